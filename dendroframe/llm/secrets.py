"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what the patterns miss.

The field tags the tokens between white space as O (outside), B (a secret begins) or I (goes on), from the token's shape,
its neighbours' words and features of the file, and is decoded by Viterbi. It is fitted on a bounded sample of documents
(`sample`, lowest in hash order): their pattern matches and secrets planted into them at seeded places are the positives.

A document is decoded token by token only if some token could gain by leaving O (emission gain plus twice the largest
transition gain above 0); all others are O throughout, so the result is that of a full decoding.
Defined results: a null or empty text has no spans; spans are in code points with the end excluded; spans of the field that
touch a pattern's span give way to it; equal starts sort by kind. Repeated rows give repeated results; an empty table gives an
empty one, and a field that has learned nothing adds no span. A very long text is held whole, alone in its slice, with some 60
bytes of arrays a character. Other columns are kept, whatever their names, except that they give way to found.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, text_slices

KINDS = ("assign", "access", "hex", "crf")
#: Fixed patterns (letters of the names in either case).
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
#: Documents that the fit may read.
SAMPLE = 800
WINDOW = 16
BATCH_CHARS = 1_000_000
O, B, I = 0, 1, 2  # noqa: E741
_NEVER = -1e4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns: per kind leftmost, without overlap; short matches are dropped."""
    out = []
    low = text.encode(errors="replace").lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in low.translate(_HEX_ONLY):  # low has all that the text has, and capitals: a necessary sign only
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


_HEX_ONLY = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))


def _class_table() -> np.ndarray:
    """Classes of bytes: 0 white space, 1 digit, 2 lower, 3 upper, 4 other ASCII, 5 beyond ASCII."""
    t = np.full(256, 4, np.uint8)
    t[:33] = 0
    t[ord("0") : ord("9") + 1] = 1
    t[ord("a") : ord("z") + 1] = 2
    t[ord("A") : ord("Z") + 1] = 3
    t[128:] = 5
    return t


_CLASS = _class_table()
_LENGTHS = np.searchsorted([2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 48, 72], np.arange(73), side="right").astype(np.int64)
#: Sizes of the feature columns, in order.
SIZES = (13, 5, 5, 5, 6, 16, 5, 2, 4, 6, 4, 2, 5 * 6 * 2)


class Tokens:
    """The tokens of several texts, as places in one array of bytes, and their features."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.base = np.cumsum(sizes) - sizes
        self.data, cls = data, _CLASS[data]
        inside = cls != 0
        edge = np.diff(np.r_[0, inside.view(np.int8), 0])
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.base, self.start, side="right") - 1
        self.cls = cls
        self.features = self._features(cls, sizes) if len(self.start) else np.zeros((len(SIZES), 0), np.int64)

    def _count(self, what: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(what, dtype=np.int32)]
        return (sums[self.end] - sums[self.start]).astype(np.int64)

    def _features(self, cls: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        d, n = self.data, self.end - self.start
        digits, lower, upper, other, far = (self._count(cls == k) for k in (1, 2, 3, 4, 5))
        share = lambda x: np.where(x == 0, 0, np.minimum(4, 1 + (x * 10 > n * 2).astype(int) + (x * 10 > n * 5) + (x * 10 > n * 8)))
        kind = np.where(cls == 3, 2, cls)
        switch = np.r_[False, (kind[1:] != kind[:-1])]
        switches = self._count(switch) - switch[self.start]
        turns = np.searchsorted([1, 2, 3, 5, 9], switches, side="right")
        first, last = d[self.start], d[self.end - 1]
        quote = lambda c: (c == 34) | (c == 39)
        signs = (self._count(d == 64) > 0) * 1 + (self._count((d == 61) | (d == 58)) > 0) * 2 + quote(first) * 4 + (far > 0) * 8
        low = self.raw.lower()
        at = []
        for name in NAMES:
            i = low.find(name)
            while i >= 0:
                at.append(i)
                i = low.find(name, i + 1)
        named = np.zeros(len(n), bool)
        doc_named = np.zeros(len(sizes), bool)
        if at:
            tok = np.searchsorted(self.start, np.array(at), side="right") - 1
            named[tok] = True
            doc_named[self.doc[tok]] = True
        sign = (n == 1) & ((first == 61) | (first == 58))
        ends_sign = ~sign & ((last == 61) | (last == 58))
        own = np.where(named, 1, np.where(sign, 2, np.where(ends_sign, 3, np.where(digits > 0, 4, 0))))
        same = np.r_[False, self.doc[1:] == self.doc[:-1]]
        before = np.where(same, np.r_[0, own[:-1]], 0)
        same2 = np.r_[[False] * min(2, len(n)), self.doc[2:] == self.doc[:-2]]
        before2 = np.where(same2, np.r_[[False] * min(2, len(n)), named[:-2]], False)
        after = np.where(np.r_[same[1:], False], np.r_[own[1:], 0], 0)
        size = np.searchsorted([1000, 8000], sizes)[self.doc]
        hexes = self._count(((d >= 48) & (d <= 57)) | ((d >= 97) & (d <= 102)))
        plain = digits + lower + upper + self._count((d == 43) | (d == 47) | (d == 61) | (d == 95) | (d == 45))
        charset = (hexes == n) * 1 + (plain == n) * 2
        return np.stack([
            _LENGTHS[np.minimum(n, 72)], share(digits), share(upper), share(other), turns, signs, before, before2.astype(int),
            np.where(after == 0, 0, np.where(after == 1, 1, np.where(after == 4, 2, 3))), doc_named[self.doc] * 3 + size, charset, named.astype(int),
            (share(digits) * 6 + turns) * 2 + (n >= 16),
        ])

    def span(self, i: int, j: int) -> tuple[int, int, int]:
        """Document, and bytes from its start, of tokens i to j without quotes and punctuation around."""
        a, b = int(self.start[i]), int(self.end[j])
        while a < b and self.raw[a : a + 1] in b"\"'([{<":
            a += 1
        while b > a and self.raw[b - 1 : b] in b"\"')]}>,;.:!?":
            b -= 1
        k = int(self.doc[i])
        return k, a - int(self.base[k]), b - int(self.base[k])


class Field:
    """weights: one table (values x 3 states) per feature column; moves: 3 x 3, from and to."""

    def __init__(self, weights: list[np.ndarray], moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.moves[O, I] = _NEVER
        usable = self.moves[self.moves > _NEVER / 2]
        self.gain = max(0.0, float(usable.max() - self.moves[O, O]))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((features.shape[1], 3))
        for w, f in zip(self.weights, features):
            out += w[f]
        return out

    def decode(self, e: np.ndarray) -> list[int]:
        """Viterbi over one document's tokens; ties go to the smaller state."""
        m = self.moves.tolist()
        back = []
        s = [e[0][O], e[0][B], _NEVER]
        for row in e[1:].tolist():
            new, came = [], []
            for k in range(3):
                best, src = s[0] + m[0][k], 0
                for j in (1, 2):
                    x = s[j] + m[j][k]
                    if x > best:
                        best, src = x, j
                new.append(best + row[k])
                came.append(src)
            s = new
            back.append(came)
        k = max(range(3), key=lambda j: (s[j], -j))
        out = [k]
        for came in reversed(back):
            k = came[k]
            out.append(k)
        return out[::-1]

    def spans(self, t: Tokens) -> list[tuple[int, int, int]]:
        """(document, start, end) in bytes."""
        if not len(t.start):
            return []
        e = self.emissions(t.features)
        hot = np.maximum(e[:, B], e[:, I]) - e[:, O] + 2 * self.gain > 0
        out = []
        bounds = np.searchsorted(t.doc, np.arange(len(t.base) + 1))
        for k in np.unique(t.doc[hot]).tolist():
            a, b = bounds[k], bounds[k + 1]
            tags, i = self.decode(e[a:b]), 0
            while i < len(tags):
                if tags[i] == O:
                    i += 1
                    continue
                j = i
                while j + 1 < len(tags) and tags[j + 1] == I:
                    j += 1
                out.append(t.span(a + i, a + j))
                i = j + 1
        return out


def _planted(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with secrets put between its words, and where they are (code points)."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = alphabet + alphabet[:26].lower() * 2
    kinds = [
        lambda: ("", "AKIA" + "".join(rng.choices(alphabet, k=16))),
        lambda: (rng.choice(["password=", "passwd: ", 'token = "', "api_key=", "secret = "]), "".join(rng.choices("0123456789abcdef", k=rng.choice([18, 32, 40])))),
        lambda: ("", "".join(rng.choices(mixed, k=rng.randrange(28, 48)))),
        lambda: (rng.choice(["key: ", "auth = ", "token "]), "".join(rng.choices(mixed, k=rng.randrange(20, 40)))),
        lambda: ("", rng.choice(".-_").join("".join(rng.choices(mixed, k=rng.randrange(8, 48))) for _ in range(rng.randrange(2, 4)))),
    ]
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 10)))
    # what looks odd and is no secret
    harmless = [
        lambda: f"{name()}.{rng.randrange(100):02}@{name()}{rng.randrange(10)}.{name()}.{rng.choice(['com', 'org', 'net'])}",
        lambda: f"+{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}",
        lambda: "".join(rng.choices("0123456789", k=rng.randrange(9, 17))),
        lambda: f"https://{name()}.{name()}.com/{name()}/{rng.randrange(10000)}?{name()}={rng.randrange(100)}",
        lambda: f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
        lambda: f"{name().capitalize()}{name().capitalize()}{name().capitalize()}",
        lambda: f"{name()}_{name()}_{rng.randrange(100)}",
        lambda: "".join(w for w in (name(), name(), name(), name())),
    ]
    words, spans = text.split(" "), []
    places = {rng.randrange(len(words) + 1) for _ in range(2)}
    quiet = {rng.randrange(len(words) + 1) for _ in range(3)}
    out, size = [], 0
    for i, w in enumerate([*words, ""]):
        if i in places:
            head, value = rng.choice(kinds)()
            spans.append((size + len(head), size + len(head) + len(value)))
            piece = head + value + ('"' if '"' in head else "")
            out.append(piece)
            size += len(piece) + 1
        if i in quiet:
            out.append(x := rng.choice(harmless)())
            size += len(x) + 1
        out.append(w)
        size += len(w) + 1
    return " ".join(out), spans


def windows(text: str, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features (windows x columns x places) and tags (windows x places) of at most ten windows of a text: around secrets, around tokens with digits or signs, and at random places. Into every other text, by its hash, secrets are planted first."""
    h = xxhash.xxh64_intdigest(text.encode(errors="replace"), seed)
    rng = random.Random(h)
    text, planted = _planted(text, rng) if h % 2 == 0 else (text, [])
    t = Tokens([text.encode(errors="replace")])
    m, rows_f, rows_y = len(t.start), [], []
    if m >= WINDOW:
        y = np.zeros(m, np.int64)
        for a, b in [*planted, *((a, b) for a, b, _ in base_spans(text))]:
            a, b = len(text[:a].encode(errors="replace")), len(text[:b].encode(errors="replace"))
            i, j = np.searchsorted(t.end, a, side="right"), np.searchsorted(t.start, b, side="left")
            y[i:j] = np.where(y[i:j] == O, I, y[i:j])
            if i < j and (i == 0 or y[i - 1] == O):
                y[i] = B
        y[np.flatnonzero((y == I) & (np.r_[O, y[:-1]] == O))] = B
        odd = np.flatnonzero((y > 0) | (t.features[1] > 0) | (t.features[5] > 0))
        picks = [*(odd if len(odd) <= 4 else rng.sample(odd.tolist(), 4)), *(rng.randrange(m) for _ in range(2)), *np.flatnonzero(y == B)[:4]]
        for i in picks:
            a = int(min(max(0, i - WINDOW // 2), m - WINDOW))
            if y[a] == I:  # a window must not begin inside a secret
                continue
            rows_f.append(t.features[:, a : a + WINDOW])
            rows_y.append(y[a : a + WINDOW])
    if not rows_f:
        return np.zeros((0, len(SIZES), WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    return np.stack(rows_f), np.stack(rows_y)


def fit(texts: list[str], seed: int = 5, steps: int = 60) -> Field:
    """fit_windows on the windows of texts."""
    return fit_windows([windows(t, seed) for t in texts], steps)


def fit_windows(found: list[tuple[np.ndarray, np.ndarray]], steps: int = 60) -> Field:
    """Maximum likelihood with a quadratic penalty."""
    rows_f, rows_y = ([x[i] for x in found if len(x[1])] for i in (0, 1))
    weights, moves = [np.zeros((s, 3)) for s in SIZES], np.zeros((3, 3))
    moves[O, I] = _NEVER
    if not rows_f:  # nothing to learn from: everything is outside
        weights[0][:, O] = 50.0
        return Field(weights, moves)
    f, y = np.concatenate(rows_f), np.concatenate(rows_y)  # windows x columns x places
    n = len(y)
    seen = [np.zeros((s, 3)) for s in SIZES]
    for k, s in enumerate(seen):
        np.add.at(s, (f[:, k].ravel(), y.ravel()), 1)
    seen_moves = np.zeros((3, 3))
    np.add.at(seen_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    history = [np.zeros_like(w) for w in [*weights, moves]]
    for _ in range(steps):
        e = np.zeros((n, WINDOW, 3))
        for k, w in enumerate(weights):
            e += w[f[:, k]]
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0] + np.array([0, 0, _NEVER])
        for i in range(1, WINDOW):
            fwd[:, i] = e[:, i] + np.logaddexp.reduce(fwd[:, i - 1, :, None] + moves, axis=1)
        for i in range(WINDOW - 2, -1, -1):
            bwd[:, i] = np.logaddexp.reduce(moves + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None])
        pair = np.exp(fwd[:, :-1, :, None] + moves + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        grads = []
        for k, w in enumerate(weights):
            got = np.stack([np.bincount(f[:, k].ravel(), p[:, :, s].ravel(), len(w)) for s in range(3)], axis=1)
            grads.append(seen[k] - got - 0.5 * w)
        grads.append(seen_moves - pair - 0.5 * np.where(moves > _NEVER / 2, moves, 0))
        for w, g, h in zip([*weights, moves], grads, history):  # Adagrad
            h += g * g
            w += 0.6 * g / np.sqrt(h + 1e-6)
        moves[O, I] = _NEVER
    return Field(weights, moves)


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Field:
    """Fits on at most `sample` documents, those lowest in hash order; a hash range keeps about twice that many before the sort. Their windows are cut by a task; only these, at most ten a document, come to the driver."""
    h = F.xxhash64(F.lit(23), F.col(id_col), F.xxhash64(F.col(text_col)))
    rows = docs.filter(F.col(text_col).isNotNull())
    n = rows.count()
    if n > 2 * sample:
        rows = rows.filter(F.abs(h % 1_000_000_007) < int(1_000_000_007 * 2 * sample / n))

    def run(batches):
        for batch in batches:
            for _, texts in text_slices(batch, 0, BATCH_CHARS):
                got = [windows(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([x[i].astype("<i8").tobytes() for x in got], pa.binary()) for i in (0, 1)], names=["f", "y"])

    kept = rows.orderBy(h, id_col).limit(sample).select(text_col).mapInArrow(run, "f binary, y binary").collect()
    return fit_windows(sorted(((np.frombuffer(r.f, "<i8").reshape(-1, len(SIZES), WINDOW), np.frombuffer(r.y, "<i8").reshape(-1, WINDOW)) for r in kept), key=lambda x: x[0].tobytes()))


def scan_texts(field: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """All spans (start, end, kind) of each text, sorted."""
    out = [base_spans(t) for t in texts]
    raw = [t.encode(errors="replace") for t in texts]
    for k, a, b in field.spans(Tokens(raw)):
        a, b = (len(raw[k][:x].decode(errors="replace")) for x in (a, b))
        if b > a and all(b <= s or a >= e for s, e, _ in out[k]):
            out[k].append((a, b, 3))
    return [sorted(s, key=lambda x: (x[0], x[2], x[1])) for s in out]


def scan(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows without their text, with found: an array of (kind, start, end), by start and kind."""
    kept = [c for c in df.columns if c not in (text_col, "found")]
    held = df.sparkSession.sparkContext.broadcast((field.weights, field.moves))
    schema = df.select(*(df[f"`{c}`"] for c in kept)).schema.add("found", T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long")))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        f = Field(*held.value)
        for batch in batches:
            for part, texts in text_slices(batch, len(kept), BATCH_CHARS):
                found = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in x] for x in scan_texts(f, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(found, kind)], names=[*kept, "found"])

    return df.select(*(df[f"`{c}`"] for c in kept), df[f"`{text_col}`"].alias(fresh(df.columns, "_secret_text"))).mapInArrow(run, schema)
