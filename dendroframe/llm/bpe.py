"""BPE encoding and decoding with a public tokenizer's JSON file.

Merging runs in batched numpy rounds: the symbols of many words lie in one flat array; in every round each word's
lowest-ranked pair is found (binary search over the sorted pair keys) and merged, until no word has a known pair.

Defined results: a null text encodes as the empty text; the empty text has no ids and decodes to ''. Repeated rows give
repeated results; an empty table gives an empty result. A very long text is encoded in parts cut before a blank or a line
break, where no token can cross. Other columns are kept, whatever their names; the result columns replace columns of the same names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import by_chars, ragged_take, segments, text_slices

#: Characters that are encoded at once; bounds a worker's memory.
BATCH_CHARS = 2_000_000
#: Pieces that a worker remembers.
KNOWN_PIECES = 150_000
_NONE = np.int64(1 << 40)
_FAR = re.compile("[^\x00-\u024f]")
#: Marks an added token among the words, which hold no white space themselves.
_ADDED = " "


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest moves above U+0100 in order."""
    same = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(same))}
    return [moved.get(b, chr(b)) for b in range(256)]


class Bpe:
    """A byte-level BPE model read from a tokenizer's JSON text."""

    def __init__(self, spec: str):
        t = json.loads(spec)
        m = t["model"]
        if m["type"] != "BPE" or m.get("byte_fallback") or m.get("dropout") or m.get("continuing_subword_prefix") or m.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE models are supported")
        steps = (t.get("normalizer") or {}).get("normalizers", [t["normalizer"]] if t.get("normalizer") else [])
        kinds = [s["type"] for s in steps]
        if any(k not in ("NFC", "Replace", "Lowercase") for k in kinds):
            raise ValueError(f"unsupported normalizers {kinds}")
        if any(s["type"] == "Replace" and (s["pattern"], s["content"]) != ({"Regex": "\\s+"}, " ") for s in steps):
            raise ValueError("unsupported replacement")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = t["pre_tokenizer"]["pretokenizers"]
        if [p["type"] for p in pre] != ["Split", "ByteLevel"] or pre[0]["behavior"] != "Removed" or not pre[0]["invert"] or pre[1]["use_regex"] or pre[1]["add_prefix_space"]:
            raise ValueError("unsupported pre-tokenizer")
        if t.get("decoder"):
            raise ValueError("unsupported decoder")
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
        #: Normalises and splits texts outside Latin, where Unicode versions differ; never merges.
        self.library = Tokenizer.from_str(spec)
        self.vocab: dict[str, int] = m["vocab"]
        self.added = {a["content"]: a["id"] for a in t.get("added_tokens", [])}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in t.get("added_tokens", [])):
            raise ValueError("unsupported added token")
        self.added_re = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        suffix = m.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + suffix] for c in letters], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in m["merges"]]
        self.base = np.int64(max(self.vocab.values()) + 1)
        left, right = (np.array([self.vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        # A merge is safe to apply at all its places at once unless an earlier-ranked merge uses what it makes.
        first_use = np.full(self.base, _NONE)
        for side in (left, right):
            np.minimum.at(first_use, side, np.arange(len(pairs)))
        self.safe = first_use[made] > np.arange(len(pairs))
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.tokens = np.full(size, "", dtype=object)
        for s, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = s
        # Pieces whose ids are known from earlier batches: a saving of time only.
        self.known: dict[str, int] = {}
        self.known_ids, self.known_n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.ranks[at], _NONE)

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs the merge rounds. sym: symbol ids of many words, one after the other; word: each symbol's word number, ascending. Returns the same after all merges."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), _NONE)
        if len(sym) > 1:
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self.rank(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            if not (least < _NONE).all():
                ended = np.repeat(least == _NONE, size)
                done.append((sym[ended], word[ended]))
                sym, word, rank = sym[~ended], word[~ended], rank[~ended]
                size, least = size[least < _NONE], least[least < _NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # overlapping places (a run of one symbol): every other one, from the left
            run_start = np.r_[True, np.diff(hit) != 1]
            within = np.arange(len(hit)) - np.flatnonzero(run_start)[np.cumsum(run_start) - 1]
            hit = hit[within % 2 == 0]
            of = word[hit]
            first = np.r_[True, of[1:] != of[:-1]]
            hit = hit[first | self.safe[rank[hit]]]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = moved[hit]
            mark = np.zeros(len(sym), bool)
            mark[at] = mark[at[at > 0] - 1] = True
            again = np.flatnonzero(mark)
            rank[again] = _NONE
            again = again[again < len(sym) - 1]
            again = again[word[again] == word[again + 1]]
            rank[again] = self.rank(sym[again], sym[again + 1])
        if not done:
            return sym, word
        sym, word = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def clean(self, s: str) -> str:
        if _FAR.search(s):
            return self.library.normalizer.normalize_str(s) if self.library.normalizer else s
        if self.nfc and not unicodedata.is_normalized("NFC", s):
            s = unicodedata.normalize("NFC", s)
        return s.lower() if self.lower else s

    def words(self, text: str) -> list[str]:
        """The text's chunks between white space, added tokens marked."""
        parts = self.added_re.split(text) if self.added_re and any(a in text for a in self.added) else [text]
        out: list[str] = []
        for part in parts:
            if part in self.added:
                out.append(f"{_ADDED}{self.added[part]}")
            else:
                part = self.clean(part)
                out += regex.split(r"\s+", part) if re.search("[\x1c-\x1f]", part) else part.split()
        return out

    def split(self, chunk: str) -> list[str]:
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after the other, and each piece's number of ids."""
        added = np.array([p[:1] == _ADDED for p in pieces], bool)
        raw = [b"" if a else p.encode() for p, a in zip(pieces, added)]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(size)[size > 0] - 1
        sym[ends] = self.last[flat[ends]]
        sym, word = self.merge(sym, np.repeat(np.arange(len(raw)), size))
        if added.any():
            at = np.flatnonzero(added)
            sym = np.r_[sym, np.array([int(pieces[i][1:]) for i in at], np.int64)]
            word = np.r_[word, at]
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        return sym, np.bincount(word, minlength=len(pieces))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and each text's number of ids."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            w = self.words(t)
            words += w
            counts[i] = len(w)
        if not words:
            return np.zeros(0, np.int64), counts
        codes, chunks = pd.factorize(np.array(words, dtype=object))
        del words
        pieces: list[str] = []
        n_pieces = np.ones(len(chunks), np.int64)
        for i, c in enumerate(chunks):
            if c[:1] == _ADDED or c.isalpha() and not _FAR.search(c):
                pieces.append(c)
            else:
                found = self.split(c) if _FAR.search(c) else self.pattern.findall(c)
                pieces += found
                n_pieces[i] = len(found)
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        piece_code, pieces = pd.factorize(np.array(pieces, dtype=object))
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
            self.known_ids, self.known_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.fromiter((self.known.get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = np.arange(len(self.known_n), len(self.known_n) + len(new))
            fresh = pieces[new].tolist()
            self.known.update(zip(fresh, slot[new].tolist()))
            ids, n = self.encode_pieces(fresh)
            self.known_ids, self.known_n = np.r_[self.known_ids, ids], np.r_[self.known_n, n]
        start = np.cumsum(self.known_n) - self.known_n
        # chunk -> ids, then text -> ids
        chunk_ids, took = ragged_take(start, self.known_n, self.known_ids, slot[piece_code])
        bounds = np.r_[0, np.cumsum(n_pieces)]
        sums = np.r_[0, np.cumsum(took)]
        chunk_start, chunk_n = sums[bounds[:-1]], sums[bounds[1:]] - sums[bounds[:-1]]
        ids, took = ragged_take(chunk_start, chunk_n, chunk_ids, codes)
        sums = np.r_[0, np.cumsum(took)]
        ends = np.cumsum(counts)
        return ids, sums[ends] - sums[ends - counts]

    def encode_each(self, texts: list[str]) -> list[np.ndarray]:
        parts = [(i, p) for i, t in enumerate(texts) for p in segments(t, BATCH_CHARS)]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for a, b in by_chars([p for _, p in parts], BATCH_CHARS):
            ids, n = self.encode([p for _, p in parts[a:b]])
            ends = np.cumsum(n)
            for (i, _), e, k in zip(parts[a:b], ends.tolist(), n.tolist()):
                out[i].append(ids[e - k : e])
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder in the tokenizer's file, the tokens stand side by side with blanks between them. Ids without a token are left out."""
        ids = ids[ids < len(self.tokens)]
        return " ".join([t for t in self.tokens[ids].tolist() if t])


@lru_cache(maxsize=4)
def _model(spec: str) -> Bpe:
    return Bpe(spec)


def _spread(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 32 << 20:
        raise ValueError("the tokenizer's file is too large to send to every executor")
    return df.sparkSession.sparkContext.broadcast(spec)


def _result_schema(df: DataFrame, new: list[tuple[str, T.DataType]]) -> tuple[list[str], T.StructType]:
    names = {n for n, _ in new}
    kept = [f for f in df.schema.fields if f.name not in names]
    return [f.name for f in kept], T.StructType([*kept, *(T.StructField(n, t) for n, t in new)])


def bpe_encode(df: DataFrame, tokenizer_json: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ids_col: the text's ids as little-endian unsigned 32-bit integers in one binary (special tokens in a text are recognised, none are added). Drops text_col, which callers can join or keep under another name."""
    spec = _spread(df, tokenizer_json)
    df = df.drop(ids_col)
    kept, schema = _result_schema(df.drop(text_col), [(ids_col, T.BinaryType())])
    order = [*kept, text_col]

    def run(batches):
        model = _model(spec.value)
        for batch in batches:
            for part, texts in text_slices(batch, len(kept), BATCH_CHARS):
                out = [x.astype("<u4").tobytes() for x in model.encode_each(texts)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(out, pa.binary())], names=[*kept, ids_col])

    return df.select(*(df[f"`{c}`"] for c in order)).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, tokenizer_json: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Adds decoded_col: the text that the ids of ids_col (as bpe_encode packs them) decode to, special tokens included; null ids decode to ''."""
    spec = _spread(df, tokenizer_json)
    kept, schema = _result_schema(df, [(decoded_col, T.StringType())])

    def run(batches):
        model = _model(spec.value)
        for batch in batches:
            held = batch.column(kept.index(ids_col))
            start, n = 0, batch.num_rows
            while start < n:  # slices of a bounded size
                out, size, end = [], 0, start
                while end < n and (end == start or size < 4 * BATCH_CHARS):
                    raw = held[end].as_py() or b""
                    size += len(raw) * 2
                    out.append(model.decode(np.frombuffer(raw, "<u4")))
                    end += 1
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in batch.columns), pa.array(out, pa.string())], names=[*kept, decoded_col])
                start = end

    return df.select(*(df[f"`{c}`"] for c in kept)).mapInArrow(run, schema)


def bpe_round_trip(df: DataFrame, tokenizer_json: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """bpe_encode and bpe_decode in one pass: the ids of a slice of texts are decoded while they are at hand, so one Python worker per task serves both."""
    spec = _spread(df, tokenizer_json)
    df = df.drop(ids_col, decoded_col)
    kept, schema = _result_schema(df.drop(text_col), [(ids_col, T.BinaryType()), (decoded_col, T.StringType())])

    def run(batches):
        model = _model(spec.value)
        for batch in batches:
            for part, texts in text_slices(batch, len(kept), BATCH_CHARS):
                ids = model.encode_each(texts)
                arrays = [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([model.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *arrays], names=[*kept, ids_col, decoded_col])

    return df.select(*(df[f"`{c}`"] for c in [*kept, text_col])).mapInArrow(run, schema)
