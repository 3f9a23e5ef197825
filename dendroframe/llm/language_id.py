"""Language identification by segmentation-marginalised unigrams.

Every language has a unigram distribution over the pieces of a fixed public vocabulary, fitted by expectation-maximisation.
A word's probability in a language is the sum over all its segmentations into pieces (a forward algorithm); a text's is the
product over its words. The prediction is the language with the highest posterior under equal priors.

Words are runs of letters (Unicode categories L*, so digits, fractions and numerals like the roman ones are none), in lower
case. The vocabulary is every piece of the public one that is made of letters, at any length; none is dropped. The fit uses a
bounded sample of labelled rows (`sample` documents of each language, the lowest in hash order); everything else covers whole
texts of all rows. A very long text is read in parts cut at white space; a word of any length counts in full, in the fit and after.
A model beyond MODEL_BYTES (a thousand languages) is refused, as it goes to all tasks.
Defined results: a null text or one without letters is 'und' with score 0; ties go to the language that sorts first;
null languages are never learned; an empty or unlabelled training table makes every prediction 'und'; an empty table gives an
empty result; repeated rows get equal results. Other columns are kept, except that they give way to the result's names.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_chars, fresh, materialize, segments, text_slices

#: Documents of each language that the fit may read. The accuracy hardly moves beyond some hundreds.
SAMPLE = 300
ROUNDS = 4
BATCH_CHARS = 500_000
#: Words that a worker remembers.
KNOWN_WORDS = 200_000
#: Probability of a character that no piece covers, and of any piece that a language lacks.
UNKNOWN, LEAST = 1e-7, 1e-7
#: Bytes of the probabilities that may be broadcast: a quarter MB a language with a vocabulary of 32,000 pieces.
MODEL_BYTES = 256 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that are made of letters, in lower case, with the mark of a word's beginning."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p == "▁" or p.removeprefix("▁").isalpha())


def letter_runs(chunk: str) -> list[str]:
    """The runs of letters in a chunk without white space."""
    return [chunk] if chunk.isalpha() else "".join(c if c.isalpha() else " " for c in chunk).split()


def word_counts(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for chunk, n in Counter(w for t in texts for w in t.lower().split()).items():
        for w in letter_runs(chunk):
            out[w] += n
    return out


class Segments:
    """Finds all pieces in many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted(pieces)
        size = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        codes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        self.longest = int(size.max(initial=1))
        #: by length: the pieces' hashes, sorted, and their numbers
        self.known = {}
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            at = at[np.argsort(codes[at])]
            self.known[n] = (codes[at], at)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * _MULT + np.uint64(ord(c))
        return h

    def blocks(self, words: list[str], cells: int = 2_000_000):
        """Words (marked by '▁' in front) of one length at a time, as (their numbers, the matrix of their characters)."""
        size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        bounds = np.flatnonzero(np.diff(np.r_[-1, size[order]]))
        for a, b in zip(bounds, np.r_[bounds[1:], len(order)]):
            n = int(size[order[a]])
            step = max(1, cells // n)
            for i in range(a, b, step):
                at = order[i : min(b, i + step)]
                text = "".join(["▁" + words[j] for j in at])
                yield at, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(at), n)

    def found(self, chars: np.ndarray):
        """For each end j: a list of (start, piece numbers or -1), one number per word."""
        n, size = chars.shape
        head = np.zeros((size + 1, n), np.uint64)
        power = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for j in range(size):
                head[j + 1] = head[j] * _MULT + chars[:, j]
                if j < self.longest:
                    power.append(power[-1] * _MULT)
            for j in range(1, size + 1):
                out = []
                for length in range(1, min(j, self.longest) + 1):
                    if length not in self.known and length > 1:
                        continue
                    codes, number = self.known.get(length, (np.zeros(1, np.uint64), np.array([-1])))
                    h = head[j] - head[j - length] * power[length]
                    at = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
                    out.append((j - length, np.where(codes[at] == h, number[at], -1)))
                yield j, out


class LanguageModel:
    """languages (sorted), segments, and prob: for each piece and language its probability; a last row for 'no piece'."""

    def __init__(self, languages: list[str], segments: Segments, prob: np.ndarray):
        self.languages, self.segments, self.prob = languages, segments, prob
        # words whose scores are known from earlier batches: a saving of time only
        self.known: dict[str, int] = {}
        self.known_scores = np.zeros((0, len(languages)))

    def remembered(self, words: list[str]) -> np.ndarray:
        """word_scores of distinct words, with the scores of earlier batches used again."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
            self.known_scores = self.known_scores[:0]
        slot = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh = [words[i] for i in new]
            slot[new] = np.arange(len(self.known_scores), len(self.known_scores) + len(new))
            self.known.update(zip(fresh, slot[new].tolist()))
            self.known_scores = np.r_[self.known_scores, self.word_scores(fresh)]
        return self.known_scores[slot]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, all segmentations summed up."""
        out = np.zeros((len(words), len(self.languages)))
        for at, chars in self.segments.blocks(words):
            n, size = chars.shape
            alpha = [np.ones((n, len(self.languages)))]
            scale = np.zeros((n, len(self.languages)))
            for j, ends in self.segments.found(chars):
                total = np.zeros((n, len(self.languages)))
                for start, piece in ends:
                    hit = np.flatnonzero(piece >= 0)
                    if j - start == 1 and len(hit) < n:
                        miss = np.flatnonzero(piece < 0)
                        total[miss] += alpha[start][miss] * UNKNOWN
                    if len(hit) == n:
                        total += alpha[start] * self.prob[piece]
                    elif len(hit):
                        total[hit] += alpha[start][hit] * self.prob[piece[hit]]
                alpha.append(total)
                if j % 16 == 0:  # long words: keep the numbers in range
                    top = np.maximum(total, 1e-300)
                    scale += np.log(top)
                    for k in range(max(0, j - self.segments.longest), j + 1):
                        alpha[k] = alpha[k] / top
                if j > self.segments.longest:
                    alpha[j - self.segments.longest - 1] = None
            out[at] = np.log(np.maximum(alpha[size], 1e-300)) + scale
        return out

    def _add(self, parts: list[tuple[int, str]], sums: np.ndarray, letters: np.ndarray) -> None:
        """Adds the scores and letters of parts (text number, part) to those of their texts."""
        chunks: list[str] = []
        counts = np.zeros(len(parts), np.int64)
        for i, (_, t) in enumerate(parts):
            c = t.lower().split()
            chunks += c
            counts[i] = len(c)
        if not chunks:
            return
        codes, uniq = pd.factorize(np.array(chunks, dtype=object))
        words: list[str] = []
        pieces = np.ones(len(uniq), np.int64)
        for i, c in enumerate(uniq):
            found = letter_runs(c)
            words += found
            pieces[i] = len(found)
        of_chunk = np.zeros((len(uniq), len(self.languages) + 1))
        if words:
            code, w = pd.factorize(np.array(words, dtype=object))
            w = w.tolist()
            one = np.c_[self.remembered(w), np.fromiter(map(len, w), np.int64, len(w))]
            np.add.at(of_chunk, np.repeat(np.arange(len(uniq)), pieces), one[code])
        doc = np.repeat(np.array([i for i, _ in parts]), counts)
        for k in range(len(self.languages)):
            sums[:, k] += np.bincount(doc, of_chunk[codes, k], len(sums))
        letters += np.bincount(doc, of_chunk[codes, -1], len(sums))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior, and mean log probability per letter, for each text."""
        n = len(texts)
        sums, letters = np.zeros((n, len(self.languages))), np.zeros(n)
        parts = [(i, p) for i, t in enumerate(texts) for p in segments(t, BATCH_CHARS)]
        if self.languages:
            for a, b in by_chars([p for _, p in parts], BATCH_CHARS):
                self._add(parts[a:b], sums, letters)
        if not self.languages:
            return ["und"] * n, np.zeros(n), np.zeros(n)
        best = sums.argmax(axis=1)
        top = sums[np.arange(n), best]
        post = 1 / np.exp(np.minimum(sums - top[:, None], 0)).sum(axis=1)
        none = letters == 0
        post[none] = 0
        names = ["und" if x else self.languages[b] for x, b in zip(none, best)]
        return names, post, np.where(none, 0, top / np.maximum(letters, 1))


def _step(logs: np.ndarray, piece: np.ndarray, length: int) -> np.ndarray:
    """Log probability of a step over the given pieces (-1: none), words x languages."""
    return np.where((piece >= 0)[:, None], logs[piece], np.log(UNKNOWN) if length == 1 else -np.inf)


def fit(words: dict[str, dict[str, int]], pieces: list[str]) -> LanguageModel:
    """words: for each language its words and their counts. Expectation-maximisation of the piece probabilities."""
    languages = sorted(k for k, v in words.items() if v)
    vocab = sorted({w for k in languages for w in words[k]})
    at = {w: i for i, w in enumerate(vocab)}
    count = np.zeros((len(vocab), len(languages)))
    for k, lang in enumerate(languages):
        for w, c in words[lang].items():
            count[at[w], k] = c
    seg = Segments(pieces or ["▁"])
    prob = np.full((len(seg.pieces), len(languages)), 1.0 / max(1, len(seg.pieces)))
    for _ in range(ROUNDS):
        got, logs = np.zeros_like(prob), np.log(prob)
        for idx, chars in seg.blocks(vocab, 400_000):
            n, size = chars.shape
            ends = list(seg.found(chars))
            # logarithms of the forward sums, so that words of any length count in full
            fwd = np.zeros((size + 1, n, len(languages)))
            for j, parts in ends:
                fwd[j] = np.logaddexp.reduce([fwd[start] + _step(logs, piece, j - start) for start, piece in parts])
            # how often a segmentation has a boundary here: that of each end, dealt out to the starts of its pieces
            cuts = np.zeros((size + 1, n, len(languages)))
            cuts[size] = count[idx]
            for j, parts in reversed(ends):
                for start, piece in parts:
                    flow = cuts[j] * np.exp(fwd[start] + _step(logs, piece, j - start) - fwd[j])
                    cuts[start] += flow
                    hit = piece >= 0
                    np.add.at(got, piece[hit], flow[hit])
        prob = np.maximum(got / np.maximum(got.sum(axis=0), 1e-300), LEAST)
    return LanguageModel(languages, seg, prob / prob.sum(axis=0))


def train(labelled: DataFrame, vocab_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> LanguageModel:
    """Fits on at most `sample` labelled rows of each language: those lowest in hash order. A hash range of each language keeps about twice that many before they are put in order, so no language is ever gathered; only the sample's word counts come to the driver."""
    h = F.xxhash64(F.lit(11), F.col(id_col), F.xxhash64(F.col(text_col)))
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = materialize(rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    rows = rows.select(F.col(lang_col).alias("lang"), h.alias("h"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).join(sizes, "lang")
    rows = rows.filter((F.col("n") <= 2 * sample) | (F.abs(F.col("h") % 1_000_000_007) < 1e9 * 2 * sample / F.col("n")))
    w = Window.partitionBy("lang").orderBy("h", "id")
    rows = rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= sample).select("lang", "text")

    def count(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 1, BATCH_CHARS):
                langs = part.column(0).to_pylist()
                for lang in sorted(set(langs)):
                    got = word_counts([t for t, own in zip(texts, langs) if own == lang])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["lang", "word", "n"])

    words: dict[str, dict[str, int]] = {}
    for r in rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        words.setdefault(r[0], {})[r[1]] = r[2]
    return fit(words, vocabulary(vocab_path))


_models: dict[str, LanguageModel] = {}


def _loaded(key: str, held) -> LanguageModel:
    if key not in _models:
        _models.clear()
        languages, pieces, prob = held.value
        _models[key] = LanguageModel(languages, Segments(pieces), prob)
    return _models[key]


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", keep_text: bool = True, names: tuple[str, str, str] = ("lang_pred", "score", "lang_fit")) -> DataFrame:
    """Adds the language, the posterior and the mean log probability of a letter, under the given names. Without keep_text the text does not come back from the workers."""
    new = list(zip(names, ("string", "double", "double")))
    kept = [c for c in df.columns if c not in {n for n, _ in new} and (keep_text or c != text_col)]
    if model.prob.nbytes > MODEL_BYTES:
        raise ValueError(f"the model of {len(model.languages)} languages has {model.prob.nbytes} bytes; at most {MODEL_BYTES} are broadcast")
    held = df.sparkSession.sparkContext.broadcast((model.languages, model.segments.pieces, model.prob))
    key = uuid.uuid4().hex
    schema = df.select(*(df[f"`{c}`"] for c in kept)).schema
    for n, t in new:
        schema = schema.add(n, t)

    def run(batches):
        m = _loaded(key, held)
        for batch in batches:
            for part, texts in text_slices(batch, len(kept), BATCH_CHARS):
                found, post, per = m.predict(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(found, pa.string()), pa.array(post, pa.float64()), pa.array(per, pa.float64())], names=[*kept, *(n for n, _ in new)])

    return df.select(*(df[f"`{c}`"] for c in kept), df[f"`{text_col}`"].alias(fresh(df.columns, "_language_text"))).mapInArrow(run, schema)


#: A document fits no learned language if a letter's mean log probability is below this (a uniform choice of 26 letters: -3.3).
LEAST_FIT = -6.0


def accepted(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language is certain: not 'und', with a posterior of one half or more, and a fit of LEAST_FIT or more. The columns stay as they are."""
    mark = fresh(df.columns, "_language")
    names = (f"{mark}_pred", f"{mark}_score", f"{mark}_fit")
    out = identify(df, model, text_col, names=names).filter((F.col(names[0]) != "und") & (F.col(names[1]) >= 0.5) & (F.col(names[2]) >= LEAST_FIT))
    return out.select(*(F.col(f"`{c}`") for c in df.columns))


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
