"""Phrases of two to four words by hashed counting (PCY, DHP) with Apriori pruning, and their exact scores.

One scan of the texts for each length. The scan that counts phrases of n words exactly also counts those of n + 1 words in
BUCKETS buckets by hash. Before the next scan two bitmaps are broadcast: the buckets that reached the least count, and a bitmap
of the hashes of the frequent phrases of n words. A phrase of n + 1 words is counted exactly only if its bucket is set and
both its parts of n words are (Apriori); for bucket counts its parts must pass the same way. Both tests may let a rare phrase
through and never stop a frequent one, so exact counts decide, and results do not depend on BUCKETS.

Bitmaps have BUCKETS bits (4 MB) whatever the input; counters stop at the least count, so they are bytes, and a task gives
them out once, in compressed parts. Phrases are counted per slice of text before they leave Python, and per task before the
shuffle, so a word of a third of all texts is one row a task. Where a corpus fills all buckets, Apriori is what still prunes.

Words are those of the contract: A-Z lowered, pieces end at . , ; : ! ? and line breaks (0A-0D), words at blanks and tabs;
all bytes of other characters belong to words. Defined results: a null text is empty, a null language is `und`; repeated
rows count again; empty texts and tables give nothing. A text is cut at ends of pieces into slices of about SLICE bytes, so
memory grows with the longest piece, not with the longest text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

LEAST, TOP, LONGEST = 30, 2000, 4
#: A candidate goes where a longer one holds it and has this share (of 100) of its count; scores are shares of this scale.
SHARE, SCALE = 80, 2_000_000
BUCKETS = 1 << 25
#: Buckets of a part, and bytes of text of a slice.
PART, SLICE = 1 << 17, 4 << 20
#: Keys that a frequent word's phrases are dealt to.
SPREAD = 16


@dataclass(frozen=True)
class Counting:
    """How phrases are counted: from which count on they are frequent, their most words, buckets, and bytes of a slice."""

    least: int = LEAST
    longest: int = LONGEST
    buckets: int = BUCKETS
    slice: int = SLICE

    @property
    def kind(self) -> np.dtype:
        """Of a counter, which stops at `least`."""
        return np.dtype(np.uint8 if self.least < 128 else np.uint32)

    def place(self, h: np.ndarray) -> np.ndarray:
        return ((h * _MIX) >> np.uint64(20)).astype(np.int64) % self.buckets


_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_BREAK = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = "lang string, phrase string, n long, part int, counts binary"


class Slice:
    """Words of some texts: unit (a number for each different language and word), joined (whether the next word follows in the same piece), hash and text of each unit."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        kind = _CLASS[raw]
        inside = kind == 0
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        held = pc.ascii_lower(pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())))
        word = held.dictionary_encode()
        self.words = word.dictionary
        broken = np.cumsum(kind == 2, dtype=np.int32)  # texts are parted by a line break too
        piece = broken[start] if len(start) else np.zeros(0, np.int32)
        self.joined = np.concatenate([piece[1:] == piece[:-1], [False]]) if len(piece) else np.zeros(0, bool)
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        names = {x: i for i, x in enumerate(sorted(set(langs)))}
        code = np.array([names[x] for x in langs], np.int64)
        lang = code[np.searchsorted(first, start, side="right") - 1] if len(start) else np.zeros(0, np.int64)
        key = lang * max(1, len(self.words)) + word.indices.to_numpy()
        seen, self.unit = np.unique(key, return_inverse=True)
        self.word_of, self.lang_of, self.names = seen % max(1, len(self.words)), seen // max(1, len(self.words)), pa.array(list(names), pa.string())
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words.cast(pa.binary()).to_pylist()], np.uint64)
        salt = np.array([xxhash.xxh3_64_intdigest(x.encode(errors="replace"), 1) for x in names], np.uint64)
        self.hash = own[self.word_of] ^ salt[self.lang_of] if len(seen) else np.zeros(0, np.uint64)

    def grams(self, n: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units (rows of n) and counts of the different phrases of n words that begin at the places of keep."""
        size = max(1, len(self.hash))
        key = self.unit[keep].astype(np.int64)
        parts = []
        for j in range(1, n):
            if size and len(key) and int(key.max()) >= 2**62 // size:  # numbered anew, so that keys fit
                seen, key = np.unique(key, return_inverse=True)
                parts.append((j, seen))
            key = key * size + self.unit[keep + j]
        seen, counts = np.unique(key, return_counts=True)
        out, rest = [], seen
        for j in range(n - 1, 0, -1):
            out.append(rest % size)
            rest = rest // size
            if parts and parts[-1][0] == j:
                rest = parts.pop()[1][rest]
        return np.stack([rest, *out[::-1]], axis=1), counts

    def phrases(self, units: np.ndarray) -> pa.Array:
        cols = [self.words.take(pa.array(self.word_of[units[:, j]])) for j in range(units.shape[1])]
        return cols[0] if len(cols) == 1 else pc.binary_join_element_wise(*cols, " ")


def mixed(h: np.ndarray, n: int) -> list[np.ndarray]:
    """The hashes of the phrases of 1 to n words that begin at each place, from the words' own (places past the end repeat the first ones; they are never used)."""
    out = [h]
    for j in range(1, n):
        x = (out[-1] * _MIX) ^ np.roll(h, -j)
        out.append(x ^ (x >> np.uint64(29)))
    return out


def _set(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _add(counter: np.ndarray, places: np.ndarray, least: int) -> None:
    """Counts places; counters stop at `least`."""
    place, times = np.unique(places, return_counts=True)
    counter[place] = np.minimum(counter[place] + np.minimum(times, least), least)


def _parts(counter: np.ndarray, names: list[str]):
    """The counter as rows, a part each; empty parts are left out."""
    for p in range(0, len(counter), PART):
        part = counter[p : p + PART]
        if part.any():
            packed = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([p // PART], pa.int32()), pa.array([packed], pa.binary())], names=names)


def _slices(batches, size: int):
    """Slices of the batches' texts (columns lang, text): (texts, languages)."""
    texts, langs, total = [], [], 0
    for batch in batches:
        lang, text = batch.column(0).to_pylist(), batch.column(1)
        for i in range(batch.num_rows):
            raw = text[i].as_buffer()
            raw = raw.to_pybytes() if raw is not None else b""
            while raw:
                cut = len(raw)
                if total + len(raw) > size:
                    found = _BREAK.search(raw, max(0, size - total))
                    cut = found.start() if found else cut
                texts.append(raw[:cut])
                langs.append(lang[i] if lang[i] is not None else "und")
                raw, total = raw[cut + 1 :], total + cut
                if total >= size:
                    yield texts, langs
                    texts, langs, total = [], [], 0
    if texts:
        yield texts, langs


def _scan(docs: DataFrame, n: int, how: Counting, known, buckets) -> DataFrame:
    """One pass: rows (lang, phrase, n) of phrases of n words that may be frequent (for n = 1 also one with a null phrase: all words), and rows (part, counts) of the buckets of n + 1 words. known: broadcast bitmap of frequent phrases of n - 1 words; buckets: of n words."""
    names = [f.split()[0] for f in _COUNTS.split(", ")]

    def run(batches):
        counter = np.zeros(how.buckets if n < how.longest else 0, how.kind)
        before, bits = (np.frombuffer(b.value, np.uint8) if b is not None else None for b in (known, buckets))
        for texts, langs in _slices(batches, how.slice):
            s = Slice(texts, langs)
            if not len(s.unit):
                continue
            h = mixed(s.hash[s.unit], n + 1)
            passed = np.ones(len(s.unit), bool)
            for j in range(n - 1):  # the last place is never joined, so what rolls over does not count
                passed &= np.roll(s.joined, -j)
            keep = np.flatnonzero(passed)
            if n > 1:
                keep = keep[_set(before, how.place(h[n - 2][keep]))]
                keep = keep[_set(before, how.place(h[n - 2][keep + 1]))]
                keep = keep[_set(bits, how.place(h[n - 1][keep]))]
                passed[:] = False
                passed[keep] = True
            if n == 1:
                counts = np.bincount(s.unit, minlength=len(s.hash))
                units = np.arange(len(s.hash))[:, None]
                totals = np.bincount(s.lang_of, weights=counts, minlength=len(s.names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([s.names, pa.nulls(len(s.names), pa.string()), pa.array(totals), pa.nulls(len(s.names), pa.int32()), pa.nulls(len(s.names), pa.binary())], names=names)
            elif len(keep):
                units, counts = s.grams(n, keep)
            else:
                continue
            rows = len(units)
            yield pa.RecordBatch.from_arrays([s.names.take(pa.array(s.lang_of[units[:, 0]])), s.phrases(units), pa.array(counts.astype(np.int64)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
            if n < how.longest:
                at = np.flatnonzero(passed[:-1] & passed[1:] & s.joined[:-1])
                _add(counter, how.place(h[n][at]), how.least)
            pa.default_memory_pool().release_unused()
        yield from _parts(counter, names)

    return materialize(docs.mapInArrow(run, _COUNTS), f"phrases-{n}")


def _bitmap(rows: DataFrame, how: Counting):
    """The broadcast bitmap of the buckets whose counts (rows part, counts) reach `least`. A part's rows are added up as they come, one part at a time; the driver puts BUCKETS bits together."""

    def run(batches):
        now, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= how.least, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(pa.decompress(packed.as_py(), PART * how.kind.itemsize, codec="zstd"), how.kind)
                if part != now and now is not None:
                    yield done()
                now, total = part, x if part != now else np.minimum(total + x, how.least)
        if now is not None:
            yield done()

    spark = rows.sparkSession
    parts = rows.filter("part is not null").select("part", "counts").repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, bits binary").collect()
    bits = bytearray(how.buckets // 8)
    for part, x in parts:
        bits[part * PART // 8 : part * PART // 8 + len(x)] = x
    return spark.sparkContext.broadcast(bytes(bits))


def _known(frequent: DataFrame, n: int, how: Counting):
    """The broadcast bitmap of the hashes of frequent phrases (lang, phrase) of n words."""
    names, how = [f.split()[0] for f in _COUNTS.split(", ")], replace(how, least=1)

    def run(batches):
        counter = np.zeros(how.buckets, how.kind)
        for batch in batches:
            salt = [xxhash.xxh3_64_intdigest(x.encode(errors="replace"), 1) for x in batch.column(0).to_pylist()]
            words = [[xxhash.xxh3_64_intdigest(w) for w in p.split(b" ")] for p in batch.column(1).cast(pa.binary()).to_pylist()]
            h = np.array(words, np.uint64).reshape(-1, n) ^ np.array(salt, np.uint64)[:, None]
            _add(counter, how.place(mixed(h.ravel(), n)[-1].reshape(-1, n)[:, 0]), 1)
        yield from _parts(counter, names)

    return _bitmap(frequent.select("lang", "phrase").mapInArrow(run, _COUNTS), how)


def frequent_phrases(docs: DataFrame, lang: Column, text: Column, how: Counting = Counting()) -> tuple[list[DataFrame], DataFrame]:
    """([words, phrases of two words, ...] as lang, phrase, n: those that occur how.least times or more; all words of each language as lang, n)."""
    rows = docs.select(lang.cast("string").alias("lang"), text.cast("string").alias("text"))
    known = buckets = totals = None
    out = []
    for n in range(1, how.longest + 1):
        raw = _scan(rows, n, how, known, buckets)
        exact = raw.filter("part is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if n == 1:
            totals = materialize(exact.filter("phrase is null").select("lang", "n"), "phrase-totals")
        out.append(materialize(exact.filter(F.col("phrase").isNotNull() & (F.col("n") >= how.least)), "phrases-frequent"))
        if n < how.longest:
            old, known, buckets = (known, buckets), _known(out[-1], n, how), _bitmap(raw, how)
            for b in old:
                if b is not None:
                    b.destroy()
        discard(raw)
    return out, totals


def _cut_scores(frequent: list[DataFrame]) -> DataFrame:
    """Candidates with the lowest score of their cuts: lang, phrase, size, a, l, r, score."""
    parts = None
    for f in frequent[:-1]:
        parts = f if parts is None else parts.unionByName(f)
    whole = None
    for f in frequent[1:]:
        whole = f if whole is None else whole.unionByName(f)
    words = F.split("phrase", " ")
    cuts = whole.select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    # a frequent word begins or ends many phrases: those of one word are dealt to SPREAD keys. Spark takes an exploded table to be as
    # small as before, and would broadcast SPREAD times what it allows: such joins are told to sort both sides
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)).cast("int")
    side = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cuts = cuts.select("lang", "phrase", F.size("words").alias("size"), "a", "k", salt.alias("salt"), side(F.lit(1), F.col("k")).alias("head"), side(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    dealt = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    for name, to in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(dealt.select("lang", F.col("phrase").alias(name), "salt", F.col("n").alias(to)).hint("merge"), ["lang", name, "salt"])
    score = F.expr(f"cast({SCALE} as decimal(20, 0)) * a div (l + r)")
    best = cuts.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "size", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, lang: Column, text: Column, how: Counting = Counting(), top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases."""
    frequent, totals = frequent_phrases(docs, lang, text, how)
    scored = materialize(_cut_scores(frequent), "phrases-scored")
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    held = scored.filter("size > 2").select("lang", F.col("a").alias("longer"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(held.hint("merge"), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < share * F.col("a").cast("decimal(20,0)")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for key in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))], ["lang"]):  # first within parts of a language, so that no task sorts a whole one
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= top)
    return left.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
