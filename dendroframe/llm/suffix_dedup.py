"""Removal of repeated byte strings, by longest-previous-factor arrays over suffix order.

A window (a string of `length` bytes) is repeated if it also starts anywhere else in the table, same document included.
Windows are dealt out by content: each belongs to its minimiser, the least hash of its 48-byte grams, so equal windows meet.
Runs of neighbouring windows with one minimiser travel together as one string. Strings are first compared by hash, so
exact copies never move; only strings that share a minimiser with a different string are fetched, once each, and put in
suffix order. There, previous and next smaller positions give each window's earlier match (its longest previous factor).
Removing what an earlier match covers keeps first copies; the matches themselves are marked too where no copy shall stay.

Minimisers with many different strings are not gathered: their strings meet as pairs of blocks. That work grows with the
square of their number, so beyond PAIRED strings windows are counted by a 128-bit hash instead, which grows in proportion.
Strings that are equal as a whole, and windows that are counted, are told apart by 128-bit hashes; all else byte by byte.

Defined results: a null text counts as empty; rows that are equal in id and text are documents of their own, each a copy of
the other; texts shorter than `length` lose nothing; overlaps within a document count; the result has one row per input row.
The id may be null or repeated (rows are told apart by 128 bits of id and text). An empty table gives an empty
result. A very long text is taken in pieces of SEGMENT windows. "First" means lowest by hash order of (id, text), then position. Column names
do not clash: only id and text are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt, materialize, spread_join

LENGTH = 400
GRAM = 48
#: Windows of a string at most; longer runs are cut (any cut is right: windows are compared one by one).
LONGEST_RUN = 2048
#: Different strings of one minimiser that are put in suffix order together.
GROUP = 128
#: Different strings of one minimiser that meet as pairs of blocks (64 blocks); of more, windows are counted by hash.
PAIRED = 8192
BATCH_BYTES = 2_000_000
#: Windows whose minimisers are sought at once, over the texts of a batch: some twenty arrays of 8 bytes each.
SEGMENT = 262_144
_MULT = 0x9E3779B97F4A7C15


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every gram, by doubling."""
    table = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    power = lambda n: np.uint64(pow(_MULT, n, 2**64))
    with np.errstate(over="ignore"):
        h, size, parts = table[data], 1, []
        rest = gram
        while rest:
            if rest & 1:
                parts.append((h, size))
            rest >>= 1
            if rest:
                h = h[:-size] * power(size) + h[size:]
                size *= 2
        n = len(data) - gram + 1
        out, at = np.zeros(n, np.uint64), 0
        for h, size in reversed(parts):
            out *= power(size)
            out += h[at : at + n]
            at += size
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _sliding(values: np.ndarray, w: int, op) -> np.ndarray:
    """op (minimum or maximum) of every w neighbours, by running values inside blocks."""
    n = len(values) - w + 1
    pad = -len(values) % w
    fill = values[-1:].repeat(pad)
    blocks = np.concatenate([values, fill]).reshape(-1, w)
    right = op.accumulate(blocks, axis=1).ravel()
    left = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(left[:n], right[w - 1 : w - 1 + n])


def runs_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The strings of many texts: text number, start, windows, minimiser, two hashes of the bytes, and whether the minimiser's gram occurs twice in it."""
    out = {k: [] for k in ("doc", "start", "n", "m", "g1", "g2", "twice")}
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    if not long:
        return {k: np.zeros(0, np.int64) for k in out}
    raw = b"".join([texts[i] for i in long])
    data = np.frombuffer(raw, np.uint8)
    size = np.array([len(texts[i]) for i in long])
    base = np.cumsum(size) - size
    h = _gram_hashes(data, gram)
    w = length - gram + 1
    m = _sliding(h, w, np.minimum)
    places = np.arange(len(m))
    doc = np.repeat(np.arange(len(long)), size)[: len(m)]
    fits = places + length <= (base + size)[doc]
    # a string ends where the minimiser or the document changes
    new = np.r_[True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]
    new &= fits
    start = np.flatnonzero(new)
    last = np.minimum(np.r_[start[1:], len(m)], (base + size)[doc[start]] - length + 1)
    n = last - start
    pieces = -(-n // LONGEST_RUN)
    if (pieces > 1).any():
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, n = np.repeat(start, pieces) + step * LONGEST_RUN, np.minimum(np.repeat(n, pieces) - step * LONGEST_RUN, LONGEST_RUN)
    # grams that are some window's minimiser; windows that cross documents only add places
    top = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), m, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    chosen = np.flatnonzero(h == top[: len(h)])
    a, b = np.searchsorted(chosen, start), np.searchsorted(chosen, start + n + w - 1)
    took = b - a
    at = np.arange(took.sum()) - np.repeat(np.cumsum(took) - took, took) + np.repeat(a, took)
    hits = h[chosen[at]] == np.repeat(m[start], took)
    twice = np.bincount(np.repeat(np.arange(len(start)), took), hits, len(start)) > 1
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[s : s + k + length - 1]) for s, k in zip(start.tolist(), n.tolist())]), "<i8").reshape(-1, 2)
    d = doc[start]
    return {"doc": np.array(long)[d], "start": start - base[d], "n": n, "m": m[start].view(np.int64), "g1": digests[:, 0], "g2": digests[:, 1], "twice": twice}


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """For every place the rank of its suffix by its first `depth` bytes (8 or more; beyond the end: zeros), by doubling."""
    n = len(data)
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | x[i : i + n]
    rank, size = _dense(key), 8
    while size < depth:
        step = min(size, depth - size)
        nxt = np.zeros(n, np.uint64)
        nxt[: max(0, n - step)] = rank[step:] + np.uint64(1)
        rank = _dense((rank << np.uint64(32)) | nxt)
        size += step
    return rank.astype(np.int64)


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]]).astype(np.uint64)
    return out


def smaller_neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank in suffix order, the nearest rank before and after it that holds a smaller position (-1: none), by jumping."""
    n = len(order)
    out = []
    for pos, back in ((order, False), (order[::-1], True)):
        p = np.arange(n) - 1
        live = np.flatnonzero(p >= 0)
        while len(live):
            live = live[pos[p[live]] > pos[live]]
            p[live] = p[p[live]]
            live = live[p[live] >= 0]
        out.append(np.where(p[::-1] < 0, -1, n - 1 - p[::-1]) if back else p)
    return out[0], out[1]


def earlier_matches(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of the places `starts`, an earlier one of them with the same `length` bytes, or -1.

    In suffix order cut at `length`, the longest previous factor of a place reaches `length` if the previous or the next
    smaller position has the same rank.
    """
    rank = suffix_ranks(data, length)[starts]
    order = np.lexsort((starts, rank))
    prev, nxt = smaller_neighbours(starts[order])
    of = rank[order]
    found = np.full(len(starts), -1)
    for near in (prev, nxt):
        ok = (near >= 0) & (of[near] == of)
        found[order[ok]] = starts[order[near[ok]]]
    return found


def repeated_windows(strings: list[bytes], length: int = LENGTH, keep_first: bool = False) -> list[np.ndarray]:
    """For each string a mask over its windows: those that occur again in these strings (or, with keep_first, that occurred before)."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    base = np.cumsum(size) - size
    n = np.maximum(size - length + 1, 0)
    starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(base, n)
    found = earlier_matches(np.frombuffer(b"".join(strings), np.uint8), starts, length)
    mark = found >= 0
    if not keep_first:
        mark[np.searchsorted(starts, found[mark])] = True
    return np.split(mark, np.cumsum(n)[:-1])


def intervals(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def _window_hashes(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    return _gram_hashes(data, length).view(np.int64), _gram_hashes(data ^ np.uint8(0x5A), length).view(np.int64)


def _row_keys(id_col: str, text_col: str) -> list:
    """k1, k2: together 128 bits of the id and the text, which tell the rows apart."""
    return [F.xxhash64(F.lit(1), id_col, text_col).alias("k1"), F.xxhash64(F.lit(2), text_col, id_col).alias("k2")]


def _pieces(column: pa.Array, length: int, limit: int):
    """Lists of (row, start, bytes) with about `limit` windows together; the pieces of a long text overlap by length - 1 bytes, so every window is in one of them."""
    out, size = [], 0
    for i in range(len(column)):
        text = column[i].as_py()
        for a in range(0, len(text) - length + 1, limit):
            if out and size + min(limit, len(text) - a) > limit:
                yield out
                out, size = [], 0
            out.append((i, a, text[a : a + limit + length - 1]))
            size += len(out[-1][2])
    if out:
        yield out


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(keyed, spans): the documents with their keys k1, k2, and for each key the runs [a, b) of windows that are repeated."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_col), *_row_keys(id_col, text_col), raw.alias("raw"))

    def cut(batches):
        for batch in batches:
            for part in _pieces(batch.column(2), length, SEGMENT):
                r = runs_of([p[2] for p in part], length)
                row, at = (np.array([p[k] for p in part]) for k in (0, 1))
                d = pa.array(row[r["doc"]])
                r["start"] = r["start"] + at[r["doc"]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(d), batch.column(1).take(d), *(pa.array(r[c].astype(np.int64)) for c in ("m", "g1", "g2")), *(pa.array(r[c].astype(np.int32)) for c in ("start", "n")), pa.array(r["twice"].astype(bool))], names=["k1", "k2", "m", "g1", "g2", "start", "n", "twice"])
                del r, d
            pa.default_memory_pool().release_unused()

    runs = keyed.filter(F.length("raw") >= length).select("k1", "k2", "raw").mapInArrow(cut, "k1 long, k2 long, m long, g1 long, g2 long, start int, n int, twice boolean")
    runs = materialize(runs, "suffix-runs")
    # minimisers that occur again: all their strings equal (lo = hi), or different ones
    again = runs.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.min("g1").alias("lo"), F.max("g1").alias("hi"), F.min("g2").alias("lo2"), F.max("g2").alias("hi2"), F.max("twice").alias("t")).filter("c > 1 or t")
    again = again.select("m", ((F.col("lo") != F.col("hi")) | (F.col("lo2") != F.col("hi2"))).alias("mixed"), "c")
    shared = materialize(spread_join(runs, again, "m", "c", runs.count()).drop("twice"), "suffix-shared")
    same = shared.filter("not mixed and c > 1").select("k1", "k2", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
    unsure = shared.filter("mixed or c = 1")
    # each different string once; those that occur twice are repeated as a whole
    strings = unsure.groupBy("m", "g1", "g2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "start", "n")).alias("at"))
    strings = materialize(strings.select("m", "g1", "g2", "copies", "at.*"), "suffix-strings")
    busy = strings.groupBy("m").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > GROUP)
    placed = spread_join(strings, busy, "m", "c", strings.count(), "left").join(keyed.select("k1", "k2", "raw"), ["k1", "k2"])
    # equal rows give their strings twice; the paths below count strings, so these become single again there
    text = placed.select("m", "g1", "g2", "copies", F.coalesce("c", F.lit(1)).alias("c"), F.substring("raw", F.col("start") + 1, F.col("n") + (length - 1)).alias("s"))
    text = materialize(text, "suffix-text")
    found = _by_order(text.filter(F.col("c") <= PAIRED), length).union(_by_hash(text.filter(F.col("c") > PAIRED), length))
    whole = strings.filter("copies > 1").select("m", "g1", "g2", F.lit(0).alias("x"), F.col("n").alias("y"))
    found = whole.union(found)
    got = unsure.join(found, ["m", "g1", "g2"]).select("k1", "k2", (F.col("start") + F.col("x")).alias("a"), (F.col("start") + F.col("y")).alias("b"))
    return keyed, same.union(got)


def _by_order(text: DataFrame, length: int) -> DataFrame:
    """Repeated windows among the different strings of each minimiser, by suffix order. Strings with copies take part, but their own windows are known to be repeated."""

    def solve(keys: list, strings: list[bytes]):
        out = ([], [], [], [], [])
        for (m, g1, g2, copies), mask in zip(keys, repeated_windows(strings, length), strict=True):
            if copies > 1:
                continue
            for x, y in zip(*intervals(mask)):
                for o, v in zip(out, (m, g1, g2, x, y)):
                    o.append(v)
        return pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:3]), *(pa.array(o, pa.int32()) for o in out[3:])], names=["m", "g1", "g2", "x", "y"])

    def run(batches):
        keys, strings, size, seen, unit = [], [], 0, set(), None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for i, (m, bi, bj, g1, g2, copies) in enumerate(zip(*cols)):
                if (m, bi, bj) != unit:
                    # units of different minimisers share no window, so several small ones may be ordered together; pairs of blocks may not
                    if keys and (size > BATCH_BYTES // 2 or (bi, bj) != (0, 0) or unit[1:] != (0, 0)):
                        yield solve(keys, strings)
                        keys, strings, size = [], [], 0
                    unit, seen = (m, bi, bj), set()
                if (g1, g2) in seen:  # an equal row of the documents
                    continue
                seen.add((g1, g2))
                keys.append((m, g1, g2, copies))
                strings.append(batch.column(6)[i].as_py())
                size += len(strings[-1])
        if keys:
            yield solve(keys, strings)

    order = ["m", "bi", "bj"]
    units = dealt(text, "c", "g1", GROUP).select(*order, "g1", "g2", "copies", "s").repartition(*order).sortWithinPartitions(*order)
    return units.mapInArrow(run, "m long, g1 long, g2 long, x int, y int")


def _by_hash(text: DataFrame, length: int) -> DataFrame:
    """The same for minimisers with very many different strings: every window's 128-bit hash is counted, so no group is ever gathered."""
    single = text.dropDuplicates(["m", "g1", "g2"])

    def spread(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                m, g1, g2, copies = (batch.column(k)[i].as_py() for k in range(4))
                h1, h2 = _window_hashes(batch.column(4)[i].as_py(), length)
                n = len(h1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v), pa.int64()) for v in (m, g1, g2, min(copies, 2))] + [pa.array(h1), pa.array(h2), pa.array(np.arange(n, dtype=np.int32))], names=["m", "g1", "g2", "copies", "h1", "h2", "x"])

    windows = single.select("m", "g1", "g2", "copies", "s").mapInArrow(spread, "m long, g1 long, g2 long, copies long, h1 long, h2 long, x int")
    again = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("c")).filter("c > 1").select("h1", "h2")
    hits = windows.filter("copies = 1").join(again, ["h1", "h2"]).groupBy("m", "g1", "g2").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    # neighbouring windows become runs
    i = F.sequence(F.lit(1), F.size("xs"))
    heads = F.filter(i, lambda j: (j == 1) | (F.element_at("xs", j) != F.element_at("xs", F.greatest(j - 1, F.lit(1))) + 1))
    tails = F.filter(i, lambda j: (j == F.size("xs")) | (F.element_at("xs", j) + 1 != F.element_at("xs", F.least(j + 1, F.size("xs")))))
    pairs = F.arrays_zip(F.transform(heads, lambda j: F.element_at("xs", j)).alias("x"), F.transform(tails, lambda j: F.element_at("xs", j) + 1).alias("y"))
    return hits.select("m", "g1", "g2", F.explode(pairs).alias("p")).select("m", "g1", "g2", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes, kept (the bytes that stay, one after the other) and removed (maximal removed runs, as pairs of start and end)."""
    keyed, spans = repeated_spans(docs, length, id_col, text_col)
    per = spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    joined = keyed.join(per, ["k1", "k2"], "left").select(id_col, "raw", "runs")
    schema = docs.select(id_col).schema.add("n_bytes", "long").add("kept", "binary").add("removed", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def done(part: pa.RecordBatch, kept: list, removed: list, size: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kind)], names=[id_col, "n_bytes", "kept", "removed"])

    def run(batches):
        for batch in batches:
            kept, removed, size, start = [], [], [], 0
            for row, (raw, runs) in enumerate(zip(batch.column(1), batch.column(2))):
                if sum(size) > BATCH_BYTES:  # a part of the batch
                    yield done(batch.slice(start, row - start), kept, removed, size)
                    kept, removed, size, start = [], [], [], row
                raw = raw.as_py()
                merged: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"] + length - 1) for r in runs.as_py() or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                at, parts = 0, []
                for a, b in merged:
                    parts.append(raw[at:a])
                    at = b
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                size.append(len(raw))
                removed.append([{"start": a, "end": b} for a, b in merged])
            yield done(batch.slice(start), kept, removed, size)
            pa.default_memory_pool().release_unused()

    return joined.mapInArrow(run, schema)
