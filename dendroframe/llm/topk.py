"""Exact top-k inner-product search by a three-phase uniform threshold.

The score of a query and a candidate is a sum over slices of the dimensions. Each slice of each block of candidates is a row of
its own, held by tasks that see no other slice: there its partial scores are the lists of the method.

1. Every list gives its DEPTH * k best partial scores. These entries are scored exactly, and each query's k-th best of them is a safe
   cutoff t: the true k-th best is not below it.
2. t goes back to all lists. An entry is sent if its partial score reaches t / slices; a candidate sent by no list stays below
   t in total.
3. The slices that did not send an entry are asked for its partial score too, and the totals decide. Nothing else is scored.

Blocks of candidates are shuffled once per phase, whatever the number of queries (of each QUERY_CHUNK query blocks), and the
smaller side, the blocks of queries, is copied to the groups of candidate blocks. A task holds QUERY_CHUNK blocks of queries
and one block of candidates at a time. Partial scores are computed in phases 1 and 2 (kept, the lists would be as large as
the product of both tables); phase 3 takes single entries.

Of candidates with equal vectors only those with the k + 1 smallest ids can be among a query's k best (one may be the query's
own); others of a block never become entries, so a vector that a third of all rows share costs little.

Vectors are whole numbers: floor(1024 * x). Defined results: vectors that are null, hold nulls or non-finite numbers, or have
another length than a query's, take no part with it; ties go to the smaller id; a repeated id is one candidate per row, and as
a query its least vector counts; an empty table gives an empty result; totals beyond 64 bits are held at the limit, partial
scores at 2^94. A query never meets a candidate of its own id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 10
SLICES = 2
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
#: Blocks of queries that a task holds, and blocks of candidates that meet them in one group of rows.
QUERY_CHUNK, GROUP = 64, 32
#: A list gives this many times k entries in phase 1: the deeper, the higher the cutoff, and the fewer entries phase 2 sends.
DEPTH = 8
#: Parts in which what all groups found for a query is merged.
SPREAD = 64
_LOW, _HIGH = -(2**63), 2**63 - 1
_FAR = 2**94
_PART = 2**32


def prepare(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """id, dim, v (array of long): the vectors that take part, as whole numbers."""
    x = F.transform(F.col(vec_col), lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    fine = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), x.alias("v"))


def _leading(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Which rows may be among a query's k best: of equal vectors those with the k + 1 smallest ids, of equal ids k rows."""
    if len(ids) <= k:
        return np.ones(len(ids), bool)
    _, of = np.unique(v, axis=0, return_inverse=True) if v.shape[1] else (None, np.zeros(len(ids), int))
    of = of.ravel()
    order = np.lexsort((ids, of))
    of, sorted_ids = of[order], ids[order]
    new_vector = np.r_[True, of[1:] != of[:-1]]
    new_id = new_vector | np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]
    place = np.cumsum(new_id)
    rank = place - place[np.flatnonzero(new_vector)[np.cumsum(new_vector) - 1]]  # the id's number within its vector
    run = np.arange(len(ids)) - np.flatnonzero(new_id)[place - 1]  # the row's number within its id
    keep = np.zeros(len(ids), bool)
    keep[order] = (rank <= k) & (run < k)
    return keep


def _blocks(df: DataFrame, size: int, name: str, slices: int, k: int | None) -> DataFrame:
    """Rows of one dimension in blocks, cut where they lie, a row per slice: dim, n (the block's number), s, ids, w (bytes of a number), vecs. With k, rows that cannot be among k best are left out."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def flush(dim: int):
            nonlocal seq
            ids, v = (np.concatenate(x) for x in zip(*held.pop(dim)))
            if k is not None:
                keep = _leading(ids, v, k)
                ids, v = ids[keep], v[keep]
            number = (part << 32) + seq
            seq += 1
            out = ([], [], [], [], [], [])
            for s, x in enumerate(np.array_split(v, slices, axis=1)):
                low, high = int(x.min(initial=0)), int(x.max(initial=0))
                w = next(w for w in (2, 4, 8) if -(2 ** (8 * w - 1)) <= low and high < 2 ** (8 * w - 1))
                for o, value in zip(out, (dim, number, s, ids.astype("<i8").tobytes(), w, np.ascontiguousarray(x.astype(f"<i{w}")).tobytes())):
                    o.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names=["dim", "n", "s", "ids", "w", "vecs"])

        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                rows = batch.take(pa.array(at))
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                v = rows.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                for a in range(0, len(at), size):
                    held.setdefault(dim, []).append((ids[a : a + size], v[a : a + size]))
                    if sum(len(x) for x, _ in held[dim]) >= size:
                        yield flush(dim)
            while sum(len(x) for part_ in held.values() for x, _ in part_) > 4 * size:  # many dimensions: none may pile up
                yield flush(max(held, key=lambda d: sum(len(x) for x, _ in held[d])))
        for dim in list(held):
            yield flush(dim)

    return materialize(df.select("id", "dim", "v").mapInArrow(run, "dim int, n long, s int, ids binary, w int, vecs binary"), name)


class _Side:
    """A slice of a block: ids and numbers; cut: per row its query's cutoff (queries in phase 2)."""

    def __init__(self, ids: bytes, w: int, vecs: bytes, cut: list | None = None):
        self.ids = np.frombuffer(ids, "<i8")
        self.v = np.frombuffer(vecs, f"<i{w}").reshape(len(self.ids), -1)
        self.cut = cut

    def floats(self) -> np.ndarray:
        return self.v.astype(np.float64)


def _exact(q: np.ndarray, r: np.ndarray) -> bool:
    """Whether floating-point sums of these products are exact."""
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(r.astype(float)).max(initial=0)) * max(1, q.shape[1])
    return top < 2**50


def _partials(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """All exact partial scores: floats where these are exact, else Python's integers."""
    return q.astype(np.float64) @ r.astype(np.float64).T if _exact(q, r) else np.asarray(q.astype(object) @ r.astype(object).T)


class _Lists:
    """Deals blocks of queries (kind 0), of candidates (1) and requests for single entries (2) out to groups, and reads them there in that order."""

    def __init__(self, q: DataFrame, r: DataFrame):
        n_q, n_r = (df.filter("s = 0").count() for df in (q, r))
        self.chunks, self.spread = max(1, -(-n_q // QUERY_CHUNK)), max(1, -(-n_r // GROUP))
        self.q, self.r = q, r

    def dealt(self, cuts: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
        """cuts: n (query block), cut (its rows' cutoffs). asked: dim, rb, qb, s, qi, pos (arrays)."""
        chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(self.chunks)).cast("int").alias("qc")
        salt = lambda c: F.pmod(F.xxhash64(c), F.lit(self.spread)).cast("int").alias("salt")
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        q = self.q.join(cuts, "n") if cuts is not None else self.q.withColumn("cut", F.lit(None).cast("array<long>"))
        all_salts, all_chunks = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (self.spread, self.chunks))
        rows = q.select("dim", "s", all_salts.alias("salt"), chunk("n"), F.lit(-1).cast("long").alias("rb"), F.lit(0).alias("kind"), F.col("n").alias("qb"), "ids", "w", "vecs", "cut", none("array<int>", "qi"), none("array<int>", "pos"))
        rows = rows.union(self.r.select("dim", "s", salt("n"), all_chunks.alias("qc"), F.col("n").alias("rb"), F.lit(1).alias("kind"), none("long", "qb"), "ids", "w", "vecs", none("array<long>", "cut"), none("array<int>", "qi"), none("array<int>", "pos")))
        if asked is not None:
            rows = rows.union(asked.select("dim", "s", salt("rb"), chunk("qb"), "rb", F.lit(2).alias("kind"), "qb", none("binary", "ids"), none("int", "w"), none("binary", "vecs"), none("array<long>", "cut"), "qi", "pos"))
        key = ["dim", "s", "salt", "qc"]
        return rows.repartition(*key).sortWithinPartitions(*key, "rb", "kind", "qb")

    @staticmethod
    def read(batches):
        """(what, key, queries so far by block, the current (rb, candidates), what is asked): what is 'block', 'ask' or 'end' of a group."""
        key, queries, block = None, {}, None
        for batch in batches:
            small = list(zip(*(batch.column(c).to_pylist() for c in range(7))))
            for i, (dim, s, salt, qc, rb, kind, qb) in enumerate(small):
                if (dim, s, salt, qc) != key:
                    if key is not None:
                        yield "end", key, queries, block, None
                    key, queries, block = (dim, s, salt, qc), {}, None
                if kind == 2:
                    yield "ask", key, queries, block, (qb, *(batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (11, 12)))
                    continue
                side = _Side(batch.column(7)[i].as_py(), batch.column(8)[i].as_py(), batch.column(9)[i].as_py(), batch.column(10)[i].as_py())
                if kind == 0:
                    queries[qb] = side
                else:
                    block = (rb, side)
                    yield "block", key, queries, block, None
        if key is not None:
            yield "end", key, queries, block, None


def _heads(lists: _Lists, k: int, slices: int) -> DataFrame:
    """Phase 1: dim, rb, qb, qi, pos (arrays): the entries that head the lists of any query of a block."""

    def run(batches):
        best: dict[int, list[np.ndarray]] = {}
        for what, (dim, s, _, _), queries, block, _ in _Lists.read(batches):
            if what == "block":
                rb, r = block
                far = r.floats()
                for qb, q in queries.items():
                    p = q.floats() @ far.T
                    p[q.ids[:, None] == r.ids[None, :]] = -np.inf
                    at = np.argpartition(-p, k - 1, axis=1)[:, :k] if p.shape[1] > k else np.broadcast_to(np.arange(p.shape[1]), p.shape)
                    new = [np.take_along_axis(p, at, 1), np.full(at.shape, rb), at]
                    if qb in best:
                        new = [np.concatenate(x, axis=1) for x in zip(best[qb], new)]
                        if new[0].shape[1] > k:
                            top = np.argpartition(-new[0], k - 1, axis=1)[:, :k]
                            new = [np.take_along_axis(x, top, 1) for x in new]
                    best[qb] = new
            elif what == "end":
                for qb, (p, rb, pos) in best.items():
                    fine = np.isfinite(p)
                    qi = np.broadcast_to(np.arange(len(p))[:, None], p.shape)[fine]
                    n = len(qi)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, s), pa.int32()), pa.array(np.full(n, qb), pa.int64()), pa.array(qi, pa.int32()), pa.array(p[fine], pa.float64()), pa.array(rb[fine], pa.int64()), pa.array(pos[fine], pa.int32())], names=["dim", "s", "qb", "qi", "p", "rb", "pos"])
                best = {}

    found = lists.dealt().mapInArrow(run, "dim int, s int, qb long, qi int, p double, rb long, pos int")
    # k entries from each group, merged in two steps so that no task gathers what all groups sent
    top = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c)), asc=False), 1, k)
    by = ["dim", "s", "qb", "qi"]
    found = found.groupBy(*by, F.pmod(F.col("rb"), F.lit(SPREAD)).alias("part")).agg(F.slice(F.sort_array(F.collect_list(F.struct("p", "rb", "pos")), asc=False), 1, k).alias("e"))
    heads = found.groupBy(*by).agg(top("e").alias("e")).select("dim", "qb", "qi", F.explode("e").alias("e")).select("dim", "qb", "qi", "e.rb", "e.pos").distinct()
    packed = heads.groupBy("dim", "rb", "qb").agg(F.collect_list(F.struct("qi", "pos")).alias("e"))
    return materialize(packed.select("dim", "rb", "qb", F.col("e.qi").alias("qi"), F.col("e.pos").alias("pos")), "topk-heads")


def _totals(lists: _Lists, entries: DataFrame, slices: int) -> DataFrame:
    """Exact totals of single entries (dim, rb, qb, qi, pos; repeated ones count once): qb, qi, query_id, rb, pos, vec_id, score. Each slice is asked for its partial scores."""
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s")
    asked = entries.select("dim", "rb", "qb", every, "qi", "pos")

    def run(batches):
        for what, _, queries, block, ask in _Lists.read(batches):
            if what != "ask":
                continue
            qb, qi, pos = ask
            (rb, r), q = block, queries[qb]
            qi, pos = np.divmod(np.unique(qi.astype(np.int64) * _PART + pos), _PART)
            a, b = q.v[qi], r.v[pos]
            if _exact(a, b):
                p = (a.astype(np.int64) * b.astype(np.int64)).sum(axis=1)
                high, low = p >> 32, p & (_PART - 1)
            else:
                p = [min(max(int(x), -_FAR), _FAR) for x in (a.astype(object) * b.astype(object)).sum(axis=1)]
                high, low = np.array([x >> 32 for x in p], np.int64), np.array([x & (_PART - 1) for x in p], np.int64)
            columns = [np.full(len(qi), qb), qi, q.ids[qi], np.full(len(qi), rb), pos, r.ids[pos], high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["qb", "qi", "query_id", "rb", "pos", "vec_id", "high", "low"])

    parts = lists.dealt(asked=asked).mapInArrow(run, "qb long, qi long, query_id long, rb long, pos long, vec_id long, high long, low long")
    whole = F.sum("high").cast("decimal(38,0)") * F.lit(_PART).cast("decimal(11,0)") + F.sum("low").cast("decimal(38,0)")
    limit = lambda x: F.lit(x).cast("decimal(38,0)")
    score = F.greatest(limit(_LOW), F.least(limit(_HIGH), F.col("x"))).cast("long")
    sums = parts.groupBy("qb", "qi", "query_id", "rb", "pos", "vec_id").agg(whole.cast("decimal(38,0)").alias("x"))
    return sums.select("qb", "qi", "query_id", "rb", "pos", "vec_id", score.alias("score"))


def _sent(lists: _Lists, cuts: DataFrame, slices: int) -> DataFrame:
    """Phase 2: dim, rb, qb, s, qi, pos (arrays): the entries whose partial score reaches the uniform threshold."""

    def run(batches):
        for what, (dim, s, _, _), queries, block, _ in _Lists.read(batches):
            if what != "block":
                continue
            rb, r = block
            for qb, q in queries.items():
                p, cut = _partials(q.v, r.v), np.array(q.cut, object)
                if p.dtype != object:  # partial >= t / slices, for whole numbers
                    cut = np.array([-(-c // slices) if c > _LOW else -np.inf for c in q.cut], np.float64)
                    hit = p >= cut[:, None]
                else:
                    hit = np.asarray(p * slices >= cut[:, None], bool) | (cut == _LOW)[:, None]
                hit &= q.ids[:, None] != r.ids[None, :]
                qi, pos = np.nonzero(hit)
                if len(qi):
                    lists_of = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (qi, pos)]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([rb], pa.int64()), pa.array([qb], pa.int64()), pa.array([s], pa.int32()), *lists_of], names=["dim", "rb", "qb", "s", "qi", "pos"])

    return materialize(lists.dealt(cuts).mapInArrow(run, "dim int, rb long, qb long, s int, qi array<int>, pos array<int>"), "topk-sent")


def phases(queries: DataFrame, rows: DataFrame, k: int = K, slices: int = SLICES) -> dict[str, DataFrame]:
    """What each phase gave: heads and sent (entries, packed by pairs of blocks), cuts (each query's cutoff), result."""
    queries = queries.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.dim", "x.v")
    q = _blocks(queries, QUERY_BLOCK, "topk-queries", slices, None)
    lists = _Lists(q, _blocks(rows, ROW_BLOCK, "topk-rows", slices, k))
    heads = _heads(lists, DEPTH * k, slices)
    # a few numbers per query: at most DEPTH * k of each slice
    scored = _totals(lists, heads, slices).groupBy("qb", "qi").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k).alias("best"))
    least = F.when(F.size("best") >= k, F.element_at("best", k)).otherwise(F.lit(_LOW))
    cuts = materialize(scored.select("qb", "qi", least.alias("cut")), "topk-cutoffs")
    places = q.filter("s = 0").select(F.col("n").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr("length(ids) div 8") - 1)).alias("qi"))
    aligned = places.join(cuts, ["qb", "qi"], "left").groupBy(F.col("qb").alias("n")).agg(F.sort_array(F.collect_list(F.struct("qi", F.coalesce("cut", F.lit(_LOW)).alias("cut")))).alias("c"))
    sent = _sent(lists, aligned.select("n", F.col("c.cut").alias("cut")), slices)
    # entries that several slices sent are asked for once
    once = sent.groupBy("dim", "rb", "qb").agg(F.flatten(F.collect_list("qi")).alias("qi"), F.flatten(F.collect_list("pos")).alias("pos"), F.count(F.lit(1)).alias("_n"))
    totals = _totals(lists, once, slices).join(cuts, ["qb", "qi"], "left").filter(F.col("score") >= F.coalesce("cut", F.lit(_LOW)))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"), "rb", "pos")
    result = totals.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return {"heads": heads, "cuts": cuts, "sent": sent, "result": result}


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, slices: int = SLICES) -> DataFrame:
    """query_id, rank, vec_id, score. queries and rows are as prepare() gives them."""
    return phases(queries, rows, k, slices)["result"]


def is_query(id_col: Column, every: int = 100) -> Column:
    return id_col % every == 0
