"""Exact k-means by exponion search.

Every vector keeps its centroid, an upper bound on its distance to it and a lower bound on its distance to every other one.
Bounds move with the centroids. A vector whose upper bound is below its lower bound, or below half the distance from its
centroid to the next one, stays where it is without a distance being computed. Any other looks only at centroids within the
ball of radius 2 * upper + gap around its own (gap: how far its centroid's nearest neighbour is), which it finds as a prefix
of that centroid's list of the others, sorted by distance. Its nearest and its second nearest centroid lie in that ball; the
radius is inclusive and bounds are rounded outwards, so ties are met and go to the smaller number.

Vectors lie in blocks with their state and with the block's sums by centroid; a round reads the blocks of the round before
and writes them anew to the shared folder, without a shuffle, and only k sums and counts reach the driver. A lost executor
costs its blocks of one round.

Vectors are whole numbers: floor(scale * x), held within +-2^27 (beyond, squared distances would pass 64 bits). Defined
results: vectors that are null, of another length, or hold nulls or non-finite numbers take no part; repeated rows are
vectors of their own; a null id takes part, and is the last to be a start; with fewer vectors than k there are as many
centroids as vectors; an empty table gives an empty result; inertia beyond 64 bits is held at the limit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

K, ROUNDS, SEED, DIMS = 8, 10, 3, 64
BLOCK = 4096
_MOST = 2**27
#: Bounds are widened by this share: far more than the rounding of a root or a sum of two numbers.
_SLACK = 1e-12
_STATE = "w int, ids array<long>, vecs binary, a binary, u binary, l binary, sums array<long>, counts array<long>, near array<long>"
_KINDS = (pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))


def prepare(vectors: DataFrame, id_col: str, vec_col: str, dims: int = DIMS, scale: int = 1024) -> DataFrame:
    """id, v (array of long): the vectors that take part, as whole numbers."""
    whole = F.transform(F.col(f"`{vec_col}`"), lambda e: F.floor(F.greatest(F.least(F.lit(float(scale)) * e.cast("double"), F.lit(float(_MOST))), F.lit(float(-_MOST)))).cast("long"))
    odd = F.exists(f"`{vec_col}`", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.filter((F.size(f"`{vec_col}`") == dims) & ~odd).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors (fewer, if there are fewer) with the smallest hash of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.withColumn("_key", key).orderBy(F.asc_nulls_last("_key"), "v").limit(k).collect()
    return np.array([r.v for r in sorted(first, key=lambda r: (r._key is None, r._key or "", r.v))], np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """What a round knows of its centroids: for each, the others in order of distance."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None = None):
        """moved: how far (at least) each centroid went since the round before."""
        self.c, self.moved, self.met = centroids, moved, 0
        gaps = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(axis=2).astype(float))
        order = np.argsort(gaps, axis=1, kind="stable")
        self.lists = [o[o != j] for j, o in enumerate(order)]
        self.reach = [gaps[j, o] * (1 - _SLACK) for j, o in enumerate(self.lists)]  # not above the true distances
        self.gap = np.array([r[0] if len(r) else np.inf for r in self.reach])

    def _distance(self, x: np.ndarray, j: int) -> np.ndarray:
        self.met += len(x)
        return _squares(x, self.c[j])

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, bounds above and below, of vectors without a state."""
        a, best, second = np.zeros(len(x), np.int32), self._distance(x, 0), np.full(len(x), np.iinfo(np.int64).max)
        for j in range(1, len(self.c)):
            d = self._distance(x, j)
            second = np.minimum(second, np.maximum(best, d))
            a[d < best] = j
            best = np.minimum(best, d)
        return a, np.sqrt(best) * (1 + _SLACK), np.sqrt(second) * (1 - _SLACK)

    def step(self, x: np.ndarray, a: np.ndarray, u: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
        """The same for vectors whose state belongs to the centroids of the round before."""
        a = a.copy()
        far = np.array([np.delete(self.moved, j).max(initial=0) for j in range(len(self.c))])
        u = (u + self.moved[a]) * (1 + _SLACK)
        l = np.maximum(l * (1 - _SLACK) - far[a], 0)  # noqa: E741
        sure = np.maximum(l, self.gap[a] / 2)
        open_ = np.flatnonzero(u >= sure)
        for j in np.unique(a[open_]).tolist():
            at = open_[a[open_] == j]
            own = self._distance(x[at], j)
            u[at] = np.sqrt(own) * (1 + _SLACK)
            still = u[at] >= sure[at]
            at, best = at[still], own[still]
            if not len(at) or not len(self.lists[j]):
                continue
            count = np.searchsorted(self.reach[j], (2 * u[at] + self.gap[j] * (1 + 4 * _SLACK)) * (1 + _SLACK), side="right")
            to, second = np.full(len(at), j, np.int32), np.full(len(at), np.iinfo(np.int64).max)
            for place in range(int(count.max())):
                o, some = int(self.lists[j][place]), np.flatnonzero(count > place)
                d = self._distance(x[at[some]], o)
                second[some] = np.minimum(second[some], np.maximum(best[some], d))
                nearer = (d < best[some]) | ((d == best[some]) & (o < to[some]))
                to[some[nearer]] = o
                best[some] = np.minimum(best[some], d)
            a[at], u[at], l[at] = to, np.sqrt(best) * (1 + _SLACK), np.sqrt(second) * (1 - _SLACK)
        return a, u, l


def _block(search: Search, ids: pa.Array, x: np.ndarray, a: np.ndarray, u: np.ndarray, l: np.ndarray, last: bool) -> pa.RecordBatch:  # noqa: E741
    k = len(search.c)
    w = 2 if np.abs(x).max(initial=0) < 2**15 else 4
    sums = [int(s) for j in range(k) for s in x[a == j].sum(axis=0)]
    near = _squares(x, search.c[a]).tolist() if last else []
    values = (w, ids.to_pylist(), x.astype(f"<i{w}").tobytes(), a.astype("<i4").tobytes(), u.astype("<f8").tobytes(), l.astype("<f8").tobytes(), [] if last else sums, np.bincount(a, minlength=k).tolist(), near)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _KINDS)], names=[f.split()[0] for f in _STATE.split(", ")])


def _round(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, last: bool, name: str) -> DataFrame:
    """Blocks with their vectors assigned to the centroids. moved None: rows are vectors (id, v), else blocks."""
    dims = centroids.shape[1]

    def run(batches):
        search = Search(centroids, moved)
        for batch in batches:
            if moved is None:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    yield _block(search, part.column(0), x, *search.all(x), last)
                continue
            for i in range(batch.num_rows):
                w, ids, vecs, a, u, l = (batch.column(c)[i] for c in range(6))  # noqa: E741
                x = np.frombuffer(vecs.as_py(), f"<i{w.as_py()}").reshape(-1, dims).astype(np.int64)
                state = (np.frombuffer(s.as_py(), t) for s, t in ((a, "<i4"), (u, "<f8"), (l, "<f8")))
                yield _block(search, ids.values, x, *search.step(x, *state), last)

    columns = ("id", "v") if moved is None else ("w", "ids", "vecs", "a", "u", "l")
    return materialize(rows.select(*columns).mapInArrow(run, _STATE), name)


def _totals(blocks: DataFrame, column: str) -> list[int]:
    """Elementwise sum of an array column over all blocks: added up within tasks first, so each task gives one row."""

    def run(batches):
        total = None
        for batch in batches:
            for row in batch.column(0):
                v = row.values.to_numpy(zero_copy_only=False).astype(object)  # no overflow, whatever the number of rows
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["v"])

    parts = blocks.select(column).mapInArrow(run, "v array<string>").select(F.posexplode("v").alias("pos", "s"))
    return [int(r.s) for r in parts.groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()]


def cluster(vectors: DataFrame, id_col: str, vec_col: str, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: each vector's centroid after `rounds` rounds of exact k-means, and sums of its distances."""
    spark, rows = vectors.sparkSession, prepare(vectors, id_col, vec_col, dims, scale)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = starts(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    blocks, moved = None, None
    for i in range(rounds + 1):
        last = i == rounds
        new = _round(rows if blocks is None else blocks, centroids, moved, last, f"centroids-{i}")
        if blocks is not None:
            discard(blocks)
        blocks = new
        if last:
            break
        sums, counts = _totals(blocks, "sums"), _totals(blocks, "counts")
        means = [[s // n for s in sums[j * dims : (j + 1) * dims]] if n else centroids[j].tolist() for j, n in enumerate(counts)]
        means = np.array(means, np.int64)
        moved = np.sqrt(((means - centroids) ** 2).sum(axis=1).astype(float)) * (1 + _SLACK)
        centroids = means

    def near(batches):
        for batch in batches:
            for a, d in zip(batch.column(0), batch.column(1)):
                got = np.zeros(len(centroids), object)
                np.add.at(got, np.frombuffer(a.as_py(), "<i4"), d.values.to_numpy(zero_copy_only=False).astype(object))
                yield pa.RecordBatch.from_arrays([pa.array([[str(x) for x in got]], pa.list_(pa.string()))], names=["v"])

    by = blocks.select("a", "near").mapInArrow(near, "v array<string>").select(F.posexplode("v").alias("pos", "s"))
    inertia = [min(int(r.s), 2**63 - 1) for r in by.groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()]
    total = min(sum(inertia), 2**63 - 1)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def spread(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, a, d = batch.column(0)[i].values, np.frombuffer(batch.column(1)[i].as_py(), "<i4"), batch.column(2)[i].values
                own = pa.array(a, pa.int32())
                yield pa.RecordBatch.from_arrays([ids, own, d, pa.array(inertia, pa.int64()).take(own), pa.array([total] * len(a), pa.int64()), pa.array(digest).take(own)], names=[f.split()[0] for f in schema.split(", ")])

    return blocks.select("ids", "a", "near").mapInArrow(spread, schema)
