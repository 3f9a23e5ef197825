"""Grids: rasters, voxels, space-filling curves, serialised pooling and patches. Cell keys are arithmetic; no cell ever tests points."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import morton, num
from ..sources.scratch import cut
from .points import extent, with_tree


def cell_of(v: Column, low: Column, size: float) -> Column:
    return F.floor((v - low) / num(size)).cast("long")


def raster_members(points: DataFrame, size: float, stride: float) -> DataFrame:
    """One row per point and raster cell it lies in: columns of points, and ix, iy, iz.

    Cells begin at the tree's minimum plus multiples of stride below its extent, half-open, and overlap where stride < size.
    A point at the very maximum lies in no cell if a cell would have to begin there.
    """
    e = extent(points)
    out = with_tree(points, e)
    for c in "xyz":
        v, span = F.col(c) - F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")
        low = F.greatest(F.floor((v - num(size)) / num(stride)) + 1, F.lit(0))
        high = F.least(F.floor(v / num(stride)), F.ceil(span / num(stride)) - 1)
        if stride >= size:  # at most one cell
            k = F.floor(v / num(stride))
            out = out.withColumn(f"i{c}", k).filter((v < F.col(f"i{c}") * num(stride) + num(size)) & (F.col(f"i{c}") * num(stride) < span))
        else:
            out = out.filter(low <= high).withColumn(f"i{c}", F.explode(F.sequence(low, high)))
    return out.drop(*(f"{m}_{c}" for m in ("min", "max") for c in "xyz"))


def raster_table(members: DataFrame, points: DataFrame, size: float, stride: float) -> DataFrame:
    """Cells that hold points: raster_id (from 0, in order of ix, iy, iz within the tree), n, and bounds. Ids are dense over cells, not points."""
    cells = members.groupBy("tree_id", "ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("raster_id", (F.row_number().over(Window.partitionBy("tree_id").orderBy("ix", "iy", "iz")) - 1).cast("long"))
    low = points.groupBy("tree_id").agg(*(F.min(c).alias(f"_{c}") for c in "xyz"))
    out = cells.join(low, "tree_id")
    for c in "xyz":
        out = out.withColumn(f"min_{c}", F.col(f"_{c}") + F.col(f"i{c}") * num(stride)).withColumn(f"max_{c}", F.col(f"min_{c}") + num(size))
    return out.drop("_x", "_y", "_z")


def reaggregate(predictions: DataFrame, points: DataFrame, value: str) -> DataFrame:
    """Mean of the overlapping cells' predictions for each point; 0 for points that no cell saw."""
    mean = predictions.groupBy("tree_id", "point_id").agg(F.avg(value).alias("_m"))
    return points.select("tree_id", "point_id").join(mean, ["tree_id", "point_id"], "left").select("tree_id", "point_id", F.coalesce("_m", num(0)).alias(value))


def extract_rasters(points: DataFrame, rasters: DataFrame) -> DataFrame:
    """The points of each raster of a metadata table (tree_id, raster_id, min_x .. max_z; as read_raster_metadata gives it): columns of points and raster_id. Boxes are half-open and may overlap.

    An equi-join: a tree's grid has cells as wide as its widest box, so a box lies in eight cells at most; points keep the one cell they are in.
    """
    size = rasters.groupBy("tree_id").agg(*(F.max(F.col(f"max_{c}") - F.col(f"min_{c}")).alias(f"_s{c}") for c in "xyz")).select("tree_id", *(F.greatest(f"_s{c}", num(1e-9)).alias(f"_s{c}") for c in "xyz"))
    boxes = rasters.select("tree_id", "raster_id", *(F.col(f"{e}_{c}").alias(f"_{e}_{c}") for c in "xyz" for e in ("min", "max"))).join(size, "tree_id")
    held = with_tree(points, size)
    for c in "xyz":
        low, high = F.floor(F.col(f"_min_{c}") / F.col(f"_s{c}")), F.floor(F.col(f"_max_{c}") / F.col(f"_s{c}"))
        boxes = boxes.withColumn(f"_g{c}", F.explode(F.sequence(low, high)))
        held = held.withColumn(f"_g{c}", F.floor(F.col(c) / F.col(f"_s{c}")))
    both = held.drop(*(f"_s{c}" for c in "xyz")).join(boxes.drop(*(f"_s{c}" for c in "xyz")), ["tree_id", "_gx", "_gy", "_gz"])
    for c in "xyz":
        both = both.filter((F.col(c) >= F.col(f"_min_{c}")) & (F.col(c) < F.col(f"_max_{c}")))
    return both.select(*(F.col(f"`{c}`") for c in points.columns), "raster_id")


def rasters_per_tree(cells: DataFrame) -> DataFrame:
    """Rasters of each tree, and the mean over trees beside them."""
    n = cells.groupBy("tree_id").agg(F.countDistinct("raster_id").alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_trees"), F.sum("n").alias("n_rasters"), F.avg("n").alias("mean_rasters"))


def first_rasters(cells: DataFrame, most: int) -> DataFrame:
    """The first `most` rasters of each tree, by id (rasters are numbered from 0 without gaps)."""
    return cells.filter(F.col("raster_id") < most)


def voxel_key(points: DataFrame, size: float) -> DataFrame:
    low = points.groupBy("tree_id").agg(*(F.min(c).alias(f"_{c}") for c in "xyz"))
    return with_tree(points, low).withColumns({f"v{c}": cell_of(F.col(c), F.col(f"_{c}"), size) for c in "xyz"}).drop("_x", "_y", "_z")


def voxelise(points: DataFrame, size: float, features: list[str], most: int | None = None) -> DataFrame:
    """Means of features, then coordinates, per voxel; with `most`, of its first points by id only (the feature of the reader's cap)."""
    keyed = voxel_key(points, size)
    key = ["tree_id", "vx", "vy", "vz"]
    if most is not None:
        keyed = keyed.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("point_id"))).filter(F.col("_k") <= most).drop("_k")
    return keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in [*features, "x", "y", "z"]))


def unpool(points: DataFrame, voxels: DataFrame, size: float) -> DataFrame:
    """Each point with its voxel's row."""
    return voxel_key(points, size).join(voxels, ["tree_id", "vx", "vy", "vz"])


#: Orders along space-filling curves; '-trans' exchanges x and y (fixed names).
ORDERS = ("z", "z-trans", "hilbert", "hilbert-trans")


def curve_code(x: Column, y: Column, z: Column, order: str = "z", depth: int = 16, batch: Column | None = None) -> Column:
    """Code of cell numbers along a curve of ORDERS; with batch its number stands in the bits above."""
    if order not in ORDERS:
        raise ValueError(f"order is one of {ORDERS}")
    a, b = (y, x) if order.endswith("-trans") else (x, y)
    code = morton(a, b, z, depth) if order.startswith("z") else hilbert(a, b, z, depth)
    return code if batch is None else F.shiftleft(batch.cast("long"), 3 * depth).bitwiseOR(code)


def _ranked(keyed: DataFrame, code: str, rank: str, coded: DataFrame | None = None) -> DataFrame:
    """Adds rank: the place by (code, point_id) within the tree, as a prefix sum over ranges of codes: a range's rows are sorted in one task, a tree's never. coded: the same rows from a shorter plan, for the counts of the ranges."""
    part = F.shiftright(code, 9).alias("_part")
    keyed = keyed.withColumn("_part", part)
    parts = (keyed if coded is None else coded.select("tree_id", part)).groupBy("tree_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("tree_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("tree_id", "_part").orderBy(code, "point_id"))
    return keyed.withColumn("_own", own).join(parts, ["tree_id", "_part"]).withColumn(rank, (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_part", "_own", "_before")


def serialise(points: DataFrame, size: float, depth: int = 16, swap: bool = False, order: str | None = None) -> DataFrame:
    """Adds the cell numbers, code (along the curve `order`; by default Z-order, with swap x and y exchanged), and rank: the place in code order within the tree (ties by id). The rank of a point is the inverse permutation; order_of gives the permutation itself."""
    keyed = voxel_key(points, size)
    order = order or ("z-trans" if swap else "z")
    return _ranked(keyed.withColumn("code", curve_code(F.col("vx"), F.col("vy"), F.col("vz"), order, depth)), "code", "rank")


def serialise_all(points: DataFrame, size: float, depth: int = 16, orders: tuple[str, ...] = ORDERS) -> DataFrame:
    """The cell numbers with code_0, rank_0, code_1, ... for each of the orders. All codes are written once; ranks are taken from there, so the source is read as often for four orders as for one."""
    keyed = voxel_key(points, size)
    out = coded = cut(keyed.withColumns({f"code_{i}": curve_code(F.col("vx"), F.col("vy"), F.col("vz"), order, depth) for i, order in enumerate(orders)}))
    for i in range(len(orders)):
        out = _ranked(out, f"code_{i}", f"rank_{i}", coded)
    return out


def order_of(coded: DataFrame, rank: str = "rank") -> DataFrame:
    """The permutation: which point stands at each place of the order. Columns tree_id, place, point_id."""
    return coded.select("tree_id", F.col(rank).alias("place"), "point_id")


def serialised_pool(coded: DataFrame, levels: int, value: str) -> DataFrame:
    """Groups of equal code >> 3*levels: count, max, mean, min and sum of value, mean coordinates, and the head (lowest rank)."""
    g = coded.withColumn("pool", F.shiftright("code", 3 * levels))
    return g.groupBy("tree_id", "pool").agg(
        F.count(F.lit(1)).alias("n"), F.max(value).alias("max_v"), F.avg(value).alias("mean_v"), F.min(value).alias("min_v"), F.sum(value).alias("sum_v"),
        *(F.avg(c).alias(f"mean_{c}") for c in "xyz"), F.min_by("point_id", "rank").alias("head"),
    )


def patches(coded: DataFrame, size: int) -> DataFrame:
    """Chunks of `size` along the order. The last chunk of a tree that has more than one is filled up with the points just before it (borrowed = true); a single short chunk stays short."""
    n = coded.groupBy("tree_id").agg(F.count(F.lit(1)).alias("_n"))
    x = coded.join(n, "tree_id").withColumn("patch", F.expr(f"rank div {size}"))
    last, short = F.expr(f"(_n - 1) div {size}"), F.expr(f"({size} - _n % {size}) % {size}")
    own = x.withColumn("borrowed", F.lit(False))
    lent = x.filter((last > 0) & (short > 0) & (F.col("rank") >= last * size - short) & (F.col("rank") < last * size)).withColumns({"patch": last, "borrowed": F.lit(True)})
    return own.unionByName(lent).drop("_n")


def relative_positions(patched: DataFrame) -> DataFrame:
    """Cell differences of all pairs inside a patch (size x size rows of each patch)."""
    a = patched.select("tree_id", "patch", F.col("point_id").alias("a"), *(F.col(f"v{c}").alias(f"a{c}") for c in "xyz"))
    b = patched.select("tree_id", "patch", F.col("point_id").alias("b"), *(F.col(f"v{c}").alias(f"b{c}") for c in "xyz"))
    return a.join(b, ["tree_id", "patch"]).select("tree_id", "patch", "a", "b", *((F.col(f"a{c}") - F.col(f"b{c}")).alias(f"r{c}") for c in "xyz"))


def batch_offsets(points: DataFrame) -> DataFrame:
    """Points of each tree and the running total over trees in order of id (one row per tree)."""
    n = points.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("offset", F.sum("n").over(Window.orderBy("tree_id").rowsBetween(Window.unboundedPreceding, 0)))


def mini_batches(cells: DataFrame, size: int) -> DataFrame:
    """Cells of each tree in batches of `size`, one smaller if the last would hold a single cell."""
    n = F.count(F.lit(1)).over(Window.partitionBy("tree_id"))
    b = F.when((n % size == 1) & (n > 1) & F.lit(size > 2), size - 1).otherwise(size)
    return cells.withColumn("_b", b).withColumn("batch", F.expr("raster_id div _b")).drop("_b")


def _hilbert(x: int, y: int, z: int, bits: int) -> int:
    """Skilling's transform of one cell's numbers to its Hilbert index: the rule that the state table is made from."""
    v = [x, y, z]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(3):
            if v[i] & q:
                v[0] ^= q - 1
            else:
                t = (v[0] ^ v[i]) & (q - 1)
                v[0] ^= t
                v[i] ^= t
        q >>= 1
    v[1] ^= v[0]
    v[2] ^= v[1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if v[2] & q:
            t ^= q - 1
        q >>= 1
    return sum(((c ^ t) >> b & 1) << (3 * b + 2 - i) for i, c in enumerate(v) for b in range(bits))


@functools.cache
def _hilbert_states() -> tuple[list[int], list[int]]:
    """(digit, next state) of each state and octant (at 8 * state + octant). Within an octant the curve is the whole curve seen in a turned frame; a state is such a frame: which axis stands for which, and which run backwards. Frames are found by comparing the curve two levels down with every turned curve of one level less."""
    turns = [(order, flips) for order in itertools.permutations(range(3)) for flips in range(8)]
    seen = lambda turn, c, top: tuple((c[turn[0][i]] ^ (top if turn[1] >> i & 1 else 0)) for i in range(3))
    cells = list(itertools.product(range(4), repeat=3))
    small = {c: _hilbert(*c, 2) for c in cells}
    inner = []
    for o in range(8):
        high = (o >> 2, o >> 1 & 1, o & 1)
        low = {c: _hilbert(*(4 * h + k for h, k in zip(high, c)), 3) & 63 for c in cells}
        inner.append(next(t for t in turns if all(low[c] == small[seen(t, c, 3)] for c in cells)))
    combined = lambda a, b: (tuple(a[0][b[0][i]] for i in range(3)), sum(((b[1] >> i & 1) ^ (a[1] >> b[0][i] & 1)) << i for i in range(3)))
    states, digit, follow, at = [((0, 1, 2), 0)], [], [], 0
    while at < len(states):
        for o in range(8):
            c = seen(states[at], (o >> 2, o >> 1 & 1, o & 1), 1)
            digit.append(_hilbert(*c, 1))
            turn = combined(states[at], inner[c[0] << 2 | c[1] << 1 | c[2]])
            if turn not in states:
                states.append(turn)
            follow.append(states.index(turn))
        at += 1
    return digit, follow


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _bit(v: Column, i: Column) -> Column:
    return F.call_function("shiftright", v, i).bitwiseAND(F.lit(1).cast("long"))


def _walk(start: dict[str, Column], bits: int, step) -> Column:
    """The struct of long columns that `step` (of the struct and the bit's number, highest first) leads to; the columns are taken once."""
    held = F.struct(*(c.cast("long").alias(k) for k, c in start.items()))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), held, lambda a, i: F.struct(*(c.alias(k) for k, c in step(a, i).items())))


def hilbert(x: Column, y: Column, z: Column, bits: int = 16) -> Column:
    """Hilbert index of cell numbers (up to 63 bits in all): a walk down the bits by the state table, inside the JVM."""
    digit, follow = _hilbert_states()

    def step(a: Column, i: Column) -> dict[str, Column]:
        at = (a["s"] * 8 + _bit(a["x"], i) * 4 + _bit(a["y"], i) * 2 + _bit(a["z"], i) + 1).cast("int")
        return {"x": a["x"], "y": a["y"], "z": a["z"], "s": F.element_at(_longs(follow), at), "code": a["code"] * 8 + F.element_at(_longs(digit), at)}

    return _walk({"x": x, "y": y, "z": z, "s": F.lit(0), "code": F.lit(0)}, bits, step)["code"]


def hilbert_decode(code: Column, bits: int = 16) -> Column:
    """A struct of x, y, z."""
    digit, follow = _hilbert_states()
    place = {(k // 8, d): k % 8 for k, d in enumerate(digit)}
    octant = [place[s, d] for s in range(len(digit) // 8) for d in range(8)]
    after = [follow[8 * s + place[s, d]] for s in range(len(digit) // 8) for d in range(8)]

    def step(a: Column, i: Column) -> dict[str, Column]:
        at = (a["s"] * 8 + F.call_function("shiftright", a["code"], i * 3).bitwiseAND(F.lit(7).cast("long")) + 1).cast("int")
        o = F.element_at(_longs(octant), at)
        return {"code": a["code"], "s": F.element_at(_longs(after), at), "x": a["x"] * 2 + F.shiftright(o, 2), "y": a["y"] * 2 + F.shiftright(o, 1).bitwiseAND(F.lit(1).cast("long")), "z": a["z"] * 2 + o.bitwiseAND(F.lit(1).cast("long"))}

    out = _walk({"code": code, "s": F.lit(0), "x": F.lit(0), "y": F.lit(0), "z": F.lit(0)}, bits, step)
    return F.struct(out["x"].alias("x"), out["y"].alias("y"), out["z"].alias("z"))
