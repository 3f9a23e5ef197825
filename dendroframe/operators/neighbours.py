"""Neighbour joins: balls, nearest neighbours, nearest cylinder surfaces, interpolation.

Balls are equi-joins on grid cells: one side is copied to its 27 neighbouring cells, the other stays where it is.
Nearest things are sought in rounds: what a point finds within one cell's width is final; the cells' width doubles for the
points that are left. Ties are broken by the lower id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import angle_between, cylinder_axis, cylinder_terms, distance, dot, norm, num
from ..sources.scratch import cut

XYZ = ("x", "y", "z")
#: Points of a tree up to which every point meets all of them at once: a bound on the pairs of a point.
FEW_POINTS = 1024
#: Points of a tree's cell, about, and cylinders of a block: what one group of nearest cylinders holds.
CELL_POINTS, BLOCK = 8192, 65536
#: Points, and pairs, from which on a box is not halved any more.
FEW_OF_BOX, FEW_PAIRS = 8, 4096
#: Doublings after which the points that are left (far from everything) meet their whole tree.
ROUNDS = 16


def _wide(df: DataFrame) -> DataFrame:
    """The side of a join that has a row for each of many cells: both sides are sorted. Spark takes a table to be as small after an explode as before it, and would send it to all tasks by way of the driver."""
    return df.hint("merge")


def _cells(df: DataFrame, cell: Column | float, prefix: str, spread: bool) -> DataFrame:
    c = cell if isinstance(cell, Column) else num(cell)
    for k in XYZ:
        own = F.floor(F.col(k) / c).cast("long")
        df = df.withColumn(f"{prefix}{k}", F.explode(F.array(own - 1, own, own + 1)) if spread else own)
    return df


def ball_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs within `radius` (<=) in the same tree: tree_id, point_id, other_id, d. Both sides have tree_id, point_id, x, y, z."""
    a = _cells(left.select("tree_id", "point_id", *XYZ), radius, "g", True)
    b = _cells(right.select("tree_id", F.col("point_id").alias("other_id"), *XYZ), radius, "g", False)
    b = b.select("tree_id", "other_id", "gx", "gy", "gz", *(F.col(k).alias(f"o{k}") for k in XYZ))
    d = distance([F.col(k) for k in XYZ], [F.col(f"o{k}") for k in XYZ])
    return _wide(a).join(b, ["tree_id", "gx", "gy", "gz"]).withColumn("d", d).filter(F.col("d") <= radius).select("tree_id", "point_id", "other_id", "d")


def reach_join(points: DataFrame, balls: DataFrame, least: float = 1e-6, with_points: list[str] | None = None, with_balls: list[str] | None = None) -> DataFrame:
    """Pairs of points (tree_id, point_id, x, y, z) and balls (tree_id, ball_id, x, y, z, radius) of a tree with d <= radius, each ball with a radius of its own: tree_id, ball_id, point_id, d, radius, and other columns of either side by name.

    Balls are dealt to levels by the power of two that holds their radius; a level's cells are as wide, so a ball lies in 27
    of them at most, whatever its radius. Points have one row for each level that their tree uses. Balls of no radius (below
    `least`) share the finest level; those of a negative or null one hold nothing.
    """
    more_p, more_b = with_points or [], with_balls or []
    cell, room = F.pow(num(2), F.col("_level")), F.col("radius") * (1 + 1e-9) + 1e-12
    b = balls.filter(F.col("radius") >= 0).select("tree_id", "ball_id", *(F.col(k).alias(f"_c{k}") for k in XYZ), "radius", *more_b)
    b = b.withColumn("_level", F.ceil(F.log2(F.greatest("radius", num(least)))).cast("int"))
    used = b.select("tree_id", "_level").distinct()
    for k in XYZ:
        b = b.withColumn(f"g{k}", F.explode(F.sequence(F.floor((F.col(f"_c{k}") - room) / cell), F.floor((F.col(f"_c{k}") + room) / cell))))
    held = points.select("tree_id", "point_id", *XYZ, *more_p).join(used, "tree_id").withColumns({f"g{k}": F.floor(F.col(k) / cell) for k in XYZ})
    met = held.join(_wide(b), ["tree_id", "_level", "gx", "gy", "gz"]).withColumn("d", distance([F.col(k) for k in XYZ], [F.col(f"_c{k}") for k in XYZ]))
    return met.filter(F.col("d") <= F.col("radius")).select("tree_id", "ball_id", "point_id", "d", "radius", *more_p, *more_b)


def density(points: DataFrame, radius: float) -> DataFrame:
    """Points within radius of each point, itself included.

    Counting sums over (cell of the point, cell of the neighbour) before the distance test would not be exact, so pairs are
    made; they never leave the task that counts them first (partial aggregation).
    """
    return ball_join(points, points, radius).groupBy("tree_id", "point_id").agg(F.count(F.lit(1)).alias("density"))


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("tree_id", "point_id").orderBy("d", "other_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _extents(df: DataFrame, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows and widest extent of each tree."""
    width = [F.max(F.greatest(*map(F.col, c)) if len(c) > 1 else F.col(c[0])) - F.min(F.least(*map(F.col, c)) if len(c) > 1 else F.col(c[0])) for c in columns.values()]
    return df.groupBy("tree_id").agg(F.count(F.lit(1)).alias("_n"), *(w.alias(f"_e{k}") for k, w in zip(columns, width))).withColumn("_wide", F.greatest("_ex", "_ey", "_ez", num(1e-9)))


def knn(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The k nearest points of the same tree (fewer if the tree has fewer): tree_id, point_id, rank, other_id, d.

    The first cells are sized for a tree whose points lie on a surface (trees do), or fill their box if that is smaller, and
    then narrowed by how many points a point's cell really holds. Trees of few points are one cell.
    """
    stat = _extents(right, {c: (c,) for c in XYZ})
    share = num(k) / F.col("_n")
    room = lambda c: F.greatest(F.col(f"_e{c}"), F.col("_wide") * 1e-3)
    guess = F.least(F.col("_wide") * F.sqrt(share), F.cbrt(room("x") * room("y") * room("z") * share))
    stat = cut(stat.select("tree_id", "_n", F.when(F.col("_n") <= FEW_POINTS, F.col("_wide") * 4).otherwise(F.greatest(guess, F.col("_wide") * 1e-6)).alias("_cell")))
    crowded = stat.filter(F.col("_n") > FEW_POINTS)
    if not crowded.isEmpty():
        held = _cells(right.select("tree_id", *XYZ).join(crowded.select("tree_id", "_cell"), "tree_id"), F.col("_cell"), "g", False)
        held = held.groupBy("tree_id", "gx", "gy", "gz").agg(F.count(F.lit(1)).alias("c")).groupBy("tree_id").agg((F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("_held"))
        narrow = F.when(F.col("_held") > k, F.col("_cell") * F.sqrt(num(k) / F.col("_held"))).otherwise(F.col("_cell"))
        stat = cut(stat.join(held, "tree_id", "left").select("tree_id", "_n", narrow.alias("_cell")))
    d = distance([F.col(c) for c in XYZ], [F.col(f"o{c}") for c in XYZ])
    others = right.select("tree_id", F.col("point_id").alias("other_id"), *XYZ)
    rest, out = left.select("tree_id", "point_id", *XYZ), None
    for i in range(ROUNDS + 1):
        size = stat.withColumn("_cell", F.col("_cell") * 2**i)
        if i < ROUNDS:
            a = _cells(rest.join(size, "tree_id"), F.col("_cell"), "g", True)
            b = _cells(others.join(size.select("tree_id", "_cell"), "tree_id"), F.col("_cell"), "g", False)
            b = b.select("tree_id", "other_id", "gx", "gy", "gz", *(F.col(c).alias(f"o{c}") for c in XYZ))
            pairs = _wide(a).join(b, ["tree_id", "gx", "gy", "gz"]).withColumn("d", d).filter(F.col("d") <= F.col("_cell"))
        else:
            b = others.select("tree_id", "other_id", *(F.col(c).alias(f"o{c}") for c in XYZ))
            pairs = rest.join(size, "tree_id").join(b, "tree_id").withColumn("d", d)
        near = _nearest(pairs.select("tree_id", "point_id", "other_id", "d", "_n"), k)
        full = F.count(F.lit(1)).over(Window.partitionBy("tree_id", "point_id")) >= F.least(F.lit(k), F.col("_n"))
        settled = cut(near.withColumn("_ok", full).filter("_ok").select("tree_id", "point_id", "rank", "other_id", "d"))
        out = settled if out is None else out.unionByName(settled)
        if i == ROUNDS:
            break
        rest = rest.join(settled.filter("rank = 1").select("tree_id", "point_id"), ["tree_id", "point_id"], "left_anti")
        rest = cut(rest.join(stat.select("tree_id"), "tree_id", "left_semi"))
        if rest.isEmpty():
            break
    return out


def _with_axis(cylinders: DataFrame) -> DataFrame:
    length, u = cylinder_axis([F.col(f"s{k}") for k in XYZ], [F.col(f"e{k}") for k in XYZ])
    return cylinders.withColumns({"_length": length, **{f"_u{k}": c for k, c in zip(XYZ, u)}})


_AXIS = ("sx", "sy", "sz", "_length", "_ux", "_uy", "_uz", "radius")


def _terms(perp_tol: float) -> dict[str, Column]:
    return cylinder_terms([F.col(k) for k in XYZ], [F.col(f"s{k}") for k in XYZ], F.col("_length"), [F.col(f"_u{k}") for k in XYZ], F.col("radius"), perp_tol)


def _places(p: np.ndarray, s: np.ndarray, u: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places (n, 3) and axes (m, 3): where along the axis, what that exceeds it by, and the distance from its line (n, m)."""
    v = [p[:, i, None] - s[:, i] for i in range(3)]
    t = v[0] * u[:, 0] + v[1] * u[:, 1] + v[2] * u[:, 2]
    w = [v[i] - t * u[:, i] for i in range(3)]
    return t, t - np.clip(t, 0, length), np.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])


def tree_parts(df: DataFrame) -> tuple[dict[str, Column], Column]:
    """tree_id as plain columns, which pandas can group by, and tree_id made of these."""
    kind = df.schema["tree_id"].dataType
    if not isinstance(kind, T.StructType):
        return {"_t0": F.col("tree_id")}, F.col("_t0").alias("tree_id")
    names = [f"_t{i}" for i in range(len(kind.fields))]
    return {n: F.col(f"tree_id.{f.name}") for n, f in zip(names, kind.fields)}, F.struct(*(F.col(n).alias(f.name) for n, f in zip(names, kind.fields))).alias("tree_id")


def may_be_nearest(p: np.ndarray, s: np.ndarray, u: np.ndarray, length: np.ndarray, radius: np.ndarray, perp_tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of points and of cylinders that may be the points' nearest: all whose distance is the least but for rounding.

    Boxes of points are halved; each keeps the cylinders that may be nearest to one of its points. With l the distance of the
    box's centre to the solid cylinder, a point of the box is at least l - half from its surface and at most l + half, or a
    radius if it is inside. Where the whole box lies along the axis, its distance from the mantle is known within half.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    slack = 1e-9 + 1e-12 * max(np.abs(v).max(initial=0) for v in (p, s))
    stack = [(np.arange(len(p)), np.arange(len(s)))]
    while stack:
        i, k = stack.pop()
        if len(i) <= FEW_OF_BOX or len(i) * len(k) <= FEW_PAIRS:
            _, h, rho = _places(p[i], s[k], u[k], length[k])
            over = np.maximum(rho - radius[k], 0)
            mantle, cap = np.abs(rho - radius[k]), np.sqrt(h * h + over * over)
            # where rounding may take h to the other side of perp_tol, either distance may hold
            low, high = np.where(np.abs(h) <= perp_tol + slack, mantle, cap), np.where(np.abs(h) <= perp_tol - slack, mantle, cap)
            low, high = np.minimum(low, high), np.maximum(low, high)
            a, b = np.nonzero(low <= high.min(axis=1)[:, None] + slack)
            out.append((i[a], k[b]))
            continue
        x = p[i]
        low, high = x.min(axis=0), x.max(axis=0)
        half = float(np.sqrt(((high - low) ** 2).sum())) / 2 + slack
        t, h, rho = (v[0] for v in _places(((low + high) / 2)[None], s[k], u[k], length[k]))
        over = np.maximum(rho - radius[k], 0)
        solid = np.sqrt(h * h + over * over)
        along = (t >= half) & (t <= length[k] - half)
        mantle = np.abs(rho - radius[k])
        least = np.where(along, mantle, solid) - half - perp_tol
        most = np.where(along, mantle + half, np.maximum(solid + half + perp_tol, radius[k]))
        k = k[least <= most.min() + slack]
        by = x[:, int((high - low).argmax())]
        order = np.argpartition(by, len(i) // 2)
        stack += [(i[order[: len(i) // 2]], k), (i[order[len(i) // 2 :]], k)]
    return tuple(np.concatenate(o) for o in zip(*out))


def met_cylinders(points: DataFrame, cylinders: DataFrame, perp_tol: float = 1e-3) -> DataFrame:
    """Points with each cylinder of their tree that may be their nearest (tree_id, point_id, x, y, z, id and the cylinder's axis). Points and cylinders without finite numbers are left out.

    Of cylinders alike but for their id only the lowest is looked at. A tree's points are dealt to cells of some CELL_POINTS
    and its cylinders to blocks of some BLOCK; each cell meets each block in a group of its own (may_be_nearest), whose memory
    depends on these two numbers. Only what may be nearest within a block leaves the group.
    """
    parts, whole = tree_parts(points)
    keys = [*parts, "_i", "_j", "_k", "_block"]
    finite = lambda names: " and ".join(f"abs({c}) < double('infinity')" for c in names)
    p = points.select("tree_id", "point_id", *(F.col(c).cast("double").alias(c) for c in XYZ)).filter(finite(XYZ))
    alike = ["tree_id", "sx", "sy", "sz", "ex", "ey", "ez", "radius"]
    c = _with_axis(cylinders.groupBy(*alike).agg(F.min("id").alias("id"))).select("tree_id", "id", *_AXIS).filter(finite(_AXIS))
    stat = p.groupBy("tree_id").agg(F.count(F.lit(1)).alias("_n"), *(f(k).alias(f"_{n}{k}") for k in XYZ for n, f in (("lo", F.min), ("hi", F.max))))
    blocks = c.groupBy("tree_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    along = F.ceil(F.cbrt(F.col("_n") / CELL_POINTS)).cast("int")
    stat = cut(stat.join(blocks, "tree_id").withColumn("_cells", along).drop("_n"))
    at = lambda k: F.least(F.col("_cells") - 1, F.floor((F.col(k) - F.col(f"_lo{k}")) / F.greatest(F.col(f"_hi{k}") - F.col(f"_lo{k}"), num(1e-12)) * F.col("_cells"))).cast("int")
    held = p.join(stat, "tree_id").withColumns({n: at(k) for n, k in zip(("_i", "_j", "_k"), XYZ)}).select("tree_id", "_i", "_j", "_k", "point_id", *XYZ, "_blocks")
    cells = cut(held.select("tree_id", "_i", "_j", "_k", "_blocks").distinct()).drop("_blocks")
    left = held.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns(parts).drop("tree_id", "_blocks")
    right = c.join(stat.select("tree_id", "_blocks"), "tree_id").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    right = right.join(cells, "tree_id").withColumns(parts).drop("tree_id", "_blocks")
    own, names = [*parts, "point_id", *XYZ], [*parts, "point_id", *XYZ, "id", *_AXIS]
    kinds = {**{f.name: f for f in left.schema}, **{f.name: f for f in right.schema}}
    schema = T.StructType([T.StructField(n, kinds[n].dataType) for n in names])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        x, s = a[list(XYZ)].to_numpy(float), b[["sx", "sy", "sz"]].to_numpy(float)
        i, k = may_be_nearest(x, s, b[["_ux", "_uy", "_uz"]].to_numpy(float), b["_length"].to_numpy(float), b["radius"].to_numpy(float), perp_tol)
        return pd.concat([a.iloc[i][own].reset_index(drop=True), b.iloc[k][["id", *_AXIS]].reset_index(drop=True)], axis=1)[names]

    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
    return out.select(whole, *names[len(parts) :])


def nearest_cylinder(points: DataFrame, cylinders: DataFrame, perp_tol: float = 1e-3) -> DataFrame:
    """For every point its tree's nearest cylinder surface: cylinder_id, distance, and the offset ox, oy, oz to the mantle. Ties: lower id.

    No point meets its whole tree (met_cylinders); the minimum is kept per point by partial aggregation. Points of trees
    without cylinders are left out.
    """
    t = _terms(perp_tol)
    best = F.min(F.struct(t["distance"].alias("distance"), F.col("id").alias("cylinder_id"), *(t[k].alias(k) for k in ("ox", "oy", "oz")))).alias("m")
    out = met_cylinders(points, cylinders, perp_tol).groupBy("tree_id", "point_id").agg(best)
    return out.select("tree_id", "point_id", "m.cylinder_id", "m.distance", "m.ox", "m.oy", "m.oz")


def label_points(points: DataFrame, cylinders: DataFrame, perp_tol: float = 1e-3) -> DataFrame:
    """Points with cylinder_id and the offset dx, dy, dz to the nearest cylinder's mantle."""
    n = nearest_cylinder(points, cylinders, perp_tol).select("tree_id", "point_id", "cylinder_id", F.col("ox").alias("dx"), F.col("oy").alias("dy"), F.col("oz").alias("dz"))
    return points.drop("dx", "dy", "dz", "cylinder_id").join(n, ["tree_id", "point_id"])


def near_cylinders(points: DataFrame, cylinders: DataFrame, eps: float, perp_tol: float = 1e-3) -> DataFrame:
    """Points closer than eps to any cylinder of their tree: those whose nearest one is (met_cylinders)."""
    near = met_cylinders(points, cylinders, perp_tol).groupBy("tree_id", "point_id").agg(F.min(_terms(perp_tol)["distance"]).alias("d")).filter(F.col("d") < eps)
    return points.join(near, ["tree_id", "point_id"], "left_semi")


def interpolate(targets: DataFrame, sources: DataFrame, value: str, k: int = 3) -> DataFrame:
    """Weighted mean over the k nearest sources, weights 1 / max(d^2, 1e-6); one source: its value."""
    near = knn(targets, sources, k).join(sources.select("tree_id", F.col("point_id").alias("other_id"), F.col(value).alias("_v")), ["tree_id", "other_id"])
    w = 1 / F.greatest(F.col("d") * F.col("d"), num(1e-6))
    return near.groupBy("tree_id", "point_id").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias(value))


def first_inside(centres: DataFrame, points: DataFrame, radius: float, most: int) -> DataFrame:
    """The first `most` points by id within radius (<=) of each centre, of its tree: tree_id, point_id, other_id.

    The points of the 27 cells around a cell meet its centres in groups of some CELL_POINTS centres and BLOCK points, by
    order of id, until each centre has enough; pairs never leave a group, and no more than `most` rows of a centre do.
    """
    parts, whole = tree_parts(centres)
    cell = ["tree_id", "gx", "gy", "gz"]
    keys = [*parts, *cell[1:], "_deal", "_block"]
    a = _cells(centres.select("tree_id", "point_id", *(F.col(k).cast("double").alias(k) for k in XYZ)).dropna(subset=list(XYZ)), radius, "g", False)
    b = _cells(points.select("tree_id", F.col("point_id").alias("other_id"), *(F.col(k).cast("double").alias(k) for k in XYZ)).dropna(subset=list(XYZ)), radius, "g", True)
    size = lambda df, most_, name: df.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / most_).cast("int").alias(name))
    stat = cut(size(a, CELL_POINTS, "_deals").join(size(b, BLOCK, "_blocks"), cell))
    own = lambda name, id_: F.pmod(F.xxhash64(id_), F.col(f"{name}s")).cast("int").alias(name)
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1)).alias(name)
    spread = lambda df, id_, *more: _wide(df).join(stat, cell).select(*(c.alias(n) for n, c in parts.items()), *cell[1:], id_, *XYZ, *more)
    left = spread(a, "point_id", own("_deal", "point_id"), each("_block"))
    right = spread(b, "other_id", each("_deal"), own("_block", "other_id"))
    names = [*parts, "point_id", "other_id"]
    kinds = {f.name: f.dataType for df in (left, right) for f in df.schema}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])

    def run(c: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(o):
            return pd.DataFrame(columns=names)
        o = o.sort_values("other_id", kind="stable")
        x, y, ids = c[list(XYZ)].to_numpy(float), o[list(XYZ)].to_numpy(float), o["other_id"].to_numpy()
        open_, lack, rows, found, at, step = np.arange(len(x)), np.full(len(x), most), [], [], 0, 64
        while len(open_) and at < len(y):
            part = y[at : at + step]
            for k in range(0, len(open_), max(1, FEW_PAIRS * 64 // len(part))):
                i = open_[k : k + max(1, FEW_PAIRS * 64 // len(part))]
                d = [x[i, None, w] - part[:, w] for w in range(3)]
                met = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) <= radius
                met &= np.cumsum(met, axis=1, dtype=np.int32) <= lack[i, None]
                p, q = np.nonzero(met)
                rows.append(i[p])
                found.append(at + q)
                lack[i] -= met.sum(axis=1)
            at, step, open_ = at + step, min(2 * step, FEW_PAIRS), open_[lack[open_] > 0]
        rows, found = np.concatenate(rows), np.concatenate(found)
        out = c[names[:-1]].iloc[rows].reset_index(drop=True)
        out["other_id"] = ids[found]
        return out[names]

    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
    return out.select(whole, "point_id", "other_id")


def ball_query(centres: DataFrame, points: DataFrame, radius: float, most: int) -> DataFrame:
    """slot 0..most-1 for each centre: the first `most` points by id within the radius, filled up with the first; the nearest point where there is none."""
    inside = first_inside(centres, points, radius, most)
    w = Window.partitionBy("tree_id", "point_id").orderBy("other_id")
    inside = cut(inside.withColumn("slot", F.row_number().over(w) - 1).filter(F.col("slot") < most))
    n = inside.groupBy("tree_id", "point_id").agg(F.count(F.lit(1)).alias("n"), F.min("other_id").alias("first_id"))
    alone = centres.join(n, ["tree_id", "point_id"], "left_anti")
    nearest = knn(alone, points, 1).select("tree_id", "point_id", F.lit(0).cast("long").alias("n"), F.col("other_id").alias("first_id"))
    fill = n.unionByName(nearest).filter(F.col("n") < most).withColumn("slot", F.explode(F.sequence(F.col("n"), F.lit(most - 1).cast("long")))).select("tree_id", "point_id", F.col("slot").cast("int").alias("slot"), F.col("first_id").alias("other_id"))
    return inside.select("tree_id", "point_id", "slot", "other_id").unionByName(fill)


def square_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """Squared distances of all pairs inside a tree."""
    o = b.select("tree_id", F.col("point_id").alias("other_id"), *(F.col(k).alias(f"o{k}") for k in XYZ))
    d = sum(((F.col(k) - F.col(f"o{k}")) * (F.col(k) - F.col(f"o{k}")) for k in XYZ), num(0))
    return a.join(o, "tree_id").select("tree_id", "point_id", "other_id", d.alias("d2"))


def merge_candidates(ends: DataFrame, heads: DataFrame, max_distance: float, max_angle: float, effective: bool = False) -> DataFrame:
    """For each branch end (tree_id, point_id, x, y, z, radius, ux, uy, uz) the nearest head (same columns) of the tree with d < max_distance and an angle below max_angle. effective: distance between surfaces, not below 0."""
    own = [f"_o{k}" for k in ("radius", "ux", "uy", "uz")]
    head = heads.select("tree_id", "point_id", *XYZ, *(F.col(k).alias(f"_o{k}") for k in ("radius", "ux", "uy", "uz")))
    reach = num(max_distance)
    if effective:  # surfaces are that near only if centres are within the distance plus both radii
        wide = heads.groupBy("tree_id").agg(F.max("radius").alias("_wide"))
        ends, reach = ends.join(wide, "tree_id"), reach + F.col("radius") + F.col("_wide")
    balls = ends.select("tree_id", F.col("point_id").alias("ball_id"), *XYZ, F.col("radius").alias("_r"), "ux", "uy", "uz", reach.alias("radius"))
    met = reach_join(head, balls, with_points=own, with_balls=["_r", "ux", "uy", "uz"]).withColumnsRenamed({"point_id": "other_id", "ball_id": "point_id"}).filter("point_id <> other_id")
    d = F.greatest(num(0), F.col("d") - (F.col("_r") + F.col("_oradius"))) if effective else F.col("d")
    a = angle_between([F.col(k) for k in ("ux", "uy", "uz")], [F.col(f"_o{k}") for k in ("ux", "uy", "uz")])
    pairs = met.withColumns({"d": d, "angle": a}).filter((F.col("d") < max_distance) & (F.col("angle") < max_angle))
    return pairs.groupBy("tree_id", "point_id").agg(F.min(F.struct("d", "other_id", "angle")).alias("m")).select("tree_id", "point_id", "m.other_id", "m.d", "m.angle")


def paired(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Point-wise join of two versions of clouds; trees whose point counts differ are left out."""
    na, nb = (x.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")) for x in (a, b))
    same = na.join(nb, ["tree_id", "n"]).select("tree_id")
    left = a.select("tree_id", "point_id", F.col(value).alias(f"{value}_a")).join(same, "tree_id", "left_semi")
    return left.join(b.select("tree_id", "point_id", F.col(value).alias(f"{value}_b")), ["tree_id", "point_id"])


def lookup(points: DataFrame, cylinders: DataFrame, value: str = "radius") -> DataFrame:
    """A cylinder's value by id; null where the id is unknown."""
    return points.join(cylinders.select("tree_id", F.col("id").alias("cylinder_id"), value), ["tree_id", "cylinder_id"], "left")


def match_by_prefix(clouds: DataFrame, models: DataFrame) -> DataFrame:
    """For each cloud name the model whose name begins with it and adds least (ties by name). No separator is asked for, so a longer number may match too.

    Names are joined by the prefixes of the models (one row per length that occurs among clouds), not by comparing all pairs.
    """
    lengths = clouds.select(F.length("cloud").alias("n")).distinct()
    keyed = models.join(lengths, F.length("model") >= F.col("n")).select("model", F.expr("substring(model, 1, n)").alias("cloud"))
    return clouds.join(keyed, "cloud").groupBy("cloud").agg(F.min(F.struct((F.length("model") - F.length("cloud")).alias("extra"), F.col("model"))).alias("m")).select("cloud", "m.model", "m.extra")


def match_by_parts(clouds: DataFrame, models: DataFrame, parts: int = 3) -> DataFrame:
    """First model (by name) that shares the cloud's first `parts` parts between underscores."""
    m = models.groupBy(F.substring_index("model", "_", parts).alias("key")).agg(F.min("model").alias("model"))
    return clouds.withColumn("key", F.substring_index("cloud", "_", parts)).join(m, "key").select("cloud", "model")


def match_by_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """Trees of equal point counts, the lowest tree of b for each of a. Ambiguous by nature; prefer the tree's id."""
    na, nb = (x.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")) for x in (a, b))
    return na.join(nb.groupBy("n").agg(F.min("tree_id").alias("other_tree")), "n").select("tree_id", "other_tree", "n")
