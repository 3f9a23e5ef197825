"""Steps of a tree model's growth as relations: seed spheres, candidates around spheres, the spheres that are accepted, and the points that are used up.

Each step takes all trees and all spheres at once. The sequential fit (qsm.Fit) goes through the same steps one sphere at a
time; here spheres of a generation are one table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import cross, distance, norm, num
from ..sources.scratch import cut
from .cluster import cluster_directions, dbscan_cores
from .neighbours import XYZ, near_cylinders, reach_join
from .stats import principal_axes, subsampled_circles

Rank = Callable[[], Column]
#: Spheres of a group, about, and the groups at most that a cell's spheres are dealt to (a point goes to 27 times as many at most, so copies grow with the points).
DEAL, DEALS = 512, 8
#: Points around a cell up to which they are held by each of its groups (some 400 bytes a point); beyond, spheres and points meet by joins.
AROUND = 1 << 19


def _hashed() -> Column:
    return F.xxhash64("fit", "point_id")


def rings(points: DataFrame, by: list[str], fits: int = 10, share: float = 0.8, rank: Rank = _hashed) -> DataFrame:
    """by, n, x, y, z, r: for each group of points the centre and radius of its ring, the mean of circle fits on hashed subsets in the group's plane of largest variance. Groups that fix no plane or circle are left out.

    A circle does not depend on the axes chosen in its plane, so any two across the plane's normal do.
    """
    mean = points.groupBy(*by).agg(*(F.avg(c).alias(f"_m{c}") for c in XYZ))
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    flat = F.when(F.abs("nx") <= 0.9, F.array(num(0), F.col("nz"), -F.col("ny"))).otherwise(F.array(-F.col("nz"), num(0), F.col("nx")))
    plane = cut(principal_axes(points, by)).filter("nx is not null").withColumn("_e", flat)  # one row a group; written, as its long expressions would be repeated in all that follows
    size = F.sqrt(sum((F.col("_e")[i] * F.col("_e")[i] for i in range(3)), num(0)))
    plane = plane.select(*by, *n, *((F.col("_e")[i] / size).alias(f"_a{c}") for i, c in enumerate(XYZ)))
    plane = cut(plane.select(*by, *(f"_a{c}" for c in XYZ), *(b.alias(f"_b{c}") for b, c in zip(cross(n, [F.col(f"_a{c}") for c in XYZ]), XYZ))).join(mean, by))
    along = lambda k: sum(((F.col(c) - F.col(f"_m{c}")) * F.col(f"_{k}{c}") for c in XYZ), num(0))
    flat_points = points.join(plane, by).select(*by, "point_id", along("a").alias("u"), along("b").alias("v"))
    circles = subsampled_circles(flat_points, by, rank(), fits, share, "u", "v").filter("r is not null")
    return circles.join(plane, by).select(*by, "n", *((F.col(f"_m{c}") + F.col("cx") * F.col(f"_a{c}") + F.col("cy") * F.col(f"_b{c}")).alias(c) for c in XYZ), "r")


def ring(x: np.ndarray, place: np.ndarray, share: float = 0.8) -> tuple[np.ndarray, float] | None:
    """Centre and radius of one group's ring, as rings gives it; place: each point's place in the order of each fit (fits x points)."""
    n = len(x)
    if n < 3:
        return None
    mean = x.mean(axis=0)
    v = x - mean
    c = v.T @ v / (n - 1)
    q = np.trace(c) / 3
    b = c - q * np.eye(3)
    p = np.sqrt((b * b).sum() / 6)
    half = np.linalg.det(b) / p**3 / 2 if p > 0 else 0.0
    w = c - (q + 2 * p * np.cos(np.arccos(min(1.0, max(-1.0, half))) / 3 + 2 * np.pi / 3)) * np.eye(3)  # less the least eigenvalue
    ways = np.cross(w[[0, 0, 1]], w[[1, 2, 2]])
    size = np.sqrt((ways * ways).sum(axis=1))
    if not size.max() > 0:
        return None
    normal = ways[size.argmax()] / size.max()
    flat = np.array([0.0, normal[2], -normal[1]]) if abs(normal[0]) <= 0.9 else np.array([-normal[2], 0.0, normal[0]])
    flat /= np.sqrt((flat * flat).sum())
    axes = np.stack([flat, np.cross(normal, flat)])
    uv = v @ axes.T

    def circles(part: np.ndarray) -> tuple[np.ndarray, ...]:
        """cx, cy and r of each row's points, NaN where there is none: stats.fit_circles."""
        m = part.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            mu, mv = part @ uv[:, 0] / m, part @ uv[:, 1] / m
            a, b = (uv[:, 0] - mu[:, None]) * part, (uv[:, 1] - mv[:, None]) * part
            aa, bb, q = a * a, b * b, a * a + b * b
            ab, aq, bq, aa, bb, q = (a * b).sum(axis=1), (a * q).sum(axis=1), (b * q).sum(axis=1), aa.sum(axis=1), bb.sum(axis=1), q.sum(axis=1)
            det = aa * bb - ab * ab
            det = np.where((m >= 3) & (det > (aa + bb) * (aa + bb) * 1e-12), det, np.nan)
            cx, cy = (aq * bb - bq * ab) / (2 * det), (bq * aa - aq * ab) / (2 * det)
            r = np.sqrt(q / m + cx * cx + cy * cy)
        return cx + mu, cy + mv, r

    take = math.floor(n * share)
    some = circles((place <= np.partition(place, take - 1, axis=1)[:, take - 1 : take]).astype(float))
    whole = None
    out = []
    for i in range(3):
        fit = some[i][~np.isnan(some[i])]
        if not len(fit) and whole is None:
            whole = circles(np.ones((1, n)))
        out.append(fit.mean() if len(fit) else whole[i][0])
    return None if np.isnan(out).any() else (mean + out[0] * axes[0] + out[1] * axes[1], float(out[2]))


def seed_spheres(points: DataFrame, height: float = 0.2, least: int = 10, rank: Rank = _hashed) -> DataFrame:
    """tree_id, x, y, z, radius, spread: the first sphere of each tree that has `least` points within `height` of its lowest one: their ring, at that lowest point's height, with twice its radius."""
    low = points.groupBy("tree_id").agg(F.min("z").alias("_low"))
    base = points.join(low, "tree_id").filter(F.col("z") <= F.col("_low") + num(height)).select("tree_id", "point_id", *XYZ)
    return rings(base, ["tree_id"], rank=rank).filter(F.col("n") >= least).join(low, "tree_id").select("tree_id", "x", "y", F.col("_low").alias("z"), (2 * F.col("r")).alias("radius"), F.col("r").alias("spread"))


def candidates(points: DataFrame, spheres: DataFrame, eps_deg: float = 20.0, min_samples: int = 5, thickness: float = 0.1, rank: Rank = _hashed) -> DataFrame:
    """tree_id, sphere_id, label, n, x, y, z, spread: where branches may go on from spheres (tree_id, sphere_id, x, y, z, radius).

    The points in each sphere's outer shell (radius - thickness < d <= radius) are clustered by their direction from its
    centre; each cluster's ring is a candidate, unless it lies more than one and a half radii away. points: those not used up.

    Spheres lie in cells as wide as the power of two that holds their radius, and meet the points around their cell in
    groups; a shell never leaves its group, as all shells together grow with the square of the points. Cells with more than
    AROUND points around them go by joins.
    """
    cell, width = ["tree_id", "_level", "gx", "gy", "gz"], F.pow(num(2), F.col("_level"))
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    s = spheres.filter("radius >= 0").select("tree_id", "sphere_id", *(F.col(c).cast("double").alias(c) for c in XYZ), F.col("radius").cast("double").alias("radius")).dropna(subset=list(XYZ))
    s = s.withColumn("_level", F.ceil(F.log2(F.greatest("radius", num(1e-6)) * (1 + 1e-9))).cast("int")).withColumns({f"g{c}": at(c) for c in XYZ})
    gap = norm([F.greatest(num(0), F.col(f"g{c}") * width - F.col(c), F.col(c) - (F.col(f"g{c}") + 1) * width) for c in XYZ])
    p = points.select("tree_id", "point_id", *(F.col(c).cast("double").alias(c) for c in XYZ)).dropna(subset=list(XYZ)).join(s.groupBy("tree_id", "_level").agg(F.max("radius").alias("_most")), "tree_id")
    for c in XYZ:
        p = p.withColumn(f"g{c}", F.explode(F.sequence(at(c) - 1, at(c) + 1)))
    p = p.filter(gap <= F.col("_most") * (1 + 1e-9) + 1e-12).drop("_most").hint("merge")
    held = s.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    held = cut(p.join(held, cell).groupBy(*cell, "n").agg(F.count(F.lit(1)).alias("_around")).select(*cell, "_around", F.least(F.lit(DEALS), F.ceil(F.col("n") / DEAL)).cast("int").alias("_deals")))
    few = held.filter(F.col("_around") <= AROUND)
    out = _candidates_by_groups(p.join(few, cell), s.join(few, cell), [*cell, "_deal"], math.radians(eps_deg), min_samples, thickness, rank)
    many = held.filter(F.col("_around") > AROUND)
    if not many.isEmpty():
        crowded = s.join(many, cell, "left_semi").select("tree_id", "sphere_id", *XYZ, "radius")
        out = out.unionByName(_candidates_by_joins(points, crowded, math.radians(eps_deg), min_samples, thickness, rank))
    return out


def _candidates_by_groups(points: DataFrame, spheres: DataFrame, keys: list[str], eps: float, min_samples: int, thickness: float, rank: Rank, fits: int = 10, share: float = 0.8) -> DataFrame:
    """candidates of spheres and the points around them, which meet by keys (the last one, _deal, is one of _deals numbers)."""
    left = spheres.withColumn("_deal", F.pmod(F.xxhash64("sphere_id"), F.col("_deals")).cast("int")).select(*(F.col(k).alias(f"_k{k}") for k in keys), "sphere_id", *XYZ, "radius")
    ranks = [f"_r{k}" for k in range(fits)]
    right = points
    for k, name in enumerate(ranks):
        right = right.withColumn("fit", F.lit(k)).withColumn(name, rank())
    right = right.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).select(*(F.col(k).alias(f"_k{k}") for k in keys), "point_id", *XYZ, *ranks)
    keys = [f"_k{k}" for k in keys]
    kinds = {f.name: f.dataType for df in (left, right) for f in df.schema}
    schema = T.StructType([T.StructField("tree_id", kinds["_ktree_id"]), T.StructField("sphere_id", kinds["sphere_id"]), T.StructField("label", kinds["point_id"]), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in (*XYZ, "spread"))])

    def run(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        p = p.sort_values("point_id", kind="stable")
        x, ids = p[list(XYZ)].to_numpy(float), p["point_id"].to_numpy()
        place = np.empty((fits, len(p)), np.int32)  # of each point in each fit's order
        for k, name in enumerate(ranks):
            place[k, p[name].to_numpy().argsort(kind="stable")] = np.arange(len(p))
        del p
        for tree, sphere, centre, radius in zip(s["_ktree_id"], s["sphere_id"], s[list(XYZ)].to_numpy(float), s["radius"].to_numpy(float)):
            v = x - centre
            d = np.sqrt(v[:, 0] * v[:, 0] + v[:, 1] * v[:, 1] + v[:, 2] * v[:, 2])
            shell = np.flatnonzero((d <= radius) & (d > radius - thickness) & (d > 0))
            if len(shell) < min_samples:
                continue
            label, core = dbscan_cores(v[shell], eps, min_samples, angular=True)
            for k in range(label.max() + 1):
                own = shell[label == k]
                got = ring(x[own], place[:, own], share)
                if got is not None and np.sqrt(((got[0] - centre) ** 2).sum()) <= 1.5 * radius:
                    rows.append((tree, sphere, ids[shell[core & (label == k)][0]], len(own), *got[0], got[1]))
        return pd.DataFrame(rows, columns=schema.names)

    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or Spark would join tasks of few bytes, whose work grows with their square
    return left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(run, schema)


def _candidates_by_joins(points: DataFrame, spheres: DataFrame, eps: float, min_samples: int, thickness: float, rank: Rank) -> DataFrame:
    """candidates for shells of any number of points; all shells are written."""
    key = F.struct("tree_id", "sphere_id").alias("tree_id")
    inside = reach_join(points, spheres.withColumnRenamed("sphere_id", "ball_id"), with_points=None).withColumnRenamed("ball_id", "sphere_id")
    shell = inside.filter(F.col("d") > F.col("radius") - num(thickness)).join(points.select("tree_id", "point_id", *XYZ), ["tree_id", "point_id"]).select(key, "point_id", *XYZ)
    label = cluster_directions(shell, eps, min_samples, spheres.select(key, *XYZ)).filter("label >= 0")
    ring = rings(shell.join(label, ["tree_id", "point_id"]), ["tree_id", "label"], rank=rank)
    ring = ring.select("tree_id.tree_id", "tree_id.sphere_id", "label", "n", *XYZ, F.col("r").alias("spread"))
    own = spheres.select("tree_id", "sphere_id", "radius", *(F.col(c).alias(f"_s{c}") for c in XYZ))
    far = distance([F.col(c) for c in XYZ], [F.col(f"_s{c}") for c in XYZ])
    return ring.join(own, ["tree_id", "sphere_id"]).filter(far <= 1.5 * F.col("radius")).select("tree_id", "sphere_id", "label", "n", *XYZ, "spread")


def accepted(points: DataFrame, spheres: DataFrame, found: DataFrame, factor: float = 2.0, radii: tuple[float, float] = (0.15, 0.4), growth: tuple[float, float] = (0.33, 1.05), alpha: float = 0.5, least: int = 4) -> DataFrame:
    """tree_id, sphere_id, label, x, y, z, spread, radius, score, fresh: the candidates that become spheres.

    A candidate's spread is held within `growth` times that of its sphere, its radius is `factor` times that, held within
    `radii`; it needs `least` points in reach that its sphere does not hold (fresh). The score, by which growth goes on, is a
    running mean of spreads: alpha * spread + (1 - alpha) * the sphere's score. spheres: with spread and score.
    """
    own = spheres.select("tree_id", "sphere_id", F.col("radius").alias("_radius"), F.col("spread").alias("_spread"), F.col("score").alias("_score"), *(F.col(c).alias(f"_s{c}") for c in XYZ))
    low, high = (num(g) * F.col("_spread") for g in growth)
    x = found.join(own, ["tree_id", "sphere_id"]).withColumn("spread", F.greatest(low, F.least(high, F.col("spread"))))
    x = x.withColumns({"radius": F.greatest(num(radii[0]), F.least(num(radii[1]), F.col("spread") * num(factor))), "score": num(alpha) * F.col("spread") + num(1 - alpha) * F.col("_score"), "ball_id": F.struct("sphere_id", "label")})
    places = [f"_p{c}" for c in XYZ]
    x = cut(x)  # used twice
    met = reach_join(points.withColumns({p: F.col(c) for p, c in zip(places, XYZ)}), x, with_points=places, with_balls=["_radius", *(f"_s{c}" for c in XYZ)])
    new = met.filter(distance([F.col(p) for p in places], [F.col(f"_s{c}") for c in XYZ]) > F.col("_radius"))
    fresh = new.groupBy("tree_id", "ball_id").agg(F.count(F.lit(1)).alias("fresh")).filter(F.col("fresh") >= least)
    return x.join(fresh, ["tree_id", "ball_id"]).select("tree_id", "sphere_id", "label", *XYZ, "spread", "radius", "score", "fresh")


def used_up(points: DataFrame, spheres: DataFrame, children: DataFrame, eps: float = 0.1) -> DataFrame:
    """tree_id, point_id: the points that spheres and the cylinders to their accepted children use up: those within a sphere, and those closer than eps to a cylinder's surface and within three radii of its sphere."""
    ball = lambda k: reach_join(points, spheres.select("tree_id", F.col("sphere_id").alias("ball_id"), *XYZ, (num(k) * F.col("radius")).alias("radius"))).select("tree_id", "point_id", F.col("ball_id").alias("sphere_id"))
    ends = children.join(spheres.select("tree_id", "sphere_id", *(F.col(c).alias(f"s{c}") for c in XYZ)), ["tree_id", "sphere_id"])
    key = F.struct("tree_id", "sphere_id").alias("tree_id")
    cylinders = ends.select(key, F.xxhash64("sphere_id", "label").alias("id"), *(f"s{c}" for c in XYZ), *(F.col(c).alias(f"e{c}") for c in XYZ), F.col("spread").alias("radius"))
    wide = ball(3).join(points.select("tree_id", "point_id", *XYZ), ["tree_id", "point_id"]).select(key, "point_id", *XYZ)
    near = near_cylinders(wide, cylinders, eps).select("tree_id.tree_id", "point_id")
    return ball(1).select("tree_id", "point_id").unionByName(near).distinct()
