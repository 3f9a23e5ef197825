"""Per-tree projections and filters of point clouds. Window functions over tree_id; no self-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance, norm, num



def extent(points: DataFrame, by: str = "tree_id") -> DataFrame:
    """Bounding box of each tree (partial aggregation, one row per tree)."""
    return points.groupBy(by).agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def with_tree(points: DataFrame, per_tree: DataFrame) -> DataFrame:
    """Joins one row per tree; small sides are broadcast by their size, large ones stay a shuffle join that AQE can split."""
    return points.join(per_tree, "tree_id")


def height_filter(points: DataFrame, height: float, below: bool = False) -> DataFrame:
    """Points at least `height` above their tree's lowest point (below: the others)."""
    base = points.groupBy("tree_id").agg(F.min("z").alias("_base"))
    ok = F.col("z") >= F.col("_base") + num(height)
    return with_tree(points, base).filter(~ok if below else ok).drop("_base")


def relative_height(points: DataFrame) -> DataFrame:
    e = points.groupBy("tree_id").agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    return with_tree(points, e).withColumn("height", (F.col("z") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), num(0))).drop("_lo", "_hi")


def axis_distance(points: DataFrame) -> DataFrame:
    c = points.groupBy("tree_id").agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    return with_tree(points, c).withColumn("axis_distance", F.hypot(F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy"))).drop("_cx", "_cy")


def centre(points: DataFrame, unit_sphere: bool = False) -> DataFrame:
    """Coordinates minus the tree's centroid; with unit_sphere divided by the largest distance from it (unchanged where that is 0)."""
    c = points.groupBy("tree_id").agg(*(F.avg(k).alias(f"_{k}") for k in "xyz"))
    out = with_tree(points, c).withColumns({k: F.col(k) - F.col(f"_{k}") for k in "xyz"}).drop("_x", "_y", "_z")
    if unit_sphere:
        r = out.groupBy("tree_id").agg(F.max(norm([F.col(k) for k in "xyz"])).alias("_r"))
        out = with_tree(out, r).withColumns({k: F.col(k) / F.when(F.col("_r") > 0, F.col("_r")).otherwise(num(1)) for k in "xyz"}).drop("_r")
    return out


def spread(points: DataFrame, by: str = "tree_id") -> DataFrame:
    """Mean distance to the centroid of each group; 0.01 for fewer than two points."""
    c = points.groupBy(by).agg(*(F.avg(k).alias(f"_{k}") for k in "xyz"), F.count(F.lit(1)).alias("n"))
    d = points.join(c, by).groupBy(by).agg(F.avg(distance([F.col(k) for k in "xyz"], [F.col(f"_{k}") for k in "xyz"])).alias("mean_distance"), F.first("n").alias("n"))
    return d.select(by, F.when(F.col("n") < 2, num(0.01)).otherwise(F.col("mean_distance")).alias("spread"), "n")


def apply_offset(points: DataFrame) -> DataFrame:
    return points.withColumns({k: F.col(k) + F.col(f"d{k}") for k in "xyz"})


def denoise(points: DataFrame, keep_logit: str = "l0", noise_logit: str = "l1") -> DataFrame:
    """Keeps points whose first class wins; ties go to it."""
    return points.filter(F.col(keep_logit) >= F.col(noise_logit))


def offset_labels(points: DataFrame, tau: float) -> DataFrame:
    """offset_norm, offset_mask (norm <= tau) and is_noise (norm > tau: 1)."""
    n = norm([F.col(f"d{k}") for k in "xyz"])
    return points.withColumn("offset_norm", n).withColumns({"offset_mask": F.col("offset_norm") <= tau, "is_noise": (F.col("offset_norm") > tau).cast("int")})


def pad_columns(points: DataFrame, names: list[str]) -> DataFrame:
    """Missing feature columns as 0.0."""
    return points.withColumns({c: num(0) for c in names if c not in points.columns})


def mark_segmented(points: DataFrame, segmented: DataFrame, negate: bool = True) -> DataFrame:
    """Points that are (negate: are not) in `segmented`, by tree and point id."""
    return points.join(segmented.select("tree_id", "point_id"), ["tree_id", "point_id"], "left_anti" if negate else "left_semi")


def override_noise(points: DataFrame, noise: DataFrame) -> DataFrame:
    """is_noise replaced by that of a separate noise cloud where it has the point."""
    n = noise.select("tree_id", "point_id", F.col("is_noise").alias("_noise"))
    return points.join(n, ["tree_id", "point_id"], "left").withColumn("is_noise", F.coalesce("_noise", "is_noise")).drop("_noise")


def hash_rank(seed: int, *key: str) -> Column:
    """Stands in for a random number: deterministic, the same under any partitioning."""
    return F.xxhash64(F.lit(seed), *key)
