"""Evaluation products: the tables behind the comparisons of clouds and models before and after a prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cols, in_box, num
from .neighbours import paired
from .points import apply_offset
from .stats import DISTANCE_EDGES, bin_centres, binned, log_edges, mean_error, neighbour_distance, power_law

#: Boxes of the slice report, low and high corners in metres (fixed values).
SLICES = [
    ((21.9, -20.9, -2.8), (22.25, -20.5, -2.6)), ((21.0, -23.0, 8.3), (23.0, -21.3, 8.95)), ((19.55, -19.8, 13.12), (21.1, -17.51, 13.6)),
    ((18.2, -25.4, 16.5), (20.7, -22.8, 17.47)), ((20.5, -21.0, 22.15), (22.4, -19.9, 24.7)),
]


def binned_fit(df: DataFrame, before: str, after: str, edges: list[float], geometric: bool = False) -> DataFrame:
    """Bins of `before` with n, mean and std of `after`, the bin's centre, and beside them the power law after = a * before^b over all rows (a, b and their errors, the same in every row)."""
    centre = F.create_map(*(x for i, m in enumerate(bin_centres(edges, geometric)) if m is not None for x in (F.lit(i), num(m))))
    fit = power_law(df, before, after).select(F.col("n").alias("n_all"), "a", "b", "a_err", "b_err")
    one = fit.withColumn("_one", F.lit(1))
    bins = binned(df, before, after, edges).withColumns({"centre": centre[F.col("bin")], "_one": F.lit(1)})
    return bins.join(one, "_one").drop("_one")  # fit is one row


def nnd_comparison(points: DataFrame, k: int = 1, edges: list[float] = DISTANCE_EDGES) -> DataFrame:
    """Nearest-neighbour distances of each cloud against those of the same points moved by their offsets: bins, centres and power law."""
    return binned_fit(nnd_pairs(points, k), "v_a", "v_b", edges)


def nnd_pairs(points: DataFrame, k: int = 1) -> DataFrame:
    """tree_id, point_id, v_a, v_b: mean distance to the k nearest others before and after the offsets."""
    a, b = (neighbour_distance(p, k).withColumnRenamed("mean_distance", "v") for p in (points, apply_offset(points)))
    return paired(a, b, "v")


def tree_comparison(a: DataFrame, b: DataFrame, value: str = "distance") -> DataFrame:
    """Mean of value per tree on both sides, for trees that both have, and the gain a - b."""
    one, two = (x.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy("tree_id").agg(F.avg(value).alias(f"mean_{n}"), F.count(F.lit(1)).alias(f"n_{n}")) for x, n in ((a, "a"), (b, "b")))
    return one.join(two, "tree_id").withColumn("gain", F.col("mean_a") - F.col("mean_b"))


def slice_report(points: DataFrame, boxes: list[tuple] = SLICES, k: int = 1) -> DataFrame:
    """For each tree and box (closed) that holds points: their number, and mean and error of the distance to their k nearest others inside the box, before and after the offsets. Points keep the box they start in."""
    hit = F.array_compact(F.array(*(F.when(in_box(cols("x", "y", "z"), low, high), F.lit(i)) for i, (low, high) in enumerate(boxes))))
    held = points.withColumn("slice", F.explode(hit))
    # a slice of a tree is taken as a cloud of its own
    own = F.to_json(F.struct("tree_id", "slice"))
    names = held.select(own.alias("key"), "tree_id", "slice").groupBy("key").agg(F.first("tree_id").alias("tree_id"), F.first("slice").alias("slice"), F.count(F.lit(1)).alias("n"))
    pairs = nnd_pairs(held.withColumn("tree_id", own), k)
    out = names
    for side in ("a", "b"):
        out = out.join(mean_error(pairs, f"v_{side}", ["tree_id"]).select(F.col("tree_id").alias("key"), F.col("mean").alias(f"mean_{side}"), F.col("sem").alias(f"sem_{side}")), "key", "left")
    return out.drop("key")


def offset_bins(df: DataFrame, before: str, after: str, low: float = 1e-5) -> DataFrame:
    """Logarithmic bins from `low` to the largest value, with geometric centres and the power law."""
    top = df.agg(F.max(F.when(~F.isnan(before), F.col(before)))).first()[0]
    if top is None or top <= low:
        top = low * 10
    return binned_fit(df, before, after, log_edges(low, float(top)), geometric=True)
