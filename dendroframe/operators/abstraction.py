"""Set abstraction and feature propagation: trained layers over balls around sampled points, and back to all points.

Features are an array column (feat). Balls and nearest points are the grid joins of `neighbours`; dense layers run in Arrow
batches over a ball's rows; the largest value of each channel is a partial aggregate, so a ball's rows are folded where they
are made. Points that fill up a short ball repeat its first and cannot change a maximum, so they are not made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import num
from ..sources.scratch import cut
from .cluster import farthest_points
from .layers import Step, batch_norm, linear, mapped, relu
from .neighbours import XYZ, ball_join, knn

BN_EPS = 1e-5


def shared_layers(w: dict[str, np.ndarray], name: str, convs: str = "mlp_convs", norms: str = "mlp_bns", eps: float = BN_EPS) -> list[Step]:
    """The layers <name>.<convs>.0, 1, ... : linear, norm, activation each."""
    out, i = [], 0
    while f"{name}.{convs}.{i}.weight" in w:
        out += [linear(w[f"{name}.{convs}.{i}.weight"], w.get(f"{name}.{convs}.{i}.bias")), batch_norm(w, f"{name}.{norms}.{i}", eps), relu]
        i += 1
    if not out:
        raise ValueError(f"no layers {name}.{convs}.0 among {sorted(w)[:5]}")
    return out


def _width(w: dict[str, np.ndarray], name: str, convs: str = "mlp_convs") -> int:
    last = max(int(k.split(".")[-2]) for k in w if k.startswith(f"{name}.{convs}.") and k.endswith(".weight"))
    return len(w[f"{name}.{convs}.{last}.weight"])


def _largest(rows: DataFrame, width: int) -> DataFrame:
    return rows.groupBy("tree_id", "point_id").agg(F.array(*(F.max(F.col("feat")[i]) for i in range(width))).alias("feat"))


def ball(centres: DataFrame, points: DataFrame, radius: float, most: int) -> DataFrame:
    """tree_id, point_id, other_id: the first `most` points by id within the radius of each centre; the nearest where there is none."""
    near = ball_join(centres, points, radius)
    inside = near.withColumn("_k", F.row_number().over(Window.partitionBy("tree_id", "point_id").orderBy("other_id"))).filter(F.col("_k") <= most).select("tree_id", "point_id", "other_id")
    alone = cut(centres.join(inside.select("tree_id", "point_id").distinct(), ["tree_id", "point_id"], "left_anti").select("tree_id", "point_id", *XYZ))
    return inside if alone.isEmpty() else inside.unionByName(knn(alone, points, 1).select("tree_id", "point_id", "other_id"))


def _grouped(points: DataFrame, centres: DataFrame, radius: float, most: int, coords_first: bool) -> DataFrame:
    """A row for each point of each centre's ball: its place relative to the centre, and its features."""
    o = points.select("tree_id", F.col("point_id").alias("other_id"), *(F.col(c).alias(f"o{c}") for c in XYZ), "feat")
    rows = ball(centres, points, radius, most).join(o, ["tree_id", "other_id"]).join(centres.select("tree_id", "point_id", *XYZ), ["tree_id", "point_id"])
    place = F.array(*(F.col(f"o{c}") - F.col(c) for c in XYZ))
    return rows.select("tree_id", "point_id", (F.concat(place, "feat") if coords_first else F.concat("feat", place)).alias("feat"))


def sampled(points: DataFrame, n: int) -> DataFrame:
    return cut(farthest_points(points, n).join(points.select("tree_id", "point_id", *XYZ), ["tree_id", "point_id"]).select("tree_id", "point_id", *XYZ))


def set_abstraction(points: DataFrame, w: dict[str, np.ndarray], name: str, n: int, radius: float, most: int) -> DataFrame:
    """n centres of each tree (tree_id, point_id, x, y, z) with feat: the largest values over their balls of the layers' outputs, from coordinates relative to the centre and features."""
    centres = sampled(points, n)
    rows = mapped(_grouped(points, centres, radius, most, True), *shared_layers(w, name))
    return cut(centres.join(_largest(rows, _width(w, name)), ["tree_id", "point_id"]))


def set_abstraction_scales(points: DataFrame, w: dict[str, np.ndarray], name: str, n: int, scales: list[tuple[float, int]]) -> DataFrame:
    """The same around the same centres at several (radius, most), each with layers of its own (conv_blocks.<scale>, bn_blocks.<scale>); features side by side. Here features come before relative coordinates."""
    centres = sampled(points, n)
    out = centres.withColumn("feat", F.array().cast("array<double>"))
    for i, (radius, most) in enumerate(scales):
        convs = f"conv_blocks.{i}"
        rows = mapped(_grouped(points, centres, radius, most, False), *shared_layers(w, name, convs, f"bn_blocks.{i}"))
        one = _largest(rows, _width(w, name, convs)).select("tree_id", "point_id", F.col("feat").alias("_f"))
        out = out.join(one, ["tree_id", "point_id"]).withColumn("feat", F.concat("feat", "_f")).drop("_f")
    return cut(out)


def set_abstraction_all(points: DataFrame, w: dict[str, np.ndarray], name: str) -> DataFrame:
    """One row for each tree, at the origin, with the largest values over all of its points of the layers' outputs."""
    rows = points.select("tree_id", F.lit(0).cast("long").alias("point_id"), F.concat(F.array(*XYZ), "feat").alias("feat"))
    return _largest(mapped(rows, *shared_layers(w, name)), _width(w, name)).select("tree_id", "point_id", *(num(0).alias(c) for c in XYZ), "feat")


def feature_propagation(points: DataFrame, centres: DataFrame, w: dict[str, np.ndarray], name: str) -> DataFrame:
    """points (tree_id, point_id, x, y, z, feat or not) with feat: the layers over their own features and those of their three nearest centres (weights 1 / max(d^2, 1e-6); of one centre: its own)."""
    width = len(centres.select("feat").first()[0]) if not centres.isEmpty() else 0
    near = knn(points, centres, 3).join(centres.select("tree_id", F.col("point_id").alias("other_id"), "feat"), ["tree_id", "other_id"]).withColumn("_w", 1 / F.greatest(F.col("d") * F.col("d"), num(1e-6)))
    mean = near.groupBy("tree_id", "point_id").agg(F.array(*(F.sum(F.col("_w") * F.col("feat")[i]) / F.sum("_w") for i in range(width))).cast("array<double>").alias("_f"))
    own = ["feat"] if "feat" in points.columns else []
    both = points.join(mean, ["tree_id", "point_id"]).withColumn("feat", F.concat(*own, "_f")).drop("_f")
    return cut(mapped(both, *shared_layers(w, name)))
