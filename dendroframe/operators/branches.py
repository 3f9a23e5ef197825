"""Merging of branches: spheres of separate clusters of a tree are joined by their best joints, as relations.

A joint is a pair of outer spheres of two clusters that are near each other, where the one's heading leads to the other, or
that are very near. Clusters are joined best joint first; the joints that are used are the minimum spanning forest of the
clusters over the joints' order (fit before loose, then distance, then numbers), so they do not depend on how the work is
dealt. Each round every merged cluster takes its best joint to another one (Boruvka), which at least halves their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dot, norm, num
from ..sources.scratch import cut
from .hierarchy import components
from .neighbours import XYZ, reach_join, tree_parts

HEADING = ("hx", "hy", "hz")
JOINT = ("loose", "far", "a", "b", "cluster_a", "cluster_b")
#: Joints that a task holds before it lets those go that others of their clusters lead.
HELD = 100_000


def joints(spheres: DataFrame, max_dist: float, max_angle: float, effective: bool = False) -> DataFrame:
    """tree_id, cluster_a, cluster_b, loose, far, a, b: pairs of spheres (tree_id, sphere_id, cluster, x, y, z, spread, hx, hy, hz, tied) of different clusters; a the branch's, b the main one's.

    far: between centres, or with effective between surfaces (not below 0). loose = 0: far < max_dist, and b's heading leads
    to a within max_angle (degrees); loose = 1: far < max_dist / 2 at any angle. Two spheres that are both not tied (no
    cylinder ends there) are no joint. Found by cells: no sphere meets its whole tree.
    """
    own = ["cluster", "spread", "tied"]
    points = spheres.select("tree_id", F.col("sphere_id").alias("point_id"), *XYZ, *own)
    reach = num(max_dist)
    main = spheres
    if effective:
        wide = spheres.groupBy("tree_id").agg(F.max("spread").alias("_wide"))
        main, reach = main.join(wide, "tree_id"), reach + F.col("spread") + F.col("_wide")
    balls = main.select("tree_id", F.col("sphere_id").alias("ball_id"), *XYZ, reach.alias("radius"), *(F.col(c).alias(f"_m{c}") for c in own), *HEADING, *(F.col(c).alias(f"_b{c}") for c in XYZ))
    met = reach_join(points.withColumns({f"_a{c}": F.col(c) for c in XYZ}), balls, with_points=[*own, *(f"_a{c}" for c in XYZ)], with_balls=[*(f"_m{c}" for c in own), *HEADING, *(f"_b{c}" for c in XYZ)])
    met = met.filter((F.col("cluster") != F.col("_mcluster")) & (F.col("tied") | F.col("_mtied")))
    gap, head = [F.col(f"_a{c}") - F.col(f"_b{c}") for c in XYZ], [F.col(c) for c in HEADING]
    far = F.greatest(num(0), F.col("d") - F.col("spread") - F.col("_mspread")) if effective else F.col("d")
    cos = dot(gap, head) / F.greatest(F.col("d") * norm(head), num(1e-12))
    met = met.withColumns({"far": far, "_cos": cos}).withColumn("loose", F.when((F.col("far") < max_dist) & (F.col("_cos") >= math.cos(math.radians(max_angle))), 0).when(F.col("far") < max_dist / 2, 1))
    return met.filter("loose is not null").select("tree_id", F.col("cluster").alias("cluster_a"), F.col("_mcluster").alias("cluster_b"), "loose", "far", F.col("point_id").alias("a"), F.col("ball_id").alias("b"))


def leading_joints(found: DataFrame) -> DataFrame:
    """Of the joints that a task has, those of each pair of clusters that no other leads (by loose, then far): tree_id, lo, hi and the joint. A task holds HELD of them at a time and sorts no more; a pair may keep several (of other tasks, or as near)."""
    parts, whole = tree_parts(found)
    rows = found.select(*(c.alias(n) for n, c in parts.items()), F.least("cluster_a", "cluster_b").alias("lo"), F.greatest("cluster_a", "cluster_b").alias("hi"), *JOINT)
    keys = [*parts, "lo", "hi"]

    def lead(t: pa.Table) -> pa.Table:
        pair = np.zeros(t.num_rows, np.int64)
        for k in keys:
            code = pc.fill_null(pc.dictionary_encode(t[k].combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
            pair = np.unique(pair * (t.num_rows + 1) + code + 1, return_inverse=True)[1]
        loose, far = t["loose"].to_numpy(), t["far"].to_numpy()
        order = np.lexsort((far, loose, pair))
        first = order[np.r_[True, np.diff(pair[order]) > 0]]
        return t.filter(pa.array((loose == loose[first][pair]) & (far == far[first][pair])))

    def run(batches):
        held, n, least = [], 0, HELD
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= least:
                kept = lead(pa.Table.from_batches(held))
                if kept.num_rows > HELD // 2:  # too many pairs for this task: the shuffle brings them together
                    yield from kept.to_batches()
                    kept = kept.slice(0, 0)
                held, n = kept.to_batches(), kept.num_rows
                least = n + HELD // 2
        if n:
            yield from lead(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(run, rows.schema).select(whole, "lo", "hi", *JOINT)


def merge_branches(spheres: DataFrame, max_dist: float, max_angle: float, effective: bool = False, base: int = 0) -> tuple[DataFrame, DataFrame]:
    """(labels, used): labels has tree_id, cluster, merged (the name of the whole: the base's cluster, or its cluster of most spheres, ties the lower); used the joints taken: tree_id, cluster_a, cluster_b, loose, far, a, b."""
    found = joints(spheres, max_dist, max_angle, effective)
    pairs = leading_joints(found).groupBy("tree_id", "lo", "hi").agg(F.min(F.struct(*JOINT)).alias("j"))
    pairs = cut(pairs.withColumns({"from": F.col("lo"), "to": F.col("hi")}))
    labels = cut(spheres.groupBy("tree_id", "cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.col("cluster")))
    used = None
    while not pairs.isEmpty():
        both = pairs.select("tree_id", F.col("from").alias("label"), "j").unionByName(pairs.select("tree_id", F.col("to").alias("label"), "j"))
        best = both.groupBy("tree_id", "label").agg(F.min("j").alias("j")).select("tree_id", "j").distinct()
        taken = cut(pairs.join(best, ["tree_id", "j"], "left_semi"))
        used = taken.select("tree_id", "j") if used is None else used.unionByName(taken.select("tree_id", "j"))
        nodes = labels.select("tree_id", F.col("label").alias("point_id")).distinct()
        now = components(nodes, taken.select("tree_id", F.col("from").alias("a"), F.col("to").alias("b"))).select("tree_id", F.col("point_id").alias("label"), F.col("component").alias("_new"))
        labels = cut(labels.join(now, ["tree_id", "label"]).select("tree_id", "cluster", "n", F.col("_new").alias("label")))
        for end in ("from", "to"):
            pairs = pairs.join(now.select("tree_id", F.col("label").alias(end), F.col("_new").alias(f"_{end}")), ["tree_id", end])
        pairs = cut(pairs.filter("_from <> _to").select("tree_id", "lo", "hi", "j", F.col("_from").alias("from"), F.col("_to").alias("to")))
    name = labels.groupBy("tree_id", "label").agg(F.min(F.struct((F.col("cluster") != base).alias("k"), (-F.col("n")).alias("m"), "cluster")).alias("_n")).select("tree_id", "label", F.col("_n.cluster").alias("merged"))
    labels = labels.join(name, ["tree_id", "label"]).select("tree_id", "cluster", "merged")
    if used is None:
        used = found.limit(0)
        return labels, used
    return labels, used.select("tree_id", "j.cluster_a", "j.cluster_b", "j.loose", "j.far", "j.a", "j.b")
