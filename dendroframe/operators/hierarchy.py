"""Cylinder hierarchies as relations: levels, top-down correction, re-rooting, connected components.

Hierarchies are climbed by doubling: each round joins every node with what its farthest known ancestor knows, so a tree of
depth D takes log2(D) rounds, whatever the number of rows. Every round is written to the shared checkpoint folder, so plans
stay short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cylinder_volume, num
from ..sources.scratch import cut

#: Nodes of a path that a row carries: the levels that one round of a top-down pass settles.
PATH = 32


def roots(cylinders: DataFrame) -> DataFrame:
    return cylinders.filter("parent_id is null")


def climb(nodes: DataFrame, value: Column | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(state, jumps) for nodes (tree_id, id, parent_id): state has tree_id, id, level (steps to the root; null for nodes that hang on none, circles included), top (the root's id), and with value path (value of up to PATH nodes, from the farthest ancestor down to the node itself) and entry (the ancestor above a full path). jumps[i] has tree_id, id, at: the ancestor 2^i steps up (null: beyond the root)."""
    path = [F.array(value).alias("path"), F.lit(None).cast(nodes.schema["parent_id"].dataType).alias("entry")] if value is not None else []
    root = F.col("parent_id").isNull()
    state = cut(nodes.select("tree_id", "id", F.col("parent_id").alias("at"), F.when(root, 0).otherwise(1).alias("n"), F.when(root, F.col("id")).alias("top"), *path))
    jumps, size, most = [], 1, state.count()
    while size <= 2 * most and not state.filter("at is not null").isEmpty():  # beyond that, only circles are open
        jumps.append(state.select("tree_id", "id", "at"))
        above = state.select("tree_id", F.col("id").alias("at"), *(F.col(c).alias(f"_{c}") for c in state.columns if c not in ("tree_id", "id")))
        open_ = F.col("at").isNotNull()
        new = {"at": F.when(open_, F.col("_at")), "n": F.when(open_, F.col("n") + F.coalesce("_n", F.lit(0))).otherwise(F.col("n")), "top": F.when(open_, F.col("_top")).otherwise(F.col("top"))}
        if value is not None and size < PATH:
            new["path"] = F.when(open_ & F.col("_path").isNotNull(), F.concat("_path", "path")).otherwise(F.col("path"))
            if 2 * size == PATH:
                new["entry"] = new["at"]
        joined = state.join(above, ["tree_id", "at"], "left")
        state = cut(joined.select("tree_id", "id", *(new.get(c, F.col(c)).alias(c) for c in state.columns if c not in ("tree_id", "id"))))
        size *= 2
    level = F.when(F.col("top").isNotNull() & F.col("at").isNull(), F.col("n")).alias("level")
    return state.select("tree_id", "id", level, "top", *(["path", "entry"] if value is not None else [])), jumps


def correct_radii(cylinders: DataFrame, low: float, high: float, only: str | None = None) -> DataFrame:
    """Each cylinder's radius held within [low, high] times its parent's corrected radius, from the roots down (only: cylinders of this type); the volume is made anew. Cylinders that hang on no root keep their values (level null).

    A row carries the radii of the PATH nodes above it, so the levels are settled PATH at a time: one pass for trees up to
    that depth, else one join of each range of levels with the range above it.
    """
    held = F.lit(True) if only is None else F.coalesce(F.col("type") == only, F.lit(False))
    state, _ = climb(cylinders.select("tree_id", "id", "parent_id", "radius", held.alias("held")), F.struct("radius", "held"))
    fold = lambda start: F.aggregate(
        "path", start.cast("double"), lambda p, x: F.when(p.isNull() | ~x["held"], x["radius"]).otherwise(F.greatest(F.least(x["radius"], p * num(high)), p * num(low)))
    )
    deepest = state.agg(F.max("level")).first()[0] or 0
    if deepest < PATH:
        walk = state.filter("level is not null").select("tree_id", "id", fold(F.lit(None)).alias("new_radius"), "level")
    else:
        walk = None
        bands = cut(state.filter("level is not null").withColumn("band", F.expr(f"level div {PATH}")).repartition("band", "tree_id", F.expr("pmod(xxhash64(id), 16)")).sortWithinPartitions("band"))
        before = None
        for k in range(deepest // PATH + 1):
            band = bands.filter(F.col("band") == k)
            if before is None:
                done = band.select("tree_id", "id", fold(F.lit(None)).alias("new_radius"), "level")
            else:
                done = band.join(before.select("tree_id", F.col("id").alias("entry"), F.col("new_radius").alias("_start")), ["tree_id", "entry"]).select("tree_id", "id", fold(F.col("_start")).alias("new_radius"), "level")
            before = done = cut(done)
            walk = done if walk is None else walk.unionByName(done)
    out = cylinders.join(walk, ["tree_id", "id"], "left").withColumn("radius", F.coalesce("new_radius", "radius")).drop("new_radius")
    if "length" in cylinders.columns:
        out = out.withColumn("volume", cylinder_volume(F.col("radius"), F.col("length")))
    return out


def reroot(edges: DataFrame, new_roots: DataFrame) -> DataFrame:
    """Parents when each tree hangs on its new root (one per tree): columns tree_id, id, parent_id, level; nodes the root does not reach are left out.

    Only the nodes between the new root and the old one change their parents, so that path is looked up (by doubling) and
    turned round; levels are counted by climbing again. edges (tree_id, id, parent_id) form trees: no circles.
    """
    own = edges.select("tree_id", "id", "parent_id")
    bare = own.filter("parent_id is not null").select("tree_id", F.col("parent_id").alias("id")).distinct().join(own, ["tree_id", "id"], "left_anti")
    nodes = cut(own.unionByName(bare.withColumn("parent_id", F.lit(None).cast(own.schema["parent_id"].dataType))))
    _, jumps = climb(nodes)
    way = new_roots.select("tree_id", "id", F.lit(0).cast("long").alias("far"))
    for i, jump in enumerate(jumps):
        up = way.join(jump.filter("at is not null"), ["tree_id", "id"]).select("tree_id", F.col("at").alias("id"), (F.col("far") + 2**i).alias("far"))
        way = cut(way.unionByName(up.join(nodes.select("tree_id", "id"), ["tree_id", "id"], "left_semi")))
    below = way.select("tree_id", (F.col("far") + 1).alias("far"), F.col("id").alias("below"))
    turned = way.join(below, ["tree_id", "far"], "left").select("tree_id", "id", "below", F.lit(True).alias("turned"))
    flipped = nodes.join(turned, ["tree_id", "id"], "left").select("tree_id", "id", F.when(F.col("turned"), F.col("below")).otherwise(F.col("parent_id")).alias("parent_id"))
    flipped = cut(flipped)
    state, _ = climb(flipped)
    reached = state.filter("level is not null").join(new_roots.select("tree_id", F.col("id").alias("top")), ["tree_id", "top"], "left_semi")
    return flipped.join(reached.select("tree_id", "id", "level"), ["tree_id", "id"]).select("tree_id", "id", "parent_id", F.col("level").cast("int").alias("level"))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """tree_id, point_id, component (least id that edges (tree_id, a, b) connect it with).

    Each round takes the least label among neighbours and then jumps to that label's label; rounds grow with the
    logarithm of a component's width in practice. Stops when no label changes.
    """
    both = edges.select("tree_id", "a", "b").union(edges.select("tree_id", F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    labels = nodes.select("tree_id", F.col("point_id").alias("id"), F.col("point_id").alias("label"))
    both, labels = cut(both), cut(labels)
    for _ in range(most_rounds):
        near = both.join(labels.select("tree_id", F.col("id").alias("b"), F.col("label").alias("l")), ["tree_id", "b"]).groupBy("tree_id", F.col("a").alias("id")).agg(F.min("l").alias("l"))
        step = cut(labels.join(near, ["tree_id", "id"], "left").select("tree_id", "id", "label", F.least("label", F.coalesce("l", "label")).alias("new")))
        jump = step.select("tree_id", F.col("id").alias("new"), F.col("new").alias("jumped"))
        new = cut(step.join(jump, ["tree_id", "new"], "left").select("tree_id", "id", F.coalesce("jumped", "new").alias("label"), (F.coalesce("jumped", "new") != F.col("label")).alias("moved")))
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select("tree_id", F.col("id").alias("point_id"), F.col("label").alias("component"))


def children_of(cylinders: DataFrame) -> DataFrame:
    """Cylinders with children_ids, from their parents."""
    kids = cylinders.filter("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list(F.col("id"))).alias("children_ids"))
    return cylinders.drop("children_ids").join(kids, ["tree_id", "id"], "left").withColumn("children_ids", F.coalesce("children_ids", F.array().cast("array<bigint>")))


def with_measures(cylinders: DataFrame) -> DataFrame:
    """length and volume from the ends and the radius."""
    length = F.sqrt(sum(((F.col(f"e{k}") - F.col(f"s{k}")) * (F.col(f"e{k}") - F.col(f"s{k}")) for k in "xyz"), num(0)))
    return cylinders.withColumn("length", length).withColumn("volume", cylinder_volume(F.col("radius"), F.col("length")))
