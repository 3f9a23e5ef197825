"""Joins by cells and levels, orders from one scan, merging of branches, linkage and directions: against plain forms, with bounds on what is met."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendroframe.operators import branches, cluster, grid, growth, neighbours, qsm


def cloud(spark, x, tree="t", parts=3):
    return spark.createDataFrame([(tree, i, *map(float, v)) for i, v in enumerate(x)], "tree_id string, point_id long, x double, y double, z double").repartition(parts)


# -- balls of different radii


def test_reach_join_brute_force(spark):
    rng = np.random.default_rng(1)
    x, c, r = rng.uniform(-3, 3, (300, 3)), rng.uniform(-3, 3, (80, 3)), 2.0 ** rng.uniform(-5, 2, 80)
    r[:4] = 0, 1, 2, 0.5
    c[0] = x[5]  # a ball of no radius holds its own place
    c[1], x[7] = (0, 0, 0), (1, 0, 0)  # the edge belongs to it
    balls = [("t", i, *map(float, v), float(q)) for i, (v, q) in enumerate(zip(c, r))] + [("t", 900, 0.0, 0.0, 0.0, -1.0), ("t", 901, 0.0, 0.0, 0.0, None), ("u", 902, 0.0, 0.0, 0.0, 9.0)]
    b = spark.createDataFrame(balls, "tree_id string, ball_id long, x double, y double, z double, radius double")
    got = sorted((q.ball_id, q.point_id) for q in neighbours.reach_join(cloud(spark, x), b).collect())
    assert got == sorted((i, j) for i in range(80) for j in range(300) if np.sqrt(((x[j] - c[i]) ** 2).sum()) <= r[i])
    assert (0, 5) in got and (1, 7) in got


def test_reach_join_meets_few_pairs(spark):
    """At every radius a ball meets what 27 cells hold, not its tree."""
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 16, (4000, 3))
    p = cloud(spark, x)
    b = p.filter("point_id % 4 = 0").select("tree_id", F.col("point_id").alias("ball_id"), "x", "y", "z", F.expr("cast(0.25 as double) * power(2, point_id % 3)").alias("radius"))
    out = neighbours.reach_join(p, b)
    found, text = out.count(), out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    level = [int(np.ceil(np.log2(0.25 * 2 ** (i % 3)))) for i in range(0, 4000, 4)]
    pairs = 0
    for i, lv in zip(range(0, 4000, 4), level):
        w, r = 2.0**lv, 0.25 * 2 ** (i % 3)
        low, high = np.floor((x[i] - r) / w), np.floor((x[i] + r) / w)
        pairs += int(((np.floor(x / w) >= low) & (np.floor(x / w) <= high)).all(axis=1).sum())
    assert found <= pairs < 27 * 1.2 * sum(4000 / 16**3 * (0.25 * 2 ** (i % 3)) ** 3 for i in range(0, 4000, 4)) + 4000 < 0.05 * 4000 * 1000


# -- orders


def scans(df) -> int:
    return len(re.findall(r"\bFileScan\b|Scan parquet", df._jdf.queryExecution().executedPlan().toString()))


def test_orders_read_the_source_once(spark, tmp_path):
    cloud(spark, np.random.default_rng(3).uniform(0, 9, (500, 3))).write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    one, four = grid.serialise_all(p, 0.5, 8, ("hilbert",)), grid.serialise_all(p, 0.5, 8)
    assert scans(one) == scans(four) == 0  # ranks come from what was written
    assert "ArrowEvalPython" not in grid.serialise(p, 0.5, 8, order="hilbert")._jdf.queryExecution().executedPlan().toString()
    rows = four.collect()
    for i in range(4):
        assert [r[f"rank_{i}"] for r in sorted(rows, key=lambda r: (r[f"code_{i}"], r.point_id))] == list(range(500))


# -- branches


def test_merging_in_rounds_is_merging_by_best_joints(spark):
    """The relation's joints and names are those of the task that fits a tree."""
    rng = np.random.default_rng(4)
    for how, n in (("center", 40), ("effective", 25)):
        fit = qsm.Fit(np.zeros((0, 3)), qsm.QsmParams(distance_type=how, max_dist=0.4 if how == "center" else 0.2))
        for c in range(n):
            at, head = rng.uniform(0, 1.2, 3), rng.normal(size=3)
            before = None
            for k in range(rng.integers(1, 6)):
                here = fit.add(qsm.Sphere(at + 0.15 * k * head / np.linalg.norm(head), 0.15, 0.05 + 0.01 * k, 0.1, c, head if k else np.array([0, 0, 1.0])))
                if before is not None:
                    fit.edges.append((before, here, 0.05, "follow"))
                    fit.spheres[before].outer = False
                before = here
        tied = {i for e in fit.edges for i in e[:2]}
        rows = [("t", i, s.cluster, *map(float, s.centre), float(s.spread), *map(float, s.heading), i in tied) for i, s in enumerate(fit.spheres) if s.outer]
        df = spark.createDataFrame(rows, "tree_id string, sphere_id long, cluster long, x double, y double, z double, spread double, hx double, hy double, hz double, tied boolean")
        labels, used = branches.merge_branches(df, fit.p.max_dist, fit.p.max_angle, how == "effective")
        want = {}
        old, count = [s.cluster for s in fit.spheres], len(fit.edges)
        fit.merge_all()
        joints = sorted((b, a) for a, b, _, _ in fit.edges[count:])
        assert len(joints) > 5
        assert sorted((r.a, r.b) for r in used.collect()) == joints
        for c, s in zip(old, fit.spheres):
            want.setdefault(s.cluster, set()).add(c)
        got = {}
        for r in labels.collect():
            got.setdefault(r.merged, set()).add(r.cluster)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        assert all(0 not in g or k == 0 for k, g in got.items())


def test_merging_of_nothing(spark):
    df = spark.createDataFrame([], "tree_id string, sphere_id long, cluster long, x double, y double, z double, spread double, hx double, hy double, hz double, tied boolean")
    labels, used = branches.merge_branches(df, 1.0, 30)
    assert labels.collect() == [] and used.collect() == []


def test_fitting_time_grows_with_the_points():
    import time

    def stems(n):
        rng = np.random.default_rng(0)
        out = []
        for i in range(n // 1000):
            t, h = rng.uniform(0, 2 * np.pi, 1000), rng.uniform(0, 1, 1000)
            out.append(np.c_[i % 8 * 0.7 + 0.1 * np.cos(t), i // 8 % 8 * 0.7 + 0.1 * np.sin(t), i // 64 + h] + rng.normal(0, 0.005, (1000, 3)))
        return np.concatenate(out)

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        fit = qsm.Fit(stems(n), qsm.QsmParams())
        fit.run()
        took.append(time.process_time() - began)
        assert len(fit.cylinders()) > n / 200
    assert took[0] < 10 and took[1] < 8 * took[0]


# -- linkage


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_linkage_brute_force(spark, linkage):
    rng = np.random.default_rng(5)
    for n, t in ((60, 0.5), (120, 0.25), (40, 3.0)):
        x = rng.uniform(0, 2, (n, 3))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        want = cluster.agglomerative_labels(d, t, linkage)
        assert cluster.linked_labels(x, t, linkage).tolist() == [int(np.flatnonzero(want == k)[0]) for k in want]
    got = {r.point_id: r.label for r in cluster.agglomerate(cloud(spark, x), 0.6, linkage, 2).collect()}
    want = cluster.agglomerative_labels(d, 0.6, linkage)
    for i in range(n):
        same = np.flatnonzero(want == want[i])
        assert got[i] == (int(same[0]) if len(same) > 1 else -1)


def test_linkage_of_a_large_tree_in_small_parts():
    """200,000 points whose matrix would have 320 GB."""
    rng = np.random.default_rng(6)
    centres = np.stack(np.meshgrid(*[np.arange(30.0)] * 3), axis=-1).reshape(-1, 3)[:25_000]
    x = (centres[:, None] + rng.normal(0, 0.02, (25_000, 8, 3))).reshape(-1, 3)
    label = cluster.linked_labels(x, 0.4, "average")
    assert (label == np.repeat(np.arange(0, 200_000, 8), 8)).all()
    with pytest.raises(ValueError, match="linkage"):
        cluster.agglomerate(None, 1.0, "ward")


# -- directions


@pytest.mark.parametrize("n, eps, least", [(40, 0.5, 3), (400, 0.2, 4), (900, 0.06, 5), (300, 1.2, 200)])
def test_directions_brute_force(spark, n, eps, least):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3)) * [1, 1, 0.3]
    x[: n // 3] = x[0] + rng.normal(0, 0.02, (n // 3, 3))  # a crowded cell
    got = {r.point_id: r.label for r in cluster.cluster_directions(cloud(spark, x), eps, least).collect()}
    want = cluster.dbscan_labels(cluster.angular_distances(x - x.mean(axis=0)), eps, least)
    near = cluster.angular_distances(x - x.mean(axis=0)) <= eps
    core = near.sum(axis=1) >= least
    first = {k: int(np.flatnonzero((want == k) & core)[0]) for k in set(want.tolist()) - {-1}}
    for i in range(n):
        assert got[i] == (first[want[i]] if want[i] >= 0 else -1)


def test_directions_edges(spark):
    p = cloud(spark, [(0, 0, 0), (1, 0, 0), (-1, 0, 0)])
    assert {r.point_id: r.label for r in cluster.cluster_directions(p, 0.3, 1).collect()} == {0: -1, 1: 1, 2: 2}
    assert cluster.cluster_directions(p.limit(0), 0.3, 1).collect() == []
    with pytest.raises(ValueError, match="quarter"):
        cluster.cluster_directions(p, 2.0, 1)


# -- farthest points


def test_farthest_rows_look_at_few():
    rng = np.random.default_rng(7)
    t = rng.uniform(0, 2 * np.pi, 30_000)
    x = np.c_[np.cos(t), np.sin(t), rng.uniform(0, 10, 30_000)]
    x[100:200] = x[:100]
    far, at, want = np.full(len(x), np.inf), 0, []
    for _ in range(300):
        want.append(at)
        far = np.minimum(far, ((x - x[at]) ** 2).sum(axis=1))
        at = int(far.argmax())
    seen = []
    assert cluster.farthest_rows(x, 300, seen) == want
    assert sum(seen[100:]) < 0.05 * 200 * len(x)
    assert cluster.farthest_rows(np.ones((4, 3)), 9) == [0, 0, 0, 0] and cluster.farthest_rows(x[:0], 3) == []


def test_merge_candidates_by_cells(spark):
    rng = np.random.default_rng(8)
    x, u, r = rng.uniform(0, 4, (200, 3)), rng.normal(size=(200, 3)), rng.uniform(0.01, 0.4, 200)
    df = spark.createDataFrame([("t", i, *map(float, a), float(q), *map(float, b)) for i, (a, q, b) in enumerate(zip(x, r, u))], "tree_id string, point_id long, x double, y double, z double, radius double, ux double, uy double, uz double")
    for effective in (False, True):
        got = {q.point_id: q.other_id for q in neighbours.merge_candidates(df, df, 0.5, 1.2, effective).collect()}
        want = {}
        for i in range(200):
            d = np.linalg.norm(x - x[i], axis=1)
            d = np.maximum(0, d - r - r[i]) if effective else d
            a = np.arccos(np.clip(u @ u[i] / np.linalg.norm(u, axis=1) / np.linalg.norm(u[i]), -1, 1))
            ok = [(d[j], j) for j in range(200) if j != i and d[j] < 0.5 and a[j] < 1.2]
            if ok:
                want[i] = min(ok)[1]
        assert got == want


# -- growth


def test_used_up_points_brute_force(spark):
    rng = np.random.default_rng(10)
    x = rng.uniform(0, 3, (400, 3))
    spheres = [("t", 1, 1.0, 1.0, 1.0, 0.4), ("t", 2, 2.0, 2.0, 2.0, 0.3)]
    children = [("t", 1, 7, 1.4, 1.0, 1.3, 0.1), ("t", 2, 9, 2.0, 2.6, 2.0, 0.2), ("t", 2, 11, 2.0, 1.5, 2.0, 0.05)]
    s = spark.createDataFrame(spheres, "tree_id string, sphere_id long, x double, y double, z double, radius double")
    c = spark.createDataFrame(children, "tree_id string, sphere_id long, label long, x double, y double, z double, spread double")
    got = {r.point_id for r in growth.used_up(cloud(spark, x), s, c, 0.1).collect()}
    fit, want = qsm.Fit(x, qsm.QsmParams()), set()
    for _, i, *centre, radius in spheres:
        d = np.linalg.norm(x - centre, axis=1)
        want |= set(np.flatnonzero(d <= radius).tolist())
        near = np.flatnonzero(d <= 3 * radius)
        for _, own, _, *end, spread in children:
            if own == i:
                want |= set(near[fit.to_axis(near, np.array(centre), np.array(end), spread) < 0.1].tolist())
    assert got == want and len(want) > 5


def test_rings_of_tilted_circles(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for g in range(4):
        n = rng.normal(size=3)
        n /= np.linalg.norm(n)
        a = np.cross(n, [1.0, 0, 0] if abs(n[0]) < 0.9 else [0, 1.0, 0])
        a /= np.linalg.norm(a)
        t, c, r = rng.uniform(0, 4, 40), rng.uniform(-5, 5, 3), 0.1 + g
        for i, p in enumerate(c + r * (np.cos(t)[:, None] * a + np.sin(t)[:, None] * np.cross(n, a))):
            rows.append(("t", g, i, *map(float, p)))
        want[g] = (*c, r)
    rows += [("t", 9, i, float(i), 0.0, 0.0) for i in range(5)] + [("t", 10, 0, 1.0, 1.0, 1.0)]  # a line, a point: no ring
    df = spark.createDataFrame(rows, "tree_id string, g long, point_id long, x double, y double, z double")
    got = {r.g: (r.x, r.y, r.z, r.r) for r in growth.rings(df, ["tree_id", "g"]).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(v, abs=1e-6) for g, v in want.items())
