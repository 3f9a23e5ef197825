"""Analytic fixtures, invariants and edge cases of the point-cloud operators."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendroframe.functions import geometry as G
from dendroframe.operators import cluster, grid, hierarchy, neighbours, points, qsm, sampling, stats
from dendroframe.operators.predict import predict

P = "tree_id string, point_id long, x double, y double, z double"
C = "tree_id string, id long, sx double, sy double, sz double, ex double, ey double, ez double, radius double, parent_id long, type string"


def cloud(spark, rows):
    return spark.createDataFrame(rows, P)


def random_cloud(spark, n=120, seed=1, tree="a"):
    v = np.random.default_rng(seed).normal(size=(n, 3))
    return cloud(spark, [(tree, i, *map(float, r)) for i, r in enumerate(v)]), v


def test_cylinder_caps_axis_and_zero_length(spark):
    c = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.5, None, "follow"), ("b", 2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, None, "follow")], C)
    p = cloud(spark, [("a", 0, 1.0, 0.0, 0.5), ("a", 1, 0.0, 0.0, 2.0), ("a", 2, 1.5, 0.0, 2.0), ("a", 3, 0.0, 0.0, 0.5), ("b", 4, 0.0, 2.0, 0.0), ("c", 5, 0.0, 0.0, 0.0)])
    got = {r.point_id: r for r in neighbours.nearest_cylinder(p, c).collect()}
    assert {k: round(r.distance, 9) for k, r in got.items()} == {0: 0.5, 1: 1.0, 2: round(2**0.5, 9), 3: 0.5, 4: 1.5}
    assert (got[0].ox, got[0].oy, got[0].oz) == pytest.approx((-0.5, 0, 0))
    assert 5 not in got  # no cylinder in its tree


def test_ideal_cylinder_offsets(spark):
    p = sampling.ideal_cylinder(spark, 2000)
    c = spark.createDataFrame([("ideal", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 5.0, 0.1, None, "follow")], C)
    j = p.join(neighbours.nearest_cylinder(p, c), ["tree_id", "point_id"])
    worst = j.agg(F.max(F.abs(F.col("dx") - F.col("ox"))), F.max(F.abs(F.col("distance") - F.abs(F.hypot("x", "y") - 0.1)))).first()
    assert max(worst) < 1e-9


@pytest.mark.parametrize("k", [1, 4, 200])
def test_knn_brute_force(spark, k):
    p, v = random_cloud(spark)
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    got = {}
    for r in neighbours.knn(p, p, k).collect():
        got.setdefault(r.point_id, []).append((r.rank, r.other_id))
    for i in range(len(v)):
        assert [o for _, o in sorted(got[i])] == np.lexsort((np.arange(len(v)), d[i]))[:k].tolist()


def test_ball_and_dbscan_brute_force(spark):
    p, v = random_cloud(spark, 150, 2)
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    n = {r.point_id: r.density for r in neighbours.density(p, 0.6).collect()}
    assert n == {i: int((d[i] <= 0.6).sum()) for i in range(len(v))}
    got = {r.point_id: r.label for r in cluster.dbscan(p, 0.6, 5).collect()}
    want = cluster.dbscan_labels(d, 0.6, 5)
    core = (d <= 0.6).sum(axis=1) >= 5
    assert {i for i, x in got.items() if x < 0} == set(np.flatnonzero(want < 0))
    for a in np.flatnonzero(core):
        for b in np.flatnonzero(core):
            assert (got[a] == got[b]) == (want[a] == want[b])


def test_circle_fit_exact_and_degenerate(spark):
    t = np.linspace(0, 5, 30)
    rows = [("c", i, float(3 + 2 * np.cos(a)), float(-1 + 2 * np.sin(a)), 0.0) for i, a in enumerate(t)] + [("line", i, float(i), float(2 * i), 0.0) for i in range(5)] + [("two", i, float(i), 0.0, 0.0) for i in range(2)]
    got = {r.tree_id: r for r in stats.fit_circles(cloud(spark, rows), ["tree_id"]).collect()}
    assert (got["c"].cx, got["c"].cy, got["c"].r) == pytest.approx((3, -1, 2))
    assert got["line"].r is None and got["two"].r is None


def test_power_law(spark):
    df = spark.range(1, 50).select(F.col("id").cast("double").alias("x"), (2 * F.pow("id", F.lit(0.7))).alias("y"))
    r = stats.power_law(df, "x", "y").first()
    assert (r.a, r.b) == pytest.approx((2, 0.7)) and r.b_err == pytest.approx(0, abs=1e-6)


def test_grid_properties(spark):
    p, v = random_cloud(spark, 300, 3)
    m = grid.raster_members(p, 1.0, 1.0)
    assert m.groupBy("point_id").count().filter("count > 1").isEmpty()  # disjoint cells
    vox = grid.voxelise(p, 0.5, [])
    assert vox.agg(F.sum(F.col("mean_x") * F.col("n"))).first()[0] == pytest.approx(v[:, 0].sum())
    s = grid.serialise(p, 0.1)
    assert sorted(r["rank"] for r in s.collect()) == list(range(300))
    assert [r.point_id for r in s.orderBy("rank").collect()] == [r.point_id for r in s.orderBy("code", "point_id").collect()]


def test_morton_and_hilbert_round_trip(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 65536).alias("x"), (F.col("id") * 104729 % 65536).alias("y"), (F.col("id") * 31 % 65536).alias("z"))
    x, y, z = G.morton_decode(F.col("m"))
    bad = df.withColumn("m", G.morton(*G.cols("x", "y", "z"))).filter((x != F.col("x")) | (y != F.col("y")) | (z != F.col("z")))
    assert bad.isEmpty()
    cells = spark.range(512).select(F.col("id"), grid.hilbert_decode(F.col("id"), 3).alias("c")).select("id", "c.*").withColumn("code", grid.hilbert(*G.cols("x", "y", "z"), 3)).orderBy("id").collect()
    assert [r.code for r in cells] == list(range(512)) and len({(r.x, r.y, r.z) for r in cells}) == 512
    assert (np.abs(np.diff([(r.x, r.y, r.z) for r in cells], axis=0)).sum(axis=1) == 1).all()  # neighbours along the curve touch


@pytest.mark.parametrize("bits", [1, 2, 5, 16, 20])
def test_hilbert_walk_is_the_transform(spark, bits):
    df = spark.range(200).select(*((F.abs(F.xxhash64("id", F.lit(i))) % (1 << bits)).alias(c) for i, c in enumerate("xyz"))).withColumn("code", grid.hilbert(*G.cols("x", "y", "z"), bits))
    for r in df.withColumn("back", grid.hilbert_decode(F.col("code"), bits)).collect():
        assert r.code == grid._hilbert(r.x, r.y, r.z, bits) and tuple(r.back) == (r.x, r.y, r.z)


def test_empty_single_and_duplicate_points(spark):
    none = cloud(spark, [])
    for df in (points.centre(none, True), neighbours.density(none, 1.0), neighbours.knn(none, none, 3), grid.voxelise(none, 1.0, []), stats.covariance(none, 3), points.spread(none), cluster.linked_components(none, 1.0)):
        assert df.count() == 0
    one = cloud(spark, [("a", 0, 1.0, 2.0, 3.0)])
    assert points.spread(one).first().spread == 0.01
    assert neighbours.knn(one, one, 3).count() == 1
    assert points.relative_height(one).first().height is None
    twice = cloud(spark, [("a", i, 1.0, 1.0, 1.0) for i in range(4)])
    assert {r.density for r in neighbours.density(twice, 0.1).collect()} == {4}


def test_hierarchy(spark):
    c = spark.createDataFrame([("a", 0, *[0.0] * 5, 1.0, 1.0, None, "follow"), ("a", 1, *[0.0] * 5, 1.0, 5.0, 0, "follow"), ("a", 2, *[0.0] * 5, 1.0, 0.01, 1, "connection"), ("a", 3, *[0.0] * 5, 1.0, 7.0, 99, "follow")], C)
    got = {r.id: (r.radius, r.level) for r in hierarchy.correct_radii(c, 0.33, 1.05).collect()}
    assert got[1] == (pytest.approx(1.05), 1) and got[2] == (pytest.approx(0.3465), 2) and got[3] == (7.0, None)
    only = {r.id: r.radius for r in hierarchy.correct_radii(c, 0.33, 1.05, "connection").collect()}
    assert only[1] == 5.0 and only[2] == pytest.approx(1.65)
    again = {r.id: r.parent_id for r in hierarchy.reroot(c.select("tree_id", "id", "parent_id"), spark.createDataFrame([("a", 2)], "tree_id string, id long")).collect()}
    assert again == {2: None, 1: 2, 0: 1}


def test_components_chain(spark):
    n = cloud(spark, [("a", i, float(i), 0.0, 0.0) for i in range(40)] + [("a", 100, 99.0, 0.0, 0.0)])
    got = {r.point_id: r.component for r in cluster.linked_components(n, 1.0).collect()}
    assert got == {**{i: 0 for i in range(40)}, 100: 100}


def y_tree(n=4000, seed=0):
    rng = np.random.default_rng(seed)

    def limb(a, b, r, k):
        a, b = np.array(a, float), np.array(b, float)
        d = b - a
        u = np.cross(d, [1, 0.3, 0.2])
        u /= np.linalg.norm(u)
        w = np.cross(d / np.linalg.norm(d), u)
        t, f = rng.random(k), rng.random(k) * 2 * np.pi
        return a + t[:, None] * d + r * (np.cos(f)[:, None] * u + np.sin(f)[:, None] * w)

    return np.concatenate([limb((0, 0, 0), (0, 0, 2), 0.12, n // 2), limb((0, 0, 2), (0.8, 0, 3.2), 0.08, n // 4), limb((0, 0, 2), (-0.8, 0, 3.2), 0.08, n // 4)])


def test_qsm_invariants_and_determinism(spark):
    v = y_tree()
    df = cloud(spark, [("y", i, *map(float, r)) for i, r in enumerate(v)])
    rows = [qsm.fit_qsm(df.repartition(k)).collect() for k in (1, 5)]
    a, b = (sorted((r.id, round(r.sx, 9), round(r.radius, 9), r.parent_id or -1) for r in x) for x in rows)
    assert a == b and len(a) > 5
    by = {r.id: r for r in rows[0]}
    assert all(r.error is None for r in rows[0])
    for r in rows[0]:
        assert r.volume == pytest.approx(np.pi * r.radius**2 * r.length)
        seen, at = set(), r
        while at.parent_id is not None:  # no circles
            assert at.id not in seen
            seen.add(at.id)
            at = by[at.parent_id]
    assert sum(r.parent_id is None for r in rows[0]) <= 3
    assert max(r.ez for r in rows[0]) > 2.5  # the branches are reached
    assert qsm.fit_qsm(cloud(spark, [("e", 0, 0.0, 0.0, 0.0)])).count() == 0


def test_predictors_and_pipeline(spark):
    from dendroframe.plans.pipeline import Config, run

    v = y_tree(1500)
    df = cloud(spark, [("y", i, *map(float, r)) for i, r in enumerate(v)])
    assert predict(df, "statistical").count() <= 1500
    with pytest.raises(ValueError):
        predict(df, "nothing")
    out = run(df, Config.of({"general": {}, "stage2": {"min_points": 2900, "k_init": 5}, "stage3": {"qsm_params": {"eps_deg": 20}}}))
    assert out["dense"].count() == 3000
    assert out["cylinders"].count() > 3
    with pytest.raises(ValueError):
        Config.of({"stage3": {"qsm_params": {"nothing": 1}}})


def test_upsample_modes(spark):
    p, _ = random_cloud(spark, 50, 4)
    assert sampling.upsample(p, 5, 2, True).count() == 150
    assert sampling.upsample(p, 5, 2, False).count() == 200
    assert sampling.upsample(p, 60, 1).count() == 50  # fewer than k points
    u = sampling.upsample(p, 5, 2, False)
    assert u.select("point_id").distinct().count() == 200


def test_ball_query_falls_back_to_nearest(spark):
    c = cloud(spark, [("a", 0, 0.0, 0.0, 0.0), ("a", 1, 50.0, 0.0, 0.0)])
    p = cloud(spark, [("a", 10, 0.1, 0.0, 0.0), ("a", 11, 0.2, 0.0, 0.0), ("a", 12, 40.0, 0.0, 0.0)])
    got = sorted((r.point_id, r.slot, r.other_id) for r in neighbours.ball_query(c, p, 1.0, 3).collect())
    assert got == [(0, 0, 10), (0, 1, 11), (0, 2, 10), (1, 0, 12), (1, 1, 12), (1, 2, 12)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_qsm_fit_query_takes_all_cylinders(spark):
    from dendroframe.plans import fixtures, registry

    sf = "/root/testdata/sf0.001"
    cloud_of = sampling.noisy_cloud(fixtures.cylinders(spark, sf), mu=-6.0, sigma=0.3).withColumn("point_id", F.xxhash64("x", "y", "z")).toPandas()
    assert cloud_of.cylinder_id.nunique() == fixtures.cylinders(spark, sf).count() == 200
    got = registry.QUERIES["qsm_fit"](spark, sf).toPandas()
    for tree, part in cloud_of.groupby("tree_id"):
        fit = qsm.Fit(part.sort_values("point_id")[["x", "y", "z"]].to_numpy(), qsm.QsmParams())
        fit.run()
        want = fit.cylinders()
        mine = got[got.tree_id == tree].sort_values("id")
        assert mine[["id", "sx", "sy", "sz", "ex", "ey", "ez", "radius"]].to_numpy() == pytest.approx(want[["id", "sx", "sy", "sz", "ex", "ey", "ez", "radius"]].to_numpy())


@pytest.mark.parametrize("angular", [True, False])
def test_dbscan_points_is_the_matrix_form(angular):
    rng = np.random.default_rng(4)
    for trial in range(12):
        n = int(rng.integers(1001, 1300))
        x = rng.normal(size=(n, 3)) if trial % 2 else rng.normal(size=(6, 3))[rng.integers(0, 6, n)] + rng.normal(0, rng.uniform(0.02, 0.3), (n, 3))
        eps = [0.05, 0.15, 0.35, 1.0][trial % 4]
        d = cluster.angular_distances(x) if angular else np.linalg.norm(x[:, None] - x[None], axis=2)
        assert cluster.dbscan_points(x, eps, 5, angular).tolist() == cluster.dbscan_labels(d, eps, 5).tolist()


def test_dense_shell_is_clustered_whole():
    rng = np.random.default_rng(5)
    ray = lambda d, n, w: np.array(d) * rng.uniform(0.31, 0.39, (n, 1)) + rng.normal(0, w, (n, 3))
    v = np.concatenate([ray((0.0, 0, 1), 12000, 0.01), ray((1.0, 0, 0), 8, 0.005)])  # a thick branch and a thin one
    fit = qsm.Fit(v, qsm.QsmParams())
    s = qsm.Sphere(np.zeros(3), 0.4, 0.1, 0.1, 0, np.array([0.0, 0, 1]))
    groups = fit.shell_groups(s, np.arange(len(v)))
    assert [g.tolist() for g in groups] == [list(range(12000)), list(range(12000, 12008))]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_spheres_and_balls_over_all_points(spark):
    from dendroframe.plans import fixtures, registry

    sf = "/root/testdata/sf0.001"
    p = fixtures.points(spark, sf).select("tree_id", "point_id", "x", "y", "z").toPandas()
    balls = {(r.tree_id, r.point_id, r.slot): r.other_id for r in registry.QUERIES["ball_query_all"](spark, sf).collect()}
    spheres = {(r.tree_id, r.sphere_id, r.point_id): (r.d, r.shell) for r in registry.QUERIES["sphere_assignment_all"](spark, sf).collect()}
    want_balls, want_spheres = {}, {}
    for tree, part in p.sort_values("point_id").groupby("tree_id"):
        ids, v = part.point_id.tolist(), part[["x", "y", "z"]].to_numpy()
        d = np.linalg.norm(v[:, None] - v[None], axis=2)
        for i, a in enumerate(ids):
            inside = [b for b, x in zip(ids, d[i]) if x <= 1.5]
            for slot in range(4):
                want_balls[tree, a, slot] = inside[slot] if slot < len(inside) else inside[0]
            for b, x in zip(ids, d[i]):
                if x <= 1.5:
                    want_spheres[tree, a, b] = (x, x > 0.5)
    assert balls == want_balls and {k[1] for k in balls} == set(p.point_id)
    assert spheres.keys() == want_spheres.keys() and {k[1] for k in spheres} == set(p.point_id)
    assert all(spheres[k][0] == pytest.approx(x, abs=1e-6) and spheres[k][1] == shell for k, (x, shell) in want_spheres.items())
