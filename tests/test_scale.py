"""Operators at sizes where their plain forms would not do, against those forms; and rules that no query shows."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendroframe.functions import geometry as G
from dendroframe.operators import cluster, evaluation, grid, hierarchy, neighbours, predict, qsm, sampling, stats
from dendroframe.sources import sinks

P = "tree_id string, point_id long, x double, y double, z double"
C = "tree_id string, id long, sx double, sy double, sz double, ex double, ey double, ez double, radius double"


def surface(spark, n, tree="a", seed=0):
    """Points of a thin bent tube: a surface in a large box, with one stray point."""
    rng = np.random.default_rng(seed)
    t, a = rng.random(n) * 20, rng.random(n) * 2 * np.pi
    v = np.c_[np.cos(a) * 0.2 + np.sin(t), np.sin(a) * 0.2, t]
    v[0] = (40, 40, 40)
    return spark.createDataFrame([(tree, i, *map(float, r)) for i, r in enumerate(v)], P), v


# -- hierarchies


def test_a_chain_deeper_than_one_band(spark):
    n = 150
    rng = np.random.default_rng(1)
    radius = rng.uniform(0.01, 1, n)
    rows = [("a", i, float(radius[i]), i - 1 if i else None, "connection" if i % 3 else "follow") for i in range(n)]
    rows += [("a", 1000 + i, 0.5, 10 * i, "follow") for i in range(15)] + [("a", 2000, 0.3, 2001, "follow"), ("a", 2001, 0.3, 2000, "follow"), ("a", 3000, 9.0, 4000, "follow"), ("b", 0, 1.0, None, "follow")]
    df = spark.createDataFrame(rows, "tree_id string, id long, radius double, parent_id long, type string")
    for only in (None, "connection"):
        want, parents = {}, {(t, i): (r, p, k) for t, i, r, p, k in rows}

        def fixed(t, i):
            if (t, i) not in want:
                r, p, kind = parents[t, i]
                if p is None:
                    want[t, i] = r
                else:
                    up = fixed(t, p)
                    want[t, i] = max(min(r, up * 1.05), up * 0.33) if only in (None, kind) else r
            return want[t, i]

        for t, i, *_ in rows:
            if i not in (2000, 2001, 3000):
                fixed(t, i)
        got = {(r.tree_id, r.id): (r.radius, r.level) for r in hierarchy.correct_radii(df, 0.33, 1.05, only).collect()}
        assert len(got) == len(rows)
        assert all(got["a", i] == (parents["a", i][0], None) for i in (2000, 2001, 3000))  # circles, and what hangs on nothing
        assert all(got[k][0] == pytest.approx(v) for k, v in want.items())
        assert got["a", 149][1] == 149 and got["a", 1014][1] == 141


def test_reroot_of_a_long_chain(spark):
    rows = [("a", i, i - 1 if i else None) for i in range(90)] + [("a", 200 + i, i) for i in range(0, 90, 7)] + [("b", 5, None), ("b", 6, 5)]
    df = spark.createDataFrame(rows, "tree_id string, id long, parent_id long")
    new = spark.createDataFrame([("a", 60), ("b", 6)], "tree_id string, id long")
    near: dict = {}
    for t, i, p in rows:
        if p is not None:
            near.setdefault((t, i), []).append(p)
            near.setdefault((t, p), []).append(i)
    want = {}
    for root in (("a", 60), ("b", 6)):
        queue = [(root, None, 0)]
        for at, parent, level in queue:
            want[at] = (parent, level)
            queue += [((at[0], x), at[1], level + 1) for x in near[at] if (at[0], x) not in want]
    assert {(r.tree_id, r.id): (r.parent_id, r.level) for r in hierarchy.reroot(df, new).collect()} == want


# -- neighbours


def test_knn_on_a_surface_settles_in_rounds(spark, monkeypatch):
    p, v = surface(spark, 3000)
    pairs = []
    plain = neighbours._nearest
    monkeypatch.setattr(neighbours, "_nearest", lambda x, k: (pairs.append(x.count()), plain(x, k))[1])
    got: dict = {}
    for r in neighbours.knn(p, p, 6).collect():
        got.setdefault(r.point_id, []).append((r.rank, r.other_id))
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    for i in range(len(v)):
        assert [o for _, o in sorted(got[i])] == np.lexsort((np.arange(len(v)), d[i]))[:6].tolist()
    assert len(pairs) > 2 and sum(pairs) < 150 * len(v)  # far below the 3,000 pairs a point of the plain form


def test_nearest_cylinder_in_cells(spark):
    rng = np.random.default_rng(2)
    p, v = surface(spark, 1200)
    s = np.c_[np.sin(np.linspace(0, 20, 400)), rng.normal(0, 0.1, 400), np.linspace(0, 20, 400)]
    e = s + rng.normal(0, 0.3, (400, 3))
    e[7] = s[7]  # no length
    radius = rng.uniform(0.02, 0.3, 400)
    radius[3] = 2.5
    c = spark.createDataFrame([("a", i, *map(float, (*a, *b, r))) for i, (a, b, r) in enumerate(zip(s, e, radius))] + [("b", 1, *[0.0] * 5, 1.0, 0.5)], C)
    both = p.union(spark.createDataFrame([("b", 0, 1.0, 1.0, 1.0), ("c", 0, 0.0, 0.0, 0.0)], P))
    t = neighbours._terms(1e-3)
    best = F.min(F.struct(t["distance"].alias("distance"), F.col("id").alias("cylinder_id"), *(t[k].alias(k) for k in ("ox", "oy", "oz")))).alias("m")
    every = both.join(neighbours._with_axis(c), "tree_id").groupBy("tree_id", "point_id").agg(best).select("tree_id", "point_id", "m.cylinder_id", "m.distance", "m.ox", "m.oy", "m.oz")
    plain = {(r.tree_id, r.point_id): tuple(r)[2:] for r in every.collect()}
    cells = {(r.tree_id, r.point_id): tuple(r)[2:] for r in neighbours.nearest_cylinder(both, c).collect()}
    assert plain.keys() == cells.keys() and len(plain) == 1201
    for k, x in plain.items():
        assert cells[k][0] == x[0] and cells[k][1:] == pytest.approx(x[1:], abs=1e-9), k
    near = {(r.tree_id, r.point_id) for r in neighbours.near_cylinders(both, c, 0.1).collect()}
    assert near == {k for k, x in plain.items() if x[1] < 0.1}


def test_points_meet_few_cylinders(spark):
    """Of 2,000 cylinders along a tree's branches, a point on them meets a few hundredths."""
    rng = np.random.default_rng(9)
    start = rng.uniform(-4, 4, (2000, 3))
    end = start + rng.normal(0, 0.08, (2000, 3))
    at = rng.integers(0, 2000, 4000)
    x = start[at] + rng.uniform(0, 1, (4000, 1)) * (end - start)[at] + rng.normal(0, 0.03, (4000, 3))
    c = spark.createDataFrame([("a", i, *map(float, (*s, *e, 0.03))) for i, (s, e) in enumerate(zip(start, end))], C)
    p = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(x)], P)
    assert neighbours.met_cylinders(p, c).count() < 4000 * 2000 * 0.03


# -- grids


def test_rasters_from_metadata(spark):
    p, v = surface(spark, 400)
    boxes = [("a", 0, -1.0, -1.0, 0.0, 1.0, 1.0, 5.0), ("a", 1, -1.0, -1.0, 4.0, 0.5, 0.1, 9.0), ("a", 2, 40.0, 40.0, 40.0, 41.0, 41.0, 41.0), ("a", 3, 5.0, 5.0, 5.0, 6.0, 6.0, 6.0), ("b", 0, -9.0, -9.0, -9.0, 99.0, 99.0, 99.0)]
    m = spark.createDataFrame(boxes, "tree_id string, raster_id int, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    got = {(r.point_id, r.raster_id) for r in grid.extract_rasters(p, m).collect()}
    assert got == {(i, b[1]) for i, x in enumerate(v) for b in boxes if b[0] == "a" and all(b[2 + k] <= x[k] < b[5 + k] for k in range(3))}


def test_curve_orders(spark):
    p, _ = surface(spark, 200)
    coded = grid.serialise_all(p.filter("point_id > 0"), 0.5, 8)
    rows = coded.collect()
    for i in range(len(grid.ORDERS)):
        order = sorted(rows, key=lambda r: (r[f"code_{i}"], r.point_id))
        assert [r[f"rank_{i}"] for r in order] == list(range(199))
        places = {r.place: r.point_id for r in grid.order_of(coded, f"rank_{i}").collect()}
        assert [places[k] for k in range(199)] == [r.point_id for r in order]
    with pytest.raises(ValueError):
        grid.curve_code(F.lit(1), F.lit(1), F.lit(1), "peano")


# -- statistics, evaluation, splits


def test_bin_centres_and_log_edges(spark):
    assert stats.bin_centres([0, 2, 4, float("inf")]) == [1, 3, None] and stats.bin_centres([1, 4, 9], True) == [2, 6]
    edges = stats.log_edges(0.003, 3.0)
    assert edges == pytest.approx(sorted(r.edge for r in stats.log_bins(spark, 0.003, 3.0).collect()))


def test_slice_report_and_offset_bins_of_little(spark):
    v = [("a", 0, 21.0, -22.0, 8.5), ("a", 1, 21.5, -22.0, 8.5), ("a", 2, 0.0, 0.0, 0.0), ("b", 0, 22.0, -20.7, -2.7)]
    p = spark.createDataFrame(v, P).withColumns({c: F.lit(0.0) for c in ("dx", "dy", "dz")})
    got = {(r.tree_id, r.slice): (r.n, r.mean_a, r.mean_b) for r in evaluation.slice_report(p).collect()}
    assert got == {("a", 1): (2, 0.5, 0.5), ("b", 0): (1, None, None)}
    one = spark.createDataFrame([(0.0, 1.0)], "a double, b double")
    assert sum(r.n for r in evaluation.offset_bins(one, "a", "b").collect()) == 0
    assert evaluation.tree_comparison(p.withColumn("distance", F.lit(2.0)), p.withColumn("distance", F.lit(0.5)).filter("tree_id = 'a'")).first().gain == 1.5


def test_splits_of_rasters(spark):
    m = spark.createDataFrame([(f"{i % 3}_{i}", k) for i in range(20) for k in range(i % 4 + 1)], "tree_id string, raster_id long")
    got = sampling.split_rasters(m, lambda c: F.substring_index(c, "_", -1).cast("long")).collect()
    assert {r.tree_id for r in got if r.split == "test"} == {"0_0", "1_1", "2_2"} and len(got) == m.count()
    assert {r.plot for r in got} == {"0", "1", "2"}
    assert {r.tree_id for r in sampling.first_trees(m, 2).collect()} == {"0_0", "0_12"}
    assert sampling.split_plots(spark.createDataFrame([], "tree_id string")).count() == 0


# -- clusters and models


def test_single_linkage_is_components(spark):
    p, v = surface(spark, 150, seed=3)
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    want = cluster.agglomerative_labels(d, 0.7, "single", 3)
    got = [r.label for r in cluster.agglomerate(p, 0.7, "single", 3).orderBy("point_id").collect()]
    assert [x < 0 for x in got] == [x < 0 for x in want]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(150) for j in range(150) if want[i] >= 0 and want[j] >= 0)


def test_outer_spheres(spark):
    s = spark.createDataFrame([("a", 0, None, 0.0), ("a", 1, 0, 1.0), ("a", 2, 1, 2.0), ("a", 3, 1, 2.0), ("b", 0, 1, 5.0), ("b", 1, 0, 4.0)], "tree_id string, sphere_id long, parent_id long, z double")
    assert sorted(map(tuple, qsm.outer_spheres(s).collect())) == [("a", 2), ("a", 3), ("b", 1)]  # in b each grew from the other: the lowest


def test_final_merge_goes_on_over_new_outer_spheres():
    up = np.array([0.0, 0, 1])
    fit = qsm.Fit(np.zeros((1, 3)), qsm.QsmParams(max_dist=1.0))
    sphere = lambda z, c: qsm.Sphere(np.array([0.0, 0, z]), 0.3, 0.1, 0.1, c, up)
    for s in (sphere(0, 0), sphere(0.5, 0), sphere(1.0, 0), sphere(1.8, 1), sphere(2.3, 1), sphere(3.1, 2), sphere(9.0, 3)):
        fit.add(s)
    fit.edges = [(0, 1, 0.1, "follow"), (1, 2, 0.1, "follow"), (3, 4, 0.1, "follow")]
    for i in (0, 1, 3):
        fit.spheres[i].outer = False
    fit.spheres[3].outer = True  # the branch's near end
    fit.merge_all()
    assert [s.cluster for s in fit.spheres] == [0, 0, 0, 0, 0, 0, 3]  # 2 is in reach of 1 only
    assert [e[:2] for e in fit.edges if e[3] == "connection"] == [(2, 3), (4, 5)]
    assert not fit.spheres[2].outer and fit.outer(3) == [6]


def test_models_by_plot_and_augmentation(spark, tmp_path):
    os.makedirs(tmp_path / "o")
    os.makedirs(tmp_path / "n")
    np.savez(tmp_path / "o" / "best_3.npz", w=np.eye(3) * 0.1)
    np.savez(tmp_path / "n" / "best_4.npz", b=np.array([0.0, 1.0]))
    files = predict.weight_files(str(tmp_path / "o"), str(tmp_path / "n"))
    assert sorted(files) == ["N_4", "O_3"]
    w, b = predict.load_weights(files["O_3"])["w"], predict.load_weights(files["N_4"])["b"]
    models = {"O_3": lambda x: x @ w, "N_4": lambda x: np.tile(b, (len(x), 1))}
    p = spark.createDataFrame([("3_1", 0, 1.0, 2.0, 3.0), ("4_1", 0, 1.0, 2.0, 3.0)], P)
    same = predict.array_predictor(lambda x: (x @ w, np.zeros((len(x), 2))))(p).filter("tree_id = '3_1'").first()
    assert same.dx == pytest.approx(0.1)
    got = {r.tree_id: r for r in predict.plot_predictor(models)(p).collect()}
    assert (got["3_1"].dx, got["3_1"].l0) == (pytest.approx(0.1), 1.0) and (got["4_1"].dx, got["4_1"].l1) == (0.0, 1.0)
    full = p.withColumns({"dx": F.lit(0.5), "dy": F.lit(0.0), "dz": F.lit(0.1)})
    one, two = (sorted(map(tuple, predict.augment(full, predict.turned(), 7).collect())) for _ in range(2))
    assert one == two and one[0][2:5] != (1.0, 2.0, 3.0)
    assert np.hypot(*one[0][5:7]) / one[0][7] == pytest.approx(5.0) and one[0][4] / one[0][7] == pytest.approx(30.0)


# -- sinks, labels


def test_files_from_tasks_and_colours(spark, tmp_path):
    files = spark.createDataFrame([("a.bin", bytearray(b"1")), ("b.bin", bytearray(b"22")), ("c.bin", bytearray(b""))], "name string, content binary").repartition(3)
    assert sinks.write_files(files, str(tmp_path / "out")) == 3
    assert {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(tmp_path / "out") if not n.startswith(".")} == {"a.bin": b"1", "b.bin": b"22", "c.bin": b""}
    assert sinks.write_files(files.limit(0), f"file://{tmp_path}/none") == 0
    c = spark.createDataFrame([("t", 0, *[0.0] * 5, 1.0, 0.5, None, "follow"), ("t", 1, *[0.0] * 5, 1.0, 0.2, 0, "connection")], C + ", parent_id long, type string")
    for by, has in (("root", (b"255 0 0", b"140 89 38")), ("type", (b"255 0 0", b"0 153 0")), ("radius", (b"255 0 0", b"0 0 255"))):
        raw = bytes(sinks.mesh_files(c, by=by).first().content)
        assert all(x in raw for x in has), by
    s = spark.createDataFrame([("t", 0.0, 0.0, 0.0, 1.0, True), ("t", 0.0, 0.0, 1.0, 2.0, False)], "tree_id string, x double, y double, z double, radius double, is_outer boolean")
    assert b"127 127 127" in bytes(sinks.sphere_files(s).first().content) and b"255 0 0" in bytes(sinks.sphere_files(s, "radius").first().content)
    assert json.loads(sinks.qsm_set_json(spark.createDataFrame([("b",), ("a",)], "path string")).first().value) == ["a", "b"]


def test_labels_and_views(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (15.0,), (20.0,), (21.0,)], "v double")
    assert [r[0] for r in df.select(G.tick_label(F.col("v"))).collect()] == ["0.00", "0.05", "0.10", "0.55", "1.00", "inf"]
    first = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0, *[1.0] * 3, 0.1, 1), ("a", 1, 5.0, 0.0, 2.0, *[1.0] * 3, 0.1, 0), ("a", 2, float("nan"), 0.0, -9.0, *[1.0] * 3, 0.1, 0)], C + ", branch_order int")
    assert tuple(stats.model_base(first, "branch_order").first())[1:] == (5.0, 0.0, 2.0) and tuple(stats.model_base(first).first())[1:] == (0.0, 0.0, 0.0)
