"""One test for each finding of round 4 that was right."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendroframe.operators import cluster, growth

P = "tree_id string, point_id long, x double, y double, z double"


def cloud(spark, x, tree="a"):
    return spark.createDataFrame([(tree, i, *map(float, r)) for i, r in enumerate(x)], P)


def cuts(monkeypatch, module):
    """The rows of every table that the module writes to the checkpoint folder."""
    rows, real = [], module.cut

    def counted(df):
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(module, "cut", counted)
    return rows


def test_shells_are_not_written(spark, monkeypatch):
    """the points of all shells were written, which grow with the square of the points. The candidates stay those of the joins, in cells with many spheres and with radii of several levels."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1.0, (400, 3))
    x[:3] = x[3]  # at one place
    p = cloud(spark, x)
    radius = rng.choice([0.3, 0.9, 2.5], 400)
    s = spark.createDataFrame([("a", i, *map(float, x[i]), float(radius[i])) for i in range(400)] + [("a", 900, 0.0, 0.0, 0.0, -1.0), ("a", 901, None, 0.0, 0.0, 1.0), ("b", 902, 0.0, 0.0, 0.0, 1.0)], "tree_id string, sphere_id long, x double, y double, z double, radius double")
    rows = lambda df: {(r.tree_id, r.sphere_id, r.label): (r.n, r.x, r.y, r.z, r.spread) for r in df.collect()}
    want = rows(growth._candidates_by_joins(p, s, np.radians(35), 4, 0.5, growth._hashed))
    assert len(want) > 100
    monkeypatch.setattr(growth, "DEAL", 30)
    made = [*(cuts(monkeypatch, m) for m in (growth, cluster))]
    got = rows(growth.candidates(p, s, 35, 4, 0.5))
    assert sum(map(sum, made)) < 400  # cells, no points of shells
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    monkeypatch.setattr(growth, "AROUND", 200)  # some cells are crowded then
    got = rows(growth.candidates(p, s, 35, 4, 0.5))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_candidates_are_found_once(spark):
    """what spheres became was found twice, once to count fresh points and once for the rows."""
    x = np.random.default_rng(5).normal(0, 0.3, (600, 3))
    found = spark.createDataFrame([("a", 0, 7, 0.3, 0.0, 0.0, 0.1)], "tree_id string, sphere_id long, label long, x double, y double, z double, spread double")
    spheres = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0, 0.2, 0.1, 0.1)], "tree_id string, sphere_id long, x double, y double, z double, radius double, spread double, score double")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    got = growth.accepted(cloud(spark, x), spheres, found.mapInPandas(counted, found.schema)).collect()
    far = lambda c: np.linalg.norm(x - c, axis=1)
    assert [r.fresh for r in got] == [int(((far([0.3, 0, 0]) <= 0.2) & (far([0, 0, 0]) > 0.2)).sum())]
    assert seen.value == 1


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_linkage_keeps_no_pairs(monkeypatch, linkage):
    """all pairs of a component within the threshold were held at once. Ties stay as they were."""
    import tracemalloc

    rng = np.random.default_rng(6)
    for n, x in enumerate([*(rng.integers(0, 5, (120, 3)).astype(float) for _ in range(3)), rng.normal(0, 1, (150, 3))]):
        for t in (0.0, 1.0, 2.0) if n == 3 or linkage == "complete" else (0.0, 1.0):  # of equal means the matrix takes one by rounding
            want = cluster.agglomerative_labels(np.linalg.norm(x[:, None] - x[None], axis=2), t, linkage)
            with monkeypatch.context() as m:
                m.setattr(cluster, "KEPT_PAIRS", 0)
                if n == 3:
                    m.setattr(cluster, "AT_ONCE", 50)
                assert cluster.linked_labels(x, t, linkage).tolist() == [int(np.flatnonzero(want == k)[0]) for k in want], (n, t)
    x = rng.normal(0, 0.3, (2000, 3))  # two million pairs
    tracemalloc.start()
    cluster.linked_labels(x, 2.0, linkage)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_cells_of_a_large_tree_take_little_memory():
    """a tree's cells were told apart by tables of three numbers a point, sorted and compared whole (some 100 bytes a point for a time)."""
    import tracemalloc

    from dendroframe.operators import qsm

    x = np.random.default_rng(7).uniform(-1, 1, (300_000, 3))
    fit = qsm.Fit(x, qsm.QsmParams())
    tracemalloc.start()
    got = fit.grid(0.6)
    assert tracemalloc.get_traced_memory()[1] < 50 * len(x)
    tracemalloc.stop()
    cell = np.floor(x / 0.6).astype(int)
    for c, own in got.items():
        assert own.tolist() == np.flatnonzero((cell == c).all(axis=1)).tolist()
    assert sum(map(len, got.values())) == len(x)
    wide = qsm.Fit(np.array([[0.0, 0, 0], [1e9, 1e9, 1e9], [-1e9, 0, 5]]), qsm.QsmParams()).grid(0.075)  # more cells than a number holds
    assert sorted(v.tolist() for v in wide.values()) == [[0], [1], [2]]
    fit.owner[:] = 3
    fit.owner[[5, 299_999, 77]] = qsm.UNSEGMENTED
    left = np.array([5, 77, 299_999])
    assert fit.first_left(4, 1000) == left[qsm._mixed(left, 4).argmin()]
    fit.owner[:] = 3
    assert fit.first_left(4) is None
