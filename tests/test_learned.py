"""Trained layers against plain NumPy: sparse convolutions, attention, set abstraction, and training."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendroframe.functions.geometry import morton
from dendroframe.operators import abstraction, attention, grid, layers, training


def code(v):
    return sum(((int(v[k]) >> i) & 1) << (3 * i + 2 - k) for i in range(layers.DEPTH) for k in range(3))


def voxels_of(spark, cells, feats, tree="a"):
    return spark.createDataFrame([(tree, code(v), [float(x) for x in f]) for v, f in zip(cells, feats)], "tree_id string, code long, feat array<double>").repartition(3)


def cells_of(rng, n, span):
    return np.unique(rng.integers(0, span, (n, 3)), axis=0)


def plain_conv(cells, feats, w):
    at = {tuple(v): f for v, f in zip(cells, feats)}
    k = w.shape[1] // 2
    out = np.zeros((len(cells), len(w)))
    for i, v in enumerate(cells):
        for z in range(-k, k + 1):
            for y in range(-k, k + 1):
                for x in range(-k, k + 1):
                    f = at.get((v[0] + x, v[1] + y, v[2] + z))
                    if f is not None:
                        out[i] += w[:, z + k, y + k, x + k] @ f
    return out


def features_by_code(df):
    return {(r.tree_id, r.code): np.array(r.feat) for r in df.collect()}


@pytest.mark.parametrize("kernel, span", [(3, 20), (5, 9)])
def test_sub_conv_is_a_dense_convolution(spark, kernel, span):
    """Over tile borders, at cell 0 and at the grid's far end; two trees with the same cells stay apart."""
    rng = np.random.default_rng(kernel)
    cells = cells_of(rng, 400, span)
    cells = np.concatenate([cells, cells[:40] + 2**layers.DEPTH - span])
    feats, w = rng.normal(size=(len(cells), 3)), rng.normal(size=(4, kernel, kernel, kernel, 3))
    both = voxels_of(spark, cells, feats).unionByName(voxels_of(spark, cells[:5], feats[:5], "b"))
    got = features_by_code(layers.sub_conv(both, layers.rulebook(both, kernel), w, np.arange(4)))
    assert len(got) == len(cells) + 5
    for tree, n in (("a", len(cells)), ("b", 5)):
        for v, f in zip(cells[:n], plain_conv(cells[:n], feats[:n], w)):
            assert got[tree, code(v)] == pytest.approx(f + np.arange(4))


def test_strided_and_inverse_convolutions(spark):
    rng = np.random.default_rng(1)
    cells = cells_of(rng, 60, 7)
    feats, w, back = rng.normal(size=(len(cells), 2)), rng.normal(size=(3, 2, 2, 2, 2)), rng.normal(size=(2, 2, 2, 2, 3))
    down = {}
    for v, f in zip(cells, feats):
        down[tuple(v // 2)] = down.get(tuple(v // 2), 0) + w[:, v[2] % 2, v[1] % 2, v[0] % 2] @ f
    fine = voxels_of(spark, cells, feats)
    coarse = layers.down_conv(fine, w)
    got = features_by_code(coarse)
    assert {k: v for (_, k), v in got.items()} == {code(v): pytest.approx(f) for v, f in down.items()}
    up = features_by_code(layers.up_conv(coarse, fine, back))
    for v in cells:
        assert up["a", code(v)] == pytest.approx(back[:, v[2] % 2, v[1] % 2, v[0] % 2] @ down[tuple(v // 2)])


def test_rulebook_joins_each_pair_once(spark):
    cells = cells_of(np.random.default_rng(2), 200, 8)
    rules = layers.rulebook(voxels_of(spark, cells, np.ones((len(cells), 1)))).collect()
    near = [(code(a), code(b)) for a in cells for b in cells if np.abs(a - b).max() <= 1]
    assert sorted((r.code, r.source) for r in rules) == sorted(near)
    assert layers.rulebook(voxels_of(spark, cells[:0], cells[:0])).collect() == []


def norm_weights(rng, name, n):
    return {f"{name}.weight": rng.normal(size=n), f"{name}.bias": rng.normal(size=n)}


def test_transformer_block(spark):
    rng = np.random.default_rng(3)
    c, heads, size = 4, 2, 16
    cells = cells_of(rng, 60, 6)
    feats = rng.normal(size=(len(cells), c))
    w = {"b.cpe.0.weight": rng.normal(size=(c, 3, 3, 3, c)) / 5, "b.cpe.0.bias": rng.normal(size=c), "b.cpe.1.weight": rng.normal(size=(c, c)), "b.cpe.1.bias": rng.normal(size=c)}
    w |= norm_weights(rng, "b.cpe.2", c) | norm_weights(rng, "b.norm1.0", c) | norm_weights(rng, "b.norm2.0", c)
    w |= {"b.attn.qkv.weight": rng.normal(size=(3 * c, c)), "b.attn.qkv.bias": rng.normal(size=3 * c), "b.attn.proj.weight": rng.normal(size=(c, c)), "b.attn.proj.bias": rng.normal(size=c)}
    w |= {"b.attn.rpe.rpe_table": rng.normal(size=(3 * (2 * attention.position_bound(size) + 1), heads))}
    w |= {"b.mlp.0.fc1.weight": rng.normal(size=(8, c)), "b.mlp.0.fc1.bias": rng.normal(size=8), "b.mlp.0.fc2.weight": rng.normal(size=(c, 8)), "b.mlp.0.fc2.bias": rng.normal(size=c)}
    rank = rng.permutation(len(cells))
    rows = [("a", int(i), code(v), *map(int, v), int(k), [float(x) for x in f]) for i, (v, k, f) in enumerate(zip(cells, rank, feats))]
    df = spark.createDataFrame(rows, "tree_id string, point_id long, code long, vx long, vy long, vz long, rank_0 long, feat array<double>").repartition(3)
    got = {r.point_id: np.array(r.feat) for r in attention.transformer_stage(df, layers.rulebook(df), {k.replace("b.", "s.block0.", 1): v for k, v in w.items()}, "s", 1, heads, size, (0,)).collect()}

    ln = lambda x, n: (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * w[f"{n}.weight"] + w[f"{n}.bias"]
    x = feats + ln((plain_conv(cells, feats, w["b.cpe.0.weight"]) + w["b.cpe.0.bias"]) @ w["b.cpe.1.weight"].T + w["b.cpe.1.bias"], "b.cpe.2")
    qkv = ln(x, "b.norm1.0") @ w["b.attn.qkv.weight"].T + w["b.attn.qkv.bias"]
    order, mixed, bound = np.argsort(rank), np.zeros_like(x), attention.position_bound(size)
    starts = list(range(0, len(cells), size))
    for s in starts:
        members = order[s : s + size] if s + size <= len(cells) else order[-size:]  # the last patch borrows
        for i in order[s : s + size]:
            for h in range(heads):
                cut_ = lambda part, j: qkv[j, part * c + h * 2 : part * c + h * 2 + 2]  # noqa: B023, E731
                bias = [sum(w["b.attn.rpe.rpe_table"][np.clip(cells[i][a] - cells[j][a], -bound, bound) + bound + a * (2 * bound + 1), h] for a in range(3)) for j in members]
                e = np.exp([cut_(0, i) @ cut_(1, j) / math.sqrt(2) + b for j, b in zip(members, bias)])
                mixed[i, h * 2 : h * 2 + 2] = (e / e.sum()) @ np.array([cut_(2, j) for j in members])
    x = x + mixed @ w["b.attn.proj.weight"].T + w["b.attn.proj.bias"]
    y = ln(x, "b.norm2.0") @ w["b.mlp.0.fc1.weight"].T + w["b.mlp.0.fc1.bias"]
    y = 0.5 * y * (1 + np.vectorize(math.erf)(y / math.sqrt(2)))
    x = x + y @ w["b.mlp.0.fc2.weight"].T + w["b.mlp.0.fc2.bias"]
    for i in range(len(cells)):
        assert got[i] == pytest.approx(x[i])


def test_short_trees_have_one_patch(spark):
    w = {"a.qkv.weight": np.eye(6, 2), "a.proj.weight": np.eye(2)}
    rows = [("a", i, 0, 0, i, i, [1.0, float(i)]) for i in range(3)] + [("b", 7, 0, 0, 0, 0, [2.0, 3.0])]
    df = spark.createDataFrame(rows, "tree_id string, point_id long, vx long, vy long, vz long, rank long, feat array<double>")
    got = {(r.tree_id, r.point_id): r.feat for r in attention.patch_attention(df, w, "a", 1, 8).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 7)}
    assert attention.patch_attention(df.limit(0), w, "a", 1, 8).collect() == []


def test_abstraction_at_several_scales_and_of_all_points(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 4, (60, 3))
    f = rng.normal(size=(60, 2))
    df = spark.createDataFrame([("t", i, *map(float, x), [float(v) for v in y]) for i, (x, y) in enumerate(zip(p, f))], "tree_id string, point_id long, x double, y double, z double, feat array<double>")
    n = lambda name, c: {f"{name}.weight": rng.normal(size=c), f"{name}.bias": rng.normal(size=c), f"{name}.running_mean": rng.normal(size=c), f"{name}.running_var": rng.uniform(1, 2, c)}
    w = {}
    for head, norms in (("m.conv_blocks.0", "m.bn_blocks.0"), ("m.conv_blocks.1", "m.bn_blocks.1"), ("g.mlp_convs", "g.mlp_bns")):
        w |= {f"{head}.0.weight": rng.normal(size=(3, 5, 1, 1)), f"{head}.0.bias": rng.normal(size=3), **n(f"{norms}.0", 3)}

    def layer(x, head, norms):
        y = x @ w[f"{head}.0.weight"][:, :, 0, 0].T + w[f"{head}.0.bias"]
        return np.maximum(0, (y - w[f"{norms}.0.running_mean"]) / np.sqrt(w[f"{norms}.0.running_var"] + 1e-5) * w[f"{norms}.0.weight"] + w[f"{norms}.0.bias"])

    scales = [(0.05, 4), (1.5, 6)]  # the first is too short for any other point
    got = abstraction.set_abstraction_scales(df, w, "m", 5, scales).collect()
    assert len(got) == 5
    for r in got:
        d, want = np.linalg.norm(p - p[r.point_id], axis=1), []
        for i, (radius, most) in enumerate(scales):
            near = np.flatnonzero(d <= radius)[:most]
            want += layer(np.concatenate([f[near], p[near] - p[r.point_id]], axis=1), f"m.conv_blocks.{i}", f"m.bn_blocks.{i}").max(axis=0).tolist()
        assert r.feat == pytest.approx(want)
    whole = abstraction.set_abstraction_all(df, w, "g").collect()
    assert len(whole) == 1 and whole[0].feat == pytest.approx(layer(np.concatenate([p, f], axis=1), "g.mlp_convs", "g.mlp_bns").max(axis=0))


# -- training


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    target = np.stack([x[:, 0] - x[:, 1], x[:, 2] * 0.5, np.abs(x[:, 0])], axis=1) + rng.normal(scale=0.05, size=(300, 3))
    label = (x[:, 0] + x[:, 2] > 0).astype(int)
    return x, target, label, label == 0


def as_df(spark, sets, rows, parts):
    x, t, y, m = (a[rows] for a in sets)
    data = [([float(v) for v in a], *map(float, b), int(c), bool(d)) for a, b, c, d in zip(x, t, y, m)]
    return spark.createDataFrame(data, "feat array<double>, dx double, dy double, dz double, label int, mask boolean").repartition(parts)


def plain_run(sets, hidden, how, p):
    """One process, derivatives by differences of the loss."""
    x, t, y, mask = sets
    model = training.Dense([3, *hidden, 5])

    def loss(p, rows):
        out = model.forward(p, x[rows])[-1]
        lse = np.log(np.exp(out[:, 3:]).sum(axis=1))
        ce = (lse - out[np.arange(len(out)), 3 + y[rows]]).mean()
        return ce + np.sqrt(np.maximum(((out[:, :3] - t[rows]) ** 2).sum(axis=1), 1e-8))[mask[rows]].mean()

    train, val, m, v, curve = np.arange(240), np.arange(240, 300), np.zeros_like(p), np.zeros_like(p), []
    for e in range(how.epochs):
        before = loss(p, train)
        g = np.array([(loss(p + d, train) - loss(p - d, train)) / 2e-6 for d in np.eye(len(p)) * 1e-6])
        g *= min(1, how.clip / (np.sqrt(g @ g) + 1e-6))
        m, v, rate = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, how.rate_at(e)
        p = p * (1 - rate * how.decay) - rate * (m / (1 - 0.9 ** (e + 1))) / (np.sqrt(v / (1 - 0.999 ** (e + 1))) + 1e-8)
        curve.append((before, loss(p, val)))
    return curve


@pytest.mark.parametrize("hidden", [[], [4]])
def test_training_is_that_of_one_process(spark, sets, tmp_path, hidden):
    how = training.Training(epochs=5, rate=0.05, least_rate=0.001, period=3)
    start = training.Dense([3, *hidden, 5]).start(1)
    want = plain_run(sets, hidden, how, start)
    for parts in (1, 5):
        _, _, curve = training.train_head(as_df(spark, sets, slice(0, 240), parts), as_df(spark, sets, slice(240, 300), parts), f"file://{tmp_path}/{parts}", hidden, how, start)
        assert [(r.train, r.validation) for r in curve.orderBy("epoch").collect()] == [pytest.approx(x, abs=1e-5) for x in want]


def test_training_goes_on_where_it_stopped(spark, sets, tmp_path):
    how = training.Training(epochs=6, rate=0.1, period=4, batches=3)
    a, b = as_df(spark, sets, slice(0, 240), 2), as_df(spark, sets, slice(240, 300), 2)
    whole = training.train_head(a, b, f"file://{tmp_path}/whole", [4], how)
    training.train_head(a, b, f"file://{tmp_path}/cut", [4], training.Training(epochs=2, rate=0.1, period=4, batches=3))
    again = training.train_head(a, b, f"file://{tmp_path}/cut", [4], how)
    assert again[1] == pytest.approx(whole[1])
    c, d = ([(r.epoch, r.train, r.validation) for r in x[2].orderBy("epoch").collect()] for x in (whole, again))
    assert len(c) == 6 and c == [pytest.approx(x) for x in d]
    assert c[-1][2] < c[0][2]
    out = training.apply_head(a, *whole[:2])
    assert {"dx", "dy", "dz", "l0", "l1"} <= set(out.columns) and out.count() == 240


def test_training_stops_without_improvement(spark, sets, tmp_path):
    how = training.Training(epochs=50, rate=0.0, least_rate=0.0, patience=2)
    _, _, curve = training.train_head(as_df(spark, sets, slice(0, 50), 1), as_df(spark, sets, slice(240, 300), 1), f"file://{tmp_path}/p", how=how)
    assert curve.count() == 3
    with pytest.raises(ValueError, match="no rows"):
        training.train_head(as_df(spark, sets, slice(0, 0), 1), as_df(spark, sets, slice(0, 5), 1), f"file://{tmp_path}/q")


def test_codes_are_those_of_morton(spark):
    r = spark.range(1).select(morton(F.lit(5), F.lit(9), F.lit(2**20 - 1), layers.DEPTH).alias("c")).first()
    assert r.c == code((5, 9, 2**20 - 1))
    assert grid.ORDERS[0] == "z"
