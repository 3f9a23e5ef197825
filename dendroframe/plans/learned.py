"""Queries of trained layers over the fixture tables. Weights follow a formula that SQL can say too: no trained ones are shipped."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import abstraction, attention, grid, layers, points, training
from ..sources.scratch import shared_folder
from . import fixtures as X
from .registry import PATCH, _fps_sql, q, query, r


def weight(seed: int, out: int, into: int, kernel: int = 1) -> np.ndarray:
    """(out, kernel^3, in) weights; w_sql says the same."""
    o, k, i = np.ogrid[:out, : kernel**3, :into]
    return ((o * 7 + i * 11 + k * 13 + seed * 5) % 17 - 8) / 32.0


def w_sql(seed: int, o: int, i: int, k: str = "0") -> str:
    return f"(({o * 7 + i * 11 + seed * 5} + 13 * ({k})) % 17 - 8) / CAST(32 AS DOUBLE)"


def conv(seed: int, out: int, into: int, kernel: int = 3) -> np.ndarray:
    return weight(seed, out, into, kernel).reshape(out, kernel, kernel, kernel, into)


def norm(name: str, n: int) -> dict[str, np.ndarray]:
    c = np.arange(n)
    return {f"{name}.weight": 1 + c / 8, f"{name}.bias": (c % 3 - 1) / 4, f"{name}.running_mean": c / 16, f"{name}.running_var": 1 + c / 4}


def norm_relu_sql(source: str, out: str, n: int, keys: str, relu: bool = True, eps: float = layers.EPS) -> str:
    one = lambda c: f"(f{c} - {c / 16}) * CAST({1 + c / 8} AS DOUBLE) / sqrt(CAST({1 + c / 4 + eps} AS DOUBLE)) + {(c % 3 - 1) / 4}"
    return f"{out} AS MATERIALIZED (SELECT {keys}, {', '.join(f'greatest(0, {one(c)}) AS f{c}' if relu else f'{one(c)} AS f{c}' for c in range(n))} FROM {source})"


def linear_sql(source: str, out: str, seed: int, n_out: int, n_in: int, keys: str, bias: bool = False) -> str:
    one = lambda o: " + ".join(f"{w_sql(seed, o, i)} * f{i}" for i in range(n_in)) + (f" + {bias_of(o)}" if bias else "")
    return f"{out} AS MATERIALIZED (SELECT {keys}, {', '.join(f'{one(o)} AS f{o}' for o in range(n_out))} FROM {source})"


def bias_of(o: int) -> float:
    return (o % 5 - 2) / 8


def biases(n: int) -> np.ndarray:
    return np.array([bias_of(o) for o in range(n)])


# -- sparse convolutions

VOXELS = """v AS (SELECT e.*, CAST(floor(x-mx) AS BIGINT) vx, CAST(floor(y-my) AS BIGINT) vy, CAST(floor(z-mz) AS BIGINT) vz FROM ev e JOIN (SELECT tree_id, min(x) mx, min(y) my, min(z) mz FROM ev GROUP BY tree_id) m ON e.tree_id = m.tree_id),
c AS (SELECT *, row_number() OVER (PARTITION BY tree_id, vx, vy, vz ORDER BY point_id) n FROM v),
f AS MATERIALIZED (SELECT tree_id, vx, vy, vz, avg(z / 30) f0, CAST(1 AS DOUBLE) f1, CAST(1 AS DOUBLE) f2, CAST(1 AS DOUBLE) f3 FROM c WHERE n <= 10 GROUP BY tree_id, vx, vy, vz)"""
KEY = "tree_id, vx, vy, vz"


def conv_sql(source: str, out: str, seed: int, n_out: int, n_in: int) -> str:
    one = lambda o: "sum(" + " + ".join(f"{w_sql(seed, o, i, 'k')} * f{i}" for i in range(n_in)) + f") AS f{o}"
    return (
        f"{out}_p AS (SELECT a.tree_id, a.vx, a.vy, a.vz, ((b.vz-a.vz+1)*3 + b.vy-a.vy+1)*3 + b.vx-a.vx+1 AS k, {', '.join(f'b.f{i}' for i in range(n_in))} FROM {source} a JOIN {source} b ON a.tree_id = b.tree_id AND abs(a.vx-b.vx) <= 1 AND abs(a.vy-b.vy) <= 1 AND abs(a.vz-b.vz) <= 1),\n"
        f"{out} AS MATERIALIZED (SELECT {KEY}, {', '.join(map(one, range(n_out)))} FROM {out}_p GROUP BY {KEY})"
    )


def down_sql(source: str, out: str, seed: int, n_out: int, n_in: int) -> str:
    k = "((vz%2)*2 + vy%2)*2 + vx%2"
    one = lambda o: "sum(" + " + ".join(f"{w_sql(seed, o, i, k)} * f{i}" for i in range(n_in)) + f") AS f{o}"
    return f"{out} AS MATERIALIZED (SELECT tree_id, vx//2 AS vx, vy//2 AS vy, vz//2 AS vz, {', '.join(map(one, range(n_out)))} FROM {source} GROUP BY tree_id, vx//2, vy//2, vz//2)"


def up_sql(coarse: str, fine: str, out: str, seed: int, n_out: int, n_in: int) -> str:
    k = "((a.vz%2)*2 + a.vy%2)*2 + a.vx%2"
    one = lambda o: " + ".join(f"{w_sql(seed, o, i, k)} * b.f{i}" for i in range(n_in)) + f" AS f{o}"
    return f"{out} AS MATERIALIZED (SELECT a.tree_id, a.vx, a.vy, a.vz, {', '.join(map(one, range(n_out)))} FROM {fine} a JOIN {coarse} b ON a.tree_id = b.tree_id AND a.vx//2 = b.vx AND a.vy//2 = b.vy AND a.vz//2 = b.vz)"


def added_sql(a: str, b: str, out: str, n: int, side_by_side: int = 0) -> str:
    f = [f"a.f{i} + b.f{i} AS f{i}" for i in range(n)] if not side_by_side else [f"a.f{i}" for i in range(n)] + [f"b.f{i} AS f{n + i}" for i in range(side_by_side)]
    return f"{out} AS MATERIALIZED (SELECT a.tree_id, a.vx, a.vy, a.vz, {', '.join(f)} FROM {a} a JOIN {b} b USING ({KEY}))"


def block_sql(source: str, out: str, seed: int, n_out: int, n_in: int) -> list[str]:
    parts = [norm_relu_sql(source, f"{out}_a", n_in, KEY), conv_sql(f"{out}_a", f"{out}_b", seed, n_out, n_in), norm_relu_sql(f"{out}_b", f"{out}_c", n_out, KEY), conv_sql(f"{out}_c", f"{out}_d", seed + 1, n_out, n_out)]
    own = source
    if n_in != n_out:
        parts.append(linear_sql(source, own := f"{out}_e", seed + 2, n_out, n_in, KEY))
    return [*parts, added_sql(f"{out}_d", own, out, n_out)]


def block_weights(name: str, seed: int, n_out: int, n_in: int) -> dict[str, np.ndarray]:
    w = norm(f"{name}.conv_branch.0", n_in) | {f"{name}.conv_branch.2.weight": conv(seed, n_out, n_in)} | norm(f"{name}.conv_branch.3", n_out) | {f"{name}.conv_branch.5.weight": conv(seed + 1, n_out, n_out)}
    return w | ({f"{name}.i_branch.0.weight": conv(seed + 2, n_out, n_in, 1)} if n_in != n_out else {})


def voxels(s, d):
    return layers.voxel_features(X.event_points(s, d).withColumn("h", F.col("z") / 30), 1.0, ["h"])


def shown(df, n: int):
    keys = [c.alias(k) for c, k in zip(G.morton_decode(F.col("code")), ("vx", "vy", "vz"))]
    return df.select("tree_id", *keys, *(r(F.col("feat")[i]).alias(f"f{i}") for i in range(n)))


def shown_sql(source: str, n: int, keys: str = KEY) -> str:
    return f"SELECT {keys}, {', '.join(f'{q(f"f{i}")} AS f{i}' for i in range(n))} FROM {source}"


@query("sparse_conv", X.sql(f"{VOXELS}, {conv_sql('f', 'g', 1, 3, 4)} {shown_sql('g', 3)}", "ev"))
def _(s, d):
    v = voxels(s, d)
    return shown(layers.sub_conv(v, layers.rulebook(v), conv(1, 3, 4)), 3)


@query("sparse_block", X.sql(f"{VOXELS}, {', '.join(block_sql('f', 'g', 3, 3, 4))} {shown_sql('g', 3)}", "ev"))
def _(s, d):
    v = voxels(s, d)
    return shown(layers.residual_block(v, layers.rulebook(v), block_weights("b", 3, 3, 4), "b"), 3)


@query("sparse_down_up", X.sql(f"{VOXELS}, {down_sql('f', 'g', 2, 3, 4)}, {up_sql('g', 'f', 'h', 5, 2, 3)} {shown_sql('h', 2)}", "ev"))
def _(s, d):
    v = voxels(s, d)
    return shown(layers.up_conv(layers.down_conv(v, conv(2, 3, 4, 2)), v, conv(5, 2, 3, 2)), 2)


UNET = {
    "input_conv.0.weight": conv(1, 2, 4),
    **block_weights("unet.blocks.block0", 2, 2, 2), **norm("unet.conv.0", 2), "unet.conv.2.weight": conv(4, 3, 2, 2),
    **block_weights("unet.u.blocks.block0", 5, 3, 3),
    **norm("unet.deconv.0", 3), "unet.deconv.2.weight": conv(7, 2, 3, 2), **block_weights("unet.blocks_tail.block0", 8, 2, 4), **norm("output_layer.0", 2),
    **{k: v for name, seed, n in (("offset_linear", 11, 3), ("semantic_linear", 13, 2)) for k, v in {f"{name}.0.weight": weight(seed, 2, 2)[:, 0], f"{name}.0.bias": biases(2), **norm(f"{name}.1", 2), f"{name}.3.weight": weight(seed + 1, n, 2)[:, 0], f"{name}.3.bias": biases(n)}.items()},
}


def _head_sql(name: str, seed: int, n: int) -> list[str]:
    return [linear_sql("o", f"{name}a", seed, 2, 2, KEY, True), norm_relu_sql(f"{name}a", f"{name}b", 2, KEY), linear_sql(f"{name}b", name, seed + 1, n, 2, KEY, True)]


_UNET_SQL = ",\n".join([
    VOXELS, conv_sql("f", "i", 1, 2, 4), *block_sql("i", "b0", 2, 2, 2), norm_relu_sql("b0", "dn", 2, KEY), down_sql("dn", "dc", 4, 3, 2), *block_sql("dc", "u0", 5, 3, 3),
    norm_relu_sql("u0", "un", 3, KEY), up_sql("un", "b0", "uc", 7, 2, 3), added_sql("b0", "uc", "cat", 2, 2), *block_sql("cat", "t0", 8, 2, 4), norm_relu_sql("t0", "o", 2, KEY), *_head_sql("p", 11, 3), *_head_sql("l", 13, 2),
])


@query("sparse_unet", X.sql(f"{_UNET_SQL} SELECT v.tree_id, v.point_id, {', '.join(f'{q(f"p.f{i}")} AS d{c}' for i, c in enumerate('xyz'))}, {q('l.f0')} AS l0, {q('l.f1')} AS l1 FROM v JOIN p USING ({KEY}) JOIN l USING ({KEY})", "ev"))
def _(s, d):
    p = X.event_points(s, d).withColumn("h", F.col("z") / 30)
    return layers.sparse_unet(p, UNET, ["h"], 1.0).select("tree_id", "point_id", *(r(c).alias(c) for c in ("dx", "dy", "dz", "l0", "l1")))


# -- attention within patches

HEADS, WIDTH = 2, 4
POINT = "tree_id, point_id"
ATTENTION = {"a.qkv.weight": weight(1, 3 * WIDTH, WIDTH)[:, 0], "a.qkv.bias": biases(3 * WIDTH), "a.proj.weight": weight(2, WIDTH, WIDTH)[:, 0], "a.proj.bias": biases(WIDTH)}


def attention_weights(size: int) -> dict[str, np.ndarray]:
    return ATTENTION | {"a.rpe.rpe_table": weight(3, 3 * (2 * attention.position_bound(size) + 1), HEADS)[:, 0]}


def _attention_sql(size: int) -> str:
    bound = attention.position_bound(size)
    place = lambda axis, n: f"(greatest({-bound}, least({bound}, a.v{axis} - b.v{axis})) + {bound + n * (2 * bound + 1)})"
    bias = lambda h: " + ".join(f"(({place(axis, n)} * 7 + {h * 11 + 15}) % 17 - 8) / CAST(32 AS DOUBLE)" for n, axis in enumerate("xyz"))
    d = WIDTH // HEADS
    dot = lambda h: " + ".join(f"a.f{h * d + j} * b.f{WIDTH + h * d + j}" for j in range(d))
    scores = ", ".join(f"exp(({dot(h)}) / sqrt(CAST({d} AS DOUBLE)) + {bias(h)}) AS e{h}" for h in range(HEADS))
    mixed = ", ".join(f"sum(e{h} * f{2 * WIDTH + h * d + j}) / sum(e{h}) AS f{h * d + j}" for h in range(HEADS) for j in range(d))
    return (
        f"{PATCH.replace('48', str(size))}, i AS (SELECT tree_id, point_id, z / 30 AS f0, x / 10 AS f1, y / 10 AS f2, CAST(1 AS DOUBLE) AS f3 FROM ev), {linear_sql('i', 'x', 1, 3 * WIDTH, WIDTH, POINT, True)},\n"
        f"b AS MATERIALIZED (SELECT pa.patch, pa.borrowed, pa.vx, pa.vy, pa.vz, x.* FROM pa JOIN x USING ({POINT})),\n"
        f"s AS (SELECT a.tree_id, a.point_id, {scores}, {', '.join(f'b.f{2 * WIDTH + j}' for j in range(WIDTH))} FROM b a JOIN b ON a.tree_id = b.tree_id AND a.patch = b.patch WHERE NOT a.borrowed),\n"
        f"mixed AS (SELECT {POINT}, {mixed} FROM s GROUP BY {POINT}), {linear_sql('mixed', 'projected', 2, WIDTH, WIDTH, POINT, True)} {shown_sql('projected', WIDTH, POINT)}"
    )


def _attended(s, d, size: int):
    p = grid.serialise(X.event_points(s, d), 1.0).withColumn("feat", F.array(F.col("z") / 30, F.col("x") / 10, F.col("y") / 10, F.lit(1.0)))
    out = attention.patch_attention(p, attention_weights(size), "a", HEADS, size)
    return out.select("tree_id", "point_id", *(r(F.col("feat")[i]).alias(f"f{i}") for i in range(WIDTH)))


@query("patch_attention", X.sql(_attention_sql(16), "ev"))
def _(s, d):
    return _attended(s, d, 16)


@query("patch_attention_wide", X.sql(_attention_sql(48), "ev"))
def _(s, d):
    return _attended(s, d, 48)


# -- set abstraction


def shared(name: str, seed: int, widths: list[int]) -> dict[str, np.ndarray]:
    """Layers from widths[0] channels to the last."""
    out = {}
    for i, (a, b) in enumerate(zip(widths, widths[1:])):
        out |= {f"{name}.mlp_convs.{i}.weight": weight(seed + i, b, a)[:, 0], f"{name}.mlp_convs.{i}.bias": biases(b), **norm(f"{name}.mlp_bns.{i}", b)}
    return out


def shared_sql(source: str, out: str, seed: int, widths: list[int], keys: str) -> str:
    parts, last = [], source
    for i, (a, b) in enumerate(zip(widths, widths[1:])):
        parts += [linear_sql(last, f"{out}_l{i}", seed + i, b, a, keys, True), norm_relu_sql(f"{out}_l{i}", last := f"{out}_r{i}", b, keys, eps=abstraction.BN_EPS)]
    return ",\n".join([*parts, f"{out} AS (SELECT * FROM {last})"])


def ball_sql(points: str, centres: str, out: str, seed: int, radius: float, most: int, widths: list[int]) -> str:
    """Set abstraction of points (with f0, ...) around centres: out has tree_id, point_id, x, y, z, f0, ..."""
    n = widths[0] - 3
    gap = "(c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)+(c.z-p.z)*(c.z-p.z)"
    rows = f"{out}_g AS MATERIALIZED (SELECT * FROM (SELECT c.tree_id, c.point_id, p.x-c.x AS f0, p.y-c.y AS f1, p.z-c.z AS f2, {', '.join(f'p.f{i} AS f{3 + i}' for i in range(n))}, row_number() OVER (PARTITION BY c.tree_id, c.point_id ORDER BY p.point_id) slot FROM {centres} c JOIN {points} p ON c.tree_id = p.tree_id WHERE sqrt({gap}) <= {radius}) WHERE slot <= {most})"
    top = f"{out} AS MATERIALIZED (SELECT c.*, m.* EXCLUDE (tree_id, point_id) FROM {centres} c JOIN (SELECT {POINT}, {', '.join(f'max(f{i}) AS f{i}' for i in range(widths[-1]))} FROM {out}_m GROUP BY {POINT}) m USING ({POINT}))"
    return ",\n".join([rows, shared_sql(f"{out}_g", f"{out}_m", seed, widths, POINT), top])


def back_sql(points: str, n_own: int, centres: str, n_up: int, out: str, seed: int, widths: list[int]) -> str:
    """Feature propagation to points (with f0, ...)."""
    gap = "(c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)+(c.z-p.z)*(c.z-p.z)"
    near = f"{out}_n AS (SELECT p.tree_id, p.point_id, 1 / greatest({gap}, 1e-6) AS w, {', '.join(f'c.f{i}' for i in range(n_up))}, row_number() OVER (PARTITION BY p.tree_id, p.point_id ORDER BY sqrt({gap}), c.point_id) rk FROM {points} p JOIN {centres} c ON c.tree_id = p.tree_id)"
    mean = f"{out}_i AS MATERIALIZED (SELECT {POINT}, {', '.join(f'sum(w * f{i}) / sum(w) AS f{i}' for i in range(n_up))} FROM {out}_n WHERE rk <= 3 GROUP BY {POINT})"
    both = f"{out}_b AS (SELECT p.tree_id, p.point_id, {', '.join([f'p.f{i}' for i in range(n_own)] + [f'i.f{i} AS f{n_own + i}' for i in range(n_up)])} FROM {points} p JOIN {out}_i i USING ({POINT}))"
    return ",\n".join([near, mean, both, shared_sql(f"{out}_b", out, seed, widths, POINT)])


LEVELS = shared("sa1", 1, [4, 4, 5]) | shared("sa2", 3, [8, 6]) | shared("fp2", 5, [11, 4]) | shared("fp1", 6, [5, 4, 3])
_LEVELS_SQL = ",\n".join([
    _fps_sql(8), "c1 AS MATERIALIZED (SELECT p.tree_id, p.point_id, x, y, z FROM picks k JOIN pts p USING (tree_id, point_id))",
    "c2 AS MATERIALIZED (SELECT p.tree_id, p.point_id, x, y, z FROM picks k JOIN pts p USING (tree_id, point_id) WHERE k.pick < 4)",  # the first picks of the picks are the first picks
    ball_sql("pts", "c1", "s1", 1, 2.0, 8, [4, 4, 5]), ball_sql("s1", "c2", "s2", 3, 6.0, 8, [8, 6]), back_sql("s1", 5, "s2", 6, "b2", 5, [11, 4]),
    "l1 AS (SELECT s1.tree_id, s1.point_id, x, y, z, b2.* EXCLUDE (tree_id, point_id) FROM s1 JOIN b2 USING (tree_id, point_id))",
    back_sql("pts", 1, "l1", 4, "b1", 6, [5, 4, 3]),
])


@query("set_abstraction", X.sql(f"{_LEVELS_SQL} {shown_sql('b1', 3, POINT)}", "pts"))
def _(s, d):
    """Two levels down and up again."""
    p = X.points(s, d).select("tree_id", "point_id", "x", "y", "z", F.array("f0").alias("feat"))
    one = abstraction.set_abstraction(p, LEVELS, "sa1", 8, 2.0, 8)
    two = abstraction.set_abstraction(one, LEVELS, "sa2", 4, 6.0, 8)
    out = abstraction.feature_propagation(p, abstraction.feature_propagation(one, two, LEVELS, "fp2"), LEVELS, "fp1")
    return out.select("tree_id", "point_id", *(r(F.col("feat")[i]).alias(f"f{i}") for i in range(3)))


# -- training

HOW = training.Training(epochs=3, rate=0.05, least_rate=0.001, period=2)
START = np.concatenate([weight(9, training.OUT, 2)[:, 0].ravel(), biases(training.OUT)])


def _training_sql(how: training.Training, start: np.ndarray) -> str:
    """The curve of a linear head over two features, unrolled: w<e> holds the parameters (p0, ...) and moments of epoch e."""
    n, names = len(start), range(len(start))
    rows = "t AS MATERIALIZED (SELECT point_id, f0 AS x0, z / 10 AS x1, dx, dy, dz, CAST(sqrt(dx*dx+dy*dy+dz*dz) > 0.2 AS INT) AS label, sqrt(dx*dx+dy*dy+dz*dz) <= 0.2 AS mask FROM pts)"
    parts = [rows, f"w0 AS (SELECT {', '.join(f'CAST({x} AS DOUBLE) AS p{i}, CAST(0 AS DOUBLE) AS m{i}, CAST(0 AS DOUBLE) AS v{i}' for i, x in enumerate(start.tolist()))})"]
    outs = ", ".join(f"p{2 * o} * x0 + p{2 * o + 1} * x1 + p{10 + o} AS o{o}" for o in range(5))
    ce, length = "ln(exp(o3) + exp(o4)) - CASE label WHEN 1 THEN o4 ELSE o3 END", "sqrt(greatest((o0-dx)*(o0-dx)+(o1-dy)*(o1-dy)+(o2-dz)*(o2-dz), 1e-8))"
    for e in range(how.epochs):
        each = [f"CASE WHEN mask AND len > 1e-4 THEN (o{o} - d{c}) / len / nm ELSE 0 END" for o, c in enumerate("xyz")] + [f"(exp(o{o}) / (exp(o3) + exp(o4)) - CAST(label = {o - 3} AS INT)) / n" for o in (3, 4)]
        grads = [f"sum(({each[i // 2]}) * x{i % 2}) AS g{i}" for i in range(10)] + [f"sum({each[o]}) AS g{10 + o}" for o in range(5)]
        scale = f"least(1, {how.clip} / (sqrt({' + '.join(f'g{i}*g{i}' for i in names)}) + 1e-6))"
        rate, k = how.rate_at(e), e + 1
        parts += [
            f"o{e} AS (SELECT t.*, {outs} FROM t, w{e})", f"l{e} AS (SELECT *, {length} AS len, {ce} AS ce, count(*) OVER () AS n, count(*) FILTER (WHERE mask) OVER () AS nm FROM o{e} WHERE point_id % 5 <> 0)",
            f"g{e} AS MATERIALIZED (SELECT avg(ce) + avg(CASE WHEN mask THEN len END) AS train, {', '.join(grads)} FROM l{e})", f"c{e} AS (SELECT *, {scale} AS s FROM g{e})",
            f"n{e} AS (SELECT {', '.join(f'p{i}, 0.9 * m{i} + 0.1 * g{i} * s AS m{i}, 0.999 * v{i} + (1 - 0.999) * g{i} * s * g{i} * s AS v{i}' for i in names)} FROM w{e}, c{e})",
            f"w{k} AS MATERIALIZED (SELECT {', '.join(f'p{i} * {1 - rate * how.decay} - {rate} * (m{i} / {1 - 0.9**k}) / (sqrt(v{i} / {1 - 0.999**k}) + 1e-8) AS p{i}, m{i}, v{i}' for i in names)} FROM n{e})",
            f"y{e} AS (SELECT t.*, {outs} FROM t, w{k} WHERE point_id % 5 = 0)", f"z{e} AS (SELECT avg({ce}) + avg(CASE WHEN mask THEN {length} END) AS validation FROM y{e})",
        ]
    shown = " UNION ALL ".join(f"SELECT CAST({e} AS INT) AS epoch, CAST({round(how.rate_at(e), 6)} AS DOUBLE) AS rate, {q('train')} AS train, {q('validation')} AS validation FROM g{e}, z{e}" for e in range(how.epochs))
    assert n == 15
    return ",\n".join(parts) + "\n" + shown


@query("train_head", X.sql(_training_sql(HOW, START), "pts"))
def _(s, d):
    p = points.offset_labels(X.points(s, d), 0.2).select("point_id", F.array("f0", F.col("z") / 10).alias("feat"), "dx", "dy", "dz", F.col("is_noise").alias("label"), F.col("offset_mask").alias("mask"))
    _, _, curve = training.train_head(p.filter("point_id % 5 <> 0"), p.filter("point_id % 5 = 0"), shared_folder(s, "head"), how=HOW, start=START)
    return curve.select("epoch", *(r(c).alias(c) for c in ("rate", "train", "validation")))
