"""The registered queries over the fixture tables, and SQL for those that SQL can express. Sums of floating numbers are rounded on both sides."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import branches, cluster, evaluation, grid, growth, hierarchy, neighbours, points, qsm, sampling, stats
from ..sources import readers, sinks
from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
D = 6


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r(c, digits: int = D):
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0  # no negative zero


def rounded(df: DataFrame, *names: str, digits: int = D) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def q(c: str, digits: int = D) -> str:
    return f"round({c}, {digits}) + 0.0"


# -- nearest cylinders and labels


@query("nearest_cylinder", X.sql(f"SELECT tree_id, point_id, cylinder_id, {q('distance')} AS distance, {q('ox')} AS ox, {q('oy')} AS oy, {q('oz')} AS oz FROM near_offset", "pts", "cyl", "near", "near_offset"))
def _(s, d):
    return rounded(neighbours.nearest_cylinder(X.points(s, d), X.cylinders(s, d)), "distance", "ox", "oy", "oz").select("tree_id", "point_id", "cylinder_id", "distance", "ox", "oy", "oz")


@query("tree_mean_distance", X.sql(f"SELECT tree_id, count(*) AS n, {q('avg(distance)')} AS mean, {q('stddev_pop(distance)/sqrt(count(*))')} AS sem, {q('stddev_pop(distance)')} AS std FROM near GROUP BY tree_id", "pts", "cyl", "near"))
def tree_mean_distance(s, d):
    return rounded(stats.mean_error(neighbours.nearest_cylinder(X.points(s, d), X.cylinders(s, d)), "distance", ["tree_id"]), "mean", "sem", "std")


NORM = "sqrt(dx*dx+dy*dy+dz*dz)"


@query("offset_label", X.sql(f"SELECT tree_id, point_id, {q(NORM)} AS offset_norm, {NORM} <= 0.2 AS offset_mask, CAST({NORM} > 0.2 AS INT) AS is_noise FROM pts", "pts"))
def _(s, d):
    return rounded(points.offset_labels(X.points(s, d), 0.2), "offset_norm").select("tree_id", "point_id", "offset_norm", "offset_mask", "is_noise")


@query("apply_offset_denoise", X.sql(f"SELECT tree_id, point_id, {q('x+dx')} AS x, {q('y+dy')} AS y, {q('z+dz')} AS z FROM pts WHERE l0 >= l1", "pts"))
def _(s, d):
    return rounded(points.apply_offset(points.denoise(X.points(s, d))), "x", "y", "z").select("tree_id", "point_id", "x", "y", "z")


@query("height_filter", X.sql("SELECT e.tree_id, point_id FROM ev e JOIN (SELECT tree_id, min(z) b FROM ev GROUP BY tree_id) m ON e.tree_id = m.tree_id WHERE z >= b + 10", "ev"))
def _(s, d):
    return points.height_filter(X.event_points(s, d), 10.0).select("tree_id", "point_id")


@query("relative_height", X.sql(f"SELECT e.tree_id, point_id, {q('(z-lo)/nullif(hi-lo,0)')} AS height FROM ev e JOIN (SELECT tree_id, min(z) lo, max(z) hi FROM ev GROUP BY tree_id) m ON e.tree_id = m.tree_id", "ev"))
def _(s, d):
    return rounded(points.relative_height(X.event_points(s, d)), "height").select("tree_id", "point_id", "height")


@query("axis_distance", X.sql(f"SELECT e.tree_id, point_id, {q('sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))')} AS axis_distance FROM ev e JOIN (SELECT tree_id, avg(x) cx, avg(y) cy FROM ev GROUP BY tree_id) m ON e.tree_id = m.tree_id", "ev"))
def _(s, d):
    return rounded(points.axis_distance(X.event_points(s, d)), "axis_distance").select("tree_id", "point_id", "axis_distance")


CENTRED = "c AS (SELECT p.tree_id, point_id, x-mx x, y-my y, z-mz z FROM pts p JOIN (SELECT tree_id, avg(x) mx, avg(y) my, avg(z) mz FROM pts GROUP BY tree_id) m ON p.tree_id = m.tree_id)"


@query("centre_cloud", X.sql(f"{CENTRED} SELECT tree_id, point_id, {q('x')} AS x, {q('y')} AS y, {q('z')} AS z FROM c", "pts"))
def _(s, d):
    return rounded(points.centre(X.points(s, d)), "x", "y", "z").select("tree_id", "point_id", "x", "y", "z")


@query("unit_sphere", X.sql(f"{CENTRED}, m AS (SELECT tree_id, max(sqrt(x*x+y*y+z*z)) r FROM c GROUP BY tree_id) SELECT c.tree_id, point_id, {q('x/r')} AS x, {q('y/r')} AS y, {q('z/r')} AS z FROM c JOIN m ON c.tree_id = m.tree_id", "pts"))
def _(s, d):
    return rounded(points.centre(X.points(s, d), True), "x", "y", "z").select("tree_id", "point_id", "x", "y", "z")


@query("spread", X.sql(f"{CENTRED} SELECT tree_id, {q('CASE WHEN count(*) < 2 THEN 0.01 ELSE avg(sqrt(x*x+y*y+z*z)) END')} AS spread, count(*) AS n FROM c GROUP BY tree_id", "pts"))
def _(s, d):
    return rounded(points.spread(X.points(s, d)), "spread")


BOX = ((-1.0, 0.0, 5.0), (4.0, 6.0, 15.0))
IN_BOX = "x BETWEEN -1 AND 4 AND y BETWEEN 0 AND 6 AND z BETWEEN 5 AND 15"


@query("slice_box", X.sql(f"SELECT tree_id, point_id FROM ev WHERE {IN_BOX}", "ev"))
def _(s, d):
    return X.event_points(s, d).filter(G.in_box(G.cols("x", "y", "z"), *BOX)).select("tree_id", "point_id")


@query("slice_rotate_view", X.sql(f"SELECT tree_id, point_id, {q('(x-1.5)*cos(radians(45))-(y-3)*sin(radians(45))+1.5')} AS u, {q('z')} AS v FROM ev WHERE {IN_BOX}", "ev"))
def _(s, d):
    u, v = G.rotate_view(*G.cols("x", "y", "z"), 1.5, 3.0, "y")
    return X.event_points(s, d).filter(G.in_box(G.cols("x", "y", "z"), *BOX)).select("tree_id", "point_id", r(u).alias("u"), r(v).alias("v"))


@query("slice_views", X.sql(f"SELECT tree_id, point_id, {q('x')} AS top_u, {q('y')} AS top_v, {q('y')} AS side_u, {q('z')} AS side_v FROM ev WHERE {IN_BOX}", "ev"))
def _(s, d):
    top, side = (G.rotate_view(*G.cols("x", "y", "z"), 1.5, 3.0, v) for v in "zx")
    return X.event_points(s, d).filter(G.in_box(G.cols("x", "y", "z"), *BOX)).select("tree_id", "point_id", r(top[0]).alias("top_u"), r(top[1]).alias("top_v"), r(side[0]).alias("side_u"), r(side[1]).alias("side_v"))


CYL_BOX = ((-1.0, -1.0, -1.0), (0.6, 0.9, 0.8))


@query("cylinders_in_slice", X.sql("SELECT tree_id, id FROM cyl WHERE (sx BETWEEN -1 AND 0.6 AND sy BETWEEN -1 AND 0.9 AND sz BETWEEN -1 AND 0.8) OR (ex BETWEEN -1 AND 0.6 AND ey BETWEEN -1 AND 0.9 AND ez BETWEEN -1 AND 0.8)", "cyl"))
def _(s, d):
    return X.cylinders(s, d).filter(G.cylinder_in_box(G.cols("sx", "sy", "sz"), G.cols("ex", "ey", "ez"), *CYL_BOX)).select("tree_id", "id")


FLAT = "sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy))"
CORNERS = ", ".join(f"{q(f'{e}x {sign} (ey-sy)/{FLAT}*radius')} AS u{i}, {q(f'{e}y {back} (ex-sx)/{FLAT}*radius')} AS v{i}" for i, (e, sign, back) in enumerate((("s", "-", "+"), ("s", "+", "-"), ("e", "+", "-"), ("e", "-", "+"))))


@query("cylinder_quad", X.sql(f"SELECT tree_id, id, {CORNERS} FROM cyl WHERE {FLAT} > 1e-12", "cyl"))
def _(s, d):
    c = X.cylinders(s, d).withColumn("q", G.cylinder_quad(*G.cols("sx", "sy", "ex", "ey", "radius"))).filter("q is not null")
    return c.select("tree_id", "id", *(r(F.col("q")[i][k]).alias(f"{k}{i}") for i in range(4) for k in "uv"))


LEN = "sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)+(ez-sz)*(ez-sz))"


@query("cylinder_volume", X.sql(f"SELECT tree_id, id, {q(LEN)} AS length, {q(f'pi()*radius*radius*{LEN}')} AS volume FROM cyl", "cyl"))
def _(s, d):
    return rounded(hierarchy.with_measures(X.cylinders(s, d)), "length", "volume").select("tree_id", "id", "length", "volume")


@query("display_scale", X.sql(f"SELECT point_id, {q('CASE WHEN v <= 0.1 THEN v*100 WHEN v <= 1 THEN 10+(v-0.1)/0.9*10 WHEN v <= 1.1 THEN 20+(v-1)*10 ELSE 21 END')} AS shown FROM (SELECT point_id, abs(x)/5 v FROM ev)", "ev"))
def _(s, d):
    return X.event_points(s, d).select("point_id", r(G.display_scale(F.abs("x") / 5)).alias("shown"))


@query("radius_color", X.sql(f"m AS (SELECT tree_id, min(radius) lo, max(radius) hi FROM cyl GROUP BY tree_id), t AS (SELECT c.tree_id, id, CASE WHEN hi > lo THEN (radius-lo)/(hi-lo) ELSE 0.5 END t FROM cyl c JOIN m ON c.tree_id = m.tree_id WHERE radius >= 0.00001) SELECT tree_id, id, {q('CASE WHEN t < 0.5 THEN 0 ELSE 2*t-1 END')} AS red, {q('CASE WHEN t < 0.5 THEN 2*t ELSE 2-2*t END')} AS green, {q('CASE WHEN t < 0.5 THEN 1-2*t ELSE 0 END')} AS blue FROM t", "cyl"))
def _(s, d):
    return rounded(sinks.colored_cylinders(X.cylinders(s, d)).select("tree_id", "id", "color.*"), "red", "green", "blue")


# -- grids

SPAN = "m AS (SELECT tree_id, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz FROM ev GROUP BY tree_id)"


def _raster_sql(size: str, stride: str) -> str:
    def rng(c):
        v, e = f"(e.{c}-l{c})", f"(h{c}-l{c})"
        return f"range(CAST(greatest(floor(({v}-{size})/{stride})+1, 0) AS BIGINT), CAST(least(floor({v}/{stride}), ceil({e}/{stride})-1) AS BIGINT)+1)"

    return f"{SPAN},\na1 AS (SELECT e.tree_id, point_id, e.x, lx, ly, lz, e.y, hx, hy, hz, e.z, unnest({rng('x')}) ix FROM ev e JOIN m ON e.tree_id = m.tree_id),\na2 AS (SELECT *, unnest({rng('y').replace('e.', '')}) iy FROM a1),\nmem AS (SELECT *, unnest({rng('z').replace('e.', '')}) iz FROM a2)"


CELLS = "cells AS (SELECT tree_id, ix, iy, iz, count(*) n, any_value(lx) lx, any_value(ly) ly, any_value(lz) lz FROM mem GROUP BY tree_id, ix, iy, iz)"


@query("rasterize", X.sql(_raster_sql("2.0", "2.0") + " SELECT tree_id, point_id, ix, iy, iz FROM mem", "ev"))
def _(s, d):
    return grid.raster_members(X.event_points(s, d), 2.0, 2.0).select("tree_id", "point_id", "ix", "iy", "iz")


@query("rasterize_overlap", X.sql(_raster_sql("2.0", "1.0") + " SELECT tree_id, point_id, ix, iy, iz FROM mem", "ev"))
def _(s, d):
    return grid.raster_members(X.event_points(s, d), 2.0, 1.0).select("tree_id", "point_id", "ix", "iy", "iz")


@query("raster_metadata", X.sql(_raster_sql("2.0", "2.0") + f",\n{CELLS} SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY ix, iy, iz) - 1 AS raster_id, n, {q('lx+ix*2.0')} AS min_x, {q('ly+iy*2.0')} AS min_y, {q('lz+iz*2.0')} AS min_z, {q('lx+ix*2.0+2.0')} AS max_x FROM cells", "ev"))
def _(s, d):
    p = X.event_points(s, d)
    return rounded(grid.raster_table(grid.raster_members(p, 2.0, 2.0), p, 2.0, 2.0), "min_x", "min_y", "min_z", "max_x").select("tree_id", "raster_id", "n", "min_x", "min_y", "min_z", "max_x")


@query("raster_reaggregate", X.sql(_raster_sql("2.0", "1.0") + f", g AS (SELECT tree_id, point_id, avg(x*0.1+(ix+iy+iz)*0.01) p FROM mem GROUP BY tree_id, point_id) SELECT e.tree_id, e.point_id, {q('coalesce(p, 0)')} AS p FROM ev e LEFT JOIN g ON e.tree_id = g.tree_id AND e.point_id = g.point_id", "ev"))
def _(s, d):
    p = X.event_points(s, d)
    m = grid.raster_members(p, 2.0, 1.0).withColumn("p", F.col("x") * 0.1 + (F.col("ix") + F.col("iy") + F.col("iz")) * 0.01)
    return rounded(grid.reaggregate(m, p, "p"), "p")


@query("mini_batches", X.sql(_raster_sql("2.0", "2.0") + f",\n{CELLS}, n AS (SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY ix, iy, iz) - 1 raster_id, count(*) OVER (PARTITION BY tree_id) c FROM cells) SELECT tree_id, raster_id, raster_id // CASE WHEN c % 7 = 1 AND c > 1 THEN 6 ELSE 7 END AS batch FROM n", "ev"))
def _(s, d):
    p = X.event_points(s, d)
    return grid.mini_batches(grid.raster_table(grid.raster_members(p, 2.0, 2.0), p, 2.0, 2.0), 7).select("tree_id", "raster_id", "batch")


VOX = f"{SPAN}, v AS (SELECT e.*, CAST(floor((x-lx)/1.0) AS BIGINT) vx, CAST(floor((y-ly)/1.0) AS BIGINT) vy, CAST(floor((z-lz)/1.0) AS BIGINT) vz FROM ev e JOIN m ON e.tree_id = m.tree_id)"


@query("voxel_mean", X.sql(f"{VOX} SELECT tree_id, vx, vy, vz, count(*) AS n, {q('avg(x)')} AS mean_x, {q('avg(y)')} AS mean_y, {q('avg(z)')} AS mean_z FROM v GROUP BY tree_id, vx, vy, vz", "ev"))
def _(s, d):
    return rounded(grid.voxelise(X.event_points(s, d), 1.0, []), "mean_x", "mean_y", "mean_z")


@query("voxel_mean_capped", X.sql(f"{VOX}, k AS (SELECT *, row_number() OVER (PARTITION BY tree_id, vx, vy, vz ORDER BY point_id) rn FROM v) SELECT tree_id, vx, vy, vz, count(*) AS n, {q('avg(x)')} AS mean_x FROM k WHERE rn <= 2 GROUP BY tree_id, vx, vy, vz", "ev"))
def _(s, d):
    return rounded(grid.voxelise(X.event_points(s, d), 1.0, [], 2), "mean_x").select("tree_id", "vx", "vy", "vz", "n", "mean_x")


@query("voxel_unpool", X.sql(f"{VOX}, g AS (SELECT tree_id, vx, vy, vz, avg(z) mz FROM v GROUP BY tree_id, vx, vy, vz) SELECT v.tree_id, point_id, {q('mz')} AS mean_z FROM v JOIN g ON v.tree_id = g.tree_id AND v.vx = g.vx AND v.vy = g.vy AND v.vz = g.vz", "ev"))
def _(s, d):
    p = X.event_points(s, d)
    return rounded(grid.unpool(p, grid.voxelise(p, 1.0, []), 1.0), "mean_z").select("tree_id", "point_id", "mean_z")


def _bits(a: str, b: str, c: str) -> str:
    return " + ".join(f"(({v} >> {i}) & 1) * {1 << (3 * i + k)}" for i in range(8) for v, k in ((a, 2), (b, 1), (c, 0)))


CODED = f"{VOX}, k AS (SELECT *, CAST({_bits('vx', 'vy', 'vz')} AS BIGINT) code FROM v)"
RANKED = f"{CODED}, o AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY code, point_id) - 1 \"rank\" FROM k)"


@query("morton_encode", X.sql(f"{CODED} SELECT tree_id, point_id, code FROM k", "ev"))
def _(s, d):
    return grid.voxel_key(X.event_points(s, d), 1.0).select("tree_id", "point_id", G.morton(*G.cols("vx", "vy", "vz")).alias("code"))


@query("morton_roundtrip", X.sql("SELECT point_id, point_id % 65536 AS x, (point_id*7) % 65536 AS y, (point_id*13) % 65536 AS z FROM ev", "ev"))
def _(s, d):
    p = X.event_points(s, d).select("point_id", G.morton(F.expr("point_id % 65536"), F.expr("(point_id*7) % 65536"), F.expr("(point_id*13) % 65536")).alias("code"))
    x, y, z = G.morton_decode(F.col("code"))
    return p.select("point_id", x.alias("x"), y.alias("y"), z.alias("z"))


@query("morton_swapped", X.sql(f"{VOX} SELECT tree_id, point_id, CAST({_bits('vy', 'vx', 'vz')} AS BIGINT) AS code FROM v", "ev"))
def _(s, d):
    return grid.serialise(X.event_points(s, d), 1.0, swap=True).select("tree_id", "point_id", "code")


@query("serialized_order", X.sql(f"{RANKED} SELECT tree_id, point_id, \"rank\" FROM o", "ev"))
def _(s, d):
    return grid.serialise(X.event_points(s, d), 1.0).select("tree_id", "point_id", "rank")


@query("serialized_pool", X.sql(f"{RANKED} SELECT tree_id, code >> 6 AS pool, count(*) AS n, {q('max(z)')} AS max_v, {q('avg(z)')} AS mean_v, {q('min(z)')} AS min_v, {q('sum(z)')} AS sum_v, {q('avg(x)')} AS mean_x, min_by(point_id, \"rank\") AS head FROM o GROUP BY tree_id, code >> 6", "ev"))
def _(s, d):
    out = grid.serialised_pool(grid.serialise(X.event_points(s, d), 1.0), 2, "z")
    return rounded(out, "max_v", "mean_v", "min_v", "sum_v", "mean_x").select("tree_id", "pool", "n", "max_v", "mean_v", "min_v", "sum_v", "mean_x", "head")


PATCH = f"{RANKED}, c AS (SELECT tree_id, count(*) n FROM o GROUP BY tree_id), pa AS (SELECT o.tree_id, point_id, \"rank\" // 48 patch, false borrowed, vx, vy, vz FROM o UNION ALL SELECT o.tree_id, point_id, (n-1)//48, true, vx, vy, vz FROM o JOIN c ON o.tree_id = c.tree_id WHERE (n-1)//48 > 0 AND (48 - n % 48) % 48 > 0 AND \"rank\" >= (n-1)//48*48 - (48 - n % 48) % 48 AND \"rank\" < (n-1)//48*48)"


@query("patch_assign", X.sql(f"{PATCH} SELECT tree_id, point_id, patch, borrowed FROM pa", "ev"))
def _(s, d):
    return grid.patches(grid.serialise(X.event_points(s, d), 1.0), 48).select("tree_id", "point_id", "patch", "borrowed")


@query("relative_positions", X.sql(f"{PATCH} SELECT a.tree_id, a.patch, count(*) AS n, CAST(sum(abs(a.vx-b.vx)) AS BIGINT) AS rx, CAST(max(a.vz-b.vz) AS BIGINT) AS rz FROM pa a JOIN pa b ON a.tree_id = b.tree_id AND a.patch = b.patch GROUP BY a.tree_id, a.patch", "ev"))
def _(s, d):
    rel = grid.relative_positions(grid.patches(grid.serialise(X.event_points(s, d), 1.0), 48))
    return rel.groupBy("tree_id", "patch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("rx")).alias("rx"), F.max("rz").alias("rz"))


@query("batch_offsets", X.sql("n AS (SELECT tree_id, count(*) n FROM ev GROUP BY tree_id) SELECT tree_id, n, CAST(sum(n) OVER (ORDER BY tree_id) AS BIGINT) AS \"offset\" FROM n", "ev"))
def _(s, d):
    return grid.batch_offsets(X.event_points(s, d))


@query("bounding_box", X.sql(f"SELECT tree_id, {q('min(x)')} AS min_x, {q('max(x)')} AS max_x, {q('min(y)')} AS min_y, {q('max(y)')} AS max_y, {q('min(z)')} AS min_z, {q('max(z)')} AS max_z FROM ev GROUP BY tree_id", "ev"))
def _(s, d):
    return rounded(points.extent(X.event_points(s, d)), *(f"{m}_{c}" for m in ("min", "max") for c in "xyz"))


def _hilbert_steps(source: str, x: str, y: str, z: str, bits: int, keep: str) -> tuple[str, str]:
    """Skilling's transform of axes to a Hilbert index as a chain of CTEs, one per bit and axis; (the CTEs, the last one's name). Its column is code."""
    steps, at = [f"h0 AS (SELECT {keep}, CAST({x} AS BIGINT) a, CAST({y} AS BIGINT) b, CAST({z} AS BIGINT) c FROM {source})"], 0

    def add(a: str, b: str, c: str, more: str = "") -> None:
        nonlocal at
        steps.append(f"h{at + 1} AS (SELECT {keep}, {a} a, {b} b, {c} c{more} FROM h{at})")
        at += 1

    for k in range(bits - 1, 0, -1):
        p = (1 << k) - 1
        hit = lambda v: f"(({v} >> {k}) & 1) = 1"  # noqa: B023, E731
        add(f"CASE WHEN {hit('a')} THEN xor(a, {p}) ELSE a END", "b", "c")
        add(f"CASE WHEN {hit('b')} THEN xor(a, {p}) ELSE xor(a, xor(a, b) & {p}) END", f"CASE WHEN {hit('b')} THEN b ELSE xor(b, xor(a, b) & {p}) END", "c")
        add(f"CASE WHEN {hit('c')} THEN xor(a, {p}) ELSE xor(a, xor(a, c) & {p}) END", "b", f"CASE WHEN {hit('c')} THEN c ELSE xor(c, xor(a, c) & {p}) END")
    add("a", "xor(b, a)", "xor(c, xor(b, a))")
    turn = "0"
    for k in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN ((c >> {k}) & 1) = 1 THEN {(1 << k) - 1} ELSE 0 END)"
    add("a", "b", "c", f", {turn} t")
    add("xor(a, t)", "xor(b, t)", "xor(c, t)")
    code = " + ".join(f"((({v} >> {i}) & 1) << {3 * i + k})" for i in range(bits) for v, k in (("a", 2), ("b", 1), ("c", 0)))
    steps.append(f"h{at + 1} AS (SELECT {keep}, CAST({code} AS BIGINT) code FROM h{at})")
    return ",\n".join(steps), f"h{at + 1}"


HILBERT, LAST = _hilbert_steps("ev", "point_id % 1024", "(point_id*7) % 1024", "(point_id*13) % 1024", 10, "point_id")


@query("hilbert_encode", X.sql(f"{HILBERT}\nSELECT point_id, code FROM {LAST}", "ev"))
def _(s, d):
    return X.event_points(s, d).select("point_id", grid.curve_code(F.expr("point_id % 1024"), F.expr("(point_id*7) % 1024"), F.expr("(point_id*13) % 1024"), "hilbert", 10).alias("code"))


def _orders_sql() -> str:
    hilbert, last = _hilbert_steps("v", "vx", "vy", "vz", 8, "tree_id, point_id")
    swapped, last_2 = _hilbert_steps("v", "vy", "vx", "vz", 8, "tree_id, point_id")
    swapped = re.sub(r"\bh(\d+)\b", r"g\1", swapped)
    rank = lambda code: f"row_number() OVER (PARTITION BY v.tree_id ORDER BY {code}, v.point_id) - 1"
    z, zt = (f"CAST({_bits(a, b, 'vz')} AS BIGINT)" for a, b in (("vx", "vy"), ("vy", "vx")))
    on = lambda t: f"{t}.tree_id = v.tree_id AND {t}.point_id = v.point_id"
    h, g = last, last_2.replace("h", "g")
    return f"{VOX},\n{hilbert},\n{swapped}\nSELECT v.tree_id, v.point_id, {rank(z)} AS rank_0, {rank(zt)} AS rank_1, {h}.code AS code_2, {rank(h + '.code')} AS rank_2, {g}.code AS code_3, {rank(g + '.code')} AS rank_3 FROM v JOIN {h} ON {on(h)} JOIN {g} ON {on(g)}"


@query("serialized_orders", X.sql(_orders_sql(), "ev"))
def _(s, d):
    return grid.serialise_all(X.event_points(s, d), 1.0, 8).select("tree_id", "point_id", "rank_0", "rank_1", "code_2", "rank_2", "code_3", "rank_3")


@query("serialized_inverse", X.sql(f"{RANKED} SELECT tree_id, \"rank\" AS place, point_id FROM o", "ev"))
def _(s, d):
    return grid.order_of(grid.serialise(X.event_points(s, d), 1.0))


@query("morton_batch", X.sql(f"{CODED} SELECT tree_id, point_id, (CAST(tree_id AS BIGINT) << 24) | code AS code FROM k", "ev"))
def _(s, d):
    return grid.voxel_key(X.event_points(s, d), 1.0).select("tree_id", "point_id", grid.curve_code(*G.cols("vx", "vy", "vz"), depth=8, batch=F.col("tree_id")).alias("code"))


BOXES = f"{_raster_sql('2.0', '1.0')},\n{CELLS}, meta AS (SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY ix, iy, iz) - 1 raster_id, lx+ix*1.0 ax, ly+iy*1.0 ay, lz+iz*1.0 az FROM cells)"


@query("extract_rasters", X.sql(f"{BOXES} SELECT e.tree_id, point_id, raster_id FROM ev e JOIN meta m ON e.tree_id = m.tree_id AND x >= ax AND x < ax+2.0 AND y >= ay AND y < ay+2.0 AND z >= az AND z < az+2.0", "ev"))
def _(s, d):
    p = X.event_points(s, d)
    return grid.extract_rasters(p, grid.raster_table(grid.raster_members(p, 2.0, 1.0), p, 2.0, 1.0)).select("tree_id", "point_id", "raster_id")


@query("rasters_per_tree", X.sql(f"{BOXES} SELECT count(DISTINCT tree_id) AS n_trees, count(*) AS n_rasters, {q('count(*) / CAST(count(DISTINCT tree_id) AS DOUBLE)')} AS mean_rasters FROM meta", "ev"))
def _(s, d):
    p = X.event_points(s, d)
    return rounded(grid.rasters_per_tree(grid.raster_table(grid.raster_members(p, 2.0, 1.0), p, 2.0, 1.0)), "mean_rasters")


@query("first_rasters", X.sql(f"{BOXES} SELECT tree_id, raster_id FROM meta WHERE raster_id < 5 AND tree_id IN (SELECT DISTINCT tree_id FROM ev ORDER BY tree_id LIMIT 2)", "ev"))
def _(s, d):
    p = X.event_points(s, d)
    return sampling.first_trees(grid.first_rasters(grid.raster_table(grid.raster_members(p, 2.0, 1.0), p, 2.0, 1.0), 5), 2).select("tree_id", "raster_id")


@query("split_rasters", X.sql(f"{BOXES}, nm AS (SELECT CAST(3 + tree_id % 5 AS VARCHAR) || '_' || CAST(tree_id AS VARCHAR) tree, tree_id, raster_id FROM meta), t AS (SELECT tree, row_number() OVER (ORDER BY (tree_id*7919) % 10007, tree) rk, count(*) OVER () n FROM (SELECT DISTINCT tree, tree_id FROM nm)) SELECT nm.tree AS tree_id, raster_id, CASE WHEN rk <= ceil(n*0.15) THEN 'test' ELSE 'train' END AS split, left(nm.tree, 1) AS plot FROM nm JOIN t ON nm.tree = t.tree", "ev"))
def _(s, d):
    p = X.event_points(s, d)
    m = grid.raster_table(grid.raster_members(p, 2.0, 1.0), p, 2.0, 1.0).withColumn("tree_id", F.expr("concat(cast(3 + tree_id % 5 as string), '_', cast(tree_id as string))"))
    return sampling.split_rasters(m, lambda c: F.expr(f"(cast(substring_index({c}, '_', -1) as bigint) * 7919) % 10007")).select("tree_id", "raster_id", "split", "plot")


@query("hilbert_roundtrip", X.sql("SELECT point_id, point_id % 1024 AS x, (point_id*7) % 1024 AS y, (point_id*13) % 1024 AS z FROM ev", "ev"))
def _(s, d):
    p = X.event_points(s, d).select("point_id", grid.hilbert(F.expr("point_id % 1024"), F.expr("(point_id*7) % 1024"), F.expr("(point_id*13) % 1024"), 10).alias("code"))
    return p.select("point_id", grid.hilbert_decode(F.col("code"), 10).alias("h")).select("point_id", "h.*")


# -- neighbours

DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


def _pairs(table: str) -> str:
    return f"pr AS (SELECT a.tree_id, a.point_id, b.point_id other_id, {DIST} d FROM {table} a JOIN {table} b ON a.tree_id = b.tree_id)"


KN = _pairs("pts") + ", kn AS (SELECT *, row_number() OVER (PARTITION BY tree_id, point_id ORDER BY d, other_id) rk FROM pr)"


@query("knn_mean_distance", X.sql(f"{KN} SELECT tree_id, point_id, {q('avg(d)')} AS mean_distance FROM kn WHERE rk BETWEEN 2 AND 6 GROUP BY tree_id, point_id", "pts"))
def _(s, d):
    return rounded(stats.neighbour_distance(X.points(s, d), 5), "mean_distance")


@query("radius_density", X.sql("cell AS (SELECT *, CAST(floor(x/0.5) AS BIGINT) gx, CAST(floor(y/0.5) AS BIGINT) gy, CAST(floor(z/0.5) AS BIGINT) gz FROM ev), nb AS (SELECT * EXCLUDE (gx, gy, gz), gx + a.i gx, gy + b.i gy, gz + c.i gz FROM cell, (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(i), (VALUES (-1),(0),(1)) c(i)) SELECT a.tree_id, a.point_id, count(*) AS density FROM nb a JOIN cell b ON a.tree_id = b.tree_id AND a.gx = b.gx AND a.gy = b.gy AND a.gz = b.gz WHERE " + DIST + " <= 0.5 GROUP BY a.tree_id, a.point_id", "ev"))
def _(s, d):
    return neighbours.density(X.event_points(s, d), 0.5)


COVARIANCES = ", ".join(f"covar_samp(p.{a}, p.{b}) c{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))


def _cov_sql(k: int, name: str = "cv") -> str:
    return f"{name} AS (SELECT k.tree_id, k.point_id, {COVARIANCES} FROM kn k JOIN pts p ON k.tree_id = p.tree_id AND k.other_id = p.point_id WHERE rk <= {k} GROUP BY k.tree_id, k.point_id)"


def _eigen_sql(source: str, name: str) -> str:
    """name: the rows of source with eigenvalues hi, mid, lo and vert, the size of the least axis' z."""
    n = name
    return f"""{n}1 AS (SELECT *, (cxx+cyy+czz)/3 q FROM {source}), {n}2 AS (SELECT *, sqrt(((cxx-q)*(cxx-q)+(cyy-q)*(cyy-q)+(czz-q)*(czz-q)+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) p FROM {n}1),
{n}3 AS (SELECT *, ((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz)-cxy*(cxy*(czz-q)-cyz*cxz)+cxz*(cxy*cyz-(cyy-q)*cxz))/(p*p*p)/2 h FROM {n}2), {n}4 AS (SELECT *, q+2*p*cos(acos(least(1, greatest(-1, h)))/3+2*pi()/3) lo, q+2*p*cos(acos(least(1, greatest(-1, h)))/3) hi FROM {n}3),
{n}5 AS (SELECT *, cxy*cyz-cxz*(cyy-lo) ax, cxz*cxy-(cxx-lo)*cyz ay, (cxx-lo)*(cyy-lo)-cxy*cxy az, cxy*(czz-lo)-cxz*cyz bx, cxz*cxz-(cxx-lo)*(czz-lo) by_, (cxx-lo)*cyz-cxy*cxz bz, (cyy-lo)*(czz-lo)-cyz*cyz cx_, cyz*cxz-cxy*(czz-lo) cy_, cxy*cyz-(cyy-lo)*cxz cz_ FROM {n}4),
{n}6 AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) na, sqrt(bx*bx+by_*by_+bz*bz) nb, sqrt(cx_*cx_+cy_*cy_+cz_*cz_) nc FROM {n}5),
{name} AS (SELECT *, 3*q-hi-lo mid, abs(CASE WHEN na >= nb AND na >= nc THEN az/na WHEN nb >= nc THEN bz/nb ELSE cz_/nc END) vert FROM {n}6)"""


COV = f"{KN}, {_cov_sql(8)}"


@query("local_covariance", X.sql(f"{COV} SELECT tree_id, point_id, " + ", ".join(f"{q(c)} AS {c}" for c in ("cxx", "cyy", "czz", "cxy", "cxz", "cyz")) + " FROM cv", "pts"))
def _(s, d):
    return rounded(stats.covariance(X.points(s, d), 8), "cxx", "cyy", "czz", "cxy", "cxz", "cyz")


EIG = f"{COV}, {_eigen_sql('cv', 'eig')}"


@query("curvature", X.sql(f"{EIG} SELECT tree_id, point_id, {q('greatest(lo, 0)/(cxx+cyy+czz+0.000001)', 5)} AS curvature FROM eig", "pts"))
def _(s, d):
    return rounded(stats.curvature(stats.covariance(X.points(s, d), 8)), "curvature", digits=5)


@query("normals", X.sql(f"{KN}, {_cov_sql(15)}, {_eigen_sql('cv', 'eig')} SELECT tree_id, point_id, {q('vert', 4)} AS verticality, true AS unit FROM eig", "pts"))
def _(s, d):
    """The normal's sign is arbitrary, so the size of its z is shown, and that its length is 1."""
    n = stats.normals(stats.covariance(X.points(s, d), 15))
    return rounded(n.withColumn("unit", F.abs(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz") - 1) < 1e-6), "verticality", digits=4).select("tree_id", "point_id", "verticality", "unit")


@query("point_features", X.sql(f"{KN}, {_cov_sql(15)}, {_cov_sql(10, 'cw')}, {_eigen_sql('cv', 'eig')}, {_eigen_sql('cw', 'eiw')}, dn AS (SELECT tree_id, point_id, count(*) density FROM pr WHERE d <= 1.0 GROUP BY tree_id, point_id) SELECT a.tree_id, a.point_id, {q('a.vert', 4)} AS verticality, {q('greatest(b.lo, 0)/(b.cxx+b.cyy+b.czz+0.000001)', 5)} AS curvature, density FROM eig a JOIN eiw b ON a.tree_id = b.tree_id AND a.point_id = b.point_id JOIN dn ON a.tree_id = dn.tree_id AND a.point_id = dn.point_id", "pts"))
def _(s, d):
    out = stats.add_features(X.points(s, d), radius=1.0)
    return rounded(rounded(out, "verticality", digits=4), "curvature", digits=5).select("tree_id", "point_id", "verticality", "curvature", "density")


@query("idw_interpolate", X.sql(f"t AS (SELECT a.tree_id, a.point_id, b.f0, {DIST} d, row_number() OVER (PARTITION BY a.tree_id, a.point_id ORDER BY {DIST}, b.point_id) rk FROM pts a JOIN pts b ON a.tree_id = b.tree_id WHERE a.point_id % 2 = 0 AND b.point_id % 2 = 1) SELECT tree_id, point_id, {q('sum(f0/greatest(d*d, 0.000001))/sum(1/greatest(d*d, 0.000001))')} AS f0 FROM t WHERE rk <= 3 GROUP BY tree_id, point_id", "pts"))
def _(s, d):
    p = X.points(s, d)
    return rounded(neighbours.interpolate(p.filter("point_id % 2 = 0"), p.filter("point_id % 2 = 1"), "f0"), "f0")


@query("ball_query_capped", X.sql(f"c AS (SELECT a.tree_id, a.point_id, b.point_id other_id, {DIST} d FROM pts a JOIN pts b ON a.tree_id = b.tree_id WHERE a.point_id % 5 = 0 AND b.point_id % 5 <> 0), i AS (SELECT *, row_number() OVER (PARTITION BY tree_id, point_id ORDER BY other_id) - 1 slot FROM c WHERE d <= 1.5), f AS (SELECT tree_id, point_id, coalesce(min(CASE WHEN d <= 1.5 THEN other_id END), min_by(other_id, d)) first_id, count(*) FILTER (WHERE d <= 1.5) n FROM c GROUP BY tree_id, point_id), s AS (SELECT tree_id, point_id, first_id, n, unnest(range(4)) slot FROM f) SELECT s.tree_id, s.point_id, CAST(s.slot AS INT) AS slot, coalesce(i.other_id, s.first_id) AS other_id FROM s LEFT JOIN i ON i.tree_id = s.tree_id AND i.point_id = s.point_id AND i.slot = s.slot", "pts"))
def _(s, d):
    p = X.points(s, d)
    return neighbours.ball_query(p.filter("point_id % 5 = 0"), p.filter("point_id % 5 <> 0"), 1.5, 4)


@query("ball_query_all", X.sql(f"near AS (SELECT a.tree_id, a.point_id, b.point_id other_id, row_number() OVER (PARTITION BY a.tree_id, a.point_id ORDER BY b.point_id) - 1 slot FROM pts a JOIN pts b ON a.tree_id = b.tree_id WHERE {DIST} <= 1.5), k AS (SELECT tree_id, point_id, count(*) n, min(other_id) f FROM near GROUP BY tree_id, point_id) SELECT tree_id, point_id, CAST(slot AS INT) AS slot, other_id FROM near WHERE slot < 4 UNION ALL SELECT tree_id, point_id, CAST(s AS INT), f FROM k, range(4) r(s) WHERE s >= n", "pts"))
def _(s, d):
    """Every point as a centre, against every point."""
    p = X.points(s, d)
    return neighbours.ball_query(p, p, 1.5, 4)


@query("square_distances", X.sql(f"SELECT a.tree_id, a.point_id, count(*) AS n, {q('sum((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))', 4)} AS d2 FROM pts a JOIN pts b ON a.tree_id = b.tree_id GROUP BY a.tree_id, a.point_id", "pts"))
def _(s, d):
    p = X.points(s, d)
    return rounded(neighbours.square_distances(p, p).groupBy("tree_id", "point_id").agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("d2")), "d2", digits=4)


@query("segment_near_cylinders", X.sql("SELECT tree_id, point_id FROM near WHERE distance < 0.15", "pts", "cyl", "near"))
def _(s, d):
    return neighbours.near_cylinders(X.points(s, d), X.cylinders(s, d), 0.15).select("tree_id", "point_id")


@query("merge_candidates", X.sql(f"c AS (SELECT a.tree_id, a.point_id, b.point_id other_id, {DIST} d, acos(least(1, greatest(-1, (a.dx*b.dx+a.dy*b.dy+a.dz*b.dz)/(sqrt(a.dx*a.dx+a.dy*a.dy+a.dz*a.dz)*sqrt(b.dx*b.dx+b.dy*b.dy+b.dz*b.dz))))) g FROM pts a JOIN pts b ON a.tree_id = b.tree_id AND a.point_id <> b.point_id) SELECT tree_id, point_id, min_by(other_id, d) AS other_id, {q('min(d)')} AS d FROM c WHERE d < 1.5 AND g < 0.7 GROUP BY tree_id, point_id", "pts"))
def _(s, d):
    p = X.points(s, d).withColumn("radius", F.lit(0.05)).withColumnsRenamed({"dx": "ux", "dy": "uy", "dz": "uz"})
    return rounded(neighbours.merge_candidates(p, p, 1.5, 0.7), "d").select("tree_id", "point_id", "other_id", "d")


@query("merge_candidates_effective", X.sql(f"c AS (SELECT a.tree_id, a.point_id, b.point_id other_id, greatest(0, {DIST} - 0.5) d, acos(least(1, greatest(-1, (a.dx*b.dx+a.dy*b.dy+a.dz*b.dz)/(sqrt(a.dx*a.dx+a.dy*a.dy+a.dz*a.dz)*sqrt(b.dx*b.dx+b.dy*b.dy+b.dz*b.dz))))) g FROM pts a JOIN pts b ON a.tree_id = b.tree_id AND a.point_id <> b.point_id), o AS (SELECT *, row_number() OVER (PARTITION BY tree_id, point_id ORDER BY d, other_id) k FROM c WHERE d < 1.5 AND g < 0.7) SELECT tree_id, point_id, other_id, {q('d')} AS d FROM o WHERE k = 1", "pts"))
def _(s, d):
    """By the distance between surfaces, not below 0."""
    p = X.points(s, d).withColumn("radius", F.lit(0.25)).withColumnsRenamed({"dx": "ux", "dy": "uy", "dz": "uz"})
    return rounded(neighbours.merge_candidates(p, p, 1.5, 0.7, effective=True), "d").select("tree_id", "point_id", "other_id", "d")


@query("sphere_assignment", X.sql(f"SELECT b.tree_id, a.point_id AS sphere_id, b.point_id, {q(DIST)} AS d, {DIST} > 0.5 AS shell FROM pts a JOIN pts b ON a.tree_id = b.tree_id WHERE a.point_id % 10 = 0 AND {DIST} <= 1.5", "pts"))
def _(s, d):
    p = X.points(s, d)
    sp = p.filter("point_id % 10 = 0").select("tree_id", F.col("point_id").alias("sphere_id"), "x", "y", "z", F.lit(1.5).alias("radius"))
    return rounded(qsm.sphere_assignment(p, sp, 1.0), "d")


@query("sphere_assignment_all", X.sql(f"SELECT b.tree_id, a.point_id AS sphere_id, b.point_id, {q(DIST)} AS d, {DIST} > 0.5 AS shell FROM pts a JOIN pts b ON a.tree_id = b.tree_id WHERE {DIST} <= 1.5", "pts"))
def _(s, d):
    """Every point as a sphere, against every point."""
    p = X.points(s, d)
    sp = p.select("tree_id", F.col("point_id").alias("sphere_id"), "x", "y", "z", F.lit(1.5).alias("radius"))
    return rounded(qsm.sphere_assignment(p, sp, 1.0), "d")


RADII = "0.1 * power(3, a.point_id % 5)"


@query("sphere_assignment_radii", X.sql(f"SELECT b.tree_id, a.point_id AS sphere_id, b.point_id, {q(DIST)} AS d, {DIST} > {RADII} - 0.2 AS shell FROM pts a JOIN pts b ON a.tree_id = b.tree_id WHERE {DIST} <= {RADII}", "pts"))
def _(s, d):
    """Spheres of 0.1 to 8.1: five levels of cells."""
    p = X.points(s, d)
    sp = p.select("tree_id", F.col("point_id").alias("sphere_id"), "x", "y", "z", F.expr("cast(0.1 as double) * power(3, point_id % 5)").alias("radius"))
    return rounded(qsm.sphere_assignment(p, sp, 0.2), "d")


@query("anti_join_segmented", X.sql("SELECT tree_id, point_id FROM pts WHERE NOT (l0 >= l1)", "pts"))
def _(s, d):
    p = X.points(s, d)
    return points.mark_segmented(p, points.denoise(p)).select("tree_id", "point_id")


@query("noise_override", X.sql(f"SELECT tree_id, point_id, CASE WHEN point_id % 3 = 0 THEN 1 ELSE CAST({NORM} > 0.2 AS INT) END AS is_noise FROM pts", "pts"))
def _(s, d):
    p = points.offset_labels(X.points(s, d), 0.2)
    return points.override_noise(p, p.filter("point_id % 3 = 0").withColumn("is_noise", F.lit(1))).select("tree_id", "point_id", "is_noise")


@query("prefix_match", X.sql("SELECT cloud, min_by(model, length(model) * 1000000 + rn) AS model, min(length(model) - length(cloud)) AS extra FROM (SELECT cloud, model, row_number() OVER (ORDER BY model) rn FROM (SELECT DISTINCT cloud FROM clouds) JOIN models ON starts_with(model, cloud)) GROUP BY cloud", "nm"))
def _(s, d):
    c, m = X.names(s, d)
    return neighbours.match_by_prefix(c.distinct(), m).select("cloud", "model", F.col("extra").cast("long").alias("extra"))


@query("parts_match", X.sql("m AS (SELECT array_to_string(string_split(model, '_')[1:2], '_') k, min(model) model FROM models GROUP BY 1) SELECT cloud, model FROM clouds JOIN m ON array_to_string(string_split(cloud, '_')[1:2], '_') = k", "nm"))
def _(s, d):
    return neighbours.match_by_parts(*X.names(s, d), parts=2)


@query("count_match", X.sql("n AS (SELECT tree_id, count(*) n FROM ev GROUP BY tree_id) SELECT a.tree_id, min(b.tree_id) AS other_tree, a.n FROM n a JOIN n b ON a.n = b.n GROUP BY a.tree_id, a.n", "ev"))
def _(s, d):
    p = X.event_points(s, d)
    return neighbours.match_by_count(p, p)


# -- statistics

@query("circle_fit", X.sql(f"""m AS (SELECT tree_id, avg(x) mx, avg(y) my FROM pts GROUP BY tree_id), a AS (SELECT p.tree_id, mx, my, x-mx a, y-my b FROM pts p JOIN m ON p.tree_id = m.tree_id),
s AS (SELECT tree_id, count(*) n, any_value(mx) mx, any_value(my) my, sum(a*a) aa, sum(b*b) bb, sum(a*b) ab, sum(a*(a*a+b*b)) aq, sum(b*(a*a+b*b)) bq, sum(a*a+b*b) q FROM a GROUP BY tree_id),
c AS (SELECT *, (aq*bb-bq*ab)/(2*(aa*bb-ab*ab)) cx, (bq*aa-aq*ab)/(2*(aa*bb-ab*ab)) cy FROM s) SELECT tree_id, n, {q('cx+mx')} AS cx, {q('cy+my')} AS cy, {q('sqrt(q/n+cx*cx+cy*cy)')} AS r FROM c""", "pts"))  # fmt: skip
def _(s, d):
    return rounded(stats.fit_circles(X.points(s, d), ["tree_id"]), "cx", "cy", "r")


def _circle_sql(source: str, by: str, name: str) -> str:
    """name: circle fits (n, mx, my, cx, cy relative to the mean, r) of the rows of source by its columns `by`."""
    on = " AND ".join(f"p.{k} = m.{k}" for k in by.split(", "))
    det, scale = "(aa*bb-ab*ab)", "((aa+bb)*(aa+bb))"
    return f"""{name}1 AS (SELECT {by}, avg(x) mx, avg(y) my FROM {source} GROUP BY {by}), {name}2 AS (SELECT p.*, mx, my, x-mx a, y-my b FROM {source} p JOIN {name}1 m ON {on}),
{name}3 AS (SELECT {by}, count(*) n, any_value(mx) mx, any_value(my) my, sum(a*a) aa, sum(b*b) bb, sum(a*b) ab, sum(a*(a*a+b*b)) aq, sum(b*(a*a+b*b)) bq, sum(a*a+b*b) q FROM {name}2 GROUP BY {by}),
{name}4 AS (SELECT *, CASE WHEN n >= 3 AND {det} > {scale}*1e-12 THEN (aq*bb-bq*ab)/(2*{det}) END ux, CASE WHEN n >= 3 AND {det} > {scale}*1e-12 THEN (bq*aa-aq*ab)/(2*{det}) END uy FROM {name}3),
{name} AS (SELECT *, ux+mx cx, uy+my cy, CASE WHEN q/n+ux*ux+uy*uy >= 0 THEN sqrt(q/n+ux*ux+uy*uy) END r FROM {name}4)"""


@query("circle_fit_subsampled", X.sql(f"s AS (SELECT p.tree_id, fit, x, y, row_number() OVER (PARTITION BY p.tree_id, fit ORDER BY (point_id*7919 + fit*104729) % 10007, point_id) k, count(*) OVER (PARTITION BY p.tree_id, fit) n FROM pts p, range(10) f(fit)), t AS (SELECT tree_id, fit, x, y FROM s WHERE k <= floor(n*0.8)), {_circle_sql('t', 'tree_id, fit', 'c')}, {_circle_sql('pts', 'tree_id', 'w')}, a AS (SELECT tree_id, avg(cx) sx, avg(cy) sy, avg(r) sr, count(r) n_fits FROM c GROUP BY tree_id) SELECT w.tree_id, w.n, n_fits, {q('coalesce(sx, cx)')} AS cx, {q('coalesce(sy, cy)')} AS cy, {q('coalesce(sr, r)')} AS r FROM w LEFT JOIN a ON w.tree_id = a.tree_id", "pts"))
def _(s, d):
    return rounded(stats.subsampled_circles(X.points(s, d), ["tree_id"], F.expr("(point_id * 7919 + fit * 104729) % 10007"), 10, 0.8), "cx", "cy", "r")


def _stem_sql() -> str:
    heights = [0.10 + i * 0.10 for i in range(4)]
    pick = "CASE " + " ".join(f"WHEN count(*) FILTER (WHERE up < CAST({h!r} AS DOUBLE)) >= 3 THEN CAST({h!r} AS DOUBLE)" for h in heights) + f" ELSE CAST({heights[-1]!r} AS DOUBLE) END"
    return f"""b AS (SELECT tree_id, min(z) bz FROM ev GROUP BY tree_id), nr AS (SELECT e.*, bz, z-bz up FROM ev e JOIN b ON e.tree_id = b.tree_id WHERE z-bz < 0.5), pk AS (SELECT tree_id, {pick} slice FROM nr GROUP BY tree_id),
pt AS (SELECT nr.*, slice FROM nr JOIN pk ON nr.tree_id = pk.tree_id WHERE up < slice), {_circle_sql('pt', 'tree_id', 'c')} SELECT c.tree_id, {q('coalesce(cx, mx)', 4)} AS bx, {q('coalesce(cy, my)', 4)} AS "by", {q('bz')} AS bz, {q('slice')} AS slice, n FROM c JOIN b ON c.tree_id = b.tree_id JOIN pk ON c.tree_id = pk.tree_id"""


@query("stem_base_cloud", X.sql(_stem_sql(), "ev"))
def _(s, d):
    return rounded(rounded(stats.stem_base(X.event_points(s, d)), "bx", "by", digits=4), "bz", "slice")


@query("stem_base_qsm", X.sql(f"r AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY sz, id) k FROM cyl) SELECT tree_id, {q('sx')} AS bx, {q('sy')} AS \"by\", {q('sz')} AS bz FROM r WHERE k = 1", "cyl"))
def _(s, d):
    return rounded(stats.model_base(X.cylinders(s, d)), "bx", "by", "bz")


@query("stem_base_branches", X.sql(f"o AS (SELECT *, id % 3 AS b FROM cyl), r AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY CASE WHEN b = 0 THEN 0 ELSE 1 END, sz, id) k FROM o WHERE NOT (tree_id < 5 AND b = 0)) SELECT tree_id, {q('sx')} AS bx, {q('sy')} AS \"by\", {q('sz')} AS bz FROM r WHERE k = 1", "cyl"))
def _(s, d):
    """Among branch order 0 where a tree has one; half of the trees have none."""
    c = X.cylinders(s, d).withColumn("branch_order", F.col("id") % 3).filter("not (tree_id < 5 and branch_order = 0)")
    return rounded(stats.model_base(c, "branch_order"), "bx", "by", "bz")


@query("qsm_align", X.sql(f"r AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY sz, id) k FROM cyl), b AS (SELECT tree_id, min_by(x, z) bx, min_by(y, z) bky, min(z) bz FROM pts GROUP BY tree_id), t AS (SELECT r.tree_id, r.sx-bx tx, r.sy-bky ty, r.sz-bz tz FROM r JOIN b ON r.tree_id = b.tree_id WHERE k = 1) SELECT c.tree_id, id, {q('sx-tx')} AS sx, {q('sy-ty')} AS sy, {q('ez-tz')} AS ez FROM cyl c JOIN t ON c.tree_id = t.tree_id", "pts", "cyl"))
def _(s, d):
    low = X.points(s, d).groupBy("tree_id").agg(F.min(F.struct("z", "x", "y")).alias("m")).select("tree_id", F.col("m.x").alias("bx"), F.col("m.y").alias("by"), F.col("m.z").alias("bz"))
    return rounded(stats.align_model(X.cylinders(s, d), X.points(s, d), low), "sx", "sy", "ez").select("tree_id", "id", "sx", "sy", "ez")


EDGES = stats.DISTANCE_EDGES


def _bin_sql(v: str) -> str:
    cases = " ".join(f"WHEN {v} >= {EDGES[i]} AND {v} < {EDGES[i + 1] if EDGES[i + 1] != float('inf') else 1e308} THEN {i}" for i in range(len(EDGES) - 1))
    return f"CASE {cases} END"


@query("binned_distance", X.sql(f"o AS (SELECT {_bin_sql(NORM)} bin, n.distance v FROM pts p JOIN near n ON p.tree_id = n.tree_id AND p.point_id = n.point_id), g AS (SELECT bin, count(*) n, avg(v) m, stddev_pop(v) s FROM o GROUP BY bin) SELECT CAST(b.i AS INT) AS bin, coalesce(n, 0) AS n, {q('m')} AS mean, {q('s')} AS std FROM range({len(EDGES) - 1}) b(i) LEFT JOIN g ON g.bin = b.i", "pts", "cyl", "near"))
def _(s, d):
    p = X.points(s, d)
    both = points.offset_labels(p, 0.2).join(neighbours.nearest_cylinder(p, X.cylinders(s, d)), ["tree_id", "point_id"])
    return rounded(stats.binned(both, "offset_norm", "distance", EDGES), "mean", "std")


@query("log_bins", X.sql(f"b AS (SELECT min({NORM}) lo, max({NORM}) hi FROM pts) SELECT round(e, 9) AS edge FROM (SELECT m * pow(10, o) e FROM (VALUES (1),(2),(5)) a(m), range(-8, 8) r(o), b WHERE m * pow(10, o) > lo AND m * pow(10, o) < hi UNION SELECT lo FROM b UNION SELECT hi FROM b)", "pts"))
def _(s, d):
    """Edges over the span of the table's offsets."""
    low, high = X.points(s, d).select(F.sqrt(sum(F.col(f"d{k}") * F.col(f"d{k}") for k in "xyz")).alias("v")).agg(F.min("v"), F.max("v")).first()
    return stats.log_bins(s, low, high).select(F.round("edge", 9).alias("edge"))


@query("power_law_fit", X.sql(f"""v AS (SELECT ln(greatest(p_size, 1e-8)) lx, ln(greatest(CAST(p_retailprice AS DOUBLE), 1e-8)) ly FROM part), s AS (SELECT count(*) n, regr_slope(ly, lx) b, regr_intercept(ly, lx) la, regr_sxx(ly, lx) sxx, regr_syy(ly, lx) syy, avg(lx) mx FROM v),
t AS (SELECT *, greatest(0, syy-b*b*sxx)/(n-2) v FROM s) SELECT n, {q('exp(la)')} AS a, {q('b')} AS b, {q('exp(la)*sqrt(v*(1.0/n+mx*mx/sxx))')} AS a_err, {q('sqrt(v/sxx)')} AS b_err FROM t""", "cyl"))  # fmt: skip
def _(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    return rounded(stats.power_law(p, "x", "y"), "a", "b", "a_err", "b_err")


def _power_sql(source: str, x: str, y: str) -> str:
    return f"""pw AS (SELECT ln(greatest({x}, 1e-8)) lx, ln(greatest({y}, 1e-8)) ly FROM {source}), ps AS (SELECT count(*) n_all, regr_slope(ly, lx) b, regr_intercept(ly, lx) la, regr_sxx(ly, lx) sxx, regr_syy(ly, lx) syy, avg(lx) mx FROM pw),
pf AS (SELECT n_all, {q('exp(la)', 5)} a, {q('b', 5)} b, {q('exp(la)*sqrt(v*(1.0/n_all+mx*mx/sxx))', 5)} a_err, {q('sqrt(v/sxx)', 5)} b_err FROM (SELECT *, greatest(0, syy-b*b*sxx)/(n_all-2) v FROM ps))"""


def _fitted(df):
    return rounded(rounded(df, "mean", "std", "centre"), "a", "b", "a_err", "b_err", digits=5).select("bin", "n", "mean", "std", "centre", "n_all", "a", "b", "a_err", "b_err")


NND = f"{KN}, moved AS (SELECT tree_id, point_id, x+dx x, y+dy y, z+dz z FROM pts), mn AS (SELECT a.tree_id, a.point_id, min({DIST}) v_b FROM moved a JOIN moved b ON a.tree_id = b.tree_id AND a.point_id <> b.point_id GROUP BY a.tree_id, a.point_id), nn AS (SELECT a.tree_id, a.point_id, min(d) v_a FROM pr a WHERE other_id <> point_id GROUP BY a.tree_id, a.point_id), o AS (SELECT v_a, v_b FROM nn JOIN mn ON nn.tree_id = mn.tree_id AND nn.point_id = mn.point_id)"
CENTRES = "CASE " + " ".join(f"WHEN i = {i} THEN CAST({m!r} AS DOUBLE)" for i, m in enumerate(stats.bin_centres(EDGES)) if m is not None) + " END"


@query("nnd_comparison", X.sql(f"{NND}, g AS (SELECT {_bin_sql('v_a')} bin, count(*) n, avg(v_b) m, stddev_pop(v_b) s FROM o GROUP BY 1), {_power_sql('o', 'v_a', 'v_b')} SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, {q('m')} AS mean, {q('s')} AS std, {q(CENTRES)} AS centre, n_all, a, b, a_err, b_err FROM range({len(EDGES) - 1}) r(i) LEFT JOIN g ON g.bin = i, pf", "pts"))
def _(s, d):
    return _fitted(evaluation.nnd_comparison(X.points(s, d)))


@query("tree_comparison", X.sql(f"SELECT p.tree_id, {q(f'avg({NORM})')} AS mean_a, {q('avg(n.distance)')} AS mean_b, count(*) AS n_a, {q(f'avg({NORM}) - avg(n.distance)')} AS gain FROM pts p JOIN near n ON p.tree_id = n.tree_id AND p.point_id = n.point_id GROUP BY p.tree_id", "pts", "cyl", "near"))
def _(s, d):
    p = X.points(s, d)
    a = points.offset_labels(p, 0.2).withColumnRenamed("offset_norm", "distance")
    return rounded(evaluation.tree_comparison(a, neighbours.nearest_cylinder(p, X.cylinders(s, d))), "mean_a", "mean_b", "gain").select("tree_id", "mean_a", "mean_b", "n_a", "gain")


SMALL_BOXES = [((-2.0, -2.0, -2.0), (2.0, 2.0, 2.0)), ((0.0, 0.0, -3.0), (3.0, 3.0, 3.0)), ((-4.0, -4.0, 0.0), (0.0, 4.0, 4.0))]


def _slices_sql() -> str:
    boxes = " UNION ALL ".join(f"SELECT tree_id, CAST({i} AS INT) slice, point_id, x, y, z, x+dx mx, y+dy my, z+dz mz FROM pts WHERE x BETWEEN {a[0]} AND {b[0]} AND y BETWEEN {a[1]} AND {b[1]} AND z BETWEEN {a[2]} AND {b[2]}" for i, (a, b) in enumerate(SMALL_BOXES))
    moved = "sqrt((a.mx-b.mx)*(a.mx-b.mx)+(a.my-b.my)*(a.my-b.my)+(a.mz-b.mz)*(a.mz-b.mz))"
    return f"""s AS ({boxes}), n AS (SELECT tree_id, slice, count(*) n FROM s GROUP BY tree_id, slice), d AS (SELECT a.tree_id, a.slice, a.point_id, min({DIST}) va, min({moved}) vb FROM s a JOIN s b ON a.tree_id = b.tree_id AND a.slice = b.slice AND a.point_id <> b.point_id GROUP BY a.tree_id, a.slice, a.point_id),
g AS (SELECT tree_id, slice, avg(va) ma, stddev_pop(va)/sqrt(count(va)) ea, avg(vb) mb, stddev_pop(vb)/sqrt(count(vb)) eb FROM d GROUP BY tree_id, slice) SELECT n.tree_id, n.slice, n, {q('ma')} AS mean_a, {q('ea')} AS sem_a, {q('mb')} AS mean_b, {q('eb')} AS sem_b FROM n LEFT JOIN g ON n.tree_id = g.tree_id AND n.slice = g.slice"""


@query("slice_report", X.sql(_slices_sql(), "pts"))
def _(s, d):
    return rounded(evaluation.slice_report(X.points(s, d), SMALL_BOXES), "mean_a", "sem_a", "mean_b", "sem_b").select("tree_id", "slice", "n", "mean_a", "sem_a", "mean_b", "sem_b")


@query("offset_bins", X.sql(f"o AS (SELECT {NORM} va, n.distance vb FROM pts p JOIN near n ON p.tree_id = n.tree_id AND p.point_id = n.point_id), top AS (SELECT max(va) hi FROM o), ed AS (SELECT 0.001 e UNION SELECT hi FROM top UNION SELECT m * pow(10, x) FROM (VALUES (1),(2),(5)) a(m), range(-4, 6) b(x), top WHERE m * pow(10, x) > 0.001 AND m * pow(10, x) < hi), bn AS (SELECT e lo, lead(e) OVER (ORDER BY e) up, CAST(row_number() OVER (ORDER BY e) - 1 AS INT) bin FROM ed), {_power_sql('o', 'va', 'vb')} SELECT bin, count(va) AS n, {q('avg(vb)')} AS mean, {q('stddev_pop(vb)')} AS std, {q('sqrt(any_value(lo)*any_value(up))')} AS centre, any_value(n_all) AS n_all, any_value(a) AS a, any_value(b) AS b, any_value(a_err) AS a_err, any_value(b_err) AS b_err FROM (SELECT * FROM bn, top WHERE up IS NOT NULL) bn LEFT JOIN o ON va >= lo AND (va < up OR (up = hi AND va <= up)), pf GROUP BY bin", "pts", "cyl", "near"))
def _(s, d):
    p = X.points(s, d)
    both = points.offset_labels(p, 0.2).join(neighbours.nearest_cylinder(p, X.cylinders(s, d)), ["tree_id", "point_id"])
    return _fitted(evaluation.offset_bins(both, "offset_norm", "distance", 0.001))


@query("mean_sem", X.sql(f"SELECT count(z) AS n, {q('avg(z)')} AS mean, {q('stddev_pop(z)/sqrt(count(z))')} AS sem, {q('stddev_pop(z)')} AS std FROM ev", "ev"))
def _(s, d):
    return rounded(stats.mean_error(X.event_points(s, d), "z"), "mean", "sem", "std")


@query("improvement", X.sql(f"SELECT count(*) AS n, {q('avg(o-n)')} AS mean, {q('stddev_pop(o-n)')} AS std FROM (SELECT {NORM} o, n.distance n FROM pts p JOIN near n ON p.tree_id = n.tree_id AND p.point_id = n.point_id)", "pts", "cyl", "near"))
def _(s, d):
    p = X.points(s, d)
    a = points.offset_labels(p, 0.2).select("tree_id", "point_id", F.col("offset_norm").alias("v"))
    b = neighbours.nearest_cylinder(p, X.cylinders(s, d)).select("tree_id", "point_id", F.col("distance").alias("v"))
    return rounded(stats.mean_error(neighbours.paired(a, b, "v").withColumn("gain", F.col("v_a") - F.col("v_b")), "gain"), "mean", "std").select("n", "mean", "std")


HM = "h AS (SELECT n.distance v, c.radius*100 rc, p.z + 6 hz FROM pts p JOIN near n ON p.tree_id = n.tree_id AND p.point_id = n.point_id JOIN cyl c ON c.tree_id = n.tree_id AND c.id = n.cylinder_id), b AS (SELECT v, CASE WHEN rc >= 0 AND rc < 1 THEN 0 WHEN rc < 2 AND rc >= 1 THEN 1 WHEN rc < 4 AND rc >= 2 THEN 2 WHEN rc < 8 AND rc >= 4 THEN 3 WHEN rc < 16 AND rc >= 8 THEN 4 WHEN rc < 32 AND rc >= 16 THEN 5 END radius_bin, CASE WHEN hz < 0 THEN NULL WHEN hz < 5 THEN 0 WHEN hz < 10 THEN 1 WHEN hz < 15 THEN 2 WHEN hz < 20 THEN 3 WHEN hz < 25 THEN 4 WHEN hz < 30 THEN 5 ELSE 6 END height_bin FROM h)"


def _heat(s, d, percentile=None):
    p, c = X.points(s, d), X.cylinders(s, d)
    n = neighbours.lookup(neighbours.nearest_cylinder(p, c), c).join(p.select("tree_id", "point_id", "z"), ["tree_id", "point_id"])
    return rounded(stats.heat_map(n, F.col("radius") * 100, F.col("z") + 6, "distance", percentile), "v")


@query("distance_heatmap_mean", X.sql(f"{HM} SELECT radius_bin, height_bin, count(*) AS n, {q('avg(v)')} AS v FROM b WHERE radius_bin IS NOT NULL AND height_bin IS NOT NULL GROUP BY radius_bin, height_bin", "pts", "cyl", "near"))
def _(s, d):
    return _heat(s, d)


@query("distance_heatmap_p95", X.sql(f"{HM} SELECT radius_bin, height_bin, count(*) AS n, {q('quantile_cont(v, 0.95)')} AS v FROM b WHERE radius_bin IS NOT NULL AND height_bin IS NOT NULL GROUP BY radius_bin, height_bin", "pts", "cyl", "near"))
def _(s, d):
    return _heat(s, d, 0.95)


@query("nnd_histogram", X.sql(f"{KN}, nd AS (SELECT tree_id, point_id, d FROM kn WHERE rk = 2), h AS (SELECT CAST(least(floor((d-0.0)/(3.0/30)), 29) AS INT) bin, count(*) n FROM nd WHERE d <= 3.0 GROUP BY 1) SELECT bin, n, {q('bin*(3.0/30)')} AS low_edge, {q('n/(sum(n) OVER ()*(3.0/30))')} AS density FROM h", "pts"))
def _(s, d):
    nd = stats.neighbour_distance(X.points(s, d), 1)
    return rounded(stats.histogram(nd, "mean_distance", 0.0, 3.0, 30), "low_edge", "density").select("bin", "n", "low_edge", "density")


@query("nnd_mode", X.sql(f"{KN}, h AS (SELECT CAST(least(floor(d/(3.0/30)), 29) AS INT) bin, count(*) n FROM kn WHERE rk = 2 AND d <= 3.0 GROUP BY 1) SELECT {q('bin*(3.0/30)')} AS mode, n FROM h ORDER BY n DESC, bin LIMIT 1", "pts"))
def _(s, d):
    return rounded(stats.histogram_mode(stats.histogram(stats.neighbour_distance(X.points(s, d), 1), "mean_distance", 0.0, 3.0, 30)), "mode")


@query("pointwise_loss", X.sql(f"SELECT count(*) AS n, {q('avg(ln(exp(l0)+exp(l1)) - CASE WHEN point_id % 2 = 1 THEN l1 ELSE l0 END)')} AS semantic_loss, {q(f'avg(sqrt(greatest(dx*dx+dy*dy+dz*dz, 1e-8))) FILTER (WHERE {NORM} <= 0.2)')} AS offset_loss FROM pts", "pts"))
def _(s, d):
    p = points.offset_labels(X.points(s, d), 0.2).withColumns({"label": F.expr("cast(point_id % 2 as int)"), "mask": F.col("offset_mask"), "tx": F.lit(0.0), "ty": F.lit(0.0), "tz": F.lit(0.0)})
    return rounded(stats.point_losses(p), "semantic_loss", "offset_loss")


@query("early_stop", X.sql(f"""e AS (SELECT tree_id run, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY point_id) AS INT) epoch, x loss FROM pts), b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM e),
i AS (SELECT *, max(CASE WHEN before IS NULL OR loss < before THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) improved FROM b), st AS (SELECT run, min(CASE WHEN epoch - improved >= 10 THEN epoch END) stop_epoch FROM i GROUP BY run)
SELECT i.run, {q('min(loss)')} AS best_loss, min_by(epoch, loss) AS best_epoch, any_value(stop_epoch) AS stop_epoch FROM i JOIN st ON i.run = st.run WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY i.run""", "pts"))  # fmt: skip
def _(s, d):
    from pyspark.sql import Window

    e = X.points(s, d).select(F.col("tree_id").alias("run"), F.row_number().over(Window.partitionBy("tree_id").orderBy("point_id")).alias("epoch"), F.col("x").alias("loss"))
    return rounded(stats.early_stop(e, 10), "best_loss")


@query("merge_spheres", X.sql(f"""w AS (SELECT *, point_id // 10 % 5 g, CAST(1 + point_id % 3 AS DOUBLE) w, 0.1 + abs(f0) rad FROM pts), m AS (SELECT tree_id, g, sum(w*x)/sum(w) mx, sum(w*y)/sum(w) my, sum(w*z)/sum(w) mz FROM w GROUP BY tree_id, g)
SELECT w.tree_id, w.g, {q('any_value(mx)')} AS x, {q('max(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))+rad)')} AS radius, sum(w) AS weight FROM w JOIN m ON w.tree_id = m.tree_id AND w.g = m.g GROUP BY w.tree_id, w.g""", "pts"))  # fmt: skip
def _(s, d):
    p = X.points(s, d).withColumns({"g": F.expr("point_id div 10 % 5"), "weight": F.expr("cast(1 + point_id % 3 as double)"), "radius": 0.1 + F.abs("f0"), "spread": F.abs("f0")})
    return rounded(stats.merge_spheres(p, ["tree_id", "g"], "enclosed"), "x", "radius").select("tree_id", "g", "x", "radius", "weight")


@query("merge_spheres_weighted", X.sql(f"""w AS (SELECT *, point_id // 10 % 5 g, CAST(1 + point_id % 3 AS DOUBLE) w, 0.1 + abs(f0) rad FROM pts)
SELECT tree_id, g, {q('sum(w*z)/sum(w)')} AS z, {q('sum(w*rad)/sum(w)')} AS radius, {q('max(rad)')} AS largest, {q('sum(w*abs(f0))/sum(w)')} AS spread FROM w GROUP BY tree_id, g""", "pts"))  # fmt: skip
def _(s, d):
    p = X.points(s, d).withColumns({"g": F.expr("point_id div 10 % 5"), "weight": F.expr("cast(1 + point_id % 3 as double)"), "radius": 0.1 + F.abs("f0"), "spread": F.abs("f0")})
    subset = stats.merge_spheres(p, ["tree_id", "g"], "subset").select("tree_id", "g", F.col("radius").alias("largest"))
    return rounded(stats.merge_spheres(p, ["tree_id", "g"], "weighted").join(subset, ["tree_id", "g"]), "z", "radius", "largest", "spread").select("tree_id", "g", "z", "radius", "largest", "spread")


@query("principal_axes", X.sql(f"cv AS (SELECT p.tree_id, {COVARIANCES} FROM pts p GROUP BY p.tree_id), {_eigen_sql('cv', 'eig')} SELECT tree_id, {q('hi', 5)} AS l0, {q('mid', 5)} AS l1, {q('lo', 5)} AS l2, {q('vert', 4)} AS verticality FROM eig", "pts"))
def _(s, d):
    out = stats.principal_axes(X.points(s, d), ["tree_id"]).withColumn("verticality", F.abs("nz"))
    return rounded(rounded(out, "l0", "l1", "l2", digits=5), "verticality", digits=4).select("tree_id", "l0", "l1", "l2", "verticality")


# -- hierarchy and clusters

WALK = "t AS (SELECT tree_id, id, radius, 0 lv FROM cyl WHERE parent_id IS NULL UNION ALL SELECT c.tree_id, c.id, greatest(least(c.radius, t.radius*1.05), t.radius*0.33), t.lv+1 FROM t JOIN cyl c ON c.tree_id = t.tree_id AND c.parent_id = t.id)"


@query("radius_correction", X.sql(f"{WALK} SELECT tree_id, id, {q('radius')} AS radius, lv AS level FROM t", "cyl", recursive=True))
def _(s, d):
    return rounded(hierarchy.correct_radii(X.cylinders(s, d), 0.33, 1.05), "radius").select("tree_id", "id", "radius", "level")


@query("radius_correction_connections", X.sql(f"{WALK.replace('greatest(least', 'CASE WHEN c.type = ' + chr(39) + 'connection' + chr(39) + ' THEN greatest(least').replace('t.radius*0.33)', 't.radius*0.33) ELSE c.radius END')} SELECT tree_id, id, {q('radius')} AS radius, lv AS level FROM t", "cyl", recursive=True))
def _(s, d):
    return rounded(hierarchy.correct_radii(X.cylinders(s, d), 0.33, 1.05, "connection"), "radius").select("tree_id", "id", "radius", "level")


@query("reroot", X.sql("e AS (SELECT tree_id, id a, parent_id b FROM cyl WHERE parent_id IS NOT NULL UNION ALL SELECT tree_id, parent_id, id FROM cyl WHERE parent_id IS NOT NULL), t AS (SELECT tree_id, max(id) id, CAST(NULL AS BIGINT) parent_id, 0 level FROM cyl GROUP BY tree_id UNION ALL SELECT t.tree_id, e.b, t.id, t.level+1 FROM t JOIN e ON e.tree_id = t.tree_id AND e.a = t.id AND e.b IS DISTINCT FROM t.parent_id) SELECT tree_id, id, parent_id, level FROM t", "cyl", recursive=True))
def _(s, d):
    c = X.cylinders(s, d)
    return hierarchy.reroot(c.select("tree_id", "id", "parent_id"), c.groupBy("tree_id").agg(F.max("id").alias("id")))


@query("roots", X.sql("SELECT tree_id, count(*) AS n FROM cyl WHERE parent_id IS NULL GROUP BY tree_id", "cyl"))
def _(s, d):
    return hierarchy.roots(X.cylinders(s, d)).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))


@query("children", X.sql("SELECT tree_id, parent_id AS id, count(*) AS n, min(id) AS first_child FROM cyl WHERE parent_id IS NOT NULL GROUP BY tree_id, parent_id", "cyl"))
def _(s, d):
    return hierarchy.children_of(X.cylinders(s, d)).filter("size(children_ids) > 0").select("tree_id", "id", F.size("children_ids").cast("long").alias("n"), F.col("children_ids")[0].alias("first_child"))


COMP = "e AS (SELECT a.tree_id, a.point_id a, b.point_id b FROM pts a JOIN pts b ON a.tree_id = b.tree_id WHERE " + DIST + " <= 1.2), t AS (SELECT tree_id, point_id, point_id reach FROM pts UNION SELECT t.tree_id, t.point_id, e.b FROM t JOIN e ON e.tree_id = t.tree_id AND e.a = t.reach), comp AS (SELECT tree_id, point_id, min(reach) component FROM t GROUP BY tree_id, point_id)"


@query("components", X.sql(f"{COMP} SELECT tree_id, point_id, component FROM comp", "pts", recursive=True))
def _(s, d):
    return cluster.linked_components(X.points(s, d), 1.2)


@query("seeded_growth", X.sql(f"{COMP}, n AS (SELECT tree_id, a point_id, count(*) n FROM e GROUP BY tree_id, a), g AS (SELECT DISTINCT comp.tree_id, component FROM comp JOIN n ON comp.tree_id = n.tree_id AND comp.point_id = n.point_id WHERE n >= 4) SELECT comp.tree_id, comp.point_id, CASE WHEN g.component IS NULL THEN -1 ELSE comp.component END AS label FROM comp LEFT JOIN g ON comp.tree_id = g.tree_id AND comp.component = g.component", "pts", recursive=True))
def _(s, d):
    return cluster.seeded_growth(X.points(s, d), 1.2, 4)


_DENSITY = "core AS (SELECT tree_id, a point_id FROM e GROUP BY tree_id, a HAVING count(*) >= 4), ce AS (SELECT e.* FROM e JOIN core x ON e.tree_id = x.tree_id AND e.a = x.point_id JOIN core y ON e.tree_id = y.tree_id AND e.b = y.point_id), t AS (SELECT tree_id, point_id, point_id reach FROM core UNION SELECT t.tree_id, t.point_id, ce.b FROM t JOIN ce ON ce.tree_id = t.tree_id AND ce.a = t.reach), lab AS (SELECT tree_id, point_id, min(reach) label FROM t GROUP BY tree_id, point_id), bord AS (SELECT e.tree_id, e.a point_id, min(label) label FROM e JOIN lab ON e.tree_id = lab.tree_id AND e.b = lab.point_id GROUP BY e.tree_id, e.a) SELECT p.tree_id, p.point_id, coalesce(lab.label, bord.label, -1) AS label FROM pts p LEFT JOIN lab ON p.tree_id = lab.tree_id AND p.point_id = lab.point_id LEFT JOIN bord ON p.tree_id = bord.tree_id AND p.point_id = bord.point_id"


@query("dbscan_labels", X.sql("e AS (SELECT a.tree_id, a.point_id a, b.point_id b FROM pts a JOIN pts b ON a.tree_id = b.tree_id WHERE " + DIST + " <= 1.5)," + _DENSITY, "pts", recursive=True))
def _(s, d):
    return cluster.dbscan(X.points(s, d), 1.5, 4)


_TURNS = "u AS (SELECT p.tree_id, point_id, (x-mx)/r ux, (y-my)/r uy, (z-mz)/r uz FROM (SELECT p.*, mx, my, mz, sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)) r FROM pts p JOIN (SELECT tree_id, avg(x) mx, avg(y) my, avg(z) mz FROM pts GROUP BY tree_id) m ON p.tree_id = m.tree_id) p), e AS (SELECT a.tree_id, a.point_id a, b.point_id b FROM u a JOIN u b ON a.tree_id = b.tree_id WHERE acos(least(1, greatest(-1, a.ux*b.ux+a.uy*b.uy+a.uz*b.uz))) <= 0.35), "


@query("cluster_directions", X.sql(_TURNS + _DENSITY, "pts", recursive=True))
def _(s, d):
    return cluster.cluster_directions(X.points(s, d), 0.35, 4)


@query("agglomerate_single", X.sql(f"{COMP}, n AS (SELECT tree_id, component, count(*) n FROM comp GROUP BY tree_id, component) SELECT comp.tree_id, point_id, CASE WHEN n >= 2 THEN comp.component ELSE -1 END AS label FROM comp JOIN n ON comp.tree_id = n.tree_id AND comp.component = n.component", "pts", recursive=True))
def _(s, d):
    return cluster.agglomerate(X.points(s, d), 1.2, "single", 2)


def _linkage_sql(threshold: float, how: str, rounds: int = 14) -> str:
    """c<rounds>: clusters by the mean or the largest distance. Each round joins the clusters that are each other's nearest: for linkages that only grow so, the result is that of joining one pair at a time."""
    out = [f"dd AS MATERIALIZED (SELECT a.tree_id, a.point_id p, b.point_id q, {DIST} d FROM pts a JOIN pts b ON a.tree_id = b.tree_id AND a.point_id <> b.point_id)", "c0 AS (SELECT tree_id, point_id, point_id k FROM pts)"]
    for i in range(rounds):
        out += [
            f"m{i} AS MATERIALIZED (SELECT dd.tree_id, a.k p, b.k q, {how}(d) d FROM dd JOIN c{i} a ON a.tree_id = dd.tree_id AND a.point_id = p JOIN c{i} b ON b.tree_id = dd.tree_id AND b.point_id = q WHERE a.k <> b.k GROUP BY dd.tree_id, a.k, b.k)",
            f"n{i} AS MATERIALIZED (SELECT tree_id, p, min_by(q, d) q, min(d) d FROM m{i} GROUP BY tree_id, p)",
            f"c{i + 1} AS MATERIALIZED (SELECT c.tree_id, c.point_id, CASE WHEN x.p IS NOT NULL THEN least(c.k, x.q) ELSE c.k END k FROM c{i} c LEFT JOIN (SELECT a.* FROM n{i} a JOIN n{i} b ON a.tree_id = b.tree_id AND a.p = b.q AND a.q = b.p WHERE a.d <= {threshold}) x ON x.tree_id = c.tree_id AND x.p = c.k)",
        ]
    return ",\n".join(out)


_LINKED = "s AS (SELECT tree_id, k, count(*) n FROM c14 GROUP BY tree_id, k) SELECT c.tree_id, point_id, CASE WHEN n >= 2 THEN c.k ELSE -1 END AS label FROM c14 c JOIN s ON s.tree_id = c.tree_id AND s.k = c.k"


@query("agglomerate_complete", X.sql(f"{_linkage_sql(2.0, 'max')}, {_LINKED}", "pts"))
def _(s, d):
    return cluster.agglomerate(X.points(s, d), 2.0, "complete", 2)


@query("agglomerate", X.sql(f"{_linkage_sql(2.0, 'avg')}, {_LINKED}", "pts"))
def _(s, d):
    return cluster.agglomerate(X.points(s, d), 2.0, "average", 2)


def _fps_sql(n: int) -> str:
    """picks: the places of farthest-point sampling (tree_id, point_id, pick), unrolled."""
    gap = "(p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)+(p.z-c.z)*(p.z-c.z)"
    out = ["k0 AS MATERIALIZED (SELECT tree_id, min(point_id) point_id FROM pts GROUP BY tree_id)"]
    for i in range(n - 1):
        before = f"least(p.d, {gap})" if i else gap
        out.append(f"d{i} AS MATERIALIZED (SELECT p.tree_id, p.point_id, p.x, p.y, p.z, {before} d FROM {f'd{i - 1}' if i else 'pts'} p JOIN k{i} k ON k.tree_id = p.tree_id JOIN pts c ON c.tree_id = k.tree_id AND c.point_id = k.point_id)")
        out.append(f"k{i + 1} AS MATERIALIZED (SELECT tree_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY d DESC, point_id) rk, count(*) OVER (PARTITION BY tree_id) n FROM d{i}) WHERE rk = 1 AND n > {i + 1})")
    return ",\n".join(out) + ", picks AS (" + " UNION ALL ".join(f"SELECT tree_id, point_id, {i} pick FROM k{i}" for i in range(n)) + ")"


@query("fps", X.sql(f"{_fps_sql(8)} SELECT tree_id, point_id, CAST(pick AS BIGINT) AS pick FROM picks", "pts"))
def _(s, d):
    return cluster.farthest_points(X.points(s, d), 8)


def _group_sql(n: int, scales: list[tuple[float, int]]) -> str:
    """Balls around the sampled centres, filled up with their first point: the largest f0 and the mean place."""
    parts = []
    for i, (radius, most) in enumerate(scales):
        fill = lambda k: f"(sum(b{k}) + ({most} - count(*)) * min_by(b{k}, slot)) / {most}"  # noqa: B023, E731
        parts.append(f"SELECT tree_id, point_id, CAST({i} AS INT) scale, max(f0) max_v, {fill('x')} mean_x, {fill('y')} mean_y, {fill('z')} mean_z FROM (SELECT c.tree_id, c.point_id, p.f0, p.x-c.x bx, p.y-c.y \"by\", p.z-c.z bz, row_number() OVER (PARTITION BY c.tree_id, c.point_id ORDER BY p.point_id) slot FROM centres c JOIN pts p ON c.tree_id = p.tree_id WHERE sqrt((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)+(c.z-p.z)*(c.z-p.z)) <= {radius}) WHERE slot <= {most} GROUP BY tree_id, point_id".replace("sum(by)", 'sum("by")').replace("min_by(by,", 'min_by("by",'))
    return f"{_fps_sql(n)}, centres AS (SELECT p.tree_id, p.point_id, x, y, z FROM picks k JOIN pts p ON p.tree_id = k.tree_id AND p.point_id = k.point_id), gr AS ({' UNION ALL '.join(parts)}) SELECT tree_id, point_id, scale, {q('max_v')} AS max_v, {q('mean_x')} AS mean_x, {q('mean_y')} AS mean_y, {q('mean_z')} AS mean_z FROM gr"


SCALES = [(1.0, 4), (2.0, 8), (4.0, 16)]


@query("sample_and_group", X.sql(_group_sql(8, [(2.0, 8)]).replace("scale, round", "round"), "pts"))
def _(s, d):
    return rounded(cluster.sample_and_group(X.points(s, d), 8, 2.0, 8, "f0"), "max_v", "mean_x", "mean_y", "mean_z").select("tree_id", "point_id", "max_v", "mean_x", "mean_y", "mean_z")


@query("sample_and_group_scales", X.sql(_group_sql(8, SCALES), "pts"))
def _(s, d):
    return rounded(cluster.sample_and_group_scales(X.points(s, d), 8, SCALES, "f0"), "max_v", "mean_x", "mean_y", "mean_z").select("tree_id", "point_id", "scale", "max_v", "mean_x", "mean_y", "mean_z")


@query("outer_spheres", X.sql("SELECT tree_id, id AS sphere_id FROM cyl WHERE NOT EXISTS (SELECT 1 FROM cyl k WHERE k.tree_id = cyl.tree_id AND k.parent_id = cyl.id)", "cyl"))
def _(s, d):
    return qsm.outer_spheres(X.cylinders(s, d).select("tree_id", F.col("id").alias("sphere_id"), "parent_id", F.col("sz").alias("z")))


# -- sampling, names, generation


@query("split_random", X.sql("n AS (SELECT *, row_number() OVER (ORDER BY (k*7919) % 10007, tree_id) rk, count(*) OVER () n FROM tr) SELECT tree_id, CASE WHEN rk <= ceil(n*0.15) THEN 'test' ELSE 'train' END AS split FROM n", "tr"))
def _(s, d):
    return sampling.split_random(X.trees(s, d), F.expr("(k*7919) % 10007")).select("tree_id", "split")


@query("split_plot", X.sql("f AS (SELECT DISTINCT left(tree_id, 1) fold FROM tr) SELECT tree_id, fold, CASE WHEN left(tree_id, 1) = fold THEN 'test' ELSE 'train' END AS split FROM tr, f", "tr"))
def _(s, d):
    return sampling.split_plots(X.trees(s, d)).select("tree_id", "fold", "split")


@query("stratified_sample", X.sql("n AS (SELECT *, left(tree_id, 1) stratum, row_number() OVER (PARTITION BY left(tree_id, 1) ORDER BY (k*7919) % 10007, tree_id) rk FROM tr) SELECT tree_id, stratum FROM n WHERE rk <= 10", "tr"))
def _(s, d):
    return sampling.stratified(X.trees(s, d), F.expr("(k*7919) % 10007"), 10, F.substring("tree_id", 1, 1)).select("tree_id", "stratum")


@query("simple_sample", X.sql("SELECT tree_id FROM tr ORDER BY (k*104729) % 10007, tree_id LIMIT 40", "tr"))
def _(s, d):
    return sampling.first_n(X.trees(s, d), F.expr("(k*104729) % 10007"), 40).select("tree_id")


@query("clean_names", X.sql("SELECT model, regexp_replace(model, '[^0-9_]', '', 'g') AS clean, string_split(model, '_')[1] || '_' || string_split(model, '_')[2] AS tree_key FROM models", "nm"))
def _(s, d):
    return X.names(s, d)[1].select("model", G.keep_digits(F.col("model")).alias("clean"), G.tree_key(F.col("model")).alias("tree_key"))


@query("alias_resolve", X.sql(f"SELECT id, {q('sx')} AS sx, {q('ez')} AS ez, {q('radius')} AS radius FROM cyl", "cyl"))
def _(s, d):
    c = X.cylinders(s, d)
    raw = c.select(F.col("id").cast("string").alias(' "ID"'), *(F.col(a).cast("string").alias(b) for a, b in (("sx", "start.x"), ("sy", "start.y"), ("sz", "start.z"), ("ex", "endX "), ("ey", "endY"), ("ez", "endZ"), ("radius", "Radius"))))
    return rounded(readers.standardise_cylinders(raw), "sx", "ez", "radius").select("id", "sx", "ez", "radius")


@query("upsample_iterations", X.sql("n AS (SELECT tree_id, count(*) n FROM ev GROUP BY tree_id) SELECT tree_id, n, CAST(least(greatest(ceil((5000-n)/CAST(n AS DOUBLE)), 0), 10) AS INT) AS added, CAST(least(greatest(ceil(log2(5000.0/n)), 0), 10) AS INT) AS doubled FROM n", "ev"))
def _(s, d):
    n = X.event_points(s, d).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("tree_id", "n", sampling.upsample_rounds(F.col("n"), 5000, 10, True).alias("added"), sampling.upsample_rounds(F.col("n"), 5000, 10, False).alias("doubled"))


@query("midpoint_upsample", X.sql(f"{KN}, c AS (SELECT *, row_number() OVER (PARTITION BY tree_id, point_id ORDER BY d, other_id) - 1 k, count(*) OVER (PARTITION BY tree_id, point_id) m FROM kn WHERE rk <= 6 AND d > 1e-9) SELECT a.tree_id, a.point_id, {q('(a.x+b.x)/2')} AS x, {q('(a.y+b.y)/2')} AS y, {q('(a.z+b.z)/2')} AS z FROM c JOIN pts a ON a.tree_id = c.tree_id AND a.point_id = c.point_id JOIN pts b ON b.tree_id = c.tree_id AND b.point_id = c.other_id WHERE k = (c.point_id*7919) % m", "pts"))
def _(s, d):
    p = X.points(s, d)
    top = p.groupBy("tree_id").agg((F.max("point_id") + 1).alias("top"))
    up = sampling.upsample(p, 5, 1, pick=F.col("point_id") * 7919).filter("born = 1").join(top, "tree_id")
    return rounded(up.withColumn("point_id", F.col("point_id") - F.col("top")), "x", "y", "z").select("tree_id", "point_id", "x", "y", "z")


@query("noise_point_counts", X.sql(f"e AS (SELECT tree_id, min(sz) lo, max(sz) hi FROM cyl GROUP BY tree_id), r AS (SELECT c.tree_id, id, radius, {LEN} len, 50*(1-0.75*pow((sz-lo)/(hi-lo), 0.33)) rho FROM cyl c JOIN e ON c.tree_id = e.tree_id) SELECT tree_id, id, CAST(floor(2*pi()*radius*rho)*floor(len*rho) AS BIGINT) AS n FROM r", "cyl"))
def _(s, d):
    return sampling.noise_counts(X.cylinders(s, d)).select("tree_id", "id", "n")


@query("noisy_cloud")
def _(s, d):
    return sampling.noisy_cloud(X.cylinders(s, d))


def _surface_sql(n: int, sigma: float) -> str:
    part = lambda a, b: f"(((k + 1) * CAST({a} AS DOUBLE) + id * CAST({b} AS DOUBLE)) % 1)"
    turn, up, size, way = (part(*w) for w in sampling.WEYL)
    return f"""u AS (SELECT *, {LEN} len, (ex-sx)/{LEN} ux, (ey-sy)/{LEN} uy, (ez-sz)/{LEN} uz FROM cyl, range({n}) r(k)),
g AS (SELECT *, 2 * pi() * {turn} a, len * {up} t, {sigma} * sqrt(-2 * ln(1 - {size})) * cos(2 * pi() * {way}) g FROM u),
o AS (SELECT *, cos(a) * (1 - ux*ux/(1+uz)) - sin(a) * ux*uy/(1+uz) ox, sin(a) * (1 - uy*uy/(1+uz)) - cos(a) * ux*uy/(1+uz) oy, -cos(a) * ux - sin(a) * uy oz FROM g)
SELECT tree_id, id AS cylinder_id, k, {", ".join(f"{q(f's{c} + t * u{c} + (radius + g) * o{c}')} AS {c}, {q(f'-g * o{c}')} AS d{c}" for c in "xyz")} FROM o"""


@query("ideal_cylinder", X.sql(_surface_sql(10, 0.02), "cyl"))
def _(s, d):
    """Points around every cylinder of the table, with exact offsets."""
    return rounded(sampling.surface_points(X.cylinders(s, d), 10, 0.02), "x", "y", "z", "dx", "dy", "dz")


@query("unique_counts", X.sql("g AS (SELECT tree_id, CAST(floor(x) AS BIGINT) v, count(*) n FROM ev GROUP BY 1, 2) SELECT tree_id, v, n, dense_rank() OVER (PARTITION BY tree_id ORDER BY v) - 1 AS code FROM g", "ev"))
def _(s, d):
    from pyspark.sql import Window

    g = X.event_points(s, d).groupBy("tree_id", F.floor("x").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("code", (F.dense_rank().over(Window.partitionBy("tree_id").orderBy("v")) - 1).cast("long"))


@query("set_operations", X.sql("a AS (SELECT point_id FROM ev WHERE point_id % 2 = 0), b AS (SELECT point_id FROM ev WHERE point_id % 3 = 0) SELECT 'both' AS what, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)", "ev"))
def _(s, d):
    p = X.event_points(s, d).select("point_id")
    a, b = p.filter("point_id % 2 = 0"), p.filter("point_id % 3 = 0")
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(a.intersect(b), "both").union(n(a.subtract(b), "only")).union(n(a.union(b).distinct(), "any"))


@query("qsm_fit")
def _(s, d):
    up = sampling.noisy_cloud(X.cylinders(s, d), mu=-6.0, sigma=0.3, by_tree=True)
    return qsm.fit_qsm(up.withColumn("point_id", F.xxhash64("x", "y", "z")), together=True)


# -- merging of branches

_COS = "((a.x-b.x)*b.dx + (a.y-b.y)*b.dy + (a.z-b.z)*b.dz) / greatest({d} * sqrt(b.dx*b.dx+b.dy*b.dy+b.dz*b.dz), 1e-12)".format(d=DIST)


def _branches_sql(max_dist: float, max_angle: float, rounds: int = 6) -> str:
    """u: the joints of the minimum spanning forest, those whose rank is the least that the greatest rank on a way between their clusters can be (ways are doubled in rounds); l: the clusters' names."""
    out = [
        "s AS (SELECT *, point_id % 23 AS cluster, point_id % 7 <> 0 AS tied FROM pts)",
        f"c AS (SELECT a.tree_id, a.cluster ca, b.cluster cb, {DIST} far, {_COS} cos, a.point_id a, b.point_id b FROM s a JOIN s b ON a.tree_id = b.tree_id AND a.cluster <> b.cluster AND (a.tied OR b.tied) WHERE {DIST} < {max_dist})",
        f"j AS (SELECT *, CASE WHEN cos >= cos(radians({max_angle})) THEN 0 WHEN far < {max_dist / 2} THEN 1 END loose FROM c)",
        "k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY loose, far, a, b) r FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, least(ca, cb), greatest(ca, cb) ORDER BY loose, far, a, b) n FROM j WHERE loose IS NOT NULL) WHERE n = 1)",
        "w0 AS MATERIALIZED (SELECT tree_id, ca p, cb q, r FROM k UNION ALL SELECT tree_id, cb, ca, r FROM k)",
    ]
    for i in range(rounds):
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT tree_id, p, q, min(r) r FROM (SELECT tree_id, p, q, r FROM w{i} UNION ALL SELECT x.tree_id, x.p, y.q, greatest(x.r, y.r) FROM w{i} x JOIN w{i} y ON x.tree_id = y.tree_id AND x.q = y.p WHERE x.p <> y.q) GROUP BY tree_id, p, q)")
    out.append(f"u AS (SELECT k.* FROM k JOIN w{rounds} w ON w.tree_id = k.tree_id AND w.p = k.ca AND w.q = k.cb WHERE w.r = k.r)")
    out.append(f"z AS (SELECT tree_id, cluster, count(*) n FROM s GROUP BY tree_id, cluster), m AS (SELECT tree_id, cluster p, cluster q FROM z UNION ALL SELECT tree_id, p, q FROM w{rounds})")
    out.append("l AS (SELECT tree_id, cluster, merged FROM (SELECT m.tree_id, m.p cluster, m.q merged, row_number() OVER (PARTITION BY m.tree_id, m.p ORDER BY m.q <> 0, z.n DESC, m.q) rk FROM m JOIN z ON z.tree_id = m.tree_id AND z.cluster = m.q) WHERE rk = 1)")
    return ",\n".join(out)


def _branch_spheres(s, d):
    return X.points(s, d).select("tree_id", F.col("point_id").alias("sphere_id"), (F.col("point_id") % 23).alias("cluster"), "x", "y", "z", F.lit(0.05).alias("spread"), *(F.col(f"d{c}").alias(f"h{c}") for c in "xyz"), (F.col("point_id") % 7 != 0).alias("tied"))


@query("merge_branches", X.sql(f"{_branches_sql(1.5, 50)} SELECT tree_id, cluster, merged FROM l", "pts"))
def _(s, d):
    return branches.merge_branches(_branch_spheres(s, d), 1.5, 50)[0]


@query("branch_joints", X.sql(f"{_branches_sql(1.5, 50)} SELECT tree_id, ca AS cluster_a, cb AS cluster_b, loose, {q('far')} AS far, a, b FROM u", "pts"))
def _(s, d):
    return rounded(branches.merge_branches(_branch_spheres(s, d), 1.5, 50)[1], "far")


# -- steps of growth


def _ring_sql(source: str, by: str, name: str) -> str:
    """name: by, n, x, y, z, r of the ring of each group of source."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in by.split(", "))
    pick = lambda a, b, c: f"CASE WHEN na >= nb AND na >= nc THEN {a}/na WHEN nb >= nc THEN {b}/nb ELSE {c}/nc END"
    order = "ORDER BY (point_id*7919 + fit*104729) % 10007, point_id"
    return f"""{name}c AS (SELECT {", ".join(f"p.{k}" for k in by.split(", "))}, avg(p.x) mx_, avg(p.y) my_, avg(p.z) mz_, {COVARIANCES} FROM {source} p GROUP BY {", ".join(f"p.{k}" for k in by.split(", "))}), {_eigen_sql(f"{name}c", f"{name}e")},
{name}n AS (SELECT {by}, mx_, my_, mz_, {pick("ax", "bx", "cx_")} nx, {pick("ay", "by_", "cy_")} ny, {pick("az", "bz", "cz_")} nz FROM {name}e WHERE greatest(na, nb, nc) > 0),
{name}a AS (SELECT *, CASE WHEN abs(nx) <= 0.9 THEN 0 ELSE -nz / sqrt(nx*nx+nz*nz) END ex, CASE WHEN abs(nx) <= 0.9 THEN nz / sqrt(ny*ny+nz*nz) ELSE 0 END ey, CASE WHEN abs(nx) <= 0.9 THEN -ny / sqrt(ny*ny+nz*nz) ELSE nx / sqrt(nx*nx+nz*nz) END ez FROM {name}n),
{name}f AS (SELECT *, ny*ez-nz*ey fx, nz*ex-nx*ez fy, nx*ey-ny*ex fz FROM {name}a),
{name}u AS MATERIALIZED (SELECT {", ".join(f"s.{k}" for k in by.split(", "))}, s.point_id, (s.x-mx_)*ex+(s.y-my_)*ey+(s.z-mz_)*ez x, (s.x-mx_)*fx+(s.y-my_)*fy+(s.z-mz_)*fz y FROM {source} s JOIN {name}f f ON {on("s", "f")}),
{name}k AS (SELECT *, row_number() OVER (PARTITION BY {by}, fit {order}) k, count(*) OVER (PARTITION BY {by}, fit) m FROM {name}u, range(10) r(fit)), {name}t AS (SELECT {by}, fit, x, y FROM {name}k WHERE k <= floor(m*0.8)),
{_circle_sql(f"{name}t", f"{by}, fit", f"{name}p")}, {_circle_sql(f"{name}u", by, f"{name}w")},
{name}q AS (SELECT {by}, avg(cx) sx, avg(cy) sy, avg(r) sr FROM {name}p GROUP BY {by}), {name}z AS (SELECT {", ".join(f"w.{k}" for k in by.split(", "))}, w.n, coalesce(sx, w.cx) u, coalesce(sy, w.cy) v, coalesce(sr, w.r) r FROM {name}w w LEFT JOIN {name}q q ON {on("w", "q")}),
{name} AS (SELECT {", ".join(f"z.{k}" for k in by.split(", "))}, n, mx_+u*ex+v*fx x, my_+u*ey+v*fy y, mz_+u*ez+v*fz z, r FROM {name}z z JOIN {name}f f ON {on("z", "f")} WHERE r IS NOT NULL)"""


def _ranked_fit():
    return F.expr("(point_id * 7919 + fit * 104729) % 10007")


@query("seed_spheres", X.sql(f"lo AS (SELECT tree_id, min(z) low FROM ev GROUP BY tree_id), sl AS (SELECT e.tree_id, point_id, x, y, z FROM ev e JOIN lo ON lo.tree_id = e.tree_id WHERE z <= low + 3.0), {_ring_sql('sl', 'tree_id', 'rg')} SELECT rg.tree_id, {q('x', 4)} AS x, {q('y', 4)} AS y, {q('low')} AS z, {q('2*r', 4)} AS radius, {q('r', 4)} AS spread FROM rg JOIN lo ON lo.tree_id = rg.tree_id WHERE n >= 10", "ev"))
def _(s, d):
    return rounded(rounded(growth.seed_spheres(X.event_points(s, d), 3.0, 10, _ranked_fit), "x", "y", "radius", "spread", digits=4), "z")


_SPHERE = "CAST(3 AS DOUBLE)"
_SHELL = (
    X.SQL["pts"].replace("pts AS", "all_pts AS", 1)
    + f", pts AS (SELECT a.tree_id * 1000000 + a.point_id AS tree_id, b.point_id, b.x, b.y, b.z, a.x ox, a.y oy, a.z oz FROM all_pts a JOIN all_pts b ON a.tree_id = b.tree_id WHERE {DIST} <= 3 AND {DIST} > 1)"
    + ", u AS (SELECT tree_id, point_id, (x-ox)/r ux, (y-oy)/r uy, (z-oz)/r uz FROM (SELECT *, sqrt((x-ox)*(x-ox)+(y-oy)*(y-oy)+(z-oz)*(z-oz)) r FROM pts)), e AS (SELECT a.tree_id, a.point_id a, b.point_id b FROM u a JOIN u b ON a.tree_id = b.tree_id WHERE acos(least(1, greatest(-1, a.ux*b.ux+a.uy*b.uy+a.uz*b.uz))) <= radians(40)), "
    + f"lb AS ({_DENSITY.replace('core AS', 'WITH RECURSIVE core AS', 1)}), sh AS (SELECT p.tree_id, lb.label, p.point_id, p.x, p.y, p.z FROM pts p JOIN lb ON lb.tree_id = p.tree_id AND lb.point_id = p.point_id WHERE lb.label >= 0), "
    + _ring_sql("sh", "tree_id, label", "rg")
    + f", cn AS (SELECT o.tree_id, o.point_id AS sphere_id, rg.label, rg.n, rg.x, rg.y, rg.z, rg.r AS spread, abs(o.f0) + 0.05 AS own, o.x ox, o.y oy, o.z oz FROM rg JOIN all_pts o ON o.tree_id * 1000000 + o.point_id = rg.tree_id WHERE sqrt((rg.x-o.x)*(rg.x-o.x)+(rg.y-o.y)*(rg.y-o.y)+(rg.z-o.z)*(rg.z-o.z)) <= 4.5)"
)


def _spheres(s, d):
    return X.points(s, d).select("tree_id", F.col("point_id").alias("sphere_id"), "x", "y", "z", F.lit(3.0).alias("radius"), (F.abs("f0") + 0.05).alias("spread"), (F.abs("f0") + 0.05).alias("score"))


def _grown(s, d):
    return growth.candidates(X.points(s, d), _spheres(s, d), 40.0, 4, 2.0, _ranked_fit)


@query("growth_candidates", f"WITH RECURSIVE {_SHELL} SELECT tree_id, sphere_id, label, n, {q('x', 4)} AS x, {q('y', 4)} AS y, {q('z', 4)} AS z, {q('spread', 4)} AS spread FROM cn")
def _(s, d):
    """Every point as a sphere."""
    return rounded(_grown(s, d), "x", "y", "z", "spread", digits=4)


_ACCEPTED = (
    ", ac AS (SELECT *, greatest(0.33*own, least(1.05*own, spread)) sp, greatest(0.15, least(3.0, 20*greatest(0.33*own, least(1.05*own, spread)))) radius FROM cn), "
    "fr AS (SELECT a.tree_id, sphere_id, label, count(*) fresh FROM ac a JOIN all_pts p ON p.tree_id = a.tree_id WHERE sqrt((p.x-a.x)*(p.x-a.x)+(p.y-a.y)*(p.y-a.y)+(p.z-a.z)*(p.z-a.z)) <= a.radius AND sqrt((p.x-a.ox)*(p.x-a.ox)+(p.y-a.oy)*(p.y-a.oy)+(p.z-a.oz)*(p.z-a.oz)) > 3 GROUP BY a.tree_id, sphere_id, label)"
)


@query("growth_accepted", f"WITH RECURSIVE {_SHELL}{_ACCEPTED} SELECT ac.tree_id, ac.sphere_id, ac.label, {q('sp', 4)} AS spread, {q('radius', 4)} AS radius, {q('0.5*sp+0.5*own', 4)} AS score, fresh FROM ac JOIN fr ON fr.tree_id = ac.tree_id AND fr.sphere_id = ac.sphere_id AND fr.label = ac.label WHERE fresh >= 1")
def _(s, d):
    out = growth.accepted(X.points(s, d), _spheres(s, d), _grown(s, d), factor=20.0, radii=(0.15, 3.0), least=1)
    return rounded(out, "spread", "radius", "score", digits=4).select("tree_id", "sphere_id", "label", "spread", "radius", "score", "fresh")


from . import learned  # noqa: E402, F401  (registers its queries)
