"""Deterministic point clouds and cylinder models over the star-schema tables, in both engines' words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return _t(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("point_id"), F.col("label").cast("int").alias("tree_id"), *((e(i) * 10).alias(c) for i, c in enumerate("xyz")), *(e(3 + i).alias(f"d{c}") for i, c in enumerate("xyz")),
        e(6).alias("f0"), e(10).alias("l0"), e(11).alias("l1"),
    )


def cylinders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as bigint) id", "cast(p_partkey % 10 as int) tree_id",
        "((p_partkey%7)-3)*0.5D sx", "((p_partkey%11)-5)*0.4D sy", "((p_partkey%13)-6)*0.3D sz",
        "((p_partkey%7)-3)*0.5D+((p_partkey%3)-1)*0.3D ex", "((p_partkey%11)-5)*0.4D+((p_partkey%5)-2)*0.2D ey", "((p_partkey%13)-6)*0.3D+0.25D ez",
        "0.02D+p_size*0.005D radius", "case when p_partkey>=10 then cast(((p_partkey div 10)-1) div 2 as bigint)*10 + p_partkey%10 end parent_id",
        "case when p_partkey%4=0 then 'connection' else 'follow' end type",
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").selectExpr(
        "cast(event_id as bigint) point_id", "cast(user_id % 10 as int) tree_id", "cast(value as double)/10 x", "(user_id % 50)/cast(5 as double) y",
        "(unix_micros(cast(ts as timestamp)) - 1704067200000000)/cast(86400000000 as double) z",
    )


def names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _t(spark, sf_dir, "part")
    base = "concat(cast(30 + p_partkey % 60 as string), '_', cast(p_partkey as string))"
    end = "case p_partkey % 3 when 0 then '' when 1 then '_qsm' else '_pred_denoised' end"
    return p.selectExpr(f"{base} cloud"), p.selectExpr(f"concat({base}, {end}) model")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").selectExpr("concat(cast(3 + p_partkey % 5 as string), '_', cast(p_partkey as string)) tree_id", "cast(p_partkey as bigint) k")


SQL = {
    "pts": """pts AS (SELECT CAST(vec_id AS BIGINT) point_id, CAST(label AS INT) tree_id, CAST(embedding[1] AS DOUBLE)*10 x, CAST(embedding[2] AS DOUBLE)*10 y, CAST(embedding[3] AS DOUBLE)*10 z,
  CAST(embedding[4] AS DOUBLE) dx, CAST(embedding[5] AS DOUBLE) dy, CAST(embedding[6] AS DOUBLE) dz, CAST(embedding[7] AS DOUBLE) f0, CAST(embedding[11] AS DOUBLE) l0, CAST(embedding[12] AS DOUBLE) l1 FROM embeddings)""",
    "cyl": """cyl AS (SELECT CAST(p_partkey AS BIGINT) id, CAST(p_partkey % 10 AS INT) tree_id,
  ((p_partkey%7)-3)*CAST(0.5 AS DOUBLE) sx, ((p_partkey%11)-5)*CAST(0.4 AS DOUBLE) sy, ((p_partkey%13)-6)*CAST(0.3 AS DOUBLE) sz,
  ((p_partkey%7)-3)*CAST(0.5 AS DOUBLE)+((p_partkey%3)-1)*CAST(0.3 AS DOUBLE) ex, ((p_partkey%11)-5)*CAST(0.4 AS DOUBLE)+((p_partkey%5)-2)*CAST(0.2 AS DOUBLE) ey, ((p_partkey%13)-6)*CAST(0.3 AS DOUBLE)+CAST(0.25 AS DOUBLE) ez,
  CAST(0.02 AS DOUBLE)+p_size*CAST(0.005 AS DOUBLE) radius, CASE WHEN p_partkey>=10 THEN CAST(((p_partkey//10)-1)//2 AS BIGINT)*10 + p_partkey%10 END parent_id,
  CASE WHEN p_partkey%4=0 THEN 'connection' ELSE 'follow' END type FROM part)""",
    "ev": """ev AS (SELECT CAST(event_id AS BIGINT) point_id, CAST(user_id % 10 AS INT) tree_id, CAST(value AS DOUBLE)/10 x, (user_id % 50)/CAST(5 AS DOUBLE) y,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))/CAST(86400000000 AS DOUBLE) z FROM events)""",
    "nm": """clouds AS (SELECT CAST(30 + p_partkey % 60 AS VARCHAR) || '_' || CAST(p_partkey AS VARCHAR) cloud FROM part),
models AS (SELECT CAST(30 + p_partkey % 60 AS VARCHAR) || '_' || CAST(p_partkey AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_qsm' ELSE '_pred_denoised' END model FROM part)""",
    "tr": "tr AS (SELECT CAST(3 + p_partkey % 5 AS VARCHAR) || '_' || CAST(p_partkey AS VARCHAR) tree_id, CAST(p_partkey AS BIGINT) k FROM part)",
    "near": """pair AS (SELECT p.tree_id, p.point_id, p.x, p.y, p.z, c.id, c.radius r, c.sx, c.sy, c.sz,
    sqrt((c.ex-c.sx)*(c.ex-c.sx)+(c.ey-c.sy)*(c.ey-c.sy)+(c.ez-c.sz)*(c.ez-c.sz)) len, c.ex-c.sx ax, c.ey-c.sy ay, c.ez-c.sz az FROM pts p JOIN cyl c ON p.tree_id = c.tree_id),
axis AS (SELECT *, ((x-sx)*ax+(y-sy)*ay+(z-sz)*az)/len t FROM pair),
clip AS (SELECT *, t - greatest(0, least(t, len)) h, sqrt((x-sx-t*ax/len)*(x-sx-t*ax/len)+(y-sy-t*ay/len)*(y-sy-t*ay/len)+(z-sz-t*az/len)*(z-sz-t*az/len)) rho FROM axis),
near AS (SELECT tree_id, point_id, min_by(id, d) cylinder_id, min(d) distance FROM (SELECT *, CASE WHEN abs(h) <= 0.001 THEN abs(rho-r) ELSE sqrt(h*h + greatest(rho-r,0)*greatest(rho-r,0)) END d FROM clip) GROUP BY tree_id, point_id)""",
    "near_offset": """near_offset AS (SELECT n.tree_id, n.point_id, n.cylinder_id, n.distance, sx + (t-h)*ax/len + r*(x-sx-t*ax/len)/greatest(rho, 1e-8) - x ox,
    sy + (t-h)*ay/len + r*(y-sy-t*ay/len)/greatest(rho, 1e-8) - y oy, sz + (t-h)*az/len + r*(z-sz-t*az/len)/greatest(rho, 1e-8) - z oz
    FROM near n JOIN clip c ON c.tree_id = n.tree_id AND c.point_id = n.point_id AND c.id = n.cylinder_id)""",
}


def sql(body: str, *parts: str, recursive: bool = False) -> str:
    """A statement over the named fixture tables; `body` may go on with further CTEs before its SELECT."""
    head = ",\n".join(SQL[p] for p in parts)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{',' if not body.lstrip().upper().startswith('SELECT') else ''}\n{body}"
