"""Sinks. Tables go to Parquet by tree. File formats of other tools are made by the tasks that hold a tree's rows, and written by them
wherever tasks can open the store (shared folders, object stores); to other ones the driver writes them, one partition at a time."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import color_ramp
from .readers import encode_las


def write_table(df: DataFrame, path: str, by: str = "tree_id", mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(by).parquet(path)


def _encode(a: np.ndarray, kind: str) -> tuple[str, bytes]:
    import io

    if kind == "txt":
        buf = io.StringIO()
        np.savetxt(buf, a, fmt="%.6f")
        return "txt", buf.getvalue().encode()
    if kind in ("las", "laz"):  # without a LAZ encoder the points stay uncompressed
        return "las", encode_las(a[:, :3])
    buf = io.BytesIO()
    np.save(buf, a)
    return "npy", buf.getvalue()


def cloud_files(df: DataFrame, columns: list[str], kind: str = "npy") -> DataFrame:
    """One row per tree with name and content of its file (npy, txt with six decimals, las at 1 mm; unknown kinds as npy), points in order of id. Trees without points give no file."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        end, raw = _encode(pdf[columns].to_numpy(float), kind)
        return pd.DataFrame({"name": [f"{pdf.tree_id.iloc[0]}.{end}"], "content": [raw]})

    return df.select("tree_id", "point_id", *columns).groupBy("tree_id").applyInPandas(run, schema)


def _store(directory: str) -> pa.fs.FileSystem | None:
    """The file system of a folder's URI, if tasks can open it by themselves (file, and the object stores and HDFS that this Arrow build knows)."""
    try:
        return pa.fs.FileSystem.from_uri(directory)[0]
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def write_files(files: DataFrame, directory: str) -> int:
    """Writes rows (name, content) as files; returns their number. Tasks write them, each under a passing name first, so that a repeated task leaves whole files; only to stores that tasks cannot open (_store) the driver does, through Hadoop, row by row."""
    spark = files.sparkSession
    if "://" not in directory and not directory.startswith("file:"):
        directory = f"file:{directory}"
    if directory.startswith("file:"):
        directory = "file:///" + directory.removeprefix("file:").lstrip("/")
    if _store(directory) is not None:

        def write(batches):
            store, folder = pa.fs.FileSystem.from_uri(directory)
            store.create_dir(folder, recursive=True)
            for pdf in batches:
                for name, content in zip(pdf.name, pdf.content):
                    passing = f"{folder}/.{name}.{uuid.uuid4().hex}"
                    with store.open_output_stream(passing) as f:
                        f.write(content)
                    store.move(passing, f"{folder}/{name}")
                yield pd.DataFrame({"n": [len(pdf)]})

        return files.select("name", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for row in files.toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(f"{directory}/{row['name']}")
        out = p.getFileSystem(conf).create(p, True)
        out.write(row["content"])
        out.close()
        n += 1
    return n


def cylinder_csv(cylinders: DataFrame) -> DataFrame:
    """The columns of a cylinder file in the published order and names."""
    kids = F.to_json("children_ids") if "children_ids" in cylinders.columns else F.lit("[]")
    names = {"id": "ID", "sx": "startX", "sy": "startY", "sz": "startZ", "ex": "endX", "ey": "endY", "ez": "endZ", "radius": "radius", "volume": "volume", "length": "length", "parent_id": "parentID"}
    return cylinders.select("tree_id", *(F.col(k).alias(v) for k, v in names.items()), kids.alias("childrenIDs"), "type")


def write_cylinder_csv(cylinders: DataFrame, path: str, mode: str = "errorifexists") -> None:
    cylinder_csv(cylinders).write.mode(mode).partitionBy("tree_id").option("header", True).csv(path)


def splits_json(trees: DataFrame) -> DataFrame:
    """One JSON list of paths per split."""
    return trees.groupBy("split").agg(F.to_json(F.sort_array(F.collect_list("path"))).alias("value"))


def qsm_set_json(models: DataFrame, path_col: str = "path") -> DataFrame:
    """The JSON list of all model files' paths, in order: one row. The list is bounded by the number of files."""
    return models.agg(F.to_json(F.sort_array(F.collect_list(path_col))).alias("value"))


def raster_json(rasters: DataFrame) -> DataFrame:
    """One JSON object of raster bounds per tree."""
    b = lambda e: F.array(*(F.col(f"{e}_{c}") for c in "xyz")).alias(e)
    r = F.struct(F.col("raster_id").cast("int").alias("raster_id"), F.struct(b("min"), b("max")).alias("bounds"))
    return rasters.groupBy("tree_id").agg(F.to_json(F.struct(F.first("path").alias("path"), F.array_sort(F.collect_list(r)).alias("rasters"))).alias("value"))


def colored_cylinders(cylinders: DataFrame, least_radius: float = 1e-5, by: str = "radius") -> DataFrame:
    """Cylinders to draw (numbers without null or NaN, radius of least_radius or more) with their colour: by radius from blue over green to red within the tree; by root (red where there is no parent, else brown); or by type (connections red, else green)."""
    ok = cylinders.filter(" and ".join(f"{c} is not null and not isnan({c})" for c in ("sx", "sy", "sz", "ex", "ey", "ez", "radius"))).filter(F.col("radius") >= least_radius)
    if by == "radius":
        e = ok.groupBy("tree_id").agg(F.min("radius").alias("lo"), F.max("radius").alias("hi"))
        return ok.join(e, "tree_id").withColumn("color", color_ramp(F.col("radius"), F.col("lo"), F.col("hi"))).drop("lo", "hi")
    red = {"root": F.col("parent_id").isNull(), "type": F.col("type") == "connection"}[by]
    return ok.withColumn("color", F.when(red, _color(RED)).otherwise(_color(BROWN if by == "root" else GREEN)))


#: Colours of meshes: red, green and blue shares (fixed values).
RED, GREEN, BROWN, BLUE, GREY = (1.0, 0.0, 0.0), (0.0, 0.6, 0.0), (0.55, 0.35, 0.15), (0.0, 0.0, 1.0), (0.5, 0.5, 0.5)


def _color(rgb: tuple[float, float, float]) -> Column:
    return F.struct(*(F.lit(v).alias(n) for v, n in zip(rgb, ("red", "green", "blue"))))


def _frame(axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = axis / max(float(np.linalg.norm(axis)), 1e-12)
    side = np.cross(a, [1.0, 0, 0] if abs(a[0]) < 0.9 else [0, 1.0, 0])
    side /= np.linalg.norm(side)
    return side, np.cross(a, side)


def cylinder_mesh(start: np.ndarray, end: np.ndarray, radius: float, sides: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a closed cylinder between two points."""
    u, v = _frame(end - start)
    t = 2 * np.pi * np.arange(sides) / sides
    ring = radius * (np.cos(t)[:, None] * u + np.sin(t)[:, None] * v)
    vertices = np.r_[start + ring, end + ring, [start], [end]]
    i, j = np.arange(sides), (np.arange(sides) + 1) % sides
    faces = np.r_[np.c_[i, j, i + sides], np.c_[j, j + sides, i + sides], np.c_[j, i, np.full(sides, 2 * sides)], np.c_[i + sides, j + sides, np.full(sides, 2 * sides + 1)]]
    return vertices, faces


def sphere_mesh(centre: np.ndarray, radius: float, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.pi * np.arange(steps + 1) / steps, 2 * np.pi * np.arange(2 * steps) / (2 * steps)
    v = np.stack([np.outer(np.sin(a), np.cos(b)), np.outer(np.sin(a), np.sin(b)), np.outer(np.cos(a), np.ones_like(b))], axis=2).reshape(-1, 3)
    n = 2 * steps
    i, j = (x.ravel() for x in np.meshgrid(np.arange(steps), np.arange(n), indexing="ij"))
    p, q = i * n + j, i * n + (j + 1) % n
    return centre + radius * v, np.r_[np.c_[p, p + n, q], np.c_[q, p + n, q + n]]


def ply(vertices: np.ndarray, faces: np.ndarray, colors: np.ndarray) -> bytes:
    """ASCII PLY; equal vertices of equal colour are written once."""
    rows = np.c_[np.round(vertices, 6), colors]
    uniq, index = np.unique(rows, axis=0, return_inverse=True)
    head = ["ply", "format ascii 1.0", f"element vertex {len(uniq)}", *(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header"]
    body = [f"{x:.6f} {y:.6f} {z:.6f} {int(r)} {int(g)} {int(b)}" for x, y, z, r, g, b in uniq]
    return "\n".join([*head, *body, *(f"3 {a} {b} {c}" for a, b, c in index.reshape(-1)[faces])]).encode() + b"\n"


def _mesh(rows, shape) -> bytes:
    """PLY of the shapes (vertices, faces) of rows with red, green and blue."""
    vs, fs, cs, n = [], [], [], 0
    for row in rows:
        v, f = shape(row)
        vs.append(v)
        fs.append(f + n)
        cs.append(np.tile([255 * row.red, 255 * row.green, 255 * row.blue], (len(v), 1)).astype(int))
        n += len(v)
    return ply(np.concatenate(vs), np.concatenate(fs), np.concatenate(cs))


def _files(df: DataFrame, order: list[str], end: str, shape) -> DataFrame:
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{pdf.tree_id.iloc[0]}{end}"], "content": [_mesh(pdf.sort_values(order).itertuples(), shape)]})

    return df.groupBy("tree_id").applyInPandas(run, schema)


def mesh_files(cylinders: DataFrame, sides: int = 12, by: str = "radius") -> DataFrame:
    """One PLY file per tree, cylinders coloured as in colored_cylinders."""
    c = colored_cylinders(cylinders, by=by).select("tree_id", "id", "sx", "sy", "sz", "ex", "ey", "ez", "radius", "color.*")
    return _files(c, ["id"], ".ply", lambda r: cylinder_mesh(np.array([r.sx, r.sy, r.sz]), np.array([r.ex, r.ey, r.ez]), r.radius, sides))


def sphere_files(spheres: DataFrame, by: str = "outer") -> DataFrame:
    """One PLY file per tree: outer spheres (is_outer) blue, inner ones grey; or by radius, from blue over green to red within the tree."""
    if by == "radius":
        e = spheres.groupBy("tree_id").agg(F.min("radius").alias("lo"), F.max("radius").alias("hi"))
        c = spheres.join(e, "tree_id").withColumn("color", color_ramp(F.col("radius"), F.col("lo"), F.col("hi")))
    else:
        c = spheres.withColumn("color", F.when(F.col("is_outer"), _color(BLUE)).otherwise(_color(GREY)))
    return _files(c.select("tree_id", "x", "y", "z", "radius", "color.*"), ["x", "y", "z", "radius"], "_spheres.ply", lambda r: sphere_mesh(np.array([r.x, r.y, r.z]), r.radius))
