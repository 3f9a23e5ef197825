"""Sources. Every reader gives explicit schemas, keeps all columns and turns NaN into null. Files are split over tasks, never listed into the driver's memory.

Clouds: .npy (one-dimensional arrays are taken as rows of three), delimited text (blank, then comma; decided per file) and
uncompressed LAS 1.2-1.4; LAZ needs a decoder that is not installed and is reported in column error. Unreadable files give
one row with error set.
"""

from __future__ import annotations

import io
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import nan_to_null

#: Names that a cylinder file's columns may have (fixed values).
ALIASES = {
    "sx": ["startX", "start.x", "start_x"], "sy": ["startY", "start.y", "start_y"], "sz": ["startZ", "start.z", "start_z"],
    "ex": ["endX", "end.x", "end_x"], "ey": ["endY", "end.y", "end_y"], "ez": ["endZ", "end.z", "end_z"],
    "radius": ["radius", "Radius"], "id": ["ID", "extension", "id"],
}
CLOUD_COLUMNS = ("x", "y", "z", "dx", "dy", "dz", "cylinder_id", "nx", "ny", "nz", "height", "extra")


def tree_id_of(path: Column) -> Column:
    """The first two parts, between underscores, of the file's name without its ending."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.substring_index(name, "_", 2)


def decode_npy(raw: bytes) -> np.ndarray:
    a = np.load(io.BytesIO(raw), allow_pickle=False)
    return a.reshape(-1, 3) if a.ndim == 1 else a


def decode_text(raw: bytes) -> np.ndarray:
    text = raw.decode()
    for sep in (None, ","):
        try:
            return np.loadtxt(io.StringIO(text), delimiter=sep, ndmin=2)
        except ValueError:
            continue
    raise ValueError("neither blanks nor commas separate its numbers")


def decode_las(raw: bytes) -> np.ndarray:
    """x, y, z of an uncompressed LAS file: scaled whole numbers at the head of each record."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor, offset, kind = raw[25], int.from_bytes(raw[96:100], "little"), raw[104]
    if kind & 0xC0:
        raise ValueError("compressed (LAZ) points need a decoder that is not installed")
    size = int.from_bytes(raw[105:107], "little")
    n = int.from_bytes(raw[107:111], "little") or (int.from_bytes(raw[247:255], "little") if minor >= 4 else 0)
    scale, shift = np.frombuffer(raw, "<f8", 3, 131), np.frombuffer(raw, "<f8", 3, 155)
    rec = np.frombuffer(raw, np.uint8, n * size, offset).reshape(n, size)
    return np.ascontiguousarray(rec[:, :12]).view("<i4") * scale + shift


def encode_las(xyz: np.ndarray, scale: float = 0.001) -> bytes:
    """A LAS 1.2 file (point format 0) with millimetre scale and the minimum as offset."""
    low = xyz.min(axis=0) if len(xyz) else np.zeros(3)
    high = xyz.max(axis=0) if len(xyz) else np.zeros(3)
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    head[94:96], head[96:100] = (227).to_bytes(2, "little"), (227).to_bytes(4, "little")
    head[104], head[105:107], head[107:111] = 0, (20).to_bytes(2, "little"), len(xyz).to_bytes(4, "little")
    head[131:155], head[155:179] = np.full(3, scale).tobytes(), low.astype("<f8").tobytes()
    head[179:227] = np.array([[high[i], low[i]] for i in range(3)], "<f8").tobytes()
    rec = np.zeros((len(xyz), 20), np.uint8)
    rec[:, :12] = np.ascontiguousarray(np.rint((xyz - low) / scale).astype("<i4")).view(np.uint8).reshape(len(xyz), 12)
    return bytes(head) + rec.tobytes()


DECODERS = {"npy": decode_npy, "txt": decode_text, "csv": decode_text, "las": decode_las, "laz": decode_las}


def decode_any(name: str, raw: bytes) -> np.ndarray:
    """By the file's ending; else npy, text, LAS in turn."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind in DECODERS:
        return DECODERS[kind](raw)
    for way in (decode_npy, decode_text, decode_las):
        try:
            return way(raw)
        except Exception:
            continue
    raise ValueError("no reader fits")


def read_clouds(spark: SparkSession, path: str, pattern: str = "*", columns: int = 3) -> DataFrame:
    """tree_id, path, point_id (the row's number), the first `columns` of x, y, z, dx, dy, dz, cylinder_id, nx, ny, nz, height, extra (missing ones 0.0), error."""
    names = CLOUD_COLUMNS[:columns]
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("point_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names), T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in batches:
            for name, raw in zip(pdf.path, pdf.content):
                try:
                    a = np.asarray(decode_any(name, raw), float)
                    out = np.zeros((len(a), len(names)))
                    k = min(a.shape[1], len(names))
                    out[:, :k] = a[:, :k]
                    error = None
                except Exception as e:
                    out, error = np.full((1, len(names)), np.nan), f"{type(e).__name__}: {e}"[:300]
                df = pd.DataFrame(out, columns=list(names))
                df.insert(0, "point_id", np.arange(len(df)))
                df.insert(0, "path", name)
                yield df.assign(error=error)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    out = nan_to_null(files.mapInPandas(run, schema))
    return out.select(tree_id_of(F.col("path")).alias("tree_id"), *out.columns)


def resolve_columns(columns: list[str], aliases: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Our name -> the file's name. Blanks and quotes around names do not count. Missing ones are listed in the error."""
    clean = {re.sub(r"^[\s'\"]+|[\s'\"]+$", "", c): c for c in columns}
    found, missing = {}, []
    for ours, theirs in (aliases or ALIASES).items():
        hit = next((clean[t] for t in theirs if t in clean), None)
        if hit is None:
            missing.append(f"{ours} ({' / '.join(theirs)})")
        else:
            found[ours] = hit
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return found


def standardise_cylinders(raw: DataFrame) -> DataFrame:
    """A cylinder file of any dialect in our columns: numbers by try_cast (null where they are none), whole ids, branch order where there is one. Rows without a usable number at all go."""
    found = resolve_columns(raw.columns)
    number = lambda c: F.expr(f"try_cast(trim(BOTH '\"' FROM trim(`{c}`)) AS double)")
    out = {k: number(c) for k, c in found.items()}
    out["id"] = out["id"].cast("long")
    clean = {re.sub(r"^[\s'\"]+|[\s'\"]+$", "", c): c for c in raw.columns}
    if "BranchOrder" in clean:
        out["branch_order"] = number(clean["BranchOrder"]).cast("int")
    if "parentID" in clean:
        out["parent_id"] = number(clean["parentID"]).cast("long")
    keep = [f"`{c}`" for c in raw.columns if c in ("tree_id", "path")]
    df = raw.select(*(F.expr(c) for c in keep), *(v.alias(k) for k, v in out.items()))
    df = nan_to_null(df)
    return df.filter(F.coalesce(*(F.col(c) for c in ("sx", "sy", "sz", "ex", "ey", "ez", "radius"))).isNotNull())


def read_cylinders(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.withColumn("path", F.col("_metadata.file_path"))
    return standardise_cylinders(raw.withColumn("tree_id", tree_id_of(F.col("path"))))


_RASTERS = "map<string, struct<path: string, rasters: array<struct<raster_id: int, bounds: struct<min: array<double>, max: array<double>>>>>>"


def read_raster_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Flat table of raster bounds; the rasters of one tree in several files come together."""
    text = spark.read.text(path, wholetext=True)
    m = text.select(F.explode(F.from_json("value", _RASTERS)).alias("tree_id", "m")).select("tree_id", "m.path", F.explode("m.rasters").alias("r"))
    out = m.select("tree_id", "path", "r.raster_id", *(F.col(f"r.bounds.{e}")[i].alias(f"{e}_{c}") for e in ("min", "max") for i, c in enumerate("xyz")))
    return out.distinct()


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of paths as rows."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("path"))


def read_config(path: str) -> dict:
    """YAML (or JSON) configuration; a driver-side file of bounded size."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)
