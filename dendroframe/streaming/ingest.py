"""File-arrival ingestion of clouds, beyond what the batch pipeline needs: new files become points and running statistics.

Each file is decoded once, in the batch that sees it first (exactly-once through the checkpoint). Statistics are a stateful
aggregation per tree: state grows with trees, not points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import decode_any, tree_id_of


def cloud_stream(spark: SparkSession, directory: str, pattern: str = "*", files_per_batch: int = 100) -> DataFrame:
    """tree_id, path, point_id, x, y, z of arriving cloud files; unreadable files give no rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(directory)

    def run(batches):
        for pdf in batches:
            for name, raw in zip(pdf.path, pdf.content):
                try:
                    a = np.asarray(decode_any(name, raw), float)[:, :3]
                except Exception:
                    continue
                out = pd.DataFrame(a, columns=["x", "y", "z"])
                out.insert(0, "point_id", np.arange(len(a)))
                out.insert(0, "path", name)
                yield out

    points = files.select("path", "content").mapInPandas(run, "path string, point_id long, x double, y double, z double")
    return points.withColumn("tree_id", tree_id_of(F.col("path")))


def running_extent(points: DataFrame) -> DataFrame:
    """Points and bounding box of each tree so far (update or complete mode)."""
    return points.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "5 minutes", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Events per window and type, with late data up to `late`."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
