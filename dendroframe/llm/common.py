"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (only where unset, as in tests) one made for this driver."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def _remove() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            pass
    _made.clear()


atexit.register(_remove)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it again. Later stages survive lost executors, and Spark knows the table's true size when it chooses joins."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df; for rounds of a loop that a later round, written itself, replaces."""
    global _made
    path = df.written_to
    old, _made = [m for m in _made if m[1] == path], [m for m in _made if m[1] != path]
    for spark, path in old:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(columns: list[str], name: str) -> str:
    """The name, or a longer one if a column of the table begins with it (in any case): for columns that a table is given for a while."""
    low = [c.lower() for c in columns]
    while any(c.startswith(name.lower()) for c in low):
        name += "_"
    return name


#: Rows of a key from which it is a hub, at least (fewer, of some ten bytes each, are no burden for a task, while a second way for hubs makes plans twice as large); and hubs that a table has at most.
HUB, HUBS = 1_000_000, 50_000


def spread_join(rows: DataFrame, few: DataFrame, on: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with few, which has one row per key, with the key's number of rows in `count`; no key draws its rows to one task. Keys of more than total / HUBS rows (and of HUB) are sent to all tasks: as total is the number of rows, there are at most HUBS of them."""
    hub = max(HUB, total // HUBS)
    if total <= hub:  # no key can have more
        return rows.join(few, on, how)
    hubs = F.broadcast(few.filter(F.col(count) > hub))
    rest = rows.join(hubs.select(on), on, "left_anti").join(few.filter(F.col(count) <= hub), on, how)
    return rest.unionByName(rows.join(hubs, on))


def checked(df: DataFrame, needed: dict[str, str]) -> None:
    """Fails early, naming what is missing."""
    missing = [c for c in needed.values() if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def dealt(df: DataFrame, size: str, node: str, block: int) -> DataFrame:
    """Deals the rows of groups out as pairs of blocks: adds own (the row's block) and bi <= bj, once for every pair that its block belongs to. `size` names the column with the group's rows; a group of up to `block` rows has the one pair (0, 0)."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), node), n).cast("int")
    df = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return df.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")})


def by_chars(texts: list[str], limit: int):
    """Slices of the list with about `limit` characters each (one text at least)."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def text_slices(batch: pa.RecordBatch, column: int, limit: int):
    """Parts of an Arrow batch with about `limit` bytes of text each (one row at least): (the part, its texts, '' for null). Only one part's texts are Python strings at a time."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    sums, start = np.cumsum(size, dtype=np.int64), 0
    while start < batch.num_rows:
        before = int(sums[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sums, before + limit, side="right")))
        part = batch.slice(start, stop - start)
        yield part, [t or "" for t in part.column(column).to_pylist()]
        start = stop
    pa.default_memory_pool().release_unused()  # workers are used again by later stages


_BREAK = re.compile("[ \n]")


def segments(text: str, limit: int) -> list[str]:
    """The text in parts of about `limit` characters, each ending before a blank or a line break (where there is none, it goes on), so that a very long text's words need not all be Python objects at a time."""
    out, a = [], 0
    while len(text) - a > limit and (found := _BREAK.search(text, a + limit)):
        out.append(text[a : found.start()])
        a = found.start()
    return [*out, text[a:]] if a else [text]


def ragged_take(starts: np.ndarray, lens: np.ndarray, values: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates values[starts[i]:starts[i]+lens[i]] for i in idx; also returns the lengths taken."""
    took = lens[idx]
    ends = np.cumsum(took)
    total = int(ends[-1]) if len(ends) else 0
    pos = np.arange(total, dtype=np.int64) + np.repeat(starts[idx] - (ends - took), took)
    return values[pos], took
