"""Schemas of the tables that the operators work on. Missing values are null, never NaN; -1 is 'not segmented', -2 'ignored'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


POINTS = "tree_id string, point_id long, x double, y double, z double"
LABELED = POINTS + ", dx double, dy double, dz double, cylinder_id int, nx double, ny double, nz double, height double"
CYLINDERS = "tree_id string, id long, sx double, sy double, sz double, ex double, ey double, ez double, radius double, volume double, length double, parent_id long, children_ids array<long>, type string"
RASTERS = "tree_id string, raster_id long, ix long, iy long, iz long, n long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN turned into null, as every reader gives them."""
    new = {f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(new) if new else df
