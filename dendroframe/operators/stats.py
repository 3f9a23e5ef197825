"""Aggregations and fits. Standard deviations are of the population, covariances of the sample."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, num, with_eigenvalues, with_smallest_axis
from .neighbours import XYZ, density, knn

#: Edges of the evaluation's distance bins (fixed values): hundredths to 0.1, tenths to 1, and beyond.
DISTANCE_EDGES = [*(i / 100 for i in range(10)), *(i / 10 for i in range(1, 11)), math.inf]
#: Edges of the heat-map (fixed values): radius in cm, height in m.
RADIUS_EDGES = [0, 1, 2, 4, 8, 16, 32]
HEIGHT_EDGES = [0, 5, 10, 15, 20, 25, 30, math.inf]


def bin_of(v: Column, edges: list[float], last_closed: bool = True) -> Column:
    """Number of the half-open bin; the last one is closed if asked for. Null outside and for null or NaN."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low, high = num(edges[i]), num(edges[i + 1])
        inside = (v >= low) & ((v <= high) if last_closed and i == len(edges) - 2 else (v < high))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return F.when(~F.isnan(v), out)


def binned(df: DataFrame, key: str, value: str, edges: list[float], last_closed: bool = True) -> DataFrame:
    """Count, mean and deviation of value in each bin of key; empty bins stay, with null mean."""
    got = df.select(bin_of(F.col(key), edges, last_closed).alias("bin"), F.col(value).alias("_v")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
    bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std")


def bin_centres(edges: list[float], geometric: bool = False) -> list[float | None]:
    """Middle of each bin: arithmetic, or the root of the edges' product; None for an open bin."""
    mid = [(math.sqrt(a * b) if geometric else (a + b) / 2) for a, b in zip(edges, edges[1:])]
    return [None if math.isinf(m) else m for m in mid]


def log_edges(low: float, high: float, multipliers: tuple[int, ...] = (1, 2, 5)) -> list[float]:
    """The edges of log_bins as a list, in order."""
    inner = (m * 10.0**o for o in range(math.floor(math.log10(low)), math.ceil(math.log10(high)) + 1) for m in multipliers)
    return sorted({low, high, *(e for e in inner if low < e < high)})


def log_bins(spark: SparkSession, low: float, high: float, multipliers: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """Edges m * 10^o between low and high, with both ends put in."""
    orders = range(math.floor(math.log10(low)), math.ceil(math.log10(high)) + 1)
    inner = spark.range(1).select(F.explode(F.sequence(F.lit(orders.start), F.lit(orders.stop - 1))).alias("o")).select("o", F.explode(F.array(*(num(m) for m in multipliers))).alias("m"))
    inner = inner.select((F.col("m") * F.pow(num(10), F.col("o"))).alias("edge")).filter((F.col("edge") > low) & (F.col("edge") < high))
    return inner.union(spark.range(1).select(F.explode(F.array(num(low), num(high))))).distinct()


def mean_error(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, standard error (deviation / root of n) and deviation; nulls for no values."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.stddev_pop(v) / F.sqrt(F.count(v))).alias("sem"), F.stddev_pop(v).alias("std"))


def power_law(df: DataFrame, x: str, y: str) -> DataFrame:
    """y = a * x^b by least squares on logarithms (values held at 1e-8 or more): n, a, b and their standard errors (a's by a times the error of ln a)."""
    lx, ly = (F.log(F.greatest(F.col(c), num(1e-8))) for c in (x, y))
    s = df.select(lx.alias("lx"), ly.alias("ly")).agg(F.regr_count("ly", "lx").alias("n"), F.regr_slope("ly", "lx").alias("b"), F.regr_intercept("ly", "lx").alias("la"), F.regr_sxx("ly", "lx").alias("sxx"), F.regr_syy("ly", "lx").alias("syy"), F.avg("lx").alias("mx"))
    rest = F.greatest(num(0), (F.col("syy") - F.col("b") * F.col("b") * F.col("sxx"))) / F.when(F.col("n") > 2, F.col("n") - 2)
    a = F.exp("la")
    return s.select("n", a.alias("a"), F.col("b"), (a * F.sqrt(rest * (1 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx")))).alias("a_err"), F.sqrt(rest / F.col("sxx")).alias("b_err"))


def heat_map(df: DataFrame, radius_cm: Column, height: Column, value: str, percentile: float | None = None) -> DataFrame:
    """Mean (or the linear percentile) and count of value by radius and height bin, both half-open; rows outside are left out."""
    how = F.avg(value) if percentile is None else F.percentile(value, num(percentile))
    binned_rows = df.select(bin_of(radius_cm, RADIUS_EDGES, False).alias("radius_bin"), bin_of(height, HEIGHT_EDGES, False).alias("height_bin"), value)
    return binned_rows.filter("radius_bin is not null and height_bin is not null").groupBy("radius_bin", "height_bin").agg(F.count(F.lit(1)).alias("n"), how.alias("v"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in equal bins on [low, high], the last closed; density = n / (all counted * width)."""
    width = (high - low) / bins
    v = F.col(value)
    b = F.least(F.floor((v - num(low)) / num(width)), F.lit(bins - 1)).cast("int")
    n = df.filter((v >= low) & (v <= high)).groupBy(*(by or []), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = F.sum("n").over(Window.partitionBy(*(by or [])))
    return n.withColumns({"low_edge": num(low) + F.col("bin") * num(width), "density": F.col("n") / (every * num(width))})


def histogram_mode(hist: DataFrame) -> DataFrame:
    """The left edge of the fullest bin; ties: the lowest."""
    return hist.agg(F.max(F.struct("n", (-F.col("bin")).alias("b"), "low_edge")).alias("m")).select(F.col("m.low_edge").alias("mode"), F.col("m.n").alias("n"))


def fit_circles(df: DataFrame, by: list[str], u: str = "x", v: str = "y") -> DataFrame:
    """Algebraic circle fit per group: n, cx, cy, r. Null for fewer than three points, points on a line, or a negative r^2.

    Normal equations over values relative to the group's mean (one more pass, for conditioning), solved by Cramer's rule.
    """
    mean = df.groupBy(*by).agg(F.avg(u).alias("_mu"), F.avg(v).alias("_mv"))
    a, b = F.col(u) - F.col("_mu"), F.col(v) - F.col("_mv")
    s = df.join(mean, by).select(*by, "_mu", "_mv", a.alias("a"), b.alias("b")).withColumn("q", F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    s = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("_mu").alias("mu"), F.first("_mv").alias("mv"), *(F.sum(e).alias(k) for k, e in {"aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b"), "aq": F.col("a") * F.col("q"), "bq": F.col("b") * F.col("q"), "q": F.col("q")}.items()))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    scale = (F.col("aa") + F.col("bb")) * (F.col("aa") + F.col("bb"))
    ok = (F.col("n") >= 3) & (det > scale * 1e-12)
    cx = (F.col("aq") * F.col("bb") - F.col("bq") * F.col("ab")) / (2 * F.when(ok, det))
    cy = (F.col("bq") * F.col("aa") - F.col("aq") * F.col("ab")) / (2 * F.when(ok, det))
    s = s.withColumns({"_cx": cx, "_cy": cy})
    r2 = F.col("q") / F.col("n") + F.col("_cx") * F.col("_cx") + F.col("_cy") * F.col("_cy")
    return s.select(*by, "n", (F.col("_cx") + F.col("mu")).alias("cx"), (F.col("_cy") + F.col("mv")).alias("cy"), F.when(r2 >= 0, F.sqrt(r2)).alias("r"))


def subsampled_circles(df: DataFrame, by: list[str], rank: Column, fits: int, share: float, u: str = "x", v: str = "y") -> DataFrame:
    """Mean of `fits` circle fits on subsets of share of each group's points; rank(fit) orders a group's points anew for each fit (column `fit` is at hand). Falls back to the fit on all points."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    x = df.join(n, by).withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(fits - 1))))
    w = Window.partitionBy(*by, "fit").orderBy(rank, "point_id")
    part = x.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= F.floor(F.col("_n") * num(share)))
    some = fit_circles(part, [*by, "fit"], u, v).groupBy(*by).agg(F.avg("cx").alias("sx"), F.avg("cy").alias("sy"), F.avg("r").alias("sr"), F.count("r").alias("n_fits"))
    whole = fit_circles(df, by, u, v)
    return whole.join(some, by, "left").select(*by, "n", "n_fits", F.coalesce("sx", "cx").alias("cx"), F.coalesce("sy", "cy").alias("cy"), F.coalesce("sr", "r").alias("r"))


def stem_base(points: DataFrame, first: float = 0.10, last: float = 0.5, step: float = 0.10, least: int = 3) -> DataFrame:
    """Base of each tree's stem: circle centre of the thinnest slice above the lowest point (first, first + step, ... below last) with enough points for a fit, else the slice's centroid; z is the lowest point's."""
    low = points.groupBy("tree_id").agg(F.min("z").alias("base"))
    near = points.join(low, "tree_id").withColumn("up", F.col("z") - F.col("base")).filter(F.col("up") < last)
    heights = [first + i * step for i in range(int(round((last - first) / step)) or 1)]
    counts = near.groupBy("tree_id").agg(*(F.count(F.when(F.col("up") < h, 1)).alias(f"c{i}") for i, h in enumerate(heights)))
    pick = num(heights[-1])
    for i in range(len(heights) - 1, -1, -1):
        pick = F.when(F.col(f"c{i}") >= least, num(heights[i])).otherwise(pick)
    part = near.join(counts.select("tree_id", pick.alias("slice")), "tree_id").filter(F.col("up") < F.col("slice"))
    fit = fit_circles(part, ["tree_id"])
    mid = part.groupBy("tree_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.first("base").alias("bz"), F.first("slice").alias("slice"))
    return fit.join(mid, "tree_id").select("tree_id", F.coalesce("cx", "mx").alias("bx"), F.coalesce("cy", "my").alias("by"), "bz", "slice", "n")


def model_base(cylinders: DataFrame, order_col: str | None = None) -> DataFrame:
    """Start of each tree's lowest cylinder, among branch order 0 where there is one; rows with null or NaN starts are left out, ties go to the lower id."""
    ok = cylinders.filter(" and ".join(f"s{k} is not null and not isnan(s{k})" for k in XYZ))
    first = F.when(F.col(order_col) == 0, 0).otherwise(1) if order_col else F.lit(0)
    m = ok.groupBy("tree_id").agg(F.min(F.struct(first.alias("o"), F.col("sz"), F.col("id"), F.col("sx"), F.col("sy"))).alias("m"))
    return m.select("tree_id", F.col("m.sx").alias("bx"), F.col("m.sy").alias("by"), F.col("m.sz").alias("bz"))


def align_model(cylinders: DataFrame, points: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """Cylinders moved so that their base stands at the cloud's (a shift per tree)."""
    cloud = (bases if bases is not None else stem_base(points)).select("tree_id", "bx", "by", "bz")
    shift = model_base(cylinders).select("tree_id", *(F.col(f"b{k}").alias(f"m{k}") for k in XYZ)).join(cloud, "tree_id").select("tree_id", *((F.col(f"m{k}") - F.col(f"b{k}")).alias(f"t{k}") for k in XYZ))
    return cylinders.join(shift, "tree_id").withColumns({f"{e}{k}": F.col(f"{e}{k}") - F.col(f"t{k}") for e in "se" for k in XYZ}).drop("tx", "ty", "tz")


def neighbour_distance(points: DataFrame, k: int) -> DataFrame:
    """Mean distance to the k nearest others of each point."""
    near = knn(points, points, k + 1).filter(F.col("other_id") != F.col("point_id"))
    w = Window.partitionBy("tree_id", "point_id").orderBy("d", "other_id")
    near = near.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k)
    return near.groupBy("tree_id", "point_id").agg(F.avg("d").alias("mean_distance"))


def covariance(points: DataFrame, k: int) -> DataFrame:
    """Sample covariance of the k nearest points (the point included) around each point."""
    o = points.select("tree_id", F.col("point_id").alias("other_id"), *XYZ)
    near = knn(points, points, k).join(o, ["tree_id", "other_id"])
    pairs = {"xx": "xx", "yy": "yy", "zz": "zz", "xy": "xy", "xz": "xz", "yz": "yz"}
    return near.groupBy("tree_id", "point_id").agg(*(F.covar_samp(a[0], a[1]).alias(f"c{n}") for n, a in pairs.items()))


def curvature(cov: DataFrame) -> DataFrame:
    """Smallest eigenvalue over the trace plus 1e-6."""
    return with_eigenvalues(cov).select("tree_id", "point_id", (F.greatest("l2", num(0)) / (F.col("cxx") + F.col("cyy") + F.col("czz") + num(1e-6))).alias("curvature"))


def normals(cov: DataFrame) -> DataFrame:
    """Direction of least variance; its sign is arbitrary. verticality = |nz|."""
    return with_smallest_axis(with_eigenvalues(cov)).select("tree_id", "point_id", "nx", "ny", "nz", F.abs("nz").alias("verticality"))


def add_features(points: DataFrame, use_normals: bool = True, use_curvature: bool = True, use_density: bool = True, k_normal: int = 15, k_curve: int = 10, radius: float = 0.1) -> DataFrame:
    """Normal, verticality, curvature and density columns, each on demand."""
    key, out = ["tree_id", "point_id"], points
    if use_normals:
        out = out.join(normals(covariance(points, k_normal)), key, "left")
    if use_curvature:
        out = out.join(curvature(covariance(points, k_curve)), key, "left")
    if use_density:
        out = out.join(density(points, radius), key, "left")
    return out


def principal_axes(df: DataFrame, by: list[str]) -> DataFrame:
    """Sample covariance and sorted eigenvalues of each group's coordinates, with the plane's normal."""
    cov = df.groupBy(*by).agg(*(F.covar_samp(a[0], a[1]).alias(f"c{a}") for a in ("xx", "yy", "zz", "xy", "xz", "yz")))
    return with_smallest_axis(with_eigenvalues(cov)).select(*by, "l0", "l1", "l2", "nx", "ny", "nz")


def merge_spheres(spheres: DataFrame, by: list[str], rule: str = "weighted") -> DataFrame:
    """Spheres (x, y, z, spread, radius, weight) of a group made one: weighted centre and spread; radius by rule: weighted mean, enclosed (covers all), or subset (the largest)."""
    w = F.col("weight")
    m = spheres.groupBy(*by).agg(*((F.sum(w * F.col(k)) / F.sum(w)).alias(f"m{k}") for k in XYZ), (F.sum(w * F.col("spread")) / F.sum(w)).alias("mspread"), F.sum(w).alias("mweight"))
    x = spheres.join(m, by)
    reach = distance([F.col(k) for k in XYZ], [F.col(f"m{k}") for k in XYZ]) + F.col("radius")
    how = {"weighted": F.sum(w * F.col("radius")) / F.sum(w), "enclosed": F.max(reach), "subset": F.max("radius")}[rule]
    return x.groupBy(*by).agg(*(F.first(f"m{k}").alias(k) for k in XYZ), F.first("mspread").alias("spread"), how.alias("radius"), F.first("mweight").alias("weight"))


def point_losses(df: DataFrame) -> DataFrame:
    """Mean cross-entropy of (l0, l1) against label, and mean root of max(|difference|^2, 1e-8) of offsets (dx.. against tx..) where masked."""
    top = F.greatest("l0", "l1")
    own = F.when(F.col("label") == 1, F.col("l1")).otherwise(F.col("l0"))
    ce = top + F.log(F.exp(F.col("l0") - top) + F.exp(F.col("l1") - top)) - own
    d2 = sum(((F.col(f"d{k}") - F.col(f"t{k}")) * (F.col(f"d{k}") - F.col(f"t{k}")) for k in XYZ), num(0))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(ce).alias("semantic_loss"), F.avg(F.when(F.col("mask"), F.sqrt(F.greatest(d2, num(1e-8))))).alias("offset_loss"))


def early_stop(losses: DataFrame, patience: int, run: str = "run") -> DataFrame:
    """Per run: best loss, its epoch, and the epoch that stops (null: none): the first one `patience` epochs after the last strict improvement."""
    w = Window.partitionBy(run).orderBy("epoch")
    x = losses.withColumn("before", F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    better = F.col("before").isNull() | (F.col("loss") < F.col("before"))
    x = x.withColumn("improved", F.max(F.when(better, F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stop = x.groupBy(run).agg(F.min(F.when(F.col("epoch") - F.col("improved") >= patience, F.col("epoch"))).alias("stop_epoch"))
    seen = x.join(stop, run).filter(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
    best = seen.groupBy(run).agg(F.min(F.struct("loss", "epoch")).alias("b"), F.first("stop_epoch").alias("stop_epoch"))
    return best.select(run, F.col("b.loss").alias("best_loss"), F.col("b.epoch").alias("best_epoch"), "stop_epoch")
