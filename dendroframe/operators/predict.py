"""Prediction of offsets and noise: a registry of predictors over DataFrames, and baselines that need no weights.

A learned model is added as a function from arrays to arrays; it runs in Arrow batches beside the native steps before and
after it (voxels, serialisation, patches). No weights are shipped; the baselines are no stand-in for a trained model.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import num
from .layers import sparse_unet
from .neighbours import label_points
from .points import apply_offset, denoise, offset_labels
from .stats import neighbour_distance

PREDICTORS: dict[str, Callable[..., DataFrame]] = {}


def predictor(name: str):
    def add(f):
        PREDICTORS[name] = f
        return f

    return add


@predictor("no_model")
def no_model(points: DataFrame) -> DataFrame:
    return points.withColumns({"dx": num(0), "dy": num(0), "dz": num(0), "l0": num(1), "l1": num(0)})


@predictor("oracle_offset")
def oracle_offset(points: DataFrame, cylinders: DataFrame, tau: float = 0.1) -> DataFrame:
    """Baseline: offsets to a given cylinder model; noise where they are longer than tau."""
    p = offset_labels(label_points(points, cylinders), tau)
    return p.withColumns({"l0": 1.0 - F.col("is_noise"), "l1": F.col("is_noise").cast("double")})


@predictor("statistical")
def statistical(points: DataFrame, k: int = 8, z: float = 2.0) -> DataFrame:
    """Baseline: no offset; noise where the mean distance to k neighbours is more than z deviations above the tree's mean."""
    d = neighbour_distance(points, k)
    s = d.groupBy("tree_id").agg(F.avg("mean_distance").alias("_m"), F.stddev_pop("mean_distance").alias("_s"))
    bad = d.join(s, "tree_id").select("tree_id", "point_id", (F.col("mean_distance") > F.col("_m") + z * F.col("_s")).cast("double").alias("l1"))
    return points.withColumns({"dx": num(0), "dy": num(0), "dz": num(0)}).join(bad, ["tree_id", "point_id"], "left").withColumn("l1", F.coalesce("l1", num(0))).withColumn("l0", 1 - F.col("l1"))


@predictor("sparse_unet")
def unet(points: DataFrame, weights: dict[str, np.ndarray], **options) -> DataFrame:
    """A trained sparse U-net, its arrays as load_weights reads them (layers.sparse_unet)."""
    return sparse_unet(points, weights, **options)


def _predicted(key: DataFrame) -> T.StructType:
    return T.StructType([*key.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("dx", "dy", "dz", "l0", "l1"))])


def array_predictor(model: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[DataFrame], DataFrame]:
    """A predictor from a function of one tree's coordinates (n x 3) to offsets (n x 3) and logits (n x 2)."""

    def run_all(points: DataFrame) -> DataFrame:
        key = points.select("tree_id", "point_id", "x", "y", "z")
        schema = _predicted(key)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("point_id")
            offset, logits = model(pdf[["x", "y", "z"]].to_numpy(float))
            return pdf.assign(**{c: offset[:, i] for i, c in enumerate(("dx", "dy", "dz"))}, l0=logits[:, 0], l1=logits[:, 1])

        return key.groupBy("tree_id").applyInPandas(run, schema)

    return run_all


def predict(points: DataFrame, model: str, offset: bool = True, clean: bool = True, **options) -> DataFrame:
    """Both heads see the given coordinates; then noise goes and the offsets are applied."""
    if model not in PREDICTORS:
        raise ValueError(f"unknown model {model}; there are {sorted(PREDICTORS)}")
    out = PREDICTORS[model](points, **options)
    if clean:
        out = denoise(out)
    return apply_offset(out) if offset else out


def weight_files(offset_dir: str, noise_dir: str, end: str = ".npz") -> dict[str, str]:
    """Files of trained weights by key: 'O_<plot>' for offsets and 'N_<plot>' for noise, the plot being the name's last part after an underscore."""
    found = {}
    for head, folder in (("O", offset_dir), ("N", noise_dir)):
        for name in sorted(os.listdir(folder)):
            if name.endswith(end):
                found[f"{head}_{name.removesuffix(end).split('_')[-1]}"] = f"{folder}/{name}"
    return found


def load_weights(path: str) -> dict[str, np.ndarray]:
    """The arrays of an .npz file by name (never pickled objects)."""
    with np.load(path, allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def plot_predictor(models: dict[str, Callable[[np.ndarray], np.ndarray]]) -> Callable[[DataFrame], DataFrame]:
    """A predictor from models by plot, as weight_files keys them: 'O_<plot>' gives offsets (n x 3), 'N_<plot>' logits (n x 2) from a tree's coordinates. A tree's plot is the first character of its id; without an offset model its offsets are 0, without a noise model no point is noise."""

    def run_all(points: DataFrame) -> DataFrame:
        key = points.select("tree_id", "point_id", "x", "y", "z")
        schema = _predicted(key)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("point_id")
            xyz, plot = pdf[["x", "y", "z"]].to_numpy(float), str(pdf.tree_id.iloc[0])[:1]
            offset = models[f"O_{plot}"](xyz) if f"O_{plot}" in models else np.zeros((len(xyz), 3))
            logits = models[f"N_{plot}"](xyz) if f"N_{plot}" in models else np.tile([1.0, 0.0], (len(xyz), 1))
            return pdf.assign(**{c: offset[:, i] for i, c in enumerate(("dx", "dy", "dz"))}, l0=logits[:, 0], l1=logits[:, 1])

        return key.groupBy("tree_id").applyInPandas(run, schema)

    return run_all


def augment(points: DataFrame, change: Callable[[np.ndarray, np.ndarray, np.random.Generator], tuple[np.ndarray, np.ndarray]], seed: int = 0) -> DataFrame:
    """Training augmentation: change(coordinates, offsets, generator) of each tree's points (n x 3 each) gives new ones. The generator is seeded by seed and tree, so a repeated task gives the same rows; other columns are kept."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        rng = np.random.default_rng([seed, *str(pdf.tree_id.iloc[0]).encode()])
        xyz, offset = change(pdf[["x", "y", "z"]].to_numpy(float), pdf[["dx", "dy", "dz"]].to_numpy(float), rng)
        return pdf.assign(**{c: a[:, i] for a, names in ((xyz, "x y z"), (offset, "dx dy dz")) for i, c in enumerate(names.split())})

    return points.groupBy("tree_id").applyInPandas(run, points.schema)


def turned(degrees: float = 180.0, scale: float = 0.05) -> Callable:
    """An augmentation: a random turn about the vertical axis up to `degrees` either way, and a random scale within 1 +- scale; offsets go along."""

    def change(xyz: np.ndarray, offset: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        a, f = np.radians(rng.uniform(-degrees, degrees)), rng.uniform(1 - scale, 1 + scale)
        turn = f * np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
        return xyz @ turn.T, offset @ turn.T

    return change
