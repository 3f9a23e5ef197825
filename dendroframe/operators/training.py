"""Training of a head (linear, or a small dense network) over a table of features, each step a Spark job.

A step's tasks add up the gradients of their rows in Arrow batches and give one row each; sums by parameter make one gradient
of the whole batch, as long as the model, for the driver to step with. Nothing of the data's size leaves the tasks. After each
epoch parameters and optimiser state go to the folder, so a stopped run goes on from its last epoch with the same curve.

Loss: mean cross-entropy of (l0, l1) against the label, plus the mean root of max(|difference|^2, 1e-8) of offsets where
masked, each times its multiplier. Gradients are clipped to a norm of `clip`; AdamW; the rate follows a cosine from rate to
least_rate over `period` epochs and starts again; training stops after `patience` epochs without a lower validation loss.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layers import mapped, matrix, rows_of

OUT = 5  # dx, dy, dz, l0, l1


@dataclass(frozen=True)
class Training:
    """How to train; rates, decay and clip are the published configuration's kind."""

    epochs: int = 100
    rate: float = 1e-3
    least_rate: float = 1e-5
    period: int = 50
    decay: float = 1e-3
    clip: float = 1.0
    patience: int = 20
    batches: int = 1
    semantic: float = 1.0
    offset: float = 1.0
    seed: int = 0

    def rate_at(self, epoch: int) -> float:
        return self.least_rate + (self.rate - self.least_rate) * (1 + math.cos(math.pi * (epoch % self.period) / self.period)) / 2


class Dense:
    """Layers of these sizes as one vector of parameters (each layer's weights, row by row, then its biases); activations between them."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.cuts = np.cumsum([0, *(b * a + b for a, b in zip(sizes, sizes[1:]))])

    def start(self, seed: int) -> np.ndarray:
        """Weights uniform within root(6 / (in + out)), biases 0."""
        rng, out = np.random.default_rng(seed), []
        for a, b in zip(self.sizes, self.sizes[1:]):
            out += [rng.uniform(-1, 1, a * b) * math.sqrt(6 / (a + b)), np.zeros(b)]
        return np.concatenate(out)

    def layers(self, p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = [p[a:b] for a, b in zip(self.cuts, self.cuts[1:])]
        return [(x[: a * b].reshape(b, a), x[a * b :]) for x, a, b in zip(parts, self.sizes, self.sizes[1:])]

    def forward(self, p: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """The input and every layer's output."""
        out, last = [x], len(self.sizes) - 2
        for i, (w, b) in enumerate(self.layers(p)):
            y = out[-1] @ w.T + b
            out.append(np.maximum(y, 0) if i < last else y)
        return out

    def backward(self, p: np.ndarray, held: list[np.ndarray], grad: np.ndarray) -> np.ndarray:
        """The gradient by parameters of a sum over rows, from that by outputs."""
        parts = []
        for i, (w, _) in reversed(list(enumerate(self.layers(p)))):
            parts[:0] = [(grad.T @ held[i]).ravel(), grad.sum(axis=0)]
            if i:
                grad = (grad @ w) * (held[i] > 0)
        return np.concatenate(parts)


def losses(out: np.ndarray, target: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Sums of cross-entropy and of masked offset lengths, and their gradients by outputs."""
    logits = out[:, 3:]
    top = logits.max(axis=1, keepdims=True)
    e = np.exp(logits - top)
    p = e / e.sum(axis=1, keepdims=True)
    own = np.arange(len(out)), label
    ce = float((top[:, 0] + np.log(e.sum(axis=1)) - logits[own]).sum())
    by_ce, by_offset = np.zeros_like(out), np.zeros_like(out)
    by_ce[:, 3:] = p
    by_ce[own[0], 3 + label] -= 1
    gap = out[:, :3] - target
    square = (gap**2).sum(axis=1)
    length = np.sqrt(np.maximum(square, 1e-8))
    by_offset[:, :3] = np.where((mask & (square > 1e-8))[:, None], gap / length[:, None], 0)
    return ce, float(length[mask].sum()), by_ce, by_offset


def sums(df: DataFrame, model: Dense, p: np.ndarray, gradients: bool = True) -> np.ndarray:
    """Over all rows (feat, dx, dy, dz, label, mask): rows, masked rows, both losses' sums, and both gradients."""

    def run(batches):
        total = np.zeros(4 + (2 * len(p) if gradients else 0))
        for b in batches:
            if not b.num_rows:
                continue
            held = model.forward(p, matrix(b.column(0)))
            target = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], axis=1)
            mask = b.column(5).to_numpy(zero_copy_only=False).astype(bool)
            ce, length, by_ce, by_offset = losses(held[-1], target, b.column(4).to_numpy(zero_copy_only=False).astype(int), mask)
            total[:4] += [b.num_rows, mask.sum(), ce, length]
            if gradients:
                total[4:] += np.concatenate([model.backward(p, held, by_ce), model.backward(p, held, by_offset)])
        yield pa.RecordBatch.from_arrays([rows_of(total[None])], names=["v"])

    parts = df.select("feat", *(F.col(c).cast("double") for c in ("dx", "dy", "dz")), F.col("label").cast("int"), F.coalesce("mask", F.lit(False)).alias("mask")).mapInArrow(run, "v array<double>")
    out = np.zeros(4 + (2 * len(p) if gradients else 0))
    for r in parts.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).collect():
        out[r.pos] = r.x
    return out


def _mean_losses(s: np.ndarray, how: Training) -> float:
    return how.semantic * s[2] / max(1.0, s[0]) + how.offset * s[3] / max(1.0, s[1])


def _gradient(s: np.ndarray, how: Training) -> np.ndarray:
    n = (len(s) - 4) // 2
    g = how.semantic * s[4 : 4 + n] / max(1.0, s[0]) + how.offset * s[4 + n :] / max(1.0, s[1])
    return g * min(1.0, how.clip / (math.sqrt(float(g @ g)) + 1e-6))


def adamw(p: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, step: int, rate: float, decay: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
    return p * (1 - rate * decay) - rate * (m / (1 - b1**step)) / (np.sqrt(v / (1 - b2**step)) + eps), m, v


_STATE = "epoch int, step long, rate double, train double, validation double, best double, since int, p array<double>, m array<double>, v array<double>, best_p array<double>"


def _exists(spark, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def train_head(train: DataFrame, validation: DataFrame, folder: str, hidden: list[int] | None = None, how: Training = Training(), start: np.ndarray | None = None, deal: Column | None = None) -> tuple[Dense, np.ndarray, DataFrame]:
    """(model, best parameters, curve): curve has a row for each epoch: epoch, rate, train, validation (mean losses; train: before the epoch's steps).

    Rows have feat (all of one length), dx, dy, dz, label (0 or 1), mask. With several batches the rows are dealt to them by a
    hash of `deal` (by default of the features) and written to the folder once, a part each. The folder must be one that all
    executors share, and keeps one run: called again, the run goes on where it stopped.
    """
    spark = train.sparkSession
    first = train.select(F.size("feat").alias("n")).first()
    if first is None:
        raise ValueError("no rows to train on")
    model = Dense([first.n, *(hidden or []), OUT])
    if how.batches > 1:
        if not _exists(spark, f"{folder}/rows/_SUCCESS"):
            by = F.pmod(F.xxhash64(F.lit(how.seed), deal if deal is not None else F.col("feat")), how.batches)
            train.select("feat", "dx", "dy", "dz", "label", "mask", by.alias("_batch")).write.partitionBy("_batch").mode("overwrite").parquet(f"{folder}/rows")
        rows = spark.read.parquet(f"{folder}/rows")
        parts = [rows.filter(F.col("_batch") == i) for i in range(how.batches)]
    else:
        parts = [train]
    state = None
    if _exists(spark, f"{folder}/epoch-*/_SUCCESS"):
        state = spark.read.schema(_STATE).parquet(f"{folder}/epoch-*").orderBy(F.desc("epoch")).first()
    if state is None:
        p = model.start(how.seed) if start is None else np.asarray(start, float)
        epoch, step, m, v, best, since, best_p = 0, 0, np.zeros_like(p), np.zeros_like(p), math.inf, 0, p
    else:
        p, m, v, best_p = (np.array(x) for x in (state.p, state.m, state.v, state.best_p))
        epoch, step, best, since = state.epoch + 1, state.step, state.best, state.since
    while epoch < how.epochs and since < how.patience:
        rate, seen = how.rate_at(epoch), np.zeros(4)
        for part in parts:
            s = sums(part, model, p)
            seen += s[:4]
            step += 1
            p, m, v = adamw(p, m, v, _gradient(s, how), step, rate, how.decay)
        loss = _mean_losses(sums(validation, model, p, False), how)
        since, best_p = (0, p) if loss < best else (since + 1, best_p)
        best = min(best, loss)
        row = (epoch, step, rate, float(_mean_losses(seen, how)), float(loss), float(best), since, p.tolist(), m.tolist(), v.tolist(), best_p.tolist())
        spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch-{epoch:06d}")
        epoch += 1
    curve = spark.read.schema(_STATE).parquet(f"{folder}/epoch-*").select("epoch", "rate", "train", "validation")
    return model, best_p, curve


def apply_head(df: DataFrame, model: Dense, p: np.ndarray) -> DataFrame:
    """df with dx, dy, dz, l0, l1 of a trained head over its features."""
    out = mapped(df.drop("dx", "dy", "dz", "l0", "l1").withColumn("_out", F.col("feat")), lambda x: model.forward(p, x)[-1], col="_out")
    return out.withColumns({c: F.col("_out")[i] for i, c in enumerate(("dx", "dy", "dz", "l0", "l1"))}).drop("_out")
