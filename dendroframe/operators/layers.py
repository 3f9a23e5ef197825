"""Layers of trained networks over tables of features, and sparse convolutions over voxels.

Features are an array column. What a layer does to each row alone (products with weights, norms, activations) runs in Arrow
batches; what rows exchange is Spark's work: joins on voxel keys, and sums by partial aggregation. Weights are arrays by
name, as load_weights reads them; they travel with a layer's code (Spark broadcasts
it when it is large), and their size is the model's, not the data's.

A voxel's key is its tree and the Morton code of its cell, so a coarser level's key is the code without its last three bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import morton, morton_decode
from ..sources.scratch import cut
from .grid import voxel_key, voxelise

#: Bits of a cell number in a voxel's code, and bits of a tile's edge: 16^3 voxels, so many voxels that a task holds at a time.
DEPTH, TILE = 20, 4
EPS = 1e-4

Step = Callable[[np.ndarray], np.ndarray]


def matrix(column: pa.Array) -> np.ndarray:
    """An array column's rows, all of one length, as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def rows_of(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.float64()))


def linear(weight: np.ndarray, bias: np.ndarray | None = None) -> Step:
    """x W' + b; weights of 1 x 1 convolutions too."""
    w = weight.reshape(len(weight), -1).astype(float)
    return lambda x: x @ w.T + (0 if bias is None else bias)


def batch_norm(w: dict[str, np.ndarray], name: str, eps: float = EPS) -> Step:
    """A trained batch norm: its running mean and variance."""
    scale = w[f"{name}.weight"] / np.sqrt(w[f"{name}.running_var"] + eps)
    shift = w[f"{name}.bias"] - w[f"{name}.running_mean"] * scale
    return lambda x: x * scale + shift


def layer_norm(w: dict[str, np.ndarray], name: str, eps: float = 1e-5) -> Step:
    gain, shift = w[f"{name}.weight"], w[f"{name}.bias"]
    return lambda x: (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + eps) * gain + shift


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


_erf = np.frompyfunc(math.erf, 1, 1)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)).astype(float))


def mapped(df: DataFrame, *steps: Step, col: str = "feat") -> DataFrame:
    """df with the steps applied to each row's features."""
    at = df.columns.index(col)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(at))
                for f in steps:
                    x = f(x)
                yield pa.RecordBatch.from_arrays([rows_of(x) if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(run, df.withColumn(col, F.lit(None).cast("array<double>")).schema)


def summed(terms: DataFrame, width: int, *by: str) -> DataFrame:
    """Elementwise sum of the features of each key: a sum per place, so tasks add up what they hold before the shuffle."""
    return terms.groupBy(*by).agg(F.array(*(F.sum(F.col("feat")[i]) for i in range(width))).alias("feat"))


# -- sparse convolutions


def voxel_features(points: DataFrame, size: float, features: list[str], use_features: bool = True, use_coords: bool = False, most: int | None = 10) -> DataFrame:
    """tree_id, code, feat: means of features, then coordinates, over a voxel's first `most` points by id; what is not used is 1."""
    v = voxelise(points, size, features, most)
    one = F.lit(1.0)
    feat = [*(F.col(f"mean_{c}") if use_features else one for c in features), *(F.col(f"mean_{c}") if use_coords else one for c in "xyz")]
    return v.select("tree_id", morton(F.col("vx"), F.col("vy"), F.col("vz"), DEPTH).alias("code"), F.array(*feat).alias("feat"))


def _spread(d: int) -> int:
    """Bits of d with two empty bits after each."""
    return sum(((d >> i) & 1) << 3 * i for i in range(DEPTH))


def _stepped(code: Column, steps: tuple[int, int, int]) -> Column:
    """The code of the cell so many cells away along x, y, z; null beyond the grid. Sums are taken on the interleaved bits: those between an axis's own pass a carry on when they are set, and a borrow when they are not."""
    parts, inside = [], F.lit(True)
    for bit, d in zip((2, 1, 0), steps):
        mask = _spread(2**DEPTH - 1) << bit
        own, by = code.bitwiseAND(F.lit(mask)), F.lit(_spread(abs(d)) << bit)
        if d > 0:
            own = (code.bitwiseOR(F.lit(~mask)) + by).bitwiseAND(F.lit(mask))
            inside = inside & (own >= by)  # else it went round
        elif d < 0:
            own, inside = (own - by).bitwiseAND(F.lit(mask)), inside & (own >= by)
        parts.append(own)
    return F.when(inside, parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]))


def rulebook(voxels: DataFrame, kernel: int = 3) -> DataFrame:
    """tree_id, code, offset, source: for each voxel those of its kernel's cells (offset = (z * kernel + y) * kernel + x) that are voxels too, itself included.

    One equi-join on voxel keys finds the neighbours on one side; each pair is a rule for both of its voxels.
    """
    r, last, own = kernel // 2, kernel**3 - 1, voxels.select("tree_id", "code").distinct()
    ahead = F.array(*(F.struct(F.lit(i).alias("offset"), _stepped(F.col("code"), (i % kernel - r, i // kernel % kernel - r, i // kernel**2 - r)).alias("source")) for i in range(last // 2 + 1, last + 1)))
    near = own.select("tree_id", "code", F.explode(ahead).alias("_s")).select("tree_id", "code", "_s.offset", "_s.source").filter("source is not null")
    met = near.join(own.select("tree_id", F.col("code").alias("source")), ["tree_id", "source"])
    rule = lambda a, o, b: F.struct(F.col(a).alias("code"), o.cast("int").alias("offset"), F.col(b).alias("source"))
    both = met.select("tree_id", F.explode(F.array(rule("code", F.col("offset"), "source"), rule("source", last - F.col("offset"), "code"))).alias("_r")).select("tree_id", "_r.*")
    return both.unionByName(own.select("tree_id", "code", F.lit(last // 2).alias("offset"), F.col("code").alias("source")))


def _offsets(weight: np.ndarray) -> np.ndarray:
    """Weights (out, z, y, x, in) as (offset, in, out)."""
    return weight.reshape(len(weight), -1, weight.shape[-1]).transpose(1, 2, 0).astype(float)


def conv_terms(features: DataFrame, rules: DataFrame, weight: np.ndarray) -> DataFrame:
    """The terms (tree_id, code, feat) whose sum by voxel is the submanifold convolution.

    Rules and features meet per tile of source voxels, of at most 16^3 voxels, so a task's memory is bounded; a tile adds up
    its own terms first and gives one row for each voxel that it reaches: its own and a rim of one voxel.
    """
    held = features.sparkSession.sparkContext.broadcast(_offsets(weight))
    f = features.select(F.col("tree_id").alias("_tree"), F.shiftright("code", 3 * TILE).alias("_part"), F.col("code").alias("source"), "feat")
    r = rules.select("tree_id", F.shiftright("source", 3 * TILE).alias("_tile"), "source", "offset", "code")

    def run(key, rules_, found):
        w = held.value
        out = np.zeros((0, w.shape[2]))
        codes = np.zeros(0, np.int64)
        if rules_.num_rows and found.num_rows:
            source, x = found["source"].to_numpy(), matrix(found["feat"].combine_chunks())
            order = np.argsort(source, kind="stable")
            source, x = source[order], x[order]
            code, offset = rules_["code"].to_numpy(), rules_["offset"].to_numpy()
            at = np.searchsorted(source, rules_["source"].to_numpy())
            known = at < len(source)
            known[known] = source[at[known]] == rules_["source"].to_numpy()[known]
            code, offset, at = code[known], offset[known], at[known]
            codes, to = np.unique(code, return_inverse=True)
            out = np.zeros((len(codes), w.shape[2]))
            for k in np.unique(offset):
                some = offset == k
                out[to[some]] += x[at[some]] @ w[k]  # an offset reaches a voxel once
        return pa.table({"tree_id": pa.array([key[0].as_py()] * len(codes), key[0].type), "code": pa.array(codes, pa.int64()), "feat": rows_of(out)})

    return r.groupBy("tree_id", "_tile").cogroup(f.groupBy("_tree", "_part")).applyInArrow(run, features.select("tree_id", "code", F.col("feat").cast("array<double>")).schema)


def sub_conv(features: DataFrame, rules: DataFrame, weight: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    """Submanifold convolution: every voxel's kernel over the voxels there are. weight: (out, z, y, x, in)."""
    out = summed(conv_terms(features, rules, weight), len(weight), "tree_id", "code")
    return out if bias is None else mapped(out, lambda x: x + bias)


def _by_corner(df: DataFrame, weight: np.ndarray) -> DataFrame:
    """feat times the weights of its voxel's place within the voxel one level up (column corner: bits x, y, z)."""
    held, at = df.sparkSession.sparkContext.broadcast(_offsets(weight)), df.columns.index("feat")
    corner = df.columns.index("corner")

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, k, w = matrix(b.column(at)), b.column(corner).to_numpy(), held.value
                y = np.zeros((len(x), w.shape[2]))
                for c in np.unique(k):  # code: x in bit 2, z in bit 0; weights: z first
                    y[k == c] = x[k == c] @ w[(c & 1) * 4 + (c >> 1 & 1) * 2 + (c >> 2)]
                yield pa.RecordBatch.from_arrays([rows_of(y) if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(run, df.withColumn("feat", F.lit(None).cast("array<double>")).schema).drop("corner")


def down_conv(features: DataFrame, weight: np.ndarray) -> DataFrame:
    """Kernel 2, stride 2: a voxel one level up sums up its eight, each with its place's weights. Keys are arithmetic; nothing is joined."""
    corner = F.col("code").bitwiseAND(F.lit(7).cast("long")).alias("corner")
    return summed(_by_corner(features.select("tree_id", F.shiftright("code", 3).alias("code"), corner, "feat"), weight), len(weight), "tree_id", "code")


def up_conv(coarse: DataFrame, fine: DataFrame, weight: np.ndarray) -> DataFrame:
    """The inverse of down_conv's pairs: each voxel of `fine` (tree_id, code) gets its coarser voxel's features times its place's weights."""
    up = fine.select("tree_id", "code", F.shiftright("code", 3).alias("_up"), F.col("code").bitwiseAND(F.lit(7).cast("long")).alias("corner"))
    both = up.join(coarse.select("tree_id", F.col("code").alias("_up"), "feat"), ["tree_id", "_up"]).select("tree_id", "code", "corner", "feat")
    return _by_corner(both, weight)


def residual_block(features: DataFrame, rules: DataFrame, w: dict[str, np.ndarray], name: str) -> DataFrame:
    """Twice norm, activation and submanifold convolution, plus the input (through a 1 x 1 convolution where channels change). The input joins as one more term of the last sum."""
    a = cut(sub_conv(mapped(features, batch_norm(w, f"{name}.conv_branch.0"), relu), rules, w[f"{name}.conv_branch.2.weight"]))
    last = w[f"{name}.conv_branch.5.weight"]
    terms = conv_terms(mapped(a, batch_norm(w, f"{name}.conv_branch.3"), relu), rules, last)
    one = f"{name}.i_branch.0.weight"
    own = mapped(features, linear(w[one])) if one in w else features
    return cut(summed(terms.unionByName(own.select("tree_id", "code", F.col("feat").cast("array<double>"))), len(last), "tree_id", "code"))


def u_block(features: DataFrame, w: dict[str, np.ndarray], name: str) -> DataFrame:
    """Residual blocks, a coarser level within (while there are weights for one), and residual blocks over both levels' features."""
    rules, i = cut(rulebook(features)), 0
    while f"{name}.blocks.block{i}.conv_branch.0.weight" in w:
        features = residual_block(features, rules, w, f"{name}.blocks.block{i}")
        i += 1
    if f"{name}.conv.2.weight" in w:
        inner = cut(down_conv(mapped(features, batch_norm(w, f"{name}.conv.0"), relu), w[f"{name}.conv.2.weight"]))
        inner = u_block(inner, w, f"{name}.u")
        up = up_conv(mapped(inner, batch_norm(w, f"{name}.deconv.0"), relu), features, w[f"{name}.deconv.2.weight"])
        features = cut(features.join(up.select("tree_id", "code", F.col("feat").alias("_up")), ["tree_id", "code"]).select("tree_id", "code", F.concat("feat", "_up").alias("feat")))
        i = 0
        while f"{name}.blocks_tail.block{i}.conv_branch.0.weight" in w:
            features = residual_block(features, rules, w, f"{name}.blocks_tail.block{i}")
            i += 1
    return features


def head(w: dict[str, np.ndarray], name: str, last: int = 3, eps: float = EPS) -> list[Step]:
    """A head of two layers: linear, norm, activation, linear."""
    return [linear(w[f"{name}.0.weight"], w[f"{name}.0.bias"]), batch_norm(w, f"{name}.1", eps), relu, linear(w[f"{name}.{last}.weight"], w[f"{name}.{last}.bias"])]


def sparse_unet(points: DataFrame, weights: dict[str, np.ndarray], features: list[str] | None = None, size: float = 0.1, use_features: bool = True, use_coords: bool = False, most: int | None = 10) -> DataFrame:
    """A trained sparse U-net's predictions: points with dx, dy, dz (offset) and l0, l1 (logits), each point those of its voxel.

    Levels are as many as there are weights for. A coarser level keeps every voxel, at the border of the grid too.
    """
    features = features or []
    x = cut(voxel_features(points, size, features, use_features, use_coords, most))
    rules = cut(rulebook(x))
    x = u_block(cut(sub_conv(x, rules, weights["input_conv.0.weight"])), weights, "unet")
    x = mapped(x, batch_norm(weights, "output_layer.0"), relu)
    offset, logits = head(weights, "offset_linear"), head(weights, "semantic_linear")

    def both(f: np.ndarray) -> np.ndarray:
        a = b = f
        for s in offset:
            a = s(a)
        for s in logits:
            b = s(b)
        return np.concatenate([a, b], axis=1)

    # codes are undone for voxels, which are fewer, not made anew for points
    cell = [v.alias(k) for k, v in zip(("vx", "vy", "vz"), morton_decode(F.col("code")))]
    y = cut(mapped(x, both).select("tree_id", *cell, *(F.col("feat")[i].alias(c) for i, c in enumerate(("dx", "dy", "dz", "l0", "l1")))))
    keyed = voxel_key(points.drop("dx", "dy", "dz", "l0", "l1"), size).withColumns({k: F.col(k).bitwiseAND(F.lit(2**DEPTH - 1).cast("long")) for k in ("vx", "vy", "vz")})
    return keyed.join(y, ["tree_id", "vx", "vy", "vz"]).drop("vx", "vy", "vz")
