"""Attention within patches of a space-filling order, and the transformer block around it.

A patch is `size` consecutive points of a tree's order (grid.patches); a task holds one patch at a time, so memory grows with
size * size * heads and never with the tree. Points lent to a tree's last patch are looked at there and answered only in
their own patch. Weights are arrays by name, as load_weights reads them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .grid import ORDERS, patches
from .layers import gelu, layer_norm, linear, mapped, matrix, rows_of, sub_conv


def position_bound(size: int) -> int:
    """The cell difference up to which relative positions have weights of their own, for patches of this size (a fixed rule of the trained tables)."""
    return int((4 * size) ** (1 / 3) * 2)


def relative_bias(cells: np.ndarray, table: np.ndarray, bound: int) -> np.ndarray:
    """heads x n x n: for each pair of points the sum of the table's rows for its cell differences along x, y, z, held within the bound."""
    places = np.clip(cells[:, None] - cells[None], -bound, bound) + bound + np.arange(3) * (2 * bound + 1)
    return table[places].sum(axis=2).transpose(2, 0, 1)


def patch_attention(coded: DataFrame, w: dict[str, np.ndarray], name: str, heads: int, size: int, rank: str = "rank") -> DataFrame:
    """coded (tree_id, point_id, vx, vy, vz, rank, feat) with new features: multi-head attention within patches along `rank`, with a relative-position bias if the weights have a table for it."""
    width = len(w[f"{name}.proj.weight"])
    table, bound, scale = w.get(f"{name}.rpe.rpe_table"), position_bound(size), (width // heads) ** -0.5
    keys = coded.select("tree_id", "point_id", "vx", "vy", "vz", F.col(rank).alias("rank"), "feat")
    x = patches(mapped(keys, linear(w[f"{name}.qkv.weight"], w.get(f"{name}.qkv.bias"))), size).select("tree_id", "patch", "point_id", "vx", "vy", "vz", "borrowed", "feat")
    out = coded.select("tree_id", "point_id", F.col("feat").cast("array<double>").alias("feat")).schema

    def run(patch: pa.Table) -> pa.Table:
        patch = patch.combine_chunks()
        n = patch.num_rows
        queries, keys_, values = matrix(patch["feat"].chunk(0)).reshape(n, 3, heads, width // heads).transpose(1, 2, 0, 3)
        own = ~patch["borrowed"].to_numpy()
        score = (queries[:, own] * scale) @ keys_.transpose(0, 2, 1)
        if table is not None:
            score = score + relative_bias(np.stack([patch[c].to_numpy() for c in ("vx", "vy", "vz")], axis=1), table, bound)[:, own]
        score = np.exp(score - score.max(axis=2, keepdims=True))
        mixed = (score / score.sum(axis=2, keepdims=True)) @ values
        kept = patch.filter(pa.array(own))
        return pa.table({"tree_id": kept["tree_id"], "point_id": kept["point_id"], "feat": rows_of(mixed.transpose(1, 0, 2).reshape(-1, width))})

    return mapped(x.groupBy("tree_id", "patch").applyInArrow(run, out), linear(w[f"{name}.proj.weight"], w.get(f"{name}.proj.bias")))


def _plus(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """a with b's features added to its own."""
    return a.join(b.select(*keys, F.col("feat").alias("_b")), list(keys)).withColumn("feat", F.zip_with("feat", "_b", lambda x, y: x + y)).drop("_b")


def transformer_block(voxels: DataFrame, rules: DataFrame, w: dict[str, np.ndarray], name: str, heads: int, size: int, rank: str = "rank") -> DataFrame:
    """A block of a serialised transformer over voxels (tree_id, point_id, code, vx, vy, vz, ranks, feat; one point a voxel): a convolution that tells positions, attention along `rank`, and two dense layers, each added to what came in. Norms come first."""
    keys = ("tree_id", "point_id")
    place = sub_conv(voxels.select("tree_id", "code", "feat"), rules, w[f"{name}.cpe.0.weight"], w[f"{name}.cpe.0.bias"])
    place = mapped(place, linear(w[f"{name}.cpe.1.weight"], w[f"{name}.cpe.1.bias"]), layer_norm(w, f"{name}.cpe.2"))
    x = cut(_plus(voxels, place, ("tree_id", "code")))
    x = cut(_plus(x, patch_attention(mapped(x, layer_norm(w, f"{name}.norm1.0")), w, f"{name}.attn", heads, size, rank), keys))
    dense = (layer_norm(w, f"{name}.norm2.0"), linear(w[f"{name}.mlp.0.fc1.weight"], w[f"{name}.mlp.0.fc1.bias"]), gelu, linear(w[f"{name}.mlp.0.fc2.weight"], w[f"{name}.mlp.0.fc2.bias"]))

    def step(f: np.ndarray) -> np.ndarray:
        y = f
        for s in dense:
            y = s(y)
        return f + y

    return mapped(x, step)


def transformer_stage(voxels: DataFrame, rules: DataFrame, w: dict[str, np.ndarray], name: str, blocks: int, heads: int, size: int, orders: tuple[int, ...] = tuple(range(len(ORDERS)))) -> DataFrame:
    """Blocks one after the other (block0, block1, ...), each along the next of the orders: rank_<order>, as grid.serialise_all gives them. Give the orders shuffled to mix them as training did."""
    for i in range(blocks):
        voxels = cut(transformer_block(voxels, rules, w, f"{name}.block{i}", heads, size, f"rank_{orders[i % len(orders)]}"))
    return voxels
