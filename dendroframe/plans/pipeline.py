"""The staged pipeline: clouds -> prediction -> upsampling -> cylinder models -> corrected radii."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.hierarchy import children_of, correct_radii
from ..operators.points import height_filter
from ..operators.predict import predict
from ..operators.qsm import QsmParams, fit_qsm
from ..operators.sampling import rounds_closed_form, upsample


@dataclass(frozen=True)
class Stage1:
    predict_offset: bool = True
    denoise: bool = True
    model_type: str = "no_model"
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Stage2:
    upsampling: bool = True
    k_init: int = 10
    max_iterations: int = 10
    min_height: float = 0.0
    use_only_original_points: bool = True
    min_points: int = 1_000_000


@dataclass(frozen=True)
class Stage3:
    qsm_fitting: bool = True
    qsm_params: QsmParams = field(default_factory=QsmParams)


@dataclass(frozen=True)
class Config:
    stage1: Stage1 = field(default_factory=Stage1)
    stage2: Stage2 = field(default_factory=Stage2)
    stage3: Stage3 = field(default_factory=Stage3)

    @staticmethod
    def of(raw: dict) -> Config:
        """From a nested dictionary, as a configuration file gives it. Unknown keys are errors; 'general' is the caller's."""
        known = {k: v for k, v in raw.items() if k != "general"}
        q = dict(known.get("stage3") or {})
        names = QsmParams.__dataclass_fields__
        params = {k: v for k, v in (q.pop("qsm_params", None) or {}).items()}
        unknown = set(params) - set(names)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        q = {k: v for k, v in q.items() if k not in ("qsm_verbose", "qsm_debug")}
        return Config(Stage1(**(known.get("stage1") or {})), Stage2(**(known.get("stage2") or {})), Stage3(**q, qsm_params=QsmParams(**params)))


def run(points: DataFrame, config: Config | None = None, points_per_tree: int | None = None) -> dict[str, DataFrame]:
    """The DataFrames of each stage: predicted, dense, cylinders. Nothing runs before one is used.

    points_per_tree: the smallest tree's size, if known; without it rounds follow from a count of the smallest tree.
    """
    c = config or Config()
    out = {"predicted": predict(points, c.stage1.model_type, c.stage1.predict_offset, c.stage1.denoise, **c.stage1.options).select("tree_id", "point_id", "x", "y", "z")}
    dense = out["predicted"]
    if c.stage2.upsampling:
        high = height_filter(dense, c.stage2.min_height)
        n = points_per_tree
        if n is None:
            least = high.groupBy("tree_id").count().agg({"count": "min"}).first()[0]
            n = least or 0
        rounds = rounds_closed_form(n, c.stage2.min_points, c.stage2.max_iterations, c.stage2.use_only_original_points)
        grown = upsample(high, c.stage2.k_init, rounds, c.stage2.use_only_original_points).drop("born")
        dense = grown.unionByName(height_filter(dense, c.stage2.min_height, below=True)) if c.stage2.min_height > 0 else grown
    out["dense"] = dense
    if c.stage3.qsm_fitting:
        p = c.stage3.qsm_params
        raw = fit_qsm(dense, p)
        fixed = correct_radii(raw.filter("id is not null").drop("error"), p.min_spread_growth, p.max_spread_growth, "connection" if p.only_correct_connections else None)
        out["cylinders"] = children_of(fixed)
    return out
