"""Gap filling: nearest features of other logs, Spark ML regressors, blending."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, PolynomialExpansion, StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import asof_nearest, blend_gaps, mask_with_buffer, quantile_fence, resample_uniform, rescale_depth, threshold

METHODS = ("rf", "rftc", "xgb", "xgblgbm")
FENCE = {"rf": (0.025, 0.975), "rftc": (0.15, 0.85), "xgb": (0.025, 0.975), "xgblgbm": None}


def clean_log(raw: DataFrame, value: str, op: str, limit: float, buffer: int, core_length: float, step: float | None, core: str = "core_id", depth: str = "depth") -> DataFrame:
    """Threshold mask with buffer, depths stretched to the core's length, uniform resampling."""
    out = mask_with_buffer(raw, threshold(value, op, limit), [value], [core], depth, buffer)
    out = rescale_depth(out, depth, [core], F.lit(float(core_length)))
    return resample_uniform(out, [core], depth, value, step) if step else out


def features(target: DataFrame, others: Mapping[str, DataFrame], tolerance: float = 3.0, core: str = "core_id", depth: str = "depth", value: str = "v") -> DataFrame:
    """target with f_<name>: the nearest value of each other log within tolerance, else null."""
    out = target
    for name, other in others.items():
        out = asof_nearest(out, other.select(core, depth, F.col(value).alias(f"f_{name}")), [core], depth, f"f_{name}", tolerance)
    return out


def _learners(method: str, seed: int, trees: int, rounds: int) -> list:
    if method in ("rf", "rftc"):
        return [RandomForestRegressor(numTrees=trees, maxDepth=12, seed=seed), GBTRegressor(maxIter=rounds, maxDepth=5, stepSize=0.05, seed=seed)]
    if method == "xgb":
        return [GBTRegressor(maxIter=rounds, maxDepth=6, stepSize=0.1, seed=seed)]
    return [GBTRegressor(maxIter=rounds, maxDepth=6, stepSize=0.1, seed=seed), GBTRegressor(maxIter=rounds, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, seed=seed + 1)]


def fill_gaps(log: DataFrame, columns: Sequence[str], method: str = "xgblgbm", weights: Mapping[str, float] | None = None, seed: int = 0, trees: int = 100, rounds: int = 40, core: str = "core_id", depth: str = "depth", value: str = "v") -> DataFrame:
    """log with filled: value where it is known, else the mean prediction of the method's learners from depth and the feature columns.

    rf and rftc train within a quantile fence; rftc draws inner gaps' predictions to the line between their neighbours; xgb and xgblgbm also
    take the features' products, xgblgbm the best of all only. trees and rounds bound the work of the learners. Columns that are null throughout are left out; without known rows or without gaps the log passes as it is.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")

    counts = log.agg(F.count(value).alias("k"), F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns]).head()
    if not counts.k or counts.k == counts.n:
        return log.withColumn("filled", F.col(value))
    used = [depth, *[c for c in columns if counts[c]]]
    scaled = log.withColumns({f"__{c}": F.col(c).cast("double") * float((weights or {}).get(c, 1.0)) for c in used})
    names = [f"__{c}" for c in used]
    train = scaled.where(F.col(value).isNotNull()).withColumn("label", F.col(value).cast("double"))
    if FENCE[method]:
        train = quantile_fence(train, [core], "label", *FENCE[method])
    steps = [Imputer(strategy="median", inputCols=names, outputCols=names), VectorAssembler(inputCols=names, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True)]
    if method.startswith("xgb"):  # products of all features by twos
        steps.append(PolynomialExpansion(degree=2, inputCol="__scaled", outputCol="__all"))
        many = len(names) * (len(names) + 3) // 2
        top = many if method == "xgb" else max(1, min(50, counts.k // 10, many))
        best = UnivariateFeatureSelector(featuresCol="__all", outputCol="features", labelCol="label", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("continuous")
        steps.append(best.setSelectionThreshold(top))
    else:
        steps[-1].setOutputCol("features")
    prepared = Pipeline(stages=steps).fit(train)
    ready, asked = prepared.transform(train), prepared.transform(scaled.withColumn("label", F.lit(0.0)))
    models = [m.setPredictionCol(f"__p{k}").fit(ready) for k, m in enumerate(_learners(method, seed, trees, rounds))]
    for m in models:
        asked = m.transform(asked)
    mean = sum((F.col(f"__p{k}") for k in range(len(models))), F.lit(0.0)) / len(models)
    out = asked.select(*log.columns, mean.alias("__predicted"))
    if method == "rftc":
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy(core).orderBy(depth)))
        out = blend_gaps(out, [core], "__n", value, "__predicted").drop("__n")
    else:
        out = out.withColumn("filled", F.coalesce(F.col(value), F.col("__predicted")))
    return out.drop("__predicted")


def weights_for(columns: Sequence[str], weights: Mapping[str, float], legacy_substring: bool = False) -> dict[str, float]:
    """The weight of each feature column: of the log it is named for, or, with legacy_substring, the product over all logs in its name."""
    out = {}
    for c in columns:
        name = c.removeprefix("f_")
        hit = [w for k, w in weights.items() if (k in name if legacy_substring else k == name)]
        if hit:
            out[c] = math.prod(hit)
    return out


@dataclass(frozen=True)
class LogKind:
    """A kind of log: its data columns, the depth columns that its tables may have (the first that is there is used), how it is cleaned,
    its weight as a feature, and kinds that it doesn't learn from besides its own other columns."""

    columns: tuple[str, ...]
    depth_columns: tuple[str, ...] = ("depth",)
    mask: tuple[str, float] | None = None
    buffer: int = 0
    weight: float = 1.0
    without: tuple[str, ...] = ()

    def depth(self, log: DataFrame) -> str:
        return next(c for c in self.depth_columns if c in log.columns)


def fill_logs(logs: Mapping[str, DataFrame], kinds: Mapping[str, LogKind], method: str = "xgblgbm", tolerance: float = 3.0, core: str = "core_id", more: Mapping[str, DataFrame] | None = None, **how) -> dict[str, DataFrame]:
    """Each log (core, depth, columns) with the gaps of all its columns filled from depth and the other kinds' columns.

    Each column is a target of its own; the columns beside it in its own log are no features of it. more: further logs (core, depth, v) to
    learn from, of any name. Logs are cleaned by their kinds' masks first. The result has (core, depth, columns), by name.
    """
    clean = {}
    for name, log in logs.items():
        k = kinds[name]
        out = log.select(core, F.col(k.depth(log)).cast("double").alias("depth"), *k.columns)
        for c in k.columns if k.mask else ():
            out = mask_with_buffer(out, threshold(c, *k.mask), [c], [core], "depth", k.buffer)
        clean[name] = out
    done = {}
    for name, log in clean.items():
        others = {f"{n}_{c}": o.select(core, "depth", F.col(c).alias("v")).where("v is not null") for n, o in clean.items() if n != name and n not in kinds[name].without for c in kinds[n].columns}
        others |= more or {}
        weights = {f"f_{n}_{c}": kinds[n].weight for n in clean for c in kinds[n].columns}
        result = log.select(core, "depth")
        for c in kinds[name].columns:
            target = features(log.select(core, "depth", F.col(c).alias("v")), others, tolerance, core)
            filled = fill_gaps(target, [f"f_{o}" for o in others], method, weights, core=core, **how)
            result = result.join(filled.select(core, "depth", F.col("filled").alias(c)), [core, "depth"])
        done[name] = result
    return done
