"""Models as JSON files: metadata and data, checked for version and kind when read."""

from __future__ import annotations

import json
import math
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.errors import DeserializationError, IncompatibleFormatVersion, ModelTypeMismatch, SerializationError
from statloom.operators.linear import LinearFit, PolynomialFit
from statloom.operators.loess import LoessFit
from statloom.operators.penalized import PenalizedFit

FORMAT_VERSION = "1.0"
LIBRARY_VERSION = "0.1.0"
MODEL_TYPES = ("OLS", "Ridge", "Lasso", "ElasticNet", "WLS", "LOESS", "Polynomial")


def model_type(name: str) -> str:
    """The name in its usual case."""
    for t in MODEL_TYPES:
        if t.lower() == name.lower():
            return t
    raise DeserializationError(f"{name} is no model type")


def check_version(version: str) -> None:
    try:
        major = int(str(version).split(".")[0])
    except ValueError as e:
        raise IncompatibleFormatVersion(f"{version} is no version") from e
    if major != int(FORMAT_VERSION.split(".")[0]):
        raise IncompatibleFormatVersion(f"the file is of version {version}, not {FORMAT_VERSION}")


def _plain(v):
    return None if isinstance(v, float) and not math.isfinite(v) else v


def describe(fit) -> tuple[str, dict]:
    if isinstance(fit, LinearFit):
        return fit.kind, {"y": fit.y, "x": fit.x, "coefficients": [_plain(v) for v in fit.coefficients], "terms": [{k: _plain(v) for k, v in r.items()} for r in fit.inference()], "statistics": {k: _plain(v) for k, v in fit.statistics().items()}}
    if isinstance(fit, PenalizedFit):
        return fit.kind, {"y": fit.y, "x": fit.x, "lambda": fit.lam, "alpha": fit.alpha, "coefficients": [_plain(v) for v in fit.coefficients], "statistics": {k: _plain(float(v)) for k, v in fit.statistics().items()}, "iterations": fit.iterations, "converged": fit.converged}
    if isinstance(fit, PolynomialFit):
        _, data = describe(fit.fit)
        return "Polynomial", data | {"degree": fit.degree, "centre": fit.centre, "means": fit.means, "stds": fit.stds, "standardized": fit.standardized}
    if isinstance(fit, LoessFit):
        return "LOESS", {"span": fit.span, "degree": fit.degree, "robust_iterations": fit.robust_iterations, "surface": fit.surface, "train_x": fit.train_x.tolist(), "train_y": fit.train_y.tolist(), "fitted": fit.fitted.tolist()}
    raise SerializationError(f"{type(fit).__name__} is no model")


def serialize(fit, name: str | None = None) -> str:
    kind, data = describe(fit)
    meta = {"format_version": FORMAT_VERSION, "library_version": LIBRARY_VERSION, "model_type": kind, "created_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")} | ({"name": name} if name else {})
    return json.dumps({"metadata": meta, "data": data}, indent=2)


def deserialize(text: str, kind: str | None = None) -> dict:
    """{metadata, data}; the version is checked first, then the kind."""
    try:
        model = json.loads(text)
        meta = model["metadata"]
        version, found = meta["format_version"], meta["model_type"]
        model["data"]
    except (ValueError, KeyError, TypeError) as e:
        raise DeserializationError(f"this is no model: {e}") from e
    check_version(version)
    if kind is not None and model_type(kind) != model_type(found):
        raise ModelTypeMismatch(f"the file holds a model of type {found}, not {kind}")
    return model


def metadata(text: str) -> dict:
    return deserialize(text)["metadata"]


def save(spark: SparkSession, fit, path: str, name: str | None = None) -> None:
    """Write one JSON file into the folder ``path``, by Spark, so any store it reaches will do."""
    spark.createDataFrame([(serialize(fit, name),)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n\n")


def load(spark: SparkSession, path: str, kind: str | None = None) -> dict:
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as e:
        raise DeserializationError(f"{path} can't be read") from e
    if not rows:
        raise DeserializationError(f"{path} is empty")
    return deserialize(rows[0][0], kind)


def predict(model: dict, df: DataFrame) -> DataFrame:
    """The rows with yhat by a loaded linear, penalised or polynomial model."""
    data = model["data"]
    b = [0.0 if v is None else v for v in data["coefficients"]]
    if model_type(model["metadata"]["model_type"]) == "Polynomial":
        from statloom.operators.linear import features

        raise_to = features(F.col("x").cast("double"), data["degree"], data["centre"], list(zip(data["means"], data["stds"], strict=True)) if data["standardized"] else None)
    else:
        raise_to = [F.col(f"`{c}`").cast("double") for c in data["x"]]
    total = F.lit(b[0])
    for c, v in zip(raise_to, b[1:], strict=True):
        total = total + F.lit(v) * c
    return df.withColumn("yhat", total)
