"""Store a trained model and read it again.

A model is a folder: ``about`` holds one line of JSON with its kind and its numbers, and every
fitted MLlib part or member model has a folder of its own beside it.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import SparkSession

from contestry.operators.boosting import BoostedModel
from contestry.operators.models import (
    CalibratedModel,
    EnsembleModel,
    FittedModel,
    PriorModel,
    _Constant,
    _Isotonic,
    _Platt,
)


def _about(model) -> tuple[dict, dict]:
    """The numbers of a model, and its parts by folder name."""
    if isinstance(model, FittedModel):
        return {"kind": "fitted", "features": model.features, "seen": model.seen}, {"pipeline": model.pipeline}
    if isinstance(model, BoostedModel):
        return {"kind": "boosted"} | asdict(model), {}
    if isinstance(model, PriorModel):
        return {"kind": "prior", "parts": list(model.parts)}, {}
    if isinstance(model, EnsembleModel):
        parts = {f"member_{i}": part for i, part in enumerate(model.members)}
        return {"kind": "ensemble", "weights": model.weights, "members": len(parts)}, parts
    if isinstance(model, CalibratedModel):
        parts = {"base": model.base} | {f"map_{i}": part for i, part in enumerate(model.maps)}
        return {"kind": "calibrated", "maps": len(model.maps)}, parts
    if isinstance(model, _Constant):
        return {"kind": "constant", "value": model.value}, {}
    if isinstance(model, _Platt):
        return {"kind": "sigmoid", "slope": model.slope, "intercept": model.intercept}, {}
    if isinstance(model, _Isotonic):
        return {"kind": "isotonic"}, {"steps": model.model}
    raise TypeError(f"no way to store a {type(model).__name__}")


def write_model(model, path: str) -> str:
    """Any model of :mod:`contestry.operators.models`, over what is at ``path``."""
    told, parts = _about(model)
    line = SparkSession.active().createDataFrame([(json.dumps(told),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/about")
    for name, part in parts.items():
        if isinstance(part, (PipelineModel, IsotonicRegressionModel)):
            part.write().overwrite().save(f"{path}/{name}")
        else:
            write_model(part, f"{path}/{name}")
    return path


def read_model(spark: SparkSession, path: str):
    """The model that :func:`write_model` stored."""
    told = json.loads(spark.read.text(f"{path}/about").first().value)
    kind = told.pop("kind")
    inner = lambda name: read_model(spark, f"{path}/{name}")
    if kind == "fitted":
        return FittedModel(PipelineModel.load(f"{path}/pipeline"), told["features"], told["seen"])
    if kind == "boosted":
        return BoostedModel(**told)
    if kind == "prior":
        return PriorModel(tuple(told["parts"]))
    if kind == "ensemble":
        return EnsembleModel([inner(f"member_{i}") for i in range(told["members"])], told["weights"])
    if kind == "calibrated":
        return CalibratedModel(inner("base"), [inner(f"map_{i}") for i in range(told["maps"])])
    if kind == "constant":
        return _Constant(**told)
    if kind == "sigmoid":
        return _Platt(**told)
    return _Isotonic(IsotonicRegressionModel.load(f"{path}/steps"))
