"""Models kept with what they need: threshold, widths, features, dates."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from headway.operators.delay import DelayModel
from headway.operators.models import Detector


def _write(spark: SparkSession, path: str, facts: dict) -> None:
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def _read(spark: SparkSession, path: str, kind: str) -> dict:
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    if facts.get("kind") != kind:
        raise ValueError(f"{path} holds a {facts.get('kind')}, not a {kind}")
    return facts


def save_detector(detector: Detector, path: str, spark: SparkSession, training_dates: list[str]) -> None:
    detector.model.write().overwrite().save(f"{path}/model")
    _write(spark, path, {"kind": "detector", "name": detector.name, "threshold": detector.threshold, "validation_ap": detector.validation_ap, "numbers": list(detector.numbers), "categories": list(detector.categories), "training_dates": training_dates})


def load_detector(path: str, spark: SparkSession) -> tuple[Detector, list[str]]:
    """The detector and the dates that it learnt from: a moment of those is no test of it."""
    f = _read(spark, path, "detector")
    return Detector(f["name"], PipelineModel.load(f"{path}/model"), f["threshold"], f["validation_ap"], f["numbers"], f["categories"]), f["training_dates"]


def save_delay(model: DelayModel, path: str, spark: SparkSession) -> None:
    model.model.write().overwrite().save(f"{path}/model")
    model.widths.write.mode("overwrite").parquet(f"{path}/widths")
    _write(spark, path, {"kind": "delay", "training_dates": model.training_dates})


def load_delay(path: str, spark: SparkSession) -> DelayModel:
    """Refuses a model without the widths of its intervals."""
    f = _read(spark, path, "delay")
    widths = spark.read.parquet(f"{path}/widths")
    if widths.filter("all").isEmpty():
        raise ValueError(f"{path} has no interval widths: fit it again")
    return DelayModel(PipelineModel.load(f"{path}/model"), widths, f["training_dates"])
