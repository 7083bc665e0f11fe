"""Delay regressors and disruption detectors on Spark ML, chosen on validation rows only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.operators.evalstats import average_precision, best_threshold, score_curve


def prepared(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """``df`` with numbers as doubles and a flag for each that is missing."""
    return df.withColumns({**{c: F.col(c).cast("double") for c in numbers}, **{f"{c}_missing": F.col(c).isNull().cast("double") for c in numbers}})


def feature_stages(numbers: Sequence[str], categories: Sequence[str] = (), scale: bool = False) -> list:
    """Median imputation beside missing flags; categories in alphabetical order, unseen ones kept apart."""
    filled = [f"{c}_filled" for c in numbers]
    stages: list = [Imputer(strategy="median", inputCols=list(numbers), outputCols=filled)]
    for c in categories:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_level", stringOrderType="alphabetAsc", handleInvalid="keep"))
    inputs = [*filled, *(f"{c}_missing" for c in numbers), *(f"{c}_level" for c in categories)]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw" if scale else "features", handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features"))
    return stages


#: Rounds of boosting at most; they end when the validation rows gain no more.  Trees of a forest.
ROUNDS = 1000
TREES = 500
#: Candidates of each kind of model; the first of equally good ones is taken.
DELAY_GRID = ({"maxDepth": 3, "stepSize": 0.1}, {"maxDepth": 5, "stepSize": 0.1}, {"maxDepth": 3, "stepSize": 0.05}, {"maxDepth": 5, "stepSize": 0.05})
DETECTORS: dict[str, tuple[Callable, tuple[dict, ...]]] = {
    "boosted": (lambda **k: GBTClassifier(labelCol="label", seed=0, maxIter=ROUNDS, validationIndicatorCol="_validation", **k), ({"maxDepth": 2}, {"maxDepth": 3}, {"maxDepth": 4})),
    "forest": (lambda **k: RandomForestClassifier(labelCol="label", seed=0, numTrees=TREES, **k), ({"maxDepth": 4}, {"maxDepth": 6}, {"maxDepth": 8})),
    "logistic": (lambda **k: LogisticRegression(labelCol="label", maxIter=50, **k), ({"regParam": 0.001}, {"regParam": 0.01}, {"regParam": 0.1})),
}


def fit_delay(train: DataFrame, validation: DataFrame, numbers: Sequence[str], categories: Sequence[str], label: str = "delay_s", grid: Sequence[dict] = DELAY_GRID, rounds: int = ROUNDS) -> PipelineModel:
    """The candidate of the least mean absolute error on the validation rows."""
    both = prepared(train, numbers).withColumn("_validation", F.lit(False)).unionByName(prepared(validation, numbers).withColumn("_validation", F.lit(True)))
    both = both.withColumn(label, F.col(label).cast("double")).cache()
    best = None
    try:
        for candidate in grid:
            learner = GBTRegressor(labelCol=label, lossType="absolute", maxIter=rounds, seed=0, validationIndicatorCol="_validation", maxBins=64, **candidate)
            model = Pipeline(stages=[*feature_stages(numbers, categories), learner]).fit(both)
            mae = model.transform(both.filter("_validation")).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0]
            if mae is not None and (best is None or mae < best[0]):
                best = (mae, model)
    finally:
        both.unpersist()
    if best is None:
        raise ValueError("no validation rows to choose a model by")
    return best[1]


@dataclass
class Detector:
    name: str
    model: PipelineModel
    threshold: float
    validation_ap: float | None
    numbers: Sequence[str]
    categories: Sequence[str]

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with score, the probability of disruption, and flag."""
        out = self.model.transform(prepared(rows, self.numbers))
        out = out.withColumn("score", vector_to_array("probability")[1])
        return out.select(*rows.columns, "score", (F.col("score") >= self.threshold).alias("flag"))


def _constant(share: float) -> PipelineModel:
    """A model that gives every row the probability ``share``."""
    sql = SQLTransformer(statement=f"SELECT *, {1 - share!r}D AS _no, {share!r}D AS _yes FROM __THIS__")
    return PipelineModel([sql, VectorAssembler(inputCols=["_no", "_yes"], outputCol="probability")])


def fit_detector(
    kind: str, train: DataFrame, validation: DataFrame, numbers: Sequence[str], categories: Sequence[str] = ("line",), target: str = "target", lone: bool = False
) -> Detector:
    """The candidate of the best average precision on the validation rows, with the threshold of its best F1.

    Training rows of one class, and validation rows without a positive one, are refused unless ``lone``.  Then
    training rows of one class (or none) give a detector whose every score is their share of positives, 0 or 1.
    Without a positive validation row all candidates are equally good, so the first is taken.  In both cases the
    threshold is 0.5; the precision is undefined without positives.
    """
    label = lambda df: df.filter(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double"))
    rows, held = label(train), label(validation)
    classes = [r[0] for r in rows.select("label").distinct().collect()]  # two at most
    choice = not held.filter("label = 1").isEmpty()
    if len(classes) < 2 and not lone:
        raise ValueError("the training rows have one class only")
    if not choice and not lone:
        raise ValueError("the validation rows have no positive one")
    make, grid = DETECTORS[kind]
    best = None
    used = prepared(rows, numbers)
    if kind == "boosted":  # which looks at the validation rows to know when to end, and learns from the others
        used = used.withColumn("_validation", F.lit(False)).unionByName(prepared(held, numbers).withColumn("_validation", F.lit(True)))
    for candidate in grid if len(classes) == 2 else (None,):
        if candidate is None:
            model = _constant(float(sum(classes)))
        else:
            stages = feature_stages(numbers, categories, scale=kind == "logistic")
            model = Pipeline(stages=[*stages, make(**candidate)]).fit(used)
        if not choice:
            return Detector(kind, model, 0.5, None, numbers, categories)
        scored = model.transform(prepared(held, numbers)).select(vector_to_array("probability")[1].alias("score"), F.col(target).alias("target"))
        curve = score_curve(scored, "score", "target")
        ap = average_precision(curve).first()[0]
        if best is None or ap > best[0]:
            best = (ap, model, best_threshold(curve).first()["threshold"] if candidate is not None else 0.5)
    return Detector(kind, best[1], best[2], best[0], numbers, categories)
