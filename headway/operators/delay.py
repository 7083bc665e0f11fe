"""The delay model from training table to intervals: filters, split, fit, baseline, margins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.operators import evalstats, models, reconcile
from headway.schemas import DELAY_FEATURES, DELAY_FORBIDDEN, features

CATEGORIES = ("route_short_name", "stop_id")
NUMBERS = tuple(c for c in DELAY_FEATURES if c not in CATEGORIES)
RELIABLE_STOPS_AHEAD = 1
ALPHA = 0.1


def modelling_rows(table: DataFrame, dates: int | None = None) -> DataFrame:
    """Reliable, plausible rows of dates that the timetable covers; the first so many dates if asked."""
    rows = reconcile.schedule_covered(reconcile.plausible(table.filter(F.col("stops_ahead_final") <= RELIABLE_STOPS_AHEAD)))
    return rows if dates is None else reconcile.first_dates(rows, dates)


def bins(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bin", F.concat_ws("|", F.coalesce("route_short_name", F.lit("")), evalstats.lateness_band(F.col("prev_stop_delay_s"))))


@dataclass
class DelayModel:
    """A fitted model, the half-widths of its intervals and the dates that it learnt from."""

    model: PipelineModel
    widths: DataFrame
    training_dates: list[str]

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with prediction and half_width: the bin's, else that of all."""
        out = bins(self.model.transform(models.prepared(rows, NUMBERS))).select(*rows.columns, "prediction", "bin")
        own = self.widths.filter("NOT all").select("bin", F.col("width").alias("_own"))
        every = self.widths.filter("all").select(F.col("width").alias("_every"))
        return out.join(F.broadcast(own), "bin", "left").join(F.broadcast(every)).withColumn("half_width", F.coalesce("_own", "_every")).drop("_own", "_every")


def fit(table: DataFrame, grid: Sequence[dict] = models.DELAY_GRID, rounds: int = models.ROUNDS) -> tuple[DelayModel, DataFrame]:
    """The model, and the test rows with prediction, half_width and split.

    The margins come from the validation rows, which the model was only chosen by.
    """
    keep = ("service_date", "delay_s", "split")
    rows = features(reconcile.with_split(table), DELAY_FEATURES, DELAY_FORBIDDEN, keep)
    rows = rows.filter("delay_s IS NOT NULL").withColumns({c: F.coalesce(F.col(c), F.lit("<missing>")) for c in CATEGORIES})
    parts = {s: rows.filter(F.col("split") == s) for s in ("train", "validation", "test")}
    fitted = models.fit_delay(parts["train"], parts["validation"], NUMBERS, CATEGORIES, grid=grid, rounds=rounds)
    held = bins(fitted.transform(models.prepared(parts["validation"], NUMBERS))).withColumn("score", F.abs(F.col("prediction") - F.col("delay_s")))
    widths = evalstats.conformal_widths(held, "bin", "score", ALPHA)
    dates = [r[0] for r in parts["train"].select("service_date").distinct().orderBy("service_date").collect()]
    model = DelayModel(fitted, widths, dates)
    return model, model.predict(parts["test"])


def against_persistence(scored: DataFrame) -> DataFrame:
    """Both guesses on the rows where the stop before is known: a row each."""
    known = scored.filter("prev_stop_delay_s IS NOT NULL")
    one = evalstats.regression_scores(known, "delay_s", "prediction", "prev_stop_delay_s").withColumn("guess", F.lit("model"))
    two = evalstats.regression_scores(known, "delay_s", "prev_stop_delay_s", "prev_stop_delay_s").withColumn("guess", F.lit("persistence"))
    return one.unionByName(two)


def learning_curve(table: DataFrame, lengths: Sequence[int] = (7, 14, 21, 28, 35), **how) -> list[tuple[int, float | None]]:
    """Test errors of models of the first so many dates, as far as there are dates."""
    n = table.select("service_date").distinct().count()
    out = []
    for k in (x for x in lengths if x <= n):
        _, scored = fit(reconcile.first_dates(table, k), **how)
        out.append((k, scored.agg(F.avg(F.abs(F.col("prediction") - F.col("delay_s")))).first()[0]))
    return out
