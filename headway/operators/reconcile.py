"""Observations to training rows: one event a stop, the timetable attached, lags, calendar, split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.time import calendar, gtfs_seconds
from headway.operators.evalstats import percentiles
from headway.operators.temporal import latest_by
from headway.schemas import TRAINING_COLUMNS


def collapse(observations: DataFrame, keys: Sequence[str] = ("service_date", "trip_id", "stop_id"), ts: str = "observed_at_utc", tie: Sequence[str] = (), count: str | None = "observation_count") -> DataFrame:
    """The latest observation of each key and the sum of their counts (a missing count is 1)."""
    rest = [c for c in observations.columns if c not in (*keys, count)]
    n = F.coalesce(F.col(count), F.lit(1)) if count in observations.columns else F.lit(1)
    best = observations.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, *tie)).alias("_v"), F.sum(n).alias(count or "observation_count"))
    return best.select(*keys, *[F.col("_v")[c].alias(c) for c in rest], F.col(count or "observation_count").cast("long"))


def with_target(observations: DataFrame) -> DataFrame:
    """delay_s: the arrival delay, else the departure delay; rows with neither go."""
    return observations.withColumn("delay_s", F.coalesce("arrival_delay_s", "departure_delay_s")).filter("delay_s IS NOT NULL")


def merged_timetable(stop_times: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Timetable calls of several eras (bundle, with bundle_rank from the newest): within one the last row of
    a (trip, stop) wins, across eras the first."""
    rows = stop_times if wanted is None else stop_times.join(wanted.select("trip_id").distinct(), "trip_id", "left_semi")
    rows = rows.withColumn("stop_sequence", F.expr("try_cast(stop_sequence AS INT)")).filter("stop_sequence IS NOT NULL")
    rows = rows.withColumns({"scheduled_arrival_s": gtfs_seconds(F.col("arrival_time")), "scheduled_departure_s": gtfs_seconds(F.col("departure_time"))})
    return latest_by(rows, ["trip_id", "stop_id"], [(-F.col("bundle_rank")).alias("newest"), "file_row"])


def calls(stop_times: DataFrame) -> DataFrame:
    """Whole call lists, each trip's from the newest era that has it."""
    newest = stop_times.groupBy("trip_id").agg(F.min("bundle_rank").alias("bundle_rank"))
    return stop_times.join(newest, ["trip_id", "bundle_rank"])


def attach_schedule(events: DataFrame, schedule: DataFrame) -> DataFrame:
    """Events with their scheduled arrival and sequence, where the timetable has the call."""
    own = schedule.select("trip_id", "stop_id", "scheduled_arrival_s", F.col("stop_sequence").alias("_sequence"), F.lit(True).alias("_found"))
    out = events.join(own, ["trip_id", "stop_id"], "left")
    fed = F.col("stop_sequence") if "stop_sequence" in events.columns else F.lit(None).cast("int")
    return out.withColumns({"schedule_matched": F.coalesce("_found", F.lit(False)), "stop_sequence": F.coalesce("_sequence", fed)}).drop("_found", "_sequence")


def previous_delay(events: DataFrame, by: Sequence[str] = ("service_date", "trip_id"), order: Sequence = (), out: str = "prev_stop_delay_s", value: str = "delay_s") -> DataFrame:
    """The delay at the trip's stop before."""
    order = order or [F.coalesce(F.col("stop_sequence"), F.lit(1_000_000_000)), "observed_at_utc", "stop_id"]
    return events.withColumn(out, F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def reconcile(observations: DataFrame, schedule: DataFrame) -> DataFrame:
    """The training table."""
    rows = attach_schedule(with_target(collapse(observations, tie=("stops_ahead",))), schedule)
    rows = previous_delay(rows).withColumns(calendar(F.col("observed_at_utc"))).withColumnRenamed("stops_ahead", "stops_ahead_final")
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in TRAINING_COLUMNS])


def schedule_covered(table: DataFrame, date: str = "service_date", value: str = "scheduled_arrival_s", least: float = 0.5) -> DataFrame:
    """Rows of the dates at least half of whose rows have a schedule: whole dates stay or go."""
    good = table.groupBy(date).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("_share")).filter(F.col("_share") >= least)
    return table.join(good.select(date), date, "left_semi")


def plausible(table: DataFrame, most_s: float = 7200, delay: str = "delay_s", prev: str = "prev_stop_delay_s") -> DataFrame:
    return table.filter((F.abs(delay) <= most_s) & (F.col(prev).isNull() | (F.abs(prev) <= most_s)))


def cut_points(n: int, shares: Sequence[float] = (0.70, 0.15, 0.15)) -> tuple[int, int]:
    """Numbers of dates before validation and before test; halves round to even, at least one date trains."""
    train = max(1, round(n * shares[0]))
    return train, max(train, round(n * (shares[0] + shares[1])))


def with_split(table: DataFrame, date: str = "service_date", shares: Sequence[float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """``split`` by whole dates in order.  Dates, which are days, are ranked in a table of their own."""
    dates = table.select(date).distinct()
    train, validation = cut_points(dates.count(), shares)
    ranked = dates.withColumn("_n", F.row_number().over(Window.orderBy(date)))
    split = F.when(F.col("_n") <= train, "train").when(F.col("_n") <= validation, "validation").otherwise("test")
    return table.join(ranked.select(date, split.alias("split")), date)


def first_dates(table: DataFrame, n: int, date: str = "service_date") -> DataFrame:
    return table.join(table.select(date).distinct().orderBy(date).limit(n), date, "left_semi")


def quality_report(table: DataFrame, date: str, value: str, entity: str, thin: float = 0.25) -> DataFrame:
    """One row: counts, distinct entities, median and 90th percentile, rows of a day, thin days."""
    days = table.groupBy(date).agg(F.count("*").alias("n"))
    by_day = days.agg(F.count("*").alias("days"), F.min("n").alias("least_a_day"), F.median("n").alias("median_a_day"), F.max("n").alias("most_a_day"))  # of a row a day
    thin_days = days.join(F.broadcast(by_day.select("median_a_day"))).agg(F.count_if(F.col("n") < F.col("median_a_day") * thin).alias("thin_days"))
    whole = table.agg(F.count("*").alias("n"), F.count_distinct(entity).alias("entities"), F.count_if(F.col(value).isNull()).alias("missing"))
    spread = percentiles(table, value, (0.5, 0.9)).agg(*[F.max(F.when(F.col("share") == q, F.col("value"))).alias(c) for q, c in ((0.5, "median_value"), (0.9, "p90_value"))])
    return whole.join(F.broadcast(spread)).join(F.broadcast(by_day)).join(F.broadcast(thin_days))  # a row each
