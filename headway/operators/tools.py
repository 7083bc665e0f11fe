"""What can be said of a line at a moment, from what was known before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.operators.temporal import latest_by

LOOKBACK_S = 30 * 60
RUNNING_S = 10 * 60
STATIONS = 5
TRAINS = 8


def _recent(events: DataFrame, at: Column, seconds: int) -> DataFrame:
    """Events in [at - seconds, at)."""
    return events.filter((F.col("observed_at") >= at - F.expr(f"INTERVAL {seconds} SECONDS")) & (F.col("observed_at") < at))


def situation(events: DataFrame, at: Column, late_s: float, lookback_s: int = LOOKBACK_S) -> DataFrame:
    """Of each line: services seen lately, late ones, the largest delay, by each service's last event."""
    seen = _recent(events, at, lookback_s)
    last = latest_by(seen, ["line", "service_date", "trip_id"], ["observed_at", "event_id"] if "event_id" in events.columns else ["observed_at", "delay_s"])
    return last.groupBy("line").agg(F.count("*").alias("n_services"), F.count_if(F.col("delay_s") > late_s).alias("n_late"), F.max("delay_s").alias("max_delay_s"))


def delayed_stations(events: DataFrame, stations: DataFrame, at: Column, late_s: float, k: int = STATIONS, lookback_s: int = LOOKBACK_S) -> DataFrame:
    """The k stations with most services that were late there, by falling count and name."""
    late = _recent(events, at, lookback_s).filter(F.col("delay_s") > late_s).join(stations, "stop_id")
    each = late.select("station", "service_date", "trip_id").distinct().groupBy("station").agg(F.count("*").alias("n"))
    return each.orderBy(F.desc("n"), "station").limit(k)


def station_names(stops: DataFrame) -> DataFrame:
    """stop_id and the name of its parent station, without a trailing ' Station'."""
    own, parent = stops.alias("s"), stops.alias("p")
    name = F.coalesce("p.stop_name", "s.stop_name")
    return own.join(parent, F.col("s.parent_station") == F.col("p.stop_id"), "left").select(F.col("s.stop_id").alias("stop_id"), F.trim(F.regexp_replace(name, " Station$", "")).alias("station"))


def running(events: DataFrame, at: Column, within_s: int = RUNNING_S) -> DataFrame:
    """Each service's last event of the last minutes."""
    return latest_by(_recent(events, at, within_s), ["line", "service_date", "trip_id"], ["observed_at", "event_id"] if "event_id" in events.columns else ["observed_at", "delay_s"])


def next_calls(calls: DataFrame, trip: str = "trip_id", sequence: str = "stop_sequence") -> DataFrame:
    """Calls of a timetable with the one that follows: next_stop_id and next_scheduled_s."""
    w = Window.partitionBy(trip).orderBy(sequence)
    return calls.withColumns({"next_stop_id": F.lead("stop_id").over(w), "next_scheduled_s": F.lead("scheduled_arrival_s").over(w)})


def expected_delays(live: DataFrame, calls: DataFrame, predict: Callable[[DataFrame], DataFrame] | None = None, k: int = TRAINS) -> DataFrame:
    """Running services with their next call and the expected delay there; the k most delayed.

    Where a trip calls at its last stop twice, the call nearest to the estimated time counts.
    """
    joined = live.join(next_calls(calls), ["trip_id", "stop_id"]).filter("next_stop_id IS NOT NULL")
    near = F.struct(F.abs(F.col("scheduled_arrival_s") - F.col("estimate_s")).alias("d"), "stop_sequence") if "estimate_s" in live.columns else F.struct("stop_sequence")
    rest = [c for c in joined.columns if c not in ("service_date", "trip_id")]
    one = joined.groupBy("service_date", "trip_id").agg(F.min_by(F.struct(*rest), near).alias("_v")).select("service_date", "trip_id", *[F.col("_v")[c].alias(c) for c in rest])
    out = one.withColumn("expected_delay_s", F.col("delay_s").cast("double")) if predict is None else predict(one)
    return out.orderBy(F.desc("expected_delay_s"), "trip_id").limit(k)


def risk(table: DataFrame, line: str, at: Column, window_s: int, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The score of the line's last window that was over at the moment."""
    over = F.col("window_start") + F.expr(f"INTERVAL {window_s} SECONDS") <= at
    return score(table.filter((F.col("line") == line) & over).orderBy(F.desc("window_start")).limit(1))


def question_set(dates: DataFrame, lines: list[str], incidents: DataFrame | None = None, peaks: tuple[str, ...] = ("08:30:00", "17:30:00"), templates: int = 3, offset_s: int = 900) -> DataFrame:
    """(at, line, template, why): both peaks of each date for each line, and a while into each incident.

    Questions number a few a date, so one window over them is small.
    """
    each = dates.select("date", F.explode(F.array(*[F.lit(p) for p in peaks])).alias("clock")).select(F.to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), "clock")).alias("at"), F.explode(F.array(*[F.lit(x) for x in lines])).alias("line"), F.lit("peak").alias("why"))
    if incidents is not None:
        each = each.unionByName(incidents.select((F.col("first_seen").cast("timestamp") + F.expr(f"INTERVAL {offset_s} SECONDS")).alias("at"), F.explode("lines").alias("line"), F.lit("incident").alias("why")))
    return each.withColumn("template", (F.row_number().over(Window.orderBy("at", "line", "why")) - 1) % templates)
