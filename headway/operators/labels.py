"""Disruption labels on a dense grid of lines and windows, and what a detector sees of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.time import ZONE, calendar, floor_to, local, service_day
from headway.operators.temporal import asof_last, coverage, dense_grid, explode_windows, latest_by, with_lags

RELIABLE_STOPS_AHEAD = 1
PLAUSIBLE_S = 7200


@dataclass(frozen=True)
class LabelRule:
    """Thresholds of the delay rule; every one can be set."""

    late_s: float = 300
    share: float = 0.25
    min_services: int = 5
    window_s: int = 900

    def __post_init__(self):
        if not 0 < self.share <= 1:
            raise ValueError("share must lie in (0, 1]")
        if self.min_services < 1:
            raise ValueError("min_services must be at least 1")
        if self.late_s < 0:
            raise ValueError("late_s must not be negative")


def late_needed(n: Column, share: float) -> Column:
    """How many of n services must be late, against the drift of a double product."""
    return F.ceil(F.lit(float(share)) * n - F.lit(1e-9)).cast("long")


def reliable(events: DataFrame) -> DataFrame:
    """Events that labels are made of: near, plausible, with a delay."""
    return events.filter(F.col("delay_s").isNotNull() & (F.col("stops_ahead") <= RELIABLE_STOPS_AHEAD) & (F.abs("delay_s") <= PLAUSIBLE_S))


def latest_by_service(events: DataFrame, window_s: int, tie: Sequence[str] = ()) -> DataFrame:
    """The last event of each service in each window of its line."""
    at = events.withColumn("window_start", floor_to(F.col("observed_at"), window_s))
    return latest_by(at, ["line", "window_start", "service_date", "trip_id"], ["observed_at", *tie])


def services_by_window(latest: DataFrame, late_s: float, failed: DataFrame | None = None) -> DataFrame:
    """n_services, n_late and mean and max delay of each line and window.

    ``failed`` (line, window_start, service_date, trip_id): services that count as late, seen or not.
    """
    key = ["line", "window_start", "service_date", "trip_id"]
    rows = latest.select(*key, "delay_s", (F.col("delay_s") > late_s).alias("late"))
    if failed is not None:
        marked = failed.select(*key).distinct().withColumn("failed", F.lit(True))
        rows = rows.join(marked, key, "full").withColumn("late", F.coalesce("late", F.lit(False)) | F.coalesce("failed", F.lit(False)))
    return rows.groupBy("line", "window_start").agg(
        F.count("*").alias("n_services"), F.count_if("late").alias("n_late"), F.avg("delay_s").alias("mean_delay_s"), F.max("delay_s").alias("max_delay_s")
    )


def label_grid(grid: DataFrame, counts: DataFrame, rule: LabelRule, spans: DataFrame | None = None) -> DataFrame:
    """The grid with counts (0 where nothing was seen), the rules and the three-valued ``disrupted``.

    ``spans`` (incident_id, line, start, end) makes rule a true in every window that it touches; a
    window without rule a and with too few services is unknown.
    """
    out = grid.join(counts, ["line", "window_start"], "left").fillna(0, ["n_services", "n_late"])
    if spans is None:
        out = out.withColumns({"incident_ids": F.array().cast("array<string>"), "rule_a": F.lit(False)})
    else:
        each = explode_windows(spans, "start", "end", rule.window_s).groupBy("line", "window_start").agg(F.array_sort(F.collect_set("incident_id")).alias("incident_ids"))
        out = out.join(each, ["line", "window_start"], "left").withColumn("incident_ids", F.coalesce("incident_ids", F.array().cast("array<string>"))).withColumn("rule_a", F.size("incident_ids") > 0)
    enough = F.col("n_services") >= rule.min_services
    out = out.withColumn("share_late", F.when(F.col("n_services") > 0, F.col("n_late") / F.col("n_services")))
    out = out.withColumn("rule_b", enough & (F.col("n_late") >= late_needed(F.col("n_services"), rule.share)))
    return out.withColumn("disrupted", F.when(F.col("rule_a") | F.col("rule_b"), True).when(enough, False))


def with_targets(labels: DataFrame, horizon: int = 2, service_date: str | None = None) -> DataFrame:
    """``labels`` with target: whether one of the next windows is disrupted, by Kleene logic.

    With a ``service_date`` column, a target that looks at a window of another date is unknown.
    """
    w = Window.partitionBy("line").orderBy("window_start")
    later = [F.lead("disrupted", k).over(w) for k in range(1, horizon + 1)]
    target = later[0]
    for x in later[1:]:
        target = target | x
    if service_date:
        other = F.lit(False)
        for k in range(1, horizon + 1):
            date = F.lead(service_date, k).over(w)
            other = other | (date.isNotNull() & (date != F.col(service_date)))
        target = F.when(~other, target)
    return labels.withColumn("target", target)


def alert_in_feed(windows: DataFrame, polls: DataFrame, alerts: DataFrame, window_s: int, max_presence_s: int = 24 * 3600) -> DataFrame:
    """``windows`` with alert_in_feed: whether the last alert poll by the window's end held an alert of the line.

    ``alerts``: line, first_seen, last_seen.  Unknown (NULL) before the first poll.
    """
    ends = windows.withColumn("_end", F.col("window_start") + F.expr(f"INTERVAL {window_s} SECONDS"))
    at = asof_last(ends, polls.select(F.col("poll_time").alias("poll_time")), "_end", "poll_time", take=["poll_time"])
    # Alerts are few and short: as the polls that each was seen at, they meet windows by equality.
    spans = alerts.select("line", "first_seen", F.least("last_seen", F.col("first_seen") + F.expr(f"INTERVAL {max_presence_s} SECONDS")).alias("_to"))
    days = spans.withColumn("_day", F.explode(F.sequence(F.to_date("first_seen"), F.to_date("_to"))))
    keyed = at.withColumn("_day", F.to_date("poll_time"))
    hit = keyed.join(days, ["line", "_day"]).filter((F.col("first_seen") <= F.col("poll_time")) & (F.col("poll_time") <= F.col("_to"))).select("line", "window_start").distinct().withColumn("_hit", F.lit(True))
    out = at.join(hit, ["line", "window_start"], "left")
    return out.withColumn("alert_in_feed", F.when(F.col("poll_time").isNotNull(), F.coalesce("_hit", F.lit(False)))).drop("_end", "_hit", "poll_time")


def detection_table(labels: DataFrame, zone: str = ZONE, history: int = 3, horizon: int = 2) -> DataFrame:
    """Features that look back (lags, calendar) and targets that look forward."""
    out = labels.withColumns({"service_date": service_day(F.col("window_start"), zone), "window_start_local": local(F.col("window_start"), zone), **calendar(F.col("window_start"), zone)})
    out = with_lags(out, ["line"], ["window_start"], ["share_late", "n_services", "max_delay_s"], range(1, history + 1))
    return with_targets(out.withColumn("disrupted_now", F.col("disrupted")), horizon, "service_date")


def unserved_calls(statuses: DataFrame, calls: DataFrame, hold_s: int = 120) -> tuple[DataFrame, DataFrame]:
    """Calls that a cancelled or skipping trip failed to make while the status held, and the statuses
    whose trip has no timetable.

    ``statuses``: trip_id, service_date, line, trip_relationship, skipped_stop_ids, first_seen, last_seen;
    ``calls``: trip_id, service_date, stop_id, due (an instant).
    """
    held = F.col("due").between(F.col("first_seen"), F.col("last_seen") + F.expr(f"INTERVAL {hold_s} SECONDS"))
    which = (F.col("trip_relationship") == "CANCELED") | F.array_contains("skipped_stop_ids", F.col("stop_id"))
    joined = statuses.join(calls, ["trip_id", "service_date"])
    why = F.when(F.col("trip_relationship") == "CANCELED", "cancelled").otherwise("skipped")
    placed = joined.filter(held & F.coalesce(which, F.lit(False))).withColumn("why", why)
    return placed, statuses.join(calls.select("trip_id", "service_date").distinct(), ["trip_id", "service_date"], "left_anti")


def not_seen(placed: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``placed`` without cancelled services that were seen after all; skipped ones stay."""
    gone = placed.filter("why = 'cancelled'").join(seen.select(*keys).distinct(), list(keys), "left_anti")
    return gone.unionByName(placed.filter("why <> 'cancelled'"))


def compare_labels(labels: DataFrame, check: DataFrame, since: str, keys: Sequence[str] = ("line", "window_start")) -> DataFrame:
    """Windows from a date on, both labels side by side; keys must not repeat."""
    for df, name in ((labels, "labels"), (check, "check")):
        if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"{name} repeats a key of {', '.join(keys)}")
    other = check.select(*keys, *[F.col(c).alias(f"{c}_check") for c in check.columns if c not in keys])
    return labels.filter(F.col("service_date") >= since).join(other, list(keys))


def label_snapshot(events: DataFrame, polls: DataFrame, rule: LabelRule, lines: Sequence[str], spans: DataFrame | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Labels of every window that the polls (poll_time) cover, for each line: coverage, events and rules in one call."""
    bounds = coverage(polls, polls, "poll_time", rule.window_s)
    grid = dense_grid(bounds, "start", "end", rule.window_s, "line", list(lines))
    own = events.filter(F.col("line").isin(list(lines)))
    return label_grid(grid, services_by_window(latest_by_service(reliable(own), rule.window_s, tie), rule.late_s), rule, spans)


def window_delays(labels: DataFrame) -> DataFrame:
    """Of each verdict (unknown ones too): windows, services, mean of the windows' mean delays, and the largest delay."""
    return labels.groupBy("disrupted").agg(F.count("*").alias("windows"), F.sum("n_services").alias("services"), F.avg("mean_delay_s").alias("mean_delay_s"), F.max("max_delay_s").alias("max_delay_s"))
