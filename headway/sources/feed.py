"""Nested realtime feed messages flattened to rows; absent values stay NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.text import enum_name, translation
from headway.functions.time import service_date_or

#: Codes of the public GTFS-realtime schema.
STOP_RELATIONSHIPS = {0: "SCHEDULED", 1: "SKIPPED", 2: "NO_DATA", 3: "UNSCHEDULED"}
TRIP_RELATIONSHIPS = {0: "SCHEDULED", 1: "ADDED", 2: "UNSCHEDULED", 3: "CANCELED", 5: "REPLACEMENT", 6: "DUPLICATED", 7: "DELETED"}
CAUSES = {
    1: "UNKNOWN_CAUSE", 2: "OTHER_CAUSE", 3: "TECHNICAL_PROBLEM", 4: "STRIKE", 5: "DEMONSTRATION", 6: "ACCIDENT", 7: "HOLIDAY",
    8: "WEATHER", 9: "MAINTENANCE", 10: "CONSTRUCTION", 11: "POLICE_ACTIVITY", 12: "MEDICAL_EMERGENCY",
}
EFFECTS = {
    1: "NO_SERVICE", 2: "REDUCED_SERVICE", 3: "SIGNIFICANT_DELAYS", 4: "DETOUR", 5: "ADDITIONAL_SERVICE", 6: "MODIFIED_SERVICE",
    7: "OTHER_EFFECT", 8: "UNKNOWN_EFFECT", 9: "STOP_MOVED", 10: "NO_EFFECT", 11: "ACCESSIBILITY_ISSUE",
}
SEVERITIES = {1: "UNKNOWN_SEVERITY", 2: "INFO", 3: "WARNING", 4: "SEVERE"}


def with_routes(df: DataFrame, routes: DataFrame | None, lines: list[str] | None = None) -> DataFrame:
    """``df`` with route_short_name by route_id; with ``lines``, only rows of those.  Without a lookup nothing is filtered."""
    if routes is None:
        return df.withColumn("route_short_name", F.lit(None).cast("string"))
    names = routes.groupBy("route_id").agg(F.max("route_short_name").alias("route_short_name"))
    out = df.join(names, "route_id", "left")
    return out.filter(F.col("route_short_name").isin(lines)) if lines else out


def stop_observations(updates: DataFrame, poll_time: Column, routes: DataFrame | None = None, lines: list[str] | None = None, most_stops: int = 3) -> DataFrame:
    """A row for each of a trip's first ``most_stops`` scheduled stops with a delay (all below 1).

    stops_ahead is the place in the whole list, which skipped stops count in.
    """
    each = F.transform("stop_time_update", lambda s, i: F.struct(i.alias("stops_ahead"), s.alias("s")))
    told = F.filter(each, lambda x: (F.coalesce(x["s"]["relationship"], F.lit(0)) == 0) & (x["s"]["arrival"]["delay"].isNotNull() | x["s"]["departure"]["delay"].isNotNull()))
    first = F.slice(told, 1, F.lit(most_stops)) if most_stops >= 1 else told
    rows = updates.filter(F.coalesce(F.col("trip.trip_id"), F.lit("")) != "").select("trip", poll_time.alias("observed_at_utc"), F.explode(first).alias("x"))
    out = rows.select(
        service_date_or(F.col("trip.start_date"), F.col("observed_at_utc")).alias("service_date"),
        F.col("trip.trip_id").alias("trip_id"),
        F.col("x.s.stop_id").alias("stop_id"),
        F.col("trip.route_id").alias("route_id"),
        F.col("x.s.stop_sequence").alias("stop_sequence"),
        F.col("x.stops_ahead").alias("stops_ahead"),
        F.col("x.s.arrival.delay").alias("arrival_delay_s"),
        F.col("x.s.departure.delay").alias("departure_delay_s"),
        F.lit("SCHEDULED").alias("schedule_relationship"),
        "observed_at_utc",
    )
    return with_routes(out, routes, lines)


def trip_statuses(updates: DataFrame, poll_time: Column, routes: DataFrame | None = None, lines: list[str] | None = None) -> DataFrame:
    """A row for each trip that is not as scheduled, or skips stops (listed in feed order)."""
    skips = F.transform(F.filter("stop_time_update", lambda s: s["relationship"] == 1), lambda s: s["stop_id"])
    out = updates.select(
        service_date_or(F.col("trip.start_date"), poll_time).alias("service_date"),
        F.col("trip.trip_id").alias("trip_id"),
        F.col("trip.route_id").alias("route_id"),
        enum_name(F.coalesce(F.col("trip.relationship"), F.lit(0)), TRIP_RELATIONSHIPS).alias("trip_relationship"),
        F.coalesce(skips, F.array().cast("array<string>")).alias("skipped_stop_ids"),
        poll_time.alias("observed_at_utc"),
    )
    out = out.filter((F.coalesce("trip_id", F.lit("")) != "") & ((F.col("trip_relationship") != "SCHEDULED") | (F.size("skipped_stop_ids") > 0)))
    return with_routes(out, routes, lines)


def service_alerts(alerts: DataFrame, poll_time: Column) -> DataFrame:
    return alerts.select(
        F.col("id").alias("alert_id"),
        enum_name(F.coalesce("cause", F.lit(1)), CAUSES).alias("cause"),
        enum_name(F.coalesce("effect", F.lit(8)), EFFECTS).alias("effect"),
        enum_name(F.coalesce("severity", F.lit(1)), SEVERITIES).alias("severity"),
        *[translation(F.col(a)).alias(b) for a, b in (("header", "header_text"), ("description", "description_text"), ("url", "url"))],
        poll_time.alias("observed_at_utc"),
    )


def alert_scopes(alerts: DataFrame, poll_time: Column, routes: DataFrame | None = None) -> DataFrame:
    """Distinct selectors of each alert times its active periods; no periods: one, unbounded."""
    picked = F.array_distinct(F.transform("informed_entity", lambda e: F.struct(F.coalesce(e["route_id"], F.lit("")).alias("route_id"), F.coalesce(e["direction_id"], F.lit(-1)).alias("direction_id"), F.coalesce(e["stop_id"], F.lit("")).alias("stop_id"))))
    zero = F.lit(0).cast("long")
    period = lambda a, b: F.struct(F.coalesce(a, zero).alias("start"), F.coalesce(b, zero).alias("end"))
    periods = F.when(F.size(F.coalesce("active_period", F.array().cast("array<struct<start:bigint,end:bigint>>"))) > 0, F.transform("active_period", lambda p: period(p["start"], p["end"]))).otherwise(F.array(period(zero, zero)))
    rows = alerts.select(F.col("id").alias("alert_id"), F.explode(picked).alias("e"), periods.alias("p")).select("alert_id", "e.*", F.explode("p").alias("p"))
    out = rows.select("alert_id", "route_id", "direction_id", "stop_id", F.col("p.start").alias("active_period_start"), F.col("p.end").alias("active_period_end"), poll_time.alias("observed_at_utc"))
    return with_routes(out, routes)


def route_summary(updates: DataFrame, routes: DataFrame) -> DataFrame:
    """Trips by route: known ones first, then by falling count and id."""
    counts = updates.groupBy(F.col("trip.route_id").alias("route_id")).agg(F.count("*").alias("trips"))
    return with_routes(counts, routes).orderBy(F.col("route_short_name").isNull(), F.desc("trips"), "route_id")


def top_routes(updates: DataFrame, routes: DataFrame, k: int = 20) -> DataFrame:
    """The first k rows of the summary: a report."""
    return route_summary(updates, routes).limit(k)


def lookup_mismatch(updates: DataFrame, routes: DataFrame) -> Column | bool:
    """Whether there are trips but none of a known route: the lookup is of another era."""
    row = with_routes(updates.select(F.col("trip.route_id").alias("route_id")), routes).agg(F.count("*").alias("n"), F.count("route_short_name").alias("known")).first()
    return bool(row["n"] and not row["known"])


def first_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
