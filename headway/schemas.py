"""Explicit schemas of the stored tables and analysis frames, and the feature contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from headway.errors import LeakageError, SchemaMismatchError


#: Columns of the stored tables and feeds, as DDL strings, which need no session.
STOP_OBSERVATIONS = (
    "service_date string, trip_id string, stop_id string, stop_sequence int, route_id string, route_short_name string, "
    "stops_ahead int, arrival_delay_s int, departure_delay_s int, schedule_relationship string, "
    "first_seen_utc timestamp, last_seen_utc timestamp, observation_count long"
)
STOP_KEY = ("service_date", "trip_id", "stop_id", "stop_sequence")
POLL_LOG = "poll_time_utc timestamp, entities_seen long, rows_written long, status string"
SERVICE_ALERTS = (
    "alert_id string, cause string, effect string, severity string, header_text string, description_text string, url string, "
    "first_seen_utc timestamp, last_seen_utc timestamp, observation_count long"
)
ALERT_KEY = ("alert_id",)
ALERT_SCOPES = (
    "alert_id string, route_id string, direction_id int, stop_id string, active_period_start long, active_period_end long, "
    "route_short_name string, first_seen_utc timestamp, last_seen_utc timestamp"
)
SCOPE_KEY = ("alert_id", "route_id", "direction_id", "stop_id", "active_period_start")
TRIP_STATUSES = (
    "service_date string, trip_id string, trip_relationship string, route_id string, route_short_name string, "
    "skipped_stop_ids array<string>, first_seen_utc timestamp, last_seen_utc timestamp, observation_count long"
)
STATUS_KEY = ("service_date", "trip_id", "trip_relationship")

_STOP_EVENT = "struct<delay:int,time:bigint>"
TRIP_UPDATE = (
    "id string, trip struct<trip_id:string,route_id:string,start_date:string,relationship:int>, "
    f"stop_time_update array<struct<stop_id:string,stop_sequence:int,relationship:int,arrival:{_STOP_EVENT},departure:{_STOP_EVENT}>>"
)
_TEXTS = "array<struct<language:string,text:string>>"
ALERT = (
    f"id string, cause int, effect int, severity int, header {_TEXTS}, description {_TEXTS}, url {_TEXTS}, "
    "informed_entity array<struct<route_id:string,direction_id:int,stop_id:string>>, active_period array<struct<start:bigint,end:bigint>>"
)

#: Output columns, in order.
TRAINING_COLUMNS = (
    "service_date", "trip_id", "stop_id", "route_id", "route_short_name", "stop_sequence", "scheduled_arrival_s", "delay_s",
    "arrival_delay_s", "departure_delay_s", "prev_stop_delay_s", "stops_ahead_final", "observation_count", "observed_at_utc",
    "hour_local", "day_of_week", "is_weekend", "is_peak", "schedule_matched",
)
LABEL_COLUMNS = (
    "line", "window_start_utc", "window_start_local", "service_date", "n_services", "n_late", "share_late", "rule_a", "rule_b",
    "disrupted", "incident_ids",
)

#: What a delay model may see, and what would give it the answer.
DELAY_FEATURES = (
    "scheduled_arrival_s", "stop_sequence", "prev_stop_delay_s", "hour_local", "day_of_week", "is_weekend", "is_peak",
    "route_short_name", "stop_id",
)
DELAY_FORBIDDEN = frozenset(
    {"delay_s", "arrival_delay_s", "departure_delay_s", "stops_ahead_final", "observation_count", "observed_at_utc", "schedule_matched", "trip_id", "service_date", "route_id"}
)
DETECTION_FEATURES = (
    "line", "n_services", "n_late", "share_late", "mean_delay_s", "max_delay_s",
    *(f"{c}_lag{k}" for k in (1, 2, 3) for c in ("share_late", "n_services", "max_delay_s")),
    "hour_local", "day_of_week", "is_weekend", "is_peak", "alert_in_feed",
)
DETECTION_FORBIDDEN = frozenset(
    {"target", "target_rule_a", "target_rule_b", "disrupted_now", "rule_a", "incident_ids", "service_date", "window_start_utc", "window_start_local"}
)


def assert_columns(df: DataFrame, columns, what: str = "table") -> DataFrame:
    """``df``, unless one of ``columns`` is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise SchemaMismatchError(f"{what} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def features(df: DataFrame, names, forbidden, keep=()) -> DataFrame:
    """``keep`` and the features ``names`` of ``df``; refuses a feature that is forbidden."""
    if leaks := sorted(set(names) & set(forbidden)):
        raise LeakageError(f"{', '.join(leaks)} would tell the model its answer; leave them out")
    return assert_columns(df, names).select(*dict.fromkeys([*keep, *names]))
