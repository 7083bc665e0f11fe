"""All queries of the library's own operators, by name, with their DuckDB SQL.

The tables stand in for transit data: events are observations (line = event_type, trip = user_id, delay =
value), line items are the calls of a trip, orders are trips, embeddings are passages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions import text as text_functions
from headway.functions.time import calendar, clock, gtfs_seconds, service_day
from headway.operators import alerts, evalstats, labels, merge, models, reconcile, reports, retrieval, temporal, tools
from headway.sources.feed import first_per_group
from headway.schemas import DETECTION_FEATURES, DETECTION_FORBIDDEN, features
from headway.session import cut as _cut
from headway.session import work_folder
from headway.streaming import collect

WINDOW_S = 3 * 3600
RULE = labels.LabelRule(late_s=100, share=0.25, min_services=5, window_s=WINDOW_S)
RESAMPLES = 2000

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name, with the SQL of the same rows."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from headway.plans import moments, stores, words  # noqa: F401  they register theirs

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations."""
    return _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("line"), F.date_format("ts", "yyyy-MM-dd").alias("service_date"), F.col("user_id").cast("string").alias("trip_id"),
        F.lit(0).alias("stops_ahead"), F.col("value").alias("delay_s"), F.col("ts").cast("timestamp").alias("observed_at"), "event_id",
    )


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    counts = labels.services_by_window(labels.latest_by_service(labels.reliable(events), WINDOW_S, ("event_id",)), RULE.late_s)
    from headway.functions.time import floor_to

    span = events.agg(floor_to(F.min("observed_at"), WINDOW_S).alias("start"), (floor_to(F.max("observed_at"), WINDOW_S) + F.expr(f"INTERVAL {WINDOW_S} SECONDS")).alias("end"))
    grid = temporal.dense_grid(span, "start", "end", WINDOW_S, "line", events.select("line"))
    return labels.with_targets(labels.label_grid(grid, counts, RULE))


_LABELS = """
    e AS (SELECT event_type AS line, user_id, value, ts, event_id, time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '2000-01-01') AS w FROM events),
    latest AS (SELECT line, w, CAST(ts AS DATE) AS sd, user_id, arg_max(value, (ts, event_id)) AS d FROM e WHERE abs(value) <= 7200 GROUP BY ALL),
    counts AS (SELECT line, w, count(*) AS n, count(*) FILTER (d > 100) AS late, avg(d) AS mean_d, max(d) AS max_d FROM latest GROUP BY ALL),
    grid AS (SELECT line, w FROM (SELECT DISTINCT line FROM e), (SELECT unnest(generate_series(min(w), max(w), INTERVAL '3 hours')) AS w FROM e)),
    labelled AS (SELECT g.line, g.w, coalesce(n, 0) AS n_services, coalesce(late, 0) AS n_late, mean_d, max_d,
        coalesce(n, 0) >= 5 AND coalesce(late, 0) >= ceil(CAST(0.25 AS DOUBLE) * coalesce(n, 0) - CAST(1e-9 AS DOUBLE)) AS rule_b FROM grid g LEFT JOIN counts USING (line, w)),
    verdicts AS (SELECT *, CASE WHEN rule_b THEN true WHEN n_services >= 5 THEN false END AS disrupted FROM labelled),
    targets AS (SELECT *, lead(disrupted, 1) OVER o OR lead(disrupted, 2) OVER o AS target FROM verdicts WINDOW o AS (PARTITION BY line ORDER BY w))
"""


@query(f"WITH {_LABELS} SELECT line, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, n_services, n_late, rule_b, disrupted, target FROM targets")
def label_windows(spark, sf_dir):
    """AG2 AG3 JN6 JN7 SC10 WN3: services seen and late by line and window, disrupted now and soon."""
    return _labels(spark, sf_dir).select("line", _stamp("window_start").alias("window_start"), "n_services", "n_late", "rule_b", "disrupted", "target")


@query("SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, arg_max(value, (ts, event_id)) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS observed_at, count(*) AS observation_count FROM events GROUP BY user_id, event_type, strftime(ts, '%Y-%m-%d')")
def collapse_events(spark, sf_dir):
    """AG1 JN5: the latest observation of each key and how many there were."""
    rows = _table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).drop("props")
    return reconcile.collapse(rows, ("user_id", "event_type", "day"), "ts", ("event_id",)).select("user_id", "event_type", "day", "value", _stamp("ts").alias("observed_at"), "observation_count")


_HALVES = ("event_type IN ('click', 'error')", "event_type NOT IN ('click', 'error')")


@query(
    f"""WITH s AS (SELECT user_id, arg_max(value, (ts, event_id)) AS value, min(ts) AS first, max(ts) AS last, count(DISTINCT ts) AS n FROM events WHERE {_HALVES[0]} GROUP BY user_id),
    b AS (SELECT * FROM events WHERE {_HALVES[1]}),
    f AS (SELECT b.user_id, arg_max(b.value, (b.ts, b.event_id)) AS value, min(b.ts) AS first, max(b.ts) AS last, count(DISTINCT CASE WHEN s.last IS NULL OR b.ts > s.last THEN b.ts END) AS n FROM b LEFT JOIN s USING (user_id) GROUP BY b.user_id)
    SELECT coalesce(s.user_id, f.user_id) AS user_id, CASE WHEN s.last IS NULL OR f.last > s.last THEN f.value ELSE s.value END AS value,
        strftime(coalesce(s.first, f.first), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(greatest(s.last, f.last), '%Y-%m-%d %H:%M:%S') AS last_seen,
        coalesce(s.n, 0) + CASE WHEN s.last IS NULL OR f.last > s.last THEN f.n ELSE 0 END AS observation_count
    FROM s FULL JOIN f ON s.user_id = f.user_id"""
)
def guarded_upsert(spark, sf_dir):
    """SNK1 TMP5: a second batch of observations folded into what is stored of the first."""
    rows = _table(spark, sf_dir, "events").select("user_id", "ts", "value", "event_id", "event_type")
    first, second = (rows.filter(h).drop("event_type") for h in _HALVES)
    stored = merge.fold_batch(first, ["user_id"], "ts", ["event_id"])
    out = merge.guarded_upsert(stored, second, ["user_id"], "ts", ["event_id"])
    return out.select("user_id", "value", _stamp("first_seen_utc").alias("first_seen"), _stamp("last_seen_utc").alias("last_seen"), "observation_count")


@query(
    """WITH f AS (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY ALL)
    SELECT f.user_id, string_agg(event_type, ',' ORDER BY t, event_type) AS skipped, strftime(max(first), '%Y-%m-%d %H:%M:%S') AS first_seen, max(n) AS observation_count
    FROM f JOIN (SELECT user_id, min(ts) AS first, count(DISTINCT ts) AS n FROM events GROUP BY ALL) USING (user_id) GROUP BY f.user_id"""
)
def status_merge_sets(spark, sf_dir):
    """SNK3 SET4: lists that accumulate over two batches, the stored order first."""
    rows = _table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("observed_at"), F.array("event_type").alias("skipped_stop_ids"))
    none = spark.createDataFrame([], "user_id long, skipped_stop_ids array<string>, first_seen_utc timestamp_ntz, last_seen_utc timestamp_ntz, observation_count long")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    stored = merge.merge_status(none, rows.filter(F.col("observed_at") < half), ["user_id"], "observed_at")
    out = merge.merge_status(stored, rows.filter(F.col("observed_at") >= half), ["user_id"], "observed_at")
    return out.select("user_id", F.array_join("skipped_stop_ids", ",").alias("skipped"), _stamp("first_seen_utc").alias("first_seen"), "observation_count")


_CALL_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_CALL_ORDER}) AS n FROM lineitem WHERE l_returnflag <> 'R') WHERE n <= 3")
def first_k_per_trip(spark, sf_dir):
    """FLT1 WN5: the first three calls of each trip that are not dropped."""
    rows = _table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'")
    return first_per_group(rows, ["l_orderkey"], _CALL_ORDER.split(", "), 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten(spark, sf_dir):
    """FLT3 FLT4 SRC15: a nested optional number."""
    return _table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long").getField("k").alias("k"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {_CALL_ORDER}) AS prev_quantity FROM lineitem")
def prev_stop_delay(spark, sf_dir):
    """WN1: the value at the trip's call before."""
    rows = _table(spark, sf_dir, "lineitem")
    return reconcile.previous_delay(rows, ["l_orderkey"], _CALL_ORDER.split(", "), "prev_quantity", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "prev_quantity")


@query(
    """WITH s AS (SELECT l_orderkey, l_partkey, max(l_linenumber) AS seq FROM lineitem GROUP BY ALL)
    SELECT o_orderkey, s.l_partkey AS stop, s.seq AS stop_sequence, s.seq IS NOT NULL AS schedule_matched FROM orders LEFT JOIN s ON o_orderkey = l_orderkey AND o_custkey = l_partkey"""
)
def attach_schedule(spark, sf_dir):
    """JN2: trips with their timetable call, where there is one."""
    calls = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id")).agg(F.max("l_linenumber").alias("stop_sequence"))
    trips = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("stop_id"))
    out = reconcile.attach_schedule(trips, calls.withColumn("scheduled_arrival_s", F.lit(0)))
    return out.select(F.col("trip_id").alias("o_orderkey"), F.when(F.col("schedule_matched"), F.col("stop_id")).alias("stop"), "stop_sequence", "schedule_matched")


@query(
    """WITH r AS (SELECT l_orderkey, l_partkey, CASE WHEN l_shipdate >= DATE '1995-01-01' THEN 0 ELSE 1 END AS era, l_linenumber, CAST(l_linenumber AS BIGINT) * 10000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS file_row FROM lineitem)
    SELECT l_orderkey AS trip_id, l_partkey AS stop_id, arg_max(era, (-era, file_row)) AS bundle_rank, arg_max(l_linenumber, (-era, file_row)) AS stop_sequence, (20 + arg_max(l_linenumber, (-era, file_row))) * 3600 + 600 AS scheduled_arrival_s FROM r GROUP BY ALL"""
)
def first_bundle_wins(spark, sf_dir):
    """JN3 SC4: within an era the last row of a call wins, across eras the newest."""
    n = F.col("l_linenumber")
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id"), F.when(F.col("l_shipdate") >= F.lit("1995-01-01").cast("date"), 0).otherwise(1).alias("bundle_rank"), n.cast("string").alias("stop_sequence"),
        F.concat((n + 20).cast("string"), F.lit(":10:00")).alias("arrival_time"), F.lit("bad").alias("departure_time"), (n.cast("long") * 10000000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("file_row"),
    )
    return reconcile.merged_timetable(rows).select("trip_id", "stop_id", "bundle_rank", "stop_sequence", "scheduled_arrival_s")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_wanted(spark, sf_dir):
    """JN4: rows whose key is wanted."""
    return _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_unmatched(spark, sf_dir):
    """JN10 JN24 SET6: rows whose key is unknown."""
    return _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name, r_name AS station FROM nation JOIN region ON n_regionkey = r_regionkey")
def parent_rollup(spark, sf_dir):
    """SRC11 JN21: stops named by their parent station."""
    nations = _table(spark, sf_dir, "nation")
    stops = nations.select(F.concat(F.lit("n"), "n_nationkey").alias("stop_id"), F.col("n_name").alias("stop_name"), F.concat(F.lit("r"), "n_regionkey").alias("parent_station"))
    parents = _table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("stop_id"), F.concat("r_name", F.lit(" Station")).alias("stop_name"), F.lit(None).cast("string").alias("parent_station"))
    named = tools.station_names(stops.unionByName(parents))
    return nations.join(named, F.concat(F.lit("n"), "n_nationkey") == named["stop_id"]).select("n_nationkey", "n_name", "station")


@query(
    """WITH t AS (SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Australia/Sydney' AS wall FROM events)
    SELECT event_id, strftime(wall - INTERVAL 3 HOURS, '%Y-%m-%d') AS service_date, CAST(hour(wall) AS INTEGER) AS hour_local, CAST(isodow(wall) - 1 AS INTEGER) AS day_of_week, isodow(wall) >= 6 AS is_weekend,
        isodow(wall) < 6 AND (hour(wall) BETWEEN 6 AND 9 OR hour(wall) BETWEEN 15 AND 18) AS is_peak FROM t"""
)
def calendar_features(spark, sf_dir):
    """SC1 SC3 SC7 SC8: service day, hour, weekday and peak on the wall clock."""
    return _table(spark, sf_dir, "events").select("event_id", service_day(F.col("ts")).alias("service_date"), *[c.alias(n) for n, c in calendar(F.col("ts")).items()])


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, 20 + l_linenumber AS h FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN q > 9 THEN h * 3600 + q * 60 + 30 END AS INTEGER) AS seconds, CASE WHEN q > 9 THEN lpad(CAST(h % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(q AS VARCHAR), 2, '0') END AS clock FROM t"""
)
def gtfs_time(spark, sf_dir):
    """SC4 SC21: hours past 24; malformed times (one-digit minutes) are NULL."""
    told = F.concat((F.col("l_linenumber") + 20).cast("string"), F.lit(":"), F.col("l_quantity").cast("long").cast("string"), F.lit(":30"))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gtfs_seconds(told).alias("seconds"))
    return rows.withColumn("clock", F.when(F.col("seconds").isNotNull(), clock(F.col("seconds"))))


@query(
    """WITH m AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem)
    SELECT l_orderkey, l_linenumber, month FROM m WHERE month IN (SELECT month FROM m GROUP BY month HAVING avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0 END) >= 0.333)"""
)
def coverage_filter(spark, sf_dir):
    """FIL3 AG6: whole periods stay or go by the share of their rows that is covered."""
    rows = _table(spark, sf_dir, "lineitem").withColumns({"month": F.date_format("l_shipdate", "yyyy-MM"), "covered": F.when(F.col("l_returnflag") == "N", 1)})
    return reconcile.schedule_covered(rows, "month", "covered", least=0.333).select("l_orderkey", "l_linenumber", "month")


@query(
    """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS c FROM d)
    SELECT day, n, CASE WHEN k <= greatest(1, round_even(c * CAST(0.7 AS DOUBLE), 0)) THEN 'train' WHEN k <= greatest(1, round_even(c * CAST(0.7 AS DOUBLE), 0), round_even(c * CAST(0.85 AS DOUBLE), 0)) THEN 'validation' ELSE 'test' END AS split FROM r"""
)
def chronological_split(spark, sf_dir):
    """GEN8: whole days, in order, to train, validation and test."""
    rows = _table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return reconcile.with_split(rows, "day").groupBy("day", "split").agg(F.count("*").alias("n")).select("day", "n", "split")


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), s AS (SELECT count(*) AS days, min(n) AS least_a_day, median(n) AS median_a_day, max(n) AS most_a_day FROM d)
    SELECT count(*) AS n, count(DISTINCT user_id) AS entities, round(median(value), 6) AS median_value, round(quantile_cont(value, 0.9), 6) AS p90_value, count(*) FILTER (value IS NULL) AS missing,
        max(days) AS days, max(least_a_day) AS least_a_day, CAST(max(median_a_day) AS DOUBLE) AS median_a_day, max(most_a_day) AS most_a_day, (SELECT count(*) FROM d, s WHERE d.n < 0.25 * median_a_day) AS thin_days FROM events, s"""
)
def quality_report(spark, sf_dir):
    """AG7: counts, spread and thin days."""
    rows = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    out = reconcile.quality_report(rows, "day", "value", "user_id")
    return out.withColumns({"median_value": F.round("median_value", 6), "p90_value": F.round("p90_value", 6)})


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def pivot_dates(spark, sf_dir):
    """AG8: counts by date and line, crosswise."""
    return reports.crosswise(_table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", "event_type")


@query(
    f"WITH {_LABELS} SELECT line, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, n_services, "
    + ", ".join(f"lag(n_services, {k}) OVER o AS n_services_lag{k}, round(lag(max_d, {k}) OVER o, 6) AS max_delay_s_lag{k}" for k in (1, 2, 3))
    + " FROM labelled WINDOW o AS (PARTITION BY line ORDER BY w)"
)
def lags_123(spark, sf_dir):
    """WN2 AG4: aggregates of the three windows before."""
    out = temporal.with_lags(_labels(spark, sf_dir), ["line"], ["window_start"], ["n_services", "max_delay_s"], (1, 2, 3))
    return out.select("line", _stamp("window_start").alias("window_start"), "n_services", *[c for k in (1, 2, 3) for c in (F.col(f"n_services_lag{k}"), F.round(f"max_delay_s_lag{k}", 6).alias(f"max_delay_s_lag{k}"))])


@query(
    """SELECT e.event_id, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS poll_time FROM events e ASOF LEFT JOIN (SELECT DISTINCT ts FROM events WHERE event_type = 'error') p ON e.ts >= p.ts"""
)
def asof_poll(spark, sf_dir):
    """JN13 JN14: the last poll at or before each moment."""
    rows = _table(spark, sf_dir, "events")
    polls = rows.filter("event_type = 'error'").select(F.col("ts").alias("poll_time"))
    return temporal.asof_last(rows.select("event_id", "ts"), polls, "ts", "poll_time", take=["poll_time"]).select("event_id", _stamp("poll_time").alias("poll_time"))


@query(
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, time_bucket(INTERVAL '3 hours', min(ts), TIMESTAMP '2000-01-01') AS a, time_bucket(INTERVAL '3 hours', max(ts), TIMESTAMP '2000-01-01') AS b FROM events GROUP BY ALL)
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM (SELECT unnest(generate_series(a, b, INTERVAL '3 hours')) AS w FROM s) GROUP BY 1"""
)
def interval_windows(spark, sf_dir):
    """JN8: spans counted in every window that they touch."""
    spans = _table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return temporal.explode_windows(spans, "a", "b", WINDOW_S).groupBy(_stamp("window_start").alias("window_start")).agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'cancelled' ELSE 'skipped' END AS why, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAYS AND (o_orderstatus = 'F' OR l_linenumber IN (1, 3)))
    SELECT why, l_returnflag, count(*) AS calls FROM p GROUP BY ALL"""
)
def status_holds(spark, sf_dir):
    """JN11 TMP9: calls that fell into the time that a status held."""
    statuses = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trip_id"), F.lit("").alias("service_date"), F.when(F.col("o_orderstatus") == "F", "CANCELED").otherwise("SCHEDULED").alias("trip_relationship"), F.array(F.lit("1"), F.lit("3")).alias("skipped_stop_ids"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 60 DAYS")).alias("last_seen"),
    )
    calls = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.lit("").alias("service_date"), F.col("l_linenumber").cast("string").alias("stop_id"), F.col("l_shipdate").cast("timestamp").alias("due"), "l_returnflag")
    placed, _ = labels.unserved_calls(statuses, calls)
    return placed.groupBy("why", "l_returnflag").agg(F.count("*").alias("calls"))


@query(
    """WITH e AS (SELECT event_type AS line, user_id, value, ts, event_id, CAST(ts AS DATE) AS sd, time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '2000-01-01') AS w FROM events),
    latest AS (SELECT line, w, sd, user_id, arg_max(value, (ts, event_id)) > 100 AS late FROM e WHERE line <> 'error' GROUP BY ALL),
    failed AS (SELECT DISTINCT 'view' AS line, w, sd, user_id FROM e WHERE line = 'error'),
    both_of AS (SELECT coalesce(l.line, f.line) AS line, coalesce(l.w, f.w) AS w, coalesce(late, false) OR f.user_id IS NOT NULL AS late FROM latest l FULL JOIN failed f ON l.line = f.line AND l.w = f.w AND l.sd = f.sd AND l.user_id = f.user_id),
    a AS (SELECT line, w, count(*) AS n_services, count(*) FILTER (late) AS n_late FROM latest GROUP BY ALL), b AS (SELECT line, w, count(*) AS n, count(*) FILTER (late) AS l FROM both_of GROUP BY ALL)
    SELECT line, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, n_services, n_late, n AS n_services_check, l AS n_late_check FROM a JOIN b USING (line, w) WHERE w >= TIMESTAMP '2024-01-03'"""
)
def label_check(spark, sf_dir):
    """JN9 JN16 SET3: windows with and without services that failed, side by side."""
    rows = _events(spark, sf_dir)
    latest = labels.latest_by_service(rows.filter("line <> 'error'"), WINDOW_S, ("event_id",))
    from headway.functions.time import floor_to

    failed = rows.filter("line = 'error'").select(F.lit("view").alias("line"), floor_to(F.col("observed_at"), WINDOW_S).alias("window_start"), "service_date", "trip_id")
    one, two = (labels.services_by_window(latest, RULE.late_s, f).select("line", "window_start", "n_services", "n_late") for f in (None, failed))
    both = labels.compare_labels(one.withColumn("service_date", F.date_format("window_start", "yyyy-MM-dd")), two, "2024-01-03")
    return both.select("line", _stamp("window_start").alias("window_start"), "n_services", "n_late", "n_services_check", "n_late_check")


def _marker_sql(markers) -> str:
    return "CASE " + " ".join(f"WHEN contains(t, '{m}') THEN '{m}'" for m in markers) + " END"


@query(
    f"""WITH d AS (SELECT doc_id, lower(source || chr(10) || text) AS t FROM documents), m AS (SELECT doc_id, {_marker_sql(text_functions.PLANNED)} AS p, {_marker_sql(text_functions.IMPACT)} AS i FROM d)
    SELECT doc_id, p IS NULL AND i IS NOT NULL AS is_incident, CASE WHEN p IS NOT NULL THEN 'planned work: ''' || p || '''' WHEN i IS NOT NULL THEN 'service impact: ''' || i || '''' ELSE 'no effect on train running stated' END AS reason FROM m"""
)
def classify_text(spark, sf_dir):
    """SC12: the ordered rule over whole texts."""
    v = text_functions.classify(F.lit("UNKNOWN_CAUSE"), F.col("source"), F.col("text"), F.lit(0))
    return _table(spark, sf_dir, "documents").select("doc_id", v["is_incident"].alias("is_incident"), v["reason"].alias("reason"))


def _feed(spark, sf_dir) -> DataFrame:
    """Orders with their line items as nested trip updates."""
    delay = lambda c, when: F.struct(F.when(when, F.col(c).cast("int")).alias("delay"), F.lit(None).cast("bigint").alias("time"))
    relationship = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    calls = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*_CALL_ORDER.split(", "), F.struct(
        F.col("l_partkey").cast("string").alias("stop_id"), F.col("l_linenumber").cast("int").alias("stop_sequence"), relationship.alias("relationship"),
        delay("l_quantity", F.col("l_returnflag") == "A").alias("arrival"), delay("l_linenumber", F.col("l_quantity") > 10).alias("departure"),
    ).alias("s")).alias("x"))
    lists = calls.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("stop_time_update"))
    trip = F.struct(F.col("o_orderkey").cast("string").alias("trip_id"), F.col("o_orderpriority").alias("route_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("start_date"), F.when(F.col("o_orderstatus") == "P", 3).otherwise(0).alias("relationship"))
    return _table(spark, sf_dir, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").cast("string").alias("id"), trip.alias("trip"), "stop_time_update")


_FEED = f"""c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_CALL_ORDER}) - 1 AS ahead, CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INTEGER) END AS arr, CASE WHEN l_quantity > 10 THEN CAST(l_linenumber AS INTEGER) END AS dep FROM lineitem)"""


@query(
    f"""WITH {_FEED}, k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ahead) AS n FROM c WHERE l_returnflag <> 'R' AND (arr IS NOT NULL OR dep IS NOT NULL))
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS service_date, CAST(o_orderkey AS VARCHAR) AS trip_id, CAST(l_partkey AS VARCHAR) AS stop_id, o_orderpriority AS route_id, CAST(l_linenumber AS INTEGER) AS stop_sequence, CAST(ahead AS INTEGER) AS stops_ahead, arr AS arrival_delay_s, dep AS departure_delay_s
    FROM k JOIN orders ON l_orderkey = o_orderkey WHERE n <= 3"""
)
def flatten_observations(spark, sf_dir):
    """FLT1 FLT4 FLT8 SC2: each trip's first scheduled stops with a delay, from a nested feed."""
    from headway.sources.feed import stop_observations

    out = stop_observations(_feed(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return out.select("service_date", "trip_id", "stop_id", "route_id", "stop_sequence", "stops_ahead", "arrival_delay_s", "departure_delay_s")


@query(
    f"""WITH {_FEED}, s AS (SELECT l_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY ahead) FILTER (l_returnflag = 'R'), '') AS skips FROM c GROUP BY 1)
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS service_date, CAST(o_orderkey AS VARCHAR) AS trip_id, o_orderpriority AS route_id, CASE WHEN o_orderstatus = 'P' THEN 'CANCELED' ELSE 'SCHEDULED' END AS trip_relationship, skips AS skipped
    FROM orders JOIN s ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' OR skips <> ''"""
)
def flatten_statuses(spark, sf_dir):
    """FLT2: trips that are cancelled or skip stops."""
    from headway.sources.feed import trip_statuses

    out = trip_statuses(_feed(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return out.select("service_date", "trip_id", "route_id", "trip_relationship", F.array_join("skipped_stop_ids", ",").alias("skipped"))


@query(
    """WITH e AS (SELECT user_id, event_type, value > 100 AS dir FROM events GROUP BY ALL), p AS (SELECT user_id, epoch(date_trunc('day', ts)) AS s FROM events WHERE event_type = 'error' GROUP BY ALL)
    SELECT CAST(e.user_id AS VARCHAR) AS alert_id, event_type AS route_id, CAST(dir AS INTEGER) AS direction_id, coalesce(CAST(p.s AS BIGINT), 0) AS active_period_start, CASE WHEN p.s IS NULL THEN 0 ELSE CAST(p.s AS BIGINT) + 86400 END AS active_period_end FROM e LEFT JOIN p USING (user_id)"""
)
def flatten_scopes(spark, sf_dir):
    """FLT3 FLT6: distinct selectors of each alert times its active periods."""
    from headway.sources.feed import alert_scopes

    rows = _table(spark, sf_dir, "events")
    day = F.unix_seconds(F.date_trunc("day", F.col("ts")).cast("timestamp"))
    period = F.when(F.col("event_type") == "error", F.struct(day.alias("start"), (day + 86400).alias("end")))
    entity = F.struct(F.col("event_type").alias("route_id"), (F.col("value") > 100).cast("int").alias("direction_id"), F.lit(None).cast("string").alias("stop_id"))
    feed = rows.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.collect_set(entity).alias("informed_entity"), F.collect_set(period).alias("active_period"))
    return alert_scopes(feed, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("alert_id", "route_id", "direction_id", "active_period_start", "active_period_end")


_ISLANDS = """
    g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER o) <= 2100 THEN 0 ELSE 1 END AS fresh FROM events WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
"""


@query(
    f"""WITH {_ISLANDS} SELECT 'inc-' || substr(sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR))), 1, 10) AS incident_id, event_type AS line, count(*) AS n_alerts,
        strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM i GROUP BY event_type, island"""
)
def components(spark, sf_dir):
    """JN17 AG10 AG11: republications chained into incidents."""
    rows = _table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("alert_id"), F.col("event_type").alias("cause"), F.array("event_type").alias("lines"), F.col("ts").cast("timestamp").alias("first_seen"), F.col("ts").cast("timestamp").alias("last_seen")
    )
    found = alerts.incidents(rows, _cut)
    return found.select("incident_id", F.get("lines", F.lit(0)).alias("line"), F.size("alert_ids").cast("long").alias("n_alerts"), _stamp("first_seen").alias("first_seen"), _stamp("last_seen").alias("last_seen"))


@query(
    f"""WITH {_LABELS}, k AS (SELECT *, coalesce(disrupted, false) AS flag, CAST(w AS DATE) AS d FROM targets WHERE target IS NOT NULL),
    s AS (SELECT count(*) FILTER (flag AND target) AS tp, count(*) FILTER (flag AND NOT target) AS fp, count(*) FILTER (NOT flag AND target) AS fn, count(*) FILTER (flag) AS flagged, count(*) FILTER (target) AS positive, count(DISTINCT d) AS dates FROM k)
    SELECT *, round(tp / flagged, 9) AS precision, round(tp / positive, 9) AS recall, round(2 * tp / (flagged + positive), 9) AS f1, round(fp / dates, 9) AS false_alarms_a_day FROM s"""
)
def detection_scores(spark, sf_dir):
    """AG12 ML7: scores of the persistence detector."""
    rows = _labels(spark, sf_dir).withColumn("d", F.to_date("window_start"))
    out = evalstats.detection_scores(rows, F.coalesce("disrupted", F.lit(False)), F.col("target"), "d")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "false_alarms_a_day")})


_CURVE = """
    s AS (SELECT value AS score, count(*) AS n, count(*) FILTER (event_type = 'error') AS p FROM events GROUP BY 1),
    c AS (SELECT *, sum(n) OVER o AS flagged, sum(p) OVER o AS tp FROM s WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""


def _curve(spark, sf_dir):
    return evalstats.score_curve(_table(spark, sf_dir, "events").withColumn("target", F.col("event_type") == "error"), "value", "target")


@query(f"WITH {_CURVE} SELECT round(sum(tp / flagged * p) / sum(p), 9) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    """AG13 WN7: step-wise average precision, ties of a score together."""
    return evalstats.average_precision(_curve(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


@query(
    f"""WITH {_CURVE}, f AS (SELECT *, 2 * tp / (flagged + (SELECT sum(p) FROM s)) AS f1, lead(score) OVER (ORDER BY score DESC) AS lower FROM c), b AS (SELECT * FROM f ORDER BY f1 DESC, score DESC LIMIT 1)
    SELECT round((score + coalesce(lower, 0)) / 2, 9) AS threshold, round(f1, 9) AS f1 FROM b"""
)
def best_threshold(spark, sf_dir):
    """AG14: the threshold of the best F1, halfway to the next score."""
    return evalstats.best_threshold(_curve(spark, sf_dir)).select(F.round("threshold", 9).alias("threshold"), F.round("f1", 9).alias("f1"))


def _calls(spark, sf_dir) -> DataFrame:
    """Line items with the value at the call before, as a guess of their own."""
    rows = _table(spark, sf_dir, "lineitem")
    out = reconcile.previous_delay(rows, ["l_orderkey"], _CALL_ORDER.split(", "), "prev", "l_quantity")
    return out.filter("prev IS NOT NULL").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("truth"), F.col("prev").cast("double").alias("guess"), F.lit(25.0).alias("naive"))


_CALLS = f"""
    l AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS DOUBLE) AS truth, CAST(lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {_CALL_ORDER}) AS DOUBLE) AS guess FROM lineitem),
    r AS (SELECT *, guess - truth AS e FROM l WHERE guess IS NOT NULL)
"""
_SCORES = "count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(CASE WHEN truth <> 0 THEN abs(e) / abs(truth) END), 6) AS mape, round(avg(CASE WHEN truth <> 0 THEN 1.0 ELSE 0 END), 6) AS mape_coverage"


@query(f"WITH {_CALLS} SELECT {_SCORES}, round(avg(abs(e)) / avg(abs(25.0 - truth)), 6) AS mase FROM r")
def regression_scores(spark, sf_dir):
    """AG15 FIL6: errors of the persistence guess, also against a constant."""
    out = evalstats.regression_scores(_calls(spark, sf_dir), "truth", "guess", "naive")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "n"})


@query(f"WITH {_CALLS} SELECT l_returnflag, {_SCORES} FROM r GROUP BY l_returnflag")
def by_segment(spark, sf_dir):
    """AG16: the same by segment."""
    out = evalstats.regression_scores(_calls(spark, sf_dir), "truth", "guess", by=["l_returnflag"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("n", "l_returnflag")})


@query(f"WITH {_CALLS}, q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS share, unnest(quantile_cont(e, [0.05, 0.25, 0.5, 0.75, 0.95])) AS v FROM r) SELECT CAST(share AS DOUBLE) AS share, round(v, 6) AS residual FROM q")
def residual_pct(spark, sf_dir):
    """AG17: interpolated percentiles of the errors."""
    return evalstats.residual_percentiles(_calls(spark, sf_dir), "truth", "guess").select("share", F.round("residual", 6).alias("residual"))


_BANDS = "CASE WHEN guess <= 10 THEN '<=10' WHEN guess <= 30 THEN '10-30' ELSE '>30' END"


def _banded(spark, sf_dir):
    g = F.col("guess")
    return _calls(spark, sf_dir).withColumns({"bin": F.concat_ws("|", "l_returnflag", F.when(g <= 10, "<=10").when(g <= 30, "10-30").otherwise(">30")), "score": F.abs(g - F.col("truth"))})


_WIDTHS = f"""{_CALLS}, b AS (SELECT *, l_returnflag || '|' || {_BANDS} AS bin, abs(e) AS score FROM r),
    k AS (SELECT bin, score, row_number() OVER (PARTITION BY bin ORDER BY score) AS rn, count(*) OVER (PARTITION BY bin) AS n FROM b UNION ALL SELECT 'all', score, row_number() OVER (ORDER BY score), count(*) OVER () FROM b),
    w AS (SELECT bin, max(n) AS n, min(CASE WHEN rn = ceil((n + 1) * CAST(0.9 AS DOUBLE)) THEN score END) AS width FROM k GROUP BY bin)"""


@query(f"WITH {_WIDTHS} SELECT bin, n, width FROM w")
def conformal(spark, sf_dir):
    """AG18 SC11: split-conformal half-widths by bin and over all."""
    out = evalstats.conformal_widths(_banded(spark, sf_dir), "bin", "score", 0.1)
    return out.select(F.coalesce("bin", F.lit("all")).alias("bin"), "n", "width")


@query(
    f"""WITH {_WIDTHS}, x AS (SELECT l_returnflag AS segment, b.score <= w.width AS inside, w.width FROM b JOIN w USING (bin)), y AS (SELECT * FROM x UNION ALL SELECT 'all', inside, width FROM x)
    SELECT segment, count(*) AS n, round(avg(CASE WHEN inside THEN 1.0 ELSE 0 END), 9) AS share_inside, CAST(median(width) AS DOUBLE) AS median_width FROM y GROUP BY segment"""
)
def coverage_table(spark, sf_dir):
    """AG19 ML8: share of truths inside their intervals, by segment and over all."""
    rows = _banded(spark, sf_dir)
    widths = evalstats.conformal_widths(rows, "bin", "score", 0.1).filter("NOT all").select("bin", "width")
    out = evalstats.coverage_table(rows.join(widths, "bin"), "l_returnflag", F.col("score") <= F.col("width"), F.col("width"))
    return out.withColumn("share_inside", F.round("share_inside", 9))


#: The draws of the bootstraps: each resample draws as many dates as there are, by digests of its number and the draw's.
_DRAWS = f"""days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events)),
    drawn AS (SELECT r AS resample, CAST('0x' || substr(md5('0-' || r || '-' || j.i), 1, 12) AS BIGINT) % j.n AS i FROM range({RESAMPLES}) t(r), days j),
    draws AS (SELECT resample, day, count(*) AS times FROM drawn JOIN days USING (i) GROUP BY ALL),
    d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(value) AS s, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS es, count(*) FILTER (event_type = 'error') AS en FROM events GROUP BY 1)"""
_INTERVAL = "SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, avg(CASE WHEN m IS NOT NULL THEN 1.0 ELSE 0 END) AS defined FROM x"


def _by_day(spark, sf_dir):
    error = F.col("event_type") == "error"
    return _table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.sum("value").alias("s"), F.count("*").alias("n"), F.sum(F.when(error, F.col("value")).otherwise(0.0)).alias("es"), F.count_if(error).alias("en"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query(f"WITH {_DRAWS}, x AS (SELECT resample, sum(s * times) / sum(d.n * times) AS m FROM draws JOIN d USING (day) GROUP BY 1) {_INTERVAL}")
def bootstrap_date(spark, sf_dir):
    """AG20 SET7: an interval of the mean, whole dates resampled."""
    by_day = _by_day(spark, sf_dir)
    return _rounded(evalstats.bootstrap_by_date(by_day, evalstats.date_draws(by_day, RESAMPLES), ["s", "n"], lambda s, n: F.try_divide(s, n)))


@query(f"WITH {_DRAWS}, x AS (SELECT resample, sum(es * times) / nullif(sum(en * times), 0) - sum(s * times) / sum(d.n * times) AS m FROM draws JOIN d USING (day) GROUP BY 1) {_INTERVAL}")
def paired_bootstrap(spark, sf_dir):
    """AG21: an interval of a difference, both sides on the same draws."""
    by_day = _by_day(spark, sf_dir)
    return _rounded(evalstats.bootstrap_by_date(by_day, evalstats.date_draws(by_day, RESAMPLES), ["s", "n", "es", "en"], lambda s, n, es, en: F.try_divide(es, en) - F.try_divide(s, n)))


@query(
    """WITH i AS (SELECT event_type AS line, CAST(ts AS DATE) AS d, floor(median(epoch(ts))) AS a FROM events GROUP BY ALL), f AS (SELECT event_type AS line, floor(epoch(ts)) AS t FROM events WHERE value > 300),
    l AS (SELECT i.line, i.d, i.a, min(t) AS t FROM i LEFT JOIN f ON f.line = i.line AND f.t BETWEEN i.a - 3600 AND i.a + 1800 + 900 GROUP BY ALL)
    SELECT count(*) AS incidents, count(t) AS flagged, count(*) FILTER (a - t > 0) AS ahead, CAST(median(a - t) AS DOUBLE) AS median_lead_s FROM l"""
)
def lead_time(spark, sf_dir):
    """JN18 AG27: how long before its alert an incident was flagged."""
    rows = _table(spark, sf_dir, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    alert = F.timestamp_seconds(F.floor("a"))
    found = rows.groupBy(F.col("event_type").alias("line"), F.to_date("ts").alias("d")).agg(F.median(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("a"))
    cases = found.select(F.col("d").cast("string").alias("incident_id"), "line", alert.alias("alert"), (alert + F.expr("INTERVAL 1800 SECONDS")).alias("last_seen"))
    flags = rows.filter("value > 300").select(F.col("event_type").alias("line"), F.col("ts").alias("flag_end"))
    return evalstats.lead_summary(evalstats.lead_times(cases, flags))


_RANKED = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(_TYPES)) + " END"


@query(
    f"""WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, {_RANKED} AS r, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT DISTINCT day FROM c),
    s AS (SELECT d.day, c.event_type, c.r, sum(n) AS n FROM d LEFT JOIN c ON c.day < d.day GROUP BY ALL)
    SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(arg_max(event_type, (n, -r)), 'none') AS guess FROM s GROUP BY day"""
)
def mode_so_far(spark, sf_dir):
    """AG24 JN19: the commonest group before each day."""
    rows = _table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return evalstats.mode_so_far(rows, "day", "event_type", _TYPES, "none")


_GUESS = "CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' que ') THEN 'es' ELSE 'fr' END"


@query(
    f"""WITH g AS (SELECT lang AS t, {_GUESS} AS g FROM documents), a AS (SELECT t, count(*) AS actual, count(*) FILTER (t = g) AS tp FROM g GROUP BY t), p AS (SELECT g, count(*) AS guessed FROM g GROUP BY g)
    SELECT round(avg(2 * tp / (actual + coalesce(guessed, 0))), 9) AS macro_f1, count(*) AS groups FROM a LEFT JOIN p ON a.t = p.g"""
)
def macro_f1(spark, sf_dir):
    """AG22: F1 averaged over the groups that occur."""
    rows = _table(spark, sf_dir, "documents").select("lang", F.expr(_GUESS).alias("guess"))
    return evalstats.macro_f1(rows, "lang", "guess").withColumn("macro_f1", F.round("macro_f1", 9))


def _passages(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


@query(
    """WITH q AS (SELECT vec_id AS id, embedding AS v, label FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.id AS query, q.label AS want, e.vec_id AS id, e.label, list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM q JOIN embeddings e ON e.vec_id <> q.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s), k AS (SELECT unnest([1, 3, 5, 10]) AS k), h AS (SELECT k, query, max(CASE WHEN label = want AND rank <= k THEN 1.0 ELSE 0 END) AS hit FROM r, k WHERE rank <= 10 GROUP BY ALL)
    SELECT k, round(avg(hit), 9) AS recall FROM h GROUP BY k"""
)
def k_sweep(spark, sf_dir):
    """AG23 WN9: recall of one retrieval at several depths."""
    rows = _passages(spark, sf_dir)
    best = retrieval.top_k_for(rows.filter("id % 50 = 0"), rows, 10, "embedding", "id")
    own = rows.select(F.col("id").alias("query"), F.col("label").alias("want"))
    named = best.join(own, "query").join(rows.select("id", "label"), "id")
    each = named.select("query", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)])).alias("k"), (F.col("label") == F.col("want")).alias("same"), "rank")
    hit = each.groupBy("k", "query").agg(F.max((F.col("same") & (F.col("rank") <= F.col("k"))).cast("double")).alias("hit"))
    return hit.groupBy("k").agg(F.round(F.avg("hit"), 9).alias("recall"))


@query(
    """WITH c AS (SELECT label, count(*) AS good FROM embeddings GROUP BY 1), t AS (SELECT count(*) AS m FROM embeddings)
    SELECT label, round(1 - greatest((m - good) / m, 0) * greatest((m - good - 1) / (m - 1), 0) * greatest((m - good - 2) / (m - 2), 0), 9) AS chance FROM c, t"""
)
def chance_recall(spark, sf_dir):
    """AG23: the chance that three drawn at random hold a good one."""
    rows = _table(spark, sf_dir, "embeddings")
    counts = rows.groupBy("label").agg(F.count("*").alias("good")).join(F.broadcast(rows.agg(F.count("*").alias("m"))))
    return counts.select("label", F.round(evalstats.chance_of_a_hit(F.col("m"), F.col("m") - F.col("good"), 3), 9).alias("chance"))


@query(
    """WITH s AS (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END) AS o, avg(quality) AS a, avg(toxic) AS b FROM labels)
    SELECT n, round(o, 9) AS agreement, round((o - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 9) AS kappa FROM s"""
)
def kappa(spark, sf_dir):
    """AG25: agreement of two raters beyond chance."""
    out = evalstats.kappa(_table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return out.withColumns({"agreement": F.round("agreement", 9), "kappa": F.round("kappa", 9)})


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('0' || CAST(doc_id AS VARCHAR))) AS k, count(*) OVER (PARTITION BY quality, toxic) AS n FROM labels)
    SELECT doc_id, quality, toxic FROM r WHERE k <= greatest(1, (n + 4) // 5)"""
)
def strata_sample(spark, sf_dir):
    """GEN5: a fifth of each stratum, by hash; the sample is what the operator is for."""
    return evalstats.stratified_sample(_table(spark, sf_dir, "labels"), ["quality", "toxic"], F.col("doc_id"))


_PROBE = [((7 * i) % 13 - 6) / 6 for i in range(64)]
_TOP = "SELECT id, label, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 10"


def _searched(spark, sf_dir, where=None):
    found = retrieval.top_k(_passages(spark, sf_dir), _PROBE, 10, "embedding", where)
    return found.select("id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH s AS (SELECT vec_id AS id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_PROBE} AS DOUBLE[])) AS score FROM embeddings) {_TOP}")
def cosine_topk(spark, sf_dir):
    """TK1: the ten passages most like a query."""
    return _searched(spark, sf_dir)


@query(f"WITH s AS (SELECT vec_id AS id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_PROBE} AS DOUBLE[])) AS score FROM embeddings WHERE label < 7 AND label <> 0) {_TOP}")
def cosine_topk_guarded(spark, sf_dir):
    """TK1 FIL10: the same among passages known before a moment, the case's own left out."""
    rows = _passages(spark, sf_dir).withColumns({"first_seen_ts": F.col("label"), "incident_id": F.col("label").cast("string")})
    found = retrieval.top_k(rows, _PROBE, 10, "embedding", retrieval.guards(seen_before=7, exclude="0"))
    return found.select("id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


#: A text's words with the blanks behind them, and a mark behind each that ends a sentence before another.
_MARKED = r"""array_to_string(list_transform(range(1, len(w) + 1), lambda i: w[i] || CASE WHEN {ends} THEN chr(1) ELSE '' END), '')"""
_ENDS_PLAIN = r"regexp_matches(w[i], '[.!?]\s+$') AND regexp_matches(w[i + 1], '^[A-Z0-9]')"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_CHUNKS = f"""RECURSIVE p AS (SELECT doc_id, unnest(range(len(x))) AS pno, {_STRIP.format("unnest(x)")} AS p FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS x FROM documents)),
    w AS (SELECT doc_id, pno, regexp_extract_all(p, '\\S+\\s*') AS w FROM p WHERE len(p) > 1000),
    s AS (SELECT doc_id, pno, list_transform(string_split({_MARKED.format(ends=_ENDS_PLAIN)}, chr(1)), lambda x: regexp_replace(x, '\\s+$', '')) AS s FROM w),
    f(doc_id, pno, i, now, done) AS (SELECT doc_id, pno, 1, s[1], CAST(NULL AS VARCHAR) FROM s UNION ALL
        SELECT f.doc_id, f.pno, i + 1, CASE WHEN i >= len(s) THEN NULL WHEN len(now) + 1 + len(s[i + 1]) > 1000 THEN s[i + 1] ELSE now || ' ' || s[i + 1] END, CASE WHEN i >= len(s) OR len(now) + 1 + len(s[i + 1]) > 1000 THEN now END
        FROM f JOIN s ON f.doc_id = s.doc_id AND f.pno = s.pno WHERE i <= len(s) AND now IS NOT NULL),
    runs AS (SELECT doc_id, pno, i, {_STRIP.format("done")} AS r FROM f WHERE done IS NOT NULL),
    u AS (SELECT doc_id, pno, 0 AS i, 0 AS k, p AS unit FROM p WHERE p <> '' AND len(p) <= 1000 UNION ALL SELECT doc_id, pno, i, unnest(range(0, len(r), 1000)) AS k, substr(r, unnest(range(0, len(r), 1000)) + 1, 1000) FROM runs),
    units AS (SELECT doc_id, unit, row_number() OVER (PARTITION BY doc_id ORDER BY pno, i, k) AS n FROM u),
    g(doc_id, n, now, done) AS (SELECT doc_id, 1, unit, CAST(NULL AS VARCHAR) FROM units WHERE n = 1 UNION ALL
        SELECT g.doc_id, g.n + 1, CASE WHEN unit IS NULL THEN NULL WHEN len(now) + 2 + len(unit) > 1000 THEN {_STRIP.format("right(now, 150) || chr(10) || chr(10) || unit")} ELSE {_STRIP.format("now || chr(10) || chr(10) || unit")} END,
            CASE WHEN unit IS NULL OR len(now) + 2 + len(unit) > 1000 THEN now END
        FROM g LEFT JOIN units ON g.doc_id = units.doc_id AND units.n = g.n + 1 WHERE now IS NOT NULL),
    chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_no, done AS chunk FROM g WHERE done IS NOT NULL)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(len(chunk) AS INTEGER) AS n_chars, md5(chunk) AS chunk_md5 FROM chunks")
def chunk_documents(spark, sf_dir):
    """GEN1 GEN2 GEN3: passages of whole documents."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.chunk(rows).select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query()
def embed_chunks(spark, sf_dir):
    """RT1: vectors of passages by the embedder that needs no model."""
    rows = retrieval.chunk(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = retrieval.embed(rows, "chunk")
    return out.select("doc_id", "chunk_no", F.round(retrieval.dot(F.col("vector"), F.col("vector")), 4).alias("norm"), F.size("vector").alias("width"))


_ENDS_SAID = r"""regexp_matches(rtrim(w[i]), '[.!?][)\]"'']?$') AND regexp_matches(w[i + 1], '^[A-Z0-9"''(\[]') AND regexp_extract(rtrim(w[i]), '[A-Za-z.]+$') NOT IN ('e.g.', 'i.e.', 'St.', 'Mt.', 'vs.', 'approx.', 'Approx.')"""
_STATEMENTS = rf"""lines AS (SELECT conv_id, turn, unnest(range(len(x))) AS l, trim(unnest(x)) AS line FROM (SELECT conv_id, turn, regexp_split_to_array(text, '\r\n|\n|\r') AS x FROM conversations)),
    w AS (SELECT conv_id, turn, l, regexp_extract_all(line, '\S+\s*') AS w FROM lines),
    s AS (SELECT conv_id, turn, l, unnest(range(len(x))) AS k, trim(unnest(x)) AS statement FROM (SELECT conv_id, turn, l, string_split({_MARKED.format(ends=_ENDS_SAID)}, chr(1)) AS x FROM w)),
    said AS (SELECT conv_id, turn, conv_id || '#' || turn || '#' || (row_number() OVER (PARTITION BY conv_id, turn ORDER BY l, k) - 1) AS statement_id, statement FROM s WHERE statement <> '')"""


@query(f"WITH {_STATEMENTS} SELECT statement_id, statement FROM said")
def split_statements(spark, sf_dir):
    """SC18 GEN6: sentences of answers, numbered."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text_functions.statements(F.col("text"))).alias("i", "statement"))
    return rows.select(F.concat_ws("#", "conv_id", "turn", "i").alias("statement_id"), "statement")


@query(r"SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '\b[0-9a-f]{8}\b'))) AS INTEGER) AS n_ids, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '\b[0-9a-f]{8}\b'))), ',') AS ids FROM pages")
def cited_ids(spark, sf_dir):
    """SC19: ids that a text cites."""
    ids = text_functions.cited_ids(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.size(ids).alias("n_ids"), F.array_join(F.array_sort(ids), ",").alias("ids"))


@query("SELECT doc_id, md5(CASE WHEN n_chars > 1000 THEN source ELSE text END) AS picked_md5 FROM documents")
def translation_pick(spark, sf_dir):
    """FLT5: the text in a language, else one without a variant, else the first."""
    tag = F.concat("lang", F.when(F.col("n_chars") > 1000, "/x").otherwise(""))
    texts = F.array(F.struct(F.lit("en/us").alias("language"), F.col("source").alias("text")), F.struct(tag.alias("language"), F.col("text").alias("text")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text_functions.translation(texts).cast("binary")).alias("picked_md5"))


@query(
    """WITH l AS (SELECT substr(sha256(line), 1, 3) AS g, line FROM (SELECT CAST(doc_id AS VARCHAR) || ':' || sha256(text) AS line FROM documents)), d AS (SELECT g, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM l GROUP BY g)
    SELECT sha256(string_agg(d, chr(10) ORDER BY d)) AS hash FROM d"""
)
def corpus_hash(spark, sf_dir):
    """SC16: a digest of the corpus that does not depend on order."""
    return text_functions.corpus_hash(_table(spark, sf_dir, "documents"), "doc_id", "text")


_AT = "2024-01-15 12:00:00"


@query(
    f"""WITH l AS (SELECT event_type AS line, user_id, strftime(ts, '%Y-%m-%d') AS sd, arg_max(value, (ts, event_id)) AS d FROM events WHERE ts >= TIMESTAMP '{_AT}' - INTERVAL 1 DAY AND ts < TIMESTAMP '{_AT}' GROUP BY ALL)
    SELECT line, count(*) AS n_services, count(*) FILTER (d > 100) AS n_late, max(d) AS max_delay_s FROM l GROUP BY line"""
)
def situation(spark, sf_dir):
    """AG28 FIL11 RT4: a line at a moment, from what was known before it."""
    return tools.situation(_events(spark, sf_dir), F.lit(_AT).cast("timestamp"), RULE.late_s, 86_400)


@query(
    f"""SELECT event_type AS line, strftime(ts, '%Y-%m-%d') AS service_date, CAST(user_id AS VARCHAR) AS trip_id, arg_max(value, (ts, event_id)) AS delay_s, arg_max(event_id, (ts, event_id)) AS event_id
    FROM events WHERE ts >= TIMESTAMP '{_AT}' - INTERVAL 6 HOURS AND ts < TIMESTAMP '{_AT}' GROUP BY event_type, strftime(ts, '%Y-%m-%d'), user_id"""
)
def running(spark, sf_dir):
    """RT7: services seen lately."""
    return tools.running(_events(spark, sf_dir), F.lit(_AT).cast("timestamp"), 6 * 3600).select("line", "service_date", "trip_id", "delay_s", "event_id")


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS stop FROM lineitem GROUP BY ALL)
    SELECT l_orderkey AS trip_id, l_linenumber AS stop_sequence, stop AS stop_id, lead(stop) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS next_stop_id FROM c"""
)
def next_call(spark, sf_dir):
    """JN20 WN10: each call with the one that follows."""
    calls = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence")).agg(F.min("l_partkey").alias("stop_id")).withColumn("scheduled_arrival_s", F.lit(0))
    return tools.next_calls(calls).select("trip_id", "stop_sequence", "stop_id", "next_stop_id")


@query("SELECT event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-20' AND ts < TIMESTAMP '2024-01-20 16:00:00' GROUP BY 1")
def freeze_asof(spark, sf_dir):
    """TMP7 SNK11: what a store held at the end of a service day in Sydney."""
    from headway.functions.time import cutoff

    rows = _events(spark, sf_dir)
    frozen = merge.freeze(rows, "2024-01-20", cutoff(F.lit("2024-01-20")), date_col="service_date", seen="observed_at")
    return frozen.groupBy(F.col("line").alias("event_type")).agg(F.count("*").alias("n"), _stamp(F.max("observed_at")).alias("last_seen"))


@query(
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), q AS (SELECT d + t AS asked_at, line FROM d, (SELECT unnest([TIME '08:30:00', TIME '17:30:00']) AS t), (SELECT unnest(['T1', 'T4']) AS line))
    SELECT strftime(asked_at, '%Y-%m-%d %H:%M:%S') AS asked_at, line, CAST((row_number() OVER (ORDER BY asked_at, line) - 1) % 3 AS INTEGER) AS template FROM q"""
)
def question_set(spark, sf_dir):
    """GEN4 WN8: questions at both peaks of each date, templates in turn."""
    dates = _table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()
    return tools.question_set(dates, ["T1", "T4"]).select(_stamp("at").alias("asked_at"), "line", F.col("template").cast("int").alias("template"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(DISTINCT ts) AS observation_count FROM events GROUP BY user_id")
def stream_replay(spark, sf_dir):
    """TMP1 TMP3 TMP5: the events collected as a stream into a keyed table, and the table read."""
    folder = work_folder(spark, "stream")
    rows = collect.snapshots(spark, f"{sf_dir}/events.parquet", _table(spark, sf_dir, "events").schema).select("user_id", "ts", "value", "event_id")
    table = collect.VersionedTable(spark, f"{folder}/table")
    collect.collect(rows, table, ["user_id"], "ts", f"{folder}/checkpoint", ["event_id"]).awaitTermination()
    return table.read().select("user_id", "value", _stamp("first_seen_utc").alias("first_seen"), _stamp("last_seen_utc").alias("last_seen"), "observation_count")


_NUMBERS = tuple(c for c in DETECTION_FEATURES if c != "line")


def _detection(spark, sf_dir) -> DataFrame:
    """Windows with all the features of the contract; errors stand in for alert polls, purchases for alerts."""
    rows = _events(spark, sf_dir)
    polls = rows.filter("line = 'error'").select(F.col("observed_at").alias("poll_time"))
    seen = rows.filter("line = 'purchase' AND delay_s > 60").select(F.explode(F.array(*[F.lit(t) for t in _TYPES])).alias("line"), F.col("observed_at").alias("first_seen"), (F.col("observed_at") + F.expr("INTERVAL 2 HOURS")).alias("last_seen"), "delay_s")
    seen = seen.filter((F.col("delay_s") % 5).cast("int") == F.length("line") % 5)
    flagged = labels.alert_in_feed(_labels(spark, sf_dir).drop("target"), polls, seen, WINDOW_S)
    table = labels.detection_table(flagged, history=3)
    table = reconcile.with_split(table.withColumn("date", F.date_format("window_start", "yyyy-MM-dd")), "date")
    return features(table, DETECTION_FEATURES, DETECTION_FORBIDDEN, keep=("window_start", "split", "target"))


def _detector(kind: str, spark, sf_dir) -> DataFrame:
    rows = _cut(_detection(spark, sf_dir))
    fitted = models.fit_detector(kind, rows.filter("split = 'train'"), rows.filter("split = 'validation'"), _NUMBERS, lone=True)
    return fitted.score(rows).select("line", _stamp("window_start").alias("window_start"), "split", F.round("score", 6).alias("score"), "flag", "target")


@query()
def forest_detect(spark, sf_dir):
    """ML3 ML4: a forest chosen on validation rows, its scores and flags."""
    return _detector("forest", spark, sf_dir)


@query()
def logit_detect(spark, sf_dir):
    """ML3 ML4 ML5: logistic regression on imputed, scaled features."""
    return _detector("logistic", spark, sf_dir)


@query()
def boosted_detect(spark, sf_dir):
    """ML3 ML4: boosted trees."""
    return _detector("boosted", spark, sf_dir)


@query()
def gbt_delay(spark, sf_dir):
    """ML1 ML6 ML8: boosted trees on the absolute error, on calls of trips."""
    rows = _calls(spark, sf_dir).join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("month")), "l_orderkey")
    rows = _cut(reconcile.with_split(rows, "month"))
    numbers = ("guess", "l_linenumber")
    model = models.fit_delay(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), numbers, ("l_returnflag",), label="truth")
    out = model.transform(models.prepared(rows.filter("split = 'test'"), numbers))
    return evalstats.regression_scores(out, "truth", "prediction", "guess")


@query("SELECT event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1")
def store_status(spark, sf_dir):
    """AG9: what a store holds."""
    out = reports.store_status(_table(spark, sf_dir, "events"), "ts", "event_type")
    return out.withColumns({c: _stamp(c) for c in ("first_seen", "last_seen")})


@query("SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_polls(spark, sf_dir):
    """TK4: the last rows, which is what the report is."""
    return reports.recent(_table(spark, sf_dir, "events"), "ts", 20, ["event_id"]).select("event_id", "event_type", _stamp("ts").alias("seen"))


@query("SELECT toxic, count(*) AS statements, count(*) FILTER (quality IS NULL) AS failed, round(avg(quality), 9) AS faithful FROM labels GROUP BY toxic")
def faithfulness(spark, sf_dir):
    """AG26: rates among those with a verdict."""
    rows = _table(spark, sf_dir, "labels").withColumn("supported", F.col("quality") == 1)
    return reports.faithfulness(rows, by=["toxic"]).withColumn("faithful", F.round("faithful", 9))


@query("SELECT g AS lang, count(d.lang) AS n FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'it']) AS g) LEFT JOIN documents d ON d.lang = g GROUP BY g")
def group_counts(spark, sf_dir):
    """AG30: rows of every group, those without any included."""
    return reports.group_counts(_table(spark, sf_dir, "documents"), "lang", ("en", "fr", "de", "es", "it"))


@query(
    f"""WITH {_LABELS}, n AS (SELECT line, w, CAST(ceil(CAST(0.25 AS DOUBLE) * n_services - CAST(1e-9 AS DOUBLE)) AS BIGINT) - n_late AS gap FROM verdicts WHERE NOT disrupted)
    SELECT line, strftime(arg_min(w, (gap, w)), '%Y-%m-%d %H:%M:%S') AS window_start, min(gap) AS gap FROM n GROUP BY line"""
)
def nearest_to_firing(spark, sf_dir):
    """API9: the window of each line that came nearest to being disrupted."""
    out = reports.nearest_to_firing(_labels(spark, sf_dir), labels.late_needed(F.col("n_services"), RULE.share))
    return out.withColumn("window_start", _stamp("window_start"))


@query(
    f"""WITH {_LABELS}, d AS (SELECT DISTINCT CAST(w AS DATE) AS day FROM targets), r AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS c FROM d),
    s AS (SELECT day, CASE WHEN k <= greatest(1, round_even(c * CAST(0.7 AS DOUBLE), 0)) THEN 'train' WHEN k <= greatest(1, round_even(c * CAST(0.7 AS DOUBLE), 0), round_even(c * CAST(0.85 AS DOUBLE), 0)) THEN 'validation' ELSE 'test' END AS split FROM r)
    SELECT split, count(*) AS rows, count(target) AS known, count(*) FILTER (target) AS positive FROM targets JOIN s ON CAST(w AS DATE) = day GROUP BY split"""
)
def split_report(spark, sf_dir):
    """API10: rows, known and positive targets of each part."""
    rows = reconcile.with_split(_labels(spark, sf_dir).withColumn("date", F.to_date("window_start")), "date")
    return reports.split_report(rows)


@query(f"WITH {_CHUNKS}, l AS (SELECT doc_id, list_sort(list(len(chunk))) AS l FROM chunks GROUP BY 1) SELECT doc_id, len(l) AS passages, CAST(l[1] AS INTEGER) AS least, CAST(l[len(l) // 2 + 1] AS INTEGER) AS median, CAST(l[-1] AS INTEGER) AS most FROM l")
def passage_summary(spark, sf_dir):
    """AG29: passages of each document."""
    return reports.passage_summary(chunk_documents(spark, sf_dir), "doc_id")
