"""Queries of sources and sinks: files and tables written to the shared folder and read back."""

from __future__ import annotations

import os
import sqlite3
import zipfile

from pyspark.sql import functions as F

from headway.operators import alerts, evalstats, merge, reconcile, reports, retrieval
from headway.plans.catalogue import _HALVES, _STATEMENTS, _events, _stamp, _table, query
from headway.session import work_folder
from headway.sources import corpus, feed, store
from headway.streaming import collect


def _files(spark, name: str) -> str:
    """A new folder for files that no Spark writer makes; the shared folder must be a mounted one."""
    folder = work_folder(spark, name).removeprefix("file://").removeprefix("file:")
    os.makedirs(folder)
    return folder


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def sqlite_scan(spark, sf_dir):
    """SRC2: rows of a legacy database file, in ranges of row ids."""
    path = f"{_files(spark, 'sqlite')}/store.db"
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE customer (c_custkey INTEGER, c_name TEXT, c_acctbal REAL)")
        db.executemany("INSERT INTO customer VALUES (?, ?, ?)", (tuple(r) for r in rows.toLocalIterator()))
    return store.read_sqlite(spark, path, "customer")


@query("SELECT event_id, event_type AS line, coalesce(CASE WHEN event_id % 3 > 0 THEN CAST(floor(value) AS INTEGER) END, CASE WHEN event_id % 5 > 0 THEN CAST(floor(value) AS INTEGER) + 1 END) AS delay_s FROM events WHERE event_type IN ('click', 'view')")
def stop_events_by_line(spark, sf_dir):
    """SRC3 FIL13: observations of some lines, the arrival's delay or else the departure's."""
    whole = F.floor("value").cast("int")
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("route_short_name"), F.when(F.col("event_id") % 3 > 0, whole).alias("arrival_delay_s"), F.when(F.col("event_id") % 5 > 0, whole + 1).alias("departure_delay_s"))
    return store.stop_events(rows, ["click", "view"]).select("event_id", F.col("route_short_name").alias("line"), "delay_s")


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS poll_time FROM events WHERE event_type <> 'error'")
def alert_polls(spark, sf_dir):
    """SRC4: times of the polls that went well."""
    log = _table(spark, sf_dir, "events").select(F.col("ts").alias("poll_time_utc"), F.when(F.col("event_type") == "error", "error: timeout").otherwise("ok").alias("status"))
    return store.ok_polls(log).select(F.date_format("poll_time_utc", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("poll_time"))


@query("SELECT o_orderkey AS trip_id, o_orderpriority AS line FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND (o_orderstatus = 'P' OR o_orderkey % 3 = 0)")
def trip_status_scan(spark, sf_dir):
    """SRC5: trips of some lines that are cancelled or skip stops."""
    skips = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("s1"))).otherwise(F.array().cast("array<string>"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_orderpriority").alias("route_short_name"), F.when(F.col("o_orderstatus") == "P", "CANCELED").otherwise("SCHEDULED").alias("trip_relationship"), skips.alias("skipped_stop_ids"))
    return store.tracked_statuses(rows, ["1-URGENT", "3-MEDIUM"]).select("trip_id", F.col("route_short_name").alias("line"))


@query(
    """WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'purchase', 'view') AND value > 60)
    SELECT CAST(user_id AS VARCHAR) AS alert_id, CASE WHEN user_id % 2 = 0 THEN 'UNKNOWN_CAUSE' ELSE 'WEATHER' END AS cause, string_agg(event_type, ',' ORDER BY event_type) AS lines FROM s GROUP BY user_id"""
)
def alerts_with_lines(spark, sf_dir):
    """SRC6 JN22: alerts with the sorted lines of their scopes; those of none are left out."""
    rows = _table(spark, sf_dir, "events")
    own = rows.select(F.col("user_id").cast("string").alias("alert_id"), F.when(F.col("user_id") % 2 == 1, "WEATHER").alias("cause")).distinct()
    scopes = rows.filter("value > 60").select(F.col("user_id").cast("string").alias("alert_id"), F.col("event_type").alias("route_short_name"))
    return alerts.with_lines(own, scopes, ["click", "purchase", "view"]).select("alert_id", "cause", F.array_join("lines", ",").alias("lines"))


@query("SELECT event_id, user_id, value, CAST(CASE WHEN user_id % 4 > 0 THEN user_id % 10 END AS INTEGER) AS stop_sequence FROM events")
def snapshot_scan(spark, sf_dir):
    """SRC7 SNK5 SET1 SET2: CSV snapshots of each day read as one table, after the rows of the store."""
    folder = work_folder(spark, "snapshots")
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 10).otherwise(-1).cast("int").alias("stop_sequence"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    store.write_partitioned(rows.filter("event_type <> 'error'").drop("event_type"), folder, ["day"], kind="csv")
    stored = rows.filter("event_type = 'error'").drop("event_type", "day").withColumn("stop_sequence", F.nullif("stop_sequence", F.lit(-1)))
    return stored.unionByName(store.read_snapshots(spark, folder, "event_id long, user_id long, value double, stop_sequence int"), allowMissingColumns=True)


@query("SELECT CAST(c_nationkey AS VARCHAR) AS trip_id, CAST(c_custkey AS VARCHAR) AS stop_id, file_row, CAST(c_custkey % 40 AS INTEGER) AS stop_sequence, CAST(25 * 3600 + 600 AS INTEGER) AS scheduled_arrival_s FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS file_row FROM customer) WHERE c_nationkey % 2 = 0 AND c_custkey % 40 > 0")
def timetable_scan(spark, sf_dir):
    """SRC8 JN4: calls of wanted trips from a zipped timetable, rows without a sequence left out."""
    folder = _files(spark, "timetable")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").orderBy("c_custkey")
    with zipfile.ZipFile(f"{folder}/gtfs_20240101.zip", "w") as z, z.open("feed/stop_times.txt", "w") as f:
        f.write("﻿trip_id,arrival_time,departure_time,stop_id,stop_sequence\r\n".encode())
        for r in rows.toLocalIterator():
            f.write(f"{r['c_nationkey']},25:10:00,25:11:00,{r['c_custkey']},{r['c_custkey'] % 40 or ''}\r\n".encode())
    times = store.timetable(spark, f"{folder}/*.zip")["stop_times"].withColumn("bundle_rank", F.lit(0))
    wanted = _table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("trip_id"))
    return reconcile.merged_timetable(times, wanted).select("trip_id", "stop_id", "file_row", "stop_sequence", "scheduled_arrival_s")


@query("SELECT c_custkey, CASE WHEN n_nationkey < 20 THEN n_name END AS route_short_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def route_lookup(spark, sf_dir):
    """SRC9 SRC10 SNK9 JN1: a lookup kept as CSV, and rows with their route's name where it is known."""
    folder = work_folder(spark, "routes")
    store.write_route_lookup(_table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("n"), "n_nationkey").alias("route_id"), F.col("n_name").alias("route_short_name")), folder)
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("route_id"))
    return feed.with_routes(rows, store.read_route_lookup(spark, folder)).select("c_custkey", "route_short_name")


@query("SELECT strftime(ts, '%Y-%m-%d') AS service_date, event_type AS line, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def table_write(spark, sf_dir):
    """SNK7 SRC12: a table in a folder for each date, and the table read."""
    folder = work_folder(spark, "table")
    store.write_partitioned(_events(spark, sf_dir).select("service_date", "line", "delay_s"), folder, ["service_date"])
    rows = spark.read.schema("line string, delay_s double, service_date string").parquet(folder)
    return rows.groupBy("service_date", "line").agg(F.count("*").alias("n"), F.round(F.sum("delay_s"), 4).alias("total"))


_TRAINING = """o AS (SELECT strftime(ts, '%Y-%m-%d') AS service_date, CAST(user_id AS VARCHAR) AS trip_id, event_type AS stop_id, arg_max(CASE WHEN event_id % 3 > 0 THEN CAST(floor(value) AS INTEGER) END, ts) AS a, 0 AS x,
        arg_max(event_id, ts) AS last_id, arg_max(CAST(floor(value) AS INTEGER), ts) AS v, max(ts) AS ts, count(*) AS observation_count FROM events GROUP BY ALL),
    t AS (SELECT *, coalesce(CASE WHEN last_id % 3 > 0 THEN v END, CASE WHEN last_id % 5 > 0 THEN v + 1 END) AS delay_s, CASE WHEN stop_id IN ('click', 'view') AND CAST(trip_id AS BIGINT) < 75 THEN CASE stop_id WHEN 'click' THEN 1 ELSE 2 END END AS stop_sequence FROM o),
    training AS (SELECT *, lag(delay_s) OVER (PARTITION BY service_date, trip_id ORDER BY coalesce(stop_sequence, 1000000000), ts, stop_id) AS prev_stop_delay_s,
        hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Australia/Sydney') AS hour_local, stop_sequence IS NOT NULL AS schedule_matched FROM t WHERE delay_s IS NOT NULL)"""


def _training(spark, sf_dir):
    """Events as observations of stops (a stop is a type), half of the trips with two calls in the timetable."""
    whole = F.floor("value").cast("int")
    rows = _table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("service_date"), F.col("user_id").cast("string").alias("trip_id"), F.col("event_type").alias("stop_id"), F.lit("r").alias("route_id"), F.lit("T1").alias("route_short_name"),
        F.lit(None).cast("int").alias("stop_sequence"), F.lit(0).alias("stops_ahead"), F.when(F.col("event_id") % 3 > 0, whole).alias("arrival_delay_s"), F.when(F.col("event_id") % 5 > 0, whole + 1).alias("departure_delay_s"),
        F.col("ts").cast("timestamp").alias("observed_at_utc"), F.lit(1).alias("observation_count"),
    )
    trips = _table(spark, sf_dir, "events").filter("user_id < 75").select(F.col("user_id").cast("string").alias("trip_id")).distinct()
    calls = trips.select("trip_id", F.explode(F.array(*[F.struct(F.lit(s).alias("stop_id"), F.lit(i).alias("stop_sequence"), F.lit(3600 * i).alias("scheduled_arrival_s")) for i, s in ((1, "click"), (2, "view"))])).alias("c")).select("trip_id", "c.*")
    return reconcile.reconcile(rows, calls)


@query(f"WITH {_TRAINING} SELECT service_date, trip_id, stop_id, CAST(stop_sequence AS INTEGER) AS stop_sequence, CAST(stop_sequence * 3600 AS INTEGER) AS scheduled_arrival_s, delay_s, prev_stop_delay_s, observation_count, CAST(hour_local AS INTEGER) AS hour_local, schedule_matched FROM training")
def training_table(spark, sf_dir):
    """FIL12 FIL13: the training table in its order of columns, shown without what is constant."""
    out = _training(spark, sf_dir)
    return out.select("service_date", "trip_id", "stop_id", "stop_sequence", "scheduled_arrival_s", "delay_s", "prev_stop_delay_s", "observation_count", "hour_local", "schedule_matched")


@query(
    """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'MAINTENANCE' ELSE 'WEATHER' END AS cause, doc_id % 10 * 4 AS hours FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS alert_id, CASE WHEN doc_id % 7 = 0 THEN doc_id % 2 = 0 ELSE false END AS is_incident,
        CASE WHEN doc_id % 7 = 0 THEN 'override: looked at, twice' WHEN cause = 'MAINTENANCE' THEN 'planned maintenance' WHEN hours > 24 THEN 'standing notice (' || hours || ' h in the feed)' ELSE 'no effect on train running stated' END AS reason FROM a"""
)
def overrides_scan(spark, sf_dir):
    """SRC13 API4 API12: the audit of alerts, with overrides from a checked CSV."""
    folder = work_folder(spark, "overrides")
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    said = docs.filter("doc_id % 7 = 0").select(F.col("doc_id").cast("string").alias("alert_id"), (F.col("doc_id") % 2 == 0).alias("is_incident"), F.lit("looked at, twice").alias("reason"))
    said.write.option("header", True).csv(folder)
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = docs.select(F.col("doc_id").cast("string").alias("alert_id"), F.when(F.col("doc_id") % 9 == 0, "MAINTENANCE").otherwise("WEATHER").alias("cause"), F.lit("a notice").alias("header_text"), F.lit("").alias("description_text"), first.alias("first_seen"), F.timestamp_seconds(F.unix_seconds(first) + F.col("doc_id") % 10 * 4 * 3600).alias("last_seen"))
    return alerts.audited(rows, store.read_checked(spark, folder, "alert_id string, is_incident boolean, reason string")).select("alert_id", "is_incident", "reason")


@query("SELECT CAST(doc_id AS VARCHAR) AS alert_id FROM documents WHERE doc_id % 7 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def unknown_overrides(spark, sf_dir):
    """SET6 API12: overrides that name no alert."""
    said = _table(spark, sf_dir, "documents").filter("doc_id % 7 = 0").select(F.col("doc_id").cast("string").alias("alert_id"))
    return reports.unknown_overrides(said, _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("alert_id")))


@query(
    """WITH s AS (SELECT count(*) AS n, avg(CASE WHEN (quality = 1) = (toxic = 0) THEN 1.0 ELSE 0 END) AS o, avg(quality) AS a, avg(1 - toxic) AS b FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1))
    SELECT n, round(o, 9) AS agreement, round((o - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 9) AS kappa FROM s"""
)
def filled_sheet(spark, sf_dir):
    """SRC16 SNK8 SNK14 JN23 API16: a blind sheet written, filled in, read, and paired with a judge's verdicts."""
    folder = work_folder(spark, "sheet")
    rows = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    said = rows.select(F.col("doc_id").cast("string").alias("statement_id"), F.lit("s").alias("system"), F.concat(F.lit('said "'), "doc_id", F.lit('", twice')).alias("statement"), F.lit("e").alias("evidence"), (F.col("toxic") == 0).alias("supported"))
    store.write_blind_sheet(said, f"{folder}/blind")
    blank = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/blind").drop("human_supported")
    truth = rows.select(F.col("doc_id").cast("string").alias("statement_id"), F.when(F.col("quality") == 1, "yes").otherwise("No ").alias("human_supported"))
    blank.join(truth, "statement_id").write.option("header", True).option("escape", '"').csv(f"{folder}/filled")
    both = evalstats.paired(store.read_sheet(spark, f"{folder}/filled"), said)
    out = evalstats.kappa(both, F.col("human_supported"), F.col("supported"))
    return out.withColumns({"agreement": F.round("agreement", 9), "kappa": F.round("kappa", 9)})


@query("SELECT DISTINCT sha256(substr(r_name, 1, 1)) AS sha256, CAST(1 AS BIGINT) AS length FROM region WHERE substr(r_name, 1, 1) <> 'E'")
def bundle_discovery(spark, sf_dir):
    """SRC17 SNK15 SC25: files of each content once, without those that are kept already."""
    folder = _files(spark, "bundles")
    for r in _table(spark, sf_dir, "region").toLocalIterator():
        with open(f"{folder}/{r['r_regionkey']}.zip", "w") as f:
            f.write(r["r_name"][:1])
    kept = spark.createDataFrame([("E",)], "x string").select(F.sha2(F.col("x").cast("binary"), 256).alias("sha256"))
    return store.new_bundles(store.distinct_bundles(spark, f"{folder}/*.zip"), kept).select("sha256", "length")


@query("SELECT 'k' || n_nationkey AS document_key, n_name AS content FROM nation")
def pinned_documents(spark, sf_dir):
    """SRC18: files whose digests are the pinned ones."""
    folder = _files(spark, "pinned")
    rows = _table(spark, sf_dir, "nation")
    for r in rows.toLocalIterator():
        with open(f"{folder}/{r['n_nationkey']}.txt", "w") as f:
            f.write(r["n_name"])
    pins = rows.select(F.concat(F.lit("k"), "n_nationkey").alias("document_key"), F.concat("n_nationkey", F.lit(".txt")).alias("file"), F.sha2(F.col("n_name").cast("binary"), 256).alias("sha256"))
    return corpus.pinned(spark, f"{folder}/*.txt", pins).select("document_key", F.col("content").cast("string").alias("content"))


@query("SELECT event_id AS poll, event_id % 15 = 0 AS alerts FROM events")
def alert_schedule(spark, sf_dir):
    """SRC19 TMP4: which polls are of alerts too, by the settings."""
    from headway.config import settings

    own = settings(environ={"HEADWAY_ALERTS_EVERY": " 15 "})
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("poll"), collect.polls_alerts(F.col("event_id"), own.alerts_every).alias("alerts"))


@query(
    """WITH m AS (SELECT event_type, strftime(ts, '%Y-%m-%d %H') AS poll_time, count(*) AS entities_seen FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL)
    SELECT poll_time, entities_seen, event_type AS status FROM m WHERE event_type = 'click' UNION ALL SELECT poll_time, entities_seen, event_type FROM m WHERE event_type = 'view' AND poll_time NOT IN (SELECT poll_time FROM m WHERE event_type = 'click')"""
)
def poll_log(spark, sf_dir):
    """SNK4 SNK6: a log whose rows of a poll are replaced by those of its repetition."""
    rows = _table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("poll_time"), F.col("event_type").alias("status")).agg(F.count("*").alias("entities_seen"))
    return merge.replace_by_key(rows.filter("status = 'view'"), rows.filter("status = 'click'"), ["poll_time"]).select("poll_time", "entities_seen", "status")


@query(
    """WITH s AS (SELECT user_id, event_type, min(ts) AS first, max(ts) AS last, count(DISTINCT ts) AS n FROM events GROUP BY ALL), a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS cause, count(DISTINCT ts) AS n FROM events GROUP BY 1)
    SELECT user_id AS alert_id, event_type AS route_id, cause, strftime(first, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_seen, s.n AS scope_count, a.n AS alert_count FROM s JOIN a USING (user_id)"""
)
def alert_store(spark, sf_dir):
    """SNK2: alerts and their scopes, each upserted by their own key, of two batches."""
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("alert_id"), F.col("event_type").alias("cause"), F.col("event_type").alias("route_id"), "ts", "event_id")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    parts = rows.filter(F.col("ts") < half), rows.filter(F.col("ts") >= half)

    def upserted(keys, drop):
        one, two = (p.drop(*drop) for p in parts)
        return merge.guarded_upsert(merge.fold_batch(one, keys, "ts", ["event_id"]), two, keys, "ts", ["event_id"])

    own = upserted(["alert_id"], ["route_id"]).select("alert_id", "cause", F.col("observation_count").alias("alert_count"))
    scopes = upserted(["alert_id", "route_id"], ["cause"])
    return scopes.join(own, "alert_id").select("alert_id", "route_id", "cause", _stamp("first_seen_utc").alias("first_seen"), _stamp("last_seen_utc").alias("last_seen"), F.col("observation_count").alias("scope_count"), "alert_count")


@query(f"WITH {_STATEMENTS} SELECT statement_id, md5(statement) AS statement_md5, len(statement) % 2 = 0 AS supported FROM said WHERE turn % 2 = 1")
def judged_lines(spark, sf_dir):
    """SNK13 GEN6 RT12 SC27: statements of answers with a judge's verdicts, as JSON lines, read back."""
    folder = work_folder(spark, "judged")
    answers = _table(spark, sf_dir, "conversations").filter("turn % 2 = 1").select(F.concat_ws("#", "conv_id", "turn").alias("answer_id"), F.col("text").alias("answer"), F.lit("").alias("evidence"))
    store.write_json_lines(reports.judged(answers, lambda statement, evidence: len(statement) % 2 == 0), f"{folder}/judged")
    rows = spark.read.schema("statement_id string, statement string, supported boolean").json(f"{folder}/judged")
    return rows.select("statement_id", F.md5(F.col("statement").cast("binary")).alias("statement_md5"), "supported")


@query("SELECT label, count(*) AS n, 'width is 64, not 128' AS stale FROM embeddings GROUP BY label")
def index_build(spark, sf_dir):
    """SNK10 RT2 RT3 API13 API14: an index with its fingerprint, opened, and what would make it stale."""
    folder = work_folder(spark, "index")
    print_of = {"embedder": "given", "width": 64}
    retrieval.build_index(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"), folder, print_of)
    index = retrieval.open_index(spark, folder, print_of)
    stale = "; ".join(retrieval.stale_reasons(print_of, {"embedder": "given", "width": 128}))
    return index.groupBy("label").agg(F.count("*").alias("n")).withColumn("stale", F.lit(stale))


@query(
    f"""WITH s AS (SELECT user_id, arg_max(value, (ts, event_id)) AS value, min(ts) AS first, max(ts) AS last, count(DISTINCT ts) AS n FROM events WHERE {_HALVES[0]} GROUP BY user_id),
    b AS (SELECT * FROM events WHERE {_HALVES[1]}), f AS (SELECT b.user_id, arg_max(b.value, (b.ts, b.event_id)) AS value, min(b.ts) AS first, max(b.ts) AS last FROM b GROUP BY b.user_id)
    SELECT coalesce(s.user_id, f.user_id) AS user_id, CASE WHEN s.last IS NULL OR f.last > s.last THEN f.value ELSE s.value END AS value, strftime(greatest(s.last, f.last), '%Y-%m-%d %H:%M:%S') AS last_seen, 'ok,error: no feed,ok' AS log FROM s FULL JOIN f ON s.user_id = f.user_id"""
)
def polls_into_store(spark, sf_dir):
    """TMP2 SNK16 API6 API7: polls folded into a store, one of which fails; a copy of the store, and the log."""
    folder = work_folder(spark, "polls")
    rows = _table(spark, sf_dir, "events").select("user_id", "ts", "value", "event_id", "event_type")
    sink, told = collect.sink_for("parquet", spark, f"{folder}/store"), []

    def fails():
        raise OSError("no feed")

    reads = (lambda: rows.filter(_HALVES[0]).drop("event_type"), fails, lambda: rows.filter(_HALVES[1]).drop("event_type"))
    for n, read in enumerate(reads):
        collect.poll_once(read, sink, n, ["user_id"], "ts", lambda _, status: told.append(status), ["event_id"])
    sink.read().write.parquet(f"{folder}/copy")
    return spark.read.parquet(f"{folder}/copy").select("user_id", "value", _stamp("last_seen_utc").alias("last_seen"), F.lit(",".join(told)).alias("log"))
