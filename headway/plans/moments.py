"""Queries of what can be said at a moment, of labels and windows, of models, and of answers about causes."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions.text import GROUPS
from headway.functions.time import floor_to
from headway.operators import agent, artefacts, cases, delay, evalstats, labels, models, reasons, reconcile, reports, retrieval, temporal, tools
from headway.plans.catalogue import (
    _AT, _FEED, _LABELS, _NUMBERS, _PROBE, _TYPES, RULE, WINDOW_S, _cut, _detection, _events, _feed, _labels, _passages, _stamp, _table, query,
)
from headway.plans.stores import _TRAINING, _training
from headway.schemas import DELAY_FEATURES, DELAY_FORBIDDEN, features
from headway.session import work_folder
from headway.sources import feed

# Filters and projections.


@query(
    f"""WITH {_TRAINING}, p AS (SELECT * FROM training WHERE abs(delay_s) <= 200 AND (prev_stop_delay_s IS NULL OR abs(prev_stop_delay_s) <= 200))
    SELECT service_date, trip_id, stop_id, delay_s FROM p WHERE service_date IN (SELECT service_date FROM p GROUP BY 1 HAVING avg(CASE WHEN stop_sequence IS NOT NULL THEN 1.0 ELSE 0 END) >= 0.2) AND service_date IN (SELECT DISTINCT service_date FROM training ORDER BY 1 LIMIT 20)"""
)
def modelling_filters(spark, sf_dir):
    """FIL1 FIL2 FIL3 FIL7: reliable and plausible rows of covered dates, of the first twenty."""
    table = _training(spark, sf_dir)
    first = reconcile.first_dates(table, 20)
    rows = reconcile.plausible(first.filter(F.col("stops_ahead_final") <= delay.RELIABLE_STOPS_AHEAD), 200)
    return reconcile.schedule_covered(rows, least=0.2).select("service_date", "trip_id", "stop_id", "delay_s")


@query("SELECT event_id, event_type AS line, value AS delay_s FROM events WHERE user_id % 3 <= 1 AND value <= 7200")
def reliable_events(spark, sf_dir):
    """FIL4: events that labels are made of."""
    rows = _events(spark, sf_dir).withColumn("stops_ahead", (F.col("trip_id").cast("long") % 3).cast("int"))
    return labels.reliable(rows).select("event_id", "line", "delay_s")


@query(f"WITH {_LABELS} SELECT line, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, target FROM targets WHERE target IS NOT NULL")
def known_targets(spark, sf_dir):
    """FIL5: windows whose target is known."""
    return evalstats.known(_labels(spark, sf_dir)).select("line", _stamp("window_start").alias("window_start"), "target")


@query(f"WITH {_TRAINING} SELECT service_date, delay_s, CAST(stop_sequence * 3600 AS INTEGER) AS scheduled_arrival_s, CAST(stop_sequence AS INTEGER) AS stop_sequence, prev_stop_delay_s, CAST(hour_local AS INTEGER) AS hour_local, 'T1' AS route_short_name, stop_id FROM training")
def feature_projection(spark, sf_dir):
    """FIL8 FIL9 API3: the delay model's features, the calendar's left out here; a forbidden one is refused."""
    rows = features(_training(spark, sf_dir), DELAY_FEATURES, DELAY_FORBIDDEN, keep=("service_date", "delay_s"))
    return rows.drop("day_of_week", "is_weekend", "is_peak")


# Time.


@query("SELECT event_type AS line, strftime(time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(DISTINCT user_id) AS services FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    """TMP6 SC9: quarter hours, aligned in UTC."""
    rows = _events(spark, sf_dir).groupBy("line", _stamp(floor_to(F.col("observed_at"), 900)).alias("window_start"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("trip_id").alias("services"))


@query(
    """WITH p AS (SELECT epoch(ts)::BIGINT AS s FROM (SELECT date_trunc('second', ts) AS ts FROM events WHERE event_type = 'error')), g AS (SELECT s - lag(s) OVER (ORDER BY s) AS g FROM p)
    SELECT strftime(to_timestamp(CAST(ceil((SELECT min(epoch(ts)) FROM events WHERE event_type = 'view') / 900) * 900 AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start, strftime(to_timestamp(CAST(floor((SELECT max(s) FROM p) / 900) * 900 AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS "end", (SELECT max(g) FROM g) AS gap_s"""
)
def coverage_bounds(spark, sf_dir):
    """AG5 WN4: the span that polls cover, and the longest time between two of them."""
    rows = _events(spark, sf_dir)
    out = temporal.coverage(rows.filter("line = 'view'"), rows.filter("line = 'error'"), "observed_at", 900)
    return out.select(_stamp("start").alias("start"), _stamp("end").alias("end"), "gap_s")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts)::VARCHAR IS NOT NULL AS seen FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    """WN6: the last row of each key."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return temporal.latest_by(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.col("ts").isNotNull().alias("seen"))


@query(f"SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE ts < TIMESTAMP '{_AT}' GROUP BY 1")
def known_before(spark, sf_dir):
    """TMP11: what a feed had told before a moment."""
    rows = temporal.as_of(_table(spark, sf_dir, "events"), F.lit(_AT).cast("timestamp_ntz"), "ts")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS service_date, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def collector_status(spark, sf_dir):
    """TMP10: what a store holds of each date, and failed polls."""
    rows = _events(spark, sf_dir)
    held = reports.store_status(rows, "observed_at", "service_date")
    failed = rows.groupBy("service_date").agg(F.count_if(F.col("line") == "error").alias("failed"))
    return held.join(failed, "service_date").select("service_date", "n", _stamp("first_seen").alias("first_seen"), _stamp("last_seen").alias("last_seen"), "failed")


@query(f"WITH {_FEED}, r AS (SELECT o_orderpriority AS route_id, count(*) AS trips FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM c) GROUP BY 1) SELECT route_id, CASE WHEN route_id < '4' THEN 'R' || substr(route_id, 1, 1) END AS route_short_name, trips FROM r ORDER BY route_id >= '4', trips DESC, route_id LIMIT 3")
def top_routes(spark, sf_dir):
    """FLT7 TK5: the first routes of a feed, known ones before others, by their trips."""
    known = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("route_id")).distinct().filter("route_id < '4'")
    lookup = known.withColumn("route_short_name", F.concat(F.lit("R"), F.substring("route_id", 1, 1)))
    return feed.top_routes(_feed(spark, sf_dir), lookup, 3).select("route_id", "route_short_name", "trips")


@query("SELECT * FROM (VALUES ('of another era', true), ('of this era', false), ('without trips', false)) AS t(lookup, mismatch)")
def era_mismatch(spark, sf_dir):
    """TMP8: trips of a feed, of whose routes a lookup knows none."""
    updates = _feed(spark, sf_dir)
    known = spark.createDataFrame([("1-URGENT", "R1")], "route_id string, route_short_name string")
    old = spark.createDataFrame([("x", "R1")], "route_id string, route_short_name string")
    rows = [("of another era", feed.lookup_mismatch(updates, old)), ("of this era", feed.lookup_mismatch(updates, known)), ("without trips", feed.lookup_mismatch(updates.filter("false"), old))]
    return spark.createDataFrame(rows, "lookup string, mismatch boolean")


@query(
    """WITH d AS (SELECT DISTINCT strftime(ts, '%Y%m%d') AS day FROM events), b AS (SELECT DISTINCT strftime(l_shipdate, '%Y%m%d') AS fetched FROM lineitem UNION SELECT unnest(['20240103', '20240110', '20240117', '20240131'])),
    r AS (SELECT day, fetched, row_number() OVER (PARTITION BY day ORDER BY fetched DESC) - 1 AS bundle_rank FROM d JOIN b ON fetched <= day)
    SELECT substr(day, 1, 4) || '-' || substr(day, 5, 2) || '-' || substr(day, 7, 2) AS service_date, 'gtfs_' || fetched AS bundle, CAST(bundle_rank AS INTEGER) AS bundle_rank FROM r WHERE bundle_rank < 3"""
)
def era_choice(spark, sf_dir):
    """JN12: the newest timetables that were fetched by each date."""
    dates = _events(spark, sf_dir).select("service_date")
    old = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("gtfs_"), F.date_format("l_shipdate", "yyyyMMdd")).alias("bundle"))
    new = spark.createDataFrame([(f"gtfs_{d}",) for d in ("20240103", "20240110", "20240117", "20240131")], "bundle string")
    return cases.eras_for(dates, old.unionByName(new)).select("service_date", "bundle", "bundle_rank")


# Labels.


@query(
    f"""WITH {_LABELS} SELECT CASE WHEN disrupted THEN 'yes' WHEN NOT disrupted THEN 'no' ELSE 'unknown' END AS disrupted, count(*) AS windows, CAST(sum(n_services) AS BIGINT) AS services, round(avg(mean_d), 6) AS mean_delay_s, max(max_d) AS max_delay_s FROM verdicts GROUP BY 1"""
)
def label_delays(spark, sf_dir):
    """JN15 AG4: delays of windows by their label."""
    out = labels.window_delays(_labels(spark, sf_dir))
    said = F.when(F.col("disrupted"), "yes").when(~F.col("disrupted"), "no").otherwise("unknown")
    return out.select(said.alias("disrupted"), "windows", "services", F.round("mean_delay_s", 6).alias("mean_delay_s"), "max_delay_s")


_SNAPSHOT = """b AS (SELECT time_bucket(INTERVAL '3 hours', min(ts), TIMESTAMP '2000-01-01') + CASE WHEN min(ts) = time_bucket(INTERVAL '3 hours', min(ts), TIMESTAMP '2000-01-01') THEN INTERVAL 0 HOURS ELSE INTERVAL 3 HOURS END AS a, time_bucket(INTERVAL '3 hours', max(ts), TIMESTAMP '2000-01-01') AS z FROM events WHERE event_type = 'error'),
    g AS (SELECT line, w FROM (SELECT unnest(['click', 'view']) AS line), (SELECT unnest(generate_series(a, z - INTERVAL 3 HOURS, INTERVAL '3 hours')) AS w FROM b)),
    n AS (SELECT line, w, count(*) AS n, count(*) FILTER (d > 100) AS late FROM (SELECT event_type AS line, time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '2000-01-01') AS w, CAST(ts AS DATE) AS sd, user_id, arg_max(value, (ts, event_id)) AS d FROM events GROUP BY ALL) GROUP BY ALL),
    i AS (SELECT event_type AS line, CAST(ts AS DATE) AS d, min(ts) AS a, min(ts) + INTERVAL 4 HOURS AS z FROM events WHERE value > 300 GROUP BY ALL),
    s AS (SELECT DISTINCT line, 'inc-' || d AS incident_id, unnest(generate_series(time_bucket(INTERVAL '3 hours', a, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL '3 hours', z, TIMESTAMP '2000-01-01'), INTERVAL '3 hours')) AS w FROM i),
    snapshot AS (SELECT g.line, g.w, coalesce(any_value(n), 0) AS n_services, coalesce(any_value(late), 0) AS n_late, list_sort(list(incident_id) FILTER (incident_id IS NOT NULL)) AS ids FROM g LEFT JOIN n USING (line, w) LEFT JOIN s USING (line, w) GROUP BY ALL)"""


def _snapshot(spark, sf_dir):
    rows = _events(spark, sf_dir)
    polls = rows.filter("line = 'error'").select(F.col("observed_at").alias("poll_time"))
    spans = rows.filter("delay_s > 300").groupBy("line", F.to_date("observed_at").alias("d")).agg(F.min("observed_at").alias("start")).select(F.concat(F.lit("inc-"), "d").alias("incident_id"), "line", "start", (F.col("start") + F.expr("INTERVAL 4 HOURS")).alias("end"))
    return labels.label_snapshot(rows, polls, RULE, ["click", "view"], spans, ("event_id",))


@query(f"WITH {_SNAPSHOT} SELECT line, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, n_services, n_late, coalesce(array_to_string(ids, ','), '') AS incident_ids, len(coalesce(ids, [])) > 0 AS rule_a FROM snapshot")
def label_snapshot(spark, sf_dir):
    """API2 AG6: labels of every window that the polls cover, from events, polls and incidents in one call."""
    return _snapshot(spark, sf_dir).select("line", _stamp("window_start").alias("window_start"), "n_services", "n_late", F.array_join("incident_ids", ",").alias("incident_ids"), "rule_a")


@query(f"WITH {_SNAPSHOT} SELECT incident_id, count(*) AS windows, count(DISTINCT line) AS lines FROM (SELECT line, w, unnest(ids) AS incident_id FROM snapshot) GROUP BY 1")
def incident_windows(spark, sf_dir):
    """API9: windows and lines that each incident marks."""
    return reports.incident_windows(_snapshot(spark, sf_dir))


@query(
    f"""WITH {_LABELS}, o AS (SELECT line, w, n_services >= 5 AND n_late >= ceil(CAST(0.5 AS DOUBLE) * n_services - CAST(1e-9 AS DOUBLE)) AS b, n_services FROM labelled)
    SELECT v.disrupted::VARCHAR AS label, (CASE WHEN b THEN true WHEN o.n_services >= 5 THEN false END)::VARCHAR AS check, count(*) AS windows FROM verdicts v JOIN o USING (line, w) WHERE v.w >= TIMESTAMP '2024-01-03' GROUP BY ALL"""
)
def label_flips(spark, sf_dir):
    """API9: windows by their label and by that of a stricter rule."""
    one = _labels(spark, sf_dir).select("line", "window_start", "n_services", "n_late", "disrupted")
    strict = F.when(F.col("n_services") >= 5, F.col("n_late") >= labels.late_needed(F.col("n_services"), 0.5))
    two = one.select("line", "window_start", strict.alias("disrupted"))
    both = labels.compare_labels(one.withColumn("service_date", F.date_format("window_start", "yyyy-MM-dd")), two, "2024-01-03")
    out = reports.label_flips(both)
    return out.select(F.col("disrupted").cast("string").alias("label"), F.col("disrupted_check").cast("string").alias("check"), "windows")


# A line at a moment.


@query(
    f"""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS trip_id, strftime(ts, '%Y-%m-%d') AS service_date, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '{_AT}' - INTERVAL 6 HOURS AND ts < TIMESTAMP '{_AT}' GROUP BY ALL)
    SELECT service_date, trip_id, 's' || (CAST(trip_id AS BIGINT) % 4 + 1) AS next_stop_id, v AS expected_delay_s FROM r WHERE CAST(trip_id AS BIGINT) % 4 < 3 ORDER BY v DESC, trip_id LIMIT 8"""
)
def trains_by_delay(spark, sf_dir):
    """TK2 RT6 JN20: running services by the delay expected at their next call, those at their last left out."""
    rows = _events(spark, sf_dir).filter("line = 'view'").withColumn("stop_id", F.concat(F.lit("s"), F.col("trip_id").cast("long") % 4))
    calls = rows.select("trip_id").distinct().select("trip_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("trip_id", F.concat(F.lit("s"), "k").alias("stop_id"), F.col("k").alias("stop_sequence"), (F.col("k") * 60).alias("scheduled_arrival_s"))
    out = tools.expected_delays(tools.running(rows, F.lit(_AT).cast("timestamp"), 6 * 3600), calls, k=tools.TRAINS)
    return out.select("service_date", "trip_id", "next_stop_id", "expected_delay_s")


@query(
    f"""SELECT 'Station ' || (user_id % 12) AS station, count(DISTINCT (CAST(ts AS DATE), user_id)) AS n FROM events WHERE value > 60 AND ts >= TIMESTAMP '{_AT}' - INTERVAL 2 DAYS AND ts < TIMESTAMP '{_AT}' GROUP BY 1 ORDER BY n DESC, station LIMIT 5"""
)
def late_stations(spark, sf_dir):
    """TK3: the stations where most services were late."""
    rows = _events(spark, sf_dir).withColumn("stop_id", F.concat(F.lit("s"), F.col("trip_id").cast("long") % 12))
    names = spark.range(12).select(F.concat(F.lit("s"), "id").alias("stop_id"), F.concat(F.lit("Station "), "id").alias("station"))
    return tools.delayed_stations(rows, names, F.lit(_AT).cast("timestamp"), 60, 5, 2 * 86_400)


@query(
    f"""WITH {_LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY w DESC) AS k FROM labelled WHERE w + INTERVAL 3 HOURS <= TIMESTAMP '{_AT}')
    SELECT line, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, round(CASE WHEN n_services > 0 THEN n_late / n_services ELSE 0 END, 9) AS score FROM r WHERE k = 1"""
)
def disruption_risk(spark, sf_dir):
    """RT5: the score of each line's last whole window at a moment; the share of late services stands in for a model."""
    table = _labels(spark, sf_dir).select("line", "window_start", "n_services", "n_late")
    scorer = lambda rows: rows.withColumn("score", F.round(F.coalesce(F.try_divide("n_late", "n_services"), F.lit(0.0)), 9))
    out = None
    for line in _TYPES:
        one = tools.risk(table, line, F.lit(_AT).cast("timestamp"), WINDOW_S, scorer)
        out = one if out is None else out.unionByName(one)
    return out.select("line", _stamp("window_start").alias("window_start"), "score")


@query(
    f"""WITH s AS (SELECT vec_id AS id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_PROBE} AS DOUBLE[])) AS score FROM embeddings WHERE vec_id * 100 < 20000)
    SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 5"""
)
def past_incidents(spark, sf_dir):
    """RT8: the incidents most like a situation, of those first seen before a moment."""
    rows = _passages(spark, sf_dir).withColumns({"first_seen_ts": F.col("id") * 100})
    found = retrieval.top_k(rows, _PROBE, 5, "embedding", retrieval.guards(seen_before=20_000))
    return found.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    """SELECT * FROM (VALUES ('line_status', 'T1', false), ('line_status', 'T9', true), ('no_tool', 'T1', true), ('disruption_risk', 'T1', true), ('answer', '', false)) AS t(tool, line, is_error)"""
)
def tool_dispatch(spark, sf_dir):
    """RT9 RT10 API18 API19: a model's tool calls, errors as data, and its answer, as the transcript keeps them."""

    class Scripted:
        asked = [("line_status", "T1"), ("line_status", "T9"), ("no_tool", "T1"), ("disruption_risk", "T1")]

        def __init__(self):
            self.left = [*self.asked]

        def turn(self, messages):
            if not self.left:
                return {"answer": "as told"}
            tool, line = self.left.pop(0)
            return {"tool": tool, "input": {"line": line}}

    events = _events(spark, sf_dir).withColumn("line", F.when(F.col("line") == "view", "T1").otherwise("T4"))
    done = agent.ask("why?", agent.ToolBox(_AT, ["T1", "T4"], events), Scripted())
    rows = [(s["tool"], s["input"]["line"], s["is_error"]) for s in done.steps] + [("answer", "", done.answer != "as told")]
    assert all(t["strict"] and t["input_schema"]["properties"]["line"]["enum"] == ["T1", "T4"] for t in agent.tool_schemas(["T1", "T4"]))
    return spark.createDataFrame(rows, "tool string, line string, is_error boolean")


# Why: causes by a model that is passed in.

_CASES = f"""c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{GROUPS[0]}' WHEN 1 THEN '{GROUPS[1]}' WHEN 2 THEN '{GROUPS[2]}' ELSE '{GROUPS[3]}' END AS truth, doc_id % 11 AS day,
        CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN '{GROUPS[3]}' ELSE CASE doc_id % 4 WHEN 0 THEN '{GROUPS[0]}' WHEN 1 THEN '{GROUPS[1]}' WHEN 2 THEN '{GROUPS[2]}' ELSE '{GROUPS[3]}' END END AS guess FROM documents)"""


def _stand_in(instructions: str, asked: str) -> dict:
    """A model that reads the case's number in the question, declines some cases and errs in others."""
    assert instructions == reasons.INSTRUCTIONS
    i = int(asked.split("case ")[1].split(".")[0])
    if i % 13 == 0:
        return {"cause_group": "no such group"}
    return {"cause_group": GROUPS[3] if i % 3 == 0 else GROUPS[i % 4], "explanation": "told", "cited_alert_ids": ["0a1b2c3d"] if i % 2 else ["ffffffff"]}


def _explained(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    passage = F.struct(F.array(F.lit("0a1b2c3d4e")).alias("alert_ids"), F.lit("technical").alias("cause_group"), F.lit("Signals failed.").alias("text"))
    passages = F.when(F.col("doc_id") % 5 > 0, F.array(passage))
    rows = docs.withColumn("passages", passages).withColumn("question", reasons.question(F.concat(F.lit("case "), "doc_id", F.lit(".")), F.col("passages")))
    answers = reasons.with_citations_checked(reasons.explain(rows, _stand_in))
    truth = F.element_at(F.array(*[F.lit(g) for g in GROUPS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return answers.withColumns({"truth": truth, "date": (F.col("doc_id") % 11).cast("string")})


@query(
    f"""WITH {_CASES} SELECT doc_id, guess AS cause_group, guess IS NULL AS failed, CASE WHEN guess IS NULL THEN '' WHEN doc_id % 2 = 0 THEN 'ffffffff' WHEN doc_id % 5 = 0 THEN '0a1b2c3d' ELSE '' END AS unsupported,
        md5('Situation: case ' || doc_id || '.' || chr(10) || chr(10) || CASE WHEN doc_id % 5 > 0 THEN 'Past incidents, most similar first:' || chr(10) || chr(10) || '[alerts 0a1b2c3d] cause group: technical' || chr(10) || 'Signals failed.' ELSE 'No past incidents are provided.' END) AS question_md5 FROM c"""
)
def explained_cases(spark, sf_dir):
    """RT11: causes named by a model, answers checked, citations that were not shown, failures kept."""
    rows = _explained(spark, sf_dir)
    return rows.select("doc_id", "cause_group", F.col("error").isNotNull().alias("failed"), F.array_join("unsupported_citations", ",").alias("unsupported"), F.md5(F.col("question").cast("binary")).alias("question_md5"))


def _f1_sql() -> str:
    one = lambda g: f"CASE WHEN sum(n_{g} * times) > 0 THEN 2 * sum(t_{g} * times) / (sum(n_{g} * times) + sum(g_{g} * times)) END"
    sums = ", ".join(f"count(*) FILTER (truth = '{g}') AS n_{g}, count(*) FILTER (guess = '{g}') AS g_{g}, count(*) FILTER (truth = '{g}' AND guess = '{g}') AS t_{g}" for g in GROUPS)
    return f"""WITH {_CASES}, d AS (SELECT CAST(day AS VARCHAR) AS day, {sums} FROM c GROUP BY 1), days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d),
        drawn AS (SELECT r AS resample, CAST('0x' || substr(md5('0-' || r || '-' || j.i), 1, 12) AS BIGINT) % j.n AS i FROM range(2000) t(r), days j), draws AS (SELECT resample, day, count(*) AS times FROM drawn JOIN days USING (i) GROUP BY ALL),
        x AS (SELECT resample, list_avg(list_filter([{", ".join(one(g) for g in GROUPS)}], lambda f: f IS NOT NULL)) AS m FROM draws JOIN d USING (day) GROUP BY 1)
        SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, avg(CASE WHEN m IS NOT NULL THEN 1.0 ELSE 0 END) AS defined FROM x"""


@query(_f1_sql())
def reasons_run(spark, sf_dir):
    """API15 AG22: an interval of the macro-F1 of named causes, failed answers wrong, whole dates resampled."""
    by_date = _cut(reasons.macro_f1_sums(_explained(spark, sf_dir), "truth", "cause_group", "date"))
    names, metric = reasons.macro_f1_of()
    out = evalstats.bootstrap_by_date(by_date, evalstats.date_draws(by_date), names, metric)
    return out.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


# Models.


@query("SELECT l_returnflag AS feature, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 9) AS share FROM lineitem GROUP BY 1")
def importance_share(spark, sf_dir):
    """AG31: each feature's share of all weight."""
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("w")).collect()  # a row a feature
    shares = reports.importance([r[0] for r in rows], [r[1] for r in rows])
    return spark.createDataFrame([(f, round(x, 9)) for f, x in shares], "feature string, share double")


@query(f"WITH {_LABELS}, g AS (SELECT count(*) AS n FROM labelled) SELECT n AS rows, CAST(0 AS BIGINT) AS different, true AS flags_agree FROM g")
def kept_detector(spark, sf_dir):
    """SRC20 SNK12: a detector kept with its facts and loaded again scores as before."""
    folder = work_folder(spark, "detector")
    rows = _cut(_detection(spark, sf_dir))
    fitted = models.fit_detector("logistic", rows.filter("split = 'train'"), rows.filter("split = 'validation'"), _NUMBERS, lone=True)
    artefacts.save_detector(fitted, folder, spark, ["2024-01-01"])
    loaded, dates = artefacts.load_detector(folder, spark)
    assert dates == ["2024-01-01"]
    key = ["line", "window_start"]
    one, two = fitted.score(rows), loaded.score(rows)
    both = one.select(*key, F.col("score").alias("a"), F.col("flag").alias("f")).join(two.select(*key, F.col("score").alias("b"), F.col("flag").alias("g")), key)
    return both.agg(F.count("*").alias("rows"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-12).alias("different"), F.bool_and(F.col("f") == F.col("g")).alias("flags_agree"))


@query()
def ablation_detect(spark, sf_dir):
    """ML12 ML11: a detector with all features and without the alert flag, scored on the test windows."""
    rows = _cut(_detection(spark, sf_dir))
    train, held, test = (rows.filter(F.col("split") == s) for s in ("train", "validation", "test"))
    out = None
    for name, numbers in (("all", _NUMBERS), ("without alert_in_feed", tuple(c for c in _NUMBERS if c != "alert_in_feed"))):
        scored = models.fit_detector("logistic", train, held, numbers, lone=True).score(test)
        curve = evalstats.score_curve(scored, "score", "target")
        one = evalstats.average_precision(curve).select(F.lit(name).alias("features"), F.round("average_precision", 6).alias("average_precision"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def delay_model(spark, sf_dir):
    """ML9 ML8 ML11 API11: split, fit, intervals from validation rows, and both guesses on the test rows."""
    table = _cut(delay.modelling_rows(_training(spark, sf_dir).withColumn("scheduled_arrival_s", F.coalesce("scheduled_arrival_s", F.lit(0)))))
    _, scored = delay.fit(table)
    scored = _cut(scored.withColumn("inside", F.abs(F.col("prediction") - F.col("delay_s")) <= F.col("half_width")))
    inside = scored.agg(F.round(F.avg(F.col("inside").cast("double")), 6).alias("inside"))
    both = delay.against_persistence(scored)
    return both.join(F.broadcast(inside)).select("guess", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mase")], "inside")


