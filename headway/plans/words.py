"""Queries of scalar functions, and of texts about alerts, incidents and situations."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import text as text_functions
from headway.functions import time
from headway.operators import alerts, cases, labels, reconcile, reports, retrieval
from headway.plans.catalogue import _ISLANDS, _PROBE, _cut, _events, _passages, _table, query
from headway.sources.feed import CAUSES

_WALL = "ts AT TIME ZONE 'UTC' AT TIME ZONE 'Australia/Sydney'"


@query(
    """WITH d AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS day, ((CAST(ts AS DATE) + TIME '12:00:00') AT TIME ZONE 'Australia/Sydney') AT TIME ZONE 'UTC' - INTERVAL 12 HOURS AS origin FROM events)
    SELECT event_id, strftime(origin, '%Y-%m-%d %H:%M:%S') AS origin, CAST(floor(epoch(ts) - epoch(origin)) AS BIGINT) AS seconds FROM d"""
)
def service_origins(spark, sf_dir):
    """SC5 SC23: the instant that timetables count from, and an instant in seconds of its service day."""
    day = F.date_format("ts", "yyyy-MM-dd")
    seconds = F.floor(time.service_seconds(F.col("ts"), day))
    return _table(spark, sf_dir, "events").select("event_id", F.date_format(time.service_origin(day), "yyyy-MM-dd HH:mm:ss").alias("origin"), seconds.alias("seconds"))


@query(
    "SELECT doc_id, CASE "
    + " ".join(f"WHEN doc_id % 13 = {k} THEN '{text_functions.CAUSE_GROUPS.get(v, 'other_unknown')}'" for k, v in CAUSES.items())
    + " ELSE 'other_unknown' END AS cause_group FROM documents"
)
def cause_groups(spark, sf_dir):
    """SC13 FLT8: the group of each cause, by its code in the feed."""
    code = (F.col("doc_id") % 13).cast("int")
    return _table(spark, sf_dir, "documents").select("doc_id", text_functions.cause_group(text_functions.enum_name(code, CAUSES)).alias("cause_group"))


def _incident_alerts(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    seen = F.col("ts").cast("timestamp")
    return rows.select(
        F.col("event_id").cast("string").alias("alert_id"), F.col("event_type").alias("cause"), F.array("event_type").alias("lines"), seen.alias("first_seen"), seen.alias("last_seen"),
        F.concat(F.lit(" user "), F.col("user_id") % 7).alias("header_text"), F.when(F.col("user_id") % 3 > 0, F.col("event_type")).alias("description_text"),
    )


@query(
    f"""WITH {_ISLANDS}, p AS (SELECT event_type, island, ts, event_id, 0 AS k, 'user ' || user_id % 7 AS piece FROM i UNION ALL SELECT event_type, island, ts, event_id, 1, event_type FROM i WHERE user_id % 3 > 0),
    f AS (SELECT event_type, island, piece, min((ts, CAST(event_id AS VARCHAR), k)) AS first_at FROM p GROUP BY ALL), t AS (SELECT event_type, island, string_agg(piece, chr(10) ORDER BY first_at) AS body FROM f GROUP BY ALL),
    h AS (SELECT event_type, island, min(ts) AS first, 'inc-' || substr(sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR))), 1, 10) AS incident_id FROM i GROUP BY ALL)
    SELECT incident_id, 'Lines ' || event_type || ' from ' || strftime(first, '%Y-%m-%d %H:%M') || chr(10) || body AS text FROM h JOIN t USING (event_type, island)"""
)
def passage_texts(spark, sf_dir):
    """SC14 GEN7: one text an incident, its alerts' distinct pieces in time order."""
    rows = _incident_alerts(spark, sf_dir)
    found = _cut(alerts.incidents(rows, _cut))  # read twice
    return alerts.passages(rows, found).select("incident_id", "text")


@query(
    f"""WITH {_ISLANDS}, h AS (SELECT event_type, island, min(ts) AS first, max(ts) AS last, count(*) AS n, list_sort(list(CAST(event_id AS VARCHAR))) AS ids FROM i GROUP BY ALL)
    SELECT 'inc-' || substr(sha256(array_to_string(ids, ',')), 1, 10) AS incident_id, 'Operator ' || CASE WHEN n = 1 THEN 'alert ' ELSE 'alerts ' END || array_to_string(list_transform(ids, lambda x: substr(x, 1, 8)), ', ') || ' (first seen ' || strftime(first AT TIME ZONE 'UTC' AT TIME ZONE 'Australia/Sydney', '%H:%M') || ' local time)' AS citation,
        CAST(floor(epoch(first)) AS BIGINT) AS first_seen_ts, 'alerts ' || array_to_string(list_transform(ids, lambda x: substr(x, 1, 8)), ', ') AS locator, event_type AS lines FROM h"""
)
def citations(spark, sf_dir):
    """SC15: how an incident is cited, and the metadata of its passage."""
    found = cases.passage_metadata(alerts.incidents(_incident_alerts(spark, sf_dir), _cut))
    m = F.col("metadata")
    return found.select("incident_id", m["citation"].alias("citation"), m["first_seen_ts"].cast("long").alias("first_seen_ts"), m["locator"].alias("locator"), m["lines"].alias("lines"))


@query(r"SELECT page_id, md5(t) AS text_md5, CAST(len(t) AS INTEGER) AS n_chars FROM (SELECT page_id, trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(html, '[ \t\v\f\r]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x)), chr(10))) AS t FROM pages) WHERE len(t) >= 120")
def normalised_pages(spark, sf_dir):
    """SC17 SRC14: pages with blanks and blank lines collapsed, short ones left out."""
    rows = _table(spark, sf_dir, "pages").select("page_id", text_functions.normalise(F.col("html")).alias("t")).filter(F.length("t") >= 120)
    return rows.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").alias("n_chars"))


@query(f"SELECT event_id, strftime({_WALL}, '%H:%M') || ' on ' || strftime({_WALL}, '%A %-d %B %Y') AS moment FROM events")
def spoken_moments(spark, sf_dir):
    """SC20: instants in words."""
    return _table(spark, sf_dir, "events").select("event_id", time.spoken_moment(F.col("ts")).alias("moment"))


@query(
    f"""WITH r AS (SELECT event_id, event_type || ' and T9' AS who, {_WALL} AS wall, user_id % 4 AS services, user_id % 3 AS late, CAST(floor(value) AS BIGINT) - 20 AS worst, user_id % 2 = 0 AS known, user_id FROM events),
    h AS (SELECT *, who || ', ' || strftime(wall, '%H:%M') || ' on ' || strftime(wall, '%A %-d %B %Y') || ' (local time).' AS head FROM r)
    SELECT event_id, CASE WHEN services = 0 THEN head || ' No ' || who || ' service was observed in the 30 minutes before.' ELSE head || ' In the 30 minutes before, ' || services || ' services were observed. When last reported, ' || late || ' were more than five minutes late'
        || CASE WHEN worst > 0 THEN ' and the most delayed was ' || CAST(round_even(worst / 60, 0) AS BIGINT) || ' minutes behind' ELSE '' END || '.' || CASE WHEN known THEN ' At some point in those 30 minutes, services were reported more than five minutes late at Central (' || user_id || '), Town Hall (1).' ELSE '' END END AS text FROM h"""
)
def situation_words(spark, sf_dir):
    """SC22: situations in words."""
    station = lambda name, n: F.struct(F.lit(name).alias("station"), n.cast("long").alias("n"))
    stations = F.when(F.col("user_id") % 2 == 0, F.array(station("Central", F.col("user_id")), station("Town Hall", F.lit(1)))).otherwise(F.array().cast("array<struct<station:string,n:bigint>>"))
    text = cases.describe(F.array(F.col("event_type"), F.lit("T9")), F.col("ts"), 30, F.col("user_id") % 4, F.col("user_id") % 3, F.floor("value") - 20, stations)
    return _table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query(
    """WITH d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events), r AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS c FROM d)
    SELECT day, k <= greatest(1, round_even(c * CAST(0.7 AS DOUBLE), 0)) AS this_date_was_in_training FROM r"""
)
def training_flag(spark, sf_dir):
    """SC24: whether a model learnt from a date."""
    days = _table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    learnt = [r[0] for r in reconcile.with_split(days, "day").filter("split = 'train'").select("day").collect()]  # days
    return days.select("day", F.col("day").isin(learnt).alias("this_date_was_in_training"))


@query("""SELECT r_name AS prompt, substr(sha256(r_name || '{"a": 1}'), 1, 12) AS fingerprint FROM region""")
def prompt_prints(spark, sf_dir):
    """SC26 API17: digits that change with a prompt or its answer's schema."""
    prompts = [r[0] for r in _table(spark, sf_dir, "region").select("r_name").collect()]
    return spark.createDataFrame([(p, cases.prompt_fingerprint(p, {"a": 1})) for p in prompts], "prompt string, fingerprint string")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS ids, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def tool_json(spark, sf_dir):
    """SC27: nested results as JSON and back, the ids in them collected."""
    item = F.struct(F.array("event_type").alias("alert_ids"), F.lit(None).cast("string").alias("note"))
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_set(item).alias("incidents"))).alias("output"))
    parsed = F.from_json("output", "incidents array<struct<alert_ids:array<string>>>")
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(parsed["incidents"], lambda x: x["alert_ids"]))))
    return rows.select("user_id", F.array_join(ids, ",").alias("ids"), F.size(ids).cast("long").alias("n"))


@query(
    f"""WITH s AS (SELECT vec_id AS id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_PROBE} AS DOUBLE[])) AS score FROM embeddings), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 10),
    x AS (SELECT *, trim(repeat('word' || label || ' ', CAST(label * 9 + 1 AS BIGINT))) AS text FROM t)
    SELECT rank, printf('%d. [%+.3f] %s', rank, score, 'source ' || label) || chr(10) || '   ' || CASE WHEN len(text) > 220 THEN substr(text, 1, 220) || '…' ELSE text END AS line FROM x"""
)
def shown_hits(spark, sf_dir):
    """SC28 SC29: hits as lines, rank and score first, long texts cut."""
    found = retrieval.top_k(_passages(spark, sf_dir), _PROBE, 10, "embedding").withColumn("rank", F.col("rank").cast("long"))
    words = F.expr("repeat(concat('word', label, '\n  '), label * 9 + 1)")
    score = retrieval.similarity(1 - F.col("score"))
    return cases.shown(found.select("rank", score.alias("score"), F.concat(F.lit("source "), "label").alias("citation"), words.alias("text")))


@query("SELECT * FROM (VALUES ('leaf-wise', 4, 16, 5), ('leaf-wise', 6, 64, 1), ('symmetric', 4, NULL, NULL), ('symmetric', 6, NULL, NULL)) AS t(kind, depth, leaves, least)")
def grid_words(spark, sf_dir):
    """SC30: one grid in the words of other learners."""
    grid = ({"max_depth": 4, "learning_rate": 0.1, "min_child_weight": 5}, {"max_depth": 6, "learning_rate": 0.1, "min_child_weight": 1})
    rows = [("leaf-wise", c["max_depth"], c["num_leaves"], c["min_child_samples"]) for c in cases.leaf_wise(grid)] + [("symmetric", c["depth"], None, None) for c in cases.symmetric(grid)]
    return spark.createDataFrame(rows, "kind string, depth int, leaves int, least int")


@query(
    r"""WITH t AS (SELECT doc_id, '[alerts ' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) || ', ' || substr(md5(CAST(doc_id % 10 AS VARCHAR)), 1, 8) || '] text [alerts ' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) || ']' AS t FROM documents)
    SELECT doc_id, CASE WHEN substr(t, 9, 8) = substr(t, 19, 8) THEN substr(t, 9, 8) ELSE substr(t, 9, 8) || ',' || substr(t, 19, 8) END AS ids, CASE WHEN doc_id % 10 = 3 OR doc_id = 3 THEN '' ELSE substr(md5('3'), 1, 8) END AS unsupported FROM t"""
)
def evidence(spark, sf_dir):
    """RT14 SET5 SET6: ids in the headings of what was shown, and citations that were not shown."""
    short = lambda c: F.substring(F.md5(c.cast("string").cast("binary")), 1, 8)
    i = F.col("doc_id")
    text = F.concat(F.lit("[alerts "), short(i), F.lit(", "), short(i % 10), F.lit("] text [alerts "), short(i), F.lit("]"))
    shown = reports.evidence_ids(text)
    cited = F.array(short(F.lit(3)), short(i))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(shown, ",").alias("ids"), F.array_join(reports.unsupported_citations(cited, shown), ",").alias("unsupported"))


@query("SELECT e.user_id, count(*) AS n, string_agg(DISTINCT e.event_type, ',' ORDER BY e.event_type) AS shared FROM events e JOIN events o ON o.user_id = e.user_id + 1 AND o.event_type = e.event_type AND CAST(o.ts AS DATE) = CAST(e.ts AS DATE) GROUP BY 1")
def shared_lines(spark, sf_dir):
    """SET5: lines that neighbours have in common on a day."""
    rows = _table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), "event_type").groupBy("user_id", "d").agg(F.collect_list("event_type").alias("lines"))
    other = rows.select((F.col("user_id") - 1).alias("user_id"), "d", F.col("lines").alias("theirs"))
    both = rows.join(other, ["user_id", "d"]).withColumn("shared", F.array_intersect("lines", "theirs"))
    pairs = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.size(F.filter("theirs", lambda y: y == x)))
    each = both.filter(F.size("shared") > 0).groupBy("user_id").agg(F.sum(pairs).alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("shared")))), ",").alias("shared"))
    return each.select("user_id", "n", "shared")


@query(
    """WITH e AS (SELECT event_type AS line, CAST(ts AS DATE) AS d, min(ts) AS first FROM events GROUP BY ALL), w AS (SELECT e.line, e.d, e.first, x.user_id, arg_max(x.value, (x.ts, x.value)) AS v FROM e JOIN events x ON x.event_type = e.line AND floor(epoch(x.ts)) >= floor(epoch(e.first)) - 86400 AND floor(epoch(x.ts)) < floor(epoch(e.first)) GROUP BY ALL),
    c AS (SELECT line, d, count(*) AS services, count(*) FILTER (v > 100) AS late, max(v) AS worst FROM w GROUP BY ALL)
    SELECT e.line, strftime(e.d, '%Y-%m-%d') AS day, coalesce(services, 0) AS services, coalesce(late, 0) AS late, worst FROM e LEFT JOIN c ON e.line = c.line AND e.d = c.d
    WHERE strftime(first AT TIME ZONE 'UTC' AT TIME ZONE 'Australia/Sydney', '%Y-%m-%d') >= '2024-01-05' AND strftime(first AT TIME ZONE 'UTC' AT TIME ZONE 'Australia/Sydney', '%Y-%m-%d') < '2024-01-25'"""
)
def incident_cases(spark, sf_dir):
    """FIL14 GEN7: incidents of some dates with what was seen of their lines in the day before."""
    rows = _events(spark, sf_dir).drop("service_date").withColumn("service_date", F.lit("d")).withColumn("stop_id", F.lit("s"))
    found = rows.groupBy("line", F.to_date("observed_at").alias("d")).agg(F.min("observed_at").alias("first_seen")).select(F.concat_ws("|", "line", "d").alias("incident_id"), "line", "d", F.array("line").alias("lines"), "first_seen")
    stations = spark.createDataFrame([("s", "Central")], "stop_id string, station string")
    out = cases.cases(found, rows, stations, "2024-01-05", "2024-01-25", 86_400, 100)
    return out.select("line", F.col("d").cast("string").alias("day"), "services", "late", "worst")


@query("SELECT lang, source, count(*) AS n, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n_chars DESC, doc_id)) AS ids FROM documents GROUP BY ALL")
def stable_sort(spark, sf_dir):
    """TK6: rows in order of several keys, the last of which breaks all ties."""
    item = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").alias("b"))
    rows = _table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("l"))
    return rows.select("lang", "source", "n", F.md5(F.array_join(F.transform("l", lambda x: x["b"].cast("string")), ",").cast("binary")).alias("ids"))


@query("SELECT late_s, n, n_late FROM (SELECT CAST(unnest([0.0, 60.0, 100.0]) AS DOUBLE) AS late_s), LATERAL (SELECT count(*) AS n, count(*) FILTER (value > late_s) AS n_late FROM events)")
def label_rules(spark, sf_dir):
    """API1: late events by each of some thresholds of a rule."""
    rows = _table(spark, sf_dir, "events")
    rules = [labels.LabelRule(late_s=x) for x in (0.0, 60.0, 100.0)]
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col("value") > r.late_s).alias(f"l{i}") for i, r in enumerate(rules)])
    each = F.explode(F.array(*[F.struct(F.lit(r.late_s).alias("late_s"), F.col("n").alias("n"), F.col(f"l{i}").alias("n_late")) for i, r in enumerate(rules)])).alias("x")
    return counts.select(each).select("x.*")
