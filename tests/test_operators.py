import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from headway import schemas
from headway.errors import EmbeddingError, LeakageError, SchemaMismatchError, StaleIndexError
from headway.functions import text
from headway.operators import alerts, evalstats, labels, merge, reconcile, retrieval, temporal, tools
from headway.operators.graph import connected_components
from headway.plans.catalogue import _cut

T0 = dt.datetime(2026, 6, 10, 10)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), _cut).collect()}
    assert got == {v: root(v) for v in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), _cut).count() == 0


def test_asof_takes_the_last_at_or_before(spark):
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), at(rng.randint(0, 5000))) for i in range(200)]
    right = [(rng.choice("ab"), at(rng.randint(0, 5000)), i) for i in range(60)]
    df = temporal.asof_last(spark.createDataFrame(left, "i long, k string, ts timestamp"), spark.createDataFrame(right, "k string, seen timestamp, v long"), "ts", "seen", by=["k"], take=["seen"], segment_s=3600)
    got = {r["i"]: r["seen"] for r in df.collect()}
    assert got == {i: max((s for kk, s, _ in right if kk == k and s <= t), default=None) for i, k, t in left}


def test_upsert_guards(spark):
    schema = "k long, t timestamp, v string"
    stored = merge.fold_batch(spark.createDataFrame([(1, at(5), "a"), (1, at(5), "a"), (2, at(9), "b"), (2, at(1), "x")], schema), ["k"], "t", ["v"])
    batch = spark.createDataFrame([(1, at(4), "late"), (2, at(9), "equal"), (3, at(1), "new"), (1, at(7), "c"), (1, at(6), "d")], schema)
    got = {r["k"]: tuple(r)[1:] for r in merge.guarded_upsert(stored, batch, ["k"], "t", ["v"]).collect()}
    assert got == {1: ("c", at(5), at(7), 3), 2: ("b", at(1), at(9), 2), 3: ("new", at(1), at(1), 1)}
    again = merge.guarded_upsert(merge.guarded_upsert(stored, batch, ["k"], "t", ["v"]), batch, ["k"], "t", ["v"])
    assert {r["k"]: tuple(r)[1:] for r in again.collect()} == got


def test_status_lists_accumulate_and_late_ones_go(spark):
    none = spark.createDataFrame([], "k long, skipped_stop_ids array<string>, first_seen_utc timestamp, last_seen_utc timestamp, observation_count long")
    one = merge.merge_status(none, spark.createDataFrame([(1, at(5), ["b", "a"])], "k long, t timestamp, skipped_stop_ids array<string>"), ["k"], "t")
    batch = spark.createDataFrame([(1, at(6), ["a", "c"]), (1, at(4), ["z"])], "k long, t timestamp, skipped_stop_ids array<string>")
    row = merge.merge_status(one, batch, ["k"], "t").first()
    assert (row["skipped_stop_ids"], row["first_seen_utc"], row["last_seen_utc"], row["observation_count"]) == (["b", "a", "c"], at(5), at(6), 2)
    kept = merge.merge_status(one, batch, ["k"], "t", always=True).first()
    assert kept["skipped_stop_ids"] == ["b", "a", "z", "c"]


def test_freeze(spark):
    rows = spark.createDataFrame([("2026-06-10", at(0), at(50)), ("2026-06-11", at(0), at(50)), ("2026-06-10", at(40), at(50))], "service_date string, first timestamp, last timestamp")
    got = merge.freeze(rows, "2026-06-10", F.lit(at(30)), date_col="service_date", first="first", clip="last").collect()
    assert [tuple(r) for r in got] == [("2026-06-10", at(0), at(30))]


def _label(spark, events, spans=None, failed=None):
    df = spark.createDataFrame(events, "line string, service_date string, trip_id string, stops_ahead int, delay_s double, observed_at timestamp")
    rule = labels.LabelRule()
    counts = labels.services_by_window(labels.latest_by_service(labels.reliable(df), rule.window_s), rule.late_s, failed)
    grid = spark.createDataFrame([("T1", at(0)), ("T1", at(15)), ("T4", at(0)), ("T4", at(15))], "line string, window_start timestamp")
    return {(r["line"], r["window_start"]): r for r in labels.label_grid(grid, counts, rule, spans).collect()}


def test_label_rules(spark):
    events = [("T1", "d", str(i), 0, 301.0 if i < 2 else 300.0, at(1)) for i in range(5)]  # 2 of 5 late: strictly over 300 s
    events += [("T1", "d", "0", 0, 301.0, at(2)), ("T1", "d", "9", 2, 900.0, at(1)), ("T1", "d", "8", 0, 9999.0, at(1)), ("T1", "d", "7", 0, None, at(1))]
    events += [("T4", "d", str(i), 0, 900.0, at(16)) for i in range(4)]  # too few to tell
    spans = spark.createDataFrame([("inc-1", "T4", at(3), at(14))], "incident_id string, line string, start timestamp, end timestamp")
    got = _label(spark, events, spans)
    a = got["T1", at(0)]
    assert (a["n_services"], a["n_late"], a["rule_a"], a["rule_b"], a["disrupted"]) == (5, 2, False, True, True)
    assert got["T1", at(15)]["disrupted"] is None and got["T4", at(15)]["disrupted"] is None
    b = got["T4", at(0)]
    assert b["rule_a"] and b["disrupted"] and b["incident_ids"] == ["inc-1"] and b["n_services"] == 0


def test_latest_in_the_window_counts_and_failed_are_late(spark):
    events = [("T1", "d", str(i), 0, 0.0, at(1)) for i in range(5)] + [("T1", "d", "0", 0, 900.0, at(0)), ("T1", "d", "1", 0, 900.0, at(9))]
    assert _label(spark, events)["T1", at(0)]["n_late"] == 1
    failed = spark.createDataFrame([("T1", at(0), "d", "2"), ("T1", at(0), "d", "77")], "line string, window_start timestamp, service_date string, trip_id string")
    row = _label(spark, events, failed=failed)["T1", at(0)]
    assert (row["n_services"], row["n_late"]) == (6, 3)


def test_targets_look_forward_by_kleene_logic(spark):
    verdicts = [None, True, False, False, None, False, False]
    dates = ["a"] * 5 + ["b"] * 2
    rows = spark.createDataFrame([("T1", at(15 * i), d, v) for i, (v, d) in enumerate(zip(verdicts, dates, strict=True))], "line string, window_start timestamp, service_date string, disrupted boolean")
    plain = [r["target"] for r in labels.with_targets(rows).orderBy("window_start").collect()]
    assert plain == [True, False, None, None, False, None, None]
    dated = [r["target"] for r in labels.with_targets(rows, service_date="service_date").orderBy("window_start").collect()]
    assert dated == [True, False, None, None, None, None, None]


def test_needed_share_does_not_drift(spark):
    got = [r[0] for r in spark.range(1, 41).select(labels.late_needed(F.col("id"), 0.3)).collect()]
    assert got == [-(-3 * n // 10) for n in range(1, 41)]
    with pytest.raises(ValueError):
        labels.LabelRule(share=0)


def test_alert_flag_is_as_of_the_last_poll(spark):
    windows = spark.createDataFrame([("T1", at(15 * i)) for i in range(5)], "line string, window_start timestamp")
    polls = spark.createDataFrame([(at(20),), (at(50),), (at(62),)], "poll_time timestamp")
    seen = spark.createDataFrame([("T1", at(20), at(50))], "line string, first_seen timestamp, last_seen timestamp")
    got = [r["alert_in_feed"] for r in labels.alert_in_feed(windows, polls, seen, 900).orderBy("window_start").collect()]
    assert got == [None, True, True, True, False]


ALERTS = [
    ("a", "UNKNOWN_CAUSE", "Trackwork at weekend, buses replace trains", "", ["T1"], 0, 30),
    ("b", "TECHNICAL_PROBLEM", "Trains are not running between X and Y", "", ["T1"], 0, 30),
    ("c", "UNKNOWN_CAUSE", "Street closure", "", ["T1"], 0, 30),
    ("d", "UNKNOWN_CAUSE", "DELAYS at Central", "", ["T1", "T4"], 60, 90),
    ("e", "MAINTENANCE", "Allow extra travel time", "", ["T4"], 0, 30),
    ("f", "POLICE_ACTIVITY", "Trains may be delayed", "", ["T4"], 0, 25 * 60),
    ("g", "POLICE_ACTIVITY", "Trains may be delayed", "", ["T4"], 120, 130),
]


def _alerts(spark):
    rows = [(i, c, h, d, x, at(a), at(b)) for i, c, h, d, x, a, b in ALERTS]
    return spark.createDataFrame(rows, "alert_id string, cause string, header_text string, description_text string, lines array<string>, first_seen timestamp, last_seen timestamp")


def test_alert_rules_and_incidents(spark):
    said = spark.createDataFrame([("e", True, "seen")], "alert_id string, is_incident boolean, reason string")
    got = {r["alert_id"]: (r["is_incident"], r["reason"]) for r in alerts.audited(_alerts(spark), said).collect()}
    assert got["a"] == (False, "planned work: 'trackwork'")
    assert got["b"] == (True, "service impact: 'not running'") and got["c"] == (False, "no effect on train running stated") and got["d"] == (True, "service impact: 'delay'")
    assert got["e"] == (True, "override: seen") and got["f"] == (False, "standing notice (25 h in the feed)")
    assert {r["alert_id"]: r["reason"] for r in alerts.audited(_alerts(spark)).collect()}["e"] == "planned maintenance"
    picked = alerts.audited(_alerts(spark), said).filter("is_incident")
    found = alerts.incidents(picked, _cut)
    rows = {tuple(r["alert_ids"]): r for r in found.collect()}
    # b hands over to d (30 min, unknown cause); e to d likewise would be on T4: maintenance and unknown; d to g at 30 min
    assert set(rows) == {("b", "d", "e", "g")}
    whole = rows["b", "d", "e", "g"]
    assert whole["lines"] == ["T1", "T4"] and whole["cause"] == "TECHNICAL_PROBLEM" and whole["cause_group"] == "technical" and whole["incident_id"].startswith("inc-")
    spans = {r["line"]: (r["start"], r["end"]) for r in alerts.line_spans(picked, found).collect()}
    assert spans == {"T1": (at(0), at(90)), "T4": (at(0), at(130))}
    assert alerts.passages(picked, found).first()["text"].count("\n") == 4


def test_incidents_equal_all_pairs(spark):
    """The components of all pairs that hand over, by brute force; also of points in time, and across time slots."""
    for seed, most in ((4, 3000), (5, 20_000), (6, 500)):
        rng = random.Random(seed)
        rows = []
        for i in range(150):
            a = rng.randint(0, most)
            rows.append((f"{i:03d}", rng.choice(["X", "Y", "Z", "UNKNOWN_CAUSE"]), rng.sample(["T1", "T4", "T8"], rng.randint(1, 2)), a, a + rng.choice([0, 0, 5, 35, 70, 200, 900])))
        df = spark.createDataFrame([(i, c, x, at(a), at(b)) for i, c, x, a, b in rows], "alert_id string, cause string, lines array<string>, first_seen timestamp, last_seen timestamp")
        label = {r[0]: r[0] for r in rows}
        links = [(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and set(p[2]) & set(q[2]) and min(abs(q[3] - p[4]), abs(p[3] - q[4])) <= 35 and (p[1] == q[1] or "UNKNOWN_CAUSE" in (p[1], q[1]))]
        changed = True
        while changed:
            changed = False
            for p, q in links:
                m = min(label[p], label[q])
                if (label[p], label[q]) != (m, m):
                    label[p] = label[q] = m
                    changed = True
        want = {}
        for i, c in label.items():
            want.setdefault(c, []).append(i)
        assert sorted(r["alert_ids"] for r in alerts.incidents(df, _cut).collect()) == sorted(sorted(v) for v in want.values())


def test_cut_points():
    assert reconcile.cut_points(30) == (21, 26) and reconcile.cut_points(1) == (1, 1) and reconcile.cut_points(5) == (4, 4)


def test_reconcile(spark):
    obs = [("2026-06-10", "t", "s1", "r", "T1", 1, 0, 60, None, at(0), 2), ("2026-06-10", "t", "s1", "r", "T1", 1, 0, 90, 1, at(5), None), ("2026-06-10", "t", "s2", "r", "T1", 2, 1, None, 30, at(6), 1), ("2026-06-10", "t", "s3", "r", "T1", 3, 1, None, None, at(7), 1)]
    df = spark.createDataFrame(obs, "service_date string, trip_id string, stop_id string, route_id string, route_short_name string, stop_sequence int, stops_ahead int, arrival_delay_s int, departure_delay_s int, observed_at_utc timestamp, observation_count int")
    times = spark.createDataFrame([("t", "s1", "4", "25:10:00", "x", 0, 1), ("t", "s1", "5", "26:00:00", "x", 0, 2), ("t", "s1", "9", "01:00:00", "x", 1, 9), ("t", "s9", "bad", "01:00:00", "x", 0, 3)], "trip_id string, stop_id string, stop_sequence string, arrival_time string, departure_time string, bundle_rank int, file_row long")
    out = reconcile.reconcile(df, reconcile.merged_timetable(times))
    assert out.columns == list(schemas.TRAINING_COLUMNS)
    got = {r["stop_id"]: r for r in out.collect()}
    assert set(got) == {"s1", "s2"}
    assert (got["s1"]["delay_s"], got["s1"]["observation_count"], got["s1"]["scheduled_arrival_s"], got["s1"]["stop_sequence"], got["s1"]["schedule_matched"]) == (90, 3, 26 * 3600, 5, True)
    # s1 is now fifth by the timetable, s2 second by the feed
    assert (got["s2"]["prev_stop_delay_s"], got["s1"]["prev_stop_delay_s"], got["s2"]["schedule_matched"]) == (None, 30, False)


def test_feature_contracts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, target int")
    assert not set(schemas.DELAY_FEATURES) & schemas.DELAY_FORBIDDEN and not set(schemas.DETECTION_FEATURES) & schemas.DETECTION_FORBIDDEN
    assert len(schemas.DETECTION_FEATURES) == 20 and len(schemas.TRAINING_COLUMNS) == 19
    with pytest.raises(LeakageError):
        schemas.features(df, ["a", "target"], {"target"})
    with pytest.raises(SchemaMismatchError):
        schemas.features(df, ["b"], set())


def test_curves_with_ties(spark):
    rng = random.Random(8)
    pairs = [(rng.choice([0.1, 0.2, 0.5, 0.9, rng.random()]), rng.random() < 0.3) for _ in range(400)]
    curve = evalstats.score_curve(spark.createDataFrame(pairs, "s double, y boolean"), "s", "y", buckets=16)
    scores = sorted({s for s, _ in pairs}, reverse=True)
    total, ap, best = sum(y for _, y in pairs), 0.0, (-1, 0)
    for s in scores:
        flagged = [y for x, y in pairs if x >= s]
        ap += sum(flagged) / len(flagged) * sum(y for x, y in pairs if x == s) / total
        best = max(best, (2 * sum(flagged) / (len(flagged) + total), s))
    lower = max((s for s in scores if s < best[1]), default=0.0)
    assert evalstats.average_precision(curve).first()[0] == pytest.approx(ap)
    row = evalstats.best_threshold(curve).first()
    assert (row["threshold"], row["f1"]) == (pytest.approx((best[1] + lower) / 2), pytest.approx(best[0]))
    nothing = evalstats.score_curve(spark.createDataFrame([], "s double, y boolean"), "s", "y")
    assert evalstats.average_precision(nothing).first()[0] is None and evalstats.best_threshold(nothing).first()["threshold"] == 0.5


def test_conformal_rank(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 20)] + [("b", 1.0)] * 3, "bin string, v double")
    got = {(r["all"], r["bin"]): (r["n"], r["width"]) for r in evalstats.conformal_widths(rows, "bin", "v", 0.1).collect()}
    assert got[False, "a"] == (19, 18.0) and got[False, "b"] == (3, None) and got[True, None] == (22, 18.0)


def test_bootstrap_uses_the_same_draws(spark):
    import hashlib

    import numpy as np

    by = spark.createDataFrame([("a", 1.0, 2), ("b", 5.0, 1), ("c", 0.0, 4)], "date string, s double, n long")
    draws = evalstats.date_draws(by, 50, seed=0)
    row = evalstats.bootstrap_by_date(by, draws, ["s", "n"], lambda s, n: F.try_divide(s, n)).first()
    vals, s, n = [], np.array([1.0, 5.0, 0.0]), np.array([2, 1, 4])
    for r in range(50):
        i = [int(hashlib.md5(f"0-{r}-{j}".encode()).hexdigest()[:12], 16) % 3 for j in range(3)]
        vals.append(s[i].sum() / n[i].sum())
    assert (row["low"], row["high"]) == (pytest.approx(np.percentile(vals, 2.5)), pytest.approx(np.percentile(vals, 97.5)))
    assert evalstats.date_draws(by.limit(0), 5).count() == 0


def test_percentiles_equal_sorting(spark):
    import numpy as np

    rng = random.Random(21)
    groups = {"a": [rng.choice([1.0, 2.5, rng.random() * 1e6]) for _ in range(101)], "b": [3.0], "c": [float(i) for i in range(10)], None: [7.0, 9.0], "d": []}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("d", None), ("a", None)]
    shares = (0.0, 0.05, 0.5, 0.9, 1.0)
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["share"]): r["value"] for r in evalstats.percentiles(df, "x", shares, ["g"], buckets=8).collect()}
    assert got == {(g, q): pytest.approx(np.percentile(xs, 100 * q)) for g, xs in groups.items() if xs for q in shares}
    every = [x for xs in groups.values() for x in xs]
    assert {r["share"]: r["value"] for r in evalstats.percentiles(df, "x", shares).collect()} == {q: pytest.approx(np.percentile(every, 100 * q)) for q in shares}
    assert evalstats.percentiles(df.limit(0), "x", shares).count() == 0


def test_lead_times(spark):
    cases = spark.createDataFrame([("i", "T1", at(60), at(90)), ("j", "T1", at(600), at(610))], "incident_id string, line string, alert timestamp, last_seen timestamp")
    flags = spark.createDataFrame([("T1", at(-1)), ("T1", at(50)), ("T1", at(70)), ("T4", at(600)), ("T1", at(626))], "line string, flag_end timestamp")
    got = {r["incident_id"]: r["lead_s"] for r in evalstats.lead_times(cases, flags).collect()}
    assert got == {"i": 600, "j": None}


def test_chance_and_sample(spark):
    got = spark.range(1).select(evalstats.chance_of_a_hit(F.lit(5), F.lit(3), 2).alias("a"), evalstats.chance_of_a_hit(F.lit(2), F.lit(1), 3).alias("b")).first()
    assert (got["a"], got["b"]) == (pytest.approx(1 - 3 / 5 * 2 / 4), 1.0)
    rows = spark.createDataFrame([(i, i % 3 if i % 10 else None) for i in range(100)], "id long, s int")
    taken = evalstats.stratified_sample(rows, ["s"], F.col("id")).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in taken} == {None: 2, 0: 6, 1: 6, 2: 6}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.statements(F.lit('He said "stop." Then 15.0 left. e.g. Central is on. St. Leonards too.\n Next'))) == ['He said "stop."', "Then 15.0 left. e.g. Central is on.", "St. Leonards too.", "Next"]
    assert one(text.cited_ids(F.lit("see 0a1b2c3d and 0a1b2c3d, xx0a1b2c3d 12345678"))) == ["0a1b2c3d", "12345678"]
    assert one(text.enum_name(F.lit(9), {9: "NINE"})) == "NINE" and one(text.enum_name(F.lit(7), {9: "NINE"})) == "UNKNOWN(7)"
    pick = lambda *t: one(text.translation(F.array(*[F.struct(F.lit(a).alias("language"), F.lit(b).alias("text")) for a, b in t])))
    assert pick(("de", "D"), ("en", "E")) == "E" and pick(("en/html", "H"), ("de", "D")) == "D" and pick(("en/html", "H"),) == "H"
    assert one(text.cause_group(F.lit("STRIKE"))) == "weather_external" and one(text.cause_group(F.lit(None).cast("string"))) == "other_unknown"
    assert one(text.normalise(F.lit("  a\t b \n\n\n c  "))) == "a b\n\nc"


def test_passages_keep_to_the_target():
    rng = random.Random(2)
    for _ in range(50):
        body = "\n\n".join(" ".join("w" * rng.randint(1, 9) + rng.choice(["", "", "."]) for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 6)))
        out = retrieval.passages_of(body, 200, 30)
        assert all(len(p) <= 200 + 32 for p in out)
        assert not out or "".join(out[0].split()) == "".join(body.split())[: len("".join(out[0].split()))]
    assert retrieval.passages_of(None) == retrieval.passages_of(" \n\n ") == []


def test_search_guards_and_index(spark, tmp_path):
    rows = retrieval.embed(spark.createDataFrame([(str(i), f"text number {i % 7} about trains", i, f"inc-{i % 3}") for i in range(40)], "id string, text string, first_seen_ts long, incident_id string"), "text")
    print_of = {"embedder": "hashing", "width": 64}
    retrieval.build_index(rows, str(tmp_path / "index"), print_of)
    index = retrieval.open_index(spark, str(tmp_path / "index"), print_of)
    q = retrieval.hashing_embedder(["text number 3 about trains"])[0]
    got = retrieval.top_k(index, q, 4, where=retrieval.guards(seen_before=30, exclude="inc-0")).collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4] and all(r["first_seen_ts"] < 30 and r["incident_id"] != "inc-0" for r in got)
    assert got[0]["score"] == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(StaleIndexError):
        retrieval.open_index(spark, str(tmp_path / "index"), {"width": 128})
    with pytest.raises(ValueError):
        retrieval.build_index(rows.unionByName(rows), str(tmp_path / "other"), print_of)
    with pytest.raises(Exception, match="shape") as e:
        retrieval.embed(rows.drop("vector"), "text", lambda t: retrieval.hashing_embedder(t, 8)).collect()
    assert EmbeddingError.__name__ in str(e.value)


def test_tools_see_nothing_at_or_after_the_moment(spark):
    rows = spark.createDataFrame([("T1", "d", "t", "s1", 500.0, at(-10)), ("T1", "d", "t", "s2", 100.0, at(-5)), ("T1", "d", "u", "s1", 400.0, at(-31)), ("T1", "d", "v", "s1", 900.0, at(0))], "line string, service_date string, trip_id string, stop_id string, delay_s double, observed_at timestamp")
    got = tools.situation(rows, F.lit(at(0)), 300).first()
    assert (got["n_services"], got["n_late"], got["max_delay_s"]) == (1, 0, 100.0)
    names = tools.station_names(spark.createDataFrame([("s1", "Central Platform 1", "p"), ("p", "Central Station", None)], "stop_id string, stop_name string, parent_station string"))
    late = tools.delayed_stations(rows, names, F.lit(at(0)), 300).collect()
    assert [tuple(r) for r in late] == [("Central", 1)]
    live = tools.running(rows, F.lit(at(0)))
    calls = spark.createDataFrame([("t", "s2", 1, 100), ("t", "s3", 2, 200)], "trip_id string, stop_id string, stop_sequence int, scheduled_arrival_s int")
    out = tools.expected_delays(live, calls).collect()
    assert [(r["trip_id"], r["next_stop_id"], r["expected_delay_s"]) for r in out] == [("t", "s3", 100.0)]


def test_guard_of_many_queries_acts_before_the_best_are_kept(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(40)], "id long, v array<double>").coalesce(1)
    got = retrieval.top_k_for(rows.filter("id = 0"), rows, 3, "v", "id", guard=lambda q, x: x > q + 20).orderBy("rank").collect()
    assert [r["id"] for r in got] == [21, 22, 23]


def test_eras_are_the_newest_fetched_by_then(spark):
    from headway.operators import cases

    dates = spark.createDataFrame([("2026-06-10",), ("2026-06-01",), ("2026-05-01",)], "service_date string")
    bundles = spark.createDataFrame([(f"gtfs_{d}",) for d in ("20260530", "20260601", "20260605", "20260609", "20260611")] + [("other",)], "bundle string")
    got = sorted(tuple(r) for r in cases.eras_for(dates, bundles).select("service_date", "bundle_rank", "bundle").collect())
    assert got == [("2026-06-01", 0, "gtfs_20260601"), ("2026-06-01", 1, "gtfs_20260530"), ("2026-06-10", 0, "gtfs_20260609"), ("2026-06-10", 1, "gtfs_20260605"), ("2026-06-10", 2, "gtfs_20260601")]


def test_passage_summary(spark):
    rows = [("a", x) for x in (5, 3, 9, 3)] + [("b", 7)]
    got = {r[0]: tuple(r)[1:] for r in __import__("headway.operators.reports", fromlist=["x"]).passage_summary(spark.createDataFrame(rows, "d string, n_chars int"), "d").collect()}
    assert got == {"a": (4, 3, 5, 9), "b": (1, 7, 7, 7)}


def test_corpus_hash_has_as_many_levels_as_it_takes(spark):
    rows = spark.range(5000).select(F.col("id"), F.concat(F.lit("t"), "id").alias("text"))
    one = text.corpus_hash(rows, "id", "text", digits=1).first()[0]
    assert one == text.corpus_hash(rows.repartition(7).orderBy(F.desc("id")), "id", "text", digits=1).first()[0]
    assert one != text.corpus_hash(rows.unionByName(rows.limit(1)), "id", "text", digits=1).first()[0]


def test_one_moment_in_seconds_of_its_service_day(spark):
    from headway.functions import time

    got = spark.range(1).select(time.service_seconds(F.lit(dt.datetime(2026, 10, 3, 14)), F.lit("2026-10-04")).alias("x")).first()[0]
    assert got == 3600.0  # noon less twelve hours, on a day that is an hour short


def test_no_frame_of_chains_is_read_anew_for_each_row(spark):
    """Frames that reach to the last row take the square of a crowded time slot; running ones do not."""
    plan = alerts.chains(_alerts(spark))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "window" in plan and "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_citations_go_through_crowded_slots_once(spark, sf_dir, monkeypatch):
    """The query's chains have no frame that is read anew for each row."""
    from headway.plans import words

    plans, chains = [], alerts.chains

    def spied(rows, *rest):
        plans.append(chains(rows)._jdf.queryExecution().optimizedPlan().toString().lower())
        return chains(rows, *rest)

    monkeypatch.setattr(alerts, "chains", spied)
    assert words.citations(spark, sf_dir).count() > 0
    assert len(plans) == 1 and "unboundedfollowing" not in plans[0]


def test_passages_collect_each_piece_once(spark):
    """Pieces stand where they first occur, as by sorting all; those that alerts repeat are not collected."""
    rng = random.Random(9)
    words = [None, "", " a ", "a", "b", "c", "d "]
    rows = [(f"{i % 50:02d}", "X", rng.choice(words), rng.choice(words), ["T1"], at(5 * (i % 9)), at(60)) for i in range(60)]
    rows.append(("zz", "X", None, " ", ["T8"], at(0), at(1)))
    df = spark.createDataFrame(rows, "alert_id string, cause string, header_text string, description_text string, lines array<string>, first_seen timestamp, last_seen timestamp")
    found = alerts.incidents(df, _cut)
    first = lambda x: (x is not None, x or "")
    strip = lambda x: None if x is None else x.strip(" ")
    want = {}
    for r in found.collect():
        mine = sorted((x[5], x[0], [first(strip(x[2])), first(strip(x[3]))]) for x in rows if x[0] in r["alert_ids"])
        want[r["incident_id"]] = list(dict.fromkeys(p for _, _, t in mine for _, p in t if p))
    made = alerts.passages(df, found)
    assert {r["incident_id"]: [p for p in r["text"].split("\n")[1:] if p] for r in made.collect()} == want and len(want) == 2
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(flatten(transform(_p" not in plan and "min(struct(first_seen" in plan


def test_crowded_cells_are_looked_at_by_their_corners(spark):
    """Alerts that come and go within one gap are one chain; only the cells' corners go through the slots."""
    rows = [(str(i), "X", ["T1"], at(i % 60 / 60), at(1 + i % 7)) for i in range(900)]
    df = spark.createDataFrame(rows, "alert_id string, cause string, lines array<string>, first_seen timestamp, last_seen timestamp")
    kept = []

    def counted(rows):
        kept.append(_cut(rows))
        return kept[-1]

    found = alerts.chains(df, cut=counted)
    assert found.select("alert_id").distinct().count() == 900 and found.select("chain").distinct().count() == 1
    assert kept and max(x.count() for x in kept) <= 8


@pytest.mark.parametrize("seed", range(3))
def test_incidents_equal_their_definition_in_crowded_and_in_sparse_cells(spark, monkeypatch, seed):
    """Chains over both kinds of cells, before 1970 too, ids that repeat and are sorted in parts."""
    monkeypatch.setattr(alerts, "ID_PARTS", 3)
    rng, gap = random.Random(seed), 35
    base, rows = dt.datetime(1970, 1, 1), []
    for i in range(150):
        first = rng.choice([rng.randint(-3000, 3000), gap * rng.randint(-60, 60), rng.randint(-90, 90)])
        last = first + rng.choice([0, gap, rng.randint(0, 60), rng.randint(100, 2500)])
        rows.append((f"{i:03d}", rng.choice(["X", "Y", alerts.UNKNOWN]), rng.choice([["T1"], ["T4"], ["T1", "T4"], ["T8"]]), first, last))
    rows += rows[:5]
    stamped = [(*r[:3], base + dt.timedelta(minutes=r[3]), base + dt.timedelta(minutes=r[4])) for r in rows]
    df = spark.createDataFrame(stamped, "alert_id string, cause string, lines array<string>, first_seen timestamp, last_seen timestamp")
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if set(a[2]) & set(b[2]) and (a[1] == b[1] or alerts.UNKNOWN in (a[1], b[1])) and abs(a[4] - b[3]) <= gap:
                parent[root(a[0])] = root(b[0])
    want = {}
    for x in parent:
        want.setdefault(root(x), []).append(x)
    got = alerts.incidents(df, _cut).collect()
    assert sorted(r["alert_ids"] for r in got) == sorted(sorted(v) for v in want.values()) and 1 < len(want) < 150
    for r in got:
        mine = [x for x in rows if x[0] in r["alert_ids"]]
        assert r["lines"] == sorted({y for x in mine for y in x[2]}) and r["cause"] == min(mine, key=lambda x: (x[1] == alerts.UNKNOWN, x[3], x[0]))[1]
