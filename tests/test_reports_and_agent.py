import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from headway import schemas
from headway.errors import FeedError
from headway.operators import agent, delay, reports, retrieval
from headway.sources import feed, realtime

T0 = dt.datetime(2026, 6, 10, 10)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def raw_feed():
    m = realtime.message()()
    m.header.gtfs_realtime_version = "2.0"
    e = m.entity.add(id="1")
    e.trip_update.trip.trip_id, e.trip_update.trip.route_id = "t", "r"
    s = e.trip_update.stop_time_update.add(stop_id="s1", stop_sequence=4)
    s.arrival.delay = 0
    s = e.trip_update.stop_time_update.add(stop_id="s2")
    s.departure.time = 99
    a = m.entity.add(id="2").alert
    a.cause = 10
    a.header_text.translation.add(text="Hello", language="en")
    a.informed_entity.add(route_id="r")
    a.active_period.add(start=5)
    return m.SerializeToString()


def test_messages_decode_with_presence(spark):
    messages = spark.createDataFrame([(at(0), bytearray(raw_feed()))], "poll_time timestamp, raw binary")
    rows = realtime.decoded(messages, "trip_update").collect()
    stops = rows[0]["stop_time_update"]
    assert stops[0]["arrival"]["delay"] == 0 and stops[0]["departure"] is None and stops[1]["departure"]["delay"] is None and stops[1]["stop_sequence"] is None
    seen = feed.stop_observations(realtime.decoded(messages, "trip_update"), F.col("poll_time")).collect()
    assert [(r["stop_id"], r["arrival_delay_s"], r["departure_delay_s"]) for r in seen] == [("s1", 0, None)]
    alert = feed.service_alerts(realtime.decoded(messages, "alert"), F.col("poll_time")).first()
    assert (alert["cause"], alert["header_text"]) == ("CONSTRUCTION", "Hello")
    with pytest.raises(FeedError):
        realtime.decode(b"\xff\xff\xff")


def test_polled_feed(spark, tmp_path):
    (tmp_path / "feed.pb").write_bytes(raw_feed())
    spark.dataSource.register(realtime.PolledFeed)
    for name, url, status in (("good", (tmp_path / "feed.pb").as_uri(), "ok"), ("bad", (tmp_path / "none.pb").as_uri(), "error")):
        stream = spark.readStream.format("headway_feed").option("url", url).load()
        q = stream.writeStream.format("memory").queryName(f"polled_{name}").option("checkpointLocation", str(tmp_path / name)).start()
        for _ in range(60):
            if spark.table(f"polled_{name}").count():
                break
            q.awaitTermination(1)
        q.stop()
        rows = spark.table(f"polled_{name}").collect()
        assert rows and all(r["status"].startswith(status) for r in rows)
        assert (rows[0]["raw"] is not None) == (status == "ok")


def test_judge_failures_are_no_verdicts(spark):
    answers = spark.createDataFrame([("a", "It is late. It is red.", "late"), ("b", "Broken.", "x")], "answer_id string, answer string, evidence string")

    def judge(statement, evidence):
        if statement == "Broken.":
            raise RuntimeError("no answer")
        return evidence in statement

    rows = reports.judged(answers, judge)
    got = {r["statement_id"]: r["supported"] for r in rows.collect()}
    assert got == {"a#0": True, "a#1": False, "b#0": None}
    rate = reports.faithfulness(rows).first()
    assert (rate["statements"], rate["failed"], rate["faithful"]) == (3, 1, 0.5)


def test_summaries(spark):
    rows = spark.createDataFrame([("technical",), ("technical",)], "cause_group string")
    assert {r["cause_group"]: r["n"] for r in reports.group_counts(rows, "cause_group").collect()} == {"technical": 2, "network_incident": 0, "weather_external": 0, "other_unknown": 0}
    chunks = spark.createDataFrame([("d", n) for n in (5, 1, 9, 7)], "doc string, n_chars int")
    assert tuple(reports.passage_summary(chunks, "doc").first()) == ("d", 4, 1, 7, 9)
    labels = spark.createDataFrame([("T1", 1, ["i"]), ("T1", 2, ["i", "j"]), ("T4", 1, ["i"])], "line string, window_start int, incident_ids array<string>")
    assert {r["incident_id"]: (r["windows"], r["lines"]) for r in reports.incident_windows(labels).collect()} == {"i": (3, 2), "j": (1, 1)}


class Scripted:
    def __init__(self, *said):
        self.said, self.heard = list(said), []

    def turn(self, messages):
        self.heard.append(messages[-1]["content"])
        return self.said.pop(0)


def box(spark):
    events = spark.createDataFrame([("T1", "d", "t", "s1", 500.0, at(-5)), ("T1", "d", "t", "s1", 0.0, at(1))], "line string, service_date string, trip_id string, stop_id string, delay_s double, observed_at timestamp")
    alerts = spark.createDataFrame([("a", "Trains delayed", ["T1"], at(-20), at(5)), ("b", "Later", ["T1"], at(2), at(9))], "alert_id string, header_text string, lines array<string>, first_seen timestamp, last_seen timestamp")
    passages = [("p", "T1 Trains delayed before", int(at(-600).timestamp())), ("q", "T1 Trains delayed after", int(at(600).timestamp()))]
    index = retrieval.embed(spark.createDataFrame(passages, "id string, text string, first_seen_ts long"), "text")
    return agent.ToolBox("2026-06-10 10:00:00", ["T1", "T4"], events, alerts, index=index)


def test_loop_uses_tools_as_of_the_moment(spark):
    model = Scripted({"tool": "line_status", "input": {"line": "T1"}}, {"tool": "line_status", "input": {"line": "T9"}}, {"tool": "predict_delays", "input": {"line": "T1"}}, {"answer": "late"})
    done = agent.ask("How is T1?", box(spark), model)
    assert (done.answer, done.stop_reason, [s["is_error"] for s in done.steps]) == ("late", "answered", [False, True, True])
    status = json.loads(done.steps[0]["output"])
    assert status["status"][0]["n_late"] == 1 and [a["alert_id"] for a in status["alerts"]] == ["a"]
    assert agent.ask("?", box(spark), Scripted(*[{"tool": "x"}] * 9), most_turns=2).stop_reason == "out of turns"


def test_similar_incidents_are_earlier_ones(spark):
    out, failed = box(spark).call("similar_past_incidents", {"line": "T1"})
    assert not failed and [r["id"] for r in json.loads(out)["incidents"]] == ["p"]


def test_delay_model_end_to_end(spark):
    import random

    rng = random.Random(1)
    rows = []
    for d in range(10):
        for t in range(30):
            prev = None
            for q in range(5):
                x = (prev if prev is not None else 0) + rng.choice([-20, 0, 0, 30])
                rows.append((f"2026-06-{d + 1:02d}", f"t{t}", f"s{q}", "r", "T1", q, 36000 + 600 * q, x, x, None, prev, 0, 1, at(0), 8, 2, False, True, True))
                prev = x
    types = ["string"] * 5 + ["int"] * 6 + ["int", "int", "timestamp", "int", "int", "boolean", "boolean", "boolean"]
    table = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(schemas.TRAINING_COLUMNS, types, strict=True)))
    model, scored = delay.fit(delay.modelling_rows(table), grid=[{"maxDepth": 3, "stepSize": 0.2}], rounds=5)
    assert len(model.training_dates) == 7 and set(scored.select("split").distinct().toPandas()["split"]) == {"test"}
    inside = scored.agg(F.avg((F.abs(F.col("prediction") - F.col("delay_s")) <= F.col("half_width")).cast("double"))).first()[0]
    assert inside >= 0.8
    got = {r["guess"]: r for r in delay.against_persistence(scored).collect()}
    assert set(got) == {"model", "persistence"} and got["persistence"]["mase"] == 1.0
