import io
import json

import pytest
from pyspark.sql import functions as F

from headway.__main__ import main
from headway.errors import RefusedError
from headway.operators import agent, reasons, reports, retrieval, serve
from headway.sources import store


def _cases(spark):
    rows = [("a", None), ("b", []), ("c", [(["0a1b2c3d99", "4e5f6a7b99"], "technical", "Signals failed.")])]
    df = spark.createDataFrame(rows, "id string, passages array<struct<alert_ids:array<string>,cause_group:string,text:string>>")
    return df.withColumn("question", reasons.question(F.concat(F.lit("case "), "id"), F.col("passages")))


def test_questions_show_what_was_found(spark):
    got = {r["id"]: r["question"].split("\n\n") for r in _cases(spark).collect()}
    assert got["a"] == ["Situation: case a", "No past incidents are provided."]
    assert got["b"][1] == "Past incidents were searched for, and none was found."
    assert got["c"][1:] == ["Past incidents, most similar first:", "[alerts 0a1b2c3d, 4e5f6a7b] cause group: technical\nSignals failed."]


def test_answers_are_checked_and_failures_kept(spark):
    def model(instructions, asked):
        from headway.errors import RefusedError

        if "case a" in asked:
            raise RefusedError("not this one")
        if "case b" in asked:
            return {"cause_group": "nothing of the kind", "explanation": "x"}
        return {"cause_group": "technical", "explanation": "x", "cited_alert_ids": ["4e5f6a7b", "12345678"]}

    got = {r["id"]: r for r in reasons.with_citations_checked(reasons.explain(_cases(spark), model)).collect()}
    assert got["a"]["cause_group"] is None and got["a"]["error"] == "declined: not this one"
    assert got["b"]["cause_group"] is None and "must be one of" in got["b"]["error"]
    assert (got["c"]["cause_group"], got["c"]["error"], got["c"]["unsupported_citations"]) == ("technical", None, ["12345678"])
    with pytest.raises(ValueError, match="list of texts"):
        reasons.checked({"cause_group": "technical", "explanation": "x", "cited_alert_ids": [1]})
    assert issubclass(RefusedError, RuntimeError)


def test_macro_f1_of_whole_dates(spark):
    rows = [("d", "technical", "technical"), ("d", "technical", None), ("e", "weather_external", "technical"), ("e", "weather_external", "weather_external")]
    by = reasons.macro_f1_sums(spark.createDataFrame(rows, "date string, t string, g string"), "t", "g", "date")
    names, metric = reasons.macro_f1_of()
    got = by.agg(*[F.sum(n).alias(n) for n in names]).select(metric(*[F.col(n) for n in names]).alias("m")).first()["m"]
    assert got == pytest.approx((2 * 1 / (2 + 2) + 2 * 1 / (2 + 1)) / 2)


def test_past_incidents_are_guarded_before_the_best_are_kept(spark):
    rows = [(i, [1.0, i / 50], 10 * i) for i in range(30)]
    index = spark.createDataFrame(rows, "id long, vector array<double>, first_seen_ts long")
    got = reasons.past_incidents(index.filter("id in (7, 20)"), index, k=3).orderBy("query", "rank").collect()
    assert [(r["query"], r["id"]) for r in got] == [(7, 6), (7, 5), (7, 4), (20, 19), (20, 18), (20, 17)]


def test_tool_server(spark):
    events = spark.createDataFrame([("T1", "d", "t", "s1", 500.0, "2026-06-10 09:55:00")], "line string, service_date string, trip_id string, stop_id string, delay_s double, at string").withColumn("observed_at", F.to_timestamp("at"))
    box = agent.ToolBox("2026-06-10 10:00:00", ["T1", "T4"], events)
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "line_status", "arguments": {"line": "T1"}}}, {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "line_status", "arguments": {"line": "T9"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "none"},
    ]
    out = io.StringIO()
    serve.serve(box, [*map(json.dumps, asked), "", "not json"], out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [s["id"] for s in said] == [1, 2, 3, 4, 5, None]
    tools = said[1]["result"]["tools"]
    assert [t["name"] for t in tools] == list(agent.ToolBox.TOOLS) and tools[0]["inputSchema"]["properties"]["line"]["enum"] == ["T1", "T4"]
    assert not said[2]["result"]["isError"] and json.loads(said[2]["result"]["content"][0]["text"])["status"][0]["n_late"] == 1
    assert said[3]["result"]["isError"] and said[4]["error"]["code"] == serve.UNKNOWN_METHOD and said[5]["error"]["code"] == serve.BAD_MESSAGE


def test_commands(spark, tmp_path, sf_dir):
    said: list[str] = []
    assert main(["queries"], spark, said.append) == 0 and any(x.startswith("label_windows: ") for x in said)
    assert main(["run", "no_such", sf_dir], spark, said.append) == 1
    said.clear()
    assert main(["run", "store_status", sf_dir], spark, said.append) == 0 and len(said) == 5
    assert main(["run", "store_status", sf_dir, "--out", str(tmp_path / "out")], spark, said.append) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 5
    rows = spark.sql("SELECT '2026-06-10' AS service_date, timestamp'2026-06-10 01:00:00' AS first_seen_utc, timestamp'2026-06-12 01:00:00' AS last_seen_utc UNION ALL SELECT '2026-06-11', timestamp'2026-06-11 01:00:00', timestamp'2026-06-11 02:00:00'")
    rows.write.parquet(str(tmp_path / "t"))
    said.clear()
    assert main(["status", str(tmp_path / "t")], spark, said.append) == 0 and json.loads(said[0])["service_date"] == "2026-06-10"
    assert main(["freeze", str(tmp_path / "t"), str(tmp_path / "f"), "--date", "2026-06-10"], spark, said.append) == 0
    kept = spark.read.parquet(str(tmp_path / "f")).collect()
    assert len(kept) == 1 and str(kept[0]["last_seen_utc"]) == "2026-06-10 17:00:00"
    retrieval.build_index(spark.range(3).withColumn("text", F.lit("x")), str(tmp_path / "i"), {"width": 64})
    assert main(["index", str(tmp_path / "i"), "--expect", '{"width": 64}'], spark, said.append) == 0
    assert main(["index", str(tmp_path / "i"), "--expect", '{"width": 128}'], spark, said.append) == 1 and "width is 64, not 128" in said[-1]


def test_archive_and_routes(spark, tmp_path):
    import zipfile

    for n in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr(zipfile.ZipInfo("routes.txt"), "route_id,route_short_name\nr1,T1\nr2,T4\n")
            z.writestr(zipfile.ZipInfo("stops.txt"), "stop_id,stop_name,parent_station,location_type\ns1,Central,p,\n")
    said: list[str] = []
    assert main(["archive", str(tmp_path / "*.zip")], spark, said.append) == 0 and len(said) == 1
    assert main(["route", str(tmp_path / "*.zip"), str(tmp_path / "csv")], spark, said.append) == 0
    assert {tuple(r) for r in store.read_route_lookup(spark, str(tmp_path / "csv/routes")).collect()} == {("r1", "T1"), ("r2", "T4")}


def test_shares_of_importance():
    assert reports.importance(["a", "b", "c"], [1.0, 3.0, 0.0]) == [("b", 0.75), ("a", 0.25), ("c", 0.0)]
    assert reports.importance(["a"], [0.0]) == [("a", 0.0)]
