import datetime as dt
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from headway import schemas
from headway.sources import feed, store
from headway.streaming import collect

T0 = dt.datetime(2026, 6, 10, 10)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def update(trip, route, stops, start=None, relationship=None):
    each = [(s, q, r, None if a is None else (a, None), None if d is None else (d, None)) for s, q, r, a, d in stops]
    return (trip, (trip, route, start, relationship), each)


def test_flatten(spark):
    rows = [
        update("t1", "r1", [("s1", 1, 1, 5, 5), ("s2", None, 0, None, None), ("s3", 3, 0, 60, None), ("s4", 4, None, None, 0), ("s5", 5, 0, 1, 1), ("s6", 6, 0, 2, 2)], "20260609"),
        update("t2", "r9", [], None, 3), update("", "r1", [("s1", 1, 0, 9, 9)]), update("t3", "r1", [("s1", 1, 0, 9, 9)], None, 42),
    ]
    updates = spark.createDataFrame(rows, schemas.TRIP_UPDATE)
    routes = spark.createDataFrame([("r1", "T1")], "route_id string, route_short_name string")
    poll = F.lit(at(0))
    got = feed.stop_observations(updates, poll, routes).orderBy("trip_id", "stops_ahead").collect()
    assert [(r["stop_id"], r["stops_ahead"], r["arrival_delay_s"], r["departure_delay_s"], r["service_date"], r["route_short_name"]) for r in got] == [
        ("s3", 2, 60, None, "2026-06-09", "T1"), ("s4", 3, None, 0, "2026-06-09", "T1"), ("s5", 4, 1, 1, "2026-06-09", "T1"), ("s1", 0, 9, 9, "2026-06-10", "T1"),
    ]
    assert feed.stop_observations(updates, poll, most_stops=0).count() == 5
    statuses = {r["trip_id"]: (r["trip_relationship"], r["skipped_stop_ids"]) for r in feed.trip_statuses(updates, poll).collect()}
    assert statuses == {"t1": ("SCHEDULED", ["s1"]), "t2": ("CANCELED", []), "t3": ("UNKNOWN(42)", [])}
    assert [r["route_id"] for r in feed.route_summary(updates, routes).collect()] == ["r1", "r9"]
    assert feed.lookup_mismatch(updates, routes.filter("false")) and not feed.lookup_mismatch(updates, routes)


def test_alerts(spark):
    rows = [
        ("a", 3, None, 99, [("de", "Hallo"), ("en", "Hello")], None, [], [("r1", None, None), ("r1", None, None), (None, 1, "s")], [(5, None), (None, 9)]),
        ("b", None, 1, None, [], None, None, [("r2", 0, None)], None),
    ]
    df = spark.createDataFrame(rows, schemas.ALERT)
    got = {r["alert_id"]: r for r in feed.service_alerts(df, F.lit(at(0))).collect()}
    assert (got["a"]["cause"], got["a"]["severity"], got["a"]["header_text"], got["a"]["url"]) == ("TECHNICAL_PROBLEM", "UNKNOWN(99)", "Hello", "")
    assert (got["b"]["cause"], got["b"]["effect"]) == ("UNKNOWN_CAUSE", "NO_SERVICE")
    scopes = sorted(tuple(r)[:6] for r in feed.alert_scopes(df, F.lit(at(0))).select("alert_id", "route_id", "direction_id", "stop_id", "active_period_start", "active_period_end").collect())
    assert scopes == [("a", "", 1, "s", 0, 9), ("a", "", 1, "s", 5, 0), ("a", "r1", -1, "", 0, 9), ("a", "r1", -1, "", 5, 0), ("b", "r2", 0, "", 0, 0)]


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE obs (trip_id TEXT, delay INTEGER)")
        db.executemany("INSERT INTO obs VALUES (?, ?)", [(str(i), i if i % 3 else None) for i in range(100)])
    spark.dataSource.register(store.SqliteSource)
    df = spark.read.format("headway_sqlite").option("path", path).option("table", "obs").load()
    assert df.dtypes == [("trip_id", "string"), ("delay", "bigint")] and df.count() == 100 and df.filter("delay IS NULL").count() == 34
    with pytest.raises(Exception, match="no table"):
        spark.read.format("headway_sqlite").option("path", path).option("table", "none").load().count()


def test_sqlite_reads_every_row_once(spark, tmp_path):
    """Negative and sparse row ids, tables without row ids, and a file that is not there."""
    path = str(tmp_path / "y.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE a (id INTEGER PRIMARY KEY, x TEXT)")
        db.executemany("INSERT INTO a VALUES (?, 'x')", [(i,) for i in (-10**12, -3, -2, -1, 0, 1, 5, 10**12)])
        db.execute("CREATE TABLE b (k TEXT PRIMARY KEY, v REAL) WITHOUT ROWID")
        db.executemany("INSERT INTO b VALUES (?, 1.5)", [(str(i),) for i in range(20)])
        db.execute("CREATE TABLE c (v REAL)")
    assert sorted(r[0] for r in store.read_sqlite(spark, path, "a").collect()) == [-10**12, -3, -2, -1, 0, 1, 5, 10**12]
    assert store.read_sqlite(spark, path, "b").count() == 20 and store.read_sqlite(spark, path, "c").count() == 0
    assert store.read_sqlite(spark, str(tmp_path / "none.db"), "a", "id long, x string").collect() == []


def test_sheets_and_lines(spark, tmp_path):
    rows = [("a#0", "s", 'He said "no", twice\nand left', "e,1", True), ("a#1", "s", "Ok", "e2", False)]
    df = spark.createDataFrame(rows, "statement_id string, system string, statement string, evidence string, supported boolean")
    store.write_json_lines(df, str(tmp_path / "judged"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "judged")).collect())) == sorted(rows)
    with pytest.raises(Exception, match="exist"):
        store.write_json_lines(df, str(tmp_path / "judged"))
    store.write_blind_sheet(df, str(tmp_path / "sheet"))
    sheet = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "sheet"))
    assert sheet.columns == ["statement_id", "system", "statement", "evidence", "human_supported"] and sheet.count() == 2
    assert sheet.orderBy("statement_id").first()["statement"] == rows[0][2]
    with pytest.raises(Exception, match="yes or no"):
        store.read_sheet(spark, str(tmp_path / "sheet")).collect()
    filled = sheet.withColumn("human_supported", F.when(F.col("statement_id") == "a#0", "Yes ").otherwise("no"))
    filled.write.option("header", True).option("escape", '"').csv(str(tmp_path / "filled"))
    assert {tuple(r) for r in store.read_sheet(spark, str(tmp_path / "filled")).collect()} == {("a#0", True), ("a#1", False)}


def test_batches_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    schema = "k long, t timestamp, v double"
    table = collect.VersionedTable(spark, str(tmp_path / "t"), buckets=8)
    collect.merge_batch(table, spark.createDataFrame([(i, at(0), 1.0) for i in range(100)], schema), 0, ["k"], "t")
    collect.merge_batch(table, spark.createDataFrame([(5, at(1), 2.0), (500, at(1), 2.0)], schema), 1, ["k"], "t")
    held = table.manifest(1)
    assert sorted(set(held.values())) == [0, 1] and list(held.values()).count(1) <= 2
    rows = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(rows) == 101 and rows[5] == rows[500] == 2.0 and rows[6] == 1.0
    for n in (2, 3, 4):
        collect.merge_batch(table, spark.createDataFrame([(5, at(n), float(n))], schema), n, ["k"], "t")
    assert table.versions() == [3, 4] and len({r["k"] for r in table.read().collect()}) == 101


def test_polls_never_raise(spark, tmp_path):
    table, told = collect.VersionedTable(spark, str(tmp_path / "t"), buckets=4), []

    def fails():
        raise OSError("no feed")

    log = lambda n, s: told.append((n, s))
    assert not collect.poll_once(fails, table, 0, ["k"], "t", log)
    assert collect.poll_once(lambda: spark.createDataFrame([(1, at(0))], "k long, t timestamp"), table, 1, ["k"], "t", log)
    assert told == [(0, "error: no feed"), (1, "ok")] and table.read().count() == 1
    assert not collect.poll_once(fails, table, 2, ["k"], "t", lambda n, s: 1 / 0)
    assert [n for n in range(40) if collect.polls_alerts(n, 15)] == [0, 15, 30] and not collect.polls_alerts(0, 0)
    assert collect.alert_sink(collect.sink_for("parquet", spark, str(tmp_path / "s"))) and collect.alert_sink(collect.sink_for("csv", spark, str(tmp_path / "s"))) is None
    with pytest.raises(ValueError):
        collect.sink_for("none", spark, "x")


def test_timetable_zip(spark, tmp_path):
    for n in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{n}_20260601.zip", "w") as z:
            z.writestr("stop_times.txt", "﻿trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,25:10:00,25:11:00,s1,1\n")
            z.writestr("stops.txt", "﻿stop_id,stop_name,parent_station,location_type\ns1,Central Platform,p,\n")
    tables = store.timetable(spark, str(tmp_path / "*.zip"))
    rows = tables["stop_times"].collect()
    assert len(rows) == 2 and rows[0]["trip_id"] == "t" and rows[0]["arrival_time"] == "25:10:00" and rows[0]["file_row"] == 0
    assert tables["stops"].first()["stop_name"] == "Central Platform" and tables["routes"].count() == 0
    found = store.distinct_bundles(spark, str(tmp_path / "*.zip"))
    assert found.count() == 1 and store.new_bundles(found, found).count() == 0


def test_snapshots_and_checked_csv(spark, tmp_path):
    df = spark.createDataFrame([("2026-06-10", "t", -1), ("2026-06-11", "u", 4)], "service_date string, trip_id string, stop_sequence int")
    store.write_partitioned(df, str(tmp_path / "snap"), ["service_date"], kind="csv")
    (tmp_path / "snap" / "_polls.csv").write_text("poll,ok\n")
    got = store.read_snapshots(spark, str(tmp_path / "snap"), "trip_id string, stop_sequence int")
    assert sorted((r["trip_id"], r["stop_sequence"]) for r in got.collect()) == [("t", None), ("u", 4)]
    (tmp_path / "bad.csv").write_text("alert_id,is_incident\na,yes,too,many\n")
    with pytest.raises(Exception):  # noqa: B017
        store.read_checked(spark, str(tmp_path / "bad.csv"), "alert_id string, is_incident boolean").collect()


def test_replay_in_any_order_gives_the_batch_answer(spark, tmp_path):
    schema = "k long, t timestamp, v double"
    files = [[(1, at(5), 1.0), (2, at(1), 9.0)], [(1, at(3), 7.0), (2, at(2), 8.0)], [(1, at(5), 2.0), (1, at(9), 3.0)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table, told = collect.VersionedTable(spark, str(tmp_path / "table")), []
    collect.collect(stream, table, ["k"], "t", str(tmp_path / "cp"), ["v"], log=lambda i, s: told.append((i, s))).awaitTermination()
    got = {r["k"]: r for r in table.read().collect()}
    assert (got[1]["v"], got[1]["last_seen_utc"]) == (3.0, at(9)) and (got[2]["v"], got[2]["last_seen_utc"]) == (8.0, at(2))
    assert [s for _, s in told] == ["ok"] * len(told) and len(table.versions()) <= 2
    before = table.versions()
    collect.merge_batch(table, spark.createDataFrame([(1, at(99), 0.0)], schema), before[-1], ["k"], "t")  # a batch done already
    assert table.versions() == before


def test_stateful_latest_wins(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "key long, observed_at timestamp, value double"
    for i, rows in enumerate([[(1, at(5), 1.0)], [(1, at(3), 7.0), (1, at(9), 3.0)], [(2, at(1), 4.0), (1, at(8), 5.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = stream.groupBy("key").transformWithStateInPandas(collect.LatestWins(), "key long, value double, first_seen timestamp, last_seen timestamp, observation_count long", "update", "none")
    q = out.writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["key"]: (r["value"], r["last_seen"]) for r in spark.table("latest").collect()}
    assert got == {1: (3.0, at(9)), 2: (4.0, at(1))}
    assert {r["key"]: r["observation_count"] for r in spark.table("latest").collect()}[2] == 1


def test_windows_close_with_the_watermark(spark, tmp_path):
    rows = [("T1", at(1), 500.0), ("T1", at(2), 10.0), ("T1", at(200), 10.0)]
    spark.createDataFrame(rows, "line string, t timestamp, d double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line string, t timestamp, d double").parquet(str(tmp_path / "in"))
    q = collect.late_counts(stream, "t", "d").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("late").collect()] == [("T1", at(0), 2, 1)]
