import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from headway.config import ConfigError, Settings, settings
from headway.operators import artefacts, cases
from headway.operators.models import fit_detector
from headway.sources import corpus

T0 = dt.datetime(2026, 6, 9, 22, 30)  # 08:30 on Wednesday 10 June in Sydney


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_settings(spark):
    assert settings(environ={}) == Settings() and Settings().alerts_trigger == "1800 seconds"
    got = settings(environ={"HEADWAY_LINES": "T1, T8,", "HEADWAY_POLL_SECONDS": "60", "HEADWAY_NEED_ROUTES": "Yes", "HEADWAY_SINK": " "})
    assert (got.lines, got.trigger, got.need_routes, got.sink) == (("T1", "T8"), "60 seconds", True, "parquet")
    spark.conf.set("spark.headway.poll_seconds", "30")
    assert settings(spark, {"HEADWAY_POLL_SECONDS": "60"}).poll_seconds == 30
    spark.conf.unset("spark.headway.poll_seconds")
    for bad in ({"HEADWAY_POLL_SECONDS": "x"}, {"HEADWAY_NEED_ROUTES": "maybe"}, {"HEADWAY_SINK": "tape"}, {"HEADWAY_POLL_SECONDS": "0"}):
        with pytest.raises(ConfigError):
            settings(environ=bad)
    assert settings(environ={"HEADWAY_ALERTS_EVERY": "0"}).alerts_trigger is None


def test_eras(spark):
    bundles = spark.createDataFrame([(f"gtfs_{d}.zip",) for d in ("20260601", "20260605", "20260610", "20260612")] + [("odd.zip",)], "bundle string")
    dates = spark.createDataFrame([("2026-06-11",), ("2026-06-05",), ("2026-05-01",)], "service_date string")
    got = sorted(tuple(r) for r in cases.eras_for(dates, bundles).collect())
    assert got == [("2026-06-05", "gtfs_20260601.zip", 1), ("2026-06-05", "gtfs_20260605.zip", 0), ("2026-06-11", "gtfs_20260601.zip", 2), ("2026-06-11", "gtfs_20260605.zip", 1), ("2026-06-11", "gtfs_20260610.zip", 0)]


def test_cases_in_words(spark):
    found = spark.createDataFrame([("i", ["0a1b2c3d4e"], ["T1"], "STRIKE", "weather_external", at(0), at(30)), ("j", ["x", "y"], ["T4"], "A", "b", at(0), at(9)), ("k", ["z"], ["T1"], "A", "b", at(1440), at(1450))], "incident_id string, alert_ids array<string>, lines array<string>, cause string, cause_group string, first_seen timestamp, last_seen timestamp")
    events = spark.createDataFrame([("T1", "d", "a", "s1", 400.0, at(-20)), ("T1", "d", "a", "s2", 90.0, at(-10)), ("T1", "d", "b", "s1", 450.0, at(-1)), ("T1", "d", "c", "s1", 900.0, at(0)), ("T1", "d", "e", "s1", 900.0, at(-31))], "line string, service_date string, trip_id string, stop_id string, delay_s double, observed_at timestamp")
    names = spark.createDataFrame([("s1", "Central"), ("s2", "Town Hall")], "stop_id string, station string")
    got = {r["incident_id"]: r for r in cases.cases(found, events, names, until="2026-06-11").collect()}
    assert set(got) == {"i", "j"}
    assert got["i"]["text"] == (
        "T1, 08:30 on Wednesday 10 June 2026 (local time). In the 30 minutes before, 2 services were observed. When last reported, 1 were more than five minutes late "
        "and the most delayed was 8 minutes behind. At some point in those 30 minutes, services were reported more than five minutes late at Central (2)."
    )
    assert got["j"]["text"].endswith("No T4 service was observed in the 30 minutes before.")
    meta = {r["incident_id"]: r["metadata"] for r in cases.passage_metadata(found).collect()}
    assert meta["i"]["citation"] == "Operator alert 0a1b2c3d (first seen 08:30 local time)" and meta["j"]["locator"] == "alerts x, y"
    line = cases.shown(spark.createDataFrame([(1, 0.5, "c", "a  b\n" + "x" * 300)], "rank int, score double, citation string, text string")).first()["line"]
    assert line.startswith("1. [+0.500] c\n   a b xx") and line.endswith("…")


def test_grids_and_fingerprint():
    grid = [{"max_depth": 3, "min_child_weight": 5, "learning_rate": 0.1}]
    assert cases.leaf_wise(grid)[0]["num_leaves"] == 8 and cases.symmetric(grid) == [{"depth": 3, "learning_rate": 0.1}]
    assert cases.prompt_fingerprint("a", {}) != cases.prompt_fingerprint("b", {}) and len(cases.prompt_fingerprint("a", {})) == 12


def test_pins(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    good = spark.createDataFrame([("a", "a.txt", hashlib.sha256(b"hello").hexdigest())], "document_key string, file string, sha256 string")
    assert bytes(corpus.pinned(spark, str(tmp_path / "*.txt"), good).first()["content"]) == b"hello"
    for bad in (good.withColumn("sha256", F.lit("0")), good.withColumn("file", F.lit("b.txt"))):
        with pytest.raises(corpus.CorpusError):
            corpus.pinned(spark, str(tmp_path / "*.txt"), bad)


def test_detectors_are_kept_whole(spark, tmp_path):
    rows = spark.createDataFrame([("T1" if i % 2 else "T4", float(i % 7), None if i % 5 == 0 else i * 1.0, i % 7 > 3) for i in range(80)], "line string, a double, b double, target boolean")
    fitted = fit_detector("logistic", rows, rows, ("a", "b"))
    artefacts.save_detector(fitted, str(tmp_path / "m"), spark, ["2026-06-10"])
    again, dates = artefacts.load_detector(str(tmp_path / "m"), spark)
    key = ["line", "a", "score", "flag"]
    assert dates == ["2026-06-10"] and sorted(map(str, again.score(rows).select(key).collect())) == sorted(map(str, fitted.score(rows).select(key).collect()))
    with pytest.raises(ValueError, match="not a delay"):
        artefacts.load_delay(str(tmp_path / "m"), spark)
    with pytest.raises(ValueError, match="one class"):
        fit_detector("logistic", rows.filter("target"), rows, ("a", "b"))
