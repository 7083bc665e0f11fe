"""Detectors where the training windows are of one class, or the validation windows have no positive one."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from headway.operators import evalstats, models
from headway.plans import catalogue

QUERIES = catalogue.queries()


def _windows(spark, n=120):
    rng = random.Random(5)
    rows = [(rng.choice(["T1", "T4"]), a := rng.gauss(0, 1), a + rng.gauss(0, 1) > 0.5) for _ in range(n)]
    return spark.createDataFrame(rows, "line string, a double, target boolean")


@pytest.fixture(scope="module")
def quiet(spark, tmp_path_factory):
    """Events of ten days with windows of six services, none of which is late: as large tables, whose windows are all alike."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=30 * (i // 2)), i % 7, ("click", "error")[i % 2], float(i % 50), "{}") for i in range(960)]
    folder = str(tmp_path_factory.mktemp("quiet"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("kind", ["logistic", "boosted", "forest"])
@pytest.mark.parametrize("seen", [True, False, None])
def test_one_class_gives_its_share(spark, kind, seen):
    rows = _windows(spark)
    train = rows.withColumn("target", F.lit(seen).cast("boolean"))
    for held in (rows, rows.filter("false")):
        found = models.fit_detector(kind, train, held, ("a",), lone=True)
        got = {(r["score"], r["flag"]) for r in found.score(rows).select("score", "flag").collect()}
        assert got == {(1.0 if seen else 0.0, bool(seen))}
    share = rows.filter("target").count() / rows.count()
    assert models.fit_detector(kind, train, rows, ("a",), lone=True).validation_ap == pytest.approx(share)


def test_without_a_positive_validation_row_the_first_candidate_is_taken(spark):
    rows = _windows(spark)
    found = models.fit_detector("logistic", rows, rows.filter("NOT target"), ("a",), lone=True)
    assert found.model.stages[-1].getRegParam() == models.DETECTORS["logistic"][1][0]["regParam"]
    assert (found.threshold, found.validation_ap) == (0.5, None)
    assert evalstats.average_precision(evalstats.score_curve(found.score(rows), "score", "target")).first()[0] > 0.6


def test_where_both_classes_are_nothing_changes(spark):
    rows = _windows(spark)
    one, two = (models.fit_detector("logistic", rows, rows, ("a",), lone=x) for x in (False, True))
    assert (one.threshold, one.validation_ap) == (two.threshold, two.validation_ap)


def test_ablation_detect(spark, quiet):
    got = [tuple(r) for r in QUERIES["ablation_detect"](spark, quiet).collect()]
    assert got == [("all", None), ("without alert_in_feed", None)]


@pytest.mark.parametrize("name", ["boosted_detect", "forest_detect", "logit_detect"])
def test_detect(name, spark, quiet):
    got = QUERIES[name](spark, quiet).collect()
    assert len(got) == 160 and {(r["score"], r["flag"]) for r in got} == {(0.0, False)}


def test_kept_detector(spark, quiet):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{quiet}/events.parquet/*.parquet')")
    want = con.execute(catalogue.oracle_sql()["kept_detector"]).fetchall()
    assert [tuple(r) for r in QUERIES["kept_detector"](spark, quiet).select("rows", "different", "flags_agree").collect()] == want == [(160, 0, True)]
