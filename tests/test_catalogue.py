"""Every query that SQL can express gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from headway.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"forest_detect", "logit_detect", "boosted_detect", "gbt_delay", "ablation_detect", "delay_model", "kept_detector"}
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in got.fetchall())
    assert rows == want


@pytest.mark.parametrize("name", ["logit_detect", "boosted_detect", "gbt_delay", "delay_model"])
def test_models_run(name, spark, sf_dir):
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert rows
    if name == "gbt_delay":
        assert rows[0]["mae"] <= rows[0]["mae"] / rows[0]["mase"] * 1.05  # no worse than the guess by the call before
    if name == "delay_model":
        by = {r["guess"]: r for r in rows}
        assert by["model"]["mae"] < by["persistence"]["mae"] and by["persistence"]["mase"] == 1.0 and 0.8 <= by["model"]["inside"] <= 1
    if name.endswith("_detect"):
        # The flag is the score against one threshold, whatever the part of the data.
        flagged, others = ([r["score"] for r in rows if r["flag"] == f] for f in (True, False))
        assert all(0 <= r["score"] <= 1 for r in rows) and (not flagged or not others or min(flagged) >= max(others) - 1e-6)


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 1200 and "target" in df.columns
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_gbt_delay_tries_the_whole_grid(spark, sf_dir, monkeypatch):
    from headway.operators import models
    from headway.plans import catalogue

    class Called(Exception):
        pass

    def fit(*args, **how):
        assert not {"grid", "rounds"} & set(how) and len(args) <= 5
        raise Called

    monkeypatch.setattr(models, "fit_delay", fit)
    with pytest.raises(Called):
        catalogue.queries()["gbt_delay"](spark, sf_dir)
