"""Fitted models against what their definitions say, computed apart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.operators import evalstats, models, retrieval


def _rows(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.choice([None, rng.random() * 10])
        z = 1.5 * a + (0.4 * (b - 5) if b is not None else 0) + rng.gauss(0, 1)
        rows.append((rng.choice(["T1", "T4"]), a, b, z > 0.5, "train" if i < 200 else "validation"))
    return spark.createDataFrame(rows, "line string, a double, b double, target boolean, split string")


def test_logistic_regression_is_where_its_gradient_is_zero(spark):
    rows = _rows(spark)
    train, held = (rows.filter(F.col("split") == s) for s in ("train", "validation"))
    found = models.fit_detector("logistic", train, held, ("a", "b"))
    fitted = found.model.stages[-1]
    out = found.model.transform(models.prepared(train, ("a", "b"))).select("features", "probability", "target").collect()
    x, y = np.array([r["features"].toArray() for r in out]), np.array([r["target"] for r in out], float)
    w, c = fitted.coefficients.toArray(), fitted.intercept
    p = 1 / (1 + np.exp(-(x @ w + c)))
    assert np.allclose(p, [r["probability"][1] for r in out])
    spread = x.std(axis=0, ddof=1)
    reg = fitted.getRegParam()
    gradient = x.T @ (p - y) / len(y) + reg * w * spread**2
    assert np.abs(gradient[spread > 0]).max() < 2e-3 and abs((p - y).mean()) < 2e-3


def test_the_candidate_of_the_best_precision_is_taken(spark):
    rows = _rows(spark)
    train, held = (rows.filter(F.col("split") == s) for s in ("train", "validation"))
    found = models.fit_detector("logistic", train, held, ("a", "b"))
    scored = [(r["score"], r["target"]) for r in found.score(held).select("score", "target").collect()]
    total = sum(y for _, y in scored)
    ap, best = 0.0, (-1.0, 0.0)
    for s in sorted({s for s, _ in scored}, reverse=True):
        flagged = [y for x, y in scored if x >= s]
        ap += sum(flagged) / len(flagged) * sum(y for x, y in scored if x == s) / total
        best = max(best, (2 * sum(flagged) / (len(flagged) + total), s))
    assert found.validation_ap == pytest.approx(ap)
    lower = max((s for s, _ in scored if s < best[1]), default=0.0)
    assert found.threshold == pytest.approx((best[1] + lower) / 2)
    everywhere = found.score(rows).collect()
    assert all(r["flag"] == (r["score"] >= found.threshold) for r in everywhere)


def test_refuses_what_can_not_be_learned(spark):
    rows = _rows(spark, 40)
    with pytest.raises(ValueError, match="one class"):
        models.fit_detector("logistic", rows.withColumn("target", F.lit(True)), rows, ("a",))
    with pytest.raises(ValueError, match="no positive"):
        models.fit_detector("logistic", rows, rows.withColumn("target", F.lit(False)), ("a",))


def test_boosted_trees_end_by_the_validation_rows(spark, monkeypatch):
    rows = _rows(spark)
    train, held = (rows.filter(F.col("split") == s) for s in ("train", "validation"))
    monkeypatch.setitem(models.DETECTORS, "boosted", (models.DETECTORS["boosted"][0], ({"maxDepth": 2},)))
    found = models.fit_detector("boosted", train, held, ("a", "b"))
    trees = found.model.stages[-1]
    assert 1 <= trees.getNumTrees < models.ROUNDS
    scored = evalstats.average_precision(evalstats.score_curve(found.score(held), "score", "target")).first()[0]
    assert scored == pytest.approx(found.validation_ap) and scored > 0.6


def test_embedding_is_the_embedder_s(spark):
    texts = ["the river", "", None, "stone lamp lamp"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r["i"]: r["vector"] for r in retrieval.embed(df, "text", batch=7).collect()}
    want = retrieval.hashing_embedder([t or "" for t in texts])
    assert all(np.allclose(got[i], want[i]) for i in range(len(texts)))
    q = want[0]
    best = retrieval.top_k(retrieval.embed(df, "text").withColumnRenamed("i", "id"), q, 3).collect()
    assert [r["id"] for r in best] == [0, 4, 8] and best[0]["score"] == pytest.approx(1.0)
