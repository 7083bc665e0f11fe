import numpy as np
from pyspark.sql import functions as F

from headway.llm import quality
from headway.llm.common import id_fold


def _auc(pairs):
    order = sorted(pairs)
    ranks = {i: r + 1 for r, i in enumerate(range(len(order)))}
    pos = [ranks[i] for i, (_, y) in enumerate(order) if y == 1]
    n1, n0 = len(pos), len(order) - len(pos)
    return (sum(pos) - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = id_fold(F.col("doc_id"), 5) == 0
    rows = quality.quality_scores(docs, labels, ~held).join(labels, "doc_id").filter(held).select("score", "quality").collect()
    assert _auc([(r[0], r[1]) for r in rows]) > 0.97


def test_scores_equal_brute_force(spark):
    """Densities by determinants and inverses of the shrunk covariances, from all labelled rows at once."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = id_fold(F.col("doc_id"), 5) == 0
    rows = docs.join(labels, "doc_id", "left").select("doc_id", "text", "quality", held.alias("held"), (F.pmod(F.xxhash64("doc_id"), F.lit(quality.KEPT)) == 0).alias("kept")).collect()
    x = np.array([quality.statistics((r["text"] or "").encode()) for r in rows])
    y = np.array([-1 if r["quality"] is None else r["quality"] for r in rows])
    used = (y >= 0) & ~np.array([r["held"] for r in rows])
    kept = np.array([r["kept"] for r in rows])
    own = {k: x[used & ~kept & (y == k)] for k in (0, 1)}
    n = {k: len(own[k]) for k in (0, 1)}
    cov = {k: np.cov(own[k].T, bias=True) for k in (0, 1)}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    logs = []
    for k in (0, 1):
        c = 0.9 * cov[k] + 0.1 * pooled
        c = 0.98 * c + 0.02 * np.diag(np.maximum(np.diag(pooled), 1e-6))
        z = x - own[k].mean(axis=0)
        logs.append(np.log(n[k]) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    difference = logs[1] - logs[0]
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels, ~held).collect()}
    score = np.array([got[r["doc_id"]]["score"] for r in rows])
    # Scores are a logistic of the difference: its two numbers from two rows, all other rows must lie on it.
    logit = np.log(score / (1 - score))
    inside = np.flatnonzero((np.abs(difference) < 50) & (np.abs(logit) < 20))
    a, b = inside[difference[inside].argmin()], inside[difference[inside].argmax()]
    slope = (logit[b] - logit[a]) / (difference[b] - difference[a])
    assert slope > 0 and len(inside) > 100
    assert np.abs(logit[inside] - (logit[a] + slope * (difference[inside] - difference[a]))).max() < 1e-3
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    # Calibrated: of held-out rows, the mean score is near the share of label 1.
    out = (y >= 0) & ~used
    assert abs(score[out].mean() - y[out].mean()) < 0.1


def test_logistic_is_the_best_of_a_grid():
    rng = np.random.default_rng(3)
    z = np.linspace(-60, 60, 41)
    for true in (0.02, 0.2, 5.0):
        p = 1 / (1 + np.exp(-np.clip(true * (z - 7), -50, 50)))
        counts = np.stack([rng.binomial(50, 1 - p), rng.binomial(50, p)]).astype(float)
        a, b = quality.logistic(z, counts)
        n, m = counts.sum(axis=1)
        y = (counts[0] / (n + 2) + counts[1] * (m + 1) / (m + 2)) / counts.sum(axis=0)
        loss = lambda a, b: (counts.sum(axis=0) * (np.logaddexp(0, a * z + b) - y * (a * z + b))).sum()  # noqa: B023, E731
        assert all(loss(a, b) <= loss(a * f, b + g) + 1e-6 for f in (0.9, 0.99, 1, 1.01, 1.1) for g in (-0.3, -0.01, 0, 0.01, 0.3))


def test_one_class_or_no_labels_give_a_constant(odd_docs, spark):
    ones = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(odd_docs, ones, F.lit(True)).collect()
    assert len(got) == odd_docs.count() and {r["score"] for r in got} == {1.0}
    none = quality.quality_scores(odd_docs, ones.limit(0), F.lit(True)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_null_equals_empty_and_empty_table(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] * 2, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(odd_docs, labels, F.lit(True)).collect()}
    assert got[0] == got[1] and all(0 <= s <= 1 for s in got.values())
    assert quality.quality_scores(no_docs, labels, F.lit(True)).count() == 0
