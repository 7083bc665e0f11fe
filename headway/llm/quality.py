"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Each text becomes a row of transformed statistics (logarithms of sizes, log-odds of shares).  Means
and covariances of both classes come from sums over all labelled training rows, made on the
executors; covariances are shrunk towards their pooled matrix and its mean variance.  A score is the
logistic of a calibrated difference of log-densities, from Mahalanobis distances by Cholesky factors
that are inverted once.  Calibration uses the differences of training rows that the densities were not
fitted on (a tenth of them, by a hash of the id), as counts in fixed bins.

Null and empty texts are the row of statistics of the empty text.  Without labelled rows of both
classes every score is the share of label 1 (0.5 without any).  Very long texts are read whole.
A document with several labels counts once for each; repeated documents repeat; a score that is the
threshold predicts 1; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import cut, prepare

FEATURES = (
    "words", "word_length", "word_length_spread", "upper", "digits", "marks", "symbols", "bars", "breaks", "beyond_ascii",
    "distinct", "top_word", "repeats", "line_repeats", "mark_ends", "short_words",
)
#: Weights of the pooled covariance and of its mean variance in a class covariance.
SHRINK_POOLED = 0.10
SHRINK_ROUND = 0.02
#: One labelled row in so many calibrates.
KEPT = 10
_BINS = 400
_SPAN = 60.0

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in ".,;:!?'\"()-":
    _CLASS[ord(_c)] = 3
for _c in "#$%&*+/<=>@[\\]^_`{}~":
    _CLASS[ord(_c)] = 4
_CLASS[ord("|")] = 5
_CLASS[ord("\n")] = 6
_CLASS[0x80:] = 7
_MARKS = tuple(bytes([c]) for c in b".,;:!?#$%&*|")


def _odds(share: float, n: float) -> float:
    """Log-odds of a share of n things, with half a thing on either side."""
    p = (share * n + 0.5) / (n + 1)
    return float(np.log(p / (1 - p)))


def statistics(text: bytes | None) -> list[float]:
    data = text or b""
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=8) if n else np.zeros(8, np.int64)
    words = data.split()
    m = len(words)
    sizes = np.fromiter(map(len, words), np.int64, m)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = sum(w.endswith(_MARKS) for w in words)
    # A long text repeats more of its words; against its length's power the share says more.
    usual = m ** 0.9 if m else 1.0
    return [
        float(np.log1p(m)),
        float(np.log1p(sizes.mean() if m else 0)),
        float(np.log1p(sizes.std() if m else 0)),
        *[_odds(kinds[k] / n if n else 0, n) for k in range(1, 8)],
        float(np.log((len(counts) + 1) / (usual + 1))),
        _odds(max(counts.values(), default=0) / m if m else 0, m),
        _odds(again / m if m else 0, m),
        _odds(1 - len(set(lines)) / len(lines) if lines else 0, len(lines)),
        _odds(ends / m if m else 0, m),
        _odds(float((sizes <= 3).mean()) if m else 0, m),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the row of FEATURES, of every whole text."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Discriminant:
    """Log-density differences by cached inverse Cholesky factors."""

    means: np.ndarray
    inverse: np.ndarray  # of each class's Cholesky factor
    constant: np.ndarray  # log prior less half the log determinant
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.inverse[k].T
            density.append(self.constant[k] - 0.5 * (z * z).sum(axis=1))
        return np.clip(density[1] - density[0], -1e6, 1e6)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.difference(x), -_SPAN, _SPAN) + self.shift, -500, 500)))


def _sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of each label: rows, sums and cross products; each task sends one row a label."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                t = total.setdefault(k, [0.0, np.zeros(d), np.zeros((d, d))])
                t[0] += len(own)
                t[1] += own.sum(axis=0)
                t[2] += own.T @ own
        for k, (n, s, c) in total.items():
            yield pa.RecordBatch.from_pydict({"label": pa.array([k], pa.int32()), "sums": pa.array([[n, *s, *c.ravel()]], pa.list_(pa.float64()))})

    parts = rows.select("x", F.col("label").cast("int")).mapInArrow(run, "label int, sums array<double>")
    out = {}
    each = parts.select("label", F.posexplode("sums").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v"))
    for row in each.collect():  # two labels times the statistics and their pairs
        out.setdefault(row["label"], np.zeros(1 + d + d * d))[row["i"]] = row["v"]
    return {k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in out.items()}


def fit(rows: DataFrame, pooled: float = SHRINK_POOLED, rounded: float = SHRINK_ROUND) -> Discriminant | float:
    """A discriminant of ``rows`` (x, label 0 or 1, and kept: whether for calibration only); a constant score
    where a class has no two rows."""
    rows = cut(rows)
    sums = _sums(rows.filter("NOT kept"))
    n = np.array([sums[k][0] if k in sums else 0.0 for k in (0, 1)])
    if n.min() < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    means = np.stack([sums[k][1] / n[k] for k in (0, 1)])
    own = np.stack([sums[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)])
    both = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(both), 1e-6))
    inverse, constant = [], []
    for k in (0, 1):
        c = (1 - pooled) * own[k] + pooled * both
        c = (1 - rounded) * c + rounded * np.diag(scale * scale)
        factor = np.linalg.cholesky(c + 1e-9 * np.eye(len(c)))
        inverse.append(np.linalg.inv(factor))
        constant.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    model = Discriminant(means, np.stack(inverse), np.array(constant))
    kept = rows.filter("kept")
    both = kept.agg(F.countDistinct("label")).first()[0] == 2
    model.slope, model.shift = _calibrate(kept if both else rows, model)
    return model


def _calibrate(rows: DataFrame, model: Discriminant) -> tuple[float, float]:
    """Slope and shift of the logistic of clipped differences, from counts in bins."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _BINS))
        for batch in batches:
            if batch.num_rows:
                z = np.clip(model.difference(batch.column(0).flatten().to_numpy().reshape(-1, d)), -_SPAN, _SPAN)
                at = np.minimum(((z + _SPAN) * _BINS / (2 * _SPAN)).astype(int), _BINS - 1)
                np.add.at(total, (batch.column(1).to_numpy(zero_copy_only=False), at), 1)
        k, i = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"label": pa.array(k, pa.int32()), "at": pa.array(i, pa.int32()), "n": pa.array(total[k, i].astype(np.int64))})

    counts = np.zeros((2, _BINS))
    got = rows.select("x", F.col("label").cast("int")).mapInArrow(run, "label int, at int, n long").groupBy("label", "at").agg(F.sum("n").alias("n"))
    for row in got.collect():  # two labels times the bins
        counts[row["label"], row["at"]] = row["n"]
    z = (np.arange(_BINS) + 0.5) * 2 * _SPAN / _BINS - _SPAN
    return logistic(z, counts)


def logistic(z: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope (over 0) and shift of the logistic that gives ``counts`` (of label 0 and 1 at each ``z``) the most likelihood.

    Labels are taken as if one more row of the other were seen, so that the slope is bounded where z parts the
    labels wholly.  Newton steps on z in units of its range, halved as long as they do not help.
    """
    unit = max(1.0, float(np.abs(z).max()))
    x = np.column_stack([z / unit, np.ones(len(z))])
    n, m = counts[0].sum(), counts[1].sum()
    every = counts.sum(axis=0)
    target = (counts[0] / (n + 2) + counts[1] * (m + 1) / (m + 2)) / np.maximum(every, 1)

    def loss(w: np.ndarray) -> float:
        return float((every * (np.logaddexp(0, x @ w) - target * (x @ w))).sum() + 0.5e-6 * (w @ w))

    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 0.5 * (1 + np.tanh(x @ w / 2))
        g = x.T @ (every * (p - target)) + 1e-6 * w
        step = np.linalg.solve((x * (every * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), g)
        share = 1.0
        while share > 1e-9 and loss(w - share * step) > loss(w):
            share /= 2
        w = w - share * step
        if np.abs(share * step).max() < 1e-9:
            break
    return max(float(w[0]) / unit, 1e-3), float(w[1])


def quality_scores(docs: DataFrame, labels: DataFrame, trains: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, score and predicted of every document; learns from labelled rows where ``trains``
    (an expression over ``doc_id``) holds."""
    spark = prepare(docs.sparkSession)
    stats = cut(document_statistics(docs, id_col, text_col))
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    model = fit(stats.join(marked, "doc_id").filter(trains).select("x", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(KEPT)) == 0).alias("kept")))
    sent = spark.sparkContext.broadcast(model)
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            s = np.full(len(x), own) if isinstance(own, float) else own.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
