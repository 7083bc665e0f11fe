"""Passages: cutting, embedding, an index with a fingerprint, guarded cosine search."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.errors import EmbeddingError, StaleIndexError

TARGET = 1000
OVERLAP = 150
WIDTH = 64


#: Blanks between sentences: behind an end mark, before a capital or a digit.
_BETWEEN = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")


def _filled(parts: Iterator[str] | Sequence[str], glue: str, target: int) -> Iterator[list[str]]:
    """Runs of parts that, joined by ``glue``, stay within the target; a longer part is a run of its own."""
    run: list[str] = []
    size = 0
    for part in parts:
        if run and size + len(glue) + len(part) > target:
            yield run
            run, size = [], 0
        size += len(part) + (len(glue) if run else 0)
        run.append(part)
    if run:
        yield run


def passages_of(text: str | None, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Passages of about ``target`` characters: whole paragraphs, else whole sentences, else cut; each
    begins with the tail of the one before."""
    units: list[str] = []
    for paragraph in (p.strip() for p in (text or "").split("\n\n")):
        if len(paragraph) <= target:
            units += [paragraph] if paragraph else []
            continue
        for run in _filled(_BETWEEN.split(paragraph), " ", target):
            joined = " ".join(run).strip()
            units += [joined[i : i + target] for i in range(0, len(joined), target)]
    out: list[str] = []
    now = ""
    for unit in units:
        if now and len(now) + 2 + len(unit) > target:
            out.append(now)
            now = now[-overlap:] if overlap > 0 else ""
        now = f"{now}\n\n{unit}".strip() if now else unit
    return [*out, now] if now.strip() else out


def chunk(df: DataFrame, text_col: str = "text", target: int = TARGET, overlap: int = OVERLAP, least: int = 0) -> DataFrame:
    """``df`` without its text, with chunk_no and chunk; texts shorter than ``least`` have none."""

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: passages_of(t, target, overlap) if t is not None and len(t) >= least else [])

    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(cut(F.col(text_col))).alias("chunk_no", "chunk"))


def hashing_embedder(texts: Sequence[str], width: int = WIDTH) -> np.ndarray:
    """A stand-in that needs no model: signed hashed words, of length 1."""
    out = np.zeros((len(texts), width), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            out[i, h % width] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed(df: DataFrame, text_col: str, embedder: Callable[[Sequence[str]], np.ndarray] = hashing_embedder, batch: int = 128, width: int = WIDTH) -> DataFrame:
    """``df`` with vector; counts and widths of what the embedder returns are checked."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out: list = []
            for i in range(0, len(s), batch):
                part = s.iloc[i : i + batch].fillna("").tolist()
                got = np.asarray(embedder(part))
                if got.shape != (len(part), width):
                    raise EmbeddingError(f"{len(part)} texts gave vectors of shape {got.shape}, not {(len(part), width)}")
                out += got.astype(np.float32).tolist()
            yield pd.Series(out, dtype=object)

    return df.withColumn("vector", run(F.col(text_col)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(index: DataFrame, query: Sequence[float], k: int, vector: str = "vector", where: Column | None = None, tie: str = "id") -> DataFrame:
    """The k rows most like one query vector, filtered first, with score and rank; an exact scan whose tasks
    keep k rows each."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = index if where is None else index.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    best = rows.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), tie)))  # k rows


def top_k_for(queries: DataFrame, index: DataFrame, k: int, vector: str, id_col: str, guard: Callable[[Column, Column], Column] | None = None, block: int = 4096, guarded_block: int = 256, beside: Sequence[str] = ()) -> DataFrame:
    """For each row of a set of queries, the k rows of the index most like it: query, id, score, rank.

    Queries go in blocks of bounded size (the index is scanned once a block), each sent to every task, which
    keeps its own best k of each query by numpy; only those are shuffled.  ``guard`` takes (query id, index id) and keeps pairs; it may
    look at the columns ``beside`` of the index.
    """
    spark = index.sparkSession
    rows = index.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), *beside)
    blocks: list[list] = [[]]
    for r in queries.select(F.col(id_col).cast("long"), F.col(vector).cast("array<float>")).toLocalIterator():
        if len(blocks[-1]) == (block if guard is None else guarded_block):
            blocks.append([])
        blocks[-1].append(r)
    found = None
    for part in blocks:
        if not part:
            continue
        names = np.array([r[0] for r in part])
        m = np.array([r[1] for r in part], np.float64)
        sent = spark.sparkContext.broadcast((names, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)))

        guarded = guard is not None
        seen = rows.withColumn("ok", F.array(*[F.coalesce(guard(F.lit(r[0]), F.col("id")), F.lit(False)) for r in part])).drop(*beside) if guarded else rows

        def run(batches, sent=sent, guarded=guarded):
            names, q = sent.value
            kept: list[list] = [[] for _ in names]
            for pdf in batches:
                if not len(pdf):
                    continue
                ids = pdf["id"].to_numpy()
                v = np.array(pdf["v"].tolist(), np.float64)
                v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)).T
                ok = np.array(pdf["ok"].tolist(), bool) if guarded else None
                for i in range(len(names)):
                    if i % 64 == 0:  # scores of some queries at a time
                        s = q[i : i + 64] @ v
                    row = s[i % 64]
                    good = np.flatnonzero((ids != names[i]) & ok[:, i] if guarded else ids != names[i])
                    top = good[np.lexsort((ids[good], -row[good]))[:k]]
                    kept[i] = sorted(kept[i] + [(-row[j], ids[j]) for j in top])[:k]
            out = [(names[i], x, -s) for i, each in enumerate(kept) for s, x in each]
            yield pd.DataFrame(out, columns=["query", "id", "score"])

        got = seen.mapInPandas(run, "query long, id long, score double")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "query long, id long, score double, rank int")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def guards(seen_before: int | None = None, exclude: str | None = None, document: str | None = None) -> Column | None:
    """What a search at a moment may see: passages first seen in an earlier second, not the case itself."""
    parts = []
    if document is not None:
        parts.append(F.col("document_key") == document)
    if seen_before is not None:
        parts.append(F.col("first_seen_ts") < int(seen_before))
    if exclude is not None:
        parts.append(F.col("incident_id") != exclude)
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def build_index(chunks: DataFrame, path: str, fingerprint: dict, id_col: str = "id") -> None:
    """Writes the index and its fingerprint; empty input and repeated ids are refused."""
    if chunks.isEmpty():
        raise ValueError("no passages: nothing to index")
    if not chunks.groupBy(id_col).count().filter("count > 1").isEmpty():
        raise ValueError(f"{id_col} repeats")
    chunks.write.mode("overwrite").parquet(f"{path}/passages")
    chunks.sparkSession.createDataFrame([(json.dumps(fingerprint, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/fingerprint")


def stale_reasons(found: dict, expected: dict) -> list[str]:
    """What an index was built with that is not as expected, in words."""
    return [f"{k} is {found.get(k)!r}, not {v!r}" for k, v in sorted(expected.items()) if found.get(k) != v]


def open_index(spark, path: str, expected: dict) -> DataFrame:
    """The passages, unless the index was built with other settings."""
    found = json.loads(spark.read.text(f"{path}/fingerprint").first()[0])
    if stale := stale_reasons(found, expected):
        raise StaleIndexError("build the index again: " + "; ".join(stale))
    return spark.read.parquet(f"{path}/passages")


def similarity(distance: Column) -> Column:
    """Of a cosine distance."""
    return 1 - distance
