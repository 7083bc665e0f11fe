"""Pinned documents: their digests checked, their pages as rows."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.text import normalise


class CorpusError(ValueError):
    """A document is not the one that was pinned."""


def pinned(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """Files (of ``binaryFile``) with the document_key of their name; refuses a missing one and a changed one.

    ``pins``: document_key, file, sha256.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.sha2("content", 256).alias("_found"))
    both = pins.join(files, "file", "left")
    wrong = both.filter(F.col("_found").isNull() | (F.col("_found") != F.col("sha256"))).select("document_key", "_found").collect()  # a row a pinned file that is wrong
    if wrong:
        raise CorpusError("; ".join(f"{r[0]} is {'missing' if r[1] is None else 'another file: sha256 ' + r[1]}" for r in wrong))
    return both.drop("_found")


def pages(documents: DataFrame, least: int = 120) -> DataFrame:
    """(document_key, page from 1, text) of PDF contents; shorter pages are left out.  Needs pypdf on the executors."""

    def run(batches):
        import pandas as pd

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise CorpusError("reading PDF pages needs pypdf on every executor") from e
        for pdf in batches:
            rows = [(k, n, p.extract_text() or "") for k, c in zip(pdf["document_key"], pdf["content"], strict=True) for n, p in enumerate(PdfReader(io.BytesIO(c)).pages, 1)]
            yield pd.DataFrame(rows, columns=["document_key", "page", "text"])

    raw = documents.select("document_key", "content").mapInPandas(run, "document_key string, page int, text string")
    return raw.withColumn("text", normalise(F.col("text"))).filter(F.length("text") >= least)
