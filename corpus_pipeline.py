"""From documents to packed sequences, in stages; each works on all that its predecessor kept.

Each stage takes documents with any further columns, also of names that operators use themselves, and gives
them back as they are (the last one gives pieces).  Null texts count as empty; an empty table stays empty.
Rows that repeat an id and a text are one document: the second stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import decontam, langid, packing, pii, simhash
from headway.llm.common import id_fold
from headway.llm.queries import vocabulary
from headway.session import remove, work_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from three of four labelled rows.

    Null texts and texts without a letter go, as do texts that are more like made-up ones than like any language
    learned.  Without a labelled row nothing is recognised.
    """
    return langid.recognised(docs, langid.train(docs, id_fold(F.col("doc_id"), 4) != 2))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are 0.8 alike or more: that of the least id,
    of one id's texts the one of the least hash.  Texts without words are alike."""
    return simhash.one_of_each(docs, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, unchanged; a null text is not."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data masked and n_chars brought into line; a null text stays null."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its sequence and place there; an empty text is one piece."""
    packed = packing.pack(packing.pieces(docs, vocabulary()))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each written to the shared folder and read again."""
    folder = work_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # nothing reads it any more
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
