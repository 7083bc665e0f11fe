"""What the text operators share: shipping code to executors, batches of bounded size, lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.session import cut  # noqa: F401  the operators take it from here

#: Rows and bytes of one Arrow batch at most; a batch of long documents then fits in a Python worker.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make Python workers able to import this package, and bound their Arrow batches."""
    sc = spark.sparkContext
    if not getattr(sc, "_headway_shipped", False):
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="headway-"), "headway.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        sc.addPyFile(target)
        sc._headway_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def trim() -> None:
    """Gives memory that nothing holds back to the system, where the C library has a call for that."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches: Iterator) -> Iterator:
    """``batches``; after the last one the Python worker, which waits for other tasks, gives its memory back."""
    try:
        yield from batches
    finally:
        trim()


def release(spark: SparkSession) -> None:
    """Lets the driver see which shuffles nothing needs any more, so that their files are deleted now and not at
    its next collection, and gives memory that nothing holds back to the system."""
    trim()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores after it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that an operator's own are about to replace."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])
