"""Sessions with the settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from headway.config import ConfigError


def build_session(name: str = "headway", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` (dots as double underscores) override.

    Numbers of shuffle partitions are left to adaptive execution, which joins small ones and splits
    skewed ones, unless the caller sets them.
    """
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    own |= {k.replace("__", "."): str(v) for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=own).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    A session without one gets a folder of its own if all of it is one machine; on a cluster that is refused.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_headway_folder", None)
    if own is None:
        own = spark.sparkContext._headway_folder = tempfile.mkdtemp(prefix="headway-")
    return own


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: its lineage ends, and lost executors do not matter."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it is in; one that is not there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
