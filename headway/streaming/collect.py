"""Micro-batch collection: each batch is folded into a keyed table that keeps the latest observation.

The table is a folder of buckets by a hash of the key, and of manifests.  A batch reads the buckets that its
keys fall in, writes them anew below its own number, and then puts a manifest in place that names, for each
bucket, the number that holds it.  Buckets that a batch does not touch are neither read nor written.  A batch
that is run again after a failure writes the same files, and a reader never sees half of one.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from headway.operators.merge import fold_batch, guarded_upsert


class VersionedTable:
    """A keyed table in any store that Spark writes: ``data/v=N/b=K`` and ``manifests/N.json``."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2, buckets: int = 64):
        self.spark, self.path, self.keep, self.buckets = spark, path.rstrip("/"), keep, buckets

    def _fs(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Whole versions, in order: those with a manifest."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/manifests")):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(f"{self.path}/manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int) -> dict[int, int]:
        """Of each bucket that holds rows, the version that wrote it."""
        found = json.loads(self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0])
        return {int(k): v for k, v in found["buckets"].items()}

    def read(self, only: Sequence[int] | None = None) -> DataFrame | None:
        """The last version, or some of its buckets; none before the first."""
        known = self.versions()
        if not known:
            return None
        held = self.manifest(known[-1])
        paths = [f"{self.path}/data/v={v}/b={b}" for b, v in sorted(held.items()) if only is None or b in only]
        return self.spark.read.parquet(*paths) if paths else None

    def bucket(self, keys: Sequence[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def write(self, df: DataFrame, version: int, keys: Sequence[str]) -> None:
        """``df``, whole buckets, as part of a version; the other buckets stay what they are."""
        known = [v for v in self.versions() if v < version]
        held = self.manifest(known[-1]) if known else {}
        data = f"{self.path}/data/v={version}"
        placed = df.withColumn("b", self.bucket(keys))
        placed.hint("rebalance", F.col("b")).write.mode("overwrite").partitionBy("b").parquet(data)
        fs, path = self._fs()
        wrote = [int(f.getPath().getName()[2:]) for f in fs.listStatus(path(data)) if f.getPath().getName().startswith("b=")]
        held |= dict.fromkeys(wrote, version)
        draft, final = path(f"{self.path}/manifests/.{version}.tmp"), path(f"{self.path}/manifests/{version}.json")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"buckets": held}, sort_keys=True).encode()))
        stream.close()
        fs.delete(final, False)
        fs.rename(draft, final)
        self._forget()

    def _forget(self) -> None:
        """Deletes old manifests, and data that none of the others names."""
        fs, path = self._fs()
        known = self.versions()
        for old in known[: -self.keep]:
            fs.delete(path(f"{self.path}/manifests/{old}.json"), False)
        used = {(v, b) for k in known[-self.keep :] for b, v in self.manifest(k).items()}
        newest = known[-1]
        for folder in fs.listStatus(path(f"{self.path}/data")):
            v = int(folder.getPath().getName()[2:])
            own = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("b=")]
            if v < newest and not any((v, int(p.getName()[2:])) in used for p in own):
                fs.delete(folder.getPath(), True)


def merge_batch(table: VersionedTable, batch: DataFrame, batch_id: int, keys: Sequence[str], ts: str, tie: Sequence[str] = ()) -> None:
    """Folds one batch into the table; a batch number that is done already changes nothing."""
    known = table.versions()
    if known and known[-1] >= batch_id:
        return
    touched = [r[0] for r in batch.select(table.bucket(keys)).distinct().collect()]  # buckets' numbers
    stored = table.read(touched) if touched else None
    fresh = fold_batch(batch, keys, ts, tie) if stored is None else guarded_upsert(stored, batch, keys, ts, tie)
    table.write(fresh, batch_id, keys)


class CsvSnapshots:
    """A sink of plain files: a folder of each poll's rows, never changed; it takes no alerts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, df: DataFrame, version: int, keys: Sequence[str] = ()) -> None:  # noqa: ARG002
        df.write.mode("overwrite").option("header", True).csv(f"{self.path}/poll={version}")


class Sinks(VersionedTable):
    """The keyed table as a sink of everything: observations, statuses, and alerts."""

    def write_alerts(self, alerts: DataFrame, version: int) -> None:
        VersionedTable(self.spark, f"{self.path}-alerts", self.keep, self.buckets).write(alerts, version, ["alert_id"])


def sink_for(kind: str, spark: SparkSession, path: str):
    """The sink of a setting's name."""
    known = {"parquet": Sinks, "csv": CsvSnapshots}
    if kind not in known:
        raise ValueError(f"no sink {kind}; there are {', '.join(known)}")
    return known[kind](spark, path)


def alert_sink(sink):
    """The sink, if it takes alerts; else none: alerts are then not polled."""
    return sink if hasattr(sink, "write_alerts") else None


def poll_once(read: Callable[[], DataFrame], table: VersionedTable, poll: int, keys: Sequence[str], ts: str, log: Callable[[int, str], None], tie: Sequence[str] = ()) -> bool:
    """One poll: reads and folds in what came.  Nothing is raised; what went wrong is told, even to a log that fails."""
    try:
        merge_batch(table, read(), poll, keys, ts, tie)
        status = "ok"
    except Exception as e:  # noqa: BLE001  the next poll goes on
        status = f"error: {e}"
    with contextlib.suppress(Exception):
        log(poll, status)
    return status == "ok"


def polls_alerts(poll: int, every: int) -> bool:
    """Whether the poll of this number (from 0) is one of alerts too; never, if ``every`` is not positive."""
    return every > 0 and poll % every == 0


def collect(stream: DataFrame, table: VersionedTable, keys: Sequence[str], ts: str, checkpoint: str, tie: Sequence[str] = (), interval: str | None = None, log: Callable[[int, str], None] | None = None) -> StreamingQuery:
    """Starts collecting ``stream`` into ``table``; without an interval, what is there now and then ends.

    ``log`` is told of every batch; a batch that fails is told and stops the query, which starts again
    from the same batch.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        try:
            merge_batch(table, batch, batch_id, keys, ts, tie)
        except Exception as e:
            if log:
                log(batch_id, f"error: {e}")
            raise
        if log:
            log(batch_id, "ok")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def snapshots(spark: SparkSession, path: str, schema, kind: str = "parquet", files_a_batch: int | None = None) -> DataFrame:
    """A stream of the files of a folder as they appear, or of one file."""
    reader = spark.readStream.schema(schema).format(kind)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    if kind == "csv":
        reader = reader.option("header", True)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.load(path)


def late_counts(stream: DataFrame, ts: str, delay: str, window: str = "15 minutes", watermark: str = "1 hour", late_s: float = 300) -> DataFrame:
    """Services and late ones by line and window, as a stream: windows close when the watermark passes them."""
    return stream.withWatermark(ts, watermark).groupBy("line", F.window(ts, window).alias("w")).agg(
        F.count("*").alias("n_observations"), F.count_if(F.col(delay) > late_s).alias("n_late")
    ).select("line", F.col("w.start").alias("window_start"), "n_observations", "n_late")


class LatestWins(StatefulProcessor):
    """The guarded upsert as keyed state: (value, first, last, count), with an optional time to live."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "value double, first timestamp, last timestamp, n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, N802, N803
        """The rule of the guarded upsert: of a batch's rows only those later than the state count, each time
        once; of several at the last time the one of the greatest value is kept."""
        seen = self.state.get() if self.state.exists() else None
        last = pd.Timestamp(seen[2]) if seen else None
        times: set = set()
        best = None
        for pdf in rows:
            late = pdf if last is None else pdf[pdf["observed_at"] > last]
            if not len(late):
                continue
            times.update(late["observed_at"].unique())
            top = late[late["observed_at"] == late["observed_at"].max()]
            found = (top["observed_at"].iloc[0], float(top["value"].max()))
            best = found if best is None else max(best, found)
        if best is None and seen is None:
            return
        if best is not None:
            seen = (best[1], seen[1] if seen else pd.Timestamp(min(times)), best[0], (seen[3] if seen else 0) + len(times))
            self.state.update(tuple(seen))
        yield pd.DataFrame({"key": [key[0]], "value": [seen[0]], "first_seen": [seen[1]], "last_seen": [seen[2]], "observation_count": [seen[3]]})

    def close(self) -> None:
        pass
