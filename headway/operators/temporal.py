"""Event-time building blocks: latest wins, as-of joins, windows, dense grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.time import ceil_to, floor_to


#: Rows of one segment of an as-of join, about.
SEGMENT_ROWS = 200_000


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], first: bool = False) -> DataFrame:
    """The row of each key that is last (or first) in ``order``, which must be total for one result.

    An aggregation with map-side combining: no sort, and a hot key sends one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order)
    pick = F.min_by if first else F.max_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def asof_last(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: Sequence[str] = (), take: Sequence[str] = (), segment_s: int | None = None) -> DataFrame:
    """``left`` with the columns ``take`` of the last row of ``right`` at or before its time, else NULL.

    Rows of both sides are merged and the last one on the right is carried forward.  So that no key
    is one task, time is cut into segments: inside a segment the window carries, and each segment starts
    with the last row of the segments before it, which is found on one row a segment.  Segments are so short
    (a second at least) that one has about SEGMENT_ROWS rows of both sides.
    """
    if segment_s is None:
        sides = [df.agg(F.count("*").alias("n"), *[f(F.unix_seconds(F.col(ts).cast("timestamp"))).alias(k) for k, f in (("a", F.min), ("b", F.max))]).first() for df, ts in ((left, left_ts), (right, right_ts))]
        n = sum(r["n"] for r in sides)
        span = max((r["b"] for r in sides if r["n"] and r["b"] is not None), default=0) - min((r["a"] for r in sides if r["n"] and r["a"] is not None), default=0)
        segment_s = max(1, span * SEGMENT_ROWS // max(n, 1))
    value = F.struct(F.col(right_ts).alias("_at"), *[F.col(c) for c in take])
    r = right.select(*by, F.col(right_ts).alias("_ts"), value.alias("_r"), F.lit(0).alias("_side"), F.lit(None).alias("_l"))
    l = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns if c not in by]).alias("_l"))  # noqa: E741
    rows = r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)).unionByName(l)
    rows = rows.withColumn("_seg", F.floor(F.unix_micros(F.col("_ts").cast("timestamp")) / (segment_s * 1_000_000)))
    # One row a segment that holds anything: its last right row, carried over from the earlier ones.
    ends = rows.groupBy(*by, "_seg").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_ts", "_r"))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*by, "_seg", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    inside = Window.partitionBy(*by, "_seg").orderBy("_ts", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rows.withColumn("_last", F.last("_r", ignorenulls=True).over(inside)).filter("_side = 1")
    keys = [*by, "_seg"]
    same = [carried[k].eqNullSafe(starts[k]) for k in keys]
    joined = carried.join(starts, same, "left").select(*[carried[k] for k in by], "_l", F.coalesce("_last", "_start").alias("_found"))
    own = [F.col(c) if c in by else F.col("_l")[c].alias(c) for c in left.columns]
    return joined.select(*own, *[F.col("_found")[c].alias(c) for c in take])


def explode_windows(spans: DataFrame, start: str, end: str, seconds: int, out: str = "window_start") -> DataFrame:
    """A row for each window that a span touches, its first and last included: an equi-join replaces a range join."""
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    first, last = floor_to(F.col(start), seconds), floor_to(F.col(end), seconds)
    return spans.withColumn(out, F.explode(F.when(last >= first, F.sequence(first, last, step))))


def dense_grid(coverage: DataFrame, start: str, end: str, seconds: int, by: str, values: Sequence[str] | DataFrame, out: str = "window_start") -> DataFrame:
    """Every window in [start, end) of the one row of ``coverage``, for each of ``values``."""
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    times = coverage.select(F.explode(F.when(F.col(start) < F.col(end), F.sequence(F.col(start), F.col(end) - step, step))).alias(out))
    if isinstance(values, DataFrame):
        # One row for each distinct value: as an array it costs no join.
        values = values.agg(F.array_sort(F.collect_set(by)).alias("_all"))
        return times.join(F.broadcast(values)).select(F.explode("_all").alias(by), out)  # values: one row
    return times.select(F.explode(F.array(*[F.lit(v) for v in values])).alias(by), out)


def with_lags(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], steps: Sequence[int]) -> DataFrame:
    """``df`` with ``column_lag{k}`` of each column and step, in one sort."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in steps})


def coverage(first_polls: DataFrame, last_polls: DataFrame, ts: str, seconds: int) -> DataFrame:
    """One row: start (the first poll rounded up), end (the last of the others rounded down), longest gap in seconds."""
    a = first_polls.agg(ceil_to(F.min(ts), seconds).alias("start"))
    b = last_polls.agg(floor_to(F.max(ts), seconds).alias("end"))
    return a.join(F.broadcast(b)).join(F.broadcast(longest_gap(last_polls, ts)))


def longest_gap(polls: DataFrame, ts: str) -> DataFrame:
    """One row, gap_s: the longest time between neighbouring polls; hours are looked at side by side."""
    at = polls.select(F.unix_seconds(F.col(ts).cast("timestamp")).alias("s"))
    hour = F.floor(F.col("s") / 3600)
    w = Window.partitionBy("h").orderBy("s")
    inside = at.withColumn("h", hour).withColumn("g", F.col("s") - F.lag("s").over(w))
    hours = inside.groupBy("h").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.max("g").alias("g"))
    order = Window.orderBy("h")  # a row an hour
    return hours.withColumn("between", F.col("a") - F.lag("b").over(order)).agg(F.max(F.greatest("g", "between")).alias("gap_s"))


def as_of(df: DataFrame, at: Column, ts: str) -> DataFrame:
    """What was known at a moment: rows strictly before it."""
    return df.filter(F.col(ts) < at)
