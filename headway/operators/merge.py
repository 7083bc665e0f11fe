"""Keyed state: guarded latest-wins upserts, accumulated sets, as-of freezes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _moments(batch: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str]) -> DataFrame:
    """One row for each key and time of a batch: its values (_v), by ``tie`` where several came at once."""
    rest = [c for c in batch.columns if c not in keys and c != ts]
    value = F.struct(*rest) if rest else F.struct(F.lit(True).alias("_none"))
    return batch.groupBy(*keys, F.col(ts).alias("_t")).agg(F.max_by(value, F.struct(*tie) if tie else value).alias("_v"))


def _folded(moments: DataFrame, keys: Sequence[str], taken: Column) -> DataFrame:
    """One row a key of :func:`_moments`: the latest values, first and last time, and how many times are ``taken``."""
    return moments.groupBy(*keys).agg(F.max_by("_v", "_t").alias("_v"), F.min("_t").alias("first_seen_utc"), F.max("_t").alias("last_seen_utc"), F.count_if(taken).cast("long").alias("observation_count"))


def fold_batch(batch: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """One row a key as if the batch's rows had come in time order: the latest values, first_seen_utc,
    last_seen_utc and observation_count, the number of distinct times (an equal time changes nothing)."""
    rest = [c for c in batch.columns if c not in keys and c != ts]
    folded = _folded(_moments(batch, keys, ts, tie), keys, F.lit(True))
    return folded.select(*keys, *[F.col("_v")[c].alias(c) for c in rest], "first_seen_utc", "last_seen_utc", "observation_count")


def _same(a: str, b: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def _with_last(rows: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with _last, when their key was last seen by what is stored."""
    known = stored.select(*keys, F.col("last_seen_utc").alias("_last"))
    return rows.alias("r").join(known.alias("k"), _same("r", "k", keys), "left").select("r.*", "_last")


def guarded_upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """``stored`` after the batch.  A row counts only if it is strictly later than what is stored, so a
    replay changes nothing and late rows are rejected; the first time seen is kept.

    A key's times are counted by aggregation, never held together.
    """
    rest = [c for c in batch.columns if c not in keys and c != ts]
    moments = _with_last(_moments(batch, keys, ts, tie), stored, keys)
    fresh = _folded(moments, keys, F.col("_last").isNull() | (F.col("_t") > F.col("_last")))
    both = stored.alias("s").join(fresh.alias("f"), _same("s", "f", keys), "full")
    known, came = F.col("s.last_seen_utc").isNotNull(), F.col("f.last_seen_utc").isNotNull()
    wins = came & (~known | (F.col("f.last_seen_utc") > F.col("s.last_seen_utc")))
    return both.select(
        *[F.coalesce(F.col(f"s.{k}"), F.col(f"f.{k}")).alias(k) for k in keys],
        *[F.when(wins, F.col("f._v")[c]).otherwise(F.col(f"s.{c}")).alias(c) for c in rest],
        F.when(known, F.col("s.first_seen_utc")).otherwise(F.col("f.first_seen_utc")).alias("first_seen_utc"),
        F.when(wins, F.col("f.last_seen_utc")).otherwise(F.col("s.last_seen_utc")).alias("last_seen_utc"),
        (F.coalesce(F.col("s.observation_count"), F.lit(0)) + F.when(wins, F.col("f.observation_count")).otherwise(0)).cast("long").alias("observation_count"),
    )


def accumulated_list(stored: Column, new: Column) -> Column:
    """The union of two lists without repeats, the stored order first."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(stored, none), F.coalesce(new, none)))


def merge_status(stored: DataFrame, batch: DataFrame, keys: Sequence[str], ts: str, skips: str = "skipped_stop_ids", always: bool = False) -> DataFrame:
    """Trip statuses after the batch: guarded like observations, the skip list accumulated.

    New skips come in order of when they were first told; a key holds each of its stops once.  A rejected
    late row's new skips go with it, unless ``always``.
    """
    merged = guarded_upsert(stored.drop(skips), batch.drop(skips), keys, ts)
    told = _with_last(batch.select(*keys, F.col(ts).alias("_t"), F.posexplode(skips).alias("_i", "_stop")), stored, keys)
    if not always:
        told = told.filter(F.col("_last").isNull() | (F.col("_t") > F.col("_last")))
    each = told.groupBy(*keys, "_stop").agg(F.min(F.struct("_t", "_i")).alias("_at"))
    new = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_stop"))), lambda x: x["_stop"]).alias("_new"))
    out = merged.alias("m").join(new.alias("n"), _same("m", "n", keys), "left").select("m.*", "_new")
    out = out.alias("m").join(stored.select(*keys, F.col(skips).alias("_old")).alias("o"), _same("m", "o", keys), "left").select("m.*", "_old")
    rest = [c for c in merged.columns if c not in (*keys, "first_seen_utc", "last_seen_utc", "observation_count")]
    return out.select(*keys, *rest, accumulated_list(F.col("_old"), F.col("_new")).alias(skips), "first_seen_utc", "last_seen_utc", "observation_count")


def replace_by_key(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``batch`` in place of the stored rows of its keys (poll logs)."""
    return stored.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(batch)


def freeze(rows: DataFrame, cutoff_date: str, cutoff: Column, date_col: str | None = None, seen: str | None = None, first: str | None = None, clip: str | None = None, clip_at: Column | None = None) -> DataFrame:
    """What a store held at a cut-off: no later service dates, nothing first seen at or after the instant,
    and times last seen clipped."""
    if date_col:
        rows = rows.filter(F.col(date_col) <= cutoff_date)
    if seen:
        rows = rows.filter(F.col(seen) < cutoff)
    if first:
        rows = rows.filter(F.col(first) < cutoff)
    if clip:
        rows = rows.withColumn(clip, F.least(F.col(clip), cutoff if clip_at is None else clip_at))
    return rows
