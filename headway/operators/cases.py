"""Incidents as cases to explain: what was seen when they began, in words, with citations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.time import ZONE, local, spoken_date, spoken_time

ERAS = 3


def eras_for(dates: DataFrame, bundles: DataFrame, date: str = "service_date", name: str = "bundle", most: int = ERAS) -> DataFrame:
    """Of each date the newest timetables fetched by then (named ..._YYYYMMDD), with bundle_rank from 0.

    Timetables are a few a month: as one sorted list, each date takes what was there, newest first.
    """
    fetched = bundles.select(F.struct(F.regexp_extract(name, r"_([0-9]{8})", 1).alias("day"), F.col(name).alias("name")).alias("b")).filter("b.day <> ''").distinct()
    listed = fetched.agg(F.sort_array(F.collect_list("b"), asc=False).alias("_all"))  # one row
    known = dates.select(date).distinct().join(F.broadcast(listed))
    taken = F.slice(F.filter("_all", lambda b: b["day"] <= F.regexp_replace(date, "-", "")), 1, most)
    return known.select(date, F.posexplode(taken).alias("bundle_rank", "_b")).select(date, F.col("_b.name").alias(name), "bundle_rank")


def short_ids(alert_ids: Column) -> Column:
    return F.array_join(F.transform(alert_ids, lambda x: F.substring(x, 1, 8)), ", ")


def citation(alert_ids: Column, first_seen: Column, publisher: str = "Operator", zone: str = ZONE) -> Column:
    """Such as: Operator alerts 0a1b2c3d, 4e5f6a7b (first seen 08:30 local time)."""
    noun = F.when(F.size(alert_ids) == 1, " alert ").otherwise(" alerts ")
    return F.concat(F.lit(publisher), noun, short_ids(alert_ids), F.lit(" (first seen "), spoken_time(first_seen, zone), F.lit(" local time)"))


def passage_metadata(found: DataFrame, document_key: str = "alerts") -> DataFrame:
    """Incidents with the metadata map that a search filters by and an answer cites."""
    pairs = {
        "document_key": F.lit(document_key), "locator": F.concat(F.lit("alerts "), short_ids(F.col("alert_ids"))), "citation": citation(F.col("alert_ids"), F.col("first_seen")),
        "incident_id": F.col("incident_id"), "alert_ids": F.array_join("alert_ids", ","), "lines": F.array_join("lines", ","), "cause": F.col("cause"), "cause_group": F.col("cause_group"),
        "first_seen_ts": F.unix_seconds(F.col("first_seen").cast("timestamp")).cast("string"), "last_seen_ts": F.unix_seconds(F.col("last_seen").cast("timestamp")).cast("string"),
    }
    return found.withColumn("metadata", F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]))


def describe(lines: Column, at: Column, minutes: int, services: Column, late: Column, worst_s: Column, stations: Column, zone: str = ZONE) -> Column:
    """A situation in words; ``stations``: array of (station, n).  Rounds halves to even, as the figures' readers do."""
    who = F.array_join(lines, " and ")
    head = F.concat(who, F.lit(", "), spoken_time(at, zone), F.lit(" on "), spoken_date(at, zone), F.lit(" (local time)."))
    none = F.concat(F.lit("No "), who, F.lit(f" service was observed in the {minutes} minutes before."))
    seen = F.concat(F.lit(f"In the {minutes} minutes before, "), services.cast("string"), F.lit(" services were observed."))
    behind = F.when(worst_s > 0, F.concat(F.lit(" and the most delayed was "), F.bround(worst_s / 60).cast("long").cast("string"), F.lit(" minutes behind"))).otherwise("")
    last = F.concat(F.lit("When last reported, "), late.cast("string"), F.lit(" were more than five minutes late"), F.coalesce(behind, F.lit("")), F.lit("."))
    named = F.array_join(F.transform(stations, lambda s: F.concat(s["station"], F.lit(" ("), s["n"].cast("string"), F.lit(")"))), ", ")
    where = F.when(F.size(stations) > 0, F.concat(F.lit(f"At some point in those {minutes} minutes, services were reported more than five minutes late at "), named, F.lit(".")))
    return F.when(services == 0, F.concat_ws(" ", head, none)).otherwise(F.concat_ws(" ", head, seen, last, where))


def cases(found: DataFrame, events: DataFrame, stations: DataFrame, since: str | None = None, until: str | None = None, lookback_s: int = 1800, late_s: float = 300, k: int = 5, zone: str = ZONE) -> DataFrame:
    """Incidents first seen on local dates in [since, until), with what was seen of their lines just before, and as text.

    Events meet incidents by line and hour.
    """
    day = F.date_format(local(F.col("first_seen"), zone), "yyyy-MM-dd")
    picked = found
    if since is not None:
        picked = picked.filter(day >= since)
    if until is not None:
        picked = picked.filter(day < until)
    t = F.unix_seconds(F.col("first_seen").cast("timestamp"))
    slots = picked.select("incident_id", t.alias("_t"), F.explode("lines").alias("line")).withColumn("_h", F.explode(F.sequence(F.floor((F.col("_t") - lookback_s) / 3600), F.floor(F.col("_t") / 3600))))
    when = F.unix_seconds(F.col("observed_at").cast("timestamp"))
    seen = slots.join(events.withColumn("_s", when).withColumn("_h", F.floor(when / 3600)), ["line", "_h"]).filter((F.col("_s") >= F.col("_t") - lookback_s) & (F.col("_s") < F.col("_t")))
    last = seen.groupBy("incident_id", "line", "service_date", "trip_id").agg(F.max_by("delay_s", F.struct("observed_at", "delay_s")).alias("d"))
    counts = last.groupBy("incident_id").agg(F.count("*").alias("services"), F.count_if(F.col("d") > late_s).alias("late"), F.max("d").alias("worst"))
    late_at = seen.filter(F.col("delay_s") > late_s).join(stations, "stop_id").select("incident_id", "station", "service_date", "trip_id").distinct().groupBy("incident_id", "station").agg(F.count("*").alias("n"))
    order = Window.partitionBy("incident_id").orderBy(F.desc("n"), "station")
    top = late_at.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("incident_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "station", "n"))), lambda x: F.struct(x["station"].alias("station"), x["n"].alias("n"))).alias("stations"))
    out = picked.join(counts, "incident_id", "left").join(top, "incident_id", "left").fillna(0, ["services", "late"])
    out = out.withColumn("stations", F.coalesce("stations", F.array().cast(top.schema["stations"].dataType)))
    return out.withColumn("text", describe(F.col("lines"), F.col("first_seen"), lookback_s // 60, F.col("services"), F.col("late"), F.col("worst"), F.col("stations"), zone))


def shown(hits: DataFrame, width: int = 220) -> DataFrame:
    """Search hits as lines: rank, score with its sign, citation, and the beginning of the text."""
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    cut = F.when(F.length(plain) > width, F.concat(F.substring(plain, 1, width), F.lit("…"))).otherwise(plain)
    return hits.select("rank", F.format_string("%d. [%+.3f] %s\n   %s", F.col("rank"), F.col("score"), F.col("citation"), cut).alias("line"))


def prompt_fingerprint(prompt: str, schema: dict) -> str:
    """Twelve digits that change with a judge's prompt or its answer's schema."""
    return hashlib.sha256((prompt + json.dumps(schema, sort_keys=True)).encode()).hexdigest()[:12]


def leaf_wise(grid: Sequence[dict]) -> list[dict]:
    """Depth-wise candidates for a leaf-wise learner: as many leaves as a tree of that depth can have."""
    return [c | {"num_leaves": 1 << c["max_depth"], "min_child_samples": c["min_child_weight"]} for c in grid]


def symmetric(grid: Sequence[dict]) -> list[dict]:
    """The same for a learner of symmetric trees, which has no least leaf."""
    return [{"depth": c["max_depth"], "learning_rate": c["learning_rate"]} for c in grid]
