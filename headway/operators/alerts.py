"""Alerts to incidents: a rule picks them, republications chain into one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.text import cause_group, classify
from headway.operators.graph import connected_components

UNKNOWN = "UNKNOWN_CAUSE"
REPUBLISH_GAP_S = 35 * 60


def with_lines(alerts: DataFrame, scopes: DataFrame, lines: list[str] | None = None) -> DataFrame:
    """Alerts with the sorted lines that their scopes name; alerts of none are left out."""
    own = scopes.filter(F.col("route_short_name").isNotNull() if lines is None else F.col("route_short_name").isin(lines))
    named = own.groupBy("alert_id").agg(F.array_sort(F.collect_set("route_short_name")).alias("lines"))
    return alerts.withColumn("cause", F.coalesce("cause", F.lit(UNKNOWN))).join(named, "alert_id")


def audited(alerts: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Alerts with is_incident and reason."""
    said = why = None
    if overrides is not None:
        reason = F.col("reason") if "reason" in overrides.columns else F.lit("")
        alerts = alerts.join(overrides.select("alert_id", F.col("is_incident").alias("_said"), reason.alias("_why")), "alert_id", "left")
        said, why = F.col("_said"), F.col("_why")
    presence = F.unix_seconds(F.col("last_seen").cast("timestamp")) - F.unix_seconds(F.col("first_seen").cast("timestamp"))
    verdict = classify(F.col("cause"), F.col("header_text"), F.col("description_text"), presence, said, why)
    return alerts.withColumn("_v", verdict).select(*[c for c in alerts.columns if c not in ("_said", "_why")], "_v.is_incident", "_v.reason")


#: Time slots, in gaps, that hand-overs are looked for in side by side.
SLOT_GAPS = 8
#: A table that was counted is sent to all executors if it has so many rows at most.
SMALL_ROWS = 100_000
#: Parts that an incident's ids are sorted in side by side.
ID_PARTS = 16


def _counted(df: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``df``, counted, and sent to all executors by joins if it is small."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= SMALL_ROWS else held


def chains(alerts: DataFrame, gap_s: int = REPUBLISH_GAP_S, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(alert_id, chain): chains of alerts of one line and one cause that hand over to each other; rows may repeat.

    Two alerts hand over if one leaves within the gap of the other's coming and both have one cause or an
    unknown one, which counts among every cause.  In a cell of time as wide as the gap every end is near
    every beginning, so a cell that has both is of one chain and is looked at by its first and last end and
    beginning only; an aggregation finds these.  Cells of one kind keep all their points.  Along time, the ends
    and beginnings of a line and a cause fall apart only where no end and beginning on either side are near
    enough: between lie others of either kind, which are then near enough to one of the two.  So chains are
    runs of neighbours.  They are found in time slots side by side, each with the cells next to its borders, and
    numbered from the breaks of the slots before.  An alert is in a chain for each of its lines and causes, by its
    end and by its beginning.  With ``cut`` cells and slots are gone through once.
    """
    gap = gap_s * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    causes = alerts.select("cause").distinct().agg(F.collect_set("cause").alias("_all"))  # a row; causes are an enum's names
    among = F.explode(F.when(F.col("cause") == UNKNOWN, F.col("_all")).otherwise(F.array("cause"))).alias("among")
    ends = F.explode(F.array(F.struct(micros("first_seen").alias("t"), F.lit(True).alias("begins")), F.struct(micros("last_seen").alias("t"), F.lit(False).alias("begins"))))
    points = alerts.join(F.broadcast(causes)).select("alert_id", F.explode("lines").alias("line"), "cause", "_all", ends.alias("e"))
    # Whole numbers, rounded down before 1970 too: no cell is wider than the gap.
    points = points.select("alert_id", "line", among, "e.*").withColumn("cell", F.expr(f"(t - pmod(t, {gap})) DIV {gap}"))
    keys = ["line", "among", "cell"]
    corner = lambda f, begins: f(F.when(F.col("begins") == begins, F.col("t")))
    found = points.groupBy(*keys).agg(corner(F.min, False).alias("e0"), corner(F.max, False).alias("e1"), corner(F.min, True).alias("b0"), corner(F.max, True).alias("b1"))
    mixed = _counted(found.filter("e0 IS NOT NULL AND b0 IS NOT NULL"), cut)
    corners = F.explode(F.array(*[F.struct(F.col(c).alias("t"), F.lit(c[0] == "b").alias("begins")) for c in ("e0", "e1", "b0", "b1")])).alias("e")
    whole = mixed.select(F.lit(None).cast(points.schema["alert_id"].dataType).alias("alert_id"), *keys, corners).select("alert_id", *keys, "e.*", F.lit(True).alias("whole"))
    looked = points.join(mixed.select(*keys), keys, "left_anti").select("alert_id", *keys, "t", "begins", F.lit(False).alias("whole")).unionByName(whole)
    slot = lambda c: f"({c} - pmod({c}, {SLOT_GAPS})) DIV {SLOT_GAPS}"
    near = F.explode(F.array_distinct(F.array(*[F.expr(slot(c)) for c in ("cell", "(cell - 1)", "(cell + 1)")]))).alias("slot")
    placed = looked.select("*", near).withColumn("own", F.col("slot") == F.expr(slot("cell")))
    order = Window.partitionBy("line", "among", "slot").orderBy("t", "begins", "alert_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Backwards, as a frame up to the last row would be read anew for each row.
    back = Window.partitionBy("line", "among", "slot").orderBy(F.desc("t"), F.desc("begins"), F.desc("alert_id"))
    behind = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda begins: F.max(F.when(F.col("begins") == begins, F.col("t"))).over(before)
    following = lambda begins: F.min(F.when(F.col("begins") == begins, F.col("t"))).over(behind)
    held = (following(True) - last(False) <= gap) | (following(False) - last(True) <= gap)
    marked = placed.withColumn("break", F.when(F.coalesce(held, F.lit(False)), 0).otherwise(1)).filter("own")
    inside = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = cut(marked.withColumn("k", F.sum("break").over(inside)).select("alert_id", *keys, "whole", "slot", "k").distinct())
    breaks = numbered.groupBy("line", "among", "slot").agg(F.max("k").alias("n"))
    earlier = Window.partitionBy("line", "among").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a slot
    starts = breaks.select("line", "among", "slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    others = Window.orderBy("line", "among").rowsBetween(Window.unboundedPreceding, -1)  # a row a line and cause
    firsts = breaks.groupBy("line", "among").agg(F.sum("n").alias("n")).select("line", "among", F.coalesce(F.sum("n").over(others), F.lit(0)).alias("base"))
    named = numbered.join(starts.join(firsts, ["line", "among"]), ["line", "among", "slot"]).select("alert_id", *keys, "whole", (F.col("base") + F.col("start") + F.col("k")).alias("chain"))
    cells = _counted(named.filter("whole").groupBy(*keys).agg(F.min("chain").alias("chain")), cut)
    return named.filter("NOT whole").select("alert_id", "chain").unionByName(points.join(cells, keys).select("alert_id", "chain"))


def incidents(alerts: DataFrame, cut: Callable[[DataFrame], DataFrame], gap_s: int = REPUBLISH_GAP_S) -> DataFrame:
    """One row an incident: its alerts, lines, span, cause and group, and an id made of its alerts' ids.

    Only chains that an alert links to others, by another line, cause or time, are a matter of components.
    An incident's ids are sorted in parts; one task merges the sorted parts.
    """
    each = chains(alerts, gap_s, cut)
    first = cut(each.groupBy("alert_id").agg(F.min("chain").alias("a"), F.max("chain").alias("z")))
    links = each.join(_counted(first.filter("a < z")), "alert_id").select("a", F.col("chain").alias("b"))
    found = _counted(connected_components(links, cut))
    own = first.join(found, first["a"] == found["vertex"], "left").select("alert_id", F.coalesce("component", "a").alias("_found"))
    rows = alerts.join(own, "alert_id", "left").withColumn("_c", F.coalesce(F.col("_found").cast("string"), F.concat(F.lit("alone|"), "alert_id")))
    order = F.struct((F.col("cause") == UNKNOWN).alias("u"), "first_seen", "alert_id", "cause")
    parts = rows.groupBy("_c", F.pmod(F.xxhash64("alert_id"), F.lit(ID_PARTS)).alias("_part")).agg(
        F.sort_array(F.collect_set("alert_id")).alias("ids"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.array_distinct(F.flatten(F.collect_set("lines"))).alias("lines"), F.min(order).alias("least"),
    )
    grouped = parts.groupBy("_c").agg(
        F.sort_array(F.flatten(F.collect_list("ids"))).alias("alert_ids"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"), F.min("least")["cause"].alias("cause"),
    )
    out = grouped.withColumns({"cause_group": cause_group(F.col("cause")), "incident_id": F.concat(F.lit("inc-"), F.substring(F.sha2(F.array_join("alert_ids", ",").cast("binary"), 256), 1, 10))})
    return out.select("incident_id", "alert_ids", "lines", "cause", "cause_group", "first_seen", "last_seen")


def line_spans(alerts: DataFrame, found: DataFrame) -> DataFrame:
    """(incident_id, line, start, end) by line: an alert marks only the lines that it names itself."""
    member = found.select("incident_id", F.explode("alert_ids").alias("alert_id"))
    each = alerts.join(member, "alert_id").select("incident_id", F.explode("lines").alias("line"), "first_seen", "last_seen")
    return each.groupBy("incident_id", "line").agg(F.min("first_seen").alias("start"), F.max("last_seen").alias("end"))


def passages(alerts: DataFrame, found: DataFrame) -> DataFrame:
    """One text an incident: a header line, then its alerts' distinct pieces in time order.

    A piece stands where it first occurs; only that is collected of the pieces that alerts repeat.
    """
    member = found.select("incident_id", F.explode("alert_ids").alias("alert_id"))
    said = F.array(F.trim("header_text"), F.trim("description_text"))
    pieces = alerts.select("alert_id", "first_seen", said.alias("t")).join(member, "alert_id").select("*", F.posexplode("t").alias("k", "piece")).filter("piece <> ''")
    firsts = pieces.groupBy("incident_id", "piece").agg(F.min(F.struct("first_seen", "alert_id", "t", "k")).alias("at"))
    texts = firsts.groupBy("incident_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]).alias("_p"))
    head = F.concat(F.lit("Lines "), F.array_join("lines", ", "), F.lit(" from "), F.date_format("first_seen", "yyyy-MM-dd HH:mm"))
    body = F.coalesce(F.array_join("_p", "\n"), F.lit(""))
    return found.join(texts, "incident_id", "left").withColumn("text", F.concat_ws("\n", head, body)).drop("_p")
