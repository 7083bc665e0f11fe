"""Summaries of stores, audits, passages and judgements."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.text import GROUPS, statements


def store_status(rows: DataFrame, ts: str, by: str) -> DataFrame:
    """Rows, first and last time, of each group."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def recent(rows: DataFrame, ts: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The last n rows: a report, of which each task keeps n."""
    return rows.orderBy(F.desc(ts), *[F.desc(t) for t in tie]).limit(n)


def incident_windows(labels: DataFrame) -> DataFrame:
    """How many windows each incident marks, and on how many lines."""
    each = labels.select("line", "window_start", F.explode("incident_ids").alias("incident_id"))
    return each.groupBy("incident_id").agg(F.count("*").alias("windows"), F.count_distinct("line").alias("lines"))


def label_flips(compared: DataFrame, a: str = "disrupted", b: str = "disrupted_check") -> DataFrame:
    """Windows by both labels, unknown ones included."""
    return compared.groupBy(a, b).agg(F.count("*").alias("windows"))


def nearest_to_firing(labels: DataFrame, needed: Column) -> DataFrame:
    """Of each line, the window that lacks the fewest late services."""
    gap = (needed - F.col("n_late")).alias("gap")
    return labels.filter("NOT disrupted").groupBy("line").agg(F.min_by(F.struct("window_start", gap), F.struct(gap, "window_start")).alias("w")).select("line", "w.window_start", "w.gap")


def split_report(rows: DataFrame, split: str = "split", target: str = "target") -> DataFrame:
    """Rows, known targets and positive ones of each part."""
    return rows.groupBy(split).agg(F.count("*").alias("rows"), F.count(target).alias("known"), F.count_if(F.col(target)).alias("positive"))


def group_counts(rows: DataFrame, group: str, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Rows of every group, those without any included."""
    names = rows.sparkSession.createDataFrame([(g,) for g in groups], "g string")
    counts = rows.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"))
    return names.join(counts, "g", "left").select(F.col("g").alias(group), F.coalesce("n", F.lit(0)).alias("n"))


def unknown_overrides(overrides: DataFrame, alerts: DataFrame) -> DataFrame:
    return overrides.join(alerts.select("alert_id").distinct(), "alert_id", "left_anti")


def passage_summary(chunks: DataFrame, document: str, size: str = "n_chars") -> DataFrame:
    """Passages of each document, their least, upper median and greatest length.

    The upper median is the smallest length that more than half of the passages do not exceed.  Lengths are
    counted first: a document has few different ones.
    """
    counts = chunks.groupBy(document, size).agg(F.count("*").alias("c"))
    own = Window.partitionBy(document)
    up_to = F.sum("c").over(own.orderBy(size).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumns({"_up": up_to, "_n": F.sum("c").over(own)})
    return ranked.groupBy(document).agg(
        F.max("_n").alias("passages"), F.min(size).alias("least"), F.min(F.when(F.col("_up") > F.floor(F.col("_n") / 2), F.col(size))).alias("median"), F.max(size).alias("most")
    )


def crosswise(rows: DataFrame, by: str, group: str, most: int = 1000) -> DataFrame:
    """Counts by ``by`` with a column for each group that occurs; more than ``most`` groups are refused."""
    names = [r[0] for r in rows.select(group).distinct().orderBy(group).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"{group} has over {most} values")
    return rows.groupBy(by).pivot(group, names).count().fillna(0)


def importance(features: Sequence[str], weights: Sequence[float]) -> list[tuple[str, float]]:
    """Each feature's share of all weight, largest first; nothing to share gives shares of 0."""
    total = float(sum(weights))
    shares = [(f, w / total if total else 0.0) for f, w in zip(features, weights, strict=True)]
    return sorted(shares, key=lambda x: (-x[1], x[0]))


def judged(answers: DataFrame, judge: Callable[[str, str], bool | None], id_col: str = "answer_id", text_col: str = "answer", evidence_col: str = "evidence") -> DataFrame:
    """A row for each statement of each answer with the judge's verdict; a judge that fails gives NULL."""
    rest = [c for c in answers.columns if c not in (text_col,)]
    each = answers.select(*rest, F.posexplode(statements(F.col(text_col))).alias("i", "statement")).withColumn("statement_id", F.concat_ws("#", id_col, "i")).drop("i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            verdicts: list[bool | None] = []
            for s, e in zip(pdf["statement"], pdf[evidence_col], strict=True):
                try:
                    verdicts.append(judge(s, e))
                except Exception:  # noqa: BLE001  any failure of a judge is one without a verdict
                    verdicts.append(None)
            yield pdf.assign(supported=pd.array(verdicts, dtype="boolean"))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in each.schema)
    return each.mapInPandas(run, f"{names}, supported boolean")


def faithfulness(rows: DataFrame, supported: str = "supported", by: Sequence[str] = ()) -> DataFrame:
    """Share of supported statements among those with a verdict, and how many have none."""
    parts = [F.count("*").alias("statements"), F.count_if(F.col(supported).isNull()).alias("failed"), F.avg(F.col(supported).cast("double")).alias("faithful")]
    return rows.groupBy(*by).agg(*parts) if by else rows.agg(*parts)


def evidence_ids(text: Column) -> Column:
    """Ids named in the headings ``[alerts a, b]`` of a text, each once, in order."""
    heads = F.regexp_extract_all(text, F.lit(r"\[alerts ([^\]]*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(heads, lambda h: F.regexp_extract_all(h, F.lit(r"\b[0-9a-f]{8}\b"), F.lit(0)))))


def unsupported_citations(cited: Column, shown: Column) -> Column:
    """Ids that an answer cites but was not shown."""
    return F.array_except(cited, shown)
