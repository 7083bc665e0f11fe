"""Scores of detectors, delay models, retrieval and judges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detection_scores(rows: DataFrame, flag: Column, target: Column, date: str) -> DataFrame:
    """One row: counts, precision, recall, F1 and false alarms a day; NULL where nothing is to divide by."""
    known = rows.filter(target.isNotNull())
    out = known.agg(
        F.count_if(flag & target).alias("tp"), F.count_if(flag & ~target).alias("fp"), F.count_if(~flag & target).alias("fn"),
        F.count_if(flag).alias("flagged"), F.count_if(target).alias("positive"), F.count_distinct(date).alias("dates"),
    )
    return out.withColumns(
        {
            "precision": F.try_divide("tp", "flagged"),
            "recall": F.try_divide("tp", "positive"),
            "f1": F.try_divide(2 * F.col("tp"), F.col("flagged") + F.col("positive")),
            "false_alarms_a_day": F.try_divide("fp", "dates"),
        }
    )


def score_curve(rows: DataFrame, score: str, target: str, buckets: int = 256) -> DataFrame:
    """A row for each distinct score, from the highest: its rows and positives, and those down to it.

    Running sums go by bands of scores: bands start from totals of the bands above, and each band is
    summed by itself, so no task sorts the whole table.
    """
    each = rows.filter(F.col(target).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.count_if(F.col(target)).alias("p"))
    ends = each.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    band = F.least(F.floor(F.coalesce(F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * buckets), F.lit(buckets - 1))
    banded = each.join(F.broadcast(ends)).withColumn("band", band).drop("lo", "hi")
    totals = banded.groupBy("band").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)  # a row a band
    starts = totals.select("band", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("sn"), F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("sp"))
    inside = Window.partitionBy("band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return banded.withColumns({"cn": F.sum("n").over(inside), "cp": F.sum("p").over(inside)}).join(F.broadcast(starts), "band").select("score", "n", "p", (F.col("cn") + F.col("sn")).alias("flagged"), (F.col("cp") + F.col("sp")).alias("tp"))


def average_precision(curve: DataFrame) -> DataFrame:
    """One row: the step-wise average precision; NULL without positives."""
    return curve.agg(F.try_divide(F.sum(F.col("tp") / F.col("flagged") * F.col("p")), F.sum("p")).alias("average_precision"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """One row: the threshold of the best F1 (the higher of equal ones), halfway to the next lower score
    (half the lowest score if there is none); 0.5 without rows."""
    total = curve.agg(F.sum("p").alias("positives"))
    scored = curve.join(F.broadcast(total)).withColumn("f1", F.try_divide(2 * F.col("tp"), F.col("flagged") + F.col("positives")))
    best = scored.agg(F.max_by(F.struct("score", "f1"), F.struct("f1", "score")).alias("b")).select(F.col("b.score").alias("score"), F.col("b.f1").alias("f1"))
    below = curve.select(F.col("score").alias("lower")).join(F.broadcast(best), F.col("lower") < F.col("score")).agg(F.max("lower").alias("lower"))
    half = F.coalesce((F.col("score") + F.coalesce("lower", F.lit(0.0))) / 2, F.lit(0.5))
    return best.join(F.broadcast(below)).select(half.alias("threshold"), "f1")


def regression_scores(rows: DataFrame, truth: str, guess: str, naive: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE over non-zero truths with its coverage, and MAE against a naive guess (NULL if that is exact)."""
    error = F.col(guess) - F.col(truth)
    share = F.when(F.col(truth) != 0, F.abs(error) / F.abs(F.col(truth)))
    parts = [
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(share).alias("mape"), F.avg((F.col(truth) != 0).cast("double")).alias("mape_coverage"),
    ]
    if naive:
        parts.append(F.try_divide(F.avg(F.abs(error)), F.avg(F.abs(F.col(naive) - F.col(truth)))).alias("mase"))
    return rows.groupBy(*by).agg(*parts) if by else rows.agg(*parts)


def percentiles(rows: DataFrame, value: str | Column, shares: Sequence[float], by: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """by, share and value: the interpolated percentiles of each group, exactly; a group without values has none.

    Distinct values are counted, and their ranks found in bands of values as in :func:`score_curve`, so no
    task holds or sorts all of a group's values.
    """
    v = F.col(value) if isinstance(value, str) else value
    each = rows.select(*by, v.cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    whole = each.groupBy(*by).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"w.{k}")) for k in by]
    sized = each.alias("e").join(whole.alias("w") if by else F.broadcast(whole).alias("w"), on or None).select("e.*", "_n", "_lo", "_hi")
    band = F.least(F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * buckets), F.lit(buckets - 1))
    banded = sized.withColumn("_band", band)
    totals = banded.groupBy(*by, "_band").agg(F.sum("_c").alias("_bc"))
    before = Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)  # a row a band
    starts = totals.select(*by, "_band", F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*by, "_band")]
    ranked = banded.withColumn("_up", F.sum("_c").over(inside)).alias("b").join(starts.alias("s"), same).select("b.*", (F.col("_up") + F.col("_start")).alias("_to"))
    wanted = ranked.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares]))).withColumn("_at", F.col("share") * (F.col("_n") - 1))
    holds = lambda k: (F.col("_to") - F.col("_c") <= k) & (k < F.col("_to"))
    ends = wanted.groupBy(*by, "share").agg(
        F.max("_at").alias("_at"), F.max(F.when(holds(F.floor("_at")), F.col("_v"))).alias("_a"), F.max(F.when(holds(F.ceil("_at")), F.col("_v"))).alias("_b")
    )
    part = F.col("_at") - F.floor("_at")
    return ends.select(*by, "share", F.when(part == 0, F.col("_a")).otherwise((1 - part) * F.col("_a") + part * F.col("_b")).alias("value"))


def residual_percentiles(rows: DataFrame, truth: str, guess: str, shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """One row a share: the interpolated percentile of guess - truth."""
    return percentiles(rows, F.col(guess) - F.col(truth), shares).withColumnRenamed("value", "residual")


def conformal_widths(scores: DataFrame, bin_col: str, value: str, alpha: float = 0.1) -> DataFrame:
    """Of each bin and of all (bin NULL): n and the ceil((n + 1)(1 - alpha))-th smallest score (NULL: none so large).

    The rank is found on counts of distinct scores, in bands as in :func:`score_curve`.
    """
    each = scores.groupBy(F.col(bin_col).alias("bin"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    both = each.withColumn("all", F.lit(False)).unionByName(each.groupBy("v").agg(F.sum("c").alias("c")).select(F.lit(None).cast(each.schema["bin"].dataType).alias("bin"), "v", "c", F.lit(True).alias("all")))
    sized = both.groupBy("all", "bin").agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rank = F.ceil((F.col("n") + 1).cast("double") * F.lit(1 - alpha)).cast("long")
    rows = both.alias("x").join(sized.withColumn("rank", rank).alias("s"), (F.col("x.all") == F.col("s.all")) & F.col("x.bin").eqNullSafe(F.col("s.bin")))
    band = F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * 255)
    banded = rows.select("x.all", "x.bin", "v", "c", "n", "rank", band.alias("band"))
    totals = banded.groupBy("all", "bin", "band").agg(F.sum("c").alias("bc"))
    below = Window.partitionBy("all", "bin").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("all", "bin", "band", F.coalesce(F.sum("bc").over(below), F.lit(0)).alias("start"))
    inside = Window.partitionBy("all", "bin", "band").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = banded.withColumn("cum", F.sum("c").over(inside)).alias("b").join(starts.alias("t"), (F.col("b.all") == F.col("t.all")) & F.col("b.bin").eqNullSafe(F.col("t.bin")) & (F.col("b.band") == F.col("t.band")))
    return summed.groupBy("b.all", "b.bin", "n", "rank").agg(F.min(F.when(F.col("cum") + F.col("start") >= F.col("rank"), F.col("v"))).alias("width")).select("all", "bin", "n", "width")


def lateness_band(prev: Column) -> Column:
    """Half-open bands of the delay at the stop before."""
    return F.when(prev.isNull(), "first stop").when(prev <= 60, "<=60").when(prev <= 300, "60-300").otherwise(">300")


def coverage_table(rows: DataFrame, segment: str, inside: Column, width: Column) -> DataFrame:
    """n, share inside and median half-width of each segment and of all, worst first."""
    named = rows.select(F.explode(F.array(F.col(segment), F.lit("all"))).alias("segment"), inside.cast("double").alias("inside"), width.alias("width"))
    middle = percentiles(named, "width", (0.5,), ["segment"]).select(F.col("segment").alias("_s"), F.col("value").alias("median_width"))
    counted = named.groupBy("segment").agg(F.count("*").alias("n"), F.avg("inside").alias("share_inside"))
    out = counted.join(middle, F.col("segment").eqNullSafe(F.col("_s")), "left").drop("_s")
    return out.select("segment", "n", "share_inside", "median_width").orderBy("share_inside", "segment")


def date_draws(dates: DataFrame, resamples: int = 2000, seed: int = 0, date: str = "date") -> DataFrame:
    """(resample, date, times): how often each of the table's dates is in each resample of all dates with replacement.

    The dates, in order, are numbered; the j-th draw of a resample is the number that the digest of
    ``seed-resample-j`` gives.  As many rows as resamples times dates at most; dates are days.
    """
    days = dates.select(F.col(date).alias("date")).distinct()
    numbered = days.withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1)
    n = days.count()
    if not n:
        return dates.sparkSession.createDataFrame([], "resample int, date string, times long")
    name = F.concat_ws("-", F.lit(str(seed)), F.col("resample").cast("string"), F.col("j").cast("string"))
    each = dates.sparkSession.range(resamples).select(F.col("id").cast("int").alias("resample"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    drawn = each.select("resample", (F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long") % n).cast("int").alias("_i"))
    return drawn.groupBy("resample", "_i").agg(F.count("*").alias("times")).join(numbered, "_i").select("resample", "date", "times")


def bootstrap_by_date(by_date: DataFrame, draws: DataFrame, sums: Sequence[str], metric: Callable[..., Column]) -> DataFrame:
    """One row: 2.5 and 97.5 percentiles over resamples of ``metric`` of the weighted sums, and the share defined.

    ``by_date``: a row a date with additive columns, so each resample costs a row a date, not the data again.
    """
    joined = draws.join(by_date, "date")
    each = joined.groupBy("resample").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in sums]).select(metric(*[F.col(c) for c in sums]).alias("m"))
    return each.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg(F.col("m").isNotNull().cast("double")).alias("defined"))  # a row a resample


def lead_times(incidents: DataFrame, flags: DataFrame, before_s: int = 3600, after_s: int = 900) -> DataFrame:
    """Incidents (incident_id, line, alert, last_seen) with the first flag (line, flag_end) from an hour before
    the alert to a quarter of an hour after its end, and lead_s; NULL if missed.  Hours meet by equality."""
    a = F.unix_seconds(F.col("alert").cast("timestamp")) - before_s
    b = F.unix_seconds(F.col("last_seen").cast("timestamp")) + after_s
    slots = incidents.withColumns({"_a": a, "_b": b}).withColumn("_h", F.explode(F.sequence(F.floor(F.col("_a") / 3600), F.floor(F.col("_b") / 3600))))
    at = F.unix_seconds(F.col("flag_end").cast("timestamp"))
    keyed = flags.select("line", at.alias("_t"), F.floor(at / 3600).alias("_h"))
    first = slots.join(keyed, ["line", "_h"]).filter(F.col("_t").between(F.col("_a"), F.col("_b"))).groupBy("incident_id", "line").agg(F.min("_t").alias("_t"))
    return incidents.join(first, ["incident_id", "line"], "left").withColumn("lead_s", F.unix_seconds(F.col("alert").cast("timestamp")) - F.col("_t")).drop("_t")


def lead_summary(leads: DataFrame) -> DataFrame:
    """One row: incidents, flagged ones, those flagged ahead of their alert, and the median lead."""
    middle = percentiles(leads, "lead_s", (0.5,)).agg(F.max("value").alias("median_lead_s"))
    return leads.agg(F.count("*").alias("incidents"), F.count("lead_s").alias("flagged"), F.count_if(F.col("lead_s") > 0).alias("ahead")).join(F.broadcast(middle))  # a row each


def macro_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: F1 averaged over the groups in the truth."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    actual = cells.groupBy(F.col("t").alias("k")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("tp"))
    guessed = cells.groupBy(F.col("g").alias("k")).agg(F.sum("n").alias("guessed"))
    return actual.join(guessed, "k", "left").agg(F.avg(2 * F.col("tp") / (F.col("actual") + F.coalesce("guessed", F.lit(0)))).alias("macro_f1"), F.count("*").alias("groups"))


def kappa(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: Cohen's kappa of two yes/no raters; NULL if chance explains all."""
    n = F.count("*")
    agree = F.try_divide(F.count_if(a == b), n)
    pa, pb = F.try_divide(F.count_if(a), n), F.try_divide(F.count_if(b), n)
    chance = pa * pb + (1 - pa) * (1 - pb)
    return rows.agg(n.alias("n"), agree.alias("agreement"), F.try_divide(agree - chance, 1 - chance).alias("kappa"))


def paired(labels: DataFrame, verdicts: DataFrame, key: str = "statement_id", human: str = "human_supported", judge: str = "supported") -> DataFrame:
    """Both ratings of each labelled statement; a label without a statement, or without a verdict, is an error."""
    both = labels.select(key, human).join(verdicts.select(key, F.col(judge).alias("_judge")), key, "left")
    said = F.when(F.col("_judge").isNotNull(), F.col("_judge")).otherwise(F.raise_error(F.concat(F.lit("no verdict on "), F.col(key))).cast("boolean"))
    return both.select(key, human, said.alias(judge))


def known(table: DataFrame, target: str = "target") -> DataFrame:
    """Rows whose target is known."""
    return table.filter(F.col(target).isNotNull())


def stratified_sample(rows: DataFrame, strata: Sequence[str], key: Column, share: tuple[int, int] = (1, 5), seed: str = "0") -> DataFrame:
    """Of each stratum the ceil(share * n) (one at least) rows whose hashed keys come first.

    The cut in each stratum is found on counts by the hash's first digits, so only one small part of a
    stratum is put in order.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))).withColumn("_d", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*strata, "_d").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*strata)
    up_to = w.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    marks = counts.withColumns({"_before": F.coalesce(F.sum("c").over(up_to), F.lit(0)), "_n": F.sum("c").over(w)})
    take = F.greatest(F.lit(1), F.floor((F.col("_n") * share[0] + share[1] - 1) / share[1]))
    marks = marks.withColumn("_left", take - F.col("_before")).filter("_left > 0").select(*[F.col(s).alias(f"_m_{s}") for s in strata], F.col("_d").alias("_m_d"), "_left")
    on = [F.col(s).eqNullSafe(F.col(f"_m_{s}")) for s in strata] + [F.col("_d") == F.col("_m_d")]
    joined = hashed.join(marks, on)
    rank = F.row_number().over(Window.partitionBy(*strata, "_d").orderBy("_h"))
    return joined.withColumn("_r", rank).filter("_r <= _left").select(*rows.columns)


def chance_of_a_hit(pool: Column, off: Column, drawn: int) -> Column:
    """The chance that ``drawn`` of ``pool`` items, ``off`` of which are off the mark, hold a good one."""
    steps = F.sequence(F.lit(0), F.lit(drawn - 1))
    none = F.aggregate(steps, F.lit(1.0), lambda a, i: a * F.greatest(F.coalesce(F.try_divide((off - i).cast("double"), (pool - i).cast("double")), F.lit(0.0)), F.lit(0.0)))
    return F.when(pool > 0, 1 - none)


def mode_so_far(rows: DataFrame, order: str, group: str, ranking: Sequence[str], default: str) -> DataFrame:
    """A row for each value of ``order``: the commonest group strictly before it, ties by ``ranking``."""
    rank = F.coalesce(*[F.when(F.col(group) == g, F.lit(i)) for i, g in enumerate(ranking)], F.lit(len(ranking)))
    counts = rows.groupBy(order, F.col(group).alias("g"), rank.alias("r")).agg(F.count("*").alias("n"))
    groups = counts.agg(F.collect_set(F.struct("g", "r")).alias("_all"))  # a row; groups are an enum's names
    every = counts.select(order).distinct().join(F.broadcast(groups)).select(order, F.explode("_all").alias("x")).select(order, "x.g", "x.r")
    before = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    filled = every.join(counts.select(order, "g", "n"), [order, "g"], "left").withColumn("c", F.coalesce(F.sum("n").over(before), F.lit(0)))
    best = filled.groupBy(order).agg(F.max_by("g", F.struct("c", (-F.col("r")).alias("r"))).alias("g"), F.max("c").alias("c"))
    return best.select(order, F.when(F.col("c") > 0, F.col("g")).otherwise(default).alias("guess"))
