"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an equi-join and an aggregation with map-side combining.  The centres of large stars, of
which there can be a bounded number only, are joined by broadcast, so that no task gets all edges of
one; the number of rounds grows with the logarithm of the longest path.  Nothing but two numbers a
round reaches the driver.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vertex is hot that has at least so many edges, and at least its share of all: 2 * _HOT_SHARE vertices at most.
_HOT_EDGES = 512
_HOT_SHARE = 2000


def _with_least(rows: DataFrame, least: DataFrame, hot_from: int) -> DataFrame:
    """``rows`` (c, n) with m, the least vertex around c, from ``least`` (c, m, degree)."""
    hot = least.filter(F.col("degree") >= hot_from).select("c", F.col("m").alias("_hot"))
    known = rows.join(F.broadcast(hot), "c", "left")
    rest = known.filter("_hot IS NULL").drop("_hot").join(least.filter(F.col("degree") < hot_from).select("c", "m"), "c")
    return known.filter("_hot IS NOT NULL").withColumnRenamed("_hot", "m").unionByName(rest)


def _star(edges: DataFrame, large: bool, hot_from: int) -> DataFrame:
    """Edges (v > u): each vertex's neighbours are linked to the least vertex around it."""
    if large:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"), F.count("*").alias("degree")).select("c", F.least("c", "m").alias("m"), "degree")
        out = _with_least(both.filter("u > v").select(F.col("v").alias("c"), F.col("u").alias("n")), least, hot_from)
        return out.select(F.col("n").alias("v"), F.col("m").alias("u")).distinct()
    # Rows of a vertex, as the larger end, are at most as many as it has smaller neighbours: few after a large star.
    least = edges.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"), F.count("*").alias("degree"))
    out = _with_least(edges.select(F.col("v").alias("c"), F.col("u").alias("n")), least, hot_from)
    moved = out.filter("n > m").select(F.col("n").alias("v"), F.col("m").alias("u"))
    return moved.unionByName(least.select(F.col("c").alias("v"), F.col("m").alias("u"))).distinct()


#: Edges of one partition, about; a small graph is not dealt to more tasks than it fills, but to some.
_PART_EDGES = 20_000
_LEAST_PARTS = 8


@contextlib.contextmanager
def _partitions(spark, edges: int) -> Iterator[None]:  # noqa: ANN001
    """As many shuffle partitions as a graph of so many edges fills, at most those of the session."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(_LEAST_PARTS, edges // _PART_EDGES))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], most_rounds: int = 60) -> DataFrame:
    """(vertex, component) of every vertex with an edge to another; the component is its least vertex.

    ``edges`` has columns a and b of one orderable type; direction, repeats, loops and null ends do
    not matter (null ends and loops are left out).  ``cut`` ends a round's lineage.
    """
    tidy = edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    now = cut(tidy)
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    seen = print_of(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        hot_from = max(_HOT_EDGES, seen[0] // _HOT_SHARE)
        with _partitions(now.sparkSession, seen[0]):
            now = cut(_star(_star(now, True, hot_from), False, hot_from))
            after = print_of(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    # Settled: stars, whose centres are the least vertices.
    centres = now.select(F.col("u").alias("vertex"), F.col("u").alias("component")).distinct()
    return now.select(F.col("v").alias("vertex"), F.col("u").alias("component")).unionByName(centres)
