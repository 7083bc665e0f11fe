"""K-d tree sharding by weighted medians.

The space of the rows' metadata is split again and again: a node that is to hold k shards is cut along
its widest dimension (its spread against the whole table's) at the point below which floor(k/2) of k
shares of its bytes lie, until a leaf is one shard.  Cuts are found for all nodes of a level at once
from sums of bytes in bins, refined until a bin is fine enough; only those sums, whose number is fixed,
reach the driver.  After each level rows keep the number of their node, and lineage is cut.

Ties along a dimension go by the text's checksum.  Rows of equal texts are one group: no cut parts them, so
they are in one shard, unless the group has more bytes than the largest row and than a twentieth of a shard.
Such a group, of which there can be a bounded number only, is dealt further by a hash of the id, and parted
where a cut falls among its rows: sizes stay near equal also where one text is a third of all rows.

Null texts have size 16 and checksum 0.  A very long text is one row and never parted.  Repeated rows are
placed one by one (those that are the same in every respect share a place in the order).  An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import cut, prepare

SHARDS = 40
OVERHEAD = 16
#: A group of equal texts may be parted if it has more than this share of a shard, and more than the largest row.
PARTED = 0.05
#: A cut is fine enough when the bin that holds it has at most this share of a shard.
FINE = 0.002
_BITS = 10
_DIM_BITS = 20
_TIE_BITS = 20
#: Rows of one slot group, about: what one task numbers.
SLOT_ROWS = 50_000


def _of(values: Sequence[int], at: Column) -> Column:
    """The entry of a list of constants that ``at`` (from 0) names."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), at + 1)


def _cut_points(placed: DataFrame, nodes: int, halves: Sequence[float], size_col: str, bits: int, fine: float) -> list[tuple[int, int]]:
    """Of each node (column ``_n`` from 0): its widest dimension, and the key (of the columns ``_k0``,
    ``_k1``, ...) at which its bytes are cut so that the share ``halves`` of them lies below."""
    dims = [c for c in placed.columns if c.startswith("_k")]
    spread = {r["_n"]: r for r in placed.groupBy("_n").agg(F.sum(size_col).alias("s"), *[f(k).alias(f"{n}{k}") for k in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
    dim, low, high, below, target, cut_at = [0] * nodes, [0] * nodes, [1] * nodes, [0.0] * nodes, [0.0] * nodes, [0] * nodes
    for i, r in spread.items():
        dim[i] = max(range(len(dims)), key=lambda d, r=r: (r[f"hi{dims[d]}"] >> bits - _DIM_BITS) - (r[f"lo{dims[d]}"] >> bits - _DIM_BITS))
        low[i], high[i] = r[f"lo{dims[dim[i]]}"], r[f"hi{dims[dim[i]]}"] + 1
        target[i] = float(r["s"]) * halves[i]
    node = F.col("_n").cast("int")
    keyed = placed.select("_n", size_col, F.element_at(F.array(*dims), (_of(dim, node) + 1).cast("int")).alias("_k"))
    todo = set(spread)
    while todo:  # the cut of node i lies in [low, high]; below: bytes under low
        step = [max(1, -(-(b - a) >> _BITS)) for a, b in zip(low, high, strict=True)]
        ends = [high[i] if i in todo else low[i] for i in range(nodes)]
        inside = keyed.filter((F.col("_k") >= _of(low, node)) & (F.col("_k") < _of(ends, node)))
        bins = inside.select("_n", size_col, (F.col("_k") - _of(low, node)).alias("_o"), _of(step, node).alias("_w")).select("_n", size_col, F.expr("_o div _w").alias("bin"))
        sums: dict[int, list] = {}
        for r in bins.groupBy("_n", "bin").agg(F.sum(size_col).alias("s")).collect():  # nodes times 2^_BITS rows at most
            sums.setdefault(r["_n"], []).append((r["bin"], float(r["s"])))
        for i in [*todo]:
            for at, held in sorted(sums[i]):  # noqa: B007
                if below[i] + held >= target[i]:
                    break
                below[i] += held
            low[i] += at * step[i]
            high[i] = min(high[i], low[i] + step[i])
            if step[i] == 1 or held <= fine:
                todo.discard(i)
                # Before or after the bin, whichever leaves less between it and the target.
                cut_at[i] = low[i] if target[i] - below[i] < below[i] + held - target[i] else high[i]
    return [*zip(dim, cut_at, strict=True)]


def kd_shards(rows: DataFrame, dims: Sequence[str], size_col: str, tie: Sequence[Column], shards: int = SHARDS) -> DataFrame:
    """``rows`` with shard.

    A key is the dimension's value among 2^20 levels, then 20 bits of each part of ``tie``.
    """
    ranges = rows.agg(*[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))], F.sum(size_col).alias("total")).first()
    levels = (1 << _DIM_BITS) - 1
    keys = {}
    for d, c in enumerate(dims):
        lo, hi = ranges[f"lo_{c}"], ranges[f"hi_{c}"]
        key = F.lit(0).cast("long") if lo is None or hi <= lo else F.floor((F.col(c) - lo) / (hi - lo) * levels)
        for t in tie:
            key = F.shiftleft(key, _TIE_BITS) + t
        keys[f"_k{d}"] = key
    bits = _DIM_BITS + _TIE_BITS * len(tie)
    fine = FINE * float(ranges["total"] or 0) / shards
    placed = cut(rows.withColumns(keys).withColumn("_n", F.lit(0)))
    counts, firsts = [shards], [0]  # of each open node: its shards and the first of them
    while max(counts) > 1:
        live = [i for i, k in enumerate(counts) if k > 1]
        rank = {i: j for j, i in enumerate(live)}
        node = F.col("_n").cast("int")
        only = placed.withColumn("_n", _of([rank.get(i, -1) for i in range(len(counts))], node)).filter("_n >= 0")
        points = _cut_points(only, len(live), [(counts[i] // 2) / counts[i] for i in live], size_col, bits, fine)
        dim = [points[rank[i]][0] if i in rank else 0 for i in range(len(counts))]
        at = [points[rank[i]][1] if i in rank else 0 for i in range(len(counts))]
        left, right, new_counts, new_firsts = [], [], [], []
        for k, first in zip(counts, firsts, strict=True):
            left.append(len(new_counts))
            right.append(len(new_counts) + (k > 1))
            new_counts += [k // 2, k - k // 2] if k > 1 else [k]
            new_firsts += [first, first + k // 2] if k > 1 else [first]
        key = F.element_at(F.array(*keys), (_of(dim, node) + 1).cast("int"))
        placed = cut(placed.withColumn("_n", F.when(key < _of(at, node), _of(left, node)).otherwise(_of(right, node))))
        counts, firsts = new_counts, new_firsts
    return placed.withColumn("shard", _of(firsts, F.col("_n").cast("int")).cast("int")).drop("_n", *keys)


def slots(placed: DataFrame, order: Sequence[Column], group: Column) -> DataFrame:
    """``placed`` (with shard) with slot: a gapless number from 0 in each shard.

    Rows are numbered in groups of bounded size by a hash, and each group starts where the counts of the
    groups before it end; no task holds a shard.
    """
    n = placed.count()
    groups = max(1, -(-n // SLOT_ROWS))
    dealt = placed.withColumn("_g", F.pmod(group, F.lit(groups)))
    starts = dealt.groupBy("shard", "_g").agg(F.count("*").alias("n"))
    # Its rows number shards times groups: a row for tens of thousands.
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("shard", "_g", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("shard", "_g").orderBy(*order))
    return dealt.withColumn("_r", own).join(starts, ["shard", "_g"]).withColumn("slot", F.col("_start") + F.col("_r") - 1).drop("_g", "_r", "_start")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; the law is ``bytes``.

    Dimensions: the logarithm of the size, characters per byte (which parts scripts), and the checksum.
    """
    prepare(docs.sparkSession)
    text = F.col(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
            F.coalesce(F.try_divide(F.length(text), F.octet_length(text)), F.lit(1.0)).cast("double").alias("density"),
        ).withColumns({"log_size": F.log2(F.col("size").cast("double")), "crc": F.col("text_crc32").cast("double")})
    )
    sums = rows.agg(F.sum("size"), F.max("size")).first()
    most = max(PARTED * (sums[0] or 0) / shards, sums[1] or 0)
    # Heavier than a share of a shard: at most shards / PARTED groups.
    heavy = rows.groupBy("text_crc32", "size", "density").agg(F.sum("size").alias("_held")).filter(F.col("_held") > most).select("text_crc32", "size", "density", F.lit(True).alias("_heavy"))
    rows = cut(rows.join(F.broadcast(heavy), ["text_crc32", "size", "density"], "left"))
    tie = [F.shiftright("text_crc32", 32 - _TIE_BITS), F.when(F.col("_heavy"), F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(1 << _TIE_BITS))).otherwise(0)]
    placed = kd_shards(rows, ["log_size", "density", "crc"], "size", tie, shards).select("doc_id", "size", "text_crc32", "shard")
    numbered = slots(placed, ["text_crc32", "size", "doc_id"], F.xxhash64("text_crc32", "doc_id"))
    return numbered.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
