"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

A solution is a list of bins.  Crossover injects whole well-filled bins of one parent into the
other and removes the bins that hold duplicates of their items; displaced items first replace one or two
smaller ones of a bin where that fills it better, and the rest go back by best fit, longest first.
Pieces are dealt by hash to blocks of bounded size; several islands evolve each block from different
seeds, and each island's elite migrates to the next one between epochs.  A block whose best solution has
as few bins as a lower bound is done at once.  The bins that are well filled at the end stay; the items
of the others are dealt again, to fewer blocks, until one block is left or the rounds end.

Only a document of more than ``capacity`` tokens is cut: into pieces of ``capacity``, the last of
which may be shorter.  A null text counts as empty; every document ends in one end token, so an
empty text is a piece of length 1.  Very long texts make many pieces; a task holds one text's ids.
Of pieces of equal length any may come first.  Repeated rows are packed one by one; an empty table gives
an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import cut, prepare
from headway.llm.tokens import KnownTable, WordVocabulary, byte_symbols

CAPACITY = 4096
#: Items of a block, on average: what one task holds and evolves.
BLOCK_ITEMS = 2000
ISLANDS = 2
EPOCHS = 3
POPULATION = 8
OFFSPRING = 40
#: A bin with at most this share of its capacity free counts as well filled.
WELL_FILLED = 0.004
ROUNDS = 3


class _Ids(WordVocabulary):
    """The library's ids of words, each made when first met, in a bounded table."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        self.symbols = byte_symbols()
        self.by_word = KnownTable(self, self.ids, b"".join)

    def ids(self, word: str) -> bytes:
        if word in self.marks:
            return np.array([self.marks[word]], "<u4").tobytes()
        plain = word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()


_vocabularies: dict[str, _Ids] = {}


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The library's ids of each text, as little-endian unsigned 32-bit numbers.

    The library's model merges each word by itself, so a word's ids are made once and kept.
    """
    if path not in _vocabularies:
        _vocabularies[path] = _Ids(path)
    own = _vocabularies[path]
    return [b"".join(map(own.by_word.__getitem__, own.chunks(t))) if t else b"" for t in texts]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(token_bytes(batch.column(1).to_pylist(), vocabulary)):
                ids += end
                for k, b in enumerate(range(0, len(ids), step)):
                    part = ids[b : b + step]
                    at.append(i)
                    piece.append(k)
                    start.append(b // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# One block: a solution is a list of (items, fill); items are positions in the sorted lengths.


def best_fit(order, weights, capacity: int, bins: list | None = None) -> list:
    """``bins`` with the items of ``order`` added, each to the fullest bin that takes it."""
    bins = [([*items], fill) for items, fill in bins or []]
    free = sorted((capacity - fill) << 32 | i for i, (_, fill) in enumerate(bins) if fill < capacity)
    for item in order:
        w = weights[item]
        k = bisect_left(free, w << 32)
        if k < len(free):
            room, i = divmod(free.pop(k), 1 << 32)
            items, fill = bins[i]
            items.append(item)
            bins[i] = (items, fill + w)
            if room > w:
                insort(free, (room - w) << 32 | i)
        else:
            bins.append(([item], w))
            if w < capacity:
                insort(free, (capacity - w) << 32 | (len(bins) - 1))
    return bins


def least_bins(weights, capacity: int) -> int:
    """A lower bound of the number of bins; ``weights`` in descending order.

    For each size t up to half the capacity: what is over half takes a bin each, and of the others that are
    no less than t only as much fits beside them as their room allows.
    """
    w = np.asarray(weights, np.int64)
    if not len(w):
        return 0
    sums = np.r_[0, np.cumsum(w)]
    over_half = int(np.searchsorted(-w, -capacity // 2, "left")) if capacity % 2 else int((2 * w > capacity).sum())
    best = -(-int(sums[-1]) // capacity)
    for t in np.unique(w[2 * w <= capacity]).tolist():
        alone = int(np.searchsorted(-w, -(capacity - t), "left"))
        last = int(np.searchsorted(-w, -t, "right"))
        alone = min(alone, over_half)
        room = (over_half - alone) * capacity - int(sums[over_half] - sums[alone])
        best = max(best, over_half + max(0, -(-(int(sums[last] - sums[over_half]) - room) // capacity)))
    return max(best, over_half)


def replace(kept: list, displaced: list[int], weights, capacity: int, rng: random.Random) -> list[int]:
    """Fills bins of ``kept`` better, by a displaced item for one or two smaller ones; what is displaced now."""
    pool = sorted((weights[i], i) for i in displaced)
    for k in rng.sample(range(len(kept)), len(kept)):
        items, fill = kept[k]
        if fill == capacity or not pool:
            continue
        best = None
        for a in range(len(items)):
            for b in range(a, len(items)):
                out = weights[items[a]] + (weights[items[b]] if b > a else 0)
                at = bisect_left(pool, (out + capacity - fill + 1, -1)) - 1
                if at >= 0 and pool[at][0] > out and (best is None or pool[at][0] - out > best[0]):
                    best = pool[at][0] - out, pool[at], a, b
        if best:
            gain, new, a, b = best
            pool.remove(new)
            for i in {items[a], items[b]}:
                insort(pool, (weights[i], i))
            kept[k] = ([i for j, i in enumerate(items) if j not in (a, b)] + [new[1]], fill + gain)
    return [i for _, i in pool]


def fitness(bins: list, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones, which leave their room together."""
    return -len(bins), sum(fill * fill for _, fill in bins) / (capacity * capacity)


def crossover(a: list, b: list, weights, capacity: int, rng: random.Random) -> list:
    tight = capacity * (1 - WELL_FILLED)
    well = [x for x in a if x[1] >= tight]
    rng.shuffle(well)
    injected = well[: max(1, len(well) * rng.randint(30, 90) // 100)] if well else []
    taken = {i for items, _ in injected for i in items}
    kept, displaced = [*injected], []
    for x in b:
        if taken.isdisjoint(x[0]) and (x[1] >= tight or rng.random() < 0.7):
            kept.append(x)
        else:  # a duplicate, or one of the poor bins that mutation dissolves
            displaced += [i for i in x[0] if i not in taken]
    displaced = replace(kept, displaced, weights, capacity, rng)
    if rng.random() < 0.5:
        displaced.sort(key=lambda i: -weights[i])
    else:
        displaced.sort(key=lambda i: -weights[i] * rng.uniform(0.8, 1.25))
    return best_fit(displaced, weights, capacity, kept)


def evolve(weights: list[int], capacity: int, seed: int, offspring: int = OFFSPRING, immigrant: list | None = None) -> list:
    """The best solution found for the items of one block; ``weights`` in descending order."""
    rng = random.Random(seed)
    people = [best_fit(range(len(weights)), weights, capacity)]
    least = least_bins(weights, capacity)
    if len(people[0]) <= least:
        return people[0]  # no solution has fewer
    if immigrant is not None:
        people.append(immigrant)
    while len(people) < POPULATION:
        spread = 0.05 * len(people)
        order = sorted(range(len(weights)), key=lambda i: -weights[i] * rng.uniform(1 - spread, 1 + spread))
        people.append(best_fit(order, weights, capacity))
    people = sorted(((fitness(p, capacity), k, p) for k, p in enumerate(people)), reverse=True)
    for k in range(offspring):
        if len(people[0][2]) <= least:
            break
        a, b = rng.sample(range(len(people)), 2)
        child = crossover(people[min(a, b)][2], people[max(a, b)][2], weights, capacity, rng)
        people = sorted([*people, (fitness(child, capacity), POPULATION + k, child)], key=lambda x: x[:2], reverse=True)[:POPULATION]
    return people[0][2]


_ORDER = ["length", "doc_id", "piece", "ids_crc32"]


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(_ORDER, ascending=[False, True, True, True], kind="stable", ignore_index=True)


def _numbers(bins: list, n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, (items, _) in enumerate(bins):
        out[items] = k
    return out


def _bins(numbers: np.ndarray, weights: list[int]) -> list:
    found: dict[int, list[int]] = {}
    for i, k in enumerate(numbers):
        found.setdefault(int(k), []).append(i)
    return [(items, sum(weights[i] for i in items)) for items in found.values()]


def _round(items: DataFrame, blocks: int, capacity: int, seed: int) -> DataFrame:
    """``items`` with block, bin and fill."""
    kind = items.schema["doc_id"].dataType.simpleString()
    dealt = items.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    over = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    elites = None
    for epoch in range(EPOCHS):

        def settle(key, own: pd.DataFrame, came: pd.DataFrame | None = None, epoch=epoch) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame({"block": [], "island": [], "n_bins": [], "numbers": []})
            block, island = int(key[0]), int(key[1])
            weights = _sorted(own)["length"].tolist()
            guest = _bins(came["numbers"].iloc[0], weights) if came is not None and len(came) else None
            bins = evolve(weights, capacity, seed=hash((seed, block, island, epoch)), immigrant=guest)
            return pd.DataFrame({"block": [block], "island": [island], "n_bins": [len(bins)], "numbers": [_numbers(bins, len(weights))]})

        schema = "block long, island int, n_bins int, numbers array<int>"
        if elites is None:
            elites = over.groupBy("block", "island").applyInPandas(lambda key, own: settle(key, own), schema)
        else:
            moved = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))
            elites = over.groupBy("block", "island").cogroup(moved.groupBy("block", "island")).applyInPandas(lambda key, own, came: settle(key, own, came), schema)
    best = elites.groupBy("block").agg(F.min_by("numbers", F.struct("n_bins", "island")).alias("numbers"))

    def place(key, own: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        own = _sorted(own)
        if len(own):
            own["bin"] = chosen["numbers"].iloc[0]
            own["fill"] = own.groupby("bin")["length"].transform("sum")
        else:
            own["bin"], own["fill"] = [], []
        return own[["doc_id", "piece", "start", "length", "ids_crc32", "block", "bin", "fill"]]

    return dealt.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block long, bin long, fill long")


def pack(parts: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """``parts`` (as of :func:`pieces`) with sequence_id and offset."""
    prepare(parts.sparkSession)
    parts = cut(parts)
    whole = parts.filter(F.col("length") >= capacity)
    # A whole sequence holds one piece, so any number that is unique will do; parts are cut above.
    done = [whole.withColumn("sequence_id", F.monotonically_increasing_id())]
    rest = parts.filter(F.col("length") < capacity)
    n = rest.count()
    for r in range(rounds):
        if not n:
            break
        blocks = max(1, -(-n // block_items))
        placed = cut(_round(rest, blocks, capacity, seed=r))
        last = r == rounds - 1 or blocks == 1
        stays = F.lit(True) if last else F.col("fill") >= capacity * (1 - WELL_FILLED)
        number = F.lit((r + 1) << 59) + F.shiftleft(F.col("block"), 20) + F.col("bin")
        done.append(placed.filter(stays).select(*parts.columns, number.alias("sequence_id")))
        if last:
            break
        rest = placed.filter(~stays).select(*parts.columns)
        n = rest.count()
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32")
    before = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return out.withColumn("offset", before)
