"""Near-duplicates by SimHash and multi-index hashing.

Fingerprints of 64 bits come from XXH64 hashes of word shingles.  A fingerprint is split into one
segment more than half the distance: two of 32 bits for 3 differing bits, four of 16 for 7.  Of two
fingerprints within the distance, one segment differs in at most one bit, so each fingerprint
enumerates the Hamming ball of radius 1 around each of its segments, fetches the fingerprints whose
segment has such a value, and verifies the whole distance.

Work is on distinct fingerprints, so exact copies never meet in pairs.  Fingerprints that share a
segment's value meet in one group.  A group emits only a spanning star of its components, never its
pairs, and a large one is dealt out in blocks, every block of the table against every block of the
probes, so that no task holds more than a bounded part of it.

Null and empty texts have fingerprint zero and link like any other.  Repeated rows repeat in the
result; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import cut, prepare, release, trimmed, unused
from headway.operators.graph import connected_components

DISTANCE = 3
SEED = 42
SHINGLE = 3
#: Table entries (and, in proportion, probes) of one block of a group.
BLOCK = 4096
#: Lists of large groups of at most so many rows are broadcast; longer ones are joined by shuffling.
BROADCAST_ROWS = 20_000


def _shingles(text: bytes | None, shingle: int) -> list[bytes]:
    """The runs of so many words, repeats included; of fewer words, the whole of them."""
    words = text.lower().split() if text else []
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is 1 if it is set in over half the shingles' hashes."""
    import xxhash

    parts = _shingles(text, shingle)
    return _simhash(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts)))


def _simhash(hashes: np.ndarray) -> int:
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # long texts in parts: 64 bytes a hash
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of up to 255 rows fit in a byte, which is far faster to add up.
        for j in range(0, len(bits), 255 * 64):
            block = bits[j : j + 255 * 64]
            whole = len(block) // 255 * 255
            if whole:
                counts += block[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            counts += block[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint as a signed 64-bit number) of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, fp long")


def _differing(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit patterns; numpy would count those of a signed number's absolute value."""
    return np.bitwise_count(x.view(np.uint64))


def _stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (x, least of its component) of the links (a, b)."""
    label: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := label.setdefault(x, x)) != x:
            label[x] = x = label[up]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            label[max(x, y)] = min(x, y)
    return np.array([(x, root(x)) for x in label if root(x) != x], np.int64).reshape(-1, 2)


def _near(entries: np.ndarray, probes: np.ndarray, distance: int) -> np.ndarray:
    """Stars over all entries and probes of one large group within ``distance``, slice by slice."""
    step = max(1, _PAIRS // max(1, len(probes)))
    stars = np.zeros((0, 2), np.int64)
    for i in range(0, len(entries), step):
        part = entries[i : i + step]
        x, y = np.nonzero(_differing(part[:, None] ^ probes[None, :]) <= distance)
        stars = np.concatenate([stars, np.column_stack([part[x], probes[y]])])
        if len(stars) > 4 * (len(entries) + len(probes)):
            stars = _stars(stars[:, 0], stars[:, 1])
    return _stars(stars[:, 0], stars[:, 1])


#: Distances taken at once.
_PAIRS = 1 << 20


def _linked(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Edges of rows (segment, value, tblock, pblock, entry, fp) that come sorted by group, probes first."""
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``rows``: whole groups."""
        starts = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
        entries = np.add.reduceat(rows[:, 4], starts)
        probes = np.diff(np.r_[starts, len(rows)]) - entries
        live = (entries > 0) & (probes > 1)
        starts, entries, probes = starts[live], entries[live], probes[live]
        work = entries * probes
        out = [_near(rows[s + p : s + p + t, 5], rows[s : s + p, 5], distance) for s, t, p in zip(*(v[work > _PAIRS].tolist() for v in (starts, entries, probes)), strict=True)]
        small = np.flatnonzero(work <= _PAIRS)
        for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(work[small]) // _PAIRS)) + 1) if len(small) else ():
            # Every entry of a group beside every probe of it, for many groups at once.
            each = np.repeat(part, work[part])
            at = np.arange(len(each)) - np.repeat(np.cumsum(work[part]) - work[part], work[part])
            x = rows[starts[each] + probes[each] + at // probes[each], 5]
            y = rows[starts[each] + at % probes[each], 5]
            good = (_differing(x ^ y) <= distance) & (x != y)
            x, y, each = x[good], y[good], each[good]
            if not len(x):
                continue
            n = np.bincount(each, minlength=len(work))
            many = n[each] > 4 * (entries + probes)[each]
            out.append(np.column_stack([x[~many], y[~many]]))
            for g in np.unique(each[many]):
                out.append(_stars(x[each == g], y[each == g]))
        edges = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        if len(edges):
            edges = np.unique(np.sort(edges, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 1]), pa.array(edges[:, 0])], ["a", "b"])

    size = 0
    for batch in trimmed(batches):
        if not batch.num_rows:
            continue
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        held.append(rows)
        size += len(rows)
        if size < _PAIRS // 4 or (rows[-1, :4] == held[0][0, :4]).all():
            continue  # few rows yet, or still one group
        rows = np.concatenate(held)
        last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))[-1] + 1
        held, size = [rows[last:]], len(rows) - last
        yield from solve(rows[:last])
    if held:
        yield from solve(np.concatenate(held))


def _blocks(table: DataFrame, bounds: list[int], block: int) -> DataFrame:
    """(segment, value, tparts, pparts) of the values with very many entries and of those one bit from them,
    which get as many probes: into how many blocks their entries and probes are dealt."""
    large = table.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(b - a)]) for a, b in zip(bounds, bounds[1:], strict=False)])
    around = large.select("segment", "n", F.col("value").alias("from"), F.explode(F.element_at(flips, F.col("segment") + 1)).alias("x"))
    sums = around.groupBy("segment", F.col("from").bitwiseXOR(F.col("x")).alias("value")).agg(F.sum("n").alias("probes"), F.sum(F.when(F.col("x") == 0, F.col("n")).otherwise(0)).alias("entries"))
    count = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1)).cast("int")
    return sums.select("segment", "value", count("entries").alias("tparts"), count("probes").alias("pparts"))


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct values ``fps.fp``."""
    spark = prepare(fps.sparkSession)
    segments = distance // 2 + 1
    bounds = [64 * i // segments for i in range(segments + 1)]

    def with_value(flips: list[list[int]]) -> DataFrame:
        """A row for each segment and each of its flips: the segment's value with those bits changed."""
        each = [
            F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b - a) - 1)).bitwiseXOR(F.lit(x)).alias("value"))
            for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))
            for x in flips[s]
        ]
        return fps.select("fp", F.explode(F.array(*each)).alias("h")).select("fp", "h.segment", "h.value")

    table = with_value([[0]] * segments)
    probes = with_value([[0, *(1 << i for i in range(b - a))] for a, b in zip(bounds, bounds[1:], strict=False)])
    rows = table.withColumn("entry", F.lit(1)).unionByName(probes.withColumn("entry", F.lit(0)))
    parts = cut(_blocks(table, bounds, block))
    if n := parts.count():
        rows = rows.join(F.broadcast(parts) if n <= BROADCAST_ROWS else parts, ["segment", "value"], "left").fillna(1, ["tparts", "pparts"])
        # An entry meets every block of probes, a probe every block of entries.
        is_entry = F.col("entry") == 1
        own = F.pmod(F.xxhash64("fp"), F.when(is_entry, F.col("tparts")).otherwise(F.col("pparts"))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.when(is_entry, F.col("pparts")).otherwise(F.col("tparts")).cast("int") - 1))
        rows = rows.select("segment", "value", "entry", "fp", own.alias("own"), other.alias("other"))
        rows = rows.select("segment", "value", F.when(is_entry, F.col("own")).otherwise(F.col("other")).alias("tblock"), F.when(is_entry, F.col("other")).otherwise(F.col("own")).alias("pblock"), "entry", "fp")
    else:
        rows = rows.select("segment", "value", F.lit(0).alias("tblock"), F.lit(0).alias("pblock"), "entry", "fp")
    key = ["segment", "value", "tblock", "pblock"]
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(shuffles, *key).sortWithinPartitions(*key, "entry")
    return dealt.mapInArrow(lambda batches: _linked(batches, distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``id_col``, th (a hash of the text), fp, root (one number a component) and component_id (the least id
    reachable over links, the row's own included)."""
    prepare(docs.sparkSession)
    own = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(distinct.select("fp"), distance)
    found = connected_components(edges, cut)
    least = found.join(distinct, found["vertex"] == distinct["fp"]).groupBy("component").agg(F.min("least").alias("component_id"))
    linked = found.join(least, "component").select(F.col("vertex").alias("fp"), "component", "component_id")
    # Cut, so that the last join's sides are both plain shuffles: a fingerprint with very many rows is then split.
    classes = cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")))
    return own.join(classes, "fp").select(F.col("doc_id").alias(id_col), "th", "fp", "root", "component_id")


def _hashed(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct hashes (of 64 bits) of a text's shingles, in order."""
    import xxhash

    parts = _shingles(text, shingle)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts)))


def _set_hash(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


#: Shingles in at least one of so many texts rank as common; there are at most so many times a text's shingles of them.
COMMON = 16384
#: Shingle hashes that a task counts at once.
_COUNTED = 2_000_000


def _common(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles, in order, and about how many texts have each."""
    rows = docs.select(F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(t[n > 1].view(np.int64)), pa.array(n[n > 1])], ["t", "n"])

        size = 0
        for batch in trimmed(batches):
            for text in batch.column(0):
                held.append(_hashed(text.as_py(), shingle))
                size += len(held[-1])
                if size >= _COUNTED:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    least = max(3, docs.count() // COMMON)
    got = rows.mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    t, n = (got.column(c).to_numpy().astype(np.int64) for c in ("t", "n"))
    order = np.argsort(t.view(np.uint64))
    return t.view(np.uint64)[order], n[order]


#: Groups of more texts than this are one family without a look at their histograms.
GLUED = 512
#: Bits of the map of shared shingles that tells most others apart before they are dealt.
SHARED_BITS = 1 << 25
#: Texts, and shingles of them, of one block of a family.
FAMILY_ROWS = 2048
FAMILY_SHINGLES = 2_000_000
#: Texts of a large family that are in each of its blocks.
HUBS = 8
#: Lists of texts of at most so many rows (some 40 bytes each) are broadcast; longer ones are joined by shuffling.
BROADCAST_TEXTS = 100_000


def _histogram(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall on each of some places (of at most 255): a power of two, about a sixth of the hashes'
    number, fewer for very many.

    Two sets' histograms differ by no more in all than the hashes that are in one of them only; those of sets that
    have little in common differ by more than a ninth of both sizes.  Adding up halves gives that of half the places.
    """
    n = len(hashes)
    width = max(min(_power(n // 8), 1024), _power(n // 16), 16)
    return np.minimum(np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8)


def _power(n: int) -> int:
    """The least power of two that is no less."""
    return 1 << max(0, n - 1).bit_length()


def _parity(hashes: np.ndarray, width: int) -> np.ndarray:
    """Words of 64 bits; a bit is the parity of the number of hashes that fall on it.

    Bits that differ between two sets are at most as many as the hashes that are in one of them only.
    """
    return np.packbits((np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).view(np.uint64)


def _unlike(m, n, similarity: float):
    """The most hashes in one only of two sets of sizes m and n that are alike."""
    return (m + n) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _described(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """doc_id, th (a hash of the text), and of its set of shingles: sh (a hash), size, rare, fp, places and toks.

    fp is the SimHash of the set, places its histogram, rare the number of uncommon hashes.
    toks: the set's first hashes, uncommon ones first, as many as it takes that of two sets that are alike
    one of the first is in both.  Any order of all hashes gives that; this one keeps groups small.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, text_col, shingle))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("binary").alias("text"))
    names = ["doc_id", "th", "sh", "size", "rare", "fp", "places", "toks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = sent.value
        for batch in trimmed(batches):
            hashes, sizes, rare, fps, places, toks = [], [], [], [], [], []
            for text in batch.column(2):
                s = _hashed(text.as_py(), shingle)
                hashes.append(_set_hash(s))
                sizes.append(len(s))
                fps.append(_simhash(s))
                places.append(_histogram(s).tobytes())
                known = np.zeros(len(s), np.int64)
                if len(common) and len(s):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    known = np.where(common[at] == s, counts[at], 0)
                    s = s[np.argsort(known, kind="stable")]
                rare.append(int((known == 0).sum()))
                toks.append(s[: len(s) - math.ceil(similarity * len(s) - 1e-6) + 1].view(np.int64))
            ends = np.cumsum([0, *map(len, toks)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(toks) if toks else np.zeros(0, np.int64)))
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            columns = [batch.column(0), batch.column(1), signed(hashes), pa.array(sizes, pa.int32()), pa.array(rare, pa.int32()), signed(fps), pa.array(places, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names)

    ids = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {ids}, th long, sh long, size int, rare int, fp long, places binary, toks array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int, at_least: int) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by their first ``keys`` columns: of many small groups, or of one large one."""
    held: list[pa.RecordBatch] = []
    size = 0
    key = lambda batch, i: [batch.column(c)[i].as_py() for c in range(keys)]
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < at_least or key(batch, batch.num_rows - 1) == key(held[0], 0):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for c in range(keys):
            column = table.column(c).to_numpy()
            same &= column == column[-1]
        last = int(np.flatnonzero(~same)[-1]) + 1
        yield table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches()
        size = table.num_rows - last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    """Where groups start, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in range(keys):
        column = table.column(c).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.r_[np.flatnonzero(new), table.num_rows]


def _meeting(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the fingerprints of pairs that can be alike, in groups of at most GLUED rows (t, fp, size, pos, places).

    What stands before the first hash that two sets share is in one of them only, so the group of that
    hash bounds what they have in common, and their histograms bound what they have not.
    """
    for table in _groups(trimmed(batches), 1, 4096):
        fp, size, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("fp", "size", "pos"))
        held = table.column("places").combine_chunks()
        flat, ends = np.frombuffer(held.buffers()[2], np.uint8), np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
        width = np.diff(ends)

        def unlike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """How much the histograms of rows x and y differ, of as many places as the smaller has."""
            out = np.zeros(len(x), np.int64)
            both = np.minimum(width[x], width[y])
            for w in np.unique(both).tolist():
                some = np.flatnonzero(both == w)
                for part in np.array_split(some, -(-len(some) * w // (_PAIRS * 8))):
                    sums = []
                    for rows in (x[part], y[part]):
                        folded = np.zeros((len(part), w), np.int16)
                        for k in range(int((width[rows] // w).max())):
                            has = width[rows] > k * w
                            folded[has] += flat[ends[rows[has]][:, None] + (k * w + np.arange(w))]
                        sums.append(folded)
                    out[part] = np.abs(sums[0] - sums[1]).sum(axis=1, dtype=np.int64)
            return out

        starts = _starts(table, 1)
        many = np.diff(starts)
        out = [np.zeros((0, 2), np.int64)]
        live = np.flatnonzero(many > 1)
        for part in np.split(live, np.flatnonzero(np.diff(np.cumsum(many[live] ** 2) // (_PAIRS // 4))) + 1) if len(live) else ():
            group = np.repeat(part, many[part] ** 2)
            at = np.arange(len(group)) - np.repeat(np.cumsum(many[part] ** 2) - many[part] ** 2, many[part] ** 2)
            x, y = starts[group] + at // many[group], starts[group] + at % many[group]
            most = np.minimum(size[x] - pos[x], size[y] - pos[y])
            good = (x < y) & (fp[x] != fp[y]) & (most * (1 + similarity) >= similarity * (size[x] + size[y]) - 1e-6)
            x, y = x[good], y[good]
            good = unlike(x, y) <= _unlike(size[x], size[y], similarity)
            out.append(np.column_stack([fp[x[good]], fp[y[good]]]))
        edges = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        if len(edges):
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 1]), pa.array(edges[:, 0])], ["a", "b"])


def _bit_map(shared: DataFrame) -> np.ndarray:
    """Words of 64 bits, SHARED_BITS in all, with the bits set that ``shared.t`` fall on."""
    bit = F.pmod("t", F.lit(SHARED_BITS))
    rows = shared.select(F.expr("1L").alias("one"), bit.alias("bit")).groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(one, cast(bit % 64 AS int))")).alias("word")).toArrow()
    words = np.zeros(SHARED_BITS // 64, np.int64)
    words[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
    return words.view(np.uint64)


def _placed(texts: DataFrame, bit_map: np.ndarray) -> DataFrame:
    """t, sh, size and pos (t's place in the text's list) of the shingles of ``texts`` that ``bit_map`` does not rule out."""
    sent = texts.sparkSession.sparkContext.broadcast(bit_map)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            bit = flat.view(np.uint64) & np.uint64(SHARED_BITS - 1)
            at = np.flatnonzero(words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
            row = np.searchsorted(ends, at + ends[0], "right") - 1
            pos = (at + ends[0] - ends[row]).astype(np.int32)
            for i in range(0, len(at), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(flat[at[part]]), *[batch.column(c).take(pa.array(row[part])) for c in (0, 1)], pa.array(pos[part])], ["t", "sh", "size", "pos"])

    return texts.select("sh", "size", "toks").mapInArrow(run, "t long, sh long, size int, pos int")


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """sh and s: the distinct hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_hashed(t.as_py(), shingle) for t in batch.column(0)]
            sh = np.array([_set_hash(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sh), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["sh", "s"])

    return docs.mapInArrow(run, "sh long, s array<long>")


def _join_alike(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of alike sets, one of ``left`` and one of ``right``, that join all labels so linked; ``label`` is changed.

    Each pair of two labels is looked at (with the same ``left`` and ``right``, once): bitmaps tell most that
    are not alike, the others are compared whole.
    """
    once = left is right
    sizes = np.array([len(s) for s in sets], np.int64)
    width = 1 << int(np.clip(2 * int(sizes.max(initial=1)), 256, 4096) - 1).bit_length()
    bits = np.stack([_parity(s, width) for s in sets])
    found = []
    for x in left.tolist():
        if once:
            right = right[right > x]
        far = np.zeros(len(right), np.uint16)
        live = label[right] != label[x]
        if not live.any():
            continue
        far[live] = np.bitwise_count(bits[right[live]] ^ bits[x]).sum(axis=1, dtype=np.uint16)
        live &= far <= _unlike(sizes[right], sizes[x], similarity)
        order = np.argsort(far[live] / np.maximum(1, sizes[right[live]] + sizes[x]), kind="stable")
        near = right[live][order]
        while len(near):
            y = int(near[0])
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if common >= similarity * (sizes[x] + sizes[y] - common) and sizes[x] and sizes[y]:
                found.append((x, y))
                label[label == label[y]] = label[x]
            near = near[1:]
            near = near[label[near] != label[x]]
    return found


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between alike sets, of rows (family, i, j, side, label, rare, sh, s) sorted by block (family, i, j), hubs' first.

    Of a block's rows those of side 0 meet those of side 1; rows of side 2 meet each other.
    """
    for table in _groups(trimmed(batches), 3, 256):
        starts = _starts(table, 3)
        side, sh, known = (table.column(c).to_numpy() for c in ("side", "sh", "label"))
        lists = table.column("s").combine_chunks()
        flat, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
        ends = ends - ends[0]
        a, b = [], []
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if j - i < 2:
                continue
            sets = [flat[ends[k] : ends[k + 1]] for k in range(i, j)]
            sides, label = side[i:j], known[i:j].copy()
            every = np.arange(j - i)
            left, right = (every, every) if (sides == 2).all() else (every[sides == 0], every[sides == 1])
            links_here = _join_alike(sets, label, left, right, similarity)
            a += [int(sh[i + x]) for x, _ in links_here]
            b += [int(sh[i + y]) for _, y in links_here]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _cut_and_release(df: DataFrame) -> DataFrame:
    """As :func:`cut`; the shuffles behind it go at once: there are many, each of many files."""
    out = cut(df)
    release(df.sparkSession)
    return out


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 5) -> DataFrame:
    """``id_col``, th, root (one number a component) and component_id, linked by the similarity (Jaccard) of whole texts' shingles.

    Families of candidates are the components of two kinds of links: those that multi-index hashing finds
    between the SimHashes of the sets (:func:`links`), and, as no distance of fingerprints has all pairs that
    are alike, those between sets that share one of their rarest shingles and can be alike by size, place and
    histogram.  Two sets that are alike share one of these (:func:`_described`), so
    all links lie within families.  There each pair of texts that are not yet joined is checked exactly.
    A family of more than one block meets in two rounds: each block in itself and with a few hubs, then the
    texts that are not in the largest component with all.  Texts without words are alike.
    """
    spark = prepare(docs.sparkSession)
    release(spark)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_TEXTS else df
    own = _cut_and_release(_described(docs, id_col, text_col, shingle, similarity))
    first = F.struct("th", "doc_id")
    texts = _cut_and_release(own.groupBy("sh").agg(F.min("doc_id").alias("least"), F.min_by(F.struct("th", "doc_id", "size", "rare", "fp", "places", "toks"), first).alias("of")).select("sh", "least", "of.*"))
    # Texts are distinct, and so are a text's shingles: those of two rows or more are shared.
    shared = texts.select("fp", F.explode("toks").alias("t")).groupBy("t").agg(F.min("fp").alias("hub"), F.count("*").alias("many"))
    shared = _cut_and_release(shared.filter("many > 1"))
    members = _placed(texts, _bit_map(shared)).join(small(shared), "t")
    members = _cut_and_release(members)
    release(spark)
    glued = members.filter(F.col("many") > GLUED).join(texts.select("sh", "fp"), "sh").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    # Of a group's texts in order of size, one that can be alike with any can be so with a neighbour.
    by_size = Window.partitionBy("t").orderBy("size")
    fits = (F.lag("size").over(by_size) >= F.col("size") * similarity - 1e-6) | (F.lead("size").over(by_size) * similarity <= F.col("size") + 1e-6)
    fitting = members.filter(F.col("many") <= GLUED).withColumn("fits", fits).filter("fits").select("t", "sh", "pos")
    met = fitting.join(texts.select("sh", "fp", "size", "places"), "sh").select("t", "fp", "size", "pos", "places")
    met = met.repartition(shuffles, "t").sortWithinPartitions("t").mapInArrow(lambda batches: _meeting(batches, similarity), "a long, b long").distinct()
    edges = _cut_and_release(links(texts.select("fp").distinct(), distance).unionByName(glued).unionByName(met))
    release(spark)
    family = connected_components(edges, _cut_and_release).withColumnRenamed("vertex", "fp")
    named = texts.join(family, "fp", "left").select("sh", "th", "doc_id", "size", (F.col("rare") / F.greatest("size", F.lit(1))).alias("rare"), F.coalesce("component", "fp").alias("family"))
    blocks = F.greatest(F.ceil(F.count("*") / FAMILY_ROWS), F.ceil(F.sum("size") / FAMILY_SHINGLES)).cast("int")
    sized = named.groupBy("family").agg(F.count("*").alias("n"), blocks.alias("parts")).filter("n > 1").drop("n")
    related = _cut_and_release(named.join(sized, "family"))
    rows = docs.select(F.xxhash64(F.col(text_col)).alias("th"), F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))

    def alike(placed: DataFrame) -> DataFrame:
        """Edges found in the blocks (family, i, j) that texts are ``placed`` in."""
        placed = _cut_and_release(placed.select("th", "doc_id", "sh", "family", "i", "j", "side", "label", "rare"))
        wanted = _cut_and_release(placed.select(F.col("th").alias("_th"), F.col("doc_id").alias("_first")).distinct())
        on = (F.col("th") == F.col("_th")) & F.col("_id").eqNullSafe(F.col("_first"))
        sets = _shingle_sets(rows.join(small(wanted), on, "left_semi").select("_text"), shingle)
        dealt = sets.join(small(placed), "sh").select("family", "i", "j", "side", "label", "rare", "sh", "s")
        dealt = dealt.repartition(shuffles, "family", "i", "j").sortWithinPartitions("family", "i", "j", "rare", "sh")
        return _cut_and_release(dealt.mapInArrow(lambda batches: _verified(batches, similarity), "a long, b long"))

    block = lambda n: F.pmod(F.xxhash64("sh"), n).cast("int")
    each_block = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    large = related.filter("parts > 1")
    hubs = _cut_and_release(large.groupBy("family", F.pmod(F.xxhash64("sh"), F.lit(HUBS)).alias("k")).agg(F.min(F.struct("rare", "sh"))["sh"].alias("sh")).select("sh"))
    others = related.join(hubs, "sh", "left_anti").withColumn("i", block(F.col("parts")))
    round_one = others.unionByName(large.join(hubs, "sh", "left_semi").withColumn("i", each_block(F.col("parts"))))
    found = alike(round_one.withColumns({"j": F.lit(0), "side": F.lit(2), "label": F.col("sh")}))
    labels = connected_components(found, _cut_and_release).withColumnRenamed("vertex", "sh")
    apart = _cut_and_release(large.join(labels, "sh", "left").withColumn("label", F.coalesce("component", "sh")).drop("component"))
    counted = apart.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("size").alias("m"))
    main = counted.groupBy("family").agg(F.max(F.struct("n", "m", "label")).alias("top"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    beside = F.greatest(F.ceil((F.col("n") - F.col("top.n")) / FAMILY_ROWS), F.ceil((F.col("m") - F.col("top.m")) / FAMILY_SHINGLES)).cast("int")
    main = _cut_and_release(main.select("family", F.col("top.label").alias("main"), beside.alias("lefts")).filter("lefts > 0"))
    if not main.isEmpty():
        both = apart.join(main, "family")
        left = both.filter("label <> main").withColumns({"i": block(F.col("lefts")), "side": F.lit(0)}).withColumn("j", each_block(F.col("parts")))
        right = both.withColumns({"j": block(F.col("parts")), "side": F.lit(1)}).withColumn("i", each_block(F.col("lefts")))
        labels = connected_components(found.unionByName(alike(left.unionByName(right))), _cut_and_release).withColumnRenamed("vertex", "sh")
    least = labels.join(texts.select("sh", "least"), "sh").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = labels.join(least, "component").select("sh", "component", "component_id")
    classes = _cut_and_release(texts.join(linked, "sh", "left").select("sh", F.coalesce("component", "sh").alias("root"), F.coalesce("component_id", "least").alias("component_id")))
    return own.select("doc_id", "th", "sh").join(classes, "sh").select(F.col("doc_id").alias(id_col), "th", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **how) -> DataFrame:
    """One document of each component: the one with the least id, of its texts the one of the least hash.

    Components are those of :func:`near_duplicates`, or with a ``similarity`` those of
    :func:`similar_documents`.  Of rows that repeat an id and a text one stays.  Rows with a null id stay
    only where no row of their component has an id.
    """
    found = near_duplicates if similarity is None else lambda *a, **k: similar_documents(*a, similarity=similarity, **k)
    near = cut(found(docs, id_col, text_col, **how).select(F.col(id_col).alias("id"), "th", "component_id", "root"))
    own = near.filter(F.col("id").eqNullSafe(F.col("component_id")))
    beside = own.join(own.groupBy("root").agg(F.min("th").alias("first")), "root").filter("th <> first")
    gone = near.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "th").unionByName(beside.select("id", "th")).distinct()
    id_name, digest = unused(docs, "_id", "_hash")
    gone = cut(gone.toDF(id_name, digest))
    on = (F.xxhash64(F.col(text_col)) == F.col(digest)) & F.col(id_col).eqNullSafe(F.col(id_name))
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_TEXTS else gone, on, "left_anti")
    if not own.groupBy("id", "th").count().filter("count > 1").isEmpty():
        out = out.withColumn(digest, F.xxhash64(text_col)).dropDuplicates([id_col, digest]).drop(digest)
    return out
