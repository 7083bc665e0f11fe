import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from headway.llm import simhash
from headway.llm.common import cut
from headway.operators.graph import connected_components


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance):
    near = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= distance
    label = values.copy()
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize(("distance", "block"), [(3, 4096), (3, 16), (7, 4096), (7, 8), (5, 40)])
def test_links_of_clouds_equal_brute_force(spark, distance, block):
    """Also where groups are dealt out in blocks."""
    rng = np.random.default_rng(1)
    values = set(map(int, rng.integers(-(2**63), 2**63 - 1, 150)))
    for base in rng.integers(-(2**63), 2**63 - 1, 3):
        for _ in range(120):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= -(1 << 63) if bit == 63 else 1 << int(bit)
            values.add(x)
    values = np.array(sorted(values), np.int64)
    fps = spark.createDataFrame([(int(v),) for v in values], "fp long")
    found = {r["vertex"]: r["component"] for r in connected_components(simhash.links(fps, distance, block), cut).collect()}
    assert [found.get(int(v), int(v)) for v in values] == brute_components(values, distance).tolist()


def test_fingerprints_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        text = " ".join(rng.choice(["a", "B", "é", "the", "of", "x\ty"]) for _ in range(rng.randint(0, 30)))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    long = " ".join(rng.choice("abcdef") * rng.randint(1, 4) for _ in range(70_000))
    assert simhash.fingerprint(long.encode()) == brute_fingerprint(long)


def test_spark_hash_is_the_same(spark):
    text = "some three words é"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64)


def test_components_carry_least_ids(odd_docs, no_docs):
    rows = odd_docs.collect()
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["fp"] == by_id[1]["fp"] == by_id[2]["fp"] == 0
    assert by_id[0]["component_id"] == by_id[2]["component_id"] == 0
    assert by_id[5]["component_id"] == by_id[6]["component_id"] == 5
    assert by_id[7]["component_id"] == by_id[8]["component_id"] == 7
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_stays(odd_docs, no_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == sorted((i is None, i) for i in [0, 3, 4, 5, 7, 9, None])
    assert simhash.one_of_each(no_docs).count() == 0


def test_chains_are_followed(spark):
    """0-1-2-... each two bits from the next: one component."""
    chain, x = [], 0
    for i in range(30):
        x ^= 0b11 << 2 * i
        chain.append((i, x - (1 << 64) if x >> 63 else x))
    found = connected_components(simhash.links(spark.createDataFrame(chain, "i long, fp long").select("fp")), cut).collect()
    assert len(found) == 30 and len({r["component"] for r in found}) == 1


def similar_components(sets, similarity=0.8):
    """The least id of each set's component over Jaccard similarity, by brute force."""
    label = {i: i for i in sets}
    edges = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in edges:
            m = min(label[i], label[j])
            if (label[i], label[j]) != (m, m):
                label[i] = label[j] = m
                changed = True
    return label


def _families(rng, most_changes):
    """Copies of bases with some words changed, and texts that share half of a base."""
    rows = []
    for family in range(6):
        base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
        for copy in range(40 if family == 0 else 8):
            words = list(base)
            for _ in range(0 if copy == 3 else rng.randint(1, most_changes)):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(base[:150] + [f"other{k}" for k in range(150)])))
    return rows + [(900, "a b c"), (901, "A  b\tc"), (902, "a b d"), (903, ""), (904, None), (905, " ")]


@pytest.mark.parametrize(("most_changes", "found"), [(2, 1.0), (6, 0.9)])
def test_checked_similarity_against_brute_force(spark, most_changes, found):
    """Copies are alike through their base.  Nothing else is linked; of copies at the limit few are missed."""
    rows = _families(random.Random(12), most_changes)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = similar_components({i: set(simhash._shingles((t or "").encode(), 5)) for i, t in rows})
    assert all(want[i] == want[c] for i, c in got.items())
    copies = [i for i in want if want[i] != i]
    assert sum(got[i] == want[i] for i in copies) >= found * len(copies)


def test_checked_similarity_on_odd_tables(odd_docs, no_docs):
    got = simhash.similar_documents(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[5] == by_id[6] == 5 and by_id[7] == by_id[8] == 7
    kept = simhash.one_of_each(odd_docs, similarity=0.8)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == sorted((i is None, i) for i in [0, 3, 4, 5, 7, 9, None])
    assert simhash.one_of_each(no_docs, similarity=0.8).count() == 0


def _equals_brute_force(spark, texts):
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == similar_components({i: set(simhash._shingles(t.encode(), 5)) for i, t in enumerate(texts)})


def test_all_copies_meet_their_base(spark):
    """Whichever text of a family of one fingerprint has the least hash."""
    rng = random.Random(31)
    base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(400):
        words = list(base)
        for at in rng.sample(range(300), rng.randint(1, 6)):
            words[at] = f"new{rng.random()}"
        texts.append(" ".join(words))
    _equals_brute_force(spark, texts)


def test_large_groups_are_closed_over_chains(spark, monkeypatch):
    """Families without a base, of copies of copies, also where families meet in many blocks."""
    monkeypatch.setattr(simhash, "GLUED", 8)
    monkeypatch.setattr(simhash, "FAMILY_ROWS", 16)
    rng = random.Random(32)
    texts = []
    for _ in range(2):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
        for k in range(90):
            for at in rng.sample(range(0, 300, 3), 1 + k % 6):
                words[at] = f"new{rng.random()}"
            texts.append(" ".join(words))
    _equals_brute_force(spark, texts)


def test_pairs_of_short_texts_are_found(spark):
    """Pairs at 0.80 to 0.85 whose words' fingerprints differ in 6 to 10 bits."""
    pairs = [(7412, 9934), (4024, 2938), (5208, 2382), (7237, 1016), (2789, 8154), (2540, 4), (205, 4)]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(F.col("doc_id").isin([i for p in pairs for i in p]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert all(got[a] == got[b] for a, b in pairs)


def test_texts_of_one_fingerprint_meet_each_other(spark):
    """Pairs of near copies whose words also stand in other texts in another order."""
    rng = random.Random(33)
    texts = []
    for _ in range(12):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(200)]
        swapped = list(words)
        swapped[50], swapped[51] = swapped[51], swapped[50]
        texts += [" ".join(rng.sample(words, 200)), " ".join(words), " ".join(rng.sample(words, 200)), " ".join(swapped)]
    _equals_brute_force(spark, texts)


def test_edges_of_alike_sets_join_what_brute_force_joins():
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 2**63, 120).astype(np.uint64))
    sets = []
    for k in range(80):
        drop = rng.random(len(base)) < 0.002 * k
        sets.append(np.unique(np.r_[base[~drop], rng.integers(0, 2**63, int(drop.sum()) // 2).astype(np.uint64)]))
    sets.append(np.zeros(0, np.uint64))
    label = np.arange(len(sets))
    found = simhash._join_alike(sets, label, *(np.arange(len(sets)),) * 2, 0.8)
    want = similar_components({i: set(s.tolist()) or {f"none{i}"} for i, s in enumerate(sets)})
    assert len(found) == len(sets) - len(set(want.values()))
    assert len(set(zip(label.tolist(), want.values(), strict=True))) == len(set(want.values())) == len(set(label.tolist()))


def test_one_of_each_with_repeated_ids(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "TUV"}
    rows = [(3, texts["T"]), (5, texts["U"]), (5, texts["T"]), (3, texts["V"]), (3, texts["V"])]
    for similarity in (None, 0.8):
        kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity)
        assert sorted(map(tuple, kept.collect())) == sorted(set(rows) - {(5, texts["T"])})


def test_histograms_bound_what_sets_have_apart():
    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for n in (1, 5, 40, 300, 3000, 30_000):
        base = draw(n)
        for share in (0.0, 0.1, 0.5, 1.0):
            other = np.unique(np.r_[base[: int(n * (1 - share))], draw(int(n * share * rng.uniform(0.5, 1.2)))])
            mine = np.unique(base)
            a, b = simhash._histogram(mine).astype(int), simhash._histogram(other).astype(int)
            w = min(len(a), len(b))
            apart = np.abs(a.reshape(-1, w).sum(axis=0) - b.reshape(-1, w).sum(axis=0)).sum()
            assert apart <= len(np.setxor1d(mine, other))
            if share == 1.0 and n >= 300:
                assert apart > simhash._unlike(len(mine), len(other), 0.8)


def test_groups_meet_as_brute_force_says():
    """Rows of several groups, also of texts of very different length; every alike pair of a group is found."""
    rng = np.random.default_rng(6)
    sets, rows = [], []
    for size in (30, 400, 5000):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        for k in range(12):
            drop = rng.random(size) < 0.015 * k
            sets.append(np.unique(np.r_[base[~drop], rng.integers(0, 2**63, int(drop.sum())).astype(np.uint64)]))
    for t in range(4):
        rows += [(t, k, len(sets[k]), t, simhash._histogram(sets[k]).tobytes()) for k in range(len(sets)) if k % 4 != t]
    table = pa.table({n: pa.array(c, k) for n, c, k in zip(("t", "fp", "size", "pos", "places"), zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)})
    got = {(b, a) for batch in simhash._meeting(iter(table.to_batches(max_chunksize=7)), 0.8) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    alike = {(x, y) for x in range(len(sets)) for y in range(x + 1, len(sets)) if len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))}
    met = {(x, y) for x, y in alike if any(x % 4 != t and y % 4 != t for t in range(4))}
    assert met and met <= got
    assert all(x // 12 == y // 12 for x, y in got)  # nothing of different texts
