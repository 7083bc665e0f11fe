import pytest

import corpus_pipeline
from headway.llm import decontam, pii, simhash
from tests.llm.test_pii import base_spans
from tests.llm.test_simhash import similar_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet").cache()]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stage(spark, docs[-1], SF).cache())
    return docs


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_stages_against_brute_force(steps, spark):
    rows = [{r["doc_id"]: r["text"] for r in df.collect()} for df in steps[:-1]]
    assert len(rows[1]) >= 0.99 * len(rows[0])
    sets = {i: set(simhash._shingles(t.encode(), 5)) for i, t in rows[1].items()}
    label = similar_components(sets)
    assert set(rows[2]) == set(label.values())
    items = [(r["item_id"], decontam.words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for _, w in items for i in range(max(1, len(w) - 12)) if w}
    kept = set()
    for i, t in rows[2].items():
        w = decontam.words_of(t)
        hit = {k for a in range(len(w)) for n in {len(x) for x in windows} if tuple(w[a : a + n]) in windows for k in range(a, a + n)}
        if not hit or 20 * len(hit) < len(w):
            kept.add(i)
    assert set(rows[3]) == kept and all(rows[3][i] == rows[2][i] for i in kept)
    assert set(rows[4]) == set(rows[3])
    for i, t in rows[4].items():
        assert not base_spans(t)
        if not base_spans(rows[3][i]):
            assert t == rows[3][i]
    assert {r["doc_id"] for r in steps[5].collect()} == set(rows[4])


def test_run_gives_the_last_stage(steps, spark):
    got, want = corpus_pipeline.run(spark, SF), steps[-1]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_marks_have_no_spans_themselves():
    assert not base_spans(" ".join(k.mask for k in pii.KINDS))
