import zlib

from headway.llm import sharding


def test_law_holds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_documents(docs).toPandas()
    texts = docs.toPandas().set_index("doc_id")["text"]
    assert sorted(rows["doc_id"]) == sorted(texts.index)
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1.2 * rows["size"].max()
    assert (rows.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s))))).all()
    for r in rows.itertuples():
        data = texts[r.doc_id].encode()
        assert rows.at[r.Index, "size"] == len(data) + 16 and r.text_crc32 == zlib.crc32(data)


def test_hot_copies_are_spread(spark):
    rows = [(i, "the very same text " * 5) for i in range(600)] + [(1000 + i, f"text {i} " * (i % 9 + 1)) for i in range(300)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() <= 1.25 * sizes.mean()


def test_few_shards_agree_with_sorting(spark):
    """One dimension, two shards: the cut is the weighted median."""
    rows = [(i, "x" * i) for i in range(1, 200)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=2).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert abs(sizes[0] - sizes[1]) <= 2 * got["size"].max()


def test_odd_and_empty_tables(odd_docs, no_docs):
    got = sharding.shard_documents(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["shard"] < 40 for r in got)
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 0} == {(16, 0)}
    assert sharding.shard_documents(no_docs).count() == 0
