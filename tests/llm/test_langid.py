import numpy as np
from pyspark.sql import functions as F

from headway.llm import langid
from headway.llm.common import id_fold


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = id_fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held)
    rows = langid.identify(docs, model).filter(held).select((F.col("lang") == F.col("lang_pred")).alias("ok"), "lang_rejected").collect()
    assert sum(r["ok"] for r in rows) >= 0.97 * len(rows)
    assert sum(r["lang_rejected"] for r in rows) <= 0.01 * len(rows)


def test_odd_tables(odd_docs, no_docs, spark):
    model = langid.fit(["the river and stone"] * 5 + ["der fluss und stein"] * 5, ["en"] * 5 + ["de"] * 5)
    got = {r["doc_id"]: r for r in langid.identify(odd_docs, model).collect()}
    assert langid.identify(odd_docs, model).columns == [*[c for c in odd_docs.columns if c != "lang_pred"], "lang_pred", "lang_score", "lang_rejected"]
    for i in (0, 1, 2):
        assert (got[i]["lang_pred"], got[i]["lang_score"], got[i]["lang_rejected"]) == ("und", 0.0, True)
    assert got[7]["lang_pred"] == "en" and 0 <= got[7]["lang_score"] <= 1
    assert langid.identify(no_docs, model).count() == 0
    assert langid.train(no_docs, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.identify(odd_docs, None).collect()} == {"und"}


def test_batches_do_not_matter():
    model = langid.fit(["the river and stone", "of the lamp"] * 20 + ["der fluss und stein", "die lampe"] * 20, ["en", "en"] * 20 + ["de", "de"] * 20)
    texts = ["the stone", "", None, "und der", "12 34", "lamp " * 500]
    whole, _ = model.scores(texts)
    for i, t in enumerate(texts):
        assert abs(model.scores([t])[0][0] - whole[i]).max() < 1e-6


def test_long_runs_are_judged_whole():
    """A word's middle counts, as in scripts without spaces."""
    model = langid.fit(["河流石头安静" * 3, "灯光港口"] * 20 + ["แม่น้ำและหิน" * 3, "ท่าเรือ"] * 20, ["zh", "zh"] * 20 + ["th", "th"] * 20)
    text = "ท่าเรือ" * 3 + "河流石头安静" * 4000 + "ท่าเรือ" * 3
    for text, lang in ((text, "zh"), ("灯光港口" * 5 + "แม่น้ำและหิน" * 4000 + "灯光港口" * 5, "th")):
        p, _ = model.scores([text, "a b"])
        assert model.langs[p[0].argmax()] == lang
    word = text.encode()
    marked = b"<" + word + b">"
    assert len(langid.buckets_of(word)) == 3 * len(marked) - 5


def test_rejection_is_relative_to_the_number_of_languages():
    """Between an even share and the least kept-back score, also for two languages."""
    words = {"en": "the river stone of lamp", "de": "der fluss stein und lampe"}
    model = langid.fit([words[x] for x in words] * 40, list(words) * 40)
    assert 0.5 < model.threshold < 1
    p, _ = model.scores(["the river stone of lamp", "the fluss der river stein stone"])
    assert p[0].max() >= model.threshold > 0.5


def test_languages_of_long_texts_are_learned(spark):
    rows = [(i, "the river and stone " * 3, "en") for i in range(30)] + [(100 + i, "der fluss und stein " * 1500, "de") for i in range(30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == ["de", "en"]
    long = langid.train(spark.createDataFrame(rows[30:], "doc_id long, text string, lang string"), F.lit(True))
    assert long.langs == ["de"]


def test_what_is_no_language_is_rejected(spark):
    """Shuffled letters, random letters, digests, other scripts; clean held-out documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = id_fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held)
    assert 0.01 < model.temperature < 100
    rng = np.random.default_rng(5)
    text = docs.filter(held & (F.length("text") > 400)).first()["text"]
    junk = [
        "xqzt brlk wvnm pqrs zzkt qqwv", "Привет, как дела сегодня?", "これは日本語の文章です", "안녕하세요 세계 여러분", "გამარჯობა მსოფლიო", "სახლი და წყალი",
        "deadbeef 01ab23cd fe12aa99 77aa 9e8f", *["".join(chr(97 + i) if i < 26 else " " for i in rng.integers(0, 31, 200)) for _ in range(5)],
        *["".join(rng.permutation(list(text))) for _ in range(5)],
    ]
    p, _ = model.scores(junk)
    assert (p.max(axis=1) < model.threshold).mean() >= 0.9
    rows = langid.identify(docs, model).filter(held).select("lang_rejected").collect()
    assert sum(r[0] for r in rows) <= 0.01 * len(rows)


def test_scores_equal_brute_force():
    """The mean of the buckets' logits, in plain Python."""
    import zlib

    model = langid.fit(["the river and stone", "of the lamp"] * 20 + ["der fluss und stein", "die lampe"] * 20, ["en", "en"] * 20 + ["de", "de"] * 20)
    for text in ("The river; of stein", "x", "lamp LAMPE 12 lamp", "é" * 50):
        total, n = [0.0] * 3, 0
        for word in "".join(c if not c.isascii() or c.isalpha() else " " for c in text.lower()).split():
            data = b"<" + word.encode() + b">"
            buckets = [zlib.crc32(data[i : i + k]) % langid.BUCKETS for k in (2, 3, 4) for i in range(len(data) - k + 1)] + [zlib.crc32(data, 7) % langid.BUCKETS]
            n += len(buckets)
            total = [t + sum(float(model.logits[b][j]) for b in buckets) for j, t in enumerate(total)]
        z = [(t / n + float(b)) / model.temperature for t, b in zip(total, model.bias, strict=True)]
        e = [np.exp(x - max(z)) for x in z]
        got, _ = model.scores([text])
        assert np.allclose(got[0], [x / sum(e) for x in e[:2]], atol=1e-5)


def test_recognised_documents_keep_their_columns(odd_docs):
    model = langid.fit(["the river and stone"] * 30 + ["der fluss und stein"] * 30, ["en"] * 30 + ["de"] * 30)
    kept = langid.recognised(odd_docs, model)
    assert kept.dtypes == odd_docs.dtypes
    assert {r["lang_pred"] for r in kept.collect()} <= {r["lang_pred"] for r in odd_docs.collect()}
