import hashlib
import random

import pytest

from headway.llm import decontam


def brute(doc, items, window):
    hit, found = set(), set()
    for name, words in items:
        for w in [words[i : i + window] for i in range(len(words) - window + 1)] if len(words) >= window else [words] * bool(words):
            for i in range(len(doc) - len(w) + 1):
                if doc[i : i + len(w)] == w:
                    found.add(name)
                    hit.update(range(i, i + len(w)))
    return len(hit), found


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        window, letters = rng.randint(1, 5), [bytes([97 + i]) for i in range(rng.randint(1, 4))]
        items = [(k, [rng.choice(letters) for _ in range(rng.randint(0, 9))]) for k in range(rng.randint(0, 5))]
        doc = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 40))]
        spans, found = decontam.SuffixAutomaton(items, window).spans(doc)
        assert (sum(b - a for a, b in spans), found) == brute(doc, items, window)
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("most", [10**6, 25])
def test_several_automata_give_the_same(spark, most, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 14, 20])))) for i in range(12)] + [(98, None), (99, "")]
    docs = [(i, " ".join([rng.choice(words) for _ in range(10)] + items[i % 12][1].split()[:16] + [rng.choice(words) for _ in range(5)])) for i in range(60)] + [(-1, None)]
    real = decontam.item_parts
    monkeypatch.setattr(decontam, "item_parts", lambda b: real(b, most_words=most))
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in got:
        doc = decontam.words_of(dict(docs)[r["doc_id"]])
        hit, found = brute(doc, [(i, decontam.words_of(t)) for i, t in items], 13)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(doc), hit, len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= len(doc))


def test_clean_documents_stay_as_they_are(spark):
    passage = " ".join(f"q{i}" for i in range(15))
    filler = " ".join(f"f{i}" for i in range(400))
    docs = [(0, f"{passage} end", "a"), (1, f"{filler} {passage}", "b"), (2, filler, "c"), (3, None, "d")]
    df, items = spark.createDataFrame(docs, "doc_id long, text string, _spans string").drop("_spans"), spark.createDataFrame([(0, passage)], "item_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in decontam.drop_contaminated(df, items).collect()}
    assert kept == {1: docs[1][1], 2: filler, 3: None}
    cleaned = {r["doc_id"]: r["text"] for r in decontam.remove_spans(df, items).collect()}
    assert cleaned == {0: " end", 1: filler + " ", 2: filler, 3: None}


def test_odd_and_empty_tables(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, "the river stone")], "item_id long, text string")
    assert decontam.contamination(odd_docs, items).count() == odd_docs.count()
    assert decontam.contamination(no_docs, items).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(odd_docs, items.limit(0)).collect()} == {0}
    assert decontam.drop_contaminated(odd_docs, items).columns == odd_docs.columns
