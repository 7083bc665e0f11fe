import random
import re

from headway.llm import license_scan

PHRASES = [(p.split(" "), label) for p, label in license_scan.PHRASES.items()]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(i, label) for p, label in PHRASES for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_equals_brute_force(spark):
    rng = random.Random(3)
    bits = ["cc", "by", "CC", "general", "Public", "license", "all", "rights", "reserved", "x", "été", "-", ".", "\n", "4"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(1500)] + [(-1, None), (-2, ""), (-3, "cc by " * 5000)]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text), text
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_passages_survive_small_changes(spark):
    whole = license_scan.TEMPLATES["mit"][1].split(" ")
    changed = " ".join(["before", *whole[:6], "inserted", *whole[6:], "after"])
    half = " ".join(whole[: len(whole) // 2])
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(spark.createDataFrame([(0, changed), (1, half), (2, " ".join(whole))], "doc_id long, text string")).collect()}
    assert got == {0: "mit", 1: "", 2: "mit"}


def test_odd_tables(odd_docs, no_docs):
    got = license_scan.scan_licenses(odd_docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd_docs.collect())
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = license_scan.scan_licenses(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_templates(spark):
    """Of over 64 words, whole, changed in places, and half of it; also of base phrases."""
    words = license_scan.TEMPLATES["mit"][2].split(" ")
    assert len(words) > 128
    changed = " ".join(w for i, w in enumerate(words) if i % 40 != 20)
    phrase = " ".join(words[:100])
    docs = [(0, " ".join(words)), (1, f"x {changed} y"), (2, " ".join(words[90:])), (3, " ".join(words[:99]))]
    templates = {"long": (" ".join(words),)}
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), {phrase: "base"}, templates).collect()}
    assert [got[i]["labels"] for i in range(4)] == ["base,long", "long", "", ""]
    assert [got[i]["n_base"] for i in range(4)] == [1, 0, 0, 0] and got[0]["score"] == 1.0


def test_only_ascii_letters_are_lowered(spark):
    got = license_scan.scan_licenses(spark.createDataFrame([(0, "\u212airk by CC BY")], "doc_id long, text string"), {"kirk by": "k", "cc by": "cc"}).first()
    assert got["base_labels"] == "cc"
