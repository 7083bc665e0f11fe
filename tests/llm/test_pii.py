import hashlib
import random
import re

from headway.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            g = m.group()
            digits = re.sub("[^0-9]", "", g)
            if kind == "ip" and any(int(p) > 255 for p in g.split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    bits = ["a", "Z", ".", "@", "-", "+", "_", "%", "1", "4", "9", "0", " ", "(", ")", "é", "\U0001f600", "\n", "10.1.2.3", "a@b.c", "4111 1111 1111 1111", "+1 555 123 4567", "4041894974608795", "256.1.1.1", "@b.c", "x@"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(3000)] + [(-1, None), (-2, ""), (-3, "1.2.3.4 " * 1500 + "a@b.co " * 600)]
    got = {r["doc_id"]: r for r in pii.pii_summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        spans = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest(), text
        for kind in PATTERNS:
            assert got[i][f"n_{kind}"] == sum(s[3] == kind for s in spans)


def test_long_runs_are_linear(spark):
    rows = [(0, "a" * 300_000 + "@"), (1, "1" * 300_000), (2, "+1" + " (" * 100_000), (3, "a." * 100_000 + "@" + "a." * 100_000)]
    got = {r["doc_id"]: r for r in pii.pii_summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_email"] == got[1]["n_card"] == got[2]["n_phone"] == 0
    assert got[3]["spans"] == "email:0:400000"


def test_further_kinds_need_their_checks(spark):
    rows = [(0, "IBAN DE89 3704 0044 0532 0130 00 now"), (1, "IBAN DE89 3704 0044 0532 0130 01 now"), (2, "my ssn is 123-45-6789."), (3, "part 123-45-6789."), (4, "ssn 000-45-6789")]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "iban:5:32", 1: "", 2: "ssn:10:21", 3: "", 4: ""}


def test_mask_leaves_the_rest(spark):
    rows = [(0, "a@b.co and 10.0.0.1, 4111 1111 1111 1111; +1 (555) 123-4567!", 1), (1, None, 2), (2, "plain 12 34", 3), (3, "4111 1111 1111 1112", 4)]
    got = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string, _p long")).collect()}
    assert got == {0: "<EMAIL> and <IP>, <CARD>; <PHONE>!", 1: None, 2: "plain 12 34", 3: "4111 1111 1111 1112"}


def test_odd_and_empty_tables(odd_docs, no_docs):
    assert pii.pii_summary(odd_docs).count() == odd_docs.count()
    assert sorted(pii.find_spans(odd_docs).columns) == sorted([*odd_docs.columns, "pii_spans"])
    assert pii.mask(odd_docs).count() == odd_docs.count()
    assert pii.pii_summary(no_docs).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = pii.pii_summary(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan
