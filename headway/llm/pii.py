"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything is DataFrame functions on one row at a time: no Python, no shuffle.  Each kind's pattern
splits the text into matches and the pieces between them; positions are sums of their lengths, made in
blocks so that a text with very many matches stays linear.  Patterns have guards against starting
inside a run that has failed already, so they are linear in the text too.

Kinds email, ip, card and phone are always kept once valid.  The further kinds iban (mod-97) and ssn
(number ranges) are kept if their score reaches ``KEEP``: shape, checksum and context words add up.

Null and empty texts have no spans.  Spans of different kinds may overlap.  Repeated rows repeat; an
empty table gives an empty result; all columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import unused

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Length of the text before and after a match in which context words count.
NEAR = 40
KEEP = 0.5
_BLOCK = 512


@dataclass(frozen=True)
class Kind:
    name: str
    #: Java pattern.  Possessive where backing off can't lead to another match.
    pattern: str
    #: A plain string without which a text can't match; it spares the scan.
    needs: str | None
    shape: float
    confirmed: float
    context: str
    always: bool
    mask: str


#: In the order in which spans of one start are listed.
KINDS = (
    # A run of local characters is tried from its start, or from where the last match ended, only.
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7, 0.1, r"mail|contact|write", True, "<EMAIL>"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.4, 0.3, r"\bip\b|address|host|server", True, "<IP>"),
    # A chain of digits with single separators, whole, if it has 14 to 19 digits.
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", None, 0.2, 0.6, r"card|visa|credit|payment", True, "<CARD>"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.5, 0.2, r"phone|call|tel|mobile|fax", True, "<PHONE>"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", None, 0.2, 0.5, r"iban|bank|account|konto", False, "<IBAN>"),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-", 0.1, 0.2, r"ssn|social security", False, "<SSN>"),
)
BASE = tuple(k.name for k in KINDS if k.always)
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    """Whether the digits' checksum holds, every second one from the right doubled."""
    n = F.length(digits)
    each = F.split(digits, "")

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d >= 5, d * 2 - 9).otherwise(d * 2)
        return F.when((n - 1 - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.filter(each, lambda c: c != ""), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(text: Column) -> Column:
    """Whether an account number, its first four characters moved to its end, is 1 modulo 97."""
    plain = F.regexp_replace(text, " ", "")
    moved = F.filter(F.split(F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(moved, F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & _mod97(match)
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def _split(df: DataFrame, kind: Kind, text: Column, m: str, p: str) -> DataFrame:
    """``df`` with the kind's matches (column ``m``) and, where there are any, the pieces around them (``p``)."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.needs:
        found = F.when(F.contains(text, F.lit(kind.needs)), found)
    df = df.withColumn(m, F.coalesce(found, none))
    return df.withColumn(p, F.when(F.size(m) > 0, F.split(text, kind.pattern, -1)).otherwise(none))


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR)))).rlike(kind.context)
    return F.round(F.lit(kind.shape + kind.confirmed) + F.when(near, 0.2).otherwise(0.0), 2)


def _starts(matches: Column, pieces: Column) -> Column:
    """Where each match starts, in code points: a running sum, by blocks and within them."""
    whole = F.transform(matches, lambda m, i: F.struct(F.length(F.get(pieces, i)).cast("long").alias("gap"), F.length(m).cast("long").alias("own")))
    blocks = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _BLOCK).cast("int"))
    chunks = F.transform(blocks, lambda b: F.slice(whole, b * _BLOCK + 1, F.lit(_BLOCK)))
    empty = F.array().cast("array<long>")

    def run(values: Column, start: Column, gap, step) -> Column:
        zero = F.struct(start.alias("s"), empty.alias("a"))
        return F.aggregate(values, zero, lambda acc, x: F.struct((acc["s"] + step(x)).alias("s"), F.concat(acc["a"], F.array(acc["s"] + gap(x))).alias("a")))["a"]

    total = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["own"])
    sized = F.transform(chunks, lambda c: F.struct(c.alias("c"), total(c).alias("n")))
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<array<long>>").alias("a"))
    step = lambda acc, x: F.struct((acc["s"] + x["n"]).alias("s"), F.concat(acc["a"], F.array(run(x["c"], acc["s"], lambda y: y["gap"], lambda y: y["gap"] + y["own"]))).alias("a"))
    return F.flatten(F.aggregate(sized, zero, step)["a"])


_SPANS = "array<struct<start:bigint,no:int,end:bigint,kind:string,score:double>>"


def find_spans(df: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """``df`` with its spans, sorted: array of (start, no of the kind, end, kind, score); ends are exclusive."""
    text = F.col(f"`{text_col}`")
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    m, p, *parts = unused(df, "_m", "_p", *[f"_s{no}" for no in range(len(KINDS))])
    for no, kind in enumerate(KINDS):
        df = _split(df, kind, text, m, p)
        df = df.withColumn(parts[no], F.when(F.size(m) > 0, _spans_of(no, kind, F.col(m), F.col(p))).otherwise(F.array().cast(_SPANS)))
    return df.select(*rest, F.array_sort(F.concat(*parts)).alias(out))


def _spans_of(no: int, kind: Kind, matches: Column, pieces: Column) -> Column:
    """The valid spans of the matches."""

    def span(x: Column, i: Column) -> Column:
        m, start = x["m"], x["s"]
        score = F.when(_valid(kind.name, m), _score(kind, F.get(pieces, i), F.get(pieces, i + 1)))
        return F.struct(start.alias("start"), F.lit(no).alias("no"), (start + F.length(m)).alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

    least = 0.0 if kind.always else KEEP
    each = F.transform(F.arrays_zip(matches.alias("m"), _starts(matches, pieces).alias("s")), span)
    return F.filter(each, lambda s: s["score"].isNotNull() & (s["score"] >= least)).cast(_SPANS)


def pii_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, a digest of their spans and all spans as text."""
    rows = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    spans = F.col("pii_spans")
    listed = lambda which: F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter(spans, lambda s: s["no"] < len(BASE))
    count = lambda no: F.size(F.filter(spans, lambda s: s["no"] == no)).cast("long")
    return rows.select(
        F.col("doc_id").alias(id_col),
        *[count(no).alias(f"n_{kind}") for no, kind in enumerate(BASE)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with each valid match replaced by its kind's mark, one kind after another."""
    text = F.col(f"`{text_col}`")
    names = df.columns
    m, p = unused(df, "_m", "_p")
    for kind in KINDS:
        df = _split(df, kind, text, m, p)
        masked = F.when(F.size(m) > 0, _masked(kind, F.col(m), F.col(p))).otherwise(text)
        df = df.withColumn(text_col, masked).select(*[F.col(f"`{c}`") for c in names])
    return df


def _masked(kind: Kind, matches: Column, pieces: Column) -> Column:
    """The pieces with the matches, the valid ones masked, between them."""

    def put(piece: Column, x: Column) -> Column:
        good = _valid(kind.name, x["m"])
        if not kind.always:
            good = good & (_score(kind, piece, x["after"]) >= KEEP)
        return F.concat(piece, F.when(x["m"].isNull(), "").when(good, kind.mask).otherwise(x["m"]))

    with_after = F.transform(matches, lambda m, i: F.struct(m.alias("m"), F.get(pieces, i + 1).alias("after")))
    return F.array_join(F.zip_with(pieces, with_after, put), "")
