"""The text operators' queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import decontam, langid, license_scan, media, packing, pii, quality, sharding, simhash, tokens
from headway.llm.common import documents, id_fold


def vocabulary() -> str:
    """Where the public word-level byte-pair vocabulary lies, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_summary(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_fold(F.col("doc_id"), 5) == 0
    scored = quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir)).drop("passages")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(documents(spark, sf_dir))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.pieces(documents(spark, sf_dir), vocabulary()))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), vocabulary())


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held_out)
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_quality, op3_media, op4_sharding, op5_licenses, op6_simhash, op7_decontam, op8_packing, op9_tokens, op10_langid)}


_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: Every window of every item against every run of as many words of every document.
_DECONTAM_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
    b AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, unnest(list_transform(range(greatest(len(ws) - 12, 1)), lambda i: array_to_string(ws[i + 1 : i + 13], ' '))) AS gram FROM b WHERE len(ws) > 0),
    lengths AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, unnest(range(len(ws) - n + 1)) AS i, unnest(list_transform(range(len(ws) - n + 1), lambda i: array_to_string(ws[i + 1 : i + n], ' '))) AS gram FROM d, lengths WHERE len(ws) >= n),
    hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, gram)),
    places AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS sha FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _pii_sql() -> str:
    """Matches of each kind by simpler patterns, positions from the lengths around them, the checks, and the words nearby."""
    found = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        # What the full pattern looks at on either side makes a match begin (and, for the last, end) a run of these.
        "iban": r"[A-Za-z0-9]+",
        "ssn": r"[0-9A-Za-z-]+",
    }
    rows = []
    for no, kind in enumerate(pii.KINDS):
        p = found[kind.name].replace("'", "''")
        rows.append(f"SELECT doc_id, t, {no} AS no, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS p FROM d")
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(len({digits})), lambda i: CASE WHEN (len({digits}) - 1 - i) % 2 = 0 THEN CAST({digits}[i + 1] AS INTEGER) WHEN CAST({digits}[i + 1] AS INTEGER) >= 5 THEN 2 * CAST({digits}[i + 1] AS INTEGER) - 9 ELSE 2 * CAST({digits}[i + 1] AS INTEGER) END)) % 10 = 0"
    plain = "replace(m, ' ', '')"
    moved = f"array_to_string(list_transform(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
    mod97 = f"list_reduce(list_transform(string_split({moved}, ''), lambda c: CAST(c AS BIGINT)), lambda a, c: (a * 10 + c) % 97) = 1"
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    valid = f"""CASE no WHEN 0 THEN true WHEN 1 THEN regexp_full_match(m, '{part}(?:\\.{part}){{3}}') WHEN 2 THEN len({digits}) BETWEEN 14 AND 19 AND {luhn} WHEN 3 THEN len({digits}) BETWEEN 10 AND 15
        WHEN 4 THEN len({plain}) BETWEEN 15 AND 34 AND {mod97} ELSE NOT regexp_matches(m, '^(?:000|666|9..)|-00-|-0000$') END"""
    of = lambda get: "CASE no " + " ".join(f"WHEN {no} THEN {get(k)}" for no, k in enumerate(pii.KINDS)) + " END"
    score = f"round({of(lambda k: f'CAST({k.shape + k.confirmed} AS DOUBLE)')} + CASE WHEN regexp_matches(lower(right(before, {pii.NEAR}) || ' ' || left(after, {pii.NEAR})), {of(lambda k: chr(39) + k.context + chr(39))}) THEN CAST(0.2 AS DOUBLE) ELSE 0 END, 2)"
    listed = lambda which: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) FILTER ({which}), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(rows)}),
    r AS (SELECT doc_id, t, no, m[i] AS m, list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS s FROM f, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)),
    l AS (SELECT doc_id, t, no, s, CASE no WHEN 4 THEN regexp_extract(substr(t, CAST(s AS BIGINT) + 1, 80), '^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}') ELSE m END AS m FROM r),
    g AS (SELECT *, s + len(m) AS e FROM l WHERE m <> '' AND (no <> 4 OR NOT regexp_matches(substr(t, CAST(s + len(m) AS BIGINT) + 1, 1), '[A-Za-z0-9]')) AND (no <> 5 OR regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')) AND (no <> 2 OR len({digits}) BETWEEN 14 AND 19)),
    n AS (SELECT *, coalesce(lag(e) OVER w, 0) AS b, coalesce(lead(s) OVER w, len(t)) AS z FROM g WINDOW w AS (PARTITION BY doc_id, no ORDER BY s)),
    c AS (SELECT *, {of(lambda k: chr(39) + k.name + chr(39))} AS kind, substr(t, CAST(b AS BIGINT) + 1, CAST(s - b AS BIGINT)) AS before, substr(t, CAST(e AS BIGINT) + 1, CAST(z - e AS BIGINT)) AS after FROM n WHERE {valid}),
    k AS (SELECT *, {score} AS score FROM c), kept AS (SELECT * FROM k WHERE no < {len(pii.BASE)} OR score >= {pii.KEEP}),
    o AS (SELECT doc_id, {", ".join(f"count(*) FILTER (no = {i}) AS n_{k}" for i, k in enumerate(pii.BASE))}, {listed(f"no < {len(pii.BASE)}")} AS base, {listed("true")} AS spans, max(score) AS top_score FROM kept GROUP BY doc_id)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(top_score, 0) AS top_score FROM d LEFT JOIN o USING (doc_id)"""


def _simhash_sql() -> str:
    """XXH64 by its definition in numbers of 128 bits, bits by counting, links between all pairs, reachability."""
    # The hash's five primes.
    p1, p2, p3, p4, p5 = (f"CAST({n} AS UHUGEINT)" for n in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    whole = f"CAST({1 << 64} AS UHUGEINT)"
    seed = f"CAST({simhash.SEED} AS UHUGEINT)"
    mul = lambda x, y: f"(({x}) * {y} % {whole})"
    rot = lambda x, r: f"((({x}) * CAST({1 << r} AS UHUGEINT)) % {whole} + ({x}) // CAST({1 << 64 - r} AS UHUGEINT))"
    lane = lambda at, n: "CAST(CAST('0x' || " + " || ".join(f"substr(h, CAST({at} + {2 * k + 1} AS BIGINT), 2)" for k in reversed(range(n))) + " AS UBIGINT) AS UHUGEINT)"
    stripes = lambda k: f"list_transform(range(n // 32), lambda i: {mul(lane(f'64 * i + {16 * k}', 8), p2)})"
    turn = lambda start, k: f"list_reduce(list_prepend({start}, {stripes(k)}), lambda a, x: {mul(rot(f'(a + x) % {whole}', 31), p1)})"
    starts = (f"({seed} + {p1} + {p2}) % {whole}", f"{seed} + {p2}", seed, f"({seed} + {whole} - {p1}) % {whole}")
    merged = "(" + " + ".join(rot(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))) + f") % {whole}"
    rounds = "list_value(" + ", ".join(mul(rot(mul(f"v{k}", p2), 31), p1) for k in range(4)) + ")"
    bits = ", ".join(f"sum((x >> {b}) & 1) AS b{b}" for b in range(64))
    value = " + ".join(f"CASE WHEN 2 * b{b} > n THEN CAST({1 << b} AS UHUGEINT) ELSE CAST(0 AS UHUGEINT) END" for b in range(64))
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    g AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(len(ws) - 2), lambda i: array_to_string(ws[i + 1 : i + 3], ' ')) ELSE [array_to_string(ws, ' ')] END) AS gram FROM w WHERE len(ws) > 0),
    h0 AS (SELECT gram, hex(encode(gram)) AS h, CAST(octet_length(encode(gram)) AS BIGINT) AS n FROM (SELECT DISTINCT gram FROM g)),
    h1 AS (SELECT *, {", ".join(f"{turn(s, k)} AS v{k}" for k, s in enumerate(starts))} FROM h0),
    h2 AS (SELECT gram, h, n, ((CASE WHEN n >= 32 THEN list_reduce(list_prepend({merged}, {rounds}), lambda a, x: ({mul("xor(a, x)", p1)} + {p4}) % {whole}) ELSE {seed} + {p5} END) + CAST(n AS UHUGEINT)) % {whole} AS x FROM h1),
    h3 AS (SELECT gram, h, n, list_reduce(list_prepend(x, list_transform(range(n // 32 * 4, n // 8), lambda i: {mul(rot(mul(lane("16 * i", 8), p2), 31), p1)})), lambda a, k: ({mul(rot("xor(a, k)", 27), p1)} + {p4}) % {whole}) AS x FROM h2),
    h4 AS (SELECT gram, h, n, CASE WHEN n % 8 >= 4 THEN xor(x, {mul(lane("n // 8 * 16", 4), p1)}) END AS y, x FROM h3),
    h5 AS (SELECT gram, h, n, CASE WHEN y IS NOT NULL THEN ({mul(rot("y", 23), p2)} + {p3}) % {whole} ELSE x END AS x FROM h4),
    h6 AS (SELECT gram, list_reduce(list_prepend(x, list_transform(range(n // 4 * 4, n), lambda i: {mul(lane("2 * i", 1), p5)})), lambda a, k: {mul(rot("xor(a, k)", 11), p1)}) AS x FROM h5),
    h7 AS (SELECT gram, {mul(f"xor(x, x // CAST({1 << 33} AS UHUGEINT))", p2)} AS x FROM h6),
    h8 AS (SELECT gram, {mul(f"xor(x, x // CAST({1 << 29} AS UHUGEINT))", p3)} AS x FROM h7),
    h9 AS (SELECT gram, CAST(xor(x, x // CAST({1 << 32} AS UHUGEINT)) AS UBIGINT) AS x FROM h8),
    b AS (SELECT doc_id, count(*) AS n, {bits} FROM g JOIN h9 USING (gram) GROUP BY doc_id),
    f AS (SELECT w.doc_id, CAST(coalesce({value}, CAST(0 AS UHUGEINT)) AS UBIGINT) AS fp FROM w LEFT JOIN b USING (doc_id)),
    d AS (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
    l AS (SELECT p.fp AS a, q.fp AS b FROM d p JOIN d q ON bit_count(xor(p.fp, q.fp)) <= {simhash.DISTANCE}),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT doc_id, lower(lpad(to_hex(f.fp), 16, '0')) AS fingerprint, component_id FROM f JOIN (SELECT r.a AS fp, min(least) AS component_id FROM r JOIN d ON r.b = d.fp GROUP BY 1) c USING (fp)"""


def _licenses_sql() -> str:
    """Word pairs joined to those of the templates, diagonals, bands of neighbours, shares."""
    every = [(p, label, True) for p, label in license_scan.PHRASES.items()] + [(t, label, False) for label, ts in license_scan.TEMPLATES.items() for t in ts]
    pairs = []
    for no, (text, label, base) in enumerate(every):
        words = text.split(" ")
        pairs += [f"({no}, '{label}', {base}, {len(words) - 1}, {q}, '{a} {b}')" for q, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    labels = lambda which: f"coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER ({which}), '')"
    return f"""WITH t(template, label, base, pairs, q, gram) AS (VALUES {", ".join(pairs)}), d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
    g AS (SELECT doc_id, unnest(range(len(ws) - 1)) AS p, unnest(list_transform(range(len(ws) - 1), lambda i: ws[i + 1] || ' ' || ws[i + 2])) AS gram FROM d WHERE len(ws) > 1),
    h AS (SELECT DISTINCT doc_id, template, label, base, pairs, q, p - q AS diagonal FROM g JOIN t USING (gram)),
    n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= CASE WHEN base THEN 0 ELSE {license_scan.GAP} END THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT doc_id, template, base, diagonal FROM h)),
    b AS (SELECT doc_id, template, diagonal, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS band FROM n),
    m AS (SELECT doc_id, template, label, base, band, count(DISTINCT q) / pairs AS share, min(diagonal) AS low FROM h JOIN b USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, base, pairs, band),
    s AS (SELECT *, CASE WHEN base THEN share = 1 ELSE share >= {license_scan.CONFIRM} END AS good FROM m),
    o AS (SELECT doc_id, count(*) FILTER (base AND good) AS n_base, min(low) FILTER (base AND good) AS first_word, max(low) FILTER (base AND good) AS last_word, {labels("base AND good")} AS base_labels, {labels("good")} AS labels, max(share) AS score FROM s GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN o USING (doc_id)"""


def _media_sql() -> str:
    """Payload, header, checksums and features of the samples; the texts of these tables hold no media themselves."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    low = lambda n: "unhex(concat(" + ", ".join("printf('%02x', (" + n + f") >> {8 * k} & 255)" for k in range(4)) + "))"
    fixed = media.to_wav(b"")
    head = f"unhex('{fixed[:4].hex()}') || {low('36 + p')} || unhex('{fixed[8:40].hex()}') || {low('p')}"
    return f"""WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents), n AS (SELECT *, octet_length(data) AS n, greatest(64, (octet_length(data) + 63) // 64 * 64) AS p FROM t),
    y AS (SELECT *, data || unhex(repeat('00', CAST(p - n AS BIGINT))) AS payload FROM n),
    z AS (SELECT *, {head} || payload AS media, list_transform(range(p), lambda i: CAST('0x' || substr(hex(payload), 2 * i + 1, 2) AS INTEGER)) AS b FROM y),
    x AS (SELECT *, list_transform(b, lambda v: v - 128) AS x FROM z)
    SELECT doc_id, n AS n_bytes, p AS payload_bytes, sha256(payload) AS payload_sha256,
        xor(list_reduce(list_prepend(4294967295, list_transform(b[-64:], lambda v: CAST(v AS BIGINT))), lambda c, v: xor(c >> 8, {table}[xor(c, v) % 256 + 1])), 4294967295) AS tail_crc32,
        octet_length(media) AS media_bytes, sha256(media) AS media_sha256,
        'audio/wav;corrected=1;samples=' || p || ';peak=' || list_max(list_transform(x, lambda v: abs(v))) || ';rms=' || CAST(floor(sqrt(list_sum(list_transform(x, lambda v: v * v)) / p)) AS BIGINT)
        || ';crossings=' || len(list_filter(range(1, p), lambda i: (x[i] < 0) <> (x[i + 1] < 0))) || ';silence=' || 1000 * len(list_filter(x, lambda v: v = -128)) // p || ';embedded=0;kinds=' AS feature
    FROM x"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express on whole tables; the others are tested by brute force."""
    return {"op1_pii": _pii_sql(), "op3_media": _media_sql(), "op5_licenses": _licenses_sql(), "op6_simhash": _simhash_sql(), "op7_decontam": _DECONTAM_SQL}
