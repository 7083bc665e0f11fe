"""License passages by diagonal voting.

All rolling word pairs of every text are hashed and joined with the pairs of the templates.  A hit at
word ``p`` of a text and pair ``q`` of a template votes for the diagonal ``p - q``: where the template
would start.  Votes are gathered by diagonal as masks of the pairs seen, one for each 64 of them;
neighbouring diagonals of one template (a word more or less in between) are merged; a merged group is
confirmed if enough of the template's pairs are in it.  Templates may be of any length.  Everything is DataFrame functions; the table of template pairs is a constant.

Base phrases are templates of their own: each diagonal with all their pairs is a place.

Null and empty texts have no words.  Very long texts are one row a word pair, never held whole by a window.
Of several confirmed passages of one label all are listed.  Repeated rows repeat in the result; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases and their labels; every place where all the words stand counts.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Passages of public licenses, as normalised words.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
    ),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"
        " fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or"
        " other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other"
        " dealings in the software",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the"
        " documentation and or other materials provided with the distribution",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above"
        " copyright notice and this permission notice appear in all copies",
    ),
    "gpl-3.0": ("licensed under the gnu general public license version 3",),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0",),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
}
#: Diagonals of one template at most so far apart are merged.
GAP = 2
#: Share of a template's pairs that confirms it.
CONFIRM = 0.75
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _pairs(spark: SparkSession, phrases: Mapping[str, str], templates: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """A row for each pair of each template: template, label, base, pairs, q, gram."""
    rows = []
    every = [(p, label, True) for p, label in phrases.items()] + [(t, label, False) for label, ts in templates.items() for t in ts]
    for no, (text, label, base) in enumerate(every):
        words = text.split(" ")
        if len(words) < 2:
            raise ValueError(f"a template has two words or more: {text!r}")
        rows += [f"({no}, '{label}', {str(base).lower()}, {len(words) - 1}, {q}, '{a} {b}')" for q, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return spark.sql("SELECT *, xxhash64(gram) AS hash FROM VALUES " + ", ".join(rows) + " AS t(template, label, base, pairs, q, gram)")


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and passages of each row.

    Passages are the confirmed templates: label, first and last diagonal, share of pairs.
    """
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), ascii_uppercase, ascii_lowercase)
    words = F.array_remove(F.split(lowered, _SEPARATORS), "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), words.alias("w"))
    # The last word has no pair: its null gram stands for the text itself, also where there is no word.
    grams = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    each = rows.select("doc_id", "th", grams.alias("g")).select("doc_id", "th", F.posexplode_outer("g").alias("p", "g"))
    pairs = F.broadcast(_pairs(docs.sparkSession, phrases, templates))
    hits = each.join(pairs, (F.xxhash64("g") == F.col("hash")) & (F.col("g") == F.col("gram")), "left").filter("template IS NOT NULL OR g IS NULL")
    votes = hits.groupBy("doc_id", "th", "template", "label", "base", "pairs", (F.col("p") - F.col("q")).alias("diagonal"), F.expr("q div 64").alias("part")).agg(
        F.bit_or(F.expr("shiftleft(1L, q % 64)")).alias("mask"),
        F.coalesce(F.max(F.when(F.col("template").isNull(), F.col("p") + 1)), F.lit(0)).alias("n_words"),
        F.count(F.when(F.col("template").isNull(), 1)).alias("copies"),
    )
    along = Window.partitionBy("doc_id", "th", "template").orderBy("diagonal")
    # Places of base phrases must not grow together; the others' neighbours do.
    near = F.col("diagonal") - F.lag("diagonal").over(along) <= F.when(F.col("base"), 0).otherwise(GAP)
    groups = votes.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("band", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    band = ["doc_id", "th", "template", "label", "base", "pairs", "band"]
    masks = groups.groupBy(*band, "part").agg(
        F.bit_or("mask").alias("mask"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.max("n_words").alias("n_words"), F.max("copies").alias("copies")
    )
    merged = masks.groupBy(*band).agg(
        F.sum(F.bit_count("mask")).alias("seen"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("n_words").alias("n_words"), F.max("copies").alias("copies")
    )
    share = F.coalesce(F.col("seen") / F.col("pairs"), F.lit(0.0))
    scored = merged.withColumn("share", share).withColumn("good", F.when(F.col("base"), F.col("share") == 1.0).otherwise(F.col("share") >= CONFIRM))
    place = F.col("base") & F.col("good")
    out = scored.groupBy("doc_id", "th").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("low"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("good"), F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_set(F.when(F.col("good") & ~F.col("base"), F.struct("label", "low", "high", "share")))).alias("passages"),
        F.max("copies").cast("int").alias("copies"),
    )
    many = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return out.select("*", many.alias("_i")).select(
        F.col("doc_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "passages"
    )
