"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The automaton of all items' words is built once on the driver, its size is checked, and documents'
words stream through it, tracking the longest suffix that occurs in an item.  Where that reaches a
window (``window`` consecutive words of an item, or the whole of a shorter item), the words of the
window are hit.  Runs of words that no item holds are skipped without touching the automaton.

Null texts have no words; items without words match nothing; several equal items all count, each by
its own id; repeated documents give repeated rows; an empty table on either side gives empty results
or no hits.  Other columns pass through untouched, or are not read where only a digest is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import prepare, unused

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
COVERAGE = 20
#: Words of items in one automaton at most; more items are spread over several, used one after another.
AUTOMATON_WORDS = 100_000

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes(0x20 if b in _SEPARATORS else b for b in range(256))


def words_of(text: bytes | str | None) -> list[bytes]:
    """Words of 0-9, a-z and characters beyond ASCII; only A-Z are lower-cased."""
    if not text:
        return []
    data = text.encode() if isinstance(text, str) else text
    return data.lower().translate(_TO_SPACE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items in which each state occurs."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        own: dict[int, set] = {}
        whole: dict[int, set] = {}
        self.shortest = window
        for item, words in items:
            if not words:
                continue
            at = 0
            for w in words:
                at = self._extend(at, self.vocabulary.setdefault(w, len(self.vocabulary)))
            at = 0
            for w in words:  # every prefix is in one state; clones are passed through their links
                at = self.next[at][self.vocabulary[w]]
                own.setdefault(at, set()).add(item)
            if len(words) < window:
                self.shortest = min(self.shortest, len(words))
                whole.setdefault(at, set()).add((item, len(words)))
        order = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        for s in order:  # a state's strings end wherever those of the states that link to it end
            if s in own and self.link[s] > 0:
                own.setdefault(self.link[s], set()).update(own[s])
        self.items = {s: tuple(own[s]) for s in own if self.length[s] >= window and self.length[self.link[s]] < window}
        # Short items that end where a state's strings end, by going up the links.
        self.short: dict[int, tuple] = {}
        for s in reversed(order):
            found = (*whole.get(s, ()), *self.short.get(self.link[s], ()))
            if found:
                self.short[s] = found

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [start, end) ranges of hit words, and the items with an occurring window."""
        get, known = self.vocabulary.get, len(self.vocabulary)
        numbers = np.fromiter(map(get, words, [known] * len(words)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(numbers < known, prepend=False, append=False))
        found: list[list[int]] = []
        items: set = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            state = matched = 0
            for i, c in enumerate(numbers[a:b].tolist(), a):
                while state and c not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    matched += 1
                size = 0
                if matched >= window:
                    size, s = window, state
                    while length[link[s]] >= window:
                        s = link[s]
                    state, matched = s, min(matched, length[s])
                    items.update(self.items[s])
                for item, n in self.short.get(state, ()):
                    if n <= matched:
                        items.add(item)
                        size = max(size, n)
                if size:
                    if found and found[-1][1] >= i + 1 - size:
                        found[-1][0] = min(found[-1][0], i + 1 - size)
                        found[-1][1] = i + 1
                        while len(found) > 1 and found[-2][1] >= found[-1][0]:
                            end = found.pop()[1]
                            found[-1][1] = end
                    else:
                        found.append([i + 1 - size, i + 1])
        return [(a, b) for a, b in found], items


def item_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most_words: int = AUTOMATON_WORDS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their words, in parts of at most ``most_words`` words (or of one longer item); one is held at a time."""
    part: list = []
    held = 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        words = words_of(row[1])
        if held and held + len(words) > most_words:
            yield part
            part, held = [], 0
        part.append((row[0], words))
        held += len(words)
    yield part


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str) -> tuple[DataFrame, str, str, str]:
    """``docs`` with three more columns, and their names: number of words, spans (of words), items."""
    spark = prepare(docs.sparkSession)
    own_names = unused(docs, "_n_words", "_spans", "_items")
    n_col, spans_col, items_col = own_names
    df = docs.withColumns({n_col: F.lit(0).cast("long"), spans_col: F.array().cast("array<struct<start:int,end:int>>"), items_col: F.array().cast("array<string>")})
    names = df.columns
    at = {"text": names.index(text_col), "_n_words": names.index(n_col), "_spans": names.index(spans_col), "_items": names.index(items_col)}
    schema = df.schema
    for part in item_parts(benchmark):
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton(sent.value, window)
            for batch in batches:
                n, spans, items = [], [], []
                for text, old, held in zip(batch.column(at["text"]), batch.column(at["_spans"]).to_pylist(), batch.column(at["_items"]).to_pylist(), strict=True):
                    words = words_of(text.as_py())
                    found, which = automaton.spans(words)
                    if old and found:
                        found = _merged([(x["start"], x["end"]) for x in old] + found)
                    elif old:
                        found = [(x["start"], x["end"]) for x in old]
                    n.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in found])
                    items.append(sorted({*held, *map(str, which)}) if which else held)
                columns = list(batch.columns)
                columns[at["_n_words"]] = pa.array(n, pa.int64())
                columns[at["_spans"]] = pa.array(spans, batch.schema.field(at["_spans"]).type)
                columns[at["_items"]] = pa.array(items, batch.schema.field(at["_items"]).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        df = df.mapInArrow(run, schema)
    return df, n_col, spans_col, items_col


def _n_hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_hit, n_items, items_sha256, contaminated, spans (of words) of each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found, words, spans, items = _hits(rows, benchmark, window, "text")
    n_hit = _n_hit(spans)
    return found.select(
        F.col("doc_id").alias(id_col),
        F.col(words).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * coverage >= F.col(words))).alias("contaminated"),
        F.col(spans).alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    found, words, spans, _ = _hits(docs, benchmark, window, text_col)
    n_hit = _n_hit(spans)
    return found.filter(~((n_hit > 0) & (n_hit * coverage >= F.col(words)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_spans(text: str | None, spans: list, longest: int = 0) -> str | None:
    """``text`` without the words of the spans of more than ``longest`` words."""
    if not text or not spans:
        return text
    data = text.encode()
    flat = data.lower().translate(_TO_SPACE)
    bounds, at = [], 0
    for w in flat.split():
        a = flat.index(w, at)
        at = a + len(w)
        bounds.append((a, at))
    out, kept = [], 0
    for s in spans:
        if s[1] - s[0] > longest:
            out.append(data[kept : bounds[s[0]][0]])
            kept = bounds[s[1] - 1][1]
    return (b"".join(out) + data[kept:]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, longest: int = 0, text_col: str = "text") -> DataFrame:
    """``docs`` without hit spans of more than ``longest`` words; contaminated documents lose all their hit spans."""
    found, words, spans_col, _ = _hits(docs, benchmark, window, text_col)
    n_hit = _n_hit(spans_col)
    over = (n_hit > 0) & (n_hit * coverage >= F.col(words))

    @F.pandas_udf("string")
    def cleaned(text, spans, all_of):  # noqa: ANN001
        import pandas as pd

        return pd.Series([cut_spans(t, [(x["start"], x["end"]) for x in s], 0 if a else longest) for t, s, a in zip(text, spans, all_of, strict=True)])

    keep = [F.col(f"`{c}`") if c != text_col else cleaned(F.col(text_col), spans_col, over).alias(text_col) for c in docs.columns]
    return found.select(*keep)
