"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

A word's byte symbols form a linked list.  A heap holds every adjacent pair that has a rank; the
lowest rank (the leftmost of equal ones) is popped and merged until none is left, so the count is
the number of initial symbols minus the merges.  Counts of words are kept in a bounded table, as most
recur.

Null texts count as empty (0 bytes, 0 tokens); an empty table gives an empty result; repeated rows
give repeated results; columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import prepare

#: Entries of a table of known words at most; a full table is emptied.
KNOWN = 600_000
#: Characters of a chunk that is kept, at most.
LONGEST = 64
_POSITION = 1 << 40


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(other.get(b, b)) for b in range(256)]


#: What Python takes for white space but the library does not.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


class WordVocabulary:
    """What a word-level byte-pair vocabulary file says: how text becomes words, and its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = spec["model"]
        splitter = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(splitter["pattern"]["Regex"])
        self.marks = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.marks)) + ")")

    def chunks(self, text: str) -> list[str]:
        """Runs without white space of the normalised text; special tokens stand as they are.

        No word spans white space, so what a chunk holds does not depend on its neighbours.
        """
        if "<|" in text and len(parts := self.special.split(text)) > 1:
            return [c for p in parts if p for c in ([p] if p in self.marks else self.chunks(p))]
        odd = _ODD.search(text) is not None
        if text.isascii():
            low = text.lower()
        else:
            low = unicodedata.normalize("NFC", text)
            # A whole string's last sigma is lowered in its own way; the library lowers characters.
            low = "".join(map(str.lower, low)) if "\u03a3" in low else low.lower()
        return _SPACE.split(low) if odd else low.split()

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk, which are merged each by itself."""
        return [chunk] if chunk.isalpha() or chunk in self.marks else self.pattern.findall(chunk)


class KnownTable(dict):
    """Results by chunk: made when first asked for; emptied when it holds KNOWN entries.  Chunks of more than LONGEST
    characters are made each time, so that the table is bounded in bytes too."""

    def __init__(self, vocabulary: WordVocabulary, make, join):
        super().__init__()
        self.vocabulary, self.make, self.join = vocabulary, make, join

    def __missing__(self, chunk):
        if len(self) >= KNOWN:
            self.clear()
        words = self.vocabulary.words(chunk)
        value = self.make(chunk) if len(words) == 1 and words[0] == chunk else self.join(map(self.__getitem__, words))
        if len(chunk) <= LONGEST:
            self[chunk] = value
        return value


class MergeCounter(WordVocabulary):
    """Counts what the library for a word-level byte-pair vocabulary file would emit."""

    def __init__(self, path: str):
        super().__init__(path)
        vocab, end = self.model["vocab"], self.model["end_of_word_suffix"] or ""
        self.inner = [vocab[s] for s in byte_symbols()]
        self.last = [vocab[s + end] for s in byte_symbols()]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(self.model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 20 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.model = None
        self.by_word = KnownTable(self, self.merge, sum)

    def merge(self, word: str) -> int:
        if word in self.marks:
            return 1
        data = word.encode()
        n = len(data)
        if n < 2:
            return n
        ranks, merged = self.ranks, self.merged
        symbol = [self.inner[b] for b in data]
        symbol[-1] = self.last[data[-1]]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbol[i] << 20 | symbol[i + 1])
            if rank is not None:
                heap.append(rank * _POSITION + i)
        heapify(heap)
        count = n
        while heap:
            rank, i = divmod(heappop(heap), _POSITION)
            j = after[i]
            if j >= n or symbol[i] < 0 or ranks.get(symbol[i] << 20 | symbol[j]) != rank:
                continue  # one of the two has been merged into another pair
            symbol[i], symbol[j] = merged[rank], -1
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                rank = ranks.get(symbol[i] << 20 | symbol[k])
                if rank is not None:
                    heappush(heap, rank * _POSITION + i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbol[h] << 20 | symbol[i])
                if rank is not None:
                    heappush(heap, rank * _POSITION + h)
        return count

    def count(self, text: str | None) -> int:
        return sum(map(self.by_word.__getitem__, self.chunks(text))) if text else 0


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    ``vocabulary`` is the path of a word-level byte-pair .json file, there on every executor.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            n = [own.count(t.as_py()) for t in texts]
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counts, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("doc_id", id_col)
