"""Language identification: averaged hashed subword embeddings with a linear softmax.

Each word adds its byte n-grams and itself, hashed to buckets; a text is the mean of its buckets'
embeddings, and a linear softmax over it gives the language.  Embeddings and softmax are trained
together by stochastic gradient descent in numpy on a bounded sample of labelled rows, beside a class
of its own for made-up texts of no language (shuffled letters, random words, random scripts, digits and
letters).  Temperature and rejection threshold are then fitted on rows that were kept back and on made-up
texts in scripts that were not trained on; the threshold lies between the two kinds' scores.

Null texts and texts without a letter are ``und`` with score 0 and rejected.  Without any labelled
row every text is ``und``.  Texts of any length are judged whole, in memory bounded by the text.  Of equally
likely languages the first by name is taken.  Repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import prepare, release, unused

#: Rows of the training sample, on average, and characters of one of them at most.
TRAIN_ROWS = 4000
TRAIN_CHARS = 20_000
BUCKETS = 1 << 15
WIDTH = 16
EPOCHS = 6
RATE = 0.5
#: Share of rows kept back from training that rejection may cost, at most; share of made-up texts that it should reject.
REJECTED = 0.0005
CAUGHT = 0.99
#: Made-up texts for each labelled one, and words of one at most.
MADE_UP = 0.3
MADE_UP_WORDS = 200
#: First code point and number of letters of scripts that made-up texts are written in; the first half in training, all in calibration.
SCRIPTS = ((0x430, 32), (0x5D0, 27), (0x905, 50), (0xAC00, 2000), (0x4E00, 3000), (0x3B1, 25), (0x621, 40), (0xE01, 46), (0x3041, 80), (0x10D0, 33))
_KNOWN = 200_000
#: Words of more bytes, as unspaced scripts have, are not held in memory; bytes of them whose buckets are made at once.
LONG = 64
PART = 4096

_DROPPED = bytes([*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes(0x20 if b in _DROPPED else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_TO_SPACE).split()


def bucket_parts(word: bytes) -> Iterator[array]:
    """Buckets of the word with its ends marked: 2 to 4 bytes each, and the whole; of a long run, part by part."""
    word = b"<" + word + b">"
    n = len(word)
    crc = zlib.crc32
    for a in range(0, n, PART):
        out = array("H", [crc(word[i : i + k]) & (BUCKETS - 1) for k in (2, 3, 4) for i in range(a, min(a + PART, n - k + 1))])
        if a + PART >= n:
            out.append(crc(word, 7) & (BUCKETS - 1))
        yield out


def buckets_of(word: bytes) -> array:
    """All of a word's buckets."""
    out = array("H")
    for part in bucket_parts(word):
        out.extend(part)
    return out


def _key(word: bytes) -> bytes:
    """The word, or a digest of a long one (with a blank, which no word has)."""
    return word if len(word) <= LONG else b" " + hashlib.blake2b(word, digest_size=16).digest()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    #: A column for each language, and one more for no language.  Each bucket's embedding times the softmax weights: as the mean is linear, nothing else is needed.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def _sums(self, words: list[bytes]) -> np.ndarray:
        """For each word the sums of its buckets' logits, and how many there are."""
        known, k = self.known, len(self.bias)
        keys = words if max(map(len, words), default=0) <= LONG else list(map(_key, words))
        whole = dict(zip(keys, words, strict=True))
        missing = [w for w in whole if w not in known]
        if len(known) + len(missing) > _KNOWN:
            known.clear()
            missing = list(whole)
            self.table = np.zeros((0, k + 1), np.float32)
        # Long ones, whose keys start with a blank, last.
        missing.sort(key=lambda w: w[0] == 0x20)
        if missing or not hasattr(self, "table"):
            if not hasattr(self, "table"):
                self.table = np.zeros((0, k + 1), np.float32)
            each = [buckets_of(w) for w in missing if w[0] != 0x20]
            new = np.zeros((len(missing), k + 1), np.float32)
            if each:
                sizes = np.fromiter(map(len, each), np.int64, len(each))
                flat = np.frombuffer(b"".join(each), np.uint16)
                new[: len(each), :k] = np.add.reduceat(self.logits[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
                new[: len(each), k] = sizes
            for i in range(len(each), len(missing)):
                total = np.zeros(k + 1)
                for part in bucket_parts(whole[missing[i]]):
                    total[:k] += self.logits[np.frombuffer(part, np.uint16)].sum(axis=0, dtype=np.float64)
                    total[k] += len(part)
                new[i] = total
            known.update(zip(missing, range(len(self.table), len(self.table) + len(missing)), strict=True))
            self.table = np.concatenate([self.table, new])
        return self.table[np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))]

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the probability of each language (the rest is that of none), and whether it has words at all."""
        k = len(self.bias)
        sums = np.zeros((len(texts), k + 1))
        split = [words_of(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        full = np.flatnonzero(sizes)
        if len(full):
            each = self._sums(list(chain.from_iterable(split)))
            sums[full] = np.add.reduceat(each, np.r_[0, np.cumsum(sizes[full])[:-1]], axis=0, dtype=np.float64)
        some = sums[:, k] > 0
        z = (sums[:, :k] / np.maximum(sums[:, k:], 1) + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return (z / z.sum(axis=1, keepdims=True))[:, : len(self.langs)], some


def made_up(text: str, rng: np.random.Generator, scripts: tuple) -> str:
    """A text of no language, about as long as ``text``: one of four kinds."""
    words = [w.decode("utf-8", "ignore") for w in words_of(text)[:MADE_UP_WORDS]]
    words = [w[:LONG] for w in words if w] or ["none"]
    words += words * (2 // len(words))  # of one or two words, too little can be told
    sizes = [len(w) for w in words]
    kind = rng.choice(4, p=(0.3, 0.3, 0.3, 0.1))
    if kind == 0:  # the letters of all words, dealt anew
        letters = rng.permutation(list("".join(words)))
    elif kind == 1:
        letters = [chr(0x61 + i) for i in rng.integers(0, 26, sum(sizes))]
    elif kind == 2:
        first, n = scripts[rng.integers(0, len(scripts))]
        letters = [chr(first + i) for i in rng.integers(0, n, sum(sizes))]
    else:  # as in digests and keys; digits end words
        letters = ["0123456789abcdef"[i] for i in rng.integers(0, 16, 4 * sum(sizes))]
        sizes = [4 * n for n in sizes]
    ends = np.cumsum(sizes)
    return " ".join("".join(letters[e - n : e]) for n, e in zip(sizes, ends, strict=True))


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Model:
    """Train on nine tenths of the rows and on made-up texts; calibrate on the others and on further made-up ones."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    label = {x: i for i, x in enumerate(names)}
    cached: dict[bytes, array] = {}

    def described(text: str, y: int) -> Iterator[tuple]:
        """The text's buckets, their shares, and its label; nothing of a text without words."""
        flat = array("H")
        for w in words_of(text):
            if len(w) > LONG:
                flat.extend(buckets_of(w))
                continue
            if w not in cached:
                cached[w] = buckets_of(w)
            flat.extend(cached[w])
        if flat:
            ids, counts = np.unique(np.frombuffer(flat, np.uint16), return_counts=True)
            yield ids, (counts / counts.sum()).astype(np.float32), y

    k = len(names) + 1
    rows = [r for text, lang in zip(texts, langs, strict=True) for r in described(text, label[lang])]
    order = rng.permutation(len(rows))
    kept = max(1, len(rows) // 10) if len(rows) >= 20 else 0
    held = [rows[i] for i in order[:kept]]
    rows = [rows[i] for i in order[kept:]]
    models = rng.integers(0, len(texts), int(MADE_UP * len(texts))) if kept else ()
    rows += [r for i in models for r in described(made_up(texts[i], rng, SCRIPTS[: len(SCRIPTS) // 2]), k - 1)]
    held += [r for i in models[: max(20, kept)] for r in described(made_up(texts[i], rng, SCRIPTS), k - 1)]
    cached.clear()
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight = rng.normal(0, 0.1, (WIDTH, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    steps, done = EPOCHS * max(1, len(rows)), 0
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            ids, share, y = rows[r]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ embed[ids]
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weight @ p
            weight -= rate * np.outer(mean, p)
            bias -= rate * p
            # Shares are small, so embeddings take a larger step: one over the largest share.
            embed[ids] -= (rate / share.max()) * 0.2 * np.outer(share, back)
    model = Model(names, (embed @ weight).astype(np.float32), bias)
    if kept:
        z = np.stack([share @ model.logits[ids] + bias for ids, share, _ in held])
        y = np.array([r[2] for r in held])
        # As if one row more of each other class were seen: no temperature is then too small to be the best.
        target = np.full((len(y), k), 1 / (len(y) + k))
        target[np.arange(len(y)), y] += len(y) / (len(y) + k)

        def softmax(t: float) -> np.ndarray:
            e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        grid = np.geomspace(0.01, 100, 161)
        model.temperature = float(min(grid, key=lambda t: -(target * np.log(softmax(t) + 1e-30)).sum(axis=1).mean()))
        best = softmax(model.temperature)[:, : k - 1].max(axis=1)
        good, bad = np.sort(best[y < k - 1]), np.sort(best[y == k - 1])
        least = good[int(REJECTED * len(good))]
        most = bad[int(CAUGHT * (len(bad) - 1))] if len(bad) else 0.0
        model.threshold = float((least + min(least, most)) / 2)
    return model


def train(docs: DataFrame, used: Column, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of about ``rows`` of the rows where ``used`` holds, picked by a hash of the id.

    Longer texts than ``chars`` are used only for languages of which no shorter one was picked: a piece of each.
    """
    labelled = docs.filter(used & F.col(lang_col).isNotNull())
    n = labelled.count()
    if not n:
        return None
    below = int(min(1.0, rows / n) * (1 << 32))
    picked = labelled.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 32)) < below)
    over = F.greatest(F.length(text_col) - chars, F.lit(0))
    piece = F.substring(F.col(text_col), F.pmod(F.xxhash64(id_col), over + 1).cast("int") + 1, F.lit(chars))
    sample = picked.filter(F.col(text_col).isNotNull()).select(F.col(id_col), piece.alias("piece"), F.col(lang_col).alias("lang"), (over > 0).alias("cut"))
    # Where ids repeat, more may be picked.
    sample = sample.orderBy(F.xxhash64(id_col), "lang", "cut", F.xxhash64("piece")).limit(2 * rows).collect()
    sample = [r for r in sample if has_letter(r[1])]
    whole = {r[2] for r in sample if not r[3]}
    sample = sorted((r for r in sample if not r[3] or r[2] not in whole), key=lambda r: (str(r[0]), r[1], r[2]))
    if not sample:
        return None
    model = fit([r[1] for r in sample], [r[2] for r in sample])
    del sample
    release(docs.sparkSession)
    return model


def recognised(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents whose language is not rejected, with their own columns, whatever their names."""
    names = unused(docs, *OWN)
    return identify(docs, model, text_col, names=names).filter(~F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


OWN = ("lang_pred", "lang_score", "lang_rejected")


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, names: Sequence[str] = OWN) -> DataFrame:
    """The columns ``keep`` (all by default), then the language, its score and whether it is rejected; the ``names``
    of these replace columns of the same names."""
    spark = prepare(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    (text,) = unused(docs, "_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(text))
    sent = spark.sparkContext.broadcast(model)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = batch.column(n).to_pylist()
            if own is None:
                pred, score, no = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            else:
                p, some = own.scores(texts)
                best = p.argmax(axis=1)
                letters = [has_letter(t) for t in texts]
                pred = [own.langs[b] if a else "und" for a, b in zip(letters, best, strict=True)]
                score = [float(x) if a else 0.0 for a, x in zip(letters, p.max(axis=1), strict=True)]
                no = [not a or not s or x < own.threshold for a, s, x in zip(letters, some, score, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_())],
                [*batch.schema.names[:n], *names],
            )

    schema = rows.drop(text).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    return rows.mapInArrow(run, schema)
