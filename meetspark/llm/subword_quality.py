"""Quality classes by supervised subword embeddings.

A document is a bag: each word, its character n-grams with its ends marked, and each pair of neighbouring words, all hashed into
buckets. The learned vectors of its bag are averaged and a softmax gives the classes. Vectors and softmax are trained together by
stochastic gradient descent in numpy on the driver, on a bounded sample of labelled texts; each step moves the vectors of one
document's bag. A pair of equal words has one feature of its own, whatever the word, so repetition is seen in words never met.

As average and softmax are linear, scoring needs one number for each bucket (``Model.line``); tasks look words up, each different
word of a block once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Block, blocks, mix, owner, word_hashes

BUCKETS = 1 << 17
DIMENSIONS = 8
SHORTEST, LONGEST = 3, 5
LONG = 64  # characters of a word; longer ones are read in pieces of this size
LOW_ROWS, HIGH_ROWS, TRAINING_CHARS = 2_000, 4_000, 8_000
EPOCHS, VECTOR_RATE, SOFT_RATE, BIAS_RATE = 3, 0.2, 0.4, 0.04
AT_ONCE = 20_000
_U = np.uint64
_REPEAT = 0  # the bucket of a pair of equal words; no other feature is hashed into it


def _bucket(h: np.ndarray) -> np.ndarray:
    return (1 + mix(h) % _U(BUCKETS - 1)).astype(np.int32)


def pieces(word: str) -> list[str]:
    return [word[i : i + LONG] for i in range(0, len(word), LONG)] or [""]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, its ends marked, and the word that each belongs to. Words hold no line ends."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    code = np.frombuffer(("<" + ">\n<".join(words) + ">\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.flatnonzero(code == 10)
    size = np.diff(stops, prepend=-1)
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    left = np.repeat(stops, size) - np.arange(len(code))  # characters of the word from each place
    value = mix(code.astype(_U) + _U(1))
    found, owners, run = [], [], value
    for n in range(2, LONGEST + 1):
        run = mix(run[:-1] * _U(31) + value[n - 1 :]) if n <= len(code) else run[:0]
        if n >= SHORTEST:
            at = np.flatnonzero(left[: len(run)] >= n)
            found.append(_bucket(run[at]))
            owners.append(word[at])
    return np.concatenate(found), np.concatenate(owners)


def _pairs(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of neighbouring words and the places of their second words."""
    at = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    a, b = hashes[at - 1], hashes[at]
    return np.where(a == b, np.int32(_REPEAT), _bucket(mix(a) * _U(31) + b)), at


def _words(b: Block, at: np.ndarray) -> list[str]:
    return [b.data[s:e].tobytes().decode() for s, e in zip(b.starts[at], b.ends[at], strict=True)]


def bags(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text its different buckets and the share of each in the bag."""
    for b in blocks(pa.array(texts, pa.string())):
        hashes, doc = word_hashes(b), owner(b.first)
        _, first, own = np.unique(hashes, return_index=True, return_inverse=True)
        parts = [pieces(w) for w in _words(b, first)]
        gram, part = grams([p for x in parts for p in x])
        word = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[part]
        heads = np.searchsorted(word, np.arange(len(parts) + 1), sorter=(order := np.argsort(word, kind="stable")))
        gram = gram[order]
        second, at = _pairs(hashes, doc)
        starts = np.searchsorted(at, b.first)
        for i in range(len(b.first) - 1):
            inside = slice(b.first[i], b.first[i + 1])
            kind, times = np.unique(own[inside], return_counts=True)
            sizes = heads[kind + 1] - heads[kind]
            each = np.repeat(heads[kind] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            bucket = np.concatenate([gram[each], _bucket(hashes[first[kind]]), second[starts[i] : starts[i + 1]]])
            weight = np.concatenate([np.repeat(times, sizes), times, np.ones(starts[i + 1] - starts[i])])
            kept, back = np.unique(bucket, return_inverse=True)
            yield kept.astype(np.int32), (np.bincount(back, weight, len(kept)) / max(1.0, weight.sum())).astype(np.float32)


@dataclass
class Model:
    line: np.ndarray  # of each bucket its vector, projected on high minus low quality
    bias: float
    most: int = 500_000
    known: tuple[np.ndarray, np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, _U), np.zeros(0), np.zeros(0)))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of each word's n-grams, some pieces at a time."""
        parts = [pieces(w) for w in words]
        word, parts = np.repeat(np.arange(len(words)), [len(p) for p in parts]), [p for x in parts for p in x]
        total, count = np.zeros(len(words)), np.zeros(len(words))
        for i in range(0, len(parts), AT_ONCE):
            gram, part = grams(parts[i : i + AT_ONCE])
            own = word[i + part] - word[i]
            size = word[min(i + AT_ONCE, len(parts)) - 1] - word[i] + 1
            total[word[i] : word[i] + size] += np.bincount(own, self.line[gram], size)
            count[word[i] : word[i] + size] += np.bincount(own, minlength=size)
        return total, count

    def block(self, b: Block) -> np.ndarray:
        """The log odds of high quality of each text of a block."""
        n, hashes, doc = len(b.first) - 1, word_hashes(b), owner(b.first)
        key, first, own = np.unique(hashes, return_index=True, return_inverse=True)
        held, sums, counts = self.known
        place = np.minimum(np.searchsorted(held, key), max(0, len(held) - 1))
        hit = held[place] == key if len(held) else np.zeros(len(key), dtype=bool)
        total, count = np.zeros(len(key)), np.zeros(len(key))
        total[hit], count[hit] = sums[place[hit]], counts[place[hit]]
        new = np.flatnonzero(~hit)
        total[new], count[new] = self.words(_words(b, first[new]))
        total[new] += self.line[_bucket(key[new])]
        count[new] += 1
        if len(held) + len(new) > self.most:
            held, sums, counts = held[:0], sums[:0], counts[:0]
        order = np.argsort(np.concatenate([held, key[new]]), kind="stable")
        self.known = tuple(np.concatenate([a, x[new]])[order] for a, x in ((held, key), (sums, total), (counts, count)))
        second, at = _pairs(hashes, doc)
        value = np.bincount(doc, total[own], n) + np.bincount(doc[at], self.line[second], n)
        size = np.bincount(doc, count[own], n) + np.bincount(doc[at], minlength=n)
        return value / np.maximum(size, 1) + self.bias

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(texts: list[str], high: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Fit vectors and softmax on texts and their classes, which weigh the same together. A bag's vectors move by their shares in it
    times its different buckets, so that long bags teach as much as short ones."""
    high = np.asarray(high)
    if not len(texts) or high.min() == high.max():
        return Model(np.zeros(BUCKETS, np.float32), 4.0 if not len(texts) or high.max() else -4.0)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (2, DIMENSIONS)), np.zeros(2)
    held = list(bags(texts))
    weight = 0.5 * len(high) / np.where(high == 1, (high == 1).sum(), (high != 1).sum())
    steps = iter(np.linspace(1, 0, epochs * len(held), endpoint=False))
    for _ in range(epochs):
        for i in rng.permutation(len(held)):
            bucket, share = held[i]
            rate = next(steps)
            mean = share @ table[bucket]
            logit = soft @ mean + bias
            p = np.exp(logit - logit.max())
            error = weight[i] * (p / p.sum() - (np.arange(2) == high[i]))
            hidden = error @ soft
            soft -= SOFT_RATE * rate * np.outer(error, mean)
            bias -= BIAS_RATE * rate * error
            table[bucket] -= np.outer(VECTOR_RATE * rate * len(bucket) * share, hidden).astype(np.float32)  # a bag's buckets differ
    return Model((table @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.rows.start, b.rows.stop - b.rows.start), pa.array(model.score(model.block(b)))], names=["doc_id", "score"])

    return run


def subword_quality(docs: DataFrame, labels: DataFrame, low_rows: int = LOW_ROWS, high_rows: int = HIGH_ROWS, training_chars: int = TRAINING_CHARS, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs(doc_id, text)``; a high score means quality 1.

    Learns from ``labels(doc_id, quality)``: of the ids whose crc32 of the id as text is not ``held_fold`` modulo ``folds``, the
    ``low_rows`` and ``high_rows`` of least hash of each class (a fixed bound on what is gathered), those of them that have a
    text of 1 to ``training_chars`` characters, one text each. Every whole text is scored, of any length.

    A null or empty text has an empty bag and the score of the bias; a row without an id is scored and not held out; repeated rows
    are scored each; of an id with several texts the least is learned from, of an id with both labels the low one counts; labels
    other than 0 and 1 are ignored; without texts of both classes all scores are on the side of the class there is, or high; a score
    of 0.5 is predicted 1; an empty table gives an empty result; extra columns are ignored.
    """
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(folds)) == held_fold
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~fold("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    low, high = (usable.filter(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((0, low_rows), (1, high_rows)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sample = texts.filter(F.length("text").between(1, training_chars)).join(F.broadcast(low.union(high)), "doc_id")  # at most low_rows + high_rows ids
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).orderBy("doc_id").toPandas()
    model = train(sample["text"].tolist(), sample["quality"].to_numpy(int))
    scored = texts.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
