"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is a bag of its hashed character n-grams and of itself; a span of ``SPAN`` consecutive words is the average of the
embeddings of all its words' bags, and a two-way linear softmax scores that average. Embeddings and softmax are trained jointly
in numpy on the driver, on a bounded sample of labelled rows. Labels are given for documents, so of a toxic training document
only the spans that score highest count as toxic, chosen anew in each step; a document's score is that of its worst span, calibrated
on the sample. Misspellings that were never seen share most of their n-grams with words that were.

``SPAN`` was chosen within the training rows alone, learning from some and scoring others: 1 (an insult stands alone, a word's
bag is all that is averaged) found all toxic texts, averages over more words hid many of them. README has the figures.

A run of more than ``LONG`` characters without white space (a script without spaces, joined words, a URL) stands for several
words: its parts between marks, and of what is still long overlapping stretches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Block, blocks, mix, word_hashes

BUCKETS = 1 << 16
DIMENSIONS = 8
SPAN = 1
SHORTEST, LONGEST = 3, 5
TOXIC_ROWS, HARMLESS_ROWS, TRAINING_CHARS = 600, 3_000, 4_000
LONG, STRETCH = 64, 16
_U = np.uint64
_EDGES = re.compile(r"^(?:[^\w\n]|_)+|(?:[^\w\n]|_)+$", re.M)


@cache
def _parts() -> re.Pattern:
    """Runs of letters, digits and the combining marks that many scripts write vowels with."""
    marks = "".join(re.escape(chr(c)) for c in range(0x300, 0x1F000) if unicodedata.category(chr(c))[0] == "M")
    return re.compile(rf"(?:[^\W_]|[{marks}])+")


def stretches(word: str) -> Iterator[str]:
    """The words of a run of text without white space: itself up to ``LONG`` characters; else its parts between marks, and
    of a part above ``LONG`` stretches that overlap by half, so that every character is in one of them."""
    if len(word) <= LONG:
        yield word
        return
    found = 0
    for m in _parts().finditer(word):
        part, found = m[0], found + 1
        if len(part) <= LONG:
            yield part
        else:
            for i in range(0, len(part) - STRETCH // 2, STRETCH // 2):
                yield part[i : i + STRETCH]
    if not found:
        yield ""


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, lower-cased, without the marks around it and with its ends marked, and of the
    word itself; and the word that each bucket belongs to."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    text = "<" + _EDGES.sub("", "\n".join(words).lower()).replace("\n", ">\n<") + ">\n"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.flatnonzero(code == 10)
    word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(stops, prepend=-1))
    left = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(len(code))  # characters of the word from each place
    begins = np.append(0, stops[:-1] + 1)
    value = mix(code.astype(_U) + _U(1))
    buckets, owner, run = [], [], value
    for n in range(2, LONGEST + 1):
        run = mix(run[:-1] * _U(31) + value[n - 1 :]) if n <= len(code) else run[:0]
        if n >= SHORTEST:
            at = np.flatnonzero(left[: len(run)] >= n)
            buckets.append(run[at] % _U(BUCKETS))
            owner.append(word[at])
    place = np.arange(len(code)) - np.repeat(begins, np.diff(stops, prepend=-1))
    buckets.append(mix(np.add.reduceat(mix(value * _U(31) + place.astype(_U)), begins)) % _U(BUCKETS))
    owner.append(np.arange(len(words), dtype=np.int32))
    return np.concatenate(buckets).astype(np.int32), np.concatenate(owner)


def _all_subwords(words: list[str], at_once: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """``subwords`` of many words, some at a time."""
    bucket, own = zip(*(subwords(words[i : i + at_once]) for i in range(0, len(words), at_once)), strict=True)
    return np.concatenate(bucket), np.concatenate([x + np.int32(i * at_once) for i, x in enumerate(own)])


def words_of(block: Block, i: int) -> list[str]:
    """The words of a block's text, long runs taken apart."""
    found = (block.data[s:e].tobytes().decode() for s, e in zip(block.starts[block.first[i] : block.first[i + 1]], block.ends[block.first[i] : block.first[i + 1]], strict=True))
    return [part for w in found for part in stretches(w)]


def span_means(values: np.ndarray, first: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The largest mean of ``span`` consecutive values of each stretch ``[first[i], first[i + 1])``, of all where there are fewer;
    -inf for none."""
    n = np.diff(first)
    out = np.full(len(n), -np.inf)
    few = np.flatnonzero((n > 0) & (n <= span))
    if len(few):
        out[few] = sum(np.where(j < n[few], values[np.minimum(first[few] + j, len(values) - 1)], 0.0) for j in range(span)) / n[few]
    many = np.flatnonzero(n > span)
    if len(many):
        count = n[many] - span + 1
        heads = np.cumsum(count) - count
        at = np.repeat(first[many] - heads, count) + np.arange(count.sum())
        out[many] = np.maximum.reduceat(sum(values[at + j] for j in range(span)) / span, heads)
    return out


@dataclass
class Model:
    buckets: np.ndarray  # of each n-gram bucket its embedding, projected on toxic minus harmless
    bias: float
    slope: float
    offset: float
    span: int = SPAN
    most: int = 500_000
    known: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, _U), np.zeros(0)))

    def words(self, words: list[str], at_once: int = 50_000) -> np.ndarray:
        """The mean of each word's buckets."""
        out = np.zeros(len(words))
        for i in range(0, len(words), at_once):
            bucket, own = subwords(words[i : i + at_once])
            size = min(at_once, len(words) - i)
            out[i : i + size] = np.bincount(own, self.buckets[bucket], size) / np.bincount(own, minlength=size)
        return out

    def block(self, b: Block) -> np.ndarray:
        """The worst span of each text of a block; a text without words has the lowest."""
        key, first, own = np.unique(word_hashes(b), return_index=True, return_inverse=True)
        held, score = self.known
        place = np.minimum(np.searchsorted(held, key), max(0, len(held) - 1))
        hit = held[place] == key if len(held) else np.zeros(len(key), dtype=bool)
        value = np.zeros(len(key))
        value[hit] = score[place[hit]]
        new = np.flatnonzero(~hit & (b.ends[first] - b.starts[first] <= LONG))
        value[new] = self.words([b.data[s:e].tobytes().decode() for s, e in zip(b.starts[first[new]], b.ends[first[new]], strict=True)])
        if len(held) + len(new) > self.most:
            held, score = held[:0], score[:0]
        order = np.argsort(np.concatenate([held, key[new]]), kind="stable")
        self.known = np.concatenate([held, key[new]])[order], np.concatenate([score, value[new]])[order]
        values, heads = value[own], b.first
        long = np.flatnonzero(b.ends - b.starts > LONG)
        if len(long):  # bytes; in characters a run may still be one word
            parts = [self.words(list(stretches(b.data[s:e].tobytes().decode()))) for s, e in zip(b.starts[long], b.ends[long], strict=True)]
            size = np.ones(len(values), np.int64)
            size[long] = [len(p) for p in parts]
            heads = np.concatenate([[0], np.cumsum(size)])
            values = np.repeat(values, size)
            for i, p in zip(long, parts, strict=True):
                values[heads[i] : heads[i] + len(p)] = p
            heads = heads[b.first]
        return span_means(values, heads, self.span)

    def score(self, worst: np.ndarray) -> np.ndarray:
        logit = self.slope * (np.maximum(worst, -30.0) + self.bias) + self.offset
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _adam(state: dict, name: str, value: np.ndarray, grad: np.ndarray, step: int, rate: float) -> None:
    m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
    m += 0.1 * (grad - m)
    v += 0.01 * (grad * grad - v)
    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def _spread(index: np.ndarray, rows: np.ndarray, take: np.ndarray | None, size: int, at_once: int = 1 << 20) -> np.ndarray:
    """Sums of ``rows[:, take]`` by ``index``, some values of one dimension at a time so that what is taken is never held whole."""
    out = np.zeros((len(rows), size))
    for i in range(0, len(index), at_once):
        part = slice(i, i + at_once)
        own, taken = index[part].astype(np.int64), part if take is None else take[part]
        for total, row in zip(out, rows, strict=True):
            total += np.bincount(own, row[taken], size)
    return out


def _spans(docs: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all different spans of documents, half overlapping, padded with -1, and their documents."""
    step, out = max(1, span // 2), []
    for d in docs:
        at = np.unique(np.append(np.arange(0, max(1, len(d) - span + 1), step), max(0, len(d) - span)))
        padded = np.pad(d, (0, max(0, span - len(d))), constant_values=-1)
        out.append(np.unique(padded[at[:, None] + np.arange(span)], axis=0))
    return np.concatenate(out), np.repeat(np.arange(len(docs)), [len(x) for x in out])


def train(texts: list[str], toxic: np.ndarray, prevalence: float = 0.5, span: int = SPAN, steps: int = 40, rate: float = 0.05, seed: int = 7) -> Model:
    """Fit embeddings and softmax together on documents and their labels."""
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(b, i)], dtype=np.int32) for b in blocks(pa.array(texts, pa.string())) for i in range(len(b.first) - 1)]
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, toxic = [docs[i] for i in keep], np.asarray(toxic)[keep]
    if not docs or toxic.min() == toxic.max():
        return Model(np.zeros(BUCKETS), 0.0, 0.0, -4.0 if not len(toxic) or not toxic.max() else 4.0, span)
    bucket, word = _all_subwords(list(vocabulary))
    n, per_word = len(vocabulary), 1.0 / np.bincount(word)
    spans, owner = _spans(docs, span)
    real = spans >= 0
    per_span = 1.0 / real.sum(axis=1)
    filled = np.where(real, spans, n)  # a word of no weight
    first = np.searchsorted(owner, np.arange(len(docs)))
    label = toxic[owner] == 1
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (DIMENSIONS, BUCKETS))
    soft, bias, state = rng.normal(0, 0.1, (2, DIMENSIONS)), np.zeros(2), {}
    share = 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (~label).sum())
    for step in range(1, steps + 1):
        words = np.concatenate([_spread(word, table, bucket, n) * per_word, np.zeros((DIMENSIONS, 1))], axis=1)
        mean = sum(words[:, filled[:, j]] for j in range(span)) * per_span
        logits = np.einsum("cd,dn->cn", soft, mean) + bias[:, None]
        p = 1 / (1 + np.exp(np.clip(logits[0] - logits[1], -30, 30)))
        # of a toxic document the worst spans share one unit of weight; first all do
        top = np.maximum.reduceat(p, first)[owner]
        chosen = label & ((p >= 0.9 * top) if step > 10 else np.ones(len(p), dtype=bool))
        count = np.bincount(owner[chosen], minlength=len(docs))
        error = np.where(chosen, share[0] / np.maximum(count[owner], 1), np.where(label, 0.0, share[1])) * (p - chosen)
        both = np.stack([-error, error])
        by_span = np.einsum("cd,cn->dn", soft, both) * per_span
        by_word = sum(_spread(filled[:, j], by_span, None, n + 1) for j in range(span))[:, :n] * per_word
        _adam(state, "soft", soft, np.einsum("cn,dn->cd", both, mean) + 1e-4 * soft, step, rate)
        _adam(state, "bias", bias, both.sum(axis=1), step, rate)
        _adam(state, "table", table, _spread(bucket, by_word, word, BUCKETS), step, rate)
    line, edge = (soft[1] - soft[0]) @ table, float(bias[1] - bias[0])
    flat = np.bincount(word, line[bucket], n) * per_word
    worst = span_means(flat[np.concatenate(docs)], np.append(0, np.cumsum([len(d) for d in docs])), span) + edge
    return Model(line, edge, *_calibrate(worst, toxic == 1, prevalence), span)


def _calibrate(x: np.ndarray, y: np.ndarray, prevalence: float) -> tuple[float, float]:
    """Logistic fit of the labels on the worst span; toxic rows weigh ``prevalence`` together."""
    scale, centre = x.std() + 1e-9, x.mean()
    z, w = (x - centre) / scale, np.where(y, prevalence / y.sum(), (1 - prevalence) / (~y).sum())
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        e, h = w * (p - y), w * p * (1 - p) + 1e-9
        grad = np.array([(e * z).sum() + 1e-3 * a, e.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
    return float(a / scale), float(b - a * centre / scale)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.rows.start, b.rows.stop - b.rows.start), pa.array(model.score(model.block(b)))], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, harmless_rows: int = HARMLESS_ROWS, training_chars: int = TRAINING_CHARS, span: int = SPAN, held_out_of: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs(doc_id, text)``.

    Learns from ``labels(doc_id, toxic)``: of the ids whose crc32 of the id as text is not divisible by ``held_out_of`` and that
    have a text of at most ``training_chars`` characters, the ``toxic_rows`` and ``harmless_rows`` of least hash, one text
    each (a fixed bound on what is gathered). The share of toxic rows among the labels of all training ids sets the calibration.
    Every whole text is scored, of any length.

    A null or empty text gets the lowest score; a row without an id is scored and not held out; repeated rows are scored
    each; of an id with several texts the least is learned from, of an id with both labels the toxic one counts; without labels of
    both classes all scores are on the side of the class there is, or low; an empty table gives an empty result; extra columns are
    ignored.
    """
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(held_out_of)) == 0
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~fold("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prevalence = usable.agg(F.avg("toxic")).first()[0] or 0.0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    fit = texts.filter(F.length("text").between(1, training_chars)).select("doc_id", "text")
    fit = fit.select("doc_id").distinct().join(usable, "doc_id")
    picked = [fit.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((0, harmless_rows), (1, toxic_rows))]
    sample = texts.filter(F.length("text").between(1, training_chars)).join(F.broadcast(picked[0].union(picked[1])), "doc_id")  # at most the rows of the bound
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).orderBy("doc_id").toPandas()
    model = train(sample["text"].tolist(), sample["toxic"].to_numpy(int), prevalence, span)
    scored = texts.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
