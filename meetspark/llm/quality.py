"""Quality rules and a hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Two multinomials over hashed character n-grams are counted: one over every document of the corpus, one over a bounded
sample of trusted documents. A document's score is the mean log ratio of its n-grams, so it does not depend on its length;
documents below ``threshold`` are not kept. Counting emits one row for each bucket and partition, never one for each n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BLOCK_BYTES, Block, RangeHash, blocks, owner, separators, word_hashes

BUCKET_BITS = 16
GRAM_BYTES = 4
TRUSTED_ROWS = 20_000
THRESHOLD = -0.3
_UNIT = 1 << 20  # log ratios are added up as whole numbers, so a score does not depend on the texts read together
_SYMBOLS = ~separators(*((ord(c), ord(c)) for c in "#*$%&|<>"))


def buckets(data: np.ndarray, bits: int = BUCKET_BITS, n: int = GRAM_BYTES) -> np.ndarray:
    """Bucket of the n bytes from each place."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.int64)
    code = np.zeros(size, dtype=np.uint32)
    for i in range(n):
        code = (code << np.uint32(8)) | data[i : i + size]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in batches:
            trusted = np.asarray(batch.column("trusted").fill_null(False).to_numpy(zero_copy_only=False)).astype(bool)
            for b in blocks(batch.column("text")):
                found = buckets(b.data, bits)
                # n-grams that reach into the next text belong to neither
                inside = np.ones(len(found), dtype=bool)
                for i in range(1, GRAM_BYTES):
                    at = b.offsets[1:-1] - i
                    inside[at[(at >= 0) & (at < len(found))]] = False
                counts[0] += np.bincount(found[inside], minlength=1 << bits)
                if trusted[b.rows].any():
                    own = np.repeat(trusted[b.rows], np.diff(b.offsets))[: len(found)]
                    counts[1] += np.bincount(found[inside & own], minlength=1 << bits)
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "raw", "trusted"])

    return run


def log_ratios(docs: DataFrame, bits: int = BUCKET_BITS) -> np.ndarray:
    """Log of trusted to raw probability of each bucket. ``docs(text, trusted)``; zeros if there is no trusted text."""
    rows = docs.select("text", "trusted").mapInArrow(_count(bits), "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    counts = np.zeros((2, 1 << bits))
    counts[:, rows["bucket"].to_numpy(np.int64)] = rows[["raw", "trusted"]].to_numpy(float).T
    if not counts[1].any():
        return np.zeros(1 << bits)
    base = (counts[0] + 1) / (counts[0] + 1).sum()
    prior = 0.001 * counts[1].sum() + 1
    return np.log((counts[1] + prior * base) / (counts[1].sum() + prior)) - np.log(base)


def _repeats(b: Block) -> np.ndarray:
    """For each text the words in a 3-word window that occurs twice or more in it."""
    n = len(b.starts)
    doc = owner(b.first)
    if n < 3:
        return np.zeros(len(b.first) - 1, dtype=np.int64)
    hashes = word_hashes(b)
    one = RangeHash(hashes)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    key = one.of(at, at + 3) ^ (doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[times[back] > 1]
    cover = np.zeros(n + 1, dtype=bool)
    for i in range(3):
        cover[hit + i] = True
    return np.bincount(doc[cover[:n]], minlength=len(b.first) - 1)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def _rules(ratio: np.ndarray, bits: int):
    whole = np.rint(ratio * _UNIT).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text"), block_bytes=BLOCK_BYTES // 2):
                word = np.zeros(len(b.data) + 1, dtype=np.int8)
                np.add.at(word, b.starts, 1)
                np.add.at(word, b.ends, -1)
                inside = np.cumsum(word[:-1], dtype=np.int8).astype(bool)
                chars = _sums(inside & ((b.data & 0xC0) != 0x80), b.offsets)
                symbols = _sums(~_SYMBOLS[b.data], b.offsets)
                value = np.zeros(len(b.data), dtype=np.int64)
                found = buckets(b.data, bits)
                value[: len(found)] = whole[found]
                for i in range(1, GRAM_BYTES):
                    at = b.offsets[1:] - i
                    value[at[at >= 0]] = 0
                grams = np.maximum(np.diff(b.offsets) - GRAM_BYTES + 1, 0)
                score = _sums(value, b.offsets) / _UNIT / np.maximum(grams, 1)
                lines = [_dup_lines(b.text(i)) if len(b.data) else 0 for i in range(len(b.first) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.rows.start, b.rows.stop - b.rows.start), *(pa.array(np.asarray(x, dtype=np.int64)) for x in (np.diff(b.first), chars, symbols, lines, _repeats(b))), pa.array(score)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return run


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS, bits: int = BUCKET_BITS) -> DataFrame:
    """Counts, rules and verdict of each row of ``docs(doc_id, text)``; ``trusted(doc_id)`` names the texts to resemble.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept``. The trusted
    multinomial is fitted on the ``trusted_rows`` trusted ids of least hash, a fixed bound; the raw one on all documents.

    A null or empty text has zero counts and fails the rules. A text shorter than an n-gram has score 0. Without trusted
    texts every score is 0 and the rules alone decide. Rows without an id are scored; repeated rows are scored each; a score
    at the threshold is kept; an empty table gives an empty result; texts of any length are read whole; extra columns are ignored.
    """
    chosen = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows).withColumn("trusted", F.lit(True))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    ratio = log_ratios(texts.join(F.broadcast(chosen), "doc_id", "left"), bits)  # at most trusted_rows ids
    out = texts.mapInArrow(_rules(ratio, bits), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
