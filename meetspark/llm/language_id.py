"""Language identification by Bayesian fusion of text, declared language, address and host.

The evidence for each language is added up as log probabilities:

* text: hashed character n-gram multinomials, counted for each language over all rows of the corpus that declare it, with
  the mean log likelihood weighed as a bounded number of independent n-grams;
* declared markup language and address suffix (country domain or path segment): the chance to see them given the language;
* host prior: how the texts of the host look, smoothed by those of its suffix, smoothed by those of the whole corpus, all
  by grouped aggregation, without the row's own share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import buckets
from .storage import saved
from .words import Block, blocks

BUCKET_BITS = 15
GRAM_BYTES = 3
COUNTED_AT_ONCE = 64  # languages whose counts a task holds before it passes them on
MODEL_ENTRIES = 1 << 22  # buckets of all languages that the driver and each task hold in one pass
MEANS_AT_ONCE = 1 << 21
EFFECTIVE_GRAMS = 40
RIGHT_MARKUP, RIGHT_ADDRESS = 0.9, 0.8
HOST_WEIGHT, SUFFIX_WEIGHT = 10.0, 100.0
MIN_POSTERIOR = 0.5
_LETTER = "\\p{L}"
_UNIT = 1 << 20  # log probabilities are added up as whole numbers, so sums do not depend on the order


def _grams(b: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram from each byte of a block, and whether it lies within one text."""
    found = buckets(b.data, bits, GRAM_BYTES)
    inside = np.ones(len(found), dtype=bool)
    for i in range(1, GRAM_BYTES):
        at = b.offsets[1:-1] - i
        inside[at[(at >= 0) & (at < len(found))]] = False
    return found, inside


def _counts(languages: list[str], bits: int):
    index = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for i, n in counts.items():
                bucket = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), i)), pa.array(bucket), pa.array(n[bucket])], names=["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            lang = np.array([index.get(x, -1) for x in batch.column("declared").to_pylist()])
            for b in blocks(batch.column("text")):
                found, inside = _grams(b, bits)
                own = np.where(inside, np.repeat(lang[b.rows], np.diff(b.offsets))[: len(found)], -1)
                for i in np.unique(own[own >= 0]).tolist():
                    if i not in counts:
                        if len(counts) == COUNTED_AT_ONCE:
                            yield from counted()
                        counts[i] = np.zeros(1 << bits, dtype=np.int64)
                    counts[i] += np.bincount(found[own == i], minlength=1 << bits)
        yield from counted()

    return run


def gram_counts(rows: DataFrame, languages: list[str], bits: int) -> DataFrame:
    """``lang`` (place in ``languages``), ``bucket, n`` of the n-grams of the rows that declare a language, in one pass over the texts."""
    found = rows.filter("declared IS NOT NULL").select("declared", "text").mapInArrow(_counts(languages, bits), "lang long, bucket long, n long")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def passes(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of languages, from and to, that have at most ``most`` entries together, or are one language."""
    out, first, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            out.append((first, i))
            first, held = i, 0
        held += n
    return [*out, (first, len(sizes))]


def _models(counted: DataFrame, first: int, last: int, bits: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of each language from ``first`` before ``last`` the log probability of a bucket that it never has, the buckets that it has and their
    log probabilities, in units of ``1 / _UNIT``."""
    found = counted.filter(F.col("lang").between(first, last - 1)).select(*(F.col(c).cast(t) for c, t in (("lang", "int"), ("bucket", "int"), ("n", "double")))).toPandas().sort_values("lang")
    edges = np.searchsorted(found["lang"].to_numpy(), np.arange(first, last + 1))
    bucket, n = found["bucket"].to_numpy(np.int32), found["n"].to_numpy()
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        table = np.full(1 << bits, 0.1)
        table[bucket[lo:hi]] += n[lo:hi]
        every = np.log(table.sum())
        out.append((int(np.rint((np.log(0.1) - every) * _UNIT)), bucket[lo:hi], np.rint((np.log(table[bucket[lo:hi]]) - every) * _UNIT).astype(np.int32)))
    return out


def _means(models: list[tuple[int, np.ndarray, np.ndarray]], bits: int, known: int):
    """Adds to each row's ``means``, of which it has ``known``, the mean log likelihood of its n-grams under each of the models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MEANS_AT_ONCE // (known + len(models)))
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                out, grams = np.zeros((len(batch), len(models))), np.zeros(len(batch), dtype=np.int64)
                for b in blocks(batch.column("text"), block_bytes=1 << 19):
                    found, _ = _grams(b, bits)
                    n = np.maximum(np.diff(b.offsets) - GRAM_BYTES + 1, 0)
                    begin = np.minimum(b.offsets[:-1], len(found))
                    end = np.minimum(begin + n, len(found))
                    line = np.empty(1 << bits, dtype=np.int32)
                    for i, (unseen, bucket, value) in enumerate(models):
                        line.fill(unseen)
                        line[bucket] = value
                        total = np.concatenate([[0], np.cumsum(line[found], dtype=np.int64)])
                        out[b.rows, i] = (total[end] - total[begin]) / np.maximum(n, 1) / _UNIT
                    grams[b.rows] = n
                before = _dense(batch.column("means"), len(batch))
                kept = [c for c in batch.schema.names if c not in ("means", "grams")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _lists(np.hstack([before, out])), pa.array(grams)], names=[*kept, "means", "grams"])

    return run


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _dense(lists: pa.Array, n: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return np.asarray(lists.flatten()).reshape(n, -1) if n else np.zeros((0, 0))


def _sparse(column: pa.Array, shape: tuple[int, int]) -> np.ndarray:
    """A column of lists of (language, count) as a matrix."""
    out = np.zeros(shape)
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    pairs = column.flatten()
    if len(pairs):
        out[np.repeat(np.arange(shape[0]), size), np.asarray(pairs.field(0))] = np.asarray(pairs.field(1))
    return out


def _fused(languages: list[str], corpus: np.ndarray):
    """Language, posterior and language by text alone of each row."""
    index, n = {x: i for i, x in enumerate(languages)}, len(languages)

    def seen(codes: list[str | None], right: float) -> np.ndarray:
        out = np.full((len(codes), n), np.log((1 - right) / max(1, n - 1)))
        for i, c in enumerate(codes):
            if c is None:
                out[i] = 0
            elif c in index:
                out[i, index[c]] = np.log(right)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 19) // n)
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                shape = len(part), n
                grams, guess = np.asarray(part.column("grams")), np.asarray(part.column("guess"))
                letters = guess >= 0
                own = np.zeros(shape)
                own[np.flatnonzero(letters), guess[letters]] = 1
                in_suffix, in_host = (_sparse(part.column(c), shape) - own for c in ("in_suffix", "in_host"))
                suffix = (in_suffix + SUFFIX_WEIGHT * corpus) / (in_suffix.sum(axis=1, keepdims=True) + SUFFIX_WEIGHT)
                host = (in_host + HOST_WEIGHT * suffix) / (in_host.sum(axis=1, keepdims=True) + HOST_WEIGHT)
                score = _dense(part.column("means"), len(part)) * np.minimum(grams, EFFECTIVE_GRAMS)[:, None]
                score += seen(part.column("declared").to_pylist(), RIGHT_MARKUP) + seen(part.column("address").to_pylist(), RIGHT_ADDRESS) + np.log(host)
                best = score.argmax(axis=1)
                sure = np.round(1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1), 6)
                name = lambda of, letters=letters: pa.array([languages[i] if x else "und" for i, x in zip(of.tolist(), letters.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("uid"), name(best), pa.array(np.where(letters, sure, 0.0)), name(guess)], names=["uid", "language", "posterior", "text_language"])

    return run


def identify(rows: DataFrame, bits: int = BUCKET_BITS, min_posterior: float = MIN_POSTERIOR, entries: int = MODEL_ENTRIES) -> DataFrame:
    """``uid, language, posterior, text_language, accepted`` of ``rows(uid, text, declared, address, host, suffix)``.

    ``uid`` is unique; ``declared`` and ``address`` are language codes or null (no evidence); ``host`` and ``suffix`` may be
    null (one group of their own). Every declared language takes part: one pass counts the n-grams of all of them, and one scores all
    texts as long as the languages have at most ``entries`` different buckets together, which bounds the driver's and the tasks' memory;
    rare codes have few, so thousands of them fit beside the common ones. What is beyond costs further passes. A row is accepted if its text has
    a letter and its best language a posterior of ``min_posterior`` or more; a text without a letter (null, empty) is ``und``
    with posterior 0. Ties go to the first language by name. If nothing is declared at all, every row is ``und``.
    """
    languages = sorted(r[0] for r in rows.filter("declared IS NOT NULL").select("declared").distinct().collect())  # codes of two or three letters
    if not languages:
        return rows.select("uid", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_language"), F.lit(False).alias("accepted"))
    kind = rows.schema["uid"].dataType.simpleString()
    letters = F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))
    now = rows.select("uid", letters.alias("letters"), "declared", "address", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix"), "text", F.array().cast("array<double>").alias("means"), F.lit(0).cast("long").alias("grams"))
    shape = f"uid {kind}, letters boolean, declared string, address string, host string, suffix string, text string, means array<double>, grams long"
    counted = saved(gram_counts(rows, languages, bits), "grams")
    sizes = {r["lang"]: r["count"] for r in counted.groupBy("lang").count().collect()}  # at most one row for each code
    for first, last in passes([sizes.get(i, 0) for i in range(len(languages))], entries):
        now = now.mapInArrow(_means(_models(counted, first, last, bits), bits, first), shape)
        if last < len(languages):
            now = saved(now, "means")
    guess = F.when(F.col("letters"), F.array_position("means", F.array_max("means")).cast("int") - 1).otherwise(-1)
    known = saved(now.drop("text").withColumn("guess", guess), "evidence")
    # how texts look: in the corpus, in the suffix and in the host
    looks = saved(known.filter("guess >= 0").groupBy("host", "suffix", "guess").agg(F.count("*").alias("n")), "looks")
    every = {r["guess"]: r["n"] for r in looks.groupBy("guess").agg(F.sum("n").alias("n")).collect()}
    corpus = (np.array([every.get(i, 0) for i in range(len(languages))]) + 1.0) / (sum(every.values()) + len(languages))
    listed = lambda name: F.collect_list(F.struct("guess", "n")).alias(name)  # noqa: E731  one entry for each language
    by_suffix = looks.groupBy("suffix", "guess").agg(F.sum("n").alias("n")).groupBy("suffix").agg(listed("in_suffix"))
    priors = saved(looks.groupBy("host", "suffix").agg(listed("in_host")).join(by_suffix, "suffix"), "priors")
    placed = known.join(priors, ["host", "suffix"], "left").select("uid", "guess", "means", "grams", "declared", "address", "in_host", "in_suffix")
    out = placed.mapInArrow(_fused(languages, corpus), f"uid {kind}, language string, posterior double, text_language string")
    return out.withColumn("accepted", F.col("posterior") >= min_posterior)


def primary(code: Column) -> Column:
    """``fr`` of ``fr-CA``; null for what is no language code."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(code)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def identify_pages(pages: DataFrame) -> DataFrame:
    """Language of each row of ``pages(page_id, url, html)``: ``page_id, url, language, posterior, text_language, accepted``.

    Text is the html without scripts, styles, comments and tags; the declared language is that of the first ``<html lang>`` outside
    comments, wherever it stands. Null html has no text; null or odd urls give no address evidence and share one host group;
    repeated rows are judged each; an empty table gives an empty result; pages of any length are read whole; extra columns are
    ignored, whatever their names.
    """
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?(</\1\s*>|\z)|<!--.*?(-->|\z)|<[^<>]*>|&\w+;", " ")
    seen = F.regexp_replace("html", r"(?s)<!--.*?(-->|\z)", " ")
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    segment = F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit(""))
    country = F.when(F.length(suffix) == 2, suffix)
    rows = pages.select("page_id", "url", bare.alias("text"), primary(F.regexp_extract(seen, r"(?i)<html\b[^<>]*?[\s\"'](?:xml:)?lang\s*=\s*[\"']?([A-Za-z_-]+)", 1)).alias("declared"), F.coalesce(segment, country).alias("address"), host.alias("host"), suffix.alias("suffix"))
    rows = saved(rows.withColumn("uid", F.monotonically_increasing_id()), "bare")
    found = identify(rows.select("uid", "text", "declared", "address", "host", "suffix"))
    return rows.select("uid", "page_id", "url").join(found, "uid").drop("uid")


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(text, lang, source, ...)`` whose language is accepted; columns stay as they are.

    ``lang`` is the declared language and ``source`` the host; documents have no address. Nulls are no evidence; null, empty and
    letterless texts are not accepted; each row is judged for itself, so repeated rows and ids stay as they are; an empty table
    gives an empty result.
    """
    rows = saved(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")
    facts = rows.select("uid", F.col("row.text").alias("text"), primary(F.col("row.lang")).alias("declared"), F.lit(None).cast("string").alias("address"), F.col("row.source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"))
    good = identify(facts).filter("accepted").select("uid")
    return rows.join(good.hint("shuffle_hash"), "uid").select("row.*")
