"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 * r`` bits have a common variant within ``r`` bits of each, so every different
fingerprint emits all variants within ``r`` bits and equal variants meet in one shuffle. With ``r = 1`` a bucket holds at
most 65 different fingerprints, all of which are within two bits of each other; a star from the smallest verified one keeps
the component, so no bucket is expanded into all its pairs. Exact copies are collapsed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import saved

BITS = 64
_SHINGLES_AT_ONCE = 1 << 14


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed number; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        width = len(words)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest, ones, n = xxhash.xxh64_digest, np.zeros(BITS, dtype=np.int64), len(starts)
    for i in range(0, n, _SHINGLES_AT_ONCE):
        part = b"".join([digest(line[s:e], seed) for s, e in zip(starts[i : i + _SHINGLES_AT_ONCE], stops[i : i + _SHINGLES_AT_ONCE], strict=True)])
        ones += np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(prints, pa.int64())], names=[*batch.schema.names[:-1], "print"])

    return run


def links(prints: DataFrame) -> DataFrame:
    """Links ``a < b`` between different fingerprints at most two bits apart, enough to join every component.

    The fingerprints are dealt out anew first: each becomes 65 rows, and few small files would be few large tasks.
    """
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long") for i in range(BITS)))
    variants = prints.repartition(n).select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("variant"))
    met = variants.groupBy("variant").agg(F.collect_set("print").alias("near")).filter(F.size("near") > 1)
    pairs = met.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a < b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def simhash_groups(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id, print, h``: groups of documents linked by fingerprints two or fewer bits apart.

    Texts are lower-cased in A-Z; words are ``[^\\x20\\x09-\\x0D]+``; shingles have ``width`` words, repeats count; a text
    of fewer words is one shingle; a text without words (null, empty) has fingerprint zero and is linked like any other.
    ``component_id`` is the smallest id reachable; ``h`` is a hash of the text. One row for each row of ``docs``; extra columns are
    ignored, whatever their names; texts of any length are read whole. A row without an id is returned and gets its component's
    smallest id; repeated rows and ids are rows like any other. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    prints = saved(texts.mapInArrow(_fingerprints(width), "doc_id long, h long, print long"), "prints")
    firsts = saved(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "firsts")
    member = components(links(firsts.select("print")))
    placed = saved(firsts.join(member.withColumnRenamed("node", "print"), "print", "left").select("print", "first", F.coalesce("component", "print").alias("component")), "placed")
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = saved(placed.join(smallest, "component").select("print", "component_id"), "labels")
    return prints.join(labels, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "print", "h")


def simhash_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """The rows of ``docs``, one document of each group: that with the smallest ``doc_id``. Columns stay as they are.

    A document is an id with its text: of rows that repeat the kept id those with its text or another text of its group
    stay, those of other groups are judged there. A row without an id stays. An empty table gives an empty result.
    """
    keep = simhash_groups(docs, width).filter("doc_id = component_id").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    kept = docs.join(keep, (docs["doc_id"].cast("long") == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__h")), "left")
    return kept.filter(F.col("__id").isNotNull() | docs["doc_id"].isNull()).select(*(docs[c] for c in docs.columns))
