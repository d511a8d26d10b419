"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Word 4-grams are hashed; the least hash in every window of ten words is kept as the window's fingerprint, in benchmark items
and in documents alike, so any shared window shares its fingerprint and is found. Neighbouring windows of a document mostly
share theirs: such a run is one row with its fingerprint and the words it spans. Runs are joined with the benchmark's
fingerprints; those that meet are extended: their windows are compared with the benchmark's word by word. Items shorter than a
window are one window of their own length and go the same way with that length.

The benchmark's fingerprints also set bits of a filter, ``BITS_PER_PRINT`` for each and ``MOST_BITS`` at most (1 MB, a literal of
the plan). One scan of the documents computes the fingerprints of all window lengths and keeps the runs whose bit is
set. The filter only ever lets through more, so results are exact whatever the benchmark's size; where a larger one fills it, all
runs of the documents go to the join of fingerprints, about a row for each four words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved

WINDOW = 10
GRAM = 4
BITS_PER_PRINT, MOST_BITS = 16, 1 << 23
_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z were lower-cased; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), _NO_WORD)
    return F.filter(parts, lambda x: x != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: a lambda's variable is never put in place of its expression again."""
    return F.transform(F.array(value), body).getItem(0)


def window_prints(words: Column, window: int, gram: int) -> Column:
    """The winnowed fingerprint of each window of a word array: the least hash of its word ``gram``-grams."""
    gram = min(gram, window)
    size = F.greatest(F.size(words) - (window - 1), F.lit(0))

    def grams(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, gram)))) if gram > 1 else h

    def least(g: Column) -> Column:
        return F.slice(F.transform(g, lambda x, i: F.least(x, *(F.get(g, i + j) for j in range(1, window - gram + 1)))) if window > gram else g, F.lit(1), size)

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(grams(h), least))


RUN = 64  # windows of a run; longer ones, of repeated words, are cut


def _met(lengths: list[int], gram: int, bits: Column, size: int):
    """Of a word array: how many words it has, and the runs of windows of each length with one fingerprint whose bit is set."""

    def runs(w: Column, length: int) -> Column:
        held = lambda x: F.getbit(F.get(bits, F.shiftright(x.bitwiseAND(F.lit(size - 1)), 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1

        def of(prints: Column) -> Column:
            opens = F.transform(prints, lambda x, i: F.when(held(x) & ((i % RUN == 0) | (x != F.get(prints, i - 1))), i))
            return let(F.filter(opens, lambda i: i.isNotNull()), lambda at: F.transform(at, lambda i: run(prints, i)))

        def run(prints: Column, i: Column) -> Column:
            # how many of the next windows, up to the next cut, have the same fingerprint
            print_ = F.get(prints, i)
            ahead = F.slice(prints, i + 1, F.lit(RUN) - i % RUN)
            n = F.coalesce(F.nullif(F.array_position(F.transform(ahead, lambda x: x != print_), True), F.lit(0).cast("long")) - 1, F.size(ahead).cast("long")).cast("int")
            return F.struct(i.alias("at"), F.lit(length).alias("length"), print_.alias("print"), F.array_join(F.slice(w, i + 1, n + (length - 1)), " ").alias("words"))

        return let(window_prints(w, length, gram), of)

    return lambda w: F.struct(F.size(w).cast("long").alias("n"), F.concat(*(runs(w, n) for n in lengths)).alias("met"))


def _windows_of(runs: DataFrame) -> DataFrame:
    """``uid, at, length, key`` of every window of ``runs(uid, at, length, words)``."""
    words = F.split("words", " ")
    each = runs.select("uid", F.col("at").alias("first"), "length", words.alias("w")).select("uid", "first", "length", "w", F.posexplode(F.slice("w", F.lit(1), F.size("w") - F.col("length") + 1)).alias("i", "x"))
    return each.select("uid", (F.col("first") + F.col("i")).alias("at"), "length", F.array_join(F.slice("w", F.col("i") + 1, F.col("length")), " ").alias("key"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``length, print, key, item_id`` of every window of every item; ``key`` is its words joined by spaces."""
    items = benchmark.select(F.col("item_id"), split_words(lower_ascii(F.col("text"))).alias("words")).filter(F.size("words") > 0)
    items = saved(items, "items")
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect())
    parts = []
    for length in lengths:
        fit = items.filter(F.size("words") >= window) if length == window else items.filter(F.size("words") == length)
        spread = fit.select("item_id", "words", F.posexplode(window_prints(F.col("words"), length, gram)).alias("at", "print"))
        parts.append(spread.select(F.lit(length).alias("length"), "print", F.array_join(F.slice("words", F.col("at") + 1, F.lit(length)), " ").alias("key"), "item_id"))
    if not parts:
        return items.select(F.lit(0).alias("length"), F.lit(0).cast("long").alias("print"), F.lit("").alias("key"), "item_id").limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return saved(out.distinct(), "windows")


def _filter(windows: DataFrame, most_bits: int) -> tuple[Column, int]:
    """The bits of all fingerprints as an array of 64-bit words, and their number, a power of two."""
    n = windows.select("print").distinct().count()
    size = min(most_bits, max(64, 1 << (BITS_PER_PRINT * n - 1).bit_length()))
    slot = F.col("print").bitwiseAND(F.lit(size - 1))
    words = windows.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(print & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    held = {r["w"]: r["b"] for r in words.collect()}  # at most most_bits / 64 rows
    return F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(size // 64))), ",").cast("array<bigint>"), size


def scanned(docs: DataFrame, windows: DataFrame, gram: int = GRAM, most_bits: int = MOST_BITS) -> DataFrame:
    """The columns of ``docs(..., text)`` but ``text``, its ``n_words``, ``met`` (runs that the filter lets through) and ``uid``, a number
    of the row."""
    words = split_words(lower_ascii(F.col("text")))
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most a window's words
    others = [c for c in docs.columns if c != "text"]
    if not lengths:
        out = docs.select(*others, F.size(words).cast("long").alias("n_words"), F.lit(None).cast("array<struct<at:int,length:int,print:long,words:string>>").alias("met"))
    else:
        out = docs.select(*others, let(words, _met(lengths, gram, *_filter(windows, most_bits))).alias("x")).select(*others, F.col("x.n").alias("n_words"), F.col("x.met").alias("met"))
    return saved(out.withColumn("uid", F.monotonically_increasing_id()), "scanned")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, most_bits: int) -> DataFrame:
    """``doc_id, h`` (hash of the text) and the results of each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text"))
    windows = benchmark_windows(benchmark.filter("item_id IS NOT NULL"), window, gram)
    scan = scanned(rows, windows, gram, most_bits)
    prints, kinds = windows.select("length", "print").distinct(), windows.select("length", "key").distinct()
    runs = scan.select("uid", F.explode("met").alias("m")).select("uid", "m.*").join(prints, ["length", "print"])
    hits = saved(_windows_of(runs).join(kinds, ["length", "key"]), "hits")
    covered = hits.select("uid", F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("at"))
    covered = covered.groupBy("uid").agg(F.countDistinct("at").alias("n_hit"))
    items = hits.select("uid", "key").distinct().join(windows.select("key", F.col("item_id").cast("string").alias("item")).distinct(), "key")
    items = items.select("uid", "item").distinct().groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    each = scan.select("doc_id", "h", "uid", "n_words").join(covered, "uid", "left").join(items, "uid", "left")
    none = F.array().cast("array<string>")
    return each.select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, most_bits: int = MOST_BITS) -> DataFrame:
    """Words of documents inside windows of benchmark items, and those items.

    ``docs(doc_id, text)``, ``benchmark(item_id, text)``. Texts are lower-cased in A-Z and split into words. A window is
    ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Returns ``doc_id, n_words,
    n_hit`` (words inside any occurrence of a window), ``n_items`` and ``item_ids`` (items with windows that occur, sorted
    as strings), ``contaminated`` (n_hit > 0).

    Edge cases: a null or empty text has no words and is clean; items without words or id match nothing; rows that repeat a
    doc_id give one row each, judged by its own text; rows without an id are judged too; an empty benchmark leaves all
    documents clean; an empty table gives an empty result; texts of any length are read whole; extra columns are ignored.
    """
    out = _judged(docs, benchmark, window, gram, most_bits)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a word inside a benchmark window; columns stay as they are.

    Each row is judged by its own text: of rows that repeat an id, or have none, the clean ones stay. A null or empty text is
    clean; an empty table gives an empty result; columns beside ``doc_id`` and ``text`` may have any name.
    """
    dirty = _judged(docs, benchmark, window, GRAM, MOST_BITS).filter("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    return docs.join(dirty, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__h")), "left_anti")
