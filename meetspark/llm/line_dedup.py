"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations alone.

A line goes if an earlier line (by document, then place) is within the edit bound: equal after white space is squeezed, or,
for lines of ``min_words`` words or more, one word inserted, deleted or replaced. Words are the letters of the edit distance.

1. Equal lines are collapsed to their earliest place by a pre-aggregated group-by on a 128-bit hash.
2. Two lines one edit apart agree on their first or on their last half (the halves of the shorter one). Each different line
   emits these halves as keys, and only lines that meet another one go on.
3. Those emit all variants with one word deleted as hashed keys, with the place of the deletion, and themselves. Lines that
   meet with the same deletion place differ by one replaced word; a line that meets a variant differs by one inserted word.
   Hence minima over a bucket decide all its lines, and no bucket is expanded into pairs.
4. The edit distance to the earliest line found is verified on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import let
from .storage import saved

MIN_WORDS = 5
RUN = 64


def _spaced(text: Column) -> Column:
    """A text whose white space inside lines is spaces alone: splitting at one character is much cheaper than at a pattern."""
    for c in "\x09\x0b\x0c\x0d":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _words(line: Column) -> Column:
    """Words of a line of a spaced text."""
    return F.array_remove(F.split(line, " "), "")


def _halves(words: Column) -> Column:
    """Hashes of the first and the last half of a line, as a line of its length and as one of a word more."""
    n = F.size(words)
    half, low = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.array(
        F.xxhash64(n, F.lit("P"), F.slice(words, F.lit(1), half)),
        F.xxhash64(n, F.lit("S"), F.slice(words, half + 1, n - half)),
        F.xxhash64(n - 1, F.lit("P"), F.slice(words, F.lit(1), low)),
        F.xxhash64(n - 1, F.lit("S"), F.slice(words, low + 2, n - 1 - low)),
    )


def _running_xor(values: Column, of, least: int = RUN) -> Column:
    """XOR of all ``of(x)`` before each place of an array and at its end. Runs of ``least`` places are folded, then the runs:
    a fold over the whole array would copy its result at each step."""
    fold = lambda a, f: F.aggregate(a, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.try_element_at(s, F.lit(-1)).bitwiseXOR(f(x)))))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / least).cast("int") - 1, F.lit(0))), lambda c: fold(F.slice(values, c * least + 1, F.lit(least)), of))

    def joined(runs: Column, ahead: Column) -> Column:
        inner = F.transform(runs, lambda r, c: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda v: v.bitwiseXOR(F.get(ahead, c))))
        return F.concat(F.flatten(inner), F.array(F.try_element_at(ahead, F.lit(-1))))

    return let(runs, lambda r: let(fold(r, lambda x: F.try_element_at(x, F.lit(-1))), lambda ahead: joined(r, ahead)))


def _near(words: str, other: str) -> Column:
    """One word inserted, deleted or replaced between two different word arrays at most."""
    same = f"zip_with({words}, {other}, (x, y) -> x <=> y)"
    back = f"zip_with(reverse({words}), reverse({other}), (x, y) -> x <=> y)"
    run = "coalesce(nullif(array_position({0}, false), 0) - 1, size({0}))"  # equal words from the start
    replaced = f"size(filter({same}, e -> NOT e)) <= 1"
    inserted = f"{run.format(same)} + {run.format(back)} >= least(size({words}), size({other}))"
    return F.expr(f"CASE abs(size({words}) - size({other})) WHEN 0 THEN {replaced} WHEN 1 THEN {inserted} ELSE false END")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, h, at`` of the lines of ``docs(doc_id, h, text)`` that an earlier line makes redundant.

    ``h`` is the hash of the text, so that rows that repeat an id are kept apart.
    """
    place = F.struct("doc_id", "h", "at")

    spaced = docs.select("doc_id", "h", _spaced(F.col("text")).alias("text"))
    keyed = spaced.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.trim("line") != "")
    keyed = keyed.select("doc_id", "h", "at", _words(F.col("line")).alias("words"))
    keyed = keyed.select("doc_id", "h", "at", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"), F.when(F.size("words") >= min_words, _halves(F.col("words"))).alias("halves"))
    lines = saved(keyed, "lines")
    firsts = saved(lines.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.first("halves").alias("halves")), "firsts")
    exact = lines.join(firsts.select("k1", "k2", "first"), ["k1", "k2"]).filter(place > F.col("first")).select("doc_id", "h", "at")
    # lines that share a half with another line
    meet = firsts.select("k1", "k2", "first", F.explode("halves").alias("half"))
    shared = saved(meet.groupBy("half").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo <> hi").select("half"), "halves")
    going = meet.join(shared, "half").groupBy("k1", "k2").agg(F.first("first").alias("first"))
    wanted = saved(going.select("k1", "k2", "first", F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"), F.col("first.at").alias("at")), "going")
    listed = wanted.groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("k1", "k2")))).alias("which"))
    texts = docs.join(listed.hint("shuffle_hash"), ["doc_id", "h"])
    opened = texts.select("doc_id", "h", "which", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.array_contains(F.map_keys("which"), F.col("at")))
    opened = saved(opened.select(place.alias("first"), F.element_at("which", F.col("at")).alias("key"), _words(_spaced(F.col("line"))).alias("words")).dropDuplicates(["first"]), "opened")
    # deletion neighbourhood

    def neighbourhood(b: Column) -> Column:
        """All variants of a line by one running XOR: ``b`` has the hash of each word with the place it gets by a deletion
        before it, and what a deletion after it changes. A line as it is has gap 0."""
        step = _running_xor(b, lambda x: x["d"])
        shifted = F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x["b"]))

        def rows(run: Column, end: Column) -> Column:
            own = F.array(F.struct(F.lit(0).alias("gap"), F.xxhash64(F.try_element_at(run, F.lit(-1)).bitwiseXOR(end), F.size(b)).alias("v")))
            cut = F.transform(b, lambda x, i: F.struct((i + 1).alias("gap"), F.xxhash64(F.get(run, i).bitwiseXOR(x["b"]).bitwiseXOR(end), F.size(b) - 1).alias("v")))
            return F.concat(own, cut)

        return let(step, lambda run: let(shifted, lambda end: rows(run, end)))

    placed = F.transform("words", lambda w, j: F.struct(F.xxhash64(w, j - 1).alias("b"), F.xxhash64(w, j).bitwiseXOR(F.xxhash64(w, j - 1)).alias("d")))
    variants = let(placed, neighbourhood)
    spread = saved(opened.select("first", F.explode(variants).alias("x")).select("first", "x.gap", "x.v"), "variants")
    buckets = saved(
        spread.groupBy("v", "gap").agg(F.min("first").alias("lo"), F.count("*").alias("c")).groupBy("v")
        .agg(F.map_from_entries(F.collect_list(F.struct("gap", "lo"))).alias("by_gap"), F.min(F.when(F.col("gap") > 0, F.col("lo"))).alias("variant"), F.min(F.when(F.col("gap") == 0, F.col("lo"))).alias("whole"), F.sum("c").alias("c"))
        .filter("c > 1"),
        "buckets",
    )
    earlier = F.when(F.col("gap") == 0, F.col("variant")).otherwise(F.least(F.element_at("by_gap", F.col("gap")), F.col("whole")))
    pairs = spread.join(buckets, "v").select("first", earlier.alias("other")).filter(F.col("other") < F.col("first"))
    pairs = saved(pairs.groupBy("first").agg(F.min("other").alias("other")), "pairs")
    with_words = pairs.join(opened.select("first", F.col("words").alias("a")), "first").join(opened.select(F.col("first").alias("other"), F.col("words").alias("b")), "other")
    near = with_words.filter(_near("a", "b")).select("first")
    # every copy of a line goes with it
    keys = saved(near.join(wanted.select("first", "k1", "k2"), "first").select("k1", "k2"), "near")
    also = lines.join(keys, ["k1", "k2"]).select("doc_id", "h", "at")
    return exact.unionByName(also).distinct()


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Texts of ``docs(doc_id, text)`` without the lines that an earlier line makes redundant.

    Returns ``doc_id, n_lines, n_removed, kept_text``: lines are separated by ``\\n``; lines without a word are never removed
    or counted as copies; the first place of a line stays, also in its own document. The edit bound is one word for lines of
    ``min_words`` words or more and none below.

    Edge cases: a null text has no lines and stays null; an empty text has one empty line; rows that repeat an id with other
    texts are ordered by the hash of their text, exact repeats of a row are treated as one place and keep the same lines; a
    row without an id keeps all its lines and removes none; an empty table gives an empty result; lines and texts of any length
    are read whole, in time linear in their length; extra columns are ignored.
    """
    return _marked(docs.select("doc_id", "text"), min_words).select("doc_id", "n_lines", "n_removed", "kept_text")


def _marked(docs: DataFrame, min_words: int) -> DataFrame:
    """The columns of ``docs`` and ``n_lines, n_removed, kept_text``."""
    own = docs.columns
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text"))
    gone = removed_lines(rows.filter("doc_id IS NOT NULL"), min_words).groupBy("doc_id", "h").agg(F.collect_set("at").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "gone")
    out = rows.select("row", "doc_id", "h").join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("g")), "left")
    text = F.col("row.text")
    parts = F.split(text, "\n")
    kept = F.array_join(F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull()), "\n")
    n = F.when(text.isNull(), 0).otherwise(F.size(parts))
    return out.select("row.*", n.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), F.when(F.col("gone").isNull(), text).otherwise(kept).alias("kept_text"))


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs(doc_id, text, lang, source, n_chars)`` with the kept text and its length; every row stays."""
    marked = _marked(docs.select("doc_id", "text", "lang", "source", "n_chars"), min_words)
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return marked.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", length.alias("n_chars"))
