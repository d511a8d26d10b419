"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

All words have one global order: words of no template first, then the templates' words by how often the corpus has them, rarest
first. Blocks and templates are sets in that order, so a block is known by the ranks of its template words. A block that
contains ``needed = ceil(threshold * |T|)`` of a template's words

* has a word of the template's prefix, its first ``|T| - needed + 1`` words (prefix filter, an equi-join on that word);
* has ``needed`` template words at all (length filter);
* has ``needed`` words left, in the block and in the template, from the first common word on (positional filter on both sides);

and what passes is verified on the sets. A block is a line, or the end of a line and the words that follow it
in the next lines, as many as the longest template has. All of it is DataFrame operations: documents
without a prefix word are left out by the scan itself, and only the others are taken apart into blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import let, lower_ascii, split_words

# The phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Short notices by which licenses are declared, and the labels of the method.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "bsd-2-clause": ["licensed under the bsd 2 clause license"],
    "bsd-3-clause": ["licensed under the bsd 3 clause license"],
    "cc-by-4.0": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "gpl-2.0": ["licensed under the gnu general public license version 2"],
    "gpl-3.0": ["licensed under the gnu general public license version 3"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["subject to the terms of the mozilla public license version 2 0"],
}
THRESHOLD = 0.8
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _any(phrases: list[str]) -> str:
    """A pattern for phrases of whole words in a text that is not lower-cased."""
    return f"(?i)(?<!{_WORD})(?:{'|'.join(_GAP.join(p.split()) for p in phrases)})(?!{_WORD})"


def template_sets(templates: dict[str, list[str]]) -> list[tuple[str, tuple[str, ...]]]:
    return [(label, tuple(sorted(set(text.split())))) for label, texts in sorted(templates.items()) for text in texts]


def ordered_vocabulary(texts: DataFrame, templates: dict[str, list[str]]) -> list[str]:
    """All template words, rarest first by their number of places in ``texts(words)``."""
    vocabulary = sorted({w for _, words in template_sets(templates) for w in words})
    named = ", ".join(f"'{w}'" for w in vocabulary)
    found = texts.select(F.explode(F.expr(f"filter(words, w -> w IN ({named}))")).alias("w")).groupBy("w").count()
    times = {r["w"]: r["count"] for r in found.collect()}  # at most one row for each template word
    return sorted(vocabulary, key=lambda w: (times.get(w, 0), w))


def template_prefixes(order: list[str], templates: dict[str, list[str]], threshold: float) -> list[tuple[str, list[int], int, int, int]]:
    """``label, words`` (ranks from 1), ``needed, rank, at`` of every prefix word of every template."""
    rank, out = {w: i for i, w in enumerate(order, 1)}, []
    for label, words in template_sets(templates):
        ranks, needed = sorted(rank[w] for w in words), math.ceil(threshold * len(words) - 1e-9)
        out += [(label, ranks, needed, r, at) for at, r in enumerate(ranks[: len(ranks) - needed + 1])]
    return out


def text_blocks(rows: DataFrame, prefix: list[str], most: int) -> DataFrame:
    """``uid, wrapped, line, block`` (different words): lines of ``rows(uid, text)``, and runs of ``most`` words over line ends, with a
    prefix word."""
    some = rows.filter(F.col("text").rlike(_any(prefix)))
    lines = some.select("uid", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    lines = lines.filter(F.col("t").rlike(_any(prefix))).select("uid", F.lit(False).alias("wrapped"), "line", F.array_distinct(split_words(lower_ascii(F.col("t")))).alias("block"))
    # every run of up to ``most`` words that goes beyond its first line is in the wrapped block of that line
    worded = some.select("uid", F.filter(F.transform(F.split("text", "\n"), lambda t: split_words(lower_ascii(t))), lambda w: F.size(w) > 0).alias("lines"))
    worded = worded.withColumn("heads", F.transform("lines", lambda w: F.slice(w, 1, most - 1)))
    tail = lambda w: F.slice(w, F.greatest(F.size(w) - (most - 2), F.lit(1)), F.lit(most - 1))
    after = lambda i: F.slice(F.flatten(F.slice(F.col("heads"), i + 2, F.lit(most - 1))), 1, most - 1)
    wrapped = F.transform("lines", lambda w, i: F.array_distinct(F.concat(tail(w), after(i))))
    wrapped = worded.filter((F.size("lines") > 1) & F.lit(most > 1)).select("uid", F.posexplode(wrapped).alias("line", "block"))
    wrapped = wrapped.filter(F.arrays_overlap("block", F.array(*map(F.lit, prefix)))).select("uid", F.lit(True).alias("wrapped"), "line", "block")
    return lines.unionByName(wrapped)


def candidates(blocks: DataFrame, order: list[str], prefixes: list[tuple[str, list[int], int, int, int]], positional: bool = True) -> DataFrame:
    """Pairs of blocks and templates that pass the filters, once for each common prefix word: ``uid, wrapped, line, ranks, label, words,
    needed``."""
    table = blocks.sparkSession.createDataFrame(prefixes, "label string, words array<int>, needed int, rank int, at int")
    place = F.array(*map(F.lit, order))
    ranks = F.array_sort(F.filter(F.transform("block", lambda w: F.array_position(place, w).cast("int")), lambda r: r > 0))
    heads = ", ".join(str(r) for r in sorted({r for *_, r, _ in prefixes}))
    keyed = blocks.select("uid", "wrapped", "line", ranks.alias("ranks")).select("*", F.posexplode("ranks").alias("own", "rank")).filter(f"rank IN ({heads})")
    met = keyed.join(F.broadcast(table), "rank").filter(F.size("ranks") >= F.col("needed"))  # a row for each prefix word of the given templates
    return met.filter(F.least(F.size("ranks") - F.col("own"), F.size("words") - F.col("at")) >= F.col("needed")) if positional else met


def license_blocks(rows: DataFrame, templates: dict[str, list[str]], threshold: float = THRESHOLD) -> DataFrame:
    """``uid, label, score`` of the templates that blocks of ``rows(uid, text)`` contain to at least ``threshold``.

    Versions of one license (labels alike up to the first hyphen) differ in a word, so of each license a block takes the labels
    of the templates that it contains best.
    """
    order = ordered_vocabulary(rows.select(split_words(lower_ascii(F.col("text"))).alias("words")), templates)
    prefixes = template_prefixes(order, templates, threshold)
    most = max((len(text.split()) for texts in templates.values() for text in texts), default=1)
    blocks = text_blocks(rows, sorted({order[r - 1] for *_, r, _ in prefixes}), most)
    met = candidates(blocks, order, prefixes)
    common = met.withColumn("common", F.size(F.array_intersect("ranks", "words"))).filter("common >= needed")
    scored = common.select("uid", "wrapped", "line", "label", (F.col("common") / F.size("words")).alias("score")).distinct()
    best = scored.withColumn("best", F.max("score").over(Window.partitionBy("uid", "wrapped", "line", F.substring_index("label", "-", 1)))).filter("score = best")
    return best.groupBy("uid", "label").agg(F.max("score").alias("score"))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licenses named in ``docs(doc_id, text)``.

    Returns ``doc_id, n_words, n_base`` (places where a phrase's words stand consecutively), ``first_word, last_word`` (their
    smallest and largest start, words counted from 0), ``base_labels, labels`` (with the templates' labels), ``score`` (the
    best containment; 1 where a phrase was found). Words are those of ``split_words`` in the text lower-cased in A-Z.

    Edge cases: a null or empty text has no words, no labels and score 0; a row without an id is scanned; rows that repeat an
    id are scanned each by its own text; an empty table gives an empty result; texts of any length are scanned whole; extra
    columns are ignored.
    """
    phrases = PHRASES if phrases is None else phrases
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = rows.select("doc_id", F.struct("doc_id", F.xxhash64("text").alias("h")).alias("uid"), "text")
    found = license_blocks(rows.select("uid", "text"), TEMPLATES if templates is None else templates, threshold)
    found = found.groupBy("uid").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))

    def places(words: Column) -> Column:
        def test(w: Column, i: Column) -> Column:
            out = None
            for phrase, label in sorted(phrases.items()):
                first, *rest = phrase.split()
                same = w == first
                for j, x in enumerate(rest, 1):
                    same = same & (F.get(words, i + j) == x)
                found = F.struct(i.alias("at"), F.lit(label).alias("label"))
                out = F.when(same, found) if out is None else out.when(same, found)
            return out

        return F.filter(F.transform(words, test), lambda p: p.isNotNull())

    named = F.coalesce(F.col("text").rlike(_any(sorted(phrases))), F.lit(False))
    base = rows.select("doc_id", "uid", let(split_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.when(named, let(F.transform(w, lower_ascii), places)).alias("p"))).alias("x"))
    base = base.select("doc_id", "uid", F.col("x.n").alias("n_words"), F.coalesce("x.p", F.array().cast("array<struct<at:int,label:string>>")).alias("p"))
    base = base.select("doc_id", "uid", "n_words", F.size("p").cast("long").alias("n_base"), F.array_min("p.at").cast("long").alias("first_word"), F.array_max("p.at").cast("long").alias("last_word"), F.array_distinct("p.label").alias("own"))
    out = base.join(found.withColumnRenamed("uid", "other"), F.col("uid").eqNullSafe(F.col("other")), "left")
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", listed("own").alias("base_labels"), listed(F.array_union("own", F.coalesce("more", none))).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
