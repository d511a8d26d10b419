"""Removal of long passages that repeat across documents, by compaction of a sparse De Bruijn graph of word k-mers.

Every run of ``window`` words is a k-mer. Consecutive ones whose least inner ``ANCHOR_WORDS``-gram (the *anchor*) is the same
make a super-k-mer: a node of the graph, keyed by its anchor and by the hash of its words. Edges lead from a node to the one
that follows it in a text. Then, as Spark jobs:

1. Nodes whose anchor stands in one document only can hold no repeat and end there, by a pre-aggregated group-by.
2. Of every other node its copies are counted and its *source*, the first document and word position that has it, is kept.
   A join of the nodes with their successors finds the edges that do not branch: the node has one successor, and both have
   as many copies. Their sources then follow each other in one text, so runs of such edges are islands along the source
   coordinates, and each run becomes one compacted path. One join of first nodes with copies yields all copies of a path.
3. Where an anchor has different nodes (the ends of a repeat, or a changed word) each different node is opened once, in its
   source, into single k-mers, which are joined; those in a row on one diagonal are one span again.
4. Source coordinates verify every span: the words at its source are sent to the copy and compared word by word; only equal
   words are cut. A hash collision could hide a repeat but never cuts a word.

At scale: one row for every ``(window - k + 2) / 2`` words is shuffled, hot anchors are pre-aggregated before their shuffle,
and the joins back are plain sort-merge joins that adaptive execution can split. Windows run over one text's rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved
from .words import RangeHash, blocks, owner, sliding_argmin, span_hashes, word_hashes

ANCHOR_WORDS = 12
_NODES = "id long, row long, anchor long, node long, next long, lo int, hi int, times int"
_KMERS = "id long, row long, at int, k1 long, k2 long"
_SPAN = ["id", "row", "lo", "n", "times", "source_id", "source_row", "source_lo"]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _node_rows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (np.asarray(batch.column(c)) for c in ("id", "row"))
            for b in blocks(batch.column("text")):
                if len(b.starts) < window:
                    continue
                words = RangeHash(word_hashes(b))
                at = np.arange(len(b.starts) - k + 1)
                grams = words.of(at, at + k)
                best = sliding_argmin(grams, window - k + 1)
                text = owner(b.first)
                whole = np.flatnonzero(b.first[text[: len(best)] + 1] - np.arange(len(best)) >= window)
                if not len(whole):
                    continue
                chosen = best[whole]
                new = np.ones(len(whole), dtype=bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (whole[1:] != whole[:-1] + 1)
                begin = np.flatnonzero(new)
                lo, hi = whole[begin], whole[np.append(begin[1:], len(whole)) - 1]
                anchor = chosen[begin]
                shift = ((anchor - lo) * window + (hi - lo)).astype(np.uint64)
                node = words.of(lo, hi + window) + shift * np.uint64(0xD6E8FEB86659FD93)
                doc = text[lo]
                # a text that repeats itself has the same node several times in a row: one row with their number
                fresh = np.append(True, (node[1:] != node[:-1]) | (doc[1:] != doc[:-1]))
                heads = np.flatnonzero(fresh)
                times = np.diff(np.append(heads, len(node)))
                node, doc, lo, hi, anchor = node[heads], doc[heads], lo[heads], hi[heads], anchor[heads]
                last = np.append(doc[1:] != doc[:-1], True)
                base = b.first[doc]
                doc = doc + b.rows.start
                following = pa.array(np.append(node[1:], node[:1]).view(np.int64), mask=last)
                places = (pa.array(x.astype(np.int32)) for x in (lo - base, hi - base, times))
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(rows[doc]), _signed(grams[anchor]), _signed(node), following, *places], names=["id", "row", "anchor", "node", "next", "lo", "hi", "times"])

    return run


def _kmer_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, wanted = np.asarray(batch.column("id")), np.asarray(batch.column("row")), batch.column("ranges")
            for b in blocks(batch.column("text")):
                one, two = RangeHash(word_hashes(b)), RangeHash(span_hashes(b.data, b.starts, b.ends, seed=1), salt=1)
                for i in range(len(b.first) - 1):
                    r = b.rows.start + i
                    at = np.unique(np.concatenate([np.arange(p["lo"], p["hi"] + 1) for p in wanted[r].as_py()]))
                    start = at + b.first[i]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[r])), pa.array(np.full(len(at), rows[r])), pa.array(at.astype(np.int32)), _signed(one.of(start, start + window)), _signed(two.of(start, start + window))], names=["id", "row", "at", "k1", "k2"])

    return run


def _source_words(window: int, most: int = 1 << 21):
    """The words of the wanted k-mer ranges ``[lo, lo + n)`` of each text, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id, row, text, wanted in zip(*(batch.column(c) for c in ("id", "row", "text", "wanted")), strict=True):
                words, held, size = text.as_py().encode().split(), [], 0
                spans = wanted.as_py()
                for i, s in enumerate(spans):
                    held.append((id.as_py(), row.as_py(), s["lo"], s["n"], b" ".join(words[s["lo"] : s["lo"] + s["n"] + window - 1]).decode()))
                    size += len(held[-1][4])
                    if size > most or i + 1 == len(spans):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["source_id", "source_row", "source_lo", "n", "words"])
                        held, size = [], 0

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, kept = [], [], []
        for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = (text.as_py() or "").encode().split()
            total.append(len(words))
            if found.is_valid:
                stay = np.ones(len(words), dtype=bool)
                for s in found:
                    lo, n, same = s["lo"].as_py(), s["n"].as_py(), s["words"].as_py().encode().split()
                    for at in range(lo, lo + n * s["times"].as_py(), n):
                        if words[at : at + len(same)] == same:
                            stay[at : at + len(same)] = False
                words = [words[j] for j in np.flatnonzero(stay)]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def compacted_paths(nodes: DataFrame) -> DataFrame:
    """``node`` (the first one), ``source_id, source_row, source_lo, n`` of each path of repeated nodes without a branch.

    ``nodes(node, source: struct(id, row, lo, hi), last, copies, next0, next1, followed, times)``: its first place, its largest
    document, its number of places, the least and largest successor, the number of places that have one, and how often in a row it
    stands at most. A node that follows itself is a path of its own.
    """
    one_way = nodes.filter("followed = copies AND next0 = next1 AND times = 1").select(F.col("next0").alias("to"), F.col("copies").alias("many"))
    joined = nodes.filter("times = 1").join(one_way, (F.col("node") == F.col("to")) & (F.col("copies") == F.col("many"))).select(F.col("node").alias("into")).distinct()
    flagged = nodes.join(joined, F.col("node") == F.col("into"), "left").select("node", "source.*", F.col("into").isNull().alias("opens"))
    along = Window.partitionBy("id", "row").orderBy("lo")
    placed = flagged.withColumn("begin", F.last(F.when(F.col("opens"), F.col("lo")), ignorenulls=True).over(along))
    return placed.groupBy("id", "row", "begin").agg(F.min_by("node", "lo").alias("node"), (F.max("hi") - F.col("begin") + 1).alias("n")).select("node", F.col("id").alias("source_id"), F.col("row").alias("source_row"), F.col("begin").alias("source_lo"), "n")


def repeated_spans(texts: DataFrame, window: int = 50, k: int = ANCHOR_WORDS) -> DataFrame:
    """Ranges of k-mers of ``texts(id, row, text)`` that also start in a text of a smaller id, with their source.

    ``id, row, lo, n, times, source_id, source_row, source_lo``: the k-mers ``lo`` to ``lo + n - 1`` are those of the source from
    ``source_lo``, and so are the next ``n``, ``times`` times. Spans may overlap.
    """
    k = min(k, window)
    usable = texts.filter("id IS NOT NULL AND text IS NOT NULL")
    every = saved(usable.mapInArrow(_node_rows(window, k), _NODES), "nodes")
    anchors = every.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("node").alias("n0"), F.max("node").alias("n1"))
    anchors = saved(anchors.filter("most > least").select("anchor", F.expr("n0 <> n1").alias("branching")), "anchors")
    places = saved(every.join(anchors, "anchor").drop("anchor"), "places")
    kinds = places.groupBy("node").agg(
        F.min(F.struct("id", "row", "lo", "hi")).alias("source"), F.max("id").alias("last"), F.count("*").alias("copies"), F.min("next").alias("next0"), F.max("next").alias("next1"), F.count("next").alias("followed"), F.max("times").alias("times"), F.first("branching").alias("branching")
    )
    kinds = saved(kinds, "kinds")
    paths = saved(compacted_paths(kinds.filter(F.col("last") > F.col("source.id"))), "paths")
    copies = places.select("id", "row", "lo", "times", "node").join(paths.hint("merge"), "node").filter(F.col("id") > F.col("source_id")).select(_SPAN)
    # different nodes of one anchor, each opened where it first stands
    first = kinds.filter("branching").select("node", F.col("source.id").alias("first"))
    opened = places.filter("branching").join(first, "node").filter(F.col("id") == F.col("first")).groupBy("id", "row").agg(F.collect_set(F.struct("lo", F.expr("hi + (times - 1) * (hi - lo + 1)").alias("hi"))).alias("ranges"))
    kmers = saved(usable.join(opened.hint("shuffle_hash"), ["id", "row"]).mapInArrow(_kmer_rows(window), _KMERS).distinct(), "kmers")
    shared = saved(kmers.groupBy("k1", "k2").agg(F.min(F.struct("id", "row", "at")).alias("source"), F.max("id").alias("last")).filter(F.col("last") > F.col("source.id")).drop("last"), "shared")
    single = kmers.join(shared, ["k1", "k2"]).filter(F.col("id") > F.col("source.id")).select("id", "row", "at", F.col("source.id").alias("source_id"), F.col("source.row").alias("source_row"), F.col("source.at").alias("source_at"))
    line = ["id", "row", "source_id", "source_row", "shift"]
    single = single.withColumn("shift", F.col("at") - F.col("source_at")).withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(line).orderBy("at")))
    single = single.groupBy(*line, "run").agg(F.min("at").alias("lo"), F.count("*").cast("int").alias("n"), F.min("source_at").alias("source_lo"), F.lit(1).alias("times")).select(_SPAN)
    return copies.unionByName(single).distinct()


def substring_dedup(docs: DataFrame, window: int = 50, k: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove words covered by a window of words that also starts in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``. Returns ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space),
    one row for each row of ``docs``; other columns are ignored, whatever their names.

    Edge cases: a null or empty text has no words and kept text ``''``; a text of fewer than ``window`` words loses
    nothing; a row without an id neither loses words nor makes others lose them; rows that repeat an id are judged each
    by its own text and never against each other; an empty table gives an empty result; texts of any length are read
    whole. Repeats inside one document stay.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.select("id", F.xxhash64("id", "text").alias("row"), "text")
    spans = saved(repeated_spans(texts, window, k), "spans")
    wanted = spans.select("source_id", "source_row", F.col("source_lo").alias("lo"), "n").distinct().groupBy("source_id", "source_row").agg(F.collect_list(F.struct("lo", "n")).alias("wanted"))
    sources = texts.join(wanted.hint("shuffle_hash"), (F.col("id") == F.col("source_id")) & (F.col("row") == F.col("source_row"))).select("id", "row", "text", "wanted")
    words = sources.mapInArrow(_source_words(window), "source_id long, source_row long, source_lo int, n int, words string")
    words = saved(words.dropDuplicates(["source_id", "source_row", "source_lo", "n"]), "sources")
    found = spans.join(words, ["source_id", "source_row", "source_lo", "n"]).groupBy("id", "row").agg(F.collect_list(F.struct("lo", "n", "times", "words")).alias("spans"))
    marked = texts.alias("t").join(found.alias("s").hint("shuffle_hash"), (F.col("t.id") == F.col("s.id")) & (F.col("t.row") == F.col("s.row")), "left")
    marked = marked.select(F.col("t.id").alias("doc_id"), F.col("t.text").alias("text"), F.col("s.spans").alias("spans"))
    return marked.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
