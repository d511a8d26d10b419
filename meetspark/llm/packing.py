"""Mixture-controlled packing of token streams by deficit round-robin over source queues.

Each source is a queue of tokens: its documents one after the other, dealt out in quanta. In every round a queue is credited its
share of a window; it is served a quantum when its credit has grown to one, and what is left is carried on as a deficit. So the
round of a queue's j-th quantum is a closed formula of j, the queue's total and the sum of all, a row that any partition can
compute. The quanta in order of round and source are the served stream: their places are running sums over slices of rounds, found by
joins, and windows are cut every ``window`` tokens of it, so all but the last are full. Deficits are carried over windows and
partitions by arithmetic, not by state; nothing is held for all sources anywhere.

With weights other than the natural ones, a queue's share is its weight; queues run dry one after the other, and the others go on in
their proportions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import running
from .storage import saved
from .tokens import encoder_of
from .words import blocks

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
ROWS_PER_BLOCK = 1_000
BLOCKS_PER_GROUP = 1_000
QUANTUM = 512  # tokens; at any place in the stream a queue has had its share of it but for a quantum and a round
ROUNDS_PER_SLICE = 1_000


def _tokens(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, END_ID)
        for batch in batches:
            for b in blocks(batch.column("text")):
                ids, n = encoder.encode(b)
                part = batch.slice(b.rows.start, b.rows.stop - b.rows.start)
                ends = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
                column = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(n), column], names=["doc_id", "source", "n", "ids"])

    return run


def cut_windows(row: np.ndarray, at: np.ndarray, size: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Stretches of texts (row, start in the row, length, place in the stream), in order of row and start, with neighbours joined that are
    neighbours in the stream too, and cut at the edges of windows."""
    join = np.zeros(len(row), dtype=bool)
    join[1:] = (row[1:] == row[:-1]) & (place[1:] == place[:-1] + size[:-1])
    head = np.flatnonzero(~join)
    size = np.add.reduceat(size, head)
    row, at, place = row[head], at[head], place[head]
    n = (place + size - 1) // window - place // window + 1
    i = np.repeat(np.arange(len(row)), n)
    nth = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    cut = (place[i] // window + nth) * window
    begin, end = np.maximum(place[i], cut), np.minimum(place[i] + size[i], cut + window)
    return row[i], at[i] + begin - place[i], end - begin, begin


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _cut(window: int, quantum: int, width: int):
    kind = {2: np.uint16, 4: np.uint32}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                begin, n = (np.asarray(part.column(c)).astype(np.int64) for c in ("begin", "n"))
                served = part.column("served")
                own = np.repeat(np.arange(len(part)), np.asarray(served.value_lengths()).astype(np.int64))
                j, place = (np.asarray(served.flatten().field(c)).astype(np.int64) for c in ("j", "place"))
                low, high = np.maximum(j * quantum, begin[own]), np.minimum((j + 1) * quantum, (begin + n)[own])
                row, at, size, place = cut_windows(own, low - begin[own], high - low, place + low - j * quantum, window)
                crc, held, ids = np.zeros(len(row), dtype=np.int64), -1, b""
                for i in range(len(row)):
                    if row[i] != held:
                        held, ids = row[i], memoryview(np.frombuffer(part.column("ids")[int(row[i])].as_py(), kind).astype("<u4").tobytes())
                    crc[i] = zlib.crc32(ids[4 * at[i] : 4 * (at[i] + size[i])])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), pa.array(at), pa.array(size), pa.array(crc), pa.array(n[row]), pa.array(place // window), pa.array(place % window), part.column("source").take(take)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return run


def pack(docs: DataFrame, window: int = 2048, weights: dict[str, float] | None = None, quantum: int = QUANTUM, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack all documents into windows of ``window`` tokens, served in the target proportions of the sources.

    ``docs`` has ``doc_id, text, source``; each document's ids end with id 1. ``weights`` are target shares by source
    (missing ones: 1); None means the natural shares. Returns a row for each piece: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, source``. Windows are full but for the last. Every source has a queue of its own,
    whatever their number. In any stretch of the stream each queue that is not dry has its share but for ``quantum`` tokens and what a
    round gives it; a smaller quantum mixes finer and cuts more pieces.

    Edge cases: a null or empty text is one token; a null source is a queue of its own; repeated rows are packed each; rows
    without an id are packed with a null id; an empty table gives an empty result; extra columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").alias("text"))
    tokens = texts.mapInArrow(_tokens(vocabulary), "doc_id long, source string, n long, ids binary")
    tokens = saved(tokens.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    width = encoder_of(vocabulary, END_ID).dtype.itemsize
    block = F.pmod(F.xxhash64("uid"), F.lit(max(1, tokens.count() // ROWS_PER_BLOCK)))
    sizes = tokens.select("uid", "doc_id", "n", "source", block.alias("block"))
    parts = saved(sizes.groupBy("source", "block").agg(F.sum("n").alias("n")).withColumn("group", F.expr(f"block div {BLOCKS_PER_GROUP}")), "blocks")
    # tokens ahead of a block in its queue: those of the groups of blocks before, then those of the blocks before in its group
    groups = parts.groupBy("source", "group").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("source")
    groups = groups.select("source", "group", (F.sum("n").over(whole.orderBy("group")) - F.col("n")).alias("ahead_of_group"), F.sum("n").over(whole).alias("total"))
    ahead = parts.select("source", "group", "block", (F.sum("n").over(Window.partitionBy("source", "group").orderBy("block")) - F.col("n")).alias("in_group"))
    ahead = ahead.join(groups, ["source", "group"]).select("source", "block", (F.col("ahead_of_group") + F.col("in_group")).alias("ahead"), "total")
    inside = Window.partitionBy("source", "block").orderBy("doc_id", "uid")
    placed = sizes.withColumn("inside", F.sum("n").over(inside) - F.col("n")).join(ahead, ["source", "block"])
    placed = saved(placed.select("uid", "source", "n", (F.col("ahead") + F.col("inside")).alias("begin"), "total"), "placed")
    # the weight of a queue, and of all
    weight = F.col("total").cast("double") if weights is None else F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("source")), F.lit(1.0)).cast("double") if weights else F.lit(1.0)
    every = parts.groupBy("source").agg(F.sum("n").alias("total")).agg(F.sum(weight)).first()[0] or 1.0
    # the quanta that a document's tokens are in; each is served in the round that brings its queue's credit to its end
    asked = placed.select("uid", "source", "total", F.explode(F.expr(f"sequence(begin div {quantum}, (begin + n - 1) div {quantum})")).alias("j"))
    quanta = asked.groupBy("source", "j").agg(F.first("total").alias("total"))
    end = F.least((F.col("j") + 1) * quantum, "total")
    quanta = quanta.select(F.lit(0).alias("all"), "source", "j", (end - F.col("j") * quantum).alias("size"), (F.ceil(end * (every / window) / weight) - 1).cast("long").alias("round"))
    served = running(quanta, ["round", "source", "j"], {"through": ("sum", F.col("size"))}, at="round", width=ROUNDS_PER_SLICE, key="all")
    served = served.select("source", "j", (F.col("through") - F.col("size")).alias("place"))
    lists = asked.select("uid", "source", "j").join(served, ["source", "j"]).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("j", "place"))).alias("served"))
    ready = tokens.join(lists.join(placed.select("uid", "begin"), "uid").hint("shuffle_hash"), "uid").select("doc_id", "source", "n", "ids", "begin", "served")
    return ready.mapInArrow(_cut(window, quantum, width), _PIECES)
