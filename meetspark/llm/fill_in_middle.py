"""Fill-in-the-middle: texts cut in three at code points and written with their middle last.

A cut is a number of code points, a text is UTF-8 bytes. The places where code points begin are kept as a set in the manner of
Roaring bitmaps: one container for each 65,536 bytes, stored as a sorted array, a bitmap or runs, whichever is smallest, with
cumulative cardinalities. Both cuts of a text are ``select`` questions: the container is found in the cumulative counts, then the
place within it. Plain ASCII is one run for a container, scripts of two or three bytes are bitmaps, so the set never
takes more than about an eighth of the text, and one set serves all texts of a block of a few MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
BLOCK_BYTES = 1 << 21
CHUNK = 1 << 16
_MOST_IN_ARRAY = 4096


class _Array:
    """The sorted members themselves."""

    def __init__(self, at: np.ndarray):
        self.at = at.astype(np.uint16)

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.at[k].astype(np.int64)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, x.astype(np.uint32), "left")


class _Runs:
    """First member of each run of consecutive members, and the members before it."""

    def __init__(self, heads: np.ndarray, sizes: np.ndarray):
        self.heads, self.before = heads.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])

    def select(self, k: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, k, "right") - 1
        return self.heads[run] + k - self.before[run]

    def rank(self, x: np.ndarray) -> np.ndarray:
        run = np.maximum(np.searchsorted(self.heads, x, "right") - 1, 0)
        inside = np.clip(x - self.heads[run], 0, self.before[run + 1] - self.before[run])
        return self.before[run] + inside


class _Bitmap:
    """A bit for each place in words of 64, and the members before each word."""

    def __init__(self, member: np.ndarray):
        padded = np.zeros(CHUNK, dtype=bool)
        padded[: len(member)] = member
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def _bits(self, word: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")

    def select(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, k, "right") - 1
        found = np.cumsum(self._bits(word), axis=1, dtype=np.int64) == (k - self.before[word] + 1)[:, None]
        return 64 * word + found.argmax(axis=1)

    def rank(self, x: np.ndarray) -> np.ndarray:
        word = x >> 6
        below = np.arange(64) < (x & 63)[:, None]
        return self.before[word] + (self._bits(word) * below).sum(axis=1)


class BoundarySet:
    """The places in UTF-8 bytes where code points begin."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        self.containers, counts = [], []
        for start in range(0, len(data), CHUNK):
            member = (data[start : start + CHUNK] & 0xC0) != 0x80
            edge = np.flatnonzero(np.diff(member.view(np.int8), prepend=0, append=0))
            heads, sizes = edge[::2], edge[1::2] - edge[::2]
            count = int(sizes.sum())
            if 2 + 4 * len(heads) < min(2 * count, CHUNK // 8):
                container = _Runs(heads, sizes)
            elif count <= _MOST_IN_ARRAY:
                container = _Array(np.flatnonzero(member))
            else:
                container = _Bitmap(member)
            self.containers.append(container)
            counts.append(count)
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)

    def _each(self, which: np.ndarray, ask: np.ndarray, how: str) -> np.ndarray:
        out = np.zeros(len(ask), dtype=np.int64)
        order = np.argsort(which, kind="stable")
        heads = np.flatnonzero(np.diff(which[order], prepend=-1))
        for rows in np.split(order, heads[1:]) if len(order) else ():
            out[rows] = getattr(self.containers[which[rows[0]]], how)(ask[rows])
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte offset of the k-th code point, counted from 0; of the number of code points, the end of the bytes."""
        out = np.full(len(k), self.size, dtype=np.int64)
        some = np.flatnonzero(k < self.before[-1])
        which = np.searchsorted(self.before, k[some], "right") - 1
        out[some] = CHUNK * which + self._each(which, k[some] - self.before[which], "select")
        return out

    def rank(self, offset: np.ndarray) -> np.ndarray:
        """Code points that begin before a byte offset."""
        out = np.full(len(offset), self.before[-1], dtype=np.int64)
        some = np.flatnonzero(offset < self.size)
        which = offset[some] >> 16
        out[some] = self.before[which] + self._each(which, offset[some] & (CHUNK - 1), "rank")
        return out


def _transform(plain_from: int, spm_below: int):
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def block(ids: pa.Array, hashes: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        places = BoundarySet(data)
        begins = places.rank(offsets)
        n = np.diff(begins)
        one, two = hashes[0] % (n + 1), hashes[1] % (n + 1)
        low, high = np.minimum(one, two), np.maximum(one, two)
        cuts = places.select(np.concatenate([begins[:-1] + low, begins[:-1] + high])).reshape(2, -1)
        forms, outputs = [], []
        for i in range(len(n)):
            start, stop = offsets[i], offsets[i + 1]
            text = data[start:stop].tobytes()
            if not text or hashes[2][i] % 100 >= plain_from or p in text or s in text or m in text:
                forms.append("plain")
                outputs.append(text)
                continue
            a, b = cuts[0, i] - start, cuts[1, i] - start
            spm = hashes[3][i] % 100 < spm_below
            forms.append("spm" if spm else "psm")
            outputs.append(b"".join((s, text[b:], p, text[:a], m, text[a:b]) if spm else (p, text[:a], s, text[b:], m, text[a:b])))
        plain = np.array([f == "plain" for f in forms], dtype=bool)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n), pa.array(forms, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            hashes = [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
            row, rows = 0, len(offsets) - 1
            while row < rows:
                stop = min(rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1))
                yield block(batch.column("doc_id").slice(row, stop - row), [h[row:stop] for h in hashes], data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
                row = stop

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each row of ``docs(doc_id, text)``; n counts code points.

    The first four groups of eight hex digits of the sha256 of ``seed:doc_id`` decide on a row: two cuts, plain or not, the order
    of the parts. A text that contains a sentinel stays plain, so ``restored`` is always exact. Rows are independent of each other: no
    shuffle, and memory is bounded by a batch of texts and a block's output.

    A null text counts as empty, an empty one is plain; a row without an id is hashed as ``seed:`` alone; repeated rows come out
    repeated and equal; equal cuts give an empty middle; an empty table gives an empty result; extra columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), digest.alias("digest")).select("doc_id", "text", *hashes)
    return rows.mapInArrow(_transform(plain_from, spm_below), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form"):
    """The text of an output, as a column expression: the parts between the sentinels, put in their order."""
    part = lambda i: F.get(F.split(F.col(output), "<[PSM]>"), F.lit(i))  # noqa: E731  the first part is empty
    return F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).when(F.col(form) == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col(output))
