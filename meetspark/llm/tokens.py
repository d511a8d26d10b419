"""Token ids of texts, a block of texts at a time.

The vocabulary's pre-tokenizer lower-cases, drops white space and keeps apart runs of letters, single digits and runs of other
characters, so no token reaches over such a border. A text is therefore cut into *units* at white space and between ASCII or
Latin-1 letters, ASCII digits and ASCII punctuation; the apostrophe (contractions) and all other characters never make a
border, so what is not plainly a border stays inside a unit. Each different unit of a block is encoded once, plain ones lower-cased
and many at a time, and its ids are copied to all its places by array operations. Units are told apart by 128-bit hashes.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .words import Block, span_hashes

_SPACE, _LETTER, _DIGIT, _PUNCTUATION, _OTHER = range(5)
_END_OF_WORD = "</w>"


def _kinds() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for code in range(0x21, 0x7F):
        c = chr(code)
        out[code] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _OTHER if c == "'" else _PUNCTUATION
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    return out


_KIND = _kinds()


class Encoder:
    """Encodes blocks of texts; up to ``most`` units stay known from block to block."""

    def __init__(self, vocabulary: str, end_id: int, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if max(names.values()) < 1 << 16 else np.uint32)
        self.closes = np.zeros(max(names.values()) + 1, dtype=bool)
        self.closes[[i for name, i in names.items() if name.endswith(_END_OF_WORD)]] = True
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self.end_id, self.most = end_id, most
        self._forget()

    def _forget(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, one after the other, and how many each text has; every text ends with the end id."""
        texts = len(block.offsets) - 1
        starts, ends, plain, data = self._units(block)
        key, check = (self._hash(block.data, data, starts, ends, plain, seed) for seed in (0, 1))
        distinct, first, own = np.unique(key, return_index=True, return_inverse=True)
        odd = np.flatnonzero(check != check[first][own])  # a key that two different units share
        if len(self.key) + len(distinct) > self.most:
            self._forget()
        at, size = self._known(distinct, check[first], data, block.data, starts[first], ends[first], plain[first])
        at, size = at[own], size[own]
        if len(odd):
            ids, size[odd] = self._single([block.data[s:e].tobytes() for s, e in zip(starts[odd], ends[odd], strict=True)])
            at[odd] = len(self.pool) + np.cumsum(size[odd]) - size[odd]
            pool = np.concatenate([self.pool, ids])
        else:
            pool = self.pool
        before = np.concatenate([[0], np.cumsum(size)])
        total = int(before[-1])
        found = pool[np.repeat(at - before[:-1], size) + np.arange(total)]
        count = np.diff(before[np.searchsorted(starts, block.offsets)])
        out = np.full(total + texts, self.end_id, self.dtype)
        out[np.arange(total) + np.repeat(np.arange(texts), count)] = found
        return out, count + 1

    def _units(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units, whether each is plain (one pre-token), and the bytes with plain letters lower-cased."""
        data = block.data
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # all of Latin-1 from U+00C0 but two signs
        kind[lead] = kind[lead + 1] = _LETTER
        if self.special is not None:
            for m in self.special.finditer(data.tobytes()):
                kind[m.start() : m.end()] = _OTHER
        lower = data.copy()
        lower[(data >= 0x41) & (data <= 0x5A)] += 0x20
        upper = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E)] + 1
        lower[upper] += 0x20
        word = kind != _SPACE
        opens = word.copy()
        if len(data):
            left, right = kind[:-1], kind[1:]
            border = (left != right) & (left != _OTHER) & (right != _OTHER) | (left == _DIGIT) & (right == _DIGIT)
            opens[1:] &= border | (left == _SPACE)
            heads = block.offsets[:-1][block.offsets[:-1] < block.offsets[1:]]
            opens[heads] = word[heads]
        starts = np.flatnonzero(opens)
        closes = np.concatenate([opens[1:] | ~word[1:], [True]]) & word if len(data) else word
        ends = np.flatnonzero(closes) + 1
        others = np.concatenate([[0], np.cumsum(kind == _OTHER)])
        return starts, ends, others[ends] == others[starts], lower

    @staticmethod
    def _hash(raw: np.ndarray, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray, seed: int) -> np.ndarray:
        out = span_hashes(lower, starts, ends, seed)
        rest = np.flatnonzero(~plain)
        if len(rest):
            out[rest] = span_hashes(raw, starts[rest], ends[rest], seed)
        return out

    def _known(self, key, check, lower, raw, starts, ends, plain) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of different units are in the pool, and how many; unknown ones are encoded and added."""
        place = np.searchsorted(self.key, key)
        inside = np.minimum(place, max(0, len(self.key) - 1))
        held = self.key[inside] == key if len(self.key) else np.zeros(len(key), dtype=bool)
        hit = held.copy()
        hit[held] = self.check[inside[held]] == check[held]
        new = np.flatnonzero(~hit)
        at, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        at[hit], size[hit] = self.at[inside[hit]], self.size[inside[hit]]
        if not len(new):
            return at, size
        some, rest = new[plain[new]], new[~plain[new]]
        parts = [self._joined([lower[s:e].tobytes() for s, e in zip(starts[some], ends[some], strict=True)]), self._single([raw[s:e].tobytes() for s, e in zip(starts[rest], ends[rest], strict=True)])]
        new = np.concatenate([some, rest])
        size[new] = np.concatenate([sizes for _, sizes in parts])
        at[new] = len(self.pool) + np.cumsum(size[new]) - size[new]
        self.pool = np.concatenate([self.pool, *(ids for ids, _ in parts)])
        fresh = new[~held[new]]  # a key held for another unit stays with that one
        order = np.argsort(np.concatenate([self.key, key[fresh]]), kind="stable")
        for name, more in (("key", key[fresh]), ("check", check[fresh]), ("at", at[fresh]), ("size", size[fresh])):
            setattr(self, name, np.concatenate([getattr(self, name), more])[order])
        return at, size

    def _joined(self, units: list[bytes], at_once: int = 1_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain units and how many each has: each is one pre-token, which the id of an end of word closes."""
        out = [(np.zeros(0, self.dtype), np.zeros(0, np.int64))]
        parts = [units[i : i + at_once] for i in range(0, len(units), at_once)]
        for i in range(0, len(parts), 16):
            some = parts[i : i + 16]
            encoded = self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in some], add_special_tokens=False)
            for part, e in zip(some, encoded, strict=True):
                ids = np.array(e.ids, self.dtype)
                stops = np.flatnonzero(self.closes[ids]) + 1
                whole = len(stops) == len(part) and stops[-1] == len(ids)
                out.append((ids, np.diff(stops, prepend=0)) if whole else self._single(part))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _single(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any units, each encoded alone."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)] if units else []
        return np.array([i for x in ids for i in x], self.dtype), np.fromiter(map(len, ids), np.int64, len(ids))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(vocabulary: str, end_id: int) -> Encoder:
    """The process's encoder of a vocabulary: loading one takes a moment, and tasks follow each other in one Python worker."""
    if (vocabulary, end_id) not in _ENCODERS:
        _ENCODERS[vocabulary, end_id] = Encoder(vocabulary, end_id)
    return _ENCODERS[vocabulary, end_id]
