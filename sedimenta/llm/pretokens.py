"""Byte-pair encoding of whole Arrow batches: a pre-token is encoded once per worker and looked up ever after."""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import tiktoken

from sedimenta.llm.words import hash_spans, raw

#: Folder of the public vocabularies and the rank file used; both are parameters of the operators.
TOKENIZERS = os.environ.get("SEDIMENTA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Splitting pattern of the rank files, as their documentation gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Slots of a worker's cache; it is emptied when half full, which costs time and never changes a result.
CACHE_BITS = 21

#: Bytes that may end, and bytes that may begin, a white-space character in UTF-8.
_SPACE_END, _SPACE_BEGIN = np.zeros(256, bool), np.zeros(256, bool)
for _table, _more in ((_SPACE_END, [*range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]), (_SPACE_BEGIN, [0xC2, 0xE1, 0xE2, 0xE3])):
    _table[[*range(9, 14), *range(28, 33), *_more]] = True


def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def worker_encoding(folder: str, vocabulary: str) -> tiktoken.Encoding:
    """The encoding, built once in each Python worker."""
    if (folder, vocabulary) not in _encodings:
        _encodings[folder, vocabulary] = encoding(folder, vocabulary)
    return _encodings[folder, vocabulary]


class HashTable:
    """Open addressing with linear probing: two 64-bit hashes of a key -> non-negative int."""

    def __init__(self, bits: int):
        self.bits, self.used = bits, 0
        self.key, self.check = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.value = np.full(1 << bits, -1, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where absent."""
        out = np.full(len(h), -1, np.int32)
        todo, slot = np.arange(len(h)), self._slot(h)
        while len(todo):
            value = self.value[slot]
            same = (self.key[slot] == h[todo]) & (self.check[slot] == c[todo]) & (value >= 0)
            out[todo[same]] = value[same]
            on = ~same & (value >= 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, c: np.ndarray, value: np.ndarray) -> None:
        """Stores distinct keys that are absent; the caller keeps the table at most half full."""
        todo, slot = np.arange(len(h)), self._slot(h)
        while len(todo):
            free = np.flatnonzero(self.value[slot] < 0)
            take, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.key[take], self.check[take], self.value[take] = h[todo[won]], c[todo[won]], value[todo[won]]
            on = np.ones(len(todo), bool)
            on[won] = False
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        self.used += len(h)


def pretokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, starts and ends of the pre-tokens, and the offsets of the rows in them.

    A pre-token begins at the start of a text and at each space. The pattern never matches across such a place
    unless the space lies inside a run of white space; a text with such a space is one pre-token as a whole.
    """
    data, offsets = raw(column)
    n = len(data)
    space = np.flatnonzero(data == 32)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    begins[n] = False
    after = np.minimum(space + 1, n - 1) if n else space
    bad = space[_SPACE_END[data[space - 1]] & ~begins[space] & (edge[space + 1] | _SPACE_BEGIN[data[after]])]
    if len(bad):
        whole = np.zeros(len(offsets), bool)
        whole[np.searchsorted(offsets, bad, "right") - 1] = True
        space = space[~whole[np.searchsorted(offsets, space, "right") - 1]]
    begins[space] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n)
    return data, start, end, np.searchsorted(start, offsets)


def _first_of_each(h: np.ndarray) -> np.ndarray:
    """A position of each distinct value."""
    order = np.argsort(h)
    sorted_ = h[order]
    return order[np.concatenate([[True], sorted_[1:] != sorted_[:-1]])]


class PreTokenizer:
    """Token ids of pre-tokens, kept in a bounded cache of one worker."""

    def __init__(self, enc: tiktoken.Encoding, bits: int = CACHE_BITS):
        self.enc, self.bits = enc, bits
        self._empty()

    def _empty(self) -> None:
        self.table = HashTable(self.bits)
        self.ids, self.filled = np.zeros(1 << self.bits, np.uint16), 0
        self.begin, self.size = np.zeros((1 << self.bits) // 2 + 1, np.int64), np.zeros((1 << self.bits) // 2 + 1, np.int64)

    def _room(self, coming: int) -> None:
        """Empties the cache before it would be more than half full; one batch may need a larger table for itself."""
        if self.table.used + coming > (1 << self.bits) // 2:
            self.bits = max(self.bits, int(2 * coming).bit_length())
            self._empty()

    def _store(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, c: np.ndarray) -> None:
        at = self.table.used
        encode = self.enc.encode_ordinary
        found = [encode(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(start.tolist(), end.tolist())]
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = int(size.sum())
        if self.filled + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), np.uint16)])
        flat = [i for ids in found for i in ids]
        self.ids[self.filled : self.filled + total] = flat
        self.begin[at : at + len(h)] = self.filled + np.cumsum(size) - size
        self.size[at : at + len(h)] = size
        self.filled += total
        self.table.add(h, c, np.arange(at, at + len(h), dtype=np.int32))

    def entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Cache entry of each pre-token, encoding those that the cache lacks."""
        at = self.table.find(h, c)
        new = np.flatnonzero(at < 0)
        if len(new):
            first = new[_first_of_each(h[new])]
            if self.table.used + len(first) > (1 << self.bits) // 2:
                # All of this batch must be in the table at once.
                first = _first_of_each(h)
                self._room(len(first))
                new = np.arange(len(h))
            self._store(data, start[first], end[first], h[first], c[first])
            at[new] = self.table.find(h[new], c[new])
        return at

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows and the offsets of the rows in them."""
        data, start, end, offsets = pretokens(column)
        h, c = hash_spans(data, start, end), hash_spans(data, start, end, 1)
        at = self.entries(data, start, end, h, c)
        size = self.size[at]
        before = np.concatenate([[0], np.cumsum(size)])
        flat = np.repeat(self.begin[at] - before[:-1], size) + np.arange(before[-1])
        return self.ids[flat], before[offsets]


_tokenizers: dict[tuple[str, str], PreTokenizer] = {}


def worker_tokenizer(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> PreTokenizer:
    """The tokenizer with its cache, one in each Python worker."""
    if (folder, vocabulary) not in _tokenizers:
        _tokenizers[folder, vocabulary] = PreTokenizer(worker_encoding(folder, vocabulary))
    return _tokenizers[folder, vocabulary]
