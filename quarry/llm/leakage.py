"""Passages of evaluation items inside documents: SimHash windows, multi-index blocks, exact verification.

Every window of ``window`` consecutive words of every item and every document gets a 64-bit SimHash of
its words. A fingerprint within ``radius`` bits of another shares at least one of ``radius + 1`` disjoint
blocks of bits with it, so looking up each block finds every such pair. Candidates are verified by the
weighted Jaccard similarity of their five-word shingles, a shingle weighing one over the number of items it
occurs in; of those whose shingles are all the same an exact check tells whether the words are in one order.

Equal fingerprints of a batch of documents and of the items are looked up once, and equal windows are
verified once, however often they repeat. Items are the stated query set: they are read in blocks of a
bounded number of words, each broadcast and held against all documents. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, RADIUS, SHINGLE = 16, 3, 5
#: Words of items in one broadcast block: some 120 MB with fingerprints and tables.
BLOCK_WORDS = 2_000_000
#: Words of documents handled at once.
BATCH_WORDS = 60_000

#: A maximal run of letters or digits; an underscore separates.
WORD = re.compile(r"[^\W_]+")
_BIT = np.arange(64, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word to its 64-bit hash without letter case."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.casefold().encode("utf-8", "surrogatepass"))
        if len(self) < 1_000_000:
            self[word] = value
        return value


def word_hashes(text: str | None, known: _Hashes) -> np.ndarray:
    return np.array([known[w] for w in WORD.findall(text or "")], np.uint64)


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two vertical counters: the planes are the binary digits of 64 counts a word."""
    out, carry = [], None
    for k in range(max(len(a), len(b))):
        x, y = a[k] if k < len(a) else None, b[k] if k < len(b) else None
        if x is None or y is None:
            x = y if x is None else x
            out.append(x if carry is None else x ^ carry)
            carry = None if carry is None else x & carry
        else:
            both = x ^ y
            out.append(both if carry is None else both ^ carry)
            carry = x & y if carry is None else (x & y) | (both & carry)
    return out if carry is None else [*out, carry]


def fingerprints(words: np.ndarray, window: int, block: int = BATCH_WORDS) -> np.ndarray:
    """The SimHash of every window of consecutive words (first at index 0); a text of any length is taken in blocks.

    A bit is set where more than half of the window's words have it. The counts of all 64 bits are added at once,
    for windows of 1, 2, 4, ... words, and those that make up the window.
    """
    count = len(words) - window + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(count, np.uint64)
    for start in range(0, count, block):
        part = words[start : start + block + window - 1]
        size = len(part) - window + 1
        total: list[np.ndarray] = []
        planes, width, at = [part], 1, 0
        while width <= window:
            if window & width:
                piece = [p[at : at + size] for p in planes]
                total = _added(total, piece) if total else piece
                at += width
            if 2 * width <= window:
                held = len(planes[0]) - width
                planes = _added([p[:held] for p in planes], [p[width : width + held] for p in planes])
            width *= 2
        # More than half: compare the counts, digit by digit from the highest, with the half rounded down.
        half = window // 2
        above, equal = np.zeros(size, np.uint64), np.full(size, ~np.uint64(0))
        for k in range(max(len(total), half.bit_length()) - 1, -1, -1):
            digit = total[k] if k < len(total) else np.zeros(size, np.uint64)
            if half >> k & 1:
                equal &= digit
            else:
                above |= equal & digit
                equal &= ~digit
        out[start : start + size] = above
    return out


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The hash of every run of ``size`` words (first at index 0)."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    mixed = np.zeros(count, np.uint64)
    for k in range(size):
        mixed = (mixed * _MIX) ^ words[k : k + count]
        mixed ^= mixed >> np.uint64(29)
    return mixed


class ItemIndex:
    """Block tables over the windows of one block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int, radius: int):
        self.window, self.radius = window, radius
        known = _Hashes()
        texts = [word_hashes(t, known) for _, t in items]
        self.words = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        starts = np.cumsum([0, *map(len, texts)])
        at = [np.arange(s, max(s, s + len(t) - window + 1)) for s, t in zip(starts, texts, strict=False)]
        self.start = np.concatenate(at) if at else np.empty(0, np.int64)
        self.item = np.repeat(np.array([i for i, _ in items], np.int64), [len(a) for a in at])
        prints = [fingerprints(t, window) for t in texts]
        self.print = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        # Equal fingerprints are listed once; ``member`` has their windows one after the other.
        self.value, at = np.unique(self.print, return_inverse=True)
        self.member = np.argsort(at, kind="stable").astype(np.int32)
        self.first = np.searchsorted(at[self.member], np.arange(len(self.value) + 1))
        # Windows of the same words are one text, verified once.
        self.text = _same_rows(self.words, self.start, window)
        owned, self._owner_n = np.unique(np.stack([self.text, self.item.view(np.uint64)]), axis=1, return_counts=True)
        self._owner_text, self._owner_item = owned[0], owned[1].view(np.int64)
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            keys = self._key(self.value, low, high)
            order = np.argsort(keys, kind="stable").astype(np.int32)
            self.blocks.append((low, high, order, keys[order]))
        parts = [np.unique(shingles(t)) for t in texts]
        self.shingle, frequency = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, int))
        self.weight = 1.0 / frequency

    def owners(self, text: np.uint64) -> list[tuple[int, int]]:
        """(item, number of places) of the items with a window of this text."""
        lo, hi = np.searchsorted(self._owner_text, text, "left"), np.searchsorted(self._owner_text, text, "right")
        return list(zip(self._owner_item[lo:hi].tolist(), self._owner_n[lo:hi].tolist(), strict=True))

    @staticmethod
    def _key(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return (prints >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``prints``, place in ``value``) of all pairs of fingerprints within the radius, each pair once; ``prints`` has no repeats."""
        found = []
        for low, high, order, keys in self.blocks:
            own = self._key(prints, low, high)
            begin, end = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            hits = np.flatnonzero(end > begin)
            for part in np.array_split(hits, max(1, int((end - begin).sum() // 2_000_000) + 1)):
                size = end[part] - begin[part]
                mine = np.repeat(part, size)
                theirs = order[np.repeat(begin[part] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                close = np.bitwise_count(prints[mine] ^ self.value[theirs]) <= self.radius
                found.append(np.stack([mine[close], theirs[close].astype(np.int64)]))
        both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
        return both[0], both[1]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document window, item window) of all pairs of fingerprints within the radius, each pair once."""
        values, at = np.unique(prints, return_inverse=True)
        mine, theirs = self.near(values)
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(values) + 1))
        a, b = _crossed(first, order, mine, self.first, self.member, theirs)
        return a, b

    def _weights(self, values: np.ndarray) -> np.ndarray:
        if not len(self.shingle):
            return np.ones(values.shape)
        at = np.minimum(np.searchsorted(self.shingle, values), len(self.shingle) - 1)
        return np.where(self.shingle[at] == values, self.weight[at], 1.0)

    def verify(self, words: np.ndarray, starts: np.ndarray, item_windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(similarity, equal) of document windows beginning at ``starts`` and item windows, by their weighted shingles."""
        span = np.arange(self.window)
        similarity, equal = np.zeros(len(starts)), np.zeros(len(starts), bool)
        for begin in range(0, len(starts), 100_000):
            part = slice(begin, begin + 100_000)
            mine, theirs = words[starts[part][:, None] + span], self.words[self.start[item_windows[part]][:, None] + span]
            a, b = _row_sets(mine), _row_sets(theirs)
            weight_a, weight_b = self._weights(a), self._weights(b)
            weight_a[:, 1:][a[:, 1:] == a[:, :-1]] = 0
            weight_b[:, 1:][b[:, 1:] == b[:, :-1]] = 0
            both = np.zeros(len(a))
            for k in range(b.shape[1]):
                both += weight_b[:, k] * (a == b[:, k : k + 1]).any(axis=1)
            union = weight_a.sum(axis=1) + weight_b.sum(axis=1) - both
            similarity[part] = np.where(union > 0, both / np.where(union > 0, union, 1), (mine == theirs).all(axis=1))
            equal[part] = (similarity[part] >= 1 - 1e-9) & (mine == theirs).all(axis=1)
        return similarity, equal


def _row_sets(windows: np.ndarray) -> np.ndarray:
    """The sorted shingles of each window (a row of word hashes)."""
    size = min(SHINGLE, windows.shape[1])
    mixed = np.zeros((len(windows), windows.shape[1] - size + 1), np.uint64)
    for k in range(size):
        mixed = (mixed * _MIX) ^ windows[:, k : k + mixed.shape[1]]
        mixed ^= mixed >> np.uint64(29)
    return np.sort(mixed, axis=1)


def _same_rows(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A number for each window, equal for windows of the same words, by a hash of 64 bits of the sequence."""
    mixed = np.zeros(len(starts), np.uint64)
    for k in range(window):
        mixed = (mixed ^ words[starts + k]) * _MIX
        mixed ^= mixed >> np.uint64(31)
    return mixed


def _crossed(first_a: np.ndarray, order_a: np.ndarray, a: np.ndarray, first_b: np.ndarray, order_b: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of the groups (a, b): group g has ``order[first[g]:first[g + 1]]``."""
    na, nb = first_a[a + 1] - first_a[a], first_b[b + 1] - first_b[b]
    total = na * nb
    row = np.repeat(np.arange(len(a)), total)
    place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return order_a[first_a[a][row] + place // nb[row]], order_b[first_b[b][row] + place % nb[row]]


def _search(indexes: list[ItemIndex], batches: Iterator[pa.RecordBatch], min_similarity: float) -> Iterator[pa.RecordBatch]:
    known = _Hashes()

    def flush(index: ItemIndex, ids: list[int], texts: list[np.ndarray]) -> pa.RecordBatch | None:
        lengths = np.array([len(t) for t in texts])
        words = np.concatenate(texts)
        prints = fingerprints(words, index.window)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(ids)), lengths)[: len(prints)]
        inside = np.arange(len(prints)) + index.window <= ends[owner]
        starts = np.flatnonzero(inside)
        # One entry for each different window of the batch and of the block of items, with how often it occurs where.
        texts_of, own_first, own = np.unique(_same_rows(words, starts, index.window), return_index=True, return_inverse=True)
        mine, theirs = index.candidates(prints[starts[own_first]])
        pairs, first = np.unique(np.stack([mine.astype(np.uint64), index.text[theirs]]), axis=1, return_index=True)
        similarity, equal = index.verify(words, starts[own_first[mine[first]]], theirs[first])
        keep = np.flatnonzero(similarity >= min_similarity)
        if not len(keep):
            return None
        # (window text of the batch, document) and (window text of the items, item), each with its number of places.
        doc_text, doc_n = np.unique(np.stack([own, owner[starts]]), axis=1, return_counts=True)
        rows: dict[tuple[int, int], list] = {}
        for k in keep.tolist():
            at, text = int(pairs[0, k]), pairs[1, k]
            lo, hi = np.searchsorted(doc_text[0], [at, at + 1])
            for document, n in zip(doc_text[1, lo:hi].tolist(), doc_n[lo:hi].tolist(), strict=True):
                for item, m in index.owners(text):
                    row = rows.setdefault((ids[document], item), [0, 0, 0.0])
                    row[0] += n * m
                    row[1] += n * m * bool(equal[k])
                    row[2] = max(row[2], float(similarity[k]))
        columns = list(zip(*((d, i, *row) for (d, i), row in rows.items()), strict=True))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "windows", "equal_windows", "similarity"])

    ids: list[int] = []
    texts: list[np.ndarray] = []
    held, shortest = 0, min(index.window for index in indexes)
    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            words = word_hashes(text.as_py(), known)
            if len(words) < shortest:
                continue
            ids.append(doc)
            texts.append(words)
            held += len(words)
            if held >= BATCH_WORDS:
                yield from (out for index in indexes if (out := flush(index, ids, texts)) is not None)
                ids, texts, held = [], [], 0
    if ids:
        yield from (out for index in indexes if (out := flush(index, ids, texts)) is not None)


def item_window(words: int) -> int:
    """The window of an item by its size: its number of words, from eight on rounded down to a multiple of eight."""
    return words if words < 8 else words - words % 8


def _item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    block, words = [], 0
    for row in items.where("item_id is not null and passage is not null").select("item_id", "passage").distinct().orderBy("item_id", "passage").toLocalIterator():
        block.append((row[0], row[1]))
        words += len(WORD.findall(row[1]))
        if words >= block_words:
            yield block
            block, words = [], 0
    yield block


def leaks(documents: DataFrame, items: DataFrame, window: int | None = WINDOW, radius: int = RADIUS, min_similarity: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, windows, equal_windows, similarity) of documents with a window like one of an item.

    Windows have ``window`` words or, if it is None, the size of the item (see ``item_window``), for leaks of whole
    items; documents are hashed once for all sizes. A pair of windows counts if the fingerprints lie within the radius
    and the weighted similarity is at least ``min_similarity``; ``windows`` counts such pairs, ``equal_windows`` those of
    the same words in the same order. Letter case and whatever stands between words do not count. Null or shorter texts
    and items match nothing; items repeated under one id count once; a document id that repeats is searched each time.
    """
    from functools import reduce

    spark = documents.sparkSession
    schema = "doc_id long, item_id long, windows long, equal_windows long, similarity double"
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for block in _item_blocks(items, block_words):
        sized: dict[int, list[tuple[int, str]]] = {}
        for item, passage in block:
            size = window or item_window(len(WORD.findall(passage)))
            if size:
                sized.setdefault(size, []).append((item, passage))
        indexes = spark.sparkContext.broadcast([ItemIndex(listed, size, radius) for size, listed in sorted((sized or {window or 1: []}).items())])
        parts.append(texts.mapInArrow(lambda batches, indexes=indexes: _search(indexes.value, batches, min_similarity), schema))
    return reduce(DataFrame.unionByName, parts)


def leaked_pairs(found: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents with a window of an item whose weighted shingles are all the same, in the same order."""
    return found.where("similarity >= 1 - 1e-9 and equal_windows > 0").select("doc_id", "item_id").distinct()
