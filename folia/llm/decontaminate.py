"""Benchmark decontamination by SimHash windows of each item's own size.

A text is compared with an item through the windows that have as many words as
the item.  A window's SimHash has the signs of the summed vectors of its word
shingles.  A shingle's vector is as long as the root of its weight (its letters),
so the cosine of two windows is at least their weighted overlap, and at a
similarity of 0.8 a place of the print differs with probability 0.15: 29 of 192
places, with a standard deviation of 5.  RADIUS is 47, while unrelated windows
differ in 96 places.

Prints are looked up in a multi-index.  They are cut into BLOCKS of 8 bits, and
RADIUS < 2 * BLOCKS, so a print within the radius differs from an item's in at
most one bit of some block; each block value lists the items within one bit of
it, so every pair within the radius is found.  Those are verified by the exact
weighted similarity of the two sets of word shingles.

Only windows that hold at least one shingle of an item of their length are
signed.  That loses nothing: any other window has similarity 0 to all of them.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from folia.llm._text import PLAIN_WORDS, WordHashes, batch, kept_where, mapped, mix, shingle_hashes

#: Places of a print (a multiple of 64), and how many may differ.
BITS, RADIUS = 192, 47
BLOCK_BITS = 8
BLOCKS = BITS // BLOCK_BITS
#: Shingles that are signed at once, starts that are looked up at once, and pairs that a look-up expands at once.
SIGNED, STARTS, PAIRS = 8192, 4096, 1 << 20
#: Items that one pass over the documents holds; more items take more passes.
ITEMS_A_PASS = 50_000
_FILTER_BITS = 22


def shingle_vectors(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each shingle plus or minus the root of its weight (in sixteenths) in each of BITS places, by the bits of its hash."""
    seeds = np.arange(1, BITS // 64 + 1, dtype=np.uint64)
    bits = np.unpackbits(mix(mix(hashes)[:, None] ^ mix(seeds)[None, :]).view(np.uint8), axis=1, bitorder="little")
    root = np.rint(16 * np.sqrt(weights)).astype(np.int32)
    return (2 * bits.astype(np.int32) - 1) * root[:, None]


def simhashes(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A print (row of 64-bit words) for each range of shingles.

    The prefix sums are made SIGNED shingles at a time and kept at the starts and
    ends only, so ranges of any length take bounded memory.
    """
    at = np.union1d(starts, ends)
    sums, total = np.zeros((len(at), BITS), dtype=np.int64), np.zeros(BITS, dtype=np.int64)
    for lo in range(int(at[0]), int(at[-1]), SIGNED):
        hi = min(lo + SIGNED, int(at[-1]))
        part = np.cumsum(shingle_vectors(hashes[lo:hi], weights[lo:hi]), axis=0, dtype=np.int64)
        first, last = np.searchsorted(at, [lo + 1, hi + 1])
        sums[first:last] = total + part[at[first:last] - lo - 1]
        total = total + part[-1]
    bits = (sums[np.searchsorted(at, ends)] - sums[np.searchsorted(at, starts)]) > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class MultiIndex:
    """Prints by block; ``near`` gives every pair within RADIUS bits."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.order, self.first = prints, [], []
        flips = np.concatenate([[0], 1 << np.arange(BLOCK_BITS)])
        for v in self.blocks(prints):
            near = (v[:, None] ^ flips).ravel()
            order = np.argsort(near, kind="stable")
            self.order.append((order // len(flips)).astype(np.int32))
            self.first.append(np.searchsorted(near[order], np.arange((1 << BLOCK_BITS) + 1)))

    @staticmethod
    def blocks(prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints).view(np.uint8).reshape(-1, BLOCKS).T.astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``prints``, index of the item) of the pairs within the radius."""
        found, n = [np.zeros(0, dtype=np.int64)], len(self.prints)
        for v, order, first in zip(self.blocks(prints), self.order, self.first, strict=True):
            ends = np.cumsum(first[v + 1] - first[v])
            for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                pair = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
                w = np.searchsorted(ends, pair, side="right")
                i = order[first[v[w] + 1] - (ends[w] - pair)].astype(np.int64)
                close = distances(prints[w], self.prints[i]) <= RADIUS
                found.append(np.unique(w[close] * n + i[close]))
        pairs = np.unique(np.concatenate(found))
        return pairs // n, pairs % n


def weighted_similarity(a: dict, b: dict) -> float:
    """Weighted Jaccard of {shingle: weight times count}."""
    both = sum(min(w, b[s]) for s, w in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def _weigh(shingles: np.ndarray, weights: np.ndarray) -> dict:
    out: dict = defaultdict(int)
    for s, w in zip(shingles.tolist(), weights.tolist(), strict=True):
        out[s] += w
    return out


class Items:
    """The items of a pass, by length, ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int, str]], n: int, threshold: float):
        self.n, self.threshold = n, threshold
        self.words = WordHashes()
        by_length = defaultdict(list)
        for item, text in items:
            hashes, sizes = self.of(text)
            if len(hashes):
                by_length[len(hashes)].append((item, *self.shingles(hashes, sizes, min(n, len(hashes)))))
        self.groups = {}
        lengths = defaultdict(lambda: defaultdict(set))  # words in a shingle -> shingle -> lengths of items that have it
        for length, group in by_length.items():
            prints = np.concatenate([simhashes(g, w, np.array([0]), np.array([len(g)])) for _, g, w in group])
            sets = [_weigh(g, w) for _, g, w in group]
            self.groups[length] = ([i for i, _, _ in group], MultiIndex(prints), sets)
            for x in sets:
                for s in x:
                    lengths[min(n, length)][s].add(length)
        self.runs = {}
        for size, got in lengths.items():
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            keys = np.array(list(got), dtype=np.uint64)
            bits[(keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.runs[size] = (bits, {k: sorted(v) for k, v in got.items()})

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, letters) of each word; the words themselves are held a few at a time."""
        hashes, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        found = (m.group() for m in PLAIN_WORDS.finditer((text or "").lower()))
        while words := list(islice(found, 1 << 16)):
            hashes.append(self.words.of(words))
            sizes.append(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        return np.concatenate(hashes), np.concatenate(sizes)

    def shingles(self, hashes: np.ndarray, sizes: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, letters) of each run of ``size`` words."""
        size = min(self.n if size is None else size, len(hashes))
        total = np.concatenate([[0], np.cumsum(sizes)])
        return shingle_hashes(hashes, size), total[size:] - total[: len(total) - size]

    def search(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item found."""
        hashes, sizes = self.of(text)
        best: dict[int, tuple[float, int, int]] = {}
        for size, (bits, lengths) in self.runs.items():
            if size > len(hashes):
                continue
            g, letters = self.shingles(hashes, sizes, size)
            at = defaultdict(lambda: array("q"))  # item length -> places of shingles of such items
            for p in np.flatnonzero(bits[(g & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)]).tolist():
                for length in lengths.get(int(g[p]), ()):
                    at[length].append(p)
            for length, places in at.items():
                self._windows(g, letters, size, length, np.frombuffer(places, dtype=np.int64), len(hashes), best)
        return sorted((i, *v) for i, v in best.items())

    def _windows(self, g, letters, size: int, length: int, places: np.ndarray, n_words: int, best: dict) -> None:
        """Looks up the windows of ``length`` words that hold a shingle at one of ``places``; a shorter text is one window."""
        last = max(0, n_words - length)
        span = np.zeros(last + 2, dtype=np.int32)
        until = np.minimum(places, last)
        np.add.at(span, np.clip(places + size - length, 0, until), 1)
        np.add.at(span, until + 1, -1)
        starts = np.flatnonzero(np.cumsum(span)[:-1] > 0)
        # windows that overlap are signed together, in pieces of bounded span
        cut = np.flatnonzero((np.diff(starts) > length) | (np.diff(starts // STARTS) > 0)) + 1
        ids, index, sets = self.groups[length]
        held = min(length, n_words) - size + 1
        for part in np.split(starts, cut):
            for w, i in zip(*(x.tolist() for x in index.near(simhashes(g, letters, part, part + held))), strict=True):
                s = int(part[w])
                sim = weighted_similarity(sets[i], _weigh(g[s : s + held], letters[s : s + held]))
                if sim >= self.threshold and sim > best.get(ids[i], (0.0,))[0]:
                    best[ids[i]] = (sim, s, min(length, n_words))


def _passes(benchmark: DataFrame, item_col: str, text_col: str, n: int, threshold: float):
    """A broadcast of at most ITEMS_A_PASS items each, until all items have had their pass."""
    items, sc = [], benchmark.sparkSession.sparkContext
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        items.append((r.i, r.t))
        if len(items) == ITEMS_A_PASS:
            yield sc.broadcast(items)
            items = []
    yield sc.broadcast(items)


class _Search:
    """Builds the index once per worker task."""

    def __init__(self, items, n: int, threshold: float):
        self.items, self.n, self.threshold, self.index = items, n, threshold, None

    def __call__(self, text: str | None):
        if self.index is None:
            self.index = Items(self.items.value, self.n, self.threshold)
        return self.index.search(text)

    def __getstate__(self):
        return {**self.__dict__, "index": None}


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, start, length: a row for each item found in a row of ``docs``.

    Null and empty texts, and items without a word, match nothing.  Words are runs
    of letters and digits in lower case; items of fewer than ``n`` words are one
    shingle.  Of equally similar windows the first is reported.  Texts of any length
    are searched whole; rows that repeat each give their rows, and so do items that
    repeat; rows without an id are searched like others.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("length", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in _passes(benchmark, item_col, item_text_col, n, threshold):
        search = _Search(items, n, threshold)

        def run(batches, search=search):
            for b in batches:
                got = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in search(t)]
                if got:
                    yield batch(schema, *zip(*got, strict=True))

        found = mapped(rows, run, "doc_id bigint, item_id bigint, similarity double, start bigint, length bigint")
        out = found if out is None else out.unionByName(found)
    return out


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they were."""
    for items in _passes(benchmark, item_col, item_text_col, n, threshold):
        search = _Search(items, n, threshold)
        docs = kept_where(docs, text_col, [("leaks", BooleanType())], lambda x, search=search: ([bool(search(t)) for t in x[0]],), "not leaks")
    return docs
