"""Language-model scores from an interpolated modified Kneser-Ney model of any order from 2.

Counting: each task folds its documents' n-grams into sorted, compressed arrays,
dealt by the last word of the context.  All n-grams with that word meet in one
part, so the part alone knows the counts of its contexts and, without their first
words, of all shorter n-grams: one shuffle serves all levels.  The arrays number
words; those of a sample have numbers that all tasks know, so the lists that name
words for the rest don't grow with the number of parts.  Words that the sample
shows to be frequent are dealt by the word before too, and their pairs merged in a
second, small round; a last round merges what several parts know of one word.  A part
writes its n-grams and contexts as sorted hash arrays into the shared folder.

Scoring: workers map the files into memory and look up whole batches by binary
search; documents are never shuffled.  The files have the same bytes whenever
they are written, so a task that runs again does no harm.

Texts begin with order - 1 start marks.  Every distinct n-gram of the corpus is
kept, unpruned.  A context that began a single n-gram once has no row of its own:
it is known by its own n-gram one level below.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm._arrays import flat, groups, narrow, packed, planes, steps, unpacked
from folia.llm._store import filesystem, new_folder, publish
from folia.llm._text import WordHashes, batch, mapped, mix, sliced

#: No word holds a line feed, so these are no words.
END, START = np.uint64(xxhash.xxh3_64_intdigest(b"\n")), np.uint64(xxhash.xxh3_64_intdigest(b"\n\n"))
#: Tokens (or n-grams) that a task holds before it folds them.
FOLD_TOKENS = 4_000_000
#: Input bytes for each part of the arrays, and the least number of parts.
PART_BYTES, LEAST_PARTS = 8 << 20, 16
#: Parts that one task merges, one after the other: their n-grams travel with one list of words.
GROUP = 4
#: Ways that n-grams are dealt at once; more groups of parts take more rounds.
FAN = 1024
#: Documents in the sample that shows frequent words; it decides where rows go and how they are written, not what they say.
SAMPLE = 2_000
#: The most words of the sample that all tasks know, so that blobs name them by number: 8 bytes each are broadcast.
KNOWN = 1 << 18
#: Parts of n-grams for each part that words are dealt to, and the most of these.
WORD_SHARE, WORD_PARTS = 64, 4096


def held_out(id_col: str) -> Column:
    """True for the fold that the model doesn't learn from; a null id isn't in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(words: WordHashes, text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z in lower case, and of the end."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII only
    out = np.empty(len(w) + 1, dtype=np.uint64)
    out[:-1] = words.of(w)
    out[-1] = END
    return out


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) ^ w)


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """A key for each n-gram, of its context's key and its last word."""
    key = columns[0]
    for c in columns[1:]:
        key = pair_keys(key, c)
    return key


def before(t: np.ndarray, sizes: np.ndarray, order: int, start) -> list[np.ndarray]:
    """The columns of the n-grams that end at each token, the tokens last."""
    place = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [t]
    for k in range(1, order):
        c = np.full_like(t, start)
        c[k:] = np.where(place[k:] >= k, t[:-k], start)
        out.insert(0, c)
    return out


@dataclass(frozen=True)
class Layout:
    """Where n-grams, contexts and words go."""

    parts: int
    word_parts: int
    hot: tuple  # frequent words and START, sorted
    order: int

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        hot = np.array(self.hot, dtype=np.uint64)
        return hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words

    def of_grams(self, columns: list[np.ndarray]) -> np.ndarray:
        """By the context's last word; where that is frequent also by the word before it (in a pair, by the word after it)."""
        by = columns[-2]
        hot = self.is_hot(by)
        if hot.any():
            by = np.where(hot, pair_keys(by, columns[-3] if len(columns) > 2 else columns[-1]), by)
        return _part_of(mix(by), self.parts)

    def is_shared(self, words: np.ndarray) -> np.ndarray:
        """Whether several parts have a share in what is known of a word."""
        return self.is_hot(words) | (words == END) if self.order > 2 else np.ones(len(words), dtype=bool)

    def of_words(self, words: np.ndarray) -> np.ndarray:
        """The part that merges a shared word, else the part of the pairs that begin with it."""
        return np.where(self.is_shared(words), _part_of(words, self.word_parts), _part_of(mix(words), self.parts))


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _distinct(columns: list[np.ndarray], n: np.ndarray | None, names: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams of word numbers (below ``names``) and the sums of ``n`` (None: 1 each),
    in order of the context from its last word back, then of the last word."""
    key, bound = columns[-2].astype(np.int64), names
    for c in [*columns[-3::-1], columns[-1]]:
        if bound * names >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            bound = len(key)
        key, bound = key * names + c, bound * names
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = groups(key)
    sums = np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n[order], first) if len(first) else n
    return [c[order[first]] for c in columns], sums


class Known:
    """The words that all tasks know, the most frequent first."""

    def __init__(self, words: np.ndarray):
        self.words, self.order = words, np.argsort(words)

    def __reduce__(self):
        return Known, (self.words,)

    def places(self, names: np.ndarray) -> np.ndarray:
        """The number of each word, that of all words for others."""
        if not len(self.words):
            return np.zeros(len(names), dtype=np.int64)
        at = self.order[np.minimum(np.searchsorted(self.words, names, sorter=self.order), len(self.order) - 1)]
        return np.where(self.words[at] == names, at, len(self.words))

    def first(self, names: np.ndarray, *less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The names with known words first, in their order, then others (by ``less``), and the new number of each."""
        rank = np.lexsort((*less, self.places(names)))
        back = np.empty(len(rank), dtype=np.int64)
        back[rank] = np.arange(len(rank))
        return names[rank], back

    def written(self, names: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes]:
        """Names that come known first, with their places, as the steps between these, and the rest."""
        known = at < len(self.words)
        return packed(steps(at[known])), planes(names[~known])

    def read(self, blob: tuple[bytes, bytes]) -> np.ndarray:
        return np.concatenate([self.words[np.cumsum(unpacked(blob[0])[0], dtype=np.int64)], flat(blob[1], "<u8")])


BLOBS = pa.schema([("part", pa.int64()), ("salt", pa.int64()), ("data", pa.binary())])
BLOBS_DDL = "part bigint, salt bigint, data binary"
TALLY = pa.schema([("part", pa.int64()), ("what", pa.string()), ("n", pa.list_(pa.int64()))])


def _dealt_grams(names: np.ndarray, columns: list[np.ndarray], n: np.ndarray, part: np.ndarray, width: int, known: Known):
    """(group of ``width`` parts, blob) of distinct n-grams in order; of the names known ones are first.

    A blob names the words of all its parts once; of each part it has the context's
    last word, then the words before it, the last word and the counts.
    """
    order, places = np.argsort(narrow(part), kind="stable"), known.places(names)
    cut = np.append(groups(part[order] // width), len(order)).tolist()
    for lo, hi in zip(cut, cut[1:], strict=False):
        there = np.zeros(len(names), dtype=bool)
        for c in columns:
            there[c[order[lo:hi]]] = True
        local = np.cumsum(there) - 1
        inner, slices = lo + np.append(groups(part[order[lo:hi]]), hi - lo), []
        for x, y in zip(inner.tolist(), inner[1:].tolist(), strict=False):
            rows = order[x:y]
            own = [local[c[rows]] for c in columns]
            own = [own[-2], *own[-3::-1], own[-1]]
            # the first column ascends, and the second among equals of the first
            step = steps(own[0])
            own[1] = np.where(step > 0, own[1], steps(own[1]))
            slices.append((int(part[rows[0]]), packed(step, *own[1:], n[rows])))
        yield int(part[order[lo]]) // width, pickle.dumps((known.written(names[there], places[there]), slices), protocol=5)


def _read_grams(blobs: list[bytes], order: int, known: Known):
    """The names of all blobs, known ones first, and (part, columns of numbers, counts) part by part; an n-gram may come several times."""
    got = [pickle.loads(x) for x in blobs]
    tables = [known.read(x) for x, _ in got]
    names, at = np.unique(np.concatenate(tables), return_inverse=True)
    names, back = known.first(names)
    at = back[at]
    starts = np.cumsum([0, *map(len, tables)]).tolist()
    by_part: dict[int, list] = {}
    for i, (_, slices) in enumerate(got):
        for part, data in slices:
            by_part.setdefault(part, []).append((at[starts[i] : starts[i + 1]], data))
    place = [*range(order - 2, -1, -1), order - 1]  # of a blob's columns

    def read(table: np.ndarray, data: bytes) -> list[np.ndarray]:
        columns = [c.astype(np.int64) for c in unpacked(data)]
        first = np.flatnonzero(columns[0])
        first = np.concatenate([[0], first[first > 0]])
        total, columns[0] = np.cumsum(columns[1]), np.cumsum(columns[0])
        columns[1] = total - np.repeat((total - columns[1])[first], np.diff(np.append(first, len(total))))
        return [*(table[columns[place.index(p)]] for p in range(order)), columns[-1]]

    def parts():
        for part in sorted(by_part):
            *columns, n = map(np.concatenate, zip(*(read(*x) for x in by_part.pop(part)), strict=True))
            yield part, columns, n

    return names, parts()


def _in_batches(rows):
    """Record batches of at most 256 blobs from (part, blob)."""
    got, salt = [], TaskContext.get().partitionId()
    for x in rows:
        got.append(x)
        if len(got) == 256:
            yield batch(BLOBS, [p for p, _ in got], np.full(len(got), salt), [d for _, d in got])
            got = []
    if got:
        yield batch(BLOBS, [p for p, _ in got], np.full(len(got), salt), [d for _, d in got])


def _count(batches, layout: Layout, order: int, width: int, known: Known):
    """Folded n-grams of training texts as blobs by groups of ``width`` parts."""
    words, held, size = WordHashes(500_000), [], 0

    def fold():
        t = np.concatenate([[START], *held])
        names, t, n = np.unique(t, return_inverse=True, return_counts=True)
        # frequent words have low numbers, which compress
        names, back = known.first(names, -n)
        t = back[t]
        columns, n = _distinct(before(t[1:], np.array([len(x) for x in held]), order, t[0]), None, len(names))
        yield from _dealt_grams(names, columns, n, layout.of_grams([names[c] for c in columns]), width, known)

    for b in sliced(batches):
        for text in b.column(0).to_pylist():
            held.append(tokens(words, text))
            size += len(held[-1])
            if size >= FOLD_TOKENS:
                yield from _in_batches(fold())
                held, size = [], 0
    if held:
        yield from _in_batches(fold())


def _refold(batches, layout: Layout, order: int, width: int, known: Known):
    """Blobs of wide groups merged as they come and dealt to groups of ``width`` parts."""
    held, size = [], 0

    def fold():
        names, parts = _read_grams(held, order, known)
        *columns, n = map(np.concatenate, zip(*((*c, n) for _, c, n in parts), strict=True))
        columns, n = _distinct(columns, n, len(names))
        yield from _dealt_grams(names, columns, n, layout.of_grams([names[c] for c in columns]), width, known)

    for b in batches:
        for data in b.column("data").to_pylist():
            held.append(data)
            size += len(data)
            if size >= 4 * FOLD_TOKENS:
                yield from _in_batches(fold())
                held, size = [], 0
    if held:
        yield from _in_batches(fold())


#: Key bits that a file of so many rows leaves out: they are the number of the row's bucket.
BUCKET_BITS, BUCKET_ROWS = 16, 1 << 15


def _save(folder: str, name: str, key: np.ndarray, *columns: np.ndarray) -> None:
    """Keys, sorted, and a byte for each that names its values among the 255 most frequent (else a row of the rest does).

    A head of eight numbers says how many rows, bucket bits, columns, distinct
    values and rest rows follow.
    """
    order = np.argsort(key)
    key, columns = key[order], [c[order] for c in columns]
    table, code, n = np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True, return_counts=True) if len(columns) > 1 else np.unique(columns[0], return_inverse=True, return_counts=True)
    rank = np.argsort(-n, kind="stable")
    back = np.empty(len(rank), dtype=np.int64)
    back[rank] = np.arange(len(rank))
    table, code = table[rank].reshape(len(rank), len(columns)), back[code.ravel()]
    rest = np.flatnonzero(code >= 255)
    bits = BUCKET_BITS if len(key) >= BUCKET_ROWS else 0
    starts = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(key)])
    high = (key >> np.uint64(32)).astype("<u2" if bits else "<u4")
    head = np.array([len(key), bits, len(columns), len(table), len(rest), 0, 0, 0], dtype="<u8")
    with tempfile.NamedTemporaryFile() as f:
        for x in (head, table.astype("<i8"), rest.astype("<u4"), code[rest].astype("<u4"), starts.astype("<u4"), key.astype("<u4"), high, np.minimum(code, 255).astype("u1")):
            f.write(x.tobytes())
        f.flush()
        publish(folder, name, f.name)


class SortedHashes:
    """A file of ``_save``, mapped into memory once."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype="u1", mode="r").view(np.ndarray)
        n, self.bits, columns, values, rest = np.frombuffer(raw[:64].tobytes(), dtype="<u8")[:5].astype(int).tolist()
        at = 64

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            out, at = raw[at : at + size].view(kind), at + size
            return out

        self.table = np.array(take(values * columns, "<i8")).reshape(values, columns)
        self.rest, self.rest_code = take(rest, "<u4"), take(rest, "<u4")
        self.starts, self.low = take((1 << self.bits) + 1, "<u4"), take(n, "<u4")
        self.high, self.code = take(n, "<u2" if self.bits else "<u4"), take(n, "u1")

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the keys that are there, their rows of values)."""
        b = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), dtype=np.int64)
        lo, hi = self.starts[b].astype(np.int64), self.starts[b + 1].astype(np.int64)
        end = hi.copy()
        high, low = (keys >> np.uint64(32)).astype(self.high.dtype), keys.astype(np.uint32)  # without bucket bits, as in the file
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # binary search by the high bits in all buckets at once
            m = (lo[open_] + hi[open_]) >> 1
            less = self.high[m] < high[open_]
            lo[open_[less]] = m[less] + 1
            hi[open_[~less]] = m[~less]
            open_ = open_[lo[open_] < hi[open_]]
        hit, open_ = [], np.flatnonzero(lo < end)
        while len(open_):  # rows with equal high bits follow in order of the low ones
            row = lo[open_]
            same = self.high[row] == high[open_]
            have = self.low[row]
            hit.append(open_[same & (have == low[open_])])
            open_ = open_[same & (have < low[open_])]
            lo[open_] += 1
            open_ = open_[lo[open_] < end[open_]]
        hit = np.concatenate(hit) if hit else open_
        row = lo[hit]
        code = self.code[row].astype(np.int64)
        more = code == 255
        if more.any():
            code[more] = self.rest_code[np.searchsorted(self.rest, row[more])]
        return hit, self.table[code]


def _levels(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _by_context(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The contexts of n-grams in order, and (total, one, two, more) of each."""
    first = groups(*columns[:-1])
    if not len(first):
        return [c[:0] for c in columns[:-1]], [n[:0]] * 4
    return [c[first] for c in columns[:-1]], [np.add.reduceat(x, first) for x in (n, *((x.astype(np.int64) for x in (n == 1, n == 2, n > 2))))]


def _word_rows(layout: Layout, words: np.ndarray, rows: np.ndarray):
    """(part, blob) of words' six values that other parts add to."""
    there = np.flatnonzero(rows.any(axis=0))
    there = there[np.argsort(words[there])]
    part = layout.of_words(words[there])
    order = np.argsort(part, kind="stable")
    cut = np.append(groups(part[order]), len(order)).tolist()
    for lo, hi in zip(cut, cut[1:], strict=False):
        own = there[order[lo:hi]]
        yield -1 - int(part[order[lo]]), packed(steps(words[own]), *rows[:, own])


def _tally(layout: Layout, level: int, numbers: list[int]) -> tuple[int, bytes]:
    """Numbers to be added up: counts of counts of a level, or (level 1) what words sum to."""
    return -1 - layout.word_parts - level, pickle.dumps(numbers, protocol=5)


def _word_tally(rows: np.ndarray, docs: int) -> list[int]:
    count, ends = rows[:2]
    return [int(count.sum()), int((count > 0).sum()), int(ends.sum()), docs, *_levels(ends), int((ends > 2).sum())]


def _save_pairs(folder: str, name: str, names: np.ndarray, columns: list[np.ndarray], n: np.ndarray, layout: Layout, rows: np.ndarray, out: list) -> None:
    """Writes complete pairs, passes on the counts of their counts, and adds what they say of their first words and of the end to ``rows``."""
    if not len(n):
        return
    _save(folder, name, gram_keys([names[c] for c in columns]), n)
    (first,), stats = _by_context(columns, n)
    rows[2:, first] += np.stack(stats)
    rows[1] += np.where(names == END, np.bincount(columns[1], minlength=len(names)), 0)
    out.append(_tally(layout, 2, _levels(n)))


def _table(out: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([[p for p, _ in out], [0] * len(out), [d for _, d in out]], schema=BLOBS)


def _merge_grams(folder: str, layout: Layout, order: int, known):
    """Merges the n-grams of a group of parts, part by part, and writes the arrays of all levels down to its words; passes on pairs after frequent words and what other parts add to."""

    def merge(table: pa.Table) -> pa.Table:
        names, parts = _read_grams(table["data"].to_pylist(), order, known.value)
        hot, shared, later = layout.is_hot(names), layout.is_shared(names), []
        rows, out = np.zeros((6, len(names)), dtype=np.int64), []
        start = int(np.flatnonzero(names == START)[0]) if (names == START).any() else -1
        for part, columns, n in parts:
            columns, n = _distinct(columns, n, len(names))
            mine = np.zeros((6, len(names)), dtype=np.int64)
            if order == 2:  # a pair's part goes by its first word, so it knows no word's endings
                np.add.at(mine[0], columns[1], n)
                mine[1] += np.where(names == END, 0, np.bincount(columns[1], minlength=len(names)))
                _save_pairs(folder, f"g2-{part}", names, columns, n, layout, mine, out)
                rows += mine
                continue
            # every token but ends is the last context word once, and the words before it are those it ends pairs of
            np.add.at(mine[0], columns[-2], n)
            two = groups(columns[-2], columns[-3])
            np.add.at(mine[1], columns[-2][two], 1)
            if start >= 0:
                mine[0, names == END] = mine[0, start]  # a start for each end
                mine[:2, start] = 0
            for level in range(order, 2, -1):
                _save(folder, f"g{level}-{part}", gram_keys([names[c] for c in columns]), n)
                context, stats = _by_context(columns, n)
                own = np.flatnonzero((stats[0] > 1) | (context[-1] == start))
                if len(own):
                    _save(folder, f"c{level}-{part}", gram_keys([names[c[own]] for c in context]), *(x[own] for x in stats))
                out.append(_tally(layout, level, _levels(n)))
                columns, n = _distinct(columns[1:], None, len(names))
            wait = hot[columns[0]]
            _save_pairs(folder, f"g2-{part}", names, [c[~wait] for c in columns], n[~wait], layout, mine, out)
            if wait.any():
                later.append((*(c[wait] for c in columns), n[wait]))
            whole = ~shared & mine.any(axis=0)
            if whole.any():
                _save(folder, f"w-{part}", names[whole], *mine[:, whole])
                out.append(_tally(layout, 1, _word_tally(mine[:, whole], 0)))
            rows += np.where(shared, mine, 0)
        if later:
            *pairs, n = map(np.concatenate, zip(*later, strict=True))
            pairs, n = _distinct(pairs, n, len(names))
            out += _dealt_grams(names, pairs, n, layout.of_grams([names[c] for c in pairs]), GROUP, known.value)
        out += _word_rows(layout, names, rows)
        return _table(out)

    return merge


def _merge_pairs(folder: str, layout: Layout, known):
    """Merges pairs after frequent words; passes everything else on."""

    def merge(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() < 0:
            return table.select(BLOBS.names)
        names, parts = _read_grams(table["data"].to_pylist(), 2, known.value)
        rows, out = np.zeros((6, len(names)), dtype=np.int64), []
        for part, columns, n in parts:
            columns, n = _distinct(columns, n, len(names))
            _save_pairs(folder, f"h2-{part}", names, columns, n, layout, rows, out)
        out += _word_rows(layout, names, rows)
        return _table(out)

    return merge


def _merge_words(folder: str, layout: Layout):
    """Merges what several parts know of a word into an array of such words."""

    def merge(table: pa.Table) -> pa.Table:
        part = -1 - table["part"][0].as_py()
        blobs = table["data"].to_pylist()
        if part >= layout.word_parts:
            level = part - layout.word_parts
            return pa.table([[part], ["words" if level == 1 else f"level {level}"], [np.sum([pickle.loads(x) for x in blobs], axis=0).tolist()]], schema=TALLY)
        got = [unpacked(x) for x in blobs]
        keys = [np.cumsum(x[0].astype(np.uint64), dtype=np.uint64) for x in got]
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        rows = np.zeros((6, len(key)), dtype=np.int64)
        starts = np.cumsum([0, *map(len, keys)])
        for x, s in zip(got, starts.tolist(), strict=False):
            rows[:, at[s : s + len(x[0])]] += np.stack([c.astype(np.int64) for c in x[1:]])
        _save(folder, f"x-{part}", key, *rows)
        return pa.table([[part], ["words"], [_word_tally(rows, int(rows[0, key == END].sum()))]], schema=TALLY)

    return merge


def _discounts(levels: list[int]) -> np.ndarray:
    """What modified Kneser-Ney takes off counts 1, 2, 3 or more (0 off 0)."""
    n1, n2, n3, n4 = levels
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a and b else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.1), k - 0.1) for k, d in enumerate(raw, 1))])


@dataclass(frozen=True)
class NgramModel:
    folder: str
    layout: Layout
    n: int  # training tokens
    vocabulary: int
    docs: int
    pair_types: int
    gram_off: tuple  # what is taken off counts, of level 2 and up
    word_off: tuple
    word_left: float  # sum of what is taken off the words' ending counts

    def _look(self, kind: str, part: np.ndarray, keys: np.ndarray, columns: int) -> np.ndarray:
        """A row of values for each key; 0 where a key isn't there."""
        out = np.zeros((len(keys), columns))
        # by part, and in a part nearly in the order of its file, so that look-ups pass through it once
        order = np.argsort((keys >> np.uint64(48)).astype(np.uint16), kind="stable")
        order = order[np.argsort(narrow(part)[order], kind="stable")]
        cut = np.append(groups(part[order]), len(order)).tolist()
        for lo, hi in zip(cut, cut[1:], strict=False):
            rows = order[lo:hi]
            have = _file(self.folder, f"{kind}-{part[rows[0]]}")
            if have is not None:
                hit, values = have.look(keys[rows])
                out[rows[hit]] = values
        return out

    def _words(self, words: np.ndarray) -> np.ndarray:
        out, part, shared = np.zeros((len(words), 6)), self.layout.of_words(words), self.layout.is_shared(words)
        for kind, rows in (("w", np.flatnonzero(~shared)), ("x", np.flatnonzero(shared))):
            if len(rows):
                out[rows] = self._look(kind, part[rows], words[rows], 6)
        return out

    def _grams(self, columns: list[np.ndarray]) -> np.ndarray:
        """Counts of distinct n-grams."""
        keys, part = gram_keys(columns), self.layout.of_grams(columns)
        out = np.zeros(len(keys))
        hot = self.layout.is_hot(columns[0]) if len(columns) == 2 < len(self.gram_off) + 1 else np.zeros(len(keys), dtype=bool)
        for kind, rows in ((f"g{len(columns)}", np.flatnonzero(~hot)), ("h2", np.flatnonzero(hot))):
            if len(rows):
                out[rows] = self._look(kind, part[rows], keys[rows], 1)[:, 0]
        return out

    def score(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """n_tokens, n_known, base_score, score of token arrays."""
        sizes = np.array([len(x) for x in texts])
        t = np.concatenate(texts)
        starts = np.cumsum(sizes) - sizes
        words, w = np.unique(np.concatenate([[START], t]), return_inverse=True)
        start, w = w[0], w[1:]
        order = len(self.gram_off) + 1
        columns = before(w, sizes, order, start)
        count, ends, *context = self._words(words).T
        base = np.log10((count + 0.5) / (self.n + 0.5 * (self.vocabulary + 1)))
        off, types = np.array(self.word_off), max(self.pair_types, 1)
        left = self.word_left / types if self.pair_types else 1.0
        p = (np.maximum(ends - off[np.minimum(ends, 3).astype(int)], 0) / types + left / (self.vocabulary + 1))[w]
        context, first = [x[columns[-2]] for x in context], np.zeros(len(t), dtype=bool)
        first[starts] = True
        for level in range(2, order + 1):
            off = np.array(self.gram_off[level - 2])
            # most of the longest n-grams come once in a batch: they are looked up as they are
            own, at = _unique(columns[-level:], len(words)) if level < order else (columns[-level:], slice(None))
            c = self._grams([words[x] for x in own])[at]
            total, one, two, more = context
            gamma = (one * off[1] + two * off[2] + more * off[3]) / np.maximum(total, 1)
            gamma[total == 0] = 1.0  # a context never seen says nothing about the next word
            p = np.maximum(c - off[np.minimum(c, 3).astype(int)], 0) / np.maximum(total, 1) + gamma * p
            if level < order:  # the contexts of the next level: the n-grams that end before the token
                heads = [words[np.append(x, start)] for x in own]
                at = np.where(first, len(own[0]), np.concatenate([[0], at[:-1]]))
                # any word after them would do: their part goes by their last two
                seen = self._look(f"c{level + 1}", self.layout.of_grams([*heads, heads[-1]]), gram_keys(heads), 4)
                context = list(seen[at].T)
                # a context without a row began one n-gram once if it is an n-gram itself
                known = np.zeros(len(t))
                known[1:] = c[:-1]
                known[first] = 0
                once = (context[0] == 0) & (known > 0)
                context[0][once], context[1][once] = 1, 1
        add = lambda x: np.add.reduceat(x.astype(np.float64), starts)
        return [sizes, add(count[w] > 0).astype(np.int64), add(base[w]), add(np.log10(p))]


def _unique(columns: list[np.ndarray], names: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of word numbers below ``names``, and the place of each row among them."""
    key, bound = columns[0].astype(np.int64), names
    for c in columns[1:]:
        if bound * names >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            bound = len(key)
        key, bound = key * names + c, bound * names
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    return [c[first] for c in columns], at


@lru_cache(maxsize=16_384)
def _file(folder: str, name: str) -> SortedHashes | None:
    """A mapped file; from a remote folder by way of a copy that the executor's workers share."""
    from pyarrow import fs as pafs

    fs, base = filesystem(folder)
    info = fs.get_file_info(f"{base}/{name}")
    if info.type != pafs.FileType.File or not info.size:
        return None
    path = info.path
    if not isinstance(fs, pafs.LocalFileSystem):
        path = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(base), name)
        if not os.path.exists(path):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            pafs.copy_files(info.path, f"{path}.{os.getpid()}", source_filesystem=fs)
            os.replace(f"{path}.{os.getpid()}", path)
    return SortedHashes(path)


def _frequent(docs: DataFrame, parts: int) -> tuple[tuple, np.ndarray]:
    """Words with over half a part's share of a sample's tokens, and START; and the KNOWN most frequent, by frequency."""
    words = WordHashes()
    t = np.concatenate([[START], *(tokens(words, r[0]) for r in docs.take(SAMPLE))])
    w, n = np.unique(t, return_counts=True)
    return tuple(sorted({*w[2 * parts * n > len(t)].tolist(), int(START)})), w[np.lexsort((w, -n))][:KNOWN]


def fit(docs: DataFrame, text_col: str = "text", folder: str | None = None, order: int = 2, fan: int = FAN) -> NgramModel:
    """Learns n-grams of up to ``order`` words from all rows of ``docs``.

    Null texts are empty (an end alone); repeated rows count as often as they
    come; texts of any length are counted whole, in folds.
    """
    if order < 2:
        raise ValueError(f"the order must be 2 at least: {order}")
    folder = folder or new_folder(docs.sparkSession, "ngrams")
    # the planner's estimate, for files their size; without one it is huge and LEAST_PARTS holds
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0
    parts = max(LEAST_PARTS, size // PART_BYTES)
    texts = docs.select(F.col(text_col).alias("text"))
    hot, words = _frequent(texts, parts)
    layout = Layout(parts, min(WORD_PARTS, max(LEAST_PARTS, parts // WORD_SHARE)), hot, order)
    known = docs.sparkSession.sparkContext.broadcast(Known(words))  # KNOWN words at most
    tasks = max(fan, size // (64 << 20))
    width = max(GROUP, -(-parts // fan))
    stats = texts.mapInArrow(lambda b, width=width: _count(b, layout, order, width, known.value), BLOBS_DDL)
    while width > GROUP:  # wider groups of parts are dealt on, each by several tasks
        width = max(GROUP, -(-width // fan))
        stats = stats.withColumn("salt", F.pmod("salt", F.lit(-(-tasks // fan)))).repartition(tasks, "part", "salt").mapInArrow(lambda b, width=width: _refold(b, layout, order, width, known.value), BLOBS_DDL)
    stats = stats.groupBy("part").applyInArrow(_merge_grams(folder, layout, order, known), BLOBS_DDL)
    if order > 2:
        stats = stats.groupBy("part").applyInArrow(_merge_pairs(folder, layout, known), BLOBS_DDL)
    tallies = stats.groupBy("part").applyInArrow(_merge_words(folder, layout), "part bigint, what string, n array<bigint>")
    # added up per kind: a row per level, whatever the number of parts
    total = {r.what: r.n for r in tallies.select("what", F.posexplode("n").alias("i", "x")).groupBy("what", "i").agg(F.sum("x").alias("x")).groupBy("what").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("n")).collect()}
    n, vocabulary, types, n_docs, *rest = total.get("words", [0] * 9)
    off = _discounts(rest[:4])
    left = float(np.dot(off[1:], [rest[0], rest[1], rest[4]]))
    return NgramModel(folder, layout, n, vocabulary, n_docs, types, tuple(tuple(_discounts(total.get(f"level {k}", [0] * 4))) for k in range(2, order + 1)), tuple(off), left)


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row."""

    def run(batches):
        words = WordHashes(500_000)
        for b in batches:
            for c in sliced([b], 4 << 20):
                yield batch(SCORES, c.column(0), c.column(1), *model.score([tokens(words, x) for x in c.column(2).to_pylist()]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    got = mapped(rows, run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
