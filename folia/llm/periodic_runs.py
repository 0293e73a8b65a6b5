"""Periodic runs of words, found by tandem repeats (Gusfield and Stoye, 2004).

The words of the documents of a slice form one string of symbols in which every
end of a document is a symbol of its own.  Over its suffix array and tree:

1. The string is cut into Lempel-Ziv blocks.  For each block, extensions to both
   sides of pairs of places around its borders give squares that cover the
   leftmost square of every kind (the same words in the same order).
2. A square's end is marked in the suffix tree if the square is the leftmost of
   its kind.  From each mark, suffix-link walks go to the next rotation as long
   as it is in the tree and not yet marked: all kinds of squares are marked then.
3. The leaves below a mark are the places of its squares.  Squares of one period
   at neighbouring places merge into runs.

Only squares whose half isn't itself a power are followed: they are the ones
whose half is the smallest period of their run, and there are O(n log n) places.

A run of four periods or more has each of its words four times or more, so
before all that the words that stand less often in their stretch become ends of
stretches, again and again: runs lie whole inside what stays.

**Defined results.**  A null text has no words; texts of up to five words and
empty ones have no run.  A row with a null id has no planted period.  Ties for
the greatest exponent go to the smallest start, then period.  Repeated rows
give their results each.  An empty table gives no rows.  Only the two named
columns are read.  Memory follows the words of a slice, or of the longest text,
that may lie in runs.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm._text import batch, sliced


#: Bytes of text worked on at once; the words take some hundred bytes each meanwhile.
SLICE = 4 << 20


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the suffixes in order, the place of each) by prefix doubling; only groups that aren't told apart yet are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.full(n + 1, -1, dtype=np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = s[order[1:]] != s[order[:-1]]
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, n))
    rank[order] = np.repeat(heads, size)
    todo, k = order[np.repeat(size, size) > 1], 1
    while len(todo):
        key = rank[todo] * (n + 1) + rank[np.minimum(todo + k, n)] + 1
        by = np.argsort(key, kind="stable")
        todo, key = todo[by], key[by]
        base = rank[todo]
        starts = np.flatnonzero(np.append(True, base[1:] != base[:-1]))
        place = base + np.arange(len(todo)) - np.repeat(starts, np.diff(np.append(starts, len(todo))))
        order[place] = todo
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(heads, len(todo)))
        rank[todo] = np.repeat(place[heads], size)
        todo, k = todo[np.repeat(size, size) > 1], 2 * k
    return order, rank[:n]


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[i] of the suffixes at places i - 1 and i (Kasai); lcp[0] is 0."""
    n = len(s)
    lcp = np.zeros(n, dtype=np.int64)
    text, sa, at, out = (memoryview(np.ascontiguousarray(x)) for x in (s, order, rank, lcp))
    h = 0
    for i in range(n):
        r = at[i]
        if r:
            j = sa[r - 1]
            top = n - max(i, j)
            while h < top and text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            h -= h > 0
        else:
            h = 0
    return lcp


class Extensions:
    """Longest common prefixes of any two suffixes: least lcp between their places, by a tree of minima."""

    def __init__(self, s: np.ndarray):
        self.n = len(s)
        self.order, self.rank = suffix_array(s)
        self.lcp = common_prefixes(s, self.order, self.rank)
        self.size = 1 << max(self.n - 1, 1).bit_length()
        self.tree = np.full(2 * self.size, self.n, dtype=np.int64)
        self.tree[self.size : self.size + self.n] = self.lcp
        for level in range(self.size.bit_length() - 2, -1, -1):
            lo = 1 << level
            self.tree[lo : 2 * lo] = self.tree[2 * lo : 4 * lo].reshape(-1, 2).min(axis=1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different places; a place at the end has no suffix and gives 0."""
        inside = (a < self.n) & (b < self.n)
        x, y = (self.rank[np.where(inside, p, 0)] for p in (a, b))
        lo, hi = np.minimum(x, y) + 1 + self.size, np.maximum(x, y) + 1 + self.size
        best = np.full(len(lo), self.n, dtype=np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            left = open_ & (lo & 1 == 1)
            best[left] = np.minimum(best[left], self.tree[lo[left]])
            lo = lo + left
            right = open_ & (hi & 1 == 1)
            hi = hi - right
            best[right] = np.minimum(best[right], self.tree[hi[right]])
            lo, hi = lo >> 1, hi >> 1
        return np.where(inside, best, 0)


class SuffixTree:
    """Nodes as intervals of the suffix array: first the n leaves by place, then the inner nodes; the root is the last.

    depth, parent, lo and hi (the leaves below) and least (the first position
    below) are arrays; the children of a node are ``kids[begin[v] : begin[v + 1]]``,
    ordered by their first symbols, ``first``.
    """

    def __init__(self, s: np.ndarray, ext: Extensions):
        n = len(s)
        self.lo, self.hi, self.depth, self.parent = (np.zeros(2 * n, dtype=np.int64) for _ in range(4))
        self.lo[:n] = self.hi[:n] = np.arange(n)
        self.depth[:n] = n - ext.order
        lo, hi, depth, parent, shared = map(memoryview, (self.lo, self.hi, self.depth, self.parent, np.append(ext.lcp[1:], 0)))
        stack: list[int] = []  # open inner nodes, of growing depth
        new = n
        for i in range(n):  # leaf i, then what the next leaf shares with it
            d, last = shared[i], i
            while stack and depth[stack[-1]] > d:
                v = stack.pop()
                parent[last], hi[v], last = v, i, v
            if not stack or depth[stack[-1]] < d:
                lo[new], depth[new] = lo[last], d
                stack.append(new)
                new += 1
            parent[last] = stack[-1]
        self.root = stack[0]
        hi[self.root], parent[self.root] = n - 1, self.root
        self.lo, self.hi, self.depth, self.parent = (x[:new].copy() for x in (self.lo, self.hi, self.depth, self.parent))
        self.least = self._least(ext.order)
        rest = np.flatnonzero(np.arange(new) != self.root)
        self.kids = rest[np.lexsort((self.lo[rest], self.parent[rest]))]
        self.begin = np.searchsorted(self.parent[self.kids], np.arange(new + 1))
        self.first = s[self.least[self.kids] + self.depth[self.parent[self.kids]]]

    def _least(self, order: np.ndarray) -> np.ndarray:
        """The least position below each node: minima go up level by level of depth."""
        least = np.full(len(self.lo), len(order), dtype=np.int64)
        least[: len(order)] = order
        inner = np.arange(len(order), len(self.lo))
        # children come before parents when intervals are ordered by their size
        seen, up = memoryview(least), memoryview(self.parent)
        for v in range(len(order)):
            if seen[v] < seen[up[v]]:
                seen[up[v]] = seen[v]
        for v in inner[np.argsort(self.hi[inner] - self.lo[inner], kind="stable")].tolist():
            if v != self.root and seen[v] < seen[up[v]]:
                seen[up[v]] = seen[v]
        return least


def longest_before(tree: SuffixTree, n: int) -> np.ndarray:
    """For each position the length of the longest prefix that also begins earlier."""
    out = np.zeros(n, dtype=np.int64)
    top = tree.least != tree.least[tree.parent]  # the highest node whose first position is this one
    out[tree.least[top]] = tree.depth[tree.parent[top]]
    return out


def blocks(before: np.ndarray) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the end."""
    out, at, step = [0], 0, memoryview(before)
    while at < len(before):
        at += max(step[at], 1)
        out.append(at)
    return np.array(out, dtype=np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, 1 to count) for each of the counts."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def leftmost_cover(s: np.ndarray, ahead: Extensions, back: Extensions, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of squares that cover the leftmost square of each kind."""
    n = len(s)
    backward = lambda a, b: back.of(n - 1 - a, n - 1 - b)  # noqa: E731  the common suffix that ends at both places
    begin, end = cuts[:-1], cuts[1:]
    size = end - begin
    found = []
    # the right half begins in the block and the square's middle lies k before its end
    o, k = _spread(np.where(end < n, size, 0))
    h1 = end[o]
    q = h1 - k
    same = s[q] == s[h1]
    k, q, h1 = k[same], q[same], h1[same]
    right = ahead.of(q, h1)
    left = np.where(q > 0, backward(np.maximum(q - 1, 0), h1 - 1), 0)
    ok = (left + right >= k) & (right > 0)
    found.append((np.maximum(q - left, q - k + 1)[ok], k[ok]))
    # the square begins in or before the block, its right half k after the block's begin
    o, k = _spread(np.minimum(size + np.append(size[1:], 0), n - 1 - begin))
    h, h1 = begin[o], end[o]
    q = h + k
    same = (s[q] == s[h]) & (h > 0)
    k, q, h, h1 = k[same], q[same], h[same], h1[same]
    same = s[h - 1] == s[q - 1]
    k, q, h, h1 = k[same], q[same], h[same], h1[same]
    right, left = ahead.of(h, q), backward(h - 1, q - 1)
    start = np.maximum(h - left, h - k + 1)
    ok = (left + right >= k) & (right > 0) & (start + k <= h1) & (left > 0)
    found.append((start[ok], k[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _prime_divisors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def not_powers(ahead: Extensions, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the half of each square has no smaller period that divides it."""
    kinds, which = np.unique(half, return_inverse=True)
    divisors = [_prime_divisors(k) for k in kinds.tolist()]
    counts = np.array([len(d) for d in divisors], dtype=np.int64)[which]
    owner, nth = _spread(counts)
    period = np.array([half_ // divisors[w][k - 1] for half_, w, k in zip(half[owner].tolist(), which[owner].tolist(), nth.tolist(), strict=True)], dtype=np.int64)
    power = ahead.of(start[owner], start[owner] + period) >= 2 * half[owner] - period
    out = np.ones(len(start), dtype=bool)
    out[owner[power]] = False
    return out


def suffix_links(s: np.ndarray, tree: SuffixTree, n: int) -> np.ndarray:
    """The node of each inner node's string without its first symbol, from the parent's link downwards."""
    link = np.full(len(tree.lo), tree.root, dtype=np.int64)
    inner = np.arange(n, len(tree.lo))
    down = Walker(s, tree, link)
    out = memoryview(link)
    for v in inner[np.argsort(tree.depth[inner], kind="stable")].tolist():
        if v != tree.root:
            out[v] = down.reach(v, down.depth[v] - 1)
    return link


class Walker:
    """Steps along suffix links: from a place above or at node v to that of the same string without its first symbol."""

    def __init__(self, s: np.ndarray, tree: SuffixTree, link: np.ndarray):
        self.text, self.link = memoryview(np.ascontiguousarray(s)), memoryview(link)
        self.depth, self.parent, self.least, self.kids, self.begin, self.first = (memoryview(np.ascontiguousarray(x)) for x in (tree.depth, tree.parent, tree.least, tree.kids, tree.begin, tree.first))
        self.root = tree.root

    def child(self, v: int, symbol: int) -> int:
        """The child whose edge begins with the symbol, or -1."""
        lo, hi = self.begin[v], self.begin[v + 1]
        at = bisect_left(self.first, symbol, lo, hi)
        return self.kids[at] if at < hi and self.first[at] == symbol else -1

    def reach(self, v: int, length: int) -> int:
        """The first node at depth ``length`` or below on the path of v's string without its first symbol."""
        i, u = self.least[v] + 1, self.parent[v]
        at = self.root if u == self.root else self.link[u]
        while self.depth[at] < length:
            at = self.child(at, self.text[i + self.depth[at]])
        return at

    def rotated(self, v: int, length: int) -> int:
        """The node of the next rotation of the square of this length at v, or -1 if the string has none."""
        i = self.least[v]
        at, a = self.reach(v, length - 1), self.text[i]
        if self.depth[at] == length - 1:
            return self.child(at, a)
        return at if self.text[self.least[at] + length - 1] == a else -1


def vocabulary(s: np.ndarray, tree: SuffixTree, start: np.ndarray, half: np.ndarray, before: np.ndarray) -> list[tuple[int, int]]:
    """(node, half length) of every kind of square that is a rotation of the given ones."""
    new = 2 * half > before[start]  # the leftmost of its kind: no earlier place has these words
    start, half = start[new], half[new]
    # nodes whose first position is the start lie on one path; the mark is on the edge into the first that is deep enough
    span = int(tree.depth.max()) + 1
    by = np.argsort(tree.least * span + tree.depth, kind="stable")
    at = by[np.searchsorted((tree.least * span + tree.depth)[by], start * span + 2 * half)]
    walk = Walker(s, tree, suffix_links(s, tree, len(s)))
    seen, out = set(), []
    for v, k in zip(at.tolist(), half.tolist(), strict=True):
        while v >= 0 and (v, k) not in seen:
            seen.add((v, k))
            out.append((v, k))
            v = walk.rotated(v, 2 * k)
    return out


def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of two periods or more, by period and start."""
    if len(s) < 2:
        return (np.empty(0, dtype=np.int64),) * 3
    s = np.unique(s, return_inverse=True)[1].astype(np.int64)
    s = np.append(s, s.max() + 1)  # an end of its own, so that no suffix begins another
    n = len(s)
    ahead, back = Extensions(s), Extensions(s[::-1].copy())
    tree = SuffixTree(s, ahead)
    before = longest_before(tree, n)
    start, half = leftmost_cover(s, ahead, back, blocks(before))
    back = None
    single = not_powers(ahead, start, half)
    kinds = vocabulary(s, tree, start[single], half[single], before)
    if not kinds:
        return (np.empty(0, dtype=np.int64),) * 3
    v, k = np.array(kinds, dtype=np.int64).T
    owner, nth = _spread(tree.hi[v] - tree.lo[v] + 1)
    place, period = ahead.order[tree.lo[v][owner] + nth - 1], k[owner]
    by = np.lexsort((place, period))
    place, period = place[by], period[by]
    head = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)))
    last = np.append(head[1:], len(place)) - 1
    return place[head], place[last] + 2 * period[head] - place[head], period[head]


def stretches(words: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Places of the words that stand ``least`` times or more in their stretch, until all do.

    A stretch is a sequence of places of one document without a gap.
    """
    at = np.arange(len(words))
    while len(at):
        stretch = np.cumsum(np.append(False, (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])))
        _, which, count = np.unique(stretch * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        often = count[which] >= least
        if often.all():
            break
        at = at[often]
    return at


def runs_of_documents(words: np.ndarray, doc: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs in the words of several documents, one after another, by place and period."""
    at = stretches(words, doc, least_exponent)
    if not len(at):
        return (np.empty(0, dtype=np.int64),) * 3
    gap = np.flatnonzero((at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])) + 1
    ends = int(words.max()) + 1 + np.arange(len(gap))  # each end of a stretch is a symbol of its own
    where = np.insert(at, gap, -1)
    start, length, period = runs(np.insert(words[at], gap, ends))
    long = (length >= least_length) & (length >= least_exponent * period)
    start, length, period = where[start[long]], length[long], period[long]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def planted(doc_id: int | None, words: list) -> list:
    """The words of a document, of every tenth with a period of its own making from some word on."""
    h, n = (1 if doc_id is None else zlib.crc32(str(doc_id).encode())), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


_OUT = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.string()), ("collapsed", pa.string())]
SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, runs string, collapsed string"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_exponent: int = 4, plant: bool = False, with_text: bool = True) -> DataFrame:
    """A row per document: its runs as lines ``start,length,period``, the one of the greatest exponent, and the text without the repeats.

    A word goes if a run holds it after its first period.  ``plant`` gives every
    tenth document a period first.  ``with_text`` adds ``runs`` and ``collapsed``
    (words joined by a space) to their digests.
    """
    out = pa.schema(_OUT if with_text else _OUT[:8])

    def run(batches):
        for b in sliced(batches, SLICE):
            ids = b.column(0).to_pylist()
            texts = [planted(i, t.split()) if plant else t.split() for i, t in zip(ids, b.column(1).to_pylist(), strict=True)]
            size = np.array([len(t) for t in texts], dtype=np.int64)
            number: dict[bytes, int] = {}
            words = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), dtype=np.int64, count=int(size.sum()))
            start, length, period = runs_of_documents(words, np.repeat(np.arange(len(texts)), size), least_length, least_exponent)
            first = np.cumsum(size) - size
            cuts = np.searchsorted(start, np.append(first, size.sum()))
            rows = []
            for d, t in enumerate(texts):
                mine = slice(cuts[d], cuts[d + 1])
                got = list(zip((start[mine] - first[d]).tolist(), length[mine].tolist(), period[mine].tolist(), strict=True))
                rows.append((ids[d], *_summary(t, got, with_text)))
            yield batch(out, *zip(*rows, strict=True))

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return picked.mapInArrow(run, SCHEMA if with_text else SCHEMA.partition(", runs string")[0])


def _summary(words: list[bytes], got: list[tuple[int, int, int]], with_text: bool) -> tuple:
    best = (None,) * 4
    if got:
        start, length, period = got[0]
        for s, n, q in got[1:]:  # in order of start, then period: only a greater exponent takes over
            if n * period > length * q:
                start, length, period = s, n, q
        best = (start, length, period, 1000 * length // period)
        keep = np.ones(len(words), dtype=bool)
        for s, n, q in got:
            keep[s + q : s + n] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    lines, text = "".join(f"{s},{n},{q}\n" for s, n, q in got).encode(), b" ".join(words)
    row = (len(got), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(text).hexdigest())
    return (*row, lines.decode(), text.decode(errors="replace")) if with_text else row
