"""Quality classifier: a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad from features of itself and of
its neighbours, with transitions between labels.  Training knows only document
labels: lines first take their document's label, and in rounds of relabelling
the lines of bad documents that look good become good (at least one stays bad).
A document's quality is the mean of its lines' forward-backward marginals,
weighted by their length, on a scale fitted to the training documents.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folia.llm._text import batch, kept_where, mapped, with_columns

#: Symbols that mark junk, and marks that end sentences.
SYMBOLS, ENDS = "#*$%&|<>=_~^\\", ".!?:;\"”»"
FEATURES = ("chars", "words", "word_chars", "symbols", "upper", "letters", "digits", "bangs", "distinct", "beside", "again", "ends")
#: Thresholds per feature: half at quantiles, half at equal steps, so that rare extremes have their own.
CUTS = 8
#: Texts of more characters are scored by blocks of lines; chains of more lines go line by line with carried messages.
LONG_TEXT, LONG_CHAIN = 1 << 20, 2048
BLOCK_LINES, BLOCK_CHARS = 1 << 16, 1 << 22

_LINE = re.compile(r"[^\n]+")
_flags: np.ndarray | None = None


def _char_flags() -> np.ndarray:
    """For each code point: 1 letter, 2 upper-case, 4 digit, 8 symbol, 16 exclamation mark, 32 space."""
    global _flags
    if _flags is None:
        f = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            s = chr(c)
            f[c] = s.isalpha() | 2 * s.isupper() | 4 * s.isdigit() | 32 * s.isspace()
        for s in SYMBOLS:
            f[ord(s)] |= 8
        f[ord("!")] |= 16
        _flags = f
    return _flags


def _rows(lines: list[str], again) -> np.ndarray:
    """A row of FEATURES per line; ``again`` says which lines stand earlier in their text."""
    words = []
    for x in lines:
        w = x.split()
        words.append((len(w), len(set(w)), sum(map(operator.eq, w, w[1:])), x.rstrip()[-1:] in ENDS))
    flags = _char_flags()[np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    chars = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    starts = np.cumsum(chars) - chars
    letters, upper, digits, symbols, bangs, spaces = (np.add.reduceat((flags & bit) > 0, starts, dtype=np.int64) for bit in (1, 2, 4, 8, 16, 32))
    n, distinct, beside, ends = np.array(words, dtype=np.float64).T
    solid = np.maximum(chars - spaces, 1)
    cols = (
        np.log1p(chars), np.log1p(n), solid / np.maximum(n, 1), symbols / np.maximum(n, 1), upper / np.maximum(letters, 1), letters / solid,
        digits / solid, bangs / np.maximum(n, 1), distinct / np.maximum(n, 1), beside / np.maximum(n, 1), again, ends,
    )
    return np.stack(cols, axis=1).astype(np.float32)


def _lines(text: str | None) -> Iterator[str]:
    """The lines with a word."""
    return (x for m in _LINE.finditer(text or "") if not (x := m.group()).isspace())


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of FEATURES per line with a word, lines per text); null is empty."""
    lines, sizes, again = [], [], []
    for t in texts:
        own, seen = list(_lines(t)), set()
        for x in own:
            again.append(x in seen)
            seen.add(x)
        lines += own
        sizes.append(len(own))
    raw = _rows(lines, again) if lines else np.zeros((0, len(FEATURES)), dtype=np.float32)
    return raw, np.array(sizes, dtype=np.int64)


def line_blocks(text: str) -> Iterator[np.ndarray]:
    """The same rows for one text, in blocks of bounded lines and characters."""
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in _lines(text)), dtype=np.uint64)
    again = np.ones(len(hashes), dtype=bool)
    again[np.unique(hashes, return_index=True)[1]] = False
    del hashes
    held, chars, at = [], 0, 0
    for x in _lines(text):
        held.append(x)
        chars += len(x)
        if len(held) == BLOCK_LINES or chars >= BLOCK_CHARS:
            yield _rows(held, again[at : at + len(held)])
            held, chars, at = [], 0, at + len(held)
    if held:
        yield _rows(held, again[at:])


def neighbours(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row with the rows of the line before and after in its text (zeros at the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x):
        before[1:], after[:-1] = x[:-1], x[1:]
        ends = np.cumsum(sizes[sizes > 0])
        before[ends - sizes[sizes > 0]] = 0
        after[ends - 1] = 0
    return np.concatenate([x, before, after], axis=1)


@dataclass
class LineCrf:
    cuts: np.ndarray  # FEATURES x CUTS
    weights: np.ndarray  # log-odds of good
    trans: np.ndarray  # [from, to], 0 bad, 1 good
    slope: float = 1.0
    shift: float = 0.0

    def design(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        x = np.ones((len(raw), 1 + self.cuts.size), dtype=np.float32)
        for j in range(self.cuts.shape[0]):
            x[:, 1 + j * CUTS : 1 + (j + 1) * CUTS] = raw[:, j : j + 1] > self.cuts[j]
        return neighbours(x, sizes)

    def votes(self, raw: np.ndarray) -> np.ndarray:
        """What each line adds to the potential of itself, of the line after it and of the line before it.

        The weights of the cuts below a value are a prefix sum, so no row of the design is made.
        """
        w = self.weights.reshape(3, -1).astype(np.float64)
        out = np.repeat(w[:, :1], len(raw), axis=1)
        for j, cuts in enumerate(self.cuts):
            order = np.argsort(cuts, kind="stable")
            sums = np.zeros((3, CUTS + 1))
            np.cumsum(w[:, 1 + j * CUTS : 1 + (j + 1) * CUTS][:, order], axis=1, out=sums[:, 1:])
            out += sums[:, np.searchsorted(cuts[order], raw[:, j])]
        return out

    def potentials(self, votes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log-odds of good of each line, of its own features and its neighbours'."""
        u = votes[0].copy()
        if len(u):
            ends = np.cumsum(sizes[sizes > 0])
            inner = np.ones(len(u), dtype=bool)
            inner[ends - 1] = False
            at = np.flatnonzero(inner)
            u[at + 1] += votes[1][at]
            u[at] += votes[2][at + 1]
        return u

    def marginals(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        u, p = self.potentials(self.votes(raw), sizes), np.empty(len(raw))
        short = sizes <= LONG_CHAIN
        line = np.repeat(short, sizes)
        p[line] = forward_backward(u[line], sizes[short], self.trans)[0]
        ends = np.cumsum(sizes)
        for k in np.flatnonzero(~short):
            p[ends[k] - sizes[k] : ends[k]] = chain_marginals(u[ends[k] - sizes[k] : ends[k]], self.trans)
        return p

    def quality(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal per text; 0 where there is no line."""
        p, w = self.marginals(raw, sizes), np.expm1(raw[:, 0].astype(np.float64))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(doc, w, len(sizes))
        return np.bincount(doc, w * p, len(sizes)) / np.maximum(total, 1e-9)

    def quality_of_long(self, text: str) -> float:
        """``quality`` of one text; of a line it holds a few numbers at a time."""
        votes, w = [np.zeros((3, 0))], [np.zeros(0)]
        for raw in line_blocks(text):
            votes.append(self.votes(raw).astype(np.float32))
            w.append(np.expm1(raw[:, 0].astype(np.float64)).astype(np.float32))
        votes, w = np.concatenate(votes[1:] or votes, axis=1), np.concatenate(w[1:] or w)
        u = self.potentials(votes, np.array([len(w)]))
        del votes
        p = chain_marginals(u, self.trans)
        return float(np.dot(w, p) / max(w.sum(dtype=np.float64), 1e-9))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        q, held, chars = np.zeros(len(texts)), [], 0

        def settle():
            q[held] = self.quality(*line_features([texts[i] for i in held]))
            held.clear()

        for i, t in enumerate(texts):
            if t and len(t) > LONG_TEXT:
                q[i] = self.quality_of_long(t)
                continue
            held.append(i)
            chars += len(t or "")
            if chars > LONG_TEXT:
                settle()
                chars = 0
        if held:
            settle()
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(q) + self.shift, -30, 30)))


def chain_marginals(u: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(good) of each line of one chain; the messages are odds, carried from line to line."""
    (bb, bg), (gb, gg) = np.exp(trans - trans.max()).tolist()
    into, out = np.empty(len(u)), np.empty(len(u))
    odds = 1.0
    for at in range(0, len(u), BLOCK_LINES):  # odds of a line by those before it
        got, own = [], np.exp(np.clip(u[at : at + BLOCK_LINES].astype(np.float64), -30, 30)).tolist()
        for e in own:
            got.append(odds)
            odds *= e
            odds = (odds * gg + bg) / (odds * gb + bb)
        into[at : at + len(got)] = got
    odds = 1.0
    for at in range((len(u) - 1) // BLOCK_LINES * BLOCK_LINES, -1, -BLOCK_LINES):  # and by those after it
        got, own = [], np.exp(np.clip(u[at : at + BLOCK_LINES].astype(np.float64), -30, 30)).tolist()
        for e in reversed(own):
            got.append(odds)
            odds *= e
            odds = (odds * gg + gb) / (odds * bg + bb)
        out[at : at + len(got)] = got[::-1]
    z = np.log(into)
    z += np.log(out)
    z += np.clip(u, -30, 30)
    return 1 / (1 + np.exp(-z))


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-3, 1 - 1e-3)
    return np.log(q / (1 - q))


def forward_backward(u: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transition counts), chains of like length together."""
    p, pairs = np.zeros(len(u)), np.zeros((2, 2))
    starts = np.cumsum(sizes) - sizes
    t = np.exp(trans - trans.max())
    classes = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for c in np.unique(classes[sizes > 0]):
        rows = np.flatnonzero((classes == c) & (sizes > 0))
        n = sizes[rows]
        width = int(n.max())
        step = max(1, (1 << 22) // width)
        for at in range(0, len(rows), step):
            r, m = rows[at : at + step], n[at : at + step]
            place = starts[r][:, None] + np.minimum(np.arange(width), m[:, None] - 1)
            live = np.arange(width) < m[:, None]
            e = np.clip(u[place], -30, 30)
            e = np.stack([np.exp(-e / 2), np.exp(e / 2)], axis=2)
            a = np.empty((len(r), width, 2))
            a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            for k in range(1, width):
                x = (a[:, k - 1] @ t) * e[:, k]
                a[:, k] = x / x.sum(1, keepdims=True)
            b = np.ones((len(r), width, 2))
            for k in range(width - 2, -1, -1):
                x = (e[:, k + 1] * b[:, k + 1]) @ t.T
                x /= x.sum(1, keepdims=True)
                b[:, k] = np.where(live[:, k + 1 : k + 2], x, 1.0)
            g = a * b
            g /= g.sum(2, keepdims=True)
            p[place[live]] = g[:, :, 1][live]
            if width > 1:
                x = a[:, :-1, :, None] * t * (e * b)[:, 1:, None, :]
                x /= x.sum((2, 3), keepdims=True)
                pairs += (x * live[:, 1:, None, None]).sum((0, 1))
    return p, pairs


def train(raw: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rounds: int = 2, steps: int = 80, rate: float = 0.1, decay: float = 1e-4) -> LineCrf:
    """Fits by gradient ascent on the line labels' likelihood (Adam, full batches)."""
    if len(raw):
        low, high = np.quantile(raw, [0.001, 0.999], axis=0)
        inner = np.arange(1, CUTS // 2 + 1) / (CUTS // 2 + 1)
        cuts = np.concatenate([np.quantile(raw, np.linspace(0.05, 0.95, CUTS // 2), axis=0).T, low[:, None] + (high - low)[:, None] * inner], axis=1)
    else:
        cuts = np.zeros((len(FEATURES), CUTS))
    model = LineCrf(cuts.astype(np.float32), np.zeros(3 * (1 + cuts.size), dtype=np.float32), np.zeros((2, 2)))
    x = model.design(raw, sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    y = labels[doc].astype(float)
    same = doc[1:] == doc[:-1]
    for turn in range(rounds):
        m, v = np.zeros(len(model.weights) + 4), np.zeros(len(model.weights) + 4)
        want = np.zeros((2, 2))
        np.add.at(want, (y[:-1][same].astype(int), y[1:][same].astype(int)), 1)
        for step in range(1, steps + 1):
            p, pairs = forward_backward(x @ model.weights, sizes, model.trans)
            g = np.concatenate([(y - p).astype(np.float32) @ x, (want - pairs).ravel()]) / max(1, len(y))
            g -= decay * np.concatenate([model.weights, model.trans.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            model.weights, model.trans = (model.weights + move[:-4]).astype(np.float32), model.trans + move[-4:].reshape(2, 2)
        if turn + 1 < rounds:
            p = forward_backward(x @ model.weights, sizes, model.trans)[0]
            good = p > 0.5
            worst = np.lexsort((p, doc))[np.cumsum(sizes[sizes > 0]) - sizes[sizes > 0]]  # the worst line of each text
            good[worst] = False
            y = np.where(labels[doc] == 1, 1.0, good.astype(float))
    z = _logit(model.quality(raw, sizes))
    # both labels count alike on the fitted scale, whatever their shares
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge-bound logistic fit
        s = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        g = np.array([(share * (labels - s) * z).sum() - 1e-3 * slope, (share * (labels - s)).sum() - 1e-3 * shift])
        w = share * s * (1 - s)
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        slope, shift = slope + np.clip(d[0], -1, 1), shift + np.clip(d[1], -1, 1)
    model.slope, model.shift = float(slope), float(shift)
    return model


def held_out(id_col: str) -> Column:
    """True for the fold that training never sees; a null id is in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 3000) -> LineCrf | None:
    """A model from at most ``max_train`` labelled documents outside the held-out fold.

    The sample are the labelled ids with the least hashes.  Of an id with several
    labels the least counts, and rows that repeat an id count as documents of the
    sample, in a fixed order.  None where there are not documents of both labels.
    The driver holds 12 numbers for each line of the sample, whose number of texts
    is ``max_train``.
    """
    picked = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select(F.xxhash64("id").alias("h"), "label", "text")
    out = pa.schema([("h", pa.int64()), ("label", pa.int32()), ("raw", pa.list_(pa.float32()))])

    def run(batches):
        for b in batches:
            raw, sizes = line_features(b.column(2).to_pylist())
            ends = np.cumsum(sizes)
            yield batch(out, b.column(0), b.column(1), [raw[e - n : e].ravel() for e, n in zip(ends, sizes, strict=True)])

    # rows of one id come together, so of the last id only some may be left
    got = mapped(rows, run, "h bigint, label int, raw array<float>").orderBy("h", "label", "raw").limit(max_train).collect()
    labels_ = np.array([r.label for r in got])
    if len(set(labels_.tolist())) < 2:
        return None
    sizes = np.array([len(r.raw) // len(FEATURES) for r in got], dtype=np.int64)
    raw = np.array([v for r in got for v in r.raw], dtype=np.float32).reshape(-1, len(FEATURES))
    return train(raw, sizes, labels_)


def _scorer(model: LineCrf | None):
    return lambda cols: (model.scores(cols[0]) if model else np.full(len(cols[0]), 0.5),)


def classify(docs: DataFrame, model: LineCrf | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Null and empty texts have no good line and score lowest; without a model
    every text scores 0.5.  Each row gives a row, repeated or not, and texts of any
    length are scored whole.
    """
    rows = with_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["text"], [("score", DoubleType())], _scorer(model))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_rows(docs: DataFrame, model: LineCrf | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they were."""
    return kept_where(docs, text_col, [("score", DoubleType())], _scorer(model), F.col("score") >= threshold)
