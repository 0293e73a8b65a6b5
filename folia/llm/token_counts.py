"""Exact BPE token counts by rank-synchronous array merging.

Texts are cut into pre-tokens at places that no merge of the vocabulary can
cross: at spaces and line feeds, and between characters that no piece has side by
side.  The distinct ones of a batch are held as one ragged NumPy array of symbol
ids; each round finds every sequence's lowest-rank pair by one segmented minimum
and merges it in all sequences at once, wherever it stands in them as long as no
better pair comes up, until no sequence has a pair left.  What is counted is the surviving symbols (a symbol outside the
vocabulary counts as its UTF-8 bytes, which is the model's byte fallback).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm._text import batch, mapped

SPACE = "▁"
NONE = np.int64(1) << np.int64(62)


class PieceTable:
    """Vocabulary and merge table of a sentencepiece BPE model.

    Supports what its counts rely on: BPE with byte fallback, the identity
    normaliser, no user-defined or unused pieces, and no piece with a space
    mark after another character.  Any other model is refused.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec, kinds = m.normalizer_spec, {p.type for p in m.pieces}
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or kinds & {4, 5}:
            raise ValueError("only BPE with byte fallback and normal pieces is supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        self.dummy_prefix = spec.add_dummy_prefix
        pieces = {p.piece: p.score for p in m.pieces if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses a word boundary")
        self.ids: dict[str, int] = {p: i for i, p in enumerate(pieces)}
        self.known = len(self.ids)
        #: Line feeds occur in no piece, so they are bytes and bound pre-tokens.
        self.line_feed_apart = not any("\n" in p for p in pieces)
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        pairs = {}
        for p, score in pieces.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if (len(a) == 1 or a in pieces) and (len(b) == 1 or b in pieces):
                    pairs[(self.id(a), self.id(b))] = (order[score], self.ids[p])
        self.width = np.int64(len(self.ids) + 1)
        keys = np.array([a * int(self.width) + b for a, b in pairs], dtype=np.int64)
        at = np.argsort(keys)
        self.keys = keys[at]
        self.ranks = np.array([r for r, _ in pairs.values()], dtype=np.int64)[at]
        self.merged = np.array([p for _, p in pairs.values()], dtype=np.int64)[at]
        beside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        #: Neighbours in some piece, as code points.
        self.beside = np.unique(np.array([ord(x[0]) << 21 | ord(x[1]) for x in beside], dtype=np.int64))
        self.other = int(self.width) - 1  # any character that is in no pair and no piece

    def id(self, s: str) -> int:
        if s not in self.ids:
            self.ids[s] = len(self.ids)
        return self.ids[s]

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs of symbols; rank NONE where there is none."""
        key = np.where(b >= 0, a * self.width + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        out = np.array([self.cost(t) if len(t) == 1 else 0 for t in tokens], dtype=np.int64)
        more = [i for i, t in enumerate(tokens) if len(t) > 1]
        if more:
            out[more] = self.together([tokens[i] for i in more])
        return out

    def cost(self, c: str) -> int:
        return 1 if self.ids.get(c, self.known) < self.known else len(c.encode("utf-8", "replace"))

    def together(self, tokens: list[str]) -> np.ndarray:
        flat = "".join(tokens)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars, inverse = np.unique(points, return_inverse=True)
        names = [chr(c) for c in chars]
        sym = np.array([self.ids.get(c, self.other) for c in names], dtype=np.int64)[inverse]
        cost = np.array([self.cost(c) for c in names], dtype=np.int64)[inverse]
        lens = np.array([len(t) for t in tokens], dtype=np.int64)
        # what single symbols cost; a merge replaces two by one piece of cost 1
        total = np.add.reduceat(cost, np.cumsum(lens) - lens)
        # sequences: no piece holds two characters that none has side by side
        n = len(sym)
        seq = np.repeat(np.arange(len(tokens)), lens)
        pair = points[:-1].astype(np.int64) << 21 | points[1:]
        apart = self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] != pair
        starts = np.concatenate([[0], np.flatnonzero(apart | (seq[1:] != seq[:-1])) + 1])
        seq = seq[starts]
        lens = np.diff(np.append(starts, n))
        nxt, prv = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
        nxt[starts + lens - 1] = prv[starts] = -1
        rank, into = self.look(sym, np.where(nxt >= 0, sym[nxt], -1))
        while True:
            best = np.minimum.reduceat(rank, starts)
            live = best < NONE
            if not live.any():
                return total
            if live.sum() * 2 < len(live):  # leave out the sequences that are done
                keep = np.repeat(live, lens)
                shift = np.cumsum(keep) - 1
                sym, cost, rank, into, nxt, prv = (x[keep] for x in (sym, cost, rank, into, nxt, prv))
                nxt, prv = np.where(nxt >= 0, shift[nxt], -1), np.where(prv >= 0, shift[prv], -1)
                lens, seq, best = lens[live], seq[live], best[live]
                starts = np.cumsum(lens) - lens
                live = best < NONE
            # wherever a sequence's lowest rank stands; of matches that overlap every other one, from the left
            i = np.flatnonzero(rank == np.repeat(np.where(live, best, -1), lens))
            chained = np.concatenate([[False], nxt[i[:-1]] == i[1:]])
            head = np.flatnonzero(~chained)
            i = i[(np.arange(len(i)) - np.repeat(head, np.diff(np.append(head, len(i))))) % 2 == 0]
            j, z = nxt[i], into[i]
            k, p = nxt[j], prv[i]
            # from the left, up to the first merge that brings up a pair as good
            left = np.where(p >= 0, sym[p], -1)
            touch = np.flatnonzero(k[:-1] == i[1:]) + 1
            left[touch] = z[touch - 1]
            better = (self.look(left, z)[0] <= rank[i]) | (self.look(z, np.where(k >= 0, sym[k], -1))[0] <= rank[i])
            of = np.searchsorted(starts, i, side="right") - 1
            count = np.cumsum(better) - better
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            go = count == np.repeat(count[first], np.diff(np.append(first, len(i))))
            i, j, k, z, of = i[go], j[go], k[go], z[go], of[go]
            np.subtract.at(total, seq[of], cost[i] + cost[j] - 1)
            sym[i], cost[i], nxt[i], rank[j] = z, 1, k, NONE
            prv[k[k >= 0]] = i[k >= 0]
            rank[i], into[i] = self.look(sym[i], np.where(k >= 0, sym[k], -1))
            p = prv[i]
            i, p = i[p >= 0], p[p >= 0]
            rank[p], into[p] = self.look(sym[p], sym[i])


@lru_cache(maxsize=4)
def table(path: str) -> PieceTable:
    return PieceTable(path)


_LINES_APART, _WHOLE = re.compile(" *[^ \n]+| +"), re.compile(" *[^ ]+| +")


def pre_tokens(t: PieceTable, text: str) -> tuple[list[str], int]:
    """(pre-tokens with spaces still as spaces, line feeds left out)."""
    if not text:
        return [], 0
    text = text.replace(SPACE, " ")  # the mark itself counts as a space
    if t.dummy_prefix:
        text = " " + text
    if not t.line_feed_apart:
        return _WHOLE.findall(text), 0
    return _LINES_APART.findall(text), text.count("\n")


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, cache: int = 500_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row.

    Null and empty texts have 0 bytes and 0 tokens; ids may be null or repeat,
    each row gives a row; texts are never cut.  ``cache`` bounds the pre-tokens
    that a worker remembers.
    """
    id_type = docs.schema[id_col].dataType
    out = pa.schema([("id", pa.int64() if id_type.typeName() == "long" else pa.string()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        t, seen = table(model_path), {}
        for b in batches:
            texts = b.column(1).to_pylist()
            cut = [pre_tokens(t, x or "") for x in texts]
            new = list(set().union(*(c for c, _ in cut)) - seen.keys())
            if len(seen) + len(new) > cache:
                seen.clear()
                new = list(set().union(*(c for c, _ in cut)))
            for at in range(0, len(new), 50_000):
                part = new[at : at + 50_000]
                seen.update(zip(part, t.counts([x.replace(" ", SPACE) for x in part]).tolist(), strict=True))
            yield batch(out, b.column(0), [len((x or "").encode()) for x in texts], [n + sum(map(seen.__getitem__, c)) for c, n in cut])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if out.field("id").type == pa.string():
        picked = picked.withColumn("id", F.col("id").cast("string"))
    kind = "bigint" if out.field("id").type == pa.int64() else "string"
    got = mapped(picked, run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return got.select(F.col("id").cast(id_type).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
