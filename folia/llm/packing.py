"""Concatenate-and-cut packing by two-pass prefix sums.

Pass 1 tokenises every document once and stages the ids with each partition's
running total.  The partition totals (one row a partition, summed in two levels)
give each partition its global offset.  Pass 2 cuts the global token stream into
fixed windows; a document that spans a window edge gives a boundary record, so
each piece says which ids of which document lie where in which sequence.
"""

from __future__ import annotations

import operator
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.llm._store import staged
from folia.llm._text import batch, mapped, sliced

#: Partitions whose totals one task sums up.
FAN = 4096


@lru_cache(maxsize=4)
def _encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def chunks(text: str | None) -> list[str]:
    """A text cut at spaces and line feeds, which are white space to every rule of
    the vocabulary, so nothing crosses them; chunks may be empty."""
    return text.replace("\n", " ").split(" ") if text else []


#: A run of Latin letters and the marks after it: the vocabulary's rules cut there
#: whatever stands around, so the two parts have ids of their own.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?*%&$#|]*)")


class ChunkIds(dict):
    """chunk of text -> its ids as little-endian bytes, for the chunks of a batch.

    The parts of chunks are remembered from batch to batch, one memory a worker;
    when there are over ``most``, those that the batch doesn't have are forgotten.
    """

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        self.path, self.most, self.parts = path, most, {}
        last = [i for t, i in _encoder(path).get_vocab().items() if t.endswith("</w>")]
        self.last = np.zeros(max(last, default=0) + 1 << 1, dtype=bool)
        self.last[last] = True

    def _one(self, part: str) -> bytes:
        return np.array(_encoder(self.path).encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_parts(self, new: list[str]) -> None:
        """Many parts in one call: each ends with the one id in it that ends a word."""
        groups = [new[at : at + 500] for at in range(0, len(new), 500)]
        for at in range(0, len(groups), 40):
            some = groups[at : at + 40]
            for words, e in zip(some, _encoder(self.path).encode_batch_fast(["\n".join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(words):
                    data, cut = ids.tobytes(), [0, *(4 * ends).tolist()]
                    self.parts.update((w, data[cut[i] : cut[i + 1]]) for i, w in enumerate(words))
                else:
                    self.parts.update((w, self._one(w)) for w in words)

    def learn(self, chunks: set[str]) -> None:
        self.clear()
        # lists of strings only: tuples by the hundred thousand would keep the garbage collector busy
        whole, letters, marks, others = [], [], [], []
        for c in chunks:
            m = _SIMPLE.fullmatch(c)
            if m:
                whole.append(c)
                letters.append(m[1].lower())
                marks.append(m[2])
            else:
                others.append(c)
        need = set(letters)
        need.update(marks)
        if len(self.parts) > self.most:
            self.parts = {p: v for p, v in self.parts.items() if p in need}
        self.parts[""] = b""
        self._learn_parts(list(need - self.parts.keys()))
        get = self.parts.__getitem__
        self.update(zip(whole, map(operator.add, map(get, letters), map(get, marks)), strict=True))
        self.update((c, self._one(c) if c else b"") for c in others)


@lru_cache(maxsize=4)
def _chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """id, ids (little-endian uint32), n, pid, before (tokens of the partition before this row)."""
    out = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("pid", pa.int64()), ("before", pa.int64())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        seen, pid, before = _chunk_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        for b in sliced(batches, 8 << 20):
            cut = [chunks(x) for x in b.column(1).to_pylist()]
            seen.learn(set().union(*cut))
            ids = [b"".join(map(seen.__getitem__, c)) + end for c in cut]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            yield batch(out, b.column(0), ids, n, np.full(len(n), pid), before + np.cumsum(n) - n)
            before += int(n.sum())

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return mapped(picked, run, "id bigint, ids binary, n bigint, pid bigint, before bigint")


def partition_offsets(rows: DataFrame) -> DataFrame:
    """pid, base: tokens in all partitions before; a prefix sum in two levels."""
    totals = rows.groupBy("pid").agg(F.sum("n").alias("total")).withColumn("block", F.col("pid").cast("long").bitwiseAND(-FAN))
    blocks = totals.groupBy("block").agg(F.sum("total").alias("all"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row for every FAN partitions
    blocks = blocks.select("block", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("inner", F.coalesce(F.sum("total").over(inside), F.lit(0))).join(blocks, "block").select("pid", (F.col("base") + F.col("inner")).alias("base"))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, length: int = 4096) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A null or empty text is the end id alone.  Each row of ``docs`` is packed,
    repeated rows too.  All sequences are full but the last.
    """
    rows = staged(tokenised(docs, tokenizer_path, id_col, text_col, end_id), "packing-ids")
    # a few bytes for each partition of the scan: a broadcast that is bounded by the number of files
    placed = rows.join(F.broadcast(partition_offsets(rows)), "pid").select("id", "ids", "n", (F.col("base") + F.col("before")).alias("at"))
    out = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])

    def run(batches):
        for b in batches:
            got = [[] for _ in out]
            for doc, ids, n, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                start = 0
                while start < n:
                    seq, off = divmod(at + start, length)
                    size = min(n - start, length - off)
                    piece = ids[4 * start : 4 * (start + size)]
                    for c, v in zip(got, (doc, start, size, zlib.crc32(piece), n, seq, off, piece), strict=True):
                        c.append(v)
                    start += size
            yield batch(out, *got)

    return mapped(placed, run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
