"""Words, hashes and shingles shared by the operators (executor side, NumPy)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII-space words: what the counting contracts call words.
WORDS = re.compile(r"[^ \t-\r]+")
#: Letters and digits only: what similarity compares, so that punctuation and
#: case don't tell texts apart.
PLAIN_WORDS = re.compile(r"\w+")

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection of 64-bit words."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it holds too many words."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def plain_words(text: str | None) -> list[str]:
    return PLAIN_WORDS.findall(text.lower()) if text else []


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, in order; a shorter text is one run."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = mix(h ^ words[k : len(words) - n + 1 + k])
    return h


def mapped(df, fn, schema, **more):
    """``df.mapInArrow`` over slices that hold a bounded number of characters.

    ``fn`` takes an iterator of record batches.  Arrow batches hold up to 10,000
    rows; texts may be long, so each is cut into slices of about 16 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        return fn(sliced(batches))

    return df.mapInArrow(run, schema, **more)


def sliced(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, min(b.num_rows, int(b.num_rows * most / max(1, b.nbytes))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def with_columns(df, inputs: list[str], new, compute):
    """``df`` with the fields ``new`` (a list of (name, Spark type)) appended.

    ``compute(lists)`` gets one Python list per input column and returns one
    sequence per new field.  All other columns pass through as Arrow arrays, so
    rows need no key and no join.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    added = StructType([StructField(n, t) for n, t in new])
    types = to_arrow_schema(added).types
    where = [df.columns.index(c) for c in inputs]

    def run(batches):
        for b in batches:
            got = compute([b.column(i).to_pylist() for i in where])
            cols = [*b.columns, *(pa.array(v, t) for v, t in zip(got, types, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *(n for n, _ in new)])

    return mapped(df, run, StructType([*df.schema.fields, *added.fields]))


def kept_where(docs, text_col: str, new, compute, condition):
    """The rows of ``docs`` for which ``condition`` holds over the fields ``new`` of the text, all columns as they were.

    The columns go by other names meanwhile, so none can clash with a new field.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    got = with_columns(plain, [f"c{docs.columns.index(text_col)}"], new, compute)
    return got.where(condition).select(*plain.columns).toDF(*docs.columns)
