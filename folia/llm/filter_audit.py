"""How the filters of a chain interact: a packed bitmap index over filters, labels and parts.

Each document has a bit per filter that it fails.  A task packs the bits of the
documents it reads into NumPy bitsets, laid out part by part so that no byte
holds documents of two parts; for each subset of the filters it clears the
documents that fail one of the subset (AND-NOT), and counts the bits that are
left (popcount), once alone and once under each label.  Counts of tasks are
summed.  All orders of the filters follow from these 2^5 survivor counts: the
documents that a step removes are the survivors of the filters before it less
the survivors of those and its own.

**Defined results.**  A null text is an empty one; a null part (lang) is the
part ''.  A document with a null id has no smaller id to repeat and is no
smaller document either, and no label.  Rows that repeat an id count each, as
they are.  Of several label rows of a document, one with the label 1 suffices.
An empty table has no parts and gives no rows.  Ties can't occur: nothing is
ranked.  Only the named columns are read, so extra columns don't matter.  Long
texts are cut into words piece by piece; what is held is their distinct words.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm._store import staged, unused
from folia.llm._text import batch, mapped

FILTERS = "ABCDE"
#: Texts longer than this are cut into words one by one.
PIECE = 1 << 20

_WORD = re.compile(rb"[^ \t-\r]+")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = re.compile(rb"[#$%&*|]")


def word_counts(text: bytes) -> tuple[int, int]:
    """(words, distinct words) of a text."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    n, seen = 0, set()
    for m in _WORD.finditer(text):
        n += 1
        seen.add(m[0])
    return n, len(seen)


def failed(text: bytes, chars: int) -> int:
    """Bits 0 to 3 are set where the text, of so many code points, fails A to D."""
    n, distinct = word_counts(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * upper > 3 * chars) << 2 | bool(_SIGNS.search(text)) << 3


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, failed (bits of A to D), digest (SHA-256 of the text), a row for each of ``docs``."""
    out = pa.schema([("id", pa.int64()), ("part", pa.string()), ("failed", pa.int32()), ("digest", pa.binary())])

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            yield batch(out, b.column(0), b.column(1), list(map(failed, texts, b.column(3).to_pylist())), [hashlib.sha256(t).digest() for t in texts])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = picked.select("id", "part", F.col("text").cast("binary"), F.char_length("text").alias("chars"))
    return mapped(picked, run, "id bigint, part string, failed int, digest binary")


def _sum_names(n: int) -> list[str]:
    return [f"{k}{s}" for k in ("all", "good", "toxic") for s in range(n)]


def survivor_counts(flagged: DataFrame, n_filters: int) -> DataFrame:
    """part, then three arrays all, good, toxic: documents of the part that no filter of subset s (a bit mask, its place in the array) removes.

    ``flagged`` has part, failed (a bit per filter), good and toxic (0 or 1).
    """
    subsets = 1 << n_filters
    names = _sum_names(subsets)
    out = pa.schema([("part", pa.string()), *((c, pa.int64()) for c in names)])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column(0).dictionary_encode()
            bits, good, toxic = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            part = parts.indices.to_numpy(zero_copy_only=False)
            sizes = np.bincount(part, minlength=len(parts.dictionary))
            starts = np.concatenate([[0], np.cumsum((sizes + 7) // 8)])  # in bytes: a part begins with a byte of its own
            order = np.argsort(part, kind="stable")
            place = np.empty(len(part), dtype=np.int64)
            place[order] = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            place += 8 * starts[part]

            def packed(mask):
                flat = np.zeros(8 * starts[-1], dtype=bool)
                flat[place[mask]] = True
                return np.packbits(flat)

            fails = [packed(bits >> f & 1 == 1) for f in range(n_filters)]
            labels = [packed(np.ones(len(part), dtype=bool)), packed(good == 1), packed(toxic == 1)]
            left = [np.full(starts[-1], 255, dtype=np.uint8)]
            for s in range(1, subsets):
                top = s.bit_length() - 1
                left.append(left[s ^ 1 << top] & ~fails[top])
            counts = [np.add.reduceat(np.bitwise_count(x & kind).astype(np.int64), starts[:-1]) for kind in labels for x in left]
            yield batch(out, parts.dictionary, *counts)

    # few columns of few bytes: slices of 10,000 rows are bounded as they are
    tasks = flagged.select("part", "failed", "good", "toxic").mapInArrow(run, "part string, " + ", ".join(f"{c} bigint" for c in names))
    sums = tasks.groupBy("part").agg(*(F.sum(c).alias(c) for c in names))
    return sums.select("part", *(F.array(*(c for c in names if c.startswith(k))).alias(k) for k in ("all", "good", "toxic")))


def first_of_each(rows: DataFrame) -> DataFrame:
    """digest, id: the least id of each text.  Sums of tasks are shuffled, so a text that very many rows have is no hot key."""
    return rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id"))


def flags(rows: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """The rows of ``marks`` as part, failed (with the bit of E), good, toxic.

    A row fails E unless it has its text's least id; the two are joined by text
    and id, so the copies of one text are spread over all tasks by their ids.
    """
    first = first_of_each(rows).withColumn("is_first", F.lit(True))
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marked = labels.select(F.col(label_id).cast("long").alias("id"), "quality", "toxic").where("id is not null").groupBy("id").agg(one("quality"), one("toxic"))
    copy = (F.col("is_first").isNull() & F.col("id").isNotNull()).cast("int") * (1 << FILTERS.index("E"))
    got = rows.join(first, ["id", "digest"], "left").select("id", "part", (F.col("failed") + copy).alias("failed")).join(marked, "id", "left")
    return got.select("part", "failed", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, mask of the filters before the step, filter) of all orders."""
    return [("".join(p), k + 1, sum(1 << filters.index(x) for x in p[:k]), filters.index(p[k])) for p in permutations(filters) for k in range(len(p))]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row per part, order and step.

    The marks of documents (some 60 bytes each) are staged; texts are read once and never shuffled.
    """
    rows = staged(marks(docs, id_col, text_col, part_col), "filter-marks")
    return by_order(survivor_counts(flags(rows, labels), len(FILTERS)))


def by_order(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The steps of all orders, from the survivor counts of each part: a fixed number of rows a part."""
    full = (1 << len(filters)) - 1
    at = lambda kind, mask: F.col(kind)[mask]
    # a filter's place in all orders: |S|! (n - 1 - |S|)! of them have just S before it
    fact = [1, 1, 2, 6, 24, 120, 720, 5040]
    per_filter = []
    for f in range(len(filters)):
        rest = [s for s in range(full + 1) if not s >> f & 1]
        weight = {s: fact[s.bit_count()] * fact[len(filters) - 1 - s.bit_count()] for s in rest}
        shapley = sum(((at("all", s) - at("all", s | 1 << f)) * weight[s] for s in rest), F.lit(0).cast("long"))
        per_filter.append(F.struct((at("all", 0) - at("all", 1 << f)).alias("fails"), (at("all", full ^ 1 << f) - at("all", full)).alias("unique_fails"), shapley.alias("shapley")))
    (totals,) = unused(["part", "all", "good", "toxic"], "totals")
    steps = F.explode(F.from_json(F.lit(_steps_json(filters)), "array<struct<filter_order:string,step:int,before:int,after:int,f:int>>")).alias("o")
    each = counts.select("part", "all", "good", "toxic", F.array(*per_filter).alias(totals)).select("*", steps)
    gone = lambda kind: F.col(kind)[F.col("o.before")] - F.col(kind)[F.col("o.after")]
    of = F.col(totals)[F.col("o.f")]
    return each.select(
        "part", "o.filter_order", "o.step", F.col("all")[F.col("o.after")].alias("kept"), gone("all").alias("removed"), (of["fails"] - gone("all")).alias("redundant"),
        of["unique_fails"].alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), of["shapley"].alias("shapley"),
    )


def _steps_json(filters: str) -> str:
    import json

    return json.dumps([{"filter_order": o, "step": k, "before": m, "after": m | 1 << f, "f": f} for o, k, m, f in orders(filters)])
