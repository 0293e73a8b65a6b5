"""Trees of whole documents: interval labels, ancestors, paths and outlines in one shuffle each.

Elements are dealt by document and sorted; a task takes the documents that a batch
holds whole and follows all their parent links at once, level by level in memory.
What a document has of elements is in one task, as it was when it was parsed from
one row; other documents don't add to it.

Parents are elements of the same document.  Elements that no root reaches (below a
missing parent, or on a cycle) have no label and no path; the ancestors of such an
element are those up to the missing one, or up to where the cycle closes.  Of
repeated element ids the first counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

_text, _int, _long = pa.string(), pa.int32(), pa.int64()
LABELS = pa.schema({"doc_id": _text, "element_id": _text, "pre": _long, "last": _long, "depth": _int, "place": _int})
ANCESTRY = pa.schema({"element_id": _text, "ancestor_id": _text, "distance": _int})
PATHS = pa.schema({"element_id": _text, "depth": _int, "path": _text})
OUTLINE = pa.schema({"element_id": _text, "score": pa.float64(), "doc_id": _text, "parent_id": _text, "element_type": _text})


def whole_documents(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema: pa.Schema) -> DataFrame:
    """``run`` over tables that hold all rows of their documents (column doc_id)."""
    rows = rows.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(b.schema.get_field_index("doc_id"))
            cut = pc.index(ids, ids[-1]).as_py()
            if cut or held and held[-1].column(held[-1].schema.get_field_index("doc_id"))[-1] != ids[-1]:
                yield from run(pa.Table.from_batches([*held, b.slice(0, cut)])).to_batches()
                held = []
            held.append(b.slice(cut))
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(go, from_arrow_schema(schema))


class Forest:
    """Parents of the elements of some documents as places in their table; -1 for none, -2 for one that is missing."""

    def __init__(self, ids: pa.ChunkedArray, parents: pa.ChunkedArray):
        self.ids = ids.combine_chunks()
        up = pc.index_in(parents.combine_chunks(), value_set=self.ids).fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int64)
        up[parents.combine_chunks().is_null().to_numpy(zero_copy_only=False)] = -1
        first = pc.index_in(self.ids, value_set=self.ids).to_numpy(zero_copy_only=False)
        self.repeated = first != np.arange(len(first))
        self.up = up
        self.depth = np.full(len(up), -1, dtype=np.int64)
        self.levels = []  # the places at each depth, parents first
        level = np.flatnonzero((up == -1) & ~self.repeated)
        order = np.argsort(up, kind="stable")
        above = up[order]
        while len(level):
            self.depth[level] = len(self.levels)
            self.levels.append(level)
            lo, hi = np.searchsorted(above, level), np.searchsorted(above, level, side="right")
            count = hi - lo
            level = order[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            level = level[~self.repeated[level]]

    def ancestors(self, start: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of ``start``, the ancestor's place, distance): itself first, then upwards."""
        which, at, d, out = np.arange(len(start)), start, 0, []
        lost = np.flatnonzero(self.depth[start] < 0)  # may run into a cycle
        which, at = np.delete(which, lost), np.delete(at, lost)
        while len(at):
            out.append((which, at, np.full(len(at), d)))
            if d == most:
                break
            d, at = d + 1, self.up[at]
            which, at = which[at >= 0], at[at >= 0]
        for w in lost.tolist():
            seen, x = [], int(start[w])
            while x >= 0 and x not in seen and (most is None or len(seen) <= most):
                seen.append(x)
                x = int(self.up[x])
            out.append((np.full(len(seen), w), np.array(seen), np.arange(len(seen))))
        return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0, dtype=np.int64) for i in range(3))


def _by_schema(schema: pa.Schema, *columns) -> pa.Table:
    return pa.table([pa.array(c, t) if isinstance(c, np.ndarray | list) else c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def labelled(elements: DataFrame) -> DataFrame:
    """doc_id, element_id, pre, last, depth, place: numbers in pre-order, of the last element below, of levels above, and among siblings from 1.

    x is below y in their document if ``y.pre < x.pre <= y.last``.  Siblings come by ord.
    """

    def run(t: pa.Table) -> pa.Table:
        f = Forest(t["element_id"], t["parent_id"])
        n = len(f.up)
        size, doc = np.ones(n, dtype=np.int64), t["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        for level in reversed(f.levels[1:]):
            np.add.at(size, f.up[level], size[level])
        ord_ = t["ord"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        pre, place = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for d, level in enumerate(f.levels):
            above = f.up[level] if d else -1 - doc[level].astype(np.int64)  # the roots of a document are siblings
            level = level[np.lexsort((level, ord_[level], above))]
            above = f.up[level] if d else -1 - doc[level].astype(np.int64)
            head = np.flatnonzero(np.append(True, above[1:] != above[:-1])) if len(level) else np.empty(0, dtype=np.int64)
            run_ = np.diff(np.append(head, len(level)))
            before = np.cumsum(size[level]) - size[level]
            before -= np.repeat(before[head], run_)
            place[level] = np.arange(len(level)) - np.repeat(head, run_) + 1
            pre[level] = before + (pre[above] + 1 if d else 0)
        has = np.flatnonzero(pre >= 0)
        return _by_schema(LABELS, t["doc_id"].take(has), t["element_id"].take(has), pre[has], (pre + size - 1)[has], f.depth[has], place[has])

    return whole_documents(elements.select("doc_id", "element_id", "parent_id", F.col("ord").cast("long").alias("ord")), run, LABELS)


def _with_hits(hits: DataFrame, elements: DataFrame, *columns: str) -> DataFrame:
    """The elements, and the hits among them as rows of their own, both with doc_id."""
    if "doc_id" not in hits.columns:
        hits = hits.join(elements.select("element_id", "doc_id").distinct(), "element_id")
    e = elements.select("doc_id", "element_id", "parent_id", *columns, F.lit(False).alias("hit"))
    return e.unionByName(hits.select("doc_id", "element_id", F.lit(True).alias("hit"), *(["score"] if "score" in hits.columns else [])), allowMissingColumns=True)


def ancestry(hits: DataFrame, elements: DataFrame, max_depth: int | None = None) -> DataFrame:
    """element_id, ancestor_id, distance: each hit's ancestors, itself at distance 0.  Cycles end where they close."""
    def run(t: pa.Table) -> pa.Table:
        hit = t["hit"].combine_chunks()
        own, asked = t.filter(pc.invert(hit)), t.filter(hit)
        f = Forest(own["element_id"], own["parent_id"])
        start = pc.index_in(asked["element_id"].combine_chunks(), value_set=f.ids)
        known = start.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        which, at, d = f.ancestors(known, max_depth)
        return _by_schema(ANCESTRY, f.ids.take(pa.array(known[which])), f.ids.take(pa.array(at)), d)

    return whole_documents(_with_hits(hits.select("element_id", *(["doc_id"] if "doc_id" in hits.columns else [])), elements), run, ANCESTRY)


def paths(elements: DataFrame, max_depth: int | None = None) -> DataFrame:
    """element_id, depth, path: the document and the chain of ids down to each element."""
    def run(t: pa.Table) -> pa.Table:
        f = Forest(t["element_id"], t["parent_id"])
        ids, docs, path = f.ids.to_pylist(), t["doc_id"].to_pylist(), [None] * len(f.up)
        got = [i for level in f.levels[: None if max_depth is None else max_depth + 1] for i in level.tolist()]
        for i in got:
            up = f.up[i]
            path[i] = f"{docs[i] if up < 0 else path[up]}/{ids[i]}"
        return _by_schema(PATHS, [ids[i] for i in got], f.depth[got], [path[i] for i in got])

    return whole_documents(elements.select("doc_id", "element_id", "parent_id"), run, PATHS)


def outline(hits: DataFrame, elements: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The hits and all their ancestors, once each; those that aren't hits have no score.  Of a hit's scores the highest counts."""
    def run(t: pa.Table) -> pa.Table:
        hit = t["hit"].combine_chunks()
        own, asked = t.filter(pc.invert(hit)), t.filter(hit)
        f = Forest(own["element_id"], own["parent_id"])
        at = pc.index_in(asked["element_id"].combine_chunks(), value_set=f.ids)
        fine = at.is_valid().to_numpy(zero_copy_only=False)
        start = at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        score = np.full(len(f.up), np.nan)
        np.fmax.at(score, start, asked["score"].to_numpy()[fine].astype(float))
        nodes = np.unique(f.ancestors(np.unique(start), max_depth)[1])
        o = own.take(pa.array(nodes))
        return _by_schema(OUTLINE, o["element_id"], pa.array(score[nodes], from_pandas=True), o["doc_id"], o["parent_id"], o["element_type"])

    return whole_documents(_with_hits(hits.select("element_id", F.col("score").cast("double").alias("score"), *(["doc_id"] if "doc_id" in hits.columns else [])), elements, "element_type"), run, OUTLINE)


def subtree(labels: DataFrame, doc_id: str, pre: int, last: int) -> DataFrame:
    """What is below an element of known label, itself first: a range of the table, which reaches the scan."""
    return labels.where((F.col("doc_id") == doc_id) & F.col("pre").between(pre, last)).orderBy("pre")
