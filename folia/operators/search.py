"""Filters, vector top-k, k-nearest-neighbour joins and ranking."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.vectors import cosine, literal


def criteria(wanted: dict) -> Column:
    """A conjunction: lists are IN, ``exclude_<column>`` is NOT IN, ``metadata`` matches JSON fields, the rest is equality."""
    tests = [F.lit(True)]
    for k, v in wanted.items():
        if k == "metadata":
            tests += [F.get_json_object("metadata", f"$.{f}") == (str(x).lower() if isinstance(x, bool) else str(x)) for f, x in v.items()]
        elif k.startswith("exclude_"):
            c = F.col(k.removeprefix("exclude_"))
            tests.append(c.isNull() | ~c.isin(list(v)))
        elif isinstance(v, list | tuple | set):
            tests.append(F.col(k).isin(list(v)))
        else:
            tests.append(F.col(k) == v)
    return reduce(lambda a, b: a & b, tests)


def find(rows: DataFrame, wanted: dict, limit: int = 100, order: str = "doc_id") -> DataFrame:
    """The first rows, in a defined order, that meet the criteria."""
    return rows.where(criteria(wanted)).orderBy(order).limit(limit)


def containing(rows: DataFrame, column: str, text: str) -> DataFrame:
    """Case-insensitive substring; % and _ are ordinary characters."""
    return rows.where(F.contains(F.lower(F.col(column)), F.lit(text.lower())))


def top_k(vectors: DataFrame, query: list[float], k: int = 10, wanted: dict | None = None, key: str = "element_pk", column: str = "embedding", min_score: float | None = None) -> DataFrame:
    """key, score of the nearest rows of the query's dimension; ties by key.

    Filters reach the scan; each task keeps k rows (TakeOrderedAndProject).
    """
    rows = vectors.where(criteria(wanted or {}) & (F.size(column) == len(query)))
    scored = rows.select(key, cosine(F.col(column), literal(query)).alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), key).limit(k)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int = 20, key: str = "element_pk", column: str = "embedding", group: str | None = None, threshold: float | None = None, block: int = 16_384, corpus_block: int = 65_536) -> DataFrame:
    """source, target, score: each query's k nearest corpus rows, exactly; equal scores by key.

    Both sides are cut into blocks by a hash of their key; a task multiplies one
    block of queries with one of the corpus and gives k rows a query, which are
    merged by query.  Nothing passes the driver but the two sizes.  With ``group``
    a row of the query's own group isn't a neighbour; vectors of other dimensions
    never are.
    """
    kin = F.col(group).cast("string") if group else F.lit(None).cast("string")
    # floats are shuffled as floats and become doubles where they are multiplied
    kind = "array<float>" if {df.schema[column].dataType.simpleString() for df in (queries, corpus)} == {"array<float>"} else "array<double>"
    side = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(column).cast(kind).alias("v"), kin.alias("kin")).where(F.col(column).isNotNull())
    q, c = side(queries), side(corpus)
    n_q, n_c = (max(1, -(-df.count() // size)) for df, size in ((q, block), (c, corpus_block)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = q.select("*", F.lit(True).alias("asks"), place(n_q).alias("i"), every(n_c).alias("j")).unionByName(c.select("*", F.lit(False).alias("asks"), every(n_q).alias("i"), place(n_c).alias("j")))
    schema = pa.schema([("source", pa.int64()), ("target", pa.int64()), ("score", pa.float64())])

    def side_of(t: pa.Table, width: int) -> _Side:
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        own = t["id"].to_numpy()
        by = np.argsort(own, kind="stable")
        return _Side(own[by], v[by], t["kin"].to_numpy()[by])

    def nearest(table: pa.Table) -> pa.Table:
        # groups by number, null as one more
        kin = pc.fill_null(table["kin"].combine_chunks().dictionary_encode().indices, -1)
        table = table.set_column(table.schema.get_field_index("kin"), "kin", kin)
        asks, sizes, out = table["asks"].to_numpy(), pc.list_value_length(table["v"]).to_numpy(), []
        for width in np.unique(sizes[sizes > 0]).tolist():
            at = sizes == width
            if (at & asks).any() and (at & ~asks).any():
                out += _nearest(*(side_of(table.filter(pa.array(at & x)), width) for x in (asks, ~asks)), k, bool(group), -np.inf if threshold is None else threshold)
        return pa.table([np.concatenate([x[i] for x in out]) if out else pa.array([], f.type) for i, f in enumerate(schema)], schema=schema)

    found = rows.groupBy("i", "j").applyInArrow(nearest, "source bigint, target bigint, score double")
    best = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


class _Side:
    """One side of two blocks: keys in order, vectors, groups by number, norms."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, kin: np.ndarray):
        self.ids, self.v, self.kin = ids, v, kin
        self.norm = np.concatenate([np.sqrt(_dot(x, x)) for x in np.split(v, range(16_384, len(v), 16_384))])

    def units(self, at: slice) -> np.ndarray:
        n = self.norm[at, None]
        return self.v[at] / np.where(n, n, 1)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added in the order of their elements: equal rows give equal sums, wherever they stand."""
    return np.cumsum(a.astype(np.float64) * b, axis=1)[:, -1]


def _nearest(q: _Side, c: _Side, k: int, apart: bool, floor: float, few: int = 256, tile: int = 4096, slack: float = 1e-9) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(source, target, score) of the k best rows of ``c`` for some queries at a time.

    A product of matrices, whose last bits follow the place of a row, names what may
    be among the k best; these are scored again one by one, and ranked by that.
    """
    out = []
    for lo in range(0, len(q.ids), few):
        part = slice(lo, lo + few)
        units, ids, kin = q.units(part), q.ids[part], q.kin[part]
        least, best = np.full(len(ids), floor), None
        for start in range(0, len(c.ids), tile):
            cols = slice(start, start + tile)
            s = units @ c.units(cols).T
            edge = least
            if best is None and k < s.shape[1]:
                own = ids[:, None] == c.ids[None, cols]
                first = np.where(own | (kin[:, None] == c.kin[None, cols]) if apart else own, -np.inf, s)
                first[~np.isfinite(first)] = -np.inf
                edge = np.maximum(least, np.partition(first, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            r, t = np.nonzero((s >= edge[:, None] - slack) & np.isfinite(s))
            t += start
            other = ids[r] != c.ids[t]
            if apart:
                other &= kin[r] != c.kin[t]
            r, t = r[other], t[other]
            if not len(r):
                continue
            score = np.concatenate([_dot(q.v[lo + r[x : x + 65_536]], c.v[t[x : x + 65_536]]) for x in range(0, len(r), 65_536)])
            norm = q.norm[lo + r] * c.norm[t]
            score = np.divide(score, norm, out=np.zeros_like(score), where=norm != 0)
            at = score >= least[r]
            r, t, score = (np.concatenate([*old, new[at]]) for old, new in zip(zip(best) if best else ((), (), ()), (r, t, score), strict=True))
            order = np.lexsort((t, -score, r))
            order = order[np.arange(len(order)) - np.searchsorted(r[order], r[order]) < k]
            best = r, t, score = r[order], t[order], score[order]
            n = np.bincount(r, minlength=len(ids))
            least[n == k] = score[np.cumsum(n)[n == k] - 1]
        if best:
            out.append((ids[best[0]], c.ids[best[1]], best[2]))
    return out


def hybrid_rank(text_hits: DataFrame, vector_hits: DataFrame, k: int = 10, key: str = "element_pk", text_weight: float = 0.3, vector_weight: float = 0.7, text_scale: float = 10.0, on: str | None = None) -> DataFrame:
    """key, score: 0.3 of the text score over ten and 0.7 of the vector score; a missing side is 0.

    With ``on`` text hits are of what vector hits belong to, by that column, such as
    their documents: each vector hit is ranked, in one join, and no other key.
    """
    t = text_hits.select(on or key, F.col("score").alias("t"))
    v = vector_hits.select(key, *([on] if on else []), F.col("score").alias("v"))
    rows = v.join(t, on, "left") if on else t.join(v, key, "full")
    score = text_weight * (F.coalesce("t", F.lit(0.0)) / text_scale) + vector_weight * F.coalesce("v", F.lit(0.0))
    return rows.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def best_per_document(hits: DataFrame, key: str = "element_pk") -> DataFrame:
    """doc_id and its best hit; of equal scores the least key."""
    return hits.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col(key)).alias("k"))).alias("b")).select("doc_id", (-F.col("b.k")).alias(key), F.col("b.score").alias("score"))


def document_sources(hits: DataFrame, documents: DataFrame) -> DataFrame:
    return hits.join(documents.select("doc_id", "source"), "doc_id").where("source <> ''").select("source").distinct()


def capped(limit: int | None, min_score: float | None, most: int = 100) -> tuple[int, float]:
    """A service's bounds on what a caller asks for: at most ``most`` rows, no score below 0."""
    return min(10 if limit is None else limit, most), max(0.0 if min_score is None else min_score, 0.0)


def flattened(paths: DataFrame, hits: DataFrame, elements: DataFrame) -> DataFrame:
    """Hits as flat rows with their path and score, sorted by path."""
    rows = elements.join(paths.select("element_id", "path"), "element_id").join(hits.select("element_id", "score"), "element_id")
    return rows.orderBy("path")
