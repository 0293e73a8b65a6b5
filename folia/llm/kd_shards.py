"""Shards of near equal bytes by a k-d tree over the metadata of documents.

A document is a point: one coordinate for each metadata dimension (language,
source, size, id), scaled to 32 bits between the least and greatest value of the
table.  A node of the tree that is to give k shards is cut across the dimension
in which its points lie widest, at the weighted median: where the bytes on the
left are as near to (k // 2) / k of the node's as a cut can bring them.  So it
goes on until each leaf holds the target bytes.  Documents that agree in the
dimension of a cut are ordered by hashes of their texts and then of their rows,
so a source that has a third of all rows is cut like any other.

Medians are exact and distributed: tasks sum the bytes of all nodes of a level in
buckets of the key range; the bucket that holds the median is cut again between
its least and greatest key, until it has one key or less than a
``tolerance`` of a shard's bytes.  The driver gets at most ``BUCKETS`` sums for
each node and dimension, whatever the number of documents.

**Defined results.**  A null text has no bytes (its size is the 16 of each row)
and the crc32 of no bytes.  A null value of a dimension lies below all others.
Repeated rows are placed one by one.  Where there are fewer rows than shards some
shards are empty; an empty table gives no rows.  Only the named columns are read.
A text is measured in the JVM and goes nowhere; a row that is larger than a
shard's share makes its shard larger.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from folia.llm._store import dropped, row_numbers, staged
from folia.llm._text import batch, mix

#: The dimension that stands for the measured size of the text.
BYTES = "(bytes)"
DIMENSIONS = ("lang", "source", BYTES, "doc_id")
#: Bytes of a row besides its text.
ROW_BYTES = 16
#: Ranges into which a node's keys are counted at once.
BUCKETS = 256
#: Bits of a coordinate, and of the order among equal coordinates.
COORDINATE, TIE = 32, 31


def measured(docs: DataFrame, id_col: str, text_col: str, dims: tuple[str, ...]) -> DataFrame:
    """id, size, crc and d0, d1, ...: strings of up to 64 characters, or doubles."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text) + ROW_BYTES

    def dimension(name: str):
        if name == BYTES:
            return F.log2(size.cast("double"))
        if isinstance(kinds[name], NumericType):
            return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        return F.substring(F.col(name).cast("string"), 1, 64)

    return docs.select(F.col(id_col).cast("long").alias("id"), size.cast("long").alias("size"), F.crc32(text).alias("crc"), *(dimension(d).alias(f"d{i}") for i, d in enumerate(dims)))


@dataclass
class Scale:
    """One dimension's values as whole numbers from 1 to 2^32 - 1 in the same order; null is 0."""

    lo: object
    hi: object
    skip: int = 0

    @classmethod
    def of(cls, lo, hi) -> Scale:
        if not isinstance(lo, str):
            return cls(lo, hi)
        a, b = lo.encode(), hi.encode()
        skip = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return cls(*(int.from_bytes(x[skip : skip + 8].ljust(8, b"\0"), "big") for x in (a, b)), skip)

    def numbers(self, column: pa.Array) -> np.ndarray:
        values = column.dictionary_encode()
        codes = np.array([self._number(v) for v in values.dictionary.to_pylist()] + [0], dtype=np.int64)
        return codes[values.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)]

    def _number(self, v) -> int:
        if isinstance(v, str):
            v = int.from_bytes(v.encode()[self.skip : self.skip + 8].ljust(8, b"\0"), "big")
        if self.hi == self.lo:
            return 1
        top = (1 << COORDINATE) - 2
        if isinstance(v, float):
            return 1 + min(top, max(0, int((v - self.lo) / (self.hi - self.lo) * top)))
        return 1 + (v - self.lo) * top // (self.hi - self.lo)


def scales(rows: DataFrame, n_dims: int) -> list[Scale]:
    ends = rows.agg(*(f(f"d{i}") for i in range(n_dims) for f in (F.min, F.max))).first()
    return [Scale.of(ends[2 * i], ends[2 * i + 1]) if ends[2 * i] is not None else Scale(0, 0) for i in range(n_dims)]


def points(rows: DataFrame, by: list[Scale]) -> DataFrame:
    """id, size, crc, tie and c0, c1, ... of each row of ``measured``."""
    n = len(by)
    names = ["id", "size", "crc", "tie", *(f"c{i}" for i in range(n))]
    out = pa.schema([(c, pa.int64()) for c in names])

    def run(batches):
        for b, number in row_numbers(batches):
            text, row = (mix(x.astype(np.uint64)) >> np.uint64(s) for x, s in ((b.column(2).to_numpy(), 48), (number, 49)))
            tie = (text << np.uint64(15) | row).astype(np.int64)
            yield batch(out, b.column(0), b.column(1), b.column(2), tie, *(s.numbers(b.column(3 + i)) for i, s in enumerate(by)))

    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


@dataclass
class Tree:
    """Node v sends keys of dimension ``dim[v]`` up to ``cut[v]`` to child ``kids[v]``, others to the next; leaves have dim -1."""

    leaves: list[int]  # how many shards a node gives
    dim: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    kids: list[int] = field(default_factory=lambda: [-1])

    def split(self, v: int, dim: int, cut: int) -> list[int]:
        left = self.leaves[v] // 2
        self.dim[v], self.cut[v], self.kids[v] = dim, cut, len(self.dim)
        for n in (left, self.leaves[v] - left):
            self.leaves.append(n)
            self.dim.append(-1)
            self.cut.append(0)
            self.kids.append(-1)
        return [self.kids[v], self.kids[v] + 1]

    def shards(self) -> list[int]:
        """The shard of each leaf, from left to right."""
        out, stack, n = [-1] * len(self.dim), [0], 0
        while stack:
            v = stack.pop()
            if self.dim[v] < 0:
                out[v] = n
                n += 1
            else:
                stack += [self.kids[v] + 1, self.kids[v]]
        return out

    def route(self, coordinates: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The lowest node of each point; ``coordinates`` has a row per dimension."""
        dim, cut, kids = (np.array(x, dtype=np.int64) for x in (self.dim, self.cut, self.kids))
        at, every = np.zeros(len(tie), dtype=np.int64), np.arange(len(tie))
        while len(every):
            every = every[dim[at[every]] >= 0]
            v = at[every]
            key = coordinates[dim[v], every] << TIE | tie[every]
            at[every] = kids[v] + (key > cut[v])
        return at


def _columns(b: pa.RecordBatch, n_dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinates, tie, size) of a batch of points."""
    at = b.schema.get_field_index
    return np.array([b.column(at(f"c{i}")).to_numpy() for i in range(n_dims)]).reshape(n_dims, b.num_rows), b.column(at("tie")).to_numpy(), b.column(at("size")).to_numpy()


def bucket_sums(rows: DataFrame, tree: Tree, asks: list[tuple[int, int, int, int]], n_dims: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each (node, dimension, least key, greatest key) the (bytes, least key, greatest key) of its buckets that hold points, in order."""
    shift = [max(0, (hi - lo).bit_length() - (BUCKETS.bit_length() - 1)) for _, _, lo, hi in asks]
    of_node: dict[int, list[int]] = {}
    for a, (v, *_) in enumerate(asks):
        of_node.setdefault(v, []).append(a)
    out = pa.schema([(c, pa.int64()) for c in ("bucket", "bytes", "lo", "hi")])

    def run(batches):
        total = np.zeros(len(asks) * BUCKETS, dtype=np.int64)
        lo = np.full(len(total), np.iinfo(np.int64).max)
        hi = np.full(len(total), -1, dtype=np.int64)
        for b in batches:
            coordinates, tie, size = _columns(b, n_dims)
            node = tree.route(coordinates, tie)
            order = np.argsort(node, kind="stable")
            values, starts = np.unique(node[order], return_index=True)
            for v, mine in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
                for a in of_node.get(v, ()):
                    _, d, least, most = asks[a]
                    key = coordinates[d, mine] << TIE | tie[mine]
                    inside = (key >= least) & (key <= most)
                    key, weight = key[inside], size[mine[inside]]
                    bucket = a * BUCKETS + (key - least >> shift[a])
                    np.add.at(total, bucket, weight)
                    np.minimum.at(lo, bucket, key)
                    np.maximum.at(hi, bucket, key)
        full = np.flatnonzero(hi >= 0)
        yield batch(out, full, total[full], lo[full], hi[full])

    names = ["tie", "size", *(f"c{i}" for i in range(n_dims))]
    tasks = rows.select(*names).mapInArrow(run, "bucket bigint, bytes bigint, lo bigint, hi bigint")
    got: dict[int, list[tuple[int, int, int]]] = {}
    # at most BUCKETS rows for each ask
    for r in sorted(tasks.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()):
        got.setdefault(r.bucket // BUCKETS, []).append((r.bytes, r.lo, r.hi))
    return got


def fit(rows: DataFrame, n_dims: int, shards: int, tolerance: float) -> Tree:
    """The tree over staged points: a level of nodes is cut at once, in a few passes."""
    tree, level = Tree([shards]), [0]
    top = (1 << COORDINATE + TIE) - 1
    while level := [v for v in level if tree.leaves[v] > 1]:
        wide = bucket_sums(rows, tree, [(v, d, 0, top) for v in level for d in range(n_dims)], n_dims)
        asks, need, slack, cuts = {}, {}, {}, {}
        for i, v in enumerate(level):
            mine = [wide.get(i * n_dims + d) for d in range(n_dims)]
            if not mine[0]:  # no points: its shards stay empty
                cuts[v] = (0, top)
                continue
            span = [(x[-1][2] >> TIE) - (x[0][1] >> TIE) for x in mine]
            d = span.index(max(span))
            weight = sum(x[0] for x in mine[d])
            need[v], slack[v] = weight * (tree.leaves[v] // 2) / tree.leaves[v], tolerance * weight / tree.leaves[v]
            asks[v] = (d, mine[d])
        while asks:
            again = {}
            for v, (d, sums) in asks.items():
                for weight, lo, hi in sums:
                    if weight >= need[v]:
                        break
                    need[v] -= weight
                if lo == hi or weight <= slack[v]:
                    cuts[v] = (d, hi if weight - need[v] <= need[v] else lo - 1)
                else:
                    again[v] = (d, lo, hi)
            asked = list(again.items())
            got = bucket_sums(rows, tree, [(v, *x) for v, x in asked], n_dims) if asked else {}
            asks = {v: (x[0], got[i]) for i, (v, x) in enumerate(asked)}
        level = [k for v in level for k in tree.split(v, *cuts[v])]
    return tree


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = DIMENSIONS, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: each row's shard and its place there, without gaps from 0.

    Either the number of shards is given or the bytes that each should hold.
    Slots follow the order in which tasks read the rows: tasks count their rows of
    each shard, and sums over the tasks before give each its first slot.
    """
    raw = staged(measured(docs, id_col, text_col, dims), "shard-rows")
    n = len(dims)
    rows = staged(points(raw, scales(raw, n)), "shard-points")
    dropped(raw)
    if shards is None:
        if not target_bytes or target_bytes < 1:
            raise ValueError("give shards or target_bytes")
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    tree = fit(rows, n, shards, tolerance)
    of_leaf = np.array(tree.shards(), dtype=np.int64)
    out = pa.schema([(c, pa.int64()) for c in ("id", "size", "crc", "shard", "task", "place")])

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        for b in batches:
            to = of_leaf[tree.route(*_columns(b, n)[:2])]
            order = np.argsort(to, kind="stable")
            count = np.bincount(to, minlength=shards)
            place = np.empty(len(to), dtype=np.int64)
            place[order] = np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count)
            place += seen[to]
            seen += count
            yield batch(out, b.column(0), b.column(1), b.column(2), to, np.full(len(to), task), place)

    placed = staged(rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in out.names)), "shard-places")
    dropped(rows)
    # a row for each task and shard
    counts = placed.groupBy("task", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(base, ["task", "shard"]).select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("place")).alias("slot"))
