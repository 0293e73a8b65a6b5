"""A stored index of vectors: lists around centroids, with product-quantised residuals.

The index is a folder.  ``vectors`` holds every row, partitioned by ``list_id``,
the list of its nearest centroid, with a code of some bytes that stands for the
rest of its direction; ``lists`` holds the centroids and how many rows each list
has, ``words`` the code words.  A search of one vector reads the partitions of the
lists nearest to it and compares exactly.  A join of many reads the lists that some
query goes to, cut into parts; each part meets each block of queries (an equi join by
both).  There a query's best candidates in its own lists are had by their codes and
compared exactly, and only its nearest rows of a part go on.

Only model parameters pass the driver: lists * (dimensions + 1) and 256 *
dimensions numbers.  Parts and blocks are dealt by hashes of keys, so a group is
bounded whatever lies in one direction.

Vectors of other dimensions than the index has, and null ones, are in list -1 and
are only found by queries of their dimension, exactly.  Vectors of length 0 have
score 0 to all.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from folia.operators.search import top_k
from folia.operators.staging import staged

#: Code words of a piece: a code is a byte.
WORDS = 256
#: A model of more numbers than this is refused: it is sent to every task.
MOST_NUMBERS = 1 << 26
#: Rows and queries that meet in one group.
PART, BLOCK = 65_536, 16_384
ODD_LIST = -1


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n, n, 1)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the lists of this length, their numbers as rows); null numbers are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.flatnonzero(pc.equal(pc.list_value_length(column), width).fill_null(False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(at)).flatten()
    return at, np.asarray(flat.fill_null(0), dtype=np.float32).reshape(len(at), width)


@dataclass(frozen=True)
class Model:
    centroids: np.ndarray  # (lists, dimensions), of length 1
    words: np.ndarray  # (pieces, WORDS, numbers of a piece): residuals, cut in pieces

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def nearest(self, v: np.ndarray, n: int = 1) -> np.ndarray:
        return np.argsort(-(v @ self.centroids.T), axis=1, kind="stable")[:, :n]

    def _pieces(self, v: np.ndarray) -> np.ndarray:
        """(pieces, rows, numbers), the last piece filled up with zeros."""
        count, _, size = self.words.shape
        return np.pad(v, ((0, 0), (0, count * size - v.shape[1]))).reshape(len(v), count, size).transpose(1, 0, 2)

    def codes(self, v: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """A byte a piece of each vector of length 1: the code word nearest to what its centroid leaves."""
        out = np.empty((len(v), len(self.words)), dtype=np.uint8)
        for i, (x, w) in enumerate(zip(self._pieces(v - self.centroids[lists]), self.words, strict=True)):
            out[:, i] = np.argmin((w**2).sum(1) - 2 * x @ w.T, axis=1)
        return out

    def decoded(self, codes: np.ndarray, list_id: int) -> np.ndarray:
        rest = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)[:, : self.width]
        return self.centroids[list_id] + rest


def fit(vectors: DataFrame, lists: int = 100, pieces: int = 16, key: str = "element_pk", column: str = "embedding", sample: int = 20_000, rounds: int = 10) -> Model:
    """Centroids by spherical k-means and code words by k-means, on the at most ``sample`` vectors with the least hashes.

    The dimension is the most frequent one of the sample.
    """
    rows = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).select(F.xxhash64(key).alias("h"), key, F.col(column).cast("array<float>").alias("v")).orderBy("h", key).limit(sample).toArrow()
    sizes = pc.list_value_length(rows["v"]).to_numpy()
    width = int(np.bincount(sizes).argmax()) if len(sizes) else 1
    if lists * width > MOST_NUMBERS:
        raise ValueError(f"{lists} lists of {width} numbers are too many to send to every task")
    v = _unit(matrix(rows["v"], width)[1])
    return Model(c := _centroids(v, lists, rounds), _words(v, c, min(pieces, width), rounds))


def _spaced(v: np.ndarray, n: int) -> np.ndarray:
    return v[np.unique(np.linspace(0, len(v) - 1, min(n, len(v))).astype(int))] if len(v) else np.zeros((1, v.shape[1]), dtype=np.float32)


def _centroids(v: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    c = _spaced(v, lists)
    for _ in range(rounds if len(v) else 0):
        total = np.zeros_like(c)
        np.add.at(total, np.argmax(v @ c.T, axis=1), v)
        c = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, _unit(total), c)
    return c


def _words(v: np.ndarray, centroids: np.ndarray, pieces: int, rounds: int) -> np.ndarray:
    size = -(-v.shape[1] // pieces)
    pieces = -(-v.shape[1] // size)
    empty = Model(centroids, np.zeros((pieces, WORDS, size), dtype=np.float32))
    if not len(v):
        return empty.words
    out = []
    for x in empty._pieces(v - centroids[np.argmax(v @ centroids.T, axis=1)]):
        w = np.resize(_spaced(x, WORDS), (WORDS, size)).astype(np.float32)
        for _ in range(rounds):
            at = np.argmin((w**2).sum(1) - 2 * x @ w.T, axis=1)
            n, total = np.bincount(at, minlength=WORDS)[:, None], np.zeros_like(w)
            np.add.at(total, at, x)
            w = np.where(n > 0, total / np.maximum(n, 1), w)
        out.append(w)
    return np.array(out)


def assigned(vectors: DataFrame, model: Model, column: str = "embedding") -> DataFrame:
    """Every row with its list_id and code; all other columns as they are."""
    place = vectors.columns.index(column)

    def run(batches):
        for b in batches:
            lists, codes = np.full(b.num_rows, ODD_LIST, dtype=np.int32), [None] * b.num_rows
            at, v = matrix(b.column(place), model.width)
            if len(at):
                v = _unit(v)
                lists[at] = model.nearest(v)[:, 0]
                for i, c in zip(at.tolist(), model.codes(v, lists[at]), strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists), pa.array(codes, pa.binary())], names=[*b.schema.names, "list_id", "code"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("list_id", IntegerType()), StructField("code", BinaryType())]))


@dataclass(frozen=True)
class Index:
    """A written index; ``sizes`` has the rows of each list."""

    spark: SparkSession
    path: str
    model: Model
    sizes: dict[int, int]
    schema: StructType
    key: str
    column: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def search(self, query: list[float], k: int = 10, probes: int = 10, **more) -> DataFrame:
        """key, score of the nearest rows in the ``probes`` lists nearest to the query: other partitions aren't read."""
        lists = self.model.nearest(_unit(np.array([query], dtype=np.float32)), probes)[0].tolist() if len(query) == self.model.width else [ODD_LIST]
        return top_k(self.rows.where(F.col("list_id").isin(lists)), query, k, key=self.key, column=self.column, **more)

    def knn_join(self, queries: DataFrame, k: int = 20, probes: int = 10, refine: int = 8, group: str | None = None, threshold: float | None = None, where: Column | None = None) -> DataFrame:
        """source, target, score: of each query the k nearest rows among the ``refine * k`` of each part with the best codes in its ``probes`` lists.

        ``queries`` has the index's key and vector columns.  With ``group``, a
        column of both sides, rows of the query's own group don't count; ``where``
        restricts the rows of the index.  Queries of other dimensions find nothing.
        """
        kin = F.col(group).cast("string") if group else F.lit(None).cast("string")
        asked = queries.select(F.col(self.key).cast("long").alias("id"), F.col(self.column).cast("array<float>").alias("v"), kin.alias("kin"))
        asked = staged(asked.where(F.size("v") == self.model.width), "index-queries")
        n = asked.count()
        # one row a list at most; other lists aren't read
        lists = sorted(r.list_id for r in self._routed(asked, probes).distinct().collect())
        rows = self.rows if where is None else self.rows.where(where)
        rows = rows.where(F.col("list_id").isin(lists))
        parts, blocks = max(1, -(-sum(self.sizes.get(i, 0) for i in lists) // PART)), max(1, -(-n // BLOCK))
        place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asks = asked.select("id", "v", "kin", F.lit(None).cast("int").alias("list_id"), F.lit(None).cast("binary").alias("code"), place(blocks).alias("block"), every(parts).alias("part"))
        has = rows.select(F.col(self.key).cast("long").alias("id"), F.col(self.column).cast("array<float>").alias("v"), kin.alias("kin"), "list_id", "code")
        has = has.select("*", every(blocks).alias("block"), place(parts).alias("part"))
        found = asks.unionByName(has).groupBy("block", "part").applyInArrow(self._meet(k, refine * k, probes, bool(group), threshold), "source bigint, target bigint, score double")
        best = Window.partitionBy("source").orderBy(F.desc("score"), "target")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")

    def _routed(self, asked: DataFrame, probes: int) -> DataFrame:
        """list_id: the lists that some query goes to, each perhaps several times."""
        model = self.model

        def run(batches):
            for b in batches:
                v = matrix(b.column(0), model.width)[1]
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(model.nearest(_unit(v), probes)).astype(np.int32))], names=["list_id"])

        return asked.select("v").mapInArrow(run, "list_id int")

    def _meet(self, k: int, most: int, probes: int, grouped: bool, threshold: float | None):
        """Of a block of queries and a part of the rows the best ``most`` of each query by their codes, and of these the best ``k`` exactly."""
        model = self.model
        schema = pa.schema([("source", pa.int64()), ("target", pa.int64()), ("score", pa.float64())])

        def run(table: pa.Table) -> pa.Table:
            kin = pc.fill_null(table["kin"].combine_chunks().dictionary_encode().indices, -1)
            table = table.set_column(table.schema.get_field_index("kin"), "kin", kin)
            mask = table["list_id"].is_null()
            q, x = table.filter(mask).sort_by("id"), table.filter(pc.invert(mask)).sort_by([("list_id", "ascending"), ("id", "ascending")])
            out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
            if len(q) and len(x):
                ids, own, mine, theirs = q["id"].to_numpy(), x["id"].to_numpy(), q["kin"].to_numpy(), x["kin"].to_numpy()
                raw, exact = matrix(q["v"], model.width)[1], matrix(x["v"], model.width)[1]
                v = _unit(raw)
                numbers, starts = np.unique(x["list_id"].to_numpy(), return_index=True)
                ends = [*starts[1:].tolist(), len(x)]
                codes = np.frombuffer(b"".join(x["code"].to_pylist()), dtype=np.uint8).reshape(len(x), -1)
                w = np.concatenate([model.decoded(codes[lo:hi], i) for i, lo, hi in zip(numbers.tolist(), starts.tolist(), ends, strict=True)])
                long = np.linalg.norm(exact.astype(np.float64), axis=1)
                step = max(1, min(128, (1 << 22) // len(x)))  # bounded scores and candidates at a time
                for at in range(0, len(ids), step):
                    s = np.full((min(step, len(ids) - at), len(x)), -np.inf, dtype=np.float32)
                    goes = np.zeros((len(s), len(model.centroids)), dtype=bool)
                    np.put_along_axis(goes, model.nearest(v[at : at + step], probes), True, axis=1)
                    for i, lo, hi in zip(numbers.tolist(), starts.tolist(), ends, strict=True):
                        r = np.flatnonzero(goes[:, i])
                        s[r, lo:hi] = v[at + r] @ w[lo:hi].T
                    same = ids[at : at + step, None] == own[None, :]
                    if grouped:
                        same |= (mine[at : at + step, None] == theirs[None, :]) & (theirs >= 0)[None, :]
                    s[same] = -np.inf
                    n = min(most, len(x))
                    top = np.argpartition(s, len(x) - n, axis=1)[:, len(x) - n :]
                    r, t = np.repeat(np.arange(len(s)), n), top.ravel()
                    fine = np.isfinite(s[r, t])
                    r, t = r[fine], t[fine]
                    a = raw[at + r].astype(np.float64)
                    size = np.linalg.norm(a, axis=1) * long[t]
                    score = np.where(size > 0, np.einsum("ij,ij->i", a, exact[t].astype(np.float64)) / np.where(size > 0, size, 1), 0.0)
                    order = np.lexsort((own[t], -score, r))
                    r, t, score = r[order], t[order], score[order]
                    good = np.arange(len(r)) - np.searchsorted(r, r) < k
                    if threshold is not None:
                        good &= score >= threshold
                    for c, y in zip(out, (ids[at + r[good]], own[t[good]], score[good]), strict=True):
                        c.append(y)
            return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        return run


def write(rows: DataFrame, model: Model, path: str, key: str = "element_pk", column: str = "embedding") -> Index:
    """Writes ``assigned`` rows as an index.

    Rows are dealt by ranges of list and key, so a list with very many rows is
    written by several tasks.
    """
    spark = rows.sparkSession
    rows = staged(rows, "index-rows")
    rows.repartitionByRange(F.col("list_id"), F.col(key)).sortWithinPartitions("list_id", key).write.partitionBy("list_id").parquet(f"{path}/vectors")
    sizes = {r.list_id: r.n for r in rows.groupBy("list_id").agg(F.count("*").alias("n")).collect()}
    spark.createDataFrame([(i, sizes.get(i, 0), c.tolist()) for i, c in enumerate(model.centroids)], "list_id int, n long, centroid array<float>").coalesce(1).write.parquet(f"{path}/lists")
    spark.createDataFrame([(i, w.ravel().tolist()) for i, w in enumerate(model.words)], "piece int, words array<float>").coalesce(1).write.parquet(f"{path}/words")
    spark.createDataFrame([(rows.schema.json(), key, column)], "rows string, key string, vector string").coalesce(1).write.parquet(f"{path}/columns")
    return Index(spark, path, model, sizes, rows.schema, key, column)


def build(vectors: DataFrame, path: str, key: str = "element_pk", column: str = "embedding", **more) -> Index:
    """Fits a model, deals all rows of ``vectors`` and writes the index."""
    model = fit(vectors, key=key, column=column, **more)
    return write(assigned(vectors, model, column), model, path, key, column)


def open_index(spark: SparkSession, path: str) -> Index:
    lists = spark.read.parquet(f"{path}/lists").orderBy("list_id").collect()
    words = spark.read.parquet(f"{path}/words").orderBy("piece").collect()
    model = Model(np.array([r.centroid for r in lists], dtype=np.float32), np.array([r.words for r in words], dtype=np.float32).reshape(len(words), WORDS, -1))
    columns = spark.read.parquet(f"{path}/columns").first()
    return Index(spark, path, model, {r.list_id: r.n for r in lists}, StructType.fromJson(json.loads(columns.rows)), columns.key, columns.vector)
