"""A stored inverted index with BM25 ranking.

The index has blocks of postings: (term, ids, tfs, lengths) names some of the texts
that have a term, written in buckets by a hash of the term and sorted by it: a search
reads the buckets of its terms, and in them the row groups that may hold these.  A
block comes of one slice of texts, whose words are counted in the task that reads
them, so only blocks are shuffled, once, and the blocks of a word that every text has
are split among many tasks.  A block without a term names all texts of its slice;
``facts`` has their number and that of their words.

Terms are runs of letters and digits in lower case.  Null texts have no terms and
count as texts.  Ids should be unique: rows of one id and length count as one text,
with their words added up by a search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

TERM = r"[\p{L}\p{N}]+"
#: Partitions of the postings; a table of many terabytes takes more.
BUCKETS = 64
#: Bytes of words whose blocks are made at once.
SLICE = 32 << 20


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of some SLICE bytes."""
    for b in batches:
        step = max(1, min(b.num_rows, int(b.num_rows * SLICE / max(1, b.nbytes))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _lists(values: pa.Array, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _schemas(rows: DataFrame) -> tuple[StructType, pa.Schema]:
    """Of blocks of the ids of ``rows``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    lists = {"ids": rows.schema["id"].dataType, "tfs": IntegerType(), "lengths": IntegerType()}
    schema = StructType([StructField("term", StringType()), *(StructField(c, ArrayType(t)) for c, t in lists.items())])
    return schema, to_arrow_schema(schema)


def _blocks(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Blocks of the words of each slice of texts, and one without a term of all its texts."""
    words = texts.select(F.col(key).alias("id"), terms(F.col(column)).alias("w"))
    schema, arrow = _schemas(words)

    def run(batches):
        for b in _cut(batches):
            ids, lengths = b.column(0), pc.list_value_length(b.column(1)).to_numpy()
            said = b.column(1).flatten().dictionary_encode()
            # pairs of word and text by number, in order of the word
            pairs, tf = np.unique(said.indices.to_numpy().astype(np.int64) * b.num_rows + np.repeat(np.arange(b.num_rows), lengths), return_counts=True)
            word, text = np.divmod(pairs, b.num_rows)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            of = [ids.take(pa.array(text)), pa.array(tf, pa.int32()), pa.array(lengths[text])]
            every = [ids, pa.array(np.zeros(b.num_rows, dtype=np.int32)), pa.array(lengths)]
            for term, lists, at in ((said.dictionary.take(pa.array(word[starts])), of, starts), (pa.nulls(1, pa.string()), every, np.zeros(1))):
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([term, *(_lists(x, at) for x in lists)], arrow.types, strict=True)], schema=arrow)

    return words.mapInArrow(run, schema)


def _packed(rows: DataFrame) -> DataFrame:
    """Blocks of ``postings``."""
    rows = rows.select("term", "id", F.col("tf").cast("int"), F.col("length").cast("int"))
    schema, arrow = _schemas(rows)

    def run(batches):
        for b in _cut(batches):
            said = b.column(0).dictionary_encode()
            code = pc.fill_null(said.indices, -1).to_numpy().astype(np.int64)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-2))
            term = said.dictionary.take(pa.array(code[order][starts], mask=code[order][starts] < 0))
            lists = (_lists(b.column(i).take(pa.array(order)), starts) for i in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([term, *lists], arrow.types, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _unpacked(blocks: DataFrame) -> DataFrame:
    """A row for each text that a block names."""
    kept = [c for c in blocks.columns if c not in ("ids", "tfs", "lengths")]
    rows = blocks.select(*kept, F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
    return rows.select(*kept, F.col("p.ids").alias("id"), F.col("p.tfs").cast("long").alias("tf"), F.col("p.lengths").cast("long").alias("length"))


def postings(texts: DataFrame, key: str = "element_pk", column: str = "text") -> DataFrame:
    """term, id, tf, length of every text, and a row without a term for each text."""
    return _unpacked(_blocks(texts, key, column))


def _bucket(term: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    texts: int
    words: int
    buckets: int
    schema: StructType

    @property
    def rows(self) -> DataFrame:
        """``postings``, and the bucket of each."""
        return _unpacked(self.spark.read.schema(self.schema).parquet(f"{self.path}/postings"))

    def search(self, text: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """id, score of the k texts that match the words of ``text`` best; ties by id."""
        return self.scores(text, k1, b).orderBy(F.desc("score"), "id").limit(k)

    def scores(self, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """id, score of every text with one of the words."""
        asked = sorted(set(self.spark.range(1).select(terms(F.lit(text)).alias("t")).first().t))
        places = {r[0] for r in self.spark.createDataFrame([(t,) for t in asked], "t string").select(_bucket(F.col("t"), self.buckets)).collect()}
        hits = self.rows.where(F.col("bucket").isin(sorted(places)) & F.col("term").isin(asked)).groupBy("term", "id", "length").agg(F.sum("tf").alias("tf"))
        # a row for each word asked for
        known = hits.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(1 + (self.texts - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        mean = self.words / self.texts if self.texts and self.words else 1.0
        tf = F.col("tf").cast("double")
        part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / mean))
        return hits.join(F.broadcast(known), "term").groupBy("id").agg(F.sum(part).alias("score"))


def _written(blocks: DataFrame, path: str, buckets: int) -> TextIndex:
    spark = blocks.sparkSession
    # where a bucket has more than a task should write, its blocks are split among several
    out = blocks.withColumn("bucket", _bucket(F.col("term"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    out.write.partitionBy("bucket").parquet(f"{path}/postings")
    every = _unpacked(spark.read.schema(out.schema).parquet(f"{path}/postings").where((F.col("bucket") == _bucket(F.lit(None).cast("string"), buckets)) & F.col("term").isNull()))
    facts = every.select("id", "length").distinct().agg(F.count("*").alias("texts"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"))
    facts.select("*", F.lit(buckets).alias("buckets"), F.lit(out.schema.json()).alias("columns")).coalesce(1).write.parquet(f"{path}/facts")
    return open_index(spark, path)


def write(rows: DataFrame, path: str, buckets: int = BUCKETS) -> TextIndex:
    """Writes ``postings`` as an index."""
    return _written(_packed(rows), path, buckets)


def build(texts: DataFrame, path: str, key: str = "element_pk", column: str = "text", buckets: int = BUCKETS) -> TextIndex:
    return _written(_blocks(texts, key, column), path, buckets)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    f = spark.read.parquet(f"{path}/facts").first()
    return TextIndex(spark, path, f.texts, f.words, f.buckets, StructType.fromJson(json.loads(f["columns"])))
