"""Upserts, replacement by document, cascading deletes and change detection.

Tables are DataFrames in and out; ``swap`` writes a new version beside the old
one and then moves the pointer, so a reader never meets half a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` and those of ``old`` with other keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """By source: a source that is known keeps its doc_id and time of creation."""
    kept = old.select("source", F.col("doc_id").alias("o_id"), F.col("created_at").alias("o_at"))
    merged = new.join(kept, "source", "left").select(F.coalesce("o_id", "doc_id").alias("doc_id"), "source", "content_hash", F.coalesce("o_at", "created_at").alias("created_at"), "updated_at")
    return old.join(new.select("source"), "source", "left_anti").select("doc_id", "source", "content_hash", "created_at", "updated_at").unionByName(merged)


def touch_history(history: DataFrame, processed: DataFrame) -> DataFrame:
    """source_id, content_hash, processing_count: one more for what was processed, 1 for what is new."""
    h, p = history.alias("h"), processed.select("source_id", "content_hash").alias("p")
    j = h.join(p, F.col("h.source_id") == F.col("p.source_id"), "full")
    return j.select(F.coalesce("p.source_id", "h.source_id").alias("source_id"), F.coalesce("p.content_hash", "h.content_hash").alias("content_hash"), (F.coalesce("h.processing_count", F.lit(0)) + F.col("p.source_id").isNotNull().cast("int")).alias("processing_count"))


def changes(history: DataFrame, listing: DataFrame) -> DataFrame:
    """source_id, status: new, changed, unchanged or gone by content hash."""
    h, n = history.select("source_id", F.col("content_hash").alias("h")), listing.select("source_id", F.col("content_hash").alias("n"))
    status = F.when(F.col("h").isNull(), "new").when(F.col("n").isNull(), "gone").when(F.col("h") == F.col("n"), "unchanged").otherwise("changed")
    return h.join(n, "source_id", "full").select("source_id", status.alias("status"))


def replace_elements(old: DataFrame, new: DataFrame) -> DataFrame:
    """The elements of the documents in ``new`` replaced; unchanged ones (same id and hash) keep their pk, the rest get the next ones."""
    docs = new.select("doc_id").distinct()
    known = old.select("element_id", "content_hash", "element_pk")
    got = new.drop("element_pk").join(known, ["element_id", "content_hash"], "left")
    top = old.agg(F.coalesce(F.max("element_pk"), F.lit(0)).alias("top"))
    fresh = got.where("element_pk is null").drop("element_pk")
    # numbered within hash ranges: a range's offset is a prefix sum over few rows, no single task sees all
    fresh = fresh.withColumn("slot", F.pmod(F.xxhash64("element_id"), F.lit(1024)))
    from pyspark.sql import Window

    sizes = fresh.groupBy("slot").agg(F.count("*").alias("n"))
    offsets = sizes.select("slot", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")).join(F.broadcast(top))
    numbered = fresh.withColumn("i", F.row_number().over(Window.partitionBy("slot").orderBy("element_id"))).join(F.broadcast(offsets), "slot")
    fresh = numbered.withColumn("element_pk", F.col("top") + F.col("base") + F.col("i")).drop("slot", "i", "base", "top")
    return old.join(docs, "doc_id", "left_anti").unionByName(got.where("element_pk is not null")).unionByName(fresh)


def delete_documents(doc_ids: DataFrame, elements: DataFrame, edges: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements, edges and embeddings without those of the documents; edges that come in from others stay."""
    gone = elements.join(doc_ids.select("doc_id"), "doc_id", "left_semi")
    kept = elements.join(doc_ids.select("doc_id"), "doc_id", "left_anti")
    return kept, edges.join(gone.select(F.col("element_id").alias("source_id")), "source_id", "left_anti"), embeddings.join(gone.select("element_pk"), "element_pk", "left_anti")


def delete_relationships(edges: DataFrame, element_id: str, kind: str | None = None) -> DataFrame:
    """Edges without those from or to an element (of one kind, if given)."""
    hit = (F.col("source_id") == element_id) | (F.col("target_reference") == element_id)
    return edges.where(~(hit & (F.col("relationship_type") == kind) if kind else hit))


def swap(df: DataFrame, root: str, table: str) -> str:
    """Writes a new version of a table and makes it the current one; returns its path.

    Pointers are only ever added and the one with the greatest number counts, so a
    failure at any place leaves the old version or the new one.
    """
    path = new_version(root, table)
    df.write.parquet(path)
    point(df.sparkSession, root, table, path)
    return path


def new_version(root: str, table: str) -> str:
    import uuid

    return f"{root}/{table}/v-{uuid.uuid4().hex}"


def point(spark, root: str, table: str, path: str) -> None:
    """Makes a written version the current one."""
    last = _pointer(spark, root, table)
    spark.createDataFrame([((last.version if last else 0) + 1, path)], "version long, path string").coalesce(1).write.mode("append").json(f"{root}/{table}/_current")


def current_path(spark, root: str, table: str) -> str | None:
    at = _pointer(spark, root, table)
    return at.path if at else None


def _pointer(spark, root: str, table: str):
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema("version long, path string").json(f"{root}/{table}/_current")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return rows.orderBy(F.desc("version"), "path").first()


def current(spark, root: str, table: str) -> DataFrame | None:
    """The current version of a table, None before the first."""
    path = current_path(spark, root, table)
    return spark.read.parquet(path) if path else None
