"""Statistics of documents and of their columns, from their parsed elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.temporal import temporal_kind
from folia.operators.explode import column_types
from folia.operators.geometry import is_identity

#: Words of a page, for formats that don't tell their pages.
PAGE_WORDS = 250
#: Types that repeat the text of what is below them.
_ABOVE = ("root", "body", "list", "table", "table_row", "table_header_row", "div", "article", "section", "nav", "aside", "figure", "xml_object", "xml_list", "xml_element", "json_object", "json_array", "workbook", "presentation_body")


def document_statistics(rows: DataFrame) -> DataFrame:
    """doc_id, elements, by_type (counts), words, characters, pages, depth_of_paths, top (the first step of an XML path).

    ``rows`` are parsed elements (doc_id, element_type, content, metadata).  Words are
    those of elements that hold text of their own, split at white space; a page has
    250 of them, and a document one page at least.  Counts of a type are summed
    before they are shuffled, so a very long document is no heavy group.
    """
    own = F.when(~F.col("element_type").isin(*_ABOVE), F.trim(F.coalesce("content", F.lit(""))))
    words = F.when(own != "", F.size(F.split(own, r"\s+"))).otherwise(0)
    path = F.get_json_object("metadata", "$.path")
    per_type = rows.groupBy("doc_id", "element_type").agg(
        F.count("*").alias("n"), F.sum(words).alias("words"), F.sum(F.char_length(F.coalesce(own, F.lit("")))).alias("characters"),
        F.max(F.size(F.split(F.regexp_replace(path, r"/text\(\)$", ""), "/")) - 1).alias("deep"), F.min(F.nullif(F.regexp_extract(path, r"^/([^/\[]+)", 1), F.lit(""))).alias("top"),
    )
    got = per_type.groupBy("doc_id").agg(
        F.sum("n").alias("elements"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("element_type", "n")))).alias("by_type"), F.sum("words").alias("words"), F.sum("characters").alias("characters"),
        F.max("deep").alias("depth_of_paths"), F.min("top").alias("top"),
    )
    return got.withColumn("pages", F.greatest(F.floor(F.col("words") / PAGE_WORDS), F.lit(1)).cast("int"))


def cells(rows: DataFrame) -> DataFrame:
    """doc_id, row, col, header, value of the cells of parsed tables that know their header."""
    of = lambda f: F.get_json_object("metadata", f"$.{f}")
    return rows.where("element_type = 'table_cell'").select("doc_id", of("row").cast("int").alias("row"), of("col").cast("int").alias("col"), of("header").alias("header"), F.coalesce("content", F.lit("")).alias("value"))


def column_statistics(table_cells: DataFrame, sample: int = 10) -> DataFrame:
    """doc_id, col, header, cells, inferred_type, is_identity, is_temporal of each column.

    A column of dates or strings is temporal if more than half of its first
    ``sample`` values are times or dates.
    """
    key = ["doc_id", "col", "header"]
    kinds = column_types(table_cells, key)
    first = Window.partitionBy("doc_id", "col").orderBy("row")
    seen = table_cells.withColumn("k", F.row_number().over(first)).groupBy(*key).agg(
        F.count("*").alias("cells"), F.count_if((F.col("k") <= sample) & (temporal_kind(F.col("value")) != "NONE")).alias("timed"), F.least(F.count("*"), F.lit(sample)).alias("asked")
    )
    got = seen.join(kinds, key)
    timed = F.col("inferred_type").isin("date", "string") & (F.col("timed") * 2 > F.col("asked"))
    return got.select(*key, "cells", "inferred_type", is_identity(F.col("header")).alias("is_identity"), timed.alias("is_temporal"))
