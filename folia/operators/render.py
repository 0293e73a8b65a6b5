"""Elements as text a reader would write, by their type, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.temporal import temporal_phrase
from folia.operators.geometry import is_identity


def _meta(field: str) -> Column:
    return F.get_json_object("metadata", f"$.{field}")


def named_value(name: Column, value: Column) -> Column:
    """``name is "value"`` for names that tell who or what, ``name: value`` for others; times are said in words."""
    return F.when(is_identity(name), F.concat(name, F.lit(' is "'), value, F.lit('"'))).otherwise(F.concat(name, F.lit(": "), temporal_phrase(value)))


def own_text(elements: DataFrame) -> Column:
    """The text of an element by itself."""
    kind, content = F.col("element_type"), F.coalesce("content", F.lit(""))
    name = F.coalesce(_meta("name"), _meta("header"))
    attributes = F.from_json(F.get_json_object("metadata", "$.attributes"), "map<string,string>")
    phrases = F.array_join(F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit(" is "), F.lit('"'), e["value"], F.lit('"'))), ", ")
    tag = F.regexp_extract(F.coalesce(_meta("path"), F.lit("")), r"([^/\[]+)(?:\[\d+\])?$", 1)
    xml = F.concat_ws(" ", F.when(content != "", F.concat(tag, F.lit(": "), content)).otherwise(tag), F.when(phrases != "", F.concat(F.lit("("), phrases, F.lit(")"))))
    return (
        F.when(kind == "list_item", F.concat(F.when(_meta("list_type") == "ordered", F.concat(F.coalesce(_meta("index"), F.lit("1")), F.lit(". "))).otherwise("- "), content))
        .when(kind == "code_block", F.concat(F.lit("Code"), F.coalesce(F.concat(F.lit(" ("), _meta("language"), F.lit(")")), F.lit("")), F.lit(":\n"), content))
        .when(kind == "blockquote", F.regexp_replace(content, r"(?m)^", "> "))
        .when(kind == "image", F.concat(F.lit("Image: "), F.coalesce(_meta("alt"), F.lit("no description"))))
        .when(kind.isin("table_cell", "json_field") & name.isNotNull(), named_value(name, content))
        .when(kind.isin("xml_element", "xml_object", "xml_list"), xml)
        .otherwise(content)
    )


def with_text(elements: DataFrame) -> DataFrame:
    """``elements`` (with content) and their ``text``."""
    return elements.withColumn("text", own_text(elements))


def row_texts(elements: DataFrame, separator: str = " | ") -> DataFrame:
    """doc_id, element_id, text of each row: its cells in order, joined."""
    cells = with_text(elements.where(F.col("element_type").isin("table_cell", "table_header")))
    return cells.groupBy("doc_id", F.col("parent_id").alias("element_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), separator).alias("text"))


def table_previews(elements: DataFrame, rows: int = 5, separator: str = " | ") -> DataFrame:
    """doc_id, element_id, text of each table: its first rows, a line each."""
    lines = row_texts(elements, separator).join(elements.where(F.col("element_type").isin("table_row", "table_header_row")).select("doc_id", "element_id", "ord", "parent_id"), ["doc_id", "element_id"])
    first = Window.partitionBy("doc_id", "parent_id").orderBy("ord")
    lines = lines.withColumn("k", F.row_number().over(first)).where(F.col("k") <= rows)
    return lines.groupBy("doc_id", F.col("parent_id").alias("element_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n").alias("text"))
