"""Pointers to content: which source a pointer names, and what it points at there.

A pointer has a source (path or URI), an element type and the place in the
document.  ``resolve`` joins pointers with the content of their sources, whatever
connector read it, and gives the element's text; what can't be found is said in
words, as the result of a look-up is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.formats import detect
from folia.functions.jsonpath import text as text_of
from folia.functions.text import remap_prefix, source_kind

#: Kinds of sources whose records a resolver can be given.
KINDS = ("file", "web", "s3", "db", "mongodb", "confluence", "jira", "servicenow")


def supports(source: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    return source.isNotNull() & (F.trim(source) != "") & source_kind(source).isin(*kinds)


def db_parts(uri: Column) -> Column:
    """db://connection/table/key column/key/content column[/type] in its parts."""
    p = F.split(F.regexp_replace(uri, "^db://", ""), "/")
    names = ("connection", "table", "key_column", "key", "content_column", "content_type")
    return F.struct(*(F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names)))


def mongo_parts(uri: Column) -> Column:
    """mongodb://host/database/collection/id[/field path] in its parts."""
    p = F.split(F.regexp_replace(uri, "^mongodb://", ""), "/")
    names = ("host", "database", "collection", "id", "field")
    return F.struct(*(F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names)))


def mongo_field(uri: Column, record: Column) -> Column:
    """What a pointer names in its record (JSON text): the field at its path as text, or the whole record; null if it isn't there.

    Paths differ from row to row, so they are walked step by step over variants.
    """
    path = mongo_parts(uri)["field"]
    steps = F.filter(F.split(F.translate(path, "[]", "."), r"\."), lambda x: x != "")

    def step(at: Column, name: Column) -> Column:
        index = F.try_element_at(F.try_variant_get(at, "$", "array<variant>"), F.when(name.rlike("^[0-9]+$"), name.try_cast("int")) + 1)
        return F.coalesce(index, F.try_element_at(F.try_variant_get(at, "$", "map<string,variant>"), name))

    found = text_of(F.aggregate(steps, F.try_parse_json(record), step))
    return F.when(F.coalesce(path, F.lit("")) == "", record).otherwise(found)


def object_parts(uri: Column) -> Column:
    """s3://bucket/key in its parts."""
    return F.struct(F.regexp_extract(uri, "^s3://([^/]+)", 1).alias("bucket"), F.regexp_extract(uri, "^s3://[^/]+/(.*)$", 1).alias("key"))


def html_facts(html: Column) -> list[Column]:
    """title, description and language of a page's head, null where it has none."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return [
        some(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        some(F.regexp_extract(html, r"""(?is)<meta\s+name=["']description["']\s+content=["']([^"']*)""", 1)).alias("description"),
        some(F.regexp_extract(html, r"""(?is)<html[^>]*\slang=["']([^"']+)""", 1)).alias("language"),
    ]


def resolve(pointers: DataFrame, contents: DataFrame, elements: DataFrame | None = None, prefixes: list[tuple[str, str]] | None = None) -> DataFrame:
    """``pointers`` (source, element_type, element_id) with kind, doc_type and text.

    ``contents`` has source, content and perhaps doc_type.  A root gives the whole
    content, any other element its rendered text from ``elements`` (element_id,
    element_type, content, metadata).
    """
    from folia.operators.render import with_text

    where = remap_prefix(F.col("source"), prefixes or [])
    stated = F.col("doc_type") if "doc_type" in contents.columns else F.lit(None).cast("string")
    have = contents.select(F.col("source").alias("at"), F.col("content").alias("whole"), detect(F.col("source"), F.col("content"), stated).alias("doc_type"))
    got = pointers.withColumn("at", where).join(have, "at", "left").withColumn("kind", source_kind(F.col("at")))
    if elements is not None:
        said = with_text(elements.select("element_id", "element_type", "content", "metadata")).select("element_id", F.col("text").alias("said"))
        got = got.join(said, "element_id", "left")
    else:
        got = got.withColumn("said", F.lit(None).cast("string"))
    missing = F.concat(F.lit("Error: no content for "), F.coalesce("source", F.lit("")))
    unknown = F.concat(F.lit("Error: no element "), F.coalesce("element_id", F.lit("")), F.lit(" in "), F.coalesce("source", F.lit("")))
    text = F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "").when(F.col("whole").isNull(), missing).when(F.col("element_type") == "root", F.col("whole")).otherwise(F.coalesce("said", unknown))
    return got.select(*pointers.columns, "kind", "doc_type", text.alias("text"))
