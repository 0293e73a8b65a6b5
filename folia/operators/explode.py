"""Documents to elements: one generator per format that SQL can express.

All return rows of doc_id, ord, element_type, parent_ord, parent_type, content, metadata (JSON
text); ``with_ids`` turns them into the elements relation with deterministic ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.text import EMAIL, URL, element_id, preview, word_count
from folia.operators.staging import staged

COLUMNS = ["doc_id", "ord", "element_type", "parent_ord", "parent_type", "content", "metadata"]
#: Places that a paragraph leaves for its sentences.
SENTENCES = 1 << 20


def with_ids(rows: DataFrame, whole: bool = False) -> DataFrame:
    """element_id, doc_id, element_type, parent_id, ord, content_preview, content_hash, metadata; with ``whole`` also content.

    A parent's id follows from its document, place and type, so no join is needed.
    """
    parent = F.when(F.col("parent_ord").isNotNull(), element_id(F.col("doc_id"), F.col("parent_ord"), F.col("parent_type")))
    own = element_id(F.col("doc_id"), F.col("ord"), F.col("element_type"))
    return rows.select(own.alias("element_id"), F.col("doc_id").cast("string").alias("doc_id"), "element_type", parent.alias("parent_id"), "ord", preview(F.col("content")).alias("content_preview"), F.md5(F.coalesce("content", F.lit(""))).alias("content_hash"), "metadata", *(["content"] if whole else []))


def _trimmed(parts: Column) -> Column:
    # F.trim itself would be given each part's place as the characters to trim
    return F.transform(parts, lambda x: F.trim(x))


def explode_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n\n", normalise: bool = False, min_length: int = 1) -> DataFrame:
    """A root and its paragraphs; with ``normalise`` white space collapses first, so there is one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.trim(F.regexp_replace(text, r"\s+", " ")) if normalise else text
    parts = F.filter(_trimmed(F.split(text, separator)), lambda x: F.char_length(x) >= max(1, min_length))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.concat(F.array(F.lit(None).cast("string")), parts).alias("parts")).select("doc_id", F.posexplode("parts").alias("ord", "content"))
    meta = F.to_json(F.struct((F.col("ord") - 1).alias("index"), F.char_length("content").alias("length"), word_count(F.col("content")).alias("word_count"), F.col("content").rlike(URL).alias("has_urls"), F.col("content").rlike(EMAIL).alias("has_emails")))
    root = F.col("ord") == 0
    return rows.select("doc_id", "ord", F.when(root, "root").otherwise("paragraph").alias("element_type"), F.when(~root, F.lit(0)).alias("parent_ord"), F.when(~root, "root").alias("parent_type"), "content", F.when(~root, meta).alias("metadata"))


def explode_sentences(paragraphs: DataFrame) -> DataFrame:
    """Paragraph rows with their sentences as children: a tree of three levels."""
    kids = paragraphs.where("element_type = 'paragraph'").select("doc_id", F.col("ord").alias("parent_ord"), F.posexplode(F.filter(F.split("content", r"(?<=[.!?])\s+"), lambda x: x != "")).alias("i", "content"))
    wide = lambda c: F.col(c).cast("long") * SENTENCES
    kids = kids.select("doc_id", (wide("parent_ord") + F.col("i") + 1).alias("ord"), F.lit("line").alias("element_type"), wide("parent_ord").alias("parent_ord"), F.lit("paragraph").alias("parent_type"), "content", F.lit(None).cast("string").alias("metadata"))
    return paragraphs.withColumn("ord", wide("ord")).withColumn("parent_ord", wide("parent_ord")).unionByName(kids)


def text_stats(text: Column) -> list[Column]:
    """char, word, line and paragraph counts and the title of a text."""
    first = F.element_at(F.filter(_trimmed(F.split(text, "\n")), lambda x: x != ""), 1)
    filled = F.when(F.size(F.filter(_trimmed(F.split(text, "\n")), lambda x: x != "")) > 0, F.substring(first, 1, 100))
    return [
        F.char_length(text).alias("char_count"),
        word_count(text).alias("word_count"),
        F.size(F.split(text, "\n")).alias("line_count"),
        F.size(F.filter(F.split(text, "\n\n"), lambda x: F.trim(x) != "")).alias("paragraph_count"),
        filled.alias("title"),
    ]


def text_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, link_text, link_target, link_type: URLs and mail addresses of each text."""
    found = F.concat(
        F.transform(F.regexp_extract_all(text_col, F.lit(URL), 1), lambda u: F.struct(u.alias("link_text"), u.alias("link_target"), F.lit("url").alias("link_type"))),
        F.transform(F.regexp_extract_all(text_col, F.lit(EMAIL), 1), lambda m: F.struct(m.alias("link_text"), F.concat(F.lit("mailto:"), m).alias("link_target"), F.lit("email").alias("link_type"))),
    )
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(found))


def explode_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of Markdown: headers, paragraphs, lists, code, quotes and tables by line groups.

    A header's parent is the latest header of a smaller level, a block's the latest
    header; both come from one window per level over the lines, no loop over rows.
    """
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("n", "line"))
    by = Window.partitionBy("doc_id").orderBy("n")
    fence = F.col("line").rlike(r"^\s*```")
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(by)).withColumn("in_code", fence | (F.col("fences") % 2 == 1))
    level = F.char_length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    kind = (
        F.when(F.col("in_code"), "code_block")
        .when(level > 0, "header")
        .when(F.trim("line") == "", "blank")
        .when(F.col("line").rlike(r"^\s*([-*+]|\d+[.)])\s+"), "list_item")
        .when(F.col("line").rlike(r"^\s*>"), "blockquote")
        .when(F.col("line").rlike(r"^\s*\|.*\|\s*$"), "table_row")
        .otherwise("paragraph")
    )
    lines = lines.withColumn("level", level).withColumn("kind", kind)
    fresh = (F.lag("kind").over(by).isNull()) | (F.lag("kind").over(by) != F.col("kind")) | F.col("kind").isin("header", "list_item", "table_row")
    lines = lines.withColumn("block", F.sum(fresh.cast("int")).over(by)).where("kind <> 'blank'")
    blocks = lines.groupBy("doc_id", "block", "kind").agg(F.min("n").alias("n"), F.max("level").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("raw"))
    above = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("n")), True).over(above).alias(f"h{k}") for k in range(1, 7)]
    blocks = blocks.select("*", *last)
    # the latest header below a level is the greatest line number among the levels below
    parent = F.lit(None).cast("int")
    for k in range(6, 0, -1):
        parent = F.when((F.col("kind") == "header") & (F.col("level") == k), F.greatest(F.lit(-1), F.lit(-1), *(F.col(f"h{j}") for j in range(1, k)))).otherwise(parent)
    parent = F.coalesce(parent, F.greatest(F.lit(-1), *(F.col(f"h{j}") for j in range(1, 7))))
    content = F.trim(F.when(F.col("kind") == "header", F.regexp_replace("raw", r"^#+\s+", "")).when(F.col("kind") == "list_item", F.regexp_replace("raw", r"^\s*([-*+]|\d+[.)])\s+", "")).when(F.col("kind") == "blockquote", F.regexp_replace("raw", r"(?m)^\s*>\s?", "")).otherwise(F.col("raw")))
    meta = F.when(F.col("kind") == "header", F.to_json(F.struct("level", F.regexp_replace("raw", r"^#+\s+", "").alias("text"))))
    body = blocks.select("doc_id", (F.col("n") + 1).alias("ord"), F.col("kind").alias("element_type"), (parent + 1).alias("parent_ord"), F.when(parent >= 0, "header").otherwise("root").alias("parent_type"), content.alias("content"), meta.alias("metadata"))
    roots = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("ord"), F.lit("root").alias("element_type"), F.lit(None).cast("int").alias("parent_ord"), F.lit(None).cast("string").alias("parent_type"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("metadata"))
    return roots.unionByName(body)


def markdown_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, link_text, link_target of inline and wiki links; duplicates stay."""
    texts, targets = (F.regexp_extract_all(text_col, F.lit(r"\[([^\]\[]+)\]\(([^)]+)\)"), k) for k in (1, 2))
    pairs = F.arrays_zip(texts.alias("link_text"), targets.alias("link_target"))
    wiki = F.transform(F.regexp_extract_all(text_col, F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda x: F.struct(x.alias("link_text"), x.alias("link_target")))
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(F.concat(pairs, wiki)))


def explode_cells(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A tabular document's cells: key, row's column number, header, value and its temporal mark."""
    from folia.functions.temporal import temporal_kind

    cells = F.array(*(F.struct(F.lit(i).alias("col"), F.lit(c).alias("header"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))
    got = rows.select(F.col(key).alias("row_key"), F.inline(cells))
    return got.withColumn("content_preview", F.when(temporal_kind(F.col("value")) != "NONE", F.concat(F.lit("[TIME] "), "value")).otherwise(F.col("value")))


def column_types(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """header (or the columns ``by``), inferred_type: integer, float, boolean, date or string; empty cells don't count."""
    v = F.when(F.trim("value") != "", F.trim("value"))
    every = lambda c: F.coalesce(F.bool_and(F.when(v.isNotNull(), c)), F.lit(False))
    by = by or ["header"]
    got = cells.groupBy(*by).agg(
        every(v.rlike(r"^[+-]?\d+$")).alias("i"),
        every(v.try_cast("double").isNotNull()).alias("f"),
        every(F.lower(v).isin("true", "false", "yes", "no")).alias("b"),
        every(v.rlike(r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4})")).alias("d"),
    )
    return got.select(*by, F.when(F.col("i"), "integer").when(F.col("f"), "float").when(F.col("b"), "boolean").when(F.col("d"), "date").otherwise("string").alias("inferred_type"))


def explode_json(docs: DataFrame, id_col: str, json_col: str, max_depth: int | None = None) -> DataFrame:
    """doc_id, path, depth, json_type, value of every node of a JSON text, down to ``max_depth`` if one is given.

    Each level explodes the level before, which is staged; the last one is empty.
    """
    node = docs.select(F.col(id_col).alias("doc_id"), F.lit("$").alias("path"), F.lit(0).alias("depth"), F.try_parse_json(F.col(json_col)).alias("v")).where("v is not null")
    out, depth = None, 0
    while True:
        s = F.schema_of_variant(F.col("v"))
        kind = F.when(F.startswith("s", F.lit("OBJECT")), "object").when(F.startswith("s", F.lit("ARRAY")), "array").when(F.col("s") == "STRING", "string").when(F.col("s") == "BOOLEAN", "boolean").when(F.col("s") == "VOID", "null").when(F.col("s") == "BIGINT", "integer").otherwise("number")
        level = staged(node.select("doc_id", "path", "depth", s.alias("s"), F.to_json("v").alias("value")).select("doc_id", "path", "depth", kind.alias("json_type"), "value"), "json-level")
        out = level if out is None else out.unionByName(level)
        inner = level.where("json_type in ('object', 'array')")
        if depth == max_depth or inner.isEmpty():
            return out
        depth += 1
        node = _children(inner.withColumn("v", F.parse_json("value")))


def _children(inner: DataFrame) -> DataFrame:
    e = inner.sparkSession.tvf.variant_explode(F.col("v").outer())
    got = inner.lateralJoin(e.select("pos", "key", F.col("value").alias("child")))
    path = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), "key"))
    return got.select("doc_id", path.alias("path"), (F.col("depth") + 1).alias("depth"), F.col("child").alias("v"))


def markdown_stats(text: Column) -> list[Column]:
    """Counts of headers, list items, code blocks and links, the title (first header of level 1) and the languages of code."""
    langs = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"(?m)^```([A-Za-z0-9_+-]+)"), 1), lambda x: x != ""))
    targets = F.regexp_extract_all(text, F.lit(r"\[[^\]\[]+\]\(([^)]+)\)"), 1)
    return [
        F.regexp_count(text, F.lit(r"(?m)^#{1,6}\s+\S")).alias("header_count"),
        F.regexp_count(text, F.lit(r"(?m)^\s*([-*+]|\d+[.)])\s+")).alias("list_item_count"),
        F.floor(F.regexp_count(text, F.lit(r"(?m)^```")) / 2).cast("int").alias("code_block_count"),
        F.size(targets).alias("link_count"),
        F.size(F.array_distinct(targets)).alias("distinct_links"),
        F.nullif(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1), F.lit("")).alias("title"),
        F.array_join(langs, ",").alias("code_languages"),
    ]


def cell_links(cells: DataFrame) -> DataFrame:
    """row_key, col, link_target, link_type: URLs and mail addresses in cells."""
    found = F.concat(
        F.transform(F.regexp_extract_all("value", F.lit(URL), 1), lambda u: F.struct(u.alias("link_target"), F.lit("url").alias("link_type"))),
        F.transform(F.regexp_extract_all("value", F.lit(EMAIL), 1), lambda m: F.struct(F.concat(F.lit("mailto:"), m).alias("link_target"), F.lit("email").alias("link_type"))),
    )
    return cells.select("row_key", "col", F.inline(found))
