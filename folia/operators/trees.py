"""Outlines, sections, context and crawls over the parent hierarchy.

Ancestors, paths and outlines come from :mod:`folia.operators.intervals`.  A crawl
walks its links level by level with joins over staged levels and ends with the
first that is empty, or at ``max_depth``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.operators.intervals import ancestry, labelled, outline, paths, subtree
from folia.operators.staging import staged

__all__ = ["ancestry", "children", "context", "context_ancestors", "context_children", "crawl", "family_context", "labelled", "meaningful", "outline", "paths", "sections", "subtree"]


def children(elements: DataFrame) -> DataFrame:
    """parent_id and the ids of its children in order."""
    return elements.where("parent_id is not null").groupBy("doc_id", "parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "element_id"))), lambda x: x["element_id"]).alias("child_ids"))


def context(elements: DataFrame, before: int = 1, after: int = 1, most_words: int = 500, text_col: str = "content") -> DataFrame:
    """element_id, text: each element with its neighbours in document order, blank line between.

    Neighbours are the nearest elements with text; of each, a text over ``most_words`` words is cut.
    """
    from folia.functions.text import first_words

    rows = elements.where((F.col("element_type") != "root") & (F.col(text_col) != "")).withColumn("_text", first_words(F.col(text_col), most_words))
    by = Window.partitionBy("doc_id").orderBy("ord")
    ahead = F.collect_list("_text").over(by.rowsBetween(-before, -1)) if before else F.array().cast("array<string>")
    behind = F.collect_list("_text").over(by.rowsBetween(1, after)) if after else F.array().cast("array<string>")
    return rows.select("doc_id", "element_id", "ord", F.concat_ws("\n\n", "_text", ahead, behind).alias("text"))


def sections(elements: DataFrame) -> DataFrame:
    """element_id, section_id: the latest header above each element that isn't a header."""
    by = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    head = F.last(F.when(F.col("element_type") == "header", F.col("element_id")), True).over(by)
    return elements.select("doc_id", "element_id", "element_type", head.alias("section_id")).where("element_type <> 'header' and section_id is not null").drop("element_type")


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int | None = 3) -> DataFrame:
    """node, depth: what is reached from the seeds over links (source, target), each node once, at its least depth."""
    links = staged(links.select("source", "target"), "crawl-links")
    frontier = seen = staged(seeds.select("node", F.lit(0).alias("depth")).distinct(), "crawl-level")
    d = 0
    while d != max_depth:
        d += 1
        found = links.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = staged(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "crawl-level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def meaningful(elements: DataFrame, text_col: str = "content") -> DataFrame:
    """Elements that say something as context: not a root, and with text."""
    return elements.where((F.col("element_type") != "root") & (F.trim(text_col) != ""))


def context_ancestors(elements: DataFrame, depth: int = 1, text_col: str = "content") -> DataFrame:
    """element_id, texts: of each element the nearest ``depth`` ancestors with text, nearest first."""
    rows = elements.select("doc_id", "element_id", "parent_id", "element_type", text_col)
    up = ancestry(rows.select("doc_id", "element_id"), rows).where("distance > 0")
    said = meaningful(rows, text_col).select(F.col("element_id").alias("ancestor_id"), F.col(text_col).alias("said"))
    near = Window.partitionBy("element_id").orderBy("distance")
    got = up.join(said, "ancestor_id").withColumn("k", F.row_number().over(near)).where(F.col("k") <= depth)
    return got.groupBy("element_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "said"))), lambda x: x["said"]).alias("texts"))


def context_children(elements: DataFrame, count: int = 3, text_col: str = "content") -> DataFrame:
    """element_id, texts: of each element its first ``count`` children with text, in order."""
    kids = meaningful(elements, text_col).where("parent_id is not null")
    first = Window.partitionBy("parent_id").orderBy("ord", "element_id")
    kids = kids.withColumn("k", F.row_number().over(first)).where(F.col("k") <= count)
    return kids.groupBy(F.col("parent_id").alias("element_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(text_col).alias("said")))), lambda x: x["said"]).alias("texts"))


def family_context(elements: DataFrame, before: int = 1, after: int = 1, ancestors: int = 1, children: int = 1, most_words: int = 500, text_col: str = "content") -> DataFrame:
    """doc_id, element_id, text: an element with its neighbours, ancestors and children, in this order."""
    from folia.functions.text import first_words

    elements = staged(elements.select("doc_id", "element_id", "parent_id", "element_type", "ord", first_words(F.col(text_col), most_words).alias("content")), "context-elements")
    out = context(elements, before, after, most_words)
    for texts, name in ((context_ancestors(elements, ancestors), "up"), (context_children(elements, children), "down")):
        out = out.join(texts.withColumnRenamed("texts", name), "element_id", "left")
    return out.select("doc_id", "element_id", "ord", F.concat_ws("\n\n", "text", "up", "down").alias("text"))
