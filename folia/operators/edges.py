"""Relationships between elements: structural, explicit, semantic, cross-document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia import schema
from folia.functions.vectors import cosine


def category(kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(k.isin(schema.STRUCTURAL), "STRUCTURAL").when(k.isin(schema.EXPLICIT), "EXPLICIT_LINK").when(k.isin(schema.SEMANTIC), "SEMANTIC").otherwise("UNKNOWN")


def _edge(doc, source, kind: str, target, metadata=None):
    return F.struct(
        F.md5(F.concat_ws("|", source, F.lit(kind), target)).alias("relationship_id"), doc.alias("doc_id"), source.alias("source_id"), F.lit(kind).alias("relationship_type"), target.alias("target_reference"),
        (F.lit(None).cast("string") if metadata is None else metadata).alias("metadata"),
    )


def sibling_edges(elements: DataFrame) -> DataFrame:
    """next_sibling and previous_sibling between consecutive children of a parent.

    One shuffle by (doc_id, parent_id); only children have siblings.
    """
    by = Window.partitionBy("doc_id", "parent_id").orderBy("ord")
    pairs = elements.where("parent_id is not null").select("doc_id", "element_id", F.lead("element_id").over(by).alias("next_id")).where("next_id is not null")
    sure = F.lit('{"confidence":1.0}')
    return pairs.select(F.inline(F.array(_edge(F.col("doc_id"), F.col("element_id"), "next_sibling", F.col("next_id"), sure), _edge(F.col("doc_id"), F.col("next_id"), "previous_sibling", F.col("element_id"), sure))))


# The kind of a containment edge by the child's type; all others are contains.
CONTAINMENT = {"paragraph": "contains_text", "list_item": "contains_list_item", "table_row": "contains_table_row", "table_cell": "contains_table_cell", "table_header": "contains_table_header", "json_item": "contains_array_item"}


def containment_edges(elements: DataFrame) -> DataFrame:
    kids = elements.where("parent_id is not null")
    kind = F.lit("contains")
    for child, name in CONTAINMENT.items():
        kind = F.when(F.col("element_type") == child, name).otherwise(kind)
    down = kids.select(F.md5(F.concat_ws("|", "parent_id", kind, "element_id")).alias("relationship_id"), "doc_id", F.col("parent_id").alias("source_id"), kind.alias("relationship_type"), F.col("element_id").alias("target_reference"), F.lit(None).cast("string").alias("metadata"))
    up = kids.select(_edge(F.col("doc_id"), F.col("element_id"), "contained_by", F.col("parent_id")).alias("e")).select("e.*")
    return down.unionByName(up)


def link_edges(links: DataFrame, elements: DataFrame) -> DataFrame:
    """link edges to the targets named, and referenced_by edges from the elements they match.

    ``links``: doc_id, source_id, link_text, link_target.  A target matches the
    element of its document with that id after ``#``, else the first header with
    the link's text or target.
    """
    links = links.where("source_id is not null and link_target is not null")
    plain = links.select(_edge(F.col("doc_id"), F.col("source_id"), "link", F.col("link_target"), F.to_json(F.struct(F.col("link_text").alias("text")))).alias("e")).select("e.*")
    head = F.when(F.col("element_type") == "header", F.get_json_object("metadata", "$.text"))
    keys = elements.select(
        F.col("doc_id").alias("t_doc"), F.col("element_id").alias("t_id"), "ord",
        F.inline(F.array(F.struct(F.concat(F.lit("#"), "element_id").alias("key"), F.lit(0).alias("rank")), F.struct(F.concat(F.lit("#"), F.get_json_object("metadata", "$.id")).alias("key"), F.lit(0).alias("rank")), F.struct(head.alias("key"), F.lit(1).alias("rank")))),
    ).where("key is not null")
    asked = links.select("doc_id", "source_id", "link_text", "link_target", F.explode(F.array_distinct(F.array("link_target", F.coalesce("link_text", F.lit(""))))).alias("key"))
    hits = asked.join(keys, (F.col("doc_id") == F.col("t_doc")) & (asked["key"] == keys["key"]))
    best = hits.groupBy("doc_id", "source_id", "link_text", "link_target").agg(F.min(F.struct("rank", "ord", "t_id")).alias("b"))
    back = best.select(_edge(F.col("doc_id"), F.col("b.t_id"), "referenced_by", F.col("source_id")).alias("e")).select("e.*")
    return plain.unionByName(back)


def semantic_edges(vectors: DataFrame, threshold: float = 0.7, per_element: int = 5) -> DataFrame:
    """Pairs of elements of one document by cosine, best first.

    ``vectors``: doc_id, element_id, ord, embedding.  A document keeps at most
    ``per_element`` times as many pairs as it has elements, then those at the
    threshold.  The join is an equi join by document.
    """
    # few of the pairs reach the threshold, and those rank as they would among all
    a, b = (vectors.select("doc_id", *(F.col(c).alias(f"{c}_{s}") for c in ("element_id", "ord", "embedding"))) for s in "ab")
    pairs = a.join(b, "doc_id").where("ord_a < ord_b").withColumn("similarity", cosine(F.col("embedding_a"), F.col("embedding_b")))
    sizes = vectors.groupBy("doc_id").agg(F.count("*").alias("n"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("similarity"), "ord_a", "ord_b")
    pairs = pairs.where(F.col("similarity") >= threshold)
    return pairs.withColumn("rank", F.row_number().over(best)).join(sizes, "doc_id").where(F.col("rank") <= per_element * F.col("n")).select("doc_id", F.col("element_id_a").alias("source_id"), F.col("element_id_b").alias("target_reference"), "similarity")


def outgoing(edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Edges with what is known of their source and target element, if it is one."""
    s = elements.select(F.col("element_id").alias("source_id"), F.col("element_type").alias("source_element_type"))
    t = elements.select(F.col("element_id").alias("target_reference"), F.col("element_type").alias("target_element_type"), F.col("content_preview").alias("target_content_preview"))
    return edges.join(s, "source_id", "left").join(t, "target_reference", "left")


def union_detectors(*edges: DataFrame) -> DataFrame:
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out


def similarity_edges(pairs: DataFrame) -> DataFrame:
    """Pairs (doc_id, source_id, target_reference, similarity) as semantic edges of the relationships relation."""
    meta = F.to_json(F.struct(F.round("similarity", 6).alias("similarity")))
    return pairs.select(_edge(F.col("doc_id"), F.col("source_id"), "semantic_similarity", F.col("target_reference"), meta).alias("e")).select("e.*")


def section_edges(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    """Pairs (source, target, score) of element_pk as semantic_section edges; ``sections`` has the element_pk, element_id and doc_id of both sides."""
    a, b = (sections.select(F.col("element_pk").alias(k), F.col("element_id").alias(f"{k}_id"), F.col("doc_id").alias(f"{k}_doc")) for k in ("source", "target"))
    meta = F.to_json(F.struct(F.round("score", 6).alias("similarity_score"), F.lit(True).alias("cross_document"), F.col("source_doc").alias("source_doc_id"), F.col("target_doc").alias("target_doc_id")))
    named = pairs.join(a, "source").join(b, "target")
    return named.select(_edge(F.col("source_doc"), F.col("source_id"), "semantic_section", F.col("target_id"), meta).alias("e")).select("e.*")


def confidence(edges: DataFrame) -> DataFrame:
    """Edges with what their metadata say of confidence and similarity (null where they don't)."""
    of = lambda *names: F.coalesce(*(F.get_json_object("metadata", f"$.{f}") for f in names)).cast("double").alias(names[0])
    return edges.select("*", of("confidence"), of("similarity", "similarity_score"))


def by_confidence(edges: DataFrame, key: str = "confidence") -> DataFrame:
    """Edges by confidence or similarity, highest first; those without come last."""
    return confidence(edges).orderBy(F.desc_nulls_last(key), "relationship_id")


def between(edges: DataFrame, kinds: list[str] | None = None, at_least: float | None = None, category_: str | None = None) -> DataFrame:
    """Edges of some kinds or of a category, with a confidence or similarity of at least a bound."""
    got = confidence(edges)
    if kinds:
        got = got.where(F.col("relationship_type").isin(kinds))
    if category_:
        got = got.where(category(F.col("relationship_type")) == category_)
    if at_least is not None:
        got = got.where(F.coalesce("confidence", "similarity") >= at_least)
    return got
