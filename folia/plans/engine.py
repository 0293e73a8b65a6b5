"""The engine: ingest sources into the relations and query them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folia.functions.formats import detect
from folia.operators import edges, embed, explode, markup, search, store, text_index, trees, vector_index
from folia.schema import SECTION_TYPES

Embed = Callable[[DataFrame], DataFrame]


class Engine:
    """Five relations below a root folder, each replaced as a whole version at a time.

    ``embed`` turns rows of element_pk and text into rows of element_pk and
    embedding (see ``folia.operators.embed``).  ``semantic`` is the least
    similarity of elements of one document that makes an edge, and ``across`` that
    of sections of different ones; None leaves such edges out.

    Vectors are kept in a vector index besides: ``lists`` of them, of which a
    search reads ``probes``.  The index keeps its centroids from ingest to ingest
    until there are four times the vectors they were fitted for.  With ``words``
    an inverted index of the elements' texts is kept too.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Embed | None = None, semantic: float | None = None, across: float | None = None, lists: int = 100, probes: int = 10, words: bool = False):
        self.spark, self.root, self.embed, self.semantic, self.across = spark, root.rstrip("/"), embed, semantic, across
        self.lists, self.probes, self.words = lists, probes, words

    def table(self, name: str) -> DataFrame | None:
        return store.current(self.spark, self.root, name)

    def parsed(self, docs: DataFrame) -> DataFrame:
        """Rows of all documents (doc_id, doc_type, content, perhaps bytes), each by its format's generator."""
        own = [k for k in markup.PARSERS if "bytes" in docs.columns or k not in markup.BINARY]
        text = explode.explode_text(docs.where(~F.col("doc_type").isin("markdown", *own)), "doc_id", "content")
        marked = explode.explode_markdown(docs.where("doc_type = 'markdown'"), "doc_id", "content")
        return text.withColumn("doc_id", F.col("doc_id").cast("string")).unionByName(marked).unionByName(markup.explode_mixed(docs.where(F.col("doc_type").isin(*own))))

    def links(self, docs: DataFrame, rows: DataFrame) -> DataFrame:
        """doc_id, source_id, link_text, link_target: links of text and Markdown leave the root, those of markup their element."""
        root = F.md5(F.concat_ws("|", F.col("doc_id"), F.lit("0"), F.lit("root"))).alias("source_id")
        plain = explode.text_links(docs.where(~F.col("doc_type").isin("markdown", *markup.PARSERS)), "doc_id", "content").select("doc_id", root, "link_text", "link_target")
        marked = explode.markdown_links(docs.where("doc_type = 'markdown'"), "doc_id", "content").select("doc_id", root, "link_text", "link_target")
        ids = rows.select("doc_id", "ord", F.md5(F.concat_ws("|", "doc_id", F.col("ord").cast("string"), "element_type")).alias("source_id"), "metadata")
        deep = markup.markup_links(ids.where("metadata is not null")).join(ids.select("doc_id", "ord", "source_id"), ["doc_id", "ord"]).select("doc_id", "source_id", F.lit(None).cast("string").alias("link_text"), "link_target")
        return plain.unionByName(marked).unionByName(deep)

    def ingest(self, docs: DataFrame) -> dict[str, int]:
        """Takes source_id, doc_type, content (and bytes for office files and PDF); only new and changed sources are parsed again.

        A type that isn't stated is detected.  Of rows with one source_id that with
        the greatest content hash counts.  Returns the numbers of documents,
        elements and relationships written and of unchanged documents.
        """
        more = ["bytes"] if "bytes" in docs.columns else []
        raw = F.coalesce("content", F.lit(""))
        hashed = F.md5(F.coalesce(F.col("bytes"), F.encode(raw, "UTF-8"))) if more else F.md5(raw)
        docs = docs.select("source_id", detect(F.col("source_id"), F.col("content"), F.col("doc_type")).alias("doc_type"), "content", *more, hashed.alias("content_hash"))
        docs = docs.groupBy("source_id").agg(F.max_by(F.struct("doc_type", "content", *more, "content_hash"), F.struct("content_hash", "doc_type")).alias("r")).select("source_id", "r.*")
        old = self.table("documents")
        seen = Observation()
        docs_seen = docs.observe(seen, F.count("*").alias("n"))
        todo = docs_seen if old is None else docs_seen.join(old.select("source_id", F.col("content_hash").alias("h")), "source_id", "left").where("h is null or h <> content_hash").drop("h")
        path = store.swap(todo.withColumn("doc_id", F.md5("source_id")), self.root, "batch")
        todo = self.spark.read.parquet(path)
        rows = self.spark.read.parquet(store.swap(self.parsed(todo), self.root, "rows"))
        new = explode.with_ids(rows)
        before = self.table("elements")
        elements = store.replace_elements(new.withColumn("element_pk", F.lit(0).cast("long")).limit(0) if before is None else before, new)
        elements = self.spark.read.parquet(store.swap(elements, self.root, "elements"))
        fresh = elements.join(todo.select("doc_id"), "doc_id", "left_semi")
        found = edges.union_detectors(edges.containment_edges(fresh), edges.sibling_edges(fresh), edges.link_edges(self.links(todo, rows), fresh))
        if self.embed:
            vectors = self.embed(trees.context(explode.with_ids(rows, whole=True)).join(fresh.select("element_id", "element_pk"), "element_id").select("element_pk", "text"))
            had = self.table("embeddings")
            if had is not None:
                vectors = had.join(elements.select("element_pk"), "element_pk", "left_semi").join(fresh.select("element_pk"), "element_pk", "left_anti").unionByName(vectors)
            vectors = self.spark.read.parquet(store.swap(vectors, self.root, "embeddings"))
            found = edges.union_detectors(found, *self._similar(fresh, elements, self._indexed(elements, fresh, vectors)))
        if self.words:
            self._words_indexed(elements, explode.with_ids(rows, whole=True).join(fresh.select("element_id", "element_pk"), "element_id").select("element_pk", F.col("content").alias("text")))
        kept = self.table("relationships")
        if kept is not None:
            kept = kept.join(todo.select("doc_id"), "doc_id", "left_anti")
            if before is not None:  # sections of other documents may be like ones that have gone or changed
                stale = before.join(todo.select("doc_id"), "doc_id", "left_semi").select(F.col("element_id").alias("target_reference"), F.lit("semantic_section").alias("relationship_type"))
                kept = kept.join(stale, ["target_reference", "relationship_type"], "left_anti").select(found.columns)
            found = kept.unionByName(found)
        store.swap(found, self.root, "relationships")
        changed, total = todo.count(), seen.get["n"]
        documents = todo.select("source_id", "doc_id", "doc_type", "content_hash")
        store.swap(documents if old is None else store.upsert(old, documents, "source_id"), self.root, "documents")
        return {"documents": changed, "unchanged": total - changed, "elements": fresh.count(), "relationships": self.table("relationships").join(todo.select("doc_id"), "doc_id", "left_semi").count()}

    def crawl(self, contents: DataFrame, seeds: DataFrame, root: str, max_depth: int | None = 3) -> DataFrame:
        """Ingests the seeds (column target: source ids) and what their local links reach; returns source ids with their depth.

        ``contents`` has source_id, doc_type and content of whatever may be reached,
        as any source gives it.  ``root`` keeps the state, so a later call goes on.
        """
        from folia.functions.values import local_links
        from folia.streaming import follow

        reached = lambda new: contents.join(new.withColumnRenamed("target", "source_id"), "source_id", "left_semi")

        def links(new: DataFrame) -> DataFrame:
            docs = reached(new).select("source_id", detect(F.col("source_id"), F.col("content"), F.col("doc_type")).alias("doc_type"), "content", F.col("source_id").alias("doc_id"))
            found = self.links(docs, explode.with_ids(self.parsed(docs)))
            return found.select(F.col("doc_id").alias("source"), local_links(F.col("doc_id"), F.col("link_target")).alias("target"))

        follow.add_seeds(seeds, root)
        return follow.follow(self.spark, root, links, max_depth, lambda new: self.ingest(reached(new)))

    def index(self) -> vector_index.Index | None:
        path = store.current_path(self.spark, self.root, "vector_index")
        return vector_index.open_index(self.spark, path) if path else None

    def _indexed(self, elements: DataFrame, fresh: DataFrame, vectors: DataFrame) -> vector_index.Index:
        """A new version of the vector index: rows of unchanged documents stay as they are, those of ``fresh`` are dealt anew."""
        described = lambda rows: rows.join(elements.select("element_pk", "doc_id", "element_type"), "element_pk").select("element_pk", "doc_id", "element_type", "embedding")
        old, path = self.index(), store.new_version(self.root, "vector_index")
        fitted = 0 if old is None else sum(old.sizes.values())
        if not fitted or vectors.count() > 4 * fitted:
            got = vector_index.build(described(vectors), path, lists=self.lists)
        else:
            kept = old.rows.join(elements.select("element_pk"), "element_pk", "left_semi").join(fresh.select("element_pk"), "element_pk", "left_anti")
            new = vectors.join(fresh.select("element_pk"), "element_pk", "left_semi")
            got = vector_index.write(kept.unionByName(vector_index.assigned(described(new), old.model)), old.model, path)
        store.point(self.spark, self.root, "vector_index", path)
        return got

    def text_index(self) -> text_index.TextIndex | None:
        path = store.current_path(self.spark, self.root, "text_index")
        return text_index.open_index(self.spark, path) if path else None

    def _words_indexed(self, elements: DataFrame, texts: DataFrame) -> None:
        """A new version of the inverted index: postings of unchanged documents stay, those of the texts are made anew."""
        old, path, new = self.text_index(), store.new_version(self.root, "text_index"), text_index.postings(texts)
        if old is not None:
            kept = old.rows.drop("bucket").join(elements.select(F.col("element_pk").alias("id")), "id", "left_semi").join(texts.select(F.col("element_pk").alias("id")), "id", "left_anti")
            new = kept.unionByName(new)
        text_index.write(new, path)
        store.point(self.spark, self.root, "text_index", path)

    def search_words(self, text: str, limit: int = 10) -> DataFrame:
        """Elements by BM25 of their own texts, best first (needs ``words``)."""
        hits = self.text_index().search(text, limit).withColumnRenamed("id", "element_pk")
        return self.table("elements").join(F.broadcast(hits), "element_pk").orderBy(F.desc("score"), "element_pk")

    def search_hybrid(self, text: str, limit: int = 10, candidates: int = 1000) -> DataFrame:
        """Elements by text and vector scores together: of either side the best ``candidates`` are ranked."""
        vectors = embed.query_vector(self.spark, self.embed, text)
        near = self.index().search(vectors, candidates, self.probes)
        said = self.text_index().search(text, candidates).withColumnRenamed("id", "element_pk")
        return self.table("elements").join(F.broadcast(search.hybrid_rank(said, near, limit)), "element_pk").orderBy(F.desc("score"), "element_pk")

    def _similar(self, fresh: DataFrame, elements: DataFrame, index: vector_index.Index) -> list[DataFrame]:
        """Semantic edges in the documents just parsed, and from their sections to those of other documents."""
        new = index.rows.join(fresh.select("element_pk", "element_id", "ord"), "element_pk")
        out = []
        if self.semantic is not None:
            out.append(edges.similarity_edges(edges.semantic_edges(new.select("doc_id", "element_id", "ord", "embedding"), self.semantic)))
        if self.across is not None:
            section = F.lower("element_type").isin(SECTION_TYPES)
            pairs = index.knn_join(new.where(section), 20, self.probes, group="doc_id", threshold=self.across, where=section)
            out.append(edges.section_edges(pairs, elements))
        return out

    def search_text(self, text: str, limit: int = 10, wanted: dict | None = None, min_score: float = 0.0) -> DataFrame:
        """Hits of a text: its vector is made as those of the elements were."""
        return self.search(embed.query_vector(self.spark, self.embed, text), limit, wanted, min_score)

    def document(self, doc_id: str) -> DataFrame:
        return self.table("documents").where(F.col("doc_id") == doc_id)

    def element(self, key: int | str) -> DataFrame:
        """By element_pk or element_id."""
        return self.table("elements").where(F.col("element_pk" if isinstance(key, int) else "element_id") == key)

    def document_elements(self, source: str) -> DataFrame:
        """By doc_id or source_id, in document order."""
        ids = self.table("documents").where((F.col("doc_id") == source) | (F.col("source_id") == source)).select("doc_id")
        return self.table("elements").join(ids, "doc_id", "left_semi").orderBy("doc_id", "ord")

    def document_relationships(self, doc_id: str) -> DataFrame:
        ids = self.table("elements").where(F.col("doc_id") == doc_id).select(F.col("element_id").alias("source_id"))
        return self.table("relationships").join(ids, "source_id", "left_semi")

    def counts(self) -> dict[str, int]:
        """Rows of each relation; 0 for one that isn't there yet."""
        return {t: 0 if (df := self.table(t)) is None else df.count() for t in ("documents", "elements", "relationships", "embeddings")}

    def search(self, query: list[float], limit: int = 10, wanted: dict | None = None, min_score: float = 0.0) -> DataFrame:
        """Hits with their elements, best first; at least ``min_score`` among the best 2 * limit.

        Without ``wanted`` the lists of the index that are nearest to the query are
        read; with it, the elements are filtered first and all their vectors compared.
        """
        elements, index = self.table("elements"), self.index()
        if wanted or index is None:
            allowed = elements.where(search.criteria(wanted or {}))
            hits = search.top_k(self.table("embeddings").join(allowed.select("element_pk"), "element_pk", "left_semi"), query, 2 * limit)
        else:
            hits = index.search(query, 2 * limit, self.probes)
        hits = hits.where(F.col("score") >= min_score)
        # at most 2 * limit rows
        return elements.join(F.broadcast(hits), "element_pk").orderBy(F.desc("score"), "element_pk").limit(limit)

    def search_outline(self, query: list[float], limit: int = 10, include_parents: bool = True, **more) -> DataFrame:
        got = trees.outline(self.search(query, limit, **more).select("doc_id", "element_id", "score"), self.table("elements"))
        return got if include_parents else got.where("score is not null")

    def search_enriched(self, query: list[float], limit: int = 10, **more) -> DataFrame:
        """Hits with the relationships that leave them."""
        hits = self.search(query, limit, **more)
        out = edges.outgoing(self.table("relationships"), self.table("elements")).join(hits.select(F.col("element_id").alias("source_id")), "source_id", "left_semi")
        links = out.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("relationship_type", "target_reference", "target_content_preview"))).alias("relationships"))
        return hits.join(links, hits.element_id == links.source_id, "left").drop("source_id")

    def sources(self, query: list[float], limit: int = 10, **more) -> DataFrame:
        return self.search(query, limit, **more).join(self.table("documents").select("doc_id", "source_id"), "doc_id").select("source_id").distinct()

    def top_documents(self, query: list[float], limit: int = 10, **more) -> DataFrame:
        """Each document's best hit, best first."""
        return search.best_per_document(self.search(query, limit, **more)).orderBy(F.desc("score"), "doc_id")

    def delete(self, source_ids: list[str]) -> None:
        gone = self.table("documents").where(F.col("source_id").isin(source_ids)).select("doc_id")
        had = self.table("embeddings")
        elements, links, vectors = store.delete_documents(gone, self.table("elements"), self.table("relationships"), self.table("elements").select("element_pk") if had is None else had)
        documents = self.table("documents").join(gone, "doc_id", "left_anti")
        store.swap(links, self.root, "relationships")
        if had is not None:
            store.swap(vectors, self.root, "embeddings")
        if index := self.index():
            path = store.new_version(self.root, "vector_index")
            vector_index.write(index.rows.join(gone, "doc_id", "left_anti"), index.model, path)
            store.point(self.spark, self.root, "vector_index", path)
        if words := self.text_index():
            path = store.new_version(self.root, "text_index")
            text_index.write(words.rows.drop("bucket").join(elements.select(F.col("element_pk").alias("id")), "id", "left_semi"), path)
            store.point(self.spark, self.root, "text_index", path)
        store.swap(elements, self.root, "elements")
        store.swap(documents, self.root, "documents")
