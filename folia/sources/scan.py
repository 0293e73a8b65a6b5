"""Sources: files, database rows in blob and JSON mode, and pre-fetched web pages.

All give source_id, doc_type, content, content_hash, metadata.  REST services are
read through any DataFrame of their records (``record_source``): paging and log-in
are the connector's business, selection and order are here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions.formats import file_type
from folia.functions.text import file_extension, included, url_host


def file_source(spark: SparkSession, base: str, pattern: str = "*", include_extensions: list[str] | None = None, exclude_extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """Files below ``base``; text is read as UTF-8, binary files keep their bytes only."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(base)
    ext = file_extension(F.col("path"))
    if exclude_extensions:
        got = got.where(~ext.isin([e.lstrip(".").lower() for e in exclude_extensions]))
    if include_extensions:
        got = got.where(ext.isin([e.lstrip(".").lower() for e in include_extensions]))
    kind = file_type(F.col("path"))
    meta = F.to_json(F.struct(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("size"), ext.alias("extension")))
    return got.select(F.col("path").alias("source_id"), kind["doc_type"].alias("doc_type"), F.when(kind["mode"] == "text", F.col("content").cast("string")).alias("content"), F.col("content").alias("bytes"), F.md5("content").alias("content_hash"), meta.alias("metadata"), F.col("modificationTime").cast("double").alias("modified_at"))


def blob_source(rows: DataFrame, name: str, id_col: str, content_col: str, metadata_cols: list[str] | None = None, timestamp_col: str | None = None) -> DataFrame:
    """One document per row: the content column, or a note on its size where it isn't text."""
    raw = F.col(content_col)
    text = raw if dict(rows.dtypes)[content_col] != "binary" else F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.concat(F.lit("<binary data: "), F.octet_length(raw).cast("string"), F.lit(" bytes>")))
    meta = F.to_json(F.struct(*metadata_cols)) if metadata_cols else F.lit("{}")
    uri = F.concat_ws("/", F.lit(f"db://{name}"), F.lit(id_col), F.col(id_col).cast("string"), F.lit(content_col))
    return rows.select(uri.alias("source_id"), text.alias("content"), F.md5(text).alias("content_hash"), meta.alias("metadata"), (F.col(timestamp_col).cast("double") if timestamp_col else F.lit(None).cast("double")).alias("modified_at"))


def json_source(rows: DataFrame, name: str, id_col: str, columns: list[str] | None = None) -> DataFrame:
    """One JSON object per row of the chosen columns (all but the id); bytes that aren't text as base64."""
    columns = columns or [c for c in rows.columns if c != id_col]
    kinds = dict(rows.dtypes)
    fields = [F.when(F.is_valid_utf8(F.col(c).cast("string")), F.col(c).cast("string")).otherwise(F.base64(c)).alias(c) if kinds[c] == "binary" else F.col(c) for c in columns]
    content = F.to_json(F.struct(*fields))
    suffix = "_".join(columns[:3]) + (f"_plus_{len(columns) - 3}_more" if len(columns) > 3 else "")
    return rows.select(F.concat_ws("/", F.lit(f"db://{name}"), F.lit(id_col), F.col(id_col).cast("string"), F.lit(suffix)).alias("source_id"), content.alias("content"), F.md5(content).alias("content_hash"))


def web_source(pages: DataFrame, url_col: str = "url", html_col: str = "html", include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Pages whose address the patterns admit."""
    got = pages.where(included(F.col(url_col), include or [], exclude or []))
    return got.select(F.col(url_col).alias("source_id"), F.lit("html").alias("doc_type"), F.col(html_col).alias("content"), F.md5(html_col).alias("content_hash"))


def record_source(records: DataFrame, name: str, id_col: str, content_col: str | None = None, wanted: dict | None = None, sort_by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Records of a service: filter, order, limit; without a content column the whole record is JSON."""
    from folia.operators.search import criteria

    got = records.where(criteria(wanted or {}))
    if sort_by:
        got = got.orderBy(*sort_by)
    if limit is not None:
        got = got.limit(limit)
    content = F.col(content_col) if content_col else F.to_json(F.struct("*"))
    return got.select(F.concat(F.lit(f"{name}://"), F.col(id_col).cast("string")).alias("source_id"), content.alias("content"), F.md5(content).alias("content_hash"))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html", same_host: bool = True) -> DataFrame:
    """source, target: absolute addresses of each page's links, without itself and, by default, other hosts."""
    raw = pages.select(F.col(url_col).alias("source"), F.explode(F.regexp_extract_all(html_col, F.lit(r"""<a\s[^>]*href=["']([^"'#]+)"""), 1)).alias("href"))
    host, root = url_host(F.col("source")), F.regexp_extract("source", r"^([A-Za-z]+://[^/?#]*)", 1)
    base = F.regexp_replace(F.regexp_replace("source", r"[?#].*$", ""), r"(?<![:/])/[^/]*$", "")
    target = F.when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.startswith("href", F.lit("/")), F.concat(root, "href")).otherwise(F.concat(base, F.lit("/"), "href"))
    got = raw.select("source", target.alias("target"), host.alias("host")).where("target <> source")
    return (got.where(url_host(F.col("target")) == F.col("host")) if same_host else got).select("source", "target").distinct()


def changed(listing: DataFrame, history: DataFrame) -> DataFrame:
    """Listed sources that are new, or modified after they were last processed; unknown times count as changed."""
    h = history.select("source_id", "last_modified")
    return listing.join(h, "source_id", "left").where("last_modified is null or modified_at is null or modified_at > last_modified").drop("last_modified")
