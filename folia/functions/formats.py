"""Format detection as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.functions.text import file_extension

# Extension -> (document type, read mode) of the file source.
FILE_TYPES = {
    "md": ("markdown", "text"), "markdown": ("markdown", "text"), "txt": ("text", "text"), "html": ("html", "text"), "htm": ("html", "text"), "css": ("text", "text"), "js": ("text", "text"),
    "json": ("text", "text"), "xml": ("text", "text"), "yaml": ("text", "text"), "yml": ("text", "text"), "pdf": ("pdf", "binary"), "docx": ("docx", "binary"), "doc": ("doc", "binary"),
    "pptx": ("pptx", "binary"), "ppt": ("ppt", "binary"), "xlsx": ("xlsx", "binary"), "xls": ("xls", "binary"), "png": ("image", "binary"), "jpg": ("image", "binary"), "jpeg": ("image", "binary"),
    "gif": ("image", "binary"), "zip": ("binary", "binary"),
}

# Extensions by document type, for detection by path.
PATH_TYPES = {
    "markdown": ["md", "markdown", "mdown"], "docx": ["docx", "doc"], "xlsx": ["xlsx", "xls"], "pptx": ["pptx", "ppt"], "pdf": ["pdf"], "html": ["html", "htm", "xhtml"],
    "text": ["txt", "text"], "csv": ["csv", "tsv"], "json": ["json"], "xml": ["xml", "xsd", "rdf", "rss", "svg", "wsdl", "xslt"], "yaml": ["yaml", "yml"],
}

DELIMITERS = [",", "\t", ";", "|"]


def file_type(path: Column) -> Column:
    """struct(doc_type, mode); anything else is text."""
    ext, out = file_extension(path), F.struct(F.lit("text").alias("doc_type"), F.lit("text").alias("mode"))
    by = {}
    for e, v in FILE_TYPES.items():
        by.setdefault(v, []).append(e)
    for (kind, mode), names in by.items():
        out = F.when(ext.isin(names), F.struct(F.lit(kind).alias("doc_type"), F.lit(mode).alias("mode"))).otherwise(out)
    return out


def type_from_path(path: Column) -> Column:
    ext, out = file_extension(path), F.lit("text")
    for kind, names in PATH_TYPES.items():
        out = F.when(ext.isin(names), kind).otherwise(out)
    return out


def is_likely_csv(text: Column) -> Column:
    """The first five lines have the same delimiter about equally often.

    Of several such delimiters the most frequent decides (of equals the first);
    the number of fields of each line must lie within 1 of their mean.
    """
    lines = F.slice(F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n"), 1, 5)
    options = []
    for i, d in enumerate(DELIMITERS):
        counts = _counts(lines, d)
        total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
        steady = (F.array_min(counts) > 0) & (F.array_max(counts) - F.array_min(counts) <= 1)
        mean = total / F.size(counts)
        near = F.forall(counts, _near(mean))
        options.append(F.when(steady, F.struct(total.alias("total"), F.lit(-i).alias("first"), near.alias("near"))))
    best = F.greatest(*options)
    return F.coalesce((F.trim(text) != "") & best["near"], F.lit(False))


def _counts(lines: Column, delimiter: str) -> Column:
    return F.transform(lines, lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(delimiter), F.lit(""))))


def _near(mean: Column):
    return lambda x: F.abs(x - mean) <= 1


def _any(text: Column, pattern: str) -> Column:
    return text.rlike(pattern).cast("int")


def content_kind(text: Column) -> Column:
    """markdown, html or text by the number of telling patterns (fixed values)."""
    markdown = _any(text, r"(?m)^#{1,6}\s+") + _any(text, r"(?m)^-\s+") + _any(text, r"\[.+?\]\(.+?\)") + _any(text, r"(?m)^```")
    html = _any(text, r"<[a-z]+[^>]*>") + _any(text, r"</[a-z]+>") + _any(text, r"<[a-z]+[^>]*/>")
    opening = F.trim(text).rlike(r"^(<!DOCTYPE html>|<html|<\?xml)")
    return F.when(opening, "html").when(markdown >= 2, "markdown").when(html >= 2, "html").otherwise("text")


# What marks a text as HTML.
HTML_MARKS = r"(?i)<!DOCTYPE html|<html|<body|<div|<p>"


def type_from_content(text: Column) -> Column:
    """csv, markdown, html, json, xml or text, in this order of tests."""
    json = F.trim(text).rlike(r"^[\{\[]") & F.try_parse_json(text).isNotNull()
    return (
        F.when(is_likely_csv(text), "csv")
        .when(text.rlike(r"(?m)^#{1,6}\s+\S"), "markdown")
        .when(text.rlike(HTML_MARKS), "html")
        .when(json, "json")
        .when(F.trim(text).rlike(r"^<(\?xml|[A-Za-z])"), "xml")
        .otherwise("text")
    )


def type_from_magic(content: Column) -> Column:
    """By the first bytes; office files by the folder names in their directory, wherever it stands."""
    has = lambda s: F.contains(content, F.lit(s.encode()))
    zipped = F.when(has("word/"), "docx").when(has("xl/"), "xlsx").when(has("ppt/"), "pptx").otherwise("zip")
    start = lambda h: F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(h))
    return F.when(start("25504446"), "pdf").when(start("504B0304"), zipped).when(start("D0CF11E0A1B11AE1"), "ms_compound").when(F.is_valid_utf8(content.cast("string")), "text").otherwise("binary")


def detect(path: Column, content: Column, doc_type: Column | None = None) -> Column:
    """A stated type, else what the path's extension says, else what the text looks like."""
    by_path = type_from_path(path)
    stated = F.nullif(doc_type, F.lit("")) if doc_type is not None else F.lit(None).cast("string")
    return F.coalesce(stated, F.when(by_path != "text", by_path), type_from_content(F.coalesce(content, F.lit(""))), F.lit("text"))
