"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The link patterns, with the | among the letters of EMAIL, since results must match.
URL = r"""(https?://[^\s<>"'\(\)]+)"""
EMAIL = r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b"
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
WIKI_LINK = r"\[\[([^\]]+)\]\]"


def preview(c: Column, most: int = 100) -> Column:
    """At most ``most`` characters, with an ellipsis where something is cut off."""
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words of a longer text, joined by single spaces."""
    words = F.split(F.trim(c), r"\s+")
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(c)


def is_number(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


def element_id(doc: Column, ord_: Column, kind: Column) -> Column:
    """Deterministic id, so that a task that runs again makes the same one."""
    return F.md5(F.concat_ws("|", doc.cast("string"), ord_.cast("string"), kind))


def occurrence(c: Column, needle: str, k: int = 0, context: int = 50) -> Column:
    """Occurrence ``k`` (from 0) of a string with ``context`` characters around it.

    What isn't found is said in words, as the result of a pointer lookup is text.
    """
    parts = F.split(c, F.lit("\\Q" + needle + "\\E"), -1)
    found = F.size(parts) - 1
    before = F.char_length(F.array_join(F.slice(parts, 1, k + 1), needle))
    lo = F.greatest(F.lit(0), before - context)
    hi = F.least(F.char_length(c), before + len(needle) + context)
    cut = F.concat(F.when(lo > 0, "...").otherwise(""), F.substring(c, lo + 1, hi - lo), F.when(hi < F.char_length(c), "...").otherwise(""))
    missing = F.when(found <= 0, F.lit(f"String '{needle}' not found in content.")).otherwise(F.concat(F.lit(f"Occurrence {k} not found. String '{needle}' appears "), found.cast("string"), F.lit(" times.")))
    return F.when(found > k, cut).otherwise(missing)


def line_range(c: Column, first: int, last: int) -> Column:
    """Lines ``first`` to ``last`` (from 0, both included)."""
    return F.array_join(F.slice(F.split(c, "\n"), first + 1, last - first + 1), "\n")


def matches_any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def included(c: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusion wins; an empty list of inclusions includes everything."""
    return ~matches_any(c, exclude) & (matches_any(c, include) if include else F.lit(True))


def mask_credentials(c: Column) -> Column:
    return F.regexp_replace(c, r"://([^:/@]+):([^@]+)@", "://$1:****@")


def url_host(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def file_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))


def source_kind(c: Column) -> Column:
    """The kind of source that a pointer's scheme names; paths are files."""
    out = F.lit("file")
    for prefix, kind in (("servicenow://", "servicenow"), ("mongodb://", "mongodb"), ("jira://", "jira"), ("confluence://", "confluence"), ("https://", "web"), ("http://", "web"), ("s3://", "s3"), ("db://", "db")):
        out = F.when(F.startswith(c, F.lit(prefix)), kind).otherwise(out)
    return out


def remap_prefix(c: Column, prefixes: list[tuple[str, str]]) -> Column:
    """Replaces the first prefix of the list that a path has."""
    out = c
    for old, new in reversed(prefixes):
        out = F.when(F.startswith(c, F.lit(old)), F.concat(F.lit(new), F.substring(c, F.lit(len(old) + 1), F.char_length(c)))).otherwise(out)
    return out
