"""Addresses, paths, settings and packed numbers as column expressions."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """A path without empty and ``.`` parts, and with each ``..`` and the part before it gone."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).otherwise(F.array_append(a, x)))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)/*[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"([^/]*)$", 1)


def join_url(base: Column, href: Column) -> Column:
    """``href`` as it is meant on the page ``base``, its fragment left out."""
    href = F.regexp_replace(href, r"#.*$", "")
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    query = F.regexp_extract(href, r"(\?.*)$", 1)
    joined = normal_path(F.concat(F.lit("/"), dir_name(path), F.lit("/"), F.regexp_replace(href, r"\?.*$", "")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href == "", F.regexp_replace(base, r"#.*$", ""))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path, href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, normal_path(F.regexp_replace(href, r"\?.*$", "")), query))
        .otherwise(F.concat(root, joined, query))
    )


def local_links(base: Column, href: Column) -> Column:
    """A link of a local file as a path: relative to the file's folder, null for links elsewhere."""
    plain = F.regexp_replace(href, r"[?#].*$", "")
    path = F.when(F.startswith(plain, F.lit("file://")), F.substring(plain, F.lit(8), F.char_length(plain))).when(F.startswith(plain, F.lit("/")), plain).otherwise(F.concat(dir_name(base), F.lit("/"), plain))
    return F.when(~plain.rlike(r"^(?!file:)[A-Za-z][A-Za-z0-9+.-]*:") & (plain != ""), normal_path(path))


def pack_floats(v: Column) -> Column:
    """An array of numbers as little-endian 32-bit floats."""
    return F.pandas_udf(_pack, "binary")(v.cast("array<float>"))


def unpack_floats(b: Column) -> Column:
    return F.pandas_udf(_unpack, "array<float>")(b)


def _pack(s):
    import numpy as np

    return s.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def _unpack(s):
    import numpy as np

    return s.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


def text_or_base64(b: Column) -> Column:
    """Bytes as the UTF-8 text that they are, else in base 64."""
    return F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(F.base64(b))


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two vectors, null where their dimensions differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total))


def epoch(text: Column) -> Column:
    """Seconds since 1970 of an ISO time, an HTTP date or a number of seconds; null where it is none of these."""
    http = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), r" GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(text.try_cast("double"), text.try_cast("timestamp").cast("double"), http.cast("double"))


def iso(seconds: Column) -> Column:
    return F.date_format(seconds.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def without_namespaces(xml: Column) -> Column:
    """XML whose names have no prefix, for ``xpath`` functions."""
    return F.regexp_replace(F.regexp_replace(xml, r"""\sxmlns(:\w+)?=("[^"]*"|'[^']*')""", ""), r"(</?)\w+:", "$1")


def with_environment(value):
    """Settings (texts, lists, dicts) with ``${NAME}`` and ``${NAME:-default}`` replaced."""
    if isinstance(value, dict):
        return {k: with_environment(v) for k, v in value.items()}
    if isinstance(value, list):
        return [with_environment(v) for v in value]
    if not isinstance(value, str):
        return value
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), value)
