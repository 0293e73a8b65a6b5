"""License texts in documents, with DataFrame functions only.

Words are shingled by three, shingles hashed once, and documents cut into
overlapping windows of blocks of four shingles, a new one at every block: short
windows (two blocks) for notices of up to five shingles, long ones (four blocks)
for the rest.  A long template is cut into long windows too.  Each window has BANDS MinHash values (a hash function is the
exclusive or with a constant), each a band of its own.  A template that lies in
a text undamaged has a Jaccard similarity of 3/8 at least with one of its
windows, so a band retrieves it with probability 1 - (5/8)^16 > 0.999; four
fifths of one at 0.3 still give 0.996.

Whatever is retrieved is verified: the share of the template's shingles found
near the window, counted exactly, must reach the threshold.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS, SHINGLE, BLOCK = 16, 3, 4
#: Blocks in a window; a new window begins at every block.
SIZES = {"short": 2, "long": 4}
#: Templates of so many shingles at most lie whole in a short window wherever they begin.
SHORT = (SIZES["short"] - 1) * BLOCK + 1
_CONSTANTS = [random.Random(20240229 + j).getrandbits(64) for j in range(BANDS)]

# Notices and opening passages of public licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without"
        " restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom"
        " the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the Software."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must"
        " retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission"
        " notice appear in all copies."
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either"
        " version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code"
        " form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "cc0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following"
        " restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


# Each step is a column of its own that the next one names at least twice: the
# optimizer then keeps it, where it would compute an inlined one for every element.


def with_shingles(rows: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """``keep`` and h: a hash for each run of SHINGLE words (runs of letters and
    digits, in lower case); null texts have none."""
    split = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    rows = rows.select(*keep, split.alias("w"))
    n = F.size("w") - SHINGLE
    hashed = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(SHINGLE))))
    return rows.select(*keep, F.when(n >= 0, hashed).otherwise(F.array().cast("array<bigint>")).alias("h"))


def _constants() -> Column:
    # all 64 bits, as a signed number: the sign of a hash is a bit like the others
    return F.array(*(F.lit(c - (1 << 64) if c >> 63 else c).cast("long") for c in _CONSTANTS))


def with_block_minima(rows: DataFrame) -> DataFrame:
    """minima: for each hash function the least value of each block of shingles of h."""
    n = F.ceil(F.size("h") / BLOCK).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("h", i * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<bigint>>"))
    rows = rows.withColumn("blocks", parts)
    mins = F.transform(_constants(), lambda c: F.transform("blocks", lambda b: F.array_min(F.transform(b, lambda x: x.bitwiseXOR(c)))))
    return rows.withColumn("minima", F.when(F.size("blocks") > 0, mins).otherwise(F.array().cast("array<array<bigint>>"))).drop("blocks")


def _least_of_next(m: Column, step: int) -> Column:
    """Each value or, if less, the one ``step`` places on."""
    return F.zip_with(m, F.slice(m, F.lit(step + 1), F.size(m)), lambda x, y: F.least(x, y))


def _hits(windows: str, values: list[int], wider: int) -> Column:
    """The shingles, once each, by which windows have a value of a template's; the
    windows are ``wider`` blocks longer than those of the column."""

    def of_band(m: Column, j: Column) -> Column:
        least = _least_of_next(m, wider) if wider else m
        return F.transform(F.array_distinct(F.filter(least, lambda x: x.isin(values))), lambda x: x.bitwiseXOR(F.get(_constants(), j)))

    return F.array_distinct(F.flatten(F.transform(windows, of_band)))


def template_bands(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """name, size, template (its shingles), band, value: a row per template, window of it and band."""
    rows = with_shingles(spark.createDataFrame(list(templates.items()), "name string, text string"), "text", "name")
    rows = rows.withColumn("size", F.when(F.size("h") <= SHORT, F.lit("short")).otherwise(F.lit("long")))
    most = SIZES["long"] * BLOCK
    # a long template gives a window at every half window, the last one at its end
    leads = F.when(F.size("h") <= most, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), F.size("h") - most, F.lit(most // 2)), F.array(F.size("h") - most))))
    rows = rows.withColumn("lead", F.explode(leads)).withColumn("window", F.slice("h", F.col("lead") + 1, F.lit(most)))
    mins = F.transform(_constants(), lambda c: F.array_min(F.transform("window", lambda x: x.bitwiseXOR(c))))
    return rows.select("name", "size", F.col("h").alias("template"), F.posexplode(mins).alias("band", "value"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, license, containment, first_word of the templates found in each document.

    containment is the share of the template's distinct shingles that lie around
    a place of the shingle that retrieved it (a little over the template's length to
    either side); of several places the best counts, the first of equals.  Null and empty texts
    hold nothing.  Rows with equal doc_id count as one document.  The templates
    are a parameter that the caller holds in memory, which bounds their broadcast.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    if short := [k for k, t in templates.items() if len(re.findall(r"[^\W_]+", t)) < SHINGLE]:
        raise ValueError(f"templates need {SHINGLE} words: {short}")
    bands = template_bands(spark, templates)
    rows = bands.collect()
    # a template by each shingle that is the least of a window of it in some band
    known = spark.createDataFrame(rows, bands.schema).select("name", "template", F.col("size").alias("t_size"), F.col("value").bitwiseXOR(F.get(_constants(), F.col("band"))).alias("t_shingle"))
    known = known.dropDuplicates(["name", "t_size", "t_shingle"])
    text = with_shingles(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "doc_id")
    text = with_block_minima(text)
    text = text.select("doc_id", "h", F.transform("minima", lambda m: _least_of_next(m, 1)).alias("two"))
    hits = F.concat(*(F.transform(_hits("two", sorted({r["value"] for r in rows if r["size"] == size}), wider), lambda x: F.struct(F.lit(size).alias("size"), x.alias("shingle"))) for size, wider in (("short", 0), ("long", 2))))
    # outer: a filter on the array itself would be pushed below and compute it all again
    found = text.withColumn("hits", hits).select("doc_id", "h", F.explode_outer("hits").alias("hit")).select("doc_id", "h", "hit.*")
    found = found.join(F.broadcast(known), (F.col("size") == F.col("t_size")) & (F.col("shingle") == F.col("t_shingle")))
    # the template lies around one of the places of the shingle that both share
    places = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.get("h", i) == F.col("shingle"))
    around = F.size("template") + SIZES["long"] * BLOCK
    found = found.select("doc_id", "name", "template", "h", F.explode(places).alias("at")).select("doc_id", "name", "template", F.greatest(F.lit(0), F.col("at") - around).alias("start"), (F.col("at") + around).alias("end"), "h")
    found = found.select("doc_id", "name", "template", "start", F.slice("h", F.col("start") + 1, F.col("end") - F.col("start")).alias("near")).distinct()
    distinct = F.array_distinct("template")
    found = found.select("doc_id", "name", (F.size(F.array_intersect(distinct, F.col("near"))) / F.size(distinct)).alias("containment"), "near", "start", "template")
    found = found.where(F.col("containment") >= threshold)
    first = F.col("start") + F.array_position(F.transform("near", lambda x: F.array_contains(F.col("template"), x)), True) - 1
    best = F.max(F.struct("containment", (-first).alias("at")))
    return found.groupBy("doc_id", F.col("name").alias("license")).agg(best.alias("b")).select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.at")).cast("long").alias("first_word"))
