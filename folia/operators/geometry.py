"""Page geometry and table structure: clusters by gaps, rectangles, cell ranges, column affinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that mark a column as naming an entity.
IDENTITIES = [
    "id", "identifier", "uuid", "guid", "key", "name", "title", "label", "person", "author", "publisher", "company", "organization", "user", "owner", "creator", "editor", "manager", "developer",
    "provider", "customer", "country", "city", "state", "province", "location", "address", "region", "type", "category", "class", "genre", "style", "format", "model", "brand", "version",
]


def is_identity(name: Column) -> Column:
    """Whether a column's name is, or contains, one of the identity words."""
    return F.lower(name).rlike("|".join(IDENTITIES))


def clusters(rows: DataFrame, by: list[str], position: str, gap: float, tie: list[str] | None = None) -> DataFrame:
    """``cluster`` numbers from 0 in each group: a new one where the gap to the row before is over ``gap``."""
    order = Window.partitionBy(*by).orderBy(position, *(tie or []))
    fresh = F.when(F.col(position) - F.lag(position).over(order) > gap, 1).otherwise(0)
    return rows.withColumn("__fresh", fresh).withColumn("cluster", F.sum("__fresh").over(order)).drop("__fresh")


def overlaps(a: tuple, b: tuple) -> Column:
    """Whether two rectangles (left, top, right, bottom) share any area or edge."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def distance(a: tuple, b: tuple) -> Column:
    """Distance of two rectangles; 0 where they overlap."""
    dx = F.greatest(b[0] - a[2], a[0] - b[2], F.lit(0.0))
    dy = F.greatest(b[1] - a[3], a[1] - b[3], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def column_number(ref: Column) -> Column:
    """A spreadsheet reference's column from 1: A is 1, AA is 27."""
    letters = F.split(F.upper(F.regexp_extract(ref, r"^\$?([A-Za-z]+)", 1)), "")
    return F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def row_number_of(ref: Column) -> Column:
    return F.regexp_extract(ref, r"(\d+)$", 1).try_cast("int")


def in_range(ref: Column, range_: Column) -> Column:
    """Whether a cell lies in a range like ``B2:D9``."""
    a, b = F.get(F.split(range_, ":"), F.lit(0)), F.element_at(F.split(range_, ":"), -1)
    return column_number(ref).between(column_number(a), column_number(b)) & row_number_of(ref).between(row_number_of(a), row_number_of(b))


def container_kinds(children: DataFrame) -> DataFrame:
    """parent, kind: array where one tag (or over four fifths) repeats, object where over half are distinct."""
    counts = children.groupBy("parent", "tag").agg(F.count("*").alias("n"))
    got = counts.groupBy("parent").agg(F.count("*").alias("tags"), F.max("n").alias("most"), F.sum("n").alias("all"))
    kind = F.when((F.col("tags") == 1) | (F.col("most") > 0.8 * F.col("all")), "array").when(F.col("tags") > 0.5 * F.col("all"), "object").otherwise("element")
    return got.select("parent", kind.alias("kind"))


def column_affinity(headers: DataFrame) -> DataFrame:
    """key_column, other_column, confidence: identity columns and others of the document that share a word.

    ``headers``: doc_id, header.  An equi join by document and word.
    """
    words = headers.select("doc_id", "header", F.explode(F.array_distinct(F.filter(F.split(F.lower("header"), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin("id", "key", "identifier")))).alias("word"))
    keys = words.where(is_identity(F.col("header"))).select("doc_id", "word", F.col("header").alias("key_column"))
    return keys.join(words.select("doc_id", "word", F.col("header").alias("other_column")), ["doc_id", "word"]).where("key_column <> other_column").select("doc_id", "key_column", "other_column", F.lit(0.7).alias("confidence")).distinct()


def header_of_cell(elements: DataFrame) -> DataFrame:
    """doc_id, element_id, header_id: the header cells above each cell of a table, and those before it in its row.

    Cells say their row, column and extent in their metadata.  A header stands over
    the columns it spans and beside the rows it spans: cells are spread over the
    columns and rows they cover and meet headers in equi joins by table and column
    or row.  A header of a row is one that isn't in a row of headers only.
    """
    of = lambda f, default: F.coalesce(F.get_json_object("metadata", f"$.{f}").cast("int"), F.lit(default)).alias(f)
    rows = elements.where("element_type in ('table_row', 'table_header_row')").select("doc_id", F.col("element_id").alias("parent_id"), F.col("parent_id").alias("table_id"))
    cells = elements.where("element_type in ('table_cell', 'table_header')").select("doc_id", "parent_id", "element_id", (F.col("element_type") == "table_header").alias("head"), of("row", 0), of("col", 0), of("rowspan", 1), of("colspan", 1))
    cells = cells.join(rows, ["doc_id", "parent_id"])
    plain = cells.groupBy("doc_id", "parent_id").agg((~F.bool_and("head")).alias("mixed"))
    cells = cells.join(plain, ["doc_id", "parent_id"])
    spread = lambda df, at, size: df.withColumn("k", F.explode(F.sequence(F.col(at), F.col(at) + F.greatest(F.col(size), F.lit(1)) - 1)))
    heads = cells.where("head").select("doc_id", "table_id", F.col("element_id").alias("header_id"), F.col("row").alias("h_row"), F.col("col").alias("h_col"), "rowspan", "colspan", "mixed")
    body = cells.where("not head").select("doc_id", "table_id", "element_id", "row", "col", "rowspan", "colspan")
    above = spread(body, "col", "colspan").join(spread(heads.where("not mixed"), "h_col", "colspan").drop("rowspan", "colspan"), ["doc_id", "table_id", "k"]).where("h_row < row")
    before = spread(body, "row", "rowspan").join(spread(heads.where("mixed"), "h_row", "rowspan").drop("rowspan", "colspan"), ["doc_id", "table_id", "k"]).where("h_col < col")
    return above.select("doc_id", "element_id", "header_id").unionByName(before.select("doc_id", "element_id", "header_id")).distinct()
