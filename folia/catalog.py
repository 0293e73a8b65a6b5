"""The registered queries of the engine proper, each with its SQL where SQL can say the same.

Elements come from ``documents``: a root, a paragraph per line, and (for the
deeper tree) a line per sentence.  ``embeddings`` play the element vectors:
``vec_id`` is the element_pk, ``vec_id div 10`` the document, ``label`` the type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia.functions import formats, temporal, text
from folia.operators import edges, explode, geometry, markup, search, selectors, statistics, store, text_index, trees, vector_index
from folia.operators.staging import shared_folder
from folia.sources import scan
from folia.streaming import follow, refresh

FLAGSHIP = "vector_topk"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return explode.explode_text(_t(spark, sf, "documents"), separator="\n")


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    return explode.with_ids(_paragraphs(spark, sf))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("element_pk"), F.floor(F.col("vec_id") / 10).cast("long").alias("doc_id"), F.col("label").alias("element_type"), "embedding")


_PROBE = [((i * 37) % 101 - 50) / 50 for i in range(64)]
_PROBE_SQL = "[" + ", ".join(f"({x!r})::double" for x in _PROBE) + "]"

# the elements relation in SQL
EL = """
w as (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents),
x as (select doc_id, list_filter(list_transform(s, lambda a: trim(a, ' ')), lambda a: length(a) >= 1) as p from w),
y as (select doc_id, unnest(p) as content, unnest(range(1, len(p) + 1))::int as ord from x),
e as (select doc_id, 0 as ord, 'root' as element_type, null as content from documents union all select doc_id, ord, 'paragraph', content from y),
el as (select md5(doc_id || '|' || ord || '|' || element_type) as element_id, doc_id::varchar as doc_id, element_type,
  case when ord > 0 then md5(doc_id || '|0|root') end as parent_id, ord,
  case when length(content) > 100 then substring(content, 1, 100) || '...' else content end as content_preview, md5(coalesce(content, '')) as content_hash from e)
"""
SC = f"""
sc as (select vec_id as element_pk, vec_id // 10 as doc_id, label as element_type,
  list_sum(list_transform(list_zip(embedding, {_PROBE_SQL}), lambda z: z[1]::double * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda a: a::double * a::double))) * sqrt(list_sum(list_transform({_PROBE_SQL}, lambda a: a * a)))) as score from embeddings)
"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    from folia.functions.vectors import cosine, literal

    return _vectors(spark, sf).select("element_pk", "doc_id", "element_type", cosine(F.col("embedding"), literal(_PROBE)).alias("score"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- sources -----------------------------------------------------------------


@query("select page_id, case when regexp_extract(regexp_replace(url, '[?#].*$', ''), '[.]([A-Za-z0-9]+)$', 1) in ('html', 'htm') then 'html' else 'text' end as doc_type, 'text' as mode from pages")
def file_types(spark, sf):
    kind = formats.file_type(F.col("url"))
    return _t(spark, sf, "pages").select("page_id", kind["doc_type"].alias("doc_type"), kind["mode"].alias("mode"))


@query("select 'db://corpus/doc_id/' || doc_id || '/text' as source_id, md5(text) as content_hash, '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' as metadata from documents")
def database_blobs(spark, sf):
    return scan.blob_source(_t(spark, sf, "documents"), "corpus", "doc_id", "text", ["lang", "source"]).select("source_id", "content_hash", "metadata")


@query("""select 'db://shop/c_custkey/' || c_custkey || '/c_name_c_nationkey_c_mktsegment' as source_id, '{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}' as content,
  md5('{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}') as content_hash from customer""")
def database_json(spark, sf):
    return scan.json_source(_t(spark, sf, "customer"), "shop", "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


@query("select url as source_id, 'html' as doc_type, md5(html) as content_hash from pages where regexp_matches(url, '^https://') and not regexp_matches(url, 'blog[.]')")
def web_pages(spark, sf):
    return scan.web_source(_t(spark, sf, "pages"), include=["^https://"], exclude=[r"blog\."]).select("source_id", "doc_type", "content_hash")


@query("""with h as (select page_id, url as source, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) as root, unnest(regexp_extract_all(html, '<a\\s[^>]*href=["'']([^"''#]+)', 1)) as href from pages)
  select distinct source, root || href as target from h where href like '/%' and root || href <> source""")
def web_links(spark, sf):
    return scan.page_links(_t(spark, sf, "pages"))


@query("select o_orderkey as id, o_totalprice as total from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') order by o_totalprice desc, o_orderkey limit 50")
def record_scan(spark, sf):
    got = _t(spark, sf, "orders").where(search.criteria({"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]}))
    return got.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))


@query("select c_custkey, 'postgres://' || lower(c_mktsegment) || ':****@host/' || c_custkey as masked from customer")
def masked_credentials(spark, sf):
    uri = F.concat(F.lit("postgres://"), F.lower("c_mktsegment"), F.lit(":pw"), F.col("c_custkey").cast("string"), F.lit("@host/"), F.col("c_custkey").cast("string"))
    return _t(spark, sf, "customer").select("c_custkey", text.mask_credentials(uri).alias("masked"))


@query("select page_id, 'web' as kind, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, case when url like 'http://%' then '/mirror/' || substring(url, 8) else url end as remapped from pages")
def source_kinds(spark, sf):
    u = F.col("url")
    return _t(spark, sf, "pages").select("page_id", text.source_kind(u).alias("kind"), text.url_host(u).alias("host"), text.remap_prefix(u, [("http://", "/mirror/")]).alias("remapped"))


@query("""select doc_id::varchar as source_id, case when doc_id % 3 = 0 then 'new' when doc_id % 3 = 1 then 'unchanged' else 'changed' end as status from documents
  union all select 'gone' || doc_id, 'gone' from documents where doc_id % 7 = 0""")
def change_detection(spark, sf):
    d = _t(spark, sf, "documents")
    now = d.select(F.col("doc_id").cast("string").alias("source_id"), F.md5("text").alias("content_hash"))
    known = d.where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("doc_id") % 3 == 1, F.md5("text")).otherwise("old").alias("content_hash"))
    gone = d.where("doc_id % 7 = 0").select(F.concat(F.lit("gone"), F.col("doc_id").cast("string")).alias("source_id"), F.lit("old").alias("content_hash"))
    return store.changes(known.unionByName(gone), now)


@query("select doc_id from documents where n_chars > 500 or doc_id % 2 = 1")
def modified_since(spark, sf):
    d = _t(spark, sf, "documents")
    listing = d.select("doc_id", F.col("doc_id").cast("string").alias("source_id"), F.col("n_chars").cast("double").alias("modified_at"))
    return scan.changed(listing, d.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("source_id"), F.lit(500.0).alias("last_modified"))).select("doc_id")


# --- formats and parsing -----------------------------------------------------


@query("""with l as (select page_id, html,
    (regexp_matches(html, '(?m)^#{1,6}\\s+'))::int + (regexp_matches(html, '(?m)^-\\s+'))::int + (regexp_matches(html, '\\[.+?\\]\\(.+?\\)'))::int + (regexp_matches(html, '(?m)^```'))::int as m,
    (regexp_matches(html, '<[a-z]+[^>]*>'))::int + (regexp_matches(html, '</[a-z]+>'))::int + (regexp_matches(html, '<[a-z]+[^>]*/>'))::int as h from pages)
  select page_id, case when starts_with(html, '<!DOCTYPE html>') then 'html' when m >= 2 then 'markdown' when h >= 2 then 'html' else 'text' end as kind from l""")
def content_kinds(spark, sf):
    return _t(spark, sf, "pages").select("page_id", formats.content_kind(F.col("html")).alias("kind"))


@query("""with l as (select doc_id, text, list_slice(string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)), 1, 5) as ls from documents),
  c as (select doc_id, text, list_transform([',', chr(9), ';', '|'], lambda d: list_transform(ls, lambda x: length(x) - length(replace(x, d, '')))) as cs from l),
  o as (select doc_id, text, unnest(cs) as k, unnest(range(1, 5)) as i from c),
  s as (select doc_id, arg_max(k, (list_sum(k) * 10 - i)) as k from o where list_min(k) > 0 and list_max(k) - list_min(k) <= 1 group by doc_id)
  select d.doc_id, coalesce(len(list_filter(s.k, lambda x: abs(x - list_avg(s.k)) > 1)) = 0, false) as is_csv from documents d left join s using (doc_id)""")
def likely_csv(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", formats.is_likely_csv(F.col("text")).alias("is_csv"))


@query("with" + EL + "select element_id, doc_id, element_type, parent_id, ord, content_preview, content_hash from el")
def text_elements(spark, sf):
    return _elements(spark, sf).drop("metadata")


@query("""select doc_id, length(text) as char_count, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) as word_count, len(string_split(text, chr(10))) as line_count,
  len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ') <> '')) as paragraph_count, substring(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], 1, 100) as title from documents""")
def text_statistics(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", *explode.text_stats(F.col("text")))


@query("""select doc_id, m as link_text, 'mailto:' || m as link_target, 'email' as link_type from (select doc_id, unnest(regexp_extract_all(text, '\\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,})\\b', 1)) as m from documents)
  union all select doc_id, u, u, 'url' from (select doc_id, unnest(regexp_extract_all(text, '(https?://[^\\s<>"''\\(\\)]+)', 1)) as u from documents)""")
def text_links(spark, sf):
    return explode.text_links(_t(spark, sf, "documents"))


@query()
def html_elements(spark, sf):
    return explode.with_ids(markup.explode_markup(_t(spark, sf, "pages"), "html", "page_id", "html"))


@query()
def markdown_turns(spark, sf):
    """All turns with their whole texts, each a document of its own."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    docs = _t(spark, sf, "conversations").select("conv_id", F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")), F.row_number().over(same).cast("string")).alias("id"), "text")
    rows = explode.explode_markdown(docs, "id")
    rows = rows.join(docs.select(F.col("id").alias("doc_id"), "conv_id"), "doc_id")
    return rows.groupBy(F.col("conv_id").alias("doc_id"), "element_type", "parent_type").agg(F.count("*").alias("n"))


@query("""select c_custkey as row_key, unnest([0, 1, 2]) as col, unnest(['c_name', 'c_nationkey', 'c_mktsegment']) as header, unnest([c_name, c_nationkey::varchar, c_mktsegment]) as value,
  unnest([c_name, case when c_nationkey < 24 then '[TIME] ' || c_nationkey else c_nationkey::varchar end, c_mktsegment]) as content_preview from customer""")
def csv_cells(spark, sf):
    return explode.explode_cells(_t(spark, sf, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


@query("select * from (values ('c_name', 'string'), ('c_nationkey', 'integer'), ('c_acctbal', 'float'), ('day', 'date'), ('flag', 'boolean')) t(header, inferred_type)")
def csv_column_types(spark, sf):
    rows = _t(spark, sf, "customer").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey"))).withColumn("flag", F.col("c_nationkey") % 2 == 0)
    return explode.column_types(explode.explode_cells(rows, "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "day", "flag"]))


@query("""select event_id as doc_id, '$' as path, 0 as depth, 'object' as json_type, json(props)::varchar as value from events
  union all select event_id, '$.' || k, 1, 'integer', json_extract_string(props, '$.' || k) from (select event_id, props, unnest(json_keys(props)) as k from events)""")
def json_nodes(spark, sf):
    return explode.explode_json(_t(spark, sf, "events"), "event_id", "props")


@query()
def xml_elements(spark, sf):
    rows = _t(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("<nation><name>"), "n_name", F.lit("</name><region>"), F.col("n_regionkey").cast("string"), F.lit("</region></nation>")).alias("content"))
    return markup.explode_markup(rows, "xml", "n_nationkey")


@query("""select doc_id, case when strpos(text, 'the') = 0 then 'String ''the'' not found in content.' else (case when strpos(text, 'the') - 1 > 20 then '...' else '' end) || substring(text, greatest(strpos(text, 'the') - 20, 1), least(length(text), strpos(text, 'the') - 1 + 3 + 20) - greatest(strpos(text, 'the') - 1 - 20, 0)) || (case when strpos(text, 'the') - 1 + 3 + 20 < length(text) then '...' else '' end) end as excerpt,
  array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) as lines from documents""")
def resolved_pointers(spark, sf):
    t = F.col("text")
    return _t(spark, sf, "documents").select("doc_id", text.occurrence(t, "the", 0, 20).alias("excerpt"), text.line_range(t, 1, 2).alias("lines"))


# --- temporal ----------------------------------------------------------------


@query("""select event_id, 'TIME' as k1, 'DATE' as k2, 'DATETIME' as k3, 'TIME_RANGE' as k4, 'NONE' as k5 from events""")
def temporal_kinds(spark, sf):
    ts = F.col("ts")
    cols = [F.date_format(ts, "HH:mm"), F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.concat(F.date_format(ts, "HH:mm"), F.lit("-"), F.date_format(ts, "HH:mm")), F.concat(F.lit("event "), F.col("event_type"))]
    return _t(spark, sf, "events").select("event_id", *(temporal.temporal_kind(c).alias(f"k{i}") for i, c in enumerate(cols, 1)))


@query("""with t as (select event_id, ts, hour(ts) as h, minute(ts) as m, extract(second from ts)::int as s, case when hour(ts) % 12 = 0 then 12 else hour(ts) % 12 end as h12, case when hour(ts) < 12 then 'AM' else 'PM' end as ap from events)
  select event_id, 'at ' || case when s = 0 and m = 0 then 'o''clock ' || h12 || ' ' || ap when s = 0 and m = 15 then 'quarter past ' || h12 || ' ' || ap when s = 0 and m = 30 then 'half past ' || h12 || ' ' || ap when s = 0 and m = 45 then 'quarter to ' || (h12 % 12 + 1) || ' ' || ap
    else h12 || ':' || lpad(m::varchar, 2, '0') || ' ' || ap end || ' in the ' || case when h between 4 and 11 then 'morning' when h between 12 and 16 then 'afternoon' when h between 17 and 20 then 'evening' else 'night' end
    || case when m <> 0 then ', at minute ' || m else '' end || case when s <> 0 then ', at second ' || s else '' end as time_phrase,
  'the month of ' || strftime(ts, '%B') || ' (' || ['first', 'second', 'third', 'fourth'][quarter(ts)] || ' quarter), in the ' || ['first', 'second', 'third', 'fourth', 'fifth'][(day(ts) - 1) // 7 + 1] || ' week, on ' || strftime(ts, '%A') || ' day ' || day(ts)
    || ', in the year ' || year(ts) || ', during the ' || ['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth'][(year(ts) % 100) // 10 + 1] || ' decade of the ' || (year(ts) // 100 + 1) || 'th century' as date_phrase from t""")
def temporal_phrases(spark, sf):
    return _t(spark, sf, "events").select("event_id", temporal.time_phrase(F.col("ts")).alias("time_phrase"), temporal.date_phrase(F.col("ts")).alias("date_phrase"))


# --- filters -----------------------------------------------------------------


@query("select doc_id, lang, source from documents where lang = 'en' and source in ('src1', 'src2') order by doc_id limit 100")
def find_documents(spark, sf):
    return search.find(_t(spark, sf, "documents"), {"lang": "en", "source": ["src1", "src2"]}).select("doc_id", "lang", "source")


@query("with" + EL + "select element_id, doc_id, ord from el where element_type = 'paragraph' and doc_id not in ('1', '2') and ord in (1, 3)")
def find_elements(spark, sf):
    return _elements(spark, sf).where(search.criteria({"element_type": "paragraph", "exclude_doc_id": ["1", "2"], "ord": [1, 3]})).select("element_id", "doc_id", "ord")


@query("select event_id from events where json_extract_string(props, '$.k') = '7'")
def metadata_filter(spark, sf):
    return _t(spark, sf, "events").withColumnRenamed("props", "metadata").where(search.criteria({"metadata": {"k": 7}})).select("event_id")


@query("with" + EL + "select element_id from el where contains(lower(content_preview), 'the th')")
def content_search(spark, sf):
    return search.containing(_elements(spark, sf), "content_preview", "The TH").select("element_id")


@query("with" + EL + "select el.element_id, d.source from el join documents d on el.doc_id = d.doc_id::varchar where d.source = 'src3'")
def document_elements(spark, sf):
    d = _t(spark, sf, "documents").where("source = 'src3'").select(F.col("doc_id").cast("string").alias("doc_id"), "source")
    return _elements(spark, sf).join(d, "doc_id").select("element_id", "source")


@query("with" + EL + "select element_type, element_type = 'root' as is_root, parent_id is not null as has_parent, element_type = 'root' as is_container, count(*) as n from el group by all")
def element_predicates(spark, sf):
    from folia.schema import CONTAINERS

    e = _elements(spark, sf)
    return e.groupBy("element_type", (F.col("element_type") == "root").alias("is_root"), F.col("parent_id").isNotNull().alias("has_parent"), F.lower("element_type").isin(CONTAINERS).alias("is_container")).agg(F.count("*").alias("n"))


# --- edges -------------------------------------------------------------------


@query("with" + EL + """, p as (select doc_id, element_id, lead(element_id) over (partition by doc_id, parent_id order by ord) as nx from el where parent_id is not null)
  select doc_id, element_id as source_id, 'next_sibling' as relationship_type, nx as target_reference from p where nx is not null union all select doc_id, nx, 'previous_sibling', element_id from p where nx is not null""")
def sibling_edges(spark, sf):
    return edges.sibling_edges(_elements(spark, sf)).select("doc_id", "source_id", "relationship_type", "target_reference")


@query("with" + EL + "select parent_id as source_id, 'contains_text' as relationship_type, element_id as target_reference from el where parent_id is not null union all select element_id, 'contained_by', parent_id from el where parent_id is not null")
def containment_edges(spark, sf):
    return edges.containment_edges(_elements(spark, sf)).select("source_id", "relationship_type", "target_reference")


@query("with" + EL + """, k as (select doc_id, element_id, ord, lead(element_id) over (partition by doc_id, parent_id order by ord) as nx from el where parent_id is not null)
  select 'STRUCTURAL' as category, 'next_sibling' as relationship_type, count(*) as n from k where nx is not null union all select 'STRUCTURAL', 'previous_sibling', count(*) from k where nx is not null
  union all select 'UNKNOWN', 'contains_text', count(*) from k union all select 'STRUCTURAL', 'contained_by', count(*) from k""")
def edges_by_type(spark, sf):
    e = _elements(spark, sf)
    both = edges.union_detectors(edges.sibling_edges(e), edges.containment_edges(e))
    return both.groupBy(edges.category(F.col("relationship_type")).alias("category"), "relationship_type").agg(F.count("*").alias("n"))


@query("with" + EL + """, p as (select element_id, lead(element_id) over (partition by doc_id, parent_id order by ord) as nx from el where parent_id is not null)
  select p.element_id as source_id, s.element_type as source_element_type, p.nx as target_reference, t.content_preview as target_content_preview from p join el s on s.element_id = p.element_id join el t on t.element_id = p.nx""")
def outgoing_edges(spark, sf):
    e = _elements(spark, sf)
    return edges.outgoing(edges.sibling_edges(e).where("relationship_type = 'next_sibling'"), e).select("source_id", "source_element_type", "target_reference", "target_content_preview")


@query("""with m as (select doc_id, unnest(regexp_extract_all(text, '\\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,})\\b', 1)) as a from documents)
  select doc_id::varchar as doc_id, md5(doc_id || '|0|root') as source_id, 'link' as relationship_type, 'mailto:' || a as target_reference from m""")
def link_edges(spark, sf):
    d = _t(spark, sf, "documents")
    links = explode.text_links(d).where("link_type = 'email'").select(F.col("doc_id").cast("string").alias("doc_id"), text.element_id(F.col("doc_id"), F.lit(0), F.lit("root")).alias("source_id"), "link_text", "link_target")
    return edges.link_edges(links, _elements(spark, sf)).select("doc_id", "source_id", "relationship_type", "target_reference")


_PAIR = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double))))"


@query(f"""with p as (select a.vec_id // 10 as doc_id, a.vec_id as source_id, b.vec_id as target_reference, {_PAIR} as similarity from embeddings a join embeddings b on a.vec_id // 10 = b.vec_id // 10 and a.vec_id < b.vec_id),
  n as (select vec_id // 10 as doc_id, count(*) as n from embeddings group by 1), r as (select *, row_number() over (partition by doc_id order by similarity desc, source_id, target_reference) as k from p)
  select r.doc_id, source_id, target_reference, round(similarity, 6) as similarity from r join n using (doc_id) where k <= 5 * n and similarity >= 0.1""")
def semantic_edges(spark, sf):
    v = _vectors(spark, sf).select("doc_id", F.col("element_pk").alias("element_id"), F.col("element_pk").alias("ord"), "embedding")
    return _rounded(edges.semantic_edges(v, 0.1), "similarity")


@query(f"""with p as (select a.vec_id as source, b.vec_id as target, {_PAIR} as score from embeddings a join embeddings b on a.vec_id // 10 <> b.vec_id // 10),
  r as (select *, row_number() over (partition by source order by score desc, target) as k from p) select source, target, round(score, 6) as score from r where k <= 20 and score >= 0.05""")
def cross_document_neighbours(spark, sf):
    v = _vectors(spark, sf)
    return _rounded(search.knn_join(v, v, 20, group="doc_id", threshold=0.05), "score")


# --- search ------------------------------------------------------------------


@query("with" + SC + "select element_pk, round(score, 6) as score from sc where element_type in (1, 2, 3, 4) order by sc.score desc, element_pk limit 10")
def vector_topk(spark, sf):
    return _rounded(search.top_k(_vectors(spark, sf), _PROBE, 10, {"element_type": [1, 2, 3, 4]}), "score")


@query("with" + SC + "select element_pk, round(score, 6) as score from sc where element_type <> 5 and score >= 0.05 order by sc.score desc, element_pk limit 50")
def vector_topk_threshold(spark, sf):
    return _rounded(search.top_k(_vectors(spark, sf), _PROBE, 50, {"exclude_element_type": [5]}, min_score=0.05), "score")


@query("with" + SC + """, d as (select doc_id, max(len(string_split(text, ' the ')) - 1) as n from documents group by doc_id),
  t as (select element_pk, least(n, 10)::double as t from sc join d on sc.doc_id = d.doc_id where n > 0), v as (select element_pk, score as v from sc)
  select element_pk, round(s, 6) as score from (select coalesce(t.element_pk, v.element_pk) as element_pk, 0.3 * coalesce(t, 0) / 10 + 0.7 * coalesce(v, 0) as s from t full join v on t.element_pk = v.element_pk) order by s desc, element_pk limit 20""")
def hybrid_rank_whole(spark, sf):
    """All vectors, with text hits of the documents that hold a word."""
    s = _scored(spark, sf)
    n = _t(spark, sf, "documents").groupBy("doc_id").agg(F.max(F.size(F.split("text", " the ", -1)) - 1).alias("n")).where("n > 0")
    t = s.join(n, "doc_id").select("element_pk", F.least("n", F.lit(10)).cast("double").alias("score"))
    return _rounded(search.hybrid_rank(t, s, 20), "score")


@query("with" + SC + "select doc_id, arg_max(element_pk, round(score, 12)) as element_pk, round(max(score), 6) as score from sc group by doc_id")
def best_per_document(spark, sf):
    return _rounded(search.best_per_document(_scored(spark, sf)), "score")


@query("select distinct source from documents where doc_id in (select vec_id // 10 from embeddings)")
def document_sources(spark, sf):
    return search.document_sources(_scored(spark, sf), _t(spark, sf, "documents"))


# --- trees and context -------------------------------------------------------


@query("with" + EL + "select element_id, element_id as ancestor_id, 0 as distance from el where ord in (0, 2) union all select element_id, parent_id, 1 from el where ord = 2")
def ancestry(spark, sf):
    e = _elements(spark, sf)
    return trees.ancestry(e.where("ord in (0, 2)"), e)


@query("with" + EL + "select element_id, least(ord, 1) as depth, case when ord = 0 then doc_id || '/' || element_id else doc_id || '/' || parent_id || '/' || element_id end as path from el")
def tree_paths(spark, sf):
    return trees.paths(_elements(spark, sf))


@query("with" + EL + "select element_id, doc_id, element_type, case when ord = 2 then 1.5::double end as score from el where ord = 2 or ord = 0 and doc_id in (select doc_id from el where ord = 2)")
def outline(spark, sf):
    e = _elements(spark, sf)
    hits = e.where("ord = 2").select("doc_id", "element_id", F.lit(1.5).alias("score"))
    return trees.outline(hits, e).select("element_id", "doc_id", "element_type", "score")


@query("with" + EL + "select doc_id, parent_id, array_to_string(list(element_id order by ord), ',') as kids from el where parent_id is not null group by doc_id, parent_id")
def child_lists(spark, sf):
    return trees.children(_elements(spark, sf)).select("doc_id", "parent_id", F.array_join("child_ids", ",").alias("kids"))


@query("with" + EL + """, z as (select md5(doc_id || '|' || ord || '|' || element_type) as element_id, doc_id::varchar as doc_id, ord, content, regexp_split_to_array(trim(content, ' '), '\\s+') as ws from e where ord > 0),
  t as (select doc_id, element_id, ord, case when len(ws) > 500 then array_to_string(ws[1:500], ' ') else content end as p from z),
  c as (select doc_id, element_id, p, lag(p) over (partition by doc_id order by ord) as b, lead(p) over (partition by doc_id order by ord) as a from t)
  select doc_id, element_id, concat_ws(chr(10) || chr(10), p, b, a) as text from c""")
def element_context(spark, sf):
    return trees.context(explode.with_ids(_paragraphs(spark, sf), whole=True)).select("doc_id", "element_id", "text")


@query("""with l as (select c_custkey as s, c_custkey * 2 as t from customer union all select c_custkey, c_custkey + 7 from customer),
  d1 as (select distinct t as node from l where s = 1), d2 as (select distinct t as node from l where s in (select node from d1)), d3 as (select distinct t as node from l where s in (select node from d2))
  select node, min(depth)::int as depth from (select 1::bigint as node, 0 as depth union all select node, 1 from d1 union all select node, 2 from d2 union all select node, 3 from d3) group by node""")
def link_crawl(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("source"))
    links = c.select("source", (F.col("source") * 2).alias("target")).unionByName(c.select("source", (F.col("source") + 7).alias("target")))
    return trees.crawl(spark.range(1, 2).select(F.col("id").alias("node")), links, 3)


@query("""with l as (select c_custkey as s, c_custkey * 2 as t from customer union all select c_custkey, c_custkey + 7 from customer),
  d1 as (select distinct t as node from l where s = 1), d2 as (select distinct t as node from l where s in (select node from d1)), d3 as (select distinct t as node from l where s in (select node from d2))
  select node, min(depth)::int as depth from (select 1::bigint as node, 0 as depth union all select node, 1 from d1 union all select node, 2 from d2 union all select node, 3 from d3) group by node""")
def followed_links(spark, sf):
    """The same links followed by a stream whose state holds what was visited."""
    root, c = shared_folder(spark, "followed"), _t(spark, sf, "customer").select(F.col("c_custkey").alias("s"))
    links = c.select(F.col("s").cast("string").alias("source"), (F.col("s") * 2).cast("string").alias("target")).unionByName(c.select(F.col("s").cast("string").alias("source"), (F.col("s") + 7).cast("string").alias("target")))
    follow.add_seeds(spark.range(1, 2).select(F.col("id").alias("target")), root)
    got = follow.follow(spark, root, lambda new: links.join(new.withColumnRenamed("target", "source"), "source", "left_semi"), 3)
    return got.select(F.col("target").cast("long").alias("node"), "depth")


# --- store and stream --------------------------------------------------------


@query("""select case when doc_id % 2 = 0 then 'old' || doc_id else 'new' || doc_id end as doc_id, 's' || doc_id as source, case when doc_id % 3 <> 0 then 'h2' else 'h1' end as content_hash, case when doc_id % 2 = 0 then 1.0::double else 2.0::double end as created_at, case when doc_id % 3 <> 0 then 2.0::double else 1.0::double end as updated_at
  from documents where doc_id % 2 = 0 or doc_id % 3 <> 0""")
def document_upsert(spark, sf):
    d = _t(spark, sf, "documents")
    row = lambda p, h, t: (F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("doc_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source"), F.lit(h).alias("content_hash"), F.lit(t).alias("created_at"), F.lit(t).alias("updated_at"))
    return store.upsert_documents(d.where("doc_id % 2 = 0").select(*row("old", "h1", 1.0)), d.where("doc_id % 3 <> 0").select(*row("new", "h2", 2.0)))


@query("select doc_id::varchar as source_id, md5(text) as content_hash, (case when doc_id % 2 = 0 then 4 else 0 end + case when doc_id % 3 = 0 then 1 else 0 end)::int as processing_count from documents where doc_id % 2 = 0 or doc_id % 3 = 0")
def history_touch(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source_id"), F.md5("text").alias("content_hash"))
    return store.touch_history(d.where("doc_id % 2 = 0").withColumn("processing_count", F.lit(4)), d.where("doc_id % 3 = 0"))


@query("with" + EL + """, o as (select * from el where doc_id::bigint % 2 = 0), k as (select count(*) as top from o)
  select count(*) as n, count(distinct element_pk) as n_pk, min(element_pk) as lo, max(element_pk) as hi from (select row_number() over () as element_pk from el)""")
def element_replacement(spark, sf):
    from pyspark.sql import Window

    e = _elements(spark, sf).drop("metadata")
    # the old half is numbered by hand for this query: ids of even documents in order
    old = store.replace_elements(e.where("false").withColumn("element_pk", F.lit(0).cast("long")), e.where("doc_id % 2 = 0"))
    return store.replace_elements(old, e).agg(F.count("*").alias("n"), F.countDistinct("element_pk").alias("n_pk"), F.min("element_pk").alias("lo"), F.max("element_pk").alias("hi"))


@query("with" + EL + """, g as (select * from el where doc_id::bigint % 5 <> 0), p as (select element_id, doc_id, lead(element_id) over (partition by doc_id, parent_id order by ord) as nx from el where parent_id is not null)
  select 'elements' as relation, count(*) as n from g union all select 'relationships', 2 * count(*) from p where nx is not null and doc_id::bigint % 5 <> 0""")
def cascading_delete(spark, sf):
    e = _elements(spark, sf)
    keyed = e.withColumn("element_pk", F.xxhash64("element_id"))
    gone = _t(spark, sf, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    a, b, _ = store.delete_documents(gone, keyed, edges.sibling_edges(e), keyed.select("element_pk"))
    return a.agg(F.lit("elements").alias("relation"), F.count("*").alias("n")).unionByName(b.agg(F.lit("relationships").alias("relation"), F.count("*").alias("n")))


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n from events group by all")
def windowed_counts(spark, sf):
    return refresh.windowed_counts(_t(spark, sf, "events"))


@query("with" + EL + "select (select count(*) from documents) as documents, (select count(*) from el) as elements, (select count(*) * 2 from el where parent_id is not null) as relationships")
def ingest_statistics(spark, sf):
    e = _elements(spark, sf)
    d = _t(spark, sf, "documents").agg(F.count("*").alias("documents"))
    n = e.agg(F.count("*").alias("elements"), (F.count("parent_id") * 2).alias("relationships"))
    return d.join(F.broadcast(n), F.lit(True))  # two rows of one


# --- ingest of a mixed corpus, rendering, family context, values -------------


@query("""with t as (select 'text' as doc_type, doc_id::varchar as d, len(list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda a: trim(a, ' ')), lambda a: length(a) >= 1)) as n from documents),
  r as (select n_regionkey, count(*) as n from nation group by 1)
  select 'text' as doc_type, 'root' as element_type, count(*) as n from t union all select 'text', 'paragraph', sum(n) from t having sum(n) > 0
  union all select 'csv', 'root', count(*) from r union all select 'csv', 'table', count(*) from r union all select 'csv', 'table_header_row', count(*) from r union all select 'csv', 'table_row', sum(n) from r union all select 'csv', 'table_cell', 2 * sum(n) from r
  union all select 'json', 'root', count(*) from supplier union all select 'json', 'json_object', count(*) from supplier union all select 'json', 'json_field', 2 * count(*) from supplier
  union all select 'xml', 'root', count(*) from region union all select 'xml', 'xml_object', count(*) from region union all select 'xml', 'xml_element', 2 * count(*) from region union all select 'xml', 'xml_text', 2 * count(*) from region
  union all select 'markdown', 'root', count(*) from region union all select 'markdown', 'header', 2 * count(*) from region union all select 'markdown', 'list_item', 2 * count(*) from region""")
def mixed_ingest(spark, sf):
    """The engine over text, CSV, JSON, XML and Markdown at once; types that aren't stated are detected."""
    from folia.operators.staging import shared_folder
    from folia.plans.engine import Engine

    none, as_text = F.lit(None).cast("string"), lambda c: F.col(c).cast("string")
    doc = lambda df, name, key, kind, content, end="": df.select(F.concat(F.lit(name), as_text(key), F.lit(end)).alias("source_id"), kind.alias("doc_type"), content.alias("content"))
    region, nation = _t(spark, sf, "region"), _t(spark, sf, "nation")
    lines = F.array_join(F.array_sort(F.collect_list(F.concat(as_text("n_nationkey"), F.lit(","), "n_name"))), "\n")
    tables = nation.groupBy("n_regionkey").agg(F.concat(F.lit("key,name\n"), lines).alias("csv"))
    named = F.concat(F.lit("<region><key>"), as_text("r_regionkey"), F.lit("</key><name>"), "r_name", F.lit("</name></region>"))
    marked = F.concat(F.lit("# "), "r_name", F.lit("\n\n## Facts\n\n- key "), as_text("r_regionkey"), F.lit("\n- [more](x.md)\n"))
    docs = doc(_t(spark, sf, "documents"), "text:", "doc_id", F.lit("text"), F.col("text"))
    docs = docs.unionByName(doc(tables, "tables/t.csv?", "n_regionkey", F.lit("csv"), F.col("csv")))
    docs = docs.unionByName(doc(_t(spark, sf, "supplier"), "records/", "s_suppkey", none, F.to_json(F.struct("s_suppkey", "s_name")), ".json"))
    docs = docs.unionByName(doc(region, "xml:", "r_regionkey", F.lit("xml"), named)).unionByName(doc(region, "md:", "r_regionkey", none, marked))
    engine = Engine(spark, shared_folder(spark, "mixed-ingest"))
    engine.ingest(docs)
    return engine.table("elements").join(engine.table("documents").select("doc_id", "doc_type"), "doc_id").groupBy("doc_type", "element_type").agg(F.count("*").alias("n"))


@query("""select c_custkey, h, case when h = 'c_name' then h || ' is "' || v || '"' else h || ': ' || v end as text from (
  select c_custkey, unnest(['c_name', 'c_mktsegment']) as h, unnest([c_name, c_mktsegment]) as v from customer)""")
def rendered_cells(spark, sf):
    from folia.operators import render

    cells = F.array(*(F.struct(F.lit(c).alias("h"), F.col(c).alias("content")) for c in ("c_name", "c_mktsegment")))
    rows = _t(spark, sf, "customer").select("c_custkey", F.inline(cells)).select("c_custkey", "h", "content", F.lit("table_cell").alias("element_type"), F.to_json(F.struct(F.col("h").alias("header"))).alias("metadata"))
    return render.with_text(rows).select("c_custkey", "h", "text")


def _places(spark, sf):
    """Regions, nations and customers as trees of elements, a document per region."""
    none, nation = F.lit(None).cast("string"), _t(spark, sf, "nation")
    node = lambda df, doc, p, key, up, kind, name: df.select(F.col(doc).cast("string").alias("doc_id"), F.concat(F.lit(p), F.col(key).cast("string")).alias("element_id"), up.alias("parent_id"), F.lit(kind).alias("element_type"), F.col(key).cast("long").alias("ord"), F.col(name).alias("content"))
    out = node(_t(spark, sf, "region"), "r_regionkey", "r", "r_regionkey", none, "section", "r_name")
    out = out.unionByName(node(nation, "n_regionkey", "n", "n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "section", "n_name"))
    customers = _t(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.unionByName(node(customers, "n_regionkey", "c", "c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "paragraph", "c_name"))


@query("""with m as (select n_nationkey as n, any_value(n_regionkey) as r, count(c_custkey) as m from nation left join customer on c_nationkey = n_nationkey group by n_nationkey),
  t as (select n, r, m, sum(m + 1) over (partition by r order by n) - m as pre, row_number() over (partition by r order by n) as place from m)
  select 'r' || r_regionkey as element_id, 0::bigint as pre, coalesce((select sum(m + 1) from m where r = r_regionkey), 0)::bigint as last, 0 as depth, 1 as place from region
  union all select 'n' || n, pre::bigint, (pre + m)::bigint, 1, place::int from t
  union all select 'c' || c_custkey, (pre + i)::bigint, (pre + i)::bigint, 2, i::int from (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) as i from customer) c join t on c_nationkey = n""")
def interval_labels(spark, sf):
    return trees.labelled(_places(spark, sf)).drop("doc_id")


@query("""select 'c' || c_custkey as element_id, n_name || '/' || r_name as said from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  union all select 'n' || n_nationkey, r_name from nation join region on n_regionkey = r_regionkey""")
def context_ancestors(spark, sf):
    return trees.context_ancestors(_places(spark, sf), 2).select("element_id", F.array_join("texts", "/").alias("said"))


@query("""with k as (select 'n' || c_nationkey as element_id, c_name as s, row_number() over (partition by c_nationkey order by c_custkey) as i from customer union all select 'r' || n_regionkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) from nation)
  select element_id, string_agg(s, '/' order by i) as said from k where i <= 3 group by element_id""")
def context_children(spark, sf):
    return trees.context_children(_places(spark, sf), 3).select("element_id", F.array_join("texts", "/").alias("said"))


@query("""select page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/x/y.html?q=1' as up, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/a' as root, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) as file from pages""")
def url_parts(spark, sf):
    from folia.functions import values

    u = F.col("url")
    return _t(spark, sf, "pages").select("page_id", values.join_url(u, F.lit("../../../x/./z/../y.html?q=1#f")).alias("up"), values.join_url(u, F.lit("/a")).alias("root"), values.file_name(u).alias("file"))


@query("""select vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, """ + _PROBE_SQL + """), lambda z: (z[1]::double - z[2]) * (z[1]::double - z[2])))), 5) as distance from embeddings""")
def vector_distances(spark, sf):
    """Vectors packed as 32-bit floats, unpacked, and their distance from a probe."""
    from folia.functions import values
    from folia.functions.vectors import literal

    v = values.unpack_floats(values.pack_floats(F.col("embedding")))
    return _t(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(values.euclidean(F.col("v"), literal(_PROBE)), 5).alias("distance"))


@query("""select doc_id, case when doc_id % 4 = 0 then text when doc_id % 4 = 1 then 'Error: no content for db://c/t/k/' || doc_id || '/text' when doc_id % 4 = 2 then '- ' || lang else 'Error: no element e' || doc_id || ' in db://c/t/k/' || doc_id || '/text' end as text from documents""")
def pointer_lookup(spark, sf):
    """Whole roots, rendered elements, and words for what isn't there."""
    from folia.sources import resolve

    key, m = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    d = _t(spark, sf, "documents").select("doc_id", "text", "lang", F.concat(F.lit("db://c/t/k/"), key, F.lit("/text")).alias("source"), F.concat(F.lit("e"), key).alias("element_id"), F.when(m == 0, "root").otherwise("list_item").alias("element_type"))
    elements = d.where(m == 2).select("element_id", F.lit("list_item").alias("element_type"), F.col("lang").alias("content"), F.lit(None).cast("string").alias("metadata"))
    got = resolve.resolve(d.select("doc_id", "source", "element_id", "element_type"), d.where(m != 1).select("source", F.col("text").alias("content")), elements)
    return got.select("doc_id", "text")


@query("""with e as (select c_custkey as id, round(c_acctbal / 10000, 4) as c from customer) select id, c as confidence from e where c >= 0.5""")
def confident_edges(spark, sf):
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("link").alias("relationship_type"), F.col("c_custkey").cast("string").alias("relationship_id"), F.to_json(F.struct(F.round(F.col("c_acctbal") / 10000, 4).alias("confidence"))).alias("metadata"))
    return edges.by_confidence(edges.between(rows, ["link"], 0.5).drop("confidence", "similarity")).select("id", "confidence")


_ASKED = "the quality of light, the water"
BM = """
bw as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from documents),
bl as (select doc_id, len(w) as n from bw), bs as (select count(*) as texts, avg(n) as mean from bl),
bt as (select doc_id, t as term, count(*) as tf from (select doc_id, unnest(w) as t from bw) where t in ('the', 'quality', 'of', 'light', 'water') group by all),
bd as (select term, ln(1 + (texts - count(*) + 0.5) / (count(*) + 0.5)) as idf from bt, bs group by term, texts),
bm as (select bt.doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as score from bt join bd using (term) join bl using (doc_id), bs group by bt.doc_id)
"""


@query("with" + BM + "select doc_id, round(score, 6) as score from bm")
def bm25_scores(spark, sf):
    """Every document with one of the words, ranked through a stored inverted index."""
    return _rounded(_text_index(spark, sf).scores(_ASKED), "score").withColumnRenamed("id", "doc_id")


@query("with" + SC.rstrip() + "," + BM + """, v as (select element_pk, doc_id, score as v from sc)
  select element_pk, round(s, 6) as score from (select element_pk, 0.3 * coalesce(bm.score, 0) / 10 + 0.7 * v as s from v left join bm using (doc_id)) order by s desc, element_pk limit 20""")
def hybrid_bm25(spark, sf):
    """All vectors by their cosine and the BM25 score of their document."""
    t = _text_index(spark, sf).scores(_ASKED).withColumnRenamed("id", "doc_id")
    return _rounded(search.hybrid_rank(t, _scored(spark, sf), 20, on="doc_id"), "score")


def _text_index(spark, sf):
    return text_index.build(_t(spark, sf, "documents"), shared_folder(spark, "text-index"), "doc_id")


@query("""with c as (select c_custkey::varchar as key, c_name as name from customer)
  select key as cell, h as header from c, (select unnest(['customer', 'key']) as h) union all select name, h from c, (select unnest(['customer', 'name']) as h)""")
def header_cells(spark, sf):
    """The headers over each cell of HTML tables, one of them over two columns."""
    from folia.operators import geometry

    line = F.concat(F.lit("<tr><td>"), F.col("c_custkey").cast("string"), F.lit("<td>"), "c_name", F.lit("</tr>"))
    body = F.array_join(F.array_sort(F.collect_list(line)), "")
    docs = _t(spark, sf, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("<table><tr><th colspan=2>customer</tr><tr><th>key<th>name</tr>"), body, F.lit("</table>")).alias("html"))
    el = explode.with_ids(markup.explode_markup(docs, "html", "c_nationkey", "html"), whole=True)
    named = lambda key, name: el.select(F.col("element_id").alias(key), F.col("content").alias(name))
    return geometry.header_of_cell(el).join(named("element_id", "cell"), "element_id").join(named("header_id", "header"), "header_id").select("cell", "header")


@query()
def approximate_topk(spark, sf):
    """Top-k through a stored index; a test measures its recall against the exact search."""
    return _rounded(_vector_index(spark, sf).search(_PROBE, 10, probes=42), "score")


@query()
def approximate_neighbours(spark, sf):
    """The 20 nearest vectors of other documents for every vector, through a stored index.

    The given vectors are evenly spread in 64 dimensions, so two thirds of the
    lists are needed for a recall of 0.9; a test measures it against the exact join.
    """
    return _rounded(_vector_index(spark, sf).knn_join(_vectors(spark, sf), 20, probes=42, group="doc_id", threshold=0.05), "score")


def _vector_index(spark, sf):
    return vector_index.build(_vectors(spark, sf), shared_folder(spark, "vector-index"), lists=64)


# --- look-ups by path ------------------------------------------------------------


@query("""with i as (select l_orderkey, to_json({'items': list({'line': l_linenumber, 'qty': l_quantity::int, 'mode': l_returnflag} order by l_linenumber, l_quantity::int, l_returnflag)}) as j from lineitem group by l_orderkey),
  x as (select l_orderkey, j, json_extract(j, '$.items[*].mode')::varchar[] as modes, json_extract(j, '$.items[*].qty')::int[] as qty, json_extract(j, '$.items[*].line')::varchar[] as lines from i)
  select l_orderkey, json_extract_string(j, '$.items[0].mode') as first_mode, json_extract_string(j, '$.items[4].qty') as fifth, json_extract(j, '$.missing[0]')::varchar as nothing,
    array_to_string(list_transform(modes, lambda a: trim(a, '"')), ',') as modes, array_to_string(list_transform(modes[2:3], lambda a: trim(a, '"')), ',') as inner_modes,
    array_to_string(list_transform(list_filter(list_zip(qty, lines), lambda z: z[1] > 40), lambda z: z[2]), ',') as large from x""")
def json_paths(spark, sf):
    """Orders as nested records, and values in them by path."""
    from folia.functions import jsonpath

    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("qty"), F.col("l_returnflag").alias("mode"))
    orders = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("j"))
    one, many = (lambda p: jsonpath.text(jsonpath.find(F.col("j"), p))), (lambda p: F.array_join(F.transform(jsonpath.find_all(F.col("j"), p), jsonpath.text), ","))
    return orders.select(
        "l_orderkey", one("$.items[0].mode").alias("first_mode"), one("$.items[4].qty").alias("fifth"), one("$.missing[0]").alias("nothing"),
        many("$.items[*].mode").alias("modes"), many("$.items[1:3].mode").alias("inner_modes"), many("$.items[?(@.qty > 40)].line").alias("large"),
    )


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def dotted_fields(spark, sf):
    from folia.functions import jsonpath

    return _t(spark, sf, "events").select("event_id", jsonpath.text(jsonpath.dotted(F.col("props"), "k")).alias("k"))


@query("""with c as (select c_nationkey, c_custkey, c_name, c_mktsegment as seg, row_number() over (partition by c_nationkey order by c_custkey) as i from customer)
  select c_nationkey::varchar as doc_id, 'second' as asked, c_name as value from c where i = 2
  union all select c_nationkey::varchar, 'segments', c_name from c where seg = 'BUILDING'
  union all select c_nationkey::varchar, 'neighbours', c_custkey::varchar from c where i > 1 and seg = 'MACHINERY'""")
def xpath_values(spark, sf):
    """Nations as XML with their customers, and values in them by path and selector."""
    c = F.concat(F.lit("<customer id='"), F.col("c_custkey").cast("string"), F.lit("' seg='"), "c_mktsegment", F.lit("'><name>"), "c_name", F.lit("</name></customer>"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", c.alias("x")))), lambda x: x["x"])
    docs = _t(spark, sf, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("<nation>"), F.array_join(each, ""), F.lit("</nation>")).alias("content"))
    rows = selectors.nodes(docs, "xml", "c_nationkey")
    paths = {"second": "/nation/customer[2]/name/text()", "segments": "//customer[@seg='BUILDING']/name"}
    got = [selectors.select_xpath(rows, p).select("doc_id", F.lit(k).alias("asked"), "value") for k, p in paths.items()]
    after = selectors.select(rows, "nation > customer + customer[seg=MACHINERY]").select("doc_id", F.lit("neighbours").alias("asked"), F.col("attributes")["id"].alias("value"))
    return got[0].unionByName(got[1]).unionByName(after)


@query("""with n as (select c_nationkey, count(*) as n, sum(length(c_name) + length(c_mktsegment)) as chars, sum(len(regexp_split_to_array(c_name, '\\s+')) + len(regexp_split_to_array(c_mktsegment, '\\s+'))) as w from customer group by 1)
  select c_nationkey::varchar as doc_id, 2 + 5 * n as elements, 2 * n as texts, w::bigint as words, chars::bigint as characters, greatest(w // 250, 1)::int as pages, 3 as depth_of_paths, 'nation' as top from n""")
def document_statistics(spark, sf):
    """Nations as XML with their customers, and what their elements say of each."""
    c = F.concat(F.lit("<customer><name>"), "c_name", F.lit("</name><seg>"), "c_mktsegment", F.lit("</seg></customer>"))
    docs = _t(spark, sf, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("<nation>"), F.array_join(F.collect_list(c), ""), F.lit("</nation>")).alias("content"))
    got = statistics.document_statistics(markup.explode_markup(docs, "xml", "c_nationkey"))
    return got.select("doc_id", "elements", F.col("by_type")["xml_text"].alias("texts"), "words", "characters", "pages", "depth_of_paths", "top")


@query("""with n as (select c_nationkey::varchar as doc_id, count(*) as cells from customer group by 1)
  select doc_id, cells, c.* from n, (values (0, 'customer_key', 'integer', true, false), (1, 'day', 'date', false, true), (2, 'at', 'string', false, true), (3, 'balance', 'float', false, false)) c(col, header, inferred_type, is_identity, is_temporal)""")
def column_verdicts(spark, sf):
    """Nations as CSV with their customers, and what each column is."""
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("c_custkey", F.lit(300)).cast("int")).cast("string"), F.concat(F.pmod("c_custkey", F.lit(12)).cast("string"), F.lit("pm")), F.concat(F.col("c_custkey").cast("string"), F.lit(".5")))
    body = F.array_join(F.collect_list(line), "\n")
    docs = _t(spark, sf, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("customer_key,day,at,balance\n"), body).alias("content"))
    return statistics.column_statistics(statistics.cells(markup.explode_markup(docs, "csv", "c_nationkey")))


@query()
def page_addresses(spark, sf):
    """Every element of every page by its own selector: the text found there; a test holds that each finds its element alone."""
    rows = selectors.nodes(_t(spark, sf, "pages"), "html", "page_id", "html")
    return selectors.look_up(rows.select("doc_id", F.col("selector").alias("address")), rows)


# --- table structure ---------------------------------------------------------


@query("""with g as (select l_orderkey, l_linenumber, l_quantity, case when l_quantity - lag(l_quantity) over (partition by l_orderkey order by l_quantity, l_linenumber) > 5 then 1 else 0 end as f from lineitem)
  select l_orderkey, l_linenumber, (sum(f) over (partition by l_orderkey order by l_quantity, l_linenumber))::bigint as cluster from g""")
def gap_clusters(spark, sf):
    return geometry.clusters(_t(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", 5, ["l_linenumber"]).select("l_orderkey", "l_linenumber", "cluster")


@query("select p_partkey, chr((65 + p_size % 26)::int) || p_partkey as ref, p_size % 26 between 1 and 3 and p_partkey between 2 and 90 as inside from part")
def cells_in_range(spark, sf):
    ref = F.concat(F.chr((F.lit(65) + F.col("p_size") % 26).cast("long")), F.col("p_partkey").cast("string"))
    return _t(spark, sf, "part").select("p_partkey", ref.alias("ref"), geometry.in_range(ref, F.lit("B2:D90")).alias("inside"))


@query("select n_name, regexp_matches(lower('col_' || n_name), 'id|identifier|uuid|guid|key|name|title|label|person|author|publisher|company|organization|user|owner|creator|editor|manager|developer|provider|customer|country|city|state|province|location|address|region|type|category|class|genre|style|format|model|brand|version') as is_identity from nation")
def identity_names(spark, sf):
    return _t(spark, sf, "nation").select("n_name", geometry.is_identity(F.concat(F.lit("col_"), F.col("n_name"))).alias("is_identity"))


@query("""with c as (select o_custkey as parent, o_orderstatus as tag, count(*) as n from orders group by all), g as (select parent, count(*) as tags, max(n) as most, sum(n) as s from c group by parent)
  select parent, case when tags = 1 or most > 0.8 * s then 'array' when tags > 0.5 * s then 'object' else 'element' end as kind from g""")
def container_kinds(spark, sf):
    return geometry.container_kinds(_t(spark, sf, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderstatus").alias("tag")))
