"""The thin queries opN_<name>: each operator over its whole table with
production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.html_extract import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages")).drop("host", "n_boilerplate")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.ngram_lm import fit, held_out, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs.where(~held_out("doc_id")), order=3)).drop("perplexity")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")).drop("ids")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.warc import merge_index, read_archives, write_archives

    index = merge_index(write_archives(_table(spark, sf_dir, "pages")))
    return read_archives(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.quality_rules import fit, judge

    docs = _table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, _table(spark, sf_dir, "labels"))).drop("rule")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.line_crf import classify, fit

    docs = _table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from folia.llm.kd_shards import shard

    placed = shard(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.periodic_runs import find_runs

    return find_runs(_table(spark, sf_dir, "documents"), plant=True, with_text=False)


_ALL = (op1_html_extraction, op2_token_counts, op3_lm_scoring, op4_packing, op5_license_scan, op6_warc, op7_quality_rules, op8_decontamination, op9_quality_classifier, op10_near_dedup, op11_filter_audit, op12_sharding, op13_periodic_runs)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


OP6_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from q where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, q.payload_digest,
       case when f.first_id is null or f.first_id = page_id then 'response' else 'revisit' end as record_type,
       case when f.first_id <> page_id then f.first_id end as refers_to
from q left join f on q.payload_digest = f.payload_digest
"""


#: The five conditions row by row, then every order walked step by step: a row's
#: first failed filter in the order is the one that removes it.
OP11_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         coalesce(doc_id > min(doc_id) over (partition by coalesce(text, '')), false) as e
  from documents),
l as (select doc_id, max((quality = 1)::int) as q, max((toxic = 1)::int) as x from labels group by doc_id),
r as (
  select part, coalesce(q, 0) = 1 as good, coalesce(x, 0) = 1 as toxic,
         (case when len(w) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end)
         || (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end)
         || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end) || (case when e then 'E' else '' end) as fails
  from d left join l on d.doc_id = l.doc_id),
g as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from r group by part, fails),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, k::int as step, substr(filter_order, k::int, 1) as f, substr(filter_order, 1, k::int - 1) as before from o, range(1, 6) as x(k)),
c as (
  select part, filter_order, step, s.f,
         sum(n) filter (not contains(fails, s.f) and translate(fails, before, '') = fails) as kept,
         sum(n) filter (contains(fails, s.f) and translate(fails, before, '') = fails) as removed,
         sum(n) filter (contains(fails, s.f) and translate(fails, before, '') <> fails) as redundant,
         sum(n) filter (fails = s.f) as unique_fails,
         sum(good) filter (contains(fails, s.f) and translate(fails, before, '') = fails) as good_lost,
         sum(toxic) filter (contains(fails, s.f) and translate(fails, before, '') = fails) as toxic_lost
  from g, s group by part, filter_order, step, s.f)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
       coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       (sum(coalesce(removed, 0)) over (partition by part, f))::bigint as shapley
from c
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op11_filter_audit": OP11_SQL}
