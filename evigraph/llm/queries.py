"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The same rules, priors and bound as the operator's, for DuckDB.
OP9_SQL = r"""
with cut as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end as rest from pages
), parts as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from cut
), rules(h, p, says) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), ruled as (
  select *, case when host = '' then null
      when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
      when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
      when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'com/en/'
      when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'net/de/'
      when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'org/es/' end as rule,
    regexp_replace(host, ':[0-9]*$', '') as name
  from parts
), named as (
  select *, array_to_string(string_split(name, '.')[-2:], '.') as two, array_to_string(string_split(name, '.')[-3:], '.') as three, string_split(name, '.')[-1] as one from ruled
), levelled as (
  select *, two in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') as long_suffix from named
), placed as (
  select page_id, host, path, rule, case when long_suffix then three else two end as domain, case when long_suffix then two else one end as suffix from levelled
), hosts as (
  select host, domain, suffix, sum(1 - quality)::double as bad, count(*)::double as n from placed join labels on doc_id = page_id where quality in (0, 1) group by all
), domains as (select domain, suffix, sum(bad) as bad, sum(n) as n from hosts group by all
), suffixes as (select suffix, sum(bad) as bad, sum(n) as n from domains group by all
), whole as (select (sum(bad) + 1) / (sum(n) + 2) as mean from suffixes
), moments as (
  select 's' as lvl, avg(bad / n) as m, coalesce(var_samp(bad / n), 0) as v, avg(1 / n) as k from suffixes union all
  select 'd', avg(bad / n), coalesce(var_samp(bad / n), 0), avg(1 / n) from domains union all
  select 'h', avg(bad / n), coalesce(var_samp(bad / n), 0), avg(1 / n) from hosts
), strength as (
  select lvl, round(least(greatest(greatest(m * (1 - m), 1e-9) / (greatest(v - greatest(m * (1 - m), 1e-9) * k, 1e-9) / (1 - least(k, 0.999))) - 1, 1.0), 1000.0), 6) as s from moments
), s1 as (select suffix, (whole.mean * s + bad) / (s + n) as mean from suffixes, whole, strength where lvl = 's'
), d1 as (select domain, (s1.mean * s + bad) / (s + n) as mean from domains join s1 using (suffix), strength where lvl = 'd'
), h1 as (select host, d1.mean * s + bad as a, (1 - d1.mean) * s + n - bad as b from hosts join d1 using (domain), strength where lvl = 'h'
), blocked as (select host from h1 where a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5)
select page_id, host, path, rule,
  coalesce((select says from rules where h || p = rule), case when host in (select host from blocked) then 'block' else 'allow' end) as verdict
from placed
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigraph.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigraph.llm.site_tree import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigraph.llm.warc import archive_and_read

    return archive_and_read(_table(spark, sf_dir, "pages"))


def op7_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigraph.llm.ngram import train_and_score

    return train_and_score(_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigraph.llm.near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigraph.llm.decontam import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigraph.llm.media import documents_as_media

    return documents_as_media(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigraph.llm.quality import train_and_score

    return train_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigraph.llm.url_filter import judge

    # the labelled outcomes of pages: rows of labels by id, bad where the quality is 0
    outcomes = _table(spark, sf_dir, "labels").selectExpr("doc_id as page_id", "1 - quality as bad")
    return judge(_table(spark, sf_dir, "pages"), outcomes)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evigraph.llm.pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_media": op3_media,
    "op4_quality": op4_quality,
    "op5_main_text": op5_main_text,
    "op6_warc": op6_warc,
    "op7_ngram_scores": op7_ngram_scores,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_url_filter": op9_url_filter,
    "op10_pii": op10_pii,
}
ORACLE_SQL: dict[str, str] = {"op9_url_filter": OP9_SQL}
