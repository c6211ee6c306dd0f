"""The dealt operators over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import embedding_dups, exact_dedup, html_text, licenses, mixing, ngram_join, packing, quality, repair, warc
from .store import new_path, partitions, tables

#: Shares of the token budget by language, which is the domain that a document's text tells.
TARGETS = {"de": 0.2, "en": 0.5, "es": 0.1, "fr": 0.2}


def labelled_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(tables(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, tables(spark, sf_dir, "pages")).withColumnRenamed("record_id", "page_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.scored(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))
    return docs.filter("quality_keep").select("doc_id", F.round("quality_score", 6).alias("quality_score"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents are a first load, all others a second one, which must leave what the index has from the first."""
    docs = tables(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark, new_path(spark, "digest-index"), partitions(spark))
    first = F.coalesce(F.col("lang") == "en", F.lit(False))
    loads = [exact_dedup.exact_dedup(docs.filter(part), index, name) for name, part in (("first", first), ("second", ~first))]
    return loads[0].unionByName(loads[1]).withColumn("digest", F.sha2("text", 256))


def op4_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_shards(tables(spark, sf_dir, "documents"))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return mixing.mixed(docs, labelled_domains(spark, docs, sf_dir), TARGETS).select("doc_id", "mix_tokens", "mix_posterior", "mix_rate", "mix_copies")


def op6_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_copies(tables(spark, sf_dir, "embeddings"))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tables(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(tables(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html_text.extracted(F.col("html")).alias("found")).select("page_id", "url", "found.text", "found.score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(tables(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_quality_classifier, op3_exact_dedup, op4_repair_tokens, op5_soft_mixing, op6_embedding_near_dups, op7_best_two_fit, op8_ngram_jaccard_join, op9_html_text, op10_license_scan)}

_WORDS = r"regexp_extract_all(lower(text), '[\x{3040}-\x{9fff}]|[a-z0-9\x{80}-\x{9f}\x{a1}-\x{1fff}\x{2080}-\x{2fff}\x{a000}-\x{10ffff}]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
select page_id, url, sha256(html) digest, strlen(html) bytes, html
from (select *, row_number() over (partition by html order by page_id) r from pages where html is not null) where r = 1""",
    "op3_exact_dedup": """
select doc_id, text, lang, source, n_chars, sha256(text) digest
from (select *, row_number() over (partition by text order by lang is distinct from 'en', doc_id nulls last) r from documents) where r = 1 or text is null""",
    "op6_embedding_near_dups": """
with recursive u as (select vec_id i, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) v from embeddings
      where list_dot_product(embedding::double[], embedding::double[]) > 0),
p as (select a.i a, b.i b from u a join u b on a.i < b.i where list_dot_product(a.v, b.v) >= 0.95),
e as (select a, b from p union all select b, a from p),
reach as (select distinct a, a b from e union select r.a, e.b from reach r join e on r.b = e.a),
k as (select a, min(b) low from reach group by a),
l as (select a, count(*) n from e group by a)
select vec_id, coalesce(low, vec_id) class_id, coalesce(n, 0)::bigint links from embeddings left join k on k.a = vec_id left join l on l.a = vec_id""",
    "op8_ngram_jaccard_join": f"""
with recursive w as (select doc_id, {_WORDS} w from documents where doc_id is not null and text is not null),
s as (select doc_id, list_sort(list_distinct(case when len(w) < 3 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end)) g from w where len(w) > 0),
c as (select min(doc_id) rep, count(distinct doc_id) n, g, len(g) m from s group by g),
t as (select rep, n, m, unnest(g) x from c),
p as (select a.rep a, b.rep b, a.n na, b.n nb from t a join t b on a.x = b.x and a.rep < b.rep group by a.rep, b.rep, a.n, b.n, a.m, b.m having count(*) / (a.m + b.m - count(*)) >= 0.5),
e as (select a, b, nb from p union all select b, a, na from p),
reach as (select distinct a, a b from e union select r.a, e.b from reach r join e on r.b = e.a),
k as (select a, min(b) low from reach group by a),
l as (select a, sum(nb) more from e group by a),
r as (select s.doc_id, coalesce(low, rep) class_id, n - 1 + coalesce(more, 0) links from s join c using (g) left join k on k.a = rep left join l on l.a = rep
      union all select doc_id, doc_id, 0 from documents where doc_id is not null and doc_id not in (select doc_id from s))
select doc_id, min(class_id)::bigint class_id, sum(links)::bigint links from r group by doc_id""",
}
