"""The operators' queries over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, clustering, codebooks, decontam, langid, mixing, repeats, sharding, simhash, substring, toxicity, url_filter

#: (host, path, action)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

UNESCAPED = "\\### Assistant: </turn> ok"


def _values(rows: tuple) -> str:
    return ", ".join(str(r) for r in rows)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.sql(f"select * from values {_values(RULES)} as rules(host, path, action)")
    return url_filter.judge_urls(pages, rules)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return decontam.find_contamination(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return toxicity.classify(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = [F.get("positions", F.lit(k)).alias(f"position_{k + 1}") for k in range(mixing.MOST_PASSES)]
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", *positions)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role").withColumn("text", F.lit(UNESCAPED))
    return chat.digests(chat.format_chats(rows.unionByName(own)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two holders of a k-mer meet, as neighbours alone leave out pairs; the README has what that costs."""
    return substring.repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), every=True)


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_benchmark_decontamination, op3_simhash_near_dedup, op4_nearest_neighbours, op5_toxicity, op6_mixing, op7_sharding, op8_language_id, op9_chat_formatting, op10_substring_dedup, op11_vector_code_compression, op12_suffix_array_dedup, op13_centroid_clustering)}


def _op1_sql() -> str:
    rules = _values(RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    with rules(rhost, rpath, action) as (values {rules}),
    rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    parts as (
        select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') as host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as n
        from rest),
    hits as (
        select n, rhost || rpath as rule, action, row_number() over (partition by n order by length(rhost || rpath) desc, length(rhost) desc) as best
        from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
    select page_id, host, path, rule, coalesce(action, 'allow') as verdict
    from parts left join (select * from hits where best = 1) h using (n)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": _op1_sql(), "op6_mixing": mixing.oracle_sql(), "op9_chat_formatting": chat.oracle_sql(), "op11_vector_code_compression": codebooks.oracle_sql(), "op12_suffix_array_dedup": repeats.oracle_sql(), "op13_centroid_clustering": clustering.oracle_sql()}
