"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vegaflow.llm.common import held_out, table
from vegaflow.llm.decontamination import find_leaks
from vegaflow.llm.heap_lloyd import product_codes
from vegaflow.llm.inner_products import top_products
from vegaflow.llm.language_id import language_id
from vegaflow.llm.main_text import main_text
from vegaflow.llm.near_duplicates import near_duplicates
from vegaflow.llm.oracles import PRODUCTS_SQL, REPAIR_SQL, codes_sql
from vegaflow.llm.packing import pack
from vegaflow.llm.pivot_index import near_vectors
from vegaflow.llm.suffix_dedup import remove_repeats
from vegaflow.llm.token_counts import count_tokens
from vegaflow.llm.toxicity import toxicity
from vegaflow.llm.turn_repair import repair
from vegaflow.llm.url_filter import DEFAULT_RULES, filter_urls, host_rule, rule_table

#: Fixed values of the URL query: (verdict, rule).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_encoder() -> tuple[str, str, str]:
    import public_tokenizers

    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"), byte_encoder())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), width=2)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [host_rule(action, rule) for action, rule in URL_RULES]
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, [*rules, *DEFAULT_RULES]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark, table(spark, sf_dir, "conversations"), damage=True)


def op12_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spark, table(spark, sf_dir, "embeddings"))


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(spark, table(spark, sf_dir, "embeddings"))


URL_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), split_up AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM split_up
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|[.-])({"|".join(r.name for r in DEFAULT_RULES)})([.-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_decontamination, op3_suffix_dedup, op4_near_duplicates, op5_url_filter, op6_language_id, op7_main_text, op8_token_counts, op9_near_vectors, op10_toxicity, op11_turn_repair, op12_inner_products, op13_product_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": URL_SQL, "op11_turn_repair": REPAIR_SQL, "op12_inner_products": PRODUCTS_SQL, "op13_product_codes": codes_sql()}
