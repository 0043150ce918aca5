"""The registered queries of this subpackage; ``QUERIES`` and ``ORACLES`` are read by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ingestkit.llm import (ann, cross_tokens, decontaminate, html_blocks, language, mixing, ngram_join, sharding, simhash, spelling, token_scan,
                           toxicity, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_ngram_join", ngram_join.JOIN_SQL)
def op1(spark, sf_dir):
    return ngram_join.join_digest(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_decontaminate", decontaminate.DECONTAMINATE_SQL)
def op3(spark, sf_dir):
    return decontaminate.decontaminate_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_language_id")
def op4(spark, sf_dir):
    return language.identify_digest(table(spark, sf_dir, "documents"))


@query("op5_html_text")
def op5(spark, sf_dir):
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@query("op6_sharding")
def op6(spark, sf_dir):
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


@query("op7_mixing", mixing.MIXING_SQL)
def op7(spark, sf_dir):
    return mixing.mixing_digest(table(spark, sf_dir, "documents"))


@query("op8_url_filter")
def op8(spark, sf_dir):
    return url_filter.judge_digest(table(spark, sf_dir, "pages"))


@query("op9_token_counts")
def op9(spark, sf_dir):
    return token_scan.token_counts(table(spark, sf_dir, "documents"))


@query("op10_ann")
def op10(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


@query("op11_token_alignment")
def op11(spark, sf_dir):
    return cross_tokens.align_digest(table(spark, sf_dir, "documents"))


@query("op12_spelling", spelling.VARIANTS_SQL)
def op12(spark, sf_dir):
    return spelling.variants_digest(table(spark, sf_dir, "documents"))


@query("op13_simhash")
def op13(spark, sf_dir):
    return simhash.join_digest(table(spark, sf_dir, "documents"))
