"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontaminate, embedding_forest, language, licenses, line_dedup, mixing, multiset_hash, ngram_join, oracle, prefix_trie, sharding, spelling, suffix_dedup, token_output
from basketry.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def levels() -> dict:
    """The mixing tree: domains of five numbered sources each, then language, then source."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT)")
    return {"domain": F.concat(F.lit("domain"), F.floor(number / 5)), "lang": F.col("lang"), "source": F.col("source")}


WEIGHTS = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0, ("*", "en"): 4.0, ("*", "de"): 2.0, ("*", "fr"): 2.0, ("*", "es"): 2.0}


@register("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


@register("op2_license_scan", oracle.license_scan())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("matches").withColumn("score", F.round("score", 9))


@register("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.find_repeats(documents(spark, sf_dir)).drop("__row")


@register("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("spans")


@register("op5_rans_tokens")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_blocks(*token_output.write_blocks(documents(spark, sf_dir), tokenizer_path()))


@register("op6_mix_sources")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), levels(), WEIGHTS, share=0.5, max_epochs=4, seed=17)


@register("op9_ngram_join", oracle.NGRAM_JOIN)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), width=3, num=90, den=100).drop("__row")


@register("op10_language_mixture")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.label(docs).select(F.col("row.doc_id").alias("doc_id"), language.held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "languages")


@register("op7_embedding_forest", oracle.EMBEDDING_LINKS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.link(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"), threshold=0.9)


@register("op8_vector_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), n_shards=24)


@register("op11_prefix_trie", oracle.PREFIX_TRIE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")))


@register("op12_spelling_variants", oracle.SPELLING)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


@register("op13_multiset_hash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edited(documents(spark, sf_dir)).drop("state")
