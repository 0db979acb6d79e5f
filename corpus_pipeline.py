"""Corpus pipeline: each stage applies one operator of basketry.llm to what its predecessor kept.

Language ID drops documents without a letter, which no language fits, and fills in missing language labels; the n-gram join
keeps the first document of each group of near duplicates; decontamination drops documents that hold a
benchmark item; mixing draws documents to the target weights (a document may be drawn in several epochs);
the last stage tokenises, codes and reads back what was drawn. Each stage takes (spark, docs, sf_dir).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontaminate, language, mixing, ngram_join, token_output
from basketry.llm.queries import WEIGHTS, levels, tokenizer_path
from basketry.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null, or without a letter), and fills a null lang with the predicted one; mixed texts stay.

    An empty table gives an empty result; repeated rows and null ids are ordinary rows.
    """
    told = language.label(docs).where(F.col("lang_pred") != language.UNDETERMINED)
    filled = F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias("lang")
    return told.select(*[filled if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document (least id) of each group linked by five-word shingles at similarity 0.8.

    Null, empty and blank texts link with nothing and stay; an empty table gives an empty result.
    """
    return ngram_join.keep_first(docs, width=5, num=80, den=100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts stay, and all of them where the benchmark is empty."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents to the target weights, one row per epoch drawn.

    Null languages and sources count as "unknown"; an empty table gives an empty result.
    """
    return mixing.mix(docs, levels(), WEIGHTS, share=0.5, max_epochs=4, seed=17, with_row=True).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the drawn documents as coded ids and returns what reading them back tells of each.

    Null texts count as empty (the end id alone); rows of one doc_id keep the order of their texts' hashes; an empty table gives
    an empty result.
    """
    return token_output.read_blocks(*token_output.write_blocks(docs, tokenizer_path()))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("token_output", write_tokens),
]
#: Language models, hashing by Spark and the tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
