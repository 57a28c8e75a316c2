"""Binds the operators to the given tables: one query for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import ann, langid, maxscore, mixing, oracles, packing, pu_quality, rules, setsketch, substring, tokenfile, toxicity, variants, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=20)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digest(table(spark, sf_dir, "documents"), window=50)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.weak_quality(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_tokens(tokenfile.write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(maxscore.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language, op2_source_mix, op3_nearest, op4_substring, op5_near_duplicates, op6_weak_quality, op7_toxicity, op8_token_file, op9_packing, op10_quality, op11_ranked_search, op12_contamination, op13_spelling_variants)}
ORACLES: dict[str, str] = {"op4_substring": oracles.OP4, "op5_near_duplicates": oracles.OP5, "op11_ranked_search": oracles.OP11, "op12_contamination": oracles.OP12, "op13_spelling_variants": oracles.OP13}
