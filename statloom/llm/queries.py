"""The opN_ queries over the standard tables, their SQL, and the pipeline's registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.chosenpath import near_sql
from statloom.llm.mixing import mix_sql
from statloom.llm.substring import repeats_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the public tokenizers' files are; a parameter of the operators.
def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.langid import identify, train

    return identify(spark, table(spark, sf_dir, "pages"), train(table(spark, sf_dir, "documents")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.packing import pack

    return pack(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")).drop("rid")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.substring import remove_repeats

    return remove_repeats(spark, table(spark, sf_dir, "documents"))


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.mih import nearest

    return nearest(spark, table(spark, sf_dir, "embeddings"))


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.weaklabel import classify

    return classify(spark, table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.secrets import labelled, scan, train

    found = scan(table(spark, sf_dir, "documents"), train(labelled(spark)), ["doc_id"], path=F.col("source"))
    return found.where("secret").select("doc_id", "start", F.length("value").alias("length"), F.sha2(F.encode("value", "UTF-8"), 256).alias("value_sha256"), "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.rules import judge

    found, _ = judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.mixing import mix

    return mix(spark, table(spark, sf_dir, "documents")).drop("copies")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.viterbi import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statloom.llm.chosenpath import ChosenPath

    found = ChosenPath(spark, k=2, threshold=0.8).run(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_best_fit_packing, op3_substring_dedup, op4_multi_index_hashing, op5_weak_label_quality, op6_secret_scan, op7_quality_rules, op8_mix_sources, op9_token_counts, op10_minhash_near_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_substring_dedup": repeats_sql(), "op8_mix_sources": mix_sql(), "op10_minhash_near_dedup": near_sql()}
