"""A corpus pipeline: quality rules, near duplicates, secret scans, source mixing and packing, each stage written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import chosenpath, mixing, packing, rules, secrets
from statloom.llm.common import Scratch, with_row_id
from statloom.llm.queries import table, tokenizer_file

#: Removed rows that are broadcast at most, as a long each.
BROADCAST_ROWS = 1_000_000


def free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the list learned from ``labels`` reject. Only labelled documents are read to learn."""
    labels = table(spark, sf_dir, "labels")
    known = labels.where("doc_id is not null and quality is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.SAMPLE)
    stats = rules.text_stats(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id", "left_semi"))
    found = rules.learn_list(stats.drop("text"), labels)
    # other names while the statistics stand beside them, so no column clashes
    names = {c: "text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)}
    judged = rules.text_stats(docs.select(*((F.col("text").cast("string") if c == "text" else F.col(f"`{c}`")).alias(n) for c, n in names.items())))
    return judged.where(~rules.base_failed() & found.verdict().isNull()).select(*(F.col(n).alias(c) for c, n in names.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group that shares four fifths of its five-word shingles."""
    key = free_name(docs, "rid")
    rows = with_row_id(docs, key)
    found = chosenpath.ChosenPath(spark, k=5, threshold=0.8).run(rows.select(F.col(key).alias("rid"), "doc_id", "text"), given=True)
    gone = Scratch(spark, "gone").save(found.where(~F.col("first")).select(F.col("rid").alias(key)))
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key, "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; no document goes."""
    forest = secrets.train(secrets.labelled(spark))
    key = free_name(docs, "rid")
    clean = secrets.redact(with_row_id(docs, key), forest, key, path=F.col("source"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(spark, docs, keep=docs.columns)
    return mixed.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and places. Under the default capacities only tokens bind; see the README."""
    return packing.pack(spark, docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Learned rules, a forest and a packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
