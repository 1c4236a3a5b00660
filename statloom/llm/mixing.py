"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. A source takes some whole passes over its documents, and those below a hash
threshold once more. The threshold is found without sorting documents: word counts are summed by source and the first 12
bits of the hash; where the running sum crosses the budget, only that bucket is summed by its next 12 bits, and so on. A larger
budget only raises the threshold, so mixes of one seed are nested. All of it is DataFrame operations; what windows sort are
at most 4096 sums of a source, and for the targets one row for each source, in one task: about 100 bytes each, so up to some tens of millions of sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm.common import WORD, Scratch

BITS, LEVELS = 12, 5
#: Sources that are broadcast at most.
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_hash(key: Column, seed: str) -> Column:
    """The first 60 bits of an MD5, as a long from 0."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes``: (source, source_size). Adds each source's target; the weights repeat over the sources by code point, null last.

    Sharing out by weight, stopping sources at ``most`` times their size and sharing the excess again ends where each target is the
    lesser of its limit and weight times one level. The sources in order of limit over weight are those that stop, up to some place.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (n % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * share)
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.least("limit", F.col("weight") * F.col("level")).alias("target"))


def thresholds(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs``: (source, hash, size); ``wanted``: (source, rest). Returns (source, upto): documents of a hash up to it come nearest to the rest.

    Documents of one hash go together. The one that crosses the budget is in if that comes nearer to it (or as near).
    """
    now = docs.where("size > 0")
    now = now.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, now["source"].eqNullSafe(wanted["source"])).select(now["source"], "hash", "size", "rest")
    for level in range(1, LEVELS + 1):
        bucket = F.shiftright("hash", BITS * (LEVELS - level))
        sums = now.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("sum"), F.first("rest").alias("rest"), (F.min("hash") < F.max("hash")).alias("many"))
        run = Window.partitionBy("source").orderBy("bucket")
        cross = sums.withColumn("to", F.sum("sum").over(run)).where("to > rest")
        first = cross.withColumn("n", F.row_number().over(run)).where("n = 1")
        edge = scratch.save(first.select("source", "bucket", (F.col("rest") - (F.col("to") - F.col("sum"))).alias("rest"), F.col("sum"), "many"))
        if level == LEVELS or edge.where("many").isEmpty():
            break
        e = edge.select(F.col("source").alias("own"), F.col("bucket").alias("at"), F.col("rest").alias("left"))
        e = F.broadcast(e) if e.count() <= BROADCAST_ROWS else e
        now = scratch.save(now.withColumn("bucket", bucket).join(e, F.col("source").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("at"))).select("source", "hash", "size", F.col("left").alias("rest")))
    last = now.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.max("hash").alias("hash"))
    e = edge.select(F.col("source").alias("own"), F.col("bucket").alias("at"), "rest", "sum")
    found = last.join(e, F.col("source").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("at")))
    return found.select("source", F.when(F.col("sum") <= 2 * F.col("rest"), F.col("hash")).otherwise(F.col("hash") - 1).alias("upto"))


def mix(
    spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Take ``share`` of all words, by source weights. Returns a row for each of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted), copies, and the columns to keep.

    Null or empty text: size 0, nothing is taken. Null source: a source of its own, after the others. Null id: hashed as such. Rows of one id in
    a source: all or none. An empty table: no row. A clashing column name does no harm, only the named columns are read. The same input gives the same mix.
    """
    scratch = Scratch(spark, "mix")
    own = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), place_hash(docs[id_col], seed).alias("hash"), word_count(docs[text_col]).alias("size"), *(F.struct(*(docs[c] for c in keep)).alias("row"),) if keep else ())
    sized = own if keep else scratch.save(own)
    light = sized.select("source", "hash", "size")
    if keep:
        light = scratch.save(light)
    goal = scratch.save(targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    passes = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0)))
    goal_rest = goal.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    upto = thresholds(light, goal_rest.select("source", "rest"), scratch)
    plan = goal_rest.join(upto.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")), "left").select(F.col("source").alias("own"), "source_size", "target", "passes", "upto")
    plan = scratch.save(plan)
    joined = sized.join(F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan, F.col("source").eqNullSafe(F.col("own")))
    copies = (F.col("passes") + F.when(F.col("hash") <= F.col("upto"), 1).otherwise(0)).cast("long")
    out = joined.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.least(copies, F.lit(1))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *(["row"] if keep else []))


def mix_sql(weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> str:
    """The same mix by sorting, for DuckDB."""
    choice = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {choice} END AS weight, source_size * {float(most)} AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () * {float(share)} - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
g AS (SELECT source, source_size, least(most, weight * (SELECT max(lev) FROM l)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM g),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
       sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN upto + upto - own <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""
