"""Approximate nearest neighbours by multi-index hashing.

A bounded sample fits the codes: principal axes turned by iterative quantisation, one sign bit for each, from several starts of the turning, since
more bits follow distances closer. A code is cut into
substrings, each with its own index from value to rows. If two codes differ in at most r bits, then by the pigeonhole principle some
substring t differs in at most r_t of them, where the r_t + 1 add up to r + 1; probing every substring value within
r_t of the query's therefore retrieves every code within r. Those codes' vectors are ranked by their exact distance.
Where a radius has more values to probe than the index holds, the held values are compared instead; both find the same rows.

The radius is fitted on the sample, which has fewer and so farther neighbours than all rows: it holds at least ``recall`` of the
sample's true neighbours. A query that finds fewer than k rows within it probes again with a growing radius, up to all bits, until it has k
or all candidates: rows far from dense groups, which set the radius, may have few codes near. Each task indexes blocks of its rows and answers a bounded share of the queries at a time;
the driver holds one such share (QUERIES vectors), and the rows are read once for each.

How much is retrieved and ranked depends on the vectors alone: grouped ones have a small radius and few probes; among nearly uniform ones the nearest differ from a
query in two fifths of the bits, and no cut into substrings of a size that can be probed leaves much out. ``shares`` tells both figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm.common import Scratch

#: Vectors that the codes and the radius are fitted on, at most: those of the least id hashes.
SAMPLE = 10_000
#: Bits of one turning, turnings, and bits of a substring.
BITS, TURNS, PART = 64, 4, 16
#: Rows of an index block and queries that a task holds at most, on average.
BLOCK, QUERIES = 16_384, 32_768
SEED = 4


def usable(vector: Column) -> Column:
    """Not null, not empty or zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Codes:
    centre: np.ndarray
    turn: np.ndarray  # columns of the rotated axes
    radius: int

    @property
    def parts(self) -> int:
        return self.turn.shape[1] // PART

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A number of PART bits for each substring."""
        return np.packbits((x - self.centre) @ self.turn > 0, axis=1).view(np.uint16)

    def radii(self) -> np.ndarray:
        """Probing radius of each substring; -1: not probed."""
        left = self.radius + 1 - self.parts
        return np.array([left // self.parts + (t < left % self.parts) for t in range(self.parts)])


def fit(x: np.ndarray, k: int = 10, recall: float = 0.985, rounds: int = 40, seed: int = SEED) -> Codes:
    """Iterative quantisation of the rows of ``x``, and the radius that holds ``recall`` of the k nearest neighbours of some of them."""
    rng = np.random.default_rng(seed)
    d = x.shape[1] if len(x) else 0
    centre = x.mean(axis=0) if len(x) else np.zeros(d)
    y = x - centre
    axes = np.linalg.svd(y.T @ y)[0] if d else np.zeros((0, 0))
    axes = np.hstack([axes, np.zeros((d, max(0, BITS - d)))])[:, :BITS]
    v, turns = y @ axes, []
    for _ in range(TURNS):
        turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(rounds if len(x) else 0):
            a, _, b = np.linalg.svd(v.T @ np.sign(v @ turn))
            turn = a @ b
        turns.append(axes @ turn)
    codes = Codes(centre, np.hstack(turns), 0)
    own = codes.encode(x) if len(x) else np.zeros((0, codes.parts), np.uint16)
    apart = [0]
    for i in rng.choice(len(x), min(400, len(x)), replace=False) if len(x) else []:
        near = ((x - x[i]) ** 2).sum(axis=1)
        near[i] = np.inf
        near = np.argpartition(near, min(k, len(x) - 1))[:k] if len(x) > 1 else np.zeros(0, int)
        apart += list(np.bitwise_count(own[near[near != i]] ^ own[i]).sum(axis=1))
    codes.radius = int(np.quantile(apart, recall, method="higher"))
    return codes


def probes() -> list[np.ndarray]:
    """By radius, the differences of so many bits at most."""
    bits = np.bitwise_count(np.arange(1 << PART, dtype=np.uint16))
    return [np.flatnonzero(bits <= r).astype(np.uint16) for r in range(PART + 1)]


class Index:
    """Substring indexes over a block's codes: for each substring the values that occur, and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = []
        for t in range(codes.shape[1]):
            order = np.argsort(codes[:, t], kind="stable")
            values, starts = np.unique(codes[order, t], return_index=True)
            self.parts.append((order, values, np.r_[starts, len(order)]))

    def retrieve(self, code: np.ndarray, radii: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
        """Rows of which some substring is within its radius."""
        hit = np.zeros(len(self.codes), bool)
        for t, r in enumerate(radii):
            if r >= 0:
                order, values, starts = self.parts[t]
                differ = near[min(int(r), PART)]
                if len(differ) < len(values):
                    asked = differ ^ code[t]
                    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
                    at = at[values[at] == asked]
                else:
                    at = np.flatnonzero(np.bitwise_count(values ^ code[t]) <= r)
                size = starts[at + 1] - starts[at]
                hit[order[np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int, radii: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
        """Every row whose code is within the radius."""
        rows = self.retrieve(code, radii, near)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def shares(codes: Codes, x: np.ndarray, queries: np.ndarray) -> tuple[float, float]:
    """Of the rows, how many the queries' probes retrieve and how many are ranked, on average."""
    index, near, radii, asked = Index(codes.encode(x)), probes(), codes.radii(), codes.encode(queries)
    got = [(len(index.retrieve(q, radii, near)), len(index.within(q, codes.radius, radii, near))) for q in asked]
    return tuple(float(v) / max(1, len(x)) for v in np.mean(got, axis=0))


def _search(codes: Codes, ids: np.ndarray, vectors: np.ndarray, k: int):
    width = vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, near = codes.encode(vectors), probes()
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)

        def block(own: np.ndarray, x: np.ndarray) -> None:
            index, radii = Index(codes.encode(x)), codes.radii()
            for q in range(len(ids)):
                rows = index.within(asked[q], codes.radius, radii, near)
                rows = rows[own[rows] != ids[q]]
                if not len(rows):
                    continue
                score, found = np.sqrt(((x[rows] - vectors[q]) ** 2).sum(axis=1)), own[rows]
                if best[q] is not None:
                    score, found = np.r_[best[q][0], score], np.r_[best[q][1], found]
                if len(score) > 4 * k:
                    keep = score <= np.partition(score, k - 1)[k - 1]
                    score, found = score[keep], found[keep]
                order = np.lexsort((found, score))[:k]
                best[q] = score[order], found[order]

        held, many = [], 0
        for b in batches:
            column = b.column("embedding")
            held.append((b.column("vec_id").to_numpy(), np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)))
            many += b.num_rows
            if many >= BLOCK:
                block(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, many = [], 0
        if many:
            block(*(np.concatenate(x) for x in zip(*held, strict=True)))
        rows = [(i, b) for i, b in zip(ids, best, strict=True) if b is not None]
        if rows:
            yield pa.record_batch({"query_id": pa.array(np.repeat([i for i, _ in rows], [len(b[0]) for _, b in rows])), "vec_id": pa.array(np.concatenate([b[1] for _, b in rows])), "score": pa.array(np.concatenate([b[0] for _, b in rows]))})

    return run


def sample(vectors: DataFrame, most: int) -> np.ndarray:
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
    return np.array([r["embedding"] for r in rows], float).reshape(len(rows), -1)


def nearest(spark: SparkSession, vectors: DataFrame, every: int = 100, k: int = 10, most: int = SAMPLE, recall: float = 0.985) -> DataFrame:
    """The k nearest of all other rows for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    ``vectors``: (vec_id long, embedding array of numbers), other columns are ignored. A null vec_id or an unusable vector takes no part, nor does one of
    another length than the commonest (the shorter of two as common). Ties go to the smaller vec_id. Repeated rows: each is a candidate, a repeated query is asked once, and
    no row of its id answers it. Each query gets k rows, or all candidates if there are fewer. Empty table: no row.
    """
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    lengths = fine.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = fine.where(F.size("embedding") == lengths["n"])
    codes = fit(sample(fine, most), k, recall)
    scratch = Scratch(spark, "nearest")
    total = fine.count()
    short = scratch.save(fine.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.count("*").alias("own")))
    bits, done = codes.parts * PART, None
    while (many := short.count()) > 0:
        best = scratch.save(_probe(fine, short, codes, k, max(1, -(-many // QUERIES))))
        if codes.radius >= bits:  # every row was ranked
            done = best if done is None else done.union(best)
            break
        have = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("have"))
        left = short.join(have, "vec_id", "left").where(F.coalesce("have", F.lit(0)) < F.least(F.lit(k), F.lit(total) - F.col("own"))).drop("have")
        short = scratch.save(left)
        best = best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        done = best if done is None else done.union(best)
        codes = replace(codes, radius=min(bits, max(2 * codes.radius, codes.radius + PART)))
    if done is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return done.select("query_id", "rank", "vec_id", "score")


def _probe(fine: DataFrame, queries: DataFrame, codes: Codes, k: int, shares: int) -> DataFrame:
    """The k nearest rows within the radius of each query, some queries at a time: query_id, vec_id, score, rank."""
    found = None
    for share in range(shares):
        asked = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(shares)) == share).orderBy("vec_id").collect()
        if not asked:
            continue
        ids, x = np.array([r["vec_id"] for r in asked]), np.array([r["embedding"] for r in asked], float)
        part = fine.mapInArrow(_search(codes, ids, x, k), "query_id long, vec_id long, score double")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
