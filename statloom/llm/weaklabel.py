"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Documents are counted by vote pattern, and expectation-maximisation over the
pattern counts estimates how each labeller votes on good and on bad documents. The posteriors of a bounded sample train a logistic
scorer on hashed words and word shapes, which scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import CACHE_LONG, CACHE_WORDS, Scratch, hash_share, slices, texts
from statloom.llm.rules import feature, text_stats

BUCKETS = 1 << 15
#: Documents that the scorer learns from, on average at most: those of the least id hashes; fewer if their words are more than SAMPLE_WORDS.
SAMPLE, SAMPLE_WORDS = 12_000, 40_000_000


def labellers() -> dict[str, Column]:
    """Votes: 1 good, 0 bad, -1 none."""

    def vote(name: str, bad: Column, good: Column) -> tuple[str, Column]:
        return name, F.when(bad, 0).when(good, 1).otherwise(-1)

    words, length, symbols, lines, repeats = feature("n_words"), feature("word_length"), feature("symbols"), feature("dup_lines"), feature("repeats")
    shares = F.coalesce(F.try_divide("n_symbols", "word_chars"), F.lit(0.0))
    upper, marks, other, per_line = feature("upper"), feature("marks"), feature("other_marks"), feature("line_words")
    return dict([
        vote("size", words < 2, words >= 60), vote("word_length", (length < 2.5) | (length > 12), (length >= 4) & (length <= 6.5)), vote("symbols", symbols > 0.08, (symbols < 0.01) & (words >= 20)), vote("symbol_share", shares > 0.02, shares < 0.002), vote("many_symbols", symbols > 0.5, symbols == 0), vote("dup_lines", (lines > 0.4) & (words >= 60), (lines < 0.1) & (words >= 100)),
        vote("repeats", repeats > 0.45, (repeats < 0.05) & (words >= 20)), vote("most_repeats", (repeats > 0.6) & (words >= 30), repeats < 0.3), vote("upper", upper > 0.4, upper < 0.08), vote("marks", marks > 0.25, marks < 0.02), vote("punctuation", ((other == 0) & (words >= 30)) | (other > 1.5), (other >= 0.05) & (other <= 0.3)),
        vote("lines", per_line < 2, (per_line >= 6) & (per_line <= 150)),
    ])


@dataclass
class LabelModel:
    """share: of good documents; p[labeller, class, vote]: of the labeller's votes on documents of the class. No vote is no evidence."""

    share: float
    p: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = np.arange(votes.shape[1])
        logs = [np.log(s) + np.where(votes >= 0, np.log(self.p[at, c, np.maximum(votes, 0)]), 0.0).sum(axis=1) for c, s in ((0, 1 - self.share), (1, self.share))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    @property
    def accuracy(self) -> np.ndarray:
        """Of each labeller's votes, how many are right."""
        return (1 - self.share) * self.p[:, 0, 0] + self.share * self.p[:, 1, 1]


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 300) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and how often each occurs, from the shares of good votes. Half a document in each count keeps all chances above 0."""
    good, bad = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    q = (good + 0.5) / (good + 2.0 * bad + 1.0)  # a labeller that finds a fault counts twice at first
    model = LabelModel(0.5, np.full((votes.shape[1], 2, 2), 0.5))
    for _ in range(rounds):
        weight = np.stack([(1 - q) * counts, q * counts])
        p = np.stack([np.stack([[weight[c][votes[:, j] == v].sum() + 0.5 for v in (0, 1)] for c in (0, 1)]) for j in range(votes.shape[1])])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        model = LabelModel(float(share), p / p.sum(axis=2, keepdims=True))
        new = model.posterior(votes)
        if len(q) == 0 or np.abs(new - q).max() < 1e-9:
            break
        q = new
    return model


#: Letters of either case, digits and bytes beyond ASCII (mostly letters) as one byte each.
_SHAPE = bytes(65 if 65 <= i < 91 else 97 if 97 <= i < 123 or i > 127 else 48 if 48 <= i < 58 else i for i in range(256))
_RUN = re.compile(rb"(.)\1{2,}", re.S)


class _Buckets(dict):
    """Word -> buckets of the word and of its shape, packed. A shape has runs of one kind cut to two."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        shape = b"~" + _RUN.sub(rb"\1\1", word.translate(_SHAPE))
        value = (xxhash.xxh3_64_intdigest(word) % BUCKETS) << 32 | xxhash.xxh3_64_intdigest(shape) % BUCKETS
        if len(word) <= CACHE_LONG:
            self[word] = value
        return value


_buckets = _Buckets()


def hashed(words: list[bytes]) -> np.ndarray:
    """Two buckets for each word."""
    packed = np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))
    return np.concatenate([packed >> 32, packed & 0xFFFFFFFF])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, weight = [], []
        for t in texts(b.column("text")):
            bucket, count = np.unique(hashed(t.split()), return_counts=True)
            at.append(bucket.astype(np.int32).tobytes())
            weight.append((count / np.sqrt(max(1, (count.astype(float) ** 2).sum()))).astype(np.float32).tobytes())
        yield b.drop_columns(["text"]).append_column("at", pa.array(at, pa.binary())).append_column("weight", pa.array(weight, pa.binary()))


def logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 12, rate: float = 0.5, decay: float = 1e-6, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adagrad over blocks of 64 rows, for soft labels; the classes weigh the same."""
    rng = np.random.default_rng(seed)
    w, b, g, gb = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-6), 1e-6
    share = np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), 64):
            own = order[s : s + 64]
            sizes = np.array([len(rows[i][0]) for i in own])
            at, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
            row = np.repeat(np.arange(len(own)), sizes)
            z = np.bincount(row, w[at] * x, minlength=len(own)) + b
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            weight = np.where(y[own] >= 0.5, 0.5 / share, 0.5 / (1 - share))
            d = (p - y[own]) * weight
            step = np.bincount(at, d[row] * x, minlength=BUCKETS) / len(own) + decay * w
            g += step**2
            w -= rate * step / np.sqrt(g)
            db = d.mean()
            gb += db**2
            b -= rate * db / np.sqrt(gb)
    return w, b


def _score(w: np.ndarray, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            docs = texts(batch.column("text"))
            for part in slices([len(t) for t in docs], 2_000_000):
                for i in range(part.start, part.stop):
                    at = hashed(docs[i].split())
                    c = np.bincount(at, minlength=1)[at]  # for each word, how often its bucket occurs
                    out[i] = w[at].sum() / np.sqrt(max(1.0, float(c.sum()))) + b
            yield batch.drop_columns(["text"]).append_column("score", pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40)))))

    return run


def classify(spark: SparkSession, docs: DataFrame, most: int = SAMPLE, at_least: float = 0.5) -> DataFrame:
    """``docs``: (doc_id long, text string), other columns are ignored. Returns doc_id, pattern (the votes in order, a letter each: g, b or -), weak (the label model's chance of good), score (the scorer's) and kept.

    Kept: the mean of both chances reaches ``at_least``. Null or empty text: no words, which is judged like any text. Null doc_id and repeated rows: a row for each. Empty table: no row.
    Every document counts in the label model; the scorer learns from a sample of documents by id hash, each with its whole text.
    A text's statistics are computed once; its pattern finds the row again by the id and 128 bits of hash of the text, and rows equal in these have the same pattern.
    """
    scratch = Scratch(spark, "weak")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.select("*", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    key = ["id", "h1", "h2"]
    letters = F.concat(*(F.when(v == 1, "g").when(v == 0, "b").otherwise("-") for v in labellers().values()))
    judged = scratch.save(text_stats(keyed, False).select("doc_id", *key, letters.alias("pattern"), "n_words"))
    patterns = judged.groupBy("pattern").agg(F.count("*").alias("count"), F.sum("n_words").alias("words")).orderBy("pattern").collect()  # at most 3 to the number of labellers
    if not patterns:
        return judged.select("doc_id", "pattern", F.lit(0.0).alias("weak"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    table = np.array([["b-g".index(c) for c in r["pattern"]] for r in patterns])
    table = np.select([table == 0, table == 1], [0, -1], 1)
    counts = np.array([r["count"] for r in patterns], float)
    model = estimate(table, counts)
    weak = {r["pattern"]: float(p) for r, p in zip(patterns, model.posterior(table), strict=True)}
    chosen = rows.where(hash_share(min(most / counts.sum(), SAMPLE_WORDS / max(1, sum(r["words"] for r in patterns))), "doc_id", F.lit("weak")))
    found = text_stats(chosen).withColumn("pattern", letters).select("doc_id", "text", "pattern").mapInArrow(_features, "doc_id long, pattern string, at binary, weight binary").toArrow()
    sample = sorted(zip(*(found[c].to_pylist() for c in ("doc_id", "at", "weight", "pattern")), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    x = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for _, a, v, _ in sample]
    w, b = logistic(x, np.array([weak[r[3]] for r in sample]))
    chances = spark.createDataFrame([(k, v) for k, v in weak.items()], "pattern string, weak double")
    scores = keyed.mapInArrow(_score(w, b), "doc_id long, id long, h1 long, h2 long, score double")
    out = scores.join(judged.groupBy(key).agg(F.min("pattern").alias("pattern")), key).join(F.broadcast(chances), "pattern")
    return out.select("doc_id", "pattern", F.round("weak", 6).alias("weak"), F.round("score", 6).alias("score"), ((F.col("weak") + F.col("score")) / 2 >= at_least).alias("kept"))
