"""Quality rules: text statistics, and a learned decision list over them.

Sequential covering learns the list from labelled statistics: a rule starts empty and adds the threshold condition of most
information gain until it covers no good document of the growing part; conditions are then cut from its end as long as that
does not worsen it on the held-out part. A rule that is not precise enough there ends the list. What a rule covers is
taken out before the next one is grown. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import Scratch, hash_words, mix, rolling, slices, texts

SYMBOLS = b"#*$%&|<>"
REPEAT = 5
#: Labelled documents that the list is learned from, at most: those of the least id hashes.
SAMPLE = 40_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_CLASSES = {
    "upper": [range(65, 91)], "digits": [range(48, 58)], "marks": [[33, 63]], "other_marks": [[ord(c) for c in ".,;:'\"()-"]],
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", *_CLASSES)


def repeated_words(words: np.ndarray, sizes: np.ndarray, width: int = REPEAT) -> np.ndarray:
    """For each document, its words in windows that occur twice or more in it."""
    ends = np.cumsum(sizes)
    h = rolling(words, width)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(np.arange(len(h)) + width <= ends[doc[: len(h)]])
    keys = mix(h[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + width, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(cover[:-1]) > 0)]
    return covered[ends] - covered[ends - sizes]


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = np.r_[0, np.cumsum(flags)]
    return c[ends] - c[starts]


def _stats(batches: Iterator[pa.RecordBatch], keep_text: bool = True) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs = texts(b.column("text"))
        b = b if keep_text else b.drop_columns(["text"])
        for part in slices([len(d) for d in docs], 2_000_000):
            own = docs[part]
            words = [d.split() for d in own]
            sizes = np.fromiter(map(len, words), np.int64, len(own))
            hashes = np.concatenate([hash_words(w) for w in words])
            del words
            raw = np.frombuffer(b"".join(own), np.uint8)
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            ends = np.cumsum(lengths)
            starts = ends - lengths
            lines = [[x for x in d.split(b"\n") if x.strip()] for d in own]
            out = {
                "n_words": sizes, "word_chars": _sums(_FIRST[raw] & ~_SPACE[raw], starts, ends), "n_symbols": _sums(_SYMBOL[raw], starts, ends),
                "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64), "n_repeat_words": repeated_words(hashes, sizes), "n_lines": np.array([len(x) for x in lines], np.int64),
            }
            for name, codes in _CLASSES.items():
                table = np.zeros(256, bool)
                table[[c for r in codes for c in r]] = True
                out[name] = _sums(table[raw], starts, ends)
            yield pa.record_batch([*(c[part.start : part.stop] for c in b.columns), *(pa.array(out[c].astype(np.int64)) for c in COUNTS)], names=[*b.schema.names, *COUNTS])


def text_stats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """The columns of ``docs``, text among them unless it isn't kept, and COUNTS of each whole text, as longs. Null text: all 0. Lines are split at newlines alone and count if they hold a word."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if keep_text or f.name != "text"] + [f"{c} long" for c in COUNTS])
    return docs.mapInArrow(_stats if keep_text else partial(_stats, keep_text=False), schema)


#: What conditions are about: shares of words, characters and lines.
FEATURES = {
    "n_words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "upper": ("upper", "word_chars"), "digits": ("digits", "word_chars"), "marks": ("marks", "n_words"), "other_marks": ("other_marks", "n_words"), "line_words": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.col(top).cast("double") if bottom is None else F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    bound: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.bound if self.above else x[self.name] <= self.bound

    def column(self) -> Column:
        return feature(self.name) > F.lit(self.bound) if self.above else feature(self.name) <= F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.bound:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a document that the first rule to hold rejects is bad, one that none holds for is good."""

    rules: tuple[Rule, ...]

    def verdict(self) -> Column:
        """The number of the first rule that holds, as an ordered conditional; null if none does."""
        if not self.rules:
            return F.lit(None).cast("int")
        out = None
        for i, r in enumerate(self.rules):
            test = r.conditions[0].column()
            for c in r.conditions[1:]:
                test = test & c.column()
            out = F.when(test, i) if out is None else out.when(test, i)
        return out

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r.conditions))} (precision {r.precision:.3f}, {r.covered})" for r in self.rules)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, bins: int = 64, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.95, least: int = 5) -> DecisionList:
    """Learn to tell the bad rows. The order of rows decides the held-out third. Without a bad row or a good one the list is empty."""
    n = len(bad)
    held = np.arange(n) % 3 == 2
    grid = {k: np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[:-1])) if n else np.zeros(0) for k, v in x.items()}
    alive = np.ones(n, bool)
    rules: list[Rule] = []
    while len(rules) < most_rules and (alive & bad & ~held).sum() >= least:
        own: list[Condition] = []
        inside = alive & ~held
        while len(own) < most_conditions:
            p0, t0 = int((inside & bad).sum()), int(inside.sum())
            if p0 == t0:
                break
            best, gain = None, 1e-9
            for k, bounds in grid.items():
                place = np.searchsorted(bounds, x[k][inside], side="left")  # of how many bounds the value is above
                for mask, sign in ((bad[inside], 1), (~bad[inside], 0)):
                    counts = np.bincount(place[mask], minlength=len(bounds) + 1)
                    if sign:
                        pos = np.cumsum(counts)
                    else:
                        neg = np.cumsum(counts)
                for above in (False, True):
                    p = (pos[-1] - pos[:-1]) if above else pos[:-1]
                    q = (neg[-1] - neg[:-1]) if above else neg[:-1]
                    g = np.where(p >= least, p * (np.log2(np.maximum(p, 1e-12) / np.maximum(p + q, 1)) - np.log2(p0 / t0)), -1.0)
                    i = int(np.argmax(g)) if len(g) else -1
                    if i >= 0 and g[i] > gain:
                        best, gain = Condition(k, above, float(bounds[i])), g[i]
            if best is None:
                break
            own.append(best)
            inside &= best.holds(x)
        test = alive & held

        def worth(conditions: list[Condition]) -> tuple[float, int, int]:
            hit = test & Rule(tuple(conditions), 0, 0).holds(x)
            p, t = int((hit & bad).sum()), int(hit.sum())
            return (2 * p - t) / t if t else -1.0, p, t

        while len(own) > 1 and worth(own[:-1])[0] >= worth(own)[0]:
            own.pop()
        value, p, t = worth(own) if own else (-1.0, 0, 0)
        if not own or t == 0 or p / t < precision:
            break
        rule = Rule(tuple(own), p / t, t)
        rules.append(rule)
        alive &= ~rule.holds(x)
    return DecisionList(tuple(rules))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learn_list(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Learn from ``labels``: (doc_id, quality 0 or 1), null rows left out, at most ``sample`` of them, chosen by hash. Documents that the base rules reject teach nothing."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = stats.where(~base_failed()).join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), *COUNTS).limit(sample).select(*(feature(k).alias(k) for k in FEATURES), (F.col("quality") == 0).alias("bad")).toPandas()
    return learn({k: rows[k].to_numpy(float) for k in FEATURES}, rows["bad"].to_numpy(bool))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, DecisionList]:
    """Statistics and verdict of each of ``docs``: doc_id, COUNTS, base_failed, rule (the number of the rule that rejects it, or null) and kept.

    Null or empty text: no words, so the base rules reject it. Null doc_id: judged, but takes no label. Repeated rows: each judged. Empty tables: no row,
    or a list without rules. Only doc_id, text and quality are read, whatever else there is.
    """
    scratch = Scratch(spark, "rules")
    stats = scratch.save(text_stats(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))).drop("text"))
    found = learn_list(stats, labels, sample)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", found.verdict())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), found
