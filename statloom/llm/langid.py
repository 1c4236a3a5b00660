"""Language identification by Bayesian evidence fusion.

Text likelihoods come from a naive Bayes model of hashed byte trigrams, learned from labelled documents. They are tempered,
since neighbouring trigrams repeat each other's evidence, and joined with the declared markup language, whose reliability is estimated
by grouped sums of text posteriors, and with priors that shrink host to address suffix to all pages. A page's
own share is taken out of its host's, suffix's and declaration's sums, so its text does not count twice.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import Scratch, hash_share, texts

BUCKETS = 1 << 14
#: Labelled documents that the text model learns from, on average at most: those of the least id hashes.
SAMPLE = 20_000
#: Exponent of a text's likelihood.
TEMPER = 0.1
#: Pages that a parent's prior counts as, and pseudo-counts of declarations.
HOST_PAGES, SUFFIX_PAGES, DECLARED_PAGES = 5.0, 20.0, 2.0
BROADCAST_ROWS = 100_000

_OPENS = re.compile(rb"<(?:!--|(script|style|nav|aside|footer)\b)?", re.I)
_CLOSES = {name: re.compile(rb"</" + name + rb"\s*>", re.I) for name in (b"script", b"style", b"nav", b"aside", b"footer")}
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
DECLARED = r"(?is)<html\b[^>]*?\slang\s*=\s*[\x22']?([A-Za-z]{2,3})"


def page_text(raw: bytes) -> bytes:
    """The text between tags, without scripts, styles, navigation and comments, entities resolved.

    A hidden element or comment that is not closed is a plain tag, and a tag that is not closed is text; what is missing once is not looked for again, so the time is linear.
    """
    kept, at, missing = [], 0, set()
    while (m := _OPENS.search(raw, at)) is not None:
        start, name = m.start(), (m.group(1) or b"").lower()
        end = -1
        if name and name not in missing:
            found = _CLOSES[name].search(raw, m.end())
            end = found.end() if found else -1
        elif m.group() == b"<!--" and b"--" not in missing:
            close = raw.find(b"-->", m.end())
            end = close + 3 if close >= 0 else -1
        if end < 0 and (name or m.group() == b"<!--"):
            missing.add(name or b"--")
        if end < 0:
            end = raw.find(b">", start) + 1 or -1
        if end < 0:
            break  # no tag is closed from here on
        kept.append(raw[at:start])
        at = end
    plain = b" ".join([*kept, raw[at:]])
    return entities.unescape(plain.decode("utf-8", "replace")).encode("utf-8", "replace") if b"&" in plain else plain


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, white space as one space."""
    b = np.frombuffer(b" " + b" ".join(text.decode("utf-8", "replace").lower().encode("utf-8", "replace").split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64) % BUCKETS


@dataclass
class TextModel:
    langs: list[str]
    log_p: np.ndarray  # language x bucket

    def log_likelihood(self, text: bytes) -> np.ndarray:
        return self.log_p[:, trigrams(text)].sum(axis=1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's trigram counts of each language; bucket -1 stands for a language whose texts have none."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(texts(b.column("text")), b.column("lang").to_pylist(), strict=True):
            own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        at = at if len(at) else np.array([-1])
        yield pa.record_batch({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at.astype(np.int32)), "count": pa.array(own[at])})


def train(docs: DataFrame, most: int = SAMPLE) -> TextModel:
    """``docs``: (doc_id, text, lang). Rows without a language teach nothing. Trigram counts are summed by task and then by language."""
    known = docs.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen = known.where(hash_share(most / max(1, known.count()), "doc_id")).select("text", "lang")
    rows = chosen.mapInArrow(_counted, "lang string, bucket int, count long").groupBy("lang", "bucket").agg(F.sum("count").alias("count")).collect()  # at most BUCKETS rows a language
    langs = sorted({r["lang"] for r in rows})
    counts = np.full((len(langs), BUCKETS), 0.5)
    for r in rows:
        if r["bucket"] >= 0:
            counts[langs.index(r["lang"]), r["bucket"]] += r["count"]
    return TextModel(langs, np.log(counts / counts.sum(axis=1, keepdims=True)) if len(langs) else counts)


def _scored(model: TextModel, temper: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = np.array([model.log_likelihood(page_text(raw)) for raw in texts(b.column("html"))]).reshape(b.num_rows, len(model.langs)) * temper
            p = np.exp(logs - logs.max(axis=1, keepdims=True, initial=-np.inf))
            p /= p.sum(axis=1, keepdims=True)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(model.langs), dtype=np.int32)), pa.array(x.ravel())) for x in (logs, p)]
            yield pa.record_batch([b.column("page_id"), b.column("host"), b.column("declared"), *lists], names=["page_id", "host", "declared", "logs", "shares"])

    return run


def _sums(rows: DataFrame, by: list[str], n: int, prefix: str) -> DataFrame:
    """Grouped sums of the text posteriors as an array, and the number of pages."""
    sums = rows.groupBy(*by).agg(*(F.sum(F.get("shares", F.lit(i))).alias(f"_{i}") for i in range(n)), F.count("*").alias(f"{prefix}_pages"))
    return sums.select(*by, F.array(*(f"_{i}" for i in range(n))).alias(f"{prefix}_sums"), f"{prefix}_pages")


def identify(spark: SparkSession, pages: DataFrame, model: TextModel, temper: float = TEMPER) -> DataFrame:
    """``pages``: (page_id long, url string, html string), other columns are ignored. Returns page_id, host, declared, text_lang, lang and posterior of the language.

    Null html: no text and no declaration, so the priors decide. Null or odd url: the host is null and shares the prior of all such pages. Null page_id and repeated rows: a row for each.
    No page: no row. Ties go to the first language by name; without a learned language, lang is null.
    """
    n = len(model.langs)
    if not n:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"))
    scratch = Scratch(spark, "lang", few=2)

    def found(column: str, pattern: str) -> Column:
        x = F.lower(F.regexp_extract(F.col(column).cast("string"), pattern, 1))
        return F.when(x != "", x)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), found("url", HOST).alias("host"), found("html", DECLARED).alias("declared"), F.col("html").cast("string").alias("html"))
    scored = scratch.save(rows.mapInArrow(_scored(model, temper), "page_id long, host string, declared string, logs array<double>, shares array<double>"))
    scored = scored.withColumn("suffix", F.substring_index("host", ".", -1))

    def joined(left: DataFrame, sums: DataFrame, key: str) -> DataFrame:
        small = sums.count() <= BROADCAST_ROWS
        right = sums.withColumnRenamed(key, "_key")
        return left.join(F.broadcast(right) if small else right, left[key].eqNullSafe(F.col("_key")), "left").drop("_key")

    hosts = scratch.save(_sums(scored, ["host"], n, "host"))
    own = hosts.withColumn("suffix", F.substring_index("host", ".", -1))
    adds = [F.sum(F.get("host_sums", F.lit(i))).alias(f"_{i}") for i in range(n)]
    suffixes = own.groupBy("suffix").agg(*adds, F.sum("host_pages").alias("suffix_pages")).select("suffix", F.array(*(f"_{i}" for i in range(n))).alias("suffix_sums"), "suffix_pages")
    total = hosts.agg(*adds).first()
    everything = [float(total[i] or 0.0) for i in range(n)]
    declared = _sums(scored, ["declared"], n, "declared")
    x = joined(joined(joined(scored, hosts, "host"), suffixes, "suffix"), declared, "declared")

    def at(name: str, i: int) -> Column:
        return F.get(name, F.lit(i))

    evidence = []
    for i in range(n):
        p = at("shares", i)
        top = (everything[i] + 1.0) / (sum(everything) + n)
        suffix = (F.greatest(at("suffix_sums", i) - p, F.lit(0.0)) + SUFFIX_PAGES * top) / (F.col("suffix_pages") - 1 + SUFFIX_PAGES)
        host = (F.greatest(at("host_sums", i) - p, F.lit(0.0)) + HOST_PAGES * suffix) / (F.col("host_pages") - 1 + HOST_PAGES)
        # of the pages of this language, how many declare this; a declaration of a known language starts with one more page of it
        match = F.when(F.col("declared") == model.langs[i], DECLARED_PAGES).otherwise(DECLARED_PAGES / 10)
        said = F.when(F.col("declared").isNull(), F.lit(0.0)).otherwise(F.log((F.greatest(at("declared_sums", i) - p, F.lit(0.0)) + match) / (everything[i] + 2 * DECLARED_PAGES)))
        evidence.append(at("logs", i) + F.log(host) + said)
    x = x.withColumn("fused", F.array(*evidence))
    best = F.array_max("fused")
    names = F.array(*(F.lit(v) for v in model.langs))
    weight = F.aggregate(F.transform("fused", lambda v: F.exp(v - best)), F.lit(0.0), lambda a, v: a + v)
    return x.select(
        "page_id", "host", "declared", F.get(names, (F.array_position("shares", F.array_max("shares")) - 1).cast("int")).alias("text_lang"),
        F.get(names, (F.array_position("fused", best) - 1).cast("int")).alias("lang"), F.round(1.0 / weight, 6).alias("posterior"),
    )
