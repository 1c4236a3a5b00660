"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted over the corpus.

Each task hashes every window of its documents, with two bases, to 96 bits. Of windows that it sees twice, only the first goes on and the others are
known to be repeats, so a window that a third of all documents share reaches its partition once from each task. The
hashes go to the partition of their range as arrays, with their places as differences. A partition finds the first place of each hash;
the places of all others return by document, where overlapping windows merge into maximal intervals.

Spark deals, shuffles and recovers the counting; a range counts by sorting an array, since an aggregate with a row for each window (a hash, a check and a place:
some 40 bytes before compression) would shuffle more than an array, which takes about 14 bytes a window. Different windows of one hash are expected 0.002 times in 100 TB (2e13 windows): 2e13**2 / 2**97.
Where ranges are many, arrays go to groups of ranges first and from there, rejoined, to the ranges, so that a share's arrays don't get short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import SECOND_BASE, Scratch, hash_words, mix, rolling, slices, texts

WINDOW = 20
#: Characters of text that a task hashes together.
SHARE = 4_000_000
#: Entries that a partition sorts, on average.
RANGE = 1_500_000
#: Ranges that arrays go to directly; more are reached by groups of ranges.
DIRECT = 2048
#: Entries of a group of ranges that are dealt to its ranges together.
REGROUPED = 4_000_000
#: Shares of the documents whose intervals a task writes, one after another: a file for each would be small, and each costs processes on a local disk.
SHARES_A_FILE = 8
#: Known repeats of an array.
KNOWN = 50_000
#: Bytes of intervals that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: A null doc_id sorts after every other.
NO_ID = (1 << 63) - 1

_BLOB = "target int, kind byte, first long, ids binary, tags binary, counts binary, places binary, hashes binary, checks binary"


def _tag(text: bytes) -> int:
    """Tells rows of one doc_id with different texts apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _packed(values: np.ndarray, small: type, large: type) -> bytes:
    """The values after a byte that tells their type; the small one if it holds them."""
    fits = not len(values) or (values.min() >= 0 and values.max() <= np.iinfo(small).max)
    return (b"\0" + values.astype(small).tobytes()) if fits else (b"\1" + values.astype(large).tobytes())


def _unpacked(raw: bytes, small: type, large: type) -> np.ndarray:
    return np.frombuffer(raw, large if raw[0] else small, offset=1).astype(np.int64)


def _blob(target: int, kind: int, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, tags: np.ndarray, hashes: np.ndarray | None = None, checks: np.ndarray | None = None) -> dict:
    """Entries in order of (doc, place): each document once, its places as differences."""
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    step = np.diff(place, prepend=0)
    step[new] = place[new]
    own, own_tags = ids[doc[new]], tags[doc[new]]
    return {
        "target": target, "kind": kind, "first": int(own[0]), "ids": _packed(np.diff(own), np.uint32, np.int64), "tags": own_tags.tobytes() if own_tags.any() else b"",
        "counts": _packed(np.diff(np.r_[new, len(doc)]), np.uint8, np.uint32), "places": _packed(step, np.uint16, np.uint32), "hashes": b"" if hashes is None else hashes.tobytes(), "checks": b"" if checks is None else checks.tobytes(),
    }


def _entries(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and tags of the blob's documents, and each entry's document and place."""
    ids = np.cumsum(np.r_[np.int64(r["first"]), _unpacked(r["ids"], np.uint32, np.int64)])
    tags = np.frombuffer(r["tags"], np.int64) if r["tags"] else np.zeros(len(ids), np.int64)
    counts, step = _unpacked(r["counts"], np.uint8, np.uint32), _unpacked(r["places"], np.uint16, np.uint32)
    sums = np.cumsum(step)
    first = np.cumsum(counts) - counts
    return ids, tags, np.repeat(np.arange(len(ids)), counts), sums - np.repeat(sums[first] - step[first], counts)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    types = {"target": pa.int32(), "kind": pa.int8(), "first": pa.int64(), "ids": pa.binary(), "tags": pa.binary(), "counts": pa.binary(), "places": pa.binary(), "hashes": pa.binary(), "checks": pa.binary()}
    return pa.record_batch({k: pa.array([r[k] for r in rows], t) for k, t in types.items()})


def _joined(blobs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and tags of all documents, and of all entries document, place, hash and check."""
    parts = [_entries(r) for r in blobs]
    base = np.cumsum([0] + [len(p[0]) for p in parts])
    ids, tags = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    doc = np.concatenate([p[2] + o for p, o in zip(parts, base, strict=False)])
    place = np.concatenate([p[3] for p in parts])
    return ids, tags, doc, place, np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in blobs]), np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in blobs])


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _anywhere(first_id: int, place: int, targets: int) -> int:
    """Known repeats only pass through, so any target does; every array gets its own."""
    return int(mix(mix(np.array([first_id]).view(np.uint64)) + np.uint64(place))[0] % np.uint64(targets))


def _regrouped(ranges: int):
    """Blobs of a group of ranges to blobs of its ranges."""

    def dealt(blobs: list[dict]) -> pa.RecordBatch:
        ids, tags, doc, place, h, check = _joined(blobs)
        target = _range(h, ranges)
        order = np.argsort(target, kind="stable")  # of (doc, place) within a range
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(target[order]) > 0]), len(order)]
        return _rows([_blob(int(target[order[s]]), 0, doc[at], place[at], ids, tags, h[at], check[at]) for s, e in zip(cuts[:-1], cuts[1:], strict=True) for at in (order[s:e],)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"]:
                    yield _rows([r | {"target": _anywhere(r["first"], len(r["places"]), ranges)}])
                    continue
                held.append(r)
                many += len(r["hashes"]) // 8
                if many >= REGROUPED:
                    yield dealt(held)
                    held, many = [], 0
        if held:
            yield dealt(held)

    return run


def _windows(width: int, ranges: int, group: int, tagged: bool):
    """Batches of (doc_id, text) to blobs: kind 0, the first of each hash for its group of ranges; kind 1, known repeats."""
    groups = -(-ranges // group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = texts(b.column("text"))
            all_ids = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for part in slices([len(d) for d in docs], SHARE):
                own = docs[part]
                ids = all_ids[part]
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                own = [own[i] for i in order]
                tags = np.fromiter(map(_tag, own), np.int64, len(own)) if tagged else np.zeros(len(own), np.int64)
                words = [d.split() for d in own]
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                joined = np.concatenate([hash_words(w) for w in words]) if len(words) else np.zeros(0, np.uint64)
                del words
                h, check = rolling(joined, width), (rolling(joined, width, SECOND_BASE) >> np.uint64(32)).astype(np.uint32)
                doc = np.repeat(np.arange(len(sizes)), sizes)[: len(h)]
                ends = np.cumsum(sizes)
                inside = np.flatnonzero(np.arange(len(h)) + width <= ends[doc]) if len(h) else np.zeros(0, np.int64)
                if not len(inside):
                    continue
                h, check, doc = h[inside], check[inside], doc[inside]
                place = inside - (ends - sizes)[doc]
                by = np.argsort(h, kind="stable")  # stable: the first place of each hash comes first
                sorted_h = h[by]
                first = np.r_[True, (sorted_h[1:] != sorted_h[:-1]) | (check[by[1:]] != check[by[:-1]])]
                if not first.all():
                    # places that tie with the first (rows of one doc_id) are no repeats of it
                    lead = by[np.flatnonzero(first)][np.cumsum(first) - 1]
                    later = ~first & ((ids[doc[by]] != ids[doc[lead]]) | (place[by] > place[lead]))
                    if later.any():
                        every = np.sort(by[later])
                        for at in np.array_split(every, -(-len(every) // KNOWN)):  # each to a target of its own
                            yield _rows([_blob(_anywhere(int(ids[doc[at[0]]]), int(place[at[0]]), groups), 1, doc[at], place[at], ids, tags)])
                    first |= ~later
                keep, kept_h = by[first], sorted_h[first]
                target = _range(kept_h, ranges) // np.uint64(group)
                cuts = np.searchsorted(target, np.arange(groups + 1, dtype=np.uint64))
                out = []
                for k in range(groups):
                    if cuts[k] < cuts[k + 1]:
                        at = np.sort(keep[cuts[k] : cuts[k + 1]])
                        out.append(_blob(k, 0, doc[at], place[at], ids, tags, h[at], check[at]))
                yield _rows(out)

    return run


def _repeats(shares: int):
    """Blobs of one range at a time (sorted by target) to blobs of repeated places by share of the documents."""

    def dealt(ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch | None:
        if not len(doc):
            return None
        share = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shares)
        of = share[doc]
        order = np.lexsort((place, doc, ids[doc], of))
        doc, place, of = doc[order], place[order], of[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
        return _rows([_blob(int(of[s]), 1, doc[s:e], place[s:e], ids, tags) for s, e in zip(cuts[:-1], cuts[1:], strict=True)])

    def judged(blobs: list[dict]) -> pa.RecordBatch | None:
        ids, tags, doc, place, h, check = _joined(blobs)
        blobs.clear()
        order = np.argsort(h, kind="stable")
        h = h[order]
        many = np.r_[False, h[1:] == h[:-1]]
        many[:-1] |= many[1:]
        order, h = order[many], h[many]
        if not len(h):
            return None
        doc, place, check = doc[order], place[order], check[order]
        differ = (h[1:] == h[:-1]) & (check[1:] != check[:-1])
        if differ.any():  # different windows of one hash
            by = np.lexsort((check, h))
            doc, place, check, h = doc[by], place[by], check[by], h[by]
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)[doc]  # equal for rows of one doc_id
        starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
        size = np.diff(np.r_[starts, len(h)])
        key = (rank << 32) | place
        later = key > np.repeat(np.minimum.reduceat(key, starts), size)
        return dealt(ids, tags, doc[later], place[later])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"]:
                    if (out := dealt(*_entries(r))) is not None:
                        yield out
                    continue
                if held and r["target"] != now:
                    if (out := judged(held)) is not None:
                        yield out
                    held = []
                now = r["target"]
                held.append(r)
        if held and (out := judged(held)) is not None:
            yield out

    return run


def _merged(width: int):
    """Blobs of one share of the documents to a row for each document: the ends of its maximal intervals of covered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            parts = [_entries(r) for r in held]
            base = np.cumsum([0] + [len(p[0]) for p in parts])
            ids, tags = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            doc = np.concatenate([p[2] + o for p, o in zip(parts, base, strict=False)])
            place = np.concatenate([p[3] for p in parts])
            order = np.lexsort((place, tags[doc], ids[doc]))
            i, t, place = ids[doc][order], tags[doc][order], place[order]
            new_doc = np.r_[True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])]
            new = new_doc | np.r_[True, place[1:] > place[:-1] + width]
            at = np.flatnonzero(new)
            begin, end = place[at], place[np.r_[at[1:] - 1, len(place) - 1]] + width
            own = np.flatnonzero(new_doc[at])
            offsets = pa.array(np.r_[own, len(at)].astype(np.int32))
            return pa.record_batch({
                "id": pa.array(i[at[own]]), "tag": pa.array(t[at[own]]), "begins": pa.ListArray.from_arrays(offsets, pa.array(begin)), "ends": pa.ListArray.from_arrays(offsets, pa.array(end)),
            })

        for batch in batches:
            for r in batch.to_pylist():
                if held and r["target"] != now:
                    yield flush()
                    held.clear()
                now = r["target"]
                held.append(r)
        if held:
            yield flush()

    return run


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("tag", pa.array([_tag(t) for t in texts(b.column("text"))], pa.int64()))


def _repeated_ids(rows: DataFrame) -> bool:
    """Whether some rows share a doc_id; only then their texts have to tell them apart."""
    return bool(rows.groupBy("doc_id").count().where("count > 1").limit(1).count())


def _removed(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, gone, shas, kept_texts = [], [], [], []
            for text, begins, ends in zip(texts(b.column("text")), b.column("begins").to_pylist(), b.column("ends").to_pylist(), strict=True):
                words = text.split()
                counts.append(len(words))
                if begins:
                    kept, at = [], 0
                    for s, e in zip(begins, ends, strict=True):
                        kept += words[at:s]
                        at = e
                    words = kept + words[at:]
                gone.append(counts[-1] - len(words))
                joined = b" ".join(words)
                shas.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    kept_texts.append(joined.decode("utf-8", "replace"))
            out = {"doc_id": b.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
            if keep_text:
                out |= {"begins": b.column("begins"), "ends": b.column("ends"), "kept_text": pa.array(kept_texts, pa.string())}
            yield pa.record_batch(out)

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = WINDOW, keep_text: bool = False, entries: int = RANGE, direct: int = DIRECT) -> DataFrame:
    """Remove every word that a ``width``-word window covers whose words also start earlier: in a smaller doc_id, or before in the same document.

    ``docs``: (doc_id long, text string); other columns are ignored. Returns doc_id, n_words, n_removed, kept_sha256, and on request the
    removed intervals (word numbers, ends exclusive) and the kept text. Null or empty text: no words. Null doc_id: sorts last; all
    such rows count as one document. Rows of one doc_id: equal places tie, and a tie is no earlier start, so an identical row gets the same result.
    Empty table: no row. Texts are read whole. Windows are told apart by 96-bit hashes. ``entries``: of a range; ``direct``: ranges that are reached in one shuffle.
    """
    scratch = Scratch(spark, "windows")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(1, round(letters / 6 / entries))
    several = _repeated_ids(rows)
    group = 1 if ranges <= direct else round(ranges**0.5)
    hashed = rows.mapInArrow(_windows(width, ranges, group, several), _BLOB)
    if group > 1:
        hashed = hashed.repartitionById(-(-ranges // group), F.col("target")).mapInArrow(_regrouped(ranges), _BLOB)
    repeats = hashed.repartitionById(ranges, F.col("target")).sortWithinPartitions("target").mapInArrow(_repeats(ranges), _BLOB)
    shares = repeats.repartitionById(ranges, F.col("target")).sortWithinPartitions("target").coalesce(-(-ranges // SHARES_A_FILE))
    merged = shares.mapInArrow(_merged(width), "id long, tag long, begins array<long>, ends array<long>")
    intervals = scratch.save(merged)
    tagged = rows.mapInArrow(_tagged, "doc_id long, text string, tag long") if several else rows.withColumn("tag", F.lit(0).cast("long"))
    if (intervals.agg(F.sum(80 + 16 * F.size("begins"))).first()[0] or 0) <= BROADCAST_BYTES:
        intervals = F.broadcast(intervals)
    found = tagged.join(intervals, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("id")) & (tagged["tag"] == intervals["tag"]), "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", begins array<long>, ends array<long>, kept_text string" if keep_text else "")
    return found.select("doc_id", "text", "begins", "ends").mapInArrow(_removed(keep_text), schema)


def repeats_sql(width: int = WINDOW) -> str:
    """The same over ``documents`` with every window as a string, for DuckDB and small tables."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), CAST([] AS VARCHAR[])) AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
w AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i + {width - 1} <= len(words) THEN array_to_string(words[i:i + {width - 1}], ' ') END AS win FROM p),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND (doc_id > min(doc_id) OVER (PARTITION BY win) OR i > min(i) OVER (PARTITION BY win, doc_id)) AS later FROM w),
c AS (SELECT doc_id, i, word, max(CAST(later AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
a AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""
