"""Best-fit packing: token ids are cut into pieces, and vector best-fit places the pieces in sequences.

A sequence has three residual capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces are
placed from the largest down, each in the sequence that, among those where every capacity suffices, the weighted dot product of
piece and residual or the weighted norm of the residual that is left prefers; where none suffices, a sequence is opened.

Pieces of one length are alike, and so are sequences of one residual. A block of pieces is packed over those kinds with
multiplicities, so the work grows with the number of lengths, not of pieces. Blocks are hash shares of all
pieces of a bounded expected size, packed independently; each costs at most one sequence more.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import Scratch, slices, texts, with_row_id

#: Pieces of a block, on average.
BLOCK = 100_000
#: Chunks that a worker's cache holds before it starts anew, about 200 bytes each.
CACHE_CHUNKS = 450_000
#: Bytes up to which a chunk is kept after its texts are done.
CACHE_LONG = 300
#: Characters of text that are encoded together.
SHARE = 1_500_000

#: White space outside ASCII, and the separators that Python alone counts as white space, in UTF-8.
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8d\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")
_MARKS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80", b"\xef\xbb\xbf")
_CHUNK = re.compile(rb"\s*\S+|\s+")


#: How byte-level vocabularies cut a text before merging. Fixed value.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _by_ranks(path: str):
    """The same vocabulary as a tiktoken encoding, which merges faster; only where ids follow the order of merges, so that both merge alike."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    ids = model["vocab"]
    made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or len(set(made)) < len(made) or made[0] < 255:
        return None
    # printable bytes stand for themselves, the others for the letters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letter[c] for c in t): i for t, i in ids.items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Chunks:
    """Ids of texts, from a cache of white space and the word after it: the tokenizer never joins a word with the space that follows it, so a text's ids are those of its chunks."""

    def __init__(self, path: str, special_as_text: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        # a text that holds an added token's string may have that token's id there, whatever surrounds it
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id; the byte-level alphabet has a letter for each
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.known: dict[bytes, bytes] = {}
        self.fast = _by_ranks(path)

    def ids(self, text: bytes) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")

    def learn(self, chunks: set[bytes]) -> None:
        """Encode chunks together where each begins with a space, and part the ids by their bytes."""
        spaced = [c for c in chunks if c[0] == 32]
        for c in chunks.difference(spaced):
            self.known[c] = self.ids(c).tobytes()
        for s in range(0, len(spaced), 1000):
            own = spaced[s : s + 1000]
            joined = b"".join(own)
            ids = self.ids(joined) if self.fast is None else np.asarray(self.fast.encode_ordinary(joined.decode("utf-8", "replace")), "<u4")
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            at = 4 * np.searchsorted(np.cumsum(self.width[ids]), ends, side="left") + 4
            raw = ids.tobytes()
            self.known.update(zip(own, [raw[i:j] for i, j in zip([0, *at.tolist()], at.tolist(), strict=False)], strict=True))

    def whole(self, text: bytes) -> bool:
        """Whether a text must go to the tokenizer as it is: it has an added token or white space that chunks don't know."""
        return any(t in text for t in self.added) or (any(m in text for m in (_MARKS[:4] if text.isascii() else _MARKS)) and _OTHER_SPACE.search(text) is not None)

    def encode(self, docs: list[bytes]) -> list[bytes]:
        """Little-endian ids of each text."""
        parts = [None if self.whole(d) else _CHUNK.findall(d) for d in docs]
        new = set(itertools.filterfalse(self.known.__contains__, itertools.chain.from_iterable(p for p in parts if p)))
        if len(self.known) + len(new) > CACHE_CHUNKS:
            self.known.clear()
            new = set().union(*(p for p in parts if p))
        self.learn(new)
        out = [self.ids(d).tobytes() if p is None else b"".join(map(self.known.__getitem__, p)) for d, p in zip(docs, parts, strict=True)]
        for c in new:
            if len(c) > CACHE_LONG:
                del self.known[c]
        return out


@functools.cache
def _chunks(path: str, special_as_text: bool) -> _Chunks:
    return _Chunks(path, special_as_text)


def _pieces(path: str, end_id: int, most: int, with_ids: bool, special_as_text: bool):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _chunks(path, special_as_text).encode
        for b in batches:
            rows, starts, lengths, pieces, crcs, raw = [], [], [], [], [], []

            def flush() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                out = {"rid": b.column("rid").take(at), "doc_id": b.column("doc_id").take(at), "piece": pa.array(pieces, pa.int32()), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in raw], pa.list_(pa.int32()))
                for x in (rows, starts, lengths, pieces, crcs, raw):
                    x.clear()
                return pa.record_batch(out)

            docs = texts(b.column("text"))
            encoded = (x for part in slices([len(t) for t in docs], SHARE) for x in encode(docs[part]))
            for i, ids in enumerate(encoded):
                ids += end
                n = len(ids) // 4
                cut, start, piece = n % most or most, 0, 0
                while start < n:
                    own = ids[4 * start : 4 * cut]
                    rows.append(i), starts.append(start), lengths.append(cut - start), pieces.append(piece), crcs.append(zlib.crc32(own))
                    if with_ids:
                        raw.append(own)
                    start, cut, piece = cut, cut + most, piece + 1
                if len(rows) >= 20_000:
                    yield flush()
            yield flush()

    return run


_PIECE = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds at most, and each capacity's weight in the choice; attention is the sum of squared lengths."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    score: str = "norm"


def best_fit(lengths: np.ndarray, caps: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """Vector best-fit of the lengths. Returns each one's sequence (from 0) and its offset there."""
    total = np.array([caps.tokens, caps.documents, caps.attention], float)
    weight = np.array(caps.weights)
    order = np.argsort(-lengths, kind="stable")
    kinds, counts = np.unique(lengths, return_counts=True)
    state = np.zeros((256, 3))  # residuals of each kind of open sequence
    held: list[list[np.ndarray]] = []  # its sequences
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used, opened, at = 0, 0, 0
    index: dict[tuple[float, ...], int] = {}
    many = np.zeros(256, np.int64)

    def put(residual: np.ndarray, ids: np.ndarray) -> None:
        nonlocal state, many, used
        key = tuple(residual)
        if (k := index.get(key)) is None:
            if used == len(state):
                state, many = np.concatenate([state, np.zeros_like(state)]), np.concatenate([many, np.zeros_like(many)])
            k = index[key] = used
            state[k] = residual
            held.append([])
            used += 1
        held[k].append(ids)
        many[k] += len(ids)

    for length, count in zip(kinds[::-1], counts[::-1], strict=True):
        size = np.array([length, 1, float(length) ** 2])
        items, at = order[at : at + count], at + count
        if (size > total).any():
            raise ValueError("a piece exceeds the capacity of an empty sequence")
        while len(items):
            fits = np.flatnonzero((many[:used] > 0) & (state[:used] >= size).all(axis=1))
            if len(fits):
                left = state[fits]
                if caps.score == "norm":
                    k = fits[np.argmin(((((left - size) / total) ** 2) * weight).sum(axis=1))]
                else:
                    k = fits[np.argmax((left / total * (size / total) * weight).sum(axis=1))]
                ids = np.concatenate(held[k]) if len(held[k]) > 1 else held[k][0]
                take, rest = ids[: len(items)], ids[len(items) :]
                held[k] = [rest] if len(rest) else []
                many[k] = len(rest)
                residual = state[k].copy()
            else:  # as many as one kind of piece needs, one in each; those that fit together follow in the next turns
                each = int(min((total // size).min(), len(items)))
                new = -(-len(items) // each)
                take, residual = np.arange(opened, opened + new), total
                opened += new
            own, items = items[: len(take)], items[len(take) :]
            sequence[own], offset[own] = take, int(caps.tokens - residual[0])
            put(residual - size, take)
    return sequence, offset


def _pack(caps: Capacities):
    def run(block: pa.Table) -> pa.Table:
        order = np.lexsort((block.column("piece").to_numpy(), block.column("rid").to_numpy()))
        block = block.take(pa.array(order))
        sequence, offset = best_fit(block.column("length").to_numpy(), caps)
        sequence = sequence + (block.column("block").to_numpy().astype(np.int64) << 40)
        return block.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, caps: Capacities = Capacities(), end_id: int = 2, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """Pack ``docs``: (doc_id, text, ...), whole texts, into sequences. Returns a row for each piece: rid (one for each input row), doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids on request.

    Null or empty text: the end id alone. Null doc_id: kept as null. Repeated rows: each is packed. Empty table: no row. Other columns, whatever their names, are ignored.
    The text of a document longer than a sequence is cut from its end, so only its first piece may be shorter. Ids are those that the tokenizer's file gives without further settings: a special token's string in a text becomes that token, unless ``special_as_text``.
    """
    scratch = Scratch(spark, "pack")
    rows = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    schema = _PIECE + (", ids array<int>" if with_ids else "")
    pieces = scratch.save(rows.mapInArrow(_pieces(tokenizer_path, end_id, caps.tokens, with_ids, special_as_text), schema))
    blocks = max(1, round(pieces.count() / BLOCK))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("rid", "piece"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(_pack(caps), schema + ", sequence_id long, offset long")
