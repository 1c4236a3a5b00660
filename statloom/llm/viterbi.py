"""Token counts: the number of pieces of a vocabulary's segmentation of whole texts, without the segmentation.

An Aho-Corasick automaton finds every vocabulary piece that ends at each place of a word; dynamic programming carries the
best prefix and its number of pieces to the end. What is best is the file's own rule:

* Unigram: the greatest sum of scores. Ties go to the longest piece that ends there, as in the unigram model of the tokenizers library, which visits starts in order and replaces
  only by a better score. A character without a piece of its own may be an unknown piece, ten below the least score.
* Merge ranks (BPE): scores order merges and don't add up. Merging is local: a segmentation is the tokenizer's if each piece and each two neighbours, merged alone, stay as they are.
  So exactly one piece that ends at a place agrees with the last piece of the prefix before it, and that one is carried. Whether two pieces stay apart is
  found by merging the two, best rank first and leftmost of equals, and kept.

An unknown character counts as its UTF-8 bytes if the vocabulary has all byte pieces; else a run of unknown characters counts as one.
Words are cut before every space (before a run of spaces for merges), and around line ends if no longer piece contains one.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import texts

SPACE = "▁"
PENALTY = 10.0
#: The score of pieces that merge after all others (runs of spaces). Fixed value.
LAST = -1e9
CACHE_WORDS = 400_000
#: Pairs of pieces that are kept; about 200 bytes each.
CACHE_PAIRS = 400_000
#: Longer words are counted but not kept.
LONG = 200


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, by id."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), float(m.get_score(i))) for i in range(m.vocab_size())]


class Counter(dict):
    """Word -> number of pieces; a cache of bounded size."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        known = {p for p, _ in pieces}
        self.by_bytes = all(f"<0x{i:02X}>" in known for i in range(256))
        # a line end that is unknown may join unknown neighbours into one piece
        self.cut = ("\n" in known or self.by_bytes) and not any("\n" in p and len(p) > 1 for p in known)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self.pieces(word)
        if len(word) <= LONG:
            self[word] = value
        return value

    def pieces(self, word: str) -> int:
        n = len(word)
        best, count, lost = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, single, unknown = 0, False, self.unknown

        def close(end: int, found: bool) -> None:
            """A character without a piece may be unknown; it is the shortest, so it comes last."""
            score = best[end - 1] + unknown
            if not found or score > best[end]:
                best[end], lost[end] = score, True
                count[end] = count[end - 1] + (len(word[end - 1].encode("utf-8", "replace")) if self.by_bytes else not lost[end - 1])

        found = False
        for last, (size, s) in self.automaton.iter(word):
            end = last + 1
            if end != at:
                if at and not single:
                    close(at, found)
                for e in range(at + 1, end):
                    close(e, False)
                at, single, found = end, False, False
            score = best[end - size] + s
            if not found or score > best[end]:
                best[end], count[end], found, lost[end] = score, count[end - size] + 1, True, False
            if size == 1:
                single = True
        if at and not single:
            close(at, found)
        for e in range(at + 1, n + 1):
            close(e, False)
        return count[n]

    def text(self, text: str) -> int:
        words = text.split(" ")
        if not words[0]:
            del words[0]
        if not self.cut:
            return sum(map(self.__getitem__, [SPACE + w for w in words]))
        plain = [SPACE + w for w in words if "\n" not in w]
        total = sum(map(self.__getitem__, plain))
        if len(plain) < len(words):
            for w in words:
                if "\n" in w:
                    head, *rest = w.split("\n")
                    total += self[SPACE + head] + len(rest) * self["\n"] + sum(self[x] for x in rest if x)
        return total


def by_ranks(path: str) -> list[tuple[str, float]] | None:
    """Pieces that text may become and their scores, if those are merge ranks (0, -1, -2, ... by id, or LAST); byte pieces are left in."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    own = [i for i in range(m.vocab_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i))]
    scores = [float(m.get_score(i)) for i in own]
    if not all(s in (-float(k), LAST) for k, s in enumerate(scores)):
        return None
    return [(m.id_to_piece(i), float(m.get_score(i))) for i in range(m.vocab_size()) if m.is_byte(i)] + [(m.id_to_piece(i), s) for i, s in zip(own, scores, strict=True)]


def merged(parts: list[str], scores: dict[str, float]) -> list[str]:
    """Merge the neighbours that make the piece of the best score, the leftmost of equals, until none make one."""
    while len(parts) > 1:
        made = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores]
        if not made:
            break
        i = min(made)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class MergeCounter(dict):
    """Word -> number of pieces of a vocabulary of merge ranks; a cache of bounded size."""

    def __init__(self, pieces: list[tuple[str, float]]):
        names = {p for p, _ in pieces}
        self.by_bytes = all(f"<0x{i:02X}>" in names for i in range(256))
        self.scores = {p: s for p, s in pieces if p and not re.fullmatch("<0x[0-9A-F]{2}>", p)}
        self.automaton = ahocorasick.Automaton()
        for p in self.scores:
            if merged(list(p), self.scores) == [p]:  # else no merge makes it
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.apart: dict[tuple[str, str], bool] = {}
        # a run of spaces and what follows up to the next space; whole texts if a piece has a space after something else
        line_end = r"\n" if self.by_bytes and not any("\n" in p and len(p) > 1 for p in self.scores) else ""
        pattern = (r"\n|" if line_end else "") + f"{SPACE}+[^{SPACE}{line_end}]*|[^{SPACE}{line_end}]+"
        self.words = None if any(SPACE in p.lstrip(SPACE) for p in self.scores) else re.compile(pattern)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self.pieces(word)
        if len(word) <= LONG:
            self[word] = value
        return value

    def stay(self, left: str, right: str) -> bool:
        key = left, right
        if (found := self.apart.get(key)) is None:
            if len(self.apart) >= CACHE_PAIRS:
                self.apart.clear()
            found = self.apart[key] = merged(list(left + right), self.scores) == [left, right]
        return found

    def pieces(self, word: str) -> int:
        n = len(word)
        count, last = [0] * (n + 1), [""] * (n + 1)  # of each prefix: pieces, and the last one ("" at the start and after an unknown character)
        at, found = 0, True

        def close(end: int) -> None:
            """No piece ends here, so this character is unknown: nothing joins it."""
            lost = end > 1 and not last[end - 1]
            count[end] = count[end - 1] + (len(word[end - 1].encode("utf-8", "replace")) if self.by_bytes else not lost)

        for place, piece in self.automaton.iter(word):
            end = place + 1
            if end != at:
                if not found:
                    close(at)
                for e in range(at + 1, end):
                    close(e)
                at, found = end, False
            if not found:
                before = last[end - len(piece)]
                if not before or self.stay(before, piece):
                    count[end], last[end], found = count[end - len(piece)] + 1, piece, True
        if not found:
            close(at)
        for e in range(at + 1, n + 1):
            close(e)
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        whole = SPACE + text.replace(" ", SPACE)
        return self.pieces(whole) if self.words is None else sum(map(self.__getitem__, self.words.findall(whole)))


@functools.cache
def counter(path: str) -> Counter | MergeCounter:
    ranks = by_ranks(path)
    return Counter(vocabulary(path)) if ranks is None else MergeCounter(ranks)


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            own = [t.decode("utf-8", "replace") for t in texts(b.column("text"))]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_chars": pa.array(list(map(len, own)), pa.int64()), "n_tokens": pa.array(np.array([c.text(t) for t in own], np.int64))})

    return run


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_chars and n_tokens of each whole text, by the file's own rule: best sum of scores, or merges by rank.

    Null or empty text: 0 tokens. Null doc_id and repeated rows: a row for each. Empty table: no row. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counts(model_path), "doc_id long, n_chars long, n_tokens long")
