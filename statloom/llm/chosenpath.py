"""MinHash near-duplicate detection by a chosen-path set similarity join.

Every distinct shingle set gets ``POSITIONS`` minwise tokens. Each of several independent trees starts with all sets in
one node. A node picks some positions by hash, and a set goes to the child named by the position and its own token
there, so two sets of similarity s share a child with chance 1 - (1 - s)**branch at each node. Two levels are always
taken; a node that still has more than ``SMALL`` sets recurses, a smaller one is compared exhaustively by two bits of each
token. A tree misses a pair at the threshold, at whatever depth, with at most the chance e = (1 - s + s * e)**branch that such a branching dies out;
``shape`` chooses branches and trees so that at most one in ten thousand such pairs is missed (at 0.8: two branches, e = 0.0625, four trees, 2e-5).
The comparison by bits, at three and a half standard deviations, misses 3e-4 of them; both miss far less of closer pairs.

Links are confirmed on full sets. A node first offers for each set the MOST others that look most alike; once those links have
made components, a node that had more is looked at again and offers eight times as many of the pairs that still cross two components.
A node that has even more gets the full sets of its members and confirms all such pairs itself, best first, joining components as
it goes. A large group of near copies thus costs a few links for each of its members, not all pairs, and no link between
components is lost.

No task gets a large node whole. At first it is dealt in parts of about ``SMALL`` sets, each compared in itself. Later the sets outside its
largest component, at most ``SMALL`` or the node branches, go to every part, and the component's are dealt out. Full sets are bounded by bytes in the same way.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm.common import Scratch, hash_words, mix, slices, texts, with_row_id
from statloom.llm.components import components

POSITIONS, DEPTH = 128, 2
#: Sets in a node that are compared exhaustively.
SMALL = 8192
#: Nodes up to this size offer all their pairs at once.
TINY = 8
#: Partners that a set is offered with at first.
MOST = 2
#: Partners of a verification team, which gets its leader's set once.
CHUNK = 64
#: Shingles that are compared with a set at a time.
SHINGLES = 200_000
#: Shingles of full sets that a part holds, and sets up to which a node is not branched for its shingles.
HELD_SHINGLES, FEW = 20_000_000, 64
#: Bytes of a side that is broadcast at most.
BROADCAST_BYTES = 12_000_000
#: Bytes of a hashed shingle that are kept for verification.
KEPT = 6

_random = np.random.default_rng(10)
_MULTIPLY = _random.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ONE = np.uint64(1)


@dataclass(frozen=True)
class Shape:
    trees: int
    branch: int

    @property
    def nodes(self) -> int:
        """Of a set, on the DEPTH-th level of all trees."""
        return self.trees * self.branch**DEPTH


def shape(threshold: float, recall: float = 0.9999) -> Shape:
    """The trees and branches of least work that find ``recall`` of the pairs at the threshold."""
    best = None
    for branch in range(2, 17):
        lost = 0.0
        for _ in range(1000):  # up to the chance of dying out at any depth
            lost = (1 - threshold + threshold * lost) ** branch
        if lost < 0.5:
            own = Shape(max(1, math.ceil(math.log(1 - recall) / math.log(max(lost, 1e-12)) - 1e-9)), branch)
            best = own if best is None or own.nodes < best.nodes else best
    if best is None:
        raise ValueError("the threshold is too low for chosen paths")
    return best


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence where it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    h = words[: n - width + 1].copy()
    for j in range(1, width):
        h = mix(h) + words[j : n - width + 1 + j]
    return np.unique(mix(h + np.uint64(width)))


def _summary(k: int):
    """Batches of (rid, doc_id, text) to a row for each: set size, digest, minwise tokens, their two bit planes and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = texts(b.column("text"))
            for part in slices([len(d) for d in docs], 2_000_000):
                sets = [shingle_hashes(hash_words(d.lower().split()), k) for d in docs[part]]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                tokens = np.zeros((len(sets), POSITIONS), np.uint32)
                if (full := np.flatnonzero(sizes)).size:
                    joined = np.concatenate(sets)
                    starts = (np.cumsum(sizes) - sizes)[full]
                    buffer = np.empty_like(joined)
                    for i, m in enumerate(_MULTIPLY):
                        np.multiply(joined, m, out=buffer)
                        tokens[full, i] = (mix(np.minimum.reduceat(buffer, starts)) >> np.uint64(32)).astype(np.uint32)
                bits = np.arange(64, dtype=np.uint64)
                planes = [(((tokens[:, at : at + 64] >> np.uint32(p)) & np.uint32(1)).astype(np.uint64) << bits).sum(axis=1, dtype=np.uint64).view(np.int64) for at in (0, 64) for p in (0, 1)]
                yield pa.record_batch({
                    "rid": b.column("rid")[part.start : part.stop], "doc_id": b.column("doc_id")[part.start : part.stop],
                    "n": pa.array(sizes.astype(np.int64)), "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    **{f"p{i}": pa.array(x) for i, x in enumerate(planes)}, "tokens": pa.array([t.tobytes() for t in tokens], pa.binary()),
                    "members": pa.array([s.view(np.uint8).reshape(-1, 8)[:, 8 - KEPT :].tobytes() for s in sets], pa.binary()),
                })

    return run


PLANES = ("p0", "p1", "p2", "p3")
_SUMMARY = "rid long, doc_id long, n long, digest binary, p0 long, p1 long, p2 long, p3 long, tokens binary, members binary"


def _children(nodes: np.ndarray, tokens: np.ndarray, branch: int) -> tuple[np.ndarray, np.ndarray]:
    """The children of each (node, set), one for each of ``branch`` positions; the second array has their rows."""
    out = []
    first = mix(nodes)
    rows = np.arange(len(nodes))
    # steps by an odd number pass every position of a power of two, so a node's positions differ
    step = mix(first + _ONE) | _ONE
    for j in range(branch):
        chosen = (first + step * np.uint64(j)) % np.uint64(POSITIONS)
        out.append(mix(mix(nodes + chosen + _ONE) + tokens[rows, chosen.astype(np.int64)].astype(np.uint64)))
    return np.concatenate(out), np.tile(rows, branch)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POSITIONS)


def _first_nodes(tokens: np.ndarray, of: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each tree's nodes on its DEPTH-th level, and their rows."""
    for tree in range(of.trees):
        nodes, rows = np.full(len(tokens), mix(np.uint64([tree + 1]))[0]), np.arange(len(tokens))
        for _ in range(DEPTH):
            nodes, own = _children(nodes, tokens[rows], of.branch)
            rows = rows[own]
        yield nodes, rows


def _paths(of: Shape):
    """Batches of (rid, n, planes, tokens) to the nodes of every tree's DEPTH-th level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for nodes, rows in _first_nodes(_tokens(b.column("tokens")), of):
                    yield _node_rows(nodes, b.take(pa.array(rows)))

    return run


def _path_ids(of: Shape):
    """The nodes alone, to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch({"node": pa.array(np.concatenate([nodes for nodes, _ in _first_nodes(_tokens(b.column("tokens")), of)]).view(np.int64))})

    return run


def _node_rows(nodes: np.ndarray, b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.record_batch({"node": pa.array(nodes.view(np.int64))} | {k: b.column(k) for k in ("rid", "n", *PLANES)})


def _branch(of: Shape):
    """Batches of (node, rid, n, planes, tokens) to the node's children, with no earlier node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                nodes, rows = _children(b.column("node").to_numpy().view(np.uint64), _tokens(b.column("tokens")), of.branch)
                out = _node_rows(nodes, b.take(pa.array(rows)))
                yield out.append_column("earlier", pa.array([b""] * len(nodes), pa.binary()))

    return run


def _earlier(branched: np.ndarray, of: Shape):
    """Batches of (node, rid, n, planes, tokens) with the set's nodes that come before this one; 0 for a branched one, below which two sets may part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                seen = np.empty((b.num_rows, of.nodes), np.uint64)
                at = 0
                for nodes, rows in _first_nodes(_tokens(b.column("tokens")), of):
                    order = np.argsort(rows, kind="stable")
                    seen[:, at : at + of.branch**DEPTH] = nodes[order].reshape(b.num_rows, -1)
                    at += of.branch**DEPTH
                own = b.column("node").to_numpy().view(np.uint64)
                same = seen == own[:, None]
                before = np.where(same.any(axis=1), same.argmax(axis=1), 0)
                seen[np.isin(seen, branched)] = 0
                out = _node_rows(own, b)
                yield out.append_column("earlier", pa.array([x[:k].tobytes() for x, k in zip(seen, before, strict=True)], pa.binary()))

    return run


_NODE = "node long, rid long, n long, p0 long, p1 long, p2 long, p3 long"


class _Group:
    """Arrays of one node's sets."""

    def __init__(self, c: dict[str, np.ndarray], threshold: float, least: int):
        self.rid, self.n, self.label, self.planes = c["rid"], c["n"], c["label"], [c[k] for k in PLANES]
        self.threshold, self.least = threshold, least
        # the first sets are compared with each other in the first part of a node alone
        self.first = int(c["other"][0])
        self.skip = self.first if c["part"][0] else 0
        self.earlier = None
        if "earlier" in c and (most := max(map(len, c["earlier"]))):
            self.earlier = np.stack([np.frombuffer(x.ljust(most, b"\0"), np.uint64) for x in c["earlier"]])
            self.before = np.array([len(x) // 8 for x in c["earlier"]])

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each of the first sets with the later ones that may reach the threshold, are in another component and didn't meet it in an earlier node, the best first."""
        for i in range(min(self.first, len(self.rid) - 1)):
            start = max(i + 1, self.skip)
            rest = slice(start, None)
            agree = agreement(*((p[i], p[rest]) for p in self.planes))
            n = self.n[rest]
            hit = np.flatnonzero((agree >= self.least) & (np.minimum(n, self.n[i]) >= self.threshold * np.maximum(n, self.n[i]) - 1e-9) & (self.label[rest] != self.label[i]))
            if self.earlier is not None and len(hit):
                k = np.flatnonzero(self.earlier[i, : self.before[i]])
                hit = hit[~(self.earlier[np.ix_(hit + start, k)] == self.earlier[i, k]).any(axis=1)]
            if len(hit):
                yield i, hit[np.argsort(-agree[hit], kind="stable")] + start


def agreement(*planes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Positions at which both bits agree; two planes for each 64 positions."""
    (a0, b0), (a1, b1), (a2, b2), (a3, b3) = planes
    return POSITIONS - (np.bitwise_count((a0 ^ b0) | (a1 ^ b1)).astype(np.int64) + np.bitwise_count((a2 ^ b2) | (a3 ^ b3)))


def _offer(threshold: float, full: bool, most: int):
    """Batches sorted by node, part and, if full, with the most frequent component last; gives pairs (kind 0), up to ``most`` for a set, and the sets of nodes that have more (1)."""
    least = _least_agreement(threshold)

    def offered(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        x, y = np.concatenate(a), np.concatenate(b)
        a.clear(), b.clear()
        return pa.record_batch({"kind": pa.array(np.zeros(len(x), np.int8)), "a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    def tiny(c: dict[str, np.ndarray], at: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within nodes of up to TINY sets; left: how many sets of its node follow each."""
        for k in range(1, TINY):
            at = at[left[at] >= k]
            if not len(at):
                return
            i, j = at, at + k
            near = agreement(*((c[p][i], c[p][j]) for p in PLANES)) >= least
            i, j = i[near], j[near]
            ok = (np.minimum(c["n"][i], c["n"][j]) >= threshold * np.maximum(c["n"][i], c["n"][j]) - 1e-9) & (c["label"][i] != c["label"][j])
            if ok.any():
                yield c["rid"][i[ok]], c["rid"][j[ok]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("node", "part", "rid", "n", *PLANES, "label", "size", "other", "dealt", *(["earlier"] if full else []))
        for c in whole_groups(batches, names):
            a, b = [], []
            starts = _starts(c)
            ends = np.r_[starts[1:], len(c["node"])]
            size = ends - starts
            left = np.repeat(ends, size) - 1 - np.arange(len(c["node"]))
            small = (c["size"][starts] <= TINY) & (size == c["size"][starts])
            for x, y in tiny(c, np.flatnonzero(np.repeat(small, size)), left):
                a.append(x), b.append(y)
            for s, e in zip(starts[~small], ends[~small], strict=True):
                group = _Group({k: v[s:e] for k, v in c.items()}, threshold, least)
                dealt = bool(c["dealt"][s])  # sets of other parts were not compared with these
                more, touched = dealt, np.full(e - s, dealt)
                for i, hit in group.candidates():
                    touched[i] = touched[hit] = True
                    a.append(np.full(min(most, len(hit)), group.rid[i])), b.append(group.rid[hit[:most]])
                    more |= len(hit) > most
                    if len(a) >= 5000:
                        yield offered(a, b)
                if more:  # sets like no other of the node are done with
                    yield pa.record_batch({"kind": pa.array(np.ones(int(touched.sum()), np.int8)), "a": pa.array(c["node"][s:e][touched]), "b": pa.array(c["rid"][s:e][touched])})
            if a:
                yield offered(a, b)

    return run


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEPT, 8), np.uint8)
    out[:, :KEPT] = np.frombuffer(raw, np.uint8).reshape(-1, KEPT)
    return out.reshape(-1).view(np.uint64)


def _least_agreement(threshold: float) -> int:
    """Two bits of a token agree with chance s + (1 - s) / 4; three and a half standard deviations below that."""
    p = threshold + (1 - threshold) / 4
    return int(POSITIONS * (p - 3.5 * (p * (1 - p) / POSITIONS) ** 0.5))


def _exact(threshold: float):
    """Batches of nodes' parts with members, the most frequent component last; gives confirmed links, at most one less than a part's components."""
    hundred = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in whole_groups(batches, ("node", "part", "rid", "n", *PLANES, "label", "size", "other", "earlier", "members")):
            starts = _starts(c)
            a, b = [], []
            for s, e in zip(starts, np.r_[starts[1:], len(c["node"])], strict=True):
                group = _Group({k: v[s:e] for k, v in c.items()}, threshold, _least_agreement(threshold))
                group.label = group.label.copy()
                raw = c["members"][s:e]
                sizes = np.array([len(m) // KEPT for m in raw])
                for i, hit in group.candidates():
                    own = _unpacked(raw[i])
                    for part in slices(sizes[hit].tolist(), SHINGLES):  # best first
                        j = hit[part]
                        j = j[group.label[j] != group.label[i]]
                        if not len(j):
                            continue
                        flat = _unpacked(b"".join(raw[j]))
                        same = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                        both = np.add.reduceat(same.astype(np.int64), np.cumsum(sizes[j]) - sizes[j])
                        for y in j[100 * both >= hundred * (sizes[j] + sizes[i] - both)]:
                            if group.label[y] != group.label[i]:
                                a.append(group.rid[i]), b.append(group.rid[y])
                                group.label[group.label == group.label[y]] = group.label[i]
            if a:
                yield pa.record_batch({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})

    return run


def _starts(c: dict[str, np.ndarray]) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (c["node"][1:] != c["node"][:-1]) | (c["part"][1:] != c["part"][:-1])])


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of whole parts of nodes, of bounded rows and bytes as long as no part is larger."""
    held: list[dict[str, np.ndarray]] = []
    rows = size = 0

    def taken() -> dict[str, np.ndarray]:
        out = {k: np.concatenate([h[k] for h in held]) for k in names}
        held.clear()
        return out

    for b in batches:
        if not b.num_rows:
            continue
        new = {k: b.column(k).to_numpy(zero_copy_only=False) for k in names}
        new |= {k: new[k].view(np.uint64) for k in PLANES}  # bitwise_count takes absolute values of signed numbers
        held.append(new)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows > 2 * SMALL or size > KEPT * HELD_SHINGLES:
            whole = taken()
            last = int(_starts(whole)[-1])  # this part may go on in the next batch
            if last:
                yield {k: v[:last] for k, v in whole.items()}
            held.append({k: v[last:] for k, v in whole.items()})
            rows, size = len(held[0]["node"]), size * (len(whole["node"]) - last) // len(whole["node"])
    if held:
        yield taken()


_EARLIER = _NODE + ", earlier binary"
_OFFER = "kind byte, a long, b long"


def _verify(threshold: float):
    """Batches of (a, team, lead, rid, members) sorted by a and team, a's own row first; gives the confirmed links."""
    hundred = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, team, own = None, None, None
        for batch in batches:
            out = []
            for a, t, lead, rid, raw in zip(*(batch.column(k).to_pylist() for k in ("a", "team", "lead", "rid", "members")), strict=True):
                if lead:
                    leader, team, own = a, t, _unpacked(raw)
                    continue
                if (a, t) != (leader, team):
                    raise ValueError("a verification group has no leader")
                other = _unpacked(raw)
                small, large = (own, other) if len(own) < len(other) else (other, own)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if 100 * both >= hundred * (len(own) + len(other) - both):
                    out.append((leader, rid))
            if out:
                yield pa.record_batch({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    return run


class ChosenPath:
    """Groups documents whose k-word shingle sets have a Jaccard similarity of at least ``threshold``."""

    def __init__(self, spark: SparkSession, k: int = 5, threshold: float = 0.8, small: int = SMALL, recall: float = 0.9999):
        self.spark, self.k, self.threshold, self.small, self.shape = spark, k, threshold, small, shape(threshold, recall)
        # few files, except where tasks hold whole sets or compare them
        self.scratch = Scratch(spark, "near", few=8)

    def light(self, table: DataFrame, width: int = 24) -> DataFrame:
        """The table, to be broadcast if its rows of that many bytes are few."""
        return F.broadcast(table) if width * table.count() <= BROADCAST_BYTES else table

    def only(self, table: DataFrame, rids: DataFrame) -> DataFrame:
        """The table's rows of some sets, so that what follows shuffles no others. Their numbers are broadcast up to a size, beyond it joined."""
        return table.join(self.light(rids.select("rid").distinct()), "rid", "left_semi")

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets reach the threshold. The partners of ``a`` are dealt out in teams of about CHUNK, and its set goes to each team once."""
        count = pairs.groupBy("a").agg(F.count("*").alias("partners"))
        teams = pairs.join(count, "a").withColumn("team", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / CHUNK)))
        leads = teams.select("a", "team", F.lit(True).alias("lead"), F.col("a").alias("rid")).distinct()
        need = self.scratch.save(teams.select("a", "team", F.lit(False).alias("lead"), F.col("b").alias("rid")).union(leads))
        rows = sets.join(self.light(need, 32), "rid")
        rows = rows.select("a", "team", "lead", "rid", "members").repartition("a", "team").sortWithinPartitions("a", "team", F.col("lead").desc())
        links = self.scratch.save(rows.mapInArrow(_verify(self.threshold), "u long, v long"), few=0)
        self.scratch.drop(need)
        return links

    def first(self, reps: DataFrame) -> DataFrame:
        """The sets' first nodes, those of several sets. A large one comes in parts, by hash, of about ``small`` sets."""
        tokens = reps.select("rid", "n", *PLANES, "tokens")
        large = self.scratch.save(tokens.select("tokens").mapInArrow(_path_ids(self.shape), "node long").groupBy("node").agg(F.count("*").alias("of")).where(F.col("of") > self.small))
        nodes = tokens.mapInArrow(_paths(self.shape), _NODE)
        if large.isEmpty():
            nodes = nodes.withColumns({"dealt": F.lit(False), "part": F.lit(0).cast("long")})
        else:
            part = F.pmod(F.xxhash64("rid"), F.ceil(F.col("of") / self.small))
            nodes = nodes.join(self.light(large), "node", "left").withColumn("dealt", F.col("of").isNotNull()).withColumn("part", F.when(F.col("dealt"), part).otherwise(0)).drop("of")
        size = F.count("*").over(Window.partitionBy("node", "part"))
        found = nodes.withColumn("label", F.col("rid")).withColumn("size", size).where("size > 1").withColumn("other", F.col("size"))
        return found.sortWithinPartitions("node", "part")

    def sized(self, nodes: DataFrame) -> DataFrame:
        """Nodes of at least two components, with their size, how many sets are outside the most frequent component, whether they branch and into how many parts they are dealt."""
        labels = nodes.groupBy("node", "label").agg(F.count("*").alias("of"), F.sum("n").alias("shingles"))
        top = F.max(F.struct("of", "label", "shingles"))
        sums = labels.groupBy("node").agg(F.sum("of").alias("size"), F.sum("shingles").alias("all"), top.alias("top"), F.count("*").alias("labels")).where("labels > 1")
        other, others = F.col("size") - F.col("top.of"), F.col("all") - F.col("top.shingles")
        branch = (other > self.small) | ((others > HELD_SHINGLES) & (other > FEW))
        parts = F.greatest(F.ceil(F.col("top.of") / self.small), F.ceil(F.col("top.shingles") / HELD_SHINGLES), F.lit(1))
        mixed = self.scratch.save(sums.select("node", "size", other.alias("other"), F.col("top.label").alias("main"), branch.alias("branch"), parts.alias("parts")))
        found = nodes.join(self.light(mixed, 48), "node")
        return found.withColumn("last", F.col("label") == F.col("main")).drop("main")

    def dealt(self, found: DataFrame) -> DataFrame:
        """The most frequent component's sets in one part each, the others in every part, first."""
        everywhere = F.when(F.col("last"), F.array(F.pmod(F.xxhash64("rid"), "parts"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        return found.where(~F.col("branch")).withColumn("part", F.explode(everywhere)).withColumn("dealt", F.lit(False)).drop("parts", "branch")

    def relabelled(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """(rid, label) of all sets with a link, after more links: these join components, so only their ends' labels make a graph."""
        if labels is None:
            return components(links, self.scratch).withColumnRenamed("node", "rid")
        known = self.light(labels)
        ends = links.join(known.toDF("u", "lu"), "u", "left").join(known.toDF("v", "lv"), "v", "left")
        joined = components(ends.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")), self.scratch)
        old = labels.join(self.light(joined).toDF("label", "less"), "label", "left").select("rid", F.coalesce("less", "label").alias("label"))
        new = joined.join(known, F.col("node") == F.col("rid"), "left_anti").select(F.col("node").alias("rid"), joined["label"])
        return self.scratch.save(old.union(new))

    def run(self, docs: DataFrame, given: bool = False) -> DataFrame:
        """``docs``: (doc_id long, text string), other columns are ignored but a unique long ``rid`` that is ``given``. Returns rid, doc_id, n_shingles, component_id (smallest doc_id reachable) and first (one row of each component).

        Null or empty text: an empty set that is linked with nothing. Null doc_id: sorts last; a component without any id
        has a null one. Repeated rows: each gets a row, all with the same component. Empty table: no row. Texts are read whole.
        """
        scratch = self.scratch
        rows = docs.select(*(["rid"] if given else []), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = rows if given else with_row_id(rows)
        sets = scratch.save(rows.mapInArrow(_summary(self.k), _SUMMARY), few=0)
        light = sets.select("rid", "doc_id", "n", "digest")
        classes = scratch.save(light.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")).select("digest", F.col("best.rid").alias("rid"), F.col("best.doc_id").alias("least")))
        reps = self.only(sets, classes)
        labels = tested = nodes = None
        most = MOST
        branched = np.zeros(0, np.uint64)  # of more than ``small`` sets or HELD_SHINGLES shingles each, so few
        while True:
            full, branch, again = nodes is not None, None, None
            if full:
                every = scratch.save(self.sized(nodes))
                parted = every.where("branch").select("node", "rid", "n", *PLANES)
                if not parted.isEmpty():
                    branch = scratch.save(parted.join(self.only(reps, parted).select("rid", "tokens"), "rid").mapInArrow(_branch(self.shape), _EARLIER))
                    branched = np.union1d(branched, np.array([r["node"] for r in parted.select("node").distinct().collect()], np.int64).view(np.uint64))
                found = self.dealt(every)
                if branch is not None:  # sets may have parted below an earlier node, which then doesn't count
                    found = found.withColumn("earlier", F.lit(b""))
            else:
                found = self.first(reps)
            if most > 8 * MOST:
                found = found.join(self.only(sets, every.where(~F.col("branch"))).select("rid", "members"), "rid")
                new = scratch.save(found.repartition("node", "part").sortWithinPartitions("node", "part", "last", "rid").mapInArrow(_exact(self.threshold), "u long, v long"), few=0)
            else:
                found = found.repartition("node", "part").sortWithinPartitions("node", "part", "last", "rid") if full else found
                offers = scratch.save(found.mapInArrow(_offer(self.threshold, full, most), _OFFER), few=0)
                pairs = offers.where("kind = 0").select("a", "b").distinct()
                pairs = scratch.save(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
                tested = pairs
                new = self.confirmed(pairs, sets.select("rid", "members"))
                again = offers.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("rid")).distinct()
            if not new.isEmpty():
                labels = self.relabelled(labels, new)
            todo = branch
            if again is not None:
                todo = again.join(self.only(reps, again).select("rid", "n", *PLANES, "tokens"), "rid").mapInArrow(_earlier(branched, self.shape), _EARLIER)
                todo = todo if branch is None else todo.union(branch)
            if todo is None:
                break
            if labels is not None:
                todo = todo.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
            else:
                todo = todo.withColumn("label", F.col("rid"))
            nodes, most = scratch.save(todo), most * 8
            if nodes.isEmpty():
                break
        if labels is not None:
            classes = classes.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
        else:
            classes = classes.withColumn("label", F.col("rid"))
        least = scratch.save(classes.groupBy("label").agg(F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull().alias("none"), "least", "rid")).getField("rid").alias("first_rid")))
        known = scratch.save(classes.join(self.light(least, 40), "label").select("digest", "component_id", "first_rid"))
        # empty sets need no partner and would all meet in one task
        alone = light.where("n = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
        joined = light.where("n > 0").join(self.light(known, 64), "digest")
        return joined.select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("rid") == F.col("first_rid")).alias("first")).union(alone)


def near_sql(k: int = 2, hundred: int = 80) -> str:
    """The same over ``documents`` by comparing all sets that share a shingle, for DuckDB and small tables."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{letters}', '{letters.lower()}'), '[^\\x20\\x09-\\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, least(len(w), 1)) + 1)) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '  ' ORDER BY s)) AS same FROM s GROUP BY doc_id),
r AS (SELECT same, min(doc_id) AS doc_id, any_value(n) AS n FROM n GROUP BY same),
o AS (SELECT s.doc_id, s, n FROM s JOIN r ON s.doc_id = r.doc_id),
b AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m FROM o AS a JOIN o AS b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {hundred} * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT u, v FROM b WHERE 100 * shared >= {hundred} * (n + m - shared)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
c AS (SELECT doc_id AS a, doc_id AS z FROM r UNION SELECT c.a, e.v FROM c JOIN e ON c.z = e.u),
f AS (SELECT a, min(z) AS component_id FROM c GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(f.component_id, d.doc_id) AS component_id, coalesce(f.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON n.same = r.same LEFT JOIN f ON r.doc_id = f.a"""
