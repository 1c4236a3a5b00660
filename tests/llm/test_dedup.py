import hashlib

import pytest

from statloom.llm.chosenpath import ChosenPath
from statloom.llm.components import components
from statloom.llm.common import Scratch
from statloom.llm.substring import remove_repeats


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, hundred=80):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= hundred * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies(spark, docs, small_docs, k):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ChosenPath(spark, k=k).run(docs).collect()}
    assert found == brute(small_docs, k)


def test_near_sql(small_docs):
    """The SQL that the query is held against finds brute force's groups."""
    import duckdb

    from statloom.llm.chosenpath import near_sql

    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", small_docs)
    rows = c.execute(near_sql()).fetchall()
    assert {r[0]: r[1:3] for r in rows} == brute(small_docs, 2) and all(r[3] == (r[0] == r[2]) for r in rows)


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_other_thresholds(spark, docs, small_docs, threshold):
    """Trees and branches follow the threshold."""
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ChosenPath(spark, k=2, threshold=threshold).run(docs).collect()}
    assert found == brute(small_docs, 2, round(100 * threshold))


def test_shape_reaches_the_recall():
    """The chosen trees find pairs at the threshold as often as promised, on random tokens."""
    import numpy as np

    from statloom.llm import chosenpath

    rng = np.random.default_rng(5)
    assert chosenpath.shape(0.8) == chosenpath.Shape(4, 2)
    for threshold in (0.5, 0.7, 0.8, 0.9):
        of = chosenpath.shape(threshold, 0.99)
        a = rng.integers(0, 1 << 32, (3000, chosenpath.POSITIONS), dtype=np.uint32)
        b = np.where(rng.random(a.shape) < threshold, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
        met = np.zeros(len(a), bool)
        for (x, rows), (y, _) in zip(chosenpath._first_nodes(a, of), chosenpath._first_nodes(b, of), strict=True):
            order = np.argsort(rows, kind="stable")
            x, y = x[order].reshape(len(a), -1), y[order].reshape(len(a), -1)
            met |= (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
        assert met.mean() >= 0.985
    with pytest.raises(ValueError):
        chosenpath.shape(0.01)


@pytest.mark.parametrize("small, most, shingles", [(12, 2, 20_000_000), (8192, 1, 20_000_000), (8192, 1, 3000), (30, 1, 1000)])
def test_large_group_with_recursion(spark, monkeypatch, small, most, shingles):
    """Nodes beyond small limits of sets or shingles are dealt in parts, branch and are confirmed in place; the groups stay the same."""
    import random

    from statloom.llm import chosenpath

    monkeypatch.setattr(chosenpath, "HELD_SHINGLES", shingles)
    rng = random.Random(3)
    base, other = [f"w{i}" for i in range(120)], [f"w{i}" for i in range(0, 240, 2)]
    rows = []
    for i in range(300):
        w = list(base if i % 3 else other)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(chosenpath, "MOST", most)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ChosenPath(spark, k=2, small=small).run(df).collect()}
    assert found == brute(rows, 2)


def test_branched_nodes_do_not_count_as_earlier():
    """A pair that met in a node that was branched, where it may have parted, is offered in its later nodes too."""
    import numpy as np
    import pyarrow as pa

    from statloom.llm import chosenpath

    tokens = np.random.default_rng(1).integers(0, 1 << 32, (1, chosenpath.POSITIONS), dtype=np.uint32).repeat(2, axis=0)
    of = chosenpath.shape(0.8)
    nodes = np.concatenate([n[rows == 0] for n, rows in chosenpath._first_nodes(tokens, of)])
    assert len(set(nodes.tolist())) == of.nodes
    plane = pa.array([5, 5], pa.int64())

    def links(at, branched):
        own = pa.record_batch({"node": pa.array(nodes[[at, at]].view(np.int64)), "rid": pa.array([1, 2]), "n": pa.array([100, 100]), **dict.fromkeys(chosenpath.PLANES, plane), "tokens": pa.array([t.tobytes() for t in tokens], pa.binary())})
        (b,) = chosenpath._earlier(branched, of)([own])
        columns = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("rid", "n", *chosenpath.PLANES, "earlier")} | {"label": np.array([1, 2]), "other": np.array([2, 2]), "part": np.array([0, 0])}
        columns |= {k: columns[k].view(np.uint64) for k in chosenpath.PLANES}
        group = chosenpath._Group(columns, 0.8, 90)
        return [(int(group.rid[i]), int(group.rid[j])) for i, hit in group.candidates() for j in hit]

    none = np.zeros(0, np.uint64)
    assert [links(at, none) for at in (0, 1, 5)] == [[(1, 2)], [], []]
    assert [links(at, nodes[:1]) for at in (0, 1, 5)] == [[(1, 2)], [(1, 2)], []]
    assert links(5, nodes[:5]) == [(1, 2)]


def test_near_odd_rows(spark, odd_docs, no_docs):
    assert ChosenPath(spark).run(no_docs).count() == 0
    rows = ChosenPath(spark).run(odd_docs).collect()
    assert len(rows) == 6
    assert all(r["component_id"] == 1 for r in rows if r["n_shingles"])
    assert sum(r["first"] for r in rows if r["n_shingles"]) == 1
    assert [r["component_id"] for r in rows if not r["n_shingles"]] == [None]


def test_many_partitions_are_saved_in_few_files(spark, docs, small_docs, monkeypatch):
    """Of the light tables: a file for each shuffle partition would be a small one. Comparing keeps all partitions."""
    from statloom.llm import common

    written, kept = [], []
    plain = common.Scratch.save

    def save(self, df, few=None):
        out = plain(self, df, **({} if few is None else {"few": few}))
        (written if few is None else kept).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common.Scratch, "save", save)
    own = {"spark.sql.shuffle.partitions": "600", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ChosenPath(spark, k=2).run(docs).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == brute(small_docs, 2) and max(written) <= 75


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    for alone in (0, 1000):
        found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"), alone).collect()}
        assert found == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
        assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test"), alone).count() == 0


def test_labels_of_one_task_equal_a_search():
    import numpy as np

    from statloom.llm.components import least_labels

    rng = np.random.default_rng(9)
    for n, m in ((50, 30), (2000, 1500), (3000, 9000)):
        u, v = rng.integers(0, n, m) * 7, rng.integers(0, n, m) * 7
        parent = {int(x): int(x) for x in {*u, *v}}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in zip(u, v, strict=True):
            x, y = root(int(a)), root(int(b))
            parent[max(x, y)] = min(x, y)
        nodes, labels = least_labels(u, v)
        assert dict(zip(nodes.tolist(), labels.tolist(), strict=True)) == {x: root(x) for x in parent}
    chain = rng.permutation(100_000)
    assert (least_labels(chain[:-1], chain[1:])[1] == 0).all()


def brute_repeats(rows, width=20):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        w = (t or "").encode().split()
        covered = set()
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                covered.update(range(s, s + width))
            seen.add(key)
        kept = b" ".join(x for n, x in enumerate(w) if n not in covered)
        out[i] = (len(w), len(covered), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_windows(spark, docs, small_docs):
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(spark, docs).collect()}
    rows = [(r[0], r[1] or "") for r in small_docs]
    assert found == brute_repeats(rows)


def test_repeated_windows_across_ranges(spark, docs, small_docs, monkeypatch):
    """Some ranges, and many that are reached by groups."""
    from statloom.llm import substring

    monkeypatch.setattr(substring, "BROADCAST_BYTES", 0)
    wanted = brute_repeats([(r[0], r[1] or "") for r in small_docs])
    for entries, direct in ((2000, 2048), (300, 4)):
        found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(spark, docs, keep_text=True, entries=entries, direct=direct).collect()}
        assert found == wanted


def test_intervals_are_saved_in_few_files(spark, docs, small_docs, monkeypatch):
    """A file for each range would be many small ones."""
    from statloom.llm import substring

    parts = []
    plain = substring.Scratch.save
    monkeypatch.setattr(substring.Scratch, "save", lambda self, df: parts.append(df.rdd.getNumPartitions()) or plain(self, df))
    letters = sum(len(r[1] or "") for r in small_docs)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(spark, docs, entries=letters / 6 / 40).collect()}
    assert parts == [5] and found == brute_repeats([(r[0], r[1] or "") for r in small_docs])


def counted_here(rows, width, ranges, group, share=None):
    """The steps of the operator in one process: (doc_id, removed words) and the entries that each target gets of known repeats."""
    import pyarrow as pa

    from statloom.llm import substring

    def dealt(batches):
        out = {}
        for b in batches:
            for r in b.to_pylist():
                out.setdefault(r["target"], []).append(r)
        return [substring._rows(out[k]) for k in sorted(out)]

    batches = [pa.record_batch({"doc_id": pa.array([i for i, _ in rows[s : s + 5]], pa.int64()), "text": pa.array([t for _, t in rows[s : s + 5]])}) for s in range(0, len(rows), 5)]
    first = dealt(substring._windows(width, ranges, group, False)(iter(batches)))
    known = {b.column("target")[0].as_py(): sum(len(substring._entries(r)[2]) for r in b.to_pylist() if r["kind"]) for b in first}
    if group > 1:
        first = dealt(x for b in first for x in substring._regrouped(ranges)(iter([b])))
    repeats = dealt(x for b in first for x in substring._repeats(ranges)(iter([b])))
    removed = {}
    for b in repeats:
        for found in substring._merged(width)(iter([b])):
            for r in found.to_pylist():
                removed[r["id"]] = sum(e - s for s, e in zip(r["begins"], r["ends"], strict=True))
    return removed, known


@pytest.mark.parametrize("group", [1, 3])
def test_windows_of_one_hash_are_told_apart(small_docs, monkeypatch, group):
    """Six bits of the first hash make most windows collide; the second one tells them apart."""
    import numpy as np

    from statloom.llm import substring

    plain = substring.rolling
    monkeypatch.setattr(substring, "rolling", lambda words, k, *base: plain(words, k, *base) if base else plain(words, k) << np.uint64(58))
    rows = [(r[0], r[1] or "") for r in small_docs]
    removed, _ = counted_here(rows, 20, 8, group)
    assert removed == {i: gone for i, (_, gone, _) in brute_repeats(rows).items() if gone}


def test_known_repeats_are_spread():
    """Documents that repeat themselves: no target holds much more than its share of the known repeats."""
    text = " ".join(f"a{i}" for i in range(60))
    _, known = counted_here([(i, f"{text} {text} x{i}") for i in range(800)], 20, 16, 1)
    assert len(known) == 16 and max(known.values()) <= 4 * sum(known.values()) / 16


def test_repeats_sql(docs, small_docs):
    """The SQL that the query is held against removes what brute force removes."""
    import duckdb

    from statloom.llm.substring import repeats_sql

    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", small_docs)
    assert {r[0]: tuple(r[1:]) for r in c.execute(repeats_sql()).fetchall()} == brute_repeats([(r[0], r[1] or "") for r in small_docs])


def test_repeats_in_long_texts_and_clashing_columns(spark):
    import random

    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(3)}" if i == 0 else f"v{rng.randrange(300)}" for _ in range(150_000 if i == 0 else 400)), "x", 3, b"y") for i in range(6)] + [(6, "word " * 120_000, "x", 3, b"y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string, begins int, hashes binary")
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(spark, df).collect()}
    assert found == brute_repeats([r[:2] for r in rows])


def test_repeated_windows_odd_rows(spark, odd_docs, no_docs):
    assert remove_repeats(spark, no_docs).count() == 0
    rows = remove_repeats(spark, odd_docs).collect()
    # the text starts in document 1; in 3 and without an id it is a repeat, but for windows that start later there
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in rows) == [("1", 50, 0), ("3", 50, 50), ("3", 50, 50), ("3", 51, 50), ("None", 0, 0), ("None", 50, 50)]
