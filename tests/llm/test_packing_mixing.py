import zlib

import duckdb
import numpy as np
import pytest

from statloom.llm.mixing import mix, mix_sql, targets
from statloom.llm.packing import Capacities, best_fit, pack
from statloom.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


def test_pieces_and_sequences(spark, docs, small_docs, tokenizer):
    rows = pack(spark, docs, tokenizer_file("byte_bpe_50k.json"), with_ids=True).collect()
    texts = {r[0]: r[1] or "" for r in small_docs}
    own, sequences = {}, {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert own.keys() == texts.keys()
    for i, pieces in own.items():
        pieces.sort(key=lambda r: r["piece"])
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2]
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [x for r in pieces for x in r["ids"]] == ids
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        assert all(r["length"] == 1024 for r in pieces[1:]) and all(0 < r["length"] <= 1024 for r in pieces)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in pieces)
    total = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        total += at
    # no two pieces beyond a half share a sequence, so this is a bound from below
    assert len(sequences) <= max(-(-total // 1024), sum(r["length"] > 512 for r in rows)) + 3


def test_ids_are_the_files_own(spark, tokenizer):
    """Special tokens' strings, long texts without spaces, columns named as the operator's own."""
    path = tokenizer_file("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y<|endoftext|>", "<|endoftext", " <|endoftext|>\n\n", "word " * 60_000, "ab1-" * 50_000, "漢字" * 20_000 + "<|endoftext|>", "\xa0 a\u2003b  c"]
    df = spark.createDataFrame([(i, t, 7, 7, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece int, length long, sequence_id long, rid string")
    for special in (False, True):
        tokenizer.encode_special_tokens = special
        own = {}
        for r in sorted(pack(spark, df, path, with_ids=True, special_as_text=special).collect(), key=lambda r: r["piece"]):
            own.setdefault(r["doc_id"], []).extend(r["ids"])
        assert own == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    tokenizer.encode_special_tokens = False


def test_capacities():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 600, 2000)
    for score in ("norm", "dot"):
        caps = Capacities(1024, 4, 500_000, (1.0, 0.1, 0.1), score)
        sequence, offset = best_fit(lengths, caps)
        for s in np.unique(sequence):
            own = np.flatnonzero(sequence == s)
            assert lengths[own].sum() <= 1024 and len(own) <= 4 and (lengths[own].astype(float) ** 2).sum() <= 500_000
            o = own[np.argsort(offset[own])]
            assert (offset[o] == np.r_[0, np.cumsum(lengths[o])[:-1]]).all()
    with pytest.raises(ValueError):
        best_fit(np.array([2000]), Capacities())
    assert len(best_fit(np.zeros(0, np.int64), Capacities())[0]) == 0


def test_best_fit_is_tight():
    lengths = np.random.default_rng(2).integers(1, 1025, 20_000)
    sequence, _ = best_fit(lengths, Capacities())
    assert sequence.max() + 1 <= 1.01 * lengths.sum() / 1024 + 1


def test_pack_odd_rows(spark, odd_docs, no_docs, tokenizer):
    path = tokenizer_file("byte_bpe_50k.json")
    assert pack(spark, no_docs, path).count() == 0
    rows = pack(spark, odd_docs, path).collect()
    texts = [r["text"] or "" for r in odd_docs.collect()]
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == sorted((str(r["doc_id"]), len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for r, t in zip(odd_docs.collect(), texts, strict=True))
    assert len({r["rid"] for r in rows}) == 6


def test_mix_equals_sorting(spark, docs, small_docs):
    found = {r["doc_id"]: r.asDict() for r in mix(spark, docs).drop("copies").collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", small_docs)
    frame = c.execute(mix_sql())
    names = [d[0] for d in frame.description]
    wanted = {r[0]: dict(zip(names, r, strict=True)) for r in frame.fetchall()}
    assert found.keys() == wanted.keys()
    for i in found:
        assert {k: v for k, v in found[i].items() if k != "target"} == {k: v for k, v in wanted[i].items() if k != "target"}
        assert abs(found[i]["target"] - wanted[i]["target"]) < 1e-6


def test_mix_targets(spark, docs):
    rows = mix(spark, docs).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6
    for (size, target), own in by.items():
        assert target <= 2 * size + 1e-9
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, mix(spark, docs.repartition(3)).collect()))


def reshared(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """Targets step by step: share out by weight, stop sources at their limit, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, budget = {}, list(order), share * sum(sizes.values())
    while left:
        total = sum(weight[s] for s in left)
        above = [s for s in left if budget * weight[s] / total > most * sizes[s]]
        if not above:
            return target | {s: budget * weight[s] / total for s in left}
        for s in above:
            target[s] = most * sizes[s]
            budget -= target[s]
            left.remove(s)
    return target


def test_targets_are_reshared_excess(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.choice([0, 3, 50, 1000, 40_000], 9))} | {None: int(rng.integers(1, 500))}
        found = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()
        wanted = reshared(sizes)
        assert {r["source"]: r["target"] for r in found} == pytest.approx(wanted)


def test_mix_nested(spark, docs):
    """A larger share takes at least as much of every document."""
    small = {r["doc_id"]: r["taken"] for r in mix(spark, docs, share=0.3).collect()}
    large = {r["doc_id"]: r["taken"] for r in mix(spark, docs, share=0.6).collect()}
    assert all(small[i] <= large[i] for i in small)


def test_mix_odd_rows(spark, odd_docs, no_docs):
    assert mix(spark, no_docs).count() == 0
    rows = mix(spark, odd_docs).collect()
    sizes = {"a": 100, "b": 101, None: 50}
    wanted = reshared(sizes)
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in rows) == sorted([("None", 50, 50), ("None", 0, 100), ("3", 50, 100), ("3", 50, 100), ("3", 51, 101), ("1", 50, 101)])
    assert {r["source_size"]: r["target"] for r in rows} == pytest.approx({sizes[s]: t for s, t in wanted.items()})
    assert len({r["taken"] for r in rows if r["doc_id"] == 3 and r["size"] == 50}) == 1  # rows of one id and source go together


def test_mix_long_text_and_clashing_columns(spark):
    rows = [(i, "w " * (200_000 if i == 0 else 10 + i), "a" if i % 2 else "b", 5, 6, "x", 7) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, hash int, target string, upto int")
    found = {r["doc_id"]: r for r in mix(spark, df).collect()}
    assert {i: r["size"] for i, r in found.items()} == {r[0]: r[1].count("w") for r in rows}
    kept = mix(spark, df, keep=df.columns).collect()
    assert all(r["row"].asDict() == df.where(f"doc_id = {r['doc_id']}").first().asDict() for r in kept[:3])
