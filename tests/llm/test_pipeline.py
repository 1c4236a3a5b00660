import importlib

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(sf_dir):
    return sf_dir.replace("0.001", "0.01")


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality rules", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "best-fit packing"]


def test_each_stage(spark, folder):
    """Every stage's decisions, held against its own input."""
    from statloom.llm.common import Scratch

    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = scratch.save(P.quality_rules(spark, docs, folder))
    assert kept.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    good = [i for i, q in labels.items() if q == 1 and len((before[i]["text"] or "").split()) >= 30]
    assert sum(i in ids for i in good) >= 0.97 * len(good) and all(kept.where("doc_id = 0").first()[c] == before[0][c] for c in columns if 0 in ids)

    single = scratch.save(P.near_duplicates(spark, kept, folder))
    from tests.llm.test_dedup import brute

    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = brute(rows, 5)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (n, root) in groups.items() if n == 0 or i == root}

    clean = scratch.save(P.secret_scans(spark, single, folder))
    was = {r["doc_id"]: r["text"] for r in single.collect()}
    now = {r["doc_id"]: r for r in clean.collect()}
    assert now.keys() == was.keys()
    changed = [i for i in now if now[i]["text"] != was[i]]
    from pyspark.sql import functions as F

    from statloom.llm import secrets

    cuts: dict = {}
    for r in secrets.scan(single, secrets.train(secrets.labelled(spark)), ["doc_id"], path=F.col("source")).where("secret").collect():
        cuts.setdefault(r["doc_id"], []).append((r["start"], len(r["value"])))
    for i, text in was.items():
        for start, n in sorted(cuts.get(i, []), reverse=True):
            text = text[:start] + "[SECRET]" + text[start + n :]
        assert now[i]["text"] == text
    assert changed and all("[SECRET]" in now[i]["text"] and now[i]["n_chars"] == len(now[i]["text"]) for i in changed)
    assert not any('token = "' in now[i]["text"] and "[SECRET]" not in now[i]["text"] for i in now)

    mixed = scratch.save(P.mix_sources(spark, clean, folder))
    assert mixed.columns == columns
    from statloom.llm.mixing import mix

    copies = {r["doc_id"]: r["copies"] for r in mix(spark, clean).collect()}
    seen: dict = {}
    for r in mixed.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {i: n for i, n in copies.items() if n}

    pieces = P.pack(spark, mixed, folder).collect()
    assert {r["rid"] for r in pieces}.__len__() == mixed.count()
    from tokenizers import Tokenizer

    from statloom.llm.queries import tokenizer_file

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    lengths = {i: len(t.encode(now[i]["text"] or "", add_special_tokens=False).ids) + 1 for i in seen}
    packed: dict = {}
    for r in pieces:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == {i: n * lengths[i] for i, n in seen.items()}
    size: dict = {}
    for r in pieces:
        size[r["sequence_id"]] = size.get(r["sequence_id"], 0) + r["length"]
    assert max(size.values()) <= 1024 and len(size) <= 1.02 * sum(size.values()) / 1024 + 2


def test_odd_columns(spark, folder, tmp_path):
    """Columns that clash with the operators' names pass through; nulls and empty tables do no harm."""
    rows = [(1, "the and of " * 5 + " ".join(f"u{i}" for i in range(60)), "en", "src0", 10, 1, "a", 2, "b"), (2, None, None, None, None, None, None, None, None), (None, " ".join(f"z{i}" for i in range(30)), "en", "src1", 3, 4, "c", 5, "d")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid int, n_words string, label int, row string"
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.limit(0)):
        table.write.parquet(str(tmp_path / f"t{table.count()}"))
        now = spark.read.parquet(str(tmp_path / f"t{table.count()}"))
        for n, (name, stage) in enumerate(P.STAGES):
            now = stage(spark, now, folder)
            if n < 4:
                assert now.columns == docs.columns, name
            now.write.parquet(str(tmp_path / f"t{table.count()}-{n}"))
            now = spark.read.parquet(str(tmp_path / f"t{table.count()}-{n}"))
        assert now.count() == 0 or table.count()


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
