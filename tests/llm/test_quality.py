import numpy as np
import pytest

from statloom.llm import langid, rules, weaklabel


def brute_stats(text):
    w = (text or "").encode().split()
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p for v in at.values() if len(v) > 1 for s in v for p in range(s, s + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, docs, small_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found, learned = rules.judge(spark, docs, labels)
    assert learned.rules == ()
    rows = {r["doc_id"]: r for r in found.collect()}
    for i, text, _ in small_docs:
        r = rows[i]
        wanted = brute_stats(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == wanted, i
        assert r["base_failed"] == (wanted[0] < 10 or 100 * wanted[4] > 20 * wanted[0])
        assert r["kept"] == (not r["base_failed"])


def test_covering_finds_rules():
    rng = np.random.default_rng(0)
    x = {k: rng.random(6000) for k in ("a", "b", "c")}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["c"] > 0.95)
    learned = rules.learn(x, bad)
    hit = np.zeros(6000, bool)
    for r in learned.rules:
        hit |= r.holds(x)
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()
    assert rules.learn({"a": np.zeros(0)}, np.zeros(0, bool)).rules == ()
    assert rules.learn(x, np.zeros(6000, bool)).rules == ()


def test_list_is_one_conditional(spark, sf_dir):
    """The Spark expression and the learned rules agree; held-out labels too, mostly."""
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found, learned = rules.judge(spark, docs, labels)
    rows = found.select("rule", *(rules.feature(k).alias(f"f_{k}") for k in rules.FEATURES)).toPandas()
    first = np.full(len(rows), -1)
    x = {k: rows[f"f_{k}"].to_numpy() for k in rules.FEATURES}
    for i, r in reversed(list(enumerate(learned.rules))):
        first[r.holds(x)] = i
    assert (rows["rule"].fillna(-1).astype(int).to_numpy() == first).all()
    good = found.join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert good.where("not kept").count() <= 0.01 * good.count()


def test_rules_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 0, 0), (None, 1, 0), (9, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert rules.judge(spark, no_docs, labels)[0].count() == 0
    assert rules.judge(spark, odd_docs, labels)[0].count() == 6


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(4)
    n, right = 20_000, [0.95, 0.85, 0.75, 0.9]
    y = rng.random(n) < 0.7
    votes = np.stack([np.where(rng.random(n) < 0.2, -1, np.where(rng.random(n) < a, y, ~y)) for a in right], axis=1).astype(int)
    table, counts = np.unique(votes, axis=0, return_counts=True)
    model = weaklabel.estimate(table, counts.astype(float))
    assert np.abs(model.accuracy - right).max() < 0.03 and abs(model.share - 0.7) < 0.03
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.93


def test_classifier(spark, sf_dir, odd_docs, no_docs):
    folder = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = weaklabel.classify(spark, docs)
    assert found.count() == docs.count()
    rows = found.join(labels, "doc_id").select("quality", "kept").collect()
    good, bad = [r["kept"] for r in rows if r["quality"]], [r["kept"] for r in rows if not r["quality"]]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5
    assert weaklabel.classify(spark, no_docs).count() == 0
    assert weaklabel.classify(spark, odd_docs).count() == 6


def test_languages(spark, sf_dir, no_docs):
    folder = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and n_chars > 60")
    model = langid.train(train)
    rows = held.select("text", "lang").collect()
    right = [model.langs[int(np.argmax(model.log_likelihood(r["text"].encode())))] == r["lang"] for r in rows]
    assert np.mean(right) > 0.95
    assert langid.train(no_docs).langs == []
    empty = langid.identify(spark, spark.createDataFrame([(1, "http://a.b/", "<p>x")], "page_id long, url string, html string"), langid.train(no_docs)).collect()
    assert [r["lang"] for r in empty] == [None]


def test_fused_evidence(spark, sf_dir):
    """Without text the declaration decides; without that, the host's other pages."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    model = langid.train(docs)
    texts = {r["lang"]: r["text"] for r in docs.where("n_chars > 500").orderBy("doc_id").collect()}
    pages = [(i, f"https://host{k}.example.{k}/p{i}", f"<html lang='{k}'><p>{texts[k]}</p>") for k in ("de", "fr", "en") for i in range(8)]
    pages += [(100, "https://host.fr.example.fr/", "<html lang='fr'><body></body></html>"), (101, "https://hostde.example.de/x", "<html><script>the and of</script></html>"), (102, None, None), (103, "nonsense", f"<p>{texts['es']}</p>"), (103, "nonsense", f"<p>{texts['es']}</p>"), (None, "https://hosten.example.en/", "&eacute;")]
    found = langid.identify(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()
    lang = {r["page_id"]: r["lang"] for r in found}
    assert len(found) == len(pages)
    assert lang[100] == "fr" and lang[101] == "de" and lang[103] == "es" and lang[102] is not None
    assert all(0 < r["posterior"] <= 1 for r in found)
    assert langid.identify(spark, spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_pages_are_saved_in_few_files(spark, sf_dir, monkeypatch):
    """Whatever their partitions, with the same result."""
    from statloom.llm import langid

    written = []
    plain = langid.Scratch.save
    monkeypatch.setattr(langid.Scratch, "save", lambda self, df, *a, **b: written.append(len((out := plain(self, df, *a, **b)).inputFiles())) or out)
    pages, model = spark.read.parquet(f"{sf_dir}/pages.parquet"), langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    one, many = ({r["page_id"]: (r["text_lang"], r["lang"]) for r in langid.identify(spark, p, model).collect()} for p in (pages.coalesce(1), pages.repartition(60)))
    assert one == many and max(written) <= 16


def test_page_text():
    assert langid.page_text(b"<!-- a --><style>b{}</style>c &amp; <b>d</b><script>e</script>").split() == [b"c", b"&", b"d"]


def test_page_text_is_linear_and_equals_the_pattern():
    """The same text as one pattern over the whole page; a page of unclosed tags takes no longer than its length allows."""
    import re
    import time

    hidden = re.compile(rb"<!--.*?-->|<(script|style|nav|aside|footer)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
    rng = np.random.default_rng(6)
    parts = [b"<", b">", b"<!--", b"-->", b"<script", b"<SCRIPT>", b"</script >", b"<nav x>", b"</nav>", b"<p>", b"a b ", b"<scripted>", b"</style>", b"<style>", b"\n", b"<b"]
    for _ in range(3000):
        page = b"".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 25)))
        assert langid.page_text(page) == hidden.sub(b" ", page), page
    began = time.perf_counter()
    for part in (b"<script>", b"<!--", b"<", b"<nav "):
        langid.page_text(part * 200_000)
    assert time.perf_counter() - began < 20


def brute_fusion(pages, model, temper=langid.TEMPER):
    """The same fusion page by page."""
    import re

    own = []
    for _, url, html in pages:
        logs = model.log_likelihood(langid.page_text((html or "").encode())) * temper
        p = np.exp(logs - logs.max())
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        said = re.search(r"(?is)<html\b[^>]*?\slang\s*=\s*['\"]?([A-Za-z]{2,3})", html or "")
        host = host.group(1).lower() if host else None
        own.append((host, host.rsplit(".", 1)[-1] if host else None, said.group(1).lower() if said else None, logs, p / p.sum()))
    total, n = sum(o[4] for o in own), len(model.langs)

    def others(k, i):
        return [o[4] for j, o in enumerate(own) if j != i and o[k] == own[i][k]]

    out = []
    for i, (_, _, said, logs, p) in enumerate(own):
        top = (total + 1) / (total.sum() + n)
        suffix = (sum(others(1, i), np.zeros(n)) + langid.SUFFIX_PAGES * top) / (len(others(1, i)) + langid.SUFFIX_PAGES)
        host = (sum(others(0, i), np.zeros(n)) + langid.HOST_PAGES * suffix) / (len(others(0, i)) + langid.HOST_PAGES)
        match = np.array([langid.DECLARED_PAGES if said == k else langid.DECLARED_PAGES / 10 for k in model.langs])
        evidence = logs + np.log(host) + (0 if said is None else np.log((sum(others(2, i), np.zeros(n)) + match) / (total + 2 * langid.DECLARED_PAGES)))
        out.append((model.langs[int(evidence.argmax())], float(1 / np.exp(evidence - evidence.max()).sum())))
    return out


def test_fusion_equals_brute_force(spark, sf_dir):
    """Columns named as the operator's own, odd addresses and a long page among them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(120).collect()]
    rows += [(1000, None, None), (1001, "nonsense", ""), (1002, "http://u@Long.Example.org:8/x", "<html lang=EN><p>" + "the and of " * 60_000)]
    df = spark.createDataFrame([(*r, "x", 1.0, [2.0]) for r in rows], "page_id long, url string, html string, host string, declared double, shares array<double>")
    found = {r["page_id"]: r for r in langid.identify(spark, df, model).collect()}
    for (i, *_), (lang, posterior) in zip(rows, brute_fusion(rows, model), strict=True):
        assert found[i]["posterior"] == pytest.approx(posterior, abs=2e-5)
        assert found[i]["lang"] == lang or posterior < 0.5001


def test_scores_equal_brute_force(spark, docs, small_docs):
    """Votes by pattern, expectation-maximisation and scores, document by document; every document is in the sample. The fixture has clashing columns and a long text."""
    import xxhash

    rows = [*((i, t) for i, t, _ in small_docs), (500, "lorem ipsum. " * 40_000)]
    df = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], "doc_id long, text string, pattern string, score double, weak int")
    found = {r["doc_id"]: r for r in weaklabel.classify(spark, df, most=10**6).collect()}
    stats = rules.text_stats(df.select("doc_id", "text")).select("doc_id", *(v.alias(k) for k, v in weaklabel.labellers().items())).collect()
    letters = {r["doc_id"]: "".join("-bg"[v + 1] for v in tuple(r)[1:]) for r in stats}
    assert {i: r["pattern"] for i, r in found.items()} == letters
    patterns = sorted(set(letters.values()))
    table = np.array([[{"-": -1, "b": 0, "g": 1}[c] for c in p] for p in patterns])
    counts = np.array([list(letters.values()).count(p) for p in patterns], float)
    # EM over single documents is EM over patterns
    each = np.array([table[patterns.index(letters[i])] for i, _ in rows])
    one, many = weaklabel.estimate(each, np.ones(len(each))), weaklabel.estimate(table, counts)
    assert one.share == pytest.approx(many.share, abs=1e-9) and np.allclose(one.p, many.p, atol=1e-9)
    weak = dict(zip(patterns, many.posterior(table), strict=True))
    assert all(r["weak"] == pytest.approx(weak[r["pattern"]], abs=1e-6) for r in found.values())

    def features(text):
        sums: dict = {}
        for w in (text or "").encode().split():
            shape = b"~" + weaklabel._RUN.sub(rb"\1\1", w.translate(weaklabel._SHAPE))
            for b in (xxhash.xxh3_64_intdigest(w) % weaklabel.BUCKETS, xxhash.xxh3_64_intdigest(shape) % weaklabel.BUCKETS):
                sums[b] = sums.get(b, 0) + 1
        at = np.array(sorted(sums), np.int32)
        v = np.array([sums[b] for b in at], float)
        return at, (v / np.sqrt(max(1, (v**2).sum()))).astype(np.float32)

    sample = sorted(((i, *features(t)) for i, t in rows), key=lambda x: (x[0], x[1].tobytes()))
    w, b = weaklabel.logistic([(a, v) for _, a, v in sample], np.array([weak[letters[i]] for i, *_ in sample]))
    for i, a, v in sample:
        assert found[i]["score"] == pytest.approx(1 / (1 + np.exp(-(float(w[a] @ v) + b))), abs=1e-4)
        assert found[i]["kept"] == ((weak[letters[i]] + found[i]["score"]) / 2 >= 0.5) or abs(weak[letters[i]] + found[i]["score"] - 1) < 1e-4


def test_statistics_are_computed_once(spark, docs, odd_docs, no_docs):
    """Scoring doesn't count the words again; a pattern finds its row even without an id or with one of several texts."""
    assert weaklabel.classify(spark, docs)._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    odd = odd_docs.select("doc_id", "text").unionAll(spark.createDataFrame([(None, "z " * 70), (0, "z " * 70), (0, "%"), (None, "%"), (0, None), (0, "")], "doc_id long, text string"))
    letters = weaklabel.F.concat(*(weaklabel.F.element_at(weaklabel.F.array(*map(weaklabel.F.lit, "-bg")), v + 2) for v in weaklabel.labellers().values()))
    wanted = rules.text_stats(odd).select("doc_id", letters.alias("pattern")).collect()
    found = weaklabel.classify(spark, odd)
    assert found.columns == weaklabel.classify(spark, no_docs).columns
    assert sorted(map(str, found.select("doc_id", "pattern").collect())) == sorted(map(str, wanted)) and len(wanted) == 12


def test_samples_of_any_size_are_bounded(spark):
    """Hash shares are exact far below one in a million."""
    from statloom.llm.common import hash_share

    df = spark.range(1_000_000)
    assert df.where(hash_share(1.0, "id")).count() == 1_000_000
    assert abs(df.where(hash_share(0.01, "id")).count() - 10_000) < 500
    assert df.where(hash_share(1e-12, "id")).count() == 0
    assert abs(df.where(hash_share(2e-6, "id")).count() - 2) <= 6


def test_long_text_statistics_and_clashing_columns(spark):
    text = "word, " * 150_000 + "\n" + "a b c d e f g\n" * 3
    df = spark.createDataFrame([(1, text, "x", 2, 3), (2, "one two", "x", 2, 3)], "doc_id long, text string, n_words string, kept int, rule int")
    labels = spark.createDataFrame([(1, 0, "z")], "doc_id long, quality int, n_words string")
    rows = {r["doc_id"]: r for r in rules.judge(spark, df, labels)[0].collect()}
    assert tuple(rows[1][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_stats(text)


def test_features_never_null(spark):
    df = spark.createDataFrame([(0,) * len(rules.COUNTS)], ", ".join(f"{c} long" for c in rules.COUNTS))
    row = df.select(*(rules.feature(k).alias(k) for k in rules.FEATURES), *(v.alias(f"v_{k}") for k, v in weaklabel.labellers().items())).first()
    assert None not in tuple(row)
