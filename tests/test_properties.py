"""Invariants, error cases and the special functions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.errors import DeserializationError, IncompatibleFormatVersion, InsufficientData, InvalidInput, ModelTypeMismatch, SingularMatrix
from statloom.functions import describe as D
from statloom.functions import special as S
from statloom.operators import diagnostics as X
from statloom.operators import importance as I
from statloom.operators import linear as L
from statloom.operators import loess as LO
from statloom.operators import penalized as P
from statloom.operators import validation as V
from statloom.plans.moments import Moments, moments
from statloom.sources import models, tables


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4)) * [1, 5, 0.1, 20] + [0, 100, 3, -50]
    y = 4 + x @ [2, -0.3, 7, 0.05] + rng.normal(size=400)
    rows = [(i, *map(float, r), float(v), float(w)) for i, (r, v, w) in enumerate(zip(x, y, rng.random(400) + 0.1, strict=True))]
    return spark.createDataFrame(rows, "i long, a double, b double, c double, d double, y double, w double").repartition(4)


NAMES = ["a", "b", "c", "d"]


def arrays(df, names=NAMES):
    rows = df.orderBy("i").collect()
    return np.array([[r[c] for c in names] for r in rows]), np.array([r["y"] for r in rows])


def test_ols_against_numpy(noise):
    x, y = arrays(noise)
    design = np.column_stack([np.ones(len(y)), x])
    b = np.linalg.lstsq(design, y, rcond=None)[0]
    fit = L.ols(noise, "y", NAMES)
    assert fit.coefficients == pytest.approx(list(b), rel=1e-8)
    rows = fit.rows().orderBy("i").collect()
    assert abs(sum(r["resid"] for r in rows)) < 1e-8 and sum(r["leverage"] for r in rows) == pytest.approx(5, rel=1e-9)
    assert 0 <= fit.r_squared <= 1
    h = np.diag(design @ np.linalg.inv(design.T @ design) @ design.T)
    assert [r["leverage"] for r in rows] == pytest.approx(list(h), rel=1e-6)
    assert L.wls(noise.withColumn("one", F.lit(1.0)), "y", NAMES, "one").coefficients == pytest.approx(list(b), rel=1e-8)
    assert L.polynomial(noise, "y", "a", 1).fit.coefficients == pytest.approx(L.ols(noise, "y", ["a"]).coefficients, rel=1e-9)


def test_wls_against_numpy(noise):
    x, y = arrays(noise)
    w = np.array([r["w"] for r in noise.orderBy("i").collect()])
    design = np.column_stack([np.ones(len(y)), x])
    b = np.linalg.solve(design.T @ (design * w[:, None]), design.T @ (w * y))
    assert L.wls(noise, "y", NAMES, "w").coefficients == pytest.approx(list(b), rel=1e-7)
    e = y - design @ b
    se = np.sqrt((w @ e**2) / (len(y) - 5) * np.diag(np.linalg.inv(design.T @ (design * w[:, None]))))
    assert [r["std_error"] for r in L.wls(noise, "y", NAMES, "w", rss="weighted").inference()] == pytest.approx(list(se), rel=1e-7)
    with pytest.raises(InvalidInput):
        L.wls(noise.withColumn("w", F.lit(-1.0)), "y", NAMES, "w")
    with pytest.raises(InvalidInput):
        L.wls(noise.withColumn("w", F.lit(0.0)), "y", NAMES, "w")


def test_wide_path_agrees(noise):
    own = {c: F.col(c) for c in [*NAMES, "y"]}
    a, b = moments(noise, own), L.wide_moments(noise, own)
    assert a.mean == pytest.approx(b.mean, rel=1e-9) and np.allclose(a.s, b.s, rtol=1e-8, atol=1e-8)


def test_collinear_columns(noise):
    both = noise.withColumn("e", 2 * F.col("a") + F.col("b"))
    fit = L.ols(both, "y", ["a", "b", "e"])
    assert [math.isnan(v) for v in fit.coefficients] == [False, False, False, True]
    assert fit.coefficients[:3] == pytest.approx(L.ols(noise, "y", ["a", "b"]).coefficients, rel=1e-7)
    with pytest.raises(SingularMatrix):
        X.cooks_distance(both, "y", ["a", "b", "e"])
    assert math.isfinite(X.breusch_pagan(both, "y", ["a", "b", "e"])["statistic"])
    assert all(math.isinf(r["vif"]) for r in X.vif(both, ["a", "b", "e"]).collect())


def test_errors(spark, noise):
    with pytest.raises(InvalidInput):
        L.ols(noise.withColumn("a", F.when(F.col("i") == 3, None).otherwise(F.col("a"))), "y", ["a"])
    with pytest.raises(InvalidInput):
        L.ols(noise.withColumn("a", F.when(F.col("i") == 3, float("inf")).otherwise(F.col("a"))), "y", ["a"])
    with pytest.raises(InsufficientData):
        L.ols(noise.limit(3), "y", ["a", "b"])
    with pytest.raises(InvalidInput):
        X.durbin_watson(noise.withColumn("k", F.lit(1)), "y", ["a"], "k")
    with pytest.raises(InvalidInput):
        P.elastic_net(noise, "y", ["a"], -1.0)
    with pytest.raises(InvalidInput):
        P.elastic_net(noise, "y", ["a"], 1.0, 1.5)
    with pytest.raises(InvalidInput):
        L.ols(noise, "y", ["a"]).intervals(noise, 1.0)
    with pytest.raises(InvalidInput):
        LO.loess(noise, "y", ["a"], "i", 0.0)
    with pytest.raises(InvalidInput):
        X.reset(noise, "y", ["a"], [1])


def test_penalised_optimality(noise):
    """Karush-Kuhn-Tucker conditions of the scaled problem; limits at no penalty."""
    own = {c: F.col(c) for c in [*NAMES, "y"]}
    s = P.scale(moments(noise, own), NAMES, "y")
    for alpha in (1.0, 0.5, 0.1):
        lam = 0.05
        b, _, ok = P.coordinate_descent(s.q, s.c, lam, alpha)
        g = s.c - s.q @ b - lam * (1 - alpha) * b
        assert ok and all(abs(v - lam * alpha * np.sign(w)) < 1e-7 if w else abs(v) <= lam * alpha + 1e-7 for v, w in zip(g, b, strict=True))
    plain = L.ols(noise, "y", NAMES).coefficients
    assert P.ridge(noise, "y", NAMES, 0.0).coefficients == pytest.approx(plain, rel=1e-7)
    assert P.lasso(noise, "y", NAMES, 0.0).coefficients == pytest.approx(plain, rel=1e-5)
    assert P.elastic_net(noise, "y", NAMES, 0.7, 0.0).coefficients == pytest.approx(P.ridge(noise, "y", NAMES, 0.7).coefficients, rel=1e-6)
    used = [P.lasso(noise, "y", NAMES, v).nonzero for v in (0.0, 0.1, 0.5, 2.0, 100.0)]
    assert used == sorted(used, reverse=True) and used[-1] == 0
    bounded = P.elastic_net(noise, "y", NAMES, 0.01, bounds={"a": (0.0, 1.0)}, penalty_factor={"b": math.inf})
    assert 0 <= bounded.slopes[0] <= 1 + 1e-12 and bounded.slopes[1] == 0
    path = P.elastic_net_path(noise, "y", NAMES, 1.0, count=10).collect()
    assert all(r["coefficient"] == 0 for r in path if r["step"] == 0 and r["term"] != "intercept")
    assert P.ridge(noise.withColumn("a", F.lit(1.0)), "y", NAMES, 1.0).slopes[0] == 0


def test_penalised_weights_and_origin(noise):
    """Without a penalty: weighted least squares, and least squares through the origin."""
    x, y = arrays(noise)
    w = np.array([r["w"] for r in noise.orderBy("i").collect()])
    assert P.lasso(noise, "y", NAMES, 0.0, weight="w", tol=1e-12).coefficients == pytest.approx(L.wls(noise, "y", NAMES, "w").coefficients, rel=1e-4)
    assert w.sum() > 0
    origin = np.linalg.lstsq(x, y, rcond=None)[0]
    found = P.lasso(noise, "y", NAMES, 0.0, intercept=False, tol=1e-12).coefficients
    assert found[0] == 0 and found[1:] == pytest.approx(list(origin), rel=1e-3, abs=1e-5)


def test_cross_validation(noise):
    x, y = arrays(noise)
    folds, terms = V.cross_validate(noise, "y", NAMES, "i", 5)
    for r in folds.collect():
        test = np.arange(400) // 80 == r["fold"] - 1
        design = np.column_stack([np.ones(400), x])
        b = np.linalg.lstsq(design[~test], y[~test], rcond=None)[0]
        e = y[test] - design[test] @ b
        assert r["mse"] == pytest.approx((e**2).mean(), rel=1e-7) and r["test_size"] == 80 and r["train_size"] == 320
        t = y[~test]
        assert r["train_r_squared"] == pytest.approx(1 - ((t - design[~test] @ b) ** 2).sum() / ((t - t.mean()) ** 2).sum(), rel=1e-7)
    assert V.summarize(folds).first()["n_samples"] == 400
    assert V.most_stable(terms).count() == 1
    assert sorted(V.fisher_yates(50)) == list(range(50)) and V.fisher_yates(50) != list(range(50)) and V.fisher_yates(50) == V.fisher_yates(50)
    # few rows fall into the folds of the sequential generator's order
    order = V.fisher_yates(400, 7)
    folds = {r["i"]: r["fold"] for r in V.with_folds(noise, "i", 5, True, 7).collect()}
    assert folds == {i: 1 + place // 80 for place, i in enumerate(order)}
    assert {r["fold"]: r["count"] for r in V.with_folds(noise, "i", 5, True, 7, sequential=0).groupBy("fold").count().collect()} == dict.fromkeys(range(1, 6), 80)
    sizes = [r["count"] for r in V.with_folds(noise, "i", 7).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [58] + [57] * 6
    with pytest.raises(InvalidInput):
        V.cross_validate(noise, "y", NAMES, "i", 1)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_many_rows_fall_into_sequential_folds(spark, monkeypatch, broadcast):
    monkeypatch.setattr(V, "BROADCAST_ROWS", broadcast, raising=False)
    n = 70_001
    found = {r["id"]: r["fold"] for r in V.with_folds(spark.range(n), "id", 7, True, 7).collect()}
    sizes = [n // 7 + (f < n % 7) for f in range(7)]
    assert len(found) == n and [found[i] for i in V.fisher_yates(n, 7)] == [f + 1 for f, size in enumerate(sizes) for _ in range(size)]


def test_importance(noise):
    fit = L.ols(noise, "y", NAMES)
    shap = I.shap_values(fit).collect()
    yhat = {r["i"]: r["yhat"] for r in fit.rows().collect()}
    for r in shap[:20]:
        assert sum(r[f"shap_{c}"] for c in NAMES) + r["expected_value"] == pytest.approx(yhat[r["i"]], rel=1e-9)
    found = {r["variable"]: r["importance"] for r in I.permutation_importance(fit, "i", 5).collect()}
    assert found["a"] > found["c"] > -0.01
    again = {r["variable"]: r["importance"] for r in I.permutation_importance(fit, "i", 5).collect()}
    assert found == pytest.approx(again, rel=1e-9)
    assert sorted(I.Lcg(42).shuffle(30)) == list(range(30))
    # the stream's shuffles, refitted one by one
    x, y = arrays(noise, NAMES)
    rng, tss = I.Lcg(42), ((y - y.mean()) ** 2).sum()

    def rss(own):
        design = np.column_stack([np.ones(len(y)), own])
        return ((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2).sum()

    for j, name in enumerate(NAMES):
        losses = []
        for _ in range(5):
            own = x.copy()
            own[:, j] = own[rng.shuffle(len(y)), j]
            losses.append((rss(own) - rss(x)) / tss)
        assert found[name] == pytest.approx(np.mean(losses), abs=1e-9)
    many = {r["variable"]: r["importance"] for r in I.permutation_importance(fit, "i", 20, sequential=0).collect()}
    assert all(abs(many[k] - found[k]) < 0.15 * max(abs(found[k]), 0.02) for k in found)
    ranks = [r["vif"] for r in I.vif_ranking(noise, NAMES).orderBy("rank").collect()]
    assert ranks == sorted(ranks)


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_many_rows_are_permuted_by_the_stream(spark, monkeypatch, limit):
    """All shuffles of a stream that tasks enter in the middle, held against one that runs through."""
    monkeypatch.setattr(I, "BROADCAST_BYTES", limit, raising=False)
    n = 5003
    rows = spark.range(n).selectExpr("id", "pmod(xxhash64(id), 1000) / 1000 AS a", "pmod(xxhash64(id, 7), 1000) / 1000 + id / 5003 AS b").selectExpr("*", "2 * a + b + pmod(xxhash64(id, 9), 1000) / 500 AS y")
    found = {r["variable"]: r for r in I.permutation_importance(L.ols(rows, "y", ["a", "b"]), "id", 3).collect()}
    table = np.array([[r["a"], r["b"], r["y"]] for r in rows.orderBy("id").collect()], float)
    x, y, rng = table[:, :2], table[:, 2], I.Lcg(42)

    def rss(own):
        design = np.column_stack([np.ones(n), own])
        return ((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2).sum()

    for j, name in enumerate("ab"):
        losses = []
        for _ in range(3):
            own = x.copy()
            own[:, j] = own[rng.shuffle(n), j]
            losses.append((rss(own) - rss(x)) / ((y - y.mean()) ** 2).sum())
        assert found[name]["importance"] == pytest.approx(np.mean(losses), abs=1e-9)
        assert found[name]["std_error"] == pytest.approx(np.std(losses, ddof=1) / 3**0.5, abs=1e-9)


def test_all_importance_of_many_rows_has_the_stream(spark):
    """Its permutation column is the stream's beyond few rows too; the other columns don't depend on the shuffles."""
    n = 5003
    rows = spark.range(n).selectExpr("id", "id / 5003 AS a", "CAST(id % 7 AS DOUBLE) AS b").selectExpr("*", "a + b / 10 + pmod(xxhash64(id, 9), 1000) / 5000 AS y")
    found = {r["variable"]: r["importance"] for r in I.all_importance(L.ols(rows, "y", ["a", "b"]), "id", 3).collect()}
    table = np.array([[r["a"], r["b"], r["y"]] for r in rows.orderBy("id").collect()], float)
    y, rng = table[:, 2], I.Lcg(42)

    def r2(own):
        design = np.column_stack([np.ones(n), own])
        return 1 - ((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    for j, name in enumerate("ab"):
        losses = []
        for _ in range(3):
            own = table[:, :2].copy()
            own[:, j] = own[rng.shuffle(n), j]
            losses.append(r2(table[:, :2]) - r2(own))
        assert found[name] == pytest.approx(np.mean(losses), abs=1e-9)


def test_mean_abs_shap_of_large_keys_is_exact(spark):
    """Of a predictor as large as shifted keys the sixth decimal is the rounding error of a plain sum; the sums here have none, in any order and partitions."""
    rows = spark.range(6000).selectExpr("id", "CAST(id % 1000 + 1000000 * (id DIV 1000) AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b").selectExpr("*", "100 * a + b + pmod(xxhash64(id, 9), 1000) / 100 AS y")
    for own in (rows.coalesce(1), rows.repartition(5), rows.coalesce(1).sort("b", "id")):
        fit = L.ols(own, "y", ["a", "b"])
        found = {r["variable"]: r["mean_abs_shap"] for r in I.mean_abs_shap(fit).collect()}
        for j, c in enumerate("ab"):
            mean = float(fit.moments.pick([c]).mean[0])
            wanted = abs(fit.coefficients[j + 1]) * (math.fsum(abs(r[c] - mean) for r in rows.collect()) / 6000)
            assert found[c] == pytest.approx(wanted, rel=5e-16)


def test_influence_by_refits(noise):
    small = noise.where("i < 60")
    x, y = arrays(small, ["a", "b"])
    design = np.column_stack([np.ones(60), x])
    b = np.linalg.lstsq(design, y, rcond=None)[0]
    mse = ((y - design @ b) ** 2).sum() / 57
    cook = {r["i"]: r["cooks_d"] for r in X.cooks_distance(small, "y", ["a", "b"])[0].collect()}
    betas = {r["i"]: r["dfbetas"] for r in X.dfbetas(small, "y", ["a", "b"])[0].collect()}
    c = np.linalg.inv(design.T @ design)
    for i in (0, 17, 59):
        rest = np.arange(60) != i
        other = np.linalg.lstsq(design[rest], y[rest], rcond=None)[0]
        s = math.sqrt(((y[rest] - design[rest] @ other) ** 2).sum() / 56)
        assert cook[i] == pytest.approx(((design @ (b - other)) ** 2).sum() / 3 / mse, rel=1e-6)
        assert betas[i] == pytest.approx(list((b - other) / (s * np.sqrt(np.diag(c)))), rel=1e-5)


def test_recursive_residuals_agree(noise):
    """The window sums for one predictor are the updates for any number of them."""
    x, y = arrays(noise, ["a"])
    w = X.recursive_residuals(y, np.column_stack([np.ones(400), x]))[2:]
    t = abs(w.sum() / w.std(ddof=1) / math.sqrt(len(w)))
    assert X.harvey_collier(noise, "y", ["a"], "i")["statistic"] == pytest.approx(t, rel=1e-7)
    assert (w @ w) == pytest.approx(L.ols(noise, "y", ["a"]).rss, rel=1e-8)
    assert math.isfinite(X.harvey_collier(noise, "y", ["a", "b"], "i")["p_value"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=2), min_size=4, max_size=30), st.integers(1, 3))
def test_moments_merge(rows, at):
    def of(part):
        a = np.array(part, float)
        d = a - a.mean(axis=0)
        return Moments(["a", "b"], float(len(a)), a.mean(axis=0), d.T @ d, len(a))

    one, two = of(rows[:at]).merge(of(rows[at:])), of(rows)
    assert one.n == two.n and np.allclose(one.mean, two.mean) and np.allclose(one.s, two.s, atol=1e-6 * (1 + np.abs(two.s).max()))


@settings(max_examples=200, deadline=None)
@given(st.floats(0.001, 0.999), st.floats(0.2, 60), st.floats(0.2, 60))
def test_special_identities(p, a, b):
    assert S.inc_beta(p, a, b) == pytest.approx(1 - S.inc_beta(1 - p, b, a), abs=1e-10)
    assert S.normal_cdf_exact(S.normal_inverse_cdf(p)) == pytest.approx(p, abs=1e-12)
    assert S.normal_cdf(S.normal_inverse_cdf(p)) == pytest.approx(p, abs=2e-7)
    assert S.student_t_cdf(S.student_t_inverse_cdf(p, a), a) == pytest.approx(p, abs=1e-9)
    x = 10 * p * a
    assert S.chi_squared_survival(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-9)
    assert S.inc_gamma_upper(a + 1, x) == pytest.approx(S.inc_gamma_upper(a, x) + math.exp(a * math.log(x) - x - math.lgamma(a + 1)), abs=1e-10)
    assert S.f_survival(x, 2, b) == pytest.approx((1 + 2 * x / b) ** (-b / 2), rel=1e-7, abs=1e-300)
    assert S.erf(p) + S.erfc(p) == pytest.approx(1) and S.erfce(30 + p) == pytest.approx(1 / ((30 + p) * math.sqrt(math.pi)), rel=1e-3)


def test_special_edges():
    assert math.isnan(S.inc_beta(1.5, 1, 1)) and math.isnan(S.student_t_cdf(math.inf, 3)) and S.normal_inverse_cdf(0) == -math.inf and S.normal_inverse_cdf(1) == math.inf
    assert S.ln_gamma(-2) == math.inf and S.fisher_snedecor_cdf(-1, 2, 3) == 0 and S.chi_squared_survival(-1, 2) == 1 and S.two_tailed_p_value(101, 3) == 0
    assert S.student_t_inverse_cdf(0.995, 1) == pytest.approx(63.65674, rel=1e-5)
    assert X.shapiro_wilk_sample(np.array([1.0, 2.0, 4.0]))[0] == pytest.approx(0.9642857, abs=1e-6)


def test_describe_edges(spark):
    one = spark.createDataFrame([(1.0,)], "v double").agg(D.variance("v").alias("a"), D.stddev_population("v").alias("b"), D.median("v").alias("c")).first()
    assert math.isnan(one["a"]) and one["b"] == 0 and one["c"] == 1
    none = spark.createDataFrame([], "v double").agg(D.mean("v").alias("a"), D.total("v").alias("b"), D.minimum("v").alias("c"), D.quantile("v", 2.0).alias("d")).first()
    assert math.isnan(none["a"]) and none["b"] == 0 and math.isnan(none["c"])
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (3.0,), (1.0,), (None,)], "v double")
    assert odd.agg(D.maximum("v").alias("a")).first()["a"] == 3
    assert tuple(D.mode(odd, "v").first()) == ([1.0, 3.0], 2, 2)


def test_order_statistics(spark, monkeypatch):
    """Ranks selected by rounds of brackets, with ties, NaN, infinities and values of all magnitudes."""
    rng = np.random.default_rng(3)
    tables_ = [rng.normal(size=5000), np.repeat([1.0, 2.0, 7.0], [4000, 3, 900]), np.exp(rng.uniform(-600, 600, 4000)) * rng.choice([-1, 1], 4000), np.array([5.0]), np.full(3000, 2.5), np.r_[rng.normal(size=50), [math.inf, -math.inf, 0.0, -0.0]]]
    monkeypatch.setattr(D, "SELECT", 20)
    monkeypatch.setattr(D, "ACCURACY", 50)
    for v in tables_:
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(3)
        ranks = sorted({0, len(v) // 3, len(v) // 2, len(v) - 1, *(int(r) for r in rng.integers(0, len(v), 4))})
        assert D.order_statistics(df, "v", ranks) == [np.sort(v)[r] for r in ranks]
    df = spark.createDataFrame([(float(x),) for x in tables_[0]], "v double")
    assert D.quantiles(df, "v", (0.0, 0.3, 0.77, 1.0, 2.0))[:4] == pytest.approx(list(np.quantile(tables_[0], (0.0, 0.3, 0.77, 1.0))))
    assert all(math.isnan(x) for x in D.quantiles(df.limit(0), "v", (0.0, 0.5)))
    with_nan = spark.createDataFrame([(1.0,), (float("nan"),), (0.0,)], "v double")
    assert D.order_statistics(with_nan, "v", [0, 1]) == [0.0, 1.0] and math.isnan(D.order_statistics(with_nan, "v", [2])[0])


def test_sorted_local_fits_equal_single_ones():
    """The windows of sorted points give what each point's own neighbourhood gives, ties and duplicates included."""
    from statloom.operators import loess as LO

    rng = np.random.default_rng(8)
    for values in (rng.normal(size=300), rng.integers(0, 40, 300).astype(float), np.repeat(rng.normal(size=30), 10)):
        y, robust = rng.normal(size=300) + values, rng.choice([0.0, 0.5, 1.0], 300)
        x, q = values[:, None], np.r_[values[::7], rng.normal(size=20)][:, None]
        for k in (5, 60, 300):
            for degree in (0, 1):
                for r in (None, robust):
                    assert np.allclose(LO.fit_points(q, x, y, k, degree, r), LO._fit_each(q, x, y, k, degree, r), atol=1e-9)


def test_collinear_weighted_fit(spark, noise):
    """The solution of least norm of unit-length terms predicts as the fit without the repeated predictor."""
    df = noise.withColumn("twice", 2 * F.col("a") + F.col("b"))
    plain, fit = L.wls(noise, "y", NAMES, "w"), L.wls(df, "y", [*NAMES, "twice"], "w")
    x, y = arrays(df, [*NAMES, "twice"])
    w = np.array([r["w"] for r in df.orderBy("i").collect()])
    design = np.column_stack([np.ones(len(y)), x]) * np.sqrt(w)[:, None]
    scales = np.linalg.norm(design, axis=0)
    b = np.linalg.lstsq(design / scales, y * np.sqrt(w), rcond=1e-10)[0] / scales
    assert fit.coefficients == pytest.approx(list(b), rel=1e-5, abs=1e-7)
    assert fit.r_squared == pytest.approx(plain.r_squared, rel=1e-8) and all(math.isfinite(r["std_error"]) for r in fit.inference())


def test_both_variants_and_guidance(noise):
    found = X.both(X.white, noise, "y", NAMES)
    assert found["r"]["statistic"] == X.white(noise, "y", NAMES, "R")["statistic"] and found["python"]["statistic"] == X.white(noise, "y", NAMES, "Python")["statistic"]
    assert found["passed"] == (found["r"]["passed"] and found["python"]["passed"]) and found["r"]["guidance"]


def test_csv(spark, tmp_path):
    text = "a, b ,name\n1, 2.5,x\n 3,nan,y\n4,5\n6,7,z,w\n8,inf,\"q, r\"\n"
    t = tables.parse_csv(spark, text)
    assert t.headers == ["a", "b", "name"] and t.numeric_columns == ["a", "b"] and t.n_rows == 3 and t.n_cols == 3
    assert [tuple(r) for r in t.numbers().collect()] == [(1.0, 2.5, "x"), (3.0, None, "y"), (8.0, None, "q, r")]
    (tmp_path / "t.csv").write_text(text)
    u = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, u.data.collect())) == sorted(map(tuple, t.data.collect())) and u.numeric_columns == ["a", "b"]
    coded = tables.category_codes(t.data, "name").collect()
    assert sorted(r["name"] for r in coded) == [1.0, 2.0, 3.0]


def test_models(spark, noise, tmp_path):
    fits = [L.ols(noise, "y", NAMES), L.wls(noise, "y", NAMES, "w"), P.ridge(noise, "y", NAMES), P.lasso(noise, "y", NAMES, 0.1), P.elastic_net(noise, "y", NAMES, 0.1, 0.5)]
    for i, fit in enumerate(fits):
        models.save(spark, fit, str(tmp_path / f"m{i}"), "mine")
        m = models.load(spark, str(tmp_path / f"m{i}"), fit.kind.lower())
        assert m["metadata"]["name"] == "mine" and m["data"]["coefficients"] == pytest.approx(fit.coefficients)
        got = models.predict(m, noise).orderBy("i").limit(5).collect()
        assert [r["yhat"] for r in got] == pytest.approx([r["yhat"] for r in fit.predict(noise).orderBy("i").limit(5).collect()])
    _, loess = LO.loess(noise.where("i < 50"), "y", ["a"], "i")
    assert models.deserialize(models.serialize(loess), "LOESS")["data"]["span"] == 0.75
    text = models.serialize(fits[0])
    with pytest.raises(ModelTypeMismatch):
        models.deserialize(text, "Lasso")
    with pytest.raises(IncompatibleFormatVersion):
        models.deserialize(text.replace('"1.0"', '"2.0"'))
    with pytest.raises(DeserializationError):
        models.deserialize("{}")
    with pytest.raises(DeserializationError):
        models.load(spark, str(tmp_path / "none"))


def test_stream(spark, sf_dir, tmp_path):
    """A stream's windows equal the table's."""
    from statloom.streaming.windowed import windowed_line

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "value", "event_id")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_line(stream, "ts", "value", "event_id", "1 day", "30 days").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {r["window_start"]: (r["n"], round(r["slope"] or 0, 9)) for r in spark.table("windows").collect()}
    wanted = {r["window_start"]: (r["n"], round(r["slope"] or 0, 9)) for r in windowed_line(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "event_id", "1 day", "1 day").collect()}
    assert found == wanted


def test_sql_functions(spark):
    assert "get_t_critical" in S.register(spark)
    row = spark.sql("SELECT get_t_critical(0.05D, 10.0D) AS a, get_normal_inverse(0.975D) AS b, normal_cdf(CAST(NULL AS DOUBLE)) AS c").first()
    assert row["a"] == pytest.approx(2.228138852) and row["b"] == pytest.approx(1.959963985) and row["c"] is None


def test_ordered_rows(noise):
    """Numbers, lags and running sums over range partitions equal those of one list."""
    from statloom.plans.ordered import number_rows

    y = [r["y"] for r in noise.orderBy("i").collect()]
    o = number_rows(noise, "i", {"y": F.col("y"), "i": F.col("i")})
    assert o.n == 400 and [r["_t"] for r in o.rows.orderBy("i").collect()] == list(range(1, 401))
    for r in o.lagged("y", 3).collect():
        assert [r["l1"], r["l2"], r["l3"]] == [y[r["_t"] - 1 - j] if r["_t"] > j else None for j in (1, 2, 3)]
    for r in o.running({"s": F.col("y")}).collect():
        assert r["s"] is None if r["_t"] == 1 else r["s"] == pytest.approx(sum(y[: r["_t"] - 1]), rel=1e-9)
    assert number_rows(noise.limit(0), "i", {"y": F.col("y")}).n == 0
