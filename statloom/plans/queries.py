"""Queries over the standard tables, one or more for each operator, and the SQL they are held against.

Both sides round to the digits on which different summation orders agree.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.functions import describe as D
from statloom.functions import special as S
from statloom.operators import diagnostics as X
from statloom.operators import importance as I
from statloom.operators import linear as L
from statloom.operators import loess as LO
from statloom.operators import penalized as P
from statloom.operators import validation as V
from statloom.plans import solve
from statloom.plans import sqltext as T
from statloom.plans.moments import moments, number

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return read(spark, sf_dir, "lineitem").select((price * (1 - discount) * (1 + F.col("l_tax"))).alias("y"), price.alias("x1"), discount.alias("x2"), F.col("l_tax").alias("x3"), F.col("l_quantity").alias("w"), "l_returnflag", "l_linestatus")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    u = (F.col("user_id") % 50).cast("double")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("t"), (F.col("value") + 0.8 * k + 0.05 * u).alias("y"), k.alias("x1"), u.alias("x2"), "value")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("t"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("t"), F.col("s_acctbal").alias("y"), F.col("s_suppkey").cast("double").alias("x"))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """The named columns, in order, each double rounded (and -0.0 made 0.0); None keeps a column as it is."""
    return df.select(*(F.col(c) if d is None else (F.round(c, d) + 0.0).alias(c) for c, d in digits.items()))


def row(spark: SparkSession, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


# ---- descriptive statistics (ST), sources (IO) and row operators (PR)

_PRICE = "l_extendedprice"


@query(f"SELECT round(avg({_PRICE}), 4) AS mean, round(var_samp({_PRICE}), 0) AS variance, round(stddev_samp({_PRICE}), 3) AS stddev, round(var_pop({_PRICE}), 0) AS variance_population, round(stddev_pop({_PRICE}), 3) AS stddev_population, round(sum({_PRICE}), 1) AS total FROM lineitem")
def st_1_2_3_6_mean_variance_sum(spark, sf_dir):
    c = F.col(_PRICE)
    return read(spark, sf_dir, "lineitem").agg(F.round(D.mean(c), 4).alias("mean"), F.round(D.variance(c), 0).alias("variance"), F.round(D.stddev(c), 3).alias("stddev"), F.round(D.variance_population(c), 0).alias("variance_population"), F.round(D.stddev_population(c), 3).alias("stddev_population"), F.round(D.total(c), 1).alias("total"))


@query(f"SELECT round(median({_PRICE}), 6) AS median, round(quantile_cont({_PRICE}, 0.1), 6) AS q10, round(quantile_cont({_PRICE}, 0.93), 6) AS q93 FROM lineitem")
def st_4_5_median_quantile(spark, sf_dir):
    c = F.col(_PRICE)
    return read(spark, sf_dir, "lineitem").agg(F.round(D.median(c), 6).alias("median"), F.round(D.quantile(c, 0.1), 6).alias("q10"), F.round(D.quantile(c, 0.93), 6).alias("q93"))


@query(f"SELECT round(median({_PRICE}), 6) AS median, round(quantile_cont({_PRICE}, 0.1), 6) AS q10, round(quantile_cont({_PRICE}, 0.93), 6) AS q93 FROM lineitem")
def st_4_5_selected_quantiles(spark, sf_dir):
    """By rank selection, for tables of any size."""
    return row(spark, **{k: round(v, 6) for k, v in zip(("median", "q10", "q93"), D.quantiles(read(spark, sf_dir, "lineitem"), _PRICE, (0.5, 0.1, 0.93)), strict=True)})


@query(f"SELECT min({_PRICE}) AS lowest, max({_PRICE}) AS highest, round(max({_PRICE}) - min({_PRICE}), 6) AS width FROM lineitem")
def st_7_min_max_range(spark, sf_dir):
    c = F.col(_PRICE)
    return read(spark, sf_dir, "lineitem").agg(D.minimum(c).alias("lowest"), D.maximum(c).alias("highest"), F.round(D.value_range(c), 6).alias("width"))


@query("WITH c AS (SELECT CAST(p_size AS DOUBLE) AS v, count(*) AS n FROM part GROUP BY 1) SELECT v AS mode, n AS frequency, (SELECT count(*) FROM c) AS unique_count FROM c WHERE n = (SELECT max(n) FROM c)")
def st_8_mode(spark, sf_dir):
    return D.modes(read(spark, sf_dir, "part"), "p_size")


@query(f"SELECT min({_PRICE}) AS min, round(quantile_cont({_PRICE}, 0.25), 6) AS q1, round(median({_PRICE}), 6) AS median, round(quantile_cont({_PRICE}, 0.75), 6) AS q3, max({_PRICE}) AS max, round(quantile_cont({_PRICE}, 0.75) - quantile_cont({_PRICE}, 0.25), 5) AS iqr FROM lineitem")
def st_9_five_numbers(spark, sf_dir):
    return rounded(D.five_number_summary(read(spark, sf_dir, "lineitem"), _PRICE), min=None, q1=6, median=6, q3=6, max=None, iqr=5)


@query("SELECT round(corr(l_extendedprice, l_extendedprice*(1-l_discount)), 9) AS strong, round(corr(l_quantity, l_tax), 9) AS weak FROM lineitem")
def st_10_correlation(spark, sf_dir):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return read(spark, sf_dir, "lineitem").agg(F.round(D.correlation(price, price * (1 - discount)), 9).alias("strong"), F.round(D.correlation("l_quantity", "l_tax"), 9).alias("weak"))


@query("WITH q AS (SELECT quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b FROM events) SELECT event_id, value FROM events, q WHERE value < a - 1.5*(b-a) OR value > b + 1.5*(b-a)")
def pr_12_outliers(spark, sf_dir):
    return D.outliers(read(spark, sf_dir, "events"), "value").select("event_id", "value")


@query("SELECT 'l_discount' AS \"column\", round(avg(l_discount), 9) AS mean, round(stddev_samp(l_discount), 9) AS stddev, round(median(l_discount), 9) AS median FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 9), round(stddev_samp(l_tax), 9), round(median(l_tax), 9) FROM lineitem")
def st_describe(spark, sf_dir):
    return rounded(D.describe(read(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"]), column=None, mean=9, stddev=9, median=9)


@query("SELECT s_suppkey AS key, s_acctbal AS balance, 's_acctbal,s_nationkey,s_suppkey' AS numeric_columns FROM supplier")
def io_1_2_parse_csv(spark, sf_dir):
    """The suppliers as CSV text, parsed."""
    from statloom.sources.tables import parse_csv

    rows = read(spark, sf_dir, "supplier").collect()
    names = list(rows[0].asDict()) if rows else []
    text = ",".join(names) + "\n" + "\n".join(",".join(f" {v} " for v in r) for r in rows) + "\nragged,row\n"
    found = parse_csv(spark, text)
    return found.numbers().select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_acctbal").alias("balance"), F.lit(",".join(found.numeric_columns)).alias("numeric_columns"))


@query("SELECT c_custkey AS key, c_acctbal AS balance FROM customer")
def io_1_2_read_csv(spark, sf_dir):
    """The customers as a folder of CSV files, read by all tasks."""
    from statloom.plans.ordered import folder
    from statloom.sources.tables import read_csv

    path = folder(spark, "csv")
    read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path, header=True)
    return read_csv(spark, path).numbers().select(F.col("c_custkey").cast("long").alias("key"), F.col("c_acctbal").alias("balance"))


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 1 ELSE 0 END) AS BIGINT) AS bad, round(avg(value), 6) AS mean FROM events")
def pr_1_validation(spark, sf_dir):
    from statloom.plans.moments import unfit

    v = F.col("value")
    return read(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(unfit(v)).alias("bad"), F.round(F.avg(v), 6).alias("mean"))


@query(f"WITH src AS ({T.PARTS}), c AS (SELECT avg(x) AS m FROM src) SELECT t, round(x - m, 6) AS x_centered, round((x-m)*(x-m), 6) AS x2, round((x-m)*(x-m)*(x-m), 5) AS x3 FROM src, c")
def pr_5_polynomial_features(spark, sf_dir):
    p = parts(spark, sf_dir)
    centre = p.agg(F.avg("x")).first()[0]
    a, b, c = L.features(F.col("x"), 3, centre)
    return p.select("t", (F.round(a, 6) + 0.0).alias("x_centered"), (F.round(b, 6) + 0.0).alias("x2"), (F.round(c, 5) + 0.0).alias("x3"))


@query(f"WITH src AS ({T.PARTS}), c AS (SELECT min(x) AS a, max(x) AS b FROM src) SELECT t, round((x-a)/(b-a), 9) AS scaled FROM src, c")
def pr_10_min_max_normalize(spark, sf_dir):
    p = parts(spark, sf_dir)
    a, b = p.agg(F.min("x"), F.max("x")).first()
    return p.select("t", F.round((F.col("x") - a) / (b - a) if b > a else F.lit(0.5), 9).alias("scaled"))


@query("SELECT event_id, round(CASE WHEN value - 50 > 20 THEN value - 70 WHEN value - 50 < -20 THEN value - 30 ELSE 0.0 END, 6) + 0.0 AS shrunk FROM events")
def pr_11_soft_threshold(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", (F.round(P.soft_threshold_col(F.col("value") - 50, 20.0), 6) + 0.0).alias("shrunk"))


# ---- least squares (RG)


def lines_fit(spark, sf_dir) -> L.LinearFit:
    return L.ols(lines(spark, sf_dir), "y", ["x1", "x2"])


def events_fit(spark, sf_dir) -> L.LinearFit:
    return L.ols(events(spark, sf_dir), "y", ["x1", "x2"])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_fit(spark, sf_dir).terms()


_I00, _I01, _I02 = T.INVERSE
_LINES2 = f"WITH src AS ({T.LINES}), {T.FIT2}"
_EVENTS2 = f"WITH src AS ({T.EVENTS}), {T.FIT2}"
_EVENTS1 = f"WITH src AS ({T.EVENTS}), {T.FIT1}"


def _terms_sql(start: str, digits: int) -> str:
    one = "SELECT '{t}' AS term, round({b}, {d}) AS coefficient, round(sqrt(rss/df*{i}), {d}) AS std_error, round({b}/sqrt(rss/df*{i}), 3) AS t_stat FROM g"
    return start + " " + " UNION ALL ".join(one.format(t=t, b=b, i=i, d=digits) for t, b, i in (("intercept", "b0", _I00), ("x1", "b1", "i11"), ("x2", "b2", "i22")))


@query(_terms_sql(_LINES2, 5))
def rg_1_ols_terms(spark, sf_dir):
    return rounded(lines_fit(spark, sf_dir).terms(), term=None, coefficient=5, std_error=5, t_stat=3)


@query(_LINES2 + " SELECT n, round(1-rss/tss, 9) AS r_squared, round(1-(rss/tss)*(n-1)/df, 9) AS adj_r_squared, round((tss-rss)/2/(rss/df)/1e6, 4) AS f_millions, round(power(1+2*((tss-rss)/2/(rss/df))/df, -df/2), 9) AS f_p_value, round(sqrt(rss/df), 4) AS std_error, round((SELECT avg(abs(e)) FROM r), 4) AS mae, round(-n/2*ln(2*pi()*rss/n)-n/2, 2) AS log_likelihood, round(8 + n*ln(2*pi()*rss/n)+n, 2) AS aic, round(4*ln(n) + n*ln(2*pi()*rss/n)+n, 2) AS bic, round(6 + n*ln(2*pi()*rss/n)+n, 2) AS aic_plain, round(3*ln(n) + n*ln(2*pi()*rss/n)+n, 2) AS bic_plain FROM g")
def rg_1_3_4_5_ols_summary(spark, sf_dir):
    s = lines_fit(spark, sf_dir).summary().withColumn("f_millions", F.col("f_statistic") / 1e6)
    return rounded(s, n=None, r_squared=9, adj_r_squared=9, f_millions=4, f_p_value=9, std_error=4, mae=4, log_likelihood=2, aic=2, bic=2, aic_plain=2, bic_plain=2)


@query(_EVENTS2 + " SELECT t, round(yhat, 6) AS yhat, round(e, 6) + 0.0 AS resid, round(h, 9) AS leverage, round(e/sqrt(rss/df*(1-h)), 6) + 0.0 AS std_resid FROM r")
def rg_1_2_pr_3_ols_rows(spark, sf_dir):
    return rounded(events_fit(spark, sf_dir).rows(), t=None, yhat=6, resid=6, leverage=9, std_resid=6)


@query("WITH src AS (SELECT l_extendedprice AS x1, l_extendedprice*(1-l_discount) AS x2, l_tax AS x3 FROM lineitem), c AS (SELECT corr(x1,x2) a, corr(x1,x3) b, corr(x2,x3) c FROM src), d AS (SELECT *, 1+2*a*b*c-a*a-b*b-c*c AS det FROM c) SELECT 'x1' AS variable, round((1-c*c)/det, 5) AS vif FROM d UNION ALL SELECT 'x2', round((1-b*b)/det, 5) FROM d UNION ALL SELECT 'x3', round((1-a*a)/det, 5) FROM d")
def rg_6_dx_11_vif(spark, sf_dir):
    price = F.col("x1")
    found = X.vif(lines(spark, sf_dir), ["x1", "x2", "x3"], {"x2": price * (1 - F.col("x2"))})
    return rounded(found, variable=None, vif=5)


_WLS = """, m AS (SELECT sum(w) sw, sum(w*x1)/sum(w) m1, sum(w*x2)/sum(w) m2, sum(w*y)/sum(w) my, CAST(count(*) AS DOUBLE) n FROM src),
s AS (SELECT sum(w*(x1-m1)*(x1-m1)) s11, sum(w*(x2-m2)*(x2-m2)) s22, sum(w*(x1-m1)*(x2-m2)) s12, sum(w*(x1-m1)*(y-my)) s1y, sum(w*(x2-m2)*(y-my)) s2y FROM src, m),
b AS (SELECT *, s11*s22-s12*s12 AS det, (s1y*s22-s2y*s12)/(s11*s22-s12*s12) AS b1, (s2y*s11-s1y*s12)/(s11*s22-s12*s12) AS b2 FROM s, m),
e AS (SELECT sum((y-(my-b1*m1-b2*m2)-b1*x1-b2*x2)*(y-(my-b1*m1-b2*m2)-b1*x1-b2*x2)) AS rss FROM src, b)"""


@query(f"WITH src AS ({T.LINES}){_WLS} SELECT 'intercept' AS term, round(my-b1*m1-b2*m2, 5) AS coefficient, round(sqrt(rss/(n-3)*(1/sw + (m1*m1*s22 - 2*m1*m2*s12 + m2*m2*s11)/det)), 5) AS std_error FROM b, e UNION ALL SELECT 'x1', round(b1, 5), round(sqrt(rss/(n-3)*s22/det), 5) FROM b, e UNION ALL SELECT 'x2', round(b2, 5), round(sqrt(rss/(n-3)*s11/det), 5) FROM b, e")
def rg_7_wls_terms(spark, sf_dir):
    return rounded(L.wls(lines(spark, sf_dir), "y", ["x1", "x2"], "w").terms(), term=None, coefficient=5, std_error=5)


@query(f"WITH src AS ({T.LINES}){_WLS}, t AS (SELECT var_pop(y)*count(*) AS tss FROM src) SELECT n, round(1-rss/tss, 9) AS r_squared, round(sqrt(rss/(n-3)), 4) AS std_error FROM b, e, t")
def rg_7_wls_summary(spark, sf_dir):
    return rounded(L.wls(lines(spark, sf_dir), "y", ["x1", "x2"], "w").summary(), n=None, r_squared=9, std_error=4)


_POLY = f"WITH src AS (SELECT t, y, x AS x1, x*x AS x2 FROM ({T.PARTS}) AS p), {T.FIT2}"


@query(_terms_sql(_POLY, 7).replace("'x1' AS", "'x' AS").replace("'x2' AS", "'x^2' AS"))
def rg_10_polynomial_terms(spark, sf_dir):
    return rounded(L.polynomial(parts(spark, sf_dir), "y", "x", 2).fit.terms(), term=None, coefficient=7, std_error=7, t_stat=3)


@query(_POLY + " SELECT t, round(b0 + b1*(x1+1) + b2*(x1+1)*(x1+1), 5) AS yhat FROM r")
def rg_11_polynomial_predict(spark, sf_dir):
    p = parts(spark, sf_dir)
    fit = L.polynomial(p, "y", "x", 2, center=True, standardize=True)
    return rounded(fit.predict(p.withColumn("x", F.col("x") + 1), "x"), t=None, yhat=5)


@query(f"WITH src AS ({T.LINES}), g AS (SELECT l_returnflag, l_linestatus, regr_slope(y, x1) b, regr_intercept(y, x1) a, regr_r2(y, x1) r2, count(*) n FROM src GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, 'intercept' AS term, round(a, 5) AS coefficient, round(r2, 9) AS r_squared, n FROM g UNION ALL SELECT l_returnflag, l_linestatus, 'x1', round(b, 5), round(r2, 9), n FROM g")
def rg_1_grouped_ols(spark, sf_dir):
    return rounded(L.grouped_ols(lines(spark, sf_dir), ["l_returnflag", "l_linestatus"], "y", ["x1"]), l_returnflag=None, l_linestatus=None, term=None, coefficient=5, r_squared=9, n=None)


@query(f"WITH src AS (SELECT *, sin(t/10.0) AS s FROM ({T.EVENTS}) AS q), {T.fwl('src', 'y', ['x1', 'x2', 's'])} SELECT round(rss, 2) AS rss, round(1 - rss/tss, 9) AS r_squared FROM z")
def rg_13_14_15_three_predictors(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("s", F.sin(F.col("t") / 10.0))
    fit = L.ols(e, "y", ["x1", "x2", "s"])
    return row(spark, rss=round(fit.rss, 2), r_squared=round(fit.r_squared, 9))


_WIDE = f"WITH RECURSIVE x AS (SELECT vec_id, unnest(generate_series(0, 63)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT k, avg(v) AS m, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY k), c AS (SELECT vec_id, CASE WHEN x.k = 0 THEN 64 ELSE x.k END AS k, v - m AS v FROM x JOIN m ON x.k = m.k), a AS (SELECT 0 AS g, p.k AS i, q.k AS j, sum(p.v*q.v) AS v FROM c AS p JOIN c AS q ON p.vec_id = q.vec_id GROUP BY 2, 3), {T.sweep('a', 63)}, f AS (SELECT v/(n - 64) AS mse, n, m AS my FROM sw, m WHERE i = 64 AND j = 64 AND k = 0)"


@query(_WIDE + " SELECT 'e' || i AS term, round(v, 6) + 0.0 AS coefficient, round(sqrt(mse*(SELECT v FROM sw AS d WHERE d.i = sw.i AND d.j = sw.i)), 6) AS std_error FROM sw, f WHERE j = 64 AND i < 64 UNION ALL SELECT 'intercept', round(my - (SELECT sum(v*m) FROM sw JOIN m ON i = k WHERE j = 64 AND i < 64), 6) + 0.0, round(sqrt(mse*(1/n + (SELECT sum(v*p.m*q.m) FROM sw JOIN m AS p ON i = p.k JOIN m AS q ON j = q.k WHERE i < 64 AND j < 64))), 6) FROM f")
def la_3_6_wide_qr(spark, sf_dir):
    """Sixty-three predictors by the tree of QR factorisations."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)))
    return rounded(L.ols(e, "e0", [f"e{i}" for i in range(1, 64)]).terms(), term=None, coefficient=6, std_error=6)


@query(_terms_sql(_LINES2, 5).replace("SELECT 'intercept' AS term", "SELECT 'dup' AS term, CAST(NULL AS DOUBLE) AS coefficient, CAST(NULL AS DOUBLE) AS std_error, CAST(NULL AS DOUBLE) AS t_stat FROM g UNION ALL SELECT 'intercept' AS term"))
def la_6_7_rank_deficient_ols(spark, sf_dir):
    """A predictor that earlier ones determine is dropped."""
    df = lines(spark, sf_dir).withColumn("dup", F.col("x1") - 2 * F.col("x2"))
    t = rounded(L.ols(df, "y", ["x1", "x2", "dup"]).terms(), term=None, coefficient=5, std_error=5, t_stat=3)
    return t.select("term", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("coefficient", "std_error", "t_stat")))


_LEAST = f"WITH src AS ({T.LINES}){_WLS}, l AS (SELECT sqrt(sw) AS l0, sqrt((SELECT sum(w*x1*x1) FROM src)) AS l1, sqrt((SELECT sum(w*x2*x2) FROM src)) AS l2, sqrt((SELECT sum(w*(x1/1e4+x2)*(x1/1e4+x2)) FROM src)) AS l3, my-b1*m1-b2*m2 AS b0, b1, b2 FROM b), z AS (SELECT *, (b1*l1*l1/1e4 + b2*l2*l2)/(l1*l1/1e8 + l2*l2 + l3*l3) AS f FROM l)"


@query(_LEAST + " SELECT 'intercept' AS term, round(b0, 4) AS coefficient FROM z UNION ALL SELECT 'x1', round(b1 - f/1e4, 6) FROM z UNION ALL SELECT 'x2', round(b2 - f, 3) FROM z UNION ALL SELECT 'both', round(f, 3) FROM z")
def rg_7_8_la_8_9_collinear_wls(spark, sf_dir):
    """The solution of least norm, terms scaled to unit length."""
    df = lines(spark, sf_dir).withColumn("both", F.col("x1") / 1e4 + F.col("x2"))
    t = L.wls(df, "y", ["x1", "x2", "both"], "w").terms()
    digits = F.when(F.col("term") == "intercept", F.round("coefficient", 4)).when(F.col("term") == "x1", F.round("coefficient", 6)).otherwise(F.round("coefficient", 3))
    return t.select("term", digits.alias("coefficient"))


# ---- diagnostics (DX)

_RESET = f"WITH src AS ({T.EVENTS}), {T.FIT1}, " + T.fwl("r", "y", ["x1"], "a") + ", " + T.fwl("r", "y", ["x1", "(x1-49.5)*(x1-49.5)", "(x1-49.5)*(x1-49.5)*(x1-49.5)"], "b")


@query(_RESET + " SELECT round(greatest((b.n-4)/2*(a.rss-b.rss)/b.rss, 0), 6) AS statistic, round(power(1+2*greatest((b.n-4)/2*(a.rss-b.rss)/b.rss, 0)/(b.n-4), -(b.n-4)/2), 6) AS p_value FROM a, b")
def dx_3_reset(spark, sf_dir):
    return rounded(X.frame(events(spark, sf_dir), X.reset(events(spark, sf_dir), "y", ["x1"], (2, 3))), statistic=6, p_value=6)


_RESET2 = f"WITH src AS ({T.EVENTS}), {T.FIT2}, " + T.fwl("r", "y", ["x1", "x2"], "a") + ", "
_RESET_F = " SELECT round(greatest((b.n-{t})/{q}*(a.rss-b.rss)/b.rss, 0), 5) AS statistic FROM a, b"


@query(_RESET2 + T.fwl("r", "y", ["x1", "x2", "(x1-49.5)*(x1-49.5)", "(x2-24.5)*(x2-24.5)", "(x1-49.5)*(x1-49.5)*(x1-49.5)", "(x2-24.5)*(x2-24.5)*(x2-24.5)"], "b") + _RESET_F.format(t=7, q=4))
def dx_3_reset_regressor(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.reset(e, "y", ["x1", "x2"], (2, 3), "regressor")), statistic=5)


# the first principal axis of two predictors in closed form, without a sign since the square alone is added
_AXIS = ", ax AS (SELECT *, 0.5*atan2(2*s12, s11 - s22) AS turn FROM m), sc AS (SELECT r.*, power(cos(turn)*x1 + sin(turn)*x2, 2)/1000 AS p2 FROM r, ax), "


@query(f"WITH src AS ({T.EVENTS}), {T.FIT2}{_AXIS}" + T.fwl("sc", "y", ["x1", "x2"], "a") + ", " + T.fwl("sc", "y", ["x1", "x2", "p2"], "b") + _RESET_F.format(t=4, q=1))
def dx_3_la_12_reset_princomp(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.reset(e, "y", ["x1", "x2"], (2,), "princomp")), statistic=5)


# X'X with the penalty on every term, the intercept too, where the third predictor repeats the first
_RIDGED = f"WITH RECURSIVE src AS ({T.EVENTS}), t AS (SELECT t, unnest([0, 1, 2, 3, 4]) AS k, unnest([1.0, x1, x2, 2*x1, y]) AS v FROM src), a AS (SELECT 0 AS g, CASE WHEN p.k = 4 THEN 5 ELSE p.k + 1 END AS i, CASE WHEN q.k = 4 THEN 5 ELSE q.k + 1 END AS j, sum(p.v*q.v) + CASE WHEN p.k = q.k AND p.k < 4 THEN 1e-4 ELSE 0 END AS v FROM t AS p JOIN t AS q ON p.t = q.t GROUP BY p.k, q.k), {T.sweep('a', 4)}, b AS (SELECT max(v) FILTER (i = 1) b0, max(v) FILTER (i = 2) b1, max(v) FILTER (i = 3) b2, max(v) FILTER (i = 4) b3 FROM sw WHERE j = 5)"


@query(_RIDGED + " SELECT t, round(b0 + b1*x1 + b2*x2 + b3*2*x1, 4) AS yhat FROM src, b")
def rg_13_ridge_fallback(spark, sf_dir):
    """Diagnostics fit collinear predictors with a small ridge."""
    e = events(spark, sf_dir).withColumn("x3", 2 * F.col("x1"))
    return X.residuals(e, "y", ["x1", "x2", "x3"], keep=["t"])[0].select("t", F.round("yhat", 4).alias("yhat"))


@query(_EVENTS2 + ", q AS (SELECT e*e AS y, x1, x2 FROM r), " + T.fwl("q", "y", ["x1", "x2"]) + " SELECT round(n*(1-rss/tss), 6) AS statistic, round(exp(-n*(1-rss/tss)/2), 6) AS p_value FROM z")
def dx_4_breusch_pagan(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.breusch_pagan(e, "y", ["x1", "x2"])), statistic=6, p_value=6)


_WHITE = _EVENTS2 + ", q AS (SELECT e*e AS v, x1, x2, (x1-m1)*(x1-m1) AS x3, (x2-m2)*(x2-m2) AS x4, (x1-m1)*(x2-m2) AS x5 FROM r), "
_WHITE_R = _WHITE + T.fwl("q", "v", ["x1", "x2", "x3", "x4"]) + " SELECT round(n*(1-rss/tss), 6) AS statistic FROM z"
_WHITE_PYTHON = _WHITE + T.fwl("q", "v", ["x1", "x2", "x3", "x4", "x5"]) + " SELECT round(n*(1-rss/tss), 6) AS statistic FROM z"


@query(_WHITE_R.replace(" AS statistic", " AS statistic, round(exp(-n*(1-rss/tss)/2)*(1+n*(1-rss/tss)/2), 6) AS p_value"))
def dx_5_white_r(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.white(e, "y", ["x1", "x2"], "R")), statistic=6, p_value=6)


@query(_WHITE_PYTHON)
def dx_5_white_python(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.white(e, "y", ["x1", "x2"], "Python")), statistic=6)


@query(_EVENTS2 + ", k AS (SELECT n, sum(e*e)/n v, sum(e*e*e)/n c3, sum(e*e*e*e)/n c4 FROM r GROUP BY n), j AS (SELECT c3/power(v,1.5) s, c4/(v*v)-3 k, n FROM k) SELECT round(n/6*(s*s+k*k/4), 4) AS statistic, round(exp(-n/12*(s*s+k*k/4)), 6) AS p_value, round(s, 7) + 0.0 AS skewness, round(k, 7) AS excess_kurtosis FROM j")
def dx_6_jarque_bera(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.jarque_bera(e, "y", ["x1", "x2"])), statistic=4, p_value=6, skewness=7, excess_kurtosis=7)


def _poly_sql(c, x: str) -> str:
    return "(" + " + ".join(f"{v!r}*power({x}, {i})" for i, v in enumerate(c)) + ")"


_SW = f"""WITH d AS (SELECT avg(l_extendedprice) AS v FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY CAST(l_shipdate AS DATE)),
o AS (SELECT v, row_number() OVER (ORDER BY v) AS i, CAST(count(*) OVER () AS DOUBLE) AS n, avg(v) OVER () AS mv FROM d),
m AS (SELECT *, {T.acklam('((i - 0.375)/(n + 0.25))')} AS m FROM o),
s AS (SELECT n, sum(m*m) AS mm, max(m) FILTER (i = n) AS mn, max(m) FILTER (i = n - 1) AS mp FROM m GROUP BY n),
w AS (SELECT *, mn/sqrt(mm) + {_poly_sql(X.SW_C1, '(1/sqrt(n))')} AS a1, mp/sqrt(mm) + {_poly_sql(X.SW_C2, '(1/sqrt(n))')} AS a2 FROM s),
p AS (SELECT *, (mm - 2*mn*mn - 2*mp*mp)/(1 - 2*a1*a1 - 2*a2*a2) AS phi FROM w),
q AS (SELECT p.n, power(sum(v*CASE WHEN i = p.n THEN a1 WHEN i = p.n - 1 THEN a2 WHEN i = 1 THEN -a1 WHEN i = 2 THEN -a2 ELSE m/sqrt(phi) END), 2)/sum((v - mv)*(v - mv)) AS w FROM m, p GROUP BY p.n),
z AS (SELECT n, w, (ln(1 - w) - {_poly_sql(X.SW_MEAN, 'ln(n)')})/exp({_poly_sql(X.SW_SD, 'ln(n)')}) AS z FROM q)
SELECT round(w, 8) AS statistic, round({T.normal_sf('z')}, 8) + 0.0 AS p_value, {T.normal_sf('z')} > 0.05 AS passed, CAST(n AS BIGINT) AS n FROM z"""


@query(_SW)
def dx_7_shapiro_wilk(spark, sf_dir):
    # mean price of each shipping day: all lines count, and the days of TPC-H's seven years are about 2500 at any scale
    d = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("t")).agg(F.avg("l_extendedprice").alias("y")).where("t is not null")
    return rounded(X.frame(d, X.shapiro_wilk(d, "y", [])), statistic=8, p_value=8, passed=None, n=None)


_AD = f"WITH src AS ({T.EVENTS}), {T.FIT2}, s AS (SELECT avg(e) m, stddev_samp(e) d, CAST(count(*) AS DOUBLE) nn FROM r), q AS (SELECT (e-m)/d AS u, nn FROM r, s), o AS (SELECT u, nn, row_number() OVER (ORDER BY u) AS i FROM q), z AS (SELECT nn, -nn - sum((2*i-1)*ln({T.normal_cdf('u')}) + (2*(nn-i)+1)*ln({T.normal_cdf('(-u)')}))/nn AS a FROM o GROUP BY nn)"


@query(_AD + " SELECT round(a, 4) AS statistic FROM z")
def dx_8_anderson_darling(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.anderson_darling(e, "y", ["x1", "x2"])), statistic=4)


@query(_EVENTS2 + ", l AS (SELECT e, lag(e) OVER (ORDER BY t) AS p FROM r) SELECT round(sum((e-p)*(e-p))/sum(e*e), 9) AS statistic, round(1-sum((e-p)*(e-p))/sum(e*e)/2, 9) + 0.0 AS autocorrelation FROM l")
def dx_9_durbin_watson(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.durbin_watson(e, "y", ["x1", "x2"], "t")), statistic=9, autocorrelation=9)


_BG = _EVENTS1 + ", l AS (SELECT e, x1, coalesce(lag(e) OVER (ORDER BY t), 0) AS l1, coalesce(lag(e, 2) OVER (ORDER BY t), 0) AS l2 FROM r), " + T.fwl("l", "e", ["x1", "l1", "l2"])


@query(_BG + " SELECT round(n*(1-rss/tss), 6) AS statistic, round(exp(-n*(1-rss/tss)/2), 6) AS p_value FROM z")
def dx_10_breusch_godfrey(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.breusch_godfrey(e, "y", ["x1"], "t", 2)), statistic=6, p_value=6)


@query(_BG + " SELECT round((tss-rss)/2/(rss/(n-4)), 6) AS statistic, round(power(1+2*((tss-rss)/2/(rss/(n-4)))/(n-4), -(n-4)/2), 6) AS p_value FROM z")
def dx_10_breusch_godfrey_f(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.breusch_godfrey(e, "y", ["x1"], "t", 2, "F")), statistic=6, p_value=6)


@query(_EVENTS2 + " SELECT t, round(e*e*h/(3*(rss/df)*(1-h)*(1-h)), 10) AS cooks_d, e*e*h/(3*(rss/df)*(1-h)*(1-h)) > 4/n AS influential FROM r")
def dx_12_pr_13_cooks_distance(spark, sf_dir):
    rows, info = X.cooks_distance(events(spark, sf_dir), "y", ["x1", "x2"])
    return rows.select("t", F.round("cooks_d", 10).alias("cooks_d"), (F.col("cooks_d") > info["threshold_4_over_n"]).alias("influential"))


_SI = "sqrt((rss - e*e/(1-h))/(df-1))"


@query(_EVENTS2 + f" SELECT t, round(e*({_I00}+({_I01})*x1+({_I02})*x2)/((1-h)*{_SI}*sqrt({_I00})), 7) + 0.0 AS b0, round(e*(({_I01})+i11*x1+i12*x2)/((1-h)*{_SI}*sqrt(i11)), 7) + 0.0 AS b1, round(e*(({_I02})+i12*x1+i22*x2)/((1-h)*{_SI}*sqrt(i22)), 7) + 0.0 AS b2 FROM r")
def dx_13_dfbetas(spark, sf_dir):
    rows, _ = X.dfbetas(events(spark, sf_dir), "y", ["x1", "x2"])
    return rows.select("t", *((F.round(F.get("dfbetas", F.lit(i)), 7) + 0.0).alias(f"b{i}") for i in range(3)))


@query(_EVENTS2 + f", i AS (SELECT row_number() OVER (ORDER BY t) AS position, n, e*({_I00}+({_I01})*x1+({_I02})*x2)/((1-h)*{_SI}*sqrt({_I00})) AS b0, e*(({_I01})+i11*x1+i12*x2)/((1-h)*{_SI}*sqrt(i11)) AS b1, e*(({_I02})+i12*x1+i22*x2)/((1-h)*{_SI}*sqrt(i22)) AS b2 FROM r) SELECT 'intercept' AS term, position FROM i WHERE abs(b0) > 2/sqrt(n) UNION ALL SELECT 'x1', position FROM i WHERE abs(b1) > 2/sqrt(n) UNION ALL SELECT 'x2', position FROM i WHERE abs(b2) > 2/sqrt(n)")
def dx_13_influential_terms(spark, sf_dir):
    rows, info = X.dfbetas(events(spark, sf_dir), "y", ["x1", "x2"])
    return X.influential_terms(rows, ["intercept", "x1", "x2"], info["threshold"], "t")


@query(_EVENTS2 + f" SELECT t, round(e*sqrt(h)/({_SI}*(1-h)), 7) + 0.0 AS dffits, abs(e*sqrt(h)/({_SI}*(1-h))) > 2*sqrt(3/n) AS influential FROM r")
def dx_14_pr_13_dffits(spark, sf_dir):
    rows, info = X.dffits(events(spark, sf_dir), "y", ["x1", "x2"])
    return rows.select("t", (F.round("dffits", 7) + 0.0).alias("dffits"), (F.abs("dffits") > info["threshold"]).alias("influential"))


@query(_EVENTS2 + ", i AS (SELECT row_number() OVER (ORDER BY t) AS i, e*e*h/(3*(rss/df)*(1-h)*(1-h)) AS d, n FROM r) SELECT i AS position FROM i WHERE d > 4/n")
def pr_13_influential_positions(spark, sf_dir):
    rows, info = X.cooks_distance(events(spark, sf_dir), "y", ["x1", "x2"])
    return X.influential(rows, F.col("cooks_d"), info["threshold_4_over_n"], "t")


def _rainbow_sql(first: str, count: str) -> str:
    rows = f"WITH src AS ({T.EVENTS}), o AS (SELECT *, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS c FROM src), blk AS (SELECT * FROM o WHERE i >= {first} AND i < {first} + {count}), "
    return rows + T.fwl("o", "y", ["x1", "x2"], "a") + ", " + T.fwl("blk", "y", ["x1", "x2"], "b") + " SELECT round(greatest(a.rss-b.rss, 0)/(a.n-b.n)/(b.rss/(b.n-3)), 8) AS statistic FROM a, b"


_RAINBOW_R, _RAINBOW_PYTHON = _rainbow_sql("ceil(0.25*(c-1)+1)", "floor(0.5*c)"), _rainbow_sql("ceil(0.25*c)+1", "floor(ceil(0.25*c)+0.5*c)-ceil(0.25*c)")


@query(_RAINBOW_R)
def dx_1_rainbow_r(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.rainbow(e, "y", ["x1", "x2"], "t")), statistic=8)


@query(_RAINBOW_PYTHON)
def dx_1_rainbow_python(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.rainbow(e, "y", ["x1", "x2"], "t", 0.5, "Python")), statistic=8)


_HC = f"WITH src AS ({T.EVENTS}), a AS (SELECT avg(x1) ma, avg(y) mb FROM src), u AS (SELECT row_number() OVER (ORDER BY t) AS i, x1-ma AS u, y-mb AS v FROM src, a), p AS (SELECT i, u, v, CAST(i-1 AS DOUBLE) m, sum(u) OVER w sx, sum(v) OVER w sy, sum(u*u) OVER w sxx, sum(u*v) OVER w sxy FROM u WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), q AS (SELECT i, u, v, m, sx, sy, sxx-sx*sx/m AS dx, sxy-sx*sy/m AS dxy FROM p WHERE i > 2), w AS (SELECT i, (v-sy/m-dxy/dx*(u-sx/m))/sqrt(1+1/m+(u-sx/m)*(u-sx/m)/dx) AS w FROM q WHERE dx > 1e-12)"


@query(_HC + " SELECT round(abs(sum(w)/stddev_samp(w)/sqrt(count(*))), 7) AS statistic FROM w")
def dx_2_harvey_collier_r(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.harvey_collier(e, "y", ["x1"], "t")), statistic=7)


@query(_HC + " SELECT round(sum(w)/stddev_samp(w)/sqrt(count(*)), 7) + 0.0 AS statistic FROM w WHERE i > 3")
def dx_2_harvey_collier_python(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.harvey_collier(e, "y", ["x1"], "t", "Python")), statistic=7)


_HC2 = f"""WITH src AS ({T.EVENTS}), a AS (SELECT avg(x1) m1, avg(x2) m2, avg(y) my, CAST(count(*) AS DOUBLE) n FROM src),
u AS (SELECT row_number() OVER (ORDER BY t) AS i, x1-m1 AS u, x2-m2 AS v, y-my AS z, n FROM src, a),
p AS (SELECT i, u, v, z, n, CAST(i-1 AS DOUBLE) m, sum(u) OVER w su, sum(v) OVER w sv, sum(z) OVER w sz, sum(u*u) OVER w suu, sum(u*v) OVER w suv, sum(v*v) OVER w svv, sum(u*z) OVER w suz, sum(v*z) OVER w svz FROM u WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT i, n, m, u-su/m AS u, v-sv/m AS v, z-sz/m AS z, suu-su*su/m AS a, suv-su*sv/m AS b, svv-sv*sv/m AS c, suz-su*sz/m AS d, svz-sv*sz/m AS e FROM p WHERE i > 3),
w AS (SELECT n, (z - ((d*c-e*b)*u + (e*a-d*b)*v)/(a*c-b*b))/sqrt(1+1/m+(c*u*u-2*b*u*v+a*v*v)/(a*c-b*b)) AS w FROM q WHERE a*c-b*b > 1e-9),
s AS (SELECT abs(sum(w)/stddev_samp(w)/sqrt(count(*))) AS s, any_value(n) - 4 AS dof FROM w)"""


@query(_HC2 + f" SELECT round(s, 7) AS statistic, round({T.two_tailed('s', 'dof')}, 7) AS p_value FROM s")
def dx_2_harvey_collier_two_predictors(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(X.frame(e, X.harvey_collier(e, "y", ["x1", "x2"], "t")), statistic=7, p_value=7)


@query(f"SELECT 'r' AS method, * FROM ({_RAINBOW_R}) AS a UNION ALL SELECT 'python', * FROM ({_RAINBOW_PYTHON}) AS b")
def dx_1_rainbow_both(spark, sf_dir):
    e = events(spark, sf_dir)
    found = X.both(X.rainbow, e, "y", ["x1", "x2"], "t")
    return spark.createDataFrame([(k, round(found[k]["statistic"], 8)) for k in ("r", "python")], "method string, statistic double")


@query(f"SELECT 'r' AS method, * FROM ({_WHITE_R}) AS a UNION ALL SELECT 'python', * FROM ({_WHITE_PYTHON}) AS b")
def dx_5_white_both(spark, sf_dir):
    e = events(spark, sf_dir)
    found = X.both(X.white, e, "y", ["x1", "x2"])
    return spark.createDataFrame([(k, round(found[k]["statistic"], 6)) for k in ("r", "python")], "method string, statistic double")


# ---- prediction intervals (PI)


@query(_EVENTS2 + " SELECT t, round(yhat, 6) AS predicted, round(h, 9) AS leverage, round(sqrt(rss/df*(1+h)), 7) AS se_pred FROM r")
def pi_1_2_intervals(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(L.ols(e, "y", ["x1", "x2"]).intervals(e), t=None, predicted=6, leverage=9, se_pred=7)


_RIDGE1 = "b0r AS (SELECT *, (s1y/sqrt(s11*syy))/(1 + {lam}/sqrt(syy))*sqrt(syy/s11) AS rb FROM g), f AS (SELECT *, my - rb*m1 AS ra FROM b0r), k AS (SELECT src.t, src.x1, src.y, f.*, ra + rb*src.x1 AS yh, 1/n + i11*(src.x1-m1)*(src.x1-m1) AS hh FROM src, f), q AS (SELECT sum((y-yh)*(y-yh)) AS rrss FROM k)"


@query(_EVENTS1 + ", " + _RIDGE1.format(lam="2.0") + " SELECT t, round(yh, 6) AS predicted, round(sqrt(rrss/(n-1-2.0/3.0)*(1+hh)), 7) AS se_pred FROM k, q")
def pi_3_ridge_intervals(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(P.ridge(e, "y", ["x1"], 2.0).intervals(e), t=None, predicted=6, se_pred=7)


_LASSO1 = "b0r AS (SELECT *, greatest(abs(s1y/sqrt(s11*syy)) - {lam}/sqrt(syy), 0)*sign(s1y)*sqrt(syy/s11) AS rb FROM g), f AS (SELECT *, my - rb*m1 AS ra FROM b0r), k AS (SELECT src.t, src.x1, src.y, f.*, ra + rb*src.x1 AS yh, 1/n + i11*(src.x1-m1)*(src.x1-m1) AS hh FROM src, f), q AS (SELECT sum((y-yh)*(y-yh)) AS rrss FROM k)"


@query(_EVENTS1 + ", " + _LASSO1.format(lam="1.5") + " SELECT t, round(yh, 6) AS predicted, round(sqrt(rrss/(n-2)*(1+hh)), 7) AS se_pred FROM k, q")
def pi_4_lasso_intervals(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(P.lasso(e, "y", ["x1"], 1.5).intervals(e), t=None, predicted=6, se_pred=7)


@query("SELECT 'no degrees of freedom' AS reason, true AS refused")
def pi_5_no_degrees_of_freedom(spark, sf_dir):
    """As many terms as rows leave nothing for an interval."""
    from statloom.errors import InsufficientData, InvalidInput

    few = events(spark, sf_dir).orderBy("t").limit(3)
    try:
        P.ridge(few, "y", ["x1", "x2"], 0.0).intervals(few)
        refused = False
    except (InsufficientData, InvalidInput):
        refused = True
    return row(spark, reason="no degrees of freedom", refused=refused)


# ---- penalised regression (RE)


@query(_LINES2 + ", u AS (SELECT *, s12/sqrt(s11*s22) AS q, s1y/sqrt(s11*syy) AS c1, s2y/sqrt(s22*syy) AS c2, 1 + 100.0/sqrt(syy) AS a FROM g), v AS (SELECT *, (c1*a - c2*q)/(a*a-q*q)*sqrt(syy/s11) AS p1, (c2*a - c1*q)/(a*a-q*q)*sqrt(syy/s22) AS p2 FROM u) SELECT 'intercept' AS term, round(my-p1*m1-p2*m2, 4) AS coefficient FROM v UNION ALL SELECT 'x1', round(p1, 4) FROM v UNION ALL SELECT 'x2', round(p2, 4) FROM v")
def re_5_ridge_two_predictors(spark, sf_dir):
    return rounded(P.ridge(lines(spark, sf_dir), "y", ["x1", "x2"], 100.0).terms(), term=None, coefficient=4)


@query(_EVENTS1 + ", " + _LASSO1.format(lam="1.5") + " SELECT 'intercept' AS term, round(ra, 7) AS coefficient FROM f UNION ALL SELECT 'x1', round(rb, 7) FROM f")
def re_6_lasso_one_predictor(spark, sf_dir):
    return rounded(P.lasso(events(spark, sf_dir), "y", ["x1"], 1.5).terms(), term=None, coefficient=7)


@query(_EVENTS1 + ", u AS (SELECT *, greatest(abs(s1y/sqrt(s11*syy)) - 0.4*2.0/sqrt(syy), 0)*sign(s1y)/(1 + 0.6*2.0/sqrt(syy))*sqrt(syy/s11) AS rb FROM g) SELECT 'intercept' AS term, round(my-rb*m1, 7) AS coefficient FROM u UNION ALL SELECT 'x1', round(rb, 7) FROM u")
def re_1_elastic_net_one_predictor(spark, sf_dir):
    return rounded(P.elastic_net(events(spark, sf_dir), "y", ["x1"], 2.0, 0.4).terms(), term=None, coefficient=7)


@query(_EVENTS1 + ", " + _LASSO1.format(lam="1.5") + " SELECT round(1 - rrss/tss, 8) AS r_squared, round(sqrt(rrss/(n-2)), 6) AS rmse, round((SELECT avg(abs(y-yh)) FROM k), 6) AS mae FROM f, q")
def re_6_lasso_summary(spark, sf_dir):
    return rounded(P.lasso(events(spark, sf_dir), "y", ["x1"], 1.5).summary(), r_squared=8, rmse=6, mae=6)


_FOUR = ["x1", "x2", "x3", "w"]


def _net_sql(source: str, x: list[str], lam: str, alpha: float, sweeps: int = 200, digits: int = 4, intercept: bool = True, weight: str | None = None, **options) -> str:
    slopes = [f"b{i}*dy/d{i}" for i in range(1, len(x) + 1)]
    start = f"WITH RECURSIVE src AS ({source}), {T.scaled('src', x, weight=weight, intercept=intercept)}, {T.descent(len(x), lam, alpha, sweeps, **options)}"
    level = " - ".join(["my", *(f"{b}*m{i}" for i, b in enumerate(slopes, 1))]) if intercept else "0.0"
    return start + " " + " UNION ALL ".join([f"SELECT 'intercept' AS term, round({level}, {digits}) + 0.0 AS coefficient FROM cd", *(f"SELECT '{c}', round({b}, {digits}) + 0.0 FROM cd" for c, b in zip(x, slopes, strict=True))])


@query(_net_sql(T.LINES, _FOUR, "50.0", 0.5))
def re_1_2_3_elastic_net(spark, sf_dir):
    fit = P.elastic_net(lines(spark, sf_dir), "y", _FOUR, 50.0, 0.5)
    return rounded(fit.terms(), term=None, coefficient=4)


@query(_net_sql(T.LINES, _FOUR, "50.0", 0.5, factor=[0.5, 1.0, 2.0, 1.0], bounds={2: (-100.0, 100.0), 4: (0.0, 30.0)}))
def re_2_3_factors_and_bounds(spark, sf_dir):
    fit = P.elastic_net(lines(spark, sf_dir), "y", _FOUR, 50.0, 0.5, penalty_factor={"x1": 0.5, "x3": 2.0}, bounds={"x2": (-100.0, 100.0), "w": (0.0, 30.0)})
    return rounded(fit.terms(), term=None, coefficient=4)


@query(_net_sql(T.LINES, ["x1", "x2", "x3"], "20.0", 0.7, weight="w"))
def re_2_weighted_elastic_net(spark, sf_dir):
    return rounded(P.elastic_net(lines(spark, sf_dir), "y", ["x1", "x2", "x3"], 20.0, 0.7, weight="w").terms(), term=None, coefficient=4)


@query(_net_sql(T.EVENTS, ["x1", "x2"], "3.0", 0.5, 400, 6, intercept=False))
def re_2_elastic_net_through_origin(spark, sf_dir):
    return rounded(P.elastic_net(events(spark, sf_dir), "y", ["x1", "x2"], 3.0, 0.5, intercept=False).terms(), term=None, coefficient=6)


_PATH = f"WITH RECURSIVE src AS ({T.LINES}), {T.scaled('src', _FOUR, tag='one')}, sc AS (SELECT i AS g, one.* EXCLUDE (g), CASE WHEN i = 0 THEN 1e300 ELSE greatest(abs(c1), abs(c2), abs(c3), abs(c4))/0.5*dy*power(power(1e-4, 1/29.0), i) END AS lam FROM one, range(30) AS s(i)), {T.descent(4, 'lam', 0.5, 200)}, f AS (SELECT *, CAST((b1 <> 0)::INT + (b2 <> 0)::INT + (b3 <> 0)::INT + (b4 <> 0)::INT AS INT) AS nz, 2*(b1*c1 + b2*c2 + b3*c3 + b4*c4) - (b1*b1 + b2*b2 + b3*b3 + b4*b4 + 2*(b1*b2*q1_2 + b1*b3*q1_3 + b1*b4*q1_4 + b2*b3*q2_3 + b2*b4*q2_4 + b3*b4*q3_4)) AS r2 FROM cd)"


@query(_PATH + " " + " UNION ALL ".join([f"SELECT CAST(g AS INT) AS step, '{t}' AS term, round({b}, 4) + 0.0 AS coefficient, nz AS n_nonzero, round(r2, 8) + 0.0 AS r_squared FROM f" for t, b in [("intercept", "my - dy*(b1*m1/d1 + b2*m2/d2 + b3*m3/d3 + b4*m4/d4)"), *((c, f"b{i}*dy/d{i}") for i, c in enumerate(_FOUR, 1))]]))
def re_4_elastic_net_path(spark, sf_dir):
    return rounded(P.elastic_net_path(lines(spark, sf_dir), "y", ["x1", "x2", "x3", "w"], 0.5, count=30), step=None, term=None, coefficient=4, n_nonzero=None, r_squared=8)


@query(_LINES2 + " SELECT round(greatest(abs(s1y/sqrt(s11*syy)), abs(s2y/sqrt(s22*syy)))/0.5, 9) AS lambda_max FROM g")
def re_7_lambda_max(spark, sf_dir):
    m = moments(lines(spark, sf_dir), {c: F.col(c) for c in ("x1", "x2", "y")})
    return row(spark, lambda_max=round(P.lambda_max(P.scale(m, ["x1", "x2"], "y").c, 0.5), 9))


@query("WITH src AS (" + T.EVENTS + "), t AS (SELECT greatest(abs(covar_pop(x1,y)*count(*)/stddev_samp(x1)), abs(covar_pop(x2,y)*count(*)/stddev_samp(x2))) AS top FROM src), s AS (SELECT unnest(generate_series(1, 19)) AS i) SELECT i AS step, round(top*power(power(1e-4, 1/19.0), i), 4) AS lambda FROM t, s")
def re_8_10_lambda_path(spark, sf_dir):
    path = P.make_lambda_path(events(spark, sf_dir), "y", ["x1", "x2"], 20)
    return spark.createDataFrame([(i, round(v, 4)) for i, v in enumerate(path) if math.isfinite(v)], "step long, lambda double")


@query("WITH s AS (SELECT unnest([0, 3, 7]) AS i) SELECT i AS position, CASE WHEN i = 0 THEN 1e308 ELSE round(10.0*power(power(1e-4, 1/9.0), i), 9) END AS lambda FROM s")
def re_9_extract_lambdas(spark, sf_dir):
    path = P.lambda_path(10.0, 100, 3, 10)
    return spark.createDataFrame([(i, 1e308 if math.isinf(path[i]) else round(path[i], 9)) for i in (0, 3, 7)], "position int, lambda double")


@query(_net_sql(f"SELECT t, y, x AS x1, x*x AS x2, x*x*x AS x3 FROM ({T.PARTS}) AS p", ["x1", "x2", "x3"], "1.0", 1.0, 4000, 6).replace("'x1'", "'x'").replace("'x2'", "'x^2'").replace("'x3'", "'x^3'"))
def rg_12_polynomial_lasso(spark, sf_dir):
    return rounded(P.polynomial_penalized(parts(spark, sf_dir), "y", "x", 3, 1.0, 1.0).terms(), term=None, coefficient=6)


# ---- cross-validation (CV)


@query(f"WITH src AS ({T.EVENTS}), f AS (SELECT ntile(3) OVER (ORDER BY t) AS fold FROM src) SELECT fold, count(*) AS n FROM f GROUP BY fold")
def cv_1_fold_sizes(spark, sf_dir):
    return V.with_folds(events(spark, sf_dir).select("t"), "t", 3).groupBy("fold").agg(F.count("*").alias("n")).select(F.col("fold").cast("long").alias("fold"), "n")


def _cv_sql(slope: str) -> str:
    return f"WITH src AS (SELECT *, ntile(5) OVER (ORDER BY t) AS fold FROM ({T.EVENTS}) AS q), k AS (SELECT DISTINCT fold FROM src), m AS (SELECT k.fold, avg(x1) m1, avg(y) my, var_pop(x1) s11, var_pop(y) syy, covar_pop(x1,y) s1y, count(*) n FROM k JOIN src ON src.fold <> k.fold GROUP BY k.fold), b AS (SELECT fold, n, my, m1, {slope} AS b1 FROM m), s AS (SELECT src.fold, count(*) AS test_size, any_value(b.n) AS train_size, avg(power(y-(my-b1*m1)-b1*x1, 2)) AS mse, avg(abs(y-(my-b1*m1)-b1*x1)) AS mae, 1-sum(power(y-(my-b1*m1)-b1*x1, 2))/(var_pop(y)*count(*)) AS r2 FROM src JOIN b ON src.fold = b.fold GROUP BY src.fold)"


def _cv(spark, sf_dir, **options) -> tuple[DataFrame, DataFrame]:
    return V.cross_validate(events(spark, sf_dir), "y", ["x1"], "t", 5, **options)


_CV_ROWS = " SELECT fold, train_size, test_size, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae, round(r2, 8) AS r_squared FROM s"


def _cv_rows(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("fold", F.col("fold").cast("long")), fold=None, train_size=None, test_size=None, mse=6, rmse=6, mae=6, r_squared=8)


@query(_cv_sql("s1y/s11") + _CV_ROWS)
def cv_3_ols(spark, sf_dir):
    return _cv_rows(_cv(spark, sf_dir)[0])


@query(_cv_sql("(s1y/sqrt(s11*syy))/(1+2.0/sqrt(syy))*sqrt(syy/s11)") + _CV_ROWS)
def cv_4_ridge(spark, sf_dir):
    return _cv_rows(_cv(spark, sf_dir, kind="ridge", lam=2.0)[0])


@query(_cv_sql("greatest(abs(s1y/sqrt(s11*syy))-1.0/sqrt(syy), 0)*sign(s1y)*sqrt(syy/s11)") + _CV_ROWS)
def cv_5_lasso(spark, sf_dir):
    return _cv_rows(_cv(spark, sf_dir, kind="lasso", lam=1.0)[0])


def _cv_scores(errors: str) -> str:
    """Metrics by fold of ``errors`` (fold, n, y, p); n: of the training rows."""
    return f"s AS (SELECT fold, count(*) AS test_size, CAST(any_value(n) AS BIGINT) AS train_size, avg((y-p)*(y-p)) AS mse, avg(abs(y-p)) AS mae, 1-sum((y-p)*(y-p))/(var_pop(y)*count(*)) AS r2 FROM {errors} GROUP BY fold)"


_CV_NET = f"WITH RECURSIVE src AS (SELECT *, ntile(5) OVER (ORDER BY t) AS fold FROM ({T.EVENTS}) AS q), tr AS (SELECT k.fold AS f, src.* FROM (SELECT DISTINCT fold FROM src) AS k JOIN src ON src.fold <> k.fold), {T.scaled('tr', ['x1', 'x2'], 'f')}, {T.descent(2, '1.0', 0.5, 100)}, e AS (SELECT fold, n, y, my + dy*(b1/d1*(x1-m1) + b2/d2*(x2-m2)) AS p FROM src JOIN cd ON fold = g), " + _cv_scores("e")


@query(_CV_NET + _CV_ROWS)
def cv_6_elastic_net(spark, sf_dir):
    return _cv_rows(V.cross_validate(events(spark, sf_dir), "y", ["x1", "x2"], "t", 5, "elastic_net", 1.0, 0.5)[0])


@query(_cv_sql("s1y/s11") + " SELECT round(avg(mse), 6) AS mean_mse, round(stddev_samp(mse), 5) AS std_mse, round(avg(sqrt(mse)), 6) AS mean_rmse, round(avg(mae), 6) AS mean_mae, round(stddev_samp(r2), 7) AS std_r_squared FROM s")
def cv_7_9_10_11_summary(spark, sf_dir):
    return rounded(V.summarize(_cv(spark, sf_dir)[0]), mean_mse=6, std_mse=5, mean_rmse=6, mean_mae=6, std_r_squared=7)


@query(_cv_sql("s1y/s11") + ", p AS (SELECT 'x1' AS term, stddev_pop(b1) AS std, avg(b1) AS mean FROM b UNION ALL SELECT 'intercept', stddev_pop(my-b1*m1), avg(my-b1*m1) FROM b) SELECT term, round(std, 7) AS std, round(mean, 7) AS mean FROM p ORDER BY p.std LIMIT 1")
def cv_8_most_stable(spark, sf_dir):
    return rounded(V.most_stable(_cv(spark, sf_dir)[1]), term=None, std=7, mean=7)


@query(_cv_sql("s1y/s11").replace("ntile(5) OVER (ORDER BY t)", "ntile(5) OVER (ORDER BY md5('42:' || t), t)") + _CV_ROWS)
def cv_2_shuffled_folds(spark, sf_dir):
    """Many rows, in the order of a seeded hash."""
    return _cv_rows(V.cross_validate(events(spark, sf_dir), "y", ["x1"], "t", 5, shuffle=True, columns=None, sequential=0)[0])


_SHUFFLED = f"WITH RECURSIVE src AS ({T.SUPPLIERS}), n AS (SELECT count(*) AS n FROM src), {T.sequential_shuffle('(SELECT n FROM n)', 42)}, o AS (SELECT unnest(p) AS i, unnest(range(1, len(p) + 1)) AS place FROM sh), f AS (SELECT i, ntile(7) OVER (ORDER BY place) AS fold FROM o) SELECT t, CAST(fold AS INT) AS fold FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM src) AS s JOIN f ON s.i = f.i"


@query(_SHUFFLED)
def cv_2_12_sequential_shuffle(spark, sf_dir):
    """Few rows, shuffled by the sequential generator."""
    return V.with_folds(suppliers(spark, sf_dir).select("t"), "t", 7, True)


@query("SELECT 'folds' AS option, true AS refused UNION ALL SELECT 'rows', true")
def cv_12_option_checks(spark, sf_dir):
    from statloom.errors import InsufficientData, InvalidInput

    def refused(error, folds: int) -> bool:
        try:
            V.with_folds(suppliers(spark, sf_dir).limit(3), "t", folds)
        except error:
            return True
        return False

    return spark.createDataFrame([("folds", refused(InvalidInput, 1)), ("rows", refused(InsufficientData, 4))], "option string, refused boolean")


# ---- feature importance (FI)


@query(_EVENTS2 + ", s AS (SELECT stddev_samp(src.x1) a, stddev_samp(src.x2) b, stddev_samp(src.y) c FROM src) SELECT 'x1' AS variable, round(b1*a/c, 8) AS standardized FROM g, s UNION ALL SELECT 'x2', round(b2*b/c, 8) FROM g, s")
def fi_1_2_11_standardized(spark, sf_dir):
    e = events(spark, sf_dir)
    fit = L.ols(e, "y", ["x1", "x2"])
    sd = e.agg(D.stddev("y")).first()[0]
    return rounded(I.standardized_coefficients(e, fit.coefficients, fit.x, sd), variable=None, standardized=8)


@query(_EVENTS2 + " SELECT t, round(b1*(x1-m1), 7) + 0.0 AS shap_x1, round(b2*(x2-m2), 7) + 0.0 AS shap_x2, round(b0, 7) AS base_value, round(my, 7) AS expected_value FROM r")
def fi_3_shap(spark, sf_dir):
    return rounded(I.shap_values(events_fit(spark, sf_dir)), t=None, shap_x1=7, shap_x2=7, base_value=7, expected_value=7)


@query(_EVENTS2 + " SELECT 'x1' AS variable, round(avg(abs(b1*(x1-m1))), 7) AS mean_abs_shap FROM r UNION ALL SELECT 'x2', round(avg(abs(b2*(x2-m2))), 7) FROM r")
def fi_3_11_mean_abs_shap(spark, sf_dir):
    return rounded(I.mean_abs_shap(events_fit(spark, sf_dir)), variable=None, mean_abs_shap=7)


@query(_POLY + " SELECT t, round(b1*(x1-m1), 5) + 0.0 AS shap_1, round(b2*(x2-m2), 5) + 0.0 AS shap_2 FROM r")
def fi_4_shap_polynomial(spark, sf_dir):
    s = I.shap_polynomial(L.polynomial(parts(spark, sf_dir), "y", "x", 2))
    return rounded(s.withColumnsRenamed({"shap_x": "shap_1", "shap_x^2": "shap_2"}), t=None, shap_1=5, shap_2=5)


@query(_EVENTS1 + ", " + _LASSO1.format(lam="1.5") + " SELECT t, round(rb*(x1-m1), 7) + 0.0 AS shap_x1 FROM k")
def fi_5_shap_lasso(spark, sf_dir):
    return rounded(I.shap_values(P.lasso(events(spark, sf_dir), "y", ["x1"], 1.5)), t=None, shap_x1=7)


def _moved_sql(count: int) -> str:
    """Central products of each predictor, moved by the affine maps, with the other columns: CTE pr."""
    numbers = f"{T.affine_maps('(SELECT CAST(n AS BIGINT) FROM m)', count, 42)}, nr AS (SELECT row_number() OVER (ORDER BY t) AS i, x1, x2, y FROM src)"
    moved = "mv AS (SELECT r, ((i - 1)*a + b) % (SELECT CAST(n AS BIGINT) FROM m) + 1 AS i, x1 AS z1, x2 AS z2 FROM nr, am)"
    return f"{numbers}, {moved}, pr AS (SELECT r, covar_pop(z1, x2) AS z12, covar_pop(z1, y) AS z1y, covar_pop(z2, x1) AS z21, covar_pop(z2, y) AS z2y FROM mv JOIN nr ON mv.i = nr.i GROUP BY r)"


_R2 = "(({a}*{a}*s22 - 2*{c}*{a}*{b} + {b}*{b}*s11)/((s11*s22 - {c}*{c})*syy))"
_PERMUTED = f"WITH RECURSIVE src AS ({T.EVENTS}), {T.FIT2}, " + _moved_sql(5) + ", lo AS (SELECT 'x1' AS variable, " + "1 - rss/tss - " + _R2.format(a="z1y", b="s2y", c="z12") + " AS loss FROM pr, g UNION ALL SELECT 'x2', 1 - rss/tss - " + _R2.format(a="s1y", b="z2y", c="z21") + " FROM pr, g)"
_LOSSES = " SELECT variable, round(avg(loss), 6) + 0.0 AS importance, round(stddev_samp(loss)/sqrt(count(*)), 6) AS std_error FROM lo GROUP BY variable"


@query(_PERMUTED + _LOSSES)
def fi_6_permutation_ols(spark, sf_dir):
    return rounded(I.permutation_importance(events_fit(spark, sf_dir), "t", 5, sequential=0), variable=None, importance=6, std_error=6)


_RIDGE2 = "ri AS (SELECT *, s12/sqrt(s11*s22) AS q, s1y/sqrt(s11*syy) AS u1, s2y/sqrt(s22*syy) AS u2, 1 + 1.0/sqrt(syy) AS w FROM g), rb AS (SELECT *, (u1*w - u2*q)/(w*w-q*q)*sqrt(syy/s11) AS p1, (u2*w - u1*q)/(w*w-q*q)*sqrt(syy/s22) AS p2 FROM ri)"
_RIDGE_R2 = "(2*(p1*{a} + p2*{b}) - p1*p1*s11 - p2*p2*s22 - 2*p1*p2*{c})/syy"


@query(f"WITH RECURSIVE src AS ({T.EVENTS}), {T.FIT2}, " + _moved_sql(5) + f", {_RIDGE2}, lo AS (SELECT 'x1' AS variable, {_RIDGE_R2.format(a='s1y', b='s2y', c='s12')} - {_RIDGE_R2.format(a='z1y', b='s2y', c='z12')} AS loss FROM pr, rb UNION ALL SELECT 'x2', {_RIDGE_R2.format(a='s1y', b='s2y', c='s12')} - {_RIDGE_R2.format(a='s1y', b='z2y', c='z21')} FROM pr, rb)" + _LOSSES)
def fi_7_permutation_ridge(spark, sf_dir):
    return rounded(I.permutation_importance(P.ridge(events(spark, sf_dir), "y", ["x1", "x2"], 1.0), "t", 5, sequential=0), variable=None, importance=6, std_error=6)


#: Suppliers with a second predictor, few enough for the sequential generator.
_FEW = f"SELECT t, y + 100*x AS y, x AS x1, CAST(t % 7 AS DOUBLE) AS x2 FROM ({T.SUPPLIERS}) AS q"
_STREAM = f"WITH RECURSIVE src AS ({_FEW}), {T.FIT2}, {T.real_shuffles('(SELECT CAST(n AS BIGINT) FROM m)', 8, 42)}, nr AS (SELECT row_number() OVER (ORDER BY t) - 1 AS i, x1, x2, y FROM src), od AS (SELECT r, unnest(p) AS f, unnest(range(len(p))) AS i FROM sh), pr AS (SELECT r, covar_pop(z.x1, d.x2) AS z12, covar_pop(z.x1, d.y) AS z1y, covar_pop(z.x2, d.x1) AS z21, covar_pop(z.x2, d.y) AS z2y FROM od JOIN nr AS d ON d.i = od.i JOIN nr AS z ON z.i = od.f GROUP BY r), lo AS (SELECT 'x1' AS variable, 1 - rss/tss - {_R2.format(a='z1y', b='s2y', c='z12')} AS loss FROM pr, g WHERE r < 4 UNION ALL SELECT 'x2', 1 - rss/tss - {_R2.format(a='s1y', b='z2y', c='z21')} FROM pr, g WHERE r >= 4)"


def _few(spark, sf_dir) -> DataFrame:
    return suppliers(spark, sf_dir).select("t", (F.col("y") + 100 * F.col("x")).alias("y"), F.col("x").alias("x1"), (F.col("t") % 7).cast("double").alias("x2"))


@query(_STREAM + _LOSSES.replace(" FROM lo", ", row_number() OVER (ORDER BY avg(loss) DESC) AS rank FROM lo"))
def fi_9_11_permutation_stream(spark, sf_dir):
    """One stream of the sequential generator over both predictors, ranked."""
    found = I.permutation_importance(L.ols(_few(spark, sf_dir), "y", ["x1", "x2"]), "t", 4)
    return rounded(found.withColumn("rank", F.col("rank").cast("long")), variable=None, importance=6, std_error=6, rank=None)


@query(_EVENTS2 + " SELECT 'x1' AS variable, round(b1*(x1-m1), 7) + 0.0 AS shap FROM r WHERE t = 7 UNION ALL SELECT 'x2', round(b2*(x2-m2), 7) + 0.0 FROM r WHERE t = 7")
def fi_11_observation_contribution(spark, sf_dir):
    return rounded(I.observation_contribution(events_fit(spark, sf_dir), "t", 7), variable=None, shap=7)


_LOESS_STREAM = f"""WITH RECURSIVE src AS ({T.SUPPLIERS}), n AS (SELECT count(*) AS n FROM src), {T.real_shuffles('(SELECT n FROM n)', 4, 42)},
nr AS (SELECT row_number() OVER (ORDER BY t) - 1 AS i, x, y FROM src), od AS (SELECT r, unnest(p) AS f, unnest(range(len(p))) AS i FROM sh),
pts AS (SELECT -1 AS r, i, x, y FROM nr UNION ALL SELECT r, d.i, z.x, d.y FROM od JOIN nr AS d ON d.i = od.i JOIN nr AS z ON z.i = od.f),
d AS (SELECT q.r, q.i AS t, q.x AS qx, q.y AS qy, p.x, p.y, abs(p.x-q.x) AS d, row_number() OVER (PARTITION BY q.r, q.i ORDER BY abs(p.x-q.x), p.i) AS k FROM pts AS q JOIN pts AS p ON q.r = p.r),
k AS (SELECT d.*, max(d.d) OVER (PARTITION BY r, t) AS h FROM d, n WHERE k <= floor(0.5*n + 1e-7)),
w AS (SELECT r, t, qx, qy, x, y, CASE WHEN d > 0.999*h THEN 0 WHEN d <= 0.001*h THEN 1 ELSE power(1-power(d/h, 3), 3) END AS w FROM k),
a AS (SELECT r, t, qx, qy, sum(w*x)/sum(w) mx, sum(w*y)/sum(w) my FROM w GROUP BY ALL), b AS (SELECT w.r, w.t, sum(w*(x-mx)*(x-mx)) sxx, sum(w*(x-mx)*y) sxy FROM w JOIN a ON w.t = a.t AND w.r = a.r GROUP BY ALL),
e AS (SELECT a.r, sum(power(a.qy - (my + (a.qx-mx)*sxy/sxx), 2)) AS rss FROM a JOIN b ON a.t = b.t AND a.r = b.r GROUP BY a.r),
lo AS (SELECT 'x' AS variable, (e.rss - z.rss)/(SELECT var_pop(y)*count(*) FROM src) AS loss FROM e, e AS z WHERE e.r >= 0 AND z.r = -1)"""


@query(_LOESS_STREAM + _LOSSES)
def fi_8_permutation_loess(spark, sf_dir):
    s = suppliers(spark, sf_dir)
    _, fit = LO.loess(s, "y", ["x"], "t", 0.5, 1)
    return rounded(I.permutation_importance_loess(spark, fit, ["x"], 4), variable=None, importance=6, std_error=6)


@query("WITH src AS (SELECT l_extendedprice AS x1, l_extendedprice*(1-l_discount) AS x2 FROM lineitem), c AS (SELECT corr(x1,x2) a FROM src) SELECT 'x1' AS variable, round(1/(1-a*a), 5) AS vif, round(1-a*a, 8) AS score FROM c UNION ALL SELECT 'x2', round(1/(1-a*a), 5), round(1-a*a, 8) FROM c")
def fi_10_13_vif_ranking(spark, sf_dir):
    found = I.vif_ranking(lines(spark, sf_dir), ["x1", "x2"], {"x2": F.col("x1") * (1 - F.col("x2"))})
    return rounded(found, variable=None, vif=5, score=8)


_ALL = f"WITH RECURSIVE src AS ({_FEW}), {T.FIT2}, {T.real_shuffles('(SELECT CAST(n AS BIGINT) FROM m)', 6, 42)}, nr" + _STREAM.split(", nr", 1)[1].replace("r < 4", "r < 3").replace("r >= 4", "r >= 3") + ", sh1 AS (SELECT avg(abs(b1*(x1-m1))) AS a1, avg(abs(b2*(x2-m2))) AS a2 FROM r)"
_ALL_ONE = "SELECT '{v}' AS variable, round({b}*sqrt({s}/syy), 6) + 0.0 AS standardized, round({a}, 6) AS mean_abs_shap, round((SELECT avg(loss) FROM lo WHERE variable = '{v}'), 6) + 0.0 AS importance, round(1/(1 - s12*s12/(s11*s22)), 6) AS vif FROM g, sh1"


@query(_ALL + " " + _ALL_ONE.format(v="x1", b="b1", s="s11", a="a1") + " UNION ALL " + _ALL_ONE.format(v="x2", b="b2", s="s22", a="a2"))
def fi_12_all_importance(spark, sf_dir):
    return rounded(I.all_importance(L.ols(_few(spark, sf_dir), "y", ["x1", "x2"]), "t", 3), variable=None, standardized=6, mean_abs_shap=6, importance=6, vif=6)


# ---- local regression (LO)

_KNN = "WITH src AS ({src}), n AS (SELECT count(*) AS n FROM src), d AS (SELECT q.t, q.x AS qx, p.x, p.y, abs(p.x-q.x) AS d, row_number() OVER (PARTITION BY q.t ORDER BY abs(p.x-q.x), p.t) AS i FROM src q, src p), k AS (SELECT d.*, max(d.d) OVER (PARTITION BY d.t) AS h FROM d, n WHERE i <= floor({span}*n + 1e-7)), w AS (SELECT t, qx, x, y, CASE WHEN d > 0.999*h THEN 0 WHEN d <= 0.001*h THEN 1 ELSE power(1-power(d/h, 3), 3) END AS w FROM k)"


@query(_KNN.format(src=T.SUPPLIERS, span="0.3") + " SELECT t, round(sum(w*y)/sum(w), 6) AS yhat FROM w GROUP BY t")
def lo_1_7_degree_0(spark, sf_dir):
    return rounded(LO.loess(suppliers(spark, sf_dir), "y", ["x"], "t", 0.3, 0)[0], t=None, yhat=6)


_LINE = ", a AS (SELECT t, qx, sum(w) sw, sum(w*x)/sum(w) mx, sum(w*y)/sum(w) my FROM w GROUP BY t, qx), b AS (SELECT w.t, sum(w*(x-mx)*(x-mx)) sxx, sum(w*(x-mx)*y) sxy FROM w JOIN a ON w.t = a.t GROUP BY w.t)"


@query(_KNN.format(src=T.SUPPLIERS, span="0.5") + _LINE + " SELECT a.t, round(my + (qx-mx)*sxy/sxx, 6) AS yhat FROM a JOIN b ON a.t = b.t")
def lo_1_3_4_5_6_degree_1(spark, sf_dir):
    return rounded(LO.loess(suppliers(spark, sf_dir), "y", ["x"], "t", 0.5, 1)[0], t=None, yhat=6)


@query(_KNN.format(src=T.SUPPLIERS, span="0.5").replace("FROM src q, src p", "FROM (SELECT t, x + 0.25 AS x FROM src) AS q, src p") + _LINE + " SELECT a.t, round(my + (qx-mx)*sxy/sxx, 6) AS yhat FROM a JOIN b ON a.t = b.t")
def lo_2_predict(spark, sf_dir):
    s = suppliers(spark, sf_dir)
    _, fit = LO.loess(s, "y", ["x"], "t", 0.5, 1)
    return rounded(LO.predict(fit, s.withColumn("x", F.col("x") + 0.25), ["x"], ["t"]), t=None, yhat=6)


_QUADRATIC = f"""WITH RECURSIVE src AS ({T.SUPPLIERS}), nz AS (SELECT t, y, x, CAST(t % 7 AS DOUBLE) AS z FROM src), lim AS (SELECT min(x) a, max(x) b, min(z) c, max(z) e, count(*) n FROM nz),
pts AS (SELECT t, y, (x-a)/(b-a) AS x, (z-c)/(e-c) AS z, n FROM nz, lim),
d AS (SELECT q.t, p.x-q.x AS u, p.z-q.z AS v, p.y, q.n, sqrt((p.x-q.x)*(p.x-q.x) + (p.z-q.z)*(p.z-q.z)) AS d, row_number() OVER (PARTITION BY q.t ORDER BY sqrt((p.x-q.x)*(p.x-q.x) + (p.z-q.z)*(p.z-q.z)), p.t) AS i FROM pts AS q, pts AS p),
k AS (SELECT *, max(d) OVER (PARTITION BY t) AS h FROM d WHERE i <= floor(0.9*n + 1e-7)),
w AS (SELECT t AS g, i, [1.0, u, v, u*u, u*v, v*v, y] AS c, CASE WHEN d > 0.999*h THEN 0 WHEN d <= 0.001*h THEN 1 ELSE power(1-power(d/h, 3), 3) END AS w FROM k),
l AS (SELECT g, i, w, unnest(range(1, 8)) AS j, unnest(c) AS v FROM w),
a AS (SELECT p.g, p.j AS i, q.j AS j, sum(p.w*p.v*q.v) AS v FROM l AS p JOIN l AS q ON p.g = q.g AND p.i = q.i GROUP BY ALL), {T.sweep('a', 6)}"""


@query(_QUADRATIC + " SELECT g AS t, round(v, 4) AS yhat FROM sw WHERE i = 1 AND j = 7")
def lo_8_degree_2_two_predictors(spark, sf_dir):
    s = suppliers(spark, sf_dir).withColumn("z", (F.col("t") % 7).cast("double"))
    return rounded(LO.loess(s, "y", ["x", "z"], "t", 0.9, 2)[0], t=None, yhat=4)


def _robust_sql(rounds: int) -> str:
    """A degree 1 fit, and others whose weights count the residuals of the one before."""
    out = [f"WITH src AS ({T.SUPPLIERS}), n AS (SELECT count(*) AS n FROM src), d AS (SELECT q.t, q.x AS qx, q.y AS qy, p.t AS pt, p.x, p.y, abs(p.x-q.x) AS d, row_number() OVER (PARTITION BY q.t ORDER BY abs(p.x-q.x), p.t) AS i FROM src q, src p), k AS (SELECT d.*, max(d.d) OVER (PARTITION BY d.t) AS h FROM d, n WHERE i <= floor(0.5*n + 1e-7)), nb AS (SELECT t, qx, qy, pt, x, y, CASE WHEN d > 0.999*h THEN 0 WHEN d <= 0.001*h THEN 1 ELSE power(1-power(d/h, 3), 3) END AS w FROM k), rw0 AS (SELECT t, 1.0 AS rw FROM src)"]
    for i in range(rounds + 1):
        out.append(f"w{i} AS (SELECT nb.* EXCLUDE (w), w*rw AS w FROM nb JOIN rw{i} AS r ON nb.pt = r.t), a{i} AS (SELECT t, qx, qy, sum(w*x)/sum(w) mx, sum(w*y)/sum(w) my FROM w{i} GROUP BY ALL), b{i} AS (SELECT w.t, sum(w*(x-mx)*(x-mx)) sxx, sum(w*(x-mx)*y) sxy FROM w{i} AS w JOIN a{i} AS a ON w.t = a.t GROUP BY w.t)")
        out.append(f"f{i} AS (SELECT a.t, my + (qx-mx)*sxy/sxx AS yhat, qy - (my + (qx-mx)*sxy/sxx) AS e FROM a{i} AS a JOIN b{i} AS b ON a.t = b.t), c{i} AS (SELECT 6*median(abs(e)) AS c FROM f{i}), rw{i + 1} AS (SELECT t, CASE WHEN abs(e)/c <= 0.001 THEN 1 WHEN abs(e)/c > 0.999 THEN 0 ELSE power(1 - power(e/c, 2), 2) END AS rw FROM f{i}, c{i})")
    return ", ".join(out) + f" SELECT t, round(yhat, 5) AS yhat FROM f{rounds}"


@query(_robust_sql(2))
def lo_9_10_robust(spark, sf_dir):
    return rounded(LO.loess(suppliers(spark, sf_dir), "y", ["x"], "t", 0.5, 1, 2)[0], t=None, yhat=5)


@query(_KNN.format(src=T.SUPPLIERS, span="0.5") + _LINE + ", f AS (SELECT round(my + (qx-mx)*sxy/sxx, 6) AS yhat, a.t FROM a JOIN b ON a.t = b.t) SELECT 'direct' AS surface, * FROM f UNION ALL SELECT 'interpolate', * FROM f")
def lo_11_surface(spark, sf_dir):
    """The option is recorded; both are computed directly."""
    out = None
    for surface in ("direct", "interpolate"):
        yhat, fit = LO.loess(suppliers(spark, sf_dir), "y", ["x"], "t", 0.5, 1, surface=surface)
        one = rounded(yhat, t=None, yhat=6).withColumn("surface", F.lit(fit.surface))
        out = one if out is None else out.union(one)
    return out


# ---- distribution functions (SF)

_U = "(event_id % 97 + 1)/99.0"


def _arg(spark, sf_dir, low: int = 1) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 97 + 1) / F.lit(99.0)).cast("double").alias("u"))


@query(f"SELECT event_id, round(lgamma({_U}*20), 8) + 0.0 AS v FROM events")
def sf_1_ln_gamma(spark, sf_dir):
    return _arg(spark, sf_dir).select("event_id", (F.round(S.arrow(S.ln_gamma)(F.col("u") * 20), 8) + 0.0).alias("v"))


@query(f"SELECT event_id, round(power({_U}, 2.5), 9) AS one, round(1-power(1-{_U}, 3.5), 9) AS other FROM events")
def sf_2_inc_beta(spark, sf_dir):
    f = S.arrow(S.inc_beta)
    return _arg(spark, sf_dir).select("event_id", F.round(f("u", F.lit(2.5), F.lit(1.0)), 9).alias("one"), F.round(f("u", F.lit(1.0), F.lit(3.5)), 9).alias("other"))


@query(f"SELECT event_id, round(exp(-{_U}*9), 9) AS one, round(exp(-{_U}*9)*(1+{_U}*9), 9) AS two FROM events")
def sf_3_inc_gamma_upper(spark, sf_dir):
    f = S.arrow(S.inc_gamma_upper)
    return _arg(spark, sf_dir).select("event_id", F.round(f(F.lit(1.0), F.col("u") * 9), 9).alias("one"), F.round(f(F.lit(2.0), F.col("u") * 9), 9).alias("two"))


@query(f"SELECT event_id, round(0.5+atan(({_U}-0.5)*12)/pi(), 9) AS one, round(0.5+({_U}-0.5)*12/(2*sqrt(2+power(({_U}-0.5)*12, 2))), 9) AS two FROM events")
def sf_4_14_student_t(spark, sf_dir):
    f, t = S.arrow(S.student_t_cdf), (F.col("u") - 0.5) * 12
    return _arg(spark, sf_dir).select("event_id", F.round(f(t, F.lit(1.0)), 9).alias("one"), F.round(f(t, F.lit(2.0)), 9).alias("two"))


@query(f"SELECT event_id, round(1-power(1+2*{_U}*6/11, -5.5), 9) AS v FROM events")
def sf_5_fisher_snedecor(spark, sf_dir):
    return _arg(spark, sf_dir).select("event_id", F.round(S.arrow(S.fisher_snedecor_cdf)(F.col("u") * 6, F.lit(2.0), F.lit(11.0)), 9).alias("v"))


@query(f"SELECT event_id, round(exp(-{_U}*8)*(1+{_U}*8+power({_U}*8, 2)/2), 9) AS v FROM events")
def sf_6_chi_squared(spark, sf_dir):
    a = _arg(spark, sf_dir)
    return a.select("event_id", F.round(S.chi_squared_survival_even_col(F.col("u") * 16, 6), 9).alias("v"))


@query(f"SELECT event_id, round(exp(-{_U}*8)*(1+{_U}*8+power({_U}*8, 2)/2), 9) AS v FROM events")
def sf_6_chi_squared_udf(spark, sf_dir):
    return _arg(spark, sf_dir).select("event_id", F.round(S.arrow(S.chi_squared_survival)(F.col("u") * 16, F.lit(6.0)), 9).alias("v"))


@query(f"SELECT event_id, round({T.normal_cdf(f'(({_U}-0.5)*8)')}, 9) AS v FROM events")
def sf_7_normal_cdf(spark, sf_dir):
    return _arg(spark, sf_dir).select("event_id", F.round(S.normal_cdf_col((F.col("u") - 0.5) * 8), 9).alias("v"))


@query(f"SELECT event_id, round({T.normal_cdf(f'(({_U}-0.5)*8)')}, 5) AS v FROM events")
def sf_8_9_normal_cdf_exact(spark, sf_dir):
    """Within the other formula's error."""
    a = _arg(spark, sf_dir)
    z = (F.col("u") - 0.5) * 8
    return a.select("event_id", F.round(S.normal_cdf_col(z) + 0 * S.arrow(S.normal_cdf_exact)(z), 5).alias("v"))


@query(f"SELECT event_id, round({T.acklam(f'({_U})')}, 7) + 0.0 AS v FROM events")
def sf_10_normal_inverse(spark, sf_dir):
    return _arg(spark, sf_dir).select("event_id", (F.round(S.acklam_col(F.col("u")), 7) + 0.0).alias("v"))


@query(f"SELECT event_id, round(tan(pi()*({_U}-0.5)), 6) + 0.0 AS one, round(2*({_U}-0.5)*sqrt(2/(4*{_U}*(1-{_U}))), 6) + 0.0 AS two FROM events")
def sf_11_12_student_t_inverse(spark, sf_dir):
    f = S.arrow(S.student_t_inverse_cdf)
    return _arg(spark, sf_dir).select("event_id", (F.round(f("u", F.lit(1.0)), 6) + 0.0).alias("one"), (F.round(f("u", F.lit(2.0)), 6) + 0.0).alias("two"))


@query(f"SELECT event_id, round(1-2*abs(0.5-(0.5+atan(({_U}-0.5)*12)/pi())), 8) AS t_p, round(power(1+2*{_U}*6/11, -5.5), 9) AS f_p FROM events")
def sf_13_p_values(spark, sf_dir):
    return _arg(spark, sf_dir).select("event_id", F.round(S.arrow(S.two_tailed_p_value)((F.col("u") - 0.5) * 12, F.lit(1.0)), 8).alias("t_p"), F.round(S.arrow(S.f_p_value)(F.col("u") * 6, F.lit(2.0), F.lit(11.0)), 9).alias("f_p"))


@query(f"SELECT event_id, round(0.5+atan(({_U}-0.5)*12)/pi(), 9) AS p FROM events")
def sf_14_sql_functions(spark, sf_dir):
    S.register(spark)
    return _arg(spark, sf_dir).selectExpr("event_id", "round(get_t_cdf((u - 0.5) * 12, 1.0D), 9) AS p")


@query("SELECT '0.1.0' AS version")
def sf_14_version(spark, sf_dir):
    S.register(spark)
    return spark.sql("SELECT get_version() AS version")


# ---- models (IO) and streams


@query(_EVENTS2 + " SELECT t, round(yhat, 6) AS yhat FROM r")
def io_3_4_model_roundtrip(spark, sf_dir):
    from statloom.sources import models

    fit = events_fit(spark, sf_dir)
    return rounded(models.predict(models.deserialize(models.serialize(fit, "events"), "ols"), fit.df), t=None, yhat=6)


@query(_EVENTS2 + " SELECT t, round(yhat, 6) AS yhat FROM r")
def io_3_4_8_model_file(spark, sf_dir):
    """Written to a file of the shared folder and read again."""
    from statloom.plans.ordered import folder
    from statloom.sources import models

    fit, path = events_fit(spark, sf_dir), folder(spark, "model")
    models.save(spark, fit, path, "events")
    return rounded(models.predict(models.load(spark, path, "ols"), fit.df), t=None, yhat=6)


_KINDS = ("OLS", "WLS", "Polynomial", "Ridge", "Lasso", "ElasticNet", "LOESS")


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, '1.0' AS format_version, true AS same, true AS mismatch_refused, true AS version_refused, '{k}' AS parsed" for k in _KINDS))
def io_5_6_9_model_kinds(spark, sf_dir):
    """Every kind of model survives its text; a wrong kind and another major version are refused; names are read in any case."""
    import json

    from statloom.errors import IncompatibleFormatVersion, ModelTypeMismatch
    from statloom.sources import models

    few = _few(spark, sf_dir)
    fits = [L.ols(few, "y", ["x1", "x2"]), L.wls(few, "y", ["x1"], "x1"), L.polynomial(few, "y", "x1", 2), P.ridge(few, "y", ["x1", "x2"]), P.lasso(few, "y", ["x1", "x2"]), P.elastic_net(few, "y", ["x1", "x2"], 1.0, 0.5), LO.loess(few, "y", ["x1"], "t", 0.5, 1)[1]]

    def refused(error, text: str, kind: str | None) -> bool:
        try:
            models.deserialize(text, kind)
        except error:
            return True
        return False

    rows = []
    for k, fit in zip(_KINDS, fits, strict=True):
        text = models.serialize(fit)
        model = models.deserialize(text, k)
        newer = json.loads(text)
        newer["metadata"]["format_version"] = "2.0"
        same = model["data"] == json.loads(json.dumps(models.describe(fit)[1]))
        rows.append((model["metadata"]["model_type"], model["metadata"]["format_version"], same, refused(ModelTypeMismatch, text, "OLS" if k != "OLS" else "WLS"), refused(IncompatibleFormatVersion, json.dumps(newer), None), models.model_type(k.upper())))
    return spark.createDataFrame(rows, "kind string, format_version string, same boolean, mismatch_refused boolean, version_refused boolean, parsed string")


@query("SELECT time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP)) AS window_start, count(*) AS n, round(regr_slope(value, CAST(event_id AS DOUBLE)), 8) + 0.0 AS slope, round(regr_intercept(value, CAST(event_id AS DOUBLE)), 4) + 0.0 AS intercept FROM events GROUP BY 1")
def stream_windowed_line(spark, sf_dir):
    from statloom.streaming.windowed import windowed_line

    w = windowed_line(read(spark, sf_dir, "events"), "ts", "value", "event_id", "1 day", "1 day")
    return rounded(w, window_start=None, n=None, slope=8, intercept=4)
