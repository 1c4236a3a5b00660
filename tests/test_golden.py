"""Published results of R and statsmodels on two small public data sets."""

import math

import pytest

from statloom.operators import diagnostics as X
from statloom.operators import linear as L
from statloom.operators import loess as LO
from statloom.operators import penalized as P

#: R's mtcars: mpg and ten predictors of 32 cars. Fixed values.
MTCARS_NAMES = ["mpg", "cyl", "disp", "hp", "drat", "wt", "qsec", "vs", "am", "gear", "carb"]
MTCARS = """
21 6 160 110 3.9 2.62 16.46 0 1 4 4
21 6 160 110 3.9 2.875 17.02 0 1 4 4
22.8 4 108 93 3.85 2.32 18.61 1 1 4 1
21.4 6 258 110 3.08 3.215 19.44 1 0 3 1
18.7 8 360 175 3.15 3.44 17.02 0 0 3 2
18.1 6 225 105 2.76 3.46 20.22 1 0 3 1
14.3 8 360 245 3.21 3.57 15.84 0 0 3 4
24.4 4 146.7 62 3.69 3.19 20 1 0 4 2
22.8 4 140.8 95 3.92 3.15 22.9 1 0 4 2
19.2 6 167.6 123 3.92 3.44 18.3 1 0 4 4
17.8 6 167.6 123 3.92 3.44 18.9 1 0 4 4
16.4 8 275.8 180 3.07 4.07 17.4 0 0 3 3
17.3 8 275.8 180 3.07 3.73 17.6 0 0 3 3
15.2 8 275.8 180 3.07 3.78 18 0 0 3 3
10.4 8 472 205 2.93 5.25 17.98 0 0 3 4
10.4 8 460 215 3 5.424 17.82 0 0 3 4
14.7 8 440 230 3.23 5.345 17.42 0 0 3 4
32.4 4 78.7 66 4.08 2.2 19.47 1 1 4 1
30.4 4 75.7 52 4.93 1.615 18.52 1 1 4 2
33.9 4 71.1 65 4.22 1.835 19.9 1 1 4 1
21.5 4 120.1 97 3.7 2.465 20.01 1 0 3 1
15.5 8 318 150 2.76 3.52 16.87 0 0 3 2
15.2 8 304 150 3.15 3.435 17.3 0 0 3 2
13.3 8 350 245 3.73 3.84 15.41 0 0 3 4
19.2 8 400 175 3.08 3.845 17.05 0 0 3 2
27.3 4 79 66 4.08 1.935 18.9 1 1 4 1
26 4 120.3 91 4.43 2.14 16.7 0 1 5 2
30.4 4 95.1 113 3.77 1.513 16.9 1 1 5 2
15.8 8 351 264 4.22 3.17 14.5 0 1 5 4
19.7 6 145 175 3.62 2.77 15.5 0 1 5 6
15 8 301 335 3.54 3.57 14.6 0 1 5 8
21.4 4 121 109 4.11 2.78 18.6 1 1 4 2
"""
#: R's cars: speed and stopping distance. Fixed values.
CARS = "4,2 4,10 7,4 7,22 8,16 9,10 10,18 10,26 10,34 11,17 11,28 12,14 12,20 12,24 12,28 13,26 13,34 13,34 13,46 14,26 14,36 14,60 14,80 15,20 15,26 15,54 16,32 16,40 17,32 17,40 17,50 18,42 18,56 18,76 18,84 19,36 19,46 19,68 20,32 20,48 20,52 20,56 20,64 22,66 23,54 24,70 24,92 24,93 24,120 25,85"


@pytest.fixture(scope="module")
def mtcars(spark):
    rows = [(i, *map(float, line.split())) for i, line in enumerate(MTCARS.strip().split("\n"))]
    return spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} double" for c in MTCARS_NAMES)).repartition(3)


@pytest.fixture(scope="module")
def cars(spark):
    rows = [(i, *map(float, r.split(","))) for i, r in enumerate(CARS.split())]
    return spark.createDataFrame(rows, "i long, speed double, dist double").repartition(3)


X10 = MTCARS_NAMES[1:]


@pytest.mark.parametrize("test, statistic, p", [
    (lambda d: X.jarque_bera(d, "mpg", X10), 1.746657601854928, 0.41755926155187895),
    (lambda d: X.breusch_pagan(d, "mpg", X10), 14.913588960624198, 0.13524415065657977),
    (lambda d: X.reset(d, "mpg", X10), 5.545230273822531, 0.012679008059481361),
    (lambda d: X.rainbow(d, "mpg", X10, "i"), 3.8577111479531578, 0.071197120389536461),
    (lambda d: X.shapiro_wilk(d, "mpg", X10), 0.95694363046672815, 0.22614893260656743),
    (lambda d: X.white(d, "mpg", X10, "R"), 19.397512014434628, 0.49613856327408801),
    (lambda d: X.breusch_godfrey(d, "mpg", X10, "i"), 0.06273071608909854, 0.80223085567818475),
])
def test_mtcars(mtcars, test, statistic, p):
    found = test(mtcars)
    assert math.isfinite(found["statistic"]) and found["statistic"] == pytest.approx(statistic, rel=1e-7)
    assert found["p_value"] == pytest.approx(p, rel=1e-6)


def test_mtcars_others(mtcars):
    assert X.durbin_watson(mtcars, "mpg", X10, "i")["statistic"] == pytest.approx(1.8608933684548066, rel=1e-9)
    found = X.anderson_darling(mtcars, "mpg", X10)
    assert found["statistic"] == pytest.approx(0.39168047953432961, abs=1e-5) and found["p_value"] == pytest.approx(0.359, abs=1e-2)
    vif = {r["variable"]: r["vif"] for r in X.vif(mtcars, X10).collect()}
    assert vif["cyl"] == pytest.approx(15.373833403442193, rel=1e-9) and vif["disp"] == pytest.approx(21.620241028958979, rel=1e-9)


def test_cars(cars):
    terms = {r["term"]: r for r in L.ols(cars, "speed", ["dist"]).terms().collect()}
    assert terms["intercept"]["coefficient"] == pytest.approx(8.2839056417871682, rel=1e-10) and terms["dist"]["std_error"] == pytest.approx(0.017494479053131284, rel=1e-10)
    assert terms["dist"]["p_value"] == pytest.approx(1.4898364962950983e-12, rel=1e-6)
    assert X.harvey_collier(cars, "speed", ["dist"], "i")["statistic"] == pytest.approx(5.478727, rel=1e-6)
    assert X.harvey_collier(cars, "speed", ["dist"], "i", "Python")["statistic"] == pytest.approx(5.342546, rel=1e-6)
    cook = [r["cooks_d"] for r in X.cooks_distance(cars, "speed", ["dist"])[0].orderBy("i").limit(3).collect()]
    assert cook == pytest.approx([0.088844997649360977, 0.10561564497421086, 0.014560685320349421], rel=1e-9)
    fits = [r["dffits"] for r in X.dffits(cars, "speed", ["dist"])[0].orderBy("i").limit(3).collect()]
    assert fits == pytest.approx([-0.42750344948613522, -0.47362452616832706, -0.16958428617767135], rel=1e-9)


def test_cars_lasso(cars):
    for lam, b0, b1 in ((2.6012, 12.6663, 0.0636), (0.9865, 9.946, 0.1269), (0.1419, 8.523, 0.16)):
        fit = P.lasso(cars, "speed", ["dist"], lam)
        assert fit.coefficients == pytest.approx([b0, b1], abs=2e-4)


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_change_nothing(cars, parts):
    d = cars.repartition(parts)
    assert L.ols(d, "speed", ["dist"]).coefficients == pytest.approx([8.2839056417871682, 0.1655675746443189], rel=1e-12)
    assert X.durbin_watson(d, "speed", ["dist"], "i")["statistic"] == pytest.approx(X.durbin_watson(cars, "speed", ["dist"], "i")["statistic"], rel=1e-12)


def test_loess_is_exact_on_lines(spark):
    line = spark.createDataFrame([(i, float(i * i % 17 + i), 3.0 + 2.0 * (i * i % 17 + i)) for i in range(40)], "i long, x double, y double")
    rows, fit = LO.loess(line, "y", ["x"], "i", 0.5, 1)
    wanted = {r["i"]: r["y"] for r in line.collect()}
    assert all(r["yhat"] == pytest.approx(wanted[r["i"]], abs=1e-9) for r in rows.collect())
    plane = line.withColumn("z", line["x"] % 5).withColumn("y", line["x"] * 2 - line["x"] % 5)
    wanted = {r["i"]: r["y"] for r in plane.collect()}
    assert all(r["yhat"] == pytest.approx(wanted[r["i"]], abs=1e-6) for r in LO.loess(plane, "y", ["x", "z"], "i", 0.9, 1)[0].collect())
