"""Every core query runs, and agrees with its SQL where it has one."""

import math

import duckdb
import pytest

from statloom.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=str)
    assert found
    if name not in ORACLE_SQL:
        return
    frame = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in frame.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = sorted((tuple(value(r[i]) for i in at) for r in frame.fetchall()), key=str)
    assert len(found) == len(wanted)
    wrong = [(a, b) for a, b in zip(found, wanted, strict=True) if not all(close(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x, float(y) if isinstance(y, (int, float)) and not isinstance(y, bool) else y) for x, y in zip(a, b, strict=True))]
    assert not wrong, wrong[:3]


def test_shapiro_wilk_reads_the_whole_table(spark, sf_dir, duck):
    """Every shipping day is a value, and every line counts in its day's mean."""
    import numpy as np

    from statloom.operators.diagnostics import shapiro_wilk_sample

    days = [r[0] for r in duck.execute("SELECT avg(l_extendedprice) FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY CAST(l_shipdate AS DATE)").fetchall()]
    (found,) = QUERIES["dx_7_shapiro_wilk"](spark, sf_dir).collect()
    w, p = shapiro_wilk_sample(np.array(days, float))
    assert found["n"] == len(days) and found["statistic"] == pytest.approx(w, abs=2e-8) and found["p_value"] == pytest.approx(p, abs=2e-8)
