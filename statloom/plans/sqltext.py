"""SQL text of the same statistics, for holding results against another engine. ``src`` is a relation with columns y, x1, x2 (and t, a unique order)."""

from __future__ import annotations

from collections.abc import Sequence

#: Relations over the standard tables.
LINES = "SELECT l_extendedprice*(1-l_discount)*(1+l_tax) AS y, l_extendedprice AS x1, l_discount AS x2, l_tax AS x3, l_quantity AS w, l_returnflag, l_linestatus FROM lineitem"
EVENTS = "SELECT event_id AS t, value + 0.8*CAST(json_extract(props, '$.k') AS DOUBLE) + 0.05*CAST(user_id % 50 AS DOUBLE) AS y, CAST(json_extract(props, '$.k') AS DOUBLE) AS x1, CAST(user_id % 50 AS DOUBLE) AS x2, value FROM events"
PARTS = "SELECT p_partkey AS t, p_retailprice AS y, CAST(p_size AS DOUBLE) AS x FROM part"
SUPPLIERS = "SELECT s_suppkey AS t, s_acctbal AS y, CAST(s_suppkey AS DOUBLE) AS x FROM supplier"

#: Least squares of y on x1: CTE g has b0, b1, rss, tss, i11; r has yhat, e, h by row.
FIT1 = """
m AS (SELECT CAST(count(*) AS DOUBLE) n, avg(y) my, avg(x1) m1, var_pop(x1) s11, covar_pop(x1, y) s1y, var_pop(y) syy FROM src),
g AS (SELECT *, s1y/s11 AS b1, my - s1y/s11*m1 AS b0, n*(syy - s1y*s1y/s11) AS rss, n*syy AS tss, 1/(n*s11) AS i11, n-2 AS df FROM m),
r AS (SELECT src.*, g.*, b0 + b1*x1 AS yhat, y - (b0 + b1*x1) AS e, 1/n + i11*(x1-m1)*(x1-m1) AS h FROM src, g)"""

#: Of y on x1 and x2.
FIT2 = """
m AS (SELECT CAST(count(*) AS DOUBLE) n, avg(y) my, avg(x1) m1, avg(x2) m2, var_pop(x1) s11, var_pop(x2) s22, covar_pop(x1, x2) s12, covar_pop(x1, y) s1y, covar_pop(x2, y) s2y, var_pop(y) syy FROM src),
d AS (SELECT *, s11*s22 - s12*s12 AS det FROM m),
c AS (SELECT *, (s1y*s22 - s2y*s12)/det AS b1, (s2y*s11 - s1y*s12)/det AS b2 FROM d),
g AS (SELECT *, my - b1*m1 - b2*m2 AS b0, n*(syy - b1*s1y - b2*s2y) AS rss, n*syy AS tss, s22/(n*det) AS i11, s11/(n*det) AS i22, -s12/(n*det) AS i12, n-3 AS df FROM c),
r AS (SELECT src.*, g.*, b0 + b1*x1 + b2*x2 AS yhat, y - (b0 + b1*x1 + b2*x2) AS e, 1/n + i11*(x1-m1)*(x1-m1) + 2*i12*(x1-m1)*(x2-m2) + i22*(x2-m2)*(x2-m2) AS h FROM src, g)"""

#: The inverse of X'X from FIT2's g.
INVERSE = "(1/n + m1*m1*i11 + 2*m1*m2*i12 + m2*m2*i22)", "(-(i11*m1 + i12*m2))", "(-(i12*m1 + i22*m2))"


def fwl(source: str, target: str, regressors: Sequence[str], tag: str = "z") -> str:
    """CTEs that take one regressor after another out of the target and of the later ones; the last, ``<tag>``, has rss, tss and n."""
    k = len(regressors)
    names = [f"r{i}" for i in range(k)]
    out = [f"{tag}0 AS (SELECT {target} AS t, {', '.join(f'{c} AS {n}' for c, n in zip(regressors, names, strict=True))} FROM {source})"]
    for i in range(k):
        left = ["t", *names[i + 1 :]]
        sums = ", ".join(f"regr_slope({v}, {names[i]}) AS s_{v}, regr_intercept({v}, {names[i]}) AS i_{v}" for v in left)
        out.append(f"{tag}a{i} AS (SELECT {sums} FROM {tag}{i})")
        out.append(f"{tag}{i + 1} AS (SELECT {', '.join(f'{v} - i_{v} - s_{v}*{names[i]} AS {v}' for v in left)} FROM {tag}{i}, {tag}a{i})")
    out.append(f"{tag} AS (SELECT (SELECT sum(t*t) FROM {tag}{k}) AS rss, (SELECT var_pop(t)*count(*) FROM {tag}0) AS tss, (SELECT CAST(count(*) AS DOUBLE) FROM {tag}0) AS n)")
    return ",\n".join(out)


def normal_cdf(z: str) -> str:
    """Abramowitz and Stegun's formula as in the functions module."""
    from statloom.functions.special import ERF_A, ERF_P

    t = f"(1/(1 + {ERF_P}*abs({z})/sqrt(2.0)))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"({poly} + {a})*{t}"
    return f"(CASE WHEN {z} >= 0 THEN 1 - 0.5*{poly}*exp(-({z})*({z})/2) ELSE 0.5*{poly}*exp(-({z})*({z})/2) END)"


def normal_sf(z: str) -> str:
    """The upper tail by the series in odd powers over double factorials, to about 1e-15."""
    term = f"exp((2*q.k + 1)*ln(greatest(abs({z}), 1e-300)) - (q.k + 1)*ln(2.0) - lgamma(q.k + 1.5) + 0.5*ln(pi()))"
    return f"(CASE WHEN abs({z}) > 12 THEN CASE WHEN {z} > 0 THEN 0.0 ELSE 1.0 END ELSE 0.5 - sign({z})*exp(-({z})*({z})/2)/sqrt(2*pi())*(SELECT sum({term}) FROM (SELECT CAST(unnest(range(300)) AS DOUBLE) AS k) AS q) END)"


def acklam(p: str) -> str:
    from statloom.functions.special import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, ACKLAM_TAIL

    def horner(c, x: str) -> str:
        out = repr(c[0])
        for v in c[1:]:
            out = f"({out}*{x} + {v!r})"
        return out

    def tail(v: str) -> str:
        q = f"sqrt(-2*ln({v}))"
        return f"({horner(ACKLAM_C, q)}/{horner(ACKLAM_D, q)})"

    q = f"({p} - 0.5)"
    r = f"({q}*{q})"
    return f"(CASE WHEN {p} < {ACKLAM_TAIL} THEN {tail(p)} WHEN {p} > {1 - ACKLAM_TAIL} THEN -{tail(f'(1 - {p})')} ELSE {q}*{horner(ACKLAM_A, r)}/{horner(ACKLAM_B, r)} END)"


def scaled(source: str, x: Sequence[str], by: str = "0", weight: str | None = None, intercept: bool = True, tag: str = "sc") -> str:
    """CTE of the unit-scale problem of penalised fits, a row for each value of ``by``: n, means m<i>, deviations d<i>, response my and dy, correlations q<i>_<j>, c<i>, and vy, the response's variance."""
    k = len(x)
    w = weight or "1.0"
    every = [*x, "y"]
    mean = ", ".join(f"sum({w}*{v})/sum({w}) AS a{i}" for i, v in enumerate(every))
    away = [f"({v} - a{i})" for i, v in enumerate(every)]
    cov = ", ".join(f"sum({w}*{away[i]}*{away[j]})/sum({w}) AS v{i}_{j}" for i in range(k + 1) for j in range(i, k + 1))
    raw = {(i, j): f"v{i}_{j}" if intercept else f"(v{i}_{j} + a{i}*a{j})" for i in range(k + 1) for j in range(i, k + 1)}
    own = [f"a{i} AS m{i + 1}, sqrt(v{i}_{i}) AS d{i + 1}" for i in range(k)] + [f"a{k} AS my, sqrt({raw[k, k]}) AS dy, v{k}_{k} AS vy"]
    own += [f"{raw[i, j]}/sqrt(v{i}_{i}*v{j}_{j}) AS q{i + 1}_{j + 1}" for i in range(k) for j in range(i, k)] + [f"{raw[i, k]}/sqrt(v{i}_{i}*{raw[k, k]}) AS c{i + 1}" for i in range(k)]
    means = f"{tag}m AS (SELECT {by} AS g, CAST(count(*) AS DOUBLE) AS n, {mean} FROM {source} GROUP BY 1)"
    covs = f"{tag}v AS (SELECT m.g, any_value(m.n) AS n, {', '.join(f'any_value(a{i}) AS a{i}' for i in range(k + 1))}, {cov} FROM (SELECT *, {by} AS g FROM {source}) AS s JOIN {tag}m AS m ON s.g = m.g GROUP BY m.g)"
    return f"{means},\n{covs},\n{tag} AS (SELECT g, n, {', '.join(own)} FROM {tag}v)"


def descent(k: int, lam: str, alpha: float, sweeps: int, factor: Sequence[float] | None = None, bounds: dict[int, tuple[float, float]] | None = None, source: str = "sc", tag: str = "cd") -> str:
    """Recursive CTE: cyclic coordinate descent over the rows of ``scaled``; b1.. are the unit-scale coefficients after the sweeps. ``lam`` may name columns."""
    factor = factor or [1.0] * k
    inner = f"(SELECT d.i, s.*, {', '.join(f'd.b{j}' for j in range(1, k + 1))} FROM {tag}r AS d JOIN {source} AS s ON d.g = s.g WHERE d.i < {sweeps})"
    for j in range(1, k + 1):
        rho = f"c{j}" + "".join(f" - q{min(m, j)}_{max(m, j)}*{'u' if m < j else 'b'}{m}" for m in range(1, k + 1) if m != j)
        value = f"sign({rho})*greatest(abs({rho}) - ({lam})/dy*{alpha * factor[j - 1]}, 0)/(q{j}_{j} + ({lam})/dy*{(1 - alpha) * factor[j - 1]})"
        if bounds and j in bounds:
            value = f"least(greatest({value}, {bounds[j][0]}*d{j}/dy), {bounds[j][1]}*d{j}/dy)"
        inner = f"(SELECT *, {value} AS u{j} FROM {inner} AS p{j})"
    start = f"SELECT 0 AS i, g, {', '.join(f'CAST(0 AS DOUBLE) AS b{j}' for j in range(1, k + 1))} FROM {source}"
    step = f"SELECT i + 1, g, {', '.join(f'u{j}' for j in range(1, k + 1))} FROM {inner} AS p"
    return f"{tag}r AS ({start} UNION ALL {step}),\n{tag} AS (SELECT s.*, {', '.join(f'b{j}' for j in range(1, k + 1))} FROM {tag}r AS d JOIN {source} AS s ON d.g = s.g WHERE d.i = {sweeps})"


def sweep(source: str, k: int, tag: str = "sw") -> str:
    """Recursive CTE over ``source`` (g, i, j, v), a symmetric matrix of k terms and, as number k + 1, the response, for each g: afterwards v(i, k + 1) are coefficients, v(k + 1, k + 1) is the residual sum and the rest the inverse."""
    value = "CASE WHEN i = p AND j = p THEN 1/pp WHEN i = p THEN pj/pp WHEN j = p THEN -ip/pp ELSE v - ip*pj/pp END"
    pivots = f"SELECT *, s + 1 AS p, max(CASE WHEN i = s + 1 AND j = s + 1 THEN v END) OVER (PARTITION BY g) AS pp, max(CASE WHEN i = s + 1 THEN v END) OVER (PARTITION BY g, j) AS pj, max(CASE WHEN j = s + 1 THEN v END) OVER (PARTITION BY g, i) AS ip FROM {tag}r WHERE s < {k}"
    return f"{tag}r AS (SELECT 0 AS s, g, i, j, CAST(v AS DOUBLE) AS v FROM {source} UNION ALL SELECT s + 1, g, i, j, {value} FROM ({pivots}) AS p),\n{tag} AS (SELECT g, i, j, v FROM {tag}r WHERE s = {k})"


def two_tailed(t: str, dof: str) -> str:
    """p-value of Student's t by the finite sums for whole degrees of freedom."""
    angle = f"atan(abs({t})/sqrt({dof}))"
    even = f"sin({angle})*(SELECT sum(exp(lgamma(z.k + 0.5) - lgamma(0.5) - lgamma(z.k + 1) + 2*z.k*ln(cos({angle})))) FROM (SELECT CAST(unnest(range(CAST({dof} AS BIGINT)//2)) AS DOUBLE) AS k) AS z)"
    odd = f"2/pi()*({angle} + sin({angle})*cos({angle})*coalesce((SELECT sum(exp(lgamma(z.k + 1) + lgamma(1.5) - lgamma(z.k + 1.5) + 2*z.k*ln(cos({angle})))) FROM (SELECT CAST(unnest(range((CAST({dof} AS BIGINT) - 1)//2)) AS DOUBLE) AS k) AS z), 0))"
    return f"(1 - (CASE WHEN CAST({dof} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END))"


def sequential_shuffle(n: str, seed: int) -> str:
    """Recursive CTE ``sh``: list p, the order that the folds' generator (multiplier 1103515245, modulus 2**32, rejection) makes of 0 to n - 1."""
    draw = "(s*1103515245 + 12345) % 4294967296"
    fits = f"{draw} < 4294967295//(i + 1)*(i + 1)"
    j = f"CAST(({draw}) % (i + 1) AS BIGINT)"
    moved = f"list_transform(p, lambda v, k: CASE WHEN k = i + 1 THEN p[{j} + 1] WHEN k = {j} + 1 THEN p[i + 1] ELSE v END)"
    return f"shr AS (SELECT CAST({seed} + 1 AS HUGEINT) AS s, CAST({n} - 1 AS BIGINT) AS i, range({n}) AS p UNION ALL SELECT {draw}, CASE WHEN {fits} THEN i - 1 ELSE i END, CASE WHEN {fits} THEN {moved} ELSE p END FROM shr WHERE i > 0),\nsh AS (SELECT p FROM shr WHERE i = 0 ORDER BY s LIMIT 1)"


def real_shuffles(n: str, count: int, seed: int) -> str:
    """Recursive CTE ``sh``: r (from 0) and list p, consecutive orders of 0 to n - 1 that the permutations' generator (multiplier 1664525, modulus 2**64, 53 bits) makes."""
    draw = "(s*1664525 + 1013904223) % 18446744073709551616"
    j = f"CAST(floor(CAST(({draw})//2048 AS DOUBLE)/9007199254740992*(i + 1)) AS BIGINT)"
    moved = f"list_transform(p, lambda v, k: CASE WHEN k = i + 1 THEN p[{j} + 1] WHEN k = {j} + 1 THEN p[i + 1] ELSE v END)"
    step = f"SELECT {draw}, CASE WHEN i = 1 THEN {n} - 1 ELSE i - 1 END, CASE WHEN i = 1 THEN r + 1 ELSE r END, {moved}, i = 1"
    # a finished order is handed on as it is and the next one starts from 0 to n - 1
    fresh = f"(SELECT s, i, r, CASE WHEN done THEN range({n}) ELSE p END AS p FROM shr WHERE r < {count})"
    return f"shr AS (SELECT CAST({seed} + 1 AS HUGEINT) AS s, CAST({n} - 1 AS BIGINT) AS i, 0 AS r, range({n}) AS p, false AS done UNION ALL {step} FROM {fresh} AS f),\nsh AS (SELECT r - 1 AS r, p FROM shr WHERE done)"


def affine_maps(n: str, count: int, seed: int) -> str:
    """Recursive CTE ``am``: r (from 0), a and b of the permutations of many rows: numbers of the same generator, a drawn until it has no common factor with n, then b."""
    draw = "(s*1664525 + 1013904223) % 18446744073709551616"
    real = f"CAST(({draw})//2048 AS DOUBLE)/9007199254740992"
    a = f"(1 + CAST(floor({real}*({n} - 1)) AS BIGINT))"
    step = f"SELECT {draw}, CASE WHEN a IS NULL THEN r ELSE r + 1 END, CASE WHEN a IS NULL AND gcd({a}, {n}) = 1 THEN {a} END, CASE WHEN a IS NOT NULL THEN a END, CASE WHEN a IS NOT NULL THEN CAST(floor({real}*{n}) AS BIGINT) END FROM amr WHERE r < {count}"
    return f"amr AS (SELECT CAST({seed} + 1 AS HUGEINT) AS s, 0 AS r, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS ua, CAST(NULL AS BIGINT) AS ub UNION ALL {step}),\nam AS (SELECT r - 1 AS r, ua AS a, ub AS b FROM amr WHERE ub IS NOT NULL)"
