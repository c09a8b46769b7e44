"""SQL of regressions for DuckDB: one regressor after another is taken out of the rest and of the outcome.

With the target taken last, its coefficient is the slope that is left, and a row's part of the coefficient's error is
what is left of the target times the residual over the target's remaining squares; every variance is a sum of
products of those. Nothing here is shared with the moments that the Spark queries use.
"""

from __future__ import annotations

Z = 1.6448536269514722


def partialled(name: str, source: str, keys: list[str], y: str, xs: list[str], target: str, keep: tuple[str, ...] = ("date",), constant: bool = True) -> str:
    """CTEs ending in ``name``: keys, kept columns, n, k, beta, sxx, u and q of complete rows of ``source``."""
    p = f"(PARTITION BY {', '.join(keys)})"
    cols = [y, target, *[x for x in xs if x != target]]
    fixed = ", ".join([*keys, *keep])
    where = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    mean = f" - avg({{c}}) OVER {p}" if constant else ""
    parts = [f"{name}_0 AS (SELECT {fixed}, count(*) OVER {p} AS n, {', '.join(f'{c}{mean.format(c=c)} AS {c}' for c in cols)} FROM {source} WHERE {where})"]
    for j, x in enumerate(cols[2:], 1):
        left = [*cols[:2], *cols[2 + j :]]
        parts.append(f"{name}_{j} AS (SELECT {fixed}, n, {', '.join(f'{c} - coalesce(sum({c} * {x}) OVER {p} / nullif(sum({x} * {x}) OVER {p}, 0), 0) * {x} AS {c}' for c in left)} FROM {name}_{j - 1})")
    last = f"{name}_{len(cols) - 2}"
    parts.append(f"{name}_b AS (SELECT *, sum({target} * {y}) OVER {p} / sum({target} * {target}) OVER {p} AS beta, sum({target} * {target}) OVER {p} AS sxx FROM {last})")
    parts.append(f"{name} AS (SELECT {fixed}, n, {len(xs) + int(constant)} AS k, beta, sxx, {y} - beta * {target} AS u, {target} * ({y} - beta * {target}) / sxx AS q FROM {name}_b)")
    return ", ".join(parts)


def result(name: str, keys: list[str], se: str, bandwidth: str = "0", most: int = 0, cluster: str = "code", order: str = "date", digits: int = 5, extra: str = "") -> str:
    """SELECT keys, beta, se, t, lo, hi, n by the variance ``se``: hac with Bartlett weights, hc0, cluster or classical."""
    k = ", ".join(keys)
    if se == "hac":
        lagged = "".join(f", lag(q, {l}) OVER w AS q{l}" for l in range(1, most + 1))
        terms = "".join(f" + CASE WHEN {l} <= {bandwidth} THEN 2 * (1 - {l} / CAST({bandwidth} + 1 AS DOUBLE)) * coalesce(sum(q * q{l}), 0) ELSE 0 END" for l in range(1, most + 1))
        body = f"SELECT {k}, any_value(beta) AS beta, any_value(n) AS n, sum(q * q){terms} AS v FROM (SELECT *{lagged} FROM {name} WINDOW w AS (PARTITION BY {k} ORDER BY {order})) GROUP BY {k}"
    elif se == "hc0":
        body = f"SELECT {k}, any_value(beta) AS beta, any_value(n) AS n, sum(q * q) AS v FROM {name} GROUP BY {k}"
    elif se == "classical":
        body = f"SELECT {k}, any_value(beta) AS beta, any_value(n) AS n, sum(u * u) / (any_value(n) - any_value(k)) / any_value(sxx) AS v FROM {name} GROUP BY {k}"
    else:
        body = f"SELECT {k}, any_value(beta) AS beta, any_value(n) AS n, sum(s * s) AS v FROM (SELECT {k}, any_value(beta) AS beta, any_value(n) AS n, sum(q) AS s FROM {name} GROUP BY {k}, {cluster}) GROUP BY {k}"
    r = lambda e, a, n=digits: f"round({e}, {n}) AS {a}"
    sd = "sqrt(greatest(v, 0))"
    return f"SELECT {k}, {r('beta', 'beta')}, {r(sd, 'se')}, {r(f'beta / {sd}', 't', digits - 2)}, {r(f'beta - {Z} * {sd}', 'lo')}, {r(f'beta + {Z} * {sd}', 'hi')}, n{extra} FROM ({body})"


def projections(source: str, hs: list[int], n_lags: int, extra: tuple[str, ...] = (), by: str = "code", lagged: tuple[str, ...] = ("x", "y")) -> tuple[str, list[str]]:
    """SELECT of a local projection's rows by horizon, and its regressors, x first."""
    lag = ", ".join(f"lag({c}, {l}) OVER w AS {c}_L{l}" for l in range(1, n_lags + 1) for c in lagged)
    each = [f"SELECT {by}, CAST({h} AS INT) AS h, date, x{''.join(f', {e}' for e in extra)}{', ' + lag if lag else ''}, {f'lead(y, {h}) OVER w' if h else 'y'} - lag(y) OVER w AS dy FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY date)" for h in hs]
    return " UNION ALL ".join(each), ["x", *[f"{c}_L{l}" for l in range(1, n_lags + 1) for c in lagged]]
