"""DuckDB SQL that computes from values what sketches hold, for the correctness queries."""

from __future__ import annotations

PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def gamma(accuracy: float) -> str:
    return f"(1.0::DOUBLE + 2.0::DOUBLE * {accuracy}::DOUBLE / (1.0::DOUBLE - {accuracy}::DOUBLE))"


def rep(index: str, accuracy: float) -> str:
    g = gamma(accuracy)
    return f"(pow({g}, {index}) * (1.0::DOUBLE + (1.0::DOUBLE - 2.0::DOUBLE / (1.0::DOUBLE + {g}))))"


def bins(source: str, value: str, keys: str = "", accuracy: float = 0.01, rule: str = "ceil") -> str:
    """keys, s, i, c of the values in source (a FROM clause)."""
    k = f"{keys}, " if keys else ""
    v = f"({value})::DOUBLE"
    return f"SELECT {k}sign({v})::INT AS s, CASE WHEN {v} = 0 THEN 0 ELSE {rule}(ln(abs({v})) / ln({gamma(accuracy)}))::INT END AS i, count(*)::DOUBLE AS c FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL"


def _frame(bin_sql: str, keys: str) -> str:
    names = [k.split(" AS ")[-1].strip() for k in keys.split(",")] if keys else []
    k = ", ".join(names)
    by = f"{k}, " if k else ""
    return f"""
b AS ({bin_sql}),
w AS (SELECT *, sum(c) OVER (PARTITION BY {by}s ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum FROM b),
t AS (SELECT {by}sum(c) AS n, coalesce(sum(c) FILTER (s < 0), 0) AS nn, coalesce(sum(c) FILTER (s = 0), 0) AS nz FROM b{f" GROUP BY {k}" if k else ""}),
q AS (SELECT *, q * (n - 1) AS r FROM t, (SELECT unnest([{{qs}}])::DOUBLE AS q)),
j AS (SELECT {", ".join("q." + x for x in names) + ", " if names else ""}q.q, q.r, q.nn, q.nz,
  min(w.i) FILTER (w.s < 0 AND w.cum > greatest(q.nn - 1 - q.r, 0)) AS ineg,
  min(w.i) FILTER (w.s > 0 AND w.cum > greatest(q.r - q.nz - q.nn, 0)) AS ipos, max(w.i) FILTER (w.s > 0) AS xpos
  FROM q {f"JOIN w USING ({k})" if k else ", w"} GROUP BY ALL),
v AS (SELECT {by}q, CASE WHEN r < nn THEN -{{ineg}} WHEN r < nn + nz THEN 0 WHEN xpos IS NULL THEN 0 ELSE {{ipos}} END AS value FROM j)"""


def _filled(bin_sql: str, keys: str, quantiles: list[float], accuracy: float) -> str:
    return _frame(bin_sql, keys).format(qs=", ".join(map(str, quantiles)), ineg=rep("ineg", accuracy), ipos=rep("coalesce(ipos, xpos)", accuracy))


def quantiles(bin_sql: str, keys: str, qs: list[float], accuracy: float = 0.01) -> str:
    """keys, q, value (6 places)."""
    names = ", ".join(k.split(" AS ")[-1].strip() for k in keys.split(",")) + ", " if keys else ""
    return f"WITH {_filled(bin_sql, keys, qs, accuracy)}\nSELECT {names}q, round(value, 6) AS value FROM v"


def stats(bin_sql: str, keys: str, accuracy: float = 0.01, percentiles: bool = True) -> str:
    """keys, count, sum (2 places), avg, min, max and the six percentiles (6 places)."""
    names = ", ".join(k.split(" AS ")[-1].strip() for k in keys.split(",")) if keys else ""
    by = f"{names}, " if names else ""
    value = f"s * CASE WHEN s = 0 THEN 0 ELSE {rep('i', accuracy)} END"
    summary = f"s1 AS (SELECT {by}sum(c)::BIGINT AS n, sum({value} * c) AS total, min({value}) AS low, max({value}) AS high FROM b{f' GROUP BY {names}' if names else ''})"
    wide = ", ".join(f"max(value) FILTER (q = {q}) AS {p}" for p, q in PERCENTILES.items())
    pivot = f"p AS (SELECT {by}{wide} FROM v{f' GROUP BY {names}' if names else ''})"
    rounded = ", ".join(f"round({p}, 6) AS {p}" for p in PERCENTILES)
    head = f"WITH {_filled(bin_sql, keys, list(PERCENTILES.values()), accuracy)}, {summary}, {pivot}"
    join = f"s1 JOIN p USING ({names})" if names else "s1, p"
    return f"{head}\nSELECT {by}n AS count, round(total, 2) AS sum, round(total / n, 6) AS avg, round(low, 6) AS min, round(high, 6) AS max{', ' + rounded if percentiles else ''} FROM {join}"
