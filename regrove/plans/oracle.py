"""DuckDB SQL that solves a regression by Gauss-Jordan elimination: an independent check on the engine."""

from __future__ import annotations


def solved_ctes(rows: str, p: int) -> str:
    """CTEs t (x, y, g), gj, fit (inv, beta, n), res (x, e, g) from ``rows``: a SELECT of x (DOUBLE[]), y and g."""
    return f"""t AS ({rows}),
gram AS (SELECT i, j, sum(list_append(x, y)[i] * list_append(x, y)[j]) AS v FROM t, range(1, {p + 2}) a(i), range(1, {p + 2}) b(j) GROUP BY i, j),
lines AS (SELECT i, list(v ORDER BY j) AS r FROM gram WHERE i <= {p} GROUP BY i),
aug AS (SELECT list(list_concat(r[1:{p}], [CASE WHEN i = u THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR u IN range(1, {p + 1})], [r[{p + 1}]]) ORDER BY i) AS m FROM lines),
gj(k, m) AS (SELECT 0, m FROM aug UNION ALL
  SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda x: x / row[k + 1])
    ELSE list_transform(row, lambda x, j: x - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM gj WHERE k < {p}),
fit AS (SELECT list_transform(m, lambda row: row[{p + 1}:{2 * p}]) AS inv, list_transform(m, lambda row: row[{2 * p + 1}]) AS beta, (SELECT count(*) FROM t) AS n FROM gj WHERE k = {p}),
res AS (SELECT x, y, g, y - list_sum(list_transform(x, lambda v, i: v * beta[i])) AS e FROM t, fit)"""


def regression_sql(rows: str, names: list[str], *, vcov: str = "iid", extra: str = "0", k: str | None = None, digits: int = 4, before: str = "") -> str:
    """term, estimate, std_error. ``extra``: what else than coefficients takes degrees of freedom; ``k``: parameters that count for clusters."""
    p = len(names)
    meat = {
        "iid": "SELECT i, j, 0.0::DOUBLE AS v FROM range(1, 2) a(i), range(1, 2) b(j)",
        "hc1": f"SELECT i, j, sum(e * e * x[i] * x[j]) AS v FROM res, range(1, {p + 1}) a(i), range(1, {p + 1}) b(j) GROUP BY i, j",
        "cluster": f"SELECT a.i, b.i AS j, sum(a.s * b.s) AS v FROM sc a JOIN sc b USING (g) GROUP BY a.i, b.i",
    }[vcov]
    scale = {
        "iid": "1",
        "hc1": f"(n / (n - {p} - ({extra})))",
        "cluster": f"((SELECT count(DISTINCT g) FROM t) / ((SELECT count(DISTINCT g) FROM t) - 1.0) * n / (n - ({k or f'{p} + ({extra})'})))",
    }[vcov]
    variance = f"(SELECT sum(e * e) FROM res) / (n - {p} - ({extra})) * inv[u][u]" if vcov == "iid" else f"{scale} * (SELECT sum(inv[u][i] * v * inv[j][u]) FROM meat)"
    labels = ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    return f"""WITH RECURSIVE {before}{solved_ctes(rows, p)},
sc AS (SELECT g, i, sum(e * x[i]) AS s FROM res, range(1, {p + 1}) a(i) GROUP BY g, i),
meat AS ({meat}),
o AS (SELECT u, ([{labels}])[u] AS term, beta[u] AS b, {variance} AS v FROM fit, range(1, {p + 1}) q(u))
SELECT term, round(b, {digits}) + 0.0 AS estimate, round(sqrt(v), {digits}) + 0.0 AS std_error FROM o"""
