"""The reduction of each strategy as SQL text that Spark SQL runs too."""

from __future__ import annotations

from .design import ModelMatrix
from .formula import Formula


def strategy_sql(strategy: str, formula: Formula, matrix: ModelMatrix, source: str, needed: list[str], numeric: list[str] = ()) -> str:
    """One statement; ``source``: the table that stands after FROM; rows with a null in ``needed`` are dropped.

    ``numeric``: the numeric variables of the formula, whose group means a Mundlak model has. Sums are named by the places of the model's
    columns: sum_x1, sum_x1_y, sum_x1_x2; in a Mundlak model the means follow the regressors, by variable, then fixed effect.
    """
    q = lambda n: f"`{n}`"
    x = [(f"x{k}", c.sql) for k, c in enumerate(matrix.columns, 1)]
    where = " WHERE " + " AND ".join(f"{q(n)} IS NOT NULL" for n in needed) if needed else ""
    fe = [(f"fe{k}", f) for k, f in enumerate(formula.fe, 1)]
    y = f"CAST({q(formula.outcome)} AS DOUBLE) AS y"
    if strategy == "compress":
        keys = [*(f"{sql} AS {q(c.name)}" for (_, sql), c in zip(x, matrix.columns)), *(q(f) for f in formula.fe)]
        names = ", ".join([*(q(c.name) for c in matrix.columns), *(q(f) for f in formula.fe)])
        return (
            f"WITH base AS (SELECT {', '.join(keys)}, {y} FROM {source}{where}),\n"
            f"cte AS (SELECT {names}, COUNT(*) AS n, SUM(y) AS sum_Y, SUM(y * y) AS sum_Y_sq FROM base GROUP BY {names})\n"
            f"SELECT *, sum_Y / n AS mean_Y, SQRT(n) AS wts FROM cte"
        )
    base = f"base AS (SELECT {', '.join([*(f'CAST({sql} AS DOUBLE) AS {n}' for n, sql in x), y, *(f'{q(f)} AS {n}' for n, f in fe)])} FROM {source}{where})"
    columns = [n for n, _ in x]
    if strategy == "moments":
        return f"WITH {base}\nSELECT {_sums(columns)} FROM base"
    if strategy == "demean":
        both = [*columns, "y"]
        parts = [base]
        for k, (n, _) in enumerate(fe, 1):
            parts.append(f"m{k} AS (SELECT {n}, {', '.join(f'AVG({c}) AS {c}_m{k}' for c in both)} FROM base GROUP BY {n})")
        joins = " ".join(f"JOIN m{k} USING ({n})" for k, (n, _) in enumerate(fe, 1))
        if len(fe) == 1:
            tilde = ", ".join(f"{c} - {c}_m1 AS {c}_tilde" for c in both)
        else:
            parts.append(f"overall AS (SELECT {', '.join(f'AVG({c}) AS {c}_o' for c in both)} FROM base)")
            joins += " CROSS JOIN overall"
            tilde = ", ".join(f"{c} - {c}_m1 - {c}_m2 + {c}_o AS {c}_tilde" for c in both)
        parts.append(f"demeaned AS (SELECT {tilde}, {', '.join(n for n, _ in fe)} FROM base {joins})")
        counts = ", ".join(f"COUNT(DISTINCT {n}) AS n_{n}" for n, _ in fe)
        return "WITH " + ",\n".join(parts) + f"\nSELECT {_sums([f'{c}_tilde' for c in columns], 'y_tilde')}, {counts} FROM demeaned"
    own = [(f"v{k}", v) for k, v in enumerate(numeric, 1)]
    base = base.replace(f" FROM {source}", "".join(f", CAST({q(v)} AS DOUBLE) AS {n}" for n, v in own) + f" FROM {source}", 1)
    parts, joins = [base], ""
    if own:
        for k, (n, _) in enumerate(fe, 1):
            parts.append(f"m{k} AS (SELECT {n}, {', '.join(f'AVG({v}) AS {v}_bar{k}' for v, _ in own)} FROM base GROUP BY {n})")
            joins += f" JOIN m{k} USING ({n})"
    bars = [f"{v}_bar{k}" for v, _ in own for k in range(1, len(fe) + 1)]
    return "WITH " + ",\n".join(parts) + f"\nSELECT {_sums([*columns, *bars])} FROM base{joins}"


def _sums(columns: list[str], y: str = "y") -> str:
    out = ["COUNT(*) AS n_total", f"SUM({y}) AS sum_y", f"SUM({y} * {y}) AS sum_y_sq"]
    for i, a in enumerate(columns):
        out += [f"SUM({a}) AS sum_x{i + 1}", f"SUM({a} * {y}) AS sum_x{i + 1}_y"]
        out += [f"SUM({a} * {b}) AS sum_x{i + 1}_x{j + 1}" for j, b in enumerate(columns[i:], i)]
    return ", ".join(out)
