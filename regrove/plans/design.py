"""From formula terms to design columns: one-hot factors, interactions, reference levels."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.relation import kind_of
from .formula import Formula, parse_terms


@dataclass(frozen=True)
class DesignColumn:
    """``column`` and ``sql`` say the same; ``factor``: a factor left whole, to be grouped by."""

    name: str
    column: Column
    sql: str
    factor: str | None = None


@dataclass
class ModelMatrix:
    columns: list[DesignColumn]
    levels: dict[str, list] = field(default_factory=dict)

    @property
    def col_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def select_exprs(self) -> list[str]:
        return [c.sql for c in self.columns]


def level_text(level: object) -> str:
    """A level in names of coefficients."""
    if isinstance(level, bool):
        return "TRUE" if level else "FALSE"
    if isinstance(level, float) and level.is_integer():
        return str(int(level))
    return str(level)


#: Levels of a factor that may become columns.
MAX_LEVELS = 10_000


def sql_name(name: str) -> str:
    """A column in SQL text, quoted where it must be."""
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) else f"`{name.replace('`', '``')}`"


def factor_levels(df: DataFrame, names: list[str], given: dict[str, list] | None = None, ref: dict[str, object] | None = None) -> dict[str, list]:
    """Sorted distinct levels over all rows, one job for all factors; ``given`` levels keep their order, a ``ref`` level comes first.

    Levels come to the driver, so a factor with more than MAX_LEVELS raises; at most one level more is held of each.
    """
    given, ref = given or {}, ref or {}
    asked = [n for n in dict.fromkeys(names) if n not in given]
    found = {n: list(given[n]) for n in names if n in given}
    if asked:
        sizes = df.agg(*[F.approx_count_distinct(F.col(f"`{n}`"), 0.02) for n in asked]).first() if len(asked) else []
        for n, size in zip(asked, sizes):
            if size > MAX_LEVELS:
                raise ValueError(f"factor {n!r} has about {size:,} levels, more than {MAX_LEVELS:,}; use it as a fixed effect")
        row = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{n}`"))).alias(f"c{k}") for k, n in enumerate(asked)]).first()
        found |= {n: list(row[k]) for k, n in enumerate(asked)}
    for n, level in ref.items():
        if n in found:
            if level not in found[n]:
                raise ValueError(f"{n!r} has no level {level!r}")
            found[n] = [level, *(x for x in found[n] if x != level)]
    return found


def one_hot(name: str, level: object) -> DesignColumn:
    text = level_text(level) if isinstance(level, bool) else str(level).replace("'", "''")
    sql = f"CASE WHEN {sql_name(name)} = {str(level).lower() if isinstance(level, bool) else f"'{text}'" if isinstance(level, str) else level} THEN 1.0 ELSE 0.0 END"
    return DesignColumn(f"{name}{level_text(level)}", F.when(F.col(f"`{name}`") == F.lit(level), 1.0).otherwise(0.0), sql)


def _expanded(df: DataFrame, name: str, kinds: dict[str, str], levels: dict[str, list], drop_reference: bool) -> list[DesignColumn]:
    if kinds[name] != "factor":
        return [DesignColumn(name, F.col(f"`{name}`").cast("double"), sql_name(name))]
    own = levels[name]
    if len(own) < 2:
        return [DesignColumn(f"{name}_constant", F.lit(1.0), "1")]
    return [one_hot(name, x) for x in own[drop_reference:]]


def model_matrix(formula: Formula | str, df: DataFrame, *, expand: str = "all", sep: str = ":", fe_vars: tuple[str, ...] = (), levels: dict[str, list] | None = None, ref: dict[str, object] | None = None) -> ModelMatrix:
    """The design columns of a formula's right side (an outcome is ignored).

    ``expand``: "all", or "interactions", which leaves factors of main effects whole. Of an interaction a factor keeps all its levels
    unless it is a fixed effect or the rest of the interaction is a term itself.
    """
    if expand not in ("all", "interactions"):
        raise ValueError("expand is 'all' or 'interactions'")
    if isinstance(formula, str):
        right = formula.partition("~")[2] if "~" in formula else formula
        formula = Formula(None, parse_terms(right.partition("|")[0])[0])
    kinds = {v: kind_of(df, v) for v in formula.variables}
    for v, k in kinds.items():
        if k == "other":
            raise ValueError(f"{v!r} is a date or time; use it as a fixed effect or cluster, or compute a number from it")
    wanted = [v for t in formula.terms for v in t if kinds[v] == "factor" and (expand == "all" or len(t) > 1)]
    known = factor_levels(df, wanted, levels, ref)
    labels = {frozenset(t) for t in formula.terms} | {frozenset([f]) for f in fe_vars}
    out: list[DesignColumn] = []
    for term in formula.terms:
        if len(term) == 1:
            v = term[0]
            if kinds[v] == "factor" and expand == "interactions":
                out.append(DesignColumn(v, F.col(f"`{v}`"), sql_name(v), factor=v))
            else:
                out += _expanded(df, v, kinds, known, True)
            continue
        parts = [_expanded(df, v, kinds, known, v in fe_vars or frozenset(set(term) - {v}) in labels) for v in term]
        for chosen in product(*parts):
            column = chosen[0].column
            for c in chosen[1:]:
                column = column * c.column
            out.append(DesignColumn(sep.join(c.name for c in chosen), column, " * ".join(f"({c.sql})" for c in chosen)))
    return ModelMatrix(out, known)
