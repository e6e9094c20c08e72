"""Which strategy estimates a model: by fixed effects, continuous regressors, and how far grouping compresses the rows."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("auto", "compress", "moments", "demean", "mundlak")
ALIASES = {"within": "demean"}


#: Distance from a limit, as a part of it, within which distinct tuples are counted rather than estimated, and the error of the estimate.
NEAR, ESTIMATE = 0.25, 0.03


@dataclass(frozen=True)
class Choice:
    strategy: str
    n_rows: int | None = None
    n_cells: int | None = None  # an estimate, where that is far enough from the limits
    ratio: float | None = None


def distinct_tuples(df: DataFrame, names: list[str]) -> tuple[int, int]:
    """(distinct tuples of the columns, rows), in one job that pre-aggregates before its shuffle."""
    cells = df.groupBy(*[F.col(f"`{n}`") for n in names]).count()
    row = cells.agg(F.count("*"), F.sum("count")).first()
    return row[0], row[1] or 0


def cells_of(df: DataFrame, names: list[str], limits: list[Callable[[int], float]]) -> tuple[int, int]:
    """(distinct tuples, rows): an estimate, by a sketch that is merged without a shuffle, unless it comes near one of ``limits`` (of the rows); then exact."""
    about, rows = df.agg(F.approx_count_distinct(F.xxhash64(*[F.col(f"`{n}`") for n in names]), ESTIMATE), F.count("*")).first()
    if any(abs(about - limit(rows)) <= NEAR * limit(rows) for limit in limits):
        return distinct_tuples(df, names)
    return min(about, rows), rows


def is_balanced(df: DataFrame, unit: str, time: str, *, strict: bool = True) -> bool:
    """Whether all cells of two fixed effects have the same size; ``strict``: and none of them is missing."""
    cells = df.groupBy(F.col(f"`{unit}`").alias("u"), F.col(f"`{time}`").alias("t")).agg(F.count("*").alias("n"))
    row = cells.agg(F.min("n"), F.max("n"), F.count("*"), F.countDistinct("u"), F.countDistinct("t")).first()
    return row[0] == row[1] and (not strict or row[2] == row[3] * row[4])


def nested_levels(df: DataFrame, fe: list[str], cluster: str) -> int:
    """Levels of those fixed effects each level of which lies in one cluster."""
    total = 0
    for f in fe:
        pairs = df.select(F.col(f"`{f}`").alias("f"), F.col(f"`{cluster}`").alias("c")).distinct().groupBy("f").count()
        levels, most = pairs.agg(F.count("f"), F.max("count")).first()
        total += levels if (most or 0) <= 1 else 0
    return total


def is_continuous(df: DataFrame, names: list[str], n_rows: int) -> bool:
    """Whether some numeric column that isn't of integers has over min(50, a fifth of the rows) values."""
    numeric = [f.name for f in df.schema if f.name in names and f.dataType.typeName() in ("double", "float", "decimal")]
    if not numeric:
        return False
    counts = df.agg(*[F.countDistinct(F.col(f"`{n}`")).alias(f"c{k}") for k, n in enumerate(numeric)]).first()
    return any(c > min(50, 0.2 * n_rows) for c in counts)


def choose(df: DataFrame, strategy: str, xvars: list[str], fe: list[str], *, compress_ratio: float | None, compress_nmax: int, in_memory: bool = False, strict_balance: bool = True, verbose: bool = False) -> Choice:
    strategy = ALIASES.get(strategy, strategy)
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    if compress_ratio is None:
        compress_ratio = 0.6 if len(fe) in (1, 2) else 0.01
    if not 0 <= compress_ratio <= 1:
        raise ValueError("compress_ratio lies between 0 and 1")
    if strategy == "moments" and fe:
        warnings.warn("moments takes no fixed effects; compress is used", stacklevel=3)
        return Choice("compress")
    if strategy == "demean" and len(fe) not in (1, 2):
        warnings.warn("demean takes one or two fixed effects; compress is used", stacklevel=3)
        return Choice("compress")
    if strategy == "mundlak" and not fe:
        raise ValueError("mundlak needs at least one fixed effect")
    if strategy != "auto":
        if strategy == "demean" and len(fe) == 2 and verbose and not is_balanced(df, *fe, strict=strict_balance):
            warnings.warn("the panel is unbalanced: double demeaning isn't the two-way fixed-effects estimate", stacklevel=3)
        return Choice(strategy)
    if len(fe) >= 3:
        return Choice("compress")
    cells, rows = cells_of(df, [*dict.fromkeys([*xvars, *fe])], [lambda n: compress_ratio * n, lambda n: compress_nmax])
    ratio = cells / max(rows, 1)
    fails = ratio > compress_ratio or cells > compress_nmax
    if not fe:
        plain = not fails and not (in_memory and is_continuous(df, xvars, rows))
        return Choice("compress" if plain else "moments", rows, cells, ratio)
    if len(fe) == 1 or not fails:
        return Choice("demean" if fails else "compress", rows, cells, ratio)
    if is_balanced(df, *fe, strict=strict_balance):
        return Choice("demean", rows, cells, ratio)
    raise ValueError("two fixed effects on an unbalanced panel that compresses badly: pick strategy='compress' (exact) or 'mundlak'")
