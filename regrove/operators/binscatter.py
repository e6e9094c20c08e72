"""Binned scatter plots: bins of a running variable, a regression within and across bins, values by bin with intervals and bands.

Rows never leave the cluster: they get a bin column and are reduced to cells by the regression below.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tdist import t_quantile
from ..plans.formula import Formula, parse_formula
from ..sources.relation import complete_rows, relation
from .regress import parse_vcov, regress
from .result import RegressionResult

#: Rows of a sample at least.
SAMPLE_LEAST = 10_000
#: Rows up to which quantile bins are one window; of more, only where the bins begin is looked for, by counts between so many splitters.
WINDOW_ROWS, SPLITTERS = 1_000_000, 1000


#: Strokes of lines; ground, ink and shade of plots.
DASHES = {"solid": "", "dashed": "6 4", "dotted": "1 4"}
THEMES = {"light": ("white", "#336", "#ccd"), "dark": ("#222", "#9bf", "#446")}


@dataclass
class BinscatterResult:
    points: list[dict] | None
    line: list[dict] | None
    bins: list[dict]
    model: RegressionResult
    opt: dict
    knots: list[float] | None = None

    def frame(self, spark: SparkSession, what: str = "points") -> DataFrame | None:
        """``points``, ``line`` or ``bins`` as a DataFrame."""
        rows = getattr(self, what)
        if rows is None:
            return None
        kinds = {"bin": "int", "id": "int"}
        names = list(rows[0]) if rows else ["bin"]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"`{n}` {kinds.get(n, 'double')}" for n in names))

    def __str__(self) -> str:
        o = self.opt
        out = [f"Binned scatter: {o['formula']}", f"points = {o['points']}, line = {o['line']}, nbins = {o['nbins']} ({o['binspos']})"]
        n = f"Observations: {o['N']:,}"
        return "\n".join([*out, n + (f" (of {o['N_orig']:,})" if o["N"] != o["N_orig"] else "")])

    def svg(self, width: int = 640, height: int = 400, ci: bool = True, cb: bool = True, line: bool = True, kind: str = "pointrange", lty: str = "solid", theme: str = "light") -> str:
        """A plot: band, line (broken between bins where these aren't joined), points with intervals.

        ``kind``: "pointrange", "errorbar" (intervals with caps) or "points"; ``lty``: "solid", "dashed" or "dotted"; ``theme``: "light" or "dark".
        """
        if kind not in ("pointrange", "errorbar", "points") or lty not in DASHES or theme not in THEMES:
            raise ValueError(f"kind is pointrange, errorbar or points, lty one of {', '.join(DASHES)}, theme one of {', '.join(THEMES)}")
        ground, ink, shade = THEMES[theme]
        dashes = f' stroke-dasharray="{DASHES[lty]}"' if DASHES[lty] else ""
        rows = (self.points or []) + (self.line or [])
        ys = [r[k] for r in rows for k in ("fit", "lwr", "upr", "cb_lwr", "cb_upr") if r.get(k) is not None and not math.isnan(r[k])]
        xs = [r["x"] for r in rows]
        if not xs or not ys:
            return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"/>'
        pad = 30
        px = lambda x: pad + (x - min(xs)) / ((max(xs) - min(xs)) or 1) * (width - 2 * pad)
        py = lambda y: height - pad - (y - min(ys)) / ((max(ys) - min(ys)) or 1) * (height - 2 * pad)
        parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><rect width="100%" height="100%" fill="{ground}"/>']
        if cb and self.points and "cb_lwr" in self.points[0]:
            edge = [(px(p["x"]), py(p["cb_upr"])) for p in self.points] + [(px(p["x"]), py(p["cb_lwr"])) for p in reversed(self.points)]
            parts.append(f'<polygon points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in edge)}" fill="{shade}" stroke="none"/>')
        runs: dict[int, list] = {}
        for r in (self.line or []) if line else []:
            runs.setdefault(r["bin"] if self.opt["line"] and self.opt["line"][1] == 0 else 0, []).append((px(r["x"]), py(r["fit"])))
        parts += [f'<polyline points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in run)}" fill="none" stroke="{ink}"{dashes}/>' for run in runs.values()]
        for p in self.points or []:
            if ci and kind != "points" and p.get("lwr") is not None and not math.isnan(p["lwr"]):
                x, low, high = px(p["x"]), py(p["lwr"]), py(p["upr"])
                ends = [(x, low, x, high)] + ([(x - 4, y, x + 4, y) for y in (low, high)] if kind == "errorbar" else [])
                parts += [f'<line x1="{a:.1f}" y1="{b:.1f}" x2="{c:.1f}" y2="{d:.1f}" stroke="{ink}"/>' for a, b, c, d in ends]
            parts.append(f'<circle cx="{px(p["x"]):.1f}" cy="{py(p["fit"]):.1f}" r="3" fill="{ink}"/>')
        return "".join([*parts, "</svg>"])


def ntile_bins(df: DataFrame, x: Column, nbins: int, tie: list[Column] | None = None, *, n_rows: int | None = None, name: str = "bin") -> DataFrame:
    """``df`` with quantile bins 1 to ``nbins``, as NTILE over ``x`` then ``tie`` numbers them.

    Many rows are never ordered: the (x, tie) at which each bin begins is found by counting rows between sampled splitters, again within
    the ranges that hold a beginning until these are small, and rows are compared with the ``nbins`` - 1 beginnings. Of rows that
    agree in x and tie with a beginning, so many go below it as NTILE would put there. ``n_rows`` only decides which way is taken.
    """
    n = df.count() if n_rows is None else n_rows
    order = [x, *(tie or [])]
    if n <= WINDOW_ROWS:
        return df.withColumn(name, F.ntile(nbins).over(Window.orderBy(*order)))
    key = F.struct(*[c.alias(f"k{k}") for k, c in enumerate(order)])
    keys = df.select(key.alias("key"))
    n = keys.count()
    small, extra = divmod(n, nbins)
    starts = sorted({r for k in range(1, nbins) if (r := k * small + min(k, extra)) < n})
    found = _at_ranks(keys, n, starts)
    values = sorted({found[r][0] for r in starts}, key=_nulls_first)
    held = _literals(values, keys.schema["key"].dataType)
    at = {v: k for k, v in enumerate(values)}
    # Of each value, the bins that begin at it, and how many rows that equal it come before each.
    base, splits = [0] * (len(values) + 1), {}
    for r in starts:
        v, before, times = found[r]
        if r > before:
            splits.setdefault(at[v], []).append(r - before)
        else:
            base[at[v]] += 1
    below = [0]  # bins begun before the rows of each place: after k values, then at the value itself
    for k in range(len(values)):
        below.append(below[-1] + base[k] + len(splits.get(k, [])))
    place = _rank(key, held, len(values))  # values at most the key
    exact = F.get(held, place - 1) == key
    numbers = lambda xs: F.array(*[F.lit(int(v)) for v in xs])
    tile = F.get(numbers(below), place) + 1
    if not splits:
        return df.withColumn(name, tile.cast("int"))
    # Rows equal to a value within which a bin begins are numbered, in parts, whichever comes first: they agree in all that orders them.
    one, rank = f"{name}__place", f"{name}__rank"
    parts = min(SPLITTERS, max(1, -(-max(found[r][2] for r in starts) // WINDOW_ROWS)))
    part = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(parts)) if parts > 1 else F.lit(0).cast("long")
    is_split = F.get(numbers([int(k in splits) for k in range(len(values))]), place - 1) == 1
    rows = df.withColumns({one: F.when(exact & is_split, place - 1), name: tile.cast("int"), rank: part})
    edge = rows.where(F.col(one).isNotNull())
    counts = {(r[0], r[1]): r[2] for r in edge.groupBy(one, rank).count().collect()}
    offset, total = [], {}
    for k, s in sorted(counts):
        offset.append(F.when((F.col(one) == k) & (F.col(rank) == s), F.lit(total.get(k, 0))))
        total[k] = total.get(k, 0) + counts[k, s]
    number = F.row_number().over(Window.partitionBy(one, rank).orderBy(F.lit(0))) - 1 + F.coalesce(*offset, F.lit(0))
    late = F.lit(0)  # bins that begin within the equal rows, after this one
    edge = edge.withColumn(rank, number)
    for k, cuts in splits.items():
        late = F.when(F.col(one) == k, sum((F.when(F.col(rank) < c, 1).otherwise(0) for c in cuts), F.lit(0))).otherwise(late)
    edge = edge.withColumn(name, (F.col(name) - late).cast("int"))
    return rows.where(F.col(one).isNull()).drop(one, rank).unionByName(edge.drop(one, rank))


def _nulls_first(v: tuple) -> tuple:
    return tuple((x is not None, x) for x in v)


def _literals(values: list, kind: T.DataType) -> Column:
    """An array of structs, folded to one literal."""
    row = lambda v: F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(v, kind.fields)])
    return F.array(*[row(v) for v in values])


def _rank(key: Column, held: Column, n: int) -> Column:
    """How many of the ``n`` ascending values are at most the key: a binary search inside the row."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    fits = lambda at, step: (at + step <= n) & (F.get(held, at + step - 1) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def _at_ranks(keys: DataFrame, n: int, ranks: list[int]) -> dict[int, tuple]:
    """Of each rank from 0 among the ``n`` keys: (the key there, keys before it, keys equal to it)."""
    if not ranks:
        return {}
    if n <= WINDOW_ROWS:
        so_far = F.sum("count").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        groups = keys.groupBy("key").count().withColumn("upto", so_far)
        wanted = F.array(*[F.lit(r).cast("long") for r in ranks])
        rows = groups.where(F.exists(wanted, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("count")))).collect()
        return {r: (tuple(x["key"]), x["upto"] - x["count"], x["count"]) for x in rows for r in ranks if x["upto"] - x["count"] <= r < x["upto"]}
    many = max(SPLITTERS, 4 * len(ranks))
    drawn = sorted({tuple(r["key"]) for r in keys.sample(min(1.0, 4 * many / n), seed=n % 1000).collect()}, key=_nulls_first)
    splitters = drawn[:: max(1, len(drawn) // many)]
    if not splitters:
        raise RuntimeError("no splitters were drawn")
    held = _literals(splitters, keys.schema["key"].dataType)
    place = _rank(F.col("key"), held, len(splitters))
    # Even places lie between splitters, odd ones are those equal to one.
    place = 2 * place - F.when(F.get(held, place - 1) == F.col("key"), 1).otherwise(0)
    placed = keys.select("key", place.alias("place"))
    counts = {r[0]: r[1] for r in placed.groupBy("place").count().collect()}
    out, open_, before, inside = {}, {}, 0, 0
    left = list(ranks)
    for k in sorted(counts):
        mine = [r for r in left if before <= r < before + counts[k]]
        if mine and k % 2:
            out |= {r: (splitters[k // 2], before, counts[k]) for r in mine}
        elif mine:
            open_[k] = (before - inside, mine)
            inside += counts[k]
        before += counts[k]
    if open_:
        if inside == n:
            raise RuntimeError("splitters do not tell the rows apart")
        shift = {r - off: (r, off) for off, mine in open_.values() for r in mine}
        deeper = _at_ranks(placed.where(F.col("place").isin(list(open_))).select("key"), inside, sorted(shift))
        for low, (key, first, times) in deeper.items():
            r, off = shift[low]
            out[r] = (key, first + off, times)
    return out


def equal_width_bins(x: Column, low: float, high: float, nbins: int) -> Column:
    """Bins 1 to ``nbins`` of equal width over [low, high]; one bin where all x are equal."""
    if high <= low:
        return F.when(x.isNotNull(), F.lit(1))
    return F.least(F.lit(nbins), F.floor((x - F.lit(low)) / F.lit((high - low) / nbins)) + 1).cast("int")


def manual_bins(x: Column, breaks: list[float]) -> Column:
    """Bins between breaks, closed on the left, the last on both sides; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(breaks) - 1):
        upper = x <= F.lit(breaks[k + 1]) if k == len(breaks) - 2 else x < F.lit(breaks[k + 1])
        out = F.when((x >= F.lit(breaks[k])) & upper, F.lit(k + 1)).otherwise(out)
    return out


def log_breaks(low: float, high: float, nbins: int) -> list[float]:
    """Breaks of equal width in logarithms, for positive x."""
    return [math.exp(v) for v in np.linspace(math.log(low), math.log(high), nbins + 1)]


def bin_geometry(df: DataFrame, x: str, name: str = "bin") -> DataFrame:
    """(bin, x_left, x_right, x_mid, x_mean, n), in order of bins."""
    v = F.col(f"`{x}`").cast("double")
    g = df.groupBy(name).agg(F.min(v).alias("x_left"), F.max(v).alias("x_right"), F.avg(v).alias("x_mean"), F.count("*").alias("n"))
    return g.select(name, "x_left", "x_right", ((F.col("x_left") + F.col("x_right")) / 2).alias("x_mid"), "x_mean", "n").orderBy(name)


def _order(spec: Any, what: str) -> tuple[int, int] | None:
    """(p, s), or None for "not asked for"."""
    if spec is None or spec is False:
        return None
    p, s = (0, 0) if spec is True else tuple(spec)
    if not (p == int(p) and s == int(s) and p >= 0 and s >= 0):
        raise ValueError(f"{what} is a pair of degree and smoothness, not negative")
    if s > p:
        raise ValueError(f"{what}: smoothness is at most the degree")
    return int(p), int(s)


def free_prefix(columns: Iterable[str], names: Iterable[str]) -> str:
    taken, names, prefix = {c.lower() for c in columns}, list(names), ""
    while any(prefix + n.lower() in taken for n in names):
        prefix += "_"
    return prefix


@dataclass
class _Inputs:
    formula: Formula
    rows: DataFrame
    x: str
    controls: list[str]
    vcov: str | None
    cluster: str | None
    ci: bool
    cb: bool
    level: float
    linegrid: int
    nsims: int
    strategy: str
    seed: int
    bin: str = "bin"
    opt: dict = field(default_factory=dict)

    def free(self, names: Iterable[str]) -> str:
        """What goes before ``names`` so that no column of the rows has one of them: nothing, or underscores."""
        return free_prefix(self.rows.columns, names)


def binscatter(
    formula: str,
    spark: SparkSession | None = None,
    *,
    table: Any = None,
    data: Any = None,
    path: str | None = None,
    points: Any = (0, 0),
    line: Any = None,
    linegrid: int = 20,
    nbins: int = 20,
    binspos: Any = "qs",
    randcut: float | None = None,
    sample_fit: bool = False,
    ci: bool = True,
    cb: bool = False,
    vcov: str | None = None,
    cluster: str | None = None,
    level: float = 0.95,
    nsims: int = 500,
    strategy: str = "auto",
    tie: list[str] | None = None,
    seed: int = 1,
    verbose: bool = False,
    dots: Any = None,
) -> BinscatterResult:
    """``y ~ x + controls | fe``: x is binned; ``points`` and ``line`` are (degree, smoothness).

    Smoothness 0: a polynomial of its own in every bin; above: a spline with so many continuous derivatives less one. Values are at controls of 0 and
    reference levels of fixed effects. ``binspos``: "qs" quantiles, "es" equal widths, "log" equal widths of logarithms, or inner knots. ``tie``: columns that order equal x.
    All rows are used, unless ``randcut`` asks for quantile breaks on a sample of that share (SAMPLE_LEAST rows at least) and ``sample_fit`` for fits on it too.
    Columns that are added get underscores before their names where the input has such names.
    """
    if dots is not None:
        warnings.warn("dots is superseded by points", DeprecationWarning, stacklevel=2)
        points = dots
    p, ln = _order(points, "points"), _order(line, "line")
    if p is None and ln is None:
        raise ValueError("ask for points, a line, or both")
    if not 0 < level < 1:
        raise ValueError("level lies between 0 and 1")
    if nbins != int(nbins) or nbins < 1:
        raise ValueError("nbins is a positive whole number")
    if linegrid != int(linegrid) or linegrid < 2:
        raise ValueError("linegrid is a whole number of at least 2")
    if randcut is not None and not 0 < randcut <= 1:
        raise ValueError("randcut lies above 0 and at most at 1")
    parsed = parse_formula(formula)
    if parsed.has_interactions:
        raise ValueError("binned scatters take no interactions")
    x, *controls = [t[0] for t in parsed.terms]
    if ci and vcov is None and cluster is None:
        vcov = "hc1"
    parse_vcov(vcov, cluster)
    df = complete_rows(relation(spark, table=table, data=data, path=path), list(dict.fromkeys([parsed.outcome, x, *controls, *parsed.fe])))
    keep = list(dict.fromkeys([parsed.outcome, x, *controls, *parsed.fe, *(tie or []), *([parse_vcov(vcov, cluster)[1]] if parse_vcov(vcov, cluster)[1] else [])]))
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    xc = F.col(f"`{x}`").cast("double")
    n, distinct, low, high = df.agg(F.count("*"), F.countDistinct(xc), F.min(xc), F.max(xc)).first()
    if not n:
        raise ValueError("no complete rows")
    if nbins > distinct and not isinstance(binspos, (list, tuple)):
        warnings.warn(f"nbins ({nbins}) is above the number of values of {x!r} ({distinct})", stacklevel=2)
    share = 1.0 if randcut is None else randcut
    size = max(SAMPLE_LEAST, math.ceil(n * share))
    sampled = size < n and share < 1.0
    bin_ = f"{free_prefix(df.columns, ['bin'])}bin"
    sample = df.sample(min(1.0, size / n), seed) if sampled else df
    if sampled and sample_fit:
        df = sample
    if isinstance(binspos, (list, tuple)):
        inner = sorted({float(k) for k in binspos if low < k < high})
        rows = df.withColumn(bin_, manual_bins(xc, [low, *inner, high]))
    elif binspos in ("es", "log"):
        if binspos == "log" and low <= 0:
            raise ValueError("log bins take positive values")
        rows = df.withColumn(bin_, equal_width_bins(xc, low, high, nbins)) if binspos == "es" else df.withColumn(bin_, manual_bins(xc, log_breaks(low, high, nbins)))
    elif binspos == "qs":
        if sampled:
            cuts = sample.agg(F.percentile(xc, F.lit([k / nbins for k in range(1, nbins)])) if nbins > 1 else F.array()).first()[0]
            rows = df.withColumn(bin_, manual_bins(xc, [low, *sorted({c for c in cuts if low < c < high}), high]))
        else:
            rows = ntile_bins(df, xc, nbins, [F.col(f"`{t}`") for t in tie or keep], n_rows=n, name=bin_)
    else:
        raise ValueError("binspos is 'qs', 'es', 'log' or a list of knots")
    # Binned once: bin geometry, each fit and each robust pass read these rows.
    rows = rows.where(F.col(bin_).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    opt = {"points": p, "line": ln, "binspos": binspos, "N_orig": n, "x_var": x, "y_var": parsed.outcome, "formula": formula, "level": level, "ci": ci, "cb": cb, "vcov": vcov or "iid"}
    inputs = _Inputs(parsed, rows, x, controls, vcov if ci or cluster else "iid", cluster, ci, cb, level, linegrid, nsims, strategy, seed, bin_, opt)
    try:
        geo = [{("bin" if k == bin_ else k): v for k, v in r.asDict().items()} for r in bin_geometry(rows, x, bin_).collect()]
        first = p or ln
        result = _fitted(inputs, geo, first, p is not None, ln is not None and (p is None or ln == p))
        if p is not None and ln is not None and ln != p:
            other = _fitted(inputs, geo, ln, False, True)
            result.line = other.line
    finally:
        rows.unpersist()
    return result


def _fitted(inputs: _Inputs, geo: list[dict], order: tuple[int, int], with_points: bool, with_line: bool) -> BinscatterResult:
    degree, smooth = order
    if smooth == 0:
        geo = [g for g in geo if g["n"] >= degree + 1]
        return _unconstrained(inputs, geo, degree, with_points, with_line)
    return _spline(inputs, geo, degree, smooth, with_points, with_line)


def _unconstrained(inputs: _Inputs, geo: list[dict], degree: int, with_points: bool, with_line: bool) -> BinscatterResult:
    x, y = F.col(f"`{inputs.x}`").cast("double"), inputs.formula.outcome
    rows = inputs.rows.where(F.col(inputs.bin).isin([g["bin"] for g in geo]))
    terms: list[str] = []
    added: dict[str, Column] = {}
    own = inputs.free(["bin_one", *(n for g in geo for n in (f"bin_{g['bin']}", *(f"u{d}_{g['bin']}" for d in range(1, degree + 1))))])
    for k, g in enumerate(geo):
        b, h = g["bin"], g["x_right"] - g["x_left"]
        if k:
            added[f"{own}bin_{b}"] = F.when(F.col(inputs.bin) == b, 1.0).otherwise(0.0)
            terms.append(f"{own}bin_{b}")
        if h <= 0:
            continue
        for d in range(1, degree + 1):
            u = (x - F.lit(g["x_left"])) / F.lit(h)
            power = u
            for _ in range(d - 1):
                power = power * u
            added[f"{own}u{d}_{b}"] = F.when(F.col(inputs.bin) == b, power).otherwise(0.0)
            terms.append(f"{own}u{d}_{b}")
    rows = rows.withColumns(added) if added else rows
    all_terms = [*terms, *inputs.controls]
    if not all_terms:  # a single bin of means
        rows = rows.withColumn(f"{own}bin_one", F.lit(0.0))
        all_terms = [f"{own}bin_one"]
    fml = Formula(y, tuple((t,) for t in all_terms), inputs.formula.fe)
    fit = regress(fml, table=rows, vcov=inputs.vcov, cluster=inputs.cluster, strategy="compress" if inputs.strategy == "auto" else inputs.strategy, drop_missings=False)
    first = geo[0]["bin"] if geo else None

    def vector(value: float, g: dict) -> dict[str, float]:
        out = {"(Intercept)": 1.0}
        if g["bin"] != first:
            out[f"{own}bin_{g['bin']}"] = 1.0
        h = g["x_right"] - g["x_left"]
        for d in range(1, degree + 1):
            out[f"{own}u{d}_{g['bin']}"] = ((value - g["x_left"]) / h) ** d if h > 0 else 0.0
        return out

    return _output(inputs, fit, geo, vector, with_points, with_line, band=True)


def _spline(inputs: _Inputs, geo: list[dict], degree: int, smooth: int, with_points: bool, with_line: bool) -> BinscatterResult:
    if inputs.cb:
        warnings.warn("confidence bands are for smoothness 0; cb is ignored", stacklevel=4)
    x = F.col(f"`{inputs.x}`").cast("double")
    knots = [g["x_right"] for g in geo[:-1]]
    own = inputs.free([*(f"x{d}_spline" for d in range(1, degree + 1)), *(f"knot{j}_pow{r}" for j in range(1, len(knots) + 1) for r in range(smooth, degree + 1))])
    added = {f"{own}x{d}_spline": (x if d == 1 else F.pow(x, F.lit(float(d)))) for d in range(1, degree + 1)}
    for j, k in enumerate(knots, 1):
        for r in range(smooth, degree + 1):
            added[f"{own}knot{j}_pow{r}"] = F.when(x > F.lit(k), F.pow(x - F.lit(k), F.lit(float(r)))).otherwise(0.0)
    rows = inputs.rows.withColumns(added)
    fml = Formula(inputs.formula.outcome, tuple((t,) for t in [*added, *inputs.controls]), inputs.formula.fe)
    fit = regress(fml, table=rows, vcov=inputs.vcov, cluster=inputs.cluster, strategy=inputs.strategy, drop_missings=False)

    def vector(value: float, g: dict) -> dict[str, float]:
        out = {"(Intercept)": 1.0} | {f"{own}x{d}_spline": value**d for d in range(1, degree + 1)}
        return out | {f"{own}knot{j}_pow{r}": max(0.0, value - k) ** r for j, k in enumerate(knots, 1) for r in range(smooth, degree + 1)}

    out = _output(inputs, fit, geo, vector, with_points, with_line, band=False)
    out.knots = knots
    return out


def _output(inputs: _Inputs, fit: RegressionResult, geo: list[dict], vector: Any, with_points: bool, with_line: bool, band: bool) -> BinscatterResult:
    place = {n: k for k, n in enumerate(fit.names)}

    def weights(value: float, g: dict) -> np.ndarray:
        w = np.zeros(len(fit.names))
        for n, v in vector(value, g).items():
            if n in place:
                w[place[n]] = v
        return w

    t = t_quantile(1 - (1 - inputs.level) / 2, fit.df_residual)
    points = line = None
    if with_points:
        at = np.array([weights(g["x_mean"], g) for g in geo])
        values = at @ fit.beta
        points = [{"x": g["x_mean"], "bin": g["bin"], "fit": float(v)} for g, v in zip(geo, values)]
        if inputs.ci:
            spread = at @ fit.covariance @ at.T
            variances = np.diag(spread)
            se = np.where(variances > -1e-10, np.sqrt(np.maximum(variances, 0.0)), np.nan)
            for row, s in zip(points, se):
                row |= {"se": float(s), "lwr": row["fit"] - t * float(s), "upr": row["fit"] + t * float(s)}
            if inputs.cb and band:
                rng = np.random.default_rng(inputs.seed)
                draws = rng.multivariate_normal(np.zeros(len(geo)), (spread + spread.T) / 2, inputs.nsims, method="eigh")
                with np.errstate(all="ignore"):
                    sup = np.nanmax(np.where(se > 0, np.abs(draws) / se, np.nan), axis=1)
                critical = float(np.quantile(sup, inputs.level))
                for row, s in zip(points, se):
                    row |= {"cb_lwr": row["fit"] - critical * float(s), "cb_upr": row["fit"] + critical * float(s)}
    if with_line:
        line = [{"x": float(v), "bin": g["bin"], "fit": float(weights(v, g) @ fit.beta)} for g in geo for v in np.linspace(g["x_left"], g["x_right"], inputs.linegrid)]
    bins = [{"id": g["bin"], "left": g["x_left"], "right": g["x_right"]} for g in geo]
    opt = inputs.opt | {"nbins": len(geo), "N": sum(g["n"] for g in geo)}
    return BinscatterResult(points, line, bins, fit, opt)
