"""Linear regression by sufficient statistics: compress, moments, demean and Mundlak strategies."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import independent_columns, solve_normal
from ..plans.design import DesignColumn, factor_levels, level_text, model_matrix
from ..plans.formula import Formula, parse_formula
from ..plans.sqltext import strategy_sql
from ..sources.relation import complete_rows, kind_of, relation
from .gram import EXPRESSION_COLUMNS, Absorbed, Layout, cell_meat, cell_moments, cluster_meat, gram
from .result import RegressionResult
from .strategy import choose, nested_levels

#: Set REGROVE_VERBOSE=1 for messages by default.
#: Columns of a design that are solved as one dense matrix, and cells up to which the driver sums them itself.
DENSE_COLUMNS, LOCAL_CELLS = 2000, 100_000
#: Columns up to which scores of clusters are sums over rows; of more, over cells by cluster.
ROW_SCORES = 24
VERBOSE = os.environ.get("REGROVE_VERBOSE", "") not in ("", "0")


@dataclass
class _Job:
    """One regression on its way."""

    formula: Formula
    df: DataFrame
    vcov: str
    cluster: str | None
    ssc: str
    levels: dict[str, list]
    ref: dict[str, object]
    query: str = ""
    ratio_est: float | None = None

    @property
    def y(self) -> Column:
        return F.col(f"`{self.formula.outcome}`").cast("double")

    def fe_text(self) -> list[Column]:
        return [F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(self.formula.fe)]


def parse_vcov(vcov: str | None, cluster: str | None) -> tuple[str, str | None]:
    """("iid" | "hc1" | "cluster", cluster variable); a ``cluster`` goes before ``vcov``."""
    one_sided = lambda x: x.strip().lstrip("~").strip()
    if cluster is None and isinstance(vcov, str) and vcov.strip().startswith("~"):
        cluster = vcov
    if cluster is not None:
        name = one_sided(cluster)
        if not name or any(c in name for c in "+:*|^"):
            raise ValueError("clusters are levels of a single variable")
        return "cluster", name
    kind = (vcov or "iid").lower()
    if kind not in ("iid", "hc1"):
        raise ValueError("vcov is 'iid', 'hc1' or a one-sided formula such as '~group'")
    return kind, None


def regress(
    formula: str | Formula,
    spark: SparkSession | None = None,
    *,
    table: Any = None,
    data: Any = None,
    path: str | None = None,
    vcov: str | None = None,
    strategy: str = "auto",
    compress_ratio: float | None = None,
    compress_nmax: int = 1_000_000,
    cluster: str | None = None,
    ssc: str = "full",
    sql_only: bool = False,
    data_only: bool = False,
    drop_missings: bool = True,
    verbose: bool | None = None,
    levels: dict[str, list] | None = None,
    ref: dict[str, object] | None = None,
    strict_balance: bool = True,
    query_only: bool | None = None,
) -> RegressionResult | DataFrame | str:
    """Fit ``y ~ x1 + x2:x3 | fe1 + fe2`` on a relation.

    Rows with a null in the outcome, a regressor or a fixed effect are dropped (``drop_missings``), and rows with a null cluster always, with a
    warning; NaN isn't missing. ``sql_only``: the SQL of the reduction; ``data_only``: the reduced data as a DataFrame, not run yet.
    ``levels`` and ``ref`` order a factor's levels; the first is the reference. An intercept is always fitted.
    """
    if query_only is not None:
        warnings.warn("query_only is superseded by sql_only", DeprecationWarning, stacklevel=2)
        sql_only = query_only
    if ssc not in ("full", "nested"):
        raise ValueError("ssc is 'full' or 'nested'")
    verbose = VERBOSE if verbose is None else verbose
    parsed = parse_formula(formula) if isinstance(formula, str) else formula
    if parsed.no_intercept:
        warnings.warn("an intercept is fitted all the same", stacklevel=2)
    kind, group = parse_vcov(vcov, cluster)
    df = relation(spark, table=table, data=data, path=path)
    if kind_of(df, parsed.outcome) == "other":
        raise ValueError(f"outcome {parsed.outcome!r} is not numeric")
    if drop_missings:
        df = complete_rows(df, list(dict.fromkeys([parsed.outcome, *parsed.variables, *parsed.fe])))
    if group is not None:
        kind_of(df, group)
        if not df.where(F.col(f"`{group}`").isNull()).isEmpty():
            warnings.warn(f"rows with a null in {group!r} are dropped", stacklevel=2)
            df = complete_rows(df, [group])
    choice = choose(df, strategy, parsed.variables, list(parsed.fe), compress_ratio=compress_ratio, compress_nmax=compress_nmax, in_memory=data is not None, strict_balance=strict_balance, verbose=verbose)
    if verbose:
        print(f"strategy: {choice.strategy}" + (f" (compression ratio {choice.ratio:.4f}, {choice.n_cells:,} cells)" if choice.ratio is not None else ""))
    job = _Job(parsed, df, kind, group, ssc, levels or {}, ref or {}, ratio_est=choice.ratio)
    matrix = model_matrix(parsed, df, expand="interactions" if choice.strategy == "compress" else "all", fe_vars=parsed.fe, levels=levels, ref=ref)
    source = table if isinstance(table, str) and " " not in table.strip() else "relation"
    needed = list(dict.fromkeys([parsed.outcome, *parsed.variables, *parsed.fe])) if drop_missings else []
    job.query = strategy_sql(choice.strategy, parsed, matrix, source, needed, [v for v in parsed.variables if kind_of(df, v) == "numeric"])
    if sql_only:
        return job.query
    fit = {"compress": _compress, "moments": _moments, "demean": _demean, "mundlak": _mundlak}[choice.strategy]
    return fit(job, matrix.columns, matrix.levels, data_only)


def _covariance(job: _Job, inverse: np.ndarray, meat: np.ndarray | None, rss: float, n: int, df: int, k: int, clusters: int | None) -> np.ndarray:
    if job.vcov == "iid":
        return rss / df * inverse
    if job.vcov == "hc1":
        return n / df * inverse @ meat @ inverse
    if clusters < 2:
        warnings.warn("a single cluster: standard errors are not defined", stacklevel=4)
        return np.full_like(inverse, np.nan)
    return clusters / (clusters - 1) * n / (n - k) * inverse @ meat @ inverse


def _linear(names: list[Column], beta: np.ndarray) -> Column:
    total = F.lit(0.0)
    for c, b in zip(names, beta):
        total = total + c * F.lit(float(b))
    return total


def _row_meat(job: _Job, frame: DataFrame, x: list[Column], y: Column, beta: np.ndarray) -> tuple[np.ndarray | None, int | None, float | None]:
    """(meat, clusters, residual sum of squares) by a second pass, if a robust covariance is asked for."""
    if job.vcov == "iid":
        return None, None, None
    e = y - _linear(x, beta)
    if job.vcov == "hc1":
        m = gram(frame.withColumn("_e", e), [F.col("_e"), *(F.col("_e") * c for c in x)])
        return m[1:, 1:], None, float(m[0, 0])
    scored = frame.withColumn("_e", e).groupBy("g").agg(*[F.sum(F.col("_e") * c).alias(f"s{k}") for k, c in enumerate(x)])
    m = gram(scored, [F.lit(1.0), *(F.col(f"s{k}") for k in range(len(x)))])
    return m[1:, 1:], int(round(m[0, 0])), None


def _kept(xx: np.ndarray, names: list[str]) -> tuple[list[int], list[str]]:
    keep = independent_columns(xx)
    return keep, [n for k, n in enumerate(names) if k not in keep]


def _frame(job: _Job, columns: list[DesignColumn]) -> DataFrame:
    """x0, x1, ..., y, f0, ..., g: only what the model needs."""
    out = [c.column.cast("double").alias(f"x{k}") for k, c in enumerate(columns)] + [job.y.alias("y")]
    out += [F.col(f"`{f}`").alias(f"f{k}") for k, f in enumerate(job.formula.fe)]
    if job.cluster is not None:
        out.append(F.col(f"`{job.cluster}`").alias("g"))
    return job.df.select(*out)


def _moments(job: _Job, columns: list[DesignColumn], levels: dict[str, list], data_only: bool) -> RegressionResult | DataFrame:
    frame = _frame(job, columns)
    x = [F.lit(1.0), *(F.col(f"x{k}") for k in range(len(columns)))]
    if data_only:
        named = [("n_total", F.count("*")), ("sum_y", F.sum("y")), ("sum_y_sq", F.sum(F.col("y") * F.col("y")))]
        for i in range(1, len(x)):
            named += [(f"sum_x{i}", F.sum(x[i])), (f"sum_x{i}_y", F.sum(x[i] * F.col("y")))]
            named += [(f"sum_x{i}_x{j}", F.sum(x[i] * x[j])) for j in range(i, len(x))]
        return frame.agg(*[c.alias(n) for n, c in named])
    return _solved(job, frame, x, ["(Intercept)", *(c.name for c in columns)], [c.name for c in columns], columns, levels, "moments")


def _solved(job: _Job, frame: DataFrame, x: list[Column], names: list[str], regressors: list[str], columns: list[DesignColumn], levels: dict[str, list], strategy: str) -> RegressionResult:
    """Normal equations with an intercept first; columns are centred, so that large means cost no digits."""
    y = F.col("y")
    p = len(x)
    means = np.array([v or 0.0 for v in frame.agg(*[F.avg(c) for c in [*x[1:], y]]).first()])
    centred = [x[0], *(c - F.lit(float(m)) for c, m in zip(x[1:], means)), y - F.lit(float(means[-1]))]
    m = gram(frame, centred)
    n = int(round(m[0, 0]))
    if not n:
        raise ValueError("no complete rows")
    noise = np.concatenate([[0.0], 1e-22 * n * means[:-1] ** 2])
    constant = [k for k in range(1, p) if m[k, k] <= noise[k]]  # rounding is all that is left
    m[constant, :] = m[:, constant] = 0.0
    keep, gone = _kept(m[:p, :p], names)
    xx, xy, yy = m[np.ix_(keep, keep)], m[keep, p], m[p, p]
    beta, inverse = solve_normal(xx, xy)
    df = max(n - len(keep), 1)
    meat, clusters, rss = _row_meat(job, frame, [centred[k] for k in keep], centred[p], beta)
    if rss is None:
        rss = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    nested = nested_levels(job.df, list(job.formula.fe), job.cluster) if job.cluster and job.ssc == "nested" and strategy == "moments" else 0
    covariance = _covariance(job, inverse, meat, rss, n, df, len(keep) - nested, clusters)
    # Back to the columns as they are: only the intercept moves.
    back = np.eye(len(keep))
    if keep[0] == 0:
        back[0, 1:] = [-means[k - 1] for k in keep[1:]]
        beta, covariance = back @ beta, back @ covariance @ back.T
        beta[0] += means[-1]
    kept_names = [names[k] for k in keep]
    return RegressionResult(job.formula, kept_names, beta, covariance, job.vcov, strategy, n, df, rss, float(yy - m[0, p] ** 2 / n), [r for r in regressors if r in kept_names], n_clusters=clusters, collinear=gone, query=job.query, design=columns, levels=levels, compression_ratio_est=job.ratio_est)


def _means(frame: DataFrame, by: str, columns: list[str], prefix: str) -> DataFrame:
    return frame.groupBy(by).agg(*[F.avg(c).alias(f"{prefix}{c}") for c in columns])


def _demean(job: _Job, columns: list[DesignColumn], levels: dict[str, list], data_only: bool) -> RegressionResult | DataFrame:
    frame = _frame(job, columns)
    own = [*(f"x{k}" for k in range(len(columns))), "y"]
    two = len(job.formula.fe) == 2
    p = len(columns)
    if not two and job.vcov == "iid" and not data_only and p + 1 <= EXPRESSION_COLUMNS:
        m, n, n_fe = _within_moments(frame, own)
        tilde = None
    else:
        first = _means(frame, "f0", own, "u_")
        joined = frame.join(first, "f0")
        if two:
            second = _means(frame, "f1", own, "t_")
            grand = frame.agg(*[F.avg(c) for c in own]).first()
            joined = joined.join(second, "f1")
            tilde = [(F.col(c) - F.col(f"u_{c}") - F.col(f"t_{c}") + F.lit(grand[k])).alias(f"d_{c}") for k, c in enumerate(own)]
        else:
            tilde = [(F.col(c) - F.col(f"u_{c}")).alias(f"d_{c}") for c in own]
        joined = joined.select(*tilde, "f0", *(["f1"] if two else []), *(["g"] if job.cluster else []))
        if data_only:
            return joined
        n_fe = [first.count(), *([second.count()] if two else [])]
        d = [F.col(f"d_{c}") for c in own]
        m = gram(joined, [F.lit(1.0), *d])
        n, m = int(round(m[0, 0])), m[1:, 1:]
    if not n:
        raise ValueError("no complete rows")
    names = [c.name for c in columns]
    keep, gone = _kept(m[:p, :p], names)
    # A column that the fixed effects absorb is left with rounding noise.
    plain = gram(frame, [F.col(f"x{k}") for k in range(p)]).diagonal() if p else np.zeros(0)
    absorbed = [k for k in keep if m[k, k] <= 1e-18 * max(plain[k], 1e-300) * 1e4]
    keep = [k for k in keep if k not in absorbed]
    gone = [names[k] for k in range(p) if k not in keep]
    xx, xy, yy = m[np.ix_(keep, keep)], m[keep, p], m[p, p]
    beta, inverse = solve_normal(xx, xy) if keep else (np.zeros(0), np.zeros((0, 0)))
    df_fe = sum(n_fe) - 1 if two else n_fe[0]
    df = max(n - len(keep) - df_fe, 1)
    rss = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    meat, clusters, exact = _row_meat(job, joined, [d[k] for k in keep], d[p], beta) if tilde is not None else (None, None, None)
    rss = exact if exact is not None else rss
    k = len(keep) + df_fe - (nested_levels(job.df, list(job.formula.fe), job.cluster) if job.cluster and job.ssc == "nested" else 0)
    covariance = _covariance(job, inverse, meat, rss, n, df, k, clusters)
    kept_names = [names[j] for j in keep]
    return RegressionResult(job.formula, kept_names, beta, covariance, job.vcov, "demean", n, df, rss, float(yy), kept_names, n_clusters=clusters, collinear=gone, n_fe=n_fe, query=job.query, design=columns, levels=levels, compression_ratio_est=job.ratio_est)


def _within_moments(frame: DataFrame, own: list[str]) -> tuple[np.ndarray, int, list[int]]:
    """(Gram matrix of group-demeaned columns, rows, groups) without joining means to rows: products less sums times sums over size, by group."""
    p = len(own)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    groups = frame.groupBy("f0").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{k}") for k, c in enumerate(own)], *[F.sum(F.col(own[i]) * F.col(own[j])).alias(f"q{i}_{j}") for i, j in pairs])
    row = groups.agg(F.sum("n"), F.count("*"), *[F.sum(F.col(f"q{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) for i, j in pairs]).first()
    m = np.zeros((p, p))
    for (i, j), v in zip(pairs, row[2:]):
        m[i, j] = m[j, i] = v or 0.0
    return m, row[0] or 0, [row[1]]


def _mundlak(job: _Job, columns: list[DesignColumn], levels: dict[str, list], data_only: bool) -> RegressionResult | DataFrame:
    numeric = [v for v in job.formula.variables if kind_of(job.df, v) == "numeric"]
    out = [c.column.cast("double").alias(f"x{k}") for k, c in enumerate(columns)] + [job.y.alias("y")]
    out += [F.col(f"`{v}`").cast("double").alias(f"v{k}") for k, v in enumerate(numeric)]
    out += [F.col(f"`{f}`").alias(f"f{k}") for k, f in enumerate(job.formula.fe)]
    if job.cluster is not None:
        out.append(F.col(f"`{job.cluster}`").alias("g"))
    frame = rows = job.df.select(*out)
    x, names = [F.lit(1.0), *(F.col(f"x{k}") for k in range(len(columns)))], ["(Intercept)", *(c.name for c in columns)]
    for f, label in enumerate(job.formula.fe):
        if numeric:
            frame = frame.join(_means(rows, f"f{f}", [f"v{k}" for k in range(len(numeric))], f"m{f}_"), f"f{f}")
    for k, v in enumerate(numeric):
        for f, label in enumerate(job.formula.fe):
            x.append(F.col(f"m{f}_v{k}"))
            names.append(f"{v}_bar_{label}")
    if data_only:
        return frame.select(*[c.alias(n) for c, n in zip(x, names)], F.col("y").alias(job.formula.outcome))
    return _solved(job, frame, x, names, [c.name for c in columns], columns, levels, "mundlak")


def _compress(job: _Job, columns: list[DesignColumn], levels: dict[str, list], data_only: bool) -> RegressionResult | DataFrame:
    """Group by design columns and fixed effects; the cells stay distributed, and are exact for coefficients, IID and HC1."""
    keys = [c.column.alias(f"k{i}") for i, c in enumerate(columns)] + [F.col(f"`{f}`").alias(f"e{i}") for i, f in enumerate(job.formula.fe)]
    names = [f"k{i}" for i in range(len(columns))] + [f"e{i}" for i in range(len(job.formula.fe))]
    rows = job.df.select(*keys, job.y.alias("y"), *([F.col(f"`{job.cluster}`").alias("g")] if job.cluster else []))
    sums = [F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")]
    grouped = rows.groupBy(*names).agg(*sums)
    labels = [c.name for c in columns] + list(job.formula.fe)
    reduced = grouped.select(*[F.col(k).alias(n) for k, n in zip(names, labels)], "n", F.col("sy").alias("sum_Y"), F.col("syy").alias("sum_Y_sq"), (F.col("sy") / F.col("n")).alias("mean_Y"), F.sqrt("n").alias("wts"))
    if data_only:
        return reduced
    grouped = grouped.persist()
    try:
        fe_names = [f"e{i}" for i in range(len(job.formula.fe))]
        factors = [c.factor for c in columns if c.factor]
        n_cells, *sizes = grouped.agg(F.count("*"), *[F.approx_count_distinct(F.col(f), 0.02) for f in fe_names]).first()
        absorbed = None
        if fe_names and sum(sizes) + len(columns) > DENSE_COLUMNS:
            absorbed = int(np.argmax(sizes))
            if (rest := sum(sizes) - sizes[absorbed]) + len(columns) > DENSE_COLUMNS:
                raise ValueError(f"about {rest:,} levels of fixed effects besides {job.formula.fe[absorbed]!r}, more than the {DENSE_COLUMNS:,} columns that are solved at once; pick another strategy")
        dense_fe = [f for k, f in enumerate(fe_names) if k != absorbed]
        given = {f"e{i}": job.levels[f] for i, f in enumerate(job.formula.fe) if f in job.levels and i != absorbed}
        wanted_ref = {f"e{i}": job.ref[f] for i, f in enumerate(job.formula.fe) if f in job.ref and i != absorbed}
        fe_levels = factor_levels(grouped, dense_fe, given, wanted_ref) if dense_fe else {}
        own_levels = factor_levels(job.df, factors, job.levels, job.ref) if factors else {}
        # Factors of main effects are expanded now, after grouping.
        x: list[Column] = []
        x_names: list[str] = []
        design: list[DesignColumn] = []
        for i, c in enumerate(columns):
            if not c.factor:
                x.append(F.col(f"k{i}").cast("double"))
                x_names.append(c.name)
                design.append(c)
                continue
            found = own_levels[c.factor]
            for level in found[1:] if len(found) > 1 else []:
                x.append(F.when(F.col(f"k{i}") == F.lit(level), 1.0).otherwise(0.0))
                x_names.append(f"{c.name}{level_text(level)}")
                design.append(DesignColumn(x_names[-1], F.when(F.col(f"`{c.factor}`") == F.lit(level), 1.0).otherwise(0.0), ""))
        texts = {f: [_as_text(v) for v in own] for f, own in fe_levels.items()}
        layout = Layout(len(x), [texts[f] for f in dense_fe], intercept=absorbed is None)
        dense = [*(c.alias(f"x{k}") for k, c in enumerate(x)), *(F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(dense_fe))]
        if absorbed is not None:  # a null level, where missing values stay, is a level
            dense.append(F.coalesce(F.col(fe_names[absorbed]).cast("string"), F.lit("")).alias("a"))
        cells = grouped.select(*dense, "n", "sy", "syy")
        by_cluster = rows.groupBy("g", *names).agg(F.count("*").alias("n"), F.sum("y").alias("sy")).select(*dense, "n", "sy", F.col("g").cast("string").alias("g")) if job.vcov == "cluster" else None
        dense_names = [*x_names, *(f"{job.formula.fe[int(e[1:])]}{level_text(v)}" for e in dense_fe for v in fe_levels[e][1:])]
        if absorbed is not None:
            held = Absorbed(cells, layout)
            held.groups = held.groups.persist()
            try:
                return _absorbed(job, held, by_cluster, dense_names, x_names, columns, design, levels | own_levels, absorbed, {job.formula.fe[int(e[1:])]: texts[e] for e in dense_fe}, n_cells, reduced)
            finally:
                held.groups.unpersist()
        summable = cells.toArrow() if n_cells <= LOCAL_CELLS else cells
        xx, xy, (n_rows, sy, syy) = cell_moments(summable, layout)
        n = int(round(n_rows))
        if not n:
            raise ValueError("no complete rows")
        all_names = ["(Intercept)", *dense_names]
        keep, gone = _kept(xx, all_names)
        beta, inverse = solve_normal(xx[np.ix_(keep, keep)], xy[keep])
        full = np.zeros(layout.p)
        full[keep] = beta
        rss, meat = cell_meat(summable, layout, full, job.vcov == "hc1")
        clusters = None
        if by_cluster is not None and layout.p <= ROW_SCORES:
            meat, clusters = _row_scores(rows.select(*dense, "y", "g"), layout, full)
        elif by_cluster is not None:
            meat, clusters = cluster_meat(by_cluster, layout, full)
        meat = meat[np.ix_(keep, keep)]
        df = max(n - len(keep), 1)
        k = len(keep) - (nested_levels(job.df, list(job.formula.fe), job.cluster) if job.cluster and job.ssc == "nested" else 0)
        covariance = _covariance(job, inverse, meat, rss, n, df, k, clusters)
    finally:
        grouped.unpersist()
    kept_names = [all_names[j] for j in keep]
    return RegressionResult(
        job.formula, kept_names, beta, covariance, job.vcov, "compress", n, df, rss, float(syy - sy**2 / n), [r for r in x_names if r in kept_names],
        nobs=n_cells, n_clusters=clusters, collinear=gone, compression_ratio=n_cells / n, compression_ratio_est=job.ratio_est, query=job.query, design=design,
        levels=levels | own_levels, fe_levels={f: texts[e] for f, e in zip(job.formula.fe, fe_names)}, data=reduced,
    )


def _row_scores(rows: DataFrame, layout: Layout, beta: np.ndarray) -> tuple[np.ndarray, int]:
    """As ``cluster_meat``, from rows, each column of the design an expression: one aggregation by cluster, without cells."""
    x = [F.lit(1.0), *(F.col(f"x{k}") for k in range(layout.k))]
    for k, place in enumerate(layout.places):
        x += [F.when(F.col(f"f{k}") == F.lit(level), 1.0).otherwise(0.0) for level in place]
    scored = rows.withColumn("_e", F.col("y") - _linear(x, beta)).groupBy("g").agg(*[F.sum(F.col("_e") * c).alias(f"s{k}") for k, c in enumerate(x)])
    m = gram(scored, [F.lit(1.0), *(F.col(f"s{k}") for k in range(len(x)))])
    return m[1:, 1:], int(round(m[0, 0]))


def _absorbed(job: _Job, held: Absorbed, by_cluster: DataFrame | None, names: list[str], x_names: list[str], columns: list[DesignColumn], design: list[DesignColumn], levels: dict[str, list], absorbed: int, fe_levels: dict[str, list[str]], n_cells: int, reduced: DataFrame) -> RegressionResult:
    """The same model with its largest fixed effect eliminated; its levels, and the intercept, are not among the coefficients."""
    within, whole, (n_rows, sy, syy), n_groups = held.within()
    q = held.layout.p
    n = int(round(n_rows))
    if not n:
        raise ValueError("no complete rows")
    explained = [k for k in range(q) if within[k, k] <= 1e-12 * max(whole[k, k], 1e-300)]  # by the groups
    keep = [k for k in range(q) if k not in explained]
    keep = [keep[k] for k in independent_columns(within[np.ix_(keep, keep)])]
    gone = [names[k] for k in range(q) if k not in keep]
    xx, xy = within[np.ix_(keep, keep)], within[keep, q]
    beta, inverse = solve_normal(xx, xy) if keep else (np.zeros(0), np.zeros((0, 0)))
    full = np.zeros(q)
    full[keep] = beta
    df = max(n - len(keep) - n_groups, 1)
    rss, meat, clusters = float(within[q, q] - 2 * beta @ xy + beta @ xx @ beta), None, None
    if job.vcov == "hc1":
        rss, meat = held.meat(full, True)
    elif by_cluster is not None:
        meat, clusters = held.cluster_meat(by_cluster, full)
    if meat is not None:
        meat = meat[np.ix_(keep, keep)]
    k = len(keep) + n_groups - (nested_levels(job.df, list(job.formula.fe), job.cluster) if job.cluster and job.ssc == "nested" else 0)
    covariance = _covariance(job, inverse, meat, rss, n, df, k, clusters)
    kept_names = [names[j] for j in keep]
    return RegressionResult(
        job.formula, kept_names, beta, covariance, job.vcov, "compress", n, df, rss, float(syy - sy**2 / n), [r for r in x_names if r in kept_names], nobs=n_cells, n_clusters=clusters,
        collinear=gone, compression_ratio=n_cells / n, compression_ratio_est=job.ratio_est, query=job.query, design=design, levels=levels, fe_levels=fe_levels, data=reduced,
        absorbed=job.formula.fe[absorbed], effects=held.effects(full),
    )


def _as_text(level: object) -> str:
    """As Spark casts it to a string."""
    if isinstance(level, bool):
        return str(level).lower()
    if hasattr(level, "isoformat"):
        return str(level)
    return str(level)
