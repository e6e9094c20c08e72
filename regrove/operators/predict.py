"""Predictions as DataFrame columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tdist import t_quantile
from .gram import Layout
from .result import RegressionResult


def predict(fit: RegressionResult, newdata: DataFrame | None, interval: str = "none", level: float = 0.95) -> DataFrame:
    """``newdata`` with ``fit`` and, for an interval, ``lwr`` and ``upr``.

    Demeaned models add the outcome's group means of ``newdata`` where it has the outcome, else they give deviations within groups; they have no intervals.
    Mundlak models use the regressors' group means of ``newdata``. Unknown levels of a fixed effect have the reference's effect.
    """
    if interval not in ("none", "confidence", "prediction"):
        raise ValueError("interval is 'none', 'confidence' or 'prediction'")
    if newdata is None:
        if fit.data is None:
            raise ValueError("newdata is needed: the model keeps no rows")
        newdata = fit.data
    beta = dict(zip(fit.names, map(float, fit.beta)))
    if fit.strategy == "demean":
        return _within(fit, newdata, beta)
    if fit.strategy == "mundlak":
        columns, rows = _mundlak(fit, newdata)
    else:
        columns, rows = {"(Intercept)": F.lit(1.0), **{c.name: c.column for c in fit.design}}, newdata
    if fit.absorbed is not None:
        return _with_effects(fit, newdata, columns, beta, interval)
    if interval == "none" and not fit.fe_levels:
        return rows.withColumn("fit", _sum(columns, beta)).select(*[F.col(f"`{c}`") for c in newdata.columns], "fit")
    return _scored(fit, newdata, rows, columns, beta, interval, level)


def _with_effects(fit: RegressionResult, newdata: DataFrame, columns: dict[str, Column], beta: dict[str, float], interval: str) -> DataFrame:
    """Levels of the absorbed fixed effect that the model does not know give null."""
    if interval != "none":
        raise ValueError(f"no intervals: the levels of {fit.absorbed!r} are absorbed, and their covariance is not held")
    line = _sum(columns, beta)
    for f, own in fit.fe_levels.items():
        for x in own[1:]:
            line = line + F.when(F.col(f"`{f}`").cast("string") == F.lit(x), F.lit(beta.get(f"{f}{x}", 0.0))).otherwise(0.0)
    rows = newdata.select(F.struct(*[F.col(f"`{c}`") for c in newdata.columns]).alias("row"), line.alias("line"), F.coalesce(F.col(f"`{fit.absorbed}`").cast("string"), F.lit("")).alias("a"))
    return rows.join(fit.effects, "a", "left").select("row.*", (F.col("line") + F.col("effect")).alias("fit"))


def _sum(columns: dict[str, Column], beta: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, c in columns.items():
        if name in beta:
            total = total + c * F.lit(beta[name])
    return total


def _scored(fit: RegressionResult, newdata: DataFrame, rows: DataFrame, columns: dict[str, Column], beta: dict[str, float], interval: str, level: float) -> DataFrame:
    names = [n for n in columns if n != "(Intercept)"]
    levels = list(fit.fe_levels.values())
    layout = Layout(len(names), levels)
    all_names = ["(Intercept)", *names, *(f"{f}{x}" for f, own in fit.fe_levels.items() for x in own[1:])]
    known = {n: k for k, n in enumerate(fit.names)}
    place = [known.get(n, -1) for n in all_names]
    if len([p for p in place if p >= 0]) < len(fit.names):  # levels whose text differs from their name, such as TRUE
        rest = iter([k for k, n in enumerate(fit.names) if n not in all_names])
        place = [p if p >= 0 or k <= len(names) or all_names[k] in fit.collinear else next(rest, -1) for k, p in enumerate(place)]
    b = np.array([fit.beta[p] if p >= 0 else 0.0 for p in place])
    v = np.zeros((layout.p, layout.p))
    has = [k for k, p in enumerate(place) if p >= 0]
    v[np.ix_(has, has)] = fit.covariance[np.ix_([place[k] for k in has], [place[k] for k in has])]
    extra = fit.rss / fit.df_residual if interval == "prediction" else 0.0
    t = t_quantile(1 - (1 - level) / 2, fit.df_residual)
    own = newdata.columns
    out = ["fit", "lwr", "upr"] if interval != "none" else ["fit"]
    frame = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), *[F.coalesce(columns[n].cast("double"), F.lit(float("nan"))).alias(f"x{k}") for k, n in enumerate(names)], *[F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(fit.fe_levels)])
    schema = frame.select("row", *[F.lit(0.0).alias(c) for c in out]).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, batch in layout.blocks(batches):
            fitted = x @ b
            columns = [batch.column("row"), pa.array(fitted)]
            if len(out) == 3:
                half = t * np.sqrt(np.maximum(((x @ v) * x).sum(1), 0.0) + extra)
                columns += [pa.array(fitted - half), pa.array(fitted + half)]
            yield pa.RecordBatch.from_arrays(columns, ["row", *out])

    return frame.mapInArrow(score, schema).select("row.*", *out)


def _mundlak(fit: RegressionResult, newdata: DataFrame) -> tuple[dict[str, Column], DataFrame]:
    columns = {"(Intercept)": F.lit(1.0), **{c.name: c.column for c in fit.design}}
    for name in fit.names:
        for f in fit.fe:
            if name.endswith(f"_bar_{f}") and name not in columns:
                v = name[: -len(f"_bar_{f}")]
                columns[name] = F.avg(F.col(f"`{v}`").cast("double")).over(Window.partitionBy(F.col(f"`{f}`")))
    added = {f"_c{k}": c for k, c in enumerate(columns.values())}
    rows = newdata.withColumns(added)
    return {n: F.col(f"_c{k}") for k, n in enumerate(columns)}, rows


def _within(fit: RegressionResult, newdata: DataFrame, beta: dict[str, float]) -> DataFrame:
    y = fit.formula.outcome
    has = y.lower() in {c.lower() for c in newdata.columns}
    line = _sum({c.name: c.column.cast("double") for c in fit.design}, beta)
    rows = newdata.withColumns({"_line": line, **({"_y": F.col(f"`{y}`").cast("double")} if has else {})})
    means = [Window.partitionBy(F.col(f"`{f}`")) for f in fit.fe]

    def level(c: str) -> Column:
        total = F.lit(0.0)
        for w in means:
            total = total + F.avg(c).over(w)
        return total

    values = ["_line", *(["_y"] if has else [])]
    grand = rows.agg(*[F.avg(c) for c in values]).first() if len(fit.fe) == 2 else [0.0] * len(values)
    out = F.col("_line") - level("_line") + F.lit(grand[0] or 0.0)
    if has:
        out = out + level("_y") - F.lit(grand[1] or 0.0)
    return rows.withColumn("fit", out).select(*[F.col(f"`{c}`") for c in newdata.columns], "fit")
