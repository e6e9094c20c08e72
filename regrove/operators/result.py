"""What a regression returns."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.tdist import p_two_sided, t_quantile
from ..plans.design import DesignColumn
from ..plans.formula import Formula

STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "."))
LABELS = {"iid": "IID", "hc1": "Heteroskedasticity-robust"}


@dataclass
class RegressionResult:
    formula: Formula
    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    vcov_type: str
    strategy: str
    nobs_orig: int
    df_residual: int
    rss: float
    tss: float
    regressors: list[str]  # names of coefficients that are regressor terms
    nobs: int = 1
    n_clusters: int | None = None
    collinear: list[str] = field(default_factory=list)
    n_fe: list[int] = field(default_factory=list)
    compression_ratio: float | None = None
    compression_ratio_est: float | None = None
    query: str = ""
    design: list[DesignColumn] = field(default_factory=list)
    levels: dict[str, list] = field(default_factory=dict)
    fe_levels: dict[str, list[str]] = field(default_factory=dict)
    data: DataFrame | None = None  # compressed rows, of strategy compress
    absorbed: str | None = None  # a fixed effect of too many levels for coefficients; ``effects``: (a, effect) of its levels
    effects: DataFrame | None = None

    @property
    def fe(self) -> tuple[str, ...]:
        return self.formula.fe

    def shown(self, fe: bool = False, fes: bool | None = None) -> list[int]:
        """Places of coefficients: all without fixed effects or with ``fe``, else those of regressor terms only."""
        if fes is not None:
            warnings.warn("fes is superseded by fe", DeprecationWarning, stacklevel=3)
            fe = fes
        own = set(self.regressors)
        return [k for k, n in enumerate(self.names) if fe or not self.fe or n in own]

    def coef(self, fe: bool = False, fes: bool | None = None) -> dict[str, float]:
        return {self.names[k]: float(self.beta[k]) for k in self.shown(fe, fes)}

    def vcov(self) -> np.ndarray:
        return self.covariance

    def std_errors(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance), 0.0))

    def confint(self, parm: list[str] | str | None = None, level: float = 0.95, fe: bool = False, fes: bool | None = None) -> dict[str, tuple[float, float]]:
        """Bounds b -+ t * se by name."""
        t, se = t_quantile(1 - (1 - level) / 2, self.df_residual), self.std_errors()
        wanted = [parm] if isinstance(parm, str) else parm
        places = self.shown(fe, fes) if wanted is None else [self.names.index(p) for p in wanted]
        return {self.names[k]: (float(self.beta[k] - t * se[k]), float(self.beta[k] + t * se[k])) for k in places}

    def gof(self) -> dict[str, float]:
        """R squared (within, for demean), adjusted, and root mean squared error."""
        n, df = self.nobs_orig, self.df_residual
        r2 = 1 - self.rss / self.tss if self.tss else math.nan
        adjusted = 1 - (self.rss / df) / (self.tss / (n - 1)) if self.tss and n > 1 else math.nan
        return {"r2": r2, "adj_r2": adjusted, "rmse": math.sqrt(max(self.rss, 0.0) / n) if n else math.nan}

    def tidy_rows(self, conf_int: bool = False, conf_level: float = 0.95, fe: bool = False, fes: bool | None = None) -> list[dict]:
        se, bounds = self.std_errors(), self.confint(level=conf_level, fe=True)
        rows = []
        for k in self.shown(fe, fes):
            b, s = float(self.beta[k]), float(se[k])
            t = b / s if s else math.nan
            row = {"term": self.names[k], "estimate": b, "std.error": s, "statistic": t, "p.values": p_two_sided(t, self.df_residual)}
            if conf_int:
                row["conf.low"], row["conf.high"] = bounds[self.names[k]]
            rows.append(row)
        return rows

    def tidy(self, spark: SparkSession, conf_int: bool = False, conf_level: float = 0.95, fe: bool = False, fes: bool | None = None) -> DataFrame:
        rows = self.tidy_rows(conf_int, conf_level, fe, fes)
        names = ["term", "estimate", "std.error", "statistic", "p.values", *(["conf.low", "conf.high"] if conf_int else [])]
        schema = ", ".join(f"`{n}` {'string' if n == 'term' else 'double'}" for n in names)
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    def glance_row(self) -> dict:
        g = self.gof()
        return {"r.squared": g["r2"], "adj.r.squared": g["adj_r2"], "rmse": g["rmse"], "nobs": self.nobs_orig, "df.residual": self.df_residual}

    def glance(self, spark: SparkSession) -> DataFrame:
        row = self.glance_row()
        return spark.createDataFrame([tuple(row.values())], ", ".join(f"`{n}` {'long' if n in ('nobs', 'df.residual') else 'double'}" for n in row))

    def predict(self, newdata: DataFrame | None = None, interval: str = "none", level: float = 0.95) -> DataFrame:
        from .predict import predict

        return predict(self, newdata, interval, level)

    def summary(self, fe: bool = False, fes: bool | None = None) -> str:
        if fes is not None:
            warnings.warn("fes is superseded by fe", DeprecationWarning, stacklevel=2)
            fe = fes
        n = f"{self.nobs_orig:,}"
        head = {
            "compress": f"Least squares of {self.formula.outcome} by compress: {n} rows in {self.nobs:,} cells",
            "demean": f"Least squares of {self.formula.outcome} by demean ({' and '.join(self.fe)}): {n} rows",
            "mundlak": f"Least squares of {self.formula.outcome} by mundlak (means by {' and '.join(self.fe)}): {n} rows",
            "moments": f"Least squares of {self.formula.outcome} by moments: {n} rows",
        }[self.strategy]
        if self.absorbed:
            head += f"\nAbsorbed: {self.absorbed}"
        label = f"Clustered ({self.n_clusters} clusters)" if self.vcov_type == "cluster" else LABELS[self.vcov_type]
        rows = [("", "Estimate", "Std. Error", "t value", "Pr(>|t|)", "")]
        for r in self.tidy_rows(fe=fe):
            p = r["p.values"]
            stars = next((s for limit, s in STARS if p < limit), "") if not math.isnan(p) else ""
            rows.append((r["term"], f"{r['estimate']:.6g}", f"{r['std.error']:.6g}", f"{r['statistic']:.6g}", "< 2.2e-16" if p < 2.2e-16 else f"{p:.5g}", stars))
        widths = [max(len(row[k]) for row in rows) for k in range(6)]
        table = "\n".join(" ".join(x.ljust(w) if k in (0, 5) else x.rjust(w) for k, (x, w) in enumerate(zip(row, widths))).rstrip() for row in rows)
        g = self.gof()
        tail = f"---\n{', '.join(f'{s} p < {limit}' for limit, s in STARS)}\nRMSE: {g['rmse']:.6g}   Adj. R2: {g['adj_r2']:.6g}"
        if self.collinear:
            tail += f"\nLeft out as collinear: {', '.join(self.collinear)}"
        return f"{head}\nStandard Errors: {label}\n{table}\n{tail}"

    def __str__(self) -> str:
        return self.summary()
