"""A regression kept up to date over a stream: Gram matrices of micro-batches add up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.linalg import independent_columns, solve_normal
from ..operators.gram import gram
from ..operators.result import RegressionResult
from ..plans.design import model_matrix
from ..plans.formula import parse_formula
from ..sources.relation import complete_rows


class StreamingRegression:
    """IID regression without fixed effects; factors need their ``levels``, since later batches may bring new ones.

    ``seen`` holds the batches counted, so that a batch that is run again after a failure counts once.
    """

    def __init__(self, formula: str, levels: dict[str, list] | None = None) -> None:
        self.formula = parse_formula(formula)
        if self.formula.fe:
            raise ValueError("a streamed regression takes no fixed effects")
        self.levels = levels or {}
        self.total: np.ndarray | None = None
        self.names: list[str] = []
        self.seen: set[int] = set()

    def update(self, batch: DataFrame, batch_id: int | None = None) -> None:
        if batch_id is not None and batch_id in self.seen:
            return
        rows = complete_rows(batch, [self.formula.outcome, *self.formula.variables])
        columns = model_matrix(self.formula, rows, levels=self.levels).columns
        m = gram(rows, [F.lit(1.0), *(c.column for c in columns), F.col(f"`{self.formula.outcome}`")])
        self.names = ["(Intercept)", *(c.name for c in columns)]
        self.total = m if self.total is None else self.total + m
        if batch_id is not None:
            self.seen.add(batch_id)

    def attach(self, stream: DataFrame) -> DataStreamWriter:
        """A writer whose query updates this object; start it with a checkpoint folder of its own."""
        return stream.writeStream.foreachBatch(self.update)

    def result(self) -> RegressionResult:
        if self.total is None or not self.total[0, 0]:
            raise ValueError("no complete rows")
        m, p = self.total, len(self.names)
        keep = independent_columns(m[:p, :p])
        xx, xy, yy, n = m[np.ix_(keep, keep)], m[keep, p], m[p, p], int(round(m[0, 0]))
        beta, inverse = solve_normal(xx, xy)
        rss, df = float(yy - 2 * beta @ xy + beta @ xx @ beta), max(n - len(keep), 1)
        names = [self.names[k] for k in keep]
        return RegressionResult(self.formula, names, beta, rss / df * inverse, "iid", "moments", n, df, rss, float(yy - m[0, p] ** 2 / n), names[1:], collinear=[x for k, x in enumerate(self.names) if k not in keep])
