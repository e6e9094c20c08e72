"""Gram matrices of DataFrame columns: the one kernel behind moments, robust meats and compressed cells.

Few columns are summed as expressions inside whole-stage code generation. More are multiplied as matrices, one partial
matrix per task, added up in a second step by a bounded number of tasks, so that the driver gets few matrices whatever
the number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many columns each product is an aggregate expression.
EXPRESSION_COLUMNS = 8
#: Partial matrices that reach the driver at most.
LAST_TASKS = 32
#: Numbers of a dense block of rows.
CELLS = 1 << 21
#: Bytes of keys and vectors that a task holds before it sends their sums on.
HELD = 1 << 24
#: Columns up to which sums by group or cluster are aggregate expressions; they hold nothing in Python.
NARROW = 24


def gram(df: DataFrame, columns: list[Column], *, kernel: str | None = None) -> np.ndarray:
    """The matrix of sums of products of ``columns`` over all rows; a null counts as 0."""
    p = len(columns)
    rows = df.select(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"c{k}") for k, c in enumerate(columns)])
    if (kernel or ("expression" if p <= EXPRESSION_COLUMNS else "matrix")) == "expression":
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        sums = rows.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in pairs]).first()
        out = np.zeros((p, p))
        for (i, j), x in zip(pairs, sums):
            out[i, j] = out[j, i] = x or 0.0
        return out

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(p)], 1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["m"])

    return summed(rows.mapInArrow(partial, "m array<double>"), p * p).reshape(p, p)


def summed(partials: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays, one of each task, added up by at most LAST_TASKS tasks before the driver adds the rest."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += x.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["m"])

    tasks = max(1, min(LAST_TASKS, int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = partials.repartition(tasks).mapInArrow(add, "m array<double>").collect()
    total = np.zeros(size)
    for r in rows:
        total += np.array(r[0])
    return total


def total(rows: DataFrame | pa.Table, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], size: int) -> np.ndarray:
    """The sum of what ``partial`` gives: of an Arrow table here, of a DataFrame in its tasks."""
    if isinstance(rows, pa.Table):
        out = np.zeros(size)
        for batch in partial(iter(rows.to_batches())):
            for x in batch.column(0):
                out += x.values.to_numpy()
        return out
    return summed(rows.mapInArrow(partial, "m array<double>"), size)


class Layout:
    """Columns of a dense design: the intercept, ``k`` regressors, and dummies for all but the first level of each fixed effect."""

    def __init__(self, k: int, levels: list[list[str]], intercept: bool = True) -> None:
        self.k, self.intercept = k, intercept
        self.places: list[dict[str, int]] = []
        at = k + intercept
        for own in levels:
            self.places.append({x: at + i for i, x in enumerate(own[1:])})
            at += max(0, len(own) - 1)
        self.p = at

    def dense(self, batch: pa.RecordBatch) -> np.ndarray:
        """From columns x0, x1, ..., f0, f1, ... (levels as text); a level not known has no dummy."""
        n = batch.num_rows
        out = np.zeros((n, self.p))
        if self.intercept:
            out[:, 0] = 1.0
        for j in range(self.k):
            out[:, j + self.intercept] = batch.column(f"x{j}").to_numpy(zero_copy_only=False)
        for f, place in enumerate(self.places):
            codes = batch.column(f"f{f}").dictionary_encode()
            at = np.array([place.get(x, -1) for x in codes.dictionary.to_pylist()] + [-1])
            idx = at[codes.indices.fill_null(len(at) - 1).to_numpy(zero_copy_only=False)]
            has = np.flatnonzero(idx >= 0)
            out[has, idx[has]] = 1.0
        return out

    def expressions(self) -> list[Column]:
        """The columns of ``dense``, one by one."""
        out = [F.lit(1.0)] * self.intercept + [F.col(f"x{j}") for j in range(self.k)]
        return out + [F.when(F.col(f"f{f}") == F.lit(level), 1.0).otherwise(0.0) for f, place in enumerate(self.places) for level in place]

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        step = max(1, CELLS // max(1, self.p))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                piece = batch.slice(a, step)
                yield self.dense(piece), piece


def cell_moments(cells: DataFrame | pa.Table, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(X'X, X'y, [n, sum of y, sum of y squared]) from cells with columns of ``layout`` and n, sy, syy."""
    p = layout.p

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx, xy, rest = np.zeros((p, p)), np.zeros(p), np.zeros(3)
        for x, batch in layout.blocks(batches):
            n, sy, syy = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "sy", "syy"))
            xx += x.T @ (x * n[:, None])
            xy += x.T @ sy
            rest += [n.sum(), sy.sum(), syy.sum()]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([xx.ravel(), xy, rest])], pa.list_(pa.float64()))], ["m"])

    out = total(cells, partial, p * p + p + 3)
    return out[: p * p].reshape(p, p), out[p * p : p * p + p], out[-3:]


def cell_meat(cells: DataFrame | pa.Table, layout: Layout, beta: np.ndarray, robust: bool = True) -> tuple[float, np.ndarray]:
    """(residual sum of squares, X' diag(squared residuals) X, unless not ``robust``), exact from cells."""
    p = layout.p
    size = p * p if robust else 0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rss, meat = 0.0, np.zeros((p, p) if robust else (0, 0))
        for x, batch in layout.blocks(batches):
            squares = _squares(batch, x @ beta)
            rss += squares.sum()
            if robust:
                meat += x.T @ (x * squares[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[rss], meat.ravel()])], pa.list_(pa.float64()))], ["m"])

    out = total(cells, partial, size + 1)
    return float(out[0]), out[1:].reshape(p, p) if robust else np.zeros((p, p))


def _squares(batch: pa.RecordBatch, fit: np.ndarray) -> np.ndarray:
    """Squared residuals of each cell."""
    n, sy, syy = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "sy", "syy"))
    mean = sy / n
    return np.maximum(syy - n * mean * mean, 0.0) + n * (mean - fit) ** 2


def sums_by(rows: DataFrame, key: str, m: int, vectors: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, pa.RecordBatch]]]) -> DataFrame:
    """(key as text, v): the sum of the vectors of length ``m`` that ``vectors`` gives for the rows of each key.

    Each task adds up the keys it meets before the shuffle, in HELD bytes whatever their number, so that a key with most of the rows
    sends few vectors a task, and the sums of a key are added one by one after it.
    """

    def flush(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(list(held.values())) if held else np.zeros(0)
        return vectors_of(pa.array(list(held), pa.string()), values)

    def vectors_of(names: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.ListArray.from_arrays(np.arange(0, values.size + 1, m, dtype=np.int32), pa.array(values.ravel()))], [key, "v"])

    def added(names: pa.Array, v: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Each key once, with the sum of its vectors."""
        g = names.dictionary_encode()
        codes = g.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        return g.dictionary, np.add.reduceat(v[order], cuts, axis=0) if len(cuts) else np.zeros((0, m))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        size = settled = 0  # bytes held, and those of them that are added up
        for v, batch in vectors(batches):
            held.append(added(batch.column(key), v))
            size += held[-1][0].nbytes + held[-1][1].nbytes
            if size - settled <= HELD // 2:
                continue
            held = [added(pa.concat_arrays([n for n, _ in held]), np.concatenate([x for _, x in held]))]
            size = settled = held[0][0].nbytes + held[0][1].nbytes
            if size > HELD // 2:
                yield vectors_of(*held[0])
                held, size, settled = [], 0, 0
        if held:
            yield vectors_of(*added(pa.concat_arrays([n for n, _ in held]), np.concatenate([x for _, x in held])))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sum_, done = None, np.zeros(m), {}
        for batch in batches:
            for name, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != last and last is not None:
                    done[last] = sum_
                sum_ = v.values.to_numpy() if name != last else sum_ + v.values.to_numpy()
                last = name
            yield flush(done)
            done = {}
        if last is not None:
            yield flush({last: sum_})

    schema = f"`{key}` string, v array<double>"
    return rows.mapInArrow(partial, schema).repartition(key).sortWithinPartitions(key).mapInArrow(combine, schema)


def outer_sum(sums: DataFrame, m: int) -> tuple[np.ndarray, int]:
    """(sum of v v', rows) of the vectors of ``sums_by``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meat, count = np.zeros((m, m)), 0
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            meat += v.T @ v
            count += len(v)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[count], meat.ravel()])], pa.list_(pa.float64()))], ["m"])

    out = total(sums, partial, m * m + 1)
    return out[1:].reshape(m, m), int(round(out[0]))


def expression_sums(rows: DataFrame, key: str, columns: list[Column]) -> DataFrame:
    """As ``sums_by``, of few columns: Spark adds them up, and spills what it cannot hold."""
    sums = rows.groupBy(key).agg(*[F.sum(c).alias(f"s{k}") for k, c in enumerate(columns)])
    return sums.select(key, F.array(*[F.col(f"s{k}") for k in range(len(columns))]).alias("v"))


def cluster_meat(cells: DataFrame, layout: Layout, beta: np.ndarray) -> tuple[np.ndarray, int]:
    """(sum over clusters of score times score', clusters) from cells by cluster (column g) with n and sy."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        for x, batch in layout.blocks(batches):
            n, sy = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "sy"))
            yield x * (sy - n * (x @ beta))[:, None], batch

    return outer_sum(sums_by(cells, "g", layout.p, scores), layout.p)


def _within_groups(layout: Layout, batches: Iterator[pa.RecordBatch], beta: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(columns less their group's means, fitted values, cells) of cells joined with their groups."""
    for x, batch in layout.blocks(batches):
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, layout.p + 2)
        x = x - v[:, 2:] / v[:, :1]
        yield x, v[:, 1] / v[:, 0] + x @ beta, batch


class Absorbed:
    """Cells with one fixed effect (column a, as text) taken out: its part of the normal equations is diagonal, so it is eliminated group by group.

    ``layout`` holds the other columns, without an intercept. Groups stay distributed; of each, the sums n, n * y and n * columns.
    """

    def __init__(self, cells: DataFrame, layout: Layout) -> None:
        self.cells, self.layout = cells, layout
        q = layout.p
        if q <= NARROW:
            n = F.col("n").cast("double")
            self.groups = expression_sums(cells, "a", [n, F.col("sy"), *(c * n for c in layout.expressions())])
            return

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
            for x, batch in layout.blocks(batches):
                n, sy = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "sy"))
                yield np.concatenate([n[:, None], sy[:, None], x * n[:, None]], 1), batch

        self.groups = sums_by(cells.select(*[c for c in cells.columns if c != "g"]), "a", q + 2, vectors)

    def within(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(sums of products of the columns, and last of y, within groups; of the columns as they are; [n, sum of y, sum of y squared]; groups)."""
        q = self.layout.p
        xx, xy, rest = cell_moments(self.cells, self.layout)
        whole = np.zeros((q + 1, q + 1))
        whole[:q, :q], whole[:q, q], whole[q, :q], whole[q, q] = xx, xy, xy, rest[2]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            between, count = np.zeros((q + 1, q + 1)), 0
            for batch in batches:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, q + 2)
                u = np.concatenate([v[:, 2:], v[:, 1:2]], 1)
                between += u.T @ (u / v[:, :1])
                count += len(v)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[count], between.ravel()])], pa.list_(pa.float64()))], ["m"])

        out = total(self.groups, partial, (q + 1) ** 2 + 1)
        return whole - out[1:].reshape(q + 1, q + 1), whole, rest, int(round(out[0]))

    def meat(self, beta: np.ndarray, robust: bool) -> tuple[float, np.ndarray]:
        """As ``cell_meat``, of columns within groups."""
        layout, q = self.layout, self.layout.p

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rss, meat = 0.0, np.zeros((q, q))
            for x, fit, batch in _within_groups(layout, batches, beta):
                squares = _squares(batch, fit)
                rss += squares.sum()
                if robust:
                    meat += x.T @ (x * squares[:, None])
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[rss], meat.ravel()])], pa.list_(pa.float64()))], ["m"])

        out = total(self.cells.join(self.groups, "a"), partial, q * q + 1)
        return float(out[0]), out[1:].reshape(q, q)

    def cluster_meat(self, by: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, int]:
        """As ``cluster_meat``, from cells by cluster."""
        layout = self.layout
        if 0 < layout.p <= NARROW:
            size = F.col("v")[0]
            own = by.join(self.groups, "a").select("g", "n", "sy", (F.col("v")[1] / size).alias("_mean"), *[(c - F.col("v")[k + 2] / size).alias(f"w{k}") for k, c in enumerate(layout.expressions())])
            fit = sum((F.col(f"w{k}") * F.lit(float(b)) for k, b in enumerate(beta)), F.col("_mean"))
            own = own.withColumn("_e", F.col("sy") - F.col("n") * fit)
            scored = own.groupBy("g").agg(*[F.sum(F.col(f"w{k}") * F.col("_e")).alias(f"s{k}") for k in range(layout.p)])
            m = gram(scored, [F.lit(1.0), *(F.col(f"s{k}") for k in range(layout.p))])
            return m[1:, 1:], int(round(m[0, 0]))

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
            for x, fit, batch in _within_groups(layout, batches, beta):
                n, sy = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "sy"))
                yield x * (sy - n * fit)[:, None], batch

        return outer_sum(sums_by(by.join(self.groups, "a"), "g", self.layout.p, scores), self.layout.p)

    def effects(self, beta: np.ndarray) -> DataFrame:
        """(a, effect): of each level, the mean outcome that the other columns do not explain."""
        mean = lambda k: F.col("v")[k] / F.col("v")[0]
        line = F.aggregate(F.zip_with(F.slice("v", 3, len(beta)), F.array(*[F.lit(float(b)) for b in beta]), lambda z, b: z * b), F.lit(0.0), lambda t, z: t + z) if len(beta) else F.lit(0.0)
        return self.groups.select("a", (mean(1) - line / F.col("v")[0]).alias("effect"))
