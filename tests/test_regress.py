import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import regrove
from regrove import regress
import regrove.operators.gram as G
import regrove.operators.regress as R
from regrove.operators.gram import gram
from regrove.operators.strategy import choose, is_balanced, nested_levels
from regrove.sources.relation import relation
from regrove.streaming.accumulate import StreamingRegression


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(3)
    firm, year = np.repeat(np.arange(20), 6), np.tile(np.arange(6), 20)
    x1, x2 = rng.normal(size=120) + firm / 5, rng.integers(0, 3, 120).astype(float)
    y = 1 + 2 * x1 - 0.5 * x2 + firm * 0.3 + year * 0.2 + rng.normal(size=120) * (1 + x2)
    kind = np.array(["a", "b", "c"])[rng.integers(0, 3, 120)]
    return pd.DataFrame({"firm": firm, "year": year, "x1": x1, "x2": x2, "y": y, "kind": kind, "city": firm // 4})


@pytest.fixture(scope="module")
def rows(spark, panel):
    df = spark.createDataFrame(panel).cache()
    df.createOrReplaceTempView("panel")
    return df


def dense(columns, y, vcov="iid", g=None, k=None):
    """Least squares with all columns written out."""
    x = np.column_stack(columns)
    inverse = np.linalg.inv(x.T @ x)
    b = inverse @ x.T @ y
    e, (n, p) = y - x @ b, x.shape
    if vcov == "iid":
        v = e @ e / (n - p) * inverse
    elif vcov == "hc1":
        v = n / (n - p) * inverse @ (x.T @ (x * e[:, None] ** 2)) @ inverse
    else:
        s = np.array([(x * e[:, None])[g == c].sum(0) for c in np.unique(g)])
        v = len(s) / (len(s) - 1) * n / (n - (p if k is None else k)) * inverse @ (s.T @ s) @ inverse
    return b, np.sqrt(np.diag(v))


def dummies(values):
    return [(values == v).astype(float) for v in np.unique(values)[1:]]


def near(fit, names, b, se, rel=1e-7):
    for n, x, s in zip(names, b, se):
        k = fit.names.index(n)
        assert fit.beta[k] == pytest.approx(x, rel=rel, abs=1e-9) and fit.std_errors()[k] == pytest.approx(s, rel=rel)


@pytest.mark.parametrize("vcov", ["iid", "hc1", "cluster"])
@pytest.mark.parametrize("strategy", ["moments", "compress"])
def test_no_fixed_effects(rows, panel, strategy, vcov):
    how = {"cluster": "city"} if vcov == "cluster" else {"vcov": vcov}
    fit = regress("y ~ x1 + x2", table=rows, strategy=strategy, **how)
    near(fit, ["(Intercept)", "x1", "x2"], *dense([np.ones(120), panel.x1, panel.x2], panel.y.to_numpy(), vcov, panel.city.to_numpy()))
    assert fit.nobs_orig == 120 and fit.df_residual == 117 and (fit.n_clusters == 5) == (vcov == "cluster")


@pytest.mark.parametrize("vcov", ["iid", "hc1", "cluster", "nested"])
def test_one_fixed_effect_by_every_strategy(rows, panel, vcov):
    how = {"iid": {}, "hc1": {"vcov": "hc1"}, "cluster": {"cluster": "firm"}, "nested": {"cluster": "firm", "ssc": "nested"}}[vcov]
    x = [np.ones(120), panel.x1, panel.x2, *dummies(panel.firm.to_numpy())]
    b, se = dense(x, panel.y.to_numpy(), "cluster" if vcov == "nested" else vcov, panel.firm.to_numpy(), k=2 if vcov == "nested" else None)
    for strategy in ("compress", "demean"):
        near(regress("y ~ x1 + x2 | firm", table=rows, strategy=strategy, **how), ["x1", "x2"], b[1:3], se[1:3], 1e-6)


def test_two_fixed_effects_on_a_balanced_panel(rows, panel):
    b, se = dense([np.ones(120), panel.x1, *dummies(panel.firm.to_numpy()), *dummies(panel.year.to_numpy())], panel.y.to_numpy())
    for strategy in ("compress", "demean"):
        near(regress("y ~ x1 | firm + year", table=rows, strategy=strategy), ["x1"], b[1:2], se[1:2], 1e-6)


def test_mundlak(rows, panel):
    bars = [panel.groupby(f).x1.transform("mean") for f in ("firm", "year")]
    fit = regress("y ~ x1 | firm + year", table=rows, strategy="mundlak", vcov="hc1")
    near(fit, ["(Intercept)", "x1", "x1_bar_firm", "x1_bar_year"], *dense([np.ones(120), panel.x1, *bars], panel.y.to_numpy(), "hc1"))
    assert list(fit.coef()) == ["x1"] and len(fit.coef(fe=True)) == 4


def test_factors_and_interactions(rows, panel):
    a = {k: (panel.kind == k).astype(float) for k in "abc"}
    y = panel.y.to_numpy()
    near(regress("y ~ x1 * kind", table=rows, strategy="moments"), ["(Intercept)", "x1", "kindb", "kindc", "x1:kindb", "x1:kindc"], *dense([np.ones(120), panel.x1, a["b"], a["c"], a["b"] * panel.x1, a["c"] * panel.x1], y))
    near(regress("y ~ x1:kind", table=rows, strategy="compress"), ["x1:kinda", "x1:kindb", "x1:kindc"], *(v[1:] for v in dense([np.ones(120), *(a[k] * panel.x1 for k in "abc")], y)))
    near(regress("y ~ x2 + kind", table=rows, strategy="compress", vcov="hc1", ref={"kind": "c"}), ["(Intercept)", "x2", "kinda", "kindb"], *dense([np.ones(120), panel.x2, a["a"], a["b"]], y, "hc1"))


def test_design_names_and_sql(spark):
    df = spark.createDataFrame([(1.0, "a", 10, True), (2.0, "it's", 20, False), (3.0, "c d", 30, True)], "x1 double, x2 string, x3 int, b boolean")
    m = regrove.model_matrix("~ x1 + x2", df)
    assert m.col_names == ["x1", "x2c d", "x2it's"] and m.select_exprs[0] == "x1" and "CASE WHEN" in m.select_exprs[1] and "it''s" in m.select_exprs[2]
    assert regrove.model_matrix("~ x1:x2", df, sep="_x_").col_names == ["x1_x_x2a", "x1_x_x2c d", "x1_x_x2it's"]
    only = regrove.model_matrix("~ x1 + x2 + x1:x2", df, expand="interactions")
    assert only.col_names == ["x1", "x2", "x1:x2c d", "x1:x2it's"]
    assert regrove.model_matrix("~ x1:x3", df, sep="_x_").select_exprs == ["(x1) * (x3)"]
    assert regrove.model_matrix("~ b", df).col_names == ["bTRUE"] and m.levels == {"x2": ["a", "c d", "it's"]}
    assert regrove.model_matrix("~ x2", df.where("x1 = 1")).col_names == ["x2_constant"]


def test_nulls_go_and_clusters_warn(spark):
    data = [(1.0, 1.0, "a", "g"), (2.5, 2.0, "a", "h"), (2.0, 3.0, "b", None), (None, 4.0, "b", "g"), (5.0, None, "a", "g"), (4.0, 5.0, None, "h"), (3.0, 5.0, "b", "h"), (6.5, 7.0, "b", "g"), (6.0, 6.0, "a", "h")]
    df = spark.createDataFrame(data, "y double, x double, f string, g string")
    assert regress("y ~ x | f", table=df, strategy="compress").nobs_orig == 6
    with pytest.warns(UserWarning, match="null"):
        assert regress("y ~ x | f", table=df, strategy="demean", cluster="g").nobs_orig == 5
    with pytest.raises(ValueError, match="no complete rows"):
        regress("y ~ x", table=df.where("false"), strategy="moments")


def test_collinear_columns_are_dropped_by_every_strategy(rows):
    more = rows.withColumn("z", F.col("x1") + F.col("x2")).withColumn("own", F.col("firm") * 2.0)
    for strategy in ("moments", "compress"):
        assert regress("y ~ x1 + x2 + z", table=more, strategy=strategy).collinear == ["z"]
    assert regress("y ~ x1 + own | firm", table=more, strategy="demean").collinear == ["own"]
    assert regress("y ~ x1 + x2 + z | year", table=more, strategy="mundlak").collinear[0] == "z"


def test_strategy_choice(rows):
    pick = lambda x, fe, **more: choose(rows, "auto", x, fe, **({"compress_ratio": None, "compress_nmax": 10**6} | more)).strategy
    assert pick(["x1"], []) == "moments" and pick(["x2"], [], compress_ratio=0.5) == "compress"
    assert pick(["x1"], ["firm"]) == "demean" and pick(["x2"], ["city"]) == "compress"
    assert pick(["x1"], ["firm", "year"]) == "demean" and pick(["x1"], ["firm", "year", "city"]) == "compress"
    assert pick(["x2"], ["city"], compress_nmax=3) == "demean"
    uneven = rows.union(rows.limit(1))
    assert not is_balanced(uneven, "firm", "year")
    with pytest.raises(ValueError, match="unbalanced"):
        choose(uneven, "auto", ["x1"], ["firm", "year"], compress_ratio=None, compress_nmax=10**6)
    gaps = rows.where("NOT (firm = 0 AND year = 0)")
    assert not is_balanced(gaps, "firm", "year") and is_balanced(gaps, "firm", "year", strict=False)
    assert nested_levels(rows, ["firm", "year"], "city") == 20
    with pytest.warns(UserWarning, match="compress is used"):
        assert choose(rows, "moments", ["x1"], ["firm"], compress_ratio=None, compress_nmax=10).strategy == "compress"
    with pytest.raises(ValueError):
        choose(rows, "auto", ["x1"], [], compress_ratio=2.0, compress_nmax=10)


def test_sources_and_reductions(rows, panel, spark, tmp_path):
    rows.write.partitionBy("city").parquet(str(tmp_path / "p"))
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "c.csv"))
    want = regress("y ~ x1", table="panel", strategy="moments").beta
    for how in ({"data": panel}, {"path": f"{tmp_path}/p"}, {"path": f"read_parquet('{tmp_path}/p/**/*.parquet')"}, {"path": f"{tmp_path}/c.csv"}, {"table": "SELECT * FROM panel"}):
        assert np.allclose(regress("y ~ x1", spark, strategy="moments", **how).beta, want)
    with pytest.raises(ValueError):
        regress("y ~ x1", spark)
    for strategy, f in (("moments", "y ~ x1 + kind"), ("compress", "y ~ x2 + kind | year"), ("within", "y ~ x1 | firm + year"), ("mundlak", "y ~ x1 | firm + year")):
        sql = regress(f, table="panel", strategy=strategy, sql_only=True)
        assert sql.startswith("WITH") and spark.sql(sql).count() >= 1
        assert regress(f, table="panel", strategy=strategy, data_only=True).count() >= 1
    assert regress("y ~ x2 | year", table="panel", strategy="compress", data_only=True).agg(F.sum("n")).first()[0] == 120
    with pytest.warns(DeprecationWarning):
        assert isinstance(regress("y ~ x1", table="panel", strategy="moments", query_only=True), str)


def test_results(rows, panel, spark):
    fit = regress("y ~ x1 + x2 | firm", table=rows, strategy="compress", vcov="hc1")
    assert list(fit.coef()) == ["x1", "x2"] and len(fit.coef(fe=True)) == 22
    low, high = fit.confint("x1", 0.9)["x1"]
    assert low < fit.coef()["x1"] < high
    tidy = fit.tidy(spark, conf_int=True).toPandas()
    assert list(tidy.columns) == ["term", "estimate", "std.error", "statistic", "p.values", "conf.low", "conf.high"]
    e = panel.y - np.column_stack([np.ones(120), panel.x1, panel.x2, *dummies(panel.firm.to_numpy())]) @ fit.beta
    r2 = 1 - (e @ e) / ((panel.y - panel.y.mean()) ** 2).sum()
    assert fit.gof()["r2"] == pytest.approx(r2) and fit.glance(spark).first()["nobs"] == 120
    assert "by compress" in str(fit) and "Heteroskedasticity-robust" in str(fit) and "firm" not in str(fit)
    with pytest.warns(DeprecationWarning):
        fit.coef(fes=True)


def test_predictions(rows, panel):
    x = np.column_stack([np.ones(120), panel.x1, *dummies(panel.firm.to_numpy())])
    b = np.linalg.lstsq(x, panel.y, rcond=None)[0]
    fit = regress("y ~ x1 | firm", table=rows, strategy="compress")
    out = fit.predict(rows, interval="confidence").toPandas().sort_values(["firm", "year"])
    wider = fit.predict(rows, interval="prediction").toPandas().sort_values(["firm", "year"])
    assert np.allclose(out.fit, x @ b) and ((wider.upr - wider.lwr).to_numpy() > (out.upr - out.lwr).to_numpy()).all()
    assert np.allclose(regress("y ~ x1 | firm", table=rows, strategy="demean").predict(rows).toPandas().sort_values(["firm", "year"]).fit, x @ b)
    inter = regress("y ~ x1 * kind", table=rows, strategy="moments").predict(rows).toPandas()
    assert abs((inter.y - inter.fit).mean()) < 1e-9
    bar = regress("y ~ x1 | firm", table=rows, strategy="mundlak").predict(rows).toPandas()
    assert abs((bar.y - bar.fit).mean()) < 1e-9
    with pytest.raises(ValueError):
        regress("y ~ x1", table=rows, strategy="moments").predict()


def test_gram_kernels_agree(rows):
    columns = [F.lit(1.0), F.col("x1"), F.col("x2"), F.col("y")]
    assert np.allclose(gram(rows, columns, kernel="expression"), gram(rows, columns, kernel="matrix"))


def test_streamed_batches_add_up(rows, spark, tmp_path):
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    model = StreamingRegression("y ~ x1 + kind", levels={"kind": ["a", "b", "c"]})
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = model.attach(stream).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = regress("y ~ x1 + kind", table=rows, strategy="moments")
    assert np.allclose(model.result().beta, want.beta) and len(model.seen) >= 2
    model.update(rows, 0)
    assert model.result().nobs_orig == 120


@pytest.mark.parametrize("how", [{"vcov": "iid"}, {"vcov": "hc1"}, {"cluster": "g"}, {"cluster": "g", "ssc": "nested"}])
def test_absorbed_fixed_effect(spark, monkeypatch, how):
    """A fixed effect with many levels is eliminated: coefficients and standard errors of the rest as with a column for each level."""
    rng = np.random.default_rng(4)
    n = 800
    firm, year = rng.integers(0, 60, n), rng.integers(0, 5, n)
    x = rng.integers(0, 6, n).astype(float)
    frame = pd.DataFrame({"firm": firm, "year": [f"y{v}" for v in year], "x": x, "z": np.round(rng.normal(size=n), 1), "firm_size": firm * 2.0, "g": firm // 6})
    frame["y"] = 1000 + 2 * x - frame.z + firm * 0.5 + year + rng.normal(size=n) * (1 + x)
    df = spark.createDataFrame(frame)
    formula = "y ~ x + z + firm_size | firm + year"
    want = regress(formula, table=df, strategy="compress", **how)
    monkeypatch.setattr(R, "DENSE_COLUMNS", 30)
    got = regress(formula, table=df, strategy="compress", **how)
    assert got.absorbed == "firm" and "firm_size" in got.collinear and "firm" in str(got)
    at = [want.names.index(v) for v in ("x", "z")]
    assert [got.names.index(v) for v in ("x", "z")] == [0, 1]
    if "firm_size" not in want.collinear:  # without a scan order that drops it, the last level of the firm is dropped instead
        at = [want.names.index(v) for v in ("x", "z")]
    assert got.beta[:2] == pytest.approx(want.beta[at], rel=1e-8)
    assert got.std_errors()[:2] == pytest.approx(want.std_errors()[at], rel=1e-6)
    assert got.df_residual == want.df_residual and got.rss == pytest.approx(want.rss, rel=1e-8)
    fits = [{(r["firm"], r["year"], r["x"], r["z"]): r["fit"] for r in m.predict(df).collect()} for m in (got, want)]
    assert fits[0] == pytest.approx(fits[1], rel=1e-6)
    with pytest.raises(ValueError, match="absorbed"):
        got.predict(df, interval="confidence")
    monkeypatch.setattr(R, "DENSE_COLUMNS", 3)
    with pytest.raises(ValueError, match="levels of fixed effects besides"):
        regress(formula, table=df, strategy="compress")


def test_many_levels_take_little_memory(spark):
    """50,000 levels of a fixed effect: no matrix of that size anywhere."""
    df = spark.range(150_000).select((F.col("id") % 50_000).alias("firm"), (F.col("id") % 7).cast("double").alias("x"), ((F.col("id") % 7) * 3.0 + (F.col("id") % 50_000)).alias("y"))
    fit = regress("y ~ x | firm", table=df, strategy="compress", vcov="hc1")
    assert fit.absorbed == "firm" and fit.beta[0] == pytest.approx(3.0) and fit.df_residual == 150_000 - 50_001


def test_large_means_cost_no_digits(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=500)
    y = 2 * x + rng.normal(size=500)
    small, large = (regress("y ~ x", table=spark.createDataFrame(pd.DataFrame({"x": x + a, "y": y + a})), strategy="moments", vcov=v) for a in (0.0, 1e7) for v in ("hc1",))
    assert large.beta[1] == pytest.approx(small.beta[1], rel=1e-7) and large.rss == pytest.approx(small.rss, rel=1e-6)
    assert large.std_errors()[1] == pytest.approx(small.std_errors()[1], rel=1e-6)


def test_reader_calls(spark, tmp_path):
    (tmp_path / "a.csv").write_text("y;x\n1;2\n3;NA\n")
    (tmp_path / "b.csv").write_text("y;x\n5;6\n")
    call = f"read_csv('{tmp_path}/a.csv', delim = ';', header=true, nullstr='NA', auto_detect=true)"
    assert sorted(map(tuple, relation(spark, path=call).collect())) == [(1, 2), (3, None)]
    both = relation(spark, path=f"read_csv(['{tmp_path}/a.csv', '{tmp_path}/b.csv'], sep=';', nullstr='NA')")
    assert both.columns == ["y", "x"] and both.count() == 3
    bare = relation(spark, path=f"read_csv_auto('{tmp_path}/b.csv', delim=';', header=false)")
    assert bare.count() == 2
    for bad in ("read_csv('f', unknown=1)", "read_csv(f)", "read_csv('f', ';')", "read_nothing('f')"):
        with pytest.raises(ValueError):
            relation(spark, path=bad)


@pytest.mark.parametrize("strategy", ["moments", "mundlak"])
def test_sql_has_the_values_of_the_model(spark, strategy):
    """The sums that the SQL gives, solved here, are the fitted model."""
    rng = np.random.default_rng(7)
    n = 300
    frame = pd.DataFrame({"x": rng.normal(size=n), "f": rng.choice(["a", "b", "it's"], n), "w": rng.normal(size=n), "firm": rng.integers(0, 9, n), "year": rng.integers(0, 4, n)})
    frame["y"] = frame.x - frame.w + frame.firm + rng.normal(size=n)
    df = spark.createDataFrame(frame).withColumnRenamed("w", "odd name")
    df.createOrReplaceTempView("sums_of_a_model")
    formula = "y ~ x + f + x:f" + (" | firm + year" if strategy == "mundlak" else "")
    fit = regress(formula, table=df, strategy=strategy)
    row = spark.sql(regress(formula, table="sums_of_a_model", strategy=strategy, sql_only=True)).first().asDict()
    p = len(fit.names)
    assert not fit.collinear and f"sum_x{p - 1}" in row and f"sum_x{p}" not in row
    a, b = np.zeros((p, p)), np.zeros(p)
    a[0, 0], b[0] = row["n_total"], row["sum_y"]
    for i in range(1, p):
        a[0, i] = a[i, 0] = row[f"sum_x{i}"]
        b[i] = row[f"sum_x{i}_y"]
        for j in range(i, p):
            a[i, j] = a[j, i] = row[f"sum_x{i}_x{j}"]
    assert np.linalg.solve(a, b) == pytest.approx(fit.beta, rel=1e-6, abs=1e-6)


def test_scores_of_clusters_by_rows_and_by_cells(spark, panel, monkeypatch):
    df = spark.createDataFrame(panel)
    formula = "y ~ x1 + kind | year"
    by_rows = regress(formula, table=df, strategy="compress", cluster="city")
    monkeypatch.setattr(R, "ROW_SCORES", 0)
    by_cells = regress(formula, table=df, strategy="compress", cluster="city")
    assert by_rows.n_clusters == by_cells.n_clusters == 5 and by_rows.covariance == pytest.approx(by_cells.covariance, rel=1e-8, abs=1e-12)


def test_sums_by_key_hold_few_keys(monkeypatch):
    """What a task holds does not grow with the number of its keys, and every key keeps its whole sum."""
    tasks = []
    rows = SimpleNamespace(mapInArrow=lambda task, schema: tasks.append(task) or rows, repartition=lambda key: rows, sortWithinPartitions=lambda key: rows)
    G.sums_by(rows, "g", 2, lambda batches: ((np.ones((b.num_rows, 2)), b) for b in batches))
    names = [f"key {k}" for k in range(200_000)]
    batches = (pa.RecordBatch.from_arrays([pa.array(["hot"] * 1000 + names[a : a + 5000])], ["g"]) for _ in range(2) for a in range(0, len(names), 5000))
    count, hot, held = 0.0, 0.0, 0
    tracemalloc.start()
    for out in tasks[0](batches):
        held = max(held, tracemalloc.get_traced_memory()[1])
        v = out.column(1).flatten().to_numpy().reshape(-1, 2)
        count += v.sum()
        hot += v[out.column(0).index("hot").as_py(), 0]
        del v, out
    tracemalloc.stop()
    assert count == 2 * (400_000 + 80_000) and hot == 80_000
    assert held < 40e6


def test_absorbed_effect_of_a_narrow_design_by_expressions(spark, monkeypatch, capsys):
    """Sums of groups and scores of clusters hold nothing in Python, and are those of the matrices of a wide design."""
    rng = np.random.default_rng(9)
    n = 600
    frame = pd.DataFrame({"firm": rng.integers(0, 50, n), "year": [f"y{v}" for v in rng.integers(0, 4, n)], "x": rng.integers(0, 6, n).astype(float), "g": rng.integers(0, 40, n)})
    frame["y"] = 2 * frame.x + frame.firm + rng.normal(size=n) * (1 + frame.x)
    df = spark.createDataFrame(frame)
    cells = df.select(F.col("x").alias("x0"), F.col("firm").cast("string").alias("a"), F.lit(1).alias("n"), F.col("y").alias("sy"))
    G.Absorbed(cells, G.Layout(1, [], intercept=False)).groups.explain()
    assert "MapInArrow" not in capsys.readouterr().out
    monkeypatch.setattr(R, "DENSE_COLUMNS", 20)
    for how in ({"vcov": "hc1"}, {"cluster": "g"}):
        narrow = regress("y ~ x | firm + year", table=df, strategy="compress", **how)
        with monkeypatch.context() as patch:
            patch.setattr(G, "NARROW", 0)
            patch.setattr(G, "HELD", 1 << 10)
            wide = regress("y ~ x | firm + year", table=df, strategy="compress", **how)
        assert narrow.absorbed == wide.absorbed == "firm" and narrow.n_clusters == wide.n_clusters
        assert narrow.beta == pytest.approx(wide.beta, rel=1e-9) and narrow.covariance == pytest.approx(wide.covariance, rel=1e-8, abs=1e-12)
