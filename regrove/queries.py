"""Registered queries over the test tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tdist import t_quantile
from .operators.binscatter import BinscatterResult, bin_geometry, binscatter, equal_width_bins, log_breaks, manual_bins, ntile_bins
from .operators.regress import regress
from .operators.result import RegressionResult
from .operators.strategy import choose, distinct_tuples, is_balanced, nested_levels
from .plans.design import factor_levels, model_matrix
from .plans.oracle import regression_sql, solved_ctes

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 4


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Group means hardly differ, which makes Mundlak models ill-conditioned and their coefficients large.
MUNDLAK_DIGITS = 4


def _terms(spark: SparkSession, fit: RegressionResult) -> DataFrame:
    """term, estimate, std_error, rounded as the oracle rounds."""
    digits = MUNDLAK_DIGITS if fit.strategy == "mundlak" else DIGITS
    rows = [(n, float(b), float(s)) for n, b, s in zip(fit.names, fit.beta, fit.std_errors())]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double").select("term", *[(F.round(c, digits) + 0.0).alias(c) for c in ("estimate", "std_error")])


Y, XS = "l_extendedprice", ["l_quantity", "l_discount"]
FLAGS = [("l_returnflag", "N"), ("l_returnflag", "R"), ("l_linestatus", "O")]
PLAIN, FE = f"{Y} ~ l_quantity + l_discount", f"{Y} ~ l_quantity + l_discount | l_returnflag + l_linestatus"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _lineitem(formula: str, **more) -> Query:
    return lambda spark, d: _terms(spark, regress(formula, table=_read(spark, d, "lineitem"), **more))


def _dummy(column: str, level: str) -> str:
    return f"CASE WHEN {column} = '{level}' THEN 1.0 ELSE 0.0 END"


def _rows(x: list[str], y: str = Y, g: str = "0", source: str = "lineitem") -> str:
    return f"SELECT [{', '.join(f'CAST({e} AS DOUBLE)' for e in x)}] AS x, CAST({y} AS DOUBLE) AS y, {g} AS g FROM {source}"


_X = ["1", *XS]
_XF = [*_X, *(_dummy(*f) for f in FLAGS)]
_N, _NF = ["(Intercept)", *XS], ["(Intercept)", *XS, *(a + b for a, b in FLAGS)]
for _v in ("iid", "hc1", "cluster"):
    _how = {"cluster": "l_suppkey"} if _v == "cluster" else {"vcov": _v}
    _g = "l_suppkey" if _v == "cluster" else "0"
    QUERIES[f"moments_{_v}"] = _lineitem(PLAIN, strategy="moments", **_how)
    ORACLES[f"moments_{_v}"] = regression_sql(_rows(_X, g=_g), _N, vcov=_v)
    QUERIES[f"compress_fe_{_v}"] = _lineitem(FE, strategy="compress", **_how)
    ORACLES[f"compress_fe_{_v}"] = regression_sql(_rows(_XF, g=_g), _NF, vcov=_v)
    _within = f"(SELECT *, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY l_suppkey) AS d_{c}' for c in [*XS, Y])} FROM lineitem) w"
    QUERIES[f"demean_1fe_{_v}"] = _lineitem(f"{PLAIN} | l_suppkey", strategy="demean", **_how)
    ORACLES[f"demean_1fe_{_v}"] = regression_sql(_rows([f"d_{c}" for c in XS], f"d_{Y}", _g, _within), XS, vcov=_v, extra="(SELECT count(DISTINCT l_suppkey) FROM lineitem)")
    _bars = f"(SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY l_partkey) AS m_{c}' for c in XS)} FROM lineitem) w"
    QUERIES[f"mundlak_1fe_{_v}"] = _lineitem(f"{PLAIN} | l_partkey", strategy="mundlak", **_how)
    ORACLES[f"mundlak_1fe_{_v}"] = regression_sql(_rows([*_X, *(f"m_{c}" for c in XS)], g=_g, source=_bars), [*_N, *(f"{c}_bar_l_partkey" for c in XS)], vcov=_v, digits=MUNDLAK_DIGITS)
    _within = f"(SELECT *, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY l_orderkey) AS d_{c}' for c in [*XS, Y])} FROM lineitem) w"
    QUERIES[f"compress_absorbed_{_v}"] = _lineitem(f"{PLAIN} | l_orderkey", strategy="compress", **_how)
    ORACLES[f"compress_absorbed_{_v}"] = regression_sql(_rows([f"d_{c}" for c in XS], f"d_{Y}", _g, _within), XS, vcov=_v, extra="(SELECT count(DISTINCT l_orderkey) FROM lineitem)")
QUERIES["compress_fe_nested"] = _lineitem(FE, strategy="compress", cluster="l_returnflag", ssc="nested")
ORACLES["compress_fe_nested"] = regression_sql(_rows(_XF, g="l_returnflag"), _NF, vcov="cluster", k="6 - (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
_two = f"(SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY {f}) AS m{k}_{c}' for c in XS for k, f in enumerate(('l_partkey', 'l_orderkey')))} FROM lineitem) w"
QUERIES["mundlak_2fe"] = _lineitem(f"{PLAIN} | l_partkey + l_orderkey", strategy="mundlak")
ORACLES["mundlak_2fe"] = regression_sql(_rows([*_X, *(f"m{k}_{c}" for c in XS for k in (0, 1))], source=_two), [*_N, *(f"{c}_bar_{f}" for c in XS for f in ("l_partkey", "l_orderkey"))], digits=MUNDLAK_DIGITS)
_qty = [("l_returnflag", "N"), ("l_returnflag", "R")]
QUERIES["interaction_num_factor"] = _lineitem(f"{Y} ~ l_quantity * l_returnflag", strategy="moments")
ORACLES["interaction_num_factor"] = regression_sql(_rows(["1", "l_quantity", *(_dummy(*f) for f in _qty), *(f"l_quantity * {_dummy(*f)}" for f in _qty)]), ["(Intercept)", "l_quantity", "l_returnflagN", "l_returnflagR", "l_quantity:l_returnflagN", "l_quantity:l_returnflagR"])
QUERIES["interaction_num_num"] = _lineitem(f"{Y} ~ l_quantity + l_quantity:l_discount", strategy="compress", vcov="hc1")
ORACLES["interaction_num_num"] = regression_sql(_rows(["1", "l_quantity", "l_quantity * l_discount"]), ["(Intercept)", "l_quantity", "l_quantity:l_discount"], vcov="hc1")
QUERIES["interaction_only"] = _lineitem(f"{Y} ~ l_quantity:l_returnflag", strategy="moments")
ORACLES["interaction_only"] = regression_sql(_rows(["1", *(f"l_quantity * {_dummy('l_returnflag', v)}" for v in "ANR")]), ["(Intercept)", *(f"l_quantity:l_returnflag{v}" for v in "ANR")])


def collinear_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").withColumn("total", F.col("l_quantity") + F.col("l_discount"))
    return _terms(spark, regress(f"{PLAIN} + total | l_returnflag", table=rows, strategy="compress"))


QUERIES["collinear_drop"] = collinear_drop
ORACLES["collinear_drop"] = regression_sql(_rows([*_X, *(_dummy(*f) for f in _qty)]), [*_N, "l_returnflagN", "l_returnflagR"])


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("y"), F.count("*").cast("double").alias("x"))


_PANEL = "(SELECT user_id, event_type, avg(value) AS y, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY ALL)"
QUERIES["demean_2fe"] = lambda spark, d: _terms(spark, regress("y ~ x | user_id + event_type", table=_panel(spark, d), strategy="demean"))
ORACLES["demean_2fe"] = regression_sql(
    _rows(["dx"], "dy", source=f"(SELECT {', '.join(f'{c} - avg({c}) OVER (PARTITION BY user_id) - avg({c}) OVER (PARTITION BY event_type) + avg({c}) OVER () AS d{c}' for c in 'xy')} FROM {_PANEL}) w"),
    ["x"],
    extra=f"(SELECT count(DISTINCT user_id) + count(DISTINCT event_type) - 1 FROM events)",
)


def compress_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = regress(FE, table=_read(spark, sf_dir, "lineitem"), strategy="compress", data_only=True)
    return cells.select("l_quantity", "l_discount", "l_returnflag", "l_linestatus", "n", F.round("sum_Y", 2).alias("sum_y"), F.round("mean_Y", 8).alias("mean_y"), F.round("wts", 6).alias("wts"))


QUERIES["compress_cells"] = compress_cells
ORACLES["compress_cells"] = f"SELECT l_quantity, l_discount, l_returnflag, l_linestatus, count(*) AS n, round(sum({Y}), 2) AS sum_y, round(sum({Y}) / count(*), 8) AS mean_y, round(sqrt(count(*)), 6) AS wts FROM lineitem GROUP BY ALL"


def auto_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What auto chooses, and why, for models of no, one, two and three fixed effects."""
    rows = _read(spark, sf_dir, "lineitem")
    out = []
    for name, x, fe, df in (
        ("no_fe", ["l_quantity"], [], rows),
        ("no_fe_wide", ["l_quantity", "l_extendedprice"], [], rows),
        ("one_fe", ["l_quantity", "l_extendedprice"], ["l_suppkey"], rows),
        ("two_fe", ["l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"], rows),
        ("two_fe_balanced", ["x", "y"], ["user_id", "event_type"], _panel(spark, sf_dir)),
    ):
        c = choose(df, "auto", x, fe, compress_ratio=None, compress_nmax=1_000_000)
        out.append((name, c.n_rows, c.strategy))
    return spark.createDataFrame(out, "model string, n_rows long, strategy string")


def distinct_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and rows of the same models, counted."""
    rows, panel = _read(spark, sf_dir, "lineitem"), _panel(spark, sf_dir)
    cases = [("no_fe", ["l_quantity"], rows), ("no_fe_wide", ["l_quantity", "l_extendedprice"], rows), ("two_fe", ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"], rows), ("two_fe_balanced", ["x", "y", "user_id", "event_type"], panel)]
    return spark.createDataFrame([(n, *distinct_tuples(d, x)) for n, x, d in cases], "model string, n_cells long, n_rows long")


def _case(name: str, cells: str, source: str, limit: float, good: str, bad: str) -> str:
    return f"SELECT '{name}' AS model, (SELECT count(*) FROM {source} s) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT {cells} FROM {source} s)) AS n_cells, {limit} AS l, '{good}' AS good, '{bad}' AS bad"


QUERIES["auto_choice"] = auto_choice
QUERIES["distinct_cells"] = distinct_cells
ORACLES["distinct_cells"] = " UNION ALL ".join(
    f"SELECT '{n}' AS model, (SELECT count(*) FROM (SELECT DISTINCT {c} FROM {s} s)) AS n_cells, (SELECT count(*) FROM {s} s) AS n_rows"
    for n, c, s in [("no_fe", "l_quantity", "lineitem"), ("no_fe_wide", "l_quantity, l_extendedprice", "lineitem"), ("two_fe", "l_quantity, l_discount, l_returnflag, l_linestatus", "lineitem"), ("two_fe_balanced", "x, y, user_id, event_type", _PANEL)]
)
ORACLES["auto_choice"] = "SELECT model, n_rows, CASE WHEN n_cells / n_rows <= l AND n_cells <= 1000000 THEN good ELSE bad END AS strategy FROM (" + " UNION ALL ".join([
    _case("no_fe", "l_quantity", "lineitem", 0.01, "compress", "moments"),
    _case("no_fe_wide", "l_quantity, l_extendedprice", "lineitem", 0.01, "compress", "moments"),
    _case("one_fe", "l_quantity, l_extendedprice, l_suppkey", "lineitem", 0.6, "compress", "demean"),
    _case("two_fe", "l_quantity, l_discount, l_returnflag, l_linestatus", "lineitem", 0.6, "compress", "demean"),
    _case("two_fe_balanced", "x, y, user_id, event_type", _PANEL, 0.6, "compress", "demean"),
]) + ")"


def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    cases = [("raw", events), ("panel", _panel(spark, sf_dir)), ("gaps", _panel(spark, sf_dir).where("NOT (user_id = 1 AND event_type = 'click')"))]
    return spark.createDataFrame([(n, is_balanced(d, "user_id", "event_type"), is_balanced(d, "user_id", "event_type", strict=False)) for n, d in cases], "panel string, balanced boolean, equal_cells boolean")


_cells = "SELECT {n} AS panel, min(n) = max(n) AND count(*) = count(DISTINCT user_id) * count(DISTINCT event_type) AS balanced, min(n) = max(n) AS equal_cells FROM (SELECT user_id, event_type, count(*) AS n FROM {s} s GROUP BY ALL)"
QUERIES["balance_check"] = balance_check
ORACLES["balance_check"] = " UNION ALL ".join(_cells.format(n=f"'{n}'", s=s) for n, s in (("raw", "events"), ("panel", _PANEL), ("gaps", f"(SELECT * FROM {_PANEL} WHERE NOT (user_id = 1 AND event_type = 'click'))")))


def nested_fe_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    cases = [("nation_in_region", ["n_nationkey"]), ("segment_in_region", ["c_mktsegment"]), ("both", ["n_nationkey", "c_mktsegment"])]
    return spark.createDataFrame([(n, nested_levels(rows, fe, "n_regionkey")) for n, fe in cases], "model string, nested long")


QUERIES["nested_fe_levels"] = nested_fe_levels
ORACLES["nested_fe_levels"] = """WITH r AS (SELECT * FROM nation JOIN customer ON n_nationkey = c_nationkey),
a AS (SELECT CASE WHEN max(k) <= 1 THEN count(*) ELSE 0 END AS n FROM (SELECT n_nationkey, count(DISTINCT n_regionkey) AS k FROM r GROUP BY 1)),
b AS (SELECT CASE WHEN max(k) <= 1 THEN count(*) ELSE 0 END AS n FROM (SELECT c_mktsegment, count(DISTINCT n_regionkey) AS k FROM r GROUP BY 1))
SELECT 'nation_in_region' AS model, n AS nested FROM a UNION ALL SELECT 'segment_in_region', n FROM b UNION ALL SELECT 'both', a.n + b.n FROM a, b"""


def levels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = factor_levels(_read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])
    return spark.createDataFrame([(v, k, x) for v, own in found.items() for k, x in enumerate(own, 1)], "variable string, place int, level string")


QUERIES["factor_levels"] = levels_query
ORACLES["factor_levels"] = " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST(row_number() OVER (ORDER BY l) AS INT) AS place, l AS level FROM (SELECT DISTINCT {v} AS l FROM lineitem)" for v in ("l_returnflag", "l_linestatus"))


def design_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the columns of a design with factors and interactions."""
    rows = _read(spark, sf_dir, "lineitem")
    matrix = model_matrix("~ l_quantity + l_linestatus + l_quantity:l_linestatus + l_tax:l_returnflag", rows)
    sums = rows.agg(*[F.round(F.sum(c.column), 2).alias(f"s{k}") for k, c in enumerate(matrix.columns)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"s{k}").alias("total")) for k, n in enumerate(matrix.col_names)])).alias("r")).select("r.*")


QUERIES["design_columns"] = design_columns
ORACLES["design_columns"] = " UNION ALL ".join(
    f"SELECT '{n}' AS name, round(sum(CAST({e} AS DOUBLE)), 2) AS total FROM lineitem"
    for n, e in [("l_quantity", "l_quantity"), ("l_linestatusO", _dummy("l_linestatus", "O")), ("l_quantity:l_linestatusO", f"l_quantity * {_dummy('l_linestatus', 'O')}"), *((f"l_tax:l_returnflag{v}", f"l_tax * {_dummy('l_returnflag', v)}") for v in "ANR")]
)


def gof_glance(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = regress(FE, table=_read(spark, sf_dir, "lineitem"), strategy="compress").glance_row()
    return spark.createDataFrame([(round(g["r.squared"], 9), round(g["adj.r.squared"], 9), round(g["rmse"], 4), g["nobs"], g["df.residual"])], "r_squared double, adj_r_squared double, rmse double, nobs long, df_residual long")


QUERIES["gof_glance"] = gof_glance
ORACLES["gof_glance"] = f"""WITH RECURSIVE {solved_ctes(_rows(_XF), 6)},
s AS (SELECT sum(e * e) AS rss, sum(y * y) - sum(y) * sum(y) / count(*) AS tss, count(*) AS n FROM res)
SELECT round(1 - rss / tss, 9) AS r_squared, round(1 - (rss / (n - 6)) / (tss / (n - 1)), 9) AS adj_r_squared, round(sqrt(rss / n), 4) AS rmse, n AS nobs, n - 6 AS df_residual FROM s"""


_KEYS = ["l_orderkey", "l_linenumber"]


def _predicted(formula: str, strategy: str, interval: str = "none") -> Query:
    """Predictions for all rows, and how wide their interval is in units of t."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _read(spark, sf_dir, "lineitem")
        fit = regress(formula, table=rows, strategy=strategy)
        out = fit.predict(rows, interval=interval)
        half = [F.round((F.col("upr") - F.col("fit")) / t_quantile(0.975, fit.df_residual), 3).alias("se")] if interval != "none" else []
        return out.select(*_KEYS, F.round("fit", 3).alias("fit"), *half)

    return run


def _predicted_sql(x: list[str], extra: str | None) -> str:
    """``extra``: what is added to the variance of the mean, or None for no interval."""
    se = f""",
  round(sqrt(s2 * ({extra} + list_sum(list_transform(x, lambda v, i: v * list_sum(list_transform(x, lambda w, j: w * inv[i][j])))))), 3) AS se""" if extra is not None else ""
    return f"""WITH RECURSIVE {solved_ctes(_rows(x), len(x))},
s AS (SELECT sum(e * e) / (count(*) - {len(x)}) AS s2 FROM res),
d AS (SELECT l_orderkey, l_linenumber, [{', '.join(f'CAST({e} AS DOUBLE)' for e in x)}] AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round(list_sum(list_transform(x, lambda v, i: v * beta[i])), 3) AS fit{se} FROM d, fit, s"""


QUERIES["predict_confidence"] = _predicted(FE, "compress", "confidence")
ORACLES["predict_confidence"] = _predicted_sql(_XF, "0")
QUERIES["predict_prediction"] = _predicted(FE, "compress", "prediction")
ORACLES["predict_prediction"] = _predicted_sql(_XF, "1")
QUERIES["predict_moments"] = _predicted(PLAIN, "moments", "confidence")
ORACLES["predict_moments"] = _predicted_sql(_X, "0")
_supp = f"(SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY l_suppkey) AS m_{c}' for c in [*XS, Y])} FROM lineitem) w"
QUERIES["predict_demean"] = _predicted(f"{PLAIN} | l_suppkey", "demean")
ORACLES["predict_demean"] = f"""WITH RECURSIVE {solved_ctes(_rows([f'{c} - m_{c}' for c in XS], f'{Y} - m_{Y}', source=_supp), 2)}
SELECT l_orderkey, l_linenumber, round(m_{Y} + beta[1] * (l_quantity - m_l_quantity) + beta[2] * (l_discount - m_l_discount), 3) AS fit FROM {_supp}, fit"""
_part = f"(SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY l_partkey) AS m_{c}' for c in XS)} FROM lineitem) w"
QUERIES["predict_mundlak"] = _predicted(f"{PLAIN} | l_partkey", "mundlak")
ORACLES["predict_mundlak"] = f"""WITH RECURSIVE {solved_ctes(_rows([*_X, *(f'm_{c}' for c in XS)], source=_part), 5)}
SELECT l_orderkey, l_linenumber, round(beta[1] + beta[2] * l_quantity + beta[3] * l_discount + beta[4] * m_l_quantity + beta[5] * m_l_discount, 3) AS fit FROM {_part}, fit"""


def tidy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficient table with fixed effects: statistics, how sure, and bounds in units of t."""
    fit = regress(FE, table=_read(spark, sf_dir, "lineitem"), strategy="compress", vcov="hc1")
    t = t_quantile(0.975, fit.df_residual)
    rows = [(r["term"], r["statistic"], (r["conf.high"] - r["estimate"]) / t, (r["estimate"] - r["conf.low"]) / t, r["p.values"] < 0.05) for r in fit.tidy_rows(conf_int=True, fe=True)]
    out = spark.createDataFrame(rows, "term string, statistic double, above double, below double, significant boolean")
    return out.select("term", *[(F.round(c, 4) + 0.0).alias(c) for c in ("statistic", "above", "below")], "significant")


QUERIES["tidy_terms"] = tidy_terms
ORACLES["tidy_terms"] = f"SELECT term, round(estimate / std_error, 4) + 0.0 AS statistic, round(std_error, 4) + 0.0 AS above, round(std_error, 4) + 0.0 AS below, abs(estimate / std_error) > 1.96 AS significant FROM ({regression_sql(_rows(_XF), _NF, vcov='hc1', digits=12)})"

_TIE = "l_extendedprice, l_orderkey, l_linenumber, l_quantity"


def _price_bins(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    return ntile_bins(_read(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), n, [F.col(c.strip()) for c in _TIE.split(",")])


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")).select(F.col("bin").cast("int"), "n", "low", "high")


_COUNTED = "SELECT CAST(bin AS INT) AS bin, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM ({}) WHERE bin IS NOT NULL GROUP BY bin"
_NTILE = f"SELECT *, ntile(10) OVER (ORDER BY {_TIE}) AS bin FROM lineitem"
QUERIES["bins_qs"] = lambda spark, d: _counted(_price_bins(spark, d))
ORACLES["bins_qs"] = _COUNTED.format(_NTILE)


def bins_es(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    low, high = rows.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return _counted(rows.withColumn("bin", equal_width_bins(F.col("l_extendedprice"), low, high, 8)))


QUERIES["bins_es"] = bins_es
ORACLES["bins_es"] = _COUNTED.format("SELECT l.*, least(8, floor((l_extendedprice - a) / ((b - a) / 8)) + 1) AS bin FROM lineitem l, (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)")


def bins_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    low, high = rows.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return _counted(rows.withColumn("bin", manual_bins(F.col("l_extendedprice"), [low, *log_breaks(low, high, 8)[1:-1], high])).where("bin is not null"))


QUERIES["bins_log"] = bins_log
ORACLES["bins_log"] = _COUNTED.format("SELECT l.*, least(8, floor((ln(l_extendedprice) - ln(a)) / ((ln(b) - ln(a)) / 8)) + 1) AS bin FROM lineitem l, (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)")
_BREAKS = [1000.0, 20000.0, 50000.0, 80000.0, 90000.0]
QUERIES["bins_manual"] = lambda spark, d: _counted(_read(spark, d, "lineitem").withColumn("bin", manual_bins(F.col("l_extendedprice"), _BREAKS)).where("bin is not null"))
ORACLES["bins_manual"] = _COUNTED.format("SELECT *, CASE WHEN l_extendedprice >= 1000 AND l_extendedprice < 20000 THEN 1 WHEN l_extendedprice >= 20000 AND l_extendedprice < 50000 THEN 2 WHEN l_extendedprice >= 50000 AND l_extendedprice < 80000 THEN 3 WHEN l_extendedprice >= 80000 AND l_extendedprice <= 90000 THEN 4 END AS bin FROM lineitem")
QUERIES["bin_geometry"] = lambda spark, d: bin_geometry(_price_bins(spark, d), "l_extendedprice").select(F.col("bin").cast("int"), "x_left", "x_right", F.round("x_mid", 3).alias("x_mid"), F.round("x_mean", 3).alias("x_mean"), "n")
ORACLES["bin_geometry"] = f"SELECT CAST(bin AS INT) AS bin, min(l_extendedprice) AS x_left, max(l_extendedprice) AS x_right, round((min(l_extendedprice) + max(l_extendedprice)) / 2, 3) AS x_mid, round(avg(l_extendedprice), 3) AS x_mean, count(*) AS n FROM ({_NTILE}) GROUP BY bin"


def _scatter(spark: SparkSession, sf_dir: str, formula: str = "l_quantity ~ l_extendedprice", **more) -> BinscatterResult:
    return binscatter(formula, table=_read(spark, sf_dir, "lineitem"), nbins=more.pop("nbins", 6), binspos=more.pop("binspos", "es"), **more)


def _points(columns: list[str], **more) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [(p["bin"], *(float(p[c]) for c in columns)) for p in _scatter(spark, sf_dir, **more).points]
        out = spark.createDataFrame(rows, ", ".join(["bin int", *(f"{c} double" for c in columns)]))
        return out.select("bin", *[F.round(c, 4).alias(c) for c in columns])

    return run


_ES6 = "(SELECT l.*, CAST(least(6, floor((l_extendedprice - a) / ((b - a) / 6)) + 1) AS INT) AS bin FROM lineitem l, (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)) s"
QUERIES["binscatter_00_hc1"] = _points(["x", "fit", "se"])
ORACLES["binscatter_00_hc1"] = f"""WITH s AS (SELECT * FROM {_ES6}), m AS (SELECT bin, avg(l_extendedprice) AS x, avg(l_quantity) AS fit, count(*) AS n FROM s GROUP BY bin)
SELECT m.bin, round(any_value(x), 4) AS x, round(any_value(fit), 4) AS fit,
  round(sqrt(sum((l_quantity - fit) * (l_quantity - fit)) / any_value(m.n) / any_value(m.n) * (SELECT count(*) FROM s) / ((SELECT count(*) FROM s) - 6.0)), 4) AS se FROM s JOIN m ON s.bin = m.bin GROUP BY m.bin"""
QUERIES["binscatter_10"] = _points(["x", "fit"], points=(1, 0))
ORACLES["binscatter_10"] = f"SELECT bin, round(avg(l_extendedprice), 4) AS x, round(regr_intercept(l_quantity, l_extendedprice) + regr_slope(l_quantity, l_extendedprice) * avg(l_extendedprice), 4) AS fit FROM {_ES6} GROUP BY bin"


def _line(points: tuple[int, int], line: tuple[int, int]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scatter(spark, sf_dir, points=points, line=line, linegrid=3, ci=False).frame(spark, "line").select("bin", F.round("x", 4).alias("x"), F.round("fit", 4).alias("fit"))

    return run


QUERIES["binscatter_line"] = _line((0, 0), (1, 0))
ORACLES["binscatter_line"] = f"""WITH m AS (SELECT bin, min(l_extendedprice) AS a, max(l_extendedprice) AS b, regr_intercept(l_quantity, l_extendedprice) AS i, regr_slope(l_quantity, l_extendedprice) AS s FROM {_ES6} GROUP BY bin)
SELECT bin, round(a + k * (b - a) / 2, 4) AS x, round(i + s * (a + k * (b - a) / 2), 4) AS fit FROM m, range(0, 3) g(k)"""


def _spline_sql(degree: int = 1, vcov: str | None = None, g: str = "0") -> str:
    """A spline in thousands, whose knots are the right ends of the first five bins; with ``vcov``, standard errors too."""
    x = lambda v: [f"pow({v} / 1000, {d})" for d in range(1, degree + 1)] + [f"pow(greatest(0, {v} - (SELECT k[{j}] FROM kn)) / 1000, {r})" for j in range(1, 6) for r in range(1, degree + 1)]
    kn = f"kn AS (SELECT list(r ORDER BY bin) AS k, list(m ORDER BY bin) AS m, list(bin ORDER BY bin) AS b FROM (SELECT bin, max(l_extendedprice) AS r, avg(l_extendedprice) AS m FROM {_ES6} GROUP BY bin)),\n"
    p = 1 + 6 * degree
    at = f"pt AS (SELECT b[u] AS bin, m[u] AS x, [1.0::DOUBLE, {', '.join(x('m[u]'))}] AS w FROM kn, range(1, 7) q(u))"
    fit = "round(list_sum(list_transform(w, lambda v, i: v * beta[i])), 4) AS fit"
    if vcov is None:
        return f"""WITH RECURSIVE {kn}{solved_ctes(_rows(["1", *x("l_extendedprice")], "l_quantity"), p)}, {at}
SELECT bin, round(x, 4) AS x, {fit} FROM pt, fit"""
    spread = {"hc1": f"SELECT bin, sum(s * s) * any_value(n) / (any_value(n) - {p}.0) AS v FROM (SELECT pt.bin, e * list_sum(list_transform(res.x, lambda v, i: v * list_sum(list_transform(w, lambda z, j: z * inv[i][j])))) AS s, n FROM res, pt, fit) GROUP BY bin"}
    spread["cluster"] = f"SELECT bin, sum(s * s) * count(*) / (count(*) - 1.0) * any_value(n) / (any_value(n) - {p}.0) AS v FROM (SELECT pt.bin, g, any_value(n) AS n, sum(e * list_sum(list_transform(res.x, lambda v, i: v * list_sum(list_transform(w, lambda z, j: z * inv[i][j]))))) AS s FROM res, pt, fit GROUP BY pt.bin, g) GROUP BY bin"
    return f"""WITH RECURSIVE {kn}{solved_ctes(_rows(["1", *x("l_extendedprice")], "l_quantity", g), p)}, {at}, v AS ({spread[vcov]})
SELECT pt.bin, round(pt.x, 4) AS x, {fit}, round(sqrt(v), 4) AS se FROM pt JOIN v ON v.bin = pt.bin, fit"""


QUERIES["binscatter_11"] = _points(["x", "fit"], points=(1, 1), strategy="moments")
ORACLES["binscatter_11"] = _spline_sql()
QUERIES["binscatter_21"] = _points(["x", "fit"], points=(2, 1), strategy="moments")
ORACLES["binscatter_21"] = _spline_sql(2)
QUERIES["binscatter_11_hc1"] = _points(["x", "fit", "se"], points=(1, 1), strategy="moments", vcov="hc1")
ORACLES["binscatter_11_hc1"] = _spline_sql(1, "hc1")
QUERIES["binscatter_11_cluster"] = _points(["x", "fit", "se"], points=(1, 1), strategy="moments", cluster="l_suppkey")
ORACLES["binscatter_11_cluster"] = _spline_sql(1, "cluster", "l_suppkey")
_bin_x = ["1", *(f"CASE WHEN bin = {b} THEN 1.0 ELSE 0.0 END" for b in range(2, 7)), "l_discount", *(_dummy(*f) for f in _qty)]


def binscatter_controls_fe(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = _scatter(spark, sf_dir, "l_quantity ~ l_extendedprice + l_discount | l_returnflag", vcov="hc1").model
    return _terms(spark, fit)


QUERIES["binscatter_controls_fe"] = binscatter_controls_fe
ORACLES["binscatter_controls_fe"] = regression_sql(_rows(_bin_x, "l_quantity", source=_ES6), ["(Intercept)", *(f"bin_{b}" for b in range(2, 7)), "l_discount", "l_returnflagN", "l_returnflagR"], vcov="hc1")
#: Bands are simulated, so there is no SQL for them.
QUERIES["binscatter_cb"] = _points(["x", "fit", "se", "cb_lwr", "cb_upr"], cb=True)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
