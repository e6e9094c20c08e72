import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from regrove.operators import binscatter as B
from regrove.operators.binscatter import binscatter, equal_width_bins, manual_bins, ntile_bins
from regrove.queries import queries


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    x, w = rng.uniform(0, 10, 600), rng.normal(size=600)
    data = pd.DataFrame({"id": range(600), "x": x, "w": w, "y": 2 * x + rng.normal(size=600), "f": rng.integers(0, 3, 600)})
    data["yc"] = data.y + 0.5 * w
    return data, spark.createDataFrame(data).cache()


def test_bin_means_and_hc1(noisy):
    data, df = noisy
    r = binscatter("y ~ x", table=df, nbins=5, tie=["x"])
    data = data.sort_values("x").assign(bin=np.repeat(range(1, 6), 120))
    for p, (_, g) in zip(r.points, data.groupby("bin")):
        assert p["x"] == pytest.approx(g.x.mean()) and p["fit"] == pytest.approx(g.y.mean())
        assert p["se"] == pytest.approx(np.sqrt(((g.y - g.y.mean()) ** 2).sum() / 120**2 * 600 / 595))
        assert p["lwr"] < p["fit"] < p["upr"]
    assert r.opt["nbins"] == 5 and r.opt["N"] == 600 and "Binned scatter" in str(r) and r.svg().startswith("<svg")


def test_piecewise_lines_and_splines(noisy, spark):
    data, df = noisy
    r = binscatter("y ~ x", table=df, nbins=4, points=(1, 0), line=(1, 1), linegrid=5)
    data = data.sort_values("x").assign(bin=np.repeat(range(1, 5), 150))
    for p, (_, g) in zip(r.points, data.groupby("bin")):
        slope, cut = np.polyfit(g.x, g.y, 1)
        assert p["fit"] == pytest.approx(cut + slope * g.x.mean(), rel=1e-8)
    knots = data.groupby("bin").x.max().to_numpy()[:3]
    design = lambda v: np.column_stack([np.ones(len(v)), v, *(np.maximum(0, v - k) for k in knots)])
    b = np.linalg.lstsq(design(data.x.to_numpy()), data.y, rcond=None)[0]
    at = np.array([p["x"] for p in r.line])
    assert len(r.line) == 20 and np.allclose([p["fit"] for p in r.line], design(at) @ b, atol=1e-6)
    assert r.frame(spark, "bins").count() == 4 and r.frame(spark, "line").count() == 20


def test_controls_fixed_effects_and_band(noisy):
    data, df = noisy
    r = binscatter("yc ~ x + w | f", table=df, nbins=4, cb=True)
    d = data.sort_values("x").assign(bin=np.repeat(range(1, 5), 150))
    x = np.column_stack([*((d.bin == k).astype(float) for k in range(1, 5)), d.w, d.f == 1, d.f == 2])
    b = np.linalg.lstsq(x, d.yc, rcond=None)[0]
    assert np.allclose([p["fit"] for p in r.points], b[:4])
    assert all(p["cb_lwr"] < p["lwr"] and p["cb_upr"] > p["upr"] for p in r.points)


def test_bins(spark, noisy, monkeypatch):
    _, df = noisy
    v = spark.createDataFrame([(float(k),) for k in [0, 1, 2, 5, 10]], "x double")
    assert [r[0] for r in v.select(equal_width_bins(F.col("x"), 0, 10, 5)).collect()] == [1, 1, 2, 3, 5]
    assert [r[0] for r in v.select(manual_bins(F.col("x"), [1, 2, 5])).collect()] == [None, 1, 2, 2, None]
    assert [r[0] for r in v.select(equal_width_bins(F.col("x"), 3, 3, 5)).collect()] == [1] * 5
    whole = {r["id"]: r["bin"] for r in ntile_bins(df, F.col("x"), 7, [F.col("id")]).collect()}
    monkeypatch.setattr(B, "WINDOW_ROWS", 10)
    assert {r["id"]: r["bin"] for r in ntile_bins(df, F.col("x"), 7, [F.col("id")]).collect()} == whole


def test_degenerate_and_wrong_inputs(spark, noisy):
    _, df = noisy
    few = spark.createDataFrame([(float(k % 3), float(k)) for k in range(30)], "x double, y double")
    with pytest.warns(UserWarning, match="nbins"):
        r = binscatter("y ~ x", table=few, nbins=10, points=(1, 0))
    assert all(not np.isnan(p["fit"]) for p in r.points)
    assert len(binscatter("y ~ x", table=few, nbins=1).points) == 1
    assert [b["id"] for b in binscatter("y ~ x", table=df, binspos=[2.0, 5.0]).bins] == [1, 2, 3]
    for bad in ({"points": (0, 1)}, {"level": 1.5}, {"nbins": 0}, {"linegrid": 1}, {"randcut": 2}, {"points": None}, {"binspos": "no"}):
        with pytest.raises(ValueError):
            binscatter("y ~ x", table=df, **bad)
    with pytest.raises(ValueError, match="interactions"):
        binscatter("y ~ x:w", table=df)
    with pytest.warns(DeprecationWarning):
        binscatter("y ~ x", table=df, nbins=2, dots=(0, 0))


def test_breaks_from_a_sample(noisy, monkeypatch):
    _, df = noisy
    monkeypatch.setattr(B, "SAMPLE_LEAST", 100)
    r = binscatter("y ~ x", table=df, nbins=4, randcut=0.5)
    assert r.opt["N"] == 600 and len(r.points) == 4
    s = binscatter("y ~ x", table=df, nbins=4, randcut=0.5, points=(1, 1), sample_fit=True)
    assert s.opt["N"] < 600
    assert binscatter("y ~ x", table=df, nbins=4, randcut=0.5, points=(1, 1)).opt["N"] == 600


@pytest.mark.parametrize("n_rows", [None, 10**9, 10**12])
def test_quantile_bins_of_any_number_of_rows(spark, monkeypatch, n_rows):
    """As NTILE: one x in nine of ten rows, ties that the tie columns break or do not, and rows that are equal throughout."""
    monkeypatch.setattr(B, "WINDOW_ROWS", 50)
    monkeypatch.setattr(B, "SPLITTERS", 12)
    rng = np.random.default_rng(8)
    x = np.where(rng.random(3000) < 0.9, 5.0, rng.integers(0, 40, 3000).astype(float))
    rows = [(float(v), None if k % 7 == 0 else f"t{rng.integers(0, 4)}", int(k) if k % 3 else 1) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, t string, k int").repartition(5)
    for tie in ([], ["t"], ["t", "k"]):
        for nbins in (1, 7, 20):
            columns = [F.col(c) for c in tie]
            got = ntile_bins(df, F.col("x"), nbins, columns, n_rows=n_rows)
            want = df.withColumn("bin", F.ntile(nbins).over(Window.orderBy("x", *tie)))
            by = lambda d: sorted(map(str, d.groupBy("x", *tie, "bin").count().collect()))
            assert by(got) == by(want) and got.columns == [*df.columns, "bin"]


def test_clashing_names(noisy):
    """Controls and fixed effects named like the columns that a binned scatter adds change nothing."""
    _, df = noisy
    df = df.withColumn("w", F.col("x") * F.col("x") + F.col("y") * 0.1)
    for order in ((0, 0), (1, 0), (1, 1)):
        want = binscatter("y ~ x + w", table=df, nbins=3, points=order)
        for name in ("bin", "BIN_2", "u1_2", "x1_spline", "knot1_pow1", "bin_one"):
            got = binscatter(f"y ~ x + {name}", table=df.withColumnRenamed("w", name), nbins=3, points=order)
            assert [p["fit"] for p in got.points] == pytest.approx([p["fit"] for p in want.points]), name


def test_registered_spline_takes_all_rows(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.uniform(1000, 90000, 2000)
    spark.createDataFrame(pd.DataFrame({"l_extendedprice": x, "l_quantity": x / 2000 + rng.normal(size=2000)})).write.parquet(str(tmp_path / "lineitem.parquet"))
    query = queries()["binscatter_11"]
    whole = query(spark, str(tmp_path)).collect()
    monkeypatch.setattr(B, "SAMPLE_LEAST", 100)
    assert query(spark, str(tmp_path)).collect() == whole


def test_bands_hold_all_points_at_once(spark):
    """Means of bins are independent, so the critical value of k of them is known: both bounds of a normal to the power k."""
    from statistics import NormalDist

    rng = np.random.default_rng(11)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.uniform(0, 4, 4000), "y": rng.normal(size=4000)}))
    for k in (1, 4):
        r = binscatter("y ~ x", table=df, nbins=k, binspos="es", cb=True, nsims=20_000)
        want = NormalDist().inv_cdf((1 + 0.95 ** (1 / k)) / 2)
        assert [(p["cb_upr"] - p["fit"]) / p["se"] for p in r.points] == pytest.approx([want] * k, abs=0.06)
        assert [p["fit"] - p["cb_lwr"] for p in r.points] == pytest.approx([p["cb_upr"] - p["fit"] for p in r.points])


def test_plots(noisy):
    _, df = noisy
    r = binscatter("y ~ x", table=df, nbins=4, line=(1, 0), cb=True, nsims=100)
    plain = r.svg()
    assert plain.count("<circle") == 4 and plain.count("<line") == 4 and plain.count("<polyline") == 4 and plain.count("<polygon") == 1
    other = r.svg(kind="errorbar", lty="dashed", theme="dark", cb=False)
    assert other.count("<line") == 12 and other.count("stroke-dasharray") == 4 and "#222" in other and "<polygon" not in other
    assert "<line" not in r.svg(kind="points") and "<polyline" not in r.svg(line=False)
    for bad in ({"kind": "x"}, {"lty": "x"}, {"theme": "x"}):
        with pytest.raises(ValueError):
            r.svg(**bad)
