import math

import numpy as np
import pytest

from regrove.functions.linalg import independent_columns, solve_normal
from regrove.functions.tdist import p_two_sided, t_quantile
from regrove.operators.regress import parse_vcov
from regrove.plans.formula import parse_formula


def test_terms_by_degree_and_order():
    f = parse_formula("y ~ a * b + c + b:c | g + h")
    assert f.labels == ["a", "b", "c", "a:b", "b:c"]
    assert f.fe == ("g", "h") and f.variables == ["a", "b", "c"]
    assert parse_formula("y ~ (a + b)^2").labels == ["a", "b", "a:b"]
    assert parse_formula("y ~ a * b - a").labels == ["b", "a:b"]
    assert parse_formula("y ~ b:a + a:b").labels == ["b:a"]


@pytest.mark.parametrize("text, message", [("y ~ 1", "No regressors on RHS"), ("y ~ ", "No regressors on RHS"), ("y + z ~ x", "Exactly one outcome variable required"), ("y ~ log(x)", "not supported"), ("y ~ a | b:c", "single variables"), ("y ~ a b", "at the end")])
def test_bad_formulas(text, message):
    with pytest.raises(ValueError, match=message):
        parse_formula(text)


def test_intercept_dropped_is_noted():
    assert parse_formula("y ~ 0 + x").no_intercept and parse_formula("y ~ x - 1").no_intercept


def test_vcov_arguments():
    assert parse_vcov(None, None) == ("iid", None)
    assert parse_vcov("HC1", None) == ("hc1", None)
    assert parse_vcov("~ g", None) == ("cluster", "g") and parse_vcov("hc1", "g") == ("cluster", "g")
    for bad in ("hc3", "~ a + b"):
        with pytest.raises(ValueError):
            parse_vcov(bad, None)


def test_student_t():
    assert p_two_sided(-2, 10) == pytest.approx(0.0733880348, rel=1e-8)
    assert p_two_sided(-1.96, 38295) == pytest.approx(0.0500030, rel=1e-5)
    assert p_two_sided(-8.5, 59994) == pytest.approx(1.9387e-17, rel=1e-3)
    assert p_two_sided(1.0, 1) == pytest.approx(0.5)
    assert t_quantile(0.975, 1) == pytest.approx(12.7062047, rel=1e-7)
    assert t_quantile(0.975, 1e9) == pytest.approx(1.959963985, rel=1e-7)
    assert t_quantile(0.025, 7) == pytest.approx(-t_quantile(0.975, 7)) and math.isinf(t_quantile(1.0, 3))


def test_last_redundant_column_goes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3)) * [1, 1e4, 1e-3]
    x = np.column_stack([x, x[:, 0] + x[:, 1], np.zeros(50)])
    assert independent_columns(x.T @ x) == [0, 1, 2]


def test_normal_equations():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 4)) * [1, 1e3, 1e-2, 5], rng.normal(size=80)
    beta, inverse = solve_normal(x.T @ x, x.T @ y)
    assert np.allclose(beta, np.linalg.lstsq(x, y, rcond=None)[0]) and np.allclose(inverse @ (x.T @ x), np.eye(4), atol=1e-8)
