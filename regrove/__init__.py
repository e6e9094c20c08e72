"""regrove: formula-driven regression over Spark relations via mergeable sufficient statistics."""

from .operators.regress import regress
from .operators.result import RegressionResult
from .plans.design import model_matrix
from .plans.formula import parse_formula

__version__ = "0.1.0"
__all__ = ["RegressionResult", "model_matrix", "parse_formula", "regress"]
