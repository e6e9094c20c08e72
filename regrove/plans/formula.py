"""Formulas ``y ~ x1 + x2:x3 + a * b | fe1 + fe2``."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

TOKEN = re.compile(r"\s*([A-Za-z_.][A-Za-z0-9_.]*|`[^`]+`|\d+|[+\-*:^()|~])")


@dataclass(frozen=True)
class Formula:
    """``terms``: main effects first, then by degree, each a tuple of variables; ``fe``: fixed effects."""

    outcome: str | None
    terms: tuple[tuple[str, ...], ...]
    fe: tuple[str, ...] = ()
    text: str = ""
    no_intercept: bool = False

    @property
    def variables(self) -> list[str]:
        """Regressor variables, in order of first appearance."""
        return list(dict.fromkeys(v for t in self.terms for v in t))

    @property
    def has_interactions(self) -> bool:
        return any(len(t) > 1 for t in self.terms)

    @property
    def labels(self) -> list[str]:
        return [":".join(t) for t in self.terms]


class _Parser:
    """Right-hand sides: + and -, then *, then :, then ^."""

    def __init__(self, text: str) -> None:
        self.tokens: list[str] = []
        at = 0
        while text[at:].strip():
            found = TOKEN.match(text, at)
            if not found:
                raise ValueError(f"cannot read formula at {text[at:].strip()[:20]!r}")
            self.tokens.append(found[1].strip("`"))
            at = found.end()
        self.at = 0
        self.dropped_intercept = False

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def next(self) -> str:
        if self.peek() is None:
            raise ValueError("formula ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def sum(self) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = []
        sign = "+"
        if self.peek() in ("+", "-"):
            sign = self.next()
        while True:
            terms = self.product()
            if sign == "-":
                self.dropped_intercept |= ("1",) in terms
                out = [t for t in out if t not in terms]
            else:
                self.dropped_intercept |= ("0",) in terms
                out += [t for t in terms if t not in (("0",), ("1",)) and t not in out]
            if self.peek() not in ("+", "-"):
                return out
            sign = self.next()

    def product(self) -> list[tuple[str, ...]]:
        out = self.cross()
        while self.peek() == "*":
            self.next()
            right = self.cross()
            out = _unique([*out, *right, *(_joined(a, b) for a in out for b in right)])
        return out

    def cross(self) -> list[tuple[str, ...]]:
        out = self.power()
        while self.peek() == ":":
            self.next()
            out = _unique([_joined(a, b) for a in out for b in [*self.power()]])
        return out

    def power(self) -> list[tuple[str, ...]]:
        out = self.atom()
        while self.peek() == "^":
            self.next()
            degree = int(self.next())
            out = _unique([_joined(*c) for k in range(1, degree + 1) for c in combinations(out, k)])
        return out

    def atom(self) -> list[tuple[str, ...]]:
        token = self.next()
        if token == "(":
            out = self.sum()
            if self.next() != ")":
                raise ValueError("formula lacks a closing bracket")
            return out
        if token in "+-*:^)|~":
            raise ValueError(f"formula has {token!r} where a variable should stand")
        if self.peek() == "(":
            raise ValueError(f"transformations such as {token}(...) are not supported; compute the column first")
        return [(token,)]


def _joined(*parts: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(v for p in parts for v in p))


def _unique(terms: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    seen: dict[frozenset, tuple[str, ...]] = {}
    for t in terms:
        seen.setdefault(frozenset(t), t)
    return list(seen.values())


def parse_terms(text: str) -> tuple[tuple[tuple[str, ...], ...], bool]:
    """(terms by degree, whether the intercept was dropped); variables of a term in order of first appearance."""
    parser = _Parser(text)
    terms = parser.sum()
    if parser.peek() is not None:
        raise ValueError(f"formula has {parser.peek()!r} at the end")
    order = {v: k for k, v in enumerate(dict.fromkeys(parser.tokens))}
    terms = _unique([tuple(sorted(t, key=order.get)) for t in terms])
    return tuple(sorted(terms, key=len)), parser.dropped_intercept


def parse_formula(text: str) -> Formula:
    left, tilde, right = text.partition("~")
    if not tilde:
        raise ValueError("a formula needs a ~")
    outcome = left.strip().strip("`")
    if not re.fullmatch(r"[A-Za-z_.][A-Za-z0-9_.]*", outcome):
        raise ValueError("Exactly one outcome variable required")
    parts = right.split("|")
    if len(parts) > 2:
        raise ValueError("a formula has at most two parts on its right side")
    terms, dropped = parse_terms(parts[0]) if parts[0].strip() else ((), False)
    if not terms:
        raise ValueError("No regressors on RHS")
    fe = parse_terms(parts[1])[0] if len(parts) == 2 and parts[1].strip() else ()
    if any(len(t) > 1 for t in fe):
        raise ValueError("fixed effects are single variables")
    return Formula(outcome, terms, tuple(t[0] for t in fe), text.strip(), dropped)
