"""Model formulas as column expressions: ``y ~ a + C(g) + a:b + I(x**2) + log(z) - 1``."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double, col, is_numeric

FUNCTIONS = {"log": F.log, "exp": F.exp, "sqrt": F.sqrt, "log2": F.log2, "log10": F.log10, "log1p": F.log1p, "expm1": F.expm1, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "square": lambda c: c * c}
STATEFUL = {"center", "standardize", "scale"}
MOST_LEVELS = 500


class FormulaError(ValueError):
    """The formula cannot be read or does not fit the data."""


@dataclass
class Design:
    """What is needed to rebuild the same columns on other data: outcome, terms, levels and centring."""

    outcome: str
    outcome_source: str
    intercept: bool
    terms: list[list[str]]
    levels: dict[str, list[str]] = field(default_factory=dict)
    states: dict[str, list[float]] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)

    def to_json(self) -> dict[str, Any]:
        return self.__dict__.copy()


def _split(text: str, marks: str) -> list[tuple[str, str]]:
    """Top-level parts of ``text`` with the mark before each."""
    out, depth, start, mark, quote = [], 0, 0, "+", ""
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif not depth and ch in marks and not (ch == "*" and "**" in (text[i : i + 2], text[i - 1 : i + 1])):
            out.append((mark, text[start:i].strip()))
            mark, start = ch, i + 1
    out.append((mark, text[start:].strip()))
    if depth or quote:
        raise FormulaError("unbalanced formula")
    return out


def parse(formula: str) -> tuple[str, bool, list[list[str]]]:
    """(outcome, intercept, terms); a term is a list of factors."""
    sides = formula.split("~")
    if len(sides) != 2 or not sides[0].strip() or not sides[1].strip():
        raise FormulaError("a formula needs one outcome and one right side")
    intercept, terms = True, []
    for mark, part in _split(sides[1].strip(), "+-"):
        if part in ("0", "1", ""):
            if not part and mark == "+" and not terms:
                continue
            intercept = (part == "1") == (mark == "+")
            continue
        crossed = [p for _, p in _split(part, "*")]
        expanded: list[list[str]] = [[]]
        for p in crossed:
            own = [x for _, x in _split(p, ":")]
            expanded = expanded + [e + own for e in expanded]
        for term in sorted((e for e in expanded if e), key=len):
            if any(not f for f in term):
                raise FormulaError(f"empty factor in {part!r}")
            if mark == "-":
                terms = [t for t in terms if sorted(t) != sorted(term)]
            elif not any(sorted(t) == sorted(term) for t in terms):
                terms.append(term)
    return sides[0].strip(), intercept, terms


def _categorical(factor: str) -> str | None:
    """The source of ``C(source)``."""
    m = re.fullmatch(r"C\((.*)\)", factor.strip(), re.S)
    return m[1].strip() if m else None


def _node(node: ast.AST, df: DataFrame, design: Design | None, seen: list[str]) -> Column:
    if isinstance(node, ast.Expression):
        return _node(node.body, df, design, seen)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        if node.id not in df.columns:
            raise FormulaError(f"unknown column {node.id!r}")
        seen.append(node.id)
        dtype = df.schema[node.id].dataType
        if isinstance(dtype, T.BooleanType):
            return col(node.id).cast("int").cast("double")
        if not is_numeric(df, node.id):
            raise FormulaError(f"{node.id!r} is not numeric here")
        return as_double(col(node.id))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        value = _node(node.operand, df, design, seen)
        return -value if isinstance(node.op, ast.USub) else value
    if isinstance(node, ast.BinOp):
        a, b = _node(node.left, df, design, seen), _node(node.right, df, design, seen)
        made = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b, ast.Pow: lambda: F.pow(a, b), ast.Mod: lambda: a % b}.get(type(node.op))
        if made:
            return made()
    if isinstance(node, ast.Call):
        name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
        if name == "Q" and len(node.args) == 1 and isinstance(node.args[0], ast.Constant):
            return _node(ast.Name(id=str(node.args[0].value)), df, design, seen)
        if len(node.args) == 1 and not node.keywords:
            inner = _node(node.args[0], df, design, seen)
            if name == "I":
                return inner
            if name in FUNCTIONS:
                return FUNCTIONS[name](inner)
            if name in STATEFUL and design is not None:
                key = ast.unparse(node)
                if key not in design.states:
                    r = df.agg(F.avg(inner).alias("m"), F.stddev_pop(inner).alias("s")).first()
                    design.states[key] = [float(r["m"] or 0.0), float(r["s"] or 1.0)]
                mean, sd = design.states[key]
                return (inner - F.lit(mean)) / F.lit(1.0 if name == "center" else sd)
    raise FormulaError(f"cannot read {ast.dump(node)[:60]}")


def expression(text: str, df: DataFrame, design: Design | None, seen: list[str]) -> Column:
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise FormulaError(str(e)) from e
    return _node(tree, df, design, seen)


def _contrast(factor: str, levels: list[str]) -> tuple[list[str], list[list[float]]]:
    """(suffixes, a row of codes per level) of a categorical factor: Treatment unless C(x, Kind) names another coding."""
    wrapped = _categorical(factor)
    parts = [p for _, p in _split(wrapped, ",")] if wrapped is not None else [factor]
    m = re.fullmatch(r"(Treatment|Sum|Helmert|Diff|Poly)\s*(?:\((.*)\))?", parts[1] if len(parts) > 1 else "Treatment", re.S)
    if not m or len(parts) > 2:
        raise FormulaError(f"unknown coding in {factor!r}")
    kind, argument, k = m[1], (m[2] or "").split("=")[-1].strip().strip("\"'"), len(levels)
    if kind == "Treatment":
        if argument and argument not in levels:
            raise FormulaError(f"{argument!r} is no level of {factor!r}")
        base = levels.index(argument) if argument else 0
        rest = [i for i in range(k) if i != base]
        return [f"[T.{levels[i]}]" for i in rest], [[float(i == j) for j in rest] for i in range(k)]
    if kind == "Sum":
        return [f"[S.{v}]" for v in levels[:-1]], [[-1.0 if i == k - 1 else float(i == j) for j in range(k - 1)] for i in range(k)]
    if kind == "Helmert":
        return [f"[H.{v}]" for v in levels[1:]], [[float(j + 1) if i == j + 1 else -1.0 if i <= j else 0.0 for j in range(k - 1)] for i in range(k)]
    if kind == "Diff":
        return [f"[D.{v}]" for v in levels[:-1]], [[(j + 1) / k if i > j else (j + 1 - k) / k for j in range(k - 1)] for i in range(k)]
    powers = np.vander(np.arange(k) - (k - 1) / 2, k, increasing=True)
    q, r = np.linalg.qr(powers)
    codes = (q * np.sign(np.diag(r)))[:, 1:]
    names = [".Linear", ".Quadratic", ".Cubic"] + [f"^{n}" for n in range(4, k)]
    return names[: k - 1], codes.tolist()


def _source(text: str, df: DataFrame) -> str:
    """The column that a factor names plainly or by Q("...")."""
    m = re.fullmatch(r"""Q\(\s*(["'])(.*)\1\s*\)""", text.strip())
    name = m[2] if m else text.strip()
    if name not in df.columns:
        raise FormulaError(f"unknown column {name!r}")
    return name


def _is_categorical(factor: str, df: DataFrame) -> str | None:
    wrapped = _categorical(factor)
    if wrapped is not None:
        inner = _split(wrapped, ",")[0][1]
        return _source(inner, df)
    try:
        name = _source(factor, df)
    except FormulaError:
        return None
    return name if isinstance(df.schema[name].dataType, (T.StringType, T.DateType)) else None


def design_of(formula: str, df: DataFrame) -> Design:
    """Learn levels (sorted distinct values) and centring from ``df``."""
    outcome, intercept, terms = parse(formula)
    seen: list[str] = []
    design = Design(outcome, "", intercept, terms)
    expression(outcome, df, None, seen)
    design.outcome_source = seen[0] if seen else outcome
    for term in terms:
        for factor in term:
            name = _is_categorical(factor, df)
            if name is not None and factor not in design.levels:
                rows = df.where(col(name).isNotNull()).select(col(name).alias("v")).distinct().limit(MOST_LEVELS + 1).collect()
                if len(rows) > MOST_LEVELS:
                    raise FormulaError(f"{name!r} has more than {MOST_LEVELS} levels")
                design.levels[factor] = [str(v) for v in sorted(r["v"] for r in rows)]
    design.terms = _ordered(terms, design.levels)
    design.names = [n for n, _ in columns(design, df)]
    return design


def _ordered(terms: list[list[str]], levels: dict[str, list[str]]) -> list[list[str]]:
    """Categorical terms first, then terms by the numeric factors they share, as these first come; in each, fewer factors first."""
    buckets: dict[frozenset[str], list[list[str]]] = {frozenset(): []}
    for term in terms:
        buckets.setdefault(frozenset(f for f in term if f not in levels), []).append(term)
    return [t for own in buckets.values() for t in sorted(own, key=len)]


def _coded(text: Column, levels: list[str], codes: list[float]) -> Column:
    """A code per level, null for values that are no level."""
    out = F.lit(None).cast("double")
    for level, code in zip(levels, codes, strict=True):
        out = F.when(text == F.lit(level), F.lit(float(code))).otherwise(out)
    return out


def columns(design: Design, df: DataFrame) -> list[tuple[str, Column]]:
    """(name, expression) of each design column. Treatment coding; without an intercept the first categorical term has all levels."""
    out: list[tuple[str, Column]] = [("Intercept", F.lit(1.0))] if design.intercept else []
    seen: list[str] = []
    full = not design.intercept
    for term in design.terms:
        made: list[tuple[str, Column]] = [("", F.lit(1.0))]
        for factor in term:
            levels = design.levels.get(factor)
            if levels is None:
                own = [(factor, expression(factor, df, design, seen))]
            else:
                name = _is_categorical(factor, df)
                if name is None:
                    raise FormulaError(f"unknown column in {factor!r}")
                seen.append(name)
                text = col(name).cast("string")
                whole = full and len(term) == 1
                known = F.when(text.isin(levels), 1.0)
                if whole:
                    own = [(f"{factor}[{v}]", F.when(text == F.lit(v), 1.0).otherwise(known * 0.0)) for v in levels]
                else:
                    suffixes, codes = _contrast(factor, levels)
                    own = [(factor + name, _coded(text, levels, [row[j] for row in codes])) for j, name in enumerate(suffixes)]
                full = full and not whole
            made = [(f"{a}:{b}" if a else b, x * y if a else y) for a, x in made for b, y in own]
        out += made
    design.sources = sorted(set(seen))
    if not out:
        raise FormulaError("no terms")
    return out


def frame(design: Design, df: DataFrame, keep: list[str] | None = None, outcome: bool = True) -> DataFrame:
    """x0.., y (if wanted) and the kept columns; rows with a gap in any of them have a null x or y."""
    made = [e.alias(f"x{i}") for i, (_, e) in enumerate(columns(design, df))]
    y = [expression(design.outcome, df, None, []).alias("y")] if outcome else []
    return df.select(*made, *y, *[col(k) for k in keep or []])


def complete(data: DataFrame, design: Design, outcome: bool = True) -> DataFrame:
    names = [f"x{i}" for i in range(len(design.names))] + (["y"] if outcome else [])
    condition = " AND ".join(f"{n} IS NOT NULL AND NOT isnan({n})" for n in names)
    return data.where(condition)
