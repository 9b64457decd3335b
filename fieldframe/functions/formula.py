"""Band arithmetic: formula text to a Column or to DuckDB SQL, through Python's own parser and a whitelist.

Division by zero gives null, as does the root of a negative number. ``^`` is a power. A wavelength NNNnm reads the band
named nmNNN; h, s and b read hsb_h, hsb_s and hsb_b, as names are not case-sensitive.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HSB = {"h": "hsb_h", "s": "hsb_s", "b": "hsb_b"}
FUNCTIONS = {"sqrt", "abs", "atan", "exp", "log"}


def parse(formula: str) -> ast.expr:
    text = re.sub(r"\b(\d+)nm\b", r"nm\1", formula).replace("^", "**")
    tree = ast.parse(text.strip(), mode="eval").body
    for node in ast.walk(tree):
        known = isinstance(node, (ast.BinOp, ast.UnaryOp, ast.Name, ast.Load, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow, ast.USub, ast.UAdd))
        known = known or isinstance(node, ast.Constant) and isinstance(node.value, (int, float))
        known = known or isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and len(node.args) == 1
        if not known:
            raise ValueError(f"not band arithmetic: {formula!r}")
    return tree


def bands(formula: str) -> set[str]:
    """The columns that a formula reads."""
    tree = parse(formula)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {HSB.get(n.id, n.id) for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


def computable(available: set[str], catalogue: dict[str, str]) -> list[str]:
    """Names of the catalogue's formulas that need no other band."""
    return [name for name, f in catalogue.items() if bands(f) <= available]


def column(formula: str, of: dict | None = None) -> Column:
    """The formula as a Column; ``of`` gives bands another column, by name or as a Column."""

    def walk(n: ast.expr) -> Column:
        if isinstance(n, ast.Constant):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            name = HSB.get(n.id, n.id)
            found = (of or {}).get(name, name)
            return F.col(found) if isinstance(found, str) else found
        if isinstance(n, ast.UnaryOp):
            x = walk(n.operand)
            return -x if isinstance(n.op, ast.USub) else x
        if isinstance(n, ast.Call):
            x = walk(n.args[0])
            if n.func.id == "sqrt":
                return F.when(x >= 0, F.sqrt(x))
            return getattr(F, n.func.id)(x)
        a, b = walk(n.left), walk(n.right)
        if isinstance(n.op, ast.Add):
            return a + b
        if isinstance(n.op, ast.Sub):
            return a - b
        if isinstance(n.op, ast.Mult):
            return a * b
        if isinstance(n.op, ast.Div):
            return F.try_divide(a, b)
        return F.when(~((a == 0) & (b < 0)), F.pow(a, b))

    return walk(parse(formula))


def sql(formula: str) -> str:
    """The formula in DuckDB's dialect."""

    def walk(n: ast.expr) -> str:
        if isinstance(n, ast.Constant):
            return f"{float(n.value)!r}::DOUBLE"
        if isinstance(n, ast.Name):
            return HSB.get(n.id, n.id)
        if isinstance(n, ast.UnaryOp):
            return f"(-{walk(n.operand)})" if isinstance(n.op, ast.USub) else walk(n.operand)
        if isinstance(n, ast.Call):
            x = walk(n.args[0])
            return f"(CASE WHEN {x} >= 0 THEN sqrt({x}) END)" if n.func.id == "sqrt" else f"{n.func.id}({x})"
        a, b = walk(n.left), walk(n.right)
        if isinstance(n.op, ast.Div):
            return f"({a} / nullif({b}, 0))"
        if isinstance(n.op, ast.Pow):
            return f"(CASE WHEN NOT ({a} = 0 AND {b} < 0) THEN pow({a}, {b}) END)"
        return f"({a} {'+' if isinstance(n.op, ast.Add) else '-' if isinstance(n.op, ast.Sub) else '*'} {b})"

    return walk(parse(formula))
