"""User expressions: one Python expression compiled to a Column, by a whitelist over its syntax tree."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """The expression cannot be compiled, or names what there is not."""


def _log(f):
    return lambda x: F.when(x > 0, f(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arctan2": F.atan2, "log": _log(F.ln), "log10": _log(F.log10), "exp": F.exp,
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)).otherwise(F.lit(float("nan"))), "abs": F.abs, "isnan": F.isnan,
    "isfinite": lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), "minimum": F.least, "maximum": F.greatest,
    "where": lambda c, a, b: F.when(c, a).otherwise(b), "rad2deg": F.degrees, "deg2rad": F.radians,
}
CONSTANTS = {"pi": math.pi, "e": math.e, "nan": math.nan, "inf": math.inf}
_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a, b)),  # the sign is the divisor's, as in Python
    ast.Pow: F.pow,
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)),
    ast.BitAnd: lambda a, b: a & b,
    ast.BitOr: lambda a, b: a | b,
}
_COMPARE = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


#: Types of columns that hold no NaN.
_NO_NAN = {"tinyint", "smallint", "int", "bigint", "string", "boolean", "date", "timestamp", "timestamp_ntz"}


def compile_expression(text: str, columns: Iterable[str] | Mapping[str, str], functions: dict[str, Callable[..., Column]] | None = None) -> Column:
    """The Column of `text` over `columns` (names, or names with their types); np.f and f are the same function.

    Division by zero gives null. NaN compares as in Python: every comparison with it is false but `!=`, which is true.
    """
    known, functions = dict(columns) if isinstance(columns, Mapping) else dict.fromkeys(columns), {**FUNCTIONS, **(functions or {})}
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"{text!r} is not an expression: {e.msg}") from e

    def number(n: ast.AST) -> bool:
        """Whether n may be NaN."""
        match n:
            case ast.Constant():
                return False
            case ast.Name() if n.id in known:
                return known[n.id] not in _NO_NAN
            case ast.Compare() | ast.BoolOp() | ast.UnaryOp(op=ast.Not() | ast.Invert()):
                return False
        return True

    def compare(op: ast.cmpop, a: ast.AST, b: ast.AST) -> Column:
        x, y = visit(a), visit(b)
        text = any(isinstance(n, ast.Constant) and isinstance(n.value, str) for n in (a, b))
        nan = [F.isnan(c.try_cast("double")) for n, c in ((a, x), (b, y)) if not text and number(n)]
        out = _COMPARE[type(op)](x, y)
        for c in nan:
            out = out | c if isinstance(op, ast.NotEq) else out & ~c
        return out

    def visit(n: ast.AST) -> Column:
        match n:
            case ast.Constant(value=bool() | int() | float() | str()):
                return F.lit(n.value)
            case ast.Name() if n.id in known:
                return F.col(f"`{n.id}`")
            case ast.Name() if n.id in CONSTANTS:
                return F.lit(CONSTANTS[n.id])
            case ast.Attribute(value=ast.Name(id="np")) if n.attr in CONSTANTS:
                return F.lit(CONSTANTS[n.attr])
            case ast.BinOp() if type(n.op) in _BINARY:
                return _BINARY[type(n.op)](visit(n.left), visit(n.right))
            case ast.UnaryOp(op=ast.USub()):
                return -visit(n.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return visit(n.operand)
            case ast.UnaryOp(op=ast.Not() | ast.Invert()):
                return ~visit(n.operand)
            case ast.BoolOp():
                parts = [visit(v) for v in n.values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(n.op, ast.And) else out | p
                return out
            case ast.Compare() if all(type(o) in _COMPARE for o in n.ops):
                sides = [n.left, *n.comparators]
                out = None
                for o, a, b in zip(n.ops, sides, sides[1:], strict=False):
                    c = compare(o, a, b)
                    out = c if out is None else out & c
                return out
            case ast.IfExp():
                return F.when(visit(n.test), visit(n.body)).otherwise(visit(n.orelse))
            case ast.Subscript():
                return visit(n.value)[visit(n.slice)]
            case ast.Call(func=ast.Name(id=name)) | ast.Call(func=ast.Attribute(value=ast.Name(id="np"), attr=name)) if name in functions and not n.keywords:
                return functions[name](*map(visit, n.args))
        raise ExpressionError(f"{ast.unparse(n)!r} in {text!r} is not allowed or not known")

    return visit(tree)
