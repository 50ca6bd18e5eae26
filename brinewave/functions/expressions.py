"""Safe compilers of scalar expressions and row filters to columns.

Text is parsed with Python's own grammar and only nodes of a white list become
column expressions; nothing is evaluated as code.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2,
    "exp": F.exp, "log": F.log, "log10": F.log10, "sqrt": F.sqrt, "abs": F.abs,
}
CONSTANTS = {"pi": math.pi, "e": math.e}
OPERATORS: dict[type, Callable] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b,
    ast.Mod: lambda a, b: F.pmod(a, b), ast.Pow: lambda a, b: F.pow(a, b), ast.FloorDiv: lambda a, b: F.floor(a / b),
}
COMPARISONS: dict[type, Callable] = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}


class _Compiler:
    def __init__(self, names: dict[str, Column | float] | None, columns: set[str] | None, functions: dict[str, Callable]):
        self.names, self.columns, self.functions = names or {}, columns, functions

    def build(self, node: ast.AST) -> Column:
        method = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if method is None:
            raise ValueError(f"not allowed in an expression: {type(node).__name__}")
        return method(node)

    def on_expression(self, node: ast.Expression) -> Column:
        return self.build(node.body)

    def on_constant(self, node: ast.Constant) -> Column:
        if not isinstance(node.value, (int, float, str, bool, type(None))):
            raise ValueError(f"not allowed as a constant: {node.value!r}")
        return F.lit(node.value)

    def on_name(self, node: ast.Name) -> Column:
        if node.id in self.names:
            value = self.names[node.id]
            return value if isinstance(value, Column) else F.lit(value)
        if self.columns is not None and node.id in self.columns:
            return F.col(f"`{node.id}`")
        if node.id in CONSTANTS:
            return F.lit(CONSTANTS[node.id])
        raise NameError(f"name {node.id!r} is not defined")

    def on_attribute(self, node: ast.Attribute) -> Column:
        if isinstance(node.value, ast.Name) and node.value.id in ("np", "math") and node.attr in CONSTANTS:
            return F.lit(CONSTANTS[node.attr])
        raise ValueError("attributes are not allowed in an expression")

    def on_unaryop(self, node: ast.UnaryOp) -> Column:
        x = self.build(node.operand)
        if isinstance(node.op, ast.USub):
            return -x
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return ~x
        return x

    def on_binop(self, node: ast.BinOp) -> Column:
        if isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            a, b = self.build(node.left), self.build(node.right)
            return a & b if isinstance(node.op, ast.BitAnd) else a | b
        if type(node.op) not in OPERATORS:
            raise ValueError(f"not allowed in an expression: {type(node.op).__name__}")
        return OPERATORS[type(node.op)](self.build(node.left), self.build(node.right))

    def on_boolop(self, node: ast.BoolOp) -> Column:
        parts = [self.build(v) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out

    def on_compare(self, node: ast.Compare) -> Column:
        out, left = None, node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.List, ast.Tuple)):
                    raise ValueError("'in' takes a list")
                one = self.build(left).isin(*[ast.literal_eval(x) for x in right.elts])
                one = ~one if isinstance(op, ast.NotIn) else one
            elif type(op) in COMPARISONS:
                one = COMPARISONS[type(op)](self.build(left), self.build(right))
            else:
                raise ValueError(f"not allowed in an expression: {type(op).__name__}")
            out, left = one if out is None else out & one, right
        return out

    def on_ifexp(self, node: ast.IfExp) -> Column:
        return F.when(self.build(node.test), self.build(node.body)).otherwise(self.build(node.orelse))

    def on_call(self, node: ast.Call) -> Column:
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in ("np", "math") else None
        if name not in self.functions or node.keywords:
            raise NameError(f"function {ast.unparse(f)!r} is not defined")
        return self.functions[name](*[self.build(a) for a in node.args])


def expression(text: str, variables: dict[str, Column | float] | None = None, columns: list[str] | None = None, functions: dict[str, Callable] | None = None) -> Column:
    """A column for an arithmetic expression over variables, columns and the listed functions."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as error:
        raise ValueError(f"not an expression: {text!r}") from error
    return _Compiler(variables, set(columns or ()), FUNCTIONS | (functions or {})).build(tree)


def condition(text: str, columns: list[str], variables: dict[str, Column | float] | None = None) -> Column:
    """A boolean column for a row filter: and/or/not, chained comparisons, in, `quoted names`, @variables."""
    quoted: dict[str, Column | float] = dict(variables or {})

    def quote(m: re.Match) -> str:
        if m[1] not in columns:
            raise ValueError(f"no column {m[1]!r}")
        name = f"_quoted_{len(quoted)}"
        quoted[name] = F.col(f"`{m[1]}`")
        return name

    plain = re.sub(r"@(?=[A-Za-z_])", "", re.sub(r"`([^`]+)`", quote, text))
    try:
        return expression(plain, quoted, columns)
    except NameError as error:
        raise ValueError(f"bad filter {text!r}: {error}") from error
