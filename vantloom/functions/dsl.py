"""Two small languages compiled to Columns: scripts over one value, and programs over arrays."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantloom.functions.binding import let

_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Mod: lambda a, b: a % b, ast.Pow: lambda a, b: F.pow(a, b)}
_CALLS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "floor": F.floor, "ceil": F.ceil, "round": F.round, "upper": F.upper, "lower": F.lower, "trim": F.trim, "length": F.length}
_COMPARE = {ast.Gt: lambda a, b: a > b, ast.Lt: lambda a, b: a < b, ast.GtE: lambda a, b: a >= b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def script(value: Column, source: str) -> Column:
    """An expression over ``value``: arithmetic, comparisons, ``a if c else b`` and a few functions; nothing else is read."""

    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Name) and node.id == "value":
            return value
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool)):
            return F.lit(node.value)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -walk(node.operand)
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
            return _COMPARE[type(node.ops[0])](walk(node.left), walk(node.comparators[0]))
        if isinstance(node, ast.IfExp):
            return F.when(walk(node.test), walk(node.body)).otherwise(walk(node.orelse))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS:
            return _CALLS[node.func.id](*(walk(a) for a in node.args))
        raise ValueError(f"not allowed in a script: {ast.dump(node)[:60]}")

    return walk(ast.parse(source, mode="eval"))


_LINE = re.compile(r"^\s*(\w+)\s*=\s*(\w+)\(([^)]*)\)\s*$")


def _elementwise(op: Callable) -> Callable:
    def fn(a, b):
        if isinstance(b, float):
            return F.transform(a, lambda x: op(x, F.lit(b)))
        return F.zip_with(a, b, op)

    return fn


def _softmax(v: Column) -> Column:
    return let(F.array_max(v), lambda m: let(F.transform(v, lambda x: F.exp(x - m)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s))))


def _matmul(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: F.aggregate(F.zip_with(row, v, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))


_OPS: dict[str, Callable] = {
    "add": _elementwise(lambda x, y: x + y),
    "sub": _elementwise(lambda x, y: x - y),
    "mul": _elementwise(lambda x, y: x * y),
    "div": _elementwise(lambda x, y: x / y),
    "matmul": _matmul,
    "relu": lambda v: F.transform(v, lambda x: F.greatest(x, F.lit(0.0))),
    "sigmoid": lambda v: F.transform(v, lambda x: 1 / (1 + F.exp(-x))),
    "tanh": lambda v: F.transform(v, F.tanh),
    "softmax": _softmax,
    "transpose": lambda m: F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda k: F.transform(m, lambda row: F.get(row, k))),
    "reshape": lambda v, rows, cols: F.transform(F.sequence(F.lit(0), F.lit(int(rows) - 1)), lambda r: F.slice(v, r * int(cols) + 1, int(cols))),
    "concat": lambda *vs: F.concat(*vs),
    "slice": lambda v, start, length: F.slice(v, int(start) + 1, int(length)),
}


def compile_program(source: str) -> Callable[[dict[str, Column]], Column]:
    """Lines ``name = op(args)`` over array columns; the last line is the result. Numbers are constants."""
    steps = []
    for line in filter(str.strip, source.splitlines()):
        m = _LINE.match(line)
        if not m or m[2] not in _OPS:
            raise ValueError(f"cannot read {line!r}")
        steps.append((m[1], m[2], [a.strip() for a in m[3].split(",") if a.strip()]))

    def run(inputs: dict[str, Column]) -> Column:
        known: dict = dict(inputs)
        for name, op, args in steps:
            known[name] = _OPS[op](*(known[a] if a in known else float(a) for a in args))
        return known[steps[-1][0]]

    return run
