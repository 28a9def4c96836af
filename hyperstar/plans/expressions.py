"""The expression language: a parser by precedence, and its translation to Columns.

``a + b * 2``, ``price > 10 and not (kind = 'x')``, ``round(amount / 3, 2)``,
``sum(amount) - sum(vat)``, ``extract(year, day)``. Names may have dots.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ExpressionError
from ..functions import scalars


@dataclass(frozen=True)
class Value:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")"""
    r"""|(?P<name>[^\W\d]\w*(?:\.[^\W\d]\w*)*)|(?P<op><=|>=|!=|<>|==|[-+*/%<>=&|~(),])|(?P<bad>\S))"""
)
_BINDING = {"or": 1, "and": 2, "=": 4, "==": 4, "!=": 4, "<>": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "|": 5, "&": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8}
_NOT, _SIGN = 3, 9


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, [], 0
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind is None:
                continue
            if kind == "bad":
                raise ExpressionError(f"'{m['bad']}' has no meaning in '{text}'")
            self.tokens.append((kind, m[kind]))

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, op: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if op is not None and t != ("op", op):
            raise ExpressionError(f"'{op}' is missing in '{self.text}'")
        self.at += 1
        return t

    def binary(self) -> str | None:
        kind, x = self.peek()
        return x.lower() if (kind == "op" or kind == "name") and x.lower() in _BINDING else None

    def expression(self, least: int = 0):
        left = self.prefix()
        while (op := self.binary()) and _BINDING[op] > least:
            self.take()
            left = Binary({"==": "=", "<>": "!="}.get(op, op), left, self.expression(_BINDING[op]))
        return left

    def prefix(self):
        kind, x = self.take()
        if kind == "number":
            return Value(int(x) if x.isdigit() else float(x))
        if kind == "text":
            return Value(x[1:-1].replace(x[0] * 2, x[0]))
        if kind == "op" and x == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if kind == "op" and x in "-+~":
            return Unary(x, self.expression(_SIGN))
        if kind == "name":
            low = x.lower()
            if low == "not":
                return Unary("not", self.expression(_NOT))
            if low in ("null", "true", "false"):
                return Value({"null": None, "true": True, "false": False}[low])
            if self.peek() != ("op", "("):
                return Name(x)
            self.take("(")
            args = []
            while self.peek() != ("op", ")"):
                args.append(self.expression())
                if self.peek() != ("op", ")"):
                    self.take(",")
            self.take(")")
            return Call(x, tuple(args))
        raise ExpressionError(f"a value is missing in '{self.text}'")


@lru_cache(maxsize=1024)
def parse(text: str):
    p = _Parser(text)
    tree = p.expression()
    if p.peek()[0] != "end":
        raise ExpressionError(f"'{p.peek()[1]}' does not belong in '{text}'")
    return tree


def names(tree) -> set[str]:
    """What an expression refers to, without variables and the parts of dates."""
    if isinstance(tree, str):
        tree = parse(tree)
    if isinstance(tree, Name):
        return set() if tree.name.lower() in scalars.VARIABLES else {tree.name}
    if isinstance(tree, Call):
        return set().union(*map(names, tree.args[1:] if tree.name.lower() == "extract" else tree.args))
    if isinstance(tree, Unary):
        return names(tree.arg)
    return names(tree.left) | names(tree.right) if isinstance(tree, Binary) else set()


#: Functions that aggregate when they are called with one value.
AGGREGATING = ("sum", "min", "max", "avg", "stddev", "variance", "count", "count_distinct")
_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "stddev": F.stddev_samp, "variance": F.var_samp, "count": F.count, "count_distinct": F.count_distinct}

_OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "%": lambda a, b: a % F.nullif(b, F.lit(0)),
    "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "=": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "and": lambda a, b: a & b, "or": lambda a, b: a | b,
}
_SIGNS: dict[str, Callable[[Column], Column]] = {"-": lambda a: -a, "+": lambda a: a, "~": F.bitwise_not, "not": lambda a: ~a}


def to_column(tree, find: Callable[[str], Column], rows: Callable[[str], Column] | None = None) -> Column:
    """An expression as a Column; ``find`` has the Column of a name. With ``rows`` aggregate functions may be called, and ``rows`` has what a name means within them."""
    if isinstance(tree, str):
        tree = parse(tree)
    if isinstance(tree, Value):
        return F.lit(tree.value)
    if isinstance(tree, Name):
        variable = scalars.VARIABLES.get(tree.name.lower())
        return variable() if variable else find(tree.name)
    if isinstance(tree, Unary):
        return _SIGNS[tree.op](to_column(tree.arg, find, rows))
    if isinstance(tree, Binary):
        return _OPERATIONS[tree.op](to_column(tree.left, find, rows), to_column(tree.right, find, rows))
    low = tree.name.lower()
    if low == "extract":
        if len(tree.args) != 2 or not isinstance(tree.args[0], (Name, Value)):
            raise ExpressionError("extract takes a part of a date and a date")
        part = tree.args[0].name if isinstance(tree.args[0], Name) else str(tree.args[0].value)
        return scalars.extract(part, to_column(tree.args[1], find, rows))
    if low in AGGREGATING and rows is not None and len(tree.args) == 1:
        return _AGGREGATE[low](to_column(tree.args[0], rows))
    if low == "count" and rows is not None and not tree.args:
        return F.count(F.lit(1))
    if low in AGGREGATING and low not in ("min", "max"):
        raise ExpressionError(f"aggregate function '{tree.name}' does not belong here")
    return scalars.call(tree.name, [to_column(a, find, rows) for a in tree.args])
