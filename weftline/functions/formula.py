"""Formulas over columns: ``2 * [Price] + sqrt([Item].[Quantity])``.

Names stand in brackets; names joined by dots are a path through links.
``[out]`` is the value accumulated so far.  A formula that is a single name
passes any type; in all others values are numbers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.errors import EngineError, ErrorCode
from weftline.functions.scalars import safe_div, to_number

_LEX = re.compile(r"\s*(?:(?P<path>\[[^\]]*\](?:\s*\.\s*\[[^\]]*\])*)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>[-+*/^%(),]))")
_NAME = re.compile(r"\[([^\]]*)\]")


def _sign(x: Column) -> Column:
    return F.signum(x)


FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "cbrt": F.cbrt, "ceil": lambda x: F.ceil(x).cast("double"), "cos": F.cos, "cosh": F.cosh, "exp": F.exp, "expm1": F.expm1,
    "floor": lambda x: F.floor(x).cast("double"), "log": F.ln, "log10": F.log10, "log1p": F.log1p, "log2": F.log2, "signum": _sign, "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh,
}
CONSTANTS = {"pi": math.pi, "e": math.e}


@dataclass(frozen=True)
class Formula:
    """A parsed formula; ``paths`` are the names it refers to, in order of first use."""

    text: str
    paths: tuple[tuple[str, ...], ...]
    tree: tuple
    identity: bool

    def column(self, resolve: Callable[[tuple[str, ...]], Column], out: Column | None = None, numbers: frozenset = frozenset()) -> Column:
        """The expression, with each path turned into a Column by ``resolve``; ``numbers`` are the paths known to hold numbers, which needn't be read as text."""
        if self.identity:
            return self._leaf(self.tree[1], resolve, out)
        return self._build(self.tree, resolve, out, numbers)

    def uses_out(self) -> bool:
        return any(len(p) == 1 and p[0].lower() == "out" for p in self.paths)

    def increment(self) -> Formula | None:
        """What the formula adds to [out], as a formula without it; None unless it does nothing else to [out]."""

        def has_out(t: tuple) -> bool:
            return t == ("path", t[1]) and len(t[1]) == 1 and t[1][0].lower() == "out" if t[0] == "path" else any(isinstance(x, tuple) and has_out(x) for x in t[1:])

        def rest(t: tuple) -> tuple | None:
            """The tree without its one [out] in a sum; ("zero",) if nothing is left, None if [out] stands elsewhere."""
            if t[0] == "path" and has_out(t):
                return ("zero",)
            if t[0] in "+-" and len(t) == 3:
                left, right = has_out(t[1]), has_out(t[2])
                if left and not right and (a := rest(t[1])) is not None:
                    return (t[0], ("number", 0.0), t[2]) if a == ("zero",) else (t[0], a, t[2])
                if right and not left and t[0] == "+" and (b := rest(t[2])) is not None:
                    return t[1] if b == ("zero",) else ("+", t[1], b)
            return None

        if self.identity or not self.uses_out():
            return None
        tree = rest(self.tree)
        paths = tuple(p for p in self.paths if not (len(p) == 1 and p[0].lower() == "out"))
        return None if tree is None or tree == ("zero",) else Formula(self.text, paths, tree, False)

    def _leaf(self, path: tuple[str, ...], resolve, out: Column | None) -> Column:
        if len(path) == 1 and path[0].lower() == "out":
            if out is None:
                raise EngineError(ErrorCode.DEFINITION, f"[out] has no meaning in {self.text!r}")
            return out
        return resolve(path)

    def _build(self, t: tuple, resolve, out, numbers) -> Column:
        kind = t[0]
        if kind == "number":
            return F.lit(t[1])
        if kind == "path":
            value = self._leaf(t[1], resolve, out)
            return F.coalesce(value.cast("double"), F.lit(float("nan"))) if t[1] in numbers else to_number(value)
        if kind == "call":
            return FUNCTIONS[t[1]](self._build(t[2], resolve, out, numbers))
        if kind == "neg":
            return -self._build(t[1], resolve, out, numbers)
        a, b = self._build(t[1], resolve, out, numbers), self._build(t[2], resolve, out, numbers)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: safe_div(a, b), "%": lambda: F.when(b == 0, F.lit(float("nan"))).otherwise(F.try_mod(a, b)), "^": lambda: F.pow(a, b)}[kind]()


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.paths = text, 0, []
        self.tokens: list[tuple[str, str]] = []
        pos = 0
        while text[pos:].strip():
            m = _LEX.match(text, pos)
            if not m:
                self.fail(f"cannot read {text[pos:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def fail(self, why: str):
        raise EngineError(ErrorCode.DEFINITION, f"formula {self.text!r}: {why}")

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, op: str) -> bool:
        if self.peek() == ("op", op):
            self.at += 1
            return True
        return False

    def sum(self) -> tuple:
        left = self.term()
        while self.peek() in (("op", "+"), ("op", "-")):
            op = self.tokens[self.at][1]
            self.at += 1
            left = (op, left, self.term())
        return left

    def term(self) -> tuple:
        left = self.unary()
        while self.peek() in (("op", "*"), ("op", "/"), ("op", "%")):
            op = self.tokens[self.at][1]
            self.at += 1
            left = (op, left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.take("-"):
            return ("neg", self.unary())
        if self.take("+"):
            return self.unary()
        return self.power()

    def power(self) -> tuple:
        base = self.atom()
        return ("^", base, self.unary()) if self.take("^") else base

    def atom(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind == "number":
            return ("number", float(value))
        if kind == "path":
            path = tuple(n.strip() for n in _NAME.findall(value))
            if not all(path):
                self.fail("an empty name")
            if path not in self.paths:
                self.paths.append(path)
            return ("path", path)
        if kind == "name":
            if value.lower() in FUNCTIONS and self.take("("):
                inner = self.sum()
                if not self.take(")"):
                    self.fail("a missing bracket")
                return ("call", value.lower(), inner)
            if value.lower() in CONSTANTS:
                return ("number", CONSTANTS[value.lower()])
            self.fail(f"unknown name {value!r}")
        if (kind, value) == ("op", "("):
            inner = self.sum()
            if not self.take(")"):
                self.fail("a missing bracket")
            return inner
        self.fail("ends too early" if kind == "end" else f"unexpected {value!r}")


def parse(text: str) -> Formula:
    """Read a formula; what can't be read raises at once."""
    p = _Parser(text)
    tree = p.sum()
    if p.peek()[0] != "end":
        p.fail(f"unexpected {p.peek()[1]!r}")
    return Formula(text, tuple(p.paths), tree, tree[0] == "path")
