"""Expressions and the reader of their Mathematica-style notation.

The reader is a table-driven operator-precedence parser over regular-expression tokens. What it
returns is as written: differences, quotients, roots and exponentials stay what they are, so that
they can be displayed; ``canonical`` reduces them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from fractions import Fraction


@dataclass(frozen=True)
class Number:
    value: Fraction


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Constant:
    """A named constant, or a string literal with its quotes."""

    name: str


@dataclass(frozen=True)
class Call:
    """An operator with operands. A binder has ``bind`` and the operands [low, high, body] or [body]."""

    head: str
    kids: tuple
    bind: str | None = None


Expression = Number | Variable | Constant | Call

# The named constants.
CONSTANTS = frozenset("Pi E I Infinity ComplexInfinity EulerGamma Degree GoldenRatio Catalan Glaisher Khinchin".split())
ESCAPED_CONSTANTS = {r"\[Pi]": "Pi", r"\[Infinity]": "Infinity", r"\[ExponentialE]": "E", r"\[ImaginaryI]": "I", r"\[Degree]": "Degree", r"\[EulerGamma]": "EulerGamma"}
BINDERS = frozenset({"Integrate", "Sum", "Product"})

#: Binding powers, loosest first. Chains of one relation are one call; ``->`` and ``^`` group to the right.
RELATIONS = {"==": "Equal", "!=": "Unequal", "<": "Less", "<=": "LessEqual", ">": "Greater", ">=": "GreaterEqual"}
RULE, RELATION, SUM, PRODUCT, QUOTIENT, SIGN, POWER, POSTFIX = range(10, 90, 10)
INFIX = {"->": RULE, **dict.fromkeys(RELATIONS, RELATION), "+": SUM, "-": SUM, "*": PRODUCT, "/": QUOTIENT, "^": POWER, "!": POSTFIX, "[": POSTFIX + 10}
DEEPEST = 200

TOKEN = re.compile(
    r"""\s+ | \(\*.*?\*\) | (?P<number>\d+(?:\.\d*)?|\.\d+) | (?P<text>"[^"]*") | (?P<name>(?:[^\W\d_]|\$|\\\[\w+\])(?:[^\W_]|\$|\\\[\w+\])*)
      | (?P<sign>->|==|!=|<=|>=|[-+*/^!<>()\[\]{},])""",
    re.X | re.S,
)


class ParseError(ValueError):
    """Text that isn't an expression."""


def tokens(text: str) -> list[tuple[str, str, int]]:
    found, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected character at {at}")
        if m.lastgroup:
            found.append((m.lastgroup, m.group(), at))
        at = m.end()
    return [*found, ("end", "", len(text))]


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth = tokens(text), 0, 0

    @property
    def next(self) -> str:
        kind, text, _ = self.tokens[self.at]
        return text if kind == "sign" else f"<{kind}>"

    def take(self, wanted: str | None = None) -> str:
        _, text, at = self.tokens[self.at]
        if wanted and self.next != wanted:
            raise ParseError(f"expected {wanted} at {at}")
        self.at += 1
        return text

    def expression(self, power: int = 0) -> Expression:
        self.depth += 1
        if self.depth > DEEPEST:
            raise ParseError("nested too deeply")
        left = self.operand()
        while True:
            sign = self.next
            juxtaposed = sign in ("<number>", "<name>", "<text>", "(", "{")
            strength = PRODUCT if juxtaposed else INFIX.get(sign, 0)
            if strength <= power:
                self.depth -= 1
                return left
            if not juxtaposed:
                self.take()
            left = self.joined(left, "*" if juxtaposed else sign, strength)

    def joined(self, left: Expression, sign: str, strength: int) -> Expression:
        if sign == "!":
            return Call("Factorial", (left,))
        if sign == "[":
            kids = self.operands("]")
            if isinstance(left, Variable | Constant) and not left.name.startswith('"'):
                return called(left.name, kids)
            return Call("Construct", (left, *kids))
        right = self.expression(strength - 1 if sign in ("->", "^") else strength)
        if sign in RELATIONS:
            head = RELATIONS[sign]
            return Call(head, (*left.kids, right)) if isinstance(left, Call) and left.head == head else Call(head, (left, right))
        head = {"->": "Rule", "+": "Plus", "-": "Subtract", "*": "Times", "/": "Divide", "^": "Power"}[sign]
        if head in ("Plus", "Times") and isinstance(left, Call) and left.head == head:
            return replace(left, kids=(*left.kids, right))
        return Call(head, (left, right))

    def operands(self, close: str) -> tuple:
        kids = []
        if self.next != close:
            kids.append(self.expression())
            while self.next == ",":
                self.take()
                kids.append(self.expression())
        self.take(close)
        return tuple(kids)

    def operand(self) -> Expression:
        kind, text, at = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Number(Fraction(text if text[-1] != "." else text[:-1]))
        if kind == "text":
            return Constant(text)
        if kind == "name":
            name = ESCAPED_CONSTANTS.get(text, text)
            return Constant(name) if name in CONSTANTS else Variable(text)
        if text == "(":
            inner = self.expression()
            self.take(")")
            # a parenthesised sum or product stays apart from what follows it
            return inner
        if text == "{":
            return Call("List", self.operands("}"))
        if text == "-":
            return Call("Minus", (self.expression(SIGN),))
        if text == "+":
            return self.expression(SIGN)
        raise ParseError(f"expected an operand at {at}")


def called(head: str, kids: tuple) -> Expression:
    """A call; Rational of integers is a number, and iterators make binders, the last one innermost."""
    if head == "Rational" and len(kids) == 2:
        parts = [_integer(k) for k in kids]
        if None not in parts and parts[1]:
            return Number(Fraction(parts[0], parts[1]))
    if head in BINDERS and len(kids) >= 2:
        body = kids[0]
        for k in reversed(kids[1:]):
            iterator = _iterator(k)
            if iterator is None:
                return Call(head, kids)
            name, bounds = iterator
            body = Call(head, (*bounds, body), name)
        return body
    return Call(head, kids)


def _integer(e: Expression) -> int | None:
    if isinstance(e, Call) and e.head == "Minus":
        inner = _integer(e.kids[0])
        return None if inner is None else -inner
    return int(e.value) if isinstance(e, Number) and e.value.denominator == 1 else None


def _iterator(e: Expression) -> tuple[str, tuple] | None:
    if isinstance(e, Variable):
        return e.name, ()
    if isinstance(e, Call) and e.head == "List" and 1 <= len(e.kids) <= 3 and isinstance(e.kids[0], Variable):
        bounds = e.kids[1:]
        return e.kids[0].name, (Number(Fraction(1)), *bounds) if len(bounds) == 1 else bounds
    return None


def parse(text: str) -> Expression:
    """The expression that ``text`` denotes; ParseError if it is none."""
    reader = _Reader(text)
    found = reader.expression()
    reader.take("<end>")
    return found
