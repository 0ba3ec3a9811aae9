"""Structural features of canonical texts: search tokens and facet tags."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

# Facet tag -> operator heads that carry it.
OPERATOR_FACETS = {
    "sum": "Sum",
    "product": "Product",
    "exponential": "Exp",
    "logarithm": "Log",
    "trigonometric": "Sin Cos Tan Cot Sec Csc",
    "inverse-trigonometric": "ArcSin ArcCos ArcTan ArcCot",
    "hyperbolic": "Sinh Cosh Tanh Coth Sech Csch",
    "inverse-hyperbolic": "ArcSinh ArcCosh ArcTanh",
    "absolute-value": "Abs",
    "sign": "Sign",
    "factorial": "Factorial",
    "binomial": "Binomial",
    "integer-part": "Floor Ceiling Round",
    "gamma-function": "Gamma LogGamma PolyGamma Beta Pochhammer",
    "error-function": "Erf Erfc Erfi",
    "bessel": "BesselJ BesselY BesselI BesselK HankelH1 HankelH2",
    "airy": "AiryAi AiryBi",
    "struve": "StruveH StruveL",
    "elliptic": "EllipticF EllipticE EllipticK EllipticPi EllipticTheta EllipticNomeQ InverseEllipticNomeQ JacobiSD JacobiCN JacobiSN JacobiDN WeierstrassP",
    "hypergeometric": "Hypergeometric2F1 HypergeometricPFQ Hypergeometric1F1 HypergeometricU",
    "meijer-g": "MeijerG",
    "polylogarithm": "PolyLog LerchPhi",
    "zeta": "Zeta HurwitzZeta DirichletEta",
    "orthogonal-polynomial": "LegendreP LegendreQ HermiteH LaguerreL ChebyshevT ChebyshevU JacobiP GegenbauerC",
    "integral-function": "SinIntegral CosIntegral ExpIntegralEi ExpIntegralE LogIntegral FresnelC FresnelS",
}
# Facet tags of constants.
LEAF_FACETS = {"$Pi": "has-pi", "$E": "has-e", "$I": "imaginary-unit", "$EulerGamma": "euler-gamma", "$Infinity": "infinite-limit"}
HEAD_FACET = {head: tag for tag, heads in OPERATOR_FACETS.items() for head in heads.split()}
INT64 = range(-(2**63), 2**63)

_ITEM = re.compile(r' *(?:(?P<name>[A-Za-z][A-Za-z0-9]*)(?P<open>\[)?|(?P<leaf>\$"[^"]*"?|[^,\[\] ]+))')
_AFTER = re.compile(r" *([,\]]|$)")
_NO_KIDS = re.compile(r" *\]")


class Node(NamedTuple):
    """A term: an operator (head, kids) or a leaf; ``raw`` is the text it was read from."""

    head: str
    kids: tuple
    leaf: str
    raw: str


class CanonicalError(ValueError):
    """Text that isn't canonical."""


def read(text: str) -> Node:
    """The term of a canonical text. Open operators are kept on a stack, so depth is unlimited."""
    stack: list[tuple[str, int, list[Node]]] = []
    at = 0

    def fail(where: int, why: str) -> CanonicalError:
        return CanonicalError(f"canonical parse error at {where}: {why}")

    while True:
        m = _ITEM.match(text, at)
        if not m:
            raise fail(at, "expected a term")
        at = m.end()
        if m["open"]:
            stack.append((m["name"], m.start("name"), []))
            empty = _NO_KIDS.match(text, at)
            if not empty:
                continue
            at = empty.end()
            head, start, _ = stack.pop()
            done = Node(head, (), "", text[start:at])
        else:
            leaf = m["name"] or m["leaf"]
            done = Node("", (), leaf, leaf)
        while True:
            m = _AFTER.match(text, at)
            if not stack:
                if not m or m[1]:
                    raise fail(at, "trailing input")
                return done
            stack[-1][2].append(done)
            if not m or not m[1]:
                raise fail(at, "expected ']'")
            at = m.end()
            if m[1] == ",":
                break
            head, start, kids = stack.pop()
            done = Node(head, tuple(kids), "", text[start:at])


def generalize(leaf: str) -> str:
    """Numbers, variables, slots and strings lose their value; constants and bare names keep it."""
    if leaf.startswith('$"'):
        return "$str"
    return {"": "?", "#": "#num", "v": "var", "@": "slot"}.get(leaf[:1], leaf)


def label(node: Node) -> str:
    return node.head or generalize(node.leaf)


def _nodes(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node.kids))


def fingerprint(raw: str) -> str:
    return hashlib.sha256(raw.encode()).hexdigest()[:16]


def tokens(root: Node) -> list[str]:
    """Operators, parent-child edges, two-step paths, subterm fingerprints and leaves, with repeats."""
    found: list[str] = []
    for node in _nodes(root):
        if not node.head:
            found.append(f"l:{generalize(node.leaf)}")
            continue
        found.append(f"op:{node.head}")
        for kid in node.kids:
            found.append(f"e:{node.head}>{label(kid)}")
            found.extend(f"p:{node.head}>{kid.head}>{label(grandkid)}" for grandkid in kid.kids)
        found.append(f"s:{fingerprint(node.raw)}")
    return found


def rational(leaf: str) -> tuple[int, int] | None:
    """Numerator and denominator of a leaf like ``#-1/2``, in 64 bits."""
    m = re.fullmatch(r"#([+-]?[0-9]+)(?:/([+-]?[0-9]+))?", leaf)
    if not m:
        return None
    pair = int(m[1]), int(m[2] or 1)
    return pair if pair[1] and all(x in INT64 for x in pair) else None


def _power_facets(exponent: Node) -> set[str]:
    pair = rational(exponent.leaf) if not exponent.head else None
    if pair is None:
        return set()
    found = {"fraction"} if pair[0] < 0 else set()
    if pair[1] == 2 and abs(pair[0]) == 1:
        found.add("square-root")
    elif pair[1] > 1:
        found.add("nth-root")
    return found


def facets(root: Node) -> list[str]:
    """The sorted facet tags of a term."""
    found: set[str | None] = set()
    for node in _nodes(root):
        found.add(HEAD_FACET.get(node.head) if node.head else LEAF_FACETS.get(node.leaf))
        if node.head == "Integrate":
            found |= {"integral", "definite-integral" if len(node.kids) >= 3 else "indefinite-integral"}
        elif node.head == "Power" and len(node.kids) == 2:
            found |= _power_facets(node.kids[1])
        elif node.head == "Construct" and node.kids:
            first = node.kids[0]
            inner = first.kids[0].head if first.head == "Construct" and first.kids else ""
            if "Derivative" in (first.head, inner):
                found.add("derivative")
    return sorted(found - {None})


def tokens_from(text: str) -> list[str]:
    """Tokens of a canonical text; none if it can't be read."""
    try:
        return tokens(read(text))
    except CanonicalError:
        return []


def facets_from(text: str) -> list[str]:
    """Facets of a canonical text; none if it can't be read."""
    try:
        return facets(read(text))
    except CanonicalError:
        return []


def jaccard(a: list[str], b: list[str]) -> float:
    """Similarity of two token lists as sets; 1 for two empty ones."""
    either = set(a) | set(b)
    return len(set(a) & set(b)) / len(either) if either else 1.0
