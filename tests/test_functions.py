"""Parsing, canonical forms, features and LaTeX: one or more cases of every rule, and properties over random formulas."""

import itertools
import random
import re
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axiomata.functions import canonical as c
from axiomata.functions import features as f
from axiomata.functions.expressions import Call, Constant, Number, ParseError, Variable, parse
from axiomata.functions.latex import identity, latex

# sums: signs of terms, of numbers and of the first term
SUMS = [
    ("p + q - r", "p + q - r"),
    ("p - (q + r)", r"p - \left(q + r\right)"),
    ("p - (q - r)", r"p - \left(q - r\right)"),
    ("-u + v", "-u + v"),
    ("Plus[w, ~7, -v]", "w - 7 - v"),
    ("Plus[~7, w]", "-7 + w"),
    ("-(u + v)", r"-\left(u + v\right)"),
]
# products: signs, denominators from powers, dots between digits
PRODUCTS = [
    ("4*u*v", "4 u v"),
    ("u*4*9", r"u 4 \cdot 9"),
    ("(u + v)*w", r"\left(u + v\right) w"),
    ("Times[~1, u]", "-u"),
    ("Times[~6, u, v]", "-6 u v"),
    ("Times[~1, ~1, u]", "u"),
    ("Times[-u, -1]", "u 1"),
    ("Times[u, Power[v, ~1]]", r"\frac{u}{v}"),
    ("Times[Power[u, ~3], Power[v, ~1]]", r"\frac{1}{u^{3} v}"),
    ("Times[~2, u, Power[v + w, ~1]]", r"-\frac{2 u}{\left(v + w\right)}"),
    ("u*v/w", r"u \frac{v}{w}"),
    ("(u*v)/w", r"\frac{u v}{w}"),
]
# powers: special exponents, and bases that need parentheses
POWERS = [
    ("u^v", "u^{v}"),
    ("(u + v)^3", r"\left(u + v\right)^{3}"),
    ("u^(v + 1)", "u^{v + 1}"),
    ("(u/v)^w", r"\left(\frac{u}{v}\right)^{w}"),
    ("Power[Rational[2, 5], k]", r"\left(\frac{2}{5}\right)^{k}"),
    ("Power[~4, k]", r"\left(-4\right)^{k}"),
    ("Power[u, Rational[1, 2]]", r"\sqrt{u}"),
    ("Power[u, Rational[-1, 2]]", r"\frac{1}{\sqrt{u}}"),
    ("Power[u + v, ~1]", r"\frac{1}{\left(u + v\right)}"),
    ("Sqrt[u v]", r"\sqrt{u v}"),
    ("Exp[u v]", "e^{u v}"),
]
# binders with and without limits, and with numbers of operands that have no form
BINDERS = [
    ("Integrate[Cos[w], w]", r"\int \cos\!\left(w\right)\,dw"),
    ("Integrate[h[w], {w, -1, 1}]", r"\int_{-1}^{1} \operatorname{h}\!\left(w\right)\,dw"),
    ("Integrate[u + w, {w, 0, 9}]", r"\int_{0}^{9} \left(u + w\right)\,dw"),
    ("Sum[j, {j, 2, m}]", r"\sum_{j=2}^{m} j"),
    ("Product[theta, {theta, 1, 4}]", r"\prod_{\theta=1}^{4} \theta"),
    ("Sum[j, j]", r"\sum_{j} j"),
]
# other operators, functions and names
OTHERS = [
    ("(u + v)!", r"\left(u + v\right)!"),
    ("Abs[u - v]", r"\left|u - v\right|"),
    ("Binomial[m, 3]", r"\binom{m}{3}"),
    ("Floor[u/2] + Ceiling[v]", r"\left\lfloor \frac{u}{2} \right\rfloor + \left\lceil v \right\rceil"),
    ("Subscript[u, j + 1]", "u_{j + 1}"),
    ("u -> v^2", r"u\to v^{2}"),
    ("u < v", "u < v"),
    ("u != v + 1", r"u\neq v + 1"),
    ("u >= v", r"u\geq v"),
    ("Log[u]", r"\ln\!\left(u\right)"),
    ("Log[3, u]", r"\log_{3}u"),
    ("Log[3, u + v]", r"\log_{3}\left(u + v\right)"),
    ("ArcTan[u]", r"\arctan\!\left(u\right)"),
    ("Csch[u]", r"\operatorname{csch}\!\left(u\right)"),
    ("Sign[u]", r"\operatorname{sgn}\!\left(u\right)"),
    ("LegendreP[2, w]", r"P_{2}\!\left(w\right)"),
    ("HermiteH[m + 1, w]", r"H_{m + 1}\!\left(w\right)"),
    ("Whatever[u, v]", r"\operatorname{Whatever}\!\left(u, v\right)"),
    ("Divide[u]", r"\operatorname{Divide}\!\left(u\right)"),
    ("EulerGamma + GoldenRatio + Catalan", r"\gamma + \varphi + G"),
    ("ComplexInfinity", r"\tilde{\infty}"),
    ("omicron + psi + Omega", r"o + \psi + \mathrm{Omega}"),
    (r"\[CapitalGamma] + \[CurlyThing]", r"\Gamma + \mathrm{CurlyThing}"),
    ("speed", r"\mathrm{speed}"),
    ('"if"', r"\text{if}"),
    ("Rational[-2, 6]", r"-\frac{1}{3}"),
]


@pytest.mark.parametrize(("text", "want"), SUMS + PRODUCTS + POWERS + BINDERS + OTHERS)
def test_latex(text, want):
    """``~7`` stands for a negative number, which in text is a sign before a number."""
    assert latex(parse(re.sub(r"~(\d+)", r"Rational[-\1,1]", text))) == want


def test_latex_of_calls_that_no_text_makes():
    u = Variable("u")
    assert latex(Call("Sum", (u, u), "j")) == r"\sum"
    assert latex(Call("Times", ())) == "1"
    assert latex(Call("Plus", ())) == ""
    assert latex(Call("Times", (Call("Minus", (Call("Minus", (u,)),)), Number(Fraction(-1))))) == "-u"


def test_identity():
    left, right = parse("Cosh[w]^2"), parse("1 + Sinh[w]^2")
    assert identity(left, right) == r"\cosh\!\left(w\right)^{2} = 1 + \sinh\!\left(w\right)^{2}"
    assert (identity(left, None), identity(None, None)) == (r"\cosh\!\left(w\right)^{2}", "")


@pytest.mark.parametrize("text", [" ", "u *", "* u", "h[u", "h[u]]", "((u)", "u v)", "%", "h[, u]", "h[u,]", "{u, v", "Integrate[u, {w, 1}", "u = v"])
def test_text_that_is_no_formula(text):
    with pytest.raises(ParseError):
        parse(text)


def test_what_parsing_gives():
    assert parse("3.25") == Number(Fraction(13, 4))
    assert parse("Khinchin") == Constant("Khinchin")
    assert parse("u - v") == Call("Subtract", (Variable("u"), Variable("v")))
    assert parse("u < v < w").kids == (Variable("u"), Variable("v"), Variable("w"))
    assert parse("u^v^w") == parse("u^(v^w)")
    assert parse("2 u v") == parse("2*u*v")
    assert parse("Sum[j, {j, 1, 9}]").bind == "j"


# each row: texts of one form
SAME = [
    ("u + v w", "w v + u", "p*q + r"),
    ("Sum[j^2, {j, 1, m}]", "Sum[i^2, {i, 1, k}]"),
    ("Integrate[Integrate[x y, {x, 0, 1}], {y, 0, 2}]", "Integrate[Integrate[p q, {p, 0, 1}], {q, 0, 2}]"),
    ("Exp[2 u]", "E^(2*v)", "Power[E, Times[w, 2]]"),
    ("Sqrt[u]", "u^(1/2)", "Power[v, Rational[1, 2]]"),
    ("u - v - w", "w - v - u", "-u + (w - v)"),
    ("(u^2)^3", "v^6"),
    ("2*3*u + 4 - 1", "3 + u*6"),
    ("-(-u)", "v"),
    ("0*u + v", "w"),
    ("h[k[u], v]", "h[k[p], q]"),
    ("1.5*u", "3/2 u"),
    ("u (* remark *) v", "p*q"),
]


@pytest.mark.parametrize("texts", SAME)
def test_same_form(texts):
    assert len({c.canonical(parse(t)) for t in texts}) == 1
    assert len({c.signature(parse(t)) for t in texts}) == 1


def test_forms_differ_between_rows():
    forms = [c.canonical(parse(row[0])) for row in SAME]
    assert len(set(forms)) == len(forms) - 1  # u and v of two rows are both one variable
    for a, b in (("h[u, v]", "h[u, u]"), ("u^v", "v^2"), ("u - v", "u + v"), ("Cos[u]", "Cosh[u]"), ("Sum[j, {j, 1, 2}]", "Sum[j, {j, 1, 3}]"), ("p q + q r + r s", "p q + r s + s p + q r")):
        assert c.canonical(parse(a)) != c.canonical(parse(b))


def test_canonical_text_is_spelled_by_rules():
    assert c.canonical(parse("Integrate[w^2 + u, {w, 0, Pi}]")) == "Integrate[#0,$Pi,Plus[Power[@0,#2],v0]]"
    assert c.canonical(parse("Sum[Product[i j, {i, 1, j}], {j, 1, 3}]")) == "Sum[#1,#3,Product[#1,@0,Times[@0,@1]]]"
    assert c.canonical(parse('h["p,q", 2/4]')) == 'h[$"p,q",#1/2]'
    assert c.engine_probe() == c.signature(parse(c.PROBE)) and len(c.engine_probe()) == 64


def test_symmetric_forms():
    """Variables that nothing tells apart: any order of names gives the one form."""
    cycle = [f"{a}*{b}" for a, b in zip("pqrstu", "qrstup", strict=True)]
    forms = set()
    for order in itertools.islice(itertools.permutations("pqrstu"), 0, 720, 37):
        named = dict(zip("pqrstu", order, strict=True))
        forms.add(c.canonical(parse(" + ".join("".join(named.get(x, x) for x in t) for t in cycle))))
    assert len(forms) == 1


names = st.sampled_from("abcdxyz")


def trees():
    leaf = st.one_of(names, st.integers(0, 5).map(str))
    return st.recursive(leaf, lambda t: st.tuples(st.sampled_from(["+", "*", "f", "^"]), t, t), max_leaves=7)


def written(tree, rename, rng):
    if isinstance(tree, str):
        return rename.get(tree, tree)
    op, *kids = tree
    parts = [written(k, rename, rng) for k in kids]
    if op in "+*" and rng.random() < 0.5:
        parts.reverse()
    return f"f[{parts[0]}, {parts[1]}]" if op == "f" else f"(({parts[0]}) {op} ({parts[1]}))"


@settings(max_examples=150, deadline=None)
@given(trees(), st.randoms(use_true_random=False))
def test_order_and_names_do_not_matter(tree, rng):
    old = list("abcdxyz")
    new = old[:]
    random.Random(rng.random()).shuffle(new)
    plain = written(tree, {}, random.Random(1))
    other = written(tree, dict(zip(old, new, strict=True)), rng)
    assert c.canonical(parse(plain)) == c.canonical(parse(other))


@settings(max_examples=100, deadline=None)
@given(trees())
def test_canonical_text_is_read_back(tree):
    text = c.canonical(parse(written(tree, {}, random.Random(1))))
    node = f.read(text)
    assert node.raw == text
    assert len(f.tokens_from(text)) >= 1


def test_reading_canonical_text():
    node = f.read("Times[Power[v0,#-1],Sin[v1]]")
    assert (node.head, [k.head for k in node.kids], node.kids[1].kids[0].leaf) == ("Times", ["Power", "Sin"], "v1")
    quoted = f.read('g[$"[x], ]",@2]')
    assert [k.leaf for k in quoted.kids] == ['$"[x], ]"', "@2"]
    assert f.read("Nothing[]").kids == ()
    for text in ("g[v0", "g[v0,,v1]", "g[v0] v1", "[v0]", "g]", "", 'g[$"open]'):
        with pytest.raises(f.CanonicalError):
            f.read(text)
        assert f.tokens_from(text) == [] == f.facets_from(text)


# text -> its facets, in order
FACETS = {
    "Sum[#1,$Infinity,Power[@0,#-2]]": "fraction infinite-limit sum",
    "Product[v0]": "product",
    "Integrate[#0,#1,LegendreP[#2,@0]]": "definite-integral integral orthogonal-polynomial",
    "Integrate[Cosh[@0]]": "hyperbolic indefinite-integral integral",
    "Power[v0,#1/3]": "nth-root",
    "Power[Plus[v0,v1],#-1/2]": "fraction square-root",
    "Times[$Pi,Log[v0]]": "has-pi logarithm",
    "Power[$E,Times[$I,v0]]": "has-e has-i",
    "Gamma[Zeta[v0]]": "gamma-function zeta",
    "MyOwn[v0,#7]": "",
}


@pytest.mark.parametrize(("text", "want"), FACETS.items())
def test_facets(text, want):
    found = f.facets_from(text)
    assert found == sorted(set(found))
    assert set(want.split()) - {"has-i", "orthogonal-polynomial"} <= set(found)


def test_every_head_has_one_facet():
    for head, facet in f.HEAD_FACET.items():
        assert facet in f.facets_from(f"{head}[v0,v1]")
    assert (len(f.HEAD_FACET), len(set(f.HEAD_FACET.values()))) == (85, 25)


def test_tokens_by_hand():
    import hashlib

    mark = lambda s: "s:" + hashlib.sha256(s.encode()).hexdigest()[:16]
    want = ["op:Cos", "e:Cos>Times", "p:Cos>Times>#num", "p:Cos>Times>$Pi", mark("Cos[Times[#2,$Pi]]"), "op:Times", "e:Times>#num", "e:Times>$Pi", mark("Times[#2,$Pi]"), "l:#num", "l:$Pi"]
    assert sorted(f.tokens_from("Cos[Times[#2,$Pi]]")) == sorted(want)


def test_similarity():
    assert f.jaccard(["p", "q", "r"], ["r", "s"]) == 1 / 4
    assert f.jaccard(["p", "p"], ["p"]) == 1
    assert f.jaccard([], ["p"]) == 0
    assert f.jaccard([], []) == 1


def test_numbers_and_classes_of_leaves():
    rationals = {"#12": (12, 1), "#-7/3": (-7, 3), "#4/6": (4, 6), "#x": None, "12": None, "#5/0": None, "#1/2/3": None}
    assert {x: f.rational(x) for x in rationals} == rationals
    classes = {"#-7/3": "#num", "v12": "var", "@4": "slot", '$"v0"': "$str", "$Degree": "$Degree", "other": "other", "": "?"}
    assert {x: f.generalize(x) for x in classes} == classes
