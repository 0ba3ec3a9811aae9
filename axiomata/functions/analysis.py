"""Formula functions as vectorised UDFs; each text is parsed once for all that derives from it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axiomata.functions import canonical, features
from axiomata.functions.expressions import ParseError, parse
from axiomata.functions.latex import latex

_STRING, _STRINGS = T.StringType(), T.ArrayType(T.StringType())
#: What is derived from a formula's text, once.
ANALYSIS = T.StructType([T.StructField(n, k) for n, k in zip(("canonical", "signature", "tokens", "facets", "side_latex", "error"), (_STRING, _STRING, _STRINGS, _STRINGS, _STRING, _STRING), strict=True)])
#: Texts whose analysis a worker remembers, since corpora repeat them.
REMEMBERED = 1 << 14
FEATURES = T.StructType([T.StructField("tokens", _STRINGS), T.StructField("facets", _STRINGS)])


@lru_cache(REMEMBERED)
def analyse_text(text: str) -> tuple:
    """(canonical, signature, tokens, facets, side_latex, error) of Mathematica text."""
    try:
        expression = parse(text)
        form = canonical.canonical(expression)
        return form, canonical.signature_of(form), features.tokens_from(form), features.facets_from(form), latex(expression), None
    except (ParseError, RecursionError, OverflowError) as e:
        return None, None, None, None, None, str(e) or type(e).__name__


@F.pandas_udf(ANALYSIS)
def analyse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([analyse_text(t or "") for t in batch], columns=ANALYSIS.names)


@F.pandas_udf(FEATURES)
def features_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Tokens and facets of canonical texts."""
    for batch in texts:
        yield pd.DataFrame({"tokens": [features.tokens_from(t or "") for t in batch], "facets": [features.facets_from(t or "") for t in batch]})


@F.pandas_udf(_STRING)
def read_error(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Why a text isn't canonical, or null."""

    def why(text: str) -> str | None:
        try:
            features.read(text or "")
        except features.CanonicalError as e:
            return str(e)
        return None

    for batch in texts:
        yield batch.map(why)


def with_features(formulas: DataFrame, form: str = "canonical") -> DataFrame:
    """Adds tokens and facets, read once per distinct canonical text."""
    once = formulas.select(form).distinct().withColumn("_f", features_of(F.col(form)))
    return formulas.join(once, form).select(*formulas.columns, "_f.tokens", "_f.facets")


def generalized(leaf: Column) -> Column:
    """A leaf without its value, as an expression."""
    first = F.substring(leaf, 1, 1)
    return (
        F.when(leaf.startswith('$"'), F.lit("$str")).when(leaf == "", F.lit("?")).when(first == "#", F.lit("#num")).when(first == "v", F.lit("var")).when(first == "@", F.lit("slot")).otherwise(leaf)
    )


def rational_of(leaf: Column) -> Column:
    """struct(num, den) of a leaf like ``#-1/2``, or null."""
    pattern = r"^#([+-]?[0-9]+)(?:/([+-]?[0-9]+))?$"
    num = F.regexp_extract(leaf, pattern, 1).try_cast("long")
    below = F.regexp_extract(leaf, pattern, 2)
    den = F.when(below == "", F.lit(1).cast("long")).otherwise(below.try_cast("long"))
    return F.when(num.isNotNull() & den.isNotNull() & (den != 0), F.struct(num.alias("num"), den.alias("den")))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays as sets; 1 for two empty ones."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))
