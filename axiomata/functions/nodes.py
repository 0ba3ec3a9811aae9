"""Canonical texts as tables of nodes: a relational path to what ``features`` computes in Python."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axiomata.functions import features
from axiomata.functions.analysis import generalized

NODE = T.StructType(
    [T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()), T.StructField("pos", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("op", "leaf", "raw")]
)


def node_rows(text: str | None) -> Iterator[tuple]:
    """(node_id, parent_id, pos, op, leaf, raw) in preorder; nothing for a text that can't be read."""
    try:
        stack = [(features.read(text or ""), None, 0)]
    except features.CanonicalError:
        return
    count = 0
    while stack:
        node, parent, pos = stack.pop()
        yield count, parent, pos, node.head, node.leaf, node.raw
        stack.extend((kid, count, k) for k, kid in reversed(list(enumerate(node.kids))))
        count += 1


@F.udtf(returnType=NODE)
class FormulaNodes:
    """``formula_nodes(canonical)`` for lateral joins in SQL, once registered."""

    def eval(self, canonical: str):
        yield from node_rows(canonical)


def nodes(formulas: DataFrame) -> DataFrame:
    """The nodes of every formula, read once per distinct canonical text."""
    spark = formulas.sparkSession
    spark.udtf.register("formula_nodes", FormulaNodes)
    formulas.select("canonical").distinct().createOrReplaceTempView("_canonical_texts")
    once = spark.sql("SELECT canonical, n.* FROM _canonical_texts, LATERAL formula_nodes(canonical) n")
    return formulas.select("entry_id", "side", "canonical").join(once, "canonical").drop("canonical")


def edge_tokens(table: DataFrame) -> DataFrame:
    """entry_id, side, tok: the parent-child and two-step tokens, by joins of the node table with itself."""
    keys = ["entry_id", "side"]
    label = F.when(F.col("op") != "", F.col("op")).otherwise(generalized(F.col("leaf")))
    kid = table.select(*keys, F.col("parent_id").alias("up"), F.col("node_id").alias("id"), label.alias("label"), "op")
    parent = table.select(*keys, F.col("node_id").alias("up"), F.col("op").alias("above"), F.col("parent_id").alias("top"))
    pairs = kid.join(parent, [*keys, "up"])
    edges = pairs.select(*keys, F.concat(F.lit("e:"), "above", F.lit(">"), "label").alias("tok"))
    grand = table.select(*keys, F.col("node_id").alias("top"), F.col("op").alias("highest"))
    steps = pairs.join(grand, [*keys, "top"])
    return edges.unionByName(steps.select(*keys, F.concat(F.lit("p:"), "highest", F.lit(">"), "above", F.lit(">"), "label").alias("tok")))
