"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; policies are versioned bit masks applied to the ledger afterwards, and ablations
are counts over its bits, so that changing a policy never reads a text again. All of it is
DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm.tables import WHITE, table


class Rule(NamedTuple):
    """A rule fails a document where ``fails`` holds; its bit is its place in RULES."""

    name: str
    fails: str


#: Places are permanent: new rules are appended, since stored ledgers carry the bits.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("shouting", "100 * n_bangs > 20 * n_words"),
)

BASE = 0b11
#: Version -> mask of the bits that reject a document.
POLICIES = {"base": BASE, "v1": BASE | 0b1111100}

_GAP = "[ \\t\\n\\x0B\\f\\r]+"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs of anything but space and \\x09-\\x0D."""
    return _bind(F.btrim(text, F.lit(WHITE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _GAP, -1)))


def _covered(windows: Column) -> Column:
    """Words in windows that occur at least twice: starts of such windows, each adding up to three words."""

    def starts(order: Column) -> Column:
        near = lambda x, k: F.coalesce(x["w"] == F.get(order, k)["w"], F.lit(False))
        again = F.filter(order, lambda x, k: near(x, k - 1) | near(x, k + 1))
        return F.sort_array(F.transform(again, lambda x: x["at"]))

    def total(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    return _bind(_bind(ordered, starts), total)


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more."""
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    counted = _bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements. A null text counts as an empty one."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"))

    full = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return docs.withColumns(
        {
            "_words": _bind(words_of(whole), of),
            "_lines": _bind(full, lines),
            "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]+", ""))).cast("long"),
            "n_bangs": F.regexp_count(whole, F.lit("!!")).cast("long"),
        }
    ).select(*[F.col(c) for c in docs.columns], "_words.*", "_lines.*", "n_symbols", "n_bangs")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: key, measurements and ``fail_bits``.

    Only the key and the text of ``docs`` are read, so further columns, whatever their names, do
    no harm. Repeated rows give repeated rows; a null key stays null; an empty table gives an
    empty ledger. Texts of any length are measured whole.
    """
    found = measured(docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")), "text_").drop("text_")
    return found.withColumn("fail_bits", fail_bits(rules)).withColumnRenamed("key_", key)


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for place, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << place)).otherwise(F.lit(0)).cast("long"))
    return bits


def passing(docs: DataFrame, policy: str | int = "v1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns."""
    found = measured(docs.select(F.struct("*").alias("row_"), F.col(text).alias("text_")), "text_").withColumn("fail_bits", fail_bits())
    return verdicts(found, policy).where("kept").select("row_.*")


def verdicts(book: DataFrame, policy: str | int = "v1") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under one policy."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    hit = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) != 0
    return book.withColumns({"base_failed": hit(BASE), "kept": ~hit(mask | BASE)})


def ablations(book: DataFrame, policy: str | int = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and kept without it.

    The ledger shrinks to one row per bit pattern first, so the rest doesn't grow with the corpus.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    used = [(k, r.name) for k, r in enumerate(rules) if mask >> k & 1]
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in used]))
    rows = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    n_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("long")
    return rows.groupBy("place", "rule").agg(
        n_if(has).alias("n_failed"), n_if(F.col("bits") == F.col("bit")).alias("n_sole"), n_if(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = verdicts(ledger(table(spark, sf_dir, "documents", "doc_id", "text")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule of the policy does on ``documents``, from the ledger's bits alone."""
    return ablations(ledger(table(spark, sf_dir, "documents", "doc_id", "text")))


#: The same in DuckDB.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), rc AS (SELECT doc_id, count(DISTINCT p) AS n FROM r GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
         ((length(t) - length(replace(t, '!!', ''))) // 2)::BIGINT AS n_bangs,
         coalesce(rc.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rc ON w.doc_id = rc.doc_id
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_bangs > 20 * n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits FROM b
"""

ABLATIONS_ORACLE = (
    "WITH book AS ("
    + ORACLE
    + """), rules(place, rule) AS (VALUES (0, 'few_words'), (1, 'repeated_windows'), (2, 'symbols'), (3, 'short_words'), (4, 'long_words'), (5, 'duplicate_lines'), (6, 'shouting'))
SELECT place, rule, count(*) FILTER (fail_bits & (1 << place) <> 0) AS n_failed, count(*) FILTER (fail_bits = (1 << place)) AS n_sole, count(*) FILTER (fail_bits & ~(1 << place)::BIGINT = 0) AS n_kept_without
FROM book, rules GROUP BY place, rule"""
)
