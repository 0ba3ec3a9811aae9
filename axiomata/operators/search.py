"""Search over formulas: exact, fuzzy, progressive facets, duplicates.

Formulas are DataFrames with the columns of ``schema.FORMULAS``; results are DataFrames in rank order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiomata.functions.analysis import jaccard
from axiomata.schema import FORMULA

K1, B = 1.2, 0.75
#: A term's weight where it is in half of the documents or more.
FLOOR = 1e-6
#: Digits of a score that rank.
DIGITS = 9
FUZZY_LIMIT, POOL = 25, 200


def checked(limit: int) -> int:
    if limit < 0:
        raise ValueError("a limit can't be negative")
    return limit


def pool_for(limit: int, pool: int) -> int:
    return limit * 5 if pool < limit else pool


def occurrence() -> Column:
    return F.struct("entry_id", "side", "source", "label")


def collapse(ranked: DataFrame) -> DataFrame:
    """One row per signature: the first by ``rank``, with all its rows as occurrences, in rank order."""
    others = [F.col(c) for c in ranked.columns if c not in ("signature", "rank")]
    groups = ranked.groupBy("signature").agg(F.min_by(F.struct(*others), "rank").alias("first"), F.min("rank").alias("rank"), F.sort_array(F.collect_list(F.struct(F.col("rank"), occurrence().alias("o")))).alias("all"))
    return groups.select("first.*", "signature", "rank", F.transform("all", lambda x: x["o"]).alias("occurrences"))


def entry_sides(formulas: DataFrame) -> DataFrame:
    """entry_id and both sides' text and LaTeX; nulls for sides that an entry lacks."""
    of = lambda side, c: F.max(F.when((F.col("side") == side) & (F.col(c) != ""), F.col(c)))
    columns = [of(s, c).alias(f"{s}_{c}") for s in ("lhs", "rhs") for c in ("mma", "side_latex") if c in formulas.columns]
    return formulas.groupBy("entry_id").agg(*columns)


def identity_mma(lhs: Column, rhs: Column) -> Column:
    """``lhs == rhs``, or the side there is."""
    return F.concat_ws(" == ", F.nullif(lhs, F.lit("")), F.nullif(rhs, F.lit("")))


def identities(formulas: DataFrame) -> DataFrame:
    """entry_id, identity_mma, identity_latex of every entry."""
    pairs = entry_sides(formulas)
    latex = F.concat_ws(" = ", "lhs_side_latex", "rhs_side_latex")
    return pairs.select("entry_id", identity_mma(F.col("lhs_mma"), F.col("rhs_mma")).alias("identity_mma"), latex.alias("identity_latex"))


def with_identities(hits: DataFrame, formulas: DataFrame) -> DataFrame:
    """Adds identity_mma and identity_latex to hits; only their entries are read.

    Spark broadcasts the hits' ids if it finds them small enough, and else joins by a shuffle.
    """
    mine = formulas.join(hits.select("entry_id").distinct(), "entry_id", "left_semi")
    return hits.join(identities(mine), "entry_id", "left")


def exact(formulas: DataFrame, signature: str) -> DataFrame:
    """Formulas of a signature, collapsed, with score 1."""
    found = formulas.where(F.col("signature") == signature).select(*FORMULA).withColumns({"score": F.lit(1.0), "rank": F.struct("entry_id", "side")})
    return collapse(found).drop("rank")


def bm25(postings: DataFrame, query: DataFrame, keys: list[str], total: Column, average: Column, length: str = "length") -> DataFrame:
    """Scores, higher is better, of the documents that hold a query term.

    ``postings`` has keys, tok, tf and the document's length; ``query`` has distinct (group..., tok).
    ``total`` and ``average`` are the corpus's size and mean length.
    """
    groups = [c for c in query.columns if c != "tok"]
    frequency = postings.groupBy("tok").agg(F.count("*").alias("df"))
    hits = postings.join(F.broadcast(query) if not groups else query, "tok").join(frequency, "tok")
    idf = F.greatest(F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col(length) / average))
    return hits.groupBy(*groups, *keys).agg(F.sum(weight).alias("bm25"))


def postings(formulas: DataFrame) -> DataFrame:
    """entry_id, side, tok, tf, length: an inverted index of formulas' tokens."""
    held = formulas.select("entry_id", "side", F.size("tokens").alias("length"), F.explode("tokens").alias("tok"))
    return held.groupBy("entry_id", "side", "tok", "length").agg(F.count("*").alias("tf")).select("entry_id", "side", "tok", "tf", "length")


def fuzzy(formulas: DataFrame, query_tokens: list[str], limit: int = FUZZY_LIMIT, pool: int = POOL, index: DataFrame | None = None) -> DataFrame:
    """The ``pool`` best by BM25 of shared tokens, ranked again by Jaccard, collapsed, then limited.

    With an ``index`` (``postings``), only its rows of the query's tokens are read, and the tokens
    of the pool; without one, formulas that share no token are dropped before theirs are exploded.
    """
    pool = pool_for(checked(limit), pool)
    wanted = sorted(set(query_tokens))
    spark = formulas.sparkSession
    asked = F.array(*[F.lit(t) for t in wanted]).cast("array<string>")
    index = postings(formulas.where(F.arrays_overlap("tokens", asked))) if index is None else index
    length = F.col("n_tokens") if "n_tokens" in formulas.columns else F.size("tokens")
    stats = formulas.agg(F.count("*").cast("double").alias("n"), F.avg(length).alias("average"))
    query = spark.createDataFrame([(t,) for t in wanted], "tok string")
    scores = bm25(index.where(F.col("tok").isin(wanted)), query, ["entry_id", "side"], stats.select("n").scalar(), stats.select("average").scalar())
    best = scores.withColumn("bm25", F.round("bm25", DIGITS)).orderBy(F.desc("bm25"), "entry_id", "side").limit(pool)
    candidates = formulas.join(F.broadcast(best), ["entry_id", "side"])  # ``pool`` rows
    # a struct sorts by its fields in order: similarity, then what ranked the pool
    scored = candidates.withColumn("score", jaccard(F.col("tokens"), asked))
    ranked = scored.withColumn("rank", F.struct((-F.col("score")).alias("s"), (-F.col("bm25")).alias("b"), "entry_id", "side"))
    return collapse(ranked.select(*FORMULA, "score", "rank")).orderBy("rank").limit(limit).drop("rank")


class Facets(NamedTuple):
    """A progressive filter: matching formulas' keys, their number, refinements, and formulas if few."""

    total: DataFrame
    refine: DataFrame
    hits: DataFrame


def facet_rows(formulas: DataFrame) -> DataFrame:
    return formulas.select("entry_id", "side", F.explode(F.array_distinct("facets")).alias("facet"))


def matching(formulas: DataFrame, rows: DataFrame, selected: list[str], strict: bool = False) -> DataFrame:
    """Keys of the formulas that carry all selected facets, by ``rows`` of facets; repeats count only if ``strict``."""
    if not selected:
        return formulas.select("entry_id", "side")
    wanted = len(selected) if strict else len(set(selected))
    rows = rows.where(F.col("facet").isin(sorted(set(selected))))
    return rows.groupBy("entry_id", "side").agg(F.countDistinct("facet").alias("n")).where(F.col("n") == wanted).select("entry_id", "side")


def facets(formulas: DataFrame, selected: list[str], limit: int = FUZZY_LIMIT, strict: bool = False, rows: DataFrame | None = None) -> Facets:
    """total (one row), refine (facet, n; most first), and hits only where 0 < total <= limit.

    ``rows`` are the formulas' facets one by one, if there is a table of them.
    """
    rows = facet_rows(formulas) if rows is None else rows
    keys = matching(formulas, rows, selected, strict)
    total = keys.agg(F.count("*").alias("total"))
    among = rows.join(keys, ["entry_id", "side"], "left_semi")
    refine = among.where(~F.col("facet").isin(selected)) if selected else among
    refine = refine.groupBy("facet").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "facet")
    listed = formulas.join(keys, ["entry_id", "side"], "left_semi").where(total.scalar() <= checked(limit))
    ranked = listed.select(*FORMULA).withColumns({"score": F.lit(1.0), "rank": F.struct("entry_id", "side")})
    return Facets(total, refine, collapse(ranked).orderBy("rank").drop("rank"))


def duplicate_signatures(formulas: DataFrame) -> DataFrame:
    """signature, n_entries of signatures under several entries."""
    return formulas.groupBy("signature").agg(F.countDistinct("entry_id").alias("n_entries")).where("n_entries > 1")


def duplicates(formulas: DataFrame, limit: int = FUZZY_LIMIT) -> DataFrame:
    """The signatures with most entries, with all their rows in order."""
    top = duplicate_signatures(formulas).orderBy(F.desc("n_entries"), "signature").limit(checked(limit))
    rows = formulas.join(F.broadcast(top), "signature")
    return rows.groupBy("signature", "n_entries").agg(F.sort_array(F.collect_list(occurrence())).alias("occurrences")).orderBy(F.desc("n_entries"), "signature")


def duplicate_report(groups: DataFrame) -> DataFrame:
    """Lines of a duplicate report: signature prefix, number of rows, the first six ids."""
    ids = F.transform("occurrences", lambda o: F.concat_ws(".", o["entry_id"], o["side"]))
    more = F.when(F.size(ids) > 6, F.format_string(" (+%d more)", F.size(ids) - 6)).otherwise(F.lit(""))
    return groups.select(F.concat(F.substring("signature", 1, 12), F.lit(" ×"), F.size("occurrences").cast("string"), F.lit(" "), F.concat_ws(", ", F.slice(ids, 1, 6)), more).alias("line"))


def hit_lines(hits: DataFrame) -> DataFrame:
    """Lines of a result list: score, entry.side, LaTeX cut at 80 characters."""
    cut = F.when(F.length("latex") > 80, F.concat(F.substring("latex", 1, 80), F.lit("…"))).otherwise(F.col("latex"))
    return hits.select(F.concat_ws("  ", F.format_string("%.3f", "score"), F.concat_ws(".", "entry_id", "side"), cut).alias("line"))


def hit_json(hits: DataFrame) -> DataFrame:
    """Hits as JSON objects."""
    names = ["entry_id", "side", "label", "class", "latex", "mma", "identity_mma", "identity_latex", "signature", "score", "occurrences"]
    return hits.select(F.to_json(F.struct(*[c for c in names if c in hits.columns])).alias("json"))


def signatures_by_side(formulas: DataFrame) -> DataFrame:
    """entry_id and a map of side to signature."""
    pairs = F.sort_array(F.collect_list(F.struct("side", "signature")))
    return formulas.groupBy("entry_id").agg(F.map_from_entries(pairs).alias("signatures"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: what remains of successive upserts."""
    last = F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in keys]), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("last")).select(*keys, "last.*")
