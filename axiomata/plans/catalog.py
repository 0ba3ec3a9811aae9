"""The registered queries of the formula engine and their oracles in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.functions import canonical as forms
from axiomata.functions import features
from axiomata.functions import strings
from axiomata.functions.analysis import generalized, rational_of, read_error
from axiomata.functions.nodes import edge_tokens, nodes
from axiomata.operators import api, limiter, search
from axiomata.operators.scratch import fresh_dir, kept
from axiomata.operators.store import Store
from axiomata.plans.derived import FACETS_SQL, FORMS_SQL, PART_SQL, STORED_SQL, TOKENS_SQL, part_entries, part_formulas, part_indexed, part_store, source_entries, table, write_corpus
from axiomata.sources import corpus

QUERIES: dict = {}
ORACLES: dict = {}

#: What the searches look for.
WANTED = "Plus[Power[v0,#-1/2],BesselJ[v1]]"
SELECTED = ["bessel", "fraction"]
NARROW = ["bessel", "fraction", "square-root"]
#: Tokens a second and burst of the limiter query.
RATE, BURST = 1 / 7200, 3
#: What the searches over the derived store look for, in its notation and in canonical text.
ASKED, ASKED_FORM = "Binomial[i, 5]", "Binomial[v0,#5]"


#: Distinct words of the benchmark that are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 1_000_000


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"WITH {PART_SQL} SELECT signature, count(DISTINCT entry_id) AS n_entries FROM formulas GROUP BY signature HAVING count(DISTINCT entry_id) > 1")
def dup_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.duplicate_signatures(part_formulas(spark, sf_dir))


@query(f"WITH {PART_SQL} SELECT count(*) AS total FROM (SELECT signature FROM formulas GROUP BY signature HAVING count(DISTINCT entry_id) > 1)")
def dup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.duplicate_signatures(part_formulas(spark, sf_dir)).agg(F.count("*").alias("total"))


_TOP = f"""WITH {PART_SQL}, top AS (
  SELECT signature, count(DISTINCT entry_id) AS n_entries FROM formulas GROUP BY signature HAVING count(DISTINCT entry_id) > 1 ORDER BY n_entries DESC, signature LIMIT 25)"""


@query(f"{_TOP} SELECT signature, n_entries, string_agg(entry_id || '.' || side, ',' ORDER BY entry_id, side) AS ids FROM top JOIN formulas USING (signature) GROUP BY signature, n_entries")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = search.duplicates(part_formulas(spark, sf_dir), 25)
    return groups.select("signature", "n_entries", F.array_join(F.transform("occurrences", lambda o: F.concat_ws(".", o["entry_id"], o["side"])), ",").alias("ids"))


@query(
    f"""{_TOP}, l AS (SELECT signature, list(entry_id || '.' || side ORDER BY entry_id, side) AS ids FROM top JOIN formulas USING (signature) GROUP BY signature)
    SELECT signature[:12] || ' ×' || len(ids) || ' ' || array_to_string(ids[:6], ', ') || CASE WHEN len(ids) > 6 THEN ' (+' || (len(ids) - 6) || ' more)' ELSE '' END AS line FROM l"""
)
def dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.duplicate_report(search.duplicates(part_formulas(spark, sf_dir), 25))


@query("SELECT sha256(text) AS signature, count(*) AS n_docs FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("signature"), "doc_id")
    groups = rows.groupBy("signature").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return groups.where("a <> b").select("signature", "n_docs")


@query(
    f"""WITH {PART_SQL} SELECT signature, min(entry_id) AS entry_id, 1.0::DOUBLE AS score, count(*) AS n_occurrences, string_agg(entry_id, ',' ORDER BY entry_id, side) AS ids
    FROM formulas WHERE signature = sha256('{WANTED}') GROUP BY signature"""
)
def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.exact(part_formulas(spark, sf_dir), forms.signature_of(WANTED))
    return hits.select("signature", "entry_id", "score", F.size("occurrences").cast("long").alias("n_occurrences"), F.array_join("occurrences.entry_id", ",").alias("ids"))


def _in(facets: list[str]) -> str:
    return ", ".join(f"'{f}'" for f in facets)


def _matching(facets: list[str]) -> str:
    return f"m AS (SELECT entry_id, side FROM facets WHERE facet IN ({_in(facets)}) GROUP BY entry_id, side HAVING count(DISTINCT facet) = {len(facets)})"


@query(f"WITH {FACETS_SQL}, {_matching(SELECTED)} SELECT count(*) AS total FROM m")
def facet_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(part_indexed(spark, sf_dir), SELECTED).total


@query(f"WITH {FACETS_SQL}, {_matching(SELECTED)} SELECT facet, count(*) AS n FROM facets SEMI JOIN m USING (entry_id, side) WHERE facet NOT IN ({_in(SELECTED)}) GROUP BY facet")
def facet_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(part_indexed(spark, sf_dir), SELECTED).refine


@query(f"WITH {FACETS_SQL} SELECT facet, count(*) AS n FROM facets GROUP BY facet")
def facet_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(part_indexed(spark, sf_dir), []).refine


@query(
    f"""WITH {FACETS_SQL}, {_matching(NARROW)}, c AS (SELECT count(*) AS total FROM m)
    SELECT signature, min(entry_id) AS entry_id, count(*) AS n_occurrences FROM formulas SEMI JOIN m USING (entry_id, side), c WHERE total <= 100000 GROUP BY signature"""
)
def facet_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.facets(part_indexed(spark, sf_dir), NARROW, 100_000).hits
    return hits.select("signature", "entry_id", F.size("occurrences").cast("long").alias("n_occurrences"))


_QUERY_TOKENS = ", ".join(f"'{t}'" for t in sorted(set(features.tokens_from(WANTED))))


@query(
    f"""WITH {TOKENS_SQL}, p AS (SELECT entry_id, side, len(tokens) AS length, unnest(tokens) AS tok FROM tokenized),
    t AS (SELECT entry_id, side, length, tok, count(*) AS tf FROM p WHERE tok IN ({_QUERY_TOKENS}) GROUP BY ALL),
    d AS (SELECT tok, count(*) AS df FROM t GROUP BY tok), s AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS average FROM tokenized),
    b AS (SELECT entry_id, side, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 9) AS bm25
      FROM t JOIN d USING (tok), s GROUP BY entry_id, side ORDER BY bm25 DESC, entry_id, side LIMIT 200),
    j AS (SELECT tokenized.*, bm25, len(list_intersect(list_distinct(tokens), [{_QUERY_TOKENS}]))::DOUBLE / len(list_distinct(list_concat(tokens, [{_QUERY_TOKENS}]))) AS score
      FROM b JOIN tokenized USING (entry_id, side)),
    r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY score DESC, bm25 DESC, entry_id, side) AS k, count(*) OVER (PARTITION BY signature) AS n_occurrences FROM j)
    SELECT signature, entry_id, round(score, 9) AS score, n_occurrences FROM r WHERE k = 1 ORDER BY r.score DESC, bm25 DESC, entry_id LIMIT 25"""
)
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.fuzzy(kept(part_indexed(spark, sf_dir)), features.tokens_from(WANTED))
    return hits.select("signature", "entry_id", F.round("score", 9).alias("score"), F.size("occurrences").cast("long").alias("n_occurrences"))


@query(
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents),
    p AS (SELECT doc_id, length, tok, count(*) AS tf FROM (SELECT doc_id, len(ws) AS length, unnest(ws) AS tok FROM w) GROUP BY ALL),
    q AS (SELECT DISTINCT item_id, tok FROM (SELECT item_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS tok FROM benchmark) WHERE tok <> ''),
    d AS (SELECT tok, count(*) AS df FROM p GROUP BY tok), s AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS average FROM w),
    b AS (SELECT item_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) AS bm25
      FROM p JOIN q USING (tok) JOIN d USING (tok), s GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS rank FROM b)
    SELECT item_id, rank::INTEGER AS rank, doc_id, bm25 FROM r WHERE rank <= 10"""
)
def bm25_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents nearest each benchmark item."""
    from pyspark.sql.window import Window

    words = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", -1), lambda x: x != "")
    n_words = F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"))
    docs = table(spark, sf_dir, "documents").select("doc_id", n_words.alias("length"), words("text").alias("ws"))
    wanted = kept(table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(words("text"))).alias("tok")).distinct())
    terms = wanted.select("tok").distinct()
    terms = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    # a row per document and wanted word, dealt by document once for all that follows
    stats = docs.agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("average"))
    held = docs.select("doc_id", "length", F.explode("ws").alias("tok")).join(terms, "tok", "left_semi")
    postings = kept(held.groupBy("doc_id", "length", "tok").agg(F.count("*").alias("tf")))
    by_doc = postings.repartition("doc_id")  # then scores need no further exchange
    scores = search.bm25(by_doc, wanted, ["doc_id"], stats.select("n").scalar(), stats.select("average").scalar()).withColumn("bm25", F.round("bm25", 6))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bm25"), "doc_id")))
    return ranked.where("rank <= 10").select("item_id", "rank", "doc_id", "bm25")


@query(f"WITH {TOKENS_SQL} SELECT entry_id, array_to_string(list_sort(tokens), ' ') AS tokens FROM tokenized")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_indexed(spark, sf_dir).select("entry_id", F.array_join(F.sort_array("tokens"), " ").alias("tokens"))


@query(f"WITH {FACETS_SQL} SELECT entry_id, string_agg(facet, ' ' ORDER BY facet) AS facets FROM facets GROUP BY entry_id")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_indexed(spark, sf_dir).select("entry_id", F.array_join("facets", " ").alias("facets"))


@query(
    f"""WITH {TOKENS_SQL} SELECT tok, count(*) AS n FROM (SELECT unnest(tokens) AS tok FROM tokenized) WHERE tok[1:2] IN ('e:', 'p:') GROUP BY tok"""
)
def node_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge and path tokens, by joins of the node table."""
    return edge_tokens(nodes(part_formulas(spark, sf_dir))).groupBy("tok").agg(F.count("*").alias("n"))


_LEAVES = "leaves AS (SELECT entry_id, unnest(['v0', power, 'v1', '$Pi', '$\"x,y\"', '@' || p_size, p_type, '', '#', '#9/0']) AS leaf FROM formulas)"


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    power = F.regexp_extract("canonical", r"(#[^\]]*)", 1)
    size = F.concat(F.lit("@"), F.col("p_size").cast("string"))
    sizes = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("entry_id"), "p_size")
    rows = part_formulas(spark, sf_dir).join(sizes, "entry_id")
    listed = F.array(F.lit("v0"), power, F.lit("v1"), F.lit("$Pi"), F.lit('$"x,y"'), size, F.col("class"), F.lit(""), F.lit("#"), F.lit("#9/0"))
    return rows.select("entry_id", F.explode(listed).alias("leaf"))


@query(
    f"""WITH {PART_SQL}, {_LEAVES} SELECT entry_id, leaf, CASE WHEN leaf LIKE '$"%' THEN '$str' WHEN leaf = '' THEN '?' WHEN leaf[1] = '#' THEN '#num' WHEN leaf[1] = 'v' THEN 'var'
    WHEN leaf[1] = '@' THEN 'slot' ELSE leaf END AS class FROM leaves"""
)
def generalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(spark, sf_dir).select("entry_id", "leaf", generalized(F.col("leaf")).alias("class"))


@query(
    f"""WITH {PART_SQL}, {_LEAVES}, n AS (SELECT *, TRY_CAST(regexp_extract(leaf, '^#(-?[0-9]+)(/([0-9]+))?$', 1) AS BIGINT) AS num,
      TRY_CAST(coalesce(nullif(regexp_extract(leaf, '^#(-?[0-9]+)(/([0-9]+))?$', 3), ''), '1') AS BIGINT) AS den FROM leaves)
    SELECT entry_id, leaf, CASE WHEN num IS NOT NULL AND den <> 0 THEN num END AS num, CASE WHEN num IS NOT NULL AND den <> 0 THEN den END AS den FROM n"""
)
def parse_rat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(spark, sf_dir).select("entry_id", "leaf", rational_of(F.col("leaf")).alias("r")).select("entry_id", "leaf", "r.num", "r.den")


_SIDES = f"""{PART_SQL}, e AS (SELECT entry_id, CASE WHEN entry_id[-1:] IN ('0', '5') THEN ' ' ELSE label END AS lhs, canonical AS rhs FROM formulas),
  sides AS (SELECT entry_id, 'lhs' AS side, lhs AS mma FROM e WHERE trim(lhs) <> '' UNION ALL SELECT entry_id, 'rhs', rhs FROM e WHERE trim(rhs) <> '')"""


@query(f"WITH {_SIDES} SELECT * FROM sides")
def unpivot_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sides(part_entries(spark, sf_dir)).select("entry_id", "side", "mma")


@query(
    f"""WITH {_SIDES}, p AS (SELECT entry_id, max(CASE WHEN side = 'lhs' THEN mma END) AS lhs, max(CASE WHEN side = 'rhs' THEN mma END) AS rhs FROM sides GROUP BY entry_id)
    SELECT entry_id, CASE WHEN lhs IS NOT NULL AND rhs IS NOT NULL THEN lhs || ' == ' || rhs ELSE coalesce(lhs, rhs, '') END AS identity_mma FROM p"""
)
def identity_mma(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = search.entry_sides(corpus.sides(part_entries(spark, sf_dir)))
    return pairs.select("entry_id", search.identity_mma(F.col("lhs_mma"), F.col("rhs_mma")).alias("identity_mma"))


@query(f"WITH {PART_SQL} SELECT entry_id, signature AS rhs FROM formulas")
def signatures_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.signatures_by_side(part_formulas(spark, sf_dir)).select("entry_id", F.col("signatures")["rhs"].alias("rhs"))


@query("SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return search.latest(rows, ["user_id", "event_type"], ["ts", "event_id"])


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    b AS (SELECT event_id, user_id, t, k, true AS allowed, {BURST}::DOUBLE - 1 AS left_ FROM e WHERE k = 1
      UNION ALL SELECT event_id, user_id, t, k, have >= 1, CASE WHEN have >= 1 THEN have - 1 ELSE have END
      FROM (SELECT e.event_id, e.user_id, e.t, e.k, least({BURST}::DOUBLE, b.left_ + (e.t - b.t) / 1e6::DOUBLE * (1::DOUBLE / 7200)) AS have FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1))
    SELECT event_id, user_id, allowed FROM b"""
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return limiter.limited(rows, "user_id", "ts", "event_id", RATE, BURST).select("event_id", "user_id", "allowed")


@query(f"WITH {PART_SQL} SELECT count(*) AS count FROM formulas")
def stats_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_formulas(spark, sf_dir).agg(F.count("*").alias("count"))


@query(
    """SELECT format('{:.3f}', (p_partkey * 37 + 5) % 1001 / 1000.0) || '  part-' || p_partkey || '.rhs  ' ||
      CASE WHEN length(repeat(p_name || ' ', p_partkey % 12)) > 80 THEN repeat(p_name || ' ', p_partkey % 12)[:80] || '…' ELSE repeat(p_name || ' ', p_partkey % 12) END AS line FROM part"""
)
def hit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of results with many scores, and LaTeX of up to and beyond 80 characters."""
    rows = table(spark, sf_dir, "part")
    latex = F.repeat(F.concat("p_name", F.lit(" ")), (F.col("p_partkey") % 12).cast("int"))
    hits = rows.select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("entry_id"), F.lit("rhs").alias("side"), latex.alias("latex"), (((F.col("p_partkey") * 37 + 5) % 1001) / 1000.0).alias("score"))
    return search.hit_lines(hits)


# parsing, canonical forms and LaTeX, over derived sides in Mathematica notation


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.analysis(corpus.sides(source_entries(spark, sf_dir)))


@query(f"WITH {FORMS_SQL} SELECT entry_id, side, mma, canonical, sha256(canonical) AS signature, facets FROM parsed")
def canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = corpus.parted(_analysis(spark, sf_dir))
    return good.select("entry_id", "side", "mma", "canonical", "signature", F.array_join("facets", " ").alias("facets"))


@query(f"WITH {FORMS_SQL} SELECT entry_id, side, mma, latex FROM parsed")
def latex_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = corpus.parted(_analysis(spark, sf_dir))
    return good.select("entry_id", "side", "mma", F.col("side_latex").alias("latex"))


@query(
    f"""WITH {FORMS_SQL}, p AS (SELECT entry_id, max(CASE WHEN side = 'lhs' THEN latex END) AS l, max(CASE WHEN side = 'rhs' THEN latex END) AS r,
      max(CASE WHEN side = 'lhs' THEN mma END) AS lm, max(CASE WHEN side = 'rhs' THEN mma END) AS rm FROM parsed GROUP BY entry_id)
    SELECT entry_id, CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l ELSE l || ' = ' || r END AS identity_latex, CASE WHEN lm IS NULL THEN rm WHEN rm IS NULL THEN lm ELSE lm || ' == ' || rm END AS identity_mma FROM p"""
)
def identity_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = corpus.parted(_analysis(spark, sf_dir))
    return search.identities(good).select("entry_id", "identity_latex", "identity_mma")


@query(f"WITH {FORMS_SQL} SELECT entry_id, side, mma, 'expected ] at 3' AS error FROM spelled WHERE canonical IS NULL")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.parted(_analysis(spark, sf_dir))[1]


@query(f"WITH {FORMS_SQL}, o AS (SELECT unnest(string_split(ops, ' ')) AS op FROM parsed) SELECT 'op:' || op AS tok, count(*) AS n FROM o GROUP BY op")
def operators_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator tokens, from the analysis of every side."""
    good, _ = corpus.parted(_analysis(spark, sf_dir))
    return good.select(F.explode("tokens").alias("tok")).where(F.col("tok").startswith("op:")).groupBy("tok").agg(F.count("*").alias("n"))


@query(f"WITH {FORMS_SQL} SELECT count(*) AS total, count(canonical) AS indexed, count(*) - count(canonical) AS rejected FROM spelled")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived side through parser, canonical form, tokens, facets and LaTeX."""
    found = _analysis(spark, sf_dir)
    return found.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("indexed"), F.count_if(F.col("error").isNotNull()).alias("rejected"))


# a store, made from corpus files and changed once


@query(f"WITH {FORMS_SQL} SELECT count(*) AS total, count(canonical) AS indexed, count(*) - count(canonical) AS rejected, 1::BIGINT AS skipped, count(canonical) AS stored FROM spelled")
def store_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus files of all derived entries, and one that isn't a corpus, into a new store, twice."""
    root = fresh_dir(spark, "ingest")
    files = write_corpus(source_entries(spark, sf_dir), f"{root}/corpus", 4)
    spark.createDataFrame([("[{",)], "text string").coalesce(1).write.text(f"{root}/broken")
    store = Store(spark, f"{root}/store")
    for _ in range(2):  # the second changes nothing
        done = store.ingest([*files, f"{root}/broken/*"])
    counts = (done.total, done.indexed, done.rejected.count(), done.skipped.count(), store.count())
    return spark.createDataFrame([counts], "total long, indexed long, rejected long, skipped long, stored long")


@query(f"WITH {STORED_SQL} SELECT entry_id, side, label, source, class, entry_latex AS latex, mma, canonical, sha256(canonical) AS signature, latex AS side_latex, len(string_split(ops, ' ')) AS n_ops FROM stored")
def store_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_ops = F.size(F.filter("tokens", lambda t: t.startswith("op:")))
    return part_store(spark, sf_dir).formulas.select("entry_id", "side", "label", "source", "class", "latex", "mma", "canonical", "signature", "side_latex", n_ops.cast("long").alias("n_ops"))


@query(f"WITH {STORED_SQL}, f AS (SELECT unnest(string_split(facets, ' ')) AS facet FROM stored WHERE facets <> '') SELECT facet, count(*) AS n FROM f GROUP BY facet")
def store_facet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_store(spark, sf_dir).table("facets").groupBy("facet").agg(F.count("*").alias("n"))


@query(
    f"""WITH {STORED_SQL}, m AS (SELECT * FROM stored WHERE list_contains(string_split(facets, ' '), 'fraction'))
    SELECT facet, count(*) AS n FROM (SELECT unnest(string_split(facets, ' ')) AS facet FROM m) WHERE facet <> 'fraction' GROUP BY facet UNION ALL SELECT 'total', count(*) FROM m"""
)
def store_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = part_store(spark, sf_dir).facets(["fraction"])
    return found.refine.unionByName(found.total.select(F.lit("total").alias("facet"), F.col("total").alias("n")))


@query(f"WITH {STORED_SQL}, o AS (SELECT entry_id, side, unnest(string_split(ops, ' ')) AS op FROM stored), g AS (SELECT entry_id, side, op, count(*) AS tf FROM o GROUP BY ALL) SELECT 'op:' || op AS tok, count(*) AS df, sum(tf)::BIGINT AS tf FROM g GROUP BY op")
def store_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_store(spark, sf_dir).table("postings").where(F.col("tok").startswith("op:"))
    return rows.groupBy("tok").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_PAIRS = """pairs AS (SELECT entry_id, max(CASE WHEN side = 'lhs' THEN mma END) AS lm, max(CASE WHEN side = 'rhs' THEN mma END) AS rm, max(CASE WHEN side = 'lhs' THEN latex END) AS ll, max(CASE WHEN side = 'rhs' THEN latex END) AS rl FROM stored GROUP BY entry_id),
  hits AS (SELECT * FROM stored WHERE canonical = 'Binomial[v0,#5]'), first AS (SELECT * FROM hits ORDER BY entry_id, side LIMIT 1), all_ AS (SELECT list({'entry_id': entry_id, 'side': side, 'source': source, 'label': label} ORDER BY entry_id, side) AS o FROM hits)"""


@query(
    f"""WITH {STORED_SQL}, {_PAIRS} SELECT entry_id, side, 1.0::DOUBLE AS score, len(o)::BIGINT AS n_occurrences, list_aggregate(list_transform(o, lambda x: x.entry_id || '.' || x.side), 'string_agg', ',') AS ids,
      concat_ws(' == ', lm, rm) AS identity_mma, concat_ws(' = ', ll, rl) AS identity_latex FROM first JOIN pairs USING (entry_id), all_"""
)
def store_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = part_store(spark, sf_dir).exact(ASKED)
    ids = F.array_join(F.transform("occurrences", lambda o: F.concat_ws(".", o["entry_id"], o["side"])), ",")
    return hits.select("entry_id", "side", "score", F.size("occurrences").cast("long").alias("n_occurrences"), ids.alias("ids"), "identity_mma", "identity_latex")


@query(
    f"""WITH {STORED_SQL}, {_PAIRS} SELECT to_json({{'entry_id': entry_id, 'side': side, 'label': label, 'class': class, 'latex': entry_latex, 'mma': mma,
      'identity_mma': concat_ws(' == ', lm, rm), 'identity_latex': concat_ws(' = ', ll, rl), 'signature': sha256(canonical), 'score': 1.0::DOUBLE, 'occurrences': o}})::VARCHAR AS json FROM first JOIN pairs USING (entry_id), all_"""
)
def hit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hit_json(part_store(spark, sf_dir).exact(ASKED))


@query(
    f"""WITH {STORED_SQL}, d AS (SELECT canonical, count(DISTINCT entry_id) AS n_entries, count(*) AS n_rows FROM stored GROUP BY canonical HAVING count(DISTINCT entry_id) > 1),
    t AS (SELECT count(*) AS total FROM d) SELECT sha256(canonical) AS signature, n_entries, n_rows, total FROM d, t ORDER BY n_entries DESC, signature LIMIT 10"""
)
def store_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, groups = part_store(spark, sf_dir).duplicates(10)
    return groups.select("signature", "n_entries", F.size("occurrences").cast("long").alias("n_rows"), F.lit(total).cast("long").alias("total"))


@query(f"WITH {STORED_SQL}, t AS (SELECT count(*) AS n FROM stored WHERE list_contains(string_split(ops, ' '), 'Binomial')) SELECT 'Binomial[v0,#5]' AS canonical, 1.0::DOUBLE AS score, least(n, 10) > 0 AS found FROM t")
def store_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a fuzzy search, which reads the store's postings: the formula itself."""
    hits = part_store(spark, sf_dir).fuzzy(features.tokens_from(ASKED_FORM), 1)
    return hits.select("canonical", F.round("score", 9).alias("score"), F.lit(True).alias("found"))


@query(
    """SELECT conv_id, role AS system, CASE WHEN conv_id % 3 = 0 THEN 'verified' ELSE 'draft' END AS status, sha256(text) AS proof, true AS dated FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS k FROM conversations) WHERE k = 1"""
)
def proof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of every conversation as its proof; set for all, then set again for every third; a reset of formulas keeps them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.col("role").alias("system"))
    last = search.latest(rows, ["conv_id"], ["turn", "text"]).select(F.col("conv_id").cast("string").alias("entry_id"), "system", F.lit("draft").alias("status"), F.encode("text", "UTF-8").alias("proof"))
    store = Store(spark, f"{fresh_dir(spark, 'proofs')}")
    store.set_proofs(last)
    store.set_proofs(last.where(F.col("entry_id").cast("long") % 3 == 0).withColumn("status", F.lit("verified")))
    store.reset()
    found = store.table("proofs")
    return found.select(F.col("entry_id").cast("long").alias("conv_id"), "system", "status", F.sha2("proof", 256).alias("proof"), F.col("updated").isNotNull().alias("dated"))


_PROBE = "Plus[Integrate[#0,$Infinity,Times[Cos[Times[@0,v0]],Power[$E,Times[#-1,Power[@0,#2],v1]]]],Sum[#1,v2,Power[@0,#2]]]"


@query(
    f"""SELECT * FROM (VALUES ('1 new', true, 'no engine fingerprint recorded (empty store)', '', '2'), ('2 reset', false, '', sha256('{_PROBE}'), '2'), ('3 other engine', true, 'the canonical engine has changed', 'x', '2'),
      ('4 reset again', false, '', sha256('{_PROBE}'), '2'), ('5 other schema', true, 'schema version 1, not 2', sha256('{_PROBE}'), '1')) AS v(step, stale, reason, engine_probe, schema_version)"""
)
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store through its states: what it says of itself, and its settings."""
    store = Store(spark, fresh_dir(spark, "stale"))
    rows = []

    def told(step: str) -> None:
        rows.append((step, *store.stale(), store.meta("engine_probe"), store.meta("schema_version")))

    told("1 new")
    store.reset()
    told("2 reset")
    store.set_meta("engine_probe", "x")
    told("3 other engine")
    store.reset()
    told("4 reset again")
    store.set_meta("schema_version", "1")
    told("5 other schema")
    return spark.createDataFrame(rows, "step string, stale boolean, reason string, engine_probe string, schema_version string")


_BROKEN = "'canonical parse error at '"


@query(
    f"""WITH {PART_SQL} SELECT entry_id, CASE substr(entry_id, -1) WHEN '0' THEN {_BROKEN} || length(canonical) || ': trailing input'
      WHEN '1' THEN {_BROKEN} || (length(canonical) - 1) || ': expected ' || chr(39) || ']' || chr(39) WHEN '2' THEN {_BROKEN} || '5: expected a term' END AS error FROM formulas"""
)
def canonical_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical texts that go on, end early or lack an operand, by the last digit of the part; others are read."""
    form, digit = F.col("canonical"), F.substring("entry_id", -1, 1)
    early = F.substring(form, F.lit(1), F.length(form) - 1)
    broken = F.when(digit == "0", F.concat(form, F.lit("]"))).when(digit == "1", early).when(digit == "2", F.replace(form, F.lit("Plus["), F.lit("Plus[,"))).otherwise(form)
    return part_formulas(spark, sf_dir).withColumn("canonical", broken).select("entry_id", read_error("canonical").alias("error"))


@query("SELECT * FROM (VALUES ('folder', 'a.json b.json'), ('glob', 'notes.txt'), ('twice', 'a.json a.json'), ('missing', 'error'), ('none given', 'error'), ('roots', 'b.json')) AS v(paths, found)")
def corpus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders, globs and files of a corpus in the shared folder."""
    root = fresh_dir(spark, "paths")
    root = root if "://" in root else f"file://{root}"
    for name in ("b.json", "a.json", "notes.txt", "below/c.json"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True).close()

    def found(paths: list[str], roots: tuple[str, ...] = ()) -> str:
        try:
            return " ".join(p.rsplit("/", 1)[1] for p in corpus.sources(paths, list(roots), spark))
        except (FileNotFoundError, ValueError):
            return "error"

    asked = {"folder": [root], "glob": [f"{root}/*.txt"], "twice": [f"{root}/a.json"] * 2, "missing": [f"{root}/none"], "none given": []}
    rows = [(k, found(v)) for k, v in asked.items()] + [("roots", found([], (f"{root}/b.json",)))]
    return spark.createDataFrame(rows, "paths string, found string")


@query(
    f"""WITH {STORED_SQL}, h AS (SELECT count(*) AS n FROM stored WHERE canonical = '{ASKED_FORM}'), f AS (SELECT count(*) AS n FROM stored WHERE list_contains(string_split(facets, ' '), 'sum'))
    SELECT 'count' AS field, (SELECT count(*) FROM stored)::VARCHAR AS value UNION ALL SELECT 'exact occurrences', n::VARCHAR FROM h UNION ALL SELECT 'facets total', n::VARCHAR FROM f
    UNION ALL SELECT * FROM (VALUES ('query_canonical', '{ASKED_FORM}'), ('first of fuzzy', '{ASKED_FORM}'), ('error', 'expected ] at 10'), ('no query', 'q is required'), ('facets limit', '25'), ('added lhs', sha256('Zeta[#2]')),
      ('added rhs', sha256('Times[#1/6,Power[$Pi,#2]]')), ('refused', 'rhs: expected ] at 4'), ('no id', 'id is required'), ('proof', 'coq draft by computation'), ('no proof', '')) AS v(field, value)"""
)
def service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the service answers on the derived store, and on a new one that is added to."""
    store, fresh = part_store(spark, sf_dir), Store(spark, fresh_dir(spark, "service"))

    def refused(of) -> str:
        try:
            of()
        except ValueError as e:
            return str(e)
        return ""

    found, facet = api.search(store, ASKED), api.facets(store, ["sum"])
    added = api.add(fresh, {"id": "z", "lhs": "Zeta[2]", "rhs": "Pi^2/6"}).first()["signatures"]
    api.put_proof(fresh, "z", "coq", "by computation")
    proof = lambda k: " ".join(str(x) for r in api.get_proof(fresh, k).select("system", "status", "proof").collect() for x in r)
    answers = {
        "count": api.stats(store).first()["count"], "query_canonical": found["query_canonical"], "exact occurrences": len(found["exact"].first()["occurrences"]),
        "first of fuzzy": store.fuzzy(features.tokens_from(ASKED_FORM), 1).first()["canonical"], "error": api.search(store, "Binomial[i")["error"], "no query": refused(lambda: api.search(store, "")),
        "facets total": facet["total"].first()["total"], "facets limit": facet["limit"], "added lhs": added["lhs"], "added rhs": added["rhs"],
        "refused": refused(lambda: api.add(fresh, {"id": "y", "lhs": "u", "rhs": "f[uu"})), "no id": refused(lambda: api.add(fresh, {"lhs": "u"})), "proof": proof("z"), "no proof": proof("y"),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in answers.items()], "field string, value string")


# helpers of the service


@query(
    """WITH c AS (SELECT c_custkey, c_name, c_mktsegment AS seg, c_custkey % 256 AS o FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS bearer, CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.' || o ELSE CASE WHEN c_custkey % 4 = 1 THEN '192.168.7.' || o ELSE '::' || o END END AS client_ip,
      seg || ':' || c_name AS subject, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN seg END AS user_info_id, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS id_token_subject,
      CASE WHEN c_custkey % 2 = 0 THEN 'x^{' || o || '}' ELSE c_name END AS cleaned, CASE WHEN c_custkey % 5 = 0 THEN seg ELSE c_name END AS first_non_empty, c_custkey % 7 <> 0 AS not_blank,
      CASE WHEN length(seg || c_name) > 26 THEN (seg || c_name)[:26] || '…' ELSE seg || c_name END AS shortened, CASE WHEN c_custkey % 5 = 0 THEN seg ELSE c_name END AS display_latex, CASE WHEN c_custkey % 5 = 0 THEN coalesce(CASE WHEN c_custkey % 2 = 0 THEN seg END, '') ELSE c_name END AS display_mma,
      CASE WHEN c_custkey % 2 = 0 THEN c_name || '.lhs, ' || c_name || '.rhs' ELSE '' END AS occurrences FROM c"""
)
def service_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, addresses, JSON bodies, tokens and LaTeX derived from customers, through the helpers of the service."""
    key, name, seg, o = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"), (F.col("c_custkey") % 256).cast("string")
    even, third = key % 2 == 0, key % 3
    say = F.concat
    header = F.when(third == 0, say(F.lit("Bearer   "), name, F.lit("  "))).when(third == 1, say(F.lit("Basic "), name)).otherwise(F.lit(""))
    forwarded = F.when(even, say(F.lit(" 10.0.0."), o, F.lit(" , 1.2.3.4"))).otherwise(F.lit(""))
    remote = F.when(key % 4 == 1, say(F.lit("192.168.7."), o, F.lit(":8080"))).otherwise(say(F.lit("[::"), o, F.lit("]:443")))
    body = F.when(third == 0, say(F.lit('{"sub": "'), name, F.lit('", "id": "9"}'))).when(third == 1, say(F.lit('{"id": "'), seg, F.lit('"}'))).otherwise(F.lit('{"name": "x"}'))
    payload = F.translate(F.regexp_replace(F.base64(say(F.lit('{"sub": "'), name, F.lit('"}')).cast("binary")), "[=\\s]", ""), "+/", "-_")
    token = F.when(third == 0, say(F.lit("e30."), payload, F.lit(".sig"))).when(third == 1, say(F.lit("."), payload, F.lit("."))).otherwise(say(F.lit("e30."), payload))
    latex = F.when(even, say(F.lit(" $$x^{"), o, F.lit("}$ "))).otherwise(say(F.lit("$"), name, F.lit(" .  ")))
    first = F.when(key % 5 == 0, F.lit("")).otherwise(name)
    blank = F.when(key % 7 == 0, F.lit(" \t  ")).otherwise(say(F.lit(" "), name))
    occurrence = lambda side: F.struct(name.alias("entry_id"), F.lit(side).alias("side"))
    occurrences = F.when(even, F.array(occurrence("lhs"), occurrence("rhs"))).otherwise(F.array(occurrence("lhs")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", strings.bearer(header).alias("bearer"), strings.client_ip(forwarded, remote).alias("client_ip"), strings.subject(seg, name).alias("subject"), strings.user_info_id(body).alias("user_info_id"),
        strings.id_token_subject(token).alias("id_token_subject"), strings.cleaned_latex(latex).alias("cleaned"), strings.first_non_empty(first, seg).alias("first_non_empty"), strings.not_blank(blank).alias("not_blank"),
        strings.shortened(say(seg, name), 26).alias("shortened"), strings.display_latex(first, seg).alias("display_latex"), strings.display_mma(first, F.when(even, seg)).alias("display_mma"), strings.occurrence_text(occurrences).alias("occurrences"),
    )


@query(
    f"""WITH RECURSIVE r AS (SELECT event_id, user_id, ts, event_id % 5 = 0 OR event_type IN ('error') AS free FROM events),
    e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM r WHERE NOT free),
    b AS (SELECT event_id, user_id, t, k, true AS allowed, {BURST}::DOUBLE - 1 AS left_ FROM e WHERE k = 1
      UNION ALL SELECT event_id, user_id, t, k, have >= 1, CASE WHEN have >= 1 THEN have - 1 ELSE have END
      FROM (SELECT e.event_id, e.user_id, e.t, e.k, least({BURST}::DOUBLE, b.left_ + (e.t - b.t) / 1e6::DOUBLE * (1::DOUBLE / 7200)) AS have FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1))
    SELECT event_id, user_id, allowed FROM b UNION ALL SELECT event_id, user_id, true FROM r WHERE free"""
)
def rate_limit_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some requests are outside the limited paths, some come from a privileged role."""
    path = F.when(F.col("event_id") % 5 == 0, F.lit("/docs")).otherwise(F.lit("/api/search"))
    role = F.when(F.col("event_type") == "error", F.lit("privileged")).otherwise(F.lit("social"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", path.alias("path"), role.alias("role"))
    found = limiter.limited(rows, "user_id", "ts", "event_id", RATE, BURST, limiter.exempt(F.col("path"), F.col("role")))
    return found.select("event_id", "user_id", "allowed")
