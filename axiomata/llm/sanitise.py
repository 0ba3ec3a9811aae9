"""Personal data: fixed patterns, and terms that give protected entities away.

Patterns find emails, IP addresses, card and phone numbers. Protected entities are the values found
and the groups they belong to: an email's domain, an address's network, a phone number's or a
card's first digits. Words that stand near an entity are its candidates, and their co-occurrence is
counted over all documents: how many hold the word, the entity, and the word near the entity. A
word gives an entity away if its pointwise mutual information with it reaches ALPHA of the
entity's own information, and if that is no chance: in how many different surroundings both meet
must be too many for words and entities that are independent. Copies of one text are one
surrounding, so they are no evidence. Such words are hidden wherever they occur, in any document.
All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm.tables import Scratch, table

#: Each finds the same matches as the plain pattern, starting only where that one can, so that long runs take linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Sixteen digits and more; shorter matches of the plain pattern are dropped anyway.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
#: Code points on either side of an entity that count as near; letters or digits of a word.
REACH, LETTERS = 60, 2
#: Different surroundings in which a word and an entity must meet; there is no evidence in one.
CONTEXTS = 2
#: Share of an entity's information that a term must carry; logarithm of how unlikely chance must be, for all pairs looked at.
ALPHA, UNLIKELY = 0.9, 14.0
#: Keys that a frequent pair of entity and term is spread over.
SALT = 8
#: Rows with terms, and words, that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_WORDS = 50_000, 200_000
WORD = rf"[\p{{L}}\p{{N}}]{{{LETTERS},}}+"

_SPAN = "array<struct<start:int,end:int,hit:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _each(kinds: tuple[str, ...], of: Callable[[str, Column], Column]) -> Column:
    """``of`` a kind and each of its spans, for some kinds in order, as one array."""

    def one(k: str) -> Column:
        return F.transform(F.col(k), lambda x: of(k, x))

    return F.concat(*[one(k) for k in kinds])


def spans(text: Column, pattern: str | Column) -> Column:
    """start, end (code points, end exclusive) and text of the leftmost non-overlapping matches."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.zip_with(between, hits, lambda b, h: F.struct(F.length(b).alias("gap"), h.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), _none().alias("got"))

    def step(s: Column, x: Column) -> Column:
        begin, end = s["at"] + x["gap"], s["at"] + x["gap"] + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(s["got"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("got"))

    return F.aggregate(F.filter(sizes, lambda x: x["hit"].isNotNull()), start, step, lambda s: s["got"])


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(number)

    def value(i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind, the spans of the patterns that hold personal data."""
    found = {
        "email": F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(_none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), spans(text, IP)).otherwise(_none()),
        "card": F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), spans(text, CARD)).otherwise(_none()),
        "phone": F.when(F.contains(text, F.lit("+")), spans(text, PHONE)).otherwise(_none()),
    }
    found["ip"] = F.filter(found["ip"], lambda x: F.forall(F.split(x["hit"], r"\."), _small))
    found["card"] = F.filter(found["card"], lambda x: (F.length(digits(x["hit"])) <= 19) & luhn(digits(x["hit"])))
    found["phone"] = F.filter(found["phone"], lambda x: F.length(digits(x["hit"])).between(8, 15))
    return found


def context_words(text: Column, span: Column, every: Column) -> Column:
    """Words around one span: its left and right surroundings without cut words, and outside all spans."""
    low = F.greatest(span["start"] - REACH, F.lit(0))
    left = F.substring(text, low + 1, span["start"] - low)
    cut = F.when(low > 0, F.length(F.regexp_extract(left, r"^\S*", 0))).otherwise(F.lit(0))
    right = F.substring(text, span["end"] + 1, F.lit(REACH))
    whole = F.when(F.length(right) == REACH, F.regexp_replace(right, r"\S*$", "")).otherwise(right)
    moved = lambda found, by: F.transform(found, lambda w: F.struct((w["start"] + by).alias("start"), (w["end"] + by).alias("end"), F.lower(w["hit"]).alias("hit")))
    words = F.concat(moved(spans(F.substring(left, cut + 1, F.length(left)), WORD), low + cut), moved(spans(whole, WORD), span["end"]))
    return F.filter(words, lambda w: ~F.exists(every, lambda b: (w["start"] < b["end"]) & (w["end"] > b["start"])))


def _row() -> Column:
    """Stands for a row where spans are joined; equal rows have equal spans."""
    return F.xxhash64("doc_id", "text")


def entities(kind: str, hit: Column) -> Column:
    """What a value reveals: itself, and its group."""
    value = F.lower(hit)
    group = {
        "email": F.concat(F.lit("domain:"), F.substring_index(value, "@", -1)),
        "ip": F.concat(F.lit("network:"), F.substring_index(value, ".", 2)),
        "card": F.concat(F.lit("issuer:"), F.substring(digits(value), 1, 6)),
        "phone": F.concat(F.lit("area:"), F.substring(digits(value), 1, 4)),
    }[kind]
    return F.array(F.concat(F.lit(f"{kind}:"), value), group)


def found(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, spans per kind (the terms too) for every row of ``docs``; without the texts."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kept = scratch.keep(_marked(docs))
    hidden = occurrences(docs, kept, telling(docs, kept, scratch).select("hit").distinct(), scratch)
    return kept.drop("around").join(_handed(hidden, scratch), "row", "left").withColumn("term", F.coalesce("term", _none()))


def _marked(docs: DataFrame) -> DataFrame:
    """row, doc_id, base spans, and for each span its entities and the words near it."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select("doc_id", _row().alias("row"), whole.alias("text"), *[c.alias(k) for k, c in base_spans(whole).items()])
    every = F.concat(*[F.col(k) for k in KINDS[:4]])
    named = _each(KINDS[:4], lambda k, x: F.struct(entities(k, x["hit"]).alias("entities"), x["start"].alias("start"), x["end"].alias("end")))
    around = F.transform(named, lambda x: F.struct(x["entities"].alias("entities"), context_words(F.col("text"), x, F.col("every")).alias("words")))
    marked = marked.withColumn("every", every).withColumn("around", F.when(F.size("every") > 0, around).otherwise(F.array().cast(f"array<struct<entities:array<string>,words:{_SPAN}>>")))
    return marked.select("row", "doc_id", *KINDS[:4], "around")


def _handed(rows: DataFrame, scratch: Scratch, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows that are written once, to be broadcast if they are few."""
    rows = scratch.keep(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


def words_of(text: str = "text") -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def telling(docs: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """entity, hit and their counts, for the words that give an entity away.

    Of ``n_docs`` documents, n_entity hold the entity, n_word the word, n_both the word near the
    entity; contexts and both_contexts are in how many different surroundings the entity stands,
    and with the word.
    """
    near = kept.select("row", F.explode("around").alias("a")).select("row", F.explode("a.entities").alias("entity"), F.transform("a.words", lambda w: w["hit"]).alias("words"))
    near = near.withColumn("context", F.xxhash64(F.array_join("words", " ")))
    # entities of one surrounding, as most are, end here
    contexts = near.groupBy("entity", "context").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= CONTEXTS)
    salted = contexts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    often = near.withColumn("salt", F.pmod("row", F.lit(SALT)).cast("int")).join(salted, ["entity", "salt"])
    words = scratch.keep(often.select("row", "entity", "context", "contexts", F.explode(F.array_distinct("words")).alias("hit")))
    met = words.groupBy("entity", "hit", "context").agg(F.max("contexts").alias("contexts")).groupBy("entity", "hit").agg(F.count("*").alias("both_contexts"), F.max("contexts").alias("contexts"))
    pairs = scratch.keep(met.where(F.col("both_contexts") >= CONTEXTS))
    together = words.select("entity", "hit", "row").distinct().groupBy("entity", "hit").agg(F.count("*").alias("n_both")).join(pairs, ["entity", "hit"])
    holding = kept.select("row", F.explode(F.array_distinct(F.flatten(F.transform("around", lambda a: a["entities"])))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    candidates = _handed(pairs.select("hit").distinct(), scratch, BROADCAST_WORDS)
    frequency = docs.select(F.explode(words_of()).alias("hit")).join(candidates, "hit", "left_semi").groupBy("hit").agg(F.count("*").alias("n_word"))
    total = kept.agg(F.count("*").cast("double"))
    judged = together.join(holding, "entity").join(frequency, "hit").withColumn("n_docs", total.scalar())
    information = -F.log2(F.col("n_entity") / F.col("n_docs"))
    mutual = F.log2(F.col("n_both") * F.col("n_docs") / (F.col("n_word").cast("double") * F.col("n_entity")))
    expected = F.col("contexts") * F.col("n_word") / F.col("n_docs")  # surroundings with both, if they were independent
    evidence = F.col("both_contexts") * F.log(F.col("both_contexts") / expected) - F.col("both_contexts") + expected
    return scratch.keep(judged.where((information > 0) & (mutual >= ALPHA * information) & (F.col("both_contexts") > expected) & (evidence >= UNLIKELY)))


def occurrences(docs: DataFrame, kept: DataFrame, hits: DataFrame, scratch: Scratch) -> DataFrame:
    """row, term: the spans of telling words in all documents, outside the base spans."""
    hits = _handed(hits, scratch, BROADCAST_WORDS)
    having = docs.select(_row().alias("row"), F.explode(words_of()).alias("hit")).join(hits, "hit").distinct().groupBy("row").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    having = _handed(having, scratch)
    some = docs.select(_row().alias("row"), "text").join(having, "row").join(kept.select("row", F.concat(*KINDS[:4]).alias("every")), "row").dropDuplicates(["row"])
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("hits", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    at = F.filter(spans(F.col("text"), pattern), lambda x: F.array_contains(F.col("hits"), F.lower(x["hit"])) & ~F.exists("every", lambda b: (x["start"] < b["end"]) & (x["end"] > b["start"])))
    return some.select("row", at.cast(_SPAN).alias("term")).where(F.size("term") > 0)


def _listed(kinds: tuple[str, ...]) -> Column:
    return F.array_join(_each(kinds, lambda k, x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts per kind, base_sha256 and spans for every row of ``docs``.

    Only key and text are read. A null text counts as empty. Rows that repeat a doc_id are each
    reported; texts of any length are searched whole; an empty table gives an empty report.
    """
    scratch = Scratch(docs.sparkSession, "sanitise")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found(docs, scratch, key, text).select("doc_id", *counts[:4], F.sha2(_listed(KINDS[:4]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"), counts[4])


def replaced(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The text with every span replaced by the name of its kind; spans that overlap become one."""
    every = F.sort_array(_each(kinds, lambda k, x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("name"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        after = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), x["name"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], after).otherwise(s["out"]).alias("out"))

    return F.aggregate(every, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced. All columns stay; a null text stays null."""
    scratch = Scratch(docs.sparkSession, "sanitise")
    terms = found(docs, scratch, key, text).where(F.size("term") > 0).select("row", "term").dropDuplicates(["row"])
    packed = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.struct("*").alias("whole"))
    marked = packed.select("whole", "text", _row().alias("row"), *[c.alias(k) for k, c in base_spans(F.coalesce("text", F.lit(""))).items()])
    marked = marked.join(_handed(terms, scratch), "row", "left").withColumn("term", F.coalesce("term", _none()))
    after = F.when(F.col("text").isNotNull(), replaced(F.col("text")))
    return marked.select(F.col("whole").withField(f"`{text}`", after).alias("whole")).select("whole.*")


def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents", "doc_id", "text"))
