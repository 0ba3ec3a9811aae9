"""Near-duplicate documents by an LSH forest over MinHash signatures.

A signature is cut into TREES labels of DEPTH values. Each tree is a sorted order of all labels;
documents next to each other there share the longest prefixes, so the order itself is as deep as
a region needs: among many similar documents, neighbours agree in many values, elsewhere in few.
Neighbours that share enough first values are candidates, confirmed on their full shingle sets: as
many as leave a pair at the threshold a chance of MISS at most to share fewer in every tree.
The second round widens the windows among neighbours that are still in different components.

Rows that share so many first values in a tree are a region. The windows cover small regions
whole. Documents of larger ones that hold several components are joined on prefixes: in any one
order of all shingles, two sets that are similar enough share one of the first
n - ceil(n * PERCENT / 100) + 1 of each. Rare shingles go first, so what many documents share, as
boilerplate, makes no pairs. So no pair of a region is left out, however dense it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm import shingles
from axiomata.llm.components import components
from axiomata.llm.tables import Scratch, table

TREES, DEPTH, MISS = 16, 8, 2e-5
#: Rows on either side that are neighbours in each round; larger regions are joined on prefixes.
WINDOWS = (2, 10)
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bytes of text hashed together; rows of a tree per task; copies are spread over so many keys.
TOGETHER, ROWS, SALT = 1 << 20, 200_000, 16
#: Documents on either side of a block of pairs that are confirmed together.
BLOCK = 4_000
#: Candidate ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Counters of the rarity that orders shingles (any order is exact); pairs made at a time.
RARITY, PAIRS = 1 << 18, 1 << 21
_FACTORS = np.random.default_rng(20260103).integers(0, 2**63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of stretches of a batch of about TOGETHER bytes."""
    texts = batch.column(column)
    k = 0
    while k < batch.num_rows:
        some, size = [], 0
        while k + len(some) < batch.num_rows and (not some or size < TOGETHER):
            some.append((texts[k + len(some)].as_py() or "").encode("utf-8", "replace"))
            size += len(some[-1])
        yield k, some
        k += len(some)


def signatures(found: list[np.ndarray]) -> np.ndarray:
    """MinHash values of some non-empty sets, as big-endian bytes, so that bytes sort as values."""
    flat = np.concatenate(found)
    starts = np.cumsum([0] + [len(s) for s in found[:-1]])
    out = np.empty((len(found), TREES * DEPTH), ">u4")
    for k, factor in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat(flat * factor, starts) >> np.uint64(32)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, signs = [], [], []
        for _, texts in _groups(batch, "text"):
            found = shingles.sets(texts)
            full = [s for s in found if len(s)]
            made = iter(signatures(full)) if full else iter(())
            for s in found:
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signs.append(next(made).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"]
        )


def least_common(percent: int) -> int:
    """First values that candidates have in common: 4 at 85, 3 at 80."""
    return max(d for d in range(1, DEPTH + 1) if d == 1 or (1 - (percent / 100) ** d) ** TREES <= MISS)


def neighbours(tree: np.ndarray, label: np.ndarray, rep: np.ndarray, comp: np.ndarray, size: np.ndarray, percent: int, past: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs among rows in label order, past ``past`` and up to ``to`` places apart."""
    n = len(rep)
    same = (label[1:] == label[:-1]).cumprod(axis=1).sum(axis=1) >= least_common(percent)
    same &= tree[1:] == tree[:-1]
    region = np.concatenate([[0], np.cumsum(~same)])
    pairs = [(np.arange(n - k), np.arange(k, n)) for k in range(past + 1, to + 1) if n > k]
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
    low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    ok = (region[a] == region[b]) & (comp[a] != comp[b]) & (rep[a] != rep[b]) & (100 * low >= percent * high)
    a, b = rep[a[ok]], rep[b[ok]]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1]


_ORDERED = ["tree", "label", "rep", "comp", "n_shingles"]


def _next_to(percent: int, window: tuple[int, int], ends: bool):
    """A task's rows in label order -> candidate pairs, and its first and last rows if ``ends``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        tree, rep, comp, size = (whole[c].to_numpy() for c in ("tree", "rep", "comp", "n_shingles"))
        label = np.frombuffer(b"".join(whole["label"].to_pylist()), ">u4").reshape(len(rep), DEPTH)
        a, b = neighbours(tree, label, rep, comp, size, percent, *window)
        nothing = pa.nulls(len(a))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(nothing.cast(whole.schema.field(c).type) for c in _ORDERED)], names=["a", "b", *_ORDERED])
        if ends:
            edge = whole if len(rep) <= 2 * window[1] else pa.concat_tables([whole.slice(0, window[1]), whole.slice(len(rep) - window[1])])
            for x in edge.select(_ORDERED).combine_chunks().to_batches():
                none = pa.nulls(x.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *x.columns], names=["a", "b", *_ORDERED])

    return run


def candidates(forest: DataFrame, scratch: Scratch, rows: int, percent: int, window: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of neighbours in different components. ``forest`` has _ORDERED."""
    parts = max(1, -(-rows // ROWS))
    schema = "a long, b long, tree int, label binary, rep long, comp long, n_shingles long"
    dealt = forest.repartitionByRange(parts, "tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    found = scratch.keep(dealt.mapInArrow(_next_to(percent, window, parts > 1), schema))
    pairs = found.where("a is not null").select("a", "b")
    if parts > 1:  # a few rows per task: pairs across the tasks' borders
        border = found.where("a is null").select(*_ORDERED).coalesce(1).sortWithinPartitions("tree", "label", "rep")
        pairs = pairs.unionByName(border.mapInArrow(_next_to(percent, window, False), schema).where("a is not null").select("a", "b"))
    return pairs.distinct()


def dense(forest: DataFrame, scratch: Scratch, percent: int, window: int) -> DataFrame:
    """rep, comp of the rows in regions of several components that windows don't cover."""
    region = F.substring("label", 1, 4 * least_common(percent)).alias("region")
    sizes = forest.groupBy("tree", region).agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    large = scratch.keep(sizes.where((F.col("n") > window + 1) & (F.col("low") < F.col("high"))).select("tree", "region"))
    rows = forest.select("tree", region, "rep", "comp")
    if large.count() <= BROADCAST_IDS:
        inside = rows.join(F.broadcast(large), ["tree", "region"], "left_semi")
    else:
        salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        inside = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALT)).cast("int")).join(salted, ["tree", "region", "salt"], "left_semi")
    return scratch.keep(inside.select("rep", "comp").distinct())


def _counter(shingle: np.ndarray) -> np.ndarray:
    return (shingle % np.uint64(RARITY)).astype(np.int64)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(RARITY, np.int64)
    for batch in batches:
        for _, texts in _groups(batch, "text"):
            for s in shingles.sets(texts):
                np.add.at(total, _counter(s), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])


def prefix(shingle: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, of which any set that is similar enough has one among its own."""
    n = len(shingle)
    return shingle[np.lexsort((shingle, rarity[_counter(shingle)]))[: n + percent * n // -100 + 1]]


def _prefixed(rarity, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, texts in _groups(batch, "text"):
                found = shingles.sets(texts)
                first = [prefix(s, rarity.value, percent) for s in found]
                times = [len(x) for x in first]
                place = np.concatenate([np.arange(n) for n in times])
                own = [np.repeat(batch.column(c).to_numpy()[k : k + len(found)], times) for c in ("rep", "comp")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(first).view(np.int64)), *map(pa.array, own), pa.array(np.repeat([len(s) for s in found], times)), pa.array(place)], names=["shingle", "rep", "comp", "n_shingles", "place"]
                )

    return run


def across(shingle: np.ndarray, rep: np.ndarray, comp: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of different components that share a shingle. Rows come sorted by shingle and comp.

    Sets that are similar enough have ``least`` shingles in common, so after the rarest of these
    either set has least - 1 more; a shingle at a later place can't be it.
    """
    n = len(rep)
    new = np.append(shingle[1:] != shingle[:-1], True)
    ends = lambda last: np.minimum.accumulate(np.where(last, np.arange(1, n + 1), n)[::-1])[::-1]
    after, end = ends(new | np.append(comp[1:] != comp[:-1], True)), ends(new)
    sums = np.cumsum(end - after)
    k = 0
    while k < n:
        stop = max(k + 1, int(np.searchsorted(sums, (sums[k - 1] if k else 0) + PAIRS, "right")))
        times = (end - after)[k:stop]
        a = np.repeat(np.arange(k, stop), times)
        b = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(after[k:stop], times)
        ok = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        least = -(-percent * (size[a] + size[b]) // (100 + percent))
        ok &= (rep[a] != rep[b]) & (place[a] <= size[a] - least) & (place[b] <= size[b] - least)
        a, b = rep[a[ok]], rep[b[ok]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pairs[0], pairs[1]
        k = stop


def _across(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            whole = pa.Table.from_batches(got)
            for a, b in across(*(whole[c].to_numpy() for c in ("shingle", "rep", "comp", "n_shingles", "place")), percent):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def prefix_pairs(inside: DataFrame, docs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """All pairs (a, b) of different components among ``inside`` (rep, comp) that can be similar enough."""
    spark = docs.sparkSession
    few = inside.count() <= BROADCAST_IDS
    texts = scratch.keep(docs.withColumnRenamed("doc_id", "rep").join(F.broadcast(inside) if few else inside, "rep").dropDuplicates(["rep", "text"]).select("rep", "comp", "text"))
    tally = texts.select("text").mapInArrow(_tallied, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    rarity = np.zeros(RARITY, np.int64)
    rarity[tally["at"].to_numpy()] = tally["n"].to_numpy()
    rows = scratch.keep(texts.mapInArrow(_prefixed(spark.sparkContext.broadcast(rarity), percent), "shingle long, rep long, comp long, n_shingles long, place long"))
    dealt = rows.repartition(max(1, -(-rows.count() // ROWS)), "shingle").sortWithinPartitions("shingle", "comp")
    return dealt.mapInArrow(_across(percent), "a long, b long").distinct()


def _confirmed(percent: int):
    """Rows come sorted by block, its documents first (other is null); then its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}
        for batch in batches:
            block, ids, other = (batch.column(c).to_pylist() for c in ("block", "id", "other"))
            found: list[np.ndarray] = []
            for _, texts in _groups(batch, "text"):
                found += shingles.sets(texts)
            links: list[tuple[int, int]] = []
            for k, x, y, s in zip(block, ids, other, found, strict=True):
                if k != at:
                    at, own = k, {}
                if y is None:
                    own.setdefault(x, []).append(s)
                elif any(100 * (c := shingles.common(p, q)) >= percent * (len(p) + len(q) - c) for p in own.get(x, ()) for q in own.get(y, ())):
                    links.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough.

    Both ends of a pair are hashed into groups of about BLOCK documents; a block holds the pairs
    between two groups, so a text goes to a block once, however many of its pairs are there.
    """
    ids = scratch.keep(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    n = ids.count()
    texts = scratch.keep(docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    groups = max(1, -(-n // BLOCK))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    keyed = pairs.select("a", "b", (group("a") * groups + group("b")).alias("block"))
    needed = keyed.select("block", F.col("a").alias("doc_id")).unionByName(keyed.select("block", F.col("b").alias("doc_id"))).distinct()
    rows = needed.join(texts, "doc_id").select("block", F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("other"), "text")
    rows = rows.unionByName(keyed.select("block", F.col("a").alias("id"), F.col("b").alias("other"), F.lit(None).cast("string").alias("text")))
    dealt = rows.repartition(max(12, min(groups * groups, -(-n // 2_000))), "block").sortWithinPartitions("block", F.col("other").asc_nulls_first())
    return scratch.keep(dealt.mapInArrow(_confirmed(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Only key and text are read. Documents with equal sets are one node of the forest. A text
    without words (or null) has an empty set, is linked with nothing and is its own component.
    Rows that repeat a doc_id are one document, linked by any of its texts. A null doc_id takes
    the component of its set's other documents, if any, and is never kept unless its set is empty
    or nowhere else. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "forest")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = scratch.keep(docs.mapInArrow(_signed, "doc_id long, n_shingles long, digest binary, signature binary"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt")
    members = signed.select("doc_id", "n_shingles", "digest", salt)
    salted = scratch.keep(members.where("digest is not null").groupBy("digest", "salt").agg(F.min("doc_id").alias("low")))
    reps = salted.groupBy("digest").agg(F.min("low").alias("rep"))
    full = signed.where("digest is not null and doc_id is not null").dropDuplicates(["digest", "doc_id"])
    nodes = scratch.keep(full.join(reps.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "signature"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring(F.col("signature"), t * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("label")))
    rows = nodes.count() * TREES
    links = roots = None

    def planted() -> DataFrame:
        if roots is None:
            placed = nodes.withColumn("comp", F.col("rep"))
        else:
            placed = nodes.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("comp", F.coalesce("root", "rep"))
        return placed.select(F.explode(cut).alias("t"), "rep", "comp", "n_shingles").select("t.tree", "t.label", "rep", "comp", "n_shingles")

    for window in zip((0, *WINDOWS), WINDOWS, strict=False):
        found = confirmed(scratch.keep(candidates(planted(), scratch, rows, percent, window)), docs, scratch, percent)
        links = found if links is None else links.unionByName(found)
        roots = components(links, scratch)
    inside = dense(planted(), scratch, percent, WINDOWS[-1])
    if not inside.isEmpty():
        found = confirmed(scratch.keep(prefix_pairs(inside, docs, scratch, percent)), docs, scratch, percent)
        links = links.unionByName(found)
        roots = components(links, scratch)
    named = reps.join(roots, reps.rep == roots.id, "left").select("digest", F.coalesce("root", "rep").alias("comp"))
    spread = salted.select("digest", "salt").join(named, "digest")
    own = members.join(spread, ["digest", "salt"], "left")
    component = F.coalesce("comp", "doc_id")
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("comp").isNull()).alias("kept"))


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, more) that stay: one document of each component.

    Of rows that repeat a doc_id the one with the smallest text stays. Rows without a doc_id stay.
    """
    scratch = Scratch(docs.sparkSession, "representatives")
    gone = scratch.keep(near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").where("doc_id is not null").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    stay = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = scratch.keep(docs.where("doc_id is not null").groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"))
    if again.isEmpty():
        return stay
    first = stay.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.coalesce("text", F.lit(""))).alias("row"))
    return stay.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select("row.*"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
