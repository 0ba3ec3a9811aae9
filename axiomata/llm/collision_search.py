"""Nearest neighbours by counting collisions in single-projection sorted arrays.

Every valid vector is indexed: it is normalised and projected on M random directions, and each
block of vectors keeps one sorted array of projections per direction. Around a query's own
projection a window is taken in every array; windows widen by a factor (virtual rehashing), and
only the vectors that newly lie in them are counted, until enough collide with the query in a
share of the arrays. Those vectors are verified with the exact cosine in double precision. Widening stops for a query once its k-th
verified distance lies within the windows, or the windows hold the whole block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiomata.llm.tables import table

#: Directions; vectors in a block; first half-width of a window; its growth; the share of arrays that must collide.
M, BLOCK, WIDTH, GROWTH, SHARE = 48, 16384, 0.3, 1.6, 0.54
#: Verified candidates per query and block before the radius test may stop it, as a multiple of k.
ENOUGH = 20
#: Queries that are searched together.
BATCH = 64
SEED = 20260101
SCHEMA = "query_id long, vec_id long, score double"


def directions(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim, m))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest components are from 0.5 to 1.

    That leaves cosines as they are, to the last bit, and keeps squares from over- and underflowing.
    """
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


class Block:
    """The sorted arrays of up to 65,535 vectors, of any magnitude."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = M):
        self.ids = ids
        self.vectors = vectors = scaled(vectors)
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.a = directions(vectors.shape[1], m)
        marks = ((vectors / self.norms[:, None]) @ self.a).T
        self.order = np.argsort(marks, axis=1, kind="stable")
        self.marks = np.take_along_axis(marks, self.order, axis=1)

    def widen(self, marks: np.ndarray, width: float, low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> None:
        """Widens the windows (``low``, ``high``: places in every array) of some queries, and counts what comes to lie in them."""
        below, above = np.empty_like(low), np.empty_like(high)
        for j, row in enumerate(self.marks):
            below[:, j] = np.searchsorted(row, marks[:, j] - width)
            above[:, j] = np.searchsorted(row, marks[:, j] + width, "right")
        for i in range(len(marks)):
            edges = zip(self.order, below[i].tolist(), low[i].tolist(), high[i].tolist(), above[i].tolist(), strict=True)
            fresh = [part for row, a, b, c, d in edges for part in (row[a:b], row[c:d])]
            counts[i] += np.bincount(np.concatenate(fresh), minlength=len(self.ids)).astype(counts.dtype)
        low[:], high[:] = below, above

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query, ids and cosines of the k best verified vectors, ties to the smaller id."""
        queries = scaled(queries)
        own = np.sqrt((queries * queries).sum(1))
        marks = (queries / own[:, None]) @ self.a
        need = max(1, int(np.ceil(SHARE * len(self.marks))))
        found: list = [None] * len(queries)
        active, width = np.arange(len(queries)), WIDTH
        low = np.stack([np.searchsorted(row, marks[:, j]) for j, row in enumerate(self.marks)], axis=1)
        high, counts = low.copy(), np.zeros((len(queries), len(self.ids)), np.uint8)
        while len(active):
            lows, highs, found_there = low[active], high[active], counts[active]
            self.widen(marks[active], width, lows, highs, found_there)
            low[active], high[active], counts[active] = lows, highs, found_there
            hit = found_there >= need
            hit &= self.ids[None, :] != query_ids[active, None]
            whole = width >= 2 * np.abs(self.marks).max() + 1e-9
            if whole:
                hit = self.ids[None, :] != query_ids[active, None]
            ready = np.flatnonzero((hit.sum(1) >= k * ENOUGH) | whole)
            if len(ready):
                at = active[ready]
                some = np.flatnonzero(hit[ready].any(0))
                near = (queries[at] @ self.vectors[some].T) / (own[at, None] * self.norms[None, some])
                near[~hit[ready][:, some]] = -np.inf
                for i, row in zip(at, near, strict=True):
                    found[i] = best = self.best(queries[i], own[i], some, row, k)
                    if not whole and (len(best[0]) < k or 2 - 2 * best[1][-1] > width * width):
                        found[i] = None
            active = np.array([i for i in active if found[i] is None], int)
            width *= GROWTH
        return found

    def best(self, query: np.ndarray, own: float, some: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        count = int(np.isfinite(near).sum())
        if count > k:
            some = some[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9]
        else:
            some = some[np.isfinite(near)]
        # one fixed order of summing, so that equal vectors tie
        scores = (self.vectors[some] * query).sum(1) / (self.norms[some] * own)
        top = np.lexsort((self.ids[some], -scores))[:k]
        return self.ids[some][top], scores[top]


def _searched(k: int):
    """Rows come sorted by block, vectors before queries; a block is held at a time."""

    def answers(block: Block, asked: list) -> pa.RecordBatch:
        ids = np.array([i for i, _ in asked])
        found = block.search(ids, np.array([v for _, v in asked]), k)
        columns = [np.repeat(ids, [len(x) for x, _ in found]), np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, block, asked = None, [], [], None, []
        for batch in batches:
            part, is_query, vec_id, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "is_query", "vec_id", "dim"))
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dims)
            for i in range(batch.num_rows):
                key = (dims[i], part[i])
                if key != at:
                    if asked:
                        yield answers(block, asked)
                    at, ids, vectors, block, asked = key, [], [], None, []
                vector = flat[ends[i] - dims[i] : ends[i]]
                if not is_query[i]:
                    ids.append(vec_id[i])
                    vectors.append(vector)
                elif ids:
                    block = block or Block(np.array(ids), np.array(vectors))
                    asked.append((vec_id[i], vector))
                    if len(asked) == BATCH:
                        yield answers(block, asked)
                        asked = []
        if asked:
            yield answers(block, asked)

    return run


def valid(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part: an id, and finite components, not all zero."""
    value = F.col(embedding).cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = vectors.select(F.col(key).alias("vec_id"), value.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return found.where(F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def nearest(vectors: DataFrame, k: int = 5, is_query=None, key: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of every query among all other ids.

    Queries are the rows for which ``is_query`` holds (by default, ids divisible by 50). Vectors
    that are null, zero or hold null or non-finite components take no part; vectors are compared
    with those of their own length, at any magnitude. Only the two named columns are read. A repeated id counts once per distinct vector as a candidate
    and its first vector is the query. Fewer than k candidates give fewer rows, an empty table
    none. Blocks bound memory: every block is searched by every query, and the lists are merged.
    """
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    found = valid(vectors, key, embedding).dropDuplicates(["vec_id", "embedding"])
    sizes = {r["dim"]: r["count"] for r in found.groupBy("dim").count().collect()}  # one row per vector length
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cores = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    parts = {d: max(-(-n // block), min(cores, -(-n // 2048))) for d, n in sizes.items()}
    blocks = F.coalesce(*[F.when(F.col("dim") == d, F.lit(p)) for d, p in parts.items()])
    rows = found.select("vec_id", "embedding", "dim", F.pmod(F.xxhash64("vec_id", "embedding"), blocks).cast("int").alias("part"), F.lit(False).alias("is_query"))
    asked = found.where(is_query)
    first = asked.groupBy("vec_id", "dim").agg(F.min("embedding").alias("embedding"))
    asked = first.select("vec_id", "embedding", "dim", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"), F.lit(True).alias("is_query"))
    n = sum(parts.values())
    dealt = rows.unionByName(asked).repartition(n, "dim", "part").sortWithinPartitions("dim", "part", "is_query")
    hits = dealt.mapInArrow(_searched(k), SCHEMA)
    ranked = hits.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
