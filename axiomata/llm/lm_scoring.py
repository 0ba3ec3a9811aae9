"""Document scores by masked pseudo-likelihood.

A window network predicts every word from the words on both sides of it. The probability of a word
has two factors: that of its class given both sides, by the network, and the word's own share of
its class, from its count in the whole corpus. Frequent words are classes of their own; the others
share classes by their ending and length. A document's score is the sum over its words of the
logarithms of both.

1. Texts are gathered into batches, written once as compressed rows.
2. Batches send their distinct words with counts to buckets, which add them up and answer every
   batch with the corpus's counts of its words. So what is gathered grows with the corpus, and no
   table of words comes to the driver: only the words frequent enough for a class of their own.
3. The network starts from one batch; then every task trains over all its texts, and the tasks'
   networks are averaged by their words.
4. Batches and their answers meet, and documents are scored.

A word is a maximal run of bytes other than space and \\x09-\\x0D, with A-Z lower-cased, known by
a 64-bit number.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm import shingles
from axiomata.llm.exchange import GATHERED, NO_ID, REPLY, SENT, Batch, answers, by_batch, by_bucket, gathered, narrow, reply, sent, to_batches, to_buckets, widened
from axiomata.llm.tables import Scratch, table

#: Classes of words without one of their own; words seen on either side; sizes of the layers.
SHARED, SIDE, WIDTH, HIDDEN = 32, 2, 12, 24
#: A word has a class of its own if it is one of every OWN * log2(words of the corpus) words or more often; so there are never more such classes than that.
OWN = 100
#: Words of one batch that the network starts from; passes over them; step of training; words a step.
START, PASSES, STEP, TOGETHER = 200_000, 2, 0.05, 1024
#: Words scored by one matrix product.
ROWS = 8192
#: Bytes of text in a batch, and of text whose words one bucket counts.
BATCH, BUCKET = 8 << 20, 16 << 20
SEED = 20260105


class Words:
    """The words of a batch, in text order: number, shared class, and which text they are in."""

    def __init__(self, batch: Batch):
        ends = np.cumsum(batch.lengths)
        raw, n = batch.raw.tobytes(), len(batch.lengths)
        whole = np.frombuffer(b"\n".join([raw[a:b] for a, b in zip((ends - batch.lengths).tolist(), ends.tolist(), strict=True)]), np.uint8)
        first, last, self.number = shingles.words(whole)
        self.text = np.searchsorted(ends + np.arange(1, n + 1), first, "right")
        self.shared = shared_class(whole, first, last)


def shared_class(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The class of words that have none of their own, by their last two bytes and their length."""
    end = shingles.LOWER[raw[last - 1]].astype(np.int64)
    before = np.where(last - first > 1, shingles.LOWER[raw[np.maximum(last - 2, 0)]], 0).astype(np.int64)
    return ((before * 31 + end) * 5 + np.minimum(last - first, 12)) % SHARED


class Distinct:
    """The distinct words of a batch, by bucket and number; ``of`` gives each word's place among them."""

    def __init__(self, words: Words, buckets: int):
        key, one, of, count = np.unique(words.number, return_index=True, return_inverse=True, return_counts=True)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of, self.number, self.count, self.shared = place[of], key[order], count[order], words.shared[one][order]
        self.cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))


def _word_count(raw: bytes) -> int:
    return len(shingles.words(np.frombuffer(raw, np.uint8))[0])


def _sent(buckets: int):
    """Batches -> their distinct words, counts and shared classes for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, payload in zip(batch.column("batch").to_pylist(), batch.column("payload"), strict=True):
                mine = Distinct(Words(Batch.unpacked(payload.as_py())), buckets)
                full = np.flatnonzero(np.diff(mine.cuts))
                spans = [(int(mine.cuts[b]), int(mine.cuts[b + 1])) for b in full]
                blobs = [narrow(mine.number[i:j], 8) + narrow(mine.count[i:j], 4) + narrow(mine.shared[i:j], 1) for i, j in spans]
                yield sent(at, full, [j - i for i, j in spans], blobs)

    return run


COUNTS, FREQUENT, SUMS = 0, 1, 3
_SUMMARY = ["number", "n", "class"]


def _totalled(limit: float):
    """A bucket's words -> for each batch the corpus's counts of its words; words of ``limit`` or more; sums by shared class."""

    def summary(kind: int, number: np.ndarray, n: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(n), pa.int64()), pa.array([kind] * len(n), pa.int32()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(number.view(np.int64)), pa.array(n), pa.array(shared)], names=["batch", "kind", "bucket", "payload", *_SUMMARY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in by_bucket(batches):
            number = np.concatenate([widened(blob, 8, n) for _, n, blob in got])
            count = np.concatenate([widened(blob[8 * n :], 4, n) for _, n, blob in got])
            shared = np.concatenate([widened(blob[12 * n :], 1, n) for _, n, blob in got]).astype(np.int64)
            key, one, of = np.unique(number, return_index=True, return_inverse=True)
            total = np.bincount(of, count, len(key)).astype(np.int64)
            cuts = np.cumsum([0] + [n for _, n, _ in got])
            found = reply(COUNTS, bucket, [(at, total[of[i:j]].astype("<u8").tobytes()) for (at, _, _), i, j in zip(got, cuts[:-1], cuts[1:], strict=True)])
            nothing = [pa.nulls(found.num_rows, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*found.columns, *nothing], names=[*found.schema.names, *_SUMMARY])
            often = np.flatnonzero(total >= limit)
            yield summary(FREQUENT, key[often], total[often], shared[one[often]])
            sums = np.bincount(shared[one], total, SHARED).astype(np.int64)
            yield summary(SUMS, np.zeros(SHARED, np.uint64), sums, np.arange(SHARED))

    return run


class Vocabulary(NamedTuple):
    own: np.ndarray  # numbers of the words with classes of their own, sorted
    log_total: np.ndarray  # per class, the logarithm of how often its words occur

    def classes(self, number: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Shared classes come first, then those of single words."""
        if not len(self.own):
            return shared
        at = np.minimum(np.searchsorted(self.own, number), len(self.own) - 1)
        return np.where(self.own[at] == number, SHARED + at, shared)


def vocabulary(totals: DataFrame) -> Vocabulary:
    """From what buckets summed up: a bounded number of frequent words, and a sum per shared class."""
    found = sorted((r["number"] % 2**64, r["n"], r["class"]) for r in totals.where(F.col("kind") == FREQUENT).select(*_SUMMARY).collect())
    sums = np.zeros(SHARED + len(found))
    for r in totals.where(F.col("kind") == SUMS).groupBy("class").agg(F.sum("n").alias("n")).collect():
        sums[r["class"]] = r["n"]
    for k, (_, n, shared) in enumerate(found):
        sums[shared] -= n
        sums[SHARED + k] = n
    return Vocabulary(np.array([x for x, _, _ in found], np.uint64), np.log(np.maximum(sums, 1)))


def windows(classes: np.ndarray, text: np.ndarray, pad: int) -> np.ndarray:
    """For every word the classes of the SIDE words before and after it, ``pad`` beyond the ends of its text."""
    n = len(classes)
    out = np.full((n, 2 * SIDE), pad, np.int32)
    for column, k in enumerate(k for k in range(-SIDE, SIDE + 1) if k):
        a, b = slice(max(0, -k), min(n, n - k)), slice(max(0, k), min(n, n + k))
        out[a, column] = np.where(text[a] == text[b], classes[b], pad)
    return out


class Network:
    """Embeddings of the words on both sides, a hidden layer, a softmax over the classes."""

    names = ("embedding", "into", "bias", "out", "prior")

    def __init__(self, classes: int):
        rng = np.random.default_rng(SEED)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.classes = classes
        self.embedding = normal(classes + 1, WIDTH) * np.float32(3)
        self.into = normal(2 * SIDE * WIDTH, HIDDEN)
        self.bias = np.zeros(HIDDEN, np.float32)
        self.out = normal(HIDDEN, classes)
        self.prior = np.zeros(classes, np.float32)
        self.squares = {n: np.full(getattr(self, n).shape, 1e-6, np.float32) for n in self.names}

    def layers(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = np.take(self.embedding, around, axis=0).reshape(len(around), -1)
        hidden = np.tanh(seen @ self.into + self.bias)
        return seen, hidden, self.logits(hidden)

    def logits(self, hidden: np.ndarray) -> np.ndarray:
        raw = hidden @ self.out
        raw += self.prior
        if raw.max(initial=0) > 60 or raw.min(initial=0) < -60:  # else exponentials stay in range as they are
            raw -= raw.max(axis=1, keepdims=True)
        return raw

    def log_probability(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        # positions' shares of the hidden layer are looked up, which is the same product
        hidden = self.positions[0][around[:, 0]]
        for p in range(1, 2 * SIDE):
            hidden += np.take(self.positions[p], around[:, p], axis=0)
        hidden += self.bias
        raw = self.logits(np.tanh(hidden, out=hidden))
        own = raw[np.arange(len(target)), target]
        return own - np.log(np.exp(raw, out=raw) @ np.ones(self.classes, np.float32))

    def settle(self) -> Network:
        parts = self.into.reshape(2 * SIDE, WIDTH, HIDDEN)
        self.positions = [self.embedding @ parts[p] for p in range(2 * SIDE)]
        return self

    def passed(self, around: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over some words, by Adagrad."""
        order = rng.permutation(len(target))
        around, target = around[order], target[order]
        ones, width = np.ones(self.classes, np.float32), np.arange(WIDTH)
        for k in range(0, len(target), TOGETHER):
            near, own = around[k : k + TOGETHER], target[k : k + TOGETHER]
            seen, hidden, raw = self.layers(near)
            error = np.exp(raw, out=raw)
            error *= (np.float32(1 / len(own)) / (error @ ones))[:, None]
            error[np.arange(len(own)), own] -= np.float32(1 / len(own))
            back = error @ self.out.T
            back *= 1 - hidden * hidden
            wide = back @ self.into.T
            place = (near[:, :, None] * WIDTH + width).ravel()
            embedding = np.bincount(place, wide.ravel(), self.embedding.size).reshape(self.embedding.shape).astype(np.float32)
            slopes = {"embedding": embedding, "into": seen.T @ back, "bias": back.sum(0), "out": hidden.T @ error, "prior": np.ones(len(own), np.float32) @ error}
            for n in self.names:
                self.squares[n] += slopes[n] ** 2
                setattr(self, n, getattr(self, n) - np.float32(STEP) * slopes[n] / np.sqrt(self.squares[n]))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.names])

    def filled(self, flat: np.ndarray) -> Network:
        at = 0
        for n in self.names:
            was = getattr(self, n)
            setattr(self, n, flat[at : at + was.size].reshape(was.shape).astype(np.float32))
            at += was.size
        return self


_NUMBERS = "at long, sum double, n long"


def _trained(shared, start: bool):
    """Batches -> the numbers of a network after passes over their words, times how many words.

    To start, passes are over START words from everywhere in the batch; else over every word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, words = shared.value
        net, rng, total = copy.deepcopy(begun), np.random.default_rng(SEED + 2), 0
        for batch in batches:
            for payload in batch.column("payload"):
                mine = Words(Batch.unpacked(payload.as_py()))
                target = words.classes(mine.number, mine.shared)
                around = windows(target, mine.text, net.classes)
                if start:
                    step = max(1, len(target) // START)
                    around, target = around[::step], target[::step]
                for _ in range(PASSES if start else 1):
                    net.passed(around, target, rng)
                total += len(target)
        if total:
            flat = net.flat().astype(np.float64) * total
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), total))], names=["at", "sum", "n"])

    return run


def trained(texts: DataFrame, words: Vocabulary) -> Network:
    """A network of all words of all batches."""
    net = Network(len(words.log_total))
    net.prior = (words.log_total - np.log(np.exp(words.log_total).sum())).astype(np.float32)
    first = texts.agg(F.min("batch")).first()[0]
    if first is None:
        return net.settle()
    for start, some in ((True, texts.where(F.col("batch") == first)), (False, texts)):
        given = texts.sparkSession.sparkContext.broadcast((net, words))
        each = some.select("payload").mapInArrow(_trained(given, start), _NUMBERS)
        got = each.groupBy("at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).orderBy("at").toArrow()  # as many rows as the network has numbers
        if got.num_rows:  # rounded, so that the order of a sum doesn't show
            net = copy.deepcopy(net).filled(np.round(got["sum"].to_numpy() / got["n"].to_numpy(), 6))
    return net.settle()


def word_scores(net: Network, words: Vocabulary, mine: Words, count: np.ndarray) -> np.ndarray:
    """Per word of a batch, the logarithm of its probability given both sides; ``count`` is its count in the corpus."""
    target = words.classes(mine.number, mine.shared)
    around = windows(target, mine.text, net.classes)
    each = [net.log_probability(around[i : i + ROWS], target[i : i + ROWS]) for i in range(0, len(target), ROWS)]
    return np.concatenate([np.empty(0), *each]) + np.log(count) - words.log_total[target]


def _scored(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, words = shared.value
        for _, texts, replies in by_batch(batches):
            mine = Words(texts)
            count = answers(replies, COUNTS, "<u8")[Distinct(mine, buckets).of]
            n = np.bincount(mine.text, minlength=len(texts.ids))
            sums = np.bincount(mine.text, word_scores(net, words, mine, count), len(texts.ids)).astype(np.float64)
            means = pa.array(sums / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([pa.array(texts.ids, mask=texts.ids == NO_ID), pa.array(n), pa.array(sums), means], names=["doc_id", "n_words", "sum_log_prob", "mean_log_prob"])

    return run


class Fitted(NamedTuple):
    """Batches of the texts, their number, the buckets' answers, and what scores them."""

    texts: DataFrame
    n: int
    totals: DataFrame
    buckets: int
    net: Network
    words: Vocabulary


def fitted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Fitted:
    scratch = Scratch(docs.sparkSession, "scoring")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(None).cast("string").alias("carried"))
    texts = scratch.keep(docs.mapInArrow(gathered(BATCH, _word_count), GATHERED))
    n, total = texts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(12, -(-n * BATCH // BUCKET))
    limit = total / (OWN * np.log2(total + 2))
    counted = to_buckets(texts.mapInArrow(_sent(buckets), SENT), buckets)
    totals = scratch.keep(counted.mapInArrow(_totalled(limit), REPLY + ", number long, n long, class long"))
    words = vocabulary(totals)
    return Fitted(texts, n, totals, buckets, trained(texts, words), words)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, sum_log_prob, mean_log_prob for every row of ``docs``.

    Only key and text are read. A null text, or one without words, has no words, a sum of 0 and a
    null mean. Texts of any length are counted, learnt from and scored whole; equal texts have
    equal scores but for rounding; an empty table gives an empty result.
    """
    made = fitted(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast((made.net, made.words))
    met = to_batches(made.texts, made.n, made.totals.where(F.col("kind") == COUNTS).select("batch", "kind", "bucket", "payload"), each=2)
    return met.mapInArrow(_scored(shared, made.buckets), "doc_id long, n_words long, sum_log_prob double, mean_log_prob double")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents", "doc_id", "text"))
