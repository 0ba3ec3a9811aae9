"""Removal of long repeated passages through run-length compressed suffix indexes.

A window is LENGTH bytes of a text; a byte goes if a window that covers it also starts in a
document with a smaller id. One index over a corpus doesn't fit any machine, so windows are dealt
out first by content. Of the GRAM-byte strings in a window the one with the smallest hash is its
anchor; equal windows have equal anchors at the same place, and the windows that share an anchor
form a context of at most 2 * LENGTH - GRAM bytes.

1. Texts are gathered into batches, written once as compressed rows.
2. Every batch sends each distinct (anchor, context hash) with its smallest document to the bucket
   of the anchor. Most contexts end there: unique, or equal to one in a smaller document.
3. Where contexts of an anchor differ, as at the ends of a repeat, the smallest document of each
   sends its bytes. Their bucket builds a run-length compressed Burrows-Wheeler transform over
   them, sampled at both ends of each run. From these samples alone it streams matching statistics: how long the match with the neighbour in suffix order is, and
   where that is. Matches of LENGTH chain the windows that are equal, and mark those that occur in
   a smaller document.
4. Batches turn both answers into removed bytes.

An anchor with very many contexts, as a common phrase has, would put them all into one bucket.
Its windows are dealt out each by its own hash, as anchors with one context.

Everything is exchanged as packed arrays, copies shrink to one row per batch before each exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm.exchange import GATHERED, NO_ID, REPLY, SENT, Batch, answers, by_batch, by_bucket, gathered, narrow, packed_ids, reply, sent, to_batches, to_buckets, unpacked_ids, widened
from axiomata.llm.shingles import mixed
from axiomata.llm.tables import Scratch, table

LENGTH, GRAM = 50, 22
#: Bytes of text in a batch, hashed together, and behind one bucket.
BATCH, STRETCH, BUCKET = 4 << 20, 1 << 20, 8 << 20
#: An anchor is hot from so many contexts, and from one of so many of all; there are never more hot ones than that. A batch reports anchors from LOCAL contexts.
HOT, HOT_PART, LOCAL = 50_000, 1_000_000, 4

_rng = np.random.default_rng(20260104)
_VALUE = _rng.integers(0, 2**64, 256, np.uint64)
_BASE, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_UP, _DOWN = (np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(STRETCH + 4 * LENGTH, b))]) for b in (_BASE, _BACK))
_LOCAL = np.uint64((1 << 24) - 1)
NO_HOT = np.empty(0, np.uint64)


class Anchors:
    """The anchors of a batch of texts, in text order: windows first..last share one."""

    def __init__(self, raw: np.ndarray, lengths: np.ndarray, hot: np.ndarray = NO_HOT, length: int = LENGTH, gram: int = GRAM):
        ends = np.cumsum(lengths)
        closed = np.zeros(len(raw) + 1, np.int32)  # windows that would leave their text
        np.add.at(closed, np.maximum(ends - length + 1, ends - lengths), 1)
        np.add.at(closed, ends, -1)
        closed = np.cumsum(closed) > 0
        parts = [self._stretch(raw, closed, at, length, gram) for at in range(0, len(raw), STRETCH)]
        parts = [p for p in parts if p is not None]
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
        self.first, self.last, self.key, self.context = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty
        if len(hot):
            self._apart(raw, np.isin(self.key, hot), length)
        self.doc = np.searchsorted(ends, self.first, "right")

    @staticmethod
    def _stretch(raw, closed, at, length, gram):
        part = raw[at : at + STRETCH + length - 1]
        starts = np.flatnonzero(~closed[at : at + min(STRETCH, max(0, len(part) - length + 1))])
        if not len(starts):
            return None
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * _UP[: len(part)], out=sums[1:])
        n = len(part) - gram + 1
        hashes = mixed((sums[gram:] - sums[:-gram]) * _DOWN[:n])
        lowest = (hashes & ~_LOCAL) | np.arange(n, dtype=np.uint64)
        width, step = length - gram + 1, 1
        while 2 * step <= width:
            lowest = np.minimum(lowest[:-step], lowest[step:])
            step *= 2
        if step < width:
            lowest = np.minimum(lowest[: step - width], lowest[width - step :])
        anchor = (lowest[starts] & _LOCAL).astype(np.int64)
        turn = np.flatnonzero((anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
        head, tail = np.concatenate([[0], turn]), np.concatenate([turn, [len(starts)]]) - 1
        first, last, anchor = starts[head], starts[tail], anchor[head]
        context = (sums[last + length] - sums[first]) * _DOWN[first] + ((last - first) * 64 + (anchor - first)).astype(np.uint64)
        return first + at, last + at, mixed(hashes[anchor] + np.uint64(1)) >> np.uint64(24), mixed(context) >> np.uint64(16)

    def _apart(self, raw: np.ndarray, hot: np.ndarray, length: int) -> None:
        """Windows of hot anchors become anchors of their own, named by their hash."""
        times = (self.last - self.first + 1)[hot]
        window = np.repeat(self.first[hot] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        own = np.zeros(len(window), np.uint64)
        for k in range(length):
            own += _VALUE[raw[window + k]] * _UP[k]
        key, context = mixed(own + np.uint64(2)) >> np.uint64(24), mixed(own + np.uint64(3)) >> np.uint64(16)
        columns = [(self.first, window), (self.last, window), (self.key, key), (self.context, context)]
        joined = [np.concatenate([old[~hot], new]) for old, new in columns]
        order = np.argsort(joined[0], kind="stable")
        self.first, self.last, self.key, self.context = (x[order] for x in joined)


def busy(anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """(anchors with LOCAL contexts or more in a batch, how many)."""
    order = np.lexsort((anchors.context, anchors.key))
    k, c = anchors.key[order], anchors.context[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    key, n = np.unique(k[new], return_counts=True)
    return key[n >= LOCAL], n[n >= LOCAL]


def _busy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column("payload"):
            texts = Batch.unpacked(payload.as_py())
            key, n = busy(Anchors(texts.raw, texts.lengths))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])


def hot_anchors(texts: DataFrame, size: int, least: int = HOT) -> np.ndarray:
    """Anchors that would overload a bucket; HOT_PART of them at most."""
    least = max(least, size // 16 // HOT_PART)
    found = texts.select("payload").mapInArrow(_busy, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["key"] for r in found.select("key").collect()], np.int64).view(np.uint64))


class Rows:
    """The distinct (bucket, anchor, context) of a batch, each with its smallest document."""

    def __init__(self, anchors: Anchors, ids: np.ndarray, buckets: int):
        doc = ids[anchors.doc]
        bucket = (anchors.key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((doc, anchors.context, anchors.key, bucket))
        b, k, c = bucket[order], anchors.key[order], anchors.context[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.one = order[new]  # an anchor in the smallest document
        self.bucket, self.key, self.context, self.doc = b[new], k[new], c[new], doc[order][new]
        self.cuts = np.searchsorted(self.bucket, np.arange(buckets + 1))


def pack_rows(key: np.ndarray, context: np.ndarray, doc: np.ndarray) -> bytes:
    return narrow(key, 5) + narrow(context, 6) + packed_ids(doc)


def unpack_rows(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return widened(raw, 5, n), widened(raw[5 * n :], 6, n), unpacked_ids(raw[11 * n :], n)


def _sent(buckets: int, hot):
    """Batches -> a blob of rows for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, payload in zip(batch.column("batch").to_pylist(), batch.column("payload"), strict=True):
                texts = Batch.unpacked(payload.as_py())
                rows = Rows(Anchors(texts.raw, texts.lengths, hot.value), texts.ids, buckets)
                full = np.flatnonzero(np.diff(rows.cuts))
                spans = [(int(rows.cuts[b]), int(rows.cuts[b + 1])) for b in full]
                yield sent(at, full, [j - i for i, j in spans], [pack_rows(rows.key[i:j], rows.context[i:j], rows.doc[i:j]) for i, j in spans])

    return run


UNIQUE, COVERED, DIFFERS = 0, 1, 2


def statuses(key: np.ndarray, context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For the rows of a bucket: COVERED by the same context in a smaller document; or the first of several contexts of its anchor."""
    order = np.lexsort((doc, context, key))
    k, c, d = key[order], context[order], doc[order]
    n = len(order)
    new_key = np.ones(n, bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= c[1:] != c[:-1]
    lowest = d[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    group = np.cumsum(new_key) - 1
    contexts = np.bincount(group, new)
    out = np.empty(n, np.uint8)
    out[order] = np.where(d > lowest, COVERED, np.where(contexts[group] > 1, DIFFERS, UNIQUE))
    return out


#: Kinds of answers: statuses of contexts, and windows marked in contexts that differ.
STATUS, MARKED = 0, 1


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, got in by_bucket(batches):
        parts = [unpack_rows(blob, n) for _, n, blob in got]
        found = statuses(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        cuts = np.cumsum([0] + [n for _, n, _ in got])
        yield reply(STATUS, bucket, [(at, found[i:j].tobytes()) for (at, _, _), i, j in zip(got, cuts[:-1], cuts[1:], strict=True)])


def suffix_order(text: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """All places of some texts in the order of the suffixes that start there; each ends with its text, and of equal ones the earlier text's comes first."""
    n, depth = len(text), 7
    left = (np.repeat(np.cumsum(widths), widths) - np.arange(n)).astype(np.int32)  # bytes to the end of the own text
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key = (key << np.uint64(8)) | np.where(left > k, padded[k : k + n], 0).astype(np.uint64)
    key = (key << np.uint64(8)) | np.minimum(left, depth).astype(np.uint64)
    longest = int(widths.max(initial=0))
    while depth < longest:
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint32)
        key = rank.astype(np.uint64)
        key <<= np.uint64(32)
        inside = np.flatnonzero(left > depth)
        key[inside] |= rank[inside + depth] + np.uint64(1)
        depth *= 2
    return np.argsort(key, kind="stable")


class RunIndex:
    """A run-length compressed Burrows-Wheeler transform over some contexts, sampled at the ends of its runs.

    A run is a stretch of suffixes, in their order, that the same byte precedes; a context's start
    is preceded by an end of its own, so it is a run alone. Kept of each run are the places in the
    text of its first and last suffix, which is all that matching needs; of the suffix order
    nothing else is kept.
    """

    END = 256

    def __init__(self, text: np.ndarray, widths: np.ndarray):
        self.text, self.widths = text, widths
        order = suffix_order(text, widths).astype(np.int32)
        self.opens = np.cumsum(widths) - widths
        before = np.roll(text.astype(np.int16), 1)
        before[self.opens[widths > 0]] = self.END
        before = before[order]
        heads = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == self.END)])[: len(order)])
        self.run_head = order[heads]
        self.run_end = order[np.append(heads[1:], len(order))[: len(heads)] - 1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes at ``a`` and ``b``."""
        ends = np.repeat(np.cumsum(self.widths), self.widths).astype(np.int32)
        most = np.minimum(ends[a] - a, ends[b] - b)
        out = np.zeros(len(a), np.int32)
        alive = np.flatnonzero(most > 0)
        while len(alive):
            same = self.text[a[alive] + out[alive]] == self.text[b[alive] + out[alive]]
            alive = alive[same]
            out[alive] += 1
            alive = alive[out[alive] < most[alive]]
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place, streamed through the text: where the suffix before it in suffix order starts, and their common length.

        Between runs that is known from the samples: the last suffix of one run comes before the
        first of the next. Within a run the neighbours are preceded by the same byte, so both
        neighbours of the place one byte earlier have moved on by one, and match one byte less.
        """
        n = len(self.text)
        places = np.arange(n, dtype=np.int32)
        before, length = places.copy(), np.zeros(n, np.int32)
        at, source = self.run_head[1:], self.run_end[:-1]
        before[at], length[at] = source, self.common(at, source)
        near = np.zeros(n, np.int32)
        near[self.run_head] = self.run_head
        near = np.maximum.accumulate(near)
        moved = places - near
        return before[near] + moved, length[near] - moved


def covered_windows(text: np.ndarray, widths: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Per context, a bit for each of its windows that occurs in one of a smaller document."""
    index = RunIndex(text, widths)
    before, matched = index.matching_statistics()
    n = len(text)
    first = np.where(matched >= length, before, np.arange(n, dtype=np.int32))
    del before, matched
    while True:  # along the chain of equal windows to its first
        jump = first[first]
        if (jump == first).all():
            break
        first = jump
    owner = np.repeat(np.arange(len(widths), dtype=np.int32), widths)
    open_ = np.flatnonzero(np.arange(n) - index.opens[owner] + length <= widths[owner])
    lowest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(lowest, first[open_], doc[owner[open_]])
    hit = open_[lowest[first[open_]] < doc[owner[open_]]]
    out = np.zeros(len(widths), np.uint64)
    np.bitwise_or.at(out, owner[hit], np.uint64(1) << (hit - index.opens[owner[hit]]).astype(np.uint64))
    return out


def _literal(buckets: int, hot):
    """Batches and statuses -> for each bucket, the bytes of contexts that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, texts, replies in by_batch(batches):
            anchors = Anchors(texts.raw, texts.lengths, hot.value)
            rows = Rows(anchors, texts.ids, buckets)
            status = answers(replies, STATUS, "u1")
            some = np.flatnonzero(status == DIFFERS)
            cuts = np.searchsorted(rows.bucket[some], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            ns, blobs = [], []
            for b in full:
                one = rows.one[some[cuts[b] : cuts[b + 1]]]
                first, widths = anchors.first[one], anchors.last[one] - anchors.first[one] + LENGTH
                at_byte = np.repeat(first - (np.cumsum(widths) - widths), widths) + np.arange(widths.sum())
                blobs.append(_literals(widths, texts.raw[at_byte], texts.ids[anchors.doc[one]]))
                ns.append(len(one))
            if len(full):
                yield sent(at, full, ns, blobs)

    return run


def _literals(widths: np.ndarray, raw: np.ndarray, doc: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(widths.astype("<u1").tobytes() + raw.tobytes() + packed_ids(doc))


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, got in by_bucket(batches):
        texts, widths, docs = [], [], []
        for _, n, blob in got:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            w = np.frombuffer(raw, "<u1", n).astype(np.int64)
            size = int(w.sum())
            widths.append(w)
            texts.append(np.frombuffer(raw, np.uint8, size, n))
            docs.append(unpacked_ids(raw[n + size :], n))
        bits = covered_windows(np.concatenate(texts), np.concatenate(widths), np.concatenate(docs))
        cuts = np.cumsum([0] + [n for _, n, _ in got])
        yield reply(MARKED, bucket, [(at, bits[i:j].astype("<u4").tobytes()) for (at, _, _), i, j in zip(got, cuts[:-1], cuts[1:], strict=True)])


def removed(texts: Batch, buckets: int, hot: np.ndarray, status: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bytes of a batch go."""
    anchors = Anchors(texts.raw, texts.lengths, hot)
    rows = Rows(anchors, texts.ids, buckets)
    change = np.zeros(len(texts.raw) + 1, np.int32)
    mask = np.zeros(len(status), np.uint32)
    mask[status == DIFFERS] = bits
    later = texts.ids[anchors.doc] > rows.doc[rows.of]
    whole = later | (status[rows.of] == COVERED)
    np.add.at(change, anchors.first[whole], 1)
    np.add.at(change, anchors.last[whole] + LENGTH, -1)
    some = np.flatnonzero(~whole & (mask[rows.of] != 0))
    for k in range(LENGTH - GRAM + 1):
        at = anchors.first[some[(mask[rows.of[some]] >> np.uint32(k)) & np.uint32(1) == 1]] + k
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _finished(buckets: int, hot, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, replies in by_batch(batches):
            gone = removed(texts, buckets, hot.value, answers(replies, STATUS, "u1"), answers(replies, MARKED, "<u4"))
            ends, rest = np.cumsum(texts.lengths), np.cumsum(texts.carried)
            out: list[list] = [[], [], [], [], [], [], []]
            for key, a, b, c, d in zip(texts.ids.tolist(), (ends - texts.lengths).tolist(), ends.tolist(), (rest - texts.carried).tolist(), rest.tolist(), strict=True):
                drop = gone[a:b]
                kept = texts.raw[a:b][~drop].tobytes()
                spans = int(drop[:1].sum() + (drop[1:] & ~drop[:-1]).sum())
                values = (None if key == NO_ID else key, b - a, int(drop.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None, texts.more[c:d].decode())
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "carried"]
            n = 7 if with_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)][:n], names=names[:n])

    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, hot_from: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text and the other columns) for every row of ``docs``.

    Only key and text are read. A null text is empty. A null doc_id counts as larger than all
    others. Rows that repeat a doc_id don't shorten each other. kept_text leaves out bytes of
    characters that a removed run has cut. Texts of any length are taken whole, in one batch
    each at least; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    others = [c for c in docs.columns if c not in (key, text)]
    carried = F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])) if with_text and others else F.lit(None).cast("string")
    kinds = docs.select(*[f"`{c}`" for c in others]).schema
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), carried.alias("carried"))
    texts = scratch.keep(docs.mapInArrow(gathered(BATCH), GATHERED))
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(12, -(-size // BUCKET))
    hot = spark.sparkContext.broadcast(hot_anchors(texts, size, hot_from))
    judged = scratch.keep(to_buckets(texts.mapInArrow(_sent(buckets, hot), SENT), buckets).mapInArrow(_judged, REPLY))
    resolved = scratch.keep(to_buckets(to_batches(texts, n, judged).mapInArrow(_literal(buckets, hot), SENT), buckets).mapInArrow(_resolved, REPLY))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string, carried string" if with_text else "")
    done = to_batches(texts, n, judged, resolved).mapInArrow(_finished(buckets, hot, with_text), schema)
    if not with_text:
        return done
    done = done.withColumn("carried", F.from_json("carried", kinds) if others else F.struct())
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *[F.col(f"carried.`{c}`") for c in others])


def op1_repeat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
