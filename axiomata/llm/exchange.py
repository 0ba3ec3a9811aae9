"""Batches of whole texts, and packed answers that travel between batches and buckets.

A corpus is gathered into batches, written once as compressed rows. A batch sends each bucket one
row of packed numbers; a bucket answers every batch with one row, in the order of what it got; the
answers are dealt to the batches again. So copies shrink before each exchange, and no row stands
for a single word or string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Null ids come after all others.
NO_ID = np.iinfo(np.int64).max
#: Kind of the rows that hold texts; answers have smaller ones.
TEXTS = 2
GATHERED = "batch long, size long, payload binary"
SENT = "bucket int, batch long, n int, blob binary"
REPLY = "batch long, kind int, bucket int, payload binary"


def narrow(x: np.ndarray, width: int) -> bytes:
    """Unsigned numbers in ``width`` bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(raw: bytes, width: int, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    return wide.view("<u8").ravel()


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids as distances from the smallest, as narrow as they go."""
    low = int(ids.min()) if len(ids) else 0
    far = (ids.astype(np.int64) - low).astype(np.uint64)
    most = int(far.max()) if len(ids) else 0
    width = next(w for w in (1, 2, 3, 4, 6, 8) if most < 256**w)
    return np.array([low, width], "<i8").tobytes() + narrow(far, width)


def unpacked_ids(raw: bytes, n: int) -> np.ndarray:
    low, width = np.frombuffer(raw, "<i8", 2).tolist()
    return (widened(raw[16:], width, n).astype(np.int64) + low).astype(np.int64)


class Batch:
    """Some whole texts: ids, lengths and bytes, and what else their rows carry."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, raw: bytes, carried: np.ndarray, more: bytes):
        self.ids, self.lengths, self.raw = ids, lengths, np.frombuffer(raw, np.uint8)
        self.carried, self.more = carried, more

    def packed(self) -> bytes:
        head = np.concatenate([[len(self.ids)], self.ids, self.lengths, self.carried]).astype("<i8").tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + self.more + self.raw.tobytes())

    @classmethod
    def unpacked(cls, payload: bytes) -> Batch:
        raw = zstandard.ZstdDecompressor().decompress(payload)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        ids, lengths, carried = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
        text = 8 + 24 * n + int(carried.sum())
        return cls(ids, lengths, raw[text:], carried, raw[8 + 24 * n : text])


def gathered(batch_bytes: int, measure: Callable[[bytes], int] | None = None):
    """Rows (doc_id, text, carried) -> batches of about ``batch_bytes``; a text is never cut.

    ``size`` is the sum of ``measure`` over the texts, by default their bytes and some for each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, texts, more, held, size = TaskContext.get().partitionId() << 32, [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            sizes = [np.array([len(t) for t in x], np.int64) for x in (texts, more)]
            made = Batch(np.array(ids, np.int64), sizes[0], b"".join(texts), sizes[1], b"".join(more))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([size], pa.int64()), pa.array([made.packed()], pa.binary())], names=["batch", "size", "payload"])

        for batch in batches:
            for key, text, rest in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("carried"), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                ids.append(NO_ID if key is None else key)
                texts.append(raw)
                more.append((rest.as_py() or "").encode())
                held += len(raw) + 16
                size += measure(raw) if measure else len(raw) + 16
                if held >= batch_bytes:
                    yield row()
                    at, ids, texts, more, held, size = at + 1, [], [], [], 0, 0
        if ids:
            yield row()

    return run


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Rows of SENT sorted by bucket -> (bucket, its (batch, n, blob))."""
    at, got = None, []
    for batch in batches:
        for bucket, *rest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "batch", "n", "blob")), strict=True):
            if bucket != at and got:
                yield at, got
                got = []
            at = bucket
            got.append(tuple(rest))
    if got:
        yield at, got


def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Batch, list[tuple[int, int, bytes]]]]:
    """Rows of REPLY sorted by batch and kind -> (batch, texts, its answers as (kind, bucket, payload))."""
    replies: list[tuple[int, int, bytes]] = []
    for batch in batches:
        for at, kind, bucket, payload in zip(*(batch.column(c).to_pylist() for c in ("batch", "kind", "bucket")), batch.column("payload"), strict=True):
            if kind < TEXTS:
                replies.append((kind, bucket, payload.as_py()))
            else:
                yield at, Batch.unpacked(payload.as_py()), replies
                replies = []


def sent(at: int, buckets: np.ndarray, sizes: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(buckets, pa.int32()), pa.array([at] * len(blobs), pa.int64()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "batch", "n", "blob"])


def reply(kind: int, bucket: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    press = zstandard.ZstdCompressor(level=1).compress
    columns = [pa.array([b for b, _ in rows], pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array([press(x) for _, x in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["batch", "kind", "bucket", "payload"])


def answers(replies: list[tuple[int, int, bytes]], kind: int, dtype: str) -> np.ndarray:
    """The answers of one kind, in the order of the buckets."""
    press = zstandard.ZstdDecompressor().decompress
    mine = sorted((b, x) for k, b, x in replies if k == kind)
    return np.concatenate([np.frombuffer(press(x), dtype) for _, x in mine]) if mine else np.empty(0, dtype)


def to_buckets(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def to_batches(texts: DataFrame, n: int, *replies: DataFrame, each: int = 4) -> DataFrame:
    """Texts with their answers, about ``each`` of ``n`` batches a task."""
    rows = texts.select("batch", F.lit(TEXTS).alias("kind"), F.lit(0).alias("bucket"), "payload")
    for r in replies:
        rows = rows.unionByName(r)
    return rows.repartition(max(12, -(-n // each)), "batch").sortWithinPartitions("batch", "kind")
