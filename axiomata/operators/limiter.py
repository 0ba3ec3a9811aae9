"""A token bucket per key over requests in time order.

A bucket starts full, gains ``rate`` tokens a second up to ``burst``, and a request takes one or
is denied. Tasks stream their keys' requests in order and hold one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRY_AFTER = 60


def per_minute(rpm: float = 60, burst: float = 0) -> tuple[float, float]:
    """(tokens a second, burst) of a setting; unset values fall back to 60, and burst to the rate."""
    rpm = rpm if rpm > 0 else 60
    return rpm / 60, burst if burst > 0 else rpm


def exempt(path: Column, role: Column, prefix: str = "/api/", privileged: bool = True) -> Column:
    """Requests that aren't limited: outside ``prefix``, or of the privileged role if that is spared."""
    outside = ~path.startswith(prefix) if prefix else F.lit(False)
    return outside | (F.lit(privileged) & F.coalesce(role == "privileged", F.lit(False)))


class Bucket:
    def __init__(self, rate: float, burst: float):
        self.rate, self.burst, self.tokens, self.at = rate, float(burst), float(burst), None

    def allow(self, micros: int) -> bool:
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + (micros - self.at) / 1e6 * self.rate)
        self.at = micros
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


def limited(requests: DataFrame, key: str, ts: str, tie: str, rate: float, burst: float, exempt: Column | None = None) -> DataFrame:
    """``requests`` with ``allowed``; exempt ones pass and take nothing. Ties in time go by ``tie``."""
    free = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    rows = requests.withColumn("_free", free)
    bound = rows.where(~F.col("_free"))
    ordered = bound.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).alias("i")).repartition("k").sortWithinPartitions("k", "t", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = object(), None
        for batch in batches:
            out = []
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if k != at:
                    at, bucket = k, Bucket(rate, burst)
                out.append(bucket.allow(t))
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(out, pa.bool_())], names=["i", "allowed"])

    kind = dict(requests.dtypes)[tie]
    decided = ordered.mapInArrow(run, f"i {kind}, allowed boolean")
    joined = rows.join(decided, rows[tie] == decided.i, "left")
    return joined.select(*[rows[c] for c in requests.columns], F.coalesce("allowed", F.lit(True)).alias("allowed"))
