"""The token bucket as a stateful stream operator, with idle buckets dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from axiomata.operators.limiter import Bucket

#: Dropping a bucket is neutral once it would be full again.
IDLE_MS = 600_000


def limited(requests: DataFrame, key: str, ts: str, tie: str, rate: float, burst: float, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Key, tie and ``allowed`` of streamed requests; within a micro-batch in time order.

    Idle buckets are dropped after ``idle_ms``, for which the stream runs batches without data; a
    query that is to end when its input is used up takes None.
    """
    rows = requests.select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).cast("long").alias("i"))

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(rate, burst)
        if state.exists:
            bucket.tokens, bucket.at = state.get
        batch = pd.concat(list(parts)).sort_values(["t", "i"])
        batch["allowed"] = [bucket.allow(t) for t in batch["t"].tolist()]
        state.update((bucket.tokens, bucket.at))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield batch[["k", "i", "allowed"]]

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("k").applyInPandasWithState(run, "k string, i long, allowed boolean", "tokens double, at long", "append", timeout)
