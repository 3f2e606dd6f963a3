"""State over streams: an as-of join that waits for late rows, and rows told apart within a span of time.

Both run on a stream with transformWithState, and on a table as the batch result that the stream comes to
when all its rows were in time. State lies by key in the RocksDB store, which sessions that run these must name:

    spark.conf.set(*stateful.STORE)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ROW = StructType([StructField("at", LongType()), StructField("id", LongType())])


class AsofProcessor(StatefulProcessor):
    """Rows of both sides wait until the watermark has passed a left row's time; then its right row is known, and older right rows but the last are let go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getMapState("left", "id long, at long", "at long")
        self.right = handle.getMapState("right", "id long, at long", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            for side, row_id, at in zip(pdf.side, pdf.row_id, pdf["at"], strict=True):
                at, row_id = int(at), int(row_id)
                # What is late could change what was said already.
                if at < mark:
                    continue
                (self.left if side == 0 else self.right).updateValue((row_id, at), (at,))
                if side == 0:
                    self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        rights = sorted((r[1], r[0]) for r in self.right.keys())
        best = max((r for r in rights if r[0] <= at), default=None)
        ready = sorted(x[0] for x in self.left.keys() if x[1] == at)
        for row_id in ready:
            self.left.removeKey((row_id, at))
        if best is not None:
            for r in rights:
                if r < best:
                    self.right.removeKey((r[1], r[0]))
        if ready:
            yield pd.DataFrame({"key": [key[0]] * len(ready), "left_id": ready, "right_id": pd.array([best[1] if best else None] * len(ready), dtype="Int64"), "right_at": pd.array([best[0] if best else None] * len(ready), dtype="Int64")})

    def close(self) -> None:
        pass


class FirstProcessor(StatefulProcessor):
    """The first row of each key is passed on; others of it that are no more than a span behind it are not."""

    def __init__(self, span_ms: int):
        self.span = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        own = sorted((int(at), int(i)) for pdf in rows for i, at in zip(pdf.row_id, pdf["at"], strict=True) if int(at) >= mark)
        if own and not self.seen.exists():
            self.seen.update((own[0][0],))
            self.handle.registerTimer(own[0][0] + self.span)
            yield pd.DataFrame({"key": [key[0]], "row_id": [own[0][1]], "at": [own[0][0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def _millis(ts: str) -> F.Column:
    return F.unix_millis(F.col(ts).cast("timestamp")).alias("at")


def asof(left: DataFrame, right: DataFrame, key: str, row_id: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, left_id, right_id, right_at): each left row with the last right row of its key that isn't later (ties: the largest id); nulls where there is none.

    On streams a left row comes out when the watermark, late behind the newest time seen, has passed it, so rows that arrive in any order within that
    give the batch result; rows that are later are left out. Times are in milliseconds. Rows with a null key, id or time are left out. State holds the left rows
    that wait, and of right rows those from the last one before the watermark on.
    """
    sides = [df.select(F.col(key).alias("key"), F.col(row_id).cast("long").alias("row_id"), F.lit(side).alias("side"), F.col(ts).cast("timestamp").alias("ts")).filter("key is not null and row_id is not null and ts is not null") for side, df in enumerate((left, right))]
    if not left.isStreaming and not right.isStreaming:
        both = sides[0].unionByName(sides[1]).withColumn("at", _millis("ts"))
        w = Window.partitionBy("key").orderBy("at", F.desc("side"), "row_id").rowsBetween(Window.unboundedPreceding, 0)
        met = both.withColumn("r", F.last(F.when(F.col("side") == 1, F.struct("row_id", "at")), ignorenulls=True).over(w)).filter("side = 0")
        return met.select("key", F.col("row_id").alias("left_id"), F.col("r.row_id").alias("right_id"), F.col("r.at").alias("right_at"))
    both = sides[0].unionByName(sides[1]).withWatermark("ts", late).withColumn("at", _millis("ts"))
    kind = left.schema[key].dataType.simpleString()
    schema = f"key {kind}, left_id long, right_id long, right_at long"
    return both.groupBy("key").transformWithStateInPandas(AsofProcessor(), schema, "append", "eventTime")


def first_within(events: DataFrame, key: str, row_id: str, span_ms: int, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, row_id, at): of rows of a key that follow its first one by no more than a span, that first one only.

    On a stream the first is the first to arrive, as it is passed on at once; rows that are later than the watermark are left out, and a key is new again when
    the watermark has passed the span. On a table the first by time (ties: the smallest id) starts each span. Rows with nulls are left out.
    """
    own = events.select(F.col(key).alias("key"), F.col(row_id).cast("long").alias("row_id"), F.col(ts).cast("timestamp").alias("ts")).filter("key is not null and row_id is not null and ts is not null")
    kind = events.schema[key].dataType.simpleString()
    if events.isStreaming:
        seen = own.withWatermark("ts", late).withColumn("at", _millis("ts"))
        return seen.groupBy("key").transformWithStateInPandas(FirstProcessor(span_ms), f"key {kind}, row_id long, at long", "append", "eventTime")
    rows = F.array_sort(F.collect_list(F.struct(_millis("ts"), "row_id")))
    start = F.array().cast("array<struct<at: bigint, row_id: bigint>>")
    begun = F.aggregate(rows, start, lambda a, r: F.when((F.size(a) > 0) & (r["at"] - F.element_at(a, -1)["at"] <= span_ms), a).otherwise(F.array_append(a, r)))
    return own.groupBy("key").agg(begun.alias("firsts")).select("key", F.explode("firsts").alias("f")).select("key", "f.row_id", "f.at")
