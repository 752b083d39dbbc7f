"""Segments on a stream: runs of equal values of each key, closed as they end, whatever the order in which rows come.

A segment ends where the value changes, after `most` rows, and when no row of its key follows within `idle` of event time. Rows wait
in state until the watermark has passed them and then count in the order of time and place, so the result does not depend on how they
came, on how micro-batches were cut, or on restarts. State of a key: the rows that wait, and one open segment.

`segments.runs` is the same on a table, but for `idle`.

Results for odd input: rows later than the watermark are dropped, as Spark has it; a null value is a value; a null time or key makes no
segment; a stream that ends leaves the last segment of each key open until the watermark passes `idle`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that wait, as JSON: an entry for each batch of rows that came, as each entry costs a call of its own.
_ROWS = "rows string"
_OPEN = "segment long, value string, size long, first long, last long"


class _Segments(StatefulProcessor):
    def __init__(self, key: str, most: int, idle: int) -> None:
        self.key, self.most, self.idle = key, most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting_rows", _ROWS)
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for batch in rows:
            came = [(int(t), int(p), v if isinstance(v, str) else None) for t, p, v in zip(batch["us"], batch["place"], batch["value"])]
            if came:
                self.waiting.appendValue((json.dumps(came),))
            times |= {-(-t // 1000) for t, _, _ in came}
        # a timer for the last row is enough: when it goes off, all rows up to the watermark are taken
        for t in {min(times), max(times)} if times else ():
            self.handle.registerTimer(t)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r for held in self.waiting.get() for r in json.loads(held[0])), key=lambda r: (r[0], r[1]))
        now = [r for r in rows if r[0] <= passed]
        if now:
            self.waiting.clear()
        if len(rows) > len(now):
            if now:
                self.waiting.put([(json.dumps(rows[len(now) :]),)])
            self.handle.registerTimer(-(-rows[-1][0] // 1000))
        number, value, size, first, last = self.open.get() if self.open.exists() else (0, None, 0, 0, 0)
        out = []
        for us, _, v in now:
            if size and (v != value or size == self.most or us > last + self.idle):
                out.append((number, value, size, first, last))
                size = 0
            if not size:
                number, value, first = number + 1, v, us
            size, last = size + 1, us
        if size and last + self.idle < passed:
            out.append((number, value, size, first, last))
            size = 0
        elif size:
            self.handle.registerTimer((last + self.idle) // 1000 + 1)
        if now or out:
            self.open.update((number, value, size, first, last))
        if out:
            made = pd.DataFrame(out, columns=["segment", "value", "rows", "first_us", "last_us"])
            made.insert(0, self.key, key[0])
            yield made
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def segmented(stream: DataFrame, key: str, time: str, place: str, value: str, most: int, late: str, idle: str) -> DataFrame:
    """key, segment (from 1), value (as text), rows, first_ts and last_ts of each segment that has ended.

    late: how far rows may be behind the latest one (the watermark); idle: how long a key may be silent within a segment.
    place: a whole number that orders rows of one time. The session's state store must be RocksDB (`use_rocksdb`).
    """
    kind = stream.schema[key].dataType.simpleString()
    gap = int(pd.Timedelta(idle).total_seconds() * 1_000_000)
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    some = rows.select(F.col(key), F.col(time), F.unix_micros(time).alias("us"), F.col(place).cast("long").alias("place"), F.col(value).cast("string").alias("value"))
    schema = f"`{key}` {kind}, segment long, value string, rows long, first_us long, last_us long"
    out = some.groupBy(key).transformWithStateInPandas(_Segments(key, most, gap), schema, "append", "EventTime")
    return out.select(key, "segment", "value", "rows", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"))


def use_rocksdb(spark: SparkSession) -> None:
    """What `segmented` needs of a session; streams that run already keep their own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
