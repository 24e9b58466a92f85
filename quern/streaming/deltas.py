"""Rates of a running total on a stream of samples that come late and out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAMPLE = "at timestamp, place bigint, total double"


class Deltas(StatefulProcessor):
    """Keeps the samples of a key until the watermark has passed them, and the last one that was told."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", SAMPLE)
        self.last = handle.getValueState("last", SAMPLE)

    def _tell(self, key: tuple, rows: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        passed = pd.Timestamp(max(0, watermark_ms), unit="ms")
        ready = sorted(r for r in rows if r[0] <= passed)
        rest = [r for r in rows if r[0] > passed]
        before = self.last.get() if self.last.exists() else None
        out = []
        for at, place, total in ready:
            seconds = (at - pd.Timestamp(before[0])).total_seconds() if before else 0.0
            out.append((key[0], at, place, (total - before[2]) / seconds if before and seconds else None))
            before = (at, place, total)
        if ready:
            self.last.update(before)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(int(min(r[0] for r in rest).timestamp() * 1000) + 1)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["key", "at", "place", "rate"]).astype({"rate": "float64", "place": "int64"})

    def _waiting(self) -> list[tuple]:
        return [(pd.Timestamp(r[0]), int(r[1]), float(r[2])) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(pd.Timestamp(r.at), int(r.place), float(r.total)) for frame in rows for r in frame.itertuples(index=False)]
        yield from self._tell(key, self._waiting() + fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._tell(key, self._waiting(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def delta_stream(samples: DataFrame, late: str) -> DataFrame:
    """samples(key, at, place, total) of a stream to (key, at, place, rate): the rate between neighbours in the order of time and place, null for the first and where no time passed.

    A sample is told once the watermark, `late` behind the newest, has passed it,
    so that one that comes within this time finds its place; later ones are
    dropped. A key keeps what waits and one sample. As metrics.deltas() on a
    table of the samples that weren't too late.
    """
    kind = dict(samples.dtypes)["key"]
    samples.sparkSession.conf.set(PROVIDER, ROCKS)
    watched = samples.select("key", "at", "place", "total").withWatermark("at", late)
    return watched.groupBy("key").transformWithStateInPandas(Deltas(), f"key {kind}, at timestamp, place bigint, rate double", "Append", "EventTime")
