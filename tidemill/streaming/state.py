"""Keyed state over streams: pauses, numbered lines, blocks of progress lines, latest progress, arrivals.

Rows of a micro-batch reach a processor in parts; each part is sorted and gone through by itself where parts come in
order, as they do for a key whose rows are sorted before they are dealt out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import progress
from ..functions.resilience import PAUSE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pauses(StatefulProcessor):
    """For each url the time until which it is paused. A pause replaces an earlier one, even a longer one.

    Rows have seq, which orders a key's rows of one batch, and ts_us. State goes when it has been out of date for
    an hour of processing time.
    """

    def __init__(self, seconds: float = PAUSE, keep_ms: int = 3_600_000):
        self.micros, self.keep_ms = int(seconds * 1_000_000), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(rows).sort_values("seq")
        before = self.until.get()[0] if self.until.exists() else None
        until = (batch["ts_us"] + self.micros).where(batch["is_pause"]).ffill()
        known = until.shift().fillna(before) if before is not None else until.shift()
        last = until.iloc[-1] if pd.notna(until.iloc[-1]) else before
        if last is not None:
            self.until.update((int(last),))
        yield pd.DataFrame({"url": key[0], "seq": batch["seq"], "paused": (batch["ts_us"] < known).fillna(False).astype(bool)})

    def close(self) -> None:
        pass


class TimedPauses(StatefulProcessor):
    """Pauses that end by event time: a row `pause` when one is set and a row `resume` when it has run out.

    A pause replaces an earlier one and its timer. At the resume the key's state goes, so keys that rest cost nothing.
    """

    def __init__(self, seconds: float = PAUSE):
        self.millis = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = pd.concat(rows).sort_values(["at_ms", "seq"])["at_ms"]
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        until = int(at.iloc[-1]) + self.millis
        self.until.update((until,))
        self.handle.registerTimer(until)
        yield pd.DataFrame({"url": key[0], "what": "pause", "at_ms": at, "until_ms": at + self.millis})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.until.exists() and self.until.get()[0] == at:
            self.until.clear()
            yield pd.DataFrame({"url": [key[0]], "what": ["resume"], "at_ms": [at], "until_ms": [at]})

    def close(self) -> None:
        pass


class Numbers(StatefulProcessor):
    """Lines of each source numbered on, over all files that are its pieces."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getValueState("lines", "lines long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(rows).sort_values(["piece", "place"])
        first = self.lines.get()[0] if self.lines.exists() else 0
        self.lines.update((first + len(batch),))
        yield pd.DataFrame({"source": key[0], "line_no": range(first, first + len(batch)), "line": batch["line"]})

    def close(self) -> None:
        pass


class Blocks(StatefulProcessor):
    """For each source the open block's fields; a row for each finished block. After `end` further lines are ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "block long, ended boolean, fields string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        block, ended, text = self.open.get() if self.open.exists() else (0, False, "{}")
        fields = json.loads(text)
        out = []
        batch = pd.concat(rows).sort_values("line_no")
        for line in [] if ended else batch["line"][batch["line"].str.contains("=", regex=False, na=False)].str.strip():
            name, value = line.split("=", 1)
            fields[name] = value
            if name == "progress":
                out.append((key[0], block, *[fields.get(f) for f in progress.FIELDS]))
                block, fields, ended = block + 1, {}, value == "end"
            if ended:
                break
        self.open.update((block, ended, json.dumps({n: v for n, v in fields.items() if n in progress.FIELDS})))
        yield pd.DataFrame(out, columns=["source", "block", *progress.FIELDS])

    def close(self) -> None:
        pass


def paused(rows: DataFrame, seconds: float = PAUSE) -> DataFrame:
    """url, seq and paused for a stream of url, seq, ts_us and is_pause. Needs the RocksDB state store."""
    out = "url string, seq long, paused boolean"
    return rows.groupBy("url").transformWithStateInPandas(Pauses(seconds), outputStructType=out, outputMode="append", timeMode="processingTime")


def pause_events(pauses: DataFrame, seconds: float = PAUSE, delay: str = "10 seconds") -> DataFrame:
    """url, what (pause or resume), at_ms and until_ms for a stream of url, seq and ts, the times at which pauses are set.

    Rows later than the watermark, which runs `delay` behind, are dropped. Needs the RocksDB state store.
    """
    out = "url string, what string, at_ms long, until_ms long"
    return pauses.withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", delay).groupBy("url").transformWithStateInPandas(TimedPauses(seconds), outputStructType=out, outputMode="append", timeMode="eventTime")


def numbered(pieces: DataFrame) -> DataFrame:
    """source, line_no and line for a stream of source, piece, place and line. Needs the RocksDB state store."""
    out = "source string, line_no long, line string"
    return pieces.groupBy("source").transformWithStateInPandas(Numbers(), outputStructType=out, outputMode="append", timeMode="none")


def blocks(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Finished progress blocks of a stream of source, line_no and line, with the columns and values that
    operators.progress.block_fields gives for a table. Needs the RocksDB state store."""
    out = "source string, block long, " + ", ".join(f"{f} string" for f in progress.FIELDS)
    rows = lines.groupBy("source").transformWithStateInPandas(Blocks(), outputStructType=out, outputMode="append", timeMode="none")
    return rows.select("source", "block", *[progress.field(f, F.col(f), strict).alias(f) for f in progress.FIELDS])


def latest(updates: DataFrame) -> DataFrame:
    """The last update of each url_index, for complete or update mode."""
    last = F.max_by(F.struct("downloaded", "total"), F.struct("ts", "seq"))
    return updates.groupBy("url_index").agg(last.alias("s")).select("url_index", "s.downloaded", "s.total")


def distinct_urls(responses: DataFrame, delay: str | None = None) -> DataFrame:
    """The first of equal urls; with a delay, over column ts, state is kept for that long only."""
    if delay is None:
        return responses.dropDuplicates(["url"])
    return responses.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url"])
