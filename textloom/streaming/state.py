"""State with timers: results of contents that come again within their time to live."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from textloom.streaming.jobs import run

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000


class StoredResults(StatefulProcessor):
    """For a content the row that was computed last: its id, result and end, and a timer that clears them at the end."""

    def init(self, handle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "source long, result string, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows), ignore_index=True).sort_values(["at", "id"], ignore_index=True)
        at, before = own["at"].to_numpy(), self.stored.get()
        source, result, ends = before or (None, None, int(at[0]))
        sources, results, new = np.zeros(len(own), np.int64), np.empty(len(own), object), np.zeros(len(own), bool)
        a = 0
        while a < len(own):
            if at[a] >= ends:
                source, result, ends = int(own["id"][a]), own["result"][a], int(at[a]) + int(own["days"][a]) * DAY
                new[a] = True
            # at least the row itself, which a time to live of no days leaves at its own end
            b = max(int(np.searchsorted(at, ends)), a + 1)
            sources[a:b], results[a:b] = source, result
            a = b
        if new.any():
            self.stored.update((source, result, ends))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-ends // 1000))
        yield pd.DataFrame({"id": own["id"], "hit": ~new, "source": sources, "result": results})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self.stored.get()
        if before and before[2] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.stored.clear()
        return iter(())

    def close(self) -> None:
        pass


def reuse_results(stream: DataFrame, folder: str, key: str, ts: str, content: str, result: str, days: str, late: str = "1 hour") -> DataFrame:
    """Run a stream of analysed contents: ``key`` (long), ``hit``, ``source``, and ``result``, computed or stored.

    A row whose equal ``content`` was computed less than that row's own ``days`` (int, its time to live)
    before gets its result and is a hit of ``source``, its key; any other row is computed and stored.
    The age is that of the computed row, so hits don't prolong it. State is a row for each content
    that has not ended; a timer in event time clears it. A stream that is run again on the same
    ``folder`` goes on from where it was: state, progress and results are below it.

    Rows of a batch are taken in order of time, then key. One task holds a content's rows of a batch (key,
    time, result; not the content), so a trigger bounds them. Rows more than ``late`` behind are
    dropped by the watermark; those without content, time, key or days are left out. Other columns are not read.
    """
    spark = stream.sparkSession
    kind = stream.schema[result].dataType.simpleString()
    own = stream.select(
        F.col(ts).alias("ts"),
        F.sha2(F.col(content).cast("string"), 256).alias("content"),
        F.col(key).cast("long").alias("id"),
        F.unix_micros(F.col(ts)).alias("at"),
        F.to_json(F.struct(F.col(result).alias("r"))).alias("result"),
        F.col(days).cast("int").alias("days"),
    ).dropna(subset=["ts", "content", "id", "days"])
    kept = own.withWatermark("ts", late).groupBy("content").transformWithStateInPandas(StoredResults(), "id long, hit boolean, source long, result string", "Append", "EventTime")
    out = kept.select(F.col("id").alias(key), "hit", "source", F.from_json("result", f"r {kind}")["r"].alias(result))
    schema = out.schema

    def each(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/results/batch={batch}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        run(out, "append", each, progress=f"{folder}/progress")
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/results")
