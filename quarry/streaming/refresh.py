"""The refresh that repeats: when each link or part is due again, kept as state with a timer a key."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "id string, at timestamp, alive boolean"
DUE = "id string, action string, due timestamp, fail_count long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Due(StatefulProcessor):
    """Of each id when it was last seen to be checked, how often in a row it failed, and its one timer.

    An event without a verdict tells that the id exists: it is due at once, unless it is known.
    A check sets the timer to ``days`` after it; checks not newer than the last one are left
    out. When the timer goes off the id is due, and ``days`` later by the clock of then again, if no
    check comes.
    The failure that makes ``most`` in a row purges the id: it is told once and forgotten.
    """

    def __init__(self, days: float, most: int):
        self.every, self.most = int(days * 86_400_000), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "checked long, failures long, timer long")

    def _set(self, checked: int, failures: int, timer: int) -> None:
        old = self.state.get() if self.state.exists() else None
        if old is not None and old[2] != timer:
            self.handle.deleteTimer(old[2])
        self.handle.registerTimer(timer)
        self.state.update((checked, failures, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        if not key[0]:
            return
        out, events = [], pd.concat(list(rows), ignore_index=True)  # an id's events of one batch
        at = (events["at"].astype("datetime64[us]").astype("int64") // 1000).tolist()
        for when, alive in sorted(zip(at, events["alive"].tolist(), strict=True), key=lambda e: (e[0], e[1] is not None and e[1] == e[1], bool(e[1]))):
            known = self.state.get() if self.state.exists() else None
            if alive is None or alive != alive:
                if known is None:
                    out.append((key[0], "check", when, 0))
                    self._set(-1, 0, when + self.every)
            elif known is None or when > known[0]:
                failures = 0 if alive else (known[1] if known else 0) + 1
                if failures >= self.most:
                    if known is not None:
                        self.handle.deleteTimer(known[2])
                    self.state.clear()
                    out.append((key[0], "purge", when, failures))
                else:
                    self._set(when, failures, when + self.every)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        checked, failures, timer = self.state.get()
        when = expiredTimerInfo.getExpiryTimeInMs()
        if when == timer:
            again = max(when, timerValues.getCurrentWatermarkInMs()) + self.every
            self.handle.registerTimer(again)
            self.state.update((checked, failures, again))
            yield self._frame([(key[0], "check", when, failures)])

    @staticmethod
    def _frame(rows: list[tuple]):
        import pandas as pd

        out = pd.DataFrame(rows, columns=["id", "action", "due", "fail_count"])
        out["due"] = pd.to_datetime(out["due"], unit="ms")
        return out

    def close(self) -> None:
        pass


def due(events: DataFrame, days: float = 7, most: int = 3, late: str = "0 seconds") -> DataFrame:
    """Stream of (id, action, due, fail_count) from a stream of events (id, at, alive).

    ``action`` is check or purge. The clock is the events' own: an event without an id, or with an
    empty one, only moves it on. Events that are ``late`` or more behind it are left out.
    """
    rows = events.where("at IS NOT NULL").withWatermark("at", late).withColumn("id", F.coalesce("id", F.lit("")))  # a filter by id would keep the clock's own events from the clock
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=Due(days, most), outputStructType=DUE, outputMode="append", timeMode="eventTime")


def refresh(spark: SparkSession, source: str, state: str, now: datetime | None = None, days: float = 7, most: int = 3) -> None:
    """Take in the JSON files of ``source`` that are new; what is due goes to ``state``/due, a folder a batch.

    With ``now``, events that only move the clock are added to ``source``: a batch's timers go by
    the clock of the batch before, so there are two. Without, timers that the last file's
    clock has passed go off in the next run. A batch that is replayed overwrites its own
    folder, so nothing is due twice; a run without new files adds nothing.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for _ in range(0 if now is None else 2):
        spark.createDataFrame([(None, now, None)], EVENTS).coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/due/batch={batch_id}")

    stream = due(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(source), days, most)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def waiting(spark: SparkSession, state: str) -> DataFrame:
    """(id, action, due, fail_count): all that has become due so far."""
    return spark.read.option("recursiveFileLookup", "true").schema(DUE).parquet(f"{state}/due").select(*[F.col(c.split()[0]) for c in DUE.split(", ")])
