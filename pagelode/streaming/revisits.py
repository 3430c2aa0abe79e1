"""When sites are due again, as state of a stream: a timer for each site, kept in the stream's checkpoint.

Visits come as files of (site_url, visited_at, frequency_hours), one row a site and crawl. A site's timer stands at its last visit and
its frequency; when the time of the stream has passed it, the site is due, once, until it is visited again. The time of the stream is the latest
visited_at that has come: rows without a site only tell the time (`tell_time`), so a clock that stands still fires nothing. A visit may be
told up to LATE after the time that the stream has reached, as a crawl takes time; one that comes later is left out.
"""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The stream's watermark stands so far behind its time, and timers are set as much earlier.
LATE = datetime.timedelta(days=1)
VISITS = "site_url string, visited_at timestamp, frequency_hours int"
DUE = "site_url string, due_at timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Timers(StatefulProcessor):
    """Of a site: its last visit, and one timer."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "visited_at timestamp, frequency_hours int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        visits = [(r.visited_at.to_pydatetime(), int(r.frequency_hours)) for part in rows for r in part.dropna().itertuples()]
        newest = max(visits, default=None)
        if newest and key[0] and (not self.last.exists() or self.last.get()[0] < newest[0]):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update(newest)
            due = newest[0].replace(tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=newest[1])
            self.handle.registerTimer(int((due - LATE).timestamp() * 1000))
        yield pd.DataFrame({"site_url": pd.Series([], dtype=str), "due_at": pd.Series([], dtype="datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"site_url": [key[0]], "due_at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms") + LATE]})

    def close(self) -> None:
        pass


def tell_visits(sites: DataFrame, folder: str, as_of) -> None:
    """Notes that sites (site_url, frequency_hours) were visited. The session's time zone is taken to be UTC."""
    sites.select("site_url", F.lit(as_of).cast("timestamp").alias("visited_at"), F.col("frequency_hours").cast("int")).write.mode("append").parquet(folder)


def tell_time(spark: SparkSession, folder: str, as_of) -> None:
    spark.createDataFrame([(None, as_of, None)], VISITS).coalesce(1).write.mode("append").parquet(folder)


def due(visits: DataFrame) -> DataFrame:
    """A stream of visits as a stream of (site_url, due_at). A query of it needs the state store of `rocksdb_state`."""
    timed = visits.withColumn("site_url", F.coalesce("site_url", F.lit(""))).withWatermark("visited_at", f"{int(LATE.total_seconds())} seconds")
    return timed.groupBy("site_url").transformWithStateInPandas(Timers(), DUE, "Append", "EventTime")


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Timers need this state store; queries started within have it, the session's setting is restored."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def recrawl(spark: SparkSession, folder: str, checkpoint: str, crawl: Callable[[DataFrame, int], None], trigger: dict | None = None):
    """Starts a stream over the visits in a folder; crawl(sites, batch) is given the sites (site_url, due_at) that have fallen due. It may be given a batch
    again after a failure, with the same sites. Visits that it tells are read by the next run."""

    def run(batch: DataFrame, number: int) -> None:
        sites = spark.createDataFrame(batch.groupBy("site_url").agg(F.max("due_at").alias("due_at")).collect(), DUE)  # a row a site that is due
        if sites.take(1):
            crawl(sites, number)

    with rocksdb_state(spark):
        stream = due(spark.readStream.schema(VISITS).parquet(folder))
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(run).start()
