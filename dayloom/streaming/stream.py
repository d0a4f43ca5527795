"""Traces as streams: dedup, counters and blocks under watermarks, and days that late data touches."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.feeds import IDENTITY, scan_agent_log
from ..sources.ledger import Ledger
from ..sources.traces import D, Settings, entries

LATE = "7 days"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Agent log lines of a folder as they arrive; a file is read once, by the query's checkpoint."""
    return scan_agent_log(spark.readStream.text(path)).where("outcome = 'found'")


def stream_dedup(traces: DataFrame, late: str = LATE) -> DataFrame:
    """Each identity once, if its repeats come within the time allowed."""
    return traces.withWatermark("ts", late).dropDuplicatesWithinWatermark(IDENTITY)


def stream_ingest(traces: DataFrame, ledger: Ledger, checkpoint: str, now: dt.datetime | None = None) -> StreamingQuery:
    """Append traces to a ledger, each identity once over all runs and whatever its time; a batch that is tried again counts once."""

    def write(batch: DataFrame, n: int) -> None:
        ledger.append(batch, tag=f"{checkpoint}#{n}", now=now, observed=False)

    return traces.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(traces: DataFrame, every: str = "1 day", late: str = LATE) -> DataFrame:
    """Counters by source in tumbling windows."""
    return traces.withWatermark("ts", late).groupBy(F.window("ts", every), "source").agg(F.count("*").alias("n")).select(F.col("window.start").alias("from_ts"), "source", "n")


def stream_blocks(entries: DataFrame, late: str = LATE) -> DataFrame:
    """Blocks as sessions: a trace keeps its session open for its own length and the gap; a pause as long as the gap stays inside."""
    hold = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast((span_us + gap_us) / 1000000 as decimal(18, 6)))")
    return entries.withWatermark("ts", late).groupBy(F.session_window("ts", hold), *D).agg(F.min("ts_us").alias("from_us"), F.max(F.least("end_us", "day_end_us")).alias("to_us"), F.count("*").alias("events")).drop("session_window")


def stream_touched_days(traces: DataFrame, ledger: Ledger, build: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, settings: Settings | None = None, frozen: DataFrame | None = None, now: dt.datetime | None = None) -> StreamingQuery:
    """Keep the day tables of a ledger up to date: each batch is stored, and the actor-days that its new traces fall into are worked out again by build.

    A meeting that runs over midnight counts for the day it begins in, as
    everywhere. Days of frozen (D, events) whose number of events has changed
    stand in the table `disturbed` after the batch. The days follow from the
    stored traces, so a batch that stopped between the two commits works them
    out when it is tried again.
    """

    def write(batch: DataFrame, n: int) -> None:
        ledger.append(batch, tag=f"{checkpoint}#{n}", now=now, observed=False)
        if ledger.done(f"{checkpoint}#{n}:days"):
            return
        days = entries(ledger.of_commit("events", f"{checkpoint}#{n}"), settings).select(*D).distinct()
        ledger.refresh_days(days, build, settings, frozen=frozen, tag=f"{checkpoint}#{n}:days")

    return traces.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
