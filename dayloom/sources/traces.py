"""The trace table: columns, ordering, and the columns that all operators work on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

SCHEMA = """actor_id string, source string, external_id string, ts timestamp, duration_ms bigint, type string, subtype string,
project string, raw_text string, entrypoint string, session_id string, cwd string, git_branch string, is_sidechain boolean,
client_version string, host string, port string, path_head string, title string, ingested_at timestamp"""

#: A day of an actor, and the total order of its traces.
D = ("actor_id", "local_day")
ORD = ("ts_us", "source", "external_id")
MINUTE = 60_000_000


@dataclass(frozen=True)
class Settings:
    """Options for everybody; a table actor_settings can replace them by actor (with_settings)."""

    tz: str = "UTC"
    gap_us: int = 10 * MINUTE
    window_us: int = 5 * MINUTE
    head_us: int = 2 * MINUTE
    tail_us: int = 2 * MINUTE
    fallback: str = "cwd-basename"


def with_settings(traces: DataFrame, settings: Settings | None = None, table: DataFrame | None = None) -> DataFrame:
    """traces with tz, gap_us, window_us, head_us, tail_us and fallback. A zero or missing gap is 10 minutes, a missing window half the gap, a missing head or tail none."""
    s = settings or Settings()
    names = ("tz", "gap_us", "window_us", "head_us", "tail_us", "fallback")
    if table is None:
        return traces.withColumns({n: F.lit(getattr(s, n)) for n in names})
    own = table.select("actor_id", *(F.col(n).alias(f"_{n}") for n in names), F.lit(True).alias("_has"))
    out = traces.join(own, "actor_id", "left")
    gap = F.coalesce(F.nullif(F.col("_gap_us"), F.lit(0)), F.lit(10 * MINUTE))
    mine = {"tz": F.coalesce("_tz", F.lit(s.tz)), "gap_us": gap, "window_us": F.coalesce("_window_us", F.floor(gap / 2)), "head_us": F.coalesce("_head_us", F.lit(0)), "tail_us": F.coalesce("_tail_us", F.lit(0)), "fallback": F.coalesce("_fallback", F.lit(s.fallback))}
    return out.withColumns({n: F.when(F.col("_has"), c).otherwise(F.lit(getattr(s, n))) for n, c in mine.items()}).drop("_has", *(f"_{n}" for n in names))


def is_touch() -> Column:
    prompt = (F.col("source") == "agent-log") & (F.col("type") == "user") & (F.col("raw_text") == "prompt") & ~F.coalesce("is_sidechain", F.lit(False))
    return F.coalesce((F.col("source") == "browser") | prompt, F.lit(False))


def own_span_us() -> Column:
    return F.when((F.col("source") == "calendar") & (F.col("duration_ms") > 0), F.col("duration_ms") * 1000).otherwise(F.lit(0).cast("long"))


def entries(traces: DataFrame, settings: Settings | None = None, table: DataFrame | None = None) -> DataFrame:
    """traces with the columns of a day's account: ts_us, end_us, local_day and its bounds, touch, owns, key, path. Rows without a readable time go (unreadable counts them)."""
    t = with_settings(traces.where("ts is not null"), settings, table).withColumn("ts_us", F.unix_micros("ts")).withColumn("local_day", S.local_day(F.col("ts"), F.col("tz")))
    start, end = S.day_bounds(F.col("local_day"), F.col("tz"))
    return t.withColumns(
        {
            "span_us": own_span_us(),
            "touch": is_touch(),
            "day_start_us": start,
            "day_end_us": end,
            "key": F.when(F.col("source") == "browser", S.browser_key(F.col("host"), F.col("port"), F.col("path_head"))).otherwise(""),
            "path": F.when(F.col("source").isin("agent-log", "git"), S.trimmed_path(F.col("cwd"))).otherwise(""),
        }
    ).withColumns({"end_us": F.col("ts_us") + F.col("span_us"), "owns": F.col("touch") | (F.col("span_us") > 0)})


def unreadable(rows: DataFrame, column: str = "ts") -> DataFrame:
    """How many rows have a time that cannot be read."""
    return rows.agg(F.count_if(F.col(column).try_cast("timestamp").isNull()).alias("unreadable"), F.count("*").alias("n"))
