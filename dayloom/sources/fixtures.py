"""Traces, rules and answers made of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KIND = "CASE WHEN event_type IN ('click','view') THEN 'browser' WHEN event_type = 'signup' THEN 'calendar' ELSE 'agent-log' END"


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as traces."""
    return as_traces(spark.read.parquet(f"{sf_dir}/events.parquet"))


def live_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of traces."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return as_traces(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))  # a pattern, as the source takes no single file


def as_traces(e: DataFrame) -> DataFrame:
    """Events as traces: users are sessions, groups of users are actors."""
    visit, agent = "event_type IN ('click','view')", "event_type IN ('purchase','error')"
    return e.select(
        F.expr("concat('a', cast(user_id % 3 as string))").alias("actor_id"),
        F.expr(KIND).alias("source"),
        F.expr("lpad(cast(event_id as string), 12, '0')").alias("external_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr("CASE WHEN event_type = 'signup' THEN cast(floor(value) as bigint) * 60000 END").alias("duration_ms"),
        F.expr(f"CASE WHEN {visit} THEN 'visit' WHEN event_type = 'signup' THEN 'event' WHEN event_type = 'purchase' THEN 'user' ELSE 'assistant' END").alias("type"),
        F.expr("CASE WHEN event_type = 'purchase' THEN 'prompt' ELSE '' END").alias("raw_text"),
        F.expr("event_type = 'purchase' AND event_id % 17 = 0").alias("is_sidechain"),
        F.expr(f"CASE WHEN {agent} THEN concat('s', cast(user_id as string)) ELSE '' END").alias("session_id"),
        F.expr(f"CASE WHEN {agent} THEN concat('/src/p', cast(user_id % 12 as string)) ELSE '' END").alias("cwd"),
        F.expr(f"CASE WHEN {agent} THEN concat('p', cast(user_id % 12 as string)) ELSE '' END").alias("project"),
        F.lit("").alias("git_branch"),
        F.expr(f"CASE WHEN {visit} THEN concat('h', cast(user_id % 9 as string), '.example.com') ELSE '' END").alias("host"),
        F.expr(f"CASE WHEN {visit} AND event_id % 5 = 0 THEN '3000' ELSE '' END").alias("port"),
        F.expr(f"CASE WHEN {visit} THEN concat('k', cast(cast(regexp_replace(props, '[^0-9]+', '') as int) % 10 as string)) ELSE '' END").alias("path_head"),
        F.expr("CASE WHEN event_type <> 'error' THEN concat('TK-', cast(user_id % 20 as string), ' item') ELSE '' END").alias("title"),
    )


#: level, project, subject, kind, value, since; in the order written.
RULES = [
    ("project", "alpha", "", "path", "/src/p1", None),
    ("project", "beta", "", "path", "/src/p1*", None),
    ("project", "gamma", "", "key", "h3.example.com", None),
    ("project", "delta", "", "key", "h3.example.com:3000", None),
    ("project", "eps", "", "key", "h3.example.com/k1", None),
    ("project", "zeta", "", "path", "/src/p4", "2024-01-15"),
    ("project", "eta", "", "key", "example.com/k7", None),
    ("never", "", "", "key", "h5.example.com", None),
    ("never", "", "", "path", "/src/p7", None),
    ("ambiguous", "", "", "key", "h6.example.com", None),
    ("subject", "", "", "title", r"\b(TK-[0-9]+)\b", None),
    ("subject", "gamma", "focus", "key", "h3.example.com/k2", None),
]

#: actor, day, from and to (hours of the day), project, subject, clear_subject, one_off, order made.
ANSWERS = [
    ("a0", "2024-01-05", 9.0, 11.5, "manual-a", "", False, False, 1),
    ("a0", "2024-01-05", 10.0, 10.5, "manual-b", "TK-x", False, True, 2),
    ("a1", "2024-01-10", 13.0, 15.0, "", "TK-y", False, False, 1),
    ("a2", "2024-01-20", 0.0, 24.0, "", "", True, False, 1),
]

#: actor, day, from and to (hours), worked, project, subject, order answered.
PAUSES = [
    ("a0", "2024-01-06", 1.0, 6.0, True, "paused-a", "TK-p", 1),
    ("a0", "2024-01-06", 5.0, 9.0, True, "paused-b", "", 2),
    ("a1", "2024-01-07", 2.0, 3.0, False, "", "", 1),
    ("a2", "2024-01-08", 20.0, 23.0, True, "p2", "", 1),
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, None, *r) for i, r in enumerate(RULES)], "rule_id int, actor_id string, level string, project string, subject string, kind string, value string, since string")


def _spans(spark: SparkSession, rows: list, names: str) -> DataFrame:
    df = spark.createDataFrame(rows, f"actor_id string, day string, f double, t double, {names}")
    at = lambda c: (F.unix_micros(F.col("day").cast("timestamp")) + (F.col(c) * 3_600_000_000).cast("long"))
    return df.withColumns({"from_us": at("f"), "to_us": at("t"), "local_day": F.to_date("day")}).drop("f", "t", "day")


def answers(spark: SparkSession) -> DataFrame:
    return _spans(spark, ANSWERS, "project string, subject string, clear_subject boolean, one_off boolean, made_at int")


def pauses(spark: SparkSession) -> DataFrame:
    return _spans(spark, PAUSES, "worked boolean, project string, subject string, answered_at int")
