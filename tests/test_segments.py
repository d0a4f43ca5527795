"""Actor-days cut into slices: the rows of the plain way, spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from dayloom.operators import blocks, rules, segments, stretches
from dayloom.sources import traces as T

from .test_day import COLS, M, event, random_day

DAY = ("actor_id", "local_day")


def entries(spark, rows, **settings):
    return T.entries(spark.createDataFrame(rows, COLS), T.Settings(**settings))


@pytest.fixture(scope="module")
def named(spark):
    rng = random.Random(23)
    rows = [r for k in range(12) for r in random_day(rng, f"r{k:02d}")]
    rows += [event(500 + i, 600 + i // 7, rng.choice(["prompt", "machine", "visit", "meeting"]), rng.choice(["alpha", "beta", "", "", ""]), rng.choice([1, 5]), "busy") for i in range(160)]  # many at one instant
    rows += [event(900 + i, 3 * i, "visit", "", 0, "unnamed") for i in range(40)]
    return rules.named(entries(spark, rows, gap_us=17 * M)).cache()


@pytest.mark.parametrize("slice_rows", [7, 40, 10_000])
def test_slices_give_the_same_rows(named, slice_rows):
    plain = blocks.attributed(named)
    cut = segments.attributed(named, slice_rows).select(plain.columns)
    assert plain.exceptAll(cut).count() == 0 and cut.exceptAll(plain).count() == 0


def test_only_hot_days_are_cut(named, monkeypatch):
    monkeypatch.setattr(segments, "SLICE_ROWS", 20)
    hot = blocks.hot_days(named, 100)
    assert [r.actor_id for r in hot.collect()] == ["busy"] and blocks.hot_days(named, 1000) is None
    plain, both = blocks.attributed(named), blocks.attributed(named, hot)
    assert plain.exceptAll(both.select(plain.columns)).count() == 0 and both.count() == plain.count()
    numbered = blocks.blocks(named)
    assert numbered.exceptAll(blocks.blocks(named, hot).select(numbered.columns)).count() == 0


def test_days_are_dealt_over_tasks_by_rows(named, monkeypatch):
    monkeypatch.setattr(blocks, "TASK_ROWS", 10)
    plain = blocks.attributed(named)
    for df in (blocks.blocks(named), plain, stretches.head_tail(plain)):
        days = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct(*DAY).alias("n"))
        assert days.agg(F.max("n")).first()[0] < 6 and days.count() > 8
    assert max(blocks.HOT_DAY, segments.SLICE_ROWS) <= 100_000


def plan_windows(df):
    """(partition keys, whether raw rows are below) of every window of the plan."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in text.splitlines() if "Window [" in line]


def test_no_window_over_a_whole_day_of_rows(named):
    for df in (segments.numbered(segments.sliced(named, 40)), segments.owned(segments.inherited(segments.numbered(segments.sliced(named, 40))))):
        for line in plan_windows(df):
            over_rows = "ts_us" in line.split("], [")[-1]
            assert not over_rows or "_slice" in line


def test_a_day_of_a_million_events_is_many_tasks(spark):
    n = 1_000_000
    e = spark.range(n).select(
        F.lit("a").alias("actor_id"), F.when(F.col("id") % 3 == 0, "browser").otherwise("agent-log").alias("source"), F.format_string("%09d", "id").alias("external_id"),
        F.timestamp_micros(F.lit(1_777_852_800_000_000) + F.col("id") * 80_000 + F.when(F.col("id") > 600_000, 900_000_000).otherwise(0)).alias("ts"), F.lit(None).cast("bigint").alias("duration_ms"), F.lit("user").alias("type"), F.lit("").alias("raw_text"),
        F.lit(False).alias("is_sidechain"), F.lit("").alias("session_id"), F.lit("").alias("cwd"), F.when(F.col("id") % 5 == 0, "p").otherwise("").alias("project"), F.lit("").alias("git_branch"), F.lit("h").alias("host"), F.lit("").alias("port"), F.lit("").alias("path_head"), F.lit("").alias("title"),
    )
    day = T.entries(e)
    slices = segments.sliced(day, 50_000)
    sizes = [r["count"] for r in slices.groupBy("_slice").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 150_000
    got = segments.numbered(slices).agg(F.count("*"), F.max("nth"), F.count_distinct("nth"), F.max("block_id"), F.count_if((F.col("block_id") == 1) == (F.col("external_id") <= "000600000"))).first()
    assert tuple(got) == (n, n, n, 2, n)


@pytest.mark.parametrize("slice_edges", [5, 60, 10_000])
def test_sweep_in_slices_gives_the_same_pieces(spark, named, monkeypatch, slice_edges):
    b = blocks.attributed(named).localCheckpoint()
    monkeypatch.setattr(stretches, "SLICE_ROWS", slice_edges)
    hot = named.select(*DAY).distinct().where("actor_id in ('busy', 'unnamed', 'r03', 'r04')").localCheckpoint()
    day = b.select("local_day").first()[0]
    said = [("busy", day, 1, 0, 2**60, "all", "", False, False), ("r05", day, 1, 0, 2**60, "", "s", False, True)]
    answers = spark.createDataFrame(said, "actor_id string, local_day date, made_at int, from_us long, to_us long, project string, subject string, clear_subject boolean, one_off boolean")
    plain, cut = stretches.head_tail(b), stretches.head_tail(b, hot)
    assert plain.exceptAll(cut.select(plain.columns)).count() == 0 and cut.count() == plain.count()
    for a in (None, answers):
        one, two = stretches.pieces(plain, a), stretches.pieces(cut, a, hot)
        assert one.count() > 50 and one.exceptAll(two.select(one.columns)).count() == 0 and two.count() == one.count()


def test_no_day_of_a_busy_actor_is_one_task(named, monkeypatch):
    monkeypatch.setattr(segments, "SLICE_ROWS", 20)
    monkeypatch.setattr(stretches, "SLICE_ROWS", 20)
    b = blocks.attributed(named).localCheckpoint()
    hot = blocks.hot_days(named, 100)
    p = stretches.pieces(stretches.head_tail(b, hot), None, hot).where("actor_id = 'busy'")
    assert p.select(F.spark_partition_id()).distinct().count() > 1
    for line in plan_windows(stretches.sliced_sweep(stretches.edges(stretches.block_ends(b).withColumns({"from_us": F.col("block_from_us"), "to_us": F.col("block_to_us")})), 5)):
        assert "_slice" in line
    assert max(blocks.HOT_DAY, segments.SLICE_ROWS, blocks.TASK_ROWS) <= 20_000
