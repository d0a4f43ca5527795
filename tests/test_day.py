"""A day's account on hand-made and random days."""

import random

import pytest
from pyspark.sql import functions as F

from dayloom.operators import blocks, rollup, rules, stretches
from dayloom.sources import traces as T

DAY_US = 86_400_000_000
M = 60_000_000
COLS = "actor_id string, source string, external_id string, ts timestamp, duration_ms bigint, type string, raw_text string, is_sidechain boolean, session_id string, cwd string, project string, git_branch string, host string, port string, path_head string, title string"


def event(i, minute, kind, project="", length=0, actor="a", day="2026-05-04", session=None):
    import datetime as dt

    at = dt.datetime.fromisoformat(day) + dt.timedelta(minutes=minute)
    source = {"prompt": "agent-log", "machine": "agent-log", "visit": "browser", "meeting": "calendar"}[kind]
    session = session if session is not None else ("s-" + project if source == "agent-log" else "")
    return (actor, source, f"e{i:04d}", at, length * 60000 if kind == "meeting" else None, "user" if kind == "prompt" else "assistant", "prompt" if kind == "prompt" else "", False, session, "", project, "", "h.example" if kind == "visit" else "", "", "", "")


def account(spark, rows, **settings):
    e = T.entries(spark.createDataFrame(rows, COLS), T.Settings(**settings))
    b = blocks.attributed(rules.named(e))
    h = stretches.head_tail(b)
    p = stretches.pieces(h)
    return b, h, p, stretches.stretches(p)


def test_a_pause_as_long_as_the_gap_stays_in_the_block(spark):
    b, *_ = account(spark, [event(1, 600, "prompt", "x"), event(2, 610, "prompt", "x"), event(3, 620.1, "prompt", "x")])
    assert [r.block_id for r in b.orderBy("ts_us").collect()] == [1, 1, 2]


def test_the_gap_is_measured_from_the_latest_end(spark):
    b, *_ = account(spark, [event(1, 600, "meeting", length=60), event(2, 601, "visit"), event(3, 669, "visit"), event(4, 680, "visit")])
    assert [r.block_id for r in b.orderBy("ts_us").collect()] == [1, 1, 1, 2]


def test_unnamed_takes_the_nearest_and_a_tie_the_earlier(spark):
    b, *_ = account(spark, [event(1, 600, "prompt", "x"), event(2, 605, "visit"), event(3, 610, "prompt", "y"), event(4, 608, "visit")])
    assert {r.external_id: r.project for r in b.collect()} == {"e0001": "x", "e0002": "x", "e0003": "y", "e0004": "y"}


def test_unnamed_blocks_take_what_their_neighbours_agree_on(spark):
    rows = [event(1, 60, "prompt", "x"), event(2, 120, "visit"), event(3, 180, "prompt", "x"), event(4, 240, "visit"), event(5, 300, "prompt", "y"), event(6, 360, "visit")]
    b, *_ = account(spark, rows)
    got = {r.external_id: (r.project, r.origin, r.candidates) for r in b.collect()}
    assert got["e0002"] == ("x", "neighbours", []) and got["e0004"] == ("", "none", ["x", "y"]) and got["e0006"] == ("y", "one-neighbour", [])


def test_head_and_tail(spark):
    _, h, _, _ = account(spark, [event(1, 1, "prompt", "x"), event(2, 12.5, "machine", "x"), event(3, 1439.5, "prompt", "x")])
    got = [((r.from_us - r.day_start_us) / M, (r.to_us - r.day_start_us) / M) for r in h.select("block_id", "from_us", "to_us", "day_start_us").distinct().orderBy("block_id").collect()]
    assert got == [(0, 3), (12.5, 12.5), (1437.5, 1440)]


def test_owner_is_the_nearest_touch_and_padding_is_attention(spark):
    _, _, p, s = account(spark, [event(1, 600, "prompt", "x"), event(2, 602, "machine", "y"), event(3, 604, "machine", "y"), event(4, 605, "prompt", "z")])
    got = [(r.owner, (r.to_us - r.from_us) / M, r.padding) for r in s.orderBy("from_us").collect()]
    assert got == [("x", 2, True), ("x", 2, False), ("x", 2, False), ("z", 1, False), ("z", 2, True)]
    assert {r.kind for r in p.collect()} == {"padding", "attention"}


def test_a_meeting_owns_its_time_and_stops_at_midnight(spark):
    _, h, _, s = account(spark, [event(1, 1400, "meeting", "m", length=120), event(2, 1410, "machine", "x")])
    assert s.where("owner = 'm'").agg(F.sum(F.col("to_us") - F.col("from_us"))).first()[0] == 40 * M
    assert h.agg(F.max(F.col("to_us") - F.col("day_start_us"))).first()[0] == DAY_US


def test_agent_time_counts_other_sessions_and_projects(spark):
    rows = [event(1, 600, "prompt", "x"), event(2, 601, "machine", "y"), event(3, 605, "machine", "y"), event(4, 608, "machine", "y"), event(5, 609, "prompt", "x")]
    b, _, _, s = account(spark, rows, head_us=0, tail_us=0)
    got = stretches.agent_overlap(s, stretches.live_sessions(b)).groupBy("project").agg(F.sum("agent_us")).collect()
    assert [tuple(r) for r in got] == [("y", 7 * M)]


def random_day(rng, actor):
    rows = []
    for i in range(rng.randrange(3, 28)):
        kind = rng.choice(["prompt", "machine", "visit", "meeting"])
        project = rng.choice(["alpha", "beta", ""]) if kind != "visit" else ""
        rows.append(event(i, rng.randrange(0, 1440), kind, project, rng.choice([5, 30, 60, 90, 240, 480, 1200]), actor))
    return rows


@pytest.fixture(scope="module")
def days(spark):
    rng = random.Random(11)
    rows = [r for k in range(60) for r in random_day(rng, f"r{k:03d}")]
    made = account(spark, rows, gap_us=17 * M, window_us=6 * M, head_us=3 * M, tail_us=2 * M)
    return [x.cache() for x in made], rows


def test_invariants_of_random_days(spark, days):
    (b, h, p, s), _ = days
    agent = stretches.agent_overlap(s, stretches.live_sessions(b))
    t = rollup.day_totals(h, s, agent)
    bad = t.where("attention_us + background_us <> active_us or active_us > span_us or padding_us > attention_us or span_us > 86400000000 or attention_us < 0 or background_us < 0")
    assert t.count() == 60 and bad.count() == 0
    total = t.agg(F.sum("active_us")).first()[0]
    assert total == s.agg(F.sum(F.col("to_us") - F.col("from_us"))).first()[0] == p.agg(F.sum(F.col("to_us") - F.col("from_us"))).first()[0]
    assert total == h.select("actor_id", "block_id", "from_us", "to_us").distinct().agg(F.sum(F.col("to_us") - F.col("from_us"))).first()[0]
    assert total == rollup.project_rows(b, s).agg(F.sum(F.col("attention_us") + F.col("background_us"))).first()[0]
    r = stretches.runs(p, h)
    assert total == r.where("not gap").agg(F.sum(F.col("to_us") - F.col("from_us"))).first()[0]
    spans = sorted((x.actor_id, x.from_us, x.to_us) for x in p.collect())
    assert all(a[0] != c[0] or a[2] <= c[1] for a, c in zip(spans, spans[1:]))


def test_attention_is_the_overlap_with_the_windows(days):
    (b, _, _, s), _ = days
    windows = {}
    for w in stretches.attention_windows(b).collect():
        windows.setdefault(w.actor_id, []).append((w.from_us, w.to_us))
    for x in s.collect():
        over = sum(max(0, min(t, x.to_us) - max(f, x.from_us)) for f, t in windows.get(x.actor_id, []))
        assert x.attention_us == (x.to_us - x.from_us if x.padding else over)


def test_order_of_the_input_does_not_matter(spark, days):
    (_, _, _, s), rows = days
    rows = list(rows)
    random.Random(1).shuffle(rows)
    again = account(spark, rows, gap_us=17 * M, window_us=6 * M, head_us=3 * M, tail_us=2 * M)[3]
    assert s.exceptAll(again).count() == 0


def test_a_claim_never_overlaps_runs(spark, days):
    (b, h, p, _), _ = days
    r = stretches.runs(p, h)
    pauses = b.select("actor_id", "local_day", "day_start_us").distinct().select("actor_id", "local_day", F.col("day_start_us").alias("from_us"), (F.col("day_start_us") + 720 * M).alias("to_us"), F.lit(True).alias("worked"), F.lit("c").alias("project"), F.lit("").alias("subject"), F.lit(1).alias("answered_at"))
    held = {x.actor_id: x.held_us for x in rollup.claimed_pauses(pauses, r, b).collect()}
    start = {x.actor_id: x.from_us for x in pauses.collect()}
    free = {a: 720 * M for a in start}
    for x in r.where("not gap").collect():
        free[x.actor_id] -= max(0, min(x.to_us, start[x.actor_id] + 720 * M) - max(x.from_us, start[x.actor_id]))
    assert held == {a: t for a, t in free.items() if t > 0}


def test_one_exchange_by_day_and_no_python(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        s = account(spark, [event(1, 600, "prompt", "x")])[3]
        plan = s._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Pandas" not in plan
