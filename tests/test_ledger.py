"""A stored account that follows its sources."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dayloom.operators import blocks, rollup, rules, stretches
from dayloom.sources.ledger import Change, Ledger
from dayloom.sources.traces import SCHEMA, entries
from dayloom.streaming import stream as Z

NOW = dt.datetime(2026, 5, 10, 12)
COLS = "actor_id string, source string, external_id string, ts timestamp, duration_ms bigint, type string, raw_text string, entrypoint string, title string, project string"


def at(day, minute=0, month=5):
    return dt.datetime(2026, month, day) + dt.timedelta(minutes=minute)


def traces(spark, rows):
    """rows: (actor, id, time) and optionally length, title, entrypoint, source."""
    full = [(r[0], r[6] if len(r) > 6 else "calendar", r[1], r[2], r[3] if len(r) > 3 else None, "event", "", r[5] if len(r) > 5 else "work", r[4] if len(r) > 4 else "t", "") for r in rows]
    return spark.createDataFrame(full, COLS)


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/ledger", buckets=3)


def content(ledger, *columns):
    return sorted(map(tuple, ledger.read("events").select("actor_id", "external_id", *columns).collect()))


def test_an_identity_is_stored_once_whenever_it_comes_again(spark, ledger):
    first = traces(spark, [("a", "1", at(1)), ("a", "2", at(2)), ("a", "2", at(1, 5)), ("b", "1", at(2)), (None, "1", at(3)), ("b", "x", None)])
    assert ledger.append(first, now=NOW) == {"seen": 6, "new": 5, "unchanged": 1}
    again = traces(spark, [("a", "1", at(1, month=1)), ("a", "2", at(28, month=9)), ("b", "2", at(2)), ("b", "x", at(4))])
    assert ledger.append(again, now=NOW) == {"seen": 4, "new": 1, "unchanged": 3}
    assert {r[:3] for r in map(tuple, ledger.read("events").select("actor_id", "external_id", "ts").collect())} == {("a", "1", at(1)), ("a", "2", at(1, 5)), ("b", "1", at(2)), ("b", "2", at(2)), (None, "1", at(3)), ("b", "x", None)}
    assert ledger.append(spark.createDataFrame([], COLS), now=NOW)["new"] == 0


def test_a_batch_with_a_tag_counts_once(spark, ledger):
    rows = traces(spark, [("a", "1", at(1))])
    assert ledger.append(rows, tag="q:0", now=NOW)["new"] == 1
    assert ledger.append(traces(spark, [("a", "9", at(1))]), tag="q:0", now=NOW) == {"seen": 0, "new": 0, "unchanged": 0}
    assert content(ledger) == [("a", "1")]


def test_a_cursor_is_the_newest_time_that_is_not_in_the_future(spark, ledger):
    ledger.append(traces(spark, [("a", "1", at(1)), ("a", "2", at(9)), ("a", "3", at(30, month=6)), ("b", "1", at(20))]), now=NOW)
    cursor = lambda: {r.actor_id: r.cursor for r in ledger.read("cursors").collect()}
    assert cursor() == {"a": at(9)}
    ledger.append(traces(spark, [("a", "4", at(3)), ("b", "2", at(4))]), now=NOW)
    assert cursor() == {"a": at(9), "b": at(4)}
    rows = traces(spark, [("a", "5", at(1, 23 * 60)), ("a", "6", at(2)), ("b", "7", at(1)), ("c", "8", at(1))])
    assert {r.external_id for r in ledger.since_cursor(rows).collect()} == {"6", "7", "8"}


def test_files_that_did_not_change_are_not_read(spark, ledger, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.csv").write_text("a,1,2026-05-01 10:00:00\n")
    read = []

    def reader(paths):
        read.append([p.rsplit("/", 1)[1] for p in paths])
        r = spark.read.schema("actor_id string, external_id string, ts timestamp").csv(paths)
        return r.select("*", F.lit("browser").alias("source"))

    assert ledger.import_files(f"file://{source}", reader, now=NOW) == {"files": 1, "seen": 1, "new": 1, "unchanged": 0}
    assert ledger.import_files(f"file://{source}", reader, now=NOW)["files"] == 0
    (source / "two.csv").write_text("a,1,2026-05-01 10:00:00\na,2,2026-05-02 10:00:00\n")
    assert ledger.import_files(f"file://{source}", reader, now=NOW) == {"files": 1, "seen": 2, "new": 1, "unchanged": 1}
    (source / "one.csv").write_text("a,3,2026-05-03 10:00:00,longer than before\n")
    assert ledger.import_files(f"file://{source}", reader, now=NOW)["new"] == 1
    assert read == [["one.csv"], ["two.csv"], ["one.csv"]]


def window(ledger, feed, whole=True, now=NOW, instances=None):
    asked = ledger.spark.createDataFrame(instances or [("a", "calendar", "work", whole)], "actor_id string, source string, entrypoint string, whole boolean")
    got = ledger.replace_window(feed, asked, "2026-05-01", "2026-05-08", now=now)
    return tuple(got[n] for n in ("new", "moved", "unchanged", "removed", "refused"))


def test_a_restated_window(spark, ledger):
    ledger.append(traces(spark, [("a", "keep", at(2), 10), ("a", "move", at(3), 10), ("a", "name", at(3), 10, "old"), ("a", "gone", at(4), 10), ("a", "early", at(1, -30), 60), ("a", "later", at(20), 5), ("a", "other", at(4), 5, "t", "home"), ("b", "gone", at(4), 10)]), now=dt.datetime(2026, 5, 1))
    feed = traces(spark, [("a", "keep", at(2), 10), ("a", "move", at(6), 10), ("a", "name", at(3), 10, "new"), ("a", "early", at(1, -30), 90), ("a", "fresh", at(5), 7)])
    assert window(ledger, feed) == (1, 3, 1, 1, 0)
    assert content(ledger, "ts", "duration_ms", "title") == sorted(
        [("a", "keep", at(2), 10, "t"), ("a", "move", at(6), 10, "t"), ("a", "name", at(3), 10, "new"), ("a", "early", at(1, -30), 90, "t"), ("a", "fresh", at(5), 7, "t"), ("a", "later", at(20), 5, "t"), ("a", "other", at(4), 5, "t"), ("b", "gone", at(4), 10, "t")]
    )
    seen = {r.external_id: r.ingested_at.day for r in ledger.read("events").where("actor_id = 'a'").collect()}
    assert seen["move"] == 1 and seen["fresh"] == 10  # when it was first seen stays
    before = ledger.commits().count()
    assert window(ledger, feed) == (0, 0, 5, 0, 0) and ledger.commits().count() == before
    assert ledger.append(traces(spark, [("a", "gone", at(4), 10), ("a", "fresh", at(9)), ("a", "move", at(3))]), now=NOW)["new"] == 1  # removed ones may come again, moved ones are known


def test_nothing_goes_unless_the_feed_was_read_whole(spark, ledger):
    ledger.append(traces(spark, [("a", "1", at(2)), ("a", "2", at(3)), ("b", "1", at(2))]), now=NOW)
    assert window(ledger, traces(spark, [("a", "3", at(4))]), whole=False) == (1, 0, 0, 0, 2)
    assert len(content(ledger)) == 4
    assert window(ledger, traces(spark, []).limit(0), instances=[("a", "calendar", "work", True), ("b", "calendar", "work", False)]) == (0, 0, 0, 3, 1)
    assert content(ledger) == [("b", "1")]


def test_a_failed_run_leaves_the_ledger_as_it_was(spark, ledger):
    ledger.append(traces(spark, [("a", "1", at(2)), ("a", "2", at(3))]), now=NOW)
    before = content(ledger)
    bad = traces(spark, [("a", "3", at(4))]).withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        ledger.append(bad, now=NOW)
    with pytest.raises(Exception, match="lost"):
        window(ledger, bad)
    # written, but not committed
    rows = ledger.placed(ledger.whole(traces(spark, [("a", "4", at(4))]), F.lit(NOW)))
    ledger.write(Change("events", rows), "00000000000000000009-dead")
    assert content(ledger) == before


def test_parts_that_are_not_touched_keep_their_files(spark, ledger):
    ledger.append(traces(spark, [("a", str(d), at(d)) for d in range(1, 8)]), now=NOW)
    files = lambda: {(r.part_day, r.version) for r in ledger.live("events").collect()}
    before = files()
    assert window(ledger, traces(spark, [("a", str(d), at(d)) for d in range(1, 8) if d != 3])) == (0, 0, 6, 1, 0)
    assert {d for d, _ in before - files()} == {"2026-05-03"} and {d for d, _ in files() - before} == {"2026-05-03"}
    assert ledger.vacuum() > 0 and len(content(ledger)) == 6


def built(e):
    b = blocks.attributed(rules.named(e))
    h = stretches.head_tail(b)
    s = stretches.stretches(stretches.pieces(h))
    return {"project_rows": rollup.project_rows(b, s)}


def events(spark, ids):
    rows = [("ab"[i % 2], "agent-log", f"e{i:03d}", at(1 + i % 4, 600 + 7 * i), None, "user", "prompt", "", "", ["x", "y", ""][i % 3]) for i in ids]
    return spark.createDataFrame(rows, COLS).select("*", F.lit("s").alias("session_id"), F.lit("/w").alias("cwd"))


def test_late_traces_change_their_days_as_a_full_run_does(spark, tmp_path):
    schema = built(entries(spark.createDataFrame([], SCHEMA)))["project_rows"].schema
    ledger = Ledger(spark, f"file://{tmp_path}/l", buckets=2, tables={"project_rows": schema})
    land = tmp_path / "land"
    land.mkdir()
    every = [i for i in range(60)]
    first = [i for i in every if i % 4 != 2 or i < 20]
    stream = spark.readStream.schema(events(spark, []).schema).parquet(f"file://{land}")
    run = lambda frozen=None: Z.stream_touched_days(stream, ledger, built, f"file://{tmp_path}/state", frozen=frozen, now=NOW).awaitTermination()
    events(spark, first).write.mode("append").parquet(f"file://{land}")
    run()
    full = lambda ids: built(entries(ledger.whole(events(spark, ids), F.lit(NOW))))["project_rows"]
    same = lambda ids: ledger.read("project_rows").exceptAll(full(ids)).count() == 0 and full(ids).exceptAll(ledger.read("project_rows")).count() == 0
    assert same(first) and ledger.read("project_rows").count() > 0
    before = {(r.part_day, r.bucket, r.version) for r in ledger.live("project_rows").collect()}
    frozen = ledger.read("project_rows").groupBy("actor_id", "local_day").agg(F.sum("events").alias("events"))
    frozen = spark.createDataFrame(frozen.collect(), frozen.schema)
    events(spark, every).write.mode("append").parquet(f"file://{land}")
    run(frozen)
    assert same(every)
    after = {(r.part_day, r.bucket, r.version) for r in ledger.live("project_rows").collect()}
    late = {i for i in every if i not in first}
    days = {at(1 + i % 4, 600 + 7 * i).date().isoformat() for i in late}
    assert {d for d, _, _ in after - before} == days and before & after
    assert {(r.actor_id, r.local_day.isoformat()) for r in ledger.read("disturbed").collect()} == {("ab"[i % 2], at(1 + i % 4, 600 + 7 * i).date().isoformat()) for i in late}


def test_a_stream_stores_an_identity_once_over_all_runs(spark, ledger, tmp_path):
    land = f"file://{tmp_path}/land"
    events(spark, range(10)).write.parquet(land)
    source = spark.readStream.schema(events(spark, []).schema).parquet(land)
    for run, days in (("one", 0), ("two", 40), ("three", -300)):
        moved = source.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(days)))
        Z.stream_ingest(moved, ledger, f"file://{tmp_path}/{run}", now=NOW).awaitTermination()
    assert ledger.read("events").count() == 10 and ledger.read("events").where("month(ts) <> 5").count() == 0
