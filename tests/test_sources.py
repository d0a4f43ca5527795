"""Scalars, rules by hand, sources, frozen days and streams."""

import datetime as dt

from pyspark.sql import functions as F

from dayloom.functions import scalars as S
from dayloom.operators import confirm, rules
from dayloom.sources import feeds
from dayloom.sources import traces as T
from dayloom.sources.ledger import Change, Ledger
from dayloom.streaming import stream


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").orderBy("i").select(column(F.col("s"))).collect()]


def test_hosts(spark):
    got = one(spark, S.canonical_host, "Example.COM.", "[2001:0db8:0:0:0:0:0:1]", "1:0:0:2:0:0:0:3", "::", "192.0.2.1", None)
    assert got == ["example.com", "2001:db8::1", "1:0:0:2::3", "::", "192.0.2.1", ""]


def test_path_heads(spark):
    assert one(spark, S.path_head, "/a+b/c", "//x%20y?z", "/%E4%BD%A0/", "", None, "/" + "a" * 99) == ["a+b", "x y", "你", "", "", "a" * 64]


def test_durations_verbs_and_escapes(spark):
    assert one(spark, S.iso_duration, "PT1H30M", "P1W", "-P1DT2S", "P", "PT", None) == [5_400_000_000, 604_800_000_000, -86_402_000_000, None, None, None]
    assert one(spark, S.reflog_verb, "commit (amend): x", "rebase -i (pick): y", "Unheard: z", "") == ["commit (amend)", "rebase (pick)", "other", "other"]
    assert one(spark, S.unescape_ical, r"a\, b\; c\nd \\n") == ["a, b; c\nd \\n"]


def test_days_of_23_hours(spark):
    df = spark.createDataFrame([(dt.date(2026, 3, 29),), (dt.date(2026, 3, 30),)], "d date")
    start, end = S.day_bounds(F.col("d"), F.lit("Europe/Berlin"))
    assert [r[0] for r in df.select(((end - start) / 3_600_000_000).cast("int")).collect()] == [23, 24]


def resolve(spark, written, **target):
    base = {"actor_id": "a", "source": "agent-log", "external_id": "1", "ts": dt.datetime(2026, 5, 4, 9), "duration_ms": None, "type": "user", "raw_text": "prompt", "is_sidechain": False, "session_id": "", "cwd": "", "project": "guess", "git_branch": "", "host": "", "port": "", "path_head": "", "title": ""}
    schema = "actor_id string, source string, external_id string, ts timestamp, duration_ms bigint, type string, raw_text string, is_sidechain boolean, session_id string, cwd string, project string, git_branch string, host string, port string, path_head string, title string"
    row = base | target
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(written)], "rule_id int, actor_id string, level string, project string, subject string, kind string, value string, since string")
    x = rules.named(T.entries(spark.createDataFrame([tuple(row.values())], schema)), r).first()
    return x.project, x.subject, x.by_rule, x.covered


def test_rules_by_hand(spark):
    p = lambda name, kind, value, since=None, actor=None: (actor, "project", name, "", kind, value, since)
    never = lambda kind, value: (None, "never", "", "", kind, value, None)
    assert resolve(spark, [p("x", "path", "/src/thing"), p("y", "path", "/src/thing/proto")], cwd="/src/thing/proto/z/")[0] == "y"
    assert resolve(spark, [p("x", "path", "/src/thing")], cwd="/src/thing-other") == ("guess", "", False, False)
    assert resolve(spark, [p("x", "path", "/src/thing*")], cwd="/src/thing-a1")[0] == "x"
    assert resolve(spark, [p("x", "path", "/s"), p("y", "path", "/s", "2026-05-01"), p("z", "path", "/s", "2026-06-01")], cwd="/s")[0] == "y"
    assert resolve(spark, [p("x", "path", "/s"), p("y", "path", "/s")], cwd="/s")[0] == "x"
    assert resolve(spark, [never("path", "/home"), p("x", "path", "/home/src")], cwd="/home") == ("", "", False, True)
    assert resolve(spark, [never("path", "/home"), p("x", "path", "/home/src")], cwd="/home/src/a")[0] == "x"
    assert resolve(spark, [p("x", "path", "/s", None, "b"), p("y", "path", "/s", None, "a")], cwd="/s")[0] == "y"
    web = {"source": "browser", "project": ""}
    assert resolve(spark, [p("x", "key", "example.com"), p("y", "key", "example.com/issues")], host="sub.example.com", path_head="issues", **web)[0] == "y"
    assert resolve(spark, [p("x", "key", "10")], host="192.0.2.10", **web)[0] == ""
    assert resolve(spark, [p("x", "key", "h.example:3000")], host="h.example", port="3000", **web)[0] == "x"
    sub = [(None, "subject", "", "", "title", r"\b([A-Z]+-\d+)\b", None), (None, "subject", "x", "own", "title", "thing", None)]
    assert resolve(spark, [p("x", "path", "/s"), *sub], cwd="/s", title="AB-12 thing") == ("x", "own", True, True)
    assert resolve(spark, sub, title="AB-12 thing") == ("guess", "AB-12", False, False)


def test_dead_rules(spark):
    rows = [(0, None, "never", "", "", "key", "example.com", None), (1, None, "project", "x", "", "key", "example.com", None), (2, None, "project", "y", "", "key", "example.com/long", None), (3, None, "project", "z", "", "key", "h:443", None), (4, None, "subject", "", "", "title", "no group", None)]
    r = spark.createDataFrame(rows, "rule_id int, actor_id string, level string, project string, subject string, kind string, value string, since string")
    assert {(x.rule_id, x.problem) for x in rules.dead_rules(r).collect()} == {(1, "covered by never"), (3, "default port"), (4, "no capture")}


def test_recurrence_keeps_the_clock_over_summer_time(spark):
    rows = [("d", "FREQ=DAILY;COUNT=4", "2026-03-27 09:00:00"), ("w", "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,FR;COUNT=5", "2026-03-02 09:00:00"), ("m", "FREQ=MONTHLY;BYMONTHDAY=-1", "2026-01-31 10:00:00"), ("s", "FREQ=MONTHLY", "2026-01-31 10:00:00"), ("o", "FREQ=MONTHLY;BYDAY=2TU", "2026-01-01 08:00:00"), ("1", None, "2026-03-30 07:00:00")]
    df = spark.createDataFrame(rows, "uid string, rrule string, s string").withColumn("start_local", F.col("s").cast("timestamp")).withColumn("tzid", F.lit("Europe/Berlin"))
    got = {}
    for r in feeds.expand_recurrence(df.select("uid", "rrule", "start_local", "tzid"), "2026-03-01", "2026-05-01").orderBy("at").collect():
        got.setdefault(r.uid, []).append(r["at"].strftime("%m-%d %H"))
    assert got["d"] == ["03-27 08", "03-28 08", "03-29 07", "03-30 07"]
    assert got["w"] == ["03-02 08", "03-06 08", "03-16 08", "03-20 08", "03-30 07"]
    assert got["m"] == ["03-31 08", "04-30 08"] and got["s"] == ["03-31 08"]
    assert got["o"] == ["03-10 07", "04-14 06"] and got["1"] == ["03-30 05"]


def test_recurrence_under_a_day_and_its_outcomes(spark):
    rules = {"h": "FREQ=HOURLY;INTERVAL=2", "c": "FREQ=MINUTELY;INTERVAL=20;COUNT=5", "b": "FREQ=HOURLY;BYDAY=SU;COUNT=3", "u": "FREQ=HOURLY;INTERVAL=6;UNTIL=20260328T120000", "s": "FREQ=SECONDLY", "e": "FREQ=SECONDLY;BYMONTH=12", "x": "FREQ=DAILY;BYSETPOS=1", "y": "FREQ=OFTEN", "d": "FREQ=DAILY"}
    df = spark.createDataFrame(list(rules.items()), "uid string, rrule string").selectExpr("*", "timestamp '2026-03-28 00:00:00' as start_local", "'Europe/Berlin' as tzid")
    got = {}
    for r in feeds.expand_recurrence(df, "2026-03-28", "2026-04-02").orderBy("at").collect():
        got.setdefault(r.uid, []).append((r["at"] and r["at"].strftime("%d %H:%M"), r.outcome))
    assert [t for t, _ in got["h"]][:13] == [f"28 {h:02}:00" for h in range(1, 24, 2)] + ["29 01:00"] and len(got["h"]) == 60
    assert [t for t, _ in got["c"]] == ["28 00:00", "28 00:20"]  # the first three are before the window
    assert [t for t, _ in got["b"]] == ["28 23:00", "29 00:00", "29 01:00"]
    assert [t for t, _ in got["u"]] == ["28 05:00", "28 11:00"]
    assert {o for k in "hcbud" for _, o in got[k]} == {"expanded"} and len(got["d"]) == 5
    assert len(got["s"]) == 10001 and {o for _, o in got["s"]} == {"truncated"} and got["e"] == [(None, "truncated")]
    assert got["x"] == got["y"] == [(None, "unexpanded")]


def test_declined_meetings_are_refused(spark):
    event = lambda i, who: f"BEGIN:VEVENT\r\nUID:{i}\r\nDTSTART:20260328T090000\r\nDURATION:PT1H\r\n{who}END:VEVENT\r\n"
    who = ["", "ATTENDEE;CN=Me;PARTSTAT=DECLINED:mailto:Me@example.com\r\n", "ATTENDEE;PARTSTAT=ACCEPTED:mailto:me@example.com\r\n", "ATTENDEE;PARTSTAT=declined:mailto:you@example.com\r\n"]
    text = "BEGIN:VCALENDAR\r\n" + "".join(event(i, w) for i, w in enumerate(who)) + "END:VCALENDAR\r\n"
    events = feeds.ical_times(feeds.events_of(feeds.scan_ical(spark.createDataFrame([("f", text)], "feed string, value string"))), "UTC")
    assert {r.uid: r.reason for r in feeds.meeting_filter(events, (" me@Example.com",)).collect()} == {"0": "kept", "1": "declined-by-me", "2": "kept", "3": "kept"}
    assert {r.reason for r in feeds.meeting_filter(events).collect()} == {"kept"}



RULE = "rule_id int, actor_id string, level string, project string, subject string, kind string, value string, since string"


def test_frozen_days_are_replaced_and_read_when_complete(spark, tmp_path):
    part = lambda n, e, hash="h1": spark.createDataFrame([("a", dt.date(2026, 5, 4), e, hash)], f"actor_id string, local_day date, {n} int, rules_hash string")
    every = lambda e, hash="h1": {n: part("events", e, hash) for n in confirm.TABLES}
    book = confirm.frozen_ledger(spark, f"file://{tmp_path}/book", every(1))
    for e in (1, 2):
        confirm.confirm_snapshot(every(e), book)
    other = every(9)
    other["projects"] = other["projects"].unionByName(other["projects"].withColumn("actor_id", F.lit("b")))  # b isn't frozen
    confirm.confirm_snapshot(other, book)
    book.write(Change("projects", part("events", 7).withColumns({"part_day": F.lit("2026-05-04"), "bucket": F.lit(0)})), "99999999999999999999-x")  # never committed
    got = confirm.snapshot_read(book)
    assert [(r.actor_id, r.events) for r in got["projects"].collect()] == [("a", 9)] and got["days"].count() == 1
    # confirmed again without subjects, it keeps none of before; another day stays
    june = {n: df.withColumn("local_day", F.lit("2026-06-04").cast("date")) for n, df in every(5).items()}
    confirm.confirm_snapshot(june, book)
    confirm.confirm_snapshot({n: df.limit(0 if n == "subjects" else 1) for n, df in every(3).items()}, book)
    got = confirm.snapshot_read(book)
    assert sorted(r.events for r in got["projects"].collect()) == [3, 5] and [r.events for r in got["subjects"].collect()] == [5]
    assert book.vacuum() > 0 and sorted(r.events for r in confirm.snapshot_read(book)["projects"].collect()) == [3, 5]


def test_a_frozen_day_keeps_the_rules_it_was_worked_out_with(spark, tmp_path):
    days = lambda d, h: spark.createDataFrame([("a", dt.date(2026, 5, d), 1, h)], "actor_id string, local_day date, events int, rules_hash string")
    rules_ = lambda *v: spark.createDataFrame([(i, a, "project", x, "", "path", f"/{x}", None) for i, (a, x) in enumerate(v)], RULE)
    book = confirm.frozen_ledger(spark, f"file://{tmp_path}/book", {n: days(1, "") for n in confirm.TABLES})
    for d, h, r in ((1, "h1", rules_((None, "x"), ("a", "y"), ("b", "z"))), (2, "h2", rules_((None, "w"))), (3, "h1", rules_((None, "not looked at")))):
        confirm.confirm_snapshot({n: days(d, h) for n in confirm.TABLES}, book, r)
    assert sorted((r.local_day.day, r.project) for r in confirm.frozen_rules(book).collect()) == [(1, "x"), (1, "y"), (2, "w"), (3, "x"), (3, "y")]


def test_a_timeline_has_its_pauses_and_claims(spark):
    day = dt.date(2026, 5, 4)
    s = spark.createDataFrame([("a", day, 0, 10, "x"), ("a", day, 10, 30, "x"), ("a", day, 50, 60, "y"), ("a", day, 60, 60, "z"), ("a", day, 90, 95, "y")], "actor_id string, local_day date, from_us long, to_us long, owner string")
    p = spark.createDataFrame([("a", day, 30, 50, True, "lunch", 1), ("a", day, 30, 50, True, "talk", 2), ("a", day, 60, 80, True, "part", 1), ("a", day, 60, 90, False, "no", 2)], "actor_id string, local_day date, from_us long, to_us long, worked boolean, project string, answered_at int")
    got = [(r.nth, r.from_us, r.to_us, r.project, r.gap, r.claimed) for r in confirm.export_timeline(s, p).orderBy("nth").collect()]
    assert got == [(1, 0, 30, "x", False, False), (2, 30, 50, "talk", True, True), (3, 50, 60, "y", False, False), (4, 60, 90, "", True, False), (5, 90, 95, "y", False, False)]
    assert confirm.snapshot_span(s).first().span_us == 95


def test_one_persons_rules_move_their_days_alone(spark):
    schema = "rule_id int, actor_id string, value string"
    rules_ = spark.createDataFrame([(0, None, "x"), (1, "a", "y"), (2, "b", "z")], schema)
    days = spark.createDataFrame([(x, dt.date(2026, 5, 4), 1) for x in "abc"], "actor_id string, local_day date, events int")
    frozen = confirm.with_rules_hash(days, rules_)
    moved = lambda r: sorted(x.actor_id for x in confirm.rules_moved(frozen, spark.createDataFrame(r, schema)).collect())
    assert moved([(2, "b", "z"), (0, None, "x"), (1, "a", "y")]) == []
    assert moved([(0, None, "x"), (1, "a", "changed"), (2, "b", "z")]) == ["a"]
    assert moved([(0, None, "x"), (1, "a", "y"), (2, "b", "z"), (3, "c", "new")]) == ["c"]
    assert moved([(0, None, "changed"), (1, "a", "y"), (2, "b", "z")]) == ["a", "b", "c"]


def agent_lines(path, ids):
    path.write_text("".join(f'{{"type":"user","uuid":"{i}","timestamp":"2026-05-04T09:{i % 60:02d}:00Z","sessionId":"s","message":{{"content":"hi"}}}}\n' for i in ids) + "{broken\n")


def test_ingest_stream_takes_each_identity_once(spark, tmp_path):
    src, book, ck = tmp_path / "in", Ledger(spark, f"file://{tmp_path}/out"), str(tmp_path / "ck")
    src.mkdir()
    for name, ids in (("a.jsonl", range(5)), ("b.jsonl", range(3, 9))):
        agent_lines(src / name, ids)
        rows = stream.read_lines(spark, str(src)).withColumn("actor_id", F.lit("a")).drop("outcome")
        stream.stream_ingest(rows, book, ck).awaitTermination()
    assert sorted(int(r.external_id) for r in book.read("events").collect()) == list(range(9))


def test_block_and_count_streams(spark, tmp_path):
    base = spark.createDataFrame([("a", "browser", str(i), dt.datetime(2026, 5, 4, 9) + dt.timedelta(minutes=m), None, "visit", "", False, "", "", "", "", "h", "", "", "") for i, m in enumerate([0, 10, 20, 40, 41])], "actor_id string, source string, external_id string, ts timestamp, duration_ms bigint, type string, raw_text string, is_sidechain boolean, session_id string, cwd string, project string, git_branch string, host string, port string, path_head string, title string")
    late = base.limit(1).withColumn("ts", F.lit("2026-06-04 09:00:00").cast("timestamp")).withColumn("external_id", F.lit("late"))
    base.unionByName(base.limit(2)).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    entries = T.entries(stream.stream_dedup(rows))

    def result(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    again = tmp_path / "more"
    got = result(stream.stream_blocks(T.entries(rows)), "blocks").orderBy("from_us").collect()
    assert [r.events for r in got[:2]] == [5, 2] and not again.exists()
    assert result(stream.stream_counts(rows), "counts").count() <= 2
    assert result(entries, "once").count() == 6


def feed(*events):
    return "\ufeffBEGIN:VCALENDAR\r\n" + "".join("BEGIN:VEVENT\r\n" + "".join(f"{x}\r\n" for x in e) + "END:VEVENT\r\n" for e in events) + "END:VCALENDAR\r\n"


def test_events_with_alarms_odd_zones_and_bad_dates(spark):
    text = feed(
        ("UID:a", "SUMMARY:real", "DTSTART;TZID=Europe/Berlin:20260302T090000", "DTEND;TZID=Europe/London:20260302T090000", "BEGIN:VALARM", "SUMMARY:alarm", "DURATION:PT5M", "END:VALARM"),
        ("UID:b", 'DTSTART;TZID="W. Europe Standard Time":20260302T090000', "DURATION:PT1H", "EXDATE:20260309T090000,nonsense", "RDATE:20260310T090000"),
        ("SUMMARY:no uid", "DTSTART:20260302T090000Z", "DURATION:PT1H"),
        ("UID:" + "u" * 600, "DTSTART:20260302T090000Z", "DURATION:PT1H"),
        ("UID:c", "DTSTART:rubbish", "DURATION:PT1H"),
        ("UID:d", "DTSTART:20260302T090000Z", "DTEND:20260302T080000Z"),
    )
    events = feeds.ical_times(feeds.events_of(feeds.scan_ical(spark.createDataFrame([("f", text)], "feed string, value string"))), "Asia/Tokyo")
    got = {r.event: r for r in feeds.meeting_filter(events).collect()}
    assert [got[i].reason for i in range(6)] == ["kept", "kept", "no uid", "uid too long", "unreadable", "negative"]
    assert got[0].title == "real" and got[0].length_us == 3_600_000_000 and got[0].unknown_zone is None
    assert got[1].tzid == "Asia/Tokyo" and got[1].unknown_zone == "W. Europe Standard Time" and got[1].bad_dates == 1 and got[0].bad_dates == 0


def test_an_occurrence_that_runs_into_the_window_is_in(spark):
    rows = [("a", "2026-03-01 23:00:00", "FREQ=DAILY;COUNT=3", 2 * 3_600_000_000), ("b", "2026-03-01 22:00:00", "FREQ=DAILY;COUNT=3", 2 * 3_600_000_000), ("c", "2026-02-27 00:00:00", None, 4 * 86_400_000_000), ("h", "2026-03-01 22:30:00", "FREQ=HOURLY;COUNT=4", 3_600_000_000)]
    df = spark.createDataFrame(rows, "uid string, s string, rrule string, length_us long").selectExpr("uid", "rrule", "cast(s as timestamp) as start_local", "'UTC' as tzid", "length_us")
    got = {}
    for r in feeds.expand_recurrence(df, "2026-03-02", "2026-03-03").orderBy("at").collect():
        got.setdefault(r.uid, []).append(r.at.strftime("%d %H:%M"))
    assert got == {"a": ["01 23:00", "02 23:00"], "b": ["02 22:00"], "c": ["27 00:00"], "h": ["01 23:30", "02 00:30", "02 01:30"]}


def test_a_broken_override_leaves_its_occurrence(spark):
    df = lambda *r: spark.createDataFrame(r, "uid string, at string, reason string").withColumn("at", F.col("at").cast("timestamp"))
    days = [df(("a", f"2026-03-0{k} 09:00:00", reason)) for k, reason in ((1, None), (2, "kept"), (3, "unreadable"), (4, None), (5, None))]
    every = days[0].unionByName(days[1]).unionByName(days[2]).unionByName(days[3])
    got = feeds.recurrence_overrides(every, days[3], days[1].unionByName(days[2]), days[4])
    assert sorted(r["at"].day for r in got.collect()) == [1, 3, 5]


def test_entries_of_an_ignore_list(spark):
    entries = {
        " HTTPS://Example.org/ ": ("example.org", None), "[::1]": ("::1", None), "0:0:0:0:0:0:0:1": ("::1", None), "localhost": ("localhost", None), "..a.b..": ("a.b", None), "10.0.0.1": ("10.0.0.1", None),
        "localhost:3000": (None, "not a domain"), "*.example.com": (None, "not a domain"), "example.com/watch": (None, "not a domain"), "me@example.com": (None, "not a domain"), "a..b": (None, "not a domain"), "a b.org": (None, "not a domain"),
        "so­ft.org": ("so�ft.org", "unseen character"), "": (None, None), " ./ ": (None, None), None: (None, None),
    }
    got = feeds.ignore_entries(spark.createDataFrame([(d,) for d in entries], "domain string")).collect()
    assert {r.domain: (r.host, r.problem) for r in got} == entries


def test_addresses_and_unseen_characters_of_hosts(spark):
    hosts = {"1.2.3.4": True, "999.1.1.1": False, "1.2.3": False, "01.2.3.4": False, "255.255.255.255": True, "fe80::1": True, "a.b": False}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: r.a for r in df.select("h", S.is_address(F.col("h")).alias("a")).collect()} == hosts
    odd = spark.createDataFrame([("EX​ample.org.",)], "h string")
    assert odd.select(S.canonical_host(F.col("h"))).first()[0] == "ex�ample.org"
