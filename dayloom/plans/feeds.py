"""Queries over the sources, the review queue and frozen days."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blocks
from ..operators import confirm as C
from ..operators import review as V
from ..operators import rollup as U
from ..operators import stretches as T
from ..sources import feeds as X
from ..sources import fixtures, store
from ..sources import traces as T2
from ..sources.ledger import Ledger, outcomes
from ..streaming import stream as Z
from .oracle import after

D = ("actor_id", "local_day")
DS = "actor_id, local_day"
#: Of named entries, what project rows are made of: a large day is laid out several times, which takes as long as its rows are wide.
NAMED = (*T2.ORD, *D, "end_us", "span_us", "day_start_us", "day_end_us", "gap_us", "window_us", "head_us", "tail_us", "touch", "owns", "session_id", "path", "key", "project", "subject", "by_rule", "covered", "ambiguous")
#: Rows of an actor-day beyond which it is cut into slices there: with so few columns, a task holds more rows, and slices take several exchanges where a whole day takes one.
LARGE_DAY = 100_000


def table(c, name):
    return c.spark.read.parquet(f"{c.sf_dir}/{name}.parquet")


def log_lines(c):
    t = table(c, "conversations")
    line = F.to_json(
        F.struct(
            F.col("role").alias("type"),
            F.when(F.col("role") != "system", F.concat_ws("-", "conv_id", "turn")).alias("uuid"),
            F.date_format(F.expr("timestamp '2024-01-01' + make_dt_interval(0, cast(conv_id as int), cast(turn as int))"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.concat(F.lit("c"), F.col("conv_id")).alias("sessionId"),
            F.concat(F.lit("/work/p"), F.col("conv_id") % 7, F.lit("/")).alias("cwd"),
            F.struct(F.when(F.col("role") == "assistant", "model-a").alias("model"), F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("Read").alias("name")))).alias("content")).alias("message"),
        )
    )
    return t.select(F.when(F.col("turn") % 5 == 4, F.lit("{broken")).otherwise(line).alias("value"))


LOG_SQL = """SELECT CASE WHEN turn % 5 = 4 THEN 'malformed' WHEN role = 'system' THEN 'skipped' ELSE 'found' END AS outcome, * FROM conversations"""


def chrome(c):
    v = table(c, "events").where("event_type in ('click', 'view')").select(F.col("event_id").alias("id"), (F.col("event_id") % 300).alias("url"), (F.unix_micros(F.col("ts").cast("timestamp")) + X.SINCE_1601_US).alias("visit_time"), (F.col("event_id") % 11 + 805306368).alias("transition"))
    return X.scan_visits_chrome(v, table(c, "pages").select(F.col("page_id").alias("id"), "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title")))


def firefox(c):
    v = table(c, "events").where("event_type in ('click', 'view')").select(F.col("event_id").alias("id"), (F.col("event_id") % 300).alias("place_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("visit_date"), (F.col("event_id") % 9 + 1).alias("visit_type"))
    return X.scan_visits_firefox(v, table(c, "pages").select(F.col("page_id").alias("id"), "url", F.lit("").alias("title")))


def visits(c):
    return table(c, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))


def ignored(c):
    return c.spark.createDataFrame([("example.org",), ("Blog.tionsh.example.net.",)], "domain string")


def written_entries(c):
    """The hosts of all pages as somebody might write them into a list, with what becomes of each."""
    host = F.expr("try_parse_url(url, 'HOST')")
    shapes = [host, F.concat(F.lit("https://"), host, F.lit("/")), F.concat(host, F.lit(":8080")), F.concat(F.lit("*."), host), F.concat(F.lit("so\u00adft."), host), F.concat(F.lit("a "), host), F.lit(" . ")]
    e = table(c, "pages").select("page_id", F.get(F.array(*shapes), (F.col("page_id") % len(shapes)).cast("int")).alias("domain"))
    return X.ignore_entries(e).select("page_id", "host", "problem")


HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"
VISIT_SQL = f"""SELECT page_id, 'kept' AS outcome, lower({HOST}) AS host, CASE WHEN regexp_extract(url, '^https?://[^/:?#]+:([0-9]+)', 1) IN ('80', '443') THEN '' ELSE regexp_extract(url, '^https?://[^/:?#]+:([0-9]+)', 1) END AS port,
 regexp_extract(url, '^https?://[^/?#]+/+([^/?#]*)', 1) AS path_head FROM pages"""


ENTRIES = f"""SELECT page_id, CASE page_id % 7 WHEN 0 THEN h WHEN 1 THEN h WHEN 4 THEN 'so' || chr(65533) || 'ft.' || h END AS host, CASE WHEN page_id % 7 IN (2, 3, 5) THEN 'not a domain' WHEN page_id % 7 = 4 THEN 'unseen character' END AS problem FROM (SELECT page_id, lower({HOST}) AS h FROM pages)"""


def reflog_lines(c):
    k = F.col("l_orderkey").cast("string")
    ref = F.element_at(F.array(F.lit("refs/heads/main"), F.lit("HEAD"), F.lit("refs/remotes/origin/main")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    verb = F.when(F.col("l_orderkey") % 3 == 0, "commit (amend): x").when(F.col("l_orderkey") % 3 == 1, "checkout: moving from a to b").otherwise("unheard of: y")
    value = F.concat(F.sha1(F.concat(F.lit("o"), k)), F.lit(" "), F.sha1(F.concat(F.lit("n"), k)), F.lit(" A B <a@example.com> "), (F.lit(1_700_000_000) + F.col("l_orderkey") * 60).cast("string"), F.lit(" +0000\t"), verb)
    return table(c, "lineitem").select(F.concat(F.lit("/src/repo"), F.col("l_orderkey") % 5, F.lit("/.git/logs/"), ref).alias("path"), value.alias("value"))


REF_SQL = """SELECT 'repo' || CAST(l_orderkey % 5 AS VARCHAR) AS repo, sha1('o' || CAST(l_orderkey AS VARCHAR)) AS old, sha1('n' || CAST(l_orderkey AS VARCHAR)) AS new, 1700000000 + l_orderkey * 60 AS at_s,
 CASE l_orderkey % 3 WHEN 0 THEN 'commit (amend)' WHEN 1 THEN 'checkout' ELSE 'other' END AS verb, CASE l_linenumber % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'HEAD' ELSE 'origin/main' END AS ref, CAST(l_linenumber % 3 AS INT) AS rank FROM lineitem"""


def feeds(c):
    """Calendar feeds made of orders, a feed for each of 97 groups of customers."""
    o = table(c, "orders").withColumn("k", F.col("o_orderkey").cast("string"))
    crlf = "\r\n"
    event = F.concat_ws(
        crlf, F.lit("BEGIN:VEVENT"), F.when(F.col("o_orderkey") % 17 != 0, F.concat(F.lit("UID:"), "k")),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(f"BEGIN:VALARM{crlf}SUMMARY:alarm{crlf}DURATION:PT5M{crlf}END:VALARM")), F.concat(F.lit("SUMMARY:a\\, b\\; "), F.lit(crlf + " "), "k"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("o_orderdate", "yyyyMMdd"))).otherwise(F.concat(F.lit("DTSTART;TZID="), F.when(F.col("o_orderkey") % 11 == 0, "W. Europe Standard Time").otherwise("Europe/Berlin"), F.lit(":"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"))),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("DURATION:PT1H30M")), F.when(F.col("o_orderkey") % 7 == 0, F.lit("STATUS:CANCELLED")), F.lit("END:VEVENT"), F.lit(""),
    )
    body = o.groupBy((F.col("o_custkey") % 97).alias("feed")).agg(F.array_join(F.sort_array(F.collect_list(event)), "").alias("body"))
    end = F.when(F.col("feed") == 5, "").otherwise("END:VCALENDAR" + crlf)  # one feed is cut off
    return body.select("feed", F.concat(F.when(F.col("feed") == 7, "\ufeff").otherwise(""), F.lit("BEGIN:VCALENDAR" + crlf), "body", end).alias("value"))


WHOLE = "(SELECT * FROM orders WHERE o_custkey % 97 <> 5)"


def timed(c):
    return X.ical_times(X.events_of(X.scan_ical(feeds(c))), "UTC")


RRULES = {"1-URGENT": "FREQ=DAILY;INTERVAL=3;COUNT=5", "2-HIGH": "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,WE", "3-MEDIUM": "FREQ=MONTHLY", "4-NOT SPECIFIED": "FREQ=YEARLY;UNTIL=20200101", "5-LOW": "FREQ=MONTHLY;BYDAY=-1FR"}
FROM, TO = "1996-03-01", "1996-05-01"


def occurrences(c):
    rrule = F.element_at(F.create_map(*(F.lit(x) for kv in RRULES.items() for x in kv)), F.col("o_orderpriority"))
    start = F.to_date("o_orderdate").cast("timestamp") + F.expr("interval 9 hours")
    return X.expand_recurrence(table(c, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), start.alias("start_local"), F.lit("Europe/Berlin").alias("tzid"), rrule.alias("rrule"), F.lit(3_600_000_000).alias("length_us"), F.lit("t").alias("title")), FROM, TO)


OCC_SQL = f"""WITH d AS (SELECT CAST(unnest(generate_series(DATE '1996-02-28', DATE '1996-05-02', INTERVAL 1 DAY)) AS DATE) AS d),
s AS (SELECT CAST(o_orderkey AS VARCHAR) AS uid, CAST(o_orderdate AS DATE) AS d0, o_orderpriority AS p FROM orders),
x AS (SELECT uid, d FROM s JOIN d ON d >= d0 AND CASE p
  WHEN '1-URGENT' THEN (d - d0) % 3 = 0 AND (d - d0) <= 12
  WHEN '2-HIGH' THEN isodow(d) IN (1, 3) AND (date_diff('day', DATE '1970-01-05', d) // 7 - CAST(floor(date_diff('day', DATE '1970-01-05', d0) / 7.0) AS BIGINT)) % 2 = 0
  WHEN '3-MEDIUM' THEN day(d) = day(d0)
  WHEN '4-NOT SPECIFIED' THEN day(d) = day(d0) AND month(d) = month(d0) AND d < DATE '2020-01-02'
  WHEN '5-LOW' THEN isodow(d) = 5 AND month(d + 7) <> month(d) END)
SELECT uid, epoch_us(CAST(d AS TIMESTAMP)) + 9 * 3600000000 - CASE WHEN d < DATE '1996-03-31' THEN 1 ELSE 2 END * 3600000000 AS at_us FROM x WHERE d >= DATE '{FROM}' AND d < DATE '{TO}'"""


def ledger(c, **tables) -> Ledger:
    return Ledger(c.spark, f"{store.shared_dir(c.spark)}/{uuid.uuid4().hex}", tables=tables)


def ingested(c):
    """The stored table after the same traces came in twice, forty days later the second time."""
    path = f"{store.shared_dir(c.spark)}/{uuid.uuid4().hex}"
    book = ledger(c)
    for run, days in (("first", 0), ("again", 40)):
        Z.stream_ingest(c.live_traces.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(days))), book, f"{path}/{run}").awaitTermination()
    return book.read("events").select(*X.IDENTITY, F.unix_micros("ts").alias("ts_us"))


def touched(c):
    """Project rows kept by a stream whose second batch brings late traces to some of the days, and which days of those frozen in between that disturbed."""
    path = f"{store.shared_dir(c.spark)}/{uuid.uuid4().hex}"
    book = ledger(c, project_rows=U.PROJECT_ROWS)  # asking the chain for its schema would work out its stored steps

    def build(e):
        of = type(c)(c.spark, c.sf_dir)
        of.entries = e  # the chain over what is stored
        of.hot = blocks.hot_days(e, LARGE_DAY)
        of.named = of.named.select(*NAMED)
        return {"project_rows": of.rows}

    late, frozen = F.col("external_id").cast("bigint") % 50 == 3, None
    for run, part in (("early", ~late), ("late", late)):
        Z.stream_touched_days(c.live_traces.where(part), book, build, f"{path}/{run}", frozen=frozen).awaitTermination()
        frozen = store.stored(book.read("project_rows").groupBy(*D).agg(F.sum("events").alias("events")))
    disturbed = book.read("disturbed").select(*D, F.lit(True).alias("_d"))
    return book.read("project_rows").join(disturbed, list(D), "left").withColumn("disturbed", F.coalesce("_d", F.lit(False))).drop("_d")


def appended(c):
    """What is stored after two runs that overlap, the second of which has all it brings twice, with the run that stored it."""
    book = ledger(c)
    new = c.traces.where("ts >= timestamp '2024-01-10'")
    for day, rows in ((1, c.traces.where("ts < timestamp '2024-01-20'")), (2, new.unionByName(new))):
        book.append(rows, now=dt.datetime(2024, 3, day))
    return book.read("events").select(*X.IDENTITY, F.dayofmonth("ingested_at").alias("run"))


def scanned(c):
    """What a second run reads, the first of which was on 15 January, when later traces were in the future."""
    book = ledger(c)
    book.append(c.traces.where("ts < timestamp '2024-01-20' and actor_id <> 'a2'"), now=dt.datetime(2024, 1, 15))
    return book.since_cursor(c.traces).select(*X.IDENTITY)


def calendar_feed(c):
    """Stored meetings as a feed that has lost those in 3, made those in 5 a minute longer and given those in 7 a new id."""
    rows = c.traces.where("source = 'calendar'").withColumn("entrypoint", F.lit("work"))
    duration = F.when(F.col("external_id").like("%5"), F.col("duration_ms") + 60000).otherwise(F.col("duration_ms"))
    return rows, rows.where("external_id not like '%3'").withColumn("duration_ms", duration).withColumn("external_id", F.when(F.col("external_id").like("%7"), F.concat("external_id", F.lit("x"))).otherwise(F.col("external_id")))


def replaced(c) -> tuple[Ledger, list[dict[str, int]]]:
    """A ledger of meetings, and the counters of stating ten days of January again, twice; the feed of a2 wasn't whole."""
    book = ledger(c)
    rows, feed = calendar_feed(c)
    book.append(rows)
    asked = rows.select("actor_id", "source", "entrypoint").distinct().withColumn("whole", F.col("actor_id") != "a2")
    return book, [book.replace_window(feed, asked, "2024-01-10", "2024-01-20") for _ in range(2)]


def restated(c):
    return replaced(c)[0].read("events").select(*X.IDENTITY, F.unix_micros("ts").alias("ts_us"), "duration_ms")


INSIDE = "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'"
RESTATED = f"""SELECT actor_id, source, external_id, epoch_us(ts) AS ts_us, CASE WHEN external_id LIKE '%5' THEN duration_ms + 60000 ELSE duration_ms END AS duration_ms FROM traces
 WHERE source = 'calendar' AND NOT ({INSIDE} AND actor_id <> 'a2' AND (external_id LIKE '%3' OR external_id LIKE '%7'))
 UNION ALL SELECT actor_id, source, external_id || 'x', epoch_us(ts), duration_ms FROM traces WHERE source = 'calendar' AND external_id LIKE '%7'"""
LO, HI = 1_700_100_000, 1_700_500_000


def accounting(c):
    """Every counter of a run over all four sources, the stored ones included."""
    logs, log = outcomes(X.scan_agent_log(log_lines(c)), "agent-log")
    _, web = outcomes(X.visit_to_trace(visits(c), ignored(c)), "browser")
    _, meetings = outcomes(X.meeting_filter(timed(c)), "calendar", "reason")
    lines = store.stored(X.scan_reflog(reflog_lines(c)))
    once = X.reflog_collapse(lines)
    _, git = outcomes(X.reflog_to_trace(once, LO, HI), "git")
    read, whole = lines.count(), lines.where("new is not null").count()
    git |= {"malformed": read - whole, "collapsed": whole - git["found"] - git["out_of_range"]}
    book = ledger(c)
    found = logs.where("outcome = 'found'").withColumn("actor_id", F.lit("a"))
    for _ in range(2):
        log |= {n: v + log.get(n, 0) for n, v in book.append(found).items() if n != "seen"}
    for said in replaced(c)[1]:
        meetings |= {n: v + meetings.get(n, 0) for n, v in said.items()}
    return X.import_accounting({"agent-log": log, "browser": web, "calendar": meetings, "git": git}, c.spark)


def _accounts() -> str:
    none = " UNION ALL ".join(f"SELECT '{s}' AS source, '{o}' AS outcome, 0 AS n" for s, of in X.OUTCOMES.items() for o in of)
    stored_ = " UNION ALL ".join(f"SELECT 'calendar', '{o}', 0" for o in ("new", "moved", "unchanged", "removed", "refused"))
    gone = f"{INSIDE} AND (external_id LIKE '%3' OR external_id LIKE '%7')"
    return after(
        "traces",
        f"""SELECT source, outcome, sum(n)::BIGINT AS n FROM ({none} UNION ALL {stored_} UNION ALL
 SELECT 'agent-log', outcome, count(*) FROM ({LOG_SQL}) GROUP BY ALL UNION ALL SELECT 'agent-log', unnest(['new', 'unchanged']), count(*) FROM ({LOG_SQL}) WHERE outcome = 'found' UNION ALL
 SELECT 'browser', CASE WHEN ends_with({HOST}, '.example.org') OR {HOST} = 'blog.tionsh.example.net' OR ends_with({HOST}, '.blog.tionsh.example.net') THEN 'ignored' ELSE 'kept' END, count(*) FROM pages GROUP BY ALL UNION ALL
 SELECT 'calendar', CASE WHEN o_orderkey % 17 = 0 THEN 'no uid' WHEN o_orderkey % 7 = 0 THEN 'cancelled' WHEN o_orderkey % 4 = 0 THEN 'all-day' WHEN o_orderkey % 3 = 0 THEN 'kept' ELSE 'zero' END, count(*) FROM {WHOLE} GROUP BY ALL UNION ALL
 SELECT 'calendar', CASE WHEN {gone} THEN CASE WHEN actor_id = 'a2' THEN 'refused' ELSE 'removed' END WHEN external_id LIKE '%5' THEN 'moved' ELSE 'unchanged' END, count(*) FROM traces WHERE source = 'calendar' AND NOT (NOT ({INSIDE}) AND (external_id LIKE '%3' OR external_id LIKE '%7')) GROUP BY ALL UNION ALL
 SELECT 'calendar', 'new', count(*) FROM traces WHERE source = 'calendar' AND external_id LIKE '%7' UNION ALL
 SELECT 'calendar', CASE WHEN {gone} AND actor_id = 'a2' THEN 'refused' ELSE 'unchanged' END, count(*) FROM (SELECT * FROM traces WHERE source = 'calendar' AND (external_id NOT LIKE '%3' AND external_id NOT LIKE '%7' OR actor_id = 'a2' AND {gone})) GROUP BY ALL UNION ALL
 SELECT 'calendar', 'unchanged', count(*) FROM traces WHERE source = 'calendar' AND external_id LIKE '%7' UNION ALL
 SELECT 'git', CASE WHEN at_s >= {LO} AND at_s < {HI} THEN 'found' ELSE 'out_of_range' END, count(*) FROM (SELECT DISTINCT repo, at_s, new FROM ({REF_SQL})) GROUP BY ALL UNION ALL
 SELECT 'git', 'collapsed', count(*) - count(DISTINCT (repo, at_s, new)) FROM ({REF_SQL})) GROUP BY ALL""",
    )


ACCOUNTS = _accounts()


TRACE = "CASE WHEN key <> '' THEN 'key:' || key WHEN path <> '' THEN 'path:' || path ELSE '' END"
#: A block is called what all its events are called; its neighbours are found by looking outwards from it.
PLACES = f"""SELECT * FROM (WITH main AS MATERIALIZED (SELECT {DS}, block_id, CASE WHEN count(DISTINCT project) = 1 THEN any_value(project) ELSE '' END AS project, any_value(origin) AS origin FROM own_ GROUP BY ALL),
 near AS (SELECT m.*, coalesce((SELECT arg_max(x.project, x.block_id) FROM main x WHERE x.actor_id = m.actor_id AND x.local_day = m.local_day AND x.block_id < m.block_id AND x.project <> ''), '') AS before, coalesce((SELECT arg_min(x.project, x.block_id) FROM main x WHERE x.actor_id = m.actor_id AND x.local_day = m.local_day AND x.block_id > m.block_id AND x.project <> ''), '') AS after FROM main m)
 SELECT e.actor_id, e.local_day, trace, e.block_id, events, project, origin, before, after FROM (SELECT {DS}, {TRACE} AS trace, block_id, count(*) AS events FROM own_ WHERE NOT covered AND (path <> '' OR key <> '') GROUP BY ALL) e JOIN near n ON n.actor_id = e.actor_id AND n.local_day = e.local_day AND n.block_id = e.block_id)"""
_DICTIONARY = ", ".join(f"({i}, '{r[1]}')" for i, r in enumerate(fixtures.RULES) if r[1])
#: The ladder of suggestions, rung by rung; of a name the first rung counts.
CANDIDATES = f"""SELECT * FROM (WITH p AS MATERIALIZED ({PLACES}),
 q AS MATERIALIZED (SELECT *, CASE WHEN before <> '' AND before = after THEN 'both' WHEN before <> '' AND after = '' OR before = '' AND after <> '' THEN 'one' WHEN before <> '' AND after <> '' THEN 'apart' ELSE '' END AS kind FROM p),
 t AS MATERIALIZED (SELECT {DS}, trace, coalesce(arg_max(before, block_id) FILTER (kind = 'both'), '') AS agreed, coalesce(arg_max(before || after, block_id) FILTER (kind = 'one'), '') AS lone, count(*) FILTER (project <> '' AND origin = 'own') AS own FROM q GROUP BY ALL),
 ladder AS (
  SELECT {DS}, trace, project, 'block' AS reason, 1 AS rung, block_id AS nth, NOT EXISTS (SELECT 1 FROM q x WHERE x.actor_id = q.actor_id AND x.local_day = q.local_day AND x.trace = q.trace AND x.kind = 'both' AND x.block_id <= q.block_id) AS is_default FROM q WHERE origin = 'own'
  UNION ALL SELECT {DS}, trace, agreed, 'both', 2, 0, true FROM t
  UNION ALL SELECT {DS}, trace, lone, 'one side', 3, 0, own = 0 AND agreed = '' FROM t
  UNION ALL SELECT {DS}, trace, unnest([before, after]), 'disagree', 4, unnest([2 * block_id, 2 * block_id + 1]), false FROM q WHERE kind = 'apart'
  UNION ALL SELECT t.actor_id, t.local_day, trace, r.project, 'today', 5, r.nth, false FROM t JOIN (SELECT *, row_number() OVER (PARTITION BY {DS} ORDER BY project = '', attention_us DESC, background_us DESC, events DESC, project) AS nth FROM prow) r ON r.actor_id = t.actor_id AND r.local_day = t.local_day
  UNION ALL SELECT {DS}, trace, d.project, 'dictionary', 6, d.nth, false FROM t CROSS JOIN (SELECT name AS project, min(i) AS nth FROM (VALUES {_DICTIONARY}) v(i, name) GROUP BY name) d)
 SELECT {DS}, trace, project, reason, is_default, row_number() OVER (PARTITION BY {DS}, trace ORDER BY rung, nth, project) AS place
 FROM (SELECT *, row_number() OVER (PARTITION BY {DS}, trace, project ORDER BY rung, nth, reason) AS r FROM ladder WHERE project <> '') WHERE r = 1)"""


def register(query) -> None:
    query("scan_agent_log", lambda c: X.scan_agent_log(log_lines(c)).where("outcome = 'found'").select("external_id", "session_id", "project", F.unix_micros("ts").alias("ts_us"), "type"), f"SELECT conv_id || '-' || turn AS external_id, 'c' || conv_id AS session_id, 'p' || conv_id % 7 AS project, epoch_us(TIMESTAMP '2024-01-01') + conv_id * 3600000000 + turn * 60000000 AS ts_us, role AS type FROM ({LOG_SQL}) WHERE outcome = 'found'")
    query("agent_log_label", lambda c: X.scan_agent_log(log_lines(c)).where("outcome = 'found'").groupBy("type", F.col("raw_text").alias("label")).agg(F.count("*").alias("n")), f"SELECT role AS type, CASE WHEN role = 'user' THEN 'prompt' WHEN turn % 2 = 0 THEN 'model-a Read' ELSE 'model-a' END AS label, count(*) AS n FROM ({LOG_SQL}) WHERE outcome = 'found' GROUP BY ALL")
    query("import_accounting", accounting, ACCOUNTS)
    query("note_dedup", lambda c: X.note_dedup(X.scan_agent_log(log_lines(c)).where("outcome <> 'found'").select(F.col("outcome").alias("kind"), F.coalesce("type", F.lit("-")).alias("detail"))), f"SELECT outcome AS kind, count(*) AS n, min(CASE WHEN outcome = 'malformed' THEN '-' ELSE role END) AS example FROM ({LOG_SQL}) WHERE outcome <> 'found' GROUP BY ALL")
    at = "epoch_us(ts) AS ts_us"
    query("scan_visits_chrome", lambda c: chrome(c).select("visit_id", "url", F.unix_micros("ts").alias("ts_us"), "subtype"), f"SELECT event_id AS visit_id, url, {at}, ['" + "', '".join(X.CHROME) + "'][CAST(event_id % 11 AS INT) + 1] AS subtype FROM events LEFT JOIN pages ON page_id = event_id % 300 WHERE event_type IN ('click', 'view')")
    query("scan_visits_firefox", lambda c: firefox(c).select("visit_id", "url", F.unix_micros("ts").alias("ts_us"), "subtype"), f"SELECT event_id AS visit_id, url, {at}, ['" + "', '".join(X.FIREFOX.values()) + "'][CAST(event_id % 9 AS INT) + 1] AS subtype FROM events LEFT JOIN pages ON page_id = event_id % 300 WHERE event_type IN ('click', 'view')")
    query("visit_to_trace", lambda c: X.visit_to_trace(visits(c)).select("page_id", "outcome", "host", "port", "path_head"), VISIT_SQL)
    query("domain_ignore", lambda c: X.domain_ignore(visits(c), ignored(c)).select("page_id", "host"), f"SELECT page_id, lower({HOST}) AS host FROM pages WHERE ends_with({HOST}, '.example.org') OR {HOST} = 'blog.tionsh.example.net' OR ends_with({HOST}, '.blog.tionsh.example.net')")
    query("domain_ignore_entries", written_entries, ENTRIES)
    query("canonical_host", lambda c: visits(c).select("page_id", S.canonical_host(F.upper(F.expr("try_parse_url(url, 'HOST')"))).alias("host")), f"SELECT page_id, lower({HOST}) AS host FROM pages")
    query("effective_port", lambda c: visits(c).select("page_id", S.effective_port(F.expr("split(url, ':')[0]"), F.when(F.col("page_id") % 2 == 0, "443").otherwise("8080")).alias("port")), "SELECT page_id, CASE WHEN page_id % 2 = 0 AND starts_with(url, 'https:') THEN '' WHEN page_id % 2 = 0 THEN '443' ELSE '8080' END AS port FROM pages")
    query("path_head", lambda c: X.visit_to_trace(visits(c)).groupBy("path_head").agg(F.count("*").alias("n")), f"SELECT path_head, count(*) AS n FROM ({VISIT_SQL}) GROUP BY ALL")
    query("printable", lambda c: table(c, "documents").select("doc_id", F.md5(S.printable(F.col("text"))).alias("text_md5")), r"SELECT doc_id, md5(substring(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), 1, 4096)) AS text_md5 FROM documents")
    query("visit_external_id", lambda c: chrome(c).select(S.visit_external_id(F.lit("default"), F.col("visit_id")).alias("external_id")), "SELECT 'default/' || event_id AS external_id FROM events WHERE event_type IN ('click', 'view')")
    query("scan_reflog", lambda c: X.scan_reflog(reflog_lines(c)), REF_SQL)
    query("reflog_verb", lambda c: X.scan_reflog(reflog_lines(c)).groupBy("verb").agg(F.count("*").alias("n")), f"SELECT verb, count(*) AS n FROM ({REF_SQL}) GROUP BY ALL")
    query("reflog_collapse", lambda c: X.reflog_collapse(X.scan_reflog(reflog_lines(c))).select("repo", "at_s", "new", "ref", "rank"), f"SELECT repo, at_s, new, arg_min(ref, rank) AS ref, min(rank) AS rank FROM ({REF_SQL}) GROUP BY ALL")
    lo, hi = LO, HI
    query("reflog_to_trace", lambda c: X.reflog_to_trace(X.reflog_collapse(X.scan_reflog(reflog_lines(c))), lo, hi).select("repo", "at_s", "outcome", "raw_text", "type"), f"SELECT DISTINCT repo, at_s, CASE WHEN at_s >= {lo} AND at_s < {hi} THEN 'found' ELSE 'out_of_range' END AS outcome, left(old, 7) || '..' || left(new, 7) AS raw_text, verb AS type FROM ({REF_SQL})")
    query("reflog_external_id", lambda c: X.reflog_to_trace(X.reflog_collapse(X.scan_reflog(reflog_lines(c))), lo, hi).select("external_id"), f"SELECT DISTINCT repo || '/' || strftime(make_timestamp(CAST(at_s * 1000000 AS BIGINT)), '%Y%m%dT%H%M%SZ') || '/' || left(new, 12) AS external_id FROM ({REF_SQL})")
    query("append_dedup", appended, after("traces", "SELECT actor_id, source, external_id, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END AS run FROM traces"))
    query("incremental_scan", scanned, after("traces", "SELECT actor_id, source, external_id FROM traces t WHERE ts >= coalesce((SELECT max(x.ts) - INTERVAL 7 DAY FROM traces x WHERE x.actor_id = t.actor_id AND x.source = t.source AND x.ts <= TIMESTAMP '2024-01-15' AND x.actor_id <> 'a2'), TIMESTAMP '1900-01-01')"))
    query("replace_window", restated, after("traces", RESTATED))
    query("scan_ical", lambda c: X.scan_ical(feeds(c)).groupBy("name").agg(F.count("*").alias("n")), f"SELECT name, count(*) AS n FROM (SELECT unnest(['SUMMARY', 'DTSTART'] || CASE WHEN o_orderkey % 17 <> 0 THEN ['UID'] ELSE [] END || CASE WHEN o_orderkey % 3 = 0 THEN ['DURATION'] ELSE [] END || CASE WHEN o_orderkey % 7 = 0 THEN ['STATUS'] ELSE [] END) AS name FROM {WHOLE}) GROUP BY ALL")
    query("ical_times", lambda c: timed(c).select("uid", F.unix_micros("start_local").alias("local_us"), "tzid", "unknown_zone", "all_day", "length_us"), f"SELECT CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS uid, epoch_us(CASE WHEN o_orderkey % 4 = 0 THEN date_trunc('day', o_orderdate) ELSE date_trunc('second', o_orderdate) END) AS local_us, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 11 = 0 THEN 'UTC' ELSE 'Europe/Berlin' END AS tzid, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 11 = 0 THEN 'W. Europe Standard Time' END AS unknown_zone, o_orderkey % 4 = 0 AS all_day, CASE WHEN o_orderkey % 3 = 0 THEN 5400000000 WHEN o_orderkey % 4 = 0 THEN 86400000000 ELSE 0 END AS length_us FROM {WHOLE}")
    query("unescape_ical", lambda c: timed(c).select("uid", "title"), f"SELECT CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS uid, 'a, b; ' || o_orderkey AS title FROM {WHOLE}")
    query("iso_duration", lambda c: table(c, "orders").select("o_orderkey", S.iso_duration(F.concat(F.lit("P"), F.col("o_orderkey") % 9, F.lit("DT"), F.col("o_orderkey") % 23, F.lit("H"), F.col("o_orderkey") % 59, F.lit("M"))).alias("us")), "SELECT o_orderkey, ((o_orderkey % 9) * 86400 + (o_orderkey % 23) * 3600 + (o_orderkey % 59) * 60) * 1000000 AS us FROM orders")
    query("meeting_filter", lambda c: X.meeting_filter(timed(c)).groupBy("reason").agg(F.count("*").alias("n")), f"SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'no uid' WHEN o_orderkey % 7 = 0 THEN 'cancelled' WHEN o_orderkey % 4 = 0 THEN 'all-day' WHEN o_orderkey % 3 = 0 THEN 'kept' ELSE 'zero' END AS reason, count(*) AS n FROM {WHOLE} GROUP BY ALL")
    query("expand_recurrence", lambda c: occurrences(c).select("uid", F.unix_micros("at").alias("at_us")), OCC_SQL)
    third = lambda c, k: occurrences(c).where(F.col("uid").cast("bigint") % 10 == k)
    query("recurrence_overrides", lambda c: X.recurrence_overrides(occurrences(c), third(c, 1), third(c, 2), third(c, 3).withColumn("at", F.col("at") + F.expr("interval 1 minute"))).select("uid", F.unix_micros("at").alias("at_us")), f"SELECT uid, at_us FROM ({OCC_SQL}) WHERE CAST(uid AS BIGINT) % 10 NOT IN (1, 2) UNION ALL SELECT uid, at_us + 60000000 FROM ({OCC_SQL}) WHERE CAST(uid AS BIGINT) % 10 = 3")
    stamp = "strftime(make_timestamp(CAST(at_us AS BIGINT)), '%Y%m%dT%H%M%SZ')"
    query("meeting_to_trace", lambda c: X.meeting_to_trace(occurrences(c), "work").select("external_id", F.unix_micros("ts").alias("ts_us"), "duration_ms"), f"SELECT 'work/' || uid || '/' || {stamp} AS external_id, at_us AS ts_us, 3600000 AS duration_ms FROM ({OCC_SQL})")
    query("meeting_external_id", lambda c: X.meeting_to_trace(occurrences(c), "home").select("external_id"), f"SELECT 'home/' || uid || '/' || {stamp} AS external_id FROM ({OCC_SQL})")

    # the review queue
    tr = "CASE WHEN key <> '' THEN 'key:' || key WHEN path <> '' THEN 'path:' || path ELSE '' END"
    hp = "split_part(key, '/', 1)"
    seen = f"SELECT actor_id, trace, min(local_day) AS first_day FROM (SELECT actor_id, local_day, {tr} AS trace FROM own_ UNION ALL SELECT actor_id, local_day, 'key:' || {hp} FROM own_ WHERE key <> '') WHERE trace <> '' GROUP BY ALL"
    query("first_seen_traces", lambda c: V.first_seen_traces(c.b), after("own_", seen))
    fold = f"""SELECT {DS}, CASE WHEN key <> '' AND n > 1 THEN 'key:' || {hp} ELSE trace END AS question, sum(events) AS events, sum(time_us) AS time_us, bool_and(first_day = local_day) AS first_today, count(*) AS traces
 FROM (SELECT u.*, f.first_day, count(*) OVER (PARTITION BY u.actor_id, u.local_day, path, {hp}) AS n FROM (SELECT *, {tr} AS trace FROM unm) u JOIN ({seen}) f ON f.actor_id = u.actor_id AND f.trace = u.trace) GROUP BY ALL"""
    folded = lambda c: V.fold_by_host(V.questions(c.unmatched, V.first_seen_traces(c.b)))
    query("fold_by_host", folded, after("unm", fold))
    query("order_questions", lambda c: V.order_questions(folded(c)).select(*D, "question", "place"), after("unm", f"SELECT {DS}, question, row_number() OVER (PARTITION BY {DS} ORDER BY time_us DESC, events DESC, question) AS place FROM ({fold})"))
    query("review_budget", lambda c: V.review_budget(folded(c), U.day_totals(c.h, c.s)), after("unm", f"SELECT a.actor_id, a.local_day, coalesce(q.n, 0) AS questions, coalesce(q.t, 0) AS question_us, a.active_us FROM (SELECT {DS}, sum(to_us - from_us) AS active_us FROM st GROUP BY ALL) a LEFT JOIN (SELECT {DS}, count(*) AS n, sum(time_us) AS t FROM ({fold}) GROUP BY ALL) q ON q.actor_id = a.actor_id AND q.local_day = a.local_day"))
    open_ = "NOT covered AND (path <> '' OR key <> '')"
    query("question_titles", lambda c: V.question_titles(c.b).select(*D, "trace", "title", "n", "place"), after("own_", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {DS}, trace ORDER BY n DESC, title) AS place FROM (SELECT {DS}, {tr} AS trace, title, count(*) AS n FROM own_ WHERE {open_} AND title <> '' GROUP BY ALL)) WHERE place <= 5"))
    query("question_touches", lambda c: V.question_touches(c.b), after("own_", f"SELECT {DS}, {tr} AS trace, count(*) FILTER (touch) AS touches, count(*) AS events FROM own_ WHERE {open_} GROUP BY ALL"))
    query("question_places", lambda c: V.question_places(c.b), after("own_", PLACES))
    query("project_candidates", lambda c: V.project_candidates(V.question_places(c.b), c.rows, V.dictionary(c.rules)), after("prow", CANDIDATES))
    query("encounters", lambda c: V.encounters(c.s), after("st", f"SELECT {DS}, from_us, to_us, owner, ambiguous FROM st WHERE ambiguous <> '' AND NOT padding AND owner <> '' AND to_us - from_us >= {V.MIN_SPLIT_US}"))
    query("around_subject", lambda c: V.around_subject(c.s).where("around <> ''"), after("st", f"SELECT * FROM (SELECT {DS}, from_us, CASE WHEN last_value(nullif(subject, '') IGNORE NULLS) OVER (PARTITION BY {DS} ORDER BY from_us, to_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = first_value(nullif(subject, '') IGNORE NULLS) OVER (PARTITION BY {DS} ORDER BY from_us, to_us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) THEN last_value(nullif(subject, '') IGNORE NULLS) OVER (PARTITION BY {DS} ORDER BY from_us, to_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE '' END AS around FROM st) WHERE around <> ''"))
    query("block_summary", lambda c: V.block_summary(c.b).select(*D, "block_id", "ground", "subject", F.size("traces").alias("traces")), after("own_", f"SELECT {DS}, block_id, arg_min(ground, nth) AS ground, arg_min(owner_subject, nth) AS subject, CAST(count(DISTINCT nullif({tr}, '')) AS INT) AS traces FROM own_ GROUP BY ALL"))
    gaps = lambda c: U.pauses_between(c.runs)
    query("pause_answered", lambda c: V.pause_answered(gaps(c), c.pauses), after("run", f"SELECT r.actor_id, r.local_day, r.from_us, r.to_us, CASE WHEN max(CASE WHEN p.from_us = r.from_us AND p.to_us = r.to_us THEN 1 END) = 1 THEN 'exact' WHEN count(p.from_us) > 0 THEN 'containing' ELSE 'none' END AS answered, coalesce(arg_max(p.project, p.answered_at), '') AS project FROM run r LEFT JOIN (SELECT * FROM {_pause()}) p ON p.actor_id = r.actor_id AND p.local_day = r.local_day AND p.from_us <= r.from_us AND p.to_us >= r.to_us WHERE gap GROUP BY 1, 2, 3, 4"))
    plain = lambda c: U.project_time(T.stretches(T.pieces(c.h, hot=c.hot)))
    query("answer_delta", lambda c: V.answer_delta(plain(c), U.project_time(c.s)), after("st", f"SELECT {DS}, project, before_us, after_us, after_us - before_us AS delta_us FROM (SELECT s.actor_id, s.local_day, project, sum(b) AS before_us, sum(a) AS after_us FROM (SELECT s.actor_id, s.local_day, o.owner AS project, s.to_us - s.from_us AS b, 0 AS a FROM st s JOIN own_ o ON o.actor_id = s.actor_id AND o.local_day = s.local_day AND o.nth = s.opener UNION ALL SELECT {DS}, owner, 0, to_us - from_us FROM st) s GROUP BY ALL) WHERE after_us <> before_us"))

    # frozen days
    plain_days = lambda c: C.with_rules_hash(c.entries.where("external_id not like '%77'").groupBy(*D).agg(F.count("*").alias("events")), c.rules).withColumn("rules_hash", F.when(F.dayofmonth("local_day") % 2 == 0, "old").otherwise(F.col("rules_hash")))
    frozen = lambda c: C.with_settings_of(plain_days(c), c.entries)
    fz = f"(SELECT {DS}, count(*) AS events FROM ent WHERE external_id NOT LIKE '%77' GROUP BY ALL)"
    answered = ", ".join(f"('{r[0]}', DATE '{r[1]}', {r[7]})" for r in fixtures.ANSWERS)
    zeros = lambda df: df.na.fill(0, list(C.ASKED))
    query("confirmed_list", lambda c: C.confirmed_list(zeros(plain_days(c).join(C.asked_of(folded(c), fixtures.answers(c.spark)), list(D), "left")), c.rules), after("unm", f"SELECT f.*, coalesce(q.n, 0) AS questions_total, coalesce(a.n, 0) AS questions_answered, coalesce(a.once, 0) AS one_offs, day(f.local_day) % 2 = 0 AS rules_moved FROM {fz} f LEFT JOIN (SELECT {DS}, count(*) AS n FROM ({fold}) GROUP BY ALL) q ON q.actor_id = f.actor_id AND q.local_day = f.local_day LEFT JOIN (SELECT actor_id, local_day, count(*) AS n, count(*) FILTER (once) AS once FROM (VALUES {answered}) v(actor_id, local_day, once) GROUP BY ALL) a ON a.actor_id = f.actor_id AND a.local_day = f.local_day"))
    query("rules_moved", lambda c: C.rules_moved(frozen(c), c.rules), after("ent", f"SELECT {DS} FROM {fz} WHERE day(local_day) % 2 = 0"))
    query("disturbed_days", lambda c: C.disturbed_days(frozen(c), c.entries), after("ent", f"SELECT f.*, n.now FROM {fz} f JOIN (SELECT {DS}, count(*) AS now FROM ent GROUP BY ALL) n ON n.actor_id = f.actor_id AND n.local_day = f.local_day WHERE events <> now"))
    query("confirm_snapshot", lambda c: settled(c, snapshot(c, frozen(c))), after("ent", f"SELECT {DS}, events, 'UTC' AS tz, 600000000 AS gap_us, 300000000 AS window_us, 120000000 AS head_us, 120000000 AS tail_us, 'cwd-basename' AS fallback, false AS count_background, {len(fixtures.RULES)} AS rules FROM {fz}"))
    runs_sql = f"SELECT {DS}, min(from_us) AS from_us, max(to_us) AS to_us, any_value(owner) AS project, false AS gap FROM (SELECT *, sum(CASE WHEN po IS NULL OR po <> owner OR pt < from_us THEN 1 ELSE 0 END) OVER (PARTITION BY {DS} ORDER BY from_us, to_us ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, lag(owner) OVER w AS po, lag(to_us) OVER w AS pt FROM st WINDOW w AS (PARTITION BY {DS} ORDER BY from_us, to_us))) GROUP BY {DS}, r UNION ALL SELECT {DS}, pt, from_us, '', true FROM (SELECT *, lag(to_us) OVER (PARTITION BY {DS} ORDER BY from_us, to_us) AS pt FROM st) WHERE pt < from_us"
    query("snapshot_read", lambda c: timeline(c, C.snapshot_read(snapshot(c, frozen(c)))["stretches"]), after("st", f"SELECT row_number() OVER (PARTITION BY {DS} ORDER BY from_us, to_us) AS nth, {DS}, from_us, to_us, CASE WHEN gap AND to_us - from_us > 3600000000 THEN 'long' ELSE project END AS project, gap, gap AND to_us - from_us > 3600000000 AS claimed, max(to_us) OVER (PARTITION BY {DS}) - min(from_us) OVER (PARTITION BY {DS}) AS span_us FROM ({runs_sql})"))
    query("snapshot_claims", lambda c: C.snapshot_claims(c.pauses, C.snapshot_runs(c.s), c.entries, c.rows), after("prow", f"SELECT {DS}, project, attention_us, background_us, claimed_us FROM prow"))
    query("export_rows", lambda c: C.export_rows(c.rows, c.subjects), after("srow", f"SELECT {DS}, project, '' AS subject, attention_us FROM prow UNION ALL SELECT {DS}, project, subject, attention_us FROM srow UNION ALL SELECT s.actor_id, s.local_day, s.project, 'rest of project', p.attention_us - s.a FROM (SELECT {DS}, project, sum(attention_us) AS a FROM srow GROUP BY ALL) s JOIN prow p ON p.actor_id = s.actor_id AND p.local_day = s.local_day AND p.project = s.project"))
    long = lambda c, us: gaps(c).where(F.col("to_us") - F.col("from_us") > us).select(*D, "from_us", "to_us")
    shift = lambda c: long(c, 3_600_000_000).withColumns({"from_us": F.col("from_us") + 600_000_000, "to_us": F.col("from_us") + 1_200_000_000})
    query("pause_answer_supersede", lambda c: C.pause_answer_supersede(long(c, 1_800_000_000), shift(c)), after("run", f"SELECT {DS}, from_us, to_us FROM run WHERE gap AND to_us - from_us > 1800000000 AND to_us - from_us <= 3600000000 UNION ALL SELECT {DS}, from_us + 600000000, from_us + 1200000000 FROM run WHERE gap AND to_us - from_us > 3600000000"))


    # streams, run to the end of what is there
    query("stream_dedup", lambda c: landed(c, Z.stream_dedup(c.live_traces.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(2)))).drop("_n"))).select(*X.IDENTITY), after("traces", "SELECT actor_id, source, external_id FROM traces"))
    query("stream_ingest", ingested, after("traces", "SELECT actor_id, source, external_id, epoch_us(ts) AS ts_us FROM traces"))
    query("stream_counts", lambda c: landed(c, Z.stream_counts(c.live_traces), "complete").select(F.unix_micros("from_ts").alias("from_us"), "source", "n"), after("traces", "SELECT epoch_us(date_trunc('day', ts)) AS from_us, source, count(*) AS n FROM traces GROUP BY ALL"))
    query("stream_blocks", lambda c: landed(c, Z.stream_blocks(T2.entries(c.live_traces)), "complete"), after("bl", f"SELECT {DS}, block_from_us AS from_us, block_to_us AS to_us, events FROM bl"))
    query("stream_touched_days", touched, after("prow", f"SELECT {DS}, project, events, attention_us, background_us, agent_us, claimed_us, wall_us, EXISTS (SELECT 1 FROM ent e WHERE e.actor_id = prow.actor_id AND e.local_day = prow.local_day AND CAST(e.external_id AS BIGINT) % 50 = 3) AS disturbed FROM prow"))

def landed(c, rows, mode="append"):
    """What a stream of rows gives when all that is there has been read."""
    path = f"{store.shared_dir(c.spark)}/{uuid.uuid4().hex}"
    write = lambda batch, _: batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{path}/rows")
    q = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return c.spark.read.schema(rows.schema).parquet(f"{path}/rows")


def snapshot(c, days):
    """A ledger of all days, frozen twice, the first time with little in them."""
    parts = {"stretches": c.s, "projects": c.rows, "subjects": c.subjects, "days": days}
    book = C.frozen_ledger(c.spark, f"{store.shared_dir(c.spark)}/{uuid.uuid4().hex}", parts)
    rules = c.rules.select("rule_id", "actor_id", "level", "project", "subject", "kind", "value", "since")
    C.confirm_snapshot({n: p.limit(0) if n == "projects" else p for n, p in (parts | {"stretches": c.s.where("owner = ''")}).items()}, book, rules.limit(0))
    C.confirm_snapshot(parts, book, rules)
    book.vacuum()
    return book


def settled(c, book):
    """Frozen days with their settings and how many rules they were worked out with."""
    n = C.frozen_rules(book).groupBy(*D).agg(F.count("*").alias("rules"))
    return C.snapshot_read(book)["days"].join(n, list(D), "left").select(*D, "events", *C.SETTINGS, "rules")


def timeline(c, stretches):
    """The timeline of frozen days, every pause of over an hour claimed, with the day's span."""
    long = C.snapshot_runs(stretches.where("to_us > from_us")).where("gap and to_us - from_us > 3600000000").select(*D, "from_us", "to_us", F.lit(True).alias("worked"), F.lit("long").alias("project"), F.lit(1).alias("answered_at"))
    return C.export_timeline(stretches, long).join(C.snapshot_span(stretches), list(D))


def _pause() -> str:
    from .oracle import _spans

    return _spans(fixtures.PAUSES, "worked, project, subject, answered_at")
