"""Four kinds of sources as traces: agent logs, browser visits, git reflogs and calendar feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

# The low byte of a Chrome transition, and the visit types of Firefox.
CHROME = ["link", "typed", "auto_bookmark", "auto_subframe", "manual_subframe", "generated", "auto_toplevel", "form_submit", "reload", "keyword", "keyword_generated"]
FIREFOX = {1: "link", 2: "typed", 3: "bookmark", 4: "embed", 5: "redirect_permanent", 6: "redirect_temporary", 7: "download", 8: "framed_link", 9: "reload"}
SINCE_1601_US = 11_644_473_600_000_000

LOG = """type string, uuid string, timestamp string, sessionId string, session_id string, version string, cwd string, gitBranch string, entrypoint string,
isSidechain boolean, subtype string, durationMs double, message struct<model:string,content:string>, attachment struct<type:string>, _bad string"""


def agent_log_label(type_: Column, model: Column, content: Column, attachment: Column) -> Column:
    """assistant: model and its tools; user: tool_result if a block is one, else prompt; attachment: its type."""
    blocks = F.from_json(content, "array<struct<type:string,name:string>>")
    tools = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: b["name"]), ",")
    said = F.concat_ws(" ", F.nullif(S.text(model), F.lit("")), F.nullif(S.text(tools), F.lit("")))
    result = F.coalesce(F.exists(blocks, lambda b: b["type"] == "tool_result"), F.lit(False))
    return F.when(type_ == "assistant", said).when((type_ == "user") & result, "tool_result").when(type_ == "user", "prompt").when(type_ == "attachment", S.text(attachment)).otherwise("")


def scan_agent_log(lines: DataFrame) -> DataFrame:
    """JSON lines (value) as traces with outcome: found, skipped (a line of state, without uuid or timestamp) or malformed."""
    j = lines.select(F.from_json("value", LOG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j")).select("j.*")
    ts = F.col("timestamp").try_cast("timestamp")
    blank = (S.text(F.col("uuid")) == "") | (S.text(F.col("timestamp")) == "")
    outcome = F.when(F.col("_bad").isNotNull(), "malformed").when(blank, "skipped").when(ts.isNull(), "malformed").otherwise("found")
    return j.select(
        outcome.alias("outcome"), F.lit("agent-log").alias("source"), F.col("uuid").alias("external_id"), ts.alias("ts"), F.col("durationMs").cast("bigint").alias("duration_ms"), "type", S.text(F.col("subtype")).alias("subtype"),
        S.cwd_basename(F.col("cwd")).alias("project"), agent_log_label(F.col("type"), F.col("message.model"), F.col("message.content"), F.col("attachment.type")).alias("raw_text"), F.coalesce(F.nullif("sessionId", F.lit("")), "session_id", F.lit("")).alias("session_id"),
        S.text(F.col("cwd")).alias("cwd"), S.text(F.col("gitBranch")).alias("git_branch"), F.coalesce("isSidechain", F.lit(False)).alias("is_sidechain"),
    )


def scan_visits_chrome(visits: DataFrame, urls: DataFrame) -> DataFrame:
    """(visit_id, url, title, ts, subtype) from exported tables; a visit without its url stays."""
    word = F.coalesce(F.get(F.array(*(F.lit(x) for x in CHROME)), F.col("transition").bitwiseAND(255).cast("int")), F.lit("other"))
    u = urls.select(F.col("id").alias("url_id"), F.col("url").alias("address"), "title")
    return visits.join(u, visits.url == u.url_id, "left").select(F.col("id").alias("visit_id"), F.col("address").alias("url"), "title", F.timestamp_micros(F.col("visit_time") - SINCE_1601_US).alias("ts"), word.alias("subtype"))


def scan_visits_firefox(visits: DataFrame, places: DataFrame) -> DataFrame:
    word = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FIREFOX.items() for x in kv)), F.col("visit_type").cast("int")), F.lit("other"))
    p = places.select(F.col("id").alias("pid"), "url", "title")
    return visits.join(p, visits.place_id == p.pid, "left").select(F.col("id").alias("visit_id"), "url", "title", F.timestamp_micros("visit_date").alias("ts"), word.alias("subtype"))


def ignore_entries(ignored: DataFrame) -> DataFrame:
    """ignored (domain ...) with host, what an entry is matched as (null for one that is blank or matches nothing), and problem.

    A scheme, brackets and dots or slashes around an entry go. problem: not a
    domain, for what no host can be (a port, a path, a wildcard, a user, white
    space, an empty label), or unseen character, for one that is matched as
    something else than it looks like; null for an entry that is fine.
    """
    e = F.regexp_replace(F.lower(F.trim(S.text(F.col("domain")))), "^https?://", "")
    bare = F.regexp_replace(F.regexp_replace(e, r"^[./]+|[./]+$", ""), r"^\[(.*)\]$", "$1")
    host = S.canonical_host(bare)
    six = host.rlike("^[0-9a-f:]*:[0-9a-f:]*:[0-9a-f:.]*$")
    wrong = host.contains("..") | (~six & host.rlike(r"[/*?:@\\\s\x{A0}\x{2000}-\x{200A}\x{3000}]"))
    problem = F.when(wrong, "not a domain").when(bare.rlike(S.UNSEEN), "unseen character")
    return ignored.withColumns({"host": F.when(~wrong & (host != ""), host), "problem": F.when(host != "", problem)})


def visit_to_trace(visits: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """visits with outcome (kept, not_web, ignored, unparseable), host, port, path_head and printable title; nothing else of the address is kept.

    ignored: (domain); a host goes if it or a parent domain is listed, an address only if it is itself.
    """
    part = lambda p: F.try_parse_url(F.col("url"), F.lit(p))
    scheme = F.lower(F.regexp_extract(S.text(F.col("url")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    v = visits.withColumns({"scheme": scheme, "host": S.canonical_host(part("HOST")), "_port": F.regexp_extract(S.text(part("AUTHORITY")), r":(\d+)$", 1), "path_head": S.path_head(part("PATH")), "title": S.printable(F.col("title"))})
    v = v.withColumn("port", S.effective_port(F.col("scheme"), F.col("_port")))
    if ignored is not None:
        d = ignore_entries(ignored).where("host is not null").select(F.col("host").alias("suffix")).distinct()
        labels = F.split("host", r"\.")
        suffixes = F.when(S.is_address(F.col("host")), F.array("host")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
        hosts = v.select("host").distinct().withColumn("suffix", F.explode(suffixes)).join(d, "suffix", "left_semi").select("host").distinct().withColumn("_ignored", F.lit(True))
        v = v.join(hosts, "host", "left")
    else:
        v = v.withColumn("_ignored", F.lit(None).cast("boolean"))
    outcome = F.when(~F.col("scheme").isin("http", "https"), F.when(F.col("scheme") == "", "unparseable").otherwise("not_web")).when(F.col("host") == "", "unparseable").when(F.col("_ignored"), "ignored").otherwise("kept")
    return v.withColumn("outcome", outcome).drop("url", "_port", "scheme", "_ignored")


def domain_ignore(visits: DataFrame, ignored: DataFrame) -> DataFrame:
    return visit_to_trace(visits, ignored).where("outcome = 'ignored'")


REFLOG = r"^([0-9a-f]{40}|[0-9a-f]{64}) ([0-9a-f]{40}|[0-9a-f]{64}) .*? ?<[^>]*> (-?\d+) [+-]\d{4}\t?(.*)$"


def scan_reflog(lines: DataFrame) -> DataFrame:
    """(path, value) lines of reflogs: old, new, at_s, verb, ref and rank (0 branch, 1 HEAD, 2 remote, 3 other); malformed lines have a null new."""
    part = lambda i: F.nullif(F.regexp_extract("value", REFLOG, i), F.lit(""))
    rel = F.regexp_extract("path", r"/logs/(.*)$", 1)
    rank = F.when(rel.startswith("refs/heads/"), 0).when(rel == "HEAD", 1).when(rel.startswith("refs/remotes/"), 2).otherwise(3)
    return lines.select(
        F.regexp_extract("path", r"([^/]+)/(?:\.git/)?logs/", 1).alias("repo"), part(1).alias("old"), part(2).alias("new"), part(3).cast("bigint").alias("at_s"), S.reflog_verb(F.regexp_extract("value", REFLOG, 4)).alias("verb"), F.regexp_replace(rel, "^refs/(heads|remotes|tags)/", "").alias("ref"), rank.alias("rank")
    )


def reflog_collapse(rows: DataFrame) -> DataFrame:
    """One row for each (repo, at_s, new): the best rank, then the first ref."""
    w = W.partitionBy("repo", "at_s", "new").orderBy("rank", "ref", "verb", "old")
    return rows.where("new is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reflog_to_trace(rows: DataFrame, from_s: int, to_s: int) -> DataFrame:
    """rows with outcome found or out_of_range (half open), external_id, and 'old..new' in short."""
    at = F.timestamp_seconds("at_s")
    inside = (F.col("at_s") >= from_s) & (F.col("at_s") < to_s)
    return rows.select("repo", F.when(inside, "found").otherwise("out_of_range").alias("outcome"), S.reflog_external_id(F.col("repo"), at, F.col("new")).alias("external_id"), "at_s", F.col("verb").alias("type"), F.concat(F.left("old", F.lit(7)), F.lit(".."), F.left("new", F.lit(7))).alias("raw_text"), F.col("ref").alias("git_branch"))


def scan_ical(feeds: DataFrame) -> DataFrame:
    """(feed, value: the whole text) as properties (feed, event, nth, name, params, value) of its events; a feed that isn't whole is refused (no rows).

    A byte order mark is skipped. Components inside an event, such as alarms,
    go with all their properties.
    """
    text = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n[ \t]", "")
    f = feeds.select("feed", text.alias("t")).where(F.col("t").rlike(r"(?s)^\s*BEGIN:VCALENDAR\b.*END:VCALENDAR\s*$"))
    bodies = F.split("t", r"(?im)^BEGIN:VEVENT[ \t]*\r?\n")
    e = f.select("feed", F.posexplode(F.slice(bodies, F.lit(2), F.size(bodies))).alias("event", "body"))
    own = F.regexp_replace(F.split("body", r"(?im)^END:VEVENT").getItem(0), r"(?ims)^BEGIN:([A-Z0-9-]+)[ \t]*\r?\n.*?^END:\1[ \t]*(\r?\n|\z)", "")
    p = e.select("feed", "event", F.posexplode(F.split(own, r"\r?\n")).alias("nth", "line")).where("line <> ''")
    name = F.upper(F.regexp_extract("line", r"^([A-Za-z0-9-]+)", 1))
    pattern = r'^[A-Za-z0-9-]+((?:;[A-Za-z0-9-]+=(?:"[^"]*"|[^;:"]*))*):(.*)$'
    return p.select("feed", "event", "nth", name.alias("name"), F.regexp_extract("line", pattern, 1).alias("params"), F.regexp_extract("line", pattern, 2).alias("value"))


def events_of(properties: DataFrame) -> DataFrame:
    """One row an event: the last value and parameters of each property that counts, and DECLINED, the addresses of those who declined."""
    get = lambda n: F.max_by(F.when(F.col("name") == n, F.struct("value", "params")), F.when(F.col("name") == n, F.col("nth")))
    names = ["UID", "SUMMARY", "DTSTART", "DTEND", "DURATION", "RRULE", "STATUS", "TRANSP", "RECURRENCE-ID"]
    declined = (F.col("name") == "ATTENDEE") & F.col("params").rlike('(?i);PARTSTAT="?DECLINED"?(;|$)')
    address = F.lower(F.trim(F.regexp_replace("value", "(?i)^mailto:", "")))
    out = properties.groupBy("feed", "event").agg(*(get(n).alias(n) for n in names), F.collect_list(F.when(F.col("name") == "EXDATE", F.col("value"))).alias("EXDATE"), F.collect_list(F.when(F.col("name") == "RDATE", F.col("value"))).alias("RDATE"), F.collect_list(F.when(declined, address)).alias("DECLINED"))
    return out


def zone_known(zone: Column) -> Column:
    return F.try_to_timestamp(F.concat(F.lit("2000-01-01 00:00:00 "), zone), F.lit("yyyy-MM-dd HH:mm:ss VV")).isNotNull()


def ical_times(events: DataFrame, tz: str) -> DataFrame:
    """events with start_local, tzid, unknown_zone, all_day, length_us and bad_dates.

    Dates, UTC, zoned and floating times. A zone that isn't in the database
    (unknown_zone names it) is read as local. The length is from DTEND, in its
    own zone, else DURATION, else a day for dates and nothing for times.
    bad_dates counts the EXDATE and RDATE values that can't be read.
    """
    read = lambda x: F.coalesce(F.try_to_timestamp(F.regexp_replace(x, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(x, F.lit("yyyyMMdd")))

    def zone(name: str) -> tuple[Column, Column]:
        said = F.nullif(F.regexp_extract(S.text(F.col(f"{name}.params")), r'(?i)TZID="?([^;"]+)"?', 1), F.lit(""))
        utc = S.text(F.col(f"{name}.value")).endswith("Z")
        return F.when(utc, "UTC").when(zone_known(said), said).otherwise(F.lit(tz)), F.when(~utc & ~zone_known(said), said)

    v = F.col("DTSTART.value")
    (start_zone, unknown), (end_zone, _) = zone("DTSTART"), zone("DTEND")
    all_day = ~v.contains("T")
    at = lambda x, z: F.unix_micros(F.to_utc_timestamp(x, z))
    start, end = F.col("start_local"), read(F.col("DTEND.value"))
    length = F.coalesce(F.when(all_day, F.unix_micros(end) - F.unix_micros(start)).otherwise(at(end, F.coalesce("_end_zone", "tzid")) - at(start, F.col("tzid"))), S.iso_duration(F.col("DURATION.value")), F.when(all_day, F.lit(86_400_000_000)).otherwise(F.lit(0)))
    dates = F.flatten(F.transform(F.concat("EXDATE", "RDATE"), lambda x: F.split(x, ",")))
    out = events.withColumns({"start_local": read(v), "tzid": start_zone, "_end_zone": F.when(F.col("DTEND").isNotNull(), end_zone), "unknown_zone": unknown, "all_day": all_day, "bad_dates": F.size(F.filter(dates, lambda x: read(x).isNull())), "title": S.unescape_ical(S.text(F.col("SUMMARY.value"))), "uid": F.col("UID.value")})
    return out.withColumn("length_us", length).drop("_end_zone")


LONGEST_UID = 512


def meeting_filter(events: DataFrame, me: tuple[str, ...] = ()) -> DataFrame:
    """events with reason, the first that refuses them, else 'kept'. me: the addresses of whose calendar it is; without them no one's refusal is known to be theirs."""
    n = F.col("length_us")
    declined = F.arrays_overlap("DECLINED", F.array(*(F.lit(x.strip().lower()) for x in me))) if me else F.lit(False)
    return events.withColumn(
        "reason",
        F.when(F.col("start_local").isNull(), "unreadable").when(S.text(F.col("uid")) == "", "no uid").when(F.octet_length("uid") > LONGEST_UID, "uid too long").when(F.upper(S.text(F.col("STATUS.value"))) == "CANCELLED", "cancelled").when(F.col("all_day"), "all-day").when(F.upper(S.text(F.col("TRANSP.value"))) == "TRANSPARENT", "free").when(declined, "declined-by-me").when(n < 0, "negative").when(n > 86_400_000_000, "over a day").when(n == 0, "zero").otherwise("kept"),
    )


DOW = "MO TU WE TH FR SA SU".split()
MOST_OCCURRENCES, MOST_PERIODS = 10_000, 200_000
SECONDS = {"HOURLY": 3600, "MINUTELY": 60, "SECONDLY": 1}
RULE_PARTS = {
    "FREQ": "(SECOND|MINUTE|HOUR|WEEK|MONTH|YEAR)LY|DAILY",
    "INTERVAL": r"0*[1-9]\d{0,8}",
    "COUNT": r"0*[1-9]\d{0,8}",
    "UNTIL": r"\d{8}(T\d{6}Z?)?",
    "BYDAY": r"([+-]?\d{1,2})?(MO|TU|WE|TH|FR|SA|SU)(,([+-]?\d{1,2})?(MO|TU|WE|TH|FR|SA|SU))*",
    "BYMONTHDAY": r"[+-]?\d{1,2}(,[+-]?\d{1,2})*",
    "BYMONTH": r"\d{1,2}(,\d{1,2})*",
    "WKST": "MO|TU|WE|TH|FR|SA|SU",
}


def expand_recurrence(series: DataFrame, window_from: str, window_to: str) -> DataFrame:
    """(columns of series, at, outcome): the occurrences of rrule in [window_from, window_to), in UTC.

    series: start_local, tzid, rrule, and whatever else is to be kept. With a
    length_us, an occurrence that began before the window and runs into it is in. Dates are
    expanded in local time, so the clock stays over DST; hours, minutes and seconds
    pass evenly over it. COUNT counts from the start of the series. Days that a
    month lacks are skipped.

    outcome: expanded; truncated on all rows of a series that has more than
    MOST_OCCURRENCES in the window, or of which MOST_PERIODS shorter than a day
    were walked (then it has a row without at, too); unexpanded for a rule with a
    part that isn't supported, which gives one row without at.
    """
    keep = series.columns
    rule = F.upper(S.text(F.col("rrule")))
    freq = F.regexp_extract(F.concat(F.lit(";"), rule), ";FREQ=([^;]*)", 1)
    known = rule.rlike("^((" + "|".join(f"{k}=({v})" for k, v in RULE_PARTS.items()) + ")(;|$))+$") & (freq != "")
    wrong = rule.rlike(r"BYDAY=[^;]*\d") & ~freq.isin("MONTHLY", "YEARLY") | rule.contains("BYMONTHDAY=") & (freq == "WEEKLY")
    bad = (rule != "") & (~known | wrong)
    part = lambda n: F.nullif(F.regexp_extract(F.concat(F.lit(";"), F.upper(S.text(F.col("rrule")))), rf";{n}=([^;]*)", 1), F.lit(""))
    s = series.withColumn("_id", F.monotonically_increasing_id()).withColumns(
        {"_freq": part("FREQ"), "_every": F.coalesce(part("INTERVAL").try_cast("int"), F.lit(1)), "_count": part("COUNT").try_cast("int"), "_until": F.coalesce(F.try_to_timestamp(F.regexp_replace(part("UNTIL"), "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(part("UNTIL"), F.lit("yyyyMMdd")) + F.expr("interval 1 day - interval 1 microsecond")), "_byday": part("BYDAY"), "_bymonthday": part("BYMONTHDAY"), "_bymonth": part("BYMONTH"), "_wkst": F.coalesce(part("WKST"), F.lit("MO")), "_d0": F.to_date("start_local"), "_bad": bad}
    )
    end = F.least(F.to_date(F.lit(window_to)), F.coalesce(F.to_date("_until"), F.to_date(F.lit(window_to))))
    lasts = F.greatest(F.lit(0), F.coalesce(F.col("length_us"), F.lit(0))).cast("bigint") if "length_us" in keep else F.lit(0).cast("bigint")
    begin = F.when(F.col("_count").isNull(), F.greatest(F.col("_d0"), F.date_sub(F.to_date(F.lit(window_from)), (1 + F.ceil(lasts / 86_400_000_000)).cast("int")))).otherwise(F.col("_d0"))
    none = F.expr("cast(array() as array<bigint>)")
    long_date = lambda c: F.unix_date(c).cast("bigint")
    days = F.when(F.col("_freq").isNull(), F.array(long_date(F.col("_d0")))).when(F.date_add(end, 1) >= begin, F.sequence(long_date(begin), long_date(F.date_add(end, 1)))).otherwise(none)
    # of frequencies under a day, the numbers of the periods since the start; without BY parts each is an occurrence
    start = F.to_utc_timestamp("start_local", F.col("tzid"))
    unit = F.element_at(F.create_map(*(F.lit(x) for kv in SECONDS.items() for x in kv)), F.col("_freq"))
    s = s.withColumns({"_start_us": F.unix_micros(start), "_step_us": (unit * F.col("_every")).cast("bigint") * 1_000_000, "_plain": F.coalesce("_byday", "_bymonthday", "_bymonth").isNull()})
    period = lambda us: F.floor((us - F.col("_start_us")) / F.col("_step_us"))
    to_us = F.unix_micros(F.lit(window_to).cast("timestamp"))
    until_us = F.coalesce(F.unix_micros(F.to_utc_timestamp("_until", F.col("tzid"))), to_us)
    k0 = F.when(F.col("_plain") | F.col("_count").isNull(), F.greatest(F.lit(0), period(F.unix_micros(F.lit(window_from).cast("timestamp")) - lasts))).otherwise(0)
    k1 = F.least(period(F.least(to_us, until_us)), F.when(F.col("_plain"), F.col("_count").cast("bigint") - 1))
    s = s.withColumns({"_k0": k0.cast("bigint"), "_k1": k1.cast("bigint")}).withColumn("_clipped", F.coalesce(F.col("_k1") - F.col("_k0") >= MOST_PERIODS, F.lit(False)))
    periods = F.when(F.col("_k1") >= F.col("_k0"), F.sequence("_k0", F.least("_k1", F.col("_k0") + MOST_PERIODS - 1))).otherwise(none)
    sub = F.col("_step_us").isNotNull()
    mark = F.array(F.lit(None).cast("bigint"))
    x = s.withColumn("_k", F.explode(F.when(F.col("_bad"), mark).when(sub & F.col("_clipped"), F.concat(periods, mark)).when(sub, periods).otherwise(days)))
    x = x.withColumn("_at", F.when(sub, F.timestamp_micros(F.col("_start_us") + F.col("_k") * F.col("_step_us"))))
    x = x.withColumn("_d", F.when(sub, F.to_date(F.from_utc_timestamp("_at", F.col("tzid")))).otherwise(F.date_from_unix_date(F.col("_k").cast("int"))))
    d, d0 = F.col("_d"), F.col("_d0")
    months = lambda c: F.year(c) * 12 + F.month(c)
    wk = F.coalesce(F.array_position(F.array(*(F.lit(n) for n in DOW)), F.col("_wkst")) - 1, F.lit(0))
    week = lambda c: F.floor((F.datediff(c, F.lit("1970-01-05").cast("date")) - wk) / 7)
    step = F.when(F.col("_freq") == "DAILY", F.datediff(d, d0)).when(F.col("_freq") == "WEEKLY", week(d) - week(d0)).when(F.col("_freq") == "MONTHLY", months(d) - months(d0)).when(F.col("_freq") == "YEARLY", F.year(d) - F.year(d0)).otherwise(0)
    name = F.get(F.array(*(F.lit(n) for n in DOW)), F.weekday(d))
    last = F.dayofmonth(F.last_day(d))
    yearly = (F.col("_freq") == "YEARLY") & F.col("_bymonth").isNull()
    nth = F.when(yearly, F.floor((F.dayofyear(d) - 1) / 7) + 1).otherwise(F.floor((F.dayofmonth(d) - 1) / 7) + 1)
    year_days = F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))
    back = F.when(yearly, -(F.floor((year_days - F.dayofyear(d)) / 7) + 1)).otherwise(-(F.floor((last - F.dayofmonth(d)) / 7) + 1))
    listed = lambda c, *vals: F.arrays_overlap(F.transform(F.split(c, ","), lambda v: F.regexp_replace(v, r"^\+", "")), F.array(*(v.cast("string") for v in vals)))
    by_day = F.when(F.col("_byday").isNotNull(), listed(F.col("_byday"), name, F.concat(nth.cast("string"), name), F.concat(back.cast("string"), name)))
    by_monthday = F.when(F.col("_bymonthday").isNotNull(), listed(F.col("_bymonthday"), F.dayofmonth(d), F.dayofmonth(d) - last - 1))
    by_month = F.when(F.col("_bymonth").isNotNull(), listed(F.col("_bymonth"), F.month(d)))
    unlisted = F.col("_byday").isNull() & F.col("_bymonthday").isNull()
    same = F.when(~unlisted, True).when(F.col("_freq") == "WEEKLY", F.weekday(d) == F.weekday(d0)).when(F.col("_freq") == "MONTHLY", F.dayofmonth(d) == F.dayofmonth(d0)).when(F.col("_freq") == "YEARLY", (F.dayofmonth(d) == F.dayofmonth(d0)) & (F.col("_bymonth").isNotNull() | (F.month(d) == F.month(d0)))).otherwise(True)
    ok = (d >= d0) & (step % F.greatest("_every", F.lit(1)) == 0) & same
    for c in (by_day, by_monthday, by_month):
        ok = ok & F.coalesce(c, F.lit(True))
    marked = F.col("_k").isNull()
    x = x.where(marked | F.col("_freq").isNull() | ok)
    local = F.timestamp_micros(F.unix_micros(d.cast("timestamp")) + F.unix_micros("start_local") - F.unix_micros(d0.cast("timestamp")))
    x = x.withColumn("_local", F.when(sub, F.from_utc_timestamp("_at", F.col("tzid"))).otherwise(local)).where(marked | F.col("_until").isNull() | (F.col("_local") <= F.col("_until")))
    series_ = W.partitionBy("_id")
    nth_ = F.when(sub & F.col("_plain"), F.col("_k") + 1).otherwise(F.row_number().over(series_.orderBy(F.asc_nulls_last("_k"))))
    # a clipped series that has its COUNT all the same is whole
    x = x.withColumn("_n", nth_).withColumn("_whole", F.coalesce(F.max(F.when(~marked, F.col("_n"))).over(series_) >= F.col("_count"), F.lit(False))).where(marked | (F.col("_n") <= F.coalesce(F.col("_count").cast("bigint"), F.col("_n"))))
    x = x.withColumn("at", F.when(~marked, F.coalesce("_at", F.to_utc_timestamp("_local", F.col("tzid")))))
    opens = F.lit(window_from).cast("timestamp")
    x = x.where(marked | ((F.col("at") >= opens) | (F.unix_micros("at") + lasts > F.unix_micros(opens))) & (F.col("at") < F.lit(window_to).cast("timestamp")))
    x = x.withColumns({"_w": F.row_number().over(series_.orderBy(F.asc_nulls_last("_k"))), "_in": F.count("_k").over(series_)})
    over = (F.col("_in") > MOST_OCCURRENCES) | sub & F.col("_clipped") & ~F.col("_whole")
    x = x.withColumn("outcome", F.when(F.col("_bad"), "unexpanded").when(F.coalesce(over, F.lit(False)), "truncated").otherwise("expanded"))
    return x.where(F.when(marked, F.col("outcome") != "expanded").otherwise(F.col("_w") <= MOST_OCCURRENCES)).select(*keep, "at", "outcome")


def recurrence_overrides(occurrences: DataFrame, excluded: DataFrame, overridden: DataFrame, added: DataFrame) -> DataFrame:
    """(uid, at): occurrences without the excluded and the overridden ones, with the added ones, each once.

    overridden may have a column reason (as meeting_filter gives): an override
    that is unreadable, negative or over-long in its uid is broken and leaves its occurrence.
    """
    if "reason" in overridden.columns:
        overridden = overridden.where("reason is null or reason not in ('unreadable', 'no uid', 'uid too long', 'negative')")
    rows = occurrences.where("at is not null").select("uid", "at").unionByName(added.where("at is not null").select("uid", "at"))
    for gone in (excluded, overridden):
        rows = rows.join(gone.select("uid", "at"), ["uid", "at"], "left_anti")
    return rows.dropDuplicates(["uid", "at"])


def meeting_to_trace(occurrences: DataFrame, calendar: str) -> DataFrame:
    return occurrences.where("at is not null").select(F.lit("calendar").alias("source"), F.lit("event").alias("type"), S.meeting_external_id(F.lit(calendar), F.col("uid"), F.col("at")).alias("external_id"), F.col("at").alias("ts"), (F.col("length_us") / 1000).cast("bigint").alias("duration_ms"), F.col("title"))


IDENTITY = ["actor_id", "source", "external_id"]


def earliest(rows: DataFrame) -> DataFrame:
    """Each identity once, the row with the earliest time; a repeated identity is combined in each task first."""
    return rows.groupBy(*IDENTITY).agg(F.min_by(F.struct(*rows.columns), F.struct(F.col("ts").isNull(), "ts")).alias("r")).select("r.*")


def append_dedup(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of new that stored has not, each identity once (the earliest)."""
    return earliest(new).join(stored.select(*IDENTITY), IDENTITY, "left_anti")


def incremental_scan(rows: DataFrame, cursors: DataFrame, overlap_days: int = 7) -> DataFrame:
    """Rows since the cursor of their actor and source less the overlap; all rows where there is none."""
    c = cursors.select("actor_id", "source", (F.col("cursor") - F.make_dt_interval(F.lit(overlap_days))).alias("_from"))
    return rows.join(c, ["actor_id", "source"], "left").where(F.col("_from").isNull() | (F.col("ts") >= F.col("_from"))).drop("_from")


#: What may become of what a source holds, by source: every one is counted, and 0 is said as well.
OUTCOMES = {
    "agent-log": ("found", "skipped", "malformed"),
    "browser": ("kept", "not_web", "ignored", "unparseable"),
    "calendar": ("kept", "unreadable", "no uid", "uid too long", "cancelled", "all-day", "free", "declined-by-me", "negative", "over a day", "zero"),
    "git": ("found", "out_of_range", "malformed", "collapsed"),
}


def import_accounting(counts: dict[str, dict[str, int]], spark: SparkSession) -> DataFrame:
    """(source, outcome, n) of the counters that a run's sources gave."""
    return spark.createDataFrame([(s, o, n) for s, of in counts.items() for o, n in of.items()], "source string, outcome string, n bigint")


def note_dedup(notes: DataFrame, most: int = 20) -> DataFrame:
    """Problems by kind with their number and first example; the report holds most kinds."""
    return notes.groupBy("kind").agg(F.count("*").alias("n"), F.min("detail").alias("example")).orderBy(F.desc("n"), "kind").limit(most)
