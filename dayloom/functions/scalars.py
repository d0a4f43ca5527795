"""Column expressions for hosts, keys, paths, labels and local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCES = ("agent-log", "browser", "calendar", "git")
OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}(\.{OCTET}){{3}}$"
#: Characters that can't be seen: controls, formats, line and paragraph separators.
UNSEEN = r"[\p{Cc}\p{Cf}\u2028\u2029]"
# The reflog verbs that are kept, and the qualifiers that may follow one.
VERBS = ("am", "applypatch", "branch", "checkout", "cherry-pick", "clone", "commit", "detach", "fetch", "filter-branch", "gc", "initial", "merge", "pull", "push", "rebase", "reset", "revert", "stash", "update-ref")
QUALIFIERS = ("(abort)", "(amend)", "(cherry-pick)", "(continue)", "(edit)", "(finish)", "(fixup)", "(initial)", "(merge)", "(no-ff)", "(pick)", "(reword)", "(squash)", "(start)")


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def ipv6(host: Column) -> Column:
    """Eight groups without leading zeros, the longest run of two or more zero groups as '::' (the first of equals)."""
    halves = F.split(host, "::")
    groups = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")
    left, right = groups(F.get(halves, 0)), groups(text(F.get(halves, 1)))
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
    plain = F.array_join(F.transform(full, lambda x: F.regexp_replace(x, "^0+(?=.)", "")), ":")

    def short(p: Column) -> Column:
        out = F
        for n in range(8, 1, -1):  # the longest run first
            zeros = ":".join(["0"] * n)
            around = rf"^(.*?)(?:^|:){zeros}(?::|$)(.*)$"
            out = out.when(p.rlike(around), F.regexp_replace(p, around, "$1::$2"))
        return out.otherwise(p)

    return F.get(F.transform(F.array(plain), short), 0)  # bound once, used often


def canonical_host(host: Column) -> Column:
    """Lower case, characters that can't be seen as U+FFFD, one final dot off, IPv6 in its shortest form without brackets."""
    h = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text(host), UNSEEN, "\ufffd")), r"^\[|\]$", ""), r"(?<=.)\.$", "")
    return F.when(h.rlike("^[0-9a-f:]*:[0-9a-f:]*$"), ipv6(h)).otherwise(h)


def is_address(host: Column) -> Column:
    return host.rlike(IPV4) | host.contains(":")


def effective_port(scheme: Column, port: Column) -> Column:
    """'' for a missing port and for the scheme's own."""
    return F.when((F.lower(scheme) == "http") & (port == "80") | (F.lower(scheme) == "https") & (port == "443"), "").otherwise(text(port))


def path_head(path: Column) -> Column:
    """First segment of the decoded path up to a character out of the ordinary, 64 characters at most."""
    decoded = F.coalesce(F.try_url_decode(F.replace(text(path), F.lit("+"), F.lit("%2B"))), text(path))
    segment = F.regexp_extract(decoded, "^/*([^/]*)", 1)
    return F.left(F.regexp_extract(segment, r"^[\p{L}\p{Nd}\p{M}\-._~!$'()*+:@ ]*", 0), F.lit(64))


def printable(s: Column, limit: int = 4096) -> Column:
    """Controls, format characters and line separators become spaces."""
    return F.left(F.regexp_replace(text(s), r"[\p{Cc}\p{Cf}  ]", " "), F.lit(limit))


def browser_key(host: Column, port: Column, head: Column) -> Column:
    """host[:port][/head], IPv6 in brackets; '' without a host."""
    name = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return F.when(text(host) == "", "").otherwise(F.concat(name, F.when(text(port) != "", F.concat(F.lit(":"), port)).otherwise(""), F.when(text(head) != "", F.concat(F.lit("/"), head)).otherwise("")))


def trimmed_path(cwd: Column) -> Column:
    return F.regexp_replace(text(cwd), "/+$", "")


def trace_id(key: Column, path: Column) -> Column:
    return F.when(key != "", F.concat(F.lit("key:"), key)).when(path != "", F.concat(F.lit("path:"), path)).otherwise("")


def cwd_basename(cwd: Column) -> Column:
    return F.element_at(F.split(trimmed_path(cwd), "/"), -1)


def split_key(key: Column) -> list[Column]:
    """host_port and segment of a browser key."""
    return [F.substring_index(key, "/", 1).alias("host_port"), F.when(key.contains("/"), F.regexp_extract(key, "/(.*)$", 1)).otherwise("").alias("segment")]


def reflog_verb(message: Column) -> Column:
    """The first word before ': ', if it is on the list, with the first of the next two that is a listed qualifier; else 'other'."""
    fields = F.filter(F.split(F.substring_index(message, ": ", 1), r"\s+"), lambda x: x != "")
    verb = F.lower(F.get(fields, 0))
    qualifier = F.get(F.filter(F.transform(F.slice(fields, 2, 2), F.lower), lambda x: x.isin(*QUALIFIERS)), 0)
    return F.when(~F.coalesce(verb.isin(*VERBS), F.lit(False)), "other").otherwise(F.concat_ws(" ", verb, qualifier))


def unescape_ical(s: Column) -> Column:
    r"""\n and \N, \\, \; and \, in one pass."""
    mark = "\u0001"
    s = F.replace(s, F.lit("\\\\"), F.lit(mark))
    s = F.regexp_replace(s, r"\\[nN]", "\n")
    return F.replace(F.regexp_replace(s, r"\\([;,])", "$1"), F.lit(mark), F.lit("\\"))


def iso_duration(s: Column) -> Column:
    """Microseconds of [+-]PnW or [+-]PnDTnHnMnS; null if it is neither."""
    ok = s.rlike(r"^[+-]?P(\d+W|(?=\d|T\d)(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+S)?)?)$")
    n = lambda unit: F.coalesce(F.regexp_extract(s, rf"(\d+){unit}", 1).try_cast("bigint"), F.lit(0))
    seconds = n("W") * 604800 + n("D") * 86400 + n("H") * 3600 + n("M") * 60 + n("S")
    return F.when(ok, F.when(s.startswith("-"), -seconds).otherwise(seconds) * 1_000_000)


def visit_external_id(profile: Column, visit: Column) -> Column:
    return F.concat_ws("/", profile, visit.cast("string"))


def meeting_external_id(calendar: Column, uid: Column, at: Column) -> Column:
    return F.concat_ws("/", calendar, uid, F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def reflog_external_id(repo: Column, at: Column, sha: Column) -> Column:
    return F.concat_ws("/", repo, F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.left(sha, F.lit(12)))


def local_day(ts: Column, tz: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def day_bounds(day: Column, tz: Column) -> tuple[Column, Column]:
    """First and last instant of a local day, in microseconds; 23 to 25 hours apart."""
    at = lambda d: F.unix_micros(F.to_utc_timestamp(d.cast("timestamp"), tz))
    return at(day), at(F.date_add(day, 1))


def week_range(day: Column) -> list[Column]:
    monday = F.to_date(F.date_trunc("week", day))
    return [monday.alias("week_from"), F.date_add(monday, 6).alias("week_to")]
