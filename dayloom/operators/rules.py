"""Names for traces from a prioritised dictionary: a table of rules.

Rules are matched on the distinct values of their kind: directories by hash join
on their prefixes, hosts on their suffixes, expressions on the distinct texts. A
rule holds from its day on, so matches carry that day, not the days of entries. A rule of
an actor and one for everybody (actor_id null) are both found by the join key
scope, the actor or '*'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import scalars as S
from ..sources.store import stored
from .literals import GRAM, LOWER, UPPER, needed

#: Score of a literal match, above that of every expression.
LITERAL = 1 << 20
TARGET = ("actor_id", "source", "cwd", "git_branch", "host", "port", "path_head", "title", "local_day")


def parse_rules(rules: DataFrame) -> DataFrame:
    """Rules as written (rule_id in the order written, actor_id, level, project, subject, kind, value, since) with what matching needs."""
    v = S.text(F.col("value"))
    glob = (F.col("kind") == "path") & v.endswith("*")
    prefix = F.when(glob, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.regexp_replace(v, "(?<=.)/+$", ""))
    place = F.regexp_extract(v, "^([^/]*)", 1)
    port = F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*):(\d+)$", 1)
    host = S.canonical_host(F.when(port != "", F.regexp_replace(place, r":\d+$", "")).otherwise(place))
    key = F.col("kind") == "key"
    return rules.withColumns(
        {
            "scope": F.coalesce("actor_id", F.lit("*")),
            "glob": glob,
            "prefix": F.when(F.col("kind") == "path", prefix).otherwise(""),
            "subtree": F.col("level") != "never",
            "rule_host": F.when(key, host).otherwise(""),
            "rule_port": F.when(key, port).otherwise(""),
            "segment": F.when(key & v.contains("/"), F.regexp_extract(v, "/(.*)$", 1)).otherwise(""),
            "since_day": F.to_date("since"),
            "project": S.text(F.col("project")),
            "subject": S.text(F.col("subject")),
        }
    ).withColumn("is_address", S.is_address(F.col("rule_host")))


#: The columns that rules of a kind read.
READS = {"path": ("cwd",), "key": ("host", "port", "path_head"), "branch": ("git_branch",), "title": ("title",)}


def values() -> dict[str, Column]:
    """What rules read of an entry: directories and branches count for agent logs and git, keys for browsers, titles for all."""
    work, web = F.col("source").isin("agent-log", "git"), F.col("source") == "browser"
    return {
        "cwd": F.when(work, S.trimmed_path(F.col("cwd"))).otherwise(""),
        "git_branch": F.when(work, S.text(F.col("git_branch"))).otherwise(""),
        "host": F.when(web, S.canonical_host(F.col("host"))).otherwise(""),
        "port": F.when(web, S.text(F.col("port"))).otherwise(""),
        "path_head": F.when(web, S.text(F.col("path_head"))).otherwise(""),
        "title": S.text(F.col("title")),
    }


def targets(entries: DataFrame) -> DataFrame:
    """Distinct combinations of what rules read, by tid."""
    v = values()
    return with_tid(entries.select(*(v[c].alias(c) if c in v else F.col(c) for c in TARGET)).distinct(), read=True)


def with_tid(entries: DataFrame, read: bool = False) -> DataFrame:
    """entries with the tid of their target."""
    v = {} if read else values()
    return entries.withColumn("tid", F.sha2(F.concat_ws("\x1f", *(F.coalesce(v.get(c, F.col(c)).cast("string"), F.lit("\x1e")) for c in TARGET)), 224))


def scoped(df: DataFrame) -> DataFrame:
    return df.withColumn("scope", F.explode(F.array(F.col("actor_id"), F.lit("*"))))


def rule_in_force() -> Column:
    return F.col("since_day").isNull() | (F.col("local_day") >= F.col("since_day"))


def _matches(joined: DataFrame, reads: tuple[str, ...], n: Column, capture: Column) -> DataFrame:
    since = F.coalesce(F.datediff("since_day", F.lit("1970-01-01").cast("date")), F.lit(0))
    return joined.select("actor_id", *reads, "rule_id", "level", "project", "subject", "kind", "value", "since_day", n.cast("long").alias("n"), since.cast("long").alias("since_n"), capture.alias("capture"))


def _distinct(values_: DataFrame, kind: str) -> DataFrame:
    first = READS[kind][0]
    return values_.where(F.col(first) != "").select("actor_id", *READS[kind]).distinct()


def path_matches(values_: DataFrame, rules: DataFrame) -> DataFrame:
    """Directory prefix join on distinct directories: the directory itself and what lies under it, or a plain prefix for entries that end in '*'; never-entries take one directory.

    A directory asks with its prefixes that end where a name does, and for
    entries with '*' with those as long as one of them.
    """
    r = rules.where("kind = 'path' and prefix <> ''").drop("actor_id")
    lengths = [x["n"] for x in r.where("glob").select(F.length("prefix").alias("n")).distinct().collect()]
    d = scoped(_distinct(values_, "path"))
    names = F.split("cwd", "/", -1)
    whole = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), "/"))
    parts = F.array_distinct(F.concat(whole, F.array(F.lit("/"), F.col("cwd"))))
    plain = d.withColumn("prefix", F.explode(parts)).join(r.where("not glob"), ["scope", "prefix"])
    plain = plain.where((F.col("cwd") == F.col("prefix")) | F.col("subtree") & F.expr("startswith(cwd, concat(prefix, '/'))"))
    globs = d.withColumn("prefix", F.explode(F.array_distinct(F.array(*(F.left("cwd", F.lit(n)) for n in lengths))) if lengths else F.expr("cast(array() as array<string>)"))).join(r.where("glob"), ["scope", "prefix"])
    return _matches(plain.unionByName(globs), READS["path"], LITERAL + F.octet_length("prefix"), F.lit(""))


def key_matches(values_: DataFrame, rules: DataFrame) -> DataFrame:
    """Host suffix join on distinct keys: host or parent domain (addresses exactly), then port and first segment where the entry names them."""
    labels = F.split("host", r"\.")
    suffixes = F.when(S.is_address(F.col("host")), F.array("host")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    p = scoped(_distinct(values_, "key")).withColumn("rule_host", F.explode(suffixes))
    r = rules.where("kind = 'key' and rule_host <> ''").drop("actor_id")
    ok = ((F.col("host") == F.col("rule_host")) | ~F.col("is_address")) & ((F.col("rule_port") == "") | (F.col("rule_port") == F.col("port"))) & ((F.col("segment") == "") | (F.col("segment") == F.col("path_head")))
    return _matches(p.join(r, ["scope", "rule_host"]).where(ok), READS["key"], LITERAL + F.octet_length("value"), F.lit(""))


def grams(text: Column) -> Column:
    """The distinct runs of GRAM characters of a text, ASCII letters folded; none in a shorter one."""
    folded = F.translate(text, UPPER, LOWER)
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(folded, i, F.lit(GRAM))))).otherwise(F.expr("cast(array() as array<string>)"))


def with_needed(rules: DataFrame, kind: str) -> DataFrame:
    """The expressions of a kind with needed: strings of which a match contains one, null if that can't be told."""
    read = F.udf(needed, ArrayType(StringType()))  # a row a rule
    return rules.where(F.col("kind") == kind).drop("actor_id").withColumn("needed", read("value"))


def loose_rules(rules: DataFrame) -> DataFrame:
    """(kind, rules): how many expressions meet every text of their scope, as nothing can be said of what they need."""
    found = with_needed(rules, "branch").unionByName(with_needed(rules, "title"))
    return found.where("needed is null").groupBy("kind").agg(F.count("*").alias("rules"))


def text_matches(texts: DataFrame, expressions: DataFrame) -> DataFrame:
    """(scope, s, columns of expressions): the texts (scope, s) that expressions match. expressions: with_needed.

    An expression asks by the gram of each needed string that is rarest in the
    texts, and is tried on the texts that have the gram and the string, so rows
    grow with what comes near a match. Expressions without such a string are
    tried on all texts of their scope.
    """
    texts = texts.join(expressions.select("scope").distinct(), "scope", "left_semi")
    asked = expressions.where("needed is not null").withColumn("string", F.explode("needed")).withColumn("gram", F.explode(grams(F.col("string"))))
    held = texts.withColumn("gram", F.explode(grams(F.col("s")))).join(asked.select("scope", "gram").distinct(), ["scope", "gram"], "left_semi")
    held = stored(held)
    often = held.groupBy("scope", "gram").agg(F.count("*").alias("n"))
    rarest = asked.join(often, ["scope", "gram"], "left").groupBy("scope", "rule_id", "string").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    near = held.join(rarest, ["scope", "gram"]).where(F.translate("s", UPPER, LOWER).contains(F.col("string"))).select("scope", "s", "rule_id").distinct()
    tight = near.join(expressions, ["scope", "rule_id"])
    loose = texts.join(expressions.where("needed is null"), "scope")
    return tight.unionByName(loose).where(F.expr("rlike(s, value)"))


def regex_matches(values_: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """Expressions on distinct branches or titles, all of score 1, with their first group. A text that many actors have meets the rules for everybody once."""
    (column,) = READS[kind]
    p = scoped(_distinct(values_, kind)).withColumn("s", F.col(column))
    joined = p.join(text_matches(p.select("scope", "s").distinct(), with_needed(rules, kind)), ["scope", "s"])
    group = F.when(F.col("value").rlike(r"(?<!\\)\((?!\?)"), F.expr("regexp_extract(s, value, 1)")).otherwise("")
    return _matches(joined, READS[kind], F.lit(1), group)


def _hits(t: DataFrame, matches: DataFrame, kind: str) -> DataFrame:
    """The matches of targets: values meet rules once, however many days and combinations have them."""
    return t.join(matches, ["actor_id", *READS[kind]]).where(rule_in_force()).select("tid", "rule_id", "level", "project", "subject", "kind", "value", "n", "since_n", "capture")


def match_paths(t: DataFrame, rules: DataFrame) -> DataFrame:
    return _hits(t, path_matches(t, rules), "path")


def match_keys(t: DataFrame, rules: DataFrame) -> DataFrame:
    return _hits(t, key_matches(t, rules), "key")


def match_regex(t: DataFrame, rules: DataFrame) -> DataFrame:
    return _hits(t, regex_matches(t, rules, "branch"), "branch").unionByName(_hits(t, regex_matches(t, rules, "title"), "title"))


def all_hits(t: DataFrame, rules: DataFrame) -> DataFrame:
    return match_paths(t, rules).unionByName(match_keys(t, rules)).unionByName(match_regex(t, rules))


def never_floor(hits: DataFrame) -> DataFrame:
    """(tid, kind, floor): the score (n, since) that a literal match of that kind must beat."""
    return hits.where("level = 'never'").groupBy("tid", "kind").agg(F.max(F.struct("n", "since_n")).alias("floor"))


def above_floor(hits: DataFrame) -> DataFrame:
    """Project and subject hits that beat the floor of their kind."""
    on = hits.where("level in ('project', 'subject')").join(never_floor(hits), ["tid", "kind"], "left")
    return on.where(F.col("floor").isNull() | (F.struct("n", "since_n") > F.col("floor"))).drop("floor")


def best_rule(hits: DataFrame) -> DataFrame:
    """The best project rule of each target: longest, then latest, then first written."""
    w = W.partitionBy("tid").orderBy(F.desc("n"), F.desc("since_n"), "rule_id")
    return hits.where("level = 'project'").withColumn("nth", F.row_number().over(w)).where("nth = 1").select("tid", "rule_id", "project", "n")


HIT = ("level", "kind", "n", "since_n", "rule_id", "project", "subject", "capture", "value", "since_day")


def hit_arrays(read: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """By kind: (actor_id, values, hits), the matches of each distinct value of read (actor_id and what rules read)."""
    matches = {"path": path_matches, "key": key_matches, "branch": lambda v, r: regex_matches(v, r, "branch"), "title": lambda v, r: regex_matches(v, r, "title")}
    kinds = {r["kind"] for r in rules.select("kind").distinct().collect()}  # the four kinds at most
    return {k: f(read, rules).groupBy("actor_id", *READS[k]).agg(F.collect_list(F.struct(*HIT)).alias("hits")) for k, f in matches.items() if k in kinds}


def decide(h: DataFrame, keep: list[str]) -> DataFrame:
    """keep plus rule_project, by_rule, silenced, covered, rule_subject and ambiguous, from the array hits of rules in force."""
    score = lambda x: F.struct(x["n"], x["since_n"])
    floor = lambda kind: F.array_max(F.transform(F.filter("hits", lambda x: (x["level"] == "never") & (x["kind"] == kind)), score))
    h = h.select(*keep, "hits", floor("path").alias("path_floor"), floor("key").alias("key_floor"))
    beats = lambda x, kind, c: (x["kind"] != kind) | F.col(c).isNull() | (score(x) > F.col(c))
    h = h.withColumn("open", F.filter("hits", lambda x: x["level"].isin("project", "subject") & beats(x, "path", "path_floor") & beats(x, "key", "key_floor")))
    order = lambda x, name: ((-x["n"]).alias("a"), (-x["since_n"]).alias("b"), x["rule_id"].alias("c"), name.alias("name"))
    h = h.withColumn("best", F.array_min(F.transform(F.filter("open", lambda x: x["level"] == "project"), lambda x: F.struct(*order(x, x["project"])))))
    name = lambda x: F.when(x["subject"] != "", x["subject"]).otherwise(x["capture"])
    mine = F.filter("open", lambda x: (x["level"] == "subject") & ((x["project"] == "") | (x["project"] == F.col("best.name"))) & (name(x) != ""))
    h = h.withColumn("sub", F.array_min(F.transform(mine, lambda x: F.struct((x["project"] == "").alias("own"), *order(x, name(x))))))
    amb = F.array_min(F.transform(F.filter("hits", lambda x: x["level"] == "ambiguous"), lambda x: F.struct((x["kind"] != "path").alias("o"), x["rule_id"].alias("r"), F.concat(x["kind"], F.lit(":"), x["value"]).alias("entry"))))
    return h.select(
        *keep,
        S.text(F.col("best.name")).alias("rule_project"),
        F.col("best").isNotNull().alias("by_rule"),
        F.col("path_floor").isNotNull().alias("silenced"),
        F.exists("hits", lambda x: x["level"] != "subject").alias("covered"),
        S.text(F.col("sub.name")).alias("rule_subject"),
        S.text(amb["entry"]).alias("ambiguous"),
    )


def era(rules: DataFrame) -> Column:
    """How many of the days from which a rule holds have come by local_day: the same rules are in force on all days of an era."""
    days = [r["since_day"] for r in rules.where("since_day is not null").select("since_day").distinct().collect()]  # days of the calendar
    return F.size(F.filter(F.array(*(F.lit(d) for d in sorted(days))), lambda d: d <= F.col("local_day"))) if days else F.lit(0)


def named(entries: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """entries with project, subject, by_rule, covered and ambiguous: the rules' names, else the guess made at import unless silenced.

    Rules meet distinct values of their kind, and what they say is decided once
    for each combination of values and era. Entries join that by plain columns.
    """
    guess = S.text(F.col("project"))
    if rules is None:
        return entries.withColumns({"project": guess, "subject": F.lit(""), "by_rule": F.lit(False), "covered": F.lit(False), "ambiguous": F.lit("")})
    rules = stored(parse_rules(rules))
    now, reads = era(rules), list(values())
    read = stored(entries.select("actor_id", "local_day", *(x.alias(c) for c, x in values().items()), now.alias("era")).groupBy("actor_id", *reads, "era").agg(F.min("local_day").alias("local_day")))
    told, arrays = read, []
    for k, t in hit_arrays(read, rules).items():
        told = told.join(t.withColumnRenamed("hits", f"_hits_{k}"), ["actor_id", *READS[k]], "left")
        arrays.append(F.coalesce(F.col(f"_hits_{k}"), F.expr(f"cast(array() as {t.schema['hits'].dataType.simpleString()})")))
    if arrays:
        in_force = F.filter(F.concat(*arrays), lambda x: x["since_day"].isNull() | (F.col("local_day") >= x["since_day"]))
        told = stored(decide(told.select(*read.columns, in_force.alias("hits")), read.columns))
    else:
        told = read.withColumns({"rule_project": F.lit(""), "by_rule": F.lit(False), "silenced": F.lit(False), "covered": F.lit(False), "rule_subject": F.lit(""), "ambiguous": F.lit("")})
    new = ["rule_project", "by_rule", "silenced", "covered", "rule_subject", "ambiguous"]
    told = told.select(F.col("actor_id").alias("_actor"), F.col("era").alias("_of_era"), *(F.col(c).alias(f"_of_{c}") for c in reads), *new)
    e = entries.drop("subject", *new).withColumns({f"_{c}": x for c, x in values().items()} | {"_era": now})
    on = F.col("actor_id").eqNullSafe(F.col("_actor"))
    for c in [*reads, "era"]:
        on = on & (F.col(f"_{c}") == F.col(f"_of_{c}"))
    e = e.join(told, on, "left").drop("_actor", *(f"_{c}" for c in [*reads, "era"]), *(f"_of_{c}" for c in [*reads, "era"]))
    kept = F.when((F.col("fallback") == "cwd-basename") & ~F.col("silenced"), guess).otherwise("")
    return e.withColumns({"project": F.when(F.col("by_rule"), F.col("rule_project")).otherwise(kept), "subject": F.col("rule_subject")}).drop("rule_project", "rule_subject", "silenced")


def rules_start_inside(rules: DataFrame, first: str, last: str) -> DataFrame:
    """Rules that start strictly inside a range of days."""
    return parse_rules(rules).where((F.col("since_day") > F.lit(first).cast("date")) & (F.col("since_day") <= F.lit(last).cast("date"))).select("level", "project", "subject", "kind", "value", F.col("since_day").cast("string").alias("since")).distinct()


def shadowed(r: DataFrame) -> DataFrame:
    """(rule_id, by): parsed rules of projects and subjects that a never-entry refuses wherever they hold, with the first such entry.

    Only an entry of the same kind, at least as specific and in force from the
    same day can: for a directory one that ends in '*' with the same prefix, for
    a key one that covers its host, port and segment. A rule looks its prefix,
    or the suffixes of its host, up among the entries; one for everybody is
    refused by an entry for everybody alone.
    """
    since = F.coalesce("since_day", F.lit("0001-01-01").cast("date"))
    n = r.where("level = 'never'").select(F.col("scope").alias("seen_by"), "kind", since.alias("from_day"), F.col("rule_id").alias("by"), "glob", "prefix", F.col("rule_host").alias("host"), F.col("rule_port").alias("n_port"), F.col("segment").alias("n_segment"), F.octet_length("value").alias("n_length"))
    rule = r.where("level in ('project', 'subject')").withColumns({"from_day": since, "seen_by": F.explode(F.array_distinct(F.array("scope", F.lit("*"))))})
    paths = rule.where("kind = 'path' and prefix <> ''").join(n.where("kind = 'path' and glob").select("seen_by", "from_day", "prefix", "by"), ["seen_by", "from_day", "prefix"])
    labels = F.split("rule_host", r"\.")
    suffixes = F.when(F.col("is_address"), F.array("rule_host")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    keys = rule.where("kind = 'key' and rule_host <> ''").withColumn("host", F.explode(suffixes)).join(n.where("kind = 'key' and host <> ''").drop("glob", "prefix", "kind"), ["seen_by", "from_day", "host"])
    covers = ((F.col("n_port") == "") | (F.col("n_port") == F.col("rule_port"))) & ((F.col("n_segment") == "") | (F.col("n_segment") == F.col("segment")))
    keys = keys.where(covers & (F.col("n_length") >= F.octet_length("value")))
    return paths.select("rule_id", "by").unionByName(keys.select("rule_id", "by")).groupBy("rule_id").agg(F.min("by").alias("by"))


def dead_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, problem): rules that can't fire, as a never-entry refuses all they match, and entries with a flaw of their own."""
    r = parse_rules(rules)
    flaw = F.when(F.col("value").isNull() | (F.col("value") == ""), "empty").when((F.col("kind") == "key") & F.col("rule_port").isin("80", "443"), "default port").when((F.col("level") == "subject") & (F.col("subject") == "") & ~((F.col("kind").isin("title", "branch")) & F.col("value").rlike(r"(?<!\\)\((?!\?)")), "no capture").when(~F.col("kind").isin("path", "key", "branch", "title"), "no matcher")
    return shadowed(r).select("rule_id", F.lit("covered by never").alias("problem")).unionByName(r.select("rule_id", flaw.alias("problem")).where("problem is not null"))
