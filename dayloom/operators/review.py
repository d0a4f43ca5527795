"""The review queue of a day: what no rule could name, with what helps to answer it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.traces import D
from .blocks import B
from .rollup import order_projects, ordered, top

MIN_SPLIT_US = 300_000_000


def trace_columns(df: DataFrame) -> DataFrame:
    """df with trace, and the host_port and segment of its key."""
    host_port, segment = S.split_key(F.col("key"))
    return df.withColumns({"trace": S.trace_id(F.col("key"), F.col("path")), "host_port": host_port, "segment": segment})


def first_seen_traces(b: DataFrame) -> DataFrame:
    """(actor_id, trace, first_day): of paths, keys, and keys without their segment."""
    t = trace_columns(b.select("actor_id", "local_day", "key", "path"))
    t = t.withColumn("trace", F.explode(F.array_distinct(F.array("trace", F.when(F.col("key") != "", F.concat(F.lit("key:"), "host_port")).otherwise(F.col("trace"))))))
    return t.where("trace <> ''").groupBy("actor_id", "trace").agg(F.min("local_day").alias("first_day"))


def questions(unmatched: DataFrame, first_seen: DataFrame) -> DataFrame:
    """unmatched with trace and first_today."""
    q = trace_columns(unmatched)
    return q.join(first_seen, ["actor_id", "trace"], "left").withColumn("first_today", F.coalesce(F.col("first_day") == F.col("local_day"), F.lit(False))).drop("first_day")


def fold_by_host(q: DataFrame) -> DataFrame:
    """Keys of one host and port become one question; a lone key keeps its segment; first_today if all are."""
    one = F.when((F.col("key") != "") & (F.count("*").over(W.partitionBy(*D, "path", "host_port")) > 1), F.concat(F.lit("key:"), "host_port")).otherwise(F.col("trace"))
    return q.withColumn("question", one).groupBy(*D, "question").agg(F.sum("events").alias("events"), F.sum("time_us").alias("time_us"), F.min("first_today").alias("first_today"), F.count("*").alias("traces"))


def order_questions(folded: DataFrame) -> DataFrame:
    return folded.withColumn("place", F.row_number().over(W.partitionBy(*D).orderBy(F.desc("time_us"), F.desc("events"), "question")))


def review_budget(folded: DataFrame, totals: DataFrame) -> DataFrame:
    """(D): questions, the time under question and the day's active time."""
    q = folded.groupBy(*D).agg(F.count("*").alias("questions"), F.sum("time_us").alias("question_us"))
    return totals.select(*D, "active_us").join(q, list(D), "left").select(*D, F.coalesce("questions", F.lit(0).cast("long")).alias("questions"), F.coalesce("question_us", F.lit(0).cast("long")).alias("question_us"), "active_us")


def open_events(b: DataFrame) -> DataFrame:
    return trace_columns(b.where("not covered and (path <> '' or key <> '')"))


def question_titles(b: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest titles of each trace and day."""
    t = open_events(b).where("title <> ''").groupBy(*D, "trace", "title").agg(F.count("*").alias("n"))
    return top(t, k, (*D, "trace"), F.desc("n"), F.asc("title"))


def question_touches(b: DataFrame) -> DataFrame:
    return open_events(b).groupBy(*D, "trace").agg(F.count_if("touch").alias("touches"), F.count("*").alias("events"))


def block_names(b: DataFrame) -> DataFrame:
    """(B, project, origin, before, after): what a block is called, if all its events are called the same, where that comes from, and the nearest named blocks on either side."""
    one = F.min("project") == F.max("project")
    n = b.groupBy(*B).agg(F.when(one, F.min("project")).otherwise("").alias("project"), F.first("origin").alias("origin"))
    w = W.partitionBy(*D).orderBy("block_id")
    mark = F.when(F.col("project") != "", F.col("project"))
    side = lambda f, *frame: F.coalesce(f(mark, ignorenulls=True).over(w.rowsBetween(*frame)), F.lit(""))
    return n.select(*B, "project", "origin", side(F.last, W.unboundedPreceding, -1).alias("before"), side(F.first, 1, W.unboundedFollowing).alias("after"))


def question_places(b: DataFrame) -> DataFrame:
    """(D, trace, block_id, events, project, origin, before, after): blocks in which a trace occurs, with what they are called and the nearest named blocks on either side."""
    e = open_events(b).groupBy(*D, "trace", "block_id").agg(F.count("*").alias("events"))
    return e.join(block_names(b), list(B)).select(*D, "trace", "block_id", "events", "project", "origin", "before", "after")


def dictionary(rules: DataFrame) -> DataFrame:
    """(actor_id, project, nth): the projects that rules name, in the order written; actor_id null for everybody."""
    return rules.where("project <> ''").groupBy("actor_id", "project").agg(F.min("rule_id").alias("nth"))


def project_candidates(places: DataFrame, rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(D, trace, project, reason, is_default, place): what could name a trace, strongest evidence first, each name once.

    block: a block it is in has the name by itself; both: the neighbours of the
    last block that has the same name on both sides; one side: a neighbour with
    nothing on the other side; disagree: neighbours that do; today: the day's
    projects (rows), busiest first; dictionary: all others that are known.
    A name is a default only where the evidence agrees: of a block, as long as no
    neighbours agreed before it, of both sides, and of one side if there is
    nothing above it.
    """
    agrees = (F.col("before") == F.col("after")) & (F.col("before") != "")
    lone = (F.col("before") == "") != (F.col("after") == "")
    p = places.withColumn("agreed", F.max(agrees).over(W.partitionBy(*D, "trace").orderBy("block_id").rowsBetween(W.unboundedPreceding, 0)))
    row = lambda df, project, reason, rung, nth, default: df.select(*D, "trace", project.alias("project"), F.lit(reason).alias("reason"), F.lit(rung).alias("rung"), nth.cast("long").alias("nth"), default.alias("is_default"))
    zero, no = F.lit(0), F.lit(False)
    own = (F.col("project") != "") & (F.col("origin") == "own")
    traces = p.groupBy(*D, "trace").agg(F.max_by("before", F.when(agrees, F.col("block_id"))).alias("both"), F.max_by(F.concat("before", "after"), F.when(lone, F.col("block_id"))).alias("one"), F.max(own).alias("_own"))
    last = traces.select(*D, "trace", F.coalesce("both", F.lit("")).alias("both"), F.coalesce("one", F.lit("")).alias("one"), "_own")
    apart = p.where("before <> after and before <> '' and after <> ''")
    ladder = [
        row(p.where(own), F.col("project"), "block", 1, F.col("block_id"), ~F.col("agreed")),
        row(last, F.col("both"), "both", 2, zero, F.lit(True)),
        row(last, F.col("one"), "one side", 3, zero, ~F.col("_own") & (F.col("both") == "")),
        row(apart, F.col("before"), "disagree", 4, F.col("block_id") * 2, no),
        row(apart, F.col("after"), "disagree", 4, F.col("block_id") * 2 + 1, no),
        row(traces.select(*D, "trace").join(ordered(rows, *order_projects()).select(*D, "project", "place"), list(D)), F.col("project"), "today", 5, F.col("place"), no),
    ]
    if known is not None:
        scope = known.withColumn("_scope", F.coalesce("actor_id", F.lit("*"))).drop("actor_id")
        each = traces.select(*D, "trace", F.explode(F.array("actor_id", F.lit("*"))).alias("_scope")).join(scope, "_scope")
        ladder.append(row(each, F.col("project"), "dictionary", 6, F.col("nth"), no))
    out = ladder[0]
    for more in ladder[1:]:
        out = out.unionByName(more)
    out = out.where("project <> ''").groupBy(*D, "trace", "project").agg(F.min(F.struct("rung", "nth", "reason", "is_default")).alias("r"))
    return out.select(*D, "trace", "project", "r.reason", "r.is_default", F.row_number().over(W.partitionBy(*D, "trace").orderBy("r.rung", "r.nth", "project")).alias("place"))


def encounters(s: DataFrame, least_us: int = MIN_SPLIT_US) -> DataFrame:
    """Stretches of at least least_us that begin at an event with an ambiguous trace, not padding, and with a project."""
    return s.where((F.col("ambiguous") != "") & ~F.col("padding") & (F.col("owner") != "") & (F.col("to_us") - F.col("from_us") >= least_us)).select(*D, "from_us", "to_us", "owner", "ambiguous")


def around_subject(s: DataFrame) -> DataFrame:
    """(D, from_us, around): the subject on both sides of a stretch, if it is the same."""
    w = W.partitionBy(*D).orderBy("from_us", "to_us")
    mark = F.when(F.col("subject") != "", F.col("subject"))
    x = s.withColumns({"_b": F.last(mark, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), "_a": F.last(mark, ignorenulls=True).over(W.partitionBy(*D).orderBy(F.desc("from_us"), F.desc("to_us")).rowsBetween(W.unboundedPreceding, -1))})
    return x.select(*D, "from_us", F.when(F.col("_b") == F.col("_a"), F.col("_b")).otherwise("").alias("around"))


def block_summary(b: DataFrame) -> DataFrame:
    """(B): ground and subject of the block's first event, and the traces in it."""
    t = trace_columns(b)
    return t.groupBy(*B).agg(F.min_by("ground", "nth").alias("ground"), F.min_by("owner_subject", "nth").alias("subject"), F.array_sort(F.collect_set(F.nullif("trace", F.lit("")))).alias("traces"))


def pause_answered(gaps: DataFrame, pauses: DataFrame) -> DataFrame:
    """Pauses with how they were answered: exact (both ends), containing, or none."""
    exact = pauses.groupBy(*D, "from_us", "to_us").agg(F.max_by("project", "answered_at").alias("exact"))
    g = gaps.join(exact, [*D, "from_us", "to_us"], "left")
    p = pauses.select(*D, F.col("from_us").alias("pf"), F.col("to_us").alias("pt"), F.col("project").alias("pp"), "answered_at")
    near = g.join(p, list(D)).where("pf <= from_us and to_us <= pt").groupBy(*D, "from_us", "to_us").agg(F.max_by("pp", "answered_at").alias("near"))
    g = g.join(near, [*D, "from_us", "to_us"], "left")
    return g.select(*D, "from_us", "to_us", F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "containing").otherwise("none").alias("answered"), F.coalesce("exact", "near", F.lit("")).alias("project"))


def answer_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(D, project, before_us, after_us, delta_us): active time that an answer moves."""
    x = before.select(*D, "project", (F.col("attention_us") + F.col("background_us")).alias("before_us"))
    y = after.select(*D, "project", (F.col("attention_us") + F.col("background_us")).alias("after_us"))
    z = F.lit(0).cast("long")
    j = x.join(y, [*D, "project"], "full").select(*D, "project", F.coalesce("before_us", z).alias("before_us"), F.coalesce("after_us", z).alias("after_us"))
    return j.withColumn("delta_us", F.col("after_us") - F.col("before_us")).where("delta_us <> 0")
