"""Totals by project, subject, day and range, with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.traces import D


#: The columns that project_rows gives with agent time and claims.
PROJECT_ROWS = "actor_id string, local_day date, project string, events bigint, attention_us bigint, background_us bigint, agent_us bigint, claimed_us bigint, wall_us bigint"


def zero() -> Column:
    return F.lit(0).cast("long")


def evidence(b: DataFrame) -> DataFrame:
    """(D, project): events, and the wall time from the first to the end of the last."""
    return b.groupBy(*D, "project").agg(F.count("*").alias("events"), (F.max(F.least("end_us", "day_end_us")) - F.min("ts_us")).alias("wall_us"))


def wall(b: DataFrame) -> DataFrame:
    return evidence(b).select(*D, "project", "wall_us")


def project_time(s: DataFrame) -> DataFrame:
    return s.groupBy(*D, F.col("owner").alias("project")).agg(F.sum("attention_us").alias("attention_us"), F.sum("background_us").alias("background_us"))


def tagged(df: DataFrame, keys: list[str], sums: tuple[str, ...], **values: Column) -> DataFrame:
    """keys and the named sums of each row of df, 0 where values has none."""
    return df.select(*keys, *(values.get(c, zero()).cast("long").alias(c) for c in sums))


def project_rows(b: DataFrame, s: DataFrame, agent: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """(D, project) for every project with an event, time or a claim: rows of all sources are tagged and summed up in one grouping."""
    sums, keys = ("events", "attention_us", "background_us", "agent_us", "claimed_us"), [*D, "project"]
    named = lambda df: df.withColumn("project", F.col("owner"))
    none = F.lit(None).cast("long")
    with_wall = lambda df, a=none, z=none, row=True: df.withColumns({"_a": a, "_z": z, "_row": F.lit(row)})
    rows = [
        (with_wall(b, F.col("ts_us"), F.least("end_us", "day_end_us")), {"events": F.lit(1)}),
        (with_wall(named(s)), {c: F.col(c) for c in sums[1:3]}),
    ]
    if agent is not None:
        rows.append((with_wall(agent, row=False), {"agent_us": F.col("agent_us")}))
    if claims is not None:
        rows.append((with_wall(claims), {"claimed_us": F.col("held_us")}))
    out = None
    for df, values in rows:
        part = tagged(df, [*keys, "_a", "_z", "_row"], sums, **values)
        out = part if out is None else out.unionByName(part)
    wall_us = F.coalesce(F.max("_z") - F.min("_a"), zero()).alias("wall_us")
    return out.groupBy(*keys).agg(F.max("_row").alias("_row"), *(F.sum(c).alias(c) for c in sums), wall_us).where("_row").drop("_row")


def union_projects(b: DataFrame, s: DataFrame, claims: DataFrame) -> DataFrame:
    """Distinct (D, project) of events, time and claims."""
    return b.select(*D, "project").unionByName(s.select(*D, F.col("owner").alias("project"))).unionByName(claims.select(*D, "project")).distinct()


def subject_rows(b: DataFrame, s: DataFrame) -> DataFrame:
    """(D, project, subject): events that name it themselves, and the time of stretches filed under it."""
    e = b.where("subject <> ''").groupBy(*D, "project", "subject").agg(F.count("*").alias("events"))
    t = s.where("subject <> ''").groupBy(*D, F.col("owner").alias("project"), "subject").agg(F.sum("attention_us").alias("attention_us"), F.sum("background_us").alias("background_us"))
    both = e.select("*", zero().alias("attention_us"), zero().alias("background_us")).unionByName(t.withColumn("events", zero()))
    return both.groupBy(*D, "project", "subject").agg(*(F.sum(c).alias(c) for c in ("events", "attention_us", "background_us")))


def source_counts(b: DataFrame, *keys: str) -> DataFrame:
    return b.groupBy(*keys, "source").agg(F.count("*").alias("events"))


def browser_keys(b: DataFrame, *keys: str) -> DataFrame:
    return b.where("key <> ''").groupBy(*keys, "key").agg(F.count("*").alias("visits"))


def spans(h: DataFrame) -> DataFrame:
    """(D, span_us): from the first block's start to the last block's end, with head and tail."""
    return h.groupBy(*D).agg((F.max_by("to_us", "block_id") - F.min("from_us")).alias("span_us"), F.min("ts_us").alias("first_us"), F.max(F.least("end_us", "day_end_us")).alias("last_us"), F.count("*").alias("events"), F.count_distinct("block_id").alias("blocks"))


def day_totals(h: DataFrame, s: DataFrame, agent: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """(D): attention, background, active, padding, one-neighbour time, span, first and last trace, agent and claimed time."""
    span = F.col("to_us") - F.col("from_us")
    names = ("attention_us", "background_us", "padding_us", "one_neighbour_us")
    values = {c: F.col(c) for c in names[:2]} | {"padding_us": F.when(F.col("padding"), span).otherwise(0), "one_neighbour_us": F.when(F.col("origin") == "one-neighbour", span).otherwise(0)}
    more = [(df, c, name) for df, c, name in ((agent, "agent_us", "agent_us"), (claims, "held_us", "claimed_us")) if df is not None]
    names = (*names, *(name for _, _, name in more))
    t = tagged(s, list(D), names, **values)
    for df, c, name in more:
        t = t.unionByName(tagged(df, list(D), names, **{name: F.col(c)}))
    t = t.groupBy(*D).agg(*(F.sum(c).alias(c) for c in names))
    out = spans(h).join(t, list(D), "left").withColumns({c: F.coalesce(c, zero()) for c in names})
    return out.withColumn("active_us", F.col("attention_us") + F.col("background_us"))


def coverage(totals: DataFrame) -> DataFrame:
    """Share of the span that is active, in thousandths (null without a span)."""
    return totals.select(*D, F.when(F.col("span_us") > 0, F.floor(F.col("active_us") * 1000 / F.col("span_us"))).alias("permille"))


def counted_time(rows: DataFrame, background: bool = False) -> Column:
    return F.col("attention_us") + (F.col("background_us") if background else 0)


TOTALS = ("events", "attention_us", "background_us", "agent_us", "claimed_us", "wall_us")


def range_totals(rows: DataFrame, b: DataFrame | None = None, keys: int = 10) -> DataFrame:
    """Projects of each actor summed over days; project null is the actor's total, by one rollup.

    With b, each row has its evidence merged over the days: sources with their
    events, the first keys browser keys by visits, how many visits the others
    have (other_visits), and the names that could have been a block's.
    """
    sums = [F.sum(c).alias(c) for c in TOTALS if c in rows.columns]
    out = rows.rollup("actor_id", "project").agg(*sums, F.count_distinct("local_day").alias("days")).where("actor_id is not null")
    if b is None:
        return out
    # counts by day merge by adding up; each is made once for the project and once for the total
    both = b.select("actor_id", F.explode(F.array(F.col("project"), F.lit(None).cast("string"))).alias("project"), "source", "key", "candidates")
    of = ["actor_id", "project"]
    sources = both.groupBy(*of, "source").agg(F.count("*").alias("events")).groupBy(*of).agg(F.array_sort(F.collect_list(F.struct((-F.col("events")).alias("o"), "source", "events"))).alias("s"))
    sources = sources.select(*of, F.transform("s", lambda x: F.struct(x["source"].alias("source"), x["events"].alias("events"))).alias("sources"))
    visits = both.where("key <> ''").groupBy(*of, "key").agg(F.count("*").alias("visits"))
    first = top(visits, keys, ("actor_id", "project"), F.desc("visits"), F.asc("key"))
    first = first.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("place", "key", "visits"))).alias("k"), F.sum("visits").alias("_n"))
    total = visits.groupBy(*of).agg(F.sum("visits").alias("_all"))
    names = both.select(*of, F.explode("candidates").alias("c")).distinct().groupBy(*of).agg(F.array_sort(F.collect_list("c")).alias("candidates"))
    for part in (sources, first.select(*of, F.transform("k", lambda x: F.struct(x["key"].alias("key"), x["visits"].alias("visits"))).alias("keys"), "_n"), total, names):
        part = part.withColumnsRenamed({"actor_id": "_a", "project": "_p"})
        out = out.join(part, F.col("actor_id").eqNullSafe(F.col("_a")) & F.col("project").eqNullSafe(F.col("_p")), "left").drop("_a", "_p")
    return out.withColumn("other_visits", F.coalesce(F.col("_all") - F.col("_n"), zero())).drop("_all", "_n")


def subject_report(rows: DataFrame, name: str) -> DataFrame:
    """One subject by any case: by project, by day and in all (grouping sets)."""
    r = rows.where(F.lower("subject") == name.lower())
    sums = [F.sum(c).alias(c) for c in ("events", "attention_us", "background_us")]
    return r.groupingSets([["actor_id", "project"], ["actor_id", "local_day"], ["actor_id"]], "actor_id", "project", "local_day").agg(*sums, F.min("local_day").alias("first_day"), F.max("local_day").alias("last_day"))


def subject_list(rows: DataFrame) -> DataFrame:
    return rows.groupBy("actor_id", "subject").agg(*(F.sum(c).alias(c) for c in ("events", "attention_us", "background_us")), F.count_distinct("local_day").alias("days"))


def unmatched(b: DataFrame, s: DataFrame) -> DataFrame:
    """(D, path, key) that no rule covers: events, the time of stretches they open, and the name they have now."""
    open_ = "not covered and (path <> '' or key <> '')"
    e = b.where(open_).groupBy(*D, "path", "key").agg(F.count("*").alias("events"), F.min_by("project", "nth").alias("project"))
    t = s.where(open_).groupBy(*D, "path", "key").agg(F.sum(F.col("to_us") - F.col("from_us")).alias("time_us"))
    return e.join(t, [*D, "path", "key"], "left").withColumn("time_us", F.coalesce("time_us", zero()))


def unmatched_range(u: DataFrame) -> DataFrame:
    """Days merged; the latest name that isn't empty wins."""
    named = F.when(F.col("project") != "", F.struct("local_day", "project"))
    return u.groupBy("actor_id", "path", "key").agg(F.sum("events").alias("events"), F.sum("time_us").alias("time_us"), F.coalesce(F.max(named)["project"], F.lit("")).alias("project"))


def except_covered(b: DataFrame) -> DataFrame:
    return b.where("not covered and (path <> '' or key <> '')").select("actor_id", "path", "key").distinct()


def fold_small(rows: DataFrame, least_us: int) -> DataFrame:
    """Rows below least_us on every count become one row '(other)' a day, the sums kept."""
    small = (F.greatest("attention_us", "background_us", "agent_us", "claimed_us") < least_us) & (F.col("project") != "")
    return rows.groupBy(*D, F.when(small, "(other)").otherwise(F.col("project")).alias("project")).agg(*(F.sum(c).alias(c) for c in ("events", "attention_us", "background_us", "agent_us", "claimed_us")), F.count("*").alias("folded"))


def ran_without_you(agent: DataFrame, s: DataFrame) -> DataFrame:
    """(D, project, agent_us): projects with agent time and none of their own."""
    mine = project_time(s).where("attention_us + background_us > 0").select(*D, "project")
    return agent.groupBy(*D, "project").agg(F.sum("agent_us").alias("agent_us")).join(mine, [*D, "project"], "left_anti")


def ordered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place (1, 2, ...) within the day in that total order."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*D).orderBy(*order)))


def order_projects() -> list[Column]:
    return [F.col("project") == "", F.desc("attention_us"), F.desc("background_us"), F.desc("events"), F.asc("project")]


def order_subjects() -> list[Column]:
    return [F.desc("attention_us"), F.desc("background_us"), F.desc("events"), F.asc("subject"), F.asc("project")]


def order_unmatched() -> list[Column]:
    return [F.desc("time_us"), F.desc("events"), F.asc("path"), F.asc("key")]


def top(rows: DataFrame, k: int, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The first k rows of each group by order, each with rest, the number of rows left out."""
    w = W.partitionBy(*keys)
    return rows.withColumns({"place": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)}).where(F.col("place") <= k).withColumn("rest", F.greatest(F.lit(0), F.col("_n") - k)).drop("_n")


def claimed_pauses(pauses: DataFrame, r: DataFrame, days: DataFrame) -> DataFrame:
    """(D, from_us, to_us, project, subject, held_us): worked answers of the day; where they overlap the earlier keeps, and time in runs is taken off.

    days: D with day_start_us and day_end_us.
    """
    p = pauses.where("worked").join(days.select(*D, "day_start_us", "day_end_us").distinct(), list(D)).where("from_us >= day_start_us and from_us < day_end_us and to_us > from_us")
    taken = F.max("to_us").over(W.partitionBy(*D).orderBy("from_us", "answered_at").rowsBetween(W.unboundedPreceding, -1))
    p = p.withColumn("from_us", F.greatest("from_us", F.coalesce(taken, F.col("from_us")))).where("to_us > from_us").select(*D, "from_us", "to_us", "project", "subject")
    inside = r.where("not gap").select(*D, F.col("from_us").alias("rf"), F.col("to_us").alias("rt"))
    over = F.greatest(zero(), F.least("to_us", "rt") - F.greatest("from_us", "rf"))
    held = p.join(inside, list(D), "left").groupBy(*D, "from_us", "to_us", "project", "subject").agg(F.sum(over).alias("over"))
    return held.withColumn("held_us", F.col("to_us") - F.col("from_us") - F.coalesce("over", zero())).where("held_us > 0").drop("over")


def mark_claimed_runs(r: DataFrame, pauses: DataFrame) -> DataFrame:
    """Gap runs whose both ends are those of a worked answer are claimed and take its project."""
    p = pauses.where("worked").groupBy(*D, "from_us", "to_us").agg(F.max_by("project", "answered_at").alias("_p"))
    out = r.join(p, [*D, "from_us", "to_us"], "left")
    hit = F.col("gap") & F.col("_p").isNotNull()
    return out.withColumns({"claimed": hit, "project": F.when(hit, F.col("_p")).otherwise(F.col("project"))}).drop("_p")


def run_evidence(r: DataFrame, b: DataFrame) -> DataFrame:
    """(D, from_us, to_us, events, sources, visits) of runs that aren't gaps: events inside, the end included for a run that a gap or the day's end follows."""
    o = W.partitionBy(*D).orderBy("from_us", "to_us")
    x = r.withColumn("shut", F.coalesce(F.lead("gap").over(o), F.lit(True))).where("not gap").select(*D, "from_us", "to_us", "shut")
    # runs don't overlap, so an event can only be in the last one that began
    begins = x.select(*D, F.col("from_us").alias("at"), F.lit(0).alias("is_event"), F.struct("from_us", "to_us", "shut").alias("run"), F.lit("").alias("source"), F.lit("").alias("key"))
    events = b.select(*D, F.col("ts_us").alias("at"), F.lit(1).alias("is_event"), F.lit(None).cast(begins.schema["run"].dataType).alias("run"), "source", "key")
    w = W.partitionBy(*D).orderBy("at", "is_event", "run.to_us").rowsBetween(W.unboundedPreceding, 0)
    both = begins.unionByName(events).withColumn("run", F.last("run", ignorenulls=True).over(w)).where("is_event = 1 and (at < run.to_us or run.shut and at <= run.to_us)")
    got = both.groupBy(*D, F.col("run.from_us").alias("from_us"), F.col("run.to_us").alias("to_us")).agg(F.count("*").alias("events"), F.count_distinct("source").alias("sources"), F.count_if(F.col("key") != "").alias("visits"))
    return x.join(got, [*D, "from_us", "to_us"], "left").select(*D, "from_us", "to_us", *(F.coalesce(c, zero()).alias(c) for c in ("events", "sources", "visits")))


def pauses_between(r: DataFrame) -> DataFrame:
    """Gap runs with the nearest named project on either side."""
    o = W.partitionBy(*D).orderBy("from_us", "to_us")
    name = F.when(~F.col("gap") & (F.col("project") != ""), F.col("project"))
    out = r.withColumns({"left_project": F.last(name, ignorenulls=True).over(o.rowsBetween(W.unboundedPreceding, -1)), "right_project": F.last(name, ignorenulls=True).over(W.partitionBy(*D).orderBy(F.desc("from_us"), F.desc("to_us")).rowsBetween(W.unboundedPreceding, -1))})
    return out.where("gap").select(*D, "from_us", "to_us", F.coalesce("left_project", F.lit("")).alias("left_project"), F.coalesce("right_project", F.lit("")).alias("right_project"))


def long_background(p: DataFrame, least_us: int = 900_000_000) -> DataFrame:
    return p.where((F.col("kind") == "background") & (F.col("to_us") - F.col("from_us") > least_us)).select(*D, "from_us", "to_us", "owner")


def clusters(h: DataFrame) -> DataFrame:
    """(D, block_id, from_us, to_us, project, origin, events) of blocks with head and tail; the project if all events of the block have the same."""
    one = F.min("project") == F.max("project")
    return h.groupBy(*D, "block_id").agg(F.first("from_us").alias("from_us"), F.first("to_us").alias("to_us"), F.when(one, F.min("project")).otherwise("").alias("project"), F.first("origin").alias("origin"), F.count("*").alias("events"))


def day_document(totals: DataFrame, rows: DataFrame, r: DataFrame, h: DataFrame | None = None) -> DataFrame:
    """(D, document): the day as nested JSON, with its projects and runs in order; with h, also its blocks and the settings it was worked out with."""
    p = ordered(rows, *order_projects()).groupBy(*D).agg(F.array_sort(F.collect_list(F.struct("place", "project", "events", "attention_us", "background_us", "wall_us"))).alias("projects"))
    t = r.groupBy(*D).agg(F.array_sort(F.collect_list(F.struct("from_us", "to_us", "project", "attention_us", "background_us", "gap"))).alias("runs"))
    out, more = totals.join(p, list(D), "left").join(t, list(D), "left"), []
    if h is not None:
        c = clusters(h).groupBy(*D).agg(F.array_sort(F.collect_list(F.struct("block_id", "from_us", "to_us", "project", "origin", "events"))).alias("clusters"))
        settings = h.groupBy(*D).agg(F.first(F.struct("tz", "gap_us", "window_us", "head_us", "tail_us", "fallback")).alias("settings"))
        out, more = out.join(c, list(D), "left").join(settings, list(D), "left"), ["clusters", "settings"]
    head = F.struct("attention_us", "background_us", "active_us", "span_us", "padding_us", "first_us", "last_us")
    return out.select(*D, F.to_json(F.struct(F.col("local_day").cast("string").alias("day"), head.alias("totals"), "projects", "runs", *more)).alias("document"))
