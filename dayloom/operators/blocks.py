"""Blocks of activity, and what unnamed traces inherit from their surroundings.

Everything is a window over D = (actor_id, local_day) or over a block of it, so
one exchange by D serves all, into as many tasks as the rows need. Days with more
than HOT_DAY rows go by segments.py instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import stored
from ..sources.traces import ORD, D
from . import segments

B = (*D, "block_id")
ALL = (W.unboundedPreceding, W.unboundedFollowing)


def day() -> WindowSpec:
    return W.partitionBy(*D).orderBy(*ORD)


def block(backwards: bool = False) -> WindowSpec:
    """The rows of a block in order, or from the last: what comes next is then a running frame, which costs a step a row."""
    return W.partitionBy(*B).orderBy(*(F.desc(c) if backwards else F.asc(c) for c in ORD))


#: Rows of an actor-day beyond which it is cut into slices, and rows of the other days for which there is a task; by chance one gets a few days.
HOT_DAY, TASK_ROWS = 10_000, 10_000


def hot_days(entries: DataFrame, most: int = HOT_DAY) -> DataFrame | None:
    """(D) of the actor-days with more than most rows, or None: rows / most of them at the utmost."""
    found = stored(entries.groupBy(*D).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*D))
    return found if found.limit(1).count() else None


def either(rows: DataFrame, hot: DataFrame | None, plain, large) -> DataFrame:
    """plain for the days that aren't hot, large for those that are; both give the same rows and columns."""
    if hot is None:
        return plain(rows)
    rest = plain(rows.join(F.broadcast(hot), list(D), "left_anti").select(rows.columns))
    return rest.unionByName(large(rows.join(F.broadcast(hot), list(D), "left_semi").select(rows.columns)).select(rest.columns))


def spread(rows: DataFrame, task_rows: int | None = None, keys: tuple[str, ...] = D) -> DataFrame:
    """rows by keys over as many tasks as they need. By their size, Spark would put very many into one, as they are short; but they are sorted many times."""
    return rows.repartition(max(2, math.ceil(rows.count() / (task_rows or TASK_ROWS))), *keys)


def blocks(entries: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """entries with nth (1, 2, ... in the day) and block_id: a new block starts where a trace begins more than the gap after everything before it has ended."""
    return either(entries, hot, lambda rows: day_blocks(spread(rows)), lambda rows: segments.numbered(segments.sliced(rows)).drop("_slice"))


def day_blocks(entries: DataFrame) -> DataFrame:
    before = F.max("end_us").over(day().rowsBetween(W.unboundedPreceding, -1))
    new = before.isNull() | (F.col("ts_us") - before > F.col("gap_us"))
    out = entries.withColumns({"before_us": before, "_new": new.cast("int"), "nth": F.row_number().over(day())})
    return out.withColumn("block_id", F.sum("_new").over(day().rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def block_bounds(b: DataFrame) -> DataFrame:
    """(B, from_us, to_us, events): first start, greatest end inside the day."""
    return b.groupBy(*B).agg(F.min("ts_us").alias("from_us"), F.max(F.least("end_us", "day_end_us")).alias("to_us"), F.count("*").alias("events"))


def _nearest(flag: Column, payload: Column) -> Column:
    """payload of the nearest row of the block with flag, its own if it has it; a tie goes to the earlier, null if there is none."""
    mark = F.when(flag, F.struct(F.col("ts_us").alias("at"), payload.alias("x")))
    p = F.last(mark, ignorenulls=True).over(block().rowsBetween(W.unboundedPreceding, -1))
    n = F.last(mark, ignorenulls=True).over(block(backwards=True).rowsBetween(W.unboundedPreceding, -1))
    closer = n.isNull() | (p.isNotNull() & (F.col("ts_us") - p["at"] <= n["at"] - F.col("ts_us")))
    return F.when(flag, payload).when(closer, p["x"]).otherwise(n["x"])


def nearest_anchor(b: DataFrame) -> DataFrame:
    """b with own (named itself), anchor, and project inherited from the nearest anchor of the block; named events keep their own.

    Anchors are named events that own time, if the block has one, else all named events.
    """
    b = b.withColumn("own", F.col("project") != "")
    strong = F.max(F.col("own") & F.col("owns")).over(block().rowsBetween(*ALL))
    b = b.withColumn("anchor", F.when(strong, F.col("own") & F.col("owns")).otherwise(F.col("own")))
    got = _nearest(F.col("anchor"), F.col("project"))
    ends = block().rowsBetween(*ALL)
    mark = F.when(F.col("anchor"), F.col("project"))
    return b.withColumns(
        {"_got": F.when(F.col("own"), F.col("project")).otherwise(F.coalesce(got, F.lit(""))), "first_named": F.first(mark, ignorenulls=True).over(ends), "last_named": F.last(mark, ignorenulls=True).over(ends)}
    ).withColumn("project", F.col("_got")).drop("_got")


def neighbour_blocks(b: DataFrame) -> DataFrame:
    """b with origin of the block (own, neighbours, one-neighbour, none) and candidates; an unnamed block takes the name that its nearest named blocks agree on."""
    w = W.partitionBy(*D).orderBy("block_id")
    before = F.last("last_named", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, -1))
    after = F.last("first_named", ignorenulls=True).over(W.partitionBy(*D).orderBy(F.desc("block_id")).rangeBetween(W.unboundedPreceding, -1))
    return from_neighbours(b.withColumns({"_b": before, "_a": after}))


def from_neighbours(b: DataFrame) -> DataFrame:
    """b with origin, candidates and project, from first_named and last_named of its block and _b and _a, the names nearest before and after it."""
    x, y = F.col("_b"), F.col("_a")
    origin = F.when(F.col("first_named").isNotNull(), "own").when(x == y, "neighbours").when(x.isNull() != y.isNull(), "one-neighbour").otherwise("none")
    b = b.withColumn("origin", origin)
    candidates = F.when((F.col("origin") == "none") & x.isNotNull(), F.array_sort(F.array_distinct(F.array(x, y)))).otherwise(F.expr("cast(array() as array<string>)"))
    taken = F.when(F.col("origin").isin("neighbours", "one-neighbour"), F.coalesce(x, y)).otherwise(F.col("project"))
    return b.withColumns({"candidates": candidates, "project": taken}).drop("_b", "_a", "first_named", "last_named")


def nearest_touch(b: DataFrame) -> DataFrame:
    """b with owner, owner_subject, owner_session and ground of the time that begins at each event: those of the nearest event of the block that owns time."""
    return from_owner(b, _nearest(F.col("owns"), owner()))


def owner() -> Column:
    """What an event that owns time hands on."""
    return F.struct("project", "subject", F.col("session_id").alias("session"), "own", "by_rule")


def from_owner(b: DataFrame, got: Column) -> DataFrame:
    own = F.struct("project", "subject", F.lit("").alias("session"), "own", "by_rule")
    b = b.withColumn("_o", F.coalesce(got, own))
    return b.withColumns({"owner": F.col("_o.project"), "owner_subject": F.col("_o.subject"), "owner_session": F.coalesce("_o.session", F.lit("")), "ground": ground(F.col("_o.project"), F.col("_o.own"), F.col("_o.by_rule"))}).drop("_o")


def ground(owner: Column, own: Column, by_rule: Column) -> Column:
    """Why a stretch has its name."""
    return F.when(owner == "", "none").when(own & by_rule, "rule").when(own, "fallback").when(F.col("origin").isin("neighbours", "one-neighbour"), F.col("origin")).otherwise("inherited")


def attributed(named: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """named entries, best stored, with blocks, inherited names and owners. hot: days to be cut into slices, as hot_days finds them."""
    return either(named, hot, lambda rows: nearest_touch(neighbour_blocks(nearest_anchor(day_blocks(spread(rows))))), segments.attributed)


def block_projects(b: DataFrame) -> DataFrame:
    """(B, project, events, own_events)."""
    return b.groupBy(*B, "project").agg(F.count("*").alias("events"), F.count_if("own").alias("own_events"))


def candidates(b: DataFrame) -> DataFrame:
    """(D, candidates): distinct sorted candidates of the day's unnamed blocks."""
    return b.where("project = ''").groupBy(*D).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("candidates")))).alias("candidates"))
