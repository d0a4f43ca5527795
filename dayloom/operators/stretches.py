"""A day cut into stretches, each with an owner, and into attention and background.

One sweep does it. Every block-numbered row emits its edges with inline: where it
starts and ends, the ends of its block with head and tail, answer edges, and the
edges of its attention window. Grouped by instant, running sums tell what is
open; the last opener owns what follows. Days that are cut into slices are swept in
two levels, as in segments.py: what a slice hands on is a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import FILE_ROWS, stored
from ..sources.traces import ORD, D
from .blocks import ALL, B, block, either, spread
from .segments import BEFORE, SLICE, SLICE_ROWS, along, met, slices_of

PAY = ("block_id", "nth", "human", "owner", "owner_subject", "owner_session", "ground", "origin", "covered", "path", "key", "ambiguous", "project")


def head_tail(b: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """b with block_from_us and block_to_us (own bounds) and from_us and to_us (with head and tail).

    A head needs an agent-log prompt that opens the block, a tail a touch in it;
    either takes half the pause to the neighbour at most and stays in the day.
    hot: days of which no task may hold all rows, as hot_days finds them.
    """
    return either(b, hot, lambda rows: padded(day_ends(rows if hot is None else spread(rows))), lambda rows: padded(block_ends(rows)))


def day_ends(b: DataFrame) -> DataFrame:
    """b with what head and tail depend on, by windows over the block and the day."""
    every, first = block().rowsBetween(*ALL), block().rowsBetween(*ALL)
    w = W.partitionBy(*D).orderBy("block_id").rangeBetween(1, 1)
    return b.withColumns(
        {
            "block_from_us": F.min("ts_us").over(every),
            "block_to_us": F.max(F.least("end_us", "day_end_us")).over(every),
            "_prev": F.first("before_us").over(first),
            "_next": F.min("ts_us").over(w),
            "_prompt": F.first(F.col("touch") & (F.col("source") == "agent-log")).over(first),
            "_touched": F.max("touch").over(every),
            "_last": F.last("nth").over(every),
            "_first": F.first("nth").over(first),
        }
    )


def block_ends(b: DataFrame) -> DataFrame:
    """As day_ends, by a row a block, which the rows of the block meet."""
    ends = b.groupBy(*B).agg(
        F.min("ts_us").alias("block_from_us"), F.max(F.least("end_us", "day_end_us")).alias("block_to_us"), F.min_by("before_us", "nth").alias("_prev"), F.min_by(F.col("touch") & (F.col("source") == "agent-log"), "nth").alias("_prompt"),
        F.max("touch").alias("_touched"), F.max("nth").alias("_last"), F.min("nth").alias("_first"),
    )
    return b.join(stored(ends.withColumn("_next", F.min("block_from_us").over(W.partitionBy(*D).orderBy("block_id").rangeBetween(1, 1)))), list(B))


def padded(b: DataFrame) -> DataFrame:
    head = F.when(F.col("_prompt"), F.least("head_us", F.coalesce(F.expr("(block_from_us - _prev) div 2"), F.col("head_us")))).otherwise(0)
    tail = F.when(F.col("_touched"), F.least("tail_us", F.coalesce(F.expr("(_next - block_to_us) div 2"), F.col("tail_us")))).otherwise(0)
    return b.withColumns({"from_us": F.greatest(F.col("block_from_us") - head, "day_start_us"), "to_us": F.least(F.col("block_to_us") + tail, F.greatest("day_end_us", "block_to_us"))}).drop("_prev", "_next", "_prompt", "_touched")


def edges(h: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(D, instant, pay, cut, in_block, in_window) of each edge."""
    if answers is not None:
        a = answers.groupBy(*D).agg(F.array_sort(F.collect_list(F.struct("made_at", "from_us", "to_us", "project", "subject", "clear_subject", "one_off"))).alias("answers"))
        h = h.join(a, list(D), "left")
    else:
        h = h.withColumn("answers", F.expr("cast(null as array<struct<made_at:int,from_us:bigint,to_us:bigint,project:string,subject:string,clear_subject:boolean,one_off:boolean>>)"))
    pay = lambda human: F.struct(*(F.col(c) if c != "human" else F.lit(human).alias("human") for c in PAY))
    c = F.col
    # edges carry which payload they open with: 0 the event's, 1 the event's for a head or tail, 2 none
    edge = lambda at, which, cut, block, window: F.struct(at.alias("instant"), F.lit(which).alias("which"), F.lit(cut).alias("cut"), F.lit(block).alias("in_block"), F.lit(window).alias("in_window"))
    first, last = c("nth") == c("_first"), c("nth") == c("_last")
    inside = (c("end_us") > c("ts_us")) & (c("end_us") < c("block_to_us"))
    long, touch = c("span_us") > 0, c("touch")
    opens = F.when(long, c("ts_us")).when(touch, c("ts_us") - c("window_us"))
    shuts = F.when(long, c("end_us")).when(touch, c("ts_us") + c("window_us"))
    made = F.array(
        edge(c("ts_us"), 0, True, 0, 0),
        F.when(inside, edge(c("end_us"), 2, True, 0, 0)),
        F.when(first & (c("from_us") < c("block_from_us")), edge(c("from_us"), 1, True, 0, 0)),
        F.when(first, edge(c("from_us"), 2, True, 1, 0)),
        F.when(last & (c("to_us") > c("block_to_us")), edge(c("block_to_us"), 1, True, 0, 0)),
        F.when(last, edge(c("block_to_us"), 2, True, 0, 0)),
        F.when(last, edge(c("to_us"), 2, True, -1, 0)),
        F.when(long | touch, edge(opens, 2, False, 0, 1)),
        F.when(long | touch, edge(shuts, 2, False, 0, -1)),
    )
    h = h.withColumns({"_pay0": pay(False), "_pay1": pay(True), "_made": made})
    if answers is not None:
        cuts = F.filter(F.flatten(F.transform("answers", lambda x: F.array(x["from_us"], x["to_us"]))), lambda x: (x > c("block_from_us")) & (x < c("block_to_us")))
        said = F.when(first & c("answers").isNotNull(), F.transform(cuts, lambda x: edge(x, 2, True, 0, 0)))
        h = h.withColumn("_made", F.when(said.isNotNull(), F.concat("_made", said)).otherwise(c("_made")))
    out = h.select(*D, "answers", "_pay0", "_pay1", F.explode("_made").alias("e")).where("e is not null")
    return out.select(*D, "answers", "e.instant", F.when(c("e.which") == 0, c("_pay0")).when(c("e.which") == 1, c("_pay1")).alias("pay"), "e.cut", "e.in_block", "e.in_window")


def pieces(h: DataFrame, answers: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """(D, stretch, block_id, from_us, to_us, kind, owner, subject, ground, ...): stretches cut where attention begins and ends.

    stretch numbers the stretches of the day; kind is padding, attention or
    background. An answer that holds the middle of a stretch names it; the
    latest one counts. hot: days that are swept in slices.
    """
    plain = lambda rows: merged(day_sweep(edges(rows if hot is None else spread(rows), answers)))
    return either(h, hot, plain, lambda rows: merged(sliced_sweep(edges(rows, answers), slices_of(EDGES * rows.count(), 2 * SLICE_ROWS))))


def instants(e: DataFrame, *more: str) -> DataFrame:
    """The edges of an instant in one row."""
    return e.groupBy(*D, *more, "instant").agg(F.max("pay").alias("pay"), F.max("cut").alias("cut"), F.sum("in_block").alias("in_block"), F.sum("in_window").alias("in_window"), F.first("answers").alias("answers"))


def day_sweep(e: DataFrame) -> DataFrame:
    """A row from each instant inside a block to the next, with pay, depth and stretch; windows over the day."""
    at = instants(e)
    w = W.partitionBy(*D).orderBy("instant")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    return at.withColumns(
        {
            "to_us": F.lead("instant").over(w),
            "open": F.sum("in_block").over(run),
            "depth": F.sum("in_window").over(run),
            "pay": F.last("pay", ignorenulls=True).over(run),
            "stretch": F.sum(F.col("cut").cast("int")).over(run),
        }
    ).where("open > 0 and to_us > instant")


#: About as many edges as an event has.
EDGES = 3


def sliced_sweep(e: DataFrame, tasks: int) -> DataFrame:
    """As day_sweep, over slices of the instants of a day; an instant is in one slice."""
    at = stored(instants(e.repartitionByRange(tasks, *D, "instant").withColumn("_slice", F.spark_partition_id()), "_slice"), FILE_ROWS)
    total = lambda c: F.coalesce(F.sum(c).over(along(D).rowsBetween(*BEFORE)), F.lit(0))
    handed = at.groupBy(*SLICE).agg(
        F.min("instant").alias("_at"), F.sum("in_block").alias("_o"), F.sum("in_window").alias("_d"), F.sum(F.col("cut").cast("int")).alias("_c"), F.max_by("pay", F.when(F.col("pay").isNotNull(), F.col("instant"))).alias("_p"),
    )
    handed = handed.select(*SLICE, F.lead("_at").over(along(D)).alias("_next"), total("_o").alias("_open"), total("_d").alias("_depth"), total("_c").alias("_cuts"), F.last("_p", ignorenulls=True).over(along(D).rowsBetween(*BEFORE)).alias("_pay"))
    w = W.partitionBy(*SLICE).orderBy("instant")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    out = met(at, stored(handed), SLICE, tasks).withColumns(
        {
            "to_us": F.coalesce(F.lead("instant").over(w), "_next"),
            "open": F.col("_open") + F.sum("in_block").over(run),
            "depth": F.col("_depth") + F.sum("in_window").over(run),
            "pay": F.coalesce(F.last("pay", ignorenulls=True).over(run), "_pay"),
            "stretch": F.col("_cuts") + F.sum(F.col("cut").cast("int")).over(run),
        }
    ).where("open > 0 and to_us > instant")
    return out.drop("_slice", "_next", "_open", "_depth", "_cuts", "_pay").repartition(tasks, *D, "stretch")


def merged(at: DataFrame) -> DataFrame:
    """The pieces of swept instants."""
    # the ends of a stretch decide on answers, so find them before pieces merge
    whole = W.partitionBy(*D, "stretch")
    at = at.withColumns({"_from": F.min("instant").over(whole), "_to": F.max("to_us").over(whole)})
    middle = F.expr("_from + (_to - _from) div 2")
    said = F.filter("answers", lambda x: (x["from_us"] <= middle) & (middle < x["to_us"]))
    at = at.withColumn("said", F.try_element_at(said, F.lit(-1))).drop("answers")
    kind = F.when(F.col("pay.human"), "padding").when(F.col("depth") > 0, "attention").otherwise("background")
    s = F.col("said")
    named, subject = F.coalesce(s["project"], F.lit("")) != "", (F.coalesce(s["subject"], F.lit("")) != "") | F.coalesce(s["clear_subject"], F.lit(False))
    at = at.withColumns(
        {
            "kind": kind,
            "owner": F.when(named, s["project"]).otherwise(F.col("pay.owner")),
            "subject": F.when(subject, s["subject"]).when(named, "").otherwise(F.col("pay.owner_subject")),
            "ground": F.when(s.isNull(), F.col("pay.ground")).when(s["one_off"], "one-off").otherwise("manual"),
        }
    )
    change = (F.lag("kind").over(W.partitionBy(*D, "stretch").orderBy("instant")) != F.col("kind")) | F.lag("kind").over(W.partitionBy(*D, "stretch").orderBy("instant")).isNull()
    at = at.withColumn("_part", F.sum(change.cast("int")).over(W.partitionBy(*D, "stretch").orderBy("instant").rowsBetween(W.unboundedPreceding, 0)))
    rest = ["owner", "subject", "ground", "kind"]
    out = at.groupBy(*D, "stretch", "_part").agg(F.min("instant").alias("from_us"), F.max("to_us").alias("to_us"), F.first("pay").alias("pay"), *(F.first(c).alias(c) for c in rest))
    return out.select(*D, "stretch", F.col("pay.block_id").alias("block_id"), F.col("pay.nth").alias("opener"), "from_us", "to_us", *rest, *(F.col(f"pay.{c}").alias(c) for c in ("owner_session", "origin", "covered", "path", "key", "ambiguous")), F.col("pay.project").alias("opener_project"))


def stretches(p: DataFrame) -> DataFrame:
    """Whole stretches: pieces put together, with attention_us (padding included) and background_us."""
    span = F.col("to_us") - F.col("from_us")
    first = lambda c: F.first(c).alias(c)
    return p.groupBy(*D, "stretch").agg(
        F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us"), F.sum(F.when(F.col("kind") != "background", span).otherwise(0)).alias("attention_us"), F.sum(F.when(F.col("kind") == "background", span).otherwise(0)).alias("background_us"),
        F.max(F.col("kind") == "padding").alias("padding"), *(first(c) for c in ("block_id", "opener", "owner", "subject", "ground", "owner_session", "origin", "covered", "path", "key", "ambiguous", "opener_project")),
    )


def attention_windows(entries: DataFrame) -> DataFrame:
    """(D, from_us, to_us): union of the windows around touches and of intervals; windows that touch merge."""
    w = entries.where("touch or span_us > 0").select(*D, F.when(F.col("span_us") > 0, F.col("ts_us")).otherwise(F.col("ts_us") - F.col("window_us")).alias("f"), F.when(F.col("span_us") > 0, F.col("end_us")).otherwise(F.col("ts_us") + F.col("window_us")).alias("t"))
    return islands(w, D)


def islands(spans: DataFrame, keys: tuple[str, ...], gap: int = 0) -> DataFrame:
    """(keys, from_us, to_us): spans (f, t) merged where they touch or overlap."""
    o = W.partitionBy(*keys).orderBy("f", "t")
    before = F.max("t").over(o.rowsBetween(W.unboundedPreceding, -1))
    s = spans.withColumn("_new", (before.isNull() | (F.col("f") > before + gap)).cast("int"))
    s = s.withColumn("_i", F.sum("_new").over(o.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(*keys, "_i").agg(F.min("f").alias("from_us"), F.max("t").alias("to_us")).drop("_i")


def live_sessions(b: DataFrame) -> DataFrame:
    """(D, session_id, project, from_us, to_us): while an agent session worked on a project; its events follow each other within the gap."""
    a = b.where("source = 'agent-log' and project <> ''").withColumn("session_id", F.coalesce("session_id", F.lit("")))
    a = spread(a, keys=(*D, "session_id", "project"))
    nxt = F.lead("ts_us").over(W.partitionBy(*D, "session_id", "project").orderBy(*ORD))
    spans = a.withColumn("t", nxt).where(F.col("t") - F.col("ts_us") <= F.col("gap_us")).withColumnRenamed("ts_us", "f").select(*D, "session_id", "project", "f", "t")
    return islands(spans, (*D, "session_id", "project")).where("to_us > from_us")


BUCKET = 600_000_000


def agent_overlap(s: DataFrame, live: DataFrame) -> DataFrame:
    """(D, stretch, project, agent_us): agent work on other projects, in other sessions, while a stretch lasted. Both sides are cut at bucket edges, so nothing counts twice."""

    def cut(df: DataFrame) -> DataFrame:
        df = df.withColumn("bucket", F.explode(F.sequence(F.expr(f"from_us div {BUCKET}"), F.expr(f"(to_us - 1) div {BUCKET}"))))
        return df.withColumns({"f": F.greatest("from_us", F.col("bucket") * BUCKET), "t": F.least("to_us", (F.col("bucket") + 1) * BUCKET)}).drop("from_us", "to_us")

    x = cut(s.select(*D, "stretch", "owner", "owner_session", "from_us", "to_us"))
    y = cut(live).withColumnsRenamed({"f": "lf", "t": "lt"})
    both = x.join(y, [*D, "bucket"]).where((F.col("project") != F.col("owner")) & (F.col("session_id") != F.col("owner_session")))
    over = F.least("t", "lt") - F.greatest("f", "lf")
    return both.where(over > 0).groupBy(*D, "stretch", "project").agg(F.sum(over).alias("agent_us"))


def runs(p: DataFrame, h: DataFrame) -> DataFrame:
    """(D, from_us, to_us, project, attention_us, background_us, gap): touching stretches of one owner, gap rows between blocks, and a run without length for a block without time."""
    s = stretches(p).select(*D, "from_us", "to_us", F.col("owner").alias("project"), "attention_us", "background_us")
    o = W.partitionBy(*D).orderBy("from_us", "to_us")
    s = s.withColumn("_new", F.coalesce(((F.lag("project").over(o) != F.col("project")) | (F.lag("to_us").over(o) < F.col("from_us"))).cast("int"), F.lit(1)))
    s = s.withColumn("_r", F.sum("_new").over(o.rowsBetween(W.unboundedPreceding, 0)))
    merged = s.groupBy(*D, "_r").agg(F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us"), F.first("project").alias("project"), F.sum("attention_us").alias("attention_us"), F.sum("background_us").alias("background_us"), F.lit(False).alias("gap")).drop("_r")
    b = h.groupBy(*B).agg(F.first("from_us").alias("from_us"), F.first("to_us").alias("to_us"), F.min_by("owner", "nth").alias("project"))
    zero = F.lit(0).cast("long")
    w = W.partitionBy(*D).orderBy("block_id")
    prev = F.lag("to_us").over(w)
    pointless = b.withColumn("_p", prev).where("to_us = from_us and (_p is null or _p < from_us)").select(*D, "from_us", "to_us", "project", zero.alias("attention_us"), zero.alias("background_us"), F.lit(False).alias("gap"))
    gaps = b.withColumn("_p", prev).where("from_us > _p").select(*D, F.col("_p").alias("from_us"), F.col("from_us").alias("to_us"), F.lit("").alias("project"), zero.alias("attention_us"), zero.alias("background_us"), F.lit(True).alias("gap"))
    return merged.unionByName(pointless).unionByName(gaps)
