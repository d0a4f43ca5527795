"""Blocks, names and owners of actor-days that are too large for one task.

A two-level segmented scan. The rows of these days are laid out in their total
order and cut into slices of about SLICE_ROWS rows, wherever a cut falls. Within
a slice everything is a window over the slice; what a slice hands on - its
latest end, how many rows and blocks it has, its first and last anchor and
owner - is one row, and so is each piece, the part of a block in a slice. These
few rows are scanned over the day or the block, and each slice or piece gets
what comes before and after it. There are as many tasks as slices, so each holds
a few of them at most, however many rows a day or a block has.

The result is that of blocks.attributed, row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import FILE_ROWS, stored
from ..sources.traces import ORD, D

SLICE_ROWS = 10_000
SLICE, PIECE, BLOCK = (*D, "_slice"), (*D, "_slice", "block_id"), (*D, "block_id")
BEFORE, AFTER, ALL = (W.unboundedPreceding, -1), (1, W.unboundedFollowing), (W.unboundedPreceding, W.unboundedFollowing)


def within(keys: tuple[str, ...], backwards: bool = False) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*(F.desc(c) if backwards else F.asc(c) for c in ORD))


def along(keys: tuple[str, ...], order: str = "_slice") -> WindowSpec:
    """Over rows that summarise slices, pieces or blocks."""
    return W.partitionBy(*keys).orderBy(order)


def sliced(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with _slice: places in the total order, about slice_rows to each; written, as the borders are estimates that must not move."""
    return stored(rows.repartitionByRange(slices_of(rows.count(), slice_rows), *D, *ORD).withColumn("_slice", F.spark_partition_id()), FILE_ROWS)


def slices_of(rows: int, slice_rows: int = SLICE_ROWS) -> int:
    return max(1, math.ceil(rows / slice_rows))


def met(rows: DataFrame, summary: DataFrame, keys: tuple[str, ...], tasks: int | None = None) -> DataFrame:
    """rows joined with what is known of their slice or piece: a row for each, so no key of the join has more rows than a slice. tasks: over how many they are dealt.

    What is known of slices is a row for SLICE_ROWS rows, so it goes to the rows.
    """
    return (rows.repartition(tasks, *keys) if tasks else rows).join(F.broadcast(summary) if keys == SLICE else summary, list(keys))


def numbered(slices: DataFrame, tasks: int | None = None) -> DataFrame:
    """slices with before_us, nth and block_id, as blocks.blocks gives them. tasks: their number, if not to be counted off their files."""
    tasks = tasks or slices_of(slices.count())
    handed = slices.groupBy(*SLICE).agg(F.max("end_us").alias("_e"), F.count("*").alias("_c"))
    handed = handed.select(*SLICE, F.max("_e").over(along(D).rowsBetween(*BEFORE)).alias("_end"), F.coalesce(F.sum("_c").over(along(D).rowsBetween(*BEFORE)), F.lit(0)).alias("_rows"))
    w = within(SLICE)
    before = F.greatest("_end", F.max("end_us").over(w.rowsBetween(*BEFORE)))  # greatest passes nulls over
    out = met(slices, handed, SLICE, tasks).withColumns({"before_us": before, "nth": (F.col("_rows") + F.row_number().over(w)).cast("int")})
    out = out.withColumn("_new", (F.col("before_us").isNull() | (F.col("ts_us") - F.col("before_us") > F.col("gap_us"))).cast("int"))
    out = stored(out.withColumn("_opened", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_end", "_rows"), FILE_ROWS)
    opened = out.groupBy(*SLICE).agg(F.sum("_new").alias("_n"))
    opened = opened.select(*SLICE, F.coalesce(F.sum("_n").over(along(D).rowsBetween(*BEFORE)), F.lit(0)).alias("_blocks"))
    return met(out, opened, SLICE).withColumn("block_id", F.col("_blocks") + F.col("_opened")).drop("_new", "_opened", "_blocks")


def ends(flag: Column, payload: Column) -> tuple[Column, Column]:
    """The first and the last row of a piece with flag: where it is, and its payload."""
    mark = F.when(flag, F.struct(F.col("ts_us").alias("at"), payload.alias("x")))
    order = F.when(flag, F.struct(*ORD))
    return F.min_by(mark, order), F.max_by(mark, order)


def nearest(flag: Column, payload: Column, before: Column, after: Column) -> Column:
    """payload of the nearest row of the block with flag, its own if it has it; a tie goes to the earlier. before, after: the nearest ones in other pieces of the block."""
    mark = F.when(flag, F.struct(F.col("ts_us").alias("at"), payload.alias("x")))
    p = F.coalesce(F.last(mark, ignorenulls=True).over(within(PIECE).rowsBetween(*BEFORE)), before)
    n = F.coalesce(F.last(mark, ignorenulls=True).over(within(PIECE, backwards=True).rowsBetween(*BEFORE)), after)
    closer = n.isNull() | (p.isNotNull() & (F.col("ts_us") - p["at"] <= n["at"] - F.col("ts_us")))
    return F.when(flag, payload).when(closer, p["x"]).otherwise(n["x"])


def around(first: str, last: str) -> list[Column]:
    """For each piece the last mark of those before it in its block, and the first of those after it."""
    w = along(BLOCK)
    return [F.last(last, ignorenulls=True).over(w.rowsBetween(*BEFORE)).alias("_before"), F.first(first, ignorenulls=True).over(w.rowsBetween(*AFTER)).alias("_after")]


def inherited(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """rows with own, anchor, origin, candidates and the project they inherit, as nearest_anchor and neighbour_blocks give them."""
    from .blocks import from_neighbours  # blocks sends its hot days here

    rows = rows.withColumn("own", F.col("project") != "")
    strong, weak = F.col("own") & F.col("owns"), F.col("own")
    marks = {"strong": ends(strong, F.col("project")), "weak": ends(weak, F.col("project"))}
    pieces = rows.groupBy(*PIECE).agg(F.max(strong).alias("_s"), *(c.alias(f"_{n}{k}") for n, (a, z) in marks.items() for k, c in (("a", a), ("z", z))))
    over = along(BLOCK).rowsBetween(*ALL)
    pieces = pieces.withColumn("_strong", F.max("_s").over(over))
    pick = lambda k: F.when(F.col("_strong"), F.col(f"_strong{k}")).otherwise(F.col(f"_weak{k}"))
    pieces = pieces.select(*PIECE, "_strong", pick("a").alias("_a"), pick("z").alias("_z"))
    pieces = pieces.select(*PIECE, "_strong", *around("_a", "_z"), F.first("_a", ignorenulls=True).over(over)["x"].alias("first_named"), F.last("_z", ignorenulls=True).over(over)["x"].alias("last_named"))
    # from block to block: pieces of one block say the same, so a range frame over blocks steps over all of them
    named_before = F.last("last_named", ignorenulls=True).over(along(D, "block_id").rangeBetween(*BEFORE))
    named_after = F.first("first_named", ignorenulls=True).over(along(D, "block_id").rangeBetween(*AFTER))
    pieces = pieces.withColumns({"_b": named_before, "_n": named_after}).withColumnRenamed("_n", "_a")
    rows = met(rows, pieces, PIECE, tasks)
    rows = rows.withColumn("anchor", F.when(F.col("_strong"), strong).otherwise(weak))
    got = nearest(F.col("anchor"), F.col("project"), F.col("_before"), F.col("_after"))
    rows = rows.withColumn("_got", F.when(F.col("own"), F.col("project")).otherwise(F.coalesce(got, F.lit("")))).withColumn("project", F.col("_got"))
    return from_neighbours(rows).drop("_got", "_strong", "_before", "_after")


def owned(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """rows with owner, owner_subject, owner_session and ground, as nearest_touch gives them."""
    from .blocks import from_owner, owner

    first, last = ends(F.col("owns"), owner())
    pieces = rows.groupBy(*PIECE).agg(first.alias("_a"), last.alias("_z")).select(*PIECE, *around("_a", "_z"))
    rows = met(rows, pieces, PIECE, tasks)
    return from_owner(rows, nearest(F.col("owns"), owner(), F.col("_before"), F.col("_after"))).drop("_before", "_after")


def attributed(named: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """named entries with blocks, inherited names and owners."""
    slices = sliced(named, slice_rows)
    tasks = slices_of(slices.count(), slice_rows)
    return owned(stored(inherited(numbered(slices, tasks), tasks), FILE_ROWS), tasks).drop("_slice")
