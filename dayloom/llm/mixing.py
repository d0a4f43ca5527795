"""Mix sources to target weights by pivotal dependent rounding.

A source's target says how often its words are taken: target / source_size
copies of each document, a whole number and a fraction p. Pivotal rounding
makes the fractions whole: two documents with fractions move mass from one to
the other, in a random direction that keeps both expectations and their joint
number of words, until one of them is 0 or 1; the other goes on. So at most one
document of a group is left with a fraction. Documents are dealt into groups of
about GROUP_WORDS words; what is left goes up a reduction tree, FANOUT groups
at a time, until one document a source remains, which is rounded at random.
A source's taken words differ from its target by one document at most.

All chance comes from hashes of the rows, so reruns agree. Null sources are a
source of their own, the last; null texts have no words and are taken 0 times
in words. Repeated rows are documents of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import carried, cut, released, table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
GROUP_WORDS, FANOUT = 200_000, 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: Column) -> DataFrame:
    """df with nth (0, 1, ...) in that order: a range sort, then an offset for each partition."""
    rows = cut(df.orderBy(order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # over one row a partition
    offsets = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(offsets, part == F.col("_p")).withColumn("nth", F.col("_off") + F.col("_id") % (1 << 33)).drop("_id", "_p", "_n", "_off")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows: share of all words by weight, no target above most times its source.

    The level (words for each unit of weight) rises until the excess of the
    capped sources is dealt out; a step is one aggregate over the sources.
    """
    per = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last())
    per = cut(per.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))))
    level, known = 0.0, -1
    while True:
        capped = F.col("source_size") * most <= F.lit(level) * F.col("w")
        r = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("source_size"))).alias("full"), F.sum(F.when(~capped, F.col("w"))).alias("w"), F.count_if(capped).alias("n")).first()
        if r["n"] == known or not r["w"]:
            break
        known, level = r["n"], (share * (r["all"] or 0) - most * (r["full"] or 0)) / r["w"]
    return per.select("source", "source_size", F.least(F.col("source_size") * float(most), F.lit(level) * F.col("w")).alias("target"))


def uniform(a: int, b: int) -> float:
    x = (a * 0x9E3779B97F4A7C15 ^ b) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return ((x ^ x >> 31) >> 11) / (1 << 53)


def pivot(size: list[int], p: list[float], row: list[int]) -> list[float]:
    """p after pivotal rounding; at most one entry with a size stays between 0 and 1."""
    p, i = list(p), -1
    for j in range(len(p)):
        if not (0 < p[j] < 1 and size[j] > 0):
            continue
        if i < 0:
            i = j
            continue
        a, b = size[i], size[j]
        up, down = min(a * (1 - p[i]), b * p[j]), min(a * p[i], b * (1 - p[j]))
        if uniform(row[i], row[j]) * (up + down) < down:  # i gains, j loses
            p[i], p[j] = (1.0, p[j] - up / b) if up == a * (1 - p[i]) else (p[i] + up / a, 0.0)
        else:
            p[i], p[j] = (0.0, p[j] + down / b) if down == a * p[i] else (p[i] - down / a, 1.0)
        p[j] = min(1.0, max(0.0, p[j]))
        if not 0 < p[i] < 1:
            i = j if 0 < p[j] < 1 else -1
    return p


def rounded(table: pa.Table) -> pa.Table:
    table = table.sort_by([("_size", "descending"), ("_row", "ascending")])  # so that what is left at the end is small
    p = pivot(table["_size"].to_pylist(), table["_p"].to_pylist(), table["_row"].to_pylist())
    return table.set_column(table.schema.get_field_index("_p"), "_p", pa.array(p, pa.float64()))


def plan(narrow: DataFrame, **how) -> DataFrame:
    """(source, _size, _row, source_size, target, _whole, _m, _extra) for each distinct row of narrow (source, _size, _row).

    _m rows are the same; each is taken _whole times and _extra of them once
    more. As they have one size and one fraction, pivots among them leave a
    whole number of them taken and one with the rest, so only that one goes to
    the rounding groups. Rows without words have nothing to round.
    """
    rows = cut(narrow.groupBy("source", "_size", "_row").agg(F.count("*").alias("_m")))
    goal = cut(targets(rows.select("source", (F.col("_size") * F.col("_m")).alias("size")), **how)).withColumnRenamed("source", "_s")
    # one row a source: Spark broadcasts it while its file is small
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_whole", F.floor(share + 1e-12)).withColumn("_p", F.greatest(F.lit(0.0), share - F.col("_whole")) * F.col("_m"))
    rows = rows.withColumn("_extra", F.when(F.col("_size") > 0, F.floor(F.col("_p") + 1e-12)).otherwise(0)).withColumn("_p", F.greatest(F.lit(0.0), F.col("_p") - F.col("_extra")))
    groups = F.ceil((F.col("source_size") + 1) / GROUP_WORDS)
    rows = cut(rows.withColumn("_group", F.pmod(F.shiftright("_row", 3), groups)))
    open_ = (F.col("_p") > 0) & (F.col("_p") < 1) & (F.col("_size") > 0)
    done, level = [rows.where(~open_).withColumn("_p", F.lit(0.0))], rows.where(open_)
    widest = goal.agg(F.max(groups)).first()[0] or 1
    for _ in range(1 + max(0, math.ceil(math.log(widest, FANOUT) - 1e-9))):
        level = cut(level.groupBy("source", "_group").applyInArrow(rounded, level.schema))
        done.append(level.where(~open_))
        level = level.where(open_).withColumn("_group", F.floor(F.col("_group") / FANOUT))
    chance = F.pmod(F.xxhash64("_row", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = level.withColumn("_p", F.when(chance < F.col("_p"), 1.0).otherwise(0.0))  # the last document of each source
    for x in done:
        out = out.unionByName(x)
    return out.withColumn("_extra", F.col("_extra") + F.when(F.col("_p") >= 1, 1).otherwise(0)).drop("_p", "_group")


def mix_sources(docs: DataFrame, keep: list[str] | None = None, **how) -> DataFrame:
    """keep (all columns unless given) plus size, source_size, target, copies and taken for each row of docs (in place of any of their names).

    Rounding sees narrow rows only - a hash of the row and its size - and what
    is kept moves once, when it meets its count, or not at all if Spark
    broadcasts the counts by their size. Leave out the text where the counts
    are all that is asked for. Empty input gives no rows; a very long text is
    one document, so a mix can miss its target by that much.
    """
    keep = docs.columns if keep is None else keep
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_doc"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("_size"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    counts = cut(plan(base.select("source", "_size", "_row"), **how))

    def told(part: DataFrame) -> DataFrame:
        there = part.withColumnsRenamed({"source": "_s", "_size": "_n", "_row": "_r"})
        return base.join(there, (F.col("_row") == F.col("_r")) & (F.col("_size") == F.col("_n")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_n", "_r")

    # of rows that are the same in all columns some may be taken once more than others
    apart = (F.col("_extra") > 0) & (F.col("_extra") < F.col("_m"))
    out = told(counts.where(~apart)).withColumn("copies", F.col("_whole") + F.when(F.col("_extra") > 0, 1).otherwise(0))
    if counts.where(apart).limit(1).count():
        same = cut(told(counts.where(apart)).withColumn("_part", F.spark_partition_id()))
        here = same.groupBy("_row", "_size", "source", "_part").agg(F.count("*").alias("_here"))
        before = F.coalesce(F.sum("_here").over(W.partitionBy("_row", "_size", "source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        here = here.select(F.col("_row").alias("_r"), F.col("_part").alias("_q"), F.col("_size").alias("_n"), before.alias("_before"))
        nth = F.row_number().over(W.partitionBy("_row", "_size", "_part").orderBy("_row"))
        same = same.withColumn("_nth", nth).join(cut(here), (F.col("_row") == F.col("_r")) & (F.col("_part") == F.col("_q")) & (F.col("_size") == F.col("_n")))
        same = same.withColumn("copies", F.col("_whole") + F.when(F.col("_nth") + F.col("_before") <= F.col("_extra"), 1).otherwise(0))
        out = out.unionByName(same.select(out.columns))
    out = out.withColumn("copies", F.col("copies").cast("long"))
    return released(out.withColumns({"size": F.col("_size"), "taken": F.col("copies") * F.col("_size")}), "size", "source_size", "target", "copies", "taken")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs.select("doc_id", "source", "text"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them; copy counts from 1."""
    out = mix_sources(carried(docs, "source", "text"), keep=["_doc"])
    return released(out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), "copy")
