"""Benchmark items inside long documents, by bottom-k MinHash containment search.

DataFrame functions only. An item of n distinct five-word shingles is contained
in a document if at least ceil(threshold * n) of them occur there. Each item
keeps a bottom-k MinHash sketch: its k = n - ceil(threshold * n) + 1 smallest
shingle hashes. A document that contains the item misses at most k - 1 of its
shingles, so it holds a hash of the sketch: the search loses nothing. Items are
partitioned by size (powers of two of n), as short ones keep a large part of
their hashes and long ones only small hashes: each partition has a bound of its
own, its largest sketch hash. A document's shingle asks those partitions alone
whose bound it doesn't exceed, and never leaves its row if there is none.
Candidates are then verified on the shingles themselves. Very long texts are
searched whole; empty tables give no rows; there are no ties, as every pair at
the threshold or above is a row.

A word is a maximal run of ASCII letters and digits and of characters outside
ASCII in the lower-cased text. Texts of fewer than five words (nulls too) have
no shingle: such an item is never found, such a document holds none. Rows of
one item_id are one item; rows of one doc_id and text are one document; a null
doc_id is an id like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

APART = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
THRESHOLD = 0.8
POSITIVE = 0x7FFFFFFFFFFFFFFF


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), APART), "")


def with_shingles(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep plus w, the words; rows without a shingle go."""
    return df.where(F.col(text).isNotNull()).select(*keep, words(F.col(text)).alias("w")).where("size(w) >= 5")


def hashed(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep plus h, the array of shingle hashes (0 to 2^63 - 1)."""
    df = df.select(*keep, F.transform("w", lambda x: F.xxhash64(x)).alias("x"))
    return df.select(
        *keep,
        F.transform(F.sequence(F.lit(0), F.size("x") - 5), lambda i: F.xxhash64(*(F.get("x", i + k) for k in range(5))).bitwiseAND(F.lit(POSITIVE))).alias("h"),
    )


def spelled(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each distinct shingle (s, its words joined by a space) of a row."""
    return df.select(*keep, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice("w", i, 5), " ")))).alias("s"))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, n, part, h): the sketch of each item; part is its size partition."""
    each = hashed(with_shingles(items, "text", ["item_id"]), ["item_id"]).select("item_id", F.explode("h").alias("h"))
    each = each.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("h")).withColumn("n", F.size("h"))
    return each.select(
        "item_id", "n", F.floor(F.log2(F.col("n").cast("double"))).alias("part"), F.explode(F.slice("h", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).alias("h")
    )


def searched(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id), repeats included: documents with a hash of the item's sketch. docs: doc_id, text_hash, h (the array)."""
    bounds = sketch.groupBy("part").agg(F.max("h").alias("bound")).collect()  # a row for each power of two
    if not bounds:
        return docs.select("doc_id", "text_hash", F.lit(None).cast(sketch.schema["item_id"].dataType).alias("item_id")).limit(0)
    parts = F.array(*(F.struct(F.lit(r["part"]).alias("part"), F.lit(r["bound"]).alias("bound")) for r in bounds))
    highest = max(r["bound"] for r in bounds)
    asks = F.transform(F.filter("h", lambda h: h <= F.lit(highest)), lambda h: F.transform(F.filter(parts, lambda p: h <= p["bound"]), lambda p: F.struct(p["part"].alias("part"), h.alias("h"))))
    found = docs.select("doc_id", "text_hash", F.explode(F.flatten(asks)).alias("ask")).select("doc_id", "text_hash", "ask.part", "ask.h")
    # Spark broadcasts the sketches while they are small, by the size of their files, and else shuffles both sides.
    return found.join(sketch.select("item_id", "part", "h"), ["part", "h"]).select("doc_id", "text_hash", "item_id")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every document and item with containment of threshold or more."""
    docs = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    items = items.select("item_id", "text")
    sketch = cut(sketches(items, threshold))
    found = hashed(with_shingles(docs, "text", ["doc_id", "text_hash"]), ["doc_id", "text_hash"])
    pairs = cut(searched(found, sketch).distinct())
    who = pairs.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    held = docs.join(who, docs.doc_id.eqNullSafe(who.d) & (docs.text_hash == who.t), "left_semi")
    held = spelled(with_shingles(held, "text", ["doc_id", "text_hash"]), ["doc_id", "text_hash"])
    wanted = spelled(with_shingles(items, "text", ["item_id"]), ["item_id"]).distinct()
    wanted = cut(wanted)
    sizes = wanted.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    hits = held.join(wanted, "s").groupBy("doc_id", "text_hash", "item_id").agg(F.count_distinct("s").alias("n_found"))
    pairs = pairs.withColumnsRenamed({"doc_id": "d", "text_hash": "t", "item_id": "i"})
    hits = hits.join(pairs, hits.doc_id.eqNullSafe(pairs.d) & (hits.text_hash == pairs.t) & hits.item_id.eqNullSafe(pairs.i), "left_semi")
    hits = hits.join(sizes.withColumnRenamed("item_id", "i"), F.col("item_id").eqNullSafe(F.col("i"))).where(F.col("n_found") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))
    return hits.select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item."""
    hit = cut(contained(docs, items, threshold).select(F.col("doc_id").alias("hit")).distinct())
    return docs.join(hit, docs.doc_id.eqNullSafe(hit.hit), "left_anti")


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (
  SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL
), dw AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w FROM d
), ds AS (
  SELECT DISTINCT doc_id, text, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT doc_id, text, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), its AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw WHERE len(w) >= 5)
), n AS (SELECT item_id, count(*) AS n_shingles FROM its GROUP BY item_id)
SELECT doc_id, its.item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM ds JOIN its ON ds.s = its.s JOIN n ON n.item_id = its.item_id
GROUP BY doc_id, text, its.item_id, n_shingles
HAVING count(*) >= ceil(n_shingles * 0.8 - 1e-9)
"""
