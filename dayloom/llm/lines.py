"""Incremental, reversible line dedup: sharded cuckoo filters before exact reference-count tables.

The exact tables are the postings (doc_id, key) - which document has which line
- and the counts (key, n, first): in how many documents it is, and the smallest
of them. The counts decide; the filters only spare lookups: keys with a count of
two or more are in the cuckoo filter of their shard, so a line whose key its
filter doesn't know is kept without a lookup. A filter never misses a key that
it holds, and its rare false hits are settled by the exact counts. Inserting or
deleting documents changes the counts of their keys alone, and inserts or
deletes in its shard's filter the keys whose count passes two; the postings are
asked only for keys that lost their first document. The result is that of the
documents that remain.

A line's key is the line with spaces, tabs and line ends stripped at both ends
and A-Z lower-cased; keys under MIN_CHARS code points are never dropped. A null
or empty text is one empty line. Rows of one doc_id are one document; a null
doc_id counts as one document whose id is larger than all others. A text of very
many lines costs in proportion to them; empty input gives no rows; there are no
ties, as all rows of the smallest doc_id keep their lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, released, small_batches, table
from .words import U, mix

MIN_CHARS = 10
#: Keys a shard's filter is built for, and lines of a shard that are probed together: a common line doesn't meet in one task.
SHARD_KEYS, PROBED = 50_000, 20_000
LAST = 2**63 - 1
SLOTS = 4
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; supports deletion.

    The second bucket of a fingerprint follows from the first and the
    fingerprint, so a stored fingerprint can move without its key.
    """

    def __init__(self, keys: int = 0, table: bytes | None = None):
        if table is not None:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
        else:
            self.table = np.zeros((1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85)))))), np.uint64).repeat(SLOTS).reshape(-1, SLOTS).astype(np.uint16)
        self.mask = len(self.table) - 1

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.int64).view(U))
        print_ = ((h >> U(48)).astype(np.int64) % 65535 + 1).astype(np.uint16)
        one = (h & U(self.mask)).astype(np.int64)
        return print_, one, one ^ self._jump(print_)

    def _jump(self, print_: np.ndarray) -> np.ndarray:
        return (mix(np.asarray(print_, np.uint16).astype(U)) & U(self.mask)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """False if the table is too full; it must then be built larger."""
        for fp, one, two in zip(*(x.tolist() for x in self._where(keys)), strict=True):
            for b in (one, two):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = fp
                    break
            else:
                for turn in range(500):
                    slot = (fp + turn) % SLOTS
                    fp, self.table[b, slot] = int(self.table[b, slot]), fp
                    b ^= int(self._jump(np.array([fp]))[0])
                    free = np.flatnonzero(self.table[b] == 0)
                    if len(free):
                        self.table[b, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Forget one copy of each key; only keys that were inserted may be deleted."""
        for fp, one, two in zip(*(x.tolist() for x in self._where(keys)), strict=True):
            for b in (one, two):
                at = np.flatnonzero(self.table[b] == fp)
                if len(at):
                    self.table[b, at[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, one, two = self._where(keys)
        return ((self.table[one] == fp[:, None]) | (self.table[two] == fp[:, None])).any(axis=1)

    @staticmethod
    def of(keys: np.ndarray) -> CuckooFilter:
        room = len(keys)
        while not (out := CuckooFilter(room)).insert(keys):
            room = 2 * room + 8
        return out

    def dump(self) -> bytes:
        return self.table.tobytes()


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def digest(key: Column) -> list[Column]:
    """128 bits of the key in two longs: k is the shard and filter hash, k2 makes it exact for all practical purposes."""
    return [F.xxhash64(key).alias("k"), F.xxhash64(F.lit(7), key, F.length(key)).alias("k2")]


def id_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(LAST))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at, k, k2): place and key of each line that is long enough to be dropped."""
    keys = F.filter(F.transform(F.split(F.col("text").cast("string"), "\n", -1), lambda x, i: F.struct(i.alias("at"), line_key(x).alias("key"))), lambda x: F.length(x["key"]) >= MIN_CHARS)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.explode(keys).alias("line"))
    return rows.select("doc_id", "text_hash", "line.at", *digest(F.col("line.key")))


KEY = ["k", "k2"]


class LineIndex:
    """postings: (doc_id, k, k2), exact; counts: (k, k2, n, first), exact; filters: one row (shard, filter) a shard."""

    def __init__(self, postings: DataFrame, counts: DataFrame, filters: DataFrame, shards: int):
        self.postings, self.counts, self.filters, self.shards = postings, counts, filters, shards

    @staticmethod
    def of(lines: DataFrame) -> LineIndex:
        """An index of lines_of(documents), best written: its postings are read off them, as only later inserts and deletes need them."""
        postings = lines.select("doc_id", *KEY).distinct()
        counts = cut(postings.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(id_of(F.col("doc_id"))).alias("first")))
        common = counts.where("n > 1")
        shards = max(1, common.count() // SHARD_KEYS)
        filters = common.select(shard(shards).alias("shard"), "k").groupBy("shard").applyInPandas(build_filter, "shard long, filter binary")
        return LineIndex(postings, counts, cut(filters), shards)

    @staticmethod
    def insert(docs: DataFrame, into: LineIndex | None = None) -> LineIndex:
        """An index of docs, with those of into. Lines that into has of a document already count once."""
        if into is None:
            return LineIndex.of(cut(lines_of(docs)))
        had = into.postings.withColumnsRenamed({"doc_id": "d", "k": "p", "k2": "q"})
        new = lines_of(docs).select("doc_id", *KEY).distinct()
        new = cut(new.join(had, new.doc_id.eqNullSafe(had.d) & (new.k == had.p) & (new.k2 == had.q), "left_anti"))
        change = cut(new.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(id_of(F.col("doc_id"))).alias("first")))
        counts = cut(into.counts.unionByName(change).groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("first").alias("first")))
        old = into.counts.select(*KEY, F.col("n").alias("was"))
        risen = change.join(old, KEY, "left").where("coalesce(was, 0) < 2 and coalesce(was, 0) + n > 1").select(*KEY)
        return LineIndex(cut(into.postings.unionByName(new)), counts, into.refilter(risen, counts, True), into.shards)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents ids (doc_id): as if they had never been inserted."""
        ids = ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        of = self.postings.doc_id.eqNullSafe(ids.gone)
        gone, postings = cut(self.postings.join(ids, of, "left_semi")), cut(self.postings.join(ids, of, "left_anti"))
        change = gone.groupBy(*KEY).agg(F.count("*").alias("less"), F.min(id_of(F.col("doc_id"))).alias("lowest"))
        change = cut(change.join(self.counts, KEY).select(*KEY, (F.col("n") - F.col("less")).alias("left"), "n", "first", (F.col("first") >= F.col("lowest")).alias("headless")))
        heirs = postings.join(change.where("headless and left > 0").select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min(id_of(F.col("doc_id"))).alias("heir"))
        changed = change.where("left > 0").join(heirs, KEY, "left").select(*KEY, F.col("left").alias("n"), F.coalesce("heir", "first").alias("first"))
        counts = cut(self.counts.join(change.select(*KEY), KEY, "left_anti").unionByName(changed))
        return LineIndex(postings, counts, self.refilter(change.where("n > 1 and left < 2").select(*KEY), counts, False), self.shards)

    def refilter(self, keys: DataFrame, counts: DataFrame, add: bool) -> DataFrame:
        """The filters with keys inserted or deleted; one that gets too full is built anew from the counts."""
        change = keys.select(shard(self.shards).alias("shard"), "k")

        def update(known: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            held, changed = CuckooFilter(table=known["filter"].iloc[0]) if len(known) else CuckooFilter(len(new)), new["k"].to_numpy()
            fits = held.insert(changed) if add else held.delete(changed) is None
            return pd.DataFrame({"shard": [(known if len(known) else new)["shard"].iloc[0]], "filter": [held.dump() if fits else None]})

        out = cut(self.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(update, "shard long, filter binary"))
        full = out.where("filter is null").select("shard")
        if full.limit(1).count() == 0:
            return out
        again = counts.where("n > 1").select(shard(self.shards).alias("shard"), "k").join(full, "shard", "left_semi")
        return cut(out.where("filter is not null").unionByName(again.groupBy("shard").applyInPandas(build_filter, "shard long, filter binary")))

    def suspects(self, lines: DataFrame) -> DataFrame:
        """The lines whose key a filter knows."""
        ways = max(1, lines.count() // (self.shards * PROBED))
        deal = lines.withColumns({"shard": shard(self.shards), "way": F.pmod(F.xxhash64("doc_id", "at", "k2"), F.lit(ways))})
        known = self.filters.select("shard", "filter", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))).alias("way"))
        return deal.groupBy("shard", "way").cogroup(known.groupBy("shard", "way")).applyInArrow(probe, "doc_id long, text_hash long, at int, k long, k2 long")

    def lost(self, lines: DataFrame) -> DataFrame:
        """The lines that their document loses, as another one with a smaller doc_id holds their key."""
        common = self.counts.where("n > 1").select(*KEY, "first")
        return cut(self.suspects(lines)).join(common, KEY).where(id_of(F.col("doc_id")) > F.col("first")).select("doc_id", "text_hash", "at")


def shard(shards: int) -> Column:
    return F.pmod(F.shiftright("k", 20), F.lit(shards))


def build_filter(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [CuckooFilter.of(pdf["k"].to_numpy()).dump()]})


def probe(lines: pa.Table, known: pa.Table) -> pa.Table:
    """In Arrow, as a null doc_id would turn the others into doubles elsewhere."""
    lines = lines.select(["doc_id", "text_hash", "at", "k", "k2"])
    if not known.num_rows or not lines.num_rows:
        return lines.slice(0, 0)
    return lines.filter(pa.array(CuckooFilter(table=known["filter"][0].as_py()).contains(lines["k"].to_numpy())))


def drop_repeated_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """docs with three more columns (in place of any of their names): kept (the text without the lines it loses), n_lines (before) and lost (the places of those lines, counted from 0, in order).

    index must hold docs, and may hold other documents.
    """
    small_batches(docs.sparkSession)
    lines = cut(lines_of(docs))
    index = index or LineIndex.of(lines)
    lost = cut(index.lost(lines).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("lost"))).withColumnsRenamed({"doc_id": "lost_from", "text_hash": "lost_text"})
    # only the struct goes into the join, so that each text is moved once
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    doc_id, text = F.col("_doc").getField("doc_id").cast("long"), F.col("_doc").getField("text").cast("string")
    both = rows.join(lost, doc_id.eqNullSafe(F.col("lost_from")) & (F.xxhash64(text) == F.col("lost_text")), "left")
    both = both.withColumn("text", F.coalesce(text, F.lit("")))

    def pieces(all_lines: Column) -> Column:
        """The lines between two lost ones, for each two. all_lines is a lambda's variable, so that the text is split once."""
        last = F.concat(F.array(F.lit(-1)), F.col("lost"))
        return F.flatten(F.transform(last, lambda e, i: F.slice(all_lines, e + 2, F.coalesce(F.get(F.col("lost"), i), F.size(all_lines)) - e - 1)))

    kept = F.array_join(F.get(F.transform(F.array(F.split("text", "\n", -1)), pieces), F.lit(0)), "\n")
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    both = both.select(*both.columns, F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept).alias("kept"), n_lines.cast("long").alias("n_lines"))
    return released(both.withColumn("lost", F.coalesce("lost", F.expr("cast(array() as array<int>)"))), "kept", "n_lines", "lost")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("lost").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), f AS (
  SELECT k.*, r.first IS NOT NULL AND r.first <> doc_id AS gone FROM k LEFT JOIN r ON r.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
