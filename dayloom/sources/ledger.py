"""A stored account that follows its sources: traces, cursors and day tables, changed by commits.

A ledger is a folder. A table lies in parts by day and bucket (of the actor, or
of the identity), and each commit writes the parts it changes under a version of
its own. Its row in `commits`, one small file that is written last, makes them
count, all tables at once; until then, and if the run fails, readers see what
was there. A commit adds to a part or replaces it, and parts it doesn't touch
keep their files. vacuum() removes what no reader can see any more.

The identity of a trace (actor, source, external id) is unique over the whole
ledger, whenever it comes again and whatever time it has then: an index says
where each identity is stored, and a batch meets the buckets that its
identities fall into. A commit with a tag that was committed before does nothing,
so that a batch that a stream tries again counts once. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .feeds import IDENTITY, OUTCOMES, append_dedup, earliest, incremental_scan
from .store import stored
from .traces import SCHEMA, D, Settings, entries

PART = ["part_day", "bucket"]
PARTS = "part_day string, bucket int"
NO_DAY = "-"
COMMIT = f"tag string, name string, {PARTS}, mode string, version string"
TABLES = {
    "events": SCHEMA,
    "identities": "actor_id string, source string, external_id string, at_day string, at_bucket int",
    "cursors": "actor_id string, source string, cursor timestamp",
    "files": "path string, length bigint, modified timestamp",
    "disturbed": "actor_id string, local_day date, events bigint, now bigint",
}
#: What a source that states a trace again may change of it.
RESTATED = ("ts", "duration_ms", "type", "subtype", "title")


@dataclass
class Counted:
    """Counters of rows, observed while they are written as they are."""

    observed: dict[str, Observation] = field(default_factory=dict)

    def watch(self, rows: DataFrame, **counters: Column) -> DataFrame:
        """rows, of which counters counts those that fulfil each condition once an action has read them."""
        seen = Observation()
        self.observed |= dict.fromkeys(counters, seen)
        return rows.observe(seen, *(F.count_if(c).alias(n) for n, c in counters.items()))

    def get(self) -> dict[str, int]:
        return {n: self._read(o).get(n) or 0 for n, o in self.observed.items()}

    @staticmethod
    def _read(seen: Observation) -> dict[str, int]:
        try:
            return seen.get
        except Py4JJavaError:  # rows that turn out to be none while they are read are planned anew without their counters
            return {}


def outcomes(rows: DataFrame, source: str, column: str = "outcome") -> tuple[DataFrame, dict[str, int]]:
    """rows, stored, and how many have each outcome of their source, counted while they are written."""
    counted = Counted()
    rows = stored(counted.watch(rows, **{o: F.col(column) == o for o in OUTCOMES[source]}))
    return rows, counted.get()


@dataclass
class Change:
    """Rows for a table: added to their parts, or in the place of what is in the parts touched."""

    name: str
    rows: DataFrame
    touched: DataFrame | None = None


def instant(now: dt.datetime | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


class Ledger:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 8, tables: dict[str, StructType | str] | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.tables = {n: s if isinstance(s, StructType) else StructType.fromDDL(s) for n, s in (TABLES | (tables or {})).items()}

    # what is there

    def _folder(self, path: str):
        """The file system of a path, and the path there."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _found(self, path: str, schema: StructType) -> DataFrame:
        files, at = self._folder(path)
        if not files.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)

    def commits(self) -> DataFrame:
        return self._found(f"{self.path}/commits", StructType.fromDDL(COMMIT))

    def live(self, name: str) -> DataFrame:
        """(part_day, bucket, version) of the files that count: each part's since it was last replaced."""
        c = self.commits().where(F.col("name") == name)
        last = c.where("mode = 'replace'").groupBy(*PART).agg(F.max("version").alias("_last"))
        return c.join(last, PART, "left").where("_last is null or version >= _last").select(*PART, "version").distinct()

    def read(self, name: str, parts: DataFrame | None = None, keep_parts: bool = False) -> DataFrame:
        """A table, or what of it lies in parts (part_day, bucket): the partitions of others aren't read."""
        schema = StructType([*self.tables[name], *StructType.fromDDL(f"{PARTS}, version string")])
        live = self.live(name)
        if parts is not None:
            live = live.join(parts.select(*PART).distinct(), PART, "left_semi")
        rows = self._found(f"{self.path}/{name}", schema).join(live, [*PART, "version"], "left_semi")
        return rows.select(*self.tables[name].names, *(PART if keep_parts else []))

    # commits

    def done(self, tag: str) -> bool:
        return self.commits().where(F.col("tag") == tag).limit(1).count() > 0

    def commit(self, changes: list[Change], tag: str = "", version: str | None = None, laid: dict[str, DataFrame] | None = None) -> str:
        """Write changes under a version and make it count. laid: rows by table that lie under the version already."""
        version = version or self.new_version()
        mark = lambda name, parts, mode: parts.select(F.lit(tag).alias("tag"), F.lit(name).alias("name"), *PART, F.lit(mode).alias("mode")).distinct()
        rows = self.spark.createDataFrame([(tag, "", NO_DAY, 0, "tag")], "tag string, name string, part_day string, bucket int, mode string")
        for name, parts in (laid or {}).items():
            rows = rows.unionByName(mark(name, parts, "add"))
        for c in changes:
            self.write(c, version)
            rows = rows.unionByName(mark(c.name, self.written(c.name, version), "add") if c.touched is None else mark(c.name, c.touched, "replace"))
        rows.coalesce(1).write.parquet(f"{self.path}/commits/version={version}")  # a row a part that changes
        return version

    def new_version(self) -> str:
        return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, change: Change, version: str) -> None:
        columns = [*self.tables[change.name].names, *PART]
        change.rows.select(*columns).repartition(*PART, F.pmod(F.xxhash64(*columns), F.lit(4))).write.mode("overwrite").partitionBy(*PART).parquet(f"{self.path}/{change.name}/version={version}")

    def written(self, name: str, version: str) -> DataFrame:
        """The rows of a table that lie under a version, with their parts."""
        schema = StructType([*self.tables[name], *StructType.fromDDL(PARTS)])
        path = f"{self.path}/{name}/version={version}"
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)

    def of_commit(self, name: str, tag: str) -> DataFrame:
        """The rows that a commit added to a table."""
        versions = [r["version"] for r in self.commits().where((F.col("tag") == tag) & (F.col("name") == name) & (F.col("mode") == "add")).select("version").distinct().collect()]  # one
        return self.written(name, versions[0]) if versions else self.spark.createDataFrame([], self.tables[name])

    def vacuum(self) -> int:
        """Remove the files of parts that were replaced since; how many parts that were."""
        gone = 0
        for name in self.tables:
            past = self.commits().where((F.col("name") == name) & (F.col("mode") != "tag")).select(*PART, "version").distinct()
            for r in past.join(self.live(name), [*PART, "version"], "left_anti").toLocalIterator():
                files, at = self._folder(f"{self.path}/{name}/version={r['version']}/part_day={r['part_day']}/bucket={r['bucket']}")
                gone += bool(files.delete(at, True))
        return gone

    # traces

    def actor_bucket(self, actor: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col("actor_id") if actor is None else actor), F.lit(self.buckets)).cast("int")

    def placed(self, traces: DataFrame) -> DataFrame:
        """traces with their part: the day of their time in UTC, and the bucket of their actor."""
        return traces.withColumns({"part_day": F.coalesce(F.to_date("ts").cast("string"), F.lit(NO_DAY)), "bucket": self.actor_bucket()})

    def indexed(self, placed: DataFrame) -> DataFrame:
        """The index rows of traces that have a part."""
        rows = placed.select(*IDENTITY, F.col("part_day").alias("at_day"), F.col("bucket").alias("at_bucket"))
        return rows.withColumns({"part_day": F.lit(NO_DAY), "bucket": F.pmod(F.xxhash64(*IDENTITY), F.lit(self.buckets)).cast("int")})

    def found(self, identities: DataFrame) -> DataFrame:
        """The index rows of some identities; buckets that none of them falls into aren't read."""
        asked = self.indexed(identities.select(*IDENTITY).distinct().withColumns({"part_day": F.lit(""), "bucket": F.lit(0)}))
        return self.read("identities", asked).join(asked.select(*IDENTITY), IDENTITY, "left_semi")

    def whole(self, traces: DataFrame, now: Column) -> DataFrame:
        """traces with all columns of events."""
        there = {c.lower() for c in traces.columns}
        made = {f.name: F.lit(None).cast(f.dataType) for f in self.tables["events"] if f.name.lower() not in there}
        return traces.withColumns(made | {"ingested_at": now}).select(*(F.col(f.name).cast(f.dataType) for f in self.tables["events"]))

    def append(self, traces: DataFrame, tag: str = "", now: dt.datetime | None = None, more: Callable[[DataFrame], list[Change]] | None = None, observed: bool = True) -> dict[str, int]:
        """Store each identity that isn't there yet, the earliest of those that come together, and move the cursors, in one commit.

        Gives the counters seen, new and unchanged; seen is observed while the
        rows are written, and left to the progress of the query in a stream
        (observed false). more: changes that belong to the same commit, from the
        new traces.
        """
        if tag and self.done(tag):
            return dict.fromkeys(("seen", "new", "unchanged") if observed else ("new",), 0)
        at = instant(now)
        counted = Counted()
        rows = self.whole(traces, at)
        rows = stored(counted.watch(rows, seen=F.lit(True)) if observed else rows)  # read once, asked three times
        new = append_dedup(rows, self.found(rows))
        version = self.new_version()
        self.write(Change("events", self.placed(new)), version)
        fresh = self.written("events", version)  # the index is made of what was written
        self.commit([Change("identities", self.indexed(fresh)), *self.moved_cursors(rows, at), *(more(fresh) if more else [])], tag, version, {"events": fresh})
        got = counted.get() | {"new": fresh.count()}  # read off the footers of its files
        return got | ({"unchanged": got["seen"] - got["new"]} if observed else {})

    # cursors

    def moved_cursors(self, traces: DataFrame, now: Column) -> list[Change]:
        """The newest time of each actor and source that isn't in the future; a cursor never goes back."""
        seen = traces.where(F.col("ts") <= now).groupBy("actor_id", "source").agg(F.max("ts").alias("cursor")).withColumns({"part_day": F.lit(NO_DAY), "bucket": self.actor_bucket()})
        touched = seen.select(*PART).distinct()
        both = self.read("cursors", touched, keep_parts=True).unionByName(seen)
        return [Change("cursors", both.groupBy("actor_id", "source", *PART).agg(F.max("cursor").alias("cursor")), touched)]

    def since_cursor(self, rows: DataFrame, overlap_days: int = 7) -> DataFrame:
        """Rows from the stored cursor of their actor and source less the overlap; all rows where there is none."""
        return incremental_scan(rows, self.read("cursors"), overlap_days)

    def import_files(self, folder: str, read: Callable[[list[str]], DataFrame], pattern: str = "*", now: dt.datetime | None = None) -> dict[str, int]:
        """Append what read makes of the files of a folder that are new or have changed in size or time; the others aren't opened."""
        there = self.spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
        changed = there.join(self.read("files"), ["path", "length", "modified"], "left_anti")
        paths = [r["path"] for r in changed.select("path").collect()]  # the names a reader takes
        if not paths:
            return {"files": 0, "seen": 0, "new": 0, "unchanged": 0}
        known = changed.withColumns({"part_day": F.lit(NO_DAY), "bucket": F.lit(0)})
        kept = self.read("files", keep_parts=True).join(changed.select("path"), "path", "left_anti").unionByName(known)
        change = Change("files", kept, self.spark.createDataFrame([(NO_DAY, 0)], PARTS))
        return {"files": len(paths)} | self.append(self.since_cursor(read(paths)), now=now, more=lambda _: [change])

    # sources that restate a window

    def replace_window(self, feed: DataFrame, instances: DataFrame, window_from: str, window_to: str, tag: str = "", now: dt.datetime | None = None) -> dict[str, int]:
        """Make the window say what the feed says: new traces are inserted, changed ones moved, and those it no longer has removed.

        instances: (actor_id, source, entrypoint, whole), those that were asked.
        A trace belongs to one; only its own may remove it, and only if it was
        read whole (refused counts what else would go). A trace stored outside of
        the window that the feed states is changed too. Gives the counters new,
        moved, unchanged, removed and refused.
        """
        counts = dict.fromkeys(("new", "moved", "unchanged", "removed", "refused"), 0)
        if tag and self.done(tag):
            return counts
        at = instant(now)
        feed = earliest(self.whole(feed, at))
        opens, shuts = F.lit(window_from).cast("timestamp"), F.lit(window_to).cast("timestamp")
        asked = instances.select("actor_id", "source", "entrypoint", "whole").distinct()
        here = self.live("events").where(F.col("part_day").between(F.to_date(opens).cast("string"), F.to_date(shuts).cast("string")))
        here = here.join(asked.select(self.actor_bucket().alias("bucket")).distinct(), "bucket", "left_semi").select(*PART)
        spots = here.unionByName(self.found(feed).select(F.col("at_day").alias("part_day"), F.col("at_bucket").alias("bucket"))).distinct()
        had = self.read("events", spots, keep_parts=True).join(asked.select("actor_id", "source").distinct(), ["actor_id", "source"], "left_semi")
        mine = ["actor_id", "source", "entrypoint"]
        had = had.join(asked.withColumn("_asked", F.lit(True)), mine, "left").withColumn("_in", F.coalesce("_asked", F.lit(False)) & (F.col("ts") >= opens) & (F.col("ts") < shuts))
        was = had.select(*IDENTITY, F.struct(*self.tables["events"].names, *PART).alias("_was"), "_in", "whole")
        says = feed.select(*IDENTITY, F.struct(*feed.columns).alias("_now"))
        both = was.join(says, IDENTITY, "full").where("_now is not null or _in")
        same = F.lit(True)
        for c in ("ts", "duration_ms", "title"):
            same = same & F.col(f"_was.{c}").eqNullSafe(F.col(f"_now.{c}"))
        change = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), F.when(F.coalesce("whole", F.lit(False)), "removed").otherwise("refused")).when(same, "unchanged").otherwise("moved")
        counted = Counted()
        both = counted.watch(both.withColumn("_change", change), **{n: F.col("_change") == n for n in counts})
        path = f"{self.path}/changes/version={self.new_version()}"
        both.write.parquet(path)
        got = counted.get()
        both = self.spark.read.schema(both.schema).parquet(path).where("_change in ('new', 'moved', 'removed')")
        if not got["new"] + got["moved"] + got["removed"]:
            return got
        # a row that moves keeps what the source doesn't restate, and when it was first seen
        value = lambda c: F.when(F.col("_change") == "new", F.col(f"_now.{c}")).otherwise(F.col(f"_now.{c}") if c in RESTATED else F.col(f"_was.{c}"))
        fresh = self.placed(both.where("_change <> 'removed'").select(*(value(c).alias(c) for c in self.tables["events"].names)))
        left = both.where("_change <> 'new'").select(*IDENTITY)
        touched = both.where("_was is not null").select("_was.part_day", "_was.bucket").unionByName(fresh.select(*PART)).distinct()
        kept = self.read("events", touched, keep_parts=True).join(left, IDENTITY, "left_anti")
        slots = self.indexed(both.select(*IDENTITY).withColumns({"part_day": F.lit(""), "bucket": F.lit(0)})).select(*PART).distinct()
        index = self.read("identities", slots, keep_parts=True).join(left, IDENTITY, "left_anti").unionByName(self.indexed(fresh))
        self.commit([Change("events", kept.unionByName(fresh), touched), Change("identities", index, slots)], tag)
        return got

    # day tables

    def refresh_days(self, days: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]], settings: Settings | None = None, table: DataFrame | None = None, frozen: DataFrame | None = None, tag: str = "") -> DataFrame:
        """Work some actor-days (D) out again from the stored traces and put them into the day tables, in one commit.

        build makes the tables (with D) of entries. Other days of a part are
        copied, other parts stay as they are. frozen: (D, events) of frozen days;
        those of the days whose number of events has changed are written to
        `disturbed`, and given back.
        """
        of = stored(days.select(*D).distinct())  # a row a day, asked for by every table
        near = of.select("actor_id", F.explode(F.sequence(F.date_sub("local_day", 1), F.date_add("local_day", 1))).alias("d")).select(F.col("d").cast("string").alias("part_day"), self.actor_bucket().alias("bucket")).distinct()
        e = entries(self.read("events", near), settings, table).join(of, list(D), "left_semi")
        touched = of.select(F.col("local_day").cast("string").alias("part_day"), self.actor_bucket().alias("bucket")).distinct()
        changes = []
        for name, rows in build(e).items():
            rows = rows.withColumns({"part_day": F.col("local_day").cast("string"), "bucket": self.actor_bucket()})
            changes.append(Change(name, self.read(name, touched, keep_parts=True).join(of, list(D), "left_anti").unionByName(rows), touched))
        if frozen is not None:
            now = e.groupBy(*D).agg(F.count("*").alias("now"))
            moved = frozen.select(*D, "events").join(of, list(D), "left_semi").join(now, list(D), "left").withColumn("now", F.coalesce("now", F.lit(0).cast("long"))).where("events <> now")
            moved = moved.withColumns({"part_day": F.col("local_day").cast("string"), "bucket": self.actor_bucket()})
            changes.append(Change("disturbed", self.read("disturbed", touched, keep_parts=True).join(of, list(D), "left_anti").unionByName(moved), touched))
        self.commit(changes, tag)
        return self.read("disturbed", touched).join(of, list(D), "left_semi")
