"""Frozen days: snapshots, what disturbs them, and answers about pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.ledger import NO_DAY, PART, Change, Ledger
from ..sources.traces import D
from .rollup import claimed_pauses

TABLES = ("stretches", "projects", "subjects", "days")


def with_rules_hash(rows: DataFrame, rules: DataFrame, name: str = "rules_hash") -> DataFrame:
    """rows (actor_id ...) with a hash of the rules that hold for their actor: those for all and their own, in the order written.

    Rows of rules are hashed first, and gathered by actor; one person's edit
    moves nobody else's hash.
    """
    text = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(rules.columns)))
    by_actor = rules.select("actor_id", F.sha2(text, 256).alias("h")).groupBy("actor_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("own"))
    general = by_actor.where("actor_id is null").agg(F.max("own").alias("_all"))  # one row
    own = by_actor.where("actor_id is not null").select(F.col("actor_id").alias("_actor"), "own")
    out = rows.join(own, F.col("actor_id") == F.col("_actor"), "left").join(F.broadcast(general))
    return out.withColumn(name, F.sha2(F.concat_ws(":", F.coalesce("own", F.lit("")), F.coalesce("_all", F.lit(""))), 256)).drop("_actor", "own", "_all")


#: What a frozen day keeps of the settings it was worked out with, and of the questions it was asked.
SETTINGS = ("tz", "gap_us", "window_us", "head_us", "tail_us", "fallback", "count_background")
ASKED = ("questions_total", "questions_answered", "one_offs")
FROZEN_RULES = "rules_hash string, rule_id int, actor_id string, level string, project string, subject string, kind string, value string, since string"


def frozen_ledger(spark: SparkSession, path: str, parts: dict[str, DataFrame]) -> Ledger:
    """A ledger for frozen days, with tables shaped as parts."""
    return Ledger(spark, path, tables={n: parts[n].schema for n in TABLES} | {"rules": FROZEN_RULES})


def with_settings_of(days: DataFrame, entries: DataFrame, count_background: bool = False) -> DataFrame:
    """days (D ...) with the settings that their entries were worked out with; null for a day without any."""
    own = entries.groupBy(*D).agg(*(F.first(c).alias(c) for c in SETTINGS[:-1]))
    return days.join(own, list(D), "left").withColumn("count_background", F.lit(count_background))


def confirm_snapshot(parts: dict[str, DataFrame], ledger: Ledger, rules: DataFrame | None = None, tag: str = "") -> None:
    """Freeze days, those that have a row in the part `days`: the four tables and the rules in one commit, in the place of what was frozen of them before.

    A day that is frozen again keeps nothing of before, also where a part has no
    rows for it now. Rules are stored once for each hash of them, so a day is
    read with those it was worked out with. ledger.vacuum() removes files of
    what was replaced.
    """
    placed = lambda df: df.withColumns({"part_day": F.col("local_day").cast("string"), "bucket": ledger.actor_bucket()})
    days = placed(parts["days"].select(*D).distinct())
    touched = days.select(*PART).distinct()
    changes = [Change(n, ledger.read(n, touched, keep_parts=True).join(days.select(*D), list(D), "left_anti").unionByName(placed(parts[n].join(days.select(*D), list(D), "left_semi"))), touched) for n in TABLES]
    if rules is not None:
        new = parts["days"].select(F.col("actor_id").alias("_actor"), "rules_hash").distinct().join(ledger.read("rules").select("rules_hash").distinct(), "rules_hash", "left_anti")
        # actors without rules of their own share a hash, and are one of them here
        new = new.groupBy("rules_hash").agg(F.min("_actor").alias("_actor")).withColumn("_scope", F.explode(F.array("_actor", F.lit("*"))))
        held = new.join(rules.withColumn("_scope", F.coalesce("actor_id", F.lit("*"))), "_scope").withColumns({"part_day": F.lit(NO_DAY), "bucket": F.lit(0)})
        changes.append(Change("rules", held))
    ledger.commit(changes, tag)


def snapshot_read(ledger: Ledger) -> dict[str, DataFrame]:
    """The tables of frozen days, and the rules of each hash."""
    return {n: ledger.read(n) for n in (*TABLES, "rules")}


def frozen_rules(ledger: Ledger) -> DataFrame:
    """(D, rule_id, level, project, subject, kind, value, since): the rules that each frozen day was worked out with."""
    return ledger.read("days").select(*D, "rules_hash").join(ledger.read("rules").drop("actor_id"), "rules_hash").drop("rules_hash")


def snapshot_runs(stretches: DataFrame) -> DataFrame:
    """(D, from_us, to_us, project, gap): runs of stored stretches, with the gaps between blocks put in again."""
    w = W.partitionBy(*D).orderBy("from_us", "to_us")
    s = stretches.select(*D, "from_us", "to_us", F.col("owner").alias("project"))
    prev_to, prev = F.lag("to_us").over(w), F.lag("project").over(w)
    s = s.withColumns({"_gap_from": F.when(prev_to < F.col("from_us"), prev_to), "_new": F.coalesce(((prev != F.col("project")) | (prev_to < F.col("from_us"))).cast("int"), F.lit(1))})
    s = s.withColumn("_r", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = s.groupBy(*D, "_r").agg(F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us"), F.first("project").alias("project"), F.lit(False).alias("gap")).drop("_r")
    gaps = s.where("_gap_from is not null").select(*D, F.col("_gap_from").alias("from_us"), F.col("from_us").alias("to_us"), F.lit("").alias("project"), F.lit(True).alias("gap"))
    return runs.unionByName(gaps)


def confirmed_list(days: DataFrame, rules: DataFrame) -> DataFrame:
    """Frozen days with what was asked and answered, and whether the rules have moved since (newest first where order matters)."""
    asked = [c for c in ASKED if c in days.columns]
    return with_rules_hash(days, rules, "_now").withColumn("rules_moved", F.col("rules_hash") != F.col("_now")).select(*D, "events", *asked, "rules_moved")


def asked_of(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(D, questions_total, questions_answered, one_offs): how many questions a day had, how many answers were given for the day, and how many of those hold only once."""
    q = questions.groupBy(*D).agg(F.count("*").alias("questions_total"))
    a = answers.groupBy(*D).agg(F.count("*").alias("questions_answered"), F.count_if("one_off").alias("one_offs"))
    return q.join(a, list(D), "full").na.fill(0, list(ASKED))


def rules_moved(days: DataFrame, rules: DataFrame) -> DataFrame:
    return confirmed_list(days, rules).where("rules_moved").select(*D)


def disturbed_days(days: DataFrame, entries: DataFrame) -> DataFrame:
    """Frozen days whose number of events has changed."""
    now = entries.groupBy(*D).agg(F.count("*").alias("now"))
    return days.select(*D, "events").join(now, list(D), "left").withColumn("now", F.coalesce("now", F.lit(0).cast("long"))).where("events <> now")


def snapshot_claims(pauses: DataFrame, runs: DataFrame, bounds: DataFrame, rows: DataFrame) -> DataFrame:
    """Project rows of frozen days with claims worked out anew; a project with a claim alone gets a row."""
    c = claimed_pauses(pauses, runs, bounds).groupBy(*D, "project").agg(F.sum("held_us").alias("_c"))
    z = F.lit(0).cast("long")
    return rows.select(*D, "project", "attention_us", "background_us").join(c, [*D, "project"], "full").select(*D, "project", F.coalesce("attention_us", z).alias("attention_us"), F.coalesce("background_us", z).alias("background_us"), F.coalesce("_c", z).alias("claimed_us"))


def pause_answer_supersede(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored without the answers that a new one of the day overlaps, and the new ones."""
    n = new.select(*D, F.col("from_us").alias("nf"), F.col("to_us").alias("nt"))
    hit = (stored.actor_id == n.actor_id) & (stored.local_day == n.local_day) & (stored.from_us < n.nt) & (stored.to_us > n.nf)
    return stored.join(n, hit, "left_anti").unionByName(new)


def export_rows(projects: DataFrame, subjects: DataFrame) -> DataFrame:
    """(D, project, subject, attention_us): projects ('' as subject), their subjects, and what is left of a project ('rest of project')."""
    p = projects.select(*D, "project", F.lit("").alias("subject"), "attention_us")
    s = subjects.select(*D, "project", "subject", "attention_us")
    rest = s.groupBy(*D, "project").agg(F.sum("attention_us").alias("_s")).join(p.drop("subject"), [*D, "project"]).select(*D, "project", F.lit("rest of project").alias("subject"), (F.col("attention_us") - F.col("_s")).alias("attention_us"))
    return p.unionByName(s).unionByName(rest)


def export_timeline(stretches: DataFrame, pauses: DataFrame) -> DataFrame:
    """(D, nth, from_us, to_us, project, gap, claimed): a frozen day as its runs, one after the other, with the pauses between; a pause that a worked answer fits exactly is claimed, under the answer's project."""
    runs = snapshot_runs(stretches.where("to_us > from_us"))
    worked = pauses.where("worked").groupBy(*D, "from_us", "to_us").agg(F.max_by("project", "answered_at").alias("_p"))
    out = runs.join(worked, [*D, "from_us", "to_us"], "left").withColumn("claimed", F.col("gap") & F.col("_p").isNotNull())
    nth = F.row_number().over(W.partitionBy(*D).orderBy("from_us", "to_us"))
    return out.select(*D, nth.alias("nth"), "from_us", "to_us", F.when(F.col("claimed"), F.col("_p")).otherwise(F.col("project")).alias("project"), "gap", "claimed")


def snapshot_span(stretches: DataFrame) -> DataFrame:
    """(D, span_us): from the first to the last stretch of a frozen day."""
    return stretches.groupBy(*D).agg((F.max("to_us") - F.min("from_us")).alias("span_us"))
