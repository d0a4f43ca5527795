"""Secrets in text, with multipart credential linking.

DataFrame functions only. Base spans are found by pattern alone. Weak parts -
account names, unlabelled keys, endpoints - say nothing by themselves; they are
reported when their complement lies in the same scope, SCOPE code points around
them: an identifier next to a secret, a secret next to an identifier, an
endpoint next to both. Base spans count as parts as well. Parts are interval
joined on (text, bucket of SCOPE code points), so that no row meets more than
the parts of three buckets, however long the text.

A null text is empty: no spans. Every row of the input gives one row, repeated
rows and null ids as well; empty input gives none. Very long texts are searched
whole, in time proportional to their matches. Of two kinds that begin at one
place the one listed first comes first. All positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

SCOPE, RUN = 400, 256

# Kind, pattern, shortest match (or second group) that counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
BASE = [("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{14,}"), ("hex", r"[0-9a-f]{16,}")]
WEAK = [
    ("account", r"""\b(?i:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""),
    ("key", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"),
    ("endpoint", r"""https?://[^\x20\x09-\x0D"'<>]+"""),
]
ORDER = ["assign", "access", "hex", "account", "key", "endpoint"]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "key": "secret", "endpoint": "endpoint"}
SPAN = "array<struct<start:int,nth:int,kind:string,end:int>>"


def spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches of pattern, leftmost and not overlapping, as SPAN.

    The pieces between the matches and the matches take turns in the text, so
    running sums of their lengths give the positions: first within RUN matches,
    then over the runs, so that no long array is copied for each match.
    """
    nothing, zero = F.expr(f"cast(array() as {SPAN})"), F.lit(0)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    long_enough = (lambda x: F.length(F.regexp_extract(x, ASSIGN_VALUE, 1)) >= 12) if kind == "assign" else (lambda x: F.lit(True))
    both = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), F.transform(hits, lambda x: F.struct(F.length(x).alias("n"), long_enough(x).alias("ok"))).alias("hit"))
    span = lambda start, end: F.struct(start.alias("start"), F.lit(ORDER.index(kind)).alias("nth"), F.lit(kind).alias("kind"), end.alias("end"))

    def within(run: Column) -> Column:
        def add(s: Column, x: Column) -> Column:
            start, end = s["at"] + x["gap"], s["at"] + x["gap"] + x["hit"]["n"]
            return F.struct(end.alias("at"), F.when(x["hit"]["ok"], F.concat(s["out"], F.array(span(start, end)).cast(SPAN))).otherwise(s["out"]).alias("out"))

        return F.aggregate(run, F.struct(zero.alias("at"), nothing.alias("out")), add)

    def over(every: Column) -> Column:  # every is a lambda's variable, so that the text is searched once
        runs = F.transform(F.sequence(zero, F.floor((F.size(every) - 1) / RUN).cast("int")), lambda k: within(F.slice(every, k * RUN + 1, F.lit(RUN))))
        moved = lambda s, r: F.transform(r["out"], lambda x: span(x["start"] + s["at"], x["end"] + s["at"])).cast(SPAN)
        return F.aggregate(runs, F.struct(zero.alias("at"), nothing.alias("out")), lambda s, r: F.struct((s["at"] + r["at"]).alias("at"), F.concat(s["out"], moved(s, r)).alias("out")))["out"]

    found = F.get(F.transform(F.array(F.filter(both, lambda x: x["hit"].isNotNull())), over), F.lit(0))
    return F.when(text.rlike(pattern), found).otherwise(nothing)


def written(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def role(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv)), kind)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, linked) for each row: base spans, and weak spans whose complement lies within scope."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *(spans(F.col("text"), k, p).alias(k) for k, p in BASE + WEAK))
    rows = rows.select("doc_id", "text", F.concat(*(F.col(k) for k, _ in BASE)).alias("base"), F.concat(*(F.col(k) for k, _ in WEAK)).alias("weak"))
    rows = rows.select("doc_id", "text", "base", F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))).alias("weak"))
    parts = F.concat("base", "weak")
    could = (F.size("weak") > 0) & F.exists(parts, lambda x: role(x["kind"]) == "secret") & F.exists(parts, lambda x: role(x["kind"]) == "identifier")
    rows = cut(rows.select("doc_id", "base", F.when(could, F.sha2("text", 256)).alias("of"), F.when(could, F.col("weak")).alias("weak")))
    texts = rows.where("of is not null").groupBy("of").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    part = texts.select("of", F.explode(F.concat("base", "weak")).alias("p")).select("of", "p.*", role(F.col("p.kind")).alias("role"))
    part = cut(part)
    bucket = lambda c: F.floor(c / scope)
    asks = part.where(F.col("nth") >= len(BASE)).select("of", F.struct("start", "nth", "kind", "end").alias("p"), "role", F.explode(F.sequence(bucket(F.col("start") - scope), bucket(F.col("end") + scope))).alias("bucket"))
    # a long part stands in each bucket that it covers
    gives = part.select("of", F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("other"), F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("bucket")).where("other <> 'endpoint'")
    met = asks.join(gives, ["of", "bucket"]).where((F.col("role") != F.col("other")) & (F.col("s") - F.col("p.end") <= scope) & (F.col("p.start") - F.col("e") <= scope))
    met = met.groupBy("of", "p", "role").agg(F.max(F.col("other") == "identifier").alias("i"), F.max(F.col("other") == "secret").alias("s"))
    linked = met.where(F.when(F.col("role") == "identifier", F.col("s")).when(F.col("role") == "secret", F.col("i")).otherwise(F.col("s") & F.col("i")))
    linked = cut(linked.groupBy("of").agg(F.collect_list("p").alias("linked")))
    return rows.join(linked, "of", "left").select("doc_id", "base", F.coalesce(F.col("linked").cast(SPAN), F.expr(f"cast(array() as {SPAN})")).alias("linked"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k, _ in BASE), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked")
    )
