"""How the sources of a language differ in their words, by run-length columns.

A term is a maximal run of ASCII letters and characters outside ASCII; A-Z count
as a-z. A language keeps its terms that occur in at least LEAST of its
documents. A group is a source of a language, or the whole language; it gives
each kept term p = 1 + floor(SCALE (count + 1) / (N + V)), N its occurrences of
kept terms and V their number. f(p, q) = floor((p - q)^2 / q).

Between two sources f is summed over all kept terms. As f depends on the two
counts alone, terms that have the same counts in all sources are one row with
their number (most terms are rare, so there are far fewer such rows); these rows
are put in order of their counts, so that equal counts lie together, and each
source's counts are a column of runs. For a pair the borders of both columns'
runs are intersected, and f is worked out once a run and multiplied by its
length. Against the whole language f is worked out term by term.

Rows are grouped by (language, source, term) with a sum in each task first, so a
frequent term, or a source with a third of all documents, is spread; sums of
pairs are added up in each task. What is broadcast has a row a source, and the
result a row a pair of sources. Ranks up to TOP are cut in each task before rows
move.

Nulls are ''. Each row of documents is a document, repeated ones too. A source
without terms gives each kept term its p as well; a language without kept terms
has pairs of value 0. Very long texts are read whole, and an empty table gives
no rows. Everything is integer arithmetic; ties rank by item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches, table
from .words import FOLD, gathered, numbered_words

#: Bytes of a term: letters, and whatever is outside ASCII.
INSIDE = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])
LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: Cells (rows of equal counts times sources) that are laid out at once.
CELLS = 2_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term. docs: lang, source, text, none null."""
    small_batches(docs.sparkSession)

    def run(batches):
        for t in gathered(batches, "text"):
            number, words, at = numbered_words(t["text"].chunk(0), INSIDE, FOLD)
            if not len(words):
                continue
            doc = np.repeat(np.arange(t.num_rows), np.diff(at))
            in_doc, n = np.unique(doc * len(words) + number, return_counts=True)
            names = t.select(["lang", "source"]).group_by(["lang", "source"]).aggregate([])
            nth = {k: i for i, k in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist(), strict=True))}
            group = np.array([nth[k] for k in zip(t["lang"].to_pylist(), t["source"].to_pylist(), strict=True)])
            found, of = np.unique(group[in_doc // len(words)] * len(words) + in_doc % len(words), return_inverse=True)
            by = pa.array(found // len(words))
            counts = [pa.array(np.bincount(of, weights=w, minlength=len(found)).astype(np.int64)) for w in (n, None)]
            yield from pa.table({"lang": names["lang"].take(by), "source": names["source"].take(by), "term": words.cast(pa.large_string()).take(pa.array(found % len(words))).cast(pa.string()), "n": counts[0], "docs": counts[1]}).to_batches(100_000)

    rows = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, total, by): terms in enough documents of a language, with by, the (source, n) in order."""
    k = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by"))
    return k.where(F.col("docs") >= least).select("lang", "term", "total", "by")


def group_sizes(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, vocabulary, total) of each language and (lang, source, size) of each group: occurrences of kept terms."""
    found = docs.select("lang", "source").distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("total"))
    langs = found.select("lang").distinct().join(langs, "lang", "left").na.fill(0, ["vocabulary", "total"])
    sizes = kept.select("lang", F.explode("by").alias("b")).groupBy("lang", F.col("b.source").alias("source")).agg(F.sum("b.n").alias("size"))
    return langs, found.join(sizes, ["lang", "source"], "left").na.fill(0, ["size"])


def p_of(count: Column, size: Column, vocabulary: Column) -> Column:
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", whole, (size + vocabulary).cast("decimal(20,0)")) + 1


def runs(column: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.append(0, np.flatnonzero(column[1:] != column[:-1]) + 1)


def pair_sums(columns: np.ndarray, number: np.ndarray, p: list[np.ndarray]) -> list[list[int]]:
    """out[i][j]: f(p_i, p_j) summed over the rows, each as often as number says; columns holds an index into p[i] for each source i (a row) and each row of equal counts, in order."""
    before = np.append(0, np.cumsum(number))
    starts = [runs(c) for c in columns]
    out = [[0] * len(columns) for _ in columns]
    for i in range(len(columns)):
        for j in range(i):
            both = np.union1d(starts[i], starts[j])
            length = before[np.append(both[1:], columns.shape[1])] - before[both]
            x, y = p[i][columns[i, both]], p[j][columns[j, both]]
            square = (x - y) * (x - y)
            out[i][j] = int((square // y * length).sum())
            out[j][i] = int((square // x * length).sum())
    return out


def pair_values(kept: DataFrame, langs: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): every ordered pair of different sources of a language."""
    # as large as the square root of the result
    known = {}
    for r in groups.join(langs, "lang").orderBy("lang", "source").collect():
        known.setdefault(r["lang"], []).append((r["source"], r["size"] + r["vocabulary"]))
    shared = kept.sparkSession.sparkContext.broadcast(known)
    rows = kept.groupBy("lang", "by").agg(F.count("*").alias("number"))
    rows = rows.repartitionByRange(partitions(kept.sparkSession), "lang", "by").sortWithinPartitions("lang", "by")

    def summed(lang: str, by: list, number: np.ndarray, sums: dict) -> None:
        sources = shared.value[lang]
        nth = {s: i for i, (s, _) in enumerate(sources)}
        counts = np.zeros((len(sources), len(by)), np.int64)
        for k, row in enumerate(by):
            for x in row:
                counts[nth[x["source"]], k] = x["n"]
        order = np.lexsort(counts[::-1])
        counts, number = counts[:, order], number[order]
        columns, p = np.zeros(counts.shape, np.int64), []
        for i, (_, size) in enumerate(sources):
            values, columns[i] = np.unique(counts[i], return_inverse=True)
            p.append(np.array([1 + SCALE * (v + 1) // size for v in values.tolist()], np.int64))
        found = pair_sums(columns, number, p)
        have = sums.setdefault(lang, found)
        if have is not found:
            sums[lang] = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(have, found, strict=True)]

    def run(batches):
        sums: dict = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            number = batch.column(2).to_numpy()
            start = 0
            while start < len(lang):
                most = max(1, CELLS // len(shared.value[lang[start]]))
                stop = start + 1
                while stop < len(lang) and lang[stop] == lang[start] and stop - start < most:
                    stop += 1
                summed(lang[start], batch.column(1).slice(start, stop - start).to_pylist(), number[start:stop], sums)
                start = stop
        for name, found in sums.items():
            pairs = [(i, j, v) for i, row in enumerate(found) for j, v in enumerate(row) if i != j]
            i, j, v = zip(*pairs, strict=True) if pairs else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(pairs), pa.string()), pa.array([shared.value[name][x][0] for x in i], pa.string()), pa.array([shared.value[name][x][0] for x in j], pa.string()), pa.array(v, pa.int64())], names=["lang", "source", "item", "value"])

    sums = rows.mapInArrow(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    return pairs.join(sums, ["lang", "source", "item"], "left").na.fill(0, ["value"])


def term_values(kept: DataFrame, langs: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): every kept term that a source has, and gives more weight than its language does."""
    each = kept.select("lang", "term", "total", F.explode("by").alias("b")).select("lang", F.col("b.source").alias("source"), "term", F.col("b.n").alias("n"), "total")
    sizes = groups.join(langs.withColumnRenamed("total", "all"), "lang")
    each = each.join(sizes, ["lang", "source"])
    each = each.select("lang", "source", F.col("term").alias("item"), p_of(F.col("n"), F.col("size"), F.col("vocabulary")).alias("p"), p_of(F.col("total"), F.col("all"), F.col("vocabulary")).alias("q")).where("p > q")
    return each.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each source of a language against every other one (part pair) and its terms against the language (part term), the first top of those."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = cut(kept_terms(term_counts(docs), least))
    langs, groups = (cut(x) for x in group_sizes(docs, kept))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms_ = ranked(term_values(kept, langs, groups), "term").where(F.col("rank") <= top)
    return ranked(pair_values(kept, langs, groups), "pair").unionByName(terms_)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM (SELECT lang, source, r, term, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST}),
l AS MATERIALIZED (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS total FROM k GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
s AS (SELECT c.lang, c.source, CAST(sum(n) AS HUGEINT) AS size FROM c JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
x AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE} * CAST(coalesce(c.n, 0) + 1 AS HUGEINT) // (coalesce(s.size, 0) + l.v) AS p, 1 + {SCALE} * (k.total + 1) // (l.total + l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM x JOIN x y ON y.lang = x.lang AND y.term = x.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM x WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= {TOP}
"""
