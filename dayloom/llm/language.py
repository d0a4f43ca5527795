"""Language ID by prediction by partial matching (PPM, escape method C).

Each language has a context tree over bytes, of order ORDER, with the counts of
its training sample, which stay frozen while texts are scored. The cost of a
byte is -log2 of its PPM probability with full exclusion: the counts of the
longest context, then escapes to shorter ones, at last all byte values alike.
As the statistics are frozen, the cost of every byte in every context is worked
out once, in a table; a text's code length under a language is a sum of table
entries, and the language with the shortest code is predicted.

The sample is bounded: of each language the distinct texts in the order of their
hash, until they have TRAIN_BYTES bytes; one at least. Contexts seen fewer than
SEEN times over all languages are left out of the trees.

Ties go to the language that comes first by code point. A very long text is
scored whole; empty input gives no rows. The table that is broadcast has 4 bytes
for each context, byte value of the sample and language: it is bounded by the
sample, and grows with the number of languages, not with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import carried, cut, released, small_batches, table
from .words import slices, utf8

ORDER = 3
TRAIN_BYTES = 500_000
SEEN = 3
HASH_BUCKETS = 4096
UNKNOWN = "und"
FAR, TELLING = 1.5, 100


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def padded(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """symbols with ORDER zeros before each text, and the places of the symbols."""
    at = np.arange(len(symbols)) + ORDER * np.repeat(np.arange(1, len(ends)), np.diff(ends))
    out = np.zeros(len(symbols) + ORDER * (len(ends) - 1), np.int32)
    out[at] = symbols
    return out, at


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of each byte with the ORDER bytes before it; digits of base 257, a byte b is b + 1, 0 stands before the text."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, ends = utf8(batch.column(1))
            seq, at = padded(data.astype(np.int32) + 1, ends)
            gram = np.zeros(len(at), np.int64)
            for k in range(ORDER, -1, -1):
                gram = gram * 257 + seq[at - k]
            of = np.repeat(langs, np.diff(ends))
            for lang in dict.fromkeys(langs):
                g, n = np.unique(gram[of == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Costs of all bytes in all contexts under each language."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        digits = np.stack([gram // 257**k % 257 for k in range(ORDER, -1, -1)], axis=1)
        used = np.unique(digits)
        self.langs, self.symbol = langs, np.zeros(257, np.int32)
        used = used[used > 0]
        self.symbol[used] = np.arange(1, len(used) + 1)
        a = self.size = len(used) + 1  # symbol 0: before the text, or a byte that no sample has
        digits = self.symbol[digits]
        context = [np.zeros(len(gram), np.int64)]  # of length 0, 1, ...
        for k in range(1, ORDER + 1):
            context.append(digits[:, ORDER - k] * a ** (k - 1) + context[-1])
        nodes, first = [], [0]
        for k in range(ORDER + 1):
            c, total = np.unique(context[k], return_inverse=True)
            c = c[(np.bincount(total, weights=n) >= SEEN) | (k == 0)]
            nodes.append(c)
            first.append(first[-1] + len(c))
        self.node = np.zeros(a**ORDER, np.int32)  # of the longest context that the tree has
        for k in range(ORDER + 1):
            every = np.arange(a ** (ORDER - k)) * a**k
            self.node[(every[:, None] + nodes[k][None, :]).ravel()] = np.tile(np.arange(first[k], first[k + 1]), len(every))
        self.cost = np.zeros((first[-1] * a, len(langs)), np.float32)
        for j in range(len(langs)):
            mine = lang == j
            counts = []
            for k in range(ORDER + 1):
                at = np.searchsorted(nodes[k], context[k][mine])
                ok = (at < len(nodes[k])) & (nodes[k][np.minimum(at, len(nodes[k]) - 1)] == context[k][mine]) if len(nodes[k]) else np.zeros(mine.sum(), bool)
                counts.append(np.bincount(at[ok] * a + digits[mine][ok, ORDER], weights=n[mine][ok], minlength=len(nodes[k]) * a).reshape(-1, a))
            for k in range(ORDER + 1):
                p, left, out = np.zeros((len(nodes[k]), a)), np.ones((len(nodes[k]), 1)), np.zeros((len(nodes[k]), a), bool)
                for s in range(k, -1, -1):  # the suffix of length s of each context; a suffix is seen as often at least, so it's in the tree
                    c = counts[s][np.searchsorted(nodes[s], nodes[k] % a**s)] * ~out
                    total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
                    scale = np.maximum(total + kinds, 1)
                    p += left * c / scale
                    left = np.where(total > 0, left * kinds / scale, left)
                    out |= c > 0
                p += left * ~out / (256 - out.sum(axis=1, keepdims=True))
                self.cost[first[k] * a : first[k + 1] * a, j] = -np.log2(p).ravel()

    def code_lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(texts, languages) bits."""
        out = np.zeros((len(ends) - 1, len(self.langs)))
        if not len(data):
            return out
        a = self.size
        seq, at = padded(self.symbol[1:][data], ends)
        context = np.zeros(len(seq), np.int32)
        for k in range(1, ORDER + 1):
            context[k:] += seq[:-k] * np.int32(a ** (k - 1))
        cost = self.cost[self.node[context[at]] * np.int64(a) + seq[at]]
        some = np.flatnonzero(np.diff(ends) > 0)
        out[some] = np.add.reduceat(cost, ends[some], axis=0, dtype=np.float64)
        return out


def sample(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(lang, h, text): the distinct texts to learn from, in order of a hash until a language has train_bytes; at least one of each language.

    A histogram over HASH_BUCKETS finds the bucket in which a language gets
    full, so that only texts up to that bucket are put in order.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null and text <> ''").withColumn("h", F.xxhash64("text"))
    bucket = F.pmod("h", F.lit(HASH_BUCKETS))
    texts = cut(rows.groupBy("lang", "h").agg(F.max(F.octet_length("text")).cast("long").alias("size")).withColumn("bucket", bucket))
    before = F.sum("size").over(W.partitionBy("lang").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    open_ = texts.groupBy("lang", "bucket").agg(F.sum("size").alias("size")).withColumn("before", before).where(F.col("before") < train_bytes).select("lang", "bucket")
    first = F.sum("size").over(W.partitionBy("lang").orderBy("bucket", "h").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    chosen = texts.join(F.broadcast(open_), ["lang", "bucket"]).withColumn("first", first).where(F.col("first") < train_bytes).select("lang", "h")
    return cut(rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")))


def learned(texts: DataFrame) -> ContextTrees | None:
    """Trees from (lang, text) rows; None if there is none. The driver gets the counts alone."""
    counts = gram_counts(texts).toArrow()
    if not counts.num_rows:
        return None
    names = counts.column("lang").to_pylist()
    langs = sorted(set(names))
    nth = {x: i for i, x in enumerate(langs)}
    return ContextTrees(langs, np.array([nth[x] for x in names]), counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def train(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> ContextTrees | None:
    """Trees from the sample of (text, lang) rows with a language; None if there is none."""
    return learned(sample(docs, train_bytes))


def identify(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """docs with lang_pred, score (posterior of that language under equal priors) and bits (code length for each byte).

    lang_pred is UNKNOWN, score 0 and bits null if the text is null or has no
    letter, or if nothing could be learned. Every row gives one row.
    """
    small_batches(docs.sparkSession)
    docs = carried(docs, "text").withColumn("text", F.col("text").cast("string"))
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    new = ("lang_pred", "score", "bits")
    if trees is None:
        return released(docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits": F.lit(None).cast("double")}), *new)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double, bits double")
    def score(texts):
        import pandas as pd

        model = shared.value
        out = []
        batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(texts, type=pa.string())], names=["text"])
        for part in slices(batch, "text", 1_000_000):
            data, ends = utf8(part.column(0))
            bits = model.code_lengths(data, ends)
            best = bits.argmin(axis=1)
            low = bits[np.arange(len(best)), best]
            weight = np.exp2(np.maximum(low[:, None] - bits, -1000))
            out.append(pd.DataFrame({"lang_pred": np.array(model.langs, object)[best], "score": 1 / weight.sum(axis=1), "bits": low / np.maximum(np.diff(ends), 1)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": pd.Series([], dtype=object), "score": pd.Series([], dtype=float), "bits": pd.Series([], dtype=float)})

    seen = docs.select("_doc", known.alias("known"), score(F.when(known, F.col("text")).otherwise("")).alias("told"))
    told = lambda c, other: F.when(F.col("known"), F.col(f"told.{c}")).otherwise(other)
    return released(seen.withColumns({"lang_pred": told("lang_pred", UNKNOWN), "score": told("score", 0.0), "bits": told("bits", None)}), *new)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train(docs.where(~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return identify(docs.select("doc_id", "text"), trees).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")


def far_bits(texts: DataFrame) -> float | None:
    """Code length a byte beyond which a text is in none of the languages: FAR times the longest of the sample's texts under the trees of the other half of the sample, 8 (plain bytes) at least. None if a half is empty, as nothing tells then.

    Only texts of TELLING bytes count, as the first bytes cost most.
    """
    half = [texts.where(F.pmod("h", F.lit(2)) == k) for k in (0, 1)]
    worst = []
    for mine, other in (half, half[::-1]):
        trees = learned(mine)
        found = identify(other.where(F.octet_length("text") >= TELLING), trees).agg(F.max("bits")).first()[0] if trees else None
        if found is None:
            return None
        worst.append(found)
    return max(8.0, FAR * max(worst))


def known_language(docs: DataFrame) -> DataFrame:
    """The documents whose text is in a language that can be told.

    Those that have no letter go, and those of TELLING bytes or more whose code
    length under all trees is far above that of the texts learned from. If
    nothing could be learned, all that have a letter stay. Every labelled
    language is learned: nothing is held out, as nothing is evaluated here.
    """
    texts = sample(docs)
    trees = learned(texts)
    limit = far_bits(texts) if trees else None
    if limit is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    told = identify(carried(docs, "text"), trees).where((F.col("lang_pred") != UNKNOWN) & ((F.col("bits") <= limit) | (F.octet_length("text") < TELLING)))
    return released(told)
