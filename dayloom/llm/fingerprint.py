"""Document fingerprints by a homomorphic multiset hash.

A fingerprint is a sum of vectors, lane by lane, modulo a power of two, so it
doesn't depend on the order of what is summed, and paragraphs are inserted and
deleted by adding and subtracting their vectors (Fingerprint).

* dense: each non-empty paragraph (line) adds a vector of DENSE lanes modulo
  2^32 drawn from its hash; equal multisets of paragraphs have equal sums.
* sparse: each paragraph adds a vector of LEVELS * SPARSE lanes modulo 2^8, the
  sum of what its pieces add: a piece adds one value to one lane, at LEVELS levels
  of which each keeps an eighth of the pieces before. Pieces are runs of words
  that end at a word whose hash says so, so they follow the content.

A fingerprint is both parts in a row, as bytes. Texts that share pieces agree in
lanes: likeness() reads two fingerprints, and is the share of equal lanes among
those in use, at the first level that isn't crowded; 1 for equal dense parts.

A null text is empty. Documents are ordered by descending doc_id, nulls last,
equal ids and nulls by the hash of their text; the first follows the last, and a
lone document follows itself. Every row gives one row, repeated ones as well;
empty input gives none. A very long text is read whole, and one whose levels are
all crowded is judged by the last.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, table
from .words import U, mix, powers, slices, utf8, word_hashes

DENSE, SPARSE, LEVELS, PIECE = 32, 128, 5, 8
DENSE_BYTES = 4 * DENSE


class Fingerprint:
    """The fingerprint of a multiset of paragraphs, to be kept up to date."""

    def __init__(self, paragraphs=()):
        self.dense, self.sparse = np.zeros(DENSE, np.uint32), np.zeros(LEVELS * SPARSE, np.uint8)
        for p in paragraphs:
            self.insert(p)

    def _sum(self, paragraph: str) -> tuple[np.ndarray, np.ndarray]:
        one = fingerprints(pa.array([paragraph], pa.string()))[0]
        return one[:DENSE_BYTES].view(np.uint32), one[DENSE_BYTES:]

    def insert(self, paragraph: str) -> None:
        dense, sparse = self._sum(paragraph)
        self.dense, self.sparse = self.dense + dense, self.sparse + sparse

    def delete(self, paragraph: str) -> None:
        dense, sparse = self._sum(paragraph)
        self.dense, self.sparse = self.dense - dense, self.sparse - sparse

    def hex(self) -> str:
        return self.dense.tobytes().hex() + self.sparse.tobytes().hex()


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprints of n texts, a row of bytes for each."""
    data, ends = utf8(texts)
    n, raw = len(texts), data.tobytes()
    seeds, of = [], []
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        found = [blake2b(x, digest_size=16).digest() for x in raw[a:b].split(b"\n") if x]
        seeds += found
        of += [i] * len(found)
    dense = np.zeros((n, DENSE), np.uint32)
    of = np.array(of, np.int64)
    if len(of):
        seed = np.frombuffer(b"".join(seeds), U).reshape(-1, 2)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        for lane in range(DENSE):
            value = (mix(seed[:, 0] + seed[:, 1] * U(2 * lane + 1)) >> U(32)).astype(np.uint32)
            dense[of[first], lane] = np.add.reduceat(value, first, dtype=np.uint32)
    return np.concatenate([dense.view(np.uint8), sparse_sums(data, ends).reshape(n, -1)], axis=1)


def sparse_sums(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(ends) - 1
    lines = np.flatnonzero(data == 10) + 1
    cuts = np.unique(np.concatenate([ends, lines]))
    words, at = word_hashes(data, cuts)  # paragraph by paragraph
    out = np.zeros((n, LEVELS, SPARSE), np.uint8)
    if not len(words):
        return out
    stop = mix(words) % U(PIECE) == 0
    stop[at[1:][np.diff(at) > 0] - 1] = True
    end = np.flatnonzero(stop) + 1
    start = np.append(0, end[:-1])
    base = U(0xA0761D6478BD642F)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(base, len(words)), out=total[1:])
    piece = mix((total[end] - total[start]) * powers(U(pow(int(base), -1, 1 << 64)), len(words) + 1)[start] + (end - start).astype(U))
    text = np.searchsorted(ends, cuts[np.searchsorted(at, start, "right") - 1], "right") - 1
    value = ((piece & U(0xFF)) | U(1)).astype(np.float64)
    lane = ((piece >> U(20)) % U(SPARSE)).astype(np.int64)
    for level in range(LEVELS):
        on = (piece >> U(40)) % U(8**level) == 0
        sums = np.bincount(text[on] * SPARSE + lane[on], weights=value[on], minlength=n * SPARSE)
        out[:, level] = (sums.astype(np.int64) & 0xFF).astype(np.uint8).reshape(n, SPARSE)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of fingerprints (rows of a and b)."""
    p, q = (x[:, DENSE_BYTES:].reshape(-1, LEVELS, SPARSE) for x in (a, b))
    used = (p != 0) | (q != 0)
    fits = used.sum(axis=2) <= SPARSE * 3 // 5
    level = np.where(fits.any(axis=1), fits.argmax(axis=1), LEVELS - 1)
    row = np.arange(len(p))
    one, two, on = p[row, level], q[row, level], used[row, level]
    same = ((one == two) & on).sum(axis=1) / np.maximum(on.sum(axis=1), 1)
    return np.where((a[:, :DENSE_BYTES] == b[:, :DENSE_BYTES]).all(axis=1), 1.0, same)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """OUT for each document: its fingerprint, that of its edited text, and how like they are to each other and to the next document's.

    Documents are dealt by ranges of doc_id, in one shuffle. The head of each
    range goes to the range before as well, as that range's last neighbour.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie, last = F.xxhash64("text"), F.col("doc_id").isNull()
    key = F.when(last, tie).otherwise(F.bitwise_not("doc_id"))  # ascending is the order
    ranges = 4 * partitions(spark)
    bounds = {r["last"]: np.unique(np.array(r["b"], np.int64)) for r in rows.groupBy(last.alias("last")).agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 20 * ranges).alias("b")).collect()}
    known, unknown = bounds.get(False, np.zeros(0, np.int64)), bounds.get(True, np.zeros(0, np.int64))

    def range_of(lasts: pd.Series, keys: pd.Series) -> np.ndarray:
        lasts, keys = lasts.to_numpy(), keys.to_numpy()
        return np.where(lasts, len(known) + 1 + np.searchsorted(unknown, keys), np.searchsorted(known, keys))

    @F.pandas_udf("int")
    def placed(lasts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(range_of(lasts, keys).astype(np.int32))

    heads = {r["g"]: r["head"] for r in rows.select(placed(last, key).alias("g"), key.alias("key")).groupBy("g").agg(F.min("key").alias("head")).collect()}  # one row a range
    order = sorted(heads)
    head_of, before_of = np.zeros(len(known) + len(unknown) + 2, np.int64), np.zeros(len(known) + len(unknown) + 2, np.int64)
    for i, g in enumerate(order):  # the first range's head goes to the last range
        head_of[g], before_of[g] = heads[g], order[i - 1]

    @F.pandas_udf("array<int>")
    def dealt(lasts: pd.Series, keys: pd.Series) -> pd.Series:
        g = range_of(lasts, keys)
        return pd.Series([[2 * a, 2 * b + 1] if h else [2 * a] for a, b, h in zip(g.tolist(), before_of[g].tolist(), (head_of[g] == keys.to_numpy()).tolist(), strict=True)])

    sent = rows.select("doc_id", "text", F.explode(dealt(last, key)).alias("to"), key.alias("key"), tie.alias("tie"))
    sent = sent.select("doc_id", "text", F.shiftright("to", 1).alias("range"), (F.col("to") % 2).alias("guest"), "key", "tie")
    laid = sent.repartition(partitions(spark), "range").sortWithinPartitions("range", "guest", "key", "tie").select("doc_id", "text", "range", "guest")

    def run(batches):
        held = None  # the last document of what came before
        for batch in batches:
            for part in slices(batch, "text"):
                part = pa.Table.from_batches([part])
                if held is not None:
                    part = pa.concat_tables([held, part])
                part = part.combine_chunks()
                rng, guest, texts = part["range"].to_numpy(), part["guest"].to_numpy(), part["text"].to_pylist()
                held = part.slice(len(texts) - 1)
                own = np.flatnonzero((guest[:-1] == 0) & (rng[:-1] == rng[1:]))
                if not len(own):
                    continue
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own.tolist()]
                every = fingerprints(part["text"].chunk(0))
                other, mine = fingerprints(pa.array(edited, pa.large_string())), every[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"].chunk(0).take(pa.array(own)),
                        pa.array([len(texts[i]) for i in own.tolist()], pa.int64()),
                        pa.array([sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                        pa.array([x.tobytes().hex() for x in mine], pa.string()),
                        pa.array([x.tobytes().hex() for x in other], pa.string()),
                        pa.array(likeness(mine, other)),
                        pa.array(likeness(mine, every[own + 1])),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return laid.mapInArrow(run, OUT)


def op6_multiset_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
