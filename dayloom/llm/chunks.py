"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text: h = 2 h + g[byte] in 32 bits,
so that h depends on the last 32 bytes. A chunk ends where the top BITS bits
are zero, at MAX bytes at the latest, never before MIN bytes and never inside a
character; a rest of fewer than MIN bytes belongs to the chunk before. So chunks
are long enough not to repeat by chance. Boundaries follow the content, so an insertion moves only the chunks
around it. As the least length makes a boundary depend on the one before, a
passage of a few chunks may be cut in two ways; local_maxima() gives boundaries
that depend on RADIUS bytes around them alone. A chunk whose digest (BLAKE2b, 128 bits) occurs earlier - in a
document with a smaller doc_id, or earlier in its own - is a repeat.

op10 takes passages(): chunks that begin at close local maxima and go on for
WORDS words at least, over the next ones. So they overlap, a passage of twice as
many words holds one nearly for certain, wherever it stands, and a line that
many documents have is no repeat as long as it has fewer words. n_repeated_chunks
are those of earlier documents, n_own_repeats those that occur earlier in their
own document alone; both are removed.

Null and empty texts have no chunks, a very long one has many; empty input gives
no rows. Rows of one doc_id and text count as one document and get the same
result; a null doc_id sorts after all others. Ties, texts of one doc_id, go by a
hash of the text.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import carried, cut, released, small_batches, table
from .words import mix, slices, utf8

BITS, MIN, MAX, WINDOW = 6, 64, 1024, 32
#: For local maxima: bytes to either side, and those that are hashed.
RADIUS, HASHED = 72, 16
#: For passages: bytes to either side of where one may begin, words of one, and bytes that do for text without spaces.
CLOSE, WORDS, BYTES = 32, 28, 400
GEAR = (mix(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The rolling hash of the last window bytes after each byte; the hash of 2 w bytes comes from two hashes of w bytes."""
    h, w = GEAR[data], 1
    while w < window:
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
        w *= 2
    return h


def boundaries(data: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For each text the ends of its chunks, counted from its start."""
    starts_char = (data & 0xC0) != 0x80
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        cuts, last = [], 0
        if b > a:
            may = (np.flatnonzero(gear_hash(data[a:b]) >> np.uint32(32 - BITS) == 0) + 1).tolist()
            for p in [*may, b - a]:
                while p - last > MAX:  # no boundary for too long
                    q = last + MAX
                    while not starts_char[a + q]:
                        q -= 1
                    cuts.append(q)
                    last = q
                while p < b - a and not starts_char[a + p]:
                    p += 1
                if p - last >= MIN or p == b - a and not cuts:
                    cuts.append(p)
                    last = p
                elif p == b - a and p > last:  # a short rest belongs to the chunk before
                    cuts[-1] = p
        out.append(cuts)
    return out


def local_maxima(data: np.ndarray, ends: np.ndarray, radius: int = RADIUS, ties: bool = False) -> list[list[int]]:
    """As boundaries: a chunk ends where the mixed hash is above those of radius bytes before and not below those of radius bytes after, at MAX bytes at the latest, and never inside a character.

    ties: also where it equals the largest before, more than radius bytes after the last end. A word that
    is said over and over has no other ends, and wherever they fall, what follows is the same.
    """
    starts_char = (data & 0xC0) != 0x80
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        cuts, last, may = [], 0, []
        if b - a > 2 * radius:
            h = gear_hash(data[a:b], HASHED) * np.uint32(2654435769)
            top, w = h, 1  # the largest of w hashes from each on
            while w < radius:
                step = min(w, radius - w)
                top, w = np.maximum(top[:-step], top[step:]), w + step
            here = h[radius:-radius]
            before, high = top[: len(here)], here >= top[radius + 1 :]
            may = (np.flatnonzero((here > before) & high) + radius + 1).tolist()
            if ties and len(more := np.flatnonzero((here == before) & high)):
                strict, may, more = set(may), [], (more + radius + 1).tolist()
                for p in sorted(strict.union(more)):
                    if p in strict or p - (may[-1] if may else 0) > radius:
                        may.append(p)
        for p in [*may, b - a] if b > a else []:
            while p < b - a and not starts_char[a + p]:
                p += 1
            while p - last > MAX:
                q = last + MAX
                while not starts_char[a + q]:
                    q -= 1
                cuts.append(q)
                last = q
            if p > last:
                cuts.append(p)
                last = p
        out.append(cuts)
    return out


def passages(data: np.ndarray, ends: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each text spans that overlap: from each local maximum over WORDS words (or BYTES bytes, if that is less), and to the next maximum at least.

    The last span is that of the last WORDS words, so that all bytes are in one; a text of fewer words is one span.
    """
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts_char = (data & 0xC0) != 0x80
    out = []
    for a, b, cuts in zip(ends[:-1].tolist(), ends[1:].tolist(), local_maxima(data, ends, CLOSE, ties=True), strict=True):
        n, gap = b - a, blank[a:b]
        begin, end = np.flatnonzero(~gap & np.r_[True, gap[:-1]]), np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
        last = max(int(begin[-WORDS]) if len(begin) > WORDS else 0, n - BYTES, 0)
        while last and not starts_char[a + last]:
            last -= 1
        at = np.array([0, *cuts[:-1]], np.int64)
        at = at[at < last]
        word = np.searchsorted(end, at, side="right") + WORDS - 1  # of the words that end after a start, the last that counts
        to = np.minimum(np.append(end, n)[np.minimum(word, len(end))], at + BYTES)
        to = np.maximum(to, np.array(cuts[: len(at)], np.int64))
        inside = (to < n) & ~np.append(starts_char[a:b], True)[np.minimum(to, n)]
        while inside.any():
            to = to + inside
            inside = (to < n) & ~np.append(starts_char[a:b], True)[np.minimum(to, n)]
        out.append([*zip(at.tolist(), to.tolist(), strict=True), (last, n)] if n else [])
    return out


CHUNK = "doc_id long, text_hash long, start long, bytes int, digest binary"


def chunk(docs: DataFrame, at=boundaries) -> DataFrame:
    """A row CHUNK for each chunk of each document; at: boundaries, local_maxima or passages."""
    spans = passages if at is passages else lambda data, ends: [list(zip([0, *cuts], cuts, strict=False)) for cuts in at(data, ends)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                data, ends = utf8(part.column(2))
                raw, row, start, size, digest = data.tobytes(), [], [], [], []
                for i, found in enumerate(spans(data, ends)):
                    a = int(ends[i])
                    for p, q in found:
                        digest.append(blake2b(raw[a + p : a + q], digest_size=16).digest())
                        start.append(p)
                        size.append(q - p)
                    row += [i] * len(found)
                of = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(of), part.column(1).take(of), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(digest, pa.binary())], names=["doc_id", "text_hash", "start", "bytes", "digest"]
                )

    return identified(docs).where("text is not null").select("doc_id", "text_hash", "text").mapInArrow(run, CHUNK)


def identified(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).withColumn("text_hash", F.xxhash64("text"))


def repeats(docs: DataFrame, at=boundaries) -> DataFrame:
    """(doc_id, text_hash, n_chunks, n_bytes, n_repeated, n_across, spans): for each document with chunks its repeated chunks, as byte spans (start, end); those that overlap are one. n_across of the n_repeated are in an earlier document, the others only earlier in their own."""
    chunks = cut(chunk(docs, at).withColumn("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1))))
    place = F.struct("doc_id", "text_hash", "start")
    first = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    found = chunks.join(cut(first), "digest").where(place > F.col("first")).select("doc_id", "text_hash", "start", (F.col("start") + F.col("bytes")).alias("end"), ((F.col("doc_id") != F.col("first.doc_id")) | (F.col("text_hash") != F.col("first.text_hash"))).alias("_across"))
    w = W.partitionBy("doc_id", "text_hash").orderBy("start")
    apart = F.coalesce(F.col("start") >= F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    found = found.distinct().withColumn("_apart", apart.cast("int")).withColumn("_nth", F.sum("_apart").over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = found.groupBy("doc_id", "text_hash", "_nth").agg(F.count("*").alias("n"), F.count_if("_across").alias("m"), F.min("start").alias("start"), F.max("end").alias("end"))
    spans = cut(found.groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n_repeated"), F.sum("m").alias("n_across"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))
    sizes = chunks.dropDuplicates(["doc_id", "text_hash", "start"]).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_chunks"), F.max(F.col("start") + F.col("bytes")).alias("n_bytes"))
    out = sizes.join(spans, ["doc_id", "text_hash"], "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:long,end:long>>)")))
    return out.withColumn("doc_id", F.when(F.col("doc_id") < 2**63 - 1, F.col("doc_id")))


def without_repeats(docs: DataFrame, at=boundaries) -> DataFrame:
    """docs with n_chunks, n_repeated, n_across, n_bytes, spans (of the repeated chunks) and kept (the text without them)."""
    small_batches(docs.sparkSession)
    found = cut(repeats(docs, at)).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    rows = identified(carried(docs, "doc_id", "text"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").withColumn("raw", F.encode("text", "UTF-8"))
    both = both.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:long,end:long>>)")))
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda x: x["end"]))
    parts = F.transform(edges, lambda e, i: F.decode(F.substring("raw", (e + 1).cast("int"), (F.coalesce(F.get(F.col("spans"), i)["start"], F.col("n_bytes")) - e).cast("int")), "UTF-8"))
    kept = F.when(F.size("spans") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(parts, ""))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return released(both.withColumns({"kept": kept} | {c: zero(c) for c in ("n_chunks", "n_repeated", "n_across", "n_bytes")}), "n_chunks", "n_repeated", "n_across", "n_bytes", "spans", "kept")


def op10_content_defined_chunks(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passages)
    return out.select(
        "doc_id", "n_chunks", F.col("n_across").alias("n_repeated_chunks"), (F.col("n_repeated") - F.col("n_across")).alias("n_own_repeats"), "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )
