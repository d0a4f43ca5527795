"""Codes for vectors by product quantisation, entries found with LAESA pivots.

Each component x counts as the integer floor(1024 x). A vector is cut into PARTS
equal parts, and each part position has a codebook of ENTRIES entries, first the
parts of the smallest vec_ids, then moved ROUNDS times to the floored mean of
the parts that are nearest to them. A code names the nearest entry of each part.

LAESA: each position has PIVOTS fixed points, taken from its first entries, each
as far from those before as can be. The distances of all parts to the pivots are
worked out once and written. A round works out the distances of the entries to
the pivots; by the triangle inequality the difference of two such distances is a
lower bound of the distance between part and entry. Entries are evaluated, in
integers, in the order of their bounds, until the next bound is above the best
distance found. So the result is that of comparing all with all.

Vectors stay where they are; a round moves one row for each entry's component a
task. What the driver gathers and sends out is the codebooks and pivots, bounded
by ENTRIES times the number of components.

Rows go whose vector is null or has a null or non-finite component. Of equal
vec_ids all rows count, ordered by their vectors; null vec_ids come last. Fewer
rows than ENTRIES make smaller codebooks. A vector that isn't as long as the
first one, or has no PARTS equal parts, stays, with a null code and error. Very
large components are taken exactly; an error beyond a long is null and counts
nothing in label_error. An empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import cut, small_batches, table

PARTS, ENTRIES, ROUNDS, PIVOTS = 4, 256, 4, 8
SCALE = 1024
#: More than the rounding of a distance that is the root of a 63-bit integer.
SLACK = 1e-5
LIMB = 40
LONG = (1 << 63) - 1


def narrow(part_size: int) -> int:
    """Integers below this have squared distances that fit 63 bits."""
    return 1 << (61 - (max(part_size, 1) - 1).bit_length()) // 2


def integers(x: np.ndarray, limit: int) -> np.ndarray:
    """floor(SCALE * x), as 64-bit integers if all are below limit, else as Python's."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() * SCALE < limit - 1:
        return np.floor(x * SCALE).astype(np.int64)
    whole = [int(v) * SCALE if abs(v) >= 2**53 else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(x.shape)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    if x.dtype == object or y.dtype == object:
        return ((x.astype(object)[:, None, :] - y.astype(object)[None, :, :]) ** 2).sum(axis=2).astype(object).reshape(len(x), len(y))
    return ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)


def pivots_of(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """n rows of entries, the first and then always the one that is farthest from those taken."""
    taken = [0]
    far = squared(entries, entries[:1])[:, 0]
    while len(taken) < min(n, len(entries)):
        taken.append(int(far.argmax()))
        far = np.minimum(far, squared(entries, entries[taken[-1] :][:1])[:, 0])
    return entries[taken]


def nearest(x: np.ndarray, near: np.ndarray, entries: np.ndarray, entry_near: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x its nearest entry (ties to the lower index), the squared distance, and how many distances were evaluated in all.

    near, entry_near: distances to the pivots.
    """
    n, m = len(x), len(entries)
    low = np.zeros((n, m))
    for p in range(near.shape[1]):
        np.maximum(low, np.abs(near[:, p, None] - entry_near[None, :, p]), out=low)
    low -= SLACK
    best, who = np.full(n, LONG, np.int64), np.full(n, m, np.int64)
    open_, take, done = np.arange(n), 4, 0
    while len(open_):
        bounds = low[open_]
        k = min(take, m)
        at = np.argpartition(bounds, k - 1, axis=1)[:, :k]
        d = ((x[open_][:, None, :] - entries[at]) ** 2).sum(axis=2)
        done += int(np.isfinite(np.take_along_axis(bounds, at, axis=1)).sum())
        least = d.min(axis=1)
        first = np.where(d == least[:, None], at, m).min(axis=1)
        better = (least < best[open_]) | (least == best[open_]) & (first < who[open_])
        best[open_[better]], who[open_[better]] = least[better], first[better]
        np.put_along_axis(bounds, at, np.inf, axis=1)
        low[open_] = bounds
        open_ = open_[bounds.min(axis=1) <= np.sqrt(best[open_].astype(np.float64))]
        take *= 4
    return who, best, done


class Codebooks:
    """The entries of each part position, with the fixed pivots and the entries' distances to them."""

    def __init__(self, entries: list[np.ndarray], pivots: list[np.ndarray] | None = None):
        self.entries = entries
        self.pivots = pivots or [pivots_of(e) for e in entries]
        self.wide = [e.dtype == object or p.dtype == object for e, p in zip(self.entries, self.pivots, strict=True)]
        self.near = [None if w else np.sqrt(squared(e, p).astype(np.float64)) for e, p, w in zip(self.entries, self.pivots, self.wide, strict=True)]

    def measured(self, x: np.ndarray, part: int) -> np.ndarray:
        """Squared distances of parts to the pivots of their position."""
        return squared(x, self.pivots[part])

    def assign(self, x: np.ndarray, near: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance of each row of x; near holds the squared distances to the pivots."""
        if x.dtype == object or self.wide[part]:
            d = squared(x, self.entries[part])
            who = np.array([min(range(d.shape[1]), key=row.__getitem__) for row in d.tolist()], np.int64)
            return who, d[np.arange(len(d)), who]
        return nearest(x, np.sqrt(near.astype(np.float64)), self.entries[part], self.near[part])[:2]

    def moved(self, sums: dict[tuple[int, int], list[int]], counts: dict[tuple[int, int], int], limit: int) -> Codebooks:
        """Each entry at the floored mean of its parts; entries without any stay."""
        out = []
        for part, old in enumerate(self.entries):
            new = [[s // counts[part, i] for s in sums[part, i]] if (part, i) in counts else old[i].tolist() for i in range(len(old))]
            fits = all(abs(v) < limit for row in new for v in row)
            a = np.empty(old.shape, np.int64 if fits else object)
            a[:] = np.array(new, a.dtype).reshape(old.shape)
            out.append(a)
        return Codebooks(out, self.pivots)

    def digest(self) -> str:
        return sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows whose vector has finite components only."""
    finite = F.forall("embedding", lambda x: F.coalesce(x.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    return vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & finite)


def rows_of(batch: pa.RecordBatch, name: str = "embedding") -> np.ndarray:
    """The vectors of a batch, all of one length, as a matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def blocks(batch: pa.RecordBatch, size: int, limit: int):
    """(row numbers, parts: a matrix for each position) of the narrow and of the wide vectors of a batch."""
    x = rows_of(batch)
    wide = (np.abs(x.astype(np.float64)) * SCALE >= limit - 1).any(axis=1) if size else np.zeros(len(x), bool)
    for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        if len(rows):
            whole = integers(x[rows], limit)
            yield rows, [whole[:, k * size : (k + 1) * size] for k in range(PARTS)]


def with_pivot_distances(vectors: DataFrame, books: Codebooks, size: int, limit: int) -> DataFrame:
    """vectors with near, the squared distances of each part to its pivots, one position after the other (null for very large components)."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            near = [None] * batch.num_rows
            for rows, parts in blocks(batch, size, limit):
                if parts[0].dtype != object and not any(shared.value.wide):
                    found = np.concatenate([shared.value.measured(x, k) for k, x in enumerate(parts)], axis=1)
                    for r, f in zip(rows.tolist(), found, strict=True):
                        near[r] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int64()))], names=[*batch.schema.names, "near"])

    return vectors.mapInArrow(run, StructType([*vectors.schema, StructField("near", ArrayType(LongType()))]))


def assigned(batch: pa.RecordBatch, books: Codebooks, size: int, limit: int):
    """(row numbers, parts, indices, squared distances) of the rows of a batch with pivot distances."""
    near = batch.column(batch.schema.get_field_index("near"))
    n = len(books.pivots[0])
    for rows, parts in blocks(batch, size, limit):
        if parts[0].dtype == object or any(books.wide):
            told = [None] * PARTS
        else:
            mine = rows_of(pa.RecordBatch.from_arrays([near.take(pa.array(rows))], names=["near"]), "near")
            told = [mine[:, k * n : (k + 1) * n] for k in range(PARTS)]
        found = [books.assign(x, d, k) for k, (x, d) in enumerate(zip(parts, told, strict=True))]
        yield rows, parts, [f[0] for f in found], [f[1] for f in found]


def entry_sums(vectors: DataFrame, books: Codebooks, size: int, limit: int) -> tuple[dict, dict]:
    """For each (position, entry) the sums of its parts' components and their number.

    A task adds up its own rows, and sends the sums in digits of LIMB bits, which
    Spark adds up in 64 bits, however many rows there are.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        sums = [np.zeros((len(e), size), object) for e in shared.value.entries]
        counts = [np.zeros(len(e), np.int64) for e in shared.value.entries]
        for batch in batches:
            for _, parts, who, _ in assigned(batch, shared.value, size, limit):
                for k in range(PARTS):
                    counts[k] += np.bincount(who[k], minlength=len(counts[k]))
                    part = np.zeros(sums[k].shape, parts[k].dtype)
                    np.add.at(part, who[k], parts[k])
                    sums[k] = sums[k] + part.astype(object)
        for k in range(PARTS):
            used = np.flatnonzero(counts[k])
            entry, at = np.repeat(used, size), np.tile(np.arange(size), len(used))
            left, limb = sums[k][used].ravel(), 0
            columns = [(used, np.full(len(used), -1), np.zeros(len(used), np.int64), counts[k][used])]
            while len(left):
                digit, left = left & ((1 << LIMB) - 1), left >> LIMB
                last = bool(np.all((left == 0) | (left == -1)))
                columns.append((entry, at, np.full(len(entry), limb), (digit + (left << LIMB) if last else digit).astype(np.int64)))
                limb += 1
                if last:
                    break
            for e, a, n, v in columns:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), k, np.int32)), pa.array(e.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(v)], names=["part", "entry", "at", "limb", "v"])

    rows = vectors.mapInArrow(run, "part int, entry int, at int, limb int, v long").groupBy("part", "entry", "at", "limb").agg(F.sum("v").alias("v")).collect()
    sums, counts = {}, {}
    for r in rows:
        key = r["part"], r["entry"]
        if r["at"] < 0:
            counts[key] = r["v"]
            sums.setdefault(key, [0] * size)
        else:
            sums.setdefault(key, [0] * size)[r["at"]] += r["v"] << (LIMB * r["limb"])
    return sums, counts


def train(vectors: DataFrame, first: Codebooks, size: int, limit: int, rounds: int = ROUNDS) -> Codebooks:
    books = first
    for _ in range(rounds):
        books = books.moved(*entry_sums(vectors, books, size, limit), limit)
    return books


def encoded(vectors: DataFrame, books: Codebooks, size: int, limit: int) -> DataFrame:
    """(vec_id, label, code, error) of vectors with pivot distances."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            for rows, _, who, d in assigned(batch, shared.value, size, limit):
                for r, *x in zip(rows.tolist(), *(w.tolist() for w in who), *(y.tolist() for y in d), strict=True):
                    code[r], total = "".join(f"{i:02x}" for i in x[:PARTS]), sum(x[PARTS:])
                    error[r] = total if total <= LONG else None
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("vec_id")), batch.column(batch.schema.get_field_index("label")), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, StructType([vectors.schema["vec_id"], vectors.schema["label"], StructField("code", StringType()), StructField("error", LongType())]))


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of the usable rows of vectors (vec_id, embedding, label), and the codebooks; None if there is no such row."""
    small_batches(vectors.sparkSession)
    kept = usable(vectors)
    first_rows = lambda df: df.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()  # noqa: E731  ENTRIES at most
    first = first_rows(kept)
    nothing = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if not first or (long := len(first[0]["embedding"])) % PARTS:
        return nothing, None
    size = long // PARTS
    limit, fits = narrow(size), F.size("embedding") == long
    if any(len(r["embedding"]) != long for r in first):
        first = first_rows(kept.where(fits))
    start = np.array([r["embedding"] for r in first], np.float64).reshape(len(first), long)
    books = Codebooks([integers(start[:, k * size : (k + 1) * size], limit) for k in range(PARTS)])
    measured = cut(with_pivot_distances(kept.where(fits), books, size, limit))
    books = train(measured, books, size, limit, rounds)
    return encoded(measured, books, size, limit).unionByName(nothing.where(~fits)), books


def op13_laesa_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = cut(coded)
    # a row a label: Spark broadcasts it while its file is small
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else sha256(b"").hexdigest()).alias("codebooks_sha256"))


def _op13_sql() -> str:
    """Every part against every entry, round by round, in exact integers."""
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, CAST((i - 1) // w AS INT) AS part, CAST((i - 1) % w AS INT) AS pos, CAST(floor(CAST(v[i] AS DOUBLE) * {SCALE}) AS BIGINT) AS x FROM (SELECT r, v, len(v) // {PARTS} AS w, unnest(range(1, len(v) + 1)) AS i FROM k))",
        f"b0 AS MATERIALIZED (SELECT part, CAST(r AS INT) AS entry, pos, x AS y FROM x WHERE r < {ENTRIES})",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT r, x.part, entry, sum((x - y) * (x - y)) AS d FROM x JOIN b{n} b ON b.part = x.part AND b.pos = x.pos GROUP BY ALL) GROUP BY ALL)")
        if n < ROUNDS:
            s, c = "sum(x.x)", "count(*)"
            steps.append(f"m{n} AS (SELECT a.part, a.entry, x.pos, ({s} - (({s} % {c}) + {c}) % {c}) // {c} AS y FROM a{n} a JOIN x ON x.r = a.r AND x.part = a.part GROUP BY ALL)")
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.y, b.y) AS y FROM b{n} b LEFT JOIN m{n} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)")
    last = f"a{ROUNDS}"
    steps.append(f"c AS (SELECT vec_id, label, k.r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM k JOIN {last} a ON a.r = k.r GROUP BY ALL)")
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256 FROM c"


OP13_SQL = _op13_sql()
