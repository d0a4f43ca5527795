"""Near-duplicate documents by DartMinHash.

A text is the multiset of its five-word shingles. Each unit of weight of a
shingle is a cell on which a Poisson process throws darts, at ranks drawn from
the hash of the cell alone, so that texts which share a cell share its darts.
Each dart falls on one of COORDINATES coordinates by its hash, and the earliest
dart of each makes the signature: two signatures agree at a coordinate with a
probability equal to the weighted Jaccard similarity of the texts. Only about
COORDINATES * ln(COORDINATES) darts are looked at for a text, however long.

Bands of ROWS coordinates name buckets. Texts that meet in a bucket are joined
to a few centres of the bucket (stars), each link is checked on the exact
shingle multisets, and linked texts form components. In buckets in which more
than one component is left, an exact bound settles the texts that share too
little with all other components; the others meet new centres as long as that
joins many. A round costs a row a member, however large a group of near copies
is. What is left then - texts whose shingles nearly all occur in other
components, and which no centre is like - is compared exactly, in blocks, the
texts of smaller components with all: nothing is lost.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, min_label_components, partitions, small_batches
from .words import U, mix, sequence_hashes, shingle_hashes, slices, utf8, word_hashes

BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Texts and cells of a block, where what is left is compared, and the share of labels that a round of stars must join to be followed by another.
BLOCK, BLOCK_CELLS = 4096, 2_000_000
WORTH = 0.25


def weighted_cells(shingles: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each unit of a text's shingle multiset: the j-th copy of a shingle has its own, the same in every text."""
    key = (of.astype(U) << U(40)) | (shingles >> U(24))
    key = np.sort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    run = np.flatnonzero(new)
    copy = np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))
    return mix((key & U((1 << 40) - 1)) ^ (copy.astype(U) << U(40))), (key >> U(40)).astype(np.int64)


def dart_signatures(cells: np.ndarray, of: np.ndarray, n: int, coordinates: int = COORDINATES) -> np.ndarray:
    """(n, coordinates) hashes of the earliest dart of each coordinate; a text without cells has zeros."""
    out = np.zeros((n, coordinates), U)
    weight = np.bincount(of, minlength=n)
    todo, reach = weight > 0, coordinates * (np.log(coordinates) + 4) / np.maximum(weight, 1)
    while todo.any():
        mine = todo[of]
        cell, text, rank = cells[mine], of[mine], np.zeros(mine.sum(), np.float32)
        keys, darts, throw = [], [], 1
        while len(cell):  # the next dart of each cell comes an exponential step later
            dart = mix(cell + U(throw * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log((((dart >> U(40)).astype(np.float32)) + np.float32(0.5)) / np.float32(1 << 24))
            on = rank <= reach[text]
            cell, text, rank, dart = cell[on], text[on], rank[on], dart[on]
            slot = text.astype(U) * U(coordinates) + (dart & U(0xFFFFFF)) % U(coordinates)
            keys.append((slot << U(32)) | rank.view(np.uint32))
            darts.append(dart)
            throw += 1
        key, dart = np.concatenate(keys), np.concatenate(darts)
        order = np.argsort(key)
        slot = (key[order] >> U(32)).astype(np.int64)
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        slot, dart = slot[first], dart[order][first]
        full = np.bincount(slot // coordinates, minlength=n) == coordinates
        keep = full[slot // coordinates]
        out.ravel()[slot[keep]] = dart[keep]
        todo &= ~full
        reach = reach * 2
    return out


def signatures(texts: pa.Array) -> dict[str, np.ndarray]:
    """For each text: two hashes of its word sequence, its number of shingles and its band hashes."""
    data, ends = utf8(texts)
    words, at = word_hashes(data, ends)
    h, of = shingle_hashes(words, at)
    cells, text = weighted_cells(h, of)
    darts = dart_signatures(cells, text, len(texts))
    band = np.zeros((len(texts), BANDS), U)
    for r in range(ROWS):
        band = mix(band * U(31) + darts[:, r::ROWS])
    band = mix(band ^ mix(np.arange(BANDS, dtype=U))[None, :])
    one, two = sequence_hashes(words, at)
    return {"one": one, "two": two, "n": np.bincount(of, minlength=len(texts)), "bands": band}


SIGNED = "doc_id long, one long, two long, n long, bands array<long>"


def sign(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """SIGNED rows of the documents that have words, and their text if asked for."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = signatures(part.column(1))
                has = np.flatnonzero(s["n"] > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(has)),
                        *(pa.array(s[k][has].astype(np.int64)) for k in ("one", "two", "n")),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(s["bands"][has].astype(np.int64).ravel())),
                        *([part.column(1).take(pa.array(has))] if with_text else []),
                    ],
                    names=["doc_id", "one", "two", "n", "bands", *(["text"] if with_text else [])],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").mapInArrow(run, SIGNED + ", text string" * with_text)


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts."""
    both = pa.concat_arrays([left.cast(pa.large_string()), right.cast(pa.large_string())])
    h, of = shingle_hashes(*word_hashes(*utf8(both)))
    n = len(left)
    at = np.searchsorted(of, np.arange(2 * n + 1))
    out = np.zeros(n)
    for i in range(n):
        a, b = h[at[i] : at[i + 1]], h[at[n + i] : at[n + i + 1]]
        (x, p), (y, q) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        _, i1, i2 = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        same = np.minimum(p[i1], q[i2]).sum()
        out[i] = same / max(1, len(a) + len(b) - same)
    return out


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose texts are similar. Both sides of either join are exchanged as they are, so that Spark can split a centre with many pairs."""
    left = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "left"}), "a")
    both = left.join(texts.withColumnsRenamed({"doc_id": "b", "text": "right"}), "b").select("a", "b", "left", "right")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "left", 1_000_000):
                on = pa.array(similarity(part.column(2), part.column(3)) >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(on), part.column(1).filter(on)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


CELLS = "rep long, n int, cells binary"


def cells_of(texts: DataFrame) -> DataFrame:
    """CELLS rows: the 64-bit cells of each text's shingle multiset, so that multisets are compared as sets."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, of = shingle_hashes(*word_hashes(*utf8(part.column(1))))
                cells, text = weighted_cells(h, of)
                at = np.searchsorted(text, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at).astype(np.int32)), pa.array([cells[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["rep", "n", "cells"]
                )

    return texts.select("doc_id", "text").mapInArrow(run, CELLS)


def unpacked(cells: DataFrame) -> DataFrame:
    """(rep, label, n, cell), a row for each cell."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "cells", 8_000_000):
                n = part.column(2).to_numpy()
                row = pa.array(np.repeat(np.arange(len(n)), n))
                cell = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(row) for k in range(3)), pa.array(cell)], names=["rep", "label", "n", "cell"])

    return cells.select("rep", "label", "n", "cells").mapInArrow(run, "rep long, label long, n int, cell long")


def still_open(named: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Those members (bh, rep, label) of mixed buckets that may have a link to another label of their bucket, with n and c.

    c counts a text's cells that a text of another label has as well. Texts a
    and b share at most c(a) cells, so they are similar only if
    c(a) >= threshold / (1 + threshold) * (n(a) + n(b)), and their sizes differ
    by the threshold at most. A member for which no size in its bucket allows
    that is settled: nothing is lost. Work is a row a cell and a row a member.
    """
    named = cut(named)
    labels = named.select("rep", "label").distinct()
    each = unpacked(cells.join(labels, "rep"))
    shared = each.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("cell")
    held = cut(each.join(shared, "cell").groupBy("rep", "n").agg(F.count("*").alias("c")).where(F.col("c") >= threshold * F.col("n") - 1e-9))
    rows = cut(named.join(held, "rep"))
    step = float(np.log(1.02))
    size_class = lambda c: F.floor(F.ln(c) / step)
    buckets = rows.groupBy("bh").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.collect_set(size_class(F.col("n"))).alias("sizes")).where("lo <> hi").select("bh", "sizes")
    low, high = size_class(F.col("n") * threshold * 0.999), size_class(F.greatest(F.lit(0.5), F.col("c") * ((1 + threshold) / threshold) - F.col("n") + 1e-6))
    # the member's own size is in the set, and counts as that of a possible partner
    return rows.join(buckets, "bh").where(F.exists("sizes", lambda k: (k >= low) & (k <= high))).select("bh", "rep", "label", "n", "c")


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a member and a centre of its bucket under another label: two rows a member.

    One centre is the member with the largest share of common cells, which is
    the likeliest original of copies; the other one is drawn anew every turn.
    """
    share = F.struct((F.col("c") / F.col("n")).alias("o"), F.col("n").alias("m"), "rep", "label")
    drawn = F.struct(F.xxhash64("rep", F.lit(turn)).alias("o"), "rep", "label")
    centres = members.groupBy("bh").agg(F.max(share).alias("best"), F.max(drawn).alias("drawn"))
    centres = centres.select("bh", F.array(*(F.struct(F.col(f"{k}.rep").alias("to"), F.col(f"{k}.label").alias("other")) for k in ("best", "drawn"))).alias("centres"))
    met = members.join(cut(centres), "bh").select("rep", "label", F.explode("centres").alias("x")).where(F.col("label") != F.col("x.other"))
    return met.select(F.least("rep", "x.to").alias("a"), F.greatest("rep", "x.to").alias("b")).distinct()


def linked(cells: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Similar pairs of different labels among left x right, exactly; of those that join the same labels, the first."""
    if not len(left) or not len(right):
        return []
    size = np.array([len(c) for c in cells])
    of = np.repeat(right, size[right])
    every = np.concatenate([cells[k] for k in right.tolist()])
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    root = {int(x): int(x) for x in label}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k in left.tolist():
        lo, hi = np.searchsorted(every, cells[k], "left"), np.searchsorted(every, cells[k], "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(of[at], minlength=len(cells))
        for j in np.flatnonzero((both > 0) & (both >= threshold * (size[k] + size - both) - 1e-9)).tolist():
            p, q = find(int(label[k])), find(int(label[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((k, j))
    return out


def across(members: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different labels of a bucket, exactly.

    members: the rows that neither still_open nor the stars could settle.
    Buckets that share a label make a group, so that two texts meet once,
    however many buckets they share. In a group each text outside its largest
    label is compared with all, on the cells themselves; a task holds a block of
    either side, BLOCK texts and BLOCK_CELLS cells at most, and passes on at
    most one link fewer than it has labels. So a group within a block costs a
    row a text, and one of many blocks a row of each smaller label a block.
    """
    head = members.groupBy("bh").agg(F.min("label").alias("b"))
    groups = min_label_components(members.join(head, "bh").select(F.col("label").alias("a"), "b").distinct())
    rows = cut(members.select("rep", "label", "n").distinct().join(groups.select(F.col("node").alias("label"), F.col("label").alias("grp")), "label"))
    sizes = rows.groupBy("grp", "label").agg(F.count("*").alias("m"), F.sum("n").alias("w")).groupBy("grp").agg(F.sum("m").alias("all_m"), F.sum("w").alias("all_w"), F.max(F.struct("m", "w", "label")).alias("top"))
    blocks = lambda m, w: F.ceil(F.greatest(m / BLOCK, w / BLOCK_CELLS, F.lit(1.0)))
    sizes = cut(sizes.select("grp", F.col("top.label").alias("main"), blocks(F.col("all_m"), F.col("all_w")).alias("blocks"), blocks(F.col("all_m") - F.col("top.m"), F.col("all_w") - F.col("top.w")).alias("minors")))
    rows = rows.join(sizes, "grp")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    minor = rows.where("label <> main").select("grp", F.pmod(F.xxhash64("rep", F.lit(3)), "minors").alias("i"), every("blocks").alias("j"), F.lit(True).alias("minor"), "rep", "label")
    rest = rows.select("grp", every("minors").alias("i"), F.pmod(F.xxhash64("rep", F.lit(5)), "blocks").alias("j"), F.lit(False).alias("minor"), "rep", "label")

    def run(part: pa.Table) -> pa.Table:
        minor, rep = part["minor"].to_numpy(), part["rep"].to_numpy()
        found = linked([np.frombuffer(x, U) for x in part["cells"].to_pylist()], part["label"].to_numpy(), np.flatnonzero(minor), np.flatnonzero(~minor), threshold)
        x, y = (rep[[f[k] for f in found]] if found else rep[:0] for k in (0, 1))
        return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    dealt = minor.unionByName(rest).join(cells.select("rep", "cells"), "rep").repartition(partitions(members.sparkSession), "grp", "i", "j")
    return dealt.groupBy("grp", "i", "j").applyInArrow(run, "a long, b long").distinct()


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bh, rep, label); a text without a link is its own label."""
    return members.select("bh", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bh", "rep", F.coalesce("label", "rep").alias("label"))


def several_texts(docs: DataFrame, signed: DataFrame) -> DataFrame | None:
    """(doc_id, one, two, bands, text, rep) of the documents that have texts of different words, each with a made id of its own (rep); None if there are none."""
    apart = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("one", "two")).alias("x"), F.max(F.struct("one", "two")).alias("y")).where("x <> y")
    apart = cut(apart.select("doc_id"))
    if not apart.limit(1).count():
        return None
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").join(apart, "doc_id", "left_semi").distinct()
    return cut(sign(texts, with_text=True).withColumn("rep", F.xxhash64("doc_id", "one", "two", F.lit(13))))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row (doc_id, class_id, class_text) for each row of docs.

    class_id is the smallest doc_id of the group that links of similarity
    threshold or more connect; class_text is the smallest doc_id with the same
    words. A null or wordless text stands alone, under its own doc_id. Rows
    that share a doc_id are one document. A row without a doc_id gets the class
    of an equal text, if one has an id, else null. Empty input gives no rows.
    Texts of any length are hashed whole; ties between centres go by doc_id, and
    classes don't depend on them.
    """
    small_batches(docs.sparkSession)
    signed = cut(sign(docs))
    several = several_texts(docs, signed)
    known = signed.where("doc_id is not null")
    if several is not None:
        known = known.join(several.select("doc_id").distinct(), "doc_id", "left_anti")
    known = known.select("one", "two", F.lit(False).alias("made"), F.col("doc_id").alias("rep"), "bands")
    if several is not None:
        known = known.unionByName(several.select("one", "two", F.lit(True).alias("made"), "rep", "bands"))
    reps = cut(known.groupBy("one", "two").agg(F.min(F.struct("made", "rep", "bands")).alias("r")).select("one", "two", "r.made", "r.rep", "r.bands"))
    banded = reps.select("rep", F.explode("bands").alias("bh"))
    turn = lambda k: F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("o"), "rep"))["rep"]
    buckets = cut(banded.groupBy("bh").agg(F.min("rep").alias("c0"), F.max("rep").alias("far"), turn(1).alias("c1"), turn(2).alias("c2")).where("c0 <> far").drop("far"))
    met = cut(banded.join(buckets, "bh"))
    stars = met.select(F.explode(F.array("c0", "c1", "c2")).alias("c"), "rep").where("c <> rep").select(F.least("c", "rep").alias("a"), F.greatest("c", "rep").alias("b")).distinct()
    stars = cut(stars)
    taken = met.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    if several is not None:
        texts = texts.join(several.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(several.select(F.col("rep").alias("doc_id"), "text"))
    texts = cut(texts.join(taken, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    links = cut(verified(stars, texts, threshold))
    if several is not None:  # texts of one document belong together
        of = cut(several.select("doc_id", "one", "two").join(reps.select("one", "two", "rep"), ["one", "two"]).select("doc_id", "rep").distinct())
        links = cut(links.unionByName(of.join(of.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")))
    labels = min_label_components(links)
    named = cut(labelled(met, labels))
    mixed = named.groupBy("bh").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bh")
    members = cut(named.join(cut(mixed), "bh", "left_semi"))
    cells = cut(cells_of(texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")))
    last = False
    for turn_ in itertools.count(3):
        members = cut(still_open(members, cells, threshold))
        left = members.select("label").distinct().count()
        if not left:
            break
        new = cut(across(members, cells, threshold) if last else verified(star_pairs(members, turn_), texts, threshold))
        found = new.count()
        if found:
            links = cut(links.unionByName(new))
            labels = min_label_components(links)
        if last:
            break
        members = labelled(members, labels)
        last = found < WORTH * left
    classes = reps.select("one", "two", "made", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("one", "two", "made", "rep", F.coalesce("label", "rep").alias("label"))
    if several is not None:  # made ids give way to those of documents
        classes = cut(classes)
        ids = classes.where("not made").select("one", "two", "label", F.col("rep").alias("id")).unionByName(several.select("one", "two", F.col("doc_id").alias("id")).join(classes.select("one", "two", "label"), ["one", "two"]).select("one", "two", "label", "id"))
        first = ids.groupBy("label").agg(F.min("id").alias("_first"))
        classes = classes.join(first, "label").join(ids.groupBy("one", "two").agg(F.min("id").alias("_text")), ["one", "two"]).select("one", "two", F.col("_text").alias("rep"), F.col("_first").alias("label"))
    told = cut(signed.select("doc_id", "one", "two")).join(cut(classes.select("one", "two", "rep", "label")), ["one", "two"], "left").select("doc_id", F.col("label").alias("class_id"), F.col("rep").alias("class_text"))
    alone = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(~F.coalesce(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("class_text"))
    return told.unionByName(alone)


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_first(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents of which no near duplicate has a smaller doc_id, one row of each doc_id.

    Rows without a doc_id stay, one of each text, unless a row with an id has
    that text.
    """
    gone = cut(near_duplicates(docs, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")))
    stay = docs.join(gone, docs.doc_id.cast("long") == gone["_gone"], "left_anti")
    again = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_again")))
    if not again.limit(1).count():
        return stay
    same = stay.doc_id.eqNullSafe(again["_again"])
    few, rest = stay.join(again, same, "left_semi"), stay.join(again, same, "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first = F.min_by(F.struct(*columns), F.struct(F.xxhash64("text"), F.xxhash64(*columns))).alias("_row")
    by_id = few.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(first).select("_row.*")
    text = F.col("text").cast("string")
    by_text = few.where("doc_id is null").groupBy(text.alias("_text")).agg(first)
    named = docs.where("doc_id is not null").select(text.alias("_named"))
    by_text = by_text.join(named, F.col("_text") == F.col("_named"), "left_anti").select("_row.*")
    return rest.unionByName(by_id).unionByName(by_text)
