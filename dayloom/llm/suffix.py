"""Repeated substrings by run-compressed Burrows-Wheeler indexes.

Every byte that a string of LENGTH bytes covers is a repeat if that string also
starts in a document with a smaller doc_id. The corpus is not sorted as one:

1. Texts are dealt into groups of about SLICE bytes by a hash of document and
   text, in one shuffle that serves all steps; a group is the same in each.
2. Each window of LENGTH bytes has an anchor, its smallest k-mer by hash, so
   equal windows have equal anchors at the same place. Windows next to each
   other that share an anchor make a fragment: the anchor with up to 30 bytes
   on its left and right.
3. asked: only anchors that two documents hold can matter. Groups ask the shard
   of each anchor, once a group, and get a bit for each.
4. named: fragments of such anchors send a name, 128 bits of their bytes. All
   but the first document's occurrences of a name are repeats. Only anchors with
   two names or more need the bytes, of the first occurrence of each.
5. searched: a shard ranks the fragments of an anchor by document. For each bit
   of the rank, those without the bit are indexed and those with it are streamed
   against them, so that every fragment meets all of smaller documents (Index):
   a run-length BWT with samples at run ends, backward steps, and at each
   position the length of the longest match. LENGTH bytes or more are a repeat.

A message is a row for a group and a shard that have something to say to each
other, so there are never more than fragments.

An anchor with over HOT names is dealt by longer keys, four for each fragment,
each for the windows that contain it. Shards grow neither with copies nor with
documents, but with the distinct contexts of a key; their number follows the
size of the input.

Texts are UTF-8 bytes, a null text is empty. Rows that share a doc_id don't
repeat each other; a null doc_id counts as larger than all others. Texts are
read whole, however long; ties don't occur, as a byte is covered or not. Empty
input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import U, mix, powers, utf8

LENGTH, K = 50, 20
SIDE = LENGTH - K
#: Bytes of text to a group, anchors to a shard, and shards of fragments to a shard of anchors.
SLICE, SHARD, FINER = 2_000_000, 1_000_000, 2
#: Names of an anchor from which on it is dealt by longer keys: bytes on the left and right of the anchor, for windows with at least so many.
HOT, KEYS = 1000, ((0, 23), (8, 15), (16, 7), (24, 0))
LAST = 2**63 - 1
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Rolling:
    """Hashes of any stretch of data, from prefix sums."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        self.total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(U(base), len(data)), out=self.total[1:])
        self.back = powers(U(pow(base, -1, 1 << 64)), len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start])


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def sizes(at: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(at, n))


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n times, for each start."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def fragments(data: np.ndarray, ends: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """In order: index of the text, first window, number of windows, bytes before the anchor, anchor hash."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(U)
    h = mix((rolling.total[K:] - rolling.total[:-K]) * rolling.back[: len(data) - K + 1])
    place = U((1 << max(24, len(data).bit_length())) - 1)
    low = (h & ~place) | np.arange(len(h), dtype=U)  # ties go to the left
    wide, w = SIDE + 1, 1
    while 2 * w <= wide:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    low = np.minimum(low[: len(low) - (wide - w)], low[wide - w :])
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(low)]
    start = np.flatnonzero(np.arange(len(low)) + LENGTH <= ends[text + 1])
    at, text = (low[start] & place).astype(np.int64), text[start]
    first = firsts(at, text)
    at, start, text, windows = at[first], start[first], text[first], sizes(first, len(start))
    return text, start, windows, at - start, h[at]


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values: the bytes of data between offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def grouped(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The values of each run that begins at one of at, as one binary; values has a row of bytes or a number for each."""
    values = np.ascontiguousarray(values)
    width = values.nbytes // max(1, len(values))
    return binaries(values.reshape(-1), np.append(at, len(values)) * width)


def packed(on: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flags of each run as bits, and the offsets of the runs' bytes."""
    n = (counts + 7) // 8
    offsets = np.append(0, np.cumsum(n))
    bits = np.zeros(int(offsets[-1]) * 8, bool)
    bits[spread(offsets[:-1] * 8, counts)] = on
    return np.packbits(bits), offsets


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def five(x: np.ndarray) -> np.ndarray:
    """40 bits of each hash, as rows of five bytes."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5]


def from_five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view(U).ravel()


def identified(docs: DataFrame, groups: int) -> DataFrame:
    """(grp, doc, text_hash, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.select(F.pmod(F.col("doc").bitwiseXOR(F.col("text_hash")), F.lit(groups)).alias("grp"), "doc", "text_hash", "text")


class Group:
    """The distinct texts of a group, by document, and their fragments in order."""

    def __init__(self, rows: pa.Table):
        doc, mark = rows["doc"].to_numpy(), rows["text_hash"].to_numpy()
        order = np.lexsort((mark, doc))
        first = order[firsts(doc[order], mark[order])]
        self.doc, self.column = doc[first], rows["text"].combine_chunks().take(pa.array(first))
        if isinstance(self.column, pa.ChunkedArray):
            self.column = pa.concat_arrays(self.column.chunks)
        self.data, self.ends = utf8(self.column)
        self.place = np.empty(len(order), np.int64)  # of each row's text among the distinct ones
        self.place[order] = np.repeat(np.arange(len(first)), sizes(firsts(doc[order], mark[order]), len(order)))

    def fragments(self, shards: int):
        """text, start, windows, left, short hash, which may be asked about, which are known to be shared."""
        self.rolling = Rolling(self.data)
        text, start, windows, left, h = fragments(self.data, self.ends, self.rolling)
        short = h >> U(24)
        order = np.argsort(short, kind="stable")
        at = firsts(short[order])
        many, once = np.zeros(len(h), bool), np.zeros(len(h), bool)
        if len(h):
            doc = self.doc[text[order]]
            shared = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
            many[order] = np.repeat(shared, sizes(at, len(h)))
            # once a group if two documents share it here, else once a text
            once[order[firsts(short[order], np.where(many[order], 0, text[order]))]] = True
        return text, start, windows, left, short, once, many


def per_shard(shard: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """An order by shard and text, the runs of one text in a shard, their counts, and the runs at which a shard begins."""
    order = np.lexsort((text, shard))
    run = firsts(shard[order], text[order])
    return order, run, sizes(run, len(order)), firsts(shard[order][run])


ASK = "shard int, grp long, docs binary, counts binary, many binary, anchors binary"
ASK_NAMES = [x.split()[0] for x in ASK.split(", ")]
HELD = "grp long, shard int, mask binary"


def asked(texts: DataFrame, shards: int) -> DataFrame:
    """HELD rows: of the anchors that a group asks a shard about, in order, a bit for each that two documents hold."""

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        group = Group(rows)
        text, _, _, _, short, once, many = group.fragments(shards)
        at = np.flatnonzero(once)
        shard = (short[at] % U(shards)).astype(np.int64)
        order, run, n, edge = per_shard(shard, text[at])
        at = at[order]
        begin = run[edge]
        per = sizes(begin, len(at))
        return pa.table(
            [
                pa.array(shard[order[begin]].astype(np.int32)),
                pa.array(np.full(len(edge), key[0].as_py())),
                grouped(group.doc[text[at[run]]], edge),
                grouped(n.astype(np.int32), edge),
                binaries(*packed(many[at], per)),
                grouped(five(short[at]), begin),
            ],
            names=ASK_NAMES,
        )

    def meet(part: pa.Table) -> pa.Table:
        anchors = part["anchors"].to_pylist()
        per = np.array([len(x) // 5 for x in anchors])
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=k) for m, k in zip(part["many"].to_pylist(), per.tolist(), strict=True)]).astype(bool)
        doc, short = np.repeat(joined(part["docs"], np.int64), joined(part["counts"], np.int32)), from_five(np.frombuffer(b"".join(anchors), np.uint8))
        order = np.argsort(short, kind="stable")
        at = firsts(short[order])
        doc = doc[order]
        shared = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) | np.logical_or.reduceat(many[order], at)
        on = np.empty(len(short), bool)
        on[order] = np.repeat(shared, sizes(at, len(order)))
        return pa.table({"grp": part["grp"], "shard": part["shard"], "mask": binaries(*packed(on, per))})

    return texts.groupBy("grp").applyInArrow(ask, ASK).groupBy("shard").applyInArrow(meet, HELD)


def spans_of(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, windows: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, mark and (start, end) of the runs of windows with a flag: each covers LENGTH - 1 bytes more."""
    of = np.repeat(np.arange(len(doc)), windows)
    at = spread(start, windows)
    of, at = of[on], at[on]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(of))[: len(a)] - 1
    return doc[of[a]], mark[of[a]], np.stack([at[a], at[b] + LENGTH], axis=1).astype(np.int32)


def merged(doc: np.ndarray, text: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, span): spans of a text that overlap or touch are one. doc (a group) goes before text in order."""
    order = np.lexsort((span[:, 0], text, doc))
    doc, text, span = doc[order], text[order], span[order]
    # ends as running maxima within a text
    of = np.cumsum(np.isin(np.arange(len(doc)), firsts(doc, text)))
    reach = np.maximum.accumulate(span[:, 1].astype(np.int64) + of * (1 << 32)) - of * (1 << 32)
    new = np.ones(len(doc), bool)
    new[1:] = (of[1:] != of[:-1]) | (span[1:, 0] > reach[:-1])
    a = np.flatnonzero(new)
    last = np.append(a[1:], len(doc))[: len(a)] - 1
    out = np.zeros(len(a), SPAN)
    out["text"], out["start"], out["end"] = text[a], span[a, 0], reach[last]
    return doc[a], out


#: Messages about the texts of a group, by their place in it.
SPAN = np.dtype([("text", np.int32), ("start", np.int32), ("end", np.int32)])
PLACE = np.dtype([("text", np.int32), ("start", np.int32), ("left", np.uint8), ("right", np.uint8)])
NAME = "shard int, grp long, docs binary, counts binary, anchors binary, names binary, places binary"
NAME_NAMES = [x.split()[0] for x in NAME.split(", ")]
NAMED = "grp long, spans binary, wants binary"


def by_group(group: np.ndarray, values: np.ndarray, column: str) -> pa.Table:
    """A row for each group (in order) with its values as one binary; null in the other column of NAMED."""
    at = firsts(group)
    some, none = grouped(values, at), pa.nulls(len(at), pa.binary())
    return pa.table({"grp": group[at], "spans": some if column == "spans" else none, "wants": some if column == "wants" else none})


def passed_on(key: int, spans: np.ndarray, shards: int, names: list[str]) -> pa.Table:
    """A message with a negative shard: spans that are known already."""
    none = pa.nulls(1, pa.binary())
    return pa.table([pa.array([-1 - key % shards], pa.int32()), pa.array([key], pa.int64()), *(none for _ in names[3:]), pa.array([spans.tobytes()], pa.binary())], names=names)


def named(texts: DataFrame, held: DataFrame, shards: int) -> DataFrame:
    """NAMED rows, many for a group: SPANs known to repeat, and PLACEs of fragments that must be searched, with 128 added to right for those of hot anchors."""

    def name(key: tuple, rows: pa.Table, masks: pa.Table) -> pa.Table:
        out = pa.schema([("shard", pa.int32()), ("grp", pa.int64()), *((c, pa.binary()) for c in NAME_NAMES[2:])]).empty_table()
        if not rows.num_rows or not masks.num_rows:  # no text here has a fragment
            return out
        group, key = Group(rows), key[0].as_py()
        text, start, windows, left, short, once, many = group.fragments(shards)
        at, on = np.flatnonzero(once), many.copy()
        shard = (short[at] % U(shards)).astype(np.int64)
        order, run, _, edge = per_shard(shard, text[at])
        at = at[order]
        begin = run[edge]
        mask = dict(zip(masks["shard"].to_pylist(), masks["mask"].to_pylist(), strict=True))
        for s, a, n in zip(shard[order[begin]].tolist(), begin.tolist(), sizes(begin, len(at)).tolist(), strict=True):
            on[at[a : a + n]] |= np.unpackbits(np.frombuffer(mask[s], np.uint8), count=n).astype(bool)
        same = mix(short ^ (text.astype(U) << U(40)))  # the anchors of a text that come again
        on = np.isin(same, same[on])
        text, start, windows, left, short = (x[on] for x in (text, start, windows, left, short))
        if not len(text):
            return out
        stop = start + windows + LENGTH - 1
        one, two = group.rolling(start, stop) + left.astype(U), Rolling(group.data, BASES[1])(start, stop)
        doc, place = group.doc[text], np.zeros(len(text), PLACE)
        place["text"], place["start"], place["left"], place["right"] = text, start - group.ends[text], left, windows + SIDE - 1 - left
        order = np.lexsort((doc, two, one))
        first = firsts(one[order], two[order])
        lowest = np.empty(len(order), np.int64)
        lowest[order] = np.repeat(doc[order][first], sizes(first, len(order)))
        late, found = doc > lowest, [out]
        if late.any():  # what repeats within a group is known here
            n = windows[late]
            spans = spans_of(place["text"][late], place["text"][late], place["start"][late].astype(np.int64), n, np.ones(int(n.sum()), bool))
            found.append(passed_on(key, merged(*spans)[1], shards, NAME_NAMES))
        asks = np.flatnonzero(~late)
        shard = (short[asks] % U(shards)).astype(np.int64)
        order, run, n, edge = per_shard(shard, text[asks])
        asks, begin = asks[order], run[edge]
        found.append(
            pa.table(
                [
                    pa.array(shard[order[begin]].astype(np.int32)),
                    pa.array(np.full(len(edge), key)),
                    grouped(doc[asks[run]], edge),
                    grouped(n.astype(np.int32), edge),
                    grouped(five(short[asks]), begin),
                    grouped(np.stack([one[asks], two[asks]], axis=1), begin),
                    grouped(place[asks], begin),
                ],
                names=NAME_NAMES,
            )
        )
        return pa.concat_tables(found)

    def meet(part: pa.Table) -> pa.Table:
        if part["shard"][0].as_py() < 0:
            return pa.table({"grp": part["grp"], "spans": part["places"], "wants": pa.nulls(part.num_rows, pa.binary())})
        doc = np.repeat(joined(part["docs"], np.int64), joined(part["counts"], np.int32))
        group = np.repeat(part["grp"].to_numpy(), [len(x) // 5 for x in part["anchors"].to_pylist()])
        short, place = from_five(joined(part["anchors"], np.uint8)), joined(part["places"], PLACE)
        one, two = joined(part["names"], U).reshape(-1, 2).T
        order = np.lexsort((doc, two, one, short))
        at = firsts(short[order], one[order], two[order])
        lowest = np.empty(len(order), np.int64)
        lowest[order] = np.repeat(doc[order][at], sizes(at, len(order)))
        anchor = firsts(short[order][at])
        names = np.empty(len(order), np.int64)  # how many names the anchor has
        names[order] = np.repeat(np.repeat(sizes(anchor, len(at)), sizes(anchor, len(at))), sizes(at, len(order)))
        late = doc > lowest
        n = place["left"][late].astype(np.int64) + place["right"][late] - (SIDE - 1)
        spans = merged(*spans_of(group[late], place["text"][late], place["start"][late].astype(np.int64), n, np.ones(int(n.sum()), bool)))
        search = np.flatnonzero(~late & (names > 1))
        search = search[np.argsort(group[search], kind="stable")]
        wants = place[search].copy()
        wants["right"] += np.where(names[search] > HOT, 128, 0).astype(np.uint8)
        return pa.concat_tables([by_group(*spans, "spans"), by_group(group[search], wants, "wants")])

    asks = texts.groupBy("grp").cogroup(held.groupBy("grp")).applyInArrow(name, NAME)
    return asks.groupBy("shard").applyInArrow(meet, NAMED)


class Index:
    """A run-length BWT of fragments, each ending with a terminator of its own.

    Symbols are numbers; the anchor of a fragment is one symbol, that says which
    fragments may match it. Kept are the runs (symbol, first row, length, rows
    of smaller symbols and of earlier runs of it) and the text positions of the
    first and the last row of each run, besides the text itself.
    """

    def __init__(self, symbols: np.ndarray, width: int):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        at, step, rank = firsts(symbols[order]), 1, np.empty(n, np.int64)
        rank[order] = np.repeat(at, sizes(at, n))  # a group's rank is its first row
        tied = np.flatnonzero(np.repeat(sizes(at, n), sizes(at, n)) > 1)
        while len(tied) and step <= width:  # by 2, 4, 8, ... symbols, those that still tie; a terminator ends each in time
            here = order[tied]
            key = rank[here] * (n + 1) + np.where(here + step < n, rank[np.minimum(here + step, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            here, key = here[by], key[by]
            order[tied] = here
            at = firsts(key)
            many = sizes(at, len(key))
            rank[here] = np.repeat(tied[at], many)
            tied, step = tied[np.repeat(many, many) > 1], step * 2
        before = symbols[order - 1]
        run = firsts(before)
        length = sizes(run, n)
        by_symbol = np.lexsort((run, before[run]))
        self.rows, self.text = n, np.concatenate([symbols, np.full(width + 1, -1, np.int64)])
        self.run = before[run][by_symbol] * n + run[by_symbol]
        self.symbol, self.length = before[run][by_symbol], length[by_symbol]
        self.base = np.cumsum(self.length) - self.length
        self.first = int(order[0])
        self.head, self.tail = order[run][by_symbol], order[run + length - 1][by_symbol]

    def common(self, one: np.ndarray, two: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at one and two have in common, up to most."""
        wide = int(most.max(initial=0))
        if not wide:
            return np.zeros(len(one), np.int64)
        steps = np.arange(wide)
        same = self.text[np.minimum(one, self.rows)[:, None] + steps] == self.text[np.minimum(two, self.rows)[:, None] + steps]
        return np.minimum(np.where(same.all(axis=1), wide, same.argmin(axis=1)), most)

    def matching_statistics(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray):
        """Streams fragments from their ends; yields (fragments, positions, lengths of the longest match there)."""
        on = np.arange(len(start))
        row, place, size = np.zeros(len(on), np.int64), np.full(len(on), self.first), np.zeros(len(on), np.int64)
        for k in range(1, int(length.max(initial=0)) + 1):
            more = length[on] >= k
            on, row, place, size = on[more], row[more], place[more], size[more]
            c = symbols[start[on] + length[on] - k]
            at = np.searchsorted(self.run, c * self.rows + row, "right") - 1
            low = np.maximum(at, 0)
            into = row + c * self.rows - self.run[low]
            inside = (at >= 0) & (self.symbol[low] == c) & (into < self.length[low])
            # elsewhere the nearest runs of the symbol above and below hold the longest match
            off = np.flatnonzero(~inside)
            up, down = low[off], np.minimum(at[off] + 1, len(self.run) - 1)
            has_up, has_down = (at[off] >= 0) & (self.symbol[up] == c[off]), (at[off] + 1 < len(self.run)) & (self.symbol[down] == c[off])
            l_up = np.where(has_up, self.common(place[off], self.tail[up], size[off]), -1)
            l_down = np.where(has_down, self.common(place[off], self.head[down], size[off]), -1)
            take_up = l_up >= l_down
            some = has_up | has_down
            size = size + 1
            size[off] = np.where(some, np.maximum(l_up, l_down) + 1, 0)
            place = place - 1
            place[off] = np.where(some, np.where(take_up, self.tail[up], self.head[down]) - 1, self.first)
            row = self.base[low] + into
            row[off] = np.where(some, np.where(take_up, self.base[up] + self.length[up] - 1, self.base[down]), 0)
            yield on, length[on] - k, size


def repeated_windows(body: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A flag for each window of each fragment: does it occur in a fragment with the same key and a smaller document?

    Fragments are distinct; each has left + K + right bytes in body, its anchor in the middle.
    """
    body, windows = body.astype(np.int64), left + right - (SIDE - 1)
    flag, first = np.zeros(int(windows.sum()), bool), np.cumsum(windows) - windows
    order = np.lexsort((doc, key))
    at = firsts(key[order], doc[order])
    group = firsts(key[order][at])
    dense = np.arange(len(at)) - np.repeat(group, sizes(group, len(at)))  # rank of the document among those of the key
    rank, of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    rank[order] = np.repeat(dense, sizes(at, len(order)))
    of[order] = np.repeat(np.repeat(np.arange(len(group)), sizes(group, len(at))), sizes(at, len(order)))
    for bit in range(int(rank.max(initial=0)).bit_length()):
        met = of * (int(rank.max()) + 1) + (rank >> (bit + 1))  # equal for those that are compared now
        late = (rank >> bit & 1).astype(bool)
        stream = np.flatnonzero(late)
        if not len(stream):
            continue
        base = np.flatnonzero(~late & np.isin(met, met[stream]))
        pairs = np.unique(met[base])

        def spelled(which: np.ndarray, ended: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = left[which] + right[which] + 1 + ended
            begin = np.cumsum(n) - n
            out = np.repeat(np.arange(len(which)), n)  # terminators keep this
            put = spread(begin, left[which])
            out[put] = len(base) + body[spread(start[which], left[which])]
            out[begin + left[which]] = len(base) + 256 + np.searchsorted(pairs, met[which])
            put = spread(begin + left[which] + 1, right[which])
            out[put] = len(base) + body[spread(start[which] + left[which] + K, right[which])]
            return out, begin, n

        symbols, _, _ = spelled(base, True)
        index = Index(symbols, 2 * SIDE + 2)
        symbols, begin, n = spelled(stream, False)
        for on, position, size in index.matching_statistics(symbols, begin, n):
            full = (size > SIDE) & (position < windows[stream[on]])
            flag[first[stream[on[full]]] + position[full]] = True
    return flag


BODY = "shard int, grp long, docs binary, counts binary, keys binary, bodies binary, places binary"
BODY_NAMES = [x.split()[0] for x in BODY.split(", ")]


def searched(texts: DataFrame, told: DataFrame, shards: int) -> DataFrame:
    """(grp, spans), many for a group: all SPANs that repeat a smaller document."""

    def cut_out(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        found, key = [pa.schema([("shard", pa.int32()), ("grp", pa.int64()), *((c, pa.binary()) for c in BODY_NAMES[2:])]).empty_table()], key[0].as_py()
        spans = joined(known["spans"].drop_null(), SPAN)
        if len(spans):
            found.append(passed_on(key, spans, shards, BODY_NAMES))
        place = joined(known["wants"].drop_null(), PLACE)
        if not len(place):
            return pa.concat_tables(found)
        group, text = Group(rows), place["text"].astype(np.int64)
        begin, left, right = group.ends[text] + place["start"], place["left"].astype(np.int64), place["right"].astype(np.int64)
        hot, right, anchor = right >= 128, right & 127, begin + left
        every = [(np.flatnonzero(~hot), 0, 0, left[~hot], right[~hot])]
        for i, (l, r) in enumerate(KEYS):  # the windows with l to the next key's l - 1 bytes before the anchor
            most = KEYS[i + 1][0] - 1 if i + 1 < len(KEYS) else SIDE
            a, b = np.minimum(left, most), np.minimum(right, SIDE - l)
            mine = np.flatnonzero(hot & (a >= l) & (b >= r) & (a + b >= SIDE))
            every.append((mine, l, r, a[mine], b[mine]))
        rolling = Rolling(group.data)
        which = np.concatenate([x[0] for x in every])
        hashed = np.concatenate([rolling(anchor[m] - l, anchor[m] + K + r) + U(l) for m, l, r, _, _ in every])
        left, right = (np.concatenate([x[k] for x in every]) for k in (3, 4))
        shard = ((hashed >> U(24)) % U(shards)).astype(np.int64)
        order, run, n, edge = per_shard(shard, text[which])
        which, hashed, left, right = which[order], hashed[order], left[order], right[order]
        out = np.zeros(len(which), PLACE)
        out["text"], out["left"], out["right"] = text[which], left, right
        out["start"] = anchor[which] - left - group.ends[text[which]]
        size, begin = left + K + right, run[edge]
        found.append(
            pa.table(
                [
                    pa.array(shard[order[begin]].astype(np.int32)),
                    pa.array(np.full(len(edge), key)),
                    grouped(group.doc[text[which[run]]], edge),
                    grouped(n.astype(np.int32), edge),
                    grouped(hashed, begin),
                    binaries(group.data[spread(anchor[which] - left, size)], np.append(0, np.cumsum(size))[np.append(begin, len(size))]),
                    grouped(out, begin),
                ],
                names=BODY_NAMES,
            )
        )
        return pa.concat_tables(found)

    def search(part: pa.Table) -> pa.Table:
        if part["shard"][0].as_py() < 0:
            return pa.table({"grp": part["grp"], "spans": part["places"]})
        doc = np.repeat(joined(part["docs"], np.int64), joined(part["counts"], np.int32))
        key, place, body = joined(part["keys"], U), joined(part["places"], PLACE), joined(part["bodies"], np.uint8)
        group = np.repeat(part["grp"].to_numpy(), [len(x) // 8 for x in part["keys"].to_pylist()])
        left, right = place["left"].astype(np.int64), place["right"].astype(np.int64)
        size = left + K + right
        start = np.cumsum(size) - size
        one, two = Rolling(body)(start, start + size) + left.astype(U), Rolling(body, BASES[1])(start, start + size)
        order = np.lexsort((doc, two, one, key))
        at = firsts(key[order], one[order], two[order])
        pick = order[at]  # of equal fragments the one of the smallest document
        flag = repeated_windows(body, start[pick], left[pick], right[pick], key[pick], doc[pick])
        windows = left + right - (SIDE - 1)
        begin = np.empty(len(order), np.int64)
        begin[order] = np.repeat(np.cumsum(windows[pick]) - windows[pick], sizes(at, len(order)))
        lowest = np.empty(len(order), np.int64)
        lowest[order] = np.repeat(doc[pick], sizes(at, len(order)))
        on = flag[spread(begin, windows)] | np.repeat(doc > lowest, windows)
        return by_group(*merged(*spans_of(group, place["text"], place["start"].astype(np.int64), windows, on)), "spans").select(["grp", "spans"])

    bodies = texts.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(cut_out, BODY)
    return bodies.groupBy("shard").applyInArrow(search, "grp long, spans binary")


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def without_repeats(docs: DataFrame) -> DataFrame:
    """REMOVED for each row of docs: kept holds the remaining bytes, which may cut a character.

    All is one plan, so that the texts, dealt into groups once, serve all steps.
    """

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        if not rows.num_rows:
            return schema.empty_table()
        group, spans = Group(rows), joined(known["spans"], SPAN)
        spans = spans[np.argsort(spans["text"], kind="stable")]
        lo, hi = np.searchsorted(spans["text"], group.place, "left"), np.searchsorted(spans["text"], group.place, "right")
        out = []
        for doc, t, a, b in zip(rows["doc"].to_pylist(), group.place.tolist(), lo.tolist(), hi.tolist(), strict=True):
            raw = group.data[group.ends[t] : group.ends[t + 1]]
            if a == b:
                out.append((doc, len(raw), 0, 0, raw.tobytes()))
                continue
            edge = np.bincount(spans["start"][a:b], minlength=len(raw) + 1) - np.bincount(spans["end"][a:b], minlength=len(raw) + 1)
            gone = np.cumsum(edge)[:-1] > 0
            out.append((doc, len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), raw[~gone].tobytes()))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(1, size // ((SIDE + 2) // 2 * SHARD))
    texts = identified(docs, max(1, size // SLICE))
    told = named(texts, asked(texts, shards), shards)
    found = searched(texts, told, shards * FINER)
    out = texts.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(run, REMOVED)
    return out.withColumn("doc_id", F.when(F.col("doc_id") < LAST, F.col("doc_id")))


def op8_run_length_index(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
