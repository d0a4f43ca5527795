"""Log-probabilities of texts under a weighted backoff automaton of word n-grams.

A text is its words, A-Z as a-z, then one end; a mark that is never scored
stands before it. n-grams of up to ORDER tokens are counted over all training
documents, none left out. Smoothing, for a token w after a history h whose last
tokens but the first are h':

    p(w | h) = (c(hw) + PRIOR p(w | h')) / (c(h) + PRIOR),   p(w) = c(w) / (N + 1)

and 1 / (N + 1) for a word that training has not, so that each state's
probabilities sum to 1. States are the histories that training has, the empty
one included. A state has an arc for each n-gram seen, with log10 p, and a
failure arc to h' with log10 (PRIOR / (c(h) + PRIOR)). A text is read once from
left to right: from the state of the tokens before, failure arcs are taken until
there is an arc for the token. The state after a token is the longest history
that ends there and that training has, so it is found for all places of many
texts at once.

The counts grow with the corpus, so the automaton is never whole in one place.
Documents are dealt into groups of about GROUP_BYTES, in one shuffle. A group
asks for its distinct n-grams, with its own training counts, at the shards that
hold ranges of their hashes; a shard adds up what its groups have, and answers
each with the totals; a group makes the states and arcs that its texts can
reach. So a frequent word is one row a group, whatever its share. Only n-grams
that may be in another group are asked for: from three tokens on, those whose
first and last n - 1 tokens both are; the counts of all others are known where
they are. Words are compared as they are, longer n-grams by KEY_BITS of a hash
among the SHARD_KEYS or so of their shard: one in a hundred million shares the
count of another, at any size of the corpus.

A null text is empty: one token, the end. Rows with a null doc_id are scored and
neither learned from nor held out. Repeated rows are documents of their own. A
text is held in one task with about 100 bytes a byte of it. Without training
documents nothing is known, and each token costs nothing. An empty table gives
no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .words import FOLD, U, mix, numbered_words, slices

ORDER = 3
#: For histories of 1, 2, ... tokens.
PRIOR = (500.0, 20.0)
GROUP_BYTES, SHARD_KEYS, KEY_BITS = 11_000_000, 2_000_000, 48
START, END = b"\t", b"\n"
#: Bytes of a word: all but white space.
INSIDE = np.ones(256, bool)
INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_STEP = U(0xD6E8FEB86659FD93)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def planes(x: np.ndarray) -> bytes:
    """64-bit integers byte plane by byte plane, so that equal high bytes lie together and pack well."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def packed(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as steps: the low halves, which are noise, and the high ones, which are small."""
    steps = np.diff(keys, prepend=U(0))
    return steps.astype(np.uint32).tobytes(), zlib.compress((steps >> U(32)).astype(np.uint32).tobytes(), 1)


def unpacked(low: bytes, high: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(low, np.uint32).astype(np.int64) | np.frombuffer(zlib.decompress(high), np.uint32).astype(np.int64) << 32)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, by value, and the number of each place's value."""
    order = np.argsort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    number = np.empty(len(x), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], number


class Grams:
    """The distinct n-grams of texts, and which one ends at each place.

    at[n - 1] has the n-gram's number for each place, -1 where the text has no
    n tokens yet; place[n - 1] a place of each number.
    """

    def __init__(self, texts: pa.Array, order: int = ORDER):
        number, words, starts = numbered_words(texts, INSIDE, FOLD)
        self.words = [*words.to_pylist(), START, END] if len(texts) else []
        size = len(self.words)
        ends = np.append(0, np.cumsum(np.diff(starts) + 2))
        self.begin, seq = ends[:-1], np.full(ends[-1], -1, np.int32)
        seq[self.begin], seq[ends[1:] - 1] = size - 2, size - 1
        seq[seq < 0] = number
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
        nth = np.arange(len(seq), dtype=np.int32) - self.begin[self.text].astype(np.int32)
        place = np.zeros(size, np.int64)
        place[seq] = np.arange(len(seq))
        self.at, self.place = [seq], [place]
        for n in range(2, order + 1):
            ends_here = np.flatnonzero(nth >= n - 1)
            place, number = distinct(self.at[-1][ends_here - 1].astype(np.int64) * max(1, size) + seq[ends_here])
            ids = np.full(len(seq), -1, np.int32)
            ids[ends_here] = number
            self.at.append(ids)
            self.place.append(ends_here[place])

    def counts(self, n: int, chosen: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in the chosen texts."""
        on = (self.at[n - 1] >= 0) & chosen[self.text]
        return np.bincount(self.at[n - 1][on], minlength=len(self.place[n - 1]))

    def keys(self, n: int) -> np.ndarray:
        """64-bit hashes of the n-grams of length n."""
        words = np.empty(len(self.words), object)
        words[:] = self.words
        word = out = mix(pd.util.hash_array(words, categorize=False))
        for k in range(2, n + 1):
            place = self.place[k - 1]
            out = mix(out[self.at[k - 2][place - 1]] * _STEP + word[self.at[0][place]])
        return out

    def open(self, n: int, shared: list[np.ndarray]) -> np.ndarray:
        """The n-grams that another group may have, from what is known of shorter ones."""
        place = self.place[n - 1]
        if n <= 2:
            return np.arange(len(place))
        return np.flatnonzero(shared[n - 2][self.at[n - 2][place - 1]] & shared[n - 2][self.at[n - 2][place]])

    def dealt(self, n: int, shards: int, shared: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the open n-grams by shard and key, where each shard's begin, their keys)."""
        chosen = self.open(n, shared)
        key = self.keys(n)[chosen]
        order = np.argsort(key)
        key = key[order]
        begins = np.array([(k << 64) // shards for k in range(shards)], U)
        cuts = np.append(np.searchsorted(key, begins), len(key))
        key -= np.repeat(begins, np.diff(cuts))
        return chosen[order], cuts, key >> U(max(0, ((1 << 64) // shards).bit_length() - KEY_BITS))

    def told(self, train: np.ndarray, answers: pa.Table | None, shards: int, longest: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each length up to longest: counts over all training texts, and whether another group has the n-gram."""
        said: dict[int, dict[int, bytes]] = {}
        for n, shard, more in zip(*(answers[c].to_pylist() for c in ("n", "shard", "more")), strict=True) if longest else ():
            said.setdefault(n, {})[shard] = more
        counts: list[np.ndarray] = []
        shared: list[np.ndarray] = []
        for n in range(1, longest + 1):
            total, other = self.counts(n, train), np.zeros(len(self.place[n - 1]), bool)
            chosen, cuts, _ = self.dealt(n, shards, shared)
            if len(chosen):
                more = np.concatenate([unplaned(said[n][shard]) for shard in np.flatnonzero(np.diff(cuts)).tolist()])
                total[chosen] += more >> 1
                other[chosen] = more & 1
            counts.append(total)
            shared.append(other)
        return counts, shared


class Automaton:
    """States and arcs for some n-grams, from their counts in training."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, prior: tuple[float, ...] = PRIOR):
        self.grams, self.counts = grams, counts
        p = np.maximum(counts[0], 1) / (tokens + 1)
        self.arc, self.failure = [np.log10(p)], []
        for n in range(2, len(counts) + 1):
            place, k = grams.place[n - 1], prior[n - 2]
            history = counts[n - 2][grams.at[n - 2][place - 1]]
            p = (counts[n - 1] + k * p[grams.at[n - 2][place]]) / (history + k)
            self.arc.append(np.log10(p))
            self.failure.append(np.log10(k / (counts[n - 2] + k)))

    def read(self) -> np.ndarray:
        """log10 of the probability of the token at each place, 0 for the marks before the texts."""
        g = self.grams
        known = [np.append(c > 0, False)[ids] for ids, c in zip(g.at, self.counts, strict=True)]  # False for -1
        length = np.zeros(len(g.text), np.int64)  # of the state's history after each place
        for n in range(1, len(known)):
            length[known[n - 1]] = n
        before = np.append(0, length[:-1])
        out, open_ = np.zeros(len(g.text)), np.ones(len(g.text), bool)
        open_[g.begin] = False
        for n in range(len(known), 0, -1):
            here = open_ & (before >= n - 1)
            taken = here if n == 1 else here & known[n - 1]
            out[taken] += self.arc[n - 1][g.at[n - 1][taken]]
            open_ &= ~taken
            if n > 1:
                failed = np.flatnonzero(here & open_)
                out[failed] += self.failure[n - 2][g.at[n - 2][failed - 1]]
        return out


def sizes(docs: DataFrame) -> tuple[int, int, int]:
    """Bytes and tokens of all texts, tokens of training texts. docs: text, train."""

    def run(batches):
        total = [0, 0, 0]
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(0)
                _, _, at = numbered_words(texts, INSIDE, FOLD)
                n = np.diff(at) + 1
                total = [total[0] + texts.nbytes, total[1] + int(n.sum()), total[2] + int(n[part.column(1).to_numpy(zero_copy_only=False)].sum())]
        yield pa.RecordBatch.from_pydict({"bytes": [total[0]], "tokens": [total[1]], "train": [total[2]]})

    r = docs.select("text", "train").mapInArrow(run, "bytes long, tokens long, train long").agg(F.sum("bytes"), F.sum("tokens"), F.sum("train")).first()
    return tuple(x or 0 for x in r)


ASKED = "shard int, n int, grp long, keys binary, high binary, counts binary"


def asked(t: pa.Table, answers: pa.Table | None, shards: int, lengths: tuple[int, ...]) -> pa.Table:
    """ASKED: the open n-grams of a group of documents with their counts there, a row a shard and length. answers: those to all shorter ones."""
    train, texts = t["train"].to_numpy(), t["text"].combine_chunks()
    grams = Grams(texts, lengths[-1])
    rows: dict[str, list] = {c: [] for c in ("shard", "n", "grp", "keys", "high", "counts")}
    shared = grams.told(train, answers, shards, lengths[0] - 1)[1]
    for n in lengths:
        chosen, cuts, key = grams.dealt(n, shards, shared)
        counts = grams.counts(n, train)[chosen]
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[shard], cuts[shard + 1]
            keys = (b" ".join(grams.words[i] for i in chosen[a:b].tolist()), b"") if n == 1 else packed(key[a:b])
            for c, v in zip(rows, (shard, n, t["grp"][0].as_py(), *keys, planes(counts[a:b])), strict=True):
                rows[c].append(v)
    return pa.table(rows, schema=pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("grp", pa.int64()), ("keys", pa.binary()), ("high", pa.binary()), ("counts", pa.binary())]))


def answered(t: pa.Table) -> pa.Table:
    """(grp, n, shard, more, words): for each n-gram asked for, twice what other groups add to its count, plus one if another group has it; words, on one row a shard, is the number of words that training has."""
    out = []
    for n in sorted(set(t["n"].to_pylist())):
        rows = t.filter(pc.equal(t["n"], n))
        keys = [pa.array(k.split(b" "), pa.large_binary()) if n == 1 else pa.array(unpacked(k, h)) for k, h in zip(rows["keys"].to_pylist(), rows["high"].to_pylist(), strict=True)]
        counts = np.concatenate([unplaned(b) for b in rows["counts"].to_pylist()])
        words = np.zeros(len(keys), np.int64)
        if n == 1:
            every = pa.concat_arrays(keys).dictionary_encode()
            number, token = every.indices.to_numpy(), pc.not_equal(every.dictionary, START).to_numpy(zero_copy_only=False)
        else:
            number = distinct(pa.concat_arrays(keys).to_numpy())[1]
        total = np.zeros(number.max() + 1, np.int64)
        np.add.at(total, number, counts)
        more = 2 * (total[number] - counts) + (np.bincount(number)[number] > 1)
        more = np.split(more, np.cumsum([len(k) for k in keys])[:-1])
        if n == 1:
            words[0] = np.count_nonzero(token & (total > 0))
        out.append(pa.table({"grp": rows["grp"], "n": rows["n"], "shard": rows["shard"], "more": pa.array([planes(m) for m in more], pa.binary()), "words": words}))
    return pa.concat_tables(out)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, words long"


def scored(t: pa.Table, answers: pa.Table, shards: int, tokens: int, order: int, prior: tuple[float, ...]) -> pa.Table:
    """SCORED for a group of documents; words, what its shards told, on the first row."""
    grams = Grams(t["text"].combine_chunks(), order)
    train = t["train"].to_numpy()
    counts, _ = grams.told(train, answers, shards, order)
    log_p = Automaton(grams, counts, tokens, prior).read()
    c = counts[0][grams.at[0]]
    real = np.ones(len(c), bool)
    real[grams.begin] = False
    each = lambda x: np.add.reduceat(np.where(real, x, 0), grams.begin)
    words = np.zeros(t.num_rows, np.int64)
    words[0] = sum(answers["words"].to_pylist())
    return pa.table({"doc_id": t["doc_id"], "held_out": t["held_out"], "n_tokens": each(np.ones(len(c), np.int64)), "n_known": each((c > 0).astype(np.int64)), "log_counts": each(np.log10(c + 1.0)), "score": each(log_p), "words": words})


def score(docs: DataFrame, order: int = ORDER, prior: tuple[float, ...] = PRIOR, group_bytes: int = GROUP_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    base_score takes each token by itself, with one added to its count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = is_held_out(F.col("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held_out"), (~held & F.col("doc_id").isNotNull()).alias("train"))
    size, every, tokens = sizes(rows)
    groups, shards = max(1, math.ceil(size / group_bytes)), max(1, math.ceil(every * order / shard_keys))
    # the place in the files deals repeated rows out as well; a task that is run again gives the same
    rows = rows.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    by_group, answers = rows.groupBy("grp"), None
    first = lambda lengths: lambda t: asked(t, None, shards, lengths)
    later = lambda lengths: lambda t, a: asked(t, a, shards, lengths)
    for lengths in [tuple(range(1, min(2, order) + 1)), *((n,) for n in range(3, order + 1))]:
        if answers is None:
            asks = by_group.applyInArrow(first(lengths), ASKED)
        else:
            asks = by_group.cogroup(answers.groupBy("grp")).applyInArrow(later(lengths), ASKED)
        new = asks.groupBy("shard").applyInArrow(answered, "grp long, n int, shard int, more binary, words long")
        answers = new if answers is None else answers.unionByName(new)
    found = cut(by_group.cogroup(answers.groupBy("grp")).applyInArrow(lambda t, a: scored(t, a, shards, tokens, order, prior), SCORED))
    words = found.agg(F.sum("words")).first()[0] or 0
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(math.log10(tokens + words + 1))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op11_backoff_automaton(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
