"""Near duplicates, lines, chunks and substrings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dayloom.llm import chunks, common, lines, neardup, suffix
from dayloom.llm.words import shingle_hashes, utf8, word_hashes

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(rows):
    sets = [(d, shingles(t), t) for d, t, *_ in rows]
    root = {d: d for d, _, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x, _) in enumerate(sets):
        for b, y, _ in sets[:i]:
            both = sum((x | y).values())
            if both and sum((x & y).values()) / both >= 0.8:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in root}


def set_classes(rows):
    """classes() for texts that hold no shingle twice, by one matrix product."""
    sets = [set(shingles(t)) for _, t in rows]
    place = {s: i for i, s in enumerate(set().union(*sets))}
    has = np.zeros((len(rows), len(place)), np.float32)
    for i, s in enumerate(sets):
        has[i, [place[x] for x in s]] = 1
    both, n = has @ has.T, has.sum(axis=1)
    label = np.array([d for d, _ in rows])
    for i, j in np.argwhere(both >= 0.8 * (n[:, None] + n[None, :] - both) - 1e-4):
        if label[i] != label[j]:
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    return {d: int(x) for (d, _), x in zip(rows, label, strict=True)}


def test_words_and_shingles_are_those_of_the_pattern():
    texts = ["A b-c, É d1!", "", "one two", None, "x " * 7, "trailing word"]
    data, ends = utf8(pa.array(texts))
    _, at = word_hashes(data, ends)
    assert np.diff(at).tolist() == [len(WORD.findall((t or "").lower())) for t in texts]
    _, of = shingle_hashes(*word_hashes(data, ends))
    assert np.bincount(of, minlength=6).tolist() == [sum(shingles(t).values()) for t in texts]


def test_signatures_agree_as_often_as_texts_are_similar(rows):
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" if i % 40 else "x" for i in range(400))
    x, y = shingles(a), shingles(b)
    true = sum((x & y).values()) / sum((x | y).values())
    h, of = shingle_hashes(*word_hashes(*utf8(pa.array([a, b]))))
    s = neardup.dart_signatures(*neardup.weighted_cells(h, of), 2, 1024)
    assert abs((s[0] == s[1]).mean() - true) < 0.06


def test_near_duplicates(docs, rows):
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == classes(rows)


def test_links_that_no_star_has_are_found(spark):
    base = [f"w{i}" for i in range(200)]
    texts = []
    for j in range(30):  # a chain: each is close to the next, the ends are far apart
        w = list(base)
        for k in range(0, 2 * j):
            w[(k * 5) % 200] = "x"
        texts.append((j, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == classes(texts)


def near_copies(n):
    """Copies of one text with 1 to 12 changed words each: most pairs are a little under the threshold."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    out = []
    for j in range(n):
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 13)):
            w[k] = f"x{j}y{k}"
        out.append((j, " ".join(w)))
    return out


@pytest.mark.parametrize("one_task", [True, False])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(common, "ONE_TASK", 200 if one_task else 1)
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (60, 50), (70, 70), (80, 81), (81, 80), (None, 5)]
    got = {r.node: r.label for r in common.min_label_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40, 80: 80, 81: 80}
    assert common.min_label_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [64, 4096])
def test_a_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = near_copies(700)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    expected = set_classes(texts)
    assert got == expected and 100 < len(set(expected.values())) < 600


def test_the_bound_settles_most_of_a_group_and_rows_grow_in_proportion(spark):
    open_, pairs = {}, {}
    for n in (300, 1200):
        df = spark.createDataFrame(near_copies(n), "doc_id long, text string")
        cells = neardup.cells_of(df)
        named = df.selectExpr("1L as bh", "doc_id as rep", "doc_id as label")
        left = neardup.still_open(named, cells, 0.8)
        open_[n], pairs[n] = left.count(), neardup.star_pairs(left, 3).count()
    assert open_[300] < 200 and open_[1200] < 5 * open_[300] and pairs[1200] <= 2 * open_[1200]


def test_blocks_are_compared_exactly(spark, monkeypatch):
    texts = near_copies(120)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    named = df.selectExpr("doc_id % 2 as bh", "doc_id as rep", "doc_id as label")
    members = named.join(neardup.cells_of(df).select("rep", "n"), "rep")
    links = [(r.a, r.b) for r in neardup.across(members, neardup.cells_of(df), 0.8).collect()]
    root = {d: d for d, _ in texts}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    whole = spark.createDataFrame([(0, d, d) for d, _ in texts], "bh long, rep long, label long").join(neardup.cells_of(df).select("rep", "n"), "rep")
    monkeypatch.setattr(neardup, "BLOCK", 17)
    links_ = {frozenset((r.a, r.b)) for r in neardup.across(whole, neardup.cells_of(df), 0.8).collect()}
    every = set_classes(texts)
    assert all(every[a] == every[b] for a, b in links_) and len(links_) >= len(texts) - len(set(every.values()))
    even, odd_ = (set_classes([t for t in texts if t[0] % 2 == k]) for k in (0, 1))
    assert root == even | odd_


def test_near_duplicates_of_odd_rows(odd, none):
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in neardup.near_duplicates(odd).collect())
    assert got == [(0, 0)] * 3 + [(1, 1), (2, 2), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7), (7, 7), (8, 8)]
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == 9  # one row of each id, and of each text without one


def line_results(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    first, held = {}, {}
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), d), d)
                held.setdefault(key(x), set()).add(d)
    return {d: "\n".join(x for x in (t or "").split("\n") if len(held.get(key(x), ())) < 2 or first[key(x)] == d) for d, t, *_ in rows}


def test_lines(docs, rows):
    assert {r.doc_id: r.kept for r in lines.drop_repeated_lines(docs).collect()} == line_results(rows)


def test_line_index_forgets_and_learns(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 2)
    monkeypatch.setattr(lines, "PROBED", 5)
    index = lines.LineIndex.insert(docs.where("doc_id >= 20"))
    index = lines.LineIndex.insert(docs.where("doc_id < 20 or doc_id = 21"), index)
    gone = docs.where("doc_id % 8 = 1 or doc_id = 3 or doc_id between 60 and 63").select("doc_id")
    before, index = index, index.delete(gone)
    left = [r for r in rows if r[0] % 8 != 1 and r[0] not in (3, 60, 61, 62, 63)]
    out = lines.drop_repeated_lines(docs.join(gone, "doc_id", "left_anti"), index)
    assert {r.doc_id: r.kept for r in out.collect()} == line_results(left)
    fresh = lines.LineIndex.insert(docs.join(gone, "doc_id", "left_anti"))
    counted = lambda x: {(r.k, r.k2): (r.n, r["first"]) for r in x.counts.collect()}
    common = lambda x: {k for (k, _), (n, _) in counted(x).items() if n > 1}
    assert counted(index) == counted(fresh) and common(before) - common(index)
    # the filters have forgotten the keys whose count fell, and hold all others
    held = {}
    for r in index.filters.withColumn("keys", F.lit(None)).collect():
        held[r["shard"]] = lines.CuckooFilter(table=r["filter"])
    knows = lambda k: held[(k >> 20) % index.shards].contains(np.array([k]))[0]
    assert all(knows(k) for k in common(index)) and not any(knows(k) for k in common(before) - common(index))


def test_a_filter_that_is_full_is_built_anew(spark):
    texts = [(d, "\n".join(f"a line that two have {i}" for i in range(1 if d < 2 else 300))) for d in range(4)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    index = lines.LineIndex.insert(df.where("doc_id > 1"), lines.LineIndex.insert(df.where("doc_id < 2")))
    assert {r.doc_id: r.kept for r in lines.drop_repeated_lines(df, index).collect()} == line_results([(d, t) for d, t in texts])


def test_line_places(docs):
    for r in lines.drop_repeated_lines(docs).collect():
        x = (r.text or "").split("\n")
        assert r.n_lines == len(x) and r.kept == "\n".join(y for i, y in enumerate(x) if i not in r.lost)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys, other = rng.integers(-(2**62), 2**62, 20_000), rng.integers(-(2**62), 2**62, 20_000)
    f = lines.CuckooFilter.of(keys)
    assert f.contains(keys).all() and f.contains(other).mean() < 0.001
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.01
    assert lines.CuckooFilter(table=f.dump()).contains(keys[10_000:]).all()


def test_lines_move_each_text_once(docs):
    node = lines.drop_repeated_lines(docs)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    assert node.left().output().size() == 1


def test_lines_of_odd_rows(odd, none):
    out = lines.drop_repeated_lines(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    got = {r.doc_id: r.kept for r in out.where("doc_id in (1, 2, 3, 4, 5)").collect()}
    assert got[1] == got[2] == got[4] == "" and got[3].endswith("end") and got[5] == " \n\t\n "
    assert lines.drop_repeated_lines(none).count() == 0


def test_gear_hash_by_definition():
    data = np.frombuffer("the quick brown fox jumps over the lazy dog — and on it goes".encode(), np.uint8)
    h, out = 0, []
    for b in data.tolist():
        h = (2 * h + int(chunks.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    assert chunks.gear_hash(data).tolist() == out


def cut_points(raw):
    """Ends of the chunks of raw, byte by byte."""
    h, last, wanted, cuts = 0, 0, False, []
    inside = lambda p: p < len(raw) and raw[p] & 0xC0 == 0x80
    for p in range(1, len(raw) + 1):
        h = (2 * h + int(chunks.GEAR[raw[p - 1]])) & 0xFFFFFFFF
        wanted = wanted or h >> (32 - chunks.BITS) == 0
        if inside(p):
            continue
        if wanted and p - last >= chunks.MIN and p < len(raw):
            cuts.append(p)
            last = p
        wanted = False
        if p - last == chunks.MAX and p < len(raw):
            cuts.append(p)
            last = p
    if len(raw) - last < chunks.MIN and cuts:
        cuts.pop()
    return [*cuts, len(raw)] if raw else []


def test_chunks_end_where_the_definition_says():
    rng = random.Random(9)
    for n in (0, 10, 63, 64, 200, 5000, 20_000):
        raw = "".join(rng.choice("abcdefgh é\n") for _ in range(n)).encode()
        assert chunks.boundaries(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] == cut_points(raw)
    raw = b"x" * 4000  # no boundary of its own: cut at MAX
    assert chunks.boundaries(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] == cut_points(raw)


def test_chunks(docs, rows):
    seen, expected = set(), {}
    for d, t, *_ in sorted(rows):
        raw, kept, last = t.encode(), [], 0
        cuts = cut_points(raw)
        for p in cuts:
            raw[last:p].decode()
            if raw[last:p] not in seen:
                kept.append(raw[last:p])
            seen.add(raw[last:p])
            last = p
        expected[d] = (len(cuts), b"".join(kept).decode())
    assert {r.doc_id: (r.n_chunks, r.kept) for r in chunks.without_repeats(docs).collect()} == expected


def test_chunks_resist_insertions():
    a = np.frombuffer((" ".join(f"w{i * i}" for i in range(900))).encode(), np.uint8)
    b = np.concatenate([np.frombuffer(b"something new ", np.uint8), a])
    cut = lambda x: {x[i:j].tobytes() for i, j in zip([0, *c], c, strict=False)} if (c := chunks.boundaries(x, np.array([0, len(x)]))[0]) else set()
    assert len(cut(a) & cut(b)) >= len(cut(a)) - 2


def test_chunks_of_odd_rows(odd, none):
    out = chunks.without_repeats(odd)
    assert out.count() == odd.count()
    got = {r.doc_id: (r.n_chunks, r.kept) for r in out.where("doc_id in (1, 2, 4)").collect()}
    assert got == {1: (0, ""), 2: (0, ""), 4: (got[4][0], "")} and got[4][0] > 0
    assert chunks.without_repeats(none).count() == 0


def substring_results(rows):
    first, out = {}, {}
    for d, t, *_ in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], d) < d:
                gone[i : i + 50] = True
        out[d] = (int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("small", [False, True])
def test_substrings(docs, rows, monkeypatch, small):
    if small:  # many slices and shards, and every anchor is hot
        monkeypatch.setattr(suffix, "SLICE", 700)
        monkeypatch.setattr(suffix, "SHARD", 50)
        monkeypatch.setattr(suffix, "HOT", 1)
    out = suffix.without_repeats(docs).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    assert {r.doc_id: (r.n_removed, r.n_spans, r.sha) for r in out.collect()} == substring_results(rows)


def test_substrings_of_the_supplied_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 30_000)
    monkeypatch.setattr(suffix, "HOT", 5)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = suffix.without_repeats(df).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    assert {r.doc_id: (r.n_removed, r.n_spans, r.sha) for r in out.collect()} == substring_results([tuple(r) for r in df.collect()])


def test_matching_statistics_by_definition():
    rng = np.random.default_rng(3)
    base, other = ([rng.integers(0, 3, n) for n in rng.integers(1, 40, 60)] for _ in range(2))
    symbols = np.concatenate([np.append(x + 60, i) for i, x in enumerate(base)])
    index = suffix.Index(symbols, 64)
    assert len(index.run) < len(symbols)
    length = np.array([len(x) for x in other])
    held = {x[i:j].tobytes() for x in base for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    for on, at, size in index.matching_statistics(np.concatenate(other) + 60, np.cumsum(length) - length, length):
        for f, i, n in zip(on.tolist(), at.tolist(), size.tolist(), strict=True):
            x = other[f][i:]
            assert n == max((k for k in range(len(x) + 1) if not k or x[:k].tobytes() in held))


def test_substrings_of_odd_rows(odd, none):
    out = suffix.without_repeats(odd)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in out.where("doc_id in (1, 2, 3, 4)").collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (150003, 0), 4: (150003, 150003)} and out.count() == odd.count()
    assert suffix.without_repeats(none).count() == 0
