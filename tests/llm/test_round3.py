"""The backoff automaton, the source audit and the vector codes, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.llm import backoff, chunks, divergence, lines, neardup, vectorcodes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- backoff automaton


def by_hand(rows, order=3, prior=backoff.PRIOR):
    """Each row's result by an automaton of dicts that reads one token after the other."""
    seqs = [["<s>", *WORD.findall(fold(t)), "</s>"] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    learned = [d is not None and not h for (d, _), h in zip(rows, held)]
    count = Counter()
    for seq, on in zip(seqs, learned):
        for n in range(1, order + 1):
            for i in range(len(seq) - n + 1):
                count[tuple(seq[i : i + n])] += on
    count = +count
    tokens = sum(c for g, c in count.items() if len(g) == 1 and g != ("<s>",))
    words = sum(1 for g in count if len(g) == 1 and g != ("<s>",))

    def arc(h, w):
        if not h:
            return max(1, count[(w,)]) / (tokens + 1)
        return (count[(*h, w)] + prior[len(h) - 1] * arc(h[1:], w)) / (count[h] + prior[len(h) - 1])

    out = []
    for (d, _), seq, h in zip(rows, seqs, held):
        state, total = ("<s>",) if order > 1 and count[("<s>",)] else (), 0.0
        for w in seq[1:]:
            while state and not count[(*state, w)]:
                total += math.log10(prior[len(state) - 1] / (count[state] + prior[len(state) - 1]))
                state = state[1:]
            total += math.log10(arc(state, w))
            state = (*state, w)
            while state and (len(state) >= order or not count[state]):
                state = state[1:]
        base = sum(math.log10((count[(w,)] + 1) / (tokens + words + 1)) for w in seq[1:])
        out.append((d, h, len(seq) - 1, sum(count[(w,)] > 0 for w in seq[1:]), tokens, base, total))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("group_bytes, shard_keys", [(16_000_000, 4_000_000), (3000, 400)])
def test_scores_by_hand(docs, rows, group_bytes, shard_keys):
    got = backoff.score(docs, group_bytes=group_bytes, shard_keys=shard_keys).collect()
    same(got, by_hand([(r[0], r[1]) for r in rows]))


def test_scores_of_odd_rows(odd):
    want = by_hand([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    same(backoff.score(odd, group_bytes=50_000, shard_keys=50).collect(), want)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_scores_of_other_orders(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("aA b c d É e".split()) for _ in range(rng.randrange(0, 30)))) for i in range(80)]
    prior = (3.0, 2.0, 1.0)
    same(backoff.score(spark.createDataFrame(rows, "doc_id long, text string"), order=order, prior=prior, group_bytes=300, shard_keys=40).collect(), by_hand(rows, order, prior))


def test_probabilities_after_a_history_sum_to_one(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(20))) for i in range(30)]
    learned = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 != 2}
    words = sorted({w for d, t in rows if d in learned for w in t.split()} | {"</s>", "never"})
    count = sum(20 + 1 for _ in learned)
    # p(w | a b) for every w, from texts that differ in their last word alone
    texts = [(None, f"a b {w}") for w in words if w != "</s>"]
    got = {}
    scored = backoff.score(spark.createDataFrame([*rows, *texts, (None, "a b")], "doc_id long, text string"), prior=(3.0, 2.0))
    both = by_hand([*rows, *texts, (None, "a b")], prior=(3.0, 2.0))
    same(scored.collect(), both)
    assert both[0][4] == count
    # the automaton itself: every arc out of the state (a, b)
    g = backoff.Grams(backoff.pa.array([t for _, t in rows if _ in learned] + [t for _, t in texts] + ["a b"]))
    chosen = np.arange(len(learned) + len(texts) + 1) < len(learned)
    made = backoff.Automaton(g, [g.counts(n, chosen) for n in (1, 2, 3)], count, (3.0, 2.0)).read()
    ends = np.append(g.begin[1:], len(g.text))
    for i, w in enumerate([*(t.split()[-1] for _, t in texts), "</s>"]):
        k = len(learned) + i
        place = ends[k] - 1 if w == "</s>" else g.begin[k] + 3
        got[w] = 10 ** made[place]
    assert math.isclose(sum(got.values()), 1.0, rel_tol=1e-9)


def test_no_documents_and_none_to_learn_from(spark, none):
    assert backoff.score(none).collect() == []
    got = backoff.score(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    same(got, by_hand([(None, "a b"), (None, None)]))


def test_the_model_beats_single_tokens_on_held_out_texts(spark):
    rng = random.Random(2)
    follow = {w: [f"w{rng.randrange(60)}" for _ in range(3)] for w in (f"w{i}" for i in range(60))}

    def text():
        w, out = "w0", []
        for _ in range(60):
            w = rng.choice(follow[w])
            out.append(w)
        return " ".join(out)

    got = backoff.score(spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.6 * got[1]


# --- source divergence


def audited(rows):
    docs = [(lang or "", source or "", Counter(TERM.findall(fold(text)))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        within = Counter(t for d in mine for t in d[2])
        kept = sorted(t for t, n in within.items() if n >= 3)
        whole, by = Counter(), defaultdict(Counter)
        for _, s, c in mine:
            by[s] += Counter({t: n for t, n in c.items() if within[t] >= 3})
            whole += Counter({t: n for t, n in c.items() if within[t] >= 3})
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        for s, c in by.items():
            pairs = [(sum((p(c, t) - p(o, t)) ** 2 // p(o, t) for t in kept), i) for i, o in by.items() if i != s]
            terms = [((p(c, t) - p(whole, t)) ** 2 // p(whole, t), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(found, 1) if part == "pair" or k <= 200]
    return sorted(out)


def test_divergence_of_every_pair_and_term(docs, rows):
    assert sorted(map(tuple, divergence.audit(docs).collect())) == audited([(r[2], r[3], r[1]) for r in rows])


def test_divergence_of_odd_rows(odd, none):
    got = sorted(map(tuple, divergence.audit(odd).collect()))
    assert got == audited([(r.lang, r.source, r.text) for r in odd.select("lang", "source", "text").collect()]) and any(r[2] == "pair" and r[4] == 0 for r in got)
    assert divergence.audit(none).collect() == []


def test_divergence_laid_out_in_small_pieces(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.choice(["x", "y", None]), rng.choice(["s", "t", "u", ""]), " ".join(rng.choice(["Ä", "b", "Cc", "d1e", "f-g"]) + rng.choice("hijkl") for _ in range(12))) for _ in range(90)]
    monkeypatch.setattr(divergence, "CELLS", 12)
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string")).collect())) == audited(rows)


def test_runs_meet_at_both_borders():
    columns = np.array([[0, 0, 1, 1, 1, 2], [0, 1, 1, 1, 0, 0]])
    p = [np.array([10, 20, 30]), np.array([7, 9])]
    number = np.array([1, 2, 3, 1, 1, 5])
    got = divergence.pair_sums(columns, number, p)
    for i, j in ((0, 1), (1, 0)):
        assert got[i][j] == sum(n * ((p[i][x] - p[j][y]) ** 2 // p[j][y]) for x, y, n in zip(columns[i], columns[j], number))


# --- vector codes


def coded(rows):
    """Every part against every entry, in Python's integers."""
    kept = sorted(((i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v] for _, v, _ in kept]
    w = len(whole[0]) // 4
    parts = [[v[k * w : (k + 1) * w] for k in range(4)] for v in whole]
    books = [[p[k] for p in parts[:256]] for k in range(4)]
    find = lambda p, k: min((sum((a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(books[k]))
    for _ in range(4):
        new = []
        for k in range(4):
            of = [find(p[k], k)[1] for p in parts]
            new.append([[sum(x) // n for x in zip(*(p[k] for p, o in zip(parts, of) if o == i))] if (n := of.count(i)) else books[k][i] for i in range(len(books[k]))])
        books = new
    out = []
    for (i, _, lab), p in zip(kept, parts):
        found = [find(p[k], k) for k in range(4)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vectors(spark, rows, type_="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{type_}>, label int, code string, near string").repartition(3)


def check_codes(spark, rows, type_="double"):
    got, books = vectorcodes.compress(vectors(spark, [(*r, "c", "n") for r in rows], type_))
    want, digest = coded(rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert sorted(map(tuple, got.select("vec_id", "label", "code", "error").collect()), key=order) == sorted(want, key=order)
    assert books.digest() == digest


def test_codes_of_clusters_ties_and_repeats(spark):
    rng = random.Random(4)
    near = lambda: [round(rng.choice([-1, 0, 1]) + rng.gauss(0, 0.02), 3) for _ in range(8)]
    rows = [(i, near(), rng.choice([1, 2, None])) for i in range(330)]
    rows += [(i % 5, rows[7][1], 3) for i in range(40)]  # one vector many times, ids repeated
    rows += [(None, near(), 1), (None, near(), None), (900, None, 1), (901, [1.0] * 7 + [None], 2), (902, [math.nan] * 8, 2), (903, [math.inf] + [0.0] * 7, 2), (904, [-0.0, -1e-300, 1e-300, 0.5 / 1024, -0.5 / 1024, 1.0, -1.0, 3.0], 1)]
    check_codes(spark, rows)


def test_codes_of_large_components(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([1.0, 1e6, -3e9, 1e25, 0.1]) * rng.random() for _ in range(4)], 1) for i in range(60)]
    want, digest = coded(rows)
    got, books = vectorcodes.compress(vectors(spark, [(*r, "c", "n") for r in rows]))
    assert {r.vec_id: r.code for r in got.collect()} == {i: c for i, _, c, _ in want} and books.digest() == digest
    assert {r.vec_id: r.error for r in got.collect()} == {i: e if e < 2**63 else None for i, _, _, e in want}


def test_codes_of_few_empty_and_unequal_vectors(spark):
    check_codes(spark, [(1, [0.5, -0.5, 1.0, 2.0], 1), (2, [0.5, -0.5, 1.0, 2.0], 1)], "float")
    check_codes(spark, [(1, [], 1), (2, [], None)])
    assert vectorcodes.compress(vectors(spark, []))[0].collect() == []
    got = vectorcodes.compress(vectors(spark, [(1, [1.0] * 4, 1, "", ""), (2, [1.0] * 8, 1, "", ""), (3, [2.0] * 4, 1, "", "")]))[0]
    assert {r.vec_id: r.code for r in got.collect()} == {1: "00000000", 2: None, 3: "01010101"}
    got, books = vectorcodes.compress(vectors(spark, [(1, [1.0] * 5, 1, "", "")]))
    assert books is None and got.first().code is None


def test_bounds_spare_evaluations_and_lose_none():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (256, 6))
    x = centres[rng.integers(0, 256, 3000)] + rng.integers(-40, 40, (3000, 6))
    pivots = vectorcodes.pivots_of(centres)
    root = lambda a: np.sqrt(vectorcodes.squared(a, pivots).astype(float))
    who, best, done = vectorcodes.nearest(x, root(x), centres, root(centres))
    d = vectorcodes.squared(x, centres)
    assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and done < 0.1 * d.size


# --- SQL


@pytest.mark.parametrize("name, build, sql, table", [("op12", divergence.op12_source_divergence, divergence.OP12_SQL, "documents"), ("op13", vectorcodes.op13_laesa_vector_codes, vectorcodes.OP13_SQL, "embeddings")])
def test_queries_against_their_sql(spark, name, build, sql, table):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = build(spark, sf)
    cols = ", ".join(sorted(df.columns))
    assert sorted(map(repr, c.sql(f"select {cols} from ({sql})").fetchall())) == sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


# --- ids that are null, repeated or of 64 bits


def test_lines_beside_a_null_id_keep_large_ids_apart(spark):
    line = "one line that all of them share"
    a, b = 2**60 + 1, 2**60 + 3
    df = spark.createDataFrame([(b, line + "\nown text of b"), (a, line + "\nown text of a"), (None, line)], "doc_id long, text string")
    got = {r.doc_id: (r.kept, list(r.lost)) for r in lines.drop_repeated_lines(df).collect()}
    assert got == {a: (line + "\nown text of a", []), b: ("own text of b", [0]), None: ("", [0])}


def words_of(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_a_document_of_several_texts_is_near_what_any_of_them_is_near(spark):
    x, y, z = words_of(1), words_of(2), words_of(3)
    rows = [(5, x), (5, y), (7, y + " more"), (9, x + " more"), (11, z), (12, z), (12, words_of(4)), (2**62 + 9, words_of(5)), (2**62 + 9, words_of(6)), (2**62 + 11, words_of(6)), (None, y), (None, words_of(7))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11), (12, 11), (2**62 + 9, 2**62 + 9), (2**62 + 11, 2**62 + 9), (None, 5), (None, None)}


def test_one_row_of_each_document_stays(spark):
    x, y, z, u = (words_of(k) for k in (1, 2, 3, 4))
    rows = [(1, x, "a"), (3, y, "a"), (3, y, "a"), (3, y, "b"), (4, y + " more", "a"), (None, z, "a"), (None, z, "a"), (None, x, "a"), (8, u, "a"), (8, z + " other", "a"), (None, None, "a"), (None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _again string")
    got = neardup.keep_first(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect()))
    assert [k[:2] for k in kept] == [(False, 1), (False, 3), (False, 8), (True, 0), (True, 0)] and [k[2] for k in kept[3:]] == ["", z]


def test_op10_finds_passages_wherever_they_stand():
    """Boundaries by the bytes around them: a passage of about 50 words shares a chunk with itself in nearly any other text."""
    rng = random.Random(17)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randint(2, 10))) for _ in range(n))

    def parts(text):
        raw = text.encode()
        cuts = chunks.local_maxima(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        found = [raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]
        assert b"".join(found) == raw and all(len(x.decode().encode()) <= chunks.MAX for x in found)
        return set(found)

    caught = 0
    for _ in range(200):
        passage = words(60)
        caught += bool(parts(words(80) + passage + words(70)) & parts(words(33) + passage + words(120)))
    assert caught >= 192
    assert parts("") == set() and len(parts("x" * 4000)) == 2 and parts("short") == {b"short"}


def test_op10_finds_every_long_passage_and_leaves_lines_alone():
    """Over 50 words, one word over and over included, but neither a line that many documents have nor what a document repeats itself."""
    rng = random.Random(29)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnoé") for _ in range(rng.randint(2, 10))) for _ in range(n))

    def parts(text):
        raw = text.encode()
        spans = chunks.passages(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert max([0, *(q for _, q in spans)]) == len(raw) and all(p < q for p, q in spans) and all(b <= d for (_, b), (c, _), d in zip(spans, spans[1:], [x[1] for x in spans[1:]]))
        assert all(c <= b for (_, b), (c, _) in zip(spans, spans[1:]))
        return {raw[p:q].decode() for p, q in spans}

    caught = alone = 0
    for _ in range(200):
        passage, line = words(55), words(20)
        caught += bool(parts(words(80) + passage + words(70)) & parts(words(33) + passage + words(120)))
        alone += not parts(words(80) + " " + line + " " + words(70)) & parts(words(33) + " " + line + " " + words(120))
    assert caught >= 197 and alone == 200
    over = "and " * 60
    assert parts(words(40) + " " + over + words(90)) & parts(words(77) + " " + over + words(50))
    assert parts("") == set() and parts("short") == {"short"} and parts("é" * 3000) and parts("  ") == {"  "}


def test_op10_tells_repeats_of_others_from_own(spark):
    rng = random.Random(31)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 10))) for _ in range(n))
    mine, shared = words(60), words(60)
    rows = [(1, words(50) + " " + shared + " " + words(50)), (2, mine + "\n" + words(40) + "\n" + mine), (3, words(90) + " " + shared), (4, words(120)), (5, "and " * 300), (None, mine + "\n" + words(10)), (6, None), (7, words(15)), (8, rng.choice("xy"))]
    rows.append((9, rows[7][1]))
    out = {r.doc_id: r for r in chunks.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunks.passages).collect()}
    across = {d: r.n_across > 0 for d, r in out.items()}
    assert across == {1: False, 2: False, 3: True, 4: False, 5: False, None: True, 6: False, 7: False, 8: False, 9: True}
    assert out[2].n_repeated > 0 and out[5].n_repeated > 0 and out[1].n_repeated == out[4].n_repeated == 0
    for d, text in rows:
        raw, r = (text or "").encode(), out[d]
        cuts = [0, *(x for s in r.spans for x in (s.start, s.end)), len(raw)]
        assert cuts == sorted(cuts) and r.n_bytes == len(raw) and r.kept == b"".join(raw[p:q] for p, q in zip(cuts[::2], cuts[1::2], strict=True)).decode()


def test_postings_of_a_written_index_are_not_written_again(spark):
    df = spark.createDataFrame([(1, "a line of some length\nshort"), (2, "a line of some length")], "doc_id long, text string")
    index = lines.LineIndex.insert(df)
    assert "Aggregate" in index.postings._jdf.queryExecution().optimizedPlan().toString()
    assert index.postings.count() == 2 and [r.n for r in index.counts.collect()] == [2]
