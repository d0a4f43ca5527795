"""Expressions looked up by what they need, against every pair of text and expression."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayloom.operators import rules as R
from dayloom.operators.literals import needed


@pytest.mark.parametrize(
    "expression, strings",
    [
        ("release notes", ["release notes"]),
        (r"\b(TK-[0-9]+)\b", ["tk-"]),
        (r"(?i)Weekly\s+Review", ["weekly"]),
        (r"^standup|planning$", ["planning", "standup"]),
        (r"standup|x", None),
        (r"(alpha|beta)+ ru", ["alpha", "beta"]),
        (r"colou?rs", ["colo"]),
        (r"abc*defg", ["defg"]),
        (r"(maybe)? later", [" later"]),
        (r"(?:inner|outer) ring of fire", [" ring of fire"]),
        (r"a\.b\.c", ["a.b.c"]),
        (r"(?=look)ahead", ["ahead"]),
        (r"(?<name>issue)-\d{2,}", ["issue"]),
        (r"x{3}abcd{2}", ["abcd"]),
        (r"[a-z]{4}", None),
        (r".*", None),
        (r"ab", None),
        (r"\x41bcdef", None),
        (r"\Qa.b\Ecdef", None),
        (r"(?x) spaced out", None),
        (r"(?u)Straße", None),
        (r"[[a-z]&&[^b]]suffix", ["suffix"]),
        ("unclosed(group", None),
        ("", None),
        (None, None),
    ],
)
def test_what_an_expression_needs(expression, strings):
    assert needed(expression) == strings


ATOM = st.sampled_from(["ab", "cde", "Fgh", "x", ".", r"\d", "[xyz]", r"\.", "é", "-"])
QUANT = st.sampled_from(["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?"])


@st.composite
def expressions(draw, depth=2):
    parts = []
    for _ in range(draw(st.integers(1, 4))):
        kind = draw(st.sampled_from(["atom", "atom", "group", "either"])) if depth else "atom"
        if kind == "atom":
            a, q = draw(ATOM), draw(QUANT)
            parts.append(a + q if len(a) == 1 or not q else f"(?:{a}){q}" if draw(st.booleans()) else a + q)
        elif kind == "group":
            parts.append(f"({draw(expressions(depth - 1))}){draw(QUANT)}")
        else:
            parts.append(f"(?:{draw(expressions(depth - 1))}|{draw(expressions(depth - 1))})")
    return "".join(parts)


@settings(max_examples=300, deadline=None)
@given(expressions(), st.lists(st.text("abcdeFfghxyz.19é-", max_size=14), max_size=30))
def test_a_match_has_what_is_needed(expression, texts):
    strings = needed(expression)
    for t in texts:
        if strings is not None and re.search(expression, t):
            assert any(s in t.lower() for s in strings)


def test_pairs_are_those_of_all_against_all(spark):
    rng = random.Random(6)
    words = ["Review", "standup", "TK-12", "budget 2024", "Öl", "planning", "a.b", "xx", "", "retro"]
    texts = [(rng.choice(["a0", "a1", "*"]), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))) for _ in range(400)]
    rules = [r"(?i)review", "standup", r"\b(TK-\d+)", "plan(ning)?", r"a\.b", "^xx$", "retro|budget", "Öl", "x", r"(?i)(REVIEW|RETRO) standup", "nothing like it"]
    rows = [(i, rng.choice(["a0", None]), "subject", "p", "", "title", v, None) for i, v in enumerate(rules)]
    parsed = R.parse_rules(spark.createDataFrame(rows, "rule_id int, actor_id string, level string, project string, subject string, kind string, value string, since string"))
    t = spark.createDataFrame(texts, "scope string, s string").distinct()
    got = {(r.scope, r.s, r.rule_id) for r in R.text_matches(t, R.with_needed(parsed, "title")).collect()}
    assert got == {(s, x, i) for s, x in set(texts) for i, a, *_, v, _ in rows if (a or "*") == s and re.search(v, x)}
    assert {(r.kind, r.rules) for r in R.loose_rules(parsed).collect()} == {("title", 3)}


def test_rows_grow_with_matches_and_not_with_pairs(spark):
    texts = spark.range(3000).select(F.when(F.col("id") >= 0, "*").alias("scope"), F.format_string("meeting number %05d of the year", "id").alias("s"))
    rows = [(i, None, "project", f"p{i}", "", "title", f"number {i * 7:05d} of", None) for i in range(400)]
    parsed = R.parse_rules(spark.createDataFrame(rows, "rule_id int, actor_id string, level string, project string, subject string, kind string, value string, since string"))
    found = R.text_matches(texts, R.with_needed(parsed, "title"))
    assert found.count() == 400
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in joins and "BroadcastNestedLoopJoin" not in joins


def test_names_hold_from_their_day(spark):
    """A rule's day splits the combinations that are decided once."""
    from dayloom.sources import traces as T

    from .test_day import COLS, event

    rows = [event(i, 600, "visit", day=f"2026-05-0{d}", actor=a) for i, (d, a) in enumerate([(1, "a"), (3, "a"), (5, "a"), (3, "b"), (5, None)])]
    rules = [(0, None, "project", "one", "", "key", "h.example", "2026-05-02"), (1, None, "project", "two", "", "key", "h.example", "2026-05-04"), (2, "b", "project", "mine", "", "key", "h.example", None), (3, "b", "never", "", "", "key", "other.example", None)]
    e = T.entries(spark.createDataFrame(rows, COLS))
    got = R.named(e, spark.createDataFrame(rules, "rule_id int, actor_id string, level string, project string, subject string, kind string, value string, since string"))
    assert {(r.actor_id, r.local_day.day): (r.project, r.by_rule) for r in got.collect()} == {("a", 1): ("", False), ("a", 3): ("one", True), ("a", 5): ("two", True), ("b", 3): ("one", True), (None, 5): ("", False)}
