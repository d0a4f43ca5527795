"""Queries over the account of a day: naming, blocks, stretches and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blocks as B
from ..operators import rollup as U
from ..operators import rules as R
from ..operators import stretches as T
from ..sources import fixtures
from ..sources import traces as X
from .oracle import _rules, after

D = ("actor_id", "local_day")
E = (*D, "external_id")
DS = "actor_id, local_day"


#: What of a stretch lies between attention windows, longer than four minutes.
LONG_BACKGROUND = f"""SELECT {DS}, from_us, to_us, owner FROM (
  WITH w AS (
    SELECT s.actor_id, s.local_day, s.from_us AS a, s.to_us AS b, s.owner, greatest(w.from_us, s.from_us) AS f, least(w.to_us, s.to_us) AS t
    FROM st s JOIN win w ON w.actor_id = s.actor_id AND w.local_day = s.local_day AND w.from_us < s.to_us AND w.to_us > s.from_us
    WHERE NOT padding
  )
  SELECT {DS}, owner, coalesce(lag(t) OVER (PARTITION BY {DS}, a, b ORDER BY f), a) AS from_us, f AS to_us FROM w
  UNION ALL SELECT {DS}, owner, max(t), b FROM w GROUP BY {DS}, owner, a, b
  UNION ALL SELECT {DS}, owner, from_us, to_us FROM st s WHERE NOT padding AND NOT EXISTS (
    SELECT 1 FROM w WHERE w.actor_id = s.actor_id AND w.local_day = s.local_day AND w.a = s.from_us AND w.b = s.to_us)
) WHERE to_us - from_us > 240000000"""

#: More rules, some of which can't fire; as in fixtures.RULES, under the ids from 100 on.
FLAWED = [
    ("project", "dead", "", "key", "h5.example.com", None),
    ("project", "p", "", "key", "", None),
    ("project", "p", "", "key", "x.example.com:443", None),
    ("subject", "", "", "path", "/src/p2", None),
    ("project", "p", "", "emoji", "x", None),
    ("never", "", "", "path", "/src/p9*", None),
    ("project", "p", "", "path", "/src/p9*", None),
    ("project", "p", "", "path", "/src/p9", None),
    ("project", "p", "", "path", "/src/p9*", "2024-01-20"),
    ("project", "p", "", "path", "/src/p9/deeper", None),
    ("never", "", "", "path", "/src/p8*", "2024-01-20"),
    ("subject", "p", "s", "path", "/src/p8*", "2024-01-20"),
    ("subject", "p", "s", "path", "/src/p8*", None),
    ("never", "", "", "key", "h2.example.com/k1", None),
    ("project", "p", "", "key", "h2.example.com", None),
    ("subject", "p", "s", "key", "h2.example.com/k1", None),
    ("never", "", "", "key", "example.com/section", None),
    ("project", "p", "", "key", "a.b.example.com/section", None),
    ("project", "p", "", "key", "h.example.com", None),
    ("never", "", "", "key", "example.com/k2", None),
    ("subject", "p", "s", "key", "h.example.com/k2", None),
    ("never", "", "", "key", "h1.example.com:3000/k3", None),
    ("project", "p", "", "key", "h1.example.com:3000/k3", None),
    ("project", "p", "", "key", "h1.example.com/k3", None),
]


#: The day as compact JSON, with its projects and runs in order.
DOCUMENT = f"""SELECT t.actor_id, t.local_day, CAST(to_json({{'day': CAST(t.local_day AS VARCHAR),
  'totals': {{{', '.join(f"'{c}': CAST({c} AS BIGINT)" for c in ('attention_us', 'background_us', 'active_us', 'span_us', 'padding_us', 'first_us', 'last_us'))}}},
  'projects': p.projects, 'runs': r.runs, 'clusters': k.clusters, 'settings': {{'tz': 'UTC', 'gap_us': 600000000, 'window_us': 300000000, 'head_us': 120000000, 'tail_us': 120000000, 'fallback': 'cwd-basename'}}}}) AS VARCHAR) AS document
FROM tot t
JOIN (SELECT {DS}, list({{'place': place, 'project': project, 'events': CAST(events AS BIGINT), 'attention_us': CAST(attention_us AS BIGINT), 'background_us': CAST(background_us AS BIGINT), 'wall_us': CAST(wall_us AS BIGINT)}} ORDER BY place) AS projects
  FROM (SELECT *, row_number() OVER (PARTITION BY {DS} ORDER BY project = '', attention_us DESC, background_us DESC, events DESC, project) AS place FROM prow) GROUP BY ALL) p ON p.actor_id = t.actor_id AND p.local_day = t.local_day
JOIN (SELECT {DS}, list({{'from_us': from_us, 'to_us': to_us, 'project': project, 'attention_us': CAST(attention_us AS BIGINT), 'background_us': CAST(background_us AS BIGINT), 'gap': gap}} ORDER BY from_us, to_us, project) AS runs FROM run GROUP BY ALL) r ON r.actor_id = t.actor_id AND r.local_day = t.local_day
JOIN (SELECT {DS}, list({{'block_id': block_id, 'from_us': from_us, 'to_us': to_us, 'project': project, 'origin': origin, 'events': n}} ORDER BY block_id) AS clusters
  FROM (SELECT b.actor_id, b.local_day, b.block_id, any_value(p.from_us) AS from_us, any_value(p.to_us) AS to_us, CASE WHEN count(DISTINCT b.project) = 1 THEN any_value(b.project) ELSE '' END AS project, any_value(b.origin) AS origin, count(*) AS n FROM b_ b JOIN pad p ON p.actor_id = b.actor_id AND p.local_day = b.local_day AND p.block_id = b.block_id GROUP BY ALL) GROUP BY ALL) k ON k.actor_id = t.actor_id AND k.local_day = t.local_day"""


def dead(c):
    """Every rule, what is wrong with it and on how many entries it hits all the same."""
    flawed = c.spark.createDataFrame([(100 + i, None, *r) for i, r in enumerate(FLAWED)], c.rules.schema)
    rules = c.rules.unionByName(flawed)
    hits = R.all_hits(c.targets, R.parse_rules(rules)).join(R.with_tid(c.entries).groupBy("tid").agg(F.count("*").alias("n_")), "tid").groupBy("rule_id").agg(F.sum("n_").alias("hits"))
    out = rules.select("rule_id").join(R.dead_rules(rules), "rule_id", "left").join(hits, "rule_id", "left")
    return out.select("rule_id", F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def _dead() -> str:
    """What is wrong with a rule, worked out from the rules as written, and what it hits."""
    rows = _rules([*((i, *r) for i, r in enumerate(fixtures.RULES)), *((100 + i, *r) for i, r in enumerate(FLAWED))])
    covers = """n.level = 'never' AND n.kind = r.kind AND n.since IS NOT DISTINCT FROM r.since AND r.level IN ('project', 'subject') AND (
   r.kind = 'path' AND n.value LIKE '%*' AND rtrim(n.value, '*') = CASE WHEN r.value LIKE '%*' THEN rtrim(r.value, '*') ELSE r.value END
   OR r.kind = 'key' AND r.value <> '' AND (r.rhost = n.rhost OR ends_with(r.rhost, '.' || n.rhost)) AND n.rport IN ('', r.rport) AND n.rsegment IN ('', r.rsegment) AND length(n.value) >= length(r.value))"""
    flaw = """CASE WHEN value = '' THEN 'empty' WHEN kind = 'key' AND rport IN ('80', '443') THEN 'default port' WHEN level = 'subject' AND rsubject = '' AND NOT (kind IN ('title', 'branch') AND contains(value, '(')) THEN 'no capture' WHEN kind NOT IN ('path', 'key', 'branch', 'title') THEN 'no matcher' END"""
    hit = """(r.since IS NULL OR local_day >= r.since) AND (
   r.kind = 'path' AND cwd <> '' AND CASE WHEN r.value LIKE '%*' THEN starts_with(cwd, rtrim(r.value, '*')) WHEN r.level = 'never' THEN cwd = r.value ELSE cwd = r.value OR starts_with(cwd, r.value || '/') END
   OR r.kind = 'key' AND r.value <> '' AND host <> '' AND (host = r.rhost OR ends_with(host, '.' || r.rhost)) AND (r.rport = '' OR r.rport = port) AND (r.rsegment = '' OR r.rsegment = path_head)
   OR r.kind = 'title' AND title <> '' AND regexp_matches(title, CASE WHEN r.kind = 'title' THEN r.value ELSE '' END))"""
    return f"""SELECT r.rule_id, coalesce(p.problem, '') AS problem, coalesce(h.n, 0) AS hits FROM (SELECT * FROM {rows}) r
 LEFT JOIN (SELECT DISTINCT r.rule_id, 'covered by never' AS problem FROM (SELECT * FROM {rows}) r JOIN (SELECT * FROM {rows}) n ON {covers} UNION ALL SELECT rule_id, {flaw} FROM (SELECT * FROM {rows}) WHERE {flaw} IS NOT NULL) p ON p.rule_id = r.rule_id
 LEFT JOIN (SELECT r.rule_id, count(*) AS n FROM ent JOIN (SELECT * FROM {rows}) r ON {hit} GROUP BY ALL) h ON h.rule_id = r.rule_id"""


DEAD = _dead()


def ranged(c):
    """Totals of the range with their evidence, as text where it is a list."""
    t = U.range_totals(c.rows, c.b, 3)
    listed = lambda col, name, n: F.coalesce(F.array_join(F.transform(col, lambda x: F.concat_ws(":", x[name], x[n].cast("string"))), "|"), F.lit(""))
    return t.withColumns({"sources": listed("sources", "source", "events"), "keys": listed("keys", "key", "visits"), "candidates": F.coalesce(F.array_join("candidates", "|"), F.lit(""))})


#: Every list is made from the rows of all days at once.
RANGE = """SELECT t.*, coalesce(s.x, '') AS sources, coalesce(k.x, '') AS keys, coalesce(k.others, 0) AS other_visits, coalesce(d.x, '') AS candidates FROM (
  SELECT actor_id, project, sum(events) AS events, sum(attention_us) AS attention_us, sum(background_us) AS background_us, sum(agent_us) AS agent_us, sum(claimed_us) AS claimed_us, sum(wall_us) AS wall_us, count(DISTINCT local_day) AS days FROM prow GROUP BY GROUPING SETS ((actor_id, project), (actor_id))) t
 LEFT JOIN (SELECT actor_id, project, string_agg(source || ':' || n, '|' ORDER BY n DESC, source) AS x FROM (SELECT actor_id, project, source, count(*) AS n FROM b_ GROUP BY GROUPING SETS ((actor_id, project, source), (actor_id, source))) GROUP BY ALL) s ON s.actor_id = t.actor_id AND s.project IS NOT DISTINCT FROM t.project
 LEFT JOIN (SELECT actor_id, project, string_agg(key || ':' || n, '|' ORDER BY r) FILTER (r <= 3) AS x, coalesce(sum(n) FILTER (r > 3), 0) AS others FROM (SELECT *, row_number() OVER (PARTITION BY actor_id, project ORDER BY n DESC, key) AS r FROM (SELECT actor_id, project, key, count(*) AS n FROM b_ WHERE key <> '' GROUP BY GROUPING SETS ((actor_id, project, key), (actor_id, key)))) GROUP BY ALL) k ON k.actor_id = t.actor_id AND k.project IS NOT DISTINCT FROM t.project
 LEFT JOIN (SELECT actor_id, project, string_agg(DISTINCT c, '|' ORDER BY c) AS x FROM (SELECT actor_id, project, unnest(string_split(candidates, '|')) AS c FROM b_ WHERE candidates <> '') GROUP BY GROUPING SETS ((actor_id, project), (actor_id))) d ON d.actor_id = t.actor_id AND d.project IS NOT DISTINCT FROM t.project"""


def register(query) -> None:
    # predicates, columns and ranges
    query("count_events", lambda c: c.entries.where("local_day >= date '2024-01-05' and local_day < date '2024-01-20'").groupBy("source").agg(F.count("*").alias("n")), after("ent", "SELECT source, count(*) AS n FROM ent WHERE local_day >= DATE '2024-01-05' AND local_day < DATE '2024-01-20' GROUP BY source"))
    query("events_between", lambda c: c.entries.where("ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12'").select("actor_id", "source", "external_id", "ts_us"), after("ent", "SELECT actor_id, source, external_id, ts_us FROM ent WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'"))
    query("time_range", lambda c: c.entries.groupBy("actor_id").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")), after("ent", "SELECT actor_id, min(ts_us) AS first_us, max(ts_us) AS last_us FROM ent GROUP BY actor_id"))
    query("unreadable_ts", lambda c: X.unreadable(c.traces.withColumn("s", F.when(F.col("external_id").endswith("7"), "not a time").otherwise(F.col("ts").cast("string"))), "s"), after("traces", "SELECT count(*) FILTER (ends_with(external_id, '7')) AS unreadable, count(*) AS n FROM traces"))
    query("local_day", lambda c: X.entries(c.traces, X.Settings(tz="America/New_York")).groupBy("actor_id", "local_day").agg(F.count("*").alias("n"), F.max(F.expr("(day_end_us - day_start_us) div 3600000000")).alias("hours")), after("traces", "SELECT actor_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS local_day, count(*) AS n, 24 AS hours FROM traces GROUP BY 1, 2"))
    query("is_touch", lambda c: c.entries.where("touch").select(*E), after("ent", f"SELECT {DS}, external_id FROM ent WHERE touch"))
    query("owns_time", lambda c: c.entries.where("owns").select(*E), after("ent", f"SELECT {DS}, external_id FROM ent WHERE owns"))
    query("own_span", lambda c: c.entries.where("span_us > 0").select(*E, "span_us"), after("ent", f"SELECT {DS}, external_id, span_us FROM ent WHERE span_us > 0"))
    query("clamp_day", lambda c: c.entries.select(*E, F.least("end_us", "day_end_us").alias("end_us"), (F.col("end_us") > F.col("day_end_us")).alias("cut")), after("ent", f"SELECT {DS}, external_id, least(end_us, day_end_us) AS end_us, end_us > day_end_us AS cut FROM ent"))
    query("week_range", lambda c: c.entries.select("local_day", *S.week_range(F.col("local_day"))).groupBy("week_from", "week_to").agg(F.count("*").alias("n")), after("ent", "SELECT CAST(date_trunc('week', local_day) AS DATE) AS week_from, CAST(date_trunc('week', local_day) AS DATE) + 6 AS week_to, count(*) AS n FROM ent GROUP BY 1, 2"))
    query("union_sources", lambda c: c.traces.where("source = 'browser'").unionByName(c.traces.where("source = 'calendar'")).unionByName(c.traces.where("source = 'agent-log'")).groupBy("actor_id", "source").agg(F.count("*").alias("n")), after("traces", "SELECT actor_id, source, count(*) AS n FROM traces GROUP BY ALL"))
    query("browser_key", lambda c: c.entries.where("key <> ''").select("external_id", "key"), after("ent", "SELECT external_id, key FROM ent WHERE key <> ''"))
    query("split_key", lambda c: c.entries.where("key <> ''").select("key", *S.split_key(F.col("key"))).distinct(), after("ent", "SELECT DISTINCT key, split_part(key, '/', 1) AS host_port, split_part(key, '/', 2) AS segment FROM ent WHERE key <> ''"))
    query("trace_id", lambda c: c.entries.select(S.trace_id(F.col("key"), F.col("path")).alias("trace")).groupBy("trace").agg(F.count("*").alias("n")), after("ent", "SELECT CASE WHEN key <> '' THEN 'key:' || key WHEN path <> '' THEN 'path:' || path ELSE '' END AS trace, count(*) AS n FROM ent GROUP BY 1"))
    query("cwd_basename", lambda c: c.entries.where("cwd <> ''").select("cwd", S.cwd_basename(F.col("cwd")).alias("base")).distinct(), after("ent", "SELECT DISTINCT cwd, string_split(cwd, '/')[-1] AS base FROM ent WHERE cwd <> ''"))

    # the dictionary
    hits = lambda kind: lambda c: R.with_tid(c.entries).select("external_id", "tid").join(kind(c), "tid").select("external_id", "rule_id", "n", "since_n", "capture")
    parsed = lambda c: R.parse_rules(c.rules)
    sel = "SELECT external_id, rule_id, n, since_n, capture FROM hit WHERE kind"
    query("match_paths", hits(lambda c: R.match_paths(c.targets, parsed(c))), after("hit", f"{sel} = 'path'"))
    query("match_keys", hits(lambda c: R.match_keys(c.targets, parsed(c))), after("hit", f"{sel} = 'key'"))
    query("match_regex", hits(lambda c: R.match_regex(c.targets, parsed(c))), after("hit", f"{sel} IN ('title', 'branch')"))
    query("rule_in_force", lambda c: hits(lambda c: c.hits)(c).groupBy("rule_id").agg(F.count("*").alias("n")), after("hit", "SELECT rule_id, count(*) AS n FROM hit GROUP BY rule_id"))
    query("never_floor", lambda c: R.with_tid(c.entries).select("external_id", "tid").join(R.never_floor(c.hits), "tid").select("external_id", "kind", F.col("floor.n").alias("n"), F.col("floor.since_n").alias("since_n")), after("floor_", "SELECT external_id, kind, fn AS n, fs AS since_n FROM floor_"))
    query("best_rule", lambda c: R.with_tid(c.entries).select("external_id", "tid").join(R.best_rule(R.above_floor(c.hits)), "tid").select("external_id", "rule_id", "project"), after("best", "SELECT external_id, rule_id, rproject AS project FROM best"))
    query("resolve_project", lambda c: c.named.select(*E, "project", "by_rule"), after("named", f"SELECT {DS}, external_id, own_project AS project, by_rule FROM named"))
    query("resolve_subject", lambda c: c.named.where("subject <> ''").select(*E, "subject"), after("named", f"SELECT {DS}, external_id, subject FROM named WHERE subject <> ''"))
    query("covers_trace", lambda c: c.named.where("covered").select(*E), after("named", f"SELECT {DS}, external_id FROM named WHERE covered"))
    query("ambiguous_trace", lambda c: c.named.where("ambiguous <> ''").select(*E, "ambiguous"), after("named", f"SELECT {DS}, external_id, ambiguous FROM named WHERE ambiguous <> ''"))
    query("except_covered", lambda c: U.except_covered(c.named), after("named", "SELECT DISTINCT actor_id, path, key FROM named WHERE NOT covered AND (path <> '' OR key <> '')"))
    inside = lambda c: R.rules_start_inside(c.rules, "2024-01-01", "2024-01-31")
    query(
        "rules_start_inside",
        lambda c: c.entries.join(inside(c).select("value", F.to_date("since").alias("since")), F.col("local_day") == F.col("since")).groupBy("value", "since").agg(F.count("*").alias("events")),
        after("rule", "SELECT value, since, count(*) AS events FROM rule JOIN traces ON local_day = since WHERE since > DATE '2024-01-01' GROUP BY ALL"),
    )
    query("dead_rules", dead, after("hit", DEAD))

    # blocks and attribution
    query("blocks", lambda c: B.blocks(c.entries, c.hot).select(*E, "nth", "block_id"), after("blk", f"SELECT {DS}, external_id, nth, block_id FROM blk"))
    query("block_bounds", lambda c: B.block_bounds(B.blocks(c.entries, c.hot)), after("bl", f"SELECT {DS}, block_id, block_from_us AS from_us, block_to_us AS to_us, events FROM bl"))
    query("nearest_anchor", lambda c: B.nearest_anchor(B.blocks(c.named)).select(*E, "project", "anchor"), after("near", f"SELECT {DS}, external_id, got AS project, anchor FROM near"))
    query("neighbour_blocks", lambda c: c.b.select(*E, "project", "origin", F.array_join("candidates", "|").alias("candidates")), after("b_", f"SELECT {DS}, external_id, project, origin, candidates FROM b_"))
    query("nearest_touch", lambda c: c.b.select(*E, "owner", "owner_subject", "owner_session"), after("own_", f"SELECT {DS}, external_id, owner, owner_subject, owner_session FROM own_"))
    query("ground", lambda c: c.b.groupBy("actor_id", "ground").agg(F.count("*").alias("n")), after("own_", "SELECT actor_id, ground, count(*) AS n FROM own_ GROUP BY ALL"))
    query("candidates", lambda c: B.candidates(c.b).select(*D, F.array_join("candidates", "|").alias("candidates")), after("b_", f"SELECT {DS}, coalesce(string_agg(DISTINCT x, '|' ORDER BY x), '') AS candidates FROM (SELECT {DS}, unnest(CASE WHEN candidates = '' THEN [NULL] ELSE string_split(candidates, '|') END) AS x FROM b_ WHERE project = '') GROUP BY ALL"))
    query("block_projects", lambda c: B.block_projects(c.b), after("b_", f"SELECT {DS}, block_id, project, count(*) AS events, count(*) FILTER (own) AS own_events FROM b_ GROUP BY ALL"))

    # stretches
    query("head_tail", lambda c: c.h.select(*D, "block_id", "from_us", "to_us").distinct(), after("pad", f"SELECT {DS}, block_id, from_us, to_us FROM pad"))
    query("cut_points", lambda c: T.edges(c.h, fixtures.answers(c.spark)).where("cut").select(*D, F.col("instant").alias("at_us")).distinct(), after("st1", f"SELECT {DS}, at_us FROM cut_ UNION SELECT {DS}, from_us FROM pad UNION SELECT {DS}, to_us FROM pad"))
    query("stretches", lambda c: c.s.select(*D, "from_us", "to_us", "block_id", "opener", "padding"), after("st1", f"SELECT {DS}, from_us, to_us, block_id, opener, padding FROM st1"))
    query("manual_override", lambda c: c.s.where("ground in ('manual', 'one-off')").select(*D, "from_us", "to_us", "owner", "subject", "ground"), after("st", f"SELECT {DS}, from_us, to_us, owner, subject, ground FROM st WHERE ground IN ('manual', 'one-off')"))
    query("padding_time", lambda c: c.s.where("padding").groupBy(*D, "owner").agg(F.sum(F.col("to_us") - F.col("from_us")).alias("padding_us")), after("st", f"SELECT {DS}, owner, sum(to_us - from_us) AS padding_us FROM st WHERE padding GROUP BY ALL"))
    query("one_neighbour_time", lambda c: c.s.where("origin = 'one-neighbour'").groupBy(*D).agg(F.sum(F.col("to_us") - F.col("from_us")).alias("time_us")), after("st", f"SELECT {DS}, sum(to_us - from_us) AS time_us FROM st WHERE origin = 'one-neighbour' GROUP BY ALL"))
    query("attention_windows", lambda c: T.attention_windows(c.entries), after("win", f"SELECT {DS}, from_us, to_us FROM win"))
    query("attention_overlap", lambda c: c.s.select(*D, "from_us", "attention_us", "background_us"), after("st", f"SELECT {DS}, from_us, attention_us, background_us FROM st"))
    query("attention_parts", lambda c: c.p.groupBy(*D, "kind").agg(F.count("*").alias("parts"), F.sum(F.col("to_us") - F.col("from_us")).alias("time_us")).where("kind <> 'background'").select(*D, "kind", "time_us"), after("st", f"SELECT {DS}, CASE WHEN padding THEN 'padding' ELSE 'attention' END AS kind, sum(attention_us) AS time_us FROM st GROUP BY ALL HAVING sum(attention_us) > 0"))
    query("live_sessions", lambda c: c.live.groupBy(*D, "session_id", "project").agg(F.sum(F.col("to_us") - F.col("from_us")).alias("time_us")), after("live", f"SELECT {DS}, session_id, project, sum(t - f) AS time_us FROM live GROUP BY ALL"))
    query("agent_overlap", lambda c: c.agent.join(c.s.select(*D, "stretch", "from_us"), [*D, "stretch"]).select(*D, "from_us", "project", "agent_us"), after("agent", f"SELECT {DS}, from_us, project, agent_us FROM agent"))
    query("agent_time", lambda c: c.agent.groupBy(*D, "project").agg(F.sum("agent_us").alias("agent_us")), after("agent", f"SELECT {DS}, project, sum(agent_us) AS agent_us FROM agent GROUP BY ALL"))

    # timeline
    query("runs", lambda c: c.runs, after("run", f"SELECT {DS}, from_us, to_us, project, attention_us, background_us, gap FROM run"))
    shut = f"(SELECT *, coalesce(lead(gap) OVER (PARTITION BY {DS} ORDER BY from_us, to_us), true) AS shut FROM run)"
    query("run_evidence", lambda c: U.run_evidence(c.runs, c.b), after("run", f"SELECT r.actor_id, r.local_day, r.from_us, r.to_us, count(o.ts_us) AS events, count(DISTINCT o.source) AS sources, count(*) FILTER (o.key <> '') AS visits FROM {shut} r LEFT JOIN own_ o ON o.actor_id = r.actor_id AND o.local_day = r.local_day AND o.ts_us >= r.from_us AND (o.ts_us < r.to_us OR (r.shut AND o.ts_us = r.to_us)) WHERE NOT r.gap GROUP BY ALL"))
    side = lambda f, o, op: f"coalesce((SELECT {f}(x.project, x.from_us) FROM run x WHERE x.actor_id = r.actor_id AND x.local_day = r.local_day AND NOT x.gap AND x.project <> '' AND {op}), '')"
    query("pauses", lambda c: U.pauses_between(c.runs), after("run", f"SELECT {DS}, from_us, to_us, {side('arg_max', '', 'x.to_us <= r.from_us')} AS left_project, {side('arg_min', '', 'x.from_us >= r.to_us')} AS right_project FROM run r WHERE gap"))
    query("claimed_pauses", lambda c: c.claims, after("claim", f"SELECT {DS}, from_us, to_us, project, subject, held_us FROM claim"))
    query("mark_claimed_runs", lambda c: U.mark_claimed_runs(c.runs, c.pauses.unionByName(c.runs.where("gap and to_us - from_us > 3600000000").select(*D, "from_us", "to_us", F.lit(True).alias("worked"), F.lit("long").alias("project"), F.lit("").alias("subject"), F.lit(0).alias("answered_at")))).select(*D, "from_us", "to_us", "gap", "project", "claimed"), after("run", f"SELECT {DS}, from_us, to_us, gap, CASE WHEN gap AND to_us - from_us > 3600000000 THEN 'long' ELSE project END AS project, gap AND to_us - from_us > 3600000000 AS claimed FROM run"))
    query("long_background", lambda c: U.long_background(c.p, 240_000_000), after("st", LONG_BACKGROUND))

    # roll-ups
    cols = "project, events, attention_us, background_us, agent_us, claimed_us, wall_us"
    query("project_rows", lambda c: c.rows, after("prow", f"SELECT {DS}, {cols} FROM prow"))
    query("union_projects", lambda c: U.union_projects(c.b, c.s, c.claims), after("prow", f"SELECT {DS}, project FROM prow"))
    query("subject_rows", lambda c: c.subjects, after("srow", f"SELECT {DS}, project, subject, events, attention_us, background_us FROM srow"))
    query("source_counts", lambda c: U.source_counts(c.b, *D, "project"), after("own_", f"SELECT {DS}, project, source, count(*) AS events FROM own_ GROUP BY ALL"))
    query("browser_keys", lambda c: U.browser_keys(c.b, *D, "project"), after("own_", f"SELECT {DS}, project, key, count(*) AS visits FROM own_ WHERE key <> '' GROUP BY ALL"))
    query("wall", lambda c: U.wall(c.b), after("own_", f"SELECT {DS}, project, max(least(end_us, day_end_us)) - min(ts_us) AS wall_us FROM own_ GROUP BY ALL"))
    query("day_totals", lambda c: c.totals, after("tot", "SELECT * FROM tot"))
    query("coverage", lambda c: U.coverage(c.totals), after("tot", f"SELECT {DS}, CASE WHEN span_us > 0 THEN CAST(floor(active_us * 1000 / span_us) AS BIGINT) END AS permille FROM tot"))
    query("counted_time", lambda c: c.rows.select(*D, "project", U.counted_time(c.rows).alias("counted_us"), U.counted_time(c.rows, True).alias("with_background_us")), after("prow", f"SELECT {DS}, project, attention_us AS counted_us, attention_us + background_us AS with_background_us FROM prow"))
    query("range_totals", ranged, after("prow", RANGE))
    query("subject_report", lambda c: U.subject_report(c.subjects, "tk-7"), after("srow", f"SELECT actor_id, project, local_day, sum(events) AS events, sum(attention_us) AS attention_us, sum(background_us) AS background_us, min(d) AS first_day, max(d) AS last_day FROM (SELECT *, local_day AS d FROM srow WHERE lower(subject) = 'tk-7') GROUP BY GROUPING SETS ((actor_id, project), (actor_id, local_day), (actor_id))"))
    query("subject_list", lambda c: U.subject_list(c.subjects), after("srow", "SELECT actor_id, subject, sum(events) AS events, sum(attention_us) AS attention_us, sum(background_us) AS background_us, count(DISTINCT local_day) AS days FROM srow GROUP BY ALL"))
    query("unmatched", lambda c: c.unmatched, after("unm", f"SELECT {DS}, path, key, events, project, time_us FROM unm"))
    query("unmatched_range", lambda c: U.unmatched_range(c.unmatched), after("unm", "SELECT actor_id, path, key, sum(events) AS events, sum(time_us) AS time_us, coalesce(arg_max(project, local_day) FILTER (project <> ''), '') AS project FROM unm GROUP BY ALL"))
    least = 600_000_000
    query("fold_small", lambda c: U.fold_small(c.rows, least), after("prow", f"SELECT {DS}, CASE WHEN project <> '' AND greatest(attention_us, background_us, agent_us, claimed_us) < {least} THEN '(other)' ELSE project END AS project, sum(events) AS events, sum(attention_us) AS attention_us, sum(background_us) AS background_us, sum(agent_us) AS agent_us, sum(claimed_us) AS claimed_us, count(*) AS folded FROM (SELECT {DS}, project AS project, events, attention_us, background_us, agent_us, claimed_us FROM prow) GROUP BY 1, 2, 3"))
    # as on days when nobody turned to some of the projects
    query("ran_without_you", lambda c: U.ran_without_you(c.agent, c.s.where("owner not in ('alpha', 'beta', 'p2')")), after("agent", f"SELECT {DS}, project, sum(agent_us) AS agent_us FROM agent a WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.actor_id = a.actor_id AND st.local_day = a.local_day AND st.owner = a.project AND st.owner NOT IN ('alpha', 'beta', 'p2')) GROUP BY ALL"))
    over = f"OVER (PARTITION BY {DS} ORDER BY"
    query("order_projects", lambda c: U.ordered(c.rows, *U.order_projects()).select(*D, "project", "place"), after("prow", f"SELECT {DS}, project, row_number() {over} project = '', attention_us DESC, background_us DESC, events DESC, project) AS place FROM prow"))
    query("order_subjects", lambda c: U.ordered(c.subjects, *U.order_subjects()).select(*D, "project", "subject", "place"), after("srow", f"SELECT {DS}, project, subject, row_number() {over} attention_us DESC, background_us DESC, events DESC, subject, project) AS place FROM srow"))
    query("order_unmatched", lambda c: U.ordered(c.unmatched, *U.order_unmatched()).select(*D, "path", "key", "place"), after("unm", f"SELECT {DS}, path, key, row_number() {over} time_us DESC, events DESC, path, key) AS place FROM unm"))
    query("topk_keys", lambda c: U.top(U.browser_keys(c.b, *D, "project"), 3, (*D, "project"), F.desc("visits"), F.asc("key")), after("own_", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {DS}, project ORDER BY visits DESC, key) AS place, greatest(0, count(*) OVER (PARTITION BY {DS}, project) - 3) AS rest FROM (SELECT {DS}, project, key, count(*) AS visits FROM own_ WHERE key <> '' GROUP BY ALL)) WHERE place <= 3"))
    query("topk_subjects", lambda c: U.top(c.subjects, 8, D, *U.order_subjects()), after("srow", f"SELECT * FROM (SELECT *, row_number() {over} attention_us DESC, background_us DESC, events DESC, subject, project) AS place, greatest(0, count(*) OVER (PARTITION BY {DS}) - 8) AS rest FROM srow) WHERE place <= 8"))
    query("topk_unmatched", lambda c: U.top(c.unmatched, 15, D, *U.order_unmatched()), after("unm", f"SELECT * FROM (SELECT *, row_number() {over} time_us DESC, events DESC, path, key) AS place, greatest(0, count(*) OVER (PARTITION BY {DS}) - 15) AS rest FROM unm) WHERE place <= 15"))
    query("day_document", lambda c: U.day_document(c.totals, c.rows, c.runs, c.h), after("tot", DOCUMENT))
