"""SQL counterparts of the queries, written apart from them, as chains of common table expressions."""

from __future__ import annotations

from ..sources import fixtures

US = 60_000_000


def _lit(x) -> str:
    return "NULL" if x is None else ("true" if x else "false") if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _key_parts(value: str) -> tuple[str, str, str]:
    place, _, segment = value.partition("/")
    host, _, port = place.partition(":")
    return host, port, segment


def _rules(written: list | None = None) -> str:
    rows = []
    for i, level, project, subject, kind, value, since in written or [(i, *r) for i, r in enumerate(fixtures.RULES)]:
        host, port, segment = _key_parts(value) if kind == "key" else ("", "", "")
        rows.append("(" + ", ".join(_lit(x) for x in (i, level, project, subject, kind, value, host, port, segment)) + ", " + (f"DATE '{since}'" if since else "NULL::DATE") + ")")
    return "(VALUES " + ", ".join(rows) + ") v(rule_id, level, rproject, rsubject, kind, value, rhost, rport, rsegment, since)"


def _spans(rows: list, names: str) -> str:
    out = []
    for actor, day, f, t, *rest in rows:
        base = f"epoch_us(TIMESTAMP '{day}')"
        out.append(f"('{actor}', DATE '{day}', {base} + {int(f * 3600 * 10**6)}, {base} + {int(t * 3600 * 10**6)}, " + ", ".join(_lit(x) for x in rest) + ")")
    return "(VALUES " + ", ".join(out) + f") v(actor_id, local_day, from_us, to_us, {names})"


_VISIT, _AGENT = "event_type IN ('click','view')", "event_type IN ('purchase','error')"

STEPS: list[tuple[str, str]] = [
    (
        "traces",
        f"""SELECT 'a' || CAST(user_id % 3 AS VARCHAR) AS actor_id,
       CASE WHEN {_VISIT} THEN 'browser' WHEN event_type = 'signup' THEN 'calendar' ELSE 'agent-log' END AS source,
       lpad(CAST(event_id AS VARCHAR), 12, '0') AS external_id, ts, CAST(ts AS DATE) AS local_day,
       CASE WHEN event_type = 'signup' THEN CAST(floor(value) AS BIGINT) * 60000 END AS duration_ms,
       CASE WHEN {_VISIT} THEN 'visit' WHEN event_type = 'signup' THEN 'event' WHEN event_type = 'purchase' THEN 'user' ELSE 'assistant' END AS type,
       CASE WHEN event_type = 'purchase' THEN 'prompt' ELSE '' END AS raw_text,
       (event_type = 'purchase' AND event_id % 17 = 0) AS is_sidechain,
       CASE WHEN {_AGENT} THEN 's' || CAST(user_id AS VARCHAR) ELSE '' END AS session_id,
       CASE WHEN {_AGENT} THEN '/src/p' || CAST(user_id % 12 AS VARCHAR) ELSE '' END AS cwd,
       CASE WHEN {_AGENT} THEN 'p' || CAST(user_id % 12 AS VARCHAR) ELSE '' END AS guess,
       CASE WHEN {_VISIT} THEN 'h' || CAST(user_id % 9 AS VARCHAR) || '.example.com' ELSE '' END AS host,
       CASE WHEN {_VISIT} AND event_id % 5 = 0 THEN '3000' ELSE '' END AS port,
       CASE WHEN {_VISIT} THEN 'k' || CAST(CAST(regexp_replace(props, '[^0-9]+', '', 'g') AS INT) % 10 AS VARCHAR) ELSE '' END AS path_head,
       CASE WHEN event_type <> 'error' THEN 'TK-' || CAST(user_id % 20 AS VARCHAR) || ' item' ELSE '' END AS title
FROM events""",
    ),
    (
        "e",
        """SELECT *, epoch_us(ts) AS ts_us, coalesce(CASE WHEN source = 'calendar' AND duration_ms > 0 THEN duration_ms * 1000 END, 0) AS span_us,
       (source = 'browser' OR (source = 'agent-log' AND type = 'user' AND raw_text = 'prompt' AND NOT is_sidechain)) AS touch,
       epoch_us(CAST(local_day AS TIMESTAMP)) AS day_start_us, epoch_us(CAST(local_day + 1 AS TIMESTAMP)) AS day_end_us,
       CASE WHEN host = '' THEN '' ELSE host || CASE WHEN port <> '' THEN ':' || port ELSE '' END || CASE WHEN path_head <> '' THEN '/' || path_head ELSE '' END END AS key,
       cwd AS path FROM traces""",
    ),
    ("ent", "SELECT *, ts_us + span_us AS end_us, (touch OR span_us > 0) AS owns FROM e"),
    ("rule", f"SELECT * FROM {_rules()}"),
    (
        "hit",
        """SELECT ent.external_id, rule.*, coalesce(date_diff('day', DATE '1970-01-01', since), 0) AS since_n,
       CASE WHEN kind = 'title' THEN 1 WHEN kind = 'path' THEN 1048576 + length(rtrim(value, '*')) ELSE 1048576 + length(value) END AS n,
       CASE WHEN kind = 'title' THEN regexp_extract(title, value, 1) ELSE '' END AS capture
FROM ent JOIN rule ON (since IS NULL OR local_day >= since) AND (
  (kind = 'path' AND cwd <> '' AND CASE WHEN value LIKE '%*' THEN starts_with(cwd, rtrim(value, '*')) WHEN level = 'never' THEN cwd = value ELSE cwd = value OR starts_with(cwd, value || '/') END)
  OR (kind = 'key' AND host <> '' AND (host = rhost OR ends_with(host, '.' || rhost)) AND (rport = '' OR rport = port) AND (rsegment = '' OR rsegment = path_head))
  OR (kind = 'title' AND title <> '' AND regexp_matches(title, value)))""",
    ),
    ("floor_", "SELECT external_id, kind, n AS fn, since_n AS fs FROM (SELECT *, row_number() OVER (PARTITION BY external_id, kind ORDER BY n DESC, since_n DESC) AS r FROM hit WHERE level = 'never') WHERE r = 1"),
    ("op", "SELECT hit.* FROM hit LEFT JOIN floor_ f ON f.external_id = hit.external_id AND f.kind = hit.kind WHERE level IN ('project', 'subject') AND (fn IS NULL OR n > fn OR (n = fn AND since_n > fs))"),
    ("best", "SELECT external_id, rproject, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY n DESC, since_n DESC, rule_id) AS r FROM op WHERE level = 'project') WHERE r = 1"),
    (
        "subj",
        """SELECT external_id, name FROM (SELECT op.external_id, CASE WHEN op.rsubject <> '' THEN op.rsubject ELSE capture END AS name,
         row_number() OVER (PARTITION BY op.external_id ORDER BY op.rproject = '', n DESC, since_n DESC, op.rule_id) AS r
  FROM op LEFT JOIN best b ON b.external_id = op.external_id
  WHERE level = 'subject' AND (op.rproject = '' OR op.rproject = b.rproject) AND CASE WHEN op.rsubject <> '' THEN op.rsubject ELSE capture END <> '') WHERE r = 1""",
    ),
    (
        "named",
        """SELECT ent.*, b.external_id IS NOT NULL AS by_rule,
       CASE WHEN b.external_id IS NOT NULL THEN b.rproject WHEN f.external_id IS NULL THEN guess ELSE '' END AS own_project, coalesce(s.name, '') AS subject,
       ent.external_id IN (SELECT external_id FROM hit WHERE level <> 'subject') AS covered,
       coalesce((SELECT min(kind || ':' || value) FROM hit WHERE hit.external_id = ent.external_id AND level = 'ambiguous'), '') AS ambiguous
FROM ent LEFT JOIN best b ON b.external_id = ent.external_id LEFT JOIN subj s ON s.external_id = ent.external_id
LEFT JOIN floor_ f ON f.external_id = ent.external_id AND f.kind = 'path'""",
    ),
    ("m1", "SELECT *, max(end_us) OVER (PARTITION BY actor_id, local_day ORDER BY ts_us, source, external_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_us, row_number() OVER (PARTITION BY actor_id, local_day ORDER BY ts_us, source, external_id) AS nth FROM named"),
    ("blk", f"SELECT *, sum(CASE WHEN before_us IS NULL OR ts_us - before_us > {10 * US} THEN 1 ELSE 0 END) OVER (PARTITION BY actor_id, local_day ORDER BY nth ROWS UNBOUNDED PRECEDING) AS block_id, own_project <> '' AS own FROM m1"),
    ("anc0", "SELECT *, bool_or(own AND owns) OVER (PARTITION BY actor_id, local_day, block_id) AS strong FROM blk"),
    ("anc", "SELECT *, CASE WHEN strong THEN own AND owns ELSE own END AS anchor FROM anc0"),
    (
        "near",
        """SELECT anc.*, CASE WHEN own THEN own_project ELSE coalesce((
    SELECT a.own_project FROM anc a WHERE a.actor_id = anc.actor_id AND a.local_day = anc.local_day AND a.block_id = anc.block_id AND a.anchor
    ORDER BY abs(a.ts_us - anc.ts_us), CASE WHEN a.nth < anc.nth THEN 0 ELSE 1 END, CASE WHEN a.nth < anc.nth THEN -a.nth ELSE a.nth END LIMIT 1), '') END AS got FROM anc""",
    ),
    ("ends", "SELECT actor_id, local_day, block_id, arg_min(own_project, nth) AS first_named, arg_max(own_project, nth) AS last_named FROM anc WHERE anchor GROUP BY ALL"),
    ("bl", "SELECT actor_id, local_day, block_id, min(ts_us) AS block_from_us, max(end_us) AS block_end_us, max(least(end_us, day_end_us)) AS block_to_us, min(nth) AS lo, max(nth) AS hi, bool_or(touch) AS touched, count(*) AS events, any_value(day_start_us) AS day_start_us, any_value(day_end_us) AS day_end_us FROM blk GROUP BY ALL"),
    (
        "side",
        """SELECT bl.actor_id, bl.local_day, bl.block_id,
  (SELECT x.last_named FROM ends x WHERE x.actor_id = bl.actor_id AND x.local_day = bl.local_day AND x.block_id < bl.block_id ORDER BY x.block_id DESC LIMIT 1) AS b,
  (SELECT x.first_named FROM ends x WHERE x.actor_id = bl.actor_id AND x.local_day = bl.local_day AND x.block_id > bl.block_id ORDER BY x.block_id LIMIT 1) AS a,
  EXISTS (SELECT 1 FROM ends x WHERE x.actor_id = bl.actor_id AND x.local_day = bl.local_day AND x.block_id = bl.block_id) AS has FROM bl""",
    ),
    ("orig", "SELECT *, CASE WHEN has THEN 'own' WHEN b = a THEN 'neighbours' WHEN (b IS NULL) <> (a IS NULL) THEN 'one-neighbour' ELSE 'none' END AS origin FROM side"),
    (
        "b_",
        """SELECT near.*, o.origin, CASE WHEN o.origin IN ('neighbours', 'one-neighbour') THEN coalesce(o.b, o.a) ELSE got END AS project,
       CASE WHEN o.origin = 'none' AND o.b IS NOT NULL THEN least(o.b, o.a) || '|' || greatest(o.b, o.a) ELSE '' END AS candidates
FROM near JOIN orig o ON o.actor_id = near.actor_id AND o.local_day = near.local_day AND o.block_id = near.block_id""",
    ),
    (
        "own1",
        """SELECT b_.*, CASE WHEN owns THEN nth ELSE coalesce((
    SELECT t.nth FROM b_ t WHERE t.actor_id = b_.actor_id AND t.local_day = b_.local_day AND t.block_id = b_.block_id AND t.owns
    ORDER BY abs(t.ts_us - b_.ts_us), CASE WHEN t.nth < b_.nth THEN 0 ELSE 1 END, CASE WHEN t.nth < b_.nth THEN -t.nth ELSE t.nth END LIMIT 1), 0) END AS toucher FROM b_""",
    ),
    (
        "own_",
        """SELECT x.*, t.project AS owner, t.subject AS owner_subject, CASE WHEN x.toucher = 0 THEN '' ELSE t.session_id END AS owner_session,
       CASE WHEN t.project = '' THEN 'none' WHEN t.own AND t.by_rule THEN 'rule' WHEN t.own THEN 'fallback' WHEN x.origin IN ('neighbours', 'one-neighbour') THEN x.origin ELSE 'inherited' END AS ground
FROM own1 x JOIN b_ t ON t.actor_id = x.actor_id AND t.local_day = x.local_day AND t.nth = CASE WHEN x.toucher = 0 THEN x.nth ELSE x.toucher END""",
    ),
    (
        "pad",
        f"""SELECT bl.*, greatest(day_start_us, block_from_us - CASE WHEN f.touch AND f.source = 'agent-log' THEN least({2 * US}, coalesce((block_from_us - p.block_end_us) // 2, {2 * US})) ELSE 0 END) AS from_us,
       least(day_end_us, block_to_us + CASE WHEN touched THEN least({2 * US}, coalesce((n.nf - block_to_us) // 2, {2 * US})) ELSE 0 END) AS to_us
FROM bl JOIN (SELECT actor_id, local_day, nth, touch, source FROM blk) f ON f.actor_id = bl.actor_id AND f.local_day = bl.local_day AND f.nth = bl.lo
LEFT JOIN (SELECT actor_id, local_day, block_id + 1 AS block_id, max(end_us) AS block_end_us FROM blk GROUP BY ALL) p ON p.actor_id = bl.actor_id AND p.local_day = bl.local_day AND p.block_id = bl.block_id
LEFT JOIN (SELECT actor_id, local_day, block_id - 1 AS block_id, min(ts_us) AS nf FROM blk GROUP BY ALL) n ON n.actor_id = bl.actor_id AND n.local_day = bl.local_day AND n.block_id = bl.block_id""",
    ),
    ("answer", f"SELECT * FROM {_spans(fixtures.ANSWERS, 'project, subject, clear_subject, one_off, made_at')}"),
    (
        "cut_",
        """SELECT actor_id, local_day, block_id, ts_us AS at_us FROM blk
UNION SELECT k.actor_id, k.local_day, k.block_id, k.end_us FROM blk k JOIN bl ON bl.actor_id = k.actor_id AND bl.local_day = k.local_day AND bl.block_id = k.block_id WHERE k.end_us > k.ts_us AND k.end_us < bl.block_to_us
UNION SELECT bl.actor_id, bl.local_day, bl.block_id, x.at_us FROM bl JOIN (SELECT actor_id, local_day, unnest([from_us, to_us]) AS at_us FROM answer) x ON x.actor_id = bl.actor_id AND x.local_day = bl.local_day WHERE x.at_us > bl.block_from_us AND x.at_us < bl.block_to_us
UNION SELECT actor_id, local_day, block_id, block_to_us FROM bl""",
    ),
    ("st0", "SELECT *, lead(at_us) OVER (PARTITION BY actor_id, local_day, block_id ORDER BY at_us) AS to_us FROM cut_"),
    (
        "st1",
        """SELECT s.actor_id, s.local_day, s.block_id, s.at_us AS from_us, s.to_us, false AS padding, (SELECT max(k.nth) FROM blk k WHERE k.actor_id = s.actor_id AND k.local_day = s.local_day AND k.block_id = s.block_id AND k.ts_us <= s.at_us) AS opener
FROM st0 s WHERE s.to_us > s.at_us
UNION ALL SELECT actor_id, local_day, block_id, from_us, block_from_us, true, lo FROM pad WHERE from_us < block_from_us
UNION ALL SELECT actor_id, local_day, block_id, block_to_us, to_us, true, hi FROM pad WHERE to_us > block_to_us""",
    ),
    (
        "win0",
        f"SELECT actor_id, local_day, CASE WHEN span_us > 0 THEN ts_us ELSE ts_us - {5 * US} END AS f, CASE WHEN span_us > 0 THEN end_us ELSE ts_us + {5 * US} END AS t FROM ent WHERE touch OR span_us > 0",
    ),
    ("win1", "SELECT *, max(t) OVER (PARTITION BY actor_id, local_day ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM win0"),
    ("win2", "SELECT *, sum(CASE WHEN m IS NULL OR f > m THEN 1 ELSE 0 END) OVER (PARTITION BY actor_id, local_day ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS i FROM win1"),
    ("win", "SELECT actor_id, local_day, min(f) AS from_us, max(t) AS to_us FROM win2 GROUP BY actor_id, local_day, i"),
    (
        "st2",
        """SELECT st1.*, CASE WHEN padding THEN st1.to_us - st1.from_us ELSE coalesce((SELECT sum(least(w.to_us, st1.to_us) - greatest(w.from_us, st1.from_us)) FROM win w WHERE w.actor_id = st1.actor_id AND w.local_day = st1.local_day AND w.from_us < st1.to_us AND w.to_us > st1.from_us), 0) END AS attention_us,
  (SELECT arg_max(made_at, made_at) FROM answer a WHERE a.actor_id = st1.actor_id AND a.local_day = st1.local_day AND a.from_us <= st1.from_us + (st1.to_us - st1.from_us) // 2 AND st1.from_us + (st1.to_us - st1.from_us) // 2 < a.to_us) AS said FROM st1""",
    ),
    (
        "st",
        """SELECT s.actor_id, s.local_day, s.block_id, s.from_us, s.to_us, s.padding, s.opener, s.attention_us, s.to_us - s.from_us - s.attention_us AS background_us,
       CASE WHEN coalesce(a.project, '') <> '' THEN a.project ELSE o.owner END AS owner,
       CASE WHEN coalesce(a.subject, '') <> '' OR coalesce(a.clear_subject, false) THEN a.subject WHEN coalesce(a.project, '') <> '' THEN '' ELSE o.owner_subject END AS subject,
       CASE WHEN a.made_at IS NULL THEN o.ground WHEN a.one_off THEN 'one-off' ELSE 'manual' END AS ground,
       o.owner_session, o.origin, o.covered, o.path, o.key, o.ambiguous, o.project AS opener_project
FROM st2 s JOIN own_ o ON o.actor_id = s.actor_id AND o.local_day = s.local_day AND o.nth = s.opener
LEFT JOIN answer a ON a.actor_id = s.actor_id AND a.local_day = s.local_day AND a.made_at = s.said""",
    ),
    ("live0", f"SELECT actor_id, local_day, session_id, project, ts_us AS f, lead(ts_us) OVER (PARTITION BY actor_id, local_day, session_id, project ORDER BY nth) AS t FROM b_ WHERE source = 'agent-log' AND project <> ''"),
    ("live", f"SELECT * FROM live0 WHERE t - f <= {10 * US} AND t > f"),
    (
        "agent",
        """SELECT st.actor_id, st.local_day, st.from_us, live.project, sum(least(live.t, st.to_us) - greatest(live.f, st.from_us)) AS agent_us FROM st JOIN live ON live.actor_id = st.actor_id AND live.local_day = st.local_day
 AND live.f < st.to_us AND live.t > st.from_us AND live.project <> st.owner AND live.session_id <> st.owner_session GROUP BY ALL""",
    ),
    ("run0", "SELECT *, lag(owner) OVER w AS po, lag(to_us) OVER w AS pt FROM st WINDOW w AS (PARTITION BY actor_id, local_day ORDER BY from_us, to_us)"),
    ("run1", "SELECT *, sum(CASE WHEN po IS NULL OR po <> owner OR pt < from_us THEN 1 ELSE 0 END) OVER (PARTITION BY actor_id, local_day ORDER BY from_us, to_us ROWS UNBOUNDED PRECEDING) AS r FROM run0"),
    ("padp", "SELECT pad.*, lag(to_us) OVER (PARTITION BY actor_id, local_day ORDER BY block_id) AS prev_to FROM pad"),
    (
        "run",
        """SELECT actor_id, local_day, min(from_us) AS from_us, max(to_us) AS to_us, any_value(owner) AS project, sum(attention_us) AS attention_us, sum(background_us) AS background_us, false AS gap FROM run1 GROUP BY actor_id, local_day, r
UNION ALL SELECT p.actor_id, p.local_day, p.from_us, p.to_us, o.owner, 0, 0, false FROM padp p JOIN own_ o ON o.actor_id = p.actor_id AND o.local_day = p.local_day AND o.nth = p.lo WHERE p.to_us = p.from_us AND (prev_to IS NULL OR prev_to < p.from_us)
UNION ALL SELECT actor_id, local_day, prev_to, from_us, '', 0, 0, true FROM padp WHERE from_us > prev_to""",
    ),
    ("pause", f"SELECT * FROM {_spans(fixtures.PAUSES, 'worked, project, subject, answered_at')}"),
    ("cl0", "SELECT p.*, max(to_us) OVER (PARTITION BY actor_id, local_day ORDER BY from_us, answered_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken FROM pause p WHERE worked AND (actor_id, local_day) IN (SELECT (actor_id, local_day) FROM ent)"),
    ("cl1", "SELECT actor_id, local_day, greatest(from_us, coalesce(taken, from_us)) AS from_us, to_us, project, subject FROM cl0 WHERE to_us > greatest(from_us, coalesce(taken, from_us))"),
    (
        "claim",
        """SELECT * FROM (SELECT c.*, c.to_us - c.from_us - coalesce((SELECT sum(least(c.to_us, r.to_us) - greatest(c.from_us, r.from_us)) FROM run r WHERE NOT r.gap AND r.actor_id = c.actor_id AND r.local_day = c.local_day AND r.from_us < c.to_us AND r.to_us > c.from_us), 0) AS held_us FROM cl1 c) WHERE held_us > 0""",
    ),
    (
        "prow",
        """SELECT actor_id, local_day, project, sum(events) AS events, sum(attention_us) AS attention_us, sum(background_us) AS background_us, sum(agent_us) AS agent_us, sum(claimed_us) AS claimed_us, sum(wall_us) AS wall_us FROM (
 SELECT actor_id, local_day, project, count(*) AS events, 0 AS attention_us, 0 AS background_us, 0 AS agent_us, 0 AS claimed_us, max(least(end_us, day_end_us)) - min(ts_us) AS wall_us, 1 AS ok FROM own_ GROUP BY ALL
 UNION ALL SELECT actor_id, local_day, owner, 0, sum(attention_us), sum(background_us), 0, 0, 0, 1 FROM st GROUP BY ALL
 UNION ALL SELECT actor_id, local_day, project, 0, 0, 0, sum(agent_us), 0, 0, 0 FROM agent GROUP BY ALL
 UNION ALL SELECT actor_id, local_day, project, 0, 0, 0, 0, sum(held_us), 0, 1 FROM claim GROUP BY ALL) GROUP BY ALL HAVING max(ok) = 1""",
    ),
    (
        "srow",
        """SELECT actor_id, local_day, project, subject, sum(events) AS events, sum(attention_us) AS attention_us, sum(background_us) AS background_us FROM (
 SELECT actor_id, local_day, project, subject, count(*) AS events, 0 AS attention_us, 0 AS background_us FROM own_ WHERE subject <> '' GROUP BY ALL
 UNION ALL SELECT actor_id, local_day, owner, subject, 0, sum(attention_us), sum(background_us) FROM st WHERE subject <> '' GROUP BY ALL) GROUP BY ALL""",
    ),
    (
        "tot",
        """SELECT p.*, coalesce(t.attention_us, 0) AS attention_us, coalesce(t.background_us, 0) AS background_us, coalesce(t.attention_us + t.background_us, 0) AS active_us, coalesce(padding_us, 0) AS padding_us, coalesce(one_neighbour_us, 0) AS one_neighbour_us,
  coalesce(ag.agent_us, 0) AS agent_us, coalesce(cc.claimed_us, 0) AS claimed_us
FROM (SELECT actor_id, local_day, arg_max(to_us, block_id) - min(from_us) AS span_us, min(block_from_us) AS first_us, max(block_to_us) AS last_us, sum(events) AS events, count(*) AS blocks FROM pad GROUP BY ALL) p
LEFT JOIN (SELECT actor_id, local_day, sum(attention_us) AS attention_us, sum(background_us) AS background_us, sum(CASE WHEN padding THEN to_us - from_us ELSE 0 END) AS padding_us, sum(CASE WHEN origin = 'one-neighbour' THEN to_us - from_us ELSE 0 END) AS one_neighbour_us FROM st GROUP BY ALL) t ON t.actor_id = p.actor_id AND t.local_day = p.local_day
LEFT JOIN (SELECT actor_id, local_day, sum(agent_us) AS agent_us FROM agent GROUP BY ALL) ag ON ag.actor_id = p.actor_id AND ag.local_day = p.local_day
LEFT JOIN (SELECT actor_id, local_day, sum(held_us) AS claimed_us FROM claim GROUP BY ALL) cc ON cc.actor_id = p.actor_id AND cc.local_day = p.local_day""",
    ),
    (
        "unm",
        """SELECT u.*, coalesce(t.time_us, 0) AS time_us FROM (SELECT actor_id, local_day, path, key, count(*) AS events, arg_min(project, nth) AS project FROM own_ WHERE NOT covered AND (path <> '' OR key <> '') GROUP BY ALL) u
LEFT JOIN (SELECT actor_id, local_day, path, key, sum(to_us - from_us) AS time_us FROM st WHERE NOT covered AND (path <> '' OR key <> '') GROUP BY ALL) t ON t.actor_id = u.actor_id AND t.local_day = u.local_day AND t.path = u.path AND t.key = u.key""",
    ),
]


def after(last: str, select: str) -> str:
    """The chain up to the step last, then select. Later steps are used more than once, so they are materialised."""
    out = []
    for name, body in STEPS:
        out.append(f"{name} AS MATERIALIZED ({body})")
        if name == last:
            break
    else:
        raise KeyError(last)
    return "WITH " + ",\n".join(out) + "\n" + select
