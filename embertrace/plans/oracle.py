"""The pipeline in plain SQL, as a prefix of common table expressions.

It follows the definitions row by row (recursive steps per entity), so it shares
no idea with the Spark plans beyond the semantics.
"""

from __future__ import annotations

COOLDOWN_US = 12 * 3600 * 1_000_000
WINDOW_US = 24 * 3600 * 1_000_000

_RULE_FILES = {
    0: ("r1_repeated_error.yml", "Repeated Error"),
    1: ("r2_high_value_purchase.yml", "High Value Purchase"),
    2: ("r3_single_digit_signup.yml", "Single Digit Signup"),
    3: ("r4_browsing_above_floor.yml", "Browsing Above Floor"),
    4: ("r5_click_in_forties.yaml", "Click In Forties"),
}

EVENTS = """ev AS (
    SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS timestamp, epoch_us(ts) AS t, user_id,
           'user_' || user_id AS entity_name, event_type AS action,
           least(10, CAST(floor(value / 25) AS INTEGER)) AS sev,
           json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) AS ki,
           'WKSTN-' || lpad(CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS VARCHAR), 2, '0') AS host,
           event_id AS id
    FROM events
)"""

RULES = f"""rules AS (
    SELECT ord, title, level, pts, severity, mitre_id, tactic, tactic AS stage, summary,
           sha256(file || '|' || title) AS rule_id, file
    FROM (VALUES
        (0, '{_RULE_FILES[0][0]}', '{_RULE_FILES[0][1]}', 'medium', 10, 5, 'T1110', 'Credential Access',
         'An account produced an error'),
        (1, '{_RULE_FILES[1][0]}', '{_RULE_FILES[1][1]}', 'high', 20, 7, 'T1041', 'Exfiltration',
         'A purchase far above the usual amount'),
        (2, '{_RULE_FILES[2][0]}', '{_RULE_FILES[2][1]}', 'critical', 35, 10, 'T1068', 'Privilege Escalation',
         'Single Digit Signup'),
        (3, '{_RULE_FILES[3][0]}', '{_RULE_FILES[3][1]}', 'low', 5, 3, NULL, 'Discovery',
         'Browsing with a value above the floor'),
        (4, '{_RULE_FILES[4][0]}', '{_RULE_FILES[4][1]}', 'informational', 2, 1, 'T1059.001', 'Execution',
         'A click on an item in the forties')
    ) AS v(ord, file, title, level, pts, severity, mitre_id, tactic, summary)
)"""

HITS = """hits AS (
    SELECT ev.*, rules.*, sha256(ev.event_id || '|' || rules.rule_id) AS alert_id
    FROM ev JOIN rules ON CASE rules.ord
        WHEN 0 THEN action = 'error'
        WHEN 1 THEN action = 'purchase' AND sev BETWEEN 4 AND 10
        WHEN 2 THEN action = 'signup' AND regexp_full_match(k, '[0-9]')
        WHEN 3 THEN action IN ('click', 'view') AND sev <> 0
        ELSE action = 'click' AND starts_with(k, '4') END
)"""

FIRED = f"""numbered AS (
    SELECT *, row_number() OVER (PARTITION BY entity_name, ord ORDER BY t, event_id) AS rn FROM hits
), clock AS (
    SELECT entity_name, ord, rn, alert_id, t AS last, true AS fires FROM numbered WHERE rn = 1
    UNION ALL
    SELECT n.entity_name, n.ord, n.rn, n.alert_id,
           CASE WHEN n.t - c.last >= {COOLDOWN_US} THEN n.t ELSE c.last END, n.t - c.last >= {COOLDOWN_US}
    FROM clock c JOIN numbered n ON n.entity_name = c.entity_name AND n.ord = c.ord AND n.rn = c.rn + 1
), fired AS (
    SELECT h.*, row_number() OVER (PARTITION BY h.entity_name ORDER BY h.t, h.event_id, h.ord) AS n
    FROM hits h JOIN clock c ON c.alert_id = h.alert_id AND c.fires
)"""

CHAINED = f"""walk AS (
    SELECT entity_name, n, alert_id, alert_id AS head, t AS upd, [title] AS titles, 1 AS pos, true AS is_new
    FROM fired WHERE n = 1
    UNION ALL
    SELECT f.entity_name, f.n, f.alert_id,
           CASE WHEN f.t - w.upd <= {WINDOW_US} THEN w.head ELSE f.alert_id END,
           CASE WHEN f.t - w.upd <= {WINDOW_US} AND list_contains(w.titles, f.title) THEN w.upd ELSE f.t END,
           CASE WHEN f.t - w.upd > {WINDOW_US} THEN [f.title]
                WHEN list_contains(w.titles, f.title) THEN w.titles ELSE list_append(w.titles, f.title) END,
           CASE WHEN f.t - w.upd > {WINDOW_US} THEN 1
                WHEN list_contains(w.titles, f.title) THEN w.pos ELSE w.pos + 1 END,
           f.t - w.upd > {WINDOW_US} OR NOT list_contains(w.titles, f.title)
    FROM walk w JOIN fired f ON f.entity_name = w.entity_name AND f.n = w.n + 1
), chained AS (
    SELECT f.*, sha256(f.entity_name || '|' || w.head) AS chain_id, w.pos AS chain_position, w.is_new AS is_new_link,
           w.head = f.alert_id AS opens_chain, w.upd AS upd,
           f.pts + CASE WHEN w.pos >= 2 THEN 15 ELSE 0 END AS delta
    FROM fired f JOIN walk w ON w.alert_id = f.alert_id
)"""

DAY_US = 24 * 3600 * 1_000_000
LOSS = "greatest(1, CAST(floor({0} * CAST(0.05 AS DOUBLE)) AS BIGINT))"


def decay_fold(matches: str, points: str) -> str:
    """Entity risk step by step: every match of ``matches`` is a step, decay ticks lie between, ``points`` are added."""
    return f"""marks AS (
    SELECT *, {points} AS points, row_number() OVER w AS m, lag(t) OVER w AS previous
    FROM ({matches}) WINDOW w AS (PARTITION BY entity_name ORDER BY t, event_id, ord)
), gaps AS (
    SELECT *, CASE WHEN previous IS NULL THEN 0 ELSE greatest(0,
        (t - 1) // {DAY_US} - ((previous + {DAY_US} + {DAY_US} - 1) // {DAY_US}) + 1) END AS ticks FROM marks
), fold AS (
    SELECT entity_name, m, alert_id, CAST(0 AS BIGINT) AS before, CAST(least(100, points) AS BIGINT) AS after
    FROM gaps WHERE m = 1
    UNION ALL
    SELECT entity_name, m, alert_id, left_over, least(100, left_over + points) FROM (
        SELECT g.entity_name, g.m, g.alert_id, g.points, list_reduce(list_prepend(f.after, range(g.ticks)),
            lambda x, y: greatest(0, x - {LOSS.format("x")})) AS left_over
        FROM fold f JOIN gaps g ON g.entity_name = f.entity_name AND g.m = f.m + 1)
)"""


SCORED = f"""first_match AS (
    SELECT entity_name, arg_min(host, (t, event_id)) AS first_host, min(timestamp) AS first_seen,
           max(timestamp) AS last_seen
    FROM hits GROUP BY entity_name
), {decay_fold("SELECT h.*, c.delta FROM hits h LEFT JOIN chained c ON c.alert_id = h.alert_id", "coalesce(delta, 0)")
}, summed AS (
    SELECT c.*, fm.first_host AS entity_host,
           CAST(f.after AS INTEGER) AS entity_risk_after, CAST(f.before AS INTEGER) AS entity_risk_before,
           CAST(least(100, sum(delta) OVER c) AS INTEGER) AS chain_risk_after,
           CAST(least(100, sum(delta) OVER c - delta) AS INTEGER) AS chain_risk_before,
           min(c.timestamp) OVER c AS chain_started_at, make_timestamp(c.upd) AS chain_updated_at
    FROM chained c JOIN first_match fm USING (entity_name) JOIN fold f ON f.alert_id = c.alert_id
    WINDOW c AS (PARTITION BY chain_id ORDER BY n)
), alerts AS (
    SELECT *, is_new_link AND chain_risk_before >= 75 AS trips,
           coalesce(bool_or(is_new_link AND chain_risk_before >= 75) OVER (
               PARTITION BY chain_id ORDER BY n), false) AS is_escalated
    FROM summed
)"""

RISK_LEVEL = "CASE WHEN {0} >= 75 THEN 'CRITICAL' WHEN {0} >= 50 THEN 'HIGH' WHEN {0} >= 25 THEN 'MEDIUM' ELSE 'LOW' END"

CHAINS = f"""chains AS (
    SELECT chain_id, any_value(entity_name) AS entity_name, 'user' AS entity_type,
           arg_min(entity_host, n) AS entity_host, min(timestamp) AS started_at,
           max(timestamp) FILTER (is_new_link) AS updated_at, max(chain_risk_after) AS risk_score,
           {RISK_LEVEL.format("max(chain_risk_after)")} AS risk_level,
           bool_or(is_escalated) AS is_escalated, CAST(count(*) FILTER (is_new_link) AS INTEGER) AS link_count,
           count(*) AS alert_count,
           string_agg(title, ' > ' ORDER BY n) FILTER (is_new_link) AS links,
           string_agg(stage, ' → ' ORDER BY n) FILTER (is_new_link) AS stage_progression,
           round((max(t) FILTER (is_new_link) - min(t)) / 60000000.0, 1) AS duration_minutes
    FROM alerts GROUP BY chain_id
)"""

ENTITIES = f"""entities AS (
    SELECT sha256(entity_name) AS entity_id, entity_name AS name, 'user' AS type, fm.first_host AS host,
           fm.first_seen, fm.last_seen, arg_max(entity_risk_after, n) AS risk_score,
           {RISK_LEVEL.format("arg_max(entity_risk_after, n)")} AS risk_level,
           max(entity_risk_after) AS peak_risk, count(*) AS total_alerts, arg_max(chain_id, n) AS active_chain_id,
           count(*) FILTER (opens_chain) AS total_chains
    FROM alerts JOIN first_match fm USING (entity_name)
    GROUP BY entity_name, fm.first_host, fm.first_seen, fm.last_seen
)"""

_STEPS = [EVENTS, RULES, HITS, FIRED, CHAINED, SCORED, CHAINS, ENTITIES]


def _with(count: int, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([*_STEPS[:count], *more]) + " "


def on_events(sql: str, *more: str) -> str:
    return _with(1, *more) + sql


def on_hits(sql: str, *more: str) -> str:
    return _with(3, *more) + sql


def on_fired(sql: str, *more: str) -> str:
    return _with(4, *more) + sql


def on_chained(sql: str, *more: str) -> str:
    return _with(5, *more) + sql


def on_alerts(sql: str, *more: str) -> str:
    return _with(6, *more) + sql


def on_tables(sql: str, *more: str) -> str:
    return _with(8, *more) + sql
