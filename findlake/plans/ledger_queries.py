"""Ledger, baseline, memory, lifecycle and trend queries over events seen as findings."""

from pyspark.sql import functions as F

from findlake.operators import accept, ledger as L, lifecycle, summary, trends
from findlake.plans.registry import query
from findlake.plans.tables import FINDINGS_SQL, LEDGER_SQL, SESSIONS_SQL, findings, ledger, reviewed, session_one, session_two, table


@query(
    "summary_by_severity",
    f"""WITH {FINDINGS_SQL}, dims(severity) AS (VALUES ('critical'), ('high'), ('medium'), ('low'), ('informational'))
SELECT 'total' AS kind, '' AS key, count(*) AS findings FROM findings
UNION ALL SELECT 'severity', d.severity, count(f.ord) FROM dims d LEFT JOIN findings f ON f.severity = d.severity GROUP BY 2
UNION ALL SELECT 'category', category, count(*) FROM findings GROUP BY 2""",
)
def summary_by_severity(spark, sf_dir):
    return summary.finding_summary(findings(spark, sf_dir))


@query(
    "ledger_summary",
    f"""WITH {LEDGER_SQL},
states(s) AS (VALUES ('open'), ('acknowledged'), ('resolved'), ('dismissed'), ('reopened')),
dims(s) AS (VALUES ('critical'), ('high'), ('medium'), ('low'), ('informational')),
active AS (SELECT * FROM ledger WHERE status IN ('open', 'acknowledged', 'reopened'))
SELECT 'status' AS kind, s AS key, count(entry_id) AS entries FROM states LEFT JOIN ledger ON status = s GROUP BY 2
UNION ALL SELECT 'active_severity', s, count(entry_id) FROM dims LEFT JOIN active ON severity = s GROUP BY 2
UNION ALL SELECT 'active_category', category, count(*) FROM active GROUP BY 2""",
)
def ledger_summary(spark, sf_dir):
    return summary.ledger_summary(ledger(spark, sf_dir))


@query(
    "baseline_create",
    f"""WITH {SESSIONS_SQL}
SELECT repo, file || '::' || coalesce(rule_id, '') || '::' || anchor AS key, any_value(file) AS file,
       coalesce(min(rule_id), '') AS rule_id, arg_min(title, ord) AS title, count(*) AS count
FROM s1 GROUP BY 1, 2""",
)
def baseline_create(spark, sf_dir):
    return accept.create_baseline(session_one(spark, sf_dir))


@query(
    "baseline_apply",
    f"""WITH {SESSIONS_SQL},
keyed AS (SELECT *, file || '::' || coalesce(rule_id, '') || '::' || anchor AS key FROM s2),
base AS (SELECT repo, file || '::' || coalesce(rule_id, '') || '::' || anchor AS key, count(*) AS n FROM s1 GROUP BY 1, 2),
nth AS (SELECT *, row_number() OVER (PARTITION BY repo, key ORDER BY ord) AS k FROM keyed)
SELECT nth.repo, nth.ord, nth.key, k AS nth, k <= coalesce(n, 0) AS baselined
FROM nth LEFT JOIN base ON base.repo = nth.repo AND base.key = nth.key""",
)
def baseline_apply(spark, sf_dir):
    baseline = accept.create_baseline(session_one(spark, sf_dir))
    return accept.apply_baseline(session_two(spark, sf_dir), baseline).select("repo", "ord", "key", "nth", "baselined")


def outcome_sql(source: str) -> str:
    return f"""{LEDGER_SQL},
seen AS (
  SELECT s.*, coalesce('r:' || s.rule_id, 'c:' || s.category) AS identity,
         row_number() OVER w AS n, lag(anchor) OVER w AS before
  FROM {source} s WINDOW w AS (PARTITION BY repo, file, coalesce('r:' || s.rule_id, 'c:' || s.category) ORDER BY ord)
),
outcomes AS (
  SELECT s.repo, s.ord, s.file, s.identity, s.anchor, s.severity, s.line,
         coalesce(l.entry_id, substr(sha256(s.repo || '|' || s.file || '|' || s.identity || '|s2'), 1, 32)) AS entry_id,
         CASE WHEN n = 1 AND l.entry_id IS NULL THEN 'new'
              WHEN n = 1 AND l.status IN ('resolved', 'dismissed') THEN 'reopened'
              WHEN coalesce((CASE WHEN n = 1 THEN l.anchor ELSE before END) <> s.anchor, false) THEN 'changed'
              ELSE 'unchanged' END AS outcome
  FROM seen s LEFT JOIN ledger l ON l.repo = s.repo AND l.file = s.file AND l.identity = s.identity
)"""


@query("ledger_match", f"""WITH {LEDGER_SQL}
SELECT s.repo, s.ord, l.entry_id, coalesce(l.anchor <> s.anchor, false) AS changed
FROM s2 s LEFT JOIN ledger l ON l.repo = s.repo AND l.file = s.file
  AND l.identity = coalesce('r:' || s.rule_id, 'c:' || s.category)""")
def ledger_match(spark, sf_dir):
    return L.match(session_two(spark, sf_dir), ledger(spark, sf_dir)).select("repo", "ord", "entry_id", "changed")


def _serious(spark, sf_dir):
    """The second session reviewed with a bar: only critical and high findings are in it."""
    return session_two(spark, sf_dir).where("severity IN ('critical', 'high')")


def _synced(spark, sf_dir, rows=session_two, **options):
    return L.sync(rows(spark, sf_dir), ledger(spark, sf_dir), "s2", F.lit("2024-01-31").cast("timestamp"), **options)


@query(
    "ledger_outcomes",
    f"WITH {outcome_sql('s2')} SELECT repo, ord, entry_id, outcome FROM outcomes",
)
def ledger_outcomes(spark, sf_dir):
    return _synced(spark, sf_dir).outcomes.select("repo", "ord", "entry_id", "outcome")


def next_sql(source: str) -> str:
    return f"""{outcome_sql(source)},
touched AS (SELECT repo, entry_id, min(ord) AS first_ord, arg_max(anchor, ord) AS anchor, arg_max(severity, ord) AS severity,
                   arg_max(line, ord) AS line, bool_or(outcome = 'reopened') AS reopened FROM outcomes GROUP BY 1, 2),
next AS (
  SELECT coalesce(l.repo, t.repo) AS repo, coalesce(l.entry_id, t.entry_id) AS entry_id,
         CASE WHEN l.entry_id IS NULL THEN 'open'
              WHEN t.entry_id IS NOT NULL AND l.status IN ('resolved', 'dismissed') THEN 'reopened'
              WHEN t.entry_id IS NULL AND l.status NOT IN ('resolved', 'dismissed') THEN 'resolved'
              ELSE l.status END AS status,
         coalesce(t.anchor, l.anchor) AS anchor, coalesce(t.severity, l.severity) AS severity, coalesce(t.line, l.line) AS line,
         coalesce(l.entry_ord, t.first_ord) AS entry_ord,
         CASE WHEN t.entry_id IS NULL THEN 's1' ELSE 's2' END AS updated_session,
         1 * CAST(l.entry_id IS NOT NULL AS INTEGER) + CAST(l.moved_at IS NOT NULL AS INTEGER)
           + CAST(l.entry_id IS NULL OR (t.entry_id IS NOT NULL AND l.status IN ('resolved', 'dismissed'))
                  OR (t.entry_id IS NULL AND l.status NOT IN ('resolved', 'dismissed')) AS INTEGER) AS events,
         t.entry_id IS NULL AND l.status NOT IN ('resolved', 'dismissed') AS auto_resolved
  FROM ledger l FULL OUTER JOIN touched t ON l.repo = t.repo AND l.entry_id = t.entry_id
)"""


@query(
    "ledger_sync",
    f"WITH {next_sql('s2')} SELECT repo, entry_id, status, anchor, severity, line, entry_ord, updated_session, events FROM next",
)
def ledger_sync(spark, sf_dir):
    after = _synced(spark, sf_dir).ledger
    return after.select("repo", "entry_id", "status", "anchor", "severity", "line", "entry_ord", "updated_session", F.size("history").alias("events"))


@query(
    "sync_report",
    f"""WITH {next_sql('s3')}
SELECT repo, outcome, count(*) AS n FROM (
  SELECT repo, outcome FROM outcomes UNION ALL SELECT repo, 'auto_resolved' FROM next WHERE auto_resolved)
GROUP BY 1, 2""",
)
def sync_report(spark, sf_dir):
    return _synced(spark, sf_dir, _serious).report.groupBy("repo", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sync_scope_restore",
    f"""WITH {outcome_sql('s3')},
scope AS (SELECT DISTINCT repo, file FROM s2 WHERE severity = 'medium'),
ran(repo, tool) AS (SELECT DISTINCT repo, 'click' FROM s2 WHERE severity = 'critical' AND category = 'click')
SELECT l.repo, l.entry_id,
       l.status NOT IN ('resolved', 'dismissed') AND sc.file IS NOT NULL
         AND NOT (coalesce(l.rule_id, '') = 'click' AND ran.tool IS NULL) AS resolved_now
FROM ledger l
LEFT JOIN scope sc ON sc.repo = l.repo AND sc.file = l.file
LEFT JOIN ran ON ran.repo = l.repo AND ran.tool = l.rule_id
WHERE NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.repo = l.repo AND o.entry_id = l.entry_id)""",
)
def sync_scope_restore(spark, sf_dir):
    second, before = session_two(spark, sf_dir), ledger(spark, sf_dir)
    scope = L.sync_scope(second.where("severity = 'medium'"))
    ran = second.where("severity = 'critical' AND category = 'click'").select("repo", F.lit("click").alias("tool")).distinct()
    result = _synced(spark, sf_dir, _serious, scope=scope, ran_tools=ran, known_tools=["click"])
    untouched = before.join(result.outcomes.select("repo", "entry_id").distinct(), ["repo", "entry_id"], "left_anti")
    resolved = result.report.where("outcome = 'auto_resolved'").select("repo", "entry_id", F.lit(True).alias("hit"))
    return untouched.join(resolved, ["repo", "entry_id"], "left").select("repo", "entry_id", F.coalesce("hit", F.lit(False)).alias("resolved_now"))


@query(
    "change_references",
    f"""WITH {next_sql('s3')},
shown AS (SELECT DISTINCT repo, entry_id FROM outcomes WHERE severity = 'critical')
SELECT o.repo, o.entry_id, CASE o.outcome WHEN 'new' THEN 'introduced' ELSE 'reopened' END AS change, o.ord, n.severity, n.line
FROM outcomes o JOIN shown s ON s.repo = o.repo AND s.entry_id = o.entry_id JOIN next n ON n.repo = o.repo AND n.entry_id = o.entry_id
WHERE o.outcome IN ('new', 'reopened')
UNION ALL SELECT repo, entry_id, 'fixed', entry_ord, severity, line FROM next WHERE auto_resolved""",
)
def change_references(spark, sf_dir):
    result = _synced(spark, sf_dir, _serious)
    reported = result.outcomes.where("severity = 'critical'")
    return L.change_references(result.report, result.ledger, reported).select("repo", "entry_id", "change", "ord", "severity", "line")


@query(
    "memory_filter",
    f"""WITH {FINDINGS_SQL},
memory(kind, file, rule_id, category, status, item_ord) AS (VALUES
  ('suppression', 'u1', 'click', 'click', 'active', 1), ('suppression', 'u2', NULL, 'view', 'active', 2),
  ('suppression', 'u3', 'error', 'error', 'archived', 3), ('accepted-deviation', NULL, 'signup', NULL, 'active', 4),
  ('accepted-deviation', 'u5', 'error', NULL, 'active', 5), ('exception', 'u6', NULL, NULL, 'active', 6),
  ('exception', NULL, 'purchase', NULL, 'active', 7), ('exception', 'u1', 'click', NULL, 'active', 8),
  ('accepted-deviation', 'u6', 'click', NULL, 'active', 9), ('exception', 'u5', 'error', NULL, 'deprecated', 10)),
hits AS (
  SELECT f.repo, f.ord, m.item_ord, m.kind,
         row_number() OVER (PARTITION BY f.repo, f.ord ORDER BY CASE m.kind WHEN 'suppression' THEN 0 WHEN 'accepted-deviation' THEN 1 ELSE 2 END, m.item_ord) AS rn
  FROM findings f JOIN memory m ON m.status = 'active' AND (
    (m.kind = 'suppression' AND f.file = m.file AND ((m.rule_id IS NOT NULL AND f.rule_id = m.rule_id)
        OR (m.rule_id IS NULL AND f.rule_id IS NULL AND f.category = m.category)))
    OR (m.kind = 'accepted-deviation' AND f.rule_id = m.rule_id AND (m.file IS NULL OR f.file = m.file))
    OR (m.kind = 'exception' AND (m.rule_id IS NULL OR f.rule_id = m.rule_id) AND (m.file IS NULL OR f.file = m.file))))
SELECT f.repo, f.ord, 'm' || h.item_ord AS memory_item, h.kind AS suppressed_by
FROM findings f LEFT JOIN hits h ON h.repo = f.repo AND h.ord = f.ord AND h.rn = 1""",
)
def memory_filter(spark, sf_dir):
    rows = findings(spark, sf_dir)
    items = [
        ("suppression", "u1", "click", "click", "active", 1), ("suppression", "u2", None, "view", "active", 2),
        ("suppression", "u3", "error", "error", "archived", 3), ("accepted-deviation", None, "signup", None, "active", 4),
        ("accepted-deviation", "u5", "error", None, "active", 5), ("exception", "u6", None, None, "active", 6),
        ("exception", None, "purchase", None, "active", 7), ("exception", "u1", "click", None, "active", 8),
        ("accepted-deviation", "u6", "click", None, "active", 9), ("exception", "u5", "error", None, "deprecated", 10),
    ]
    names = ("kind", "file", "rule_id", "category", "status")
    listed = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, item)], F.lit(item[5]).cast("long").alias("item_ord")) for item in items])
    memory = rows.select("repo").distinct().select("repo", F.explode(listed).alias("m")).select("repo", "m.*")
    memory = memory.withColumn("item_id", F.concat(F.lit("m"), "item_ord"))
    return accept.apply_memory(rows, memory).select("repo", "ord", "memory_item", "suppressed_by")


STATE_SQL = """CASE event_type WHEN 'signup' THEN 'open' WHEN 'view' THEN 'acknowledged' WHEN 'purchase' THEN 'resolved'
  WHEN 'click' THEN 'dismissed' ELSE 'reopened' END"""
LEGAL_SQL = """(VALUES ('open','acknowledged'), ('open','resolved'), ('open','dismissed'), ('acknowledged','resolved'),
  ('acknowledged','dismissed'), ('resolved','reopened'), ('dismissed','reopened'), ('reopened','acknowledged'),
  ('reopened','resolved'), ('reopened','dismissed'))"""


def _requests(spark, sf_dir):
    kind = F.col("event_type")
    state = F.when(kind == "signup", "open").when(kind == "view", "acknowledged").when(kind == "purchase", "resolved").when(kind == "click", "dismissed").otherwise("reopened")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entry"), F.col("event_id").alias("ord"), state.alias("state"))


@query(
    "lifecycle_valid",
    f"""WITH e AS (SELECT user_id AS entry, event_id AS ord, {STATE_SQL} AS state FROM events),
p AS (SELECT *, lag(state) OVER (PARTITION BY entry ORDER BY ord) AS previous_state FROM e),
legal(a, b) AS {LEGAL_SQL}
SELECT entry, ord, state, previous_state, previous_state IS NULL OR a IS NOT NULL AS legal
FROM p LEFT JOIN legal ON previous_state = a AND state = b""",
)
def lifecycle_valid(spark, sf_dir):
    return lifecycle.check_sequence(_requests(spark, sf_dir), ["entry"], "ord", "state", lifecycle.LEDGER[1])


@query(
    "lifecycle_fold",
    f"""WITH RECURSIVE e AS (SELECT user_id AS entry, event_id AS ord, {STATE_SQL} AS state,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
legal(a, b) AS {LEGAL_SQL},
walk AS (
  SELECT entry, CAST(NULL AS BIGINT) AS ord, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS state_before, CAST(NULL AS BOOLEAN) AS accepted, 'open' AS state_after
  FROM (SELECT DISTINCT entry FROM e)
  UNION ALL
  SELECT e.entry, e.ord, e.n, w.state_after, l.a IS NOT NULL, CASE WHEN l.a IS NOT NULL THEN e.state ELSE w.state_after END
  FROM walk w JOIN e ON e.entry = w.entry AND e.n = w.n + 1 LEFT JOIN legal l ON l.a = w.state_after AND l.b = e.state
)
SELECT entry, ord, state_before, accepted, state_after FROM walk WHERE n > 0""",
)
def lifecycle_fold(spark, sf_dir):
    folded = lifecycle.fold(_requests(spark, sf_dir), ["entry"], "ord", "state", lifecycle.LEDGER)
    return folded.select("entry", "ord", "state_before", "accepted", "state_after")


NOW_MS = 1706745600000  # 2024-02-01 00:00 UTC, the end of the shared events


@query(
    "trends_weekly",
    f"""WITH {LEDGER_SQL},
since AS (SELECT CAST({NOW_MS} - 2592000000 AS BIGINT) AS s),
marks AS (
  SELECT 'i' AS what, epoch_us(opened) // 1000 AS ms FROM ledger
  UNION ALL SELECT 'r', epoch_us(moved_at) // 1000 FROM ledger WHERE status = 'resolved'),
counted AS (SELECT CAST(least(greatest(floor((ms - s) / 604800000.0), 0), 4) AS INTEGER) AS week,
  count(*) FILTER (what = 'i') AS introduced, count(*) FILTER (what = 'r') AS resolved FROM marks, since WHERE ms >= s GROUP BY 1)
SELECT CAST(g.week AS INTEGER) AS week, strftime(make_timestamp((s + g.week * 604800000) * 1000), '%Y-%m-%d') AS start,
       coalesce(introduced, 0) AS introduced, coalesce(resolved, 0) AS resolved
FROM generate_series(0, 4) g(week), since LEFT JOIN counted c ON c.week = g.week""",
)
def trends_weekly(spark, sf_dir):
    return trends.weekly(trends.entry_times(ledger(spark, sf_dir)), NOW_MS, 30)


@query(
    "mean_days_to_resolve",
    f"""WITH {LEDGER_SQL}
SELECT count(*) AS resolved, round(avg(((epoch_us(moved_at) // 1000) - (epoch_us(opened) // 1000)) / 86400000.0), 6) AS mean_days
FROM ledger WHERE status = 'resolved' AND epoch_us(moved_at) // 1000 >= {NOW_MS} - 2592000000""",
)
def mean_days_to_resolve(spark, sf_dir):
    out = trends.mean_days_to_resolve(trends.entry_times(ledger(spark, sf_dir)), NOW_MS, 30)
    return out.select("resolved", F.round("mean_days", 6).alias("mean_days"))


@query(
    "top_files_rules",
    f"""WITH {LEDGER_SQL},
active AS (SELECT * FROM ledger WHERE status IN ('open', 'acknowledged', 'reopened')),
f AS (SELECT 'file' AS kind, file AS name, count(*) AS open FROM active GROUP BY 2 ORDER BY open DESC, name LIMIT 5),
r AS (SELECT 'rule' AS kind, coalesce(rule_id, category) AS name, count(*) AS open FROM active GROUP BY 2 ORDER BY open DESC, name LIMIT 5)
SELECT * FROM f UNION ALL SELECT * FROM r""",
)
def top_files_rules(spark, sf_dir):
    entries = ledger(spark, sf_dir)
    by_file = trends.top(entries, F.col("file"), 5).select(F.lit("file").alias("kind"), "name", "open")
    by_rule = trends.top(entries, F.coalesce("rule_id", "category"), 5).select(F.lit("rule").alias("kind"), "name", "open")
    return by_file.unionByName(by_rule)


@query(
    "top_rules_per_repo",
    f"""WITH {LEDGER_SQL}
SELECT repo, name, open, CAST(position AS INTEGER) AS position FROM (
  SELECT repo, name, open, row_number() OVER (PARTITION BY repo ORDER BY open DESC, name) AS position FROM (
    SELECT repo, coalesce(rule_id, category) AS name, count(*) AS open FROM ledger
    WHERE status IN ('open', 'acknowledged', 'reopened') GROUP BY 1, 2)) WHERE position <= 5""",
)
def top_rules_per_repo(spark, sf_dir):
    return trends.top_per_repo(ledger(spark, sf_dir), F.coalesce("rule_id", "category"), 5).select("repo", "name", "open", "position")


@query(
    "history_feed",
    f"""WITH {LEDGER_SQL}
SELECT repo, entry_id, file, 0 AS step, epoch_us(opened) // 1000 AS at_ms, CAST(NULL AS VARCHAR) AS previous_state, 'open' AS new_state FROM ledger
UNION ALL SELECT repo, entry_id, file, 1, epoch_us(moved_at) // 1000, 'open', status FROM ledger WHERE moved_at IS NOT NULL""",
)
def history_feed(spark, sf_dir):
    feed = L.history_feed(ledger(spark, sf_dir)).withColumn("at_ms", F.unix_millis("timestamp"))
    return feed.select("repo", "entry_id", "file", "step", "at_ms", "previous_state", "new_state").orderBy(F.desc("at_ms"))


@query(
    "page_findings",
    f"""WITH {LEDGER_SQL},
rest AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY entry_ord) AS position, count(*) OVER (PARTITION BY repo) AS remaining
         FROM ledger WHERE entry_ord > 100),
totals AS (SELECT repo, count(*) AS total FROM ledger GROUP BY 1)
SELECT r.repo, r.entry_id, CAST(position AS INTEGER) AS position, total,
       CASE WHEN remaining > 20 AND position = 20 THEN entry_ord END AS next_cursor
FROM rest r JOIN totals t ON t.repo = r.repo WHERE position <= 20""",
)
def page_findings(spark, sf_dir):
    return L.page(ledger(spark, sf_dir), after=100, limit=20).select("repo", "entry_id", "position", "total", "next_cursor")


@query(
    "ledger_listing",
    f"""WITH {LEDGER_SQL}
SELECT repo, entry_id, status, severity FROM ledger
WHERE status IN ('open', 'acknowledged') AND severity IN ('critical', 'high', 'medium') AND category IN ('click', 'error')""",
)
def ledger_listing(spark, sf_dir):
    kept = L.listing(ledger(spark, sf_dir), ["open", "acknowledged"], ["critical", "high", "medium"], ["click", "error"])
    return kept.select("repo", "entry_id", "status", "severity")


@query(
    "fail_gate",
    f"""WITH {FINDINGS_SQL},
barred AS (SELECT *, CASE WHEN regexp_matches(file, '^u1[0-9]$') THEN 'critical' WHEN regexp_matches(file, '^u2[0-9]$') THEN 'none'
   WHEN regexp_matches(file, '^u[0-9]$') THEN 'medium' ELSE 'high' END AS bar FROM findings),
r(s, n) AS (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('informational', 4))
SELECT repo, count(*) FILTER (category <> 'view' AND a.n <= b.n) > 0 AS failed, count(*) FILTER (category <> 'view' AND a.n <= b.n) AS over_bar
FROM barred JOIN r a ON a.s = severity LEFT JOIN r b ON b.s = bar GROUP BY repo
UNION ALL SELECT 'clean-' || n_nationkey, false, 0 FROM nation""",
)
def fail_gate(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumn("counted", F.col("category") != "view")
    return accept.fail_gate(rows, "high", [(["u1?"], "critical"), (["u2?"], "none"), (["u?"], "medium")], repos=reviewed(spark, sf_dir, rows))
