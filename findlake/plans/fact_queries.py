"""Rule scan, intervals, environment names, context, coverage, model pass and quality queries."""

from pyspark.sql import functions as F

from findlake.functions import secrets
from findlake.functions.directives import parse_directives, suppression_comment
from findlake.operators import accept, context, coverage, envdocs, quality, rules, semantic
from findlake.plans.registry import query
from findlake.plans.tables import FINDINGS_SQL, LEDGER_SQL, LINES_SQL, findings, ledger, lines, table, texts

LINE_RULES = [
    rules.LineRule("no-ip-address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "medium", "security"),
    rules.LineRule("no-inline-token", r"(?i)\btoken\s*=", "high", "security"),
    rules.LineRule("no-shouting", r"\b[A-Z]{4,}\b", "low", "maintainability", "medium"),
    rules.LineRule("no-noise", r"###|\$\$\$|%%%", "informational", "maintainability", unless=r"(?i)license"),
    rules.SECRET_RULE,
]


@query(
    "rule_scan",
    f"""WITH {LINES_SQL},
rules(rule_id, re, unless) AS (VALUES ('no-ip-address', '\\b\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\b', 'x{{900}}'), ('no-inline-token', '(?i)\\btoken\\s*=', 'x{{900}}'),
  ('no-shouting', '\\b[A-Z]{{4,}}\\b', 'x{{900}}'), ('no-noise', '###|\\$\\$\\$|%%%', '(?i)license'))
SELECT path AS file, line, rule_id, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 200) AS excerpt
FROM lines JOIN rules ON regexp_matches(text, re) AND NOT regexp_matches(text, unless)""",
)
def rule_scan(spark, sf_dir):
    hits = rules.scan_lines(lines(spark, sf_dir).withColumnRenamed("path", "file"), LINE_RULES)
    return rules.with_excerpt(hits).select("file", F.col("line").cast("long").alias("line"), "rule_id", "excerpt")


@query(
    "secret_candidates",
    r"""WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)[A-Za-z0-9_.-]*(?:secret|token|password|passwd|api_?key|private_?key|credential)[A-Za-z0-9_.-]*["'']?\s*(?::=|=>|=|:)\s*["''`]([^"''`\n]+)["''`]', 1)) AS value FROM documents),
chars AS (SELECT DISTINCT value, string_split(value, '') AS cs FROM found),
judged AS (SELECT value, -list_sum(list_transform(list_distinct(cs), lambda c: (len(list_filter(cs, lambda x: x = c)) / len(cs)) * log2(len(list_filter(cs, lambda x: x = c)) / len(cs)))) AS entropy FROM chars)
SELECT doc_id, f.value FROM found f JOIN judged j ON j.value = f.value
WHERE length(f.value) >= 8 AND entropy >= 3.0 AND NOT regexp_matches(f.value, '^https?://|^[./~]|\s|^--|\.$|\||[\[\]()]|^\$')
  AND NOT regexp_matches(f.value, '(?i)^(x+|\*+|\.+|<.*>|your[_-].*|change[_-]?me.*|example.*|dummy.*|test.*|todo|none|null|undefined)$')""",
)
def secret_candidates(spark, sf_dir):
    found = texts(spark, sf_dir, "documents", "doc_id").select("doc_id", F.explode(secrets.named_literals(F.col("text"))).alias("s"))
    return found.select("doc_id", "s.value")


@query(
    "call_concepts",
    """WITH calls AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, replace(p_name, ' ', '.') AS callee FROM lineitem JOIN part ON p_partkey = l_partkey),
t(concept, ord, re, arg) AS (VALUES ('paint', 0, '^red\\.widget$', 1), ('paint', 1, '^.*\\.gear$', 0), ('paint', 2, '^red\\..*$', 2), ('size', 3, '^small\\..*$', 0), ('size', 4, '^(small|large)\\.ring$', 3), ('any-bolt', 5, '^.*bolt$', 0)),
h AS (SELECT callee, concept, arg_min(arg, ord)::INTEGER AS argument FROM (SELECT DISTINCT callee FROM calls) JOIN t ON regexp_matches(callee, re) GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concept, argument FROM calls JOIN h ON h.callee = calls.callee""".replace("\\\\", "\\"),
)
def call_concepts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit(".")).alias("callee"))
    spoken = F.element_at(F.array(*[F.lit(x) for x in ("typescript", "vue", "javascript")]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    calls = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "callee", spoken.alias("language"))
    entries = [("paint", 0, "red.widget@1"), ("paint", 1, "*.gear"), ("paint", 2, "red.*@2"), ("size", 3, "small.*"), ("size", 4, "{small,large}.ring@3"), ("any-bolt", 5, "*bolt")]
    concept_table = spark.createDataFrame([(c, "javascript", o, e) for c, o, e in entries], "concept string, language string, ord int, entry string")
    return rules.call_concepts(calls, rules.compile_concepts(concept_table)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "concept", "argument")


@query(
    "interval_join",
    """WITH loops AS (SELECT user_id AS u, event_id AS s, event_id + CAST(floor(value) AS BIGINT) * 20 AS e FROM events WHERE event_type = 'purchase'),
calls AS (SELECT user_id AS u, event_id AS c, event_id - CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) * 2 AS BIGINT) AS b FROM events WHERE event_type = 'click')
SELECT DISTINCT CAST(u % 10 AS VARCHAR) AS repo, c AS call_id FROM calls WHERE EXISTS (
  SELECT 1 FROM loops l WHERE l.u = calls.u AND l.s <= least(c, b) AND greatest(c + 1, b + 1) <= l.e)""",
)
def interval_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("string").alias("repo"), F.concat(F.lit("u"), "user_id").alias("file"), F.lit(1).alias("function"), "event_id", "event_type", "value", "props"
    )
    place = ["repo", "file", "function"]
    loops = events.where("event_type = 'purchase'").select(*place, F.col("event_id").alias("start"), (F.col("event_id") + F.floor("value") * 20).alias("end"))
    clicks = events.where("event_type = 'click'")
    calls = clicks.select(*place, F.col("event_id").alias("call_id"), F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"))
    back = F.col("event_id") - F.get_json_object("props", "$.k").cast("long") * 2
    refs = clicks.select("repo", "file", F.col("event_id").alias("call_id"), back.alias("b_start"), (back + 1).alias("b_end"))
    return rules.calls_in_loops(calls, loops, refs).select("repo", "call_id")


def _doc_files(spark, sf_dir):
    nation = F.col("c_nationkey") % 4
    name = F.concat(F.lit("V"), F.substring("c_mktsegment", 1, 3), F.lit("_"), (F.col("c_custkey") % 50).cast("string"))
    customer = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("d"), "c_custkey", F.when(nation == 0, "/.env.example").when(nation == 1, "/README.md").when(nation == 2, "/Dockerfile").otherwise("/docker-compose.yml"))
    content = (
        F.when(nation == 0, F.concat(F.lit("# optional\n# export "), name, F.lit("=1\nnot a name\n")))
        .when(nation == 1, F.concat(F.lit("# Title\nUse `"), name, F.lit("` here, NOT_CODE there.\n```sh\nrun $LOWER\n```\n")))
        .when(nation == 2, F.concat(F.lit("FROM x\nENV A1=\"two words\" \\\n  "), name, F.lit("=3\n")))
        .otherwise(F.concat(F.lit("services:\n  web:\n    environment:\n      - "), name, F.lit("\n      "), name, F.lit("X: 1\n")))
    )
    return customer.select(F.lit("shop").alias("repo"), path.alias("path"), content.alias("content"))


@query(
    "env_docs_gap",
    """WITH names AS (SELECT DISTINCT 'V' || substr(c_mktsegment, 1, 3) || '_' || (c_custkey % 50) AS name FROM customer
  UNION SELECT 'LOWER' UNION SELECT 'A1' UNION SELECT DISTINCT 'V' || substr(c_mktsegment, 1, 3) || '_' || (c_custkey % 50) || 'X' FROM customer WHERE c_nationkey % 4 = 3),
reads AS (SELECT o_custkey AS c, o_orderkey AS start, CASE WHEN o_orderkey % 9 = 0 THEN 'CI_JOB' WHEN o_orderkey % 9 = 1 THEN 'PATH' ELSE 'V' || substr(o_orderpriority, 3, 3) || '_' || (o_orderkey % 60) END AS name, o_orderstatus = 'F' AS fallback FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 'VAUT_' || (o_orderkey % 70), o_orderstatus = 'F' FROM orders),
gap AS (SELECT * FROM reads WHERE name NOT IN (SELECT name FROM names) AND name NOT IN ('PATH') AND NOT starts_with(name, 'CI_'))
SELECT 'f' || c || '.ts' AS file, name, min(start) AS start, CASE WHEN arg_min(fallback, start) THEN 'low' ELSE 'medium' END AS confidence FROM gap GROUP BY 1, 2""",
)
def env_docs_gap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey") % 9
    first = F.when(n == 0, "CI_JOB").when(n == 1, "PATH").otherwise(F.concat(F.lit("V"), F.substring("o_orderpriority", 3, 3), F.lit("_"), (F.col("o_orderkey") % 60).cast("string")))
    second = F.concat(F.lit("VAUT_"), (F.col("o_orderkey") % 70).cast("string"))
    reads = orders.select(
        F.lit("shop").alias("repo"), F.concat(F.lit("f"), "o_custkey", F.lit(".ts")).alias("file"), F.explode(F.array(first, second)).alias("name"), F.col("o_orderkey").alias("start"), F.lit(1).alias("line"), (F.col("o_orderstatus") == "F").alias("fallback")
    )
    return envdocs.undocumented_reads(reads, envdocs.documented(_doc_files(spark, sf_dir))).select("file", "name", "start", "confidence")


@query(
    "documented_names",
    """SELECT DISTINCT 'V' || substr(c_mktsegment, 1, 3) || '_' || (c_custkey % 50) AS name FROM customer
  UNION SELECT 'LOWER' FROM customer WHERE c_nationkey % 4 = 1 UNION SELECT 'A1' FROM customer WHERE c_nationkey % 4 = 2
  UNION SELECT 'V' || substr(c_mktsegment, 1, 3) || '_' || (c_custkey % 50) || 'X' FROM customer WHERE c_nationkey % 4 = 3""",
)
def documented_names(spark, sf_dir):
    return envdocs.documented(_doc_files(spark, sf_dir)).select("name")


@query(
    "code_window",
    """SELECT f.conv_id AS file, f.turn AS line, w.turn AS n, substr(sha256(w.text), 1, 8) AS text_hash
FROM conversations f JOIN conversations w ON w.conv_id = f.conv_id AND w.turn BETWEEN f.turn - 2 AND f.turn + 2
WHERE f.role = 'assistant'""",
)
def code_window(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.lit("chat").alias("repo"), F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("line"), "text", "role")
    view = semantic.windows(turns.where("role = 'assistant'"), turns, radius=2)
    return view.select("file", (F.col("line") - 1).alias("line"), (F.col("n") - 1).alias("n"), F.substring(F.sha2("text", 256), 1, 8).alias("text_hash"))


@query(
    "planted_interval",
    """WITH planted AS (SELECT user_id AS case_id, event_id AS planted_id, event_type AS category, event_id % 500 AS line FROM events WHERE event_type IN ('error', 'purchase')),
claims AS (SELECT user_id AS case_id, event_id AS claim_id, event_id % 500 AS line FROM events WHERE event_type = 'click'),
r AS (SELECT category, count(*) AS whole, count(*) FILTER (EXISTS (SELECT 1 FROM claims c WHERE c.case_id = p.case_id AND abs(c.line - p.line) <= 2)) AS part FROM planted p GROUP BY 1
  UNION ALL SELECT NULL, count(*), count(*) FILTER (EXISTS (SELECT 1 FROM planted p WHERE p.case_id = c.case_id AND abs(c.line - p.line) <= 2)) FROM claims c)
SELECT category, whole, part, round(part / whole, 9) AS ratio FROM r""",
)
def planted_interval(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_id", "event_type", (F.col("event_id") % 500).alias("line"))
    planted = events.where("event_type IN ('error', 'purchase')").select("case_id", F.col("event_id").alias("planted_id"), F.col("event_type").alias("category"), "line")
    claimed = events.where("event_type = 'click'").select("case_id", F.col("event_id").alias("claim_id"), "line")
    scores = quality.detection_scores(planted, claimed)
    return scores.select("category", "whole", "part", F.round("ratio", 9).alias("ratio"))


@query(
    "eval_precision_recall",
    """WITH o AS (SELECT d.lang AS category, l.quality = 1 AS real, CASE WHEN l.toxic = 1 THEN 'doubtful' WHEN d.n_chars < 300 THEN 'unsure' WHEN d.n_chars > 3000 THEN 'failed' ELSE 'confirmed' END AS verdict
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
s AS (SELECT category, count(*) AS cases, count(*) FILTER (real) AS "real", count(*) FILTER (NOT real) AS false_positive, count(*) FILTER (verdict = 'confirmed') AS confirmed,
  count(*) FILTER (verdict = 'doubtful') AS doubtful, count(*) FILTER (verdict = 'unsure') AS unsure, count(*) FILTER (verdict = 'failed') AS failed,
  count(*) FILTER (verdict = 'doubtful' AND NOT real) AS doubted_right, count(*) FILTER (verdict = 'doubtful' AND real) AS real_doubted FROM o GROUP BY ROLLUP (category))
SELECT *, round(doubted_right / nullif(doubtful, 0), 9) AS doubt_precision, round(doubted_right / nullif(false_positive, 0), 9) AS false_positive_recall,
  round(("real" - real_doubted) / nullif("real", 0), 9) AS real_retained FROM s""",
)
def eval_precision_recall(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    n = F.col("n_chars")
    verdict = F.when(F.col("toxic") == 1, "doubtful").when(n < 300, "unsure").when(n > 3000, "failed").otherwise("confirmed")
    outcomes = labels.join(documents, "doc_id").select(F.col("lang").alias("category"), (F.col("quality") == 1).alias("real"), verdict.alias("verdict"))
    scores = quality.verification_scores(outcomes)
    ratios = ("doubt_precision", "false_positive_recall", "real_retained")
    return scores.select(*[F.round(c, 9).alias(c) if c in ratios else F.col(c) for c in scores.columns])


@query(
    "claim_grounding",
    """WITH t AS (SELECT conv_id, turn, text, regexp_replace(text, '\\s+', ' ', 'g') AS flat, regexp_replace(text, '\\s', '', 'g') AS sq FROM conversations),
claims AS (SELECT a.conv_id, a.turn, CASE WHEN a.turn % 3 = 0 THEN a.turn + 1 ELSE a.turn END AS line, substr(regexp_replace(regexp_replace(substr(a.flat, 5, 30), '["\\\\]', '', 'g'), '^ +| +$', '', 'g'), 1, 200) AS quote FROM t a)
SELECT c.conv_id AS file, c.turn AS pos, CASE WHEN length(quote) >= 4 AND contains(coalesce(b.sq, ''), replace(quote, ' ', '')) THEN 'detected' ELSE 'rejected' END AS status
FROM claims c LEFT JOIN t b ON b.conv_id = c.conv_id AND b.turn = c.line""".replace("\\\\s", "\\s"),
)
def claim_grounding(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.lit("chat").alias("repo"), F.col("conv_id").alias("file"), F.col("turn").cast("int").alias("line"), "text")
    flat = F.regexp_replace("text", r"\s+", " ")
    quote = F.regexp_replace(F.substring(flat, 5, 30), r'["\\]', "")
    at = F.when(F.col("line") % 3 == 0, F.col("line") + 1).otherwise(F.col("line"))
    issue = F.struct(at.cast("string").alias("line"), quote.alias("quote"), F.concat(F.lit("claim "), F.col("line").cast("string")).alias("title"), F.lit("because").alias("why"))
    reply = F.concat(F.lit("Here: "), F.to_json(F.struct(F.array(issue).alias("issues"))), F.lit(" done"))
    replies = turns.select("repo", F.concat_ws("#", "file", "line").alias("file"), reply.alias("reply"))
    asked = turns.select("repo", "file", F.col("line").alias("asked")).withColumn("line", F.explode(F.array("asked", F.col("asked") + 1)))
    shown = turns.join(asked, ["repo", "file", "line"])
    near = shown.select("repo", F.concat_ws("#", "file", "asked").alias("file"), "line", "text")
    found = semantic.claims(replies, near, near.limit(0))
    return found.select(F.split("file", "#")[0].cast("long").alias("file"), F.split("file", "#")[1].cast("long").alias("pos"), "status")


@query(
    "explain_finding",
    f"""WITH {LEDGER_SQL}
SELECT repo, entry_id, CASE rule_id WHEN 'click' THEN 'clicks are costly' WHEN 'error' THEN 'errors hurt' END AS why,
  CASE WHEN moved_at IS NULL THEN 1 ELSE 2 END AS events,
  '// findlake-ignore-next-line ' || rule_id || ' -- accepted in review' AS suppression
FROM ledger WHERE rule_id IS NOT NULL""",
)
def explain_finding(spark, sf_dir):
    guidance = spark.createDataFrame([("click", "clicks are costly"), ("error", "errors hurt")], "rule_id string, why string")
    entries = ledger(spark, sf_dir).where("rule_id IS NOT NULL").join(guidance, "rule_id", "left")
    comment = suppression_comment(F.col("file"), F.col("rule_id"), F.lit("accepted in review"))
    return entries.select("repo", "entry_id", "why", F.size("history").alias("events"), comment.alias("suppression"))


@query(
    "accept_into_memory",
    f"""WITH {LEDGER_SQL}
SELECT repo, file, rule_id, status IN ('open', 'acknowledged', 'reopened') AS dismissed FROM ledger WHERE rule_id IS NOT NULL AND length('why ' || severity) >= 8""",
)
def accept_into_memory(spark, sf_dir):
    entries = ledger(spark, sf_dir)
    requests = entries.select("repo", "entry_id", F.concat(F.lit("why "), "severity").alias("reason"), F.lit("2024-02-01").cast("timestamp").alias("requested_at"))
    items, dismissed, _ = accept.accept_into_memory(requests, entries)
    keyed = dismissed.join(entries.select("repo", "entry_id", "file", "rule_id"), ["repo", "entry_id"]).select("repo", "file", "rule_id", F.lit(True).alias("dismissed"))
    return items.join(keyed, ["repo", "file", "rule_id"], "left").select("repo", "file", "rule_id", F.coalesce("dismissed", F.lit(False)).alias("dismissed"))


@query(
    "inline_directives",
    f"""WITH {FINDINGS_SQL},
c AS (SELECT CAST(user_id % 10 AS VARCHAR) AS repo, 'u' || user_id AS file, CAST(event_id % 500 + 1 AS INTEGER) AS line, event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error'),
d AS (SELECT repo, file, line, CASE k % 3 WHEN 0 THEN 'line' WHEN 1 THEN 'next-line' ELSE 'file' END AS scope, CASE WHEN k % 3 = 2 THEN 'purchase' WHEN k % 2 = 0 THEN 'click' END AS rule FROM c),
hits AS (SELECT f.repo, f.ord, min(d.line) AS directive_line FROM findings f JOIN d ON d.repo = f.repo AND d.file = f.file
  AND (d.rule IS NULL OR d.rule = f.rule_id) AND (d.scope = 'file' OR (d.scope = 'line' AND d.line = f.line) OR (d.scope = 'next-line' AND d.line + 1 = f.line)) GROUP BY 1, 2)
SELECT f.repo, f.ord, h.directive_line FROM findings f LEFT JOIN hits h ON h.repo = f.repo AND h.ord = f.ord""",
)
def inline_directives(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    scope = F.when(k % 3 == 0, "").when(k % 3 == 1, "-next-line").otherwise("-file")
    named = F.when(k % 3 == 2, " purchase").when(k % 2 == 0, " click").otherwise("")
    comments = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        (F.col("user_id") % 10).cast("string").alias("repo"), F.concat(F.lit("u"), "user_id").alias("file"), (F.col("event_id") % 500 + 1).cast("int").alias("line"),
        F.concat(F.lit(" findlake-ignore"), scope, named, F.lit(" -- known")).alias("text"),
    )
    return accept.apply_directives(findings(spark, sf_dir), parse_directives(comments)).select("repo", "ord", "directive_line")


@query(
    "changed_line_filter",
    f"""WITH {FINDINGS_SQL},
changed AS (SELECT DISTINCT CAST(o_custkey % 150 % 10 AS VARCHAR) AS repo, 'u' || (o_custkey % 150) AS file, CAST(o_orderkey % 500 + 1 AS INTEGER) AS line FROM orders WHERE o_orderstatus = 'F'),
fresh AS (SELECT DISTINCT 'u' || (o_custkey % 150) AS file FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000)
SELECT repo, ord FROM findings f WHERE file IN (SELECT file FROM fresh) OR EXISTS (SELECT 1 FROM changed c WHERE c.repo = f.repo AND c.file = f.file AND c.line = f.line)""",
)
def changed_line_filter(spark, sf_dir):
    key = F.col("o_custkey") % 150
    orders = table(spark, sf_dir, "orders").withColumn("repo", (key % 10).cast("string")).withColumn("file", F.concat(F.lit("u"), key))
    changed = orders.where("o_orderstatus = 'F'").select("repo", "file", (F.col("o_orderkey") % 500 + 1).cast("int").alias("line"))
    fresh = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 450000)
    listed = orders.where((F.col("o_orderstatus") == "F") | fresh).select("repo", "file", fresh.alias("untracked"))
    return accept.on_changed_lines(findings(spark, sf_dir), changed, listed).select("repo", "ord")


@query(
    "language_coverage",
    """WITH f AS (SELECT source AS repo, lang, n_chars > 3000 AS bad, CASE WHEN n_chars < 100 THEN 3 WHEN n_chars > 3000 THEN 1 ELSE 0 END AS st FROM documents)
SELECT repo, lang AS language, count(*) AS files, count(*) FILTER (bad) AS files_with_errors, CASE max(st) WHEN 3 THEN 'not-covered' WHEN 1 THEN 'partial' ELSE 'checked' END AS status FROM f GROUP BY 1, 2""",
)
def language_coverage(spark, sf_dir):
    n = F.col("n_chars")
    status = F.when(n < 100, "not-covered").when(n > 3000, "partial").otherwise("checked")
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("language"), (n > 3000).alias("has_errors"), status.alias("status"), status.alias("reason"))
    return coverage.language_coverage(files).select("repo", "language", "files", "files_with_errors", "status")


@query(
    "rule_gaps",
    f"""WITH {FINDINGS_SQL}
SELECT DISTINCT repo, rule_id FROM findings WHERE rule_id IS NOT NULL AND rule_id NOT IN (SELECT DISTINCT category FROM findings WHERE severity = 'critical' AND category IN ('click', 'error'))""",
)
def rule_gaps(spark, sf_dir):
    rows = findings(spark, sf_dir)
    policy = rows.where("rule_id IS NOT NULL").select("repo", "rule_id").distinct()
    registry = rows.where("severity = 'critical' AND category IN ('click', 'error')").select(F.col("category").alias("rule_id"))
    return coverage.rule_gaps(policy, registry).select("repo", "rule_id")


PATHS = ["Cargo.toml", "package.json", "pyproject.toml", "go.mod", "bun.lock", "README.md", "ARCHITECTURE.md", ".editorconfig", "docs/adr/0001-x.md", "turbo.json", "src/domain/a.ts", "src/adapters/b.ts"]


def _context_files(spark, sf_dir):
    index = (F.col("o_orderkey") % 12).cast("int")
    rich = F.col("o_orderkey") % 2 == 0
    path = F.element_at(F.array(*[F.lit(p) for p in PATHS]), index + 1)
    content = (
        F.when((path == "package.json") & (F.col("o_orderkey") % 5 < 2), '{"dependencies":{"react":"^18","hono":"1"},"engines":{"node":">=18"}}')
        .when(path == "package.json", '{"devDependencies":{"typescript":"5"}}')
        .when((path == "pyproject.toml") & (F.col("o_orderkey") % 5 < 2), 'dependencies = ["Django>=4"]')
        .when(path == "ARCHITECTURE.md", F.concat(F.lit("# Shape\n## Layers "), F.col("o_orderpriority"), F.lit("\ntext\n### Rules\n")))
        .when(path == ".editorconfig", F.concat(F.lit("root = true\n[*.ts]\nindent_size = "), (F.col("o_orderkey") % 8).cast("string"), F.lit("\n; note\n")))
        .when(path == "README.md", F.concat(F.lit("# Repo "), "o_orderstatus", F.lit("\nSome words here\n")))
        .otherwise("x")
    )
    first = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repo"), path.alias("path"), "o_orderkey", content.alias("content"), rich.alias("rich"))
    return first.groupBy("repo", "path").agg(F.min_by("content", "o_orderkey").alias("content"))


CONTEXT_SQL = """
firsts AS (SELECT CAST(o_custkey AS VARCHAR) AS repo, o_orderkey % 12 AS i, min(o_orderkey) AS k, arg_min(o_orderpriority, o_orderkey) AS pri, arg_min(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY 1, 2),
signals AS (
  SELECT repo, s.kind, s.value, s.i FROM firsts JOIN (VALUES (0, 'language', 'Rust'), (0, 'build', 'Cargo'), (1, 'language', 'JavaScript/TypeScript'), (2, 'language', 'Python'), (3, 'language', 'Go'),
    (4, 'manager', 'Bun'), (4, 'runtime', 'Bun'), (9, 'build', 'Turborepo'), (9, 'workspace', 'monorepo')) s(i, kind, value) ON s.i = firsts.i
  UNION ALL SELECT repo, 'framework', 'React', 1 FROM firsts WHERE i = 1 AND k % 5 < 2
  UNION ALL SELECT repo, 'runtime', 'Node.js', 1 FROM firsts WHERE i = 1 AND k % 5 < 2
  UNION ALL SELECT repo, 'framework', 'Django', 2 FROM firsts WHERE i = 2 AND k % 5 < 2)"""


@query("stack_signals", f"WITH {CONTEXT_SQL} SELECT repo, kind, value, count(*) AS evidence FROM signals GROUP BY 1, 2, 3")
def stack_signals(spark, sf_dir):
    return context.stack_profile(context.stack_signals(_context_files(spark, sf_dir))).select("repo", "kind", "value", "evidence")


@query(
    "capabilities",
    f"""WITH {CONTEXT_SQL},
caps AS (
  SELECT repo, CASE WHEN kind IN ('build', 'manager', 'runtime') THEN 'tooling' ELSE kind END AS kind, CASE value WHEN 'JavaScript/TypeScript' THEN 'javascript' ELSE value END AS id FROM signals WHERE kind <> 'workspace'
  UNION ALL SELECT DISTINCT repo, 'platform', 'web' FROM signals WHERE value = 'React'
  UNION ALL SELECT repo, 'framework', 'hono' FROM firsts WHERE i = 1 AND k % 5 < 2
  UNION ALL SELECT repo, 'language', 'typescript' FROM firsts WHERE i = 1 AND k % 5 >= 2
  UNION ALL SELECT repo, 'characteristic', 'workspace' FROM firsts WHERE i = 9
  UNION ALL SELECT a.repo, 'characteristic', 'layered' FROM firsts a JOIN firsts b ON a.repo = b.repo AND a.i = 10 AND b.i = 11)
SELECT repo, id, any_value(kind) AS kind, count(*) AS evidence FROM caps GROUP BY 1, 2""",
)
def capabilities(spark, sf_dir):
    files = _context_files(spark, sf_dir)
    return context.capabilities(files, context.stack_signals(files)).select("repo", "id", "kind", "evidence")


@query(
    "criteria_rules",
    f"""WITH {CONTEXT_SQL}
SELECT repo, 'ARCHITECTURE.md:1' AS rule_id, 'Layers ' || pri AS description FROM firsts WHERE i = 6
UNION ALL SELECT repo, 'ARCHITECTURE.md:2', 'Rules' FROM firsts WHERE i = 6
UNION ALL SELECT repo, 'editorconfig:*:root', 'EditorConfig "root" = "true" for *' FROM firsts WHERE i = 7
UNION ALL SELECT repo, 'editorconfig:*.ts:indent_size', 'EditorConfig "indent_size" = "' || (k % 8) || '" for *.ts' FROM firsts WHERE i = 7""",
)
def criteria_rules(spark, sf_dir):
    return context.criteria(_context_files(spark, sf_dir)).select("repo", "rule_id", "description")


@query(
    "understanding",
    f"""WITH {CONTEXT_SQL},
r AS (SELECT DISTINCT repo FROM firsts),
q AS (SELECT repo, (NOT EXISTS (SELECT 1 FROM signals s WHERE s.repo = r.repo AND kind = 'language'))::INT
  + (EXISTS (SELECT 1 FROM signals s WHERE s.repo = r.repo AND value = 'JavaScript/TypeScript') AND NOT EXISTS (SELECT 1 FROM signals s WHERE s.repo = r.repo AND kind = 'runtime'))::INT
  + (NOT EXISTS (SELECT 1 FROM firsts f WHERE f.repo = r.repo AND i IN (5, 6, 8)))::INT + (NOT EXISTS (SELECT 1 FROM firsts f WHERE f.repo = r.repo AND i IN (6, 7)))::INT AS n FROM r)
SELECT repo, n AS questions, CASE WHEN n = 0 THEN 'high' WHEN n <= 2 THEN 'medium' ELSE 'low' END AS confidence FROM q""",
)
def understanding(spark, sf_dir):
    files = _context_files(spark, sf_dir)
    documents = context.documentation(files.where("path LIKE '%.md'"))
    found = context.understanding(files, context.stack_signals(files), documents, context.criteria(files))
    return found.select("repo", F.size("open_questions").alias("questions"), "confidence")


@query(
    "documentation_summary",
    f"""WITH {CONTEXT_SQL},
d AS (SELECT repo, CASE i WHEN 5 THEN 'readme' WHEN 6 THEN 'architecture' ELSE 'adr' END AS kind, CASE i WHEN 5 THEN 'README.md' WHEN 6 THEN 'ARCHITECTURE.md' ELSE 'docs/adr/0001-x.md' END AS path FROM firsts WHERE i IN (5, 6, 8)),
k AS (SELECT repo, kind, count(*) AS n, min(path) AS p FROM d GROUP BY 1, 2)
SELECT repo, sum(n) || ' documentation source' || CASE WHEN sum(n) > 1 THEN 's' ELSE '' END || ' found: ' || string_agg(n || ' ' || kind || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY p) || '.' AS summary FROM k GROUP BY repo""",
)
def documentation_summary(spark, sf_dir):
    files = _context_files(spark, sf_dir).where("path LIKE '%.md'")
    return context.documentation_summary(context.documentation(files)).select("repo", "summary")
