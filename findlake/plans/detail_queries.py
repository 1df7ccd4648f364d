"""Predicates, single functions and smaller operators over the shared tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from findlake.functions import text as T
from findlake.functions.paths import is_secret_file
from findlake.operators import accept, context, coverage, envdocs, lifecycle, policy, quality, rules, semantic, surface
from findlake.plans.fact_queries import CONTEXT_SQL, _context_files
from findlake.plans.pipeline_queries import _n, _report_rows
from findlake.plans.registry import query
from findlake.plans.tables import FINDINGS_SQL, LINES_SQL, findings, lines, table, texts
from findlake.schemas import affected_files
from findlake.sinks import reports
from findlake.sources import analyzers


@query(
    "biome_ingest",
    """SELECT CAST(user_id % 10 AS VARCHAR) AS repo, r AS rule_id, CASE WHEN event_id % 3 = 0 THEN 'medium' WHEN event_id % 3 = 1 THEN 'informational' ELSE 'low' END AS severity,
  CASE event_type WHEN 'click' THEN 'security' WHEN 'view' THEN 'reliability' WHEN 'error' THEN 'performance' WHEN 'signup' THEN 'accessibility' ELSE 'maintainability' END AS category, 'src/u' || user_id || '.ts' AS file,
  CASE WHEN starts_with(r, 'lint/') THEN 'https://biomejs.dev/linter/rules/no-' || split_part(r, '/no', 2)[1:1].lower() || split_part(r, '/no', 2)[2:] END AS url
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'lint/security/noEval' WHEN 'view' THEN 'lint/suspicious/noVoid' WHEN 'error' THEN 'lint/performance/noDelete' WHEN 'signup' THEN 'lint/a11y/noKey' ELSE 'format' END AS r FROM events)""",
)
def biome_ingest(spark, sf_dir):
    kind = F.col("event_type")
    rule = F.when(kind == "click", "lint/security/noEval").when(kind == "view", "lint/suspicious/noVoid").when(kind == "error", "lint/performance/noDelete").when(kind == "signup", "lint/a11y/noKey").otherwise("format")
    level = F.when(F.col("event_id") % 3 == 0, "error").when(F.col("event_id") % 3 == 1, "information").otherwise("warning")
    file = F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".ts"))
    place = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), file, F.lit('"'))).otherwise(F.concat(F.lit('{"file":"/repo/'), file, F.lit('"}')))
    content = F.concat(F.lit('{"diagnostics":[{"severity":"'), level, F.lit('","message":"m","category":"'), rule, F.lit('","location":{"path":'), place, F.lit(',"start":{"line":'), _n(), F.lit(',"column":1}}}]}'))
    return analyzers.read_biome(_report_rows(spark, sf_dir, "biome", content)).select("repo", "rule_id", "severity", "category", "file", "url")


KINDS = [
    (".env.local", "dotenv", None, True), ("build.rs", "build-script", "rust", False), ("Dockerfile", "dockerfile", None, False), ("README", "markdown", None, False), ("guide.mdx", "markdown", None, False),
    ("docker-compose.yml", "config", None, False), ("ci.yaml", None, None, False), ("a.ts", None, "typescript", False), ("b.jsx", None, "jsx", False), ("c.kts", None, "kotlin", False), ("key.pem", None, None, True),
    ("id_rsa.pub", None, None, True), ("package.json", "config", None, False), ("x.cxx", None, "cpp", False), ("config.env", "dotenv", None, True), ("rules.mk", "config", None, False),
]


@query(
    "file_kinds",
    "WITH t(i, name, kind, lang, secret) AS (VALUES "
    + ", ".join(f"({i}, '{n}', {'NULL' if k is None else repr(k)}, {'NULL' if g is None else repr(g)}, {str(s).lower()})" for i, (n, k, g, s) in enumerate(KINDS))
    + ") SELECT l_orderkey, l_linenumber, l_partkey, 'd' || l_suppkey || '/' || name AS path, kind AS doc_kind, lang AS language, secret FROM lineitem JOIN t ON i = l_partkey % 16",
)
def file_kinds(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), (F.col("l_partkey") % 16 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("d"), "l_suppkey", F.lit("/"), name).alias("path"))
    path = F.col("path")
    return rows.select("*", envdocs.doc_kind(path).alias("doc_kind"), rules.language_of(path).alias("language"), is_secret_file(path).alias("secret"))


@query(
    "text_helpers",
    r"""WITH t AS (SELECT conv_id, turn, text FROM conversations)
SELECT conv_id, turn, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug, sha256(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS topic_hash,
  left(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), 60) AS clipped, substr(sha256(regexp_replace(text, '\s', '', 'g')), 1, 8) AS squashed,
  regexp_replace(regexp_extract(text, '^[^.\n]*'), '^\s+|\s+$', '', 'g') AS title FROM t""",
)
def text_helpers(spark, sf_dir):
    text = F.col("text")
    return texts(spark, sf_dir, "conversations", "conv_id", "turn").select(
        "conv_id", "turn", T.slug(text, 40).alias("slug"), F.sha2(T.slug(text), 256).alias("topic_hash"), T.clip(text, 60).alias("clipped"), F.substring(F.sha2(T.squash(text), 256), 1, 8).alias("squashed"), T.first_sentence(text).alias("title")
    )


@query(
    "json_report",
    f"""WITH {FINDINGS_SQL} SELECT repo, ord, '{{"file":"' || file || '",' || CASE WHEN rule_id IS NULL THEN '' ELSE '"rule_id":"' || rule_id || '",' END || '"severity":"' || severity || '","line":' || line || '}}' AS text FROM findings""",
)
def json_report(spark, sf_dir):
    return reports.json_report(findings(spark, sf_dir).select("repo", "ord", "file", "rule_id", "severity", "line")).select("repo", "ord", "text")


@query(
    "config_ignores",
    """WITH p AS (SELECT p_partkey, replace(p_name, ' ', '/') || '/k' || p_partkey || '.gen.ts' AS file FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, replace(p_name, ' ', '/') || '/k' || p_partkey || '.ts' FROM part WHERE p_size % 2 = 1)
SELECT p_partkey, file FROM p WHERE NOT starts_with(file, 'red/') AND NOT (starts_with(file, 'blue/') AND file LIKE '%.gen.ts') AND file NOT LIKE '%/bolt/k1%.ts'""",
)
def config_ignores(spark, sf_dir):
    leaf = F.when(F.col("p_size") % 2 == 0, ".gen.ts").otherwise(".ts")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit("/k"), "p_partkey", leaf).alias("file"))
    return accept.leave_out_ignored(rows, ["red", "blue/**/*.gen.ts", "**/bolt/k1*.ts"])


@query(
    "dependency_profile",
    f"""WITH {CONTEXT_SQL}
SELECT repo, 'lockfile' AS kind, 'bun.lock' AS name, 'present' AS value FROM firsts WHERE i = 4
UNION ALL SELECT repo, 'version', 'react', '^18' FROM firsts WHERE i = 1 AND k % 5 < 2 UNION ALL SELECT repo, 'runtime', 'node', '>=18' FROM firsts WHERE i = 1 AND k % 5 < 2""",
)
def dependency_profile(spark, sf_dir):
    return context.dependency_profile(_context_files(spark, sf_dir)).select("repo", "kind", "name", "value")


@query(
    "capability_summary",
    f"""WITH {CONTEXT_SQL}, v AS (SELECT DISTINCT repo, CASE WHEN kind IN ('build', 'manager', 'runtime') THEN 3 WHEN kind = 'framework' THEN 1 ELSE 0 END AS r, value FROM signals WHERE kind <> 'workspace'),
k AS (SELECT repo, r, string_agg(value, ', ' ORDER BY value) AS names FROM v GROUP BY 1, 2)
SELECT repo, string_agg(CASE r WHEN 0 THEN 'Language: ' WHEN 1 THEN 'Framework: ' ELSE 'Tooling: ' END || names, ' — ' ORDER BY r) AS summary FROM k GROUP BY 1""",
)
def capability_summary(spark, sf_dir):
    signals = context.stack_signals(_context_files(spark, sf_dir)).where("kind <> 'workspace'")
    kind = F.when(F.col("kind").isin("build", "manager", "runtime"), "tooling").otherwise(F.col("kind"))
    return context.capability_summary(signals.select("repo", kind.alias("kind"), F.col("value").alias("id")))


@query(
    "pass_counters",
    """SELECT CAST(user_id % 10 AS VARCHAR) AS repo, count(*) FILTER (event_type IN ('click', 'view', 'signup')) AS verified, count(*) FILTER (event_type = 'click') AS confirmed, count(*) FILTER (event_type = 'view') AS doubtful,
  count(*) FILTER (event_type = 'signup') AS unsure, count(*) FILTER (value >= 100) AS detected, count(*) FILTER (value >= 50 AND value < 100) AS rejected, count(*) FILTER (event_type NOT IN ('click', 'view', 'signup')) + count(*) FILTER (value < 50) AS failed
FROM events GROUP BY 1""",
)
def pass_counters(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    rows = table(spark, sf_dir, "events").withColumn("repo", (F.col("user_id") % 10).cast("string"))
    verdict = F.when(kind == "click", "confirmed").when(kind == "view", "doubtful").when(kind == "signup", "unsure")
    status = F.when(value >= 100, "detected").when(value >= 50, "rejected").otherwise("failed")
    return quality.pass_counters(rows.select("repo", verdict.alias("verdict")), rows.select("repo", status.alias("status")))


@query(
    "failure_cutoff",
    """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS repo, event_id AS ord, event_type IN ('click', 'view') AS failed, row_number() OVER w AS n,
  (event_type IN ('click', 'view')) AND lag(event_type IN ('click', 'view'), 1, false) OVER w AND lag(event_type IN ('click', 'view'), 2, false) OVER w AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT repo, min(n) AS stop FROM a WHERE third GROUP BY 1)
SELECT a.repo, ord, failed FROM a LEFT JOIN s ON s.repo = a.repo WHERE stop IS NULL OR n <= stop""",
)
def failure_cutoff(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repo"), F.col("event_id").alias("ord"), F.col("event_type").isin("click", "view").alias("failed"))
    return semantic.before_failures(attempts, 3)


@query(
    "unbound_languages",
    """WITH langs AS (SELECT DISTINCT source AS repo, lang AS language FROM documents), rules(rule_id, concept) AS (VALUES ('no-eval', 'eval'), ('no-panic', 'panic')),
b(concept, language) AS (VALUES ('eval', 'en'), ('eval', 'fr'), ('panic', 'de'))
SELECT l.repo, r.rule_id, string_agg(l.language, ',' ORDER BY l.language) AS languages FROM langs l, rules r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.concept = r.concept AND b.language = l.language) GROUP BY 1, 2""",
)
def unbound_languages(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("language")).distinct()
    pairs = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(c).alias("concept")) for r, c in (("no-eval", "eval"), ("no-panic", "panic"))])
    wanted = langs.select("repo").distinct().select("repo", F.explode(pairs).alias("p")).select("repo", "p.*")
    bindings = spark.createDataFrame([("eval", "en"), ("eval", "fr"), ("panic", "de")], "concept string, language string")
    return coverage.languages_without_binding(wanted, bindings, langs).select("repo", "rule_id", F.array_join("languages", ",").alias("languages"))


@query(
    "pack_faults",
    """WITH r AS (SELECT p_brand AS pack, CAST(p_size AS VARCHAR) || '.0' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.0' END AS version, p_name AS rule_id, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS knowledge_id FROM part),
k AS (SELECT DISTINCT p_brand AS pack, CAST(p_size AS VARCHAR) || '.0' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.0' END AS version, p_type AS knowledge_id FROM part WHERE p_partkey % 4 <> 0)
SELECT pack, version, rule_id AS subject, 'duplicate-rule' AS fault FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1
UNION ALL SELECT DISTINCT pack, version, knowledge_id, 'missing-knowledge' FROM r WHERE knowledge_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.pack = r.pack AND k.version = r.version AND k.knowledge_id = r.knowledge_id)
UNION ALL SELECT DISTINCT pack, version, version, 'bad-version' FROM r WHERE NOT regexp_matches(version, '^[0-9]+\\.[0-9]+\\.[0-9]+')""",
)
def pack_faults(spark, sf_dir):
    version = F.concat(F.col("p_size").cast("string"), F.lit(".0"), F.when(F.col("p_size") % 3 == 0, "").otherwise(".0"))
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("pack"), version.alias("version"), F.col("p_name").alias("rule_id"), "p_type", "p_partkey")
    cited = part.withColumn("knowledge_id", F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")))
    known = part.where("p_partkey % 4 <> 0").select("pack", "version", F.col("p_type").alias("knowledge_id"))
    return policy.validate_packs(cited, part.select("pack", "version").distinct(), known).select("pack", "version", "subject", "fault")


@query(
    "affected_files",
    """SELECT event_id AS ord, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id || ',u' || (user_id + 1) ELSE 'u' || user_id END AS files FROM events""",
)
def affected_files_query(spark, sf_dir):
    user = F.concat(F.lit("u"), "user_id")
    other = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id") + 1)).otherwise(user)
    place = lambda f: F.struct(f.alias("file"))
    rows = table(spark, sf_dir, "events").select(F.lit("r").alias("repo"), F.col("event_id").alias("id"), F.col("event_id").alias("ord"), F.array(place(user), place(other), place(user)).alias("locations"))
    return affected_files(rows).select("ord", F.array_join("files", ",").alias("files"))


@query(
    "analyzer_inventory",
    f"""WITH {CONTEXT_SQL},
repos AS (SELECT DISTINCT repo FROM firsts), tools(tool, need) AS (VALUES ('gitleaks', -1), ('osv-scanner', 4), ('biome', 99), ('eslint', 99), ('ruff', 99), ('clippy', 0), ('phpstan', 99), ('ktlint', 99), ('detekt', 99)),
t AS (SELECT r.repo, CAST(r.repo AS BIGINT) AS c, tool, need = -1 OR EXISTS (SELECT 1 FROM firsts f WHERE f.repo = r.repo AND f.i = need) AS applies FROM repos r, tools),
x AS (SELECT *, tool IN ('gitleaks', 'clippy', 'osv-scanner') AND c % 3 <> 0 AS installed FROM t)
SELECT repo, tool, applies, installed, CASE WHEN c % 50 = 0 THEN 'analyzers are turned off' WHEN c % 7 = 0 AND tool = 'gitleaks' THEN 'disabled in the repository''s configuration' WHEN NOT applies THEN 'this repository has nothing it analyzes'
  WHEN NOT installed THEN 'not installed' WHEN tool = 'clippy' AND c % 2 = 0 THEN 'it runs code the repository controls; enable "clippy" explicitly' WHEN tool = 'osv-scanner' THEN 'it sends package names and versions to a service; enable "osv-scanner" explicitly' END AS reason FROM x""",
)
def analyzer_inventory(spark, sf_dir):
    files = _context_files(spark, sf_dir).select("repo", "path")
    key = F.col("repo").cast("long")
    repos = files.select("repo").distinct()
    have = repos.where(key % 3 != 0).select("repo", F.explode(F.array(F.lit("gitleaks"), F.lit("clippy"), F.lit("osv-scanner"))).alias("tool"), F.lit("1").alias("version"))
    none = F.array().cast("array<string>")
    options = repos.select("repo", F.when(key % 50 == 0, "off").otherwise("auto").alias("mode"), F.when(key % 7 == 0, F.array(F.lit("gitleaks"))).otherwise(none).alias("disable"), F.when(key % 2 == 1, F.array(F.lit("clippy"))).otherwise(none).alias("enable"))
    return analyzers.inventory(files, have, options).select("repo", "tool", "applies", "installed", "reason")


@query(
    "excerpt_lookup",
    f"""WITH {LINES_SQL},
f AS (SELECT source AS repo, source || '/' || doc_id AS file, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 + doc_id % 3 END AS line, doc_id % 7 = 0 AS hidden, doc_id FROM documents)
SELECT f.doc_id, CASE WHEN hidden THEN NULL WHEN f.line IS NULL THEN 'message ' || f.doc_id ELSE substr(regexp_replace(l.text, '^\\s+|\\s+$', '', 'g'), 1, 200) END AS excerpt
FROM f LEFT JOIN lines l ON l.path = f.file AND l.line = f.line""",
)
def excerpt_lookup(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), F.when(F.col("doc_id") % 5 != 0, 1 + F.col("doc_id") % 3).cast("int").alias("line"), (F.col("doc_id") % 7 == 0).alias("sensitive"),
        F.concat(F.lit("message "), "doc_id").alias("message"), F.lit("tool").alias("tool"), F.col("doc_id").cast("string").alias("rule_id"), F.lit("c").alias("category"), F.lit("low").alias("severity"),
    )
    placed = analyzers.to_findings(found, lines(spark, sf_dir).withColumnRenamed("path", "file"))
    return placed.select(F.col("tool_rule").cast("long").alias("doc_id"), "excerpt")


@query(
    "concept_hits",
    """WITH c AS (SELECT l_orderkey AS start, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 7 WHEN 0 THEN 'dynamic-eval' WHEN 1 THEN 'shell-sink' WHEN 2 THEN 'data-query' WHEN 3 THEN 'http-no-timeout' WHEN 4 THEN 'unsafe-deserialization' WHEN 5 THEN 'weak-random' ELSE 'http-client' END AS concept,
  CASE WHEN l_suppkey % 2 = 0 THEN 'python' ELSE 'javascript' END AS lang, l_discount >= 0.05 AS built, l_tax >= 0.04 AS exposes, CAST(l_quantity AS INTEGER) % 4 AS options, l_returnflag = 'A' AS timed, CAST(l_quantity AS INTEGER) % 3 AS cert FROM lineitem),
b(concept, rule_id, w, conf, sev, js) AS (VALUES ('dynamic-eval', 'no-eval', 'always', 'high', NULL, false), ('shell-sink', 'no-shell-interpolation', 'built', 'medium', NULL, false), ('shell-sink', 'a03-injection', 'input', 'high', NULL, false), ('data-query', 'n-plus-one-queries', 'never', 'low', 'medium', true),
  ('http-no-timeout', 'no-http-without-timeout', 'keyword', 'high', NULL, false), ('unsafe-deserialization', 'no-unsafe-deserialization', 'options', 'medium', NULL, false), ('weak-random', 'no-weak-random', 'always', 'low', 'medium', true), ('http-client', 'a10-ssrf', 'input', 'high', NULL, true)),
h AS (SELECT l_suppkey, start, rule_id, CASE WHEN w = 'input' AND cert = 1 THEN 'low' ELSE conf END AS confidence, CASE WHEN w = 'input' AND cert = 1 THEN 'medium' ELSE sev END AS severity FROM c JOIN b ON b.concept = c.concept AND (js OR lang = 'python')
  WHERE CASE w WHEN 'always' THEN true WHEN 'built' THEN built AND exposes WHEN 'keyword' THEN NOT timed WHEN 'options' THEN options <= 1 WHEN 'input' THEN cert >= 1 ELSE false END)
SELECT 'f' || l_suppkey AS file, rule_id, start, min(confidence) AS confidence, count(DISTINCT confidence) > 1 AS mixed FROM h GROUP BY 1, 2, 3 HAVING NOT mixed""",
)
def concept_hits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    names = ["dynamic-eval", "shell-sink", "data-query", "http-no-timeout", "unsafe-deserialization", "weak-random", "http-client"]
    amount = F.round("l_quantity").cast("int")
    called = li.select(
        F.lit("r").alias("repo"), F.concat(F.lit("f"), "l_suppkey").alias("file"), F.when(F.col("l_suppkey") % 2 == 0, "python").otherwise("javascript").alias("language"),
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("call_id"), F.col("l_orderkey").alias("line"), F.col("l_orderkey").alias("start"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("l_partkey") % 7 + 1).cast("int")).alias("concept"), F.lit(0).alias("argument"),
        (F.col("l_discount") >= 0.05).alias("built"), (F.col("l_tax") >= 0.04).alias("exposes"), (amount % 4).alias("options"), F.when(F.col("l_returnflag") == "A", "url, timeout=1").otherwise("url").alias("argument_text"), (amount % 3).alias("cert"),
    )
    flow = called.select("repo", "file", "call_id", "argument", F.col("cert").alias("certainty")).distinct()
    wide = rules.concept_hits(called.drop("cert").withColumn("line", F.xxhash64("call_id", "concept")), None, flow)
    grouped = wide.groupBy("file", "rule_id", "start").agg(F.min("confidence").alias("confidence"), F.count_distinct("confidence").alias("n"))
    return grouped.where("n = 1").select("file", "rule_id", "start", "confidence", F.lit(False).alias("mixed"))


@query(
    "built_findings",
    f"""WITH {FINDINGS_SQL}
SELECT ord AS line, repo, file, rule_id, CASE WHEN value_hit THEN 'low' WHEN rule_id = 'click' THEN 'high' ELSE 'medium' END AS severity, CASE rule_id WHEN 'click' THEN 'Never click' ELSE 'Avoid ' || rule_id END AS title,
  CASE rule_id WHEN 'click' THEN 'costs' ELSE 'Rule "' || rule_id || '": Avoid ' || rule_id || '. Really' END AS explanation FROM (SELECT *, severity = 'critical' AS value_hit FROM findings) WHERE rule_id IS NOT NULL""",
)
def built_findings(spark, sf_dir):
    rows = findings(spark, sf_dir).where("rule_id IS NOT NULL")
    hits = rows.select("repo", "file", F.col("ord").alias("line"), "rule_id", F.lit("high").alias("confidence"), F.when(F.col("severity") == "critical", "low").alias("severity"))
    statement = F.when(F.col("rule_id") == "click", "Never click. It costs").otherwise(F.concat(F.lit("Avoid "), "rule_id", F.lit(". Really")))
    null = F.lit(None).cast("string")
    listed = rows.select("repo", "rule_id").distinct().select("repo", "rule_id", statement.alias("statement"), null.alias("category"), F.when(F.col("rule_id") == "click", "high").alias("severity"), F.lit("p").alias("pack"), F.lit("1.0.0").alias("version"))
    guidance = spark.createDataFrame([("click", "costs", "stop", "a", "b")], "rule_id string, why string, fix string, before string, after string")
    return rules.build_findings(hits, listed, guidance).select("line", "repo", "file", "rule_id", "severity", "title", "explanation")


@query(
    "checked_rules",
    f"""WITH {FINDINGS_SQL} SELECT repo, 'p' || length(rule_id) AS pack, '1.0.0' AS version, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM findings WHERE rule_id IN ('click', 'error', 'purchase') GROUP BY 1, 2, 3""",
)
def checked_rules(spark, sf_dir):
    rows = findings(spark, sf_dir).where("rule_id IS NOT NULL")
    listed = rows.select("repo", "rule_id", F.concat(F.lit("p"), F.length("rule_id")).alias("pack"), F.lit("1.0.0").alias("version")).distinct()
    registry = spark.createDataFrame([("click",), ("error",), ("purchase",)], "rule_id string")
    return coverage.checked_rules(listed, registry).select("repo", "pack", "version", F.array_join("rules", ",").alias("rules"))


@query(
    "review_complete",
    f"""WITH {FINDINGS_SQL} SELECT file AS repo, NOT bool_or(severity = 'critical' OR (category = 'error' AND severity = 'high')) AS complete FROM findings GROUP BY 1""",
)
def review_complete(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumn("repo", F.col("file"))
    runs = rows.where("category = 'error' AND severity = 'high'").select("repo", F.lit("failed").alias("status"))
    return coverage.complete(rows.where("severity = 'critical'"), rows.limit(0), runs, rows).select("repo", "complete")


@query("mention_files", "SELECT l_partkey AS name, count(DISTINCT l_suppkey) AS files FROM lineitem GROUP BY 1")
def mention_files(spark, sf_dir):
    mentions = table(spark, sf_dir, "lineitem").select(F.lit("r").alias("repo"), F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("file"))
    return surface.mention_files(mentions).select("name", "files")


@query(
    "applicable_rules",
    f"""WITH {CONTEXT_SQL}
SELECT DISTINCT repo, 'r-always' AS rule_id FROM firsts UNION ALL SELECT DISTINCT repo, 'r-node' FROM signals WHERE value = 'Node.js' UNION ALL SELECT DISTINCT repo, 'r-rust' FROM signals WHERE value = 'Rust' UNION ALL SELECT DISTINCT repo, 'r-glob' FROM firsts""",
)
def applicable_rules(spark, sf_dir):
    files = _context_files(spark, sf_dir)
    listed = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("scope"), F.lit(w).cast("string").alias("wanted")) for r, s, w in (("r-always", "always", None), ("r-node", "framework", "nodejs"), ("r-rust", "language", "RUST"), ("r-glob", "glob", "*.ts"))])
    wanted = files.select("repo").distinct().select("repo", F.explode(listed).alias("r")).select("repo", "r.*")
    have = context.stack_signals(files).select("repo", F.col("value").alias("capability"))
    return policy.applicable_rules(wanted, have).select("repo", "rule_id")


@query(
    "requested_packs",
    """WITH e AS (SELECT c_nationkey AS repo, c_mktsegment || c_custkey % 40 AS pack, min(c_custkey) AS o FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2), g AS (SELECT c_nationkey AS repo, c_mktsegment || c_custkey % 40 AS pack, min(c_custkey) AS o FROM customer GROUP BY 1, 2),
u AS (SELECT repo, pack, 0 AS s, o FROM e UNION ALL SELECT repo, pack, 1, o FROM g), f AS (SELECT repo, pack, min((s, o)) AS k FROM u GROUP BY 1, 2)
SELECT repo, pack, CAST(row_number() OVER (PARTITION BY repo ORDER BY k) AS INTEGER) AS place FROM f""",
)
def requested_packs(spark, sf_dir):
    pack = F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repo"), pack.alias("pack"), F.col("c_custkey").alias("ord"), "c_acctbal")
    found = policy.requested_packs(rows.where("c_acctbal > 5000"), rows)
    return found.select("repo", "pack", F.row_number().over(Window.partitionBy("repo").orderBy("order")).alias("place"))


def _walk_sql(start, states, pairs):
    legal = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    named = ", ".join(f"({i}, '{s}')" for i, s in enumerate(states))
    return f"""WITH RECURSIVE n(i, s) AS (VALUES {named}), legal(a, b) AS (VALUES {legal}),
e AS (SELECT c_nationkey AS key, c_custkey AS ord, s AS state, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer JOIN n ON i = CAST(floor(abs(c_acctbal)) AS BIGINT) % {len(states)}),
w AS (SELECT key, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS ord, '{start}' AS status, false AS accepted FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT e.key, e.k, e.ord, CASE WHEN l.a IS NOT NULL THEN e.state ELSE w.status END, l.a IS NOT NULL FROM w JOIN e ON e.key = w.key AND e.k = w.k + 1 LEFT JOIN legal l ON l.a = w.status AND l.b = e.state)
SELECT key, ord, status AS state_after, accepted FROM w WHERE k > 0"""


def _walk(spark, sf_dir, machine):
    states, _ = machine
    place = (F.floor(F.abs("c_acctbal")).cast("long") % len(states) + 1).cast("int")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("ord"), F.element_at(F.array(*[F.lit(s) for s in states]), place).alias("state"))
    return lifecycle.fold(rows, ["key"], "ord", "state", machine).select("key", "ord", "state_after", "accepted")


def _pairs(machine):
    return [(a, b) for a, targets in machine[1].items() for b in targets]


@query("memory_lifecycle", _walk_sql("detected", lifecycle.MEMORY[0], _pairs(lifecycle.MEMORY)))
def memory_lifecycle(spark, sf_dir):
    return _walk(spark, sf_dir, lifecycle.MEMORY)


@query("session_lifecycle", _walk_sql("requested", lifecycle.SESSION[0], _pairs(lifecycle.SESSION)))
def session_lifecycle(spark, sf_dir):
    return _walk(spark, sf_dir, lifecycle.SESSION)


@query(
    "model_candidates",
    f"""WITH {FINDINGS_SQL}, r(s, n) AS (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('informational', 4)),
c AS (SELECT f.*, row_number() OVER (PARTITION BY repo ORDER BY n, ord) AS position FROM findings f JOIN r ON s = severity WHERE category <> 'purchase' AND coalesce(rule_id, '') <> 'error')
SELECT repo, ord, CAST(position AS INTEGER) AS position FROM c""",
)
def model_candidates(spark, sf_dir):
    confidence = F.when(F.col("category") == "purchase", "high").otherwise("low")
    evidence = F.array(F.struct(F.when(F.col("rule_id") == "error", "external-analyzer").otherwise("code").alias("kind")))
    rows = findings(spark, sf_dir).withColumn("confidence", confidence).withColumn("evidence", evidence)
    return semantic.candidates(semantic.is_candidate(rows)).select("repo", "ord", "position")
