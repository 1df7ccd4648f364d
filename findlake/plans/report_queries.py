"""Ingest and report queries: diffs, analyzer reports, report rows."""

from pyspark.sql import functions as F

from findlake.functions.paths import is_ignored_path, is_test_path
from findlake.plans.registry import query
from findlake.plans.tables import FINDINGS_SQL, LINES_SQL, files, findings, reviewed, table, texts
from findlake.sinks import reports
from findlake.sources import analyzers, diff


def _diffs(spark, sf_dir):
    """Each document as one hunk: context, added, removed, added, and so on."""
    kind = lambda i: F.element_at(F.array(F.lit(" "), F.lit("+"), F.lit("-"), F.lit("+")), (i % 4 + 1).cast("int"))
    parts = F.split("content", "\n")
    body = F.transform(parts, lambda line, i: F.concat(kind(i), line))
    n = F.size(parts)
    context, minus = F.floor((n + 3) / 4), F.floor((n + 1) / 4)
    plus = n - context - minus
    before = F.when(F.col("doc_id") % 10 == 0, "/dev/null").otherwise(F.concat(F.lit("a/"), "path"))
    header = F.concat(F.lit("--- "), before, F.lit("\n+++ b/"), "path", F.lit("\n@@ -1,"), (context + minus).cast("string"), F.lit(" +1,"), (context + plus).cast("string"), F.lit(" @@\n"))
    return files(spark, sf_dir).select("doc_id", F.concat(header, F.array_join(body, "\n")).alias("diff"))


@query(
    "diff_lines",
    f"""WITH {LINES_SQL}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) AS INTEGER) AS line, regexp_replace(text, '\\r$', '') AS text, mark
FROM (SELECT doc_id, line, text, CASE (line - 1) % 4 WHEN 0 THEN ' ' WHEN 2 THEN '-' ELSE '+' END AS mark FROM lines)
WHERE mark <> '-' QUALIFY mark = '+'""",
)
def diff_lines(spark, sf_dir):
    return diff.parse(_diffs(spark, sf_dir), ["doc_id"]).added.select("doc_id", "line", "text", F.lit("+").alias("mark"))


@query(
    "diff_files",
    f"""WITH {LINES_SQL}
SELECT doc_id, any_value(path) AS path, CASE WHEN doc_id % 10 = 0 THEN 'added' ELSE 'modified' END AS kind,
       count(*) FILTER ((line - 1) % 4 IN (1, 3)) AS added_lines, count(*) FILTER ((line - 1) % 4 = 2) AS removed_lines
FROM lines GROUP BY doc_id""",
)
def diff_files(spark, sf_dir):
    return diff.parse(_diffs(spark, sf_dir), ["doc_id"]).files.select("doc_id", "path", "kind", "added_lines", "removed_lines")


@query(
    "diff_hot",
    f"""WITH {LINES_SQL}
SELECT CASE WHEN doc_id % 10 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'all' END AS diff, path,
       CASE WHEN doc_id % 10 = 0 THEN 'added' ELSE 'modified' END AS kind,
       count(*) FILTER ((line - 1) % 4 IN (1, 3)) AS added_lines, count(*) FILTER ((line - 1) % 4 = 2) AS removed_lines
FROM lines GROUP BY 1, 2, 3""",
)
def diff_hot(spark, sf_dir):
    """Nine of ten documents are sections of one diff, which many tasks read."""
    name = F.when(F.col("doc_id") % 10 == 0, F.col("doc_id").cast("string")).otherwise("all")
    rows = _diffs(spark, sf_dir).select(name.alias("key"), "doc_id", F.posexplode(F.split("diff", "\n")).alias("at", "raw"))
    lines = rows.select("key", (F.shiftleft(F.col("doc_id").cast("bigint"), 32) + F.col("at")).alias("pos"), "raw")
    found = diff.parse_lines(lines, ["key"], width=1 << 40).files
    return found.select(F.col("key").alias("diff"), "path", "kind", "added_lines", "removed_lines")


def _sarif_text():
    rule, n = F.col("event_type"), F.col("event_id")
    score = F.when(n % 3 == 0, F.concat(F.lit(',"properties":{"security-severity":"'), (n % 11).cast("string"), F.lit('.5"}'))).otherwise("")
    user = F.col("user_id").cast("string")
    uri = (
        F.when(n % 5 == 0, F.concat(F.lit("file:///repo/src/a%20b/u"), user, F.lit(".ts")))
        .when(n % 5 == 1, F.concat(F.lit("src/./u"), user, F.lit(".ts")))
        .when(n % 5 == 2, F.concat(F.lit("../out/u"), user, F.lit(".ts")))
        .when(n % 5 == 3, F.concat(F.lit("/repo/u"), user, F.lit(".ts")))
        .otherwise(F.concat(F.lit("node_modules/x/u"), user, F.lit(".ts")))
    )
    level = F.element_at(F.array(*[F.lit(x) for x in ("error", "warning", "note", "none")]), (n % 4 + 1).cast("int"))
    noise = F.when(n % 2 == 0, "scanning\n").otherwise("")
    return F.concat(
        noise, F.lit('{"runs":[{"tool":{"driver":{"rules":[{"id":"other"},{"id":"'), rule, F.lit('","helpUri":"https://example.org/'), rule, F.lit('"'), score,
        F.lit('}]}},"results":[{"ruleId":"'), rule, F.lit('","level":"'), level, F.lit('","message":{"text":"m'), n.cast("string"),
        F.lit('"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"'), uri, F.lit('"},"region":{"startLine":'), (n % 500 + 1).cast("string"), F.lit("}}}]}]}]}"),
    )


@query(
    "sarif_ingest",
    """SELECT CAST(user_id % 10 AS VARCHAR) AS repo, event_type AS rule_id, 'm' || event_id AS message,
  CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 11 + 0.5 >= 9 THEN 'critical' WHEN event_id % 11 + 0.5 >= 7 THEN 'high' WHEN event_id % 11 + 0.5 >= 4 THEN 'medium' ELSE 'low' END
       WHEN event_id % 4 = 0 THEN 'medium' WHEN event_id % 4 = 1 THEN 'low' ELSE 'informational' END AS severity,
  CASE event_id % 5 WHEN 0 THEN 'src/a b/u' || user_id || '.ts' WHEN 1 THEN 'src/u' || user_id || '.ts' ELSE 'u' || user_id || '.ts' END AS file,
  CAST(event_id % 500 + 1 AS INTEGER) AS line, 'https://example.org/' || event_type AS url
FROM events WHERE event_id % 5 IN (0, 1, 3)""",
)
def sarif_ingest(spark, sf_dir):
    reports_in = texts(spark, sf_dir, "events", "event_id").select(
        (F.col("user_id") % 10).cast("string").alias("repo"), F.lit("scanner").alias("tool"), F.lit("/repo").alias("root"), _sarif_text().alias("content")
    )
    found = analyzers.read_sarif(reports_in).where(~is_ignored_path(F.col("file")))
    return found.select("repo", "rule_id", "message", "severity", "file", "line", "url")


@query(
    "ruff_ingest",
    """SELECT CAST(user_id % 10 AS VARCHAR) AS repo,
  CASE event_type WHEN 'click' THEN 'F401' WHEN 'view' THEN 'E501' WHEN 'error' THEN 'S105' WHEN 'signup' THEN 'E902' ELSE 'B008' END AS rule_id,
  CASE event_type WHEN 'view' THEN 'low' ELSE 'medium' END AS severity,
  CASE event_type WHEN 'view' THEN 'maintainability' WHEN 'error' THEN 'security' ELSE 'reliability' END AS category,
  'pkg/u' || user_id || '.py' AS file, CAST(event_id % 500 + 1 AS INTEGER) AS line FROM events""",
)
def ruff_ingest(spark, sf_dir):
    kind = F.col("event_type")
    code = F.when(kind == "click", "F401").when(kind == "view", "E501").when(kind == "error", "S105").when(kind == "signup", "E902").otherwise("B008")
    text = F.concat(
        F.lit('[{"code":"'), code, F.lit('","message":"m","filename":"/repo/pkg/u'), F.col("user_id").cast("string"), F.lit('.py","location":{"row":'), (F.col("event_id") % 500 + 1).cast("string"), F.lit(',"column":1}}]')
    )
    reports_in = texts(spark, sf_dir, "events", "event_id").select((F.col("user_id") % 10).cast("string").alias("repo"), F.lit("ruff").alias("tool"), F.lit("/repo").alias("root"), text.alias("content"))
    return analyzers.read_ruff(reports_in).select("repo", "rule_id", "severity", "category", "file", "line")


@query(
    "gitlab_report",
    f"""WITH {FINDINGS_SQL}
SELECT repo, ord, title AS description, coalesce(rule_id, category) AS check_name,
       substr(sha256(coalesce(rule_id, category) || chr(0) || file || chr(0) || line || chr(0) || title), 1, 32) AS fingerprint,
       CASE severity WHEN 'informational' THEN 'info' WHEN 'low' THEN 'minor' WHEN 'medium' THEN 'major' WHEN 'high' THEN 'critical' ELSE 'blocker' END AS severity, file AS path, line AS begin
FROM findings""",
)
def gitlab_report(spark, sf_dir):
    rows = reports.gitlab_rows(findings(spark, sf_dir))
    return rows.select("repo", "ord", "description", "check_name", "fingerprint", "severity", F.col("location.path").alias("path"), F.col("location.lines.begin").alias("begin"))


@query(
    "github_annotations",
    f"""WITH {FINDINGS_SQL}
SELECT repo, ord, '::' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'notice' END
  || ' file=' || file || ',line=' || line || ',endLine=' || line || ',title=' || title || ' (' || coalesce(rule_id, category) || ')::' || title AS text FROM findings""",
)
def github_annotations(spark, sf_dir):
    return reports.github_annotations(findings(spark, sf_dir)).select("repo", "ord", "text")


@query(
    "markdown_rows",
    f"""WITH {FINDINGS_SQL},
r(s, n) AS (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('informational', 4)),
ranked AS (SELECT f.*, r.n FROM findings f JOIN r ON r.s = severity),
counts AS (SELECT repo, count(*) AS total, array_to_string(list_filter([
  CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN count(*) FILTER (severity = 'critical') || ' critical' END,
  CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN count(*) FILTER (severity = 'high') || ' high' END,
  CASE WHEN count(*) FILTER (severity = 'medium') > 0 THEN count(*) FILTER (severity = 'medium') || ' medium' END,
  CASE WHEN count(*) FILTER (severity = 'low') > 0 THEN count(*) FILTER (severity = 'low') || ' low' END,
  CASE WHEN count(*) FILTER (severity = 'informational') > 0 THEN count(*) FILTER (severity = 'informational') || ' informational' END], lambda x: x IS NOT NULL), ', ') AS parts FROM findings GROUP BY 1)
SELECT repo, n + 1 AS section, ord, '| ' || severity || ' | `' || file || ':' || line || '` | ' || title || ' | ' || coalesce(rule_id, category) || ' |' AS text FROM ranked
UNION ALL SELECT repo, 0, 3, '**' || total || ' findings**: ' || parts FROM counts
UNION ALL SELECT repo, 0, i, t FROM counts, (VALUES (0, '<!-- findings-report -->'), (1, '## Review findings'), (2, ''), (4, ''), (5, '| Severity | Where | Finding | Rule |'), (6, '| --- | --- | --- | --- |')) AS h(i, t)""",
)
def markdown_rows(spark, sf_dir):
    return reports.markdown_report(findings(spark, sf_dir)).select("repo", "section", "ord", "text")


@query(
    "sarif_rules",
    f"""WITH {FINDINGS_SQL}
SELECT repo, coalesce(rule_id, category) AS rule, min(ord) AS ord, arg_min(title, ord) AS title FROM findings GROUP BY 1, 2""",
)
def sarif_rules(spark, sf_dir):
    return reports.sarif_rules(findings(spark, sf_dir)).select("repo", "rule", "ord", "title")


@query(
    "sarif_report_lines",
    f"""WITH {FINDINGS_SQL},
named AS (SELECT DISTINCT repo FROM findings UNION ALL SELECT 'clean-' || n_nationkey FROM nation),
rules AS (SELECT repo, coalesce(rule_id, category) AS rule, min(ord) AS ord, arg_min(title, ord) AS title, arg_min(CASE WHEN ord % 3 = 0 THEN 'fix ' || ord END, ord) FILTER (ord % 3 = 0) AS help FROM findings GROUP BY 1, 2),
a AS (SELECT repo, ord, min(ord) OVER (PARTITION BY repo) AS f, '{{"id":"' || rule || '","name":"' || rule || '","shortDescription":{{"text":"' || title || '"}}' || coalesce(',"help":{{"text":"' || help || '"}}', '') || ',"properties":{{"precision":"' || CASE WHEN rule = 'view' THEN 'low' ELSE 'high' END || '"}}}}' AS t FROM rules),
b AS (SELECT repo, ord, min(ord) OVER (PARTITION BY repo) AS f, '{{"ruleId":"' || coalesce(rule_id, category) || '","level":"' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END
  || '","message":{{"text":"' || title || '."}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '","uriBaseId":"%SRCROOT%"}},"region":{{"startLine":' || line || ',"endLine":' || line || '}}}}}}],"properties":{{"severity":"' || severity || '","category":"' || category || '"}}}}' AS t FROM findings)
SELECT repo, 1 AS section, ord, CASE WHEN ord = f THEN t ELSE ',' || t END AS text FROM a
UNION ALL SELECT repo, 4, ord, CASE WHEN ord = f THEN t ELSE ',' || t END FROM b
UNION ALL SELECT repo, 0, 0, '{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"findlake","version":"1.0.0","rules":[' FROM named
UNION ALL SELECT repo, 2, 0, ']}}}},"results":[' FROM named
UNION ALL SELECT repo, 3, 0, '' FROM named UNION ALL SELECT repo, 5, 0, ']}}]}}' FROM named""",
)
def sarif_report_lines(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumn("recommendation", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("fix "), "ord")))
    rows = rows.withColumn("confidence", F.when(F.col("rule_id").isNull(), "low").otherwise("high"))
    return reports.sarif_report(rows, repos=reviewed(spark, sf_dir, rows))


@query(
    "text_report_lines",
    f"""WITH {FINDINGS_SQL}, r(s, n) AS (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('informational', 4))
SELECT repo, n AS section, ord, rpad(severity, 13, ' ') || ' ' || file || ':' || line || '  ' || title || '  (' || coalesce(rule_id, category) || ')' AS text FROM findings JOIN r ON s = severity
UNION ALL SELECT repo, 5, 0, count(*) || CASE WHEN count(*) = 1 THEN ' finding.' ELSE ' findings.' END FROM findings GROUP BY repo""",
)
def text_report_lines(spark, sf_dir):
    return reports.text_report(findings(spark, sf_dir))


@query(
    "path_predicates",
    r"""WITH paths AS (SELECT l_orderkey, l_linenumber,
  CASE l_suppkey % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'tests/' WHEN 3 THEN '.cache/' WHEN 4 THEN 'lib/vendor/' WHEN 5 THEN 'app/__tests__/' WHEN 6 THEN 'build/' ELSE '' END
  || 'f' || l_partkey || CASE l_linenumber WHEN 1 THEN '.ts' WHEN 2 THEN '.min.js' WHEN 3 THEN '_test.go' WHEN 4 THEN '.spec.ts' WHEN 5 THEN 'Test.java' WHEN 6 THEN '.d.ts' ELSE '.py' END AS path FROM lineitem)
SELECT l_orderkey, l_linenumber, path,
  regexp_matches(path, '(^|/)(node_modules|vendor|build|\.[^/]+)/') OR regexp_matches(path, '(?i)(\.min\.[a-z]+|\.d\.ts)$') AS ignored,
  regexp_matches(path, '(?i)(^|/)(__tests__|tests?)(/|$)|\.(test|spec)\.[a-z]+$|_test\.(go|py)$') OR regexp_matches(path, '[a-z0-9]Test\.java$') AS test
FROM paths""",
)
def path_predicates(spark, sf_dir):
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src/", "node_modules/", "tests/", ".cache/", "lib/vendor/", "app/__tests__/", "build/", "")]), (F.col("l_suppkey") % 8 + 1).cast("int"))
    ends = F.try_element_at(F.array(*[F.lit(x) for x in (".ts", ".min.js", "_test.go", ".spec.ts", "Test.java", ".d.ts")]), F.col("l_linenumber"))
    path = F.concat(folder, F.lit("f"), "l_partkey", F.coalesce(ends, F.lit(".py")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", path.alias("path"))
    return rows.withColumn("ignored", is_ignored_path(F.col("path"))).withColumn("test", is_test_path(F.col("path")))


@query(
    "merge_supersede",
    f"""WITH {FINDINGS_SQL},
own AS (SELECT * FROM findings WHERE ord % 3 <> 0),
tool AS (SELECT *, CASE ord % 2 WHEN 0 THEN 'biome' ELSE 'scanner' END AS t FROM findings WHERE ord % 3 = 0 AND category IN ('click', 'error')),
gone AS (SELECT DISTINCT repo FROM tool WHERE t = 'scanner' AND severity = 'critical'),
covered AS (SELECT DISTINCT repo, file, line FROM tool WHERE t = 'biome' AND category = 'click')
SELECT repo, file, rule_id, line, ord FROM own o
WHERE NOT (coalesce(rule_id, '') = 'signup' AND repo IN (SELECT repo FROM gone))
  AND NOT (coalesce(rule_id, '') = 'click' AND EXISTS (SELECT 1 FROM covered c WHERE c.repo = o.repo AND c.file = o.file AND c.line = o.line))
UNION ALL SELECT repo, file, t || ':' || category, line, ord FROM tool""",
)
def merge_supersede(spark, sf_dir):
    from findlake.operators.accept import merge_analyzer_findings

    rows = findings(spark, sf_dir).select("repo", "file", "rule_id", "category", "severity", "line", "ord")
    own = rows.where("ord % 3 <> 0")
    name = F.when(F.col("ord") % 2 == 0, "biome").when(F.col("severity") == "critical", "scanner-critical").otherwise("scanner")
    tool = rows.where("ord % 3 = 0 AND category IN ('click', 'error')").withColumn("tool", name).withColumn("tool_rule", F.col("category"))
    shown = F.concat_ws(":", F.when(F.col("ord") % 2 == 0, "biome").otherwise("scanner"), "category")
    tool = tool.withColumn("rule_id", shown)
    supersedes = spark.createDataFrame([("scanner-critical", "signup")], "tool string, rule_id string")
    equivalents = spark.createDataFrame([("biome", "click", "click")], "tool string, tool_rule string, rule_id string")
    merged = merge_analyzer_findings(own, tool, supersedes, equivalents)
    return merged.select("repo", "file", "rule_id", "line", "ord")


@query(
    "merged_findings",
    f"""WITH {FINDINGS_SQL},
own AS (SELECT repo, file, CASE category WHEN 'click' THEN 'no-hardcoded-secrets' ELSE rule_id END AS rule_id, line, ord FROM findings WHERE ord % 2 = 0),
tool AS (SELECT repo, file, category, CASE WHEN ord % 5 <> 0 THEN line END AS line, ord FROM findings WHERE ord % 2 = 1)
SELECT repo, file, rule_id, line, ord FROM own WHERE NOT (coalesce(rule_id, '') = 'no-hardcoded-secrets' AND CAST(repo AS INTEGER) % 2 = 0)
UNION ALL SELECT repo, file, 'ruff:' || category, line, ord FROM tool UNION ALL SELECT repo, file, 'ruff:' || category, line, -ord FROM tool""",
)
def merged_findings(spark, sf_dir):
    """Each analyzer finding comes twice and a fifth have no line; the secret scanner ran clean in every other repository."""
    from findlake.plans.review import merged

    rows = findings(spark, sf_dir)
    own = rows.where("ord % 2 = 0").withColumn("rule_id", F.when(F.col("category") == "click", "no-hardcoded-secrets").otherwise(F.col("rule_id")))
    tool = rows.where("ord % 2 = 1").select(
        "repo", F.lit("ruff").alias("tool"), F.col("category").alias("rule_id"), F.col("title").alias("message"), "severity", "category", "file",
        F.when(F.col("ord") % 5 != 0, F.col("line")).alias("line"), F.lit(False).alias("sensitive"), F.explode(F.array("ord", -F.col("ord"))).alias("ord"),
    )
    text = rows.select("repo", "file", "line", F.lit("x").alias("text")).distinct()
    runs = rows.select("repo").distinct().select("repo", F.explode(F.when(F.col("repo").cast("int") % 2 == 0, F.array(F.lit("ruff"), F.lit("gitleaks"))).otherwise(F.array(F.lit("ruff")))).alias("tool"))
    names = ("repo", "file", "rule_id", "category", "severity", "line", "anchor", "ord", "title")
    return merged(spark, own.select(*names), tool, text, runs).select("repo", "file", "rule_id", "line", "ord")
