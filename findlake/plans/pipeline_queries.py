"""The review and the analysis run whole over the shared tables, and the remaining readers."""

from pyspark.sql import functions as F

from findlake.operators import modules, resolve, surface
from findlake.plans.analysis import Analysis
from findlake.plans.registry import query
from findlake.plans.review import review
from findlake.plans.tables import LEDGER_SQL, ledger, session_one, session_two, table, texts
from findlake.operators.accept import create_baseline
from findlake.sources import analyzers


def _review(spark, sf_dir):
    second = session_two(spark, sf_dir)
    items = F.array(F.struct(F.lit("accepted-deviation").alias("kind"), F.lit("signup").alias("rule_id"), F.lit(1).cast("long").alias("item_ord")))
    null = F.lit(None).cast("string")
    memory = second.select("repo").distinct().select("repo", F.explode(items).alias("m")).select(
        "repo", "m.*", null.alias("file"), null.alias("category"), F.lit("active").alias("status"), F.lit("m1").alias("item_id")
    )
    return review(second, ledger(spark, sf_dir), "s2", "2024-01-31", memory=memory, baseline=create_baseline(session_one(spark, sf_dir)), fail_on="high")


REVIEW_SQL = f"""{LEDGER_SQL},
kept AS (SELECT *, file || '::' || coalesce(rule_id, '') || '::' || anchor AS key FROM s2 WHERE rule_id IS NULL OR rule_id <> 'signup'),
base AS (SELECT repo, file || '::' || coalesce(rule_id, '') || '::' || anchor AS key, count(*) AS n FROM s1 GROUP BY 1, 2),
nth AS (SELECT *, row_number() OVER (PARTITION BY repo, key ORDER BY ord) AS k FROM kept),
reported AS (SELECT nth.* FROM nth LEFT JOIN base ON base.repo = nth.repo AND base.key = nth.key WHERE k > coalesce(n, 0))"""


@query("review_reported", f"WITH {REVIEW_SQL} SELECT repo, ord, file, rule_id, severity FROM reported")
def review_reported(spark, sf_dir):
    return _review(spark, sf_dir).findings.select("repo", "ord", "file", "rule_id", "severity")


@query(
    "review_gate",
    f"""WITH {REVIEW_SQL} SELECT repo, bool_or(severity IN ('critical', 'high')) AS failed, count(*) FILTER (severity IN ('critical', 'high')) AS over_bar FROM reported GROUP BY 1""",
)
def review_gate(spark, sf_dir):
    return _review(spark, sf_dir).gate


@query(
    "review_ledger",
    f"""WITH {REVIEW_SQL},
seen AS (SELECT repo, file, coalesce('r:' || rule_id, 'c:' || category) AS identity FROM kept GROUP BY 1, 2, 3)
SELECT coalesce(l.repo, s.repo) AS repo, CASE WHEN l.repo IS NULL THEN 'open' WHEN s.repo IS NULL AND l.status IN ('open', 'acknowledged') THEN 'resolved'
  WHEN s.repo IS NOT NULL AND l.status IN ('resolved', 'dismissed') THEN 'reopened' ELSE l.status END AS status, count(*) AS entries
FROM ledger l FULL OUTER JOIN seen s ON s.repo = l.repo AND s.file = l.file AND s.identity = l.identity GROUP BY 1, 2""",
)
def review_ledger(spark, sf_dir):
    return _review(spark, sf_dir).sync.ledger.groupBy("repo", "status").agg(F.count(F.lit(1)).alias("entries"))


def _part_repo(spark, sf_dir):
    """Parts as a repository: packages by brand, one file per part, imports along ship lines."""
    part = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1)
    path = F.concat(F.lit("packages/b"), brand, F.lit("/p"), "p_partkey", F.lit(".ts"))
    return part.select("p_partkey", "p_size", brand.alias("brand"), path.alias("path"))


def _analysis(spark, sf_dir):
    parts = _part_repo(spark, sf_dir)
    files = parts.select(F.lit("shop").alias("repo"), "path")
    named = parts.select("brand").distinct()
    word = F.element_at(F.array(*[F.lit(w) for w in ("core", "services", "gateways", "infra", "web")]), (F.col("brand").cast("int") % 5 + 1).cast("int"))
    manifests = named.select(
        F.lit("shop").alias("repo"), F.concat(F.lit("packages/b"), "brand").alias("dir"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("@shop/"), word, F.lit("-"), "brand").alias("name"), F.lit(False).alias("member")
    )
    # A file imports its neighbour by number.
    other = parts.select((F.col("p_partkey") - 7).alias("p_partkey"), F.col("brand").alias("to"))
    pairs = parts.join(other, "p_partkey").select("path", "to", "p_partkey")
    imports = pairs.select(
        F.lit("shop").alias("repo"), F.col("path").alias("file"), F.lit(1).alias("line"), F.concat(F.lit("../b"), "to", F.lit("/p"), (F.col("p_partkey") + 7).cast("string")).alias("specifier"), F.lit(None).cast("string").alias("scope")
    )
    null = F.lit(None).cast("string")
    none = manifests.limit(0).select("repo", F.col("dir").alias("module"), "ecosystem", "name", null.alias("path"), null.alias("manifest_file"))
    rule = F.lit("* @all\npackages/b1*/** @teens\n")
    owner_files = files.select("repo").distinct().select("repo", F.lit("CODEOWNERS").alias("path"), rule.alias("content"))
    return Analysis(files, manifests, imports, none, owner_files)


SHOP_SQL = """
p AS (SELECT p_partkey AS k, p_size AS s, regexp_extract(p_brand, '(\\d+)', 1) AS b FROM part),
e AS (SELECT 'packages/b' || x.b AS src, 'packages/b' || y.b AS dst, count(*) AS n FROM p x JOIN p y ON y.k = x.k + 7 WHERE x.b <> y.b GROUP BY 1, 2)"""


@query("analysis_edges", f"WITH {SHOP_SQL} SELECT src, dst, 'import' AS kind, n AS evidence_count FROM e")
def analysis_edges(spark, sf_dir):
    return _analysis(spark, sf_dir).edges.select("src", "dst", "kind", "evidence_count")


@query(
    "analysis_violations",
    f"""WITH {SHOP_SQL},
l AS (SELECT DISTINCT 'packages/b' || b AS m, CAST(b AS INTEGER) % 5 AS pos FROM p)
SELECT src, dst, n AS evidence FROM e JOIN l a ON a.m = src JOIN l b ON b.m = dst WHERE a.pos < b.pos""",
)
def analysis_violations(spark, sf_dir):
    return _analysis(spark, sf_dir).violations.select("src", "dst", "evidence")


@query(
    "analysis_owners",
    f"""WITH {SHOP_SQL} SELECT 'packages/b' || b AS module, CASE WHEN b LIKE '1%' THEN '@teens' ELSE '@all' END AS owners, count(*) AS owned_files FROM p GROUP BY 1, 2""",
)
def analysis_owners(spark, sf_dir):
    return _analysis(spark, sf_dir).owners.select("module", F.array_join("owners", ",").alias("owners"), "owned_files")


@query(
    "analysis_cycles",
    f"""WITH RECURSIVE {SHOP_SQL}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst),
m AS (SELECT a.src AS node, min(a.dst) AS component, count(DISTINCT a.dst) AS size FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
SELECT component, node, size FROM m WHERE size >= 2""",
)
def analysis_cycles(spark, sf_dir):
    return _analysis(spark, sf_dir).cycles.select("component", "node", "size")


def _report_rows(spark, sf_dir, tool, content):
    return texts(spark, sf_dir, "events", "event_id").select((F.col("user_id") % 10).cast("string").alias("repo"), F.lit(tool).alias("tool"), F.lit("/repo").alias("root"), content.alias("content"))


def _n():
    return (F.col("event_id") % 500 + 1).cast("string")


@query(
    "eslint_ingest",
    """SELECT CAST(user_id % 10 AS VARCHAR) AS repo, r AS rule_id, CASE WHEN event_id % 2 = 0 THEN 'medium' ELSE 'low' END AS severity,
  CASE event_type WHEN 'click' THEN 'security' WHEN 'view' THEN 'reliability' WHEN 'error' THEN 'accessibility' ELSE 'maintainability' END AS category, 'src/u' || user_id || '.ts' AS file, CAST(event_id % 500 + 1 AS INTEGER) AS line
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'no-eval' WHEN 'view' THEN 'react-hooks/rules' WHEN 'error' THEN 'jsx-a11y/alt' WHEN 'signup' THEN 'parse-error' ELSE 'semi' END AS r FROM events)""",
)
def eslint_ingest(spark, sf_dir):
    kind = F.col("event_type")
    rule = F.when(kind == "click", '"no-eval"').when(kind == "view", '"react-hooks/rules"').when(kind == "error", '"jsx-a11y/alt"').when(kind == "signup", "null").otherwise('"semi"')
    level = F.when(F.col("event_id") % 2 == 0, "2").otherwise("1")
    content = F.concat(F.lit('(node) warning\n[{"filePath":"/repo/src/u'), F.col("user_id").cast("string"), F.lit('.ts","messages":[{"ruleId":'), rule, F.lit(',"severity":'), level, F.lit(',"message":"m","line":'), _n(), F.lit("}]}]"))
    return analyzers.read_eslint(_report_rows(spark, sf_dir, "eslint", content)).select("repo", "rule_id", "severity", "category", "file", "line")


@query(
    "clippy_ingest",
    """SELECT CAST(user_id % 10 AS VARCHAR) AS repo, CASE event_type WHEN 'click' THEN 'clippy::unwrap_used' WHEN 'view' THEN 'clippy::perf_x' ELSE 'clippy::style' END AS rule_id,
  CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'low' END AS severity, CASE event_type WHEN 'click' THEN 'reliability' WHEN 'view' THEN 'performance' ELSE 'maintainability' END AS category,
  'src/u' || user_id || '.rs' AS file, CAST(event_id % 500 + 1 AS INTEGER) AS line FROM events WHERE event_type <> 'error'""",
)
def clippy_ingest(spark, sf_dir):
    kind = F.col("event_type")
    code = F.when(kind == "click", "clippy::unwrap_used").when(kind == "view", "clippy::perf_x").otherwise("clippy::style")
    reason = F.when(kind == "error", "build-finished").otherwise("compiler-message")
    level = F.when(F.col("event_id") % 3 == 0, "error").otherwise("warning")
    message = F.concat(
        F.lit('{"reason":"'), reason, F.lit('","message":{"message":"m","level":"'), level, F.lit('","code":{"code":"'), code,
        F.lit('"},"spans":[{"file_name":"x.rs","is_primary":false,"line_start":1},{"file_name":"src/u'), F.col("user_id").cast("string"), F.lit('.rs","is_primary":true,"line_start":'), _n(), F.lit("}],\"children\":[]}}"),
    )
    content = F.concat(F.lit('{"reason":"compiler-artifact"}\nnoise\n'), message)
    return analyzers.read_clippy(_report_rows(spark, sf_dir, "clippy", content)).select("repo", "rule_id", "severity", "category", "file", "line")


@query(
    "phpstan_runs",
    """SELECT CAST(user_id % 10 AS VARCHAR) AS repo, CASE WHEN bool_or(event_type = 'error' AND value > 60) THEN 'failed' ELSE 'ran' END AS status,
  count(*) FILTER (NOT (event_type = 'error' AND value > 60)) AS findings FROM events GROUP BY 1""",
)
def phpstan_runs(spark, sf_dir):
    broken = (F.col("event_type") == "error") & (F.col("value") > 60)
    good = F.concat(F.lit('{"files":{"/repo/u'), F.col("user_id").cast("string"), F.lit('.php":{"messages":[{"message":"m","line":'), _n(), F.lit(',"identifier":"a.b"}]}},"errors":[]}'))
    content = F.when(broken, '{"result":"failed","errors":1,"general_errors":["memory"]}').otherwise(good)
    _, runs = analyzers.read_reports(_report_rows(spark, sf_dir, "phpstan", content), {"phpstan": analyzers.ADAPTERS["phpstan"]})
    return runs.select("repo", "status", "findings")


@query(
    "namespace_projects",
    """WITH m AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT DISTINCT replace(p_name, ' ', '.') FROM part WHERE p_size > 25),
i AS (SELECT p_partkey, replace(p_name, ' ', '.') || '.N' || p_size AS spec FROM part),
hit AS (SELECT p_partkey, arg_max(name, length(name)) AS name FROM i JOIN m ON spec = name OR starts_with(spec, name || '.') GROUP BY 1)
SELECT i.p_partkey, CASE WHEN name IS NULL THEN 'external' ELSE 'package' END AS outcome, 'src/' || name AS target_module FROM i LEFT JOIN hit ON hit.p_partkey = i.p_partkey""",
)
def namespace_projects(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    dotted = F.replace(F.col("p_name"), F.lit(" "), F.lit("."))
    first = part.select(F.split("p_name", " ")[0].alias("name"))
    names = first.unionByName(part.where("p_size > 25").select(dotted.alias("name"))).distinct()
    manifests = names.select(F.lit("r").alias("repo"), "name", F.concat(F.lit("src/"), "name").alias("dir"))
    imports = part.select(F.lit("r").alias("repo"), "p_partkey", F.concat(dotted, F.lit(".N"), F.col("p_size").cast("string")).alias("specifier"))
    return resolve.namespace_prefix(imports, manifests).select("p_partkey", "outcome", "target_module")


@query(
    "exported_surface",
    """WITH d AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'internal' ELSE 'm' || (p_size % 5) END || '/' || CASE WHEN p_size % 7 = 0 THEN 'tests/' ELSE '' END || 'f' || (p_partkey % 20) || '.go' AS file,
  CASE WHEN p_size % 2 = 0 THEN upper(substr(p_name, 1, 1)) ELSE substr(p_name, 1, 1) END || substr(p_name, 2, 2) AS name FROM part)
SELECT p_partkey AS line, split_part(file, '/', 1) AS module, file, name FROM d WHERE regexp_matches(name, '^[A-Z]') AND NOT contains(file, 'tests/') AND NOT starts_with(file, 'internal/')""",
)
def exported_surface(spark, sf_dir):
    from findlake.operators.rules import visibility

    size = F.col("p_size")
    folder = F.when(size % 5 == 0, "internal").otherwise(F.concat(F.lit("m"), (size % 5).cast("string")))
    file = F.concat(folder, F.lit("/"), F.when(size % 7 == 0, "tests/").otherwise(""), F.lit("f"), (F.col("p_partkey") % 20).cast("string"), F.lit(".go"))
    letter = F.substring("p_name", 1, 1)
    name = F.concat(F.when(size % 2 == 0, F.upper(letter)).otherwise(letter), F.substring("p_name", 2, 2))
    declared = table(spark, sf_dir, "part").select(F.lit("r").alias("repo"), F.col("p_partkey").alias("line"), file.alias("file"), name.alias("name"))
    declared = declared.withColumn("visibility", visibility(F.lit("go"), F.col("name"), F.lit(""), F.lit(False)))
    files = declared.select("repo", F.col("file").alias("path")).distinct()
    mods = files.select("repo", F.split("path", "/")[0].alias("module"), F.lit("go").alias("manifest")).distinct()
    return surface.declared_surface(declared, modules.module_files(files, mods)).select("line", "module", "file", "name")
