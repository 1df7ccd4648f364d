"""Analyzer reports (SARIF and common JSON formats) to one finding shape.

Input: one row per report, ``repo, tool, root, content``. A report is parsed inside its row and
exploded; rules are looked up in the run's own rule list before the explode, so no shuffle is
needed. A report that cannot be read is a failed run, never "no findings".
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.paths import basename, extension, is_ignored_path, to_repository_path
from findlake.functions.severity import severity_from_level, severity_from_score
from findlake.functions.text import bound, trim_space

# --- fixed values: rule prefixes and the category they decide, first match wins ---
ESLINT_CATEGORIES = (
    (("no-eval", "no-implied-eval", "no-new-func", "no-script-url", "security/"), "security"),
    (("eqeqeq", "no-undef", "no-unused-vars", "no-dupe", "no-unreachable", "no-cond-assign", "use-isnan", "valid-typeof", "react-hooks/"), "reliability"),
    (("jsx-a11y/",), "accessibility"),
)
BIOME_CATEGORIES = (
    (("lint/security/",), "security"),
    (("lint/correctness/", "lint/suspicious/"), "reliability"),
    (("lint/performance/",), "performance"),
    (("lint/a11y/",), "accessibility"),
)
DETEKT_CATEGORIES = ((("detekt.potential-bugs.", "detekt.coroutines."), "reliability"), (("detekt.performance.",), "performance"))
CLIPPY_RELIABILITY = ("unwrap_used", "expect_used", "panic", "indexing_slicing", "unreachable", "todo", "unimplemented")
CLIPPY_PERFORMANCE = ("clippy::perf", "clippy::redundant_clone", "clippy::useless_vec", "clippy::needless_collect")

# --- fixed values: (tool, its rule, our rule) and (tool, our rule it answers for entirely) ---
EQUIVALENTS = (
    ("biome", "lint/suspicious/noDoubleEquals", "eqeqeq"),
    ("biome", "lint/suspicious/noExplicitAny", "no-explicit-any"),
    ("biome", "lint/security/noGlobalEval", "no-eval"),
    ("biome", "lint/style/noVar", "no-var"),
    ("biome", "lint/correctness/noVar", "no-var"),
    ("eslint", "no-var", "no-var"),
    ("eslint", "eqeqeq", "eqeqeq"),
    ("eslint", "no-eval", "no-eval"),
    ("eslint", "no-implied-eval", "no-implied-eval"),
    ("eslint", "no-console", "avoid-print"),
)
SUPERSEDES = (("gitleaks", "no-hardcoded-secrets"),)
LOCKFILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "Cargo.lock", "composer.lock", "go.sum",
    "Gemfile.lock", "poetry.lock", "uv.lock", "requirements.txt", "gradle.lockfile", "pom.xml",
)
TRUST = {
    "gitleaks": "safe", "osv-scanner": "network", "biome": "safe", "eslint": "runs-project-code", "ruff": "safe",
    "clippy": "runs-project-code", "phpstan": "runs-project-code", "ktlint": "safe", "detekt": "safe",
}


def first_prefix(table, rule: Column, fallback: str = "maintainability") -> Column:
    """Category of the first prefix group the rule starts with."""
    chain = F.lit(fallback)
    for prefixes, category in reversed(table):
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | rule.startswith(prefix)
        chain = F.when(hit, category).otherwise(chain)
    return chain


def json_start(content: Column, opening: str = "{") -> Column:
    """Tools print logs beside their output: the document starts at the first line that begins
    with the opening character, else at its first occurrence; null without one."""
    at_line, anywhere = F.instr(content, "\n" + opening), F.instr(content, opening)
    at = F.when(content.startswith(opening), 1).when(at_line > 0, at_line + 1).otherwise(anywhere)
    return F.when(at > 0, F.substring(content, at, F.length(content)))


def _first(opening: str, content: Column) -> Column:
    at = F.instr(content, opening)
    return F.when(at > 0, F.substring(content, at, F.length(content)))


def _position(line, column=None, end_line=None, end_column=None) -> list[Column]:
    null = F.lit(None).cast("int")
    cells = [("line", line), ("column", column), ("end_line", end_line), ("end_column", end_column)]
    return [(null if c is None else F.when(c >= 0, c).cast("int")).alias(n) for n, c in cells]


def _shape(rows: DataFrame, rule, message, severity, category, file, position, url, sensitive=False) -> DataFrame:
    null = F.lit(None).cast("string")
    shaped = rows.select(
        "repo",
        "tool",
        rule.alias("rule_id"),
        message.alias("message"),
        severity.alias("severity"),
        category.alias("category"),
        to_repository_path(file, F.col("root")).alias("file"),
        *position,
        (null if url is None else url).alias("url"),
        (sensitive if isinstance(sensitive, Column) else F.lit(sensitive)).alias("sensitive"),
    )
    return shaped.where("file IS NOT NULL")


_REGION = "struct<startLine:int,startColumn:int,endLine:int,endColumn:int>"
_PHYSICAL = f"struct<artifactLocation:struct<uri:string>,region:{_REGION}>"
_RESULT = f"struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:{_PHYSICAL}>>>"
_RULE = "struct<id:string,helpUri:string,properties:struct<`security-severity`:string>>"
SARIF = f"struct<runs:array<struct<tool:struct<driver:struct<rules:array<{_RULE}>>>,results:array<{_RESULT}>>>>"


def read_sarif(reports: DataFrame) -> DataFrame:
    """Any SARIF 2.1.0 report. Per tool: gitleaks is security, critical and sensitive; OSV is
    security; ktlint is always low; detekt maps prefixes and reads anything but ``error`` as a warning."""
    document = F.from_json(json_start(F.col("content")), SARIF)
    runs = reports.select("repo", "tool", "root", F.explode(document["runs"]).alias("run"))

    def with_rule(result: Column) -> Column:
        rules = F.col("run.tool.driver.rules")
        wanted = F.coalesce(result["ruleId"], F.lit("unknown"))
        return F.struct(result.alias("r"), F.try_element_at(F.filter(rules, lambda x: x["id"] == wanted), F.lit(1)).alias("rule"))

    rows = runs.select("repo", "tool", "root", F.explode(F.transform("run.results", with_rule)).alias("x")).select("repo", "tool", "root", "x.*")
    place = F.try_element_at("r.locations", F.lit(1))["physicalLocation"]
    rule = F.coalesce("r.ruleId", F.lit("unknown"))
    score = F.col("rule.properties.security-severity").try_cast("double")
    level = F.col("r.level")
    tool = F.col("tool")
    by_level = (
        F.when(tool == "gitleaks", "critical")
        .when(tool == "ktlint", "low")
        .when(tool == "detekt", severity_from_level(F.when(level == "error", "error").otherwise("warning")))
        .otherwise(severity_from_level(level))
    )
    category = (
        F.when(tool.isin("gitleaks", "osv-scanner"), "security")
        .when(tool == "detekt", first_prefix(DETEKT_CATEGORIES, rule))
        .otherwise("maintainability")
    )
    region = place["region"]
    return _shape(
        rows,
        rule,
        F.coalesce("r.message.text", rule),
        F.when(score.isNotNull(), severity_from_score(score)).otherwise(by_level),
        category,
        place["artifactLocation"]["uri"],
        _position(region["startLine"], region["startColumn"], region["endLine"], region["endColumn"]),
        F.when(F.col("rule.helpUri") != "", F.col("rule.helpUri")),
        tool == "gitleaks",
    )


ESLINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int,column:int,endLine:int,endColumn:int>>>>"


def read_eslint(reports: DataFrame) -> DataFrame:
    entries = F.from_json(_first("[", F.col("content")), ESLINT)
    rows = reports.select("repo", "tool", "root", F.explode(entries).alias("e")).select("repo", "tool", "root", "e.filePath", F.explode("e.messages").alias("m"))
    rule = F.coalesce("m.ruleId", F.lit("parse-error"))
    docs = F.when(~F.col("m.ruleId").contains("/"), F.concat(F.lit("https://eslint.org/docs/latest/rules/"), "m.ruleId"))
    return _shape(
        rows,
        rule,
        F.coalesce("m.message", rule),
        F.when(F.coalesce("m.severity", F.lit(0)) >= 2, "medium").otherwise("low"),
        first_prefix(ESLINT_CATEGORIES, rule),
        F.coalesce("filePath", F.lit("")),
        _position(F.col("m.line"), F.col("m.column"), F.col("m.endLine"), F.col("m.endColumn")),
        docs,
    )


_POINT = "struct<line:int,column:int>"
BIOME = f"struct<diagnostics:array<struct<severity:string,message:string,category:string,location:struct<path:string,start:{_POINT},end:{_POINT}>>>>"


def read_biome(reports: DataFrame) -> DataFrame:
    document = F.from_json(json_start(F.col("content")), BIOME)
    rows = reports.select("repo", "tool", "root", F.explode(document["diagnostics"]).alias("d"))
    path = F.when(F.col("d.location.path").startswith("{"), F.get_json_object("d.location.path", "$.file")).otherwise(F.col("d.location.path"))
    rule = F.coalesce("d.category", F.lit("biome"))
    dashed = F.lower(F.regexp_replace(F.element_at(F.split(rule, "/"), -1), "([A-Z])", "-$1"))
    severity = F.when(F.col("d.severity") == "error", "medium").when(F.col("d.severity") == "information", "informational").otherwise("low")
    start, end = F.col("d.location.start"), F.col("d.location.end")
    return _shape(
        rows,
        rule,
        F.coalesce("d.message", rule),
        severity,
        first_prefix(BIOME_CATEGORIES, rule),
        path,
        _position(start["line"], start["column"], end["line"], end["column"]),
        F.when(rule.startswith("lint/"), F.concat(F.lit("https://biomejs.dev/linter/rules/"), dashed)),
    )


_CELL = "struct<row:int,column:int>"
RUFF = f"array<struct<code:string,message:string,filename:string,location:{_CELL},end_location:{_CELL},url:string>>"


def read_ruff(reports: DataFrame) -> DataFrame:
    rows = reports.select("repo", "tool", "root", F.explode(F.from_json("content", RUFF)).alias("d"))
    code = F.coalesce("d.code", F.lit("syntax-error"))
    flaw = code.rlike("^(F|E9|B)") | F.col("d.code").isNull()
    security = code.startswith("S")
    return _shape(
        rows,
        code,
        F.coalesce("d.message", code),
        F.when(flaw | security, "medium").otherwise("low"),
        F.when(security, "security").when(flaw, "reliability").otherwise("maintainability"),
        F.col("d.filename"),
        _position(F.col("d.location.row"), F.col("d.location.column"), F.col("d.end_location.row"), F.col("d.end_location.column")),
        F.col("d.url"),
    )


_SPAN = "struct<file_name:string,is_primary:boolean,line_start:int,column_start:int,line_end:int,column_end:int>"
CLIPPY = f"struct<reason:string,message:struct<message:string,level:string,code:struct<code:string>,spans:array<{_SPAN}>,children:array<struct<message:string>>>>"


def read_clippy(reports: DataFrame) -> DataFrame:
    """JSON lines; only compiler messages with a code, a level and a span count."""
    lines = reports.select("repo", "tool", "root", F.explode(F.split("content", r"\r?\n")).alias("line")).where("startswith(line, '{')")
    parsed = lines.select("repo", "tool", "root", F.from_json("line", CLIPPY).alias("d")).where(
        "d.reason = 'compiler-message' AND d.message.code.code <> '' AND d.message.level IN ('warning', 'error')"
    )
    primary = F.try_element_at(F.filter("d.message.spans", lambda s: s["is_primary"]), F.lit(1))
    rows = parsed.withColumn("s", F.coalesce(primary, F.try_element_at("d.message.spans", F.lit(1)))).where("s.file_name IS NOT NULL")
    rule = F.col("d.message.code.code")
    reliability = F.lit(False)
    for word in CLIPPY_RELIABILITY:
        reliability = reliability | rule.contains(word)
    performance = F.lit(False)
    for prefix in CLIPPY_PERFORMANCE:
        performance = performance | rule.startswith(prefix)
    help_text = F.array_join(F.transform("d.message.children", lambda c: c["message"]), " ")
    link = F.regexp_extract(help_text, r"(https://rust-lang\.github\.io/[^\s`]*)", 1)
    return _shape(
        rows,
        rule,
        F.coalesce("d.message.message", rule),
        F.when(F.col("d.message.level") == "error", "high").otherwise("low"),
        F.when(reliability, "reliability").when(performance, "performance").otherwise("maintainability"),
        F.col("s.file_name"),
        _position(F.col("s.line_start"), F.col("s.column_start"), F.col("s.line_end"), F.col("s.column_end")),
        F.when(link != "", link),
    )


PHPSTAN = "struct<result:string,errors:string,general_errors:string,files:map<string,struct<messages:array<struct<message:string,line:int,identifier:string>>>>>"


def _phpstan_fault(content: Column) -> Column:
    """A run that did not finish says nothing about the code, so it is a fault."""
    listed = lambda c: F.coalesce(F.from_json(F.when(c.startswith("["), c), "array<string>"), F.array().cast("array<string>"))

    def judge(document: Column) -> Column:
        problem = F.try_element_at(F.concat(listed(document["errors"]), listed(document["general_errors"])), F.lit(1))
        return (
            F.when(problem.isNotNull(), F.concat(F.lit("PHPStan could not finish: "), F.element_at(F.split(problem, "\n"), 1)))
            .when((document["result"] == "failed") & document["files"].isNull(), "PHPStan reported a failed run without saying why")
        )

    return bound(F.from_json(json_start(content), PHPSTAN), judge)


def read_phpstan(reports: DataFrame) -> DataFrame:
    good = reports.where(_phpstan_fault(F.col("content")).isNull())
    document = F.from_json(json_start(F.col("content")), PHPSTAN)
    rows = good.select("repo", "tool", "root", F.explode(document["files"]).alias("file", "entry")).select("repo", "tool", "root", "file", F.explode("entry.messages").alias("m"))
    found = F.col("m.identifier")
    return _shape(
        rows,
        F.coalesce(found, F.lit("phpstan")),
        F.coalesce("m.message", F.lit("")),
        F.lit("medium"),
        F.lit("reliability"),
        F.col("file"),
        _position(F.when(F.col("m.line") > 0, F.col("m.line"))),
        F.concat(F.lit("https://phpstan.org/error-identifiers/"), found),
    )


Reader = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Adapter:
    """How a tool's reports are read and when a report is a failed run (null = readable)."""

    read: Reader
    fault: Callable[[Column], Column]


def _unreadable(schema: str, start: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def fault(content: Column) -> Column:
        def judge(text: Column) -> Column:
            return F.when(text.isNull(), "no JSON document in the output").when(F.from_json(text, schema).isNull(), "output not understood")

        return bound(start(content), judge)

    return fault


def _osv_fault(content: Column) -> Column:
    return F.when(trim_space(content) != "", _unreadable(SARIF, json_start)(content))


ADAPTERS: dict[str, Adapter] = {
    "gitleaks": Adapter(read_sarif, _unreadable(SARIF, json_start)),
    "osv-scanner": Adapter(read_sarif, _osv_fault),
    "ktlint": Adapter(read_sarif, _unreadable(SARIF, json_start)),
    "detekt": Adapter(read_sarif, _unreadable(SARIF, json_start)),
    "biome": Adapter(read_biome, _unreadable(BIOME, json_start)),
    "eslint": Adapter(read_eslint, _unreadable(ESLINT, lambda c: _first("[", c))),
    "ruff": Adapter(read_ruff, _unreadable(RUFF, lambda c: F.when(trim_space(c) != "", c))),
    "clippy": Adapter(read_clippy, lambda c: F.lit(None).cast("string")),
    "phpstan": Adapter(read_phpstan, lambda c: F.coalesce(_unreadable(PHPSTAN, json_start)(c), _phpstan_fault(c))),
}


def register(tool: str, adapter: Adapter) -> None:
    """Extension point: another tool's reader."""
    ADAPTERS[tool] = adapter


def read_reports(reports: DataFrame, adapters: Mapping[str, Adapter] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(findings, runs)`` of mixed reports. Paths a review does not own are dropped."""
    known = dict(adapters or ADAPTERS)
    by_reader: dict[Reader, list[str]] = {}
    for tool, adapter in known.items():
        by_reader.setdefault(adapter.read, []).append(tool)
    findings = None
    for read, tools in by_reader.items():
        part = read(reports.where(F.col("tool").isin(*tools)))
        findings = part if findings is None else findings.unionByName(part)
    findings = findings.where(~is_ignored_path(F.col("file")))
    fault = F.lit(None).cast("string")
    for tool, adapter in known.items():
        fault = F.when(F.col("tool") == tool, adapter.fault(F.col("content"))).otherwise(fault)
    fault = F.when(~F.col("tool").isin(*known), "unknown tool").otherwise(fault)
    counts = findings.groupBy("repo", "tool").agg(F.count(F.lit(1)).alias("findings"))
    runs = reports.select("repo", "tool", fault.alias("reason")).groupBy("repo", "tool").agg(F.max("reason").alias("reason"))
    runs = runs.join(counts, ["repo", "tool"], "left").select(
        "repo", "tool", F.when(F.col("reason").isNull(), "ran").otherwise("failed").alias("status"), "reason", F.coalesce("findings", F.lit(0)).alias("findings")
    )
    return findings, runs


def in_review(findings: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Findings on files of the review: (repo, file)."""
    return findings.join(reviewed.select("repo", "file").distinct(), ["repo", "file"], "left_semi")


def applicable_tools(files: DataFrame) -> DataFrame:
    """``(repo, tool, applies)`` from the file listing in one pass."""
    path, name = F.col("path"), basename(F.col("path"))
    ends = extension(path)
    kotlin = ends.isin("kt", "kts")
    flags = {
        "gitleaks": F.lit(True),
        "osv-scanner": name.isin(*LOCKFILES),
        "biome": name.isin("biome.json", "biome.jsonc"),
        "eslint": name.rlike(r"^eslint\.config\.(js|ts|cjs|mjs|cts|mts)$|^\.eslintrc(\.[a-z]+)?$"),
        "ruff": ends.isin("py", "pyi"),
        "clippy": name == "Cargo.toml",
        "phpstan": name.isin("composer.json", "phpstan.neon", "phpstan.dist.neon", "phpstan.neon.dist", "phpstan.dist.neon.dist"),
        "ktlint": kotlin,
        "detekt": name.rlike(r"^detekt[A-Za-z0-9_-]*\.ya?ml$"),
    }
    seen = files.groupBy("repo").agg(
        *[F.bool_or(flag).alias(tool) for tool, flag in flags.items()], F.bool_or(ends == "php").alias("__php"), F.bool_or(kotlin).alias("__kotlin")
    )
    applies = {tool: F.col(tool) for tool in flags}
    applies["phpstan"] = F.col("phpstan") & F.col("__php")
    applies["detekt"] = F.col("detekt") & F.col("__kotlin")
    rows = F.array(*[F.struct(F.lit(t).alias("tool"), c.alias("applies"), F.lit(TRUST[t]).alias("trust")) for t, c in applies.items()])
    return seen.select("repo", F.explode(rows).alias("t")).select("repo", "t.*")


def inventory(files: DataFrame, installed: DataFrame, options: DataFrame) -> DataFrame:
    """What each repository has installed and what a review would run.

    ``installed``: repo, tool, version. ``options``: repo, mode, disable (array), enable (array).
    """
    rows = (
        applicable_tools(files)
        .join(installed.select("repo", "tool", "version").withColumn("installed", F.lit(True)), ["repo", "tool"], "left")
        .join(options, "repo", "left")
        .withColumn("installed", F.coalesce("installed", F.lit(False)))
    )
    tool = F.col("tool")
    why = F.when(F.col("trust") == "runs-project-code", "it runs code the repository controls").otherwise("it sends package names and versions to a service")
    reason = (
        F.when(F.col("mode") == "off", "analyzers are turned off")
        .when(F.array_contains("disable", tool), "disabled in the repository's configuration")
        .when(~F.col("applies"), "this repository has nothing it analyzes")
        .when(~F.col("installed"), "not installed")
        .when(
            (F.col("trust") != "safe") & ~F.coalesce(F.array_contains("enable", tool), F.lit(False)),
            F.concat(why, F.lit('; enable "'), tool, F.lit('" explicitly')),
        )
    )
    return rows.select("repo", "tool", "trust", "applies", "installed", "version", reason.isNull().alias("will_run"), reason.alias("reason"))


def to_findings(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Analyzer findings with an excerpt and anchor: the flagged line, the message of a finding
    without a line, nothing when it is sensitive. ``lines``: repo, file, line, text. A column
    ``ord`` stays with its finding."""
    from findlake.functions.identity import content_anchor
    from findlake.functions.text import excerpt

    joined = found.join(lines.select("repo", "file", "line", "text"), ["repo", "file", "line"], "left")
    text = F.when(F.col("sensitive"), F.lit(None).cast("string")).otherwise(F.when(F.col("line").isNull(), F.col("message")).otherwise(F.col("text")))
    cited = excerpt(text)
    return joined.select(
        "repo", "file", F.concat_ws(":", "tool", "rule_id").alias("rule_id"), "category", "severity", "line", content_anchor(cited).alias("anchor"),
        F.col("message").alias("title"), "tool", F.col("rule_id").alias("tool_rule"), cited.alias("excerpt"), *[c for c in found.columns if c == "ord"],
    )
