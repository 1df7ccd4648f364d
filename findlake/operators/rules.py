"""The rule scan: lines and call facts met with rules, in one pass over the facts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.fixed import KNOWN_TOKEN_MARKS, KNOWN_TOKEN_PATTERNS, SCRIPT_FAMILY
from findlake.functions.identity import content_anchor
from findlake.functions.paths import extension, is_test_path
from findlake.functions.secrets import named_literals
from findlake.functions.text import after, ascii_words, excerpt, first_sentence, holds_known_token
from findlake.operators.ordered import first_per_key

# --- fixed values: rule, concept, when a call is reported, confidence, severity (null = the rule's),
# --- and whether JavaScript is read by the same rule ---
CONCEPT_RULES = (
    ("no-eval", "dynamic-eval", "always", "high", None, False),
    ("no-panic", "panic", "always", "high", None, False),
    ("no-shell-interpolation", "shell-sink", "command-is-built", "medium", None, False),
    ("n-plus-one-queries", "data-query", "reads-iteration", "low", "medium", True),
    ("a03-injection", "sql-sink", "receives-input", "high", None, False),
    ("a03-injection", "shell-sink", "receives-input", "high", None, False),
    ("no-unsafe-deserialization", "unsafe-deserialization", "without-options", "medium", None, False),
    ("no-weak-hash", "weak-hash", "always", "low", "medium", False),
    ("no-print-stack-trace", "stack-trace-print", "always", "high", None, False),
    ("no-fatal-error", "crash-call", "always", "high", None, False),
    ("no-raw-markup", "raw-markup", "always", "medium", None, False),
    ("no-permit-all", "permit-all", "always", "high", None, False),
    ("no-atom-from-input", "atom-from-string", "receives-input", "high", None, False),
    ("no-unbounded-c-string", "unbounded-c-string", "always", "high", None, False),
    ("no-debug-output", "debug-output", "always", "high", None, False),
    ("no-weak-random", "weak-random", "always", "low", "medium", True),
    ("a10-ssrf", "http-client", "receives-input", "high", None, True),
    ("no-path-traversal", "file-open", "receives-input", "high", None, True),
    ("no-env-outside-config", "env-helper", "always", "high", None, False),
    ("async-all-the-way", "task-wait", "always", "low", "medium", False),
    ("no-weak-cipher", "weak-cipher", "always", "medium", None, False),
    ("no-open-redirect", "redirect", "receives-input", "high", None, True),
    ("no-template-injection", "template-sink", "receives-input", "high", None, False),
    ("no-unsafe-reflection", "reflection-sink", "receives-input", "high", None, False),
    ("no-regex-from-input", "regex-sink", "receives-input", "high", None, True),
    ("no-unsafe-xml-parser", "xml-parser", "always", "low", "medium", False),
    ("no-process-exit", "process-exit", "always", "high", None, False),
    ("no-type-punning", "type-punning", "always", "high", None, False),
    ("no-http-without-timeout", "http-no-timeout", "without-keyword", "high", None, False),
    ("no-format-string", "format-sink", "receives-input", "high", None, False),
    ("no-extract", "variable-extraction", "always", "high", None, False),
    ("no-removed-mysql-api", "legacy-db-api", "always", "high", None, False),
    ("no-global-scope", "coroutine-leak", "always", "high", None, False),
    ("no-run-blocking", "run-blocking", "always", "high", None, False),
    ("no-gc-collect", "gc-collect", "always", "high", None, False),
    ("no-dispatch-main-sync", "main-sync", "always", "high", None, False),
    ("no-unfinished-code", "unfinished-code", "always", "high", None, False),
    ("no-env-mutation", "env-mutation", "always", "high", None, False),
    ("no-leak-memory", "memory-leak", "always", "high", None, False),
    ("spring-csrf-disabled", "csrf-disable", "always", "high", None, False),
    ("spring-permit-all-requests", "permit-all-requests", "always", "high", None, False),
    ("aspnet-developer-exception-page", "developer-errors", "always", "high", None, False),
    ("no-open-cors", "open-cors-call", "always", "high", None, False),
)
TIMEOUT_KEYWORD = "timeout"
CERTAIN, UNCERTAIN = 2, 1
SCRIPT_LANGUAGES = ("javascript", "jsx", "typescript", "tsx", "vue", "svelte", "astro")


@dataclass(frozen=True)
class LineRule:
    """A pattern over single lines. ``only_in``: extensions it means something in; ``unless``: a
    pattern that clears the line; ``tests``: whether test files are read; ``needs``: plain text a
    hit always holds one of, tested before the pattern."""

    rule_id: str
    pattern: str
    severity: str = "medium"
    category: str = "maintainability"
    confidence: str = "high"
    only_in: Sequence[str] = ()
    unless: str | None = None
    tests: bool = False
    needs: Sequence[str] = ()


SECRET_RULE = LineRule("no-hardcoded-secrets", "|".join(f"(?:{p})" for p in KNOWN_TOKEN_PATTERNS), "critical", "security", tests=True, needs=KNOWN_TOKEN_MARKS)


def scan_lines(lines: DataFrame, rules: Sequence[LineRule]) -> DataFrame:
    """``lines`` (repo, file, line, text, ...) to hits, one per rule and line. The rules are part of
    the plan, so every line is read once and no join is needed."""
    text, path = F.col("text"), F.col("file")
    tested = is_test_path(path)
    hits = []
    for rule in rules:
        found = text.rlike(ascii_words(rule.pattern))
        if rule.needs:
            mark = F.lit(False)
            for plain in rule.needs:
                mark = mark | F.contains(text, F.lit(plain))
            found = mark & found
        if rule.unless:
            found = found & ~text.rlike(ascii_words(rule.unless))
        if rule.only_in:
            found = found & extension(path).isin(*rule.only_in)
        if not rule.tests:
            found = found & ~tested
        cells = F.struct(
            F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.category).alias("category"), F.lit(rule.confidence).alias("confidence")
        )
        hits.append(F.when(found, cells))
    return lines.select(*lines.columns, F.explode(F.array_compact(F.array(*hits))).alias("h")).select(*lines.columns, "h.*")


def scan_secrets(lines: DataFrame) -> DataFrame:
    """``no-hardcoded-secrets`` in two passes: formats that name themselves (high confidence) and
    literals given to secret-looking names (medium); a line both find is reported once."""
    literal = F.exists(named_literals(F.col("text")), lambda p: p["value"].isNotNull()) & ~is_test_path(F.col("file"))
    confidence = F.when(holds_known_token(F.col("text")), "high").when(literal, "medium")
    hits = lines.withColumn("confidence", confidence).where("confidence IS NOT NULL")
    return hits.select(*lines.columns, F.lit(SECRET_RULE.rule_id).alias("rule_id"), F.lit("critical").alias("severity"), F.lit("security").alias("category"), "confidence")


def with_excerpt(hits: DataFrame) -> DataFrame:
    cited = excerpt(F.col("text"))
    return hits.withColumn("excerpt", cited).withColumn("anchor", content_anchor(cited))


def expand_braces(entries: DataFrame) -> DataFrame:
    """``{a,b}`` stands for each alternative, in any number of places; ``entries`` carries the text
    in ``entry``. The parts of an entry are folded inside its row."""
    rest = [c for c in entries.columns if c != "entry"]
    parts = F.regexp_extract_all("entry", F.lit(r"(?s)(\{[^}]*\}|[^{]+|\{)"), F.lit(1))
    options = F.transform(parts, lambda p: F.when(p.rlike(r"(?s)^\{.*\}\z"), F.split(F.substring(p, F.lit(2), F.length(p) - 2), ",")).otherwise(F.array(p)))
    grown = F.aggregate(options, F.array(F.lit("")), lambda done, next_: F.flatten(F.transform(done, lambda d: F.transform(next_, lambda n: F.concat(d, n)))))
    return entries.select(*rest, F.explode(grown).alias("entry"))


def compile_concepts(table: DataFrame) -> DataFrame:
    """``table``: concept, language, ord, entry. ``*`` is any run; ``Class.x`` is a class-like
    receiver with method ``x``; ``@n`` is the argument the concept is about. Adds the regex, the
    argument and the exact key a callee must hold to meet the entry."""
    rows = expand_braces(table)
    name = F.element_at(F.split("entry", "@"), 1)
    argument = F.coalesce(F.try_element_at(F.split("entry", "@"), F.lit(2)).try_cast("int"), F.lit(0))
    escaped = F.regexp_replace("name", r"([.\\+()\[\]{}^$|?])", r"\\$1")
    method = after(F.col("name"), 6)
    class_like = F.concat(F.lit(r"^(?:.*\.)?(?=[^.]*\p{Ll})\p{Lu}[^.]*\."), F.regexp_replace(method, r"([.\\+()\[\]{}^$|?])", r"\\$1"), F.lit("$"))
    regex = F.when(F.col("name").startswith("Class."), class_like).otherwise(F.concat(F.lit("(?s)^"), F.regexp_replace(escaped, r"\*", ".*"), F.lit("$")))
    last = F.element_at(F.split("name", r"\."), -1)
    first = F.element_at(F.split("name", r"\."), 1)
    key = (
        F.when(~F.col("name").contains("*") & ~F.col("name").startswith("Class."), F.concat(F.lit("e|"), "name"))
        .when(~last.contains("*"), F.concat(F.lit("t|"), last))
        .when(F.col("name").contains(".") & ~first.contains("*"), F.concat(F.lit("h|"), first))
        .otherwise("any")
    )
    compiled = rows.withColumn("name", name).withColumn("argument", argument)
    return compiled.withColumn("regex", regex).withColumn("lookup", key)


def call_concepts(calls: DataFrame, compiled: DataFrame) -> DataFrame:
    """Concept of each call: the lowest entry in table order that names its callee, per concept.

    Calls are reduced to the distinct (language, callee) vocabulary first; exact entries are an
    equi join, and a wildcard meets only callees that share its literal method or receiver. The
    script languages share one table.
    """
    family = F.when(F.col("language").isin(*SCRIPT_FAMILY), SCRIPT_FAMILY[0]).otherwise(F.col("language"))
    words = calls.select("language", "callee").distinct().withColumn("family", family)
    parts = F.split("callee", r"\.")
    asked = F.array(
        F.concat(F.lit("e|"), "callee"), F.concat(F.lit("t|"), F.element_at(parts, -1)), F.concat(F.lit("h|"), F.element_at(parts, 1)), F.lit("any")
    )
    met = words.select("language", "family", "callee", F.explode(asked).alias("lookup")).join(
        compiled.select(family.alias("family"), "lookup", "concept", "ord", "argument", "regex"), ["family", "lookup"]
    )
    hits = met.where(F.expr("callee RLIKE regex")).groupBy("language", "callee", "concept").agg(F.min(F.struct("ord", "argument")).alias("e"))
    return calls.join(hits.select("language", "callee", "concept", F.col("e.argument").alias("argument")), ["language", "callee"])


def calls_in_loops(calls: DataFrame, loops: DataFrame, refs: DataFrame, width: int = 256) -> DataFrame:
    """Calls that read, from inside a loop, a name that loop introduces or its body declares.

    ``calls``: repo, file, function, call_id, start, end. ``refs``: repo, file, call_id, and the
    span (b_start, b_end) of the binding read. ``loops``: repo, file, function, start, end.
    A loop must contain the call and the binding, so it must contain the hull of both. Containment
    is an equi join on position bins; a loop is listed once per bin it covers.
    """
    place = ["repo", "file", "function"]
    hull = calls.join(refs, ["repo", "file", "call_id"]).select(
        *place, "call_id", F.least("start", "b_start").alias("lo"), F.greatest("end", "b_end").alias("hi")
    )
    hull = hull.withColumn("bin", F.floor(F.col("lo") / width))
    spread = loops.select(*place, F.col("start").alias("l_start"), F.col("end").alias("l_end")).distinct()
    spread = spread.withColumn("bin", F.explode(F.sequence(F.floor(F.col("l_start") / width), F.floor(F.col("l_end") / width))))
    inside = hull.alias("h").join(
        spread.alias("l"),
        [F.col(f"h.{c}") == F.col(f"l.{c}") for c in [*place, "bin"]] + [F.col("l_start") <= F.col("lo"), F.col("hi") <= F.col("l_end")],
        "left_semi",
    )
    return inside.select("repo", "file", "call_id").distinct()


def concept_hits(
    called: DataFrame,
    in_loops: DataFrame | None = None,
    flow: DataFrame | None = None,
    rules: Sequence[tuple] = CONCEPT_RULES,
) -> DataFrame:
    """Hits of the concept rules over calls that carry their concept.

    ``called``: repo, file, language, call_id, line, start, concept, argument, built, exposes,
    options, argument_text. ``flow``: repo, file, call_id, argument, certainty of input reaching
    that argument. Certain input keeps the rule's confidence; uncertain input is low and medium.
    """
    by_concept: dict[str, list[Column]] = {}
    for rule, concept, when, confidence, severity, script in rules:
        cells = (F.lit(rule).alias("rule_id"), F.lit(when).alias("when"), F.lit(confidence).alias("confidence"), F.lit(severity).cast("string").alias("severity"), F.lit(script).alias("script"))
        by_concept.setdefault(concept, []).append(F.struct(*cells))
    table = F.create_map(*[c for concept, cells in by_concept.items() for c in (F.lit(concept), F.array(*cells))])
    rows = called.select("*", F.explode(F.try_element_at(table, F.col("concept"))).alias("b")).where(F.col("b.script") | ~F.col("language").isin(*SCRIPT_LANGUAGES))
    if in_loops is None:
        rows = rows.withColumn("looped", F.lit(False))
    else:
        rows = rows.join(in_loops.withColumn("looped", F.lit(True)), ["repo", "file", "call_id"], "left")
    if flow is None:
        rows = rows.withColumn("certainty", F.lit(None).cast("int"))
    else:
        rows = rows.join(flow.select("repo", "file", "call_id", "argument", "certainty"), ["repo", "file", "call_id", "argument"], "left")
    when = F.col("b.when")
    kept = (
        F.when(when == "always", True)
        .when(when == "command-is-built", F.col("built") & F.col("exposes"))
        .when(when == "reads-iteration", F.col("looped"))
        .when(when == "without-keyword", ~F.contains(F.coalesce("argument_text", F.lit("")), F.lit(TIMEOUT_KEYWORD)))
        .when(when == "without-options", F.col("options") <= 1)
        .when(when == "receives-input", F.col("certainty") >= UNCERTAIN)
    )
    unsure = (when == "receives-input") & (F.col("certainty") == UNCERTAIN)
    hits = rows.where(F.coalesce(kept, F.lit(False)) & ~is_test_path(F.col("file"))).select(
        "repo",
        "file",
        "line",
        "start",
        F.col("b.rule_id").alias("rule_id"),
        F.when(unsure, "low").otherwise(F.col("b.confidence")).alias("confidence"),
        F.when(unsure, "medium").otherwise(F.col("b.severity")).alias("severity"),
    )
    return one_per_line(hits)


def swallowed_errors(handlers: DataFrame) -> DataFrame:
    """Empty handlers outside tests: repo, file, line, start."""
    hits = handlers.where(~is_test_path(F.col("file"))).select(
        "repo", "file", "line", "start", F.lit("no-swallowed-error").alias("rule_id"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("severity")
    )
    return one_per_line(hits)


def one_per_line(hits: DataFrame) -> DataFrame:
    """One hit per rule and line, the first in the text."""
    return first_per_key(hits, ["repo", "file", "rule_id", "line"], [F.col("start")])


def build_findings(hits: DataFrame, policy_rules: DataFrame, guidance: DataFrame) -> DataFrame:
    """Hits with their rule and guidance as findings.

    ``policy_rules``: repo, rule_id, statement, category, severity, pack, version. ``guidance``:
    rule_id, why, fix, before, after. Severity: the hit's, else the rule's, else medium.
    """
    rule = policy_rules.select(
        "repo", "rule_id", "statement", F.col("category").alias("rule_category"), F.col("severity").alias("rule_severity"), "pack", F.col("version").alias("pack_version")
    )
    joined = hits.join(rule, ["repo", "rule_id"]).join(guidance.select("rule_id", "why", "fix", "before", "after"), ["rule_id"], "left")
    summary = F.coalesce("fix", F.concat(F.lit('Address "'), "rule_id", F.lit('": '), "statement"))
    return joined.select(
        "repo",
        "file",
        "rule_id",
        "line",
        F.coalesce("rule_category", F.lit("maintainability")).alias("category"),
        F.coalesce(F.col("severity"), F.col("rule_severity"), F.lit("medium")).alias("severity"),
        "confidence",
        first_sentence(F.col("statement")).alias("title"),
        F.coalesce("why", F.concat(F.lit('Rule "'), "rule_id", F.lit('": '), "statement")).alias("explanation"),
        F.struct(summary.alias("summary"), F.struct("before", "after").alias("example")).alias("recommendation"),
        "pack",
        "pack_version",
    )


Detector = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
DETECTORS: dict[str, Detector] = {}
PARTIAL: dict[str, str] = {}


def register(group: str, detector: Detector, partial: str | None = None) -> None:
    """Extension point: ``(lines, facts) -> hits``; ``partial`` says what the detector leaves out."""
    DETECTORS[group] = detector
    if partial:
        PARTIAL[group] = partial


def run(lines: DataFrame, facts: dict[str, DataFrame], policy_rules: DataFrame) -> DataFrame:
    """Every registered detector's hits on rules the policy holds."""
    hits = None
    for detector in DETECTORS.values():
        part = detector(lines, facts)
        hits = part if hits is None else hits.unionByName(part, allowMissingColumns=True)
    if hits is None:
        raise ValueError("no detector is registered")
    return hits.join(policy_rules.select("repo", "rule_id").distinct(), ["repo", "rule_id"], "left_semi")


def visibility(language: Column, name: Column, modifiers: Column, member: Column) -> Column:
    """Who can see a declaration, from its name or its modifiers, per language."""
    words = F.split(modifiers, r"\s+")
    has = lambda *w: F.arrays_overlap(words, F.array(*[F.lit(x) for x in w]))

    def by_words(public=(), private=(), module=(), default="public", member_default=None):
        chain = F.lit(default) if member_default is None else F.when(member, member_default).otherwise(default)
        for group, level in ((module, "module"), (private, "private"), (public, "public")):
            if group:
                chain = F.when(has(*group), level).otherwise(chain)
        return chain

    lead = name.startswith("_")
    return (
        F.when(language == "go", F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("package"))
        .when(language == "python", F.when(lead, "module").otherwise("public"))
        .when(language == "dart", F.when(lead, "package").otherwise("public"))
        .when(language == "java", by_words(("public",), ("private",), ("protected",), "package"))
        .when(language == "kotlin", by_words((), ("private",), ("internal", "protected")))
        .when(language == "csharp", by_words(("public",), ("private",), ("internal", "protected"), "module", "private"))
        .when(language == "php", by_words((), ("private",), ("protected",)))
        .when(language == "elixir", by_words((), ("defp", "defmacrop", "defguardp")))
        .when(language == "swift", by_words(("public", "open"), ("private", "fileprivate"), ("internal", "package"), "module"))
        .otherwise("public")
    )


def language_of(path: Column) -> Column:
    """Language by extension."""
    table = {
        "javascript": ("js", "mjs", "cjs"), "jsx": ("jsx",), "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "vue": ("vue",), "svelte": ("svelte",),
        "astro": ("astro",), "dart": ("dart",), "rust": ("rs",), "go": ("go",), "python": ("py", "pyi"), "kotlin": ("kt", "kts"), "php": ("php",),
        "csharp": ("cs",), "java": ("java",), "ruby": ("rb",), "elixir": ("ex", "exs"), "swift": ("swift",), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "gdscript": ("gd",),
    }
    named = F.create_map(*[F.lit(x) for language, extensions in table.items() for e in extensions for x in (e, language)])
    return F.try_element_at(named, extension(path))
