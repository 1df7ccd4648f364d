"""Rule scan, directives, environment names, context, coverage, model pass and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from findlake.functions import directives, secrets, text
from findlake.operators import accept, context, coverage, envdocs, lifecycle, quality, rules, semantic, trends
from findlake.schemas import FLAT_FINDING, LEDGER
from findlake.session import checkpoint_root
from findlake.streaming.jobs import LEDGER_KEYS, ledger_batch, lifecycle_batch
from findlake.streaming.state import StateTable


def table(spark, schema, items):
    return spark.createDataFrame(items, schema)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


LINE = "repo string, file string, line int, text string"


def test_directive_parsing(spark):
    lines = [
        " findlake-ignore no-eval -- sandboxed", " findlake-ignore-next-line a, b:c — because -- really */ ", " findlake-ignore-file", " findlake-ignore * -- x", " findlake-ignored no", "see findlake-ignore-next-line no-var",
    ]
    out = directives.parse_directives(table(spark, LINE, [("r", "f", i, t) for i, t in enumerate(lines)]))
    got = {r["line"]: (r["scope"], r["rule_ids"], r["reason"]) for r in out.collect()}
    assert got == {
        0: ("line", ["no-eval"], "sandboxed"), 1: ("next-line", ["a", "b", "c"], "because -- really"), 2: ("file", None, None), 3: ("line", None, "x"), 5: ("next-line", ["no-var"], None),
    }


def test_directives_cover_in_file_order(spark):
    found = table(spark, FLAT_FINDING, [("r", "f", rule, "c", "low", line, "1", i, "t") for i, (rule, line) in enumerate([("a", 2), ("b", 2), ("a", 9), (None, 9), ("z", 3)])])
    given = table(spark, "repo string, file string, scope string, line int, rule_ids array<string>, reason string", [("r", "f", "next-line", 1, ["a"], "one"), ("r", "f", "file", 5, ["a"], "two"), ("r", "f", "line", 3, None, "three")])
    got = [(r["covered"], r["directive_reason"]) for r in accept.apply_directives(found, given).orderBy("ord").collect()]
    assert got == [(True, "one"), (False, None), (True, "two"), (False, None), (True, "three")]


def test_suppression_comment_by_language(spark):
    make = lambda f: one(spark, directives.suppression_comment(F.lit(f), F.lit("r"), F.lit("why")))
    assert make("a.py").startswith("# ") and make("a.VUE").endswith(" -->") and make("a.ts").startswith("// ")


def test_changed_lines(spark):
    found = table(spark, FLAT_FINDING, [("r", f, "x", "c", "low", n, "1", i, "t") for i, (f, n) in enumerate([("a", 1), ("a", 2), ("a", None), ("b", 7), ("c", 1)])])
    changed = table(spark, "repo string, file string, line int", [("r", "a", 2)])
    files = table(spark, "repo string, file string, untracked boolean", [("r", "a", False), ("r", "b", True)])
    assert sorted(r["ord"] for r in accept.on_changed_lines(found, changed, files).collect()) == [1, 2, 3]
    assert sorted(r["ord"] for r in accept.leave_out_ignored(found, ["a"]).collect()) == [3, 4]


def test_gate_overrides_first_match(spark):
    found = table(spark, FLAT_FINDING + ", counted boolean", [("r", "legacy/a.ts", "x", "c", "high", 1, "1", 1, "t", True), ("s", "src/a.ts", "x", "c", "medium", 1, "1", 2, "t", True), ("t", "src/a.ts", "x", "c", "critical", 1, "1", 3, "t", False), ("u", "src/b.ts", "x", "c", "low", 1, "1", 4, "t", True)])
    got = dict(accept.fail_gate(found, "medium", [(["legacy"], "none"), (["**/*.ts"], "medium")]).select("repo", "failed").collect())
    assert got == {"r": False, "s": True, "t": False, "u": False}


def test_line_rules(spark):
    lines = table(spark, LINE, [("r", "a.ts", 1, "ghp_" + "a" * 36), ("r", "b_test.go", 2, "panic!"), ("r", "c.rs", 3, "panic! // ok"), ("r", "d.rs", 4, "x panic!")])
    rule = rules.LineRule("no-panic", r"\bpanic!", "high", only_in=("rs",), unless="// ok")
    got = sorted((r["rule_id"], r["file"], r["severity"]) for r in rules.with_excerpt(rules.scan_lines(lines, [rules.SECRET_RULE, rule])).collect())
    assert got == [("no-hardcoded-secrets", "a.ts", "critical"), ("no-panic", "d.rs", "high")]


def test_secret_judgment(spark):
    keep = 'api_key = "q9X2vB7nL0pZ4tRw"'
    drop = ['password: "changeme123"', "token = 'https://example.org/abcdef'", 'secret = "aaaaaaaaaaaa"', 'password = "Please type it"', 'token="short"', 'secret = "$2b$12$abcdefghijk"', 'name = "q9X2vB7nL0pZ4tRw"', "token = `required|string|x9`"]
    df = table(spark, "i int, t string", list(enumerate([keep, *drop])))
    assert [r["i"] for r in df.where(F.size(secrets.named_literals(F.col("t"))) > 0).collect()] == [0]
    value = "aabbbc"
    want = -sum(p * math.log2(p) for p in (2 / 6, 3 / 6, 1 / 6))
    assert abs(one(spark, text.shannon_entropy(F.lit(value))) - want) < 1e-12


def test_concepts_and_conditions(spark):
    entries = [("data-query", "python", 0, "{db,pool}.query"), ("data-query", "python", 1, "*.objects.get"), ("data-query", "ruby", 0, "Class.where"), ("sql-sink", "python", 0, "run@1"), ("dynamic-eval", "python", 0, "eval"), ("http-no-timeout", "python", 0, "requests.*"), ("dynamic-eval", "javascript", 0, "eval")]
    compiled = rules.compile_concepts(table(spark, "concept string, language string, ord int, entry string", entries))
    schema = "repo string, file string, language string, call_id int, callee string, line int, start int, built boolean, exposes boolean, options int, argument_text string"
    calls = [("python", "pool.query", ""), ("python", "a.b.objects.get", ""), ("ruby", "Order.where", ""), ("ruby", "order.where", ""), ("python", "run", ""), ("python", "eval", ""), ("python", "requests.get", "url, timeout=3"), ("python", "requests.post", "url"), ("javascript", "eval", ""), ("python", "eval", "")]
    df = table(spark, schema, [("r", "f.x", lang, i, callee, 5 if callee == "eval" else i, i, False, False, 0, arg) for i, (lang, callee, arg) in enumerate(calls)])
    called = rules.call_concepts(df, compiled)
    assert sorted((r["call_id"], r["concept"], r["argument"]) for r in called.collect()) == [
        (0, "data-query", 0), (1, "data-query", 0), (2, "data-query", 0), (4, "sql-sink", 1), (5, "dynamic-eval", 0), (6, "http-no-timeout", 0), (7, "http-no-timeout", 0), (8, "dynamic-eval", 0), (9, "dynamic-eval", 0),
    ]
    looped = table(spark, "repo string, file string, call_id int", [("r", "f.x", 1)])
    flow = table(spark, "repo string, file string, call_id int, argument int, certainty int", [("r", "f.x", 4, 1, rules.UNCERTAIN), ("r", "f.x", 4, 0, rules.CERTAIN)])
    hits = rules.concept_hits(called, looped, flow)
    assert sorted((r["rule_id"], r["start"], r["confidence"], r["severity"]) for r in hits.collect()) == [
        ("a03-injection", 4, "low", "medium"), ("n-plus-one-queries", 1, "low", "medium"), ("no-eval", 5, "high", None), ("no-http-without-timeout", 7, "high", None),
    ]
    policy = table(spark, "repo string, rule_id string, statement string, category string, severity string, pack string, version string", [("r", "no-eval", "Never eval. It hurts", None, None, "p", "1.0.0")])
    guide = table(spark, "rule_id string, why string, fix string, before string, after string", [("other", "", "", "", "")])
    built = rules.build_findings(hits, policy, guide).first()
    assert (built["title"], built["severity"], built["category"]) == ("Never eval", "medium", "maintainability")
    assert built["recommendation"]["summary"] == 'Address "no-eval": Never eval. It hurts'


def test_calls_in_loops_against_brute_force(spark):
    loops = [(i % 3, (i * 37) % 900, (i * 37) % 900 + (i * 53) % 400) for i in range(60)]
    calls = [(i % 3, (i * 61) % 1000) for i in range(120)]
    place = "repo string, file string, function int"
    l_df = table(spark, place + ", start int, end int", [("r", "f", fn, a, b) for fn, a, b in loops])
    c_df = table(spark, place + ", call_id int, start int, end int", [("r", "f", fn, i, s, s + 3) for i, (fn, s) in enumerate(calls)])
    refs = table(spark, "repo string, file string, call_id int, b_start int, b_end int", [("r", "f", i, s - i % 50, s - i % 50 + 1) for i, (_, s) in enumerate(calls)])
    want = {i for i, (fn, s) in enumerate(calls) if any(fn == g and a <= min(s, s - i % 50) and max(s + 3, s - i % 50 + 1) <= b for g, a, b in loops)}
    assert {r["call_id"] for r in rules.calls_in_loops(c_df, l_df, refs, width=32).collect()} == want


@pytest.mark.parametrize(("path", "kind"), [(".env.local", "dotenv"), ("a/env.example", "dotenv"), ("x.environment", None), ("build.rs", "build-script"), ("Dockerfile.dev", "dockerfile"), ("docs/A.MD", "markdown"), ("compose.yml", "config"), (".github/workflows/ci.yaml", "config"), ("src/a.ts", None), ("app.env.sample", "dotenv")])
def test_document_kind(spark, path, kind):
    assert one(spark, envdocs.doc_kind(F.lit(path))) == kind


def test_environment_names(spark):
    names = lambda f, body: sorted(set(one(spark, f(F.lit(body)))))
    assert names(envdocs.dotenv_names, "A=1\n # export B_C = x\nnope\n1X=2\nlower=3") == ["A", "B_C", "lower"]
    assert names(envdocs.markdown_names, "Set OUTSIDE and `IN_CODE`.\n~~~sh\nexport X_Y=1 $low\n```\nSTILL_IN\n~~~\nAFTER ``D_D``\n") == ["D_D", "IN_CODE", "STILL_IN", "X_Y", "low"]
    assert names(envdocs.dockerfile_names, 'ARG ONE\nENV TWO="a b=c" \\\n  THREE=3\nENV FOUR value\n# ENV NO=1 $NOPE\nRUN x ${FIVE:-d}') == ["FIVE", "FOUR", "ONE", "THREE", "TWO"]
    assert names(envdocs.config_names, "  - API_KEY # needed\n  DB_URL: x\n  run: y\n  A == B\n  OPT ?= 1\n  url: http://HOST:80\n  v: $LOW_x") == ["API_KEY", "DB_URL", "LOW_x", "OPT"]
    assert names(envdocs.build_script_names, 'println!("cargo:rustc-env=GIT_SHA={}", s); rustc-env=bad') == ["GIT_SHA"]


def test_visibility_by_language(spark):
    see = lambda lang, name, mods="", member=False: one(spark, rules.visibility(F.lit(lang), F.lit(name), F.lit(mods), F.lit(member)))
    assert [see("go", "Run"), see("go", "run"), see("python", "_x"), see("dart", "_x"), see("java", "x"), see("java", "x", "public static")] == ["public", "package", "module", "package", "package", "public"]
    assert [see("csharp", "x", "", True), see("csharp", "x"), see("kotlin", "x", "internal"), see("swift", "x", "open"), see("elixir", "x", "defp"), see("zig", "x")] == ["private", "module", "module", "public", "private", "public"]


def test_verdicts_must_be_grounded(spark):
    view = table(spark, "repo string, file string, line int, n int, text string", [("r", "f", 5, 4, "if  (safe)  {"), ("r", "f", 5, 5, "run(x)")])
    replies = [
        ("real", {"verdict": "Real", "reason": " a   b "}), ("doubt", {"verdict": "false-positive", "proof": "if (safe) {", "reason": "ok"}), ("self", {"verdict": "fp", "proof": "run(x)", "reason": ""}), ("short", {"verdict": "no", "proof": "if"}), ("odd", {"verdict": "maybe"}), ("unsure", {"verdict": "unclear"}),
    ]
    data = [("r", "f", 5, k, f"Sure: {json.dumps(v)} bye") for k, v in replies] + [("r", "f", 5, "none", "no json")]
    out = semantic.verdicts(table(spark, "repo string, file string, line int, k string, reply string", data), view)
    assert {r["k"]: r["verdict"] for r in out.collect()} == {"real": "confirmed", "doubt": "doubtful", "self": "unsure", "short": "unsure", "odd": None, "unsure": "unsure", "none": None}
    assert out.where("k = 'real'").first()["reason"] == "a b"


def test_claims_must_quote_their_line(spark):
    issues = [
        {"line": 2, "quote": "open( path )", "title": "Leaky handle!", "why": "w", "severity": "high", "category": "weird"}, {"line": "2", "quote": "open(path)", "title": "leaky handle", "why": "w"}, {"line": 3, "quote": "open(path)", "title": "t", "why": "w"},
        {"line": 1, "quote": "let a", "title": "known one", "why": "w", "severity": "low"}, {"line": 2, "quote": "open", "title": "", "why": "w"},
    ]
    lines = table(spark, LINE, [("r", "f", 1, "let a = 1"), ("r", "f", 2, "x = open(path)"), ("r", "f", 3, "close()")])
    out = semantic.claims(table(spark, "repo string, file string, reply string", [("r", "f", json.dumps({"issues": issues}))]), lines, table(spark, "repo string, file string, line int", [("r", "f", 1)]))
    got = [(r["status"], r["category"], r["severity"]) for r in out.orderBy("pos").collect()]
    assert got == [("detected", "reliability", "medium"), ("repeated", "reliability", "medium"), ("rejected", "reliability", "medium"), ("known", "reliability", "low"), ("rejected", "reliability", "medium")]
    assert out.where("pos = 0").first()["rule_id"] == "semantic:leaky-handle"


def test_windows_prompts_and_provider(spark):
    lines = table(spark, LINE, [("r", "f", i, f'l{i} = "{"k" * 30}"' if i == 2 else f"l{i}") for i in range(1, 6)])
    view = semantic.windows(table(spark, "repo string, file string, line int", [("r", "f", 1)]), lines, radius=2)
    shown = semantic.render(view, table(spark, "repo string, file string, line int", [("r", "f", 3)])).first()["view"]
    assert shown.split("\n") == [">    1 | l1", '     2 | l2 = "[REDACTED]"'.replace("     2", "     2"), f"     3 | {semantic.WITHHELD}"]

    def provider(system, user):
        if user == "bad":
            raise RuntimeError("down")
        return f"{system}:{user}"

    prompts = table(spark, "repo string, prompt_id string, system string, user string", [("r", "1", "s", "good"), ("r", "2", "s", "bad")])
    assert {r["prompt_id"]: (r["reply"], r["fault"]) for r in semantic.ask(prompts, provider).collect()} == {"1": ("s:good", None), "2": (None, "down")}
    tries = table(spark, "repo string, ord long, failed boolean", [("r", i, f) for i, f in enumerate([True, True, False, True, True, True, False])] + [("s", 0, True)])
    assert sorted((r["repo"], r["ord"]) for r in semantic.before_failures(tries, 3).collect()) == [("r", i) for i in range(6)] + [("s", 0)]


def test_candidates(spark):
    evidence = "array<struct<kind:string>>"
    items = [("r", "a.ts", "x", "low", "medium", 1, [("code",)], 1), ("r", ".env", "x", "critical", "low", 1, [], 2), ("r", "a.ts", "no-hardcoded-secrets", "high", "low", 1, [], 3), ("r", "a.ts", "x", "high", "low", 2, [], 4), ("r", "a.ts", "x", "high", "high", 2, [], 5), ("r", "a.ts", "x", "high", "low", None, [], 6), ("r", "a.ts", "x", "high", "low", 3, [("external-analyzer",)], 7)]
    df = table(spark, f"repo string, file string, rule_id string, severity string, confidence string, line int, evidence {evidence}, ord int", items)
    assert [r["ord"] for r in semantic.candidates(semantic.is_candidate(df), 1).collect()] == [4]


def test_quality_counters(spark):
    cases = table(spark, "case_id int", [(1,), (2,)])
    planted = table(spark, "case_id int, planted_id int, category string, line int", [(1, 1, "a", 10), (1, 2, "b", 50)])
    claims = table(spark, "case_id int, claim_id int, line int", [(1, 1, 12), (1, 2, 13), (2, 3, 10)])
    got = {r["category"]: (r["whole"], r["part"]) for r in quality.detection_scores(planted, claims).collect()}
    assert got == {"a": (1, 1), "b": (1, 0), None: (3, 1)}
    assert quality.clean_file_alarms(cases, planted, claims).first()["alarms"] == 1
    counters = quality.pass_counters(table(spark, "repo string, verdict string", [("r", "confirmed"), ("r", None), ("r", "unsure")]), table(spark, "repo string, status string", [("r", "detected"), ("r", "failed")])).first()
    assert (counters["verified"], counters["failed"], counters["detected"]) == (2, 2, 1)


def test_coverage(spark):
    skipped = table(spark, "reason string, ord int, path string", [("big", i, f"p{i}") for i in range(7)] + [("odd", 0, "q")])
    got = {r["reason"]: (r["files"], r["examples"]) for r in coverage.skips_by_reason(skipped, 5).collect()}
    assert got == {"big": (7, [f"p{i}" for i in range(5)]), "odd": (1, ["q"])}
    policy = table(spark, "repo string, rule_id string, pack string, version string", [("r", "a", "p", "1"), ("r", "b", "p", "1"), ("r", "c", "p", "1")])
    known = table(spark, "rule_id string", [("a",), ("c",)])
    assert coverage.checked_rules(policy, known).first()["rules"] == ["a", "c"]
    gaps = coverage.rule_gaps(policy, known)
    assert [r["rule_id"] for r in gaps.collect()] == ["b"]
    none = table(spark, "repo string, status string", [])
    assert dict(coverage.complete(gaps, skipped.limit(0).select(F.lit("r").alias("repo")), none, table(spark, "repo string", [("r",), ("s",)])).collect()) == {"r": False, "s": True}
    missing = coverage.languages_without_binding(table(spark, "repo string, rule_id string, concept string", [("r", "a", "k")]), table(spark, "concept string, language string", [("k", "go")]), table(spark, "repo string, language string", [("r", "go"), ("r", "php")]))
    assert missing.first()["languages"] == ["php"]


def test_context(spark):
    files = table(spark, "repo string, path string, content string", [
        ("r", "package.json", json.dumps({"dependencies": {"react": "18"}, "devDependencies": {"react": "19"}, "packageManager": "bun@1.0", "engines": {"node": ">=18"}})), ("r", "Cargo.toml", 'rust-version = "1.80"\ntauri = "2"'), ("r", "bun.lock", ""), ("r", "README.md", "# Hello there \n words"),
        ("r", ".eslintrc.json", json.dumps({"rules": {"eqeqeq": "error", "no-var": ["warn", {}]}})), ("r", "biome.json", json.dumps({"linter": {"rules": {"recommended": True, "style": {"noVar": "error"}}}, "formatter": {"enabled": True, "lineWidth": 100}})), ("r", "src/domain/x.ts", ""), ("r", "src/adapters/y.ts", ""), ("r", "packages/a/z.ts", ""), ("q", "notes.txt", ""),
    ])
    signals = context.stack_signals(files)
    profile = {(r["kind"], r["value"]) for r in context.stack_profile(signals).collect()}
    assert profile == {("language", "JavaScript/TypeScript"), ("language", "Rust"), ("framework", "React"), ("framework", "Tauri"), ("build", "Cargo"), ("manager", "Bun"), ("runtime", "Bun"), ("runtime", "Node.js")}
    caps = {r["id"]: r["kind"] for r in context.capabilities(files, signals).collect()}
    assert caps == {"javascript": "language", "Rust": "language", "React": "framework", "Tauri": "framework", "web": "platform", "desktop": "platform", "Cargo": "tooling", "Bun": "tooling", "Node.js": "tooling", "biome": "tooling", "eslint": "tooling", "monorepo": "characteristic", "package-based": "characteristic", "layered": "characteristic"}
    summary = context.capability_summary(context.capabilities(files, signals)).first()["summary"]
    assert summary.startswith("Language: Rust, javascript — Framework: React, Tauri — Platform: ")
    deps = {(r["kind"], r["name"], r["value"]) for r in context.dependency_profile(files).collect()}
    assert deps == {("lockfile", "bun.lock", "present"), ("version", "react", "19"), ("runtime", "node", ">=18"), ("runtime", "packageManager", "bun@1.0"), ("version", "tauri", "2"), ("runtime", "rust", "1.80")}
    documents = context.documentation(files.where("path LIKE '%.md'"))
    assert tuple(documents.select("kind", "title", "words").first()) == ("readme", "Hello there", 4)
    assert context.documentation_summary(documents).first()["summary"] == "1 documentation source found: 1 readme."
    criteria = context.criteria(files)
    assert sorted(r["rule_id"] for r in criteria.collect()) == ["biome:formatter.lineWidth", "biome:linter.recommended", "biome:style.noVar", "eslint:eqeqeq", "eslint:no-var"]
    known = {r["repo"]: (r["open_questions"], r["confidence"]) for r in context.understanding(files, signals, documents, criteria).collect()}
    assert known == {"r": ([], "high"), "q": (["languages", "purpose", "conventions"], "low")}
    kinds = {r["repo"]: r["workspace_type"] for r in context.workspace_types(files, signals).collect()}
    assert kinds == {"r": "single-package", "q": "single-package"}


def test_trend_windows():
    assert trends.parse_window_days("8w") == 56 and trends.parse_window_days("30d") == 30 and trends.parse_window_days("7") == 7
    for bad in ("0d", "x", "-1d", ""):
        with pytest.raises(ValueError, match="window"):
            trends.parse_window_days(bad)


def test_ledger_stream_batches_are_idempotent(spark, tmp_path):
    schema = FLAT_FINDING + ", session string, ts timestamp, session_end boolean"
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d)
    first = table(spark, schema, [("p", "a", "x", "c", "low", 1, "1", 1, "t", "s1", at(1), True), ("p", "b", "x", "c", "low", 1, "1", 2, "t", "s2", at(2), True), ("q", "a", "x", "c", "low", 1, "1", 3, "t", "s1", at(1), True)])
    second = table(spark, schema, [("p", "a", "x", "c", "low", 1, "2", 4, "t", "s3", at(3), True)])
    state = StateTable(str(tmp_path / "ledger"), LEDGER_KEYS, LEDGER)
    handle = ledger_batch(state, str(tmp_path / "report"))
    for _ in range(2):
        handle(first, 0)
    for _ in range(2):
        handle(second, 1)
    got = sorted((r["repo"], r["file"], r["status"], len(r["history"])) for r in state.before(spark, 2).collect())
    assert got == [("p", "a", "reopened", 3), ("p", "b", "resolved", 2), ("q", "a", "open", 1)]


def test_ledger_stream_waits_for_the_end_of_a_session(spark, tmp_path):
    import datetime as dt

    schema = FLAT_FINDING + ", session string, ts timestamp, session_end boolean"
    at = lambda d: dt.datetime(2024, 1, d)
    row = lambda file, n, session, day, end=False: ("p", file, "x", "c", "low", 1, "1", n, "t", session, at(day), end)
    state = StateTable(str(tmp_path / "ledger"), LEDGER_KEYS, LEDGER)
    handle = ledger_batch(state)
    close = lambda session, day: ("p", None, None, None, None, None, None, None, None, session, at(day), True)
    batches = [[row("a", 1, "s2", 2)], [row("b", 2, "s2", 2), row("c", 3, "s3", 3, True)], [close("s2", 2)], [row("z", 4, "s1", 1, True)]]
    seen = []
    for k, rows in enumerate(batches):
        for _ in range(2):
            handle(table(spark, schema, rows), k)
        seen.append(sorted((r["file"], r["status"]) for r in state.before(spark, k + 1).collect()))
    # nothing before s2 closes; s3 waits for it; s1 comes too late
    assert seen == [[], [], [("a", "resolved"), ("b", "resolved"), ("c", "open")], [("a", "resolved"), ("b", "resolved"), ("c", "open")]]


def test_lifecycle_stream_continues(spark, tmp_path):
    state = StateTable(str(tmp_path / "memory"), ["item"], "item string, status string, accepted long, rejected long")
    handle = lifecycle_batch(state, lifecycle.MEMORY, "ord", "state", str(tmp_path / "rejected"))
    schema = "item string, ord long, state string"
    handle(table(spark, schema, [("m", 1, "suggested"), ("m", 2, "active"), ("n", 3, "archived")]), 0)
    handle(table(spark, schema, []), 1)
    for _ in range(2):
        handle(table(spark, schema, [("m", 4, "confirmed"), ("m", 5, "active"), ("n", 6, "active")]), 2)
    got = {r["item"]: (r["status"], r["accepted"], r["rejected"]) for r in state.before(spark, 3).collect()}
    assert got == {"m": ("active", 3, 1), "n": ("archived", 1, 1)}
    actions, removed = lifecycle.memory_requests(table(spark, "repo string, item_id string, action string", [("r", "1", "reject"), ("r", "2", "remove"), ("r", "3", "fly")]))
    assert [r["target"] for r in actions.collect()] == ["archived"] and [r["item_id"] for r in removed.collect()] == ["2"]


class _Cluster:
    """A session whose cluster names a shared folder, and one that names none."""

    def __init__(self, named):
        self.conf = self
        self.sparkContext = self
        self.master = "yarn"
        self.named = named

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None


def test_checkpoint_folder_comes_from_the_session():
    assert checkpoint_root(_Cluster("s3://shared/x/")) == "s3://shared/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(_Cluster(None))


def test_brace_groups_and_long_names(spark):
    table_ = table(spark, "concept string, language string, ord long, entry string", [("k", "go", 1, "{a,b}{c,d}{e,f}{g,h}{i,j}{k,l}"), ("m", "go", 2, "Class." + "x" * 1500), ("o", "go", 3, "open{")])
    compiled = rules.compile_concepts(table_)
    names = {r["name"] for r in compiled.collect()}
    assert {"acegik", "bdfhjl"} <= names and sum(len(n) == 6 for n in names) == 64 and "open{" in names
    assert compiled.where(f"regex LIKE '%{'x' * 1500}$'").count() == 1


def test_export_targets_to_any_depth(spark):
    from findlake.operators import surface

    deep = '{"exports":{".":' + '{"node":' * 6 + '["./a.js",{"import":"./b.js"}]' + "}" * 6 + "}}"
    got = surface.manifest_targets(table(spark, "repo string, module string, content string", [("r", "m", deep)])).orderBy("rank").collect()
    assert [r["target"] for r in got] == ["./a.js", "./b.js"]


def test_language_is_looked_up_once_per_path(spark):
    wanted = {"a/b.TS": "typescript", "x.d.mts": "typescript", ".ts": "typescript", "a.ts/": None, "a.ts/b": None, "a.": None, "": None, "b.hxx": "cpp", "c.gd": "gdscript", "q.exs": "elixir", "v.vue": "vue", "n.none": None, None: None}
    found = spark.createDataFrame([(p,) for p in wanted], "path string").select("path", rules.language_of(F.col("path")).alias("language"))
    assert {r.path: r.language for r in found.collect()} == wanted
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
