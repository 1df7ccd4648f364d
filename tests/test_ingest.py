"""Diffs, analyzer reports, stores, files and report sinks."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from findlake.functions import globs, identity, paths, text
from findlake.schemas import FINDING, FLAT_FINDING, affected_files, flatten_findings, split_well_formed
from findlake.sinks import reports, tables
from findlake.sources import analyzers, diff, files as source_files, stores


def parse(spark, body):
    return diff.parse(spark.createDataFrame([("d", body)], "id string, diff string"), ["id"])


def test_diff_keeps_header_lookalikes_inside_a_hunk(spark, rows):
    body = "diff --git a/x.sql b/x.sql\n--- a/x.sql\n+++ b/x.sql\n@@ -1,3 +1,3 @@\n keep\n--- gone\n+++ fresh\n@@ -9,1 +9,1 @@\n@@ -20 +20,2 @@\n same\n+tail\n"
    out = parse(spark, body)
    assert rows(out.added, "line", "text") == [(2, "++ fresh"), (21, "tail")]
    assert rows(out.removed, "before") == [(2,)]
    assert rows(out.files, "path", "kind", "added_lines", "removed_lines") == [("x.sql", "modified", 2, 1)]


def test_diff_kinds_paths_and_quotes(spark, rows):
    body = (
        "diff --git a/old name.ts b/new name.ts\nsimilarity index 90%\nrename from old name.ts\nrename to new name.ts\n"
        'diff --git "a/caf\\303\\251.txt" "b/caf\\303\\251.txt"\nnew file mode 100644\n--- /dev/null\n+++ "b/caf\\303\\251.txt"\n@@ -0,0 +1 @@\n+hi\r\n'
        "diff --git a/gone.py b/gone.py\ndeleted file mode 100644\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
        "diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n"
    )
    out = parse(spark, body)
    assert rows(out.files, "path", "old_path", "kind", "binary") == [
        ("café.txt", None, "added", False), ("gone.py", None, "deleted", False), ("i.png", None, "modified", True), ("new name.ts", "old name.ts", "renamed", False),
    ]
    assert rows(out.added, "text") == [("hi",)]


def test_plain_diff_without_git_headers(spark, rows):
    body = "--- a.c\t2024-01-01\n+++ a.c\t2024-01-02\n@@ -1,2 +1,2 @@\n-a\n+b\n c\n--- b.c\t2024\n+++ b.c\t2024\n@@ -1 +1 @@\n-q\n+r\n\\ No newline at end of file\n"
    out = parse(spark, body)
    assert rows(out.files, "path", "added_lines") == [("a.c", 1), ("b.c", 1)]
    assert rows(diff.touched_lines(out, ["id"]), "file", "line") == [("a.c", 1), ("b.c", 1)]


def plainly(lines):
    """A diff read line by line: added (file, line, text), removed (file, before), lines added of each file."""
    shape = re.compile(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
    added, removed, counts = [], [], {}
    number, header, olds, news, line = 0, False, 0, 0, 0
    for raw in lines:
        text, mark = raw.removesuffix("\r"), raw[:1]
        if olds > 0 or news > 0:
            if mark == "+":
                added.append((number, line, text[1:]))
                counts[number] += 1
            if mark == "-":
                removed.append((number, max(line, 1)))
            olds -= mark not in ("+", "\\")
            news -= mark not in ("-", "\\")
            line += mark not in ("-", "\\")
            continue
        head = shape.match(text)
        if head:
            number = number or 1
            counts.setdefault(number, 0)
            olds, line, news = int(head[1] or 1), int(head[2]), int(head[3] or 1)
            header = False
        elif text.startswith("@@@"):
            header = False
        elif text.startswith("diff --git ") or text.startswith("--- "):
            number += text.startswith("diff") or not header
            header = True
            counts.setdefault(number, 0)
    return sorted(added), sorted(removed), counts


def test_a_diff_cut_anywhere_reads_as_line_by_line(spark, rows):
    """Chunks of three positions and blocks of two hunks; counts that overstate, understate or never end."""
    chance = random.Random(5)
    pieces = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +1,3 @@", "@@ -4 +9 @@", "@@ -0,0 +1,4 @@", "@@ -7,3 +7,0 @@", "@@@ -1 -1 +1 @@@"]
    pieces += ["+new", "-old", " same", "\\ No newline", "+crlf\r", "", "+@@ -1 +1 @@", "@@ -1,90 +1,90 @@"]
    bodies = {f"d{k}": [chance.choice(pieces[: 15 + (k % 9 == 0)]) for _ in range(chance.randint(1, 60))] for k in range(60)}
    bodies["hot"] = ["--- a/h", "+++ b/h"] + ["@@ -1,2 +1,2 @@", "-a", "+b", " c"] * 300 + ["@@ -1,2 +1,2 @@"] * 50
    table = spark.createDataFrame([(k, 7 * i, raw) for k, body in bodies.items() for i, raw in enumerate(body)], "id string, pos bigint, raw string")
    out = diff.parse_lines(table, ["id"], width=21, block=2)
    expected = {k: plainly(body) for k, body in bodies.items()}
    assert rows(out.added, "id", "file_no", "line", "text") == sorted(((k, *a) for k, e in expected.items() for a in e[0]), key=repr)
    assert rows(out.removed, "id", "file_no", "before") == sorted(((k, *a) for k, e in expected.items() for a in e[1]), key=repr)
    whole = diff.parse_lines(table, ["id"])
    assert rows(out.files, *out.files.columns) == rows(whole.files, *whole.files.columns)


def test_one_diff_is_read_by_many_tasks(spark):
    table = spark.range(20000).selectExpr("'d' AS id", "id AS pos", "CASE WHEN id = 0 THEN '@@ -0,0 +1,19999 @@' ELSE '+x' END AS raw")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        added = diff.parse_lines(table, ["id"], width=100).added
        tasks = added.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in tasks) == 19999
    assert max(r["count"] for r in tasks) < 19999 / 2


def reports_of(spark, items):
    return spark.createDataFrame([("r", t, "/repo", c) for t, c in items], "repo string, tool string, root string, content string")


SARIF = json.dumps({"runs": [{"tool": {"driver": {"rules": [{"id": "k", "helpUri": "https://h", "properties": {"security-severity": "9.1"}}]}}, "results": [
    {"ruleId": "k", "level": "note", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "file:///repo/a%2Bb%20c.ts"}, "region": {"startLine": 3}}}]},
    {"ruleId": "z", "level": "error", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "../x.ts"}}}]},
    {"ruleId": "z", "level": "error", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "y+.ts"}}}]}]}]})


def test_sarif_scores_levels_and_paths(spark, rows):
    found, runs = analyzers.read_reports(reports_of(spark, [("osv-scanner", "log\n" + SARIF), ("gitleaks", SARIF), ("ktlint", "no json"), ("detekt", SARIF)]))
    assert rows(found.where("tool = 'osv-scanner'"), "rule_id", "severity", "category", "file", "line") == [("k", "critical", "security", "a+b c.ts", 3), ("z", "medium", "security", "y+.ts", None)]
    assert rows(found.where("tool = 'gitleaks'"), "rule_id", "severity", "sensitive") == [("k", "critical", True), ("z", "critical", True)]
    assert rows(runs, "tool", "status", "findings") == [("detekt", "ran", 2), ("gitleaks", "ran", 2), ("ktlint", "failed", 0), ("osv-scanner", "ran", 2)]


def test_json_reports(spark, rows):
    eslint = json.dumps([{"filePath": "/repo/a.js", "messages": [{"ruleId": "no-eval", "severity": 2, "message": "bad", "line": 1}, {"ruleId": None, "severity": 1, "message": "parse", "line": 2}]}])
    biome = json.dumps({"summary": {}, "diagnostics": [{"severity": "error", "message": "m", "category": "lint/suspicious/noExplicitAny", "location": {"path": {"file": "b.ts"}, "start": {"line": 4, "column": 1}}}, {"severity": "information", "category": "format", "location": {"path": "c.ts"}}]})
    ruff = json.dumps([{"code": None, "message": "syntax", "filename": "/repo/p.py", "location": {"row": 1, "column": 1}}, {"code": "S101", "message": "assert", "filename": "/other/p.py"}])
    clippy = "\n".join([
        json.dumps({"reason": "build", "message": None}),
        json.dumps({"reason": "compiler-message", "message": {"message": "u", "level": "error", "code": {"code": "clippy::unwrap_used"}, "spans": [{"file_name": "src/a.rs", "is_primary": False, "line_start": 1}, {"file_name": "src/b.rs", "is_primary": True, "line_start": 7}], "children": [{"message": "see `https://rust-lang.github.io/x#unwrap`"}]}}),
        "garbage",
    ])
    stan = json.dumps({"totals": {}, "files": {"/repo/a.php": {"errors": 1, "messages": [{"message": "x", "line": 0, "identifier": "a.b"}]}}, "errors": []})
    crash = json.dumps({"tool": "phpstan", "result": "failed", "errors": 1, "general_errors": ["out of memory\nmore"]})
    found, runs = analyzers.read_reports(reports_of(spark, [("eslint", eslint), ("biome", biome), ("ruff", ruff), ("clippy", clippy), ("phpstan", stan)]))
    assert rows(found, "tool", "rule_id", "severity", "category", "file", "line") == sorted([
        ("eslint", "no-eval", "medium", "security", "a.js", 1), ("eslint", "parse-error", "low", "maintainability", "a.js", 2),
        ("biome", "lint/suspicious/noExplicitAny", "medium", "reliability", "b.ts", 4), ("biome", "format", "informational", "maintainability", "c.ts", None),
        ("ruff", "syntax-error", "medium", "reliability", "p.py", 1), ("clippy", "clippy::unwrap_used", "high", "reliability", "src/b.rs", 7),
        ("phpstan", "a.b", "medium", "reliability", "a.php", None)], key=repr)
    urls = dict(found.select("rule_id", "url").collect())
    assert urls["lint/suspicious/noExplicitAny"] == "https://biomejs.dev/linter/rules/no-explicit-any"
    assert urls["clippy::unwrap_used"] == "https://rust-lang.github.io/x#unwrap"
    _, failed = analyzers.read_reports(reports_of(spark, [("phpstan", crash)]))
    assert rows(failed, "status", "reason", "findings") == [("failed", "PHPStan could not finish: out of memory", 0)]


def test_inventory_gates(spark):
    files = spark.createDataFrame([("r", "a.py"), ("r", "biome.json"), ("r", "Cargo.toml"), ("r", "x/yarn.lock")], "repo string, path string")
    have = spark.createDataFrame([("r", t, "1") for t in ("ruff", "biome", "clippy", "osv-scanner")], "repo string, tool string, version string")
    options = spark.createDataFrame([("r", "auto", ["biome"], ["clippy"])], "repo string, mode string, disable array<string>, enable array<string>")
    reasons = {r["tool"]: r["reason"] for r in analyzers.inventory(files, have, options).collect()}
    assert reasons["ruff"] is None and reasons["clippy"] is None
    assert reasons["biome"].startswith("disabled") and reasons["eslint"].startswith("this repository") and reasons["gitleaks"] == "not installed"
    assert reasons["osv-scanner"] == 'it sends package names and versions to a service; enable "osv-scanner" explicitly'


def test_excerpt_redaction_and_units(spark):
    star = "\U0001F600"
    key = "AKIA" + "ABCDEFGH12345678"
    cases = ["  x" + " " * 2, "é" + key, f"a {key} b", star * 150, "y" * 199 + star, '"' + "a" * 24 + '"', "'" + "a" * 23 + "'"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(text.excerpt(F.col("t"))).collect()]
    assert got[:3] == ["x", "é[redacted]", "a [redacted] b"]
    assert got[3] == star * 100 and got[4] == "y" * 199 + "�"
    scrubbed = [r[0] for r in df.orderBy("i").select(text.scrub_quoted(F.col("t"))).collect()]
    assert scrubbed[5:] == ['"[REDACTED]"', "'" + "a" * 23 + "'"]
    assert df.where("i = 3").select(text.units(F.col("t"))).first()[0] == 300


def test_paths(spark):
    raw = ["src/./a.ts", "/repo/b.ts", "/repository/b.ts", "file://localhost/repo/c%20d.ts", "file:/repo/%zz", "a/../b", "", "/repo"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, p string")
    got = [r[0] for r in df.orderBy("i").select(paths.to_repository_path(F.col("p"), F.lit("/repo/"))).collect()]
    assert got == ["src/a.ts", "b.ts", None, "c d.ts", None, None, None, None]


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("packages/legacy", "packages/legacy/a/b.ts", True), ("packages/*/dist", "packages/api/dist/x.js", True), ("*.gen.ts", "a/b/x.gen.ts", True),
        ("**/x.ts", "x.ts", True), ("a/**/b", "a/b", True), ("a?c", "z/abc/q", True), ("a/*", "b/a/c", False), ("src", "mysrc/a", False), ("./a/b", "a/b", True),
    ],
)
def test_config_globs(spark, glob, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(globs.glob_regex(glob))).first()[0] is hit


def test_nested_findings_flatten(spark, rows):
    location = [("a.ts", (3, 4), None), ("b.ts", None, None), ("a.ts", None, None)]
    blank = dict.fromkeys(["kind", "file", "excerpt", "pack", "rule_id", "tool", "version", "license", "url", "role", "provider", "model", "verdict", "reason", "topic"])
    evidence = [blank | {"kind": "code", "excerpt": "let x"}, blank | {"kind": "external-analyzer", "tool": "eslint", "rule_id": "no-var"}, blank | {"kind": "criteria", "rule_id": "later"}]
    df = spark.createDataFrame([("r", "1", "t", "e", "low", "high", "c", location, evidence, [], 1), ("r", "2", "t", "e", "low", "high", "c", [], evidence, [], 2)], FINDING)
    good, bad = split_well_formed(df)
    assert rows(bad, "id", "fault") == [("2", "no location")]
    flat = flatten_findings(good).first()
    assert (flat["file"], flat["rule_id"], flat["line"]) == ("a.ts", "eslint:no-var", 3) and len(flat["anchor"]) == 16
    assert affected_files(good).first()["files"] == ["a.ts", "b.ts"]


def test_stores_fail_closed(spark, rows):
    good = json.dumps({"schemaVersion": 1, "createdAt": "x", "entries": [{"key": "k", "file": "f", "ruleId": "r", "title": "t", "count": 2}]})
    docs = spark.createDataFrame([("r", good)], "repo string, content string")
    assert rows(stores.baseline_documents(docs), "repo", "key", "count") == [("r", "k", 2)]
    for broken in (good.replace('"schemaVersion": 1', '"schemaVersion": 2'), good.replace('"createdAt"', '"madeAt"'), "[1]"):
        with pytest.raises(Exception, match="baseline"):
            stores.baseline_documents(spark.createDataFrame([("r", broken)], "repo string, content string")).collect()


def test_packs_manifest_and_tree(spark, rows, tmp_path):
    (tmp_path / "packs").mkdir()
    (tmp_path / "packs" / "a.toml").write_text('id = "x/a"\nversion = "1.0.0"\nkind = "language"\n[[rules]]\nid = "r1"\nstatement = "Do it. Now"\ncategory = "c"\ndefaultSeverity = "high"\nappliesTo = { type = "requires-language", language = "rust" }\n')
    (tmp_path / "packs" / "b.json").write_text(json.dumps({"id": "x/b", "version": "2.0.0", "rules": [{"id": "r2", "statement": "s", "category": "c", "contradicts": ["r1"]}], "dependsOn": [{"type": "pack", "packId": "x/a", "versionRange": "^1.0.0"}]}))
    packs = stores.read_packs(spark, str(tmp_path / "packs" / "*"))
    assert rows(stores.pack_rules(packs), "pack", "rule_id", "scope", "wanted") == [("x/a", "r1", "language", "rust"), ("x/b", "r2", "always", None)]
    assert rows(stores.pack_dependencies(packs), "pack", "dep_pack", "range") == [("x/b", "x/a", "^1.0.0")]
    (tmp_path / "m.json").write_text(json.dumps({"comment": "", "generated": "", "repositories": [{"name": "n", "url": "u", "commit": "c", "license": "MIT", "origin": "o", "languagesKB": {"go": 3}}]}))
    assert stores.read_manifest(spark, str(tmp_path / "m.json")).first()["languagesKB"] == {"go": 3}
    tree = tmp_path / "tree"
    for name, data in (("one/src/a.ts", b"x"), ("one/node_modules/b.ts", b"x"), ("two/c.go", b"\xff\xfe"), ("two/big.py", b"x" * 50)):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(data)
    listed = source_files.listing(source_files.read_tree(spark, str(tree)))
    assert rows(listed, "repo", "path", "size") == [("one", "src/a.ts", 1), ("two", "big.py", 50), ("two", "c.go", 2)]
    good, skipped = source_files.gate(listed, limit=40)
    assert rows(good, "path", "content", "large") == [("big.py", "x" * 50, True), ("src/a.ts", "x", False)]
    assert rows(skipped, "path", "reason") == [("c.go", "not-utf8")]


def test_report_documents_are_valid(spark, tmp_path):
    data = [("r", "a|b.ts", "x", "c", s, n if n else None, "1", n, f"t{n}") for n, s in enumerate(["low", "critical", "low", "high"] * 12)]
    df = spark.createDataFrame(data, FLAT_FINDING)
    for name, build in (("sarif", reports.sarif_report), ("gitlab", reports.gitlab_report)):
        out = str(tmp_path / name)
        reports.write_lines(build(df), out, partitions=3)
        parts = sorted((tmp_path / name / "repo=r").glob("part-*"))
        document = json.loads("".join(p.read_text() for p in parts))
        results = document["runs"][0]["results"] if name == "sarif" else document
        assert len(results) == 48
    assert reports.markdown_report(df).count() == 7 + 48
    page = reports.markdown_report(df, rows=40).orderBy("section", "ord").collect()
    assert page[3]["text"] == "**48 findings**: 12 critical, 12 high, 24 low" and page[-1]["text"] == "…and 8 more."
    assert page[7]["text"] == "| critical | `a\\|b.ts:1` | t1 | x |"
    assert reports.text_report(df).count() == 49
    note = spark.createDataFrame([("r", "a:b,c", "x", "c", "high", 2, "1", 1, "50%\nt")], FLAT_FINDING)
    assert reports.github_annotations(note).first()["text"] == "::error file=a%3Ab%2Cc,line=2,endLine=2,title=50%25%0At (x)::50%25%0At"


def test_table_save_replaces_only_its_repositories(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save(spark.createDataFrame([("a", 1), ("b", 2)], "repo string, v int"), path)
    tables.save(spark.createDataFrame([("b", 3)], "repo string, v int"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("repo", "v").collect()) == [("a", 1), ("b", 3)]


def test_gitlab_fingerprint(spark):
    import hashlib

    got = spark.range(1).select(identity.gitlab_fingerprint(F.lit("r"), F.lit("f"), F.lit(None).cast("int"), F.lit("t"))).first()[0]
    assert got == hashlib.sha256(b"r\0f\0\0t").hexdigest()[:32]
