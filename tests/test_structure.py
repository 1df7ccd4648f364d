"""Modules, imports, ownership, surface, graph, policy and impact on hand-made repositories."""

import pytest
from pyspark.sql import functions as F

from findlake.functions import semver
from findlake.operators import graph, impact, layers, modules, ownership, policy, resolve, surface
from findlake.plans import all_queries


def table(spark, schema, items):
    return spark.createDataFrame(items, schema)


def files_of(spark, *paths):
    return table(spark, "repo string, path string", [("r", p) for p in paths])


def imports_of(spark, *items):
    return table(spark, "repo string, file string, line int, specifier string, scope string", [("r", f, i, s, scope) for i, (f, s, scope) in enumerate(items)])


def outcomes(df):
    return {r["specifier"]: (r["outcome"], r["target"]) for r in df.collect()}


def test_boundaries_by_stage(spark, rows):
    files = table(spark, "repo string, path string", [
        ("mono", "packages/a/x.ts"), ("mono", "apps/w/y.ts"), ("mono", "src/z/q.ts"), ("flat", "src/adapters/a.ts"), ("flat", "src/.hidden/b.ts"), ("flat", "src/billing/c.ts"),
        ("go", "internal/db/a.go"), ("go", "cmd/x.go"), ("go", "main.go"),
    ])
    manifests = table(spark, "repo string, dir string, ecosystem string, name string, member boolean", [("go", "", "go", "ex/go", False), ("mono", "packages/a", "npm", "@m/a", False)])
    found = modules.infer_boundaries(files, manifests, {"go": ["internal", ""]})
    assert rows(found, "repo", "module", "kind", "name") == [
        ("flat", "src/adapters", "adapter", None), ("flat", "src/billing", "domain", None), ("go", ".", "package", "ex/go"), ("go", "cmd", "domain", None),
        ("go", "internal/db", "domain", None), ("mono", "apps/w", "workspace", None), ("mono", "packages/a", "package", "@m/a"),
    ]


def test_module_files_and_longest_prefix(spark, rows):
    files = files_of(spark, "a/x.ts", "a/b/y.ts", "top.ts", "src/m.rs", "c/k.go", "c/d/k.go")
    mods = table(spark, "repo string, module string, manifest string", [("r", ".", "none"), ("r", "a", "npm"), ("r", "a/b", "npm"), ("r", "src/m", "none"), ("r", "c", "go"), ("r", "c/d", "go")])
    assert rows(modules.boundary_of(files, mods), "path", "module") == [
        ("a/b/y.ts", "a/b"), ("a/x.ts", "a"), ("c/d/k.go", "c/d"), ("c/k.go", "c"), ("src/m.rs", "src/m"), ("top.ts", "."),
    ]
    assert rows(modules.module_files(files, mods), "module", "path") == [
        (".", "top.ts"), ("a", "a/b/y.ts"), ("a", "a/x.ts"), ("a/b", "a/b/y.ts"), ("c", "c/k.go"), ("c/d", "c/d/k.go"), ("src/m", "src/m.rs"),
    ]


def test_script_imports(spark):
    files = files_of(spark, "src/a.ts", "src/b.tsx", "src/c/index.ts", "src/d.js", "src/d.ts", "lib/e/main.ts", "packages/u/package.json")
    imports = imports_of(
        spark, ("src/x.ts", "./a", None), ("src/x.ts", "./b.jsx", None), ("src/x.ts", "./c", None), ("src/x.ts", "./d.js?raw", None), ("src/x.ts", "../lib/e", None), ("src/x.ts", "./gone", None),
        ("src/x.ts", None, None), ("src/x.ts", "@u/core/deep", None), ("src/x.ts", "react", None), ("src/x.ts", "#app/x", None), ("src/x.ts", "@app/a", "."), ("src/x.ts", "@app/none", "."), ("src/x.ts", "..", None),
    )
    packages = table(spark, "repo string, name string, module string", [("r", "@u/core", "packages/u"), ("r", "@u", "packages/root")])
    aliases = table(spark, "repo string, scope string, ord int, pattern string, target_ord int, target string", [("r", ".", 0, "@app/*", 0, "missing/*"), ("r", ".", 0, "@app/*", 1, "./src/*"), ("r", ".", 1, "*", 0, "src/a")])
    entries = table(spark, "repo string, base string, entry string", [("r", "lib/e", "./main")])
    found = {r["specifier"]: (r["outcome"], r["target"], r["target_module"]) for r in resolve.resolve_scripts(imports, files, packages, aliases, entries).collect()}
    assert found == {
        "./a": ("file", "src/a.ts", None), "./b.jsx": ("file", "src/b.tsx", None), "./c": ("file", "src/c/index.ts", None), "./d.js": ("file", "src/d.ts", None), "../lib/e": ("file", "lib/e/main.ts", None),
        "./gone": ("not-found", None, None), None: ("computed", None, None), "@u/core/deep": ("package", None, "packages/u"), "react": ("external", None, None), "#app/x": ("unknown-alias", None, None),
        "@app/a": ("file", "src/a.ts", None), "@app/none": ("alias-target-not-found", None, None), "..": ("not-found", None, None),
    }


def test_ecosystem_imports(spark):
    ask = lambda *items: imports_of(spark, *[(f, s, None) for f, s in items])
    roots = table(spark, "repo string, root string, root_ord int", [("r", "", 0), ("r", "lib", 1)])
    python = files_of(spark, "pkg/__init__.py", "pkg/a.py", "pkg/sub/b.py", "lib/util.py")
    assert outcomes(resolve.dotted_path(ask(("pkg/a.py", ".sub.b"), ("pkg/sub/b.py", "..a"), ("x.py", "pkg.a.Thing"), ("x.py", "pkg.none.Q"), ("x.py", "os.path"), ("x.py", "util"), ("x.py", "pkg.sub.gone.deep")), roots, python)) == {
        ".sub.b": ("file", "pkg/sub/b.py"), "..a": ("file", "pkg/a.py"), "pkg.a.Thing": ("file", "pkg/a.py"), "pkg.none.Q": ("file", "pkg/__init__.py"), "os.path": ("external", None),
        "util": ("file", "lib/util.py"), "pkg.sub.gone.deep": ("file", "pkg/__init__.py"),
    }
    java = files_of(spark, "app/src/com/x/Foo.java", "app/src/com/x/util/Bar.kt")
    assert outcomes(resolve.by_package_directory(ask(("A.java", "com.x.Foo.Inner"), ("A.java", "com.x.util.helper"), ("A.java", "org.y.Z")), java)) == {
        "com.x.Foo.Inner": ("file", "app/src/com/x/Foo.java"), "com.x.util.helper": ("file", "app/src/com/x/util/Bar.kt"), "org.y.Z": ("external", None),
    }
    dart_manifest = table(spark, "repo string, name string, dir string", [("r", "ui", "packages/ui")])
    dart = files_of(spark, "packages/ui/lib/a/b.dart", "lib/c.dart")
    assert outcomes(resolve.package_uri(ask(("lib/m.dart", "package:ui/a/b.dart"), ("lib/m.dart", "package:ui/z.dart"), ("lib/m.dart", "package:http/http.dart"), ("lib/m.dart", "dart:io"), ("lib/m.dart", "c.dart")), dart_manifest, dart)) == {
        "package:ui/a/b.dart": ("file", "packages/ui/lib/a/b.dart"), "package:ui/z.dart": ("not-found", None), "package:http/http.dart": ("external", None), "dart:io": ("external", None), "c.dart": ("file", "lib/c.dart"),
    }
    spaces = table(spark, "repo string, namespace string, dir string", [("r", "App\\", "src"), ("r", "App\\Api\\", "api")])
    php = files_of(spark, "src/Model/User.php", "api/V1.php", "web/inc.php")
    assert outcomes(resolve.psr4(ask(("web/i.php", "\\App\\Model\\User\\CONST"), ("web/i.php", "App\\Api\\V1"), ("web/i.php", "App\\Gone"), ("web/i.php", "Vendor\\X"), ("web/i.php", "inc.php")), spaces, php)) == {
        "\\App\\Model\\User\\CONST": ("file", "src/Model/User.php"), "App\\Api\\V1": ("file", "api/V1.php"), "App\\Gone": ("not-found", None), "Vendor\\X": ("external", None), "inc.php": ("file", "web/inc.php"),
    }
    elixir = files_of(spark, "lib/my_app/http_server.ex")
    assert outcomes(resolve.snake_path(ask(("a.ex", "MyApp.HTTPServer.Inner"), ("a.ex", "Other")), roots, elixir)) == {"MyApp.HTTPServer.Inner": ("file", "lib/my_app/http_server.ex"), "Other": ("external", None)}
    projects = table(spark, "repo string, name string, dir string", [("r", "Acme", ""), ("r", "Acme.Core", "core")])
    spaces_found = {r["specifier"]: r["target_module"] for r in resolve.namespace_prefix(ask(("a.cs", "Acme.Core.Data"), ("a.cs", "Acme.Web"), ("a.cs", "AcmeX")), projects).collect()}
    assert spaces_found == {"Acme.Core.Data": "core", "Acme.Web": ".", "AcmeX": None}
    ruby = files_of(spark, "app/a.rb", "lib/b.rb")
    assert outcomes(resolve.require_path(ask(("app/m.rb", "./a.rb"), ("app/m.rb", "b"), ("app/m.rb", "json"), ("app/m.rb", "./no")), roots, ruby)) == {
        "./a.rb": ("file", "app/a.rb"), "b": ("file", "lib/b.rb"), "json": ("external", None), "./no": ("not-found", None),
    }


def test_one_root_stands_for_those_that_see_a_path_alike(spark):
    files = files_of(spark, *(f"lib/a{k}.ex" for k in range(50)), "top.rb")
    roots = table(spark, "repo string, root string, root_ord int", [("r", "lib", 0), *(("r", f"none{k}/deep", k) for k in range(1, 40)), ("r", "odd/deep", None)])
    seen = resolve._from_roots(files, roots).select("root_ord", "rel", "path").collect()
    assert len(seen) == len(set(seen)) == 51 + 50 + 51 * 2  # upwards from lib, below it, and from two directories down with and without an order
    assert {(r.root_ord, r.rel) for r in seen if r.path == "top.rb"} == {(0, "../top.rb"), (1, "../../top.rb"), (None, "../../top.rb")}
    assert resolve._from_roots(files, roots, upwards=False).count() == 50
    wanted = table(spark, "repo string, file string, specifier string", [("r", "x/y.rb", "../../top")])
    assert resolve.require_path(wanted, roots, files).collect()[0]["target"] == "top.rb"


def test_edges_from_imports_and_manifests(spark, rows):
    mods = table(spark, "repo string, module string, name string, manifest string", [("r", "a", "@m/a", "npm"), ("r", "b", "b_core", "cargo"), ("r", ".", None, "none")])
    deps = table(spark, "repo string, module string, ecosystem string, name string, path string, manifest_file string", [
        ("r", "b", "cargo", "other", "../a", "Cargo.toml"), ("r", "a", "npm", "@m/a", None, "package.json"), ("r", ".", "cargo", "b-core", None, "Cargo.toml"), ("r", "a", "npm", "left-pad", None, "package.json"),
    ])
    declared = modules.declared_edges(deps, mods)
    assert rows(declared, "src", "dst") == [(".", "b"), ("b", "a")]
    resolved = table(spark, "repo string, file string, line int, specifier string, outcome string, target string, target_module string", [
        ("r", "a/x.ts", 1, "../b/y", "file", "b/y.ts", None), ("r", "a/x.ts", 2, "../b/z", "file", "b/z.ts", None), ("r", "a/x.ts", 3, "./q", "file", "a/q.ts", None), ("r", "a/x.ts", 4, None, "computed", None, None), ("r", "b/y.ts", 5, "@m/a", "package", None, "a"),
    ])
    evidence = modules.import_edges(resolved, mods).unionByName(declared)
    assert rows(modules.edges(evidence), "src", "dst", "kind", "evidence_count", "line") == [(".", "b", "declared", 1, None), ("a", "b", "import", 2, 1), ("b", "a", "declared", 1, None), ("b", "a", "import", 1, 5)]
    assert rows(modules.unresolved_imports(resolved), "line", "reason") == [(4, "computed")]
    owned = table(spark, "repo string, module string, path string", [("r", "a", "a/x.ts")])
    assert rows(modules.computed_imports(resolved, owned), "module", "computed") == [("a", 1)]


def test_build_output_beside_a_marker(spark, rows):
    files = files_of(spark, "bin/run.js", "java/pom.xml", "java/bin/A.class", "cs/app.csproj", "cs/bin/x.dll", "node_modules/a.js", "a.min.js")
    assert rows(modules.drop_ignored(files), "path") == [("bin/run.js",), ("cs/app.csproj",), ("java/pom.xml",)]


def test_codeowners(spark, rows):
    content = "# team\n[Section]\n*  @all\n*.js @js # later\n/docs/ @docs\napps/ @apps\n/docs/private\n/a/*/z @z\nlogs/** @logs\n"
    files = table(spark, "repo string, path string, content string", [("r", "CODEOWNERS", "* @wrong"), ("r", ".github/CODEOWNERS", content)])
    rules = ownership.parse_rules(files)
    paths = files_of(spark, "x/y.js", "docs/a/b.md", "src/apps/q.ts", "docs/private/k.md", "a/b/z", "a/b/z/w.ts", "logs/q/r.ts", "apps", "main.go")
    found = {r["path"]: r["owners"] for r in ownership.owners_of(paths, rules).collect()}
    assert found == {
        "x/y.js": ["@js"], "docs/a/b.md": ["@docs"], "src/apps/q.ts": ["@apps"], "docs/private/k.md": [], "a/b/z": ["@z"], "a/b/z/w.ts": ["@z"], "logs/q/r.ts": ["@logs"], "apps": ["@all"], "main.go": ["@all"],
    }
    owned = table(spark, "repo string, module string, path string", [("r", "m", "x/y.js"), ("r", "m", "docs/private/k.md"), ("r", "n", "main.go")])
    assert rows(ownership.module_owners(owned, ownership.owners_of(owned, rules)), "module", "owners", "owned_files", "total_files", "uniform") == [("m", ["@js"], 1, 2, False), ("n", ["@all"], 1, 1, True)]


def closure(edges):
    reach = {n: set() for e in edges for n in e}
    for a, b in edges:
        reach[a].add(b)
    while True:
        grown = {n: r | {x for m in r for x in reach[m]} for n, r in reach.items()}
        if grown == reach:
            return reach
        reach = grown


@pytest.mark.parametrize("name", ["alias_imports", "module_ownership", "owners_last_match", "dotted_imports"])
def test_no_join_broadcasts_by_a_guessed_size(spark, tmp_path, name):
    parts = [(k, f"{('red', 'blue', 'small')[k % 3]} {('gear', 'bolt')[k % 2]}", k % 50) for k in range(60)]
    table(spark, "p_partkey long, p_name string, p_size int", parts).write.parquet(f"{tmp_path}/part.parquet")
    found = all_queries()[name](spark, str(tmp_path))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == (3 if name == "module_ownership" else len(parts))


def test_components_and_cycles_against_brute_force(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "a"), ("h", "h"), ("f", "i"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "w"), ("w", "x"), ("x", "z")]
    df = table(spark, "repo string, src string, dst string", [("r", a, b) for a, b in edges])
    reach = closure([e for e in edges if e[0] != e[1]])
    want = {}
    for n in reach:
        group = sorted(m for m in reach if m in reach[n] and n in reach[m])
        if len(group) > 1:
            want[n] = group[0]
    members = graph.cycles(df)
    assert {r["node"]: r["component"] for r in members.collect()} == want
    shortest = {r["component"]: r["path"] for r in graph.shortest_cycles(df, members.select("repo", "component", "node")).collect()}
    assert shortest == {"a": ["a", "b", "a"], "d": ["d", "e", "d"], "w": ["w", "x", "z", "w"]}
    down = graph.dependents(df, table(spark, "repo string, node string", [("r", "d")]))
    assert {r["node"] for r in down.collect()} == {n for n, r in reach.items() if "d" in r and n != "d"}


def test_graph_without_cycles(spark):
    df = table(spark, "repo string, src string, dst string", [("r", "a", "b"), ("r", "b", "c")])
    assert graph.cycles(df).count() == 0
    assert graph.reachable(df, table(spark, "repo string, node string", [("r", "c")])).count() == 0


def test_value_flow(spark):
    seeds = table(spark, "repo string, file string, name string, certainty int", [("r", "f", "input", 2)])
    links = table(spark, "repo string, file string, source string, name string, certainty int", [("r", "f", "input", "a", 2), ("r", "f", "a", "b", 1), ("r", "f", "b", "c", 2), ("r", "f", "input", "c", 1), ("r", "g", "input", "z", 2), ("r", "f", "a", "c", 2)])
    assert {r["name"]: r["certainty"] for r in graph.value_flow(seeds, links).collect()} == {"input": 2, "a": 2, "b": 1, "c": 2}


@pytest.mark.parametrize(("name", "layer"), [("core-api", "domain"), ("score", "unknown"), ("my-use-cases", "application"), ("web ui", "presentation"), ("core-web", "unknown"), ("infra_data", "infrastructure")])
def test_layers(spark, name, layer):
    assert spark.range(1).select(layers.layer_of(F.lit(name))).first()[0] == layer


def test_definitions_follow_reexports(spark):
    exports = table(spark, "repo string, file string, name string, target string, imported string, line int", [
        ("r", "i", "A", "a", "B", 1), ("r", "a", "B", None, None, 1), ("r", "i", "ns", "a", "*", 1), ("r", "l1", "X", "l2", "X", 1), ("r", "l2", "X", "l1", "X", 1), ("r", "s2", "deep", None, None, 1), ("r", "s1", "deep", None, None, 1), ("r", "s1", "default", None, None, 1),
    ])
    stars = table(spark, "repo string, file string, star_ord int, target string, line int", [("r", "i", 0, "loop", 1), ("r", "i", 1, "s1", 1), ("r", "i", 2, "s2", 1), ("r", "loop", 0, "i", 1), ("r", "loop", 1, "s2", 1)])
    asks = table(spark, "repo string, file string, name string", [("r", "i", n) for n in ("A", "ns", "deep", "default", "nothing")] + [("r", "l1", "X")])
    found = {(r["file"], r["name"]): (r["def_file"], r["def_name"]) for r in surface.definitions(asks, exports, stars).collect()}
    assert found == {("i", "A"): ("a", "B"), ("i", "ns"): ("i", "ns"), ("i", "deep"): ("s2", "deep")}
    points = table(spark, "repo string, module string, file string", [("r", "m", "i")])
    names = {(r["name"], r["form"]) for r in surface.exported_names(points, exports, stars).collect()}
    assert names == {("A", "direct"), ("ns", "direct"), ("deep", "star")}
    hidden = surface.unexpectedly_exposed(exports, points, surface.definitions(exports.select("repo", "file", "name"), exports, stars), table(spark, "repo string, def_file string, def_name string", [("r", "a", "B")]))
    assert sorted((r["file"], r["name"]) for r in hidden.collect()) == [("s1", "deep"), ("s2", "deep")]


def test_dead_declarations_by_visibility(spark):
    schema = "repo string, file string, language string, name string, line int, visibility string, member boolean, decorated boolean, entry_point boolean"
    kinds = [("p1", "private"), ("p2", "private"), ("m1", "module"), ("k1", "package"), ("u1", "public"), ("u2", "public")]
    items = [("r", "d/a.go", "go", n, i, v, False, False, False) for i, (n, v) in enumerate(kinds)] + [("r", "d/a.go", "go", "meth", 9, "public", True, False, False), ("r", "d/a_test.go", "go", "t", 9, "private", False, False, False), ("r", "d/a.go", "go", "main", 9, "private", False, False, True)]
    mentions = table(spark, "repo string, file string, name string", [("r", "d/a.go", "p1"), ("r", "d/b.go", "p2"), ("r", "e/b.go", "k1"), ("r", "d/a.go", "u1"), ("r", "d/b.go", "u2"), ("r", "d/a.go", "u2")])
    dead = surface.dead_declarations(table(spark, schema, items), mentions, table(spark, "repo string, language string, calls long", [("r", "go", 2)]))
    assert sorted((r["name"], r["kind"], r["confidence"]) for r in dead.collect()) == [("k1", "unreferenced", "low"), ("m1", "unreferenced", "low"), ("p2", "unreferenced", "low"), ("u1", "exported-but-unused", "low")]


def test_entrypoints_from_manifests(spark):
    body = '{"exports":{".":{"node":"./dist/node.js","import":"./dist/index.js","types":{"default":"./missing.d.ts"}},"./x":"./src/x.ts","./*":"./src/*"}}'
    manifests = table(spark, "repo string, module string, content string", [("r", "p", body), ("r", "q", '{"main":"lib/m.js"}'), ("r", "w", '{"name":"w"}'), ("r", "v", '{"exports":{"./only":"./o.ts"}}')])
    owned = table(spark, "repo string, module string, path string", [("r", "p", "p/src/index.ts"), ("r", "p", "p/src/node.ts"), ("r", "p", "p/src/x.ts"), ("r", "q", "q/src/m.ts"), ("r", "w", "w/index.js"), ("r", "v", "v/o.ts"), ("r", "v", "v/index.ts")])
    found = {(r["module"], r["subpath"]): r["file"] for r in surface.entrypoints(manifests, owned).collect()}
    assert found == {("p", "."): "p/src/index.ts", ("p", "./x"): "p/src/x.ts", ("q", "."): "q/src/m.ts", ("w", "."): "w/index.js", ("v", "./only"): "v/o.ts"}


def test_impact_confidence(spark):
    changed = table(spark, "repo string, change string, file string, deleted boolean", [("r", "c1", "a/x", False), ("r", "c2", "a/x", False), ("r", "c2", "zzz", False), ("r", "c3", "nowhere", True), ("r", "c4", "b/y", True)])
    owned = table(spark, "repo string, module string, path string", [("r", "a", "a/x"), ("r", "b", "b/y"), ("r", "c", "c/z")])
    edges = table(spark, "repo string, src string, dst string", [("r", "b", "a"), ("r", "c", "b"), ("r", "a", "c")])
    symbols = table(spark, "repo string, module string, file string, name string, line int, def_file string", [("r", "b", "b/y", "n", 3, "b/y"), ("r", "b", "b/q", "m", 3, "b/y")])
    touched = table(spark, "repo string, change string, file string, line int", [("r", "c4", "b/y", 3)])
    out = impact.estimate(changed, owned, edges, symbols, touched)
    got = {r["change"]: (r["affected_modules"], r["downstream_modules"], r["public_names"], r["confidence"]) for r in out.summary.collect()}
    assert got == {"c1": (1, 2, 0, "high"), "c2": (1, 2, 0, "medium"), "c3": (0, 0, 0, "low"), "c4": (1, 2, 2, "medium")}
    assert [r["name"] for r in out.on_changed_lines.collect()] == ["n"]


@pytest.mark.parametrize(
    ("version", "wanted", "hit"),
    [("1.4.0", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("x", "*", True), ("x", "^1.0.0", False), ("1.2.3-rc", "1.2.3", True), ("1.10.0", "^1.9.9", True), ("1.0.0", " ", True), ("1.0.0", "^z", False)],
)
def test_ranges(spark, version, wanted, hit):
    assert spark.range(1).select(semver.satisfies(F.lit(version), F.lit(wanted))).first()[0] is hit


def test_pack_resolution_order_and_versions(spark):
    packs = table(spark, "pack string, version string, pack_ord int", [("a", "1.0.0", 0), ("b", "1.0.0", 1), ("b", "1.5.0", 2), ("b", "2.0.0", 3), ("c", "1.0.0", 4)])
    deps = table(spark, "pack string, version string, dep_ord int, dep_pack string, range string", [("a", "1.0.0", 0, "b", "^1.0.0"), ("a", "1.0.0", 1, "gone", "*"), ("c", "1.0.0", 0, "b", "~1.0.0"), ("b", "1.5.0", 0, "a", "*")])
    asked = table(spark, "repo string, pack string, request_ord int", [("r", "a", 0), ("r", "c", 1)])
    resolved, missing = policy.resolve_dependencies(asked, packs, deps)
    assert [(r["pack"], r["version"]) for r in resolved.orderBy("position").collect()] == [("a", "1.0.0"), ("b", "1.0.0"), ("c", "1.0.0")]
    assert [r["pack"] for r in missing.collect()] == ["gone"]


def test_applicable_rules_and_validation(spark):
    rules = table(spark, "repo string, rule_id string, scope string, wanted string", [("r", "1", "always", None), ("r", "2", "language", "C-Sharp"), ("r", "3", "framework", "Next.js"), ("r", "4", "glob", "*.ts"), ("r", "5", "language", "go")])
    have = table(spark, "repo string, capability string", [("r", "csharp"), ("r", "NextJS")])
    assert sorted(r["rule_id"] for r in policy.applicable_rules(rules, have).collect()) == ["1", "2", "3", "4"]
    listed = table(spark, "pack string, version string, rule_id string, knowledge_id string", [("p", "1.0", "a", "k1"), ("p", "1.0", "a", "k2")])
    faults = policy.validate_packs(listed, table(spark, "pack string, version string", [("p", "1.0")]), table(spark, "pack string, version string, knowledge_id string", [("p", "1.0", "k1")]))
    assert sorted((r["fault"], r["subject"]) for r in faults.collect()) == [("bad-version", "1.0"), ("duplicate-rule", "a"), ("missing-knowledge", "k2")]


def test_conflict_precedence(spark):
    items = [("r", 0, "a", "pack", 1, ["b", "a"]), ("r", 1, "b", "pack", 0, ["a"]), ("r", 2, "b", "criteria", None, []), ("r", 3, "Z", "pack", 5, ["y"]), ("r", 4, "y", "pack", 5, [])]
    rows = table(spark, "repo string, idx int, rule_id string, origin string, request_index int, contradicts array<string>", items)
    found = policy.conflicts(rows)
    assert sorted((r["winner"], r["loser"]) for r in found.collect()) == [(1, 0), (2, 0), (2, 1), (4, 3)]
    assert sorted(r["idx"] for r in policy.survivors(rows, found).collect()) == [2, 4]
    order = [r["rule_id"] for r in rows.select("rule_id").distinct().orderBy(policy.rule_order(F.col("rule_id"))).collect()]
    assert order == ["a", "b", "y", "Z"]


def test_policy_id_is_deterministic(spark):
    context = table(spark, "repo string, generated_at string, criteria string", [("r", "t", "{}"), ("s", "t", "{}")])
    packs = [("r", "b", "1.0.0"), ("r", "a", "1.0.0"), ("s", "a", "1.0.0"), ("s", "b", "1.0.0")]
    ids = {r["policy_id"] for r in policy.policy_ids(table(spark, "repo string, pack string, version string", packs), context).collect()}
    assert len(ids) == 1
