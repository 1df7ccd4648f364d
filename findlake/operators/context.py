"""What a repository is: stack signals, capabilities, dependencies, documentation, criteria.

Input everywhere: ``files`` (repo, path, content). Marker tables are plain values; they are part
of the plan, and each repository's root files are read in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions.paths import basename, dirname
from findlake.functions.text import markdown_title, trim_space, word_count

# --- fixed values: root files and the signal each one gives ---
LANGUAGE_FILES = (
    ("Cargo.toml", "Rust"), ("pubspec.yaml", "Dart"), ("go.mod", "Go"), ("Gemfile", "Ruby"), ("pyproject.toml", "Python"),
    ("requirements.txt", "Python"), ("build.gradle.kts", "Kotlin"), ("build.gradle", "Java"), ("pom.xml", "Java"),
    ("Package.swift", "Swift"), ("mix.exs", "Elixir"), ("CMakeLists.txt", "Cpp"), ("package.json", "JavaScript/TypeScript"),
)
LANGUAGE_EXTENSIONS = ((".csproj", "CSharp"), (".sln", "CSharp"))
BUILD_FILES = (
    ("Cargo.toml", "Cargo"), ("build.gradle.kts", "Gradle"), ("build.gradle", "Gradle"), ("pom.xml", "Maven"), ("turbo.json", "Turborepo"),
    ("vite.config.ts", "Vite"), ("vite.config.js", "Vite"), ("vite.config.mjs", "Vite"), ("webpack.config.js", "Webpack"),
    ("webpack.config.ts", "Webpack"), ("tsup.config.ts", "tsup"), ("tsup.config.js", "tsup"),
)
MANAGER_FILES = (
    ("bun.lock", "Bun"), ("bun.lockb", "Bun"), ("pnpm-lock.yaml", "pnpm"), ("package-lock.json", "npm"), ("yarn.lock", "Yarn"),
    ("Cargo.lock", "Cargo"), ("pubspec.lock", "pub"),
)
RUNTIME_FILES = (
    ("bun.lock", "Bun"), ("bun.lockb", "Bun"), ("bunfig.toml", "Bun"), ("deno.json", "Deno"), ("deno.jsonc", "Deno"), (".nvmrc", "Node.js"),
)
MONOREPO_FILES = ("pnpm-workspace.yaml", "turbo.json", "lerna.json", "nx.json")
PACKAGE_FRAMEWORKS = (
    ("next", "Next.js"), ("react", "React"), ("vue", "Vue"), ("svelte", "Svelte"), ("electron", "Electron"),
    ("@tauri-apps/api", "Tauri"), ("@tauri-apps/cli", "Tauri"),
)
EXTRA_FRAMEWORKS = ("astro", "lit", "express", "fastify", "hono", "elysia")
FRAMEWORK_NEEDLES = (
    ("requirements.txt", ("django",), "Django"), ("requirements.txt", ("flask",), "Flask"), ("pyproject.toml", ("django",), "Django"),
    ("pyproject.toml", ("flask",), "Flask"), ("Pipfile", ("django",), "Django"), ("Pipfile", ("flask",), "Flask"),
    ("Gemfile", ("'rails'", '"rails"'), "Rails"), ("pom.xml", ("spring-boot", "org.springframework"), "Spring"),
    ("build.gradle", ("spring-boot", "org.springframework"), "Spring"), ("build.gradle.kts", ("spring-boot", "org.springframework"), "Spring"),
    ("mix.exs", (":phoenix",), "Phoenix"), ("Cargo.toml", ("tauri",), "Tauri"), ("pubspec.yaml", ("flutter",), "Flutter"),
)
ASPNET_NEEDLES = ("microsoft.net.sdk.web", "microsoft.aspnetcore")
PLATFORMS = {"web": ("React", "Vue", "Svelte", "Next.js"), "desktop": ("Tauri", "Electron"), "mobile": ("Flutter",)}
TOOLING_FILES = (
    ("biome.json", "biome"), ("biome.jsonc", "biome"), (".eslintrc.json", "eslint"), (".eslintrc.js", "eslint"), (".eslintrc.cjs", "eslint"),
    ("eslint.config.js", "eslint"), ("eslint.config.mjs", "eslint"), ("eslint.config.ts", "eslint"), ("vitest.config.ts", "vitest"),
    ("vitest.config.js", "vitest"), ("vitest.config.mts", "vitest"),
)
LOCKFILES = ("bun.lock", "bun.lockb", "pnpm-lock.yaml", "package-lock.json", "yarn.lock", "Cargo.lock", "pubspec.lock")
TRACKED_PACKAGES = ("react", "next", "vue", "svelte", "electron", "@tauri-apps/api", "@tauri-apps/cli")
FEATURE_DIRS = ("features", "modules", "domains")
LAYER_DIRS = ("domain", "adapters", "infrastructure", "application")
KINDS = ("language", "framework", "platform", "tooling", "characteristic")
RULE_DOCUMENTS = ("ARCHITECTURE.md", "CONTRIBUTING.md", "CLAUDE.md", "UX_CRITERIA.md", "UI_CRITERIA.md", "DX_CRITERIA.md")

_MAP = "map<string,string>"


def _row(kind: str, value, detail, origin="manifest", confidence="high", ord_: int = 0) -> Column:
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(kind).alias("kind"), lift(value).alias("value"), lift(detail).alias("detail"), F.lit(origin).alias("origin"), lift(confidence).alias("confidence"), F.lit(ord_).alias("ord")
    )


def root_files(files: DataFrame) -> DataFrame:
    return files.where(~F.col("path").contains("/"))


def _package_maps() -> tuple[Column, Column]:
    dependencies = F.coalesce(F.from_json(F.get_json_object("content", "$.dependencies"), _MAP), F.create_map().cast(_MAP))
    development = F.coalesce(F.from_json(F.get_json_object("content", "$.devDependencies"), _MAP), F.create_map().cast(_MAP))
    return dependencies, development


def _read_roots(files: DataFrame) -> DataFrame:
    """Root files with what several tests ask of them, computed once per row: the names
    package.json depends on, and the text in lower case."""
    first, second = _package_maps()
    names = F.when(F.col("path") == "package.json", F.array_union(F.map_keys(first), F.map_keys(second)))
    return root_files(files).select("repo", "path", "content", names.alias("__depends"), F.lower("content").alias("__lower"))


def _has(name: str) -> Column:
    return F.array_contains("__depends", name)


def _explode_cells(rows: DataFrame, markers: dict[str, list[Column]], tests: dict[str, list[Column]], endings: dict[str, list[Column]]) -> DataFrame:
    """``(repo, file, s)``: ``markers`` of a file name, ``tests`` of its content (each null unless
    it holds) and what name endings show. A row evaluates only its own file's tests."""
    name = F.col("path")
    empty = F.filter(F.array(_row("", "", "")), lambda r: F.lit(False))
    known = F.create_map(*[x for file, cells in markers.items() for x in (F.lit(file), F.array(*cells))])
    tested = empty
    for file, cells in tests.items():
        tested = F.when(name == file, F.array_compact(F.array(*cells))).otherwise(tested)
    ended = empty
    for ending, cells in endings.items():
        ended = F.when(name.endswith(ending), F.array_compact(F.array(*cells))).otherwise(ended)
    found = F.concat(F.coalesce(F.try_element_at(known, name), empty), tested, ended)
    return rows.select("repo", F.col("path").alias("file"), F.explode(found).alias("s"))


def stack_signals(files: DataFrame) -> DataFrame:
    """``(repo, kind, value, file, detail)`` with kind language, framework, build, manager,
    runtime or workspace: root marker files, package.json fields, and names manifests mention."""
    content, lower = F.col("content"), F.col("__lower")
    markers: dict[str, list[Column]] = {}
    for kind, table in (("language", LANGUAGE_FILES), ("build", BUILD_FILES), ("manager", MANAGER_FILES), ("runtime", RUNTIME_FILES)):
        for i, (file, value) in enumerate(table):
            markers.setdefault(file, []).append(_row(kind, value, f"{file} present", ord_=i))
    for file in MONOREPO_FILES:
        markers.setdefault(file, []).append(_row("workspace", "monorepo", f"{file} present"))

    package = [F.when(_has(d), _row("framework", value, f'dependency "{d}" declared', ord_=i)) for i, (d, value) in enumerate(PACKAGE_FRAMEWORKS)]
    package.append(F.when(F.get_json_object(content, "$.workspaces").isNotNull(), _row("workspace", "monorepo", '"workspaces" field present', ord_=9)))
    manager = F.element_at(F.split(F.get_json_object(content, "$.packageManager"), "@"), 1)
    shown = F.when(manager == "bun", "Bun").when(manager == "yarn", "Yarn").when(manager.isin("pnpm", "npm"), manager)
    package.append(F.when(shown.isNotNull(), _row("manager", shown, "packageManager field", ord_=20)))
    package.append(F.when(manager == "bun", _row("runtime", "Bun", "packageManager field", ord_=20)))
    node = F.get_json_object(content, "$.engines.node")
    package.append(F.when(node != "", _row("runtime", "Node.js", F.concat(F.lit('engines.node = "'), node, F.lit('"')), ord_=21)))
    tests = {"package.json": package}
    for i, (file, needles, value) in enumerate(FRAMEWORK_NEEDLES):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | lower.contains(needle)
        tests.setdefault(file, []).append(F.when(hit, _row("framework", value, "dependency on the framework found", ord_=20 + i)))
    web = lower.contains(ASPNET_NEEDLES[0]) | lower.contains(ASPNET_NEEDLES[1])
    endings = {ending: [_row("language", value, f"{ending} file present", ord_=50)] for ending, value in LANGUAGE_EXTENSIONS}
    endings[".csproj"].append(F.when(web, _row("framework", "ASP.NET Core", "dependency on the framework found", ord_=60)))
    found = _explode_cells(_read_roots(files), markers, tests, endings)
    return found.select("repo", "file", "s.kind", "s.value", "s.detail", "s.origin", "s.confidence", "s.ord")


def stack_profile(signals: DataFrame) -> DataFrame:
    """Distinct values per repository and kind with how much evidence each has."""
    return signals.groupBy("repo", "kind", "value").agg(F.count(F.lit(1)).alias("evidence"), F.min(F.struct("ord", "file", "detail")).alias("f")).select(
        "repo", "kind", "value", "evidence", F.col("f.file").alias("file"), F.col("f.detail").alias("detail")
    )


def workspace_types(repos: DataFrame, signals: DataFrame) -> DataFrame:
    mono = signals.where("kind = 'workspace'").select("repo").distinct().withColumn("m", F.lit(True))
    return repos.select("repo").distinct().join(mono, "repo", "left").select("repo", F.when(F.col("m"), "monorepo").otherwise("single-package").alias("workspace_type"))


def capabilities(files: DataFrame, signals: DataFrame) -> DataFrame:
    """``(repo, kind, id, confidence, origin, evidence)`` after merging: the first row of an id
    keeps its attributes, evidence is counted."""
    stack = signals.select(
        "repo",
        F.when(F.col("kind").isin("build", "manager", "runtime"), "tooling").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("value") == "JavaScript/TypeScript", "javascript").otherwise(F.col("value")).alias("id"),
        "confidence",
        "origin",
        (F.when(F.col("kind") == "language", 0).when(F.col("kind") == "framework", 100).otherwise(300) + F.col("ord")).alias("ord"),
    ).where("kind <> 'workspace'")
    chain = F.lit(None).cast("string")
    for platform, frameworks in PLATFORMS.items():
        chain = F.when(F.col("value").isin(*frameworks), platform).otherwise(chain)
    platforms = signals.where("kind = 'framework'").select("repo", F.lit("platform").alias("kind"), chain.alias("id"), F.lit("high").alias("confidence"), F.lit("convention").alias("origin"), F.lit(200).alias("ord")).where("id IS NOT NULL").distinct()

    content = F.col("content")
    markers = {file: [_row("tooling", value, "", "config", ord_=400)] for file, value in TOOLING_FILES}
    markers["tsconfig.json"] = [_row("language", "typescript", "", ord_=90)]
    markers["composer.json"] = [_row("language", "php", "", ord_=500)]
    for file in ("pnpm-workspace.yaml", "turbo.json"):
        markers[file] = [_row("characteristic", "workspace", "", "convention", ord_=600)]
    package = [F.when(_has(d), _row("framework", d, "", ord_=150)) for d in EXTRA_FRAMEWORKS]
    package.append(F.when(_has("typescript"), _row("language", "typescript", "", confidence="medium", ord_=91)))
    package.append(F.when(F.get_json_object(content, "$.engines.vscode") != "", _row("platform", "vscode-extension", "", ord_=250)))
    requires = F.from_json(F.get_json_object(content, "$.require"), _MAP)
    composer = [F.when(F.map_contains_key(requires, "laravel/framework"), _row("framework", "laravel", "", ord_=501))]
    marked = _explode_cells(_read_roots(files), markers, {"package.json": package, "composer.json": composer}, {}).select(
        "repo", "s.kind", F.col("s.value").alias("id"), "s.confidence", "s.origin", "s.ord"
    )

    folder = F.split("path", "/")
    top = files.where(F.col("path").contains("/")).select("repo", folder[0].alias("top"), F.when(F.size(folder) > 2, folder[1]).alias("second")).distinct()
    seen = top.groupBy("repo").agg(
        F.bool_or(F.col("top").isin("packages", "apps")).alias("grouped"),
        F.bool_or((F.col("top") == "src") & F.col("second").isin(*FEATURE_DIRS)).alias("featured"),
        F.count_if((F.col("top") == "src") & F.col("second").isin(*LAYER_DIRS)).alias("layers"),
    )
    shape = [
        F.when(F.col("grouped"), _row("characteristic", "monorepo", "", "convention", ord_=601)),
        F.when(F.col("grouped"), _row("characteristic", "package-based", "", "convention", ord_=602)),
        F.when(F.col("featured"), _row("characteristic", "feature-based", "", "convention", "medium", 603)),
        F.when(F.col("layers") >= 2, _row("characteristic", "layered", "", "convention", "medium", 604)),
    ]
    shaped = seen.select("repo", F.explode(F.array_compact(F.array(*shape))).alias("s")).select("repo", "s.kind", F.col("s.value").alias("id"), "s.confidence", "s.origin", "s.ord")
    every = stack.unionByName(platforms).unionByName(marked).unionByName(shaped)
    merged = every.groupBy("repo", "id").agg(F.min_by(F.struct("kind", "confidence", "origin"), "ord").alias("c"), F.count(F.lit(1)).alias("evidence"))
    return merged.select("repo", "c.kind", "id", "c.confidence", "c.origin", "evidence")


def capability_summary(found: DataFrame) -> DataFrame:
    """One line per repository: kinds in fixed order, names sorted. Ids come from the marker
    tables, so the collected set is bounded by them."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    names = found.groupBy("repo", "kind").agg(F.array_join(F.sort_array(F.collect_set("id")), ", ").alias("names")).withColumn("rank", rank)
    label = F.concat(F.initcap("kind"), F.lit(": "), "names")
    lines = names.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("rank", label.alias("text")))).alias("l"))
    return lines.select("repo", F.array_join(F.transform("l", lambda x: x["text"]), " — ").alias("summary"))


def dependency_profile(files: DataFrame) -> DataFrame:
    """``(repo, kind, name, value)``: lockfiles, tracked versions, runtime constraints."""
    name, content = F.col("path"), F.col("content")
    first, second = _package_maps()
    package, cargo = name == "package.json", name == "Cargo.toml"

    def cell(kind: str, key: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("name"), value.alias("value"))

    toml = lambda key: F.regexp_extract(content, rf'(?m)^\s*{key}\s*=\s*"([^"]+)"', 1)
    cells = [F.when(name == f, cell("lockfile", f, F.lit("present"))) for f in LOCKFILES]
    for key in TRACKED_PACKAGES:
        version = F.coalesce(F.try_element_at(second, F.lit(key)), F.try_element_at(first, F.lit(key)))
        cells.append(F.when(package & (version != ""), cell("version", key, version)))
    node, manager = F.get_json_object(content, "$.engines.node"), F.get_json_object(content, "$.packageManager")
    cells.append(F.when(package & (node != ""), cell("runtime", "node", node)))
    cells.append(F.when(package & manager.isNotNull(), cell("runtime", "packageManager", manager)))
    cells.append(F.when(cargo & (toml("tauri") != ""), cell("version", "tauri", toml("tauri"))))
    cells.append(F.when(cargo & (toml("rust-version") != ""), cell("runtime", "rust", toml("rust-version"))))
    return root_files(files).select("repo", F.explode(F.array_compact(F.array(*cells))).alias("d")).select("repo", "d.*")


def documentation_kind(path: Column) -> Column:
    """Kind by file name and directory."""
    name, folder = F.lower(basename(path)), F.lower(dirname(path))
    return (
        F.when(folder.contains("adr") | name.rlike(r"^\d{4}[-_]"), "adr")
        .when(name.contains("prd"), "prd")
        .when(name.contains("roadmap"), "roadmap")
        .when(name.contains("architecture"), "architecture")
        .when(name.contains("contributing"), "contributing")
        .when(name.startswith("readme"), "readme")
        .when(name == "claude.md", "claude-memory")
        .otherwise("other")
    )


def documentation(files: DataFrame) -> DataFrame:
    return files.select(
        "repo", "path", documentation_kind(F.col("path")).alias("kind"), markdown_title(F.col("content")).alias("title"), word_count(F.col("content")).alias("words")
    )


def documentation_summary(sources: DataFrame) -> DataFrame:
    """Counts per kind as one sentence, kinds in the order they first appear by path."""
    kinds = sources.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    part = F.concat(F.col("n").cast("string"), F.lit(" "), "kind", F.when(F.col("n") > 1, "s").otherwise(""))
    lines = kinds.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("first", part.alias("text")))).alias("l"), F.sum("n").alias("n"))
    head = F.concat(F.col("n").cast("string"), F.lit(" documentation source"), F.when(F.col("n") > 1, "s").otherwise(""), F.lit(" found: "))
    return lines.select("repo", F.concat(head, F.array_join(F.transform("l", lambda x: x["text"]), ", "), F.lit(".")).alias("summary"))


def _rules(rows: DataFrame, rule_id: Column, description: Column) -> DataFrame:
    return rows.select("repo", "path", rule_id.alias("rule_id"), description.alias("description"))


def criteria(files: DataFrame) -> DataFrame:
    """The repository's own rules, from lint and format configuration and rule-shaped documents:
    ``(repo, path, rule_id, description)``."""
    root = root_files(files)
    json_map = lambda path: F.from_json(F.get_json_object("content", path), _MAP)
    eslint = root.where(F.col("path").isin(".eslintrc.json", ".eslintrc")).groupBy("repo").agg(F.min_by(F.struct("path", "content"), F.when(F.col("path") == ".eslintrc.json", 0).otherwise(1)).alias("f")).select("repo", "f.*")
    eslint = eslint.select("repo", "path", F.explode(json_map("$.rules")).alias("name", "value"))
    out = _rules(eslint, F.concat(F.lit("eslint:"), "name"), F.concat(F.lit('ESLint rule "'), "name", F.lit('" configured')))

    biome = root.where("path = 'biome.json'")
    groups = biome.select("repo", "path", F.explode(json_map("$.linter.rules")).alias("group", "body"))
    recommended = groups.where("group = 'recommended'")
    out = out.unionByName(_rules(recommended, F.lit("biome:linter.recommended"), F.concat(F.lit("Biome recommended lint rules: "), "body")))
    inner = groups.where("group <> 'recommended' AND startswith(body, '{')").select("repo", "path", "group", F.explode(F.from_json("body", _MAP)).alias("name", "value"))
    full = F.concat("group", F.lit("."), "name")
    out = out.unionByName(_rules(inner, F.concat(F.lit("biome:"), full), F.concat(F.lit('Biome rule "'), full, F.lit('" configured'))))
    formatter = biome.select("repo", "path", F.explode(json_map("$.formatter")).alias("name", "value")).where("name <> 'enabled'")
    out = out.unionByName(_rules(formatter, F.concat(F.lit("biome:formatter."), "name"), F.concat(F.lit('Biome formatter setting "'), "name", F.lit('" = '), "value")))

    prettier = root.where(F.col("path").isin(".prettierrc", ".prettierrc.json")).select("repo", "path", F.explode(F.from_json("content", _MAP)).alias("name", "value"))
    out = out.unionByName(_rules(prettier, F.concat(F.lit("prettier:"), "name"), F.concat(F.lit('Prettier setting "'), "name", F.lit('" = '), "value")))

    pair = r"^([\w.-]+)\s*=\s*(.+)$"
    split = F.posexplode(F.split("content", r"\r?\n")).alias("pos", "raw")
    config = root.where("path = '.editorconfig'").select("repo", "path", split).withColumn("line", trim_space(F.col("raw")))
    config = config.where("line <> '' AND NOT line RLIKE '^[#;]'")
    in_file = Window.partitionBy("repo", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.when(F.col("line").rlike(r"^\[.+\]$"), F.regexp_extract("line", r"^\[(.+)\]$", 1))
    config = config.withColumn("section", F.coalesce(F.last(header, ignorenulls=True).over(in_file), F.lit("*"))).where(~F.col("line").rlike(r"^\[.+\]$") & F.col("line").rlike(pair))
    key, value = F.regexp_extract("line", pair, 1), F.regexp_extract("line", pair, 2)
    out = out.unionByName(
        _rules(config, F.concat(F.lit("editorconfig:"), "section", F.lit(":"), key), F.concat(F.lit('EditorConfig "'), key, F.lit('" = "'), value, F.lit('" for '), "section"))
    )

    flat = root.where(F.col("path").isin("rustfmt.toml", "clippy.toml")).select("repo", "path", split).withColumn("line", trim_space(F.col("raw")))
    flat = flat.where("line <> '' AND NOT line RLIKE '^[#\\\\[]'").where(F.col("line").rlike(pair))
    prefix = F.regexp_replace("path", r"\.toml$", "")
    out = out.unionByName(_rules(flat, F.concat(prefix, F.lit(":"), key), F.concat(prefix, F.lit(' "'), key, F.lit('" = '), value)))

    titles = F.filter(F.transform(F.regexp_extract_all("content", F.lit(r"(?m)^(?:##|###)[ \t]+(.+)$"), F.lit(1)), trim_space), lambda t: t != "")
    headings = root.where(F.col("path").isin(*RULE_DOCUMENTS)).select("repo", "path", F.posexplode(titles).alias("pos", "title"))
    return out.unionByName(_rules(headings, F.concat("path", F.lit(":"), (F.col("pos") + 1).cast("string")), F.col("title")))


def understanding(repos: DataFrame, signals: DataFrame, sources: DataFrame, rules: DataFrame) -> DataFrame:
    """Open questions per repository and the confidence they leave: none high, up to two medium."""
    marks = signals.groupBy("repo").agg(
        F.bool_or(F.col("kind") == "language").alias("languages"),
        F.bool_or(F.col("value") == "JavaScript/TypeScript").alias("script"),
        F.bool_or(F.col("kind") == "runtime").alias("runtimes"),
    )
    joined = (
        repos.select("repo").distinct()
        .join(marks, "repo", "left")
        .join(sources.select("repo").distinct().withColumn("documented", F.lit(True)), "repo", "left")
        .join(rules.select("repo").distinct().withColumn("ruled", F.lit(True)), "repo", "left")
    )
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    questions = F.array_compact(
        F.array(
            F.when(off("languages"), "languages"),
            F.when(F.coalesce("script", F.lit(False)) & off("runtimes"), "runtime"),
            F.when(off("documented"), "purpose"),
            F.when(off("ruled"), "conventions"),
        )
    )
    n = F.size(questions)
    return joined.select("repo", questions.alias("open_questions"), F.when(n == 0, "high").when(n <= 2, "medium").otherwise("low").alias("confidence"))
