"""Environment variables: the names a repository documents, and reads nobody documented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.paths import basename, is_test_path
from findlake.operators.ordered import first_per_key

# --- fixed values: files read as configuration, and suffixes of dotenv names ---
CONFIG_NAMES = (
    "makefile", "gnumakefile", "justfile", "taskfile.yml", "taskfile.yaml", "package.json", "composer.json",
    "pyproject.toml", "pipfile", "tox.ini", "procfile", "app.json", "wrangler.toml", "wrangler.json",
    "wrangler.jsonc", "vercel.json", "netlify.toml", "fly.toml", "render.yaml", "render.yml", ".gitlab-ci.yml",
    "azure-pipelines.yml", "bitbucket-pipelines.yml", "cloudbuild.yaml", "cloudbuild.yml", "mix.exs", "pubspec.yaml",
)
DOTENV_SUFFIXES = (
    "example", "sample", "template", "dist", "defaults", "local", "dev", "development", "prod", "production", "test", "staging", "ci",
)
# --- fixed values: variables a platform, shell or tool provides ---
AMBIENT = (
    "PATH", "HOME", "USER", "USERNAME", "LOGNAME", "PWD", "OLDPWD", "SHELL", "TERM", "TMPDIR", "TEMP", "TMP", "TZ", "LANG",
    "LANGUAGE", "HOSTNAME", "EDITOR", "VISUAL", "PAGER", "DISPLAY", "NO_COLOR", "FORCE_COLOR", "CLICOLOR", "CLICOLOR_FORCE",
    "COLORTERM", "COLUMNS", "LINES", "CI", "NODE_ENV", "APPDATA", "LOCALAPPDATA", "USERPROFILE", "PROGRAMFILES", "SYSTEMROOT",
    "COMSPEC", "OUT_DIR", "TARGET", "PROFILE", "HOST", "OPT_LEVEL", "NUM_JOBS", "RUST_LOG", "RUST_BACKTRACE", "DEBUG",
    "NODE_OPTIONS", "NODE_PATH", "VITEST", "JEST_WORKER_ID", "HTTP_PROXY", "HTTPS_PROXY", "ALL_PROXY", "NO_PROXY",
    "http_proxy", "https_proxy", "all_proxy", "no_proxy", "SOURCE_DATE_EPOCH", "WSL_DISTRO_NAME", "TERM_PROGRAM", "DYNO",
    "VERCEL", "NETLIFY", "CF_PAGES", "RENDER", "GCP_BUILDPACKS", "DEPLOY_URL", "DEPLOY_PRIME_URL", "CONTEXT", "SST", "PATHEXT",
    "RELEASE_ROOT", "RELEASE_NAME", "RELEASE_VSN", "RELEASE_NODE", "RELEASE_COOKIE", "RELEASE_TMP", "RELEASE_MODE",
    "RELEASE_DISTRIBUTION", "RELEASE_SYS_CONFIG", "RELEASE_VM_ARGS",
)
AMBIENT_PREFIXES = (
    "LC_", "XDG_", "CARGO_", "RUSTC", "GITHUB_", "RUNNER_", "GITLAB_", "CI_", "npm_", "PYTHON", "OTEL_", "VERCEL_", "NETLIFY_",
    "CF_PAGES_", "RENDER_", "VSCODE_", "FLASK_", "PUPPETEER_",
)

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_UPPER = r"(?<![A-Za-z0-9_])((?=[A-Z0-9_]*[A-Z])[A-Z_][A-Z0-9_]+)(?![A-Za-z0-9_])"
_ASSIGNED = _UPPER + r"(?=[ \t\"']*(?::(?=[ \t]|$)|=(?!=)|\?=|:=|\+=))"
_FENCE = r"(?ms)^[ \t]*(```|~~~)[^\n]*\n(.*?)(?:^[ \t]*\1[^\n]*$|\z)"


def doc_kind(path: Column) -> Column:
    """How a file is read for names: dotenv, build-script, dockerfile, markdown, config or null."""
    lower = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base = basename(lower)
    words = "|".join(DOTENV_SUFFIXES)
    suffix = rf"(?:{words})(?:\.(?:{words}))*"
    dotenv = base.isin(".env", ".envrc") | base.endswith(".env") | base.rlike(rf"^\.?env\.{suffix}$|\.env\.{suffix}$")
    yaml = base.rlike(r"\.ya?ml$")
    compose = yaml & base.rlike("^(docker-compose|compose)")
    workflow = yaml & lower.rlike(r"\.(github/workflows|circleci|buildkite|woodpecker)/")
    return (
        F.when(dotenv, "dotenv")
        .when(base == "build.rs", "build-script")
        .when(base.rlike(r"^(dockerfile|containerfile)|\.dockerfile$"), "dockerfile")
        .when(base.rlike(r"^readme|\.(md|mdx|markdown|rst|adoc)$"), "markdown")
        .when(compose | workflow | lower.rlike(r"\.cargo/config(\.toml)?$") | base.endswith(".mk") | base.isin(*CONFIG_NAMES), "config")
    )


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def dotenv_names(content: Column) -> Column:
    """``NAME=``, ``export NAME=`` and the same behind ``#``."""
    return _all(content, rf"(?m)^[ \t]*#*[ \t]*(?:export [ \t]*)?({_NAME})[ \t]*=")


def expanded_names(content: Column) -> Column:
    return _all(content, rf"\$\{{?({_NAME})")


def markdown_names(content: Column) -> Column:
    """Upper-case words and expansions in fenced blocks and inline code spans."""
    blocks = _all(content, _FENCE, 2)
    prose = F.regexp_replace(content, _FENCE, "\n")
    spans = _all(prose, r"`+([^`\n]+)`+", 1)
    code = F.array_join(F.concat(blocks, spans), "\n")
    return F.concat(_all(code, _UPPER), expanded_names(code))


def dockerfile_names(content: Column) -> Column:
    """``ENV`` and ``ARG`` names with continued lines and quoted values, and expansions."""
    joined = F.regexp_replace(content, r"\\[ \t\r]*\n", " ")
    rests = _all(joined, r"(?mi)^[ \t]*(?:ENV|ARG)[ \t]+(\S[^\n]*)$")

    def of_line(rest: Column) -> Column:
        words = _all(rest, r"((?:\"[^\"]*\"|'[^']*'|[^\s\"'])+)")
        assigned = F.filter(F.transform(words, lambda w: F.regexp_extract(w, rf"^({_NAME})=", 1)), lambda n: n != "")
        first = F.regexp_extract(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")), rf"^({_NAME})$", 1)
        return F.concat(assigned, F.filter(F.array(first), lambda n: n != ""))

    live = F.regexp_replace(content, r"(?m)^[ \t]*#[^\n]*$", "")
    return F.concat(F.flatten(F.transform(rests, of_line)), expanded_names(live))


def config_names(content: Column) -> Column:
    """Names assigned, expanded or listed on a line of their own."""
    listed = _all(content, r"(?m)^[ \t]*- +((?=[A-Z0-9_]*[A-Z])[A-Z_][A-Z0-9_]+)[ \t]*(?:#[^\n]*)?$")
    return F.concat(_all(content, "(?m)" + _ASSIGNED), expanded_names(content), listed)


def build_script_names(content: Column) -> Column:
    return _all(content, rf"rustc-env=({_NAME})=")


def documented(files: DataFrame) -> DataFrame:
    """Distinct ``(repo, name)`` the repository's files (repo, path, content) mention."""
    kind, content = F.col("doc_kind"), F.col("content")
    names = (
        F.when(kind == "dotenv", dotenv_names(content))
        .when(kind == "markdown", markdown_names(content))
        .when(kind == "dockerfile", dockerfile_names(content))
        .when(kind == "config", config_names(content))
        .when(kind == "build-script", build_script_names(content))
    )
    read = files.withColumn("doc_kind", doc_kind(F.col("path"))).where("doc_kind IS NOT NULL")
    return read.select("repo", F.explode(F.array_distinct(names)).alias("name")).distinct()


def is_ambient(name: Column) -> Column:
    return name.isin(*AMBIENT) | name.rlike("^(" + "|".join(AMBIENT_PREFIXES) + ")")


def undocumented_reads(reads: DataFrame, names: DataFrame) -> DataFrame:
    """The first read per file of each variable no file documents and no platform provides.

    ``reads``: repo, file, name, start, line, fallback. A read with a fallback costs less.
    """
    asked = reads.where(~is_ambient(F.col("name")) & ~is_test_path(F.col("file")))
    gap = asked.join(names.select("repo", "name"), ["repo", "name"], "left_anti").select(*reads.columns)
    first = first_per_key(gap, ["repo", "file", "name"], [F.col("start")])
    return first.withColumn("confidence", F.when(F.col("fallback"), "low").otherwise("medium")).withColumn("severity", F.when(F.col("fallback"), "low"))
