"""Word lists, patterns and formats results must agree with."""

# --- fixed values: severities, most serious first ---
SEVERITIES = ("critical", "high", "medium", "low", "informational")
CONFIDENCES = ("high", "medium", "low")

# --- fixed values: credential formats that identify themselves ---
KNOWN_TOKEN_PATTERNS = (
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{50,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\b(?:sk|rk)_live_[A-Za-z0-9]{16,}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
    r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}\b",
)
# A text without any of these holds no credential of the formats above.
KNOWN_TOKEN_MARKS = (
    "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "_live_", "AIza",
    "PRIVATE KEY-----", "eyJ", "SG.",
)
REDACTED = "[redacted]"
EXCERPT_UNITS = 200

# --- fixed values: paths a review does not own ---
IGNORED_DIRS = (
    "node_modules", "vendor", "bower_components", "jspm_packages", "Pods", "Carthage",
    "target", "build", "dist", "out", "coverage", "__pycache__", "site-packages", "venv",
    "obj", ".gradle", ".dart_tool", ".next", ".nuxt", ".svelte-kit", ".turbo", ".venv",
)
BUILD_OUTPUT_DIRS = ("bin", "obj")
BUILD_MARKERS = (
    "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts",
    "pom.xml", "Makefile", "CMakeLists.txt",
)
PROJECT_FILE_PATTERN = r"(?i)\.(csproj|fsproj|vbproj|sln)$"
GENERATED_NAME_PATTERN = (
    r"(?i)(\.min\.[a-z]+$|\.bundle\.[a-z]+$|\.generated\.[a-z]+$|\.g\.dart$|\.freezed\.dart$"
    r"|\.pb\.go$|_pb2\.py$|\.d\.ts$|\.map$)"
)
TEST_PATH_PATTERN = (
    r"(?i)(^|/)(__tests__|tests?|specs?|__mocks__|mocks?|fixtures?|e2e|testdata|androidTest"
    r"|(jvm|common|ios|native|js|desktop|wasmJs)Test)(/|$)|\.(test|spec)\.[a-z]+$"
    r"|_test\.(go|py|dart|exs|rb|cc|cpp)$|_spec\.rb$|(^|/)(test_[^/]*|conftest)\.py$"
)
TEST_CLASS_PATTERN = r"[a-z0-9](Test|Tests|IT)\.(kt|java|cs|php|swift)$"
GENERATED_HEAD_PATTERN = r"(?i)@generated|DO NOT EDIT|auto-?generated|this file (?:was|is) generated"
GENERATED_HEAD_LINES = 8
MINIFIED_MIN_UNITS = 2000
MINIFIED_LONGEST_LINE = 1000
MINIFIED_AVERAGE_LINE = 300

# --- fixed values: the size gate (1 MiB) and the scanned extensions ---
MAX_FILE_BYTES = 1024 * 1024
SCAN_EXTENSIONS = (
    "ts", "tsx", "js", "jsx", "mjs", "cjs", "dart", "rs", "go", "py", "kt", "kts", "php", "cs",
    "java", "vue", "svelte", "rb", "ex", "exs", "swift", "cpp", "cc", "cxx", "hpp", "hh", "hxx",
    "gd", "astro",
)

# --- fixed values: languages that share the concept table of the first ---
SCRIPT_FAMILY = ("javascript", "jsx", "typescript", "tsx", "vue", "svelte", "astro")

# --- fixed values: lifecycle states and the moves each one allows ---
LEDGER_STATES = ("open", "acknowledged", "resolved", "dismissed", "reopened")
LEDGER_ACTIVE = ("open", "acknowledged", "reopened")
LEDGER_MOVES = {
    "open": ("acknowledged", "resolved", "dismissed"),
    "acknowledged": ("resolved", "dismissed"),
    "resolved": ("reopened",),
    "dismissed": ("reopened",),
    "reopened": ("acknowledged", "resolved", "dismissed"),
}
MEMORY_STATES = ("detected", "suggested", "confirmed", "active", "deprecated", "archived")
MEMORY_MOVES = {
    "detected": ("suggested", "archived"),
    "suggested": ("confirmed", "archived"),
    "confirmed": ("active", "archived"),
    "active": ("deprecated", "archived"),
    "deprecated": ("active", "archived"),
    "archived": (),
}
MEMORY_ACTIONS = {
    "suggest": "suggested", "confirm": "confirmed", "activate": "active", "reject": "archived",
    "deprecate": "deprecated", "reactivate": "active", "archive": "archived",
}
SESSION_STATES = ("requested", "prepared", "running", "completed", "failed", "cancelled")
SESSION_MOVES = {
    "requested": ("prepared", "cancelled"),
    "prepared": ("running", "failed", "cancelled"),
    "running": ("completed", "failed", "cancelled"),
    "completed": (),
    "failed": (),
    "cancelled": (),
}
