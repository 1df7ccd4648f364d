"""Secret candidates: a literal given to a secret-looking name, judged by its shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findlake.functions.text import shannon_entropy

# --- fixed values: names, and what a value must not look like ---
NAMED_LITERAL = (
    r"(?i)([A-Za-z0-9_.-]*(?:secret|token|password|passwd|api_?key|private_?key|credential)[A-Za-z0-9_.-]*)"
    r"[\"']?\s*(?::=|=>|=|:)\s*[\"'`]([^\"'`\n]+)[\"'`]"
)
PLACEHOLDER = r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|your[_-].*|change[_-]?me.*|example.*|dummy.*|test.*|todo|none|null|undefined)$"
NOT_A_SECRET = (
    r"^https?://", r"^[./~]", r"\s", r"^--", r"\.$", r"^\$(?:argon2|2[aby]\$|pbkdf2|scrypt\$|5\$|6\$)", r"\|", r"[\[\]()]", r"^\$[A-Za-z]",
)
MIN_LENGTH = 8
MIN_ENTROPY = 3.0


def secret_like(value: Column) -> Column:
    """Long and random enough, and not a placeholder, path, URL, sentence, hash or pattern."""
    odd = value.rlike("|".join(f"(?:{p})" for p in NOT_A_SECRET)) | value.rlike(PLACEHOLDER)
    return (F.length(value) >= MIN_LENGTH) & ~odd & (shannon_entropy(value) >= MIN_ENTROPY)


def named_literals(text: Column) -> Column:
    """``array<struct<name,value>>`` of the assignments in a text that pass the judgment."""
    names = F.regexp_extract_all(text, F.lit(NAMED_LITERAL), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(NAMED_LITERAL), F.lit(2))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    return F.filter(pairs, lambda p: secret_like(p["value"]))
