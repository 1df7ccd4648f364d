"""Finding identity: rule ids, anchors, fingerprints, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_anchor(excerpt: Column) -> Column:
    """First 16 hex digits of the excerpt's hash; null without an excerpt."""
    return F.substring(F.sha2(excerpt, 256), 1, 16)


def first_code_excerpt(evidence: Column) -> Column:
    """Excerpt of the first code evidence that carries one."""
    codes = F.filter(evidence, lambda e: (e["kind"] == "code") & e["excerpt"].isNotNull())
    return F.try_element_at(codes, F.lit(1))["excerpt"]


def rule_id_from_evidence(evidence: Column) -> Column:
    """The first evidence that names a rule decides: a pack rule or criterion by its id, an
    analyzer as ``tool:rule``, a model detection as ``semantic:topic``."""

    def named(e: Column) -> Column:
        return (
            F.when(e["kind"].isin("review-pack-rule", "criteria"), e["rule_id"])
            .when(e["kind"] == "external-analyzer", F.concat_ws(":", e["tool"], e["rule_id"]))
            .when(
                (e["kind"] == "semantic-review") & (e["role"] == "detection") & (e["topic"] != ""),
                F.concat(F.lit("semantic:"), e["topic"]),
            )
        )

    return F.try_element_at(F.filter(F.transform(evidence, named), lambda r: r.isNotNull()), F.lit(1))


def identity(rule_id: Column, category: Column) -> Column:
    """Ledger identity inside a file: the rule, or the category of a finding without a rule."""
    return F.coalesce(F.concat(F.lit("r:"), rule_id), F.concat(F.lit("c:"), category))


def baseline_key(file: Column, rule_id: Column, anchor: Column) -> Column:
    return F.concat_ws("::", file, F.coalesce(rule_id, F.lit("")), F.coalesce(anchor, F.lit("")))


def entry_id(repo: Column, file: Column, ident: Column, session: Column) -> Column:
    """Deterministic ledger entry id, so a replayed batch writes the same entry."""
    return F.substring(F.sha2(F.concat_ws("|", repo, file, ident, session.cast("string")), 256), 1, 32)


def gitlab_fingerprint(rule: Column, file: Column, line: Column, title: Column) -> Column:
    text = F.concat_ws("\u0000", rule, file, F.coalesce(line.cast("string"), F.lit("")), title)
    return F.substring(F.sha2(text, 256), 1, 32)


def canonical_hash(struct: Column) -> Column:
    """Hash of a struct's JSON text; callers list fields in alphabetical order."""
    return F.substring(F.sha2(F.to_json(struct, {"ignoreNullFields": "true"}), 256), 1, 16)
