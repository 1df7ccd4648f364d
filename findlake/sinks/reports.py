"""Reports as ordered text rows.

A report of one repository may hold any number of findings, so no report is built inside one
row or task. Each operator returns ``(repo, section, ord, text)``; ``write_lines`` range-partitions
by that order, so the part files of a repository, read in name order, are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.identity import gitlab_fingerprint
from findlake.functions.severity import SEVERITIES, severity_rank
from findlake.operators.ordered import top_per_key

# --- fixed values: severities in the words other systems use ---
GITLAB = {"informational": "info", "low": "minor", "medium": "major", "high": "critical", "critical": "blocker"}
ANNOTATION = {"critical": "error", "high": "error", "medium": "warning", "low": "notice", "informational": "notice"}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "informational": "note"}
MARKER = "<!-- findings-report -->"


def _word(table: dict[str, str], column: Column) -> Column:
    chain = F.lit(None).cast("string")
    for key, value in table.items():
        chain = F.when(column == key, value).otherwise(chain)
    return chain


def rule_name() -> Column:
    return F.coalesce("rule_id", "category")


def severity_sorted(findings: DataFrame) -> DataFrame:
    """Most serious first, ties in finding order."""
    return findings.orderBy("repo", severity_rank(F.col("severity")), "ord")


def json_report(findings: DataFrame) -> DataFrame:
    """One JSON object per finding."""
    fields = [c for c in findings.columns if c not in ("repo", "ord")]
    return findings.select("repo", F.lit(1).alias("section"), "ord", F.to_json(F.struct(*fields)).alias("text"))


def gitlab_rows(findings: DataFrame) -> DataFrame:
    rule = rule_name()
    return findings.select(
        "repo",
        "ord",
        F.col("title").alias("description"),
        rule.alias("check_name"),
        gitlab_fingerprint(rule, F.col("file"), F.col("line"), F.col("title")).alias("fingerprint"),
        _word(GITLAB, F.col("severity")).alias("severity"),
        F.struct(F.replace(F.col("file"), F.lit("\\"), F.lit("/")).alias("path"), F.struct(F.coalesce("line", F.lit(1)).alias("begin")).alias("lines")).alias("location"),
    )


def _array_document(rows: DataFrame, opening: str, closing: str, repos: DataFrame | None = None) -> DataFrame:
    """JSON array elements as lines: every element but the first is led by a comma. Each repository
    of ``repos`` has a document, also without a row."""
    first = rows.groupBy("repo").agg(F.min("ord").alias("first"))
    led = rows.join(first, "repo").select(
        "repo", F.lit(1).alias("section"), "ord", F.when(F.col("ord") == F.col("first"), F.col("text")).otherwise(F.concat(F.lit(","), "text")).alias("text")
    )
    named = first.select("repo") if repos is None else first.select("repo").unionByName(repos.select("repo")).distinct()
    edge = named.select("repo", F.explode(F.array(F.struct(F.lit(0).alias("section"), F.lit(opening).alias("text")), F.struct(F.lit(2).alias("section"), F.lit(closing).alias("text")))).alias("e"))
    return led.unionByName(edge.select("repo", "e.section", F.lit(0).cast("long").alias("ord"), "e.text"))


def gitlab_report(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    rows = gitlab_rows(findings)
    body = F.to_json(F.struct("description", "check_name", "fingerprint", "severity", "location"))
    return _array_document(rows.select("repo", "ord", body.alias("text")), "[", "]", repos)


def _data(value: Column) -> Column:
    for plain, coded in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        value = F.replace(value, F.lit(plain), F.lit(coded))
    return value


def _property(value: Column) -> Column:
    value = _data(value)
    for plain, coded in ((":", "%3A"), (",", "%2C")):
        value = F.replace(value, F.lit(plain), F.lit(coded))
    return value


def github_annotations(findings: DataFrame, explanation: Column | None = None) -> DataFrame:
    """Workflow commands, one per finding."""
    line = F.col("line").cast("string")
    place = F.when(F.col("line").isNotNull(), F.concat(F.lit(",line="), line, F.lit(",endLine="), line)).otherwise("")
    title = _property(F.concat("title", F.lit(" ("), rule_name(), F.lit(")")))
    body = _data(explanation if explanation is not None else F.col("title"))
    text = F.concat(F.lit("::"), _word(ANNOTATION, F.col("severity")), F.lit(" file="), _property(F.col("file")), place, F.lit(",title="), title, F.lit("::"), body)
    return findings.select("repo", F.lit(1).alias("section"), "ord", text.alias("text"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules in first-seen order with the first finding's title."""
    return findings.groupBy("repo", rule_name().alias("rule")).agg(F.min("ord").alias("ord"), F.min_by("title", "ord").alias("title"))


def sarif_report(findings: DataFrame, tool: str = "findlake", version: str = "1.0.0", repos: DataFrame | None = None) -> DataFrame:
    """SARIF 2.1.0 as lines: rules and results stream in order between fixed opening lines. Columns
    ``recommendation`` and ``confidence`` of the findings, where there are, become a rule's help and
    precision. ``repos`` (repo) lists the repositories reviewed: each has a document."""
    extra = [c for c in ("recommendation", "confidence") if c in findings.columns]
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in extra]
    rules = sarif_rules(findings)
    if extra:
        rules = rules.join(findings.groupBy("repo", rule_name().alias("rule")).agg(*firsts), ["repo", "rule"])
    parts = [F.col("rule").alias("id"), F.col("rule").alias("name"), F.struct(F.col("title").alias("text")).alias("shortDescription")]
    if "recommendation" in extra:
        parts.append(F.when(F.col("recommendation").isNotNull(), F.struct(F.col("recommendation").alias("text"))).alias("help"))
    if "confidence" in extra:
        parts.append(F.when(F.col("confidence").isNotNull(), F.struct(F.col("confidence").alias("precision"))).alias("properties"))
    rule_text = F.to_json(F.struct(*parts))
    line = F.col("line")
    region = F.when(line.isNotNull(), F.struct(line.alias("startLine"), line.alias("endLine")))
    artifact = F.struct(F.replace(F.col("file"), F.lit("\\"), F.lit("/")).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId"))
    location = F.struct(F.struct(artifact.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.to_json(
        F.struct(
            rule_name().alias("ruleId"),
            _word(SARIF_LEVEL, F.col("severity")).alias("level"),
            F.struct(F.concat("title", F.lit(".")).alias("text")).alias("message"),
            F.array(location).alias("locations"),
            F.struct("severity", "category").alias("properties"),
        )
    )
    opening = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":['
    first = _array_document(rules.select("repo", "ord", rule_text.alias("text")), opening, ']}},"results":[', repos)
    second = _array_document(findings.select("repo", "ord", result.alias("text")), "", "]}]}", repos)
    return first.unionByName(second.withColumn("section", F.col("section") + 3))


def _cell(value: Column) -> Column:
    flat = F.regexp_replace(value, r"\r\n|\n|\r", " ")
    return F.replace(F.replace(flat, F.lit("|"), F.lit("\\|")), F.lit("<"), F.lit("&lt;"))


def _place() -> Column:
    return F.concat("file", F.when(F.col("line").isNotNull(), F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))


def markdown_report(findings: DataFrame, rows: int | None = None) -> DataFrame:
    """A comment: counts first, then the findings in a table, the most serious first. With ``rows``
    only so many, and how many more there are."""
    counted = findings.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )
    parts = F.array_compact(F.array(*[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in SEVERITIES]))
    total = F.concat(F.lit("**"), F.col("n").cast("string"), F.when(F.col("n") == 1, " finding**: ").otherwise(" findings**: "), F.array_join(parts, ", "))
    head = F.array(F.lit(MARKER), F.lit("## Review findings"), F.lit(""), total, F.lit(""), F.lit("| Severity | Where | Finding | Rule |"), F.lit("| --- | --- | --- | --- |"))
    order = [severity_rank(F.col("severity")), F.col("ord")]
    top = findings if rows is None else top_per_key(findings, ["repo"], order, rows)
    row = F.concat(F.lit("| "), "severity", F.lit(" | `"), _cell(_place()), F.lit("` | "), _cell(F.col("title")), F.lit(" | "), _cell(rule_name()), F.lit(" |"))
    page = (
        counted.select("repo", F.lit(0).alias("section"), F.posexplode(head).alias("ord", "text"))
        .withColumn("ord", F.col("ord").cast("long"))
        .unionByName(top.select("repo", (severity_rank(F.col("severity")) + 1).cast("int").alias("section"), F.col("ord").cast("long").alias("ord"), row.alias("text")))
    )
    if rows is None:
        return page
    more = F.concat(F.lit("…and "), (F.col("n") - rows).cast("string"), F.lit(" more."))
    return page.unionByName(counted.where(F.col("n") > rows).select("repo", F.lit(len(SEVERITIES) + 1).alias("section"), F.lit(0).cast("long").alias("ord"), more.alias("text")))


def text_report(findings: DataFrame) -> DataFrame:
    """Every finding on a line, most serious first, then the count."""
    line = F.concat(F.rpad("severity", 13, " "), F.lit(" "), _place(), F.lit("  "), "title", F.lit("  ("), rule_name(), F.lit(")"))
    ranked = severity_rank(F.col("severity")).cast("int")
    counts = findings.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    tail = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " finding.").otherwise(" findings."))
    return findings.select("repo", ranked.alias("section"), "ord", line.alias("text")).unionByName(
        counts.select("repo", F.lit(len(SEVERITIES)).alias("section"), F.lit(0).cast("long").alias("ord"), tail.alias("text"))
    )


def write_lines(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write ordered lines, a folder per repository. Range partitioning splits a repository that
    holds most of the rows across tasks; names of part files keep the order."""
    keys = ["repo", "section", "ord"]
    spread = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).select("repo", "text").write.partitionBy("repo").mode("overwrite").text(path)
