"""Stored documents: ledger, memory, baseline, rule packs and the repository manifest.

Stores fail closed: an unknown version or an unknown field is an error, not a guess.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake import schemas

LEDGER_DOCUMENT = (
    "schemaVersion int, repositoryRoot string, createdAt string, updatedAt string, "
    "entries array<struct<id:string,fingerprint:struct<file:string,ruleId:string,category:string,contentAnchor:string>,"
    "status:string,history array<struct<timestamp:string,previousState:string,newState:string,comment:string>>,"
    "latestFinding:struct<title:string,severity:string,locations:array<struct<file:string,lines:struct<start:int,end:int>>>>,"
    "review:struct<createdBySessionId:string,lastUpdatedBySessionId:string>>>"
).replace("history array", "history:array")
MEMORY_DOCUMENT = (
    "schemaVersion int, repositoryRoot string, createdAt string, updatedAt string, "
    "items array<struct<id:string,category:string,status:string,rationale:string,ruleId:string,scopeFile:string,"
    "fingerprintFile:string,fingerprintRuleId:string,fingerprintCategory:string,updatedAt:string>>"
)
BASELINE_DOCUMENT = "schemaVersion int, createdAt string, entries array<struct<key:string,file:string,ruleId:string,title:string,count:bigint>>"

# --- fixed values: top-level fields of each stored document ---
FIELDS = {
    "ledger": ("schemaVersion", "repositoryRoot", "createdAt", "updatedAt", "entries"),
    "memory": ("schemaVersion", "repositoryRoot", "createdAt", "updatedAt", "items"),
    "baseline": ("schemaVersion", "createdAt", "entries"),
}
SCHEMA_VERSION = 1


def _checked(documents: DataFrame, kind: str) -> DataFrame:
    """``documents`` (repo, content): raises when a document has another version or a field this
    version does not know."""
    known = F.array(*[F.lit(f) for f in FIELDS[kind]])
    keys = F.json_object_keys("content")
    version = F.get_json_object("content", "$.schemaVersion").try_cast("int")
    fault = (
        F.when(keys.isNull(), F.concat(F.lit(f"{kind} is not a JSON object: "), "repo"))
        .when(F.coalesce(version, F.lit(-1)) != SCHEMA_VERSION, F.concat(F.lit(f"{kind} has another version: "), "repo"))
        .when(F.size(F.array_except(keys, known)) > 0, F.concat(F.lit(f"{kind} has unknown fields: "), F.array_join(F.array_except(keys, known), ", ")))
    )
    ok = F.when(fault.isNull(), F.col("content")).otherwise(F.raise_error(fault).cast("string"))
    return documents.select("repo", ok.alias("content"))


def ledger_documents(documents: DataFrame) -> DataFrame:
    parsed = _checked(documents, "ledger").select("repo", F.from_json("content", LEDGER_DOCUMENT, {"mode": "FAILFAST"}).alias("d"))
    rows = parsed.select("repo", F.posexplode("d.entries").alias("entry_ord", "e"))
    first = F.try_element_at("e.latestFinding.locations", F.lit(1))
    history = F.transform(
        "e.history",
        lambda h: F.struct(
            h["timestamp"].cast("timestamp").alias("timestamp"), h["previousState"].alias("previous_state"), h["newState"].alias("new_state"),
            F.lit(None).cast("string").alias("origin"), h["comment"].alias("comment"),
        ),
    )
    return rows.select(
        "repo", F.col("e.id").alias("entry_id"), F.col("e.fingerprint.file").alias("file"), F.col("e.fingerprint.ruleId").alias("rule_id"),
        F.col("e.fingerprint.category").alias("category"), F.col("e.fingerprint.contentAnchor").alias("anchor"), F.col("e.status").alias("status"),
        F.col("e.latestFinding.severity").alias("severity"), first["lines"]["start"].alias("line"), F.col("e.latestFinding.title").alias("title"),
        F.col("entry_ord").cast("long").alias("entry_ord"), F.col("e.review.createdBySessionId").alias("created_session"),
        F.col("e.review.lastUpdatedBySessionId").alias("updated_session"), history.alias("history"),
    )


def memory_documents(documents: DataFrame) -> DataFrame:
    parsed = _checked(documents, "memory").select("repo", F.from_json("content", MEMORY_DOCUMENT, {"mode": "FAILFAST"}).alias("d"))
    rows = parsed.select("repo", F.posexplode("d.items").alias("item_ord", "i"))
    return rows.select(
        "repo", F.col("i.id").alias("item_id"), F.col("i.category").alias("kind"), F.coalesce("i.fingerprintFile", "i.scopeFile").alias("file"),
        F.coalesce("i.fingerprintRuleId", "i.ruleId").alias("rule_id"), F.col("i.fingerprintCategory").alias("category"), F.col("i.status").alias("status"),
        F.col("item_ord").cast("long").alias("item_ord"), F.col("i.rationale").alias("rationale"),
    )


def baseline_documents(documents: DataFrame) -> DataFrame:
    parsed = _checked(documents, "baseline").select("repo", F.from_json("content", BASELINE_DOCUMENT, {"mode": "FAILFAST"}).alias("d"))
    return parsed.select("repo", F.explode("d.entries").alias("e")).select("repo", "e.key", "e.file", F.col("e.ruleId").alias("rule_id"), "e.title", "e.count")


def read_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole files as (repo, content); the repository is the file's parent directory name."""
    raw = spark.read.text(pattern, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return raw.select(F.element_at(F.split("path", "/"), -2).alias("repo"), F.col("value").alias("content"))


def _toml_json(batches: Iterator) -> Iterator:
    import tomllib

    for batch in batches:
        batch["document"] = [json.dumps(tomllib.loads(text), default=str) for text in batch["content"]]
        yield batch[["path", "document"]]


PACK = (
    "struct<id:string,version:string,kind:string,rules:array<struct<id:string,statement:string,category:string,defaultSeverity:string,"
    "appliesTo:struct<type:string,language:string,framework:string,pattern:string>,contradicts:array<string>,knowledge:array<string>>>,"
    "dependsOn:array<struct<type:string,packId:string,versionRange:string,skillId:string>>>"
)


def read_packs(spark: SparkSession, pattern: str) -> DataFrame:
    """Rule packs as nested rows. JSON is read as is; TOML has no Spark reader, so each file's
    text becomes JSON in an Arrow batch and the rest is native."""
    raw = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    documents = raw.where("path LIKE '%.json'").select("path", F.col("content").alias("document"))
    toml = raw.where("path LIKE '%.toml'").mapInPandas(_toml_json, "path string, document string")
    return documents.unionByName(toml).select("path", F.from_json("document", PACK).alias("p")).select("path", "p.*")


def pack_rules(packs: DataFrame) -> DataFrame:
    rows = packs.select(F.col("id").alias("pack"), "version", F.posexplode("rules").alias("rule_ord", "r"))
    scope = F.regexp_replace(F.coalesce("r.appliesTo.type", F.lit("always")), "^requires-", "")
    return rows.select(
        "pack", "version", "rule_ord", F.col("r.id").alias("rule_id"), F.col("r.statement").alias("statement"), F.col("r.category").alias("category"),
        F.col("r.defaultSeverity").alias("severity"), scope.alias("scope"),
        F.coalesce("r.appliesTo.language", "r.appliesTo.framework", "r.appliesTo.pattern").alias("wanted"),
        F.coalesce("r.contradicts", F.array().cast("array<string>")).alias("contradicts"),
    )


def pack_dependencies(packs: DataFrame) -> DataFrame:
    rows = packs.select(F.col("id").alias("pack"), "version", F.posexplode("dependsOn").alias("dep_ord", "d"))
    return rows.where("d.packId IS NOT NULL").select("pack", "version", "dep_ord", F.col("d.packId").alias("dep_pack"), F.col("d.versionRange").alias("range"))


MANIFEST = "comment string, generated string, repositories array<struct<name:string,url:string,commit:string,license:string,origin:string,languagesKB:map<string,bigint>>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Pinned repositories, one row each."""
    raw = spark.read.schema(MANIFEST).json(path, multiLine=True, mode="FAILFAST")
    return raw.select(F.explode("repositories").alias("r")).select("r.*")


def empty(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], {"ledger": schemas.LEDGER, "memory": schemas.MEMORY, "baseline": schemas.BASELINE}[kind])
