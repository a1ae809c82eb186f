"""Issues as Markdown files with JSON sidecars, and manifests of batches of them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.names import COLUMNS, newspaper_columns, source_identifiers
from lectern.functions.text import arrow_udf, stable_id

SIDECAR = "_metadata.json"
MANIFEST_FORMAT = "lectern.batch.v1"


def _strict(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a JSON object repeats a key")
    return found


def strict_json(text: str) -> object:
    """JSON without repeated keys, NaN or infinities."""

    def refuse(name: str):
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, object_pairs_hook=_strict, parse_constant=refuse)


def sidecar_columns(text: str) -> dict:
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("a sidecar must be a JSON object")
    return newspaper_columns(found) | {"identifiers": source_identifiers(found)}


_STRUCT = "struct<" + ",".join(f"{c}:string" for c in COLUMNS) + ",identifiers:array<string>>"
sidecar_col = arrow_udf(sidecar_columns, _STRUCT)


def read_issues(spark: SparkSession, folder: str) -> DataFrame:
    """One row per Markdown file below ``folder`` (``*_metadata.md`` apart), with its sidecar's columns,
    nulls where it has none, and the newspaper's name as its folder gives it."""
    options = {"wholetext": "true", "recursiveFileLookup": "true"}
    text = lambda pattern: spark.read.format("text").options(pathGlobFilter=pattern, **options).load(folder).withColumn("file", F.col("_metadata.file_path"))
    root = F.lit("/" + folder.split("://", 1)[-1].strip("/") + "/")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), "^[a-z0-9]+:/*", "/")
    relative = F.substring(path, F.length(root) + 1, F.length(path))
    files = text("*.md").where(~F.col("file").endswith("_metadata.md")).select(F.regexp_replace("value", "\r\n?", "\n").alias("content"), relative.alias("relative_path"))
    files = files.withColumn("stem", F.regexp_replace("relative_path", r"\.md$", ""))
    sidecars = text("*" + SIDECAR).select(F.col("value").alias("metadata_json"), F.regexp_replace(relative, re.escape(SIDECAR) + "$", "").alias("stem"))
    joined = files.join(sidecars, "stem", "left")
    parts = F.split("relative_path", "/")
    inferred = F.when(F.size(parts) > 1, F.regexp_replace(F.element_at(parts, -2), "_", " "))
    named = joined.withColumn("m", sidecar_col("metadata_json")).withColumn("newspaper", inferred)
    return named.select(stable_id("newspaper", F.col("relative_path")).alias("newspaper_id"), "relative_path", "content", "newspaper", "metadata_json", *[F.col(f"m.{c}").alias(c) for c in COLUMNS], F.coalesce("m.identifiers", F.array().cast("array<string>")).alias("identifiers"))


@dataclass(frozen=True)
class BatchIssue:
    relative_path: str
    markdown_path: str
    metadata_path: str | None
    markdown_sha256: str
    metadata_sha256: str | None
    source_identifier: str | None = None


_REQUIRED = {f.name for f in fields(BatchIssue)} - {"source_identifier"}
_DIGEST = re.compile("[a-f0-9]{64}")


def portable(path: str) -> bool:
    """A relative path with forward slashes that stays within its folder on any system."""
    parts = PurePosixPath(path).parts
    return bool(path) and "\\" not in path and ":" not in path and not path.startswith("/") and ".." not in parts and "/".join(parts) == path


def load_manifest(text: str) -> tuple[str, list[BatchIssue]]:
    """(batch id, issues) of a manifest; anything unexpected in it is an error."""
    found = strict_json(text)
    if not isinstance(found, dict) or set(found) != {"format", "batch_id", "issues"} or found["format"] != MANIFEST_FORMAT:
        raise ValueError("the manifest's fields aren't those of its format")
    if not isinstance(found["batch_id"], str) or not re.fullmatch(r"[A-Za-z0-9][\w.-]{0,127}", found["batch_id"]):
        raise ValueError("the batch id must be a short name")
    if not isinstance(found["issues"], list) or not found["issues"]:
        raise ValueError("a manifest lists at least one issue")
    issues = []
    for x in found["issues"]:
        if not isinstance(x, dict) or not _REQUIRED <= set(x) <= _REQUIRED | {"source_identifier"}:
            raise ValueError("an issue's fields aren't those of its format")
        if not all(portable(x[k]) for k in ("relative_path", "markdown_path")) or not (x["metadata_path"] is None or portable(x["metadata_path"])):
            raise ValueError("paths must be relative and portable")
        if (x["metadata_path"] is None) != (x["metadata_sha256"] is None) or not all(x[k] is None or _DIGEST.fullmatch(x[k]) for k in ("markdown_sha256", "metadata_sha256")):
            raise ValueError("each file needs its SHA-256")
        issues.append(BatchIssue(**x))
    paths = [x.relative_path.casefold() for x in issues]
    if len(set(paths)) != len(paths):
        raise ValueError("a path is listed twice")
    return found["batch_id"], issues


def read_batch(spark: SparkSession, root: str, batch_id: str, issues: list[BatchIssue]) -> DataFrame:
    """The manifest's issues with their content, or an ``error`` where the file is missing, its hash
    differs, it isn't UTF-8 or it is blank."""
    listed = spark.createDataFrame(pd.DataFrame([x.__dict__ for x in issues]), "relative_path string, markdown_path string, metadata_path string, markdown_sha256 string, metadata_sha256 string, source_identifier string")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    where = F.lit(root.split("://", 1)[-1].rstrip("/") + "/")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^[a-z0-9]+:/*", "/")
    files = raw.select(F.substring(path, F.length(where) + 1, F.length(path)).alias("p"), F.sha2("content", 256).alias("sha"), F.col("content").alias("bytes"))
    markdown = files.select(F.col("p").alias("markdown_path"), F.col("sha").alias("md_sha"), F.col("bytes").alias("md"))
    sidecars = files.select(F.col("p").alias("metadata_path"), F.col("sha").alias("js_sha"), F.col("bytes").alias("js"))
    joined = listed.join(markdown, "markdown_path", "left").join(sidecars, "metadata_path", "left")
    problem = (
        F.when(F.col("md").isNull(), "missing")
        .when(F.col("md_sha") != F.col("markdown_sha256"), "hash")
        .when(F.col("metadata_path").isNotNull() & (F.col("js").isNull() | (F.col("js_sha") != F.col("metadata_sha256"))), "metadata")
        .when(~F.is_valid_utf8(F.col("md").cast("string")), "encoding")
        .when(F.trim(F.regexp_replace(F.col("md").cast("string"), r"\s+", "")) == "", "blank")
    )
    return joined.select(F.lit(batch_id).alias("batch_id"), "relative_path", "source_identifier", "markdown_sha256", "metadata_sha256", problem.alias("error"), F.when(problem.isNull(), F.regexp_replace(F.col("md").cast("string"), "\r\n?", "\n")).alias("content"), F.when(problem.isNull(), F.col("js").cast("string")).alias("metadata_json"))
