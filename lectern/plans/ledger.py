"""Batches of issues: classification, staged appends with completion markers, and publication.

Tables are Parquet folders under one root. A stage appends only rows whose keys it lacks and then marks the
batch's issues complete, so a stage that was cut off is run again without doing anything twice. One small
pointer file, replaced by a rename, says what readers see.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from os import fsync
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.names import COLUMNS
from lectern.functions.text import stable_id
from lectern.operators import chunking, relational
from lectern.sources.markdown import sidecar_col

ISSUES = "newspaper_id string, relative_path string, content string, content_sha256 string, metadata_json string, metadata_sha256 string, batch_id string, " + ", ".join(f"{c} string" for c in COLUMNS) + ", identifiers array<string>"
STAGED = "batch_id string, newspaper_id string, stage string, content_sha256 string, rows long"
STAGES = ("issues", "articles", "chunks")
_HEX = re.compile(r"[0-9a-f]{16,64}")


class StaleInput(ValueError):
    """What a step was given isn't what the tables hold."""


class Archive:
    def __init__(self, spark: SparkSession, root: str):
        if "://" in root and not root.startswith("file:"):
            raise ValueError("an archive's lock, epoch and pointer need a file system that all drivers mount, such as file:///shared")
        self.spark, self.root = spark, root.rstrip("/")
        self.local = Path(re.sub("^file:/*", "/", self.root))

    def read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def append(self, table: str, rows: DataFrame, key: str | list[str], schema: str) -> int:
        """Adds the rows whose key the table lacks; how many it was."""
        names = [c.split()[0] for c in re.split(r", (?![^<]*>)", schema)]
        new = relational.pending(rows.select(*names), self.read(table, schema).select(key) if isinstance(key, str) else self.read(table, schema).select(*key), key)
        before = self.read(table, schema).count()
        new.write.mode("append").parquet(f"{self.root}/{table}")
        return self.read(table, schema).count() - before

    # planning

    def current_issues(self) -> DataFrame:
        """The latest version of each issue's row."""
        rows = self.read("issues", ISSUES + ", version long")
        return rows.groupBy("newspaper_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "newspaper_id"]), "version").alias("r")).select("newspaper_id", "r.*")

    def plan(self, batch: DataFrame) -> DataFrame:
        """(relative_path, action): new, unchanged, metadata_changed, conflict, or invalid where the file
        failed its checks. Content never changes; an identifier belongs to one issue."""
        keyed = batch.withColumn("newspaper_id", stable_id("newspaper", F.col("relative_path"))).withColumn("ids", F.coalesce(sidecar_col("metadata_json").getField("identifiers"), F.array().cast("array<string>")))
        known = self.current_issues()
        old = known.select("newspaper_id", F.col("content_sha256").alias("old_content"), F.col("metadata_sha256").alias("old_metadata"))
        owners = known.select(F.col("newspaper_id").alias("owner"), F.explode("identifiers").alias("id"))
        taken = keyed.select("newspaper_id", F.explode("ids").alias("id"))
        elsewhere = taken.join(owners, "id").where("owner != newspaper_id").select("newspaper_id")
        twice = taken.join(taken.groupBy("id").agg(F.countDistinct("newspaper_id").alias("n")).where("n > 1"), "id").select("newspaper_id")
        clash = elsewhere.union(twice).distinct().withColumn("clash", F.lit(True))
        joined = keyed.join(old, "newspaper_id", "left").join(clash, "newspaper_id", "left")
        action = (
            F.when(F.col("error").isNotNull(), "invalid")
            .when(F.col("clash"), "conflict")
            .when(F.col("old_content").isNull(), "new")
            .when(F.col("old_content") != F.sha2(F.col("content").cast("binary"), 256), "conflict")
            .when(F.col("old_metadata").eqNullSafe(F.col("metadata_sha256")), "unchanged")
            .otherwise("metadata_changed")
        )
        return joined.select("newspaper_id", "relative_path", action.alias("action"), "error")

    # stages

    def run(self, batch: DataFrame, batch_id: str, stages: tuple[str, ...] = STAGES, offsets: Callable = chunking.whitespace_offsets, count: int = 256, overlap: int = 64, skip_tables: bool = False) -> dict[str, int]:
        """Stores a verified batch. Nothing is written if the plan holds a conflict or an invalid file."""
        with self.lock():
            self._same_config("chunking", {"count": count, "overlap": overlap, "skip_tables": skip_tables})
            plan = self.plan(batch)
            bad = plan.where("action in ('conflict', 'invalid')").limit(5).collect()
            if bad:
                raise StaleInput("the batch can't be stored: " + ", ".join(f"{r.relative_path}: {r.action}" for r in bad))
            self.bump_epoch()
            done = {}
            if "issues" in stages:
                changed = plan.where("action in ('new', 'metadata_changed')").select("newspaper_id", "action")
                rows = batch.withColumn("newspaper_id", stable_id("newspaper", F.col("relative_path"))).join(changed, "newspaper_id").withColumn("m", sidecar_col("metadata_json"))
                rows = rows.select("newspaper_id", "relative_path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"), "metadata_json", "metadata_sha256", F.lit(batch_id).alias("batch_id"), *[F.col(f"m.{c}").alias(c) for c in COLUMNS], F.coalesce("m.identifiers", F.array().cast("array<string>")).alias("identifiers"), F.lit(self.epoch()).cast("long").alias("version"))
                before = self.read("issues", ISSUES + ", version long").count()
                rows.write.mode("append").parquet(f"{self.root}/issues")
                done["issues"] = self.read("issues", ISSUES + ", version long").count() - before
                self._mark(batch_id, "issues", batch)
            own = batch.select(stable_id("newspaper", F.col("relative_path")).alias("newspaper_id"))
            issues = self.current_issues().join(own, "newspaper_id", "left_semi")
            if "articles" in stages:
                done["articles"] = self.append("articles", chunking.split_articles(issues), "article_id", chunking.ARTICLES)
                self._mark(batch_id, "articles", batch)
            if "chunks" in stages:
                articles = self.read("articles", chunking.ARTICLES).join(own, "newspaper_id", "left_semi")
                done["chunks"] = self.append("chunks", chunking.chunk_articles(articles, issues, offsets, count, overlap, skip_tables), "chunk_id", chunking.CHUNKS)
                self._mark(batch_id, "chunks", batch)
            return done

    def _mark(self, batch_id: str, stage: str, batch: DataFrame) -> None:
        rows = batch.select(F.lit(batch_id).alias("batch_id"), stable_id("newspaper", F.col("relative_path")).alias("newspaper_id"), F.lit(stage).alias("stage"), F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"), F.lit(0).cast("long").alias("rows"))
        self.append("staged", rows, ["batch_id", "newspaper_id", "stage"], STAGED)

    def status(self, batch_id: str) -> DataFrame:
        """By stage: issues of the batch that it covers, and that it lacks."""
        own = self.read("staged", STAGED).where(F.col("batch_id") == batch_id)
        total = own.where("stage = 'issues'").count()
        return own.groupBy("stage").agg(F.countDistinct("newspaper_id").alias("completed")).withColumn("pending", F.lit(total) - F.col("completed"))

    def audit(self) -> DataFrame:
        """(check, problems): what the tables must not hold. All zero for a sound archive."""
        articles, chunks, issues = self.read("articles", chunking.ARTICLES), self.read("chunks", chunking.CHUNKS), self.current_issues()
        again = chunking.split_articles(issues)
        sliced = articles.join(issues.select("newspaper_id", F.col("content").alias("source")), "newspaper_id")
        inside = F.expr("substring(source, content_start + 1, char_end - content_start)") != F.col("content")
        checks = {
            "articles without an issue": relational.pending(articles, issues, "newspaper_id"),
            "articles that their issue doesn't give": relational.pending(articles, again, "article_id"),
            "articles that are missing": relational.pending(again, articles, "article_id"),
            "articles that differ from their span": sliced.where(inside),
            "chunks without an article": relational.pending(chunks, articles, "article_id"),
            "chunks out of order": relational.gaps(chunks.withColumn("chunk_index", F.col("chunk_index").cast("long")), "article_id", "chunk_index"),
            "chunk ids used twice": chunks.groupBy("chunk_id").count().where("count > 1"),
        }
        out = None
        for name, rows in checks.items():
            one = rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("problems"))
            out = one if out is None else out.unionByName(one)
        return out

    # configuration, epoch, lock, pointer

    def _same_config(self, name: str, config: dict) -> None:
        """A stage's configuration can't change once it has written anything."""
        path = self.local / f"{name}.json"
        if path.exists():
            if json.loads(path.read_text()) != config:
                raise StaleInput(f"the archive was built with another {name} configuration")
        else:
            write_once(path, config)

    def epoch(self) -> int:
        path = self.local / "epoch.json"
        return json.loads(path.read_text())["epoch"] if path.exists() else 0

    def bump_epoch(self) -> int:
        """Invalidates what was published before anything is written."""
        value = self.epoch() + 1
        replace(self.local / "epoch.json", {"epoch": value})
        return value

    @contextmanager
    def lock(self):
        """One writer at a time; a lock that a dead process left is taken over."""
        path = self.local / "writer.lock"
        path.parent.mkdir(parents=True, exist_ok=True)
        import fcntl

        with path.open("a+") as handle:
            try:
                fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                raise StaleInput("another process is writing to the archive") from None
            yield

    def publish(self, batch_id: str, generations: dict[str, str]) -> dict:
        """Points readers at the given generations if every audit is clean; the same call again is the same
        publication."""
        problems = [r.check for r in self.audit().where("problems > 0").collect()]
        if problems:
            raise StaleInput("; ".join(problems))
        if not all(_HEX.fullmatch(g) for g in generations.values()):
            raise ValueError("generations are named by hex digits")
        pointer = {"format": "lectern.publication.v1", "batch_id": batch_id, "epoch": self.epoch(), "generations": dict(sorted(generations.items()))}
        replace(self.local / "publication.json", pointer)
        return pointer

    def published(self) -> dict:
        """The pointer, unless the tables have changed since."""
        path = self.local / "publication.json"
        if not path.exists():
            raise StaleInput("nothing was published")
        found = json.loads(path.read_text())
        if set(found) != {"format", "batch_id", "epoch", "generations"} or found["format"] != "lectern.publication.v1":
            raise StaleInput("the pointer isn't one of this format")
        if found["epoch"] != self.epoch():
            raise StaleInput("the tables have changed since they were published")
        return found


def replace(path: Path, value: object) -> None:
    """Writes JSON so that readers see the old file or the new one."""
    path.parent.mkdir(parents=True, exist_ok=True)
    held = path.with_name(f"{path.name}.{uuid.uuid4().hex}")
    with held.open("w") as f:
        json.dump(value, f, ensure_ascii=False, sort_keys=True)
        f.flush()
        fsync(f.fileno())
    held.replace(path)


def write_once(path: Path, value: object) -> None:
    """Writes a JSON report that must not exist."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x") as f:
        json.dump(value, f, ensure_ascii=False, sort_keys=True, indent=1)
        f.flush()
        fsync(f.fileno())


def generation(*parts: object) -> str:
    """A content-addressed name."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]
