"""``python -m lectern.plans.cli``: ingest, index, search, read, status and batches from the shell."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunking, entities, lexical
from lectern.plans import models
from lectern.plans.engine import MODES, Engine
from lectern.plans.ledger import Archive
from lectern.plans.serve import run_lines
from lectern.sources.markdown import load_manifest, read_batch, read_issues


def engine_of(archive: Archive) -> Engine:
    """What the archive holds, with its indexes as far as they were built."""
    spark, root = archive.spark, archive.root
    have = lambda p: (archive.local / p).exists()
    articles = archive.read("articles", chunking.ARTICLES).withColumn("is_valid", F.coalesce("is_valid", F.lit(1)))
    engine = Engine(archive.current_issues(), articles)
    for name in ("surface", "lemma"):
        if have(name):
            setattr(engine, name, lexical.open_index(spark, f"{root}/{name}"))
    if have("vectors"):
        engine.vectors = spark.read.parquet(f"{root}/vectors")
    if have("names"):
        engine.names, engine.members = spark.read.parquet(f"{root}/names"), spark.read.parquet(f"{root}/members")
    return engine


def ingest(archive: Archive, folder: str, **options) -> dict[str, int]:
    """A folder of Markdown issues as one batch."""
    rows = read_issues(archive.spark, folder)
    batch = rows.select("relative_path", "content", "metadata_json", F.sha2(F.col("metadata_json").cast("binary"), 256).alias("metadata_sha256"), F.lit(None).cast("string").alias("error"))
    return archive.run(batch, "ingest", **options)


def index(archive: Archive, kind: str, model: str | None = None) -> None:
    engine, root = engine_of(archive), archive.root
    if kind in ("surface", "lemma"):
        docs = engine.articles.where("is_valid = 1").select("article_id", "title", "content")
        docs = models.lemmatise(docs, model or "suffix-free") if kind == "lemma" else docs
        lexical.build_index(docs, f"{root}/{kind}", "article_id", "title", "content")
    elif kind == "semantic":
        chunks = archive.read("chunks", chunking.CHUNKS)
        found = models.embed(chunks.select("chunk_id", "text"), model or "hashed-words").where("is_valid = 1")
        found.join(chunks.select("chunk_id", "article_id"), "chunk_id").select("article_id", F.col("chunk_id").alias("vector_id"), "embedding").write.mode("overwrite").parquet(f"{root}/vectors")
    else:
        live = entities.eligible(engine.articles).select(F.xxhash64("article_id").alias("article_id"), "content", F.col("article_id").alias("key"))
        mentions = entities.extract(live, model or "capitalised")
        names, members = entities.dictionary(mentions, entities.completions(live, mentions))
        names.write.mode("overwrite").parquet(f"{root}/names")
        members.join(live.select("article_id", "key"), "article_id").select("normalized_name", F.col("key").alias("article_id"), "content_sha256", "char_start").write.mode("overwrite").parquet(f"{root}/members")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lectern")
    parser.add_argument("--archive", required=True)
    verbs = parser.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("ingest")
    one.add_argument("folder")
    for name, default in (("count", 256), ("overlap", 64)):
        one.add_argument(f"--token-{name}", default=default, type=int)
    one = verbs.add_parser("index")
    one.add_argument("kind", choices=("surface", "lemma", "semantic", "entities"))
    one.add_argument("--model")
    one = verbs.add_parser("search")
    one.add_argument("query")
    one.add_argument("--mode", choices=MODES, default="bm25")
    for name, kind in (("limit", int), ("offset", int), ("newspaper", str), ("date-from", str), ("date-to", str)):
        one.add_argument(f"--{name}", type=kind, default=argparse.SUPPRESS)
    one = verbs.add_parser("read")
    one.add_argument("document_id")
    one.add_argument("position")
    one = verbs.add_parser("batch")
    one.add_argument("step", choices=("plan", "run"))
    one.add_argument("manifest")
    one.add_argument("root")
    one = verbs.add_parser("status")
    one.add_argument("--batch")
    for name in ("audit", "stdio"):
        verbs.add_parser(name)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    archive = Archive(spark, args.archive)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    if args.verb == "ingest":
        show(ingest(archive, args.folder, count=args.token_count, overlap=args.token_overlap))
    elif args.verb == "index":
        index(archive, args.kind, args.model)
    elif args.verb == "search":
        options = {k: v for k, v in vars(args).items() if k in ("limit", "offset", "newspaper", "date_from", "date_to")}
        for hit in engine_of(archive).search(args.mode, args.query, **options):
            show(asdict(hit))
    elif args.verb == "read":
        show(engine_of(archive).read_source(args.document_id, position=args.position, before=2, after=2))
    elif args.verb == "batch":
        batch_id, issues = load_manifest(Path(args.manifest).read_text())
        batch = read_batch(spark, args.root, batch_id, issues)
        if args.step == "plan":
            for row in archive.plan(batch).groupBy("action").count().orderBy("action").collect():
                show(row.asDict())
        else:
            show(archive.run(batch, batch_id))
    elif args.verb == "audit":
        problems = [r.asDict() for r in archive.audit().collect()]
        show(problems)
        return int(any(p["problems"] for p in problems))
    elif args.verb == "status":
        show([r.asDict() for r in archive.status(args.batch).collect()] if args.batch else engine_of(archive).status())
    else:
        run_lines(engine_of(archive), sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
