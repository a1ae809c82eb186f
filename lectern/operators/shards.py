"""Vector shards: gapless vector ids over batches that only append, their ledger, and proofs of both."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import relational
from lectern.plans.ledger import Archive, StaleInput, generation

VECTORS = "vector_id long, chunk_id string, article_id string, text_sha256 string, embedding array<float>, shard long"


def append_vectors(archive: Archive, embedded: DataFrame, config: dict, shard_rows: int = 10_000) -> int:
    """Adds vectors of chunks that have none; their ids go on behind the last one, in order of chunk id.

    New chunk ids may sort before old ones, so what is missing is found by an anti-join. A run that was cut
    off leaves whole files or none, and the next one goes on from what is there.
    """
    archive._same_config("vectors", config)
    have = archive.read("vector_shards", VECTORS)
    start = have.agg(F.max("vector_id")).first()[0]
    start = 0 if start is None else start + 1
    new = relational.pending(embedded.where("embedding is not null"), have.select("chunk_id"), "chunk_id")
    ranked = relational.global_rank(new, [F.col("chunk_id")], f"{archive.root}/vector_ranks", "place")
    rows = ranked.withColumn("vector_id", F.col("place") - 1 + F.lit(start).cast("long")).withColumn("shard", F.floor(F.col("vector_id") / shard_rows))
    rows.select(*[c.split()[0] for c in VECTORS.split(", ")]).write.mode("append").parquet(f"{archive.root}/vector_shards")
    return archive.read("vector_shards", VECTORS).count() - start


def ledger(vectors: DataFrame) -> DataFrame:
    """By shard: first vector, vectors, and a digest of its ids in order."""
    return vectors.groupBy("shard").agg(F.min("vector_id").alias("first_vector"), F.count(F.lit(1)).alias("vectors"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vector_id", "chunk_id"))), lambda s: s["chunk_id"]), ",").cast("binary"), 256).alias("ids_sha256"))


def id_proof(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(check, problems) of ids: gaps, repeats, chunks without a vector and vectors without a chunk."""
    n = vectors.count()
    checks = {
        "vector ids outside 0..n-1": vectors.where((F.col("vector_id") < 0) | (F.col("vector_id") >= n)),
        "vector ids used twice": vectors.groupBy("vector_id").count().where("count > 1"),
        "chunks with two vectors": vectors.groupBy("chunk_id").count().where("count > 1"),
        "chunks without a vector": relational.pending(chunks.select("chunk_id"), vectors, "chunk_id"),
        "vectors without a chunk": relational.pending(vectors.select("chunk_id"), chunks, "chunk_id"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("problems"))
        out = one if out is None else out.unionByName(one)
    return out


def chunk_ids(vectors: DataFrame, spark: SparkSession, wanted: list[int]) -> list[str | None]:
    """Chunk ids of a page's vector ids, in its order; None where there is none."""
    found = {r["vector_id"]: r["chunk_id"] for r in vectors.where(F.col("vector_id").isin(wanted)).select("vector_id", "chunk_id").collect()}
    return [found.get(i) for i in wanted]


def freeze(archive: Archive, config: dict) -> str:
    """A generation: a copy of the vectors named by its ledger and configuration, never written twice."""
    vectors = archive.read("vector_shards", VECTORS)
    rows = [tuple(r) for r in ledger(vectors).orderBy("shard").collect()]
    name = generation(rows, config)
    try:
        vectors.write.mode("errorifexists").parquet(f"{archive.root}/generations/{name}")
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    return name


def open_generation(archive: Archive, name: str, config: dict) -> DataFrame:
    """Its vectors, if they are what its name says."""
    vectors = archive.spark.read.schema(VECTORS).parquet(f"{archive.root}/generations/{name}")
    if generation([tuple(r) for r in ledger(vectors).orderBy("shard").collect()], config) != name:
        raise StaleInput("the generation isn't what its name says")
    return vectors


def spec_fingerprint(spec: dict) -> str:
    return hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()
