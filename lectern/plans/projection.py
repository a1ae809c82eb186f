"""Projections of several sets of vectors into one space: checked to be of one model, fitted together, staged, counted
and only then put in the place of what the sets had."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import relational, vectors
from lectern.plans.ledger import StaleInput

AXES = ("x", "y", "z")


def project_together(sets: dict[str, DataFrame], folder: str, dimensions: int = 3) -> DataFrame:
    """(source, id, x, y, z) of all sets, each (id, embedding, model), from one fit over all of them; written to
    ``folder`` and counted there."""
    if not sets:
        raise ValueError("there is no set to project")
    spark = next(iter(sets.values())).sparkSession
    both = None
    for name, rows in sets.items():
        one = rows.select(F.lit(name).alias("source"), "id", "embedding", "model")
        both = one if both is None else both.unionByName(one)
    shapes = both.groupBy("model", F.size("embedding").alias("length")).count().limit(3).collect()
    if len(shapes) > 1:
        raise StaleInput("the sets are of different models: " + ", ".join(f"{r['model']} ({r['length']})" for r in shapes))
    key = F.to_json(F.struct("source", "id"))
    placed = vectors.project(both.withColumn("key", key), "key", "embedding", dimensions)
    named = F.from_json("key", "source string, id string")
    kind = both.schema["id"].dataType
    placed.select(named["source"].alias("source"), named["id"].cast(kind).alias("id"), *AXES[:dimensions]).write.mode("overwrite").parquet(folder)
    staged = spark.read.parquet(folder)
    want = {r["source"]: r["count"] for r in both.groupBy("source").count().collect()}
    got = {r["source"]: r["count"] for r in staged.where(F.col(AXES[0]).isNotNull()).groupBy("source").count().collect()}
    if want != got:
        raise StaleInput(f"{sum(want.values())} vectors gave {sum(got.values())} projections")
    return staged


def take(rows: DataFrame, staged: DataFrame, source: str, dimensions: int = 3) -> DataFrame:
    """A set's rows (id, x, y, z and others) with its staged projections; each row must have one."""
    own = staged.where(F.col("source") == source).drop("source")
    if not relational.pending(rows.select("id"), own, "id").isEmpty():
        raise StaleInput("some rows have no projection")
    return relational.apply_staged(rows, own, "id", list(AXES[:dimensions]))
