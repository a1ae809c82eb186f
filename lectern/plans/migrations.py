"""Versions of stored tables. A table's folder says which version it has; steps bring it up to date, each into a folder
of its own that a marker then makes the current one, so that a step that was cut off leaves the old table."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lectern.plans.ledger import replace

Step = Callable[[DataFrame], DataFrame]


def version(folder: str | Path) -> tuple[int, str]:
    """(version, folder of its files); a table without a marker has version 0."""
    path = Path(folder) / "version.json"
    if not path.exists():
        return 0, str(folder)
    found = json.loads(path.read_text())
    return found["version"], str(Path(folder) / found["files"]) if found["files"] else str(folder)


def migrate(spark: SparkSession, folder: str | Path, steps: list[Step]) -> int:
    """Applies the steps that the table lacks, in order; its version, which is how many there are. A newer table than
    this library knows is refused."""
    now, files = version(folder)
    if now > len(steps):
        raise ValueError(f"the table has version {now}, and this library knows {len(steps)}")
    for k in range(now, len(steps)):
        before = spark.read.parquet(files)
        name = f"v{k + 1}"
        steps[k](before).write.mode("overwrite").parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        if after.count() != before.count():
            raise ValueError(f"step {k + 1} changes the number of rows")
        replace(Path(folder) / "version.json", {"version": k + 1, "files": name})
        now, files = version(folder)
    return now


def read(spark: SparkSession, folder: str | Path, steps: list[Step]) -> DataFrame:
    """The table, if it is up to date."""
    now, files = version(folder)
    if now != len(steps):
        raise ValueError(f"the table has version {now}, not {len(steps)}; migrate it first")
    return spark.read.parquet(files)


def refresh_statistics(spark: SparkSession, table: str, columns: list[str] | None = None) -> None:
    """Statistics that the planner orders joins by, of a table in the catalogue."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))
