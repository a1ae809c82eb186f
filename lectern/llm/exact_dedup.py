"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, an external sort places equals adjacent, and
comparing neighbours in full finds the groups. The range key is (prefix, hash, id), so that neither a
prefix that many texts share nor one text that a third of all rows hold lands in one partition. Only a
partition's first and last key can continue in another one; these few runs are combined by digest.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import fresh, materialize, named

PREFIX_CHARS = 24
_RUNS = "row_id long, keep_id long, group_size long, text_sha256 string, open boolean"


def normalized(text):
    """One space for each run of ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _runs(batches):
    """Runs of equal neighbours in one sorted partition; ``open`` marks runs under the first or last key."""
    schema = pa.schema([("row_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string()), ("open", pa.bool_())])

    def block(rows):
        ids, keep, size, sha, opened = [], [], [], [], []
        for run_ids, digest, is_open in rows:
            known = [i for i in run_ids if i is not None]
            n = len(run_ids)
            ids += run_ids
            keep += [min(known) if known else None] * n
            size += [n] * n
            sha += [digest] * n
            opened += [is_open] * n
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keep, pa.int64()), pa.array(size, pa.int64()), pa.array(sha), pa.array(opened)], schema=schema)

    first_key, key, text, run_ids = None, None, None, []
    done, last_runs = [], []  # last_runs: those under the current key, which may prove to be the last one
    for batch in batches:
        hashes = batch.column("h").to_pylist()
        prefixes = batch.column("prefix").to_pylist()
        ids = batch.column("row_id").to_pylist()
        values = batch.column("norm")
        for i, (h, prefix, row_id) in enumerate(zip(hashes, prefixes, ids)):
            this = values[i].as_py()
            if text is not None and key == (prefix, h) and this == text:
                run_ids.append(row_id)
                continue
            if text is not None:
                last_runs.append((run_ids, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            if key != (prefix, h):
                done += [(*r, key == first_key) for r in last_runs]
                last_runs = []
                key = (prefix, h)
                first_key = first_key or key
            text, run_ids = this, [row_id]
        if len(done) > 5000:
            yield block(done)
            done = []
    if text is not None:
        last_runs.append((run_ids, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
        yield block(done + [(*r, True) for r in last_runs])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after white-space normalisation. The row with the smallest id stays; of
    repeated rows with that id all say ``kept``, as nothing tells them apart. A null text is empty, a null
    id never is the smallest (a group of null ids has a null keep_id and keeps its rows). Other columns
    aren't looked at.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("row_id"), normalized(F.col(text_col)).alias("norm"))
    keyed = keyed.select("row_id", "norm", F.substring("norm", 1, PREFIX_CHARS).alias("prefix"), F.xxhash64("norm").alias("h"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "prefix", "h", "row_id").sortWithinPartitions("prefix", "h", "norm", "row_id")
    runs = materialize(ordered.mapInArrow(_runs, _RUNS), "exact-runs")
    closed = runs.where("not open").drop("open")
    opened = runs.where("open").drop("open")
    # At most two keys of each partition are open: their sums are a few rows per partition.
    sums = opened.groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = opened.select("row_id", "text_sha256").join(sums, "text_sha256")
    out = closed.unionByName(joined.select(*closed.columns))
    return out.select(F.col("row_id").alias(id_col), "keep_id", "group_size", (F.col("row_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, in full, one per group; of repeated rows with one id only one stays.

    Null texts are empty ones, so that of null, empty and repeated empty texts one row stays; a group without
    an id keeps one row. Rows may hold any other columns, whatever their names; no rows give none.
    Uses the groups' digests so that the texts are shuffled once, by id, to find the rows that stay.
    """
    own = fresh("key", docs.columns)
    key = lambda i, digest: F.concat_ws(":", digest, F.coalesce(i.cast("string"), F.lit("null"))).alias(own)
    kept = exact_groups(docs, id_col, text_col).where("kept").select(key(F.col(id_col), F.col("text_sha256"))).distinct()
    keyed = docs.select("*", key(named(id_col).cast("long"), F.sha2(normalized(named(text_col)).cast("binary"), 256)))
    # Repeated rows share the join's key, so dropping them needs no shuffle of its own.
    return keyed.join(kept.hint("merge"), own, "left_semi").dropDuplicates([own]).select(*map(named, docs.columns))
