"""Secret scans over an incremental ledger of blobs, in DataFrame functions alone.

Every version of a text is named by its SHA-256. The ledger holds one row for each blob and rule version
already scanned; only pairs that it lacks are scanned, and the findings are joined back to every path
that holds the blob. Spans come from splitting a text at a rule's matches: the lengths of the parts and
of the matches between them add up to the matches' places.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._common import fresh, named, scratch_dir

#: kind: (regular expression, group whose length counts, least length), in the order of the kinds.
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    # Runs shorter than the least length fail, and a run's match always covers the whole run.
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Only texts with these are matched in full.
_HINTS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{16}"}
#: Matches whose places are added up at once.
PIECE = 256
_STEPS = "array<array<struct<whole:int,sized:int,gap:int>>>"
LEDGER = "blob_id binary, rule_version string, spans array<struct<start:int,kind:int,end:int>>"


def rule_version(rules: dict = RULES) -> str:
    return hashlib.sha256(repr(sorted(rules.items())).encode()).hexdigest()[:16]


def _spans(text: Column, number: int, pattern: str, group: int, least: int, hint: str) -> Column:
    """array<struct<start, kind, end>> of one rule, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    parts = F.split(text, pattern, -1)
    sized = F.transform(found, lambda m: F.length(m)) if not group else F.transform(F.regexp_extract_all(text, F.lit(pattern), group), lambda m: F.length(m))
    steps = F.arrays_zip(F.transform(found, lambda m: F.length(m)).alias("whole"), sized.alias("sized"), F.slice(F.transform(parts, lambda p: F.length(p)), F.lit(1), F.size(found)).alias("gap"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    kept = lambda s, at: F.struct((at + s["gap"]).alias("start"), F.lit(number).alias("kind"), (at + s["gap"] + s["whole"]).alias("end"))

    def piece(some: Column, at: Column) -> Column:
        """The spans of a few steps, the first of which begins at ``at``."""
        return F.aggregate(
            some,
            F.struct(at.alias("at"), empty.alias("out")),
            lambda acc, s: F.struct((acc["at"] + s["gap"] + s["whole"]).alias("at"), F.when(s["sized"] >= least, F.concat(acc["out"], F.array(kept(s, acc["at"])))).otherwise(acc["out"]).alias("out")),
            lambda acc: acc["out"],
        )

    def walk(all_: Column) -> Column:
        """An append copies its list, so steps are taken in pieces: first each one's length, then where each
        begins, then their spans."""
        pieces = F.when(F.size(all_) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PIECE).cast("int")), lambda i: F.slice(all_, i * PIECE + 1, F.lit(PIECE)))).otherwise(F.array().cast(_STEPS))
        return _let(pieces, placed)

    def placed(pieces: Column) -> Column:
        length = lambda p: F.aggregate(p, F.lit(0), lambda acc, s: acc + s["gap"] + s["whole"])
        begins = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + length(p))))
        return F.flatten(F.zip_with(pieces, F.slice(begins, F.lit(1), F.size(pieces)), piece))

    return F.when(F.rlike(text, F.lit(hint)), _let(steps, walk)).otherwise(empty)


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find_spans(text: Column, rules: dict = RULES) -> Column:
    """All rules' spans by start, then kind."""
    return F.array_sort(F.concat(*[_spans(text, i, *rule, _HINTS.get(kind, rule[0])) for i, (kind, rule) in enumerate(rules.items())]))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty if nothing was written there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger_path: str, text_col: str = "text", rules: dict = RULES) -> DataFrame:
    """Appends the findings of unseen blobs to the ledger and returns the versions (all columns but the
    text), each with ``blob_id`` and ``spans``.

    A null text is the empty blob. Equal texts, and repeated rows, are scanned once and all get the
    findings. Rows may hold any other columns: where one is called as an added one, the added one gets an
    underscore behind its name. No rows give none. An append that fails half-way leaves no rows (Parquet's
    commit), and one that is repeated adds no second finding, as only missing pairs are scanned.
    """
    spark = versions.sparkSession
    version = rule_version(rules)
    text = F.coalesce(named(text_col), F.lit(""))
    blob = F.unhex(F.sha2(text.cast("binary"), 256))
    seen = read_ledger(spark, ledger_path).where(F.col("rule_version") == version).select("blob_id")
    # Equal blobs meet after a partial aggregation, so a text of which there are thousands travels once a task.
    blobs = versions.select(blob.alias("blob_id"), text.alias("__text")).dropDuplicates(["blob_id"])
    unseen = blobs.join(seen, "blob_id", "left_anti")
    unseen.select("blob_id", F.lit(version).alias("rule_version"), find_spans(F.col("__text"), rules).alias("spans")).write.mode("append").parquet(ledger_path)
    findings = read_ledger(spark, ledger_path).where(F.col("rule_version") == version).select(F.col("blob_id").alias("__blob"), F.col("spans").alias("__spans"))
    kept = [c for c in versions.columns if c != text_col]
    paths = versions.select(*[named(c).alias(f"__v{i}") for i, c in enumerate(kept)], blob.alias("__own"))
    joined = paths.join(findings, F.col("__own") == F.col("__blob"), "left")
    return joined.select(*[F.col(f"__v{i}").alias(c) for i, c in enumerate(kept)], F.col("__own").alias(fresh("blob_id", kept)), F.col("__spans").alias(fresh("spans", kept)))


def report(scanned: DataFrame, id_col: str = "doc_id", rules: dict = RULES) -> DataFrame:
    """Counts by kind, the digest of the spans and the spans as text, for each path of a scan, whose last
    column the spans are."""
    spans_col = scanned.columns[-1]
    names = F.array(*[F.lit(k) for k in rules])
    text = F.array_join(F.transform(spans_col, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    of_kind = lambda i: F.size(F.filter(spans_col, lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(rules)]
    return scanned.select(F.col(id_col), *counts, F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))


def scan_documents(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """``report`` of a scan of (doc_id, text) against a ledger, a fresh one unless a path is given."""
    return report(scan(docs.select("doc_id", "text"), ledger_path or scratch_dir(docs.sparkSession, "secret-ledger")))
