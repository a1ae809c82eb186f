"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a value within r / 2 bits of both. A fingerprint emits
all values within half the radius; the values are shuffled, and fingerprints that meet at one are verified
in full. With ``parts`` above 1 the fingerprint is cut into parts and the ball is taken in each part, with
the radius that at least one part of a linked pair keeps: two parts of 32 bits at radius 4 mean 66 values
in place of 2,081. Where more than ``most_pairs_of`` fingerprints meet at one value, these emit the whole
fingerprint's ball instead, in which all that meet are linked, so that no pairs are formed there.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import fresh, materialize, named, text_slices
from lectern.llm.graph import components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
PARTS = 2
MOST_PAIRS_OF = 64
_BITS = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each run of ``size`` words, or of all words if they are fewer."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    h = xxhash.xxh64_intdigest
    if len(found) <= size:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    return np.fromiter([h(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(((ones * 2 > len(hashes)).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def _fingerprints(batches):
    for rows, data, offsets in text_slices(batches):
        raw = data.tobytes()
        at = offsets.tolist()
        out = np.array([fingerprint(shingle_hashes(raw[a:b])) for a, b in zip(at, at[1:])], np.uint64)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(out.view(np.int64))], ["doc_id", "digest", "fp"])


def _digest(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, fp) by row; a text without words, or null, has fingerprint 0. With ``digest`` that of the text too."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (_digest(text_col) if digest else F.lit(None).cast("string")).alias("digest"))
    found = texts.mapInArrow(_fingerprints, "doc_id long, digest string, fp long")
    return found if digest else found.select("doc_id", "fp")


def ball(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` ones, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _masks(values: list[int]):
    return F.expr("array(" + ",".join(f"{v}L" if v != -(1 << 63) else "shiftleft(1L, 63)" for v in values) + ")")


def _meet(radius: int, most_pairs_of: int, rows: int = 1 << 16):
    """Links among the fingerprints under each value, which come sorted by (value, fingerprint), and as
    (fp, fp) those under a value that more than ``most_pairs_of`` share. Rows are compared with those at
    most ``most_pairs_of`` - 1 places on, all at once, so a value's rows are never gathered."""

    def run(batches):
        value, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        done = 0  # rows that were compared before and stay for those that follow
        for batch in batches:
            value = np.append(value, batch.column("value").to_numpy())
            fp = np.append(fp, batch.column("fp").to_numpy().view(np.uint64))
            if len(value) - done < rows:
                continue
            keep = min(len(value), most_pairs_of)
            yield from compare(value, fp, done)
            done, value, fp = keep, value[-keep:], fp[-keep:]
        yield from compare(value, fp, done)

    def compare(value, fp, done):
        for step in range(1, most_pairs_of + 1):
            i = np.flatnonzero(value[step:] == value[:-step])
            i = i[i + step >= done]
            if not len(i):
                if not (value[step:] == value[:-step]).any():
                    break
                continue
            if step == most_pairs_of:
                a = b = np.unique(np.append(fp[i], fp[i + step]))
            else:
                near = np.bitwise_count(fp[i] ^ fp[i + step]) <= radius
                a, b = fp[i[near]], fp[i[near] + step]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS, most_pairs_of: int = MOST_PAIRS_OF) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: every pair within the radius is joined by a path
    of links, each of which is within the radius itself."""
    if radius % 2:
        raise ValueError("the radius must be even")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The distinct fingerprints are few bytes, which would be joined to a few tasks, but each emits many rows.
    fps = fps.select("fp").distinct().repartition(n, "fp")
    width, inner = 64 // parts, radius // parts  # one part of a linked pair differs in at most this many bits
    half = -(-inner // 2)
    # The part's number is added above the part's bits, or mixed in where these are all 64.
    piece = lambda k: F.expr(f"shiftrightunsigned(fp, {k * width}) & {(1 << width) - 1}L | {k << width}L") if parts > 1 else F.col("fp")
    masks = _masks(ball(width, half))
    emitted = fps.select("fp", F.explode(F.flatten(F.array(*[_variants(piece(k), masks) for k in range(parts)]))).alias("value"))
    met = emitted.repartition(n, "value").sortWithinPartitions("value", "fp").mapInArrow(_meet(radius, most_pairs_of), "a long, b long")
    met = materialize(met.distinct(), "simhash-met")
    # Whole balls of those in crowds: all that meet at a value are within twice half the radius of one another.
    crowd = met.where("a = b").select(F.col("a").alias("fp"))
    whole = crowd.select("fp", F.explode(_variants(F.col("fp"), _masks(ball(64, radius // 2)))).alias("value"))
    centres = whole.groupBy("value").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = whole.join(centres.hint("merge"), "value").where("fp != a").select("a", F.col("fp").alias("b"))
    return met.where("a != b").unionByName(stars).distinct()


def _variants(value, masks):
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def _named(found: DataFrame, radius: int, parts: int, most_pairs_of: int) -> DataFrame:
    """The rows of (doc_id, fp, ...) with their component's key and the smallest doc_id in it."""
    groups = found.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    nodes = components(links(groups, radius, parts, most_pairs_of)).hint("merge")
    grouped = groups.join(nodes, groups["fp"] == nodes["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = grouped.select("fp", "component").join(smallest.hint("merge"), "component").select(F.col("fp").alias("__fp"), "component", "component_id")
    return found.join(by_fp.hint("merge"), F.col("fp") == F.col("__fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, parts: int = PARTS, most_pairs_of: int = MOST_PAIRS_OF) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    reachable). Texts without words share fingerprint zero and so a component. A null id is in a component
    but never its name, unless no other id is in it; repeated rows get a row each.
    """
    found = materialize(fingerprints(docs, id_col, text_col), "simhash-fps")
    return _named(found, radius, parts, most_pairs_of).select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: one whose id names it, or of a component that has no id, one without. Rows are
    told apart by id and text, so that rows of other components with the same id, or without one, stay too.
    Rows may hold any other columns, whatever their names; no rows give none."""
    own = fresh("key", docs.columns)
    key = lambda i, digest: F.concat_ws(":", digest, F.coalesce(i.cast("string"), F.lit("null"))).alias(own)
    found = materialize(fingerprints(docs, id_col, text_col, digest=True), "simhash-fps")
    first = _named(found, RADIUS, PARTS, MOST_PAIRS_OF).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("component").agg(F.min(key(F.col("doc_id"), F.col("digest"))).alias(own)).select(own)
    rows = docs.select("*", key(named(id_col).cast("long"), _digest(text_col)))
    # Repeated rows share the join's key, so dropping them needs no shuffle of its own.
    return rows.join(kept.hint("merge"), own, "left_semi").dropDuplicates([own]).select(*map(named, docs.columns))
