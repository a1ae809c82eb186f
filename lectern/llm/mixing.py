"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source that should make up a share w of ``total`` rows and has n of them repeats each at a mean rate of
w * total / n. A document's count inverts that Poisson distribution at a uniform number seeded by its
id's hash; the document is exploded by its count and all copies are shuffled by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import fresh, materialize, named

#: A rate above this is the sum of several draws, so that exp(-rate) can't vanish.
RATE_A_DRAW = 32.0
#: Most sources whose rates are sent to every task; more are joined by shuffle.
MAX_BROADCAST_SOURCES = 10_000
#: Weight of a source by its share of rows p: p ** EXPONENT, normalised.
EXPONENT = 0.5


def uniform(seed: str, *parts: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5; DuckDB can do the same."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(rate: Column, terms: int = 128) -> Column:
    """Cumulative probabilities of 0, 1, ... at a rate of RATE_A_DRAW at most."""
    first = F.exp(-rate)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf")),
        lambda acc: acc["cdf"],
    )
    return walk


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, total: int | None = None, exponent: float = EXPONENT) -> DataFrame:
    """source, n, rate, draws, cdf (of one draw) by source; a null source is a source of its own.

    ``weights`` gives target shares (a source without one gets none); by default shares follow
    n ** exponent. ``total`` is the number of rows wanted, by default as many as there are.
    """
    counts = docs.groupBy(named(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(exponent))))
    else:
        known = docs.sparkSession.createDataFrame(list(weights.items()), "source string, w double")
        weighed = counts.join(known.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    weighed = materialize(weighed, "mix-weights")
    ws, ns = weighed.agg(F.sum("w"), F.sum("n")).first()
    want = float(total if total is not None else ns or 0)
    rated = weighed.select("source", "n", (F.col("w") * (want / ws if ws else 0.0) / F.col("n")).alias("rate"))
    drawn = rated.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE_A_DRAW)).cast("int"))
    return drawn.withColumn("cdf", poisson_table(F.col("rate") / F.col("draws")))


def mix(docs: DataFrame, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, total: int | None = None, exponent: float = EXPONENT) -> DataFrame:
    """The replicated rows in global random order, with ``copies``, ``copy`` (from 1) and ``mix_key``.

    Repeated rows of one id get the same count each. A null id is drawn as the text "null"; texts aren't
    looked at, so that null, empty and long ones are rows as others; no rows give none. Columns of the input
    stay as they are: where one is called as an added one, the added one gets an underscore behind its name.
    The rows are partitioned by a hash of (seed, id, copy), which no source or id can skew but a repeated row.
    """
    rates = materialize(source_rates(docs, source_col, weights, total, exponent), "mix-rates")
    source, draws, cdf, copies, copy, mix_key = (fresh(c, docs.columns) for c in ("rate_source", "rate_draws", "rate_cdf", "copies", "copy", "mix_key"))
    table = rates.select(F.col("source").alias(source), F.col("draws").alias(draws), F.col("cdf").alias(cdf))
    if rates.count() <= MAX_BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = docs.join(table, named(source_col).eqNullSafe(F.col(source)))
    # One hash a draw: a number that the filter's condition made itself would be made again for each term of the table.
    drawn = F.transform(F.sequence(F.lit(1), F.col(draws)), lambda j: uniform(seed, named(id_col), j))
    count = F.aggregate(drawn, F.lit(0), lambda acc, u: acc + F.size(F.filter(cdf, lambda c: c <= u)))
    counted = joined.select(*map(named, docs.columns), count.alias(copies)).where(F.col(copies) > 0)
    exploded = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    keyed = exploded.withColumn(mix_key, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(named(id_col).cast("string"), F.lit("null")), F.col(copy).cast("string")).cast("binary")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An MD5 is uniform, so its first digits are a partition's number; no sampling pass is needed.
    number = F.floor(F.conv(F.substring(mix_key, 1, 8), 16, 10).cast("double") / float(1 << 32) * parts).cast("int")
    return keyed.repartitionById(parts, number).sortWithinPartitions(mix_key)
