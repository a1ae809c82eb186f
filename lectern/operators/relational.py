"""Relational operators of an archive: validity, duplicates, coverage, ledgers, paging and ranking.

Everything here is built-in functions; what the driver gets is counts, never rows that grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


Text = str | None


def in_scope(newspaper: Text | list[str] = None, date_from: Text = None, date_to: Text = None, source: str = "source", title: str = "title", date: str = "date") -> Column:
    """Exact source or title, and inclusive bounds on dates as strings; a null date fails only a bound."""
    out = F.lit(True)
    if newspaper is not None:
        names = [newspaper] if isinstance(newspaper, str) else list(newspaper)
        out = out & F.coalesce(F.col(source).isin(names) | F.col(title).isin(names), F.col(source).isin(names), F.col(title).isin(names), F.lit(False))
    if date_from is not None:
        out = out & F.coalesce(F.col(date) >= date_from, F.lit(False))
    if date_to is not None:
        out = out & F.coalesce(F.col(date) <= date_to, F.lit(False))
    return out


def scope_ids(issues: DataFrame, newspaper: str, id_col: str) -> DataFrame:
    """Ids whose source or title is the newspaper, each once."""
    return issues.where(F.col("source") == newspaper).select(id_col).union(issues.where(F.col("title") == newspaper).select(id_col)).distinct()


def duplicates(articles: DataFrame, id_col: str, content_col: str, reason_col: str | None = None, reason: str = "duplicate") -> DataFrame:
    """All but the first, by id, of the articles with one non-empty content, that aren't marked so yet.

    Contents meet by digest, and the first is a minimum that is aggregated in part, so copies of which
    there are millions need neither one task nor their texts.
    """
    keyed = articles.where(F.col(content_col) != "").select("*", F.sha2(F.col(content_col).cast("binary"), 256).alias("__sha"), F.length(content_col).alias("__n"))
    first = keyed.groupBy("__sha", "__n").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__copies")).where("__copies > 1")
    later = keyed.join(first, ["__sha", "__n"]).where(F.col(id_col) > F.col("__first"))
    if reason_col:
        later = later.where(~F.col(reason_col).eqNullSafe(F.lit(reason)))
    return later.select(id_col, F.col("__first").alias("first_id"))


def with_validity(rows: DataFrame, validity: DataFrame, on: str, valid_col: str = "is_valid", default: int | None = None) -> DataFrame:
    """Rows with their validity: 1, 0, or null (or the default) where none is known."""
    joined = rows.join(validity.select(on, valid_col), on, "left")
    return joined.withColumn(valid_col, F.coalesce(valid_col, F.lit(default))) if default is not None else joined


def changed_validity(rows: DataFrame, new: Column, valid_col: str = "is_valid") -> DataFrame:
    """Rows whose validity isn't, null-safely, the new one."""
    return rows.where(~F.col(valid_col).eqNullSafe(new))


def page(rows: DataFrame, key: str, after: object, limit: int) -> DataFrame:
    """The next rows by key. One more than asked for tells whether there are others."""
    return (rows.where(F.col(key) > after) if after is not None else rows).orderBy(key).limit(limit)


def pending(rows: DataFrame, done: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows that aren't done. New ids may sort before old ones, so nothing relies on a last id."""
    return rows.join(done, on, "left_anti")


def coverage(eligible: DataFrame, completed: DataFrame, on: str) -> DataFrame:
    """One row: eligible, completed among them, and missing."""
    marked = eligible.select(on).join(completed.select(on).distinct().withColumn("__done", F.lit(1)), on, "left")
    return marked.agg(F.count(F.lit(1)).alias("eligible"), F.count("__done").alias("completed"), F.count_if(F.col("__done").isNull()).alias("missing"))


def set_difference(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """One row: how many keys each side lacks, from one full outer join."""
    a = left.select(on).distinct().withColumn("__a", F.lit(1))
    b = right.select(on).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, on, "full_outer")
    return both.agg(F.count_if(F.col("__b").isNull()).alias("extra"), F.count_if(F.col("__a").isNull()).alias("missing"))


def orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(key, side) of the keys that only one side has."""
    a, b = left.select(on).distinct().withColumn("__a", F.lit(1)), right.select(on).distinct().withColumn("__b", F.lit(1))
    joined = a.join(b, on, "full_outer").where("__a is null or __b is null")
    return joined.select(on, F.when(F.col("__a").isNull(), "right").otherwise("left").alias("side"))


def shared_by_all(rows: DataFrame, group: str, member: str, least: int, groups: list) -> DataFrame:
    """Members with at least ``least`` rows in each of the groups."""
    often = rows.where(F.col(group).isin(groups)).groupBy(member, group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return often.groupBy(member).agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") == len(set(groups))).select(member)


def frames(rows: DataFrame, group: str, index: str, before: int, after: int, low: str, high: str) -> DataFrame:
    """By row the least ``low`` and largest ``high`` among its neighbours by index in its group."""
    near = Window.partitionBy(group).orderBy(index).rangeBetween(-before, after)
    return rows.select(group, index, F.min(low).over(near).alias("first"), F.max(high).over(near).alias("last"))


def neighbours(rows: DataFrame, hits: DataFrame, group: str, index: str, before: int, after: int) -> DataFrame:
    """The rows around each hit (group, index). The offsets are exploded on the small side, which makes the
    range join one of equal keys."""
    around = hits.select(group, F.col(index).alias("hit"), F.explode(F.sequence(F.col(index) - before, F.col(index) + after)).alias(index))
    return rows.join(around, [group, index])


def gaps(rows: DataFrame, group: str, index: str) -> DataFrame:
    """Rows whose index isn't their place, from 0, in their group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(index)) - 1
    return rows.withColumn("place", place.cast("long")).where(F.col("place") != F.col(index))


def first_of_group(rows: DataFrame, group: str, *order: Column | str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def spread(rows: DataFrame, name: str, bucket: list[str], order: list[str], limit: int) -> DataFrame:
    """Evidence by name: the first of each bucket before any second, ``limit`` in all."""
    own = Window.partitionBy(name, *bucket).orderBy(*order)
    ranked = rows.withColumn("__turn", F.row_number().over(own))
    overall = Window.partitionBy(name).orderBy("__turn", *order)
    return ranked.withColumn("place", F.row_number().over(overall)).where(F.col("place") <= limit).drop("__turn")


def global_rank(rows: DataFrame, order: list[Column], path: str, rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """Rows with a gapless rank from 1 in the given order, without a window over one partition.

    Ranges are sorted and written to ``path``; a row's rank is its place in its range plus the sizes of
    those in front of it, of which the driver holds one number a range.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__place"))
    placed.write.mode("overwrite").parquet(path)
    written = spark.read.schema(placed.schema).parquet(path)
    sizes = dict(written.groupBy("__range").count().collect())
    offsets, total = [F.lit(0).cast("long")] * n, 0
    for k in range(n):
        offsets[k] = F.lit(total).cast("long")
        total += sizes.get(k, 0)
    return written.withColumn(rank, F.element_at(F.array(*offsets), F.col("__range") + 1) + F.col("__place") + 1).drop("__range", "__place")


def mixed(low: Column, high: Column) -> Column:
    """The value that a group shares, or "mixed"."""
    return F.when(low == high, low).otherwise(F.lit("mixed"))


def hash_sample(rows: DataFrame, key: str, count: int, seed: int = 42) -> DataFrame:
    """``count`` rows, the same ones whenever the keys and the seed are."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(count)


def md5_sample(rows: DataFrame, key: str, count: int, seed: str = "42") -> DataFrame:
    """``hash_sample`` by a hash that other engines have too."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(count)


def spaced_sample(rows: DataFrame, key: str, total: int, wanted: int) -> DataFrame:
    """Rows whose key from 0 is one of ``wanted`` evenly spaced places, both ends included: a key is one if
    rounding down any of the places gives it, which a formula decides row by row."""
    if wanted >= total:
        return rows
    if wanted == 1:
        return rows.where(F.col(key) == 0)
    step = (total - 1) / (wanted - 1)
    place = F.ceil(F.col(key) / F.lit(step))
    return rows.where((F.floor(place * F.lit(step)) == F.col(key)) & (place < wanted))


def cumulative(rows: DataFrame, order: str, size: str) -> DataFrame:
    """A ledger of shards with where each begins; it is small, one row a shard."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(order, size, (F.sum(size).over(upto) - F.col(size)).alias("begins"), F.sum(size).over(upto).alias("ends"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: count and an order-free digest, sums of 64-bit parts of each row's hash."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    part = lambda k: F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    return rows.select(part(0).alias("a"), part(1).alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.sum("a").cast("string").alias("low"), F.sum("b").cast("string").alias("high"))


def ordered_fingerprint(rows: DataFrame, key: str, columns: list[str], block: int = 1000) -> DataFrame:
    """One row: rows, and a digest that depends on their order by a whole-number key. Rows of a block of keys are
    digested in order, then the blocks' digests are, so that no task holds more than a block of rows and a list
    of digests, one for each ``block`` keys."""
    text = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [key, *columns]]), "\x1f")
    own = rows.select(F.floor(F.col(key) / block).alias("block"), F.col(key).alias("key"), F.sha2(text.cast("binary"), 256).alias("h"))
    joined = lambda c, by: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, c))), lambda x: x[c]), "").cast("binary"), 256)
    blocks = own.groupBy("block").agg(joined("h", "key").alias("h"), F.count(F.lit(1)).alias("n"))
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), joined("h", "block").alias("digest"))


def coverage_all(base: DataFrame, tables: dict[str, DataFrame], on: str) -> DataFrame:
    """By key of ``base``, once, whether each of the tables has it: one left join a table, of keys alone."""
    out = base.select(on).distinct()
    for name, table in tables.items():
        out = out.join(table.select(on).distinct().withColumn(name, F.lit(True)), on, "left")
    return out.select(on, *[F.coalesce(name, F.lit(False)).alias(name) for name in tables])


def apply_staged(rows: DataFrame, staged: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Rows with the staged values of ``columns`` where there are any; others stay. A staged key that comes twice, or
    that no row has, is an error, as it would change rows that weren't meant or none."""
    twice = staged.groupBy(on).count().where("count > 1").select(F.lit("twice").alias("problem"))
    stray = staged.join(rows, on, "left_anti").select(F.lit("unknown").alias("problem"))
    found = twice.union(stray).groupBy("problem").count().collect()
    if found:
        raise ValueError("staged keys: " + ", ".join(f"{r['problem']} {r['count']}" for r in found))
    new = staged.select(on, F.lit(True).alias("__staged"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(new, on, "left")
    return joined.select(*[F.when(F.col("__staged"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])
