"""Vectors as arrays: normalising, exact search, per-article deduplication, reranking, cells, projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def normalize(v: Column, dimensions: int | None = None) -> Column:
    """The first ``dimensions`` components at length 1; null for zero and non-finite vectors."""
    v = (F.slice(v, 1, dimensions) if dimensions else v).cast("array<double>")
    length = norm(v)
    good = (length > 0) & (length < float("inf")) & ~F.isnan(length)
    return F.when(good, F.transform(v, lambda x: x / length))


def query_vector(values, dimensions: int | None = None) -> list[float]:
    v = np.asarray(values, np.float64)[:dimensions]
    if v.ndim != 1 or not v.size or not np.isfinite(v).all() or not v.any():
        raise ValueError("a query vector is finite and isn't zero")
    return (v / np.linalg.norm(v)).tolist()


def audit(vectors: DataFrame, vector_col: str, dimensions: int) -> DataFrame:
    """One row: vectors, of other lengths, with non-finite components, and zero ones."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.size(v) != dimensions).alias("other_length"), F.count_if(odd).alias("not_finite"), F.count_if(~F.exists(v, lambda x: x != 0)).alias("zero"))


def scores(vectors: DataFrame, query: list[float], id_col: str, vector_col: str, keep: list[str] = ()) -> DataFrame:
    """Cosines with a normalised query."""
    return vectors.select(id_col, *keep, dot(normalize(F.col(vector_col)), literal(query)).alias("score")).where("score is not null")


def best(scored: DataFrame, id_col: str, limit: int, offset: int = 0) -> DataFrame:
    return scored.orderBy(F.desc("score"), id_col).offset(offset).limit(limit)


def best_of_groups(scored: DataFrame, id_col: str, group_col: str, limit: int, offset: int = 0, candidates: int | None = None) -> DataFrame:
    """The best row of each group, then the page. With ``candidates`` only so many best rows are looked at,
    so that fewer than ``limit`` groups may be left, as in the capped search."""
    rows = best(scored, id_col, candidates) if candidates else scored
    top = rows.groupBy(group_col).agg(F.min_by(F.struct(id_col, "score"), F.struct((-F.col("score")).alias("s"), id_col)).alias("b"))
    return best(top.select(F.col(f"b.{id_col}").alias(id_col), group_col, "b.score"), id_col, limit, offset)


def rerank(candidates: DataFrame, vectors: DataFrame, query: list[float], id_col: str, vector_col: str, limit: int) -> DataFrame:
    """Exact cosines, in single precision, of the candidates' vectors."""
    exact = candidates.select(id_col).join(vectors.select(id_col, vector_col), id_col)
    q = np.asarray(query, np.float32)

    def run(frames):
        for frame in frames:
            if len(frame):
                m = np.stack(frame[vector_col].to_numpy()).astype(np.float32)
                length = np.sqrt((m * m).sum(1))
                value = (m @ q) / np.where(length > 0, length, 1)
                yield pd.DataFrame({id_col: frame[id_col], "score": value.astype(np.float64)})

    return best(exact.mapInPandas(run, f"{id_col} long, score double"), id_col, limit)


def cells(vectors: DataFrame, id_col: str, vector_col: str, k: int, sample: int = 20_000, rounds: int = 10, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """Centres fitted on a bounded sample, and all vectors with their cell: an index for ``search_cells``."""
    rows = vectors.select(id_col, normalize(F.col(vector_col)).alias("v")).where("v is not null")
    fit = np.array([r["v"] for r in rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(sample).collect()])
    rng = np.random.default_rng(seed)
    centres = fit[rng.choice(len(fit), min(k, len(fit)), replace=False)]
    for _ in range(rounds):
        own = (fit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, fit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)

    def assign(frames):
        for frame in frames:
            if len(frame):
                frame["cell"] = (np.stack(frame["v"].to_numpy()) @ centres.T).argmax(1).astype(np.int32)
                yield frame

    kind = vectors.schema[id_col].dataType.simpleString()
    return centres, rows.mapInPandas(assign, f"{id_col} {kind}, v array<double>, cell int")


def search_cells(index: DataFrame, centres: np.ndarray, query: list[float], probes: int, id_col: str, limit: int) -> DataFrame:
    """Exact scores within the ``probes`` cells nearest to the query; a table partitioned by cell reads only
    those."""
    near = np.argsort(-(centres @ np.asarray(query)))[:probes].tolist()
    return best(index.where(F.col("cell").isin([int(c) for c in near])).select(id_col, dot(F.col("v"), literal(query)).alias("score")), id_col, limit)


def project(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int = 3) -> DataFrame:
    """Principal components, each with its largest loading positive. The driver gets sums of products, as
    many as the vectors' length squared, never vectors."""
    rows = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("v"))

    def moments(frames):
        n, s, p = 0, 0.0, 0.0
        for frame in frames:
            if len(frame):
                m = np.stack(frame["v"].to_numpy())
                n, s, p = n + len(m), s + m.sum(0), p + m.T @ m
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "p": [p.ravel().tolist()]})

    parts = rows.mapInPandas(moments, "n long, s array<double>, p array<double>")
    place = parts.select("n", F.posexplode(F.concat("s", "p")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    if not place:
        return rows.select(id_col, *[F.lit(None).cast("double").alias(c) for c in "xyz"[:dimensions]])
    n, flat = place[0]["n"], np.array([r["x"] for r in place])
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    mean, products = flat[:d] / n, flat[d:].reshape(d, d) / n
    _, axes = np.linalg.eigh(products - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :dimensions]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    centred = F.zip_with(F.col("v"), literal(mean), lambda a, b: a - b)
    return rows.select(id_col, *[dot(centred, literal(axes[:, i])).alias("xyz"[i]) for i in range(axes.shape[1])])


def decode_float32(column: Column) -> Column:
    """Little-endian float32 bytes as an array; bytes that aren't whole numbers of them are an error."""

    def run(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.frombuffer(b, "<f4").tolist() for b in blobs], dtype=object)

    run.__annotations__ = {"blobs": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(column)


def encode(column: Column, kind: str = "<f4") -> Column:
    """``<f4`` or ``<f2`` bytes of an array."""

    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else np.asarray(a, kind).tobytes() for a in arrays], dtype=object)

    run.__annotations__ = {"arrays": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.BinaryType())(column)


def window_best(scored: DataFrame, id_col: str, group_col: str) -> DataFrame:
    """``best_of_groups`` as a window, in rank order within the group."""
    order = Window.partitionBy(group_col).orderBy(F.desc("score"), id_col)
    return scored.withColumn("place", F.row_number().over(order))
