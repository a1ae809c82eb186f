"""Inverted lists with product-quantised vectors: cells, codes of residuals, approximate scores, exact reranking.

Centres and code books are fitted on a bounded sample; every vector is encoded where it lies, in bytes a part. An
index is a generation: a folder named by its configuration, books and inputs, which appends only what it lacks.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import relational, vectors
from lectern.plans.ledger import generation, write_once


@dataclass(frozen=True)
class Config:
    dimensions: int
    cells: int = 64
    parts: int = 16
    bits: int = 8
    probes: int = 8
    sample: int = 20_000
    rounds: int = 10
    seed: int = 42

    def __post_init__(self):
        if self.parts < 1 or self.dimensions % self.parts:
            raise ValueError("the parts must divide the dimensions")
        if not 1 <= self.bits <= 8 or not 1 <= self.probes <= self.cells:
            raise ValueError("a code has 1 to 8 bits, and probes are at most the cells")


@dataclass
class Books:
    centres: np.ndarray
    #: by part, code and component
    codes: np.ndarray

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(v, self.centres)
        rest = v - self.centres[cell]
        width = v.shape[1] // len(self.codes)
        return cell, np.stack([_nearest(rest[:, p * width : (p + 1) * width], book) for p, book in enumerate(self.codes)], 1).astype(np.uint8)

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([book[code[:, p]] for p, book in enumerate(self.codes)], 1)


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (v @ centres.T - (centres * centres).sum(1) / 2).argmax(1)


def _means(v: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = v[rng.choice(len(v), k, replace=len(v) < k)].copy()
    for _ in range(rounds):
        own = _nearest(v, centres)
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], v[rng.choice(len(v), k)])
    return centres


def fit(rows: DataFrame, id_col: str, vector_col: str, c: Config) -> Books:
    """Books from at most ``c.sample`` vectors, the same ones whenever the ids are."""
    unit = rows.select(id_col, vectors.normalize(F.col(vector_col), c.dimensions).alias("v")).where("v is not null")
    drawn = relational.hash_sample(unit, id_col, c.sample, c.seed).collect()
    v = np.array([r["v"] for r in drawn])
    if len(v) < c.cells or v.shape[1] != c.dimensions:
        raise ValueError("there must be a vector for each cell, of the configured length")
    rng = np.random.default_rng(c.seed)
    centres = _means(v, c.cells, c.rounds, rng)
    rest = v - centres[_nearest(v, centres)]
    width = c.dimensions // c.parts
    return Books(centres, np.stack([_means(rest[:, p * width : (p + 1) * width], 1 << c.bits, c.rounds, rng) for p in range(c.parts)]))


def encode(rows: DataFrame, id_col: str, vector_col: str, books: Books, dimensions: int) -> DataFrame:
    """(id, cell, code)."""
    unit = rows.select(id_col, vectors.normalize(F.col(vector_col), dimensions).alias("v")).where("v is not null")

    def run(frames):
        for frame in frames:
            if len(frame):
                cell, code = books.encode(np.stack(frame["v"].to_numpy()))
                yield pd.DataFrame({id_col: frame[id_col], "cell": cell.astype(np.int32), "code": [x.tobytes() for x in code]})

    return unit.mapInPandas(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, cell int, code binary")


def scores(index: DataFrame, books: Books, query: list[float], probes: int, id_col: str) -> DataFrame:
    """(id, score): approximate inner products within the ``probes`` cells nearest to the query, from one table of the
    query's products with each part's codes."""
    q = np.asarray(query)
    by_cell = books.centres @ q
    near = np.argsort(-by_cell)[:probes]
    width = len(q) // len(books.codes)
    table = np.stack([book @ q[p * width : (p + 1) * width] for p, book in enumerate(books.codes)])

    def run(frames):
        parts = np.arange(len(table))
        for frame in frames:
            if len(frame):
                code = np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), -1)
                yield pd.DataFrame({id_col: frame[id_col], "score": by_cell[frame["cell"].to_numpy()] + table[parts, code].sum(1)})

    kind = index.schema[id_col].dataType.simpleString()
    return index.where(F.col("cell").isin([int(x) for x in near])).mapInPandas(run, f"{id_col} {kind}, score double")


def search(index: DataFrame, books: Books, rows: DataFrame, query: list[float], c: Config, id_col: str, vector_col: str, limit: int, wanted: int | None = None, most: int | None = None) -> DataFrame:
    """The exact best of the approximate best. Candidates start at 20 for each row wanted and double, up to ``most``,
    until ``wanted`` groups of rows (here: rows) are found or the cells have no more."""
    found = scores(index, books, query, c.probes, id_col)
    take, cap = 20 * limit, most or 20_000
    while True:
        drawn = vectors.best(found, id_col, take)
        if wanted is None or take >= cap or drawn.count() < take or drawn.count() >= wanted:
            return vectors.rerank(drawn, rows, query, id_col, vector_col, limit)
        take = min(2 * take, cap)


# generations


def build(rows: DataFrame, id_col: str, vector_col: str, c: Config, root: str) -> str:
    """An index of the rows under ``root``; its name. Rows that it has already stay, whatever their vectors; a call
    that was cut off is taken up where it was."""
    folder = Path(root.removeprefix("file://"))
    books_path = folder / "books.json"
    if not books_path.exists():
        books = fit(rows, id_col, vector_col, c)
        write_once(books_path, {"config": asdict(c), "centres": books.centres.tolist(), "codes": books.codes.tolist()})
    config, books = load(root)
    if config != c:
        raise ValueError("the index was built with another configuration")
    spark = rows.sparkSession
    new = rows
    if (folder / "codes").exists():
        new = relational.pending(rows, spark.read.parquet(f"{root}/codes").select(id_col), id_col)
    encode(new, id_col, vector_col, books, c.dimensions).write.mode("append").partitionBy("cell").parquet(f"{root}/codes")
    return generation(asdict(c), books.centres.tolist())


def load(root: str) -> tuple[Config, Books]:
    found = json.loads((Path(root.removeprefix("file://")) / "books.json").read_text())
    return Config(**found["config"]), Books(np.array(found["centres"]), np.array(found["codes"]))


def open_index(spark: SparkSession, root: str) -> DataFrame:
    """The codes, in a folder for each cell, so that a search reads the probed ones."""
    return spark.read.parquet(f"{root}/codes")
