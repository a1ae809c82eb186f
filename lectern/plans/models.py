"""Hooks for models: lemmatisers and embedders are plain batch functions, found by name and loaded once a
Python worker. None is shipped; the stand-ins here are deterministic and say nothing about quality."""

from __future__ import annotations

import importlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import search_tokens

Batch = Callable[[list[str]], list]
_built_in: dict[str, Callable[[], Batch]] = {}


def register(name: str) -> Callable[[Callable[[], Batch]], Callable[[], Batch]]:
    def add(factory: Callable[[], Batch]) -> Callable[[], Batch]:
        _built_in[name] = factory
        return factory

    return add


def load(name: str | Batch) -> Batch:
    """A registered model, a callable, or ``module:factory``."""
    if callable(name):
        return name
    if name in _built_in:
        return _built_in[name]()
    module, mark, factory = name.partition(":")
    if not mark:
        raise ValueError(f"there is no model {name!r}; name one as module:factory")
    made = vars(importlib.import_module(module))[factory]
    return made()


@register("surface")
def _surface() -> Batch:
    """Every word is its own lemma."""
    return lambda texts: [" ".join(search_tokens(t)) for t in texts]


@register("suffix-free")
def _suffix_free() -> Batch:
    """Words of five letters or more without their last two."""
    return lambda texts: [" ".join(w[:-2] if len(w) >= 5 else w for w in search_tokens(t)) for t in texts]


@register("hashed-words")
def _hashed_words() -> Batch:
    """Signed sums of hashed words in 256 dimensions."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), 256), np.float32)
        for row, text in zip(out, texts):
            for word in search_tokens(text):
                h = zlib.crc32(word.encode())
                row[h & 255] += 1 if h & 256 else -1
        return out.tolist()

    return embed


def _mapped(rows: DataFrame, columns: list[str], model: str | Batch, out: dict[str, str], batch: int, apply) -> DataFrame:
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{c}` {t}" for c, t in out.items()])

    def run(frames: Iterator[pd.DataFrame]):
        predict = load(model)
        for frame in frames:
            for a in range(0, len(frame), batch):
                yield apply(predict, frame.iloc[a : a + batch])

    return rows.mapInPandas(run, schema)


def lemmatise(articles: DataFrame, model: str | Batch = "surface", batch: int = 64, id_col: str = "article_id") -> DataFrame:
    """(id, title, content) with lemmas; a field whose lemmas are empty keeps its words."""

    def apply(predict: Batch, part: pd.DataFrame) -> pd.DataFrame:
        for column in ("title", "content"):
            texts = part[column].fillna("").tolist()
            found = predict(texts)
            if len(found) != len(texts):
                raise ValueError("the lemmatiser gave another number of texts")
            part = part.assign(**{column: [lemma.strip() or text for lemma, text in zip(found, texts)]})
        return part

    rows = articles.select(id_col, F.col("title").cast("string").alias("title"), F.col("content").cast("string").alias("content"))
    return _mapped(rows, ["title", "content"], model, {}, batch, apply)


def embed(chunks: DataFrame, model: str | Batch = "hashed-words", dimensions: int | None = None, batch: int = 64, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, embedding, is_valid): truncated and at length 1; zero or non-finite vectors are invalid."""

    def apply(predict: Batch, part: pd.DataFrame) -> pd.DataFrame:
        raw = np.asarray(predict(part[text_col].fillna("").tolist()), np.float32).reshape(len(part), -1)[:, :dimensions]
        length = np.linalg.norm(raw, axis=1)
        good = np.isfinite(length) & (length > 0)
        unit = raw / np.where(good, length, 1)[:, None]
        return part.assign(embedding=[v.tolist() if g else None for v, g in zip(unit, good)], is_valid=good.astype(np.int32)).drop(columns=[])

    rows = chunks.select(id_col, F.col(text_col).cast("string").alias(text_col))
    return _mapped(rows, [text_col], model, {"embedding": "array<float>", "is_valid": "int"}, batch, apply).drop(text_col)
