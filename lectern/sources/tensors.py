"""Embedding files as PyTorch writes them (``.pt``: a zip with a pickled dictionary of path to tensor), read without
PyTorch. Only tensors, plain containers and numbers are made; anything else in the pickle is refused."""

from __future__ import annotations

import io
import pickle
import zipfile
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4", "BFloat16Storage": "bf16"}


class _Storage:
    def __init__(self, name: str):
        self.kind = _STORAGES[name]


def _tensor(values: np.ndarray, offset: int, size: tuple, stride: tuple, *_) -> np.ndarray:
    last = offset + sum((n - 1) * s for n, s in zip(size, stride)) if all(size) else offset - 1
    if offset < 0 or any(s < 0 for s in stride) or last >= len(values):
        raise ValueError("a tensor reaches out of its storage")
    return np.lib.stride_tricks.as_strided(values[offset:], size, tuple(s * values.itemsize for s in stride)).astype(np.float32)


class _Reader(pickle.Unpickler):
    def __init__(self, source: io.BytesIO, files: zipfile.ZipFile, root: str):
        super().__init__(source)
        self.files, self.root = files, root

    def find_class(self, module: str, name: str):
        if module == "torch" and name in _STORAGES:
            return _Storage(name)
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _tensor
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        raise pickle.UnpicklingError(f"{module}.{name} isn't read from embedding files")

    def persistent_load(self, found: tuple) -> np.ndarray:
        mark, storage, key, _, count = found
        if mark != "storage" or not isinstance(storage, _Storage) or not str(key).isalnum():
            raise pickle.UnpicklingError("a storage is expected")
        raw = self.files.read(f"{self.root}/data/{key}")
        if storage.kind == "bf16":  # the upper half of a float32
            return (np.frombuffer(raw, "<u2", count).astype("<u4") << 16).view("<f4")
        return np.frombuffer(raw, storage.kind, count)


def load(data: bytes) -> dict[str, np.ndarray]:
    """Path to vector, in the file's order."""
    with zipfile.ZipFile(io.BytesIO(data)) as files:
        (name,) = [n for n in files.namelist() if n.endswith("/data.pkl")]
        found = _Reader(io.BytesIO(files.read(name)), files, name.removesuffix("/data.pkl")).load()
    if not isinstance(found, dict) or not all(isinstance(k, str) and isinstance(v, np.ndarray) and v.ndim == 1 for k, v in found.items()):
        raise ValueError("the file doesn't hold vectors by path")
    return dict(found)


def read_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """(file, place, path, embedding) of all ``.pt`` files below ``folder``; (file, place) is their order."""
    kind = "file string, place long, path string, embedding array<float>"

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = load(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(np.arange(len(rows))), pa.array(list(rows)), pa.array([v.tolist() for v in rows.values()], pa.list_(pa.float32()))], ["file", "place", "path", "embedding"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pt").load(folder)
    return files.select(F.col("path"), "content").mapInArrow(run, kind)
