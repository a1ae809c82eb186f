"""What the training-data operators share: scratch tables, Arrow text batches and vectorised hashes."""

from __future__ import annotations

import ctypes
import gc
import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.scratch import scratch_dir

#: Bytes of text that a Python worker handles at once; a longer text comes alone.
SLICE_BYTES = 2 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back, which cuts its lineage."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the context cleaner find what finished steps have left, above all their shuffle files, which
    otherwise stay on the executors' disks until the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(table: DataFrame) -> None:
    """Deletes the files behind a materialized table that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()[:1]}:
        drop_folder(table.sparkSession, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(path: str):
    """(filesystem, path on it) of a URI or a plain path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_array(path: str, array: np.ndarray) -> str:
    """Writes an array for all tasks to the shared folder; they read it with ``read_array``."""
    files, own = filesystem(path)
    files.create_dir(own.rpartition("/")[0], recursive=True)
    held = io.BytesIO()
    np.save(held, array)
    with files.open_output_stream(own) as out:
        out.write(held.getbuffer())
    return path


@lru_cache(maxsize=1)
def read_array(path: str) -> np.ndarray:
    """The array in the one copy that was read."""
    files, own = filesystem(path)
    with files.open_input_file(own) as source:
        data = source.read_buffer()
    head = io.BytesIO(data.slice(0, min(1024, data.size)).to_pybytes())
    np.lib.format.read_magic(head)
    shape, columns, dtype = np.lib.format.read_array_header_1_0(head)
    return np.frombuffer(data, dtype, offset=head.tell()).reshape(shape, order="F" if columns else "C")


def give_back() -> None:
    """Returns memory that freed arrays have left to the system, which the C library would else keep for later."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
    pa.default_memory_pool().release_unused()


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column of ``taken`` is called so, in either case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def named(column: str) -> Column:
    """A column by its name, which may hold dots."""
    return F.col(f"`{column.replace('`', '``')}`")


def binary_texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column's UTF-8 bytes with 64-bit offsets; nulls become empty."""
    values = batch.column(batch.schema.get_field_index(column))
    if values.null_count:
        values = values.fill_null("" if not pa.types.is_binary(values.type) else b"")
    return values.cast(pa.large_binary())


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yields (rows, bytes, offsets) with about ``limit`` bytes of text at most, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = binary_texts(batch, column)
        _, offsets, data = values.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(values):
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(values))
            a, b = int(offsets[first]), int(offsets[last])
            yield batch.slice(first, last - first), data[a:b], offsets[first : last + 1] - a
            first = last


# polynomial hashes modulo 2^64, which give the hash of any substring from two prefix sums

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    table = _tables.get(base)
    if table is None or len(table) < n:
        grown = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        grown[0] = 1
        table = np.multiply.accumulate(grown)
        if n <= 4 * SLICE_BYTES:
            _tables[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place, for uint64."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``substring_hash`` takes its hashes; one longer than the data."""
    out = np.zeros(len(data) + 1, np.uint64)
    term = data.astype(np.uint64)
    term += np.uint64(1)
    term *= _powers(BASE, len(data))
    np.cumsum(term, out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = prefix[end] - prefix[start]
    h *= _powers(INVERSE, len(prefix))[start]
    return mix(h)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` and the index of its text."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    if len(data):
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[0], inside[-1]
        cuts = offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        both = cuts[inside[cuts] & inside[cuts - 1]]
    else:
        both = np.zeros(0, np.int64)
    at = np.flatnonzero(edge)
    if len(both):  # a word at a text's end beside a word at the next one's start
        at = np.sort(np.concatenate([at, both, both]))
    start, end = at[0::2], at[1::2]
    return start, end, np.searchsorted(offsets, start, "right") - 1
