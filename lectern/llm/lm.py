"""Language-model scores by a probabilistic suffix tree over words.

Nothing is cut by relative frequency: every n-gram that the training texts hold twice takes part, so the tree
grows with the corpus and doesn't depend on how the input is split. Contexts of up to ``depth`` words are
states if their next words diverge from those of their suffix, whose probabilities they are smoothed with.

Texts are written once as blocks of word numbers. An n-gram is told by a 64-bit key that its first and its last
words but one make; the table of all keys lies in parts by the key's first bits, one for each task of a shuffle,
and what is sent between tasks are packed arrays, each for one part:

1. Counts: blocks send their n-grams, by context, to the part of the context, which adds them up.
2. States, order by order: each n-gram that came twice asks for its suffix's probability in the part of the
   suffix and takes it to the part of its context, where the states are chosen. Only n-grams whose context came
   twice are counted one order up; a bitmap of bounded size, which may err to the safe side, says which.
3. Weights. As a context backs off by a factor, the log of a token's probability is a sum over the n-grams that
   end with it of one weight each: what its listing adds (as a next word) and its own factor (as a context).
4. Scores: blocks ask the parts for the weights of their n-grams, each once, and add the answers up by text.

A task holds one part, or one block, at a time. A part holds the words that follow a context twice, so that the
largest one is bounded by the vocabulary.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import _common
from lectern.llm._common import LOWER, binary_texts, drop_folder, drop_table, free_shuffles, give_back, materialize, mix, named, prefix_hash, read_array, scratch_dir, substring_hash, words, write_array

END = np.uint64(0xE4D)
_C1, _C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_HALF = np.uint64(32)
#: Bytes of text that are hashed at once; sums over them take some forty times as much.
HASHED_BYTES = 1 << 19
#: Bytes that an executor and its Python workers exchange at once, or one larger row.
BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class TreeParams:
    #: Words of the longest context.
    depth: int = 3
    #: An n-gram that comes less often can't be told from chance and isn't listed.
    least_count: int = 2
    #: Least divergence from the suffix's distribution, in nats, and its significance in standard deviations.
    divergence: float = 0.02
    deviations: float = 4.0
    #: Absolute discount of the next words' counts.
    discount: float = 0.75
    #: Bytes of text in a block; a longer text is cut between words.
    block_bytes: int = 4 << 20
    #: Most bits, as a power of two, of the bitmaps that every task holds.
    bitmap: int = 28
    #: Rounds in which n-grams are counted, and in which they are asked for and texts scored, each for a range of keys,
    #: so that what is sent at once takes so much less of the disks. Later ones find more on the disks already.
    count_rounds: int = 2
    rounds: int = 3
    #: Blocks of this size in all need no more rounds than one; results are the same.
    round_bytes: int = 16 << 20


def held_out(doc_id: int | None, modulus: int = 7, remainder: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == remainder


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _C1 + b * _C2)


def longer(keys: np.ndarray) -> np.ndarray:
    """The keys of the n-grams one word longer that end at each place but the first, from those of its two parts."""
    out = np.zeros(len(keys), np.uint64)
    out[1:] = pair_key(keys[:-1], keys[1:])
    return out


# blocks

_BLOCK = "block long, rows array<long>, ids array<long>, sizes array<int>, lead array<int>, whole array<boolean>, words binary, tokens binary"
_BLOCK_NAMES = ["block", "rows", "ids", "sizes", "lead", "whole", "words", "tokens"]
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def _cut(data: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Pieces of ``limit`` bytes and what the last word of each takes more."""
    out, at = [], 0
    while len(data) - at > limit:
        end = at + limit
        while end < len(data) and not len(found := np.flatnonzero(_SPACES[data[end : end + limit]])):
            end += limit
        end = end + int(found[0]) if end < len(data) else len(data)
        out.append((at, end))
        at = end
    return [*out, (at, len(data))] if at < len(data) or not out else out


@dataclass
class _Held:
    """Texts that become one block: their words' hashes, and for each text row, id, tokens, lead and wholeness."""

    token: list
    rows: list
    ids: list
    sizes: list
    lead: list
    whole: list

    def packed(self, block: int) -> pa.RecordBatch:
        token = np.concatenate(self.token) if self.token else np.zeros(0, np.uint64)
        known, index, n = np.unique(token, return_inverse=True, return_counts=True)
        # Numbers by frequency: small ones come often, and the bytes of higher places are mostly zero.
        order = np.argsort(-n, kind="stable")
        number = np.empty(len(known), np.uint32)
        number[order] = np.arange(len(known), dtype=np.uint32)
        planes = _planes(number[index])
        lists = [pa.array([x], pa.list_(t)) for x, t in ((self.rows, pa.int64()), (self.ids, pa.int64()), (self.sizes, pa.int32()), (self.lead, pa.int32()), (self.whole, pa.bool_()))]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, pa.array([known[order].tobytes()], pa.binary()), pa.array([zstandard.ZstdCompressor(level=1).compress(planes)], pa.binary())], _BLOCK_NAMES)


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of ``HASHED_BYTES`` at most, or pieces of a longer text: the first text, bytes and offsets."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + HASHED_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        own = data[int(offsets[first]) : int(offsets[last])]
        if len(own) > HASHED_BYTES:
            for x, y in _cut(own, HASHED_BYTES):
                yield first, own[x:y], np.array([0, y - x])
        else:
            yield first, own, offsets[first : last + 1] - offsets[first]
        first = last


def _hashes(data: np.ndarray, offsets: np.ndarray, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts side by side and how many each has, with its end if asked for."""
    n = len(offsets) - 1
    found, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, piece, own in _slices(data, offsets):
        piece = LOWER[piece]
        start, stop, doc = words(piece, own)
        found.append(substring_hash(prefix_hash(piece), start, stop))
        docs.append(doc + first)
    h, doc = np.concatenate(found), np.concatenate(docs)
    sizes = np.bincount(doc, minlength=n)
    if not end:
        return h, sizes
    token = np.full(len(h) + n, END, np.uint64)
    token[np.arange(len(h)) + doc] = h
    return token, sizes + 1


def _blocks(p: TreeParams):
    def run(batches):
        block = row = TaskContext.get().partitionId() << 40
        held, size = _Held([], [], [], [], [], []), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            values = binary_texts(batch)
            _, offsets, data = values.buffers()
            offsets = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
            data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            first = 0
            while first < len(ids):
                last = int(np.searchsorted(offsets, offsets[first] + max(1, p.block_bytes - size), "right")) - 1
                last = min(max(last, first + 1), len(ids))
                a, b = int(offsets[first]), int(offsets[last])
                pieces = _cut(data[a:b], p.block_bytes) if last == first + 1 else [(0, b - a)]
                if len(pieces) == 1:
                    token, sizes = _hashes(data[a:b], offsets[first : last + 1] - a, True)
                    held.token.append(token)
                    held.rows += range(row, row + last - first)
                    held.ids += ids[first:last]
                    held.sizes += sizes.tolist()
                    held.lead += [0] * (last - first)
                    held.whole += [True] * (last - first)
                    size += b - a
                else:
                    lead = np.zeros(0, np.uint64)
                    for k, (x, y) in enumerate(pieces):
                        token, _ = _hashes(data[a + x : a + y], np.array([0, y - x]), k == len(pieces) - 1)
                        own = np.append(lead, token)
                        one = _Held([own], [row], [ids[first]], [len(own)], [len(lead)], [False])
                        yield one.packed(block)
                        block += 1
                        lead = own[-p.depth :]
                row += last - first
                first = last
                if size >= p.block_bytes:
                    yield held.packed(block)
                    block, held, size = block + 1, _Held([], [], [], [], [], []), 0
        if held.rows:
            yield held.packed(block)
        _common._tables.clear()  # the worker, which later steps use again, would keep them
        give_back()

    return run


@dataclass
class Block:
    rows: np.ndarray
    ids: list
    whole: np.ndarray
    #: Hash of each token and the index of its text; whether it is this block's to count and score; how many
    #: tokens of the text come before it.
    token: np.ndarray
    doc: np.ndarray
    own: np.ndarray
    before: np.ndarray
    #: The words and each token's.
    words: np.ndarray
    number: np.ndarray


def _open(row: dict) -> Block:
    size = np.asarray(row["sizes"], np.int64)
    n = int(size.sum())
    known = np.frombuffer(row["words"], np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"], max_output_size=4 * n + 1), np.uint8) if n else np.zeros(0, np.uint8)
    planes = planes.reshape(4, -1)
    number = planes[0].astype(np.uint32)
    for k in range(1, 4):
        if planes[k].any():
            number |= planes[k].astype(np.uint32) << np.uint32(8 * k)
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
    before = np.arange(n, dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
    lead = np.asarray(row["lead"], np.int32)
    own = before >= lead[doc] if lead.any() else np.ones(n, bool)
    return Block(np.asarray(row["rows"], np.int64), list(row["ids"]), np.asarray(row["whole"], bool), known[number], doc, own, before, known, number)


def _rows(batch: pa.RecordBatch, names=_BLOCK_NAMES) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_buffer() if c in ("words", "tokens") else batch.column(c)[i].as_py() for c in names}


# packed arrays by part

_SENT = "part int, kind int, block long, n long, data binary"
_SENT_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> _HALF) * np.uint64(parts) >> _HALF).astype(np.int32)


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on, as high ones are mostly alike."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


_RAW = (np.uint64, np.float32)


def _pack(columns: list[np.ndarray]) -> bytes:
    """The first column, keys in about their order, as differences, and whole numbers by planes, compressed; hashes and
    weights, which can't be, as they are behind them."""
    first = columns[0].copy()
    first[1:] -= columns[0][:-1]
    packed = zstandard.ZstdCompressor(level=1).compress(b"".join(map(_planes, [first, *[x for x in columns[1:] if x.dtype not in _RAW]])))
    return b"".join([len(packed).to_bytes(8, "little"), packed, *[x.tobytes() for x in columns[1:] if x.dtype in _RAW]])


def _unpack(data: bytes, n: int, *types) -> list[np.ndarray]:
    raw = [False, *[t in _RAW for t in types[1:]]]
    size = 8 + int.from_bytes(data[:8], "little")
    plain = zstandard.ZstdDecompressor().decompress(data[8:size], max_output_size=n * sum(np.dtype(t).itemsize for t, r in zip(types, raw) if not r))
    out, at = [], 0
    for t, r in zip(types, raw):
        width = np.dtype(t).itemsize
        if r:
            out.append(np.frombuffer(data, t, n, size))
            size += n * width
        else:
            out.append(np.ascontiguousarray(np.frombuffer(plain, np.uint8, n * width, at).reshape(width, n).T).view(t).reshape(-1))
            at += n * width
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _split(by: np.ndarray, columns: list[np.ndarray], parts: int, kind: int, block: int | None = None) -> pa.RecordBatch | None:
    """A row for each part of ``by``, which is sorted by its upper half at least."""
    part = part_of(by, parts)
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    if not len(edges):
        return None
    stops = np.append(edges[1:], len(part))
    data = [_pack([c[a:b] for c in columns]) for a, b in zip(edges.tolist(), stops.tolist())]
    m = len(edges)
    return pa.RecordBatch.from_arrays([pa.array(part[edges]), pa.array(np.full(m, kind, np.int32)), pa.array([block] * m, pa.int64()), pa.array(stops - edges), pa.array(data, pa.binary())], schema=_SENT_ARROW)


def _table(rounds: Iterable[DataFrame], name: str) -> tuple[DataFrame, str]:
    """Packed arrays of several rounds written one after the other, by kind, and their folder."""
    path = ""
    for df in rounds:
        path = path or scratch_dir(df.sparkSession, name)
        df.write.mode("append").partitionBy("kind").parquet(path)
        free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns), path


def _parted(df: DataFrame, cut: tuple[int, int] | None = None) -> DataFrame:
    """One task a part, of all or those in ``cut``, its rows by kind."""
    first, last = cut or (0, _parts(df))
    return df.repartitionById(last - first, F.col("part") - first).sortWithinPartitions("part", "kind")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_part(batches) -> Iterator[tuple[int, Iterator[tuple[int, int | None, int, bytes]]]]:
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() if c != "data" else b.column(c) for c in ("part", "kind", "block", "n", "data"))))
    for part, own in groupby(rows, key=lambda r: r[0]):
        yield part, ((kind, block, n, data.as_py()) for _, kind, block, n, data in own)
        give_back()


# 1: counts


def _bit(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _sum(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, n) by first, each pair once."""
    # One sort of 64 bits: equal pairs come together, and others between them only by chance, which adds up later.
    order = np.argsort((first & _HIGH) | (second >> _HALF))
    first, second, n = first[order], second[order], n[order]
    new = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))) if len(first) else order
    return first[new], second[new], np.add.reduceat(n, new, dtype=n.dtype) if len(new) else n


def _exact(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, n) by first, each pair, as its key tells it, once."""
    keys = pair_key(first, second)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
    del keys
    n = np.add.reduceat(n[order], new, dtype=np.int64) if len(new) else n.astype(np.int64)
    at = order[new]
    del order, new
    by_first = np.argsort(first[at])
    at = at[by_first]
    return first[at], second[at], n[by_first]


def _inside(parts: int, first: int, last: int):
    """Whether keys are of the parts from ``first`` to before ``last``."""
    low, high = (np.uint64(-(-(x << 32) // parts)) << _HALF if x < parts else None for x in (first, last))
    return lambda keys: (keys >= low) & (keys < high) if high is not None else keys >= low


def _counts(order: int, parts: int, bitmap: str | None, cut: tuple[int, int]):
    """A block's n-grams of ``order`` words as (context, suffix, n); with order 2 its words too, as (word, n). Where the
    bitmap says that a suffix came but once, which nothing follows twice, it is written as 0. Only contexts
    of the parts in ``cut`` are sent."""
    inside = _inside(parts, *cut)

    def run(batches):
        bits = read_array(bitmap) if bitmap else None
        for batch in batches:
            for row in _rows(batch):
                b = _open(row)
                train = b.own & np.array([not held_out(i) for i in b.ids], bool)[b.doc]
                if order == 2 and train.any():
                    n = np.bincount(b.number[train], minlength=len(b.words)).astype(np.uint32)
                    at = np.flatnonzero((n > 0) & inside(b.words))
                    at = at[np.argsort(b.words[at])]
                    if (sent := _split(b.words[at], [b.words[at], n[at]], parts, _WORDS)) is not None:
                        yield sent
                keys = b.token
                for _ in range(order - 2):
                    keys = longer(keys)
                at = np.flatnonzero(train & (b.before >= order - 1))
                at = at[inside(keys[at - 1])]
                context, suffix = keys[at - 1], keys[at]
                if bits is not None:
                    likely = _bit(context, bits)
                    context, suffix = context[likely], suffix[likely]
                    suffix[~_bit(suffix, bits)] = 0
                context, suffix, n = _sum(context, suffix, np.ones(len(context), np.uint32))
                if (sent := _split(context, [context, suffix, n], parts, order)) is not None:
                    yield sent
        give_back()  # not between blocks, which take as much again

    return run


#: Rows that the adder leaves: words with their counts (n of the row has how many), n-grams that ask for their suffix.
_WORDS, _ASK, _KNOWN, _WEIGHT, _STATE, _TOTAL = 1, 2, 0, 5, 6, 9


def _columns(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The columns of several tables, which are let go of one by one; ``held`` is empty then."""
    columns = [list(x) for x in zip(*held)]
    held.clear()
    return [np.concatenate(columns.pop(0)) for _ in range(len(columns))]


def _adder(p: TreeParams, parts: int, most: int = 1 << 22):
    def run(batches):
        for _, rows in _by_part(batches):
            for kind, own in groupby(rows, key=lambda r: r[0]):
                held, waiting = [], 0
                for _, _, n, data in own:
                    if kind == _WORDS:
                        word, count = _unpack(data, n, np.uint64, np.uint32)
                        held.append((word, word, count))
                        del word, count
                    else:
                        held.append(tuple(_unpack(data, n, np.uint64, np.uint64, np.uint32)))
                    waiting += n
                    if waiting > most:
                        held, waiting = [_exact(*_columns(held))], 0
                context, suffix, n = _exact(*_columns(held))
                if kind == _WORDS:
                    yield _split(context, [context, n], parts, _WORDS)
                    yield pa.RecordBatch.from_pylist([{"part": 0, "kind": _TOTAL, "block": int(n.sum()), "n": len(n), "data": b""}], schema=_SENT_ARROW)
                    del context, suffix, n
                    continue
                first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(context))))
                keep = np.flatnonzero((n >= p.least_count) & (suffix != 0))
                keep = keep[np.argsort(suffix[keep])]
                kept = [x[keep] for x in (suffix, context, n, total)]
                del context, suffix, n, total, first, keep  # else they stay until the next part's take their place
                if (sent := _split(kept[0], kept, parts, _ASK)) is not None:
                    yield sent
                del kept, sent

    return run


# 2: states and weights


def _joiner(parts: int, total: int):
    """N-grams with their suffixes' share (of its own context) and log-probability, to the part of the context."""

    def run(batches):
        for _, rows in _by_part(batches):
            known, keys, share, log_p = [], np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
            for kind, own in groupby(rows, key=lambda r: r[0]):
                for _, _, n, data in own:
                    if kind == _KNOWN:
                        known.append([x.astype(np.float64) if i else x for i, x in enumerate(_unpack(data, n, np.uint64, np.float32, np.float32))])
                    elif kind == _WORDS:
                        word, count = _unpack(data, n, np.uint64, np.int64)
                        known.append((word, count / (total + 1), np.log10(count / (total + 1))))
                    else:
                        if known:
                            keys, share, log_p = map(np.concatenate, zip(*known))
                            order = np.argsort(keys)
                            keys, share, log_p, known = keys[order], share[order], log_p[order], []
                        suffix, context, count, whole = _unpack(data, n, np.uint64, np.uint64, np.int64, np.int64)
                        at = np.minimum(np.searchsorted(keys, suffix), max(len(keys) - 1, 0))
                        found = keys[at] == suffix if len(keys) else np.zeros(n, bool)
                        at, to = at[found], np.flatnonzero(found)
                        order = np.argsort(context[to])
                        at, to = at[order], to[order]
                        if (sent := _split(context[to], [context[to], suffix[to], count[to], whole[to], share[at].astype(np.float32), log_p[at].astype(np.float32)], parts, _ASK)) is not None:
                            yield sent

    return run


def stays(index: np.ndarray, n: np.ndarray, own: np.ndarray, lower: np.ndarray, p: TreeParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each context is a state and the suffix's weight in it, and each next word's own probability.
    ``index`` is the context of each next word; ``lower`` is its probability after the suffix."""
    size = np.bincount(index)
    total_own = np.zeros(len(size))
    total_own[index] = own
    mass = np.maximum(n - p.discount, 0) / np.maximum(own, 1)
    share = n / np.maximum(own, 1)
    kl = np.bincount(index, share * np.log(np.maximum(share, 1e-300) / lower))
    left = np.maximum(1 - np.bincount(index, share), 0)
    left_lower = np.maximum(1 - np.bincount(index, lower), 1e-12)
    kl = kl + np.where(left > 0, left * np.log(np.maximum(left, 1e-300) / left_lower), 0)
    diverges = (kl >= p.divergence) & (2 * total_own * kl > size + p.deviations * np.sqrt(2 * size))
    return diverges, 1 - np.bincount(index, mass), mass


def _weigher(p: TreeParams, parts: int, last: bool):
    """N-grams by context to what is known of them, for the next order, and to weights."""

    def run(batches):
        for _, rows in _by_part(batches):
            context, suffix, n, own, lower, log_p = map(np.concatenate, zip(*(_unpack(data, m, np.uint64, np.uint64, np.int64, np.int64, np.float32, np.float32) for _, _, m, data in rows)))
            lower, log_p = lower.astype(np.float64), log_p.astype(np.float64)
            order = np.argsort(context)
            context, suffix, n, own, lower, log_p = (x[order] for x in (context, suffix, n, own, lower, log_p))
            first = np.append(True, context[1:] != context[:-1])
            index = np.cumsum(first) - 1
            state, back, mass = stays(index, n, own, lower, p)
            log_back = np.log10(back)
            here = state[index]
            whole = np.where(here, np.log10(mass + back[index] * 10**log_p), log_p)
            keys = pair_key(context, suffix)
            order = np.argsort(keys)
            if not last:
                yield _split(keys[order], [keys[order], (n / own)[order].astype(np.float32), whole[order].astype(np.float32)], parts, _KNOWN)
            # What listing the word adds over backing off to the suffix; and the states' own weights.
            order = order[here[order]]
            if (sent := _split(keys[order], [keys[order], (whole - log_back[index] - log_p)[order].astype(np.float32)], parts, _WEIGHT)) is not None:
                yield sent
            at = np.flatnonzero(first)[state]
            if (sent := _split(context[at], [context[at], log_back[state].astype(np.float32)], parts, _STATE)) is not None:
                yield sent

    return run


def _heads(batches):
    """The upper halves of packed keys."""
    for batch in batches:
        if batch.num_rows:
            kinds = {_KNOWN: (np.uint64, np.float32, np.float32), _WEIGHT: (np.uint64, np.float32), _STATE: (np.uint64, np.float32)}
            data = [(_unpack(d.as_py(), n, *kinds[k])[0] >> _HALF).astype(np.uint32).tobytes() for d, n, k in zip(batch.column("data"), batch.column("n").to_pylist(), batch.column("kind").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("kind"), batch.column("block"), batch.column("n"), pa.array(data, pa.binary())], schema=_SENT_ARROW)


def _bits_of_part(power: int):
    """The bits of a part's range, from the byte that ``block`` says on."""

    def run(batches):
        for part, rows in _by_part(batches):
            at = np.unique(np.concatenate([np.frombuffer(data, np.uint32) >> np.uint32(32 - power) for _, _, _, data in rows])).astype(np.int64)
            low = int(at[0]) >> 3
            found = np.zeros(((int(at[-1]) >> 3) - low + 1) * 8, bool)
            found[at - low * 8] = True
            yield pa.RecordBatch.from_pylist([{"part": part, "kind": 0, "block": low, "n": 0, "data": np.packbits(found, bitorder="little").tobytes()}], schema=_SENT_ARROW)

    return run


def _bitmap(packed: DataFrame, p: TreeParams) -> str:
    """The file of a bit for each key of the packed arrays, which others may share: sixteen bits a key, as far as
    ``p.bitmap`` goes."""
    n = packed.agg(F.sum("n")).first()[0] or 0
    power = min(max((16 * n).bit_length(), 10), p.bitmap)
    bits = np.zeros(1 << (power - 3), np.uint8)
    found = _parted(packed.mapInArrow(_heads, _SENT)).mapInArrow(_bits_of_part(power), _SENT).select("block", "data").toArrow()
    for low, data in zip(found.column("block").to_pylist(), found.column("data").to_pylist()):
        bits[low : low + len(data)] |= np.frombuffer(data, np.uint8)
    return write_array(scratch_dir(packed.sparkSession, "lm-bits") + ".npy", bits)


@dataclass
class Model:
    """The tokens and words learnt from, for the n-grams of each order, from one word on, the tables of their counts
    and weights with their folders, and the bitmap of the weights' keys."""

    total: int
    words: int
    tables: list[list[tuple[DataFrame, str]]]
    bitmap: str
    folders: list[str]


def fit(blocks: DataFrame, p: TreeParams = TreeParams()) -> Model:
    parts = _parts(blocks)
    spark = blocks.sparkSession
    bits, known, total, types, folders = None, None, 0, 0, []
    tables: list[list[tuple[DataFrame, str]]] = [[] for _ in range(p.depth + 1)]
    for order in range(2, p.depth + 2):
        sent = ((blocks.mapInArrow(_counts(order, parts, bits, cut), _SENT), cut) for cut in _cuts(parts, p.count_rounds))
        counted, counted_in = _table((_parted(*x).mapInArrow(_adder(p, parts), _SENT) for x in sent), f"lm-counts-{order}")
        if order == 2:
            sums = counted.where(F.col("kind") == _TOTAL).agg(F.sum("block"), F.sum("n")).first()
            total, types = int(sums[0] or 0), int(sums[1] or 0)
            known = counted.where(F.col("kind") == _WORDS)
            tables[0].append((known, f"{counted_in}/kind={_WORDS}"))
        asked, asked_in = _table([_parted(counted.where(F.col("kind") == _ASK).unionByName(known)).mapInArrow(_joiner(parts, total), _SENT)], f"lm-asked-{order}")
        for old in [f"{counted_in}/kind={_ASK}", *[f"{x}/kind={_KNOWN}" for x in folders[1:][-1:]]]:
            drop_folder(spark, old)
        found, found_in = _table([_parted(asked).mapInArrow(_weigher(p, parts, order == p.depth + 1), _SENT)], f"lm-weights-{order}")
        drop_folder(spark, asked_in)
        folders += [counted_in, found_in] if order == 2 else [found_in]
        known = found.where(F.col("kind") == _KNOWN)
        for at, kind in ((order - 1, _WEIGHT), (order - 2, _STATE)):
            tables[at].append((found.where(F.col("kind") == kind), f"{found_in}/kind={kind}"))
        if bits:
            drop_folder(spark, bits)
        if order <= p.depth:
            bits = _bitmap(known, p)
    return Model(total, types, tables, _bitmap(_union([t for t, _ in sum(tables, [])[1:]]), p), folders)


def _cuts(parts: int, rounds: int) -> list[tuple[int, int]]:
    """The parts of each round."""
    edges = [parts * k // rounds for k in range(rounds + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


# 4: scores


def _asked(b: Block, order: int, keys: np.ndarray, bits: np.ndarray, inside=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose n-grams may have a weight, the keys of these, each once and sorted, and each place's among them."""
    at = np.flatnonzero(b.own & (b.before >= order - 1))
    if inside:  # first, as the bitmap is far larger than a cache
        at = at[inside(keys[at])]
    at = at[_bit(keys[at], bits)]
    found = keys[at]
    by_key = np.argsort(found)
    found = found[by_key]
    new = np.append(True, found[1:] != found[:-1]) if len(found) else np.zeros(0, bool)
    index = np.empty(len(at), np.int64)
    index[by_key] = np.cumsum(new) - 1
    return at, found[new], index


def _asks(order: int, parts: int, bitmap: str, cut: tuple[int, int]):
    inside = _inside(parts, *cut)

    def run(batches):
        bits = read_array(bitmap)
        for batch in batches:
            for row in _rows(batch):
                if order == 1:
                    asked = np.sort(np.frombuffer(row["words"], np.uint64))
                    asked = asked[inside(asked)]
                else:
                    b = _open(row)
                    keys = b.token
                    for _ in range(order - 1):
                        keys = longer(keys)
                    asked = _asked(b, order, keys, bits, inside)[1]
                if (sent := _split(asked, [asked], parts, 10 + order, row["block"])) is not None:
                    yield sent
        give_back()

    return run


def _answers(batches):
    """Asked keys' weights, and words' counts before them, by block; ``kind`` is the order that was asked for."""

    def table(held):
        if not held:
            return np.zeros(0, np.uint64), np.zeros(0)
        keys, values = map(np.concatenate, zip(*held))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[new], np.add.reduceat(values, new)

    def of(keys, values, wanted):
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    for part, rows in _by_part(batches):
        counts, weights, count, weight = [], [], None, None
        for kind, block, n, data in rows:
            if kind < 10:
                key, value = _unpack(data, n, np.uint64, np.int64 if kind == _WORDS else np.float32)
                (counts if kind == _WORDS else weights).append((key, value.astype(np.float64)))
                continue
            if count is None:
                count, weight = table(counts), table(weights)
                counts, weights = [], []
            (wanted,) = _unpack(data, n, np.uint64)
            found = of(*weight, wanted).astype(np.float32).tobytes()
            if kind == 11:
                found = of(*count, wanted).tobytes() + found
            found = zstandard.ZstdCompressor(level=1).compress(found)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (kind, pa.int32()), (block, pa.int64()), (n, pa.int64()), (found, pa.binary()))], schema=_SENT_ARROW)


_SUMS = "row long, doc_id long, whole boolean, n_tokens long, n_known long, base double, own double"
_SUMS_NAMES = ["row", "doc_id", "whole", "n_tokens", "n_known", "base", "own"]


def _scorer(p: TreeParams, bitmap: str):
    """Blocks, each followed by the answers to it by kind and part, to the sums of its texts."""

    def numbers(answers: list[tuple[int, bytes]], counts: bool = False) -> list[np.ndarray]:
        raw = [(m, zstandard.ZstdDecompressor().decompress(d, max_output_size=(12 if counts else 4) * m)) for m, d in answers]
        weights = np.concatenate([np.frombuffer(d, np.float32, m, 8 * m if counts else 0) for m, d in raw]).astype(np.float64)
        return [np.concatenate([np.frombuffer(d, np.float64, m) for m, d in raw]), weights] if counts else [weights]

    def sums(b: Block, answers: dict[int, list[tuple[int, bytes]]]):
        n = len(b.ids)
        pick = np.flatnonzero(b.own)
        doc = b.doc[pick]
        value = np.zeros(len(b.words))
        count = np.zeros(len(b.words))
        at = np.argsort(b.words)
        if len(at):
            count[at], value[at] = numbers(answers[11], counts=True)
        by_text = lambda x: np.bincount(doc, x, minlength=n)
        number = b.number[pick]
        own = by_text((np.log10(np.maximum(count, 1)) + value)[number])
        base, known = by_text(np.log10(count + 1)[number]), by_text((count > 0)[number])
        keys = b.token
        bits = read_array(bitmap)
        for order in range(2, p.depth + 2):
            keys = longer(keys)
            places, asked, index = _asked(b, order, keys, bits)
            if len(asked):
                (weight,) = numbers(answers[10 + order])
                own += np.bincount(b.doc[places], weight[index], minlength=n)
        columns = [pa.array(b.rows), pa.array(b.ids, pa.int64()), pa.array(b.whole), pa.array(by_text(None).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(own)]
        return pa.RecordBatch.from_arrays(columns, _SUMS_NAMES)

    def run(batches):
        held, answers = None, {}
        for batch in batches:
            kinds, sizes, data = batch.column("kind").to_pylist(), batch.column("n").to_pylist(), batch.column("data")
            for i, kind in enumerate(kinds):
                if kind < 0:
                    if held is not None:
                        yield sums(held, answers)
                    held, answers = _open({c: batch.column(c)[i].as_py() for c in _BLOCK_NAMES}), {}
                else:
                    answers.setdefault(kind, []).append((sizes[i], data[i].as_py()))
        if held is not None:
            yield sums(held, answers)

    return run


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Limits what goes between an executor and its Python workers at once, of which both hold copies."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(name, min(size, BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _sums(docs: DataFrame, p: TreeParams) -> tuple[DataFrame, Model]:
    """The sums of each text, or piece of a long one, and what they were found with."""
    blocks = materialize(docs.mapInArrow(_blocks(p), _BLOCK), "lm-blocks")
    size = blocks.agg(F.sum(F.octet_length("words") + F.octet_length("tokens"))).first()[0] or 0
    if size < p.round_bytes:
        p = replace(p, count_rounds=1, rounds=1)
    model = fit(blocks, p)
    parts = _parts(docs)
    several = []
    for order, tables in enumerate(model.tables, 1):
        for cut in _cuts(parts, p.rounds if 1 < order <= p.depth else 1):  # words and the longest n-grams are fewer
            asks = blocks.mapInArrow(_asks(order, parts, model.bitmap, cut), _SENT)
            own = [t.where(F.col("part").between(cut[0], cut[1] - 1)) for t, _ in tables]
            several.append(materialize(_parted(_union([asks, *own]), cut).mapInArrow(_answers, _SENT), "lm-answers"))
        for _, folder in tables:
            drop_folder(docs.sparkSession, folder)
    answers = _union(several)
    for folder in model.folders:
        drop_folder(docs.sparkSession, folder)
    none = [F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in _BLOCK.split(", ")[1:])]
    both = answers.select("block", "kind", "part", "n", "data", *none).unionByName(blocks.select("block", F.lit(-1).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("data"), *_BLOCK_NAMES[1:]))
    path = scratch_dir(docs.sparkSession, "lm-sums")
    for k in range(p.rounds):
        own = both.where(F.col("block") % p.rounds == k).repartition(-(-parts // p.rounds), "block").sortWithinPartitions("block", "kind", "part")
        own.mapInArrow(_scorer(p, model.bitmap), _SUMS).write.mode("append").parquet(path)
        free_shuffles(docs.sparkSession)
    found = docs.sparkSession.read.schema(_SUMS).parquet(path)
    for table in (*several, blocks):
        drop_table(table)
    return found, model


def score(docs: DataFrame, p: TreeParams = TreeParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, and one end are its tokens. A null or
    empty text is its end alone. Repeated rows count as often as they come, and each gets its row. With no
    training text every token is unknown; no rows give none. Long texts are read in pieces, each with the
    words before it as contexts. Other columns aren't read. Words are told apart by 64-bit hashes.
    """
    docs = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    with _small_batches(docs.sparkSession):
        found, model = _sums(docs, p)
    pieces = found.where("not whole").groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in _SUMS_NAMES[3:]]).drop("row")
    per_row = found.where("whole").drop("row", "whole").unionByName(pieces)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return per_row.select(
        F.col("doc_id").alias(id_col),
        held.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(model.total + model.words + 1))).alias("base_score"),
        (F.col("own") - F.col("n_tokens") * F.lit(math.log10(model.total + 1))).alias("score"),
    )
