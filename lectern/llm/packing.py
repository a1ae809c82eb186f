"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``: attention stays within a document. Pieces,
in descending order of cost, go to the sequence of the lowest cost that has room for them, found in a tree
over rooms; one that fits nowhere is cut. Each task packs what it tokenises, a block of tokens at a time, so that nothing is
shuffled, memory is bounded, and a lost task packs its rows again in the same way.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SEQUENCE_TOKENS = 2048
BLOCK_TOKENS = 2_000_000
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("sequence_cost", pa.float64())])
_SPECIAL = "<|endoftext|>"
_encoders: dict[tuple[str, str], Callable[[str], list[int]]] = {}


def encoder(json_path: str, ranks_path: str | None) -> Callable[[str], list[int]]:
    """Ids as the JSON file's tokenizer gives them. The same vocabulary's ranks, if given, are read by the
    faster library; a text that holds the special token's string always goes to the first."""
    key = (json_path, ranks_path or "")
    if key in _encoders:
        return _encoders[key]
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    encode = lambda text: slow.encode(text, add_special_tokens=False).ids
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        plain = encode
        encode = lambda text: plain(text) if _SPECIAL in text else fast.encode_ordinary(text)
    _encoders[key] = encode
    return encode


class _Open:
    """Open sequences by room: the cheapest one with room for a length, in steps that don't depend on how many
    there are. Each leaf of the tree is a room, with a heap of the (cost, sequence) that have just that room;
    each inner node holds the least head below it."""

    def __init__(self, count: int, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.least: list[tuple[float, int] | None] = [None] * (2 * self.size)
        self.heaps[capacity] = [(0.0, k) for k in range(count)]  # in order, so a heap
        self._climb(capacity)

    def _climb(self, room: int) -> None:
        heap = self.heaps[room]
        at = room + self.size
        self.least[at] = heap[0] if heap else None
        while at > 1:
            at >>= 1
            a, b = self.least[2 * at], self.least[2 * at + 1]
            self.least[at] = a if b is None or (a is not None and a <= b) else b

    def take(self, length: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest one with room for ``length``, which is taken out."""
        best, where = None, 0
        low, high = length + self.size, 2 * self.size
        while low < high:
            if low & 1:
                if (x := self.least[low]) is not None and (best is None or x < best):
                    best, where = x, low
                low += 1
            if high & 1:
                high -= 1
                if (x := self.least[high]) is not None and (best is None or x < best):
                    best, where = x, high
            low >>= 1
            high >>= 1
        if best is None:
            return None
        while where < self.size:
            where = 2 * where if self.least[2 * where] == best else 2 * where + 1
        room = where - self.size
        heapq.heappop(self.heaps[room])
        self._climb(room)
        return (*best, room)

    def put(self, cost: float, k: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, k))
        self._climb(room)


def assign(lengths: list[int], capacity: int = SEQUENCE_TOKENS, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length), which cover each item once and hold ``capacity`` at most.

    As many sequences are opened as the tokens need; only the last ones to fill may keep room. A piece goes to
    the cheapest sequence with room for all of it; if there is none, the cheapest with any room takes what it
    can and the rest is placed in the same way. Ties go to the sequence opened first.
    """
    cost = lambda n: linear * n + quadratic * n * n
    out: list[list[tuple[int, int, int]]] = []
    rest = []
    for item, n in enumerate(lengths):
        whole = n // capacity if n > capacity else 0
        for k in range(whole):
            out.append([(item, k * capacity, capacity)])
        if n - whole * capacity:
            rest.append((n - whole * capacity, item, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    count = -(-sum(n for n, _, _ in rest) // capacity)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    open_ = _Open(count, capacity)
    for n, item, start in rest:
        while n:
            spent, k, room = open_.take(n) or open_.take(1)
            take = min(n, room)
            bins[k].append((item, start, take))
            start, n = start + take, n - take
            if room > take:
                open_.put(spent + cost(take), k, room - take)
    return out + [x for x in bins if x]


def _packer(id_col: str, text_col: str, json_path: str, ranks_path: str | None, capacity: int, linear: float, quadratic: float, block: int):
    def run(batches):
        encode = encoder(json_path, ranks_path)
        sequence = TaskContext.get().partitionId() << 32

        def flush(ids, tokens):
            nonlocal sequence
            cols = [[] for _ in range(9)]
            for pieces in assign([len(t) for t in tokens], capacity, linear, quadratic):
                at, total = 0, sum(n for _, _, n in pieces)
                spent = sum(linear * n + quadratic * n * n for _, _, n in pieces)
                for item, start, n in pieces:
                    row = (ids[item], start, n, zlib.crc32(tokens[item][start : start + n].tobytes()), len(tokens[item]), sequence, at, total, spent)
                    for c, v in zip(cols, row):
                        c.append(v)
                    at += n
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

        ids, tokens, held = [], [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            values = batch.column(1)
            for i, key in enumerate(keys):
                found = encode(values[i].as_py() or "")
                own = np.empty(len(found) + 1, "<u4")
                own[:-1] = found
                own[-1] = END_ID
                ids.append(key)
                tokens.append(own)
                held += len(own)
                if held >= block:
                    yield flush(ids, tokens)
                    ids, tokens, held = [], [], 0
        if ids:
            yield flush(ids, tokens)

    return run


def pack(docs: DataFrame, tokenizer_json: str, tokenizer_ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, linear: float = 1.0, quadratic: float = 1 / 2048, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    sequence's tokens and cost.

    A null or empty text is the end id alone. Repeated rows are packed each on their own; a null id stays
    null; no rows give no pieces; other columns aren't read. All but the last sequences of a block of ``block_tokens`` are full.
    """
    from pyspark.sql import functions as F

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packer("doc_id", "text", tokenizer_json, tokenizer_ranks, capacity, linear, quadratic, block_tokens), SCHEMA)
