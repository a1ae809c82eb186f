"""Removal of long repeats by merged Burrows-Wheeler transforms.

A window is a string of ``length`` bytes within a text; it repeats if it starts anywhere else, and all
bytes that repeated windows cover are removed.

Windows that are equal have the same minimiser, so only runs of windows whose minimiser recurs are looked
at further. A run that recurs as a whole repeats. Of all other runs one copy each, the run's own bytes, goes
to the task that owns its minimiser. There the runs are cut into shards, each shard's Burrows-Wheeler
transform is built, and the transforms are merged by refining their interleave: an interleave that is
right for d symbols gives, through the transforms alone, the one for d + 1, together with the places where
neighbours first differ. Its blocks after length / STRIDE rounds are the repeated windows. Symbols are the
STRIDE bytes at a position, and the transforms are those of the texts read in steps of STRIDE, so that a
window has exactly ``length / STRIDE`` symbols.

Texts travel as blocks of about two megabytes that are written once, compressed. A minimiser under which
more than ``hot_runs`` different runs meet is no task's alone: hashes of its windows are counted instead,
which a partial aggregation spreads.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import SLICE_BYTES, drop_table, give_back, materialize, prefix_hash, substring_hash, text_slices

LENGTH = 200
GRAM = 64
STRIDE = 40
HOT_RUNS = 20_000
SHARD_BYTES = 1 << 18
BATCH_BYTES = 1 << 20
#: Bits of a gram's place, the same in every slice, so that equal windows choose the same minimiser everywhere.
_PLACE_BITS = (2 * SLICE_BYTES + LENGTH).bit_length()


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i with a full window, in time that doesn't depend on w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // w)
    padded = np.full(rows * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(rows, w)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows of ``length`` bytes that share their minimiser: (h, u, anchor, first, last)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n > 2 * SLICE_BYTES:  # a long text, window by window start, so that memory doesn't grow with it
        parts = []
        for a in range(0, n, SLICE_BYTES):
            inner = np.unique(np.clip(offsets - a, 0, min(SLICE_BYTES + length - 1, n - a)))
            h, u, at, first, last = anchors(data[a : a + SLICE_BYTES + length - 1], inner, length, gram)
            parts.append((h, u, at + a, first + a, last + a))
        return tuple(np.concatenate(x) for x in zip(*parts))
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    h = substring_hash(prefix, at, at + gram)
    bits = np.uint64(_PLACE_BITS)
    packed = (h >> bits << bits) | at.astype(np.uint64)
    least = _sliding_min(packed, length - gram + 1)
    # A window is one of a text's own if it ends within it.
    last_start = np.repeat(offsets[1:] - length, np.diff(offsets))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) <= last_start)
    if not len(start):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    anchor = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))
    first = start[new]
    last = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
    anchor = anchor[new]
    return h[anchor], substring_hash(prefix, first, last + length), anchor, first, last


# transforms and their merge


def _stable_order(keys: np.ndarray) -> np.ndarray:
    """A stable argsort of small non-negative integers, by one sort of (key, place)."""
    packed = keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Runs:
    """Strings side by side, each with a place for its end, and the symbol at each place (0: fewer than
    STRIDE bytes are left there)."""

    def __init__(self, strings: list[bytes], stride: int = STRIDE):
        self.stride = stride
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(size + 1) - (size + 1)
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        n = len(data)
        self.owner = np.repeat(np.arange(len(strings)), size + 1)
        left = self.starts[self.owner] + size[self.owner] - np.arange(n)
        self.full = left >= stride
        self.symbol = np.zeros(n, np.int64)
        at = np.flatnonzero(self.full)
        if len(at):
            prefix = prefix_hash(data)
            _, dense = np.unique(substring_hash(prefix, at, at + stride), return_inverse=True)
            self.symbol[at] = dense + 1
        #: whether there is a whole symbol in front of a place within its string
        self.has_front = np.arange(n) - self.starts[self.owner] >= stride


def transform(runs: Runs, first: int, last: int) -> np.ndarray:
    """The suffixes' order for the places first..last, ends told apart by their strings' order; its
    Burrows-Wheeler transform has the symbol in front of each."""
    places = np.arange(first, last)
    short = places[~runs.full[first:last]]
    order = places
    while True:
        front = order[runs.has_front[order]] - runs.stride
        new = np.concatenate([short, front[_stable_order(runs.symbol[front])]])
        if len(new) == len(order) and np.array_equal(new, order):
            return order
        order = new


def merge(runs: Runs, cuts: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the merged order of ``depth`` symbols, whether each differs there from the one before).

    The shards are the places between neighbouring ``cuts``. Only their transforms are used: an interleave
    says which shard each suffix comes from, and a shard's own suffixes never change their order.
    """
    orders = [transform(runs, a, b) for a, b in zip(cuts, cuts[1:])]
    sizes = [len(x) for x in orders]
    places = np.concatenate(orders)
    source = np.repeat(np.arange(len(orders)), sizes).astype(np.uint8 if len(orders) < 256 else np.int32)
    has = runs.has_front[places]
    front = np.where(has, runs.symbol[places - np.where(has, runs.stride, 0)], 0)  # the transforms, side by side
    shorts = np.array([np.count_nonzero(~runs.full[x]) for x in orders])
    lead = np.repeat(np.arange(len(orders)), shorts).astype(source.dtype)
    interleave, differs = source, np.ones(len(source), bool)
    differs[1:] = False  # no symbol read: one block
    for _ in range(depth):
        where = np.empty(len(interleave), np.int64)
        where[np.argsort(interleave, kind="stable")] = np.arange(len(interleave))  # the k-th of a shard, shards side by side
        symbol = front[where]
        mapped = np.flatnonzero(has[where])
        picked = mapped[_stable_order(symbol[mapped])]
        block = np.cumsum(differs)[picked]
        symbol = symbol[picked]
        interleave = np.concatenate([lead, interleave[picked]])
        fresh = np.ones(len(picked), bool)
        fresh[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        differs = np.concatenate([np.ones(len(lead), bool), fresh])
    where = np.empty(len(interleave), np.int64)
    where[np.argsort(interleave, kind="stable")] = np.arange(len(interleave))
    return places[where], differs


def repeated_starts(strings: list[bytes], length: int = LENGTH, stride: int = STRIDE, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of every window that the strings hold more than once."""
    if length % stride:
        raise ValueError("the length must be a multiple of the stride")
    runs = Runs(strings, stride)
    ends = np.append(runs.starts[1:], len(runs.owner))
    cuts, at = [0], 0
    for end in ends.tolist():
        if end - at >= shard_bytes:
            cuts.append(end)
            at = end
    if cuts[-1] != len(runs.owner):
        cuts.append(len(runs.owner))
    places, differs = merge(runs, cuts, length // stride)
    alone = differs & np.append(differs[1:], True)
    found = np.sort(places[~alone])
    owner = runs.owner[found]
    return owner, found - runs.starts[owner]


# blocks of texts

_BLOCK = "block long, ids array<long>, sizes array<int>, blob binary"
_ANCHOR = "h long, u long, block long, at long"


def _blocks(batches):
    seq = TaskContext.get().partitionId() << 24
    pack = zstandard.ZstdCompressor(level=3)
    for rows, data, offsets in text_slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(offsets).astype(np.int32)], pa.list_(pa.int32())), pa.array([pack.compress(data.tobytes())], pa.binary())], ["block", "ids", "sizes", "blob"])
        seq += 1


def _open(row: dict) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.asarray(row["sizes"], np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    raw = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=int(offsets[-1]) + 1) if offsets[-1] else b""
    return np.frombuffer(raw, np.uint8), offsets


def _rows(batch: pa.RecordBatch, *columns: str):
    cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
    for i in range(batch.num_rows):
        if i:
            give_back()
        yield {c: v[i].values if c == "ids" else v[i].values.to_numpy(zero_copy_only=False) if pa.types.is_list(v.type) and v[i].is_valid else v[i].as_py() for c, v in zip(columns, cols)}


def _anchors(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for row in _rows(batch, "block", "sizes", "blob"):
                data, offsets = _open(row)
                h, u, anchor, first, last = anchors(data, offsets, length, gram)
                # How far the run reaches to both sides of its anchor is less than ``length`` each.
                at = anchor << 24 | (anchor - first) << 12 | (last + length - anchor)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(u.view(np.int64)), pa.array(np.full(len(h), row["block"], np.int64)), pa.array(at)], ["h", "u", "block", "at"])

    return run


def _span(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    anchor = at >> 24
    return anchor - (at >> 12 & 0xFFF), anchor + (at & 0xFFF)


def _extract(length: int):
    """The runs asked for: their bytes, or for hot minimisers a 128-bit hash of each window."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch, "block", "sizes", "blob", "hs", "ats", "counts", "hots"):
                data, offsets = _open(row)
                raw = data.tobytes()
                start, end = _span(row["ats"])
                hot = row["hots"].astype(bool)
                cool = np.flatnonzero(~hot)
                block = lambda n: pa.array(np.full(n, row["block"], np.int64))
                for k in range(0, len(cool), 2000):
                    i = cool[k : k + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array(row["hs"][i]), pa.nulls(len(i), pa.int64()), block(len(i)), pa.array(start[i]), pa.array(row["counts"][i]), pa.array([raw[a:b] for a, b in zip(start[i].tolist(), end[i].tolist())], pa.binary())], _EXTRACT_NAMES)
                if hot.any():
                    prefix, other = prefix_hash(data), prefix_hash(data ^ np.uint8(0x5A))
                    windows = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(start[hot], end[hot])])
                    times = np.repeat(row["counts"][hot], end[hot] - start[hot] - length + 1)
                    one, two = substring_hash(prefix, windows, windows + length), substring_hash(other, windows, windows + length)
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), block(len(windows)), pa.array(windows), pa.array(times), pa.nulls(len(windows), pa.binary())], _EXTRACT_NAMES)

    return run


_EXTRACT = "h long, h2 long, block long, start long, n long, run binary"
_EXTRACT_NAMES = ["h", "h2", "block", "start", "n", "run"]
_MARK = "block long, start long, end long"


def _merged_marks(length: int, stride: int, shard_bytes: int, batch_bytes: int):
    """Covered bytes of the runs of whole minimisers, which come sorted."""

    def marks(runs):
        owner, start = repeated_starts([r[2] for r in runs], length, stride, shard_bytes)
        if not len(owner):
            return None
        new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))
        last = np.append(np.flatnonzero(new)[1:] - 1, len(owner) - 1)
        base = np.array([r[1] for r in runs])[owner[new]]
        block = np.array([r[0] for r in runs])[owner[new]]
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(base + start[new]), pa.array(base + start[last] + length)], ["block", "start", "end"])

    def run(batches):
        runs, held, group, alone = [], 0, None, 0
        for batch in batches:
            for h, block, start, text in zip(batch.column("h").to_pylist(), batch.column("block").to_pylist(), batch.column("start").to_pylist(), batch.column("run").to_pylist()):
                if h != group and held >= batch_bytes:
                    if (found := marks(runs)) is not None:
                        yield found
                    runs, held = [], 0
                group = h
                runs.append((block, start, text))
                held += len(text)
        if runs and (found := marks(runs)) is not None:
            yield found

    return run


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_OUT_TEXT = _OUT + ", kept binary"


def _spans(starts: np.ndarray | None, ends: np.ndarray | None, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the marks cover, each within its text."""
    if starts is None or not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    start, reach = starts[order], np.maximum.accumulate(ends[order])
    doc = np.searchsorted(offsets, start, "right")
    new = np.append(True, (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1]))
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def _remove(with_text: bool):
    def run(batches):
        for batch in batches:
            for row in _rows(batch, "block", "ids", "sizes", "blob", "starts", "ends"):
                data, offsets = _open(row)
                n = len(offsets) - 1
                start, end = _spans(row["starts"], row["ends"], offsets)
                doc = np.searchsorted(offsets, start, "right") - 1
                removed = np.bincount(doc, end - start, minlength=n).astype(np.int64)
                spans = np.bincount(doc, minlength=n)
                raw, sha, kept = data.tobytes(), [], []
                cut = np.searchsorted(doc, np.arange(n + 1)).tolist()
                start, end = start.tolist(), end.tolist()
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    edges = [a, *(x for s in zip(start[cut[i] : cut[i + 1]], end[cut[i] : cut[i + 1]]) for x in s), b]
                    own = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])) if len(edges) > 2 else raw[a:b]
                    sha.append(hashlib.sha256(own).hexdigest())
                    kept.append(own if with_text else None)
                cols = [row["ids"], pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(sha)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, stride: int = STRIDE, hot_runs: int = HOT_RUNS, shard_bytes: int = SHARD_BYTES, batch_bytes: int = BATCH_BYTES, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text``
    the kept bytes.

    A null text is empty; ids may be null or repeat, and rows with equal texts remove each other's bytes,
    none of them excepted. A text shorter than ``length`` keeps all bytes. Texts that are longer than a slice are read
    in slices, one after the other. No rows give none; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(rows.mapInArrow(_blocks, _BLOCK), "repeat-blocks")
    found = materialize(blocks.select("block", "sizes", "blob").mapInArrow(_anchors(length, gram), _ANCHOR), "repeat-anchors")

    # A minimiser is hot only in its rows, never in these sums, which are aggregated in part first.
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    shared = materialize(found.join(again, "h", "left_semi"), "repeat-shared")
    drop_table(found)
    by_run = materialize(shared.groupBy("h", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("block", "at")).alias("rep")), "repeat-runs")
    whole = shared.join(by_run.where("n > 1").select("h", "u"), ["h", "u"], "left_semi")
    whole = whole.select("block", (F.shiftright("at", 24) - F.shiftright("at", 12).bitwiseAND(0xFFF)).alias("start"), (F.shiftright("at", 24) + F.col("at").bitwiseAND(0xFFF)).alias("end"))
    several = by_run.groupBy("h").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1")
    asked = by_run.join(several, "h").select("h", "n", "rep.block", "rep.at", (F.col("runs") > hot_runs).alias("hot"))
    # A block holds a bounded number of runs, so what is gathered by block is bounded.
    by_block = asked.groupBy("block").agg(F.collect_list(F.struct("h", "at", "n", "hot")).alias("r")).select("block", *(F.col(f"r.{a}").cast(t).alias(b) for a, b, t in (("h", "hs", "array<long>"), ("at", "ats", "array<long>"), ("n", "counts", "array<long>"), ("hot", "hots", "array<int>"))))
    extracted = blocks.select("block", "sizes", "blob").join(by_block, "block").mapInArrow(_extract(length), _EXTRACT)
    hot = several.where(F.col("runs") > hot_runs).limit(1).count() > 0
    if hot:
        extracted = materialize(extracted, "repeat-extracted")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cool = extracted.where("run is not null").select("h", "block", "start", "run").repartition(parts, "h").sortWithinPartitions("h")
    marks = whole.unionByName(cool.mapInArrow(_merged_marks(length, stride, shard_bytes, batch_bytes), _MARK))
    if hot:
        windows = extracted.where("run is null").select("h", "h2", "block", "start", "n")
        twice = windows.groupBy("h", "h2").agg(F.sum("n").alias("all")).where("all > 1").select("h", "h2")
        marks = marks.unionByName(windows.join(twice, ["h", "h2"], "left_semi").select("block", "start", (F.col("start") + length).alias("end")))
    marked = materialize(marks.groupBy("block").agg(F.collect_list(F.struct("start", "end")).alias("m")).select("block", F.col("m.start").alias("starts"), F.col("m.end").alias("ends")), "repeat-marks")
    drop_table(shared)
    drop_table(by_run)
    return blocks.join(marked, "block", "left").mapInArrow(_remove(with_text), _OUT_TEXT if with_text else _OUT)
