"""Language identification as inference of a mixture.

A text's words are drawn from languages in unknown proportions; a word's likelihood in a language is that
of its character n-grams. Expectation-maximisation estimates the proportions, and the set of languages is
the one whose penalised likelihood is best. N-gram counts come from all labelled training texts; they are
added up in tables of fixed size, one a language.

Every language is learnt. Tables are kept in blocks of languages; more than one block lies in the shared
folder, and a task reads one at a time, so that memory doesn't grow with the languages. A text's set can't
hold more than 1 / LEAST_SHARE languages, so where there are more than CANDIDATES, a text's candidates are
those with the largest shares after one step from equal proportions, in which all languages take part. Texts
longer than a slice are read in pieces, again in each step.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import binary_texts, materialize, named, read_array, scratch_dir, text_slices, write_array

#: Cells of a language's table of hashed n-grams.
CELLS = 1 << 15
#: Languages of a block, and of a text's candidates: more than 1 / LEAST_SHARE.
CANDIDATES = 64
SMOOTHING = 0.5
EM_STEPS = 8
#: What a language costs in log-likelihood: PENALTY * log(words + 1) + ENTRY.
PENALTY = 1.0
ENTRY = 8.0
#: A language enters the set only with this share of the text.
LEAST_SHARE = 0.02
UNDETERMINED = "und"
_SLICE = 1 << 20


@dataclass
class Items:
    ids: list
    langs: list
    #: By n-gram: cell and word; by word: text; by text: whether it has a letter.
    cell: np.ndarray
    word: np.ndarray
    doc: np.ndarray
    letters: np.ndarray


_TABLE = None


def _ascii_table() -> np.ndarray:
    """Letters in lower case, all other ASCII as a space; bytes of longer characters as they are."""
    global _TABLE
    if _TABLE is None:
        table = np.arange(256, dtype=np.uint8)
        for b in range(128):
            c = chr(b)
            table[b] = ord(c.lower()) if c.isalpha() else 32
        _TABLE = table
    return _TABLE


def _clean(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with one space for everything else, as UTF-8, and the texts' offsets."""
    if not (data >= 128).any():
        return _ascii_table()[data], offsets
    raw = data.tobytes()
    parts = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = raw[a:b].decode("utf-8", "replace").lower()
        if not text.isascii():
            others = {ord(c): " " for c in set(text) if ord(c) > 127 and not c.isalpha()}
            if others:
                text = text.translate(others)
        parts.append(text.encode("utf-8", "replace"))
    out = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([0, *map(len, parts)])
    return _ascii_table()[out], ends


def _items(data: np.ndarray, offsets: np.ndarray, ids: list, langs: list) -> Items:
    data, offsets = _clean(data, offsets)
    n = len(offsets) - 1
    # A space in front of each text, so that every word has one at both sides.
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    shift = np.repeat(np.arange(n), np.diff(offsets)) + 1
    padded[np.arange(len(data)) + shift] = data
    begins = offsets[:-1] + np.arange(n)
    inside = padded != 32
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    doc = np.searchsorted(begins, start, "right") - 1
    # Three bytes a gram, of which the middle one lies in a word.
    at = np.flatnonzero(inside)
    at = at[(at > 0) & (at < len(padded) - 1)]
    gram = padded[at - 1].astype(np.uint32) << np.uint32(16) | padded[at].astype(np.uint32) << np.uint32(8) | padded[at + 1]
    cell = (gram * np.uint32(2654435761)) >> np.uint32(17)
    word = np.searchsorted(start, at, "right") - 1
    letters = np.bincount(doc, minlength=n) > 0
    return Items(ids, langs, cell.astype(np.int64), word, doc, letters)


def _pieces(data: np.ndarray, limit: int) -> list[np.ndarray]:
    """A text in pieces of ``limit`` bytes at most, cut at white space; a word longer than that between characters."""
    out, at = [], 0
    while len(data) - at > limit:
        part = data[at : at + limit]
        spaces = np.flatnonzero(part[limit // 2 :] <= 32)
        end = at + limit // 2 + int(spaces[-1]) + 1 if len(spaces) else at + limit
        while not len(spaces) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return [*out, data[at:]]


def _slices(batches, limit: int, langs: bool = False) -> Iterator[tuple[list, list, list[tuple[np.ndarray, np.ndarray]]]]:
    """(ids, langs, [(bytes, offsets)]): many texts in one piece, or one long text in several."""
    for rows, data, offsets in text_slices(batches, limit=limit):
        ids, own = rows.column(0).to_pylist(), rows.column(2).to_pylist() if langs else []
        if len(offsets) == 2 and len(data) > limit:
            yield ids, own, [(p, np.array([0, len(p)])) for p in _pieces(data, limit)]
        else:
            yield ids, own, [(data, offsets)]


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 != 2


def _count_grams(names: list[str], most: int = 1 << 23):
    """Counts by (language, cell), in one table where that has ``most`` places at most, else as they come."""
    index = {x: i for i, x in enumerate(names)}
    places = len(names) * CELLS

    def rows(key, n):
        return pa.RecordBatch.from_pydict({"cell": pa.array(key.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    def run(batches):
        total = np.zeros(places if places <= most else 0, np.int64)
        for ids, langs, pieces in _slices(batches, _SLICE, langs=True):
            for data, offsets in pieces:
                t = _items(data, offsets, ids, langs)
                lang = np.array([index.get(x, -1) if in_training(i) else -1 for i, x in zip(t.ids, t.langs)], np.int64)
                own = lang[t.doc][t.word] if len(t.doc) else np.zeros(0, np.int64)
                keep = own >= 0
                key = own[keep] * CELLS + t.cell[keep]
                if len(total):
                    total += np.bincount(key, minlength=len(total))
                else:
                    yield rows(*np.unique(key, return_counts=True))
        at = np.flatnonzero(total)
        yield rows(at, total[at])

    return run


@dataclass
class Model:
    names: list[str]
    #: Log-likelihoods by cell and language of a block, or the places where the blocks are written.
    blocks: list = field(default_factory=list)

    def block(self, i: int) -> np.ndarray:
        own = self.blocks[i]
        return own if isinstance(own, np.ndarray) else read_array(own)


def fit(docs: DataFrame, block: int = CANDIDATES) -> Model:
    """Learns from the rows of (doc_id, text, lang) with a lang whose crc32(doc_id) mod 4 isn't 2. The driver
    holds the names and one block's sums, which is ``block * CELLS`` numbers, at a time."""
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2
    rows = docs.where(train & F.col("lang").isNotNull())
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not names:
        return Model([])
    sums = rows.select("doc_id", "text", "lang").mapInArrow(_count_grams(names), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    blocks = range(0, len(names), block)
    if len(blocks) > 1:
        sums, folder = materialize(sums, "language-sums"), scratch_dir(docs.sparkSession, "languages")
    model = Model(names)
    for a in blocks:
        own = len(names[a : a + block])
        found = (sums.where(F.col("cell").between(a * CELLS, (a + own) * CELLS - 1)) if len(blocks) > 1 else sums).toArrow()
        counts = np.zeros(own * CELLS)
        counts[found.column("cell").to_numpy() - a * CELLS] = found.column("n").to_numpy()
        counts = counts.reshape(own, CELLS)
        table = np.ascontiguousarray(np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * CELLS)).T, np.float32)
        model.blocks.append(table if len(blocks) == 1 else write_array(f"{folder}/{a // block:06d}.npy", table))
    return model


# inference; chunks are (likelihoods by word and candidate, scaled to a maximum of 1; text of each word)
Chunks = Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]


def _by_text(doc: np.ndarray, values: np.ndarray, into: np.ndarray) -> None:
    """Adds the rows of ``values`` up by text; a text's words are side by side."""
    if len(doc):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        into[doc[first]] += np.add.reduceat(values, first, axis=0)


def _em(chunks: Chunks, size: np.ndarray, allowed: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood by text."""
    share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    for _ in range(steps):
        total = np.zeros_like(share)
        for like, doc in chunks():
            r = like * share[doc]
            r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
            _by_text(doc, r, total)
        share = total / size[:, None]
    seen = np.zeros(len(size))
    for like, doc in chunks():
        _by_text(doc, np.log(np.maximum((like * share[doc]).sum(1), 1e-30)), seen)
    return share, seen


def proportions(chunks: Chunks, single: np.ndarray, size: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text the proportions of its languages and the log-likelihood. ``single`` has those of each
    candidate alone, ``size`` the words (1 at least), ``equal`` the candidates of each text as 0 and 1."""
    n, width = single.shape
    every = np.arange(n)
    alone = np.where(equal > 0, single, -np.inf)
    best = alone.argmax(1)
    share = np.zeros((n, width))
    share[every, best] = 1
    seen = single[every, best].copy()
    cost = PENALTY * np.log(size + 1) + ENTRY
    value = seen - cost
    full, _ = _em(chunks, size, equal)
    rank = np.argsort(-full, axis=1, kind="stable")
    open_ = every
    for m in range(2, width + 1):
        # Sets grow by the language of the next largest share, as long as the penalised likelihood does.
        open_ = open_[full[open_, rank[open_, m - 1]] >= LEAST_SHARE]
        if not len(open_):
            break
        allowed = np.zeros((len(open_), width))
        np.put_along_axis(allowed, rank[open_, :m], 1, 1)
        own = chunks
        if len(open_) < n:
            index = np.full(n, -1)
            index[open_] = np.arange(len(open_))
            held = [(like[index[doc] >= 0], index[doc[index[doc] >= 0]]) for like, doc in chunks()]
            own = lambda: iter(held)  # noqa: B023, E731
        found, now = _em(own, size[open_], allowed)
        better = now - m * cost[open_] > value[open_]
        open_, found, now = open_[better], found[better], now[better]
        share[open_], seen[open_], value[open_] = found, now, now - m * cost[open_]
    return share, seen


@dataclass
class Found:
    """By text: candidates (places in the model's names), their shares, words, and how much likelier an n-gram
    is in the mixture than if all cells were equally likely, in nats."""

    candidates: np.ndarray
    share: np.ndarray
    words: np.ndarray
    gain: np.ndarray


def _word_sums(model: Model, i: int, t: Items) -> np.ndarray:
    """Log-likelihood of each word in each language of a block."""
    edges = np.flatnonzero(np.append(True, t.word[1:] != t.word[:-1]))
    return np.add.reduceat(model.block(i)[t.cell], edges, axis=0)


def _candidates(model: Model, items: Callable[[], Iterator[Items]], n: int) -> np.ndarray:
    """The languages of each text with the largest shares after one step from equal proportions over all of
    them, and the likeliest one alone."""
    share, single = np.zeros((n, len(model.names))), np.zeros((n, len(model.names)))
    for t in items():
        if not len(t.doc):
            continue
        total = np.full(len(t.doc), -np.inf)
        for i in range(len(model.blocks)):
            own = _word_sums(model, i, t).astype(np.float64)
            _by_text(t.doc, own, single[:, i * CANDIDATES : i * CANDIDATES + own.shape[1]])
            total = np.logaddexp(total, np.logaddexp.reduce(own, axis=1))
        for i in range(len(model.blocks)):
            own = np.exp(_word_sums(model, i, t) - total[:, None])
            _by_text(t.doc, own, share[:, i * CANDIDATES : i * CANDIDATES + own.shape[1]])
    share[np.arange(n), single.argmax(1)] += np.inf
    return np.sort(np.argsort(-share, axis=1, kind="stable")[:, :CANDIDATES], axis=1)


def infer(model: Model, pieces: list[tuple[np.ndarray, np.ndarray]]) -> Found:
    """The mixtures of the texts of a slice."""
    n = len(pieces[0][1]) - 1

    def items():
        for data, offsets in pieces:
            yield _items(data, offsets, [], [])

    if len(pieces) == 1:
        held_items = [*items()]
        items = lambda: iter(held_items)
    several = len(model.blocks) > 1
    candidates = _candidates(model, items, n) if several else np.tile(np.arange(len(model.names)), (n, 1))
    width = candidates.shape[1]

    def scaled():
        for t in items():
            if not len(t.doc):
                continue
            own = np.zeros((len(t.doc), width), np.float32) if several else _word_sums(model, 0, t)
            for i in range(len(model.blocks) if several else 0):
                block = _word_sums(model, i, t)
                place = candidates[t.doc] - i * CANDIDATES
                inside = (place >= 0) & (place < block.shape[1])
                own[inside] = block[np.nonzero(inside)[0], place[inside]]
            top = own.max(1, keepdims=True)
            yield own - top, top[:, 0], t

    words, grams, tops, single = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, width))
    held = []
    for own, top, t in scaled():
        words += np.bincount(t.doc, minlength=n)
        grams += np.bincount(t.doc[t.word], minlength=n)
        tops += np.bincount(t.doc, top, minlength=n)
        _by_text(t.doc, own.astype(np.float64), single)
        if len(pieces) == 1:
            held.append((np.exp(own).astype(np.float64), t.doc))
    chunks = (lambda: iter(held)) if len(pieces) == 1 else lambda: ((np.exp(own).astype(np.float64), t.doc) for own, _, t in scaled())
    share, seen = proportions(chunks, single, np.maximum(words, 1), np.ones((n, width)))
    share[words == 0] = 0
    return Found(candidates, share, words, (tops + seen) / np.maximum(grams, 1) + np.log(CELLS))


_PRED = "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>"


def _limit(model: Model) -> int:
    """Bytes of a slice, so that words times candidates take bounded memory."""
    return _SLICE if len(model.names) <= 8 else max(1 << 16, 8 * _SLICE // min(len(model.names), CANDIDATES))


def _predict(model: Model):
    struct = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        for ids, _, pieces in _slices(batches, _limit(model)):
            n = len(ids)
            if not model.names:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([UNDETERMINED] * n), pa.array(np.zeros(n)), pa.array([[]] * n, struct)], ["doc_id", "lang_pred", "score", "languages"])
                continue
            found = infer(model, pieces)
            best = found.share.argmax(1)
            known = (found.words > 0) & (found.share.max(1) > 0)
            names = [model.names[c[b]] if k else UNDETERMINED for c, b, k in zip(found.candidates, best, known)]
            value = np.where(known, np.minimum(found.share[np.arange(n), best], 1.0), 0.0)
            mixed = [[{"lang": model.names[c[j]], "share": float(s[j])} for j in np.flatnonzero(s > 0)] if k else [] for c, s, k in zip(found.candidates, found.share, known)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names), pa.array(value), pa.array(mixed, struct)], ["doc_id", "lang_pred", "score", "languages"])

    return run


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.select(named("doc_id").cast("long").alias("doc_id"), named("text").cast("string").alias("text"), named("lang").cast("string").alias("lang"))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the share of lang_pred), languages.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learnt. Ties go to the first
    name. Whole texts are read, whatever their length; repeated rows get a row each, no rows give none, and
    other columns aren't read.
    """
    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")).mapInArrow(_predict(model), _PRED)


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the training rows of ``docs`` and predicts every row."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return predict(docs, fit(_labelled(docs))).select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame, least_gain: float = 0.0) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and others) that the learnt languages explain.

    A text stays if its n-grams are likelier in its mixture of languages, however many these are, than if all
    n-grams were equally likely, by ``least_gain`` nats an n-gram. Null texts and those without a letter go.
    If no row is labelled, every text with a letter stays. Repeated rows are judged alike and keep their
    number; columns of any name stay; no rows give none. Texts are judged in place, without a join.
    """
    text = docs.columns.index("text")
    model = fit(_labelled(docs))

    def keep(ids, pieces) -> list[bool]:
        if model.names:
            found = infer(model, pieces)
            return ((found.words > 0) & (found.gain > least_gain)).tolist()
        return np.any([_items(*p, ids, []).letters for p in pieces], axis=0).tolist()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), binary_texts(pa.RecordBatch.from_arrays([batch.column(text)], ["text"]))], ["doc_id", "text"])
                kept = [x for ids, _, pieces in _slices([own], _limit(model)) for x in keep(ids, pieces)]
                yield batch.filter(pa.array(kept, pa.bool_()))

    # By place, as names may hold dots.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
