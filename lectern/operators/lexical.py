"""Ranked word search: inverted index, query language, BM25 scores, fusion of two indexes, regex search.

An index is a DataFrame of postings, one row per (term, document): where the term stands in the title and
in the text. A query is parsed on the driver into phrases and a condition over them; only postings of its
terms are read, and texts never travel with the scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import search_tokens, search_tokens_col

K1, B = 1.2, 0.75
TITLE_WEIGHT, TEXT_WEIGHT = 2.0, 1.0
FLOOR_IDF = 1e-6


class QueryError(ValueError):
    """A malformed query; raised before anything is read."""


# the query language


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens; ``prefix`` lets the last one be the start of a word."""

    tokens: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass
class Query:
    phrases: list[Phrase] = field(default_factory=list)
    #: ("phrase", i), ("near", [i, ...], k), ("and" | "or" | "not", left, right), ("all",)
    tree: tuple = ("all",)


_TOKEN = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<mark>[()*:,+^])|(?P<word>[^\s"()*:,+^]+))')


class _Parser:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            match = _TOKEN.match(text, at)
            if not match:
                raise QueryError(f"can't read the query at {at}")
            at = match.end()
            kind = match.lastgroup
            value = match[kind]
            if kind == "quoted":
                value = value[1:-1].replace('""', '"')
            elif kind == "word" and not all(c.isalnum() or c == "_" or ord(c) > 127 for c in value):
                raise QueryError(f"{value!r} must be quoted")
            self.items.append((kind, value))
        self.at = 0
        self.out = Query()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        found = self.peek()
        if (kind and found[0] != kind) or (value and found[1] != value):
            raise QueryError(f"{value or kind} expected, not {found[1] or 'the end'!r}")
        self.at += 1
        return found[1]

    def is_word(self, *words: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1] in words

    def parse(self) -> Query:
        if not self.items:
            raise QueryError("the query is empty")
        self.out.tree = self.either()
        if self.peek()[0] != "end":
            raise QueryError(f"nothing may follow at {self.peek()[1]!r}")
        if not any(p.tokens for p in self.out.phrases):
            self.out.tree = ("none",)
        return self.out

    def either(self) -> tuple:
        left = self.both()
        while self.is_word("OR"):
            self.take()
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.without()
        while self.is_word("AND"):
            self.take()
            left = ("and", left, self.without())
        return left

    def without(self) -> tuple:
        left = self.series()
        while self.is_word("NOT"):
            self.take()
            left = ("not", left, self.series())
        return left

    def series(self) -> tuple:
        """Terms side by side are all wanted, and bind closest."""
        left = self.term(None)
        while self.peek()[0] != "end" and not self.is_word("OR", "AND", "NOT") and self.peek()[1] not in (")", ","):
            left = ("and", left, self.term(None))
        return left

    def term(self, column: str | None) -> tuple:
        kind, value = self.peek()
        if kind == "mark" and value == "(":
            self.take()
            if column:
                raise QueryError("a column filter takes one phrase here")
            inner = self.either()
            self.take("mark", ")")
            return inner
        if kind == "word" and value == "NEAR" and self.peek(1) == ("mark", "("):
            return self.near(column)
        if kind == "word" and self.peek(1) == ("mark", ":") and column is None:
            if value not in ("title", "text"):
                raise QueryError(f"there is no column {value!r}")
            self.take()
            self.take()
            return self.term(value)
        if kind == "word" and value in ("AND", "OR", "NOT"):
            raise QueryError(f"{value} needs a term in front of it")
        return ("phrase", self.phrase(column))

    def phrase(self, column: str | None) -> int:
        kind, value = self.peek()
        if kind not in ("word", "quoted"):
            raise QueryError(f"a word is expected, not {value or 'the end'!r}")
        self.take()
        tokens, prefix = search_tokens(value), False
        while self.peek() == ("mark", "+"):
            self.take()
            if self.peek()[0] not in ("word", "quoted"):
                raise QueryError("a word must follow +")
            tokens += search_tokens(self.take())
        if self.peek() == ("mark", "*"):
            self.take()
            prefix = True
        self.out.phrases.append(Phrase(tuple(tokens), prefix, column))
        return len(self.out.phrases) - 1

    def near(self, column: str | None) -> tuple:
        self.take()
        self.take("mark", "(")
        members = []
        while self.peek()[0] in ("word", "quoted"):
            members.append(self.phrase(column))
        distance = 10
        if self.peek() == ("mark", ","):
            self.take()
            number = self.take("word")
            if not number.isdigit():
                raise QueryError("NEAR takes a number of tokens")
            distance = int(number)
        self.take("mark", ")")
        if not members:
            raise QueryError("NEAR needs phrases")
        return ("near", members, distance)


def parse(text: str) -> Query:
    return _Parser(text).parse()


# the index


#: Columns of an index's postings, and what a folder must hold to be one.
POSTINGS = ("term", "doc_id", "size", "title_at", "text_at", "segment")


@dataclass
class Index:
    """``postings``: term, doc_id, size, title_at, text_at. ``rows`` and ``tokens`` count all documents
    that were indexed, whatever became of them since."""

    postings: DataFrame
    rows: int
    tokens: int


def tokenized(docs: DataFrame, id_col: str = "doc_id", title_col: str | None = "title", text_col: str = "text", tokens=search_tokens_col) -> DataFrame:
    title = tokens(F.coalesce(F.col(title_col), F.lit(""))) if title_col else F.array().cast("array<string>")
    return docs.select(F.col(id_col).alias("doc_id"), title.alias("title_tokens"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("text_tokens"))


#: Tokens that are inverted at once, a document more at most; this bounds what a task holds.
RUN_TOKENS = 1 << 20


def postings(tokens: DataFrame) -> DataFrame:
    """One row per (term, document) with the term's places, from 1, in title and text. A document's postings are made
    where it is read, so nothing is shuffled; within a run of documents they are sorted by term."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "title_tokens", "text_tokens").mapInArrow(_inverted, f"term string, doc_id {kind}, size int, title_at array<int>, text_at array<int>")


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, count = [], 0
    for batch in batches:
        sizes = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
        upto, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            before = upto[begin - 1] if begin else 0
            stop = min(len(sizes), int(np.searchsorted(upto, before + RUN_TOKENS - count)) + 1)
            held.append(batch.slice(begin, stop - begin))
            count += int(upto[stop - 1] - before)
            begin = stop
            if count >= RUN_TOKENS:
                yield from _run(held)
                held, count = [], 0
    if held:
        yield from _run(held)


def _run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of some whole documents, by term, then in the documents' order."""
    rows = pa.Table.from_batches(held)
    docs, places, words = [], [], []
    for column in ("title_tokens", "text_tokens"):
        lists = rows[column].combine_chunks()
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(n), dtype=np.int64), n)
        docs.append(doc)
        places.append(np.arange(len(doc), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n) + 1)
        words.append(lists.flatten())
    size = np.bincount(docs[0], minlength=len(rows)) + np.bincount(docs[1], minlength=len(rows))
    in_title = len(docs[0])
    coded = pa.concat_arrays(words).dictionary_encode()
    names = coded.dictionary
    rank = np.empty(len(names), np.int64)
    rank[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
    key = rank[coded.indices.to_numpy()] * len(rows) + np.concatenate(docs)
    # Stable, so that a key's places stay in order, those in the title in front.
    order = np.argsort(key, kind="stable")
    key, at = key[order], np.concatenate(places)[order].astype(np.int32)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    title = order < in_title
    doc = key[first] % max(1, len(rows))
    lists = []
    for own in (title, ~title):
        ends = np.concatenate(([0], np.cumsum(own)))
        lists.append(pa.ListArray.from_arrays(pa.array(np.append(ends[first], ends[-1]), pa.int32()), pa.array(at[own])))
    terms = names.take(pa.array(np.argsort(rank)[key[first] // max(1, len(rows))]))
    ids = rows["doc_id"].combine_chunks().take(pa.array(doc))
    out = pa.RecordBatch.from_arrays([terms, ids, pa.array(size[doc].astype(np.int32)), *lists], names=["term", "doc_id", "size", "title_at", "text_at"])
    for a in range(0, len(out), 100_000):
        yield out.slice(a, 100_000)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", title_col: str | None = "title", text_col: str = "text", buckets: int = 64, tokens=search_tokens_col) -> Index:
    """Writes postings in runs sorted by term, of which a query reads the pages that hold its terms, and reads them
    back. There are ``buckets`` files at most, or one a core."""
    spark = docs.sparkSession
    docs.limit(0).select(F.col(id_col).alias("doc_id"), F.lit(0).alias("segment")).write.mode("overwrite").parquet(f"{path}/dropped")
    _write_segment(docs, path, 0, id_col, title_col, text_col, tokens, buckets, "overwrite")
    return open_index(spark, path)


def _write_segment(docs: DataFrame, path: str, segment: int, id_col: str, title_col: str | None, text_col: str, tokens, buckets: int, mode: str) -> None:
    split = tokenized(docs, id_col, title_col, text_col, tokens)
    # Documents first: postings whose documents aren't listed belong to a run that was cut off, and don't count.
    files = max(buckets, docs.sparkSession.sparkContext.defaultParallelism)
    rows = postings(split).select("term", "doc_id", "size", "title_at", "text_at", F.lit(segment).alias("segment"))
    rows.coalesce(files).write.mode(mode).parquet(f"{path}/postings")
    split.select("doc_id", (F.size("title_tokens") + F.size("text_tokens")).alias("size"), F.lit(segment).alias("segment")).write.mode(mode).parquet(f"{path}/documents")


def open_index(spark, path: str) -> Index:
    """The index at ``path`` with its segments; an error if its tables aren't those of an index."""
    rows, documents, dropped = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "documents", "dropped"))
    if tuple(rows.columns) != POSTINGS or tuple(documents.columns) != ("doc_id", "size", "segment"):
        raise ValueError(f"{path} doesn't hold an index of this library")
    last = dropped.groupBy("doc_id").agg(F.max("segment").alias("dead"))
    if not dropped.isEmpty():
        alive = lambda df: df.join(last, "doc_id", "left").where("dead is null or segment > dead").drop("dead")
        rows, documents = alive(rows), alive(documents)
    known = documents.select("segment").distinct()
    stats = documents.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).first()
    return Index(rows.join(F.broadcast(known), "segment", "left_semi").drop("segment"), stats["rows"], stats["tokens"])


def _next_segment(spark, path: str) -> int:
    found = spark.read.parquet(f"{path}/postings").agg(F.max("segment")).first()[0]
    dropped = spark.read.parquet(f"{path}/dropped").agg(F.max("segment")).first()[0]
    return 1 + max(-1 if found is None else found, -1 if dropped is None else dropped)


def append_index(docs: DataFrame, path: str, id_col: str = "doc_id", title_col: str | None = "title", text_col: str = "text", tokens=search_tokens_col, buckets: int = 8) -> int:
    """Adds the documents that the index lacks as a segment of its own; how many these are. The same call again
    adds none, and one that was cut off leaves postings that no document of theirs brings to life."""
    spark = docs.sparkSession
    have = spark.read.parquet(f"{path}/documents").join(spark.read.parquet(f"{path}/dropped").groupBy("doc_id").agg(F.max("segment").alias("dead")), "doc_id", "left").where("dead is null or segment > dead")
    new = docs.join(have.select(F.col("doc_id").alias(id_col)), id_col, "left_anti")
    count = new.count()
    if count:
        _write_segment(new, path, _next_segment(spark, path), id_col, title_col, text_col, tokens, buckets, "append")
    return count


def repair_index(docs: DataFrame, path: str, id_col: str = "doc_id", title_col: str | None = "title", text_col: str = "text", tokens=search_tokens_col, buckets: int = 8) -> None:
    """Puts the documents' present texts in the place of what the index holds of them."""
    spark = docs.sparkSession
    segment = _next_segment(spark, path)
    docs.select(F.col(id_col).alias("doc_id"), F.lit(segment).alias("segment")).distinct().write.mode("append").parquet(f"{path}/dropped")
    append_index(docs, path, id_col, title_col, text_col, tokens, buckets)


def drop_from_index(spark, path: str, ids: DataFrame) -> None:
    """Takes documents (doc_id) out of the index."""
    ids.select("doc_id", F.lit(_next_segment(spark, path)).alias("segment")).distinct().write.mode("append").parquet(f"{path}/dropped")


@dataclass
class Scan:
    """Documents that are searched without an index: ``tokens`` as ``tokenized`` gives them."""

    tokens: DataFrame


def scan(docs: DataFrame, id_col: str = "doc_id", title_col: str | None = None, text_col: str = "text", tokens=search_tokens_col) -> Scan:
    return Scan(tokenized(docs, id_col, title_col, text_col, tokens))


# matching


def _wanted(query: Query, term: Column) -> Column:
    """Whether any phrase needs the term."""
    exact = sorted({t for p in query.phrases for t in (p.tokens[:-1] if p.prefix else p.tokens)})
    starts = sorted({p.tokens[-1] for p in query.phrases if p.prefix and p.tokens})
    conditions = [term.isin(exact)] if exact else []
    conditions += [term.startswith(s) for s in starts]
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _positions(token: str, column: str, prefix: bool) -> Column:
    """Where a token stands in a document's column, from the gathered array ``p``."""
    keep = (lambda s: s["term"].startswith(token)) if prefix else (lambda s: s["term"] == token)
    return F.flatten(F.transform(F.filter("p", keep), lambda s: s[f"{column}_at"]))


def _hits(phrase: Phrase, column: str) -> Column:
    """Where the phrase begins in the column."""
    if not phrase.tokens or (phrase.column and phrase.column != column):
        return F.array().cast("array<int>")
    last = len(phrase.tokens) - 1
    first, *rest = [_positions(t, column, phrase.prefix and i == last) for i, t in enumerate(phrase.tokens)]
    for i, following in enumerate(rest, 1):
        first = _followed(first, following, i)
    return first


def _followed(first: Column, following: Column, by: int) -> Column:
    return F.array_intersect(first, F.transform(following, lambda at: at - by))


def _near_hits(query: Query, members: list[int], distance: int, column: str) -> list[Column]:
    """By phrase its places in the column that take part in a match: with the last phrase beginning at some
    place, at most ``distance`` tokens lie between it and the end of each other one."""
    starts = [_hits(query.phrases[i], column) for i in members]
    if len(members) == 1:
        return starts
    reach = [len(query.phrases[i].tokens) + distance for i in members]
    last = F.filter(F.array_distinct(F.flatten(F.array(*starts))), lambda m: _all_within(starts, reach, m))
    return [_within(s, r, last) for s, r in zip(starts, reach)]


def _all_within(starts: list[Column], reach: list[int], last: Column) -> Column:
    ok = F.lit(True)
    for s, r in zip(starts, reach):
        ok = ok & _any_within(s, r, last)
    return ok


def _any_within(places: Column, reach: int, last: Column) -> Column:
    return F.exists(places, lambda at: (at <= last) & (at >= last - reach))


def _within(places: Column, reach: int, lasts: Column) -> Column:
    return F.filter(places, lambda at: F.exists(lasts, lambda m: (at <= m) & (at >= m - reach)))


def _near_groups(tree: tuple) -> list[tuple]:
    if tree[0] == "near":
        return [tree]
    return [g for part in tree[1:] if isinstance(part, tuple) for g in _near_groups(part)]


def _condition(query: Query, tree: tuple) -> Column:
    kind = tree[0]
    if kind == "phrase":
        return F.col(f"n{tree[1]}") > 0
    if kind == "near":
        return F.col(f"h{tree[1][0]}") > 0
    if kind in ("all", "none"):
        return F.lit(kind == "all")
    left, right = _condition(query, tree[1]), _condition(query, tree[2])
    return left & right if kind == "and" else left | right if kind == "or" else left & ~right


def _score(query: Query, tree: tuple, phrase_score) -> Column:
    """What matching parts add; those behind NOT, and parts of an AND that fails, add nothing."""
    kind = tree[0]
    if kind == "phrase":
        return phrase_score(tree[1])
    if kind in ("all", "none"):
        return F.lit(0.0)
    if kind == "near":
        total = F.lit(0.0)
        for i in tree[1]:
            total = total + phrase_score(i)
    else:
        total = _score(query, tree[1], phrase_score)
        if kind != "not":
            total = total + _score(query, tree[2], phrase_score)
    return total if kind == "or" else F.when(_condition(query, tree), total).otherwise(0.0)


def _gathered(index: Index | Scan, query: Query) -> DataFrame:
    """doc_id, size and the places ``p`` of the query's terms. From an index only documents that have any,
    after one small shuffle of these terms' postings; from a scan all documents, without one."""
    if isinstance(index, Index):
        return index.postings.where(_wanted(query, F.col("term"))).groupBy("doc_id").agg(F.first("size").alias("size"), F.collect_list(F.struct("term", "title_at", "text_at")).alias("p"))
    none = F.array().cast("array<int>")

    def places(column: str) -> Column:
        own = lambda at: (at, none) if column == "title_tokens" else (none, at)
        spots = F.transform(F.col(column), lambda t, i: F.when(_wanted(query, t), F.struct(t.alias("term"), *(x.alias(n) for x, n in zip(own(F.array(i + 1)), ("title_at", "text_at"))))))
        return F.array_compact(spots)

    return index.tokens.select("doc_id", (F.size("title_tokens") + F.size("text_tokens")).alias("size"), F.concat(places("title_tokens"), places("text_tokens")).alias("p"), F.spark_partition_id().alias("fence"))


def matches(index: Index | Scan, query: Query) -> DataFrame:
    """doc_id, size and by phrase its hits in title (t0, ...) and text (x0, ...) and both (n0, ...)."""
    gathered = _gathered(index, query)
    counts = []
    for i, phrase in enumerate(query.phrases):
        t, x = F.size(_hits(phrase, "title")), F.size(_hits(phrase, "text"))
        counts += [t.alias(f"t{i}"), x.alias(f"x{i}"), (t + x).alias(f"n{i}")]
    for group in _near_groups(query.tree):  # these count the hits that take part, but not for the idf
        for i, t, x in zip(group[1], _near_hits(query, *group[1:], "title"), _near_hits(query, *group[1:], "text")):
            counts[3 * i] = F.size(t).alias(f"t{i}")
            counts[3 * i + 1] = F.size(x).alias(f"x{i}")
            counts.append((F.size(t) + F.size(x)).alias(f"h{i}"))
    return gathered.select("*", *counts)


def idf(rows: int, holding: int) -> float:
    value = math.log((rows - holding + 0.5) / (holding + 0.5)) if rows >= holding else 0.0
    return value if value > 0 else FLOOR_IDF


def bm25(index: Index | Scan, text: str) -> DataFrame:
    """(doc_id, score) of the matching documents; the statistics are those of all documents."""
    query = parse(text)
    found = matches(index, query)
    holding = [F.coalesce(F.sum((F.col(f"n{i}") > 0).cast("long")), F.lit(0)) for i in range(len(query.phrases))]
    rows, tokens, *holding = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), *holding).first()
    if isinstance(index, Index):
        rows, tokens = index.rows, index.tokens
    average = tokens / rows if rows else 1.0

    def phrase_score(i: int) -> Column:
        f = F.lit(TITLE_WEIGHT) * F.col(f"t{i}") + F.lit(TEXT_WEIGHT) * F.col(f"x{i}")
        return F.lit(idf(rows, holding[i])) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.lit(average)))

    score = _score(query, query.tree, phrase_score)
    # Of a scan the condition would be pushed below what it is made of, and all that be done twice.
    matched = _condition(query, query.tree) if isinstance(index, Index) else _condition(query, query.tree) & (F.col("fence") >= 0)
    return found.where(matched).select("doc_id", score.alias("score"))


def top(scores: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """The page by descending score, ties by id."""
    return scores.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)


def fuse(surface: DataFrame, lemma: DataFrame, limit: int, offset: int = 0, lemma_weight: float = 1.0) -> DataFrame:
    """Both indexes' best max(50, 5 * (offset + limit)) candidates, their scores added; cutting each list
    first is part of the definition."""
    most = max(50, 5 * (offset + limit))
    a = top(surface, most).select("doc_id", F.col("score").alias("surface"))
    b = top(lemma, most).select("doc_id", F.col("score").alias("lemma"))
    both = a.join(b, "doc_id", "full_outer")
    total = F.coalesce("surface", F.lit(0.0)) + F.lit(float(lemma_weight)) * F.coalesce("lemma", F.lit(0.0))
    return top(both.select("doc_id", total.alias("score")), limit, offset)


#: Letters, digits, blanks, marks without a meaning, plain classes, groups, alternatives and counted repeats: what
#: Python's and Java's dialects read alike. Possessive and lazy repeats and all escapes are left to Python.
_ALIKE = re.compile(r"(?:[A-Za-z0-9 ,;:_=!@#%~'\"<>/-]|\[\^?[A-Za-z0-9 _]+(?:-[A-Za-z0-9 _]+)*\]|\((?!\?)|\)|\||(?:[+*?]|\{\d+(?:,\d*)?\})(?![+*?{]))*")


def regex_search(docs: DataFrame, pattern: str, limit: int, ignore_case: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first ``limit`` documents by id that match, with where the match begins and score 1. Python's
    dialect decides, in Python workers where Java's may differ; only texts are searched, not titles."""
    try:
        compiled = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
    except re.error as e:
        raise QueryError(str(e)) from None
    if not ignore_case and _ALIKE.fullmatch(pattern) and not compiled.match(""):
        return regex_search_builtin(docs, pattern, limit, id_col, text_col)

    def first(frames):
        for frame in frames:
            found = [compiled.search(t) if t is not None else None for t in frame["text"]]
            hit = [m is not None for m in found]
            yield pd.DataFrame({"doc_id": frame["doc_id"][hit], "focus": [m.start() for m in found if m], "score": 1.0})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(first, f"doc_id {kind}, focus long, score double")
    return rows.orderBy("doc_id").limit(limit)


def regex_search_builtin(docs: DataFrame, pattern: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same in built-in functions, for patterns that mean the same in Java."""
    at = F.length(F.element_at(F.split(F.col(text_col), pattern, 2), 1))
    return docs.where(F.rlike(F.col(text_col), F.lit(pattern))).select(F.col(id_col).alias("doc_id"), at.cast("long").alias("focus"), F.lit(1.0).alias("score")).orderBy("doc_id").limit(limit)
