"""From issues to articles to chunks, all with offsets into the source (code points, end exclusive)."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import Spans, stable_id, text_outside_tables

Span = tuple[int, int]
_BLANK = "[\t ]"
_HEADING = re.compile(f"(?m)^{_BLANK}{{0,3}}#{_BLANK}*(?P<title>.*?){_BLANK}*$")
ARTICLES = "newspaper_id string, article_id string, title string, content string, article_index int, char_start int, char_end int, content_start int, line_start int, line_end int, is_valid int"
CHUNKS = "article_id string, chunk_id string, chunk_index int, text string, char_start int, char_end int, line_start int, line_end int"


class Lines:
    """Lines, from 1, of code-point offsets; only a line feed ends a line."""

    def __init__(self, text: str):
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def of(self, begin: int, stop: int) -> tuple[int, ...]:
        return tuple(bisect.bisect_left(self.ends, max(0, x)) + 1 for x in (begin, max(begin, stop - 1)))


def trimmed(text: str, start: int, end: int) -> Span:
    """The span without white space at its ends; empty spans collapse at the right end."""
    inner = text[start:end]
    lead = len(inner) - len(inner.lstrip())
    return start + lead, max(start + lead, end - (len(inner) - len(inner.rstrip())))


def articles_of(markdown: str) -> Iterator[dict]:
    """Sections under headings that begin with a number sign, whatever their level; text in front of the
    first one is dropped, as are empty bodies. Without headings the whole text is one untitled article."""
    heads = [m for m in _HEADING.finditer(markdown) if m["title"].strip()]
    regions = [(m.start(), m.end(), m["title"].strip()) for m in heads] or [(None, 0, None)]
    stops = [m.start() for m in heads[1:]] + [len(markdown)]
    lines, index = Lines(markdown), 0
    for (head, body, title), stop in zip(regions, stops):
        start, end = trimmed(markdown, body, stop)
        if start >= end:
            continue
        begin = start if head is None else head
        first, last = lines.of(begin, end)
        yield {"title": title, "content": markdown[start:end], "article_index": index, "char_start": begin, "char_end": end, "content_start": start, "line_start": first, "line_end": last}
        index += 1


def split_articles(issues: DataFrame) -> DataFrame:
    """Articles of (newspaper_id, relative_path, content). An article's id hashes its path and span."""

    def run(frames):
        for frame in frames:
            rows = [{"newspaper_id": n, "relative_path": p, **a} for n, p, c in zip(frame.newspaper_id, frame.relative_path, frame.content) if c for a in articles_of(c)]
            if rows:
                yield pd.DataFrame(rows)

    found = issues.select("newspaper_id", "relative_path", "content").mapInPandas(run, "newspaper_id string, relative_path string, title string, content string, article_index int, char_start int, char_end int, content_start int, line_start int, line_end int")
    named = found.withColumn("article_id", stable_id("article", F.col("relative_path"), F.col("char_start"), F.col("char_end"))).withColumn("is_valid", F.lit(None).cast("int"))
    return named.select(*[c.split()[0] for c in ARTICLES.split(", ")])


def whitespace_offsets(text: str) -> Spans:
    return [m.span() for m in re.finditer(r"\S+", text)]


def token_windows(text: str, offsets: Callable[[str], Spans] = whitespace_offsets, count: int = 256, overlap: int = 64, skip_tables: bool = False) -> Iterator[tuple[int, int]]:
    """Spans of windows of ``count`` tokens, each ``count - overlap`` after the last; a window that reaches
    the end is the last one. With ``skip_tables`` the windows start anew behind each table."""
    if not 0 <= overlap < count:
        raise ValueError("the overlap must be less than the count")
    for a, b in text_outside_tables(text) if skip_tables else [(0, len(text))]:
        tokens = offsets(text[a:b])
        for first in range(0, len(tokens), count - overlap):
            window = tokens[first : first + count]
            start, end = trimmed(text, a + window[0][0], a + window[-1][1])
            if start < end:
                yield start, end
            if first + count >= len(tokens):
                break


def chunk_articles(articles: DataFrame, sources: DataFrame, offsets: Callable[[str], Spans] = whitespace_offsets, count: int = 256, overlap: int = 64, skip_tables: bool = False) -> DataFrame:
    """Token windows of articles with offsets and lines of their issue (newspaper_id, content). Chunks are
    numbered as they are emitted."""

    def run(frames):
        for frame in frames:
            rows = []
            for article, content, base, source in zip(frame.article_id, frame.content, frame.content_start, frame.source_text):
                lines = Lines(source)
                for i, (a, b) in enumerate(token_windows(content, offsets, count, overlap, skip_tables)):
                    first, last = lines.of(base + a, base + b)
                    rows.append((article, i, content[a:b], base + a, base + b, first, last))
            if rows:
                yield pd.DataFrame(rows, columns="article_id chunk_index text char_start char_end line_start line_end".split())

    joined = articles.select("newspaper_id", "article_id", "content", "content_start").join(sources.select("newspaper_id", F.col("content").alias("source_text")), "newspaper_id")
    found = joined.mapInPandas(run, "article_id string, chunk_index int, text string, char_start int, char_end int, line_start int, line_end int")
    return found.withColumn("chunk_id", stable_id("chunk", F.col("article_id"), F.col("chunk_index"), F.col("char_start"), F.col("char_end"))).select(*[c.split()[0] for c in CHUNKS.split(", ")])


# chunkers without offsets, as columns


def _windows(items: Column, count: int, overlap: int) -> Column:
    """array<array<..>> of the windows that ``token_windows`` would give."""
    if not 0 <= overlap < count:
        raise ValueError("the overlap must be less than the count")
    step = count - overlap

    def cut(own: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(own) - count) / F.lit(step))).cast("int")
        return F.when(F.size(own) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(own, k * step + 1, count))).otherwise(F.array().cast(T_NESTED))

    # Bound to a variable, so that the items are made once and not for each window.
    return F.flatten(F.transform(F.array(items), cut))


T_NESTED = "array<array<string>>"


def sentences(text: Column) -> Column:
    """White space collapsed, split behind sentence ends."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=[!.?])\s+"), lambda s: s != "")


def sentence_windows(text: Column, count: int = 5, overlap: int = 1) -> Column:
    return F.transform(_windows(sentences(text), count, overlap), lambda w: F.array_join(w, " "))


def word_windows(text: Column, count: int = 256, overlap: int = 64) -> Column:
    """Windows of white-space tokens, joined by single spaces."""
    words = F.filter(F.split(text, r"\s+"), lambda s: s != "")
    return F.transform(_windows(words, count, overlap), lambda w: F.array_join(w, " "))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, blank ones dropped."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.filter(F.transform(F.split(text, r"\n\s*\n+"), strip), lambda p: p != "")


def whole(text: Column) -> Column:
    """The text as its only chunk."""
    return F.array(text)


def recursive_parts(text: str, size: int = 2000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Parts of at most ``size`` characters, cut at the coarsest separator that does, then merged with an
    overlap of whole pieces. Headings and blank lines are dropped first."""
    kept = "\n".join(x for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#"))

    def merge(pieces: list[str], glue: str) -> Iterator[str]:
        held: list[str] = []
        total = 0
        for piece in pieces:
            extra = len(piece) + (len(glue) if held else 0)
            if held and total + extra > size:
                yield glue.join(held)
                while held and (total > overlap or total + extra > size):
                    total -= len(held.pop(0)) + (len(glue) if held else 0)
            total += len(piece) + (len(glue) if held else 0)
            held.append(piece)
        if held:
            yield glue.join(held)

    def cut(part: str, level: int) -> Iterator[str]:
        while separators[level] and separators[level] not in part:
            level += 1
        mark = separators[level]
        small: list[str] = []
        for piece in part.split(mark) if mark else list(part):
            if len(piece) <= size:
                if piece:
                    small.append(piece)
                continue
            yield from merge(small, mark)
            small = []
            yield from cut(piece, level + 1)
        yield from merge(small, mark)

    return [p.strip() for p in cut(kept, 0) if p.strip()] if kept.strip() else []


def explode_chunks(rows: DataFrame, id_col: str, chunks: Column) -> DataFrame:
    """(id, chunk_index, chunk) of a column of arrays."""
    return rows.select(F.col(id_col), F.posexplode(chunks).alias("chunk_index", "chunk"))


def token_id_windows(text: str, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], count: int = 512, overlap: int = 50) -> list[str]:
    """Windows of token ids, decoded and trimmed; blank ones are skipped."""
    if not 0 <= overlap < count:
        raise ValueError("the overlap must be less than the count")
    ids, out = encode(text), []
    for first in range(0, len(ids), count - overlap):
        out.append(decode(ids[first : first + count]).strip())
        if first + count >= len(ids):
            break
    return [x for x in out if x]
