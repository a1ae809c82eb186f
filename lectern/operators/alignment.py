"""Tokens back to source offsets, sub-words to words, and predictions side by side."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import Spans

_REFERENCE = {f"&{name};": c for name, c in zip(("amp", "lt", "gt"), "&<>")}
_PIECE = re.compile("|".join(_REFERENCE) + "|.", re.S)


def _silent(c: str) -> bool:
    """Control characters, which a tokenizer may drop anywhere."""
    return ord(c) < 32 or 127 <= ord(c) <= 159


def align(tokens: Iterable[str], text: str) -> Spans:
    """Source spans of tokens that stand in the text's order. The tokenizer may have decoded the three basic
    character references, written soft hyphens as hyphens and dropped control characters; white space
    only separates. Text that no token covers is an error."""
    pieces = [(m.start(), m.end(), "-" if m.group() == "\xad" else _REFERENCE.get(m.group(), m.group())) for m in _PIECE.finditer(text)]
    at, spans = 0, []
    for token in tokens:
        while at < len(pieces) and (pieces[at][2].isspace() or _silent(pieces[at][2])):
            at += 1
        first = at
        for char in token:
            while at > first and at < len(pieces) and pieces[at][2] != char and _silent(pieces[at][2]) and not pieces[at][2].isspace():
                at += 1
            if at == len(pieces) or pieces[at][2] != char:
                raise ValueError(f"the token {token!r} isn't at {pieces[first][0] if first < len(pieces) else len(text)}")
            at += 1
        if not token:
            raise ValueError("a token is empty")
        spans.append((pieces[first][0], pieces[at - 1][1]))
    rest = [p for p in pieces[at:] if not (p[2].isspace() or _silent(p[2]))]
    if rest:
        raise ValueError(f"no token covers the text at {rest[0][0]}")
    return spans


def words_of_subwords(predictions: list[dict]) -> list[dict]:
    """(word_id, start, end, label, score) of sub-word predictions: a word has its first piece's label, and
    neighbouring words of one label, B- and I- prefixes apart, are one entity with the mean score."""
    words: dict[int, dict] = {}
    for p in predictions:
        if p["word_id"] in words:
            words[p["word_id"]]["end"] = p["end"]
        else:
            words[p["word_id"]] = dict(p)
    out: list[dict] = []
    for w in sorted(words.values(), key=lambda w: w["word_id"]):
        mark, _, kind = w["label"].rpartition("-")
        if w["label"] == "O":
            continue
        last = out[-1] if out else None
        if last and mark != "B" and last["label"] == kind and last["word_id"] == w["word_id"] - 1:
            last |= {"end": w["end"], "word_id": w["word_id"], "scores": [*last["scores"], w["score"]]}
        else:
            out.append({"start": w["start"], "end": w["end"], "label": kind, "word_id": w["word_id"], "scores": [w["score"]]})
    return [{"start": e["start"], "end": e["end"], "label": e["label"], "score": sum(e["scores"]) / len(e["scores"])} for e in out]


def highlight(text: str, marks: list[dict], begin: int, stop: int) -> str:
    """The excerpt as HTML with a mark on each stretch, titled by the labels that cover it."""
    cuts = sorted({begin, stop, *(min(max(x, begin), stop) for m in marks for x in (m["start"], m["end"]))})
    out = ""
    for a, b in zip(cuts, cuts[1:]):
        labels = ", ".join(sorted({m["label"] for m in marks if m["start"] <= a and b <= m["end"]}))
        shown = html.escape(text[a:b])
        out += f'<mark title="{html.escape(labels)}">{shown}</mark>' if labels else shown
    return out


def disagreements(left: DataFrame, right: DataFrame, labels: list[str]) -> DataFrame:
    """(article_id, only_left, only_right) of articles whose mentions differ in span or label."""
    key = ["article_id", "char_start", "char_end", "label"]
    a, b = (x.where(F.col("label").isin(labels)).select(*key).distinct() for x in (left, right))
    both = a.withColumn("__l", F.lit(1)).join(b.withColumn("__r", F.lit(1)), key, "full_outer")
    return both.groupBy("article_id").agg(F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right")).where("only_left + only_right > 0")


def run_summary(runs: DataFrame) -> DataFrame:
    """By configuration: runs, mean and sample deviation of the seconds, articles a second."""
    config = [c for c in runs.columns if c not in ("seconds", "articles", "run_id")]
    return runs.groupBy(*config).agg(F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("mean"), F.stddev_samp("seconds").alias("deviation"), (F.sum("articles") / F.sum("seconds")).alias("articles_a_second"))


def throughput(runs: DataFrame, config: list[str]) -> DataFrame:
    """By configuration: runs, documents and tokens a second over all of them, and the best run's documents a second.
    ``runs`` has documents, tokens and seconds; runs that took no time count for nothing."""
    timed = runs.where("seconds > 0")
    return timed.groupBy(*config).agg(F.count(F.lit(1)).alias("runs"), (F.sum("documents") / F.sum("seconds")).alias("documents_a_second"), (F.sum("tokens") / F.sum("seconds")).alias("tokens_a_second"), F.max(F.col("documents") / F.col("seconds")).alias("best"))


def report_page(articles: DataFrame, left: DataFrame, right: DataFrame, labels: list[str], limit: int = 40) -> str:
    """An HTML page of the articles with most disagreements, both predictions marked."""
    worst = disagreements(left, right, labels).orderBy(F.desc(F.col("only_left") + F.col("only_right")), "article_id").limit(limit)
    rows = worst.join(articles.select("article_id", "content"), "article_id").toPandas()
    ids = [int(i) for i in rows["article_id"]]
    spans = [x.where(F.col("article_id").isin(ids)).select("article_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"), "label").toPandas() for x in (left, right)]
    mark = lambda frame, i, text: highlight(text, frame[frame["article_id"] == i].to_dict("records"), 0, len(text))
    body = "".join(f"<h2>{i}</h2><p>{mark(spans[0], i, t)}</p><p>{mark(spans[1], i, t)}</p>" for i, t in zip(rows["article_id"], rows["content"]))
    return f"<!doctype html><meta charset='utf-8'><title>Disagreements</title>{body}"


