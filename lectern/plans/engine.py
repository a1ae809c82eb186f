"""One front for all searches: validation, scope, ranking, and hits with their snippets.

Ranking reads indexes only; texts are joined to the final page, whose size the caller bounds.
"""

from __future__ import annotations

import datetime
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import entities, lexical, relational, snippets, vectors
from lectern.plans import models

MODES = ("semantic", "regex", "bm25", "bm25-combined", "bm25-lemma")
MOST_HITS = 1000
Text, Number = str | None, int | None


@dataclass(frozen=True)
class Hit:
    article_id: str
    newspaper: str | None
    date: str | None
    title: str | None
    urn: str | None
    score: float
    snippet: str
    line_start: int
    line_end: int
    position: str
    document_id: str


@dataclass
class Engine:
    """``issues`` (newspaper_id, source, title, date, urn, content), ``articles`` (article_id, newspaper_id,
    title, content, is_valid, char_start, char_end, line_start, line_end), and what is there of indexes."""

    issues: DataFrame
    articles: DataFrame
    surface: lexical.Index | None = None
    lemma: lexical.Index | None = None
    vectors: DataFrame | None = None  # article_id, vector_id, embedding
    embedder: str = "hashed-words"
    names: DataFrame | None = None
    members: DataFrame | None = None

    def search(self, mode: str, query: str, *, offset: int = 0, limit: int = 10, newspaper: Text = None, newspapers: list | None = None, date_from: Text = None, date_to: Text = None, lemma_weight: float = 1.0, ignore_case: bool = False, context_lines: int = 0, max_snippet_chars: int = 320, source_wrap_chars: int = 240, candidates: int | None = None, profile: dict | None = None) -> list[Hit]:
        began = time.monotonic()
        self._check(mode, query, limit, offset, newspaper, newspapers, date_from, date_to)
        scope = relational.in_scope(newspapers if newspapers is not None else newspaper, date_from, date_to, title="issue_title")
        issues = self.issues.select("newspaper_id", "source", F.col("title").alias("issue_title"), "date", "urn")
        found = self.articles.where("is_valid = 1").join(issues.where(scope), "newspaper_id")
        page = self._ranked(mode, query, found, limit, offset, lemma_weight, ignore_case, candidates)
        ranked = [(r["doc_id"], r["score"]) for r in page.collect()]
        if profile is not None:
            profile["ranking_seconds"] = time.monotonic() - began
            profile["plan"] = page._jdf.queryExecution().simpleString()
        hits = self._hits(dict(ranked), query if mode.startswith("bm25") else "", context_lines, max_snippet_chars, source_wrap_chars)
        if profile is not None:
            profile["total_seconds"] = time.monotonic() - began
        return sorted(hits, key=lambda h: (-h.score, h.article_id)) if mode != "regex" else sorted(hits, key=lambda h: h.article_id)

    def _check(self, mode, query, limit, offset, newspaper, newspapers, date_from, date_to) -> None:
        if mode not in MODES:
            raise ValueError(f"a mode is one of {', '.join(MODES)}")
        if not isinstance(query, str) or not query.strip():
            raise ValueError("the query is empty")
        if not 1 <= limit <= MOST_HITS or offset < 0:
            raise ValueError(f"a limit is 1 to {MOST_HITS}, and an offset isn't negative")
        if newspapers is not None and (mode != "semantic" or newspaper is not None or not 1 <= len(newspapers) <= 100 or any(not 1 <= len(n) <= 200 for n in newspapers)):
            raise ValueError("a list of newspapers is for semantic search, 1 to 100 short names")
        for bound in (date_from, date_to):
            if bound is not None:
                datetime.date.fromisoformat((bound + "-01-01")[:10] if len(bound) == 4 else (bound + "-01")[:10])
        if mode in ("bm25-lemma", "bm25-combined") and (self.lemma is None or not self.lemma.rows):
            raise ValueError("there is no lemma index")
        if mode.startswith("bm25"):
            lexical.parse(query)  # a malformed query is refused whatever the scope holds

    def _ranked(self, mode, query, found, limit, offset, lemma_weight, ignore_case, candidates) -> DataFrame:
        ids = found.select(F.col("article_id").alias("doc_id"))
        within = lambda index: lexical.bm25(index, query).join(ids, "doc_id", "left_semi")
        if mode == "bm25":
            return lexical.top(within(self.surface), limit, offset)
        if mode == "bm25-lemma":
            return lexical.top(within(self.lemma), limit, offset)
        if mode == "bm25-combined":
            return lexical.fuse(within(self.surface), within(self.lemma), limit, offset, lemma_weight)
        if mode == "regex":
            return lexical.regex_search(found, query, limit, ignore_case, "article_id", "content")
        q = vectors.query_vector(models.load(self.embedder)([query])[0])
        scored = vectors.scores(self.vectors, q, "vector_id", "embedding", ["article_id"]).join(ids.withColumnRenamed("doc_id", "article_id"), "article_id", "left_semi")
        return vectors.best_of_groups(scored, "vector_id", "article_id", limit, offset, candidates).select(F.col("article_id").alias("doc_id"), "score")

    def _hits(self, scores: dict, query: str, context: int, most: int, width: int) -> list[Hit]:
        if not scores:
            return []
        rows = self.articles.where(F.col("article_id").isin(list(scores))).alias("a").join(self.issues.alias("i"), "newspaper_id")
        out = []
        for r in rows.select("article_id", "newspaper_id", F.col("a.title").alias("title"), F.col("a.content").alias("text"), *"char_start char_end line_start line_end".split(), F.col("i.source").alias("source"), F.col("i.title").alias("issue_title"), "date", "urn", F.col("i.content").alias("whole")).collect():
            at = snippets.focus(r["title"], r["text"], r["char_start"], r["char_end"], query)
            text, first, last = snippets.trim_span(r["whole"], r["line_start"] - context, r["line_end"] + context, at, most)
            urn = r["urn"]
            name = urn.removeprefix("URN:NBN:SI:doc-") if urn else r["newspaper_id"]
            out.append(Hit(r["article_id"], r["source"] or r["issue_title"], r["date"], r["title"], urn, scores[r["article_id"]], text, first, last, snippets.position(r["whole"], at, width), name))
        return out

    def read_source(self, document_id: str, *, position: Text = None, line_start: Number = None, line_end: Number = None, before: int = 0, after: int = 0, wrap_chars: int = 240, max_bytes: int = 16_384) -> dict:
        """An excerpt by lines or around a wrapped position."""
        if (position is None) == (line_start is None):
            raise ValueError("give lines or a position")
        rows = self.issues.where((F.col("newspaper_id") == document_id) | F.col("urn").isin(document_id, "URN:NBN:SI:doc-" + document_id)).limit(2).collect()
        if len(rows) != 1:
            raise ValueError("no document has that id" if not rows else "the id isn't of one document")
        row = rows[0]
        excerpt = snippets.read_wrapped(row["content"], position, before, after, wrap_chars, max_bytes) if position is not None else snippets.read_lines(row["content"], line_start, line_end or line_start, max_bytes)
        return dict(document_id=document_id, urn=row["urn"], date=row["date"], newspaper=row["source"] or row["title"]) | excerpt

    def search_entities(self, query: str) -> list[dict]:
        return [r.asDict() for r in entities.search(self.names, query).collect()]

    def search_entity_articles(self, name: str, *, limit: int = 20, after: Text = None, newspaper: Text = None, date_from: Text = None, date_to: Text = None) -> dict:
        """A page of the name's live articles, and where the next one begins."""
        issues = self.issues.select("newspaper_id", "source", F.col("title").alias("issue_title"), "date")
        rows = entities.articles_of(self.members, self.articles.join(issues, "newspaper_id"), name, after, limit + 1, relational.in_scope(newspaper, date_from, date_to, title="issue_title")).select("article_id", "title", "source", "date", "mention_start").collect()
        return {"articles": [r.asDict() for r in rows[:limit]], "next_after": rows[limit - 1]["article_id"] if len(rows) > limit else None}

    def status(self) -> dict:
        """What is indexed against what there is."""
        valid = self.articles.where("is_valid = 1").count()
        count = lambda index: index.rows if index else 0
        return {"valid_articles": valid, "surface": count(self.surface), "lemma": count(self.lemma), "vectors": self.vectors.count() if self.vectors is not None else 0, "names": self.names.count() if self.names is not None else 0}


def answer(engine: Engine, request: dict) -> dict:
    """One request of the line protocol: an operation and its arguments to a result or an error."""
    operations = {"search": lambda a: [asdict(h) for h in engine.search(**a)], "read": lambda a: engine.read_source(**a), "entities": lambda a: engine.search_entities(**a), "entity_articles": lambda a: engine.search_entity_articles(**a), "status": lambda a: engine.status()}
    reply = {"id": request.get("id")} if isinstance(request, dict) else {"id": None}
    try:
        if not isinstance(request, dict) or request.get("op") not in operations:
            raise ValueError(f"an operation is one of {', '.join(operations)}")
        return reply | {"ok": True, "result": operations[request["op"]](request.get("args", {}))}
    except (ValueError, TypeError, KeyError) as e:
        return reply | {"ok": False, "error": str(e)}
