"""Audits of every stage of an archive, the adoption of stages that were built elsewhere, and the reuse of stages that
passed before.

An audit is rows (stage, check, problems) that are all zero for a sound stage; each check is a join or an aggregate,
so that nothing but counts reaches the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import search_tokens_col
from lectern.operators import entities, relational, shards
from lectern.plans.ledger import Archive, StaleInput, generation, replace, write_once

STAGES = ("issues", "articles", "lexical", "chunks", "vectors", "mentions", "dictionary")


def counted(stage: str, checks: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.lit(stage).alias("stage"), F.lit(name).alias("check"), F.count(F.lit(1)).alias("problems"))
        out = one if out is None else out.unionByName(one)
    return out


def content_digest(column: str = "content") -> Column:
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


def audit_corpus(archive: Archive) -> DataFrame:
    """Issues, articles and chunks against one another and against the issues' texts."""
    issues = archive.current_issues()
    own = counted("issues", {
        "issues that differ from their digest": issues.where(content_digest() != F.col("content_sha256")),
        "identifiers of two issues": issues.select(F.explode("identifiers").alias("i"), "newspaper_id").groupBy("i").agg(F.countDistinct("newspaper_id").alias("n")).where("n > 1"),
    })
    stage = F.when(F.startswith("check", F.lit("chunk")), "chunks").otherwise("articles")
    return own.unionByName(archive.audit().select(stage.alias("stage"), "check", "problems"))


def audit_lexical(documents: DataFrame, articles: DataFrame, tokens=search_tokens_col, title_col: str | None = "title", text_col: str = "content") -> DataFrame:
    """An index's list of documents (doc_id, size) against the articles it should hold."""
    size = F.size(tokens(F.coalesce(text_col, F.lit(""))))
    if title_col:
        size = size + F.size(tokens(F.coalesce(title_col, F.lit(""))))
    want = articles.select(F.col("article_id").alias("doc_id"), size.alias("want"))
    return counted("lexical", {
        "articles that aren't indexed": relational.pending(want, documents, "doc_id"),
        "indexed documents without an article": relational.pending(documents, want, "doc_id"),
        "documents indexed twice": documents.groupBy("doc_id").count().where("count > 1"),
        "documents of another length": documents.join(want, "doc_id").where("size != want"),
    })


def audit_vectors(vectors: DataFrame, chunks: DataFrame, dimensions: int, slack: float = 1e-3) -> DataFrame:
    """Vectors against chunks: ids without gaps, one a chunk, of one length, at length 1, and of the chunk's present text."""
    v = F.col("embedding")
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    proof = shards.id_proof(vectors, chunks).select(F.lit("vectors").alias("stage"), "check", "problems")
    texts = chunks.select("chunk_id", content_digest("text").alias("now"))
    return proof.unionByName(counted("vectors", {
        "vectors of another dimension": vectors.where(F.size(v) != dimensions),
        "vectors that aren't at length 1": vectors.where(F.abs(squares - 1) > slack),
        "vectors of another text": vectors.join(texts, "chunk_id").where(F.col("text_sha256") != F.col("now")),
    }))


def audit_mentions(mentions: DataFrame, done: DataFrame, articles: DataFrame) -> DataFrame:
    """Mentions and completions against the articles' present texts."""
    eligible = entities.eligible(articles)
    texts = articles.select("article_id", "content", content_digest().alias("now"))
    placed = mentions.join(texts, "article_id")
    inside = F.expr("substring(content, char_start + 1, char_end - char_start)")
    counts = mentions.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    return counted("mentions", {
        "articles that weren't looked at": relational.pending(eligible.select("article_id"), done, "article_id"),
        "completions without an article": relational.pending(done, articles, "article_id"),
        "completions of another text": done.join(texts, "article_id").where(F.col("content_sha256") != F.col("now")),
        "completions of another number": done.join(counts, "article_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("entities")),
        "mentions without a completion": relational.pending(mentions, done, "article_id"),
        "mentions that aren't in the text": placed.where((inside != F.col("text")) | (F.col("char_start") >= F.col("char_end"))),
        "labels that are blank or scores that aren't finite": mentions.where((F.trim("label") == "") | F.isnan("score") | (F.abs("score") == float("inf"))),
    })


def audit_dictionary(names: DataFrame, members: DataFrame, mentions: DataFrame, done: DataFrame) -> DataFrame:
    """A dictionary against the one that its mentions give."""
    want_names, want_members = entities.dictionary(mentions, done)
    key = ["normalized_name", "article_id"]
    both = members.join(want_members.select(*key, F.col("char_start").alias("want"), F.col("content_sha256").alias("text_now")), key)
    counts = names.join(want_names.select("normalized_name", F.col("article_count").alias("want")), "normalized_name")
    return counted("dictionary", {
        "memberships that are missing": relational.pending(want_members.select(*key), members, key),
        "memberships without a mention": relational.pending(members.select(*key), want_members, key),
        "memberships of another place or text": both.where((F.col("char_start") != F.col("want")) | (F.col("content_sha256") != F.col("text_now"))),
        "names that are missing": relational.pending(want_names, names, "normalized_name"),
        "names without a mention": relational.pending(names, want_names, "normalized_name"),
        "names of another count": counts.where("article_count != want"),
    })


def problems(audits: list[DataFrame]) -> dict[str, dict[str, int]]:
    """By stage the checks that found any; a sound stage is there with none."""
    out: dict[str, dict[str, int]] = {}
    for audit in audits:
        for r in audit.collect():
            found = out.setdefault(r["stage"], {})
            if r["problems"]:
                found[r["check"]] = r["problems"]
    return out


# adoption and reuse


def adopt(archive: Archive, stage: str, audit: DataFrame, inputs: dict) -> dict:
    """Takes a stage that was built elsewhere for this archive's own, if its audit is clean: a report that is written
    once, with what it was built from. The same adoption again is the same report."""
    if stage not in STAGES:
        raise ValueError(f"a stage is one of {', '.join(STAGES)}")
    found = problems([audit]).get(stage)
    if found is None:
        raise ValueError("the audit isn't one of this stage")
    if found:
        raise StaleInput("; ".join(f"{k}: {v}" for k, v in found.items()))
    report = {"format": "lectern.adoption.v1", "stage": stage, "inputs": inputs, "name": generation(stage, inputs)}
    path = archive.local / "adopted" / f"{stage}.json"
    if path.exists():
        if json.loads(path.read_text()) != report:
            raise StaleInput(f"another {stage} was adopted")
        return report
    write_once(path, report)
    return report


def adopted(archive: Archive, stage: str, inputs: dict) -> bool:
    """Whether the stage was adopted as built from these inputs."""
    path = archive.local / "adopted" / f"{stage}.json"
    return path.exists() and json.loads(path.read_text())["name"] == generation(stage, inputs)


def audit_once(archive: Archive, audits: dict, inputs: dict[str, dict]) -> dict[str, str]:
    """By stage "passed" or "reused". ``audits`` has a function for each stage that makes its audit, ``inputs`` what the
    stage depends on; one that passed before with just these inputs, and since when no earlier stage has changed, isn't
    audited again. The first stage with problems ends it."""
    path = archive.local / "audited.json"
    before = json.loads(path.read_text()) if path.exists() else {}
    out, names = {}, []
    for stage in (s for s in STAGES if s in audits):
        names.append(generation(stage, inputs[stage]))
        name = generation(names)  # with all stages in front of it
        if before.get(stage) == name:
            out[stage] = "reused"
            continue
        found = problems([audits[stage]()])
        bad = {k: v for checks in found.values() for k, v in checks.items()}
        if bad:
            raise StaleInput(f"{stage}: " + "; ".join(f"{k}: {v}" for k, v in bad.items()))
        before = {k: v for k, v in before.items() if STAGES.index(k) < STAGES.index(stage)} | {stage: name}
        replace(path, before)
        out[stage] = "passed"
    return out
