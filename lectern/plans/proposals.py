"""Proposals for groups of names that a model or a person decides on: a task, its checked answer, its effect."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import json_digest, normalize_name
from lectern.operators import entities, relational
from lectern.plans.curation import Conflict, Curation

DECISIONS = ("include", "exclude", "uncertain")
MOST_CANDIDATES, MOST_EXISTING = 12, 20


@dataclass
class Task:
    anchor: str
    group_id: str | None
    existing: list[str]
    candidates: list[str]
    revision: int
    stage: str = "spelling"
    evidence: dict[str, list[dict]] = field(default_factory=dict)

    @property
    def fingerprint(self) -> str:
        return json_digest(self.__dict__)


def prepare(store: Curation, names: DataFrame, name: str, limit: int = 8) -> Task:
    """The name's group, if any, and candidates in no group that weren't told apart from it."""
    if not 1 <= limit <= MOST_CANDIDATES:
        raise ValueError(f"a task has 1 to {MOST_CANDIDATES} candidates")
    anchor = normalize_name(name)
    group_id = store.membership(anchor)
    existing = store.group(group_id)["members"] if group_id else [anchor]
    if len(existing) > MOST_EXISTING:
        raise ValueError("a group as large is for review by hand")
    anchors = [anchor, *[m for m in existing if m != anchor][:4]]
    found = entities.variants(names, anchors, limit=100).where(~F.col("normalized_name").isin(existing)).collect()
    free = [r["normalized_name"] for r in found if store.membership(r["normalized_name"]) is None and not any(store.is_rejected(a, r["normalized_name"]) for a in existing)]
    if not free:
        raise Conflict("the name has no candidates")
    return Task(anchor, group_id, existing, free[:limit], store.revision)


def with_evidence(task: Task, asked: list[str], members: DataFrame, articles: DataFrame, limit: int = 3) -> Task:
    """The task's second stage: passages of the names asked about, spread over sources and years."""
    if not set(asked) <= {*task.candidates, *task.existing}:
        raise ValueError("evidence is for the task's names")
    live = articles.withColumn("content_sha256", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    rows = members.where(F.col("normalized_name").isin(asked)).join(live, ["article_id", "content_sha256"])
    shown = rows.select("normalized_name", "article_id", "source", F.substring("date", 1, 4).alias("year"), "date", F.expr("substring(content, greatest(1, char_start - 80), 240)").alias("passage"))
    picked = relational.spread(shown, "normalized_name", ["source", "year"], ["date", "source", "article_id"], limit)
    evidence: dict[str, list[dict]] = {n: [] for n in asked}
    for r in picked.orderBy("normalized_name", "place").collect():
        evidence[r["normalized_name"]].append({"evidence_id": f"{r['normalized_name']}#{r['place']}", "source": r["source"], "date": r["date"], "passage": r["passage"]})
    return Task(task.anchor, task.group_id, task.existing, task.candidates, task.revision, "context", evidence)


def review(task: Task, answer: dict) -> dict[str, list[str]]:
    """Names by decision of a valid answer: one decision for each candidate, with reasons and known evidence;
    in the first stage ``needs_evidence`` may be one."""
    allowed = (*DECISIONS, "needs_evidence") if task.stage == "spelling" else DECISIONS
    known = {e["evidence_id"] for found in task.evidence.values() for e in found}
    rows = answer.get("decisions") if isinstance(answer, dict) else None
    if not isinstance(rows, list) or sorted(r.get("name", "") for r in rows) != sorted(task.candidates):
        raise ValueError("an answer decides on each candidate once")
    out: dict[str, list[str]] = {d: [] for d in allowed}
    for r in rows:
        if r.get("decision") not in allowed or not 1 <= len(r.get("reason", "")) <= 240 or not set(r.get("evidence_ids", [])) <= known:
            raise ValueError(f"the decision on {r['name']!r} isn't one")
        out[r["decision"]].append(r["name"])
    return out


def apply(store: Curation, task: Task, answer: dict, *, operation_id: str, actor: str) -> dict | None:
    """Adds what is included to the group, or makes one; excluded names are told apart from the anchor. The
    store must be as it was when the task was made."""
    found = review(task, answer)
    if found.get("needs_evidence"):
        raise ValueError("some names need evidence first")
    if store.revision != task.revision:
        raise Conflict("the store has changed since the task was made")
    result = None
    if found["include"]:
        members = sorted({*task.existing, *found["include"]})
        preferred = answer.get("preferred_name") or task.anchor
        payload = {"members": members, "preferred": preferred} | ({"group_id": task.group_id} if task.group_id else {})
        result = store.mutate("update" if task.group_id else "create", payload, operation_id=operation_id, actor=actor)
    for k, name in enumerate(found["exclude"]):
        store.mutate("reject", {"pair": [task.anchor, name]}, operation_id=f"{operation_id}/{k}", actor=actor)
    return result


def autonomous(store: Curation, names: DataFrame, task: Task, answer: dict, *, operation_id: str) -> dict | None:
    """Applies an answer without review, if the policy agrees with every inclusion."""
    included = review(task, answer)["include"]
    counts = {r["normalized_name"]: r["article_count"] for r in names.where(F.col("normalized_name").isin([*included, task.anchor])).collect()}
    bad = [n for n in included if not entities.same_by_policy(task.anchor, n, counts.get(task.anchor, 0), counts.get(n, 0))]
    if bad or not included or task.group_id or store.revision != task.revision:
        return None
    return store.apply_autonomous({"preferred": answer.get("preferred_name") or task.anchor, "members": sorted({task.anchor, *included})}, operation_id=operation_id)


def training_rows(store: Curation) -> list[dict]:
    """Reviewed changes as examples: what was asked and what was decided."""
    import json

    rows = store.db.execute("SELECT action, payload, actor FROM changes WHERE undone = 0 AND actor <> 'autonomous' ORDER BY revision")
    return [{"action": r["action"], "payload": json.loads(r["payload"]), "actor": r["actor"]} for r in rows]
