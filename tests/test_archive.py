import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, entities, relational, requests
from lectern.plans import cli, models
from lectern.plans.curation import Conflict, Curation
from lectern.plans.engine import answer
from lectern.plans.ledger import Archive, StaleInput, write_once
from lectern.plans.serve import run_lines
from lectern.sources import markdown

SIDECAR = {"Record": {"source": "Daily", "identifier": "URN:NBN:SI:doc-A", "date": "1934 10 10"}}
ISSUE = "# First article\nAlpha beta gamma delta.\nMarija Kos met Ana Novak.\n\n# Other article\nNeedle appears here.\n"


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    folder = root / "in" / "Daily_News"
    folder.mkdir(parents=True)
    (folder / "a b.md").write_text(ISSUE)
    (folder / "a b_metadata.json").write_text(json.dumps(SIDECAR))
    (folder / "c.md").write_text("Only text with a needle.\r\nHere is Ana Novak.")
    (folder / "x_metadata.md").write_text("# not an issue")
    found = Archive(spark, str(root / "store"))
    assert cli.ingest(found, str(root / "in"), count=3, overlap=1) == {"issues": 2, "articles": 3, "chunks": 9}
    for kind in ("surface", "lemma", "semantic", "entities"):
        cli.index(found, kind)
    return found


def test_ingest_again_changes_nothing(archive, tmp_path_factory):
    folder = str(archive.local.parent / "in")
    assert cli.ingest(archive, folder, count=3, overlap=1) == {"issues": 0, "articles": 0, "chunks": 0}
    with pytest.raises(StaleInput):
        cli.ingest(archive, folder, count=4, overlap=1)


def test_audit_and_publication(archive):
    assert {r.problems for r in archive.audit().collect()} == {0}
    pointer = archive.publish("ingest", {"semantic": "0123456789abcdef"})
    assert archive.published() == pointer == archive.publish("ingest", {"semantic": "0123456789abcdef"})
    archive.bump_epoch()
    with pytest.raises(StaleInput):
        archive.published()
    assert {r.stage: (r.completed, r.pending) for r in archive.status("ingest").collect()} == {s: (2, 0) for s in ("issues", "articles", "chunks")}


def test_search_modes(archive):
    engine = cli.engine_of(archive)
    hits = engine.search("bm25", "needle")
    assert len(hits) == 2 and {h.newspaper for h in hits} == {"Daily", None} and "eedle" in hits[0].snippet
    assert [h.document_id for h in engine.search("bm25", "needle", newspaper="Daily", date_from="1934")] == ["A"]
    assert engine.search("bm25", "needle", date_to="1930") == []
    assert len(engine.search("bm25-combined", "needle", profile=(profile := {}))) == 2 and profile["total_seconds"] > 0
    assert len(engine.search("regex", r"[Nn]eedle\b", limit=1)) == 1
    assert engine.search("semantic", "needle appears")[0].title == "Other article"
    for bad in ({"mode": "bm25", "query": ""}, {"mode": "x", "query": "a"}, {"mode": "bm25", "query": "(a"}, {"mode": "bm25", "query": "a", "newspapers": ["b"]}, {"mode": "bm25", "query": "a", "date_from": "never"}, {"mode": "bm25", "query": "a", "limit": 0}):
        with pytest.raises(ValueError):
            engine.search(**bad)


def test_reading_and_entities(archive):
    engine = cli.engine_of(archive)
    assert engine.read_source("A", line_start=2, line_end=2)["text"] == "Alpha beta gamma delta.\n"
    assert engine.read_source("A", position="2.1", before=1)["position_start"] == "1.1"
    assert [n["article_count"] for n in engine.search_entities("Ana Novak")] == [2]
    page = engine.search_entity_articles("ana  novak", limit=1)
    assert len(page["articles"]) == 1 and page["next_after"]
    rest = engine.search_entity_articles("ana novak", after=page["next_after"])
    assert len(rest["articles"]) == 1 and rest["next_after"] is None
    assert engine.status()["valid_articles"] == 3


def test_line_protocol(archive):
    engine = cli.engine_of(archive)
    out = io.StringIO()
    run_lines(engine, io.StringIO('{"id": 1, "op": "search", "args": {"mode": "bm25", "query": "needle"}}\n\nnot json\n{"id": 2, "op": "x"}\n'), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["ok"] for r in replies] == [True, False, False] and len(replies[0]["result"]) == 2
    assert answer(engine, {"id": 3, "op": "read", "args": {"document_id": "none", "line_start": 1}})["ok"] is False


def _manifest(root, name, **changes):
    path = root / name
    issue = {"relative_path": f"b/{name}", "markdown_path": name, "metadata_path": None, "markdown_sha256": hashlib.sha256(path.read_bytes()).hexdigest(), "metadata_sha256": None} | changes
    return json.dumps({"format": markdown.MANIFEST_FORMAT, "batch_id": "b1", "issues": [issue]})


def test_batches(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    (root / "n.md").write_text("# New\nBody text.")
    batch_id, issues = markdown.load_manifest(_manifest(root, "n.md"))
    store = Archive(spark, str(tmp_path / "store"))
    batch = markdown.read_batch(spark, str(root), batch_id, issues)
    assert [r.action for r in store.plan(batch).collect()] == ["new"]
    assert store.run(batch, batch_id) == {"issues": 1, "articles": 1, "chunks": 1}
    assert [r.action for r in store.plan(batch).collect()] == ["unchanged"]
    (root / "n.md").write_text("# New\nOther text.")
    changed = markdown.read_batch(spark, str(root), batch_id, markdown.load_manifest(_manifest(root, "n.md"))[1])
    assert [r.action for r in store.plan(changed).collect()] == ["conflict"]
    stale = markdown.read_batch(spark, str(root), batch_id, issues)
    assert stale.first().error == "hash"
    with pytest.raises(StaleInput):
        store.run(stale, batch_id)
    for bad in ({"markdown_path": "../x"}, {"markdown_sha256": "0"}, {"extra": 1}):
        with pytest.raises((ValueError, TypeError)):
            markdown.load_manifest(_manifest(root, "n.md", **bad))
    with pytest.raises(ValueError):
        markdown.strict_json('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        markdown.strict_json('{"a": NaN}')


def test_reports_are_never_overwritten(tmp_path):
    write_once(tmp_path / "r.json", {"a": 1})
    with pytest.raises(FileExistsError):
        write_once(tmp_path / "r.json", {})


def test_name_dictionary(spark):
    rows = [(i, 0, f"Marija {i:03}", "PER", 0, 10, None) for i in range(5)] + [(i, k, "Ana Novak", lab, 15, 24, None) for i in range(5) for k, lab in ((1, "PER"), (2, "ORG"))]
    mentions = spark.createDataFrame(rows, entities.MENTIONS)
    done = spark.createDataFrame([(i, "h", 3) for i in range(5)], entities.DONE)
    names, members = entities.dictionary(mentions, done)
    assert {r.normalized_name: r.article_count for r in names.collect()}["ana novak"] == 5
    again = entities.merge_dictionary(names, members, names, members)
    assert sorted(map(tuple, again[0].select("normalized_name", "article_count").collect())) == sorted(map(tuple, names.select("normalized_name", "article_count").collect()))
    assert again[1].count() == members.count() == 10
    assert [r.normalized_name for r in entities.search(names, "Ana Novk").collect()] == ["ana novak"]
    assert entities.search(names, "marija*").count() == 5
    with pytest.raises(ValueError):
        entities.search(names, "ab")


def test_same_name_policy(spark):
    assert entities.same_by_policy("Ana-Novak", "ana novák", 1, 1)
    assert entities.same_by_policy("Filharmonija", "Fi1harmonija", 50, 2) and not entities.same_by_policy("Filharmonija", "Fi1harmonija", 9, 1)
    names = spark.createDataFrame([("filharmonija", 50), ("fi1harmonija", 2), ("ana novak", 1), ("ana-novak", 3), ("ban", 9)], "normalized_name string, article_count long")
    assert {tuple(r) for r in entities.policy_pairs(names).collect()} == {("ana novak", "ana-novak"), ("fi1harmonija", "filharmonija")}
    assert [r.normalized_name for r in entities.variants(names, ["ana novak"]).collect()] == ["ana-novak"]


def test_extraction_is_checked(spark):
    articles = spark.createDataFrame([(1, "Then Ana Novak spoke."), (2, None)], "article_id long, content string")
    found = entities.extract(articles).collect()
    assert [(r.text, r.char_start) for r in found] == [("Ana Novak", 5)] or found[0].text.endswith("Ana Novak")
    with pytest.raises(ValueError):
        entities.check("abc", [entities.Entity("x", "PER", 0, 1)])


def test_curation(tmp_path, spark):
    store = Curation(tmp_path / "c.db")
    made = store.mutate("create", {"preferred": "Ana", "members": ["Ana", "Anna"]}, operation_id="1", actor="me", expected_revision=0)
    assert store.mutate("create", {"preferred": "Ana", "members": ["Ana", "Anna"]}, operation_id="1", actor="me") == made
    with pytest.raises(Conflict):
        store.mutate("delete", {"group_id": "x"}, operation_id="2", actor="me", expected_revision=0)
    with pytest.raises(Conflict):
        store.mutate("create", {"preferred": "A", "members": ["ANA"]}, operation_id="3", actor="me")
    store.mutate("reject", {"pair": ["Ana", "Hana"]}, operation_id="4", actor="me")
    with pytest.raises(Conflict):
        store.mutate("update", {"group_id": made["group_id"], "members": ["Ana", "Hana"]}, operation_id="5", actor="me")
    with pytest.raises(Conflict):
        store.apply_autonomous({"preferred": "Ana", "members": ["ana", "anna"]}, operation_id="6")
    other = store.apply_autonomous({"preferred": "Nina", "members": ["nina"]}, operation_id="7")
    assert store.group(other["group_id"])["provenance"] == "autonomous"
    union = store.mutate("union", {"group_ids": [made["group_id"], other["group_id"]]}, operation_id="8", actor="me")
    assert store.group(other["group_id"])["members"] == ["ana", "anna", "nina"] and store.canonical(other["group_id"]) == made["group_id"]
    assert store.group(made["group_id"])["provenance"] == "mixed"
    assert store.save_count(made["group_id"], ["ana", "anna", "nina"], "g", 5) and store.count(other["group_id"], "g") == 5
    store.mutate("undo", {"revision": union["revision"]}, operation_id="9", actor="me")
    assert store.group(other["group_id"])["members"] == ["nina"] and store.group(made["group_id"])["members"] == ["ana", "anna"]
    assert store.count(made["group_id"], "g") is None
    store.mutate("reopen", {"pair": ["Hana", "Ana"]}, operation_id="10", actor="me")
    assert not store.is_rejected("ana", "hana")
    store.configure_serving(True, 3)
    with pytest.raises(Conflict):
        store.configure_serving(False, 2)
    tables = store.tables(spark)
    assert tables["members"].count() == 3 and tables["redirects"].count() == 0


def test_curation_queue(tmp_path):
    store = Curation(tmp_path / "q.db")
    store.enqueue([("rare", 1), ("common", 9)])
    assert store.lease(0) == "common" and store.lease(0) == "rare" and store.lease(0) is None
    assert store.lease(1000) == "common"
    store.settle("common", False, 1000)
    assert store.lease(1000) == "common"
    store.settle("common", False, 1000)
    assert store.lease(2000) == "rare" and store.lease(2000) is None


def test_remote_embedding_jobs(spark):
    rows = spark.createDataFrame([(i, "t" * i) for i in range(1, 8)], "chunk_id long, text string").coalesce(1)
    packed = requests.pack_requests(rows, "chunk_id", "text", 3, 10)
    got = {r.chunk_id: (r.request & 0xFFFF, r.place) for r in packed.collect()}
    assert got == {1: (0, 0), 2: (0, 1), 3: (0, 2), 4: (1, 0), 5: (1, 1), 6: (2, 0), 7: (3, 0)}
    lines = {json.loads(r.value)["custom_id"]: json.loads(r.value) for r in requests.request_lines(rows, packed, "chunk_id", "text", "m", 2).collect()}
    assert len(lines) == 4 and sorted(len(x["body"]["input"]) for x in lines.values()) == [1, 1, 2, 3]
    first = next(k for k, v in lines.items() if len(v["body"]["input"]) == 3)
    bad = next(k for k, v in lines.items() if len(v["body"]["input"]) == 2)
    results = [{"custom_id": first, "response": {"status_code": 200, "body": {"data": [{"index": i, "embedding": [i, 1.0]} for i in range(3)]}}}, {"custom_id": bad, "response": {"status_code": 500}}]
    found = {r.chunk_id: (r.embedding, r.error) for r in requests.read_results(spark.createDataFrame([(json.dumps(x),) for x in results], "value string"), packed, "chunk_id").collect()}
    assert found[2] == ([1.0, 1.0], None) and found[4][1] == "500" and found[7][1] == "no result"


def test_models(spark):
    rows = spark.createDataFrame([("a", "Title", "walking dogs"), ("b", None, "...")], "article_id string, title string, content string")
    lemmas = {r.article_id: (r.title, r.content) for r in models.lemmatise(rows, "suffix-free").collect()}
    assert lemmas == {"a": ("tit", "walki dogs"), "b": ("", "...")}
    found = {r.chunk_id: r.is_valid for r in models.embed(spark.createDataFrame([("x", "words here"), ("y", "")], "chunk_id string, text string")).collect()}
    assert found == {"x": 1, "y": 0}
    with pytest.raises(ValueError):
        models.load("nothing")


def test_global_rank_is_gapless(spark, tmp_path):
    rows = spark.range(1000).withColumn("c", F.col("id") % 7)
    ranked = relational.global_rank(rows, [F.desc("c"), F.col("id")], str(tmp_path / "r")).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 1001))
    order = [r.id for r in sorted(ranked, key=lambda r: r["rank"])]
    assert order == sorted(range(1000), key=lambda i: (-(i % 7), i))


def test_validity_traps(spark):
    rows = spark.createDataFrame([(1, "x", None, "1929"), (2, None, "x", None), (3, "X", "y", "1929-01-01")], "id long, source string, title string, date string")
    ids = lambda **k: sorted(r.id for r in rows.where(relational.in_scope(**k)).collect())
    assert ids(newspaper="x") == [1, 2] and ids(date_from="1929-01-01") == [3] and ids(date_to="1929") == [1] and ids() == [1, 2, 3]
    assert chunking.ARTICLES.startswith("newspaper_id")
