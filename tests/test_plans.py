import collections
import io
import json
import pickle
import sys
import types
import urllib.request
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import alignment, entities, lexical, quantize, relational, requests
from lectern.plans import baseline, jobs, migrations, projection, runlog
from lectern.plans.curation import Conflict, Curation
from lectern.plans.ledger import Archive, StaleInput
from lectern.sources import tensors

# embedding files


class _Float:
    pass


def torch_file(vectors_by_path, kind="FloatStorage", dtype="<f4"):
    """Bytes as PyTorch would write them, all vectors in one storage."""
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    storage = type(kind, (), {"__module__": "torch", "__qualname__": kind})
    setattr(torch, kind, storage)

    def rebuild(*args):
        raise AssertionError

    rebuild.__module__, rebuild.__qualname__, rebuild.__name__ = "torch._utils", "_rebuild_tensor_v2", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = rebuild
    whole = np.concatenate(list(vectors_by_path.values())).astype(dtype)

    class Vector:
        def __init__(self, at, n):
            self.at, self.n = at, n

        def __reduce__(self):
            return rebuild, (_Float(), self.at, (self.n,), (1,), False, collections.OrderedDict())

    class Pickler(pickle.Pickler):
        def persistent_id(self, found):
            return ("storage", storage, "0", "cpu", len(whole)) if isinstance(found, _Float) else None

    sys.modules["torch"], sys.modules["torch._utils"] = torch, utils
    try:
        out, at, held = io.BytesIO(), 0, {}
        for path, v in vectors_by_path.items():
            held[path] = Vector(at, len(v))
            at += len(v)
        Pickler(out, 2).dump(held)
    finally:
        del sys.modules["torch"], sys.modules["torch._utils"]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("batch/data.pkl", out.getvalue())
        z.writestr("batch/data/0", whole.tobytes())
    return packed.getvalue()


def test_torch_files_are_read_without_torch(spark, tmp_path):
    rng = np.random.default_rng(1)
    files = [{f"{k}/{i}.md": rng.normal(size=8) for i in range(5)} for k in range(3)]
    for k, rows in enumerate(files):
        (tmp_path / f"b{k}.pt").write_bytes(torch_file(rows, *(("FloatStorage", "<f4"), ("HalfStorage", "<f2"), ("DoubleStorage", "<f8"))[k]))
    (tmp_path / "other.bin").write_bytes(b"no")
    got = tensors.read_embeddings(spark, str(tmp_path)).orderBy("file", "place").collect()
    assert [r.path for r in got] == [p for rows in files for p in rows]
    assert np.allclose([r.embedding for r in got], [v for rows in files for v in rows.values()], atol=2e-3)

    class Evil:
        def __reduce__(self):
            return print, ("never",)

    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("a/data.pkl", pickle.dumps({"x": Evil()}, 2))
    with pytest.raises(pickle.UnpicklingError):
        tensors.load(bad.getvalue())


# remote jobs


class Service:
    """A client that answers from memory; ``break_at`` makes the n-th call fail."""

    def __init__(self, break_at=None):
        self.files, self.jobs, self.calls, self.break_at = {}, {}, [], break_at

    def _called(self, name):
        self.calls.append(name)
        if len(self.calls) == self.break_at:
            raise ConnectionError("gone")

    def upload(self, name, content):
        self._called("upload")
        self.files[f"f{len(self.files)}"] = content
        return f"f{len(self.files) - 1}"

    def create(self, file_id, metadata):
        self._called("create")
        self.jobs[f"j{len(self.jobs)}"] = file_id
        return f"j{len(self.jobs) - 1}"

    def status(self, job_id):
        out = []
        for line in self.files[self.jobs[job_id]].decode().splitlines():
            body = json.loads(line)
            data = [{"index": i, "embedding": [float(len(x)), 1.0]} for i, x in enumerate(body["body"]["input"])]
            out.append(json.dumps({"custom_id": body["custom_id"], "response": {"status_code": 200, "body": {"data": data}}}))
        self.files[f"o{job_id}"] = "\n".join(out).encode()
        return {"status": "completed", "output_file_id": f"o{job_id}", "error_file_id": None}

    def download(self, file_id):
        return self.files[file_id]


def test_jobs_are_submitted_once_polled_and_collected(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * (i % 9 + 1)) for i in range(50)], "id long, text string")
    packed = requests.pack_requests(rows, "id", "text", 4, 1000)
    work = jobs.Jobs(tmp_path / "jobs")
    assert work.prepare(rows, packed, "id", "text", "m", most_requests=5) == 3
    with pytest.raises(StaleInput):
        work.prepare(rows, packed, "id", "text", "m")
    broken = Service(break_at=2)  # the upload is done, the job isn't made
    with pytest.raises(ConnectionError):
        work.submit(broken)
    broken.break_at = None
    assert work.submit(broken, most_open=2) == 2 and broken.calls.count("upload") == 2
    assert work.poll(broken) == {"completed": 2, "prepared": 1} and work.fetch(broken) == 2
    part = {r.id: r for r in work.collect(packed, "id").collect()}
    assert sum(r.embedding is None for r in part.values()) == 10 and {r.error for r in part.values()} == {None, "no result"}
    assert work.submit(broken) == 1 and work.poll(broken) == {"completed": 3} and work.fetch(broken) == 1 and work.fetch(broken) == 0
    got = {r.id: list(r.embedding) for r in work.collect(packed, "id").collect()}
    assert got == {i: [float(i % 9 + 1), 1.0] for i in range(50)}
    state = work.state()
    state[0] |= {"status": "expired", "output": None}
    work._save(state)
    assert work.retry() == 1 and work.submit(broken) == 1
    (work.folder / state[1]["file"]).write_text("changed")
    state = work.state()
    state[1]["job_id"] = None
    work._save(state)
    with pytest.raises(StaleInput):
        work.submit(broken)


def test_rest_client_speaks_http():
    seen = []

    class Reply(io.BytesIO):
        pass

    def opener(request: urllib.request.Request, timeout):
        seen.append((request.method, request.full_url, request.data, request.headers))
        return Reply(b'{"id": "x", "status": "completed"}' if "content" not in request.full_url else b"lines")

    client = jobs.RestClient("https://host/v1/", "key", opener)
    assert (client.upload("a.jsonl", b"{}"), client.create("f", {"k": "v"}), client.status("j")["status"], client.download("f")) == ("x", "x", "completed", b"lines")
    assert [(m, u) for m, u, *_ in seen] == [("POST", "https://host/v1/files"), ("POST", "https://host/v1/batches"), ("GET", "https://host/v1/batches/j"), ("GET", "https://host/v1/files/f/content")]
    assert b'filename="a.jsonl"' in seen[0][2] and json.loads(seen[1][2])["input_file_id"] == "f" and seen[2][3]["Authorization"] == "Bearer key"


# logs, measures and batches


def test_journals_tell_ended_runs_from_failed_and_cut_ones(spark, tmp_path):
    path = tmp_path / "log" / "events.jsonl"
    with runlog.index_run(path, "surface", articles=3) as journal:
        journal.write("progress", done=1)
    with pytest.raises(RuntimeError), runlog.index_run(path, "lemma"):
        raise RuntimeError("no model")
    runlog.Journal(path, "cut").write("index_started", index="x")
    with path.open("a") as f:
        f.write('{"timestamp": "half a li')
    events = runlog.read_journal(spark, path)
    assert [r.event for r in events.collect()] == ["index_started", "progress", "index_finished", "index_started", "failed", "index_started"]
    assert [r.run_id for r in runlog.interrupted(events).collect()] == ["cut"]
    assert "no model" in events.where("event = 'failed'").first().details


def test_models_are_measured(spark):
    runs = runlog.measure(lambda texts: [t.upper() for t in texts], ["two words"] * 40, (1, 16), 2)
    assert len(runs) == 4 and all(r["documents"] == 40 and r["tokens"] == 80 and r["peak_mb"] > 1 for r in runs)
    found = alignment.throughput(spark.createDataFrame(runs), ["batch"]).collect()
    assert {r.batch for r in found} == {1, 16} and all(r.runs == 2 and r.documents_a_second > 0 for r in found)
    with pytest.raises(ValueError):
        runlog.measure(lambda texts: texts[:1], ["a", "b"], (2,), 1)


@pytest.mark.parametrize("depth", [1, 3])
def test_batches_are_staged_in_order_and_coalesced(depth):
    def reader(sizes):
        left = iter(sizes)
        return lambda: list(range(next(left, 0)))

    got = list(runlog.staged(reader([3, 2, 4]), lambda r: r, lambda r: [x * 2 for x in r], depth))
    assert [len(r) for r, _ in got] == [3, 2, 4] and got[0][1] == [0, 2, 4]
    assert [len(r) for r, _ in runlog.coalesced(got, 4)] == [4, 4, 1] and list(runlog.coalesced(got, 0)) == got
    with pytest.raises(ZeroDivisionError):
        list(runlog.staged(reader([3]), lambda r: 1 / 0, lambda r: r, depth))
    with pytest.raises(ValueError):
        list(runlog.coalesced([([1], [])], 1))


# quantised vectors


def test_quantised_search_finds_near_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 32))[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 32)) * 0.3
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    c = quantize.Config(32, cells=16, parts=8, probes=6, bits=6)
    root = str(tmp_path / "index")
    name = quantize.build(rows.where("vec_id < 1500"), "vec_id", "embedding", c, root)
    assert quantize.build(rows, "vec_id", "embedding", c, root) == name
    index, (_, books) = quantize.open_index(spark, root), quantize.load(root)
    assert index.count() == index.select("vec_id").distinct().count() == 2000
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = []
    for q in (3, 700, 1999):
        want = set(np.argsort(-(unit @ unit[q]))[:10].tolist())
        got = [r.vec_id for r in quantize.search(index, books, rows, unit[q].tolist(), c, "vec_id", "embedding", 10).collect()]
        hits.append(len(want & set(got)) / 10)
    assert np.mean(hits) >= 0.9
    cell, code = books.encode(unit)
    assert np.linalg.norm(books.decode(cell, code) - unit, axis=1).mean() < np.linalg.norm(books.centres[cell] - unit, axis=1).mean()
    for bad in (dict(dimensions=30, parts=8), dict(dimensions=32, bits=9), dict(dimensions=32, cells=4, probes=5)):
        with pytest.raises(ValueError):
            quantize.Config(**bad)
    with pytest.raises(ValueError):
        quantize.fit(rows.limit(5), "vec_id", "embedding", c)
    with pytest.raises(ValueError):
        quantize.build(rows, "vec_id", "embedding", quantize.Config(32, cells=8, parts=8), root)


# audits, adoption, migration, projection


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("audited")
    archive = Archive(spark, str(root))
    text = "# One\nAna Novak met Marija Kos. And more words here.\n\n# Two\nNothing else happens in this one."
    batch = spark.createDataFrame([(f"p/{i}.md", text + f"\nEnd {i}.", None, None, None) for i in range(4)], "relative_path string, content string, metadata_json string, metadata_sha256 string, error string")
    archive.run(batch, "b", count=5, overlap=1)
    articles = archive.read("articles", baseline_schema("ARTICLES")).withColumn("is_valid", F.lit(1))
    chunks = archive.read("chunks", baseline_schema("CHUNKS"))
    index_path = str(root / "index")
    lexical.build_index(articles, index_path, "article_id", "title", "content")
    mentions = entities.extract(articles.withColumn("article_id", F.xxhash64("article_id")))
    keyed = articles.withColumn("article_id", F.xxhash64("article_id"))
    done = entities.completions(keyed, mentions)
    ranked = relational.global_rank(chunks.select("chunk_id", "article_id", "text"), [F.col("chunk_id")], str(root / "ranks"))
    vecs = ranked.select((F.col("rank") - 1).alias("vector_id"), "chunk_id", "article_id", baseline.content_digest("text").alias("text_sha256"), F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>").alias("embedding"))
    return archive, articles, keyed, chunks, index_path, mentions.cache(), done.cache(), vecs.cache()


def baseline_schema(name):
    from lectern.operators import chunking

    return getattr(chunking, name)


def test_sound_stages_have_no_problems_and_broken_ones_do(spark, stages):
    archive, articles, keyed, chunks, index_path, mentions, done, vecs = stages
    names, members = entities.dictionary(mentions, done)
    documents = spark.read.parquet(f"{index_path}/documents")
    sound = [baseline.audit_corpus(archive), baseline.audit_lexical(documents, articles), baseline.audit_vectors(vecs, chunks, 2), baseline.audit_mentions(mentions, done, keyed), baseline.audit_dictionary(names, members, mentions, done)]
    assert baseline.problems(sound) == {s: {} for s in baseline.STAGES}
    bad = [
        baseline.audit_lexical(documents.where("size > 9").withColumn("size", F.col("size") + 1), articles),
        baseline.audit_vectors(vecs.where("vector_id != 2").withColumn("embedding", F.array(F.lit(1.0), F.lit(1.0))), chunks, 2),
        baseline.audit_mentions(mentions.withColumn("char_start", F.col("char_start") + 1), done.limit(2), keyed.withColumn("content", F.concat("content", F.lit("!")))),
        baseline.audit_dictionary(names.withColumn("article_count", F.col("article_count") + 1), members.where("char_start < 5"), mentions, done),
    ]
    found = baseline.problems(bad)
    assert set(found["lexical"]) >= {"articles that aren't indexed", "documents of another length"}
    assert set(found["vectors"]) >= {"chunks without a vector", "vectors that aren't at length 1", "vector ids outside 0..n-1"}
    assert set(found["mentions"]) >= {"articles that weren't looked at", "completions of another text", "mentions that aren't in the text", "mentions without a completion"}
    assert set(found["dictionary"]) >= {"memberships that are missing", "names of another count"}


def test_adoption_and_reuse(stages):
    archive, articles, keyed, chunks, index_path, mentions, done, vecs = stages
    audit = baseline.audit_vectors(vecs, chunks, 2)
    report = baseline.adopt(archive, "vectors", audit, {"model": "m"})
    assert baseline.adopt(archive, "vectors", audit, {"model": "m"}) == report and baseline.adopted(archive, "vectors", {"model": "m"}) and not baseline.adopted(archive, "vectors", {"model": "n"})
    for call in (lambda: baseline.adopt(archive, "vectors", audit, {"model": "n"}), lambda: baseline.adopt(archive, "vectors", baseline.audit_vectors(vecs.limit(1), chunks, 2), {})):
        with pytest.raises(StaleInput):
            call()
    with pytest.raises(ValueError):
        baseline.adopt(archive, "mentions", audit, {})
    calls = []

    def audits(broken=()):
        made = lambda s: lambda: (calls.append(s), baseline.counted(s, {"x": articles if s in broken else articles.limit(0)}))[1]
        return {s: made(s) for s in ("articles", "lexical", "vectors")}

    inputs = {"articles": {"n": 1}, "lexical": {"n": 1}, "vectors": {"n": 1}}
    assert set(baseline.audit_once(archive, audits(), inputs).values()) == {"passed"} and set(baseline.audit_once(archive, audits(), inputs).values()) == {"reused"}
    calls.clear()
    assert baseline.audit_once(archive, audits(), inputs | {"lexical": {"n": 2}}) == {"articles": "reused", "lexical": "passed", "vectors": "passed"} and calls == ["lexical", "vectors"]
    with pytest.raises(StaleInput):
        baseline.audit_once(archive, audits(("vectors",)), inputs)


def test_tables_are_migrated_step_by_step(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(5).write.parquet(folder)
    one, two = (lambda df: df.withColumn("a", F.col("id") + 1)), (lambda df: df.withColumnRenamed("a", "b"))
    with pytest.raises(ValueError):
        migrations.read(spark, folder, [one])
    assert migrations.migrate(spark, folder, [one]) == 1 and migrations.migrate(spark, folder, [one, two]) == 2 and migrations.migrate(spark, folder, [one, two]) == 2
    assert migrations.read(spark, folder, [one, two]).columns == ["id", "b"]
    for steps in ([one], [one, two, lambda df: df.limit(1)]):
        with pytest.raises(ValueError):
            migrations.migrate(spark, folder, steps)


def test_joint_projection(spark, tmp_path):
    rng = np.random.default_rng(5)
    make = lambda n, model="m": spark.createDataFrame([(i, rng.normal(size=6).tolist(), model) for i in range(n)], "id long, embedding array<double>, model string")
    a, b = make(30), make(20)
    staged = projection.project_together({"a": a, "b": b}, str(tmp_path / "p"))
    assert staged.count() == 50 and staged.columns == ["source", "id", "x", "y", "z"]
    rows = spark.range(20).select("id", *[F.lit(None).cast("double").alias(c) for c in "xyz"])
    assert projection.take(rows, staged, "b").where("x is null").count() == 0
    with pytest.raises(StaleInput):
        projection.project_together({"a": a, "b": make(3, "other")}, str(tmp_path / "q"))
    with pytest.raises(StaleInput):
        projection.take(rows.union(spark.createDataFrame([(99, None, None, None)], rows.schema)), staged, "b")


# smaller pieces


def test_chains_and_circles_of_redirects(spark, tmp_path):
    redirects = [(i, i - 1) for i in range(1, 100)] + [(i, i - 1) for i in range(1001, 1140)] + [(200, 201), (201, 202), (202, 200), (300, 200)]
    groups = spark.createDataFrame([(i,) for i in (0, 1, 50, 99, 1100, 1101, 1139, 200, 201, 300, 7777)], "group_id long")
    got = {r.group_id: r.canonical_id for r in entities.resolve_redirects(groups, spark.createDataFrame(redirects, "old long, new long"), str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 50: 0, 99: 0, 1100: 1000, 1101: None, 1139: None, 200: None, 201: None, 300: None, 7777: 7777}
    identity = groups.select("group_id", F.col("group_id").alias("canonical_id"))
    assert {r.group_id: r.canonical_id for r in identity.collect()} != got


def test_groups_are_retired_and_returned(tmp_path):
    store = Curation(tmp_path / "c.db")
    change = lambda action, **p: store.mutate(action, p, operation_id=f"{action}{store.revision}", actor="me")
    a, b = (change("create", preferred=p, members=m)["group_id"] for p, m in (("A", ["a", "aa"]), ("B", ["b"])))
    change("retire", group_id=a, into=b)
    assert store.canonical(a) == b and store.group(a)["preferred"] == "B" and store.membership("aa") is None
    change("return", group_id=a)
    assert store.canonical(a) == a and store.group(a)["members"] == ["a", "aa"]
    change("retire", group_id=a)
    change("update", group_id=b, members=["b", "aa"])
    with pytest.raises(Conflict):
        change("return", group_id=a)
    store.db.execute("INSERT INTO redirects VALUES ('x', 'y'), ('y', 'x')")
    with pytest.raises(Conflict):
        store.canonical("x")


def test_an_index_tells_what_isn_t_one(spark, tmp_path):
    docs = spark.createDataFrame([(1, "t", "needle here"), (2, None, "hay")], "doc_id long, title string, text string")
    index = lexical.build_index(docs, str(tmp_path / "i"))
    assert (index.rows, index.tokens) == (2, 4)
    spark.range(1).write.parquet(str(tmp_path / "j/postings"))
    for t in ("documents", "dropped"):
        docs.write.parquet(str(tmp_path / f"j/{t}"))
    with pytest.raises(ValueError):
        lexical.open_index(spark, str(tmp_path / "j"))
    plan = lexical.bm25(index, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "here" not in plan and "text_tokens" not in plan


def test_patterns_that_both_engines_read_alike(spark):
    docs = spark.createDataFrame([(1, "é ab12"), (2, "AB"), (3, None), (4, "xx ab"), (5, "日本 \U0001f600ab")], "doc_id long, text string")
    for pattern in ("ab[0-9]*", "(a|x)b{1,2}", "[^a-z ]b", r"a\w", "a.", "x??b", "^x"):
        import re

        want = [(i, m.start()) for i, t in ((r.doc_id, r.text) for r in docs.collect()) if t and (m := re.search(pattern, t))]
        assert [(r.doc_id, r.focus) for r in lexical.regex_search(docs, pattern, 10).collect()] == want, pattern
    assert [r.doc_id for r in lexical.regex_search(docs, "ab", 10, ignore_case=True).collect()] == [1, 2, 4, 5]


def test_built_in_keys_equal_the_plain_ones(spark):
    values = ["  Red\tWidget \x1f x ", "ZÜRICH straße", "l0rn 1", "", "a-b_c", "ǅ ﬁ é", "\x0b\x0c"]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    for column, plain in ((T.normalize_name_col, T.normalize_name), (T.comparison_key_col, T.comparison_key), (T.ocr_key_col, T.ocr_key), (T.letters_signature_col, T.letters_signature), (T.ocr_signature_col, T.ocr_signature)):
        assert [r.x for r in rows.select(column("v").alias("x")).collect()] == [plain(v) for v in values] + [None]


def test_staged_values_must_be_meant(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, a string, n int")
    staged = spark.createDataFrame([(2, None)], "id long, a string")
    assert [tuple(r) for r in relational.apply_staged(rows, staged, "id", ["a"]).orderBy("id").collect()] == [(1, "a", 1), (2, None, 2)]
    for bad in ([(9, "x")], [(1, "x"), (1, "y")]):
        with pytest.raises(ValueError):
            relational.apply_staged(rows, spark.createDataFrame(bad, "id long, a string"), "id", ["a"])


def test_requests_don_t_depend_on_splits(spark):
    rows = spark.createDataFrame([(i, "é" * (i % 50)) for i in range(500)], "id long, text string")
    got = [sorted(map(tuple, requests.pack_requests(rows.repartition(k), "id", "text", 7, 300, 100).collect())) for k in (1, 9)]
    assert got[0] == got[1]


def test_discovery_needs_a_query(spark):
    names = spark.createDataFrame([("ana novak", 3)], "normalized_name string, article_count long")
    groups = spark.createDataFrame([], "group_id string, preferred string, article_count long")
    members = spark.createDataFrame([], "name string, group_id string")
    for bad in ("ab", "a*b*", "[abc]", "x" * 201):
        with pytest.raises(ValueError):
            entities.discover(names, groups, members, bad)
    assert [r.name for r in entities.discover(names, groups, members, "ana novik").collect()] == ["ana novak"]


def test_short_passages_and_those_without_spaces_are_found(spark, monkeypatch):
    from lectern.plans import catalogue

    texts = ["a long enough passage of some words, told twice", "short", "nospacesatallinthisratherlongpassage", "日本語の文章です", "x y", "not there", "", None]
    docs = [(0, f"Before {texts[0]}. {texts[1]}"), (1, f"in{texts[2]}side {texts[3]}"), (2, "axx yb short"), (3, None)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((i, sum(t in d for _, d in docs if d), min(k for k, d in docs if d and t in d)) for i, t in enumerate(texts) if t is not None and any(t in d for _, d in docs if d))
    for some in (1000, 2):
        monkeypatch.setattr(catalogue, "PASSAGES_A_PASS", some)
        assert sorted(map(tuple, catalogue._contained(frame, rows).collect())) == want
