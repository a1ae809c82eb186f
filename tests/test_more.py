import pytest
from pyspark.sql import functions as F

from lectern.functions.text import json_digest, lexical_digest
from lectern.operators import alignment, chunking, relational, shards, vectors
from lectern.plans import proposals
from lectern.plans.curation import Conflict, Curation
from lectern.plans.ledger import Archive, StaleInput


def test_digests(spark):
    rows = [("Tí\"tle", "a\nb\\ ]"), (None, "x/y")]
    got = spark.createDataFrame(rows, "t string, c string").select(lexical_digest(F.col("t"), F.col("c")).alias("d")).collect()
    assert [r.d for r in got] == [json_digest([t or "", c]) for t, c in rows]


@pytest.mark.parametrize("text,tokens,spans", [("A b.", ["A", "b", "."], [(0, 1), (2, 3), (3, 4)]), ("xy &amp; y", ["xy", "&", "y"], [(0, 2), (3, 8), (9, 10)]), ("J\x03. a", ["J.", "a"], [(0, 3), (4, 5)]), ("co\xadop", ["co-op"], [(0, 5)]), ("&eacute;", ["&eacute;"], [(0, 8)])])
def test_alignment(text, tokens, spans):
    assert alignment.align(tokens, text) == spans


@pytest.mark.parametrize("text,tokens", [("ab c", ["ab"]), ("a b", ["ab"]), ("ab", ["b"]), ("", ["x"])])
def test_alignment_covers_all(text, tokens):
    with pytest.raises(ValueError):
        alignment.align(tokens, text)


def test_subwords_and_highlights(spark):
    p = lambda w, a, b, label, s=1.0: {"word_id": w, "start": a, "end": b, "label": label, "score": s}
    found = alignment.words_of_subwords([p(0, 0, 2, "B-PER", 0.5), p(0, 2, 4, "I-LOC"), p(1, 5, 8, "I-PER"), p(2, 9, 12, "O"), p(3, 13, 15, "B-LOC"), p(4, 16, 18, "B-LOC")])
    assert found == [{"start": 0, "end": 8, "label": "PER", "score": 0.75}, {"start": 13, "end": 15, "label": "LOC", "score": 1.0}, {"start": 16, "end": 18, "label": "LOC", "score": 1.0}]
    assert alignment.highlight("a <b> c", [{"start": 2, "end": 5, "label": "X"}], 0, 7) == 'a <mark title="X">&lt;b&gt;</mark> c'
    shape = "article_id long, char_start int, char_end int, label string"
    left, right = spark.createDataFrame([(1, 0, 2, "PER"), (2, 0, 1, "LOC")], shape), spark.createDataFrame([(1, 0, 3, "PER"), (2, 0, 1, "LOC")], shape)
    assert [tuple(r) for r in alignment.disagreements(left, right, ["PER", "LOC"]).collect()] == [(1, 1, 1)]
    assert "<mark" in alignment.report_page(spark.createDataFrame([(1, "Ana")], "article_id long, content string"), left, right, ["PER"])
    runs = spark.createDataFrame([("a", 1.0, 10, 1), ("a", 3.0, 10, 2)], "model string, seconds double, articles long, run_id long")
    assert alignment.run_summary(runs).first()["articles_a_second"] == 5.0


def test_token_id_windows():
    encode, decode = lambda t: [ord(c) for c in t], lambda x: "".join(map(chr, x))
    assert chunking.token_id_windows("abcdefg", encode, decode, 4, 1) == ["abcd", "defg"]
    assert chunking.token_id_windows("", encode, decode) == []


def test_shards(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"))
    (tmp_path / "a").mkdir()
    make = lambda ids: spark.createDataFrame([(c, c[:1], "h", [1.0, 2.0]) for c in ids], "chunk_id string, article_id string, text_sha256 string, embedding array<float>")
    config = {"model": "m", "dimensions": 2}
    assert shards.append_vectors(archive, make(["m1", "m2", "m3"]), config, 2) == 3
    assert shards.append_vectors(archive, make(["a1", "m1", "z9"]), config, 2) == 2
    vectors_ = archive.read("vector_shards", shards.VECTORS)
    assert [r.chunk_id for r in vectors_.orderBy("vector_id").collect()] == ["m1", "m2", "m3", "a1", "z9"]
    chunks = make(["a1", "m1", "m2", "m3", "z9"])
    assert {r.problems for r in shards.id_proof(vectors_, chunks).collect()} == {0}
    assert sum(r.problems for r in shards.id_proof(vectors_, make(["a1", "q"])).collect()) == 5
    name = shards.freeze(archive, config)
    assert shards.freeze(archive, config) == name and shards.open_generation(archive, name, config).count() == 5
    with pytest.raises(StaleInput):
        shards.open_generation(archive, name, {"model": "other"})
    with pytest.raises(StaleInput):
        shards.append_vectors(archive, chunks, {"model": "other"}, 2)
    assert shards.chunk_ids(vectors_, spark, [4, 9, 0]) == ["z9", None, "m1"]


def test_vector_bytes(spark):
    row = spark.createDataFrame([([1.0, -2.5],)], "v array<float>").select(vectors.encode(F.col("v")).alias("b")).select(vectors.decode_float32(F.col("b")).alias("v")).first()
    assert row.v == [1.0, -2.5]
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(vectors.normalize(F.col("v")).alias("n")).first()
    assert zero.n is None
    with pytest.raises(ValueError):
        vectors.query_vector([0, 0])


def test_proposals(spark, tmp_path):
    store = Curation(tmp_path / "c.db")
    names = spark.createDataFrame([("filharmonija", 50, "F"), ("fi1harmonija", 2, "f"), ("filharmonije", 3, "f"), ("drugo", 9, "d")], "normalized_name string, article_count long, name string")
    task = proposals.prepare(store, names, "Filharmonija")
    assert set(task.candidates) == {"fi1harmonija", "filharmonije"} and len(task.fingerprint) == 64
    say = lambda **d: {"preferred_name": "Filharmonija", "decisions": [{"name": n, "decision": v, "reason": "so", "evidence_ids": []} for n, v in d.items()]}
    with pytest.raises(ValueError):
        proposals.review(task, say(fi1harmonija="include"))
    with pytest.raises(ValueError):
        proposals.apply(store, task, say(fi1harmonija="needs_evidence", filharmonije="include"), operation_id="1", actor="me")
    members = spark.createDataFrame([("fi1harmonija", 1, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", 0)], "normalized_name string, article_id long, content_sha256 string, char_start int")
    articles = spark.createDataFrame([(1, "abc", "Daily", "1934-01")], "article_id long, content string, source string, date string")
    asked = proposals.with_evidence(task, ["fi1harmonija"], members, articles)
    assert asked.evidence["fi1harmonija"][0]["passage"] == "abc"
    assert proposals.autonomous(store, names, task, say(fi1harmonija="include", filharmonije="include"), operation_id="a") is None
    done = proposals.apply(store, task, say(fi1harmonija="include", filharmonije="exclude"), operation_id="2", actor="me")
    assert store.group(done["group_id"])["members"] == ["fi1harmonija", "filharmonija"] and store.is_rejected("filharmonija", "filharmonije")
    with pytest.raises(Conflict):
        proposals.apply(store, task, say(fi1harmonija="include", filharmonije="exclude"), operation_id="3", actor="me")
    assert [r["action"] for r in proposals.training_rows(store)] == ["create", "reject"]
    other = Curation(tmp_path / "d.db")
    fresh = proposals.prepare(other, names, "filharmonija")
    assert proposals.autonomous(other, names, fresh, say(fi1harmonija="include", filharmonije="uncertain"), operation_id="b")["revision"] == 1


def test_cumulative_and_samples(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    picked = sorted(r.k for r in relational.spaced_sample(rows, "k", 100, 7).collect())
    assert picked == sorted({int(i * (99 / 6)) for i in range(7)})
    assert relational.hash_sample(rows, "k", 5).collect() == relational.hash_sample(rows.repartition(3), "k", 5).collect()
    a, b = relational.fingerprint(rows, "k").first(), relational.fingerprint(rows.repartition(4), "k").first()
    assert a == b and relational.fingerprint(rows.limit(99), "k").first() != a
