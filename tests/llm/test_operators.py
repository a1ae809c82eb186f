"""Each operator against a plain version, over nulls, empty and long texts, ties, repeats and no rows."""

import base64
import collections
import hashlib
import io
import json
import random
import tracemalloc
import zlib

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, exact_dedup, langid, lm, mixing, packing, queries, repeats, secrets, warc
from lectern.llm._common import prefix_hash

RNG = random.Random(5)
LETTERS = [chr(c) for c in range(97, 123)] + list("éßñ")


def prose(n):
    return " ".join("".join(RNG.choices(LETTERS, k=RNG.randint(1, 9))) for _ in range(n))


PASSAGE, OTHER = prose(60), prose(45)
LONG = prose(20_000)
ROWS = [
    (0, None, "en", "a"), (1, "", None, "a"), (2, " \t\n", "de", None), (3, PASSAGE, "en", "a"), (4, prose(30) + " " + PASSAGE + " " + prose(20), "en", "b"),
    (4, "a repeated row", "en", "a"), (4, "a repeated row", "en", "a"), (None, PASSAGE[:250] + OTHER, None, None), (None, None, None, None),
    (7, "x" * 450, "en", "a"), (8, "y" * 199 + "é", "en", "a"), (9, "y" * 199 + "é", "en", "a"), (10, OTHER + PASSAGE, "fr", "c"), (11, "A  B\tC", "en", "a"), (12, "A B C", "en", "a"),
    (13, LONG, "fr", "c"), (14, LONG[:50_000] + "!" + LONG[50_000:90_000], "fr", "c"), (15, "émile " * 3000, "fr", "a"), (16, "123 !? 456", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return rows.select("*", *[F.lit(None).cast("int").alias(c) for c in ("h", "w", "norm", "prefix", "block", "spans", "blob_id", "row_id", "fp", "kept")])


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


# 1: repeats


@pytest.mark.parametrize("hot,shard,batch", [(20_000, 1 << 18, 1 << 20), (1, 1 << 18, 1 << 20), (20_000, 300, 900)])
def test_repeats(docs, hot, shard, batch):
    got = repeats.remove_repeats(docs, hot_runs=hot, shard_bytes=shard, batch_bytes=batch).collect()
    want = [(r[0], *x) for r, x in zip(ROWS, brute.repeats([r[1] for r in ROWS]))]
    assert ordered(map(tuple, got)) == ordered(want)


def test_repeats_within_one_text_and_long_texts(spark):
    texts = [PASSAGE + "1" + PASSAGE + "2" + PASSAGE[:150], PASSAGE[:320] + "z" + PASSAGE[321:], "", "ab" * 400]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_text=True).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute.repeats(texts) and hashlib.sha256(got[0].kept).hexdigest() == got[0].kept_sha256
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    data = np.frombuffer(LONG.encode(), np.uint8)
    offsets = np.array([0, 70_000, 70_010, len(data)])
    whole = repeats.anchors(data, offsets)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 9_000)
    parts = repeats.anchors(data, offsets)
    windows = lambda x: {(int(h), int(a), s) for h, a, f, e in zip(x[0], *x[2:]) for s in range(f, e + 1)}
    assert windows(whole) == windows(parts) and windows(whole)


def test_transforms_merge_to_the_order_of_all_suffixes():
    rng = random.Random(1)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(40)]
    strings += strings[:5]
    runs = repeats.Runs(strings, 4)
    cuts = [0, *runs.starts[[7, 8, 30]].tolist(), len(runs.owner)]
    places, differs = repeats.merge(runs, cuts, 5)
    assert sorted(places.tolist()) == list(range(len(runs.owner)))
    start = lambda p: strings[runs.owner[p]][p - runs.starts[runs.owner[p]] :][:20]
    full = [i for i, p in enumerate(places) if len(start(p)) == 20]
    groups = np.cumsum(differs)
    by = collections.defaultdict(set)
    for i in full:
        by[groups[i]].add(start(places[i]))
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({start(places[i]) for i in full})


# 3: languages


def test_languages(spark):
    words = {"en": "the of and to house tree with river".split(), "fr": "le la est dans maison arbre avec été".split(), "de": "der die und nicht haus baum mit größe".split()}
    say = lambda lang, n: " ".join(RNG.choices(words[lang], k=n))
    rows = [(i, say(lang, 40), lang) for i, lang in enumerate(list(words) * 40)]
    extra = [(1000, None, "en"), (1001, "12 !?", "en"), (1002, "", None), (1003, say("en", 60) + " " + say("fr", 30), None), (None, say("de", 30), None), (1004, say("fr", 3000), None)]
    found = langid.identify(spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + len(extra)
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang in rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "en", "de", "fr"]
    assert 0.55 < got[1003].score < 0.8 and {x.lang for x in got[1003].languages} == {"en", "fr"}
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_languages_of_odd_rows(spark, docs):
    assert len(langid.identify(docs).collect()) == len(ROWS)
    nothing = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(nothing).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0)).count() == 0
    assert langid.keep_identified(docs).columns == docs.columns


# 4: WARC

PAGES = [(3, "http://a/é", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u\r\nv", ""), (5, "x", None), (7, "y", "z" * 200_000), (None, "n", "<p>é</p>"), (8, "r", "same"), (8, "r", "same"), (9, "s", "same")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("size", F.lit(1)).repartition(3)
    files = warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(files, with_html=True).collect()
    first = {"<p>é</p>": 1, "": 2, "z" * 200_000: 7, "same": 8}
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        revisit = i != first[html or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    assert ordered(tuple(r)[:5] for r in got) == ordered(want)
    assert all(r.html == dict((i, h or "") for i, _, h in PAGES)[r.page_id] for r in got if r.record_type == "response")
    assert warc.round_trip(pages.limit(0)).count() == 0
    big = warc.write_archives(pages, str(tmp_path / "big"), revisit_min_bytes=5)
    assert {r.page_id for r in warc.read_archives(big).collect() if r.record_type == "revisit"} == {3, None}


def test_warc_framing_is_verified():
    good = warc.page_record(1, "u", b"hello", warc.digest(b"hello"), 5, None, 6)
    ((headers, block),) = warc.records(io.BytesIO(good))
    assert block.endswith(b"hello") and headers["warc-type"] == "response"
    bad = warc.record([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:" + warc.digest(b"x"))], b"y")
    for data in (bad, good[:-10], b"plain"):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(data)))
    assert len(list(warc.records(io.BytesIO(good * 3)))) == 3


# 5: secrets

SECRET = "é password = 'abcdefghijklmnop' token:short AKIA" + "Z" * 14 + " deadbeefdeadbeef0 API_KEY=\"0123456789abcdef\" x"


def test_secrets_and_the_ledger(spark, tmp_path, docs):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, SECRET, 0), (2, None, 1), (3, SECRET, 2), (3, SECRET, 2), (None, "", 3)], "doc_id long, text string, spans int")
    rows = secrets.report(secrets.scan(first, path)).collect()
    assert len(rows) == 5
    by = {r.doc_id: r for r in rows}
    spans = [x.split(":") for x in by[1].spans.split(",")]
    assert [(k, SECRET[int(a) : int(b)]) for k, a, b in spans] == [("assign", "password = 'abcdefghijklmnop"), ("access", "AKIA" + "Z" * 14), ("hex", "deadbeefdeadbeef0"), ("assign", 'API_KEY="0123456789abcdef'), ("hex", "0123456789abcdef")]
    assert (by[1].n_assign, by[1].n_access, by[1].n_hex) == (2, 1, 2) and by[3].spans == by[1].spans and by[2].spans == ""
    assert by[2].base_sha256 == hashlib.sha256(b"").hexdigest() and by[1].base_sha256 == hashlib.sha256(by[1].spans.encode()).hexdigest()
    assert secrets.read_ledger(spark, path).count() == 2
    secrets.scan(first.limit(3).union(spark.createDataFrame([(9, "new", 0)], first.schema)), path).collect()
    assert secrets.read_ledger(spark, path).count() == 3  # only the new blob was scanned
    other = {k: v for k, v in secrets.RULES.items() if k != "hex"}
    secrets.scan(first, path, rules=other)
    assert secrets.read_ledger(spark, path).count() == 5
    assert secrets.scan_documents(docs).count() == len(ROWS) and secrets.scan_documents(docs.limit(0)).count() == 0


# 6: exact copies


def test_exact_copies(spark, docs):
    norm = lambda t: brute.SPACES.sub(b" ", (t or "").encode())
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[norm(t)].append(i)
    least = {k: min([i for i in v if i is not None], default=None) for k, v in groups.items()}
    want = [(i, least[norm(t)], len(groups[norm(t)]), i == least[norm(t)], hashlib.sha256(norm(t)).hexdigest()) for i, t, *_ in ROWS]
    assert ordered(map(tuple, exact_dedup.exact_groups(docs).collect())) == ordered(want)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(v) for v in least.values())
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_one_text_over_all_partitions(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text").otherwise(F.concat(F.lit("the same text, but "), "id")).alias("text"))
    got = exact_dedup.exact_groups(rows)
    assert got.where("group_size = 2000 and keep_id = 1").count() == 2000 and got.where("group_size = 1 and kept").count() == 1000


# 7: mixing


def test_mixing(spark, docs):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 10 == 1, None).otherwise("large").alias("source"), F.lit(1).alias("copy"))
    mixed = mixing.mix(rows, weights={"small": 0.5, "large": 0.5})
    by = {r.source: r["n"] for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(by) == {"small", "large"} and all(abs(n - 10_000) < 400 for n in by.values())
    assert mixed.where("copy < 1 or copy > copies").count() == 0
    again = mixing.mix(rows.repartition(7), weights={"small": 0.5, "large": 0.5})
    key = ("doc_id", "copy", "mix_key")
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, mixed.select(*key).collect()))
    places = [r.doc_id for r in mixed.collect()]
    assert abs(np.corrcoef(places, range(len(places)))[0, 1]) < 0.05
    heavy = mixing.mix(rows.limit(200), weights={"large": 1.0}, total=20_000)
    assert abs(heavy.count() - 20_000) < 700
    assert mixing.mix(docs).count() >= 0 and mixing.mix(docs.limit(0)).count() == 0


# 8: language model


def test_scores(docs):
    want = brute.unigram([(r[0], r[1]) for r in ROWS])
    got = lm.score(docs).collect()
    number = lambda i, *x: (str(i), *x[:-1], round(x[-1], 6))
    assert sorted(number(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == sorted(number(r[0], *x) for r, x in zip(ROWS, want))


def test_rare_words_are_counted_alike(spark):
    rows = [(i, prose(30) + " of the of the") for i in range(120)]
    frame = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in lm.score(frame).collect()}
    want = {i: x for (i, _), x in zip(rows, brute.unigram(rows + rows[:3]))}
    assert all((got[i].n_known, got[i].n_tokens) == (x[2], x[1]) and abs(got[i].base_score - x[4]) < 1e-6 for i, x in want.items())


def phrase_rows():
    """Texts whose phrases recur in many contexts, a few of them once in each of many texts."""
    rng = random.Random(11)
    vocabulary = [prose(1) + str(i) for i in range(60)]
    fixed = [rng.choices(vocabulary, k=rng.randint(2, 6)) for _ in range(12)]
    texts = []
    for i in range(150):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else [rng.choice(vocabulary)] for _ in range(rng.randint(1, 20))]
        texts.append(" ".join([*sum(parts, []), *(["seldom", "seen", "phrase"] if i % 40 == 1 else []), f"only{i}"]))
    return [*enumerate(texts), (3, texts[3]), (500, ""), (501, None), (None, texts[5]), (777, " \n".join(texts[:40]).upper()), (778, "none of these")]


@pytest.mark.parametrize("parts,more", [(2, {"round_bytes": 0}), (40, {"depth": 1}), (3, {"depth": 2, "bitmap": 10}), (3, {"depth": 5, "block_bytes": 600}), (3, {"least_count": 3, "block_bytes": 5000, "rounds": 2, "round_bytes": 0})])
def test_scores_are_those_of_the_plain_tree(spark, parts, more):
    rows, p = phrase_rows(), lm.TreeParams(**more)
    want, states = brute.suffix_tree(rows, p)
    assert states > 30
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), p).collect()
    found, want = (sorted(x, key=lambda r: (r[0], r[1])) for x in ([(str(r.doc_id), r.score) for r in got], [(str(i), x) for (i, _), x in zip(rows, want)]))
    assert [i for i, _ in found] == [i for i, _ in want] and np.allclose([x for _, x in found], [x for _, x in want], rtol=1e-6, atol=1e-5)
    base = sorted((str(i), *x[:-1], round(x[-1], 5)) for (i, _), x in zip(rows, brute.unigram(rows)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == base


def test_probabilities_after_a_state_add_up():
    rows = [r for r in phrase_rows() if r[0] is not None]
    probability, contexts, vocabulary = brute.suffix_tree(rows, lm.TreeParams(), model=True)
    assert max(map(len, contexts)) == 3
    unseen = probability((), "never seen")
    for context in contexts[:80]:
        rest = probability(context, "never seen") / unseen  # what the state leaves to words that aren't listed
        assert 0 < rest < 1
        assert abs(sum(probability(context, w) for w in vocabulary) + rest * unseen - 1) < 1e-9


def test_no_texts_to_learn_from(spark):
    held = next(i for i in range(100) if lm.held_out(i))
    (row,) = lm.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_are_hashed_in_slices(monkeypatch):
    """Sums over a text's bytes take forty times as much memory, so no more than a slice is summed up at once."""
    texts = [f"Some words, the {i}th time ".encode() * 60 for i in range(40)] + [b"", b" \t", b"x" * 9_000, "wörter und mehr ".encode() * 2_000, b"last"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(lm, "HASHED_BYTES", 1 << 30)
    whole = [lm._hashes(data, offsets, end) for end in (True, False)]
    took = []
    monkeypatch.setattr(lm, "prefix_hash", lambda x: took.append(len(x)) or prefix_hash(x))
    monkeypatch.setattr(lm, "HASHED_BYTES", 5_000)
    for (token, sizes), end in zip(whole, (True, False)):
        again, sizes_again = lm._hashes(data, offsets, end)
        assert (again == token).all() and (sizes_again == sizes).all()
    assert len(took) > 20 and sorted(took)[-2:] == [9_000, 9_000] and sorted(took)[-3] <= 5_010  # but for a long word


def test_a_part_is_added_up_in_little_memory():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(20):
        context = np.sort(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
        rows.append(lm._split(context, [context, rng.integers(1, 1 << 64, 20_000, dtype=np.uint64), np.ones(20_000, np.uint32)], 1, 2))
    rows.append(rows[0])  # so that these came twice
    tracemalloc.start()
    found = list(lm._adder(lm.TreeParams(), 1)(iter(rows)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sum(b.column("n").to_pylist()) for b in found) == 20_000
    assert peak < 420_000 * 80


def test_executors_and_workers_exchange_little_at_once(spark, docs, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    materialize = lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda *x: seen.append(spark.conf.get(name)) or materialize(*x))
    assert lm.score(docs).count() == docs.count()
    assert seen and {int(x.rstrip("b")) for x in seen} == {lm.BATCH_BYTES} and spark.conf.get(name) == before


# 9: neighbours


def exact_neighbours(ids, v, k=20, every=20):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (v[q] * v).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbours_of_few_vectors_are_exact(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[100:220] = v[0]  # ties
    rows = [(i, x.tolist(), "extra") for i, x in enumerate(v)]
    odd = [(1000, None, ""), (1020, [0.0] * 8, ""), (1040, [float("nan")] * 8, ""), (1060, [None] * 8, ""), (1080, [float("inf")] * 8, ""), (None, [1.0] * 8, "")]
    frame = spark.createDataFrame(rows + odd + rows[:2], "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for r in ann.search(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = exact_neighbours(np.arange(300), v.astype(np.float64))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>, score string")
    assert [(r.query_id, r["rank"]) for r in ann.search(few).orderBy("rank").collect()] == [(0, k) for k in range(1, 5)]
    assert ann.search(frame.limit(0)).count() == 0


def test_recall_and_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 24))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = exact_neighbours(np.arange(6000), v)
    for p in (ann.ForestParams(), ann.ForestParams(block_rows=100), ann.ForestParams(visit_rows=0, leaf_rows=60)):
        got = collections.defaultdict(set)
        for r in ann.search(frame, p=p).collect():
            got[r.query_id].add(r.vec_id)
        assert np.mean([len(got[q] & {i for i, _ in x}) / 20 for q, x in want.items()]) >= 0.9


# 10: packing


def test_packing(docs, spark):
    from tokenizers import Tokenizer

    files = queries.tokenizer_files()
    rows = spark.createDataFrame(ROWS + [(50, "<|endoftext|> as text", "en", "a"), (51, "日本語 \U0001f600  tabs\t\n\n x" * 50, None, None)], SCHEMA).repartition(2)
    plain = Tokenizer.from_file(files[0])
    for ranks in (files[1], None):
        pieces = packing.pack(rows, files[0], ranks).collect()
        ids = collections.Counter()
        for r in rows.collect():
            x = np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
            ids[(r.doc_id, len(x), zlib.crc32(x.tobytes()))] += 1
        whole = collections.Counter((r.doc_id, r.length, r.ids_crc32) for r in pieces if r.length == r.doc_tokens)
        assert not whole - ids
        total = collections.Counter()
        for r in pieces:
            total[(r.doc_id, r.doc_tokens)] += r.length
        assert all(total[(d, n)] == n * sum(c for (e, m, _), c in ids.items() if (e, m) == (d, n)) for d, n, _ in ids)
        by = collections.defaultdict(list)
        for r in pieces:
            by[r.sequence_id].append(r)
        for rows_ in by.values():
            at = 0
            for r in sorted(rows_, key=lambda r: r.offset):
                assert r.offset == at and r.length > 0
                at += r.length
            assert at == rows_[0].sequence_tokens <= 2048
    assert packing.pack(docs.limit(0), *files).count() == 0


def test_assignment_covers_all_and_balances():
    rng = random.Random(4)
    lengths = [rng.choice([1, 5, 300, 900, 2047, 2048, 2049, 9000]) for _ in range(500)] + [2048] * 3
    out = packing.assign(lengths)
    seen = collections.defaultdict(list)
    for pieces in out:
        assert 0 < sum(n for _, _, n in pieces) <= 2048
        for item, start, n in pieces:
            seen[item].append((start, n))
    for item, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[item]):
            assert start == at
            at += k
        assert at == n
    assert len(out) - sum(lengths) / 2048 < 3
    assert packing.assign([]) == []


# the pipeline


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    import corpus_pipeline

    words = {"en": "the of and to house tree with river".split(), "fr": "le la est dans maison arbre avec été".split()}
    say = lambda lang, n: " ".join(RNG.choices(words[lang], k=n))
    rows = [(i, say(lang, 200), lang, f"s{i % 3}", 0) for i, lang in enumerate(list(words) * 30)]
    rows += [(100, rows[0][1].replace(" ", "  "), "en", "s0", 0), (101, rows[1][1] + " fin", "fr", "s1", 0), (102, "12 34", "en", "s0", 0), (103, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    docs, sizes = frame, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == frame.columns
        docs = spark.createDataFrame(after.collect(), frame.schema)
        sizes.append({r.doc_id for r in docs.collect()})
    assert sizes[0] == {r[0] for r in rows} - {102, 103}
    assert sizes[1] == sizes[0] - {100}
    fps = {r[0]: brute.fingerprint(r[1]) for r in rows if r[0] in sizes[1]}
    ids = sorted(fps)
    assert sizes[2] == {ids[k] for k in set(brute.linked([fps[i] for i in ids]))}
    assert sizes[3] <= sizes[2]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == sizes[3]
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) and corpus_pipeline.ORACLE_SQL is None


# names, orders and sizes that the plain cases don't have


def plain_assign(lengths, capacity=2048):
    """The rule of ``packing.assign`` by looking at every sequence each time."""
    cost = lambda n: n + n * n / 2048
    full = [[(i, k * capacity, capacity)] for i, n in enumerate(lengths) if n > capacity for k in range(n // capacity)]
    rest = sorted(((n - n // capacity * capacity if n > capacity else n, i) for i, n in enumerate(lengths)), key=lambda x: (-x[0], x[1]))
    bins = [[] for _ in range(-(-sum(n for n, _ in rest) // capacity))]
    room, spent = [capacity] * len(bins), [0.0] * len(bins)
    for n, i in rest:
        start = lengths[i] - n
        while n:
            fit = [k for k in range(len(bins)) if room[k] >= n] or [k for k in range(len(bins)) if room[k]]
            k = min(fit, key=lambda k: (spent[k], k))
            take = min(n, room[k])
            bins[k].append((i, start, take))
            room[k], spent[k], start, n = room[k] - take, spent[k] + cost(take), start + take, n - take
    return full + [b for b in bins if b]


@pytest.mark.parametrize("seed", range(4))
def test_assignment_is_the_rule_of_lowest_cost(seed):
    rng = random.Random(seed)
    lengths = [max(1, int(rng.lognormvariate(5.7, 1.2))) for _ in range(rng.randint(1, 700))]
    assert packing.assign(lengths) == plain_assign(lengths)


CLASHING = ("__key", "key", "Key_", "copies", "copy", "mix_key", "blob_id", "spans", "source_", "rate_cdf", "a.b", "fp", "digest", "component")


def test_columns_of_any_name_stay(spark, docs, tmp_path):
    from lectern.llm import simhash

    rows = spark.createDataFrame(ROWS, SCHEMA)
    odd = rows.select("*", *[F.concat(F.lit(c + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING])
    stays = lambda out: all(r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}" for r in out.collect() for c in CLASHING)
    for stage in (exact_dedup.drop_copies, simhash.keep_representatives, mixing.mix, langid.keep_identified):
        out = stage(odd)
        assert out.columns[: len(odd.columns)] == odd.columns and stays(out)
    assert mixing.mix(odd).columns[len(odd.columns) :] == ["copies_", "copy_", "mix_key_"]
    scanned = secrets.scan(odd, str(tmp_path / "ledger"))
    assert scanned.columns[-2:] == ["blob_id_", "spans_"] and stays(scanned) and secrets.report(scanned).count() == len(ROWS)
    packed = packing.pack(odd, *queries.tokenizer_files())
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in ROWS}
    for found in (repeats.remove_repeats(odd), simhash.near_duplicates(odd), langid.identify(odd), lm.score(odd), exact_dedup.exact_groups(odd)):
        assert found.count() == len(ROWS)


def test_many_secrets_in_one_text(spark):
    n = 3000
    text = "é " + "deadbeefdeadbeef, " * n + "token = abcdefghijklmnop"
    (row,) = secrets.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    want = [f"hex:{2 + 18 * i}:{18 + 18 * i}" for i in range(n)] + [f"assign:{2 + 18 * n}:{len(text)}"]
    assert row.spans == ",".join(want) and (row.n_hex, row.n_assign) == (n, 1)


def plain_mixture(tables, text):
    """(language, share) by EM over the words of one text, with dictionaries: {language: {cell: log p}}."""
    import math

    names = sorted(tables)
    t = langid._items(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), [], [])
    words = [[int(c) for c, w in zip(t.cell, t.word) if w == k] for k in range(len(t.doc))]
    like = [{x: sum(tables[x][c] for c in w) for x in names} for w in words]
    like = [{x: math.exp(v - max(w.values())) for x, v in w.items()} for w in like]

    def em(some):
        share = {x: 1 / len(some) for x in some}
        for _ in range(langid.EM_STEPS):
            total = collections.Counter()
            for w in like:
                whole = max(sum(w[x] * share[x] for x in some), 1e-30)
                for x in some:
                    total[x] += w[x] * share[x] / whole
            share = {x: total[x] / len(like) for x in some}
        return share, sum(math.log(max(sum(w[x] * share[x] for x in some), 1e-30)) for w in like)

    cost = langid.PENALTY * math.log(len(like) + 1) + langid.ENTRY
    value, best = max(((sum(math.log(max(w[x], 1e-300)) for w in like), x) for x in names), key=lambda v: (v[0], [-ord(c) for c in v[1]]))
    value, share = value - cost, {best: 1.0}
    full = em(names)[0]
    rank = sorted(names, key=lambda x: -full[x])
    for m in range(2, len(names) + 1):
        if full[rank[m - 1]] < langid.LEAST_SHARE:
            break
        found, seen = em(rank[:m])
        if seen - m * cost <= value:
            break
        value, share = seen - m * cost, found
    return share


def language_rows(count, each, seed=21):
    """Rows of languages with words of their own letters' habits, and a mixed text of the first and the last one."""
    rng = random.Random(seed)
    words = {f"x{k:03d}": ["".join(rng.choices(rng.sample("abcdefghijklmnopqrstuvwxyz", 7), k=rng.randint(3, 8))) for _ in range(25)] for k in range(count)}
    say = lambda x, n: " ".join(rng.choices(words[x], k=n))
    return [(i, say(x, 40), x) for i, x in enumerate(list(words) * each)], say


def test_mixtures_are_those_of_the_plain_version(spark):
    rows, say = language_rows(5, 24)
    mixed = [(1000 + k, say("x000", 30) + " " + say("x004", 10 * k) + " " + say("x002", 25), None) for k in range(5)]
    frame = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    tables = {x: model.blocks[0][:, i].astype(float) for i, x in enumerate(model.names)}
    for i, text, _ in mixed + rows[:10]:
        found = langid.infer(model, [(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))])
        want = plain_mixture(tables, text)
        got = {model.names[j]: s for j, s in enumerate(found.share[0]) if s > 0}
        assert got.keys() == {x for x, s in want.items() if s > 0} and all(abs(got[x] - s) < 1e-4 for x, s in want.items() if s > 0), i


def test_three_hundred_languages_are_learnt(spark):
    rows, say = language_rows(300, 4)
    mixed = (9000, say("x007", 60) + " " + say("x290", 60), None)
    frame = spark.createDataFrame([*rows, mixed], "doc_id long, text string, lang string").repartition(4)
    assert len(langid.fit(frame.select("doc_id", "text", "lang")).blocks) == 5
    got = {r.doc_id: r for r in langid.identify(frame).collect()}
    right = [got[i].lang_pred == x for i, _, x in rows]
    assert np.mean(right) > 0.97 and {x.lang for x in got[9000].languages} == {"x007", "x290"}
    assert np.mean([r for r, (i, _, _) in zip(right, rows) if got[i].held_out]) > 0.9


def test_long_texts_are_judged_whole_in_pieces(spark, monkeypatch):
    rows, say = language_rows(3, 30)
    long_ = say("x000", 9000) + " " + say("x001", 9000)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame)
    data = np.frombuffer((long_ + "é" * 50_000).encode(), np.uint8)
    pieces = langid._pieces(data, 10_000)
    assert b"".join(p.tobytes() for p in pieces) == data.tobytes() and max(map(len, pieces)) <= 10_000
    data = data[: len(long_)]
    whole = langid.infer(model, [(data, np.array([0, len(data)]))])
    parts = langid.infer(model, [(p, np.array([0, len(p)])) for p in langid._pieces(data, 10_000)])
    assert np.allclose(whole.share, parts.share, atol=1e-6) and np.allclose(whole.gain, parts.gain) and (whole.share[0, :2] > 0.4).all()


def test_documents_of_several_languages_stay(spark):
    rows, say = language_rows(4, 30)
    extra = [(900, " ".join(say(f"x00{k}", 30) for k in range(3)), None), (901, "日本語の文章" * 30, None), (902, "12 34", "x000"), (903, None, "x000"), (904, say("x001", 3), None)]
    frame = spark.createDataFrame(rows + extra + extra[:1], "doc_id long, text string, lang string")
    kept = collections.Counter(r.doc_id for r in langid.keep_identified(frame).collect())
    assert kept == collections.Counter([i for i, *_ in rows] + [900, 900, 904])
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in langid.keep_identified(unlabelled).collect()} == {i for i, *_ in rows} | {900, 901, 904}
    assert langid.keep_identified(frame.limit(0)).count() == 0


def test_held_out_accuracy_on_documents(spark):
    import pathlib

    folder = "/root/testdata/sf0.01/documents.parquet"
    if not pathlib.Path(folder).exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(folder)
    found = langid.identify(docs).alias("p").join(docs.select("doc_id", "lang").where("lang is not null").alias("d"), "doc_id").where("held_out and lang_pred != 'und'")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 50 and right / n > 0.9


def clustered(n, dims=32, centres=400, seed=8):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] * 2 + rng.normal(size=(n, dims)) * 0.35


def test_clustered_vectors_take_few_products(spark):
    """Some 100,000 vectors: the walk takes under 0.3 n products a query, deeper than one leaf, and finds over 0.9."""
    n = 100_000
    v = clustered(n).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": v.tolist()}))
    rows = ann.usable(frame, "vec_id", "embedding")
    every = 500
    walk = ann.fit(rows, 20, every, ann.ForestParams())
    print(f"clustered: {len(walk.sizes)} trees of depth {walk.forest.depth}, {walk.products:.4f} n products, {walk.leaves:.1f} leaves a query")
    assert walk.products < 0.3 and walk.forest.depth >= 5
    got = collections.defaultdict(set)
    for r in ann.search(frame, every=every).collect():
        got[r.query_id].add(r.vec_id)
    wide = v.astype(np.float64)
    hits = []
    for q in range(0, n, every):
        s = wide @ wide[q]
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argpartition(-s, 20)[:20].tolist())) / 20)
    print(f"recall {np.mean(hits):.3f}")
    assert np.mean(hits) >= 0.9


def test_no_walk_costs_more_than_exact_search(spark):
    v = np.random.default_rng(9).normal(size=(8000, 48))
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(8000), "embedding": v.tolist()}))
    walk = ann.fit(ann.usable(frame, "vec_id", "embedding"), 20, 20, ann.ForestParams())
    print(f"isotropic: {len(walk.sizes)} trees of depth {walk.forest.depth}, {walk.products:.3f} n products")
    assert walk.products <= 1.0 and walk.found >= 0.95


def test_the_queue_yields_leaves_by_distance():
    v = clustered(3000, 16, 30)
    forest = ann.fit_forest(v, 3000, ann.ForestParams(leaf_rows=100))
    sizes = np.stack([np.bincount(x, minlength=2**forest.depth) for x in forest.leaves(v).T])
    assert forest.depth == 5 and (sizes.sum(1) == 3000).all() and sizes.max() < 400
    for q in v[:20]:
        far = forest.distances(q[None])[0]
        order = forest.visits(q, sizes / 3000, 99.0)
        assert len(order) == (sizes > 0).sum() and (np.diff([far[t, x] for t, x in order]) >= -1e-9).all()
        assert all(far[t, x] < 1e-12 for t, x in enumerate(forest.leaves(q[None])[0]))
