import random

import brute
import numpy as np
import pytest

from lectern.llm import graph, simhash

TEXTS = [None, "", "  \t\n ", "one", "ONE", "a b c d", "a b c d e", "Ä ä É", "x " * 5000, "word " * 3 + "\x0b\x0cend"]


def test_fingerprints_are_those_of_the_definition(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, fp int")
    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(docs).collect()}
    assert got == {i: brute.fingerprint(t) for i, t in enumerate(TEXTS)}


def near(seed, n, flips):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(8)]
    return [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))) for c in rng.choices(centres, k=n)]


@pytest.mark.parametrize("parts,most", [(1, 64), (2, 64), (2, 2), (2, 5), (1, 2)])
def test_links_join_what_all_pairs_would(spark, parts, most):
    fps = sorted(set(near(1, 60, 3) + near(2, 60, 6) + [0, 15, 31, (1 << 64) - 1]))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), parts=parts, most_pairs_of=most)
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    named = {r.node % (1 << 64): r.component for r in graph.components(found).collect()}
    own = {f: named.get(f, s) for f, s in zip(fps, signed)}
    want = brute.linked(fps)
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == y) for y in set(labels))
    assert groups(want) == groups([own[f] for f in fps])


def test_batches_end_anywhere():
    import pyarrow as pa

    rows = sorted((v, f) for v in range(50) for f in set(near(v, 40, 3)))
    whole = lambda size: {(a, b) for a, b in pairs(size) if a != b}

    def pairs(size):
        batches = [pa.RecordBatch.from_pydict({"value": [v for v, _ in rows[i : i + size]], "fp": [int(np.uint64(f).view(np.int64)) for _, f in rows[i : i + size]]}) for i in range(0, len(rows), size)]
        for out in simhash._meet(4, 64, size)(iter(batches)):
            yield from zip(*(c.to_pylist() for c in out.columns))

    assert whole(10_000) == whole(7) and whole(7)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == set(range(301)) | set(range(1000, 1100))
    assert all(c == (0 if n < 1000 else 1000) for n, c in got.items())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_nulls_and_ties(spark):
    docs = spark.createDataFrame([(5, "same words here now"), (5, "same words here now"), (3, "same words here now"), (None, "same words here now"), (9, None), (8, ""), (None, "all alone in this text")], "doc_id long, text string")
    rows = sorted(simhash.near_duplicates(docs).collect(), key=str)
    assert len(rows) == 7
    assert {r.component_id for r in rows if r.doc_id in (3, 5)} == {3} and {r.component_id for r in rows if r.doc_id in (8, 9)} == {8}
    kept = simhash.keep_representatives(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "8", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(docs.selectExpr("doc_id as fp"), radius=3)


def test_null_and_repeated_ids_of_unlike_texts_stay(spark):
    rng = random.Random(4)
    a, b, c, d, e, f = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(40)) for k in "abcdef")
    docs = spark.createDataFrame([(None, a), (None, a), (None, b), (None, c), (4, c), (7, d), (7, e), (3, d), (9, f), (9, f), (9, f.upper())], "doc_id long, text string")
    kept = simhash.keep_representatives(docs).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == sorted([("None", a), ("None", b), ("4", c), ("3", d), ("7", e), ("9", f)])
