import sqlite3

import pyarrow as pa
import pytest

from lectern.operators import lexical

DOCS = [(i, f"Title {i % 7}", "luna glasba " + "nova " * (i % 4) + ("redka " if i % 13 == 0 else "") + ("lun čas " if i % 5 == 0 else "") + ("glasba konec luna" if i % 3 == 0 else "")) for i in range(80)]
QUERIES = ["luna", "redka", '"luna glasba"', "luna OR nova", "luna NOT nova", "lun*", "lùna", "title:Title", "nothing here", "NEAR(luna glasba, 2)", "redka nova", "redka AND (nova OR cas)", "nova redka OR cas", '"konec mat" *', "title:3 nova", "NEAR(konec glasba luna, 1)", "text:title", "nova NOT redka OR cas", "nothing"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, text string")
    return lexical.build_index(docs, str(tmp_path_factory.mktemp("index")), buckets=4)


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(text, title, rowid) VALUES (?3, ?2, ?1)", [(i + 1, a, b) for i, a, b in DOCS])
    return con


@pytest.mark.parametrize("query", QUERIES)
def test_scores_are_those_of_fts5(index, fts, query):
    want = {r[0] - 1: -r[1] for r in fts.execute("SELECT rowid, bm25(t, 2.0, 1.0) FROM t WHERE t MATCH ?", (query,))}
    got = {r.doc_id: r.score for r in lexical.bm25(index, query).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("query", ["", "AND", "a AND", "(a", 'a "b', "a OR OR b", "NEAR(a b, x)", "unknown:a", "a-b"])
def test_malformed_queries_are_refused(query, fts):
    with pytest.raises(lexical.QueryError):
        lexical.parse(query)
    if query:
        with pytest.raises(sqlite3.OperationalError):
            fts.execute("SELECT rowid FROM t WHERE t MATCH ?", (query,)).fetchall()


def test_fusion_cuts_both_lists_first(spark):
    surface = spark.createDataFrame([(i, 100.0 - i) for i in range(60)], "doc_id long, score double")
    lemma = spark.createDataFrame([(59, 5.0)], "doc_id long, score double")
    got = {r.doc_id: r.score for r in lexical.fuse(surface, lemma, 60, lemma_weight=2.0).collect()}
    assert got[59] == 10.0 + 41.0 and len(got) == 60
    cut = {r.doc_id: r.score for r in lexical.fuse(surface, lemma, 2).collect()}
    assert cut == {0: 100.0, 1: 99.0}


def test_regex_search(spark):
    docs = spark.createDataFrame([(2, "ab12"), (1, "xx"), (3, None), (4, "AB1 ab1")], "doc_id long, text string")
    assert [(r.doc_id, r.focus) for r in lexical.regex_search(docs, r"[a-z]+\d", 5).collect()] == [(2, 0), (4, 4)]
    assert [(r.doc_id, r.focus) for r in lexical.regex_search_builtin(docs, r"[a-z]+\d", 5).collect()] == [(2, 0), (4, 4)]
    assert [r.doc_id for r in lexical.regex_search(docs, "ab1", 1, ignore_case=True).collect()] == [2]
    with pytest.raises(lexical.QueryError):
        lexical.regex_search(docs, "(", 1)


@pytest.mark.parametrize("query", QUERIES[:10])
def test_a_scan_scores_like_an_index(spark, index, query):
    found = lexical.scan(spark.createDataFrame(DOCS, "doc_id long, title string, text string"), title_col="title")
    rounded = lambda rows: sorted((r.doc_id, round(r.score, 9)) for r in rows.collect())
    assert rounded(lexical.bm25(found, query)) == rounded(lexical.bm25(index, query))


def test_postings_are_made_without_a_shuffle_in_bounded_runs(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS + [(80, None, None), (81, "x", ""), (82, "nova", "nova é nova")], "doc_id long, title string, text string")
    tokens = lexical.tokenized(docs)
    made = lexical.postings(tokens)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, title, text in tokens.collect():
        for k, words in enumerate((title, text)):
            for at, term in enumerate(words, 1):
                want.setdefault((term, i, len(title) + len(text)), ([], []))[k].append(at)
    got = {(r.term, r.doc_id, r.size): (r.title_at, r.text_at) for r in made.collect()}
    assert got == want
    monkeypatch.setattr(lexical, "RUN_TOKENS", 7)
    rows = pa.RecordBatch.from_pylist([r.asDict() for r in tokens.collect()], pa.schema([("doc_id", pa.int64()), ("title_tokens", pa.list_(pa.string())), ("text_tokens", pa.list_(pa.string()))]))
    runs = [b.to_pylist() for b in lexical._inverted(iter([rows.slice(0, 50), rows.slice(50)]))]
    assert {(p["term"], p["doc_id"], p["size"]): (p["title_at"], p["text_at"]) for run in runs for p in run} == want
    assert sum(map(len, runs)) == len(want) and len(runs) > 30
    assert all(run == sorted(run, key=lambda p: (p["term"], p["doc_id"])) for run in runs)
    assert all(len({p["doc_id"] for p in run}) <= 7 for run in runs)
