import pytest
from pyspark.sql import functions as F

from lectern.functions import names, text
from lectern.operators import chunking, snippets


def test_names_and_keys(spark):
    assert text.normalize_name("  Aná  NOVÁK ") == "aná novák"
    assert text.comparison_key("O'Neil-Smith, Jr.") == "oneilsmithjr"
    assert text.ocr_key("Barn 1O l0") == text.ocr_key("Bam IO IO") == "bamioio"
    assert text.letters_signature("Črtomír") == "crtomir"
    rows = spark.createDataFrame([("Ana  NOVAK",), (None,)], "n string").select(text.normalize_name_col("n").alias("n")).collect()
    assert [r.n for r in rows] == ["ana novak", None]


@pytest.mark.parametrize("given,tokens", [("gledališče Čas", ["gledalisce", "cas"]), ("naïve_x e-mail l’été 3.14", ["naive", "x", "e", "mail", "l", "ete", "3", "14"]), ("ß Straße", ["ß", "straße"]), (None, []), ("cafés", ["cafes"])])
def test_search_tokens(given, tokens):
    assert text.search_tokens(given) == tokens


TABLE = "Lead text.\n<TABLE class='ocr'>A<table>B</table></TABLE>\nLast text."


def test_tables():
    spans = text.text_outside_tables(TABLE)
    assert [TABLE[a:b] for a, b in spans] == ["Lead text.\n", "\nLast text."]
    assert text.without_tables(TABLE) == "Lead text.\n\n\nLast text."
    masked = text.masked_tables(TABLE)
    assert len(masked) == len(TABLE) and masked.count("\n") == 2 and "A" not in masked[11:40]
    assert text.without_tables("a <table> b") == "a <table> b"
    assert text.text_outside_tables("x</table>y<table/>z") == [(0, 19)]
    assert text.without_tables("") == ""


def test_images_and_plain_text(spark):
    assert text.without_images("a ![x](y \"(z)\")  b\n  \nc") == "a b\n\nc"
    assert text.without_images("\\![keep](x)") == "\\![keep](x)"
    row = spark.createDataFrame([("# H\n\n`c` [l](u) <b>x</b>\r\n\n\n\ny  z ```q```",)], "t string").select(text.plain_text(F.col("t")).alias("p"), text.first_sentences(F.lit("One. Two! Three?"), 2).alias("s")).first()
    assert row.p == "H\n\n l x\n\ny z" and row.s == "One. Two!"


def test_articles():
    found = list(chunking.articles_of("lost\n# First article\nAlpha beta gamma delta.\nSecond line here.\n\n## \n## Other\nNeedle.\n# Empty\n"))
    assert [(a["title"], a["content"]) for a in found][0] == ("First article", "Alpha beta gamma delta.\nSecond line here.")
    assert found[1]["title"] == "# Other" and (found[1]["line_start"], found[1]["line_end"]) == (7, 8)
    whole = list(chunking.articles_of("  just text \n"))
    assert whole[0]["title"] is None and whole[0]["content"] == "just text" and whole[0]["char_start"] == 2
    assert not list(chunking.articles_of(" \n"))


def test_token_windows():
    t = "Alpha beta gamma delta.\nSecond line here."
    spans = list(chunking.token_windows(t, count=3, overlap=1))
    assert [t[a:b] for a, b in spans] == ["Alpha beta gamma", "gamma delta.\nSecond", "Second line here."]
    apart = list(chunking.token_windows("a b <table>x</table> c", count=5, overlap=0, skip_tables=True))
    assert len(apart) == 2
    with pytest.raises(ValueError):
        list(chunking.token_windows("a", count=2, overlap=2))


def test_chunk_columns(spark):
    t = "One. Two! Three? Four. Five. Six.\n\n \nPara two  here"
    row = spark.createDataFrame([(t, "")], "t string, e string").select(chunking.sentence_windows(F.col("t"), 3, 1).alias("s"), chunking.paragraphs(F.col("t")).alias("p"), chunking.word_windows(F.col("t"), 4, 1).alias("w"), chunking.sentence_windows(F.col("e")).alias("n")).first()
    assert row.s == ["One. Two! Three?", "Three? Four. Five.", "Five. Six. Para two here"]
    assert row.p == ["One. Two! Three? Four. Five. Six.", "Para two  here"]
    assert row.w == ["One. Two! Three? Four.", "Four. Five. Six. Para", "Para two here"] and row.n == []


def test_recursive_parts():
    parts = chunking.recursive_parts("# title\n\n" + "word " * 100, 60, 10)
    assert parts and all(len(p) <= 60 for p in parts) and "title" not in parts[0]
    assert chunking.recursive_parts("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunking.recursive_parts(" \n") == []


def test_snippets():
    source = "line one is here\nline two holds the needle in it\nline three\n"
    assert snippets.focus("A Needle", "x", 5, 9, "needle OR x") == 7
    assert snippets.focus(None, "has the Needle", 10, 24, "NOT needle") == 18
    assert snippets.trim_span(source, 2, 2, 0, 100) == ("line two holds the needle in it", 2, 2)
    cut = snippets.trim_span(source, 1, 3, source.index("needle"), 12)
    assert len(cut[0]) == 12 and cut[0][0] == "…" and cut[0][-1] == "…" and "needl" in cut[0]
    assert "".join(snippets.wrap("aaa bbb ccc ddd", 8)) == "aaa bbb ccc ddd" and snippets.wrap("", 5) == [""]
    assert snippets.position(source, source.index("needle"), 10) == "2.3"
    assert snippets.read_lines(source, 2, 3, 8)["text"] == "line two"
    read = snippets.read_wrapped(source, "2.2", 1, 1, 10, 1000)
    assert (read["position_start"], read["position_end"]) == ("2.1", "2.3") and read["has_before"] and read["has_after"]
    with pytest.raises(ValueError):
        snippets.read_wrapped(source, "9.1", 1, 1, 10, 1000)


RECORD = {"Record": {"identifier": ["URN:bare", {"#text": "URN:NBN:SI:doc-1", "@identifier_type": "URN"}, "gf-urn:X"], "date": "1934 10 10", "title": ["T", "U"], "source": " S ", "format": [{"@format_type": "Issue", "#text": "7"}, "print"]}}


def test_metadata():
    found = names.newspaper_columns(RECORD)
    assert found == {"date": "1934-10-10", "publisher": None, "source": "S", "rights": None, "title": "T", "urn": "URN:NBN:SI:doc-1", "issue": "7", "volume": None}
    assert names.newspaper_columns({"Record": {"date": "c. 1929", "identifier": "urn:x"}})["urn"] == "urn:x"
    assert names.newspaper_columns(None)["date"] is None and names.iso_date("1929") == "1929" and names.iso_date("1929 5") == "1929 5"
    assert names.source_identifiers(RECORD) == ["gf-urn:x", "urn:bare", "urn:nbn:si:doc-1"]


def test_chunk_names(spark):
    value = names.chunk_name("a/b.md", 3)
    assert names.parse_chunk_name(value) == {"schema": names.CHUNK_SCHEMA, "path": "a/b.md", "article": "b", "chunk": "3"}
    assert names.parse_chunk_name("a/b###c###4")["path"] == "a/b###c" and names.parse_chunk_name("zzz")["chunk"] == "0"
    rows = spark.createDataFrame([(value,), ("a/b###c###4",), ("zzz",)], "v string").select(names.chunk_path(F.col("v")).alias("p")).collect()
    assert [r.p for r in rows] == ["a/b.md", "a/b###c", "zzz"]


def test_a_udf_holds_few_values_of_a_batch_at_once():
    import tracemalloc

    import pyarrow as pa

    pages = pa.array([f"{i}<table>{'x' * 10_000}</table>" for i in range(3000)] + [None])
    tracemalloc.start()
    masked = text.sliced(text.masked_tables, (pages,), pa.string())
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 6_000_000
    assert len(masked) == 3001 and masked[3000].as_py() is None
    assert masked[2999].as_py() == "2999" + " " * (10_000 + len("<table></table>"))
    two = pa.struct([("a", pa.int32()), ("b", pa.string())])
    assert text.sliced(lambda n, t: (n, t) if n else {"a": 5, "b": t}, (pa.array([0, 7, None]), pa.array(["x", "y", "z"])), two).to_pylist() == [{"a": 5, "b": "x"}, {"a": 7, "b": "y"}, {"a": None, "b": None}]
    assert text.sliced(str, (pa.array([], pa.int64()),), pa.string()).to_pylist() == []


def test_a_character_is_looked_up_once(monkeypatch):
    import unicodedata

    seen = []
    monkeypatch.setattr(text.unicodedata, "category", lambda c, f=unicodedata.category: seen.append(c) or f(c))
    assert text.search_tokens("Ča\u0301s, \u0301x\u20ddy " * 500) == ["cas", "xy"] * 500
    assert len(seen) == len(set(seen))
