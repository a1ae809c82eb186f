"""Queries of text functions: tables in HTML, images, names, digests, metadata and literal matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.names import COLUMNS, document_name
from lectern.functions.text import comparison_key_col, letters_signature_col, lexical_digest, masked_tables_col, normalize_name_col, ocr_signature_col, without_images_col, without_tables_col
from lectern.operators import entities
from lectern.plans.registry import query, table, texts
from lectern.sources.markdown import sidecar_col

# tables

#: What surrounds a page, by its id: a table, a nested one, one that never closes behind a stray tag, others in a row.
_CASES = (
    ("", ""),
    ("", '<TABLE class="a"><tr><td>one</td></tr></TABLE>after'),
    ("", "<table><tr><td>\n< Table >in</ table >mid</td></tr></table>\nafter<table>b</table>"),
    ("", "</table> stray<table><tr>never\nclosed</tr>"),
    ("<table>first\n</table>", "<table/> <table>x</table></table>end<tablet>"),
    ("<table><table>", "</table>still in</table>out"),
)
_PAGE_SQL = "CASE page_id % 6 " + " ".join(f"WHEN {i} THEN '{a}' || coalesce(html, '') || '{b}'" for i, (a, b) in enumerate(_CASES)) + " END"
_TAG = r"(?i)<\s*/?\s*table\b[^>]*>"
_PIECES = rf"""WITH src AS (SELECT page_id, {_PAGE_SQL} AS t FROM pages),
p AS (SELECT page_id, regexp_split_to_array(t, '{_TAG}') AS parts, regexp_extract_all(t, '{_TAG}') AS tags FROM src),
tg AS (SELECT page_id, i, tags[i] AS tag, CASE WHEN regexp_matches(tags[i], '^<\s*/') THEN -1 WHEN ends_with(tags[i], '/>') THEN 0 ELSE 1 END AS d FROM p, LATERAL (SELECT unnest(generate_series(1, len(tags))) AS i)),
s AS (SELECT *, sum(d) OVER (PARTITION BY page_id ORDER BY i) AS s FROM tg),
dp AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM s),
dq AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY page_id ORDER BY i), 0) AS was FROM dp),
o AS (SELECT page_id, max(i) FILTER (was = 0 AND depth = 1) AS o, arg_max(depth, i) AS final FROM dq GROUP BY page_id),
pieces AS (SELECT page_id, 0 AS seq, parts[1] AS txt, true AS keep FROM p
  UNION ALL SELECT page_id, 2 * i - 1, tag, (depth = 0 AND was = 0) OR (final > 0 AND i >= o) FROM dq JOIN o USING (page_id)
  UNION ALL SELECT page_id, 2 * i, parts[i + 1], depth = 0 OR (final > 0 AND i >= o) FROM dq JOIN o USING (page_id) JOIN p USING (page_id))"""


def _page() -> Column:
    out = F.lit(None).cast("string")
    for i, (a, b) in enumerate(_CASES):
        out = F.when(F.col("page_id") % 6 == i, F.concat(F.lit(a), F.coalesce("html", F.lit("")), F.lit(b))).otherwise(out)
    return out


@query(_PIECES + """, runs AS (SELECT *, sum(CASE WHEN keep THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY seq) AS run FROM pieces),
spans AS (SELECT page_id, run, string_agg(txt, '' ORDER BY seq) AS txt FROM runs WHERE keep GROUP BY page_id, run)
SELECT page_id, coalesce(string_agg(txt, chr(10) ORDER BY run) FILTER (txt <> ''), '') AS text FROM spans GROUP BY page_id""")
def table_exclusion(spark, d):
    return texts(spark, d, "pages").select("page_id", without_tables_col(_page()).alias("text"))


@query(_PIECES + r" SELECT page_id, string_agg(CASE WHEN keep THEN txt ELSE regexp_replace(txt, '[^\n]', ' ', 'g') END, '' ORDER BY seq) AS text FROM pieces GROUP BY page_id")
def table_masking(spark, d):
    return texts(spark, d, "pages").select("page_id", masked_tables_col(_page()).alias("text"))


@query(r"SELECT page_id FROM pages, LATERAL (SELECT " + _PAGE_SQL + r" AS t) WHERE contains(lower(t), 'table') AND regexp_matches(t, '(?i)<\s*table\b[^>]*>')")
def table_prefilter(spark, d):
    """A cheap test for the word before the exact one for a tag."""
    pages = texts(spark, d, "pages").select("page_id", _page().alias("t"))
    return pages.where(F.contains(F.lower("t"), F.lit("table"))).where(F.rlike("t", F.lit(r"(?i)<\s*table\b[^>]*>"))).select("page_id")


_IMAGES = "text || chr(10) || 'a  b   c ![alt](x.png)  d' || chr(10) || '  \t ' || chr(10) || '![](<y z.png>) e![f](g(1).png)'"
_CLEAN = rf"regexp_replace({_IMAGES}, '!\[[^\]]*\]\((<[^>]*>|[^()]*(\([^()]*\))?[^()]*)\)', ' ', 'g')"
_CLEAN = rf"regexp_replace({_CLEAN}, '(?m)^[ \t]+$', '', 'g')"
for _ in range(2):  # a match takes the character behind it, which may be in front of the next one
    _CLEAN = rf"regexp_replace({_CLEAN}, '(\S)[ \t]{{2,}}(\S)', '\1 \2', 'g')"


@query(f"SELECT doc_id, {_CLEAN} AS text FROM documents WHERE NOT contains(text, '](') AND text <> ''")
def image_removal(spark, d):
    tail = "\na  b   c ![alt](x.png)  d\n  \t \n![](<y z.png>) e![f](g(1).png)"
    docs = texts(spark, d).where(~F.contains("text", F.lit("](")) & (F.col("text") != ""))
    return docs.select("doc_id", without_images_col(F.concat("text", F.lit(tail))).alias("text"))


# names and identifiers

_ODD = "'  ' || upper(p_name) || chr(9) || ' ' || chr(10) || p_type || ' '"


@query(rf"SELECT p_partkey, trim(regexp_replace(lower({_ODD}), '[ \t\n]+', ' ', 'g')) AS name, regexp_replace(lower({_ODD}), '[^a-z0-9]+', '', 'g') AS key, regexp_replace(lower({_ODD}), '[^a-z0-9]+', '', 'g') AS letters, replace(translate(regexp_replace(lower({_ODD}), '[^a-z0-9]+', '', 'g'), 'l10', 'iio'), 'rn', 'm') AS signature FROM part")
def name_keys(spark, d):
    odd = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t \n"), "p_type", F.lit(" "))
    return table(spark, d, "part").select("p_partkey", normalize_name_col(odd).alias("name"), comparison_key_col(odd).alias("key"), letters_signature_col(odd).alias("letters"), ocr_signature_col(odd).alias("signature"))


@query(r"SELECT conv_id, turn, trim(replace(regexp_replace(lower(nfc_normalize(text)), '[\s\xa0]+', ' ', 'g'), 'ß', 'ss')) AS name FROM conversations WHERE text IS NOT NULL")
def name_folding(spark, d):
    """Names in other scripts, by way of Python."""
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", normalize_name_col(F.col("text")).alias("name"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '-' || doc_id WHEN 1 THEN 'http://x/' || doc_id ELSE source END AS name FROM documents")
def document_names(spark, d):
    kind, prefix = F.col("doc_id") % 3, F.lit("URN:NBN:SI:doc-")
    urn = F.when(kind == 0, F.concat(prefix, "source", F.lit("-"), "doc_id")).when(kind == 1, F.concat(F.lit("http://x/"), "doc_id")).otherwise("")
    return table(spark, d, "documents").select("doc_id", document_name(urn, F.col("source")).alias("name"))


@query("SELECT doc_id, sha256(to_json([coalesce(source, ''), coalesce(text, '')])::VARCHAR) AS digest FROM documents")
def lexical_digests(spark, d):
    return texts(spark, d).select("doc_id", lexical_digest(F.col("source"), F.col("text")).alias("digest"))


_DAY = "strftime(o_orderdate, '%Y %m %d')"


@query("""SELECT o_orderkey, replace(CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y %m %d') WHEN 1 THEN strftime(o_orderdate, '%Y %m') ELSE strftime(o_orderdate, '%Y') END, ' ', '-') AS date, 'House ' || o_custkey AS publisher, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS source, NULL::VARCHAR AS rights, o_orderstatus AS title,
 CASE WHEN o_orderkey % 2 = 0 THEN 'URN:NBN:SI:doc-' || o_orderkey ELSE 'urn:x:' || o_orderkey END AS urn, (o_custkey % 50)::VARCHAR AS issue, NULL::VARCHAR AS volume, array_to_string(CASE WHEN o_orderkey % 2 = 0 THEN ['gf-urn:' || o_custkey, 'urn:nbn:si:doc-' || o_orderkey] ELSE ['urn:x:' || o_orderkey] END, ' ') AS identifiers FROM orders""")
def metadata_columns(spark, d):
    """Records whose fields are texts, lists and objects."""
    even, key = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")
    date = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy  MM dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy MM")).otherwise(F.date_format("o_orderdate", "yyyy"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    typed = text('[{"@identifier_type":"URN","#text":"URN:NBN:SI:doc-', key, '"},"GF-URN:', F.col("o_custkey").cast("string"), '"]')
    bare = text('["x","urn:x:', key, '"]')
    record = text('{"Record":{"date":"', date, '","publisher":[" House ', F.col("o_custkey").cast("string"), ' ","other"],"source":"', F.when(even, F.col("o_orderpriority")).otherwise(" "), '","title":{"#text":"', F.col("o_orderstatus"), '"},"identifier":', F.when(even, typed).otherwise(bare), ',"format":[{"@format_type":"Issue","#text":', (F.col("o_custkey") % 50).cast("string"), "}]}}")
    rows = table(spark, d, "orders").select("o_orderkey", sidecar_col(record).alias("m"))
    return rows.select("o_orderkey", *[F.col(f"m.{c}").alias(c) for c in COLUMNS], F.array_join("m.identifiers", " ").alias("identifiers"))


@query(r"SELECT doc_id, name, len(regexp_extract_all(coalesce(text, ''), '\b' || name || '\b'))::BIGINT AS matches FROM documents, (VALUES ('from'), ('the'), ('and the')) n(name) WHERE lang = 'en'")
def literal_names(spark, d):
    return entities.literal_matches(texts(spark, d).where("lang = 'en'").select("doc_id", "text"), "text", ["from", "the", "and the"])
