"""The library's registered queries over the shared tables, each with the same query as DuckDB SQL.

``documents`` stand in for articles (source: newspaper, text: content), ``labels`` for their validity,
``embeddings`` for chunk vectors, ``conversations`` for chunks in order, ``events`` for run ledgers,
``orders`` and ``lineitem`` for issues and articles, and ``part`` for names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.names import chunk_path
from lectern.functions.text import ascii_tokens, first_sentences, plain_text, stable_id
from lectern.operators import alignment, chunking, entities, lexical, relational, requests, shards, snippets, vectors
from lectern.plans import catalogue_archive, catalogue_text  # noqa: F401 - they register their queries
from lectern.plans.registry import QUERIES, SQL, once, query, table, texts  # noqa: F401
from lectern.plans.scratch import scratch_dir

# ranked search

_TOK = "documents_tokens AS (SELECT doc_id, source, lang, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents), stats AS (SELECT count(*) AS n, avg(len(w)) AS a FROM documents_tokens)"


def _bm25_sql(terms: list[str], where: str, extra: str = "", limit: str = "LIMIT 10") -> str:
    """The score of single words over all documents; ``where`` is a condition over n0, n1, ..."""
    counts = ", ".join(f"len(list_filter(w, lambda t: {t})) AS n{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (n{i} > 0) AS d{i}" for i in range(len(terms)))
    idf = lambda i: f"(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END)"
    score = " + ".join(f"{idf(i)} * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * len(w) / a))" for i in range(len(terms)))
    return f"WITH {_TOK}, hits AS (SELECT *, {counts} FROM documents_tokens), dfs AS (SELECT {dfs} FROM hits) SELECT doc_id, round({score}, 6) AS score FROM hits, dfs, stats WHERE ({where}) {extra} ORDER BY score DESC, doc_id {limit}"


def _index(spark, d) -> lexical.Index:
    """The documents' index, built once for all queries of a session."""
    return once(spark, d, "surface index", lambda: lexical.build_index(texts(spark, d), scratch_dir(spark, "surface-index"), title_col=None, tokens=ascii_tokens))


def _scored(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", F.round("score", 6).alias("score"))


def _page(scores: DataFrame, limit: int = 10) -> DataFrame:
    return lexical.top(_scored(scores), limit)


@query(_bm25_sql(["t = 'queen'"], "n0 > 0"))
def bm25_scan(spark, d):
    """The same without an index."""
    return _page(lexical.bm25(lexical.scan(texts(spark, d), tokens=ascii_tokens), "queen"))


@query(_bm25_sql(["t = 'queen'"], "n0 > 0"))
def bm25_topk(spark, d):
    return _page(lexical.bm25(_index(spark, d), "queen"))


@query(_bm25_sql(["t = 'the'", "t = 'from'"], "n0 > 0 AND n1 > 0"))
def bm25_and(spark, d):
    return _page(lexical.bm25(_index(spark, d), "the from"))


@query(_bm25_sql(["t = 'queen'", "t = 'from'"], "n0 > 0 OR n1 > 0"))
def bm25_or(spark, d):
    return _page(lexical.bm25(_index(spark, d), "queen OR from"))


@query(f"WITH {_TOK}, hits AS (SELECT *, len(list_filter(w, lambda t: t = 'the')) AS n0, len(list_filter(w, lambda t: t = 'from')) AS n1 FROM documents_tokens), dfs AS (SELECT count(*) FILTER (n0 > 0) AS d0 FROM hits) SELECT doc_id, round((CASE WHEN ln((n - d0 + 0.5) / (d0 + 0.5)) > 0 THEN ln((n - d0 + 0.5) / (d0 + 0.5)) ELSE 1e-6 END) * n0 * 2.2 / (n0 + 1.2 * (0.25 + 0.75 * len(w) / a)), 6) AS score FROM hits, dfs, stats WHERE n0 > 0 AND n1 = 0 ORDER BY score DESC, doc_id LIMIT 10")
def bm25_not(spark, d):
    return _page(lexical.bm25(_index(spark, d), "the NOT from"))


@query(_bm25_sql(["starts_with(t, 'que')"], "n0 > 0"))
def bm25_prefix(spark, d):
    return _page(lexical.bm25(_index(spark, d), "que*"))


@query(f"WITH {_TOK}, hits AS (SELECT *, len(list_filter(generate_series(1, len(w) - 1), lambda i: w[i] = 'and' AND w[i + 1] = 'the')) AS n0 FROM documents_tokens), dfs AS (SELECT count(*) FILTER (n0 > 0) AS d0 FROM hits) SELECT doc_id, round((CASE WHEN ln((n - d0 + 0.5) / (d0 + 0.5)) > 0 THEN ln((n - d0 + 0.5) / (d0 + 0.5)) ELSE 1e-6 END) * n0 * 2.2 / (n0 + 1.2 * (0.25 + 0.75 * len(w) / a)), 6) AS score FROM hits, dfs, stats WHERE n0 > 0 ORDER BY score DESC, doc_id LIMIT 10")
def bm25_phrase(spark, d):
    return _page(lexical.bm25(_index(spark, d), '"and the"'))


@query(_bm25_sql(["t = 'from'"], "n0 > 0", "AND doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3')"))
def bm25_scoped(spark, d):
    docs = texts(spark, d)
    inside = docs.where(relational.in_scope("src3", title="lang", date="lang")).select("doc_id")
    return _page(lexical.bm25(_index(spark, d), "from").join(inside, "doc_id", "left_semi"))


@query(f"""WITH a AS ({_bm25_sql(["t = 'from'"], "n0 > 0", limit="LIMIT 50")}),
b AS ({_bm25_sql(["starts_with(t, 'from')"], "n0 > 0", limit="LIMIT 50")})
SELECT doc_id, round(coalesce(a.score, 0) + 0.5 * coalesce(b.score, 0), 6) AS score FROM a FULL JOIN b USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_combined_fusion(spark, d):
    index = _index(spark, d)
    return _scored(lexical.fuse(_scored(lexical.bm25(index, "from")), _scored(lexical.bm25(index, "from*")), 10, lemma_weight=0.5))


@query("SELECT doc_id, strlen(regexp_extract(text, '(?s)^(.*?)[0-9]{3,}', 1))::BIGINT AS bytes_before, 1.0::DOUBLE AS score FROM documents WHERE regexp_matches(text, '[0-9]{3,}') ORDER BY doc_id LIMIT 20")
def regex_search(spark, d):
    docs = table(spark, d, "documents")
    found = lexical.regex_search(docs, "[0-9]{3,}", 20)
    return found.join(docs, "doc_id").select("doc_id", F.octet_length(F.substring("text", F.lit(1), F.col("focus").cast("int"))).cast("long").alias("bytes_before"), "score")


@query("WITH h AS (SELECT doc_id, text, instr(lower(text), 'from') AS p FROM documents WHERE instr(lower(text), 'from') > 0) SELECT doc_id, (p - 1)::BIGINT AS focus, substr(text, greatest(p - 40, 1), 120) AS snippet FROM h")
def snippet_focus(spark, d):
    docs = table(spark, d, "documents").withColumn("p", snippets.focus_col(F.col("text"), "from OR"))
    shown = F.substring("text", F.greatest(F.col("p") + 1 - 40, F.lit(1)), F.lit(120))
    return docs.where("p is not null").select("doc_id", F.col("p").cast("long").alias("focus"), shown.alias("snippet"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT *, coalesce(least(nullif(instr(replace(lower(t), 'ß', 'ss'), 'from'), 0), nullif(instr(replace(lower(t), 'ß', 'ss'), 'the'), 0)) - 1, 0)::INT AS focus FROM d),
c AS (SELECT *, least(greatest(0, least(focus, length(t) - 1) - 106), length(t) - 320) AS lo FROM f),
x AS (SELECT *, length(t) <= 320 AS whole, lo + 320 AS hi, substr(t, lo + 1, 320) AS cut FROM c)
SELECT doc_id, focus,
  CASE WHEN whole THEN rtrim(t, chr(10) || chr(13)) ELSE (CASE WHEN lo > 0 THEN '…' || substr(cut, 2) ELSE cut END)[1:319] || (CASE WHEN hi < length(t) THEN '…' ELSE cut[320] END) END AS text,
  CASE WHEN whole THEN 1 ELSE length(substr(t, 1, lo)) - length(replace(substr(t, 1, lo), chr(10), '')) + 1 END::INT AS line_start,
  CASE WHEN whole THEN length(t) - length(replace(t, chr(10), '')) + 1 ELSE length(substr(t, 1, hi - 1)) - length(replace(substr(t, 1, hi - 1), chr(10), '')) + 1 END::INT AS line_end
FROM x""")
def snippet_trimmed(spark, d):
    docs = texts(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = snippets.focus_udf(F.lit(""), F.col("text"), F.lit(0), F.length("text"), F.lit("from the"))
    return docs.select("doc_id", at.alias("focus"), snippets.trim_span_col(F.col("text"), F.lit(1), F.lit(1_000_000), at, F.lit(320)).alias("s")).select("doc_id", "focus", "s.*")


_CUT = "CASE WHEN length({0}) <= 60 THEN length({0}) WHEN instr(reverse(replace(substr({0}, 1, 60), chr(9), ' ')), ' ') BETWEEN 1 AND 59 THEN 61 - instr(reverse(replace(substr({0}, 1, 60), chr(9), ' ')), ' ') ELSE 60 END"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) // 2 AS spot FROM documents WHERE text <> ''),
l AS (SELECT doc_id, length(substr(t, 1, spot)) - length(replace(substr(t, 1, spot), chr(10), '')) + 1 AS line, CASE WHEN contains(substr(t, 1, spot), chr(10)) THEN instr(reverse(substr(t, 1, spot)), chr(10)) - 1 ELSE spot END AS inside, t, spot FROM d),
w AS (SELECT doc_id, line, inside, rtrim(split_part(substr(t, spot - inside + 1), chr(10), 1), chr(13)) AS rest FROM l),
walk AS (SELECT doc_id, line, inside, rest, 1 AS section, {_CUT.format('rest')} AS cut FROM w
  UNION ALL SELECT doc_id, line, inside - cut, r, section + 1, {_CUT.format('r')} FROM (SELECT *, substr(rest, cut + 1) AS r FROM walk) x WHERE inside >= cut AND r <> '')
SELECT doc_id, line || '.' || max(section) AS position FROM walk GROUP BY doc_id, line""")
def wrapped_position(spark, d):
    docs = texts(spark, d).where("text != ''")
    return docs.select("doc_id", snippets.position_col(F.col("text"), F.floor(F.length("text") / 2).cast("int"), F.lit(60)).alias("position"))


# articles: duplicates, validity, coverage


@query("SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE text <> '') WHERE doc_id > first_id")
def duplicate_articles(spark, d):
    return relational.duplicates(table(spark, d, "documents"), "doc_id", "text")


@query("WITH l AS (SELECT doc_id, text, CASE WHEN quality = 0 THEN 'duplicate' END AS reason FROM documents LEFT JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM l WHERE text <> '') SELECT count(*) AS marked FROM r WHERE k > 1 AND reason IS DISTINCT FROM 'duplicate'")
def duplicates_to_mark(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("reason", F.when(F.col("quality") == 0, "duplicate"))
    return relational.duplicates(rows, "doc_id", "text", "reason").agg(F.count(F.lit(1)).alias("marked"))


_VALID = "v AS (SELECT d.doc_id, d.source, d.text, l.quality AS is_valid FROM documents d LEFT JOIN labels l USING (doc_id))"


def _validity(spark, d) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("is_valid"))
    return relational.with_validity(table(spark, d, "documents").select("doc_id", "source", "text"), labels, "doc_id")


@query(f"WITH {_VALID} SELECT source, count(*) FILTER (is_valid = 1) AS valid, count(*) FILTER (is_valid = 0) AS invalid, count(*) FILTER (is_valid IS NULL) AS unknown, count(*) FILTER (is_valid IS DISTINCT FROM 0) AS not_invalid FROM v GROUP BY source")
def validity_tristate(spark, d):
    return _validity(spark, d).groupBy("source").agg(F.count_if(F.col("is_valid") == 1).alias("valid"), F.count_if(F.col("is_valid") == 0).alias("invalid"), F.count_if(F.col("is_valid").isNull()).alias("unknown"), F.count_if(~F.col("is_valid").eqNullSafe(F.lit(0))).alias("not_invalid"))


@query("SELECT e.vec_id, coalesce(l.quality, 0) AS is_valid FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id")
def embedding_validity(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("is_valid"))
    return relational.with_validity(table(spark, d, "embeddings").select("vec_id"), labels, "vec_id", default=0)


@query("WITH e AS (SELECT e.vec_id, e.label % 2 AS old, coalesce(l.quality, 0) AS new FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id) SELECT count(*) AS changed, count(*) FILTER (new = 1) AS to_valid, count(*) FILTER (new = 0) AS to_invalid, min(vec_id) AS first_id, max(vec_id) AS last_id FROM e WHERE old IS DISTINCT FROM new")
def embedding_validity_changes(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("new"))
    rows = relational.with_validity(table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("is_valid")), labels, "vec_id", "new", 0)
    return relational.changed_validity(rows, F.col("new")).agg(F.count(F.lit(1)).alias("changed"), F.count_if(F.col("new") == 1).alias("to_valid"), F.count_if(F.col("new") == 0).alias("to_invalid"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_documents(spark, d):
    return relational.pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def completed_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents d WHERE doc_id > 100 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 25")
def pending_page(spark, d):
    return relational.page(relational.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id"), "doc_id", 100, 25)


@query("SELECT count(*) AS eligible, count(l.doc_id) AS completed, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage(spark, d):
    return relational.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)) AS extra, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 45 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS missing")
def set_equality_audit(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.set_difference(table(spark, d, "orders"), lines, "o_orderkey")


@query("WITH a AS (SELECT DISTINCT vec_id FROM embeddings), b AS (SELECT DISTINCT doc_id AS vec_id FROM labels) SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, CASE WHEN a.vec_id IS NULL THEN 'right' ELSE 'left' END AS side FROM a FULL JOIN b ON a.vec_id = b.vec_id WHERE a.vec_id IS NULL OR b.vec_id IS NULL")
def orphan_keys(spark, d):
    """Labels cover some documents, and vectors others."""
    return relational.orphans(table(spark, d, "embeddings"), table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id")


@query("SELECT o_orderkey, true AS any_line, bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'F') AS finished, bool_or(l_tax > 0.07) AS taxed, bool_or(l_quantity > 45) AS large, bool_or(l_discount > 0.09) AS reduced FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 UNION ALL SELECT o_orderkey, false, false, false, false, false, false FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def coverage_tables(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    kinds = {"any_line": "true", "returned": "l_returnflag = 'R'", "finished": "l_linestatus = 'F'", "taxed": "l_tax > 0.07", "large": "l_quantity > 45", "reduced": "l_discount > 0.09"}
    return relational.coverage_all(table(spark, d, "orders"), {k: lines.where(v) for k, v in kinds.items()}, "o_orderkey")


@query("SELECT c.c_custkey, c.c_name, coalesce(s.bal, c.c_acctbal) AS c_acctbal, coalesce(s.seg, c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS bal, min(o_orderpriority) AS seg FROM orders GROUP BY 1 HAVING count(*) > 9) s ON c.c_custkey = s.o_custkey")
def staged_update(spark, d):
    staged = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"), F.min("o_orderpriority").alias("c_mktsegment"), F.count(F.lit(1)).alias("n")).where("n > 9").drop("n")
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return relational.apply_staged(rows, staged.join(rows, "c_custkey", "left_semi"), "c_custkey", ["c_acctbal", "c_mktsegment"])


@query("WITH h AS (SELECT doc_id // 100 AS block, doc_id, sha256(array_to_string([doc_id::VARCHAR, coalesce(source, ''), coalesce(text, '')], chr(31))) AS h FROM documents), b AS (SELECT block, count(*) AS n, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM h GROUP BY 1) SELECT sum(n)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY block)) AS digest FROM b")
def ordered_fingerprint(spark, d):
    return relational.ordered_fingerprint(table(spark, d, "documents"), "doc_id", ["source", "text"], 100)


@query("WITH s AS (SELECT o.o_orderkey, count(l.l_orderkey) AS articles, count(*) FILTER (l.l_returnflag = 'R') AS stored, count(*) FILTER (l.l_linestatus = 'F') AS indexed FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1) SELECT count(*) AS issues, sum(articles)::BIGINT AS articles, sum(stored)::BIGINT AS stored, sum(indexed)::BIGINT AS indexed, sum(articles - indexed)::BIGINT AS pending FROM s")
def batch_status(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("s"), F.count_if(F.col("l_linestatus") == "F").alias("i"))
    joined = table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").fillna(0)
    return joined.agg(F.count(F.lit(1)).alias("issues"), F.sum("a").alias("articles"), F.sum("s").alias("stored"), F.sum("i").alias("indexed"), F.sum(F.col("a") - F.col("i")).alias("pending"))


@query("SELECT event_type, count(*) AS events, min(event_id) AS first_id, max(event_id) AS last_id, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def status_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, bool_and(event_type IN ('purchase', 'signup', 'view', 'click')) AS terminal, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors FROM events GROUP BY user_id")
def terminal_check(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_and(F.col("event_type").isin("purchase", "signup", "view", "click")).alias("terminal"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"))


@query("SELECT count(DISTINCT l_orderkey) AS issues, count(DISTINCT l_partkey) AS articles, sum(CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END)::BIGINT AS invalid FROM lineitem")
def shard_audit(spark, d):
    return table(spark, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("issues"), F.countDistinct("l_partkey").alias("articles"), F.sum(F.when(F.col("l_tax") > 0.05, 1).otherwise(0)).alias("invalid"))


@query("SELECT l_suppkey FROM (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1, 2 HAVING count(*) >= 120) GROUP BY l_suppkey HAVING count(*) = 3")
def shared_eligible(spark, d):
    return relational.shared_by_all(table(spark, d, "lineitem"), "l_returnflag", "l_suppkey", 120, ["A", "N", "R"])


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07")
def set_intersection(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.where("l_returnflag = 'A'").select("l_suppkey").intersect(lines.where("l_tax > 0.07").select("l_suppkey"))


@query("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_subtraction(spark, d):
    return table(spark, d, "orders").select("o_custkey").subtract(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")))


@query("SELECT c.c_custkey, m.first_order, o.o_orderstatus AS status FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1) m ON c.c_custkey = m.o_custkey LEFT JOIN orders o ON o.o_orderkey = m.first_order")
def resolved_run(spark, d):
    orders = table(spark, d, "orders")
    first = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order"), F.min_by("o_orderstatus", "o_orderkey").alias("status"))
    return table(spark, d, "customer").select("c_custkey").join(first, "c_custkey", "left")


@query("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_path_filter(spark, d):
    return table(spark, d, "events").where(F.get_json_object("props", "$.k") == "42").select("event_id", "user_id")


@query("SELECT doc_id FROM documents WHERE source = 'src3' UNION SELECT doc_id FROM documents WHERE lang = 'src3' OR lang = 'fr' AND source = 'src4'")
def union_scope(spark, d):
    docs = table(spark, d, "documents")
    return relational.scope_ids(docs.withColumn("title", F.when(F.col("source") == "src4", F.when(F.col("lang") == "fr", "src3")).otherwise(F.col("lang"))), "src3", "doc_id")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS date FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND strftime(o_orderdate, '%Y-%m') >= '1995' AND strftime(o_orderdate, '%Y-%m') <= '1996-06'")
def scope_filter(spark, d):
    issues = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source"), F.lit(None).cast("string").alias("title"), F.date_format("o_orderdate", "yyyy-MM").alias("date"))
    return issues.where(relational.in_scope(["1-URGENT", "2-HIGH"], "1995", "1996-06")).select("o_orderkey", "date")


@query("WITH g AS (SELECT o_custkey, count(*) AS members, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders GROUP BY 1) SELECT c.c_custkey, coalesce(g.members, 0) AS members, CASE WHEN g.lo = g.hi THEN g.lo WHEN g.lo IS NOT NULL THEN 'mixed' END AS origin FROM customer c LEFT JOIN g ON c.c_custkey = g.o_custkey")
def group_summary(spark, d):
    groups = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("members"), relational.mixed(F.min("o_orderstatus"), F.max("o_orderstatus")).alias("o"), F.min("o_orderstatus").alias("lo"))
    return table(spark, d, "customer").select("c_custkey").join(groups, "c_custkey", "left").select("c_custkey", F.coalesce("members", F.lit(0)).alias("members"), F.when(F.col("lo").isNotNull(), F.col("o")).alias("origin"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) > 2000 AND doc_id BETWEEN 50 AND 700")
def oversized_in_range(spark, d):
    return table(spark, d, "documents").where((F.length("text") > 2000) & F.col("doc_id").between(50, 700)).select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE trim(text) <> '' AND lang IS DISTINCT FROM 'en'")
def analysable(spark, d):
    return table(spark, d, "documents").where((F.trim("text") != "") & ~F.col("lang").eqNullSafe(F.lit("en"))).select("doc_id")


# chunks


@query("WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS a FROM documents), c AS (SELECT doc_id, a, unnest(generate_series(0, greatest(0, ceil((len(a) - 100) / 80.0))::BIGINT)) AS k FROM w WHERE len(a) > 0) SELECT doc_id, k::INT AS chunk_index, array_to_string(a[k * 80 + 1 : k * 80 + 100], ' ') AS chunk FROM c")
def chunk_words(spark, d):
    return chunking.explode_chunks(texts(spark, d), "doc_id", chunking.word_windows(F.coalesce("text", F.lit("")), 100, 20))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS a FROM f),
c AS (SELECT doc_id, a, unnest(generate_series(0, greatest(0, ceil((len(a) - 5) / 4.0))::BIGINT)) AS k FROM s WHERE len(a) > 0)
SELECT doc_id, k::INT AS chunk_index, array_to_string(a[k * 4 + 1 : k * 4 + 5], ' ') AS chunk FROM c""")
def chunk_sentences(spark, d):
    return chunking.explode_chunks(texts(spark, d), "doc_id", chunking.sentence_windows(F.coalesce("text", F.lit(""))))


@query(r"""WITH p AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1),
a AS (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM p)
SELECT conv_id, (i - 1)::INT AS chunk_index, a[i] AS chunk FROM a, LATERAL (SELECT unnest(generate_series(1, len(a))) AS i)""")
def chunk_paragraphs(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return chunking.explode_chunks(turns, "conv_id", chunking.paragraphs(F.array_join("t.text", "\n\n")))


@query("SELECT doc_id, 0 AS chunk_index, text AS chunk FROM documents")
def chunk_whole(spark, d):
    return chunking.explode_chunks(table(spark, d, "documents"), "doc_id", chunking.whole(F.col("text")))


@query()
def chunk_token_spans(spark, d):
    docs = texts(spark, d).select(F.col("doc_id").cast("string").alias("newspaper_id"), F.concat(F.lit("d/"), "doc_id").alias("relative_path"), F.coalesce("text", F.lit("")).alias("content"))
    return chunking.chunk_articles(chunking.split_articles(docs), docs)


@query("SELECT conv_id, turn, min(turn) OVER w AS first, max(turn) OVER w AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 PRECEDING AND 2 FOLLOWING)")
def context_frame(spark, d):
    return relational.frames(table(spark, d, "conversations"), "conv_id", "turn", 1, 2, "turn", "turn")


@query("SELECT h.conv_id, h.turn AS hit, c.turn, c.role FROM conversations h JOIN conversations c ON h.conv_id = c.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1 WHERE h.turn = 2")
def context_neighbours(spark, d):
    turns = table(spark, d, "conversations")
    return relational.neighbours(turns, turns.where("turn = 2"), "conv_id", "turn", 1, 1).select("conv_id", "hit", "turn", "role")


@query("SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE role = 'user') WHERE place <> turn")
def contiguity_check(spark, d):
    return relational.gaps(table(spark, d, "conversations").where("role = 'user'"), "conv_id", "turn").select("conv_id", "turn", "place")


@query("WITH s AS (SELECT o_orderpriority AS shard, count(*) AS n FROM orders GROUP BY 1) SELECT shard, n, (sum(n) OVER (ORDER BY shard) - n)::BIGINT AS begins, (sum(n) OVER (ORDER BY shard))::BIGINT AS ends FROM s")
def shard_offsets(spark, d):
    shards = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return relational.cumulative(shards, "shard", "n")


@query("SELECT 'article_' || substr(sha256(source || chr(0) || doc_id::VARCHAR), 1, 24) AS id, doc_id FROM documents")
def stable_ids(spark, d):
    return table(spark, d, "documents").select(stable_id("article", F.col("source"), F.col("doc_id")).alias("id"), "doc_id")


@query("SELECT doc_id, source AS path FROM documents")
def chunk_id_paths(spark, d):
    docs = table(spark, d, "documents")
    own = F.to_json(F.struct(F.lit("x").alias("article"), F.col("doc_id").cast("string").alias("chunk"), F.col("source").alias("path"), F.lit("lectern.chunk.v1").alias("schema")))
    given = F.when(F.col("doc_id") % 3 == 0, own).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("###"), "doc_id")).otherwise(F.col("source"))
    return docs.select("doc_id", chunk_path(given).alias("path"))


# markup

_PLAIN_SQL = "html"
for _pattern, _to in ((r"(?s)```.*?```", ""), (r"`[^`]*`", ""), (r"!\[[^\]]*\][(][^)]*[)]", ""), (r"\[([^\]]+)\][(][^)]*[)]", r"\1"), (r"(?m)^#+\s*", ""), (r"<[^>]+>", ""), (r"\r\n?", "' || chr(10) || '"), (r"[ \t]+", " "), (r"\n{3,}", "' || chr(10) || chr(10) || '"), (r"^\s+|\s+$", "")):
    _PLAIN_SQL = f"regexp_replace({_PLAIN_SQL}, '{_pattern}', '{_to}', 'g')"


@query(f"SELECT page_id, {_PLAIN_SQL} AS plain FROM pages")
def strip_markup(spark, d):
    return texts(spark, d, "pages").select("page_id", plain_text(F.col("html")).alias("plain"))


@query(r"SELECT doc_id, trim(array_to_string(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:2], lambda s: trim(s)), ' ')) AS lead FROM documents")
def lead_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", first_sentences(F.coalesce("text", F.lit("")), 2).alias("lead"))


# vectors

_COSINE = "q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], e) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(e, e)) AS x FROM embeddings, q)"


def _cosines(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings")
    q = vectors.query_vector(rows.where("vec_id = 0").first()["embedding"])
    return vectors.scores(rows, q, "vec_id", "embedding", ["label"])


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.round("score", 5))


@query(f"WITH {_COSINE} SELECT vec_id, label, round(x, 5) AS score FROM s ORDER BY x DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return _rounded(vectors.best(_cosines(spark, d), "vec_id", 10))


@query(f"WITH {_COSINE} SELECT vec_id, label, round(x, 5) AS score FROM s WHERE label IN (1, 3) ORDER BY x DESC, vec_id LIMIT 10 OFFSET 5")
def vector_filtered(spark, d):
    return _rounded(vectors.best(_cosines(spark, d).where(F.col("label").isin(1, 3)), "vec_id", 10, 5))


@query(f"WITH {_COSINE}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x DESC, vec_id) AS k FROM s) SELECT vec_id, label, round(x, 5) AS score FROM r WHERE k = 1 ORDER BY x DESC, vec_id LIMIT 5")
def vector_group_best(spark, d):
    return _rounded(vectors.best_of_groups(_cosines(spark, d), "vec_id", "label", 5))


@query(f"WITH {_COSINE}, c AS (SELECT * FROM s ORDER BY x DESC, vec_id LIMIT 12), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x DESC, vec_id) AS k FROM c) SELECT vec_id, label, round(x, 5) AS score FROM r WHERE k = 1 ORDER BY x DESC, vec_id LIMIT 20")
def vector_capped(spark, d):
    return _rounded(vectors.best_of_groups(_cosines(spark, d), "vec_id", "label", 20, candidates=12))


@query(f"WITH {_COSINE} SELECT vec_id, round(x, 4) AS score FROM (SELECT * FROM s ORDER BY x DESC, vec_id LIMIT 100) ORDER BY x DESC, vec_id LIMIT 10")
def vector_rerank(spark, d):
    rows = table(spark, d, "embeddings")
    q = vectors.query_vector(rows.where("vec_id = 0").first()["embedding"])
    return vectors.rerank(vectors.best(_cosines(spark, d), "vec_id", 100), rows, q, "vec_id", "embedding", 10).withColumn("score", F.round("score", 4))


@query("SELECT count(*) AS vectors, count(*) FILTER (len(embedding) <> 64) AS other_length, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS not_finite, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero FROM embeddings")
def vector_audit(spark, d):
    return vectors.audit(table(spark, d, "embeddings"), "embedding", 64)


@query("SELECT vec_id, round(list_dot_product(v, v), 6) AS length, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS v FROM (SELECT vec_id, embedding[1:16]::DOUBLE[] AS p FROM embeddings))")
def vector_truncated(spark, d):
    v = vectors.normalize(F.col("embedding"), 16)
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("length"), F.round(F.element_at("v", 1), 6).alias("first"))


@query("SELECT vec_id // 100 AS shard, min(vec_id) AS first_vector, count(*) AS vectors, sha256(string_agg('c' || vec_id, ',' ORDER BY vec_id)) AS ids_sha256 FROM embeddings GROUP BY 1")
def shard_ledger(spark, d):
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("shard"), F.col("vec_id").alias("vector_id"), F.concat(F.lit("c"), "vec_id").alias("chunk_id"))
    return shards.ledger(rows)


@query("""WITH v AS (SELECT vec_id AS vector_id, 'c' || (vec_id - vec_id % 7 // 6) AS chunk_id FROM embeddings), c AS (SELECT 'c' || doc_id AS chunk_id FROM documents), n AS (SELECT count(*) AS n FROM v)
SELECT 'vector ids outside 0..n-1' AS "check", count(*) FILTER (vector_id < 0 OR vector_id >= n) AS problems FROM v, n UNION ALL SELECT 'vector ids used twice', count(*) FROM (SELECT vector_id FROM v GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'chunks with two vectors', count(*) FROM (SELECT chunk_id FROM v GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'chunks without a vector', count(*) FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM v) UNION ALL SELECT 'vectors without a chunk', count(*) FROM v WHERE chunk_id NOT IN (SELECT chunk_id FROM c)""")
def vector_id_proof(spark, d):
    v = F.col("vec_id")
    rows = table(spark, d, "embeddings").select(v.alias("vector_id"), F.concat(F.lit("c"), (v - F.floor((v % 7) / 6)).cast("string")).alias("chunk_id"))
    return shards.id_proof(rows, table(spark, d, "documents").select(F.concat(F.lit("c"), "doc_id").alias("chunk_id")))


@query("SELECT vec_id, 4 * len(embedding)::INT AS bytes, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings")
def blob_vectors(spark, d):
    """Vectors to bytes and back."""
    blobs = table(spark, d, "embeddings").select("vec_id", vectors.encode(F.col("embedding")).alias("blob"))
    return blobs.select("vec_id", F.octet_length("blob").alias("bytes"), vectors.decode_float32(F.col("blob")).alias("v")).select("vec_id", "bytes", F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"))


@query()
def vector_cells(spark, d):
    rows = table(spark, d, "embeddings")
    centres, index = vectors.cells(rows, "vec_id", "embedding", 16)
    return _rounded(vectors.search_cells(index, centres, vectors.query_vector(rows.where("vec_id = 0").first()["embedding"]), 6, "vec_id", 10))


@query()
def vector_projection(spark, d):
    return vectors.project(table(spark, d, "embeddings"), "vec_id", "embedding")


# names

_MENTIONS = "m AS (SELECT p_partkey AS article_id, 0 AS entity_index, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, p_brand || ' ' || p_type FROM part), n AS (SELECT lower(text) AS normalized_name, article_id, min(entity_index)::INT AS char_start FROM m GROUP BY 1, 2)"


def _members(spark, d) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, d, "part")
    row = lambda i, t: F.struct(F.lit(i).alias("entity_index"), t.alias("text"), F.lit("ORG").alias("label"), F.lit(i).alias("char_start"), F.lit(i + 1).alias("char_end"))
    mentions = parts.select(F.col("p_partkey").alias("article_id"), F.explode(F.array(row(0, F.col("p_name")), row(1, F.concat("p_brand", F.lit(" "), "p_type")))).alias("m")).select("article_id", "m.*")
    done = parts.select(F.col("p_partkey").alias("article_id"), F.lit("x").alias("content_sha256"))
    return entities.dictionary(mentions, done, F.lower)


@query(f"WITH {_MENTIONS} SELECT normalized_name, count(*) AS article_count FROM n GROUP BY 1")
def name_counts(spark, d):
    return _members(spark, d)[0].select("normalized_name", "article_count")


@query(f"WITH {_MENTIONS} SELECT normalized_name, article_id, char_start FROM n")
def name_memberships(spark, d):
    return _members(spark, d)[1].select("normalized_name", "article_id", "char_start")


@query(f"WITH {_MENTIONS} SELECT normalized_name, count(*) AS article_count FROM n WHERE starts_with(normalized_name, 'red') GROUP BY 1 ORDER BY 1 LIMIT 5")
def name_prefix(spark, d):
    return entities.prefixed(_members(spark, d)[0], "red", 5).select("normalized_name", "article_count")


@query(f"WITH {_MENTIONS}, c AS (SELECT normalized_name, count(*) AS article_count FROM n GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY article_count DESC, normalized_name) AS rank, * FROM c) SELECT * FROM r WHERE rank > 5 AND rank <= 15")
def name_frequency_page(spark, d):
    ranked = relational.global_rank(_members(spark, d)[0].select("normalized_name", "article_count"), [F.desc("article_count"), F.col("normalized_name")], scratch_dir(spark, "ranks"))
    return relational.page(ranked, "rank", 5, 10)


@query(f"WITH {_MENTIONS} SELECT article_id FROM n WHERE normalized_name = 'red widget' AND article_id > 10 ORDER BY 1 LIMIT 7")
def name_articles_page(spark, d):
    articles = table(spark, d, "part").select(F.col("p_partkey").alias("article_id"), F.lit(1).alias("is_valid"), F.lit("").alias("content"))
    members = _members(spark, d)[1].withColumn("content_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return entities.articles_of(members, articles, "Red  Widget", 10, 7).select("article_id")


@query(f"WITH {_MENTIONS}, u AS (SELECT article_id, min(struct_pack(c := char_start, n := normalized_name)) AS f FROM n WHERE normalized_name IN ('red widget', 'blue bolt', 'small ring') GROUP BY 1) SELECT article_id, f.n AS normalized_name, f.c AS char_start FROM u")
def group_articles(spark, d):
    return entities.group_articles(_members(spark, d)[1], ["Red Widget", "Blue bolt", "small ring"])


@query(f"WITH {_MENTIONS}, c AS (SELECT normalized_name, count(*) AS article_count FROM n GROUP BY 1) SELECT normalized_name, article_count, levenshtein(normalized_name, 'red widgat')::INT AS distance FROM c WHERE length(normalized_name) BETWEEN 8 AND 12 AND levenshtein(normalized_name, 'red widgat') <= 2 ORDER BY distance, article_count DESC, normalized_name LIMIT 100")
def fuzzy_names(spark, d):
    return entities.search(_members(spark, d)[0], "Red widgat").select("normalized_name", "article_count", "distance")


@query(f"WITH {_MENTIONS} SELECT lower(text) AS normalized_name, arg_min(text, struct_pack(a := article_id, b := entity_index)) AS name FROM m GROUP BY 1")
def name_spellings(spark, d):
    return _members(spark, d)[0].select("normalized_name", "name")


@query(f"WITH {_MENTIONS}, e AS (SELECT DISTINCT lower(p_name) AS normalized_name, p_partkey + 1 AS article_id FROM part UNION SELECT 'no such name', 5) SELECT e.*, normalized_name NOT IN (SELECT normalized_name FROM n) AS name_missing FROM e WHERE (normalized_name, article_id) NOT IN (SELECT (normalized_name, article_id) FROM n)")
def missing_memberships(spark, d):
    expected = table(spark, d, "part").select(F.lower("p_name").alias("normalized_name"), (F.col("p_partkey") + 1).alias("article_id")).union(spark.createDataFrame([("no such name", 5)], "n string, a long"))
    return entities.missing_memberships(expected, *_members(spark, d))


_GROUPS = "g AS (SELECT p_size AS group_id, CASE WHEN p_size = 7 THEN 'Red Widgets' WHEN p_size % 2 = 0 THEN min(p_name) ELSE upper(min(p_name)) || ' & CO' END AS preferred, CASE WHEN p_size % 3 > 0 THEN count(*) END AS article_count FROM part GROUP BY 1), mb AS (SELECT lower(p_name) AS name, min(p_size) AS group_id FROM part WHERE p_size > 20 GROUP BY 1)"


def _discovery_sql(wanted: str, prefix: bool, most: int) -> str:
    like = f"starts_with({{}}, '{wanted}')" if prefix else f"{{}} = '{wanted}'"
    near = f"length(normalized_name) BETWEEN {len(wanted) - most} AND {len(wanted) + most} AND levenshtein(normalized_name, '{wanted}') <= {most}"
    return f"""WITH {_MENTIONS}, c AS (SELECT normalized_name, count(*) AS article_count FROM n GROUP BY 1), {_GROUPS},
own AS (SELECT 0 AS tier, 0 AS distance, NULL::BIGINT AS cnt, lower(preferred) AS key, NULL::VARCHAR AS matched, group_id FROM g WHERE {like.format('lower(preferred)')} ORDER BY 4, 6 LIMIT 100),
lit AS (SELECT normalized_name, article_count, 0 AS distance FROM c WHERE {like.format('normalized_name')} AND EXISTS (SELECT 1 FROM own) ORDER BY 1 LIMIT 100),
fuzzy AS (SELECT normalized_name, article_count, {f"0" if prefix else f"levenshtein(normalized_name, '{wanted}')"} AS distance FROM c WHERE {like.format('normalized_name') if prefix else near} AND NOT EXISTS (SELECT 1 FROM own) ORDER BY distance, article_count DESC, normalized_name LIMIT 100),
r AS (SELECT * FROM own UNION ALL SELECT 1, distance, article_count, normalized_name, normalized_name, mb.group_id FROM (SELECT * FROM lit UNION ALL SELECT * FROM fuzzy) x LEFT JOIN mb ON mb.name = x.normalized_name),
m2 AS (SELECT *, row_number() OVER (ORDER BY tier, distance, cnt DESC NULLS LAST, key, group_id) AS met FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY coalesce(group_id::VARCHAR, 'name:' || matched) ORDER BY met) AS turn FROM m2)
SELECT CASE WHEN t.group_id IS NOT NULL THEN preferred ELSE matched END AS name, t.group_id, CASE WHEN t.group_id IS NOT NULL THEN matched END AS matched_name, CASE WHEN t.group_id IS NOT NULL THEN article_count ELSE cnt END AS article_count, distance::INT AS distance, (row_number() OVER (ORDER BY met))::INT AS place FROM t LEFT JOIN g ON g.group_id = t.group_id WHERE turn = 1 QUALIFY place <= 100"""


def _discovered(spark, d, wanted: str) -> DataFrame:
    parts = table(spark, d, "part")
    size, least = F.col("p_size"), F.min("p_name")
    preferred = F.when(size == 7, "Red Widgets").when(size % 2 == 0, least).otherwise(F.concat(F.upper(least), F.lit(" & CO")))
    groups = parts.groupBy("p_size").agg(preferred.alias("preferred"), F.when(size % 3 > 0, F.count(F.lit(1))).alias("article_count")).withColumnRenamed("p_size", "group_id")
    members = parts.where("p_size > 20").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_size").alias("group_id"))
    return entities.discover(_members(spark, d)[0], groups, members, wanted)


@query(_discovery_sql("red widgets", False, 2))
def curated_discovery(spark, d):
    """A preferred name, in the place of near ones."""
    return _discovered(spark, d, "Red  widgets")


@query(_discovery_sql("blue", True, 0))
def curated_discovery_prefix(spark, d):
    return _discovered(spark, d, "Blue*")


@query(_discovery_sql("rad widgit", False, 2))
def curated_discovery_near(spark, d):
    """No preferred name is near enough: names by distance, those in groups as their groups."""
    return _discovered(spark, d, "rad widgit")


@query(f"WITH {_MENTIONS}, c AS (SELECT normalized_name, count(*) AS article_count FROM n GROUP BY 1), {_GROUPS} SELECT normalized_name, article_count FROM c WHERE normalized_name NOT IN (SELECT name FROM mb) AND normalized_name LIKE '%b%' ORDER BY article_count DESC, normalized_name LIMIT 8")
def discovery_frontier(spark, d):
    names = _members(spark, d)[0].select("normalized_name", "article_count")
    grouped = table(spark, d, "part").where("p_size > 20").select(F.lower("p_name").alias("normalized_name")).distinct()
    queue = names.select("normalized_name", F.when(F.contains("normalized_name", F.lit("b")), "queued").otherwise("done").alias("state"))
    return entities.frontier(names, grouped, queue, 8)


_LETTERS = "l AS (SELECT name, cnt, regexp_replace(name, '[^a-z0-9]+', '', 'g') AS letters, replace(translate(regexp_replace(name, '[^a-z0-9]+', '', 'g'), 'l10', 'iio'), 'rn', 'm') AS sig FROM x)"


@query(f"""WITH x AS (SELECT lower(p_name) AS name, count(*) * 10 AS cnt FROM part GROUP BY 1 UNION ALL SELECT DISTINCT replace(lower(p_name), ' ', '-'), 2 FROM part UNION ALL SELECT DISTINCT replace(lower(p_name), 'l', '1') || ' x', 1 FROM part UNION ALL SELECT DISTINCT lower(p_name) || ' x', 60 FROM part), {_LETTERS},
e AS (SELECT letters, min(name) AS a FROM l WHERE length(letters) >= 4 GROUP BY 1 HAVING count(*) > 1),
top AS (SELECT sig, arg_max(struct_pack(name, letters, cnt), struct_pack(cnt, name)) AS t FROM l WHERE length(letters) >= 8 GROUP BY 1)
SELECT DISTINCT a, b FROM (SELECT e.a, l.name AS b FROM l JOIN e USING (letters) WHERE l.name <> e.a
UNION ALL SELECT least(l.name, t.name), greatest(l.name, t.name) FROM l JOIN top USING (sig) WHERE length(l.letters) >= 8 AND t.cnt >= 10 AND l.letters <> t.letters AND l.letters[1] = t.letters[1] AND t.cnt >= 5 * greatest(1, l.cnt))""")
def ocr_policy_pairs(spark, d):
    own = table(spark, d, "part").groupBy(F.lower("p_name").alias("n")).agg((F.count(F.lit(1)) * 10).alias("c"))
    other = [own.select(F.replace("n", F.lit(" "), F.lit("-")), F.lit(2).cast("long")).distinct(), own.select(F.concat(F.replace("n", F.lit("l"), F.lit("1")), F.lit(" x")), F.lit(1).cast("long")).distinct(), own.select(F.concat("n", F.lit(" x")), F.lit(60).cast("long")).distinct()]
    names = own.union(other[0]).union(other[1]).union(other[2]).toDF("normalized_name", "article_count")
    return entities.policy_pairs(names)


@query("SELECT key, count(*) AS names, min(p_name) AS first_name FROM (SELECT p_name, translate(replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), 'rn', 'm'), 'l10', 'iio') AS key FROM part) GROUP BY 1")
def ocr_key_groups(spark, d):
    from lectern.functions.text import ocr_key_col

    return table(spark, d, "part").groupBy(ocr_key_col("p_name").alias("key")).agg(F.count(F.lit(1)).alias("names"), F.min("p_name").alias("first_name"))


@query("WITH r AS (SELECT p_brand, p_type, p_size, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) AS turn FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY turn, p_size, p_partkey) AS place FROM r) SELECT p_brand, p_type, p_size, p_partkey, place::INT AS place FROM o WHERE place <= 3")
def evidence_spread(spark, d):
    return relational.spread(table(spark, d, "part").select("p_brand", "p_type", "p_size", "p_partkey"), "p_brand", ["p_type"], ["p_size", "p_partkey"], 3)


@query("WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, arg_min(p_name, struct_pack(a := -n, b := p_name)) AS representative FROM c GROUP BY 1")
def representatives(spark, d):
    counts = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    return relational.first_of_group(counts, "p_brand", F.desc("n"), "p_name").select("p_brand", F.col("p_name").alias("representative"))


# statistics and samples


@query("SELECT l_returnflag, l_linestatus, count(*) AS runs, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS deviation, round(sum(l_linenumber) / sum(l_quantity), 9) AS articles_a_second FROM lineitem GROUP BY 1, 2")
def stats_by_config(spark, d):
    runs = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("seconds"), F.col("l_linenumber").alias("articles"))
    return alignment.run_summary(runs).select("l_returnflag", "l_linestatus", "runs", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), F.round("articles_a_second", 9).alias("articles_a_second"))


@query("SELECT event_type, count(*) AS runs, round(sum(user_id) / sum(value), 6) AS documents_a_second, round(sum(event_id) / sum(value), 6) AS tokens_a_second, round(max(user_id / value), 6) AS best FROM events WHERE value > 0 GROUP BY 1")
def run_throughput(spark, d):
    runs = table(spark, d, "events").select("event_type", F.col("user_id").alias("documents"), F.col("event_id").alias("tokens"), F.col("value").alias("seconds"))
    found = alignment.throughput(runs, ["event_type"])
    return found.select("event_type", "runs", *[F.round(c, 6).alias(c) for c in ("documents_a_second", "tokens_a_second", "best")])


@query("SELECT user_id AS job_id, count(*) AS items, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, bool_and(event_type IN ('purchase', 'error', 'view')) AS terminal FROM events GROUP BY 1")
def job_status(spark, d):
    kind = F.col("event_type")
    items = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "view", "expired").otherwise("running").alias("status"))
    return requests.job_status(items)


@query("WITH a AS (SELECT DISTINCT p_partkey AS article_id, p_size AS s, p_size + 3 AS e, p_type AS label FROM part WHERE p_type IN ('ECONOMY', 'SMALL')), b AS (SELECT DISTINCT p_partkey AS article_id, p_size + p_partkey % 2 AS s, p_size + 3 AS e, CASE WHEN p_partkey % 5 = 0 THEN 'SMALL' ELSE p_type END AS label FROM part), c AS (SELECT * FROM b WHERE label IN ('ECONOMY', 'SMALL')), l AS (SELECT article_id, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM c) GROUP BY 1), r AS (SELECT article_id, count(*) AS n FROM (SELECT * FROM c EXCEPT SELECT * FROM a) GROUP BY 1) SELECT coalesce(l.article_id, r.article_id) AS article_id, coalesce(l.n, 0) AS only_left, coalesce(r.n, 0) AS only_right FROM l FULL JOIN r ON l.article_id = r.article_id")
def disagreement_report(spark, d):
    parts = table(spark, d, "part")
    left = parts.select(F.col("p_partkey").alias("article_id"), F.col("p_size").alias("char_start"), (F.col("p_size") + 3).alias("char_end"), F.col("p_type").alias("label"))
    right = parts.select(F.col("p_partkey").alias("article_id"), (F.col("p_size") + F.col("p_partkey") % 2).cast("int").alias("char_start"), (F.col("p_size") + 3).alias("char_end"), F.when(F.col("p_partkey") % 5 == 0, "SMALL").otherwise(F.col("p_type")).alias("label"))
    return alignment.disagreements(left, right, ["ECONOMY", "SMALL"])


@query("SELECT lang, CASE WHEN length(text) < 1000 THEN '<1k' WHEN length(text) < 5000 THEN '1k-5k' ELSE '>=5k' END AS bucket, count(*) AS documents FROM documents GROUP BY 1, 2")
def length_histogram(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").groupBy("lang", F.when(n < 1000, "<1k").when(n < 5000, "1k-5k").otherwise(">=5k").alias("bucket")).agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT (year(o_orderdate) // 10 * 10)::INT AS decade, o_orderpriority AS newspaper, count(*) AS issues FROM orders GROUP BY 1, 2")
def decade_histogram(spark, d):
    return table(spark, d, "orders").groupBy((F.floor(F.year("o_orderdate") / 10) * 10).cast("int").alias("decade"), F.col("o_orderpriority").alias("newspaper")).agg(F.count(F.lit(1)).alias("issues"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def reservoir_sample(spark, d):
    return relational.md5_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("WITH n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT DISTINCT floor(i * ((n - 1) / 36.0))::BIGINT AS vec_id FROM n, LATERAL (SELECT unnest(generate_series(0, 36)) AS i)) SELECT e.vec_id FROM embeddings e JOIN s USING (vec_id)")
def training_sample(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id")
    return relational.spaced_sample(rows, "vec_id", rows.count(), 37)


@query("SELECT n_regionkey AS group_id, a.n_name AS a, b.n_name AS b FROM (SELECT * FROM nation) a JOIN nation b USING (n_regionkey) WHERE a.n_name < b.n_name AND a.n_nationkey + b.n_nationkey > 20")
def rejected_pairs(spark, d):
    nations = table(spark, d, "nation")
    a, b = (nations.select(F.col("n_regionkey").alias("group_id"), F.col("n_name").alias(x), F.col("n_nationkey").alias("k" + x)) for x in "ab")
    return a.join(b, "group_id").where("a < b and ka + kb > 20").select("group_id", "a", "b")


_REDIRECTS = "r AS (SELECT n_nationkey AS old, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey - 3 ELSE n_nationkey - 1 END AS new FROM nation WHERE n_nationkey > 6 UNION ALL SELECT 5, 6 UNION ALL SELECT 6, 5)"


@query(f"WITH RECURSIVE {_REDIRECTS}, walk AS (SELECT DISTINCT s_nationkey AS g, s_nationkey AS node, 0 AS hops FROM supplier UNION ALL SELECT g, r.new, hops + 1 FROM walk JOIN r ON node = r.old WHERE hops < 101), ends AS (SELECT g, arg_max(node, hops) AS node, max(hops) AS hops FROM walk GROUP BY g) SELECT s_suppkey, CASE WHEN hops <= 100 THEN node END AS canonical_id FROM supplier JOIN ends ON s_nationkey = g")
def redirected_groups(spark, d):
    """Chains of several redirects, some of which end in a circle of two."""
    key = F.col("n_nationkey")
    redirects = table(spark, d, "nation").where("n_nationkey > 6").select(key.alias("old"), F.when(key % 2 == 0, key - 3).otherwise(key - 1).alias("new")).union(spark.createDataFrame([(5, 6), (6, 5)], "old int, new int"))
    groups = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("group_id"))
    return groups.join(entities.resolve_redirects(groups.select("group_id").distinct(), redirects, scratch_dir(spark, "redirects")), "group_id").select("s_suppkey", "canonical_id")


@query("SELECT r.r_name, n.n_name, count(DISTINCT o.o_orderkey) AS issues, count(*) AS articles FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE l.l_returnflag = 'R' GROUP BY 1, 2")
def hierarchy_rollup(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    by_customer = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("issues"), F.sum("n").alias("articles"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = by_customer.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.sum("issues").alias("issues"), F.sum("articles").alias("articles"))


@query("SELECT b.item_id, count(*) AS documents, min(d.doc_id) AS first_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def contained_passages(spark, d):
    return _contained(texts(spark, d), table(spark, d, "benchmark"))


#: Passages without a key that one pass over the documents looks for.
PASSAGES_A_PASS = 1000


def _contained(docs: DataFrame, items: DataFrame, width: int = 24) -> DataFrame:
    """Passages that documents hold word for word. Both sides meet at hashes of ``width`` characters: all of
    a document's windows would be many, so those that begin a word are taken, and a passage's first one.
    Passages that have none, as they are short or have no spaces, are looked for in each document, so many a pass."""
    begins = lambda t: F.regexp_extract_all(t, F.lit(rf"(?s)(?<![^\s])(?=(\S.{{{width - 1}}}))"), 1)
    inner = F.when(F.instr("text", " ") > 0, F.expr("substring(text, instr(text, ' ') + 1)"))
    keyed = items.where("text is not null").select("item_id", F.col("text").alias("passage"), F.try_element_at(begins(inner), F.lit(1)).alias("key"))
    first = keyed.where("key is not null")
    windows = docs.select("doc_id", "text", F.explode(F.array_distinct(begins(F.col("text")))).alias("key"))
    hits = windows.join(first, "key").where(F.contains("text", "passage")).select("item_id", "doc_id").distinct()
    held: list[tuple] = []

    def looked_for() -> DataFrame:
        passages = F.array(*[F.struct(F.lit(i).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(p).alias("passage")) for i, p in held])
        found = docs.select("doc_id", F.explode(F.filter(passages, lambda x: F.contains("text", x["passage"]))).alias("x"))
        return found.select("x.item_id", "doc_id")

    for r in keyed.where("key is null").select("item_id", "passage").toLocalIterator():
        held.append((r["item_id"], r["passage"]))
        if len(held) == PASSAGES_A_PASS:
            hits, held = hits.unionByName(looked_for()), []
    if held:
        hits = hits.unionByName(looked_for())
    return hits.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_id"))


# event windows: the streaming queries' batch results


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begins, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("begins"), "event_type", "events", "total")


@query("WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m) SELECT user_id, min(ts) AS begins, count(*) AS events FROM s GROUP BY user_id, k")
def events_sessions(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("begins"), "events")


@query("""WITH RECURSIVE d AS (SELECT doc_id, doc_id // 500 AS block, strlen(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS i FROM documents),
walk AS (SELECT doc_id, block, i, block * 1048576 AS request, 0 AS place, n AS size FROM d WHERE i = 1
  UNION ALL SELECT d.doc_id, d.block, d.i, CASE WHEN w.place + 1 = 16 OR w.size + d.n > 60000 THEN w.request + 1 ELSE w.request END, CASE WHEN w.place + 1 = 16 OR w.size + d.n > 60000 THEN 0 ELSE w.place + 1 END, CASE WHEN w.place + 1 = 16 OR w.size + d.n > 60000 THEN d.n ELSE w.size + d.n END FROM walk w JOIN d ON d.block = w.block AND d.i = w.i + 1)
SELECT doc_id, request::BIGINT AS request, place::INT AS place FROM walk""")
def request_packing(spark, d):
    return requests.pack_requests(table(spark, d, "documents"), "doc_id", "text", 16, 60_000, 500)
