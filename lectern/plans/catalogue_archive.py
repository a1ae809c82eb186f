"""Queries of a whole archive, built from the shared tables: issues to articles to chunks, batches and their status,
audits, an index that grows, hits with their snippets, Markdown files and manifests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import ascii_tokens
from lectern.operators import chunking, entities, lexical, relational, snippets
from lectern.plans import baseline, models
from lectern.plans.curation import Curation
from lectern.plans.engine import Engine
from lectern.plans.ledger import Archive
from lectern.plans.registry import once, query, table, texts
from lectern.plans.scratch import scratch_dir
from lectern.sources import markdown

#: An issue for each conversation: a heading for each turn, and the turn's text.
_MARKDOWN = "m AS (SELECT conv_id, 'conv/' || conv_id || '.md' AS path, string_agg('# ' || role || ' ' || turn || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1)"
_ARTICLES = r"""t AS (SELECT conv_id, 'conv/' || conv_id || '.md' AS path, turn, role || ' ' || turn AS title, '# ' || role || ' ' || turn || chr(10) || chr(10) AS head, coalesce(text, '') AS body FROM conversations),
u AS (SELECT *, coalesce(sum(length(head) + length(body) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, regexp_extract(body, '^\s*', 0) AS lead, regexp_replace(body, '^\s+|\s+$', '', 'g') AS content FROM t),
a AS (SELECT conv_id, path, title, content, char_start, char_start + length(head) + length(lead) AS content_start, char_start + length(head) + length(lead) + length(content) AS char_end, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS article_index FROM u WHERE content <> ''),
b AS (SELECT *, 'article_' || substr(sha256(path || chr(0) || char_start || chr(0) || char_end), 1, 24) AS article_id FROM a)"""
_LINE = "length(substr({0}, 1, {1}::BIGINT)) - length(replace(substr({0}, 1, {1}::BIGINT), chr(10), '')) + 1"
COUNT, OVERLAP = 40, 10


def _issues(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations")
    part = F.concat(F.lit("# "), "role", F.lit(" "), "turn", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))).alias("p"))
    return gathered.select("conv_id", F.concat(F.lit("conv/"), "conv_id", F.lit(".md")).alias("relative_path"), F.array_join("p.part", "\n\n").alias("content"))


def _batch(spark, d) -> DataFrame:
    record = F.concat(F.lit('{"Record":{"date":"19'), F.lpad((F.col("conv_id") % 100).cast("string"), 2, "0"), F.lit('","source":"Paper '), (F.col("conv_id") % 3).cast("string"), F.lit('","identifier":"URN:NBN:SI:doc-'), "conv_id", F.lit('"}}'))
    rows = _issues(spark, d).withColumn("metadata_json", record)
    return rows.select("relative_path", "content", "metadata_json", F.sha2(F.col("metadata_json").cast("binary"), 256).alias("metadata_sha256"), F.lit(None).cast("string").alias("error"))


def _archive(spark, d) -> Archive:
    def make() -> Archive:
        archive = Archive(spark, scratch_dir(spark, "archive"))
        archive.run(_batch(spark, d).where("relative_path < 'conv/5'"), "first", count=COUNT, overlap=OVERLAP)
        archive.run(_batch(spark, d).where("relative_path >= 'conv/5'"), "second", count=COUNT, overlap=OVERLAP)
        return archive

    return once(spark, d, "archive", make)


@query(f"WITH {_MARKDOWN}, {_ARTICLES} SELECT article_id, title, b.content, article_index::INT AS article_index, char_start::INT AS char_start, char_end::INT AS char_end, content_start::INT AS content_start, ({_LINE.format('m.content', 'char_start')})::INT AS line_start, ({_LINE.format('m.content', '(char_end - 1)')})::INT AS line_end FROM b JOIN m USING (conv_id)")
def archive_articles(spark, d):
    """Both batches' articles as the archive stores them."""
    return _archive(spark, d).read("articles", chunking.ARTICLES).drop("newspaper_id", "is_valid")


_WORDS = r"[^ \t\n\x0b\x0c\r]+"


@query(rf"""WITH {_MARKDOWN}, {_ARTICLES},
g AS (SELECT article_id, conv_id, content_start, regexp_extract_all(content, '{_WORDS}') AS w, regexp_split_to_array(content, '{_WORDS}') AS p FROM b),
e AS (SELECT article_id, conv_id, content_start, len(w) AS n, i, length(p[i]) AS gap, length(w[i]) AS size FROM g, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i)),
q AS (SELECT *, sum(gap + size) OVER (PARTITION BY article_id ORDER BY i) AS stop FROM e),
k AS (SELECT DISTINCT article_id, conv_id, content_start, n, unnest(generate_series(0, greatest(0, ceil((n - {COUNT}) / {COUNT - OVERLAP}.0))::BIGINT)) AS chunk_index FROM q),
c AS (SELECT k.article_id, k.conv_id, chunk_index, min(k.content_start + stop - size) AS char_start, max(k.content_start + stop) AS char_end FROM k JOIN q ON q.article_id = k.article_id AND i BETWEEN chunk_index * {COUNT - OVERLAP} + 1 AND chunk_index * {COUNT - OVERLAP} + {COUNT} GROUP BY 1, 2, 3)
SELECT c.article_id, 'chunk_' || substr(sha256(c.article_id || chr(0) || chunk_index || chr(0) || char_start::BIGINT || chr(0) || char_end::BIGINT), 1, 24) AS chunk_id, chunk_index::INT AS chunk_index, substr(m.content, char_start::BIGINT + 1, (char_end - char_start)::BIGINT) AS text, char_start::INT AS char_start, char_end::INT AS char_end, ({_LINE.format('m.content', 'char_start')})::INT AS line_start, ({_LINE.format('m.content', '(char_end - 1)')})::INT AS line_end FROM c JOIN m USING (conv_id)""")
def archive_chunks(spark, d):
    return _archive(spark, d).read("chunks", chunking.CHUNKS)


@query("WITH s AS (SELECT count(DISTINCT conv_id) AS n FROM conversations WHERE 'conv/' || conv_id || '.md' >= 'conv/5') SELECT stage, n AS completed, 0::BIGINT AS pending FROM s, (VALUES ('issues'), ('articles'), ('chunks')) v(stage)")
def archive_status(spark, d):
    return _archive(spark, d).status("second")


@query("SELECT * FROM (VALUES ('articles without an issue', 0::BIGINT), ('articles that their issue doesn''t give', 0), ('articles that are missing', 0), ('articles that differ from their span', 0), ('chunks without an article', 0), ('chunks out of order', 0), ('chunk ids used twice', 0)) v(\"check\", problems)")
def archive_audit(spark, d):
    return _archive(spark, d).audit()


@query("SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'conflict' WHEN conv_id % 5 = 1 THEN 'metadata_changed' WHEN conv_id % 5 = 2 THEN 'invalid' WHEN conv_id % 5 = 3 THEN 'new' ELSE 'unchanged' END AS action FROM (SELECT DISTINCT conv_id FROM conversations)")
def archive_plan(spark, d):
    """A third batch: changed texts, changed metadata, unreadable files, new issues and known ones."""
    kind = F.regexp_extract("relative_path", r"(\d+)", 1).cast("long") % 5
    rows = _batch(spark, d)
    changed = rows.select(
        F.when(kind == 3, F.concat(F.lit("new/"), "relative_path")).otherwise(F.col("relative_path")).alias("relative_path"),
        F.when(kind == 0, F.concat("content", F.lit(" more"))).otherwise(F.col("content")).alias("content"),
        F.when(kind == 1, F.replace("metadata_json", F.lit("Paper"), F.lit("Daily"))).when(kind == 3, F.replace("metadata_json", F.lit("doc-"), F.lit("new-"))).otherwise(F.col("metadata_json")).alias("metadata_json"),
        F.when(kind == 2, "hash").alias("error"),
    ).withColumn("metadata_sha256", F.sha2(F.col("metadata_json").cast("binary"), 256))
    found = _archive(spark, d).plan(changed)
    return found.select(F.regexp_extract("relative_path", r"(\d+)", 1).cast("long").alias("conv_id"), "action")


_INDEXED = "x AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN doc_id % 10 = 3 THEN 'queen ' || coalesce(text, '') ELSE coalesce(text, '') END), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id % 10 <> 7), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM x), h AS (SELECT *, len(list_filter(w, lambda t: t = 'queen')) AS f FROM x), k AS (SELECT count(*) FILTER (f > 0) AS df FROM h)"


@query(f"WITH {_INDEXED} SELECT doc_id, round((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / a)), 6) AS score FROM h, s, k WHERE f > 0")
def index_append_and_repair(spark, d):
    """Half of the documents, then the others, then some with new texts, then some taken out."""
    docs = texts(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = scratch_dir(spark, "grown-index")
    how = {"title_col": None, "tokens": ascii_tokens}
    lexical.build_index(docs.where("doc_id % 2 = 0"), path, **how)
    lexical.append_index(docs, path, **how)
    lexical.append_index(docs, path, **how)
    changed = docs.where("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("queen "), "text"))
    lexical.repair_index(changed, path, **how)
    lexical.drop_from_index(spark, path, docs.where("doc_id % 10 = 7"))
    return lexical.bm25(lexical.open_index(spark, path), "queen").select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_MARKDOWN}, {_ARTICLES}, f AS (SELECT *, instr(content, 'que') AS p FROM b WHERE contains(content, 'que')) SELECT article_id, 'Paper ' || conv_id % 3 AS newspaper, '19' || lpad((conv_id % 100)::VARCHAR, 2, '0') AS date, title, conv_id::VARCHAR AS document_id, 1.0::DOUBLE AS score FROM f WHERE '19' || lpad((conv_id % 100)::VARCHAR, 2, '0') >= '1930' AND conv_id % 3 = 1 ORDER BY article_id LIMIT 15")
def engine_regex_hits(spark, d):
    archive = _archive(spark, d)
    articles = archive.read("articles", chunking.ARTICLES).withColumn("is_valid", F.lit(1))
    engine = Engine(archive.current_issues(), articles)
    hits = engine.search("regex", "que", limit=15, newspaper="Paper 1", date_from="1930")
    rows = [(h.article_id, h.newspaper, h.date, h.title, h.document_id, h.score) for h in hits]
    return spark.createDataFrame(rows, "article_id string, newspaper string, date string, title string, document_id string, score double")


@query(f"WITH {_MARKDOWN} SELECT conv_id, {_LINE.format('content', 'length(content) // 2')} AS line, split_part(content, chr(10), ({_LINE.format('content', 'length(content) // 2')})::BIGINT) || chr(10) AS text, {_LINE.format('content', 'length(content) // 2')} > 1 AS has_before FROM m WHERE ({_LINE.format('content', 'length(content) // 2')}) < length(content) - length(replace(content, chr(10), '')) + 1")
def source_lines(spark, d):
    """The line in the middle of each issue."""
    read = F.udf(lambda source, line: snippets.read_lines(source, line, line, 1_000_000), "struct<text:string,has_before:boolean,has_after:boolean>")
    issues = _issues(spark, d)
    at = F.expr("substring(content, 1, cast(length(content) / 2 as int))")
    rows = issues.withColumn("line", F.length(at) - F.length(F.replace(at, F.lit("\n"))) + 1).withColumn("r", read("content", "line"))
    return rows.where("r.has_after").select("conv_id", F.col("line").cast("long").alias("line"), "r.text", "r.has_before")


def _written(spark, d) -> str:
    """The issues as Markdown files with sidecars, in folders named like newspapers."""

    def make() -> str:
        folder = scratch_dir(spark, "issues").removeprefix("file://")

        def write(batches):
            from pyarrow import fs

            files = fs.LocalFileSystem()
            for batch in batches:
                for i, path, content, record in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "relative_path", "content", "metadata_json"))):
                    base = f"{folder}/Paper_{i % 3}"
                    files.create_dir(base, recursive=True)
                    named = {f"{base}/{i}.md": content.replace("\n", "\r\n") if i % 2 else content} | ({f"{base}/{i}_metadata.json": record} if i % 4 else {f"{base}/{i}_metadata.md": "# no issue"})
                    for name, text in named.items():
                        with files.open_output_stream(name) as out:
                            out.write(text.encode())
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

        rows = _issues(spark, d).join(_batch(spark, d).select("relative_path", "metadata_json"), "relative_path").select("conv_id", "relative_path", "content", "metadata_json")
        rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
        return folder

    return once(spark, d, "issue files", make)


@query(f"WITH {_MARKDOWN} SELECT 'Paper_' || conv_id % 3 || '/' || conv_id || '.md' AS relative_path, content, 'Paper ' || conv_id % 3 AS newspaper, CASE WHEN conv_id % 4 > 0 THEN '19' || lpad((conv_id % 100)::VARCHAR, 2, '0') END AS date, CASE WHEN conv_id % 4 > 0 THEN 'URN:NBN:SI:doc-' || conv_id END AS urn, 'newspaper_' || substr(sha256('Paper_' || conv_id % 3 || '/' || conv_id || '.md'), 1, 24) AS newspaper_id FROM m")
def markdown_scan(spark, d):
    """Read back from files: line ends made alike, sidecars joined, newspapers named by their folders."""
    return markdown.read_issues(spark, _written(spark, d)).select("relative_path", "content", "newspaper", "date", "urn", "newspaper_id")


@query(f"WITH {_MARKDOWN} SELECT conv_id::VARCHAR AS relative_path, CASE conv_id % 5 WHEN 0 THEN 'hash' WHEN 1 THEN 'missing' END AS error, CASE WHEN conv_id % 5 > 1 THEN content END AS content FROM m")
def manifest_batch(spark, d):
    """A manifest's files, some of which have another hash or aren't there."""
    import hashlib

    rows = _issues(spark, d).collect()
    digest = lambda r: hashlib.sha256((r.content.replace("\n", "\r\n") if r.conv_id % 2 else r.content).encode()).hexdigest()
    issues = [markdown.BatchIssue(str(r.conv_id), f"Paper_{r.conv_id % 3}/{r.conv_id}.md" if r.conv_id % 5 != 1 else f"none/{r.conv_id}.md", None, digest(r) if r.conv_id % 5 else "0" * 64, None) for r in rows]
    return markdown.read_batch(spark, _written(spark, d), "batch", issues).select("relative_path", "error", "content")


@query(f"WITH {_MARKDOWN} SELECT 'newspaper_' || substr(sha256(path), 1, 24) AS newspaper_id, sha256(content) AS content_sha256, 'Paper ' || conv_id % 3 AS source, '19' || lpad((conv_id % 100)::VARCHAR, 2, '0') AS date, 'urn:nbn:si:doc-' || conv_id AS identifier FROM m")
def archive_issues(spark, d):
    """Issues with the columns of their metadata and the identifiers they own."""
    rows = _archive(spark, d).current_issues()
    return rows.select("newspaper_id", "content_sha256", "source", "date", F.element_at("identifiers", 1).alias("identifier"))




_CHECKS = {
    "issues": ("issues that differ from their digest", "identifiers of two issues"),
    "articles": ("articles without an issue", "articles that their issue doesn''t give", "articles that are missing", "articles that differ from their span"),
    "chunks": ("chunks without an article", "chunks out of order", "chunk ids used twice"),
    "lexical": ("articles that aren''t indexed", "indexed documents without an article", "documents indexed twice", "documents of another length"),
    "vectors": ("vector ids outside 0..n-1", "vector ids used twice", "chunks with two vectors", "chunks without a vector", "vectors without a chunk", "vectors of another dimension", "vectors that aren''t at length 1", "vectors of another text"),
    "mentions": ("articles that weren''t looked at", "completions without an article", "completions of another text", "completions of another number", "mentions without a completion", "mentions that aren''t in the text", "labels that are blank or scores that aren''t finite"),
    "dictionary": ("memberships that are missing", "memberships without a mention", "memberships of another place or text", "names that are missing", "names without a mention", "names of another count"),
}
_ROWS = ", ".join(f"('{stage}', '{check}')" for stage, checks in _CHECKS.items() for check in checks)


def _stages(spark, d) -> tuple:
    """Index, vectors, mentions and dictionary of the archive, with articles under numbers as ids."""

    def make() -> tuple:
        archive = _archive(spark, d)
        articles = archive.read("articles", chunking.ARTICLES).withColumn("is_valid", F.lit(1))
        chunks = archive.read("chunks", chunking.CHUNKS)
        path = scratch_dir(spark, "stages")
        lexical.build_index(articles, f"{path}/index", "article_id", "title", "content")
        relational.global_rank(articles.select("article_id", "content", "is_valid"), [F.col("article_id")], f"{path}/article_ranks").select(F.col("rank").alias("article_id"), "content", "is_valid").write.parquet(f"{path}/articles")
        numbered = spark.read.parquet(f"{path}/articles")
        entities.extract(numbered).write.parquet(f"{path}/mentions")
        mentions = spark.read.parquet(f"{path}/mentions")
        embedded = models.embed(chunks.select("chunk_id", "text")).where("is_valid = 1").join(chunks.select("chunk_id", baseline.content_digest("text").alias("text_sha256")), "chunk_id")
        ranked = relational.global_rank(embedded, [F.col("chunk_id")], f"{path}/vectors")
        vectors = ranked.select((F.col("rank") - 1).alias("vector_id"), "chunk_id", "text_sha256", "embedding")
        return archive, articles, numbered, chunks, spark.read.parquet(f"{path}/index/documents"), mentions, entities.completions(numbered, mentions), vectors

    return once(spark, d, "stages", make)


@query(f"SELECT *, 0::BIGINT AS problems FROM (VALUES {_ROWS}) v(stage, \"check\")")
def stage_audits(spark, d):
    """All seven stages, none of which has a problem."""
    archive, articles, numbered, chunks, documents, mentions, done, vectors = _stages(spark, d)
    names, members = entities.dictionary(mentions, done)
    out = baseline.audit_corpus(archive)
    for audit in (baseline.audit_lexical(documents, articles), baseline.audit_vectors(vectors, chunks, 256), baseline.audit_mentions(mentions, done, numbered), baseline.audit_dictionary(names, members, mentions, done)):
        out = out.unionByName(audit)
    return out


@query(f"""WITH {_MARKDOWN}, {_ARTICLES}, r AS (SELECT content, row_number() OVER (ORDER BY article_id) AS id FROM b)
SELECT 'completions of another text' AS "check", count(*) FILTER (id % 7 = 0) AS problems FROM r UNION ALL SELECT 'articles that aren''t indexed', count(*) FILTER (id % 5 = 0) FROM r""")
def stage_audits_of_changed_texts(spark, d):
    """What the audits say when some articles' texts have changed, and some aren't indexed."""
    archive, articles, numbered, chunks, documents, mentions, done, vectors = _stages(spark, d)
    changed = numbered.withColumn("content", F.when(F.col("article_id") % 7 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    ranked = numbered.where("article_id % 5 = 0").join(relational.global_rank(articles.select(F.col("article_id").alias("text_id")), [F.col("text_id")], scratch_dir(spark, "ids")), F.col("rank") == F.col("article_id"))
    fewer = documents.join(ranked.select(F.col("text_id").alias("doc_id")), "doc_id", "left_anti")
    both = baseline.audit_mentions(mentions, done, changed).unionByName(baseline.audit_lexical(fewer, articles))
    return both.where(F.col("check").isin("completions of another text", "articles that aren't indexed")).select("check", "problems")


def _curated(spark, d) -> Curation:
    """Groups of nations by region and parity; those of a region united but in region 0; one retired, one pair told apart."""
    store = Curation(":memory:")
    change = lambda action, origin="reviewed", **p: store.mutate(action, p, operation_id=f"{action}-{store.revision}", actor="query", origin=origin)
    nations = table(spark, d, "nation").orderBy("n_nationkey").collect()
    for region in sorted({n.n_regionkey for n in nations}):
        ids = []
        for parity in (0, 1):
            names = [n.n_name for n in nations if n.n_regionkey == region and n.n_nationkey % 2 == parity]
            ids.append(change("create", origin="autonomous" if parity else "reviewed", group_id=f"g{region}{parity}", preferred=f"Region {region} {parity}", members=names)["group_id"])
        if region:
            change("union", group_ids=ids)
    change("retire", group_id="g00", into="g10")
    change("reject", pair=["nation_0", "nation_1"])
    return store


@query("""SELECT 'g' || r.g AS group_id, 'Region ' || n_regionkey || CASE WHEN n_regionkey = 0 THEN ' 1' ELSE ' 0' END AS preferred, lower(n_name) AS name, CASE n_nationkey % 2 WHEN 1 THEN 'autonomous' ELSE 'reviewed' END AS origin,
CASE WHEN n_regionkey = 0 THEN 'autonomous' WHEN count(DISTINCT n_nationkey % 2) OVER (PARTITION BY n_regionkey) > 1 THEN 'mixed' WHEN n_nationkey % 2 = 1 THEN 'autonomous' ELSE 'reviewed' END AS provenance
FROM nation, LATERAL (SELECT n_regionkey || CASE WHEN n_regionkey = 0 THEN '1' ELSE '0' END AS g) r WHERE n_regionkey > 0 OR n_nationkey % 2 = 1""")
def curation_groups(spark, d):
    store = _curated(spark, d)
    tables = store.tables(spark)
    kinds = spark.createDataFrame([(g["group_id"], g["provenance"]) for g in store.groups()], "group_id string, provenance string")
    members = tables["members"].select("group_id", "name", "origin")
    return members.join(tables["groups"].select("group_id", "preferred"), "group_id").join(kinds, "group_id")


@query("SELECT 'g' || r || '1' AS old, 'g' || r || '0' AS new FROM (SELECT DISTINCT n_regionkey AS r FROM nation WHERE n_regionkey > 0) UNION ALL SELECT 'g00', 'g10'")
def curation_redirects(spark, d):
    return _curated(spark, d).tables(spark)["redirects"]


@query("WITH m AS (SELECT p_partkey AS article_id, 0 AS entity_index, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, p_brand || ' ' || p_type FROM part), n AS (SELECT lower(text) AS normalized_name, article_id FROM m GROUP BY 1, 2) SELECT normalized_name, count(*) AS article_count FROM n GROUP BY 1")
def dictionary_merge(spark, d):
    """A dictionary of two thirds of the articles, to which that of the others, and of some again, is added."""
    parts = table(spark, d, "part")
    one = lambda i, t: F.struct(F.lit(i).alias("entity_index"), t.alias("text"), F.lit(i).alias("char_start"))
    mentions = parts.select(F.col("p_partkey").alias("article_id"), F.explode(F.array(one(0, F.col("p_name")), one(1, F.concat("p_brand", F.lit(" "), "p_type")))).alias("m")).select("article_id", "m.*")
    done = parts.select(F.col("p_partkey").alias("article_id"), F.lit("x").alias("content_sha256"))
    of = lambda condition: entities.dictionary(mentions.where(condition), done)
    names, _ = entities.merge_dictionary(*of("article_id % 3 > 0"), *of("article_id % 3 = 0 or article_id % 5 = 0"))
    return names.select("normalized_name", "article_count")


@query(f"WITH {_MARKDOWN}, {_ARTICLES}, c AS (SELECT count(*) AS n FROM b) SELECT n AS valid_articles, n AS surface, 0::BIGINT AS lemma, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT p_name) FROM part) AS names FROM c")
def index_readiness(spark, d):
    archive, articles, _, _, documents, *_ = _stages(spark, d)
    found = documents.agg(F.count(F.lit(1)), F.sum("size")).first()
    names = table(spark, d, "part").select("p_name").distinct()
    engine = Engine(archive.current_issues(), articles, lexical.Index(documents, found[0], found[1]), None, table(spark, d, "embeddings"), names=names)
    return spark.createDataFrame([engine.status()], "valid_articles long, surface long, lemma long, vectors long, names long")
