"""The registered queries of the training-data operators, with their SQL where SQL can express them.

Each reads the named columns of its table alone, so that others may have any names, but for op7, which returns all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, exact_dedup, langid, lm, mixing, packing, repeats, secrets, simhash, warc
from lectern.plans.scratch import spread

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their repeats of 200 bytes. Null texts are empty; texts shorter than 200 bytes keep all; repeated rows
    remove each other's bytes, and each gets its row; long texts are one block each; no rows give none."""
    return repeats.remove_repeats(_documents(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components. Null texts and those without words share fingerprint zero; repeated rows get a row each;
    a null id never names a component that has another; long texts are read whole; no rows give none."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages. Null texts and those without a letter are ``und`` with score 0; ties go to the first name; repeated
    rows are judged alike; long texts are read in pieces; without a labelled row all are ``und``; no rows give none."""
    return langid.identify(_documents(spark, sf_dir)).drop("languages")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back. A null html is an empty payload; a page without an id revisits the smallest id of its payload;
    repeated rows with the smallest id are all responses; a long page is one record; no pages give no archive and no rows."""
    found = warc.round_trip(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by document. Null texts are empty and have none; repeated rows are scanned once and all get the spans; matches at
    one place come in the order of the kinds; long texts take time in proportion; no rows give none."""
    return secrets.scan_documents(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts. Null texts are equal to empty ones; ties don't arise, as the smallest id stays and repeated rows
    with it all say so; a null id never is the smallest; long texts are compared in full; no rows give none."""
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replicated to the sources' shares. Texts aren't looked at; null sources are a source; null ids are drawn as one
    text; repeated rows get the same count each; columns of the input stay; no rows give none."""
    return mixing.mix(_documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by document. Null and empty texts are their end alone; repeated rows count as often as they come; long texts are
    read in pieces that know the words before them; with no training text all words are unknown; no rows give none."""
    return lm.score(_documents(spark, sf_dir))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by query. Vectors that are null, zero or hold null or non-finite components take no part; of rows that share
    an id the least vector does; ties go to the smaller id; fewer candidates than 20 all come; no rows give none."""
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces by sequence. Null and empty texts are their end id alone; repeated rows are packed each on their own; ties go to the
    sequence opened first; long texts fill sequences of their own; no rows give none."""
    columns = [c for c in packing.SCHEMA.replace(",", "").split()[::2] if not c.startswith("sequence_tokens") and c != "sequence_cost"]
    return packing.pack(_documents(spark, sf_dir), *tokenizer_files()).select(*columns)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_array_dedup, op2_simhash_near_dedup, op3_language_id, op4_warc, op5_secret_scan, op6_exact_dedup, op7_mix_sources, op8_lm_scoring, op9_nearest_neighbours, op10_packing)}

_SPACES = r"[\x20\x09-\x0D]+"
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _span_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT doc_id, '{kind}' AS kind, {order} AS ord, "at" + gap AS s, "at" + gap + whole AS e
  FROM (
    SELECT doc_id, whole, sized, gap, coalesce(sum(gap + whole) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "at"
    FROM (
      SELECT doc_id, i, length(m[i]) AS whole, length(g[i]) AS sized, length(p[i]) AS gap
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, regexp_split_to_array(t, '{pattern}') AS p FROM texts),
           LATERAL (SELECT unnest(generate_series(1, len(m))) AS i)
    )
  ) WHERE sized >= {least}"""


ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT page_id, n, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
b AS (SELECT *, list_transform(generate_series(1, 31, 10), lambda k: ('0x' || substr(d, k::BIGINT, 10))::BIGINT) AS v FROM q)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[(k // 8) + 1] >> (35 - 5 * (k % 8))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM b""",
    "op5_secret_scan": f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_span_sql("assign", 0, _ASSIGN, 2, 12)} UNION ALL {_span_sql("access", 1, "AKIA[A-Z0-9]+", 0, 18)} UNION ALL {_span_sql("hex", 2, "[0-9a-f]+", 0, 16)}),
per_doc AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord) AS x FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(x, '')) AS base_sha256, coalesce(x, '') AS spans
FROM texts LEFT JOIN per_doc USING (doc_id)""",
    "op6_exact_dedup": f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""",
    "op7_mix_sources": f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, pow(n::DOUBLE, {mixing.EXPONENT}) / sum(pow(n::DOUBLE, {mixing.EXPONENT})) OVER () * (sum(n) OVER ()) / n AS r FROM counts),
parts AS (SELECT source, greatest(1, ceil(r / {mixing.RATE_A_DRAW}))::INT AS draws, r / greatest(1, ceil(r / {mixing.RATE_A_DRAW})) AS q FROM rates),
cdf AS (SELECT source, 0 AS k, exp(-q) AS p, exp(-q) AS c, q FROM parts UNION ALL SELECT source, k + 1, p * q / (k + 1), c + p * q / (k + 1), q FROM cdf WHERE k < 128),
tables AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (SELECT d.*, list_sum(list_transform(generate_series(1, draws), lambda j: len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('mix-1:' || d.doc_id || ':' || j), 1, 13))::BIGINT / 4503599627370496.0))))::INT AS copies
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT d.*, u.copy::INT AS copy, md5('mix-1:order:' || doc_id || ':' || u.copy) AS mix_key
FROM drawn d, LATERAL (SELECT unnest(generate_series(1, copies)) AS copy) u""",
}
