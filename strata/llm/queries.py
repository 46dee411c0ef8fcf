"""The queries of this subpackage: each numbered operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


SQL["op9_exact_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
"""


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.simhash import simhash_dedup

    return simhash_dedup(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


SQL["op6_warc"] = r"""
WITH signed AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), kept AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS keep FROM signed
)
SELECT page_id, octet_length(payload) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         ((('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS INT), 5))::BIGINT >> CAST(5 * (3 - k % 4) AS INT)) & 31) AS INT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM kept
"""


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.sentencepiece_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


@query
def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.repeated_passages import repeat_report

    return repeat_report(table(spark, sf_dir, "documents"))


SQL["op11_repeated_passages"] = """
WITH texts AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
windows AS (
  SELECT doc_id, s, md5_number(substr(x, CAST(2 * s + 1 AS INT), 200)) AS m
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS s FROM texts)
), later AS (
  SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, s) > 1
), gaps AS (
  SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 100, true) AS opens FROM later
), runs AS (
  SELECT doc_id, s, count(*) FILTER (WHERE opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM gaps
), spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
cut AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, max(z) AS last,
         string_agg(substr(x, CAST(2 * before + 1 AS INT), CAST(2 * (a - before) AS INT)), '' ORDER BY a) AS head
  FROM cuts JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS INT)))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.fill_in_middle import digests

    return digests(table(spark, sf_dir, "documents"))


SQL["op12_fill_in_middle"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), hashed AS (
  SELECT doc_id, t, units, len(units) AS n,
         ('0x' || substr(hex, 1, 8))::BIGINT % (len(units) + 1) AS c1, ('0x' || substr(hex, 9, 8))::BIGINT % (len(units) + 1) AS c2,
         ('0x' || substr(hex, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(hex, 25, 8))::BIGINT % 100 AS h4
  FROM texts
), cut AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 50 THEN 'plain'
              WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(c1, c2)], '') AS p,
         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(units[greatest(c1, c2) + 1:], '') AS s
  FROM hashed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM cut
"""


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def _vector_codes_sql(rounds: int = 6, entries: int = 16) -> str:
    """One pair of tables per round: ``near`` assigns parts to entries, ``book`` averages them."""
    steps = [f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS x FROM kept, range(8) AS r(p)
), book0 AS (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, x AS c FROM parts
  QUALIFY e < {entries}
)"""]
    for r in range(rounds + 1):
        steps.append(f""", near{r} AS MATERIALIZED (
  SELECT vec_id, label, p, x, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT vec_id, label, parts.p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda y: (y[1] - y[2]) * (y[1] - y[2]))) AS BIGINT) AS d
        FROM parts JOIN book{r} ON parts.p = book{r}.p)
  GROUP BY ALL
)""")
        if r < rounds:
            steps.append(f""", book{r + 1} AS MATERIALIZED (
  SELECT old.p, old.e, coalesce(new.c, old.c) AS c
  FROM book{r} AS old LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS c
    FROM (SELECT p, e, i, CAST(floor_div AS BIGINT) AS m FROM (
            SELECT p, e, i, (sum(y) - ((sum(y) % count(*) + count(*)) % count(*))) // count(*) AS floor_div
            FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{r}) GROUP BY p, e, i))
    GROUP BY p, e
  ) AS new ON old.p = new.p AND old.e = new.e
)""")
    return "".join(steps) + f""", codes AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id, label
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes, books
"""


SQL["op13_vector_codes"] = _vector_codes_sql()
