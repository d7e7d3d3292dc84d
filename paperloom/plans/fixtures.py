"""The given tables seen as sheets, attempts, cells and codes. Each view is SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "sheet": """SELECT doc_id AS ordinal,
        CASE WHEN doc_id % 17 = 0 THEN '  ' WHEN doc_id % 13 = 0 THEN concat('r', CAST(doc_id - 1 AS STRING)) ELSE concat(' r', CAST(doc_id AS STRING)) END AS row_id,
        CASE WHEN doc_id % 29 = 0 THEN '' ELSE concat('doc', CAST(CASE WHEN doc_id % 7 = 0 THEN doc_id + 100000000 ELSE doc_id - doc_id % 3 END AS STRING), '.pdf') END AS source_pdf,
        CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat('Table ', CAST(doc_id % 9 AS STRING)) END AS locator,
        CASE WHEN doc_id % 19 = 0 THEN '' ELSE concat(source, ' ') END AS authors,
        CASE WHEN doc_id % 23 = 0 THEN '' ELSE CAST(1990 + doc_id % 35 AS STRING) END AS year,
        CASE WHEN doc_id % 4 = 0 THEN '' ELSE substring(text, 1, 40) END AS title,
        CASE WHEN doc_id % 5 = 0 THEN concat('10.1/', CAST(doc_id AS STRING)) ELSE '' END AS doi FROM {documents}""",
    "uploaded": "SELECT concat('doc', CAST(doc_id AS STRING), '.pdf') AS name, text FROM {documents} WHERE doc_id % 4 <> 1",
    "attempts": """SELECT concat('doc', CAST(user_id AS STRING), '.pdf') AS source_pdf, event_id AS attempt, ts AS attempt_ts,
        CASE event_type WHEN 'signup' THEN 'ok' WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'error' WHEN 'click' THEN 'needs_review' ELSE 'cancelled' END AS status,
        CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 3) AS BIGINT) AS output_tokens, event_id % 7 = 0 AS repaired, CAST(event_id % 4 AS BIGINT) AS low_confidence,
        concat('p', CAST(user_id % 2 AS STRING)) AS provider, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('m', CAST(event_id % 3 AS STRING)) END AS model, CAST(event_id % 2 AS STRING) AS prompt_version,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'x' END AS input_fingerprint FROM {events}""",
    "live": "SELECT DISTINCT concat('doc', CAST(user_id AS STRING), '.pdf') AS source_pdf, CASE WHEN user_id % 20 = 0 THEN 'running' ELSE 'ok' END AS status, CAST(5 AS BIGINT) AS input_tokens FROM {events} WHERE user_id % 10 = 0",
    "rows": """SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS row_id,
        concat('order', CAST(l_orderkey AS STRING), '.pdf') AS source_pdf, min(l_linestatus) AS locator, 'A' AS authors, '2001' AS year,
        CAST(max(l_quantity) AS INT) AS quantity, max(l_returnflag) AS flag, CAST(floor(max(l_discount) * 100) AS INT) AS discount, max(l_linenumber) AS line
        FROM {lineitem} GROUP BY 1, 2""",
    "orders_run": """SELECT concat('order', CAST(o_orderkey AS STRING), '.pdf') AS source_pdf, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'needs_review' ELSE 'error' END AS status,
        concat('p', CAST(o_custkey % 3 AS STRING)) AS provider, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE concat('m', CAST(o_custkey % 5 AS STRING)) END AS model, o_orderkey AS operation_id FROM {orders} WHERE o_orderkey % 5 <> 0""",
    "truth": """SELECT concat('doc', CAST(doc_id AS STRING)) AS row_id, 'quality' AS field, CASE WHEN doc_id % 11 = 0 THEN '' ELSE CAST(quality AS STRING) END AS value,
        CASE WHEN doc_id % 11 = 0 THEN 'not_reported' ELSE '' END AS missing, 'number:0.5' AS compare FROM {labels}
        UNION ALL SELECT concat('doc', CAST(doc_id AS STRING)), 'toxic', CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END, '', 'bool' FROM {labels}""",
    "coded": """SELECT concat('doc', CAST(doc_id AS STRING)) AS row_id, 'quality' AS field, CASE WHEN doc_id % 10 = 0 THEN 'null' ELSE 'integer' END AS value_type,
        CASE WHEN doc_id % 10 = 0 THEN NULL WHEN text LIKE '%***%' OR text LIKE '%!!%' OR text LIKE '% | %' THEN '0' ELSE '1' END AS value_text,
        CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM {documents}
        UNION ALL SELECT concat('doc', CAST(doc_id AS STRING)), 'toxic', 'boolean', CASE WHEN text LIKE '%idiot%' OR text LIKE '%scum%' OR text LIKE '%worthless%' THEN 'true' ELSE 'false' END, NULL FROM {documents} WHERE doc_id % 9 <> 0""",
    "run_rows": "SELECT concat('doc', CAST(doc_id AS STRING)) AS row_id FROM {documents} WHERE doc_id % 6 <> 0",
    "pairs": """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'boolean' ELSE 'string' END AS value_type,
        CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END WHEN 1 THEN CAST(o_custkey % 7 AS STRING) WHEN 2 THEN concat('-', CAST(o_custkey % 4 AS STRING)) WHEN 3 THEN concat('1990 – ', CAST(1991 + o_custkey % 3 AS STRING)) ELSE concat(' ', o_orderpriority, '  X ') END AS value_text,
        CASE o_orderkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN '3' WHEN 2 THEN '2' WHEN 3 THEN '1990-1992' ELSE '1-urgent x' END AS truth,
        CASE o_orderkey % 5 WHEN 0 THEN 'bool' WHEN 1 THEN 'number:1.5' WHEN 2 THEN 'number_abs:0.5' WHEN 3 THEN 'years' ELSE 'exact' END AS compare FROM {orders}""",
    "exchanges": "SELECT conv_id AS operation_id, turn AS sequence, text AS content, CASE WHEN turn % 3 = 2 THEN 200 WHEN conv_id % 4 = 0 THEN 400 WHEN conv_id % 6 = 1 THEN 408 WHEN turn % 2 = 0 THEN 429 ELSE 503 END AS http_status, CASE WHEN conv_id % 5 = 0 THEN '45' WHEN conv_id % 3 = 0 THEN '7' WHEN conv_id % 7 = 0 THEN 'Wed, 21 Oct 2026 07:28:00 GMT' WHEN conv_id % 11 = 0 THEN 'soon' ELSE NULL END AS retry_after, CASE WHEN conv_id % 8 < 4 THEN 'gemini' ELSE 'openrouter' END AS provider FROM {conversations}",
    "coder_b": "SELECT doc_id AS unit, 'quality' AS field, CAST(CASE WHEN doc_id % 8 = 0 THEN 1 - quality ELSE quality END AS STRING) AS code FROM {labels} UNION ALL SELECT doc_id, 'toxic', CAST(CASE WHEN doc_id % 5 = 0 THEN 1 - toxic ELSE toxic END AS STRING) FROM {labels}",
    "coder_a": "SELECT doc_id AS unit, 'quality' AS field, CAST(quality AS STRING) AS code FROM {labels} UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS STRING) FROM {labels}",
    "codebooks": "SELECT CAST(p_size AS BIGINT) AS codebook_id, CASE WHEN p_size % 9 = 0 THEN ' ' ELSE min(p_type) END AS effect_definition, p_size % 2 = 0 AS confidence, concat('book ', CAST(p_size AS STRING), ' ') AS name, CASE WHEN p_size % 3 = 0 THEN 'All parts.' END AS description FROM {part} GROUP BY p_size",
    "fields": """SELECT CAST(p_size AS BIGINT) AS codebook_id, p_partkey AS ordinal, CASE WHEN p_partkey % 31 = 0 THEN ' Year' WHEN p_partkey % 37 = 0 THEN 'Notes' WHEN p_partkey % 41 = 0 THEN 'notes' WHEN p_partkey % 43 = 0 THEN ' ' ELSE concat(p_brand, CAST(p_partkey % 5 AS STRING)) END AS field,
        CASE WHEN p_partkey % 7 = 0 THEN 'date' WHEN p_partkey % 5 = 0 THEN 'number' ELSE 'string' END AS type, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 11 = 0 THEN 'a a ' ELSE NULL END AS level_text,
        CASE WHEN p_partkey % 4 = 0 THEN concat('About ', p_name) END AS description, p_partkey % 6 <> 0 AS evidence_required, CASE WHEN p_partkey % 9 = 0 THEN concat('as in ', p_name) END AS level_note FROM {part} WHERE p_size <> 13""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables that it names."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def with_views(select: str) -> str:
    """DuckDB's SQL: the views as common tables before ``select``."""
    views = ", ".join(f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', sql)})" for name, sql in VIEWS.items())
    return f"WITH {views} {select}"
