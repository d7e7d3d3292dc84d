"""Registered queries over the given tables, with their SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions import values as vl
from paperloom.operators import audit, codebook, collate, evaluate, linkage, requests, responses, results, sheet, uploads
from paperloom.plans import staging
from paperloom.plans.fixtures import table, view, with_views
from paperloom.sources import files, sheets
from paperloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FIELDS = ["quantity", "flag", "discount"]

_JUDGED = """, t AS (SELECT ordinal, trim(row_id) AS row_id, trim(source_pdf) AS source_pdf, trim(locator) AS locator, trim(authors) AS authors, trim(year) AS year, trim(title) AS title, trim(doi) AS doi FROM sheet),
fu AS (SELECT row_id, min(ordinal) AS first_use FROM t WHERE row_id <> '' GROUP BY row_id),
judged AS (SELECT t.*, first_use, CASE WHEN t.row_id = '' THEN 'row_id is required.'
  WHEN first_use < ordinal THEN 'row_id `' || t.row_id || '` is a duplicate (first used on row ' || (first_use + 2) || ').'
  WHEN authors = '' THEN 'row_id `' || t.row_id || '` has no authors.' WHEN year = '' THEN 'row_id `' || t.row_id || '` has no year.'
  WHEN source_pdf = '' THEN 'row_id `' || t.row_id || '` has no source_pdf.' WHEN source_pdf NOT IN (SELECT name FROM uploaded) THEN 'row_id `' || t.row_id || '` references `' || source_pdf || '`, which has not been uploaded.' END AS message
  FROM t LEFT JOIN fu USING (row_id)),
issues AS (SELECT ordinal + 2 AS row_number, row_id, message, CASE WHEN message LIKE '%no source_pdf.' OR message LIKE '%not been uploaded.' THEN 'pdf' ELSE 'sheet' END AS kind FROM judged WHERE message IS NOT NULL),
valid AS (SELECT ordinal, row_id, source_pdf, locator, authors, year, title, doi FROM judged WHERE message IS NULL) """
_LAST = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY source_pdf ORDER BY attempt_ts DESC, attempt DESC) AS r, row_number() OVER (PARTITION BY source_pdf ORDER BY status = 'ok' DESC, attempt_ts DESC, attempt DESC) AS s FROM attempts),
latest AS (SELECT * EXCLUDE (r, s) FROM ranked WHERE r = 1), selected AS (SELECT * EXCLUDE (r, s) FROM ranked WHERE s = 1),
kept AS (SELECT l.source_pdf FROM latest l JOIN selected s USING (source_pdf) WHERE l.status <> 'ok' AND s.status = 'ok') """
_CELLS = """, cells AS (
  SELECT row_id, 'quantity' AS field, CASE WHEN quantity % 7 = 0 THEN 'null' ELSE 'integer' END AS value_type, CASE WHEN quantity % 7 = 0 THEN NULL ELSE CAST(quantity AS VARCHAR) END AS value_text, 'p. ' || line AS evidence, CASE WHEN quantity % 3 = 0 THEN 'low' ELSE 'high' END AS confidence FROM rows WHERE quantity % 11 <> 0
  UNION ALL SELECT row_id, 'flag', 'string', flag, 'Table 1', CASE WHEN discount % 4 = 0 THEN 'low' ELSE 'medium' END FROM rows
  UNION ALL SELECT row_id, 'discount', 'integer', CAST(discount AS VARCHAR), NULL, 'high' FROM rows WHERE line <> 2) """
_SCORED = """, scored AS (SELECT t.row_id, t.field, CASE WHEN t.missing <> '' THEN c.value_type IS NOT NULL AND v IS NULL ELSE v IS NOT NULL AND CASE WHEN compare = 'bool' THEN c.value_type = 'boolean' AND v = t.value ELSE abs(TRY_CAST(v AS DOUBLE) - TRY_CAST(t.value AS DOUBLE)) <= 0.5 END END AS ok,
  c.confidence, t.missing <> '' AS human_missing, v AS coded, CASE WHEN t.missing <> '' THEN t.missing ELSE t.value END AS expected
  FROM truth t JOIN run_rows USING (row_id) LEFT JOIN (SELECT *, CASE WHEN value_type = 'null' OR trim(value_text) = '' THEN NULL ELSE value_text END AS v FROM coded) c ON c.row_id = t.row_id AND c.field = t.field) """


def query(sql: str | None = None, views: str = "") -> Callable:
    """Registers a query under its function's name, with the SQL that follows the views."""

    def register(f: Callable) -> Callable:
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(views + sql)
        return f

    return register


def _valid(s: SparkSession, d: str) -> DataFrame:
    return sheet.sheet_valid_rows(view(s, d, "sheet"), view(s, d, "uploaded"))


def _cells(s: SparkSession, d: str) -> DataFrame:
    r = view(s, d, "rows")
    null = F.col("quantity") % 7 == 0
    cell = lambda field, type_, value, evidence, confidence: F.struct(F.lit(field).alias("field"), type_.alias("value_type"), value.cast("string").alias("value_text"), evidence.cast("string").alias("evidence"), confidence.alias("confidence"))
    cells = F.array_compact(
        F.array(
            F.when(F.col("quantity") % 11 != 0, cell("quantity", F.when(null, "null").otherwise("integer"), F.when(~null, F.col("quantity")), F.concat(F.lit("p. "), F.col("line")), F.when(F.col("quantity") % 3 == 0, "low").otherwise("high"))),
            cell("flag", F.lit("string"), F.col("flag"), F.lit("Table 1"), F.when(F.col("discount") % 4 == 0, "low").otherwise("medium")),
            F.when(F.col("line") != 2, cell("discount", F.lit("integer"), F.col("discount"), F.lit(None), F.lit("high"))),
        )
    )
    return r.select("row_id", F.explode(cells).alias("c")).select("row_id", "c.*")


def _scored(s: SparkSession, d: str) -> DataFrame:
    return evaluate.score_cells(view(s, d, "truth"), view(s, d, "run_rows"), view(s, d, "coded"))


def _fields(s: SparkSession, d: str) -> DataFrame:
    notes = F.when(F.col("level_note").isNotNull(), F.array("level_note"))
    return view(s, d, "fields").withColumn("levels", F.when(F.col("level_text").isNotNull(), F.split("level_text", " "))).withColumn("level_descriptions", notes).drop("level_text", "level_note")


# The sheet


@query("SELECT * FROM issues", _JUDGED)
def sheet_row_issues(s, d):
    return sheet.sheet_row_issues(view(s, d, "sheet"), view(s, d, "uploaded"))


@query("SELECT * FROM valid", _JUDGED)
def sheet_valid_rows(s, d):
    return _valid(s, d)


@query("SELECT kind, count(*) AS n FROM issues GROUP BY kind", _JUDGED)
def sheet_issue_kinds(s, d):
    return sheet.sheet_issue_kinds(sheet_row_issues(s, d))


@query("SELECT source_pdf, list(row_id ORDER BY ordinal) AS row_ids, list(locator ORDER BY ordinal) AS locators FROM valid GROUP BY source_pdf", _JUDGED)
def rows_per_document(s, d):
    return sheet.rows_per_document(_valid(s, d))


@query("SELECT name FROM uploaded WHERE name NOT IN (SELECT source_pdf FROM valid)", _JUDGED)
def orphan_documents(s, d):
    return sheet.orphan_documents(view(s, d, "uploaded"), _valid(s, d))


@query(
    """, f2 AS (SELECT row_id, min(ordinal) AS first_any FROM t GROUP BY row_id), x AS (SELECT t.*, first_any FROM t JOIN f2 USING (row_id))
    SELECT ordinal + 2 AS row_number, 'error' AS severity, 'row_id is required' AS message FROM x WHERE row_id = '' UNION ALL SELECT ordinal + 2, 'error', 'row_id is a duplicate' FROM x WHERE row_id <> '' AND first_any < ordinal
    UNION ALL SELECT ordinal + 2, 'warning', 'authors missing' FROM x WHERE authors = '' UNION ALL SELECT ordinal + 2, 'warning', 'year missing' FROM x WHERE year = '' UNION ALL SELECT ordinal + 2, 'warning', 'source missing' FROM x WHERE source_pdf = ''""",
    _JUDGED,
)
def draft_sheet_validate(s, d):
    return sheet.draft_sheet_validate(view(s, d, "sheet"))


@query("SELECT o_orderkey AS source_row, 'omitted' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) UNION ALL SELECT DISTINCT l_orderkey + 1000000000, 'invalid' FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 50 = 0")
def lineage_coverage(s, d):
    lines = table(s, d, "lineitem").where("l_linenumber = 1")
    listed = F.when(F.col("l_orderkey") % 50 == 0, F.array("l_orderkey", F.col("l_orderkey") + 1_000_000_000)).otherwise(F.array("l_orderkey"))
    return sheet.lineage_coverage(lines.select(listed.alias("source_rows")), table(s, d, "orders").select(F.col("o_orderkey").alias("source_row")))


@query("SELECT ordinal, CASE WHEN trim(source_pdf) = 'doc3.pdf' THEN '' ELSE source_pdf END AS source_pdf FROM sheet")
def unmatch(s, d):
    return sheet.unmatch(view(s, d, "sheet"), "doc3.pdf").select("ordinal", "source_pdf")


_KEY = "CASE WHEN source_pdf <> '' THEN source_pdf WHEN doi <> '' THEN 'doi:' || doi WHEN title <> '' THEN 'title:' || title WHEN authors <> '' OR year <> '' THEN 'authors:' || authors || '|' || year END"


def _key():
    return tx.paper_key(*(F.col(c) for c in ("source_pdf", "doi", "title", "authors", "year")))


@query(f"SELECT ordinal, {_KEY} AS key FROM t", _JUDGED)
def paper_key(s, d):
    return view(s, d, "sheet").select("ordinal", _key().alias("key"))


def _papers_sql(test: str) -> str:
    first = ", ".join(f"arg_min({c}, ordinal) AS {c}" for c in ("source_pdf", "authors", "year", "locator", "title", "doi"))
    return f"SELECT key, {first}, count(*) AS row_count FROM (SELECT *, {_KEY} AS key FROM t WHERE source_pdf {test} (SELECT name FROM uploaded)) WHERE key IS NOT NULL GROUP BY key"


@query(_papers_sql("NOT IN"), _JUDGED)
def unmatched_papers(s, d):
    return sheet.papers(view(s, d, "sheet"), view(s, d, "uploaded"), _key(), matched=False)


@query(_papers_sql("IN"), _JUDGED)
def matched_papers(s, d):
    return sheet.papers(view(s, d, "sheet"), view(s, d, "uploaded"), _key(), matched=True)


@query(f"SELECT ordinal, CASE WHEN ordinal % 7 = 0 AND k NOT LIKE 'authors%' AND name IS NOT NULL THEN name ELSE source_pdf END AS source_pdf FROM (SELECT sheet.*, t.k, 'doc' || (t.ordinal - t.ordinal % 3) || '.pdf' AS nm FROM sheet JOIN (SELECT *, {_KEY} AS k FROM t) t ON t.ordinal = sheet.ordinal) LEFT JOIN uploaded ON name = nm AND ordinal % 7 = 0 AND ordinal % 29 <> 0", _JUDGED)
def apply_matches(s, d):
    rows = view(s, d, "sheet")
    mapping = rows.where("ordinal % 7 = 0 and ordinal % 29 <> 0").select(_key().alias("key"), F.concat(F.lit("doc"), (F.col("ordinal") - F.col("ordinal") % 3).cast("string"), F.lit(".pdf")).alias("name"))
    return sheet.apply_matches(rows, mapping, view(s, d, "uploaded"), _key()).select("ordinal", "source_pdf")


# Text

_SPLIT = r"regexp_replace(regexp_replace({}, '(\p{{L}})(\p{{Nd}})', '\1 \2', 'g'), '(\p{{Nd}})(\p{{L}})', '\1 \2', 'g')"
_TOKENS = r"regexp_extract_all(" + _SPLIT.format("lower(text)") + r", '[\p{L}\p{N}]+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"


@query(f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS normal FROM documents")
def normalize_text(s, d):
    return table(s, d, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("normal"))


@query("SELECT page_id, nullif(regexp_extract(url, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), '') AS year FROM pages")
def find_year(s, d):
    return table(s, d, "pages").select("page_id", tx.find_year(F.col("url")).alias("year"))


@query(rf"SELECT doc_id, list_sort(list_distinct(list_filter({_TOKENS}, lambda t: NOT list_contains({_STOP}, t) AND (length(t) >= 3 OR regexp_matches(t, '^\p{{Nd}}+$'))))) AS tokens FROM documents")
def significant_tokens(s, d):
    return table(s, d, "documents").select("doc_id", tx.significant_tokens(F.col("text")).alias("tokens"))


@query(rf"SELECT doc_id, list_sort(list_distinct(list_filter({_TOKENS}, lambda t: NOT list_contains({_STOP}, t) AND (length(t) >= 2 OR regexp_matches(t, '^\p{{Nd}}+$'))))) AS tokens FROM documents")
def signal_tokens(s, d):
    return table(s, d, "documents").select("doc_id", tx.signal_tokens(F.col("text")).alias("tokens"))


@query(rf"SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all({_SPLIT.format('text')}, '[\p{{L}}\p{{N}}]+'), lambda t: regexp_full_match(t, '\p{{Lu}}\p{{Ll}}')), lambda t: lower(t)), lambda t: NOT list_contains({_STOP}, t)))) AS tokens FROM documents")
def short_name_tokens(s, d):
    return table(s, d, "documents").select("doc_id", tx.short_name_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, 'src' || doc_id || '_x_y.v1-' || substr(sha256('src' || doc_id || ' x/y.v1.pdf'), 1, 16) AS key FROM documents")
def collision_free_key(s, d):
    name = F.concat(F.lit("src"), F.col("doc_id").cast("string"), F.lit(" x/y.v1.pdf"))
    return table(s, d, "documents").select("doc_id", tx.collision_free_key(name).alias("key"))


_CELL = "CASE c_custkey % 6 WHEN 0 THEN '=' || c_name WHEN 1 THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) WHEN 2 THEN '  -' || c_mktsegment WHEN 3 THEN '-1.5e3' WHEN 4 THEN chr(9) || 'x' ELSE c_name END"


@query(rf"SELECT c_custkey, CASE WHEN regexp_matches(x, '^[\t\r]') OR (regexp_matches(x, '^\s*[=+\-@]') AND NOT regexp_full_match(ltrim(x), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')) THEN '''' || x ELSE x END AS cell FROM (SELECT c_custkey, {_CELL.replace('CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR)', 'CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)')} AS x FROM customer)")
def spreadsheet_safe(s, d):
    k = F.col("c_custkey") % 6
    cell = F.when(k == 0, F.concat(F.lit("="), "c_name")).when(k == 1, F.floor("c_acctbal").cast("string")).when(k == 2, F.concat(F.lit("  -"), "c_mktsegment")).when(k == 3, "-1.5e3").when(k == 4, "\tx").otherwise(F.col("c_name"))
    return table(s, d, "customer").select("c_custkey", tx.spreadsheet_safe(cell).alias("cell"))


@query("SELECT doc_id, replace(replace(text, 'the ', '[REDACTED]'), 'the%20', '[REDACTED]') AS text FROM documents")
def redact_secrets(s, d):
    return table(s, d, "documents").select("doc_id", tx.redact_secrets(F.col("text"), ("the ",)).alias("text"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(replace(replace(url, 'ref=', 'token='), 'utm_source=', 'KEY='), '#.*$', ''), '([?&](?:key|api_key|token|access_token)=)[^&]*', '\1[REDACTED]', 'gi') AS url FROM pages")
def redact_url_query(s, d):
    url = F.replace(F.replace("url", F.lit("ref="), F.lit("token=")), F.lit("utm_source="), F.lit("KEY="))
    return table(s, d, "pages").select("page_id", tx.redact_url_query(url).alias("url"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE NULL END AS kept, CASE WHEN turn % 3 = 0 THEN 'v' END AS id FROM conversations")
def header_allowlist(s, d):
    name = F.when(F.col("turn") % 2 == 0, "Date").otherwise("cookie")
    headers = tx.header_allowlist(F.create_map(name, F.col("role"), F.when(F.col("turn") % 3 == 0, "X-Request-Id").otherwise("x-other"), F.lit("v")))
    return table(s, d, "conversations").select("conv_id", "turn", headers["Date"].alias("kept"), headers["X-Request-Id"].alias("id"))


@query("SELECT event_id, CASE lower(trim(r)) WHEN '' THEN NULL WHEN 'finish_reason_unspecified' THEN NULL WHEN 'max_tokens' THEN 'length' ELSE lower(trim(r)) END AS reason FROM (SELECT event_id, CASE event_type WHEN 'click' THEN ' MAX_TOKENS ' WHEN 'view' THEN 'STOP' WHEN 'error' THEN 'FINISH_REASON_UNSPECIFIED' WHEN 'signup' THEN ' ' ELSE event_type END AS r FROM events)")
def normalize_finish_reason(s, d):
    return table(s, d, "events").select("event_id", vl.normalize_finish_reason(_reason()).alias("reason"))


def _reason():
    e = F.col("event_type")
    return F.when(e == "click", " MAX_TOKENS ").when(e == "view", "STOP").when(e == "error", "FINISH_REASON_UNSPECIFIED").when(e == "signup", " ").otherwise(e)


@query("SELECT event_id, array_to_string(list_filter([CASE event_type WHEN 'click' THEN 'stopped early: length' WHEN 'purchase' THEN 'stopped early: purchase' END, CASE WHEN event_id % 3 = 0 THEN 'repaired JSON' END], lambda x: x IS NOT NULL), '; ') AS flags FROM events")
def review_flags(s, d):
    flags = vl.review_flags(F.when(F.col("event_id") % 3 == 0, F.col("props")), vl.normalize_finish_reason(_reason()))
    return table(s, d, "events").select("event_id", F.array_join(flags, "; ").alias("flags"))


@query("SELECT event_id, CASE WHEN value / 100 >= 0.85 THEN 'high' WHEN value / 100 >= 0.5 THEN 'medium' WHEN value / 100 >= 0.25 THEN 'low' ELSE 'none' END AS band FROM events")
def confidence_band(s, d):
    return table(s, d, "events").select("event_id", vl.confidence_band(F.col("value") / 100).alias("band"))


@query(r"SELECT id, coalesce(CASE split_part(compare, ':', 1) WHEN 'bool' THEN value_text = 'true' WHEN 'number' THEN abs(CAST(value_text AS DOUBLE) - CAST(truth AS DOUBLE)) <= 1.5 WHEN 'number_abs' THEN abs(abs(CAST(value_text AS DOUBLE)) - abs(CAST(truth AS DOUBLE))) <= 0.5 WHEN 'years' THEN replace(replace(value_text, '–', '-'), ' ', '') = truth ELSE trim(regexp_replace(lower(value_text), '\s+', ' ', 'g')) = truth END, false) AS same FROM pairs")
def values_match(s, d):
    return view(s, d, "pairs").select("id", vl.values_match(F.col("value_type"), F.col("value_text"), F.col("truth"), F.col("compare")).alias("same"))


@query("SELECT row_id, field, CASE field WHEN 'flag' THEN value_text IN ('A', 'R') ELSE true END AS valid FROM cells", _CELLS)
def cell_type_check(s, d):
    type_ = F.when(F.col("field") == "flag", "string").when(F.col("field") == "discount", "number").otherwise("integer")
    levels = F.when(F.col("field") == "flag", F.array(F.lit("A"), F.lit("R")))
    return _cells(s, d).select("row_id", "field", vl.cell_type_check(type_, levels, F.col("value_type"), F.col("value_text")).alias("valid"))


# Results


@query("SELECT * FROM latest", _LAST)
def latest_attempt(s, d):
    return results.latest_attempt(view(s, d, "attempts"))


@query("SELECT * FROM selected", _LAST)
def selected_result(s, d):
    return results.selected_result(view(s, d, "attempts"))


@query("SELECT * FROM kept", _LAST)
def kept_success(s, d):
    return results.kept_success(view(s, d, "attempts"))


@query("SELECT DISTINCT source_pdf FROM valid WHERE source_pdf NOT IN (SELECT source_pdf FROM selected WHERE status = 'ok')", _JUDGED + _LAST)
def pending_documents(s, d):
    return results.pending_documents(_valid(s, d), results.selected_result(view(s, d, "attempts")))


@query("SELECT source_pdf, status FROM latest WHERE status <> 'ok' AND source_pdf IN (SELECT source_pdf FROM valid)", _JUDGED + _LAST)
def retry_candidates(s, d):
    return results.retry_candidates(results.latest_attempt(view(s, d, "attempts")), _valid(s, d))


@query("SELECT name, sha256(text) AS digest FROM uploaded")
def document_digest(s, d):
    return view(s, d, "uploaded").select("name", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


_PRINTS = ", prints AS (SELECT v.source_pdf, sha256(to_json({'version': '1', 'codebook': 'book', 'provider': 'openrouter', 'model': 'm', 'base_url': '', 'reasoning_effort': 'high', 'response_format': '', 'digest': sha256(text), 'rows': list({'row_id': row_id, 'locator': locator} ORDER BY row_id, locator)})) AS fingerprint FROM valid v JOIN uploaded u ON u.name = v.source_pdf GROUP BY v.source_pdf, text) "


def _prints(s, d):
    return results.input_fingerprint(_valid(s, d), document_digest(s, d), "book", "openrouter", "m", reasoning_effort="high", base_url="not heeded")


@query("SELECT * FROM prints", _JUDGED + _PRINTS)
def input_fingerprint(s, d):
    return _prints(s, d)


_OLD = "CASE WHEN attempt % 3 = 0 THEN NULL WHEN attempt % 3 = 1 THEN 'old' ELSE fingerprint END"


@query(f"SELECT s.source_pdf, CASE WHEN {_OLD} IS NULL OR {_OLD} = fingerprint THEN status ELSE 'stale' END AS status, {_OLD} AS input_fingerprint, CASE WHEN {_OLD} IS NULL OR {_OLD} = fingerprint THEN NULL WHEN fingerprint IS NULL AND s.source_pdf IN (SELECT source_pdf FROM valid) THEN 'document is missing' ELSE 'inputs have changed' END AS error, CASE WHEN {_OLD} IS NULL OR {_OLD} = fingerprint THEN ['r1'] ELSE [] END AS missing_ids, CASE WHEN {_OLD} IS NULL OR {_OLD} = fingerprint THEN [status] ELSE [] END AS extra_ids FROM selected s LEFT JOIN prints p ON p.source_pdf = s.source_pdf", _JUDGED + _PRINTS + _LAST)
def mark_stale(s, d):
    prints = _prints(s, d)
    old = F.when(F.col("attempt") % 3 == 0, F.lit(None).cast("string")).when(F.col("attempt") % 3 == 1, "old").otherwise(F.col("fingerprint"))
    stored = results.selected_result(view(s, d, "attempts")).join(prints, "source_pdf", "left").select("source_pdf", "status", old.alias("input_fingerprint"), F.lit(None).cast("string").alias("error"), F.array(F.lit("r1")).alias("missing_ids"), F.array("status").alias("extra_ids"))
    return results.mark_stale(stored, prints, _valid(s, d))


@query(
    ", both_ AS (SELECT source_pdf, status, input_tokens, output_tokens, repaired, low_confidence FROM latest WHERE source_pdf NOT IN (SELECT source_pdf FROM live) UNION ALL SELECT source_pdf, status, input_tokens, NULL, NULL, NULL FROM live) "
    "SELECT count(*) AS total, count(*) FILTER (status <> 'running') AS processed, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'cancelled') AS cancelled, "
    "count(*) FILTER (repaired) AS repaired, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(low_confidence), 0)::BIGINT AS low_confidence FROM (SELECT DISTINCT source_pdf FROM valid) LEFT JOIN both_ USING (source_pdf)",
    _JUDGED + _LAST,
)
def run_progress(s, d):
    return results.run_progress(_valid(s, d), view(s, d, "attempts"), view(s, d, "live"))


_ARTICLES = ", articles AS (SELECT v.source_pdf, arg_min(authors, ordinal) AS authors, arg_min(year, ordinal) AS year, count(*) AS n_rows, coalesce(any_value(s.status), 'not_run') AS status, any_value(s.input_tokens) AS input_tokens, any_value(s.output_tokens) AS output_tokens, any_value(s.repaired) AS repaired, any_value(s.low_confidence) AS low_confidence, coalesce(any_value(s.status), '') = 'ok' AND any_value(s.input_fingerprint) IS NULL AS unverified, coalesce(any_value(s.status), '') IN ('error', 'needs_review', 'cancelled', 'stale') AS retryable, v.source_pdf IN (SELECT source_pdf FROM kept) AS kept FROM valid v LEFT JOIN selected s ON s.source_pdf = v.source_pdf GROUP BY v.source_pdf) "


def _articles(s, d):
    attempts = view(s, d, "attempts")
    return results.article_table(results.selected_result(attempts), _valid(s, d), attempts)


@query("SELECT * FROM articles", _JUDGED + _LAST + _ARTICLES)
def article_table(s, d):
    return _articles(s, d)


@query("SELECT * FROM articles ORDER BY coalesce(input_tokens, -1) DESC, source_pdf", _JUDGED + _LAST + _ARTICLES)
def sort_articles(s, d):
    return results.sort_articles(_articles(s, d), "input_tokens", descending=True)


@query("SELECT source_pdf, authors FROM articles ORDER BY source_pdf LIMIT 10 OFFSET 10", _JUDGED + _LAST + _ARTICLES)
def paginate(s, d):
    return results.paginate(_articles(s, d).select("source_pdf", "authors"), ["source_pdf"], 2)


@query("SELECT n_nationkey, n_name, count(c_custkey) AS documents FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def documents_per_project(s, d):
    n = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("documents"))
    return table(s, d, "nation").join(n, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS created_at, (SELECT count(*) FROM customer) AS total, count(*) OVER () AS matching FROM customer WHERE contains(lower(c_name), lower('R#0')) ORDER BY c_acctbal, c_custkey")
def search_sort(s, d):
    named = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("created_at"))
    return results.search_sort(named, " R#0 ", "oldest")


# Collation


def _wide_sql(shown: str, where: str = "true") -> str:
    fields = ", ".join(f"coalesce(max(CASE WHEN field = '{f}' AND {where} THEN {shown} END), '') AS {f}" for f in FIELDS)
    return f"SELECT r.row_id, r.source_pdf, r.locator, r.authors, r.year, coalesce(any_value(o.status), 'not_run') AS status, {fields.replace(' AS quantity', ' AS quantity')} FROM rows r LEFT JOIN orders_run o ON o.source_pdf = r.source_pdf LEFT JOIN cells c ON c.row_id = r.row_id GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY r.row_id, r.source_pdf, r.locator, r.authors, r.year")


def _sheet_rows(s, d):
    return view(s, d, "rows").select("row_id", "source_pdf", "locator", "authors", "year")


@query(_wide_sql("CASE WHEN value_type = 'null' THEN 'Not Reported' ELSE value_text END"), _CELLS)
def collate_coded(s, d):
    return collate.collate_coded(_sheet_rows(s, d), view(s, d, "orders_run"), _cells(s, d), FIELDS)


@query(_wide_sql("evidence"), _CELLS)
def collate_evidence(s, d):
    return collate.collate_evidence(_sheet_rows(s, d), view(s, d, "orders_run"), _cells(s, d), FIELDS)


@query(_wide_sql("confidence"), _CELLS)
def collate_key(s, d):
    return collate.collate_key("confidence", _sheet_rows(s, d), view(s, d, "orders_run"), _cells(s, d), FIELDS)


@query("SELECT row_id, r.source_pdf, coalesce(provider, '') AS provider, coalesce(model, '') AS model, coalesce(CAST(operation_id AS VARCHAR), '') AS operation_id FROM rows r LEFT JOIN orders_run o ON o.source_pdf = r.source_pdf")
def collate_provenance(s, d):
    return collate.collate_provenance(_sheet_rows(s, d), view(s, d, "orders_run"))


@query("SELECT r.source_pdf, count(c.field) AS n FROM rows r LEFT JOIN (SELECT * FROM cells WHERE confidence = 'low' AND field = 'quantity') c ON c.row_id = r.row_id GROUP BY r.source_pdf", _CELLS)
def low_confidence_cells(s, d):
    rated = s.createDataFrame([("quantity",)], "field string")
    return collate.low_confidence_cells(_cells(s, d), _sheet_rows(s, d), rated)


@query("SELECT codebook_id, ordinal, field FROM fields WHERE codebook_id IN (SELECT codebook_id FROM codebooks WHERE confidence) AND field <> 'notes'")
def rated_fields(s, d):
    return collate.rated_fields(view(s, d, "codebooks"), _fields(s, d))


@query(", q AS (SELECT DISTINCT source_pdf, row_id FROM rows WHERE line <> 3), g AS (SELECT DISTINCT source_pdf, row_id FROM rows WHERE line <> 1) SELECT source_pdf, coalesce(list(row_id ORDER BY row_id) FILTER (g.row_id IS NULL), []) AS missing, coalesce(list(row_id ORDER BY row_id) FILTER (q.row_id IS NULL), []) AS extra FROM q FULL JOIN g USING (source_pdf, row_id) GROUP BY source_pdf")
def missing_extra_ids(s, d):
    r = view(s, d, "rows")
    return collate.missing_extra_ids(r.where("line <> 3"), r.where("line <> 1"))


# Evaluation


@query("SELECT * FROM scored", _SCORED)
def score_cells(s, d):
    return _scored(s, d)


@query("SELECT count(*) FILTER (ok) AS correct, count(*) AS cells, round(count(*) FILTER (ok) / count(*), 4) AS accuracy FROM scored", _SCORED)
def score_total(s, d):
    return evaluate.score_total(_scored(s, d))


@query("SELECT field, count(*) FILTER (ok) AS correct, count(*) AS cells FROM scored GROUP BY field", _SCORED)
def score_by_field(s, d):
    return evaluate.score_by_field(_scored(s, d))


@query("SELECT confidence, count(*) FILTER (ok) AS correct, count(*) AS cells FROM scored WHERE confidence IS NOT NULL GROUP BY confidence", _SCORED)
def score_by_confidence(s, d):
    return evaluate.score_by_confidence(_scored(s, d))


@query("SELECT count(*) FILTER (human_missing AND ok) AS left_blank, count(*) FILTER (human_missing AND coded IS NOT NULL) AS value_given, count(*) FILTER (NOT human_missing AND coded IS NULL) AS value_missed FROM scored", _SCORED)
def missing_tallies(s, d):
    return evaluate.missing_tallies(_scored(s, d))


@query("SELECT row_id, field, expected, coded FROM scored WHERE NOT ok", _SCORED)
def score_errors(s, d):
    return evaluate.score_errors(_scored(s, d))


@query("SELECT field, confidence, CASE WHEN grouping(field) = 1 AND grouping(confidence) = 1 THEN 'total' WHEN grouping(confidence) = 1 THEN 'field' ELSE 'confidence' END AS level, count(*) FILTER (ok) AS correct, count(*) AS cells FROM scored GROUP BY GROUPING SETS ((), (field), (confidence)) HAVING NOT (grouping(confidence) = 0 AND confidence IS NULL)", _SCORED)
def score_rollup(s, d):
    return evaluate.score_rollup(_scored(s, d))


@query("SELECT status, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, list_sort(list(DISTINCT provider || '/' || coalesce(model, 'None'))) AS providers, list_sort(list(DISTINCT prompt_version)) AS prompt_versions FROM selected GROUP BY ROLLUP (status)", _LAST)
def run_rollup(s, d):
    return evaluate.run_rollup(results.selected_result(view(s, d, "attempts")))


_KAPPA = ", p AS (SELECT field, x.code AS a, y.code AS b FROM coder_a x JOIN coder_b y USING (unit, field)), n AS (SELECT field, count(*) AS n, count(*) FILTER (a = b) / count(*) AS agree FROM p GROUP BY field), ma AS (SELECT field, a AS code, count(*) AS na FROM p GROUP BY ALL), mb AS (SELECT field, b AS code, count(*) AS nb FROM p GROUP BY ALL), pe AS (SELECT field, sum(na * nb / (n * n)) AS pe FROM ma JOIN mb USING (field, code) JOIN n USING (field) GROUP BY field) SELECT field, n, agree, (agree - pe) / (1 - pe) AS kappa FROM n JOIN pe USING (field)"


@query(_KAPPA)
def agreement_by_field(s, d):
    return evaluate.agreement_by_field(view(s, d, "coder_a"), view(s, d, "coder_b"))


@query(", p AS (SELECT field, x.code::DOUBLE AS x, y.code::DOUBLE AS y FROM coder_a x JOIN coder_b y USING (unit, field)), s AS (SELECT field, count(*) AS n, avg((x = y)::INT) AS exact, avg(abs(x - y)) AS mean_abs_diff, 2 * count(*) * var_pop((x + y) / 2) / (count(*) - 1) AS msr, count(*) * var_pop(x - y) / 2 / (count(*) - 1) AS mse, count(*) * avg(x - y) * avg(x - y) / 2 AS msc FROM p GROUP BY field) SELECT field, n, exact, mean_abs_diff, (msr - mse) / (msr + mse + 2 * (msc - mse) / n) AS icc FROM s")
def numeric_agreement(s, d):
    return evaluate.numeric_agreement(evaluate.numbers(view(s, d, "coder_a")), evaluate.numbers(view(s, d, "coder_b")))


@query("SELECT ordinal, source_pdf FROM (SELECT v.*, dense_rank() OVER (PARTITION BY authors ORDER BY md5('seed/' || source_pdf), source_pdf) AS r FROM valid v) WHERE r <= 3", _JUDGED)
def validation_sample(s, d):
    return evaluate.validation_sample(_valid(s, d), 3, "seed", "authors").select("ordinal", "source_pdf")


@query("SELECT *, cost_in + cost_out AS cost FROM (SELECT avg(input_tokens) AS mean_tokens, avg(output_tokens) AS mean_output, avg(input_tokens) * (0.375 * (200 / 1e6 * 1.1)) AS cost_in, avg(output_tokens) * (1.875 * (200 / 1e6 * 1.1)) AS cost_out FROM attempts)")
def cost_estimate(s, d):
    return evaluate.cost_estimate(view(s, d, "attempts"), 200, 0.375, 1.875)


@query("SELECT 'cell count differs' AS problem FROM scored HAVING count(*) <> count(*) FILTER (field = 'quality') UNION ALL SELECT 'accuracy fell' FROM scored HAVING count(*) FILTER (ok) / count(*) < count(*) FILTER (ok AND field = 'quality') / count(*) FILTER (field = 'quality') - 0.05 UNION ALL SELECT 'providers differ'", _SCORED)
def regression_check(s, d):
    scored = _scored(s, d)
    summary = lambda x: x.agg(F.count("*").alias("cells"), (F.count_if("ok") / F.count("*")).alias("accuracy"), F.lit(0).alias("not_ok"))
    by = lambda x, *names: x.withColumn("providers", F.array(*map(F.lit, names)))
    return evaluate.regression_check(by(summary(scored), "a/m", "b/m"), by(summary(scored.where("field = 'quality'")), "b/m", "c/m"))


# Codebooks

_LEVELS = ", f AS (SELECT *, CASE WHEN level_text IS NULL THEN NULL ELSE string_split(level_text, ' ') END AS levels, trim(field) AS name, lower(trim(field)) AS key FROM fields) "


@query(
    """, u AS (SELECT codebook_id, key, min(ordinal) AS first_use FROM f WHERE key <> '' GROUP BY ALL), x AS (SELECT f.*, first_use FROM f LEFT JOIN u USING (codebook_id, key))
    SELECT codebook_id, name AS field, 'blank name' AS rule FROM x WHERE name = '' UNION ALL SELECT codebook_id, name, 'reserved name, use ' || CASE key WHEN 'year' THEN 'publication_year' WHEN 'status' THEN 'publication_status' ELSE 'study_' || key END FROM x WHERE key IN ('row_id', 'source_pdf', 'locator', 'authors', 'year', 'status')
    UNION ALL SELECT codebook_id, name, 'clashes with notes' FROM x WHERE key = 'notes' AND name <> 'notes' UNION ALL SELECT codebook_id, name, 'duplicate name' FROM x WHERE first_use < ordinal
    UNION ALL SELECT codebook_id, name, 'unknown type' FROM x WHERE type = 'date' UNION ALL SELECT codebook_id, name, 'levels on non-string' FROM x WHERE levels IS NOT NULL AND type <> 'string'
    UNION ALL SELECT codebook_id, name, 'blank level' FROM x WHERE list_contains(levels, '') UNION ALL SELECT codebook_id, name, 'duplicate level' FROM x WHERE len(list_distinct(levels)) < len(levels)
    UNION ALL SELECT codebook_id, name, 'flag is not boolean' FROM x WHERE ordinal % 29 = 0 UNION ALL SELECT codebook_id, '', 'no effect definition' FROM codebooks WHERE trim(effect_definition) = '' UNION ALL SELECT codebook_id, '', 'no fields' FROM codebooks WHERE codebook_id NOT IN (SELECT codebook_id FROM fields)""",
    _LEVELS,
)
def codebook_lint(s, d):
    fields = _fields(s, d).withColumn("evidence_required", F.when(F.col("ordinal") % 29 == 0, "maybe").otherwise(" True"))
    return codebook.codebook_lint(view(s, d, "codebooks"), fields)


@query("SELECT codebook_id, ordinal, field, type, levels, description, evidence_required, CASE WHEN level_note IS NOT NULL THEN [level_note] END AS level_descriptions FROM f WHERE field <> 'notes' UNION ALL SELECT codebook_id, max(ordinal) + 1, 'notes', 'string', NULL, NULL, false, NULL FROM fields GROUP BY codebook_id", _LEVELS)
def codebook_effective(s, d):
    return codebook.codebook_effective(_fields(s, d))


@query("SELECT codebook_id, ordinal, CASE WHEN level_text IS NOT NULL THEN 'string' ELSE type END AS type FROM fields")
def codebook_type_coercion(s, d):
    return codebook.codebook_type_coercion(_fields(s, d)).select("codebook_id", "ordinal", "type")


@query(
    ", h AS (SELECT codebook_id, list({'field': name, 'type': lower(trim(type)), 'description': coalesce(trim(description), ''), 'evidence_required': evidence_required, 'levels': list_transform(coalesce(levels, []), lambda x, i: {'value': trim(x), 'description': CASE WHEN i = 1 THEN level_note END})} ORDER BY ordinal) AS fs FROM f GROUP BY codebook_id) "
    "SELECT codebook_id, sha256(to_json({'name': trim(name), 'description': coalesce(description, ''), 'effect_definition': trim(effect_definition), 'confidence': confidence, 'fields': fs})) AS hash FROM codebooks LEFT JOIN h USING (codebook_id)",
    _LEVELS,
)
def codebook_canonical_hash(s, d):
    return codebook.codebook_canonical_hash(view(s, d, "codebooks"), _fields(s, d))


@query(
    "SELECT codebook_id, string_agg('- `' || field || '` (' || CASE WHEN levels IS NULL THEN type ELSE 'categorical' END || ')' || coalesce(chr(10) || '  Description: ' || description, '') "
    "|| CASE WHEN levels IS NULL THEN '' ELSE chr(10) || '  Levels:' || array_to_string(list_transform(levels, lambda x, i: chr(10) || '  - `' || trim(x) || '`' || CASE WHEN i = 1 AND level_note IS NOT NULL THEN ': ' || level_note ELSE '' END), '') END, chr(10) ORDER BY ordinal) AS text FROM f GROUP BY codebook_id",
    _LEVELS,
)
def render_codebook(s, d):
    return codebook.render_codebook(_fields(s, d))


# Linkage


def _paper_rows(s, d):
    b = table(s, d, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("key"), F.col("text").alias("title"), F.concat(F.lit("y "), (2000 + F.col("item_id") % 3).cast("string")).alias("year"), *(F.lit("").alias(c) for c in ("authors", "source_pdf", "doi")))


def _signals(s, d):
    docs = table(s, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("name"), tx.signal_tokens(F.col("text")).alias("tokens"), F.when(F.col("doc_id") % 2 == 0, (2000 + F.col("doc_id") % 5).cast("string")).alias("year"))


def _scores(s, d):
    return linkage.containment_score(_paper_rows(s, d), _signals(s, d))


_ALL = r"regexp_extract_all(" + _SPLIT.format("lower({})") + r", '[\p{{L}}\p{{N}}]+')"


@query(
    rf""", p AS (SELECT item_id::VARCHAR AS key, (2000 + item_id % 3)::VARCHAR AS year, list_distinct(list_filter({_TOKENS.replace("lower(text)", "lower('y ' || (2000 + item_id % 3) || ' ' || text)")}, lambda t: NOT list_contains({_STOP}, t) AND (length(t) >= 3 OR regexp_matches(t, '^\p{{Nd}}+$')))) AS tokens FROM benchmark),
    g AS (SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 2 = 0 THEN (2000 + doc_id % 5)::VARCHAR END AS year, unnest(list_distinct({_TOKENS})) AS token FROM documents),
    m AS (SELECT key, name, len(tokens) AS n, p.year AS py, g.year AS sy, count(*) AS m FROM (SELECT *, unnest(tokens) AS token FROM p) p JOIN g USING (token) GROUP BY ALL),
    r AS (SELECT key, name, least(1.0, m / n + CASE WHEN py = sy THEN 0.15 ELSE 0.0 END) AS raw, py, sy FROM m)
    SELECT * FROM (SELECT key, name, CASE WHEN py <> sy THEN least(raw, 0.4) ELSE raw END AS score FROM r) WHERE score >= 0.25"""
)
def containment_score(s, d):
    """Scores without near misses. What rests on scores is checked on these, which SQL can say."""
    return _scores(s, d)


@query()
def pair_score(s, d):
    """All pairs with the whole formula. Its similarity of words is none of SQL's; tests compare it with plain loops."""
    return linkage.pair_score(_paper_rows(s, d), _signals(s, d))


def _named(suggestions):
    """Candidates by their names alone."""
    return suggestions.withColumn("candidates", F.transform("candidates", lambda c: c["name"]))


@query()
def near_miss_suggestions(s, d):
    """Suggestions from the whole formula, with the documents that come next."""
    return _named(linkage.near_miss_suggestions(_paper_rows(s, d), _signals(s, d)))


#: The greedy assignment, one pair after the other.
_SCORES = ORACLE_SQL["containment_score"]
_ASSIGNED = f"""WITH RECURSIVE scores AS MATERIALIZED ({_SCORES}), greedy AS (
    SELECT []::VARCHAR[] AS keys, []::VARCHAR[] AS names, NULL::STRUCT(s DOUBLE, k VARCHAR, n VARCHAR) AS pick, 0 AS i
    UNION ALL SELECT list_append(keys, pick.k), list_append(names, pick.n), pick, i FROM (SELECT keys, names, i + 1 AS i, (SELECT min({{'s': -score, 'k': key, 'n': name}}) FROM scores WHERE NOT list_contains(keys, key) AND NOT list_contains(names, name)) AS pick FROM greedy) WHERE pick IS NOT NULL),
  assigned AS MATERIALIZED (SELECT pick.k AS key, pick.n AS name, -pick.s AS score FROM greedy WHERE i > 0),
  rivals AS (SELECT s.key FROM scores s JOIN assigned a ON a.key = s.key AND a.name <> s.name LEFT JOIN assigned o ON o.name = s.name WHERE NOT a.score - s.score >= 0.1 - 1e-9 AND NOT coalesce(o.score - s.score >= 0.1 - 1e-9, false)
    UNION SELECT w.key FROM scores s JOIN assigned w ON w.name = s.name AND w.key <> s.key LEFT JOIN assigned o ON o.key = s.key WHERE NOT w.score - s.score >= 0.1 - 1e-9 AND NOT coalesce(o.score - s.score >= 0.1 - 1e-9, false)) """


@query()
def assign_one_to_one(s, d):
    return linkage.assign_one_to_one(_scores(s, d))


@query()
def match_suggestions(s, d):
    return _named(linkage.match_suggestions(_paper_rows(s, d), _scores(s, d)))


ORACLE_SQL["assign_one_to_one"] = _ASSIGNED + "SELECT * FROM assigned"
ORACLE_SQL["match_suggestions"] = _ASSIGNED + (
    ", c AS (SELECT key, list(name ORDER BY score DESC, name) AS candidates FROM (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, name) <= 10) GROUP BY key) "
    "SELECT item_id::VARCHAR AS key, coalesce(candidates, []) AS candidates, CASE WHEN band <> 'none' THEN name END AS name, CASE WHEN contested AND band IN ('high', 'medium') THEN 'low' ELSE band END AS confidence FROM (SELECT item_id, name, candidates, item_id::VARCHAR IN (SELECT key FROM rivals) AS contested, "
    "CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score >= 0.25 THEN 'low' ELSE 'none' END AS band FROM benchmark LEFT JOIN assigned ON key = item_id::VARCHAR LEFT JOIN c ON c.key = item_id::VARCHAR)"
)


# Audit


@query("SELECT sha256(content) AS sha256, any_value(strlen(content))::BIGINT AS bytes, count(*) AS uses FROM exchanges GROUP BY sha256(content)")
def blob_dedupe(s, d):
    return audit.blob_dedupe(view(s, d, "exchanges"))[0]


@query(", o AS (SELECT name, CASE WHEN strlen(text) % 5 = 0 THEN 'bad' ELSE sha256(text) END AS want FROM uploaded), h AS (SELECT 'doc' || doc_id || '.pdf' AS name, sha256(text) AS have FROM documents WHERE doc_id % 6 <> 0) SELECT name, CASE WHEN have IS NULL THEN 'absent' WHEN want IS NULL THEN 'unexpected' ELSE 'differs' END AS problem FROM o FULL JOIN h USING (name) WHERE have IS NULL OR want IS NULL OR have <> want")
def verify_checksums(s, d):
    digest = F.sha2(F.col("text").cast("binary"), 256)
    want = view(s, d, "uploaded").select("name", F.when(F.octet_length("text") % 5 == 0, "bad").otherwise(digest).alias("sha256"))
    files = table(s, d, "documents").where("doc_id % 6 <> 0").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), digest.alias("sha256"))
    return audit.verify_checksums(want, files)


@query("SELECT user_id AS operation_id, coalesce(n, 0) AS exchanges, CASE WHEN user_id % 4 = 0 THEN NULL ELSE date_diff('microsecond', lo, hi) / 1e6 END AS seconds, user_id % 4 = 0 AS interrupted, CASE WHEN user_id % 4 = 0 THEN 'interrupted' WHEN user_id % 3 = 0 THEN 'finished' ELSE 'stopped' END AS final_status FROM (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id) LEFT JOIN (SELECT operation_id, count(*) AS n FROM exchanges GROUP BY operation_id) ON operation_id = user_id")
def operation_rollup(s, d):
    e = table(s, d, "events").groupBy(F.col("user_id").alias("operation_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("hi"))
    e = e.withColumn("finished_at", F.when(F.col("operation_id") % 4 != 0, F.col("hi"))).withColumn("status", F.when(F.col("operation_id") % 3 == 0, " ").otherwise("stopped"))
    return audit.operation_rollup(e, view(s, d, "exchanges"))


@query(
    ", e AS (SELECT *, row_number() OVER (PARTITION BY operation_id ORDER BY sequence) AS n, http_status IN (429, 500, 502, 503, 504) OR (provider = 'openrouter' AND http_status IN (408, 409)) AS ok, "
    "CASE WHEN provider <> 'gemini' THEN 0 WHEN retry_after LIKE '%GMT' THEN CASE WHEN sequence % 2 = 0 THEN 20 ELSE 0 END ELSE coalesce(TRY_CAST(retry_after AS DOUBLE), 0) END AS asked FROM exchanges) "
    "SELECT operation_id, sequence, ok AS retryable, ok AND (asked > 30 OR n >= 3) AS give_up, CASE WHEN ok AND NOT (asked > 30 OR n >= 3) THEN greatest(2.0 * pow(2, n - 1), asked) END AS delay FROM e"
)
def retry_classification(s, d):
    # 20 seconds before the date that some answers name, or after it
    at = F.timestamp_seconds(F.when(F.col("sequence") % 2 == 0, 1792567660).otherwise(1792567700))
    return audit.retry_classification(view(s, d, "exchanges").withColumn("at", at))


# Sources, requests, incremental work


@query("SELECT doc_id, CASE WHEN t <> '' THEN t END AS text, CASE WHEN t = '' THEN 'no text' END AS error FROM (SELECT doc_id, coalesce(string_agg('[Page ' || i || ']' || chr(10) || body, chr(10) || chr(10) ORDER BY i) FILTER (body <> ''), '') AS t FROM (SELECT doc_id, i, trim(ps[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS body FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))) GROUP BY doc_id)")
def assemble_page_text(s, d):
    pages = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "text"))
    return sheets.assemble_page_text(pages.withColumn("page_no", F.col("page_no") + 1))


@query("SELECT source_pdf, attempt, is_canonical, file_name FROM (SELECT *, row_number() OVER (PARTITION BY source_pdf ORDER BY is_canonical DESC, file_name DESC) AS r FROM (SELECT source_pdf, attempt, attempt % 3 = 0 AS is_canonical, lpad(CAST(attempt AS VARCHAR), 9, '0') AS file_name FROM attempts)) WHERE r = 1")
def dedupe_result_records(s, d):
    records = view(s, d, "attempts").select("source_pdf", "attempt", (F.col("attempt") % 3 == 0).alias("is_canonical"), F.lpad(F.col("attempt").cast("string"), 9, "0").alias("file_name"))
    return sheets.dedupe_result_records(records)


@query("SELECT a.source_pdf, coalesce(list(row_id ORDER BY row_id) FILTER (row_id IS NOT NULL), []) AS row_ids FROM (SELECT DISTINCT source_pdf FROM (SELECT 'order' || o_orderkey || '.pdf' AS source_pdf, 'broad' || CASE WHEN o_orderkey % 3 = 0 THEN ' small' ELSE '' END AS sets FROM orders) WHERE list_contains(string_split(sets, ' '), 'small')) a LEFT JOIN rows r ON r.source_pdf = a.source_pdf GROUP BY a.source_pdf")
def scan_eval_set(s, d):
    name = F.concat(F.lit("order"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    articles = table(s, d, "orders").select(name.alias("source_pdf"), F.when(F.col("o_orderkey") % 3 == 0, "broad small").otherwise("broad").alias("sets"))
    return sheets.scan_eval_set(articles, view(s, d, "rows"), "small")


@query("SELECT path, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM (SELECT 'a/' || CASE WHEN doc_id % 9 = 0 THEN '.' ELSE '' END || doc_id || CASE WHEN doc_id % 10 = 0 THEN '.tmp' ELSE '.txt' END AS path, text FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 10 <> 0)")
def export_manifest(s, d):
    i = F.col("doc_id")
    path = F.concat(F.lit("a/"), F.when(i % 9 == 0, ".").otherwise(""), i.cast("string"), F.when(i % 10 == 0, ".tmp").otherwise(".txt"))
    return sheets.export_manifest(table(s, d, "documents").select(path.alias("path"), F.col("text").alias("content")))


_BOOK = "CAST(1 + length(source_pdf) % 3 AS BIGINT)"
_REQUESTS = (
    "SELECT v.source_pdf, codebook_id, list(row_id ORDER BY ordinal) AS row_ids, 'Rules.' || CASE WHEN any_value(confidence) THEN chr(10) || 'How sure?' ELSE '' END || chr(10) || chr(10) || 'An effect:' || chr(10) || any_value(effect_definition) || chr(10) || chr(10) || any_value(name) || chr(10) || chr(10) "
    "|| 'Rows: ' || count(*) || chr(10) || chr(10) || string_agg('- ' || row_id || ': ' || CASE WHEN locator = '' THEN '(none)' ELSE locator END, chr(10) ORDER BY ordinal) || chr(10) || chr(10) || any_value(text) AS prompt "
    f"FROM (SELECT *, {_BOOK} AS codebook_id FROM valid) v JOIN codebooks USING (codebook_id) JOIN (SELECT name AS file, text FROM uploaded) u ON file = source_pdf GROUP BY v.source_pdf, codebook_id"
)


@query(_REQUESTS, _JUDGED)
def build_requests(s, d):
    books = view(s, d, "codebooks").select("codebook_id", F.col("name").alias("text"), "effect_definition", "confidence")
    return requests.build_requests(_valid(s, d).withColumn("codebook_id", F.expr(_BOOK)), view(s, d, "uploaded"), "Rules.", books, "How sure?")


@query(
    f"SELECT source_pdf, CASE WHEN refused THEN 'error' ELSE 'received' END AS status, CASE WHEN NOT refused THEN array_to_string(list_transform(row_ids, lambda x: x || '=' || stars), ',') END AS raw, CASE WHEN refused THEN 'ValueError: refused' END AS error, CASE WHEN refused THEN 3 ELSE 1 END AS attempts "
    f"FROM (SELECT *, contains(prompt, 'worthless') AS refused, (length(prompt) - length(replace(prompt, '***', ''))) // 3 AS stars FROM ({_REQUESTS}))",
    _JUDGED,
)
def annotate_documents(s, d):
    """A keyword coder over every request: deterministic, and failing where a text is toxic."""

    def coder(prompt: str, row_ids: list[str]) -> str:
        if "worthless" in prompt:
            raise ValueError("refused")
        return ",".join(f"{i}={prompt.count('***')}" for i in row_ids)

    return requests.annotate_documents(build_requests(s, d), coder, delay=0)


#: One envelope of each kind: its JSON (with the event's i and u), and what is read from it.
_ENVELOPES = (
    ('{"candidates":[{"content":{"parts":[{"text":"t%i,"},{"text":"x"}]},"finishReason":"MAX_TOKENS"},{"content":{"parts":[{"text":"y"},{"other":1}]}}],"usageMetadata":{"promptTokenCount":%u,"candidatesTokenCount":2,"thoughtsTokenCount":3},"modelVersion":"m1"}', "'t' || event_id || ',xy', 'length', user_id, 5, 'm1', NULL"),
    ('{"choices":[{"message":{"content":"c%i"},"finish_reason":"stop"},5],"usage":{"prompt_tokens":%u,"completion_tokens":7},"model":"m2"}', "'c' || event_id, 'stop', user_id, 7, 'm2', NULL"),
    ('{"candidates":[{"content":{"parts":[{"text":"t%i"}]}}],"usageMetadata":{"thoughtsTokenCount":null},"modelVersion":""}', "'t' || event_id, NULL, NULL, NULL, NULL, NULL"),
    ('{"choices":[{"message":{"content":"c%i"}}],"usage":{"prompt_tokens":"many"},"model":5}', "'c' || event_id, NULL, NULL, NULL, NULL, NULL"),
    *((raw, f"NULL, NULL, NULL, NULL, NULL, '{error}'") for raw, error in (
        ("[%i]", "no JSON object"), ('{"a"', "no JSON object"), ('{"error":%i}', "no text"), ('{"candidates":"x"}', "candidates are no list"), ('{"candidates":[%i]}', "candidate is no object"),
        ('{"candidates":[{"content":[1]}]}', "content is no object"), ('{"candidates":[{"content":{"parts":{"text":"t"}}}]}', "parts are no list"), ('{"candidates":[{"content":{"parts":["t"]}}]}', "part is no object"),
        ('{"candidates":[{"content":{"parts":[{"text":%i}]}}]}', "text is no string"), ('{"candidates":[{"content":{"parts":[{"text":" "}]}}]}', "no text"), ('{"candidates":[{"content":{"parts":[{"text":"t"}]}}],"usageMetadata":{"promptTokenCount":"many"}}', "usage is malformed"),
        ('{"choices":"x"}', "choices are no list"), ('{"choices":[]}', "choice is no object"), ('{"choices":[{"message":"x"}]}', "message is no object"), ('{"choices":[{"message":{"content":5}}]}', "no text"),
    )),
)


def _envelope_sql() -> str:
    names = ("text", "finish_reason", "input_tokens", "output_tokens", "served_model", "error")
    types = ("VARCHAR", "VARCHAR", "BIGINT", "BIGINT", "VARCHAR", "VARCHAR")
    one = " UNION ALL ".join(f"SELECT event_id, {told} FROM events WHERE event_id % {len(_ENVELOPES)} = {k}" for k, (_, told) in enumerate(_ENVELOPES))
    return f"SELECT id, {', '.join(f'{n}::{t} AS {n}' for n, t in zip(names, types))} FROM ({one}) AS t(id, {', '.join(names)})"


@query(_envelope_sql())
def parse_envelope(s, d):
    id_, user = F.col("event_id"), F.col("user_id")
    raws = F.array(*(F.lit(raw) for raw, _ in _ENVELOPES))
    raw = F.replace(F.replace(F.get(raws, (id_ % len(_ENVELOPES)).cast("int")), F.lit("%i"), id_.cast("string")), F.lit("%u"), user.cast("string"))
    return requests.parse_envelope(table(s, d, "events").select(id_.alias("id"), raw.alias("raw")))


@query("SELECT source_pdf, operation_id, 'm' || (o_custkey % 4) AS asked_model, served_model, CASE WHEN o_custkey IS NULL THEN 'unknown operation' ELSE 'another model served' END AS problem FROM (SELECT source_pdf, operation_id, model AS served_model FROM orders_run WHERE model IS NOT NULL) LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 0) ON o_orderkey = operation_id WHERE o_custkey IS NULL OR 'm' || (o_custkey % 4) <> served_model")
def attempt_provenance_link(s, d):
    operations = table(s, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("operation_id"), F.concat(F.lit("m"), (F.col("o_custkey") % 4).cast("string")).alias("model"))
    return requests.attempt_provenance_link(view(s, d, "orders_run").where("model is not null").withColumnRenamed("model", "served_model"), operations)


@query("SELECT p_name AS name, p_size AS size, p_partkey AS mtime FROM part WHERE NOT (p_partkey % 3 = 0 AND p_partkey % 5 <> 0)")
def incremental_signals(s, d):
    docs = table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_partkey").alias("mtime"))
    stored = docs.where("mtime % 3 = 0").withColumn("version", F.when(F.col("mtime") % 5 == 0, 1).otherwise(2))
    return requests.incremental_signals(docs, stored, 2)


@query(
    ", codes AS (SELECT row_id, field, count(*) AS n, bool_or((value <> '') = (missing <> '')) AS both_, bool_or(missing NOT IN ('', 'not_reported', 'not_applicable', 'unclear')) AS unknown FROM truth GROUP BY 1, 2) "
    "SELECT row_id, field, 'repeated' AS problem FROM codes WHERE n > 1 UNION ALL SELECT row_id, field, 'value or missing' FROM codes WHERE both_ UNION ALL SELECT row_id, field, 'missing reason' FROM codes WHERE unknown "
    "UNION ALL SELECT row_id, field, 'absent' FROM (SELECT DISTINCT row_id FROM run_rows) CROSS JOIN (VALUES ('quality'), ('toxic')) AS f(field) WHERE (row_id, field) NOT IN (SELECT (row_id, field) FROM codes) "
    "UNION ALL SELECT DISTINCT row_id, field, 'no such level' FROM truth WHERE field = 'quality' AND value NOT IN ('', '0') UNION ALL SELECT DISTINCT row_id || '.pdf', NULL, 'no article' FROM run_rows WHERE row_id || '.pdf' NOT IN (SELECT name FROM uploaded) "
    "UNION ALL SELECT DISTINCT name, NULL, 'no rows' FROM uploaded WHERE name NOT IN (SELECT row_id || '.pdf' FROM run_rows)"
)
def eval_set_integrity(s, d):
    rows = view(s, d, "run_rows").withColumn("source_pdf", F.concat("row_id", F.lit(".pdf")))
    articles = view(s, d, "uploaded").select(F.col("name").alias("source_pdf"))
    return evaluate.eval_set_integrity(view(s, d, "truth"), rows, ["quality", "toxic"], levels={"quality": ("0",)}, articles=articles)


@query(
    ", both_ AS (SELECT field, CAST(a.code AS DOUBLE) AS x, CAST(b.code AS DOUBLE) AS y FROM coder_a a JOIN coder_b b USING (unit, field)), "
    "seen AS (SELECT field, count(*) AS n, avg(abs(x - y)) AS apart, avg(CAST(x <> y AS INT)) AS differ FROM both_ GROUP BY field), "
    "mx AS (SELECT field, x, count(*) AS m FROM both_ GROUP BY 1, 2), my AS (SELECT field, y, count(*) AS m FROM both_ GROUP BY 1, 2), "
    "chance AS (SELECT field, sum(mx.m * my.m * abs(x - y)) AS c FROM mx JOIN my USING (field) GROUP BY field), "
    "codes AS (SELECT field, code, sum(m) AS m FROM (SELECT field, x AS code, m FROM mx UNION ALL SELECT field, y, m FROM my) GROUP BY 1, 2), "
    "eq AS (SELECT field, sum(m * m) AS e FROM codes GROUP BY field) "
    "SELECT field, n, 1 - apart * n * n / nullif(c, 0) AS kappa_w, 1 - differ * 2 * n * (2 * n - 1) / nullif(4 * n * n - CAST(e AS DOUBLE), 0) AS alpha FROM seen JOIN chance USING (field) JOIN eq USING (field)"
)
def ordinal_agreement(s, d):
    return evaluate.ordinal_agreement(view(s, d, "coder_a"), view(s, d, "coder_b"))


@query(
    ", c AS (SELECT unit, field, 'a' AS coder, code FROM coder_a UNION ALL SELECT unit, field, 'b', code FROM coder_b UNION ALL SELECT unit, field, 'c', CASE WHEN unit % 4 = 0 THEN '2' ELSE code END FROM coder_a WHERE unit % 3 <> 0), "
    "k AS (SELECT *, count(*) OVER (PARTITION BY field, unit) AS m FROM c), n AS (SELECT field, code, count(*) AS n FROM k WHERE m > 1 GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY field ORDER BY code::DOUBLE) - n / 2.0 AS place FROM n), "
    "o AS (SELECT x.field, sum((x.code <> y.code)::INT / (x.m - 1)) AS nominal, sum(power(u.place - v.place, 2) / (x.m - 1)) AS ordinal FROM k x JOIN k y ON y.field = x.field AND y.unit = x.unit AND y.coder <> x.coder JOIN r u ON u.field = x.field AND u.code = x.code JOIN r v ON v.field = y.field AND v.code = y.code GROUP BY x.field), "
    "e AS (SELECT u.field, sum(u.n * v.n * (u.code <> v.code)::INT) AS nominal, sum(u.n * v.n * power(u.place - v.place, 2)) AS ordinal FROM r u JOIN r v ON v.field = u.field GROUP BY u.field), t AS (SELECT field, count(DISTINCT unit) AS units, count(*) AS codes FROM k WHERE m > 1 GROUP BY field) "
    "SELECT field, units, codes, 1 - (codes - 1) * o.nominal / e.nominal AS alpha_nominal, 1 - (codes - 1) * o.ordinal / e.ordinal AS alpha_ordinal FROM t JOIN o USING (field) JOIN e USING (field)"
)
def krippendorff_alpha(s, d):
    a, b = view(s, d, "coder_a"), view(s, d, "coder_b")
    third = a.where("unit % 3 <> 0").withColumn("code", F.when(F.col("unit") % 4 == 0, "2").otherwise(F.col("code")))
    codes = [df.select("unit", "field", F.lit(name).alias("coder"), "code") for name, df in (("a", a), ("b", b), ("c", third))]
    return evaluate.krippendorff_alpha(codes[0].unionByName(codes[1]).unionByName(codes[2]))


@query(
    ", e AS (SELECT DISTINCT p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' (2)' ELSE ' (4)' END || '.pdf' AS name FROM part WHERE p_partkey % 11 = 0), u AS (SELECT p_partkey AS arrival, p_name || '.pdf' AS wanted, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part), "
    "f AS (SELECT wanted, name, row_number() OVER (PARTITION BY wanted ORDER BY n) AS r FROM (SELECT wanted, n, CASE n WHEN 1 THEN wanted ELSE replace(wanted, '.pdf', ' (' || n || ').pdf') END AS name FROM (SELECT wanted, unnest(range(1, max(r) + 4)) AS n FROM u GROUP BY wanted)) WHERE name NOT IN (SELECT name FROM e)) "
    "SELECT arrival, wanted, name FROM u JOIN f USING (wanted, r)"
)
def unique_document_name(s, d):
    k = F.col("p_partkey")
    parts = table(s, d, "part")
    there = parts.where(k % 11 == 0).select(F.concat("p_name", F.when(k % 3 == 0, "").when(k % 3 == 1, " (2)").otherwise(" (4)"), F.lit(".pdf")).alias("name"))
    return uploads.unique_document_name(parts.select(k.alias("arrival"), F.concat("p_name", F.lit(".pdf")).alias("wanted")), there)


@query(
    "SELECT operation_id, sequence, CASE WHEN sequence % 7 = 6 THEN 'cancelled' WHEN http_status <> 200 THEN 'error' WHEN content LIKE '%?%' OR length(content) < 60 THEN 'needs_review' ELSE 'ok' END AS status, "
    "CASE WHEN http_status <> 200 THEN 'HTTP ' || http_status WHEN sequence % 7 = 6 THEN NULL WHEN content LIKE '%?%' AND length(content) < 60 THEN 'not a record; short' WHEN content LIKE '%?%' THEN 'not a record' WHEN length(content) < 60 THEN 'short' END AS error FROM exchanges"
)
def attempt_status(s, d):
    failed = F.when(F.col("http_status") != 200, F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
    problem = F.when(F.col("content").contains("?"), "not a record")
    flags = F.array(F.when(F.length("content") < 60, "short"))
    state = results.attempt_status(failed, F.col("sequence") % 7 == 6, problem, flags)
    return view(s, d, "exchanges").withColumn("r", state).select("operation_id", "sequence", "r.status", "r.error")


@query("SELECT CAST(NULL AS INT) AS row_number, 'A coding-sheet row has the wrong number of cells.' AS message WHERE EXISTS (SELECT * FROM documents WHERE doc_id % 10 = 0)")
def sheet_shape_check(s, d):
    cells = F.array("row_id", "source_pdf", "locator", "authors", "year", "title", "doi")
    rows = view(s, d, "sheet").select(F.when(F.col("ordinal") % 10 == 0, F.slice(cells, 1, 6)).otherwise(cells).alias("cells"))
    return sheet.sheet_shape_check([*sheet.REQUIRED, *sheet.OPTIONAL], rows)


@query(
    rf", g AS (SELECT doc_id, 'Paper_X-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '_' || (1990 + doc_id % 40) ELSE '' END AS stem, coalesce(text, '') AS page FROM documents), t AS (SELECT stem || '.pdf' AS name, stem, page, translate(stem, '_-', '  ') || ' ' || page AS text FROM g) "
    rf"SELECT name, list_sort(list_distinct(list_filter({_TOKENS}, lambda t: NOT list_contains({_STOP}, t) AND (length(t) >= 2 OR regexp_matches(t, '^\p{{Nd}}+$'))))) AS tokens, "
    r"coalesce(nullif(regexp_extract(stem, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(page, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), '')) AS year FROM t"
)
def document_signal(s, d):
    return linkage.document_signal(_named_texts(s, d))


def _named_texts(s, d):
    docs, id_ = table(s, d, "documents"), F.col("doc_id")
    year = F.when(id_ % 2 == 0, F.concat(F.lit("_"), (1990 + id_ % 40).cast("string"))).otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n[Page 2]\nlater words of 1907"))
    return docs.select(F.concat(F.lit("Paper_X-"), id_.cast("string"), year, F.lit(".pdf")).alias("name"), text.alias("text"))


@query(
    "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_name || '.PDF' WHEN 1 THEN 'a_b_' || p_partkey || '.pdf' WHEN 2 THEN '_con.pdf' END AS name, "
    "CASE p_partkey % 5 WHEN 3 THEN p_name || '.txt is not a PDF.' WHEN 4 THEN 'A file name is required.' END AS error FROM part"
)
def safe_document_name(s, d):
    id_ = F.col("p_partkey")
    given = F.when(id_ % 5 == 0, F.concat(F.lit("dir\\"), "p_name", F.lit(".PDF"))).when(id_ % 5 == 1, F.concat(F.lit("/x/a<>b?"), id_.cast("string"), F.lit(".pdf. "))).when(id_ % 5 == 2, "con.pdf").when(id_ % 5 == 3, F.concat("p_name", F.lit(".txt"))).otherwise(" .. ")
    return table(s, d, "part").withColumn("r", tx.safe_document_name(given)).select(id_.alias("id"), "r.name", "r.error")


_PAIRS = ORACLE_SQL["containment_score"]


@query()
def contested_demotion(s, d):
    scores = staging.stage(_scores(s, d), "scores")
    return linkage.contested_demotion(scores, linkage.assign_one_to_one(scores))


ORACLE_SQL["contested_demotion"] = _ASSIGNED + "SELECT key, key IN (SELECT key FROM rivals) AS contested FROM assigned"


@query()
def incremental_pair_scores(s, d):
    """Half of the papers and two thirds of the documents are scored in advance; another version's scores must not count."""
    papers, signals = _paper_rows(s, d), _signals(s, d)
    none = s.createDataFrame([], "paper_hash string, signal_hash string, version string, score double")
    score = functools.partial(linkage.incremental_pair_scores, score=linkage.containment_score)
    _, stored = score(papers.where("cast(key as long) % 2 = 0"), signals.where("cast(name as long) % 3 <> 0"), none, none, none)
    _, old = score(papers, signals, none, none, none, version="1")
    stored = staging.stage(stored.unionByName(old.withColumn("score", F.lit(9.0))), "stored")
    return score(papers, signals, stored, stored, stored)[0]


ORACLE_SQL["incremental_pair_scores"] = _PAIRS

#: One answer per order, of each kind that the rules tell apart.
_FIELDS = (responses.Field("n", "integer"), responses.Field("flag", "string", ("F", "O"), evidence_required=False))
_ANSWERS = """SELECT concat('order', CAST(o_orderkey AS STRING), '.pdf') AS source_pdf, CASE o_orderkey % 9 WHEN 0 THEN 'no record' WHEN 1 THEN '[1]' WHEN 2 THEN '{{"x":1}}'
    WHEN 3 THEN '{{"effects":[{{"row_id":5}}]}}' WHEN 4 THEN '{{"effects":[{{"row_id":"a"}},{{"row_id":"a"}}]}}' WHEN 5 THEN '{{"effects":[{{"row_id":"a","flag":1}}]}}'
    WHEN 6 THEN '{{"effects":[{{"row_id":"a","flag":1,"n":{{"value":1}}}}]}}'
    ELSE concat('{{"effects":[{{"row_id":"b","n":{{"value":null,"evidence":"p. 1"}},"flag":{{"value":null}}}},{{"row_id":"', CASE WHEN o_custkey % 4 = 0 THEN 'c' ELSE 'a' END, '","flag":{{"value":"', o_orderstatus, '"}},"n":{{"value":', CAST(o_custkey AS STRING), ',"evidence":"p. 2"}}}}]}}') END AS raw, o_orderkey, o_custkey, o_orderstatus FROM {orders}"""
_PLAIN = _ANSWERS.format(orders="orders").replace("AS STRING", "AS VARCHAR")
_JUDGED_ANSWERS = f""", answers AS ({_PLAIN}), verdict AS (SELECT *, CASE WHEN o_orderkey % 9 < 7 THEN ['json', 'object', 'effects', 'row_id', 'duplicate', 'omitted', 'malformed'][o_orderkey % 9 + 1] WHEN o_orderstatus NOT IN ('F', 'O') THEN 'invalid' WHEN o_custkey % 4 = 0 THEN 'ids' END AS stage FROM answers),
  told AS (SELECT *, CASE stage WHEN 'json' THEN 'Response is not valid JSON.' WHEN 'object' THEN 'Response is not a JSON object.' WHEN 'effects' THEN 'Response is missing an `effects` array.' WHEN 'row_id' THEN 'effects[1] is missing a non-empty string `row_id`.'
  WHEN 'duplicate' THEN 'Duplicate row_id in response: `a`.' WHEN 'omitted' THEN 'Response omitted required field(s): `a`: n.' WHEN 'malformed' THEN 'Response returned malformed field value(s): `a`: flag.'
  WHEN 'invalid' THEN 'Response returned invalid field value(s): `' || CASE WHEN o_custkey % 4 = 0 THEN 'c' ELSE 'a' END || '`: flag.' WHEN 'ids' THEN 'Returned row_id set does not match the requested set.' END AS error FROM verdict) """


def _answers(s, d):
    return s.sql(_ANSWERS, orders=table(s, d, "orders"))


def _asked(s, d):
    return _answers(s, d).select("source_pdf", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("row_id"))


@query(
    "SELECT source_pdf, c.position, c.row_id, c.field, c.value_type, c.value_text, c.evidence FROM (SELECT source_pdf, unnest(["
    "{'position': 1, 'row_id': 'b', 'field': 'n', 'value_type': 'null', 'value_text': NULL, 'evidence': 'p. 1'}, {'position': 1, 'row_id': 'b', 'field': 'flag', 'value_type': 'null', 'value_text': NULL, 'evidence': NULL}, "
    "{'position': 2, 'row_id': CASE WHEN o_custkey % 4 = 0 THEN 'c' ELSE 'a' END, 'field': 'flag', 'value_type': 'string', 'value_text': o_orderstatus, 'evidence': NULL}, "
    "{'position': 2, 'row_id': CASE WHEN o_custkey % 4 = 0 THEN 'c' ELSE 'a' END, 'field': 'n', 'value_type': 'integer', 'value_text': CAST(o_custkey AS VARCHAR), 'evidence': 'p. 2'}]) AS c FROM answers WHERE o_orderkey % 9 > 6) "
    "UNION ALL SELECT source_pdf, 1, 'a', 'flag', 'null', NULL, NULL FROM answers WHERE o_orderkey % 9 IN (5, 6) UNION ALL SELECT source_pdf, 1, 'a', 'n', 'integer', '1', NULL FROM answers WHERE o_orderkey % 9 = 6",
    _JUDGED_ANSWERS,
)
def parse_response_cells(s, d):
    return responses.parse_response_cells(_answers(s, d))[1].select("source_pdf", "position", "row_id", "field", "value_type", "value_text", "evidence")


@query("SELECT source_pdf, stage IS NULL AS ok, stage, error, CASE WHEN stage = 'ids' THEN ['a'] ELSE [] END AS missing, CASE WHEN stage = 'ids' THEN ['c'] ELSE [] END AS extra FROM told", _JUDGED_ANSWERS)
def validate_response(s, d):
    return responses.validate_response(responses.parse_response_cells(_answers(s, d))[0], _asked(s, d), _FIELDS)


@query("SELECT source_pdf, CASE WHEN o_orderkey % 11 = 0 THEN 'error' WHEN stage = 'json' THEN 'error' WHEN stage IS NULL THEN 'ok' ELSE 'needs_review' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN 'timed out' ELSE error END AS error, CASE WHEN o_orderkey % 11 <> 0 THEN raw END AS raw FROM told", _JUDGED_ANSWERS)
def replay(s, d):
    failed = F.col("o_orderkey") % 11 == 0
    attempts = _answers(s, d).select("source_pdf", F.when(failed, "error").otherwise("ok").alias("status"), F.when(failed, "timed out").alias("error"), F.when(~failed, F.col("raw")).alias("raw"))
    return responses.replay(attempts, _asked(s, d), _FIELDS)


@query(
    """, f AS (SELECT codebook_id, ordinal, field, type, level_text, confidence, to_json(field)::VARCHAR AS q FROM fields JOIN codebooks USING (codebook_id) WHERE type <> 'date' AND trim(field) <> ''),
    j AS (SELECT codebook_id, ordinal, q, q || ':{"type":"object","description":' || to_json('Coded value for `' || field || '`.')::VARCHAR || ',"properties":{"value":{"type":["' || type || '","null"]'
      || CASE WHEN level_text IS NULL THEN '' ELSE ',"enum":[' || array_to_string(list_transform(string_split(level_text, ' '), lambda x: to_json(x)::VARCHAR), ',') || ',null]' END || '}'
      || CASE WHEN confidence AND field <> 'notes' THEN ',"confidence":{"type":"string","description":"How confident you are in this value.","enum":["high","medium","low"]}' ELSE '' END
      || ',"evidence":{"type":"string","description":"Page number or a short quotation that supports this value."}},"required":["value"' || CASE WHEN confidence AND field <> 'notes' THEN ',"confidence"' ELSE '' END || ',"evidence"],"additionalProperties":false}' AS one FROM f)
    SELECT codebook_id, '{"type":"object","properties":{"effects":{"type":"array","description":"One entry per requested row.","items":{"type":"object","properties":{"row_id":{"type":"string","description":"One of the requested row ids, unchanged."},' || string_agg(one, ',' ORDER BY ordinal)
      || '},"required":["row_id",' || string_agg(q, ',' ORDER BY ordinal) || '],"additionalProperties":false}}},"required":["effects"],"additionalProperties":false}' AS schema_json FROM j GROUP BY codebook_id"""
)
def response_schema(s, d):
    fields = _fields(s, d).where("type <> 'date' and trim(field) <> ''").withColumn("description", F.lit(None).cast("string")).withColumn("evidence_required", F.lit(True))
    return responses.response_schema(view(s, d, "codebooks"), fields)


@query(
    "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'http_error' WHEN user_id % 6 = 0 THEN 'transport_error' WHEN event_type IN ('click', 'view') THEN 'received' ELSE 'in_progress' END AS status, "
    "CASE WHEN user_id % 6 <> 0 THEN CASE event_type WHEN 'click' THEN 'm1' WHEN 'view' THEN 'm2' END END AS reported_model, CASE WHEN user_id % 6 <> 0 THEN CASE event_type WHEN 'click' THEN 'r' || event_id WHEN 'view' THEN 'i' || event_id END END AS response_id, "
    "CASE WHEN user_id % 6 <> 0 AND event_type = 'view' THEN 'fp' END AS system_fingerprint, CASE WHEN user_id % 6 <> 0 THEN CASE event_type WHEN 'click' THEN '{\"promptTokenCount\":' || user_id || '}' WHEN 'view' THEN '{\"prompt_tokens\":' || user_id || '}' END END AS usage FROM events"
)
def exchange_facts(s, d):
    e = table(s, d, "events")
    id_, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    click = F.concat(F.lit('{"modelVersion":"m1","responseId":"r'), id_, F.lit('","usageMetadata":{"promptTokenCount":'), user, F.lit("}}"))
    seen = F.concat(F.lit('{"model":"m2","id":"i'), id_, F.lit('","system_fingerprint":"fp","usage":{"prompt_tokens":'), user, F.lit("}}"))
    raw = F.when(F.col("event_type") == "click", click).when(F.col("event_type") == "view", seen)
    http = F.when(F.col("event_type") == "error", 503).when(raw.isNotNull(), 200)
    error = F.when((F.col("user_id") % 6 == 0) & (F.col("event_type") != "error"), "timed out")
    return responses.exchange_facts(e.select(F.col("event_id").alias("id"), http.alias("http_status"), error.alias("error"), raw.alias("raw")))


# Files and streams, written from the given tables and read back


def _folder(s) -> str:
    return f"{staging.shared_dir(s)}/paperloom-files-{uuid.uuid4().hex}"


_SHEET_COLUMNS = ("row_id", "source_pdf", "locator", "authors", "year", "title", "doi")


@query(f"SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in _SHEET_COLUMNS)} FROM sheet")
def scan_sheet(s, d):
    """The sheet, written as CSV files and read strictly."""
    path = _folder(s)
    view(s, d, "sheet").select(*_SHEET_COLUMNS).write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return sheets.scan_sheet(s, path)[0].select(*_SHEET_COLUMNS)


@query(", n AS (SELECT count(*) FILTER (kind = 'sheet') AS sheet_issues FROM issues) SELECT sheet_issues = 0 AND valid_rows > 0 AS runnable, sheet_issues, valid_rows FROM n, (SELECT count(*) AS valid_rows FROM valid)", _JUDGED)
def sheet_runnable(s, d):
    return sheet.sheet_runnable(sheet.sheet_row_issues(view(s, d, "sheet"), view(s, d, "uploaded")), _valid(s, d))


@query("SELECT CAST(min(doc_id) + 2 AS BIGINT) AS row_number, 'error' AS severity, 'a row has the wrong number of cells' AS message FROM documents WHERE doc_id % 10 = 7 HAVING count(*) > 0 AND (SELECT count(*) FROM documents) BETWEEN 1 AND 1000000000")
def draft_shape_check(s, d):
    cells = F.array(*_SHEET_COLUMNS)
    rows = view(s, d, "sheet").select("ordinal", F.when(F.col("ordinal") % 10 == 7, F.slice(cells, 1, 6)).otherwise(cells).alias("cells"))
    return sheet.draft_shape_check(list(_SHEET_COLUMNS), rows, 1_000_000_000)


@query("SELECT o_orderkey AS ordinal FROM orders WHERE o_custkey % 4 = 0")
def untraced_rows(s, d):
    listed = F.when(F.col("o_custkey") % 4 != 0, F.array("o_orderkey")).when(F.col("o_custkey") % 8 == 0, F.array().cast("array<bigint>"))
    return sheet.untraced_rows(table(s, d, "orders").select(F.col("o_orderkey").alias("ordinal"), listed.alias("source_rows")))


def _coded(s, d):
    """Records of coded values whose JSON types differ from supplier to supplier."""
    t = table(s, d, "supplier")
    yes = F.when(F.col("s_acctbal") > 5000, "true").otherwise('"true"')
    fields = ('"name":{"value":"', F.col("s_name"), '","confidence":"low","evidence":"p. 1"},"nation":{"value":', F.col("s_nationkey").cast("string"), '},"big":{"value":', yes, '},"gone":{"value":null},"none":{"evidence":3},"odd":', F.when(F.col("s_suppkey") % 2 == 0, "1").otherwise("[]"))
    text = F.concat(F.lit('{"r1":{'), *(F.lit(x) if isinstance(x, str) else x for x in fields), F.lit('},"r2":null}'))
    return t.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("source_pdf"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("ok").alias("status"), F.parse_json(text).alias("coded_by_row_id"))


def _write_records(records, path):
    """A file per record. Opening files is the work, so tasks have few of them each, and move them themselves when they end."""
    dealt = records.repartition(sheets.file_tasks(records.count()), "source_pdf")
    dealt.write.option("maxRecordsPerFile", 1).option(*sheets.MOVED_BY_TASKS).json(path)


@query(
    "SELECT 's' || s_suppkey || '.pdf' AS source_pdf, 'r1' AS row_id, field, is_object, present, value_type, value_text, CASE WHEN field = 'name' THEN 'low' END AS confidence, CASE field WHEN 'name' THEN 'p. 1' WHEN 'none' THEN '3' END AS evidence, field = 'name' AS evidence_is_string "
    "FROM (SELECT s_suppkey, unnest([{'field': 'name', 'is_object': true, 'present': true, 'value_type': 'string', 'value_text': s_name}, {'field': 'nation', 'is_object': true, 'present': true, 'value_type': 'integer', 'value_text': s_nationkey::VARCHAR}, "
    "{'field': 'big', 'is_object': true, 'present': true, 'value_type': CASE WHEN s_acctbal > 5000 THEN 'boolean' ELSE 'string' END, 'value_text': 'true'}, {'field': 'gone', 'is_object': true, 'present': true, 'value_type': 'null', 'value_text': NULL}, "
    "{'field': 'none', 'is_object': true, 'present': false, 'value_type': NULL, 'value_text': NULL}, {'field': 'odd', 'is_object': false, 'present': false, 'value_type': NULL, 'value_text': NULL}], recursive := true) FROM supplier)"
)
def scan_results(s, d):
    """A record per supplier, each in a file of its own, read with its values' types."""
    path = _folder(s)
    _write_records(_coded(s, d), path)
    return files.result_cells(files.scan_results(s, path)).drop("value")


@query("SELECT DISTINCT sha256(content) AS sha256, strlen(content)::BIGINT AS bytes FROM exchanges WHERE content IS NOT NULL")
def append_blobs(s, d):
    """Two appends that overlap; the store has each content once."""
    path, payloads = _folder(s), view(s, d, "exchanges").select("operation_id", "sequence", "content")
    audit.append_blobs(payloads.where("operation_id % 3 <> 0"), path)
    audit.append_blobs(payloads.where("operation_id % 3 <> 1"), path)
    return s.read.parquet(path).select("sha256", "bytes")


@query("SELECT source_pdf, attempt, status FROM selected", _LAST)
def stream_selected_result(s, d):
    """Attempts as a stream into a stored table; what stands in it."""
    rows, at = staging.stage(view(s, d, "attempts").select("source_pdf", "attempt", "attempt_ts", "status"), "attempts"), _folder(s)
    jobs.stream_results(s.readStream.schema(rows.schema).parquet(rows._staged), f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return results.selected_result(jobs.read_table(s, f"{at}/table", jobs.standing)).select("source_pdf", "attempt", "status")


@query("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 10 OFFSET (SELECT 10 * (ceil(count(*) / 10)::BIGINT // 2 - 1) FROM orders)")
def paginate_deep(s, d):
    """The page in the middle, from the range of rows that holds it."""
    pages = results.Pages(table(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ranges=16)
    return pages.page(-(-pages.n // 10) // 2)


@query()
def stream_signals(s, d):
    """Documents as a stream, each name twice, the older version last; the stored table has the signals of the newer ones."""
    new = _named_texts(s, d).withColumn("arrived", F.lit(2).cast("long"))
    old = new.withColumns({"text": F.lit("an older text of 1955"), "arrived": F.lit(1).cast("long")})
    at = _folder(s)
    for part in (new, old):
        part.write.mode("append").parquet(f"{at}/arriving")
        jobs.stream_signals(s.readStream.schema(new.schema).parquet(f"{at}/arriving"), f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return jobs.read_table(s, f"{at}/table", jobs.last_signal).select("name", "tokens", "year")


ORACLE_SQL["stream_signals"] = ORACLE_SQL["document_signal"]


@query(
    "SELECT '{\"source_pdf\":\"s' || s_suppkey || '.pdf\",\"status\":\"' || CASE WHEN s_suppkey % 4 = 0 THEN 'error' ELSE 'ok' END || '\",\"effects\":{\"r1\":{\"locator\":\"Table ' || s_nationkey || '\",\"fields\":{\"name\":{\"value\":\"' || s_name || '\",\"confidence\":\"low\",\"evidence\":\"p. 1\"},\"nation\":{\"value\":' || s_nationkey "
    "|| ',\"evidence\":null},\"big\":{\"value\":' || CASE WHEN s_acctbal > 5000 THEN 'true' ELSE '\"true\"' END || ',\"evidence\":null},\"gone\":{\"value\":null,\"evidence\":null}}},\"r2\":{\"locator\":\"\",\"status\":\"not returned by the model\"}}}' AS record FROM supplier"
)
def sink_document_record(s, d):
    """A record per supplier, from records read with their types; written, a file each, and read back."""
    raw, out = _folder(s), _folder(s)
    _write_records(_coded(s, d), raw)
    read = staging.stage(files.scan_results(s, raw).select("source_pdf", "status", "coded_by_row_id", "missing_ids", "extra_ids"), "records")
    t = table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("source_pdf"), F.col("s_suppkey").cast("long").alias("at"), F.concat(F.lit("Table "), F.col("s_nationkey").cast("string")).alias("locator"))
    rows = t.select("source_pdf", (F.col("at") * 2).alias("ordinal"), F.lit("r1").alias("row_id"), "locator").unionByName(t.select("source_pdf", (F.col("at") * 2 + 1).alias("ordinal"), F.lit("r2").alias("row_id"), F.lit("").alias("locator")))
    sheets.sink_document_record(sheets.document_records(rows, files.result_cells(read), read, ["name", "nation", "big", "gone"], rated=("name",)), out)
    # the folders' names aren't needed: no types are guessed from them
    return s.read.text(out, wholetext=True, recursiveFileLookup=True).select(F.trim(F.col("value"), F.lit("\n")).alias("record"))


@query()
def sink_wide_csv(s, d):
    """The coded table, written as CSV files and read back, where blanks are blank: CSV doesn't tell them from null."""
    out, wide = _folder(s), QUERIES["collate_coded"](s, d)
    sheets.sink_wide_csv(wide, FIELDS, out)
    names = ("row_id", "source_pdf", "locator", "authors", "year", "status", *FIELDS)
    return s.read.csv(out, header=True, schema=", ".join(f"`{c}` string" for c in names), quote='"', escape='"').na.fill("")


ORACLE_SQL["sink_wide_csv"] = ORACLE_SQL["collate_coded"]
