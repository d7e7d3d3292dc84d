"""The coding sheet: its rows' issues, the valid rows, and what they say of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is said of a row, of its id (1), source (2) and the row where its id stood first (3).
MESSAGES = {
    "no id": "row_id is required.",
    "twice": "row_id `%1$s` is a duplicate (first used on row %3$d).",
    "no authors": "row_id `%1$s` has no authors.",
    "no year": "row_id `%1$s` has no year.",
    "no source": "row_id `%1$s` has no source_pdf.",
    "unknown": "row_id `%1$s` references `%2$s`, which has not been uploaded.",
}
FIELDS = ("row_id", "source_pdf", "locator", "authors", "year", "title", "doi")


def trimmed(rows: DataFrame) -> DataFrame:
    """All text fields without outer blanks; null counts as blank."""
    return rows.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in FIELDS if c in rows.columns})


def _judged(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """The first failing rule of each row. Rows are numbered from 2, below the header."""
    rows = trimmed(rows)
    # the first use of a row_id counts, whether or not that row is valid; blanks are never equal
    first = rows.where("row_id <> ''").groupBy("row_id").agg(F.min("ordinal").alias("first_use"))
    known = documents.select(F.col("name").alias("source_pdf"), F.lit(True).alias("_known")).distinct()
    # rows without an id have no first use; a key of their own each keeps them from meeting in one task
    own = F.when(F.col("row_id") == "", F.concat(F.lit("\0"), F.col("ordinal").cast("string"))).otherwise(F.col("row_id"))
    rows = rows.withColumn("_id", own).join(first.withColumnRenamed("row_id", "_id"), "_id", "left").drop("_id").join(known, "source_pdf", "left").withColumn("row_number", F.col("ordinal") + 2)
    say = lambda name: F.format_string(MESSAGES[name], F.col("row_id"), F.col("source_pdf"), F.col("first_use") + 2)
    problem = (
        F.when(F.col("row_id") == "", say("no id"))
        .when(F.col("first_use") < F.col("ordinal"), say("twice"))
        .when(F.col("authors") == "", say("no authors"))
        .when(F.col("year") == "", say("no year"))
        .when(F.col("source_pdf") == "", say("no source"))
        .when(F.col("_known").isNull(), say("unknown"))
    )
    kind = F.when(problem.isNotNull(), F.when((F.col("row_id") != "") & ~(F.coalesce(F.col("first_use"), F.col("ordinal")) < F.col("ordinal")) & (F.col("authors") != "") & (F.col("year") != ""), "pdf").otherwise("sheet"))
    return rows.withColumn("message", problem).withColumn("kind", kind)


def sheet_row_issues(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(row_number, row_id, message, kind) of each row that breaks a rule; ``ordinal`` counts rows from 0."""
    return _judged(rows, documents).where("message is not null").select("row_number", "row_id", "message", "kind")


def sheet_valid_rows(rows: DataFrame, documents: DataFrame) -> DataFrame:
    return _judged(rows, documents).where("message is null").select("ordinal", *(c for c in FIELDS if c in rows.columns))


def sheet_issue_kinds(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind").agg(F.count("*").alias("n"))


def sheet_runnable(issues: DataFrame, valid: DataFrame) -> DataFrame:
    """(runnable, sheet_issues, valid_rows), one row: a run may start if no issue is the sheet's own and some row is valid;
    rows whose document is not there are left out of it."""
    own = issues.where("kind = 'sheet'").agg(F.count("*").alias("sheet_issues"))
    counts = own.crossJoin(F.broadcast(valid.agg(F.count("*").alias("valid_rows"))))  # one row each
    return counts.select(((F.col("sheet_issues") == 0) & (F.col("valid_rows") > 0)).alias("runnable"), "sheet_issues", "valid_rows")


def rows_per_document(valid: DataFrame) -> DataFrame:
    """All rows of a document together, in sheet order: what one request asks for."""
    rows = F.sort_array(F.collect_list(F.struct("ordinal", "row_id", "locator")))
    return valid.groupBy("source_pdf").agg(F.transform(rows, lambda r: r["row_id"]).alias("row_ids"), F.transform(rows, lambda r: r["locator"]).alias("locators"))


def orphan_documents(documents: DataFrame, valid: DataFrame) -> DataFrame:
    """Documents that no valid row names."""
    return documents.select("name").join(valid.select(F.col("source_pdf").alias("name")), "name", "left_anti")


def draft_sheet_validate(rows: DataFrame, require_complete: bool = False) -> DataFrame:
    """(row_number, severity, message) for a drafted sheet: ids must be unique and there, the rest only warns unless
    ``require_complete``."""
    rows = trimmed(rows)
    uses = rows.groupBy("row_id").agg(F.min("ordinal").alias("first_use"))
    rows = rows.join(uses, "row_id").withColumn("row_number", F.col("ordinal") + 2)
    soft = "error" if require_complete else "warning"

    def issue(when: Column, severity: str, text: str) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("message")))

    found = F.array_compact(
        F.array(
            issue(F.col("row_id") == "", "error", "row_id is required"),
            issue((F.col("row_id") != "") & (F.col("first_use") < F.col("ordinal")), "error", "row_id is a duplicate"),
            issue(F.col("authors") == "", soft, "authors missing"),
            issue(F.col("year") == "", soft, "year missing"),
            issue(F.col("source_pdf") == "", "warning", "source missing"),
        )
    )
    return rows.select("row_number", F.explode(found).alias("i")).select("row_number", "i.severity", "i.message")


DRAFT_ROWS = 2_000


def draft_shape_check(header: list[str], rows: DataFrame, max_rows: int = DRAFT_ROWS) -> DataFrame:
    """(row_number, severity, message): what makes a drafted sheet as a whole unusable, the first problem only: other headers
    or another order of them than the sheet's, no rows or too many, or a row (cells, an array) with another number of
    cells, of which the first is named; ``ordinal`` counts rows from 0."""
    wrong = F.min(F.when(F.coalesce(F.size("cells"), F.lit(0)) != len(FIELDS), F.col("ordinal"))).alias("wrong")
    seen = rows.agg(F.count("*").alias("n"), wrong)
    problem = (
        F.when(F.lit(list(header) != list(FIELDS)), F.lit("the headers or their order differ"))
        .when((F.col("n") < 1) | (F.col("n") > max_rows), F.lit(f"the sheet must have 1 to {max_rows} rows"))
        .when(F.col("wrong").isNotNull(), F.lit("a row has the wrong number of cells"))
    )
    return seen.select((F.when(problem == "a row has the wrong number of cells", F.col("wrong") + 2)).cast("long").alias("row_number"), F.lit("error").alias("severity"), problem.alias("message")).where("message is not null")


def untraced_rows(out: DataFrame) -> DataFrame:
    """(ordinal) of output rows that list no source row at all."""
    return out.where(F.coalesce(F.size("source_rows"), F.lit(0)) <= 0).select("ordinal")


#: Rows that one task compares.
ROWS_A_TASK = 1_000_000


def lineage_coverage(out: DataFrame, source: DataFrame) -> DataFrame:
    """(source_row, problem): source rows that no output row (``source_rows`` array) lists, and listed rows that aren't
    there, null ones among them. Output rows that list none are ``untraced_rows``."""
    listed = out.select(F.explode("source_rows").alias("source_row"), F.lit(True).alias("listed"))
    both = listed.unionByName(source.select("source_row", F.lit(False).alias("listed")))
    # one pass over both sides, in tasks of bounded size however well their rows are compressed
    n = (out.agg(F.sum(F.greatest(F.size("source_rows"), F.lit(0)))).first()[0] or 0) + source.count()
    seen = both.repartition(-(-n // ROWS_A_TASK) or 1, "source_row").groupBy("source_row").agg(F.bool_or("listed").alias("listed"), F.bool_and("listed").alias("absent"))
    # nulls are equal to none
    none = F.col("source_row").isNull()
    problems = F.array_compact(F.array(F.when(~F.col("absent") & (none | ~F.col("listed")), "omitted"), F.when(F.col("listed") & (none | F.col("absent")), "invalid")))
    return seen.select("source_row", F.explode(problems).alias("problem"))


def unmatch(rows: DataFrame, name: str) -> DataFrame:
    """The rows of one document lose their source."""
    return rows.withColumn("source_pdf", F.when(F.trim("source_pdf") == name, "").otherwise(F.col("source_pdf")))


def apply_matches(rows: DataFrame, mapping: DataFrame, documents: DataFrame, key: Column) -> DataFrame:
    """Rows whose paper is in ``mapping`` (key, name), the name being a known document, get that source."""
    mapping = mapping.join(documents.select("name").distinct(), "name", "left_semi").select(F.col("key").alias("_key"), F.col("name").alias("_name"))
    out = rows.withColumn("_own", key).join(mapping, F.col("_own") == F.col("_key"), "left")
    return out.withColumn("source_pdf", F.coalesce("_name", "source_pdf")).select(rows.columns)


def papers(rows: DataFrame, documents: DataFrame, key: Column, matched: bool) -> DataFrame:
    """Papers whose source is (not) a document: the first row's attributes, and the number of rows."""
    known = documents.select(F.col("name").alias("source_pdf")).distinct()
    rows = trimmed(rows).join(known, "source_pdf", "left_semi" if matched else "left_anti").withColumn("key", key).where("key is not null")
    first = [F.min_by(c, "ordinal").alias(c) for c in ("source_pdf", "authors", "year", "locator", "title", "doi")]
    return rows.groupBy("key").agg(*first, F.count("*").alias("row_count"))


#: The columns that a sheet must have, and those that it may have.
REQUIRED, OPTIONAL = ("row_id", "source_pdf", "locator", "authors", "year"), ("title", "doi")


def shape_problem(header: list[str], ragged: bool) -> str | None:
    """Why a file with this header is no sheet; ``ragged``: some row has another number of cells, which is judged before
    names."""
    absent, other = [c for c in REQUIRED if c not in header], [c for c in header if c not in REQUIRED + OPTIONAL]
    if len(header) != len(set(header)):
        return "Duplicate coding-sheet column headers."
    if ragged:
        return "A coding-sheet row has the wrong number of cells."
    if absent:
        return f"Missing required column(s): {', '.join(absent)}."
    if other:
        return f"Unexpected column(s): {', '.join(other)}. The coding sheet only accepts {', '.join(REQUIRED + OPTIONAL)}."
    return None


def sheet_shape_check(header: list[str], rows: DataFrame) -> DataFrame:
    """(row_number, message): why a file as a whole is no sheet, at most one issue; rows (cells, an array) are looked at
    only for their number of cells. Null cells count as none."""
    ragged = rows.where(F.coalesce(F.size("cells"), F.lit(0)) != len(header)).limit(1)
    both = ragged.agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, shape_problem(header, True)).otherwise(shape_problem(header, False)).alias("message"))
    return both.where("message is not null").select(F.lit(None).cast("int").alias("row_number"), "message")
