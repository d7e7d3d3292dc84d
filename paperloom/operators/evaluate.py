"""Scores of coded cells against human codes, and agreement of coders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.values import number_of, values_match


def score_cells(truth: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Human codes (row_id, field, value, missing, compare) of documents that were run (``rows``: row_id) against
    cells (row_id, field, value_type, value_text, confidence): was each coded right?"""
    t = truth.join(rows.select("row_id").distinct(), "row_id").join(cells, ["row_id", "field"], "left")
    coded = F.when((F.col("value_type") == "null") | (F.trim("value_text") == ""), F.lit(None).cast("string")).otherwise(F.col("value_text"))
    returned = F.col("value_type").isNotNull()
    absent = F.coalesce("missing", F.lit("")) != ""
    ok = F.when(absent, coded.isNull() & returned).otherwise(coded.isNotNull() & values_match(F.col("value_type"), F.col("value_text"), F.col("value"), F.col("compare")))
    return t.select("row_id", "field", ok.alias("ok"), "confidence", absent.alias("human_missing"), coded.alias("coded"), F.when(absent, F.col("missing")).otherwise(F.col("value")).alias("expected"))


def _tally(*extra: Column) -> list[Column]:
    return [F.count_if("ok").alias("correct"), F.count("*").alias("cells"), *extra]


def score_total(scored: DataFrame) -> DataFrame:
    s = scored.agg(*_tally())
    return s.withColumn("accuracy", F.when(F.col("cells") > 0, F.round(F.col("correct") / F.col("cells"), 4)))


def score_by_field(scored: DataFrame) -> DataFrame:
    return scored.groupBy("field").agg(*_tally())


def score_by_confidence(scored: DataFrame) -> DataFrame:
    return scored.where("confidence is not null").groupBy("confidence").agg(*_tally())


def missing_tallies(scored: DataFrame) -> DataFrame:
    """How missing values fared: left blank rightly, given where there is none, missed where there is one."""
    absent, coded = F.col("human_missing"), F.col("coded")
    return scored.agg(F.count_if(absent & F.col("ok")).alias("left_blank"), F.count_if(absent & coded.isNotNull()).alias("value_given"), F.count_if(~absent & coded.isNull()).alias("value_missed"))


def score_errors(scored: DataFrame) -> DataFrame:
    return scored.where("not ok").select("row_id", "field", "expected", "coded")


def score_rollup(scored: DataFrame) -> DataFrame:
    """Total, by field and by confidence from one pass over the cells."""
    level = F.when(F.grouping_id() == 3, "total").when(F.grouping_id() == 1, "field").otherwise("confidence")
    out = scored.groupingSets([(), ("field",), ("confidence",)], "field", "confidence").agg(level.alias("level"), *_tally())
    return out.where("not (level = 'confidence' and confidence is null)")


def run_rollup(results: DataFrame) -> DataFrame:
    """Results and tokens by status, and in all (status null), with the distinct ``provider/model`` and prompt versions,
    sorted. Columns that ``results`` lacks count as null."""
    have = lambda c, t: F.col(c).cast(t) if c in results.columns else F.lit(None).cast(t)
    said = lambda c: F.coalesce(have(c, "string"), F.lit("None"))
    r = results.select("status", *(have(c, "long").alias(c) for c in ("input_tokens", "output_tokens")), F.concat(said("provider"), F.lit("/"), said("model")).alias("by"), said("prompt_version").alias("prompt"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    sets = [F.sort_array(F.collect_set(c)).alias(name) for c, name in (("by", "providers"), ("prompt", "prompt_versions"))]
    return r.rollup("status").agg(F.count("*").alias("n"), *sums, *sets)


def regression_check(summary: DataFrame, baseline: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """What got worse between two one-row summaries (cells, accuracy, not_ok, and perhaps providers): one row per problem.
    Runs over other cells, or by other providers, can't be compared. A summary of several rows is an error."""
    one = lambda df: df.select("*", F.assert_true(F.count("*").over(Window.partitionBy(F.lit(0))) == 1, "a summary is one row").alias("_one")).where("_one is null").drop("_one")
    b = one(baseline.limit(2)).select(*(F.col(c).alias(f"b_{c}") for c in baseline.columns))
    both = one(summary.limit(2)).join(F.broadcast(b), F.lit(True))  # one row each
    others = F.lit(False)
    if "providers" in summary.columns and "providers" in baseline.columns:
        others = (F.coalesce(F.size("b_providers"), F.lit(0)) > 0) & ~F.sort_array("providers").eqNullSafe(F.sort_array("b_providers"))
    problems = F.array_compact(
        F.array(
            F.when(~F.col("cells").eqNullSafe(F.col("b_cells")), "cell count differs"),
            F.when(others, "providers differ"),
            F.when(F.col("accuracy") < F.col("b_accuracy") - tolerance, "accuracy fell"),
            F.when(F.col("not_ok") > F.col("b_not_ok"), "documents not ok rose"),
        )
    )
    return both.select(F.explode(problems).alias("problem"))


def agreement_by_field(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two coders' (unit, field, code): units, share that agree, and Cohen's kappa, by field."""
    pairs = a.select("unit", "field", F.col("code").alias("a")).join(b.select("unit", "field", F.col("code").alias("b")), ["unit", "field"])
    table = pairs.groupBy("field", "a", "b").agg(F.count("*").alias("n"))
    of = lambda *c: F.sum("n").over(Window.partitionBy("field", *c))
    table = table.withColumn("na", of("a")).withColumn("nb", of("b")).withColumn("all", of())
    # chance: sum over codes of the product of the marginals, found on the diagonal and completed where it is empty
    left = table.groupBy("field", F.col("a").alias("code")).agg(F.first("na").alias("na"), F.first("all").alias("all"))
    right = table.groupBy("field", F.col("b").alias("code")).agg(F.first("nb").alias("nb"))
    chance = left.join(right, ["field", "code"]).groupBy("field").agg(F.sum(F.col("na") * F.col("nb") / (F.col("all") * F.col("all"))).alias("pe"))
    seen = table.groupBy("field").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("agree"))
    pe = F.coalesce("pe", F.lit(0.0))
    return seen.join(chance, "field", "left").select("field", "n", "agree", F.when(pe < 1, (F.col("agree") - pe) / (1 - pe)).alias("kappa"))


def numeric_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two coders' numbers (unit, field, value): units, exact share, mean difference, ICC for absolute agreement."""
    p = a.select("unit", "field", F.col("value").alias("x")).join(b.select("unit", "field", F.col("value").alias("y")), ["unit", "field"])
    s = p.groupBy("field").agg(
        F.count("*").alias("n"),
        F.avg((F.col("x") == F.col("y")).cast("double")).alias("exact"),
        F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"),
        F.var_pop((F.col("x") + F.col("y")) / 2).alias("vm"),
        F.var_pop(F.col("x") - F.col("y")).alias("vd"),
        F.avg(F.col("x") - F.col("y")).alias("md"),
    )
    n = F.col("n")
    msr, mse, msc = 2 * n * F.col("vm") / (n - 1), n * F.col("vd") / 2 / (n - 1), n * F.col("md") * F.col("md") / 2
    below = msr + mse + 2 * (msc - mse) / n
    return s.select("field", "n", "exact", "mean_abs_diff", F.when((n > 1) & (below != 0), (msr - mse) / below).alias("icc"))


def validation_sample(rows: DataFrame, k: int, seed: str, strata: str | None = None) -> DataFrame:
    """All rows of ``k`` documents (per stratum), drawn by a hash of seed and name: the same in every run. Each of a few
    hundred parts of the documents names its first ``k``, and the first of these are drawn, so no task sees them all."""
    by = [strata] if strata else []
    turn = F.md5(F.concat(F.lit(seed), F.lit("/"), F.col("source_pdf")).cast("binary"))
    documents = rows.select("source_pdf", *by).distinct().withColumn("turn", turn).withColumn("part", F.pmod(F.xxhash64("source_pdf"), F.lit(256)))
    first = lambda df, *part: df.withColumn("r", F.row_number().over(Window.partitionBy(*by, *part).orderBy("turn", "source_pdf"))).where(F.col("r") <= k)
    drawn = first(first(documents, "part"), F.lit(0))
    return rows.join(drawn.select("source_pdf", *by), ["source_pdf", *by], "left_semi")


def cost_estimate(attempts: DataFrame, n_docs: int, price_in: float, price_out: float, margin: float = 0.1) -> DataFrame:
    """Mean input and output tokens of the attempts that tell them, and the price (per million tokens of each) of coding
    ``n_docs`` documents with a retry margin, by kind and in all. Where no attempt tells a kind, its cost is null, and so is
    the sum."""
    mean = attempts.agg(F.avg("input_tokens").alias("mean_tokens"), F.avg("output_tokens").alias("mean_output"))
    share = n_docs / 1e6 * (1 + margin)
    mean = mean.withColumn("cost_in", F.col("mean_tokens") * (price_in * share)).withColumn("cost_out", F.col("mean_output") * (price_out * share))
    return mean.withColumn("cost", F.col("cost_in") + F.col("cost_out"))


def numbers(cells: DataFrame) -> DataFrame:
    """Cells (unit, field, code) whose code spells a number, as values."""
    return cells.select("unit", "field", number_of(F.col("code")).alias("value")).where("value is not null")


def eval_set_integrity(truth: DataFrame, rows: DataFrame, fields: list[str], reasons: tuple[str, ...] = ("not_reported", "not_applicable", "unclear"), levels: dict[str, tuple[str, ...]] | None = None, articles: DataFrame | None = None) -> DataFrame:
    """(row_id, field, problem): human codes given more than once, with both or neither of value and missing reason,
    with an unknown reason, with a value that is none of the field's ``levels``, for a field that isn't among ``fields``, or
    absent for a row (row_id) and one of them. With ``articles`` (source_pdf), the documents of ``rows`` must be these: the
    others are named in place of the row. Null counts as blank."""
    value, missing = (F.coalesce(F.col(c), F.lit("")) for c in ("value", "missing"))
    other = F.lit(False)
    for field, allowed in (levels or {}).items():
        other |= (F.col("field") == field) & (value != "") & ~value.isin(*allowed)
    codes = truth.groupBy("row_id", "field").agg(F.count("*").alias("n"), F.bool_or((value != "") == (missing != "")).alias("both"), F.bool_or(~missing.isin("", *reasons)).alias("unknown"), F.bool_or(other).alias("other"))
    problems = F.array_compact(F.array(F.when(F.col("n") > 1, "repeated"), F.when(F.col("both"), "value or missing"), F.when(F.col("unknown"), "missing reason"), F.when(F.col("other"), "no such level"), F.when(~F.col("field").isin(*fields), "no such field")))
    wrong = codes.select("row_id", "field", F.explode(problems).alias("problem"))
    due = rows.select("row_id").distinct().select("row_id", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    wrong = wrong.unionByName(due.join(codes, ["row_id", "field"], "left_anti").withColumn("problem", F.lit("absent")))
    if articles is not None:
        have, listed = (df.select(F.col("source_pdf").alias("row_id"), F.lit(None).cast("string").alias("field")).distinct() for df in (rows, articles))
        wrong = wrong.unionByName(have.join(listed, "row_id", "left_anti").select("row_id", "field", F.lit("no article").alias("problem")))
        wrong = wrong.unionByName(listed.join(have, "row_id", "left_anti").select("row_id", "field", F.lit("no rows").alias("problem")))
    return wrong


def ordinal_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(field, n, kappa_w, alpha) of two coders' ranks (unit, field, code): kappa with linear weights, and nominal
    alpha; null where all codes are equal. Units that one coder left out, and codes that are no numbers, don't count."""
    rank = lambda df, name: df.select("unit", "field", F.expr("try_cast(code AS double)").alias(name)).where(F.col(name).isNotNull())
    cells = rank(a, "x").join(rank(b, "y"), ["unit", "field"]).groupBy("field", "x", "y").agg(F.count("*").alias("m"))
    seen = cells.groupBy("field").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.abs(F.col("x") - F.col("y"))).alias("apart"), F.sum(F.when(F.col("x") != F.col("y"), F.col("m")).otherwise(0)).alias("differ"))
    xs, ys = (cells.groupBy("field", c).agg(F.sum("m").alias(f"m_{c}")) for c in ("x", "y"))
    by_chance = xs.join(ys, "field").groupBy("field").agg(F.sum(F.col("m_x") * F.col("m_y") * F.abs(F.col("x") - F.col("y"))).alias("chance"))
    codes = cells.select("field", "m", F.explode(F.array("x", "y")).alias("code")).groupBy("field", "code").agg(F.sum("m").alias("m"))
    equal = codes.groupBy("field").agg(F.sum(F.col("m") * F.col("m")).alias("equal"))
    unequal = F.nullif(4 * F.col("n") * F.col("n") - F.col("equal"), F.lit(0))
    kappa = 1 - F.col("apart") * F.col("n") / F.nullif(F.col("chance"), F.lit(0.0))
    return seen.join(by_chance, "field").join(equal, "field").select("field", "n", kappa.alias("kappa_w"), (1 - 2 * F.col("differ") * (2 * F.col("n") - 1) / unequal).alias("alpha"))


def krippendorff_alpha(codes: DataFrame) -> DataFrame:
    """(field, units, codes, alpha_nominal, alpha_ordinal) of any number of coders (unit, field, coder, code). Null codes,
    and units with a single code, don't count; alpha is null where all codes are equal. Codes are ordered as numbers; a
    field with a code that is none has no ordinal alpha.

    The distance of two ranks is that of their mean places among all codes of the field, so sums of places and of their
    squares, by unit and by field, stand for all pairs."""
    c = codes.where("code is not null").select("unit", "field", "code", F.col("code").try_cast("double").alias("rank"))
    c = c.groupBy("field", "unit", "code", "rank").agg(F.count("*").alias("n"))
    paired = c.groupBy("field", "unit").agg(F.sum("n").alias("m")).where("m > 1")
    c = c.join(paired, ["field", "unit"])
    marks = c.groupBy("field", "code", "rank").agg(F.sum("n").alias("all"))
    # a row per field and code: how many codes stand before it, and half of its own
    upto = F.sum("all").over(Window.partitionBy("field").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0))
    same = F.sum("all").over(Window.partitionBy("field", "rank"))
    marks = marks.withColumn("place", upto - same / 2)
    x = F.col("n").cast("double")
    units = c.join(marks.select("field", "code", "place"), ["field", "code"]).groupBy("field", "unit", "m").agg(F.sum(x * x).alias("nn"), F.sum(x * F.col("place")).alias("p"), F.sum(x * F.col("place") * F.col("place")).alias("pp"))
    m = F.col("m").cast("double")
    seen = units.groupBy("field").agg(F.count("*").alias("units"), F.sum((m * m - F.col("nn")) / (m - 1)).alias("o_nominal"), F.sum(2 * (m * F.col("pp") - F.col("p") * F.col("p")) / (m - 1)).alias("o_ordinal"))
    y = F.col("all").cast("double")
    chance = marks.groupBy("field").agg(F.sum("all").alias("codes"), F.sum(y * y).alias("yy"), F.sum(y * F.col("place")).alias("q"), F.sum(y * F.col("place") * F.col("place")).alias("qq"), F.bool_or(F.col("rank").isNull()).alias("odd"))
    n = F.col("codes").cast("double")
    alpha = lambda seen, chance: 1 - (n - 1) * F.col(seen) / F.nullif(chance, F.lit(0.0))
    nominal = alpha("o_nominal", n * n - F.col("yy"))
    ordinal = F.when(~F.col("odd"), alpha("o_ordinal", 2 * (n * F.col("qq") - F.col("q") * F.col("q"))))
    return seen.join(chance, "field").select("field", "units", "codes", nominal.alias("alpha_nominal"), ordinal.alias("alpha_ordinal"))
