"""Codebooks: what is wrong with one, and the form in which it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of every export, and the types of fields.
RESERVED = ("row_id", "source_pdf", "locator", "authors", "year", "status")
TYPES = ("string", "number", "integer", "boolean")


#: What a field with a reserved name may be called instead; others get ``study_`` before their name.
RENAMED = {"year": "publication_year", "status": "publication_status"}


def _texts(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def complete(fields: DataFrame) -> DataFrame:
    """``fields`` (codebook_id, ordinal, field, type, levels) with what else a field may have: description,
    evidence_required (true unless said), and level_descriptions, in the order of the levels."""
    more = {"description": F.lit(None).cast("string"), "evidence_required": F.lit(True), "level_descriptions": F.lit(None).cast("array<string>")}
    return fields.withColumns({c: v for c, v in more.items() if c not in fields.columns}).withColumn("evidence_required", F.coalesce(F.col("evidence_required"), F.lit(True)))


def _flag(df: DataFrame, c: str) -> Column:
    """Whether a flag that came as text is none."""
    text = c in df.columns and dict(df.dtypes)[c] == "string"
    return ~F.lower(F.trim(c)).isin("true", "false") if text else F.lit(False)


def codebook_lint(codebooks: DataFrame, fields: DataFrame) -> DataFrame:
    """(codebook_id, field, rule) for each broken rule. ``fields`` has codebook_id, ordinal, field, type, levels
    (array of texts), perhaps evidence_required; a reserved name comes with one to use instead."""
    other = F.coalesce(F.create_map(*(F.lit(x) for pair in RENAMED.items() for x in pair))[F.col("key")], F.concat(F.lit("study_"), F.col("key")))
    f = fields.withColumn("name", F.trim(F.coalesce("field", F.lit("")))).withColumn("key", F.lower("name")).withColumn("kind", F.lower(F.trim(F.coalesce("type", F.lit("string")))))
    twice = f.where("key <> ''").groupBy("codebook_id", "key").agg(F.min("ordinal").alias("first_use"))
    f = f.join(twice, ["codebook_id", "key"], "left")
    levels = F.coalesce("levels", F.array().cast("array<string>"))
    bare = F.transform(levels, lambda x: F.trim(F.coalesce(x, F.lit(""))))
    rules = F.array_compact(
        F.array(
            F.when(F.col("name") == "", "blank name"),
            F.when(F.col("key").isin(*RESERVED), F.concat(F.lit("reserved name, use "), other)),
            F.when((F.col("key") == "notes") & (F.col("name") != "notes"), "clashes with notes"),
            F.when(F.col("first_use") < F.col("ordinal"), "duplicate name"),
            F.when(~F.col("kind").isin(*TYPES), "unknown type"),
            F.when((F.size(levels) > 0) & (F.col("kind") != "string"), "levels on non-string"),
            F.when(F.exists(bare, lambda x: x == ""), "blank level"),
            F.when(F.size(F.array_distinct(bare)) < F.size(bare), "duplicate level"),
            F.when(_flag(fields, "evidence_required"), "flag is not boolean"),
        )
    )
    found = f.select("codebook_id", F.col("name").alias("field"), F.explode(rules).alias("rule"))
    heads = codebooks.where(F.trim(F.coalesce("effect_definition", F.lit(""))) == "").select("codebook_id", F.lit("").alias("field"), F.lit("no effect definition").alias("rule"))
    empty = codebooks.join(fields, "codebook_id", "left_anti").select("codebook_id", F.lit("").alias("field"), F.lit("no fields").alias("rule"))
    flags = codebooks.where(_flag(codebooks, "confidence")).select("codebook_id", F.lit("").alias("field"), F.lit("flag is not boolean").alias("rule"))
    return found.unionByName(heads).unionByName(empty).unionByName(flags)


def codebook_effective(fields: DataFrame) -> DataFrame:
    """The fields in use, complete: the built-in notes, without levels or evidence, stand last, in place of any of that
    name."""
    own = complete(fields).where("field <> 'notes'")
    last = fields.groupBy("codebook_id").agg(F.max("ordinal").alias("m"))
    notes = last.select("codebook_id", (F.col("m") + 1).alias("ordinal"), F.lit("notes").alias("field"), F.lit("string").alias("type"), F.lit(False).alias("evidence_required"))
    columns = ("codebook_id", "ordinal", "field", "type", "levels", "description", "evidence_required", "level_descriptions")
    return own.select(*columns).unionByName(notes, allowMissingColumns=True)


def codebook_type_coercion(fields: DataFrame) -> DataFrame:
    """A field with levels is a string, whatever it was drafted as."""
    return fields.withColumn("type", F.when(F.size(F.coalesce("levels", F.array().cast("array<string>"))) > 0, "string").otherwise(F.col("type")))


def _levels() -> Column:
    """Levels with their descriptions, as (value, description)."""
    said = F.col("level_descriptions")
    return F.transform(_texts("levels"), lambda x, i: F.struct(F.trim(x).alias("value"), F.nullif(F.trim(F.get(said, i)), F.lit("")).alias("description")))


def codebook_canonical_hash(codebooks: DataFrame, fields: DataFrame) -> DataFrame:
    """(codebook_id, hash) over all content of a codebook (codebook_id, effect_definition, and perhaps name, description,
    confidence) and its fields, in their order. Outer blanks and the case of types don't count, nor what is left out as
    against blank or false."""
    text = lambda c, df=codebooks: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in df.columns else F.lit("")
    f = complete(fields)
    one = F.struct(F.trim("field").alias("field"), F.lower(F.trim("type")).alias("type"), text("description", f).alias("description"), F.col("evidence_required"), _levels().alias("levels"))
    grouped = f.groupBy("codebook_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", one.alias("f")))).alias("fs"))
    out = codebooks.join(grouped, "codebook_id", "left")
    sure = F.coalesce(F.col("confidence").cast("boolean"), F.lit(False)) if "confidence" in codebooks.columns else F.lit(False)
    listed = F.transform("fs", lambda x: x["f"])
    whole = F.struct(text("name").alias("name"), text("description").alias("description"), text("effect_definition").alias("effect_definition"), sure.alias("confidence"), listed.alias("fields"))
    return out.select("codebook_id", F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256).alias("hash"))


def _inner(text: Column, indent: str) -> Column:
    """A trimmed text whose further lines are indented."""
    return F.replace(F.btrim(text, F.lit(" \t\n\r")), F.lit("\n"), F.lit("\n" + indent))


def render_codebook(fields: DataFrame) -> DataFrame:
    """(codebook_id, text): each field as an item of a list with its kind, description and levels, in order."""
    line = F.concat(
        F.lit("- `"), F.col("field"), F.lit("` ("), F.when(F.size(_texts("levels")) > 0, "categorical").otherwise(F.col("type")), F.lit(")"),
        F.coalesce(F.concat(F.lit("\n  Description: "), _inner(F.nullif(F.trim("description"), F.lit("")), "    ")), F.lit("")),
        F.when(F.size(_texts("levels")) > 0, "\n  Levels:").otherwise(""),
        F.array_join(F.transform(_levels(), lambda x: F.concat(F.lit("\n  - `"), x["value"], F.lit("`"), F.coalesce(F.concat(F.lit(": "), _inner(x["description"], "      ")), F.lit("")))), ""),
    )
    lines = F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line"))))
    return complete(fields).groupBy("codebook_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
