"""Names of uploaded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.plans.staging import discard, stage


def _parts(name: Column) -> tuple[Column, Column]:
    """A file name's stem, and its suffix with the dot."""
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix)), suffix


def _numbered(stem: Column, suffix: Column, n: Column) -> Column:
    return F.when(n == 1, F.concat(stem, suffix)).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), suffix))


def _proposed(waiting: DataFrame, taken: DataFrame) -> DataFrame:
    """The name that each upload gets if only those of the same name came before it: the r-th of these takes the r-th
    number that no name in ``taken`` has. A taken number k_i, the i-th of its stem, is passed by those with r > k_i - i."""
    stem, suffix = _parts(F.col("wanted"))
    w = waiting.withColumns({"stem": stem, "suffix": suffix, "r": F.row_number().over(Window.partitionBy("wanted").orderBy("arrival"))})
    stem, suffix = _parts(F.col("name"))
    names = taken.select(stem.alias("stem"), suffix.alias("suffix"))
    number = F.regexp_extract("stem", r" \(([2-9]|[1-9][0-9]{1,8})\)$", 1)
    numbered = names.where(number != "").select(F.regexp_replace("stem", r" \([0-9]+\)$", "").alias("stem"), "suffix", number.cast("long").alias("k"))
    k = numbered.unionByName(names.withColumn("k", F.lit(1).cast("long"))).join(w.select("stem", "suffix").distinct(), ["stem", "suffix"], "left_semi").distinct()
    i = F.row_number().over(Window.partitionBy("stem", "suffix").orderBy("k"))
    both = w.select("stem", "suffix", "wanted", "arrival", F.col("r").cast("long").alias("at"), F.lit(0).alias("hole")).unionByName(k.select("stem", "suffix", (F.col("k") - i).alias("at"), F.lit(1).alias("hole")), allowMissingColumns=True)
    # holes before the upload: those with a smaller ``at``
    passed = F.sum("hole").over(Window.partitionBy("stem", "suffix").orderBy("at", "hole").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("n", F.col("at") + passed).where("hole = 0")
    return both.select("arrival", "wanted", _numbered(F.col("stem"), F.col("suffix"), F.col("n")).alias("name"))


def unique_document_name(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """(arrival, wanted, name) for uploads (arrival, wanted) in the order of arrival, beside the ``existing`` (name): a name
    that is taken gets `` (2)``, `` (3)``, ... before its suffix, the first that is free.

    Uploads of one name are numbered together. Where two of different names want the same (one is called ``a (2).pdf``),
    all that came before the later one are settled, and the rest are numbered again: a round for each such clash. Names
    are of one length at least; arrivals differ."""
    waiting = stage(uploads.select("arrival", "wanted"), "uploads")
    taken, done = stage(existing.select("name").where("name is not null").distinct(), "taken"), None
    while not waiting.isEmpty():
        proposed = stage(_proposed(waiting, taken), "proposed")
        twice = proposed.groupBy("name").agg(F.min("arrival").alias("first")).join(proposed, "name").where("arrival > first")
        clash = twice.agg(F.min("arrival")).first()[0]
        settled = stage(proposed if clash is None else proposed.where(F.col("arrival") < clash), "settled")
        done = settled if done is None else done.unionByName(settled)
        left = stage(waiting.join(settled.select("arrival"), "arrival", "left_anti"), "uploads")
        more = stage(taken.unionByName(settled.select("name")), "taken")
        discard(proposed, waiting, taken)
        waiting, taken = left, more
    return done if done is not None else waiting.withColumn("name", F.col("wanted"))
