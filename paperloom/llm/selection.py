"""Dropping rows of documents without moving the others.

A row is known by a 64-bit hash of what decides over it, not by its doc_id, which may be null or repeated: equal rows
share a decision, others don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans.staging import stage

#: Keys that may be broadcast; beyond it both sides are shuffled.
BROADCAST_IDS = 2_000_000


def row_key(*columns: str) -> Column:
    """The hash of the columns, nulls told from blanks."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c))))


def without_keys(docs: DataFrame, key: Column, keys: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` whose ``key`` is not in the first column of ``keys``. These are counted first: few are sent to where the
    documents lie, so no text is shuffled."""
    keys = stage(keys.toDF("_row_key").distinct(), "keys")
    side = F.broadcast(keys) if keys.count() <= limit else keys
    return docs.withColumn("_row_key", key).join(side, "_row_key", "left_anti").select(docs.columns)


def one_row_each(docs: DataFrame, key: Column, repeated: DataFrame) -> DataFrame:
    """``docs`` with one row, the smallest, for each of the keys in the first column of ``repeated``. Only these rows are
    shuffled with their texts, the copies of a task as one."""
    keys = stage(repeated.toDF("_row_key").distinct(), "repeated")
    n = keys.count()
    if not n:
        return docs
    side = F.broadcast(keys) if n <= BROADCAST_IDS else keys
    keyed = docs.withColumn("_row_key", key)
    first = keyed.join(side, "_row_key", "left_semi").groupBy("_row_key").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return keyed.join(side, "_row_key", "left_anti").select(docs.columns).unionByName(first)
