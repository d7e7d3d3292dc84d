"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of 2^60 places; a document goes clockwise from its own place (a hash of
its doc_id) to the next point. A shard holds at most its quota of rows, the quotas being at most one apart and summing
up to all rows; an overfull shard keeps a quota's worth, spread over its points in proportion, and the documents that
overflow go on clockwise to the next point with room. Own documents come first, so only overflow moves.

The counts live in a table of one row per point (shards x vnodes rows, whatever the input). Overflowing documents walk in
the order of their places from 0 on, each to the next point that still has room; those that find none up to the ring's
end take what the first walk has left, from 0 on again. Which room is taken in the first walk follows from the running
surplus and its running minimum, so the walk is a few prefix sums. Documents are ranked within their arc by place, in
chunks cut by place, and find their shard by an equi-join with that plan: the result is the walk's at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.plans.staging import stage

VNODES = 128
#: Rows of an arc that are ranked together, about.
ARC_ROWS = 4096
#: The ring is cut into cells, so that a place finds its arc by an equi-join on the cell.
CELLS_LOG2 = 14
_RING_LOG2 = 60


def ring_place(key: Column) -> Column:
    """The first 60 bits of md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> DataFrame:
    """The points: (arc, shard, place), arc being the number in ring order."""
    points = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("v"))
    points = points.withColumn("place", ring_place(F.concat_ws("/", F.lit("shard"), "shard", "v")))
    return points.withColumn("arc", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("place", "shard")) - 1).select("arc", "shard", "place")


def arc_cells(points: DataFrame) -> DataFrame:
    """(cell, low, high, cell_arc): places above low up to high belong to the arc. The first arc also owns the places
    behind the last point."""
    order = Window.partitionBy(F.lit(1)).orderBy("arc")
    spans = points.select("arc", F.coalesce(F.lag("place").over(order), F.lit(-1)).alias("low"), F.col("place").alias("high"))
    tail = points.agg(F.max("place").alias("low")).select(F.lit(0).alias("arc"), "low", F.lit((1 << _RING_LOG2) - 1).alias("high"))
    cell = lambda c: F.shiftright(c, _RING_LOG2 - CELLS_LOG2)
    return spans.unionByName(tail).where("high > low").select(F.explode(F.sequence(cell(F.col("low") + 1), cell(F.col("high")))).alias("cell"), "low", "high", F.col("arc").alias("cell_arc"))


def plan_loads(points: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """From the rows of each arc (arc, load), where they go: (arc, from_rank, to_rank, shard, first_slot); ranks from
    from_rank up to before to_rank of the arc take the shard's slots from first_slot on."""
    p = points.join(loads, "arc", "left").withColumn("load", F.coalesce("load", F.lit(0)).cast("long"))
    own, every = Window.partitionBy("shard"), Window.partitionBy(F.lit(1))
    rows = F.sum("load").over(every)
    p = p.withColumn("quota", F.floor(rows / shards) + F.when(F.col("shard") < rows % shards, 1).otherwise(0))
    p = p.withColumn("total", F.sum("load").over(own)).withColumn("upto", F.sum("load").over(own.orderBy("arc").rowsBetween(Window.unboundedPreceding, 0)))
    # an overfull shard keeps its quota in proportion to the arcs' loads; others have room, also in proportion
    part = F.row_number().over(own.orderBy("arc")) / F.count("*").over(own)
    goal = F.when(F.col("total") > F.col("quota"), F.floor(F.col("quota") * (F.col("upto") / F.col("total")))).otherwise(F.col("upto") + F.floor((F.col("quota") - F.col("total")) * part))
    p = p.withColumn("goal", goal)
    p = p.withColumn("capacity", F.col("goal") - F.coalesce(F.lag("goal").over(own.orderBy("arc")), F.lit(0)))
    p = p.withColumn("slot0", F.col("goal") - F.col("capacity"))
    p = p.withColumn("over", F.greatest(F.col("load") - F.col("capacity"), F.lit(0))).withColumn("room", F.greatest(F.col("capacity") - F.col("load"), F.lit(0)))
    in_order = every.orderBy("arc").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("surplus", F.sum(F.col("over") - F.col("room")).over(in_order)).withColumn("over_to", F.sum("over").over(in_order))
    # where the surplus reaches a new minimum below 0 nobody waits, and that much room stays free in the first walk
    p = p.withColumn("least", F.least(F.lit(0), F.min("surplus").over(in_order)))
    p = p.withColumn("free", F.coalesce(F.lag("least").over(every.orderBy("arc")), F.lit(0)) - F.col("least"))
    p = stage(p.select("arc", "shard", "load", "over", "room", "free", "capacity", "slot0", "over_to"), "ring")
    walks = [F.struct(F.lit(1).alias("walk"), (F.col("room") - F.col("free")).alias("room"), (F.col("slot0") + F.col("load")).alias("filled")), F.struct(F.lit(2).alias("walk"), F.col("free").alias("room"), (F.col("slot0") + F.col("load") + F.col("room") - F.col("free")).alias("filled"))]
    rooms = p.select("arc", "shard", F.explode(F.array(*walks)).alias("w")).select("arc", "shard", "w.*").where("room > 0")
    rooms = rooms.withColumn("room_to", F.sum("room").over(every.orderBy("walk", "arc").rowsBetween(Window.unboundedPreceding, 0)))
    stay = p.select("arc", F.lit(0).cast("long").alias("from_rank"), F.least("load", "capacity").alias("to_rank"), "shard", F.col("slot0").alias("first_slot")).where("to_rank > 0")
    # cut the row of overflowing documents where an arc or a room ends; each piece has one arc and one room
    cuts = p.where("over > 0").select(F.col("over_to").alias("cut")).union(rooms.select("room_to")).distinct()
    # the cut lies in the arc, and in the room, that ends there or next
    marks = cuts.select("cut", F.lit(None).cast("long").alias("arc"), F.lit(None).cast("long").alias("over"), F.lit(None).cast("long").alias("keep"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("room"), F.lit(None).cast("long").alias("filled"))
    marks = marks.unionByName(p.where("over > 0").select(F.col("over_to").alias("cut"), "arc", "over", F.least("load", "capacity").alias("keep")), allowMissingColumns=True)
    marks = marks.unionByName(rooms.select(F.col("room_to").alias("cut"), "shard", "room", "filled"), allowMissingColumns=True)
    m = marks.groupBy("cut").agg(
        F.max(F.when(F.col("arc").isNotNull(), F.struct("arc", "over", "keep", "cut"))).alias("a"),
        F.max(F.when(F.col("shard").isNotNull(), F.struct("shard", "room", "filled", "cut"))).alias("r"),
    )
    ahead = every.orderBy("cut").rowsBetween(0, Window.unboundedFollowing)
    m = m.select("cut", F.coalesce(F.lag("cut").over(every.orderBy("cut")), F.lit(0)).alias("since"), F.first("a", ignorenulls=True).over(ahead).alias("a"), F.first("r", ignorenulls=True).over(ahead).alias("r"))
    rank = F.col("a.keep") + F.col("since") - (F.col("a.cut") - F.col("a.over"))
    moved = m.select(F.col("a.arc").alias("arc"), rank.alias("from_rank"), (rank + F.col("cut") - F.col("since")).alias("to_rank"), F.col("r.shard").alias("shard"), (F.col("r.filled") + F.col("since") - (F.col("r.cut") - F.col("r.room"))).alias("first_slot"))
    return stay.unionByName(moved.where("to_rank > from_rank"))


def assign_shards(docs: DataFrame, key: str, shards: int, vnodes: int = VNODES, order_by: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with shard (0 to shards-1) and slot (0, 1, ... in each shard), which replace columns of these names.
    The rows of ``docs`` are shuffled once, so give it narrow ones where that is enough.

    Defined cases: rows with the same key are placed one by one (told apart by ``order_by``), and equal rows are
    interchangeable; a null key stands where its ``order_by`` columns do, so rows without key spread over the ring; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    points = stage(ring(spark, shards, vnodes), "points")
    cells = arc_cells(points)
    # an arc's rows are ranked in chunks of about ARC_ROWS; chunks are cut by place, so ranks are the same however many there are
    chunks = max(1, docs.count() // (shards * vnodes * ARC_ROWS))
    told = [F.col(c) for c in (key, *order_by)]
    place = ring_place(F.coalesce(F.col(key).cast("string"), F.concat_ws("/", F.lit(""), *(c.cast("string") for c in told[1:]))))
    within = F.shiftright(F.col("_place") - F.col("low") - 1, 20) / (F.shiftright(F.col("high") - F.col("low"), 20) + 1)
    # the places behind the last point come after those before the first
    behind = (F.col("cell_arc") == 0) & (F.col("low") >= 0)
    chunk = (F.floor(within * chunks) + F.when(behind, chunks).otherwise(0)).alias("_chunk")

    def on_ring(columns: list[str]) -> DataFrame:
        # the columns travel as one, so their names can't clash with the plan's
        df = docs.select(F.struct(*columns).alias("_row"), place.alias("_place"))
        df = df.withColumn("_cell", F.shiftright("_place", _RING_LOG2 - CELLS_LOG2))
        # bounded: 2^CELLS_LOG2 + shards * vnodes short rows
        return df.join(F.broadcast(cells), (F.col("_cell") == F.col("cell")) & (F.col("_place") > F.col("low")) & (F.col("_place") <= F.col("high"))).select("_row", "_place", "cell_arc", chunk)

    loads = stage(on_ring([key]).groupBy(F.col("cell_arc").alias("arc"), F.col("_chunk").alias("chunk")).agg(F.count("*").alias("load")), "loads")
    plan = plan_loads(points, loads.groupBy("arc").agg(F.sum("load").alias("load")), shards).withColumnRenamed("arc", "plan_arc")
    before = F.coalesce(F.sum("load").over(Window.partitionBy("arc").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = [F.col("_row").getField(c) for c in (key, *order_by)]
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    ranked = on_ring(kept).withColumn("_rank", F.row_number().over(Window.partitionBy("cell_arc", "_chunk").orderBy("_place", *order)) - 1)
    since = loads.select(F.col("arc").alias("b_arc"), F.col("chunk").alias("b_chunk"), before.alias("b_rows"))
    ranked = ranked.join(since, (F.col("cell_arc") == F.col("b_arc")) & (F.col("_chunk") == F.col("b_chunk"))).withColumn("_rank", F.col("_rank") + F.col("b_rows"))
    # bounded: at most 4 * shards * vnodes short rows
    out = ranked.join(F.broadcast(plan), (F.col("cell_arc") == F.col("plan_arc")) & (F.col("_rank") >= F.col("from_rank")) & (F.col("_rank") < F.col("to_rank")))
    return out.select(*(F.col("_row").getField(c).alias(c) for c in kept), "shard", (F.col("first_slot") + F.col("_rank") - F.col("from_rank")).alias("slot"))
