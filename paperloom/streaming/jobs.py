"""Structured Streaming jobs: stored tables of one current row per key, fed by streams.

A table is a log of batches, ``batch=<id>`` each, reduced to one row per key before it is written. A batch that is replayed
after a failure overwrites its own folder, so it changes nothing; late rows lose against later ones when the table is
read, as the order is in the rows. Batches are numbered by the stream's checkpoint, so one table has one stream and one checkpoint. ``compact`` merges the log into a base, so that reading does not grow with its age.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from paperloom.operators.linkage import document_signal
from paperloom.operators.results import latest_attempt, selected_result

Reduce = Callable[[DataFrame], DataFrame]


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the finished folders below a table, by kind."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"batch": [], "base": []}
    for status in fs.listStatus(at) if fs.exists(at) else []:
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and number.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    return found


def read_table(spark: SparkSession, path: str, reduce: Reduce, schema: str | None = None) -> DataFrame:
    """The table's current rows: the newest base and the batches after it, reduced."""
    found = _folders(spark, path)
    base = max(found["base"], default=-1)
    parts = [f"{path}/base={base}"] * (base >= 0) + [f"{path}/batch={n}" for n in sorted(found["batch"]) if n > base]
    if not parts:
        if schema is None:
            raise ValueError(f"no table at {path}")
        return spark.createDataFrame([], schema)
    return reduce(functools.reduce(DataFrame.unionByName, map(spark.read.parquet, parts)))


def compact(spark: SparkSession, path: str, reduce: Reduce) -> None:
    """Merges all finished batches into a new base, then deletes what it replaces. A compaction that fails leaves the table as
    it was; run it while no batch is being written."""
    found = _folders(spark, path)
    last, base = max(found["batch"], default=-1), max(found["base"], default=-1)
    if last <= base:
        return
    read_table(spark, path, reduce).write.mode("overwrite").parquet(f"{path}/base={last}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, numbers in found.items():
        for n in numbers:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}"), True)


def upsert(reduce: Reduce, path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch's rows, reduced, as the table's folder of that batch."""

    def write(batch: DataFrame, number: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _run(rows: DataFrame, reduce: Reduce, path: str, checkpoint: str, name: str | None) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(upsert(reduce, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def last_signal(signals: DataFrame) -> DataFrame:
    """One signal per name, that of the last arrival; of equal arrivals that of the greater content."""
    rest = [c for c in signals.columns if c != "name"]
    return signals.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct(*(["arrived"] if "arrived" in rest else []), F.to_json(F.struct("tokens", "year")))).alias("r")).select("name", "r.*")


def stream_signals(documents: DataFrame, table_path: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Scans arriving documents (name, text, and if given ``arrived``, by which the last version of a name is told) and keeps
    one signal per name: read it by ``read_table(spark, table_path, last_signal)``. Of a name that comes twice in a batch
    only the last is scanned; the stored tables, not the query's state, remember names, so state does not grow."""
    by = ["arrived"] if "arrived" in documents.columns else []

    def scanned(batch: DataFrame) -> DataFrame:
        if "arrived" not in batch.columns:
            return last_signal(document_signal(batch))
        last = batch.groupBy("name").agg(F.max_by(F.struct("text", "arrived"), F.struct("arrived", "text")).alias("r")).select("name", "r.text", "r.arrived")
        return document_signal(last.select("name", "text")).join(last.select("name", "arrived"), "name")

    return _run(documents.select("name", "text", *by), scanned, table_path, checkpoint, name)


def standing(attempts: DataFrame) -> DataFrame:
    """The attempts that may still matter: for each document the result that stands and the last attempt."""
    chosen = selected_result(attempts).unionByName(latest_attempt(attempts))
    return chosen.dropDuplicates(["source_pdf", "attempt_ts", "attempt", "status"])


def stream_results(attempts: DataFrame, table_path: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Keeps, as attempts arrive, those that matter: at most two rows a document. ``selected_result`` and ``latest_attempt`` of
    ``read_table(spark, table_path, standing)`` equal those of all attempts."""
    return _run(attempts, standing, table_path, checkpoint, name)


class ScanProgress(StreamingQueryListener):
    """How far a named query is: register it with ``spark.streams.addListener``. ``total`` counts what is read and what the
    source says is waiting."""

    def __init__(self, name: str):
        self.name, self._lock = name, threading.Lock()
        self._state = {"status": "idle", "processed": 0, "waiting": 0}
        self._run: str | None = None

    def snapshot(self) -> dict[str, int | str]:
        with self._lock:
            state = self._state
            return {"status": state["status"], "processed": state["processed"], "total": state["processed"] + state["waiting"]}

    def onQueryStarted(self, event) -> None:  # noqa: N802, ANN001
        if event.name == self.name:
            with self._lock:
                self._run = str(event.runId)
                self._state["status"] = "running"

    def onQueryProgress(self, event) -> None:  # noqa: N802, ANN001
        if event.progress.name == self.name:
            waiting = sum(int(float(s.metrics.get("numFilesOutstanding", 0))) for s in event.progress.sources if s.metrics)
            with self._lock:
                self._state["processed"] += event.progress.numInputRows
                self._state["waiting"] = waiting

    def onQueryIdle(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802, ANN001
        with self._lock:
            if str(event.runId) == self._run:
                self._state |= {"status": "complete" if event.exception is None else "failed", "waiting": 0}


def stream_selected_result(attempts: DataFrame) -> DataFrame:
    """The result that stands and the last attempt, per document, as attempts arrive. State is one row a document;
    write it in update or complete mode."""
    order = F.struct("attempt_ts", "attempt")
    return attempts.groupBy("source_pdf").agg(
        F.max_by("attempt", F.struct((F.col("status") == "ok").alias("ok"), "attempt_ts", "attempt")).alias("attempt"),
        F.max_by("status", F.struct((F.col("status") == "ok").alias("ok"), "attempt_ts", "attempt")).alias("status"),
        F.max_by("status", order).alias("latest_status"),
    )
