"""The log of exchanges with providers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.plans.staging import discard, stage


def blob_dedupe(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs, references) of payloads (operation_id, sequence, content): each content once, by its digest."""
    p = payloads.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    blobs = p.groupBy("sha256").agg(F.first(F.octet_length("content")).cast("long").alias("bytes"), F.count("*").alias("uses"))
    return blobs, p.select("operation_id", "sequence", "sha256")


def append_blobs(payloads: DataFrame, store: str) -> DataFrame:
    """Payloads (operation_id, sequence, content) into a store of contents below ``store`` (sha256, bytes, content, in folders by
    the digest's first byte); gives the references (operation_id, sequence, sha256). A content that the store has, or that
    comes twice, is kept once.

    First only digests are compared, 64 characters a payload; then those payloads are read again whose digest is new. An
    append that failed halfway leaves nothing, and may be repeated. One writer at a time."""
    spark = payloads.sparkSession
    p = payloads.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    references = stage(p.select("operation_id", "sequence", "sha256"), "references")
    try:
        known = spark.read.parquet(store).select("sha256")
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], "sha256 string")
    new = stage(references.where("sha256 is not null").select("sha256").distinct().join(known, "sha256", "left_anti"), "new")
    fresh = p.join(new, "sha256", "left_semi").groupBy("sha256").agg(F.first(F.col("content").cast("binary")).alias("content"))
    out = fresh.select("sha256", F.octet_length("content").cast("long").alias("bytes"), "content", F.substring("sha256", 1, 2).alias("folder"))
    out.write.mode("append").partitionBy("folder").parquet(store)
    discard(new)
    return references


def read_blobs(spark: SparkSession, store: str, references: DataFrame) -> DataFrame:
    """References with their content; one without content in the store has none."""
    return references.join(spark.read.parquet(store).select("sha256", "bytes", "content"), "sha256", "left")


def verify_checksums(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(name, problem): files that are absent, unexpected, or differ from their digest."""
    e, f = expected.select("name", F.col("sha256").alias("want")), files.select("name", F.col("sha256").alias("have"))
    problem = F.when(F.col("have").isNull(), "absent").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "differs")
    return e.join(f, "name", "full").withColumn("problem", problem).where("problem is not null").select("name", "problem")


def operation_rollup(operations: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Per operation: exchanges, duration in seconds with fractions, whether it was interrupted, and its final status: that
    which it was finished with; interrupted where it never was; ``finished`` where none is told."""
    n = exchanges.groupBy("operation_id").agg(F.count("*").alias("exchanges"))
    out = operations.join(n, "operation_id", "left")
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    told = F.nullif(F.trim("status"), F.lit("")) if "status" in operations.columns else F.lit(None).cast("string")
    open_ = F.col("finished_at").isNull()
    return out.select("operation_id", F.coalesce("exchanges", F.lit(0)).alias("exchanges"), seconds.alias("seconds"), open_.alias("interrupted"), F.when(open_, "interrupted").otherwise(F.coalesce(told, F.lit("finished"))).alias("final_status"))


#: The HTTP states after which each provider may be asked again, and who says how long to wait.
RETRYABLE = {"gemini": (429, 500, 502, 503, 504), "openai_compatible": (408, 409, 429, 500, 502, 503, 504), "openrouter": (408, 409, 429, 500, 502, 503, 504)}
WAITS_AS_ASKED = ("gemini",)


def asked_to_wait(header: Column, now: Column) -> Column:
    """The seconds that a Retry-After header asks for: whole seconds, or until an HTTP date (0 if that is past; without a
    zone it is GMT); null for anything else."""
    text = F.trim(F.coalesce(header, F.lit("")))
    date = F.regexp_extract(text, r"^(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})(?: (?:GMT|UTC|UT|[+-]\d{4}))?$", 1)
    zone = F.coalesce(F.nullif(F.regexp_extract(text, r"([+-]\d{4})$", 1), F.lit("")), F.lit("+0000"))
    until = F.unix_micros(F.try_to_timestamp(F.concat(date, F.lit(" "), zone), F.lit("d MMM yyyy HH:mm:ss xx"))) - F.unix_micros(now)
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("double")).when((date != "") & until.isNotNull(), F.greatest(until / 1e6, F.lit(0.0)))


def retry_classification(exchanges: DataFrame, attempts: int = 3, longest: float = 30.0) -> DataFrame:
    """Per exchange (operation_id, sequence, http_status, retry_after, and perhaps provider and at, when it came): may it
    be retried, after how many seconds (2 * 2^n, or as long as was asked for), or is it given up? Without provider it is
    judged by the first one's states; without ``at``, dates count from now."""
    n = F.row_number().over(Window.partitionBy("operation_id").orderBy("sequence"))
    provider = F.coalesce("provider", F.lit("gemini")) if "provider" in exchanges.columns else F.lit("gemini")
    now = F.col("at") if "at" in exchanges.columns else F.current_timestamp()
    e = exchanges.withColumn("n", n)
    ok = F.lit(False)
    for name, states in RETRYABLE.items():
        ok |= (provider == name) & F.coalesce(F.col("http_status").isin(*states), F.lit(False))
    asked = F.when(provider.isin(*WAITS_AS_ASKED), F.coalesce(asked_to_wait(F.col("retry_after"), now), F.lit(0.0))).otherwise(0.0)
    give_up = ok & ((asked > longest) | (F.col("n") >= attempts))
    delay = F.when(ok & ~give_up, F.greatest(F.lit(2.0) * F.pow(F.lit(2.0), F.col("n") - 1), asked))
    return e.select("operation_id", "sequence", ok.alias("retryable"), delay.alias("delay"), give_up.alias("give_up"))
