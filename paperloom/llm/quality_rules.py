"""Quality rules with a host-level verdict.

Every document is measured over its whole text by built-in functions, and fails if one of its rules fails: the base rules
(too few words, too many words in repeated windows), and rules on symbols per word, mean word length and repeated lines.
Failures are counted by host and rule (partial sums before the shuffle). For each rule a beta prior is fitted to the
hosts' rates by their moments, and each host's rate is shrunk towards it: hosts with few documents stay near the mean, so
a host is rejected only on enough evidence. A host fails a rule whose shrunk rate is far above what is usual (``HOST_ODDS``
times the odds over all documents) and not small (``HOST_LEAST``). The verdict is joined back, and a document is kept if
neither it nor its host fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans.staging import stage

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Document rules beside the base rules: symbols per 100 words, characters per word, repeated among the lines that aren't blank.
MAX_SYMBOL_PERCENT = 10
MEAN_WORD_CHARS = (3, 10)
MAX_DUP_LINE_PERCENT = 50
RULES = ("base_failed", "symbols_failed", "length_failed", "lines_failed")
#: A host fails a rule if the odds of its shrunk rate are above this many times the odds over all documents, and the rate
#: is above the least.
HOST_ODDS, HOST_LEAST = 3.0, 0.2
#: A prior as strong as this many documents, where the hosts' rates differ too little to tell.
MAX_STRENGTH = 1000.0


def words(text: Column) -> Column:
    """Runs of characters other than space and \\t\\n\\v\\f\\r."""
    # a split at one plain character needs no regular expression
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def _paired(hashes: Column, apart: int) -> Column:
    """From the hashes of windows, those of windows twice as long: each with the one ``apart`` further on."""
    behind = F.slice(hashes, apart + 1, F.greatest(F.size(hashes) - apart, F.lit(0)))
    return F.zip_with(hashes, behind, lambda a, b: F.xxhash64(a, b))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, host) to their measures: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "host", text.alias("text"))
    d = d.withColumn("w", words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > WINDOW, F.transform("w", lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # windows of 1, 2, 4 and 8 words, by doubling; the last 7 places have no whole window
    for apart in (1, 2, 4):
        d = d.withColumn("h", _paired(F.col("h"), apart))
    d = d.withColumn("h", F.slice("h", 1, F.greatest(F.size("h") - WINDOW + 1, F.lit(0))))
    # Few texts repeat a window: only theirs are sorted. The sorted places of repeated windows are then covered one
    # after the other, each window adding the words that the one before doesn't hold.
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(repeats, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.filter("s", lambda x, j: (F.get("s", j - 1)["h"].eqNullSafe(x["h"])) | (F.get("s", j + 1)["h"].eqNullSafe(x["h"])))
    d = d.withColumn("at", F.sort_array(F.transform(at, lambda x: x["i"]))).drop("h", "s")
    fresh = F.transform("at", lambda x, j: F.when(j == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get("at", j - 1))))
    covered = F.aggregate(fresh, F.lit(0), lambda a, x: a + x)
    return d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def failed_rules(measures: DataFrame) -> DataFrame:
    """Measures with a flag for each of ``RULES``, and rule_failed for any of them."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words")
    low, high = MEAN_WORD_CHARS
    length = (F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words"))
    lines = 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")
    return measures.withColumns(dict(zip(RULES, (base, symbols, length, lines)))).withColumn("rule_failed", base | symbols | length | lines)


def host_rates(docs: DataFrame, odds: float = HOST_ODDS, least: float = HOST_LEAST) -> DataFrame:
    """(host, flags of ``RULES``) to one row per host and rule: documents, failures, the rule's prior (mean, strength),
    shrunk rate, rule_kept."""
    hosts = docs.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES))
    hosts = hosts.select("host", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in RULES))).alias("x")).select("host", "n", "x.*")
    # moments of the hosts' rates, weighted by documents: mean m, spread beyond what chance gives, strength a + b
    m = hosts.groupBy("rule").agg(F.sum("n").alias("all"), F.sum("failed").alias("bad"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"), F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"), F.count("*").alias("hosts"))
    m = m.select("*", (F.col("bad") / F.col("all")).alias("mean"))
    between = F.col("squares") - F.col("all") * F.col("mean") * F.col("mean")
    # expected: (hosts - 1) m (1 - m) + rho m (1 - m) (all - hosts - nn / all + 1), with rho = 1 / (a + b + 1)
    chance = F.col("mean") * (1 - F.col("mean"))
    room = F.col("all") - F.col("hosts") - F.col("nn") / F.col("all") + 1
    rho = F.when((chance > 0) & (room > 0), (between - (F.col("hosts") - 1) * chance) / (chance * room)).otherwise(F.lit(0.0))
    strength = F.when(rho > 1 / (MAX_STRENGTH + 1), F.greatest(1 / rho - 1, F.lit(1.0))).otherwise(F.lit(MAX_STRENGTH))
    # a row per rule
    out = hosts.join(F.broadcast(m.select("rule", "mean", strength.alias("strength"))), "rule")
    limit = F.greatest(F.lit(least), odds * F.col("mean") / (1 - F.col("mean") + odds * F.col("mean")))
    out = out.withColumn("rate", (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength")))
    return out.select("host", "rule", "n", "failed", "mean", "strength", "rate", (F.col("rate") <= limit).alias("rule_kept"))


def judge(docs: DataFrame, odds: float = HOST_ODDS, least: float = HOST_LEAST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, host): measures, the rules' flags, rule_failed, host_kept, the host's
    highest rate (host_rate), kept.

    Defined cases: a null or blank text has no words and fails; a null host is a host of its own; repeated rows are judged
    and counted one by one; other columns are passed over; an empty table gives no rows.
    """
    # staged: one pass over the texts serves the counts and the result
    docs = stage(failed_rules(measured(docs)), "measures")
    hosts = host_rates(docs.select("host", *RULES), odds, least).groupBy(F.col("host").alias("v_host")).agg(F.bool_and("rule_kept").alias("host_kept"), F.max("rate").alias("host_rate"))
    # the hosts' side is small, or a shuffled side whose hot keys adaptive execution splits
    out = docs.join(hosts, F.col("host").eqNullSafe(F.col("v_host"))).drop("v_host")
    return out.withColumn("kept", ~F.col("rule_failed") & F.col("host_kept"))
