"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import align, chat, decontaminate, html_text, language_id, mixing, near_dedup, negatives, quality_model, quality_rules, sharding, token_counts, url_filter
from paperloom.plans.staging import stage

SHARDS = 24
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A conversation whose texts are full of what templates use as marks.
ODD_CONVERSATION, ODD_TEXT = -7, "\\### Assistant: </turn> ok"
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``first_slot``: where in the mix's order a document stands first."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.count_words(F.col("text")).alias("size"), F.md5(F.col("text").cast("binary")).alias("salt"))
    # staged: the texts are read once
    taken = mixing.taken_words(stage(docs, "sizes"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    return language_id.identified(docs)


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where markup and addresses exist: declared language of the markup, host and its suffix."""
    pages = _table(spark, sf_dir, "pages")
    host = url_filter.host_of(F.col("url"))
    declared = F.substring(F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([a-z]+)", 1), 1, 2)
    docs = pages.select(F.col("page_id").alias("doc_id"), "html", declared.alias("declared"), host.alias("host"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"))
    # staged: a page is rendered once, and not by workers that stand beside those that score it
    return language_id.identified(stage(html_text.with_text(docs), "texts")).withColumnRenamed("doc_id", "page_id")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"))
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule_failed", "host_kept", "kept")


def quality_rules_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator, its rules one by one and the host's rate beside them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"))
    return quality_rules.judge(docs).select("doc_id", "n_words", "n_lines", *quality_rules.RULES, "host_rate", "host_kept", "kept")


def op6_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.assign_shards(docs, "doc_id", SHARDS, order_by=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that it holds."""
    hits = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.withColumn("contaminated", F.lit(True)).withColumn("kept", F.lit(False))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality_model.fitted(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    out = quality_model.scored(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.alignment(_table(spark, sf_dir, "documents"), BYTE_TOKENIZER, TOKENIZER)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; a seventh of the rows have another label than theirs."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like marks, go through an event log, are folded, rendered and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = [(ODD_CONVERSATION, turn, role, ODD_TEXT) for turn, role in enumerate(("user", "assistant"))]
    odd = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(t).alias("text")) for c, n, r, t in odd))).alias("r"))
    return chat.digests(chat.formatted(chat.streamed(rows.unionByName(odd.select("r.*")))))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_url_filter, op3_language_id, op4_near_dedup, op5_quality_rules, op6_shard_ring, op7_decontaminate, op8_html_text, op9_quality_model, op10_token_counts, op11_token_alignment, op12_hard_negatives, op13_chat_format, language_id_pages, quality_rules_all)}

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"


def _term(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


def _sql() -> dict[str, str]:
    lower = f"translate({{}}, '{url_filter.UPPER}', '{url_filter.LOWER}')"
    fits = " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{v} {r}'" for v, r in sorted(RULES, key=lambda x: -len(x[1]))
    )
    strict = " OR ".join(_term(t) for t in url_filter.STRICT)
    hits = " + ".join(f"{_term(t)}::INT" for t in url_filter.SOFT)
    weight = " + ".join(f"{w} * {_term(t)}::INT" for t, w in url_filter.SOFT.items())
    escape = r"regexp_replace(replace({}, '\', '\\'), '<(/?turn>|says>)', '<\\\1', 'g')"
    return {
        "op12_hard_negatives": """
            WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
                WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, a.label AS a_label, b.vec_id, b.label, list_dot_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON true WHERE a.vec_id % 100 = 0),
            p AS (SELECT anchor_id, a_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = a_label AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
            SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.a_label AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
            QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""",
        "op13_chat_format": f"""
            WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL VALUES ({ODD_CONVERSATION}, 0, 'user', '{ODD_TEXT}'), ({ODD_CONVERSATION}, 1, 'assistant', '{ODD_TEXT}'))
            SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
                sum(length({escape.format("role")}) + length({escape.format("text")}) + {len(chat.TURN + chat.SAYS + chat.END) + 1})::BIGINT AS formatted_chars
            FROM r GROUP BY conv_id""",
        "op1_mix_sources": f"""
            WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(md5(text), '')) AS turn FROM documents),
            s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
            c AS (SELECT *, 3 * source_size AS cap FROM s),
            o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS rest, sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
                  FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            f AS (SELECT *, rest * weight > cap * rest_weight AS is_full FROM o),
            l AS (SELECT rest AS l_rest, rest_weight AS l_weight FROM f WHERE NOT is_full ORDER BY rest_weight DESC LIMIT 1),
            t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE l_rest::DOUBLE * weight / l_weight END AS target FROM f LEFT JOIN l ON true),
            p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
            w AS (SELECT source, source_size, round(target)::BIGINT AS want, ceil(source_size / {mixing.BLOCK_WORDS})::BIGINT AS per_epoch, round(target)::BIGINT // source_size AS epochs, round(target)::BIGINT % source_size AS rest FROM t WHERE source_size > 0),
            k AS (SELECT *, (epochs * per_epoch + ceil(rest / {mixing.BLOCK_WORDS}))::BIGINT AS slots FROM w),
            lo AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low, greatest(1, length(bin(greatest(sum(slots) OVER () - 1, 0)::BIGINT)))::BIGINT AS bits FROM k),
            pt AS (SELECT source, bits, low + unnest(range(slots)) AS x FROM lo),
            sl AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS place FROM (SELECT source, list_sum(list_transform(range(bits), lambda i: ((x >> i) & 1) << (bits - 1 - i)))::BIGINT AS slot FROM pt)),
            q AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
            z AS (SELECT *, (epochs * size + greatest(0, least(start + size, round(target)::BIGINT - epochs * source_size) - start))::BIGINT AS taken FROM q)
            SELECT doc_id, z.source, size, source_size, target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot FROM z LEFT JOIN sl ON z.source IS NOT DISTINCT FROM sl.source AND place = start // {mixing.BLOCK_WORDS}""",
        "op2_url_filter": f"""
            WITH h AS (SELECT page_id, {lower.format("coalesce(url, '')")} AS u,
                {lower.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} AS host,
                coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
            r AS (SELECT *, CASE {fits} END AS fit, CASE WHEN {strict} OR (({hits}) > 1 AND ({weight}) >= {url_filter.SOFT_LIMIT}) THEN 'block' ELSE 'allow' END AS own FROM h)
            SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule, coalesce(split_part(fit, ' ', 1), own) AS verdict FROM r""",
        "op4_near_dedup": f"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
            g AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
            i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
            e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
            u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
            c AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a),
            m AS (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a)
            SELECT m.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
        "op5_quality_rules": f"""
            WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
            g AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) > 8)),
            f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
            r AS (SELECT doc_id, sum(least(8, coalesce(j - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM f) GROUP BY doc_id),
            m AS (SELECT d.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                  len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
            b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed, 100 * n_symbols > {quality_rules.MAX_SYMBOL_PERCENT} * n_words AS symbols_failed,
                  word_chars < {quality_rules.MEAN_WORD_CHARS[0]} * n_words OR word_chars > {quality_rules.MEAN_WORD_CHARS[1]} * n_words AS length_failed, 100 * n_dup_lines > {quality_rules.MAX_DUP_LINE_PERCENT} * n_lines AS lines_failed FROM m),
            h AS (SELECT source, rule, count(*) AS n, sum(bad::INT) AS failed FROM (SELECT source, unnest([{{'rule': 1, 'bad': base_failed}}, {{'rule': 2, 'bad': symbols_failed}}, {{'rule': 3, 'bad': length_failed}}, {{'rule': 4, 'bad': lines_failed}}], recursive := true) FROM b) GROUP BY source, rule),
            a AS (SELECT rule, sum(n) AS nn, count(*) AS k, sum(failed)::DOUBLE / sum(n) AS mean, sum(failed * failed::DOUBLE / n) AS sq, sum(n * n::DOUBLE) AS n2 FROM h GROUP BY rule),
            p AS (SELECT rule, mean, CASE WHEN mean * (1 - mean) > 0 AND nn - k - n2 / nn + 1 > 0 THEN (sq - nn * mean * mean - (k - 1) * mean * (1 - mean)) / (mean * (1 - mean) * (nn - k - n2 / nn + 1)) ELSE 0.0 END AS rho FROM a),
            t AS (SELECT rule, mean, CASE WHEN rho > 1 / {quality_rules.MAX_STRENGTH + 1} THEN greatest(1 / rho - 1, 1.0) ELSE {quality_rules.MAX_STRENGTH} END AS strength FROM p),
            v AS (SELECT source, bool_and((failed + mean * strength) / (n + strength) <= greatest({quality_rules.HOST_LEAST}, {quality_rules.HOST_ODDS} * mean / (1 - mean + {quality_rules.HOST_ODDS} * mean))) AS host_kept FROM h JOIN t USING (rule) GROUP BY source),
            o AS (SELECT b.*, host_kept, base_failed OR symbols_failed OR length_failed OR lines_failed AS rule_failed FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source)
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule_failed, host_kept, NOT rule_failed AND host_kept AS kept FROM o""",
    }


ORACLE_SQL = _sql()
