"""URL filtering: rules for places, and a weighted vocabulary for the rest.

An Aho-Corasick automaton finds all terms of an address in one walk. A term counts where no letter or digit touches it.
One strict term rejects; soft terms reject when their weights, each distinct term counted once, reach ``SOFT_LIMIT``.
Rules (host and path) come first: a rule fits its host and all subdomains where the path begins with the rule's, and
the longest one decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def terms(path: str | Path) -> tuple[tuple[str, ...], dict[str, float]]:
    """Strict terms, and soft ones with their weights, of a file of lines ``term,strict`` and ``term,weight``."""
    rows = [x.strip().split(",") for x in Path(path).read_text().splitlines() if x.strip() and not x.startswith("#")]
    return tuple(t for t, w in rows if w == "strict"), {t: float(w) for t, w in rows if w != "strict"}


STRICT, SOFT = terms(Path(__file__).with_name("url_terms.csv"))
SOFT_LIMIT = 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest of ``rules`` (verdict, place) that fits, as struct(verdict, rule), or null. A place is a host and
    the beginning of a path. The rules are a short parameter, so they become one expression."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, below = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + below)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _matcher(strict: tuple[str, ...], soft: dict[str, float]) -> Callable:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            machine.add_word(term, term)
        machine.make_automaton()
        hard = set(strict)
        plain = lambda c: c.isascii() and c.isalnum()
        for urls in batches:
            rows = []
            for url in urls:
                url = url or ""
                found = set()
                for last, term in machine.iter(url):
                    first = last - len(term)
                    if not (first >= 0 and plain(url[first])) and not (last + 1 < len(url) and plain(url[last + 1])):
                        found.add(term)
                rows.append((len(found & hard), sum(soft[t] for t in sorted(found - hard)), len(found - hard)))
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_weight", "soft_hits"])

    return run


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = (), strict: tuple[str, ...] = STRICT, soft: dict[str, float] | None = None, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """``pages`` with host, path, rule, strict_hits, soft_hits, soft_weight and verdict (columns of these names are
    replaced).

    Defined cases: a null address, or one without ``://``, has empty host and path, fits no rule and is searched as it
    is (null: no terms, so allow); repeated rows are judged one by one; an address of any length is searched whole; other
    columns stay; an empty table gives no rows.
    """
    match = F.pandas_udf(_matcher(tuple(strict), dict(SOFT if soft is None else soft)), "strict_hits int, soft_weight double, soft_hits int")
    named = ("host", "path", "rule", "strict_hits", "soft_hits", "soft_weight", "verdict", "_hits", "_rule")
    url = F.col("url").cast("string")
    out = pages.select(*(c for c in pages.columns if c not in named), host_of(url).alias("host"), path_of(url).alias("path"), match(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)).alias("_hits"))
    out = out.withColumn("_rule", rule_for(F.col("host"), F.col("path"), tuple(rules)))
    rejected = (F.col("_hits.strict_hits") > 0) | ((F.col("_hits.soft_hits") > 1) & (F.col("_hits.soft_weight") >= soft_limit))
    method = F.when(rejected, "block").otherwise("allow")
    return out.select("*", F.col("_rule.rule").alias("rule"), F.col("_hits.*"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict")).drop("_hits", "_rule")
