"""Expressions over text: tokens, years, keys, escaping, redaction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words too common to identify a paper.
STOP_WORDS = ("pdf", "et", "al", "and", "the", "of", "in", "a", "an", "is", "are", "on", "for", "with", "to", "as", "by", "not", "same", "effect", "effects", "task", "study", "https", "http", "www", "doi", "org", "dx", "com", "de", "jr")
#: Query keys that carry secrets, and response headers that may be kept.
SECRET_KEYS = ("key", "api_key", "token", "access_token")
KEPT_HEADERS = ("content-type", "date", "x-request-id", "request-id", "x-goog-request-id", "retry-after")

#: Characters that file names can't hold, and names that are devices.
UNSAFE_CHARACTERS = r'[<>:"/\\|?*\x00-\x1f\x7f]+'
DEVICE_NAMES = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9¹²³]|LPT[1-9¹²³])$"

_EDGE = r"(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})"
_TOKEN = r"[\p{L}\p{N}]+"


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _tokens(text: Column) -> Column:
    """Runs of letters and digits, cut where letters and digits meet, in the text's case."""
    return F.regexp_extract_all(F.regexp_replace(_blank(text), _EDGE, " "), F.lit(f"({_TOKEN})"))


def normalize_text(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, joined by blanks."""
    return F.array_join(_tokens(F.lower(_blank(text))), " ")


def find_year(text: Column) -> Column:
    """The first 19xx or 20xx that isn't part of a longer number; else null."""
    return F.nullif(F.regexp_extract(_blank(text), r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1), F.lit(""))


def _telling(tokens: Column) -> Column:
    """Sorted distinct tokens but stop words, by built-in set functions: no lambda runs for each token."""
    return F.sort_array(F.array_except(tokens, F.array(*map(F.lit, STOP_WORDS))))


def _numeric(t: Column) -> Column:
    return t.rlike(r"^\p{Nd}+$")


def _caseless(t: Column) -> Column:
    return t.rlike(r"^\p{L}$") & (F.lower(t) == F.upper(t))


def significant_tokens(text: Column) -> Column:
    """The tokens by which a paper is told from others, sorted: longer than two characters, or numbers."""
    return F.filter(_telling(_tokens(F.lower(_blank(text)))), lambda t: (F.length(t) >= 3) | _numeric(t))


def short_name_tokens(text: Column) -> Column:
    """Sorted short surnames: capitalised words of two letters, and single letters of scripts without case."""
    names = F.filter(_tokens(text), lambda t: t.rlike(r"^\p{Lu}\p{Ll}$") | _caseless(t))
    return _telling(F.transform(names, F.lower))


def signal_tokens(text: Column) -> Column:
    """Sorted tokens of a document that a paper's tokens may meet."""
    return F.filter(_telling(_tokens(F.lower(_blank(text)))), lambda t: (F.length(t) >= 2) | _numeric(t) | _caseless(t))


def paper_key(source: Column, doi: Column, title: Column, authors: Column, year: Column) -> Column:
    """What identifies a sheet row's paper, from the most to the least precise; null if nothing does."""
    s, d, t, a, y = (F.trim(_blank(c)) for c in (source, doi, title, authors, year))
    return F.when(s != "", s).when(d != "", F.concat(F.lit("doi:"), d)).when(t != "", F.concat(F.lit("title:"), t)).when((a != "") | (y != ""), F.concat(F.lit("authors:"), a, F.lit("|"), y))


def safe_stem(name: Column) -> Column:
    """A file name without its suffix, other characters than A-Z a-z 0-9 . _ - replaced."""
    return F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"[^A-Za-z0-9._-]+", "_")


def collision_free_key(name: Column) -> Column:
    """A readable key that differs wherever names differ."""
    return F.concat(safe_stem(name), F.lit("-"), F.substring(F.sha2(name.cast("binary"), 256), 1, 16))


def spreadsheet_safe(text: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe; numbers with a sign stay."""
    text = _blank(text)
    bare = F.regexp_replace(text, r"^\s+", "")
    formula = bare.rlike(r"^[=+\-@]") & ~bare.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")
    return F.when(text.rlike(r"^[\t\r]") | formula, F.concat(F.lit("'"), text)).otherwise(text)


def redact_secrets(text: Column, secrets: tuple[str, ...]) -> Column:
    """Secrets, raw or URL-encoded, are blotted out; the longest first."""
    from urllib.parse import quote

    for form in sorted({f for s in secrets if s for f in (s, quote(s, safe=""))}, key=lambda f: (-len(f), f)):
        text = F.replace(text, F.lit(form), F.lit("[REDACTED]"))
    return text


def redact_url_query(url: Column) -> Column:
    """Values of secret query keys are blotted out, and the fragment goes."""
    plain = F.regexp_replace(url, r"#.*$", "")
    return F.regexp_replace(plain, rf"(?i)([?&](?:{'|'.join(SECRET_KEYS)})=)[^&]*", "$1[REDACTED]")


def header_allowlist(headers: Column, names: tuple[str, ...] = KEPT_HEADERS) -> Column:
    """The entries of a map whose key, in any case, is one of ``names``."""
    return F.map_filter(headers, lambda k, _: F.lower(k).isin(*names))


@F.pandas_udf(StringType())
def _composed(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFC", n))


@F.pandas_udf(StringType())
def _within_bytes(stems: pd.Series, most: pd.Series) -> pd.Series:
    """The longest prefix of whole characters that fits."""
    return pd.Series([None if s is None else s.encode()[:m].decode(errors="ignore") for s, m in zip(stems, most)], dtype=object)


def safe_document_name(name: Column, suffix: str = ".pdf") -> Column:
    """A struct of ``name``, the file name that an upload may have, and ``error``, why it may have none. Folders go,
    unsafe runs become ``_``, device names are set off, and a name above 180 bytes gets a stem of at most 160."""
    base = F.element_at(F.split(F.regexp_replace(F.translate(_blank(name), "\\", "/"), r"/+$", ""), "/"), -1)
    clean = F.btrim(F.regexp_replace(_composed(base), UNSAFE_CHARACTERS, "_"), F.lit(" ."))
    device = F.rtrim(F.split(clean, r"\.")[0]).rlike(DEVICE_NAMES)
    safe = F.when(device, F.concat(F.lit("_"), clean)).otherwise(clean)
    end = F.regexp_extract(safe, r"(?<=.)(\.[^.]*)$", 1)
    stem = F.substring(safe, F.lit(1), F.length(safe) - F.length(end))
    short = F.when(F.octet_length(safe) > 180, F.concat(_within_bytes(stem, F.lit(160)), end)).otherwise(safe)
    error = F.when(clean == "", "A file name is required.").when(F.lower(end) != suffix, F.concat(base, F.lit(f" is not a {suffix[1:].upper()}.")))
    return F.struct(F.when(error.isNull(), short).alias("name"), error.alias("error"))
