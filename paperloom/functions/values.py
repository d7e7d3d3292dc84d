"""Expressions over coded values, finish reasons and scores."""

from __future__ import annotations

import json
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
#: Fixed values of the providers' vocabularies.
NORMAL_REASONS = ("stop", "eos_token", "stop_sequence")


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.5, "medium").when(score >= 0.25, "low").otherwise("none")


def normalize_finish_reason(value: Column) -> Column:
    reason = F.lower(F.trim(value))
    return F.when((reason == "") | (reason == "finish_reason_unspecified"), F.lit(None).cast("string")).when(reason == "max_tokens", "length").otherwise(reason)


def review_flags(repaired: Column, finish_reason: Column) -> Column:
    """Why a valid response is held for review: cut off early, or repaired; an array in that order."""
    early = F.when(finish_reason.isNotNull() & ~finish_reason.isin(*NORMAL_REASONS), F.concat(F.lit("stopped early: "), finish_reason))
    return F.array_compact(F.array(early, F.when(repaired.isNotNull(), F.lit("repaired JSON"))))


#: Full case folding, taken from the Unicode tables at hand: most characters fold to one, sharp s, ligatures and the like to
#: several.
_FOLDED = {c: f for c, f in ((c, c.casefold()) for c in map(chr, range(0x80, 0x110000))) if c != f}
_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1}
_SEVERAL = {c: f for c, f in _FOLDED.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Text for comparison without regard to case: equal wherever full case folding makes it equal. Plain ASCII is
    lower-cased; only texts with a character that folds to several go through their replacements."""
    low = F.translate(text, string.ascii_uppercase + "".join(_ONE), string.ascii_lowercase + "".join(_ONE.values()))
    # a fold over one constant, which the optimizer works out once, stays a small expression; only such texts evaluate it
    pairs = F.from_json(F.lit(json.dumps([{"c": c, "f": f} for c, f in _SEVERAL.items()])), "array<struct<c: string, f: string>>")
    several = F.aggregate(pairs, low, lambda t, p: F.replace(t, p["c"], p["f"]))
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), F.lower(text)).otherwise(F.when(text.rlike(f"[{''.join(_SEVERAL)}]"), several).otherwise(low))


def _folded(text: Column) -> Column:
    """Case folded, runs of blanks of any kind as one, trimmed."""
    return F.trim(F.regexp_replace(casefold(text), r"(?U)[\s\x1c-\x1f]+", " "))


def number_of(text: Column) -> Column:
    """The double that a text spells, else null."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def values_match(value_type: Column, value_text: Column, truth: Column, compare: Column) -> Column:
    """Whether a coded value equals the human's, by exact text, boolean, span of years, or number with a tolerance."""
    kind, tolerance = F.split(compare, ":")[0], F.try_element_at(F.split(compare, ":"), F.lit(2)).try_cast("double")
    got, want = number_of(value_text), number_of(truth)
    near = F.when(kind == "number_abs", F.abs(F.abs(got) - F.abs(want))).otherwise(F.abs(got - want)) <= tolerance
    years = lambda c: F.regexp_replace(F.regexp_replace(_folded(c), "[–—]", "-"), " ", "")
    return F.coalesce(
        F.when(kind.isin("number", "number_abs"), near & (value_type != "boolean"))
        .when(kind == "bool", (value_type == "boolean") & (F.lower(value_text) == F.when(truth == "true", "true").otherwise("false")))
        .when(kind == "years", years(value_text) == years(truth))
        .otherwise(_folded(value_text) == _folded(truth)),
        F.lit(False),
    )


def cell_type_check(type_: Column, levels: Column, value_type: Column, value_text: Column) -> Column:
    """Whether a coded value has its field's type; null always has. Numbers must be finite."""
    level = (F.coalesce(F.size(levels), F.lit(0)) <= 0) | F.array_contains(levels, value_text)
    finite = ~F.coalesce(F.lower(value_text).rlike(r"^[+-]?(nan|inf(inity)?)$"), F.lit(False))
    return F.coalesce(
        F.when(value_type == "null", F.lit(True))
        .when(type_ == "string", (value_type == "string") & level)
        .when(type_ == "number", (value_type == "integer") | ((value_type == "number") & finite))
        .when(type_ == "integer", value_type == "integer")
        .otherwise(value_type == "boolean"),
        F.lit(False),
    )
