"""Text matching and extraction expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First hit of a regex group, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    """All hits of a regex group as an array; a null text gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


SLOT = "\uffff"  # parts slots; where a text holds it, it is written as two other code points meanwhile
_MARK, _MARK_ITSELF, _MARK_SLOT = "\ufffe", "\ufffe0", "\ufffe1"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_MARK), F.lit(_MARK_ITSELF)), F.lit(SLOT), F.lit(_MARK_SLOT))


def _restored(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_MARK_SLOT), F.lit(SLOT)), F.lit(_MARK_ITSELF), F.lit(_MARK))


def packed(text: Column, pattern: str, template: list[str]) -> Column:
    """All groups of an anchored pattern in one regex pass: the text is rewritten to slots that ``split`` separates.

    ``template`` holds one replacement per slot, such as ``$2`` or ``$4 $5``.
    """
    return F.regexp_replace(_escaped(text), pattern.removesuffix("$") + ".*", SLOT.join(template))


def slots(packed_text: Column) -> Column:
    parts = F.split(packed_text, SLOT)
    return F.when(F.contains(packed_text, F.lit(_MARK)), F.transform(parts, _restored)).otherwise(parts)


def hinted_matches(text: Column, lowered: Column, pattern: str, hint: str, group: int = 1) -> Column:
    """All hits of a pattern, tried only where the lower-cased text holds a literal that every hit must hold."""
    none = F.array().cast("array<string>")
    return F.when(lowered.contains(hint), all_matches(text, pattern, group)).otherwise(none)


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def contains_any(lowered: Column, words: list[str]) -> Column:
    """Whether an already lower-cased text holds one of the words."""
    return any_of([lowered.contains(w.lower()) for w in words])


def holds_any(text: Column, words: list[str]) -> Column:
    """The same test for use in a filter, where the text expression would be copied once per word: here it occurs
    once, in one alternation of plain words."""
    return F.lower(text).rlike("|".join(re.escape(w.lower()).replace("\\ ", " ") for w in words))


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    return any_of([value.startswith(p) for p in prefixes])


def pattern_hit(lowered: Column, pattern: str) -> Column:
    """Match a word list entry: plain text by ``contains``, the few real regexes by ``rlike``."""
    if ".*" in pattern:
        return lowered.rlike(f"(?i){pattern}")
    return lowered.contains(pattern.lower())


def first_contained(text: Column, words: list[str]) -> Column:
    """The first word of the list that the text holds."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def bound(value: Column, make) -> Column:
    """``make(value)`` with the value computed once: inside a lambda function an expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _last_values(both: Column) -> Column:
    keys = both["keys"]
    pairs = F.arrays_zip(keys.alias("key"), both["values"].alias("value"))
    named = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
    last = F.filter(
        named,
        lambda p, i: ~F.exists(F.slice(keys, i + F.lit(2), F.size(keys) + F.lit(1)), lambda k: k == p["key"]),
    )
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), named).otherwise(last))


def pairs_to_map(keys: Column, values: Column) -> Column:
    """A map from parallel arrays in which a repeated key keeps its last value."""
    return bound(F.struct(keys.alias("keys"), values.alias("values")), _last_values)
