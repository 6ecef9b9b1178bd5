"""Category of a business from its industry code and description, as one expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pyspark.sql import Column
from pyspark.sql import functions as F

from civicscope.functions import fixed_values as fixed

Rules = Sequence[tuple[Sequence[str], str]]


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a literal map, NULL when absent (stays inside generated code)."""
    entries = [F.lit(part) for item in table.items() for part in item]
    return F.element_at(F.create_map(*entries), key)


def keyword_category(text: Column, rules: Rules = fixed.KEYWORDS) -> Column:
    """First rule with a word contained in the lower-cased text; NULL when none.

    The rules are one literal array walked per row: the text is lowered once and the
    walk stops testing at the first hit.  A chain of conditions would become one
    generated method too long for the JVM to compile.
    """
    table = F.array(
        *[
            F.struct(F.array(*[F.lit(w) for w in words]).alias("words"), F.lit(category).alias("category"))
            for words, category in rules
        ]
    )

    def first_hit(lowered: Column) -> Column:
        def step(found: Column, rule: Column) -> Column:
            hit = F.exists(rule["words"], lambda word: F.contains(lowered, word))
            return F.coalesce(found, F.when(hit, rule["category"]))

        return F.aggregate(table, F.lit(None).cast("string"), step)

    return F.get(F.transform(F.array(F.lower(text)), first_hit), F.lit(0))


def code_category(
    code: Column,
    prefixes: Mapping[str, str] = fixed.PREFIXES,
    sectors: Mapping[str, str] = fixed.SECTORS,
    lengths: Sequence[int] = (5, 4, 3),
    sector_length: int = 2,
) -> Column:
    """Longest known prefix of the code, else its sector, else NULL."""
    clean = F.substring_index(F.trim(code), ".", 1)
    tries = [lookup(prefixes, clean)]
    tries += [lookup(prefixes, F.substring(clean, 1, n)) for n in lengths]
    tries.append(lookup(sectors, F.substring(clean, 1, sector_length)))
    return F.coalesce(*tries)


def classify(
    code: Column,
    text: Column,
    prefixes: Mapping[str, str] = fixed.PREFIXES,
    sectors: Mapping[str, str] = fixed.SECTORS,
    rules: Rules = fixed.KEYWORDS,
    default: str = "other",
    strict_nulls: bool = True,
) -> Column:
    """Category by code, then by words of the description, then the default.

    ``strict_nulls`` gives NULL as soon as either input is NULL; without it a
    missing code falls through to the words.
    """
    found = F.coalesce(
        code_category(code, prefixes, sectors), keyword_category(text, rules), F.lit(default)
    )
    if strict_nulls:
        return F.when(code.isNotNull() & text.isNotNull(), found)
    return found
