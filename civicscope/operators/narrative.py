"""Sentences about places, built for all rows at once.

A sentence is a chain of array steps over one list of (metric, label, values): each
step reads the one before once, so expressions stay small however many metrics there
are, and no row leaves its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicscope.functions import fixed_values as fixed
from civicscope.functions.numbers import display_value, fixed_text, grouped_text, number_text, safe_ratio

Value = Callable[[str], Column]
Step = Callable[[Column], Column]

# A ratio in this range counts as average; score bands of the growth text.
AVERAGE_LOW, AVERAGE_HIGH = 0.9, 1.1
STRONG_SCORE, MODERATE_SCORE = 60, 40
CLOSE_TO_AVERAGE = "close to city average across most metrics"


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _entry(position: int, label: str, sense: str, less: str, a: Column, b: Column) -> Column:
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(label).alias("label"),
        F.lit(sense == "good").alias("good"),
        F.lit(less).alias("less"),
        a.cast("double").alias("a"),
        b.cast("double").alias("b"),
    )


def _extend(entries: Column, **fields: Step) -> Column:
    """Add fields to each entry of the list."""

    def grow(e: Column) -> Column:
        for name, step in fields.items():
            e = e.withField(name, step(e))
        return e

    return F.transform(entries, grow)


def _cleaned(entries: Column) -> Column:
    """Both values to one decimal."""
    return _extend(_extend(entries, a=lambda e: display_value(e["a"])), b=lambda e: display_value(e["b"]))


def _notable_ratio(entries: Column) -> Column:
    """Add a/b and keep the entries that differ from 1 by more than a tenth."""
    with_ratio = _extend(entries, r=lambda e: safe_ratio(e["a"], e["b"]))
    return F.filter(
        with_ratio, lambda e: e["r"].isNotNull() & ~e["r"].between(AVERAGE_LOW, AVERAGE_HIGH)
    )


def _ahead(higher: Column, entry: Column) -> Column:
    """Whether a higher (or lower) value is to the entry's advantage."""
    return higher == entry["good"]


def _clauses(entries: Column, score: Step, text: Step, positive: Step) -> Column:
    """Sorted clauses, strongest first, then in the order of the metric list."""
    shaped = F.transform(
        entries,
        lambda e: F.struct(
            (-score(e)).alias("weight"),
            e["position"].alias("position"),
            text(e).alias("text"),
            positive(e).alias("positive"),
        ),
    )
    return F.array_sort(shaped)


def _texts(clauses: Column, positive: bool | None = None, n: int | None = None) -> Column:
    """Clause texts of one side joined by commas; empty when there are none."""
    chosen = clauses
    if positive is not None:
        chosen = F.filter(chosen, lambda c: c["positive"] if positive else ~c["positive"])
    if n is not None:
        chosen = F.slice(chosen, 1, n)
    return F.array_join(F.transform(chosen, lambda c: c["text"]), ", ")


def _bind(value: Column, body: Step) -> Column:
    """Use a long expression several times while computing it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def growth_text(score: Column) -> Column:
    """Growth sentence for a score; NULL without one."""
    band = (
        F.when(score >= STRONG_SCORE, "strong growth trajectory")
        .when(score >= MODERATE_SCORE, "moderate growth")
        .otherwise("slower growth period")
    )
    shown = _bind(display_value(score), number_text)
    return F.when(score.isNotNull(), _say("momentum score: ", shown, "/100 (", band, ")"))


def age_text(category: Column, age: Column) -> Column:
    """Sentence on the most common business type; NULL without one."""
    kind = F.coalesce(category, F.lit("None"))
    return F.when(
        age.isNotNull(),
        _say(". most common business type (", kind, ") has median age of ", age.cast("string"), " years"),
    )


def _average_entries(metrics: Sequence, value: Value, average: Value) -> Column:
    return F.array(
        *[
            _entry(i, label, sense, less, value(metric), average(mean))
            for i, (metric, mean, label, sense, less) in enumerate(metrics)
        ]
    )


def place_sentence(
    value: Value,
    average: Value,
    momentum: Column,
    top_category: Column,
    top_age: Column,
    metrics=fixed.PLACE_SENTENCE,
    *,
    peer: str,
) -> Column:
    """How one place differs from the average place, in its five strongest points."""

    def text(e: Column) -> Column:
        r, label, less = e["r"], e["label"], e["less"]
        return (
            F.when(r > 10.0, _say("far more ", label))
            .when(r >= 2.0, _say(fixed_text(r), "x the ", label))
            .when(r > AVERAGE_HIGH, _say(fixed_text((r - 1) * 100), "% more ", label))
            .when(r < 0.1, _say("far ", less, " ", label))
            .when(r < 0.5, _say("1/", fixed_text(safe_ratio(F.lit(1.0), r)), " the ", label))
            .otherwise(_say(fixed_text((F.lit(1.0) - r) * 100), "% ", less, " ", label))
        )

    entries = _notable_ratio(_cleaned(_average_entries(metrics, value, average)))
    clauses = _clauses(entries, lambda e: F.abs(e["r"] - 1), text, lambda e: _ahead(e["r"] > 1.0, e))

    def story(top: Column) -> Column:
        points = F.concat_ws(" — but ", _some(_texts(top, True)), _some(_texts(top, False)))
        told = F.concat(
            F.lit(f"compared to the avg {peer}: "),
            points,
            F.coalesce(_say(". ", growth_text(momentum)), F.lit("")),
            F.coalesce(age_text(top_category, top_age), F.lit("")),
        )
        return F.when(F.size(top) == 0, CLOSE_TO_AVERAGE).otherwise(told)

    return _bind(F.slice(clauses, 1, 5), story)


def area_sentence(
    area: Column,
    places: Column,
    value: Value,
    average: Value,
    momentum: Column,
    top_category: Column,
    top_age: Column,
    metrics=fixed.AREA_SENTENCE,
    unit: str = "zip codes",
    *,
    peer: str,
) -> Column:
    """How one area differs from the average place, in its five strongest points."""

    def text(e: Column) -> Column:
        r = e["r"]
        share_less = _say(fixed_text((F.lit(1.0) - r) * 100), "% ", e["less"])
        size = (
            F.when(r > 10, _say(fixed_text(r), "x"))
            .when((r > 0) & (r < 0.1), _say("1/", fixed_text(safe_ratio(F.lit(1.0), r)), "th the"))
            .when(r >= 2, _say(fixed_text(r, 1), "x"))
            .when(r > 1, _say(fixed_text((r - 1) * 100), "% more"))
            .otherwise(share_less)
        )
        return _say(size, " ", e["label"])

    entries = _notable_ratio(_average_entries(metrics, value, average))
    clauses = _clauses(entries, lambda e: F.abs(e["r"] - 1), text, lambda e: _ahead(e["r"] > 1, e))
    people = value("population")
    residents = F.when(people != 0, _say(", pop ", grouped_text(people)))
    prefix = _say(F.lower(area), " (", places.cast("string"), f" {unit}", F.coalesce(residents, F.lit("")), ")")

    def story(top: Column) -> Column:
        good, bad = _texts(top, True), _texts(top, False)
        told = F.concat(
            F.lit(f"compared to the avg {peer}: "),
            prefix,
            F.lit(" has "),
            good,
            F.when((good != "") & (bad != ""), " — but ").otherwise(""),
            bad,
            F.lit("."),
            F.coalesce(_say(" ", growth_text(momentum)), F.lit("")),
            F.coalesce(age_text(top_category, top_age), F.lit("")),
        )
        return F.when(F.size(top) == 0, _say(prefix, f" is {CLOSE_TO_AVERAGE}.")).otherwise(told)

    return _bind(F.slice(clauses, 1, 5), story)


def _who_is_ahead(clauses: Column, name_a: Column, name_b: Column, end: str = "") -> Column:
    """Three points for each side, or that both are similar."""

    def told(c: Column) -> Column:
        a, b = _some(_texts(c, True, 3)), _some(_texts(c, False, 3))
        return _say(F.concat_ws(" — ", _say(name_a, " has ", a), _say(name_b, " has ", b)), end)

    similar = _say(name_a, " and ", name_b, " are similar across most metrics", end)
    return _bind(clauses, lambda c: F.when(F.size(c) == 0, similar).otherwise(told(c)))


def place_pair_sentence(
    name_a: Column, name_b: Column, value_a: Value, value_b: Value, metrics=fixed.PLACE_SENTENCE
) -> Column:
    """Where each of two places is ahead, three points each."""

    def text(e: Column) -> Column:
        r = e["r"]
        size = (
            F.when(r.isNull() | (r > 10.0), "far")
            .when(r >= 2.0, _say(fixed_text(r), "x"))
            .otherwise(_say(fixed_text((r - 1) * 100), "%"))
        )
        return _say(size, " ", F.when(e["good"], "more").otherwise(e["less"]), " ", e["label"])

    def score(e: Column) -> Column:
        return F.abs(e["a"] - e["b"]) / F.greatest(F.abs(e["a"]), F.abs(e["b"]), F.lit(1.0))

    entries = F.array(
        *[
            _entry(i, label, sense, less, value_a(metric), value_b(metric))
            for i, (metric, _, label, sense, less) in enumerate(metrics)
        ]
    )
    differing = F.filter(
        _cleaned(entries), lambda e: e["a"].isNotNull() & e["b"].isNotNull() & (e["a"] != e["b"])
    )
    least = lambda e: F.least(e["a"], e["b"])
    sized = _extend(
        differing, r=lambda e: F.when(least(e) > 0, safe_ratio(F.greatest(e["a"], e["b"]), least(e)))
    )
    clauses = _clauses(sized, score, text, lambda e: _ahead(e["a"] > e["b"], e))
    return _who_is_ahead(clauses, name_a, name_b)


def area_pair_sentence(
    name_a: Column, name_b: Column, value_a: Value, value_b: Value, metrics=fixed.AREA_PAIR_SENTENCE
) -> Column:
    """Where each of two areas is ahead by more than a tenth, three points each."""

    def text(e: Column) -> Column:
        share = fixed_text(F.abs(e["r"] - 1) * 100)
        return _say(share, F.when(e["r"] > 1, "% more ").otherwise("% fewer "), e["label"])

    entries = F.array(
        *[
            _entry(0, label, sense, "", value_a(metric), value_b(metric))
            for metric, label, sense in metrics
            if sense != "neutral"
        ]
    )
    # Equal shares go by falling text here, so both sort keys run downwards.
    shaped = F.transform(
        _notable_ratio(_cleaned(entries)),
        lambda e: F.struct(
            (F.abs(e["r"] - 1) * 100).alias("weight"),
            text(e).alias("text"),
            _ahead(e["r"] > 1, e).alias("positive"),
        ),
    )
    clauses = F.sort_array(shaped, asc=False)
    return _who_is_ahead(clauses, F.lower(name_a), F.lower(name_b), ".")
