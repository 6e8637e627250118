"""Parts of a scenario name, "<truth>_x_<estimator>[_<design>]".

A name is split at its separator into the truth's phrase and a tail; a phrase is a list of
tokens between underscores. The estimator's phrase is the tail's leading tokens without digits,
what follows is the design; or, for short names, the tail up to the first known suffix. Classes
are read off the two phrases: a phrase that starts with `no_rt` assumes no event, one that names
every year an event in each, a repeated one several, any other a single one of two years.

Where that differs from listing scenarios one by one: every tail `all_yrs` is an "all years"
estimator, a name without a separator is its own truth, and "no event" holds for every truth or
estimator phrase `no_rt...`, not only in the listed scenarios.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scenario names and name parts with a meaning of their own.
CORE_SCENARIOS = ["no_rt", "no_rt_x_rt_2", "rt_2_x_no_rt", "rt_2_x_rt_2"]
EVERY_YEAR_SCENARIOS = ["no_rt_x_all_yrs", "rep_3_x_all_yrs", "rt_2_x_all_yrs"]
SHAPES = ["flat", "young", "old", "mid"]
WHOLE_NAME_TRUTHS = ["rt_2", "no_rt", "rep_3"]
BASE_SUFFIXES = ("_all_yrs", "_rt_2")
DESIGN_SUFFIXES = ("_all_yrs", "_rt_2", "_rt_34")
TRUTH_LEVELS = ["reference", "young", "mid", "old", "flat"]
ESTIMATOR_LEVELS = ["reference", "all years", "young", "mid", "old", "flat"]
SEPARATOR, EVENT, EVERY_YEAR, REPEATED, QUIET, HIGH = "_x_", "rt", "all_yrs", "rep", "no_rt", "high"


def _half(scenario: Column, i: int) -> Column:
    """Truth phrase (1) or tail (2) of a name with a separator, else NULL."""
    halves = F.split(scenario, SEPARATOR, 2)
    return F.when(F.size(halves) == 2, F.element_at(halves, i))


def _before(text: Column, marks: tuple[str, ...]) -> Column:
    """Text before the first of the marks, NULL if none is there."""
    found = F.filter(F.array(*[F.locate(m, text) for m in marks]), lambda at: at > 0)
    at = F.array_min(found)
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1))


def _joined(tokens: Column) -> Column:
    return F.array_join(tokens, "_")


def raw_truth(scenario: Column) -> Column:
    return _half(scenario, 1)


def raw_estimator(scenario: Column, suffixes: tuple[str, ...] = BASE_SUFFIXES) -> Column:
    return _before(_half(scenario, 2), suffixes)


def truth_name(scenario: Column) -> Column:
    """Truth model; designs that vary the truth itself keep the whole name."""
    truth = F.coalesce(raw_truth(scenario), scenario)
    return F.when(truth.isin(WHOLE_NAME_TRUTHS), scenario).otherwise(truth)


def estimator_name(scenario: Column, suffixes: tuple[str, ...] = BASE_SUFFIXES,
                   every_year: list[str] | None = None) -> Column:
    """Estimation model; 'reference' when the name carries none."""
    tail = _half(scenario, 2)
    yearly = tail == EVERY_YEAR if every_year is None else scenario.isin(every_year)
    return F.coalesce(F.when(yearly, "all years"), _before(tail, suffixes), F.lit("reference"))


def level_ordinal(name: Column, levels: list[str]) -> Column:
    """Position of a name in an explicit level order, NULL when it is not a level."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), name)
    return F.nullif(pos, F.lit(0)).cast("int")


def raw_parts(scenario: Column) -> tuple[Column, Column, Column]:
    """Truth phrase, leading words of the tail, and its rest with the underscore before it.

    All are '' for a name without a separator or with a tail that starts with no word.
    """
    tokens = F.split(_half(scenario, 2), "_")
    words = F.transform(tokens, lambda t: t.rlike("^[a-z]+$"))
    stop = F.array_position(words, False).cast("int")
    n = F.when(stop > 0, stop - 1).otherwise(F.size(tokens))
    rest = F.slice(tokens, n + 1, F.size(tokens))
    known = F.coalesce(n > 0, F.lit(False))
    parts = (
        _half(scenario, 1),
        _joined(F.slice(tokens, F.lit(1), n)),
        F.when(F.size(rest) > 0, F.concat(F.lit("_"), _joined(rest))).otherwise(""),
    )
    return tuple(F.when(known, p).otherwise("") for p in parts)


def split_parts(scenario: Column) -> dict[str, Column]:
    """om_name, em_name and design; the last two are NULL without an "_x_"."""
    om, em, rest = raw_parts(scenario)
    matched = om != ""
    design = F.ltrim(rest, F.lit("_"))
    number = design.cast("string").rlike("^[0-9]+$")

    def without_event(phrase: Column) -> Column:
        """A shape's own event token says nothing: it is left out."""
        tokens = F.split(phrase, "_")
        return _joined(
            F.filter(
                tokens,
                lambda t, i: ~((t == EVENT) & (i > 0) & F.get(tokens, i - 1).isin(SHAPES)),
            )
        )

    return {
        "om_name": without_event(F.when(matched, om).otherwise(scenario)),
        "em_name": F.when(matched, without_event(em)),
        "design": F.when(matched, F.when(number, F.concat(F.lit("rt_"), design)).otherwise(design)),
    }


def design_class(scenario: Column, variant: str = "base") -> dict[str, Column]:
    """Readable classes of the estimator's and the truth's event assumption.

    variant "base" knows every-year estimators and repeated truths; "high" knows
    high-magnitude designs instead.
    """
    phrases = {
        "em_class": F.coalesce(_half(scenario, 2), scenario),
        "om_class": F.coalesce(_half(scenario, 1), scenario),
    }
    if variant == "high":
        large = F.array_contains(F.split(scenario, "_"), HIGH)
        event = F.when(large, "two-year high event").otherwise("two-year event")
        special = {"em_class": [], "om_class": []}
    else:
        event = F.lit("two-year event")
        special = {
            "em_class": [(F.endswith(phrases["em_class"], F.lit(EVERY_YEAR)), "every-year event")],
            "om_class": [(F.startswith(phrases["om_class"], F.lit(REPEATED)), "repeated event")],
        }
    return {
        side: F.coalesce(
            F.when(F.startswith(phrase, F.lit(QUIET)), "no event"),
            *[F.when(cond, text) for cond, text in special[side]],
            event,
        )
        for side, phrase in phrases.items()
    }
