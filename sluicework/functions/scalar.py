"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions.constants import NULL_TOKENS, SUBJECT_WORDS

# White space as JavaScript's trim() sees it: Spark's trim() removes blanks only.
_SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, f"^{_SPACE}+|{_SPACE}+\\z", "")


def null_token(value: Column) -> Column:
    """NULL when the trimmed text is one of the null tokens, else the text unchanged."""
    return F.when(strip(value).isin(NULL_TOKENS), F.lit(None)).otherwise(value)


def safe_divide(top: Column, bottom: Column) -> Column:
    """NULL for a zero or NULL divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def share(part: Column, whole: Column, digits: int) -> Column:
    return F.round(safe_divide(part, whole), digits)


def safe_long(value: Column) -> Column:
    """Text that is not an integer becomes NULL; ``3.7`` is not an integer.

    The pattern goes first because a failing cast raises and catches an error per row,
    which costs far more than the test.
    """
    return F.when(value.rlike(r"^\s*[+-]?[0-9]+\s*\z"), value.try_cast("long"))


def safe_double(value: Column) -> Column:
    """Text that is not a number becomes NULL; tested before the cast like integers."""
    number = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)\s*\z"
    return F.when(value.rlike(number), value.try_cast("double"))


def double_to_long(value: Column) -> Column:
    """Nearest integer; a bare cast of a double would truncate."""
    return F.round(value).try_cast("long")


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def steady_mean(column: str) -> Column:
    """Mean from an exact sum of decimals of twelve places, divided once: it does not depend
    on the order in which partitions were added up."""
    return F.sum(F.col(column).cast("decimal(38,12)")).cast("double") / F.count(column)


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or NULL."""
    return F.when(condition, 1).otherwise(0)


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def recency_weight(age: Column, rate: float = 0.07) -> Column:
    return F.exp(F.lit(-rate) * age)


def mean_of(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / F.lit(len(columns))


def weighted_sum(weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * F.lit(weight)
    return total


def subject_area(name: Column, words: Mapping[str, Sequence[str]] = SUBJECT_WORDS) -> Column:
    """First subject whose word list has a hit in the lower-cased text, else ``other``."""
    text = F.lower(name)
    chosen = F.lit("other")
    for subject in reversed(list(words)):
        hit = F.lit(False)
        for word in words[subject]:
            hit = hit | text.contains(word)
        chosen = F.when(hit, F.lit(subject)).otherwise(chosen)
    return chosen


def table_name(value: Column, collapse: bool = False) -> Column:
    """Text turned into a table name of at most 128 characters.

    Plain form: other characters become ``_`` and leading ``_`` go. With ``collapse``
    runs shrink to one ``_``, both ends are stripped, a leading digit gets ``t_`` and
    an empty name becomes ``unnamed_table``.
    """
    name = F.regexp_replace(value, "[^a-zA-Z0-9_]", "_")
    if not collapse:
        return F.substring(F.regexp_replace(name, "^_+", ""), 1, 128)
    name = F.regexp_replace(F.regexp_replace(name, "_+", "_"), "^_|_\\z", "")
    name = F.when(name.rlike("^[0-9]"), F.concat(F.lit("t_"), name)).otherwise(name)
    name = F.substring(name, 1, 128)
    return F.when(name == "", F.lit("unnamed_table")).otherwise(name)


def dataset_name(file_name: Column) -> Column:
    """Base name without extension, lower case, blanks and hyphens as ``_``."""
    stem = F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]+\z", "")
    return F.regexp_replace(F.lower(stem), r"[\s-]+", "_")


def zone_path(dataset: Column, at: Column, job: Column, file_name: Column) -> Column:
    """``<dataset>/year=YYYY/month=MM/day=DD/<job>/<file>`` (session clock is UTC)."""
    return F.concat_ws(
        "/",
        dataset,
        F.concat(F.lit("year="), F.date_format(at, "yyyy")),
        F.concat(F.lit("month="), F.date_format(at, "MM")),
        F.concat(F.lit("day="), F.date_format(at, "dd")),
        job,
        file_name,
    )
