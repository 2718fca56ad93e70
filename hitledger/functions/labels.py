"""Report labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hitledger import fixed_values as fixed


def hour_label(hour: Column) -> Column:
    return F.concat(F.substring(hour.cast("string"), 1, 13), F.lit(":00"))


def month_label(day: Column) -> Column:
    return F.substring(day.cast("string"), 1, 7)


def _places(number: Column, places: int) -> Column:
    """Fixed-point text, exact halves to even, without thousands separators."""
    return F.replace(F.format_number(number, places), F.lit(","), F.lit(""))


def byte_label(size: Column) -> Column:
    """Decimal units with two places from one thousand on, plain bytes below."""
    size = F.coalesce(size, F.lit(0)).cast("bigint")
    label = F.concat(size.cast("string"), F.lit(" B"))
    for unit, factor in (("KB", 1e3), ("MB", 1e6), ("GB", 1e9), ("TB", 1e12)):
        label = F.when(size >= factor, F.concat(_places(size / F.lit(factor), 2), F.lit(f" {unit}"))).otherwise(label)
    return label


def response_time_label(microseconds: Column) -> Column:
    """Milliseconds with one place; ``N/A`` without samples or at zero."""
    known = F.nullif(microseconds, F.lit(0))
    return F.coalesce(F.concat(_places(known / F.lit(1000.0), 1), F.lit(" ms")), F.lit("N/A"))


def category_label(category: Column) -> Column:
    pairs = [F.lit(x) for pair in fixed.CATEGORY_LABELS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), category), category)


def mean_floor(total: Column, samples: Column) -> Column:
    """Whole-number mean rounded down, null without samples."""
    return F.when(samples > 0, F.call_function("div", total, samples))


def share_pct(part: Column, total: Column) -> Column:
    """Percentage to two places, 0.0 of an empty total."""
    hundredths = F.round(part.cast("double") * 100.0 / total.cast("double") * 100.0)
    return F.when(total > 0, hundredths / 100.0).otherwise(F.lit(0.0))
