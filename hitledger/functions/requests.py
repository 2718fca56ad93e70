"""Fields of one request, as JVM-side column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from hitledger import fixed_values as fixed


def or_absent(text: Column) -> Column:
    """A missing or empty header reads as ``-``."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fixed.ABSENT))


def month_number(month: Column) -> Column:
    """1 to 12; unknown abbreviations count as January."""
    pairs = [F.lit(x) for i, name in enumerate(fixed.MONTHS, 1) for x in (name, i)]
    return F.coalesce(F.element_at(F.create_map(*pairs), month), F.lit(1))


def wall_clock(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Zone-less timestamp from the text parts of a log time; null when they make no valid time."""
    number = [x.try_cast("int") for x in (year, day, hour, minute, second)]
    ts = F.try_make_timestamp_ntz(number[0], month_number(month), number[1], number[2], number[3], number[4])
    return F.when(number[4] <= 59, ts)  # second 60 would roll over to the next minute


def start_of_hour(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))


def known_method(token: Column) -> Column:
    """Upper-cased method, null unless it is an HTTP method."""
    method = F.upper(token)
    return F.when(method.isin(*fixed.HTTP_METHODS), method)


def normal_path(target: Column) -> Column:
    """Target without its query and trailing slashes; the root is ``/``, an absent target is null."""
    bare = F.rtrim(F.substring_index(target, "?", 1), F.lit("/"))
    return F.when(target != "", F.coalesce(F.nullif(bare, F.lit("")), F.lit("/")))


def is_bot(user_agent: Column) -> Column:
    """Automated client: no user agent at all, or one with a known mark in it.

    Substring tests on the lower-cased text are several times faster than one case-insensitive alternation.
    """
    agent = F.lower(F.coalesce(user_agent, F.lit("")))
    marks = [F.contains(agent, F.lit(mark)) for mark in fixed.BOT_MARKS]
    return agent.isin("", fixed.ABSENT) | reduce(or_, marks) | agent.rlike(rf"{fixed.BOT_WORD_END}\b")


def category(bot: Column) -> Column:
    return F.when(bot, F.lit("bot")).otherwise(F.lit("human"))
