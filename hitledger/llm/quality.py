"""Quality rules whose cutoffs are chosen on labelled documents under an exact bound on false rejections.

Every rule turns a document into a level from 0 (unsuspicious) to LEVELS - 1 and rejects from a cutoff level on. For each
stratum and rule the cutoffs are tested from the laxest to the strictest. A cutoff is certified while the exact binomial
bound says that it rejects at most ``risk / rules`` of the good documents, at level ``error / (rules * strata)``; testing
stops at the first failure, so the whole family of tests errs with probability ``error`` at most. Of the certified cutoffs the
one that rejects the most bad documents is used, good ones weighing ``GOOD_WEIGHT`` times as much. A stratum with too few
labels gets no cutoffs and keeps everything that passes the base rules.

Statistics and verdicts are DataFrame expressions over whole texts. Only level counts (strata x rules x LEVELS numbers) are
read by the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from hitledger.llm.common import let, text_or_empty, words, written

# Fixed values of the base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = r"[#*$%&|<>]"

LEVELS = 50
GOOD_WEIGHT = 20
RULES = ("symbols", "repeats", "dup_lines", "capitals", "long_words", "short_words")


@dataclass(frozen=True)
class Cutoffs:
    """Lowest rejected level by (stratum, rule); a missing entry rejects nothing."""
    stratum: str
    levels: dict[tuple[str | None, str], int] = field(default_factory=dict)


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur at least twice in the array, first occurrences included.

    Windows are compared as strings of their words, so the count is exact. Arrays without a repeated window take one pass.
    """
    windows = F.when(F.size(tokens) < window, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (window - 1)), lambda i: F.array_join(F.slice(tokens, i, window), " ")))

    def covered(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        twice = let(placed, lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (
            F.coalesce(F.try_element_at(s, k + 2)["w"] == x["w"], F.lit(False))
            | F.when(k > 0, F.try_element_at(s, F.greatest(k, F.lit(1)))["w"] == x["w"]).otherwise(False)).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"])))
        return F.aggregate(twice, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, i: F.struct(
            (acc["n"] + i + window - F.greatest(acc["end"], i)).alias("n"), (i + window).alias("end")), lambda acc: acc["n"])

    return let(windows, lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), covered(found)).otherwise(0))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals (all long) and base_failed.

    A null or empty text has zero of everything and fails the base rules. Columns of ``docs`` with these names are replaced.
    """
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(" \t\x0b\f\r")) != "")
    whole = docs.withColumn("_words", words(text)).withColumn("_lines", lines)
    counted = whole.withColumns({
        "n_words": F.size("_words"), "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated_words(F.col("_words")), "n_lines": F.size("_lines"),
        "n_capitals": F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))}).drop("_words", "_lines")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
    counted = counted.withColumns({name: F.col(name).cast("long") for name in names})
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _level(rule: str) -> Column:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = {"symbols": F.col("n_symbols") / n, "repeats": F.col("n_repeat_words") / n,
             "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "capitals": F.col("n_capitals") / chars,
             "long_words": (F.col("word_chars") / n - 4) / 16, "short_words": (8 - F.col("word_chars") / n) / 8}[rule]
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor(share * LEVELS))).cast("int")


def within_risk(rejected: int, good: int, risk: float, error: float) -> bool:
    """Whether ``rejected`` of ``good`` documents prove, at level ``error``, that at most a share ``risk`` is rejected.

    Exact: P(Binomial(good, risk) <= rejected) <= error, the test that the Clopper-Pearson bound inverts. The terms are summed
    from the largest down and left off where they no longer change the sum.
    """
    if rejected >= good * risk:
        return False
    log_term = (math.lgamma(good + 1) - math.lgamma(rejected + 1) - math.lgamma(good - rejected + 1)
                + rejected * math.log(risk) + (good - rejected) * math.log1p(-risk))
    total, term, k = 0.0, 1.0, rejected
    while k >= 0 and term > 1e-17:
        total += term
        term *= k * (1 - risk) / ((good - k + 1) * risk)
        k -= 1
    return log_term + math.log(total) <= math.log(error)


def choose_cutoffs(counts: dict[tuple[str | None, str], list[tuple[int, int]]], risk: float, error: float) -> dict:
    """Cutoffs by (stratum, rule) from the numbers of (good, bad) documents at every level."""
    chosen = {}
    for key, levels in counts.items():
        good, bad = (sum(x[i] for x in levels) for i in (0, 1))
        best, lost, caught = 0.0, 0, 0
        for level in range(len(levels) - 1, 0, -1):
            lost, caught = lost + levels[level][0], caught + levels[level][1]
            if not within_risk(lost, good, risk / len(RULES), error / len(counts)):
                break
            gain = caught / max(bad, 1) - GOOD_WEIGHT * lost / good
            if gain > best:
                best, chosen[key] = gain, level
    return chosen


def calibrate(statistics: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.06, error: float = 0.05) -> Cutoffs:
    """Cutoffs from the labelled documents that pass the base rules: ``labels`` has doc_id and quality (1 good, 0 bad).

    Labels that are null or of documents that ``statistics`` does not hold count for nothing; of several labels of a document
    each counts. The number of strata must be modest (languages, not sites), as the driver reads their level counts.
    """
    marked = labels.filter("quality IN (0, 1)").select(F.col("doc_id").alias("_labelled"), "quality")
    known = statistics.filter("NOT base_failed").join(marked, F.col("doc_id") == F.col("_labelled"))
    levels = known.select(F.col(stratum).alias("stratum"), "quality", F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), _level(rule).alias("level")) for rule in RULES])).alias("at"))
    counts: dict = {}
    for row in levels.groupBy("stratum", "at", "quality").count().collect():
        of_rule = counts.setdefault((row["stratum"], row["at"]["rule"]), [(0, 0)] * LEVELS)
        good, bad = of_rule[row["at"]["level"]]
        of_rule[row["at"]["level"]] = (good + row["count"], bad) if row["quality"] else (good, bad + row["count"])
    return Cutoffs(stratum, choose_cutoffs(counts, risk, error))


def with_verdict(statistics: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """``statistics`` with kept: false where the base rules fail or a rule's level reaches the cutoff of the stratum."""
    rejected = F.col("base_failed")
    for (stratum, rule), level in sorted(cutoffs.levels.items(), key=repr):
        rejected = rejected | (F.col(cutoffs.stratum).eqNullSafe(F.lit(stratum)) & (_level(rule) >= level))
    return statistics.withColumn("kept", ~rejected)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Texts are measured once, into a table in the shared folder."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", stratum)
    measured = written(with_statistics(rows).drop("text"), "measured")
    return with_verdict(measured, calibrate(measured, labels, stratum)).filter("kept").select("row.*")
