"""URL filter: list rules where they fit, gradient-boosted trees on lexical features elsewhere.

The URLs that a rule decides are the labelled ones. The trees (Spark's) learn from them what blocked URLs look like: lengths, depth,
digit ratio, entropy, parameters, and how often other domains under the same suffix are blocked. A URL never sees its own domain's
labels in that rate, neither when the trees are fitted nor when it is judged: a suffix with one labelled domain tells nothing, and
the trees have to judge its URLs by their form. No Python runs over the pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from hitledger.llm.common import written

SAMPLE = 20_000
SMOOTHING = 5.0  # domains of the prior rate that every suffix has besides its own
LEXICAL = ("url_length", "host_length", "path_length", "labels", "depth", "hyphens", "digit_ratio", "entropy", "parameters", "has_fragment")


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path ("example.com/de/"); it fits the host and its subdomains where the path begins with the rule's."""
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host (A-Z lower-cased) and path of url; both empty for a null url or one without "://"."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": F.coalesce(lower, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def decided(rules: list[Rule]) -> Column:
    """The longest rule that fits host and path, as struct(text, verdict), or null. Rules are few (a list in the plan)."""
    fits = [F.when(((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path)),
                   F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<text:string,verdict:string>")


def with_features(pages: DataFrame) -> DataFrame:
    """``pages`` (with host and path) with the lexical features, the host's suffix and its domain (the suffix and the label before)."""
    url = F.coalesce("url", F.lit(""))
    letters = F.filter(F.split(url, ""), lambda c: c != "")
    size = F.greatest(F.length(url), F.lit(1))
    shares = F.transform(F.array_distinct(letters), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.withColumns({
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "labels": F.size(F.split("host", r"\.")), "depth": F.regexp_count("path", F.lit("/")), "hyphens": F.regexp_count("host", F.lit("-")),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / size,
        "entropy": F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)),
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})


@dataclass(frozen=True)
class Filter:
    """``trees`` None: labels of one kind only, whose verdict (or "allow") every other URL gets."""
    rules: list[Rule]
    verdict: str
    trees: GBTClassificationModel | None
    domains: DataFrame | None
    prior: float


def _with_suffix_rates(pages: DataFrame, domains: DataFrame, prior: float) -> DataFrame:
    """``pages`` with the features' vector. ``domains``: (domain, suffix, rate) of every labelled domain, each counting once."""
    suffixes = domains.groupBy("suffix").agg(F.sum("rate").alias("_sum"), F.count("*").alias("_domains"))
    own = domains.select("domain", F.col("rate").alias("_own"))
    known = pages.join(suffixes, "suffix", "left").join(own, "domain", "left")
    others = F.coalesce("_domains", F.lit(0)) - F.col("_own").isNotNull().cast("int")
    blocked = F.coalesce("_sum", F.lit(0.0)) - F.coalesce("_own", F.lit(0.0))
    rated = known.withColumns({"suffix_rate": (blocked + SMOOTHING * prior) / (others + SMOOTHING), "suffix_seen": F.log1p(others.cast("double"))})
    return VectorAssembler(inputCols=[*LEXICAL, "suffix_rate", "suffix_seen"], outputCol="features").transform(rated)


def _labelled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    return with_features(with_parts(pages).withColumn("_rule", decided(rules)).filter("_rule IS NOT NULL")).withColumn(
        "label", (F.col("_rule.verdict") == "block").cast("double"))


def train(pages: DataFrame, rules: list[Rule], sample: int = SAMPLE, seed: int = 42) -> Filter:
    """Trees fitted on at most ``sample`` different URLs that rules decide, drawn by a hash of the URL; suffix statistics cover all."""
    labelled = _labelled(pages.select("url"), rules)
    count = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    n, blocked = count["n"], count["blocked"] or 0.0
    if not 0 < blocked < n:
        return Filter(rules, "block" if n and blocked else "allow", None, None, 0.0)
    domains = written(labelled.groupBy("suffix", "domain").agg(F.avg("label").alias("rate")), "domains")
    prior = domains.agg(F.avg("rate")).first()[0]
    drawn = labelled.dropDuplicates(["url"]).withColumn("_order", F.xxhash64(F.lit(seed), "url")).orderBy("_order", "url").limit(sample)
    trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, maxBins=32, seed=seed, cacheNodeIds=False, checkpointInterval=-1)
    return Filter(rules, "allow", trees.fit(_with_suffix_rates(drawn, domains, prior).select("label", "features")), domains, prior)


def judge(pages: DataFrame, found: Filter) -> DataFrame:
    """page_id, url, host, path, rule (text of the longest that fits, else null), block_score (of the trees; null where there is a
    rule or no trees) and verdict. Of ``pages`` only page_id and url are read.

    A null or odd URL has empty host and path, fits no rule and is judged by the trees like others. Rows that repeat an id are
    judged each; an empty table gives an empty result.
    """
    parts = with_parts(pages.select("page_id", "url")).withColumn("_rule", decided(found.rules))
    by_rule = [F.col("_rule.text").alias("rule")]
    if found.trees is None:
        return parts.select("*", *by_rule, F.lit(None).cast("double").alias("block_score"),
                            F.coalesce("_rule.verdict", F.lit(found.verdict)).alias("verdict")).drop("_rule")
    scored = found.trees.transform(_with_suffix_rates(with_features(parts), found.domains, found.prior))
    score = F.when(F.col("_rule").isNull(), vector_to_array("probability")[1])
    verdict = F.coalesce("_rule.verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("block_score", score).select(*parts.columns, *by_rule, "block_score", verdict.alias("verdict")).drop("_rule")
