"""Top keys over many lists without summing every key: equal to the full sum, whatever the split."""

import random
from collections import Counter

import pytest

from hitledger.operators.topk import list_candidates, top_of_lists

SCHEMA = "grp string, day int, source string, key string, count bigint"


def full(rows, n):
    totals = Counter()
    for grp, _, _, key, count in rows:
        totals[grp, key] += count
    found = []
    for grp in {g for g, _ in totals}:
        ranked = sorted(((k, c) for (g, k), c in totals.items() if g == grp), key=lambda x: (-x[1], x[0]))
        found += [(grp, k, c) for k, c in ranked[:n]]
    return sorted(found)


def just_below():
    """Keys that lead no list but win by their sum, beside ones that lead a single list."""
    rows = [("g", d, "s", f"steady{k}", 50) for d in range(20) for k in range(3)]
    return rows + [("g", d, "s", f"burst{d}-{k}", 60 + k) for d in range(20) for k in range(5)]


def ties():
    return [("g", d, "s", f"k{k}", 5) for d in range(6) for k in range(12)]


def one_list_each():
    return [("g", k, "s", f"k{k}", 100 + k % 3) for k in range(40)]


def mixed(seed):
    draw = random.Random(seed)
    cells = {(g, d, s, f"k{int(draw.paretovariate(0.6)) % 60}") for g in ("a", "b") for d in range(8) for s in "xyz" for _ in range(25)}
    return [(*c, draw.choice((0, 1, 1, 2, 9, 80))) for c in sorted(cells)]


@pytest.mark.parametrize("n", [1, 4])
@pytest.mark.parametrize("rows", [just_below(), ties(), one_list_each(), mixed(1), mixed(2), [("g", 1, "s", "k", 0)], []],
                         ids=["below", "ties", "apart", "mixed1", "mixed2", "zero", "empty"])
def test_equal_to_the_full_sum(spark, rows, n):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in top_of_lists(frame, ["grp"], ["day", "source"], "key", "count", n).collect()) == full(rows, n)


def test_without_groups_with_nulls_and_clashing_names(spark):
    rows = just_below() + [(None, 3, "t", "steady0", 7), ("g", 3, None, "steady1", 9), ("g", 4, "t", None, 999), ("g", 5, "t", "x", None)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", n int, _sum int")
    found = top_of_lists(frame, [], ["day", "source"], "key", "count", 2)
    assert found.columns == ["key", "n"] and sorted(tuple(r) for r in found.collect()) == [("steady0", 1007), ("steady1", 1009)]


def test_few_keys_are_summed(spark):
    """On Zipf counts over 60 lists less than a hundredth of the keys remain to be summed."""
    lists = spark.range(60 * 5000).selectExpr("'g' AS grp", "CAST(id % 60 AS int) AS day", "'s' AS source", "concat('k', id div 60) AS key",
                                              "CAST(100000 / (1 + id div 60) + id % 7 AS bigint) AS count")
    remaining = list_candidates(lists, ["grp"], ["day", "source"], "key", "count", 10).count()
    assert 10 <= remaining <= 50
