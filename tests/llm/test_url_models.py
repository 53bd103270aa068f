"""The variable-order URL models against the same models in plain Python."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronocohort.llm import url_models as U
from chronocohort.llm.queries import URL_RULES


def grams_of(url):
    symbols = [U.START] * (U.ORDER - 1) + list(url) + [U.END]
    return ["".join(symbols[i : i + U.ORDER]) for i in range(len(symbols) - U.ORDER + 1)]


def plain_ratios(urls, strength, min_seen):
    """From (url, accepted or None, held) to the ratio of every gram of every URL."""
    asked = {g for u, _, _ in urls for g in grams_of(u)}
    alphabet = len({g[-1] for g in asked})
    logs = {}
    counts = {k: Counter(g[-n:] for u, a, held in urls if a is k and not held for g in grams_of(u) for n in range(1, U.ORDER + 1)) for k in (True, False)}
    totals = {k: Counter(g[-n:-1] for u, a, held in urls if a is k and not held for g in grams_of(u) for n in range(1, U.ORDER + 1)) for k in (True, False)}

    def p(k, gram):
        if len(gram) == 1:
            return (counts[k][gram] + 1) / (totals[k][""] + alphabet + 1)
        rest, context = p(k, gram[1:]), gram[:-1]
        if totals[True][context] + totals[False][context] < min_seen:
            return rest
        return (counts[k][gram] + strength * rest) / (totals[k][context] + strength)

    for gram in asked:
        logs[gram] = math.log(p(True, gram)) - math.log(p(False, gram))
    return logs


URLS = (
    [(f"http://{'shop' if i % 2 else 'read'}{i % 7}.org/é/{i}", bool(i % 3), i % 5 == 0) for i in range(120)]
    + [("https://hot.example/漢字", True, False)] * 300
    + [(f"http://new{i}.com/x?y=😀", None, False) for i in range(30)]
)


@pytest.mark.parametrize("min_seen", [1, 4, 1000])
def test_ratios_equal_plain_python(spark, min_seen):
    df = spark.createDataFrame(URLS, "url string, accepted boolean, held boolean").repartition(5)
    weight = lambda c: F.sum(F.when(c & ~F.col("held"), 1).otherwise(0))
    counts = U.with_grams(df).groupBy("gram").agg(weight(F.col("accepted")).alias("n_allow"), weight(~F.col("accepted")).alias("n_block"))
    got = {r["gram"]: r["ratio"] for r in U.log_ratios(counts, 2.0, min_seen).collect()}
    want = plain_ratios(URLS, 2.0, min_seen)
    assert got.keys() == want.keys()
    assert all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_scores_are_means_of_ratios(spark):
    rows = [(i, u) for i, (u, _, _) in enumerate(URLS)]
    rules = [U.Rule("org/", True), U.Rule("example/", False)]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    urls = sorted({u for u, _, _ in URLS})
    held = {r["url"] for r in spark.createDataFrame([(u,) for u in urls], "url string").where("pmod(xxhash64(url), 5) = 0").collect()}
    side = lambda u: True if ".org/" in u else False if ".example/" in u else None
    want = plain_ratios([(u, side(u), u in held and side(u) is not None) for u, _, _ in URLS], 2.0, 4)
    means = {u: sum(want[g] for g in grams_of(u)) / len(grams_of(u)) for u in urls}
    cuts = [means[dict(rows)[r["page_id"]]] - r["score"] for r in got]
    assert len(got) == len(rows) and max(cuts) - min(cuts) < 1e-9


def test_cut_has_the_fewest_errors(spark):
    held = [(0.0, False, 5), (0.1, False, 5), (0.6, False, 1), (0.5, True, 1), (0.9, True, 8), (1.0, True, 2)]
    df = spark.createDataFrame(held, "s double, accepted boolean, n long")
    cut = spark.range(1).select(U.cut_of(df)).first()[0]
    error = lambda c: sum(n for s, a, n in held if a and s < c) / 11 + sum(n for s, a, n in held if not a and s >= c) / 11
    assert error(cut) == min(error(c / 1000) for c in range(1001))
    assert spark.range(1).select(U.cut_of(df.where("accepted"))).first()[0] == 0
    assert spark.range(1).select(U.cut_of(df.limit(0))).first()[0] == 0


def test_contexts_longer_than_three_and_digits_tell_apart(spark):
    # Alike but for a digit five symbols before the place that differs.
    marked = [(i, f"http://w{i}.{'net' if i % 2 else 'org/fr'}/{7 if i % 2 else 3}aaaa{'x' if i % 2 else 'y'}") for i in range(300)]
    new = [(1000 + i, f"http://v{i}.com/{7 if i % 2 else 3}aaaa{'x' if i % 2 else 'y'}") for i in range(40)]
    got = U.judge(spark.createDataFrame(marked + new, "page_id long, url string"), URL_RULES).where("page_id >= 1000").collect()
    assert all((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got)


def test_meet_keeps_rows_of_heavy_and_other_keys(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    side = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    met = U.meet(rows, side, "k", "n")
    assert met.columns == ["k", "v"] and met.count() == 20000 and met.where("v <> 2 * k").count() == 0
