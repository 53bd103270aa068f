"""URL verdicts: host and path rules first, then the ratio of two character language models.

The rules mark URLs as accepted or rejected. Over all URLs they mark, every symbol is counted after its contexts of up to
five unfolded characters, and two variable-order Markov models are smoothed from the counts: a context seen ``min_seen``
times is used, a rarer one backs off to the next shorter. The counts are a table that grows with the input; longer grams
are named by their suffixes, so each level is one join in which a key meets an alphabet of rows at most. A URL that no
rule decides is judged by its mean log-likelihood difference less a cut: the middle of the steps with the fewest errors,
averaged over both classes, on a fifth of the marked URLs that the models do not see.

Grams and URLs that many rows share are broadcast, 4,096 at most since each has more than a 4,096th of the rows; the others
are joined by a shuffle. Everything is DataFrame functions.

Null URLs and URLs without ``://`` have empty host and path and no rule. Null and empty URLs score 0 and are allowed,
as is everything when no URL is marked. Repeated rows are judged alike; input columns named like outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from chronocohort.llm.carried import packed, unpacked
from chronocohort.llm.components import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"
ORDER = 6
HEAVY = 4096
STEPS = 1024


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path, such as ``example.com/de/``; it covers all subdomains."""

    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, or null. Rules are a short list given by the caller."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, rule.text).otherwise(found)
    return found


def with_grams(rows: DataFrame, url: str = "url") -> DataFrame:
    """One row per symbol of a URL and its end: ``gram``, the symbol after the five before it."""
    symbols = F.concat(
        F.array_repeat(F.lit(START), ORDER - 1), F.filter(F.split(F.col(url), ""), lambda c: c != ""), F.array(F.lit(END))
    )
    # Two steps: inside the lambda the symbols would be made again for every place.
    ready = rows.withColumn("symbols", symbols)
    places = F.sequence(F.lit(0), F.size("symbols") - ORDER)
    grams = F.transform(places, lambda i: F.concat(*(F.get("symbols", i + k) for k in range(ORDER))))
    return ready.select(*rows.columns, F.explode(grams).alias("gram"))


def log_ratios(counts: DataFrame, strength: float, min_seen: int) -> DataFrame:
    """From (gram, n_allow, n_block) to (gram, ratio): ln P(last symbol | context, accepted) less that for rejected."""
    kinds = ("allow", "block")
    levels = [counts.select("gram", "n_allow", "n_block")]
    for size in range(ORDER - 1, 0, -1):
        shorter = F.substring("gram", 2, size).alias("gram")
        levels.insert(0, levels[0].groupBy(shorter).agg(*(F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds)))
    whole = levels[0].select(F.struct(F.count("*").alias("size"), *(F.sum(f"n_{k}").alias(k) for k in kinds))).scalar()
    model = levels[0].select("gram", *(((F.col(f"n_{k}") + 1) / (whole[k] + whole["size"] + 1)).alias(f"p_{k}") for k in kinds))
    for size, level in enumerate(levels[1:], 2):
        context = W.partitionBy(F.substring("gram", 1, size - 1))
        seen = level.select(
            "gram", "n_allow", "n_block", F.substring("gram", 2, size - 1).alias("rest"), *(F.sum(f"n_{k}").over(context).alias(f"all_{k}") for k in kinds)
        )
        enough = F.col("all_allow") + F.col("all_block") >= min_seen

        def smoothed(k: str) -> Column:
            mixed = (F.col(f"n_{k}") + strength * F.col(f"p_{k}")) / (F.col(f"all_{k}") + strength)
            return F.when(enough, mixed).otherwise(F.col(f"p_{k}")).alias(f"p_{k}")

        model = seen.join(model.withColumnRenamed("gram", "rest"), "rest").select("gram", *(smoothed(k) for k in kinds))
    return model.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def meet(rows: DataFrame, side: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join on ``key``; ``side`` has one row per key with the number ``n`` of its rows, heavy keys are broadcast."""
    least = side.agg(F.coalesce(F.sum(n), F.lit(0)) / HEAVY).scalar()
    heavy = F.broadcast(side.where(F.col(n) > least).drop(n))
    common = rows.join(heavy, key)
    others = rows.join(heavy.select(key), key, "left_anti").join(side.where(F.col(n) <= least).drop(n), key)
    return common.unionByName(others)


def cut_of(held: DataFrame) -> Column:
    """Scalar: the middle of the cuts with the smallest mean error rate of both classes; 0 if one class is absent."""
    ends = held.select(F.struct(F.min("s").alias("low"), F.max("s").alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    step = F.when(high > low, F.floor((F.col("s") - low) / (high - low) * STEPS)).otherwise(0)
    bins = held.groupBy(step.cast("int").alias("step")).agg(
        F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("b")
    )
    # At most STEPS + 1 rows from here on.
    before, whole = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    rates = bins.select(
        "step", F.lag("step").over(W.orderBy("step")).alias("last"),
        (F.coalesce(F.sum("a").over(before), F.lit(0)) / F.nullif(F.sum("a").over(whole), F.lit(0))).alias("lost"),
        (1 - F.coalesce(F.sum("b").over(before), F.lit(0)) / F.nullif(F.sum("b").over(whole), F.lit(0))).alias("passed"),
    )
    # A cut anywhere between two filled steps has the same errors: take the middle of that gap.
    place = (F.coalesce(F.col("last") + 1, F.col("step")) + F.col("step")) / 2 / STEPS
    cut = low + place * (high - low)
    best = rates.where("lost is not null and passed is not null").agg(F.min_by(cut, F.struct(F.round(F.col("lost") + F.col("passed"), 12), "step")).alias("cut"))
    return best.select(F.coalesce("cut", F.lit(0.0))).scalar()


def url_scores(known: DataFrame, strength: float, min_seen: int) -> DataFrame:
    """From (url, accepted or null) rows to one row per non-empty URL: id, n (its rows) and score, calibrated."""
    named = known.where("url <> ''").select(F.unhex(F.sha2("url", 256)).alias("id"), "url", "accepted")
    held = F.col("accepted").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(5)) == 0)
    urls = named.groupBy("id", "url", "accepted").agg(F.count("*").alias("n")).withColumn("held", held)
    urls = stored(urls, "urls")
    weight = lambda c: F.sum(F.when(c & ~F.col("held"), F.col("n")).otherwise(0))
    counts = with_grams(urls).groupBy("gram").agg(
        F.count("*").alias("n"), weight(F.col("accepted")).alias("n_allow"), weight(~F.col("accepted")).alias("n_block")
    )
    counts = stored(counts, "grams")
    ratios = stored(log_ratios(counts, strength, min_seen).join(counts.select("gram", "n"), "gram"), "ratios")
    places = with_grams(urls.select("id", "url")).drop("url")
    means = meet(places, ratios, "gram", "n").groupBy("id").agg(F.avg("ratio").alias("s"))
    scored = stored(urls.select("id", "accepted", "held", "n").join(means, "id"), "scores")
    return scored.select("id", "n", (F.col("s") - cut_of(scored.where("held"))).alias("score"))


def judge(df: DataFrame, rules: list[Rule], url: str = "url", strength: float = 2.0, min_seen: int = 4) -> DataFrame:
    """Add host, path, rule, score (calibrated difference, above 0 for accepted) and verdict (allow or block)."""
    outputs = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in df.columns if c.lower() not in outputs]
    source = F.col(f"`{url}`")
    allows = [r.text for r in rules if r.allow]
    host, path = F.coalesce(host_of(source), F.lit("")), F.coalesce(path_of(source), F.lit(""))
    known = df.select(packed(kept), host.alias("host"), path.alias("path"), source.alias("url"))
    known = known.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    scores = url_scores(known.select("url", F.col("rule").isin(allows).alias("accepted")), strength, min_seen)
    full, bare = known.where("url <> ''"), known.where("url is null or url = ''")
    scored = meet(full.withColumn("id", F.unhex(F.sha2("url", 256))), scores, "id", "n").drop("id")
    scored = scored.unionByName(bare.withColumn("score", F.lit(0.0)))
    decided = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(allows), "allow").otherwise("block"))
    verdict = F.coalesce(decided, F.when(F.col("score") >= 0, "allow").otherwise("block"))
    return scored.select(*unpacked(kept), "host", "path", "rule", "score", verdict.alias("verdict"))
