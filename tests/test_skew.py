"""Results must not change when keys are split: every operator with a tiny group limit."""

import random

import pytest
from pyspark.sql import functions as F

from chronocohort.functions.timefn import hours
from chronocohort.operators import aggregates as A, cohort as C, intervals as I, ordered, reshape as R, skew, sampling as P, windows as W
from chronocohort.operators.evaluate import curve_points
from chronocohort.operators.ordered import KeyedOrder
from chronocohort.operators.skew import GroupSizes, hot_keys, key_join
from chronocohort.queries.windows_q import states
from chronocohort.sources import io


def rows(df):
    return sorted([tuple(r) for r in df.select(*sorted(df.columns)).collect()], key=str)


@pytest.fixture(scope="module")
def skewed(events):
    """One user holds about a third of the rows, and every second time stamp is shared."""
    ts = F.when(F.col("event_id") % 2 == 0, F.date_trunc("day", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    user = F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id"))
    return events.select("event_id", user.cast("bigint").alias("user_id"), ts.alias("ts"), "value", "event_type").cache()


@pytest.mark.parametrize("fn", ["sum", "count", "min", "max"])
@pytest.mark.parametrize("peers", [True, False])
def test_running(skewed, fn, peers):
    order = ["ts"] if peers else ["ts", "event_id"]
    cents = F.rint(F.col("value") * 100).cast("bigint")
    plain = KeyedOrder(skewed, ["user_id"], order, split=False).running(fn, cents, "x", peers).rows()
    split = KeyedOrder(skewed, ["user_id"], order, max_group=5)
    assert split.split
    assert rows(split.running(fn, cents, "x", peers).rows()) == rows(plain)


def test_ranks_and_previous(skewed):
    def all_three(**sizing):
        ordered = KeyedOrder(skewed, ["user_id"], ["ts", "event_id"], **sizing)
        return ordered.row_number("n").previous(F.col("value"), "before").rows()

    assert rows(all_three(max_group=5)) == rows(all_three(split=False))
    dense = [KeyedOrder(skewed, ["user_id"], ["ts"], **s).dense_rank("r").rows() for s in ({"max_group": 5}, {"split": False})]
    assert rows(dense[0]) == rows(dense[1])


def test_previous_keeps_nulls_apart(skewed):
    value = F.when(F.col("event_type") != "view", F.col("value"))
    got = [KeyedOrder(skewed, ["user_id"], ["ts", "event_id"], **s).previous(value, "p").rows() for s in ({"max_group": 3}, {"split": False})]
    assert rows(got[0]) == rows(got[1])


def test_null_keys_are_a_group(skewed):
    holed = skewed.withColumn("user_id", F.when(F.col("user_id") != 7, F.col("user_id")))
    got = [KeyedOrder(holed, ["user_id"], ["ts", "event_id"], **s).row_number("n").rows() for s in ({"max_group": 3}, {"split": False})]
    assert rows(got[0]) == rows(got[1])


def test_descending_running(skewed):
    s = skewed.withColumn("y", (F.col("event_id") % 2).cast("int"))
    got = [curve_points(s, "y", "value", "y", **z) for z in ({"max_group": 4}, {"split": False})]
    assert rows(got[0]) == rows(got[1])


def test_global_rank_is_gapless(skewed):
    ranked = KeyedOrder(skewed, [], ["value", "event_id"]).row_number("n").rows().orderBy("n").collect()
    assert [r["n"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert [(r["value"], r["event_id"]) for r in ranked] == sorted((r["value"], r["event_id"]) for r in ranked)


def test_key_join(skewed):
    index = skewed.groupBy("user_id").agg(F.min("ts").alias("t0"))
    near = F.col("ts") <= F.col("t0") + hours(200)
    hot = hot_keys(skewed, "user_id", 100)
    assert hot == {7: skewed.where("user_id = 7").count()}
    every = hot_keys(skewed, "user_id", 1)
    assert len(every) == skewed.groupBy("user_id").count().where("count > 1").count()
    withheld = skewed.withColumn("user_id", F.when(F.col("user_id") == 7, None).otherwise(F.col("user_id")))
    assert GroupSizes(withheld, 100).split("user_id") and key_join(withheld, skewed.select("user_id").distinct(), "user_id", how="left", max_group=100).count() == skewed.count()
    for how in ("inner", "left", "left_semi", "left_anti"):
        condition = near if how != "left_semi" else None
        salted = key_join(skewed, index, "user_id", condition, how, hot=hot, max_group=100)
        plain = key_join(skewed, index, "user_id", condition, how, hot={})
        assert rows(salted) == rows(plain)
        assert rows(key_join(skewed, index, "user_id", condition, how, max_group=1)) == rows(plain)
        by_table = key_join(skewed, index, "user_id", condition, how, max_group=1, max_listed=0)
        assert "_salt" not in "".join(by_table.columns) and rows(by_table) == rows(plain)


def test_many_hot_keys_are_a_table(spark):
    """10,000 hot keys and a null one: no list in the plan, and every row once."""
    events = spark.range(60_000).select(F.when(F.col("id") % 6 < 5, F.col("id") % 10_000).alias("k"), F.col("id").alias("v"))
    index = spark.range(0, 10_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("t0"))
    assert not isinstance(skew.heavy_keys(events, "k", 2), dict) and skew.GroupSizes(events, 2).split("k")
    for how, n in (("left", 60_000), ("left_anti", events.join(index, "k", "left_anti").count())):
        joined = key_join(events, index, "k", how=how, max_group=2)
        assert joined.count() == n and joined.select("v").distinct().count() == n
        assert "map(" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert rows(key_join(events, index, "k", max_group=2)) == rows(events.join(index, "k"))


def test_rates_and_horizons_of_hot_keys(skewed):
    onsets = skewed.groupBy("user_id").agg(F.lit(30.0).alias("onset"))
    long = skewed.select("user_id", "event_id", F.col("value").alias("t"))
    split = R.horizon_expand(long, onsets, "user_id", "t", "onset", 6, hot=hot_keys(long, "user_id", 100))
    assert rows(split) == rows(R.horizon_expand(long, onsets, "user_id", "t", "onset", 6, hot={}))
    weights = [skewed.where("user_id % 2 = 1").groupBy("user_id").agg(F.avg("value").alias("weight"))]
    rate = lambda hot: A.weighted_rate(skewed, weights, "user_id", ["user_id", "event_type"], "event_type", "value", {"r": (["view"], ["click"])}, hot)
    assert rows(rate({7: 50 * skew.MAX_GROUP_ROWS})) == rows(rate({}))
    with pytest.raises(ValueError):
        A.one_hot(skewed, ["user_id"], max_categories=3)


def test_time_operators(skewed):
    unique = skewed.dropDuplicates(["user_id", "ts"])
    purchases = unique.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    views = unique.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen"))
    spans = views.select("user_id", F.col("ts").alias("s"), (F.col("ts") + hours(9)).alias("f"))
    for build in (
        lambda **z: I.asof(purchases, views, "user_id", "ts", "ts", "seen", 24, "latest", **z),
        lambda **z: I.asof_two_sources(purchases, "value", views, "user_id", "ts", "ts", "seen", 24, "x", **z),
        lambda **z: I.point_in_interval(purchases, spans, "user_id", "ts", "s", "f", **z),
        lambda **z: W.previous_within(unique, "user_id", "ts", ["value"], 6, **z),
        lambda **z: W.running_rise(unique, "user_id", ["ts"], ["event_id"], **z),
        lambda **z: R.series_arrays(unique, "user_id", "ts", "event_id", "value", 8, **z),
    ):
        assert rows(build(max_group=4)) == rows(build(split=False))
    for build in (
        lambda **z: R.tail_n(unique, "user_id", ["ts", "event_id"], 9, **z),
        lambda **z: P.stratified(unique, "event_type", "event_id", 4, **z),
    ):
        assert rows(build(split=True)) == rows(build())


def test_earliest_on_sides_equals_the_pairs(skewed):
    treated = skewed.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("t")).distinct()
    sampled = skewed.where("event_type = 'view'").select(
        "user_id", F.when(F.col("value") >= 40, F.col("ts")).alias("clock"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    )
    args = ("user_id", "t", "clock", "day")
    first = {f"{s}_{k}": F.min(F.struct(f"{s}_time", f"{s}_kind"))[f"{s}_{k}"] for s in ("last", "next") for k in ("time", "kind")}
    pairs = I.two_sided_proximity(treated, sampled, *args).groupBy("user_id", "t").agg(*[c.alias(n) for n, c in first.items()])
    plain = I.earliest_on_sides(treated, sampled, *args, split=False)
    assert rows(plain) == rows(pairs)
    assert rows(I.earliest_on_sides(treated, sampled, *args, max_group=5)) == rows(plain)
    lost = treated.withColumn("user_id", F.lit(None).cast("bigint")), sampled.withColumn("user_id", F.lit(None).cast("bigint"))
    assert I.earliest_on_sides(*lost, *args).collect() == []
    assert I.earliest_on_sides(treated, sampled.limit(0), *args).collect() == []


def test_csv_index_and_table_from_itself(spark, skewed, tmp_path):
    path = io.write_csv(skewed.select("event_id", "value"), str(tmp_path / "csv"), index=["event_id"])
    got = io.read_csv(spark, path).orderBy("event_id").collect()
    assert [r[io.INDEX_ARTEFACT] for r in got] == list(range(skewed.count()))
    io.refresh_table(skewed.select("event_id"), "refreshed_once", str(tmp_path / "one"))
    again = io.refresh_table(spark.table("refreshed_once").where("event_id % 2 = 0"), "refreshed_once", str(tmp_path / "two"))
    assert again.count() == skewed.where("event_id % 2 = 0").count()
    spark.sql("DROP TABLE refreshed_once")


@pytest.mark.parametrize("level", [2, 256])
def test_only_large_keys_are_cut_and_only_bounds_are_stored(skewed, monkeypatch, level):
    kept = []
    for module in (ordered, skew):
        plain = module.durable
        monkeypatch.setattr(module, "durable", lambda df, plain=plain: kept.append(plain(df)) or kept[-1])
    monkeypatch.setattr(ordered, "LEVEL", level)
    n = skewed.where("user_id = 7").count()
    labels, split = ordered.labelled(skewed, ["user_id"], ["-ts"], 90, None)
    assert split and {r["user_id"] for r in labels.where(f"{ordered.RANGE} is not null").select("user_id").distinct().collect()} == {7}
    sizes = labels.where("user_id = 7").groupBy(ordered.RANGE).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy(ordered.RANGE).collect()
    assert n // 180 <= len(sizes) <= n // 45 and max(r["n"] for r in sizes) <= 180
    assert all(a["lo"] > b["hi"] for a, b in zip(sizes, sizes[1:]))
    assert [k.count() for k in kept] == [1, 1] and "value" not in str([k.schema for k in kept])


def test_six_minima_come_from_one_aggregation(skewed):
    wide = skewed.select("user_id", "ts", "event_id", *[(F.col("event_id") % k).alias(f"m{k}") for k in range(2, 8)])
    names = [f"m{k}" for k in range(2, 8)]
    got = W.running_rise(wide, "user_id", ["ts", "event_id"], names, max_group=9)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Window [") == 2
    assert rows(got) == rows(W.running_rise(wide, "user_id", ["ts", "event_id"], names, split=False))


def test_sessions_of_random_states_against_python(spark):
    rng = random.Random(4)
    data = [(k, i, rng.choice([0, 0, 1, 1, None]), rng.choice([0, 1]), rng.choice([0, 0, 0, 1, None])) for k in range(4) for i in range(rng.choice([3, 60, 400]))]
    at = {}
    data = [(k, i, on, off, end, at.setdefault((k, i), rng.randrange(900))) for k, i, on, off, end in data]
    df = spark.createDataFrame(data, "k int, i int, is_on int, is_off int, is_end int, m int")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    df = df.withColumn("t", start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("m") * 37))
    want = []
    for key in range(4):
        session, episodes, on_before, end_before = 0, {}, None, None
        own = sorted(((m, i, on, off, end) for k, i, on, off, end, m in data if k == key), key=lambda r: r[:2])
        for m, _, on, off, end in own:
            inside = on == 1 or end == 1
            if (inside and end_before == 1) or (on == 0 and off == 1) or (on == 1 and on_before is not None and (m - on_before) * 37 > 480):
                session += 1
            on_before = m if on == 1 else on_before
            end_before = end if inside else end_before
            episodes.setdefault(m, []).append((session, inside, on))
        # Rows of one time share the session of their last row.
        spans = {}
        for m, same in episodes.items():
            for _, inside, on in same:
                if inside:
                    lo, hi, any_on = spans.get(same[-1][0], (m, m, False))
                    spans[same[-1][0]] = (min(lo, m), max(hi, m), any_on or on == 1)
        kept = [spans[s] for s in sorted(spans) if spans[s][0] != spans[s][1] and spans[s][2]]
        want += [(key, n + 1, lo, hi) for n, (lo, hi, _) in enumerate(kept)]
    minutes = lambda c: (F.unix_seconds(F.col(c).cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / 60 / 37
    for sizing in ({"max_group": 6}, {"max_group": 40}, {"split": False}):
        got = W.sessionize(df, "k", "t", "is_on", "is_off", "is_end", 8, ["i"], **sizing)
        assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r[0], r[1], round(r[2]), round(r[3])) for r in got.select("k", "episode", minutes("start"), minutes("finish")).collect()) == sorted(want)


def test_sessions(spark):
    s = states(spark, "/root/testdata/sf0.001")
    hot = W.sessionize(s, "user_id", "ts", "is_on", "is_off", "is_end", 8, max_group=4)
    assert rows(hot) == rows(W.sessionize(s, "user_id", "ts", "is_on", "is_off", "is_end", 8, split=False))


def test_series_chunks_hold_everything(skewed):
    whole = R.series_arrays(skewed, "user_id", "ts", "event_id", "value")
    assert whole.count() == skewed.select("user_id").distinct().count()
    chunks = R.series_arrays(skewed, "user_id", "ts", "event_id", "value", 8)
    assert chunks.select(F.max(F.size("times"))).first()[0] == 8
    assert chunks.select(F.sum(F.size("times"))).first()[0] == skewed.count()


def test_balancing_with_split_classes(skewed):
    labelled = skewed.select("event_id", (F.col("user_id") == 7).cast("int").alias("y"))
    got = [P.oversample(labelled, "y", "event_id", **z) for z in ({"max_group": 4}, {"split": False})]
    assert rows(got[0]) == rows(got[1])
    sizes = {r["y"]: r["count"] for r in got[0].groupBy("y").count().collect()}
    assert sizes[0] == sizes[1]


def test_not_in_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for listed, kept in (([(1,)], [2]), ([(1,), (None,)], []), ([], [1, 2, None])):
        got = C.not_in(left, spark.createDataFrame(listed, "k int"), "k")
        assert sorted([r[0] for r in got.collect()], key=str) == sorted(kept, key=str)


def test_long_series_stay_whole(spark):
    long = spark.range(5000).select(F.lit(1).alias("e"), F.col("id").cast("double").alias("t"), (F.col("id") % 7).alias("v"), F.lit(1.5).alias("x"))
    series = R.series_arrays(long, "e", "t", "v", "x")
    row = R.feature_order(series, "e", "vars").first()
    assert len(row["times"]) == 5000 and sorted(row["ind_t"]) == list(range(5000)) and row["ind_k"] == sorted(row["vars"])
    assert R.pad_right(series, ["values"]).first()["values_len"] == 5000
