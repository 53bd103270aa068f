"""Join queries: equi, anti, interval, proximity, as-of, spine and matching joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronocohort.functions import timefn as T
from chronocohort.operators import aggregates as A, cohort as C, intervals as I, reshape as R, windows as W
from chronocohort.operators.skew import key_join
from chronocohort.queries.registry import FIRST_ERROR, cents, first_error, query, table


@query(
    "j_inner",
    """SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F'""",
)
def j_inner(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    n = table(spark, d, "nation").withColumnsRenamed({"n_nationkey": "c_nationkey", "n_regionkey": "r_regionkey"})
    joined = o.join(table(spark, d, "customer"), "c_custkey").join(n, "c_nationkey")
    return joined.join(table(spark, d, "region"), "r_regionkey").select("o_orderkey", "c_name", "n_name", "r_name")


@query(
    "j_left_first",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
       SELECT c_custkey, o_orderkey AS first_order, o_orderpriority AS first_priority
       FROM customer LEFT JOIN f ON c_custkey = o_custkey AND rn = 1""",
)
def j_left_first(spark, d):
    first = W.first_row(
        table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority"),
        ["o_custkey"], ["o_orderdate", "o_orderkey"],
    ).select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderkey").alias("first_order"),
        F.col("o_orderpriority").alias("first_priority"),
    )
    return table(spark, d, "customer").select("c_custkey").join(first, "c_custkey", "left")


@query(
    "j_semi",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
       WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%bolt%' AND p_size > 20)""",
)
def j_semi(spark, d):
    listed = table(spark, d, "part").where(F.col("p_name").contains("bolt") & (F.col("p_size") > 20))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return li.join(listed.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")


@query(
    "j_anti",
    """SELECT 'plain' AS kind, c_custkey FROM customer
         WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
       UNION ALL SELECT 'with null', c_custkey FROM customer WHERE c_custkey NOT IN
         (SELECT CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_custkey END FROM orders)
       UNION ALL SELECT 'left only', c_custkey FROM customer
         LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000) ON c_custkey = o_custkey
         WHERE o_custkey IS NULL""",
)
def j_anti(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    holed = o.select(F.when(F.col("o_totalprice") > 400000, None).otherwise(F.col("o_custkey")).alias("c_custkey"))
    big = o.where("o_orderstatus = 'F' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    parts = {
        "plain": C.not_in(c, urgent, "c_custkey"),
        "with null": C.not_in(c, holed, "c_custkey"),
        "left only": c.join(big, "c_custkey", "left_anti"),
    }
    tagged = [df.select(F.lit(k).alias("kind"), "c_custkey") for k, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query(
    "j_index_window",
    f"""WITH i AS ({FIRST_ERROR}) SELECT e.event_id, e.user_id, e.event_type, i.t0 FROM i JOIN events e ON e.user_id = i.user_id
        AND e.ts BETWEEN i.t0 - INTERVAL 48 HOUR AND i.t0 + INTERVAL 7 HOUR""",
)
def j_index_window(spark, d):
    ev = table(spark, d, "events")
    return I.around_index(
        ev.select("event_id", "user_id", "event_type", "ts"), first_error(ev), "user_id", "ts", "t0"
    ).drop("ts")


@query(
    "j_stay_window",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_orderdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       AND l_shipdate BETWEEN o_orderdate - INTERVAL 1 DAY AND o_orderdate + INTERVAL 90 DAY""",
)
def j_stay_window(spark, d):
    stays = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderdate",
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(90))).alias("discharge"),
    )
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"
    )
    return I.in_stay(li, stays, "l_orderkey", "l_shipdate", "o_orderdate", "discharge").drop("l_shipdate", "discharge")


TREATED = "SELECT user_id, ts AS t FROM events WHERE event_type = 'purchase'"
SAMPLED = """SELECT user_id, CASE WHEN value < 40 THEN NULL ELSE ts END AS clock, date_trunc('day', ts)::TIMESTAMP AS day
             FROM events WHERE event_type = 'view'"""


def _treated_sampled(spark, d):
    ev = table(spark, d, "events")
    treated = ev.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("t"))
    sampled = ev.where("event_type = 'view'").select(
        "user_id",
        F.when(F.col("value") < 40, None).otherwise(F.col("ts")).alias("clock"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"),
    )
    return treated, sampled


@query(
    "j_two_sided_proximity",
    f"""WITH a AS ({TREATED}), b AS ({SAMPLED})
        SELECT a.user_id, a.t, coalesce(x.clock, x.day) AS last_time, coalesce(y.clock, y.day) AS next_time,
               CASE WHEN x.clock IS NULL THEN 'date' ELSE 'time' END AS last_kind,
               CASE WHEN y.clock IS NULL THEN 'date' ELSE 'time' END AS next_kind
        FROM a LEFT JOIN b x ON a.user_id = x.user_id AND ((a.t >= x.clock AND a.t <= x.clock + INTERVAL 72 HOUR)
               OR (x.clock IS NULL AND a.t >= x.day AND a.t <= x.day + INTERVAL 3 DAY))
             LEFT JOIN b y ON a.user_id = y.user_id AND ((a.t >= y.clock - INTERVAL 24 HOUR AND a.t <= y.clock)
               OR (y.clock IS NULL AND a.t >= y.day - INTERVAL 1 DAY AND a.t <= y.day))
        WHERE coalesce(x.clock, x.day, y.clock, y.day) IS NOT NULL""",
)
def j_two_sided_proximity(spark, d):
    treated, sampled = _treated_sampled(spark, d)
    return I.two_sided_proximity(treated, sampled, "user_id", "t", "clock", "day")


@query(
    "j_suspected_time",
    f"""WITH a AS ({TREATED}), b AS (SELECT user_id, coalesce(clock, day) AS seen FROM ({SAMPLED})), m AS (
          SELECT a.user_id, a.t, min(CASE WHEN seen <= a.t THEN seen END) AS last_time, min(CASE WHEN seen >= a.t THEN seen END) AS next_time
          FROM a JOIN b ON a.user_id = b.user_id AND seen BETWEEN a.t - INTERVAL 72 HOUR AND a.t + INTERVAL 24 HOUR GROUP BY 1, 2)
        SELECT user_id, min(least(coalesce(last_time, next_time), t)) AS suspected FROM m GROUP BY 1""",
)
def j_suspected_time(spark, d):
    from chronocohort.plans.labels import suspected_times

    treated, sampled = _treated_sampled(spark, d)
    rows = suspected_times(treated, sampled, "user_id", "t", "clock", "day")
    return rows.groupBy("user_id").agg(F.min("suspected").alias("suspected"))


@query(
    "j_point_in_interval",
    """WITH iv AS (SELECT user_id, ts AS s, ts + INTERVAL 6 HOUR AS f FROM events WHERE event_type = 'click')
       SELECT e.event_id, max(CASE WHEN iv.s IS NULL THEN 0 ELSE 1 END) AS inside FROM events e
       LEFT JOIN iv ON e.user_id = iv.user_id AND e.ts BETWEEN iv.s AND iv.f WHERE e.event_type != 'click' GROUP BY 1""",
)
def j_point_in_interval(spark, d):
    ev = table(spark, d, "events")
    spans = ev.where("event_type = 'click'").select(
        "user_id", F.col("ts").alias("s"), (F.col("ts") + T.hours(6)).alias("f")
    )
    points = ev.where("event_type != 'click'").select("event_id", "user_id", "ts")
    return I.point_in_interval(points, spans, "user_id", "ts", "s", "f").select("event_id", "inside")


@query(
    "j_asof_tolerance",
    """SELECT event_id, latest FROM (SELECT a.event_id, b.value AS latest,
         row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC NULLS LAST) AS rn
         FROM events a LEFT JOIN events b ON b.event_type = 'view' AND a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 24 HOUR AND a.ts
         WHERE a.event_type = 'purchase') WHERE rn = 1""",
)
def j_asof_tolerance(spark, d):
    ev = table(spark, d, "events")
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'view'").select("user_id", "ts", "value")
    return I.asof(left, right, "user_id", "ts", "ts", "value", 24, "latest").select("event_id", "latest")


@query(
    "j_asof_two_source",
    """WITH a AS (SELECT event_id, user_id, ts, CASE WHEN value > 30 THEN value END AS own FROM events WHERE event_type = 'purchase'),
            one AS (SELECT * FROM (SELECT a.event_id, b.ts AS at, b.own AS v, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC) AS rn
                    FROM a JOIN a b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 36 HOUR AND a.ts) WHERE rn = 1),
            two AS (SELECT * FROM (SELECT a.event_id, b.ts AS at, CASE WHEN b.value < 90 THEN b.value END AS v,
                      row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC) AS rn
                    FROM a JOIN events b ON b.event_type = 'signup' AND a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 36 HOUR AND a.ts) WHERE rn = 1)
       SELECT a.event_id, CASE WHEN two.at IS NULL THEN one.v WHEN one.at >= two.at THEN coalesce(one.v, two.v) ELSE coalesce(two.v, one.v) END AS reading
       FROM a LEFT JOIN one ON a.event_id = one.event_id LEFT JOIN two ON a.event_id = two.event_id""",
)
def j_asof_two_source(spark, d):
    ev = table(spark, d, "events")
    left = ev.where("event_type = 'purchase'").select(
        "event_id", "user_id", "ts", F.when(F.col("value") > 30, F.col("value")).alias("own")
    )
    other = ev.where("event_type = 'signup'").select(
        "user_id", "ts", F.when(F.col("value") < 90, F.col("value")).alias("v")
    )
    rows = I.asof_two_sources(left, "own", other, "user_id", "ts", "ts", "v", 36, "reading")
    return rows.select("event_id", "reading")


@query(
    "j_prev_row_tolerance",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events)
       SELECT x.event_id, y.value AS value_prev, y.event_type AS event_type_prev FROM b x
       LEFT JOIN b y ON x.user_id = y.user_id AND x.rn = y.rn + 1 AND y.ts > x.ts - INTERVAL 6 HOUR""",
)
def j_prev_row_tolerance(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")
    rows = W.previous_within(ev, "user_id", "ts", ["value", "event_type"], 6)
    return rows.select("event_id", "value_prev", "event_type_prev")


HOURLY = """SELECT e.user_id, floor((epoch_us(ts) - epoch_us(admit)) / 3600000000.0)::INTEGER AS hour,
              max(value) AS top, sum((round(value * 100))::BIGINT)::BIGINT AS cents
            FROM events e JOIN (SELECT user_id, min(ts) AS admit FROM events GROUP BY user_id) s ON e.user_id = s.user_id GROUP BY 1, 2"""


def hourly(spark, d):
    """One row per user and hour since the first event: highest value and sum in hundredths."""
    ev = table(spark, d, "events").select("user_id", "ts", "value")
    starts = ev.groupBy("user_id").agg(F.min("ts").alias("admit"))
    rows = key_join(ev, starts, "user_id")
    hour = F.floor(T.hours_between("admit", "ts")).cast("int")
    return rows.groupBy("user_id", hour.alias("hour")).agg(
        F.max("value").alias("top"), F.sum(cents("value")).alias("cents")
    )


@query(
    "w_trailing_range",
    f"""WITH h AS ({HOURLY}) SELECT a.user_id, a.hour, max(b.top) AS top_24h, sum(b.cents)::BIGINT AS cents_24h FROM h a
        JOIN h b ON a.user_id = b.user_id AND b.hour BETWEEN a.hour - 24 AND a.hour GROUP BY 1, 2""",
)
def w_trailing_range(spark, d):
    spans = {"top_24h": ("max", "top"), "cents_24h": ("sum", "cents")}
    return W.trailing_hours(hourly(spark, d), "user_id", "hour", spans).drop("top", "cents")


@query(
    "j_key_spine",
    """WITH h AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, max(value) AS v FROM events GROUP BY 1, 2, 3),
            k AS (SELECT user_id, hour FROM h WHERE event_type = 'view' UNION SELECT user_id, hour FROM h WHERE event_type = 'click'
                  UNION SELECT user_id, hour FROM h WHERE event_type = 'error')
       SELECT k.user_id, k.hour, a.v AS view_v, b.v AS click_v, c.v AS error_v FROM k
       LEFT JOIN h a ON k.user_id = a.user_id AND k.hour = a.hour AND a.event_type = 'view'
       LEFT JOIN h b ON k.user_id = b.user_id AND k.hour = b.hour AND b.event_type = 'click'
       LEFT JOIN h c ON k.user_id = c.user_id AND k.hour = c.hour AND c.event_type = 'error'""",
)
def j_key_spine(spark, d):
    ev = table(spark, d, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    sources = [
        ev.where(F.col("event_type") == k).groupBy("user_id", hour).agg(F.max("value").alias(f"{k}_v"))
        for k in ("view", "click", "error")
    ]
    return A.merge_on_spine(sources, ["user_id", "hour"])


def _two_sides(spark, d):
    ev = table(spark, d, "events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    keys = ["user_id", day, (F.col("user_id") % 3).cast("int").alias("part"), F.lit(1).alias("label")]
    return tuple(
        ev.where(F.col("event_type") == k).groupBy(*keys).agg(F.max("value").alias(f"{k}_v")) for k in ("view", "click")
    )


@query(
    "j_full_outer",
    """WITH a AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, (user_id % 3)::INTEGER AS part, 1 AS label, max(value) AS view_v
                  FROM events WHERE event_type = 'view' GROUP BY 1, 2, 3),
            b AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, (user_id % 3)::INTEGER AS part, 1 AS label, max(value) AS click_v
                  FROM events WHERE event_type = 'click' GROUP BY 1, 2, 3)
       SELECT user_id, day, part, label, view_v, click_v FROM a FULL JOIN b USING (user_id, day, part, label)""",
)
def j_full_outer(spark, d):
    from chronocohort.plans.features import merge_sources

    a, b = _two_sides(spark, d)
    return merge_sources(a, b, ["user_id", "day", "part", "label"])


@query(
    "j_prev_hour_flag",
    f"""WITH h AS (SELECT user_id, hour, (cents // 5000)::BIGINT AS score FROM ({HOURLY}))
        SELECT b.user_id, b.hour, b.score, CASE WHEN b.score - a.score >= 1 THEN 1 ELSE 0 END AS rise,
               CASE WHEN a.score - b.score >= 1 THEN 1 ELSE 0 END AS fall
        FROM h a JOIN h b ON a.user_id = b.user_id AND a.hour = b.hour - 1 WHERE b.hour >= 0""",
)
def j_prev_hour_flag(spark, d):
    h = hourly(spark, d).select("user_id", "hour", F.floor(F.col("cents") / 5000).alias("score"))
    return W.hour_step_flag(h, "user_id", "hour", "score", 1, "rise", "fall")


@query(
    "j_fanout_flag",
    """SELECT c_custkey, 'fan out' AS kind, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS flag
         FROM customer LEFT JOIN orders ON c_custkey = o_custkey
       UNION ALL SELECT c_custkey, 'per entity', coalesce(max(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END), 0)
         FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
)
def j_fanout_flag(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    codes = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    wanted = ["1-URGENT", "2-HIGH"]
    return (
        C.code_flag(c, codes, "c_custkey", "o_orderpriority", wanted, "flag", fan_out=True)
        .withColumn("kind", F.lit("fan out"))
        .unionByName(
            C.code_flag(c, codes, "c_custkey", "o_orderpriority", wanted, "flag").withColumn("kind", F.lit("per entity"))
        )
    )


@query(
    "j_attach_static",
    """SELECT c_custkey, c_acctbal, c_mktsegment, n_obs, series, first_day FROM
         (SELECT o_custkey, count(*) AS n_obs, min(o_orderdate) AS first_day,
                 string_agg((round(o_totalprice * 100))::BIGINT::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS series
          FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey""",
)
def j_attach_static(spark, d):
    long = table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", cents("o_totalprice").alias("v")
    )
    series = R.series_arrays(long, "c_custkey", "o_orderdate", "o_orderkey", "v")
    static = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return series.join(static, "c_custkey").select(
        "c_custkey", "c_acctbal", "c_mktsegment",
        F.size("values").cast("bigint").alias("n_obs"),
        F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("series"),
        F.col("times")[0].alias("first_day"),
    )


CASE_STAYS = f"""WITH s AS (SELECT user_id, min(ts) AS t_in, max(ts) AS t_out, min(CASE WHEN event_type = 'error' AND value > 100 THEN ts END) AS t0
                 FROM events GROUP BY user_id)"""


@query(
    "j_rank_slice_match",
    CASE_STAYS
    + """, ca AS (SELECT user_id AS matched_case, onset_hour, row_number() OVER (ORDER BY onset_hour, user_id) - 1 AS i FROM
                (SELECT user_id, (epoch_us(t0) - epoch_us(t_in)) / 3600000000.0::DOUBLE AS onset_hour FROM s WHERE t0 IS NOT NULL)),
            co AS (SELECT user_id, t_in, len, row_number() OVER (ORDER BY len, user_id) - 1 AS j FROM
                (SELECT user_id, t_in, (epoch_us(t_out) - epoch_us(t_in)) / 3600000000.0::DOUBLE AS len FROM s WHERE t0 IS NULL)),
            r AS (SELECT (SELECT count(*) FROM co) / (SELECT count(*) FROM ca)::DOUBLE AS r)
       SELECT co.user_id, co.t_in, co.len, ca.matched_case, ca.onset_hour,
              co.t_in + to_microseconds(round_even(ca.onset_hour * 3600000000, 0)::BIGINT) AS onset_time
       FROM ca, r JOIN co ON co.j >= floor(ca.i * r.r) AND co.j < floor((ca.i + 1) * r.r)""",
)
def j_rank_slice_match(spark, d):
    ev = table(spark, d, "events")
    severe = F.when((F.col("event_type") == "error") & (F.col("value") > 100), F.col("ts"))
    s = ev.groupBy("user_id").agg(F.min("ts").alias("t_in"), F.max("ts").alias("t_out"), F.min(severe).alias("t0"))
    cases = s.where("t0 IS NOT NULL").select("user_id", T.hours_between("t_in", "t0").alias("onset"))
    controls = s.where("t0 IS NULL").select("user_id", "t_in", T.hours_between("t_in", "t_out").alias("len"))
    return C.match_by_rank(cases, controls, "user_id", "onset", "user_id", "len", "t_in")
