"""Window, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronocohort.functions import timefn as T
from chronocohort.operators import reshape as R, windows as W
from chronocohort.operators.ordered import KeyedOrder, keyed_rank
from chronocohort.operators.skew import key_join
from chronocohort.queries.registry import query, table


@query(
    "w_first_row",
    """SELECT user_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn
       FROM events WHERE event_type != 'view') WHERE rn = 1""",
)
def w_first_row(spark, d):
    ev = table(spark, d, "events").where("event_type != 'view'").select("user_id", "ts", "event_type", "value")
    return W.first_row(ev, ["user_id"], ["ts"])


@query(
    "w_dense_rank",
    """SELECT o_orderkey, dense_rank() OVER w AS visit, CASE WHEN dense_rank() OVER w = 1 THEN 1 ELSE 0 END AS first_visit
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY date_trunc('month', o_orderdate))""",
)
def w_dense_rank(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_trunc("month", "o_orderdate").alias("month"))
    ranked = KeyedOrder(o, ["o_custkey"], ["month"]).dense_rank("visit").rows()
    return ranked.select("o_orderkey", "visit", F.when(F.col("visit") == 1, 1).otherwise(0).alias("first_visit"))


@query(
    "w_row_number",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
)
def w_row_number(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return keyed_rank(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "rn").select("o_orderkey", "rn")


@query(
    "w_lag_conditional",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN lag(ts) OVER (PARTITION BY user_id, event_type = 'view' ORDER BY ts) END AS last_view,
         lag(event_type) OVER (PARTITION BY user_id, event_type IN ('view','error') ORDER BY ts) AS last_kind FROM events""",
)
def w_lag_conditional(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    is_view = F.col("event_type") == "view"
    either = F.col("event_type").isin("view", "error")
    rows = W.lag_within_state(ev, "user_id", is_view, "ts", F.col("ts"), "_last")
    rows = W.lag_within_state(rows, "user_id", either, "ts", F.col("event_type"), "last_kind")
    return rows.select("event_id", F.when(is_view, F.col("_last")).alias("last_view"), "last_kind")


STATES = """SELECT user_id, ts, CASE WHEN event_type IN ('view','click') THEN 1 ELSE 0 END AS is_on,
              CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_off, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_end FROM events"""


def states(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        "user_id", "ts",
        F.when(kind.isin("view", "click"), 1).otherwise(0).alias("is_on"),
        F.when(kind == "purchase", 1).otherwise(0).alias("is_off"),
        F.when(kind == "error", 1).otherwise(0).alias("is_end"),
    )


@query(
    "w_sessionize",
    f"""WITH s AS ({STATES}),
          a AS (SELECT *, CASE WHEN is_on = 1 THEN lag(ts) OVER (PARTITION BY user_id, is_on ORDER BY ts) END AS prev FROM s),
          b AS (SELECT *, CASE WHEN lag(is_end) OVER (PARTITION BY user_id, CASE WHEN is_on = 1 OR is_end = 1 THEN 1 ELSE 0 END ORDER BY ts) = 1 THEN 1
                               WHEN is_on = 0 AND is_off = 1 THEN 1 WHEN ts - prev > INTERVAL 8 HOUR THEN 1 ELSE 0 END AS fresh FROM a),
          c AS (SELECT *, CASE WHEN is_on = 1 OR is_end = 1 THEN sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) END AS num FROM b),
          e AS (SELECT user_id, num, min(ts) AS start, max(ts) AS finish FROM c GROUP BY 1, 2 HAVING min(ts) != max(ts) AND max(is_on) = 1
                AND num IS NOT NULL)
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY num) AS episode, start, finish,
               (epoch_us(finish) - epoch_us(start)) / 3600000000.0::DOUBLE AS hours FROM e""",
)
def w_sessionize(spark, d):
    return W.sessionize(states(spark, d), "user_id", "ts", "is_on", "is_off", "is_end", 8)


@query(
    "w_latest_row",
    """SELECT user_id, event_type, seen, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY seen DESC NULLS FIRST, event_id DESC) AS rn
       FROM (SELECT user_id, event_type, event_id, CASE WHEN value > 250 THEN NULL ELSE ts END AS seen, value FROM events)) WHERE rn = 1""",
)
def w_latest_row(spark, d):
    ev = table(spark, d, "events").select(
        "user_id", "event_type", "event_id", F.when(F.col("value") > 250, None).otherwise(F.col("ts")).alias("seen"), "value"
    )
    return W.latest_row(ev, ["user_id", "event_type"], "seen", ["event_id"]).drop("event_id")


@query(
    "w_cumcount",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 2 AS step FROM events",
)
def w_cumcount(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts")
    return keyed_rank(ev, ["user_id"], ["ts"], "_n").select("event_id", (F.col("_n") - 2).alias("step"))


@query(
    "w_cummin_delta",
    """WITH x AS (SELECT event_id, user_id, ts, (round(value * 100))::BIGINT AS a, CASE WHEN event_type != 'view' THEN event_id END AS b FROM events)
       SELECT event_id, min(coalesce(a, 0)) OVER w AS a_min, coalesce(a, 0) - min(coalesce(a, 0)) OVER w AS a_delta,
              min(coalesce(b, 0)) OVER w AS b_min, coalesce(b, 0) - min(coalesce(b, 0)) OVER w AS b_delta
       FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
)
def w_cummin_delta(spark, d):
    ev = table(spark, d, "events").select(
        "event_id", "user_id", "ts", F.rint(F.col("value") * 100).cast("bigint").alias("a"),
        F.when(F.col("event_type") != "view", F.col("event_id")).alias("b"),
    )
    return W.running_rise(ev, "user_id", ["ts"], ["a", "b"]).drop("user_id", "ts", "a", "b")


@query(
    "w_first_crossing",
    """SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events WHERE value >= 150)
       WHERE rn = 1""",
)
def w_first_crossing(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return W.first_crossing(ev, "user_id", ["ts"], "value", 150)


@query("s_sort", "SELECT user_id, ts, event_type, value FROM events ORDER BY user_id, ts")
def s_sort(spark, d):
    return table(spark, d, "events").select("user_id", "ts", "event_type", "value").orderBy("user_id", "ts")


HOURS_IN = """SELECT e.event_id, e.user_id, (epoch_us(ts) - epoch_us(admit)) / 3600000000.0::DOUBLE AS t, e.value, e.event_type FROM events e
              JOIN (SELECT user_id, min(ts) AS admit FROM events GROUP BY 1) s ON e.user_id = s.user_id"""


def hours_in(spark, d):
    """Events at hours since the user's first event."""
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")
    starts = ev.groupBy("user_id").agg(F.min("ts").alias("admit"))
    return key_join(ev, starts, "user_id").select(
        "event_id", "user_id", T.hours_between("admit", "ts").alias("t"), "value", "event_type"
    )


@query(
    "s_tail_n",
    f"""WITH h AS ({HOURS_IN}), k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) <= 40),
          g AS (SELECT user_id, floor(min(t))::BIGINT AS lo, floor(max(t))::BIGINT AS hi FROM k GROUP BY 1)
        SELECT 'kept' AS part, user_id, event_id AS item FROM k
        UNION ALL SELECT 'grid', user_id, unnest(generate_series(lo, hi)) FROM g""",
)
def s_tail_n(spark, d):
    kept = R.tail_n(hours_in(spark, d), "user_id", ["t", "event_id"], 40)
    grid = R.tail_grid(kept, "user_id", "t")
    return kept.select(F.lit("kept").alias("part"), "user_id", F.col("event_id").alias("item")).unionByName(
        grid.select(F.lit("grid").alias("part"), "user_id", F.col("grid_time").alias("item"))
    )


@query(
    "s_min_obs",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 66)",
)
def s_min_obs(spark, d):
    return R.min_observations(table(spark, d, "events").select("event_id", "user_id"), ["user_id"], 66)


@query(
    "u_union_distinct",
    """SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events WHERE event_type = 'view'
       UNION SELECT user_id, date_trunc('day', ts)::TIMESTAMP FROM events WHERE event_type = 'click'
       UNION SELECT user_id, date_trunc('day', ts)::TIMESTAMP FROM events WHERE event_type = 'error'""",
)
def u_union_distinct(spark, d):
    ev = table(spark, d, "events")
    days = [
        ev.where(F.col("event_type") == k).select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
        for k in ("view", "click", "error")
    ]
    return R.union_distinct(days)


@query(
    "u_union_by_name",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""",
)
def u_union_by_name(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey id", "c_name name", "c_acctbal balance", "c_mktsegment segment")
    s = table(spark, d, "supplier").selectExpr("s_acctbal balance", "s_suppkey id", "s_name name")
    return c.unionByName(s, allowMissingColumns=True)


@query("u_dedup", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def u_dedup(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").dropDuplicates()
