"""Reshaping, series, alignment and horizon queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronocohort.operators import reshape as R
from chronocohort.queries.joins_q import HOURLY, hourly
from chronocohort.queries.registry import EVENT_TYPES, USER_STAYS, cents, query, table, user_stays
from chronocohort.queries.windows_q import HOURS_IN, hours_in
from chronocohort.session import durable

VAR_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(EVENT_TYPES)) + " END"


def var_id():
    """Position of the event type in the fixed concept order."""
    out = None
    for i, k in enumerate(EVENT_TYPES):
        test = F.col("event_type") == k
        out = F.when(test, i) if out is None else out.when(test, i)
    return out


def as_text(values):
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


SPINE = f"""SELECT user_id, h::INTEGER AS hour, date_trunc('hour', admit + INTERVAL 59 MINUTE)::TIMESTAMP + to_hours(h) AS end_time FROM (
     SELECT user_id, admit, unnest(generate_series(-24, ceil((epoch_us(discharge) - epoch_us(admit)) / 3600000000.0)::BIGINT)) AS h FROM ({USER_STAYS}))"""


@query("r_hour_spine", SPINE)
def r_hour_spine(spark, d):
    return R.hour_spine(user_stays(table(spark, d, "events")), "user_id", "admit", "discharge")


@query(
    "r_gap_fill",
    f"SELECT s.user_id, s.hour, s.end_time, h.top, h.cents FROM ({SPINE}) s LEFT JOIN ({HOURLY}) h ON s.user_id = h.user_id AND s.hour = h.hour",
)
def r_gap_fill(spark, d):
    spine = R.hour_spine(user_stays(table(spark, d, "events")), "user_id", "admit", "discharge")
    return R.gap_fill(spine, hourly(spark, d), "user_id")


WIDE = """SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN value END AS view, CASE WHEN event_type = 'click' THEN value END AS click,
            CASE WHEN event_type IN ('view','error') THEN event_id::DOUBLE END AS both_kinds FROM events"""


@query(
    "r_unpivot",
    f"""WITH w AS ({WIDE}) SELECT user_id, ts, 0 AS var_id, view AS value FROM w WHERE view IS NOT NULL
        UNION ALL SELECT user_id, ts, 2, click FROM w WHERE click IS NOT NULL
        UNION ALL SELECT user_id, ts, 3, both_kinds FROM w WHERE both_kinds IS NOT NULL""",
)
def r_unpivot(spark, d):
    kind = F.col("event_type")
    wide = table(spark, d, "events").select(
        "user_id", "ts",
        F.when(kind == "view", F.col("value")).alias("view"),
        F.when(kind == "click", F.col("value")).alias("click"),
        F.when(kind.isin("view", "error"), F.col("event_id").cast("double")).alias("both_kinds"),
    )
    return R.unpivot_values(wide, ["user_id", "ts"], ["view", "dropped", "click", "both_kinds"])


@query(
    "r_sparse_wide",
    """SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN value END AS reading_view, CASE WHEN event_type = 'error' THEN value END AS reading_error
       FROM events WHERE event_type IN ('view','error')""",
)
def r_sparse_wide(spark, d):
    names = {"view": "reading_view", "error": "reading_error"}
    return R.sparse_wide(table(spark, d, "events"), ["event_id", "user_id", "ts"], "event_type", "value", names)


def _series_sql(source: str, extra: str = "") -> str:
    return f"""SELECT user_id, count(*)::INTEGER AS n, string_agg(v::VARCHAR, ',' ORDER BY t, var_id, v) AS vals, string_agg(var_id::VARCHAR, ',' ORDER BY t, var_id, v) AS vars,
                      min(t) AS first_t, max(t) AS last_t{extra} FROM ({source}) GROUP BY 1"""


LONG = f"SELECT user_id, t, {VAR_SQL} AS var_id, (round(value * 100))::BIGINT AS v FROM ({HOURS_IN})"


def long_series(spark, d):
    return hours_in(spark, d).select("user_id", "t", var_id().alias("var_id"), cents("value").alias("v"))


@query("r_series_arrays", _series_sql(LONG, ", 0 AS chunk"))
def r_series_arrays(spark, d):
    s = R.series_arrays(long_series(spark, d), "user_id", "t", "var_id", "v")
    return s.select(
        "user_id", "chunk", F.size("values").alias("n"), as_text("values").alias("vals"), as_text("vars").alias("vars"),
        F.array_min("times").alias("first_t"), F.array_max("times").alias("last_t"),
    )


@query(
    "r_entity_grid",
    f"""SELECT user_id, unnest(generate_series(0, round_even(max(t) + 1, 0)::BIGINT - 1))::INTEGER AS grid_time FROM ({HOURS_IN}) GROUP BY user_id""",
)
def r_entity_grid(spark, d):
    ends = hours_in(spark, d).groupBy("user_id").agg(F.max("t").alias("end_time"))
    return R.entity_grid(ends, "user_id", "end_time")


TAIL = f"SELECT * FROM ({LONG}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, var_id DESC, v DESC) <= 60"


def tail_series(spark, d):
    kept = R.tail_n(long_series(spark, d), "user_id", ["t", "var_id", "v"], 60)
    return R.series_arrays(kept, "user_id", "t", "var_id", "v")


@query(
    "r_pad_right",
    f"""WITH s AS (SELECT user_id, count(*) AS n, string_agg(v::VARCHAR, ',' ORDER BY t, var_id, v) AS vals FROM ({TAIL}) GROUP BY 1),
             m AS (SELECT max(n) AS m FROM s)
        SELECT user_id, n::INTEGER AS values_len, vals || repeat(',0', (m - n)::BIGINT) AS vals FROM s, m""",
)
def r_pad_right(spark, d):
    padded = R.pad_right(tail_series(spark, d), ["values"])
    whole = F.transform("values", lambda x: x.cast("bigint").cast("string"))
    return padded.select("user_id", "values_len", F.array_join(whole, ",").alias("vals"))


@query(
    "r_feature_order",
    f"""WITH p AS (SELECT user_id, var_id, row_number() OVER (PARTITION BY user_id ORDER BY t, var_id, v) - 1 AS pos FROM ({TAIL}))
        SELECT user_id, string_agg(var_id::VARCHAR, ',' ORDER BY var_id, pos) AS ind_k, string_agg(pos::VARCHAR, ',' ORDER BY var_id, pos) AS ind_t
        FROM p GROUP BY 1""",
)
def r_feature_order(spark, d):
    ordered = R.feature_order(tail_series(spark, d), "user_id", "vars")
    return ordered.select("user_id", as_text("ind_k").alias("ind_k"), as_text("ind_t").alias("ind_t"))


# The hourly grid of a user from the first hour with an event to the last, gaps filled with zero.
GRID = f"""SELECT s.user_id, s.step, coalesce(h.top, 0) AS top, coalesce(h.cents, 0)::DOUBLE AS cents FROM
             (SELECT user_id, unnest(generate_series(0, max(hour)))::INTEGER AS step FROM ({HOURLY}) GROUP BY user_id) s
           LEFT JOIN ({HOURLY}) h ON s.user_id = h.user_id AND s.step = h.hour"""
ALIGNED = f"""SELECT g.user_id, (g.step + 25 - n)::INTEGER AS position, top, cents FROM ({GRID}) g JOIN
                (SELECT user_id, max(hour) + 1 AS n FROM ({HOURLY}) GROUP BY 1) l ON g.user_id = l.user_id WHERE g.step + 25 - n >= 0
              UNION ALL SELECT user_id, unnest(generate_series(0, 24 - n))::INTEGER, 0, 0 FROM
                (SELECT user_id, max(hour) + 1 AS n FROM ({HOURLY}) GROUP BY 1) WHERE n < 25"""


def filled_grid(spark, d):
    h = durable(hourly(spark, d))
    ends = h.groupBy("user_id").agg(F.max("hour").alias("last"))
    # The few rows of a user's end become all hours of that user: both sides are dealt over as many tasks as those need.
    tasks = R.tasks_for(ends, F.col("last").cast("bigint") + 1)
    steps = ends.repartition(tasks, "user_id").select("user_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("step"))
    filled = steps.join(h.withColumnRenamed("hour", "step").repartition(tasks, "user_id"), ["user_id", "step"], "left")
    return filled.select(
        "user_id", "step", F.coalesce("top", F.lit(0.0)).alias("top"), F.coalesce(F.col("cents").cast("double"), F.lit(0.0)).alias("cents")
    )


def aligned(spark, d):
    return R.right_align(filled_grid(spark, d), "user_id", "step", 25, ["top", "cents"])


@query("r_right_align", ALIGNED)
def r_right_align(spark, d):
    return aligned(spark, d)


@query(
    "r_flatten_vector",
    f"""SELECT user_id, 50 AS n, string_agg((round(top * 100))::BIGINT::VARCHAR || ',' || cents::BIGINT::VARCHAR, ',' ORDER BY position) AS vector
        FROM ({ALIGNED}) GROUP BY 1""",
)
def r_flatten_vector(spark, d):
    rows = aligned(spark, d).withColumn("top", F.rint(F.col("top") * 100))
    flat = R.flatten_vector(rows, "user_id", "position", ["top", "cents"])
    whole = F.transform("vector", lambda x: x.cast("bigint").cast("string"))
    return flat.select("user_id", F.size("vector").alias("n"), F.array_join(whole, ",").alias("vector"))


@query(
    "r_tail_labels",
    f"""SELECT a.user_id, position, CASE WHEN position >= 13 THEN label ELSE 0 END AS y, 1 - CASE WHEN position >= 13 THEN label ELSE 0 END AS not_y
        FROM ({ALIGNED}) a JOIN (SELECT user_id, max(CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END) AS label FROM events GROUP BY 1) l
          ON a.user_id = l.user_id""",
)
def r_tail_labels(spark, d):
    severe = F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 150), 1).otherwise(0))
    labels = table(spark, d, "events").groupBy("user_id").agg(severe.alias("label"))
    rows = aligned(spark, d).join(labels, "user_id")
    return R.tail_labels(rows, "position", "label", 25, 12).select("user_id", "position", "y", "not_y")


@query(
    "r_static_on_grid",
    f"""SELECT g.user_id, g.step, g.top, c.c_acctbal, c.c_mktsegment FROM ({GRID}) g JOIN customer c ON c.c_custkey = g.user_id""",
)
def r_static_on_grid(spark, d):
    static = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal", "c_mktsegment")
    return filled_grid(spark, d).join(static, "user_id").drop("cents")


ONSETS = "SELECT user_id, max(t) - 2.5 AS onset FROM ({}) GROUP BY 1".format(HOURS_IN)


@query(
    "r_horizon_expand",
    f"""WITH k AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY user_id) >= 60 THEN 1 ELSE 0 END AS cut FROM ({TAIL})), o AS ({ONSETS}),
             x AS (SELECT k.*, h.h::INTEGER AS horizon FROM k JOIN o ON k.user_id = o.user_id, (SELECT unnest(generate_series(0, 6)) AS h) h WHERE h.h = 0 OR k.t <= o.onset - h.h)
        SELECT user_id, horizon, count(*) AS n_obs, max(t) AS last_time, CASE WHEN max(cut) = 1 THEN floor(min(t)) ELSE 0 END::INTEGER AS grid_start,
          CASE WHEN horizon > 0 THEN ceil(max(t) - min(t)) WHEN max(cut) = 1 THEN floor(max(t)) - floor(min(t)) + 1 ELSE round_even(max(t) + 1, 0) END::INTEGER AS grid_len,
          sum(v)::BIGINT AS total FROM x GROUP BY 1, 2""",
)
def r_horizon_expand(spark, d):
    expanded = expanded_horizons(spark, d)
    totals = expanded.groupBy("user_id", "horizon").agg(F.sum("v").alias("total"))
    return R.horizon_lengths(expanded, "user_id", "t", "cut").join(totals, ["user_id", "horizon"])


def expanded_horizons(spark, d):
    """Tail of 60 observations per user at horizons 0..6 before an onset near the end of the stay."""
    long = long_series(spark, d)
    kept = R.tail_n(long, "user_id", ["t", "var_id", "v"], 60)
    cut = kept.groupBy("user_id").agg(F.when(F.count(F.lit(1)) >= 60, 1).otherwise(0).alias("cut"))
    onsets = long.groupBy("user_id").agg((F.max("t") - 2.5).alias("onset"))
    return R.horizon_expand(kept.join(cut, "user_id"), onsets, "user_id", "t", "onset", 6)


@query(
    "r_repeat_rows",
    "SELECT doc_id, quality, s::INTEGER AS sample FROM labels, (SELECT unnest(generate_series(1, 10)) AS s)",
)
def r_repeat_rows(spark, d):
    return R.repeat_rows(table(spark, d, "labels").select("doc_id", "quality"), 10)
