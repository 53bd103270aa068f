"""Projection, filter and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronocohort.functions import scalars as S, timefn as T
from chronocohort.operators import aggregates as A, coding as C
from chronocohort.operators.skew import key_join
from chronocohort.queries.registry import FIRST_ERROR, USER_STAYS, age_sql, first_error, query, table, user_stays

VALUE_RULES = [
    # code, low, high, high included, low included, concept
    ("click", 0.0, 300.0, 0, 0, "engage"),
    ("view", 0.0, 300.0, 0, 0, "engage"),
    ("purchase", 0.0, 100.0, 1, 0, "spend"),
    ("error", 10.0, None, 0, 1, "fault"),
]


@query(
    "p_code_map_range",
    """SELECT * FROM (
         SELECT event_id, user_id, value,
                CASE WHEN event_type IN ('click','view') AND value > 0 AND value < 300 THEN 'engage'
                     WHEN event_type = 'purchase' AND value > 0 AND value <= 100 THEN 'spend'
                     WHEN event_type = 'error' AND value >= 10 THEN 'fault' END AS concept
         FROM events) WHERE concept IS NOT NULL""",
)
def p_code_map_range(spark, d):
    ev = table(spark, d, "events")
    mapped = C.map_codes_in_range(ev, VALUE_RULES, "event_type", "value", code_type="string")
    return mapped.select("event_id", "user_id", "value", "concept")


@query(
    "p_code_fuse",
    """SELECT p_partkey, CASE WHEN p_type IN ('STANDARD','ECONOMY') THEN 'plain'
              WHEN p_type IN ('SMALL','MEDIUM','LARGE') THEN 'sized' END AS label FROM part""",
)
def p_code_fuse(spark, d):
    labels = [(k, "plain") for k in ("STANDARD", "ECONOMY")] + [(k, "sized") for k in ("SMALL", "MEDIUM", "LARGE")]
    part = table(spark, d, "part")
    return C.label_codes(part, labels, "p_type", code_type="string", keep_unmapped=True).select("p_partkey", "label")


@query(
    "p_clamp_null",
    """SELECT event_id, CASE WHEN event_type = 'click' AND value > 100 THEN NULL
              WHEN event_type = 'view' AND value > 50 THEN NULL ELSE value END AS value FROM events""",
)
def p_clamp_null(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", S.clamp_null("event_type", "value", {"click": 100, "view": 50}).alias("value"))


@query(
    "p_unit_convert",
    """SELECT event_id,
         round(CASE WHEN event_type = 'view' THEN (value - 32) / 1.8 WHEN event_type = 'click' THEN value * 0.45359237
                    ELSE value END, 6) AS converted,
         round(CASE WHEN value > 0 AND value <= 1 THEN value * 100 WHEN value >= 21 AND value <= 100 THEN value END, 6)
           AS percent
       FROM events""",
)
def p_unit_convert(spark, d):
    ev = table(spark, d, "events")
    factors = {"view": (1 / 1.8, -32 / 1.8), "click": (0.45359237, 0)}
    return ev.select(
        "event_id",
        F.round(S.convert_units("event_type", "value", factors), 6).alias("converted"),
        F.round(S.banded("value", [(0, 1, True, 100), (21, 100, False, 1)]), 6).alias("percent"),
    )


@query(
    "p_sentinel",
    """SELECT event_id, CASE WHEN event_type = 'view' AND props = '{"k": 69}' THEN 0
              WHEN event_type = 'click' AND props = '{"k": 7}' THEN 0 ELSE value END AS value FROM events""",
)
def p_sentinel(spark, d):
    ev = table(spark, d, "events")
    marks = {"view": '{"k": 69}', "click": '{"k": 7}'}
    return ev.select("event_id", S.sentinel("event_type", "props", "value", marks).alias("value"))


FLAG_SQL = "CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN NULL ELSE 0 END"


@query(
    "p_null_safe_filter",
    f"SELECT event_id, event_type FROM events WHERE ({FLAG_SQL}) IS DISTINCT FROM 1",
)
def p_null_safe_filter(spark, d):
    ev = table(spark, d, "events")
    flag = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", None).otherwise(0)
    return ev.where(S.is_not(flag, 1)).select("event_id", "event_type")


@query(
    "p_in_filters",
    """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')
       AND o_orderstatus NOT IN ('P') AND o_orderpriority != '2-HIGH' AND o_totalprice BETWEEN 1000 AND 300000""",
)
def p_in_filters(spark, d):
    o = table(spark, d, "orders")
    return o.where(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        & ~F.col("o_orderstatus").isin("P")
        & (F.col("o_orderpriority") != "2-HIGH")
        & F.col("o_totalprice").between(1000, 300000)
    ).select("o_orderkey", "o_orderpriority")


@query(
    "p_keyword_any",
    """SELECT doc_id, CASE WHEN (lower(text) LIKE '%the%tion%' OR lower(text) LIKE '%license%' OR lower(text) LIKE '%und %'
              OR lower(text) LIKE '%@%') AND lower(text) NOT LIKE '%password%' AND lower(text) NOT LIKE '%copyright%'
              THEN 1 ELSE 0 END AS hit FROM documents""",
)
def p_keyword_any(spark, d):
    docs = table(spark, d, "documents")
    hit = S.keyword_any("text", ["the%tion", "license", "und ", "@"], ["password", "copyright"])
    return docs.select("doc_id", hit.alias("hit"))


@query(
    "p_phase_label",
    f"""WITH i AS ({FIRST_ERROR}) SELECT e.event_id, CASE WHEN e.ts < i.t0 THEN 0
          WHEN e.ts BETWEEN i.t0 AND i.t0 + INTERVAL 5 HOUR THEN 1 ELSE 2 END AS phase
        FROM events e JOIN i ON e.user_id = i.user_id""",
)
def p_phase_label(spark, d):
    ev = table(spark, d, "events")
    joined = key_join(ev.select("event_id", "user_id", "ts"), first_error(ev), "user_id")
    return joined.select("event_id", T.phase_label("ts", "t0").alias("phase"))


@query(
    "p_exclusion_flags",
    """SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 1 ELSE 0 END AS low_balance,
              CASE WHEN n IS NULL THEN 1 ELSE 0 END AS no_orders,
              CASE WHEN c_mktsegment != 'BUILDING' THEN 1 ELSE 0 END AS other_segment,
              CASE WHEN total > 3000000 THEN 1 ELSE 0 END AS large,
              CASE WHEN c_acctbal <= 0 OR n IS NULL OR c_mktsegment != 'BUILDING' OR total > 3000000 THEN 1 ELSE 0 END AS excluded
       FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) o
         ON c_custkey = o_custkey""",
)
def p_exclusion_flags(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    )
    flags = S.exclusion_flags(
        {
            "low_balance": F.col("c_acctbal") <= 0,
            "no_orders": F.col("n").isNull(),
            "other_segment": F.col("c_mktsegment") != "BUILDING",
            "large": F.col("total") > 3000000,
        }
    )
    c = table(spark, d, "customer").join(orders, "c_custkey", "left")
    return c.select("c_custkey", *[col.alias(n) for n, col in flags.items()])


@query(
    "p_coalesce_least",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
         coalesce(nullif(l_discount, 0), nullif(l_tax, 0), l_quantity) AS first_known,
         least(nullif(l_discount, 0), nullif(l_tax, 0)) AS smallest,
         greatest(nullif(l_discount, 0), nullif(l_tax, 0)) AS largest FROM lineitem""",
)
def p_coalesce_least(spark, d):
    li = table(spark, d, "lineitem")
    a, b = F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.coalesce(a, b, "l_quantity").alias("first_known"),
        F.least(a, b).alias("smallest"),
        F.greatest(a, b).alias("largest"),
    )


@query(
    "p_threshold_score",
    """SELECT event_id, low_score, high_score, pair_score,
              coalesce(low_score,0) + coalesce(high_score,0) + coalesce(pair_score,0) AS total FROM (
         SELECT event_id,
           CASE WHEN lo < 5 THEN 4 WHEN lo < 10 THEN 3 WHEN lo < 20 THEN 2 WHEN lo < 40 THEN 1 WHEN lo IS NULL THEN NULL ELSE 0 END AS low_score,
           CASE WHEN hi >= 150 THEN 4 WHEN hi >= 100 THEN 3 WHEN hi >= 60 THEN 2 WHEN hi >= 30 THEN 1 WHEN hi IS NULL THEN NULL ELSE 0 END AS high_score,
           CASE WHEN hi > 120 OR lo > 120 THEN 4 WHEN hi > 40 OR lo <= 2 THEN 3 WHEN coalesce(hi, lo) IS NULL THEN NULL ELSE 0 END AS pair_score
         FROM (SELECT event_id, CASE WHEN event_type IN ('click','view') THEN value END AS lo,
                      CASE WHEN event_type IN ('purchase','error') THEN value END AS hi FROM events))""",
)
def p_threshold_score(spark, d):
    ev = table(spark, d, "events")
    lo = F.when(F.col("event_type").isin("click", "view"), F.col("value"))
    hi = F.when(F.col("event_type").isin("purchase", "error"), F.col("value"))
    rows = ev.select("event_id", lo.alias("lo"), hi.alias("hi"))
    l, h = F.col("lo"), F.col("hi")
    pair = (
        F.when((h > 120) | (l > 120), 4).when((h > 40) | (l <= 2), 3).when(F.coalesce(h, l).isNull(), None).otherwise(0)
    )
    scored = rows.select(
        "event_id",
        S.threshold_score("lo", [(5, 4), (10, 3), (20, 2), (40, 1)], below=True).alias("low_score"),
        S.threshold_score("hi", [(150, 4), (100, 3), (60, 2), (30, 1)], below=False).alias("high_score"),
        pair.alias("pair_score"),
    )
    return scored.withColumn("total", S.null_as_zero_sum("low_score", "high_score", "pair_score"))


@query(
    "p_regex_extract",
    """SELECT event_id, CASE WHEN x = '' OR x LIKE '%*%' THEN NULL ELSE TRY_CAST(x AS DOUBLE) END AS k FROM (
         SELECT event_id, regexp_extract(CASE WHEN event_type = 'signup' THEN '{"k": 6*}' WHEN event_type = 'error' THEN 'none'
                                              ELSE props END, '"k": (.*?)}', 1) AS x FROM events)""",
)
def p_regex_extract(spark, d):
    ev = table(spark, d, "events")
    text = (
        F.when(F.col("event_type") == "signup", '{"k": 6*}').when(F.col("event_type") == "error", "none").otherwise(F.col("props"))
    )
    return ev.select("event_id", S.extract_number(text, r'"k": (.*?)}').alias("k"))


@query(
    "p_compose_ts",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('minute', ts) END::TIMESTAMP AS stamped FROM events""",
)
def p_compose_ts(spark, d):
    ev = table(spark, d, "events")
    note = F.when(F.col("event_type") == "error", "Date/Time: unknown").otherwise(
        F.concat(F.lit("Date/Time: [**2101**] at "), F.date_format("ts", "HH:mm"), F.lit("\n"))
    )
    clock = F.regexp_extract(note, r"Date/Time: [\[\]0-9*-]+ at ([0-9:]+)", 1)
    return ev.select("event_id", T.compose_ts(F.to_date("ts"), clock).alias("stamped"))


@query(
    "p_elapsed_hours",
    f"""WITH s AS ({USER_STAYS}) SELECT event_id,
          round(epoch_us(ts) - epoch_us(admit), 0)::BIGINT AS micros,
          (epoch_us(ts) - epoch_us(admit)) / 3600000000.0::DOUBLE AS hours,
          (epoch_us(discharge) - epoch_us(ts)) / 86400000000.0::DOUBLE AS days_left
        FROM events e JOIN s ON e.user_id = s.user_id""",
)
def p_elapsed_hours(spark, d):
    ev = table(spark, d, "events")
    rows = key_join(ev.select("event_id", "user_id", "ts"), user_stays(ev), "user_id")
    return rows.select(
        "event_id",
        T.micros_between("admit", "ts").alias("micros"),
        T.hours_between("admit", "ts").alias("hours"),
        T.days_between("ts", "discharge").alias("days_left"),
    )


SHIP = "(l_shipdate + to_microseconds((round(l_extendedprice * 100) * 10000)::BIGINT))"


@query(
    "p_age_hour_index",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {age_sql(SHIP, 'o_orderdate')} AS hour_index
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def p_age_hour_index(spark, d):
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    micros = (F.rint(F.col("l_extendedprice") * 100) * 10000).cast("bigint")
    return li.join(o, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        T.age_hour_index(F.timestamp_add("MICROSECOND", micros, "l_shipdate"), "o_orderdate").alias("hour_index"),
    )


@query(
    "p_ts_shift",
    """SELECT event_id, ts - INTERVAL 48 HOUR AS lower_end, ts + to_hours((event_id % 24)::INTEGER) AS whole_hours,
              ts + to_microseconds(round_even(value * 3600000000, 0)::BIGINT) AS part_hours FROM events""",
)
def p_ts_shift(spark, d):
    ev = table(spark, d, "events")
    return ev.select(
        "event_id",
        (F.col("ts") - T.hours(48)).alias("lower_end"),
        T.shift_hours("ts", F.col("event_id") % 24).alias("whole_hours"),
        T.shift_hours("ts", "value").alias("part_hours"),
    )


@query(
    "p_ceil_hour",
    "SELECT event_id, date_trunc('hour', ts + INTERVAL 59 MINUTE)::TIMESTAMP AS clock_hour FROM events",
)
def p_ceil_hour(spark, d):
    return table(spark, d, "events").select("event_id", T.ceil_hour("ts").alias("clock_hour"))


@query(
    "p_age_cap",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN age > 5 THEN 5.4 ELSE age END AS age FROM (
         SELECT *, round(date_diff('day', o_orderdate, l_shipdate) / 365.242::DOUBLE, 4) AS age
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
)
def p_age_cap(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, d, "lineitem").join(o, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        T.age_years("o_orderdate", "l_shipdate", over=5, capped=5.4).alias("age"),
    )


@query(
    "p_logistic_score",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
         round(1 / (1 + exp(-(-0.025::DOUBLE + 0.05 * l_quantity + coalesce(-9.5 * nullif(l_discount, 0), -9.5::DOUBLE * 0.05 + 0.134)
           + coalesce(4.2 * nullif(l_tax, 0), 4.2::DOUBLE * 0.04 - 0.25)))), 8) AS score FROM lineitem""",
)
def p_logistic_score(spark, d):
    li = table(spark, d, "lineitem")
    score = S.logistic_score(
        -0.025,
        [
            (F.col("l_quantity"), 0.05, None, None),
            (F.nullif("l_discount", F.lit(0.0)), -9.5, 0.05, 0.134),
            (F.nullif("l_tax", F.lit(0.0)), 4.2, 0.04, -0.25),
        ],
    )
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(score, 8).alias("score")
    )


@query(
    "p_ratio",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
              round(100 * l_quantity / nullif(l_discount, 0), 6) AS ratio FROM lineitem""",
)
def p_ratio(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.round(S.guarded_ratio("l_quantity", "l_discount"), 6).alias("ratio"),
    )


@query(
    "p_category_map",
    """SELECT c_custkey, CASE WHEN c_mktsegment IN ('MACHINERY','AUTOMOBILE') THEN 'engines'
              WHEN c_mktsegment IN ('HOUSEHOLD','FURNITURE') THEN 'home' ELSE c_mktsegment END AS segment,
              round_even(c_acctbal / 10, 0) * 10 AS balance_tens FROM customer""",
)
def p_category_map(spark, d):
    groups = {"engines": ["MACHINERY", "AUTOMOBILE"], "home": ["HOUSEHOLD", "FURNITURE"]}
    return table(spark, d, "customer").select(
        "c_custkey", S.category_map("c_mktsegment", groups).alias("segment"), S.round_tens("c_acctbal").alias("balance_tens")
    )


@query(
    "p_one_hot",
    """SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS "c_mktsegment_AUTOMOBILE",
         CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS "c_mktsegment_BUILDING",
         CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS "c_mktsegment_FURNITURE",
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS "c_mktsegment_HOUSEHOLD",
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS "c_mktsegment_MACHINERY" FROM customer""",
)
def p_one_hot(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return A.one_hot(c, ["c_mktsegment"])


@query(
    "p_one_hot_long",
    """SELECT c_custkey, 'c_mktsegment' AS feature, c_mktsegment AS category, 1 AS value FROM customer WHERE c_mktsegment IS NOT NULL
       UNION ALL SELECT c_custkey, 'c_name', c_name, 1 FROM customer WHERE c_name IS NOT NULL""",
)
def p_one_hot_long(spark, d):
    return A.one_hot_long(table(spark, d, "customer"), ["c_custkey"], ["c_mktsegment", "c_name"])


@query(
    "p_relabel",
    """SELECT 1 AS label, user_id AS entity, ts AS chart_time, value AS reading FROM events WHERE event_type = 'error'
       UNION ALL SELECT 0 AS label, user_id AS entity, ts AS chart_time, value AS reading FROM events WHERE event_type = 'view'""",
)
def p_relabel(spark, d):
    ev = table(spark, d, "events").withColumnsRenamed({"user_id": "entity", "ts": "chart_time", "value": "reading"})
    order = ["label", "entity", "chart_time", "reading"]
    parts = [
        ev.where(F.col("event_type") == kind).withColumn("label", F.lit(label)).select(*order)
        for kind, label in (("error", 1), ("view", 0))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "p_drop_null_key",
    """SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
       AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND nullif(d.lang, 'de') IS NOT NULL""",
)
def p_drop_null_key(spark, d):
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", F.nullif("lang", F.lit("de")).alias("lang"))
    kept = docs.dropna(subset=["lang"]).join(labels.where("quality = 1"), "doc_id", "left_semi")
    return kept.join(labels.where("toxic = 1"), "doc_id", "left_anti")


@query(
    "p_drop_sparse_cols",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN value END AS view, CASE WHEN event_type = 'click' THEN value END AS click
       FROM events""",
)
def p_drop_sparse_cols(spark, d):
    ev = table(spark, d, "events")
    wide = ev.select(
        "event_id",
        *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("view", "click")],
        F.when(F.col("value") > 100000, F.col("value")).alias("rare"),
    )
    return A.drop_sparse_columns(wide, ["view", "click", "rare"], 500)


def _bounds(events):
    """Stay start and index time (first error) per user."""
    return events.groupBy("user_id").agg(
        F.min("ts").alias("t_in"), F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("t0")
    )


BOUNDS = "SELECT user_id, min(ts) AS t_in, min(CASE WHEN event_type = 'error' THEN ts END) AS t0 FROM events GROUP BY user_id"


@query(
    "p_horizon_filter",
    f"""WITH b AS ({BOUNDS}) SELECT event_id, (epoch_us(ts) - epoch_us(t_in)) / 3600000000.0::DOUBLE AS t FROM events e
        JOIN b ON e.user_id = b.user_id WHERE t_in <= ts AND ts <= t0 - INTERVAL 3 HOUR""",
)
def p_horizon_filter(spark, d):
    from chronocohort.plans.features import before_horizon

    ev = table(spark, d, "events")
    rows = before_horizon(ev.select("event_id", "user_id", "ts"), _bounds(ev), "user_id", "ts", "t_in", "t0", 3)
    return rows.select("event_id", "t")


@query(
    "p_length_filter",
    f"""WITH b AS ({BOUNDS}), h AS (SELECT e.user_id, event_id, (epoch_us(ts) - epoch_us(t_in)) / 3600000000.0 AS t,
            (epoch_us(t0) - epoch_us(t_in)) / 3600000000.0 AS onset FROM events e JOIN b ON e.user_id = b.user_id)
        SELECT user_id, count(*) AS n FROM h
        WHERE user_id NOT IN (SELECT user_id FROM h WHERE onset < 24) AND user_id NOT IN (SELECT user_id FROM h WHERE t > 715)
        GROUP BY user_id""",
)
def p_length_filter(spark, d):
    from chronocohort.plans.features import within_lengths

    ev = table(spark, d, "events")
    bounds = _bounds(ev)
    rows = key_join(ev.select("user_id", "ts"), bounds.select("user_id", "t_in"), "user_id").select(
        "user_id", T.hours_between("t_in", "ts").alias("t")
    )
    onsets = bounds.select("user_id", T.hours_between("t_in", "t0").alias("onset_hour"))
    return within_lengths(rows, onsets, "user_id", "t", "onset_hour", 24, 715).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n")
    )
