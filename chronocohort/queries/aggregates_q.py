"""Aggregation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronocohort.functions import timefn as T
from chronocohort.operators import aggregates as A, cohort as C, evaluate as E, intervals as I, reshape as R
from chronocohort.queries.registry import hash_sql, query, table

HOUR = "date_trunc('hour', ts)::TIMESTAMP"


def clock_hour():
    return F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")


@query(
    "a_conditional_pivot",
    f"""SELECT user_id, {HOUR} AS hour, min(CASE WHEN event_type = 'view' THEN value END) AS view_low,
          max(CASE WHEN event_type = 'click' THEN value END) AS click_high, max(CASE WHEN event_type = 'error' THEN value END) AS error_high
        FROM events GROUP BY 1, 2""",
)
def a_conditional_pivot(spark, d):
    ev = table(spark, d, "events").select("user_id", clock_hour(), "event_type", "value")
    columns = {"view_low": ("min", "view"), "click_high": ("max", "click"), "error_high": ("max", "error")}
    return A.conditional_pivot(ev, ["user_id", "hour"], "event_type", "value", columns)


@query(
    "a_signed_sum",
    """SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 0 THEN -l_quantity ELSE l_quantity END) AS net
       FROM lineitem GROUP BY 1""",
)
def a_signed_sum(spark, d):
    return A.signed_sum(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_quantity", ["R"], "net")


@query(
    "a_avg_converted",
    """SELECT user_id, round(avg(CASE event_type WHEN 'view' THEN value WHEN 'click' THEN value * 0.45359237 WHEN 'error' THEN value * 0.0283495231 END), 8) AS weight
       FROM events WHERE value != 0 AND event_type IN ('view','click','error') GROUP BY 1""",
)
def a_avg_converted(spark, d):
    from chronocohort.plans.labels import mean_weight

    ev = table(spark, d, "events").where("value != 0")
    factors = {"view": 1.0, "click": 0.45359237, "error": 0.0283495231}
    return mean_weight(ev, "user_id", "event_type", "value", factors).select("user_id", F.round("weight", 8).alias("weight"))


@query(
    "a_rate_per_weight",
    f"""WITH w1 AS (SELECT user_id, max(value) AS weight FROM events WHERE event_type = 'signup' AND value > 120 GROUP BY 1),
             w2 AS (SELECT user_id, max(value) AS weight FROM events WHERE event_type = 'view' GROUP BY 1)
        SELECT e.user_id, {HOUR} AS hour,
          round(max(CASE WHEN event_type = 'click' THEN value / coalesce(w1.weight, w2.weight) WHEN event_type = 'purchase' THEN value END), 8) AS drug_a,
          max(CASE WHEN event_type = 'error' THEN value END) AS drug_b
        FROM events e LEFT JOIN w1 ON e.user_id = w1.user_id LEFT JOIN w2 ON e.user_id = w2.user_id GROUP BY 1, 2""",
)
def a_rate_per_weight(spark, d):
    ev = table(spark, d, "events")
    top = F.max("value").alias("weight")
    w1 = ev.where("event_type = 'signup' AND value > 120").groupBy("user_id").agg(top)
    w2 = ev.where("event_type = 'view'").groupBy("user_id").agg(top)
    columns = {"drug_a": (["click"], ["purchase"]), "drug_b": ([], ["error"])}
    rates = ev.select("user_id", clock_hour(), "event_type", "value")
    out = A.weighted_rate(rates, [w1, w2], "user_id", ["user_id", "hour"], "event_type", "value", columns)
    return out.withColumn("drug_a", F.round("drug_a", 8))


@query("a_count_desc", "SELECT p_name, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1 ORDER BY n DESC, p_name")
def a_count_desc(spark, d):
    counts = table(spark, d, "part").where("p_size > 10").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "p_name")


@query("a_distinct", "SELECT l_orderkey, l_returnflag, l_shipdate FROM lineitem GROUP BY 1, 2, 3")
def a_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate").distinct()


@query(
    "a_flag_max",
    f"""SELECT user_id, {HOUR} AS hour, max(CASE WHEN event_type = 'view' AND value > 20 THEN 1 WHEN event_type = 'click' THEN 1 ELSE 0 END) AS on_flag,
          max(CASE WHEN event_type = 'purchase' AND props IN ('{{"k": 69}}', '{{"k": 7}}', '{{"k": 12}}') THEN 1 ELSE 0 END) AS off_flag,
          max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS end_flag FROM events GROUP BY 1, 2""",
)
def a_flag_max(spark, d):
    ev = table(spark, d, "events")
    kind = F.col("event_type")
    marks = ['{"k": 69}', '{"k": 7}', '{"k": 12}']
    flags = {
        "on_flag": ((kind == "view") & (F.col("value") > 20)) | (kind == "click"),
        "off_flag": (kind == "purchase") & F.col("props").isin(marks),
        "end_flag": kind == "error",
    }
    return A.flag_max(ev.withColumn("hour", clock_hour()), ["user_id", "hour"], flags)


@query(
    "a_min_by_state",
    """WITH iv AS (SELECT user_id, ts AS s, ts + INTERVAL 12 HOUR AS f FROM events WHERE event_type = 'error'),
            p AS (SELECT e.event_id, e.user_id, e.value, max(CASE WHEN iv.s IS NULL THEN 0 ELSE 1 END) AS inside FROM events e
                  LEFT JOIN iv ON e.user_id = iv.user_id AND e.ts BETWEEN iv.s AND iv.f WHERE e.event_type = 'view' GROUP BY 1, 2, 3)
       SELECT user_id, min(CASE WHEN inside = 1 THEN value END) AS low_in, min(CASE WHEN inside = 0 THEN value END) AS low_out FROM p GROUP BY 1""",
)
def a_min_by_state(spark, d):
    ev = table(spark, d, "events")
    spans = ev.where("event_type = 'error'").select(
        "user_id", F.col("ts").alias("s"), (F.col("ts") + T.hours(12)).alias("f")
    )
    points = ev.where("event_type = 'view'").select("user_id", "ts", "value")
    flagged = I.point_in_interval(points, spans, "user_id", "ts", "s", "f")
    return A.min_by_state(flagged, ["user_id"], "inside", "value", {"low_in": 1, "low_out": 0})


@query(
    "a_having",
    """SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1, 2
       HAVING min(ts) != max(ts) AND max(value) > 150 AND count(*) >= 5""",
)
def a_having(spark, d):
    groups = table(spark, d, "events").groupBy("user_id", "event_type").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.max("value").alias("top")
    )
    return groups.where("first_seen != last_seen AND top > 150 AND n >= 5").drop("top")


@query(
    "a_mean_all",
    f"""SELECT user_id, {HOUR} AS hour, round(avg(value), 9) AS value, avg((value > 50)::INTEGER)::DOUBLE AS high
        FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2""",
)
def a_mean_all(spark, d):
    ev = table(spark, d, "events").select(
        "user_id", clock_hour(), "value", (F.col("value") > 50).cast("int").alias("high")
    )
    return A.mean_per_time(ev, ["user_id", "hour"], ["value", "high"]).withColumn("value", F.round("value", 9))


@query(
    "a_entity_summary",
    """SELECT l_orderkey, max(l_shipdate) AS end_time, max(l_returnflag) AS label, count(l_quantity) AS n_obs, count(l_shipdate) AS n_time_rows,
              count(DISTINCT l_shipdate) AS n_times FROM lineitem GROUP BY 1""",
)
def a_entity_summary(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity", F.col("l_returnflag").alias("label"))
    return A.entity_summary(li, "l_orderkey", "l_shipdate", "l_quantity", "label")


@query(
    "a_train_zscore",
    f"""WITH tr AS (SELECT * FROM events WHERE {hash_sql('user_id')} < 3435973836),
             st AS (SELECT avg(value) AS m, stddev_samp(value) AS s, avg(event_id) AS m2, stddev_samp(event_id) AS s2 FROM tr)
        SELECT event_id AS id, round((value - m) / s, 6) AS value, round((event_id - m2) / s2, 6) AS place FROM events, st""",
)
def a_train_zscore(spark, d):
    from chronocohort.functions.scalars import stable_hash

    ev = table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("id"), "value", F.col("event_id").cast("double").alias("place")
    )
    scaled = A.zscore(ev, ev.where(stable_hash("user_id") < 3435973836), ["value", "place"])
    return scaled.select("id", F.round("value", 6).alias("value"), F.round("place", 6).alias("place"))


SCORED = """SELECT l.doc_id, (l.doc_id % 7)::INTEGER AS class, l.quality AS y, (d.n_chars // 40)::DOUBLE AS score
            FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def scored(spark, d):
    """Labelled documents with a score that has ties and a class 0..6."""
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 40).cast("double").alias("score"))
    return table(spark, d, "labels").join(docs, "doc_id").select(
        "doc_id", (F.col("doc_id") % 7).cast("int").alias("class"), F.col("quality").alias("y"), "score"
    )


POINTS = f"""s AS ({SCORED}), g AS (SELECT class AS "group", y, score FROM s UNION ALL SELECT -1, y, score FROM s),
     f AS (SELECT "group", score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM g GROUP BY 1, 2),
     p AS (SELECT *, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, row_number() OVER w AS rn,
                  (sum(pos) OVER (PARTITION BY "group"))::BIGINT AS np, (sum(neg) OVER (PARTITION BY "group"))::BIGINT AS nn
           FROM f WINDOW w AS (PARTITION BY "group" ORDER BY score DESC)),
     q AS (SELECT "group", 0::BIGINT AS rn, 0::BIGINT AS tp, 0::BIGINT AS fp, max(np) AS np, max(nn) AS nn, 1.0::DOUBLE AS prec FROM p GROUP BY 1
           UNION ALL SELECT "group", rn, tp, fp, np, nn, tp / (tp + fp)::DOUBLE FROM p),
     z AS (SELECT *, lead(tp) OVER w AS tp2, lead(fp) OVER w AS fp2, lead(prec) OVER w AS prec2 FROM q WINDOW w AS (PARTITION BY "group" ORDER BY rn))"""


AREAS = """SELECT "group", np AS n_pos, nn AS n_neg, round(sum((fp2 - fp) * (tp2 + tp) / 2.0) / nullif(np * nn, 0), 9) AS auroc,
          round(sum((tp2 - tp) * (prec2 + prec) / 2.0) / nullif(np, 0), 9) AS aupr FROM z GROUP BY 1, 2, 3"""


@query("a_auc_by_class", f"WITH {POINTS} {AREAS}")
def a_auc_by_class(spark, d):
    areas = E.auc_by_group(E.curve_points(scored(spark, d), "y", "score", "class"))
    return areas.withColumns({c: F.round(c, 9) for c in ("auroc", "aupr")})


@query(
    "a_auc_class_slots",
    f"""WITH {POINTS}, r AS ({AREAS}), k AS (SELECT unnest(generate_series(-1, 8))::INTEGER AS "group")
        SELECT k."group", coalesce(n_pos, 0)::BIGINT AS n_pos, coalesce(n_neg, 0)::BIGINT AS n_neg, coalesce(auroc, 0)::DOUBLE AS auroc, coalesce(aupr, 0)::DOUBLE AS aupr
        FROM k LEFT JOIN r ON r."group" = k."group" """,
)
def a_auc_class_slots(spark, d):
    """As by class, with a row for every expected class; two of these have no rows."""
    areas = E.auc_by_group(E.curve_points(scored(spark, d), "y", "score", "class"))
    return E.class_slots(areas, range(9)).withColumns({c: F.round(c, 9) for c in ("auroc", "aupr")})


@query(
    "a_curve_resample",
    f"""WITH {POINTS}, k AS (SELECT unnest(generate_series(0, 99))::INTEGER AS k),
          roc AS (SELECT z."group", k.k, CASE WHEN k.k = 0 THEN 0.0 ELSE (tp + (tp2 - tp) * (k.k * nn / 99.0 - fp) / (fp2 - fp)) / np END AS value
                  FROM z JOIN k ON np > 0 AND fp2 > fp AND fp * 99 <= k.k * nn AND k.k * nn < fp2 * 99
                  UNION ALL SELECT DISTINCT "group", 99, 1.0::DOUBLE FROM z WHERE np > 0 AND nn > 0),
          pr AS (SELECT z."group", k.k, prec + (prec2 - prec) * (k.k * np / 99.0 - tp) / (tp2 - tp) AS value
                 FROM z JOIN k ON nn > 0 AND tp2 > tp AND tp * 99 <= k.k * np AND k.k * np < tp2 * 99
                 UNION ALL SELECT "group", 99, max(prec) FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY rn) AS o FROM q WHERE tp = np AND np > 0 AND nn > 0) WHERE o = 1 GROUP BY 1)
        SELECT "group", 'roc' AS curve, k, k / 99.0::DOUBLE AS x, round(value, 8) AS value FROM roc
        UNION ALL SELECT "group", 'pr', k, k / 99.0::DOUBLE, round(value, 8) FROM pr""",
)
def a_curve_resample(spark, d):
    curves = E.resample_curves(E.curve_points(scored(spark, d), "y", "score", "class"))
    return curves.withColumn("value", F.round("value", 8))


@query(
    "a_weighted_logloss",
    """SELECT round(sum((ln(exp(a) + exp(b)) - CASE WHEN y = 1 THEN a ELSE b END) * CASE WHEN y = 1 THEN 1 / 4.0 ELSE 1 END) / count(*), 8) AS loss,
              count(*) AS n FROM (SELECT quality AS y, n_chars / 5000.0 AS a, toxic - 0.5 AS b FROM labels JOIN documents USING (doc_id))""",
)
def a_weighted_logloss(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").alias("y"), (F.col("n_chars") / 5000.0).alias("a"), (F.col("toxic") - F.lit(0.5)).alias("b")
    )
    return E.weighted_log_loss(rows, "y", "a", "b", 4.0).withColumn("loss", F.round("loss", 8))


@query(
    "a_metric_rollup",
    """WITH b AS (SELECT date_trunc('day', ts)::TIMESTAMP AS epoch, event_type AS batch, max(value) AS loss, count(*)::DOUBLE AS size FROM events GROUP BY 1, 2)
       SELECT epoch, round(avg(loss), 8) AS loss, round(avg(size), 8) AS size FROM b GROUP BY 1""",
)
def a_metric_rollup(spark, d):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("epoch")
    batches = table(spark, d, "events").groupBy(day, "event_type").agg(
        F.max("value").alias("loss"), F.count(F.lit(1)).cast("double").alias("size")
    )
    rolled = E.metric_rollup(batches, "epoch", ["loss", "size"])
    return rolled.withColumns({c: F.round(c, 8) for c in ("loss", "size")})


@query(
    "a_ratio_summary",
    """SELECT n_cases, n_controls, n_controls / n_cases::DOUBLE AS ratio, floor(n_controls / n_cases::DOUBLE)::BIGINT AS ratio_floor FROM (
         SELECT count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END) AS n_cases,
                count(DISTINCT CASE WHEN o_orderpriority != '1-URGENT' THEN o_custkey END) AS n_controls FROM orders)""",
)
def a_ratio_summary(spark, d):
    o = table(spark, d, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return C.matching_summary(o.where(urgent), o.where(~urgent), "o_custkey", "o_custkey")


def _sampled(spark, d):
    """Eight scores of every labelled document."""
    return R.repeat_rows(scored(spark, d), 8).withColumn("score", F.round(F.col("score") + (F.col("sample") * 37 + F.col("doc_id")) % 11, 6))


@query(
    "m_score_eval",
    f"""WITH m AS (SELECT s.doc_id, class, y, avg(round(score + (k * 37 + s.doc_id) % 11, 6)) AS score FROM ({SCORED}) s, (SELECT unnest(generate_series(1, 8)) AS k)
                   GROUP BY 1, 2, 3),
          g AS (SELECT class AS "group", y, score FROM m UNION ALL SELECT -1, y, score FROM m),
          a AS (SELECT x."group", sum(CASE WHEN x.score > y.score THEN 1 WHEN x.score = y.score THEN 0.5 ELSE 0 END) / count(*) AS auroc
                FROM g x JOIN g y ON x."group" = y."group" AND x.y = 1 AND y.y = 0 GROUP BY 1)
        SELECT g."group", sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, round(max(auroc), 8) AS auroc FROM g LEFT JOIN a ON a."group" = g."group" GROUP BY 1""",
)
def m_score_eval(spark, d):
    means = E.mean_sample_score(_sampled(spark, d), ["doc_id", "class"], "y", "score")
    areas = E.auc_by_group(E.curve_points(means, "y", "score", "class"))
    return areas.select("group", "n_pos", "n_neg", F.round("auroc", 8).alias("auroc"))


_MEANS = f"""SELECT s.doc_id, class, y, avg(round(score + (k * 37 + s.doc_id) % 11, 6)) AS score FROM ({SCORED}) s, (SELECT unnest(generate_series(1, 8)) AS k) GROUP BY 1, 2, 3"""


@query("m_score_areas", f"WITH {POINTS.replace(SCORED, _MEANS)} {AREAS}")
def m_score_areas(spark, d):
    """Both areas of the mean of eight sampled scores."""
    sampled = _sampled(spark, d)
    areas = E.auc_by_group(E.curve_points(E.mean_sample_score(sampled, ["doc_id", "class"], "y", "score"), "y", "score", "class"))
    return areas.withColumns({c: F.round(c, 9) for c in ("auroc", "aupr")})
