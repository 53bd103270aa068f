"""End-to-end flows over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronocohort.functions import scalars as S, timefn as T
from chronocohort.operators import aggregates as A, intervals as I, reshape as R
from chronocohort.operators.skew import GroupSizes, heavy_keys, key_join
from chronocohort.plans import features as P, labels as L
from chronocohort.queries.joins_q import SAMPLED, TREATED, _treated_sampled
from chronocohort.queries.registry import EVENT_TYPES, FIRST_ERROR, USER_STAYS, age_sql, first_error, query, table, user_stays
from chronocohort.queries.reshape_q import SPINE
from chronocohort.queries.sampling_q import SPLIT, user_split


@query(
    "e_hourly_means_around_onset",
    f"""WITH i AS ({FIRST_ERROR}), w AS (SELECT e.user_id, floor((epoch_us(ts) - epoch_us(t0)) / 3600000000.0)::INTEGER AS hour,
             CASE WHEN ts < t0 THEN 0 WHEN ts <= t0 + INTERVAL 5 HOUR THEN 1 ELSE 2 END AS phase, value, event_type
           FROM events e JOIN i ON e.user_id = i.user_id AND ts BETWEEN t0 - INTERVAL 48 HOUR AND t0 + INTERVAL 7 HOUR),
         m AS (SELECT user_id, hour, max(phase) AS phase,
                 {', '.join(f"round(avg(CASE WHEN event_type = '{k}' THEN value END), 9) AS {k}_mean" for k in EVENT_TYPES)} FROM w GROUP BY 1, 2),
         s AS (SELECT user_id, unnest(generate_series(-48, 7))::INTEGER AS hour FROM i)
       SELECT s.user_id, s.hour, m.phase, {', '.join(f'm.{k}_mean' for k in EVENT_TYPES)} FROM s LEFT JOIN m ON s.user_id = m.user_id AND s.hour = m.hour""",
)
def e_hourly_means_around_onset(spark, d):
    """Mean readings per hour from 48 h before to 7 h after each user's first error, gaps kept as nulls."""
    ev = table(spark, d, "events").select("user_id", "ts", "value", "event_type")
    index = first_error(ev)
    near = I.around_index(ev, index, "user_id", "ts", "t0", 48, 7)
    reading = {k: F.when(F.col("event_type") == k, F.col("value")) for k in EVENT_TYPES}
    means = near.groupBy("user_id", F.floor(T.hours_between("t0", "ts")).cast("int").alias("hour")).agg(
        F.max(T.phase_label("ts", "t0")).alias("phase"),
        *[F.round(F.avg(c), 9).alias(f"{k}_mean") for k, c in reading.items()],
    )
    spine = index.select("user_id", F.explode(F.sequence(F.lit(-48), F.lit(7))).alias("hour"))
    return R.gap_fill(spine, means, "user_id")


@query(
    "e_onset_labels",
    f"""WITH a AS ({TREATED}), b AS (SELECT user_id, coalesce(clock, day) AS seen FROM ({SAMPLED})),
      near AS (SELECT a.user_id, a.t, min(CASE WHEN seen <= a.t THEN seen END) AS last_time, min(CASE WHEN seen >= a.t THEN seen END) AS next_time
               FROM a JOIN b ON a.user_id = b.user_id AND seen BETWEEN a.t - INTERVAL 72 HOUR AND a.t + INTERVAL 24 HOUR GROUP BY 1, 2),
      si AS (SELECT user_id, min(least(coalesce(last_time, next_time), t)) AS suspected FROM near GROUP BY 1),
      st AS ({USER_STAYS}),
      m AS (SELECT e.user_id, {age_sql('ts', 'admit')}::INTEGER AS hour, min(CASE WHEN event_type = 'view' THEN value END) AS low,
              max(CASE WHEN event_type = 'click' THEN value END) AS high, max(CASE WHEN event_type = 'error' THEN value END) AS fault
            FROM events e JOIN st ON e.user_id = st.user_id GROUP BY 1, 2),
      sc AS (SELECT user_id, hour,
               CASE WHEN low < 5 THEN 4 WHEN low < 10 THEN 3 WHEN low < 20 THEN 2 WHEN low < 40 THEN 1 WHEN low IS NULL THEN NULL ELSE 0 END AS s_low,
               CASE WHEN high >= 150 THEN 4 WHEN high >= 100 THEN 3 WHEN high >= 60 THEN 2 WHEN high >= 30 THEN 1 WHEN high IS NULL THEN NULL ELSE 0 END AS s_high,
               CASE WHEN fault >= 80 THEN 2 WHEN fault >= 40 THEN 1 ELSE 0 END AS s_fault FROM m),
      g AS (SELECT s.user_id, s.hour, s_low, s_high, s_fault FROM ({SPINE}) s LEFT JOIN sc ON s.user_id = sc.user_id AND s.hour = sc.hour),
      lb AS (SELECT x.user_id, x.hour, max(y.s_low) AS s_low, max(y.s_high) AS s_high, max(y.s_fault) AS s_fault
             FROM g x JOIN g y ON x.user_id = y.user_id AND y.hour BETWEEN x.hour - 24 AND x.hour GROUP BY 1, 2),
      t AS (SELECT lb.user_id, lb.hour, coalesce(s_low, 0) + coalesce(s_high, 0) + coalesce(s_fault, 0) AS total, admit + to_hours(lb.hour) AS onset_time
            FROM lb JOIN st ON lb.user_id = st.user_id JOIN si ON lb.user_id = si.user_id
            WHERE lb.hour >= 0 AND admit + to_hours(lb.hour) BETWEEN suspected - INTERVAL 49 HOUR AND suspected + INTERVAL 24 HOUR),
      r AS (SELECT *, total - min(total) OVER (PARTITION BY user_id ORDER BY onset_time ROWS UNBOUNDED PRECEDING) AS total_delta FROM t)
    SELECT user_id, hour, onset_time, total, total_delta FROM r WHERE total_delta >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY onset_time) = 1""",
)
def e_onset_labels(spark, d):
    """Suspicion window, hourly scores with a 24 h look-back, and the first rise by two points."""
    ev = table(spark, d, "events").select("user_id", "ts", "value", "event_type")
    treated, sampled = _treated_sampled(spark, d)
    split = GroupSizes(ev).split("user_id")
    suspected = L.suspected_times(treated, sampled, "user_id", "t", "clock", "day", split=split)
    windows = L.infection_windows(suspected, "user_id")
    stays = user_stays(ev)
    timed = key_join(ev, stays.select("user_id", "admit"), "user_id")
    timed = timed.withColumn("hour", T.age_hour_index("ts", "admit").cast("int"))
    columns = {"low": ("min", "view"), "high": ("max", "click"), "fault": ("max", "error")}
    measured = A.conditional_pivot(timed, ["user_id", "hour"], "event_type", "value", columns)
    ladders = {
        "s_low": S.threshold_score("low", [(5, 4), (10, 3), (20, 2), (40, 1)], below=True),
        "s_high": S.threshold_score("high", [(150, 4), (100, 3), (60, 2), (30, 1)], below=False),
        "s_fault": F.when(F.col("fault") >= 80, 2).when(F.col("fault") >= 40, 1).otherwise(0),
    }
    tasks = R.spine_tasks(stays, "admit", "discharge")
    spine = R.hour_spine(stays, "user_id", "admit", "discharge", tasks=tasks)
    scores = L.look_back_scores(spine, L.score_hours(measured, "user_id", ladders), "user_id", list(ladders), tasks=tasks)
    onsets = L.onset_times(scores, windows, stays, "user_id", "admit", tasks=tasks)
    return onsets.select("user_id", "hour", "onset_time", "total", "total_delta")


@query(
    "e_feature_series",
    f"""WITH bd AS (SELECT user_id, min(ts) AS t_in, min(CASE WHEN event_type = 'error' THEN ts END) AS t0 FROM events GROUP BY 1),
      v AS (SELECT user_id, ts, avg(CASE WHEN event_type = 'view' THEN value END) AS view, avg(CASE WHEN event_type = 'click' THEN value END) AS click
            FROM events WHERE event_type IN ('view','click') GROUP BY 1, 2),
      l AS (SELECT user_id, ts, avg(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
      f AS (SELECT coalesce(v.user_id, l.user_id) AS user_id, coalesce(v.ts, l.ts) AS ts, view, click, purchase FROM v FULL JOIN l ON v.user_id = l.user_id AND v.ts = l.ts),
      h AS (SELECT f.user_id, (epoch_us(ts) - epoch_us(t_in)) / 3600000000.0::DOUBLE AS t, view, click, purchase FROM f JOIN bd ON f.user_id = bd.user_id
            WHERE ts BETWEEN t_in AND t0),
      tr AS (SELECT * FROM h WHERE user_id IN (SELECT user_id FROM ({SPLIT}) WHERE split = 'train')),
      z AS (SELECT avg(view) AS m0, stddev_samp(view) AS s0, avg(click) AS m1, stddev_samp(click) AS s1, avg(purchase) AS m2, stddev_samp(purchase) AS s2 FROM tr)
    SELECT user_id, t, 0 AS var_id, round((view - m0) / s0, 6) AS value FROM h, z WHERE view IS NOT NULL
    UNION ALL SELECT user_id, t, 1, round((click - m1) / s1, 6) FROM h, z WHERE click IS NOT NULL
    UNION ALL SELECT user_id, t, 2, round((purchase - m2) / s2, 6) FROM h, z WHERE purchase IS NOT NULL""",
)
def e_feature_series(spark, d):
    """Two sources merged, cut at the index time, scaled on the train split and unpivoted."""
    ev = table(spark, d, "events")
    stays = ev.groupBy("user_id").agg(
        F.min("ts").alias("t_in"), F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("t0")
    )

    def source(*kinds):
        wide = R.sparse_wide(ev, ["user_id", "ts"], "event_type", "value", {k: k for k in kinds})
        return A.mean_per_time(wide, ["user_id", "ts"], list(kinds))

    merged = P.merge_sources(source("view", "click"), source("purchase"), ["user_id", "ts"])
    variables = ["view", "click", "purchase"]
    # A merged user has no more rows than events.
    inside = P.before_horizon(merged, stays, "user_id", "ts", "t_in", "t0", hot=heavy_keys(ev, "user_id"))
    train = inside.join(user_split(spark, d).where("split = 'train'"), "user_id", "left_semi")
    long = R.unpivot_values(A.zscore(inside, train, variables), ["user_id", "t"], variables)
    return long.withColumn("value", F.round("value", 6))
