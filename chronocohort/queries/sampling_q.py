"""Splits, balancing, batches and model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronocohort.functions import timefn as T
from chronocohort.operators import intervals as I, models as M, reshape as R, sampling as K
from chronocohort.queries.registry import EVENT_TYPES, first_error, hash_sql, query, table
from chronocohort.queries.reshape_q import aligned, var_id
from chronocohort.session import durable

SPLIT = f"""SELECT user_id, CASE WHEN rn - 1 < floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn - 1 < floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (
     SELECT user_id, row_number() OVER (ORDER BY {hash_sql('user_id')}, user_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))"""


def user_split(spark, d):
    return K.entity_split(table(spark, d, "events"), "user_id")


@query("k_entity_split", SPLIT)
def k_entity_split(spark, d):
    return user_split(spark, d)


@query(
    "k_resplit",
    f"""WITH s AS ({SPLIT}) SELECT user_id, split FROM s WHERE split = 'test' UNION ALL
        SELECT user_id, CASE WHEN row_number() OVER (ORDER BY {hash_sql('user_id', 1)}, user_id) <= (SELECT count(*) FROM s WHERE split = 'train') THEN 'train' ELSE 'val' END
        FROM s WHERE split != 'test'""",
)
def k_resplit(spark, d):
    return K.resplit(user_split(spark, d), "user_id")


def label_rows(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality", "toxic")


@query(
    "k_oversample",
    f"""WITH r AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality ORDER BY {hash_sql('doc_id', 3)}, doc_id) AS draw FROM labels),
             c AS (SELECT count(*) FILTER (quality = 1) AS ones, count(*) FILTER (quality = 0) AS zeros FROM labels),
             big AS (SELECT r.* FROM r, c WHERE quality = CASE WHEN ones > zeros THEN 1 ELSE 0 END),
             small AS (SELECT r.* FROM r, c WHERE quality != CASE WHEN ones > zeros THEN 1 ELSE 0 END)
        SELECT draw, doc_id, quality, toxic FROM big UNION ALL
        SELECT big.draw, small.doc_id, small.quality, small.toxic FROM big, c JOIN small ON small.draw = {hash_sql('big.draw', 3)} % least(ones, zeros) + 1""",
)
def k_oversample(spark, d):
    return K.oversample(label_rows(spark, d), "quality", "doc_id").select("draw", "doc_id", "quality", "toxic")


@query(
    "k_stratified",
    f"""SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {hash_sql('doc_id', 5)}, doc_id) AS rn FROM labels) WHERE rn <= 32""",
)
def k_stratified(spark, d):
    return K.stratified(label_rows(spark, d), "quality", "doc_id", 32).select("doc_id", "quality")


@query(
    "k_balanced_batches",
    f"""SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY {hash_sql('doc_id', 4)}, doc_id) - 1) // 16)::INTEGER AS batch FROM labels""",
)
def k_balanced_batches(spark, d):
    return K.balanced_batches(label_rows(spark, d), "quality", "doc_id", 16, epoch=4).select("doc_id", "quality", "batch")


@query(
    "k_seq_batches",
    "SELECT event_id, ((row_number() OVER (ORDER BY user_id, ts, event_id) - 1) // 128)::INTEGER AS batch FROM events",
)
def k_seq_batches(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts")
    return K.sequential_batches(rows, ["user_id", "ts", "event_id"], 128).select("event_id", "batch")


@query(
    "k_late_cohort",
    """WITH r AS (SELECT doc_id % 50 AS entity, (doc_id % 9)::INTEGER AS class, doc_id FROM documents), late AS (SELECT DISTINCT entity FROM r WHERE class = 6)
       SELECT 'all' AS part, * FROM r WHERE entity IN (SELECT entity FROM late)
       UNION ALL SELECT 'first', * FROM r WHERE class = 0 AND entity IN (SELECT entity FROM late)""",
)
def k_late_cohort(spark, d):
    r = table(spark, d, "documents").select(
        (F.col("doc_id") % 50).alias("entity"), (F.col("doc_id") % 9).cast("int").alias("class"), "doc_id"
    )
    whole = K.late_cohort(r, "entity", "class").withColumn("part", F.lit("all"))
    return whole.unionByName(K.late_cohort(r, "entity", "class", only_first=True).withColumn("part", F.lit("first")))


def _late_batches_sql(part: str, only: str) -> str:
    return f"""SELECT '{part}' AS part, entity, class, doc_id, y, ((row_number() OVER (PARTITION BY y ORDER BY {hash_sql('doc_id', 2)}, doc_id) - 1) // 16)::INTEGER AS batch
       FROM r WHERE entity IN (SELECT entity FROM late){only}"""


@query(
    "k_late_batches",
    f"""WITH r AS (SELECT doc_id % 50 AS entity, (doc_id % 9)::INTEGER AS class, doc_id, (doc_id % 3 = 0)::INTEGER AS y FROM documents),
          late AS (SELECT DISTINCT entity FROM r WHERE class = 6)
        {_late_batches_sql('all', '')} UNION ALL {_late_batches_sql('first', ' AND class = 0')}""",
)
def k_late_batches(spark, d):
    """Balanced batches of the late cohort, over all its classes and over class 0 alone."""
    r = table(spark, d, "documents").select(
        (F.col("doc_id") % 50).alias("entity"), (F.col("doc_id") % 9).cast("int").alias("class"), "doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("y")
    )
    parts = []
    for part, only_first in (("all", False), ("first", True)):
        batches = K.balanced_batches(K.late_cohort(r, "entity", "class", only_first=only_first), "y", "doc_id", 16, epoch=2)
        parts.append(batches.select(F.lit(part).alias("part"), "entity", "class", "doc_id", "y", "batch"))
    return parts[0].unionByName(parts[1])


@query(
    "k_epoch_shuffle",
    f"SELECT event_id, row_number() OVER (ORDER BY {hash_sql('event_id', 7)}, event_id) AS place FROM events",
)
def k_epoch_shuffle(spark, d):
    return K.epoch_order(table(spark, d, "events").select("event_id"), [], "event_id", 7, "place")


@query("m_gp_interpolate")
def m_gp_interpolate(spark, d):
    """Posterior mean and two draws of every user's readings around the first error."""
    ev = table(spark, d, "events").select("user_id", "ts", "value", "event_type")
    near = I.around_index(ev, first_error(ev), "user_id", "ts", "t0", 48, 7)
    long = near.select(
        "user_id", (T.hours_between("t0", "ts") + 48).alias("t"), var_id().alias("var_id"), ((F.col("value") - 50) / 50).alias("value")
    )
    long = R.tail_n(long, "user_id", ["t", "var_id", "value"], 250)
    grid = R.entity_grid(long.groupBy("user_id").agg(F.max("t").alias("end_time")), "user_id", "end_time")
    out = M.gp_interpolate(
        long, grid, "user_id", "t", "var_id", "value", "grid_time", M.starting_params(len(EVENT_TYPES), 3), draws=2
    )
    return out.withColumn("value", F.round("value", 6))


# A scalar filter forwards and a smoother backwards, row by row; rows of one moment are steps without decay.
OU_SQL = """
WITH RECURSIVE o AS (
  SELECT user_id, epoch_us(ts) / 3.6e9 - 473352.0 AS t, (value - 50) / 50 AS y FROM events),
g AS (SELECT user_id, unnest(range(0, 720, 6))::DOUBLE AS t, NULL::DOUBLE AS y FROM (SELECT DISTINCT user_id FROM events)),
s AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, exp(-(t - lag(t) OVER w) / 10) AS a
  FROM (SELECT * FROM o UNION ALL SELECT * FROM g) WINDOW w AS (PARTITION BY user_id ORDER BY t, y)),
f AS (
  SELECT user_id, k, 0.0::DOUBLE AS ahead, 1.0::DOUBLE AS wide,
         CASE WHEN y IS NULL THEN 0.0 ELSE y / 1.201 END AS m, CASE WHEN y IS NULL THEN 1.0 ELSE 1 - 1 / 1.201 END AS p FROM s WHERE k = 1
  UNION ALL
  SELECT x.user_id, x.k, x.ahead, x.wide, CASE WHEN x.y IS NULL THEN x.ahead ELSE x.ahead + x.wide / (x.wide + 0.201) * (x.y - x.ahead) END,
         CASE WHEN x.y IS NULL THEN x.wide ELSE x.wide - x.wide * x.wide / (x.wide + 0.201) END
  FROM (SELECT s.user_id, s.k, s.y, s.a * f.m AS ahead, s.a * s.a * f.p + 1 - s.a * s.a AS wide FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1) AS x),
step AS (
  SELECT s.user_id, s.k, s.n, s.t, s.y, f.m, f.p, lead(s.a) OVER w AS a, lead(f.ahead) OVER w AS ahead, lead(f.wide) OVER w AS wide
  FROM s JOIN f ON f.user_id = s.user_id AND f.k = s.k WINDOW w AS (PARTITION BY s.user_id ORDER BY s.k)),
b AS (
  SELECT user_id, k, t, y, m AS mean, p AS variance FROM step WHERE k = n
  UNION ALL
  SELECT x.user_id, x.k, x.t, x.y, x.m + x.p * x.a / x.wide * (b.mean - x.ahead), x.p + (x.p * x.a / x.wide) * (x.p * x.a / x.wide) * (b.variance - x.wide)
  FROM b JOIN step AS x ON x.user_id = b.user_id AND x.k = b.k - 1)
SELECT user_id, t, round(mean, 6) + 0.0 AS mean, round(variance, 6) AS variance FROM b WHERE y IS NULL
"""


@query("m_gp_mean_ou", OU_SQL)
def m_gp_mean_ou(spark, d):
    """Posterior mean and variance of every user's readings, as one feature, every six hours of the month."""
    ev = table(spark, d, "events")
    hour = T.hours_between(F.lit("2024-01-01").cast("timestamp"), "ts")
    long = ev.select("user_id", hour.alias("t"), F.lit(0).alias("var_id"), ((F.col("value") - 50) / 50).alias("value"))
    grid = ev.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(714), F.lit(6))).alias("grid_time"))
    params = {"fast": [[0.0]], "slow": [[1.0]], "noise": [0.2], "fast_length": 0.5, "slow_length": 10.0}
    out = M.gp_marginals(long, grid, "user_id", "t", "var_id", "value", "grid_time", params)
    return out.select("user_id", "t", (F.round("mean", 6) + 0.0).alias("mean"), F.round("variance", 6).alias("variance"))


def labelled_vectors(spark, d):
    """Last 25 hours of each user's grid as one vector, and whether a large error occurs."""
    ev = table(spark, d, "events")
    y = ev.groupBy("user_id").agg(F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 150), 1).otherwise(0)).alias("y"))
    grid = aligned(spark, d).withColumns({"top": F.col("top") / 100, "cents": F.col("cents") / 10000})
    # A fit reads its rows several times.
    return durable(R.flatten_vector(grid, "user_id", "position", ["top", "cents"]).join(y, "user_id"))


@query("m_logreg_gradient", "SELECT i::INTEGER AS feature, 0.0::DOUBLE AS gradient FROM range(-1, 50) AS t(i)")
def m_logreg_gradient(spark, d):
    """Gradient of the baseline's penalised loss at its fitted weights: zero to four places, feature by feature."""
    train = labelled_vectors(spark, d).join(user_split(spark, d).where("split = 'train'"), "user_id", "left_semi")
    return M.logistic_gradient(train, "vector", "y").select("feature", F.abs(F.round(F.col("gradient") / F.coalesce("scale", F.lit(1.0)), 4)).alias("gradient"))


@query("m_logreg")
def m_logreg(spark, d):
    """Logistic scores of all users from the last 25 hours of their grid, trained on the train split."""
    rows = labelled_vectors(spark, d)
    train = rows.join(user_split(spark, d).where("split = 'train'"), "user_id", "left_semi")
    return M.logistic_baseline(train, rows, "vector", "y").select("user_id", "y", F.round("score", 6).alias("score"))
