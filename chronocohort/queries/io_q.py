"""Source and sink queries: everything is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronocohort.functions import timefn as T
from chronocohort.queries.registry import query, table
from chronocohort.queries.reshape_q import LONG, _series_sql, as_text, long_series
from chronocohort.queries.sampling_q import SPLIT, user_split
from chronocohort.operators import reshape as R
from chronocohort.session import scratch_path
from chronocohort.sources import io


@query(
    "io_sql_scan",
    """SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY 1""",
)
def io_sql_scan(spark, d):
    text = """SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM {events}
              WHERE ts >= TIMESTAMP_NTZ '2024-01-08 00:00:00' GROUP BY event_type"""
    return io.query(spark, text, events=table(spark, d, "events"))


@query("io_ctas", "SELECT c_mktsegment, c_nationkey, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1, 2")
def io_ctas(spark, d):
    built = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("top")
    )
    return io.refresh_table(built, "chronocohort_segments", scratch_path(spark, "ctas"))


@query(
    "io_insert_typed",
    """SELECT o_orderkey::INTEGER AS stay, o_orderdate AS intime, (date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) * 24)::DOUBLE AS hours FROM orders""",
)
def io_insert_typed(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) * 24
    )
    schema = "stay int, intime timestamp_ntz, hours double"
    return io.insert_typed(o, "chronocohort_stays", schema, scratch_path(spark, "insert"))


@query(
    "io_typed_sink",
    "SELECT event_id::INTEGER AS event_id, ts, value::DECIMAL(10,2)::DOUBLE AS value FROM events",
)
def io_typed_sink(spark, d):
    types = {"event_id": "int", "ts": "timestamp_ntz", "value": "decimal(10,2)"}
    ev = io.typed(table(spark, d, "events"), types)
    stored = io.refresh_table(ev, "chronocohort_events", scratch_path(spark, "typed"))
    return stored.withColumn("value", F.col("value").cast("double"))


@query(
    "io_csv_roundtrip",
    "SELECT event_id, user_id, date_trunc('second', ts)::TIMESTAMP AS ts, event_type, value FROM events",
)
def io_csv_roundtrip(spark, d):
    ev = table(spark, d, "events").select(
        "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type", "value"
    )
    path = io.write_csv(ev, scratch_path(spark, "csv"), index=["event_id"])
    schema = "`Unnamed: 0` bigint, event_id bigint, user_id bigint, ts string, event_type string, value double"
    return io.parse_times(io.drop_artefact(io.read_csv(spark, path, schema)), ["ts"])


@query("io_csv_inferred", "SELECT event_id, user_id, date_trunc('second', ts)::TIMESTAMP AS ts, event_type, value FROM events")
def io_csv_inferred(spark, d):
    """The types of the columns read from the file itself."""
    ev = table(spark, d, "events").select("event_id", "user_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    back = io.read_csv(spark, io.write_csv(ev, scratch_path(spark, "csv")))
    # Whole numbers are read as the smallest type that holds the file's values.
    return back.withColumns({"event_id": F.col("event_id").cast("bigint"), "user_id": F.col("user_id").cast("bigint"), "ts": F.col("ts").cast("timestamp_ntz")})


@query(
    "io_split_sink",
    f"""SELECT split, event_type, count(*) AS n, count(DISTINCT e.user_id) AS users FROM events e JOIN ({SPLIT}) s ON e.user_id = s.user_id GROUP BY 1, 2""",
)
def io_split_sink(spark, d):
    ev = table(spark, d, "events")
    path = io.write_splits(ev, user_split(spark, d), "user_id", scratch_path(spark, "splits"))
    parts = [
        io.read_split(spark, path, s)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
        .withColumn("split", F.lit(s))
        for s in ("train", "val", "test")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("io_array_roundtrip", _series_sql(LONG))
def io_array_roundtrip(spark, d):
    path = scratch_path(spark, "arrays")

    def build():
        return R.series_arrays(long_series(spark, d), "user_id", "t", "var_id", "v")

    io.cached_parquet(spark, path, build)
    stored = io.cached_parquet(spark, path, build)
    return stored.select(
        "user_id", F.size("values").alias("n"), as_text("values").alias("vals"), as_text("vars").alias("vars"),
        F.array_min("times").alias("first_t"), F.array_max("times").alias("last_t"),
    )


@query(
    "fn_parse_ts",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END::TIMESTAMP AS parsed FROM events""",
)
def fn_parse_ts(spark, d):
    text = F.when(F.col("event_type") == "error", "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", T.parse_ts(text).alias("parsed"))
