"""The queries of the driver contract, each registered next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is checked by tests on small fixtures instead."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(c: Column | str) -> Column:
    """A value with two decimals as whole hundredths, for comparison as text."""
    return F.rint((F.col(c) if isinstance(c, str) else c) * 100).cast("bigint")


def hash_sql(entity: str, salt: int = 0) -> str:
    return f"((((({entity})::BIGINT + {salt} * 97) % 2147483648) * 2654435761 + {salt}) % 4294967296)"


def age_sql(t: str, ref: str) -> str:
    a = f"age({t}, {ref})"
    return (
        f"(date_part('year', {a}) * 8760.0 + date_part('month', {a}) * 730.0 + date_part('day', {a}) * 24.0"
        f" + date_part('hour', {a}) + round_even(date_part('minute', {a}) / 60.0, 0))::DOUBLE"
    )


# Concepts of the event stream, in a fixed order.
EVENT_TYPES = ["view", "click", "signup", "purchase", "error"]

FIRST_ERROR = "SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'error' GROUP BY user_id"
USER_STAYS = "SELECT user_id, min(ts) AS admit, max(ts) AS discharge FROM events GROUP BY user_id"


def first_error(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "error").groupBy("user_id").agg(F.min("ts").alias("t0"))


def user_stays(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.min("ts").alias("admit"), F.max("ts").alias("discharge"))
