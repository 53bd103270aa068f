"""Readers and writers: SQL text, tables, CSV, split folders and array series."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from chronocohort.functions.timefn import parse_ts
from chronocohort.operators.ordered import KeyedOrder
from chronocohort.operators.skew import key_join

# Column pandas writes for an unnamed index.
INDEX_ARTEFACT = "Unnamed: 0"


def query(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """The result of SQL text; ``{name}`` in the text refers to a DataFrame passed by name."""
    return spark.sql(text, **tables)


def jdbc_table(
    spark: SparkSession, url: str, table: str, split_column: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """A database table read in ``parts`` parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.options(
        partitionColumn=split_column, lowerBound=low, upperBound=high, numPartitions=parts
    ).load()


def refresh_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace a table with the rows of ``df``, which may come from the old table, and return the table.

    The rows are written under another name first, so a failed write leaves the old table as it was.
    ``path`` is a folder that the old table does not use.
    """
    spark, staged = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(staged)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    return spark.table(name)


def refresh_view(df: DataFrame, name: str) -> DataFrame:
    """Replace a temporary view; nothing is computed until it is read."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Only the listed columns, in this order, cast to the declared types."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def insert_typed(df: DataFrame, name: str, schema: StructType | str, path: str | None = None) -> DataFrame:
    """Create an empty table with a declared schema, then insert the rows by position."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], schema)
    refresh_table(empty, name, path)
    casted = df.toDF(*empty.columns).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema.fields]
    )
    casted.write.insertInto(name)
    return spark.table(name)


def write_csv(df: DataFrame, path: str, index: Sequence[str] = ()) -> str:
    """CSV files with header. ``index`` names columns with a unique order; a leading column then numbers the rows from 0."""
    out = df
    if index:
        ranked = KeyedOrder(df, [], list(index)).row_number(INDEX_ARTEFACT).rows()
        out = ranked.select((F.col(f"`{INDEX_ARTEFACT}`") - 1).alias(INDEX_ARTEFACT), *df.columns)
    out.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """CSV with header. A schema saves the extra pass that inferring types takes."""
    reader = spark.read.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def drop_artefact(df: DataFrame, column: str = INDEX_ARTEFACT) -> DataFrame:
    """Without the index column, if it is there."""
    return df.drop(column)


def parse_times(df: DataFrame, columns: list[str], fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    return df.withColumns({c: parse_ts(F.col(c).cast("string"), fmt) for c in columns})


def write_splits(df: DataFrame, splits: DataFrame, key: str, path: str) -> str:
    """One folder per split of the entities, ``path/split=<name>``; an entity with very many rows is dealt over tasks."""
    key_join(df, splits, key).write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def cached_parquet(spark: SparkSession, path: str, build) -> DataFrame:
    """Rows stored at ``path``; where no finished write is found they are built and stored first."""
    if not _exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
