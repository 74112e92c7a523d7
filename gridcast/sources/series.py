"""Series readers. Schemas are declared, never inferred; the entity of a per-entity file comes from its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import entity_from_path, minute_slot, normalised_entity

SERIES = T.StructType([T.StructField("id_time", T.LongType()), T.StructField("n_bytes", T.DoubleType())])
TIMES = T.StructType([T.StructField("id_time", T.LongType()), T.StructField("time", T.StringType())])


def scan_entities(spark: SparkSession, path: str, file_schema: T.StructType = SERIES) -> DataFrame:
    """id_institution, id_time, n_bytes of a folder with one CSV a entity.

    file_schema must declare every column of the files in order: Spark matches a given schema by position.
    """
    rows = spark.read.schema(file_schema).option("header", True).csv(path)
    return rows.select(entity_from_path().alias("id_institution"), "id_time", "n_bytes")


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """id_time, time of a time-dimension CSV; the text is parsed as UTC."""
    rows = spark.read.schema(TIMES).option("header", True).csv(path)
    return rows.select("id_time", F.to_timestamp("time").alias("time"))


def read_processed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A processed series written as CSV, with its entity ids normalised again."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.withColumn("id_institution", normalised_entity(F.col("id_institution")))


# Adapters: the test tables in the roles of the engine's inputs.


def events(spark: SparkSession, sf_dir: str, entities: int | None = 10) -> DataFrame:
    """event_id, ts, i (entity), nb (integer value) of the events table; entities None: every user is one."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    entity = F.col("user_id") if entities is None else F.col("user_id") % entities
    return rows.select("event_id", "ts", entity.alias("i"), F.round(F.col("value") * 100).cast("long").alias("nb"))


def resample(rows: DataFrame, granularity: str) -> DataFrame:
    """Sums of nb by entity and day, hour or ten minutes: i, day[, hr[, mi]], nb."""
    ts = F.col("ts")
    keys = {"day": F.to_date(ts), "hr": F.hour(ts), "mi": minute_slot(ts)}
    names = ["day", "hr", "mi"][: {"day": 1, "hour": 2, "10min": 3}[granularity]]
    return rows.groupBy("i", *(keys[k].alias(k) for k in names)).agg(F.sum("nb").alias("nb"))


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, day, nb: lineitem quantities by supplier and ship date."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("day")).agg(F.sum(F.col("l_quantity").cast("long")).alias("nb"))
