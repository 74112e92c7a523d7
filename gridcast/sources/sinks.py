"""Writers of window tables, scalers, id lists, metrics and models, and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import wide


def write_windows(windows: DataFrame, path: str, window: str, granularity: str, mode: str = "append") -> None:
    """Windows as Parquet, partitioned so that a read of one split touches only its files."""
    rows = windows.withColumns({"window": F.lit(window), "granularity": F.lit(granularity)})
    rows.write.mode(mode).partitionBy("window", "granularity", "split").parquet(path)


def read_windows(spark: SparkSession, path: str, window: str, granularity: str, split: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path).filter(f"window = '{window}' AND granularity = '{granularity}'")
    return rows if split is None else rows.filter(f"split = '{split}'")


def export_windows_csv(windows: DataFrame, path: str, inputs: int, outputs: int) -> None:
    """One column a step, for readers that can't take arrays."""
    wide(windows, inputs, outputs).write.mode("overwrite").option("header", True).csv(path)


def read_windows_csv(spark: SparkSession, path: str, inputs: int, outputs: int, key: str = "i", key_type: str = "string") -> DataFrame:
    """key, split, win_idx, x, y of windows exported with one column a step."""
    xs, ys = [f"x_{j}" for j in range(inputs)], [f"y_{o}" for o in range(outputs)]
    schema = f"{key} {key_type}, split string, win_idx long, " + ", ".join(f"{c} double" for c in xs + ys)
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(key, "split", "win_idx", F.array(*xs).alias("x"), F.array(*ys).alias("y"))


def write_series_csv(series: DataFrame, path: str) -> None:
    series.write.mode("overwrite").option("header", True).csv(path)


def write_scalers(scalers: DataFrame, path: str, granularity: str) -> None:
    """The scaler registry as a table keyed by granularity and entity."""
    scalers.withColumn("granularity", F.lit(granularity)).write.mode("append").partitionBy("granularity").parquet(path)


def read_scalers(spark: SparkSession, path: str, granularity: str) -> DataFrame:
    """The scalers of one granularity."""
    return spark.read.parquet(path).filter(F.col("granularity") == granularity).drop("granularity")


def write_valid(screened: DataFrame, path: str, key: str = "id") -> None:
    """The entities that passed the screening, as a table of ids."""
    screened.filter(F.col("status") == "valid").select(key).write.mode("overwrite").parquet(path)


def read_valid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows join those already there."""
    metrics.write.mode("append").parquet(path)


def export_metrics_csv(metrics: DataFrame, path: str) -> None:
    """All metric rows as one CSV file with one header; metrics are a few rows a model."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_model(spark: SparkSession, rows: list[tuple[str, str, list[int], list[float]]], path: str) -> None:
    """Weight arrays (model, name, shape, values) as Parquet."""
    spark.createDataFrame(rows, "model string, name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str, model: str) -> dict[str, tuple[list[int], list[float]]]:
    """name -> (shape, values) of one model."""
    rows = spark.read.parquet(path).filter(f"model = '{model}'").collect()
    return {r["name"]: (r["shape"], r["values"]) for r in rows}
