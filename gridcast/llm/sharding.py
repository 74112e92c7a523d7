"""Contiguous balanced shards by global byte-size prefix sums.

Rows are ordered by (id, text checksum, size). Each range partition sums its own rows, the totals of the partitions
(one row each) give every partition its global offset, and the global byte range is cut at equal targets: a row goes
where its midpoint lies. Law: `bytes`.

Cases: null text counts as no bytes (size 1, checksum 0); null ids come first; equal rows are told apart by their
place in the input, so they get different slots; an empty table gives no rows; other columns aren't carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, released, write_table


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and rows before each row in its partition."""
    size, rows = 0, 0
    for batch in batches:
        own = batch.column("size").to_numpy()
        ends = np.cumsum(own) + size
        before = pa.array(ends - own)
        row = pa.array(np.arange(rows, rows + len(own), dtype=np.int64))
        size, rows = int(ends[-1]) if len(own) else size, rows + len(own)
        yield pa.RecordBatch.from_arrays([*batch.columns, before, row], [*batch.schema.names, "before", "row"])


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.monotonically_increasing_id().alias("at"),
    )
    placed = rows.repartitionByRange("id", "crc", "size", "at").sortWithinPartitions("id", "crc", "size", "at")
    placed = placed.select(F.spark_partition_id().alias("part"), "id", "size", "crc")
    schema = "part int, id long, size long, crc long, before long, row long"
    placed = write_table(placed.mapInArrow(released(_running), schema), "shard")
    totals = placed.groupBy("part").agg(F.sum("size"), F.count("*"))
    offsets, at_size, at_row = [], 0, 0
    for part, part_size, part_rows in sorted(map(tuple, totals.collect())):  # one row a partition
        offsets.append((part, at_size, at_row))
        at_size, at_row = at_size + part_size, at_row + part_rows
    offsets = spark.createDataFrame(offsets, "part int, size_before long, rows_before long")
    middle = 2 * (F.col("size_before") + F.col("before")) + F.col("size")
    cut = F.least(F.lit(shards - 1), F.expr(f"CAST({shards} AS DECIMAL(20,0)) * middle div {2 * max(at_size, 1)}").cast("int"))
    placed = placed.join(F.broadcast(offsets), "part").withColumn("middle", middle)
    placed = placed.select("id", "size", "crc", (F.col("rows_before") + F.col("row")).alias("row"), cut.alias("shard"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # as many rows as shards
    placed = placed.join(F.broadcast(firsts), "shard")
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
