"""Dense global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomgraph.session import materialize


def with_row_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based position of every row in the given order.

    A range-partitioned sort numbers rows inside each partition; the partition sizes (one
    small row per partition, whatever the data size) give the offsets, which are broadcast. The sorted rows are
    checkpointed because both passes must see the same partition bounds.
    """
    placed = materialize(
        df.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mono", 33)
    local = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_mono", "_part", "_offset")
    )


def with_running_sums(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """For each name the sum of its value over this row and all before it in the given order, by
    the same sort; a partition's running sums start where the partitions before it end."""
    placed = materialize(df.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id()).withColumns(
        {f"_v_{n}": v for n, v in values.items()}))
    placed = placed.withColumn("_part", F.shiftright("_mono", 33))
    sizes = placed.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    within = W.partitionBy("_part").orderBy("_mono").rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "_part").withColumns({n: F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(within) for n in values})
    return out.select(*df.columns, *values)
