"""Results saved in their order, of which any page is read without the ones before it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Positions:
    """Rows in ranges of an order, and a table with the number of rows in and before each range.

    ``by`` are names of columns, with a minus before those that descend; together they should tell all rows apart.
    """

    rows: DataFrame
    ranges: DataFrame
    by: tuple[str, ...]

    @staticmethod
    def _order(by: tuple[str, ...]) -> list[Column]:
        return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_first(c) for c in by]

    @classmethod
    def save(cls, df: DataFrame, path: str, *by: str, ranges: int | None = None) -> Positions:
        """Sorts ``df`` in ranges (as many as the session's shuffles have, if not told) and counts each of them."""
        order, spark = cls._order(by), df.sparkSession
        dealt = df.repartitionByRange(*order) if ranges is None else df.repartitionByRange(ranges, *order)
        placed = dealt.withColumn("slot", F.spark_partition_id()).sortWithinPartitions(*order)
        placed.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/rows")
        # read with the schema that is known, since a table without rows has no files to find it in
        rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        counts = rows.groupBy("slot").agg(F.count("*").alias("cnt"))
        before = F.coalesce(F.sum("cnt").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
        counts.select("slot", before.alias("start"), "cnt", F.array(*map(F.lit, by)).alias("by")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
        return cls(rows, spark.read.parquet(f"{path}/ranges"), by)

    @classmethod
    def open(cls, spark: SparkSession, path: str, *by: str) -> Positions:
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/ranges"), by)

    def total(self) -> int:
        return self.ranges.agg(F.sum("cnt")).first()[0] or 0

    def page(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """The rows of a page, in order; only the ranges that it touches are read."""
        touched = self.ranges.where(F.col("start") + F.col("cnt") > offset)
        if limit is not None:
            touched = touched.where(F.col("start") < offset + limit)
        first = touched.agg(F.min("start")).first()[0]
        if limit is None:
            slots = self.rows.where(F.col("slot") >= (touched.agg(F.min("slot")).first()[0] or 0)) if first is not None else self.rows.where("false")
        else:
            slots = self.rows.where(F.col("slot").isin([r["slot"] for r in touched.select("slot").collect()]))
        out = slots.orderBy(*self._order(self.by)).drop("slot").offset(offset - (first or 0))
        return out if limit is None else out.limit(limit)

    def starts(self, *keys: str) -> DataFrame:
        """(keys, start, cnt): where the rows of each value of ``keys``, which begin the order, stand and how many there are."""
        parts = self.rows.groupBy("slot", *keys).agg(F.count("*").alias("n"))
        order = self._order(tuple(b for b in self.by if b.lstrip("-") in keys))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = parts.withColumn("before", before).join(F.broadcast(self.ranges.select("slot", "start")), "slot")  # a row a range
        return placed.groupBy(*keys).agg(F.min(F.col("start") + F.col("before")).alias("start"), F.sum("n").alias("cnt"))
