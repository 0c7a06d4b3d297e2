"""Pages of a sorted table: a directory, computed once, tells the few parts that hold a page."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a part, about.
PART_ROWS = 50_000
#: Bits of monotonically_increasing_id() that count the rows of a task.
ROW_BITS = 33


def write_pages(rows: DataFrame, keys: list[str], folder: str, part_rows: int = PART_ROWS) -> Pages:
    """Writes the rows in the order of the keys, in parts by ranges of them, and a directory of the parts.

    Every row gets its part and its place in it, so pages neither overlap nor miss a row where keys repeat; nulls come first.
    The columns `part` and `pos` are taken.
    """
    parts = max(1, -(-rows.count() // part_rows))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = placed.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))})
    placed.write.partitionBy("part").parquet(f"{folder}/rows")
    spark = rows.sparkSession
    held = spark.read.schema(placed.schema).parquet(f"{folder}/rows")
    key = F.struct(*keys)
    held.groupBy("part").agg(F.count("*").alias("n"), F.max_by(key, "pos").alias("last")).coalesce(1).write.parquet(f"{folder}/directory")  # a row for each part
    return Pages(spark, folder, keys)


def rank(key) -> list[tuple]:
    """A key that Python orders as Spark does: nulls first, texts by code point."""
    return [(v is not None, v) if v is not None else (False, 0) for v in key]


class Pages:
    """The pages of a folder of write_pages(); a page opens only the parts that hold its rows."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder, keys
        rows = sorted(spark.read.parquet(f"{folder}/directory").collect(), key=lambda r: r["part"])  # a row for each part
        self.parts, self.last = [r["part"] for r in rows], [rank(r["last"]) for r in rows]
        self.ends = list(accumulate(r["n"] for r in rows))
        self.schema = spark.read.parquet(f"{folder}/rows").schema if rows else None

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def rows(self, start: int, stop: int) -> DataFrame:
        """The rows start ... stop - 1 of the order, with part and pos."""
        first, end = bisect_right(self.ends, start), bisect_right(self.ends, max(start, stop - 1))
        wanted = self.parts[first : end + 1] if start < stop else []
        if not wanted:
            held = self.spark.read.parquet(f"{self.folder}/rows") if self.parts else self.spark.createDataFrame([], "part int, pos long")
            return held.limit(0)
        at = self.ends[first - 1] if first else 0
        read = self.spark.read.option("basePath", f"{self.folder}/rows").schema(self.schema).parquet(*(f"{self.folder}/rows/part={p}" for p in wanted))
        inside = F.lit(False)
        for p, end_of in zip(wanted, self.ends[first : end + 1], strict=True):
            inside |= (F.col("part") == p) & (F.col("pos") >= max(0, start - at)) & (F.col("pos") < stop - at)
            at = end_of
        return read.where(inside).orderBy("part", "pos")

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number` (from 0) of `size` rows; the last may be short, one beyond it is empty."""
        return self.rows(number * size, (number + 1) * size).drop("part", "pos")

    def after(self, key: tuple, size: int) -> DataFrame:
        """The next `size` rows whose key is greater than this one: no count of rows before it is needed."""
        first = bisect_right(self.last, rank(key))
        if first == len(self.parts):
            return self.rows(0, 0).drop("part", "pos")
        stop = first + 1  # the first part may hold one row of the page only
        while stop < len(self.parts) and self.ends[stop - 1] - self.ends[first] < size:
            stop += 1
        read = self.spark.read.option("basePath", f"{self.folder}/rows").schema(self.schema).parquet(*(f"{self.folder}/rows/part={p}" for p in self.parts[first:stop]))
        greater, same = F.lit(False), F.lit(True)
        for name, value in zip(self.keys, key, strict=True):
            above = F.col(name).isNotNull() if value is None else F.coalesce(F.col(name) > F.lit(value), F.lit(False))
            greater |= same & above
            same &= F.col(name).eqNullSafe(F.lit(value))
        return read.where(greater).orderBy("part", "pos").limit(size).drop("part", "pos")
