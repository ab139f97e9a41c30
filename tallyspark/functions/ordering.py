"""Places in an order, without one task for a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage

#: Rows of a group that one task sorts; larger groups are dealt out.
GROUP_ROWS = 100_000


def positions_within(rows: DataFrame, by: list[str], order: list[Column], name: str = "position", most: int = GROUP_ROWS) -> DataFrame:
    """Adds each row's place (from 1) in its group, nulls first; equal rows are placed in any order. Null groups are groups.

    Groups of up to `most` rows are numbered in a task each; the rows of larger ones are dealt out
    in ranges of the order, and a range is numbered from the number of the group's rows before it.
    """
    cols = {f"_o{j}": c for j, c in enumerate(order)}
    numbered = lambda df: df.withColumns(cols).withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*cols))).select(*rows.columns, name)
    large = cut_lineage(rows.groupBy(*by).agg(F.count("*").alias("_size")).where(F.col("_size") > most).select(*[F.col(c).alias(f"_b{j}") for j, c in enumerate(by)], F.lit(True).alias("_large")))
    if large.isEmpty():
        return numbered(rows)
    on = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(large[f"_b{j}"]) for j, c in enumerate(by)], F.lit(True))
    return numbered(rows.join(large, on, "left_anti")).unionByName(_over_ranges(rows.join(large, on, "left_semi"), by, cols, name))


def ranges(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows dealt out in ranges of group and order, with the number of the range. What is equal may span ranges too.

    Ranges depend on samples and are kept, or counts and rows could see different ones.
    """
    dealt = cut_lineage(rows).withColumn("_salt", F.rand(11)).repartitionByRange(*by, *order, "_salt").drop("_salt")
    return cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))


def _over_ranges(rows: DataFrame, by: list[str], cols: dict[str, Column], name: str) -> DataFrame:
    ranged = ranges(rows.withColumns(cols), by, list(cols))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_b{j}") for j, c in enumerate(by)], F.coalesce(before, F.lit(0)).alias("_start"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b{j}")) for j, c in enumerate(by)], F.col("_range") == F.col("_r"))
    here = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*cols))
    placed = ranged.withColumn("_here", here).join(starts, same)
    return placed.withColumn(name, (F.col("_start") + F.col("_here")).cast("int")).select(*[c for c in rows.columns if c not in cols], name)
