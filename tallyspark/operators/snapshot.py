"""Which projects changed between two file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_within, unit_of_file


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of files(path, sha) that were added, removed or modified; both listings meet in one shuffle."""
    both = old.select("path", F.col("sha").alias("_o"), F.lit(1).alias("_a"), F.lit(0).alias("_b"), F.lit(None).cast("string").alias("_n")).unionByName(new.select("path", F.lit(None).cast("string").alias("_o"), F.lit(0).alias("_a"), F.lit(1).alias("_b"), F.col("sha").alias("_n")))
    g = both.groupBy("path").agg(F.max("_o").alias("_o"), F.max("_n").alias("_n"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    change = F.when(F.col("_a") == 0, "added").when(F.col("_b") == 0, "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "modified")
    return g.select("path", change.alias("change")).where("change IS NOT NULL")


def units(files: DataFrame, scope: str = ".") -> DataFrame:
    """The distinct units of files(path) within a folder."""
    inside = files.where(is_within(F.col("path"), F.lit(scope)))
    return inside.select(unit_of_file(F.col("path")).alias("unit")).where("unit IS NOT NULL").distinct()


#: Rows of a result that one task makes where every row of one table meets every row of another.
TASK_ROWS = 1_000_000


def every_pair(left: DataFrame, right: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Every row of one with every row of the other, where that is what is asked for.

    The larger side is dealt out into parts by its rows' hashes, the smaller one is copied to each;
    counts tell how many parts make tasks of about task_rows rows.
    """
    n, m = left.count(), right.count()
    parts = max(1, min(max(n, m), -(-n * m // task_rows)))
    dealt = lambda df: df.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(parts)).cast("int"))
    copied = lambda df: df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    a, b = (copied(left), dealt(right)) if n < m else (dealt(left), copied(right))
    return a.join(b, "_part").drop("_part")


def readers(reports: DataFrame, models: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(model, report): reports(report, model) that read one of models(model). A report whose model is unknown (null) reads every changed model."""
    known = reports.where("model IS NOT NULL").join(models, "model").select("model", "report")
    unknown = reports.where("model IS NULL").select("report")
    return known.unionByName(every_pair(models.select("model"), unknown, task_rows).select("model", "report"))


def project_runs(changed: DataFrame, models: DataFrame, read: DataFrame, old_units: DataFrame, new_units: DataFrame) -> DataFrame:
    """(path, status): changed units that are no models, and the readers of changed models; a changed model that no report reads is skipped."""
    direct = changed.select("unit").exceptAll(models.select(F.col("model").alias("unit")))
    all_units = direct.union(read.select(F.col("report").alias("unit"))).distinct()
    sides = all_units.join(old_units.select("unit", F.lit(True).alias("_o")).distinct(), "unit", "left").join(new_units.select("unit", F.lit(True).alias("_n")).distinct(), "unit", "left")
    status = F.when(F.col("_o") & F.col("_n"), "changed").when(F.col("_n"), "added").when(F.col("_o"), "removed").otherwise("error")
    runs = sides.select(F.col("unit").alias("path"), status.alias("status"))
    unread = models.join(read, "model", "left_anti").select(F.col("model").alias("unit")).intersect(new_units.select("unit"))
    return runs.unionByName(unread.select(F.col("unit").alias("path"), F.lit("skipped").alias("status")))
