"""Plans for renaming Python files with hyphens in their names, over an inventory of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rename_plan(paths: DataFrame) -> DataFrame:
    """(old_path, new_path) of ``.py`` names with a hyphen; folders and suffix stay."""
    folder, name = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.regexp_extract(name, r"^(.+)\.py$", 1)
    return paths.filter(name.endswith(".py") & name.contains("-") & (stem != "")).select(F.col("path").alias("old_path"), F.concat(folder, F.translate(stem, "-", "_"), F.lit(".py")).alias("new_path")).distinct()


def rename_conflicts(paths: DataFrame) -> DataFrame:
    """The plan with ``status``: a target that exists, or that an earlier path takes, is skipped."""
    plan = rename_plan(paths)
    there = paths.select(F.col("path").alias("new_path")).distinct().withColumn("there", F.lit(True))
    first = F.row_number().over(Window.partitionBy("new_path").orderBy("old_path")) == 1
    status = F.when(F.col("there"), "Target already exists").when(~first, "Target already exists").otherwise("planned")
    return plan.join(there, "new_path", "left").select("old_path", "new_path", status.alias("status"))


def rename_summary(paths: DataFrame) -> DataFrame:
    """(status, files), with the number found as one more row."""
    told = rename_conflicts(paths).groupBy("status").agg(F.count(F.lit(1)).alias("files"))
    found = rename_plan(paths).agg(F.count(F.lit(1)).alias("files")).select(F.lit("found").alias("status"), "files")
    return told.unionByName(found)
