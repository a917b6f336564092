"""Positions in a sorted table, without one window over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.staging import Stage


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with their position (a long from one) in ``order`` among the rows of equal ``keys``; null keys are one key.

    Rows are sorted over range partitions, so a key with many rows is split; a count per partition and key and a
    running sum over these counts make the positions.
    """
    placed = rows.select("*", F.struct(*keys).alias("__key"), *(c.alias(f"__o{i}") for i, c in enumerate(order)))
    by = [F.col("__key"), *(F.col(f"__o{i}") for i in range(len(order)))]
    placed = placed.repartitionByRange(*by).sortWithinPartitions(*by).select(*rows.columns, "__key", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    placed = Stage(rows.sparkSession, "numbered").put("sorted", placed)
    sizes = placed.groupBy("__key", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__part")) - F.col("__n")
    base = sizes.select("__key", "__part", (before - F.col("__first") + 1).alias("__base"))
    return placed.join(base, ["__key", "__part"]).select(*rows.columns, (F.col("__base") + F.col("__at")).alias(name))


def scanned(rows: DataFrame, keys: list[str], order: list[Column], *, before: dict[str, tuple[Column, int]] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with values of what stands before them in ``order`` among the rows of equal ``keys``; null keys are one key.

    ``before`` names arrays of a column's values in up to so many rows directly before, the oldest first; null values are kept.  ``sums`` names sums up to and with
    the row.  Rows are sorted over range partitions, so a key with many rows is split.  A row per partition and key carries the sum and the last values on
    to the next partitions; a partition with fewer rows of a key than are asked for hands on those of the partitions before it too.
    """
    before, sums = before or {}, sums or {}
    values = {f"__b{i}": F.struct(c.alias("v")) for i, (c, _) in enumerate(before.values())} | {f"__s{i}": c for i, c in enumerate(sums.values())}
    placed = rows.select("*", F.struct(*keys).alias("__key"), *(c.alias(f"__o{i}") for i, c in enumerate(order)), *(c.alias(name) for name, c in values.items()))
    by = [F.col("__key"), *(F.col(f"__o{i}") for i in range(len(order)))]
    placed = placed.repartitionByRange(*by).sortWithinPartitions(*by).select(*rows.columns, "__key", *values, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    placed = Stage(rows.sparkSession, "scanned").put("sorted", placed)
    segment = Window.partitionBy("__key", "__part").orderBy("__at")
    own, ends, carries = [], [], []
    tails = placed.select("__key", "__part", *values, "__at")
    parts = Window.partitionBy("__key").orderBy("__part")
    for i, (_, n) in enumerate(before.values()):
        own.append(F.collect_list(f"__b{i}").over(segment.rowsBetween(-n, -1)).alias(f"__own{i}"))
        tails = tails.withColumn(f"__end{i}", F.lead("__at", n).over(segment).isNull())
        ends.append(F.transform(F.sort_array(F.collect_list(F.when(F.col(f"__end{i}"), F.struct("__at", F.col(f"__b{i}").alias("b"))))), lambda x: x["b"]).alias(f"__tail{i}"))
        carries.append(F.flatten(F.collect_list(f"__tail{i}").over(parts.rowsBetween(-n, -1))).alias(f"__tail{i}"))
    for i in range(len(sums)):
        own.append(F.sum(f"__s{i}").over(segment.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__run{i}"))
        ends.append(F.sum(f"__s{i}").alias(f"__sum{i}"))
        carries.append(F.sum(f"__sum{i}").over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__sum{i}"))
    carried = tails.groupBy("__key", "__part").agg(*ends).select("__key", "__part", *carries)
    joined = placed.select(*rows.columns, "__key", "__part", *own).join(carried, ["__key", "__part"])
    last = lambda c, n: F.slice(c, F.greatest(F.lit(1), F.size(c) - (n - 1)), F.lit(n))
    out = [F.transform(last(F.concat(f"__tail{i}", f"__own{i}"), n), lambda x: x["v"]).alias(name) for i, (name, (_, n)) in enumerate(before.items())]
    zero = F.lit(0).cast("long")
    out += [(F.coalesce(f"__sum{i}", zero) + F.coalesce(f"__run{i}", zero)).alias(name) for i, name in enumerate(sums)]
    return joined.select(*rows.columns, *out)


def islands(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, lo, hi): runs of successive whole numbers among the different values of a key.

    Runs are found within range partitions, so a key with many values is split; the first run of a partition goes on the last one of the partitions
    before it if they touch.  Only one row per partition and key is looked at for that.
    """
    each = values.select(*keys, F.col(value).cast("long").alias("__v")).distinct().withColumn("__key", F.struct(*keys))
    placed = Stage(values.sparkSession, "islands").put("sorted", each.repartitionByRange("__key", "__v").select("__key", "__v", F.spark_partition_id().alias("__part")))
    island = placed.withColumn("__run", F.col("__v") - F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__v")))
    runs = island.groupBy("__key", "__part", "__run").agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    parts = Window.partitionBy("__key").orderBy("__part")
    ends = runs.groupBy("__key", "__part").agg(F.min("lo").alias("first"), F.max("lo").alias("last"), F.max("hi").alias("end"))
    ends = ends.withColumn("joins", F.coalesce(F.lag("end").over(parts) + 1 == F.col("first"), F.lit(False)))
    # A partition that is one run and goes on an earlier one hands that one on.
    ends = ends.withColumn("opens", F.when(~F.col("joins") | (F.col("first") < F.col("last")), F.col("last")))
    ends = ends.select("__key", "__part", "first", F.when(F.col("joins"), F.last("opens", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1))).alias("__owner"))
    owned = runs.join(ends, ["__key", "__part"]).withColumn("__owner", F.when(F.col("lo") == F.col("first"), F.coalesce("__owner", "lo")).otherwise(F.col("lo")))
    return owned.groupBy("__key", "__owner").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("__key.*", "lo", "hi")
