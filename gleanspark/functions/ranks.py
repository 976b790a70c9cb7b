"""Numbers for rows in an order that spans all partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.sources.storage import stored


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its rows' places from 0 in the order, which must tell all rows apart.

    Rows are sorted over range partitions and counted in each; no window holds more than a partition.
    """
    rows = stored(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())
    before, at = {}, 0
    for part, n in counts:
        before[part] = at
        at += n
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part")) if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + offset
    return rows.withColumn(name, place.cast("long")).drop("_part")
