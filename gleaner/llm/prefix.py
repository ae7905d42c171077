"""Running totals over a whole table in a total order, without sending all rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of one partition, about, where a table has many.
ROWS = 4_000_000


def running_totals(df: DataFrame, order: Sequence[Column], totals: dict[str, str], label: str, rows: int = 0) -> DataFrame:
    """Add, for each entry (new column: value column), the inclusive running sum in the given order.

    Rows are range-partitioned by the order and written once, so that partition numbers stay fixed; the sums of
    the partitions, one row for each, give every partition its offset. Ties may fall either way, so pass a total
    order where that matters. An empty table gives an empty table. rows is about how many there are, where that is known.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS)
    placed = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), label)
    sums = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in totals.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in totals])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(v).over(within).alias(f"_run_{k}") for k, v in totals.items()])
    # one row for each shuffle partition: a proven bound
    joined = local.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, *[(F.col(f"_run_{k}") + F.col(f"_off_{k}")).alias(k) for k in totals])
