"""Global ordinals without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import settled


def with_ordinals(rows: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """Add ``name``: the place, from 0, of each row in ``order``.

    Rows are dealt by ranges of the order and sorted there; every task numbers
    its own, and the sums of the tasks before it, a row for each, are added.  No
    task sees more than its range.  Rows that tie stand next to each other.
    """
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = settled(dealt.withColumns({"__part": F.spark_partition_id(), "__own": own}))
    counts = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__start"))
    return numbered.join(starts, "__part").withColumn(name, (F.col("__start") + F.col("__own")).cast("long")).drop("__part", "__own", "__start")
