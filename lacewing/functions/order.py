"""Places in an order, without bringing a group's rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacewing.functions.lineage import cut


def numbered(rows: DataFrame, group: list[str], order: list[str], place: str, size: str | None = None) -> DataFrame:
    """Rows with their place (a long, from 0) within their group (columns without nulls) by order, ascending with nulls first, and the group's size if
    it is named.

    Rows are dealt to ranges of (group, order) and counted there; only these counts are summed over a group. Rows that are equal in all of
    these columns are spread over ranges too, and stand in any order.
    """
    part, spread, own, before, total = "_part", "_spread", "_own", "_before", "_total"
    dealt = rows.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(*group, *order, spread)
    dealt = cut(dealt.drop(spread).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(*group, part).agg(F.count("*").alias("_k"))
    whole = Window.partitionBy(*group)  # one row a range
    upto = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, part, F.coalesce(F.sum("_k").over(upto), F.lit(0)).alias(before), F.sum("_k").over(whole).alias(total))
    within = Window.partitionBy(*group, part).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    placed = dealt.withColumn(own, F.row_number().over(within)).join(counts, [*group, part])
    sized = [] if size is None else [F.col(total).alias(size)]
    return placed.select(*rows.columns, (F.col(before) + F.col(own) - 1).alias(place), *sized)
