"""Sliding windows over the genome."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places that are gone through together. A row goes to the one or two such stretches where it is seen, not to each window.
STRETCH = 9000


def window_starts(pos: Column, width: int, step: int, length: Column) -> Column:
    """Starts (1, 1 + step, ...) of the windows that hold a position and end within the genome; an array, empty if there is none."""
    first = F.greatest(F.lit(0), F.ceil((pos - width) / step)).cast("long")
    last = F.least(F.floor((pos - 1) / step), F.floor((length - width) / step)).cast("long")
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: i * step + 1)).otherwise(F.array().cast("array<bigint>"))


def seen_from(rows: DataFrame, place: str, values: list[str], back: int, ahead: int, every: int, last: Column | None = None) -> DataFrame:
    """(cluster, start, values): sums over the rows with places from start - back to start + ahead, null where all are, for the starts 1, 1 + every, ... up to last that
    see any row.

    rows: cluster, place (a long from 1 on), values. Each stretch's starts come with its first row, and the rows that a start sees are summed up in their order, so neither
    windows nor starts are listed for each row, and no sum is a difference of larger ones.
    """
    stretch = lambda p: F.floor((p - 1) / STRETCH)
    held = F.sequence(F.greatest(F.lit(0), stretch(F.col(place) - ahead)), stretch(F.col(place) + back))
    dealt = rows.select("cluster", F.col(place).alias("start"), *values, F.explode(held).alias("stretch"))
    begin, end = F.ceil(F.col("stretch") * STRETCH / every), F.ceil((F.col("stretch") + 1) * STRETCH / every) - 1
    if last is not None:
        dealt = dealt.withColumn("last", last)
        end = F.least(end, F.floor((F.col("last") - 1) / every))
    of = Window.partitionBy("cluster", "stretch")
    starts = F.when((F.row_number().over(of.orderBy("start")) == 1) & (begin <= end), F.transform(F.sequence(begin, end), lambda i: i * every + 1)).otherwise(F.array().cast("array<bigint>"))
    listed = dealt.withColumn("starts", starts).select("cluster", "stretch", *values, F.posexplode(F.concat(F.array("start"), "starts")).alias("at", "start"))
    own = F.col("at") == 0
    once = listed.groupBy("cluster", "stretch", "start").agg(*[F.sum(F.when(own, F.col(v))).alias(v) for v in values], F.count_if(own).alias("seen"), F.max(~own).alias("asked"))
    within = of.orderBy("start").rangeBetween(-back, ahead)
    sums = once.select("cluster", "start", "asked", *[F.sum(v).over(within).alias(v) for v in [*values, "seen"]])
    return sums.where("asked and seen > 0").select("cluster", "start", *values)


def summed(rows: DataFrame, place: str, values: list[str], length: Column, width: int = 300, step: int = 3) -> DataFrame:
    """(cluster, start, values): sums by window (see window_starts) of the rows (cluster, place, values) that it holds; windows without any are left out."""
    unit = math.gcd(width, step)  # windows consist of whole pieces of so many places
    placed = rows.where(F.col(place) >= 1).withColumn(place, F.floor((F.col(place) - 1) / unit) * unit + 1)
    return seen_from(placed, place, values, 0, width - unit, step, length - width + 1)


def sliding_counts(rows: DataFrame, length: Column, width: int = 300, step: int = 3) -> DataFrame:
    """(cluster, start, n_ns, n_s, ratio): distinct variants of either effect by window. rows: cluster, pos, effect."""
    variants = rows.select("cluster", "pos", "effect").distinct()
    counted = variants.select("cluster", "pos", *[(F.col("effect") == e).cast("long").alias(f"n_{e.lower()}") for e in ("NS", "S")])
    n = summed(counted, "pos", ["n_ns", "n_s"], length, width, step)
    return n.withColumn("ratio", F.try_divide(F.col("n_ns").cast("double"), F.col("n_s")))


def smoothed(windows: DataFrame, value: str, width: int = 300, step: int = 3) -> DataFrame:
    """(cluster, pos, mean): mean of a value over the windows that hold each position; null values don't count. Windows begin at 1, 1 + step, ..."""
    unit = math.gcd(width, step)
    rows = windows.select("cluster", "start", F.col(value).cast("double").alias("total"), F.col(value).isNotNull().cast("long").alias("n"))
    pieces = seen_from(rows, "start", ["total", "n"], width - unit, 0, unit)
    return pieces.select("cluster", F.explode(F.sequence(F.col("start"), F.col("start") + unit - 1)).alias("pos"), F.try_divide("total", "n").alias("mean"))
