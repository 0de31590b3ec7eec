"""Intervals that hold positions, without a join by inequality alone: the axis is cut at their ends, and stretches meet positions by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a bucket.
WIDTH = 1024


def stretches(frames: DataFrame, keep: list[str], width: int = WIDTH) -> DataFrame:
    """(bucket, low, high, frames): disjoint stretches, each with the intervals (first, last, both included) that cover it, as an array of structs of the
    columns to keep, in their order. Stretches end at ends of intervals and of buckets; those that no interval covers are left out, and so are intervals
    with a null end or with last before first."""
    whole = frames.where(F.col("first") <= F.col("last")).select(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.struct(*keep).alias("frame"))
    bucket = lambda c: F.floor(F.col(c) / width)
    dealt = whole.withColumn("bucket", F.explode(F.sequence(bucket("first"), bucket("last"))))
    start = F.col("bucket") * width
    clipped = dealt.select("bucket", "frame", F.greatest("first", start).alias("begin"), F.least("last", start + width - 1).alias("end"))
    ends = clipped.select("bucket", F.explode(F.array(F.col("begin"), F.col("end") + 1)).alias("low")).distinct()
    pieces = ends.withColumn("high", F.lead("low").over(Window.partitionBy("bucket").orderBy("low")) - 1).where("high is not null")
    held = pieces.join(clipped, "bucket").where("begin <= low and high <= end")
    return held.groupBy("bucket", "low", "high").agg(F.sort_array(F.collect_list("frame")).alias("frames"))


def covered(positions: DataFrame, frames: DataFrame, keep: list[str], pos: str = "pos", width: int = WIDTH) -> DataFrame:
    """Positions with `frames`, the intervals that hold them (see stretches), null where none does. A position meets the few stretches of its bucket and
    keeps one of them at most."""
    found = stretches(frames, keep, width).toDF("_bucket", "_low", "_high", "_frames")
    rows = positions.drop("frames").withColumn("_at", F.floor(F.col(pos) / width))
    inside = (F.col("_at") == F.col("_bucket")) & (F.col(pos) >= F.col("_low")) & (F.col(pos) <= F.col("_high"))
    return rows.join(found, inside, "left").select(*[c for c in positions.columns if c != "frames"], F.col("_frames").alias("frames"))
