"""Filtering and recoding of variant calls in long form. A missing frequency is null; a pair without a row has frequency 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Limits of calls."""

    low: float = 0.05
    high: float = 0.90
    alt_count: float = 3
    pvalue: float = 0.01
    coverage: float = 20
    missing: float = 0.25
    frequency: float = 0.03
    mutated: int = 5


LIMITS = Thresholds()


def masked(t: Thresholds = LIMITS) -> Column:
    """Frequency with unreliable calls missing and weak ones 0; a null companion value triggers no rule, and missing goes before 0."""
    return (
        F.when((F.col("coverage") < t.coverage) | (F.col("pvalue") >= t.pvalue), None)
        .when((F.col("alt_count") < t.alt_count) | (F.col("vf") <= t.low), 0.0)
        .otherwise(F.col("vf"))
    )


def binarised(vf: Column, t: Thresholds = LIMITS) -> Column:
    """1 above the clonal limit, 0 up to the detection limit, null between."""
    return F.when(vf <= t.low, 0).when(vf > t.high, 1)


def seen_enough(calls: DataFrame, n: Column, value: str, t: Thresholds = LIMITS) -> DataFrame:
    """Positions that are missing in less than the share of all n samples and present in one at least."""
    missing, present = F.count_if(F.col(value).isNull()), F.count_if(F.col(value) > 0)
    stats = calls.groupBy("pos").agg(missing.alias("missing"), present.alias("present"))
    return stats.where((F.col("missing") / n < t.missing) & (F.col("present") > 0)).select("pos")


def filter_calls(calls: DataFrame, n: Column, t: Thresholds = LIMITS) -> DataFrame:
    """Masked calls of the variants that are seen enough."""
    calls = calls.select("sample", "pos", masked(t).alias("vf"))
    return calls.join(seen_enough(calls, n, "vf", t), "pos", "left_semi")


def clonal_genotypes(calls: DataFrame, n: Column, t: Thresholds = LIMITS, use_alt_count: bool = False) -> DataFrame:
    """States (sample, pos, state) of the variants that are clonal somewhere; intermediate frequencies count as missing.

    use_alt_count: whether weak support makes a call 0, as documented, or is ignored, as the published analysis ran.
    """
    unreliable = (F.col("coverage") < t.coverage) | (F.col("pvalue") >= t.pvalue)
    vf = F.when(unreliable, None).otherwise(F.when(F.col("alt_count") < t.alt_count, 0.0).otherwise(F.col("vf")) if use_alt_count else F.col("vf"))
    calls = calls.select("sample", "pos", vf.alias("vf"))
    clonal = calls.groupBy("pos").agg(F.max("vf").alias("top")).where(F.col("top") > t.high).select("pos")
    states = calls.join(clonal, "pos", "left_semi").select("sample", "pos", binarised(F.col("vf"), t).alias("state"))
    return states.join(seen_enough(states, n, "state", t), "pos", "left_semi")


def frequent(states: DataFrame, n: Column, t: Thresholds = LIMITS) -> DataFrame:
    """(pos, carriers, frequency) of the variants whose share of all samples is above the limit."""
    sums = states.groupBy("pos").agg(F.coalesce(F.sum("state"), F.lit(0)).cast("long").alias("carriers"))
    return sums.withColumn("frequency", F.col("carriers") / n).where(F.col("frequency") > t.frequency)


def ambiguity(vf: Column, t: Thresholds = LIMITS) -> Column:
    """State as a character code: 1, 0, or {0,1} where it is neither or missing."""
    return F.when(vf > t.high, "1").when(vf < t.low, "0").otherwise("{0,1}")


def minor_variants(filtered: DataFrame, t: Thresholds = LIMITS) -> DataFrame:
    """Detected calls (sample, pos) for context counts: never clonal, in samples with more than `mutated` such calls.

    Variants go by their largest frequency, then samples by their number of calls, then variants without a call in these samples; a variant that is
    missing throughout passes the first test and fails the last.
    """
    top = filtered.groupBy("pos").agg(F.coalesce(F.max("vf"), F.lit(float("-inf"))).alias("top"))
    minor = filtered.join(top.where(F.col("top") <= t.high), "pos", "left_semi").where(F.col("vf") > t.low)
    rich = minor.groupBy("sample").agg(F.count("*").alias("n")).where(F.col("n") > t.mutated)
    return minor.join(rich, "sample", "left_semi").select("sample", "pos")
