"""Trinucleotide contexts of substitutions: counts over 96 and 6 classes, theoretical shares, and profiles of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Substitutions that are counted as their complement; flanks stay as they are.
FOLDED = {"G>T": "C>A", "G>C": "C>G", "G>A": "C>T", "A>T": "T>A", "A>G": "T>C", "A>C": "T>G"}
CLASSES = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")


def folded(change: Column) -> Column:
    out = change
    for old, new in FOLDED.items():
        out = F.when(change == old, new).otherwise(out)
    return out


def in_context(variants: DataFrame, genome: DataFrame) -> DataFrame:
    """Variants (pos, ref, alt, variant) with their context X[R>A]Y; those at an end of the genome have none and go.

    Neighbours come by equi-joins on the position, so the genome is never ordered in one task.
    """
    left = genome.select((F.col("pos") + 1).alias("pos"), F.col("base").alias("before"))
    right = genome.select((F.col("pos") - 1).alias("pos"), F.col("base").alias("after"))
    change = folded(F.concat("ref", F.lit(">"), "alt"))
    context = F.concat("before", F.lit("["), change, F.lit("]"), "after")
    return variants.join(left, "pos").join(right, "pos").select("pos", "variant", context.alias("context"))


def context_counts(detected: DataFrame, contexts: DataFrame) -> DataFrame:
    """(sample, context, n) of detected calls."""
    return detected.join(contexts, "pos").groupBy("sample", "context").agg(F.count("*").alias("n"))


def rolled_up(counts: DataFrame) -> DataFrame:
    """96 classes to 6: the change within the context."""
    return counts.groupBy("sample", F.substring("context", 3, 3).alias("context")).agg(F.sum("n").alias("n"))


def theoretical(genome: DataFrame) -> DataFrame:
    """(context, n, share): every substitution that the interior positions allow."""
    others = F.explode(F.filter(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: b != F.col("base"))).alias("alt")
    every = genome.select("pos", F.col("base").alias("ref"), others).withColumn("variant", F.lit(""))
    counts = in_context(every, genome).groupBy("context").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # 96 rows


def profiles(counts: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(group, context, n, share): summed counts of the group's samples, normalised within the group."""
    sums = counts.join(groups.where(F.col(group).isNotNull()), "sample").groupBy(group, "context").agg(F.sum("n").alias("n"))
    return sums.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(group))))
