"""Selection: expected substitutions, and dN/dS by window and over all windows, in the reading frame of coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacewing.operators.coding import amino, codon_position, codons, coding_positions, offset_in_frame, with_noncoding  # noqa: F401 - part of this module's names
from lacewing.operators.contexts import folded
from lacewing.operators.windows import summed, window_starts


def possible_changes(coding: DataFrame) -> DataFrame:
    """(at, change, effect, n): of each whole codon, known by the index of its first base, the single substitutions, folded, that keep (S) or change (NS) its
    amino acid. Codons are those of the genes, as for the effects of variants; a gene's end that makes no codon has none."""
    letters = [F.col(f"b{i}") for i in range(3)]
    every = []
    for i in range(3):
        for alt in "ACGT":
            mutated = F.concat(*[F.lit(alt) if k == i else letters[k] for k in range(3)])
            every.append(F.struct(letters[i].alias("ref"), F.lit(alt).alias("alt"), mutated.alias("mutated")))
    rows = codons(coding).select("at", F.concat(*letters).alias("whole"), F.explode(F.array(*every)).alias("x"))
    rows = rows.where("x.ref <> x.alt").select(
        "at",
        folded(F.concat("x.ref", F.lit(">"), "x.alt")).alias("change"),
        F.when(amino(F.col("whole")) == amino(F.col("x.mutated")), "S").otherwise("NS").alias("effect"),
    )
    return rows.groupBy("at", "change", "effect").agg(F.count("*").alias("n"))


def expected_by_codon(changes: DataFrame, prevalence: DataFrame) -> DataFrame:
    """(cluster, at, e_ns, e_s): possible changes weighed by their prevalence (cluster, change, share) in the cluster."""
    weighed = changes.join(prevalence, "change").withColumn("w", F.col("n") * F.col("share"))
    of = lambda effect: F.sum(F.when(F.col("effect") == effect, F.col("w")).otherwise(0.0))
    return weighed.groupBy("cluster", "at").agg(of("NS").alias("e_ns"), of("S").alias("e_s"))


def expected_windows(by_codon: DataFrame, length: Column, width: int = 300, step: int = 3) -> DataFrame:
    """(cluster, start, e_ns, e_s) of windows over the coding index, which hold the codons whose first base they hold."""
    return summed(by_codon, "at", ["e_ns", "e_s"], length, width, step)


def observed_windows(mutations: DataFrame, coding: DataFrame, length: Column, width: int = 300, step: int = 3) -> DataFrame:
    """(cluster, start, n_ns, n_s, n_always_clonal, n_always_minor, n_mixed): distinct variants (cluster, pos, effect, type) by window of the coding index.

    A variant that has several indices counts once in a window that holds several of them: for each two that follow each other, the windows that hold both take one off.
    """
    kinds = ("always clonal", "always minor", "mixed")
    of = {f"n_{e.lower()}": F.col("effect") == e for e in ("NS", "S")} | {"n_" + k.replace(" ", "_"): F.col("type") == k for k in kinds}
    earlier = F.lag("idx").over(Window.partitionBy("pos").orderBy("idx"))
    places = coding.select("pos", "idx").distinct().withColumn("earlier", earlier)
    rows = mutations.distinct().join(places, "pos").select("cluster", "idx", "earlier", *[F.coalesce(c, F.lit(False)).cast("long").alias(name) for name, c in of.items()])
    counts = summed(rows.drop("earlier"), "idx", list(of), length, width, step)
    twice = rows.where(F.col("idx") - F.col("earlier") < width).withColumn("length", length)
    both = F.array_intersect(*[window_starts(F.col(c), width, step, F.col("length")) for c in ("idx", "earlier")])
    less = twice.select("cluster", F.explode(both).alias("start"), *[(-F.col(name)).alias(name) for name in of])
    return counts.unionByName(less).groupBy("cluster", "start").agg(*[F.sum(name).alias(name) for name in of])


def ratio_of(n_ns: str, n_s: str, e_ns: str, e_s: str) -> Column:
    """(n_ns / n_s) / (e_ns / e_s); null where it isn't defined or not finite."""
    return F.try_divide(F.try_divide(F.col(n_ns).cast("double"), F.col(n_s)), F.try_divide(F.col(e_ns), F.col(e_s)))


def dnds_by_window(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Windows with expected and observed counts (0 where none) and their dN/dS."""
    counts = [c for c in observed.columns if c.startswith("n_")]
    rows = expected.join(observed, ["cluster", "start"], "left").fillna(0, counts)
    return rows.withColumn("dnds", ratio_of("n_ns", "n_s", "e_ns", "e_s"))


def dnds_overall(mutations: DataFrame, by_codon: DataFrame) -> DataFrame:
    """(cluster, n_ns, n_s, e_ns, e_s, dnds) over all of the coding sequence."""
    seen = mutations.select("cluster", "pos", "effect").distinct()
    observed = seen.groupBy("cluster").agg(F.count_if(F.col("effect") == "NS").alias("n_ns"), F.count_if(F.col("effect") == "S").alias("n_s"))
    expected = by_codon.groupBy("cluster").agg(F.sum("e_ns").alias("e_ns"), F.sum("e_s").alias("e_s"))
    return observed.join(expected, "cluster").withColumn("dnds", ratio_of("n_ns", "n_s", "e_ns", "e_s"))
