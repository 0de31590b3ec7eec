"""Coding sequence: places in reading frames with a ribosomal slip, codons, and what variants do to amino acids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def standard_code() -> dict[str, str]:
    """Codons to amino acids: the standard code's letters are listed with bases in the order T, C, A, G."""
    letters = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"  # fixed values, NCBI table 1
    return {a + b + c: letters[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def amino(codon: Column) -> Column:
    """A codon's amino acid; null for other text."""
    return F.create_map(*[F.lit(x) for pair in standard_code().items() for x in pair])[codon]


def offset_in_frame(pos: Column, first: Column, name: Column, slip: tuple[str, int] | None) -> Column:
    """Place of a position in its frame, from 1. slip: a frame's name and the place in it that is read twice; what follows is one place later."""
    place = pos - first + 1
    return place if slip is None else place + F.when((name == slip[0]) & (place > slip[1]), 1).otherwise(0)


def codon_position(pos: Column, first: Column, name: Column, slip: tuple[str, int] | None) -> Column:
    """1 to 3; null for the position that is read twice."""
    codon = ((offset_in_frame(pos, first, name, slip) - 1) % 3 + 1).cast("int")
    return codon if slip is None else F.when(~((name == slip[0]) & (pos - first + 1 == slip[1])), codon)


def coding_positions(frames: DataFrame, genome: DataFrame, slip: tuple[str, int] | None = None) -> DataFrame:
    """(idx, pos, orf, base, gene, place): the bases of the coding frames one after the other, by their first position, numbered from 1. gene is the frame's
    number (column orf of frames), place the base's own number in it. The slip's position has two rows, and so has one in two frames.

    Frames are laid out to positions, so bases come by an equi-join. Spark takes what was laid out for as small as the frames, so it is told not to broadcast it.
    """
    extra = F.lit(0) if slip is None else F.when(F.col("name") == slip[0], 1).otherwise(0)
    genes = frames.where("region = 'CDS'").withColumn("length", F.col("last") - F.col("first") + 1 + extra)
    earlier = Window.orderBy("first", "name").rowsBetween(Window.unboundedPreceding, -1)  # one row a gene
    genes = genes.withColumn("before", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    laid = genes.select("name", "orf", "first", "before", F.explode(F.sequence("first", "last")).alias("pos"))
    place = offset_in_frame(F.col("pos"), F.col("first"), F.col("name"), slip)
    twice = F.lit(False) if slip is None else (F.col("name") == slip[0]) & (F.col("pos") - F.col("first") + 1 == slip[1])
    laid = laid.withColumn("place", F.explode(F.when(twice, F.array(place, place + 1)).otherwise(F.array(place))))
    rows = laid.hint("merge").join(genome, "pos")
    return rows.select((F.col("before") + F.col("place")).cast("long").alias("idx"), "pos", F.col("name").alias("orf"), "base", F.col("orf").alias("gene"), F.col("place").cast("long").alias("place"))


def codons(coding: DataFrame) -> DataFrame:
    """(gene, codon, at, b0, b1, b2, p0, p1, p2) of the whole codons of each gene, numbered from 0 within it: the index of the first base, bases and positions."""
    slot = (F.col("place") - 1) % 3
    of = lambda i: F.when(slot == i, F.struct("base", "pos"))
    rows = coding.groupBy("gene", F.expr("(place - 1) div 3").alias("codon")).agg(F.min("idx").alias("at"), *[F.max(of(i)).alias(f"x{i}") for i in range(3)])
    rows = rows.where("x0.base is not null and x1.base is not null and x2.base is not null")
    return rows.select("gene", "codon", "at", *[F.col(f"x{i}.base").alias(f"b{i}") for i in range(3)], *[F.col(f"x{i}.pos").alias(f"p{i}") for i in range(3)])


def effects(variants: DataFrame, coding: DataFrame) -> DataFrame:
    """(pos, ref, alt, orf, codon_position, amino, amino_mutated, effect, changes, ref_mismatch) of variants (pos, ref, alt) in whole codons.

    A variant goes to the last gene that has its position. On the position that the slip reads twice it stands in both places, which may be in two codons: then
    its codon position is null and amino acids are those of both. effect is NS if any amino acid is another, else S; changes lists those, as orf.12A>B.
    ref_mismatch: the reference has another base there than ref. Variants outside of whole codons have no row.

    Codons come by equi-joins on gene and number; a variant meets two of them at most.
    """
    last = coding.groupBy("pos").agg(F.max("gene").alias("gene"))
    hits = variants.select("pos", "ref", "alt").distinct().join(coding.join(last, ["pos", "gene"]), "pos")
    key = ["pos", "ref", "alt", "orf", "gene"]
    touched = hits.withColumn("codon", F.expr("(place - 1) div 3")).groupBy(*key, "codon").agg(F.max(F.col("base") != F.col("ref")).alias("off"), F.min("place").alias("place"), F.count("*").alias("n"))
    rows = touched.join(codons(coding), ["gene", "codon"])
    before = F.concat("b0", "b1", "b2")
    after = F.concat(*[F.when(F.col(f"p{i}") == F.col("pos"), F.col("alt")).otherwise(F.col(f"b{i}")) for i in range(3)])
    rows = rows.select(*key, "codon", "off", "place", "n", amino(before).alias("a"), amino(after).alias("b")).where("a is not null and b is not null")
    met = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("codon", "a", "b"))).alias("met"), F.max("off").alias("ref_mismatch"), F.sum("n").alias("n"), F.min("place").alias("place"))
    other = F.filter("met", lambda x: x["a"] != x["b"])
    letters = lambda c: F.array_join(F.transform("met", lambda x: x[c]), "")
    change = lambda x: F.concat(F.col("orf"), F.lit("."), (x["codon"] + 1).cast("string"), x["a"], F.lit(">"), x["b"])
    return met.select(
        "pos", "ref", "alt", "orf",
        F.when(F.col("n") == 1, ((F.col("place") - 1) % 3 + 1).cast("int")).alias("codon_position"),
        letters("a").alias("amino"), letters("b").alias("amino_mutated"),
        F.when(F.size(other) > 0, "NS").otherwise("S").alias("effect"),
        F.transform(other, change).alias("changes"), "ref_mismatch",
    )


def with_noncoding(variants: DataFrame, found: DataFrame) -> DataFrame:
    """Variants (pos, ..) with the effect of those that are coding, and NC for the others."""
    return variants.join(found.select("pos", "effect"), "pos", "left").withColumn("effect", F.coalesce("effect", F.lit("NC")))
