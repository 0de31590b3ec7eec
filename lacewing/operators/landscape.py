"""Relational analytics over variants, samples and annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacewing.operators.coding import codon_position, offset_in_frame
from lacewing.operators.intervals import covered

#: Detection and clonal limits of the descriptive analyses.
LOW, HIGH = 0.05, 0.90


def sample_counts(calls: DataFrame) -> DataFrame:
    """Per sample: minor and clonal calls, and the mean frequency of the minor ones (0 if none)."""
    minor = (F.col("vf") >= LOW) & (F.col("vf") <= HIGH)
    return calls.groupBy("sample").agg(
        F.count_if(minor).alias("n_minor"),
        F.count_if(F.col("vf") > HIGH).alias("n_clonal"),
        F.coalesce(F.avg(F.when(minor, F.col("vf"))), F.lit(0.0)).alias("mean_minor"),
    )


def week_bin(date: Column) -> Column:
    """Three-week bins of ISO weeks from 16 to 39, below that `<16`, null beyond."""
    week = F.weekofyear(date)
    first = F.floor((week - 16) / 3).cast("int") * 3 + 16
    return F.when(week < 16, "<16").when(week <= 39, F.concat_ws("-", first.cast("string"), (first + 2).cast("string")))


def sample_statistics(counts: DataFrame, collected: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples with counts, collection week and cluster: the residual class SC#4 where a sample has none, null where it has no minor call."""
    cluster = F.when(F.col("n_minor") == 0, None).otherwise(F.coalesce("cluster", F.lit("SC#4")))
    rows = counts.join(collected, "sample").join(samples.select("sample", "clade"), "sample")
    rows = rows.join(samples.select("sample", "cluster"), "sample", "left")
    return rows.withColumns({"cluster": cluster, "week": F.weekofyear("collection_date"), "week_bin": week_bin(F.col("collection_date"))})


def mutation_types(calls: DataFrame) -> DataFrame:
    """(pos, type, true_transition, vf_median) of detected variants: always clonal, always minor, or mixed; of mixed ones, whether a
    call of low frequency (up to 0.20) is among them; median of the detected frequencies."""
    seen = calls.where(F.col("vf") > LOW)
    stats = seen.groupBy("pos").agg(F.max("vf").alias("top"), F.min("vf").alias("least"), F.median("vf").alias("vf_median"), F.count("*").alias("n_calls"))
    kind = F.when(F.col("least") > HIGH, "always clonal").when(F.col("top") <= HIGH, "always minor").otherwise("mixed")
    true = (F.col("least") <= 0.20) & (F.col("top") > HIGH)
    return stats.select("pos", kind.alias("type"), true.alias("true_transition"), "vf_median", "n_calls")


def variant_facts(calls: DataFrame, types: DataFrame, samples: DataFrame, variants: DataFrame) -> DataFrame:
    """Detected calls, minor and clonal ones stacked, with what is known of their variant and sample."""
    minor = calls.where((F.col("vf") > LOW) & (F.col("vf") <= HIGH)).select("sample", "pos", "vf", F.lit("minor").alias("level"))
    clonal = calls.where(F.col("vf") > HIGH).select("sample", "pos", "vf", F.lit("clonal").alias("level"))
    rows = minor.unionByName(clonal).join(types.select("pos", "type"), "pos").join(samples, "sample")
    return rows.join(variants.select("pos", "variant"), "pos").select("sample", "pos", "variant", "vf", "level", "type", "clade", "cluster")


def annotated(positions: DataFrame, frames: DataFrame, slip: tuple[str, int] | None = None) -> DataFrame:
    """Positions with region, reading frame, codon position and offset; of overlapping frames the last wins, none is intergenic.

    slip: a frame's name and the place in it that is read twice, whose codon position is null. Frames are cut at their ends into disjoint stretches, which
    positions meet by bucket.
    """
    hit = covered(positions, frames, ["orf", "name", "region", "first"]).withColumn("x", F.element_at("frames", -1))
    args = (F.col("pos"), F.col("x.first"), F.col("x.name"), slip)
    coding = F.col("x.region") == "CDS"
    return hit.select(
        *positions.columns, F.coalesce("x.region", F.lit("intergenic")).alias("region"), F.coalesce("x.name", F.lit("intergenic")).alias("orf"),
        F.when(coding, codon_position(*args)).alias("codon_position"), F.when(coding, offset_in_frame(*args)).cast("long").alias("offset"),
    )


def contingency(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(first, second, n) for all combinations of levels that occur, zero cells too, and the share within first."""
    cells = rows.groupBy(first, second).agg(F.count("*").alias("n"))
    levels = cells.agg(F.collect_set(second).alias("levels"))  # the levels of one factor
    grid = cells.select(first).distinct().select(first, F.explode(levels.scalar()).alias(second))
    full = grid.join(cells, [first, second], "left").select(first, second, F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(first))))


def substitution_rates(facts: DataFrame, changes: DataFrame, genome: DataFrame, frames: DataFrame) -> DataFrame:
    """(orf, cluster, change, n, content, rate): distinct variants by reading frame, cluster and change, over the frame's count of the changed base."""
    rows = facts.select("pos", "cluster").distinct().join(changes, "pos")
    within = lambda df: covered(df, frames, ["name"]).withColumn("orf", F.explode("frames.name"))
    n = within(rows).groupBy("orf", "cluster", "change").agg(F.count_distinct("pos").alias("n"))
    content = within(genome).groupBy("orf", "base").agg(F.count("*").alias("content"))
    joined = n.withColumn("base", F.substring("change", 1, 1)).join(content, ["orf", "base"])
    return joined.select("orf", "cluster", "change", "n", "content", (F.col("n") / F.col("content")).alias("rate"))


def spread(facts: DataFrame) -> DataFrame:
    """(pos, n_samples, n_clades, class): in how many samples and clades a variant is seen: private, one clade, or several."""
    n = facts.groupBy("pos").agg(F.count_distinct("sample").alias("n_samples"), F.count_distinct("clade").alias("n_clades"))
    kind = F.when(F.col("n_clades") >= 2, ">=2 clades").when(F.col("n_samples") == 1, "private").otherwise("1 clade")
    return n.withColumn("class", kind)


def spread_histogram(facts: DataFrame) -> DataFrame:
    """(cluster, n_samples, n_clades, n, log_n): variants by spread within each cluster."""
    n = facts.where(F.col("cluster").isNotNull()).groupBy("cluster", "pos").agg(F.count_distinct("sample").alias("n_samples"), F.count_distinct("clade").alias("n_clades"))
    cells = n.groupBy("cluster", "n_samples", "n_clades").agg(F.count("*").alias("n"))
    return cells.withColumn("log_n", F.log10("n"))


def box_statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 interquartile ranges) and n by group."""
    q = rows.groupBy(group).agg(F.expr(f"percentile({value}, array(0.25, 0.5, 0.75))").alias("q"), F.count(value).alias("n"))
    q = q.select(group, "n", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inner = rows.join(q, group).where((F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach))
    return inner.groupBy(group, "n", "q1", "q2", "q3").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    """(bin, n) with bins of a fixed width."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))


def pie(rows: DataFrame, category: str, null_label: str) -> DataFrame:
    """Slices by category, null under a label of its own: n, start, end and middle angle, and where a label stands."""
    n = rows.groupBy(F.coalesce(category, F.lit(null_label)).alias("slice")).agg(F.count("*").alias("n"))
    order = Window.orderBy("slice")  # one row a category
    total, upto = F.sum("n").over(Window.partitionBy()), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("end", 2 * F.pi() * upto / total).withColumn("start", F.lag("end", 1, 0.0).over(order))
    middle = (F.col("start") + F.col("end")) / 2
    return n.select("slice", "n", "start", "end", middle.alias("middle"), F.sin(middle).alias("x"), F.cos(middle).alias("y"))


def hit_classes(alleles: DataFrame, length: Column) -> DataFrame:
    """(class, n): positions with one, several and no alleles, of a genome of some length."""
    hits = alleles.groupBy("pos").agg(F.count_distinct("alt").alias("n"))
    both = hits.agg(F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multiple"))
    both = both.withColumn("none", length - F.col("single") - F.col("multiple"))
    return both.unpivot([], ["single", "multiple", "none"], "class", "n")


def multiple_alleles(alleles: DataFrame) -> DataFrame:
    """(pos, n, alleles): positions with more than one allele, listed in their order."""
    found = alleles.groupBy("pos").agg(F.array_sort(F.collect_set("alt")).alias("a"))
    return found.where(F.size("a") > 1).select("pos", F.size("a").cast("long").alias("n"), F.array_join("a", ",").alias("alleles"))


def main_allele(alleles: DataFrame) -> DataFrame:
    """(pos, alt, n_alleles, vf_sum): of each position the allele of the largest summed frequency, the first in order on ties."""
    sums = alleles.groupBy("pos", "alt").agg(F.sum("vf").alias("vf_sum"))
    best = F.max_by("alt", F.struct(F.round("vf_sum", 6), F.lit(0) - F.ascii("alt")))
    return sums.groupBy("pos").agg(best.alias("alt"), F.count("*").alias("n_alleles"), F.max("vf_sum").alias("vf_sum"))


def same_counts(counts: DataFrame) -> DataFrame:
    """Samples with the number of samples that have the same (n_clonal, n_minor)."""
    return counts.withColumn("n_same", F.count("*").over(Window.partitionBy("n_clonal", "n_minor")))
