"""Canonical views of variant data over the given tables: calls, genome, samples, annotation and count vectors.

A call is (sample, pos, vf, alt_count, pvalue, coverage): one variant seen in one sample. Pairs without a row are calls of frequency 0;
they are never filled in, as every measure over all samples divides by their number instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases in the order in which numbers stand for them.
BASES = "ACGT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by (sample, pos), of several rows the largest frequency and support and the smallest p-value."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("pos"))
        .agg(
            F.max(F.round(F.col("l_discount") * 10, 1)).alias("vf"),
            F.max("l_quantity").alias("alt_count"),
            F.min("l_tax").alias("pvalue"),
            (F.max("l_extendedprice") / 1000).alias("coverage"),
        )
    )


def n_samples(spark: SparkSession, sf_dir: str) -> Column:
    """Number of samples, as a scalar subquery."""
    return table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_suppkey")).scalar()


def base(number: Column) -> Column:
    return F.substring(F.lit(BASES), 1, 4).substr(number.cast("int") + 1, F.lit(1))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, base), one row a position."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), base(F.col("p_size") % 4).alias("base"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, ref, alt, variant): the substitution of each position, named pos_ref_alt."""
    number = F.col("p_size") % 4
    alt = base((number + 1 + F.col("p_partkey") % 3) % 4)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), base(number).alias("ref"), alt.alias("alt"))
    return rows.withColumn("variant", F.concat_ws("_", F.col("pos").cast("string"), "ref", "alt"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, clade, cluster): clade by nation; cluster by region, null for the regions 3 and 4."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("clade"), "n_regionkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("clade"))
    cluster = F.when(F.col("n_regionkey") < 3, F.concat(F.lit("SC#"), (F.col("n_regionkey") + 1).cast("string")))
    return rows.join(nations, "clade").select("sample", "clade", cluster.alias("cluster"))


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sample: collection_date, median_coverage, total_coverage."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample"))
    return rows.agg(
        F.min(F.to_date("l_shipdate")).alias("collection_date"),
        F.median("l_extendedprice").alias("median_coverage"),
        F.sum("l_extendedprice").alias("total_coverage"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation (orf, first, last, region, name): ten intervals over the genome; two overlap, and a gap is intergenic."""
    length = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("n"))
    rows = length.select("n", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("orf"))
    first = F.expr("cast(orf * n div 10 + 1 - case when orf = 4 then n div 40 else 0 end as bigint)")
    last = F.expr("cast((orf + 1) * n div 10 - case when orf = 6 then n div 40 else 0 end as bigint)")
    region = F.expr("case orf when 0 then '5UTR' when 9 then '3UTR' else 'CDS' end")
    return rows.select("orf", first.alias("first"), last.alias("last"), region.alias("region"), F.concat(F.lit("ORF"), F.col("orf").cast("string")).alias("name"))


def count_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, label, context, x): six non-negative counts a sample, from the first components of its vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), "label", F.posexplode(F.slice("embedding", 1, 6)).alias("context", "x"))
    return rows.select("sample", "label", "context", F.abs(F.col("x").cast("double")).alias("x"))


# The same views for DuckDB.
CALLS = "calls as (select l_suppkey as sample, l_partkey as pos, max(round(l_discount * 10, 1)) as vf, max(l_quantity) as alt_count, min(l_tax) as pvalue, max(l_extendedprice) / 1000 as coverage from lineitem group by 1, 2)"
N = "(select count(distinct l_suppkey) from lineitem)"
VARIANTS = "variants as (select pos, ref, alt, pos || '_' || ref || '_' || alt as variant from (select p_partkey as pos, substr('ACGT', p_size % 4 + 1, 1) as ref, substr('ACGT', ((p_size % 4 + 1 + p_partkey % 3) % 4 + 1)::bigint, 1) as alt from part))"
GENOME = "genome as (select p_partkey as pos, substr('ACGT', p_size % 4 + 1, 1) as base from part)"
SAMPLES = "samples as (select s_suppkey as sample, s_nationkey as clade, case when n_regionkey < 3 then 'SC#' || (n_regionkey + 1) end as cluster from supplier join nation on s_nationkey = n_nationkey)"
COLLECTED = "collected as (select l_suppkey as sample, min(l_shipdate)::date as collection_date, median(l_extendedprice) as median_coverage, sum(l_extendedprice) as total_coverage from lineitem group by 1)"
FRAMES = "frames as (select orf, orf * n // 10 + 1 - case when orf = 4 then n // 40 else 0 end as first, (orf + 1) * n // 10 - case when orf = 6 then n // 40 else 0 end as last, case orf when 0 then '5UTR' when 9 then '3UTR' else 'CDS' end as region, 'ORF' || orf as name from (select max(p_partkey) as n from part), (select unnest(range(10)) as orf))"
VECTORS = "vectors as (select vec_id as sample, label, unnest(range(6)) as context, unnest(list_transform(embedding[1:6], lambda x: abs(x::double))) as x from embeddings)"
