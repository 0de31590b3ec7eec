"""Registered queries and their DuckDB counterparts, from the same definitions but written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.functions.lineage import cut, stored
from lacewing.operators import calls as C
from lacewing.operators import coding as K
from lacewing.operators import contexts as X
from lacewing.operators import landscape as L
from lacewing.operators import phylogeny as P
from lacewing.operators import scan as N
from lacewing.operators import signatures as G
from lacewing.operators import stats as S
from lacewing.operators import windows as W
from lacewing.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Limits of the given tables, whose p-values go from 0 to 0.08.
GIVEN = C.Thresholds(pvalue=0.07)
#: The frame and the place in it that is read twice: the last of one codon and the first of the next.
SLIP = ("ORF1", 15)


def query(oracle: str | None = None, *views: str):
    """Register a query with its DuckDB SQL over views; doubles are rounded to six digits on either side, and none is -0."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

        QUERIES[f.__name__] = run
        if oracle is not None:
            ORACLES[f.__name__] = (f"with {', '.join(views)} " if views else "") + oracle
        return f

    return register


MASKED = "masked as (select sample, pos, case when coverage < 20 or pvalue >= 0.07 then null when alt_count < 3 or vf <= 0.05 then 0 else vf end as vf from calls)"
FILTERED = f"filtered as (select * from masked where pos in (select pos from masked group by pos having sum((vf is null)::int) / {T.N} < 0.25 and sum((vf > 0)::int) > 0))"
UNMASKED = "reliable as (select sample, pos, case when coverage < 20 or pvalue >= 0.07 then null else vf end as vf from calls)"
RAWSTATES = "rawstates as (select sample, pos, case when vf <= 0.05 then 0 when vf > 0.9 then 1 end as state from reliable where pos in (select pos from reliable group by pos having max(vf) > 0.9))"
STATES = f"states as (select * from rawstates where pos in (select pos from rawstates group by pos having sum((state is null)::int) / {T.N} < 0.25 and sum((state > 0)::int) > 0))"
CLONAL = (T.CALLS, UNMASKED, RAWSTATES, STATES)
TOP = "minor as (select sample, pos from filtered where vf > 0.05 and pos in (select pos from filtered group by pos having coalesce(max(vf), -1) <= 0.9)), detected as (select * from minor where sample in (select sample from minor group by sample having count(*) > 5))"
MINOR = (T.CALLS, MASKED, FILTERED, TOP)
FOLD = "case c when 'G>T' then 'C>A' when 'G>C' then 'C>G' when 'G>A' then 'C>T' when 'A>T' then 'T>A' when 'A>G' then 'T>C' when 'A>C' then 'T>G' else c end"
CONTEXTS = f"contexts as (select pos, variant, b.base || '[' || {FOLD} || ']' || a.base as context from (select *, ref || '>' || alt as c from variants) join (select pos + 1 as pos, base from genome) b using (pos) join (select pos - 1 as pos, base from genome) a using (pos))"
COUNTED = (*MINOR, T.GENOME, T.VARIANTS, CONTEXTS, "counts as (select sample, context, count(*) as n from detected join contexts using (pos) group by 1, 2)")
FACTS = "seen as (select pos, case when min(vf) > 0.9 then 'always clonal' when max(vf) <= 0.9 then 'always minor' else 'mixed' end as type, min(vf) <= 0.2 and max(vf) > 0.9 as true_transition, median(vf) as vf_median, count(*) as n_calls from calls where vf > 0.05 group by 1), facts as (select sample, pos, variant, vf, case when vf > 0.9 then 'clonal' else 'minor' end as level, type, clade, cluster from calls join seen using (pos) join samples using (sample) join variants using (pos) where vf > 0.05)"
FACT = (T.CALLS, T.SAMPLES, T.VARIANTS, FACTS)
COUNTS = "counts as (select sample, sum((vf >= 0.05 and vf <= 0.9)::int)::bigint as n_minor, sum((vf > 0.9)::int)::bigint as n_clonal, coalesce(avg(case when vf >= 0.05 and vf <= 0.9 then vf end), 0) as mean_minor from calls group by 1)"
STATISTICS = "statistics as (select sample, n_minor, n_clonal, mean_minor, collection_date, median_coverage, total_coverage, clade, case when n_minor = 0 then null else coalesce(cluster, 'SC#4') end as cluster, week(collection_date)::int as week, case when week(collection_date) < 16 then '<16' when week(collection_date) <= 39 then ((week(collection_date) - 16) // 3 * 3 + 16) || '-' || ((week(collection_date) - 16) // 3 * 3 + 18) end as week_bin from counts join collected using (sample) join samples using (sample))"
STATS = (T.CALLS, T.SAMPLES, T.COLLECTED, COUNTS, STATISTICS)
ORF = f"orf as (select pos, alt, variant, coalesce(name, 'intergenic') as orf, coalesce(region, 'intergenic') as region, case when region = 'CDS' and not (name = '{SLIP[0]}' and o = {SLIP[1]}) then (o + s - 1) % 3 + 1 end::int as codon_position, case when region = 'CDS' then o + s end as offset_ from (select *, pos - first + 1 as o, (name = '{SLIP[0]}' and pos - first + 1 > {SLIP[1]})::bigint as s from variants left join lateral (select * from frames where pos between first and last order by orf desc limit 1) on true))"
ANNOTATED = (T.VARIANTS, T.FRAMES, ORF)
CODE = ", ".join(f"('{codon}', '{amino}')" for codon, amino in K.standard_code().items())
CODING = f"genes as (select orf as gene, name, first, last, coalesce(sum(last - first + 1 + (name = '{SLIP[0]}')::int) over (order by first, name rows between unbounded preceding and 1 preceding), 0)::bigint as before from frames where region = 'CDS'), cds as (select (before + o + (name = '{SLIP[0]}' and o > {SLIP[1]})::int + k)::bigint as idx, (o + (name = '{SLIP[0]}' and o > {SLIP[1]})::int + k)::bigint as place, gene, pos, name as orf, base from (select *, pos - first + 1 as o from genes join genome on pos between first and last), (select unnest([0, 1]) as k) where k = 0 or (name = '{SLIP[0]}' and o = {SLIP[1]}))"
CODONS = f"code(codon_, amino) as (values {CODE}), hits as (select v.pos, v.ref, v.alt, c.gene, c.orf, c.place, c.base from variants v join cds c on c.pos = v.pos where c.gene = (select max(gene) from cds l where l.pos = v.pos)), spelled as (select t.pos, t.alt, t.codon, t.orf, string_agg(c.base, '' order by c.place) as whole, string_agg(case when c.pos = t.pos then t.alt else c.base end, '' order by c.place) as mutated from (select distinct pos, alt, gene, orf, (place - 1) // 3 as codon from hits) t join cds c on c.gene = t.gene and (c.place - 1) // 3 = t.codon group by all having count(*) = 3), met as (select pos, alt, orf, string_agg(x.amino, '' order by codon) as amino, string_agg(y.amino, '' order by codon) as amino_mutated, case when bool_or(x.amino <> y.amino) then 'NS' else 'S' end as effect, coalesce(string_agg(orf || '.' || (codon + 1) || x.amino || '>' || y.amino, '|' order by codon) filter (where x.amino <> y.amino), '') as changes from spelled join code x on x.codon_ = whole join code y on y.codon_ = mutated group by 1, 2, 3), effects as (select m.*, codon_position, ref_mismatch from met m join (select pos, alt, case when count(*) = 1 then (min(place) - 1) % 3 + 1 end::int as codon_position, bool_or(base <> ref) as ref_mismatch from hits group by 1, 2) using (pos, alt))"
EFFECTS = (T.GENOME, T.VARIANTS, T.FRAMES, CODING, CODONS)
ALLELES = "alleles as (select (pos + 1) // 2 as pos, alt, vf from calls join variants using (pos) where vf > 0.05)"
ALLELE = (T.CALLS, T.VARIANTS, ALLELES)
PAIRS = f"top as (select pos, count(*) as carriers, row_number() over (order by count(*) desc, pos) as rank from states where state = 1 group by 1 having count(*) / {T.N} > 0.03), ones as (select sample, pos, rank from states join top using (pos) where state = 1), joint as (select a.pos as a, b.pos as b, count(*) as joint from ones a join ones b using (sample) where a.rank < b.rank group by 1, 2), pairs as (select x.pos as a, y.pos as b, x.rank::int as rank_a, y.rank::int as rank_b, coalesce(joint, 0) as joint, ln(joint * {T.N} / (x.carriers * y.carriers)) as pmi from top x join top y on x.rank < y.rank left join joint on a = x.pos and b = y.pos)"
PAIRED = (*CLONAL, PAIRS)
EDGES = "edges as (select a as parent, b as child, rank_b as rank from pairs qualify row_number() over (partition by b order by round(pmi, 9) desc nulls last, rank_a) = 1)"


def _calls(spark: SparkSession, d: str) -> tuple:
    return T.calls(spark, d), T.n_samples(spark, d)


def _facts(spark: SparkSession, d: str, calls: DataFrame | None = None) -> DataFrame:
    calls = T.calls(spark, d) if calls is None else calls
    return L.variant_facts(calls, L.mutation_types(calls), T.samples(spark, d), T.variants(spark, d))


def _detected(spark: SparkSession, d: str, calls: DataFrame | None = None) -> DataFrame:
    calls = T.calls(spark, d) if calls is None else calls
    return C.minor_variants(C.filter_calls(calls, T.n_samples(spark, d), GIVEN), GIVEN)


def _counts(spark: SparkSession, d: str, calls: DataFrame | None = None) -> DataFrame:
    return X.context_counts(_detected(spark, d, calls), X.in_context(T.variants(spark, d), T.genome(spark, d)))


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    return L.sample_statistics(L.sample_counts(T.calls(spark, d)), T.collected(spark, d), T.samples(spark, d))


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    return L.annotated(T.variants(spark, d).select("pos", "alt", "variant"), T.frames(spark, d), SLIP)


def _coding(spark: SparkSession, d: str) -> DataFrame:
    return K.coding_positions(T.frames(spark, d), T.genome(spark, d), SLIP)


def _effects(spark: SparkSession, d: str) -> DataFrame:
    return K.effects(T.variants(spark, d), _coding(spark, d))


def _states(spark: SparkSession, d: str) -> DataFrame:
    return C.clonal_genotypes(*_calls(spark, d), GIVEN)


def _top(states: DataFrame, n) -> DataFrame:
    """All frequent variants, ranked."""
    return P.ranked(C.frequent(states, n, GIVEN))


def _start_tree(spark: SparkSession, d: str) -> tuple:
    """(states, leading variants, start tree)"""
    states, n = cut(_states(spark, d)), T.n_samples(spark, d)
    top = cut(_top(states, n))
    return states, top, cut(P.start_tree(P.associated(states, top, n), top))


def _alleles(spark: SparkSession, d: str) -> DataFrame:
    """Two positions as two alleles of one, as the tables have one substitution a position."""
    rows = T.calls(spark, d).join(T.variants(spark, d), "pos").where("vf > 0.05")
    return rows.select(F.expr("(pos + 1) div 2").alias("pos"), "alt", "vf")


@query("select * from filtered", T.CALLS, MASKED, FILTERED)
def filter_calls(spark, d):
    return C.filter_calls(*_calls(spark, d), GIVEN)


@query("select * from states", *CLONAL)
def clonal_genotypes(spark, d):
    return _states(spark, d)


@query(f"select pos, coalesce(sum(state), 0)::bigint as carriers, round(coalesce(sum(state), 0) / {T.N}, 6) as frequency from states group by 1 having coalesce(sum(state), 0) / {T.N} > 0.03", *CLONAL)
def frequent_clonal(spark, d):
    calls, n = _calls(spark, d)
    return C.frequent(C.clonal_genotypes(calls, n, GIVEN), n, GIVEN)


@query("select sample, pos, case when vf > 0.9 then '1' when vf < 0.05 then '0' else '{0,1}' end as code from reliable", T.CALLS, UNMASKED)
def ambiguity_codes(spark, d):
    unreliable = (F.col("coverage") < GIVEN.coverage) | (F.col("pvalue") >= GIVEN.pvalue)
    return T.calls(spark, d).select("sample", "pos", C.ambiguity(F.when(~unreliable, F.col("vf"))).alias("code"))


@query("select * from detected", *MINOR)
def minor_variants_filtered(spark, d):
    return _detected(spark, d)


@query("select pos, variant, context from contexts", T.GENOME, T.VARIANTS, CONTEXTS)
def variant_contexts(spark, d):
    return X.in_context(T.variants(spark, d), T.genome(spark, d))


@query("select * from counts", *COUNTED)
def context_96(spark, d):
    return _counts(spark, d)


@query("select sample, substr(context, 3, 3) as context, sum(n)::bigint as n from counts group by 1, 2", *COUNTED)
def context_6(spark, d):
    return X.rolled_up(_counts(spark, d))


@query(f"select context, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from (select b.base || '[' || {FOLD} || ']' || a.base as context from (select g.pos, g.base || '>' || alt as c from genome g, (select unnest(['A', 'C', 'G', 'T']) as alt) where alt <> g.base) join (select pos + 1 as pos, base from genome) b using (pos) join (select pos - 1 as pos, base from genome) a using (pos)) group by 1", T.GENOME)
def theoretical_96(spark, d):
    return X.theoretical(T.genome(spark, d))


@query("select cluster, context, sum(n)::bigint as n, round(sum(n) / sum(sum(n)) over (partition by cluster), 6) as share from counts join samples using (sample) where cluster is not null group by 1, 2", *COUNTED, T.SAMPLES)
def cluster_profiles(spark, d):
    return X.profiles(_counts(spark, d), T.samples(spark, d).select("sample", "cluster"), "cluster")


@query("select sample, n_minor, n_clonal, round(mean_minor, 6) as mean_minor, collection_date, round(median_coverage, 6) as median_coverage, round(total_coverage, 6) as total_coverage, clade, cluster, week, week_bin from statistics", *STATS)
def sample_statistics(spark, d):
    return _statistics(spark, d)


@query("select pos, type, true_transition, round(vf_median, 6) as vf_median, n_calls from seen", *FACT)
def mutation_types(spark, d):
    return L.mutation_types(T.calls(spark, d))


@query("select sample, pos, variant, round(vf, 6) as vf, level, type, clade, cluster from facts", *FACT)
def variant_fact(spark, d):
    return _facts(spark, d)


@query("select 'single' as class, sum((n = 1)::int)::bigint as n from (select count(distinct alt) as n from alleles group by pos) union all select 'multiple', sum((n > 1)::int)::bigint from (select count(distinct alt) as n from alleles group by pos) union all select 'none', (select max((p_partkey + 1) // 2) from part) - (select count(distinct pos) from alleles)", *ALLELE)
def hit_classes(spark, d):
    length = T.table(spark, d, "part").agg(F.max(F.expr("(p_partkey + 1) div 2"))).scalar()
    return L.hit_classes(_alleles(spark, d), length)


@query("select pos, first(alt order by round(s, 6) desc, alt) as alt, count(*) as n_alleles, round(max(s), 6) as vf_sum from (select pos, alt, sum(vf) as s from alleles group by 1, 2) group by 1", *ALLELE)
def argmax_allele(spark, d):
    return L.main_allele(_alleles(spark, d))


@query("select pos, alt, variant, region, orf, codon_position, offset_ as \"offset\" from orf", *ANNOTATED)
def orf_annotation(spark, d):
    return _annotated(spark, d)


@query("select pos, orf, codon_position, amino, amino_mutated, effect, changes, ref_mismatch from effects", *EFFECTS)
def codon_effect(spark, d):
    """Effects in the frame that the slip shifts; the variant on the slip changes two codons."""
    return _effects(spark, d).select("pos", "orf", "codon_position", "amino", "amino_mutated", "effect", F.array_join("changes", "|").alias("changes"), "ref_mismatch")


@query("select type, effect, coalesce(n, 0)::bigint as n, round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) over (partition by type), 0), 6) as share from (select a.type, b.effect from (select distinct type from cells) a, (select distinct effect from cells) b) left join cells using (type, effect)", *EFFECTS, T.CALLS, T.SAMPLES, FACTS, "cells as (select type, effect, count(*) as n from effects join seen using (pos) group by 1, 2)")
def contingency_type_effect(spark, d):
    rows = _effects(spark, d).join(L.mutation_types(T.calls(spark, d)), "pos")
    return L.contingency(rows, "type", "effect")


@query("select sample, type, coalesce(n, 0)::bigint as n, round(coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by sample), 6) as share from (select a.sample, b.type from (select distinct sample from facts) a, (select distinct type from facts) b) left join (select sample, type, count(*) as n from facts group by 1, 2) using (sample, type)", *FACT)
def sample_type_counts(spark, d):
    return L.contingency(_facts(spark, d), "sample", "type")


@query("select sample, n_minor, n_clonal, round(mean_minor, 6) as mean_minor, count(*) over (partition by n_clonal, n_minor) as n_same from counts", T.CALLS, COUNTS)
def nobs_lookup(spark, d):
    return L.same_counts(L.sample_counts(T.calls(spark, d)))


@query("select cluster, n, round(q1, 6) as q1, round(q2, 6) as q2, round(q3, 6) as q3, min(vf) as low, max(vf) as high from facts join (select cluster, count(*) as n, quantile_cont(vf, 0.25) as q1, quantile_cont(vf, 0.5) as q2, quantile_cont(vf, 0.75) as q3 from facts group by 1) using (cluster) where vf between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by all", *FACT)
def box_stats(spark, d):
    return L.box_statistics(_facts(spark, d).select("cluster", "vf"), "cluster", "vf")


@query("select floor(total_coverage / 100000)::bigint as bin, count(*) as n from collected group by 1", T.COLLECTED)
def coverage_histogram(spark, d):
    return L.histogram(T.collected(spark, d), "total_coverage", 100000)


@query("select name as orf, cluster, change, n, content, round(n / content, 6) as rate from (select name, cluster, ref || '>' || alt as change, ref, count(distinct pos) as n from facts join (select pos, ref, alt from variants) using (pos) join frames on pos between first and last group by all) join (select name, base, count(*) as content from genome join frames on pos between first and last group by all) using (name) where base = ref", *FACT, T.GENOME, T.FRAMES)
def substitution_rates(spark, d):
    changes = T.variants(spark, d).select("pos", F.concat("ref", F.lit(">"), "alt").alias("change"))
    return L.substitution_rates(_facts(spark, d), changes, T.genome(spark, d), T.frames(spark, d))


@query("select pos, count(distinct sample) as n_samples, count(distinct clade) as n_clades, case when count(distinct clade) >= 2 then '>=2 clades' when count(distinct sample) = 1 then 'private' else '1 clade' end as class from facts group by 1", *FACT)
def spread_classes(spark, d):
    return L.spread(_facts(spark, d))


@query("select cluster, n_samples, n_clades, count(*) as n, round(log10(count(*)), 6) as log_n from (select cluster, pos, count(distinct sample) as n_samples, count(distinct clade) as n_clades from facts where cluster is not null group by 1, 2) group by 1, 2, 3", *FACT)
def spread_hist2d(spark, d):
    return L.spread_histogram(_facts(spark, d))


@query("select slice, n, round(s, 6) as \"start\", round(e, 6) as \"end\", round((s + e) / 2, 6) as middle, round(sin((s + e) / 2), 6) as x, round(cos((s + e) / 2), 6) as y from (select slice, n, e, lag(e, 1, 0) over (order by slice) as s from (select slice, n, 2 * pi() * sum(n) over (order by slice) / sum(n) over () as e from (select coalesce(cluster, '0 minors') as slice, count(*) as n from statistics group by 1)))", *STATS)
def pie_geometry(spark, d):
    return L.pie(_statistics(spark, d), "cluster", "0 minors")


@query("select clade, n, round(slope, 6) as slope, round(r2, 6) as r2, round(1 - (1 - r2) * (n - 1) / nullif(n - 2, 0), 6) as adjusted_r2 from (select clade, regr_count(total_coverage, median_coverage)::bigint as n, regr_slope(total_coverage, median_coverage) as slope, regr_r2(total_coverage, median_coverage) as r2 from statistics group by 1) where n > 2", *STATS)
def coverage_regression(spark, d):
    return S.regression(_statistics(spark, d), "clade", "total_coverage", "median_coverage")


RANKS = "rankable as (select pos, vf, total_coverage as y from calls join collected using (sample) where vf > 0.05), ranked as (select pos, 2 * rank() over (partition by pos order by vf) + count(*) over (partition by pos, vf) - 2 - count(*) over (partition by pos) as a, 2 * rank() over (partition by pos order by y) + count(*) over (partition by pos, y) - 2 - count(*) over (partition by pos) as b from rankable), rhos as (select pos, count(*) as n, sum(a * b)::double / nullif(sqrt(sum(a * a)::double * sum(b * b)::double), 0) as rho from ranked group by 1 having count(*) >= 3)"


def _rhos(spark, d):
    rows = T.calls(spark, d).where("vf > 0.05").join(T.collected(spark, d), "sample")
    return S.spearman(rows.select("pos", "vf", "total_coverage"), "pos", "vf", "total_coverage")


@query("select pos, n, round(rho, 6) as rho from rhos", T.CALLS, T.COLLECTED, RANKS)
def spearman_rho(spark, d):
    return _rhos(spark, d).drop("squares")


@query("select sample, pos, p, round(least(1.0, min(p * m / last_rank) over (partition by sample order by p desc range between unbounded preceding and current row)), 6) as q from (select sample, pos, p, count(*) over (partition by sample) as m, rank() over (partition by sample order by p) + count(*) over (partition by sample, p) - 1 as last_rank from (select sample, pos, pvalue + 0.001 as p from calls))", T.CALLS)
def benjamini_hochberg(spark, d):
    rows = T.calls(spark, d).select("sample", "pos", (F.col("pvalue") + 0.001).alias("p"))
    return S.benjamini_hochberg(rows, "p", "sample")


@query("select sample, count(*) as n, round(count(*) / sum(1 / pvalue), 6) as hmp from calls where pvalue > 0 group by 1", T.CALLS)
def harmonic_p(spark, d):
    return S.harmonic_mean_p(T.calls(spark, d), "sample", "pvalue")


@query("select a, b, round(max(abs(gap)), 6) as d from (select a, b, vf, sum(step) over (partition by a, b order by vf) as gap from (select x.cluster as a, y.cluster as b, vf, sum(case when f.cluster = x.cluster then 1 / nx else -1 / ny end) as step from (select cluster, count(*) as nx from facts where cluster is not null group by 1) x join (select cluster, count(*) as ny from facts where cluster is not null group by 1) y on x.cluster < y.cluster join facts f on f.cluster in (x.cluster, y.cluster) group by 1, 2, 3)) group by 1, 2", *FACT)
def ks_pairs(spark, d):
    return S.kolmogorov_smirnov(_facts(spark, d), "cluster", "vf").drop("tied")


@query("select clade, n, round(v[1], 6) as low, round((v[floor(k)::int] + v[ceil(k)::int]) / 2, 6) as lower_hinge, round((v[floor((n + 1) / 2)::int] + v[ceil((n + 1) / 2)::int]) / 2, 6) as middle, round((v[floor(n + 1 - k)::int] + v[ceil(n + 1 - k)::int]) / 2, 6) as upper_hinge, round(v[n], 6) as high from (select clade, count(*) as n, ((count(*) + 3) // 2) / 2 as k, list(total_coverage order by total_coverage) as v from statistics group by 1)", *STATS)
def five_numbers(spark, d):
    return S.five_numbers(_statistics(spark, d), "clade", "total_coverage")


@query("select sample, v.label as profile, round(sum(v.x * p.x) / nullif(sqrt(sum(v.x * v.x) * sum(p.x * p.x)), 0), 6) as cosine from vectors v join (select label, context, avg(x) as x from vectors group by 1, 2) p using (label, context) group by 1, 2", T.VECTORS)
def cosine_to_profile(spark, d):
    rows = T.count_vectors(spark, d)
    means = rows.groupBy("label", "context").agg(F.avg("x").alias("weight"))
    joined = rows.join(means, ["label", "context"])
    sums = joined.groupBy("sample", F.col("label").alias("profile")).agg(F.sum(F.col("x") * F.col("weight")).alias("ab"), F.sum(F.col("x") * F.col("x")).alias("aa"), F.sum(F.col("weight") * F.col("weight")).alias("bb"))
    return sums.select("sample", "profile", F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("cosine"))


@query("select string_agg(variant, '|' order by pos) as name, count(*) as members from (select pos, string_agg(sample || ':' || coalesce(state, -1), ',' order by sample) as s from states where state is null or state = 1 group by 1) join variants using (pos) group by s having count(*) > 1", *CLONAL, T.VARIANTS)
def indistinguishable(spark, d):
    return P.indistinguishable(_states(spark, d), T.variants(spark, d).select("pos", "variant"))


@query("select a, b, rank_a, rank_b, joint, round(pmi, 6) as pmi from pairs", *PAIRED)
def pmi_pairs(spark, d):
    states, n = cut(_states(spark, d)), T.n_samples(spark, d)
    return P.associations(states, cut(_top(states, n)), n)


@query("select parent, child, rank from edges", *PAIRED, EDGES)
def pmi_start_tree(spark, d):
    return _start_tree(spark, d)[2]


@query("select ancestor, child, distance from closure", "recursive " + CLONAL[0], *CLONAL[1:], PAIRS, EDGES, "closure as (select parent as ancestor, child, 1 as distance from edges union all select parent, closure.child, distance + 1 from closure join edges on ancestor = edges.child)")
def ancestor_closure(spark, d):
    tree = _start_tree(spark, d)[2]
    return P.ancestors(tree, P.ancestors_rounds(tree.count() + 1))


@query("select clade, pos, round(coalesce(sum(state), 0) / nullif(any_value(size) - sum((state is null)::int), 0), 6) as mean from states join samples using (sample) join (select clade, count(*) as size from samples group by 1) using (clade) group by 1, 2", *CLONAL, T.SAMPLES)
def clade_mean_genotype(spark, d):
    return P.clade_means(_states(spark, d), T.samples(spark, d))


@query("select clade, count(*) as n, 'C' || lpad((row_number() over (order by count(*) desc, clade))::varchar, 2, '0') as label from samples group by 1", T.SAMPLES)
def dominance_order(spark, d):
    return P.by_dominance(T.samples(spark, d), "clade", "C")


@query("select s.sample, string_agg(case when o.pos is null then '0' else '1' end, '' order by t.rank) as score from (select distinct sample from ones) s cross join top t left join ones o on o.sample = s.sample and o.pos = t.pos group by 1", *PAIRED)
def memo_sort(spark, d):
    states = cut(_states(spark, d))
    return P.memo_sort(states, cut(_top(states, T.n_samples(spark, d))))


SLIDING = "spots as (select distinct cluster, pos, effect from effects join facts using (pos)), starts as (select unnest(range(1, (select max(p_partkey) from part) - 298, 3)) as start), sliding as (select cluster, start, sum((effect = 'NS')::int)::bigint as n_ns, sum((effect = 'S')::int)::bigint as n_s from starts join spots on pos between start and start + 299 group by 1, 2), ratios as (select *, n_ns / nullif(n_s, 0) as ratio from sliding)"


def _sliding(spark, d):
    rows = _effects(spark, d).select("pos", "effect").join(_facts(spark, d).select("pos", "cluster"), "pos")
    return W.sliding_counts(rows, T.table(spark, d, "part").agg(F.max("p_partkey")).scalar())


@query("select cluster, start, n_ns, n_s, round(ratio, 6) as ratio from ratios", *EFFECTS, T.CALLS, T.SAMPLES, FACTS, SLIDING)
def effect_windows(spark, d):
    return _sliding(spark, d)


@query("select cluster, pos, round(avg(ratio), 6) as mean from (select cluster, unnest(range(start, start + 300)) as pos, ratio from ratios) group by 1, 2", *EFFECTS, T.CALLS, T.SAMPLES, FACTS, SLIDING)
def effect_ratio_smooth(spark, d):
    return W.smoothed(_sliding(spark, d), "ratio")


#: Categories of a count vector, and signatures and replicates of the kernels' queries.
CATEGORIES, SIGNATURES, REPLICATES = 6, 3, 1000
#: Ranks that are compared, and random starts of each.
RANKS_TRIED, STARTS = [1, 2, 3, 4, 5, 6], 100


def _vectors(spark, d):
    """(sample, x): each sample's counts of the six classes of substitutions, dealt over all tasks, as few bytes of them are much work."""
    rows = X.rolled_up(_counts(spark, d, stored(T.calls(spark, d)))).groupBy("sample")  # the calls are gone through several times
    of = [F.sum(F.when(F.col("context") == c, F.col("n")).otherwise(0)).cast("double") for c in X.CLASSES]
    return cut(rows.agg(F.array(*of).alias("x")).repartition(2 * spark.sparkContext.defaultParallelism))


def _signatures(vectors):
    """The best of all starts."""
    once = N.distinct(vectors)
    betas = N.restarts(once, [SIGNATURES], STARTS, CATEGORIES)
    chosen = N.best(once, betas)
    return betas[SIGNATURES][chosen[SIGNATURES][0]] if chosen else G.seeded(SIGNATURES, CATEGORIES, 0)


def _factorised(spark, d):
    vectors = _vectors(spark, d)
    beta = _signatures(vectors)
    return G.exposures(vectors, beta), beta


def _tests(spark, d):
    vectors = _vectors(spark, d)
    beta = _signatures(vectors)
    return vectors, beta, G.tested(vectors, beta, REPLICATES)


@query()
def nmf_decomposition(spark, d):
    fitted, _ = _factorised(spark, d)
    return fitted.select("sample", F.posexplode("alpha").alias("signature", "exposure"))


@query()
def nmf_quality(spark, d):
    fitted, beta = _factorised(spark, d)
    return G.quality(fitted, beta)


@query()
def nmf_rank_scan(spark, d):
    """Every rank's best start, and how much the starts agree."""
    vectors = _vectors(spark, d)
    return N.measures(vectors, N.restarts(vectors, RANKS_TRIED, STARTS, CATEGORIES))


@query()
def nmf_cross_validation(spark, d):
    return N.held_out(_vectors(spark, d), RANKS_TRIED, CATEGORIES)


#: Repetitions of the cross validation by hidden cells.
REPETITIONS = 1000


@query()
def nmf_hidden_cells(spark, d):
    """Errors at cells that were hidden, by rank."""
    vectors = _vectors(spark, d)
    once = N.distinct(vectors)
    betas = N.restarts(once, RANKS_TRIED, STARTS, CATEGORIES)
    chosen = {k: betas[k][start] for k, (start, _) in N.best(once, betas).items()}
    return N.hidden_cells(vectors, chosen, REPETITIONS)


@query()
def bootstrap_significance(spark, d):
    return _tests(spark, d)[2]


@query()
def significant_exposures(spark, d):
    vectors, beta, tests = _tests(spark, d)
    return G.refitted(vectors, tests, beta)


@query()
def signature_shares(spark, d):
    """Samples with each signature, and of all samples the shares that have it and have it significantly."""
    return G.shares(_tests(spark, d)[2])


@query()
def fitted_to_signatures(spark, d):
    """The second half of the samples as a new cohort, begun from the signatures of the first."""
    vectors = _vectors(spark, d)
    half = F.pmod(F.xxhash64("sample"), F.lit(2))
    beta = _signatures(vectors.where(half == 0))
    fitted, _ = G.factorise(vectors.where(half == 1), SIGNATURES, CATEGORIES, beta=beta)
    return fitted.select("sample", F.posexplode("alpha").alias("signature", "exposure"))


@query()
def kmeans_clusters(spark, d):
    fitted, _ = _factorised(spark, d)
    return G.clusters(fitted)


#: Error rates of the attachment to a fixed tree: false ones and false zeros.
ALPHA, BETA = 0.01, 0.05
CLOSURE = "closure as (select parent as ancestor, child, 1 as distance from edges union all select parent, closure.child, distance + 1 from closure join edges on ancestor = edges.child)"
ATTACHED = f"genotypes as (select rank as clone, pos from top union select t.rank, ancestor from closure join top t on t.pos = child), clones as (select unnest(range(0, (select count(*) + 1 from top))) as clone), scored as (select s.sample, c.clone, round(sum(case when t.pos is null or st.pos is not null and st.state is null then 0 when st.state = 1 and g.pos is not null then ln(1 - {ALPHA}) when st.state = 1 then ln({ALPHA}) when g.pos is not null then ln({BETA}) else ln(1 - {BETA}) end), 6) as log_likelihood from samples s cross join clones c left join top t on true left join states st on st.sample = s.sample and st.pos = t.pos left join genotypes g on g.clone = c.clone and g.pos = t.pos group by 1, 2), attached as (select sample, clone::int as clone, log_likelihood from scored qualify row_number() over (partition by sample order by log_likelihood desc, clone) = 1)"
ATTACH = ("recursive " + CLONAL[0], *CLONAL[1:], PAIRS, EDGES, CLOSURE, T.SAMPLES, ATTACHED)


def _attached(spark, d):
    states, top, tree = _start_tree(spark, d)
    size = top.count()
    genotypes = cut(P.clone_genotypes(tree, P.ancestors(tree, P.ancestors_rounds(size)), top))
    return cut(P.attachments(states, T.samples(spark, d), genotypes, top, size, ALPHA, BETA)), size


@query("select * from attached", *ATTACH)
def attachment_fixed_tree(spark, d):
    return _attached(spark, d)[0]


@query("select clone::int as clone, n, round(n / (select count(*) from attached), 6) as prevalence from clones left join (select clone, count(*) as n from attached group by 1) using (clone)", *ATTACH)
def clone_prevalence(spark, d):
    return P.prevalence(*_attached(spark, d))
