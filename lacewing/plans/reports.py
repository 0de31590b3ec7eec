"""Further registered queries: selection, genotype reports, tree tables and labels, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacewing.functions.lineage import cut, stored
from lacewing.operators import contexts as X
from lacewing.operators import landscape as L
from lacewing.operators import phylogeny as P
from lacewing.operators import reports as R
from lacewing.operators import selection as S
from lacewing.operators import stats as Z
from lacewing.operators import windows as W
from lacewing.plans import catalogue as Q
from lacewing.plans.catalogue import query
from lacewing.sources import tables as T

BINS = 20
SLIP = Q.SLIP

CHANGES = f"triplets as (select min(idx) as at_, string_agg(base, '' order by place) as whole from cds group by gene, (place - 1) // 3 having count(*) = 3), possible as (select at_, {Q.FOLD} as change, case when x.amino = y.amino then 'S' else 'NS' end as effect, count(*) as n from (select at_, whole, substr(whole, i, 1) || '>' || alt as c, substr(whole, 1, i - 1) || alt || substr(whole, i + 1) as mutated from triplets, (select unnest([1, 2, 3]) as i), (select unnest(['A', 'C', 'G', 'T']) as alt) where substr(whole, i, 1) <> alt) join code x on x.codon_ = whole join code y on y.codon_ = mutated group by 1, 2, 3)"
PREVALENCE = "prevalence as (select cluster, substr(context, 3, 3) as change, sum(n) / sum(sum(n)) over (partition by cluster) as share from counts join samples using (sample) where cluster is not null group by 1, 2)"
EXPECTED = "weights as (select cluster, at_, sum(case when effect = 'NS' then n * share else 0 end) as e_ns, sum(case when effect = 'S' then n * share else 0 end) as e_s from possible join prevalence using (change) group by 1, 2)"
MUTATIONS = "mutations as (select distinct cluster, pos, effect, type from effects join facts using (pos) where cluster is not null)"
#: Views of calls, samples and variants come once, whichever part asks for them.
SELECTION = (T.CALLS, T.SAMPLES, T.VARIANTS, T.GENOME, T.FRAMES, Q.MASKED, Q.FILTERED, Q.TOP, Q.CONTEXTS, Q.COUNTED[-1], Q.FACTS, Q.CODING, Q.CODONS, CHANGES, PREVALENCE, EXPECTED, MUTATIONS)
WINDOWS = "begun as (select unnest(range(1, (select max(idx) from cds) - 298, 3)) as start), e as (select cluster, start, sum(e_ns) as e_ns, sum(e_s) as e_s from weights join begun on at_ between start and start + 299 group by 1, 2), o as (select cluster, start, count(distinct case when effect = 'NS' then pos end) as n_ns, count(distinct case when effect = 'S' then pos end) as n_s, count(distinct case when type = 'always clonal' then pos end) as n_always_clonal, count(distinct case when type = 'always minor' then pos end) as n_always_minor, count(distinct case when type = 'mixed' then pos end) as n_mixed from mutations join cds using (pos) join begun on idx between start and start + 299 group by 1, 2), ratios as (select cluster, start, coalesce(n_ns, 0) as n_ns, coalesce(n_s, 0) as n_s, coalesce(n_always_clonal, 0) as n_always_clonal, coalesce(n_always_minor, 0) as n_always_minor, coalesce(n_mixed, 0) as n_mixed, e_ns, e_s, (coalesce(n_ns, 0) / nullif(coalesce(n_s, 0), 0)) / nullif(e_ns / nullif(e_s, 0), 0) as dnds from e left join o using (cluster, start))"


def _mutations(spark, d, calls):
    rows = Q._effects(spark, d).select("pos", "effect").join(Q._facts(spark, d, calls).select("pos", "cluster", "type"), "pos")
    return rows.where("cluster is not null").select("cluster", "pos", "effect", "type").distinct()


def _expected(spark, d, calls):
    groups = T.samples(spark, d).select("sample", "cluster")
    prevalence = X.profiles(X.rolled_up(Q._counts(spark, d, calls)), groups, "cluster").select("cluster", F.col("context").alias("change"), "share")
    return S.expected_by_codon(S.possible_changes(Q._coding(spark, d)), prevalence)


def _windows(spark, d):
    coding, calls = cut(Q._coding(spark, d)), stored(T.calls(spark, d))
    length = coding.agg(F.coalesce(F.max("idx"), F.lit(0))).scalar()
    return S.dnds_by_window(S.observed_windows(_mutations(spark, d, calls), coding, length), S.expected_windows(_expected(spark, d, calls), length))


@query("select idx, pos, orf, base from cds", T.GENOME, T.FRAMES, Q.CODING)
def coding_positions(spark, d):
    return Q._coding(spark, d).select("idx", "pos", "orf", "base")


@query("select cluster, start, n_ns, n_s, n_always_clonal, n_always_minor, n_mixed, round(e_ns, 6) as e_ns, round(e_s, 6) as e_s, round(dnds, 6) as dnds from ratios", *SELECTION, WINDOWS)
def dnds_windows(spark, d):
    return _windows(spark, d)


@query("select cluster, pos, round(avg(dnds), 6) as mean from (select cluster, unnest(range(start, start + 300)) as pos, dnds from ratios) group by 1, 2", *SELECTION, WINDOWS)
def dnds_smooth(spark, d):
    return W.smoothed(_windows(spark, d), "dnds")


@query("select cluster, n_ns, n_s, round(e_ns, 6) as e_ns, round(e_s, 6) as e_s, round((n_ns / nullif(n_s, 0)) / nullif(e_ns / nullif(e_s, 0), 0), 6) as dnds from (select cluster, count(distinct case when effect = 'NS' then pos end) as n_ns, count(distinct case when effect = 'S' then pos end) as n_s from mutations group by 1) join (select cluster, sum(e_ns) as e_ns, sum(e_s) as e_s from weights group by 1) using (cluster)", *SELECTION)
def dnds_overall(spark, d):
    calls = stored(T.calls(spark, d))
    return S.dnds_overall(_mutations(spark, d, calls), _expected(spark, d, calls))


@query(f"select pos, name, (o + (name = '{SLIP[0]}' and o > {SLIP[1]})::int)::bigint as \"offset\", case when not (name = '{SLIP[0]}' and o = {SLIP[1]}) then (o + (name = '{SLIP[0]}' and o > {SLIP[1]})::int - 1) % 3 + 1 end::int as codon_position from (select pos, name, pos - first + 1 as o from variants join frames on pos between first and last where region = 'CDS')", T.VARIANTS, T.FRAMES)
def frameshift_offsets(spark, d):
    genes = T.frames(spark, d).where("region = 'CDS'").select("name", "first", F.explode(F.sequence("first", "last")).alias("pos"))
    rows = T.variants(spark, d).select("pos").join(genes, "pos")
    args = (F.col("pos"), F.col("first"), F.col("name"), SLIP)
    return rows.select("pos", "name", S.offset_in_frame(*args).cast("long").alias("offset"), S.codon_position(*args).alias("codon_position"))


@query("select v.pos, variant, coalesce(effect, 'NC') as effect from variants v left join effects using (pos)", *Q.EFFECTS)
def mutation_effects(spark, d):
    return S.with_noncoding(T.variants(spark, d).select("pos", "variant"), Q._effects(spark, d)).select("pos", "variant", "effect")


def _tree(spark, d):
    (states, top, tree), n = Q._start_tree(spark, d), T.n_samples(spark, d)
    size = top.count()
    genotypes = cut(P.clone_genotypes(tree, P.ancestors(tree, P.ancestors_rounds(size)), top))
    return states, top, tree, genotypes, cut(P.attachments(states, T.samples(spark, d), genotypes, top, size, Q.ALPHA, Q.BETA)), n


CORRECTED = "corrected as (select sample, pos from attached join genotypes using (clone))"


@query("select sample, pos from corrected", *Q.ATTACH, CORRECTED)
def corrected_genotypes(spark, d):
    _, _, _, genotypes, attached, _ = _tree(spark, d)
    return R.corrected_genotypes(attached, genotypes)


@query(f"select pos, tp, fp, fn, {T.N} - tp - fp - fn - gone as tn, fp + fn as hamming from (select t.pos, count(case when state = 1 and c.pos is not null then 1 end) as tp, count(case when state = 1 and c.pos is null then 1 end) as fp, count(case when st.pos is not null and state is null then 1 end) as gone, count(case when (st.pos is null or state = 0) and c.pos is not null then 1 end) as fn from samples s cross join top t left join states st on st.sample = s.sample and st.pos = t.pos left join corrected c on c.sample = s.sample and c.pos = t.pos group by 1)", *Q.ATTACH, CORRECTED)
def confusion_counts(spark, d):
    states, top, _, genotypes, attached, n = _tree(spark, d)
    return R.confusion(states, R.corrected_genotypes(attached, genotypes), top, n)


@query("select clone::int as clone, count(*) as size, string_agg(pos::varchar, ',' order by pos) as \"set\" from genotypes group by 1", *Q.ATTACH)
def mutation_sets(spark, d):
    return R.mutation_sets(_tree(spark, d)[3], "clone")


@query("select sample, clone::int as clone from (select sample, string_agg(pos::varchar, ',' order by pos) as g from ones group by 1) join (select clone, string_agg(pos::varchar, ',' order by pos) as g from genotypes group by 1) using (g)", *Q.ATTACH)
def equal_genotypes(spark, d):
    states, top, _, genotypes, _, _ = _tree(spark, d)
    observed = states.where("state = 1").join(top.select("pos"), "pos", "left_semi")
    return R.equal_genotypes(R.mutation_sets(observed, "sample"), R.mutation_sets(genotypes, "clone"))


@query("select a::int as a, b::int as b, sa + sb - 2 * coalesce(k, 0) as distance from (select clone as a, count(*) as sa from genotypes group by 1) join (select clone as b, count(*) as sb from genotypes group by 1) on a < b left join (select x.clone as a, y.clone as b, count(*) as k from genotypes x join genotypes y on x.pos = y.pos and x.clone < y.clone group by 1, 2) using (a, b)", *Q.ATTACH)
def manhattan_clones(spark, d):
    return R.manhattan(_tree(spark, d)[3], "clone")


TREE = "sizes as (select clone, count(*) as size from genotypes group by 1), listed as (select 'G' || coalesce(p.rank, 0) as parent, 'G' || t.rank as child, s.size - coalesce(q.size, 0) as length, 'clone' as kind from top t left join edges e on e.child = t.pos left join top p on p.pos = e.parent join sizes s on s.clone = t.rank left join sizes q on q.clone = p.rank union all select 'G' || clone, sample::varchar, 0, 'sample' from attached)"


@query("select parent, child, length::bigint as length, kind from listed", *Q.ATTACH, TREE)
def tree_edges(spark, d):
    _, top, tree, genotypes, attached, _ = _tree(spark, d)
    return R.tree_edges(tree, top, genotypes, attached)


@query("select child as tip, parent as clade from listed where child not in (select parent from listed)", *Q.ATTACH, TREE)
def tip_clades(spark, d):
    _, top, tree, genotypes, attached, _ = _tree(spark, d)
    return R.tip_clades(cut(R.tree_edges(tree, top, genotypes, attached)))


@query("select case when a.distance is not null then e.child else e.parent end as parent, case when a.distance is not null then e.parent else e.child end as child, 1::bigint as length from edges e left join (select child, 0 as distance from edges where child = (select max(child) from edges) union all select ancestor, distance from closure where child = (select max(child) from edges)) a on a.child = e.child", *Q.ATTACH)
def rerooted_tree(spark, d):
    _, top, tree, _, _, _ = _tree(spark, d)
    paths = P.ancestors(tree, P.ancestors_rounds(top.count()))
    return R.rerooted(tree.select("parent", "child", F.lit(1).cast("long").alias("length")), paths, tree.agg(F.max("child")).scalar())


@query("select clade, sample, rank::int as rank, pos, coalesce(state, 0)::int as state from states join top using (pos) join samples using (sample) where state is null or state = 1", *Q.PAIRED, T.SAMPLES)
def oncoprint(spark, d):
    states, n = cut(Q._states(spark, d)), T.n_samples(spark, d)
    groups = T.samples(spark, d).select("sample", F.col("clade").alias("group"))
    return R.oncoprint(states, cut(Q._top(states, n)), groups, 0).withColumnRenamed("group", "clade")


@query("select clade, count(*) as n_samples, round(coalesce(sum(k), 0) / count(*), 6) as mean from samples left join (select sample, count(*) as k from states where state = 1 group by 1) using (sample) group by 1", *Q.CLONAL, T.SAMPLES)
def mean_variants(spark, d):
    return R.mean_variants(Q._states(spark, d), T.samples(spark, d), "clade")


@query(f"select cluster, bin::int as bin, n::bigint as n, round(n / max(n) over (partition by cluster), 6) as share from (select cluster, bin, sum(coalesce(k, 0)) over (partition by cluster order by bin) as n from (select cluster, bin from (select distinct cluster from facts where cluster is not null), (select unnest(range(1, {BINS} + 1)) as bin)) left join (select cluster, greatest(1, ceil(round(vf * {BINS}, 9)))::bigint as bin, count(*) as k from facts group by 1, 2) using (cluster, bin))", *Q.FACT)
def cumulative_frequencies(spark, d):
    return R.cumulative_frequencies(Q._facts(spark, d), "cluster", "vf", BINS)


@query("select type, count(distinct sample) as n_samples, count(distinct pos) as n_variants from facts group by 1", *Q.FACT)
def distinct_by_class(spark, d):
    return R.distinct_by_class(Q._facts(spark, d), "type")


@query("select pos, variant from variants where pos not in (select pos from facts)", *Q.FACT)
def unseen_variants(spark, d):
    return R.without(T.variants(spark, d).select("pos", "variant"), Q._facts(spark, d), "pos")


@query("select sample, clade, cluster, first_pos, first_vf from samples left join (select sample, min(pos) as first_pos, arg_min(vf, pos) as first_vf from facts where level = 'clonal' group by 1) using (sample)", *Q.FACT)
def first_clonal_variant(spark, d):
    clonal = Q._facts(spark, d).where("level = 'clonal'").select("sample", F.col("pos").alias("first_pos"), F.col("vf").alias("first_vf"))
    return R.first_match(T.samples(spark, d), clonal, "sample", "first_pos")


@query("select point, (select min(pos) from clonals where pos >= point) as at_or_after, (select max(pos) from clonals where pos <= point) as at_or_before from (select distinct pos as point from facts where level = 'minor')", *Q.FACT, "clonals as (select distinct pos from facts where level = 'clonal')")
def nearest_clonal(spark, d):
    facts = cut(Q._facts(spark, d).select("pos", "level").distinct())
    pick = lambda level, name: facts.where(F.col("level") == level).select(F.col("pos").alias(name))
    return R.nearest(pick("minor", "point"), pick("clonal", "pos"), 64)


BY_CLADE = "shared as (select clade as sample, pos, 1 as state from states join samples using (sample) where state = 1 group by 1, 2), merged as (select string_agg(variant, '|' order by pos) as name, count(*) as members from (select pos, string_agg(sample::varchar, ',' order by sample) as s from shared group by 1) join variants using (pos) group by s having count(*) > 1), parts as (select name, unnest(string_split(name, '|')) as variant, generate_subscripts(string_split(name, '|'), 1) = 1 as \"first\" from merged)"


def _by_clade(spark, d):
    rows = Q._states(spark, d).where("state = 1").join(T.samples(spark, d), "sample")
    return cut(rows.select(F.col("clade").alias("sample"), "pos", "state").distinct())


@query("select name, variant, \"first\" from parts", *Q.CLONAL, T.SAMPLES, T.VARIANTS, BY_CLADE)
def merged_variants(spark, d):
    return R.split_merged(P.indistinguishable(_by_clade(spark, d), T.variants(spark, d).select("pos", "variant")))


@query("select sample as clade, coalesce(name, variant) as variant, state::int as state from shared join variants using (pos) left join parts using (variant) where \"first\" is null or \"first\"", *Q.CLONAL, T.SAMPLES, T.VARIANTS, BY_CLADE)
def represented_variants(spark, d):
    shared, names = _by_clade(spark, d), T.variants(spark, d).select("pos", "variant")
    return R.represented(shared, names, R.split_merged(P.indistinguishable(shared, names))).withColumnRenamed("sample", "clade")


@query("select variant, pos, ref, alt, label, i::int as pair, 'pair ' || i as name, label like '%A' as adenine from (select *, case ref || '>' || alt when 'C>A' then 'C>A | G>T' when 'G>T' then 'C>A | G>T' when 'C>G' then 'C>G | G>C' when 'G>C' then 'C>G | G>C' when 'C>T' then 'C>T | G>A' when 'G>A' then 'C>T | G>A' when 'T>A' then 'T>A | A>T' when 'A>T' then 'T>A | A>T' when 'T>C' then 'T>C | A>G' when 'A>G' then 'T>C | A>G' else 'T>G | A>C' end as label from variants) join (select unnest(['C>A | G>T', 'C>G | G>C', 'C>T | G>A', 'T>A | A>T', 'T>C | A>G', 'T>G | A>C']) as label, unnest(range(1, 7)) as i) using (label)", T.VARIANTS)
def variant_labels(spark, d):
    fields = R.parsed(F.col("variant"))
    rows = T.variants(spark, d).select("variant", *[c.alias(k) for k, c in fields.items()])
    change = F.concat("ref", F.lit(">"), "alt")
    rows = rows.withColumns({"label": R.pair_label(change), "pair": R.pair_number(change)})
    name = F.regexp_replace(F.concat_ws("_", F.lit("pair"), F.col("pair").cast("string")), "_", " ")
    return rows.withColumns({"name": name, "adenine": F.col("label").endswith("A")})


@query("select change, n, content, round(n / content, 6) as rate from (select ref || '>' || alt as change, ref as base, count(*) as n from variants group by 1, 2) join (select base, count(*) as content from genome group by 1) using (base)", T.VARIANTS, T.GENOME)
def rates_by_content(spark, d):
    counts = T.variants(spark, d).groupBy(F.concat("ref", F.lit(">"), "alt").alias("change")).agg(F.count("*").alias("n"))
    return R.by_base_content(counts, T.genome(spark, d))


WIDE = ", ".join(f"coalesce(sum(n) filter (c = '{c}'), 0)::bigint as \"{c}\"" for c in X.CLASSES)


@query(f"select sample, {WIDE} from (select sample, substr(context, 3, 3) as c, n from counts) group by 1", *Q.COUNTED)
def contexts_wide(spark, d):
    return R.wide(X.rolled_up(Q._counts(spark, d)), "sample", "context", "n", list(X.CLASSES), 0)


@query("select sample, pos, vf from calls where sample in (select sample from states) and pos in (select pos from states)", *Q.CLONAL)
def aligned_calls(spark, d):
    return R.aligned(T.calls(spark, d).select("sample", "pos", "vf"), Q._states(spark, d))


RANKS = "rankable as (select pos, vf, week(collection_date) as y from calls join collected using (sample) where vf > 0.05), ranked as (select pos, 2 * rank() over (partition by pos order by vf) + count(*) over (partition by pos, vf) - 2 - count(*) over (partition by pos) as a, 2 * rank() over (partition by pos order by y) + count(*) over (partition by pos, y) - 2 - count(*) over (partition by pos) as b from rankable), rhos as (select pos, count(*) as n, sum(a * b)::double / nullif(sqrt(sum(a * a)::double * sum(b * b)::double), 0) as rho, case when sum(a * a) = (count(*) ** 3 - count(*)) / 3 and sum(b * b) = sum(a * a) then (sum(a * a) + sum(b * b) - 2 * sum(a * b)) // 4 end as squares from ranked group by 1 having count(*) >= 3)"


def _by_week(spark, d):
    weeks = T.collected(spark, d).select("sample", F.weekofyear("collection_date").alias("week"))
    return Z.spearman(T.calls(spark, d).where("vf > 0.05").join(weeks, "sample").select("pos", "vf", "week"), "pos", "vf", "week")


@query("select pos, n, round(rho, 6) + 0 as rho from rhos", T.CALLS, T.COLLECTED, RANKS)
def spearman_week(spark, d):
    return _by_week(spark, d).drop("squares")


#: Both tails of Student's distribution for whole degrees of freedom, as finite sums.
TAILS = "1 - case when n % 2 = 0 then abs(rho) * coalesce(list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(1 - rho * rho, k) for k in range(0, (n - 2) // 2)]), 0) else 2 / pi() * (asin(least(1, abs(rho))) + abs(rho) * coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(greatest(0, 1 - rho * rho), k + 0.5) for k in range(0, (n - 3) // 2)]), 0)) end"


#: The exact chances of few pairs without ties.
EXACT = "exact(n_, q, p_exact) as (values " + ", ".join(f"({n}, {q}, {Z.squares_tail(q, n)!r})" for n in range(3, Z.EXACT_PAIRS + 1) for q in range(0, (n**3 - n) // 3 + 1, 2)) + ")"


@query(f"select pos, n, round(rho, 6) + 0 as rho, case when p_exact is not null then round(p_exact, 6) when rho is not null then round(greatest(0, {TAILS}), 6) end as p from rhos left join exact on n_ = n and q = squares", T.CALLS, T.COLLECTED, RANKS, EXACT)
def spearman_significance(spark, d):
    return Z.spearman_p(_by_week(spark, d))


@query("select a, b, round(d, 6) as d, round(case when reach < 0.2 then 1 else greatest(0, least(1, list_sum([(case when k % 2 = 1 then 2 else -2 end) * exp(-2 * k * k * reach * reach) for k in range(1, 101)]))) end, 6) as p from (select *, d * sqrt(nx * ny / (nx + ny)) as reach from (select a, b, nx, ny, max(abs(gap)) as d from (select a, b, nx, ny, vf, sum(step) over (partition by a, b order by vf) as gap from (select x.cluster as a, y.cluster as b, nx, ny, vf, sum(case when f.cluster = x.cluster then 1 / nx else -1 / ny end) as step from sizes x join (select cluster, nx as ny from sizes) y on x.cluster < y.cluster join facts f on f.cluster in (x.cluster, y.cluster) group by 1, 2, 3, 4, 5)) group by 1, 2, 3, 4))", *Q.FACT, "sizes as (select cluster, count(*) as nx from facts where cluster is not null group by 1)")
def ks_significance(spark, d):
    facts = cut(Q._facts(spark, d).where("cluster is not null").select("cluster", "vf"))
    return Z.kolmogorov_p(Z.kolmogorov_smirnov(facts, "cluster", "vf"), facts.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")


@query(f"select sample, n, round(hmp, 6) as hmp, round(least(1, case when x < -4 then 1 else list_sum([exp(-(v * v / greatest(1, x)) * ln(v * v / greatest(1, x)) - x * v * v / greatest(1, x)) * sin(pi() * v * v / greatest(1, x)) / (pi() * v * v / greatest(1, x)) * 2 * v for v in [(i + 0.5) * {Z.STEP} for i in range(0, {Z.STEPS})]]) * {Z.STEP} / greatest(1, x) end), 6) as p_adjusted from (select *, 1 / hmp - ln(n) - (1 + {Z.DIGAMMA_1} - ln(2 / pi())) + ln(pi() / 2) as x from (select sample, count(*) as n, count(*) / sum(1 / pvalue) as hmp from calls where pvalue > 0 group by 1))", T.CALLS)
def harmonic_p_adjusted(spark, d):
    return Z.adjusted_harmonic_p(T.calls(spark, d), "sample", "pvalue")


@query("select clade, n, round(high, 6) as share_high from (select clade, count(*) as n, avg((vf > 0.9)::int) as high from facts group by 1)", *Q.FACT)
def high_share(spark, d):
    return Q._facts(spark, d).groupBy("clade").agg(F.count("*").alias("n"), F.avg((F.col("vf") > L.HIGH).cast("int")).alias("share_high"))


@query("select \"first\", second, common from (select (select count(*) from a) - (select count(*) from (select * from a intersect select * from b)) as \"first\", (select count(*) from b) - (select count(*) from (select * from a intersect select * from b)) as second, (select count(*) from (select * from a intersect select * from b)) as common)", *Q.FACT, "a as (select distinct pos from facts where level = 'clonal'), b as (select distinct pos from facts where level = 'minor')")
def clonal_and_minor(spark, d):
    facts = cut(Q._facts(spark, d).select("pos", "level").distinct())
    a, b = (facts.where(F.col("level") == level).select("pos") for level in ("clonal", "minor"))
    n = lambda df, name: df.agg(F.count("*").alias(name)).select(F.col(name)).scalar().alias(name)
    return spark.range(1).select(n(a.subtract(b), "first"), n(b.subtract(a), "second"), n(a.intersect(b), "common"))
