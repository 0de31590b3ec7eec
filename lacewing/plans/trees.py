"""Registered queries of orders, phylogenies, matrices and densities, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lacewing.functions.lineage import cut, ensure_checkpoint_dir, stored
from lacewing.operators import calls as C
from lacewing.operators import contexts as X
from lacewing.operators import landscape as L
from lacewing.operators import phylogeny as P
from lacewing.operators import reports as R
from lacewing.operators import stats as Z
from lacewing.plans import catalogue as Q
from lacewing.plans import reports as B
from lacewing.plans.catalogue import query
from lacewing.sources import tables as T
from lacewing.sources import text as texts

#: A variant hangs under another one if its samples are so many times those that chance gives (as a logarithm); else it is a root.
ASSOCIATED = 0.15

ORDERED = "keyed as (select sample, string_agg(lpad(rank::varchar, 6, '0'), '' order by rank) || '999999' as key from ones group by 1), columns as (select sample, row_number() over (order by key, sample) as place from keyed), held as (select pos, rank, string_agg(lpad((999999 - place)::varchar, 6, '0'), '' order by place) || '000000' as key from ones join columns using (sample) group by 1, 2), lines as (select pos, row_number() over (order by key, rank) as place from held)"


@query("select o.sample, o.pos, l.place as row_place, c.place as column_place from ones o join lines l using (pos) join columns c using (sample)", *Q.PAIRED, ORDERED)
def memo_order(spark, d):
    """Cells of the leading variants' matrix with the places of their row and column after sorting both ways."""
    states = cut(Q._states(spark, d))
    top = cut(Q._top(states, T.n_samples(spark, d)))
    columns, rows = P.memo_order(states, top)
    cells = states.where("state = 1").select("sample", "pos").join(rows.withColumnRenamed("place", "row_place"), "pos")
    return cells.join(columns.withColumnRenamed("place", "column_place"), "sample").select("sample", "pos", "row_place", "column_place")


@query("select sample, cluster, row_number() over (order by cluster, sample) as place, cluster || '.' || row_number() over (partition by cluster order by sample) as label from samples where cluster is not null", T.SAMPLES)
def columns_by_cluster(spark, d):
    return P.by_cluster(T.samples(spark, d), "cluster")


@query("select pos, count(distinct alt) as n, string_agg(distinct alt, ',' order by alt) as alleles from alleles group by 1 having count(distinct alt) > 1", *Q.ALLELE)
def multiple_alleles(spark, d):
    return L.multiple_alleles(Q._alleles(spark, d))


GRID = 64


@query(f"select cluster, round(j * (1.0 / {GRID - 1}), 6) as at_, round(sum(k * exp(-pow((i - j) * (1.0 / {GRID - 1}) / h, 2) / 2) / (n * h * sqrt(2 * pi()))), 6) as density from (select cluster, greatest(0, least({GRID - 1}, round(vf * {GRID - 1})))::int as i, count(*) as k from facts where cluster is not null group by 1, 2) join (select cluster, count(*) as n, 0.9 * least(coalesce(nullif(stddev_samp(vf), 0), 1e9), coalesce(nullif((quantile_cont(vf, 0.75) - quantile_cont(vf, 0.25)) / 1.34, 0), 1e9)) * pow(count(*), -0.2) as h from facts where cluster is not null group by 1) using (cluster), (select unnest(range({GRID})) as j) group by 1, 2", *Q.FACT)
def violin_densities(spark, d):
    rows = Q._facts(spark, d).where("cluster is not null").select("cluster", "vf")
    return Z.densities(rows, "cluster", "vf", 0.0, 1.0, GRID).withColumnRenamed("at", "at_")


@query("select v.pos, variant from variants v where pos not in (select pos from facts where level = 'clonal')", *Q.FACT)
def never_clonal(spark, d):
    return R.without(T.variants(spark, d).select("pos", "variant"), Q._facts(spark, d).where("level = 'clonal'"), "pos")


NAMES = "names(old, name, place) as (values ('SC#3', 'S#1', 1), ('SC#1', 'S#2', 2), ('SC#2', 'S#3', 3))"


@query("select name as cluster, context, n, round(n / sum(n) over (partition by cluster), 6) as share, place from (select cluster, context, sum(n)::bigint as n from counts join samples using (sample) where cluster is not null group by 1, 2) join names on old = cluster", *Q.COUNTED, T.SAMPLES, NAMES)
def renamed_profiles(spark, d):
    """Cluster profiles with their rows reordered and renamed."""
    names = spark.createDataFrame([("SC#3", "S#1", 1), ("SC#1", "S#2", 2), ("SC#2", "S#3", 3)], "old string, name string, place int")
    profiles = X.profiles(Q._counts(spark, d), T.samples(spark, d).select("sample", "cluster"), "cluster")
    return R.renamed(profiles, "cluster", names)


PRODUCT = "weights as (select sample, type, count(*) / sum(count(*)) over (partition by sample) as a from facts group by 1, 2), profile as (select type, substr(context, 3, 3) as context, count(*) / sum(count(*)) over (partition by type) as b from facts join contexts using (pos) group by 1, 2)"


@query("select sample, context, round(sum(a * b), 6) as fit from weights join profile using (type) group by 1, 2", *Q.FACT, T.GENOME, Q.CONTEXTS, PRODUCT)
def reconstruction(spark, d):
    """What the classes of a sample's variants let expect of its contexts: the product of two matrices in long form."""
    facts = cut(Q._facts(spark, d).select("sample", "pos", "type"))
    weights = L.contingency(facts, "sample", "type").where("n > 0").select("sample", "type", F.col("share").alias("a"))
    contexts = X.in_context(T.variants(spark, d), T.genome(spark, d)).select("pos", F.substring("context", 3, 3).alias("context"))
    profile = L.contingency(facts.join(contexts, "pos"), "type", "context").where("n > 0").select("type", "context", F.col("share").alias("b"))
    return R.product(weights, profile, "type", "a", "b", "fit")


@query(Q.ORACLES["attachment_fixed_tree"].split(" select * from attached")[0].removeprefix("with ").replace(f"then ln(1 - {Q.ALPHA}) when st", f"then ln(1 - {Q.BETA}) when st").replace(f"else ln(1 - {Q.BETA}) end", f"else ln(1 - {Q.ALPHA}) end").join(["with ", " select * from attached"]))
def attachment_corrected(spark, d):
    """Attachment with false ones and false zeros at the rates of their names."""
    states, top, tree = Q._start_tree(spark, d)
    size = top.count()
    genotypes = cut(P.clone_genotypes(tree, P.ancestors(tree, P.ancestors_rounds(size)), top))
    return P.attachments(states, T.samples(spark, d), genotypes, top, size, Q.ALPHA, Q.BETA, crossed=False)


ADJACENCY = "sizes as (select clone, count(*) as size from genotypes group by 1)"


@query("select p.pos as parent, c.pos as child from genotypes g join top p on p.pos = g.pos join top c on c.rank = g.clone join sizes s on s.clone = g.clone join sizes q on q.clone = p.rank where p.rank <> g.clone and q.size = s.size - 1", *Q.ATTACH, ADJACENCY)
def adjacency_of_genotypes(spark, d):
    _, top, _, genotypes, _, _ = B._tree(spark, d)
    return P.adjacency(genotypes, top)


FOREST = f"forest as (select parent, child from edges join pairs on a = parent and b = child where pmi > {ASSOCIATED}), recursive_paths as (select parent as ancestor, child from forest union all select parent, r.child from recursive_paths r join forest on r.ancestor = forest.child), named as (select pos::varchar as genotype, pos from top union select child::varchar, ancestor from recursive_paths), kinds as (select sample, string_agg(pos::varchar, ',' order by pos) as g from ones group by 1), wholes as (select genotype, string_agg(pos::varchar, ',' order by pos) as g, count(*) as size from named group by 1), settled as (select s.sample, genotype from samples s left join kinds using (sample) left join wholes using (g) where g is null or genotype is not null), containing as (select a.genotype, b.genotype as parent, b.size, a.size as own from wholes a left join wholes b on b.size < a.size and not exists (select 1 from named n where n.genotype = b.genotype and n.pos not in (select m.pos from named m where m.genotype = a.genotype)) qualify row_number() over (partition by a.genotype order by b.size desc nulls last, b.genotype) = 1)"


@query("select coalesce(parent, 'Root') as parent, genotype as child, own - coalesce(size, 0) as length, 'clone' as kind from containing union all select coalesce(genotype, 'Root'), sample::varchar, 0, 'sample' from settled union all select genotype, 'hidden_' || genotype, 0, 'hidden' from containing where genotype not in (select parent from containing where parent is not null) and genotype not in (select genotype from settled where genotype is not null) union all select 'Root', 'Reference', 0, 'reference'", *Q.ATTACH, FOREST)
def genotype_phylogeny(spark, d):
    """A phylogeny of the genotypes of a forest, in which variants without a close association to an earlier one are roots, with the samples that have just a
    genotype of it or none of its variants, and tips for the leaves that no sample has."""
    states, top, tree = Q._start_tree(spark, d)
    n = T.n_samples(spark, d)
    pairs = P.associated(states, top, n).where(F.col("pmi") > ASSOCIATED).select(F.col("a").alias("parent"), F.col("b").alias("child"))
    forest = cut(tree.join(pairs, ["parent", "child"]))
    genotypes = P.clone_genotypes(forest, P.ancestors(forest, P.ancestors_rounds(top.count())), top)
    genotypes = cut(genotypes.join(top.select(F.col("rank").alias("clone"), F.col("pos").cast("string").alias("genotype")), "clone").select("genotype", "pos"))
    observed = states.where("state = 1").join(top.select("pos"), "pos", "left_semi")
    sets = R.mutation_sets(observed, "sample").select("sample", "set")
    known = R.mutation_sets(genotypes, "genotype").select("genotype", "set")
    attached = T.samples(spark, d).select("sample").join(sets, "sample", "left").join(known, "set", "left").where("set is null or genotype is not null")
    return P.genotype_tree(genotypes, cut(attached.select("sample", "genotype")))


@query("select parent::varchar as parent, child::varchar as child, length from rerooted union all select (select max(child) from edges)::varchar, 'Outgroup', 0", *Q.ATTACH, f"rerooted as ({Q.ORACLES['rerooted_tree'][Q.ORACLES['rerooted_tree'].index('select case when a.distance'):]})")
def outgroup_tree(spark, d):
    """The variants' tree, rooted anew, with an outgroup's tip at its root."""
    _, top, tree = Q._start_tree(spark, d)
    root = tree.agg(F.max("child")).scalar()
    paths = P.ancestors(tree, P.ancestors_rounds(top.count()))
    return R.with_outgroup(R.rerooted(tree.select("parent", "child", F.lit(1).cast("long").alias("length")), paths, root), root)


@query("select node, case when node = 'G0' then 'Reference' else label end as label from (select distinct parent as node from listed) left join (select parent as node, clade::varchar as label from listed join samples on child = sample::varchar where kind = 'sample' group by 1, clade qualify row_number() over (partition by parent order by count(*) desc, clade::varchar) = 1) using (node)", *Q.ATTACH, B.TREE)
def node_labels(spark, d):
    """Inner nodes of the phylogeny labelled by the clade of the samples below them."""
    _, top, tree, genotypes, attached, _ = B._tree(spark, d)
    tips = T.samples(spark, d).select(F.col("sample").cast("string").alias("tip"), F.col("clade").cast("string").alias("label"))
    return R.labelled_nodes(cut(R.tree_edges(tree, top, genotypes, attached)), tips, F.lit("G0"))


@query("select sample, pos, variant, vf, alt_count, pvalue, coverage from calls join variants using (pos)", T.CALLS, T.VARIANTS)
def calls_of_files(spark, d):
    """The calls view, written as call and depth files of each sample and read back from them."""
    return _from_files(spark, d).select("sample", "pos", "variant", "vf", "alt_count", "pvalue", "coverage")


def _from_files(spark, d):
    folder = f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4()}"
    texts.write_call_files(T.calls(spark, d).join(T.variants(spark, d), "pos"), folder)
    sample = r"/sample=([^/]+)/[^/]*$"
    with texts.small_files(spark):
        (calls, _), (depths, _) = texts.read_call_files(spark, f"{folder}/calls", sample), texts.read_depth_files(spark, f"{folder}/depth", sample)
        return stored(texts.bridged(calls, depths).withColumn("sample", F.col("sample").cast("long")))


@query("select * from filtered", T.CALLS, Q.MASKED, Q.FILTERED)
def filter_calls_of_files(spark, d):
    """Call filtering over the files."""
    return C.filter_calls(_from_files(spark, d).select("sample", "pos", "vf", "alt_count", "pvalue", "coverage"), T.n_samples(spark, d), Q.GIVEN)
