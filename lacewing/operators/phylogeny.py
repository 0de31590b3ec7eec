"""Genotype matrices in long form: order, association and merging of variants, mean genotypes of clades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacewing.functions.lineage import cut
from lacewing.functions.order import numbered


def ranked(frequent: DataFrame) -> DataFrame:
    """(pos, carriers, rank) of the frequent variants (see calls.frequent), those with most carriers first, ties by position."""
    placed = numbered(frequent.select("pos", "carriers", (-F.col("carriers")).alias("_less")), [], ["_less", "pos"], "_place")
    return placed.select("pos", "carriers", (F.col("_place") + 1).cast("int").alias("rank"))


def associated(states: DataFrame, top: DataFrame, n: Column) -> DataFrame:
    """(a, b, rank_a, rank_b, joint, pmi) of every two leading variants that a sample has together, a before b in rank.

    Carriers are paired within samples, of which each has at most as many rows as there are leading variants.
    """
    rows = states.where("state = 1").join(top, "pos")
    a = rows.selectExpr("sample", "pos as a", "rank as rank_a", "carriers as na")
    b = rows.selectExpr("sample", "pos as b", "rank as rank_b", "carriers as nb")
    joint = a.join(b, "sample").where("rank_a < rank_b").groupBy("a", "b", "rank_a", "rank_b", "na", "nb").agg(F.count("*").alias("joint"))
    return joint.select("a", "b", "rank_a", "rank_b", "joint", F.ln(F.col("joint") * n / (F.col("na") * F.col("nb"))).alias("pmi"))


def associations(states: DataFrame, top: DataFrame, n: Column) -> DataFrame:
    """The same of every two leading variants; without a common carrier joint is 0 and pmi null. All pairs are the result here; trees need none."""
    left, right = top.selectExpr("pos as a", "rank as rank_a"), top.selectExpr("pos as b", "rank as rank_b")
    pairs = left.join(right, F.col("rank_a") < F.col("rank_b"))
    found = pairs.join(associated(states, top, n).select("a", "b", "joint", "pmi"), ["a", "b"], "left")
    return found.select("a", "b", "rank_a", "rank_b", F.coalesce("joint", F.lit(0)).alias("joint"), "pmi")


def start_tree(pairs: DataFrame, top: DataFrame) -> DataFrame:
    """(parent, child, rank): each leading variant under the earlier one that it is most associated with, the earliest on ties, or the first of all where it
    has no carrier in common with an earlier one. pairs: as of associated."""
    best = pairs.groupBy(F.col("b").alias("pos")).agg(F.max_by("a", F.struct(F.round("pmi", 9), -F.col("rank_a"))).alias("parent"))
    first = top.where("rank = 1").select(F.col("pos").alias("first"))
    rows = top.where("rank > 1").join(best, "pos", "left").crossJoin(F.broadcast(first))  # one row
    return rows.select(F.coalesce("parent", "first").alias("parent"), F.col("pos").alias("child"), "rank")


def ancestors(edges: DataFrame, rounds: int) -> DataFrame:
    """(ancestor, child, distance) of all pairs of a tree by doubling; rounds: the base-2 logarithm of its depth, rounded up."""
    paths = cut(edges.select(F.col("parent").alias("ancestor"), "child", F.lit(1).alias("distance")))
    for _ in range(rounds):
        upper = paths.select("ancestor", F.col("child").alias("via"), F.col("distance").alias("above"))
        lower = paths.select(F.col("ancestor").alias("via"), "child", F.col("distance").alias("below"))
        longer = upper.join(lower, "via").select("ancestor", "child", (F.col("above") + F.col("below")).alias("distance"))
        paths = cut(paths.unionByName(longer).distinct())
    return paths


def indistinguishable(states: DataFrame, names: DataFrame) -> DataFrame:
    """(name, members) of variants that have equal states in all samples, missing ones too; names joined by |.

    A variant's states are summed up in a 128-bit hash of its rows other than 0, so no variant's samples are collected.
    """
    rows = states.where("state is null or state = 1")
    sign = [F.bit_xor(F.xxhash64(F.lit(k), "sample", F.coalesce("state", F.lit(-1)))).alias(f"h{k}") for k in range(2)]
    signed = rows.groupBy("pos").agg(*sign, F.count("*").alias("n")).join(names, "pos")
    groups = signed.groupBy("h0", "h1", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "variant"))).alias("v"))
    return groups.where(F.size("v") > 1).select(F.array_join(F.transform("v", lambda x: x["variant"]), "|").alias("name"), F.size("v").cast("long").alias("members"))


def clade_means(states: DataFrame, samples: DataFrame) -> DataFrame:
    """(clade, pos, mean): mean state over the clade's samples that have one; pairs without a row are 0."""
    sizes = samples.groupBy("clade").agg(F.count("*").alias("size"))
    sums = states.join(samples, "sample").groupBy("clade", "pos").agg(F.coalesce(F.sum("state"), F.lit(0)).alias("ones"), F.count_if(F.col("state").isNull()).alias("missing"))
    return sums.join(sizes, "clade").select("clade", "pos", F.try_divide(F.col("ones"), F.col("size") - F.col("missing")).alias("mean"))


def by_dominance(rows: DataFrame, group: str, prefix: str) -> DataFrame:
    """(group, n, label): groups by falling size, labelled prefix01, prefix02 and so on."""
    n = rows.groupBy(group).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), group))  # one row a group
    return n.withColumn("label", F.concat(F.lit(prefix), F.lpad(rank.cast("string"), 2, "0")))


def memo_sort(states: DataFrame, top: DataFrame) -> DataFrame:
    """(sample, score): the binary number that a sample's states of the leading variants make, as text of one digit a variant, so that it has no
    largest number of variants and sorts as the number does."""
    rows = states.where("state = 1").join(top.select("pos", "rank"), "pos").groupBy("sample").agg(F.collect_set("rank").alias("ranks"))
    rows = rows.withColumn("every", F.sequence(F.lit(1), top.agg(F.max("rank")).scalar()))
    return rows.select("sample", F.array_join(F.transform("every", lambda i: F.when(F.array_contains("ranks", i), "1").otherwise("0")), "").alias("score"))


def memo_order(states: DataFrame, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((sample, place), (pos, place)): columns and rows of a memo-sorted matrix of the samples' leading variants, places from 1.

    Samples are ordered by falling score (see memo_sort), then by name; variants then by the rising number that their states make in that order, then by
    rank. Scores aren't spelled out: two of them compare as the lists of their ones' places do, a list's end counting as the smallest digit.
    """
    ones = states.where("state = 1").join(top.select("pos", "rank"), "pos").select("sample", "pos", "rank")
    end = F.array(F.lit(2**31 - 1).cast("long"))
    own = ones.groupBy("sample").agg(F.concat(F.sort_array(F.collect_list(F.col("rank").cast("long"))), end).alias("key"))
    columns = cut(numbered(own, [], ["key", "sample"], "at").select("sample", (F.col("at") + 1).alias("place")))
    held = ones.join(columns, "sample").groupBy("pos", "rank").agg(F.transform(F.concat(F.sort_array(F.collect_list("place")), end), lambda x: -x).alias("key"))
    rows = numbered(held, [], ["key", "rank"], "at").select("pos", (F.col("at") + 1).alias("place"))
    return columns, rows


def by_cluster(samples: DataFrame, group: str) -> DataFrame:
    """(sample, group, place, label): samples with a group in order of group, then name, as heat maps show them, placed from 1; labels number them within
    their group, as SC#1.12."""
    rows = samples.where(F.col(group).isNotNull()).select("sample", group)
    within = numbered(rows, [group], ["sample"], "own", "size")
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a group
    placed = within.join(sizes.select(group, before.alias("before")), group)
    label = F.concat_ws(".", F.col(group).cast("string"), (F.col("own") + 1).cast("string"))
    return placed.select("sample", group, (F.col("before") + F.col("own") + 1).alias("place"), label.alias("label"))


def ancestors_rounds(k: int) -> int:
    return max(1, (k - 1).bit_length())


def clone_genotypes(tree: DataFrame, closure: DataFrame, top: DataFrame) -> DataFrame:
    """(clone, pos): the variants of each clone, its own and its ancestors'; clones are numbered by the rank of their own variant."""
    own = top.select(F.col("rank").alias("clone"), "pos")
    above = closure.join(top.select(F.col("pos").alias("child"), F.col("rank").alias("clone")), "child").select("clone", F.col("ancestor").alias("pos"))
    return own.unionByName(above).distinct()


def attachments(states: DataFrame, samples: DataFrame, genotypes: DataFrame, top: DataFrame, clones: int, alpha: float, beta: float, crossed: bool = True) -> DataFrame:
    """(sample, clone, log_likelihood): the clone of largest likelihood for each sample, the smallest number on ties; 0 is the root without variants.

    Of a sample's states of the leading variants, per clone: beta for a 0 where the clone has the variant, 1 - beta where it has not,
    alpha for a 1 where it has not, 1 - alpha where it has, as the published analysis ran; with crossed=False the chances of right states are those
    of alpha as the rate of false ones and beta as that of false zeros: 1 - alpha for a 0, 1 - beta for a 1. Missing states contribute nothing. States are counted, not listed: pairs without a row are
    0, so what isn't a 1 or missing follows from the sizes.
    """
    rows = states.where("state is null or state = 1").join(top.select("pos"), "pos")
    own = rows.groupBy("sample").agg(F.count("state").alias("ones"), F.count_if(F.col("state").isNull()).alias("gone"))
    inside = rows.join(genotypes, "pos").groupBy("sample", "clone").agg(F.count("state").alias("ones_in"), F.count_if(F.col("state").isNull()).alias("gone_in"))
    sizes = genotypes.groupBy("clone").agg(F.count("*").alias("size"))
    grid = samples.select("sample").withColumn("clone", F.explode(F.sequence(F.lit(0), F.lit(clones))))
    full = grid.join(sizes, "clone", "left").join(own, "sample", "left").join(inside, ["sample", "clone"], "left").fillna(0)
    total = top.agg(F.count("*")).scalar()
    outside = F.col("ones") - F.col("ones_in")
    missed = F.col("size") - F.col("ones_in") - F.col("gone_in")
    absent = total - F.col("size") - outside - (F.col("gone") - F.col("gone_in"))
    ln = lambda p: F.ln(F.lit(p))
    zero, one = (1 - beta, 1 - alpha) if crossed else (1 - alpha, 1 - beta)
    score = missed * ln(beta) + absent * ln(zero) + outside * ln(alpha) + F.col("ones_in") * ln(one)
    scored = full.select("sample", "clone", F.round(score, 6).alias("log_likelihood"))
    best = F.max_by(F.struct("clone", "log_likelihood"), F.struct("log_likelihood", -F.col("clone")))
    return scored.groupBy("sample").agg(best.alias("x")).select("sample", "x.clone", "x.log_likelihood")


def prevalence(attached: DataFrame, clones: int) -> DataFrame:
    """(clone, n, prevalence) of all clones; null for those without samples."""
    n = attached.groupBy("clone").agg(F.count("*").alias("n"))
    every = attached.sparkSession.range(clones + 1).select(F.col("id").cast("int").alias("clone"))
    return every.join(n, "clone", "left").withColumn("prevalence", F.col("n") / attached.agg(F.count("*")).scalar())


def adjacency(genotypes: DataFrame, top: DataFrame) -> DataFrame:
    """(parent, child): the variants' tree read off the clones' genotypes (clone, pos), clones being numbered by the rank of their own variant.

    A clone's genotype lists its own variant and its ancestors'; the parent is the ancestor with one variant less.
    """
    sizes = genotypes.groupBy("clone").agg(F.count_distinct("pos").alias("size"))
    held = genotypes.join(top.select("pos", F.col("rank").alias("above")), "pos").where("above <> clone").select("clone", "above", F.col("pos").alias("parent"))
    rows = held.join(sizes, "clone").join(sizes.selectExpr("clone as above", "size as size_above"), "above").where("size_above = size - 1")
    return rows.join(top.select(F.col("rank").alias("clone"), F.col("pos").alias("child")), "clone").select("parent", "child")


def contained(genotypes: DataFrame) -> DataFrame:
    """(genotype, parent) of every genotype (genotype, pos: sets of variants): the largest other one that it contains, of equally large ones the first by name, null
    where there is none. Of equal genotypes the first by name stands for all, and the others are its children.

    A genotype is listed under its rarest variant only; those that have this variant are candidates, and what they have in common is then counted. So
    a variant that all genotypes have lists none but the genotype without any other.
    """
    rows = genotypes.select("genotype", "pos").distinct()
    spread = rows.groupBy("pos").agg(F.count("*").alias("held"))
    rare = rows.join(spread, "pos").groupBy("genotype").agg(F.min_by("pos", F.struct("held", "pos")).alias("pos"), F.count("*").alias("size"))
    rows = rows.join(rare.select("genotype", "size"), "genotype")
    lists = rare.select(F.col("genotype").alias("small"), "pos", F.col("size").alias("least"))
    pairs = rows.join(lists, "pos").where("small <> genotype and (least < size or least = size and small < genotype)").select("genotype", "small", "least")
    common = pairs.join(rows.select("genotype", "pos"), "genotype").join(rows.select(F.col("genotype").alias("small"), "pos"), ["small", "pos"])
    inside = common.groupBy("genotype", "small", "least").agg(F.count("*").alias("k")).where("k = least")
    best = inside.groupBy("genotype").agg(F.min_by("small", F.struct(-F.col("least"), "small")).alias("parent"))
    return rare.select("genotype").join(best, "genotype", "left")


def genotype_tree(genotypes: DataFrame, attached: DataFrame, root: str = "Root", reference: str = "Reference") -> DataFrame:
    """(parent, child, length, kind): a phylogeny of genotypes (genotype, pos) that may have several roots, which all stand under `root`.

    clone: each genotype under the largest one that it contains, at the number of variants that it has more; sample: samples (sample, genotype) under theirs, at
    0, those without variants (genotype null) under the root; hidden: a tip hidden_<genotype> at 0 under each genotype that is no other's parent and has no
    sample; reference: the reference at 0 under the root.
    """
    inner = cut(contained(genotypes))
    sizes = genotypes.groupBy("genotype").agg(F.count_distinct("pos").alias("size"))
    lengths = inner.join(sizes, "genotype").join(sizes.selectExpr("genotype as parent", "size as size_above"), "parent", "left")
    length = F.col("size") - F.coalesce("size_above", F.lit(0))
    edges = lengths.select(F.coalesce("parent", F.lit(root)).alias("parent"), F.col("genotype").alias("child"), length.alias("length"), F.lit("clone").alias("kind"))
    zero = F.lit(0).cast("long").alias("length")
    tips = attached.select(F.coalesce("genotype", F.lit(root)).alias("parent"), F.col("sample").cast("string").alias("child"), zero, F.lit("sample").alias("kind"))
    leaves = inner.select("genotype").join(inner.selectExpr("parent as genotype"), "genotype", "left_anti").join(attached.select("genotype"), "genotype", "left_anti")
    hidden = leaves.select(F.col("genotype").alias("parent"), F.concat(F.lit("hidden_"), "genotype").alias("child"), zero, F.lit("hidden").alias("kind"))
    own = genotypes.sparkSession.range(1).select(F.lit(root).alias("parent"), F.lit(reference).alias("child"), zero, F.lit("reference").alias("kind"))
    return edges.unionByName(tips).unionByName(hidden).unionByName(own)
