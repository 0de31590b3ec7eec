"""Reports on genotypes, trees and labels: what the variant analyses hand on to tables and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacewing.operators.contexts import CLASSES, FOLDED

#: Substitutions by complementary pair, in the order of their numbers.
PAIRS = tuple((change, next(other for other, same in FOLDED.items() if same == change)) for change in CLASSES)
#: Characters of names in a lot of merged variants that are told apart together.
LOT = 1 << 26


def parsed(variant: Column) -> dict[str, Column]:
    """pos, ref and alt of a name pos_ref_alt; null where it has another form."""
    fields = F.split(variant, "_")
    well = variant.rlike("^[0-9]+_[ACGT]_[ACGT]$")
    return {"pos": F.when(well, fields[0].cast("long")), "ref": F.when(well, fields[1]), "alt": F.when(well, fields[2])}


def pair_label(change: Column) -> Column:
    """`C>A | G>T` and so on for either substitution of a pair."""
    return F.coalesce(*[F.when(change.isin(a, b), F.lit(f"{a} | {b}")) for a, b in PAIRS])


def pair_number(change: Column) -> Column:
    return F.coalesce(*[F.when(change.isin(a, b), F.lit(i)) for i, (a, b) in enumerate(PAIRS, 1)])


def by_base_content(counts: DataFrame, genome: DataFrame) -> DataFrame:
    """counts (change, n) over the genome's number of the changed base: adds content and rate."""
    content = genome.groupBy("base").agg(F.count("*").alias("content"))
    rows = counts.withColumn("base", F.substring("change", 1, 1)).join(F.broadcast(content), "base")  # four rows
    return rows.select("change", "n", "content", (F.col("n") / F.col("content")).alias("rate"))


def corrected_genotypes(attached: DataFrame, genotypes: DataFrame) -> DataFrame:
    """(sample, pos): the variants of the clone that each sample is attached to."""
    return attached.select("sample", "clone").join(genotypes, "clone").select("sample", "pos")


def confusion(states: DataFrame, corrected: DataFrame, top: DataFrame, n: Column) -> DataFrame:
    """(pos, tp, fp, fn, tn, hamming) of observed states against corrected genotypes, by variant of top; missing states count nowhere.

    Pairs without a row have state 0, so true negatives follow from the number of samples.
    """
    rows = states.join(top.select("pos"), "pos", "left_semi").where("state is null or state = 1")
    both = rows.withColumn("seen", F.lit(True)).join(corrected.withColumn("expected", F.lit(True)), ["sample", "pos"], "full")
    one, expected, gone = F.col("state") == 1, F.col("expected").isNotNull(), F.col("seen").isNotNull() & F.col("state").isNull()
    sums = both.groupBy("pos").agg(
        F.count_if(one & expected).alias("tp"), F.count_if(one & ~expected).alias("fp"), F.count_if(F.col("seen").isNull() & expected).alias("fn"), F.count_if(gone).alias("gone")
    )
    rest = top.select("pos").join(sums, "pos", "left").fillna(0)
    rest = rest.withColumn("tn", n - F.col("tp") - F.col("fp") - F.col("fn") - F.col("gone"))
    return rest.select("pos", "tp", "fp", "fn", "tn", (F.col("fp") + F.col("fn")).alias("hamming"))


def mutation_sets(genotypes: DataFrame, key: str) -> DataFrame:
    """(key, size, set): positions of each genotype in order, joined by commas."""
    sets = genotypes.groupBy(key).agg(F.array_sort(F.collect_set("pos")).alias("s"))
    return sets.select(key, F.size("s").cast("long").alias("size"), F.array_join(F.col("s").cast("array<string>"), ",").alias("set"))


def equal_genotypes(observed: DataFrame, clones: DataFrame) -> DataFrame:
    """(sample, clone) of samples whose set of variants is just that of a clone; both as of mutation_sets."""
    return observed.join(clones.select("clone", "set"), "set").select("sample", "clone")


def mean_variants(states: DataFrame, samples: DataFrame, group: str) -> DataFrame:
    """(group, n_samples, mean): sum of the variants' mean states; missing ones count as samples without."""
    sizes = samples.groupBy(group).agg(F.count_distinct("sample").alias("n_samples"))
    ones = states.where("state = 1").join(samples.select("sample", group), "sample").groupBy(group).agg(F.count("*").alias("ones"))
    return sizes.join(ones, group, "left").select(group, "n_samples", (F.coalesce("ones", F.lit(0)) / F.col("n_samples")).alias("mean"))


def manhattan(genotypes: DataFrame, key: str) -> DataFrame:
    """(a, b, distance) of every two genotypes (key, pos), a before b: variants that one of them has. Those in common are counted by an equi-join; the
    genotypes are the few clones of a tree."""
    sizes = genotypes.groupBy(key).agg(F.count_distinct("pos").alias("size"))
    side = lambda df, name: df.select(F.col(key).alias(name), *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c not in (key, "pos")], *(["pos"] if "pos" in df.columns else []))
    rows = genotypes.distinct()
    common = side(rows, "a").join(side(rows, "b"), "pos").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    pairs = side(sizes, "a").join(side(sizes, "b"), F.col("a") < F.col("b")).join(common, ["a", "b"], "left")
    return pairs.select("a", "b", (F.col("size_a") + F.col("size_b") - 2 * F.coalesce("common", F.lit(0))).alias("distance"))


def tree_edges(tree: DataFrame, top: DataFrame, genotypes: DataFrame, attached: DataFrame) -> DataFrame:
    """(parent, child, length, kind): clones under each other, the first under the root 0, at the distance of their genotypes, and samples under their
    clones at 0. tree: (parent, child) positions."""
    rank = top.select(F.col("pos").alias("p"), F.col("rank").alias("clone"))
    sizes = genotypes.groupBy("clone").agg(F.count("*").alias("size"))
    named = rank.join(tree.select(F.col("child").alias("p"), F.col("parent").alias("q")), "p", "left").join(rank.selectExpr("p as q", "clone as above"), "q", "left")
    named = named.join(sizes, "clone").join(sizes.selectExpr("clone as above", "size as size_above"), "above", "left")
    length = F.col("size") - F.coalesce("size_above", F.lit(0))
    inner = named.select(F.concat(F.lit("G"), F.coalesce("above", F.lit(0)).cast("string")).alias("parent"), F.concat(F.lit("G"), F.col("clone").cast("string")).alias("child"), length.alias("length"), F.lit("clone").alias("kind"))
    tips = attached.select(F.concat(F.lit("G"), F.col("clone").cast("string")).alias("parent"), F.col("sample").cast("string").alias("child"), F.lit(0).cast("long").alias("length"), F.lit("sample").alias("kind"))
    return inner.unionByName(tips)


def tip_clades(edges: DataFrame) -> DataFrame:
    """(tip, clade): the direct parent of each node that is nobody's parent."""
    return edges.select(F.col("child").alias("tip"), F.col("parent").alias("clade")).join(edges.select(F.col("parent").alias("tip")).distinct(), "tip", "left_anti")


def rerooted(edges: DataFrame, paths: DataFrame, root: Column) -> DataFrame:
    """(parent, child, length) with the edges between the new root and the old one turned round. paths: (ancestor, child) of all pairs of the tree."""
    above = paths.where(F.col("child") == root).select(F.col("ancestor").alias("node")).union(edges.sparkSession.range(1).select(root.alias("node")))
    on_path = edges.join(above.withColumnRenamed("node", "child"), "child", "left_semi").select("parent", "child")
    turned = edges.join(on_path.withColumn("turn", F.lit(True)), ["parent", "child"], "left")
    return turned.select(F.when(F.col("turn"), F.col("child")).otherwise(F.col("parent")).alias("parent"), F.when(F.col("turn"), F.col("parent")).otherwise(F.col("child")).alias("child"), "length")


def with_outgroup(edges: DataFrame, root: Column, name: str = "Outgroup") -> DataFrame:
    """edges (parent, child, length) with an outgroup's tip at 0 under the root."""
    tip = edges.sparkSession.range(1).select(root.cast("string").alias("parent"), F.lit(name).alias("child"), F.lit(0).cast("long").alias("length"))
    named = edges.select(F.col("parent").cast("string").alias("parent"), F.col("child").cast("string").alias("child"), F.col("length").cast("long").alias("length"))
    return named.unionByName(tip)


def labelled_nodes(edges: DataFrame, tips: DataFrame, root: Column, reference: str = "Reference") -> DataFrame:
    """(node, label) of the inner nodes of edges (parent, child, length): the label that most of the tips (tip, label) right below have, the first of equally
    many, null where no such tip has one; the root is the reference."""
    inner = edges.select(F.col("parent").alias("node")).distinct()
    below = edges.join(tips.select(F.col("tip").alias("child"), "label"), "child").where("label is not null").groupBy(F.col("parent").alias("node"), "label").agg(F.count("*").alias("n"))
    named = below.groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
    return inner.join(named, "node", "left").select("node", F.when(F.col("node") == root.cast("string"), reference).otherwise(F.col("label").cast("string")).alias("label"))


def cumulative_frequencies(rows: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """(group, bin, n, share): values up to each of so many bins of [0, 1], as counts and as a share of the group's largest count.

    Values are counted by bin first; the running sum goes over one row a bin.
    """
    bin_ = F.greatest(F.lit(1), F.ceil(F.round(F.col(value) * bins, 9))).cast("int")
    counts = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, bin_.alias("bin")).agg(F.count("*").alias("k"))
    grid = counts.select(group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    upto = Window.partitionBy(group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(counts, [group, "bin"], "left").withColumn("n", F.sum(F.coalesce("k", F.lit(0))).over(upto))
    return rows.select(group, "bin", "n", (F.col("n") / F.max("n").over(Window.partitionBy(group))).alias("share"))


def distinct_by_class(facts: DataFrame, kind: str) -> DataFrame:
    """(kind, n_samples, n_variants): distinct samples and variants of each class."""
    return facts.groupBy(kind).agg(F.count_distinct("sample").alias("n_samples"), F.count_distinct("pos").alias("n_variants"))


def first_match(rows: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the columns of the table's first row, by order, of the same key; nulls where there is none."""
    others = [c for c in table.columns if c != key]
    first = table.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("x"))
    return rows.join(first, key, "left").select(*rows.columns, *[F.col(f"x.{c}").alias(c) for c in others])


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key the others lack."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def nearest(points: DataFrame, positions: DataFrame, width: int) -> DataFrame:
    """(point, at_or_after, at_or_before): the nearest position on either side of each point (a column of longs each), null where there is none.

    Positions are summed up by stretches of `width`, of which each point looks at its own rows and at the running ends of the stretches; so the only order
    over all is one of one row a stretch.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    ends = positions.groupBy(bucket("pos").alias("k")).agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("pos").alias("own"))
    every = ends.join(points.select(bucket("point").alias("k")).distinct(), "k", "full")
    order = Window.orderBy("k")  # one row a stretch
    after = F.first("low", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    before = F.last("high", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumns({"after": after, "before": before})
    rows = points.withColumn("k", bucket("point")).join(every, "k", "left")
    own_after = F.array_min(F.filter("own", lambda p: p >= F.col("point")))
    own_before = F.array_max(F.filter("own", lambda p: p <= F.col("point")))
    return rows.select("point", F.coalesce(own_after, "after").alias("at_or_after"), F.coalesce(own_before, "before").alias("at_or_before"))


def split_merged(merged: DataFrame) -> DataFrame:
    """(name, variant, first): each variant of a merged name a|b|c, and whether it is the one that stands for all.

    The result has each name as often as it has variants, so it grows with their square. It is therefore made in lots of about LOT characters, dealt over all tasks, and the longest
    names come first in each: a writer that guesses from the first rows how many of them it may hold never holds too many.
    """
    parts = F.split("name", r"\|")
    lots = F.greatest(F.lit(1), F.ceil(F.length("name").cast("long") * F.size(parts) / LOT)).cast("int")
    dealt = merged.select("name", lots.alias("lots")).select("name", "lots", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    dealt = dealt.repartition("name", "lot").sortWithinPartitions(F.length("name").desc())
    each = F.ceil(F.size(parts) / F.col("lots")).cast("int")
    own = dealt.select("name", "lot", F.posexplode(F.slice(parts, F.col("lot") * each + 1, each)).alias("i", "variant"))
    return own.select("name", "variant", ((F.col("lot") == 0) & (F.col("i") == 0)).alias("first"))


def stand_ins(members: DataFrame) -> DataFrame:
    """(variant, first, name): the name of those of the merged variants that stand for all, null for the others."""
    return members.select("variant", "first", F.when(F.col("first"), F.col("name")).alias("name"))


def represented(states: DataFrame, names: DataFrame, members: DataFrame) -> DataFrame:
    """States (sample, variant, state) with one column for each group of merged variants: others are dropped, and it is renamed to the group's name.

    members: as of split_merged, not stored, so that names of variants that are dropped go where they are made."""
    rows = states.join(names, "pos").join(stand_ins(members), "variant", "left").where("first is null or first")
    return rows.select("sample", F.coalesce("name", "variant").alias("variant"), "state")


def wide(rows: DataFrame, key: str, column: str, value: str, columns: list[str], fill: object) -> DataFrame:
    """Long to wide with the columns given, in their order; fill where there is no row."""
    return rows.groupBy(key).pivot(column, columns).agg(F.first(value)).fillna(fill)


def oncoprint(states: DataFrame, top: DataFrame, groups: DataFrame, missing: int) -> DataFrame:
    """(group, sample, rank, pos, state) of the leading variants, missing states as 0 or 1 as asked; pairs without a row are left out, as they are 0."""
    rows = states.where("state is null or state = 1").join(top.select("pos", "rank"), "pos").join(groups, "sample")
    return rows.select("group", "sample", "rank", "pos", F.coalesce("state", F.lit(missing)).cast("int").alias("state"))


def aligned(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the first matrix (sample, pos, ...) whose sample and variant the second one has."""
    return first.join(second.select("sample").distinct(), "sample", "left_semi").join(second.select("pos").distinct(), "pos", "left_semi")


def renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """rows with the values of a column replaced by a table's (old, name, place), and their place; those without a name go. So columns of a matrix are reordered
    and renamed in long form."""
    kept = [c for c in rows.columns if c != column]
    return rows.join(names.select(F.col("old").alias(column), "name", "place"), column).select(*kept, F.col("name").alias(column), "place")


def product(a: DataFrame, b: DataFrame, inner: str, left: str, right: str, out: str) -> DataFrame:
    """The product of two matrices in long form, a with a column of values left and b with right, over their common index; cells without a row are 0."""
    outer = [c for c in (*a.columns, *b.columns) if c not in (inner, left, right)]
    return a.join(b, inner).groupBy(*outer).agg(F.sum(F.col(left) * F.col(right)).alias(out))
