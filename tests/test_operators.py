"""Small fixtures with results computed by hand."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lacewing.operators import calls as C
from lacewing.operators import coding as K
from lacewing.operators import contexts as X
from lacewing.operators import landscape as L
from lacewing.operators import phylogeny as P
from lacewing.operators import stats as S


def test_mask_order(spark):
    rows = [(vf, n, p, c) for vf in (0.05, 0.06) for n in (2.0, 3.0) for p in (0.0099, 0.01) for c in (19.0, 20.0)]
    got = spark.createDataFrame(rows, "vf double, alt_count double, pvalue double, coverage double").withColumn("m", C.masked()).collect()
    for r in got:
        expected = None if r.coverage < 20 or r.pvalue >= 0.01 else 0.0 if r.alt_count < 3 or r.vf <= 0.05 else r.vf
        assert r.m == expected
    empty = spark.createDataFrame([(0.5, None, None, None)], "vf double, alt_count double, pvalue double, coverage double").withColumn("m", C.masked())
    assert empty.first().m == 0.5


def test_missing_rate_is_strict(spark):
    rows = [(s, p, None if s < k else 0.5) for p, k in enumerate((0, 1, 2)) for s in range(4)]
    calls = spark.createDataFrame(rows, "sample int, pos int, vf double")
    assert [r.pos for r in C.seen_enough(calls, F.lit(4), "vf").collect()] == [0]


def test_clonal_cut(spark):
    got = spark.createDataFrame([(0.90,), (0.91,), (0.05,), (0.5,), (None,)], "vf double").select(C.binarised(F.col("vf")).alias("s"), C.ambiguity(F.col("vf")).alias("c")).collect()
    assert [r.s for r in got] == [None, 1, 0, None, None]
    assert [r.c for r in got] == ["{0,1}", "1", "{0,1}", "{0,1}", "{0,1}"]


def test_folding_keeps_flanks(spark):
    rows = [(f"{a}>{b}",) for a in "ACGT" for b in "ACGT" if a != b]
    got = {r.c: r.f for r in spark.createDataFrame(rows, "c string").withColumn("f", X.folded(F.col("c"))).collect()}
    assert got["G>T"] == "C>A" and got["A>C"] == "T>G" and got["C>A"] == "C>A" and set(got.values()) == set(X.CLASSES)
    genome = spark.createDataFrame([(1, "A"), (2, "G"), (3, "C")], "pos int, base string")
    variants = spark.createDataFrame([(2, "G", "T", "2_G_T"), (1, "A", "C", "1_A_C")], "pos int, ref string, alt string, variant string")
    assert [r.context for r in X.in_context(variants, genome).collect()] == ["A[C>A]C"]


def test_variant_types(spark):
    rows = [(1, 0.95), (1, 0.99), (2, 0.5), (2, 0.90), (3, 0.95), (3, 0.1), (4, 0.95), (4, 0.5), (5, 0.05)]
    calls = spark.createDataFrame(rows, "pos int, vf double").withColumn("sample", F.lit(1))
    got = {r.pos: (r.type, r.true_transition) for r in L.mutation_types(calls).collect()}
    assert got == {1: ("always clonal", False), 2: ("always minor", False), 3: ("mixed", True), 4: ("mixed", False)}


def test_residual_cluster(spark):
    counts = spark.createDataFrame([(1, 2, 0, 0.1), (2, 0, 1, 0.0), (3, 1, 1, 0.2)], "sample int, n_minor long, n_clonal long, mean_minor double")
    collected = spark.createDataFrame([(i, "2020-05-01") for i in (1, 2, 3)], "sample int, d string").select("sample", F.to_date("d").alias("collection_date"))
    samples = spark.createDataFrame([(1, 7, None), (2, 7, "SC#1"), (3, 7, "SC#2")], "sample int, clade int, cluster string")
    got = {r.sample: (r.cluster, r.week_bin) for r in L.sample_statistics(counts, collected, samples).collect()}
    assert got == {1: ("SC#4", "16-18"), 2: (None, "16-18"), 3: ("SC#2", "16-18")}


def test_overlapping_frames_and_codons(spark):
    frames = spark.createDataFrame([(0, 1, 3, "5UTR", "U"), (1, 4, 9, "CDS", "A"), (2, 7, 12, "CDS", "B")], "orf int, first int, last int, region string, name string")
    positions = spark.createDataFrame([(2, "A"), (6, "A"), (7, "A"), (20, "A")], "pos int, alt string")
    got = {r.pos: (r.region, r.orf, r.codon_position) for r in L.annotated(positions, frames).collect()}
    assert got == {2: ("5UTR", "U", None), 6: ("CDS", "A", 3), 7: ("CDS", "B", 1), 20: ("intergenic", "intergenic", None)}
    assert len(K.standard_code()) == 64 and K.standard_code()["ATG"] == "M" and K.standard_code()["TGA"] == "*"


def test_spread_classes(spark):
    rows = [(1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 1, 1), (3, 2, 2)]
    got = {r.pos: r["class"] for r in L.spread(spark.createDataFrame(rows, "pos int, sample int, clade int")).collect()}
    assert got == {1: "private", 2: "1 clade", 3: ">=2 clades"}


def test_five_numbers_are_hinges(spark):
    rows = [(n, float(i)) for n in (4, 5, 6, 7) for i in range(1, n + 1)]
    got = {r.g: (r.low, r.lower_hinge, r.middle, r.upper_hinge, r.high) for r in S.five_numbers(spark.createDataFrame(rows, "g int, x double"), "g", "x").collect()}
    assert got == {4: (1, 1.5, 2.5, 3.5, 4), 5: (1, 2, 3, 4, 5), 6: (1, 2, 3.5, 5, 6), 7: (1, 2.5, 4, 5.5, 7)}


def test_benjamini_hochberg_with_nulls_and_ties(spark):
    rows = [(1, 0.01), (2, 0.02), (3, 0.02), (4, None), (5, 0.5)]
    got = {r.i: r.q for r in S.benjamini_hochberg(spark.createDataFrame(rows, "i int, p double").withColumn("f", F.lit(1)), "p", "f").collect()}
    assert got[4] is None and math.isclose(got[1], 0.02 * 4 / 3) and math.isclose(got[2], 0.02 * 4 / 3) and math.isclose(got[5], 0.5)


def test_kolmogorov_smirnov_and_spearman(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), (None, 9.0)]
    assert [(r.a, r.b, r.d) for r in S.kolmogorov_smirnov(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()] == [("a", "b", 0.5)]
    pairs = [(1, float(i), float(i * i)) for i in range(4)] + [(2, 1.0, 1.0), (2, 2.0, 1.0), (2, 3.0, 1.0), (3, 1.0, 2.0)]
    got = {r.g: r.rho for r in S.spearman(spark.createDataFrame(pairs, "g int, x double, y double"), "g", "x", "y").collect()}
    assert math.isclose(got[1], 1.0) and got[2] is None and 3 not in got


def test_merging_needs_equal_missing_states(spark):
    rows = [(1, 10, 1), (2, 10, None), (1, 11, 1), (2, 11, None), (1, 12, 1), (2, 12, 0), (1, 13, 1)]
    names = spark.createDataFrame([(p, f"v{p}") for p in (10, 11, 12, 13)], "pos int, variant string")
    got = P.indistinguishable(spark.createDataFrame(rows, "sample int, pos int, state int"), names).collect()
    assert sorted(r.name for r in got) == ["v10|v11", "v12|v13"]


def test_start_tree_and_closure(spark):
    rows = [(s, p, 1) for p, carriers in ((1, range(8)), (2, range(6)), (3, range(4)), (4, (6, 7))) for s in carriers]
    states = spark.createDataFrame(rows, "sample int, pos int, state int")
    top = P.ranked(C.frequent(states, F.lit(10)))
    tree = P.start_tree(P.associated(states, top, F.lit(10)), top)
    assert sorted((r.parent, r.child) for r in tree.collect()) == [(1, 2), (1, 4), (2, 3)]
    closure = {(r.ancestor, r.child, r.distance) for r in P.ancestors(tree.select("parent", "child"), 2).collect()}
    assert closure == {(1, 2, 1), (1, 4, 1), (2, 3, 1), (1, 3, 2)}


def test_contingency_has_zero_cells(spark):
    got = L.contingency(spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "k string, v string"), "k", "v").collect()
    assert {(r.k, r.v): (r.n, r.share) for r in got} == {("a", "x"): (2, 1.0), ("a", "y"): (0, 0.0), ("b", "x"): (0, 0.0), ("b", "y"): (1, 1.0)}


def test_attachment(spark):
    top = spark.createDataFrame([(10, 5, 1), (20, 3, 2)], "pos int, carriers long, rank int")
    genotypes = spark.createDataFrame([(1, 10), (2, 10), (2, 20)], "clone int, pos int")
    states = spark.createDataFrame([(1, 10, 1), (1, 20, 1), (2, 10, 1), (3, 10, None), (3, 20, None)], "sample int, pos int, state int")
    samples = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "sample int")
    attached = P.attachments(states, samples, genotypes, top, 2, 0.01, 0.05)
    assert {r.sample: r.clone for r in attached.collect()} == {1: 2, 2: 1, 3: 0, 4: 0}
    assert {r.clone: (r.n, r.prevalence) for r in P.prevalence(attached, 3).collect()} == {0: (2, 0.5), 1: (1, 0.25), 2: (1, 0.25), 3: (None, None)}
