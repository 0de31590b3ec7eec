"""Reports, selection and text formats on small fixtures with results computed by hand or by brute force."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from lacewing.operators import phylogeny as P
from lacewing.operators import reports as R
from lacewing.operators import selection as S
from lacewing.sources import text as X


def test_frameshift(spark):
    """13467, 13468 and 13469 in a frame from 266: before the slip, on it, after it."""
    slip = ("ORF1ab", 13468 - 266 + 1)
    rows = spark.createDataFrame([(p, 266, n) for p in (13467, 13468, 13469) for n in ("ORF1ab", "S")], "pos int, first int, name string")
    args = (F.col("pos"), F.col("first"), F.col("name"), slip)
    got = {(r.pos, r.name): (r.o, r.c) for r in rows.select("pos", "name", S.offset_in_frame(*args).alias("o"), S.codon_position(*args).alias("c")).collect()}
    assert got[13467, "ORF1ab"] == (13202, 2) and got[13468, "ORF1ab"] == (13203, None) and got[13469, "ORF1ab"] == (13205, 2)
    assert got[13468, "S"] == (13203, 3) and got[13469, "S"] == (13204, 1)


def test_coding_positions_and_expected_changes(spark):
    frames = spark.createDataFrame([(1, 4, 9, "CDS", "A"), (0, 1, 3, "5UTR", "U"), (2, 9, 11, "CDS", "B")], "orf int, first int, last int, region string, name string")
    genome = spark.createDataFrame([(i, b) for i, b in enumerate("CCCATGTTTAAC", 1)], "pos int, base string")
    coding = S.coding_positions(frames, genome, ("A", 3))
    got = [(r.idx, r.pos, r.base) for r in coding.orderBy("idx").collect()]
    assert got == [(1, 4, "A"), (2, 5, "T"), (3, 6, "G"), (4, 6, "G"), (5, 7, "T"), (6, 8, "T"), (7, 9, "T"), (8, 9, "T"), (9, 10, "A"), (10, 11, "A")]
    changes = S.possible_changes(coding).collect()
    assert sum(r.n for r in changes) == 27 and all(r.effect == "NS" for r in changes if r.at == 1)  # ATG is the only one of its amino acid
    assert sum(r.n for r in changes if r.at == 4 and r.effect == "S") == 3  # GTT: the third base is free
    prevalence = spark.createDataFrame([("c", x, 0.5) for x in ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")], "cluster string, change string, share double")
    by_codon = S.expected_by_codon(S.possible_changes(coding), prevalence)
    windows = {r.start: (r.e_ns, r.e_s) for r in S.expected_windows(by_codon, F.lit(10), 6, 3).collect()}
    # ATG and GTT begin in the first window, GTT and the second frame's TAA (at 8, though no multiple of 3) in the second
    assert sorted(windows) == [1, 4] and math.isclose(windows[1][0], 7.5) and math.isclose(windows[1][1], 1.5) and math.isclose(sum(windows[4]), 9.0)
    mutations = spark.createDataFrame([("c", 6, "NS", "mixed"), ("c", 6, "NS", "mixed"), ("c", 8, "S", "always minor")], "cluster string, pos int, effect string, type string")
    seen = {r.start: (r.n_ns, r.n_s, r.n_mixed, r.n_always_minor) for r in S.observed_windows(mutations, coding, F.lit(10), 6, 3).collect()}
    assert seen == {1: (1, 1, 1, 1), 4: (1, 1, 1, 1)}  # position 6 is listed twice but counted once
    overall = S.dnds_overall(mutations, by_codon).first()
    assert overall.n_ns == overall.n_s == 1 and math.isclose(overall.dnds, overall.e_s / overall.e_ns)


def test_many_merged_variants_are_told_apart_in_lots(spark, monkeypatch):
    monkeypatch.setattr(R, "LOT", 2000)
    names = spark.range(1, 121).selectExpr("id as pos", "concat(id, '_A_C') as variant")
    states = names.selectExpr("pos % 2 as sample", "pos", "1 as state")
    members = R.split_merged(P.indistinguishable(states, names))
    groups = {k: [f"{i}_A_C" for i in range(1, 121) if i % 2 == k] for k in (0, 1)}
    assert {(r.name, r.variant, r.first) for r in members.collect()} == {("|".join(g), v, v == g[0]) for g in groups.values() for v in g} and members.count() == 120
    # each name is kept once, not with each of its variants
    assert R.stand_ins(members).agg(F.sum(F.length("name"))).first()[0] == sum(len("|".join(g)) for g in groups.values())
    assert {(r.sample, r.variant) for r in R.represented(states, names, members).collect()} == {(k, "|".join(g)) for k, g in groups.items()}


def test_merged_columns_are_split_and_represented(spark):
    rows = [(1, 10, 1), (2, 10, 1), (1, 11, 1), (2, 11, 1), (1, 12, 1)]
    states, names = spark.createDataFrame(rows, "sample int, pos int, state int"), spark.createDataFrame([(p, f"v{p}") for p in (10, 11, 12)], "pos int, variant string")
    members = R.split_merged(P.indistinguishable(states, names))
    assert {(r.name, r.variant, r.first) for r in members.collect()} == {("v10|v11", "v10", True), ("v10|v11", "v11", False)}
    got = {(r.sample, r.variant) for r in R.represented(states, names, members).collect()}
    assert got == {(1, "v10|v11"), (2, "v10|v11"), (1, "v12")}


def test_crossed_rates_and_confusion(spark):
    """A 1 without the variant costs alpha, a 0 with it beta; with alpha and beta crossed another clone wins."""
    top = spark.createDataFrame([(10, 5, 1), (20, 3, 2)], "pos int, carriers long, rank int")
    genotypes = spark.createDataFrame([(1, 10), (2, 10), (2, 20)], "clone int, pos int")
    states, samples = spark.createDataFrame([(1, 20, 1)], "sample int, pos int, state int"), spark.createDataFrame([(1,)], "sample int")
    clone = lambda a, b: P.attachments(states, samples, genotypes, top, 2, a, b).first().clone
    assert clone(0.001, 0.3) == 2 and clone(0.3, 0.001) == 0
    corrected = spark.createDataFrame([(1, 10), (2, 10), (2, 20)], "sample int, pos int")
    seen = spark.createDataFrame([(1, 10, 1), (1, 20, 1), (2, 10, None), (3, 20, 0)], "sample int, pos int, state int")
    got = {r.pos: (r.tp, r.fp, r.fn, r.tn, r.hamming) for r in R.confusion(seen, corrected, top, F.lit(4)).collect()}
    assert got == {10: (1, 0, 0, 2, 0), 20: (0, 1, 1, 2, 2)}


def test_nearest_position_on_either_side(spark):
    rnd = random.Random(1)
    points, positions = rnd.sample(range(500), 60), rnd.sample(range(500), 40)
    got = R.nearest(spark.createDataFrame([(p,) for p in points], "point long"), spark.createDataFrame([(p,) for p in positions], "pos long"), 16).collect()
    assert len(got) == 60
    for r in got:
        assert r.at_or_after == min((p for p in positions if p >= r.point), default=None) and r.at_or_before == max((p for p in positions if p <= r.point), default=None)


def test_trees_as_text(spark):
    edges = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("a", "x", 0), ("a", "y", 3)], "parent string, child string, length int")
    depth = spark.createDataFrame([("r", 0), ("a", 1), ("b", 1), ("x", 2), ("y", 2)], "node string, depth int")
    tree = X.newick_of(edges, depth).first()
    assert (tree.root, tree.newick) == ("r", "((x:0,y:3)a:1,b:2)r;")
    again = X.read_newick(spark.createDataFrame([(1, tree.newick), (2, "(p:0.5,(q,s));"), (3, None)], "tree int, newick string")).collect()
    assert {(r.parent, r.child, r.length) for r in again if r.tree == "1"} == {("r", "a", 1.0), ("r", "b", 2.0), ("a", "x", 0.0), ("a", "y", 3.0)}
    assert {(r.parent, r.child) for r in again if r.tree == "2"} == {("2:1", "q"), ("2:1", "s"), ("2:2", "p"), ("2:2", "2:1")}
    assert {(r.tip, r.clade) for r in R.tip_clades(edges).collect()} == {("b", "r"), ("x", "a"), ("y", "a")}
    paths = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("a", "y"), ("r", "x"), ("r", "y")], "ancestor string, child string")
    assert {(r.parent, r.child) for r in R.rerooted(edges, paths, F.lit("a")).collect()} == {("a", "r"), ("r", "b"), ("a", "x"), ("a", "y")}


def test_text_formats(spark, tmp_path):
    rows = [("one", i, b) for i, b in enumerate("ACGT" * 40, 1)] + [("two", 1, "A")]
    X.write_fasta(spark.createDataFrame(rows, "name string, pos long, base string"), f"{tmp_path}/fasta")
    assert sorted((r.name, r.pos, r.base) for r in X.read_fasta(spark, f"{tmp_path}/fasta").collect()) == sorted(rows)
    (tmp_path / "runs.txt").write_text("SRR1\n\n  SRR2 \n")
    assert [r.run for r in X.read_runs(spark, f"{tmp_path}/runs.txt").collect()] == ["SRR1", "SRR2"]
    frames = spark.createDataFrame([(5, 9, "CDS", "B", "ACGTA"), (1, 3, "5UTR", "A", "ACG")], "first int, last int, region string, name string, sequence string")
    X.write_annotation(frames, f"{tmp_path}/annotation")
    assert {(r.orf, r.first, r.last, r.region, r.name, r.sequence) for r in X.read_annotation(spark, f"{tmp_path}/annotation").collect()} == {(0, 1, 3, "5UTR", "A", "ACG"), (1, 5, 9, "CDS", "B", "ACGTA")}
    codes = spark.createDataFrame([("s1", "v2", "1"), ("s1", "v1", "{0,1}"), ("s2", "v1", "1")], "sample string, variant string, code string")
    X.write_codes(codes, ["v1", "v2"], f"{tmp_path}/codes")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/codes").collect()) == ["s1\t{0,1}\t1", "s2\t1\t0"]


def test_nexus(spark, tmp_path):
    (tmp_path / "a.nex").write_text("#NEXUS\nBegin trees;\n\tTranslate\n\t\t1 x y_,\n\t\t2\tb\n\t\t;\n   tree con = [&U] ((1[&prob=0.9,n=1]:0.5,2:1):0.25,3:2);\n TREE * two=(1,2);\nend;\n")
    (tmp_path / "b.nex").write_text("#NEXUS\nbegin data; end;\n")
    rows = X.read_nexus(spark, str(tmp_path)).collect()
    assert {r.file.rsplit("/", 1)[1] for r in rows} == {"a.nex"}
    con = {r.child.rsplit("/", 1)[-1]: (r.parent.rsplit("/", 1)[-1], r.length) for r in rows if r.tree == "con"}
    assert con == {"x": ("a.nex#con:1", 0.5), "b": ("a.nex#con:1", 1.0), "a.nex#con:1": ("a.nex#con:2", 0.25), "3": ("a.nex#con:2", 2.0)}
    assert sorted((r.child, r.length) for r in rows if r.tree == "two") == [("b", None), ("x", None)]
    assert X.read_nexus(spark, str(tmp_path / "b.nex")).count() == 0


def test_many_small_files_go_to_few_tasks(spark, tmp_path):
    calls = spark.range(300).selectExpr("id as sample", "id + 1 as pos", "'A' as ref", "'C' as alt", "0.5 as vf", "3.0 as alt_count", "0.01 as pvalue", "30.0 as coverage")
    X.write_call_files(calls, str(tmp_path))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with X.small_files(spark):
        (rows, bad), (depths, _) = X.read_call_files(spark, f"{tmp_path}/calls", r"/sample=([^/]+)/[^/]*$"), X.read_depth_files(spark, f"{tmp_path}/depth", r"/sample=([^/]+)/[^/]*$")
        assert rows.rdd.getNumPartitions() <= 8 and rows.count() == depths.count() == 300 and bad.count() == 0
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before and X.BY_TASK[1] == "2"
