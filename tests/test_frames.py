"""One reading frame, intervals by bucket, orders, phylogenies from genotypes and exact chances, against results by hand, by brute force and by enumeration."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import functions as F

from lacewing.functions.order import numbered
from lacewing.operators import coding as K
from lacewing.operators import intervals as I
from lacewing.operators import landscape as L
from lacewing.operators import phylogeny as P
from lacewing.operators import reports as R
from lacewing.operators import selection as Z
from lacewing.operators import stats as S
from lacewing.operators import windows as W
from lacewing.sources import text as X

FRAMES = "orf int, first int, last int, region string, name string"


def effects(spark, sequence, frames, variants, slip=None):
    genome = spark.createDataFrame([(i, b) for i, b in enumerate(sequence, 1)], "pos int, base string")
    coding = K.coding_positions(spark.createDataFrame(frames, FRAMES), genome, slip)
    rows = spark.createDataFrame([(p, r, a) for p, r, a in variants], "pos int, ref string, alt string")
    return {r.pos: r for r in K.effects(rows, coding).collect()}


def test_the_slip_changes_effects(spark):
    """ATGGTTTAA from position 1: TTT read straight on is F, but behind a slip on position 4 the codons are ATG, GGT, TTA, A.."""
    variants = [(6, "T", "C"), (7, "T", "C")]
    straight = effects(spark, "ATGGTTTAA", [(1, 1, 9, "CDS", "A")], variants)
    slipped = effects(spark, "ATGGTTTAA", [(1, 1, 9, "CDS", "A")], variants, ("A", 4))
    assert (straight[6].effect, straight[6].codon_position, straight[6].amino, straight[6].amino_mutated) == ("S", 3, "V", "V")  # GTT and GTC
    assert (slipped[6].effect, slipped[6].codon_position, slipped[6].changes) == ("S", 1, [])  # TTA and CTA
    assert (slipped[7].effect, slipped[7].codon_position, slipped[7].changes, straight[7].changes) == ("NS", 2, ["A.3L>S"], ["A.3*>Q"])
    assert (straight[7].codon_position, slipped[7].codon_position) == (1, 2)


def test_a_variant_on_the_slip_alters_two_codons(spark):
    """ATG TTT TTA: the 6th position ends one codon and begins the next."""
    got = effects(spark, "ATGTTTTA", [(1, 1, 8, "CDS", "A")], [(6, "T", "G"), (5, "A", "C"), (8, "A", "T")], ("A", 6))
    assert (got[6].codon_position, got[6].amino, got[6].amino_mutated, got[6].effect, got[6].changes) == (None, "FL", "LV", "NS", ["A.2F>L", "A.3L>V"])
    assert got[5].ref_mismatch and not got[6].ref_mismatch and got[5].changes == ["A.2F>S"]
    assert (got[8].codon_position, got[8].changes) == (3, ["A.3L>F"])


def test_the_last_gene_wins_and_ends_without_codons_have_no_effect(spark):
    frames = [(1, 1, 7, "CDS", "A"), (2, 5, 10, "CDS", "B"), (3, 11, 12, "3UTR", "U")]
    got = effects(spark, "ATGGTTTAAGGG", frames, [(7, "T", "C"), (4, "G", "A"), (12, "G", "A"), (2, "T", "C")])
    assert got[7].orf == "B" and got[7].codon_position == 3 and 12 not in got and got[4].changes == ["A.2V>I"]
    whole = K.with_noncoding(spark.createDataFrame([(7,), (12,)], "pos int"), spark.createDataFrame([(7, "S")], "pos int, effect string"))
    assert {r.pos: r.effect for r in whole.collect()} == {7: "S", 12: "NC"}
    assert K.effects(spark.createDataFrame([], "pos int, ref string, alt string"), K.coding_positions(spark.createDataFrame(frames, FRAMES), spark.createDataFrame([(1, "A")], "pos int, base string"))).count() == 0


def test_intervals_equal_brute_force(spark):
    draw = random.Random(5)
    frames = [(i, a := draw.randrange(-50, 400), a + draw.choice([-2, 0, 3, 40, 250])) for i in range(40)]
    points = [draw.randrange(-80, 500) for _ in range(300)] + [None, 7, 7]
    rows = spark.createDataFrame([(p, "mine") for p in points], "pos int, bucket string")
    got = I.covered(rows, spark.createDataFrame([*frames, (99, None, 5)], "k int, first int, last int"), ["k"], width=64)
    assert got.columns == ["pos", "bucket", "frames"]
    found = sorted(((r.pos, [x.k for x in r.frames or []]) for r in got.collect()), key=str)
    assert found == sorted(((p, [k for k, a, b in frames if p is not None and a <= p <= b]) for p in points), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert L.annotated(spark.createDataFrame([], "pos int"), spark.createDataFrame([(1, 1, 9, "CDS", "A")], FRAMES)).count() == 0


def test_places_in_an_order(spark):
    draw = random.Random(1)
    rows = [(draw.choice("aab"), draw.choice([None, *range(30)])) for _ in range(500)]
    frame = spark.createDataFrame(rows, "g string, x int").repartition(7)
    got = numbered(frame, ["g"], ["x"], "at", "n").collect()
    for g in "ab":
        own = sorted((r.at, -1 if r.x is None else r.x) for r in got if r.g == g)
        assert [a for a, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own) and {r.n for r in got if r.g == g} == {len(own)}
    assert sorted(r.at for r in numbered(frame.select("x"), [], ["x"], "at").collect()) == list(range(500))


def test_memo_order_equals_spelled_out_scores(spark):
    draw = random.Random(2)
    cells = {(s, p) for s in range(40) for p in range(1, 9) if draw.random() < 0.4}
    states = spark.createDataFrame([(s, p, 1) for s, p in cells] + [(3, 99, 1)], "sample int, pos int, state int")
    top = spark.createDataFrame([(p, 10, 9 - p) for p in range(1, 9)], "pos int, carriers long, rank int")
    columns, rows = P.memo_order(states, top)
    samples = sorted({s for s, _ in cells}, key=lambda s: (-sum(2 ** (8 - (9 - p)) for q, p in cells if q == s), s))
    assert [r.sample for r in columns.orderBy("place").collect()] == samples
    score = lambda p: sum(2 ** (len(samples) - 1 - i) for i, s in enumerate(samples) if (s, p) in cells)
    assert [r.pos for r in rows.orderBy("place").collect()] == sorted({p for _, p in cells}, key=lambda p: (score(p), 9 - p))


def test_adjacency_is_the_tree_that_the_closure_came_from(spark):
    top = spark.createDataFrame([(10 * r, 100 - r, r) for r in range(1, 7)], "pos int, carriers long, rank int")
    edges = [(10, 20), (10, 30), (20, 40), (40, 50), (30, 60)]
    tree = spark.createDataFrame([(a, b, b // 10) for a, b in edges], "parent int, child int, rank int")
    genotypes = P.clone_genotypes(tree, P.ancestors(tree, 3), top)
    assert sorted(map(tuple, P.adjacency(genotypes, top).collect())) == sorted(edges)


def test_genotype_tree_with_two_roots_and_hidden_leaves(spark):
    sets = {"a": {1}, "b": {1, 2}, "c": {1, 2, 3}, "d": {7}, "e": {7, 8}, "f": {7, 8}, "g": {1, 7, 9}}
    genotypes = spark.createDataFrame([(g, p) for g, s in sets.items() for p in s], "genotype string, pos int")
    attached = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "f")], "sample int, genotype string")
    got = {tuple(r) for r in P.genotype_tree(genotypes, attached).collect()}
    assert got == {
        ("Root", "a", 1, "clone"), ("a", "b", 1, "clone"), ("b", "c", 1, "clone"), ("Root", "d", 1, "clone"), ("d", "e", 1, "clone"), ("e", "f", 0, "clone"), ("a", "g", 2, "clone"),
        ("a", "1", 0, "sample"), ("c", "2", 0, "sample"), ("Root", "3", 0, "sample"), ("f", "4", 0, "sample"), ("g", "hidden_g", 0, "hidden"), ("Root", "Reference", 0, "reference"),
    }


def test_containment_equals_all_pairs(spark):
    draw = random.Random(8)
    sets = {f"g{i}": frozenset(draw.sample(range(12), draw.choice([1, 2, 3, 5, 8]))) for i in range(60)}
    got = {r.genotype: r.parent for r in P.contained(spark.createDataFrame([(g, p) for g, s in sets.items() for p in s], "genotype string, pos int")).collect()}
    below = lambda g: [h for h in sets if h != g and sets[h] <= sets[g] and (sets[h] != sets[g] or h < g)]
    assert got == {g: min(below(g), key=lambda h: (-len(sets[h]), h), default=None) for g in sets}


def test_outgroup_and_labels(spark):
    edges = spark.createDataFrame([("r", "x", 1), ("x", "t1", 0), ("x", "t2", 0), ("r", "y", 2), ("y", "t3", 0)], "parent string, child string, length long")
    tips = spark.createDataFrame([("t1", "G1"), ("t2", "G2"), ("t3", None)], "tip string, label string")
    assert {tuple(r) for r in R.labelled_nodes(edges, tips, F.lit("r")).collect()} == {("r", "Reference"), ("x", "G1"), ("y", None)}
    assert ("r", "Outgroup", 0) in {tuple(r) for r in R.with_outgroup(edges, F.lit("r")).collect()}


def test_corrected_likelihood_prefers_another_clone(spark):
    top = spark.createDataFrame([(10, 5, 1), (20, 3, 2)], "pos int, carriers long, rank int")
    genotypes = spark.createDataFrame([(1, 10), (2, 20)], "clone int, pos int")
    states = spark.createDataFrame([(1, 10, 1)], "sample int, pos int, state int")
    samples = spark.createDataFrame([(1,)], "sample int")
    one = lambda crossed: P.attachments(states, samples, genotypes, top, 2, 0.3, 0.1, crossed).first()
    assert math.isclose(one(True).log_likelihood, round(math.log(1 - 0.3) + math.log(1 - 0.1), 6))
    assert one(True).log_likelihood == one(False).log_likelihood and one(False).clone == 1
    none = spark.createDataFrame([(1, 10, None)], "sample int, pos int, state int")
    at = lambda crossed: P.attachments(none, samples, genotypes, top, 2, 0.3, 0.1, crossed).first()
    assert math.isclose(at(True).log_likelihood, round(math.log(0.9), 6)) and math.isclose(at(False).log_likelihood, round(math.log(0.7), 6))


def test_exact_chances_equal_enumeration(spark):
    for n in (3, 4, 5, 6):
        sums = [sum((a - b) ** 2 for a, b in enumerate(p)) for p in itertools.permutations(range(n))]
        for q in set(sums):
            low, high = sum(x <= q for x in sums), sum(x >= q for x in sums)
            expected = min(1.0, 2 * (high if q > (n**3 - n) / 6 else low) / len(sums))
            assert math.isclose(S.squares_tail(q, n), expected)
    for n, m in ((2, 3), (3, 3), (4, 2), (4, 5)):
        distances = []
        for chosen in itertools.combinations(range(n + m), n):
            i = j = 0
            d = 0.0
            for k in range(n + m):
                i, j = i + (k in chosen), j + (k not in chosen)
                d = max(d, abs(i / n - j / m))
            distances.append(d)
        for d in set(distances):
            assert math.isclose(S.distance_tail(d, n, m), sum(x >= d - 1e-9 for x in distances) / len(distances), abs_tol=1e-12)
    pairs = [(1, float(x), float(y)) for x, y in zip(range(5), (0, 1, 2, 4, 3), strict=True)] + [(2, float(i), float(i * i % 11)) for i in range(10)] + [(3, 1.0, 2.0), (3, 1.0, 3.0), (3, 4.0, 4.0)]
    got = {r.g: r for r in S.spearman_p(S.spearman(spark.createDataFrame(pairs, "g int, x double, y double"), "g", "x", "y")).collect()}
    assert math.isclose(got[1].p, S.squares_tail(2, 5)) and "squares" not in got[1].asDict() and 0 < got[3].p < 1
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("c", 1.0)], "g string, v double")
    p = {(r.a, r.b): r.p for r in S.kolmogorov_p(S.kolmogorov_smirnov(rows, "g", "v"), rows.groupBy("g").agg(F.count("*").alias("n")), "g").collect()}
    assert math.isclose(p["a", "b"], 0.2) and math.isclose(p["b", "c"], 2 / 3)


def test_densities(spark):
    values = [0.1, 0.1, 0.2, 0.5, 0.9]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 0.4), ("c", 0.3), ("c", 0.3), ("a", None)], "g string, v double")
    got = S.densities(rows, "g", "v", 0.0, 1.0, 11).collect()
    assert {r.g for r in got} == {"a"} and len(got) == 11
    mean = sum(values) / 5
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / 4)
    h = 0.9 * min(sd, 0.4 / 1.34) * 5**-0.2
    for r in got:
        assert math.isclose(r.density, sum(math.exp(-(((r["at"] - v) / h) ** 2) / 2) for v in values) / (5 * h * math.sqrt(2 * math.pi)), rel_tol=1e-9)


def test_product_and_renaming(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (1, "y", 3.0), (2, "y", 1.0)], "i int, k string, a double")
    b = spark.createDataFrame([("x", "u", 5.0), ("y", "u", 7.0), ("y", "v", 1.0)], "k string, j string, b double")
    assert {(r.i, r.j): r.ab for r in R.product(a, b, "k", "a", "b", "ab").collect()} == {(1, "u"): 31.0, (1, "v"): 3.0, (2, "u"): 7.0, (2, "v"): 1.0}
    names = spark.createDataFrame([("y", "S#1", 1)], "old string, name string, place int")
    assert [(r.i, r.k, r.place) for r in R.renamed(a, "k", names).orderBy("i").collect()] == [(1, "S#1", 1), (2, "S#1", 1)]


def test_call_and_depth_files(spark, tmp_path):
    header = "\t".join(("Chrom", "Position", "Ref", "Cons", "Reads1", "Reads2", "VarFreq", "Strands1", "Strands2", "Qual1", "Qual2", "Pvalue", "MapQual1", "MapQual2", "Reads1Plus", "Reads1Minus", "Reads2Plus", "Reads2Minus", "VarAllele"))
    line = lambda pos, ref, alt, n, vf, p: "\t".join(["NC", str(pos), ref, "N", "5", str(n), vf, "1", "1", "30", "30", str(p), "1", "1", "2", "3", "4", "5", alt])
    (tmp_path / "calls").mkdir()
    (tmp_path / "depth").mkdir()
    (tmp_path / "calls" / "SRR1_aln.sorted.vcf").write_text("\n".join([header, line(7, "A", "g", 12, "12.5%", "1E-3"), line(7, "A", "G", 10, "13%", 0.5), line(9, "C", "T", 4, "0.25", 0.01), "broken\tline", line("x", "A", "C", 1, "1%", 0), line(3, "N", "C", 1, "1%", 0), line(4, "A", "C", 1, "140%", 0), ""]))
    (tmp_path / "calls" / "SRR2.vcf").write_text(header + "\n" + line(7, "A", "T", 3, "100%", 0.0) + "\n")
    (tmp_path / "depth" / "SRR1_aln.sorted.txt").write_text("NC\t7\t100\nNC\t8\t5\nNC\tseven\t3\nNC\t9\n")
    (tmp_path / "depth" / "SRR2.txt").write_text("NC\t7\t20\nNC\t7\t21\n")
    (calls, bad), (depths, bad_depths) = X.read_call_files(spark, str(tmp_path / "calls")), X.read_depth_files(spark, str(tmp_path / "depth"))
    got = {(r.sample, r.variant): (r.vf, r.alt_count, r.pvalue, r.coverage) for r in X.bridged(calls, depths).collect()}
    assert got == {("SRR1", "7_A_G"): (0.13, 12.0, 0.001, 100.0), ("SRR1", "9_C_T"): (0.25, 4.0, 0.01, None), ("SRR2", "7_A_T"): (1.0, 3.0, 0.0, 21.0)}
    assert bad.count() == 4 and {r.file.rsplit("/", 1)[1] for r in bad.collect()} == {"SRR1_aln.sorted.vcf"} and sorted(r.line for r in bad_depths.collect()) == ["NC\t9", "NC\tseven\t3"]
    X.write_call_files(X.bridged(calls, depths), str(tmp_path / "again"))
    (calls, bad), (depths, _) = (read(spark, str(tmp_path / "again" / what), r"/sample=([^/]+)/[^/]*$") for read, what in ((X.read_call_files, "calls"), (X.read_depth_files, "depth")))
    assert {(r.sample, r.variant): (r.vf, r.alt_count, r.pvalue, r.coverage) for r in X.bridged(calls, depths).collect()} == got and bad.count() == 0


def test_positions_of_frames_are_not_broadcast(spark):
    """Spark takes what is laid out from a few intervals for a few rows."""
    genome = spark.range(1, 200_001).selectExpr("id as pos", "'A' as base")
    coding = K.coding_positions(spark.createDataFrame([(0, 1, 200_000, "CDS", "A")], FRAMES), genome)
    assert coding.count() == 200_000 and "Broadcast" not in coding._jdf.queryExecution().executedPlan().toString()


def test_windows_equal_brute_force_and_are_not_listed_by_row(spark, monkeypatch):
    monkeypatch.setattr(W, "STRETCH", 40)
    draw = random.Random(3)
    for width, step in ((30, 3), (10, 4), (7, 7)):
        length, starts = 200, range(1, 200 - width + 2, step)
        rows = [(c, draw.randint(0, length), draw.choice(["NS", "S"])) for c in ("a", "b", None) for _ in range(12)]
        df = spark.createDataFrame(rows, "cluster string, pos long, effect string")
        got = {(r.cluster, r.start): (r.n_ns, r.n_s) for r in W.sliding_counts(df, F.lit(length), width, step).collect()}
        held = {(c, s): {(p, e) for k, p, e in rows if k == c and s <= p < s + width} for c in ("a", "b", None) for s in starts}
        assert got == {k: tuple(sum(e == x for _, e in v) for x in ("NS", "S")) for k, v in held.items() if v}
        windows = [("a", s, draw.choice([None, draw.random()])) for s in starts if draw.random() < 0.3]
        means = {r.pos: r["mean"] for r in W.smoothed(spark.createDataFrame(windows, "cluster string, start long, ratio double"), "ratio", width, step).collect()}
        of = {p: [v for _, s, v in windows if s <= p < s + width] for p in range(1, length + 1)}
        expected = {p: [v for v in vs if v is not None] for p, vs in of.items() if vs}
        assert means.keys() == expected.keys() and all(means[p] is None if not v else math.isclose(means[p], sum(v) / len(v)) for p, v in expected.items())
        places = [(p, i) for p in range(1, 60) for i in sorted(draw.sample(range(1, length), draw.randint(1, 4)))]
        seen = [("a", p, draw.choice(["NS", "S"]), draw.choice(["mixed", "always minor"])) for p in draw.sample(range(1, 60), 30)]
        coding = spark.createDataFrame(places, "pos long, idx long")
        got = {r.start: (r.n_ns, r.n_s, r.n_mixed) for r in Z.observed_windows(spark.createDataFrame(seen, "cluster string, pos long, effect string, type string"), coding, F.lit(length), width, step).collect()}
        held = {s: {x for x in seen if any(p == x[1] and s <= i < s + width for p, i in places)} for s in starts}
        assert got == {s: (sum(x[2] == "NS" for x in v), sum(x[2] == "S" for x in v), sum(x[3] == "mixed" for x in v)) for s, v in held.items() if v}
    plan = W.sliding_counts(df, F.lit(10**6))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 2  # rows go to stretches and are summed up there
