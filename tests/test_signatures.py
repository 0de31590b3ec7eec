"""Kernels by their own invariants."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.operators import consensus as C
from lacewing.operators import scan as N
from lacewing.operators import signatures as G
from lacewing.operators import stats as S
from lacewing.operators import windows as W


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.normal(size=(6, 3)), rng.normal(size=6)
        gram, target = a.T @ a, a.T @ b
        x = G.nnls(gram, target)
        slope = target - gram @ x
        assert (x >= 0).all() and (slope <= 1e-7).all() and abs(x @ slope) < 1e-7
    assert (G.nnls(np.eye(3), -np.ones(3)) == 0).all()


def test_factorisation_finds_planted_signatures(spark):
    rng = np.random.default_rng(2)
    planted = G.normalised(np.array([[9, 1, 0, 0, 0, 0.0], [0, 0, 8, 2, 0, 0], [0, 0, 0, 0, 5, 5]]))
    rows = [(i, [float(v) for v in alpha @ planted]) for i, alpha in enumerate(rng.gamma(0.5, 10, size=(60, 3)))]
    samples = spark.createDataFrame(rows, "sample long, x array<double>")
    fitted, beta = G.factorise(samples, 3, 6, iterations=15)
    assert beta.sum(axis=1) == pytest.approx(1)
    r = G.quality(fitted, beta).first()
    assert r.n == 60 and r.explained > 0.99 and r.median_cosine > 0.99
    assert {r.label for r in G.clusters(fitted, 3, 2).collect()} == {"SC#1", "SC#2", "SC#3"}
    replicates = G.bootstrap(samples.limit(3).unionByName(spark.createDataFrame([(99, [0.0] * 6)], samples.schema)), planted, 60)
    got = G.significance(replicates).collect()
    assert len(got) == 12
    for r in got:
        assert (r.p is None) == (r.mean == 0)
        if r.mean > 0.2:
            assert r.p < 0.01


def test_signatures_are_included_until_they_fit():
    rng = np.random.default_rng(3)
    for k in (1, 3, 4):
        beta = G.normalised(rng.gamma(0.4, 1, size=(k, 6)))
        gram, xs = beta @ beta.T, rng.gamma(0.5, 10, size=(150, 6))
        assert G.nnls_rows(gram, xs @ beta.T) == pytest.approx(np.array([G.nnls(gram, beta @ x) for x in xs]), abs=1e-6)
        for x, got in zip(xs, G.included(xs, beta), strict=True):
            full, expected = G.nnls(gram, beta @ x), np.zeros(k)
            chosen = [i for i in np.argsort(-full) if full[i] > 0]
            for size in range(1, len(chosen) + 1):
                now = chosen[:size]
                expected[now] = G.nnls(gram[np.ix_(now, now)], beta[now] @ x)
                fit = expected @ beta
                if fit @ x / np.sqrt((fit @ fit) * (x @ x)) > 0.95:
                    break
            assert got == pytest.approx(expected, abs=1e-6)


def test_weak_signatures_are_left_out(spark):
    beta = np.array([[1, 0, 0.0], [0, 1, 0], [0, 0, 1]])
    samples = spark.createDataFrame([(1, [90.0, 4.0, 0.0]), (2, [50.0, 50.0, 1.0]), (3, [0.0, 0.0, 0.0])], "sample long, x array<double>")
    tests = G.significance(G.bootstrap(samples, beta, 40))
    assert {(r.sample, r.signature) for r in tests.collect() if r["mean"] > 0} == {(1, 0), (2, 0), (2, 1)}
    got = {(r.sample, r.signature): (r.exposure, r.goodness) for r in G.refitted(samples, tests, beta).collect()}
    assert got[1, 0] == (90, pytest.approx(90 / np.hypot(90, 4))) and got[1, 1][0] == got[1, 2][0] == 0
    assert [got[2, i][0] for i in range(3)] == [50, 50, 0] and got[3, 0] == (0, None)


def test_windows(spark):
    rows = spark.createDataFrame([("a", 1, "NS"), ("a", 1, "NS"), ("a", 6, "S"), ("a", 7, "NS")], "cluster string, pos int, effect string")
    got = {r.start: (r.n_ns, r.n_s, r.ratio) for r in W.sliding_counts(rows, F.lit(9), 6, 3).collect()}
    assert got == {1: (1, 1, 1.0), 4: (1, 1, 1.0)}
    means = {r.pos: r["mean"] for r in W.smoothed(spark.createDataFrame([("a", 1, 2.0), ("a", 4, None)], "cluster string, start long, ratio double"), "ratio", 6).collect()}
    assert means == {1: 2.0, 2: 2.0, 3: 2.0, 4: 2.0, 5: 2.0, 6: 2.0, 7: None, 8: None, 9: None}


def test_rank_scan_keeps_the_best_start_and_measures_agreement(spark):
    rng = np.random.default_rng(4)
    planted = G.normalised(np.array([[9, 1, 0, 0, 0, 0.0], [0, 0, 8, 2, 0, 0]]))
    rows = [(i, [float(v) for v in alpha @ planted]) for i, alpha in enumerate(rng.gamma(0.5, 10, size=(40, 2)))]
    samples = spark.createDataFrame(rows, "sample long, x array<double>").repartition(3)
    betas = N.restarts(samples, [1, 2, 3], 4, 6, iterations=10)
    assert {k: b.shape for k, b in betas.items()} == {k: (4, k, 6) for k in (1, 2, 3)}
    xs = np.array([x for _, x in rows])
    fits = {(k, s): G.nnls_rows(beta @ beta.T, xs @ beta.T) for k in betas for s, beta in enumerate(betas[k])}
    got = {r.k: r for r in N.measures(samples, betas).collect()}
    for k in (1, 2, 3):
        residuals = [((xs - fits[k, s] @ betas[k][s]) ** 2).sum() for s in range(4)]
        assert got[k].n == 40 and got[k].rss == pytest.approx(min(residuals), abs=1e-6)
        together = np.mean([np.equal.outer(g, g) for g in (fits[k, s].argmax(axis=1) for s in range(4))], axis=0)
        assert got[k].dispersion == pytest.approx((4 * (together - 0.5) ** 2).mean())
    assert got[1].dispersion == 1 and got[2].explained > 0.99 > got[1].explained
    beta, alpha = betas[2][got[2].best_start], fits[2, got[2].best_start]
    hoyer = lambda v: (np.sqrt(len(v)) - v.sum() / np.sqrt((v * v).sum())) / (np.sqrt(len(v)) - 1)
    assert got[2].sparseness_signatures == pytest.approx(np.mean([hoyer(v) for v in beta]))
    assert got[2].sparseness_exposures == pytest.approx(np.mean([hoyer(v) for v in alpha.T]))
    held = {r.k: r for r in N.held_out(samples, [1, 2], 6, folds=2, iterations=10).collect()}
    assert held[1].n == held[2].n == 40 and held[2].rss < held[1].rss and held[2].mean_cosine > 0.99
    assert N.restarts(samples.limit(0), [1, 2], 2, 6) == {}


def test_tails_of_the_limit_laws(spark):
    assert S._t_tails(0.0, 5) == 1 and S._t_tails(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    assert S._t_tails(2.228138852, 10) == pytest.approx(0.05, abs=1e-9) and S._t_tails(0.1, 10_000) == pytest.approx(0.920346, abs=1e-6)
    assert S._landau_tail(-5) == 1 and S._landau_tail(-3.9) == pytest.approx(1, abs=1e-5) and S._landau_tail(1e6) == pytest.approx(1e-6, rel=1e-3)
    values = [S._landau_tail(x / 4) for x in range(-15, 400)]
    assert all(a > b for a, b in zip(values, values[1:], strict=False)) and S._landau_tail(1.35578) == pytest.approx(0.5, abs=1e-4)
    rows = spark.createDataFrame([(4, 1.0), (3, None), (2, 0.5), (6, -0.5)], "n long, rho double")
    assert [r.p for r in S.spearman_p(rows).collect()] == [0, None, None, pytest.approx(0.312500, abs=1e-6)]


def silhouettes_of_all_pairs(distance, cluster):
    out = []
    for i, c in enumerate(cluster):
        mean = {g: np.mean([distance[i, j] for j in range(len(cluster)) if j != i and cluster[j] == g] or [np.nan]) for g in set(cluster)}
        a, b = mean[c], min((v for g, v in mean.items() if g != c), default=np.nan)
        out.append(0.0 if np.isnan(a) or max(a, b) <= 0 else (b - a) / max(a, b))
    return np.mean(out)


def average_linkage_of_samples(distance):
    """Cophenetic distances, one sample a leaf, by the definition: means over all pairs of two clusters."""
    groups, joined = [[i] for i in range(len(distance))], np.zeros(distance.shape)
    while len(groups) > 1:
        pairs = [(distance[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        height, i, j = min(pairs)
        joined[np.ix_(groups[i], groups[j])] = joined[np.ix_(groups[j], groups[i])] = height
        groups[i] += groups.pop(j)
    return joined


def test_consensus_measures_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    shared = rng.integers(0, 3, size=997)  # many starts, as equal distances may be joined in any order
    labels = np.stack([np.where(rng.random(997) < i / 13, rng.integers(0, 3, size=997), shared) for i in range(12)]).astype(np.uint8)
    sizes = np.array([1, 2, 3, 1, 1, 4, 1, 2, 1, 1, 1, 2])
    rows = spark.createDataFrame([(3, bytearray(x.tobytes()), int(n)) for x, n in zip(labels, sizes, strict=True)], "k int, labels binary, n long")
    got = C.agreement(rows).first()
    every = np.repeat(labels, sizes, axis=0)
    distance = 1 - C.shares_together(every)
    upper = np.triu_indices(len(every), 1)
    joined = average_linkage_of_samples(distance)
    assert got.classes == 12 and got.dispersion == pytest.approx((4 * (0.5 - distance) ** 2).mean())
    assert got.cophenetic == pytest.approx(np.corrcoef(distance[upper], joined[upper])[0, 1])
    _, cluster = C.average_linkage(1 - C.shares_together(labels), sizes, 3)
    assert len(set(cluster)) == 3 and got.silhouette_consensus == pytest.approx(silhouettes_of_all_pairs(distance, np.repeat(cluster, sizes).tolist()))
    same = C.agreement(spark.createDataFrame([(1, bytearray(3), 9)], "k int, labels binary, n long")).first()
    assert (same.classes, same.dispersion, same.cophenetic, same.silhouette_consensus) == (1, 1.0, 1.0, None)
    many = spark.range(C.MOST_CLASSES + 1).selectExpr("2 as k", "cast(cast(id as string) as binary) as labels", "1L as n")
    assert tuple(C.agreement(many).first()) == (2, C.MOST_CLASSES + 1, None, None, None)


def test_silhouettes_by_sums_equal_all_pairs(spark):
    alpha = np.random.default_rng(7).gamma(0.5, 3, size=(50, 3))
    units = C.directions(alpha)
    distance = 1 - units @ units.T
    np.fill_diagonal(distance, 0)
    expected = silhouettes_of_all_pairs(distance, alpha.argmax(axis=1).tolist())
    assert C.silhouette_of_rows(alpha) == pytest.approx(expected)
    samples = spark.createDataFrame([([float(v) for v in x],) for x in alpha], "x array<double>").repartition(3)
    assert C.silhouette_of_samples(samples, lambda batch: iter([np.stack(batch["x"].to_numpy())]), 3) == pytest.approx(expected)
    assert C.silhouette_of_rows(np.ones((4, 1))) is None


def test_hidden_cells_tell_the_planted_rank(spark):
    rng = np.random.default_rng(9)
    planted = G.normalised(np.array([[9, 1, 0, 0, 0, 0.0], [0, 0, 8, 2, 0, 0]]))
    rows = [(i, [float(v) for v in np.round(alpha @ planted + rng.gamma(1, 0.3, size=6), 3)]) for i, alpha in enumerate(rng.gamma(1.0, 20, size=(60, 2)))]
    samples = spark.createDataFrame(rows, "sample long, x array<double>").repartition(3)
    betas = {k: b[0] for k, b in N.restarts(samples, [1, 2, 4], 1, 6, iterations=15).items()}
    got = {r.k: r for r in N.hidden_cells(samples, betas, repetitions=60, share=0.02).collect()}
    assert sorted(got) == [1, 2, 4] and len({r.repetitions for r in got.values()}) == 1 and got[1].repetitions > 50
    assert got[2].median_error < got[1].median_error and got[2].median_error < got[4].median_error
    assert N.hidden_cells(samples.limit(0), betas, repetitions=5).count() == 0


def test_kmeans_costs_no_more_than_the_best_of_five(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(11)
    points = np.concatenate([rng.normal(c, 0.1, size=(40, 3)) for c in ((0, 0, 1), (0, 1, 0), (1, 0, 0))])
    frame = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(points)], "sample long, features array<double>").repartition(3)
    vectors = frame.select(array_to_vector("features").alias("features"))
    least = min(KMeans(k=3, seed=s).fit(vectors).summary.trainingCost for s in range(5))
    centres, cost = G.centres_of(frame, 3, 100)
    assert cost <= least + 1e-6 and sorted(np.round(centres).tolist()) == [[0, 0, 1], [0, 1, 0], [1, 0, 0]]
    got = G.clusters(frame.select("sample", F.transform("features", lambda v: F.greatest(v, F.lit(0.0))).alias("alpha")), 3, 50).collect()
    assert [{r.label for r in got if r.sample // 40 == g} for g in range(3)] == [{"SC#3"}, {"SC#2"}, {"SC#1"}]
    assert G.centres_of(frame.limit(0), 3, 5) is None
    assert len(G.centres_of(frame.limit(1), 3, 5)[0]) == 3


def test_fits_by_turns_equal_every_set():
    rng = np.random.default_rng(8)
    for k in (4, 5, 6):
        betas = rng.random((20, k, 6)) * (rng.random((20, k, 6)) < 0.7)
        betas[3, 1] = betas[3, 0]  # dependent
        xs = rng.poisson(rng.gamma(1, 10, size=(50, 6))).astype(float)
        grams, targets = betas @ betas.transpose(0, 2, 1), xs @ betas.transpose(0, 2, 1)
        value = lambda x: ((x @ grams) * x).sum(axis=2) / 2 - (x * targets).sum(axis=2)  # noqa: E731, B023
        x, every = N.fits(grams, targets), N._listed(grams, targets)
        assert (x >= 0).all() and np.allclose(value(x), value(every), rtol=1e-9, atol=1e-7)


def test_replicates_are_tested_where_they_are_drawn(spark):
    rng = np.random.default_rng(6)
    beta = np.array([[5, 1, 0.5, 0], [0, 2, 3, 1], [1, 0, 0, 4.0]])
    rows = [(i, [float(v) for v in rng.poisson(20 * rng.random(3) @ beta)]) for i in range(12)] + [(99, [0.0] * 4), (100, [3.0, 0.0, 0.0, 0.0])]
    samples = spark.createDataFrame(rows, "sample long, x array<double>")
    fused = G.tested(samples, beta, 60)
    plan = fused._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Window", "Join", "Aggregate", "Explode"))
    expected = {(r.sample, r.signature): (r.mean, r.p) for r in G.significance(G.bootstrap(samples, beta, 60)).collect()}
    got = {(r.sample, r.signature): (r.mean, r.p) for r in fused.collect()}
    assert got.keys() == expected.keys() and len(got) == 42
    for key, (mean, p) in expected.items():
        assert got[key][0] == pytest.approx(mean) and (got[key][1] is None) == (p is None) and (p is None or got[key][1] == pytest.approx(p))


def test_samples_with_equal_counts_are_fitted_once(spark):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate([(9, 1, 0), (0, 4, 4), (2, 2, 7)] * 5)]
    samples = spark.createDataFrame(rows, "sample long, x array<double>")
    once = N.distinct(samples)
    assert {(tuple(r.x), r.n) for r in once.collect()} == {((9.0, 1.0, 0.0), 5), ((0.0, 4.0, 4.0), 5), ((2.0, 2.0, 7.0), 5)}
    betas = N.restarts(samples, [2], 3, 3, 5)
    each = samples.withColumn("n", F.lit(1))
    assert np.allclose(betas[2], N.restarts(each, [2], 3, 3, 5)[2])
    assert np.allclose(N.best(once, betas)[2][1], N.best(each, betas)[2][1]) and N.best(once, betas)[2][1][0] == 15
    assert sum(r.n for r in N.label_classes(once, betas).collect()) == 15
