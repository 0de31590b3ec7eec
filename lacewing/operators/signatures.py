"""Mutational signatures: exposures by non-negative least squares, factorisation, bootstrap significance and clusters of samples.

Samples are rows with an array of category counts. What is solved in Python is one sample's system of a few signatures at a time; sums over
samples are Spark aggregates, and only matrices of signatures x categories come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacewing.functions.lineage import cut
from lacewing.operators.stats import benjamini_hochberg


def nnls(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises x' gram x / 2 - target' x, by growing and shrinking the set of positive entries."""
    k = len(target)
    x, positive = np.zeros(k), np.zeros(k, bool)
    for _ in range(10 * k + 10):
        slope = target - gram @ x
        free = np.where(positive, -np.inf, slope)
        enter = int(np.argmax(free))
        if free[enter] <= 1e-10 * max(1.0, np.abs(target).max()):
            break
        positive[enter] = True
        while True:
            trial = np.zeros(k)
            trial[positive] = np.linalg.lstsq(gram[np.ix_(positive, positive)], target[positive], rcond=None)[0]
            if not positive.any() or trial[positive].min() > 0:
                x = trial
                break
            below = positive & (trial <= 0)
            reach = min(x[i] / (x[i] - trial[i]) if x[i] > trial[i] else 0.0 for i in np.flatnonzero(below))
            x = x + reach * (trial - x)
            positive &= x > 1e-14
            x[~positive] = 0
    return x


def nnls_rows(gram: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """nnls for each row of targets: up to eight entries by trying every set of positive ones for all rows at once."""
    n, k = targets.shape
    if k > 8:
        return np.array([nnls(gram, t) for t in targets]).reshape(n, k)
    best, x = np.zeros(n), np.zeros((n, k))
    for size in range(1, k + 1):
        for chosen in map(list, combinations(range(k), size)):
            part = gram[np.ix_(chosen, chosen)]
            trial = targets[:, chosen] @ np.linalg.pinv(part, hermitian=True)
            value = ((trial @ part) * trial).sum(axis=1) / 2 - (trial * targets[:, chosen]).sum(axis=1)
            better = (trial > 0).all(axis=1) & (value < best - 1e-12 * np.abs(best))
            x[better] = 0
            x[np.ix_(better, chosen)] = trial[better]
            best[better] = value[better]
    return x


def included(xs: np.ndarray, beta: np.ndarray, enough: float = 0.95) -> np.ndarray:
    """Exposures of each row of counts to as few signatures as reach a cosine above enough; those of the other signatures are 0.

    The positive exposures of a full fit are sorted by falling size, and signatures are added in this order, each time fitting anew; if none reaches it,
    all of them are in.
    """
    gram, targets = beta @ beta.T, xs @ beta.T
    fit = _fits_within(gram, targets)
    full = fit(np.arange(len(xs)), np.full(len(xs), (1 << len(beta)) - 1))
    order, positive = np.argsort(-full, axis=1, kind="stable"), (full > 0).sum(axis=1)
    first = np.cumsum(1 << order, axis=1)  # the largest ones, as bits
    out, open_ = np.zeros_like(full), positive > 0
    for size in range(1, len(beta) + 1):
        rows = np.flatnonzero(open_ & (positive >= size))
        if not len(rows):
            break
        out[rows] = fit(rows, first[rows, size - 1])
        open_[rows] = ~(cosines(xs[rows], out[rows] @ beta) > enough)
    return out


def _fits_within(gram: np.ndarray, targets: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of rows and of sets of entries, as bits, that gives nnls_rows of each row's own set. Up to four entries all sets are tried once for all rows."""
    n, k = targets.shape
    if k > 4:

        def one_by_one(rows: np.ndarray, within: np.ndarray) -> np.ndarray:
            out = np.zeros((len(rows), k))
            for mask in np.unique(within).tolist():
                mine, chosen = np.flatnonzero(within == mask), [i for i in range(k) if mask >> i & 1]
                out[np.ix_(mine, chosen)] = nnls_rows(gram[np.ix_(chosen, chosen)], targets[np.ix_(rows[mine], chosen)])
            return out

        return one_by_one
    tried = []
    for size in range(1, k + 1):
        for chosen in map(list, combinations(range(k), size)):
            part, own = gram[np.ix_(chosen, chosen)], targets[:, chosen]
            trial = own @ np.linalg.pinv(part, hermitian=True)
            value = ((trial @ part) * trial).sum(axis=1) / 2 - (trial * own).sum(axis=1)
            tried.append((sum(1 << i for i in chosen), chosen, trial, np.where((trial > 0).all(axis=1), value, np.inf)))

    def of_all(rows: np.ndarray, within: np.ndarray) -> np.ndarray:
        best, x = np.zeros(len(rows)), np.zeros((len(rows), k))
        for mask, chosen, trial, value in tried:
            value = value[rows]
            better = np.flatnonzero((within & mask == mask) & (value < best - 1e-12 * np.abs(best)))
            x[better] = 0
            x[better[:, None], chosen] = trial[rows[better]]
            best[better] = value[better]
        return x

    return of_all


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a and b, NaN where one is zero."""
    norms = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.divide((a * b).sum(axis=1), norms, out=np.full(len(a), np.nan), where=norms > 0)


def exposures(samples: DataFrame, beta: np.ndarray) -> DataFrame:
    """(sample, x, alpha): exposures of each sample to the signatures, the rows of beta."""
    gram = beta @ beta.T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xs = np.stack(batch["x"].to_numpy()).astype(float) if len(batch) else np.empty((0, beta.shape[1]))
            yield batch.assign(alpha=list(nnls_rows(gram, xs @ beta.T)))

    return samples.select("sample", "x").mapInPandas(run, "sample long, x array<double>, alpha array<double>")


def normalised(beta: np.ndarray) -> np.ndarray:
    """Rows divided by their sums; rows of zeros stay."""
    sums = beta.sum(axis=1, keepdims=True)
    return np.divide(beta, sums, out=np.zeros_like(beta), where=sums > 0)


def seeded(k: int, categories: int, seed: int) -> np.ndarray:
    """Random signatures to start from."""
    return normalised(np.random.default_rng([seed, k]).random((k, categories)))


def _sums(fitted: DataFrame, k: int, categories: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over samples of the products alpha x alpha and alpha x x."""
    a, x = [F.col("alpha")[i] for i in range(k)], [F.col("x")[j] for j in range(categories)]
    products = [F.sum(a[i] * a[j]) for i in range(k) for j in range(k)] + [F.sum(a[i] * x[j]) for i in range(k) for j in range(categories)]
    row = np.array([v or 0.0 for v in fitted.agg(*products).first()])
    return row[: k * k].reshape(k, k), row[k * k :].reshape(k, categories)


def factorise(samples: DataFrame, k: int, categories: int, iterations: int = 20, seed: int = 12345, beta: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """Non-negative factorisation by alternating least squares: (exposures, signatures).

    Each round fits the samples to the signatures, and each category of the signatures to the sums over all samples. At the end signatures are
    normalised and samples fitted once more. beta: signatures to start from, as for a new cohort, which are then re-estimated.
    """
    beta = seeded(k, categories, seed) if beta is None else normalised(beta)
    for _ in range(iterations):
        gram, target = _sums(exposures(samples, beta), k, categories)
        beta = np.column_stack([nnls(gram, target[:, j]) for j in range(categories)])
    beta = normalised(beta)
    return exposures(samples, beta), beta


def quality(fitted: DataFrame, beta: np.ndarray) -> DataFrame:
    """(n, rss, explained, median_cosine) of a factorisation."""
    k, categories = beta.shape
    fit = F.array(*[sum((F.col("alpha")[i] * float(beta[i, j]) for i in range(k)), F.lit(0.0)) for j in range(categories)])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    rows = fitted.withColumn("fit", fit)
    rows = rows.withColumns({"xx": dot(F.col("x"), F.col("x")), "xf": dot(F.col("x"), F.col("fit")), "ff": dot(F.col("fit"), F.col("fit"))})
    residual = F.col("xx") - 2 * F.col("xf") + F.col("ff")
    cosine = F.try_divide(F.col("xf"), F.sqrt(F.col("xx") * F.col("ff")))
    return rows.agg(F.count("*").alias("n"), F.sum(residual).alias("rss"), (1 - F.sum(residual) / F.sum("xx")).alias("explained"), F.median(cosine).alias("median_cosine"))


#: Replicates that are fitted at once.
REPLICATES_TOGETHER = 1 << 13


def _fractions(batch: pd.DataFrame, beta: np.ndarray, replicates: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(sample, replicates x signatures): exposures of each sample's resampled counts as shares, by a seed of the sample's own."""
    step = max(1, REPLICATES_TOGETHER // replicates)
    for begin in range(0, len(batch), step):
        some = batch.iloc[begin : begin + step]
        drawn = np.zeros((len(some), replicates, beta.shape[1]))
        for own, sample, x in zip(drawn, some["sample"], some["x"], strict=True):
            x = np.asarray(x, float)
            if (total := x.sum()) > 0:
                own[:] = np.random.default_rng([seed, sample]).multinomial(round(100 * total), x / total, size=replicates) / 100
        alpha = included(drawn.reshape(-1, beta.shape[1]), beta)
        sums = alpha.sum(axis=1, keepdims=True)
        share = np.divide(alpha, sums, out=np.zeros_like(alpha), where=sums > 0)
        yield from zip(some["sample"], share.reshape(len(some), replicates, -1), strict=True)


def bootstrap(samples: DataFrame, beta: np.ndarray, replicates: int, seed: int = 12345) -> DataFrame:
    """(sample, replicate, signature, fraction): exposures of resampled counts as shares, of as few signatures as fit (see included).

    A sample's replicates are drawn together, with a seed of its own, so samples are spread over tasks and survive their loss.
    A replicate draws round(100 x total) categories by their shares and is divided by 100; a sample without counts has fractions of 0.
    """
    k = len(beta)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sample, share in _fractions(batch, beta, replicates, seed):
                keys = {"sample": sample, "replicate": np.repeat(np.arange(1, replicates + 1), k)}
                yield pd.DataFrame(keys | {"signature": np.tile(np.arange(k), replicates), "fraction": share.ravel()})

    return samples.select("sample", "x").mapInPandas(run, "sample long, replicate int, signature int, fraction double")


def signed_ranks(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of the positive ones' ranks, number, correction for ties) of each column of differences by their size, to twelve digits, those of 0 left out."""
    size = np.where(d == 0, np.inf, np.round(np.abs(d), 12))
    order = np.argsort(size, axis=0, kind="stable")
    size, positive = np.take_along_axis(size, order, axis=0), np.take_along_axis(d > 0, order, axis=0)
    new = np.ones(size.shape, bool)
    new[1:] = size[1:] != size[:-1]
    at = np.arange(len(d))[:, None]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=0)
    ends = np.ones(size.shape, bool)
    ends[:-1] = new[1:]
    last = np.minimum.accumulate(np.where(ends, at, len(d))[::-1], axis=0)[::-1]
    some, ties = np.isfinite(size), (last - first + 1).astype(float)
    return ((first + last) / 2 + 1).sum(axis=0, where=positive & some), some.sum(axis=0), ((ties * ties - 1) / 48).sum(axis=0, where=some)


def tested(samples: DataFrame, beta: np.ndarray, replicates: int, mu: float = 0.05, seed: int = 12345) -> DataFrame:
    """significance() of bootstrap(): each sample's replicates are drawn and tested in one place, so they are never shuffled or sorted by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sample, share in _fractions(batch, beta, replicates, seed):
                for i, (mean, v, n, tied) in enumerate(zip(share.mean(axis=0), *signed_ranks(share - mu), strict=True)):
                    spread = math.sqrt(max(0.0, n * (n + 1) * (2 * n + 1) / 24 - tied))
                    p = 0.5 * math.erfc((v - n * (n + 1) / 4 - 0.5) / spread / math.sqrt(2)) if mean > 0 and spread > 0 else None
                    rows.append((sample, i, float(mean), p))
            yield pd.DataFrame(rows, columns=["sample", "signature", "mean", "p"]).astype({"p": object})

    return samples.select("sample", "x").mapInPandas(run, "sample long, signature int, mean double, p double")


@F.pandas_udf(T.DoubleType())
def _upper_tail(z: pd.Series) -> pd.Series:
    """Chance of a standard normal value above z."""
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2)))


def significance(replicates: DataFrame, mu: float = 0.05) -> DataFrame:
    """(sample, signature, mean, p): one-sided signed-rank test that fractions are above mu, by the normal approximation with corrections for
    ties and continuity; null where all are 0."""
    key = ["sample", "signature"]
    off = replicates.withColumn("d", F.col("fraction") - mu)
    ranked = off.where("d <> 0").withColumn("a", F.round(F.abs("d"), 12))
    ties = F.count("*").over(Window.partitionBy(*key, "a"))
    ranked = ranked.withColumns({"ties": ties, "rank": F.rank().over(Window.partitionBy(*key).orderBy("a")) + (ties - 1) / 2})
    n = F.count("*")
    tied = F.sum((F.col("ties") * F.col("ties") - 1) / 48.0)  # each tie of t counts t times (t^2 - 1) / 48
    tests = ranked.groupBy(*key).agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0)).alias("v"), n.alias("n"), tied.alias("tied"))
    spread = F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("tied"))
    z = F.try_divide(F.col("v") - F.col("n") * (F.col("n") + 1) / 4.0 - 0.5, spread)
    means = replicates.groupBy(*key).agg(F.avg("fraction").alias("mean"))
    joined = means.join(tests.select(*key, z.alias("z")), key, "left")
    return joined.select(*key, "mean", F.when(F.col("mean") > 0, _upper_tail("z")).alias("p"))


def shares(tests: DataFrame, limit: float = 0.05) -> DataFrame:
    """(signature, n_with, n_significant, share_with, share_significant, smallest_q) over all samples: those with a mean fraction above 0 and those with p < limit,
    shares to two digits; q is adjusted over the samples of a signature."""
    rows = benjamini_hochberg(tests, "p", "signature")
    n = F.count("*")
    there, clear = F.count_if(F.col("mean") > 0), F.count_if(F.col("p") < limit)
    return rows.groupBy("signature").agg(there.alias("n_with"), clear.alias("n_significant"), F.round(there / n, 2).alias("share_with"), F.round(clear / n, 2).alias("share_significant"), F.min("q").alias("smallest_q"))


def refitted(samples: DataFrame, tests: DataFrame, beta: np.ndarray, limit: float = 0.05) -> DataFrame:
    """(sample, signature, exposure, goodness): samples fitted to the signatures with p < limit alone, and the cosine of sample and fit.

    Signatures without significance have exposure 0; goodness is null for samples without any. tests: as of significance.
    """
    kept = tests.groupBy("sample").agg(F.collect_list(F.when(F.col("p") < limit, F.col("signature"))).alias("kept"))
    gram = beta @ beta.T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sample, x, chosen in zip(batch["sample"], batch["x"], batch["kept"], strict=True):
                x, alpha, chosen = np.asarray(x, float), np.zeros(len(beta)), np.sort(np.asarray(chosen, int))
                if len(chosen):
                    alpha[chosen] = nnls(gram[np.ix_(chosen, chosen)], beta[chosen] @ x)
                cosine = cosines(x[None], (alpha @ beta)[None])[0]
                out += [(sample, i, v, None if math.isnan(cosine) else cosine) for i, v in enumerate(alpha)]
            yield pd.DataFrame(out, columns=["sample", "signature", "exposure", "goodness"])

    return samples.select("sample", "x").join(kept, "sample").mapInPandas(run, "sample long, signature int, exposure double, goodness double")


def _near(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance to it) of each point for each set of centres (sets x k x dimensions)."""
    far = (points**2).sum(axis=1)[None, :, None] - 2 * points @ centres.transpose(0, 2, 1) + (centres**2).sum(axis=2)[:, None, :]
    own = far.argmin(axis=2)
    return own, np.maximum(0, np.take_along_axis(far, own[:, :, None], axis=2)[:, :, 0])


def centres_of(points: DataFrame, k: int, starts: int = 1000, rounds: int = 100, seed: int = 12345) -> tuple[np.ndarray, float] | None:
    """(centres, cost) of the best k-means of many random starts over points (features: array<double>); none without points.

    Starts begin with distinct ones of a few thousand points that are chosen by the hash of the features. All of them go through the points together: each
    round is one aggregate of a sum for every start, centre and dimension, until no start's cost falls. A centre without points stays.
    """
    pool = points.select("features").distinct().orderBy(F.xxhash64(F.lit(seed), "features"), "features").limit(3 * starts).collect()
    if not pool:
        return None
    pool = np.array([r.features for r in pool], float)
    draw = np.random.default_rng(seed)
    centres = np.stack([pool[draw.permutation(len(pool))[np.arange(k) % len(pool)]] for _ in range(starts)])
    cost, dims = np.full(starts, np.inf), pool.shape[1]
    for _ in range(rounds):

        def sums(batches: Iterator[pd.DataFrame], centres: np.ndarray = centres) -> Iterator[pd.DataFrame]:
            total = np.zeros((starts, k * (dims + 1) + 1))
            for batch in batches:
                every = np.stack(batch["features"].to_numpy()).astype(float) if len(batch) else np.empty((0, dims))
                for begin in range(0, len(every), 500):
                    some = every[begin : begin + 500]
                    own, far = _near(some, centres)
                    one = (own[:, :, None] == np.arange(k)).astype(float).transpose(0, 2, 1)
                    total += np.concatenate([(one @ some).reshape(starts, -1), one.sum(axis=2), far.sum(axis=1, keepdims=True)], axis=1)
            yield pd.DataFrame({"i": np.arange(total.size), "value": total.ravel()})

        found = points.select("features").mapInPandas(sums, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).toPandas()
        total = found.sort_values("i")["value"].to_numpy().reshape(starts, -1)
        before, cost = cost, total[:, -1]
        if (cost >= before - 1e-12 * np.abs(cost)).all():
            break
        n = total[:, k * dims : -1][:, :, None]
        centres = np.where(n > 0, total[:, : k * dims].reshape(starts, k, dims) / np.maximum(n, 1), centres)
    best = int(np.argmin(cost))
    return centres[best], float(cost[best])


def clusters(fitted: DataFrame, k: int = 3, starts: int = 1000) -> DataFrame:
    """(sample, cluster, label): k-means of exposure shares, the best of many starts; clusters are numbered, and labelled SC#1 and on, by the centre's main
    signature, then its share. A sample is in the first of equally near clusters; one without exposures has shares of 0."""
    total = F.aggregate("alpha", F.lit(0.0), lambda s, v: s + v)
    shares = cut(fitted.select("sample", F.transform("alpha", lambda v: F.when(total > 0, v / total).otherwise(0.0)).alias("features")))
    found = centres_of(shares, k, starts)
    if found is None:
        return shares.select("sample", F.lit(0).alias("cluster"), F.lit("").alias("label")).limit(0)
    centres = np.array(sorted(found[0].tolist(), key=lambda c: (int(np.argmax(c)), -max(c))))

    @F.pandas_udf("int")
    def nearest(rows: pd.Series) -> pd.Series:
        return pd.Series(_near(np.stack(rows.to_numpy()).astype(float), centres[None])[0][0])

    return shares.select("sample", nearest("features").alias("cluster")).withColumn("label", F.concat(F.lit("SC#"), (F.col("cluster") + 1).cast("string")))
