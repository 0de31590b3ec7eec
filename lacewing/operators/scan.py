"""Factorisations of several ranks from many random starts, with the measures by which a rank is chosen.

All starts go through the samples together: each round is one aggregate over Spark's rows, of which a task sends one row for each rank, start
and entry of the small matrices (their number doesn't depend on the samples), and the driver gets the sums. Signatures are kept by rank, as an array
of starts x signatures x categories; ranks are small, as every set of signatures is tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacewing.functions.lineage import cut, stored
from lacewing.operators.consensus import agreement, silhouette_of_rows, silhouette_of_samples
from lacewing.operators.signatures import cosines, normalised, seeded

#: Samples that are fitted at once.
TOGETHER = 1000


def _listed(grams: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises x' gram x / 2 - target' x for each row of targets of each start: every set of positive entries is tried for all at once."""
    starts, n, k = targets.shape
    least, x = np.zeros((starts, n)), np.zeros((starts, n, k))
    for size in range(1, k + 1):
        for chosen in map(list, combinations(range(k), size)):
            part, mine = grams[:, chosen][:, :, chosen], targets[:, :, chosen]
            trial = mine @ np.linalg.pinv(part, hermitian=True)
            value = ((trial @ part) * trial).sum(axis=2) / 2 - (trial * mine).sum(axis=2)
            better = (trial > 0).all(axis=2) & (value < least - 1e-12 * np.abs(least))
            found = np.zeros((int(better.sum()), k))
            found[:, chosen] = trial[better]
            x[better], least[better] = found, value[better]
    return x


#: Turns in which sets of positive entries are looked for before all of them are tried, and ranks up to which they are tried at once.
TURNS, FEW = 12, 3


def fits(grams: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The same as _listed: sets of positive entries are found by turning over those that are wrong, all of a row's as long as that leaves fewer wrong ones, else the last one.

    A set without wrong ones is the solution. Rows that don't get there, and starts whose signatures are nearly dependent, have every set tried.
    """
    starts, n, k = targets.shape
    spectrum = np.linalg.eigvalsh(grams)
    clear = spectrum[:, 0] > 1e-9 * spectrum[:, -1]
    if k <= FEW or not n or not clear.all():
        x = _listed(grams[~clear], targets[~clear]) if k > FEW and n and clear.any() else None
        if x is None:
            return _listed(grams, targets)
        out = np.empty(targets.shape)
        out[~clear], out[clear] = x, fits(grams[clear], targets[clear])
        return out
    bits = 1 << np.arange(k)
    inverses = np.zeros((starts, 1 << k, k, k))
    for mask in range(1, 1 << k):
        chosen = np.flatnonzero(mask & bits)
        inverses[:, mask, chosen[:, None], chosen] = np.linalg.inv(grams[:, chosen][:, :, chosen])
    x = targets @ inverses[:, -1]
    x = x.reshape(-1, k)
    rows = np.flatnonzero((x <= 0).any(axis=1))
    masks, t = ((x[rows] > 0) * bits).sum(axis=1), targets.reshape(-1, k)[rows]
    start, exact = rows // n, 1e-12 * np.abs(t).max(axis=1, keepdims=True)
    least, patience = np.full(len(rows), k + 1), np.full(len(rows), 3)
    for _ in range(TURNS):
        if not len(rows):
            break
        trial = np.matmul(inverses[start, masks], t[:, :, None])[:, :, 0]
        slope = t - np.matmul(grams[start], trial[:, :, None])[:, :, 0]
        wrong = np.where((masks[:, None] & bits) != 0, trial <= 0, slope > exact)
        number = wrong.sum(axis=1)
        x[rows[number == 0]] = trial[number == 0]
        rows, masks, t, start, exact, least, patience, wrong, number = (v[number > 0] for v in (rows, masks, t, start, exact, least, patience, wrong, number))
        fewer = number < least
        last = bits[k - 1 - np.argmax(wrong[:, ::-1], axis=1)] if len(rows) else masks
        masks = masks ^ np.where(fewer | (patience > 0), (wrong * bits).sum(axis=1), last)
        least, patience = np.where(fewer, number, least), np.where(fewer, 3, np.maximum(0, patience - 1))
    for s in np.unique(start):
        x[rows[start == s]] = _listed(grams[s][None], t[start == s][None])[0]
    return x.reshape(targets.shape)


def distinct(samples: DataFrame) -> DataFrame:
    """(x, n): different counts with their number of samples, so that samples with equal counts are fitted once, dealt over all tasks."""
    return cut(samples.groupBy("x").agg(F.count("*").alias("n")).repartition(2 * samples.sparkSession.sparkContext.defaultParallelism))


def _fitted(batch: pd.DataFrame, betas: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rank, counts, exposures by start, samples with these counts), TOGETHER at a time; without a column n there is a sample a row."""
    for begin in range(0, len(batch), TOGETHER):
        some = batch.iloc[begin : begin + TOGETHER]
        xs, n = np.stack(some["x"].to_numpy()).astype(float), some["n"].to_numpy(float) if "n" in some else np.ones(len(some))
        for k, beta in betas.items():
            yield k, xs, fits(beta @ beta.transpose(0, 2, 1), xs @ beta.transpose(0, 2, 1)), n


def _summed(samples: DataFrame, betas: dict[int, np.ndarray], measure) -> dict[int, np.ndarray]:
    """For each rank, the sum over samples (distinct) of what measure(counts, exposures, signatures, samples) gives as an array of starts x numbers."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, xs, alpha, n in _fitted(batch, betas):
                sums[k] = sums.get(k, 0.0) + measure(xs, alpha, betas[k], n)
        for k, value in sums.items():
            yield pd.DataFrame({"k": k, "i": np.arange(value.size), "value": value.ravel()})

    found = samples.select("x", "n").mapInPandas(rows, "k int, i int, value double").groupBy("k", "i").agg(F.sum("value").alias("value")).toPandas()
    return {int(k): g.sort_values("i")["value"].to_numpy().reshape(len(betas[k]), -1) for k, g in found.groupby("k")}


def _products(xs: np.ndarray, alpha: np.ndarray, beta: np.ndarray, n: np.ndarray) -> np.ndarray:
    across = alpha.transpose(0, 2, 1) * n
    return np.concatenate([(across @ alpha).reshape(len(alpha), -1), (across @ xs).reshape(len(alpha), -1)], axis=1)


def _residuals(xs: np.ndarray, alpha: np.ndarray, beta: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n, residual and total sum of squares, then for each signature the sum of its exposures and of their squares."""
    rest = ((xs - alpha @ beta) ** 2).sum(axis=2) @ n
    same = np.ones(len(alpha))
    return np.column_stack([n.sum() * same, rest, (xs**2).sum(axis=1) @ n * same, n @ alpha, n @ alpha**2])


def restarts(samples: DataFrame, ranks: list[int], starts: int, categories: int, iterations: int = 20, seed: int = 12345) -> dict[int, np.ndarray]:
    """Signatures by rank after so many rounds of alternating least squares; samples: sample, x, or as of distinct(), read once a round. No samples, no
    signatures."""
    betas = {k: np.stack([seeded(k, categories, seed + start) for start in range(starts)]) for k in ranks}
    samples = samples if "n" in samples.columns else distinct(samples)
    for _ in range(iterations):
        sums = _summed(samples, betas, _products)
        if not sums:
            return {}
        betas = {k: fits(v[:, : k * k].reshape(-1, k, k), v[:, k * k :].reshape(-1, k, categories).transpose(0, 2, 1)).transpose(0, 2, 1) for k, v in sums.items()}
    return {k: np.stack([normalised(one) for one in beta]) for k, beta in betas.items()}


def _sparseness(size: int, total: np.ndarray, squares: np.ndarray) -> float | None:
    """Mean over vectors of (sqrt(n) - sum / norm) / (sqrt(n) - 1), vectors of zeros left out; null for a size of 1."""
    some = squares > 0
    if size < 2 or not some.any():
        return None
    return float(np.mean((np.sqrt(size) - total[some] / np.sqrt(squares[some])) / (np.sqrt(size) - 1)))


def best(samples: DataFrame, betas: dict[int, np.ndarray]) -> dict[int, tuple[int, np.ndarray]]:
    """By rank, the start of least residual (the first of equal ones) and its sums."""
    samples = samples if "n" in samples.columns else distinct(samples)
    return {k: (int(np.argmin(v[:, 1])), v[np.argmin(v[:, 1])]) for k, v in sorted(_summed(samples, betas, _residuals).items())}


def label_classes(samples: DataFrame, betas: dict[int, np.ndarray]) -> DataFrame:
    """(k, labels, n): how many samples have each vector of labels, a byte a start: the signature of a sample's largest exposure."""

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, _, alpha, n in _fitted(batch, betas):
                own = np.ascontiguousarray(alpha.argmax(axis=2).T.astype(np.uint8))
                yield pd.DataFrame({"k": k, "labels": [x.tobytes() for x in own], "n": n.astype(int)})

    samples = samples if "n" in samples.columns else distinct(samples)
    return samples.select("x", "n").mapInPandas(labels, "k int, labels binary, n long").groupBy("k", "labels").agg(F.sum("n").alias("n"))


def measures(samples: DataFrame, betas: dict[int, np.ndarray]) -> DataFrame:
    """(k, starts, best_start, n, rss, explained, sparseness_signatures, sparseness_exposures, silhouette_signatures, silhouette_exposures, classes, dispersion,
    cophenetic, silhouette_consensus) of each rank.

    rss to silhouette_exposures are those of the start with the least residual, by whose largest exposures samples are clustered (and categories by their
    largest weight), at the distance 1 - correlation; explained is 1 - rss / sum of squares, null for counts of zero. The others tell how the starts agree.
    """
    spark, starts, rows, once = samples.sparkSession, max(map(len, betas.values()), default=0), [], distinct(samples)
    for k, (start, value) in best(once, betas).items():
        beta, n, total = betas[k][start], int(value[0]), value[2]
        explained = float(1 - value[1] / total) if total > 0 else None

        def exposures(batch: pd.DataFrame, k: int = k, beta: np.ndarray = beta) -> Iterator[np.ndarray]:
            for _, _, alpha, _ in _fitted(batch, {k: beta[None]}):
                yield alpha[0]

        sparse = _sparseness(beta.shape[1], beta.sum(axis=1), (beta**2).sum(axis=1)), _sparseness(n, value[3 : 3 + k], value[3 + k :])
        rows.append((k, starts, start, n, float(value[1]), explained, *sparse, silhouette_of_rows(beta.T), silhouette_of_samples(samples.select("x"), exposures, k)))
    kinds = "k int, starts int, best_start int, n long, rss double, explained double, sparseness_signatures double, sparseness_exposures double, silhouette_signatures double, silhouette_exposures double"
    return spark.createDataFrame(rows, kinds).join(agreement(label_classes(once, betas)), "k", "left")


def held_out(samples: DataFrame, ranks: list[int], categories: int, folds: int = 5, iterations: int = 20, seed: int = 12345) -> DataFrame:
    """(k, n, rss, mean_cosine) of samples fitted to signatures that were found without them; a sample's fold is the hash of its key.

    The cosine is that of sample and fit, over samples with both.
    """
    fold = F.pmod(F.xxhash64(F.lit(seed), "sample"), F.lit(folds))
    parts = []
    for f in range(folds):
        betas = restarts(samples.where(fold != f), ranks, 1, categories, iterations, seed + f)

        def rows(batches: Iterator[pd.DataFrame], betas=betas) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k, xs, alpha, _ in _fitted(batch, betas):
                    rest, cosine = xs - alpha[0] @ betas[k][0], cosines(xs, alpha[0] @ betas[k][0])
                    yield pd.DataFrame({"k": k, "rss": (rest**2).sum(axis=1), "cosine": pd.Series(cosine).astype(object).where(~np.isnan(cosine), None)})

        parts.append(samples.where(fold == f).select("x").mapInPandas(rows, "k int, rss double, cosine double"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("k").agg(F.count("*").alias("n"), F.sum("rss").alias("rss"), F.avg("cosine").alias("mean_cosine"))


#: Share of the cells above 0 that a repetition hides, refits of the hidden ones, and rounds of each refit.
HIDDEN, REFITS, ROUNDS = 0.01, 5, 4


def hidden_cells(samples: DataFrame, betas: dict[int, np.ndarray], repetitions: int = 1000, share: float = HIDDEN, refits: int = REFITS, rounds: int = ROUNDS, seed: int = 12345) -> DataFrame:
    """(k, repetitions, mean_error, median_error): how well cells that were hidden are told by factorisations without them.

    Each repetition hides a share of the cells above 0, chosen by a hash of repetition, sample and category; they are first taken for 0, then for what the
    last fit says of them, and signatures are refitted each time, beginning with those given (one set a rank). Its error is the mean square of what
    its cells lack at the end; repetitions without a hidden cell have none.

    All repetitions and ranks go through the samples together: a round is one aggregate, as in restarts(), and a sample's row keeps its hidden cells and
    what is taken for them. samples: sample (a long), x.
    """
    ranks = sorted(betas)
    categories = next(iter(betas.values())).shape[-1] if betas else 0
    now = {k: np.repeat(betas[k].reshape(1, k, categories), repetitions, axis=0) for k in ranks}

    def hide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = []
            for sample, x in zip(batch["sample"], batch["x"], strict=True):
                drawn = np.random.default_rng([seed, int(sample) & (2**63 - 1)]).random((repetitions, categories)) < share
                cells.append(np.flatnonzero(drawn & (np.asarray(x) > 0)).astype(np.int32))
            yield batch.assign(cells=cells, taken=[np.zeros(len(ranks) * len(c)) for c in cells])

    kinds = "sample long, x array<double>, cells array<int>, taken array<double>"
    rows = stored(samples.select("sample", "x").mapInPandas(hide, kinds))

    def filled(part: pd.DataFrame, i: int) -> np.ndarray:
        """repetitions x samples x categories with the hidden cells as they are taken for a rank now."""
        xs = np.repeat(np.stack(part["x"].to_numpy()).astype(float)[None], repetitions, axis=0)
        for s, (cells, taken) in enumerate(zip(part["cells"], part["taken"], strict=True)):
            cells = np.asarray(cells)
            xs[cells // categories, s, cells % categories] = np.asarray(taken)[i * len(cells) : (i + 1) * len(cells)]
        return xs

    def pieces(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        step = max(1, TOGETHER * 100 // repetitions)
        for begin in range(0, len(batch), step):
            yield batch.iloc[begin : begin + step]

    for _ in range(refits):
        for _ in range(rounds):

            def sums(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
                total: dict[int, np.ndarray] = {}
                for batch in batches:
                    for part in pieces(batch):
                        for i, k in enumerate(ranks):
                            xs = filled(part, i)
                            alpha = fits(now[k] @ now[k].transpose(0, 2, 1), xs @ now[k].transpose(0, 2, 1))
                            across = alpha.transpose(0, 2, 1)
                            value = np.concatenate([(across @ alpha).reshape(repetitions, -1), (across @ xs).reshape(repetitions, -1)], axis=1)
                            total[k] = total.get(k, 0.0) + value
                for k, value in total.items():
                    yield pd.DataFrame({"k": k, "i": np.arange(value.size), "value": value.ravel()})

            found = rows.mapInPandas(sums, "k int, i int, value double").groupBy("k", "i").agg(F.sum("value").alias("value")).toPandas()
            for k, g in found.groupby("k"):
                v = g.sort_values("i")["value"].to_numpy().reshape(repetitions, -1)
                now = now | {int(k): fits(v[:, : k * k].reshape(-1, k, k), v[:, k * k :].reshape(-1, k, categories).transpose(0, 2, 1)).transpose(0, 2, 1)}

        def retake(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in pieces(batch):
                    told = []
                    for i, k in enumerate(ranks):
                        alpha = fits(now[k] @ now[k].transpose(0, 2, 1), filled(part, i) @ now[k].transpose(0, 2, 1))
                        told.append(alpha @ now[k])
                    taken = [np.concatenate([t[np.asarray(c) // categories, s, np.asarray(c) % categories] for t in told]) for s, c in enumerate(part["cells"])]
                    yield part.assign(taken=taken)

        rows = stored(rows.mapInPandas(retake, kinds))

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            square, n = np.zeros((len(ranks), repetitions)), np.zeros(repetitions)
            for x, cells, taken in zip(batch["x"], batch["cells"], batch["taken"], strict=True):
                cells = np.asarray(cells, int)
                off = (np.asarray(taken, float).reshape(len(ranks), -1) - np.asarray(x, float)[cells % categories]) ** 2
                np.add.at(n, cells // categories, 1)
                for i in range(len(ranks)):
                    np.add.at(square[i], cells // categories, off[i])
            seen = np.flatnonzero(n)
            for i, k in enumerate(ranks):
                yield pd.DataFrame({"k": k, "repetition": seen, "square": square[i][seen], "n": n[seen]})

    every = rows.mapInPandas(errors, "k int, repetition int, square double, n double").groupBy("k", "repetition").agg((F.sum("square") / F.sum("n")).alias("error"))
    return every.groupBy("k").agg(F.count("*").alias("repetitions"), F.avg("error").alias("mean_error"), F.median("error").alias("median_error"))
