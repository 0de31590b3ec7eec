"""Statistics over groups, written as aggregates and windows."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regression(rows: DataFrame, group: str, y: str, x: str) -> DataFrame:
    """(group, n, slope, r2, adjusted_r2) of simple linear regressions; null where they aren't defined."""
    fit = rows.groupBy(group).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    adjusted = 1 - F.try_divide((1 - F.col("r2")) * (F.col("n") - 1), (F.col("n") - 2).cast("double"))
    return fit.where("n > 2").withColumn("adjusted_r2", adjusted)


def _centred(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Average ranks within the group, doubled, less their mean n + 1: whole numbers, so that sums of them don't depend on an order."""
    order = Window.partitionBy(group).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(group, value))
    return rows.withColumn(f"rank_{value}", 2 * F.rank().over(order) + ties - 2 - F.count("*").over(Window.partitionBy(group)))


def spearman(rows: DataFrame, group: str, x: str, y: str, least: int = 3) -> DataFrame:
    """(group, n, rho, squares) over pairs without nulls, for groups with at least `least` pairs; squares: the sum of squared differences of ranks where
    neither x nor y has ties, else null.

    Ranks are summed as longs (n^3 / 3 at most) and divided once.
    """
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, x, y)
    ranked = _centred(_centred(rows, group, x), group, y)
    a, b = F.col(f"rank_{x}"), F.col(f"rank_{y}")
    sums = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb")).where(F.col("n") >= least)
    untied = F.expr("aa = (n * n * n - n) div 3 and bb = aa")
    rho = F.try_divide(F.col("ab").cast("double"), F.sqrt(F.col("aa").cast("double") * F.col("bb").cast("double")))
    return sums.select(group, "n", rho.alias("rho"), F.when(untied, F.expr("(aa + bb - 2 * ab) div 4")).alias("squares"))


def benjamini_hochberg(rows: DataFrame, p: str, family: str) -> DataFrame:
    """Add q: p-values adjusted within a family, of which nulls are no members."""
    n = F.count(p).over(Window.partitionBy(family))
    rank = F.rank().over(Window.partitionBy(family).orderBy(F.col(p).asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(family, p))
    scaled = F.col(p) * F.col("_n") / (F.col("_rank") + F.col("_ties") - 1)
    down = Window.partitionBy(family).orderBy(F.col(p).desc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n": n, "_rank": rank, "_ties": ties}).withColumn("_scaled", scaled)
    q = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_scaled").over(down)))
    return rows.withColumn("q", q).drop("_n", "_rank", "_ties", "_scaled")


def kolmogorov_smirnov(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, d, tied): largest distance of the distributions of every two groups, a < b, and whether any value is there twice in them.

    Values are counted first; a group's counts go to the pairs that it is in (one row a pair, joined by the group), whose cumulative shares are then compared.
    """
    counts = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("size"))
    names = sizes.agg(F.sort_array(F.collect_list(group)).alias("names"))  # a few groups
    pairs = sizes.select(group).crossJoin(F.broadcast(names)).select(group, F.explode(F.filter("names", lambda x: x != F.col(group))).alias("other"))
    pairs = pairs.select(group, F.least(group, "other").alias("a"), F.greatest(group, "other").alias("b"))
    shares = counts.join(sizes, group).withColumn("share", F.col("n") / F.col("size"))
    both = pairs.join(shares, group)
    signed = F.when(F.col(group) == F.col("a"), F.col("share")).otherwise(-F.col("share"))
    steps = both.groupBy("a", "b", value).agg(F.sum(signed).alias("step"), F.sum("n").alias("n"))
    upto = Window.partitionBy("a", "b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("gap", F.abs(F.sum("step").over(upto))).groupBy("a", "b").agg(F.max("gap").alias("d"), (F.max("n") > 1).alias("tied"))


def _t_tails(t: float, n: int) -> float:
    """Both tails of Student's distribution with n degrees of freedom beyond t: the incomplete beta function's continued fraction."""
    a, b, x = n / 2, 0.5, n / (n + t * t)
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):  # converges faster the other way round
        a, b, x, turned = b, a, 1 - x, True
    else:
        turned = False
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a if x > 0 else 0.0
    value, c, d = 1.0, 1.0, 0.0
    for i in range(1, 10_000):
        m = i // 2
        term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        c, d = (1 + term / c) or 1e-300, 1 / ((1 + term * d) or 1e-300)
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    tail = min(1.0, front / value)
    return 1 - tail if turned else tail


#: Pairs up to which the chance of a Spearman correlation without ties is exact.
EXACT_PAIRS = 9
#: Product of two samples' sizes below which the chance of their distance is exact, if no value is there twice.
EXACT_PRODUCT = 10_000


@lru_cache
def squares_distribution(n: int) -> np.ndarray:
    """How many of the orders of n things have each sum of squared differences of places, from 0; counted over sets of places taken."""
    top = n * (n * n - 1) // 3
    ways = {0: np.eye(1, top + 1, dtype=np.int64)[0]}
    for i in range(n):
        grown: dict[int, np.ndarray] = {}
        for taken, counts in ways.items():
            for j in range(n):
                if not taken >> j & 1:
                    step = (i - j) ** 2
                    to = grown.setdefault(taken | 1 << j, np.zeros(top + 1, np.int64))
                    to[step:] += counts[: top + 1 - step]
        ways = grown
    return ways[(1 << n) - 1]


def squares_tail(squares: int, n: int) -> float:
    """Chance of a correlation as far from 0 as that of this sum of squares, or farther: twice the smaller tail, 1 at most."""
    ways = squares_distribution(n)
    high = squares > (n**3 - n) / 6
    return min(1.0, 2 * float(ways[squares:].sum() if high else ways[: squares + 1].sum()) / math.factorial(n))


def distance_tail(d: float, n: int, m: int) -> float:
    """Chance that samples of n and m different values of one distribution are at a distance of d or more: lattice paths that reach it, by rows of the lattice."""
    near = lambda i: np.abs(i / n - np.arange(m + 1) / m) < d - 1e-9
    share = np.zeros(m + 1)  # share of the paths to (i, j) that stayed near
    for i in range(n + 1):
        inside = near(i)
        for j in range(m + 1):
            if not inside[j]:
                share[j] = 0.0
            elif i == 0 and j == 0:
                share[0] = 1.0
            else:
                share[j] = (share[j] * i if i else 0.0) / (i + j) + (share[j - 1] * j / (i + j) if j else 0.0)
    return 1 - float(share[m])


def spearman_p(correlations: DataFrame) -> DataFrame:
    """Add p to (.., n, rho, squares), in place of squares (where there are any): two-sided; exact up to EXACT_PAIRS pairs without ties, else by t = rho sqrt((n - 2) / (1 - rho^2)) with
    n - 2 degrees of freedom; 0 for a rho of 1 or -1 then; null where there is no rho or n < 3."""

    @F.pandas_udf("double")
    def tails(rho: pd.Series, n: pd.Series, squares: pd.Series) -> pd.Series:
        def one(r: float | None, k: int, q: float | None) -> float | None:
            if r is None or math.isnan(r) or k < 3:
                return None
            if k <= EXACT_PAIRS and q is not None and not math.isnan(q):
                return squares_tail(int(q), int(k))
            return 0.0 if abs(r) >= 1 - 1e-12 else _t_tails(r * math.sqrt((k - 2) / (1 - r * r)), int(k) - 2)

        return pd.Series([one(*x) for x in zip(rho, n, squares, strict=True)], dtype=object)

    squares = F.col("squares") if "squares" in correlations.columns else F.lit(None).cast("long")
    return correlations.withColumn("p", tails("rho", "n", squares)).drop("squares")


def kolmogorov_p(distances: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """(a, b, d, p): the chance of a distance of d or more between samples of these sizes (group, n) of one distribution: exact where the product of sizes is
    below EXACT_PRODUCT and no value is tied, else by Kolmogorov's limit law."""
    of = lambda side: sizes.select(F.col(group).alias(side), F.col("n").alias(f"n_{side}"))
    both = distances.join(of("a"), "a").join(of("b"), "b")
    reach = F.col("d") * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * reach * reach))
    # below 0.2 the law's chance is 1 to 12 digits
    limit = F.when(reach < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms)))

    @F.pandas_udf("double")
    def exact(d: pd.Series, n: pd.Series, m: pd.Series, small: pd.Series) -> pd.Series:
        return pd.Series([distance_tail(*x) if s else None for *x, s in zip(d, n, m, small, strict=True)], dtype=object)

    small = ~F.col("tied") & (F.col("n_a") * F.col("n_b") < EXACT_PRODUCT)
    return both.select("a", "b", "d", F.coalesce(exact("d", "n_a", "n_b", small), limit).alias("p"))


def adjusted_harmonic_p(rows: DataFrame, group: str, p: str, total: int | None = None) -> DataFrame:
    """(group, n, hmp, p_adjusted): the harmonic mean p and its chance by Landau's law, to which the mean of 1 / p tends.

    total: the number of tests that the limit is to hold for, each of weight 1 / total; a group's own number where it isn't given. p-values of 0 and
    null are left out, as in harmonic_mean_p.
    """

    @F.pandas_udf("double")
    def tail(at: pd.Series) -> pd.Series:
        return pd.Series([_landau_tail(x) for x in at], dtype=float)

    weight = F.lit(1.0) if total is None else F.col("n") / F.lit(float(total))
    tests = F.col("n") if total is None else F.lit(total)
    at = (weight / F.col("hmp") - F.log(tests) - (1 + DIGAMMA_1 - math.log(2 / math.pi))) + math.log(math.pi / 2)
    return harmonic_mean_p(rows, group, p).withColumn("p_adjusted", F.least(F.lit(1.0), weight * tail(at)))


#: The digamma function at 1, less Euler's constant.
DIGAMMA_1 = -0.5772156649015329
#: Square roots of the points, and their distance, at which Landau's integral is summed.
STEP, STEPS = 0.002, 4750


def _landau_tail(x: float) -> float:
    """Chance of a standard Landau value above x: the integral over s > 0 of exp(-s log s - x s) sin(pi s) / (pi s).

    Summed at s = v^2 / max(1, x) for equally spaced v; below -4 the chance is 1 to 9 digits.
    """
    if x < -4:
        return 1.0
    v = (np.arange(STEPS) + 0.5) * STEP
    s = v * v / max(1.0, x)
    return float((np.exp(-s * np.log(s) - x * s) * np.sin(np.pi * s) / (np.pi * s) * 2 * v).sum() * STEP / max(1.0, x))


def five_numbers(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, low, lower_hinge, middle, upper_hinge, high): Tukey's summary, whose hinges are no quartiles in general."""
    order = Window.partitionBy(group).orderBy(value)
    placed = rows.where(F.col(value).isNotNull()).select(group, value, F.row_number().over(order).alias("i"), F.count("*").over(Window.partitionBy(group)).alias("n"))
    depth = (F.floor((F.col("n") + 3) / 2)) / 2
    at = lambda d: F.avg(F.when((F.col("i") == F.floor(d)) | (F.col("i") == F.ceil(d)), F.col(value)))
    return placed.groupBy(group, "n").agg(
        F.min(value).alias("low"), at(depth).alias("lower_hinge"), at((F.col("n") + 1) / 2).alias("middle"), at(F.col("n") + 1 - depth).alias("upper_hinge"), F.max(value).alias("high")
    )


def harmonic_mean_p(rows: DataFrame, group: str, p: str) -> DataFrame:
    """(group, n, hmp): harmonic mean of the p-values above 0."""
    rows = rows.where(F.col(p) > 0)
    return rows.groupBy(group).agg(F.count("*").alias("n"), (F.count("*") / F.sum(1 / F.col(p))).alias("hmp"))


def densities(rows: DataFrame, group: str, value: str, low: float, high: float, points: int = 64) -> DataFrame:
    """(group, at, density): Gaussian kernel densities of each group at equally spaced points of [low, high], for violins.

    Values are counted at the nearest point first (those outside go to the ends), so each group's counts are convolved point by point, however many rows it
    has. The bandwidth is 0.9 min(standard deviation, interquartile range / 1.34) n^(-1/5), of the range alone or the deviation alone where the other is 0;
    groups with one value only, or a single row, have no density.
    """
    step = (high - low) / (points - 1)
    rows = rows.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    place = F.greatest(F.lit(0), F.least(F.lit(points - 1), F.round((F.col("v") - low) / step))).cast("int")
    counts = rows.groupBy(group, place.alias("i")).agg(F.count("*").alias("k"))
    q = rows.groupBy(group).agg(F.stddev_samp("v").alias("sd"), F.expr("percentile(v, array(0.25, 0.75))").alias("q"), F.count("*").alias("n"))
    spread = F.array_min(F.filter(F.array("sd", (F.col("q")[1] - F.col("q")[0]) / 1.34), lambda x: x > 0))
    widths = q.select(group, "n", (0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h")).where("h > 0")
    binned = counts.join(widths.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    spots = binned.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    far = (F.col("i") - F.col("j")) * step / F.col("h")
    part = F.col("k") * F.exp(-far * far / 2) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return spots.groupBy(group, "j").agg(F.sum(part).alias("density")).select(group, (F.col("j") * step + low).alias("at"), "density")
