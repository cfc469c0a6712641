"""Statistics of a column or pair as DataFrame plans; the normality test works on a bounded sample."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.operators.moments import pearson, spearman
from sifter.operators.joins import spread_join
from sifter.operators.ranks import double, quantiles
from sifter.operators.sampling import row_sample
from sifter.sources.shared import durable

def z_scores(df: DataFrame, column: str) -> DataFrame:
    """df with z: distance from the mean in sample deviations; null below two values, 0 for a constant column."""
    x = double(column)
    m = df.agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std"), F.count(x).alias("_n"))
    z = F.when(F.col("_n") >= 2, F.when(F.col("_std") == 0, F.lit(0.0)).otherwise(F.try_divide(x - F.col("_mean"), F.col("_std"))))
    return df.join(F.broadcast(m)).withColumn("z", F.when(x.isNotNull(), z)).drop("_mean", "_std", "_n")


def iqr_bounds(df: DataFrame, column: str, multiplier: float = 1.5) -> DataFrame:
    """(low, high): quartiles, by linear interpolation, less and plus multiplier interquartile ranges; infinite below four values."""
    x = double(column)
    n = df.agg(F.count(x)).first()[0]
    a, b = quantiles(df, column, [0.25, 0.75]) if n >= 4 else (-math.inf, math.inf)
    step = multiplier * (b - a) if n >= 4 else 0.0
    return df.sparkSession.createDataFrame([(a - step, b + step)], "low double, high double")


def cohens_d(df: DataFrame, column: str, first: Column) -> DataFrame:
    """(d): difference of the means of the rows where `first` holds and where not, in pooled deviations; 0 where undefined."""
    a, b = F.when(first, double(column)), F.when(~first, double(column))
    m = df.agg(*(f(x).alias(f"{n}{k}") for k, x in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    pooled = F.sqrt(F.try_divide((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"), F.col("na") + F.col("nb") - 2))
    d = F.try_divide(F.col("ma") - F.col("mb"), pooled)
    return m.select(F.when((F.col("na") >= 2) & (F.col("nb") >= 2), F.coalesce(d, F.lit(0.0))).otherwise(F.lit(0.0)).alias("d"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """(v) of two categorical columns over rows that have both; Yates' correction for a 2 x 2 table; 0 where undefined."""
    held = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = held.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    # Over the cells that occur alone: the others add what makes the expected counts sum to the total.
    part = cells.join(rows, "a").join(cols, "b").agg(
        F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("s"),
        F.sum("n").alias("total"),
    )
    size = rows.agg(F.count("*").alias("p"), F.max("ra").alias("r1")).join(cols.agg(F.count("*").alias("q"), F.max("cb").alias("c1")))
    most = F.col("total").cast("double")
    plain = most * (F.col("s") - 1)
    # In a 2 x 2 table every cell is equally far from its expected count, d; chi2 = plain, so d follows from it.
    r1, c1 = F.col("r1"), F.col("c1")
    scale = F.try_divide(most * most * most, r1 * (most - r1) * c1 * (most - c1))
    d = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(plain, scale)))
    chi2 = F.when((F.col("p") == 2) & (F.col("q") == 2), scale * F.pow(d - F.least(F.lit(0.5), d), F.lit(2.0))).otherwise(plain)
    v = F.sqrt(F.try_divide(F.greatest(F.lit(0.0), chi2), most * (F.least("p", "q") - 1)))
    return part.join(size).select(F.coalesce(v, F.lit(0.0)).alias("v"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """(bits) of a column's values, nulls left out; 0 for an empty column."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    got = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return got.select(F.coalesce(F.log2("t") - F.try_divide("s", "t"), F.lit(0.0)).alias("bits"))


def coefficient_of_variation(df: DataFrame, column: str) -> DataFrame:
    """(cv): |deviation / mean|; 0 below two values; with a mean of 0, infinite, or 0 for a constant."""
    x = double(column)
    m = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    zero = F.when(F.col("s") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return m.select(F.when(F.col("n") < 2, F.lit(0.0)).when(F.col("m") == 0, zero).otherwise(F.abs(F.try_divide("s", "m"))).alias("cv"))


def skewness(df: DataFrame, column: str) -> DataFrame:
    """(skewness), corrected for bias; 0 below three values or for a constant."""
    x = double(column)
    m = df.agg(F.count(x).alias("n"), F.skewness(x).alias("g"), F.stddev_pop(x).alias("s"))
    n = F.col("n")
    return m.select(
        F.when(
            (n >= 3) & (F.col("s") > 0),
            F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1)) * F.col("g"),
        ).otherwise(F.lit(0.0)).alias("skewness"),
    )


def kurtosis(df: DataFrame, column: str) -> DataFrame:
    """(kurtosis): excess, corrected for bias; 0 below four values or for a constant."""
    x = double(column)
    m = df.agg(F.count(x).cast("double").alias("n"), F.kurtosis(x).alias("g"), F.stddev_pop(x).alias("s"))
    n = F.col("n")
    value = ((n + 1) * F.col("g") + 6) * (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0))
    return m.select(F.when((n >= 4) & (F.col("s") > 0), value).otherwise(F.lit(0.0)).alias("kurtosis"))


def normality(df: DataFrame, column: str, alpha: float = 0.05, small: int = 5000) -> tuple[bool, float]:
    """(normal, p): (True, 1.0) below eight values; Shapiro-Wilk up to `small` values, else D'Agostino's K squared from moments."""
    x = double(column)
    n = df.agg(F.count(x)).first()[0]
    if n < 8:
        return True, 1.0
    if n <= small:
        p = shapiro_p(np.sort(np.array([r[0] for r in df.select(x).where(x.isNotNull()).collect()])))
    else:
        m = df.agg(F.skewness(x).alias("g"), F.kurtosis(x).alias("k")).first()
        p = k2_p(n, m.g, m.k + 3)
    return p > alpha, p


def k2_p(n: int, g1: float, b2: float) -> float:
    """D'Agostino and Pearson's omnibus test from the sample skewness and kurtosis."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(math.sqrt(w2)))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (b2 - mean) / math.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    cube = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(cube) ** (1 / 3), cube)) / math.sqrt(2 / (9 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """By Newton steps on the error function from a logistic start."""
    p = np.asarray(p, float)
    x = np.sign(p - 0.5) * np.sqrt(np.maximum(0, -2 * np.log(np.minimum(p, 1 - p)))) * 0.8
    for _ in range(60):
        cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
        step = (cdf - p) / (np.exp(-x * x / 2) / math.sqrt(2 * math.pi))
        x = x - np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-12:
            break
    return x


def shapiro_p(x: np.ndarray) -> float:
    """p of the Shapiro-Wilk test of sorted values, 12 to 5000 of them, after Royston (1995)."""
    n = len(x)
    if n < 4 or x[-1] == x[0]:
        return 1.0
    m = _normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    ss, u = float(m @ m), 1 / math.sqrt(n)
    c = m / math.sqrt(ss)
    poly = lambda k: sum(v * u**i for i, v in enumerate(k))
    # Royston's polynomial coefficients.
    last = poly([c[-1], 0.221157, -0.147981, -2.071190, 4.434685, -2.706056])
    before = poly([c[-2], 0.042981, -0.293762, -1.752461, 5.682633, -3.582633])
    a = np.empty(n)
    two = n > 5
    phi = (ss - 2 * m[-1] ** 2 - (2 * m[-2] ** 2 if two else 0)) / (1 - 2 * last**2 - (2 * before**2 if two else 0))
    a[:] = m / math.sqrt(phi)
    a[-1], a[0] = last, -last
    if two:
        a[-2], a[1] = before, -before
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n <= 11:
        gamma = 0.459 * n - 2.273
        mu, sigma = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, math.exp(
            1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3,
        )
        left = gamma - math.log(max(1 - w, 1e-300))
        if left <= 0:
            return 0.0
        z = (-math.log(left) - mu) / sigma
    else:
        v = math.log(n)
        mu, sigma = 0.0038915 * v**3 - 0.083751 * v**2 - 0.31082 * v - 1.5861, math.exp(0.0030302 * v**2 - 0.082676 * v - 0.4803)
        z = (math.log(max(1 - w, 1e-300)) - mu) / sigma
    return 0.5 * math.erfc(z / math.sqrt(2))


def sign_sum(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Sum over all pairs of rows of w * w' * sign(x - x') * sign(y - y'), level by level of a merge sort over the ranks of x."""
    p, total = np.unique(x, return_inverse=True)[1], 0
    for level in range(int(p.max(initial=0)).bit_length()):
        group, right = p >> (level + 1), p >> level & 1
        order = np.lexsort((y, group))
        g, v, r, n = group[order], y[order], right[order], w[order]
        left = np.r_[0, np.cumsum(np.where(r == 0, n, 0))]
        new_g = np.r_[True, g[1:] != g[:-1]]
        new_v = new_g | np.r_[True, v[1:] != v[:-1]]

        def bounds(new: np.ndarray, n: int = len(g)) -> tuple[np.ndarray, np.ndarray]:
            first, run = np.flatnonzero(new), np.cumsum(new) - 1
            return first[run], np.r_[first[1:], n][run]

        (g_from, g_to), (v_from, v_to) = bounds(new_g), bounds(new_v)
        more = (left[v_from] - left[g_from]) - (left[g_to] - left[v_to])
        total += sum((n * more)[r == 1].tolist())
    return total


def sign_sums(joint: DataFrame, task_rows: int, most: int) -> DataFrame:
    """(pair, s): for each pair, sign_sum() of its counts x, y, w, in groups of at most task_rows rows or (2 most + 1)^2 cells.

    A larger group's x and y are each cut at quantiles into up to `most` intervals and single values. Pairs of rows are then of three
    kinds: apart in both cuts (settled by the counts of cells), in one interval of x, or apart in x's cuts and in one interval of
    y. The latter two are groups of their own, about 1 / most as large, and are cut again until they fit.
    """
    todo, done = joint.select("pair", F.lit(0).cast("long").alias("g"), F.col("x").cast("double"), F.col("y").cast("double"), "w"), []
    shares = [k / most for k in range(1, most)]
    # An even number is an interval between cuts, an odd one the value of a cut: its rows are tied.
    at = lambda c, v: F.size(F.filter(c, lambda k: k <= F.col(v))) + F.size(F.filter(c, lambda k: k < F.col(v)))
    named = lambda kind, block: F.xxhash64("g", F.lit(kind), block)

    def signs(key, pdf):
        return pd.DataFrame(
            {"pair": [key[0]], "s": [float(sign_sum(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy(np.int64)))]},
        )

    while True:
        size = durable(todo.groupBy("pair", "g").agg(F.count("*").alias("m")), "sizes")
        large = size.where(F.col("m") > task_rows)
        if large.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(large, ["pair", "g"], "left_anti"))
        cut = todo.join(large.select("pair", "g"), ["pair", "g"], "left_semi").groupBy("pair", "g").agg(
            F.count("*").alias("m"),
            F.percentile_approx("x", shares).alias("cx"),
            F.percentile_approx("y", shares).alias("cy"),
        )
        step = F.greatest(F.lit(1), F.floor(F.lit(most) / F.least(F.lit(most), F.ceil(F.col("m") / task_rows))).cast("int"))
        some = lambda c: F.array_distinct(F.filter(c, lambda _, k: (k + 1) % step == 0))  # noqa: B023, E731
        cut = durable(cut.withColumns({"cx": some("cx"), "cy": some("cy")}), "cuts")
        placed = spread_join(todo, cut, ["pair", "g"], "m")
        placed = durable(placed.select("pair", "g", "x", "y", "w", at("cx", "x").alias("bx"), at("cy", "y").alias("by")), "placed")
        cells = placed.groupBy("pair", "g", "bx", "by").agg(F.sum("w").alias("w"))
        done.append(cells.select("pair", named(0, F.lit(0)).alias("g"), F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y"), "w"))
        inner = placed.where("bx % 2 = 0").select("pair", named(1, F.col("bx")).alias("g"), "x", "y", "w")
        outer = placed.where("by % 2 = 0").groupBy("pair", "g", "bx", "by", "y").agg(F.sum("w").alias("w"))
        outer = outer.select("pair", named(2, F.col("by")).alias("g"), F.col("bx").cast("double").alias("x"), "y", "w")
        todo = durable(inner.unionByName(outer), "todo")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.groupBy("pair", "g").applyInPandas(signs, "pair int, s double").groupBy("pair").agg(F.sum("s").alias("s"))


def kendall(
    df: DataFrame,
    columns: list[str],
    rows: int | None = None,
    min_rows: int = 30,
    task_rows: int = 1 << 15,
    most: int = 256,
) -> DataFrame:
    """(a, b, n, r): tau-b of each pair of columns over all rows that have both; over a sample of `rows` rows only if asked.

    Rows are counted by (x, y); sign_sums() settles pairs of rows, in tasks of about task_rows counts whatever the table's size.
    """
    spark = df.sparkSession
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return spark.createDataFrame([], "a string, b string, n bigint, r double")
    held = df.select(*(F.col(f"`{c}`") for c in columns))
    held = held if rows is None else row_sample(held, rows)
    here = lambda c: double(c).isNotNull() & ~F.isnan(double(c))
    cells = F.array(
        *(
            F.when(here(a) & here(b), F.struct(F.lit(k).alias("pair"), double(a).alias("x"), double(b).alias("y")))
            for k, (a, b) in enumerate(pairs)
        ),
    )
    joint = held.select(F.inline(F.array_compact(cells))).groupBy("pair", "x", "y").agg(F.count("*").alias("w"))
    joint = durable(joint, "joint")
    s = sign_sums(joint, task_rows, most)
    two = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    tied = [
        joint.groupBy("pair", v).agg(F.sum("w").alias("t")).groupBy("pair").agg(F.sum("t").alias(f"n{v}"), two("t").alias(f"t{v}"))
        for v in ("x", "y")
    ]
    n = F.col("nx")
    every = n.cast("double") * (n - 1) / 2
    r = F.try_divide(F.col("s"), F.sqrt(every - F.col("tx")) * F.sqrt(every - F.col("ty")))
    names = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    got = names.join(s.join(tied[0], "pair").join(tied[1], "pair"), "pair", "left")
    return got.select(
        "a",
        "b",
        F.coalesce(n, F.lit(0)).alias("n"),
        F.when((n >= min_rows) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
    )


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson", min_rows: int = 30) -> DataFrame:
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"unknown method {method!r}")
    return {"pearson": pearson, "spearman": spearman, "kendall": lambda d, c, m: kendall(d, c, min_rows=m)}[method](df, columns, min_rows)
