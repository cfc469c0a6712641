"""Pairwise-complete correlation, ranks, p-values, pseudo-inverse VIF and nearest-neighbour mutual information."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.operators.joins import spread_join
from sifter.operators.ranks import average_ranks, double, quantiles
from sifter.operators.sampling import row_sample
from sifter.sources.shared import durable

#: Columns up to which pairs are expressions of one aggregation; beyond it, Gram sums come from Arrow batches.
WIDE = 24
#: Distinct values of a column up to which its table of ranks (16 bytes a row) is broadcast.
RANKS_SENT = 1 << 20
#: Values of a table that one task ranks whole: 32 MB.
TASK_CELLS = 1 << 22


def bounded(r: Column) -> Column:
    """r within [-1, 1]; null stays null, which greatest() and least() alone pass over."""
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pearson(df: DataFrame, columns: list[str], min_rows: int = 30) -> DataFrame:
    """(a, b, n, r) of each pair of columns over the rows that have both; r is null below min_rows or for a constant side.

    Columns without nulls give sums of products about their means, a pass after the one that finds these. Other pairs have
    covariances and deviations in the same pass, divided by try_divide, as corr() fails on a constant column in ANSI mode. Wide
    tables sum Gram matrices of Arrow batches instead.
    """
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, n bigint, r double")
    if len(columns) > WIDE:
        return _gram(df, columns, min_rows)
    kinds = {"n": F.count, "m": F.avg, "l": F.min, "h": F.max}
    seen = df.agg(F.count("*").alias("rows"), *(f(double(c)).alias(f"{p}{k}") for k, c in enumerate(columns) for p, f in kinds.items())).first()
    at = [k for k in range(len(columns)) if seen.rows and seen[f"n{k}"] == seen.rows and math.isfinite(seen[f"m{k}"])]
    mean = {columns[k]: seen[f"m{k}"] for k in at}
    flat = {columns[k] for k in at if seen[f"l{k}"] == seen[f"h{k}"]}
    cells, found = _products(mean, [p for p in pairs if p[0] in mean and p[1] in mean])
    n = F.lit(seen.rows).cast("bigint")
    out = [(a, b, n, F.lit(None).cast("double") if {a, b} & flat else r) for (a, b), r in found(n).items()]
    for k, (a, b) in enumerate(pairs):
        if a in mean and b in mean:
            continue
        both = double(a).isNotNull() & double(b).isNotNull()
        x, y = F.when(both, double(a)), F.when(both, double(b))
        cells += [
            F.count(x).alias(f"n{k}"),
            F.covar_pop(x, y).alias(f"c{k}"),
            F.stddev_pop(x).alias(f"x{k}"),
            F.stddev_pop(y).alias(f"y{k}"),
        ]
        out.append((a, b, F.col(f"n{k}"), bounded(F.try_divide(F.col(f"c{k}"), F.col(f"x{k}") * F.col(f"y{k}")))))
    return df.agg(*cells).select(_rows_of_pairs(sorted(out, key=lambda x: pairs.index(x[:2])), min_rows))


def _rows_of_pairs(found: list[tuple[str, str, Column, Column]], min_rows: int) -> Column:
    """(a, b, n, r) rows of one row of sums."""
    cell = lambda a, b, n, r: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), F.when(n >= min_rows, r).alias("r"))
    return F.inline(F.array(*(cell(*x) for x in found)))


def _products(mean: dict[str, float], pairs: list[tuple[str, str]]):
    """(cells, found): sums of products of columns without nulls about their means, and r of each pair by these and n."""
    needed = list(dict.fromkeys(c for p in pairs for c in p))
    of = {c: f"{k}" for k, c in enumerate(needed)}
    less = {c: double(c) - F.lit(mean[c]) for c in needed}
    cells = [F.sum(less[c]).alias(f"s{of[c]}") for c in needed]
    cells += [F.sum(less[a] * less[b]).alias(f"p{of[a]}_{of[b]}") for a, b in [*((c, c) for c in needed), *pairs]]
    spread = lambda n, a, b: F.col(f"p{of[a]}_{of[b]}") - F.col(f"s{of[a]}") * F.col(f"s{of[b]}") / n
    size = lambda n, c: F.sqrt(F.greatest(F.lit(0.0), spread(n, c, c)))
    return cells, lambda n: {(a, b): bounded(F.try_divide(spread(n, a, b), size(n, a) * size(n, b))) for a, b in pairs}


def _gram(df: DataFrame, columns: list[str], min_rows: int) -> DataFrame:
    spark, p = df.sparkSession, len(columns)
    mean = df.agg(*(F.avg(double(c)).alias(f"m{k}") for k, c in enumerate(columns))).first()
    shift = np.array([m or 0.0 for m in mean])

    def sums(batches):
        total = np.zeros((6, p, p))
        for pdf in batches:
            x = pdf.to_numpy(float) - shift
            here = ~np.isnan(x)
            x, w = np.where(here, x, 0.0), here.astype(float)
            total += np.stack([w.T @ w, x.T @ w, w.T @ x, (x * x).T @ w, w.T @ (x * x), x.T @ x])
        i, j = np.triu_indices(p, 1)
        yield pd.DataFrame({"i": i, "j": j, **{f"s{k}": total[k][i, j] for k in range(6)}})

    got = df.select(*(double(c).alias(f"c{k}") for k, c in enumerate(columns))).mapInPandas(
        sums,
        "i int, j int, s0 double, s1 double, s2 double, s3 double, s4 double, s5 double",
    ).groupBy("i", "j").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(6)))
    n, sx, sy, sxx, syy, sxy = (F.col(f"s{k}") for k in range(6))
    r = F.try_divide(
        n * sxy - sx * sy,
        F.sqrt(F.greatest(F.lit(0.0), n * sxx - sx * sx)) * F.sqrt(F.greatest(F.lit(0.0), n * syy - sy * sy)),
    )
    names = spark.createDataFrame([(k, c) for k, c in enumerate(columns)], "k int, name string")
    a, b = (names.select(F.col("k").alias(i), F.col("name").alias(c)) for i, c in (("i", "a"), ("j", "b")))
    return got.join(a, "i").join(b, "j").select("a", "b", n.cast("bigint").alias("n"), F.when(n >= min_rows, bounded(r)).alias("r"))


def _rho(sums: DataFrame) -> Column:
    """Pearson's r from the sums n, sx, sy, sxx, syy and sxy."""
    n, sx, sy, sxx, syy, sxy = (F.col(c).cast("double") for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    spread = F.sqrt(F.greatest(F.lit(0.0), n * sxx - sx * sx)) * F.sqrt(F.greatest(F.lit(0.0), n * syy - sy * sy))
    return bounded(F.try_divide(n * sxy - sx * sy, spread))


def spearman(df: DataFrame, columns: list[str], min_rows: int = 30) -> DataFrame:
    """(a, b, n, r): Pearson's r of average ranks, ranked for each pair over the rows that have both.

    Tables of up to TASK_CELLS values, which the row budgets give, are ranked by one task. Beyond, columns without nulls are
    ranked once for all of their pairs, other pairs each by itself; ranks come from counts of distinct values, in tasks of
    bounded size.
    """
    spark = df.sparkSession
    pairs = list(combinations(columns, 2))
    if not pairs:
        return spark.createDataFrame([], "a string, b string, n bigint, r double")
    cells = (F.count_if(double(c).isNull()).alias(f"n{k}") for k, c in enumerate(columns))
    seen = df.agg(F.count("*").alias("rows"), *cells).first()
    if seen.rows * len(columns) <= TASK_CELLS:
        return _spearman_local(df, columns, min_rows)
    full = [c for k, c in enumerate(columns) if not seen[f"n{k}"]]
    one = [p for p in pairs if p[0] in full and p[1] in full]
    other = [p for p in pairs if p not in set(one)]
    found = [_spearman_full(df, full, seen.rows, min_rows)] if one else []
    found += [_spearman_pairs(df, other, min_rows)] if other else []
    return reduce(DataFrame.union, found)


def _spearman_local(df: DataFrame, columns: list[str], min_rows: int) -> DataFrame:
    """Spearman's r of a table that one task holds."""
    pairs = list(combinations(range(len(columns)), 2))

    def ranked(got: pa.Table) -> pa.Table:
        pdf = got.select([f"c{k}" for k in range(len(columns))]).to_pandas()
        whole = {k: pdf[f"c{k}"].rank() for k in range(len(columns)) if not pdf[f"c{k}"].isna().any()}
        out = []
        for i, j in pairs:
            both = pdf[[f"c{i}", f"c{j}"]].dropna() if i not in whole or j not in whole else None
            x, y = (whole[i], whole[j]) if both is None else (both[c].rank() for c in both)
            flat = len(x) < max(2, min_rows) or x.nunique() < 2 or y.nunique() < 2
            out.append((i, j, len(x), None if flat else float(np.clip(np.corrcoef(x, y)[0, 1], -1, 1))))
        return pa.table(
            dict(zip(("i", "j", "n", "r"), map(list, zip(*out, strict=True)), strict=True)),
            pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("r", pa.float64())]),
        )

    held = df.select(F.lit(0).alias("one"), *(double(c).alias(f"c{k}") for k, c in enumerate(columns)))
    names = df.sparkSession.createDataFrame([(i, j, columns[i], columns[j]) for i, j in pairs], "i int, j int, a string, b string")
    made = held.groupBy("one").applyInArrow(ranked, "i int, j int, n bigint, r double")
    return names.join(made, ["i", "j"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), "r")


def _spearman_full(df: DataFrame, columns: list[str], rows: int, min_rows: int) -> DataFrame:
    """Spearman's r of columns without nulls: a table of ranks for each, joined to the rows; broadcast if it is small, else so that
    the rows of a frequent value stay where they are.

    The rows are read twice: counts of values and ranks are written, as each column's join reads them. The mean of the ranks is
    known, so products about it are summed, and squares come from the ranks alone.
    """
    cells = F.array(*(F.struct(F.lit(k).alias("k"), double(c).alias("v")) for k, c in enumerate(columns)))
    counts = durable(df.select(F.inline(cells)).groupBy("k", "v").agg(F.count("*").alias("w")), "counts")
    off = F.col("rank") - (rows + 1) / 2
    ranks = durable(average_ranks(counts, "k", "v", "w").select("k", "v", "w", off.alias("rank")), "ranks")
    held = {r.k: r for r in ranks.groupBy("k").agg(F.count("*").alias("distinct"), F.sum(F.col("w") * F.col("rank") * F.col("rank")).alias("squares")).collect()}
    ranked = df.select(*(double(c).alias(f"v{k}") for k, c in enumerate(columns)))
    for k in sorted(held, key=lambda k: held[k].distinct):  # broadcasts first: they move no row
        own = ranks.where(F.col("k") == k).select(F.col("v").alias(f"v{k}"), F.col("rank").alias(f"r{k}"), "w")
        ranked = ranked.join(F.broadcast(own.drop("w")), f"v{k}") if held[k].distinct <= RANKS_SENT else spread_join(ranked, own, f"v{k}", "w")
    pairs = list(combinations(range(len(columns)), 2))
    sums = ranked.agg(*(F.sum(F.col(f"r{i}") * F.col(f"r{j}")).alias(f"p{i}_{j}") for i, j in pairs))
    size = lambda k: F.lit(math.sqrt(held[k].squares))
    r = lambda i, j: bounded(F.try_divide(F.col(f"p{i}_{j}"), size(i) * size(j)))
    return sums.select(_rows_of_pairs([(columns[i], columns[j], F.lit(rows).cast("bigint"), r(i, j)) for i, j in pairs], min_rows))


def _spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]], min_rows: int) -> DataFrame:
    """Spearman's r of each pair by itself, over rows that have both; pairs are rows of one unpivoted table."""
    spark = df.sparkSession
    both = lambda a, b: double(a).isNotNull() & double(b).isNotNull()
    cell = lambda k, a, b: F.struct(F.lit(k).alias("pair"), double(a).alias("x"), double(b).alias("y"))
    cells = F.array(*(F.when(both(a, b), cell(k, a, b)) for k, (a, b) in enumerate(pairs)))
    joint = durable(df.select(F.inline(F.array_compact(cells))).groupBy("pair", "x", "y").agg(F.count("*").alias("w")), "joint")
    for v in ("x", "y"):
        held = joint.groupBy("pair", v).agg(F.sum("w").alias("t"), F.count("*").alias("rows"))
        ranks = durable(average_ranks(held, "pair", v, "t").select("pair", v, F.col("rank").alias(f"r{v}"), "rows"), "ranks")
        joint = spread_join(joint, ranks, ["pair", v], "rows")
    w, x, y = F.col("w").cast("double"), F.col("rx"), F.col("ry")
    parts = {"n": F.col("w"), "sx": w * x, "sy": w * y, "sxx": w * x * x, "syy": w * y * y, "sxy": w * x * y}
    s = joint.groupBy("pair").agg(*(F.sum(e).alias(k) for k, e in parts.items()))
    names = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return names.join(s, "pair", "left").select(
        "a",
        "b",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("n") >= min_rows, _rho(s)).alias("r"),
    )


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for k in range(400):
        m = k // 2
        t = 1.0 if k == 0 else m * (b - m) * x / (
            (a + 2 * m - 1) * (a + 2 * m)
        ) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + t * d, tiny, key=abs)
        c = max(1 + t / c, tiny, key=abs)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_statistic(r: float, n: int) -> float:
    """Student's t of a correlation r of n rows; infinite for a perfect one."""
    return math.copysign(math.inf, r) if abs(r) >= 1 else r * math.sqrt((n - 2) / (1 - r * r))


def p_value(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation r of n rows, from Student's t."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t = t_statistic(r, n)
    return beta_inc((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t * t))


def vif(df: DataFrame, columns: list[str]) -> list[tuple[str, float]]:
    """Variance inflation of each non-constant column: the diagonal of the pseudo-inverse of the correlation matrix, 1 at least.

    Missing values take their column's median. Exact copies share their weight under a pseudo-inverse, so two of them
    have 1, not infinity. Only p * p numbers come to the driver.
    """
    if len(columns) < 2:
        return []
    cells = (
        x
        for k, c in enumerate(columns)
        for x in (F.count_if(double(c).isNull()).alias(f"n{k}"), F.min(double(c)).alias(f"l{k}"), F.max(double(c)).alias(f"h{k}"))
    )
    seen = df.agg(*cells).first()
    live = [c for k, c in enumerate(columns) if seen[f"l{k}"] is not None and seen[f"l{k}"] != seen[f"h{k}"]]
    median = {c: quantiles(df, c, [0.5])[0] for k, c in enumerate(columns) if c in live and seen[f"n{k}"]}
    filled = df.select(*(F.coalesce(double(c), F.lit(median[c])).alias(c) if c in median else double(c).alias(c) for c in live))
    if len(live) < 2:
        return []
    m = np.eye(len(live))
    at = {c: k for k, c in enumerate(live)}
    for r in pearson(filled, live, 2).collect():
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.r if r.r is not None else 0.0
    diagonal = np.diag(np.linalg.pinv(m, hermitian=True))
    return [(c, max(1.0, float(diagonal[k]))) for k, c in enumerate(live)]


def _digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.asarray(x, float).copy(), 0.0
    out = np.zeros_like(x)
    for _ in range(6):
        out -= np.where(x < 6, 1 / x, 0.0)
        x = np.where(x < 6, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def _neighbour_distance(points: np.ndarray, k: int) -> np.ndarray:
    """Chebyshev distance to the k-th other point, by chunks of rows."""
    out = np.empty(len(points))
    columns = [np.ascontiguousarray(c) for c in points.T]
    for at in range(0, len(points), 256):
        d = np.abs(columns[0][at : at + 256, None] - columns[0][None])
        for c in columns[1:]:
            np.maximum(d, np.abs(c[at : at + 256, None] - c[None]), out=d)
        out[at : at + 256] = np.partition(d, k, axis=1)[:, k]
    return out


def _within(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Points nearer than radius to each point, itself included."""
    s = np.sort(x)
    return np.searchsorted(s, x + radius, "left") - np.searchsorted(s, x - radius, "right")


def _scaled(x: np.ndarray, seed: int) -> np.ndarray:
    """Unit spread, with a tiny seeded jitter so that ties don't make distances of zero."""
    s = x.std()
    x = x / s if s > 0 else x
    return x + 1e-10 * max(1.0, float(np.abs(x).mean())) * np.random.default_rng(seed).standard_normal(len(x))


def mi_continuous(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Kraskov, Stoegbauer and Grassberger (2004), first estimator, in nats; 0 at least."""
    n = len(x)
    if n <= k + 1:
        return 0.0
    x, y = _scaled(x, 1), _scaled(y, 2)
    radius = np.nextafter(_neighbour_distance(np.c_[x, y], k), 0)
    nx, ny = _within(x, radius), _within(y, radius)
    return max(
        0.0,
        float(
            _digamma(np.array([n]))[0] + _digamma(np.array([k]))[0] - np.mean(
                _digamma(np.maximum(nx, 1)) + _digamma(np.maximum(ny, 1)),
            ),
        ),
    )


def mi_classes(x: np.ndarray, label: np.ndarray, k: int = 3) -> float:
    """Ross (2014): mutual information of a continuous variable and a class, in nats; classes of one row are left out."""
    x = _scaled(x, 1)
    keep = np.zeros(len(x), bool)
    radius, used, size = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for c in np.unique(label):
        at = np.flatnonzero(label == c)
        if len(at) > 1:
            kk = min(k, len(at) - 1)
            radius[at] = np.nextafter(_neighbour_distance(x[at, None], kk), 0)
            used[at], size[at], keep[at] = kk, len(at), True
    n = int(keep.sum())
    if n < 2:
        return 0.0
    m = _within(x[keep], radius[keep])
    return max(
        0.0,
        float(
            _digamma(np.array([n]))[0] + np.mean(_digamma(used[keep])) - np.mean(_digamma(size[keep])) - np.mean(
                _digamma(np.maximum(m, 1)),
            ),
        ),
    )


def mutual_information(
    df: DataFrame,
    pairs: list[tuple[str, str]],
    rows: int = 5000,
    k: int = 3,
    discrete: bool = False,
    min_rows: int = 30,
    n: int | None = None,
) -> DataFrame:
    """(a, b, n, score) for each pair over a bounded sample, a group of at most `rows` rows for each; with discrete, b is a class."""
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "a string, b string, n bigint, score double")
    needed = list(dict.fromkeys(c for p in pairs for c in p))
    held = row_sample(df.select(*(F.col(f"`{c}`") for c in needed)), rows, n=n)
    right = (lambda c: F.hash(F.col(f"`{c}`")).cast("double")) if discrete else double
    cells = F.array(
        *(
            F.when(
                F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull(),
                F.struct(F.lit(i).alias("pair"), double(a).alias("x"), right(b).alias("y")),
            )
            for i, (a, b) in enumerate(pairs)
        ),
    )

    def score(key, pdf):
        pdf = pdf.sort_values(["x", "y"])
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        s = 0.0 if len(x) < min_rows else mi_classes(x, y, k) if discrete else mi_continuous(x, y, k)
        return pd.DataFrame({"pair": [key[0]], "n": [len(x)], "score": [s]})

    # A number of partitions that is asked for isn't merged by bytes: a pair's work is the square of its rows.
    long = held.select(F.inline(F.array_compact(cells))).repartition(min(len(pairs), 4096), "pair")
    got = long.groupBy("pair").applyInPandas(score, "pair int, n bigint, score double")
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return names.join(got, "pair").select("a", "b", "n", "score")
