"""Statistics of experiments.  Samples are rows; undefined results are null."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .curate import own_names, running


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def mean_difference(df: DataFrame, value: str, arm: Column) -> DataFrame:
    v = F.col(value)
    return df.where(finite(v)).agg((F.avg(F.when(arm, v)) - F.avg(F.when(~arm, v))).alias("mean_diff"))


def ks(df: DataFrame, value: str, arm: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, d): the largest gap of two empirical distribution functions.

    Values are counted first; their running sums are taken block by block, so continuous values are not one task.
    """
    keys = keys or []
    v = df.where(finite(F.col(value))).groupBy(*keys, F.col(value).alias("x")).agg(F.sum(F.when(arm, 1).otherwise(0)).alias("a"), F.sum(F.when(arm, 0).otherwise(1)).alias("b"))
    total = v.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    v = running(v, keys, "x", ["a", "b"], ["ra", "rb"], through=True)
    v = v.join(total, keys) if keys else v.crossJoin(F.broadcast(total))  # without keys, one row
    return v.groupBy(*keys).agg(F.max(F.abs(F.try_divide("ra", "na") - F.try_divide("rb", "nb"))).alias("d"))


def auroc(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, auc) by rank sum with average ranks; null if only one class is there.

    Rows are counted by score first; the rank sum of a tie needs only its counts.
    """
    keys = keys or []
    c = df.groupBy(*keys, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    c = running(c, keys, "s", "n", "before").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)
    out = c.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("p").alias("n1"), F.sum(F.col("rank") * F.col("p")).alias("r"))
    n0 = F.col("n") - F.col("n1")
    return out.select(*keys, "n", F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2.0, (F.col("n1") * n0).cast("double")).alias("auc"))


def benjamini_hochberg(df: DataFrame, p: str, key: str, q: float = 0.05) -> DataFrame:
    """``df`` with rejected: step-up over the finite p-values, ordered by (p, key); ranks come block by block."""
    ok = finite(F.col(p))
    one, rank, every, most = own_names(df, "one", "rank", "n", "last")
    ranked = running(df.where(ok).withColumn(one, F.lit(1).cast("long")), [], p, one, rank, [key], through=True)
    n = df.agg(F.count_if(ok).alias(every))
    passed = ranked.crossJoin(F.broadcast(n)).where(F.col(p) <= F.col(rank) / F.col(every) * q)
    last = passed.agg(F.max(rank).alias(most))  # one row
    yes = ranked.crossJoin(F.broadcast(last)).select(*df.columns, F.coalesce(F.col(rank) <= F.col(most), F.lit(False)).alias("rejected"))
    return yes.unionByName(df.where(~F.coalesce(ok, F.lit(False))).withColumn("rejected", F.lit(False)))


def log_factorial(n: Column) -> Column:
    """ln n!: a table up to 20, Stirling's series beyond (its error is under 1e-12 there)."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(21)])
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.ln(x) - x + F.ln(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.get(table, n.cast("int"))).otherwise(series)


def fisher(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """``df`` with odds_ratio and pvalue of the two-sided exact test of ((a, b), (c, d)).

    The tables of a row's margins are an array, as long as the least margin; nothing is shared between rows.
    """
    A, B, C, D = (F.col(x).cast("long") for x in (a, b, c, d))
    n1, n2, k = A + B, C + D, A + C
    f = log_factorial
    fixed = f(k) + f(n1 + n2 - k) + f(n1) + f(n2) - f(n1 + n2)
    pmf = lambda x: F.exp(fixed - f(x) - f(k - x) - f(n1 - x) - f(n2 - k + x))
    lo, hi = F.greatest(F.lit(0).cast("long"), k - n2), F.least(k, n1)
    seen = pmf(A)
    total = F.aggregate(F.transform(F.sequence(lo, hi), pmf), F.lit(0.0), lambda s, x: s + F.when(x <= seen * (1 + 1e-9) + 1e-15, x).otherwise(0.0))
    p = F.when((n1 == 0) | (n2 == 0), 1.0).otherwise(F.least(F.lit(1.0), total))
    odds = F.when((n1 == 0) | (n2 == 0) | (B == 0) | (C == 0), F.lit(None).cast("double")).otherwise(F.try_divide(A / B, C / D))
    return df.withColumns({"odds_ratio": odds, "pvalue": p})


#: Poisson(1) weights from a uniform 32-bit number: how many of the law's cumulative probabilities it reaches.
POISSON = [int(sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) * 2**32) for i in range(12)]
#: Weights that are in memory together.
WEIGHTS = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit numbers scattered: two rounds of shift, xor and product, which SQL over 64-bit integers can follow."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(16))) * np.uint64(0x45D9F3B) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def drawn(keys: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """A 32-bit number for each replicate (rows) and key (columns) that depends on key, replicate and seed only."""
    k = mixed(keys.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF))
    r = mixed((replicates.astype(np.uint64) * np.uint64(2654435761) + np.uint64(seed)) & np.uint64(0xFFFFFFFF))
    return mixed(k[None, :] ^ r[:, None])


def poisson(keys: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    return np.searchsorted(np.array(POISSON, np.uint64), drawn(keys, replicates, seed), "right").astype(np.float64)


def resampled(df: DataFrame, groups: list[str], key: str, values: list[str], replicates: int, seed: int) -> DataFrame:
    """(groups, replicate, w, sums of w times each value) of ``replicates`` resamples of all rows, in one pass over them.

    Each row has a Poisson(1) weight in each replicate, a function of its integer ``key``, so resamples need no exchange of rows:
    a task keeps a vector of sums for each group and replicate, and vectors are merged by addition.  Rows with equal keys are
    drawn together.  Null keys or values are left out; ``groups`` should be few.
    """
    kinds = dict(df.dtypes)
    names = [f"s{i}" for i in range(len(values))]
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in groups], "replicate long", "w double", *[f"{n} double" for n in names]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for g, rows in b.groupby(groups, dropna=False, sort=False) if groups else [((), b)]:
                sums = held.setdefault(g, np.zeros((1 + len(values), replicates)))
                step = max(1, WEIGHTS // replicates)
                for at in range(0, len(rows), step):
                    part = rows.iloc[at : at + step]
                    w = poisson(part["__key"].to_numpy(np.int64), np.arange(replicates), seed)
                    sums[0] += w.sum(1)
                    for i, n in enumerate(names):
                        sums[i + 1] += w @ part[n].to_numpy(float)
        for g, sums in held.items():
            yield pd.DataFrame({**dict(zip(groups, g)), "replicate": np.arange(replicates), "w": sums[0], **{n: sums[i + 1] for i, n in enumerate(names)}})

    rows = df.select(*groups, F.col(key).cast("long").alias("__key"), *[F.col(v).cast("double").alias(n) for v, n in zip(values, names)]).dropna(subset=["__key", *names])
    parts = rows.mapInPandas(run, schema)
    return parts.groupBy(*groups, "replicate").agg(F.sum("w").alias("w"), *[F.sum(n).alias(n) for n in names])


def bootstrap_means(df: DataFrame, value: str, arm: Column, order: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, diff): mean differences of resampled arms; ``order`` is an integer key of the rows."""
    rows = df.where(finite(F.col(value))).select(F.col(value).alias("v"), arm.alias("arm"), F.col(order).alias("key"))
    got = resampled(rows, ["arm"], "key", ["v"], replicates, seed).withColumn("m", F.try_divide("s0", "w"))
    return got.groupBy("replicate").agg((F.max(F.when(F.col("arm"), F.col("m"))) - F.max(F.when(~F.col("arm"), F.col("m")))).alias("diff"))


def interval(diffs: DataFrame, alpha: float, value: str = "diff") -> DataFrame:
    return diffs.agg(F.percentile(value, F.lit(alpha / 2)).alias("lo"), F.percentile(value, F.lit(1 - alpha / 2)).alias("hi"))


def tost(df: DataFrame, value: str, arm: Column, order: str, margin: float, replicates: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """point, ci_lo, ci_hi, equivalent: the 1 - 2 alpha interval lies within the margin."""
    if margin <= 0:
        raise ValueError("the margin must be positive")
    ci = interval(bootstrap_means(df, value, arm, order, replicates, seed), 2 * alpha)
    out = mean_difference(df, value, arm).crossJoin(ci)
    inside = F.coalesce((F.col("lo") >= -margin) & (F.col("hi") <= margin), F.lit(False))
    return out.select(F.col("mean_diff").alias("point"), F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"), inside.alias("equivalent"))


def cluster_bootstrap(df: DataFrame, value: str, cluster: str, replicates: int, seed: int) -> DataFrame:
    """estimate, lo, hi of the mean when whole clusters are drawn, as many as there are; clusters must be of one size.

    A task counts how often each of its clusters is drawn; all draws follow from replicate, draw and seed, so none is exchanged.
    """
    sums = df.groupBy(cluster).agg(F.sum(value).cast("double").alias("s"), F.count("*").alias("n"))
    facts = sums.agg(F.count("*").alias("c"), (F.sum("s") / F.sum("n")).alias("estimate"), F.when(F.min("n") != F.max("n"), F.raise_error(F.lit("clusters of unequal size"))).otherwise(F.max("n")).alias("size"))
    order = F.col(cluster) if isinstance(sums.schema[cluster].dataType, NumericType) else F.xxhash64(cluster)
    rows = running(sums.withColumns({"one": F.lit(1).cast("long"), "order": order}), [], "order", "one", "i").crossJoin(F.broadcast(facts.where("size > 0")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=["i", "s", "c", "estimate"])])
        if len(own):
            c, place = int(own["c"].iloc[0]), own["i"].to_numpy(np.int64)
            got = np.zeros(replicates)
            step = max(1, WEIGHTS // c)
            for at in range(0, replicates, step):
                r = np.arange(at, min(replicates, at + step))
                picks = (drawn(np.arange(c), r, seed) % np.uint64(c)).astype(np.int64) + np.arange(len(r))[:, None] * c
                times = np.bincount(picks.ravel(), minlength=len(r) * c).reshape(len(r), c)[:, place]
                got[at : at + step] = times @ own["s"].to_numpy(float)
            yield pd.DataFrame({"replicate": np.arange(replicates), "s": got, "estimate": own["estimate"].iloc[0], "n": c * own["size"].iloc[0]})

    parts = rows.select("i", "s", "c", "estimate", "size").mapInPandas(run, "replicate long, s double, estimate double, n long")
    got = parts.groupBy("replicate").agg(F.max("estimate").alias("estimate"), (F.sum("s") / F.max("n")).alias("m"))
    return got.agg(F.max("estimate").alias("estimate"), F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), F.count("*").alias("replicates"))


def divergences(p: DataFrame, q: DataFrame, on: list[str], alpha: float = 1.0) -> DataFrame:
    """kl (bits) and tvd of two count tables (on, n) over the union of their keys, smoothed by ``alpha``."""
    both = p.select(*on, F.col("n").alias("np")).join(q.select(*on, F.col("n").alias("nq")), on, "full_outer")
    both = both.select(*on, (F.coalesce("np", F.lit(0)) + alpha).alias("np"), (F.coalesce("nq", F.lit(0)) + alpha).alias("nq"))
    t = both.agg(F.sum("np").alias("tp"), F.sum("nq").alias("tq"))
    x = both.crossJoin(F.broadcast(t)).select((F.col("np") / F.col("tp")).alias("p"), (F.col("nq") / F.col("tq")).alias("q"))
    return x.agg(F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))).alias("kl"), (F.sum(F.abs(F.col("p") - F.col("q"))) * 0.5).alias("tvd"))


def conditional_divergence(p: DataFrame, q: DataFrame, row: str, col: str, symbols: list[str], alpha: float = 1.0) -> DataFrame:
    """cond_kl: divergence of next-symbol rows, weighted by the rows' mass in q; a dense grid of smoothed counts."""
    spark = p.sparkSession
    one = spark.range(1).select(F.array(*map(F.lit, symbols)).alias("s"))
    grid = one.select(F.explode("s").alias(row), "s").select(row, F.explode("s").alias(col))
    g = grid.join(p.select(row, col, F.col("n").alias("np")), [row, col], "left").join(q.select(row, col, F.col("n").alias("nq")), [row, col], "left")
    g = g.select(row, col, (F.coalesce("np", F.lit(0)) + alpha).alias("np"), (F.coalesce("nq", F.lit(0)) + alpha).alias("nq"))
    w, every = Window.partitionBy(row), Window.partitionBy(F.lit(0))
    g = g.select((F.col("np") / F.sum("np").over(w)).alias("p"), (F.col("nq") / F.sum("nq").over(w)).alias("q"), (F.sum("nq").over(w) / F.sum("nq").over(every)).alias("mass"))
    return g.agg(F.sum(F.col("mass") * F.col("p") * F.log2(F.col("p") / F.col("q"))).alias("cond_kl"))


def gate(df: DataFrame, checks: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """``keep``, each check as a boolean, and passed, their conjunction; a null check fails."""
    out = df.select(*(keep or []), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()])
    passed = F.lit(True)
    for k in checks:
        passed = passed & F.col(k)
    return out.withColumn("passed", passed)


def parity(rows: DataFrame, keys: list[str], p: str, q: str, h: str, g: str, over: float = 1e-2) -> DataFrame:
    """(keys, l1_mean, l1_frac, rel_max) of stored against fresh rows: distances of the distributions p and q, the share of them over
    ``over``, and the largest difference of the vectors h and g over the largest |g|."""
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    gap = F.array_max(F.zip_with(h, g, lambda x, y: F.abs(x - y)))
    rows = rows.select(*keys, apart(p, q).alias("l1"), gap.alias("gap"), F.array_max(F.transform(g, F.abs)).alias("most"))
    return rows.groupBy(*keys).agg(F.avg("l1").alias("l1_mean"), F.avg((F.col("l1") > over).cast("int")).alias("l1_frac"), (F.max("gap") / F.greatest(F.max("most"), F.lit(1e-6))).alias("rel_max"))


def training_sanity(curve: DataFrame, keys: list[str], order: str, loss: str, n: int = 20) -> DataFrame:
    """(keys, first, last, dropped): mean losses of the first and the last ``n`` steps, null for curves under 2 n steps."""
    rows = running(curve.withColumn("one", F.lit(1).cast("long")), keys, order, "one", "i")
    size = curve.groupBy(*keys).agg(F.count("*").alias("steps"))
    rows = rows.join(size, keys)
    long = F.col("steps") >= 2 * n
    out = rows.groupBy(*keys).agg(F.avg(F.when(long & (F.col("i") < n), F.col(loss))).alias("first"), F.avg(F.when(long & (F.col("i") >= F.col("steps") - n), F.col(loss))).alias("last"))
    return out.select(*keys, "first", "last", (F.col("last") < F.col("first")).alias("dropped"))


def qc_probe(rows: DataFrame, key: str, entropy: str, anchors: DataFrame, mean_off: float = 0.08, frac_off: float = 0.05, random_least: float = 1.9) -> DataFrame:
    """(key, n, mean, median, low, high, passed): entropies of a sample against its anchor (key, mean, low).

    low and high are the shares under 1.5 and over 1.9 bits.  A sample with an anchor passes within ``mean_off`` and ``frac_off`` of
    it, one without (random symbols) with a mean of ``random_least`` or more.
    """
    facts = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(entropy).alias("mean"), F.percentile(entropy, F.lit(0.5)).alias("median"),
        F.avg((F.col(entropy) < 1.5).cast("int")).alias("low"), F.avg((F.col(entropy) > 1.9).cast("int")).alias("high"),
    )
    j = facts.join(anchors.select(key, F.col("mean").alias("a_mean"), F.col("low").alias("a_low")), key, "left")
    near = (F.abs(F.col("mean") - F.col("a_mean")) <= mean_off) & (F.abs(F.col("low") - F.col("a_low")) <= frac_off)
    return j.select(key, "n", "mean", "median", "low", "high", F.when(F.col("a_mean").isNull(), F.col("mean") >= random_least).otherwise(near).alias("passed"))


def recompute_violations(df: DataFrame, got: str, want: str, tolerance: float) -> DataFrame:
    g, w = F.col(got), F.col(want)
    return df.where(~F.coalesce(F.abs(g - w) <= tolerance, g.isNull() & w.isNull()))


def weighted_median(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The median of each row of ``weights``, counts of the sorted ``values``; the mean of the middle two for even totals."""
    run = np.cumsum(weights, axis=1)
    n = run[:, -1:]
    low, high = ((run > m).argmax(axis=1) for m in ((n - 1) // 2, n // 2))
    return (values[low] + values[high]) / 2.0


def bootstrap_statistic(df: DataFrame, group: str, value: str, statistic: Callable, replicates: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """(group, n, lo, hi): percentile interval of ``statistic(values, weights)`` over resamples of all rows of a group.

    Rows are counted by value first, and a resample is a multinomial draw of these counts, which is the same law as drawing
    rows; a group's task holds one weight a distinct value and replicate.
    """
    kind = dict(df.dtypes)[group]

    def run(pdf):
        pdf = pdf.sort_values("__v")
        v, c = pdf["__v"].to_numpy(float), pdf["__c"].to_numpy(np.int64)
        rng = np.random.default_rng([seed, len(v), int(c.sum())])
        got = np.concatenate([statistic(v, rng.multinomial(c.sum(), c / c.sum(), k)) for k in _batches(replicates, len(v))])
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [int(c.sum())], "lo": [np.quantile(got, alpha / 2)], "hi": [np.quantile(got, 1 - alpha / 2)]})

    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    return counts.groupBy(group).applyInPandas(run, f"{group} {kind}, n long, lo double, hi double")


def _batches(replicates: int, width: int, most: int = 1 << 22) -> list[int]:
    """Replicates dealt over batches of at most ``most`` weights."""
    step = max(1, most // max(1, width))
    return [min(step, replicates - at) for at in range(0, replicates, step)]
