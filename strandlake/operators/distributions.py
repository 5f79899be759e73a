"""Probability rows as arrays of doubles: transforms, packing, entropy, acceptance.  Index ties go to the lower index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = "array<double>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, though body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def ranked(a: Column) -> Column:
    """Structs (v, i) by value descending, then index."""
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))), lambda s: F.struct((-s["v"]).alias("v"), s["i"].alias("i")))


def argmax(a: Column) -> Column:
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def softmax(a: Column, temperature: float = 1.0) -> Column:
    def scaled(a: Column) -> Column:
        return let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp((x - top) / temperature)))

    return let(let(a, scaled), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def keep_top(p: Column, k: int) -> Column:
    """The k largest entries renormalised, others 0; an all-zero row becomes 1/k on the k lowest indices."""
    def cut(p: Column) -> Column:
        def spread(top: Column) -> Column:
            mass = F.aggregate(top, F.lit(0.0), lambda s, x: s + x["v"])
            both = F.struct(F.transform(top, lambda s: s["i"]).alias("i"), mass.alias("m"))
            return let(both, lambda b: F.transform(p, lambda x, i: F.when(~F.array_contains(b["i"], i), 0.0).when(b["m"] > 0, x / b["m"]).otherwise(1.0 / k)))

        return let(F.slice(ranked(p), 1, k), spread)

    return let(p, cut)


def transformed(logits: Column, temperature: float = 1.0, k: int = 4) -> Column:
    """Softmax at a temperature, then the top k; a temperature of 0 or less is the one-hot argmax."""
    if temperature <= 0:
        return let(argmax(logits), lambda at: F.transform(logits, lambda x, i: F.when(i == at, 1.0).otherwise(0.0)))
    return keep_top(softmax(logits, temperature), k)


def normalised(p: Column) -> Column:
    """Negative entries are 0; a row without mass is uniform."""
    def spread(up: Column) -> Column:
        return let(total(up), lambda s: F.transform(up, lambda x: F.when((s > 0) & (s < float("inf")), x / s).otherwise(F.lit(1.0) / F.size(up))))

    return let(F.transform(p, lambda x: F.greatest(x, F.lit(0.0))), spread)


def entropy_bits(p: Column) -> Column:
    clipped = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)))
    return F.aggregate(clipped, F.lit(0.0), lambda s, x: s - x * F.log2(x))


def packed(p: Column, k: int = 8) -> tuple[Column, Column, Column]:
    """(indices, values, residual mass) of the k largest."""
    top = F.slice(ranked(p), 1, k)
    return F.transform(top, lambda s: s["i"]), F.transform(top, lambda s: s["v"]), F.lit(1.0) - F.aggregate(top, F.lit(0.0), lambda s, x: s + x["v"])


def unpacked(idx: Column, val: Column, vocab: int) -> Column:
    """The dense row of a packed one; residual mass is not spread."""
    at = lambda m: F.transform(F.sequence(F.lit(0), F.lit(vocab - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))
    return let(F.map_from_arrays(idx, val), at)


def top_gap(a: Column) -> Column:
    return let(ranked(a), lambda r: F.element_at(r, 1)["v"] - F.element_at(r, 2)["v"])


def quantised(h: Column) -> tuple[Column, Column]:
    """(int8 values rounded half to even, scale) by the largest magnitude."""
    scale = F.greatest(F.array_max(F.transform(h, F.abs)), F.lit(1e-8))

    def rounded(s: Column) -> Column:
        return F.transform(h, lambda x: F.greatest(F.least(F.bround(x / s * 127.0), F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))

    return let(scale, rounded), scale


def dequantised(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x * (scale / 127.0))


def accept_probability(p: Column, q: Column) -> Column:
    """min(1, p / q); q = 0 accepts what has p > 0; a ratio that isn't finite is 0."""
    r = F.try_divide(p, q)
    return F.when(q <= 0, F.when(p > 0, 1.0).otherwise(0.0)).when(F.isnan(r) | (F.abs(r) == float("inf")), 0.0).otherwise(F.least(F.lit(1.0), r))


def residual(p: Column, q: Column) -> Column:
    """Normalised positive part of p - q; p itself if there is none."""
    def spread(left: Column) -> Column:
        return let(total(left), lambda s: F.when(s > 0, F.transform(left, lambda x: x / s)).otherwise(p))

    return let(F.zip_with(p, q, lambda x, y: F.greatest(x - y, F.lit(0.0))), spread)


def acceptance(p: Column, q: Column) -> Column:
    return F.lit(1.0) - F.lit(0.5) * total(F.zip_with(p, q, lambda x, y: F.abs(x - y)))


def lookup_mixture(symbol: Column, weight: float = 0.9) -> Column:
    """Five probabilities in the order ACGTN: weight on the symbol, the rest spread; uniform without a symbol."""
    rest = (1.0 - weight) / 5
    return F.when(symbol.isNull(), F.array(*[F.lit(0.2)] * 5)).otherwise(F.array(*[F.when(symbol == b, weight + rest).otherwise(rest) for b in "ACGTN"]))


def losses(p: Column, t: Column, target: Column, confidence: Column, weights: tuple[float, float, float] = (0.1, 0.9, 1.0)) -> dict[str, Column]:
    """Cross entropy, total variation, confidence loss and their weighted sum, of one row."""
    ce = -F.ln(F.greatest(F.get(p, target), F.lit(1e-12)))
    tv = F.lit(0.5) * total(F.zip_with(p, t, lambda x, y: F.abs(x - y)))
    goal = F.lit(1.0) - tv
    c = F.least(F.greatest(confidence, F.lit(1e-6)), F.lit(1 - 1e-6))
    bce = -(goal * F.ln(c) + (F.lit(1.0) - goal) * F.ln(F.lit(1.0) - c))
    return {"ce": ce, "tv": tv, "bce": bce, "loss": weights[0] * ce + weights[1] * tv + weights[2] * bce}


def histogram(df: DataFrame, value: str, keys: list[str], width: float = 0.1, high: float = 2.0) -> DataFrame:
    """(keys, bin, n): bins closed on the left, the last on both sides; values outside are in no bin.

    Edges are computed as index times width, as they are when compared, so that values on an edge fall where they should.
    """
    bins = round(high / width)
    edges = F.array(*[F.lit(i * width) for i in range(bins + 1)])
    at = F.least(F.size(F.filter(edges, lambda e: e <= F.col(value))) - 1, F.lit(bins - 1))
    rows = df.where((F.col(value) >= 0) & (F.col(value) <= bins * width))
    return rows.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def histograms(df: DataFrame, value: str, keys: list[str], width: float = 0.1, high: float = 2.0) -> DataFrame:
    """(keys, edges, counts, n, mean): one histogram a key in a row of its own, with the mean of the values in it."""
    bins = round(high / width)
    edges = F.array(*[F.lit(i * width) for i in range(bins + 1)])
    at = F.least(F.size(F.filter(edges, lambda e: e <= F.col(value))) - 1, F.lit(bins - 1))
    rows = df.where((F.col(value) >= 0) & (F.col(value) <= bins * width)).withColumn("__at", at)
    counts = F.array(*[F.count_if(F.col("__at") == i) for i in range(bins)])
    return rows.groupBy(*keys).agg(counts.alias("counts"), F.count("*").alias("n"), F.avg(value).alias("mean")).select(*keys, edges.alias("edges"), "counts", "n", "mean")


def merged_histograms(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, edges, counts, n, sum) of histogram rows: counts add up bin by bin; parts with other edges are an error."""
    one = keys or []
    flat = parts.select(*one, "edges", "n", "mean", F.posexplode("counts").alias("__i", "__c"))
    rows = flat.groupBy(*one, "__i").agg(F.sum("__c").alias("c"), F.min("edges").alias("low"), F.max("edges").alias("edges"), F.sum("n").alias("n"), F.sum(F.coalesce("mean", F.lit(0.0)) * F.col("n")).alias("s"))
    same = F.max("edges") == F.min("low")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("__i", "c"))), lambda x: x["c"])  # as long as there are bins
    edges = F.when(same, F.max("edges")).otherwise(F.raise_error(F.lit("histograms with other edges")).cast("array<double>"))
    return rows.groupBy(*one).agg(edges.alias("edges"), whole.alias("counts"), F.max("n").alias("n"), F.max("s").alias("sum"))


def finalised(merged: DataFrame) -> DataFrame:
    """``merged`` with the mean in place of the sum; no values, no mean."""
    return merged.withColumn("mean", F.try_divide(F.col("sum"), F.col("n").cast("double"))).drop("sum")


def running_product(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.product(value).over(w))


def predicted_length(df: DataFrame, keys: list[str], order: str, rate: str) -> DataFrame:
    """(keys, tau): 1 plus the sum over positions of the product of the rates up to it."""
    rows = running_product(df, keys, order, rate, "__p")
    return rows.groupBy(*keys).agg((F.lit(1.0) + F.sum("__p")).alias("tau"))
