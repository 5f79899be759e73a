"""Analytics of draft-and-verify rounds: a row a round, k accepted tokens of at most gamma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_length(mask: Column) -> Column:
    """How many leading elements of a boolean array are true."""
    first = F.array_position(mask, False)
    return F.when(first == 0, F.size(mask)).otherwise(first - 1).cast("int")


def mask_of(k: Column, gamma: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(gamma - 1)), lambda i: i < k)


def run_metrics(rounds: DataFrame, keys: list[str], tokens: str, seconds: str, step_ms: float = 19.413, block_ms: float = 21.269) -> DataFrame:
    """n_rounds, mean_k, mean_tau (mean_k + 1), tok_s and the projected speed-up of each run."""
    tau = F.avg("k") + F.lit(1.0)
    return rounds.groupBy(*keys).agg(
        F.count("*").alias("n_rounds"), F.avg("k").alias("mean_k"), tau.alias("mean_tau"),
        F.try_divide(F.sum(tokens).cast("double"), F.sum(seconds)).alias("tok_s"), (tau * step_ms / block_ms).alias("proj_speedup"),
    )


def position_rates(rounds: DataFrame, gamma: int, keys: list[str]) -> DataFrame:
    """(keys, pos, rate, cond_rate): share of rounds that accept the position, and of those that reach it.

    Counts by k come first, so the grid of positions is joined to gamma + 1 rows a key and not to the rounds.
    """
    by_k = rounds.groupBy(*keys, "k").agg(F.count("*").alias("n"))
    grid = by_k.select(*keys, "k", "n", F.explode(F.sequence(F.lit(0), F.lit(gamma - 1))).alias("pos"))
    over, reach = F.sum(F.when(F.col("k") > F.col("pos"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("k") >= F.col("pos"), F.col("n")).otherwise(0))
    return grid.groupBy(*keys, "pos").agg((over / F.sum("n")).alias("rate"), F.try_divide(over.cast("double"), reach.cast("double")).alias("cond_rate"))


def first_disagreement(a: Column, b: Column) -> Column:
    """Index of the first differing element; the shorter length if only lengths differ; null if equal."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & (F.get(a, i) != F.get(b, i)))
    return F.when(F.size(differs) > 0, F.element_at(differs, 1)).when(F.size(a) != F.size(b), n)


def classify_disagreement(spec: Column, native: Column, tie: float = 1e-3) -> Column:
    """What explains two rows of scores that choose different tokens: 'tie', 'path' or 'nontie'."""
    from .distributions import top_gap

    gap = F.least(top_gap(spec), top_gap(native))
    moved = F.array_max(F.zip_with(spec, native, lambda x, y: F.abs(x - y)))
    return F.when(gap < tie, "tie").when(moved + 1e-12 >= gap, "path").otherwise("nontie")


def block_metrics(rows: DataFrame, pack: str = "pack", agree: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(pack, n_blocks, tau) by pack and over all (null pack) from (pack, pos, alpha): means, then 1 + sum of products.

    ``agree`` adds, under each name, the share of positions at which two columns are equal (the draft's first choice and the
    teacher's, say), null where no position has both.
    """
    from .distributions import predicted_length

    agree = agree or {}
    same = [F.sum((F.col(a) == F.col(b)).cast("long")).alias(n) for n, (a, b) in agree.items()]
    seen = [F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"{n}_of") for n, (a, b) in agree.items()]
    facts = [F.avg("alpha").alias("alpha"), F.count("*").alias("n"), *same, *seen]
    names = ["pos", "alpha", "n", *agree, *[f"{n}_of" for n in agree]]
    by_pack = rows.groupBy(pack, "pos").agg(*facts).select(pack, *names)
    every = rows.groupBy("pos").agg(*facts).select(F.lit(None).cast(rows.schema[pack].dataType).alias(pack), *names)
    both = by_pack.unionByName(every)
    rates = [F.try_divide(F.sum(n), F.sum(f"{n}_of").cast("double")).alias(n) for n in agree]
    sizes = both.groupBy(pack).agg(F.max("n").alias("n_blocks"), *rates)
    tau = predicted_length(both, [pack], "pos", "alpha")
    return sizes.alias("s").join(tau.alias("t"), F.col(f"s.{pack}").eqNullSafe(F.col(f"t.{pack}"))).select(F.col(f"s.{pack}"), "n_blocks", "tau", *agree)


def confidence_by_position(rounds: DataFrame, keys: list[str], conf: str) -> DataFrame:
    """(keys, pos, n, mean) of the drafts' confidences; rounds are of different lengths, a position counts where it was drafted."""
    rows = rounds.select(*keys, F.posexplode(conf).alias("pos", "v"))
    return rows.groupBy(*keys, "pos").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


def numerical_evidence(actual: Column, reference: Column, tie: float = 1e-3, k: int = 4) -> dict[str, Column]:
    """What two rows of scores say of one position: flip (another first choice), both gaps, near_tie, tvd of the ``k`` best, delta."""
    from .distributions import acceptance, argmax, top_gap, transformed

    a, b = top_gap(actual), top_gap(reference)
    return {
        "flip": argmax(actual) != argmax(reference), "actual_gap": a, "reference_gap": b, "near_tie": F.least(a, b) < tie,
        "tvd": F.lit(1.0) - acceptance(transformed(actual, 1.0, k), transformed(reference, 1.0, k)),
        "delta": F.array_max(F.zip_with(actual, reference, lambda x, y: F.abs(x - y))),
    }


def classified(cases: DataFrame, keys: list[str], invariants: Column) -> DataFrame:
    """(keys, flips, near_tie_flips, max_tvd, mean_tvd, max_delta, status) over the positions of ``numerical_evidence``.

    Flips at near ties are differences of arithmetic, others have to be looked at, as have broken invariants: status is
    passed without any flip, passed_with_differences with near ties alone, else needs_review.
    """
    flips, near = F.count_if("flip"), F.count_if(F.col("flip") & F.col("near_tie"))
    ok = (flips == near) & F.coalesce(F.bool_and(invariants), F.lit(False))
    status = F.when(ok & (flips == 0), "passed").when(ok, "passed_with_differences").otherwise("needs_review")
    return cases.groupBy(*keys).agg(
        flips.alias("flips"), near.alias("near_tie_flips"), F.max("tvd").alias("max_tvd"), F.avg("tvd").alias("mean_tvd"), F.max("delta").alias("max_delta"), status.alias("status")
    )


def tvd_upper_ok(point: Column, high: Column, margin: float) -> Column:
    """The interval's upper end lies under the margin; null or infinite ends fail."""
    from .stats import finite

    return F.coalesce(finite(point) & finite(high) & (high < margin), F.lit(False))


def block_id(pos: Column, anchor: Column, mask: int) -> Column:
    """A block's input at a position: the anchor's token, then masks."""
    return F.when(pos == 0, anchor).otherwise(F.lit(mask)).cast("int")


def position_weight(pos: Column, gamma: float) -> Column:
    return F.exp(-pos / F.lit(gamma))


def hours(positions: Column, per_second: float = 3000.0) -> Column:
    return positions / F.lit(per_second * 3600)
