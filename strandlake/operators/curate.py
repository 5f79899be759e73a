"""Corpus curation: routing, sampling, quotas, packing, shards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_draw(key: Column, seed: int) -> Column:
    """A draw in [0, 1) that depends on key and seed only, and is plain integer arithmetic."""
    return ((key * 2654435761 + seed * 40503) % 4294967296 * 69069 % 4294967296) / 4294967296.0


def keep_probability(target: Column, estimate: Column, factor: float = 1.0) -> Column:
    return F.least(F.lit(1.0), target / F.greatest(estimate * factor, F.lit(1.0)))


def route(key: Column, held: Column, excluded: Column) -> Column:
    """Held out first (the exclusion list holds the held-out keys too), then excluded, else train."""
    return F.when(held, "hold").when(excluded, "excluded").otherwise("train")


def family_stats(df: DataFrame, family: str, length: Column) -> DataFrame:
    return df.groupBy(family).agg(F.count("*").alias("n_contigs"), F.sum(length).cast("long").alias("bp"))


def admissible(stats: DataFrame, low: int, high: int, need: int, name: str = "family", size: str = "bp", width: int | None = 6) -> DataFrame:
    """Families within [low, high]; if fewer than ``need``, the upper bound falls."""
    fits = F.col(size) >= low if width is None else (F.char_length(name) == width) & (F.col(size) >= low)
    flagged = stats.withColumn("__in", fits & (F.col(size) <= high))
    n = flagged.agg(F.sum(F.col("__in").cast("int")).alias("__n"))
    both = flagged.crossJoin(F.broadcast(n)).where(F.when(F.col("__n") >= need, F.col("__in")).otherwise(fits))
    return both.drop("__in", "__n")


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own columns that no column of ``df`` has, in any case."""
    taken, lead = {c.lower() for c in df.columns}, "__"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def running(
    df: DataFrame, keys: list[str], order: str, value: str | list[str], out: str | list[str], more: list[str] | None = None,
    blocks: int = 256, through: bool = False,
) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows before in ``keys``, by the numeric ``order`` (then ``more``).

    Both may be lists, summed in one pass; with ``through`` a row's own value counts too.  Two levels: rows are dealt over
    blocks at quantiles of the order, sums of blocks become offsets, and a window runs in one block only, so a key with most
    of the rows is many tasks.  The operator's own columns take names that ``df`` doesn't have; an ``out`` that it has is an
    error.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (list(value), list(out))
    clash = {c.lower() for c in df.columns} & {o.lower() for o in outs}
    if clash:
        raise ValueError(f"columns that are there already: {sorted(clash)}")
    block, one, kb = own_names(df, "block", "one", "kb")
    offs = own_names(df, *[f"off{i}" for i in range(len(values))])
    held = own_names(df, *[f"k{i}" for i in range(max(1, len(keys)))])
    cuts = sorted(set(df.approxQuantile(order, [i / blocks for i in range(1, blocks)], 0.25 / blocks))) or [0.0]
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if len(cuts) < 16 else _bisect(F.col(order), cuts)
    rows = df.withColumn(block, F.coalesce(at.cast("int"), F.lit(-1)))
    by = keys or [one]
    rows = rows if keys else rows.withColumn(one, F.lit(0))
    rows = rows.repartition(*by, block)
    before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*by, block).agg(*[F.sum(v).alias(o) for v, o in zip(values, offs)])
    per = per.select(*[F.col(k).alias(h) for k, h in zip(by, held)], F.col(block).alias(kb), *[F.coalesce(F.sum(o).over(before), F.lit(0)).alias(o) for o in offs])
    inner = Window.partitionBy(*by, block).orderBy(order, *(more or [])).rowsBetween(Window.unboundedPreceding, 0 if through else -1)
    rows = rows.withColumns({o: F.coalesce(F.sum(v).over(inner), F.lit(0)) for v, o in zip(values, outs)})
    same = F.col(block) == F.col(kb)
    for k, h in zip(by, held):
        same = same & F.col(k).eqNullSafe(F.col(h))
    return rows.join(per, same).select(*df.columns, *[(F.col(f) + F.col(o)).alias(o) for f, o in zip(offs, outs)])


def _bisect(c: Column, cuts: list[float]) -> Column:
    """How many of the sorted ``cuts`` lie under ``c``, by halves."""
    if not cuts:
        return F.lit(0)
    m = len(cuts) // 2
    return F.when(c <= cuts[m], _bisect(c, cuts[:m])).otherwise(_bisect(c, cuts[m + 1 :]) + m + 1)


def evenly_spaced(df: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """Rows at ``cap`` evenly spaced ranks of each key, all if there are no more; ranks, not lists of a key's rows."""
    rows = running(df.withColumn("__1", F.lit(1).cast("long")), keys, order, "__1", "__i")
    n = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    rows = rows.join(n, keys)
    at = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda j: F.floor(j * (F.col("__n") - 1) / max(cap - 1, 1)))
    return rows.where((F.col("__n") <= cap) | F.array_contains(at, F.col("__i"))).select(*df.columns)


def candidate_validity(df: DataFrame, keys: list[str], seq: str, least: int = 2) -> DataFrame:
    """(keys, invalid, valid, enough): candidates with a symbol outside the alphabet, the others, and whether those are enough."""
    bad = F.regexp_like(seq, F.lit("[^ACGTN]"))
    return df.groupBy(*keys).agg(F.count_if(bad).alias("invalid"), F.count_if(~bad).alias("valid"), (F.count_if(~bad) >= least).alias("enough"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; a struct minimum, so hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    lead = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.min(F.struct(*lead)).alias("__m"))
    return best.select(*[F.col(k) if k in keys else F.col(f"__m.{k}") for k in df.columns])


def longest(df: DataFrame, group: str, length: Column, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(length.desc(), order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def anchors(length: Column, gamma: int, min_ctx: int) -> Column:
    """All positions with enough context and gamma tokens to come; the lower bound falls to 0 if nothing is left."""
    hi = length - (gamma + 1)
    lo = F.when(hi < max(min_ctx - 1, 0), 0).otherwise(max(min_ctx - 1, 0))
    return F.when(hi < 0, F.array().cast("array<int>")).otherwise(F.sequence(lo, F.greatest(hi, lo)))


def sample_anchors(df: DataFrame, key: str, length: Column, gamma: int, min_ctx: int, n: int, seed: int) -> DataFrame:
    """(key, anchor): up to n of each row's anchors, by hash order; the array of a row bounds the work."""
    draw = lambda a: F.struct(hash_draw(F.col(key) * 1_000_003 + a, seed).alias("h"), a.alias("a"))
    picked = F.slice(F.array_sort(F.transform(anchors(length, gamma, min_ctx), draw)), 1, n)
    return df.select(key, F.explode(F.transform(picked, lambda s: s["a"])).alias("anchor"))


def evenly(values: Column, cap: int) -> Column:
    """``cap`` elements at evenly spaced indices, all if there are no more."""
    n = F.size(values)
    at = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.get(values, F.floor(i * (n - 1) / max(cap - 1, 1)).cast("int")))
    return F.when(n <= cap, values).otherwise(at)


def held_out_window(seq: Column, held: float = 0.1, window: int = 2048) -> tuple[Column, Column, Column]:
    """(end-aligned window, offset of the held-out part in it, split of the whole)."""
    n = F.char_length(seq)
    split = F.floor(n * (F.lit(1.0) - F.lit(held))).cast("int")
    w = F.least(n, F.lit(window))
    return F.right(seq, w), F.greatest(F.lit(0), split - (n - w)), split


# quotas


def largest_remainder(df: DataFrame, total: Column, size: str, keys: list[str], order: str, out: str = "alloc") -> DataFrame:
    """Whole shares of ``total`` in proportion to ``size``; ties by order; without any size, equal shares."""
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    s, n = F.sum(size).over(part), F.count("*").over(part)
    rows = df.withColumns({"__raw": F.when(s > 0, total * F.col(size) / s).otherwise(F.lit(None)), "__eq": F.floor(total / n), "__n": n})
    rows = rows.withColumn("__floor", F.coalesce(F.floor("__raw"), F.col("__eq")).cast("long"))
    rows = rows.withColumn("__rem", total - F.sum("__floor").over(part))
    by = part.orderBy(F.desc(F.coalesce(F.round(F.col("__raw") - F.col("__floor"), 9), F.lit(0.0))), order)
    plus = (F.row_number().over(by) <= F.col("__rem")).cast("long")
    return rows.withColumn(out, F.col("__floor") + plus).drop("__raw", "__eq", "__floor", "__rem", "__n")


def water_fill(df: DataFrame, available: str, weight: str, order: str, cap: float) -> DataFrame:
    """``df`` with raw, alloc and capped: shares of all that is available by weight, none over cap times its own.

    Closed form: in order of cap over weight, prefix sums of caps and suffix sums of weights give the level at which the
    first source that isn't full stands.
    """
    if cap < 1:
        raise ValueError("a cap under one pass cannot be filled")
    every = Window.partitionBy(F.lit(0))
    rows = df.where(F.col(available) > 0).withColumn("__w", F.greatest(F.col(weight).cast("double"), F.lit(0.0)))
    ok = F.when(F.sum("__w").over(every) <= 0, F.raise_error(F.lit("no weight on any available source")).cast("double")).otherwise(F.sum("__w").over(every))
    rows = rows.withColumns({"__w": F.col("__w") / ok, "__cap": F.col(available) * float(cap), "__t": F.sum(available).over(every)})
    by_last = every.orderBy(F.when(F.col("__w") > 0, F.col("__cap") / F.col("__w")).otherwise(F.lit(float("inf"))), order)
    rows = rows.withColumns({
        "__before": F.coalesce(F.sum(F.when(F.col("__w") > 0, F.col("__cap")).otherwise(0.0)).over(by_last.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "__rest": F.sum("__w").over(by_last.rowsBetween(0, Window.unboundedFollowing)),
    })
    e = F.try_divide(F.col("__t") - F.col("__before"), F.col("__rest"))
    fits = (F.col("__w") > 0) & (e <= F.col("__cap") / F.col("__w") + 1e-12)
    first = F.min(F.when(fits, F.struct((F.col("__cap") / F.col("__w")).alias("c"), F.col(order), e.alias("e")))).over(every)["e"]
    rows = rows.withColumn("raw", F.least(F.col("__cap"), F.col("__w") * first))
    rows = rows.withColumn("capped", F.col("raw") >= F.col("__cap") - 0.5).withColumn("__raw2", F.greatest("raw", F.lit(1e-9)))
    out = largest_remainder(rows, F.col("__t"), "__raw2", [], order)
    return out.select(*df.columns, "raw", "alloc", "capped")


def epoch_windows(plan: DataFrame, n: str, take: str, key: list[str], seed: int) -> DataFrame:
    """(key, window, visit): ``take`` visits of n windows, whole passes first, then a hash-ordered rest."""
    ids = F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    full, rest = F.floor(F.col(take) / F.col(n)), F.col(take) % F.col(n)
    order = F.array_sort(F.transform(ids, lambda i: F.struct(F.xxhash64(F.lit(seed), *[F.col(k) for k in key], i).alias("h"), i.alias("i"))))
    passes = F.flatten(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(full, F.lit(1))), lambda p: F.when(p <= full, ids).otherwise(F.array().cast("array<bigint>"))))
    extra = F.transform(F.slice(order, F.lit(1), F.greatest(rest, F.lit(0)).cast("int")), lambda s: s["i"])
    return plan.where((F.col(take) > 0) & (F.col(n) > 0)).select(*key, F.posexplode(F.concat(passes, extra)).alias("visit", "window"))


def subsample(df: DataFrame, group: list[str], length: Column, order: list[Column], cap: int) -> DataFrame:
    """Rows in hash order (a draw, then what breaks ties) until ``cap`` is reached, the one that reaches it included."""
    rows = df.withColumns({"__n": length, **{f"__o{i}": c for i, c in enumerate(order)}})
    return running(rows, group, "__o0", "__n", "__before", [f"__o{i}" for i in range(1, len(order))]).where(F.col("__before") < cap).select(*df.columns)


# packing and shards


def pack(df: DataFrame, group: list[str], order: str, seq: str = "seq", limit: int = 50_000, sep: str = "N" * 16) -> DataFrame:
    """(group, chunk, n, text): short records joined in order into chunks of at most ``limit``; longer ones stand alone.

    What a chunk holds depends on all before it in its group, so one group is one ordered stream: group by (source, file),
    as files are written; it passes through in Arrow batches, and memory holds one chunk.
    """
    g = df.select(*group, order, seq).where(F.char_length(seq) > 0)
    names = [*group]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*group).schema) + ", chunk int, n int, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, held, size = None, 0, [], 0
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                k, s = row[: len(names)], row[-1]
                if k != key:
                    if held:
                        out.append((*key, chunk, len(held), sep.join(held)))
                    key, chunk, held, size = k, 0, [], 0
                add = len(s) + (len(sep) if held else 0)
                if held and size + add > limit:
                    out.append((*key, chunk, len(held), sep.join(held)))
                    chunk, held, size = chunk + 1, [s], len(s)
                else:
                    held.append(s)
                    size += add
            yield pd.DataFrame(out, columns=[*names, "chunk", "n", "text"])
        if held:
            yield pd.DataFrame([(*key, chunk, len(held), sep.join(held))], columns=[*names, "chunk", "n", "text"])

    return g.repartition(*group).sortWithinPartitions(*group, order).mapInPandas(run, schema)


def stitched_windows(df: DataFrame, group: list[str], order: str, seq: str = "seq", window: int = 4096, sep: str = "N" * 16) -> DataFrame:
    """(group, i, text): fixed windows cut from the stream of sequences; the separator is left out when nothing waits.

    A group is one ordered stream: group by (source, file), as for ``pack``.
    """
    names = [*group]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*group).schema) + ", i int, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, i, held = None, 0, ""
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                k, s = row[: len(names)], row[-1] or ""
                if k != key:
                    key, i, held = k, 0, ""
                held = held + sep + s if held else s
                at = 0
                while len(held) - at >= window:
                    out.append((*k, i, held[at : at + window]))
                    i, at = i + 1, at + window
                held = held[at:]
            yield pd.DataFrame(out, columns=[*names, "i", "text"])

    rows = df.select(*group, order, seq)
    return rows.repartition(*group).sortWithinPartitions(*group, order).mapInPandas(run, schema)


def shard_layout(df: DataFrame, group: list[str], order: str, n: str, shard: int) -> DataFrame:
    """(group, shard_idx, first, n_pos) spans of each row: positions are cut into shards of a fixed count."""
    rows = running(df.where(F.col(n) > 0), group, order, n, "__start").withColumn("__end", F.col("__start") + F.col(n))
    rows = rows.withColumn("shard_idx", F.explode(F.sequence(F.floor(F.col("__start") / shard), F.floor((F.col("__end") - 1) / shard))))
    lo, hi = F.greatest(F.col("__start"), F.col("shard_idx") * shard), F.least(F.col("__end"), (F.col("shard_idx") + 1) * shard)
    return rows.select(*group, order, "shard_idx", (lo - F.col("__start")).alias("first"), (hi - lo).alias("n_pos"))


def quota_stop(df: DataFrame, group: list[str], order: str, n: str, quota: int) -> DataFrame:
    return running(df, group, order, n, "done").where(F.col("done") < quota)


def complete_shards(layout: DataFrame, group: list[str], shard: int, wanted: Column | None = None) -> DataFrame:
    """(group, shard_idx, n_rows) of the shards that are full, of the ``wanted`` groups only."""
    rows = layout if wanted is None else layout.where(wanted)
    per = rows.groupBy(*group, "shard_idx").agg(F.sum("n_pos").alias("__n"), F.count("*").alias("n_rows"))
    return per.where(F.col("__n") == shard).drop("__n")


def shard_checksums(layout: DataFrame, texts: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """(group, shard_idx, checksum): the digest of a shard's text, the parts of its rows in order.

    A shard holds a fixed count of positions, which bounds the list.
    """
    part = F.substring(F.col(text), (F.col("first") + 1).cast("int"), F.col("n_pos").cast("int"))
    rows = layout.join(texts.select(order, text), order).withColumn("__p", F.struct(order, part.alias("t")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("__p")), lambda x: x["t"]), "")
    return rows.groupBy(*group, "shard_idx").agg(F.md5(whole).alias("checksum"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """{**old, **new} by key: new values win, old keys stay."""
    cols = [c for c in old.columns if c != key]
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    return both.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in cols])


def crossed(n: Column, step: Column, every: int) -> Column:
    """A counter that went from n - step to n passed a multiple of ``every``."""
    return F.floor(n / every) > F.floor((n - step) / every)
