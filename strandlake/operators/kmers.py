"""k-mers and transition tables.

``windows`` cuts a sequence into pieces in one linear scan, gives each piece the start of the next one, and cuts windows
inside blocks of a piece, so the cost is linear in the length of a sequence; the counts are partial aggregates before any
shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast
from . import codes

ALPHABET = "ACGTN"
#: Symbols of a piece of a sequence, and of a block of windows in it.
PIECE, BLOCK = 4096, 128
#: Keys whose k-mers are taken as bitmaps.
KEYS = 256


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` dealt over the cluster by hash: a few large files are few splits, and what follows makes many rows of each.

    How many splits there are is not asked: with adaptive plans that would run all that comes before.
    """
    return df.repartition(*by)


def pieces(df: DataFrame, overlap: int, keep: list[str], seq: str = "seq") -> DataFrame:
    """``keep``, __at (from 0) and __p: pieces of each sequence with ``overlap`` symbols of what follows."""
    size = max(PIECE, overlap)
    rows = df.select(*keep, F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("__c"))
    more = F.transform("__c", lambda c, i: F.concat(c, F.left(F.coalesce(F.get("__c", i + 1), F.lit("")), F.lit(overlap))))
    rows = rows.select(*keep, F.posexplode(more).alias("__at", "__p"))
    return spread(rows.withColumn("__at", F.col("__at").cast("long") * size), [*keep, "__at", "__p"])


def windows(df: DataFrame, k: int, keep: list[str], seq: str = "seq", pos: bool = False) -> DataFrame:
    """``keep`` plus kmer (and pos, from 0) for every window of k symbols; sequences shorter than k give none."""
    rows = pieces(df, k - 1, keep, seq)
    n = F.char_length("__p")
    rows = rows.where(n >= k).select(*keep, "__at", "__p", F.explode(F.sequence(F.lit(0), n - k, F.lit(BLOCK))).alias("__o"))
    rows = rows.select(*keep, (F.col("__at") + F.col("__o")).alias("__o"), F.substring("__p", F.col("__o") + 1, F.lit(BLOCK + k - 1)).alias("__b"))
    at = F.explode(F.sequence(F.lit(0), F.char_length("__b") - k)).alias("__i")
    rows = rows.select(*keep, "__o", "__b", at)
    cols = [F.substring("__b", F.col("__i") + 1, F.lit(k)).alias("kmer")]
    return rows.select(*keep, *cols, *([(F.col("__o") + F.col("__i")).cast("long").alias("pos")] if pos else []))


def rolling(df: DataFrame, width: int, keep: list[str], seq: str = "seq") -> DataFrame:
    """(keep, pos, last): the ``width`` symbols up to and including each position, fewer at the start of a sequence."""
    padded = df.select(*keep, F.concat(F.lit("^" * (width - 1)), F.col(seq)).alias("seq"))
    return windows(padded, width, keep, pos=True).select(*keep, "pos", F.translate("kmer", "^", "").alias("last"))


def counts(df: DataFrame, k: int, keys: list[str], seq: str = "seq", plain: bool = True) -> DataFrame:
    """(keys, kmer, n); ``plain`` leaves out windows with anything but ACGT, else symbols outside ACGTN are an error.

    Short k-mers are counted in vectors, in one scan; long ones as rows.
    """
    if (4 if plain else 5) ** k <= codes.VECTOR:
        return codes.counts(df, k, keys, seq, plain)
    rows = windows(df, k, keys, seq)
    rows = rows.where(F.regexp_like("kmer", F.lit("^[ACGT]+$"))) if plain else rows
    return rows.groupBy(*keys, "kmer").agg(F.count("*").alias("n"))


def entropy(df: DataFrame, k: int, keys: list[str], seq: str = "seq") -> DataFrame:
    """(keys, entropy) in bits of all windows; sequences without a window have none."""
    c = counts(df, k, keys, seq, plain=False)
    total = c.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(*keys, (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def by_sequence(df: DataFrame, key: str, alone: Callable[[DataFrame], DataFrame], pooled: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``alone`` of the rows whose key no other row has, which need no exchange, and ``pooled`` of the others."""
    again = df.groupBy(key).agg(F.count("*").alias("__n")).where((F.col("__n") > 1) & F.col(key).isNotNull()).select(key)
    if again.isEmpty():
        return alone(df)
    again = broadcast(again)
    return alone(df.join(again, key, "left_anti")).unionByName(pooled(df.join(again, key, "left_semi")))


def unique_rate(df: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """(key, rate) a row: different windows of its key over all of them, 1.0 without a window or a key.

    A sequence's windows are told apart inside its Arrow batch; only sequences that share a key are exchanged.
    """

    def work(c: np.ndarray, _: dict) -> list[np.ndarray]:
        return [np.array([x], np.int64) for x in (codes.distinct(c, k), len(c) - k + 1)]

    def alone(rows: DataFrame) -> DataFrame:
        rate = F.when((F.col("__n") > 0) & F.col(key).isNotNull(), F.col("__m") / F.col("__n")).otherwise(1.0)
        return codes.each(rows, [key], seq, work, "__m long, __n long").select(key, rate.alias("rate"))

    def pooled(rows: DataFrame) -> DataFrame:
        w = windows(rows, k, [key], seq).groupBy(key).agg((F.count_distinct("kmer") / F.count("*")).alias("rate"))
        return rows.select(key).join(w, key, "left").select(key, F.coalesce("rate", F.lit(1.0)).alias("rate"))

    return by_sequence(df, key, alone, pooled)


def span_features(df: DataFrame, entropy_k: int, unique_k: int, key: str, seq: str = "seq") -> DataFrame:
    """(all columns of ``df`` but the sequence, entropy, unique) a row: bits of the windows of its key, null without one, and
    the rate of different ones as in ``unique_rate``, in one scan of each sequence."""
    keep = [c for c in df.columns if c != seq]

    def work(c: np.ndarray, _: dict) -> list[np.ndarray]:
        n = np.unique(np.concatenate([x for _, x, _ in codes.kmers(codes.clean(c), entropy_k)] or [c[:0]]), return_counts=True)[1]
        return [*[np.array([x], np.int64) for x in (n.sum(), codes.distinct(c, unique_k), len(c) - unique_k + 1)], np.array([(n * np.log2(n)).sum()])]

    def alone(rows: DataFrame) -> DataFrame:
        got = codes.each(rows, keep, seq, work, "__t long, __m long, __n long, __s double")
        known = F.col(key).isNotNull()
        bits = F.when((F.col("__t") > 0) & known, F.log2("__t") - F.col("__s") / F.col("__t"))
        rate = F.when((F.col("__n") > 0) & known, F.col("__m") / F.col("__n")).otherwise(1.0)
        return got.select(*keep, bits.alias("entropy"), rate.alias("unique"))

    def pooled(rows: DataFrame) -> DataFrame:
        uni = windows(rows, unique_k, [key], seq).groupBy(key).agg((F.count_distinct("kmer") / F.count("*")).alias("unique"))
        rows = rows.select(*keep).join(entropy(rows, entropy_k, [key], seq), key, "left").join(uni, key, "left")
        return rows.select(*keep, "entropy", F.coalesce("unique", F.lit(1.0)).alias("unique"))

    return by_sequence(df, key, alone, pooled)


def transitions(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(ctx, nxt, cnt): how often a symbol follows k symbols; no window crosses sequences."""
    rows = counts(df, k + 1, [], seq, plain=False).withColumnRenamed("n", "cnt")
    return rows.select(F.left("kmer", F.lit(k)).alias("ctx"), F.right("kmer", F.lit(1)).alias("nxt"), "cnt")


def _by_symbol(n: str) -> Column:
    """How often each symbol follows, in the order of the alphabet."""
    return F.array(*[F.sum(F.when(F.col("nxt") == x, F.col(n)).otherwise(0)) for x in ALPHABET])


def _added(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)


def smoothed(table: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(ctx, nxt, cnt, prob) over all five symbols of every context seen; a context never seen is uniform."""
    rows = table.groupBy("ctx").agg(_by_symbol("cnt").alias("__c")).withColumn("__t", _added(F.col("__c")))
    rows = rows.select("ctx", "__t", F.posexplode("__c").alias("__i", "cnt"))
    nxt = F.substring(F.lit(ALPHABET), F.col("__i") + 1, F.lit(1))
    return rows.select("ctx", nxt.alias("nxt"), "cnt", ((F.col("cnt") + F.lit(alpha)) / (F.col("__t") + F.lit(5 * alpha))).alias("prob"))


def held_out_markov(df: DataFrame, ks: tuple[int, ...], split: Column, alpha: float = 0.1, seq: str = "seq", key: str = "doc_id") -> DataFrame:
    """(k, n_train_trans, n_test, top1, ce_bits) of tables learnt on prefixes and tested on the rest, one row a k.

    One scan counts the windows of the longest context, in the training part and in the rest; shorter contexts are their
    ends.  A mark before the start tells windows that begin there: they teach nothing, and a test position's context is
    padded with N.
    """
    far = max(ks)
    marked = df.select(split.alias("cut"), F.concat(F.lit("^" * far), F.col(seq)).alias("seq"))
    rows = windows(marked, far + 1, ["cut"], pos=True)
    tested = F.col("pos") >= F.col("cut")
    rows = rows.groupBy("kmer").agg(F.count_if(~tested).alias("cnt"), F.count_if(tested).alias("m"))
    rows = rows.select("kmer", "cnt", "m", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    ctx = F.substring("kmer", F.lit(far + 1) - F.col("k"), F.col("k"))
    whole = ~F.contains(ctx, F.lit("^"))
    rows = rows.select("k", F.translate(ctx, "^", "N").alias("ctx"), F.right("kmer", F.lit(1)).alias("nxt"), F.when(whole, F.col("cnt")).otherwise(0).alias("cnt"), "m")
    rows = rows.groupBy("k", "ctx").agg(_by_symbol("cnt").alias("c"), _by_symbol("m").alias("t"), F.sum("cnt").alias("n"), F.sum("m").alias("m"))
    seen, total = F.col("n") > 0, F.col("n") + F.lit(5 * alpha)
    best = F.when(seen, F.array_position("c", F.array_max("c"))).otherwise(1)  # ties and the unseen: the first symbol
    bits = F.zip_with("c", "t", lambda c, t: -t * F.when(seen, F.log2((c + F.lit(alpha)) / total)).otherwise(F.log2(F.lit(0.2))))
    bits = F.aggregate(bits, F.lit(0.0), lambda a, x: a + x) - (F.col("m") - _added(F.col("t"))) * F.log2(F.lit(0.2))
    rows = rows.select("k", "n", "m", F.element_at("t", best.cast("int")).alias("hit"), bits.alias("bits"))
    rate = lambda c: F.try_divide(F.sum(c), F.sum("m").cast("double"))
    out = rows.groupBy("k").agg(F.sum("n").alias("n_train_trans"), F.sum("m").alias("n_test"), rate("hit").alias("top1"), rate("bits").alias("ce_bits"))
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ks))).alias("k"))
    zero = F.lit(0).cast("long")
    return every.join(out, "k", "left").select("k", F.coalesce("n_train_trans", zero).alias("n_train_trans"), F.coalesce("n_test", zero).alias("n_test"), "top1", "ce_bits")


def latest_before(df: DataFrame, k: int, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """(key, pos, last): the latest earlier start of the window at pos, for windows that have one.

    A sequence is sorted by k-mer inside its Arrow batch; nothing is exchanged.
    """

    def work(c: np.ndarray, _: dict) -> list[np.ndarray]:
        found = list(codes.earlier(c, k)) or [(np.zeros(0, np.int64),) * 2]
        return [np.concatenate(x) for x in zip(*found)]

    return codes.each(df, [key], seq, work, "pos long, last long")


def held_out_lookup(df: DataFrame, k: int, split: Column, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """(k, n_test, n_occ, n_hit, ...): does the continuation of the latest earlier match predict the symbol?

    Position j asks for the symbols before it; only matches that end before j - 1 count, which is any earlier start.
    """

    def work(c: np.ndarray, row: dict) -> list[np.ndarray]:
        occ = hit = 0
        for pos, last in codes.earlier(c[:-1], k):
            asked = pos + k >= row["__cut"]
            occ += int(asked.sum())
            hit += int((c[pos[asked] + k] == c[last[asked] + k]).sum())
        return [np.array([x], np.int64) for x in (max(len(c) - row["__cut"], 0), occ, hit)]

    rows = codes.each(df.withColumn("__cut", F.coalesce(split.cast("long"), F.lit(0))), [], seq, work, "test long, occ long, hit long", ["__cut"])
    got = rows.agg(F.sum("test").alias("n_test"), F.coalesce(F.sum("occ"), F.lit(0)).alias("n_occ"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hit"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return got.select(
        F.lit(k).alias("k"), "n_test", "n_occ", "n_hit", rate("n_occ", "n_test").alias("occurrence_rate"),
        rate("n_hit", "n_occ").alias("hit_rate_given_occ"), rate("n_hit", "n_test").alias("hit_rate_overall"),
    )


def distinct_sketches(df: DataFrame, k: int, keys: list[str], seq: str = "seq", lg: int = 14) -> DataFrame:
    """(keys, sketch): a mergeable sketch of each key's distinct k-mers, 0.8 % standard error at ``lg`` 14.

    A sketch takes a k-mer as often as it comes to the same effect, so short k-mers of few keys come out of bitmaps
    (``codes.occurring``), each once; others are rows.
    """
    few = 5**k <= codes.POSSIBLE and (not keys or df.select(*keys).distinct().limit(KEYS + 1).count() <= KEYS)
    rows = codes.unpacked(codes.occurring(df, k, keys, seq), k, keys) if few else windows(df, k, keys, seq)
    return sketched(rows, keys, lg).select(*keys, "sketch")


def sketched(rows: DataFrame, keys: list[str], lg: int = 14) -> DataFrame:
    """(keys, kmers, sketch) of k-mers, and how many there are."""
    return rows.groupBy(*keys).agg(F.count("*").alias("kmers"), F.hll_sketch_agg("kmer", lg).alias("sketch"))


def distinct_by_parts(df: DataFrame, k: int, key: str, part: str, seq: str = "seq", lg: int = 14) -> DataFrame:
    """(key, kmers, sketch, merged): the exact number of a key's distinct k-mers, a sketch of them, and one merged from
    sketches of the key's parts, all from one scan."""
    known = codes.occurring(df, k, [key, part], seq)
    whole = sketched(codes.unpacked(codes.joined(known, [key]), k, [key]), [key], lg)
    parts = sketched(codes.unpacked(known, k, [key, part]), [key, part], lg)
    up = merged_sketches(parts, [key]).select(F.col(key).alias("__key"), F.col("sketch").alias("merged"))
    return whole.join(up, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sketch) of the sketches' union, from sketches alone."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def variation(a: DataFrame, b: DataFrame, on: list[str], keys: list[str] | None = None) -> DataFrame:
    """Total variation distance of two count tables (on, n): 0 if both are empty, 1 if one is."""
    total = lambda d: d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    left, right = a.groupBy(*on).agg(F.sum("n").alias("na")), b.groupBy(*on).agg(F.sum("n").alias("nb"))
    ta, tb = total(a).withColumnRenamed("t", "ta"), total(b).withColumnRenamed("t", "tb")
    both = left.join(right, on, "full_outer").crossJoin(F.broadcast(ta)).crossJoin(F.broadcast(tb))
    gap = F.abs(F.coalesce("na", F.lit(0)) / F.col("ta") - F.coalesce("nb", F.lit(0)) / F.col("tb"))
    part = both.where("ta > 0 AND tb > 0").agg((F.sum(gap) * 0.5).alias("g"))
    return part.crossJoin(ta).crossJoin(tb).select(F.when((F.col("ta") == 0) & (F.col("tb") == 0), 0.0).when((F.col("ta") == 0) | (F.col("tb") == 0), 1.0).otherwise(F.col("g")).alias("tvd"))
