"""Paired experiments: pairing, summaries, budgets, diversity, search audit."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .curate import own_names, running


def pair(rows: DataFrame, keys: list[str], arm: str, a: str, b: str) -> DataFrame:
    """One row a key with both arms as structs a and b, and problem: 'missing' or 'duplicate' where a pair isn't one."""
    cols = [c for c in rows.columns if c not in (*keys, arm)]
    got = rows.groupBy(*keys).agg(
        *[F.min(F.when(F.col(arm) == x, F.struct(*cols))).alias(x) for x in (a, b)],
        *[F.sum((F.col(arm) == x).cast("int")).alias(f"__{x}") for x in (a, b)],
    )
    low, high = F.least(f"__{a}", f"__{b}"), F.greatest(f"__{a}", f"__{b}")
    return got.select(*keys, a, b, F.when(low == 0, "missing").when(high > 1, "duplicate").alias("problem"))


def best_batches(rows: DataFrame, backend: str, batch: str, seconds: str, ok: Column) -> DataFrame:
    """(backend, batch, total_s) of the fastest valid run of each backend; ties to the smaller batch."""
    return rows.where(ok).groupBy(backend).agg(F.min(F.struct(seconds, batch)).alias("m")).select(backend, F.col(f"m.{batch}").alias(batch), F.col(f"m.{seconds}").alias(seconds))


def uniform_violations(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n) for fields that don't have one value in all rows."""
    counts = rows.agg(*[F.count_distinct(f).alias(f) for f in fields])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields]))).where("n <> 1")


def budget_curve(rows: DataFrame, keys: list[str], order: str, seconds: str, qualified: Column, item: str, horizon: float) -> DataFrame:
    """(keys, seconds, qualified_unique): a point at 0, one for each run within the horizon, one at the horizon."""
    t, y, new = own_names(rows, "t", "y", "new")
    first = F.row_number().over(Window.partitionBy(*keys, item, qualified).orderBy(order)) == 1
    pts = running(rows.withColumn(new, (first & qualified).cast("long")), keys, order, [seconds, new], [t, y], through=True)
    pts = pts.where(F.col(t) <= horizon)
    pts = pts.select(*keys, F.col(t).alias("seconds"), F.col(y).alias("qualified_unique"))
    names = rows.select(*keys).distinct()
    zero = names.select(*keys, F.lit(0.0).alias("seconds"), F.lit(0).cast("long").alias("qualified_unique"))
    every = zero.unionByName(pts)
    ends = every.groupBy(*keys).agg(F.max("seconds").alias("s"), F.max("qualified_unique").alias("qualified_unique")).where(F.col("s") < horizon)
    return every.unionByName(ends.select(*keys, F.lit(float(horizon)).alias("seconds"), "qualified_unique"))


def map_means(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, name, mean) over all rows of the key; a row that lacks a name counts as 0."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    sums = rows.select(*keys, F.explode(column).alias("name", "v")).groupBy(*keys, "name").agg(F.sum("v").alias("s"))
    return sums.join(n, keys).select(*keys, "name", (F.col("s") / F.col("n")).alias("mean"))


def ratios(pairs: DataFrame, keys: list[str], a: str, b: str, means: list[str] | None = None) -> DataFrame:
    """(keys, n_pairs, geometric_mean, median) of a over b, and the means of the columns ``means``."""
    r = F.col(a) / F.col(b)
    return pairs.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in means or []], F.count("*").alias("n_pairs"), F.exp(F.avg(F.ln(r))).alias("geometric_mean"), F.percentile(r, F.lit(0.5)).alias("median"))


def identities(df: DataFrame, key: str, seq: str, group: list[str], asks: Column | None = None) -> DataFrame:
    """(group, a, b, identity) of pairs of one length in a group: i < j, or with ``asks`` each asking row with every other.

    Sequences are compared piece by piece; a pair in which both ask is one row, with the lesser key as a.
    """
    from .kmers import pieces

    rows = df.select(*group, key, seq, F.char_length(seq).alias("len"), (F.lit(True) if asks is None else asks).alias("__asks")).where("len > 0")
    rows = pieces(rows, 0, [*group, key, "len", "__asks"], seq)
    left = rows.where("__asks").select(*group, "len", "__at", F.col(key).alias("a"), F.col("__p").alias("__pa"))
    right = rows.select(*group, "len", "__at", F.col(key).alias("b"), F.col("__p").alias("__pb"), F.col("__asks").alias("__too"))
    pairs = left.join(right, [*group, "len", "__at"]).where("a <> b AND NOT (__too AND b < a)")
    same = F.size(F.filter(F.zip_with(F.split("__pa", ""), F.split("__pb", ""), lambda x, y: x == y), lambda t: t))
    pairs = pairs.groupBy(*group, "len", "a", "b").agg(F.sum(same).alias("__same"))
    return pairs.select(*group, "a", "b", (F.col("__same") / F.col("len")).alias("identity"))


def mean_identity(df: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """(group, pairs, identity): the mean identity of all pairs of sequences of one length in a group, without making pairs.

    Counts by position and symbol give the sum over all pairs in linear time (``codes.agreements``).  Empty sequences are in
    no pair.
    """
    from .codes import agreements

    lengths = agreements(df, group, seq).groupBy(group, "len").agg(F.max("m").alias("m"), F.sum("same").alias("same")).where("m > 1")
    pairs = F.sum(F.col("m") * (F.col("m") - 1) / 2)
    return lengths.groupBy(group).agg(pairs.cast("long").alias("pairs"), (F.sum(F.col("same") / F.col("len")) / pairs).alias("identity"))


def top_candidates(rows: DataFrame, keys: list[str], loss: str, index: str, n: int = 2) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(loss, index)
    return rows.where(F.col(loss).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def chains(nodes: DataFrame, node: str, parent: str, text: str) -> DataFrame:
    """(node, depth, path): texts from the root on; nodes that lead to no root are left out.

    Pointer doubling: in each round every node takes over what its ancestor has gathered, so a chain of n nodes takes
    log2 n rounds, each a join of written tables.  Chains that close hold more nodes than there are and go.
    """
    from ..session import written

    rows = written(nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.col(text).alias("path"), F.lit(0).alias("depth")))
    total = rows.count()
    while not rows.where("up IS NOT NULL").isEmpty():
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("path").alias("__path"), F.col("depth").alias("__depth"))
        more = rows.where("up IS NOT NULL").join(above, "up")  # an inner join: who has no such ancestor is on no chain
        more = more.select("node", F.col("__up").alias("up"), F.concat("__path", "path").alias("path"), (F.col("depth") + F.col("__depth") + 1).alias("depth"))
        rows = written(rows.where("up IS NULL").select("node", "up", "path", "depth").union(more.where(F.col("depth") < total)))
    return rows.where("up IS NULL").select("node", "depth", "path")


def ancestry(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, up, root, depth) of the nodes that lead to a root, by pointer doubling on ids alone: log2 n rounds for chains of n."""
    from ..session import written

    given = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    rows = written(given.select("node", F.col("up").alias("next"), F.coalesce("up", "node").alias("root"), F.col("up").isNotNull().cast("int").alias("depth")))
    total = rows.count()
    while not rows.where("next IS NOT NULL").isEmpty():
        above = rows.select(F.col("node").alias("next"), F.col("next").alias("__n"), F.col("root").alias("__r"), F.col("depth").alias("__d"))
        more = rows.where("next IS NOT NULL").join(above, "next").select("node", F.col("__n").alias("next"), F.col("__r").alias("root"), (F.col("depth") + F.col("__d")).alias("depth"))
        rows = written(rows.where("next IS NULL").select("node", "next", "root", "depth").union(more.where(F.col("depth") < total)))
    return rows.where("next IS NULL").select("node", "root", "depth").join(given, "node").select("node", "up", "root", "depth")


def chain_digests(nodes: DataFrame, node: str, parent: str, text: str) -> DataFrame:
    """(node, depth, digest): the MD5 of all texts from the root on, without carrying them: each text is read once.

    A tree's nodes pass one task in order of depth, which keeps the digest states of one level.  Node ids are integers.
    """
    rows = ancestry(nodes, node, parent).join(nodes.select(F.col(node).alias("node"), F.col(text).alias("text")), "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = level = None
        above: dict = {}
        here: dict = {}
        for b in batches:
            out = []
            for n, up, r, depth, t in zip(b["node"].tolist(), b["up"], b["root"].tolist(), b["depth"].tolist(), b["text"]):
                if r != root:
                    root, level, above, here = r, depth, {}, {}
                elif depth != level:
                    level, above, here = depth, here, {}
                state = above[int(up)].copy() if depth else hashlib.md5()
                state.update((t or "").encode())
                here[n] = state
                out.append((n, depth, state.hexdigest()))
            yield pd.DataFrame(out, columns=["node", "depth", "digest"])

    return rows.repartition("root").sortWithinPartitions("root", "depth", "node").select("node", "up", "root", "depth", "text").mapInPandas(run, "node long, depth int, digest string")


def beam_search(spark, start: DataFrame, expand, score, rounds: int, width: int, checkpoint=None) -> DataFrame:
    """Rounds of expand -> score -> best ``width`` a design by (loss, idx); ``checkpoint`` cuts the lineage of a round.

    ``expand(frame, round)`` gives (design, idx, parent, state), ``score`` adds loss.  A round's frame holds width rows a
    design, so the loop moves little; results of all rounds are returned.
    """
    beam, out = start, None
    for r in range(rounds):
        rows = score(expand(beam, r)).withColumn("round", F.lit(r))
        kept = top_candidates(rows, ["design"], "loss", "idx", width)
        kept = checkpoint(kept) if checkpoint else kept
        out = kept if out is None else out.unionByName(kept)
        beam = kept
    return out


# a search that outlives its driver


def search_identity(start: DataFrame, *parts) -> str:
    """What a search's rounds may be mixed with: a digest of its start rows, in any order, and of code and parameters.

    Functions count by their source, everything else by its repr.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(start.columns)])
    n, total, low = start.agg(F.count("*"), F.sum(F.pmod(row, F.lit(1 << 32))), F.min(row)).first()
    code = [inspect.getsource(p) if callable(p) else repr(p) for p in parts]
    return hashlib.sha256(json.dumps([start.dtypes, n, total, low, code]).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def durable_search(start: DataFrame, expand: Callable, score: Callable, rounds: int, width: int, root: str, identity: str) -> DataFrame:
    """All candidates (round, rank and what ``score`` gives) of a beam search whose rounds are committed below ``root``.

    A round is a folder that Spark commits as a whole, so a search whose driver was lost goes on after its last whole round,
    with the same result; a folder begun under another identity is an error.  ``expand(beam, round)`` gives design, idx and
    whatever else belongs to a candidate, ``score`` adds loss; the best ``width`` of a design by (loss, idx) have a rank, others
    and those without a loss have none.
    """
    spark = start.sparkSession
    if _exists(spark, f"{root}/identity/_SUCCESS"):
        if (held := spark.read.text(f"{root}/identity").first()[0]) != identity:
            raise ValueError(f"{root} belongs to another search: {held}")
    else:
        spark.createDataFrame([(identity,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/identity")
    beam = start
    for r in range(rounds):
        path = f"{root}/rounds/round={r}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            rows = score(expand(beam, r))
            best = F.row_number().over(Window.partitionBy("design").orderBy(F.col("loss").asc_nulls_last(), "idx"))
            rows.withColumn("rank", F.when(F.col("loss").isNotNull() & (best <= width), best)).write.mode("overwrite").parquet(path)
        beam = spark.read.parquet(path).where("rank IS NOT NULL")
    return spark.read.option("basePath", f"{root}/rounds").parquet(*[f"{root}/rounds/round={r}" for r in range(rounds)])


def search_violations(rows: DataFrame, each: int, width: int, seed: Callable[..., Column], loss: DataFrame) -> DataFrame:
    """(design, round, idx, rule) of what a search's record contradicts; none if it is sound.

    rows: design, round, idx, parent, seed, suffix, state, chain, loss, rank.  ``each`` children a kept parent (``count``), which
    is a kept candidate of the round before (``parent``); ``seed(design, round, idx)`` again (``seed``); states are the parent's
    and the suffix, chains digests of the parent's chain and the suffix (``chain``); ``loss`` (design, state, want) again
    (``loss``); and ranks of the best ``width`` by (loss, idx) (``rank``).
    """
    key = ["design", "round", "idx"]
    kept = rows.where("rank IS NOT NULL").select("design", (F.col("round") + 1).alias("round"), F.col("idx").alias("parent"), F.col("state").alias("before"), F.col("chain").alias("link"))
    joined = rows.join(kept, ["design", "round", "parent"], "left")
    first = F.col("round") == 0
    state = F.concat(F.when(first, F.lit("")).otherwise(F.col("before")), "suffix")
    chain = F.sha2(F.concat(F.when(first, F.lit("")).otherwise(F.col("link")), "suffix"), 256)
    best = F.row_number().over(Window.partitionBy("design", "round").orderBy(F.col("loss").asc_nulls_last(), "idx"))
    due = F.when(F.col("loss").isNotNull() & (best <= width), best)
    joined = joined.join(loss, ["design", "state"], "left").withColumn("due", due)
    rules = {
        "parent": ~first & F.col("before").isNull(),
        "seed": F.col("seed") != seed(F.col("design"), F.col("round"), F.col("idx")),
        "chain": (first | F.col("before").isNotNull()) & ((F.col("state") != state) | (F.col("chain") != chain)),
        "loss": ~F.coalesce(F.abs(F.col("loss") - F.col("want")) <= 1e-10, F.col("loss").isNull() & F.col("want").isNull()),
        "rank": ~F.col("rank").eqNullSafe(F.col("due")),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    bad = joined.select(*key, F.explode(found).alias("rule"))
    parents = kept.groupBy("design", "round").agg(F.count("*").alias("parents"))
    sizes = rows.groupBy("design", "round").agg(F.count("*").alias("n")).join(parents, ["design", "round"], "left")
    wrong = sizes.where(F.col("n") != F.when(F.col("round") == 0, each).otherwise(F.coalesce("parents", F.lit(0)) * each))
    return bad.unionByName(wrong.select("design", "round", F.lit(None).cast(rows.schema["idx"].dataType).alias("idx"), F.lit("count").alias("rule")))


# a queue of jobs

#: Scopes from the narrowest to the widest.
SCOPES = ("calibration", "pilot", "all")


def scope_limit(requested: str, frozen: str | None) -> str:
    """What may run: a scope that was frozen once cannot be widened by a later request."""
    for s in (requested, frozen):
        if s is not None and s not in SCOPES:
            raise ValueError(f"unknown scope: {s}")
    return requested if frozen is None else SCOPES[min(SCOPES.index(requested), SCOPES.index(frozen))]


def queue(planned: DataFrame, attempts: DataFrame, implementation: str, requested: str, frozen: str | None = None) -> DataFrame:
    """(job, stage, action, attempt, incomplete): what happens to each planned job (job, stage), given earlier attempts.

    attempts: job, at (their order), status, eligible, implementation, error.  By its latest attempt a job is out of scope, has to
    be refused (made by another implementation), skipped (complete and eligible, or a calibration that ran out of memory),
    archived and run again, or run for the first time.  ``attempt`` is the number of the archived attempt; ``incomplete`` says that its time
    is not whole (it was still running, or complete without being eligible).
    """
    latest = attempts.groupBy("job").agg(
        F.max(F.struct("at", "status", "eligible", "implementation", "error")).alias("m"), F.count("*").alias("n")
    ).select("job", "n", "m.*")
    through = SCOPES.index(scope_limit(requested, frozen))
    stage = F.array_position(F.array(*map(F.lit, SCOPES)), F.col("stage")) - 1
    memory = F.contains(F.lower(F.coalesce("error", F.lit(""))), F.lit("out of memory"))
    eligible = F.coalesce("eligible", F.lit(False))
    action = (
        F.when(F.coalesce((stage < 0) | (stage > through), F.lit(True)), "out_of_scope").when(F.col("n").isNull(), "run")
        .when(~F.coalesce(F.col("implementation") == implementation, F.lit(False)), "refuse").when((F.col("status") == "complete") & eligible, "skip")
        .when((F.col("stage") == "calibration") & (F.col("status") == "failed") & memory, "skip_memory").otherwise("archive_and_run")
    )
    rows = planned.join(latest, "job", "left").withColumn("action", action)
    again = F.col("action") == "archive_and_run"
    whole = (F.col("status") == "running") | ((F.col("status") == "complete") & ~eligible)
    return rows.select("job", "stage", "action", F.when(again, F.col("n") - 1).alias("attempt"), F.when(again, F.coalesce(whole, F.lit(False))).alias("incomplete"))


def arm_totals(rows: DataFrame, keys: list[str], peaks: list[str], sums: list[str]) -> DataFrame:
    """(keys, peaks, sums) of runs: the largest of each peak where any run has one; sums only where every run has the value."""
    whole = [F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in sums]
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in peaks], *whole)


def state_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, max_abs, max_rel) of two states (path, i, v): the largest difference, and that over the largest |b| of the path.

    A path or element that only one of them has is an error.
    """
    j = a.select("path", "i", F.col("v").alias("a"), F.lit(True).alias("in_a")).join(b.select("path", "i", F.col("v").alias("b"), F.lit(True).alias("in_b")), ["path", "i"], "full_outer")
    lone = F.col("in_a").isNull() | F.col("in_b").isNull()
    gap = F.when(lone, F.raise_error(F.concat(F.lit("only one state has "), "path", F.lit(" "), F.col("i").cast("string"))).cast("double")).otherwise(F.abs(F.col("a") - F.col("b")))
    out = j.groupBy("path").agg(F.max(gap).alias("max_abs"), F.max(F.abs("b")).alias("most"))
    return out.select("path", "max_abs", (F.col("max_abs") / F.greatest("most", F.lit(1e-12))).alias("max_rel"))


def changed(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, want, got) where they differ or one side is missing."""
    j = expected.select(key, F.col(value).alias("want")).join(actual.select(key, F.col(value).alias("got")), key, "full_outer")
    return j.where(~F.col("want").eqNullSafe(F.col("got")))


def wave(length: Column, bin_bp: int, on: int, off: int) -> Column:
    """0 and 1, a value a bin, of rows' own lengths."""
    if on % bin_bp or off % bin_bp:
        raise ValueError("edges must fall on bins")
    checked = F.when((length <= 0) | (length % bin_bp != 0), F.raise_error(F.lit("edges must fall on bins")).cast("long")).otherwise(length)
    return F.transform(F.sequence(F.lit(0).cast("long"), F.floor(checked / bin_bp) - 1), lambda i: F.when((i * bin_bp) % (on + off) < on, 1.0).otherwise(0.0))


def square_wave(length: int, bin_bp: int, on: int, off: int):
    """SQL array of 0 and 1, a value a bin."""
    if length <= 0 or length % bin_bp:
        raise ValueError("edges must fall on bins")
    return wave(F.lit(length), bin_bp, on, off)


# On and off lengths of the periodic patterns; Morse units of A, R, C.
WAVES = {"medium": (768, 768), "short": (384, 1152), "long": (1664, 1664)}
MORSE = (".-", ".-.", "-.-.")
UNIT = 384


def pattern(name: str, length: int, bin_bp: int):
    if name in WAVES:
        return square_wave(length, bin_bp, *WAVES[name])
    if name != "arc":
        raise ValueError(f"unknown pattern: {name}")
    units = [u for n, letter in enumerate(MORSE) for u in ([0] * 3 * (n > 0)) + [x for i, m in enumerate(letter) for x in [0] * (i > 0) + [1] * (1 if m == "." else 3)]]
    if length <= 0 or length % bin_bp or UNIT % bin_bp:
        raise ValueError("edges must fall on bins")
    per = UNIT // bin_bp
    lit = F.array(*[F.lit(float(u)) for u in units])
    return F.transform(F.sequence(F.lit(0), F.lit(length // bin_bp - 1)), lambda i: F.coalesce(F.get(lit, F.floor(i / per).cast("int")), F.lit(0.0)))
