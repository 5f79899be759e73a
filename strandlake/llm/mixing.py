"""Operator 8: mixing sources to target weights by weighted fair queueing.

A source's documents are shuffled by a seeded hash; a document's virtual finish time is the source's running word count,
itself included, over the source's target.  Passes over a source go on from where the last one ended.  All documents in
order of finish time, cut where the budget is spent, are the mix, so each source gets its target to within a document.

Nothing is sorted in one place.  Rows of one source, id, text and size are one entry with a multiplicity, so repeated rows
are one row of every window; running counts over the entries come from ``prefix_sums`` (hash blocks of a source), and the cut
is found by narrowing a histogram of finish times until what is left is small enough to sort.  Texts are only scanned: the
cut is one place in each source's order, and a table of these places decides which documents go into the mix.

Defined cases: null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; rows without
id are shuffled by their text; of repeated rows at the cut, as many as fit go on; no words at all give targets of 0; an empty
table gives an empty table; a very long text only counts by its words; ``mix`` ignores other columns, ``mix_documents`` returns all columns as they came.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, prefix_sums, scratch, small

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: Blocks that one source's rows are dealt over for their running sums.
BLOCK_BITS = 12
#: Bins of each narrowing, and the entries that may be sorted at its end.
BINS, SORTED = 4096, 20_000

#: A row's place in its source's order.
_PLACE = ("__h", "__id", "__size", "__tie")


def sized(docs: DataFrame, seed: int = 8) -> DataFrame:
    """Adds what mixing needs: __size (words), __src (source, never null), __h (shuffle hash), __id and __tie."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # 60 bits of MD5: any SQL engine can recompute the shuffle
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.md5(text)))
    h = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
    src = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    return docs.withColumns({"__size": F.regexp_count(text, F.lit(WORD)).cast("long"), "__src": src, "__h": h, "__tie": F.crc32(text), "__id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})


def entries(docs: DataFrame) -> DataFrame:
    """(doc_id, source, __src, place, __m, __words): rows that are one in id, source and text once, with their number and words."""
    rows = sized(docs.select("doc_id", "source", "text")).drop("text")
    rows = rows.groupBy("doc_id", "source", "__src", *_PLACE).agg(F.count("*").alias("__m"))
    return rows.withColumn("__words", F.col("__size") * F.col("__m")).withColumn("__block", F.shiftright("__h", 60 - BLOCK_BITS))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES, share: float = 1.0) -> DataFrame:
    """(__src, __total, __target): water filling over the sources, a table with one row each.

    A source is full when its target by weight would pass ``passes`` times its size. In order of cap over weight the full
    ones come first, so prefix sums give the level.
    """
    per = rows.groupBy("__src").agg(F.sum("__words").alias("__total"))
    every = Window.partitionBy(F.lit(0))
    n = F.row_number().over(every.orderBy("__src"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(n - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("w", w).withColumn("cap", F.col("__total") * float(passes))
    per = per.withColumn("budget", F.sum("__total").over(every) * share)
    before = every.orderBy(F.col("cap") / F.col("w"), "__src")
    per = per.withColumns({"caps": F.coalesce(F.sum("cap").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "rest": F.sum("w").over(before.rowsBetween(0, Window.unboundedFollowing))})
    level = (F.col("budget") - F.col("caps")) / F.col("rest")
    first = F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("__src"), level.alias("level"))  # the first source that isn't full
    per = per.withColumn("level", F.min(F.when(level <= F.col("cap") / F.col("w"), first)).over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return per.select("__src", "__total", target.alias("__target"))


def queued(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds __cum (words of the source up to and including the entry), __total and __target."""
    return prefix_sums(rows, ["__src"], "__block", [F.col(c) for c in _PLACE], "__words", "__cum").join(small(plan), "__src")


def _finish(e: str) -> str:
    return f"(({e} - 1) * __total + __cum) / __target"


@dataclass(frozen=True)
class Cut:
    """The place (finish time, source, hash, id) up to which entries are taken, and the rows of the entry right there."""

    time: float
    src: str
    h: int
    id: str
    rows: int


def find_cut(rows: DataFrame, passes: int = MAX_PASSES, share: float = 1.0) -> Cut | None:
    """Where the budget ends, over queued entries; None takes nothing."""
    latest = F.expr(f"CASE WHEN __target > 0 THEN {_finish(str(passes))} END")
    budget, most = rows.agg(F.sum("__words"), F.max(latest)).first()
    budget = int((budget or 0) * share)
    if budget <= 0 or most is None:
        return None
    row = ("__src", "__h", "__id", "__size", "__words")
    each = F.explode(F.array(*[F.struct(F.expr(_finish(str(e))).alias("f")) for e in range(1, passes + 1)]))
    times = rows.where("__size > 0 AND __target > 0").select(*row, each.alias("e")).select(*row, "e.f")
    lo, width, before = 0.0, most * (1 + 1e-9), 0
    while True:
        step = width / BINS
        inside = times.where((F.col("f") >= lo) & (F.col("f") < lo + width))
        hist = inside.groupBy(F.floor((F.col("f") - lo) / step).alias("b")).agg(F.sum("__words").alias("s"), F.count("*").alias("n"), F.min("f").alias("least"), F.max("f").alias("most"))
        bins = sorted(hist.collect(), key=lambda r: r["b"])  # at most BINS + 1 rows
        for r in bins:
            if before + r["s"] > budget:
                break
            before += r["s"]
        else:
            return Cut(float("inf"), "", 0, "", 0)
        lo, width = r["least"], max(r["most"] - r["least"], 0.0)
        if r["n"] <= SORTED or width == 0.0:
            break
        width *= 1 + 1e-9
    part = times.where((F.col("f") >= lo) & (F.col("f") <= r["most"]))
    order = Window.partitionBy(F.lit(0)).orderBy("f", "__src", "__h", "__id").rowsBetween(Window.unboundedPreceding, 0)
    over = part.withColumn("run", F.sum("__words").over(order)).where(F.col("run") > budget - before)
    first = over.agg(F.min(F.struct("f", "__src", "__h", "__id", "run", "__words", "__size")).alias("m")).first()["m"]
    if first is None:
        return Cut(float(r["most"]), "2", 0, "", 0)
    return Cut(first["f"], first["__src"], first["__h"], first["__id"], (budget - before - (first["run"] - first["__words"])) // first["__size"])


def copies(cut: Cut | None, passes: int = MAX_PASSES) -> tuple[Column, Column]:
    """(how often each row of a queued entry is in the mix, how many of its rows are so once more)."""
    none = F.lit(0).cast("long")
    if cut is None:
        return none, none
    end = F.struct(F.lit(cut.time).alias("f"), F.lit(cut.src).alias("s"), F.lit(cut.h).cast("long").alias("h"), F.lit(cut.id).alias("i"))
    n, more = F.lit(0), F.lit(0)
    for e in range(1, passes + 1):
        f = F.expr(f"CASE WHEN __size > 0 AND __target > 0 THEN {_finish(str(e))} END").cast("double")
        at = F.struct(f.alias("f"), F.col("__src").alias("s"), F.col("__h").alias("h"), F.col("__id").alias("i"))
        n = n + F.when(f.isNotNull() & (at < end), 1).otherwise(0)
        more = more + F.when(f.isNotNull() & (at == end), cut.rows).otherwise(0)
    return n.cast("long"), more.cast("long")


def _queue(docs: DataFrame) -> DataFrame:
    """The queued entries with __n and __more, a table that outlives the scope around by one."""
    with scratch(docs.sparkSession):
        rows = materialize(entries(docs), "entries")
        plan = materialize(targets(rows), "targets")
        rows = materialize(queued(rows, plan), "queued")
        n, more = copies(find_cut(rows))
        return materialize(rows.select("doc_id", "source", "__src", *_PLACE, "__m", "__cum", "__total", "__target", n.alias("__n"), more.alias("__more")), "taken", keep=True)


def mix(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken."""
    rows = _queue(docs).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m"))).alias("__row"))
    taken = (F.col("__n") + F.when(F.col("__row") <= F.col("__more"), 1).otherwise(0)) * F.col("__size")
    return rows.select("doc_id", "source", F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"))


def _repeated(rows: DataFrame, n: str) -> DataFrame:
    return rows.where(F.col(n) > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))


def _taken(docs: DataFrame, timed: bool = False) -> DataFrame:
    """Each document once for each pass it was taken in: its own columns, __src, its place and __copy (the pass).

    ``timed`` adds __f, the virtual finish time in that pass.
    """
    place = F.struct(*_PLACE)
    with scratch(docs.sparkSession):
        rows = _queue(docs)
        # a source's rows up to one place are taken once more than those after it
        per = rows.where("__size > 0").groupBy("__src").agg(F.min("__n").alias("__least"), F.max("__n").alias("__most"))
        last = rows.where("__size > 0").join(small(per), "__src").where("__n = __most").groupBy("__src").agg(F.max(place).alias("__last"))
        plan = materialize(per.join(last, "__src"), "places", keep=True)
        split = materialize(rows.where("__more > 0").select("__src", *_PLACE, "__more", (F.col("__n") + 1).alias("__copy")), "split", keep=True)  # one row at most
        times = materialize(rows.select("__src", *_PLACE, "__cum", "__total", "__target").distinct(), "times", keep=True) if timed else None
    n = F.when(F.col("__size") == 0, 0).when(place <= F.col("__last"), F.col("__most")).otherwise(F.col("__least"))
    full = sized(docs)
    names = [F.col(f"`{c}`") for c in full.columns] + [F.col("__copy")]
    taken = _repeated(full.join(small(plan), "__src").withColumn("__n", n), "__n").select(*names)
    if not split.isEmpty():
        taken = taken.unionAll(_some_of(full.join(F.broadcast(split), ["__src", *_PLACE]), full.columns).select(*names))
    return taken if times is None else taken.join(times, ["__src", *_PLACE]).withColumn("__f", F.expr(_finish("__copy")))


def _some_of(rows: DataFrame, cols: list[str]) -> DataFrame:
    """``__more`` of ``rows``, which are repeated rows of one entry: equal ones are counted, so none is held row by row."""
    rows = rows.groupBy(*[F.col(f"`{c}`") for c in cols], "__more", "__copy").agg(F.count("*").alias("__k"))
    rows = rows.withColumns({"__a": F.xxhash64(*[F.col(f"`{c}`") for c in cols]), "__one": F.lit(1)})
    rows = rows.withColumn("__b", F.pmod("__a", F.lit(1 << BLOCK_BITS)))
    rows = prefix_sums(rows, ["__one"], "__b", [F.col("__a")], "__k", "__to")
    take = F.greatest(F.lit(0), F.least(F.col("__k"), F.col("__more") - F.col("__to") + F.col("__k")))
    return rows.withColumn("__n", take).where("__n > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it was taken, with its own columns, in no order."""
    return _taken(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def ordered_mix(docs: DataFrame) -> DataFrame:
    """The mix in order of virtual finish time, range-sorted over all partitions: sources interleave by their weights."""
    return _taken(docs, timed=True).orderBy("__f", "__src", *_PLACE).select(*[F.col(f"`{c}`") for c in docs.columns])
