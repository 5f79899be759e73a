"""Operator 1: quality rules whose cutoffs come from the corpus.

Each document gets integer signals.  Every signal goes into a log-linear histogram sketch (64 buckets an octave, a
relative error under 1/64) kept per language and source; sketches merge by adding counts, so the result depends on
neither task order nor file layout.  Cutoffs are outer fences, ``Q3 + 3 * max(Q3 - Q1, floor)`` and its mirror below, read
off the finest sketch with enough rows: (language, source), else language, else all.  The thresholds are then joined back
and filter the documents.

Defined cases: null text has no words and fails the base rules; null language or source form groups of their own;
repeated rows count as often as they occur; an empty table gives an empty table; ``quality`` reads doc_id, text, lang and source
only, ``quality_filter`` returns all columns as they came, whatever their names; a very long text is one row like others, in a
piece of its own.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import marked, marks, materialize, scratch, small, without

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
#: name -> (numerator, denominator, least spread in thousandths, two-sided)
SIGNALS = {
    "word_length": ("word_chars", "n_words", 500, True),
    "symbols": ("n_symbols", "n_words", 50, False),
    "dup_lines": ("n_dup_lines", "n_lines", 200, False),
    "repeats": ("n_repeat_words", "n_words", 100, False),
}
#: A group with fewer rows falls back on the merged sketch above it.
MIN_GROUP = 200
#: Thresholds of up to this many groups are broadcast; beyond it they are joined by key (AQE splits hot keys).
MAX_BROADCAST_GROUPS = 20_000

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


def _repeat_words(words: list[bytes]) -> int:
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    often = Counter(grams)
    total = end = 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def base_signals(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), _repeat_words(words), len(lines)


_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in (*BASE, "n_lines")])


@F.arrow_udf(_TYPE)
def _signals(texts: pa.Array) -> pa.Array:
    cols = list(zip(*map(base_signals, texts.to_pylist()))) or [[]] * 6
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*BASE, "n_lines"])


def with_signals(docs: DataFrame) -> DataFrame:
    docs = without(docs, *BASE, "n_lines", "__q")
    return docs.withColumn("__q", _signals("text")).select(*docs.columns, "__q.*")


def _ratio(num: str, den: str):
    return F.expr(f"CASE WHEN {den} > 0 THEN ({num} * 1000) DIV {den} ELSE 0L END")


def _bucket(v: str):
    """The value with all but its seven leading bits cleared."""
    return F.expr(f"shiftleft(shiftright({v}, greatest(length(bin({v})) - 7, 0)), greatest(length(bin({v})) - 7, 0))")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, signal, bucket, n): the mergeable sketch of every group, over documents with a word."""
    parts = F.array(*[F.struct(F.lit(k).alias("signal"), _ratio(a, b).alias("v")) for k, (a, b, _, _) in SIGNALS.items()])
    long = rows.where("n_words > 0").select("lang", "source", F.explode(parts).alias("s")).select("lang", "source", "s.*")
    return long.groupBy("lang", "source", "signal", _bucket("v").alias("bucket")).agg(F.count("*").alias("n"))


def _quartiles(sk: DataFrame, keys: list[str]) -> DataFrame:
    merged = sk.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*keys, "signal")
    run = part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.select("*", F.sum("n").over(run).alias("cum"), F.sum("n").over(part).alias("total"))
    return merged.groupBy(*keys, "signal").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.expr("cum * 4 >= total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.expr("cum * 4 >= total * 3"), F.col("bucket"))).alias("q3"),
    )


def thresholds(sk: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, signal, lo, hi) in thousandths, one row for every group of the sketch table."""
    groups = sk.select("lang", "source", "signal").distinct().alias("g")
    fine, lang, every = (_quartiles(sk, k).alias(a) for k, a in ((["lang", "source"], "f"), (["lang"], "l"), ([], "e")))
    got = (
        groups.join(fine, F.expr("g.lang <=> f.lang AND g.source <=> f.source AND g.signal = f.signal"), "left")
        .join(lang, F.expr("g.lang <=> l.lang AND g.signal = l.signal"), "left")
        .join(F.broadcast(every), F.expr("g.signal = e.signal"), "left")
    )

    def finest(q: str):
        return F.expr(f"CASE WHEN f.total >= {min_group} THEN f.{q} WHEN l.total >= {min_group} THEN l.{q} ELSE e.{q} END")

    got = got.select("g.lang", "g.source", "g.signal", finest("q1").alias("q1"), finest("q3").alias("q3"))
    floor = F.create_map(*[x for k, v in SIGNALS.items() for x in (F.lit(k), F.lit(v[2]).cast("long"))])
    two = F.array(*[F.lit(k) for k, v in SIGNALS.items() if v[3]])
    spread = F.greatest(F.col("q3") - F.col("q1"), floor[F.col("signal")])
    lo = F.when(F.array_contains(two, F.col("signal")), F.col("q1") - 3 * spread).otherwise(F.lit(-1).cast("long"))
    return got.select("lang", "source", "signal", lo.alias("lo"), (F.col("q3") + 3 * spread).alias("hi"))


def judge(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept by joining each row with its group's thresholds."""
    wide = limits.groupBy(F.col("lang").alias("__l"), F.col("source").alias("__s")).agg(
        *[F.max(F.when(F.col("signal") == k, F.col(x))).alias(f"__{k}_{x}") for k in SIGNALS for x in ("lo", "hi")]
    )
    wide = materialize(wide, "limits")
    rows = rows.join(small(wide, MAX_BROADCAST_GROUPS), F.expr("lang <=> __l AND source <=> __s"), "left")
    inside = F.lit(True)
    for k, (a, b, _, _) in SIGNALS.items():
        v = _ratio(a, b)
        inside = inside & F.coalesce((v >= F.col(f"__{k}_lo")) & (v <= F.col(f"__{k}_hi")), F.lit(True))
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside)
    return rows.drop(*wide.columns)


def quality(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the base signals, base_failed, kept. The texts are read once."""
    rows = materialize(with_signals(docs.select("doc_id", "text", "lang", "source")).drop("text"), "signals")
    return judge(rows, thresholds(sketches(rows)))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    Signals are taken once.  What is rejected is known by the text's digests, language and source, so documents with equal
    ones share their verdict, and only rows whose digests were marked are joined (and shuffled, if many are rejected).
    """
    mine = ["__digest", "__crc"]
    ids = {"__digest": F.xxhash64("text"), "__crc": F.crc32(F.coalesce(F.col("text"), F.lit("")))}
    with scratch(docs.sparkSession):
        narrow = docs.select("text", "lang", "source").withColumns(ids)
        narrow = materialize(with_signals(narrow).drop("text"), "signals")
        gone = judge(narrow, thresholds(sketches(narrow))).where("NOT kept")
        gone = materialize(gone.select(*mine, F.col("lang").alias("__l"), F.col("source").alias("__s")).distinct(), "rejected", keep=True)
        table = materialize(marks(gone, mine), "marks", keep=True)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    every = marked(docs.withColumns(ids), mine, table, "__some")
    g = gone.withColumnsRenamed({k: f"{k}_gone" for k in mine})
    same = F.expr("__digest = __digest_gone AND __crc = __crc_gone AND lang <=> __l AND source <=> __s")
    some = every.where("__some").join(small(g), same, "left_anti")
    return every.where("NOT __some").select(*cols).unionAll(some.select(*cols))
