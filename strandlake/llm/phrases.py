r"""Operator 12: phrase collocation mining, level by level as Apriori does.

A-Z are lowered, texts are cut into pieces at ``[.,;:!?\x0A-\x0D]`` and pieces into words at spaces and tabs.  Everything is
counted by language, null being ``und``.  Level 1 counts words.  Level k reads the texts again and counts a phrase of k words
only where its first k - 1 and its last k - 1 words are frequent, which no frequent phrase can lack, so what is counted at all
shrinks from level to level.

The frequent phrases of the level below are sent to all tasks as a bitmap of BITS bits over their hashes, made by Spark's
bitmap functions: 16 MB, however many there are.  It lets every frequent phrase through and some others; those others are
counted too, and dropped by their exact counts.  So its size bounds the broadcast and never touches the result.

Words are hashed and looked up for whole Arrow batches at once; only phrases that pass become strings.  A task counts in
dictionaries of at most ENTRIES phrases, whole phrases as keys, so counts are exact and frequent phrases are combined before
the shuffle.  Very long texts are hashed stretch by stretch.

Scores come from the tables of the levels: each cut of a candidate looks up its two parts there.  A candidate inside a longer
one need only be compared with those one word longer: a candidate two words longer implies one between them at least as
frequent.  The best ``top`` of a language are chosen in salted groups first, then among those.

Defined cases: null text has no words, null lang is ``und``; languages without candidates give no rows; repeated rows count each;
equal scores go by count and phrase (UTF-8 bytes); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, small
from .words import chained, mix, pieces, shingles, text_buffer, word_hashes

LEAST, WORDS, TOP = 10, 3, 2000
#: A candidate goes if a longer one around it has this many hundredths of its count.
INSIDE = 50
SCALE = 1_000_000
#: Bits of a level's bitmap, and distinct phrases of a task's dictionaries.
BITS, ENTRIES = 1 << 27, 250_000
_CELL = 8 * 4096  # bits of one row of Spark's bitmaps

_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_APART = _ENDS + b" \t"
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORDS = bytes(0x20 if b in _APART else _LOWER[b] for b in range(256))
#: Byte -> 0 between words, else 1 + the byte with A-Z lowered.
_LUT = np.array([0 if b in _APART else 1 + _LOWER[b] for b in range(256)], np.uint64)
_IS_END = np.array([b in _ENDS for b in range(256)])
_SPACES = re.compile(rb"[ \t]+")


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _bits(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return (mix(h ^ seeds) % np.uint64(BITS)).astype(np.int64)


class Grams:
    """Words of a batch of texts, and where phrases of k words in one piece begin."""

    def __init__(self, texts: pa.Array) -> None:
        buf, _ = text_buffer(texts)
        self.text = buf.tobytes().translate(_LOWER)
        self.hash, self.bounds, self.start, self.end = word_hashes(texts, _LUT, spans=True)
        n = len(self.hash)
        #: whether a word and the next one are in one piece, and whether there is just a space between them
        self.near, self.plain = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            ends = np.zeros(len(buf) + 1, np.int32)
            np.cumsum(_IS_END[buf], out=ends[1:])
            self.near[:-1] = ends[self.start[1:]] == ends[self.end[:-1]]
            inner = self.bounds[1:-1]
            self.near[inner[(inner > 0) & (inner < n)] - 1] = False
            self.plain[:-1] = (self.start[1:] - self.end[:-1] == 1) & (buf[np.minimum(self.end[:-1], len(buf) - 1)] == 0x20)

    def places(self, k: int) -> np.ndarray:
        """For each word whether a phrase of k words begins there."""
        n = max(0, len(self.hash) - k + 1)
        out = np.ones(n, bool)
        for j in range(k - 1):
            out &= self.near[j : j + n]
        return out

    def phrases(self, at: np.ndarray, k: int) -> list[bytes]:
        plain = np.ones(len(at), bool)
        for j in range(k - 1):
            plain &= self.plain[at + j]
        text = self.text
        found = [text[a:b] for a, b in zip(self.start[at].tolist(), self.end[at + k - 1].tolist())]
        for i in np.flatnonzero(~plain).tolist():
            found[i] = _SPACES.sub(b" ", found[i])
        return found


def _counter(k: int, frequent):
    """Counts phrases of k words: (lang, phrase, n); at level 1 a null phrase has the language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        totals: Counter = Counter()
        bits = np.frombuffer(frequent.value, np.uint8) if frequent else None

        def flush() -> pa.RecordBatch:
            rows = [(lang, None, n) for lang, n in totals.items()]
            langs, phrases, counts = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
            for lang, c in held.items():
                langs += [lang] * len(c)
                phrases += c
                counts += c.values()
            held.clear()
            totals.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])

        def words(b: pa.RecordBatch, langs: list[str]) -> Iterator[tuple[str, list[bytes]]]:
            texts = b.column("text").cast(pa.binary())
            for i, lang in enumerate(langs):
                found = texts[i].as_py().translate(_WORDS).split()
                totals[lang] += len(found)
                yield lang, found

        def passing(b: pa.RecordBatch, langs: list[str]) -> Iterator[tuple[str, list[bytes]]]:
            g = Grams(b.column("text"))
            sub = shingles(g.hash, k - 1)
            seeds = {lang: _seed(lang) for lang in set(langs)}
            of = np.repeat(np.array([seeds[x] for x in langs], np.uint64), np.diff(g.bounds))
            bit = _bits(sub, of[: len(sub)])
            on = (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            at = np.flatnonzero(g.places(k) & on[:-1] & on[1:]) if len(g.hash) >= k else np.zeros(0, np.int64)
            cuts = np.searchsorted(at, g.bounds)
            found = g.phrases(at, k)
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                yield langs[i], found[cuts[i] : cuts[i + 1]]

        size = 0
        for b in pieces(batches):
            for lang, found in (words if k == 1 else passing)(b, b.column("lang").to_pylist()):
                c = held.setdefault(lang, Counter())
                before = len(c)
                c.update(found)
                size += len(c) - before
                if size > ENTRIES:
                    yield flush()
                    size = 0
        if held or totals:
            yield flush()

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit of each phrase, as ``passing`` looks it up."""
    for b in pieces(batches, "phrase"):
        h, bounds = word_hashes(b.column("phrase"), _LUT)
        k = np.diff(bounds)
        out = np.zeros(b.num_rows, np.uint64)
        for n in np.unique(k).tolist():
            rows = np.flatnonzero(k == n)
            one = h[bounds[rows][:, None] + np.arange(n)]
            x = one[:, 0].copy()
            for j in range(1, n):
                x = chained(x, one[:, j])
            out[rows] = x
        seeds = {lang: _seed(lang) for lang in set(b.column("lang").to_pylist())}
        of = np.array([seeds[x] for x in b.column("lang").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(_bits(out, of))], ["bit"])


def bitmap(spark: SparkSession, level: DataFrame) -> bytes:
    """BITS bits over (lang, phrase); at most BITS / 32768 rows of 4 kB come to the driver."""
    bit = F.col("bit") + 1
    marks = level.select("lang", "phrase").mapInArrow(_marked, "bit long")
    rows = marks.groupBy(F.bitmap_bucket_number(bit).alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        at = (r["cell"] - 1) * _CELL // 8
        out[at : at + _CELL // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def levels(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> list[DataFrame]:
    """Tables (lang, phrase, n) of the frequent phrases of 1 to ``words`` words; the first has each language's words too, phrase null."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    out: list[DataFrame] = []
    for k in range(1, words + 1):
        sent = spark.sparkContext.broadcast(bitmap(spark, out[-1].where("phrase IS NOT NULL"))) if out else None
        found = rows.mapInArrow(_counter(k, sent), "lang string, phrase string, n long")
        found = found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull())
        out.append(materialize(found, f"phrases-{k}"))
        if sent:
            sent.unpersist()
    return out


def _score(a: str, left: str, right: str) -> Column:
    wide = f"cast({SCALE} AS decimal(7,0)) * cast({a} AS decimal(15,0)) * cast({a} AS decimal(15,0))"
    return F.expr(f"({wide}) div (cast({left} AS decimal(19,0)) * cast({right} AS decimal(19,0)))")


def _part(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def scored(tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every candidate, by its lowest-scoring cut."""
    every = tables[0].where("phrase IS NOT NULL")
    for t in tables[1:]:
        every = every.unionByName(t)
    cuts = []
    for k, t in enumerate(tables[1:], 2):
        rows = t.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
        for c in range(1, k):
            cuts.append(rows.select("lang", "phrase", "a", F.lit(c).alias("k"), _part(1, c).alias("head"), _part(c + 1, k - c).alias("rest")))
    rows = cuts[0]
    for more in cuts[1:]:
        rows = rows.unionByName(more)
    every = small(every)
    rows = rows.join(every.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    rows = rows.join(every.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    rows = rows.withColumn("score", _score("a", "l", "r"))
    best = rows.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def inside(tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, longer): the largest count of a phrase one word longer around each phrase."""
    rows = []
    for k, t in enumerate(tables[2:], 3):
        w = t.select("lang", "n", F.split("phrase", " ").alias("w"))
        rows.append(w.select("lang", "n", F.explode(F.array_distinct(F.array(_part(1, k - 1), _part(2, k - 1)))).alias("phrase")))
    if not rows:
        return tables[0].where("false").select("lang", "phrase", F.col("n").alias("longer"))
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, percent: int = INSIDE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``words`` words."""
    if words < 2:
        raise ValueError("a phrase has two words or more")
    with scratch(docs.sparkSession):
        tables = levels(docs, words, least)
        rows = scored(tables).join(inside(tables), ["lang", "phrase"], "left")
        rows = rows.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent))
        order = [F.desc("score"), F.desc("a"), F.col("phrase")]
        salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        n = tables[0].where("phrase IS NULL").select("lang", "n")
        result = materialize(rows.join(small(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)
    return result
