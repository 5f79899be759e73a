r"""Operator 11: source divergence audit, by inclusion and exclusion over the supports of term counts.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lowered.  Each language keeps the terms of at least ``least`` of
its documents.  Over them every (lang, source) group, and the language as a whole, has smoothed prices
p = 1 + floor(SCALE * (count + 1) / (N + V)), and f(p, q) = floor((p - q)^2 / q) measures how far p lies from q.

The sum of f over all kept terms of an ordered pair of groups (a, b) is never taken term by term.  It is split by support:

* terms of a, as if b had none of them: the histogram of a's counts, priced against b's price of a count of 0;
* terms of b likewise, against a's price of 0;
* terms of neither: a constant times their number;
* terms of both: postings of one term are joined, and what the three parts above say of it is replaced by its own f.

A histogram has few rows however large its group, and groups with the same price of 0 share one sum.  Only the overlaps cost a
row a term and pair, and those are summed before they are shuffled.

Counting is one scan: Arrow batches are split into terms as bytes, counted by group in a dictionary of at most ENTRIES
entries, so a hot term or source is combined before the shuffle; very long texts are taken in pieces.  Everything is integer
arithmetic, in decimals where products could pass 64 bits.

Defined cases: null text, lang and source are '', repeated rows count each; a group without terms, or a language without kept
terms, still gets its pairs (0 in the latter); equal values are ranked by the item's UTF-8 bytes; an empty table gives an
empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, small

LEAST, TOP = 3, 200
SCALE = 1_000_000_000
#: Distinct terms of a task's dictionaries, and bytes of one piece of a long text.
ENTRIES, PIECE = 200_000, 1 << 20

_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of bounded size."""
    text, at = text.translate(_TERM), 0
    while at < len(text):
        to = text.find(b" ", at + PIECE) if len(text) - at > PIECE else -1
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, terms repeated after each flush; a null term marks the group."""
    held: dict = {}
    names = ["lang", "source", "term", "n", "docs"]

    def flush() -> pa.RecordBatch:
        cols: list[list] = [[] for _ in names]
        for (lang, source), (n, docs) in held.items():
            size = len(n) + 1
            for col, more in zip(cols, ([lang] * size, [source] * size, [None, *n], [0, *n.values()], [0, *map(docs.__getitem__, n)])):
                col += more
        held.clear()
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names)

    size = 0
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for i, key in enumerate(zip(b.column("lang").to_pylist(), b.column("source").to_pylist())):
            n, docs = held.setdefault(key, (Counter(), Counter()))
            before, seen = len(n), set()
            for ts in terms(texts[i].as_py()):
                n.update(ts)
                seen.update(ts)
            docs.update(seen)
            size += len(n) - before + 1
            if size > ENTRIES:
                yield flush()
                size = 0
    if held:
        yield flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, lang_n, lang_docs): a group's count of each of its terms, its language's, and the documents
    of the language with it.  A row with a null term stands for every group."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    rows = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    rows = rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    return rows.select("lang", "source", "term", "n", F.sum("n").over(one).alias("lang_n"), F.sum("docs").over(one).alias("lang_docs"))


def _price(n: str, total: str, v: str) -> Column:
    return F.expr(f"1 + (cast({SCALE} AS decimal(38,0)) * ({n} + 1)) div greatest({total} + {v}, 1)")


def _far(p: str, q: str) -> Column:
    """f of two prices; both are at most SCALE + 1, so the square fits 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's other sources by distance, and the terms it prices above its language."""
    with scratch(docs.sparkSession):
        counts = materialize(term_counts(docs), "terms")
        kept = F.col("term").isNotNull() & (F.col("lang_docs") >= least)
        own = F.when(kept, F.col("n")).otherwise(0)
        sizes = counts.groupBy("lang", "source").agg(F.sum(own).alias("total"), F.count_if(kept).alias("support"))
        # a term's language count is spread over its sources once: each source's own count sums up to it
        langs = sizes.groupBy("lang").agg(F.sum("total").alias("lang_total"))
        first = F.row_number().over(Window.partitionBy("lang", "term").orderBy("source")) == 1
        vocabulary = counts.where(kept).withColumn("first", first).where("first").groupBy("lang").agg(F.count("*").alias("v"))
        groups = sizes.join(small(langs.join(vocabulary, "lang", "left")), "lang").fillna(0, ["v"])
        groups = materialize(groups.withColumn("zero", _price("0", "total", "v")), "groups")
        few = small(groups)
        priced = counts.where(kept).join(few, ["lang", "source"]).withColumn("p", _price("n", "total", "v"))
        postings = materialize(priced.select("lang", "source", "term", "n", "p", "zero", _price("lang_n", "lang_total", "v").alias("q")), "postings")
        result = materialize(_pairs(groups, few, postings).unionByName(_terms(postings, top)), "divergence", keep=True)
    return result


def _pairs(groups: DataFrame, few: DataFrame, postings: DataFrame) -> DataFrame:
    zeros = small(groups.select("lang", F.col("zero").alias("other")).distinct())
    prices = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    sided = prices.join(zeros, "lang").groupBy("lang", "source", "other").agg(
        F.sum(F.col("k") * _far("p", "other")).alias("against"), F.sum(F.col("k") * _far("other", "p")).alias("from")
    )
    a, b = (postings.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p{s}"), F.col("zero").alias(f"z{s}")) for s in "ab")

    def more(x: str, y: str) -> Column:
        return F.sum(_far(f"p{x}", f"p{y}") - _far(f"p{x}", f"z{y}") - _far(f"z{x}", f"p{y}") + _far(f"z{x}", f"z{y}"))

    both = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(more("a", "b").alias("ab"), more("b", "a").alias("ba"))
    both = both.select("lang", F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.col(x + y).alias("overlap")) for x, y in ("ab", "ba")])))
    other = few.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"), F.col("support").alias("other_support"))
    pairs = groups.join(other, "lang").where("source <> item")
    pairs = pairs.join(sided.select("lang", "source", "other", "against"), ["lang", "source", "other"], "left")
    pairs = pairs.join(sided.select("lang", F.col("source").alias("item"), F.col("other").alias("zero"), "from"), ["lang", "item", "zero"], "left")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").fillna(0, ["against", "from", "overlap"])
    neither = (F.col("v") - F.col("support") - F.col("other_support")) * _far("zero", "other")
    return _ranked(pairs.withColumn("value", F.col("against") + F.col("from") + neither + F.col("overlap")), "pair")


def _terms(postings: DataFrame, top: int) -> DataFrame:
    rows = postings.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), _far("p", "q").alias("value"))
    return _ranked(rows, "term").where(F.col("rank") <= top)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
