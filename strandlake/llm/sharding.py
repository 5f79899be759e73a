"""Operator 2: sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring of ``cells`` cells; a row's cell is a hash of its key.  Rows are counted by
cell (a table bounded by ``cells``, the only thing the driver sees), and the driver lets whole ranges of a cell's rows
walk clockwise from full shards to the next one with room.  What comes out are ranges (cell, rows from..to -> shard, first
slot), at most cells + splits of them, which are broadcast.  A row's rank inside its cell then fixes shard and slot.  Ranks
follow from key and content alone, whatever the input's splits: a cell's rows are ordered by digest, in blocks, so that a
window never holds all of a hot cell.

With ``slack`` 0 the counts of any two shards differ by one at most; a larger slack trades balance for less movement.
Defined cases: rows with a null key are dealt over the cells by size and text; a key with many rows fills its shard and goes on
clockwise; repeated rows are interchangeable and each gets a slot (``shard`` counts them before they are numbered, so they may
be a third of all rows); very long texts only count by their size; an empty table gives an empty table; input columns named
shard, slot, size or text_crc32 are replaced, other names don't matter.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_rows, materialize, without

SHARDS, VNODES, CELLS = 24, 64, 1 << 14
#: Blocks that a cell's rows are numbered in, and parts that equal rows are counted in.
BLOCKS, STRETCHES = 64, 64


def ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """Sorted (cell, shard) points; two virtual nodes never share a cell."""
    if shards * vnodes > cells:
        raise ValueError("the ring needs a cell for each virtual node")
    taken: dict[int, int] = {}
    for v in range(vnodes):
        for s in range(shards):
            at = int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:8], 16) % cells
            while at in taken:
                at = (at + 1) % cells
            taken[at] = s
    return sorted(taken.items())


def place(counts: dict[int, int], shards: int, vnodes: int, cells: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(cell, from, to, shard, first slot) for rows ranked 0.. inside their cells."""
    points = ring(shards, vnodes, cells)
    total, m = sum(counts.values()), len(points)
    arcs: list[list[list[int]]] = [[] for _ in points]
    i = 0
    for cell in sorted(counts):
        while i < m and points[i][0] < cell:
            i += 1
        arcs[i % m].append([cell, 0, counts[cell]])
    wanted = [0] * shards
    for a, (_, s) in zip(arcs, points):
        wanted[s] += sum(t for _, _, t in a)
    base, more = divmod(total, shards)
    if slack > 0:
        room = [max(base + 1, int(-(-(1 + slack) * total // shards)))] * shards
    else:
        first = sorted(range(shards), key=lambda s: (-wanted[s], s))[:more]
        room = [base + (s in first) for s in range(shards)]
    used, out = [0] * shards, []
    waiting = [(a, arc) for a, arc in enumerate(arcs) if arc]
    for step in range(m):
        still = []
        for a, arc in waiting:
            s = points[(a + step) % m][1]
            left = []
            for cell, lo, hi in arc:
                take = min(hi - lo, room[s] - used[s])
                if take:
                    out.append((cell, lo, lo + take, s, used[s]))
                    used[s] += take
                if lo + take < hi:
                    left.append([cell, lo + take, hi])
            if left:
                still.append((a, left))
        waiting = still
        if not waiting:
            break
    return out


def _cell(key: str, sums: list[str], cells: int) -> Column:
    """The cell of a key; without one, that of size and text."""
    name = F.xxhash64(F.col(key))
    return F.pmod(F.when(F.col(key).isNull(), F.xxhash64(*sums)).otherwise(name) if sums else name, F.lit(cells)).cast("int")


def _numbered(rows: DataFrame, counts: DataFrame, shards: int, vnodes: int, cells: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """(the walk's ranges, offsets of blocks in their cells) from ``counts`` (__c, __b, n), which is written."""
    held = {r["__c"]: r["n"] for r in counts.groupBy("__c").agg(F.sum("n").alias("n")).collect()}  # at most `cells` rows
    plan = place(held, shards, vnodes, cells, slack)
    made = json.dumps([dict(zip(("__cell", "__lo", "__hi", "__shard", "__slot"), p)) for p in plan])
    ranges = literal_rows(rows.sparkSession, made, "__cell:int,__lo:bigint,__hi:bigint,__shard:int,__slot:bigint")
    before = Window.partitionBy("__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most `blocks` rows
    offsets = counts.select(F.col("__c").alias("__oc"), F.col("__b").alias("__ob"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__off"))
    return ranges, offsets


def _placed(ranked: DataFrame, ranges: DataFrame, keep: list[str]) -> DataFrame:
    out = ranked.join(F.broadcast(ranges), F.expr("__c = __cell AND __rank >= __lo AND __rank < __hi"))
    slot = F.col("__slot") + F.col("__rank") - F.col("__lo")
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("__shard").alias("shard"), slot.alias("slot"))


def assign(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS, slack: float = 0.0, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with shard and slot (gapless from 0 in each shard); only rows equal in all columns are numbered by chance, and together."""
    docs = without(docs, "shard", "slot")
    sums = [x for x in ("text_crc32", "size") if x in docs.columns]
    every = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    digest = F.xxhash64(F.lit(2), *every)
    dealt = docs.withColumns({"__c": _cell(key, sums, cells), "__e": digest, "__b": F.pmod(digest, F.lit(blocks)).cast("int")})
    counts = materialize(dealt.groupBy("__c", "__b").agg(F.count("*").alias("n")), "counts")
    ranges, offsets = _numbered(docs, counts, shards, vnodes, cells, slack)
    inner = Window.partitionBy("__c", "__b").orderBy("__e", key, *sums)
    ranked = dealt.withColumn("__rank", F.row_number().over(inner).cast("long") - 1)
    ranked = ranked.join(offsets, F.expr("__c = __oc AND __b = __ob")).withColumn("__rank", F.col("__rank") + F.col("__off"))
    return _placed(ranked, ranges, docs.columns)


def with_size(docs: DataFrame) -> DataFrame:
    """Adds size (UTF-8 bytes of the text plus 8; null: 8) and text_crc32 (of the UTF-8 bytes; null counts as empty)."""
    docs = without(docs, "size", "text_crc32")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"size": F.octet_length(text).cast("long") + 8, "text_crc32": F.crc32(text)})


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS, slack: float = 0.0, blocks: int = BLOCKS) -> DataFrame:
    """One row a document without its text: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal rows are one entry with a count (in up to STRETCHES parts), and an entry's ranks follow one another.
    """
    names = ["doc_id", "size", "text_crc32"]
    keys = with_size(docs.select("doc_id", "text")).drop("text")
    digest = F.xxhash64(F.lit(2), *names)
    keys = keys.withColumns({"__c": _cell("doc_id", names[1:], cells), "__b": F.pmod(digest, F.lit(blocks)).cast("int"), "__e": digest})
    entries = keys.groupBy("__c", "__b", "__e", *names, F.pmod(F.monotonically_increasing_id(), F.lit(STRETCHES)).alias("__s")).agg(F.count("*").alias("n"))
    entries = materialize(entries, "entries")
    counts = materialize(entries.groupBy("__c", "__b").agg(F.sum("n").alias("n")), "counts")
    ranges, offsets = _numbered(docs, counts, shards, vnodes, cells, slack)
    inner = Window.partitionBy("__c", "__b").orderBy("__e", *names, "__s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = entries.withColumn("__first", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(offsets, F.expr("__c = __oc AND __b = __ob"))
    zero, step = F.lit(0).cast("long"), F.lit(1 << 16).cast("long")
    ranked = ranked.withColumn("__at", F.explode(F.sequence(zero, F.col("n") - 1, step)))
    ranked = ranked.withColumn("__i", F.explode(F.sequence(F.col("__at"), F.least(F.col("__at") + step, F.col("n")) - 1)))
    out = _placed(ranked.withColumn("__rank", F.col("__off") + F.col("__first") + F.col("__i")), ranges, names)
    return out.select(*names, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, **options) -> DataFrame:
    """Whole documents with size, text_crc32, shard and slot; only rows that are equal in all columns are numbered together."""
    return assign(with_size(docs), **options)
