"""Operator 6: n-gram Jaccard join by T-occurrence search.

A document is the set of its distinct shingles of ``words`` words.  Two documents link when the Jaccard similarity of their
sets is at least ``percent``/100; the result is each document's connected component.  Operator 6 has 4 words and 85, the
pipeline's near-duplicate stage 5 and 80.

1. Equal sets collapse onto one representative (a digest of the set is the key).
2. In one order of all shingles, rare before frequent, linked sets share a shingle among the first ``n - ceil(percent
   n / 100) + 1`` of each, and with ``EXTRA`` more of each that many more.  These prefixes make the inverted lists; lists of
   one member go.  The order needs no exact
   counts: frequent shingles, at most ``HOT`` of them, come last by count, the rest lie before them by hash.
3. Families first: the members of every list stand in one order, the same in all lists, and neighbours that are so in
   several lists are tried.  A family of copies thus falls together with about as many trials as members.
4. The search, exact: representatives in lists that hold several components are dealt to index blocks of bounded size,
   with about twice their prefix (the head).  A representative visits the blocks in which as many of its lists as linked sets
   share at least have members of another component and similar size; there, lists of the block over its head are searched by DivideSkip: short ones
   heap-merged with skips, long ones binary-probed, and members whose overlap reaches the required T kept.  Heads have
   their own exact T: two linked sets share at least ``min(k_a - (n_a - t), k_b - (n_b - t))`` of their first k_a and k_b
   shingles, where t is the overlap that links them.
5. What is kept is verified on the whole sets, again by DivideSkip over the lists of a query's candidates.  Each visit gives
   its best ``BEST`` candidates of other components; as long as one had more, it is made again after the components were
   joined, with eight times as many, so no candidate stays untried unless it is in the query's component by then.

No list is gathered in one task, no list is joined with itself and no pair is made but those that a search keeps: a task
holds one index block (``BLOCK`` shingles or one document) and at most about ``VISITS`` visits.

Defined cases: null or wordless text has the empty set and is its own component; fewer than ``words`` words make one shingle;
repeated rows are equal sets; a null doc_id links like any other but never names a component unless all ids are null;
an empty table gives an empty table; very long texts are hashed stretch by stretch; of other columns none is read by
``join_components``, and ``one_of_each`` returns them as they came, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import json
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_rows, marked, marks, materialize, scratch, small, without
from .components import components
from .words import PLAIN, mix, pieces, shingles, word_hashes

WORDS = 4
PERCENT = 85
#: Frequent shingles that the order knows by count: 1.6 MB broadcast at most.  A smaller table only makes lists longer.
HOT = 200_000
#: Shingles that are counted at once, and the most counts that a task keeps between (lossy counting: the least go first).
HOT_PIECE, HOT_KEPT = 1 << 19, 1 << 18
#: Candidates verified together for one query.
GROUP = 256
#: Members of an inverted list that are put in order together.
CHUNK = 4096
#: Shingles of a prefix beyond those of which linked sets share one.
EXTRA = 3
#: Head shingles of an index block, visits of one task, and candidates that a visit gives in the first round.
BLOCK, VISITS, BEST = 1 << 21, 1 << 14, 16
#: Postings up to which short lists are merged by a heap, above by one stable sort; and long lists that are probed at once.
HEAPED, PROBED = 256, 32
#: Stands for a null doc_id inside.
_LAST = (1 << 63) - 1


def sets_of(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, bounds = word_hashes(texts, PLAIN)
    every = shingles(h, words)
    for i in range(len(bounds) - 1):
        lo, hi = bounds[i], bounds[i + 1]
        if hi - lo >= words:
            yield np.unique(every[lo : hi - words + 1])
        elif hi > lo:
            short = h[lo:hi]
            yield np.array([(int(short.sum(dtype=np.uint64)) * 31 + sum(int(x) * (7 + 2 * i) for i, x in enumerate(short)) + len(short)) % (1 << 64)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _count_hot(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(token, n) of the shingles that are frequent in this task's rows, by lossy counting; counts may be too low."""
    token, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []
    size = least = 0

    def merged() -> None:
        nonlocal token, count, least
        u, c = np.unique(np.concatenate(held), return_counts=True)
        at = np.minimum(np.searchsorted(u, token), len(u) - 1)
        known = u[at] == token
        c[at[known]] += count[known]
        keep = (c > least) & (c > 1)
        u, c, rest = u[keep], c[keep], ~known & (count > least)
        token, count = np.concatenate([u, token[rest]]), np.concatenate([c, count[rest]])
        if len(token) > HOT_KEPT:
            least = int(np.partition(count, len(count) - HOT_KEPT)[len(count) - HOT_KEPT])
            token, count = token[count > least], count[count > least]
        order = np.argsort(token)
        token, count = token[order], count[order]

    for b in pieces(batches):
        for s in sets_of(b.column("text"), words):
            if len(s):
                held.append(s)
                size += len(s)
            if size >= HOT_PIECE:
                merged()
                held, size = [], 0
    if held:
        merged()
    on = count > 2
    yield pa.RecordBatch.from_arrays([pa.array(token[on].view(np.int64)), pa.array(count[on])], ["token", "n"])


def hot_shingles(docs: DataFrame, words: int = WORDS, limit: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of frequent shingles, at most ``limit``; only a help for ordering."""
    texts = docs.select("text")
    # a task should see enough rows to tell what is frequent, however small the input's partitions are
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // 32)
    seen = texts.coalesce(tasks).mapInArrow(lambda batches: _count_hot(batches, words), "token long, n long")
    top = seen.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(limit).toArrow()
    token, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def lengths(n, percent: int = PERCENT):
    """Shingles of the prefix and of the head of a set of ``n`` > 0."""
    least = n - (percent * n + 99) // 100 + 1  # linked sets share one of these
    return np.minimum(n, least + EXTRA), np.minimum(n, np.maximum(2 * least - 1, least + EXTRA))


def shared_heads(n_a, n_b, percent: int = PERCENT, part: int = 1):
    """Shingles that the heads (``part`` 0: the prefixes) of linked sets of these sizes share at least."""
    t = required(n_a, n_b, percent)
    return np.maximum(1, np.minimum(lengths(n_a, percent)[part] - n_a + t, lengths(n_b, percent)[part] - n_b + t))


def _shared_lists(n, percent: int):
    """Lists that a set of ``n`` shares with any set that links with it, at least."""
    few = [1] + [int(shared_heads(k, np.arange(-(-percent * k // 100), 100 * k // percent + 1), percent, 0).min()) for k in range(1, 200)]
    return F.when(n < len(few), F.get(F.array(*map(F.lit, few)), n.cast("int"))).otherwise(min(few[100:]))


@functools.lru_cache(1 << 14)
def _partners(n: int, percent: int) -> tuple[int, int, int]:
    """Least and greatest size that links with a set of ``n``, and the least T of heads over all of them."""
    low, high = -(-percent * n // 100), 100 * n // percent
    return low, high, int(shared_heads(n, np.arange(low, high + 1), percent).min())


def signatures(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, digest, n, d1, d2 (of the set), prefix, head (32 bits a shingle): one row a document."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_token, hot_count = shared.value
        for b in pieces(batches):
            n, d1, d2, prefix, head = [], [], [], [], []
            for s in sets_of(b.column("text"), words):
                n.append(len(s))
                x, y = _digests(s)
                d1.append(x)
                d2.append(y)
                p, k = lengths(len(s), percent) if len(s) else (0, 0)
                if len(hot_token) and len(s):
                    at = np.minimum(np.searchsorted(hot_token, s), len(hot_token) - 1)
                    rank = np.where(hot_token[at] == s, hot_count[at], 0)
                    s = s[np.argsort(rank, kind="stable")[:k]]
                prefix.append(s[:p].view(np.int64))
                head.append(s[:k].astype(np.uint32).tobytes())
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            cols = [b.column("doc_id"), b.column("key"), b.column("digest"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists, pa.array(head, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "digest", "n", "d1", "d2", "prefix", "head"])

    schema = "doc_id long, key long, digest long, n long, d1 long, d2 long, prefix array<long>, head binary"
    return docs.select("doc_id", "key", "digest", "text").mapInArrow(run, schema)


def _long_lists(hot: tuple[np.ndarray, np.ndarray]) -> str:
    """The frequent shingles whose lists are dealt over chunks, as JSON; at most HOT, and few in practice."""
    on = hot[1] > CHUNK
    return json.dumps([{"token": t, "chunks": n // CHUNK + 1} for t, n in zip(hot[0][on].view(np.int64).tolist(), hot[1][on].tolist())])


def required(n_a, n_b, percent: int = PERCENT):
    """Least overlap of linked sets of these sizes."""
    return (percent * (n_a + n_b) + 99 + percent) // (100 + percent)


def merge_skip(lists: list[np.ndarray], floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of the ids in at least ``floor`` of the sorted ``lists``.

    A heap holds each list's next id.  Where fewer than ``floor`` lists stand at the least id, the ``floor - 1`` least ones
    are popped and skip to the id that is then on top: nothing before it can be in ``floor`` lists.  Many postings are merged
    by one stable sort of all lists side by side instead (a merge of its sorted runs), and counted as runs.
    """
    if len(lists) < floor:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if sum(map(len, lists)) > HEAPED:
        run = np.sort(np.concatenate(lists), kind="stable")
        ids, counts = np.unique(run, return_counts=True)
        return ids[counts >= floor], counts[counts >= floor]
    short = [x.tolist() for x in lists]
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    ids, counts = [], []
    while len(heap) >= floor:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= floor:
            ids.append(top)
            counts.append(len(popped))
            after = top + 1
        else:
            while heap and len(popped) < floor - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            after = max(top + 1, heap[0][0])
        for _, i, j in popped:
            j = bisect_left(short[i], after, j)
            if j < len(short[i]):
                heapq.heappush(heap, (short[i][j], i, j))
    return np.array(ids, np.int64), np.array(counts, np.int64)


class Lists:
    """Inverted lists over a few sets of hashes: the sets' positions in order, by hash."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        size = np.array([len(x) for x in sets], np.int64)
        token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(token, kind="stable")
        token = token[order]
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        self.sets, self.owner = max(1, len(sets)), np.repeat(np.arange(len(sets), dtype=np.int32), size)[order]
        self.token, self.start = token[first], np.append(np.flatnonzero(first), len(token))
        #: number of the list and position in one, in order: a probe of many lists is one search
        self.posting = (np.cumsum(first) - 1) * self.sets + self.owner

    def of(self, query: np.ndarray) -> np.ndarray:
        """Numbers of the lists of the query's hashes that have one."""
        if not len(self.token):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        return at[self.token[at] == query]

    def holds(self, lists: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How many of ``lists`` have each of ``ids``, by binary search."""
        want = (lists[:, None] * self.sets + ids[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.posting, want), len(self.posting) - 1)
        return (self.posting[at] == want).reshape(len(lists), len(ids)).sum(axis=0)


def divide_skip(index: Lists, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of the sets that share at least ``least`` (> 0) hashes with ``query``: short lists merged, long ones probed."""
    lists = index.of(query)
    if len(lists) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = lists[np.argsort(index.start[lists + 1] - index.start[lists], kind="stable")]
    longest = int(index.start[lists[-1] + 1] - index.start[lists[-1]])
    skip = min(least - 1, int(least / (0.0085 * math.log2(max(2, longest)) + 1)))
    short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
    ids, counts = merge_skip([index.owner[a:b] for a, b in zip(index.start[short].tolist(), index.start[short + 1].tolist())], least - skip)
    for at in range(0, skip, PROBED):
        if not len(ids):
            break
        counts = counts + index.holds(long[at : at + PROBED], ids)
        on = counts + max(0, skip - at - PROBED) >= least
        ids, counts = ids[on], counts[on]
    return ids, counts


def _binary(column: pa.Array, kind: type) -> list[np.ndarray]:
    """Views of a binary column's values; not to be kept beyond its batch."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    return [np.frombuffer(data, kind, (b - a) // kind().itemsize, a) if b > a else np.zeros(0, kind) for a, b in zip(at, at[1:])]


def _pairs(a: list[int], b: list[int], more: list[bool] | None = None) -> pa.RecordBatch:
    cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64())] + ([] if more is None else [pa.array(more, pa.bool_())])
    return pa.RecordBatch.from_arrays(cols, ["a", "b"] + ([] if more is None else ["more"]))


class Block:
    """An index block: heads of representatives, searched for the candidates of one query at a time."""

    def __init__(self, ids: list[int], sizes: list[int], roots: list[int], heads: list[np.ndarray], percent: int) -> None:
        self.ids, self.n, self.root = np.array(ids, np.int64), np.array(sizes, np.int64), np.array(roots, np.int64)
        self.percent, self.lists = percent, Lists(heads)

    def search(self, query: np.ndarray, me: int, n: int, root: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, shared) of members of other components that may link, most shared first."""
        low, high, least = _partners(n, self.percent)
        at, shared = divide_skip(self.lists, query, least)
        on = (self.n[at] >= low) & (self.n[at] <= high) & (self.ids[at] != me) & (self.root[at] != root)
        at, shared = at[on], shared[on]
        on = shared >= shared_heads(n, self.n[at], self.percent)
        at, shared = at[on], shared[on]
        order = np.lexsort((self.ids[at], -shared))
        return self.ids[at[order]], shared[order]


def _visited(batches: Iterator[pa.RecordBatch], percent: int, best: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, kind, id, n, root, head), members (kind 0) of a block before its visits -> (a, b, more)."""
    key = block = None
    rows: tuple[list, list, list, list] = ([], [], [], [])
    a_out: list[int] = []
    b_out: list[int] = []
    more: list[bool] = []
    for batch in batches:
        heads = _binary(batch.column("head"), np.uint32)
        names = ("block", "part", "kind", "id", "n", "root")
        for (x, y, kind, me, n, root), head in zip(zip(*(batch.column(c).to_pylist() for c in names)), heads):
            if (x, y) != key:
                key, block, rows = (x, y), None, ([], [], [], [])
            if kind == 0:
                for held, v in zip(rows, (me, n, root, head.copy())):
                    held.append(v)
                continue
            if block is None:
                block = Block(*rows, percent)
                rows = ([], [], [], [])
            found, _ = block.search(head, me, n, root)
            a_out += [me] * min(best, len(found))
            b_out += found[:best].tolist()
            more += [len(found) > best] * min(best, len(found))
        if len(a_out) > 10_000:
            yield _pairs(a_out, b_out, more)
            a_out, b_out, more = [], [], []
    yield _pairs(a_out, b_out, more)


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, g, n, b, set) by (a, g, b), the query itself first (b null) -> the (a, b) that link."""
    a_out: list[int] = []
    b_out: list[int] = []
    key = query = None
    size, ids, sets, need = 0, [], [], []

    def finish() -> None:
        if ids:
            at, shared = divide_skip(Lists(sets), query, min(need))
            on = at[shared >= np.array(need, np.int64)[at]].tolist()
            a_out.extend([key[0]] * len(on))
            b_out.extend(ids[i] for i in on)

    for batch in batches:
        for (a, g, n, b), held in zip(zip(*(batch.column(c).to_pylist() for c in ("a", "g", "n", "b"))), _binary(batch.column("set"), np.uint64)):
            if (a, g) != key or len(ids) >= GROUP:
                finish()
                key, ids, sets, need = (a, g), [], [], []
            if b is None:
                query, size = held.copy(), n
            else:
                ids.append(b)
                sets.append(held.copy())
                need.append(required(size, n, percent))
        if len(a_out) > 10_000:
            yield _pairs(a_out, b_out)
            a_out, b_out = [], []
    finish()
    yield _pairs(a_out, b_out)


def _digests(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed integers."""
    if not len(s):
        return 0, 0
    d = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s))], np.uint64).view(np.int64)
    return int(d[0]), int(d[1])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        sets = list(sets_of(b.column("text"), words))
        d = [_digests(s) for s in sets]
        cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()), pa.array([y for _, y in d], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["n", "d1", "d2", "set"])


_SAME = ["n", "d1", "d2"]


def linked(trials: DataFrame, reps: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of ``trials`` (a, b) that link, by T-occurrence search over the shingles of their documents."""
    ends = trials.select(F.col("a").alias("id")).union(trials.select(F.col("b").alias("id"))).distinct()
    ends = materialize(reps.join(ends, "id").select("id", *_SAME, F.col("least").alias("key")), "ends")
    texts = marked(docs.select("key", "text"), ["key"], materialize(marks(ends, ["key"]), "marks"), "__on").where("__on").select("text")
    sets = texts.mapInArrow(lambda batches: _sets(batches, words), "n long, d1 long, d2 long, set binary").dropDuplicates(_SAME)
    sets = materialize(sets.join(ends, _SAME).select("id", "n", "set"), "sets")
    many = F.floor(F.count("*").over(Window.partitionBy("a")) / GROUP) + 1
    rows = trials.withColumn("g", F.pmod(F.xxhash64("b"), many))
    found = rows.join(sets.withColumnRenamed("id", "b"), "b").select("a", "g", "n", "b", "set")
    asked = rows.select("a", "g").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "g", "n", F.lit(None).cast("long").alias("b"), "set")
    rows = asked.union(found).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())
    return rows.mapInArrow(lambda batches: _verified(batches, percent), "a long, b long")


def _postings(sig: DataFrame, reps: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, id, n, chunk, chunks, last): the inverted lists of two and more members, each with the one before it.

    Long lists are dealt over chunks; the first of a chunk follows no one here.  All lists are in one order, so copies follow
    one another in each of their lists.
    """
    long = literal_rows(sig.sparkSession, _long_lists(hot), "token:bigint,chunks:bigint")
    rows = sig.where("n > 0").select("id", "n", "prefix")
    copies = materialize(marks(rows.select("id").join(reps.select("id"), "id", "left_anti"), ["id"]), "marks")
    rows = marked(rows, ["id"], copies, "__some")  # most rows are sure to be representatives and aren't joined
    rows = rows.where("NOT __some").unionByName(rows.where("__some").join(reps.select("id"), "id", "left_semi"))
    rows = rows.select("id", "n", F.explode("prefix").alias("token"))
    rows = rows.join(F.broadcast(long), "token", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks"))
    over = Window.partitionBy("token", "chunk").orderBy(F.xxhash64("id"), "id")
    rows = rows.withColumns({"last": F.lag("id").over(over), "next": F.lead("id").over(over)})
    return materialize(rows.where("last IS NOT NULL OR next IS NOT NULL OR chunks > 1").drop("next"), "postings")


def _neighbours(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): members that follow one another in two thirds of their lists or more; chunks of long lists by their first."""
    first = postings.where("chunks > 1 AND last IS NULL").select("token", "chunk", "id", "n")
    first = first.select("id", "n", F.lag("id").over(Window.partitionBy("token").orderBy("chunk")).alias("last"))
    near = postings.select("id", "n", "last").union(first).where("last IS NOT NULL")
    near = near.groupBy(F.least("id", "last").alias("a"), F.greatest("id", "last").alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("n"))
    return near.where(300 * F.col("k") >= 2 * (100 - percent) * F.col("n")).select("a", "b")


def _mixed(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, id, n, root, asks) of the lists that hold several components; all but the largest one's members ask."""
    rows = postings.select("token", "id", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = rows.groupBy("token", "root").agg(F.count("*").alias("k"))
    lists = sizes.groupBy("token").agg(F.count("*").alias("several"), F.max_by("root", F.struct("k", "root")).alias("major")).where("several > 1")
    rows = rows.join(lists.select("token", "major"), "token")
    return materialize(rows.select("token", "id", "n", "root", (F.col("root") != F.col("major")).alias("asks")), "mixed")


def _band(percent: int) -> Callable:
    """Size class: sizes that may link are in one class or in neighbouring ones."""
    step = math.log(100 / (percent - 1))
    return lambda n: F.floor(F.log(n) / step).cast("int")


def _index(mixed: DataFrame, percent: int) -> DataFrame:
    """(id, n, root) of the members of ``mixed`` that are in as many of its lists as linked sets share at least."""
    rows = mixed.groupBy("id").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.count("*").alias("k"))
    return materialize(rows.where(F.col("k") >= _shared_lists(F.col("n"), percent)).drop("k"), "index")


def _blocks(index: DataFrame, percent: int) -> DataFrame:
    """(band, many): the size classes with their numbers of blocks of about BLOCK head shingles, a row each."""
    k = F.least("n", F.ceil(F.col("n") * (200 - 2 * percent) / 100) + 1)
    return small(index.groupBy(_band(percent)(F.col("n")).alias("band")).agg((F.floor(F.sum(k) / BLOCK) + 1).alias("many")))


def _dealt(rows: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Adds band and block of each row's id."""
    return rows.withColumn("band", _band(percent)("n")).join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("id"), "many")).drop("many")


def _visits(mixed: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(band, block, id): the blocks in which an asking member shares enough lists with members of other components."""
    places = _dealt(mixed, blocks, percent).groupBy("token", "band", "block").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
    asks = mixed.select("token", "id", "root", "asks", "n", _band(percent)(F.col("n")).alias("own"))
    met = asks.join(places, "token").where("abs(own - band) <= 1 AND (r1 <> root OR r2 <> root)")
    # of two members of one list at least one asks; it counts all lists that it shares with a block
    met = met.groupBy("band", "block", "id").agg(F.count("*").alias("k"), F.bool_or("asks").alias("asks"), F.first("n").alias("n"))
    return met.where(F.col("asks") & (F.col("k") >= _shared_lists(F.col("n"), percent))).select("band", "block", "id")


def _candidates(mixed: DataFrame, index: DataFrame, sig: DataFrame, roots: DataFrame, percent: int, best: int, again: DataFrame | None) -> DataFrame:
    """(a, b, more): what the visits of all asking members keep; of those in ``again`` with their new ``roots``, if given.

    All is decided on narrow rows first; heads then go once to where their owner is a member or visits.
    """
    if again is not None:  # only lists of these, with the components as they are now, and only their members
        named = lambda df: df.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        tokens = small(mixed.join(small(again), "id", "left_semi").select("token").distinct(), 100_000)
        mixed = named(mixed.join(tokens, "token", "left_semi")).drop("asks").join(small(again.withColumn("asks", F.lit(True))), "id", "left")
        mixed = materialize(mixed.withColumn("asks", F.coalesce("asks", F.lit(False))), "mixed")
        index = materialize(named(index.join(mixed.select("id").distinct(), "id", "left_semi")), "index")
    blocks = _blocks(index, percent)
    visits = _visits(mixed, blocks, percent)
    visits = materialize(visits, "visits")
    per = small(visits.groupBy("band", "block").agg((F.floor(F.count("*") / VISITS) + 1).cast("int").alias("parts")))
    members = _dealt(index, blocks, percent).join(per, ["band", "block"]).select("band", "block", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    asked = visits.join(per, ["band", "block"]).select("band", "block", "id", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"))
    name = F.col("band").cast("long") * (1 << 32) + F.col("block")
    to = members.union(asked).groupBy("id").agg(F.collect_list(F.struct(name.alias("block"), "part", "kind")).alias("to"))
    to = materialize(to.join(index.select("id", "n", "root"), "id"), "to")
    heads = marked(sig.select("id", "head"), ["id"], materialize(marks(to, ["id"]), "marks"), "__on").where("__on").drop("__on")
    rows = heads.join(small(to, 100_000), "id").select("id", "n", "root", "head", F.explode("to").alias("t")).select("t.block", "t.part", "t.kind", "id", "n", "root", "head")
    rows = rows.repartition("block", "part").sortWithinPartitions("block", "part", "kind", "id")
    found = rows.mapInArrow(lambda batches: _visited(batches, percent, best), "a long, b long, more boolean")
    return materialize(found, "candidates")


def _members(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row a row of ``docs``: doc_id, key, digest (of its text), n, root (null: empty set), component_id (may be _LAST).

    A table of the shared folder that outlives the scope around by one; all others go before this returns.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key"), "text", F.xxhash64("text").alias("digest"))
    with scratch(docs.sparkSession):
        hot = hot_shingles(docs, words)
        sig = materialize(signatures(docs, hot, words, percent).withColumn("id", F.monotonically_increasing_id()), "signatures")
        reps = materialize(sig.where("n > 0").groupBy(*_SAME).agg(F.min("key").alias("least"), F.min("id").alias("id")), "reps")
        postings = _postings(sig, reps, hot)
        trials = materialize(_neighbours(postings, percent), "trials")
        links = materialize(linked(trials, reps, docs, words, percent), "links")
        roots = components(links)
        mixed = _mixed(postings, roots)
        index = _index(mixed, percent)
        best, again = BEST, None
        while True:
            found = _candidates(mixed, index, sig, roots, percent, best, again)
            pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            new = materialize(pairs.join(trials, ["a", "b"], "left_anti"), "trials")
            if not new.isEmpty():
                links = materialize(links.union(linked(new, reps, docs, words, percent)), "links")
                roots = components(links)
                trials = materialize(trials.union(new), "trials")
            again = materialize(found.where("more").select(F.col("a").alias("id")).distinct(), "again")
            if again.isEmpty():
                break
            best *= 8
        named = reps.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.join(least, "root").select(*_SAME, "root", "component_id")
        return materialize(sig.select("doc_id", "key", "digest", *_SAME).join(named, _SAME, "left").drop("d1", "d2"), "members", keep=True)


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles, component_id."""
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif(F.col("component_id"), F.lit(_LAST)))
    return _members(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with its own columns: that of the least doc_id (null last), then of the least text digest.

    Rows are told apart by doc_id and text, so rows that share an id, or have none, are decided on each for itself; of rows
    equal in both the one stays whose columns have the least hash.  Rows that nothing speaks against aren't shuffled.
    """
    cols = docs.columns
    mine = ["__key", "__digest"]
    with scratch(docs.sparkSession):
        rows = _members(docs, words, percent).withColumnsRenamed({"key": "__key", "digest": "__digest"})
        best = F.min(F.struct(*mine))
        keep = rows.where("n > 0").groupBy("root").agg(best.alias("k")).select("k.*").union(rows.where("n = 0").select(*mine)).distinct()
        keep = keep.withColumn("__keep", F.lit(True))
        doubt = rows.groupBy(*mine).agg(F.count("*").alias("k")).join(keep, mine, "left").where("k > 1 OR __keep IS NULL")
        doubt = materialize(doubt.select(*mine, F.coalesce("__keep", F.lit(False)).alias("__keep")), "doubtful", keep=True)
        table = materialize(marks(doubt, mine), "marks", keep=True)
    hashed = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    every = without(docs, *mine, "__some").withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "__digest": F.xxhash64("text")})
    every = marked(every, mine, table, "__some")
    some = every.where("__some").join(doubt, mine, "left").where(F.coalesce("__keep", F.lit(True)))
    order = [F.xxhash64(*[F.col(f"`{c}`") for c in hashed])]
    # the filter on the row number becomes a limit by group ahead of the shuffle: a task sends one row of an id and text
    some = some.withColumn("__again", F.row_number().over(Window.partitionBy(*mine).orderBy(*order))).where("__again = 1")
    names = [F.col(f"`{c}`") for c in cols]
    return every.where("NOT __some").select(*names).unionAll(some.select(*names))
