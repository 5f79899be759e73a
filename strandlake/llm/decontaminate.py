"""Operator 5: benchmark decontamination by SimHash of item-sized windows.

Window lengths come from a grid of word counts (every length under 8, then 8, 12, 16, 24, ... , 192).  An item is covered
by its first and its last window of the largest length that fits (over 192 words: by windows side by side), and every
document slides a window of each of these lengths over all its words, one word at a time.  A window's 64-bit fingerprint is
the bit majority over its words' hashes, from one running sum of bit planes a document, so all lengths share it.

Multi-index: the 64 bits are four blocks of 16.  Fingerprints within ``RADIUS`` = 7 agree in at least one block up to one
bit, so looking each block up in a table of the items' blocks and their one-bit neighbours misses none of them.  What is
found is verified exactly: the item's 5-word shingles against those of the document's words at the same place, as a
weighted Jaccard similarity (a shingle weighs ``ln(1 + items / items with it)``), 0.8 or more.

Many passages of that similarity lie further than the radius away or aren't of the item's size (trimmed, inserted, deleted or
substituted words), so items of five words or more also have anchors: their heaviest shingles, as many as weigh more than a
fifth of the item together.  A run of words without any of them shares less than 0.8 of the item's weight, so looking up every
shingle of a document misses none.  Around the anchors, runs of any length that start and end with a shingle of the item are
bounded by running sums of weights and, where the bound reaches 0.8, verified: words that were left out or put in shift nothing.
Items under five words are one shingle, which only equal words (distance 0) have.  Recall at 0.8 is thus whole.

The benchmark is a query set: it is broadcast in blocks of at most ``BLOCK_ITEMS`` items, all documents against each.  Weights
come from the whole benchmark first, in one aggregate: a shingle of a single item weighs as much as one of none, so only those
of two items or more are sent along with each block (more than ``COMMON`` of them, 128 MB, are an error).  So blocks and their
order make no difference to a similarity.

Defined cases: words are runs of letters, digits and non-ASCII characters, A-Z lowered; items or documents without words
match nothing; an item under five words is one shingle; repeated items and documents match each for itself; null ids stay
null; empty tables give an empty table; very long texts are scanned ``PIECE`` words at a time; other columns are not read by
``matches`` and kept by ``clean_documents``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked, marks, materialize, scratch, small
from .words import ALNUM, mix, pieces, shingles, word_hashes

WORDS, SIMILAR = 5, 0.8
#: What counts as that similar: sums of weights are not exact.
ENOUGH = SIMILAR - 1e-9
RADIUS = 7
LONGEST = 192
BLOCK_ITEMS, COMMON = 20_000, 8_000_000
#: Flags by which most shingles that are no anchor are told apart.
ANCHOR_FLAGS = 1 << 20
#: Words whose bit planes are in memory together.
PIECE = 16384


def window_length(words: int) -> int:
    """The largest length of the grid that fits into an item of so many words."""
    if words < 8:
        return words
    best = k = 8
    while k <= min(words, LONGEST):
        best = k
        if k * 3 // 2 <= min(words, LONGEST):
            best = k * 3 // 2
        k *= 2
    return best


def fingerprints(h: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(length, first word, fingerprints of the windows that start there and after), piece by piece."""
    longest = max(lengths)
    for at in range(0, len(h), PIECE):
        part = h[at : at + PIECE + longest - 1]
        planes = np.zeros((len(part) + 1, 64), np.uint8)
        np.cumsum(np.unpackbits(part.view(np.uint8)).reshape(-1, 64), axis=0, dtype=np.uint8, out=planes[1:])  # sums wrap; a window's don't
        for n in lengths:
            last = min(PIECE, len(part) - n + 1)
            if last > 0:
                ones = planes[n : n + last] - planes[:last]
                yield n, at, np.packbits(ones > n // 2, axis=1).view(np.uint64).ravel()


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Items:
    """A block of the benchmark: shingle weights, and the multi-index of its windows' fingerprints."""

    def __init__(self, ids: list[int | None], hashes: list[np.ndarray], known: tuple[int, np.ndarray, np.ndarray] | None = None) -> None:
        """``known``: items of the whole benchmark, its shingles of two items or more in order, and the items of each; else
        the block is the whole."""
        self.ids, self.words = ids, [len(h) for h in hashes]
        self.bags = [_bag(h) for h in hashes]
        n, self.known, count = known or (len(ids), *np.unique(np.concatenate([b[0] for b in self.bags] or [np.zeros(0, np.uint64)]), return_counts=True))
        self.weight = np.log1p(n / count)
        self.rare = float(np.log1p(n))
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i, h in enumerate(hashes):
            if not len(h):
                continue
            n = window_length(len(h))
            prints = np.concatenate([p for _, _, p in fingerprints(h, [n])])
            for off in sorted({*range(0, len(h) - n + 1, n), len(h) - n}):
                rows.setdefault(n, []).append((int(prints[off]), i, off))
        #: length -> (fingerprints, item, offset in the item, per block: lookup of 65536 flags, block values)
        self.index = {n: self._tables(v) for n, v in sorted(rows.items())}
        self.first = {i: (n, np.uint64(p)) for n, v in rows.items() for p, i, off in v if not off}
        #: per item its weight, and the weight of each of its shingles (in the order of its bag)
        self.own = [self.weights(b[0]) for b in self.bags]
        self.total = [float((w * b[1]).sum()) for w, b in zip(self.own, self.bags)]
        self.anchors = self._anchors()
        #: per item the shingles that a similar run may reach over on either side of an anchor
        least = float(self.weight.min(initial=self.rare)) or 1.0
        self.reach = np.array([n + int((1 / SIMILAR - 1) * t / least) + 1 for n, t in zip(self.words, self.total)], np.int64)

    def _anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flags, anchors in order, item of each): shingles of which a window that is similar to the item has one at least."""
        keys, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, (s, c) in enumerate(self.bags):
            if self.words[i] >= WORDS:
                order = np.argsort(-self.own[i], kind="stable")
                weight = np.cumsum((self.own[i] * c)[order])
                k = int(np.searchsorted(weight, (1 - SIMILAR) * self.total[i] * (1 + 1e-9), "right")) + 1
                keys.append(s[order[:k]])
                who.append(np.full(len(keys[-1]), i))
        key, item = np.concatenate(keys), np.concatenate(who)
        order = np.argsort(key, kind="stable")
        flags = np.zeros(ANCHOR_FLAGS, bool)
        flags[(key & np.uint64(ANCHOR_FLAGS - 1)).astype(np.int64)] = True
        return flags, key[order], item[order]

    def anchored(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) for all anchors among the shingles ``s``."""
        flags, key, item = self.anchors
        at = np.flatnonzero(flags[(s & np.uint64(ANCHOR_FLAGS - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(key, s[at], "left"), np.searchsorted(key, s[at], "right")
        k = hi - lo
        first = np.repeat(lo - (np.cumsum(k) - k), k)
        return np.repeat(at, k), item[first + np.arange(k.sum())]

    def distance(self, item: int, h: np.ndarray) -> int:
        """Bits between the item's first window and the words in its place."""
        n, own = self.first[item]
        bits = np.unpackbits(h[:n].view(np.uint8)).reshape(-1, 64).sum(axis=0)
        return int(_popcount(np.packbits(bits > len(h[:n]) // 2).view(np.uint64)[0] ^ own))

    @staticmethod
    def _tables(rows: list[tuple[int, int, int]]):
        prints = np.array([r[0] for r in rows], np.uint64)
        item, off = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        flags, near = [], []
        steps = np.array([0] + [1 << b for b in range(16)], np.int64)
        for b in range(4):
            v = (prints >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)
            keys = (v[:, None] ^ steps[None, :]).ravel()
            who = np.repeat(np.arange(len(rows)), len(steps))
            order = np.argsort(keys, kind="stable")
            keys, who = keys[order], who[order]
            on = np.zeros(1 << 16, bool)
            on[keys] = True
            flags.append(on)
            near.append((np.searchsorted(keys, np.arange((1 << 16) + 1)), who))
        return prints, item, off, flags, near

    def weights(self, s: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(s), self.rare)
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        return np.where(self.known[at] == s, self.weight[at], self.rare)

    def similarity(self, item: int, h: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and a run of words, as bags of shingles."""
        (a, ca), (b, cb) = self.bags[item], _bag(h)
        if not len(a) or not len(b):
            return 0.0
        every = np.union1d(a, b)
        x, y = np.zeros(len(every)), np.zeros(len(every))
        x[np.searchsorted(every, a)], y[np.searchsorted(every, b)] = ca, cb
        w = self.weights(every)
        return float((w * np.minimum(x, y)).sum() / (w * np.maximum(x, y)).sum())

    def within(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, row of the index, distance) for all pairs within the radius."""
        own, _, _, flags, near = self.index[n]
        blocks = prints.view(np.uint16).reshape(-1, 4)
        ws, rs = [], []
        for b in range(4):
            hit = np.flatnonzero(flags[b][blocks[:, b]])
            if not len(hit):
                continue
            starts, who = near[b]
            v = blocks[hit, b].astype(np.int64)
            k = starts[v + 1] - starts[v]
            first = np.repeat(starts[v] - np.concatenate([[0], np.cumsum(k)[:-1]]), k)
            r = who[first + np.arange(k.sum())]
            w = np.repeat(hit, k)
            ok = _popcount(prints[w] ^ own[r]) <= RADIUS
            ws.append(w[ok])
            rs.append(r[ok])
        if not ws:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.stack([np.concatenate(ws), np.concatenate(rs)]), axis=1)
        return pair[0], pair[1], _popcount(prints[pair[0]] ^ own[pair[1]]).astype(np.int64)


def _bag(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = shingles(h, WORDS) if len(h) >= WORDS else mix(shingles(h, len(h)) + np.uint64(len(h)))
    return np.unique(s, return_counts=True)


def _matches(h: np.ndarray, bounds: np.ndarray, items: Items) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(row, item) -> (similarity, first word in the row, distance), the best of each item in each row of a batch."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    tried = set()
    if not items.index or not len(h):
        return best
    for n, at, prints in fingerprints(h, list(items.index)):
        _, item, off, _, _ = items.index[n]
        w, r, d = items.within(n, prints)
        row = np.searchsorted(bounds, w + at, "right") - 1
        whole = w + at + n <= bounds[row + 1]  # windows over the end of a row are none
        for doc, i, start, dist in zip(row[whole].tolist(), item[r[whole]].tolist(), (w + at - off[r])[whole].tolist(), d[whole].tolist()):
            if (doc, i, start) in tried:
                continue
            tried.add((doc, i, start))
            lo = max(start, int(bounds[doc]))
            sim = items.similarity(i, h[lo : max(lo, min(start + items.words[i], int(bounds[doc + 1])))])
            first = lo - int(bounds[doc])
            if sim >= ENOUGH and ((doc, i) not in best or (sim, -first) > (best[doc, i][0], -best[doc, i][1])):
                best[doc, i] = (sim, first, dist)
    _anchored_matches(h, bounds, items, best)
    return best


def _anchored_matches(h: np.ndarray, bounds: np.ndarray, items: Items, best: dict[tuple[int, int], tuple[float, int, int]]) -> None:
    """Adds to ``best`` what all runs of words with an anchor give, whatever their length."""
    every = shingles(h, WORDS)
    at, item = items.anchored(every)
    row = np.searchsorted(bounds, at, "right") - 1
    whole = at + WORDS <= bounds[row + 1]
    at, item, row = at[whole], item[whole], row[whole]
    order = np.lexsort((at, item, row))
    at, item, row = at[order], item[order], row[order]
    reach = items.reach[item]
    cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(at) > reach[1:])) + 1 if len(at) else []
    for a, b in zip([0, *cut], [*cut, len(at)]) if len(at) else ():
        doc, i = int(row[a]), int(item[a])
        if best.get((doc, i), (0.0,))[0] > 1 - 1e-12:
            continue
        begin, end = int(bounds[doc]), int(bounds[doc + 1])
        first = max(int(at[a]) - int(reach[a]), begin)
        s = every[first : min(int(at[b - 1]) + int(reach[a]), end - WORDS) + 1]
        for lo, hi, bound in _aligned(s, items, i):
            if bound < best.get((doc, i), (ENOUGH, 0, 0))[0]:
                break
            run_of, start = h[first + lo : first + hi + WORDS], first + lo - begin
            sim = items.similarity(i, run_of)
            if sim >= ENOUGH and ((doc, i) not in best or (sim, -start) > (best[doc, i][0], -best[doc, i][1])):
                best[doc, i] = (sim, start, items.distance(i, run_of))


def _aligned(s: np.ndarray, items: Items, i: int) -> Iterator[tuple[int, int, float]]:
    """(first, last shingle, bound) of the runs of ``s`` that may be similar to item ``i``, the best bound first.

    A run that starts or ends with a foreign shingle is less similar than without it, so only runs between shared shingles
    are looked at: running sums of weights say which of them share enough and hold no more than they may.
    """
    bag, total = items.bags[i][0], items.total[i]
    near = np.minimum(np.searchsorted(bag, s), len(bag) - 1)
    on = bag[near] == s
    place = np.flatnonzero(on)
    shared, held = (np.append(0.0, np.cumsum(w)) for w in (np.where(on, items.own[i][near], 0.0), items.weights(s)))
    eps = 1e-8 * max(1.0, total)
    low = np.searchsorted(shared[place + 1], shared[place] + SIMILAR * total - eps, "left")
    high = np.searchsorted(held[place + 1], held[place] + total / SIMILAR + eps, "right")
    k = np.maximum(0, high - np.maximum(low, np.arange(len(place))))
    if not k.sum():
        return
    start = np.repeat(np.arange(len(place)), k)
    last = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(np.maximum(low, np.arange(len(place))), k)
    both = np.minimum(shared[place[last] + 1] - shared[place[start]], total)
    bound = both / (total + held[place[last] + 1] - held[place[start]] - both) + 1e-9
    keep = np.flatnonzero(bound >= ENOUGH)
    for x in keep[np.argsort(-bound[keep], kind="stable")].tolist():
        yield int(place[start[x]]), int(place[last[x]]), float(bound[x])


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks; rows stream to the driver one block at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    known = _known(rows)
    ids: list[int | None] = []
    texts: list[str | None] = []
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        if len(ids) == BLOCK_ITEMS:
            yield _items(ids, texts, known)
            ids, texts = [], []
    if ids:
        yield _items(ids, texts, known)


def _known(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(items, shingles of two items or more, items of each), of the whole benchmark."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            h, bounds = word_hashes(b.column("text"), ALNUM)
            s = [_bag(h[bounds[i] : bounds[i + 1]])[0] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *s]).view(np.int64))], ["shingle"])

    n = rows.count()
    common = rows.mapInArrow(bags, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    found = common.limit(COMMON + 1).toArrow()
    if found.num_rows > COMMON:
        raise ValueError(f"more than {COMMON} shingles are in two items of the benchmark or more")
    s, c = (found.column(x).to_numpy() for x in ("shingle", "n"))
    s = s.view(np.uint64)
    order = np.argsort(s)
    return n, s[order], c[order]


def _items(ids: list[int | None], texts: list[str | None], known: tuple[int, np.ndarray, np.ndarray]) -> Items:
    h, bounds = word_hashes(pa.array(texts, pa.large_string()), ALNUM)
    return Items(ids, [h[bounds[i] : bounds[i + 1]] for i in range(len(ids))], known)


def _found(docs: DataFrame, benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item_id, similarity, first_word, distance) of ``docs`` (keys, text; keys are long).

    A block's matches are written before the next block is sent, so one block at a time is in memory.
    """
    spark = docs.sparkSession
    schema = f"{', '.join(f'{k} long' for k in keys)}, item_id long, similarity double, first_word long, distance int"

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items: Items = shared.value
            for b in pieces(batches):
                ids = list(zip(*(b.column(k).to_pylist() for k in keys)))
                rows = [(*ids[i], items.ids[k], *v) for (i, k), v in _matches(*word_hashes(b.column("text"), ALNUM), items).items()]
                cols = list(zip(*rows)) or [()] * (len(keys) + 4)
                types = (*[pa.int64()] * len(keys), pa.int64(), pa.float64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [*keys, "item_id", "similarity", "first_word", "distance"])

        return run

    found = []
    for items in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)
        found.append(materialize(docs.mapInArrow(scan(sent), schema), "matches"))
        sent.destroy()
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, distance): one row for each document and item found in it."""
    return _found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ["doc_id"])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in whose own text no item was found, with their own columns; null and repeated ids make no difference."""
    me = {"__id": F.col("doc_id").cast("long"), "__digest": F.xxhash64("text")}
    cols, rows = [F.col(f"`{c}`") for c in docs.columns], docs.withColumns(me)
    with scratch(docs.sparkSession):
        found = _found(rows.select(*me, "text"), benchmark, [*me])
        bad = materialize(found.select(*[F.col(k).alias(f"{k}_bad") for k in me]).distinct(), "contaminated", keep=True)
        table = materialize(marks(bad.select(F.col("__digest_bad").alias("__digest")), ["__digest"]), "marks", keep=True)
    same = F.col("__id").eqNullSafe(F.col("__id_bad")) & (F.col("__digest") == F.col("__digest_bad"))
    every = marked(rows, ["__digest"], table, "__some")  # rows with another text than any bad one are not joined
    some = every.where("__some").join(small(bad), same, "left_anti")
    return every.where("NOT __some").select(*cols).unionAll(some.select(*cols))
