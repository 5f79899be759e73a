"""Operator 10: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and non-ASCII characters, A-Z lowered.  A text's features are hashes (2**22 slots) of its
words, word pairs, pairs around one word, and beginnings of words, each again when it occurs twice and four times.  FTRL-proximal with per-coordinate rates passes over at most
``MAX_ROWS`` labelled rows and ``MAX_BYTES`` of their features (the rows with the least hash of doc_id; toxic and clean rows
each take up to half), in an order fixed by that hash; the L1 term leaves few weights, which are broadcast (a slot has one at
most, so never over 48 MB).  Scoring covers every whole text: only slots with a weight are gathered.

The clean-to-toxic ratio of what is trained on differs from that of all labelled rows, so the bias is corrected by the two
classes' sampling rates.

Defined cases: null and wordless texts get the score of the bias alone; labels of null or of unknown documents teach
nothing; a document labelled twice counts as toxic if any label says so; without labels of both classes every score is the share of toxic
labels (0 if none); repeated rows get equal scores (of ids with
several texts the least one is learnt from); very long texts are scored in pieces of their own; an empty table gives an empty
table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import ALPHA, mix, pieces, word_hashes

SLOTS = 1 << 22
#: The sample that is learnt from: labelled rows, and bytes of their features (4 a feature) that the learning task holds.
MAX_ROWS, MAX_BYTES = 24_000, 256 << 20
#: Lengths in bytes of word beginnings, and the counts in a text from which a gram is a feature again.
HEADS, LEVELS = (5, 6, 8), (1, 2, 4)
ALPHA_RATE, BETA, L1, L2 = 0.3, 1.0, 4.0, 0.5
PASSES = 3


def _grams(h: np.ndarray, heads: list[np.ndarray]) -> list[np.ndarray]:
    """Slots of words, pairs, skip pairs and word beginnings; element i starts at word i, -1 where there is none."""
    mask = np.uint64(SLOTS - 1)
    out = [h & mask]
    if len(h) > 1:
        out.append(mix(h[:-1] * np.uint64(3) + h[1:]) & mask)
    if len(h) > 2:
        out.append(mix(h[:-2] * np.uint64(5) + h[2:] * np.uint64(7)) & mask)
    return [g.astype(np.int64) for g in out] + [np.where(x == 0, -1, (x & mask).astype(np.int64)) for x in heads]


#: Words that an element of ``_grams`` reaches over beyond its first.
_REACH = (0, 1, 2) + (0,) * len(HEADS)


def _slot(base: np.ndarray, level: int) -> np.ndarray:
    """Slot of the feature that a gram occurs LEVELS[level] times or more."""
    return (base + level * 1_299_709) % SLOTS


def features(h: np.ndarray, heads: list[np.ndarray]) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.int64)
    base, n = np.unique(np.concatenate(_grams(h, heads)), return_counts=True)
    base, n = base[base >= 0], n[base >= 0]
    return np.unique(np.concatenate([_slot(base[n >= k], i) for i, k in enumerate(LEVELS)]))


def ftrl(rows: list[tuple[np.ndarray, int]], passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots with a weight, weights, bias) of FTRL-proximal over the rows in their order."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == SLOTS, 0.0, L1)
        w = -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA_RATE + L2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(passes):
        for x, y in rows:
            i = np.append(x.astype(np.int64), SLOTS)  # the last slot is the bias
            w = weight(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA_RATE
            z[i] += g - s * w
            n[i] += g * g
    live = np.flatnonzero(np.abs(z[:SLOTS]) > L1)
    return live, weight(live), float(weight(np.array([SLOTS]))[0])


def _bucket() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from at most ``max_rows`` labelled rows; one bounded task does the passes."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.lit(True) if usable is None else usable)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(10), "doc_id"))
    count = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    pos, neg = count.get(1, 0), count.get(0, 0)
    none = np.zeros(0, np.int64), np.zeros(0)
    if not pos or not neg:
        return *none, float("inf") if pos else float("-inf")
    take_pos = min(pos, max(max_rows // 2, max_rows - neg))
    take_neg = min(neg, max_rows - take_pos)
    top = [rows.where(F.col("toxic") == y).orderBy("h").limit(k) for y, k in ((1, take_pos), (0, take_neg))]
    chosen = top[0].union(top[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))  # of repeated ids the least text

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            h, at, heads = word_hashes(b.column("text"), ALPHA, HEADS)
            x = [features(h[at[i] : at[i + 1]], [k[at[i] : at[i + 1]] for k in heads]).astype(np.int32).tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("toxic"), pa.array(x, pa.binary())], ["h", "toxic", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        size = 0
        for b in batches:  # by hash: what is beyond the bound are the last rows
            for y, x in zip(b.column("toxic").to_pylist(), b.column("x")):
                size += len(x.as_buffer())
                if size <= MAX_BYTES:
                    held.append((np.frombuffer(x.as_buffer(), np.int32).copy(), y))
        slots, weights, bias = ftrl(held)
        seen = sum(y for _, y in held)
        slots, weights = np.append(slots, [-1, -2, -3]), np.append(weights, [bias, seen, len(held) - seen])
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(weights, pa.float64())], ["slot", "weight"])

    model = sample.mapInArrow(hashed, "h long, toxic int, x binary").repartition(1).sortWithinPartitions("h").mapInArrow(learn, "slot long, weight double").toArrow()
    slots, weights = model.column("slot").to_numpy(), model.column("weight").to_numpy()
    bias, seen1, seen0 = (float(weights[slots == k][0]) for k in (-1, -2, -3))
    if not seen1 or not seen0:
        return *none, float("inf") if seen1 else float("-inf")
    own = slots >= 0
    return slots[own], weights[own], bias + float(np.log((pos / neg) / (seen1 / seen0)))


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, bias = shared.value
        dense = np.zeros(SLOTS)
        dense[slots] = weights
        live = np.zeros(SLOTS, bool)  # grams that have a weight at some level
        for level in range(len(LEVELS)):
            live[(slots - level * 1_299_709) % SLOTS] = True
        for b in pieces(batches):
            h, at, heads = word_hashes(b.column("text"), ALPHA, HEADS)
            total = np.full(b.num_rows, bias)
            keys = []
            for g, reach in zip(_grams(h, heads), _REACH if len(h) > 2 else (0, 1)[: len(h)] + (0,) * len(HEADS)):
                hit = np.flatnonzero(live[g] & (g >= 0))
                row = np.searchsorted(at, hit, "right") - 1
                inside = hit + reach < at[row + 1]  # no gram runs into the next row
                keys.append(row[inside] * SLOTS + g[hit[inside]])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            for level, k in enumerate(LEVELS):
                on = key[n >= k]
                np.add.at(total, on // SLOTS, dense[_slot(on % SLOTS, level)])
            with np.errstate(over="ignore"):
                p = 1.0 / (1.0 + np.exp(-total))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id) mod ``folds`` is ``fold`` teach nothing."""
    held = F.pmod(_bucket(), F.lit(folds)) == fold
    model = train(docs, labels, ~held)
    return scores(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
