"""Operator 7: language identification by multilingual mixture inference.

A language's model is the smoothed distribution of its hashed character trigrams (over bytes of the lowered words, word
ends marked, 2**16 slots), learnt from at most ``MAX_ROWS`` labelled documents a language (those with the least hash of
doc_id).  A document is a mixture: each trigram is drawn from one of its languages.  Expectation-maximisation estimates the
proportions from the trigrams' likelihoods; the language set is the one with the best likelihood less ``log(trigrams) / 2``
a free proportion (BIC), grown greedily from the best single language.  The prediction is the language with the largest
proportion; the score is that proportion, for a set of one language its posterior among single languages.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the language first in code-point
order; labels that are null teach nothing; with no labels at all every text is ``und``; repeated rows get equal results;
an empty table gives an empty table; very long texts are scored in pieces of their own; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import pieces, text_buffer

SLOTS = 1 << 16
MAX_ROWS = 2_000
#: Languages a model may have: bounds what is broadcast (256 kB a language).
MAX_LANGUAGES = 400
STEPS, MIN_SHARE = 25, 0.02

_FOLD = np.zeros(256, np.uint32)
for _b in range(256):
    _FOLD[_b] = _b + 32 if 65 <= _b <= 90 else _b if 97 <= _b <= 122 or _b >= 128 else 0
#: A byte that continues an upper-case two-byte letter (C3 80-9E) lowered to C3 A0-BE.
_UP = np.zeros(256, bool)
_UP[0x80:0x9F] = True
_UP[0x97] = False


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every trigram of the batch, bounds): row i has slots bounds[i] to bounds[i + 1].

    Non-letters of ASCII become one space; trigrams over a space in the middle are left out.
    """
    buf, offs = text_buffer(texts)
    v = _FOLD[buf]
    if len(v) > 1:
        v[1:] += np.where((buf[:-1] == 0xC3) & _UP[buf[1:]], np.uint32(32), np.uint32(0))
    rows = len(offs) - 1
    # one space before each row's first byte and after its last: all rows in one array
    flat = np.zeros(len(v) + 2 * rows, np.uint32)
    place = np.arange(len(v)) + np.repeat(2 * np.arange(rows) + 1, np.diff(offs))
    flat[place] = v
    if len(flat) < 3:
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    mid = flat[1:-1] != 0
    code = (flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:])[mid]
    slot = (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)
    ends = offs + 2 * np.arange(rows + 1)
    return slot, np.searchsorted(np.flatnonzero(mid) + 1, ends, "left")


def has_letter(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(r"\p{L}")), F.lit(False))


def train(docs: DataFrame, usable: Column, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages in order, log likelihood of each slot)."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).withColumn("h", F.xxhash64(F.lit(7), "doc_id"))
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return [], np.zeros((0, SLOTS))
    # the least hashes of each language, by thresholds that counts give; no window over a language's rows
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    low = -(1 << 63)
    edge = {k: min((1 << 63) - 1, low + int((1 << 64) * min(1.0, max_rows / n))) for k, n in counts.items()}
    pick = F.create_map(*[x for k, v in edge.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    names = {k: i for i, k in enumerate(langs)}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), SLOTS), np.int64)
        for b in pieces(batches):
            slot, at = trigrams(b.column("text"))
            for i, k in enumerate(b.column("lang").to_pylist()):
                np.add.at(total[names[k]], slot[at[i] : at[i + 1]], 1)
        row, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(slot), pa.array(total[row, slot])], ["row", "slot", "n"])

    got = rows.where(F.col("h") <= pick[F.col("lang")]).select("text", "lang").mapInArrow(tally, "row long, slot long, n long")
    table = got.groupBy("row", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most languages x slots rows
    counts_ = np.zeros((len(langs), SLOTS))
    counts_[table.column("row").to_numpy(), table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return langs, np.log((counts_ + 0.2) / (counts_.sum(1, keepdims=True) + 0.2 * SLOTS))


def _em(p: np.ndarray, at: np.ndarray, share: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihoods) of rows whose trigrams have the likelihoods p; every row has trigrams."""
    n = np.diff(at)[:, None].astype(np.float64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for _ in range(steps):
        r = p * share[row]
        r /= r.sum(1, keepdims=True)
        new = np.add.reduceat(r, at[:-1], axis=0) / n
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, np.add.reduceat(np.log((p * share[row]).sum(1)), at[:-1])


def _second(slot: np.ndarray, at: np.ndarray, like: np.ndarray, full: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``full`` for which a second language is worth a trial, that language for all rows).

    The gain of a tenth of each other language, for the whole batch at once: most texts are settled here.
    """
    n = np.diff(at)[full]
    own = like[np.repeat(first, n), slot]
    best, second = np.full(len(full), -np.inf), np.zeros(len(full), np.int64)
    for j, lang in enumerate(like):
        gain = np.add.reduceat(np.log(np.exp(lang[slot] - own) * np.float32(0.1) + np.float32(0.9)), at[:-1][full], dtype=np.float64)
        gain[first == j] = -np.inf
        on = gain > best
        best[on], second[on] = gain[on], j
    return np.flatnonzero(best > 0.5 * np.log(n)), second


def infer(slot: np.ndarray, at: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(best language or -1, score, language set) of each row of a batch."""
    rows, k = len(at) - 1, len(like)
    best, score = np.full(rows, -1), np.zeros(rows)
    sets: list[list[int]] = [[] for _ in range(rows)]
    full = np.flatnonzero(np.diff(at) > 0)
    if not len(full) or not k:
        return best, score, sets
    single = np.stack([np.add.reduceat(lang[slot], at[:-1][full]) for lang in like], axis=1)
    # reduceat runs to the next start given, and rows between are empty
    first = single.argmax(1)
    post = 1.0 / np.exp(np.clip(single - single.max(1, keepdims=True), -700, 0)).sum(1)
    best[full], score[full] = first, post
    chosen = [[int(i)] for i in first]
    value = single.max(1)
    shares: dict[int, np.ndarray] = {}
    live, second = _second(slot, at, like, full, first) if k > 1 else (np.zeros(0, np.int64), first)
    while len(live):
        size = len(chosen[live[0]])
        live_next = []
        for i in live:
            a, b = at[full[i]], at[full[i] + 1]
            if size == 1:
                j = int(second[i])
            else:
                own = like[:, slot[a:b]].astype(np.float64)
                own -= own.max(0)
                base = np.log((shares[i][:, None] * np.exp(own[chosen[i]])).sum(0))
                # a language can help only where it beats the mixture; the gain of a tenth of it says which to try
                rest = [j for j in range(k) if j not in chosen[i]]
                gain = [np.logaddexp(base + np.log(0.9), own[j] + np.log(0.1)).sum() - base.sum() for j in rest]
                if not rest or max(gain) <= 0.5 * np.log(b - a):
                    continue
                j = rest[int(np.argmax(gain))]
            s = [*chosen[i], j]
            own = like[np.ix_(s, slot[a:b])].astype(np.float64)
            top = own.max(0)
            share, ll = _em(np.exp(own - top).T, np.array([0, b - a]), np.full((1, len(s)), 1.0 / len(s)))
            total = float(ll[0] + top.sum())
            if total - 0.5 * np.log(b - a) > value[i] and share.min() >= MIN_SHARE:
                value[i], chosen[i], shares[i] = total, s, share[0]
                live_next.append(i)
        live = np.array(live_next, np.int64)
    for i, r in enumerate(full):
        s = chosen[i]
        if len(s) > 1:
            top = min(range(len(s)), key=lambda x: (-shares[i][x], s[x]))
            best[r], score[r] = s[top], float(shares[i][top])
        sets[r] = sorted(s)
    return best, score, sets


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, languages for every row of ``docs``."""
    langs, like = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, like.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for b in pieces(batches):
            slot, at = trigrams(b.column("text"))
            best, score, sets = infer(slot, at, table)
            letter = b.column("letter").to_numpy(zero_copy_only=False)
            known = letter & (best >= 0)
            pred = [names[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())]
            cols = [b.column("doc_id"), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0).clip(0, 1)), pa.array([[names[k] for k in s] if ok else [] for s, ok in zip(sets, known.tolist())], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_letter(F.col("text")).alias("letter"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>")


def language(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages; rows whose crc32(doc_id) mod ``folds`` is ``fold`` teach nothing."""
    held = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(folds)) == fold, F.lit(False))
    model = train(docs.select("doc_id", "text", "lang"), ~held)
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")
