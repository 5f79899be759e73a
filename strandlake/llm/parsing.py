r"""Operator 13: document fingerprints by locally consistent parsing.

A text's bytes are the symbols of level 0.  A level turns symbols into phrases: runs of one symbol become a single symbol,
then deterministic coin tossing (each symbol's lowest bit that differs from its left neighbour, four times over, and a last
reduction to three labels) gives neighbours different labels from {0, 1, 2}, and a phrase begins where a label is a local
maximum.  A phrase's name is a hash of its symbols' names; names are the next level's symbols, until one is left.  Whether a
phrase begins at a symbol depends on at most MARGIN symbols around it, so equal substrings get equal names inside, at every
level and whatever their offset.

The fingerprint samples the names of levels LOW and up and the whole text's: a name's weight is the number of bytes it covers,
so each level counts alike, and each of SLOTS slots keeps the name with the least exponential draw over weight.  Likeness is
the share of filled slots that agree, an estimate of the weighted overlap of the two sets of names.  Equal texts have equal
fingerprints, and likeness 1.

A batch's texts are parsed together as numpy arrays; a text over GROUP bytes is parsed in stretches with the same phrases, so
memory beyond the text and its first level doesn't follow its length.

``neighbours`` puts documents into descending order of id by a range partitioning (a hot id is dealt out by digest and running
number) and walks each partition once; only its first and last documents are joined with those of the partitions beside it.

Defined cases: null text is empty, and an empty text has no names; null doc_ids come last, equal ones are ordered by their
texts' digests; repeated rows are neighbours of one another; the only document is its own neighbour; an empty table gives an
empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch
from .words import mix, pieces

SLOTS, LOW = 128, 2
#: Bytes parsed together; symbols left and right of a place that decide about a phrase's beginning (8 and 4 are enough).
GROUP, MARGIN = 1 << 19, 16
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _tossed(x: int, left: int) -> int:
    """Twice the lowest bit in which x differs from its left neighbour, plus that bit of x."""
    d = x ^ left
    j = (d & -d).bit_length() - 1 if d else 0
    return 2 * j + (x >> j & 1)


#: The same for labels under 128, and the least of 0, 1, 2 that neither neighbour has (9: no neighbour).
_TOSS = np.array([_tossed(x, left) for x in range(128) for left in range(128)], np.uint8)
_FREE = np.array([min({0, 1, 2} - {a, b}) for a in range(10) for b in range(10)], np.uint8)


def _left(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Left neighbours; a text's first symbol is compared with itself, lowest bit flipped."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[0] = x[0]
    out[first] = x[first]
    out[first] ^= 1
    return out


def starts(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin, for symbols without equal neighbours; ``first`` marks the beginnings of texts."""
    d = x ^ _left(x, first)
    j = np.maximum(np.frexp((d & (~d + np.uint64(1))).astype(np.float64))[1] - 1, 0).astype(np.uint64)
    label = (2 * j + (x >> j & np.uint64(1))).astype(np.uint8)
    for _ in range(3):
        label = _TOSS[label.astype(np.uint16) * 128 + _left(label, first)]
    last = np.append(first[1:], True)
    for c in (5, 4, 3):
        at = np.flatnonzero(label == c)
        left = np.where(first[at], 9, label[at - 1])
        right = np.where(last[at], 9, label[np.minimum(at + 1, len(x) - 1)])
        label[at] = _FREE[left * 10 + right]
    top = np.zeros(len(x), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    return first | (top & ~last)


def named(x: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and sizes of the phrases that begin at ``at``."""
    k = np.diff(at, append=len(x))
    out = mix(k.astype(np.uint64) + np.uint64(1 << 32))
    for j in range(int(k.max(initial=0))):
        on = np.flatnonzero(k > j) if j else slice(None)
        out[on] = mix(out[on] * _ODD + x[at[on] + j])
    return out, np.add.reduceat(size, at) if len(at) else size[:0]


def collapsed(x: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one symbol as one symbol, named by the symbol and the run's length."""
    new = first.copy()
    new[1:] |= x[1:] != x[:-1]
    new[:1] = True
    at = np.flatnonzero(new)
    k = np.diff(at, append=len(x))
    out = x[at]
    runs = np.flatnonzero(k > 1)
    out[runs] = mix(out[runs] * _ODD + k[runs].astype(np.uint64))
    return out, np.add.reduceat(size, at) if len(at) else size[:0], first[at]


def level(x: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next level's names, sizes and beginnings of texts."""
    if len(x) > GROUP:
        return _long_level(x, size)
    x, size, first = collapsed(x, size, first)
    at = np.flatnonzero(starts(x, first))
    return *named(x, size, at), first[at]


def _long_level(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``level`` of a single long text, stretch by stretch.

    Between stretches stay the open run, and from the open phrase on all collapsed symbols, with MARGIN before them.
    """
    names, sizes, at, n = [], [], 0, len(x)
    held, weight, opened, begun = x[:0], size[:0], 0, True
    while at < n:
        to = min(n, at + GROUP)
        while to < n:  # runs aren't cut
            other = np.flatnonzero(x[to : to + GROUP] != x[to - 1])
            if len(other):
                to += int(other[0])
                break
            to = min(n, to + GROUP)
        y, s, _ = collapsed(x[at:to], size[at:to], np.zeros(to - at, bool))
        y, s = np.concatenate([held, y]), np.concatenate([weight, s])
        first = np.zeros(len(y), bool)
        first[0] = begun
        top = np.flatnonzero(starts(y, first))
        top = top[(top > opened) & (top < (len(y) if to == n else len(y) - MARGIN))]
        top = np.append(opened, top)
        done, end = (top, len(y)) if to == n else (top[:-1], int(top[-1]))
        if len(done):
            a, b = named(y[:end], s[:end], done)  # from the first phrase on; context before it belongs to no phrase
            names.append(a)
            sizes.append(b)
        keep = max(0, int(top[-1]) - MARGIN)
        begun = begun and keep == 0
        held, weight, opened, at = y[keep:], s[keep:], int(top[-1]) - keep, to
    out = np.concatenate(names)
    first = np.zeros(len(out), bool)
    first[0] = True
    return out, np.concatenate(sizes), first


def parsed(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, text number, name, size) of the phrases of levels LOW and up, and of each text's single last symbol."""
    lengths = np.array([len(t) for t in texts], np.int64)
    live = np.flatnonzero(lengths)
    data = np.frombuffer(b"".join(texts), np.uint8)
    x, size = _BYTE[data], np.ones(len(data), np.int32)
    first = np.zeros(len(x), bool)
    first[np.cumsum(lengths)[live] - lengths[live]] = True
    k = 0
    while len(live):
        counts = np.diff(np.flatnonzero(first), append=len(x))
        of = np.repeat(live, counts)
        whole = np.repeat(counts == 1, counts)
        if k >= LOW:
            yield k, of, x, size
        elif whole.any():
            yield k, of[whole], x[whole], size[whole]
        if whole.any():
            x, size, first, live = x[~whole], size[~whole], first[~whole], live[counts > 1]
        if len(live):
            x, size, first = level(x, size, first)
        k += 1


def _codes(texts: list[bytes]) -> np.ndarray:
    best = np.full(len(texts) * SLOTS, np.inf)
    code = np.zeros(len(texts) * SLOTS, np.uint16)
    for _, of, name, size in parsed(texts):
        h = mix(name)
        at = of * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64)
        draw = -np.log(((mix(h) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)) / size
        np.minimum.at(best, at, draw)
        won = draw == best[at]
        code[at[won]] = (mix(h[won] + np.uint64(1)) % np.uint64(4095)).astype(np.uint16) + 1
    return code.reshape(-1, SLOTS)


def codes(texts: list[bytes]) -> np.ndarray:
    """A row of SLOTS codes for each text, 0 for empty slots; texts are parsed in groups of about GROUP bytes."""
    out, group, held = [], [], 0
    for t in texts:
        if group and held + len(t) > GROUP:
            out.append(_codes(group))
            group, held = [], 0
        group.append(t)
        held += len(t)
    return np.concatenate([*out, _codes(group)]) if group else np.zeros((0, SLOTS), np.uint16)


def packed(code: np.ndarray) -> list[bytes]:
    """Twelve bits a slot."""
    pair = code.reshape(len(code), -1, 2).astype(np.uint16)
    out = np.empty((*pair.shape[:2], 3), np.uint8)
    out[..., 0], out[..., 1], out[..., 2] = pair[..., 0] >> 4, (pair[..., 0] & 15) << 4 | pair[..., 1] >> 8, pair[..., 1] & 255
    return [row.tobytes() for row in out]


def unpacked(fingerprints: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(fingerprints), np.uint8).reshape(len(fingerprints), -1, 3).astype(np.uint16)
    return np.stack([x[..., 0] << 4 | x[..., 1] >> 4, (x[..., 1] & 15) << 8 | x[..., 2]], axis=-1).reshape(len(x), -1)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    filled = (a > 0) | (b > 0)
    n = filled.sum(1)
    return np.where(n > 0, ((a == b) & filled).sum(1) / np.maximum(n, 1), 1.0)


def _text(c: str) -> Column:
    """Base 64 in one line."""
    return F.replace(F.base64(c), F.lit("\r\n"), F.lit("")).alias(c)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, from 0 to 1; two without names are alike.  A slot is two characters of base 64."""

    def slot(c: Column, i: Column) -> Column:
        return F.substring(c, 2 * i + 1, F.lit(2))

    filled = F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: (slot(a, i) != "AA") | (slot(b, i) != "AA"))
    same = F.filter(filled, lambda i: slot(a, i) == slot(b, i))
    return F.when(F.size(filled) > 0, F.size(same) / F.size(filled)).otherwise(1.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text, in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packed(codes(texts)), pa.binary())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint binary").select("doc_id", _text("fingerprint"))


def edited(text: str, other: str) -> str:
    """The text, its last third replaced by as much of the beginning of another."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


_RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def _results(ids: list, texts: list[str], code: np.ndarray, others: list[str], other: np.ndarray) -> list[pa.Array]:
    new = [edited(t, o).encode() for t, o in zip(texts, others)]
    made = codes(new)
    cols = [ids, list(map(len, texts)), [hashlib.sha256(t).digest() for t in new], packed(code), packed(made), alike(code, made), alike(code, other)]
    return [pa.array(c, t) for c, t in zip(cols, _TYPES)]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows that have their next one in this partition; its first row and its last, with texts, for the others."""
    place = TaskContext.get().partitionId()
    names = [*_NAMES, "place", "kind", "text"]

    def edge(kind: str, doc_id, text: str, code: np.ndarray) -> pa.RecordBatch:
        cols = [[doc_id], [None], [None], packed(code), [None], [None], [None], [place], [kind], [text]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*_TYPES, pa.int32(), pa.string(), pa.string()])], names)

    ids: list = []
    texts: list[str] = []
    code = np.zeros((0, SLOTS), np.uint16)
    for b in pieces(batches, size=1 << 20):
        more = [t or "" for t in b.column("text").to_pylist()]
        found = codes([t.encode() for t in more])
        if not texts and more:
            yield edge("first", b.column("doc_id")[0].as_py(), more[0], found[:1])
        ids, texts, code = ids + b.column("doc_id").to_pylist(), texts + more, np.concatenate([code, found])
        n = len(texts) - 1
        if n > 0:
            done = _results(ids[:n], texts[:n], code[:n], texts[1:], code[1:])
            none = pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays([*done, pa.array([place] * n, pa.int32()), none, none], names)
            ids, texts, code = ids[n:], texts[n:], code[n:]
    if texts:
        yield edge("last", ids[0], texts[0], code)


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, size=1 << 20):
        c = b.to_pydict()
        yield pa.RecordBatch.from_arrays(_results(c["doc_id"], c["text"], unpacked(c["fingerprint"]), c["other"], unpacked(c["other_fingerprint"])), _NAMES)


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next one's, and its likeness to the edited and the next text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"digest": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.desc_nulls_last("doc_id"), F.asc("digest"), F.asc("row")]
    with scratch(docs.sparkSession):
        walked = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
        walked = materialize(walked.mapInArrow(_walk, _RESULT + ", place int, kind string, text string"), "walked", keep=True)
    done = walked.where("kind IS NULL").select(*_NAMES)
    first = walked.where("kind = 'first'").select(F.col("place").alias("after"), F.col("text").alias("other"), F.col("fingerprint").alias("other_fingerprint"))
    every = Window.orderBy("place")  # a row a partition
    places = walked.where("kind = 'first'").select("place")
    after = F.coalesce(F.lead("place").over(every), F.first("place").over(every))
    last = walked.where("kind = 'last'").select("doc_id", "text", "fingerprint", "place").join(places.select("place", after.alias("after")), "place")
    edges = last.join(first, "after").select("doc_id", "text", "fingerprint", "other", "other_fingerprint").mapInArrow(_join_edges, _RESULT)
    rows = done.unionByName(edges)
    return rows.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), _text("fingerprint"), _text("edited_fingerprint"), "near_edited", "near_next")
