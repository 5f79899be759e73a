"""Vectorised words: one 64-bit hash a word for a whole Arrow batch of texts.

A word's hash is a polynomial over its bytes modulo 2**64, read off one running sum of the batch's buffer and brought
to position 0 by the inverse power, then mixed with the word's length.  Work is done in pieces of a quarter megabyte that
end between words, so a very long text costs no more memory than a short one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _lut(is_word) -> np.ndarray:
    """Byte -> 0 between words, else 1 + the byte with A-Z lowered."""
    out = np.zeros(256, np.uint64)
    for b in range(256):
        if is_word(b):
            out[b] = 1 + (b + 32 if 65 <= b <= 90 else b)
    return out


#: Words of the contracts (anything but ASCII white space), lowered.
PLAIN = _lut(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Runs of letters, digits and non-ASCII characters, lowered: punctuation does not matter.
ALNUM = _lut(lambda b: b >= 128 or chr(b).isalnum())
#: Runs of letters and non-ASCII characters, lowered.
ALPHA = _lut(lambda b: b >= 128 or chr(b).isalpha())


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        seed = np.full(max(n, _STEP + 1), base, np.uint64)
        seed[0] = 1
        _powers[kind] = have = np.multiply.accumulate(seed)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The batch's bytes and the rows' offsets; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def word_hashes(texts: pa.Array, lut: np.ndarray = PLAIN, heads: tuple[int, ...] = (), spans: bool = False) -> tuple:
    """(hash of every word of the batch, bounds): row i has the words bounds[i] to bounds[i + 1].

    With ``heads``, a third value: for each length in it the hash of every word's first so many bytes, 0 for words that
    are not longer.  With ``spans``, two values more at the end: where in the batch's bytes each word begins and ends.
    """
    buf, offs = text_buffer(texts)
    n, at, hashes, starts, ends = len(buf), 0, [], [], []
    begun: list[list[np.ndarray]] = [[] for _ in heads]
    inner = offs[1:-1]
    while at < n:
        to = min(n, at + _STEP)
        while to < n:  # end between words, or at the end of a row
            back = np.flatnonzero(lut[buf[max(at, to - 4096) : to]] == 0) + max(0, to - at - 4096)
            i = np.searchsorted(inner, to, "right") - 1
            row_end = int(inner[i]) if i >= 0 and inner[i] > at else 0
            stop = max(at + int(back[-1]) + 1 if len(back) else 0, row_end)
            if stop > at:
                to = stop
                break
            to = min(n, to + _STEP)
        v = lut[buf[at:to]]
        on = v != 0
        before = np.empty_like(on)
        before[0], before[1:] = False, on[:-1]
        lo, hi = np.searchsorted(offs, (at, to), "left")
        cuts = offs[lo:hi] - at
        before[cuts[cuts < to - at]] = False
        s = np.flatnonzero(on & ~before)
        after = np.empty_like(on)
        after[-1], after[:-1] = False, on[1:]
        after[cuts[cuts > 0] - 1] = False
        e = np.flatnonzero(on & ~after)
        if len(s):
            c = np.cumsum(v * _power("up", _BASE, to - at)[: to - at])
            first = c[s] - v[s] * _power("up", _BASE, to - at)[s]
            h = (c[e] - first) * _power("down", _INV, to - at)[s]
            hashes.append(mix(h ^ ((e - s).astype(np.uint64) << np.uint64(48))))
            starts.append(s + at)
            if spans:
                ends.append(e + at + 1)
            for k, held in zip(heads, begun):
                cut = np.minimum(s + k - 1, e)
                held.append(np.where(e - s >= k, mix((c[cut] - first) * _power("down", _INV, to - at)[s] + np.uint64(k)), np.uint64(0)))
        at = to
    none = np.zeros(0, np.uint64)
    whole, bounds = (np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offs, "left")) if hashes else (none, np.zeros(len(offs), np.int64))
    out = (whole, bounds, [np.concatenate(x) if x else none for x in begun]) if heads else (whole, bounds)
    places = np.zeros(0, np.int64)
    return (*out, *(np.concatenate(x) if x else places for x in (starts, ends))) if spans else out


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-word window of a run of words; element i starts at word i."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = chained(out, h[j : len(h) - k + 1 + j])
    return out


def chained(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, each one word longer."""
    return mix(h * np.uint64(0xD6E8FEB86659FD93) + word)


def pieces(batches, column: str = "text", size: int = 2 << 20):
    """Cuts batches into runs of rows of about ``size`` bytes of text, so that working memory doesn't follow batch size."""
    for b in batches:
        texts = b.column(column)
        if b.num_rows <= 1 or texts.nbytes <= size:
            yield b
            continue
        ends = text_buffer(texts)[1][1:]
        at = 0
        while at < b.num_rows:
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + size, "right")))
            yield b.slice(at, to - at)
            at = to
