"""Sequences as small integers: what a sequence gives by itself is worked out in Arrow batches, without an exchange.

Symbols are A, C, G, T and N (0 to 4); 3-mers and k-mers are integers of that base.  A sequence is scanned STEP symbols at a
time, so beside its symbols only hits (stop and start codons, one bucket of k-mers) are in memory.  Counts are kept in one
vector a key, which is what reaches the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ACGTN"
START, STOPS = "ATG", ("TAA", "TAG", "TGA")
#: Symbols scanned at a time; k-mers of one bucket of a long sequence; counters of a task; distinct k-mers a vector may have.
STEP, BUCKET, COUNTERS, VECTOR = 1 << 20, 1 << 22, 1 << 22, 1 << 16
#: Positions of a block of sequences of one length; from how many of them on a batch sends counts instead of symbols.
PLACES, MANY = 1 << 12, 64
#: Codes of a bitmap (that of Spark's bitmap functions), bitmaps that a task holds, and k-mers they may stand for.
BITS, BLOCKS, POSSIBLE = 1 << 15, 1 << 15, 1 << 24

_CODE = np.full(256, 5, np.uint8)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(5)
_COMPLEMENT = np.array([3, 2, 1, 0, 4, 5], np.uint8)


def symbols(text: bytes) -> np.ndarray:
    """0 to 4, and 5 for anything that isn't in the alphabet."""
    return _CODE[np.frombuffer(text, np.uint8)]


def reverse_complement(c: np.ndarray) -> np.ndarray:
    return _COMPLEMENT[c][::-1]


def kmers(c: np.ndarray, k: int, base: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first position, codes, whether all symbols are under ``base``) of the windows of k symbols, STEP at a time."""
    for at in range(0, len(c) - k + 1, STEP):
        part = c[at : at + STEP + k - 1]
        n = len(part) - k + 1
        code, bad = np.zeros(n, np.int64), np.zeros(n, bool)
        for j in range(k):
            x = part[j : j + n]
            code = code * base + x
            bad |= x >= base
        yield at, code, ~bad


def _codon(*words: str) -> np.ndarray:
    out = np.zeros(125, bool)
    out[[sum(ALPHABET.index(x) * 5**i for i, x in enumerate(reversed(w))) for w in words]] = True
    return out


_IS_START, _IS_STOP = _codon(START), _codon(*STOPS)


def places(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of the codons of ``table``, in order."""
    hits = [at + np.flatnonzero(ok & table[np.where(ok, code, 0)]) for at, code, ok in kmers(c, 3)]
    return np.concatenate(hits) if hits else np.zeros(0, np.int64)


def frames(c: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """strand, frame, start, end of all complete frames of at least that length, nested ones included."""
    out = []
    for strand, s in ((1, c), (-1, reverse_complement(c))):
        start, stop = places(s, _IS_START), places(s, _IS_STOP)
        for frame in range(3):
            a, b = start[start % 3 == frame], stop[stop % 3 == frame]
            i = np.searchsorted(b, a)
            a, i = a[i < len(b)], i[i < len(b)]
            end = b[i] + 3
            a, end = a[end - a >= least], end[end - a >= least]
            out.append((np.full(len(a), strand, np.int32), np.full(len(a), frame, np.int32), a, end))
    return tuple(np.concatenate(x) for x in zip(*out))


def _range_max(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest of values[lo:hi] for each pair, -1 for none; a table of powers of two."""
    table = [values]
    while len(table[-1]) > 1 << (len(table) - 1):
        t, step = table[-1], 1 << (len(table) - 1)
        table.append(np.maximum(t[:-step], t[step:]))
    n = hi - lo
    out = np.full(len(lo), -1, np.int64)
    for k in range(len(table)):
        on = np.flatnonzero((n >= 1 << k) & (n < 2 << k))
        out[on] = np.maximum(table[k][lo[on]], table[k][hi[on] - (1 << k)])
    return out


def spans(c: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The longest open span of the windows that begin at ``starts``, over both strands and three frames.

    The walk starts one codon before a window's frame; stops are found once for all windows, so what a window costs does not
    depend on how far it overlaps others.
    """
    best = np.zeros(len(starts), np.int64)
    for s, at in ((c, starts), (reverse_complement(c), len(c) - window - starts)):
        stop = places(s, _IS_STOP)
        for frame in range(3):
            b = stop[stop % 3 == frame]
            first = at + (frame - at) % 3
            fits = first + 3 <= at + window
            last = first + 3 * ((at + window - 3 - first) // 3)
            i, j = np.searchsorted(b, at), np.searchsorted(b, at + window - 2)
            none = i >= j
            inner = _range_max(np.diff(b) - 3, i, np.maximum(i, j - 1)) if len(b) > 1 else np.full(len(at), -1)
            held = np.append(b, 0)
            gap = np.where(none, last - first + 3, np.maximum(np.maximum(held[np.minimum(i, len(b))] - first, last - held[np.maximum(j - 1, 0)]), inner))
            best = np.maximum(best, np.where(fits, gap, 0))
    return best


def open_span(c: np.ndarray) -> int:
    return int(spans(c, np.zeros(1, np.int64), len(c))[0]) if len(c) >= 3 else 0


def bucketed(c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, codes) of all windows of k symbols; equal ones come together, long sequences go bucket by bucket."""
    if 5**k >= 1 << 62:
        raise ValueError("k-mers of 26 symbols at most")
    buckets = 1 + len(c) // BUCKET
    for b in range(buckets):
        at, code = [], []
        for first, x, _ in kmers(c, k):
            on = np.flatnonzero(x % buckets == b) if buckets > 1 else np.arange(len(x))
            at.append(on + first)
            code.append(x[on])
        if at:
            yield np.concatenate(at), np.concatenate(code)


def earlier(c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, latest earlier one) of windows of k symbols that were there before."""
    for pos, code in bucketed(c, k):
        order = np.argsort(code, kind="stable")
        same = np.flatnonzero(code[order[1:]] == code[order[:-1]])
        yield pos[order[same + 1]], pos[order[same]]


def clean(c: np.ndarray) -> np.ndarray:
    if (c > 4).any():
        raise ValueError("symbols that are not in ACGTN: clean the sequences first")
    return c


def distinct(c: np.ndarray, k: int) -> int:
    """How many different windows of k symbols there are."""
    return sum(len(np.unique(code)) for _, code in bucketed(clean(c), k))


def each(df: DataFrame, keep: list[str], seq: str, work: Callable[[np.ndarray, dict], list], columns: str, inputs: list[str] | None = None) -> DataFrame:
    """``keep`` and ``columns`` (name type, ...): for each sequence the arrays that ``work(symbols, inputs)`` gives, a row an element.

    Null sequences are empty.  A batch's rows go out in pieces of about STEP elements.
    """
    inputs = inputs or []
    kept = [f for f in df.select(*keep).schema]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], columns])
    names = [*keep, *[c.strip().split(" ")[0].strip("`") for c in columns.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("__seq").cast(pa.binary())
            held, n = [], 0
            for i in range(b.num_rows):
                found = work(symbols(texts[i].as_py()), {c: b.column(c)[i].as_py() for c in inputs})
                if len(found[0]):
                    held.append((i, found))
                    n += len(found[0])
                if held and (n >= STEP or i + 1 == b.num_rows):
                    rows = np.repeat([j for j, _ in held], [len(f[0]) for _, f in held])
                    cols = [b.column(c).take(pa.array(rows)) for c in keep]
                    yield pa.RecordBatch.from_arrays([*cols, *[pa.array(np.concatenate(x)) for x in zip(*(f for _, f in held))]], names)
                    held, n = [], 0

    return df.select(*keep, *inputs, F.coalesce(F.col(seq), F.lit("")).alias("__seq")).mapInArrow(run, schema)


def words(k: int, base: int) -> list[str]:
    """All k-mers of the first ``base`` symbols, in the order of their codes."""
    out = [""]
    for _ in range(k):
        out = [w + x for w in out for x in ALPHABET[:base]]
    return out


def counts(df: DataFrame, k: int, keys: list[str], seq: str, plain: bool) -> DataFrame:
    """(keys, kmer, n): a vector of counts for each key of a task, its non-zero entries summed over tasks.

    ``plain`` leaves out windows with anything but ACGT; else a symbol outside ACGTN is an error.
    """
    base = 4 if plain else 5
    size = base**k
    if size > VECTOR:
        raise ValueError(f"at most {VECTOR} distinct k-mers")
    kept = [f for f in df.select(*keys).schema]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "__code int, n long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            on = [np.flatnonzero(v) for v in held.values()]
            rows = np.repeat(np.arange(len(on)), [len(x) for x in on])
            cols = [pa.array([key[i] for key in held], t).take(pa.array(rows)) for i, t in enumerate(types)]
            out = [*cols, pa.array(np.concatenate(on).astype(np.int32)), pa.array(np.concatenate([v[x] for v, x in zip(held.values(), on)]))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, [*keys, "__code", "n"])

        types: list = []
        for b in batches:
            types = [b.column(c).type for c in keys]
            texts = b.column("__seq").cast(pa.binary())
            for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in keys)) if keys else [()] * b.num_rows):
                c = symbols(texts[i].as_py())
                for _, code, ok in kmers(c if plain else clean(c), k, base):
                    if key not in held:
                        held[key] = np.zeros(size, np.int64)
                    held[key] += np.bincount(code[ok] if plain else code, minlength=size)
                if len(held) * size > COUNTERS:
                    yield flush()
        if held:
            yield flush()

    rows = df.select(*keys, F.coalesce(F.col(seq), F.lit("")).alias("__seq")).mapInArrow(run, schema)
    rows = rows.groupBy(*keys, "__code").agg(F.sum("n").alias("n"))
    return rows.select(*keys, word(F.col("__code"), k, base).alias("kmer"), "n")


def word(code: Column, k: int, base: int) -> Column:
    """The k symbols of a code."""
    digit = [F.substring(F.lit(ALPHABET), (F.floor(code / base**i) % base + 1).cast("int"), F.lit(1)) for i in reversed(range(k))]
    return F.concat(*digit)


def occurring(df: DataFrame, k: int, keys: list[str], seq: str) -> DataFrame:
    """(keys, __block, __bits): which k-mers occur, as bitmaps of BITS codes; blocks without any are left out.

    A task holds one bit a possible k-mer for each of its keys, so what is exchanged depends on keys and tasks and not on the
    windows.  Symbols outside ACGTN are an error.
    """
    if 5**k > POSSIBLE:
        raise ValueError(f"at most {POSSIBLE} possible k-mers")
    blocks = -(-(5**k) // BITS)
    kept = [f for f in df.select(*keys).schema]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "__block int, __bits binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        seen = np.zeros(blocks * BITS, bool)

        def flush() -> Iterator[pa.RecordBatch]:
            for key, bits in held.items():
                on = np.flatnonzero(bits.reshape(blocks, -1).any(axis=1))
                cols = [pa.array([x] * len(on), t) for x, t in zip(key, types)]
                out = [*cols, pa.array(on.astype(np.int32)), pa.array([bits[b * BITS // 8 : (b + 1) * BITS // 8].tobytes() for b in on.tolist()], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, [*keys, "__block", "__bits"])
            held.clear()

        types: list = []
        for b in batches:
            types = [b.column(c).type for c in keys]
            texts = b.column("__seq").cast(pa.binary())
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in keys)) if keys else [()] * b.num_rows):
                rows.setdefault(key, []).append(i)
            for key, at in rows.items():
                seen[:] = False
                for i in at:
                    for _, code, _ in kmers(clean(symbols(texts[i].as_py())), k):
                        seen[code] = True
                bits = np.packbits(seen, bitorder="little")
                held[key] = held[key] | bits if key in held else bits
                if len(held) * blocks > BLOCKS:
                    yield from flush()
        yield from flush()

    rows = df.select(*keys, F.coalesce(F.col(seq), F.lit("")).alias("__seq")).mapInArrow(run, schema)
    return joined(rows, keys)


def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __block, __bits) of ``occurring`` for fewer keys."""
    return rows.groupBy(*keys, "__block").agg(F.bitmap_or_agg("__bits").alias("__bits"))


def unpacked(rows: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(keys, kmer), a row a bit of ``occurring``."""
    kept = [f for f in rows.select(*keys).schema]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "__code long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part = b.slice(at, 32)
                on = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")) for x in part.column("__bits").to_pylist()]
                code = np.concatenate([x + n * BITS for x, n in zip(on, part.column("__block").to_pylist())])
                row = pa.array(np.repeat(np.arange(len(on)), [len(x) for x in on]))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(row) for c in keys], pa.array(code)], [*keys, "__code"])

    return rows.select(*keys, "__block", "__bits").mapInArrow(run, schema).select(*keys, word(F.col("__code"), k, 5).alias("kmer"))


def agreements(df: DataFrame, group: str, seq: str) -> DataFrame:
    """(group, len, m, same): how many sequences of a length there are, and at how many positions their pairs agree, added up.

    n sequences with one symbol at a position are n (n - 1) / 2 pairs that agree there.  Sequences travel in blocks of
    PLACES symbols to where their length is counted; those that a batch has MANY of go as counts, so a common length is no
    large task.  A row a block comes out; m is the same in all of a length.
    """
    kind = df.select(group).schema[0].dataType.simpleString()
    names = ["__group", "__len", "__at", "__n", "__v"]

    def counted(rows: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduce(rows == s, axis=0, dtype=np.int64) for s in range(5)])

    def runs(*cols: np.ndarray) -> list[tuple[int, int]]:
        """From and to of rows that are equal in all columns, next to one another."""
        ends = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1 if len(cols[0]) else []
        return list(zip([0, *ends], [*ends, len(cols[0])])) if len(cols[0]) else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("__seq").cast(pa.binary())
            owner = b.column("__group").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            size = np.array([len(x) for x in texts.to_pylist()], np.int64)
            order = np.lexsort((size, owner))
            order = order[size[order] > 0]
            out, held = [], 0
            for i, j in runs(owner[order], size[order]):
                n = int(size[order[i]])
                rows = np.stack([clean(symbols(texts[int(r)].as_py())) for r in order[i:j]])
                for at in range(0, n, PLACES):
                    part = rows[:, at : at + PLACES]
                    if j - i >= MANY:
                        out.append((order[i], n, at, j - i, counted(part).tobytes()))
                        held += 40 * part.shape[1]
                    else:
                        out.extend((r, n, at, 1, x.tobytes()) for r, x in zip(order[i:j], part))
                        held += part.size
                    if held > COUNTERS:
                        yield packed(b, out)
                        out, held = [], 0
            if out:
                yield packed(b, out)

    def packed(b: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        row, n, at, m, v = zip(*out)
        owners = b.column("__group").take(pa.array(np.array(row, np.int64)))
        return pa.RecordBatch.from_arrays([owners, *[pa.array(x, pa.int64()) for x in (n, at, m)], pa.array(v, pa.binary())], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, m, total = None, 0, np.zeros((5, 0), np.int64)
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = [pa.array([x[0][0] for x in done], kept), *[pa.array(x, pa.int64()) for x in zip(*((k[1], s, a) for k, s, a in done))]]
            done.clear()
            return pa.RecordBatch.from_arrays(out, [group, "len", "m", "same"])

        for b in batches:
            kept = b.column("__group").type
            owner = b.column("__group").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            n, at, weight = (b.column(c).to_numpy() for c in names[1:4])
            for i, j in runs(owner, n, at, weight):
                key = (b.column("__group")[i].as_py(), int(n[i]), int(at[i]))
                if key != last:
                    if last:
                        done.append((last, m, int((total * (total - 1) // 2).sum())))
                    if len(done) > PLACES:
                        yield flush()
                    last, m, total = key, 0, np.zeros((5, min(key[1] - key[2], PLACES)), np.int64)
                blocks = b.column("__v").slice(i, j - i).to_pylist()
                if weight[i] == 1:
                    total += counted(np.frombuffer(b"".join(blocks), np.uint8).reshape(j - i, -1))
                else:
                    for x in blocks:
                        total += np.frombuffer(x, np.int64).reshape(5, -1)
                m += int(weight[i]) * (j - i)
        if last:
            done.append((last, m, int((total * (total - 1) // 2).sum())))
            yield flush()

    rows = df.select(F.col(group).alias("__group"), F.coalesce(F.col(seq), F.lit("")).alias("__seq"))
    rows = rows.mapInArrow(cut, f"__group {kind}, __len long, __at long, __n long, __v binary")
    at = ["__group", "__len", "__at"]
    return rows.repartition(*at).sortWithinPartitions(*at, "__n").mapInArrow(add, f"`{group}` {kind}, len long, m long, same long")


FEATURES = "length long, gc double, n_orfs long, longest_orf_bp long, coding_frac double, dinuc map<string,bigint>, trinuc map<string,bigint>, tetranuc map<string,bigint>"


def features(df: DataFrame, key: str, least: int = 60, seq: str = "seq") -> DataFrame:
    """``key`` and FEATURES of each sequence in one scan; k-mers are those of A, C, G and T that occur.

    gc is null without any of these; coding_frac may pass 1, frames overlap.
    """
    names = {k: words(k, 4) for k in (2, 3, 4)}
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), *[pa.map_(pa.string(), pa.int64())] * 3]

    def one(c: np.ndarray) -> list:
        n = np.bincount(c, minlength=6)[:4]
        start, end = frames(c, least)[2:]
        size = end - start
        out = [len(c), float((n[1] + n[2]) / n.sum()) if n.sum() else None, len(size), int(size.max(initial=0)), float(size.sum() / len(c)) if len(c) else 0.0]
        for k, w in names.items():
            got = np.zeros(4**k, np.int64)
            for _, code, ok in kmers(c, k, 4):
                got += np.bincount(code[ok], minlength=4**k)
            on = np.flatnonzero(got)
            out.append(list(zip([w[i] for i in on], got[on].tolist())))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("__seq").cast(pa.binary())
            rows = [one(symbols(texts[i].as_py())) for i in range(b.num_rows)]
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([b.column(key), *cols], [key, *[f.split(" ")[0] for f in FEATURES.split(", ")]])

    kind = dict(df.dtypes)[key]
    return df.select(key, F.coalesce(F.col(seq), F.lit("")).alias("__seq")).mapInArrow(run, f"`{key}` {kind}, {FEATURES}")
