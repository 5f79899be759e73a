"""Places where a user's own Python goes: window samplers, scorers and fetchers, in Arrow batches with one set-up a task."""

from __future__ import annotations

import gzip
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (generator, length, window, how many) -> starts of windows.
Sampler = Callable[[np.random.Generator, int, int, int], np.ndarray]


def uniform_starts(rng: np.random.Generator, length: int, window: int, n: int) -> np.ndarray:
    return rng.integers(0, length - window + 1, n)


def sample_windows(df: DataFrame, key: str, seq: str, window: int, n: int, seed: int, sampler: Sampler = uniform_starts) -> DataFrame:
    """(key, i, start, text): ``n`` windows of each sequence that is long enough, at the starts that ``sampler`` gives.

    The generator is keyed by row, so results depend on neither tasks nor files; starts outside the sequence are an error.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, s in zip(b[key], b[seq]):
                if s is None or len(s) < window:
                    continue
                starts = np.asarray(sampler(np.random.default_rng([seed, zlib.crc32(str(k).encode())]), len(s), window, n), np.int64)
                if len(starts) and not (0 <= starts.min() and starts.max() <= len(s) - window):
                    raise ValueError(f"a window of {k} lies outside its sequence")
                out += [(k, i, int(at), s[at : at + window]) for i, at in enumerate(starts)]
            yield pd.DataFrame(out, columns=[key, "i", "start", "text"])

    return df.select(key, seq).mapInPandas(run, f"{key} {kind}, i int, start long, text string")


def scored(df: DataFrame, seq: str, build: Callable[[], Callable[[list[str]], list[float]]], batch: int = 64, out: str = "score") -> DataFrame:
    """``df`` with the score of its sequence.  ``build`` makes a scorer once a task (a model, a pipe to a service); it is given
    up to ``batch`` sequences at a time and closed, if it can be, when the task ends.  Null sequences have no score."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = build()
        try:
            for b in batches:
                at = np.flatnonzero(b[seq].notna().to_numpy())
                got = np.full(len(b), None, object)
                for i in range(0, len(at), batch):
                    part = at[i : i + batch]
                    values = score(b[seq].iloc[part].tolist())
                    if len(values) != len(part):
                        raise ValueError(f"{len(values)} scores for {len(part)} sequences")
                    got[part] = values
                yield b.assign(**{out: pd.Series(got, index=b.index, dtype="float64")})
        finally:
            getattr(score, "close", lambda: None)()

    return df.mapInPandas(run, schema)


def brought(get: Callable[[str], bytes], name: str, tries: int = 5, wait: float = 1.0) -> tuple[str, str | None, str | None]:
    """(asked, text, problem) of one record: retries with longer and longer pauses, gzip or plain, then the name without version."""
    problem, asked = "not found", name
    for asked in dict.fromkeys((name, name.rsplit(".", 1)[0])):
        for k in range(tries):
            try:
                raw = get(asked)
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                return asked, raw.decode(), None
            except LookupError:
                break  # not there: the next form of the name
            except (OSError, EOFError, zlib.error, UnicodeDecodeError) as e:
                problem = f"{type(e).__name__}: {e}"
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
    return asked, None, problem


def fetched(ids: DataFrame, key: str, get: Callable[[str], bytes], tries: int = 5, wait: float = 1.0) -> DataFrame:
    """(key, asked, text, problem) of records that ``get`` brings (a connection, or fixtures), gzip or plain.

    A failed request is made again up to ``tries`` times, each pause twice as long; an accession with a version that isn't
    found is asked for without it.  What can't be had is a row with its problem, not an error.
    """
    kind = dict(ids.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *brought(get, str(k), tries, wait)) for k in b[key]], columns=[key, "asked", "text", "problem"])

    return ids.select(key).where(F.col(key).isNotNull()).mapInPandas(run, f"{key} {kind}, asked string, text string, problem string")
