"""Every query of the library against its SQL twin on the smallest tables."""

import oracle
import pytest
from oracle import TINY

SMALL = TINY.replace("sf0.001", "sf0.01")

from strandlake.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return oracle.connect(TINY)


@pytest.fixture(scope="module")
def more():
    return oracle.connect(SMALL)


#: Flags that are the same for every row by what they say.
SAME = {"agg05_distinct_kmer_sketches", "agg22_divergence_totals", "ext05_stateful_shards", "sta04_tost", "sta12_pilot_gate"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, more, name):
    """Against SQL; where a flag says the same of all rows of the smallest tables, on larger ones too, where it mustn't."""
    df = QUERIES[name](spark, TINY)
    if name not in ORACLES:
        assert df.columns and df.count() > 0
        return
    assert not oracle.problems(df, ORACLES[name], con)
    flags = [c for c, t in df.dtypes if t == "boolean"]
    if flags and name not in SAME and any(df.select(c).distinct().count() < 2 for c in flags):
        df = QUERIES[name](spark, SMALL)
        assert not oracle.problems(df, ORACLES[name], more)
        assert df.count() == 1 or all(df.select(c).distinct().count() > 1 for c in flags)


def test_names_match():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(q)


# queries without a twin


def test_chained_checksums(spark):
    import zlib

    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    for r in QUERIES["fn11_arrays_crc"](spark, TINY).collect():
        b = docs.pop(r["doc_id"])
        assert r["crc"] == f"{zlib.crc32(b, zlib.crc32(b)):08x}"
    assert not docs


def test_candidate_seeds_are_distinct_and_stable(spark):
    one, two = ({(r["design"], r["i"]): r["seed"] for r in QUERIES["fn23_candidate_seeds"](spark, TINY).collect()} for _ in range(2))
    assert one == two and len(set(one.values())) == len(one) and all(0 <= s < 1 << 63 for s in one.values())


def test_beam_search_by_plain_loops(spark):
    import zlib

    got = {(r["design"], r["round"], r["rank"]): (r["state"], round(r["loss"], 6)) for r in QUERIES["st09_beam_search"](spark, TINY).collect()}
    want = {}
    for design in {k[0] for k in got}:
        beam = [(0, "")]
        for n in range(3):
            rows = sorted((zlib.crc32(f"{design}{s}{b}".encode()) % 1000 / 1000.0, idx * 4 + k, s + b) for idx, s in beam for k, b in enumerate("ACGT"))[:2]
            want |= {(design, n, i + 1): (s, round(loss, 6)) for i, (loss, _, s) in enumerate(rows)}
            beam = [(idx, s) for _, idx, s in rows]
    assert got == want and len(got) > 6


def test_weighted_windows_lie_in_their_sequences(spark):
    from strandlake.plans.base import dna

    texts = {r["doc_id"]: (r["source"], r["seq"]) for r in dna(spark, TINY).collect()}
    rows = QUERIES["smp06_weighted_windows"](spark, TINY).collect()
    assert 150 < len(rows) <= 200 and len({r["doc_id"] for r in rows}) > 60
    for r in rows:
        assert texts[r["doc_id"]][0] == r["source"] and r["window"] in texts[r["doc_id"]][1] and len(r["window"]) == 64


def test_stitched_windows_by_a_plain_stream(spark):
    from strandlake.plans.base import dna

    got = {(r["source"], r["file"], r["i"]): r["text"] for r in QUERIES["st02_stitched_windows"](spark, TINY).collect()}
    streams: dict = {}
    for r in sorted(dna(spark, TINY).collect(), key=lambda r: r["doc_id"]):
        streams.setdefault((r["source"], r["doc_id"] // 64), []).append(r["seq"])
    want = {}
    for key, seqs in streams.items():
        held, i = "", 0
        for s in seqs:
            held = held + "N" * 16 + s if held else s
            while len(held) >= 4096:
                want[*key, i] = held[:4096]
                held, i = held[4096:], i + 1
    assert got == want


def test_medians_cover_the_sample_median(spark):
    import numpy as np

    by: dict = {}
    for r in spark.read.parquet(f"{TINY}/documents.parquet").select("source", "n_chars").collect():
        by.setdefault(r[0], []).append(r[1])
    rows = QUERIES["udf07_bootstrap_statistic"](spark, TINY).collect()
    assert {r["source"]: r["n"] for r in rows} == {k: len(v) for k, v in by.items()}
    assert all(min(by[r["source"]]) <= r["lo"] <= np.median(by[r["source"]]) <= r["hi"] <= max(by[r["source"]]) for r in rows)


def test_drafts_are_verified_against_the_argmax(spark):
    import numpy as np

    for r in QUERIES["udf04_multi_candidate_verify"](spark, TINY).collect():
        rng = np.random.default_rng(r["item_id"])
        drafts, p = rng.integers(0, 3, (2, 3)), rng.random((2, 4, 3))
        runs = [next((i for i in range(3) if d[i] != t[i].argmax()), 3) for d, t in zip(drafts, p)]
        best = int(np.argmax(runs))
        assert (r["accepted"], r["winner"]) == (runs[best], best)
        assert r["tokens"] == [*drafts[best][: runs[best]].tolist(), int(p[best, runs[best]].argmax())]
