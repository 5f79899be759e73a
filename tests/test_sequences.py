"""Sequences as codes, statistics by blocks and in one pass, searches and queues, each against plain loops."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import codes, kmers, orf
from strandlake.operators import curate as cu
from strandlake.operators import designs as dg
from strandlake.operators import stats as st

FLIP = str.maketrans("ACGTN", "TGCAN")


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(7)
    out = ["", "A", "AC", "ATG", "ATGTAA", "N" * 30, "ATGNNNTAA" * 5, "ACG" * 40]
    return out + ["".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, n % 3], k=rng.randint(3, 400))) for n in range(60)]


def span(s):
    best = 0
    for t in (s, s[::-1].translate(FLIP)):
        for frame in range(3):
            last = frame - 3
            for p in range(frame, len(t) - 2, 3):
                last = p if t[p : p + 3] in orf.STOPS else last
                best = max(best, p - last)
    return best


@pytest.mark.parametrize("step", [1 << 20, 7])
def test_frames_and_spans(sequences, monkeypatch, step):
    monkeypatch.setattr(codes, "STEP", step)
    for s in sequences:
        c = codes.symbols(s.encode())
        want = []
        for strand, t in ((1, s), (-1, s[::-1].translate(FLIP))):
            for frame in range(3):
                for i in range(frame, len(t) - 2, 3):
                    if t[i : i + 3] == "ATG":
                        stop = next((j for j in range(i + 3, len(t) - 2, 3) if t[j : j + 3] in orf.STOPS), None)
                        if stop is not None and stop + 3 - i >= 9:
                            want.append((strand, frame, i, stop + 3))
        assert sorted(zip(*(x.tolist() for x in codes.frames(c, 9)))) == sorted(want)
        assert codes.open_span(c) == span(s)
        for window, stride in ((30, 7), (61, 1), (3, 2)):
            at = np.arange(0, len(s) - window + 1, stride)
            if len(at):
                assert codes.spans(c, at, window).tolist() == [span(s[i : i + window]) for i in at.tolist()]


@pytest.mark.parametrize("bucket", [1 << 22, 20])
def test_earlier_windows(sequences, monkeypatch, bucket):
    monkeypatch.setattr(codes, "BUCKET", bucket)
    for s in sequences:
        for k in (1, 3, 9):
            want, seen = {}, {}
            for p in range(len(s) - k + 1):
                if s[p : p + k] in seen:
                    want[p] = seen[s[p : p + k]]
                seen[s[p : p + k]] = p
            got = {}
            for pos, last in codes.earlier(codes.symbols(s.encode()), k):
                got |= dict(zip(pos.tolist(), last.tolist()))
            assert got == want


def test_counts_and_features(spark, sequences):
    rows = [(i, "ab"[i % 2] if i % 5 else None, s) for i, s in enumerate(sequences)] + [(999, "a", None)]
    df = spark.createDataFrame(rows, "id long, g string, seq string")
    for plain in (True, False):
        got = {(r["g"], r["kmer"]): r["n"] for r in kmers.counts(df, 3, ["g"], plain=plain).collect()}
        want = collections.Counter((g, s[i : i + 3]) for _, g, s in rows for i in range(len(s or "") - 2))
        assert got == {k: n for k, n in want.items() if not plain or "N" not in k[1]}
    with pytest.raises(Exception, match="clean the sequences"):
        kmers.counts(spark.createDataFrame([("acg",)], ["seq"]), 2, [], plain=False).collect()
    got = {r["id"]: r for r in codes.features(df, "id", 9).collect()}
    for i, _, s in rows:
        s = s or ""
        for name, k in (("dinuc", 2), ("trinuc", 3), ("tetranuc", 4)):
            assert got[i][name] == {w: n for w, n in collections.Counter(s[j : j + k] for j in range(len(s) - k + 1)).items() if "N" not in w}
        acgt = sum(s.count(x) for x in "ACGT")
        assert got[i]["length"] == len(s) and got[i]["gc"] == (pytest.approx((s.count("G") + s.count("C")) / acgt) if acgt else None)
    m = {r["id"]: r for r in orf.metrics(df, "id", 9).collect()}
    assert all((m[i]["n_orfs"], m[i]["longest_orf_bp"], m[i]["coding_frac"]) == (got[i]["n_orfs"], got[i]["longest_orf_bp"], got[i]["coding_frac"]) for i, *_ in rows)


def exchanges(df):
    """Exchanges in the final plan."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("bucket", [1 << 22, 20])
def test_unique_rate_without_exchange(spark, sequences, monkeypatch, bucket):
    monkeypatch.setattr(codes, "BUCKET", bucket)
    assert [codes.distinct(codes.symbols(s.encode()), 3) for s in sequences] == [len({s[i : i + 3] for i in range(len(s) - 2)}) for s in sequences]
    rows = [(i, s) for i, s in enumerate(sequences)] + [(997, None), (None, "ACGTACGTACGT")]
    again = [(998, "ACGTACG"), (998, "ACGTTTTTT"), (999, "A"), (999, None)]

    def rates(df):
        return sorted(((r["id"], r["rate"]) for r in df.collect()), key=str)

    def want(rows):
        w = collections.defaultdict(list)
        for key, s in rows:
            w[key] += [s[i : i + 4] for i in range(len(s or "") - 3)] if key is not None else []
        return sorted(((key, len(set(w[key])) / len(w[key]) if w[key] else 1.0) for key, _ in rows), key=str)

    got = kmers.unique_rate(spark.createDataFrame(rows, "id long, seq string"), 4, "id")
    assert rates(got) == want(rows) and not exchanges(got)
    assert rates(kmers.unique_rate(spark.createDataFrame(rows + again, "id long, seq string"), 4, "id")) == want(rows + again)


def test_span_features_without_exchange(spark, sequences):
    rows = [(i, s, "x") for i, s in enumerate(sequences)] + [(997, None, "y")]
    again = [(998, "ACGTACG", "y"), (998, "ACGTTTTTT", "z"), (999, "A", "z"), (999, None, "x")]

    def plain(rows):
        pools = collections.defaultdict(list)
        for key, s, _ in rows:
            pools[key].append(s or "")
        out = []
        for key, _, extra in rows:
            three, four = (collections.Counter(s[i : i + k] for s in pools[key] for i in range(len(s) - k + 1)) for k in (3, 4))
            p = np.array(list(three.values())) / (three.total() or 1)
            out.append((key, extra, pytest.approx(-(p * np.log2(p)).sum(), abs=1e-9) if three else None, pytest.approx(len(four) / four.total()) if four else 1.0))
        return sorted(out, key=lambda r: r[:2])

    got = kmers.span_features(spark.createDataFrame(rows, "id long, seq string, extra string"), 3, 4, "id")
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == plain(rows) and not exchanges(got)
    got = kmers.span_features(spark.createDataFrame(rows + again, "id long, seq string, extra string"), 3, 4, "id")
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == plain(rows + again)


def test_sketches_of_parts_merge(spark, sequences):
    df = spark.createDataFrame([(i % 4, s * 3) for i, s in enumerate(sequences)], "g long, seq string")
    parts = kmers.distinct_sketches(df, 8, ["g"])
    merged = kmers.merged_sketches(parts, []).select(F.hll_sketch_estimate("sketch")).first()[0]
    exact = kmers.windows(df, 8, []).distinct().count()
    assert abs(merged - exact) <= 0.02 * exact


@pytest.mark.parametrize("held", [1 << 15, 1])
def test_distinct_by_parts_from_bitmaps(spark, sequences, monkeypatch, held):
    """Exact numbers and both sketches from one scan that makes no row a window; keys may be null."""
    monkeypatch.setattr(codes, "BLOCKS", held)
    rows = [("ab"[i % 2] if i % 5 else None, i % 3 or None, s) for i, s in enumerate(sequences)] + [("c", 1, None), ("d", 1, "ACGT")]
    df = spark.createDataFrame(rows, "lang string, source long, seq string").repartition(3)
    want = collections.defaultdict(set)
    for key, _, s in rows:
        want[key] |= {s[i : i + 8] for i in range(len(s or "") - 7)}
    want = {key: w for key, w in want.items() if w}
    bits = codes.occurring(df, 8, ["lang"], "seq")
    got = collections.Counter((r["lang"], r["kmer"]) for r in codes.unpacked(bits, 8, ["lang"]).collect())
    assert got == {(key, x): 1 for key, w in want.items() for x in w}
    out = kmers.distinct_by_parts(df, 8, "lang", "source").withColumns({c: F.hll_sketch_estimate(c) for c in ("sketch", "merged")})
    found = out.collect()
    assert {r["lang"]: r["kmers"] for r in found} == {key: len(w) for key, w in want.items()}
    assert all(abs(r[c] - r["kmers"]) <= 0.02 * r["kmers"] for r in found for c in ("sketch", "merged"))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_sketches_of_many_keys(spark, sequences, monkeypatch):
    monkeypatch.setattr(kmers, "KEYS", 2)
    df = spark.createDataFrame([(i % 4, s) for i, s in enumerate(sequences)], "g long, seq string")
    got = {r["g"]: r["n"] for r in kmers.distinct_sketches(df, 8, ["g"]).select("g", F.hll_sketch_estimate("sketch").alias("n")).collect()}
    exact = {r["g"]: r["n"] for r in kmers.windows(df, 8, ["g"]).distinct().groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got.keys() == exact.keys() and all(abs(got[g] - n) <= 0.02 * n for g, n in exact.items())


def test_mean_identity_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [(g, "".join(rng.choices("ACGT", k=rng.choice([0, 5, 5, 9, 40])))) for g in "ab" for _ in range(30)] + [("c", "ACGT")]
    got = {r["g"]: (r["pairs"], r["identity"]) for r in dg.mean_identity(spark.createDataFrame(rows, ["g", "seq"]), "g").collect()}
    for g in "ab":
        pairs = [np.mean([x == y for x, y in zip(s, t)]) for s, t in itertools.combinations([s for k, s in rows if k == g], 2) if len(s) == len(t) and s]
        assert got[g] == (len(pairs), pytest.approx(np.mean(pairs)))
    assert "c" not in got


@pytest.mark.parametrize("places, many", [(1 << 12, 64), (4, 3), (7, 2), (3, 1000)])
def test_agreements_in_blocks_and_as_counts(spark, monkeypatch, places, many):
    """Symbols never become rows: what is exchanged is a block a sequence, or counts of those a batch has many of."""
    monkeypatch.setattr(codes, "PLACES", places)
    monkeypatch.setattr(codes, "MANY", many)
    rng = random.Random(3)
    rows = [(g, "".join(rng.choices("ACGTN", k=rng.choice([0, 5, 5, 9, 40])))) for g in ["a", "b", None] for _ in range(40)] + [("a", "ACGTA")] * 20 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, seq string").repartition(3)
    out = codes.agreements(df, "g", "seq")
    got = collections.defaultdict(lambda: [set(), 0])
    for r in out.collect():
        got[r["g"], r["len"]][0].add(r["m"])
        got[r["g"], r["len"]][1] += r["same"]
    want = {}
    for key in {(g, len(s)) for g, s in rows if s}:
        held = [s for g, s in rows if (g, len(s or "")) == key]
        want[key] = [{len(held)}, sum(x == y for s, t in itertools.combinations(held, 2) for x, y in zip(s, t))]
    assert dict(got) == want
    with pytest.raises(Exception, match="clean the sequences"):
        codes.agreements(spark.createDataFrame([("a", "acg")], ["g", "seq"]), "g", "seq").collect()


def test_mean_identity_makes_no_row_a_symbol(spark):
    df = spark.createDataFrame([("a", "ACGT" * 5000)] * 30, ["g", "seq"])
    out = dg.mean_identity(df, "g")
    assert [tuple(r) for r in out.collect()] == [("a", 435, 1.0)]
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


# running sums


@pytest.mark.parametrize("name", ["one", "block", "kb", "off0", "k0", "__one", "__block", "__kb", "__off0", "__k0", "__in", "__sum", "___one"])
def test_running_with_columns_of_any_name(spark, name):
    df = spark.createDataFrame([("a", i, 1) for i in range(30)], f"g string, o long, `{name}` long")
    for keys in ([], ["g"]):
        assert sorted((r["o"], r["out"]) for r in cu.running(df, keys, "o", name, "out").collect()) == [(i, i) for i in range(30)]
    df = spark.createDataFrame([("a", i, 1) for i in range(30)], f"g string, `{name}` long, v long")
    assert sorted((r[name], r["out"]) for r in cu.running(df, ["g"], name, "v", "out", through=True).collect()) == [(i, i + 1) for i in range(30)]
    with pytest.raises(ValueError, match="there already"):
        cu.running(df, [], name, "v", "G")


def reject(p, q):
    ok = sorted((x, i) for i, x in enumerate(p) if x is not None and x == x)
    last = max((k for k, (x, _) in enumerate(ok, 1) if x <= k / len(ok) * q), default=0)
    return {i for _, i in ok[:last]}


@pytest.mark.parametrize("p", [[0.01, 0.02, 0.03, 0.5, 0.9], [0.2] * 6, [0.001] * 5, [0.9, None, float("nan"), 0.95], [0.01, 0.01, 0.04, 0.04, None, 0.03], [None, float("nan")], [i / 400 for i in range(300)]])
def test_benjamini_hochberg(spark, p):
    df = spark.createDataFrame(list(enumerate(p)), "id long, p double")
    assert {r["id"] for r in st.benjamini_hochberg(df, "p", "id").collect() if r["rejected"]} == reject(p, 0.05)
    assert st.benjamini_hochberg(df, "p", "id").count() == len(p)


# resampling


def test_resamples_follow_the_law_and_merge(spark):
    w = st.poisson(np.arange(20_000), np.arange(50), 3)
    law = [np.exp(-1) / f for f in (1, 1, 2, 6)]
    assert np.bincount(w.astype(int).ravel(), minlength=4)[:4] / w.size == pytest.approx(law, abs=2e-3)
    sums = w.sum(1)
    assert sums.mean() == pytest.approx(20_000, rel=5e-3) and 0.5 < sums.var() / 20_000 < 1.8  # independent weights, not a lattice
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.03
    rng = np.random.default_rng(2)
    x, arm = rng.normal(3, 2, 4000), rng.random(4000) < 0.4
    df = spark.createDataFrame([(i, float(v), bool(a)) for i, (v, a) in enumerate(zip(x, arm))], "id long, v double, arm boolean")
    one, two = (sorted((r["replicate"], round(r["diff"], 9)) for r in st.bootstrap_means(d, "v", F.col("arm"), "id", 400, 5).collect()) for d in (df, df.repartition(7)))
    assert one == two and len(one) == 400
    got = np.array([d for _, d in one])
    assert got.mean() == pytest.approx(x[arm].mean() - x[~arm].mean(), abs=0.02)
    assert got.std() == pytest.approx(np.sqrt(x[arm].var() / arm.sum() + x[~arm].var() / (~arm).sum()), rel=0.15)


def test_many_replicates_of_many_rows(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("v"))
    rows = st.resampled(df, [], "id", ["v"], 10_000, 1)
    assert rows.count() == 10_000 and rows.agg(F.avg("w")).first()[0] == pytest.approx(3000, rel=0.01)


# search, audit, queue


def expand(beam, number):
    rows = beam.select("design", F.col("idx").alias("parent"), F.col("state").alias("s"), F.posexplode(F.array(*map(F.lit, "AB"))).alias("k", "b"))
    return rows.select("design", (F.col("parent") * 2 + F.col("k")).alias("idx"), "parent", F.concat("s", "b").alias("state"))


def score(rows):
    return rows.withColumn("loss", (F.crc32(F.concat(F.col("design").cast("string"), "state")) % 1000) / 1000.0)


def test_a_search_goes_on_after_a_lost_driver(spark, tmp_path):
    start = spark.range(5).select(F.col("id").alias("design"), F.lit(0).alias("idx"), F.lit("").alias("state"))
    run = lambda root, rounds, s=score, who="x": sorted(tuple(r) for r in dg.durable_search(start, expand, s, rounds, 2, str(tmp_path / root), who).select("round", "design", "idx", "state", "loss", F.coalesce("rank", F.lit(0))).collect())
    whole = run("a", 4)

    def lost(rows):
        lost.calls += 1
        if lost.calls > 2:
            raise KeyboardInterrupt
        return score(rows)

    lost.calls = 0
    with pytest.raises(KeyboardInterrupt):
        run("b", 4, lost)
    calls = []
    assert run("b", 4, lambda rows: calls.append(1) or score(rows)) == whole and len(calls) == 2  # two rounds were there
    with pytest.raises(ValueError, match="another search"):
        run("b", 4, score, "y")
    one, two = dg.search_identity(start, expand, 4), dg.search_identity(start.repartition(3), expand, 4)
    assert one == two != dg.search_identity(start, score, 4) and one != dg.search_identity(start.limit(4), expand, 4)


def test_queue(spark):
    attempts = [
        (1, 1, "failed", False, "new", None), (1, 2, "complete", True, "new", None), (2, 1, "complete", False, "new", None), (3, 1, "running", None, "new", None),
        (4, 1, "failed", None, "new", "CUDA out of MEMORY"), (5, 1, "failed", None, "new", "CUDA out of memory"), (6, 1, "complete", True, "old", None),
    ]
    planned = [(1, "pilot"), (2, "pilot"), (3, "pilot"), (4, "calibration"), (5, "pilot"), (6, "pilot"), (7, "pilot"), (8, "all")]
    got = dg.queue(spark.createDataFrame(planned, "job long, stage string"), spark.createDataFrame(attempts, "job long, at long, status string, eligible boolean, implementation string, error string"), "new", "all", "pilot")
    assert {r["job"]: tuple(r)[2:] for r in got.collect()} == {
        1: ("skip", None, None), 2: ("archive_and_run", 0, True), 3: ("archive_and_run", 0, True), 4: ("skip_memory", None, None),
        5: ("archive_and_run", 0, False), 6: ("refuse", None, None), 7: ("run", None, None), 8: ("out_of_scope", None, None),
    }
    assert dg.scope_limit("calibration", "all") == "calibration" and dg.scope_limit("all", "calibration") == "calibration"
    with pytest.raises(ValueError, match="unknown scope"):
        dg.scope_limit("all", "everything")


def test_chain_digests(spark):
    import hashlib

    rows = [(i, i - 1 if i else None, f"{i}.") for i in range(37)] + [(100, None, "x"), (101, 100, "y"), (102, 100, None), (103, 101, "z"), (200, 201, "c"), (201, 200, "c"), (300, 999, "lost")]
    df = spark.createDataFrame(rows, "id long, up long, t string")
    got = {r["node"]: (r["depth"], r["digest"]) for r in dg.chain_digests(df, "id", "up", "t").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = {i: (i, md5("".join(f"{k}." for k in range(i + 1)))) for i in range(37)}
    assert got == want | {100: (0, md5("x")), 101: (1, md5("xy")), 102: (1, md5("x")), 103: (2, md5("xyz"))}


def test_state_difference(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, i long, v double")
    got = {r["path"]: tuple(r)[1:] for r in dg.state_difference(make([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 0.0)]), make([("a", 0, 1.5), ("a", 1, -2.0), ("b", 0, 0.0)])).collect()}
    assert got == {"a": (4.0, 2.0), "b": (0.0, 0.0)}
    with pytest.raises(Exception, match="only one state has"):
        dg.state_difference(make([("a", 0, 1.0)]), make([("b", 0, 1.0)])).collect()
