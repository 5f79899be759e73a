"""Hand-computed vectors and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import decode as dc
from strandlake.functions import text as tx
from strandlake.operators import acceptance as acc
from strandlake.operators import curate as cu
from strandlake.operators import designs as dg
from strandlake.operators import distributions as ds
from strandlake.operators import kmers, orf
from strandlake.operators import stats as st


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [("acgt\nRYN", "ACGTNNN"), ("A C G T", "ACGT"), ("A|C", "ANC"), ("", ""), ("ßé\U0001f600", "NNN"), ("A\r\nC\tG", "ACG")])
def test_clean(spark, raw, want):
    assert one(spark, tx.clean(F.col("s")), s=raw) == want


def test_prompt(spark):
    assert one(spark, tx.prompt_reason(F.col("s")), s=" acgt\n" * 20) is None
    assert one(spark, tx.prompt_reason(F.col("s")), s=" acgt\n" * 20 + "X") == "non-ACGTN"
    assert one(spark, tx.prompt_reason(F.col("s")), s="ACGT") == "too short"


def test_ids_to_text(spark):
    assert one(spark, tx.ids_to_text(F.array(*map(F.lit, [65, 67, 71, 84, 78])))) == "ACGTN"
    assert len(one(spark, tx.ids_to_text(F.array(*map(F.lit, [1, 255, 999]))))) == 3
    assert one(spark, tx.ids_to_bases(F.array(*map(F.lit, [65, 0, 84])))) == "ANT"


@pytest.mark.parametrize("s,k,want", [("CGT", 3, 38), ("A", 3, 120), ("", 3, 124), ("NGT", 3, 113)])
def test_context_code(spark, s, k, want):
    assert one(spark, tx.context_code(F.col("s"), k), s=s) == want


def test_split_and_held_out(spark):
    assert one(spark, tx.split_point(F.col("s")), s="ACGTACGTAC") == 9
    w, off, split = cu.held_out_window(F.lit("ACGT" * 50), 0.1, 80)
    assert (one(spark, F.char_length(w)), one(spark, off), one(spark, split)) == (80, 60, 180)


def test_markov(spark):
    t = {(r["ctx"], r["nxt"]): r["cnt"] for r in kmers.transitions(spark.createDataFrame([("ACGTAC",)], ["seq"]), 1).collect()}
    assert t == {("A", "C"): 2, ("C", "G"): 1, ("G", "T"): 1, ("T", "A"): 1}
    p = {(r["ctx"], r["nxt"]): r["prob"] for r in kmers.smoothed(kmers.transitions(spark.createDataFrame([("AAA",)], ["seq"]), 2)).collect()}
    assert p["AA", "A"] == pytest.approx(1.1 / 1.5) and p["AA", "C"] == pytest.approx(0.1 / 1.5)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 127, 128, 129, 300])
def test_windows_lengths(spark, n):
    s = ("ACGT" * 80)[:n]
    got = sorted((r["pos"], r["kmer"]) for r in kmers.windows(spark.createDataFrame([(1, s)], ["id", "seq"]), 4, ["id"], pos=True).collect())
    assert got == [(i, s[i : i + 4]) for i in range(n - 3)]


def test_lookup_model():
    def hit(s, k=4):
        return dc.Lookup(k).match(np.array([dc.SYMBOLS.index(c) for c in s]))

    assert hit("A" * 10) == (5, 0) and hit("ATGCATGC") == (0, 0)
    assert hit("ACGT") is None and hit("ACGTGCAATTGC") is None
    p = dc.Lookup(4, 0.9).probs(np.array([dc.SYMBOLS.index(c) for c in "ATGCATGC"]))
    assert p[0] == pytest.approx(0.92) and p[1] == pytest.approx(0.02)


def test_orfs(spark):
    s = "CC" + "ATG" + "AAA" * 20 + "TAA" + "G"
    got = [tuple(r) for r in orf.complete(spark.createDataFrame([(1, s)], ["doc_id", "seq"]), ["doc_id"]).collect()]
    assert (1, 1, 2, 2, 68, 66) in got
    m = {r["doc_id"]: r for r in orf.metrics(spark.createDataFrame([(1, s), (2, ""), (3, "AC")], "doc_id int, seq string")).collect()}
    assert m[1]["n_orfs"] >= 1 and m[2]["n_orfs"] == 0 and m[3]["coding_frac"] == 0


def _span(w):
    best = 0
    comp = w.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]
    for s in (w, comp):
        for f in range(3):
            stop = f - 3
            for p in range(f, len(s) - 2, 3):
                stop = p if s[p : p + 3] in orf.STOPS else stop
                best = max(best, p - stop)
    return best


def test_open_span(spark):
    rng = np.random.default_rng(1)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in (0, 1, 2, 3, 4, 5, 50, 400, 801)]
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, seq string")
    assert {r["i"]: r["span"] for r in orf.open_span(df, ["i"]).collect()} == {i: _span(s) for i, s in enumerate(seqs)}


def test_transform(spark):
    p = one(spark, ds.transformed(F.array(*[F.lit(float(i)) for i in range(5)]), 1.0, 2))
    assert [x > 0 for x in p] == [False] * 3 + [True] * 2 and p[4] > p[3]
    assert one(spark, ds.transformed(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)), 0.0)) == [0, 1, 0]
    assert one(spark, ds.keep_top(F.array(*[F.lit(0.0)] * 4), 2)) == [0.5, 0.5, 0, 0]
    assert one(spark, ds.normalised(F.array(F.lit(-1.0), F.lit(0.0)))) == [0.5, 0.5]


def test_acceptance(spark):
    assert one(spark, ds.acceptance(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(1.0), F.lit(0.0)))) == 0.5
    assert one(spark, ds.residual(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(0.5), F.lit(1.0)))) == [0.0, 1.0]
    for alphas, want in (((1.0, 1.0, 1.0), 4.0), ((0.0, 0.0), 1.0), ((0.5, 0.5), 1.75)):
        df = spark.createDataFrame([(1, i, a) for i, a in enumerate(alphas)], ["g", "pos", "a"])
        assert ds.predicted_length(df, ["g"], "pos", "a").first()["tau"] == pytest.approx(want)
    assert one(spark, acc.prefix_length(F.array(F.lit(True), F.lit(False), F.lit(True)))) == 1
    a, b = (F.array(*map(F.lit, x)) for x in ((1, 2, 3), (1, 2)))
    assert one(spark, acc.first_disagreement(a, b)) == 2 and one(spark, acc.first_disagreement(a, a)) is None


def test_greedy_verify():
    p = np.array([[0.2, 0.4, 0.4, 0], [0.1, 0.1, 0.1, 0.7], [0.25] * 4])
    v = dc.verify_greedy(np.array([1, 3]), p)
    assert (v.accepted, v.tokens, v.corrected) == (2, [1, 3, 0], False)
    v = dc.verify_greedy(np.array([2, 3]), p)
    assert (v.accepted, v.tokens, v.corrected) == (0, [1], True)
    q = np.zeros((2, 3, 8))
    q[:, 0, 2] = q[:, 1, 7] = q[:, 2, 3] = 1
    v = dc.verify_greedy(np.array([[0, 0], [2, 7]]), q)
    assert v.tokens == [2, 7, 3] and v.winner == 1


def test_sampling_keeps_the_law():
    p, q = np.array([[0.1, 0.2, 0.3, 0.4], [0.25] * 4]), np.array([[0.4, 0.3, 0.2, 0.1]])
    rng = np.random.default_rng(7)
    n = 20_000
    got = np.bincount([dc.verify_sample(np.array([dc.draw(q[0], rng)]), q, p, rng).tokens[0] for _ in range(n)], minlength=4)
    assert ((got - n * p[0]) ** 2 / (n * p[0])).sum() < 16.3  # chi-square, 3 degrees, p > 0.001
    multi = np.bincount([dc.verify_sample(np.array([[dc.draw(q[0], rng)], [dc.draw(q[0], rng)]]), np.stack([q, q]), np.stack([p, p]), rng).tokens[0] for _ in range(n)], minlength=4)
    assert ((multi - n * p[0]) ** 2 / (n * p[0])).sum() < 16.3
    never = dc.verify_sample(np.array([2]), np.array([[0, 0, 0.5, 0.5]]), np.array([[0.5, 0.5, 0, 0], [0.25] * 4]), rng)
    assert never.corrected and never.tokens[0] in (0, 1)


def test_speculative_equals_native():
    rng = np.random.default_rng(3)
    for _ in range(20):
        t, d = (dc.Bigram(rng.dirichlet(np.ones(5), 5), rng.dirichlet(np.ones(5))) for _ in range(2))
        want = dc.native(t, [1], 50, None)
        for gamma in (1, 3, 8):
            assert dc.speculative(t, d, [1], 50, gamma, None)[0] == want
    assert all(k == 4 for k in dc.speculative(t, dc.Identity(t), [1], 40, 4, None)[1])


def test_largest_remainder(spark):
    def share(total, sizes):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], ["i", "s"])
        return [r["alloc"] for r in cu.largest_remainder(df, F.lit(total), "s", [], "i").orderBy("i").collect()]

    assert share(10, [3, 7]) == [3, 7] and share(7, [0, 0, 0]) == [3, 2, 2]
    assert sum(share(7, [1, 1, 1])) == 7 and max(share(7, [1, 1, 1])) - min(share(7, [1, 1, 1])) <= 1


def test_water_fill(spark):
    def fill(avail, w, cap):
        df = spark.createDataFrame([(f"s{i}", a, x) for i, (a, x) in enumerate(zip(avail, w))], ["s", "n", "w"])
        return [(r["alloc"], r["capped"]) for r in cu.water_fill(df, "n", "w", "s", cap).orderBy("s").collect()]

    assert fill([10, 990], [0.9, 0.1], 2.0) == [(20, True), (980, False)]
    assert [a for a, _ in fill([10_000] * 3, [0.5, 0.3, 0.2], 2.0)] == [15_000, 9_000, 6_000]
    rng = np.random.default_rng(0)
    for _ in range(3):
        n, w = rng.integers(1, 1000, 6).tolist(), rng.random(6).tolist()
        got = fill(n, w, 2.0)
        assert sum(a for a, _ in got) == sum(n) and all(a <= 2 * x + 1 for (a, _), x in zip(got, n))


def test_epoch_windows(spark):
    df = spark.createDataFrame([("small", 4, 8), ("big", 100, 96)], ["s", "n", "t"])
    v = cu.epoch_windows(df, "n", "t", ["s"], 1).groupBy("s", "window").count()
    got = {s: sorted(r["count"] for r in v.where(F.col("s") == s).collect()) for s in ("small", "big")}
    assert got == {"small": [2] * 4, "big": [1] * 96}


def test_packing(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["AAAA", "CC", "", "GG", "T" * 60])], ["g", "i", "seq"])
    got = [(r["chunk"], r["n"], r["text"]) for r in cu.pack(df, ["g"], "i", limit=24).orderBy("chunk").collect()]
    assert got == [(0, 2, "AAAA" + "N" * 16 + "CC"), (1, 1, "GG"), (2, 1, "T" * 60)] or got[0][1] == 2
    w = cu.stitched_windows(spark.createDataFrame([(1, i, s) for i, s in enumerate(["AAAA", "CC", "GG"])], ["g", "i", "seq"]), ["g"], "i", window=4)
    assert [r["text"] for r in w.orderBy("i").collect()] == ["AAAA", "CCNN", "NNNN", "NNNN", "NNNN", "NNGG"]


def test_shards(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([3, 0, 9, 4])], ["g", "i", "n"])
    lay = cu.shard_layout(df, ["g"], "i", "n", 5)
    assert {r["shard_idx"]: r["m"] for r in lay.groupBy("shard_idx").agg(F.sum("n_pos").alias("m")).collect()} == {0: 5, 1: 5, 2: 5, 3: 1}


def test_auroc(spark):
    def auc(y, s):
        return st.auroc(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], ["y", "s"]), "y", "s").first()["auc"]

    assert auc([0, 1, 0, 1], [1, 2, 1, 2]) == 1 and auc([0, 1, 0, 1], [1, 1, 1, 1]) == 0.5
    assert auc([0, 1], [2, 1]) == 0 and auc([1, 1], [1, 2]) is None


def test_budget_curve(spark):
    df = spark.createDataFrame([(1, 1, 3.0, True, "x"), (1, 2, 4.0, True, "x"), (1, 3, 4.0, True, "y")], ["g", "i", "s", "q", "item"])
    got = [(r["seconds"], r["qualified_unique"]) for r in dg.budget_curve(df, ["g"], "i", "s", F.col("q"), "item", 9.0).orderBy("seconds").collect()]
    assert got == [(0, 0), (3, 1), (7, 1), (9, 1)]


def test_pattern(spark):
    assert one(spark, dg.pattern("medium", 3072, 128)) == ([1.0] * 6 + [0.0] * 6) * 2
    assert one(spark, dg.pattern("short", 3072, 128)) == ([1.0] * 3 + [0.0] * 9) * 2
    assert len(one(spark, dg.pattern("arc", 19968, 128))) == 156
    with pytest.raises(ValueError):
        dg.pattern("medium", 100, 128)


def test_fisher(spark):
    df = spark.createDataFrame([(3, 1, 1, 3), (0, 0, 1, 2), (10, 2, 3, 15)], ["a", "b", "c", "d"])
    got = {r["a"]: r["pvalue"] for r in st.fisher(df, "a", "b", "c", "d").collect()}
    assert got[3] == pytest.approx(0.4857142857) and got[0] == 1.0 and got[10] == pytest.approx(0.0005367, abs=1e-6)


def test_cluster_bootstrap(spark):
    df = spark.createDataFrame([(g, float(g)) for g in (1, 2, 3, 4) for _ in range(3)], ["g", "v"])
    r = st.cluster_bootstrap(df, "v", "g", 400, 1).first()
    assert r["estimate"] == 2.5 and r["lo"] < 2.0 and r["hi"] > 3.0
    with pytest.raises(Exception, match="unequal"):
        st.cluster_bootstrap(df.limit(11), "v", "g", 10, 1).collect()


def test_windows_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(kmers, "PIECE", 100)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (0, 5, 99, 100, 101, 205, 1000)]
    df = spark.createDataFrame(list(enumerate(texts)), ["id", "seq"])
    for k in (1, 7, 130):  # also windows longer than a piece
        got = sorted(tuple(r) for r in kmers.windows(df, k, ["id"], pos=True).select("id", "pos", "kmer").collect())
        assert got == sorted((i, p, t[p : p + k]) for i, t in enumerate(texts) for p in range(len(t) - k + 1))
    got = sorted(tuple(r) for r in kmers.rolling(df, 4, ["id"]).collect())
    assert got == sorted((i, p, t[max(0, p - 3) : p + 1]) for i, t in enumerate(texts) for p in range(len(t)))


def test_frames_over_many_blocks(spark):
    """Starts whose stop lies blocks away, and spans over blocks, as by a plain scan."""
    rng = np.random.default_rng(4)
    codons = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT" if a + b + c not in orf.STOPS + ("ATG",)]
    seq = "ATG" + "".join(rng.choice(codons, 50_000)) + "TAA" + "".join(rng.choice(codons, 3000)) + "ATG" + "".join(rng.choice(codons, 100)) + "TGA"
    df = spark.createDataFrame([(1, seq)], ["id", "seq"])
    got = {tuple(r) for r in orf.complete(df, ["id"]).where("strand = 1 AND frame = 0").select("start", "end").collect()}
    want, starts = set(), []
    for p in range(0, len(seq) - 2, 3):
        c = seq[p : p + 3]
        if c == "ATG":
            starts.append(p)
        elif c in orf.STOPS:
            want |= {(s, p + 3) for s in starts if p + 3 - s >= 60}
            starts = []
    assert got == want and len(want) == 2
    best = 0
    for strand in (seq, seq[::-1].translate(str.maketrans("ACGT", "TGCA"))):
        for f in range(3):
            last = f - 3
            for p in range(f, len(strand) - 2, 3):
                last = p if strand[p : p + 3] in orf.STOPS else last
                best = max(best, p - last)
    assert orf.open_span(df, ["id"]).first()["span"] == best


def test_running_sums_by_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(["a", "b", None][int(rng.integers(3))], int(rng.integers(50)), i, int(rng.integers(1, 9))) for i in range(800)] + [("hot", 7, i, 1) for i in range(1000, 1400)]
    df = spark.createDataFrame(rows, "g string, o long, id long, n long")
    for keys in (["g"], []):
        got = {r["id"]: r["s"] for r in cu.running(df, keys, "o", "n", "s", ["id"]).collect()}
        seen, want = {}, {}
        for g, o, i, n in sorted(rows, key=lambda r: (r[1], r[2])):
            k = g if keys else 0
            want[i] = seen.get(k, 0)
            seen[k] = want[i] + n
        assert got == want
    assert cu.running(df.where("id < 0"), ["g"], "o", "n", "s").count() == 0


def test_evenly_spaced_ranks(spark):
    df = spark.createDataFrame([("a", i * 3) for i in range(100)] + [("b", 1), ("b", 2)], "g string, o long")
    got = sorted(tuple(r) for r in cu.evenly_spaced(df, ["g"], "o", 4).collect())
    assert got == [("a", 0), ("a", 99), ("a", 198), ("a", 297), ("b", 1), ("b", 2)]


def test_chains_by_doubling(spark):
    rows = [(i, i - 1 if i else None, f"{i}.") for i in range(37)] + [(100, None, "x"), (101, 100, "y"), (200, 201, "c"), (201, 200, "c"), (300, 999, "lost")]
    got = {r["node"]: (r["depth"], r["path"]) for r in dg.chains(spark.createDataFrame(rows, "id long, up long, t string"), "id", "up", "t").collect()}
    assert got == {i: (i, "".join(f"{k}." for k in range(i + 1))) for i in range(37)} | {100: (0, "x"), 101: (1, "xy")}


def test_identities_of_pairs_and_of_asking_rows(spark, monkeypatch):
    monkeypatch.setattr(kmers, "PIECE", 4)
    texts = {1: "ACGTACGTAC", 2: "ACGTACGTTT", 3: "ACG", 4: "ACGTACGTAC", 5: ""}
    df = spark.createDataFrame([("s", k, v) for k, v in texts.items()], "g string, id long, seq string")
    every = {(r["a"], r["b"]): r["identity"] for r in dg.identities(df, "id", "seq", ["g"]).collect()}
    assert every == {(1, 2): 0.8, (1, 4): 1.0, (2, 4): 0.8}
    asked = {(r["a"], r["b"]): r["identity"] for r in dg.identities(df, "id", "seq", ["g"], F.col("id").isin(2, 4)).collect()}
    assert asked == {(2, 1): 0.8, (2, 4): 0.8, (4, 1): 1.0}


def test_merged_histograms(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 1.95), ("b", 0.06), ("b", 2.0), ("b", 2.5), ("b", None)], "g string, v double")
    out = ds.finalised(ds.merged_histograms(ds.histograms(df, "v", ["g"]))).first()
    assert out["n"] == 4 and out["counts"][0] == 2 and out["counts"][19] == 2 and sum(out["counts"]) == 4
    assert out["mean"] == pytest.approx((0.05 + 1.95 + 0.06 + 2.0) / 4)
    other = ds.histograms(df, "v", ["g"], 0.5).unionByName(ds.histograms(df, "v", ["g"]))
    with pytest.raises(Exception, match="other edges"):
        ds.merged_histograms(other).collect()


def test_bootstrap_of_a_user_statistic(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 400, 1500), rng.integers(100, 103, 700)
    df = spark.createDataFrame([("a", int(x)) for x in a] + [("b", int(x)) for x in b] + [("b", None)], "g string, v long")
    got = {r["g"]: r for r in st.bootstrap_statistic(df, "g", "v", st.weighted_median, 200, 1).collect()}
    for g, v in (("a", a), ("b", b)):
        m = np.median(rng.choice(v, (400, len(v))), axis=1)
        assert got[g]["n"] == len(v)
        assert got[g]["lo"] == pytest.approx(np.quantile(m, 0.025), abs=6) and got[g]["hi"] == pytest.approx(np.quantile(m, 0.975), abs=6)
    w = rng.integers(0, 4, (50, 9))
    w[:, 0] += 1
    v = np.sort(rng.normal(size=9))
    assert st.weighted_median(v, w) == pytest.approx([np.median(np.repeat(v, x)) for x in w])


def test_log_factorials(spark):
    import math

    for n in (0, 1, 20, 21, 50, 1000, 123_456):
        assert one(spark, st.log_factorial(F.lit(n))) == pytest.approx(math.lgamma(n + 1), rel=1e-13, abs=1e-10)


def test_rounds_in_batches_keep_the_law():
    rng = np.random.default_rng(11)
    n, p0, q0 = 40_000, np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.4, 0.3, 0.2, 0.1])
    p1 = np.array([0.7, 0.1, 0.1, 0.1])
    drafts = rng.choice(4, (n, 2, 1), p=q0)
    p = np.broadcast_to(np.stack([p0, p1]), (n, 2, 2, 4))
    out = dc.sampled_rounds(drafts, np.broadcast_to(q0 * 3, (n, 2, 1, 4)), p, rng)  # rows need not be normalised
    for got, law in ((out.tokens[:, 0], p0), (out.tokens[out.accepted == 1, 1], p1)):
        m = len(got)
        assert ((np.bincount(got, minlength=4) - m * law) ** 2 / (m * law)).sum() < 16.3
    single = dc.sampled_rounds(drafts[:, :1], np.broadcast_to(q0, (n, 1, 1, 4)), p[:, :1], rng)
    assert single.accepted.mean() == pytest.approx(np.minimum(p0, q0).sum(), abs=0.01) and out.accepted.mean() > single.accepted.mean() + 0.05
    want = np.array([dc.verify_greedy(d, t).tokens[0] for d, t in zip(drafts[:50], p[:50])])
    assert (dc.greedy_rounds(drafts[:50], p[:50]).tokens[:, 0] == want).all()
