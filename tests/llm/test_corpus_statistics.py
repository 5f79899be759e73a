"""Source divergence, phrase collocations and fingerprints against brute force, planted cases and odd rows."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import divergence, parsing, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = {"term": 9, "n": 9, "p": 9, "value": 9, "rank": 9, "phrase": 9, "place": 9, "kind": 9, "digest": 9, "row": 9, "fingerprint": 9}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture
def prose(docs_of):
    rng = random.Random(4)
    vocab = ["w" + "".join(rng.choices("abcdé", k=rng.randint(1, 3))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(vocab, k=60)) + rng.choice([".", " x, Y! ", ""]), rng.choice(["en", "de"]), f"s{rng.randint(0, 3)}") for i in range(80)]
    rows += [(100 + i, "Copied words, again and again; the same", "en", "s0") for i in range(30)]
    return [*rows, (900, None, "en", None), (901, "lonely", "fr", "s9"), (902, "12 34", "fr", "s8"), (903, "no lang", None, "s1")]


# 11


def brute_divergence(rows, least, top):
    texts = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER))) for r in rows]
    out = set()
    for lang in {t[0] for t in texts}:
        own = [t for t in texts if t[0] == lang]
        df = collections.Counter(w for t in own for w in set(t[2]))
        kept = [w for w, n in df.items() if n >= least]

        def prices(group):
            c = collections.Counter(w for t in group for w in t[2])
            total = sum(c[w] for w in kept)
            return {w: (c[w], 1 + 1_000_000_000 * (c[w] + 1) // (total + len(kept))) for w in kept}

        whole = prices(own)
        by = {s: prices([t for t in own if t[1] == s]) for s in {t[1] for t in own}}
        f = lambda p, q: (p - q) ** 2 // q
        for s, p in by.items():
            pairs = [(sum(f(p[w][1], q[w][1]) for w in kept), o) for o, q in by.items() if o != s]
            terms = [(f(p[w][1], whole[w][1]), w) for w in kept if p[w][0] and p[w][1] > whole[w][1]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= top}
    return out


@pytest.mark.parametrize("least,top", [(3, 200), (1, 5), (1000, 5)])
def test_divergence_by_brute_force(docs_of, prose, least, top):
    got = divergence.divergence(clashing(docs_of(prose)), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == brute_divergence(prose, least, top)


def test_divergence_in_small_pieces(docs_of, prose, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 20)
    text = "Ab ab, ab ÉÀ" * 50 + "x" * 100
    assert [t for ts in divergence.terms(text.encode()) for t in ts] == [t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))]


def test_divergence_of_odd_rows(odd, odd_rows, docs_of):
    assert {tuple(r) for r in divergence.divergence(odd, 1, 50).collect()} == brute_divergence(odd_rows, 1, 50)
    assert divergence.divergence(docs_of([])).collect() == []


# 12


def brute_collocations(rows, words, least, percent, top):
    f, n = collections.Counter(), collections.Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, words + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = set()
    for lang in n:
        found = []
        for (of, p), a in f.items():
            if of != lang or len(p) < 2:
                continue
            if any(o == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in f.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize("words,least,percent,top", [(3, 10, 50, 2000), (2, 3, 50, 7), (4, 5, 80, 2000), (3, 1, 50, 40)])
def test_collocations_by_brute_force(docs_of, prose, words, least, percent, top):
    got = phrases.collocations(clashing(docs_of(prose)), words, least, percent, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = {tuple(r) for r in got.collect()}
    assert got == brute_collocations(prose, words, least, percent, top)
    assert got


def test_collocations_from_a_full_bitmap(docs_of, prose, monkeypatch):
    """A bitmap with far too few bits changes what is counted, not the result."""
    long = "one two\t three  " * 40 + "four"
    rows = [*prose, *((2000 + i, long, "en", "s") for i in range(2))]
    want = brute_collocations(rows, 3, 10, 50, 2000)
    assert {tuple(r) for r in phrases.collocations(docs_of(rows)).collect()} == want
    bitmap = phrases.bitmap
    monkeypatch.setattr(phrases, "bitmap", lambda *a: b"\xff" * len(bitmap(*a)))
    assert {tuple(r) for r in phrases.collocations(docs_of(rows)).collect()} == want


@pytest.mark.parametrize("step", [40, 1 << 18])
def test_phrases_of_batches(prose, monkeypatch, step):
    from strandlake.llm import words

    monkeypatch.setattr(words, "_STEP", step)
    words._powers.clear()
    texts = [r[1] for r in prose] + ["a b\tc  d", " x\n\ny z. q", "", None, "É é!ß", "one two three " * 60, "\x00a \x1cb"]
    g = phrases.Grams(pa.array(texts, pa.string()))
    for k in (1, 2, 3, 5):
        at = np.flatnonzero(g.places(k))
        of = np.searchsorted(g.bounds, at, "right") - 1
        got = list(zip(of.tolist(), g.phrases(at, k)))
        want = []
        for i, t in enumerate(texts):
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
                ws = re.findall(r"[^\x20\x09]+", piece)
                want += [(i, " ".join(ws[j : j + k]).encode()) for j in range(len(ws) - k + 1)]
        assert got == want
    words._powers.clear()


def test_bitmap_lets_all_frequent_phrases_through(spark):
    rows = [("en", f"wörd {i}") for i in range(500)] + [("de", "x"), ("de", "a b c")]
    bits = phrases.bitmap(spark, spark.createDataFrame(rows, "lang string, phrase string"))
    assert len(bits) * 8 == phrases.BITS and 0 < sum(map(int.bit_count, bits)) <= 502

    def on(lang, p):
        g = phrases.Grams(pa.array([p]))
        h = g.hash[:1]
        for w in g.hash[1:]:
            h = phrases.chained(h, np.array([w]))
        (bit,) = phrases._bits(h, np.array([phrases._seed(lang)])).tolist()
        return bits[bit >> 3] >> (bit & 7) & 1

    assert all(on(*r) for r in rows) and not any(on("fr", p) for _, p in rows[:50])


def test_collocations_of_odd_rows(odd, odd_rows, docs_of):
    assert {tuple(r) for r in phrases.collocations(odd, least=2).collect()} == brute_collocations(odd_rows, 3, 2, 50, 2000)
    assert phrases.collocations(docs_of([])).collect() == []


# 13

M64 = (1 << 64) - 1


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def toss(x, left):
    j = ((x ^ left) & -(x ^ left)).bit_length() - 1
    return 2 * j + (x >> j & 1)


def brute_levels(text):
    """[(name, start, end), ...] for each level, one symbol at a time."""
    out = [[(mix(b + 1), i, i + 1) for i, b in enumerate(text)]]
    while len(out[-1]) > 1:
        runs = []
        for name, a, b in out[-1]:
            if runs and runs[-1][0] == name:
                runs[-1] = (name, runs[-1][1], b, runs[-1][3] + 1)
            else:
                runs.append((name, a, b, 1))
        x = [name if k == 1 else mix((name * 0xD6E8FEB86659FD93 + k) & M64) for name, _, _, k in runs]
        label = x
        for _ in range(4):
            label = [toss(v, label[i - 1] if i else v ^ 1) for i, v in enumerate(label)]
        for c in (5, 4, 3):
            label = [min({0, 1, 2} - set(label[max(0, i - 1) : i] + label[i + 1 : i + 2])) if v == c else v for i, v in enumerate(label)]
        assert set(label) <= {0, 1, 2} and all(a != b for a, b in zip(label, label[1:]))
        at = [i for i in range(len(x)) if i == 0 or i + 1 < len(x) and label[i] > label[i - 1] and label[i] > label[i + 1]] + [len(x)]
        assert all(2 <= b - a <= 5 for a, b in zip(at[1:], at[2:]))
        phrases = []
        for a, b in zip(at, at[1:]):
            h = mix(b - a + (1 << 32))
            for v in x[a:b]:
                h = mix((h * 0xD6E8FEB86659FD93 + v) & M64)
            phrases.append((h, runs[a][1], runs[b - 1][2]))
        out.append(phrases)
    return out


SAMPLES = ["", "a", "aa", "ab", "aba", "a" * 1000, "abc" * 700, "word " * 300, "ß é \U0001f600   x"]


@pytest.fixture(scope="module")
def samples(tiny):
    return [t.encode() for t in SAMPLES + [r["text"] for r in tiny.limit(40).collect()]]


@pytest.mark.parametrize("group", [1 << 19, 50, 400])
def test_parsing_by_brute_force(samples, monkeypatch, group):
    monkeypatch.setattr(parsing, "GROUP", group)
    for texts in ([t] for t in samples) if group < 1000 else [samples]:
        got = collections.defaultdict(list)
        for k, of, name, size in parsing.parsed(texts):
            for t, n, s in zip(of.tolist(), name.tolist(), size.tolist()):
                got[t, k].append((n, s))
        want = {}
        for t, text in enumerate(texts):
            levels = brute_levels(text) if text else []
            want |= {(t, k): [(n, b - a) for n, a, b in names] for k, names in enumerate(levels) if k >= parsing.LOW or len(names) == 1}
        assert got == want


def test_equal_substrings_share_interior_names_at_any_offset(samples):
    rng = random.Random(3)
    inner = samples[20][:1200]
    for n in (1, 2, 3, 17, 100):
        a, b = (bytes(rng.choices(b"abcdefgh ", k=n + x)) for x in (0, 5))
        for k, (x, y) in enumerate(zip(brute_levels(a + inner + b), brute_levels(inner))):
            edge = parsing.MARGIN * 5**k
            there = {(name, s - n, e - n) for name, s, e in x}
            deep = {(name, s, e) for name, s, e in y if s >= edge and e <= len(inner) - edge}
            assert deep <= there
        code = parsing.codes([a + inner + b, inner])
        assert parsing.alike(code[:1], code[1:])[0] > 0.6


def test_fingerprints_are_strings_of_codes(spark, samples):
    code = parsing.codes(samples)
    assert (parsing.unpacked(parsing.packed(code)) == code).all()
    fp = [base64.b64encode(x).decode() for x in parsing.packed(code)]
    assert all(len(x) == 2 * parsing.SLOTS for x in fp)
    alone = np.concatenate([parsing.codes([t]) for t in samples])
    assert (alone == code).all()
    rows = spark.createDataFrame([(i, fp[i], fp[(i * 7 + 1) % len(fp)], fp[i]) for i in range(len(fp))], "i long, a string, b string, c string")
    found = sorted(rows.select("i", parsing.likeness(F.col("a"), F.col("b")), parsing.likeness(F.col("a"), F.col("c"))).collect())
    assert [r[1] for r in found] == pytest.approx([parsing.alike(code[i : i + 1], code[(i * 7 + 1) % len(fp)][None])[0] for i in range(len(fp))])
    assert all(r[2] == 1.0 for r in found)


def brute_neighbours(rows):
    """(doc_id, n_chars, sha, near texts equal) for distinct ids in descending order."""
    rows = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    out = {}
    for i, (doc_id, t) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        n = len(t) // 3
        e = t[: len(t) - n] + other[:n]
        a, b, c = parsing.codes([t.encode(), e.encode(), other.encode()])
        fp = [base64.b64encode(x).decode() for x in parsing.packed(np.stack([a, b]))]
        out[doc_id] = (len(t), hashlib.sha256(e.encode()).hexdigest(), *fp, parsing.alike(a[None], b[None])[0], parsing.alike(a[None], c[None])[0])
    return out


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_neighbours_by_brute_force(spark, docs_of, tiny, parts):
    rows = [(r["doc_id"] * 3, r["text"]) for r in tiny.limit(60).collect()] + [(1, None), (2, ""), (7, "ß é \U0001f600   x"), (10**12, "z")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = parsing.neighbours(clashing(docs_of(rows).repartition(3))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_neighbours(rows) and len(got) == len(rows)


def test_likeness_of_edited_and_unrelated_texts(tiny):
    rows = [r for r in parsing.neighbours(tiny).collect() if r["n_chars"] > 300]
    assert len(rows) > 100 and np.mean([r["near_edited"] for r in rows]) > 0.42 and min(r["near_edited"] for r in rows) > 0.1
    assert sum(r["near_next"] > 0.1 for r in rows) < 0.02 * len(rows) and sum(r["near_edited"] > r["near_next"] for r in rows) > 0.98 * len(rows)


def test_neighbours_of_odd_rows(odd, odd_rows, docs_of):
    got = parsing.neighbours(odd).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == sorted((r[0] or -1, len(r[1] or "")) for r in odd_rows)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    twins = [r["near_next"] for r in got if r["doc_id"] == 6]
    assert len(twins) == 2 and 1.0 in twins
    assert parsing.neighbours(docs_of([])).collect() == []
    (one,) = parsing.neighbours(docs_of([(5, "abcdef")])).collect()
    assert (one["near_next"], one["edited_sha256"]) == (1.0, hashlib.sha256(b"abcdab").hexdigest())
    fp = {r["doc_id"]: r["fingerprint"] for r in parsing.fingerprints(odd).collect()}
    assert all(by[k] == {v} for k, v in fp.items())


# 5: weights of the whole benchmark


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_of_the_benchmark_make_no_difference(spark, docs_of, monkeypatch, block):
    from strandlake.llm import decontaminate

    rng = random.Random(8)
    w = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    opening = w(14)
    items = [(i, f"{opening} {w(20)}") for i in range(20)] + [(30, None), (None, w(9)), (31, "two words")]
    edited = items[3][1].split()
    edited[20:22] = w(2).split()
    docs = docs_of([(1, f"{w(30)} {' '.join(edited)} {w(30)}"), (2, w(200)), (3, items[5][1]), (4, "x two words y"), (5, f"{opening} {w(20)}")])
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(docs, bench).collect()}
    df = collections.Counter(g for _, t in items for g in {tuple((t or "").split()[k : k + 5]) for k in range(len((t or "").split()) - 4)})
    bag = lambda x: collections.Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
    weight = lambda g: np.log(1 + len(items) / df.get(g, 1))
    a, b = bag(items[3][1].split()), bag(edited)
    want = sum(weight(g) * n for g, n in (a & b).items()) / sum(weight(g) * n for g, n in (a | b).items())
    assert set(got) == ({(1, 3)} if want >= 0.8 else set()) | {(3, 5), (4, 31)}
    assert got[3, 5] == pytest.approx(1.0) and got.get((1, 3), want) == pytest.approx(want)


# 4: IBANs and scripts; 3: files


def iban_ok(x):
    x = x.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def test_ibans_keep_their_country_and_valid_check_digits(docs_of):
    from strandlake.llm import pii

    real = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR14 2004 1010 0505 0001 3M02 606", "DE12 3456 7890 1234 5678 90"]
    assert [iban_ok(x) for x in real] == [True, True, True, False]
    got = {r["doc_id"]: r["text"] for r in pii.replace_private(docs_of([(i, f"pay {x} now") for i, x in enumerate(real)])).collect()}
    for i, x in enumerate(real):
        new = got[i].removeprefix("pay ").removesuffix(" now")
        assert new != x and len(new) == len(x) and new[:2] == x[:2] and (iban_ok(new) or not iban_ok(x))
        assert [c for c in new if c == " "] == [c for c in x if c == " "]


def test_full_shapes_of_ibans_stay_in_their_country(spark):
    from strandlake.llm import pii

    parts = spark.createDataFrame([("iban", f"{c}00aa{i}") for c in ("de", "fr") for i in range(10)], ["kind", "canon"])
    got = {r["canon"]: r["new"] for r in pii.surrogates(parts, "k").collect()}
    assert len(set(got.values())) == 20 and all(a != b and a[:2] == b[:2] for a, b in got.items())


def test_names_keep_their_script(docs_of):
    from strandlake.llm import pii

    got = [r["text"] for r in pii.replace_private(docs_of([(1, "Mr Παπαδόπουλος met Κύριος Γιώργος Νικολάου"), (2, "Господин Иванов"), (3, "Mr Smith")])).collect()]
    assert re.fullmatch(r"Mr [Ͱ-Ͽ]+ met Κύριος [Ͱ-Ͽἀ-῿]+ [Ͱ-Ͽ]+", got[0]) and "Νικολάου" not in got[0]
    assert re.fullmatch(r"Господин [Ѐ-ӿ]+", got[1]) and re.fullmatch(r"Mr [A-Za-z]+", got[2])


def test_token_files_are_deleted(spark, docs_of):
    import glob

    from strandlake.llm import common, tokens

    root = common.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/strandlake-tokens-*"))
    rows = tokens.count_tokens(docs_of([(1, "a few words"), (2, None)]))
    assert set(glob.glob(f"{root}/strandlake-tokens-*")) == before and rows.count() == 2
