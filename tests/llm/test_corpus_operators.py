"""Each operator against brute force, planted cases and odd rows."""

import collections
import hashlib
import importlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import chat, common, decontaminate, jaccard, language, mixing, pii, quality, queries, sharding, tokens, toxicity, words
from strandlake.llm.components import components

TINY = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = {"shard": 9, "slot": 9, "size": 9, "target": 9, "kept": 9, "n_entities": 9, "root": 9, "id": 9, "w": 9}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


# words


def test_word_hashes_follow_words():
    texts = ["Ab ab\tAB", None, "", "  x  ", "a" * 3_000_000 + " b", "é É  y\x1cz", "x\ny"]
    h, at = words.word_hashes(pa.array(texts, pa.string()))
    seen = {}
    for i, t in enumerate(texts):
        ws = WORD.findall((t or "").translate(LOWER))
        assert at[i + 1] - at[i] == len(ws)
        for w, x in zip(ws, h[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_pieces_cover_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 100] * 50 + [None, ""])], ["text"])
    parts = list(words.pieces([b], size=1000))
    assert len(parts) > 3 and sum(p.num_rows for p in parts) == 52


# 1


def brute_signals(text):
    ws = WORD.findall(text or "")
    tri = list(zip(ws, ws[1:], ws[2:]))
    often = collections.Counter(tri)
    on = {j for i, t in enumerate(tri) if often[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(on), len(lines)


def test_signals(tiny):
    texts = [r["text"] for r in tiny.collect()] + ["a b c a b c", "a a a a", None, "", "x\nx\n \n \nx", "### <a> | b", "  x\x85y"]
    for t in texts:
        assert quality.base_signals(t) == brute_signals(t)


def test_quality_thresholds_by_brute_force(spark, tiny):
    rows = quality.with_signals(tiny.select("doc_id", "text", "lang", "source")).drop("text")
    got = {(r["lang"], r["source"], r["signal"]): (r["lo"], r["hi"]) for r in quality.thresholds(quality.sketches(rows), 5).collect()}

    def bucket(v):
        s = max(0, v.bit_length() - 7)
        return v >> s << s

    data = [r for r in rows.collect() if r["n_words"]]
    for (lang, source, signal), (lo, hi) in got.items():
        num, den, floor, two = quality.SIGNALS[signal]
        for pick in (lambda r: r["lang"] == lang and r["source"] == source, lambda r: r["lang"] == lang, lambda r: True):
            v = sorted(bucket(r[num] * 1000 // r[den]) for r in data if pick(r))
            if len(v) >= 5 or pick(collections.defaultdict(str)):
                break
        q1, q3 = (next(x for i, x in enumerate(v) if (i + 1) * 4 >= len(v) * k) for k in (1, 3))
        spread = max(q3 - q1, floor)
        assert (lo, hi) == (q1 - 3 * spread if two else -1, q3 + 3 * spread)


def test_quality_keeps_clean_and_drops_junk(spark, docs_of):
    rng = random.Random(1)
    vocab = ["w" + "".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for _ in range(500)]
    clean = [(i, " ".join(rng.choices(vocab, k=200))) for i in range(300)]
    junk = [(900 + i, " ".join(w + "$$$" for w in rng.choices(vocab, k=200))) for i in range(10)]
    got = {r["doc_id"]: r for r in quality.quality(docs_of([*clean, *junk, (999, "too short")])).collect()}
    assert all(got[i]["kept"] for i, _ in clean) and not any(got[i]["kept"] for i, _ in junk)
    assert got[999]["base_failed"] and not got[999]["kept"]


# 2


def test_sharding_balance_and_slots(tiny):
    rows = sharding.shard(tiny).collect()
    counts = collections.Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    texts = {r["doc_id"]: r["text"] for r in tiny.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)


def test_ring_walks_clockwise():
    rng = random.Random(2)
    counts = {c: rng.randint(1, 9) for c in rng.sample(range(1024), 300)}
    counts[5] = 4000  # a hot key
    plan = sharding.place(counts, 8, 16, 1024, 0.0)
    got = collections.Counter()
    for cell, lo, hi, s, slot in plan:
        assert slot == got[s]
        got[s] += hi - lo
    assert max(got.values()) - min(got.values()) <= 1 and sum(got.values()) == sum(counts.values())
    points = sharding.ring(8, 16, 1024)
    home = lambda c: next((s for at, s in points if at >= c), points[0][1])
    loose = sharding.place({c: n for c, n in counts.items() if c != 5}, 8, 16, 1024, 0.5)
    stay = sum(hi - lo for c, lo, hi, s, _ in loose if s == home(c))
    assert stay >= 0.9 * sum(n for c, n in counts.items() if c != 5)


def walked(counts, shards, vnodes, cells, room):
    """Rows of each shard by a walk of one row at a time: from its cell on to the next point whose shard has room."""
    points = sharding.ring(shards, vnodes, cells)
    waiting = [(next((i for i, (at, _) in enumerate(points) if at >= c), 0), c) for c in sorted(counts) for _ in range(counts[c])]
    used, step = collections.Counter(), 0
    while waiting:
        left = []
        for i, c in waiting:  # all rows take a step together: who stands nearest comes first
            s = points[(i + step) % len(points)][1]
            if used[s] < room[s]:
                used[s] += 1
            else:
                left.append((i, c))
        waiting, step = left, step + 1
    return used


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_ring_by_a_walk_row_by_row(slack):
    rng = random.Random(4)
    counts = {c: rng.randint(1, 6) for c in rng.sample(range(256), 90)} | {17: 300}
    got = collections.Counter()
    for _, lo, hi, s, _ in sharding.place(counts, 6, 8, 256, slack):
        got[s] += hi - lo
    total = sum(counts.values())
    if slack:
        room = {s: max(total // 6 + 1, -(-((1 + slack) * total) // 6)) for s in range(6)}
    else:  # one more for the shards with most rows of their own, by walking the ring from each cell
        around = dict(sharding.ring(6, 8, 256))
        home = lambda c: next(around[(c + k) % 256] for k in range(256) if (c + k) % 256 in around)
        own = collections.Counter()
        for c, n in counts.items():
            own[home(c)] += n
        order = sorted(range(6), key=lambda s: (-own[s], s))
        room = {s: total // 6 + (i < total % 6) for i, s in enumerate(order)}
    assert walked(counts, 6, 8, 256, room) == got


def test_few_rows_move_to_a_new_shard(tiny):
    """With slack a row stays on its shard or goes to the new one, but for the few that overflow."""
    docs = tiny.select("doc_id", "text")
    before = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, shards=8, slack=0.5).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, shards=9, slack=0.5).collect()}
    moved = [i for i in before if before[i] != after[i]]
    assert len(moved) <= 0.3 * len(before) and sum(after[i] != 8 for i in moved) <= 0.1 * len(before)


def test_placement_follows_from_key_and_content(spark, tiny, docs_of):
    rows = [(None, "same")] * 40 + [(7, "same")] * 30 + [(7, f"text {i % 5}") for i in range(30)]
    docs = tiny.select("doc_id", "text", "lang", "source", "n_chars").union(docs_of(rows))
    one, two = (sorted((tuple(r) for r in sharding.shard(d).drop("grown_shard").collect()), key=repr) for d in (docs, docs.repartition(7)))
    assert one == two
    whole = [sorted((r["doc_id"] or -1, r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_documents(d).collect()) for d in (docs, docs.repartition(5))]
    assert whole[0] == whole[1]


def test_sharding_of_a_hot_key(spark, docs_of):
    same = [(None, "one text for many rows")] * 700 + [(5, "another text")] * 300
    rows = same + [(None, f"no id {i}") for i in range(500)] + [(i, f"text {i}") for i in range(10, 510)]
    for out in (sharding.shard(docs_of(rows), blocks=8), sharding.shard_documents(docs_of(rows), blocks=8)):
        got = out.collect()
        assert collections.Counter((r["size"], r["text_crc32"]) for r in got) == collections.Counter((len(t) + 8, zlib.crc32(t.encode())) for _, t in rows)
        counts = collections.Counter(r["shard"] for r in got)
        assert max(counts.values()) - min(counts.values()) <= 1
        assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())


# 3


def test_token_counts_by_encoding_again(spark, tiny):
    docs = tiny.limit(60).select("doc_id", "text")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs).collect()}
    encode = tokens._encoder(tokens.VOCABULARY)
    rows = docs.collect()
    assert got == {r["doc_id"]: len(x) for r, x in zip(rows, encode([r["text"] for r in rows]))}


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(3)
    files = {"a.bin": rng.integers(0, 4, 500), "b.bin": np.array([7, 7, 7]), "c.bin": np.zeros(0, int), "d.bin": np.array([1, 2, 3]), "e.bin": np.array([1, 7, 2])}
    for n, ids in files.items():
        ids.astype("<u2").tofile(tmp_path / n)
    sep = 3
    got = sorted((r["file"], r["doc"], r["n_tokens"], r["finished"]) for r in tokens.scan(tokens.token_files(spark, f"file://{tmp_path}"), sep, 2, block).collect())
    want = []
    for n, ids in files.items():
        ends = np.flatnonzero(ids == sep)
        want += [(n, i, int(b - a - 1), True) for i, (a, b) in enumerate(zip([-1, *ends[:-1]], ends))]
        last = ends[-1] if len(ends) else -1
        if len(ids) > last + 1:
            want.append((n, len(ends), int(len(ids) - last - 1), False))
    assert got == sorted(want)


# 4


def test_surrogates(spark, docs_of):
    t1 = 'Write to Anna.Smith@mail.example.com or +1 (743) 555-3824, card 4111111111111111, host 10.1.2.3, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962".'
    t2 = "Again anna.smith@mail.example.com; call (743) 555-3824. Mr. John Miller met Mrs. Miller. SSN 123-45-6789. MR 4111 1111 1111 1111"
    t3 = "Nothing private: version 4.0, 12 items, 3.14, section 2.1.3 of 1999."
    got = {r["doc_id"]: r for r in pii.replace_private(docs_of([(1, t1), (2, t2), (3, t3), (4, None), (5, "")])).collect()}
    assert got[3]["text"] == t3 and got[3]["n_entities"] == 0 and got[4]["text"] is None and got[5]["text"] == ""
    for secret in ("Anna.Smith@", "555-3824", "4111111111111111", "10.1.2.3", "04dbebab", "John", "Miller", "123-45-6789", "4111 1111"):
        assert secret.lower() not in (got[1]["text"] + got[2]["text"]).lower()
    mail = [re.search(r"\S+@\S+\w", got[i]["text"])[0].lower() for i in (1, 2)]
    phone = [re.search(r"\(\d{3}\) \d{3}-\d{4}", got[i]["text"])[0] for i in (1, 2)]
    assert mail[0] == mail[1] and phone[0] == phone[1] and "+1 (" in got[1]["text"]
    card = re.search(r"card (\d{16})", got[1]["text"])[1]
    digits = [int(c) for c in reversed(card)]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert card == re.sub(" ", "", re.search(r"MR ((?:\d{4} ?){4})", got[2]["text"])[1])
    m = re.search(r"Mr\. (\w+) (\w+) met Mrs\. (\w+)\.", got[2]["text"])
    assert m[1] in pii.GIVEN["m", "latin"] and m[2] == m[3]


def test_hint_lets_shortest_entities_through(spark, docs_of):
    short = ["a@b.cc", "8.8.8.8", "DE12ABCDEFGH", "123-45-6789", "555 123 4567", "(12)345 678", "a1b2c3d4" * 4, "abcdefab" * 4, "4 1 1 1 1 1 1 1 1 1 1 1 1", "4-1-1-1-1-1-1-1-1-1-1-1-1", "Mr Li"]
    texts = [f"x {t} y" for t in short]
    got = {r["doc_id"]: r for r in pii.replace_private(docs_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(short):
        assert got[i]["n_entities"] == 1 and t not in got[i]["text"], t


def test_phones_of_all_first_groups_stay_phones(spark, docs_of):
    phones = ["0203 946 0958", "0203 946 0959", "20 7946 0958", "20 7946 0959", "5551 234 5678", "555 234 5678", "(02) 946 0958"]
    got = {r["doc_id"]: r for r in pii.replace_private(docs_of([(i, f"call {t} now") for i, t in enumerate(phones)])).collect()}
    new = [got[i]["text"].removeprefix("call ").removesuffix(" now") for i in range(len(phones))]
    assert len(set(new)) == len(phones) and not set(new) & set(phones)
    assert [re.sub(r"\d", "0", x) for x in new] == [re.sub(r"\d", "0", x) for x in phones]


@pytest.mark.parametrize("n", [300, 3000, 10_000])
def test_surrogates_stay_distinct(spark, n):
    """Also where all values of a shape are real entities: then they take one another's place."""
    parts = spark.createDataFrame([("ssn", f"{i:04d}") for i in range(n)] + [("iban", "de00aaaa")], ["kind", "canon"])
    new = {r["canon"]: r["new"] for r in pii.surrogates(parts, "k").collect()}
    assert len(new) == n + 1 == len(set(new.values())) and all(len(x) == len(k) and x != k for k, x in new.items())
    assert re.fullmatch("[a-z]{2}[0-9]{2}[a-z]{4}", new["de00aaaa"])
    if n == 300:
        assert not set(new) & set(new.values())
    assert new == {r["canon"]: r["new"] for r in pii.surrogates(parts, "k").collect()}


def test_shapes_are_permuted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "TOGETHER", 100)
    parts = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(1000)], ["kind", "canon"])
    new = {r["canon"]: r["new"] for r in pii.surrogates(parts, "k").collect()}
    assert set(new) == set(new.values()) and all(k != v for k, v in new.items())


def test_replacements_by_brute_force(tiny):
    """Entities found by another regular expression engine: gaps stay, mentions change alike, kinds and forms stay."""
    rx = importlib.import_module("regex")
    entity = rx.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()))
    got = {r["doc_id"]: r for r in pii.replace_private(tiny).collect()}
    became = collections.defaultdict(set)
    for r in tiny.collect():
        found = list(entity.finditer(r["text"]))
        assert got[r["doc_id"]]["n_entities"] == len(found)
        text, at, end = got[r["doc_id"]]["text"], 0, 0
        for i, m in enumerate(found):
            gap = r["text"][end : m.start()]
            assert text[at : at + len(gap)] == gap
            at += len(gap)
            end = m.end()
            after = r["text"][end : found[i + 1].start() if i + 1 < len(found) else None]
            stop = text.index(after, at) if after else len(text) if i + 1 == len(found) else at + len(m[0])
            new, old = text[at:stop], m[0]
            assert new != old
            if m.lastgroup in ("card", "ssn", "phone", "iban", "secret"):
                assert re.sub("[0-9A-Za-z]", "x", new) == re.sub("[0-9A-Za-z]", "x", old)
            became[m.lastgroup, re.sub("[^0-9a-z@.]", "", old.lower()) if m.lastgroup != "person" else old].add(new.lower())
            at = stop
        assert text[at:] == r["text"][end:]
    assert len(became) > 10
    for (kind, _), new in became.items():  # one entity, one replacement; spelling may differ
        assert len({re.sub("[^0-9a-z@.]", "", x) for x in new} if kind != "person" else new) == 1
    per = collections.Counter((k, re.sub("[^0-9a-z@.]", "", next(iter(v))) if k != "person" else next(iter(v))) for (k, _), v in became.items())
    assert all(n == 1 for (k, _), n in per.items() if k not in ("person", "phone"))


# 5


def brute_matches(docs, items):
    return {(i, k) for i, t in docs for k, x in items if x in t}


def test_decontamination_finds_all_passages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    want = brute_matches([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert want and got == want


def test_near_passages_and_edges(spark, docs_of):
    rng = random.Random(5)
    w = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    item, short, long = w(60), w(6), w(400)
    near = item.copy()
    near[30] = "changed"
    fill = w(50)
    far = item[:30] + w(30)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, ""), (5, " ".join(long))], "item_id long, text string")
    docs = docs_of([(1, " ".join(fill + near + fill)), (2, "! ".join(fill + short).upper()), (3, " ".join(fill + far)), (4, None), (5, ""), (6, " ".join(fill + long)), (7, " ".join(fill))])
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (6, 5)} and 0.8 <= got[1, 1] < 1 and got[2, 2] == 1
    assert {r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()} == {3, 4, 5, 7}


def brute_similarity(item, run, items):
    """Weighted Jaccard similarity of two lists of words as bags of five-word shingles, with the weights of ``items``."""
    bag = lambda x: collections.Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
    df = collections.Counter(g for x in items for g in bag(x))
    weight = lambda g: np.log(1 + len(items) / df.get(g, 1))
    p, q = bag(item), bag(run)
    both = sum(weight(g) * n for g, n in (p & q).items())
    return both / sum(weight(g) * n for g, n in (p | q).items()) if p or q else 0.0


def edits(x, w, rng):
    """Copies of x with words cut off, put in, left out and changed."""
    k, at = max(1, (len(x) - 4) // 9), len(x) // 2
    out = [x[k:], x[:-k], x[k // 2 : len(x) - k + k // 2], x[:at] + w(1) + x[at:], x[:at] + x[at + 1 :], x[:at] + w(1) + x[at + 1 :]]
    for n in range(1, 1 + len(x) // 40):  # several words in one place or in several
        out += [x[:at] + w(n) + x[at:], x[:at] + x[at + n :]]
        y = list(x)
        for _ in range(n):
            j = rng.randrange(len(y))
            y[j : j + 1] = rng.choice([[], w(2), w(1)])
        out.append(y)
    return out


def test_edited_copies_by_brute_force_over_all_runs():
    rng = random.Random(15)
    w = lambda n: [rng.getrandbits(64) for _ in range(n)]
    items = [w(n) for n in (5, 6, 9, 15, 20, 24, 31, 45, 45, 52)]
    items[4][:8] = items[3][:8]  # a passage that two items share
    index = decontaminate.Items(list(range(len(items))), [np.array(x, np.uint64) for x in items])
    docs, want = [], {}
    for x in items:
        for y in edits(x, w, rng):
            docs += [w(12) + y + w(12), y]
    for d, h in enumerate(docs):
        for i, x in enumerate(items):
            if len(set(x) & set(h)) < 5:
                continue
            runs = (h[a:b] for a in range(len(h)) for b in range(a + max(5, len(x) * 6 // 10), min(len(h), a + len(x) * 3 // 2 + 2) + 1))
            best = max((brute_similarity(x, r, items) for r in runs), default=0)
            if best >= decontaminate.SIMILAR - 1e-9:
                want[d, i] = best
    got = decontaminate._matches(np.concatenate([np.array(h, np.uint64) for h in docs]), np.cumsum([0, *map(len, docs)]), index)
    assert len(want) > 50 and {k: v[0] for k, v in got.items()} == pytest.approx(want)


@pytest.mark.parametrize("n", [8, 12, 20, 32, 45, 60, 90, 130, 190, 250])
def test_recall_of_edited_copies(n):
    """Of copies whose own run of words is similar enough, none is missed, whatever was edited."""
    rng = random.Random(n)
    w = lambda k: [rng.getrandbits(64) for _ in range(k)]
    items = [w(n) for _ in range(12)]
    index = decontaminate.Items(list(range(12)), [np.array(x, np.uint64) for x in items])
    docs, want = [], set()
    for i, x in enumerate(items):
        for y in edits(x, w, rng):
            if brute_similarity(x, y, items) >= decontaminate.SIMILAR:
                want.add((len(docs), i))
            docs.append(w(30) + y + w(30))
    got = decontaminate._matches(np.concatenate([np.array(h, np.uint64) for h in docs]), np.cumsum([0, *map(len, docs)]), index)
    assert want <= set(got) and all(i == j // (len(docs) // 12) for j, i in got)


def test_multi_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(6)
    hashes = [rng.integers(0, 1 << 64, 12, dtype=np.uint64) for _ in range(50)]
    items = decontaminate.Items(list(range(50)), hashes)
    own = items.index[12][0]
    prints = np.concatenate([rng.integers(0, 1 << 64, 500, dtype=np.uint64), own ^ np.uint64(0b1011 << 20) ^ np.uint64(0b111 << 50)])
    w, r, _ = items.within(12, prints)
    want = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(own) if int(p ^ q).bit_count() <= decontaminate.RADIUS}
    assert set(zip(w.tolist(), r.tolist())) == want and len(want) >= 50


# 6


def brute_components(rows, n=4, percent=85):
    sets = {}
    for i, t in rows:
        ws = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, n, base, edits):
    out = []
    for _ in range(n):
        x = base.copy()
        for _ in range(rng.randint(0, edits)):
            x[rng.randrange(len(x))] = "e" + str(rng.randrange(10**6))
        out.append(" ".join(x))
    return out


def test_jaccard_components(spark, docs_of, monkeypatch):
    rng = random.Random(8)
    w = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    passage = w(60)
    texts = family(rng, 150, w(80), 5) + family(rng, 30, w(40), 2) + [" ".join(passage + w(rng.randint(1, 12))) for _ in range(80)]
    texts += [" ".join(w(rng.randint(0, 9))) for _ in range(40)] + ["a b", "A  B", "a b", "", None, "same text here now", "SAME text here now"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    monkeypatch.setattr(jaccard, "HOT_PIECE", 2000)
    for hot in (jaccard.HOT, 3):
        monkeypatch.setattr(jaccard, "HOT", hot)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs_of(rows)).collect()}
        assert got == brute_components(rows)


def test_near_duplicate_stage_links_at_five_words_and_80(spark, docs_of):
    pipe = importlib.import_module("corpus_pipeline")
    rng = random.Random(13)
    w = lambda n: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    rows, want = [], set()
    for i in range(30):
        base = w(80)
        copy, far = base + w(18), base + w(30)  # 5-word Jaccard 76/94 and 76/106, 4-word 77/95
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(copy)), (3 * i + 2, " ".join(w(40) + far[40:]))]
        want |= {3 * i, 3 * i + 2}
    got = pipe.near_duplicates(spark, docs_of(rows), TINY).collect()
    assert {r["doc_id"] for r in got} == want
    assert jaccard.one_of_each(docs_of(rows)).count() == len(rows)


def test_jaccard_components_at_other_words_and_percent(spark, docs_of):
    rng = random.Random(14)
    w = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    rows = list(enumerate(family(rng, 80, w(80), 4) + family(rng, 30, w(45), 2) + [" ".join(w(rng.randint(0, 9))) for _ in range(20)]))
    sets = {i: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} if len(x) >= 5 else ({tuple(x)} if x else set()) for i, t in rows for x in [t.split()]}
    root = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs_of(rows), 5, 80).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_rows_without_id_are_decided_each_for_itself(spark, docs_of):
    rng = random.Random(16)
    w = lambda n: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    x, y, item = w(60), w(60), w(40)
    near = lambda t: " ".join([*t[:-1], "changed"])
    alone = " ".join(w(30))
    docs = docs_of([(1, " ".join(x)), (None, near(x)), (None, " ".join(y)), (None, near(y)), (None, alone), (2, " ".join(w(60))), (2, near(x))])
    for n in ((), (5, 80)):
        got = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs, *n).collect()]
        assert collections.Counter(i for i, _ in got) == {1: 1, 2: 1, None: 2}
        assert {t for i, t in got if i is None} & {" ".join(y), near(y)} and (None, alone) in got and (2, near(x)) not in got
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = docs_of([(None, " ".join(w(20) + item)), (None, alone), (3, " ".join(item)), (3, alone)])
    got = [(r["doc_id"], r["text"]) for r in decontaminate.clean_documents(docs, bench).collect()]
    assert sorted(got, key=str) == [(3, alone), (None, alone)]


@pytest.mark.parametrize("heaped", [0, 40, 10_000])
def test_divide_skip_by_brute_force(heaped, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAPED", heaped)
    rng = np.random.default_rng(9)
    for _ in range(60):
        query = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(12)]
        least = int(rng.integers(1, 30))
        want = {(i, len(np.intersect1d(query, s))) for i, s in enumerate(sets) if len(np.intersect1d(query, s)) >= least}
        assert set(zip(*map(np.ndarray.tolist, jaccard.divide_skip(jaccard.Lists(sets), query, least)))) == want


def test_heads_of_linked_sets_share_what_they_must():
    rng = np.random.default_rng(11)
    for percent in (80, 85):
        for _ in range(3000):
            n = int(rng.integers(1, 120))
            a = rng.permutation(400)[:n]
            keep = int(rng.integers(n * 7 // 10, n + 1))
            b = np.concatenate([a[:keep], 400 + np.arange(int(rng.integers(0, 1 + n // 4)))])
            if not len(b) or 100 * keep < percent * (len(a) + len(b) - keep):
                continue
            order = rng.permutation(1000)  # any order of all shingles
            heads = [set(sorted(x.tolist(), key=lambda t: order[t])[: int(jaccard.lengths(len(x), percent)[1])]) for x in (a, b)]
            assert len(heads[0] & heads[1]) >= jaccard.shared_heads(len(a), len(b), percent)
            lists = [set(sorted(x.tolist(), key=lambda t: order[t])[: int(jaccard.lengths(len(x), percent)[0])]) for x in (a, b)]
            assert len(lists[0] & lists[1]) >= jaccard.shared_heads(len(a), len(b), percent, 0)
            low, high, least = jaccard._partners(len(a), percent)
            assert low <= len(b) <= high and 1 <= least <= jaccard.shared_heads(len(a), len(b), percent)


def test_templated_documents_make_no_pairs(docs_of, monkeypatch):
    """Documents of 40 slots with three variants each: every list is long, no two documents are similar."""
    kept = []
    monkeypatch.setattr(jaccard, "materialize", lambda df, tag, keep=False: kept.append((tag, out := common.materialize(df, tag, keep))) or out)
    monkeypatch.setattr(common, "delete", lambda *a: None)
    for n in (150, 300):
        rng = random.Random(3)
        kept.clear()
        rows = [(i, " ".join(f"slot{j} variant{rng.randrange(3)} of{j} the{j} form{j}" for j in range(40))) for i in range(n)]
        got = jaccard.join_components(docs_of(rows)).collect()
        assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == n
        assert sum(df.count() for tag, df in kept if tag in ("trials", "candidates")) < n


@pytest.mark.parametrize("best", [1, 2])
def test_visits_with_more_candidates_are_made_again(docs_of, monkeypatch, best):
    monkeypatch.setattr(jaccard, "BEST", best)
    monkeypatch.setattr(jaccard, "VISITS", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(60):  # a star: copies of one text, most too far from one another
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"x{i}_{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs_of(rows)).collect()}
    assert got == brute_components(rows)


def test_components(spark):
    rng = random.Random(10)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(7, 7)]
    root = {}
    for a, b in links:
        for x in (a, b):
            root.setdefault(x, x)
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: root[i] for i in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_language_mixtures(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs, F.lit(True))
    pure = {k: docs.where(F.col("lang") == k).orderBy(F.desc("n_chars")).first()["text"][:3000] for k in ("en", "de")}
    rows = docs_of([(1, pure["en"]), (2, pure["en"][:2000] + " " + pure["de"][:1000]), (3, None), (4, "123 $$ 4"), (5, ""), (6, "é")])
    got = {r["doc_id"]: r for r in language.identify(rows, model).collect()}
    assert got[1]["lang_pred"] == "en" and got[1]["languages"] == ["en"]
    assert got[2]["lang_pred"] == "en" and got[2]["languages"] == ["de", "en"] and 0.5 < got[2]["score"] < 0.8
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and got[6]["lang_pred"] != "und"


def brute_languages(slots, like):
    """(best, score, set) of one text in plain Python: EM and BIC, one language after the other."""
    n, k = len(slots), len(like)
    p = [[math.exp(like[j][s] - max(like[q][s] for q in range(k))) for j in range(k)] for s in slots]
    top = sum(max(like[q][s] for q in range(k)) for s in slots)

    def em(chosen):
        share = [1 / len(chosen)] * len(chosen)
        for _ in range(language.STEPS):
            new = [0.0] * len(chosen)
            for row in p:
                mass = [share[x] * row[j] for x, j in enumerate(chosen)]
                for x, m in enumerate(mass):
                    new[x] += m / sum(mass) / n
            done = max(abs(a - b) for a, b in zip(new, share)) < 1e-3
            share = new
            if done:
                break
        return share, top + sum(math.log(sum(share[x] * row[j] for x, j in enumerate(chosen))) for row in p)

    single = [sum(like[j][s] for s in slots) for j in range(k)]
    chosen, share, value = [max(range(k), key=lambda j: (single[j], -j))], [1.0], max(single)
    while True:
        base = [math.log(sum(share[x] * row[j] for x, j in enumerate(chosen))) for row in p]
        gain = {j: sum(math.log(0.9 * math.exp(b) + 0.1 * row[j]) - b for b, row in zip(base, p)) for j in range(k) if j not in chosen}
        if not gain or max(gain.values()) <= 0.5 * math.log(n):
            break
        more = [*chosen, max(gain, key=lambda j: (gain[j], -j))]
        got, ll = em(more)
        if ll - 0.5 * math.log(n) <= value or min(got) < language.MIN_SHARE:
            break
        chosen, share, value = more, got, ll
    if len(chosen) == 1:
        return chosen[0], 1 / sum(math.exp(max(-700, x - max(single))) for x in single), chosen
    best = max(range(len(chosen)), key=lambda x: (share[x], -chosen[x]))
    return chosen[best], share[best], sorted(chosen)


def test_mixtures_by_brute_force(tiny):
    model = language.train(tiny.select("doc_id", "text", "lang"), F.lit(True))
    like = model[1].astype(np.float32)
    texts = collections.defaultdict(str)
    for r in tiny.orderBy("doc_id").collect():
        texts[r["lang"]] += " " + (r["text"] or "")
    names = sorted(k for k in texts if k)
    rng = random.Random(3)
    docs = [texts[k][:300] for k in names] + ["a", "zzz qqq", ""]
    for _ in range(12):
        docs.append(" ".join(texts[k][a : a + rng.randint(60, 500)] for k in rng.sample(names, rng.randint(1, 3)) for a in [rng.randrange(1000)]))
    slot, at = language.trigrams(pa.array(docs))
    best, score, sets = language.infer(slot, at, like)
    many = 0
    for i in range(len(docs)):
        own = slot[at[i] : at[i + 1]].tolist()
        if not own:
            assert best[i] == -1
            continue
        want = brute_languages(own, like.astype(float).tolist())
        assert (best[i], sets[i]) == (want[0], want[2]) and score[i] == pytest.approx(want[1], abs=1e-4)
        many += len(want[2]) > 1
    assert many >= 4


# 8


def test_mix(tiny):
    rows = mixing.mix(tiny).collect()
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in tiny.collect()}
    by, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    total, full, w = sum(by.values()), set(), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by))}
    while True:
        level = (total - sum(3 * by[s] for s in full)) / sum(w[s] for s in by if s not in full)
        more = {s for s in by if s not in full and level * w[s] > 3 * by[s]}
        if not more:
            break
        full |= more
    most = {s: max(r["size"] for r in rows if r["source"] == s) for s in by}
    for s in by:
        assert target[s] == pytest.approx(3 * by[s] if s in full else level * w[s])
    # fair queueing: up to the cut's virtual time, each source is served to within its next document
    cut = max(taken[s] / target[s] for s in by)
    assert all(taken[s] + most[s] >= cut * target[s] - 1e-6 for s in by) and cut < 1 + sum(most.values()) / total
    assert sum(taken.values()) <= total
    copies = collections.Counter(r["doc_id"] for r in mixing.mix_documents(tiny).collect())
    assert copies == collections.Counter({r["doc_id"]: r["taken"] // r["size"] for r in rows if r["taken"]})


def brute_mix(rows):
    """Copies of each (id, text, source): all passes over all rows in one list, sorted and cut; equal rows are one entry."""
    size = collections.Counter(rows)
    words_of = lambda t: len(WORD.findall(t or ""))
    by = collections.Counter()
    for (_, t, s), n in size.items():
        by[s] += n * words_of(t)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    w, total, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(by.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        level = (total - sum(3 * by[s] for s in full)) / sum(w[s] for s in open_) if open_ else 0
        if not (more := {s for s in open_ if level * w[s] > 3 * by[s]}):
            break
        full |= more
    target = {s: 3 * by[s] if s in full else level * w[s] for s in names}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    place = lambda i, t: (int(md5("8|" + (str(i) if i is not None else md5(t or "")))[:15], 16), "" if i is None else str(i), words_of(t), zlib.crc32((t or "").encode()))
    line = []
    for s in names:
        run = 0
        for i, t, _ in sorted((k for k in size if k[2] == s), key=lambda k: place(k[0], k[1])):
            run += size[i, t, s] * words_of(t)
            if words_of(t):
                line += [(((e * by[s] + run) / target[s]), "1" if s is None else "0" + s, *place(i, t)[:2], (i, t, s)) for e in range(3)]
    left, out = total, collections.Counter()
    for *_, k in sorted(line, key=lambda x: x[:4]):
        n = min(size[k], left // words_of(k[1]))
        out[k] += n
        left -= size[k] * words_of(k[1])
        if left <= 0:
            break
    return +out


def test_mix_of_hot_keys(docs_of):
    rng = random.Random(21)
    rows = [(None, "the same words in many rows", "a")] * 400 + [(3, "one id and one text", "b")] * 200 + [(None, f"text {i} " * rng.randint(0, 9), None) for i in range(150)]
    rows += [(i, "word " * rng.randint(0, 40), rng.choice("abc")) for i in range(10, 400)] + [(9, None, "c"), (9, "", "c")]
    want = brute_mix(rows)
    docs = docs_of([(i, t, "en", s) for i, t, s in rows])
    key = lambda r: (r["doc_id"], r["text"], r["source"])
    assert collections.Counter(map(key, mixing.mix_documents(docs).collect())) == want
    plan = collections.Counter()
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"], r["source"]] += r["taken"]
    words = collections.Counter()
    for (i, t, s), n in want.items():
        words[i, s] += n * len(WORD.findall(t or ""))
    assert +plan == +words
    line = [key(r) for r in mixing.ordered_mix(docs).collect()]
    assert collections.Counter(line) == want
    half = collections.Counter(s for _, t, s in line[: len(line) // 2] for _ in range(len(t.split())))
    assert half["a"] > half["b"] > half["c"]  # weights 5, 2, 1, at any point of the mix


def test_cut_narrows(tiny, monkeypatch):
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(tiny).collect()}
    monkeypatch.setattr(mixing, "BINS", 8)
    monkeypatch.setattr(mixing, "SORTED", 3)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(tiny).collect()} == want


# 9


def test_chat_round_trip(spark):
    hard = "\\### Assistant: </turn> ok \\b \\h \\l \\\\ # < \n### x\n"
    rng = random.Random(11)
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 30)):
            rows.append((c, t, "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2], rng.choice([hard, "", None, "word " * rng.randint(1, 400)])))
    rows += [(None, 0, "user", "a"), (99, None, None, "b"), (98, 0, "odd\nrole: #", hard), (98, 0, "odd\nrole: #", hard)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(clashing(df), 300, 80)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, v in by.items():
        v.sort()
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in v)
        loss = "".join(x for *_, r, x in v if r == "assistant")
        assert got[c]["n_turns"] == len(v) and got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    w = made.collect()
    later = [r for r in w if r["window"] > 1 and r["conv_id"] is not None and r["conv_id"] < 12 and r["conv_id"] % 3 == 0]
    assert later and all(r["formatted"].startswith("### system\n") for r in later)
    assert any(r["n_context"] > 1 for r in w)


def unescaped(x):
    return x.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\")


@pytest.mark.parametrize("counted", [False, True])
def test_chat_windows_hold_the_budget(spark, counted, monkeypatch):
    budget, history = 120, 40
    monkeypatch.setattr(chat, "BLOCK_TOKENS", 1000)
    monkeypatch.setattr(chat, "BLOCK", 8)
    rng = random.Random(31)
    rows, tokens = [], {}
    for c in range(25):
        for t in range(rng.randint(1, 60)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            text = f"{c}_{t} " + "x" * rng.choice([0, 5, 30, 60, 100, 700 if c % 5 == 0 else 200])
            tokens[text] = rng.randint(0, 70) if counted else -(-len(text) // 4) + 4
            rows.append((c, t, role, text, tokens[text]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost long")
    made = chat.windows(df, budget, history, "cost" if counted else None).collect()
    by = collections.defaultdict(list)
    for r in sorted(made, key=lambda r: r["window"]):
        turns = [unescaped(x.split("\n", 1)[1]) for x in r["formatted"].split("</turn>\n")[:-1]]
        own = turns[r["n_context"] :]
        system = [x for i, x in enumerate(turns[: r["n_context"]]) if i == 0 and r["formatted"].startswith("### system\n")]
        past = turns[len(system) : r["n_context"]]
        cost = sum(tokens[x] for x in turns)
        lead = tokens[turns[0]] if r["formatted"].startswith("### system\n") else 0
        fresh = [x for x in own if not (r["window"] == 1 and x == own[0] and lead)]
        assert cost <= budget or len(fresh) == 1 and not past and lead + tokens[fresh[0]] > budget - history
        assert sum(tokens[x] for x in past) <= history
        seen = by[r["conv_id"]]
        assert past == seen[len(seen) - len(past) :]  # whole turns right before the span
        left = min(history, budget - cost + sum(tokens[x] for x in past))
        if len(seen) > len(past) + (1 if r["conv_id"] % 2 else 0):  # as many as fit
            assert sum(tokens[x] for x in past) + tokens[seen[len(seen) - len(past) - 1]] > left or tokens[seen[len(seen) - len(past) - 1]] == 0
        seen += own
        targets = [x for x in own if int(x.split("_")[1].split(" ")[0]) % 2 == 1]
        assert [unescaped(r["formatted"][a : a + n]) for a, n in r["loss"]] == targets
    assert {c: v for c, v in by.items()} == {c: [r[3] for r in rows if r[0] == c] for c in by} and len(by) == 25
    # no span could have taken the next one's first turn, but where a block of turns ended
    assert len(made) < 0.75 * len(rows)


# 10


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = [r for r in toxicity.toxicity(docs, labels).join(labels, "doc_id").collect() if r["held_out"]]
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / sum(r["predicted"] for r in rows) > 0.9 and hit / sum(r["toxic"] for r in rows) > 0.7


def test_toxicity_scores_by_brute_force(tiny):
    rng = np.random.default_rng(12)
    texts = [r["text"] for r in tiny.limit(30).collect()]
    feats = []
    for t in texts:
        h, _, heads = words.word_hashes(pa.array([t]), words.ALPHA, toxicity.HEADS)
        feats.append(toxicity.features(h, heads))
    slots = np.unique(rng.choice(np.concatenate(feats), 500))
    weights = rng.normal(size=len(slots))
    dense = np.zeros(toxicity.SLOTS)
    dense[slots] = weights
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(tiny, (slots, weights, 0.3)).collect()}
    for r, f in zip(tiny.limit(30).collect(), feats):
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(0.3 + dense[f].sum()))))


def test_ftrl_by_dictionaries():
    rng = random.Random(5)
    rows = [(np.array(sorted(rng.sample(range(40), rng.randint(1, 12))), np.int32), rng.randint(0, 1)) for _ in range(300)]
    rows = [(x, int(3 in x or y and 5 in x)) for x, y in rows]
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "bias" else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA_RATE + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for x, y in rows:
            at = [*x.tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA_RATE * w[i]
                n[i] += g * g
    slots, weights, bias = toxicity.ftrl(rows)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert 0 < len(want) < 40 and dict(zip(slots.tolist(), weights.tolist())) == pytest.approx(want) and bias == pytest.approx(weight("bias"))


def test_one_class_of_labels(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    for y, want in ((1, 1.0), (0, 0.0)):
        labels = spark.createDataFrame([(1, y)], "doc_id long, toxic int")
        assert [r["score"] for r in toxicity.scores(docs, toxicity.train(docs, labels)).collect()] == [want] * 2


# all


BENCH = [(1, "one of the items that must not be found here at all today")]
RUNS = {
    "quality": lambda s, d: quality.quality_filter(d),
    "sharding": lambda s, d: sharding.shard_documents(d),
    "tokens": lambda s, d: tokens.count_tokens(d),
    "pii": lambda s, d: pii.replace_private(d),
    "decontaminate": lambda s, d: decontaminate.clean_documents(d, s.createDataFrame(BENCH, "item_id long, text string")),
    "jaccard": lambda s, d: jaccard.one_of_each(d),
    "jaccard join": lambda s, d: jaccard.join_components(d),
    "language": lambda s, d: language.language(d),
    "mixing": lambda s, d: mixing.mix_documents(d),
    "mixing plan": lambda s, d: mixing.mix(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, s.createDataFrame([(6, 1), (3, 0), (None, 1)], "doc_id long, toxic int")),
}
WHOLE = {"sharding", "tokens", "pii", "language", "toxicity", "jaccard join", "mixing plan", "decontaminate"}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, odd, name):
    rows = RUNS[name](spark, clashing(odd)).collect()
    if name in WHOLE:
        assert len(rows) == odd.count()
    if name == "jaccard":
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted([1, 2, 3, 4, 5, 6, 7, 8, None], key=str)


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(spark, odd, name):
    assert RUNS[name](spark, odd.where("doc_id < 0")).count() == 0


def test_empty_side_tables(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean_documents(odd, none).count() == odd.count()
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(odd, labels).collect()} == {0.0}
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(conv)).count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_each_operator_has_a_query(n):
    assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1


@pytest.mark.skipif(not os.path.exists("corpus_pipeline.py"), reason="no pipeline here")
def test_pipeline_by_stages(spark):
    pipe = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = pipe.run(spark, TINY).collect()
    kept = {r["doc_id"] for r in quality.quality(docs).collect() if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    comp = brute_components([(i, texts[i]) for i in kept], 5, 80)
    one = {c for _, c in comp.values()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    clean = one - {i for i, _ in brute_matches([(i, texts[i]) for i in one], bench)}
    mixed = mixing.mix(docs.where(F.col("doc_id").isin(list(clean)))).collect()
    want = collections.Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixed if r["taken"]})
    assert collections.Counter(r["doc_id"] for r in rows) == want
    assert all(r["text"] == texts[r["doc_id"]] for r in rows)
    counts = collections.Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1


@pytest.mark.skipif(not os.path.exists("corpus_pipeline.py"), reason="no pipeline here")
def test_pipeline_leaves_only_its_result(spark, tmp_path, odd):
    """Odd rows, clashing columns and empty tables go through all stages; tables in between are deleted."""
    pipe = importlib.import_module("corpus_pipeline")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = [(i, " ".join(f"w{i}_{k}" for k in range(80)), "en", "s") for i in range(20, 60)]
    docs = odd.union(spark.createDataFrame([(*r, 0) for r in long], odd.schema))
    held = common.shared_dir(spark).removeprefix("file:")
    for df, want in ((docs, {r[0] for r in long}), (docs.where("doc_id < 0"), set())):
        path = f"{tmp_path}/{len(want)}"
        os.makedirs(path)
        os.symlink(f"{tmp_path}/benchmark.parquet", f"{path}/benchmark.parquet")
        clashing(df).write.parquet(f"{path}/documents.parquet")
        before = set(os.listdir(held)) if os.path.isdir(held) else set()
        out = pipe.run(spark, path)
        assert len(set(os.listdir(held)) - before) == 1
        assert {r["doc_id"] for r in out.collect()} == want
        assert set(CLASH) - {"shard", "slot", "size"} <= set(out.columns)
