"""Readers, writers and streams on files made here."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import plugins
from strandlake.sources import config, files, sinks
from strandlake.streaming import events as ev


def test_fasta_and_csv(spark, tmp_path):
    (tmp_path / "a.fa").write_text("acgt\n>one\nAC\nGT\n>empty\n>two\r\nNN>A\n")
    got = [r["raw"] for r in files.fasta(spark, str(tmp_path / "a.fa")).orderBy("row_seq").collect()]
    assert got == ["acgt", "ACGT", "NN>A"]
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(">x\nacgtn\n")
    assert [r["seq"] for r in files.load(spark, str(tmp_path / "b.fasta.gz")).collect()] == ["ACGTN"]
    (tmp_path / "c.csv").write_text("id,Sequence\n1,ac gt\n2,\n")
    assert [r["seq"] for r in files.load(spark, str(tmp_path / "c.csv")).collect()] == ["ACGT"]
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.csv(spark, str(tmp_path / "d.csv"))
    (tmp_path / "a.fa.aria2").write_text("")
    names = {r["name"] for r in files.fasta_directory(spark, str(tmp_path)).collect()}
    assert names == {"b.fasta.gz:1"}


@pytest.fixture
def many_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "2000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(name, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("lead,end", [("", "\n"), ("ACGT\nAC\n", "\n"), ("", "\r\n")])
def test_fasta_in_many_splits(spark, tmp_path, many_splits, lead, end):
    rng = random.Random(1)
    want, text = [], lead
    for i in range(300):
        seq = "".join(rng.choices("ACGT", k=rng.choice([0, 1, 30, 400])))
        want += [(i + 1, seq)] if seq else []
        text += f">r{i} > not a record\n" + "".join(seq[k : k + 60] + "\n" for k in range(0, len(seq), 60))
    (tmp_path / "big.fa").write_bytes(text.replace("\n", end).encode())
    found = files.fasta(spark, str(tmp_path / "big.fa"))
    assert spark.read.text(str(tmp_path / "big.fa"), lineSep="\n>").rdd.getNumPartitions() > 4
    assert sorted((r["row_seq"], r["raw"]) for r in found.collect()) == ([(0, "ACGTAC")] if lead else []) + want


def test_row_numbers_in_many_splits(spark, tmp_path, many_splits):
    rows = [f"{'' if i % 2 else f'id{i}'},chr1,{i},{i + 9},{'ACGTACGT' * 3}" for i in range(400)]
    (tmp_path / "h.csv").write_text("id,chrom,start,end,seq\n" + "\n".join(rows) + "\n")
    got = {r["source"]: r["name"] for r in files.genome_csv(spark, str(tmp_path / "h.csv")).collect()}
    assert got == {f"chr1:{i}-{i + 9}": f"hg38_{i}" if i % 2 else f"id{i}" for i in range(400)}
    (tmp_path / "t.tsv").write_text("index\tname\n" + "".join(f"{i}\tAC{i:05d}\n" for i in range(900)))
    assert files.track_index(spark, str(tmp_path / "t.tsv"), "AC00777") == 777


def test_broken_archives(spark, tmp_path):
    line = json.dumps({"record": "r", "text": "ACGT" * 50}) + "\n"
    whole = gzip.compress((line * 300).encode())
    for name, data in (("a_train.jsonl.gz", whole), ("b.jsonl.gz", whole + whole), ("c.jsonl.gz", whole[:-9]), ("d.jsonl.gz", whole[:40] + b"xx" + whole[42:]), ("e.jsonl.gz", b"")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "f.jsonl.gz").write_bytes(whole)
    (tmp_path / "f.jsonl.gz.aria2").write_text("")
    got = {r["path"].rsplit("/", 1)[1][0]: r for r in files.inventory(spark, str(tmp_path)).collect()}
    assert {k: r["intact"] for k, r in got.items() if k != "e"} == {"a": True, "b": True, "c": False, "d": False, "f": False}
    assert [k for k, r in got.items() if r["train"]] == ["a"] and not (got["e"]["intact"] if "e" in got else False)
    large = {r["path"].rsplit("/", 1)[1][0]: r["intact"] for r in files.inventory(spark, str(tmp_path), limit=5).collect()}  # read to their end instead
    assert {k: v for k, v in large.items() if k != "e"} == {"a": True, "b": True, "c": False, "d": False, "f": False}
    with pytest.raises(ValueError, match="c.jsonl.gz"):
        files.genome_lines(spark, str(tmp_path), finished=True)
    with pytest.raises(Exception):
        files.genome_lines(spark, str(tmp_path / "c.jsonl.gz")).collect()
    assert files.genome_lines(spark, str(tmp_path / "b.jsonl.gz")).count() == 600
    kept = files.select_chunks(files.inventory(spark, str(tmp_path)), ["b.jsonl.gz", "c.jsonl.gz"])
    assert sorted(r["file"] for r in kept.collect()) == ["b.jsonl.gz", "c.jsonl.gz"]
    with pytest.raises(ValueError, match="zz"):
        files.select_chunks(files.inventory(spark, str(tmp_path)), ["zz"])


def test_trajectory_takes_each_record_once(spark, tmp_path):
    root, schema = str(tmp_path / "log"), "round int, loss double"
    rows = lambda n: spark.createDataFrame([(n, i / 4) for i in range(3)], schema)
    rows(0).write.mode("append").json(f"{root}/rounds")
    assert sinks.trajectory(spark, f"{root}/rounds", root, schema).count() == 3
    rows(1).write.mode("append").json(f"{root}/rounds")
    rows(2).write.mode("append").json(f"{root}/rounds")
    assert sorted(r["round"] for r in sinks.trajectory(spark, f"{root}/rounds", root, schema).collect()) == [0] * 3 + [1] * 3 + [2] * 3
    rows(9).write.mode("append").json(f"{root}/records")  # what a lost writer left beside the sink's log is not read
    assert sinks.trajectory(spark, f"{root}/rounds", root, schema).count() == 9


def test_shards_wait_in_state_and_leave_when_idle(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 5, 1)
    rows = [(k, start + dt.timedelta(minutes=i), i, 0) for k, n in ((1, 5), (2, 3)) for i in range(n)]
    rows += [(1, start + dt.timedelta(minutes=10), 10, 1), (3, start + dt.timedelta(days=1), 11, 1), (3, start + dt.timedelta(days=2), 12, 2)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, arrival int")
    with ev.streaming_state(spark, 2):
        got = ev.replay(df, "arrival", 3, lambda s: ev.stateful_shards(s, "user_id", "ts", "event_id", 3, 3_600_000), str(tmp_path / "s")).collect()
    got = sorted(tuple(r) for r in got if r["user_id"] < 3)
    # full ones at once; the rest of user 1 an hour after its last event, with the watermark of the third batch
    assert got == [(1, 0, 3, 0, 2), (1, 1, 3, 3, 10), (2, 0, 3, 0, 2)]


def test_sidecar_needs_no_order(spark):
    rows = [("a", 3, "xyz"), ("a", 2, "ab"), ("b", 1, "q")]
    one, two = (sorted(tuple(r) for r in sinks.sidecar(spark.createDataFrame(x, "k string, n int, p string"), ["k"], "n", "p").collect()) for x in (rows, rows[::-1]))
    assert one == two and one[0][:2] == ("a", 5) and len(one[0][2]) == 8 and one[0][2] != one[1][2]


def test_window_sampler_is_injected(spark):
    df = spark.createDataFrame([("a", "ACGTACGTAC" * 5), ("b", "ACG"), ("c", None), ("d", "T" * 12)], "name string, seq string")
    got = plugins.sample_windows(df, "name", "seq", 12, 4, 3)
    rows = got.collect()
    assert {r["name"] for r in rows} == {"a", "d"} and len(rows) == 8
    text = {"a": "ACGTACGTAC" * 5, "d": "T" * 12}
    assert all(r["text"] == text[r["name"]][r["start"] : r["start"] + 12] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, plugins.sample_windows(df.repartition(3), "name", "seq", 12, 4, 3).collect()))
    ends = plugins.sample_windows(df, "name", "seq", 12, 1, 3, lambda rng, length, window, n: np.array([length - window])).collect()
    assert {r["name"]: r["start"] for r in ends} == {"a": 38, "d": 0}
    with pytest.raises(Exception, match="outside"):
        plugins.sample_windows(df, "name", "seq", 12, 1, 3, lambda rng, length, window, n: np.array([length])).collect()


def test_scorer_is_set_up_once_a_task(spark, tmp_path):
    log = str(tmp_path / "log")

    def build():
        class Gc:
            def __call__(self, seqs):
                assert len(seqs) <= 2
                return [sum(c in "GC" for c in s) / len(s) for s in seqs]

            def close(self):
                with open(log, "a") as f:
                    f.write("closed\n")

        return Gc()

    df = spark.createDataFrame([(i, s) for i, s in enumerate(["GC", "AT", None, "GA", "C"])], "id int, seq string").coalesce(1)
    assert {r["id"]: r["score"] for r in plugins.scored(df, "seq", build, 2).collect()} == {0: 1.0, 1: 0.0, 2: None, 3: 0.5, 4: 1.0}
    with open(log) as f:
        assert f.read() == "closed\n"
    with pytest.raises(Exception, match="1 scores for 2"):
        plugins.scored(df, "seq", lambda: lambda seqs: [0.0], 2).collect()


def test_fetching_again_and_without_version(spark, tmp_path):
    def get(name):
        mark = tmp_path / name
        tried = int(mark.read_text()) if mark.exists() else 0
        mark.write_text(str(tried + 1))
        if name == "A.1" or name == "C" and tried >= 2:
            return gzip.compress(b">A\nACGT\n") if name == "A.1" else b"late"
        if name == "B":
            return b"plain"
        if name in ("C", "D"):
            raise OSError("busy")
        raise LookupError(name)

    ids = spark.createDataFrame([("A.1",), ("B.2",), ("C",), ("D",), ("E.1",), (None,)], "acc string").coalesce(1)
    got = {r["acc"]: r for r in plugins.fetched(ids, "acc", get, tries=3, wait=0.0).collect()}
    assert got["A.1"]["text"] == ">A\nACGT\n" and (got["B.2"]["asked"], got["B.2"]["text"]) == ("B", "plain") and got["C"]["text"] == "late"
    assert got["D"]["text"] is None and "busy" in got["D"]["problem"] and got["E.1"]["problem"] == "not found" and len(got) == 5


def test_configuration(tmp_path):
    (tmp_path / "m.json").write_text('{"a": 1, "b": 3}')
    assert config.mixture(f"@{tmp_path}/m.json", ["a", "b"]) == {"a": 0.25, "b": 0.75}
    for bad in ('{"c": 1}', '{"a": -1}', '{"a": 0}', "[1]"):
        with pytest.raises(ValueError):
            config.mixture(bad, ["a", "b"])
    assert config.pool_pin('{"chunks": {"s": ["x"]}}') == {"s": ["x"]} and config.held_out_pin("GCA001, GCA002,") == ["GCA001", "GCA002"]
    for f, bad in ((config.pool_pin, "{}"), (config.held_out_pin, "short")):
        with pytest.raises(ValueError):
            f(bad)
    assert config.batches(10, 4) == [(0, 4), (4, 4), (8, 2)]
    assert config.known_sources(["b", "a"], "ab") == ["b", "a"]
    for bad in ([], ["c"], ["a", "a"]):
        with pytest.raises(ValueError):
            config.known_sources(bad, "ab")
    plan = config.dump_plan(10_000, 64, 12, 32, 0.1, {"a": 1, "b": 2}, "ab")
    assert plan == {"a": 52, "b": 104} and sum(plan.values()) == 10_000 // 64
    for change in ({"budget": 0}, {"held": 1.5}, {"context": 60}, {"budget": 10}, {"gamma": float("nan")}, {"weights": {"c": 1}}):
        with pytest.raises(ValueError):
            config.dump_plan(**{"budget": 10_000, "window": 64, "gamma": 12, "context": 32, "held": 0.1, "weights": {"a": 1}, "known": "ab"} | change)


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"a": {"seq": "acg", "source": "x"}, "b": "TT", "c": ""}))
    assert sorted(tuple(r) for r in files.samples(spark, str(tmp_path / "s.json")).collect()) == [("a", "ACG", "x"), ("b", "TT", "")]
    (tmp_path / "g.jsonl").write_text('{"record": "r1", "text": "ACG"}\n{"text": "TT"}\n{"text": ""}\nbroken\n\n')
    assert sorted((r["record"], r["text"]) for r in files.genome_lines(spark, str(tmp_path / "g.jsonl")).collect()) == [("", "TT"), ("r1", "ACG")]
    (tmp_path / "p.json").write_text(json.dumps({"meta": {}, "prompts": [{"name": n, "region": "r", "source": "s", "orig_len": 4, "seq": "ACGT"} for n in "xyz"]}))
    p = str(tmp_path / "p.json")
    assert [r["name"] for r in files.prompt_pack(spark, p, ["z", "x"], 3).orderBy("pos").collect()] == ["x", "z"]
    with pytest.raises(ValueError):
        files.prompt_pack(spark, p, ["q"])
    with pytest.raises(Exception, match="too short"):
        files.prompt_pack(spark, p, ctx=9).collect()


def test_track_and_hg38(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("index\tname\n5\tA1\n7\tB2\n")
    assert files.track_index(spark, str(tmp_path / "t.tsv"), "B2") == 1
    with pytest.raises(ValueError):
        files.track_index(spark, str(tmp_path / "t.tsv"), "C3")
    (tmp_path / "h.csv").write_text("id,chrom,start,end,seq\n,chr1,5,9,acgt\n")
    assert tuple(files.genome_csv(spark, str(tmp_path / "h.csv")).first()) == ("hg38_0", "ACGT", "chr1:5-9")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", "A" * 100)], ["name", "seq"])
    sinks.fasta(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert text == ">x\n" + "A" * 80 + "\n" + "A" * 20 + "\n"
    sums = files.checksums(spark, str(tmp_path / "out" / "part*"))
    want = sums.select("path", F.lit("0").alias("sha256"))
    assert files.intact(want, sums).first()["problem"] == "changed"


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    e.orderBy("ts").coalesce(1).write.parquet(src)
    stream = ev.read_stream(spark, src, e.schema)
    q = ev.windowed(stream, [], "1 hour").writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(n) from w").first()[0]
    assert 0 < got <= e.count()
    with ev.streaming_state(spark, 2):
        q = ev.stateful_shards(stream, "user_id", "ts", "event_id", 8).writeStream.outputMode("append").format("memory").queryName("s").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    want = e.groupBy("user_id").count().select(F.sum(F.floor(F.col("count") / 8))).first()[0]
    assert spark.sql("select count(*) from s").first()[0] == want
    d = ev.deduplicated(stream.select("user_id", "ts"), ["user_id"])
    q = d.writeStream.outputMode("append").format("memory").queryName("d").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(distinct user_id) from d").first()[0] == e.select("user_id").distinct().count()


def test_late_rows_are_dropped(spark, tmp_path):
    import datetime as dt
    import os

    schema = "ts timestamp, value double"
    batches = (["10:00", "12:00"], ["12:01"], ["10:05", "11:55", "12:05"], ["15:00"], ["15:01"])
    src = tmp_path / "in"
    src.mkdir()
    for i, times in enumerate(batches):
        rows = [(dt.datetime.fromisoformat(f"2024-05-01 {t}"), 1.0) for t in times]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        (part,) = (tmp_path / f"b{i}").glob("part-*.parquet")
        os.rename(part, src / f"{i}.parquet")
        os.utime(src / f"{i}.parquet", (1_700_000_000 + i * 10,) * 2)
    stream = ev.read_stream(spark, str(src), schema, per_trigger=1)
    q = ev.windowed(stream, [], "1 hour").writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["start"].hour: r["n"] for r in spark.sql("select * from late").collect()}
    assert sorted(got.values()) == [1, 1, 3]  # 10:05 comes after its window was closed


def test_records_in_batch_and_as_a_stream(spark, tmp_path):
    from strandlake.sources.records import Records

    (tmp_path / "r").mkdir()
    for i in range(25):
        name = f"R{i:03d}" + ("" if i % 7 == 3 else ".1")  # some are known without a version only
        data = f"record {i}".encode()
        if i != 11:
            (tmp_path / "r" / name).write_bytes(gzip.compress(data) if i % 2 else data)
    (tmp_path / "r" / "R012.1").write_bytes(gzip.compress(b"x" * 50)[:-9])  # broken off
    (tmp_path / "r" / "latest").write_text("9")
    spark.dataSource.register(Records)
    options = {"fetcher": "strandlake.sources.records:Folder", "folder": f"file://{tmp_path}/r", "pattern": "R{id:03d}.1", "step": "4", "tries": "2", "wait": "0"}
    rows = spark.read.format("records").options(**options, last="24").load()
    assert rows.rdd.getNumPartitions() == 7
    got = {r["id"]: r for r in rows.collect()}
    assert sorted(got) == list(range(25))
    assert all(got[i]["text"] == f"record {i}" and got[i]["asked"] == f"R{i:03d}" + ("" if i % 7 == 3 else ".1") for i in got if i not in (11, 12))
    assert (got[11]["text"], got[11]["problem"]) == (None, "not found") and got[12]["text"] is None and "EOFError" in got[12]["problem"]
    with pytest.raises(Exception, match="last number"):
        spark.read.format("records").options(**options).load().collect()

    def run():
        stream = spark.readStream.format("records").options(**options).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(10))
    (tmp_path / "r" / "latest").write_text("20")
    assert run() == list(range(21))  # taken up where it stopped
