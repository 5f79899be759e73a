"""Curation queries: routing, sampling, quotas, packing, shards, set operations and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curate as cu
from ..session import broadcast
from .base import DNA, densest, dna, query, r6, read

_DRAW = "((({0}) * 2654435761 + {1} * 40503) % 4294967296 * 69069 % 4294967296) / 4294967296.0::DOUBLE"


@query(f"SELECT doc_id FROM documents WHERE {_DRAW.format('doc_id', 3)} < 0.3")
def flt01_bernoulli_keep(spark, d):
    return read(spark, d, "documents").where(cu.hash_draw(F.col("doc_id"), 3) < 0.3).select("doc_id")


@query("SELECT source, round(least(1.0::DOUBLE, 20000 / greatest(sum(n_chars) * 3.2::DOUBLE, 1)), 6) AS keep_prob FROM documents GROUP BY source")
def flt02_keep_probability(spark, d):
    s = read(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return s.select("source", r6(cu.keep_probability(F.lit(20000), F.col("n"), 3.2)).alias("keep_prob"))


@query(f"WITH {DNA} SELECT doc_id FROM dna WHERE length(seq) >= 99")
def flt03_min_length(spark, d):
    return dna(spark, d).where(F.char_length("seq") >= 99).select("doc_id")


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'hold' WHEN source IN ('src1', 'src2', 'src3') THEN 'excluded' ELSE 'train' END AS split FROM documents")
def flt04_route(spark, d):
    hold, out = F.col("source").isin("src1", "src2"), F.col("source").isin("src1", "src2", "src3")
    return read(spark, d, "documents").select("doc_id", cu.route(F.col("source"), hold, out).alias("split"))


_FAM = "f AS (SELECT 'FAM' || lpad((doc_id % 40)::VARCHAR, 3, '0') AS family, count(*) AS n_contigs, sum(n_chars)::BIGINT AS bp FROM documents GROUP BY 1)"


def _families(spark, d):
    docs = read(spark, d, "documents").withColumn("family", F.concat(F.lit("FAM"), F.lpad((F.col("doc_id") % 40).cast("string"), 3, "0")))
    return cu.family_stats(docs, "family", F.col("n_chars"))


@query(f"WITH {_FAM} SELECT family, n_contigs, bp FROM f")
def agg07_family_stats(spark, d):
    return _families(spark, d)


@query(f"WITH {_FAM}, w AS (SELECT *, sum((bp BETWEEN 9000 AND 11000)::INT) OVER () AS n FROM f) SELECT family, n_contigs, bp FROM w WHERE bp >= 9000 AND (bp <= 11000 OR n < 3)")
def flt05_admission_window(spark, d):
    return cu.admissible(_families(spark, d), 9000, 11000, 3)


@query(f"WITH {_FAM}, p AS (SELECT * FROM (VALUES ('FAM001'), ('FAM002'), ('FAM099')) t(family)) SELECT p.family, f.bp, f.family IS NULL AS missing FROM p LEFT JOIN f USING (family)")
def join12_pinned_families(spark, d):
    pins = spark.range(1).select(F.explode(F.array(*map(F.lit, ("FAM001", "FAM002", "FAM099")))).alias("family"))
    return pins.join(_families(spark, d), "family", "left").select("family", "bp", F.col("n_contigs").isNull().alias("missing"))


@query(f"""WITH {DNA}, c AS (SELECT d.source, d.doc_id % 40 AS round_, CASE WHEN d.doc_id % 3 = 0 THEN d.text ELSE dna.seq END AS s FROM documents d JOIN dna USING (doc_id)) SELECT source, round_, count_if(regexp_matches(s, '[^ACGTN]'))::BIGINT AS invalid, count_if(NOT regexp_matches(s, '[^ACGTN]'))::BIGINT AS valid, count_if(NOT regexp_matches(s, '[^ACGTN]')) >= 2 AS enough FROM c GROUP BY ALL""")
def flt06_candidate_validity(spark, d):
    """Candidates of a round are whole sequences, every third one a raw text; invalid ones are counted, not dropped."""
    docs = read(spark, d, "documents").select("doc_id", "source", "text")
    s = docs.join(dna(spark, d).select("doc_id", "seq"), "doc_id")
    s = s.select("source", (F.col("doc_id") % 40).alias("round_"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.col("seq")).alias("s"))
    return cu.candidate_validity(s, ["source", "round_"], "s")


@query(f"WITH {DNA}, b AS (SELECT doc_id, length(seq)::INTEGER AS n FROM dna) SELECT doc_id, count(*) AS n, min(a)::INTEGER AS lo, max(a)::INTEGER AS hi FROM b, unnest(range(CASE WHEN n - 8 < 127 THEN 0 ELSE 127 END, n - 7)) t(a) GROUP BY doc_id")
def flt09_anchor_pool(spark, d):
    a = dna(spark, d).select("doc_id", cu.anchors(F.char_length("seq"), 7, 128).alias("a")).where(F.size("a") > 0)
    return a.select("doc_id", F.size("a").cast("long").alias("n"), F.array_min("a").alias("lo"), F.array_max("a").alias("hi"))


@query(f"WITH {DNA}, b AS (SELECT doc_id, length(seq)::INTEGER AS n, floor(length(seq) * (1.0::DOUBLE - 0.1::DOUBLE))::INTEGER AS s FROM dna), v AS (SELECT doc_id, s, n - 8 - s + 1 AS m FROM b WHERE n - 8 >= s) SELECT doc_id, (s + CASE WHEN m <= 16 THEN i ELSE floor(i * (m - 1) / 15::DOUBLE) END)::INTEGER AS anchor FROM v, range(0, 16) t(i) WHERE i < m")
def flt10_held_out_anchors(spark, d):
    from ..functions.text import split_point

    rows = dna(spark, d).select("doc_id", split_point(F.col("seq")).alias("s"), F.char_length("seq").alias("n")).where("n - 8 >= s")
    return rows.select("doc_id", F.explode(cu.evenly(F.sequence(F.col("s"), F.col("n") - 8), 16)).alias("anchor"))


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE doc_id % 50 = 7)")
def join02_allow_list_semi(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    return docs.join(docs.where("doc_id % 50 = 7").select("source").distinct(), "source", "left_semi").select("doc_id", "source")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join03_exclude_anti(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, text FROM documents WHERE lang = 'de' UNION ALL SELECT item_id, text FROM benchmark")
def set01_union_all(spark, d):
    docs = read(spark, d, "documents").where("lang = 'de'").select("doc_id", "text")
    return docs.unionByName(read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))


@query("SELECT source, acc, doc_id FROM (SELECT source, n_chars % 97 AS acc, doc_id, row_number() OVER (PARTITION BY source, n_chars % 97 ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def set02_first_wins(spark, d):
    rows = read(spark, d, "documents").select("source", (F.col("n_chars") % 97).alias("acc"), "doc_id")
    return cu.first_wins(rows, ["source", "acc"], ["doc_id"])


@query("SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'extra', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def set03_symmetric_difference(spark, d):
    a, b = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id")
    return a.exceptAll(b).select(F.lit("missing").alias("side"), "doc_id").union(b.exceptAll(a).select(F.lit("extra").alias("side"), "doc_id"))


@query("SELECT source, doc_id, rank::INTEGER AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def top06_longest_per_family(spark, d):
    return cu.longest(read(spark, d, "documents"), "source", F.col("n_chars"), "doc_id", 3).select("source", "doc_id", "rank")


@query("SELECT source, doc_id, done::BIGINT AS done FROM (SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM documents) WHERE done < 30000")
def top08_quota_stop(spark, d):
    return cu.quota_stop(read(spark, d, "documents"), ["source"], "doc_id", "n_chars", 30000).select("source", "doc_id", "done")


@query("WITH w AS (SELECT source, sum(n_chars)::DOUBLE AS n FROM documents GROUP BY source) SELECT source, round(n / sum(n) OVER (), 6) AS weight FROM w")
def smp01_mixture_weights(spark, d):
    w = read(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").cast("double").alias("n"))
    return w.select("source", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("weight"))


_SIZES = "z AS (SELECT source, sum(n_chars)::BIGINT AS n FROM documents GROUP BY source)"


@query(f"WITH {_SIZES}, r AS (SELECT source, 1000 * n / sum(n) OVER ()::DOUBLE AS raw FROM z), f AS (SELECT *, floor(raw) AS fl FROM r), k AS (SELECT *, row_number() OVER (ORDER BY round(raw - fl, 9) DESC, source) AS rk, 1000 - sum(fl) OVER () AS rem FROM f) SELECT source, (fl + (rk <= rem)::INT)::BIGINT AS alloc FROM k")
def smp02_distribute_int(spark, d):
    z = read(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return cu.largest_remainder(z, F.lit(1000), "n", [], "source").select("source", "alloc")


_FILL = f"{_SIZES}, w AS (SELECT source, n, (CASE WHEN (row_number() OVER (ORDER BY source)) % 4 = 1 THEN 8 ELSE 1 END)::DOUBLE AS w FROM z), c AS (SELECT source, n, w / sum(w) OVER () AS w, 2.0::DOUBLE * n AS cap, sum(n) OVER ()::DOUBLE AS t FROM w), o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c), l AS (SELECT arg_min((t - before) / rest, (cap / w, source)) AS e FROM o WHERE (t - before) / rest <= cap / w + 1e-12), r AS (SELECT source, n, t, cap, least(cap, w * e) AS raw FROM o, l)"


@query(f"WITH {_FILL}, s AS (SELECT *, t * raw / sum(raw) OVER () AS q FROM r), f AS (SELECT *, floor(q) AS fl FROM s), k AS (SELECT *, row_number() OVER (ORDER BY round(q - fl, 9) DESC, source) AS rk, t - sum(fl) OVER () AS rem FROM f) SELECT source, raw >= cap - 0.5 AS capped, round(raw, 3) AS raw, (fl + (rk <= rem)::INT)::BIGINT AS alloc FROM k")
def smp03_water_fill(spark, d):
    z = read(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    z = z.withColumn("w", F.when(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source")) % 4 == 1, 8).otherwise(1))
    return cu.water_fill(z, "n", "w", "source", 2.0).select("source", "capped", F.round("raw", 3).alias("raw"), "alloc")


@query("WITH p AS (SELECT doc_id, n_chars // 100 AS n, (n_chars // 100) * (1 + doc_id % 2) + CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END AS take FROM documents WHERE n_chars >= 100) SELECT doc_id, take::BIGINT AS visits, least(take, n)::BIGINT AS windows, ceil(take / n::DOUBLE)::BIGINT AS most FROM p")
def smp04_epoch_plan(spark, d):
    n = F.floor(F.col("n_chars") / 100)
    p = read(spark, d, "documents").where("n_chars >= 100").select("doc_id", n.alias("n"), (n * (1 + F.col("doc_id") % 2) + F.when(F.col("n_chars") >= 200, 1).otherwise(0)).alias("take"))
    v = cu.epoch_windows(p, "n", "take", ["doc_id"], 5).groupBy("doc_id", "window").agg(F.count("*").alias("c"))
    return v.groupBy("doc_id").agg(F.sum("c").alias("visits"), F.count("*").alias("windows"), F.max("c").alias("most"))


@query(f"WITH h AS (SELECT source, doc_id, n_chars, {_DRAW.format('doc_id', 9)} AS h FROM documents) SELECT source, doc_id FROM (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM h) WHERE b < 20000")
def smp05_subsample_bp(spark, d):
    order = [cu.hash_draw(F.col("doc_id"), 9), F.col("doc_id")]
    return cu.subsample(read(spark, d, "documents"), ["source"], F.col("n_chars"), order, 20000).select("source", "doc_id")


@query(None)
def smp06_weighted_windows(spark, d):
    """Weighted source, uniform record, uniform window: inverse distribution functions on hashed draws."""
    s = dna(spark, d).where(F.char_length("seq") >= 64).withColumn("one", F.lit(1).cast("long"))
    s = cu.running(s, ["source"], "doc_id", "one", "i")
    w = s.groupBy("source").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0)).orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("hi", F.sum("n").over(every) / F.sum("n").over(Window.partitionBy(F.lit(0)))).withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("source")), F.lit(0.0)))
    u = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(k), "id"), 11) / float(1 << 53)
    draws = spark.range(200).select("id", u(1).alias("u"), u(2).alias("v"), u(3).alias("x"))
    got = draws.join(broadcast(w), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).withColumn("i", F.floor(F.col("v") * F.col("n")).cast("int"))
    got = got.join(s.select("source", "i", "doc_id", "seq"), ["source", "i"])
    return got.select("id", "source", "doc_id", F.substring("seq", F.floor(F.col("x") * (F.char_length("seq") - 63)).cast("int") + 1, F.lit(64)).alias("window"))


def _pack(rows: str, keys: str) -> str:
    """SQL: the rows (keys, ord, seq) of a table expression, packed in order into chunks of at most 8,000."""
    on = " AND ".join(f"l.{k} = f.{k}" for k in keys.split(", "))
    each = ", ".join(f"f.{k}" for k in keys.split(", "))
    return f"""q AS MATERIALIZED (SELECT {keys}, seq, row_number() OVER (PARTITION BY {keys} ORDER BY ord) AS r FROM {rows} WHERE seq <> ''), len AS MATERIALIZED (SELECT {keys}, r, length(seq) AS n FROM q), f({keys}, r, size, chunk) AS (SELECT {keys}, r, n, 0 FROM len WHERE r = 1 UNION ALL SELECT {each}, l.r, CASE WHEN f.size + 16 + l.n > 8000 THEN l.n ELSE f.size + 16 + l.n END, CASE WHEN f.size + 16 + l.n > 8000 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN len l ON {on} AND l.r = f.r + 1), packed AS (SELECT {keys}, chunk::INTEGER AS chunk, count(*)::INTEGER AS n, md5(string_agg(seq, 'NNNNNNNNNNNNNNNN' ORDER BY r)) AS h FROM f JOIN q USING ({keys}, r) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {DNA}, rows_ AS (SELECT source, doc_id // 64 AS file, doc_id AS ord, seq FROM dna), {_pack('rows_', 'source, file')} SELECT * FROM packed")
def st01_pack_chunks(spark, d):
    """Files are runs of 64 documents; each file of a source is a stream of its own."""
    rows = dna(spark, d).withColumn("file", F.floor(F.col("doc_id") / 64))
    return cu.pack(rows, ["source", "file"], "doc_id", limit=8000).select("source", "file", "chunk", "n", F.md5("text").alias("h"))


@query(None)
def st02_stitched_windows(spark, d):
    rows = dna(spark, d).withColumn("file", F.floor(F.col("doc_id") / 64))
    return cu.stitched_windows(rows, ["source", "file"], "doc_id").select("source", "file", "i", "text")


@query("WITH s AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS e FROM documents WHERE n_chars > 0) SELECT source, doc_id, k::BIGINT AS shard_idx, (greatest(e - n_chars, k * 5000) - (e - n_chars))::BIGINT AS first, (least(e, (k + 1) * 5000) - greatest(e - n_chars, k * 5000))::BIGINT AS n_pos FROM s, unnest(range((e - n_chars)::BIGINT // 5000, (e - 1)::BIGINT // 5000 + 1)) t(k)")
def snk01_shard_layout(spark, d):
    return cu.shard_layout(read(spark, d, "documents"), ["source"], "doc_id", "n_chars", 5000)


@query("WITH s AS (SELECT source, sum(n_chars) AS n FROM documents GROUP BY source) SELECT source, (n // 5000)::BIGINT AS complete, (n // 5000 * 5000)::BIGINT AS resume_at, (n % 5000)::BIGINT AS rest FROM s")
def st04_resume_positions(spark, d):
    lay = cu.shard_layout(read(spark, d, "documents"), ["source"], "doc_id", "n_chars", 5000).groupBy("source", "shard_idx").agg(F.sum("n_pos").alias("n"))
    full = F.col("n") == 5000
    return lay.groupBy("source").agg(F.sum(full.cast("long")).alias("complete"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("resume_at"), F.sum(F.when(full, 0).otherwise(F.col("n"))).cast("long").alias("rest"))


@query(f"WITH {DNA}, s AS (SELECT source, doc_id, seq, length(seq) AS n, sum(length(seq)) OVER (PARTITION BY source ORDER BY doc_id) AS e FROM dna WHERE seq <> ''), l AS (SELECT source, doc_id, k AS shard_idx, substr(seq, (greatest(e - n, k * 5000) - (e - n) + 1)::BIGINT, (least(e, (k + 1) * 5000) - greatest(e - n, k * 5000))::BIGINT) AS part FROM s, unnest(range((e - n)::BIGINT // 5000, (e - 1)::BIGINT // 5000 + 1)) t(k)), c AS (SELECT source, shard_idx, count(*) AS n_rows, string_agg(part, '' ORDER BY doc_id) AS whole FROM l WHERE source IN ('src1', 'src4') GROUP BY ALL) SELECT source, shard_idx::BIGINT AS shard_idx, n_rows, md5(whole) AS checksum, shard_idx % 7 <> 3 AS ok, substr(whole, 1025, 64) AS window_ FROM c WHERE length(whole) = 5000")
def src15_shard_catalogue(spark, d):
    """Full shards of two sources, read against the checksums on record (every seventh is wrong there), and one window of each."""
    rows = dna(spark, d).withColumn("n", F.char_length("seq").cast("long"))
    layout = cu.shard_layout(rows, ["source"], "doc_id", "n", 5000)
    full = cu.complete_shards(layout, ["source"], 5000, F.col("source").isin("src1", "src4"))
    layout = layout.join(full, ["source", "shard_idx"], "left_semi")
    got = cu.shard_checksums(layout, rows, ["source"], "doc_id", "seq")
    record = got.select("source", "shard_idx", F.when(F.col("shard_idx") % 7 == 3, F.lit("0")).otherwise(F.col("checksum")).alias("want"))
    # window 16 of 64 positions: rows that overlap positions 1024 to 1087 of their shard
    at = cu.running(layout.withColumn("__key", F.concat_ws("|", "source", F.col("shard_idx").cast("string"))), ["__key"], "doc_id", "n_pos", "at")
    cut = at.where("at < 1088 AND at + n_pos > 1024").join(rows.select("doc_id", "seq"), "doc_id")
    lo = F.greatest(F.lit(1024), F.col("at"))
    part = F.substring("seq", (F.col("first") + lo - F.col("at") + 1).cast("int"), (F.least(F.lit(1088), F.col("at") + F.col("n_pos")) - lo).cast("int"))
    cut = cut.groupBy("source", "shard_idx").agg(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("t")))).alias("w"))
    cut = cut.select("source", "shard_idx", F.array_join(F.transform("w", lambda x: x["t"]), "").alias("window_"))
    rows = full.join(got, ["source", "shard_idx"]).join(record, ["source", "shard_idx"]).join(cut, ["source", "shard_idx"])
    return rows.select("source", "shard_idx", "n_rows", "checksum", (F.col("want") == F.col("checksum")).alias("ok"), "window_")


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT vec_id, sum(abs(x)) AS t, sum(abs(x)) FILTER (WHERE i <= 8) AS s FROM e GROUP BY vec_id) SELECT vec_id FROM m WHERE abs(s / t + CASE WHEN vec_id % 9 = 0 THEN 0.5 ELSE 1 - s / t END - 1) > 0.02")
def snk02_verify_shard(spark, d):
    from ..operators.distributions import total
    from ..sources.sinks import shard_problems

    e = read(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), F.abs).alias("a"))
    e = e.select("vec_id", F.slice("a", 1, 8).alias("a"), total(F.col("a")).alias("t")).select("vec_id", F.transform("a", lambda x: x / F.col("t")).alias("p"))
    e = e.select("vec_id", "p", F.when(F.col("vec_id") % 9 == 0, 0.5).otherwise(1 - total(F.col("p"))).alias("r"), F.sequence(F.lit(0), F.lit(7)).alias("i"))
    return shard_problems(e, "p", "r", "i").select("vec_id")


@query("SELECT coalesce(o.source, n.source) AS source, coalesce(n.v, o.v)::BIGINT AS v FROM (SELECT source, count(*) AS v FROM documents GROUP BY source) o FULL JOIN (SELECT source, max(n_chars) AS v FROM documents WHERE lang = 'fr' GROUP BY source UNION ALL SELECT 'new', 1) n ON o.source = n.source")
def snk04_manifest_upsert(spark, d):
    docs = read(spark, d, "documents")
    old = docs.groupBy("source").agg(F.count("*").alias("v"))
    new = docs.where("lang = 'fr'").groupBy("source").agg(F.max("n_chars").alias("v")).union(spark.range(1).select(F.lit("new"), F.lit(1).cast("long")))
    return cu.upsert(old, new, "source")


@query("SELECT doc_id, floor(e / 50000) > floor((e - n_chars) / 50000) AS crossed FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS e FROM documents)")
def st11_crossed_multiples(spark, d):
    rows = cu.running(read(spark, d, "documents").select("doc_id", "n_chars"), [], "doc_id", "n_chars", "b")
    return rows.select("doc_id", cu.crossed(F.col("b") + F.col("n_chars"), F.col("n_chars"), 50000).alias("crossed"))


#: Families are 40 accessions of six characters; those with 30,000 to 90,000 symbols may be held out, the first three by size.
_CURATED = f"""{DNA}, c AS (SELECT doc_id, 'F' || lpad((doc_id % 40)::VARCHAR, 5, '0') AS family, seq FROM dna WHERE seq <> ''),
st AS (SELECT family, count(*) AS n_contigs, sum(length(seq)) AS bp FROM c GROUP BY family), fit AS (SELECT *, bp >= 30000 AND bp <= 90000 AS inside FROM st WHERE bp >= 30000),
adm AS (SELECT * FROM fit WHERE inside OR (SELECT count(*) FROM fit WHERE inside) < 3), hold AS (SELECT family FROM adm ORDER BY bp DESC, family LIMIT 3),
rt AS (SELECT c.*, CASE WHEN h.family IS NOT NULL THEN 'hold' WHEN c.family IN ('F00003', 'F00007') THEN 'excluded' ELSE 'train' END AS split FROM c LEFT JOIN hold h USING (family)),
kp AS (SELECT * FROM rt WHERE split = 'hold' OR split = 'train' AND {_DRAW.format('doc_id', 7)} < 0.6),
fw AS (SELECT split, family, doc_id AS ord, seq FROM kp QUALIFY row_number() OVER (PARTITION BY split, family, md5(seq) ORDER BY doc_id) = 1)"""


@query(f"WITH RECURSIVE {_CURATED}, {_pack('fw', 'split, family')} SELECT split, family, chunk, n, h, n_contigs, bp::BIGINT AS bp FROM packed JOIN st USING (family)")
def smp07_two_pass_curation(spark, d):
    """First pass: statistics by family; then hold-outs, routing, sampling, exact copies once, packing, with the statistics."""
    rows = dna(spark, d).where("seq <> ''").select("doc_id", F.concat(F.lit("F"), F.lpad((F.col("doc_id") % 40).cast("string"), 5, "0")).alias("family"), "seq")
    stats = cu.family_stats(rows, "family", F.char_length("seq"))
    hold = cu.admissible(stats, 30_000, 90_000, 3).orderBy(F.desc("bp"), "family").limit(3).select("family", F.lit(True).alias("held"))
    rows = rows.join(F.broadcast(hold), "family", "left")  # three rows
    held = F.coalesce("held", F.lit(False))
    rows = rows.withColumn("split", cu.route(F.col("family"), held, held | F.col("family").isin("F00003", "F00007")))
    rows = rows.where((F.col("split") == "hold") | (F.col("split") == "train") & (cu.hash_draw(F.col("doc_id"), 7) < 0.6))
    rows = cu.first_wins(rows.select("split", "family", F.md5("seq").alias("acc"), "doc_id", "seq"), ["split", "family", "acc"], ["doc_id"])
    packed = cu.pack(rows, ["split", "family"], "doc_id", limit=8000)
    return packed.join(stats, "family").select("split", "family", "chunk", "n", F.md5("text").alias("h"), "n_contigs", "bp")


@query(f"WITH RECURSIVE {DNA}, k AS (SELECT source, doc_id // 64 AS file, doc_id AS ord, seq FROM dna WHERE {_DRAW.format('doc_id', 4)} < 0.5), {_pack('k', 'source, file')} SELECT * FROM packed")
def smp08_sampled_sources(spark, d):
    """Each file of a source is sampled and packed by itself."""
    k = dna(spark, d).where(cu.hash_draw(F.col("doc_id"), 4) < 0.5).withColumn("file", F.floor(F.col("doc_id") / 64))
    return cu.pack(k, ["source", "file"], "doc_id", limit=8000).select("source", "file", "chunk", "n", F.md5("text").alias("h"))


@query(densest("SELECT 'gtdb_' || k.source || '_coding' AS name, k.source AS prefix, k.start::INTEGER AS window_start, length(r.seq)::INTEGER AS contig_len, span::BIGINT AS orf_span_bp, substr(r.seq, k.start + 1, 1024) AS prompt_seq FROM k JOIN r ON r.source = k.source AND r.contig = k.contig WHERE rk = 1"))
def smp09_prompt_construction(spark, d):
    """The prompt of a family is the start of the window with the longest open span among its longest sequences."""
    from ..operators import orf

    s = dna(spark, d).select("source", "doc_id", "seq")
    best = orf.densest_window(s, "source", "doc_id")
    top = cu.longest(s, "source", F.char_length("seq"), "doc_id", 3).withColumn("contig", F.col("rank") - 1)
    rows = best.join(top, ["source", "contig"])
    return rows.select(
        F.concat(F.lit("gtdb_"), "source", F.lit("_coding")).alias("name"), F.col("source").alias("prefix"), F.col("start").alias("window_start"),
        F.char_length("seq").alias("contig_len"), F.col("span").alias("orf_span_bp"), F.substring("seq", F.col("start") + 1, F.lit(1024)).alias("prompt_seq"),
    )


@query("SELECT lang AS species, count(*) AS n, sum((n_chars < 99)::INT)::BIGINT AS failed, sum(CASE WHEN n_chars >= 99 THEN n_chars ELSE 0 END)::BIGINT AS bp FROM documents GROUP BY lang")
def agg24_species_summary(spark, d):
    short = F.col("n_chars") < 99
    return read(spark, d, "documents").groupBy(F.col("lang").alias("species")).agg(F.count("*").alias("n"), F.sum(short.cast("long")).alias("failed"), F.sum(F.when(~short, F.col("n_chars")).otherwise(0)).alias("bp"))


@query(f"WITH {DNA} SELECT count(DISTINCT seq) AS exact_unique, count(*) AS n FROM dna")
def agg25_exact_unique(spark, d):
    return dna(spark, d).select(F.sha2("seq", 256).alias("h")).agg(F.count_distinct("h").alias("exact_unique"), F.count("*").alias("n"))
