"""Probability-row queries: transforms, packing, quantisation, acceptance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import acceptance as acc
from ..operators import distributions as ds
from .base import EMB, GAMMA, ROUNDS, SOFT, embeddings, query, r6, read, rounds

_TOP = SOFT + ", rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS r FROM soft)"


def _long(df, c, *keep):
    return df.select(*keep, F.posexplode(c).alias("i", "p"))


@query(f"WITH {_TOP} SELECT vec_id, i::INTEGER AS i, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS p FROM rk WHERE r <= 4")
def top02_softmax_topk(spark, d):
    rows = embeddings(spark, d).select("vec_id", ds.transformed(F.col("e"), 1.0, 4).alias("p"))
    return _long(rows, "p", "vec_id").where("p > 0").select("vec_id", "i", r6(F.col("p")).alias("p"))


@query(f"WITH {EMB} SELECT vec_id, arg_max(i, (x, -i))::INTEGER AS best FROM emb GROUP BY vec_id")
def top07_argmax(spark, d):
    return embeddings(spark, d).select("vec_id", ds.argmax(F.col("e")).alias("best"))


@query(f"WITH {_TOP} SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY r) AS idx, round(1 - sum(p), 6) AS resid FROM rk WHERE r <= 8 GROUP BY vec_id")
def top03_pack_top8(spark, d):
    idx, _, resid = ds.packed(ds.softmax(F.col("e")))
    return embeddings(spark, d).select("vec_id", F.array_join(idx.cast("array<string>"), ",").alias("idx"), r6(resid).alias("resid"))


@query(f"WITH {_TOP}, t AS (SELECT * FROM rk WHERE r <= 4) SELECT vec_id, i::INTEGER AS i, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS p FROM t")
def top04_top4_of_top8(spark, d):
    idx, val, _ = ds.packed(ds.softmax(F.col("e")))
    rows = embeddings(spark, d).select("vec_id", F.slice(idx, 1, 4).alias("idx"), F.slice(val, 1, 4).alias("val"))
    part = ds.let(ds.total(F.col("val")), lambda s: F.transform("val", lambda v: v / s))
    rows = rows.select("vec_id", "idx", part.alias("p")).select("vec_id", F.explode(F.arrays_zip("idx", "p")).alias("z"))
    return rows.select("vec_id", F.col("z.idx").alias("i"), r6(F.col("z.p")).alias("p"))


@query(f"WITH {EMB}, k AS (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM emb) SELECT vec_id, round(max(CASE WHEN r = 1 THEN x END) - max(CASE WHEN r = 2 THEN x END), 6) AS gap FROM k GROUP BY vec_id")
def top05_top_gap(spark, d):
    return embeddings(spark, d).select("vec_id", r6(ds.top_gap(F.col("e"))).alias("gap"))


@query(f"WITH {SOFT} SELECT vec_id, round(-sum(greatest(least(p, 1), 1e-12) * log2(greatest(least(p, 1), 1e-12))), 6) AS bits FROM soft GROUP BY vec_id")
def fn08_entropy_bits(spark, d):
    return embeddings(spark, d).select("vec_id", r6(ds.entropy_bits(ds.softmax(F.col("e")))).alias("bits"))


_QUANT = EMB + ", sc AS (SELECT vec_id, greatest(max(abs(x)), 1e-8) AS s FROM emb GROUP BY vec_id)"


@query(f"WITH {_QUANT} SELECT vec_id, i::INTEGER AS i, greatest(least(round_even(x / s * 127.0::DOUBLE, 0), 127), -127)::TINYINT AS q FROM emb JOIN sc USING (vec_id)")
def fn09_quantise(spark, d):
    q, _ = ds.quantised(F.col("e"))
    return embeddings(spark, d).select("vec_id", q.alias("q")).select("vec_id", F.posexplode("q").alias("i", "q"))


@query(f"WITH {_QUANT} SELECT vec_id, round(max(abs(greatest(least(round_even(x / s * 127.0::DOUBLE, 0), 127), -127) * (s / 127.0::DOUBLE) - x) / s), 6) AS worst FROM emb JOIN sc USING (vec_id) GROUP BY vec_id")
def fn09_dequantise_error(spark, d):
    q, s = ds.quantised(F.col("e"))
    rows = embeddings(spark, d).select("vec_id", "e", q.alias("q"), s.alias("s"))
    back = ds.dequantised(F.col("q"), F.col("s"))
    return rows.select("vec_id", r6(F.array_max(F.zip_with(back, "e", lambda a, b: F.abs(a - b))) / F.col("s")).alias("worst"))


@query(f"WITH {_TOP} SELECT vec_id, i::INTEGER AS i, round(CASE WHEN r <= 8 THEN p ELSE 0 END, 6) AS p FROM rk")
def fn10_reconstruct(spark, d):
    idx, val, _ = ds.packed(ds.softmax(F.col("e")))
    rows = embeddings(spark, d).select("vec_id", idx.alias("idx"), val.alias("val"))
    return _long(rows, ds.unpacked(F.col("idx"), F.col("val"), 64), "vec_id").select("vec_id", "i", r6(F.col("p")).alias("p"))


@query(f"WITH {EMB}, u AS (SELECT vec_id, i, greatest(x, 0) AS x FROM emb), t AS (SELECT *, sum(x) OVER (PARTITION BY vec_id) AS s, count(*) OVER (PARTITION BY vec_id) AS n FROM u) SELECT vec_id, i::INTEGER AS i, round(CASE WHEN s > 0 THEN x / s ELSE 1.0 / n END, 6) AS p FROM t")
def fn12_normalise_row(spark, d):
    return _long(embeddings(spark, d), ds.normalised(F.col("e")), "vec_id").select("vec_id", "i", r6(F.col("p")).alias("p"))


_PAIR = SOFT + ", a AS (SELECT vec_id AS id, i, p FROM soft WHERE vec_id % 2 = 0), b AS (SELECT vec_id - 1 AS id, i, p AS q FROM soft WHERE vec_id % 2 = 1), pq AS (SELECT id, i, p, q FROM a JOIN b USING (id, i))"


def _pairs(spark, d):
    e = embeddings(spark, d).select("vec_id", ds.softmax(F.col("e")).alias("p"))
    a = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "p")
    return a.join(e.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("id"), F.col("p").alias("q")), "id")


@query(f"WITH {_PAIR} SELECT id, i::INTEGER AS i, round(CASE WHEN q <= 0 THEN CASE WHEN p > 0 THEN 1 ELSE 0 END ELSE least(1, p / q) END, 6) AS accept FROM pq")
def fn14_accept_probability(spark, d):
    rows = _pairs(spark, d).select("id", F.posexplode(F.arrays_zip("p", "q")).alias("i", "z"))
    return rows.select("id", "i", r6(ds.accept_probability(F.col("z.p"), F.col("z.q"))).alias("accept"))


@query(f"WITH {_PAIR}, l AS (SELECT id, i, p, greatest(p - q, 0) AS x FROM pq), t AS (SELECT *, sum(x) OVER (PARTITION BY id) AS s FROM l) SELECT id, i::INTEGER AS i, round(CASE WHEN s > 0 THEN x / s ELSE p END, 6) AS p FROM t")
def fn15_residual(spark, d):
    return _long(_pairs(spark, d).select("id", ds.residual(F.col("p"), F.col("q")).alias("r")), "r", "id").select("id", "i", r6(F.col("p")).alias("p"))


@query(f"WITH {_PAIR} SELECT id, round(1 - 0.5 * sum(abs(p - q)), 6) AS accept FROM pq GROUP BY id")
def fn16_analytic_accept(spark, d):
    return _pairs(spark, d).select("id", r6(ds.acceptance(F.col("p"), F.col("q"))).alias("accept"))


@query(f"WITH {_PAIR}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, i) AS r FROM pq), m AS (SELECT id, i, p / sum(p) OVER (PARTITION BY id) AS p FROM k WHERE r <= 4) SELECT id, i::INTEGER AS i, round(p, 6) AS p FROM m")
def fn13_draft_transform(spark, d):
    rows = _pairs(spark, d).select("id", ds.keep_top(F.col("p"), 4).alias("t"))
    return _long(rows, "t", "id").where("p > 0").select("id", "i", r6(F.col("p")).alias("p"))


@query("""SELECT item_id, n AS symbol, round(CASE WHEN n = substr('ACGTN', (item_id % 5)::INTEGER + 1, 1) THEN 0.92 ELSE 0.02 END, 6)::DOUBLE AS p FROM benchmark CROSS JOIN unnest(['A','C','G','T','N']) t(n)""")
def fn17_lookup_mixture(spark, d):
    b = read(spark, d, "benchmark").select("item_id", F.substring(F.lit("ACGTN"), (F.col("item_id") % 5).cast("int") + 1, F.lit(1)).alias("s"))
    rows = b.select("item_id", F.posexplode(ds.lookup_mixture(F.col("s"))).alias("i", "p"))
    return rows.select("item_id", F.substring(F.lit("ACGTN"), F.col("i") + 1, F.lit(1)).alias("symbol"), r6(F.col("p")).alias("p"))


@query(f"WITH {_PAIR}, t AS (SELECT id, 0.5 * sum(abs(p - q)) AS tv, -ln(greatest(max(CASE WHEN i = id % 64 THEN p END), 1e-12)) AS ce FROM pq GROUP BY id) SELECT id, round(ce, 6) AS ce, round(tv, 6) AS tv, round(-((1 - tv) * ln(0.7::DOUBLE) + tv * ln(1 - 0.7::DOUBLE)), 6) AS bce, round(0.1 * ce + 0.9 * tv - ((1 - tv) * ln(0.7::DOUBLE) + tv * ln(1 - 0.7::DOUBLE)), 6) AS loss FROM t")
def fn18_distill_losses(spark, d):
    parts = ds.losses(F.col("p"), F.col("q"), (F.col("id") % 64).cast("int"), F.lit(0.7))
    return _pairs(spark, d).select("id", *[r6(c).alias(k) for k, c in parts.items()])


@query(f"WITH {SOFT}, h AS (SELECT vec_id, least(-sum(p * log2(p)) / 3, 2.05) AS v FROM soft GROUP BY vec_id) SELECT least(floor(v / 0.1 + 1e-9), 19)::INTEGER AS bin, count(*) AS n FROM h WHERE v BETWEEN 0 AND 2 GROUP BY 1")
def agg10_entropy_histogram(spark, d):
    rows = embeddings(spark, d).select(F.least(ds.entropy_bits(ds.softmax(F.col("e"))) / 3, F.lit(2.05)).alias("v"))
    return ds.histogram(rows, "v", [])


@query(f"WITH {SOFT}, h AS (SELECT vec_id, label, least(-sum(p * log2(p)) / 3, 2.0) AS v FROM soft GROUP BY vec_id, label), part AS (SELECT label, least(floor(v / 0.1 + 1e-9), 19)::INTEGER AS bin, count(*) AS n FROM h GROUP BY ALL), m AS (SELECT label, count(*) AS n, avg(v) AS mean FROM h GROUP BY label), t AS (SELECT sum(n) AS n, sum(mean * n) / sum(n) AS mean FROM m) SELECT bin, sum(part.n)::BIGINT AS count, any_value(t.n)::BIGINT AS n, round(any_value(t.mean), 6) AS mean FROM part, t GROUP BY bin")
def agg11_merge_histograms(spark, d):
    """One histogram a label, merged bin by bin; the mean is weighted by the parts' counts."""
    v = F.least(ds.entropy_bits(ds.softmax(F.col("e"))) / 3, F.lit(2.0))
    parts = ds.histograms(embeddings(spark, d).select("label", v.alias("v")), "v", ["label"])
    out = ds.finalised(ds.merged_histograms(parts))
    return out.select(F.posexplode("counts").alias("bin", "count"), "n", r6(F.col("mean")).alias("mean")).where("count > 0")


@query(f"WITH {ROUNDS} SELECT run, count(*) AS n_rounds, round(avg(k), 6) AS mean_k, round(avg(k) + 1, 6) AS mean_tau, round(sum(k + 1) / sum(value), 6) AS tok_s, round((avg(k) + 1) * 19.413 / 21.269, 6) AS proj_speedup FROM rounds GROUP BY run")
def agg12_run_metrics(spark, d):
    rows = rounds(spark, d).withColumn("emitted", F.col("k") + 1)
    out = acc.run_metrics(rows, ["run"], "emitted", "value")
    return out.select("run", "n_rounds", *[r6(F.col(c)).alias(c) for c in ("mean_k", "mean_tau", "tok_s", "proj_speedup")])


@query(f"WITH {ROUNDS}, g AS (SELECT run, k, pos FROM rounds CROSS JOIN range(0, {GAMMA}) t(pos)) SELECT run, pos::INTEGER AS pos, round(avg((k > pos)::INT), 6) AS rate FROM g GROUP BY ALL")
def agg13_accept_rates(spark, d):
    return acc.position_rates(rounds(spark, d), GAMMA, ["run"]).select("run", "pos", r6(F.col("rate")).alias("rate"))


@query(f"WITH {ROUNDS}, g AS (SELECT run, k, pos FROM rounds CROSS JOIN range(0, {GAMMA}) t(pos)) SELECT run, pos::INTEGER AS pos, round(sum((k > pos)::INT)::DOUBLE / nullif(sum((k >= pos)::INT), 0), 6) AS cond_rate FROM g GROUP BY ALL")
def agg14_conditional_rates(spark, d):
    return acc.position_rates(rounds(spark, d), GAMMA, ["run"]).select("run", "pos", r6(F.col("cond_rate")).alias("cond_rate"))


_BLOCK = f"{ROUNDS}, bl AS (SELECT event_type AS pack, pos, 1.0::DOUBLE - ((event_id * 31 + pos * 17) % 100) / 200.0::DOUBLE AS alpha FROM rounds CROSS JOIN range(0, 4) t(pos)), m AS (SELECT pack, pos, avg(alpha) AS alpha, count(*) AS n FROM bl GROUP BY ALL UNION ALL SELECT NULL, pos, avg(alpha), count(*) FROM bl GROUP BY pos)"


_DRAFTS = f"{EMB}, c AS (SELECT vec_id, label, floor(i / 16)::INTEGER AS pos, i % 16 AS t, x FROM emb), cm AS (SELECT *, max(x) OVER (PARTITION BY vec_id, pos) AS m FROM c), cp AS (SELECT vec_id, label, pos, t, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY vec_id, pos) AS p FROM cm), pr AS (SELECT a.vec_id, a.label, a.pos, 1 - 0.5 * sum(abs(a.p - b.p)) AS alpha, arg_max(a.t, (a.p, -a.t)) AS draft, arg_max(b.t, (b.p, -b.t)) AS teacher FROM cp a JOIN cp b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos AND b.t = a.t WHERE a.vec_id % 2 = 0 GROUP BY ALL), bm AS (SELECT label AS pack, pos, avg(alpha) AS alpha, count(*) AS n, sum((draft = teacher)::INT) AS vp, sum((draft = vec_id % 16)::INT) AS vg FROM pr GROUP BY ALL UNION ALL SELECT NULL, pos, avg(alpha), count(*), sum((draft = teacher)::INT), sum((draft = vec_id % 16)::INT) FROM pr GROUP BY pos)"


@query(f"WITH {_DRAFTS}, r AS (SELECT *, exp(sum(ln(alpha)) OVER (PARTITION BY pack ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS run FROM bm) SELECT pack, max(n)::BIGINT AS n_blocks, round(1 + sum(run), 6) AS tau, round(sum(vp)::DOUBLE / sum(n), 6) AS top1_vs_teacher, round(sum(vg)::DOUBLE / sum(n), 6) AS top1_vs_truth FROM r GROUP BY pack")
def agg17_block_metrics(spark, d):
    """Blocks of four positions: each vector drafts, the next one is its teacher, over the vector's four stretches of 16 symbols."""
    e = embeddings(spark, d)
    a = e.where("vec_id % 2 = 0").select("vec_id", F.col("label").alias("pack"), "e")
    both = a.join(e.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    rows = both.select("vec_id", "pack", "e", "f", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    draft, teacher = (ds.softmax(F.slice(c, F.col("pos") * 16 + 1, F.lit(16))) for c in ("e", "f"))
    rows = rows.select("vec_id", "pack", "pos", draft.alias("p"), teacher.alias("q"))
    rows = rows.select("pack", "pos", ds.acceptance(F.col("p"), F.col("q")).alias("alpha"), ds.argmax(F.col("p")).alias("draft"), ds.argmax(F.col("q")).alias("teacher"), (F.col("vec_id") % 16).cast("int").alias("truth"))
    out = acc.block_metrics(rows, agree={"top1_vs_teacher": ("draft", "teacher"), "top1_vs_truth": ("draft", "truth")})
    return out.select("pack", "n_blocks", *[r6(F.col(c)).alias(c) for c in ("tau", "top1_vs_teacher", "top1_vs_truth")])


@query(f"WITH {SOFT} SELECT label AS run, i::INTEGER AS pos, count(*) AS n, round(avg(p), 6) AS mean FROM soft WHERE i < vec_id % 8 + 1 GROUP BY ALL")
def agg27_confidence_by_position(spark, d):
    """Mean confidence by position of drafts of one to eight tokens."""
    conf = F.slice(ds.softmax(F.col("e")), F.lit(1), (F.col("vec_id") % 8 + 1).cast("int"))
    rows = embeddings(spark, d).select(F.col("label").alias("run"), conf.alias("conf"))
    return acc.confidence_by_position(rows, ["run"], "conf").withColumn("mean", r6(F.col("mean")))


@query(f"WITH {_BLOCK} SELECT coalesce(pack, 'all') AS pack, pos::INTEGER AS pos, round(exp(sum(ln(alpha)) OVER (PARTITION BY pack ORDER BY pos ROWS UNBOUNDED PRECEDING)), 6) AS chance FROM m")
def win06_running_product(spark, d):
    rows = rounds(spark, d).select(F.col("event_type").alias("pack"), "event_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    rows = rows.withColumn("alpha", 1.0 - ((F.col("event_id") * 31 + F.col("pos") * 17) % 100) / 200.0)
    m = rows.groupBy("pack", "pos").agg(F.avg("alpha").alias("a")).unionByName(rows.groupBy("pos").agg(F.avg("alpha").alias("a")).withColumn("pack", F.lit("all")))
    return ds.running_product(m, ["pack"], "pos", "a", "chance").select("pack", "pos", r6(F.col("chance")).alias("chance"))


@query(f"WITH {ROUNDS} SELECT event_id, k::INTEGER AS prefix FROM rounds")
def win10_prefix_length(spark, d):
    return rounds(spark, d).select("event_id", acc.prefix_length(acc.mask_of(F.col("k"), GAMMA)).alias("prefix"))


_TWO = EMB + ", tok AS (SELECT vec_id, i, abs(floor(x * 3)) AS t FROM emb), a AS (SELECT vec_id AS id, i, t FROM tok WHERE vec_id % 2 = 0), b AS (SELECT vec_id - 1 AS id, i, t AS u FROM tok WHERE vec_id % 2 = 1)"


def _two(spark, d):
    t = embeddings(spark, d).select("vec_id", "e", F.transform("e", lambda x: F.abs(F.floor(x * 3)).cast("double")).alias("t"))
    a = t.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.col("t").alias("a"), F.col("e").alias("ea"))
    return a.join(t.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("id"), F.col("t").alias("b"), F.col("e").alias("eb")), "id")


@query(f"WITH {_TWO} SELECT id, min(i) FILTER (WHERE t <> u)::INTEGER AS disagree_at FROM a JOIN b USING (id, i) GROUP BY id")
def win11_first_disagreement(spark, d):
    return _two(spark, d).select("id", acc.first_disagreement(F.col("a"), F.col("b")).alias("disagree_at"))


@query(f"WITH {_TWO} SELECT id, sum((t = u)::INT)::BIGINT AS same FROM a JOIN b USING (id, i) GROUP BY id")
def join11_positional_zip(spark, d):
    return _two(spark, d).select("id", F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda t: t)).cast("long").alias("same"))


_CMP = EMB + ", k AS (SELECT vec_id, x, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM emb), g AS (SELECT vec_id, max(CASE WHEN r = 1 THEN x END) - max(CASE WHEN r = 2 THEN x END) AS gap, max(CASE WHEN r = 1 THEN i END) AS best FROM k GROUP BY vec_id), mv AS (SELECT a.vec_id AS id, max(abs(a.x - b.x)) AS moved FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1 AND b.i = a.i WHERE a.vec_id % 2 = 0 GROUP BY 1), cl AS (SELECT id, CASE WHEN least(a.gap, b.gap) < 1e-3 THEN 'tie' WHEN moved + 1e-12 >= least(a.gap, b.gap) THEN 'path' ELSE 'nontie' END AS verdict, a.best <> b.best AS differs FROM mv JOIN g a ON a.vec_id = id JOIN g b ON b.vec_id = id + 1)"


@query(f"WITH {_CMP} SELECT id, verdict FROM cl")
def fn25_compare_greedy(spark, d):
    return _two(spark, d).select("id", acc.classify_disagreement(F.col("ea"), F.col("eb")).alias("verdict"))


@query(f"WITH {_CMP} SELECT count(*) AS cases, sum((differs AND verdict = 'nontie')::INT)::BIGINT AS n_nontie, sum((differs AND verdict <> 'nontie')::INT)::BIGINT AS n_tie_flip, sum((differs AND verdict = 'nontie')::INT) = 0 AS passed FROM cl")
def agg22_divergence_totals(spark, d):
    rows = _two(spark, d).select(acc.classify_disagreement(F.col("ea"), F.col("eb")).alias("v"), (ds.argmax(F.col("ea")) != ds.argmax(F.col("eb"))).alias("differs"))
    bad = F.sum((F.col("differs") & (F.col("v") == "nontie")).cast("int"))
    return rows.agg(F.count("*").alias("cases"), bad.alias("n_nontie"), F.sum((F.col("differs") & (F.col("v") != "nontie")).cast("int")).alias("n_tie_flip"), (bad == 0).alias("passed"))


_EVID = _TOP + ", t4 AS (SELECT vec_id, i, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM rk WHERE r <= 4), tv AS (SELECT coalesce(a.vec_id, b.vec_id - 1) AS id, 0.5 * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) AS tvd FROM (SELECT * FROM t4 WHERE vec_id % 2 = 0) a FULL JOIN (SELECT * FROM t4 WHERE vec_id % 2 = 1) b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1), ke AS (SELECT vec_id, label, x, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM emb), ge AS (SELECT vec_id, any_value(label) AS label, max(CASE WHEN r = 1 THEN x END) - max(CASE WHEN r = 2 THEN x END) AS gap, max(CASE WHEN r = 1 THEN i END) AS best FROM ke GROUP BY vec_id), de AS (SELECT a.vec_id AS id, max(abs(a.x - b.x)) AS delta FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1 AND b.i = a.i WHERE a.vec_id % 2 = 0 GROUP BY 1), ev AS (SELECT a.label AS kind, a.best <> b.best AS flip, least(a.gap, b.gap) < 0.05 AS near_tie, tvd, delta, a.vec_id % 4 = 0 OR a.label % 3 <> 1 AS sound FROM de JOIN tv USING (id) JOIN ge a ON a.vec_id = id JOIN ge b ON b.vec_id = id + 1)"


@query(f"WITH {_EVID}, g AS (SELECT kind, count(*) FILTER (WHERE flip) AS flips, count(*) FILTER (WHERE flip AND near_tie) AS near_tie_flips, round(max(tvd), 6) AS max_tvd, round(avg(tvd), 6) AS mean_tvd, round(max(delta), 6) AS max_delta, bool_and(sound) AS sound FROM ev GROUP BY kind) SELECT kind, flips, near_tie_flips, max_tvd, mean_tvd, max_delta, CASE WHEN flips <> near_tie_flips OR NOT sound THEN 'needs_review' WHEN flips = 0 THEN 'passed' ELSE 'passed_with_differences' END AS status FROM g")
def fn26_numerical_evidence(spark, d):
    """Two arms of scores side by side: other first choices, near ties among them, distances, and what that amounts to."""
    labels = embeddings(spark, d).select(F.col("vec_id").alias("id"), "label")
    facts = acc.numerical_evidence(F.col("ea"), F.col("eb"), 0.05)
    rows = _two(spark, d).join(labels, "id").select("id", F.col("label").alias("kind"), *[c.alias(k) for k, c in facts.items()])
    out = acc.classified(rows, ["kind"], (F.col("id") % 4 == 0) | (F.col("kind") % 3 != 1))
    return out.withColumns({c: r6(F.col(c)) for c in ("max_tvd", "mean_tvd", "max_delta")})


_UPPER = f"{ROUNDS}, kc AS (SELECT run, k, count(*)::DOUBLE AS n FROM rounds GROUP BY ALL), kt AS (SELECT run, k, n / sum(n) OVER (PARTITION BY run) AS p FROM kc), al AS (SELECT k, n / sum(n) OVER () AS p FROM (SELECT k, sum(n) AS n FROM kc GROUP BY k)), tv AS (SELECT g.run, 0.5 * sum(abs(coalesce(kt.p, 0) - al.p)) AS point FROM (SELECT DISTINCT run FROM kc) g CROSS JOIN al LEFT JOIN kt ON kt.run = g.run AND kt.k = al.k GROUP BY g.run), nn AS (SELECT run, count(*) AS n, avg(k) AS mk FROM rounds GROUP BY run)"


@query(f"WITH {_UPPER} SELECT nn.run, (n + 1024 - 1)::BIGINT AS kv_len, round((mk + 1) * 19.413 / 21.269, 6) AS projected, round(point, 6) AS tvd, CASE WHEN nn.run % 7 = 0 THEN false ELSE point + 1.96 * sqrt(0.25 / n) < 0.16 END AS upper_ok FROM nn JOIN tv USING (run)")
def fn27_run_scalars(spark, d):
    """Cache length, projected speed-up, and whether the distance of a run's accepted lengths from everyone's stays under a margin;
    a run without an upper end fails."""
    n = rounds(spark, d).groupBy("run", "k").agg(F.count("*").alias("n"))
    every, size = n.groupBy("k").agg(F.sum("n").alias("all")), n.groupBy("run").agg(F.sum("n").alias("n_run"), (F.sum(F.col("n") * F.col("k")) / F.sum("n")).alias("mean"))
    total = every.agg(F.sum("all").alias("total"))
    grid = size.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(total)).join(n, ["run", "k"], "left")  # runs by at most 13 lengths
    gap = F.abs(F.coalesce("n", F.lit(0)) / F.col("n_run") - F.col("all") / F.col("total"))
    tvd = grid.groupBy("run", "n_run", "mean").agg((F.sum(gap) * 0.5).alias("tvd"))
    high = F.when(F.col("run") % 7 != 0, F.col("tvd") + 1.96 * F.sqrt(0.25 / F.col("n_run")))
    return tvd.select("run", (F.col("n_run") + 1024 - 1).alias("kv_len"), r6((F.col("mean") + 1) * 19.413 / 21.269).alias("projected"), r6(F.col("tvd")).alias("tvd"), acc.tvd_upper_ok(F.col("tvd"), high, 0.16).alias("upper_ok"))


@query(f"""SELECT vec_id, p::INTEGER AS pos, CASE WHEN p = 0 THEN label ELSE 511 END::INTEGER AS id, round(exp(-p / 7.0::DOUBLE), 6) AS weight, round(sum(e.x * exp(-e.p / 7.0::DOUBLE)) OVER (PARTITION BY vec_id ORDER BY e.p ROWS UNBOUNDED PRECEDING), 6) AS weighed FROM (SELECT vec_id, label, i AS p, abs(x) AS x FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE i < 7) e""")
def win15_block_ids_and_weights(spark, d):
    """Blocks of seven: the anchor's token first and masks after it, and a block's losses summed under weights that decay by position."""
    rows = embeddings(spark, d).select("vec_id", "label", F.posexplode(F.slice("e", 1, 7)).alias("pos", "x"))
    weight = acc.position_weight(F.col("pos"), 7.0)
    upto = Window.partitionBy("vec_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # seven rows a block
    return rows.select("vec_id", "pos", acc.block_id(F.col("pos"), F.col("label"), 511).alias("id"), r6(weight).alias("weight"), r6(F.sum(F.abs("x") * weight).over(upto)).alias("weighed"))


@query("""WITH b AS (SELECT conv_id AS blk, count(*) AS ctx FROM conversations GROUP BY 1) SELECT blk, q::INTEGER AS q, sum(((t < ctx AND t >= greatest(ctx - 4, 0)) OR (t >= 16 AND t - 16 <= q))::INT)::BIGINT AS visible FROM b, range(0, 7) x(q), range(0, 23) y(t) GROUP BY ALL""")
def fn31_prefix_mask(spark, d):
    b = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("blk")).agg(F.count("*").alias("ctx"))
    seen = F.size(F.filter(F.sequence(F.lit(0), F.lit(22)), lambda t: ((t < F.col("ctx")) & (t >= F.greatest(F.col("ctx") - 4, F.lit(0)))) | ((t >= 16) & (t - 16 <= F.col("q")))))
    return b.select("blk", "ctx", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("q")).select("blk", "q", seen.cast("long").alias("visible"))


@query(f"WITH {EMB}, a AS (SELECT vec_id, n * 9 AS anchor FROM (SELECT DISTINCT vec_id FROM emb), range(0, 6) t(n)) SELECT a.vec_id, anchor::INTEGER AS anchor, round(sum(x), 6) AS target_sum, count(*) AS n FROM a JOIN emb e ON e.vec_id = a.vec_id AND e.i BETWEEN anchor + 1 AND anchor + 7 GROUP BY ALL")
def fn32_gather_slices(spark, d):
    rows = embeddings(spark, d).select("vec_id", "e", F.explode(F.array(*[F.lit(9 * n) for n in range(6)])).alias("anchor"))
    cut = F.slice("e", F.col("anchor") + 2, F.lit(7))
    return rows.select("vec_id", "anchor", r6(ds.total(cut)).alias("target_sum"), F.size(cut).cast("long").alias("n"))


@query("""SELECT source, sum(n_chars)::BIGINT AS positions, round(sum(n_chars) / (3000 * 3600.0::DOUBLE), 6) AS hours, round(sum(ceil(n_chars / 4096.0::DOUBLE)) * 4096 / (3000 * 3600.0::DOUBLE), 6) AS padded_hours FROM documents GROUP BY source""")
def fn28_cost_model(spark, d):
    """Hours that a source's positions take at 3000 a second, as they are and in whole windows of 4096."""
    docs = read(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("positions"), F.sum(F.ceil(F.col("n_chars") / F.lit(4096.0)) * 4096).alias("padded"))
    return docs.select("source", "positions", r6(acc.hours(F.col("positions"))).alias("hours"), r6(acc.hours(F.col("padded"))).alias("padded_hours"))


_VERIFY = SOFT + f", best AS (SELECT vec_id, arg_max(i, (p, -i)) AS b FROM soft GROUP BY vec_id), dr AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN b ELSE vec_id % 64 END AS draft, b, floor(vec_id / 5) AS rnd, vec_id % 5 AS pos FROM best), m AS (SELECT rnd, min(pos) FILTER (WHERE draft <> b AND pos < 4) AS miss FROM dr GROUP BY rnd HAVING count(*) = 5)"


@query(f"WITH {_VERIFY} SELECT m.rnd::BIGINT AS rnd, coalesce(miss, 4)::INTEGER AS accepted, max(b) FILTER (WHERE pos = coalesce(miss, 4))::INTEGER AS last, miss IS NOT NULL AS corrected FROM m JOIN dr USING (rnd) GROUP BY m.rnd, miss")
def udf03_verify_greedy(spark, d):
    rows = embeddings(spark, d).select("vec_id", ds.argmax(F.col("e")).alias("b"))
    rows = rows.select(F.floor(F.col("vec_id") / 5).alias("rnd"), (F.col("vec_id") % 5).cast("int").alias("pos"), F.when(F.col("vec_id") % 3 == 0, F.col("b")).otherwise((F.col("vec_id") % 64).cast("int")).alias("draft"), "b")
    got = rows.groupBy("rnd").agg(F.array_sort(F.collect_list(F.struct("pos", "draft", "b"))).alias("r")).where(F.size("r") == 5)
    mask = F.transform(F.slice("r", 1, 4), lambda x: x["draft"] == x["b"])
    got = got.withColumn("accepted", acc.prefix_length(mask))
    return got.select("rnd", "accepted", F.get("r", F.col("accepted"))["b"].alias("last"), (F.col("accepted") < 4).alias("corrected"))
