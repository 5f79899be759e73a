"""Statistics queries: tests, resampling, divergences, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import designs as dg
from ..operators import distributions as ds
from ..operators import stats as st
from ..operators.curate import running
from ..session import broadcast
from .base import EMB, ROUNDS, embeddings, query, r6, read, rounds

_ARMS = "arms AS (SELECT c_custkey AS id, c_acctbal AS v, c_nationkey < 12 AS arm FROM customer)"


def _arms(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), (F.col("c_nationkey") < 12).alias("arm"))


@query(f"WITH {_ARMS} SELECT round(avg(v) FILTER (WHERE arm) - avg(v) FILTER (WHERE NOT arm), 6) AS mean_diff FROM arms")
def sta01_mean_difference(spark, d):
    return st.mean_difference(_arms(spark, d), "v", F.col("arm")).select(r6(F.col("mean_diff")).alias("mean_diff"))


@query("WITH m AS (SELECT value AS v FROM events UNION ALL SELECT NULL UNION ALL SELECT 'nan'::DOUBLE UNION ALL SELECT 'inf'::DOUBLE) SELECT count(*) AS n, round(avg(v), 6) AS mean FROM m WHERE v IS NOT NULL AND isfinite(v)")
def flt11_finite_values(spark, d):
    bad = spark.range(3).select(F.when(F.col("id") == 1, float("nan")).when(F.col("id") == 2, float("inf")).alias("v"))
    rows = read(spark, d, "events").select(F.col("value").alias("v")).union(bad)
    return rows.where(st.finite(F.col("v"))).agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"))


_KS = "c AS (SELECT lang, n_chars AS x, sum((doc_id % 2 = 0)::INT) AS a, sum((doc_id % 2 = 1)::INT) AS b FROM documents GROUP BY ALL), f AS (SELECT lang, x, sum(a) OVER (PARTITION BY lang ORDER BY x)::DOUBLE / sum(a) OVER (PARTITION BY lang) AS fa, sum(b) OVER (PARTITION BY lang ORDER BY x)::DOUBLE / sum(b) OVER (PARTITION BY lang) AS fb FROM c)"


@query(f"WITH {_KS} SELECT lang, round(max(abs(fa - fb)), 6) AS d FROM f GROUP BY lang")
def sta02_ks_by_lang(spark, d):
    docs = read(spark, d, "documents").withColumn("x", F.col("n_chars").cast("double"))
    return st.ks(docs, "x", F.col("doc_id") % 2 == 0, ["lang"]).select("lang", r6(F.col("d")).alias("d"))


@query("WITH c AS (SELECT n_chars AS x, count(*) AS n FROM documents GROUP BY 1) SELECT x, round(sum(n) OVER (ORDER BY x)::DOUBLE / sum(n) OVER (), 6) AS f FROM c")
def win08_ecdf(spark, d):
    c = read(spark, d, "documents").groupBy(F.col("n_chars").alias("x")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return running(c, [], "x", "n", "upto", through=True).crossJoin(F.broadcast(total)).select("x", r6(F.col("upto") / F.col("total")).alias("f"))


@query("WITH r AS (SELECT doc_id, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM documents) SELECT doc_id, rk::DOUBLE AS avg_rank FROM r")
def win07_average_rank(spark, d):
    docs = read(spark, d, "documents")
    c = docs.groupBy("n_chars").agg(F.count("*").alias("n"))
    ranks = running(c, [], "n_chars", "n", "before").select("n_chars", (F.col("before") + (F.col("n") + 1) / 2.0).cast("double").alias("avg_rank"))
    return docs.join(ranks, "n_chars").select("doc_id", "avg_rank")


_AUC = "j AS (SELECT d.source, l.toxic AS y, d.n_chars AS s FROM documents d JOIN labels l USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0 AS rk FROM j), g AS (SELECT source, count(*) AS n, sum(y) AS n1, sum(rk * y) AS rs FROM r GROUP BY source)"


@query(f"WITH {_AUC} SELECT source, n, round((rs - n1 * (n1 + 1) / 2.0) / nullif(n1 * (n - n1), 0), 6)::DOUBLE AS auc FROM g")
def sta09_auc_by_source(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("source", "toxic", "n_chars")
    return st.auroc(rows, "toxic", "n_chars", ["source"]).select("source", "n", r6(F.col("auc")).alias("auc"))


@query(f"WITH {_AUC} SELECT source, coalesce((rs - n1 * (n1 + 1) / 2.0) / nullif(n1 * (n - n1), 0) >= 0.5 AND n1 > 2, false) AS qualified FROM g")
def flt08_qualification(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("source", "toxic", "n_chars")
    auc = st.auroc(rows, "toxic", "n_chars", ["source"])
    n1 = rows.groupBy("source").agg(F.sum("toxic").alias("n1"))
    return auc.join(n1, "source").select("source", F.coalesce((F.col("auc") >= 0.5) & (F.col("n1") > 2), F.lit(False)).alias("qualified"))


@query("WITH p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE pow((s_suppkey * 7919 % 1000 + 1) / 1000.0, 3)::DOUBLE END AS p FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rk, count(p) OVER () AS n FROM p WHERE p IS NOT NULL), c AS (SELECT max(rk) AS last FROM r WHERE p <= rk::DOUBLE / n * 0.05) SELECT p.id, coalesce(r.rk <= c.last, false) AS rejected FROM p LEFT JOIN r USING (id), c")
def sta06_benjamini_hochberg(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    p = F.pow((F.col("id") * 7919 % 1000 + 1) / 1000.0, F.lit(3.0))
    return st.benjamini_hochberg(s.withColumn("p", F.when(F.col("id") % 11 != 0, p)), "p", "id").select("id", "rejected")


@query("""WITH t AS (SELECT source, sum((toxic = 1 AND doc_id % 2 = 0)::INT) AS a, sum((toxic = 0 AND doc_id % 2 = 0)::INT) AS b, sum((toxic = 1 AND doc_id % 2 = 1)::INT) AS c, sum((toxic = 0 AND doc_id % 2 = 1)::INT) AS d FROM documents JOIN labels USING (doc_id) GROUP BY source), lf AS (SELECT i AS n, sum(ln(greatest(i, 1))) OVER (ORDER BY i) AS l FROM range(0, 20000) r(i)), x AS (SELECT t.*, unnest(range(greatest(0, a + c - (c + d))::BIGINT, (least(a + c, a + b) + 1)::BIGINT)) AS x FROM t), pm AS (SELECT x.*, exp(k.l - fx.l - kx.l + rk.l - n1x.l - rest.l - n.l + n1.l + n2.l) AS px FROM x JOIN lf k ON k.n = a + c JOIN lf fx ON fx.n = x JOIN lf kx ON kx.n = a + c - x JOIN lf rk ON rk.n = b + d JOIN lf n1x ON n1x.n = a + b - x JOIN lf rest ON rest.n = b + d - (a + b - x) JOIN lf n ON n.n = a + b + c + d JOIN lf n1 ON n1.n = a + b JOIN lf n2 ON n2.n = c + d), o AS (SELECT source, max(px) FILTER (WHERE x = a) AS po FROM pm GROUP BY source) SELECT t.source, round(CASE WHEN a + b = 0 OR c + d = 0 THEN 1 ELSE least(1, (SELECT sum(px) FROM pm JOIN o USING (source) WHERE pm.source = t.source AND px <= po * (1 + 1e-9) + 1e-15)) END, 6) AS pvalue FROM t""")
def sta05_fisher_exact(spark, d):
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    n = lambda t, o: F.sum(((F.col("toxic") == t) & (F.col("doc_id") % 2 == o)).cast("int"))
    t = j.groupBy("source").agg(n(1, 0).alias("a"), n(0, 0).alias("b"), n(1, 1).alias("c"), n(0, 1).alias("d"))
    return st.fisher(t, "a", "b", "c", "d").select("source", r6(F.col("pvalue")).alias("pvalue"))


def _mixed(x: str, out: str) -> str:
    """Select items that scatter the 32-bit number ``x`` into ``out``; later items use earlier ones."""
    a, b = f"{out}_a", f"{out}_b"
    return f"(xor({x}, {x} >> 16) * 73244475) & 4294967295 AS {a}, (xor({a}, {a} >> 16) * 73244475) & 4294967295 AS {b}, xor({b}, {b} >> 16) AS {out}"


def _replicates(n: int, seed: int) -> str:
    return f"rs AS (SELECT rep, (rep * 2654435761 + {seed}) & 4294967295 AS r0, {_mixed('r0', 'hr')} FROM range(0, {n}) t(rep))"


_POISSON = " + ".join(f"(u >= {t})::INT" for t in st.POISSON)
_BOOT = f"{_ARMS}, ks AS (SELECT arm, v, id & 4294967295 AS k0, {_mixed('k0', 'hk')} FROM arms), {_replicates(1000, 11)}, w AS (SELECT arm, rep, v, xor(hk, hr) AS u0, {_mixed('u0', 'u')}, {_POISSON} AS w FROM ks, rs), mn AS (SELECT rep, arm, sum(w * v) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL), df AS (SELECT rep, max(m) FILTER (WHERE arm) - max(m) FILTER (WHERE NOT arm) AS diff FROM mn GROUP BY rep), ci AS (SELECT quantile_cont(diff, 0.05) AS lo, quantile_cont(diff, 0.95) AS hi FROM df)"


@query(f"WITH {_BOOT} SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM ci")
def sta03_bootstrap_interval(spark, d):
    b = st.bootstrap_means(_arms(spark, d), "v", F.col("arm"), "id", 1000, 11)
    return st.interval(b, 0.10).select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@query(f"WITH {_BOOT}, p AS (SELECT avg(v) FILTER (WHERE arm) - avg(v) FILTER (WHERE NOT arm) AS point FROM arms) SELECT round(point, 6) AS point, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi, lo >= -500 AND hi <= 500 AS equivalent FROM p, ci")
def sta04_tost(spark, d):
    out = st.tost(_arms(spark, d), "v", F.col("arm"), "id", 500.0, 1000, 11)
    return out.select(*[r6(F.col(c)).alias(c) for c in ("point", "ci_lo", "ci_hi")], "equivalent")


@query(f"WITH s AS (SELECT n_regionkey AS g, sum(n_nationkey)::DOUBLE AS s, count(*) AS n, row_number() OVER (ORDER BY n_regionkey) - 1 AS i FROM nation GROUP BY n_regionkey), js AS (SELECT j AS j0, {_mixed('j', 'hk')} FROM range(0, 5) q(j)), {_replicates(500, 5)}, dr AS (SELECT rep, xor(hk, hr) AS u0, {_mixed('u0', 'u')}, u % 5 AS i FROM js, rs), m AS (SELECT rep, sum(s.s) / sum(s.n) AS m FROM dr JOIN s USING (i) GROUP BY rep) SELECT round((SELECT sum(s) / sum(n) FROM s), 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, count(*) AS replicates FROM m")
def sta10_cluster_bootstrap(spark, d):
    n = read(spark, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").cast("double").alias("v"))
    out = st.cluster_bootstrap(n, "v", "g", 500, 5)
    return out.select(*[r6(F.col(c)).alias(c) for c in ("estimate", "lo", "hi")], "replicates")


_TOKS = "tk AS (SELECT event_id, user_id % 2 AS half, lag(event_type, 1, 'start') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_type AS tok FROM events)"


def _tokens(spark, d):
    e = read(spark, d, "events")
    prev = F.lag("event_type", 1, "start").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", (F.col("user_id") % 2).alias("half"), prev.alias("prev"), F.col("event_type").alias("tok"))


@query(f"WITH {_TOKS}, g AS (SELECT DISTINCT tok FROM tk), n AS (SELECT tok, count(*) AS n FROM tk GROUP BY tok) SELECT tok, n, round((n + 1.0) / (sum(n) OVER () + (SELECT count(*) FROM g)), 6)::DOUBLE AS p FROM n")
def agg23_smoothed_unigrams(spark, d):
    n = _tokens(spark, d).groupBy("tok").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    return n.select("tok", "n", r6((F.col("n") + 1.0) / (F.sum("n").over(w) + F.count("*").over(w))).alias("p"))


@query(f"WITH {_TOKS} SELECT prev, tok, count(*) AS n FROM tk GROUP BY ALL")
def win09_bigrams_with_start(spark, d):
    return _tokens(spark, d).groupBy("prev", "tok").agg(F.count("*").alias("n"))


@query(f"WITH {_TOKS}, p AS (SELECT tok, count(*) AS n FROM tk WHERE half = 0 GROUP BY tok), q AS (SELECT tok, count(*) AS n FROM tk WHERE half = 1 GROUP BY tok), j AS (SELECT coalesce(p.n, 0) + 1.0::DOUBLE AS a, coalesce(q.n, 0) + 1.0::DOUBLE AS b FROM p FULL JOIN q USING (tok)), x AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM j) SELECT round(sum(p * log2(p / q)), 6) AS kl, round(0.5 * sum(abs(p - q)), 6) AS tvd FROM x")
def sta08_kl_tvd(spark, d):
    t = _tokens(spark, d)
    a, b = (t.where(F.col("half") == h).groupBy("tok").agg(F.count("*").alias("n")) for h in (0, 1))
    return st.divergences(a, b, ["tok"]).select(r6(F.col("kl")).alias("kl"), r6(F.col("tvd")).alias("tvd"))


_SYMS = ["click", "error", "purchase", "signup", "view"]


@query(f"WITH {_TOKS}, g AS (SELECT a AS prev, b AS tok FROM unnest({_SYMS}) x(a), unnest({_SYMS}) y(b)), p AS (SELECT prev, tok, count(*) AS n FROM tk WHERE half = 0 GROUP BY ALL), q AS (SELECT prev, tok, count(*) AS n FROM tk WHERE half = 1 GROUP BY ALL), j AS (SELECT g.prev, coalesce(p.n, 0) + 1.0::DOUBLE AS a, coalesce(q.n, 0) + 1.0::DOUBLE AS b FROM g LEFT JOIN p USING (prev, tok) LEFT JOIN q USING (prev, tok)), x AS (SELECT a / sum(a) OVER (PARTITION BY prev) AS p, b / sum(b) OVER (PARTITION BY prev) AS q, sum(b) OVER (PARTITION BY prev) / sum(b) OVER () AS w FROM j) SELECT round(sum(w * p * log2(p / q)), 6) AS cond_kl FROM x")
def sta08_conditional_kl(spark, d):
    t = _tokens(spark, d)
    a, b = (t.where(F.col("half") == h).groupBy("prev", "tok").agg(F.count("*").alias("n")) for h in (0, 1))
    return st.conditional_divergence(a, b, "prev", "tok", _SYMS).select(r6(F.col("cond_kl")).alias("cond_kl"))


_STORED = f"{EMB}, sc AS (SELECT vec_id, greatest(max(abs(x)), 1e-8) AS s FROM emb GROUP BY vec_id), st AS (SELECT vec_id, label, i, x, greatest(least(round_even(x / s * 127.0::DOUBLE, 0), 127), -127) * (s / 127.0::DOUBLE) AS y FROM emb JOIN sc USING (vec_id)), t4 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rx, row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, i) AS ry FROM st), pq AS (SELECT vec_id, label, x, y, CASE WHEN rx <= 4 THEN exp(x) ELSE 0 END / sum(CASE WHEN rx <= 4 THEN exp(x) ELSE 0 END) OVER w AS q, CASE WHEN ry <= 4 THEN exp(y) ELSE 0 END / sum(CASE WHEN ry <= 4 THEN exp(y) ELSE 0 END) OVER w AS p FROM t4 WINDOW w AS (PARTITION BY vec_id)), l AS (SELECT vec_id, label, sum(abs(p - q)) AS l1, max(abs(y - x)) AS gap, max(abs(x)) AS most FROM pq GROUP BY vec_id, label), m AS (SELECT label, avg(l1) AS l1_mean, avg((l1 > 1e-2)::INT) AS l1_frac, max(gap) / greatest(max(most), 1e-6) AS rel_max FROM l GROUP BY label)"


@query(f"WITH {_STORED} SELECT label, round(l1_mean, 6) AS l1_mean, round(l1_frac, 6) AS l1_frac, round(rel_max, 6) AS rel_max, l1_mean <= 5e-3 AS mean_ok, l1_frac <= 0.09 AS frac_ok, rel_max <= 4e-3 AS rel_ok, l1_mean <= 5e-3 AND l1_frac <= 0.09 AND rel_max <= 4e-3 AS passed FROM m")
def sta15_parity_gate(spark, d):
    """Vectors as they are stored, in eight bits, against themselves: what that does to their distributions of the best four."""
    q, scale = ds.quantised(F.col("e"))
    rows = embeddings(spark, d).select("label", "e", q.alias("q"), scale.alias("s")).select("label", "e", ds.dequantised(F.col("q"), F.col("s")).alias("h"))
    rows = rows.select("label", "e", "h", *[ds.transformed(F.col(c), 1.0, 4).alias(n) for c, n in (("h", "p"), ("e", "t"))])
    m = st.parity(rows, ["label"], "p", "t", "h", "e")
    out = st.gate(m, {"mean_ok": F.col("l1_mean") <= 5e-3, "frac_ok": F.col("l1_frac") <= 0.09, "rel_ok": F.col("rel_max") <= 4e-3}, ["label", "l1_mean", "l1_frac", "rel_max"])
    return out.withColumns({c: r6(F.col(c)) for c in ("l1_mean", "l1_frac", "rel_max")})


@query("WITH c AS (SELECT user_id AS run, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), m AS (SELECT run, avg(loss) FILTER (WHERE n >= 40 AND i < 20) AS first, avg(loss) FILTER (WHERE n >= 40 AND i >= n - 20) AS last FROM c GROUP BY run) SELECT run, round(first, 6) AS first, round(last, 6) AS last, last < first AS dropped FROM m")
def sta15_training_sanity(spark, d):
    """Whether a run's losses fell: means of its first and last twenty steps, where it has forty."""
    curve = read(spark, d, "events").select(F.col("user_id").alias("run"), "event_id", F.col("value").alias("loss"))
    return st.training_sanity(curve, ["run"], "event_id", "loss").withColumns({c: r6(F.col(c)) for c in ("first", "last")})


@query(f"WITH {ROUNDS}, r AS (SELECT run, avg(k) AS mk FROM rounds GROUP BY run) SELECT median(mk) >= 5.5 AS median_ok, min(mk) > 3 AS all_ok, median(mk) >= 5.5 AND min(mk) > 3 AS passed FROM r")
def sta12_pilot_gate(spark, d):
    r = rounds(spark, d).groupBy("run").agg(F.avg("k").alias("mk")).agg(F.percentile("mk", F.lit(0.5)).alias("med"), F.min("mk").alias("low"))
    return st.gate(r, {"median_ok": F.col("med") >= 5.5, "all_ok": F.col("low") > 3})


@query("""WITH e AS (SELECT label, avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE))) AS got, avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE))) + CASE WHEN label % 2 = 0 THEN 0.5 ELSE 0 END AS want FROM embeddings GROUP BY label) SELECT label FROM e WHERE NOT abs(got - want) <= 1e-9""")
def sta14_recompute(spark, d):
    e = embeddings(spark, d).select("label", F.aggregate("e", F.lit(0.0), lambda s, x: s + x).alias("t")).groupBy("label").agg(F.avg("t").alias("got"))
    return st.recompute_violations(e.withColumn("want", F.col("got") + F.when(F.col("label") % 2 == 0, 0.5).otherwise(0.0)), "got", "want", 1e-9).select("label")


_FOUR = f"{EMB}, f AS (SELECT vec_id, label, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM emb WHERE i < 4), g AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM f), en AS (SELECT vec_id, label, -sum(greatest(least(p, 1), 1e-12) * log2(greatest(least(p, 1), 1e-12))) AS v FROM g GROUP BY vec_id, label), fa AS (SELECT label, count(*) AS n, avg(v) AS mean, median(v) AS median, avg((v < 1.5)::INT) AS low, avg((v > 1.9)::INT) AS high FROM en GROUP BY label), an AS (SELECT label, avg(v) AS a_mean, avg((v < 1.5)::INT) AS a_low FROM en WHERE vec_id % 3 = 0 AND label % 4 <> 0 GROUP BY label)"


@query(f"WITH {_FOUR} SELECT label, n, round(mean, 6) AS mean, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN a_mean IS NULL THEN mean >= 1.82 ELSE abs(mean - a_mean) <= 0.01 AND abs(low - a_low) <= 0.05 END AS passed FROM fa LEFT JOIN an USING (label)")
def sta16_qc_probe(spark, d):
    """Entropies of four symbols by label against anchors from every third vector; every fourth label has none."""
    rows = embeddings(spark, d).select("vec_id", "label", ds.entropy_bits(ds.softmax(F.slice("e", 1, 4))).alias("v"))
    anchors = rows.where("vec_id % 3 = 0 AND label % 4 <> 0").groupBy("label").agg(F.avg("v").alias("mean"), F.avg((F.col("v") < 1.5).cast("int")).alias("low"))
    out = st.qc_probe(rows, "label", "v", anchors, 0.01, 0.05, 1.82)
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "median", "low", "high")})


@query("""WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), j AS (SELECT 'layer' || (x.vec_id % 6) || '/' || (x.i % 4) AS path, abs(x.v - y.v) AS gap, abs(y.v) AS most FROM a x JOIN a y ON y.vec_id = x.vec_id + 1 AND y.i = x.i WHERE x.vec_id % 2 = 0) SELECT path, round(max(gap), 6) AS max_abs, round(max(gap) / greatest(max(most), 1e-12), 6) AS max_rel FROM j GROUP BY path""")
def sta17_state_diff(spark, d):
    """Two states, tensor by tensor: even vectors are one, the vectors after them the other."""
    e = embeddings(spark, d)
    pairs = e.where("vec_id % 2 = 0").select("vec_id").join(e.select((F.col("vec_id") - 1).alias("vec_id")), "vec_id", "left_semi")

    def state(odd):
        rows = e.select((F.col("vec_id") - odd).alias("vec_id"), "e").join(pairs, "vec_id").select("vec_id", F.posexplode("e").alias("pos", "v"))
        path = F.concat(F.lit("layer"), (F.col("vec_id") % 6).cast("string"), F.lit("/"), ((F.col("pos") + 1) % 4).cast("string"))
        return rows.select(path.alias("path"), (F.col("vec_id") * 1000 + F.col("pos")).alias("i"), "v")

    return dg.state_difference(state(0), state(1)).withColumns({c: r6(F.col(c)) for c in ("max_abs", "max_rel")})


_CAT = "u AS (SELECT doc_id AS id, (doc_id * 2654435761 % 4294967296 * 69069 % 4294967296) / 4294967296.0::DOUBLE AS u FROM documents), p AS (SELECT source, count(*) AS n FROM documents GROUP BY source), c AS (SELECT source, sum(n) OVER (ORDER BY source)::DOUBLE / sum(n) OVER () AS hi, (sum(n) OVER (ORDER BY source) - n)::DOUBLE / sum(n) OVER () AS lo FROM p)"


@query(f"WITH {_CAT} SELECT id, source FROM u JOIN c ON u >= lo AND u < hi")
def smp10_categorical_draws(spark, d):
    docs = read(spark, d, "documents")
    p = docs.groupBy("source").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    run = F.sum("n").over(w.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    c = p.select("source", (run / F.sum("n").over(w)).alias("hi"), ((run - F.col("n")) / F.sum("n").over(w)).alias("lo"))
    u = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") * 2654435761 % 4294967296 * 69069 % 4294967296 / 4294967296.0).alias("u"))
    return u.join(broadcast(c), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("id", "source")


@query(None)
def udf07_bootstrap_statistic(spark, d):
    """A statistic of the user's over resampled rows, all of them: the median's interval by source."""
    docs = read(spark, d, "documents").select("source", "n_chars")
    return st.bootstrap_statistic(docs, "source", "n_chars", st.weighted_median, 200, 7)


