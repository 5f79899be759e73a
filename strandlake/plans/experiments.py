"""Experiment queries: pairing, summaries, budgets, beams, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import designs as dg
from ..session import new_folder
from .base import DNA, dna, query, r6, read

_BASE = "runs AS (SELECT (o_orderkey // 2) % 4 AS pattern, (o_orderkey // 8) % 30 AS seed, CASE WHEN o_orderkey % 2 = 0 THEN 'native' ELSE 'treated' END AS arm, sum(o_totalprice) AS total_s, avg((o_orderstatus = 'F')::INT) AS auc, count(*) AS n FROM orders GROUP BY 1, 2, 3)"


def _runs(spark, d):
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select((F.floor(k / 2) % 4).alias("pattern"), (F.floor(k / 8) % 30).alias("seed"), F.when(k % 2 == 0, "native").otherwise("treated").alias("arm"), "o_totalprice", "o_orderstatus")
    auc = F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("auc")  # a share of 0 to 1 stands for a run's AUC
    return rows.groupBy("pattern", "seed", "arm").agg(F.sum("o_totalprice").alias("total_s"), auc, F.count("*").alias("n"))


@query(f"WITH {_BASE}, a AS (SELECT * FROM runs WHERE arm = 'native'), b AS (SELECT * FROM runs WHERE arm = 'treated') SELECT coalesce(a.pattern, b.pattern) AS pattern, coalesce(a.seed, b.seed) AS seed, round(a.total_s / b.total_s, 6) AS ratio, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'missing' END AS problem FROM a FULL JOIN b ON a.pattern = b.pattern AND a.seed = b.seed")
def join01_paired_runs(spark, d):
    p = dg.pair(_runs(spark, d), ["pattern", "seed"], "arm", "native", "treated")
    return p.select("pattern", "seed", r6(F.col("native.total_s") / F.col("treated.total_s")).alias("ratio"), "problem")


@query(f"WITH {_BASE}, p AS (SELECT a.pattern, a.total_s / b.total_s AS r, a.auc AS x, b.auc AS y FROM runs a JOIN runs b ON a.pattern = b.pattern AND a.seed = b.seed AND a.arm = 'native' AND b.arm = 'treated') SELECT pattern, count(*) AS n_pairs, round(exp(avg(ln(r))), 6) AS geometric_mean, round(median(r), 6) AS median, round(avg(x), 6) AS native_auc, round(avg(y), 6) AS treated_auc FROM p GROUP BY pattern")
def agg19_by_pattern(spark, d):
    p = dg.pair(_runs(spark, d), ["pattern", "seed"], "arm", "native", "treated").where("problem IS NULL")
    p = p.select("pattern", *[F.col(f"{arm}.{c}").alias(f"{arm}_{c}") for arm in ("native", "treated") for c in ("total_s", "auc")])
    out = dg.ratios(p, ["pattern"], "native_total_s", "treated_total_s", ["native_auc", "treated_auc"])
    return out.select("pattern", "n_pairs", *[r6(F.col(c)).alias(c) for c in ("geometric_mean", "median", "native_auc", "treated_auc")])


@query(f"WITH {_BASE}, p AS (SELECT a.total_s AS x, b.total_s AS y FROM runs a JOIN runs b ON a.pattern = b.pattern AND a.seed = b.seed AND a.arm = 'native' AND b.arm = 'treated') SELECT count(*) AS n_pairs, round(median(x / y), 6) AS median_speedup, round(min(x / y), 6) AS low, round(max(x / y), 6) AS high, round(100 * sum(y) / sum(x), 6) AS share FROM p")
def agg21_case_metrics(spark, d):
    p = dg.pair(_runs(spark, d), ["pattern", "seed"], "arm", "native", "treated").where("problem IS NULL")
    x, y = F.col("native.total_s"), F.col("treated.total_s")
    return p.agg(F.count("*").alias("n_pairs"), r6(F.percentile(x / y, F.lit(0.5))).alias("median_speedup"), r6(F.min(x / y)).alias("low"), r6(F.max(x / y)).alias("high"), r6(100 * F.sum(y) / F.sum(x)).alias("share"))


@query("SELECT l_returnflag AS backend, arg_min(l_linenumber, (s, l_linenumber))::INTEGER AS batch, round(min(s), 6) AS total_s FROM (SELECT l_returnflag, l_linenumber, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL) WHERE l_linenumber <= 4 GROUP BY 1")
def agg20_best_batch(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("backend"), F.col("l_linenumber").alias("batch")).agg(F.sum("l_extendedprice").alias("total_s"))
    return dg.best_batches(rows, "backend", "batch", "total_s", F.col("batch") <= 4).withColumn("total_s", r6(F.col("total_s")))


@query("SELECT 'l_linestatus' AS field, count(DISTINCT l_linestatus) AS n FROM lineitem HAVING count(DISTINCT l_linestatus) <> 1 UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem HAVING count(DISTINCT l_returnflag) <> 1")
def agg20_uniform_fields(spark, d):
    rows = read(spark, d, "lineitem").withColumn("fixed", F.lit(1))
    return dg.uniform_violations(rows, ["fixed", "l_linestatus", "l_returnflag"])


@query("WITH m AS (SELECT l_returnflag AS arm, l_orderkey AS run, CASE l_linenumber WHEN 1 THEN 'draft' WHEN 2 THEN 'verify' WHEN 3 THEN 'score' ELSE 'other' END AS name, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), n AS (SELECT arm, count(DISTINCT run) AS n FROM m GROUP BY arm) SELECT m.arm, name, round(sum(v) / max(n), 6) AS mean FROM m JOIN n USING (arm) GROUP BY ALL")
def agg18_stage_means(spark, d):
    n = F.col("l_linenumber")
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_orderkey").alias("run"), F.when(n == 1, "draft").when(n == 2, "verify").when(n == 3, "score").otherwise("other").alias("name"), "l_quantity")
    rows = rows.groupBy("arm", "run", "name").agg(F.sum("l_quantity").alias("v")).groupBy("arm", "run").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("stages_s"))
    return dg.map_means(rows, ["arm"], "stages_s").withColumn("mean", r6(F.col("mean")))


@query("WITH r AS (SELECT l_returnflag AS arm, l_orderkey AS run, max(CASE WHEN l_tax > 0.02 THEN l_extendedprice END) AS peak_bytes, max(CASE WHEN l_tax > 5 THEN l_tax END) AS peak_scorer_bytes, CASE WHEN l_returnflag = 'N' AND l_orderkey % 97 = 3 THEN NULL ELSE sum(l_quantity) END AS gpu_seconds FROM lineitem GROUP BY 1, 2) SELECT arm, max(peak_bytes) AS peak_bytes, max(peak_scorer_bytes) AS peak_scorer_bytes, CASE WHEN count(gpu_seconds) = count(*) THEN sum(gpu_seconds) END AS gpu_seconds FROM r GROUP BY arm")
def agg18_arm_totals(spark, d):
    """Largest memory of an arm's runs, and their GPU seconds where all runs have them."""
    rows = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_orderkey").alias("run"))
    rows = rows.agg(F.max(F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice"))).alias("peak_bytes"), F.max(F.when(F.col("l_tax") > 5, F.col("l_tax"))).alias("peak_scorer_bytes"), F.sum("l_quantity").alias("q"))
    rows = rows.withColumn("gpu_seconds", F.when((F.col("arm") != "N") | (F.col("run") % 97 != 3), F.col("q")))
    return dg.arm_totals(rows, ["arm"], ["peak_bytes", "peak_scorer_bytes"], ["gpu_seconds"])


@query("SELECT user_id % 20 AS run, round(median(value), 6) AS median_s, round(quantile_cont(value, 0.9), 6) AS p90_s FROM events GROUP BY 1")
def agg27_stage_medians(spark, d):
    e = read(spark, d, "events").groupBy((F.col("user_id") % 20).alias("run"))
    return e.agg(r6(F.percentile("value", F.lit(0.5))).alias("median_s"), r6(F.percentile("value", F.lit(0.9))).alias("p90_s"))


_CURVE = "b AS (SELECT o_custkey % 5 AS arm, o_orderkey AS i, o_totalprice AS s, o_orderstatus = 'F' AS q, o_orderpriority AS item FROM orders), c AS (SELECT *, sum(s) OVER (PARTITION BY arm ORDER BY i) AS t, row_number() OVER (PARTITION BY arm, item, q ORDER BY i) = 1 AND q AS nw FROM b), y AS (SELECT arm, t, sum(nw::INT) OVER (PARTITION BY arm ORDER BY i) AS y FROM c), p AS (SELECT arm, t, y FROM y WHERE t <= 2000000 UNION ALL SELECT DISTINCT arm, 0, 0 FROM b)"


@query(f"WITH {_CURVE} SELECT arm, round(t, 2)::DOUBLE AS seconds, y::BIGINT AS qualified_unique FROM p UNION ALL SELECT arm, 2000000.0, max(y)::BIGINT FROM p GROUP BY arm HAVING max(t) < 2000000")
def win05_budget_curve(spark, d):
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 5).alias("arm"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("s"), (F.col("o_orderstatus") == "F").alias("q"), F.col("o_orderpriority").alias("item"))
    return dg.budget_curve(rows, ["arm"], "i", "s", F.col("q"), "item", 2000000.0).withColumn("seconds", F.round("seconds", 2))


#: Asked are the sequences whose id is divisible by 20, each against all sequences of its source and length.
_IDENT = f"{DNA}, h AS (SELECT doc_id, source, length(seq) AS len, regexp_extract_all(seq, '.') AS seq FROM dna WHERE seq <> ''), pairs AS (SELECT a.source, a.doc_id AS a, b.doc_id AS b, list_sum(list_transform(list_zip(a.seq, b.seq), lambda p: (p[1] = p[2])::INT)) / a.len::DOUBLE AS identity FROM h a JOIN h b ON a.source = b.source AND a.len = b.len WHERE a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id AND NOT (b.doc_id % 20 = 0 AND b.doc_id < a.doc_id))"


@query(f"WITH {_IDENT} SELECT source, a, b, round(identity, 6) AS identity FROM pairs")
def join06_pairwise_identity(spark, d):
    h = dna(spark, d).select("doc_id", "source", "seq")
    return dg.identities(h, "doc_id", "seq", ["source"], F.col("doc_id") % 20 == 0).withColumn("identity", r6(F.col("identity")))


_ALL_PAIRS = f"{DNA}, h AS (SELECT doc_id, source, length(seq) AS len, regexp_extract_all(seq, '.') AS seq FROM dna WHERE seq <> ''), pairs AS (SELECT a.source, list_sum(list_transform(list_zip(a.seq, b.seq), lambda p: (p[1] = p[2])::INT)) / a.len::DOUBLE AS identity FROM h a JOIN h b ON a.source = b.source AND a.len = b.len AND a.doc_id < b.doc_id)"


@query(f"WITH {_ALL_PAIRS}, m AS (SELECT source, substr(seq, i, 4) AS k, count(*) AS n FROM dna, unnest(range(1, length(seq) - 2)) t(i) GROUP BY ALL), e AS (SELECT source, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS ent FROM m GROUP BY source), u AS (SELECT source, count(DISTINCT seq) AS exact_unique FROM dna GROUP BY source), p AS (SELECT source, count(*) AS pairs, avg(identity) AS identity FROM pairs GROUP BY source) SELECT source, exact_unique, round(ent, 6) AS fourmer_entropy_bits, coalesce(pairs, 0)::BIGINT AS pairs, round(identity, 6) AS mean_identity FROM u JOIN e USING (source) LEFT JOIN p USING (source)")
def sta11_diversity(spark, d):
    """Different sequences, entropy of 4-mers and the mean identity of all pairs of one length, by source."""
    from ..operators.kmers import entropy

    s = dna(spark, d)
    u = s.select("source", F.sha2("seq", 256).alias("h")).groupBy("source").agg(F.count_distinct("h").alias("exact_unique"))
    rows = u.join(entropy(s, 4, ["source"]), "source").join(dg.mean_identity(s, "source"), "source", "left")
    pairs = F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs")
    return rows.select("source", "exact_unique", r6(F.col("entropy")).alias("fourmer_entropy_bits"), pairs, r6(F.col("identity")).alias("mean_identity"))


@query("SELECT pattern, round_, idx, rank::INTEGER AS rank FROM (SELECT l_suppkey AS pattern, l_linenumber AS round_, l_orderkey AS idx, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY loss, l_orderkey) AS rank FROM (SELECT l_suppkey, l_linenumber, l_orderkey, min(CASE WHEN l_quantity > 2 THEN l_extendedprice END) AS loss FROM lineitem GROUP BY ALL) WHERE loss IS NOT NULL) WHERE rank <= 2")
def top01_beam_top2(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("pattern"), F.col("l_linenumber").alias("round_"), F.col("l_orderkey").alias("idx"))
    rows = rows.agg(F.min(F.when(F.col("l_quantity") > 2, F.col("l_extendedprice"))).alias("loss"))
    return dg.top_candidates(rows, ["pattern", "round_"], "loss", "idx").select("pattern", "round_", "idx", "rank")


@query("SELECT row_number() OVER (ORDER BY pattern, seed) - 1 AS ord, pattern, seed, n FROM (SELECT o_orderpriority AS pattern, o_custkey % 3 AS seed, count(*) AS n FROM orders GROUP BY ALL)")
def top09_experiment_order(spark, d):
    """Pattern by pattern, seed by seed: the place of each experiment in the fixed order."""
    rows = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("pattern"), (F.col("o_custkey") % 3).alias("seed")).agg(F.count("*").alias("n"))
    order = Window.orderBy("pattern", "seed")  # patterns x seeds rows
    return rows.select((F.row_number().over(order) - 1).cast("long").alias("ord"), "pattern", "seed", "n")


_CHAIN = "n AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, coalesce(text, '') AS s FROM conversations)"


@query(f"WITH RECURSIVE {_CHAIN}, w(id, depth, path) AS (SELECT id, 0, s FROM n WHERE parent IS NULL UNION ALL SELECT n.id, depth + 1, path || n.s FROM n JOIN w ON n.parent = w.id) SELECT id::BIGINT AS id, depth::INTEGER AS depth, md5(path) AS path FROM w")
def join09_parent_chains(spark, d):
    """All turns with the digest of all texts from the first turn on."""
    c = read(spark, d, "conversations")
    nodes = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"), F.coalesce("text", F.lit("")).alias("s"))
    return dg.chain_digests(nodes, "id", "parent", "s").select(F.col("node").alias("id"), "depth", F.col("digest").alias("path"))


@query("SELECT doc_id, sha256(text) AS want, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS got FROM documents WHERE doc_id % 10 = 0")
def join10_hash_verification(spark, d):
    docs = read(spark, d, "documents")
    a = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    b = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return dg.changed(a, b, "doc_id", "h").select("doc_id", "want", "got")


_ROUNDS, _WIDTH = 4, 2


def _candidates() -> str:
    """SQL over cand: all candidates of the search below, round by round."""
    seq = f"it AS (SELECT item_id AS design, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '{('ACGT' * 7)[:26] * 2}') AS seq FROM benchmark)"
    parts = [seq, "k0 AS (SELECT design, 0 AS idx, '' AS state, '' AS chain FROM it)"]
    for r in range(_ROUNDS):
        parts.append(f"e{r} AS (SELECT design, {r} AS round, idx * 4 + b AS idx, idx AS parent, 'ACGT'[b + 1] AS suffix, state || 'ACGT'[b + 1] AS state, sha256(chain || 'ACGT'[b + 1]) AS chain FROM k{r}, range(0, 4) x(b))")
        parts.append(f"s{r} AS (SELECT e.*, ('0x' || left(md5(design || '|' || round || '|' || idx), 15))::BIGINT AS seed, CASE WHEN regexp_matches(state, 'AAA|CCC|GGG|TTT') THEN NULL ELSE 1 - (length(seq) - length(replace(seq, state, ''))) / length(seq)::DOUBLE END AS loss FROM e{r} e JOIN it USING (design))")
        parts.append(f"t{r} AS (SELECT *, row_number() OVER (PARTITION BY design ORDER BY loss NULLS LAST, idx) AS best FROM s{r})")
        parts.append(f"c{r} AS (SELECT * EXCLUDE best, CASE WHEN loss IS NOT NULL AND best <= {_WIDTH} THEN best END::INTEGER AS rank FROM t{r})")
        parts.append(f"k{r + 1} AS (SELECT design, idx, state, chain FROM c{r} WHERE rank IS NOT NULL)")
    return ", ".join([*parts, "cand AS (" + " UNION ALL ".join(f"SELECT * FROM c{r}" for r in range(_ROUNDS)) + ")"])


def _items(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("design"), tx.recode_letters(F.col("text")).alias("seq"))


def _seed(design, number, idx):
    return F.conv(F.left(F.md5(F.concat_ws("|", design.cast("string"), number.cast("string"), idx.cast("string"))), F.lit(15)), 16, 10).cast("long")


def _expand(beam, number):
    rows = beam.select("design", F.col("idx").alias("parent"), F.col("state").alias("s"), F.col("chain").alias("c"), F.posexplode(F.array(*map(F.lit, "ACGT"))).alias("b", "suffix"))
    idx = F.col("parent") * 4 + F.col("b")
    return rows.select("design", idx.alias("idx"), "parent", "suffix", F.concat("s", "suffix").alias("state"), F.sha2(F.concat("c", "suffix"), 256).alias("chain"), _seed(F.col("design"), F.lit(number), idx).alias("seed"))


def _loss(state, seq):
    """How little of a sequence a state's occurrences cover; runs of three make a candidate invalid."""
    covered = F.char_length(seq) - F.char_length(F.replace(seq, state))
    return F.when(~F.regexp_like(state, F.lit("AAA|CCC|GGG|TTT")), 1 - covered / F.char_length(seq))


def _search(spark, d, root):
    items = _items(spark, d)

    def score(rows):
        return rows.join(items, "design").withColumn("loss", _loss(F.col("state"), F.col("seq"))).drop("seq")

    start = items.select("design", F.lit(0).alias("idx"), F.lit("").alias("state"), F.lit("").alias("chain"))
    identity = dg.search_identity(items, _expand, _loss, _seed, _ROUNDS, _WIDTH)
    return dg.durable_search(start, _expand, score, _ROUNDS, _WIDTH, root, identity)


@query(f"WITH {_candidates()} SELECT design, round, idx::INTEGER AS idx, parent::INTEGER AS parent, suffix, state, chain, seed, round(loss, 9) AS loss, rank FROM cand")
def st09_durable_search(spark, d):
    """Every candidate of a four-round search over all items: parents, seeds, digest chains, losses and the two that were kept."""
    rows = _search(spark, d, new_folder(spark, "search"))
    return rows.select("design", "round", "idx", "parent", "suffix", "state", "chain", "seed", F.round("loss", 9).alias("loss"), "rank")


_TAMPER = "tp AS (SELECT design, round, idx, CASE WHEN design % 7 = 1 AND round = 2 THEN parent + 1 ELSE parent END AS parent, CASE WHEN design % 7 = 2 THEN seed + 1 ELSE seed END AS seed, suffix, CASE WHEN design % 7 = 3 AND round = 1 THEN state || 'A' ELSE state END AS state, chain, CASE WHEN design % 7 = 4 AND idx % 4 = 1 THEN loss + 0.25 ELSE loss END AS loss, CASE WHEN design % 7 = 5 AND rank = 2 THEN NULL ELSE rank END AS rank FROM cand WHERE design % 7 <> 6 OR round <> 3 OR idx % 4 <> 2)"
_AUDIT = f"{_candidates()}, {_TAMPER}, kp AS (SELECT design, round + 1 AS round, idx AS parent, state AS before, chain AS link FROM tp WHERE rank IS NOT NULL), j AS (SELECT tp.*, before, link, row_number() OVER (PARTITION BY tp.design, tp.round ORDER BY loss NULLS LAST, idx) AS due, it.seq FROM tp LEFT JOIN kp ON kp.design = tp.design AND kp.round = tp.round AND kp.parent = tp.parent JOIN it ON it.design = tp.design), w AS (SELECT *, CASE WHEN regexp_matches(state, 'AAA|CCC|GGG|TTT') THEN NULL ELSE 1 - (length(seq) - length(replace(seq, state, ''))) / length(seq)::DOUBLE END AS want, CASE WHEN loss IS NOT NULL AND due <= {_WIDTH} THEN due END AS should FROM j), v AS (SELECT 'parent' AS rule FROM w WHERE round > 0 AND before IS NULL UNION ALL SELECT 'seed' FROM w WHERE seed <> ('0x' || left(md5(design || '|' || round || '|' || idx), 15))::BIGINT UNION ALL SELECT 'chain' FROM w WHERE (round = 0 OR before IS NOT NULL) AND (state <> CASE WHEN round = 0 THEN '' ELSE before END || suffix OR chain <> sha256(CASE WHEN round = 0 THEN '' ELSE link END || suffix)) UNION ALL SELECT 'loss' FROM w WHERE NOT coalesce(abs(loss - want) <= 1e-10, loss IS NULL AND want IS NULL) UNION ALL SELECT 'rank' FROM w WHERE rank IS DISTINCT FROM should UNION ALL SELECT 'count' FROM (SELECT design, round, count(*) AS n FROM tp GROUP BY ALL) a LEFT JOIN (SELECT design, round, count(*) AS p FROM kp GROUP BY ALL) b USING (design, round) WHERE n <> CASE WHEN round = 0 THEN 4 ELSE coalesce(p, 0) * 4 END)"


@query(f"WITH {_AUDIT} SELECT rule, count(*) AS n FROM v GROUP BY rule")
def sta13_audit_violations(spark, d):
    """Audit of a search's record in which six of seven designs were tampered with, each in another way."""
    rows, items = _search(spark, d, new_folder(spark, "audit")), _items(spark, d)
    way = F.col("design") % 7
    rows = rows.where((way != 6) | (F.col("round") != 3) | (F.col("idx") % 4 != 2)).withColumns({
        "parent": F.col("parent") + ((way == 1) & (F.col("round") == 2)).cast("int"), "seed": F.col("seed") + (way == 2).cast("int"),
        "state": F.when((way == 3) & (F.col("round") == 1), F.concat("state", F.lit("A"))).otherwise(F.col("state")),
        "loss": F.when((way == 4) & (F.col("idx") % 4 == 1), F.col("loss") + 0.25).otherwise(F.col("loss")), "rank": F.when((way != 5) | (F.col("rank") != 2), F.col("rank")),
    })
    loss = rows.select("design", "state").distinct().join(items, "design").select("design", "state", _loss(F.col("state"), F.col("seq")).alias("want"))
    return dg.search_violations(rows, 4, _WIDTH, _seed, loss).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT item_id, sha256(text) AS want, sha256(trim(text)) AS got FROM benchmark WHERE item_id % 3 = 0 AND text <> trim(text) UNION ALL SELECT item_id, sha256(text), NULL FROM benchmark WHERE item_id % 5 = 4 AND item_id % 3 <> 0")
def snk11_fragment_audit(spark, d):
    """Fragments of a record against what stands in the text: some were trimmed on the way, some are missing."""
    b = read(spark, d, "benchmark").select("item_id", "text")
    stands = b.where((F.col("item_id") % 3 == 0) | (F.col("item_id") % 5 != 4)).select("item_id", F.when(F.col("item_id") % 3 == 0, F.trim("text")).otherwise(F.col("text")).alias("text"))
    want, got = (x.select("item_id", F.sha2("text", 256).alias("sha")) for x in (b, stands))
    return dg.changed(want, got, "item_id", "sha")


@query("""WITH r AS (SELECT o_orderkey AS id, ['medium', 'short', 'long'][o_orderkey % 3 + 1] AS name, 3072 * (1 + o_custkey % 3) AS n FROM orders), w AS (SELECT id, name, n, CASE name WHEN 'medium' THEN 768 WHEN 'short' THEN 384 ELSE 1664 END AS o, CASE name WHEN 'medium' THEN 768 WHEN 'short' THEN 1152 ELSE 1664 END AS f FROM r), b AS (SELECT name, n, i, ((i * 128) % (o + f) < o)::INT AS v FROM (SELECT DISTINCT name, n, o, f FROM w), range(0, 72) t(i) WHERE i * 128 < n), p AS (SELECT name, n, count(*) AS bins, sum(v) AS lit, sum(v * (i + 1)) AS checksum FROM b GROUP BY ALL) SELECT name, n::BIGINT AS length, count(*) AS designs, any_value(bins)::BIGINT AS bins, any_value(lit)::BIGINT AS lit, any_value(checksum)::BIGINT AS checksum FROM w JOIN p USING (name, n) GROUP BY ALL""")
def fn19_patterns(spark, d):
    """The pattern each design asks for, by name and length: bins, lit bins, and a checksum of where they are."""
    k = F.col("o_orderkey") % 3
    asked = read(spark, d, "orders").select(F.when(k == 0, "medium").when(k == 1, "short").otherwise("long").alias("name"), (3072 * (1 + F.col("o_custkey") % 3)).alias("length"))
    asked = asked.groupBy("name", "length").agg(F.count("*").alias("designs"))
    wave = None
    for name, (on, off) in dg.WAVES.items():
        wave = F.when(F.col("name") == name, dg.wave(F.col("length"), 128, on, off)) if wave is None else wave.when(F.col("name") == name, dg.wave(F.col("length"), 128, on, off))
    rows = asked.withColumn("w", wave)
    total = lambda f: F.aggregate(F.transform("w", f), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("name", "length", "designs", F.size("w").cast("long").alias("bins"), total(lambda x: x.cast("long")).alias("lit"), total(lambda x, i: x.cast("long") * (i + 1)).alias("checksum"))


@query("WITH p AS (SELECT l_orderkey AS id, l_linenumber AS rep, l_quantity AS x FROM lineitem WHERE l_linenumber <= 4), n AS (SELECT rep, max(x) AS m FROM p GROUP BY rep), v AS (SELECT id, rep, avg(x / m) AS x FROM p JOIN n USING (rep) GROUP BY ALL), s AS (SELECT id, avg(x) - stddev_pop(x) AS score, count(*) AS n FROM v GROUP BY id) SELECT id, round(score, 6) AS score FROM s WHERE n = 4")
def fn20_score_predictions(spark, d):
    p = read(spark, d, "lineitem").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("rep"), F.col("l_quantity").alias("x"))
    v = p.join(p.groupBy("rep").agg(F.max("x").alias("m")), "rep").groupBy("id", "rep").agg(F.avg(F.col("x") / F.col("m")).alias("x"))
    s = v.groupBy("id").agg((F.avg("x") - F.stddev_pop("x")).alias("score"), F.count("*").alias("n"))
    return s.where("n = 4").select("id", r6(F.col("score")).alias("score"))


@query("SELECT o_custkey AS job, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) AS attempts FROM orders GROUP BY 1")
def st12_latest_attempt(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("job"))
    return o.agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.count("*").alias("attempts"))


@query("""WITH a AS (SELECT o_custkey AS job, o_orderdate AS d, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'complete' ELSE 'running' END AS status, o_orderkey % 3 <> 0 AS eligible, CASE WHEN o_orderkey % 50 = 7 THEN 'old' ELSE 'new' END AS implementation, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'CUDA: Out of memory' END AS error FROM orders), m AS (SELECT job, count(*) AS n, arg_max(status, (d, k)) AS status, arg_max(eligible, (d, k)) AS eligible, arg_max(implementation, (d, k)) AS implementation, arg_max(coalesce(error, ''), (d, k)) AS error FROM a GROUP BY job), p AS (SELECT c_custkey AS job, CASE c_custkey % 3 WHEN 0 THEN 'calibration' WHEN 1 THEN 'pilot' ELSE 'all' END AS stage FROM customer), q AS (SELECT p.job, stage, CASE WHEN stage = 'all' THEN 'out_of_scope' WHEN n IS NULL THEN 'run' WHEN implementation <> 'new' THEN 'refuse' WHEN status = 'complete' AND eligible THEN 'skip' WHEN stage = 'calibration' AND status = 'failed' AND error <> '' THEN 'skip_memory' ELSE 'archive_and_run' END AS action, n, status, eligible FROM p LEFT JOIN m USING (job)) SELECT job, stage, action, CASE WHEN action = 'archive_and_run' THEN n - 1 END AS attempt, CASE WHEN action = 'archive_and_run' THEN status = 'running' OR (status = 'complete' AND NOT eligible) END AS incomplete FROM q""")
def st12_queue(spark, d):
    """A queue of all customers' jobs against their orders as attempts, asked for everything under a scope frozen at the pilot."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "complete").otherwise("running")
    attempts = o.select(
        F.col("o_custkey").alias("job"), F.struct("o_orderdate", "o_orderkey").alias("at"), status.alias("status"), (k % 3 != 0).alias("eligible"),
        F.when(k % 50 == 7, "old").otherwise("new").alias("implementation"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "CUDA: Out of memory").alias("error"),
    )
    c = F.col("c_custkey")
    planned = read(spark, d, "customer").select(c.alias("job"), F.when(c % 3 == 0, "calibration").when(c % 3 == 1, "pilot").otherwise("all").alias("stage"))
    return dg.queue(planned, attempts, "new", "all", "pilot")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'error'")
def src16_result_scan(spark, d):
    e = read(spark, d, "events").where("event_type = 'error'")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {DNA}, r AS (SELECT doc_id, source, length(seq) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM dna) SELECT source, doc_id FROM r WHERE list_contains(list_transform(range(0, least(c, 4)::BIGINT), lambda j: floor(j * (c - 1) / 3.0)::BIGINT), i)")
def src22_evenly_spaced_picks(spark, d):
    from ..operators.curate import evenly_spaced

    return evenly_spaced(read(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 4).select("source", "doc_id")


@query(f"WITH {DNA}, q AS (SELECT doc_id, i, substr(seq, greatest(i - 3, 1), least(i, 4)) AS last FROM dna, unnest(range(1, length(seq) + 1)) t(i)) SELECT doc_id, count(*) AS n, sum(length(last))::BIGINT AS held, sum(i * (ascii(left(last, 1)) + 256 * ascii(right(last, 1))))::BIGINT AS checksum FROM q GROUP BY doc_id")
def win14_rolling_context(spark, d):
    """The last four symbols at every position, fewer at the start; what comes out is a digest of each sequence's contexts."""
    from ..operators.kmers import rolling

    rows = rolling(dna(spark, d), 4, ["doc_id"])
    ends = F.ascii("last") + 256 * F.ascii(F.right("last", F.lit(1)))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.char_length("last")).alias("held"), F.sum((F.col("pos") + 1) * ends).alias("checksum"))


