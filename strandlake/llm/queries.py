"""Queries of this subpackage for the driver: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, jaccard, language, mixing, parsing, phrases, pii, quality, sharding, tokens, toxicity
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select("doc_id", *quality.BASE, "base_failed", "kept")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_private(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.read_back(chat.windows(rows.unionByName(more)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.neighbours(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_pii": op4_pii,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_document_fingerprints": op13_document_fingerprints,
}
_WORDS = r"w AS (SELECT doc_id, lang, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"

ORACLES: dict[str, str] = {
    "op1_quality_rules": f"""
WITH {_WORDS},
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) t(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 3) t(k) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lin.n - lin.u, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lin.n, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lin USING (doc_id)),
s AS (SELECT doc_id, lang, source, n_words, g.signal, CASE WHEN g.den > 0 THEN g.num * 1000 // g.den ELSE 0 END AS v, g.floor, g.two FROM b,
  unnest([{{'signal': 'word_length', 'num': word_chars, 'den': n_words, 'floor': 500, 'two': true}}, {{'signal': 'symbols', 'num': n_symbols, 'den': n_words, 'floor': 50, 'two': false}},
  {{'signal': 'dup_lines', 'num': n_dup_lines, 'den': n_lines, 'floor': 200, 'two': false}}, {{'signal': 'repeats', 'num': n_repeat_words, 'den': n_words, 'floor': 100, 'two': false}}]) t(g)),
k AS (SELECT *, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket FROM s WHERE n_words > 0),
sk AS (SELECT lang, source, signal, bucket, count(*) AS n FROM k GROUP BY ALL),
f AS (SELECT lang, source, signal, max(t) AS t, min(bucket) FILTER (WHERE c * 4 >= t) AS q1, min(bucket) FILTER (WHERE c * 4 >= t * 3) AS q3 FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, signal ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY lang, source, signal) AS t FROM sk) GROUP BY ALL),
l AS (SELECT lang, signal, max(t) AS t, min(bucket) FILTER (WHERE c * 4 >= t) AS q1, min(bucket) FILTER (WHERE c * 4 >= t * 3) AS q3 FROM (SELECT *, sum(n) OVER (PARTITION BY lang, signal ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY lang, signal) AS t FROM (SELECT lang, signal, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL),
e AS (SELECT signal, max(t) AS t, min(bucket) FILTER (WHERE c * 4 >= t) AS q1, min(bucket) FILTER (WHERE c * 4 >= t * 3) AS q3 FROM (SELECT *, sum(n) OVER (PARTITION BY signal ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY signal) AS t FROM (SELECT signal, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL),
q AS (SELECT f.lang, f.source, f.signal, CASE WHEN f.t >= 200 THEN f.q1 WHEN l.t >= 200 THEN l.q1 ELSE e.q1 END AS q1, CASE WHEN f.t >= 200 THEN f.q3 WHEN l.t >= 200 THEN l.q3 ELSE e.q3 END AS q3 FROM f LEFT JOIN l ON l.lang IS NOT DISTINCT FROM f.lang AND l.signal = f.signal LEFT JOIN e ON e.signal = f.signal),
v AS (SELECT s.doc_id, bool_and(coalesce(s.v <= q3 + 3 * greatest(q3 - q1, s.floor) AND (NOT s.two OR s.v >= q1 - 3 * greatest(q3 - q1, s.floor)), true)) AS inside FROM s LEFT JOIN q ON q.lang IS NOT DISTINCT FROM s.lang AND q.source IS NOT DISTINCT FROM s.source AND q.signal = s.signal GROUP BY s.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND inside AS kept FROM b JOIN v USING (doc_id)""",
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS g FROM w, unnest(range(1, len(ws) - 2)) t(i) UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS o FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY ALL) x JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 100 * o >= 85 * (m.n + k.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, other) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(other) AS c FROM r GROUP BY id) c ON c.id = d.doc_id""",
    "op8_mixing": f"""
WITH {_WORDS},
z AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, len(ws)::BIGINT AS size, ('0x' || substr(md5('8|' || doc_id), 1, 15))::BIGINT AS h FROM w),
p AS (SELECT src, sum(size)::BIGINT AS total, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY src) - 1) % 3 + 1]::DOUBLE AS w FROM z GROUP BY src),
c AS (SELECT *, total * 3.0::DOUBLE AS cap, sum(total) OVER ()::DOUBLE AS budget FROM p),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c),
lv AS (SELECT arg_min((budget - caps) / rest, (cap / w, src)) AS level FROM o WHERE (budget - caps) / rest <= cap / w),
t AS (SELECT src, total, budget, coalesce(least(cap, level * w), cap) AS target FROM o, lv),
q AS (SELECT z.*, total, target, budget, sum(size) OVER (PARTITION BY src ORDER BY h, doc_id::VARCHAR, size) AS cum FROM z JOIN t USING (src)),
f AS (SELECT doc_id, size, src, h, budget, ((k - 1) * total + cum)::DOUBLE / target AS f FROM q, range(1, 4) x(k) WHERE size > 0 AND target > 0),
g AS (SELECT doc_id, size, budget, sum(size) OVER (ORDER BY f, src, h, doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS run FROM f),
m AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM g WHERE run <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.total AS source_size, q.target, coalesce(m.taken, 0)::BIGINT AS taken FROM q LEFT JOIN m USING (doc_id)""",
    "op9_chat_formatting": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
z AS (SELECT *, ceil(length(text) / 4.0)::BIGINT + 4 AS cost, length(text) + length(role) + 13 + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^\\#<\n]', '', 'g')) AS chars FROM c),
s AS (SELECT *, row_number() OVER o AS i, sum(cost) OVER o - cost AS start FROM z WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
y AS (SELECT conv_id, cost, chars FROM s WHERE i = 1 AND role = 'system'),
k AS MATERIALIZED (SELECT s.*, s.i = 1 AND role = 'system' AS lead, coalesce(y.cost, 0) AS sys, CASE WHEN s.i = 1 AND role = 'system' THEN 0 ELSE s.cost END AS own, s.start // 16384 AS block FROM s LEFT JOIN y USING (conv_id)),
g(conv_id, i, block, used, span) AS (SELECT conv_id, i, block, own, i FROM k WHERE i = 1
  UNION ALL SELECT k.conv_id, k.i, k.block, CASE WHEN n THEN own ELSE used + own END, CASE WHEN n THEN k.i ELSE span END
  FROM (SELECT k.*, g.span, g.used, k.block <> g.block OR g.used > 0 AND g.used + k.own > 768 - k.sys AS n FROM g JOIN k ON k.conv_id = g.conv_id AND k.i = g.i + 1) k),
sp AS MATERIALIZED (SELECT k.conv_id, g.span, min(k.start) AS at, greatest(0, least(256, 1024 - min(k.sys) - sum(k.own))) AS room FROM k JOIN g ON g.conv_id = k.conv_id AND g.i = k.i GROUP BY ALL),
ctx AS (SELECT k.conv_id, sum(chars) AS n FROM k JOIN sp ON sp.conv_id = k.conv_id AND k.i < sp.span AND k.start >= sp.at - sp.room AND NOT k.lead GROUP BY 1),
sys AS (SELECT y.conv_id, sum(chars) AS n FROM y JOIN sp ON sp.conv_id = y.conv_id AND sp.span > 1 GROUP BY 1),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS own FROM k GROUP BY conv_id)
SELECT t.conv_id, n_turns::BIGINT AS n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (own + coalesce(ctx.n, 0) + coalesce(sys.n, 0))::BIGINT AS formatted_chars FROM t LEFT JOIN ctx USING (conv_id) LEFT JOIN sys USING (conv_id)""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS MATERIALIZED (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT g.lang, g.source, kept.term, kept.n AS whole, coalesce(o.n, 0) AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) o ON o.lang = g.lang AND o.source = g.source AND o.term = kept.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS p, 1 + (1000000000::HUGEINT * (whole + 1)) // (sum(whole) OVER s + count(*) OVER s) AS q FROM c WINDOW s AS (PARTITION BY lang, source)),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS v FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL) z ON z.lang = a.lang AND z.a = a.source AND z.b = b.source),
te AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM te))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op12_phrase_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM w, range(1, 4) x(k), unnest(range(1, len(ws) - k + 2)) t(i)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1 : cut], ' ') AS head, array_to_string(string_split(phrase, ' ')[cut + 1 :], ' ') AS rest FROM f, range(1, 3) y(cut) WHERE cut < k),
s AS (SELECT c.lang, c.k, c.phrase, c.a, cut, h.a AS l, t.a AS r, (1000000::HUGEINT * c.a * c.a) // (h.a::HUGEINT * t.a) AS score FROM c JOIN f h ON h.lang = c.lang AND h.phrase = head JOIN f t ON t.lang = c.lang AND t.phrase = rest),
b AS (SELECT lang, k, phrase, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM s GROUP BY ALL),
i AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN f ON f.lang = b.lang AND f.k > b.k AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * f.a >= 50 * b.a),
o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN i USING (lang, phrase))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000""",
}
