"""Sequence queries: scans, cleaning, k-mers, Markov and lookup tables, reading frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import codes, kmers, orf
from ..sources.files import parse_genome_line
from ..session import broadcast
from .base import CLEAN, DNA, cleaned, densest, dna, query, r6, read


@query(f"WITH {CLEAN} SELECT doc_id, seq FROM clean WHERE seq <> ''")
def src04_load_clean(spark, d):
    return cleaned(spark, d).select("doc_id", "seq").where("seq <> ''")


@query("""SELECT doc_id, '' AS record, text FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL AND text <> ''""")
def src09_genome_lines(spark, d):
    """Whole lines; every third is cut off and skipped."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    broken = F.when(F.col("doc_id") % 3 == 0, F.lit('{"text": "unfinished')).otherwise(F.to_json(F.struct("text")))
    rows = docs.select("doc_id", parse_genome_line(broken).alias("r"))
    return rows.where("r.text IS NOT NULL AND r.text <> ''").select("doc_id", F.coalesce("r.record", F.lit("")).alias("record"), "r.text")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ACC' || doc_id || '.1' ELSE '' END AS record, length(text)::BIGINT AS n FROM documents WHERE text <> ''""")
def src10_genome_records(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    acc = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ACC"), F.col("doc_id").cast("string"), F.lit(".1")))
    line = F.to_json(F.struct(acc.alias("record"), "text"))
    rows = docs.select("doc_id", parse_genome_line(line).alias("r")).where("r.text <> ''")
    return rows.select("doc_id", F.coalesce("r.record", F.lit("")).alias("record"), F.char_length("r.text").cast("long").alias("n"))


@query("""SELECT b.item_id, coalesce(right(u.text, 30), '') || b.text || coalesce(left(n.text, 20), '') AS scored, right(coalesce(u.text, ''), 40960) AS prompt, length(b.text)::BIGINT AS n FROM benchmark b LEFT JOIN benchmark u ON u.item_id = b.item_id - 1 LEFT JOIN benchmark n ON n.item_id = b.item_id + 1""")
def src17_flank_assembly(spark, d):
    """An item between the end of the one before and the start of the one after; the prompt is what lies upstream."""
    b = read(spark, d, "benchmark").select("item_id", "text")
    up, down = (b.select((F.col("item_id") + k).alias("item_id"), F.col("text").alias(n)) for k, n in ((1, "up"), (-1, "down")))
    rows = b.join(up, "item_id", "left").join(down, "item_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("up", "down")})
    scored = F.concat(F.right("up", F.lit(30)), "text", F.left("down", F.lit(20)))
    return rows.select("item_id", scored.alias("scored"), F.right("up", F.lit(40960)).alias("prompt"), F.char_length("text").cast("long").alias("n"))


@query("""WITH r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM benchmark) SELECT idx::BIGINT AS idx FROM r WHERE item_id = 7""")
def src18_track_row(spark, d):
    """The ordinal of the one row with this id: rows before it are counted, and that it is one is checked."""
    n = read(spark, d, "benchmark").agg(F.count_if(F.col("item_id") < 7).alias("idx"), F.count_if(F.col("item_id") == 7).alias("n"))
    return n.select(F.when(F.col("n") == 1, F.col("idx")).otherwise(F.raise_error(F.lit("the id is not that of exactly one row"))).alias("idx"))


@query("""WITH r AS (SELECT source, doc_id, length(text) AS len, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rk FROM documents) SELECT source, doc_id, rk::INTEGER AS rank FROM r WHERE rk <= 2""")
def src22_held_out_records(spark, d):
    from ..operators.curate import longest

    docs = read(spark, d, "documents").select("source", "doc_id", F.char_length("text").alias("len"))
    return longest(docs, "source", F.col("len"), "doc_id", 2).select("source", "doc_id", "rank")


@query(f"""WITH {CLEAN} SELECT lang, count(*) AS n, sum(length(seq))::BIGINT AS symbols, sum(length(seq) - length(replace(seq, 'N', '')))::BIGINT AS n_symbols FROM clean GROUP BY lang""")
def fn01_clean_seq(spark, d):
    c = cleaned(spark, d)
    return c.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("seq")).alias("symbols"), F.sum(tx.occurrences(F.col("seq"), "N")).alias("n_symbols"))


@query(f"""WITH {DNA} SELECT doc_id, md5(reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan'))) AS h, reverse(translate(reverse(translate(seq, 'ACGTN', 'TGCAN')), 'ACGTN', 'TGCAN')) = seq AS twice_same FROM dna""")
def fn02_reverse_complement(spark, d):
    s = F.col("seq")
    return dna(spark, d).select("doc_id", F.md5(tx.reverse_complement(s)).alias("h"), (tx.reverse_complement_upper(tx.reverse_complement_upper(s)) == s).alias("twice_same"))


@query(f"""WITH {DNA}, c AS (SELECT doc_id, length(seq) - length(translate(seq, 'GC', '')) AS gc, length(seq) - length(translate(seq, 'ACGT', '')) AS n FROM dna) SELECT doc_id, round(gc::DOUBLE / nullif(n, 0), 6) AS gc FROM c""")
def fn03_gc_fraction(spark, d):
    return dna(spark, d).select("doc_id", r6(tx.gc_fraction(F.col("seq"))).alias("gc"))


@query("""SELECT doc_id, md5(regexp_replace(text, '[^\\x{0}-\\x{7F}]', '�', 'g')) AS h, length(text)::BIGINT AS n FROM documents""")
def fn04_ids_to_text(spark, d):
    back = tx.ids_to_text(F.transform(F.split("text", ""), lambda x: F.ascii(x)))
    return read(spark, d, "documents").select("doc_id", F.md5(back).alias("h"), F.char_length(back).cast("long").alias("n"))


@query(f"""WITH {DNA} SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(seq, '.'), lambda c: ascii(c)), ',')) AS ids, md5(translate(seq, 'ACGTN', '01234')) AS symbols FROM dna WHERE seq <> ''""")
def fn05_seq_to_ids(spark, d):
    ids = F.array_join(F.transform(tx.ids(F.col("seq")), lambda x: x.cast("string")), ",")
    return dna(spark, d).where("seq <> ''").select("doc_id", F.md5(ids).alias("ids"), F.md5(F.translate("seq", "ACGTN", "01234")).alias("symbols"))


@query(f"""WITH {DNA}, c AS (SELECT doc_id, lpad(right(seq, 3), 3, 'N') AS c FROM dna) SELECT doc_id, ((strpos('ACGTN', substr(c, 1, 1)) - 1) * 25 + (strpos('ACGTN', substr(c, 2, 1)) - 1) * 5 + strpos('ACGTN', substr(c, 3, 1)) - 1)::BIGINT AS code FROM c""")
def fn06_context_code(spark, d):
    return dna(spark, d).select("doc_id", tx.context_code(F.col("seq"), 3).alias("code"))


@query("""SELECT left(split_part(source || '_fam' || (doc_id % 7) || '.' || doc_id, '.', 1), 6) AS family, count(*) AS n FROM documents GROUP BY 1""")
def fn07_accession_family(spark, d):
    acc = F.concat("source", F.lit("_fam"), (F.col("doc_id") % 7).cast("string"), F.lit("."), F.col("doc_id").cast("string"))
    return read(spark, d, "documents").groupBy(tx.family(acc).alias("family")).agg(F.count("*").alias("n"))


@query(f"""WITH {DNA} SELECT doc_id, {', '.join(f"(length(seq) - length(replace(seq, '{b}', '')))::BIGINT AS {b.lower()}" for b in 'ACGT')} FROM dna WHERE seq <> ''""")
def fn21_one_hot(spark, d):
    rows = dna(spark, d).where("seq <> ''").select("doc_id", tx.one_hot(F.col("seq")).alias("h"))
    s = lambda i: F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + F.get(x, i))
    return rows.select("doc_id", *[s(i).alias(n) for i, n in enumerate("acgt")])


@query("""WITH RECURSIVE n AS (SELECT source AS s, 'd' || (doc_id % 5) AS t FROM documents GROUP BY 1, 2), h(s, t, i, h) AS (SELECT s, t, 1, 0::BIGINT FROM n UNION ALL SELECT s, t, i + 1, (h * 131 + ascii(substr(s || '|' || t, i, 1))) % 4294967296 FROM h WHERE i <= length(s || '|' || t)) SELECT s AS prompt, t AS drafter, 7 + h % 100000 AS seed FROM h WHERE i = length(s || '|' || t) + 1""")
def fn22_run_seed(spark, d):
    n = read(spark, d, "documents").select(F.col("source").alias("prompt"), F.concat(F.lit("d"), (F.col("doc_id") % 5).cast("string")).alias("drafter")).distinct()
    return n.select("prompt", "drafter", tx.run_seed(F.col("prompt"), F.col("drafter"), 7).alias("seed"))


@query("""SELECT doc_id, sha256(text) AS sha, sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS canonical FROM documents""")
def fn24_hashes(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.sha2(F.to_json(F.struct("lang", "source")), 256).alias("canonical"))


@query(f"""WITH {DNA} , span AS (SELECT doc_id, left(seq, 1024) AS seq FROM dna), w AS (SELECT doc_id, substr(seq, i, 5) AS m FROM span, unnest(range(1, length(seq) - 3)) t(i)), c AS (SELECT doc_id, m, count(*) AS n FROM w GROUP BY ALL), e AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS ent FROM c GROUP BY doc_id), u AS (SELECT doc_id, count(DISTINCT m)::DOUBLE / count(*) AS u FROM (SELECT doc_id, substr(seq, i, 10) AS m FROM span, unnest(range(1, length(seq) - 8)) t(i)) GROUP BY doc_id), h AS (SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(seq, '(A{{6,}}|C{{6,}}|G{{6,}}|T{{6,}}|N{{6,}})'), lambda x: length(x))), 0)::DOUBLE / nullif(length(seq), 0) AS f FROM span) SELECT s.doc_id, round(ent, 6) AS entropy_k5, round(coalesce(f, 0), 6) AS homopolymer_frac6, round(coalesce(u, 1), 6) AS unique_k10, left(seq, 80) AS prefix80 FROM span s LEFT JOIN e USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN h USING (doc_id)""")
def fn30_score_prompt_span(spark, d):
    span = F.left("seq", F.lit(1024))
    rows = dna(spark, d).select("doc_id", span.alias("seq"), r6(tx.homopolymer_fraction(span)).alias("homopolymer_frac6"), F.left("seq", F.lit(80)).alias("prefix80"))
    rows = kmers.span_features(rows, 5, 10, "doc_id")
    return rows.select("doc_id", r6(F.col("entropy")).alias("entropy_k5"), "homopolymer_frac6", r6(F.col("unique")).alias("unique_k10"), "prefix80")


@query(rf"""WITH {DNA}, p AS (SELECT doc_id, kind, upper(regexp_replace(raw, '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\v]', '', 'g')) AS s FROM (SELECT doc_id, 'raw' AS kind, text AS raw FROM documents UNION ALL SELECT doc_id, 'recoded', left(seq, 30) || chr(10) || lower(substr(seq, 31)) FROM dna)) SELECT doc_id, kind, CASE WHEN regexp_matches(s, '[^ACGTN]') THEN 'non-ACGTN' WHEN length(s) < 64 THEN 'too short' END AS reason FROM p""")
def flt07_prompt_validation(spark, d):
    """Whole texts as they are, and whole recoded sequences with a line break and lower case in them."""
    raw = read(spark, d, "documents").select("doc_id", F.lit("raw").alias("kind"), "text")
    seq = F.concat(F.left("seq", F.lit(30)), F.lit("\n"), F.lower(F.substring("seq", F.lit(31), F.char_length("seq"))))
    rows = raw.union(dna(spark, d).select("doc_id", F.lit("recoded"), seq))
    return rows.select("doc_id", "kind", tx.prompt_reason(F.col("text")).alias("reason"))


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_LOWER}', '{_UPPER}'), '(?s).')) AS ch FROM documents) SELECT doc_id, count(DISTINCT ch) FILTER (WHERE ch NOT IN ('A','C','G','T','N')) AS outside FROM c GROUP BY doc_id""")
def set05_alphabet_subset(spark, d):
    """How many different characters of a text, a-z raised, are not in the alphabet; 0 for subsets of it."""
    rows = read(spark, d, "documents").where("text <> ''")
    return rows.select("doc_id", F.size(tx.outside_alphabet(F.translate("text", _LOWER, _UPPER))).cast("long").alias("outside"))


@query(f"""WITH {DNA} SELECT substr(seq, i, 4) AS kmer, count(*) AS n FROM dna, unnest(range(1, length(seq) - 2)) t(i) GROUP BY 1""")
def agg03_kmer_counts(spark, d):
    return kmers.counts(dna(spark, d), 4, [])


@query(f"""WITH {DNA}, c AS (SELECT doc_id, substr(seq, i, 5) AS m, count(*) AS n FROM dna, unnest(range(1, length(seq) - 3)) t(i) GROUP BY ALL) SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY doc_id""")
def agg04_kmer_entropy(spark, d):
    return kmers.entropy(dna(spark, d), 5, ["doc_id"]).withColumn("entropy", r6(F.col("entropy")))


@query(f"""WITH {DNA}, w AS (SELECT doc_id, count(DISTINCT substr(seq, i, 10))::DOUBLE / count(*) AS r FROM dna, unnest(range(1, length(seq) - 8)) t(i) GROUP BY doc_id) SELECT doc_id, round(coalesce(r, 1.0), 6) AS rate FROM dna LEFT JOIN w USING (doc_id)""")
def agg05_unique_kmer_rate(spark, d):
    return kmers.unique_rate(dna(spark, d), 10, "doc_id").withColumn("rate", r6(F.col("rate")))


@query(f"""WITH {DNA}, c AS (SELECT source, substr(seq, i, 4) AS m, count(*) AS n FROM dna, unnest(range(1, length(seq) - 2)) t(i) GROUP BY ALL) SELECT source, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, sum(n)::BIGINT AS windows FROM c GROUP BY source""")
def agg06_pooled_entropy(spark, d):
    c = kmers.counts(dna(spark, d), 4, ["source"])
    t = c.groupBy("source").agg(F.sum("n").alias("windows"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return t.select("source", r6(F.log2("windows") - F.col("s") / F.col("windows")).alias("entropy"), "windows")


@query(r"""WITH c AS (SELECT lang, regexp_replace(text, '[ \t\r\n]', '', 'g') AS raw FROM documents), k AS (SELECT lang, length(raw) AS n, length(regexp_replace(raw, '[^ACGT]', '', 'g')) AS upper, length(regexp_replace(raw, '[^acgtn]', '', 'g')) AS lower, length(regexp_replace(raw, '[ACGTNacgtn]', '', 'g')) AS other FROM c) SELECT lang, sum(n)::BIGINT AS total, sum(upper)::BIGINT AS plain, sum(lower)::BIGINT AS lowered, sum(other)::BIGINT AS replaced, round(coalesce(sum(other)::DOUBLE / nullif(sum(n), 0), 0), 6) AS replaced_frac FROM k GROUP BY lang""")
def agg08_cleaning_stats(spark, d):
    raw = read(spark, d, "documents").select("lang", F.regexp_replace("text", "[ \t\r\n]", "").alias("raw"))
    n = lambda pat: F.sum(F.char_length(F.regexp_replace("raw", pat, "")))
    out = raw.groupBy("lang").agg(F.sum(F.char_length("raw")).alias("total"), n("[^ACGT]").alias("plain"), n("[^acgtn]").alias("lowered"), n("[ACGTNacgtn]").alias("replaced"))
    return out.withColumn("replaced_frac", r6(F.coalesce(F.try_divide(F.col("replaced").cast("double"), F.col("total").cast("double")), F.lit(0.0))))


_BOTH = f"{DNA}, s AS (SELECT doc_id, source, 1 AS strand, seq FROM dna UNION ALL SELECT doc_id, source, -1, reverse(translate(seq, 'ACGTN', 'TGCAN')) FROM dna), cod AS (SELECT doc_id, source, strand, (i - 1) % 3 AS frame, i - 1 AS pos, substr(seq, i, 3) AS c FROM s, unnest(range(1, length(seq) - 1)) t(i)), sel AS (SELECT * FROM cod WHERE c IN ('ATG','TAA','TAG','TGA'))"
_ORF = _BOTH + ", nx AS (SELECT *, min(CASE WHEN c <> 'ATG' THEN pos END) OVER (PARTITION BY doc_id, strand, frame ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM sel), orfs AS (SELECT doc_id, strand, frame, pos AS start, stop + 3 AS \"end\", stop + 3 - pos AS length FROM nx WHERE c = 'ATG' AND stop IS NOT NULL AND stop + 3 - pos >= 60)"


@query(f"""WITH {_ORF} SELECT doc_id, strand::INTEGER AS strand, frame::INTEGER AS frame, start::BIGINT AS start, "end"::BIGINT AS "end", length::BIGINT AS length FROM orfs""")
def join05_complete_orfs(spark, d):
    return orf.complete(dna(spark, d), ["doc_id"])


@query(f"""WITH {_ORF}, m AS (SELECT doc_id, count(*) AS n, max(length) AS l, sum(length) AS s FROM orfs GROUP BY doc_id) SELECT doc_id, coalesce(n, 0)::BIGINT AS n_orfs, coalesce(l, 0)::BIGINT AS longest_orf_bp, coalesce(s, 0)::BIGINT AS coding_bp, round(coalesce(s::DOUBLE / nullif(length(seq), 0), 0), 6) AS coding_frac FROM dna LEFT JOIN m USING (doc_id)""")
def agg09_orf_metrics(spark, d):
    return orf.metrics(dna(spark, d)).withColumn("coding_frac", r6(F.col("coding_frac")))


_KMERS = " UNION ALL ".join(f"SELECT doc_id, '{n}:' || substr(seq, i, {k}) AS field, count(*)::DOUBLE AS value FROM dna, unnest(range(1, length(seq) - {k - 2})) t(i) GROUP BY ALL" for k, n in ((2, "dinuc"), (3, "trinuc"), (4, "tetranuc")))
_SCALARS = "unnest([{'f': 'length', 'v': length(seq)::DOUBLE}, {'f': 'gc', 'v': round((length(seq) - length(translate(seq, 'CG', '')))::DOUBLE / nullif(length(seq), 0), 6)}, {'f': 'n_orfs', 'v': coalesce(n, 0)::DOUBLE}, {'f': 'longest_orf_bp', 'v': coalesce(l, 0)::DOUBLE}, {'f': 'coding_frac', 'v': round(coalesce(s::DOUBLE / nullif(length(seq), 0), 0), 6)}]) AS x"


@query(f"""WITH {_ORF}, m AS (SELECT doc_id, count(*) AS n, max(length) AS l, sum(length) AS s FROM orfs GROUP BY doc_id) SELECT doc_id, x.f AS field, x.v AS value FROM (SELECT doc_id, {_SCALARS} FROM dna LEFT JOIN m USING (doc_id)) UNION ALL {_KMERS}""")
def agg26_sequence_features(spark, d):
    """Every field of a sequence's features as a row: length, gc, frames, and the counts of its 2-, 3- and 4-mers."""
    rows = codes.features(dna(spark, d), "doc_id")
    scalars = F.array(*[F.struct(F.lit(c).alias("field"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in ("length", "gc", "n_orfs", "longest_orf_bp", "coding_frac")])

    def entries(m):
        return F.transform(F.map_entries(m), lambda e: F.struct(F.concat(F.lit(f"{m}:"), e["key"]).alias("field"), e["value"].cast("double").alias("value")))

    return rows.select("doc_id", F.inline(F.concat(scalars, *map(entries, ("dinuc", "trinuc", "tetranuc")))))


@query(f"""WITH {DNA}, w AS (SELECT DISTINCT lang, substr(seq, i, 10) AS m FROM dna, unnest(range(1, length(seq) - 8)) t(i)) SELECT lang, count(*) AS kmers, true AS close, true AS mergeable FROM w GROUP BY lang""")
def agg05_distinct_kmer_sketches(spark, d):
    """Distinct k-mers of a language from sketches by source, merged upwards: within 2 % of the exact number, and of a sketch of
    everything at once."""
    n = kmers.distinct_by_parts(dna(spark, d), 10, "lang", "source").withColumns({c: F.hll_sketch_estimate(c) for c in ("sketch", "merged")})
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.02 * F.col(b)
    return n.select("lang", "kmers", near("merged", "kmers").alias("close"), near("merged", "sketch").alias("mergeable"))


@query(f"""WITH {_BOTH}, st AS (SELECT * FROM cod), l AS (SELECT doc_id, strand, frame, pos - coalesce(max(CASE WHEN c IN ('TAA','TAG','TGA') THEN pos END) OVER (PARTITION BY doc_id, strand, frame ORDER BY pos ROWS UNBOUNDED PRECEDING), frame - 3) AS gap FROM st), b AS (SELECT doc_id, max(gap) AS span FROM l GROUP BY doc_id) SELECT doc_id, greatest(coalesce(span, 0), 0)::BIGINT AS span FROM dna LEFT JOIN b USING (doc_id)""")
def win03_open_span(spark, d):
    return orf.open_span(dna(spark, d), ["doc_id"])


@query(densest("SELECT source, span::BIGINT AS span, contig::INTEGER AS contig, start::INTEGER AS start FROM k WHERE rk = 1"))
def win04_densest_window(spark, d):
    return orf.densest_window(dna(spark, d), "source", "doc_id")


@query(f"""WITH {DNA} SELECT doc_id, round(coalesce(coalesce(list_sum(list_transform(regexp_extract_all(seq, '(A{{6,}}|C{{6,}}|G{{6,}}|T{{6,}}|N{{6,}})'), lambda x: length(x))), 0)::DOUBLE / nullif(length(seq), 0), 0), 6) AS frac FROM dna""")
def win02_homopolymer_fraction(spark, d):
    return dna(spark, d).select("doc_id", r6(tx.homopolymer_fraction(F.col("seq"))).alias("frac"))


@query(f"""WITH {DNA}, w AS (SELECT doc_id, i - 1 AS pos, substr(seq, i, 12) AS k FROM dna, unnest(range(1, length(seq) - 10)) t(i)) SELECT doc_id, count(*) AS n, sum(pos * (ascii(left(k, 1)) + 256 * ascii(right(k, 1))))::BIGINT AS checksum, min(k) AS least, max(k) AS most FROM w GROUP BY doc_id""")
def win01_sliding_windows(spark, d):
    """All windows; what comes out is a digest of each sequence's windows with their places."""
    w = kmers.windows(dna(spark, d), 12, ["doc_id"], pos=True)
    ends = F.ascii("kmer") + 256 * F.ascii(F.right("kmer", F.lit(1)))
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("pos") * ends).alias("checksum"), F.min("kmer").alias("least"), F.max("kmer").alias("most"))


@query(f"""WITH {DNA} SELECT doc_id, floor(length(seq) * (1.0::DOUBLE - 0.1::DOUBLE))::INTEGER AS split, greatest(0, floor(length(seq) * (1.0::DOUBLE - 0.1::DOUBLE))::INTEGER - (length(seq) - least(length(seq), 2048)))::INTEGER AS held_from, length(right(seq, least(length(seq), 2048)::INTEGER))::INTEGER AS n FROM dna""")
def win12_held_out_window(spark, d):
    from ..operators.curate import held_out_window

    w, off, split = held_out_window(F.col("seq"))
    return dna(spark, d).select("doc_id", split.alias("split"), off.alias("held_from"), F.char_length(w).alias("n"))


@query(f"""WITH {DNA}, s AS (SELECT doc_id, seq, floor(length(seq) * (1.0::DOUBLE - 0.1::DOUBLE))::INTEGER AS p FROM dna) SELECT doc_id, md5(left(seq, p)) AS train, md5(substr(seq, p + 1)) AS test FROM s""")
def win13_split_contiguous(spark, d):
    p = tx.split_point(F.col("seq"))
    return dna(spark, d).select("doc_id", F.md5(F.left("seq", p)).alias("train"), F.md5(F.substring("seq", p + 1, F.char_length("seq"))).alias("test"))


_TRANS = f"{DNA}, tr AS (SELECT substr(seq, i, 3) AS ctx, substr(seq, i + 3, 1) AS nxt, count(*) AS cnt FROM dna, unnest(range(1, length(seq) - 2)) t(i) GROUP BY ALL)"


@query(f"WITH {_TRANS} SELECT ctx, nxt, cnt FROM tr")
def markov_counts_k3(spark, d):
    return kmers.transitions(dna(spark, d), 3)


@query(f"""WITH {_TRANS}, g AS (SELECT DISTINCT ctx, n AS nxt FROM tr, unnest(['A','C','G','T','N']) t(n)), f AS (SELECT g.ctx, g.nxt, coalesce(cnt, 0) AS cnt FROM g LEFT JOIN tr USING (ctx, nxt)) SELECT ctx, nxt, cnt::BIGINT AS cnt, round((cnt + 0.1::DOUBLE) / (sum(cnt) OVER (PARTITION BY ctx) + 0.5::DOUBLE), 6) AS prob FROM f""")
def markov_probs_k3(spark, d):
    return kmers.smoothed(kmers.transitions(dna(spark, d), 3)).withColumn("prob", r6(F.col("prob")))


def _holdout(k: int) -> str:
    return f"""tr{k} AS (SELECT substr(seq, i, {k}) AS ctx, substr(seq, i + {k}, 1) AS nxt, count(*) AS cnt FROM (SELECT left(seq, p) AS seq FROM cut), unnest(range(1, length(seq) - {k} + 1)) t(i) GROUP BY ALL), pr{k} AS (SELECT ctx, n AS nxt, coalesce(cnt, 0) AS cnt, (coalesce(cnt, 0) + 0.1::DOUBLE) / (sum(coalesce(cnt, 0)) OVER (PARTITION BY ctx) + 0.5::DOUBLE) AS prob FROM (SELECT DISTINCT ctx FROM tr{k}) CROSS JOIN unnest(['A','C','G','T','N']) t(n) LEFT JOIN tr{k} ON tr{k}.ctx = ctx AND tr{k}.nxt = n), bs{k} AS (SELECT ctx, arg_max(nxt, (prob, -strpos('ACGTN', nxt))) AS best FROM pr{k} GROUP BY ctx), ts{k} AS (SELECT substr(repeat('N', {k}) || seq, j, {k}) AS ctx, substr(seq, j, 1) AS nxt FROM cut, unnest(range(p + 1, length(seq) + 1)) t(j)), o{k} AS (SELECT {k} AS k, (SELECT sum(cnt)::BIGINT FROM tr{k}) AS n_train_trans, count(*) AS n_test, round(avg((coalesce(best, 'A') = t.nxt)::INT), 6) AS top1, round(avg(-log2(coalesce(prob, 0.2::DOUBLE))), 6) AS ce_bits FROM ts{k} t LEFT JOIN pr{k} USING (ctx, nxt) LEFT JOIN bs{k} ON bs{k}.ctx = t.ctx)"""


@query(f"""WITH {DNA}, cut AS (SELECT doc_id, seq, floor(length(seq) * (1.0::DOUBLE - 0.1::DOUBLE))::INTEGER AS p FROM dna), {', '.join(_holdout(k).replace(f'SELECT DISTINCT ctx FROM tr{k})', f'SELECT DISTINCT ctx FROM tr{k}) d{k}').replace(f'AS prob FROM (', f'AS prob FROM (').replace(f'SELECT ctx, n AS nxt, coalesce', f'SELECT d{k}.ctx, n AS nxt, coalesce').replace('PARTITION BY ctx) +', f'PARTITION BY d{k}.ctx) +').replace(f'tr{k}.ctx = ctx AND', f'tr{k}.ctx = d{k}.ctx AND') for k in (3, 4, 5))} SELECT * FROM o3 UNION ALL SELECT * FROM o4 UNION ALL SELECT * FROM o5""")
def agg15_markov_holdout(spark, d):
    s = dna(spark, d)
    out = kmers.held_out_markov(s, (3, 4, 5), tx.split_point(F.col("seq")))
    return out.withColumns({"top1": r6(F.col("top1")), "ce_bits": r6(F.col("ce_bits"))})


@query(f"""WITH {DNA}, w AS (SELECT doc_id, i - 1 AS pos, substr(seq, i, 10) AS kmer FROM dna, unnest(range(1, length(seq) - 8)) t(i)), l AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id, kmer ORDER BY pos) AS last FROM w) SELECT doc_id, pos::BIGINT AS pos, last::BIGINT AS last FROM l WHERE last IS NOT NULL""")
def join04_latest_earlier(spark, d):
    return kmers.latest_before(dna(spark, d), 10)


@query(f"""WITH {DNA}, c AS (SELECT doc_id, seq, floor(length(seq) * (1.0::DOUBLE - 0.1::DOUBLE))::INTEGER AS p FROM dna), w AS (SELECT doc_id, p, i - 1 AS pos, substr(seq, i, 8) AS ctx, substr(seq, i + 8, 1) AS nxt FROM c, unnest(range(1, length(seq) - 7)) t(i)), l AS (SELECT *, lag(nxt) OVER (PARTITION BY doc_id, ctx ORDER BY pos) AS said FROM w), q AS (SELECT count(said) AS n_occ, coalesce(sum((said = nxt)::INT), 0)::BIGINT AS n_hit FROM l WHERE pos + 8 >= p), n AS (SELECT sum(length(seq) - p)::BIGINT AS n_test FROM c) SELECT 8 AS k, n_test, n_occ, n_hit, round(n_occ::DOUBLE / nullif(n_test, 0), 6) AS occurrence_rate, round(n_hit::DOUBLE / nullif(n_occ, 0), 6) AS hit_rate_given_occ, round(n_hit::DOUBLE / nullif(n_test, 0), 6) AS hit_rate_overall FROM n, q""")
def agg16_lookup_holdout(spark, d):
    out = kmers.held_out_lookup(dna(spark, d), 8, tx.split_point(F.col("seq")))
    return out.withColumns({c: r6(F.col(c)) for c in ("occurrence_rate", "hit_rate_given_occ", "hit_rate_overall")})


@query(f"""WITH {_TRANS}, g AS (SELECT DISTINCT ctx, n AS nxt FROM tr, unnest(['A','C','G','T','N']) t(n)), f AS (SELECT g.ctx, g.nxt, (coalesce(cnt, 0) + 0.1::DOUBLE) / (sum(coalesce(cnt, 0)) OVER (PARTITION BY g.ctx) + 0.5::DOUBLE) AS prob FROM g LEFT JOIN tr USING (ctx, nxt)), q AS (SELECT item_id, lpad(right(translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC'), 3), 3, 'N') AS ctx FROM benchmark) SELECT item_id, n AS nxt, round(coalesce(prob, 0.2::DOUBLE), 6) AS prob FROM q CROSS JOIN unnest(['A','C','G','T','N']) t(n) LEFT JOIN f ON f.ctx = q.ctx AND f.nxt = n""")
def join07_model_lookup(spark, d):
    table = kmers.smoothed(kmers.transitions(dna(spark, d), 3))
    q = read(spark, d, "benchmark").select("item_id", F.lpad(F.right(tx.recode_letters(F.col("text")), F.lit(3)), 3, "N").alias("ctx"))
    grid = q.select("item_id", "ctx", F.explode(F.array(*map(F.lit, "ACGTN"))).alias("nxt"))
    return grid.join(table, ["ctx", "nxt"], "left").select("item_id", "nxt", r6(F.coalesce("prob", F.lit(0.2))).alias("prob"))


_PAIR = f"{DNA}, a AS (SELECT substr(seq, i, 3) AS m, count(*) AS n FROM dna, unnest(range(1, length(seq) - 1)) t(i) WHERE lang = 'en' GROUP BY 1), b AS (SELECT substr(seq, i, 3) AS m, count(*) AS n FROM dna, unnest(range(1, length(seq) - 1)) t(i) WHERE lang <> 'en' GROUP BY 1)"


@query(f"""WITH {_PAIR}, ta AS (SELECT sum(n) AS t FROM a), tb AS (SELECT sum(n) AS t FROM b) SELECT round(0.5 * sum(abs(coalesce(a.n, 0) / ta.t - coalesce(b.n, 0) / tb.t)), 6) AS tvd FROM a FULL JOIN b USING (m), ta, tb""")
def sta07_kmer_tvd(spark, d):
    s = dna(spark, d)
    a, b = (kmers.counts(s.where(c), 3, []) for c in ("lang = 'en'", "lang <> 'en'"))
    return kmers.variation(a, b, ["kmer"]).select(r6(F.col("tvd")).alias("tvd"))


@query(f"""WITH {_PAIR} SELECT coalesce(a.m, b.m) AS kmer, coalesce(a.n, 0)::BIGINT AS na, coalesce(b.n, 0)::BIGINT AS nb FROM a FULL JOIN b ON a.m = b.m""")
def join08_full_outer_kmers(spark, d):
    s = dna(spark, d)
    a, b = (kmers.counts(s.where(c), 3, []).withColumnRenamed("n", n) for c, n in (("lang = 'en'", "na"), ("lang <> 'en'", "nb")))
    return a.join(b, "kmer", "full_outer").select("kmer", F.coalesce("na", F.lit(0)).cast("long").alias("na"), F.coalesce("nb", F.lit(0)).cast("long").alias("nb"))


@query(f"""WITH {_PAIR} SELECT m AS kmer FROM a UNION SELECT m FROM b""")
def set04_key_union(spark, d):
    s = dna(spark, d)
    a, b = (kmers.windows(s.where(c), 3, []) for c in ("lang = 'en'", "lang <> 'en'"))
    return a.union(b).distinct()


def _walk() -> str:
    return f"""WITH RECURSIVE {_TRANS}, bs AS MATERIALIZED (SELECT ctx, arg_max(nxt, (cnt, -strpos('ACGTN', nxt))) AS best FROM tr GROUP BY ctx), w(name, ctx, tokens, i) AS (SELECT item_id, lpad(right(translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC'), 3), 3, 'N'), '', 0 FROM benchmark UNION ALL SELECT name, right(w.ctx, 2) || coalesce(best, 'A'), tokens || coalesce(best, 'A'), i + 1 FROM w LEFT JOIN bs ON bs.ctx = w.ctx WHERE i < 12) SELECT name, tokens FROM w WHERE i = 12"""


@query(_walk())
def st06_greedy_markov_walk(spark, d):
    from ..functions.decode import greedy_walk

    tr = kmers.transitions(dna(spark, d), 3)
    best = tr.groupBy("ctx").agg(F.max_by("nxt", F.struct("cnt", -F.instr(F.lit("ACGTN"), F.col("nxt")))).alias("best"))
    start = read(spark, d, "benchmark").select(F.col("item_id").alias("name"), tx.recode_letters(F.col("text")).alias("seq"))
    return greedy_walk(start, broadcast(best), 3, 12)


@query(_walk())
def st07_speculative_greedy(spark, d):
    """Draft-and-verify decoding with a shorter table as draft: greedy output equals the target's own."""
    from ..functions.decode import Markov, decode, markov_rows

    s = dna(spark, d)
    target = markov_rows(kmers.transitions(s, 3).select("ctx", "nxt", (F.col("cnt") * 1.0).alias("prob")))
    draft = markov_rows(kmers.transitions(s, 2).select("ctx", "nxt", (F.col("cnt") * 1.0).alias("prob")))
    prompts = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("name"), tx.recode_letters(F.col("text")).alias("seq"))
    out = decode(prompts, lambda: (Markov(3, target), Markov(2, draft)), 12, 4)
    return out.select(F.col("name").cast("long").alias("name"), "tokens")


@query(f"""WITH {DNA} SELECT doc_id, '>' || doc_id || chr(10) || rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) AS v FROM dna""")
def snk06_fasta_wrap(spark, d):
    return dna(spark, d).select("doc_id", F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), tx.wrap(F.col("seq"))).alias("v"))


@query(f"""WITH {DNA} SELECT doc_id, source, length(seq)::INTEGER AS length, sha256(seq) AS sha256 FROM dna""")
def snk07_design_table(spark, d):
    return dna(spark, d).select("doc_id", "source", F.char_length("seq").alias("length"), F.sha2("seq", 256).alias("sha256"))


@query("""SELECT doc_id, list_reduce(list_transform(range(0, 24), lambda i: substr('ACGT', ((doc_id * 24 + i) * 2654435761 % 4294967296 * 69069 % 4294967296 // 1073741824 + 1)::INTEGER, 1)), lambda a, b: a || b) AS seq FROM documents""")
def src21_synthetic_sequences(spark, d):
    base = lambda i: (F.col("doc_id") * 24 + i) * 2654435761 % 4294967296 * 69069 % 4294967296
    chars = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.substring(F.lit("ACGT"), F.floor(base(i) / 1073741824).cast("int") + 1, F.lit(1)))
    return read(spark, d, "documents").select("doc_id", F.array_join(chars, "").alias("seq"))


@query(None)
def fn11_arrays_crc(spark, d):
    """Chained checksums of arrays equal the checksum of their concatenation."""
    e = read(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return e.select("doc_id", F.lower(F.lpad(F.hex(F.crc32(F.concat("b", "b"))), 8, "0")).alias("crc"))


@query(None)
def fn23_candidate_seeds(spark, d):
    """Reproducible 63-bit seeds by (design, round, parent, candidate); distinct over the grid."""
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("design"))
    g = b.select("design", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i"))
    return g.select("design", "i", F.shiftrightunsigned(F.xxhash64("design", F.floor(F.col("i") / 15), F.col("i") % 15), 1).alias("seed"))


@query(None)
def st09_beam_search(spark, d):
    """Three rounds over all items: four extensions a beam, a toy loss, the best two a round."""
    from ..operators.designs import beam_search

    start = read(spark, d, "benchmark").select(F.col("item_id").alias("design"), F.lit(0).alias("idx"), F.lit("").alias("state"))

    def expand(beam, r):
        rows = beam.select("design", F.col("idx").alias("parent"), F.col("state").alias("s"), F.posexplode(F.array(*map(F.lit, "ACGT"))).alias("k", "b"))
        return rows.select("design", (F.col("parent") * 4 + F.col("k")).alias("idx"), "parent", F.concat("s", "b").alias("state"))

    def score(rows):
        return rows.withColumn("loss", (F.crc32(F.concat(F.col("design").cast("string"), "state")) % 1000) / 1000.0)

    return beam_search(spark, start, expand, score, 3, 2).select("design", "round", "rank", "state", "loss")


@query(None)
def udf04_multi_candidate_verify(spark, d):
    """Greedy verification of two drafts an item in Arrow batches."""
    import numpy as np
    import pandas as pd

    from ..functions.decode import verify_greedy

    def run(batches):
        for b in batches:
            rows = []
            for i in b["item_id"]:
                rng = np.random.default_rng(i)
                v = verify_greedy(rng.integers(0, 3, (2, 3)), rng.random((2, 4, 3)))
                rows.append((i, v.accepted, v.winner, v.tokens))
            yield pd.DataFrame(rows, columns=["item_id", "accepted", "winner", "tokens"])

    return read(spark, d, "benchmark").select("item_id").mapInPandas(run, "item_id long, accepted int, winner int, tokens array<int>")
