"""Source queries: the tables are written in a source's format into the shared folder and read back by the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_folder
from ..sources import files, sinks
from .base import DNA, dna, query, read


def _store(spark, path):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _renamed(spark, root, ending):
    """Part files below a folder get names that say what they hold: the value of their folder, a number and ``ending``."""
    for n, path in enumerate(sorted(p for p in files.listing(spark, root) if "/part-" in p)):
        store, at = _store(spark, path)
        folder = at.getParent()
        name = folder.getName().split("=")[-1]
        store.rename(at, _store(spark, f"{folder}/{name}_{n}{ending}")[1])


@query(f"WITH {DNA} SELECT md5(seq) AS h, length(seq)::BIGINT AS n FROM dna WHERE seq <> ''")
def src01_fasta(spark, d):
    """All sequences through FASTA files wrapped at 80."""
    root = new_folder(spark, "fasta")
    sinks.fasta(dna(spark, d).where("seq <> ''").select(F.col("doc_id").cast("string").alias("name"), "seq"), root)
    return files.fasta(spark, root).select(F.md5("raw").alias("h"), F.char_length("raw").cast("long").alias("n"))


@query(f"WITH {DNA} SELECT doc_id % 2 AS kind, md5(seq) AS h FROM dna WHERE seq <> ''")
def src02_csv(spark, d):
    """Sequences from CSV files: a named column among others, and an only column of any name."""
    rows, root = dna(spark, d).where("seq <> ''"), new_folder(spark, "csv")
    rows.where("doc_id % 2 = 0").select("doc_id", F.col("seq").alias("Sequence"), "lang").write.option("header", True).csv(f"{root}/many")
    rows.where("doc_id % 2 <> 0").select(F.col("seq").alias("whatever")).write.option("header", True).csv(f"{root}/one")
    many, one = (files.csv(spark, f"{root}/{x}").select(F.lit(k).cast("long").alias("kind"), F.md5("raw").alias("h")) for k, x in enumerate(("many", "one")))
    return many.unionByName(one)


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(translate(regexp_replace(text, '[ \t\r\n]', '', 'g'), 'acgtn', 'ACGTN'), '[^ACGTN]', 'N', 'g') AS seq FROM documents) SELECT doc_id % 2 AS kind, md5(seq) AS h FROM c WHERE seq <> ''""")
def src03_load_by_name(spark, d):
    """Raw letters through gzip CSV and gzip FASTA, cleaned on the way in; the name of the path says which it is."""
    raw = read(spark, d, "documents").select("doc_id", F.translate("text", " \t\r\n>", "    N").alias("seq"))
    root = new_folder(spark, "load")
    raw.where("doc_id % 2 = 0").select("seq").write.option("header", True).option("compression", "gzip").csv(f"{root}/a.csv")
    text = raw.where("doc_id % 2 <> 0").select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), "seq").alias("value"))
    text.write.option("compression", "gzip").text(f"{root}/b.fa.gz")
    a, b = (files.load(spark, f"{root}/{x}").select(F.lit(k).cast("long").alias("kind"), F.md5("seq").alias("h")) for k, x in enumerate(("a.csv", "b.fa.gz")))
    return a.unionByName(b)


@query(f"WITH {DNA} SELECT CASE WHEN doc_id % 3 = 0 THEN 'hg38' ELSE 'id' || doc_id END AS name, 'chr' || doc_id % 22 || ':' || doc_id * 10 || '-' || doc_id * 10 + length(seq) AS source, md5(seq) AS h FROM dna WHERE seq <> ''")
def src05_genome_csv(spark, d):
    """Regions of a genome from CSV: source is chrom:start-end, rows without an id are named by their number in the file."""
    root, i = new_folder(spark, "genome"), F.col("doc_id")
    rows = dna(spark, d).where("seq <> ''").select(
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("id"), i.cast("string"))).alias("id"), F.concat(F.lit("chr"), (i % 22).cast("string")).alias("chrom"),
        (i * 10).alias("start"), (i * 10 + F.char_length("seq")).alias("end"), "seq",
    )
    rows.write.option("header", True).csv(root)
    name = F.when(F.regexp_like("name", F.lit(r"^hg38_\d+$")), "hg38").otherwise(F.col("name"))
    return files.genome_csv(spark, root).select(name.alias("name"), "source", F.md5("seq").alias("h"))


@query(r"""WITH c AS (SELECT item_id, regexp_replace(translate(regexp_replace(text, '[ \t\r\n]', '', 'g'), 'acgtn', 'ACGTN'), '[^ACGTN]', 'N', 'g') AS seq FROM benchmark) SELECT 'item' || item_id AS name, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE '' END AS source, md5(seq) AS h FROM c WHERE seq <> ''""")
def src06_samples(spark, d):
    """A samples file is one JSON map; half of its values are objects with a source, the others bare sequences."""
    root, b = new_folder(spark, "samples"), read(spark, d, "benchmark")
    value = F.when(F.col("item_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("seq"), F.lit("even").alias("source")))).otherwise(F.to_json(F.array("text")))
    value = F.when(F.col("item_id") % 2 == 0, value).otherwise(F.substring(value, F.lit(2), F.char_length(value) - 2))
    pair = F.concat(F.lit('"item'), F.col("item_id").cast("string"), F.lit('": '), value)
    b.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(pair), ", "), F.lit("}")).alias("value")).coalesce(1).write.text(root)
    return files.samples(spark, root).select("name", "source", F.md5("seq").alias("h"))


@query(f"WITH {DNA} SELECT lang, count(*) AS n, sum(length(seq))::BIGINT AS symbols, min(md5(seq)) AS least, max(md5(seq)) AS most FROM dna WHERE seq <> '' AND lang <> 'fr' GROUP BY lang")
def src07_fasta_directory(spark, d):
    """A tree of FASTA files, one folder a language; files that are still being downloaded and others by name are left out."""
    root, rows = new_folder(spark, "tree"), dna(spark, d).where("seq <> ''")
    lines = rows.select("lang", F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), "seq").alias("value"))
    lines.write.partitionBy("lang").text(root)
    _renamed(spark, root, ".fa")
    for path in [p for p in files.listing(spark, root) if "/lang=fr/" in p and p.endswith(".fa")]:
        store, at = _store(spark, path + ".aria2")
        store.create(at).close()
    found = files.fasta_directory(spark, root).withColumn("lang", F.regexp_extract("source", r"lang=([^/]*)/", 1))
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("seq")).alias("symbols"), F.min(F.md5("seq")).alias("least"), F.max(F.md5("seq")).alias("most"))


@query(f"WITH {DNA} SELECT 'r' || doc_id AS name, lang AS source, md5(seq) AS h FROM dna WHERE seq <> ''")
def src08_species_lines(spark, d):
    """Coding records as JSON lines by species; what is there already is not written again."""
    root = new_folder(spark, "species")
    rows = dna(spark, d).select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("species"), "seq")
    sinks.by_species(rows, root)
    sinks.by_species(rows.withColumn("seq", F.lit("ACGT")), root)  # a second run changes nothing
    return files.species_lines(spark, root).select("name", "source", F.md5("seq").alias("h"))


@query("SELECT source || CASE WHEN source LIKE '%1' THEN '_train' ELSE '' END AS name, source LIKE '%1' AS train, source NOT LIKE '%3' AND source NOT LIKE '%5' AS intact, source NOT LIKE '%3' AND source NOT LIKE '%5' AS intact_by_reader FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def src11_inventory(spark, d):
    """Chunk files, one a source: some have a marker of an unfinished download, some are cut off in the middle.  Checked twice: by
    unpacking their content, and as files too large for that are, by reading them to their end."""
    root = new_folder(spark, "chunks")
    docs = read(spark, d, "documents").where("source IS NOT NULL")
    name = F.concat("source", F.when(F.endswith("source", F.lit("1")), "_train").otherwise(""))
    docs.select(name.alias("file"), "text").repartition("file").write.option("compression", "gzip").partitionBy("file").json(root)
    _renamed(spark, root, ".jsonl.gz")
    for path in [p for p in files.listing(spark, root) if p.endswith(".jsonl.gz")]:
        store, at = _store(spark, path)
        if at.getParent().getName().endswith("3"):
            other = _store(spark, path + ".aria2")[1]
            store.create(other).close()
        elif at.getParent().getName().endswith("5"):
            _cut(spark, path)
    found = [files.inventory(spark, root, **x).select(F.regexp_extract("path", r"file=([^/]*)/", 1).alias("name"), "train", F.col("intact").alias(n)) for x, n in (({}, "intact"), ({"limit": 1}, "intact_by_reader"))]
    return found[0].join(found[1], ["name", "train"])


def _cut(spark, path):
    """The first half of a file in its place."""
    store, at = _store(spark, path)
    half = store.getFileStatus(at).getLen() // 2
    into = _store(spark, path + ".half")[1]
    source, sink = store.open(at), store.create(into)
    spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(source, sink, 0, half)
    source.close()
    sink.close()
    store.delete(at, False)
    store.rename(into, at)


@query("SELECT 'p' || item_id AS name, left(text, 40) AS seq FROM benchmark WHERE item_id IN (9, 3, 5)")
def src14_prompt_pack(spark, d):
    """Some prompts of a pack by name, cut to the context."""
    root, b = new_folder(spark, "pack"), read(spark, d, "benchmark")
    prompt = F.struct(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("name"), F.lit("coding").alias("region"), F.lit("items").alias("source"), F.char_length("text").alias("orig_len"), F.col("text").alias("seq"))
    b.agg(F.to_json(F.struct(F.struct(F.lit(1).alias("version")).alias("meta"), F.collect_list(prompt).alias("prompts"))).alias("value")).coalesce(1).write.text(root)
    return files.prompt_pack(spark, root, ["p3", "p9", "p5"], 40).select("name", "seq")


@query(f"WITH {DNA} SELECT 'genome' AS kind, md5(seq) AS h FROM dna WHERE seq <> '' AND lang = 'en' UNION ALL SELECT 'tree', md5(seq) FROM dna WHERE seq <> '' AND lang = 'de' UNION ALL SELECT 'samples', md5('ACGT' || repeat('T', item_id::INTEGER)) FROM benchmark")
def src22_default_union(spark, d):
    """The default corpus: regions of a genome, a map of samples and a folder of FASTA files together."""
    root, rows = new_folder(spark, "corpus"), dna(spark, d).where("seq <> ''")
    place = [F.col("doc_id").alias(c) for c in ("start", "end")]
    rows.where("lang = 'en'").select(F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("id"), F.lit("chr1").alias("chrom"), *place, "seq").write.option("header", True).csv(f"{root}/genome")
    item = F.concat(F.lit('"s'), F.col("item_id").cast("string"), F.lit('": "ACGT'), F.repeat(F.lit("T"), F.col("item_id").cast("int")), F.lit('"'))
    read(spark, d, "benchmark").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(item), ", "), F.lit("}")).alias("value")).coalesce(1).write.text(f"{root}/samples")
    sinks.fasta(rows.where("lang = 'de'").select(F.col("doc_id").cast("string").alias("name"), "seq"), f"{root}/tree")
    _renamed(spark, f"{root}/tree", ".fasta")
    got = files.default_corpus(spark, f"{root}/genome", f"{root}/samples", f"{root}/tree")
    kind = F.when(F.startswith("source", F.lit("chr1:")), "genome").when(F.col("source") == "", "samples").otherwise("tree")
    return got.select(kind.alias("kind"), F.md5("seq").alias("h"))
