"""Sequence files: FASTA, CSV, JSON and JSON lines, plain or gzip, in any store Spark reads."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean

CSV_COLUMNS = ("seq", "sequence", "dna")
FASTA_GLOB = "*.{fa,fasta,fna,fa.gz,fasta.gz,fna.gz}"
RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "species", "seq")])
GENOME = T.StructType([T.StructField("record", T.StringType()), T.StructField("text", T.StringType())])


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """Rows of a file source (with its _metadata still at hand) with path and ``out``, each row's number in its file, from 0.

    A file may be read in many splits, in any order: rows are counted by split, the counts summed in order of the splits'
    places in the file, and a row's number in its split comes from its running id.  Only one row a split is shuffled.
    """
    cols = rows.columns
    rows = rows.select(*[F.col(f"`{c}`") for c in cols], F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__start"))
    rows = rows.withColumn("__id", F.monotonically_increasing_id())
    per = rows.groupBy("path", "__start").agg(F.min("__id").alias("__least"), F.count("*").alias("__n"))
    before = Window.partitionBy("path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("path", "__start", "__least", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = rows.join(per, ["path", "__start"])
    return rows.select(*[F.col(f"`{c}`") for c in cols], "path", (F.col("__id") - F.col("__least") + F.col("__before")).alias(out))


def fasta(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, row_seq, raw): records of FASTA files; headers go, text before the first header is record 0.

    Records are read one a row, split at a ``>`` that begins a line (lines end in LF or CRLF), so a plain file is read in
    many splits and no row holds more than a record; a gzip file is one split, since it has to be read from its start.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", FASTA_GLOB)
    rows = numbered(reader.text(path, lineSep="\n>"), "__i")
    headed = F.startswith("value", F.lit(">"))
    first = rows.where("__i = 0").select("path", headed.alias("__headed"))
    rows = rows.join(first, "path")  # one row a file
    inside = (F.col("__i") > 0) | F.col("__headed")
    body = F.when(inside, F.regexp_replace("value", r"^[^\n]*(\n|$)", "")).otherwise(F.col("value"))
    number = F.col("__i") + F.col("__headed").cast("int")
    return rows.select("path", number.cast("int").alias("row_seq"), F.translate(body, "\r\n", "").alias("raw")).where("raw <> ''")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """(raw): the sequence column by its name in any case, else the only column."""
    rows = spark.read.csv(path, header=True)
    named = [c for c in rows.columns if c.lower() in CSV_COLUMNS]
    order = sorted(named, key=lambda c: CSV_COLUMNS.index(c.lower()))
    if not order and len(rows.columns) != 1:
        raise ValueError(f"no sequence column among {rows.columns}")
    return rows.select(F.col(f"`{(order or rows.columns)[0]}`").alias("raw"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """(seq): cleaned, without empty ones; the format follows the name, .gz is transparent."""
    name = path.lower().removesuffix(".gz")
    raw = csv(spark, path) if name.endswith(".csv") else fasta(spark, path)
    return raw.select(clean(F.col("raw")).alias("seq")).where("seq <> ''")


def genome_csv(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, source) with source chrom:start-end; an empty id becomes hg38_ and the row's number in its file."""
    read = spark.read.csv(path, header=True)
    rows = numbered(read, "__i")
    number = F.concat(F.lit("hg38_"), F.col("__i").cast("string"))
    ident = F.coalesce(F.nullif(F.col("id"), F.lit("")), number) if "id" in read.columns else number
    place = [F.coalesce(F.col(c), F.lit("")) if c in read.columns else F.lit("") for c in ("chrom", "start", "end")]
    out = rows.select(ident.alias("name"), clean(F.col("seq")).alias("seq"), F.concat(place[0], F.lit(":"), place[1], F.lit("-"), place[2]).alias("source"))
    return out.where("seq <> ''")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, source) from a JSON map of name to sequence, or to {seq, source}."""
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "v"))
    inner = F.from_json("v", "seq string, source string")
    obj = F.regexp_like("v", F.lit(r"^\s*\{"))
    out = pairs.select("name", clean(F.when(obj, inner["seq"]).otherwise(F.col("v"))).alias("seq"), F.when(obj, F.coalesce(inner["source"], F.lit(""))).otherwise(F.lit("")).alias("source"))
    return out.where("seq <> ''")


def listing(spark: SparkSession, root: str) -> list[str]:
    """Paths of all files below a folder, empty ones too, which Spark's readers leave out."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        out.append(files.next().getPath().toString())
    return out


def fasta_directory(spark: SparkSession, root: str) -> DataFrame:
    """(name, seq, source) of all FASTA files below a folder; files with an unfinished-download marker are left out."""
    found = fasta(spark, root, recursive=True)
    busy = [re.sub("^file:/+", "/", p[: -len(".aria2")]) for p in listing(spark, root) if p.endswith(".aria2")]
    kept = found.where(~F.regexp_replace("path", "^file:/+", "/").isin(busy)) if busy else found
    file = F.element_at(F.split("path", "/"), -1)
    return kept.select(F.concat(file, F.lit(":"), F.col("row_seq").cast("string")).alias("name"), clean(F.col("raw")).alias("seq"), F.col("path").alias("source")).where("seq <> ''")


def default_corpus(spark: SparkSession, genome: str, pack: str, tree: str | None = None) -> DataFrame:
    """(name, seq, source): a genome's regions, the samples, and the files of a folder if there is one, one after the other."""
    rows = genome_csv(spark, genome).unionByName(samples(spark, pack))
    return rows.unionByName(fasta_directory(spark, tree)) if tree else rows


def species_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, source) of coding records in JSON lines."""
    rows = spark.read.schema(RECORD).json(path).where("seq IS NOT NULL")
    return rows.select("name", clean(F.col("seq")).alias("seq"), F.col("species").alias("source")).where("seq <> ''")


def genome_lines(spark: SparkSession, path: str, finished: bool = False) -> DataFrame:
    """(path, record, text) of JSON lines; broken rows and empty texts are skipped, a missing record is ''.

    A line that is broken off is skipped, a gzip file that is broken off is an error of the read.  ``finished`` checks all
    files of the folder ``path`` first, and fails with the names of those that aren't whole.
    """
    if finished:
        unfinished = inventory(spark, path, "*.jsonl*").where("NOT intact").select("path").limit(20)
        if bad := sorted(r[0] for r in unfinished.collect()):
            raise ValueError(f"unfinished files: {bad}")
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), parse_genome_line(F.col("value")).alias("r"))
    return rows.where("r.text IS NOT NULL AND r.text <> ''").select("path", F.coalesce("r.record", F.lit("")).alias("record"), "r.text")


def parse_genome_line(c):
    return F.from_json(c, GENOME, {"mode": "PERMISSIVE"})


def prompt_pack(spark: SparkSession, path: str, names: list[str] | None = None, ctx: int | None = None) -> DataFrame:
    """(pos, name, region, source, seq) of a pack; names asked for must be there, sequences must reach ctx."""
    rows = spark.read.option("multiLine", "true").json(path).select(F.posexplode("prompts").alias("pos", "p")).select("pos", "p.name", "p.region", "p.source", "p.seq")
    if names is not None:
        have = {r[0] for r in rows.select("name").collect()}  # a pack holds tens of prompts
        if missing := sorted(set(names) - have):
            raise ValueError(f"prompts not in the pack: {missing}")
        rows = rows.where(F.col("name").isin(names))
    if ctx:
        cut = F.when(F.char_length("seq") < ctx, F.raise_error(F.concat(F.lit("prompt too short: "), F.col("name")))).otherwise(F.left("seq", F.lit(ctx)))
        rows = rows.withColumn("seq", cut.cast("string"))
    return rows


def results(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """Result records of one stage with their file."""
    return spark.read.option("multiLine", "true").json(f"{root}/*/result.json").withColumn("file", F.input_file_name()).where(F.col("stage") == stage)


def track_index(spark: SparkSession, path: str, accession: str) -> int:
    """0-based row of the one line of a table that has the accession in a cell."""
    rows = spark.read.option("sep", "\t").option("header", "true").csv(path)
    hit = F.lit(False)
    for c in rows.columns:
        hit = hit | F.coalesce(F.col(f"`{c}`") == accession, F.lit(False))
    found = [r[0] for r in numbered(rows, "__n").where(hit).select("__n").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{accession} is in {len(found)} rows")
    return found[0]


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, crc32) of whole files."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"), F.crc32("content").alias("crc32"))


def intact(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the manifest (path, sha256) that are missing or differ."""
    j = manifest.alias("m").join(files.alias("f"), "path", "left")
    return j.where(~F.coalesce(F.col("m.sha256") == F.col("f.sha256"), F.lit(False))).select("path", F.when(F.col("f.sha256").isNull(), "missing").otherwise("changed").alias("problem"))


def _unpacks(content: memoryview, step: int = 1 << 20) -> bool:
    """All members of a gzip file end, with the right checksums and lengths; what comes out is not kept."""
    at = 0
    while at < len(content):
        member = zlib.decompressobj(31)
        try:
            while at < len(content) and not member.eof:
                piece = content[at : at + step]
                at += len(piece)
                while len(piece) and not member.eof:
                    member.decompress(piece, 4 * step)
                    piece = member.unconsumed_tail
        except zlib.error:
            return False
        if not member.eof:
            return False
        at -= len(member.unused_data)
    return len(content) > 0


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        whole = [_unpacks(memoryview(x.as_buffer())) for x in b.column("content")]
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(whole, pa.bool_())], ["path", "whole"])


def inventory(spark: SparkSession, root: str, pattern: str = "*.jsonl.gz", limit: int = 1 << 30) -> DataFrame:
    """(path, length, modified, train, intact) of chunk files.

    A file is intact if no marker of an unfinished download stands beside it, and a gzip file if it unpacks to its end with
    the right checksums.  Files over ``limit`` bytes don't fit into a row: Spark's reader streams them to their end instead.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    rows = read.load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    packed = read.load(root).where((F.col("length") <= limit) & F.endswith("path", F.lit(".gz"))).select("path", "content")
    checked = packed.mapInArrow(_whole, "path string, whole boolean")
    busy = [re.sub("^file:/+", "/", p[: -len(".aria2")]) for p in listing(spark, root) if p.endswith(".aria2")]
    marked = F.regexp_replace("path", "^file:/+", "/").isin(busy) if busy else F.lit(False)
    whole = F.when(F.endswith("path", F.lit(".gz")), F.col("whole")).otherwise(F.lit(True))
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.join(checked, "path", "left")
    large = [r[0] for r in read.load(root).select("path", "length").where((F.col("length") > limit) & F.endswith("path", F.lit(".gz"))).select("path").collect()]
    if large:  # a few files: their names are on the driver, their content isn't
        broken = unreadable(spark, large)
        rows = rows.withColumn("whole", F.coalesce("whole", ~F.col("path").isin(broken) if broken else F.lit(True)))
    return rows.select("path", "length", "modified", F.contains(name, F.lit("train")).alias("train"), F.when(marked, False).otherwise(whole).alias("intact"))


def unreadable(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that cannot be read to their end, found by halves: whole ones together are one job."""
    try:
        spark.read.text(paths).agg(F.count("*")).collect()
        return []
    except Exception as e:
        if not re.search("FAILED_READ_FILE|EOFException|ZipException|IOException", str(e)):
            raise
        if len(paths) == 1:
            return paths
    half = len(paths) // 2
    return unreadable(spark, paths[:half]) + unreadable(spark, paths[half:])


def select_chunks(available: DataFrame, only: list[str]) -> DataFrame:
    """The files of an allow-list by name; a name that isn't there is an error."""
    name = F.element_at(F.split("path", "/"), -1)
    kept = available.withColumn("file", name).where(F.col("file").isin(only))
    if missing := sorted(set(only) - {r[0] for r in kept.select("file").distinct().collect()}):
        raise ValueError(f"files not found: {missing}")
    return kept
