"""Operator 3: token counts of flat, unindexed token files by separator scan.

A token file is nothing but little-endian ids, documents ended by a separator id.  ``scan`` cuts files of any size into
blocks, searches each block for the separator with one vectorised comparison, and keeps of a block only how many separators
it holds and where the first and last lie.  A prefix scan over these summaries gives every block its first document's
number and the position of the last separator before it, which stitches documents that run over block ends; document
lengths are then differences of neighbouring positions.  Tokens after a file's last separator form one more document,
marked unfinished.

``write_token_files`` makes such files from texts (one per task, named by its partition and renamed into place when whole,
so that a task that runs twice leaves one file), with a table of the documents in their order.

Defined cases: null and empty texts have no token; an empty file or table gives no rows; a file whose size is no multiple of
the id width is an error; repeated rows are documents of their own; very long texts are encoded one at a time; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import base64
import importlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, materialize, shared_dir
from .words import pieces

SEPARATOR = 50256
BLOCK = 1 << 22
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _filesystem(uri: str):
    """(file system, path) of a file that tasks share; local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def _encoder(vocabulary: str) -> Callable[[list[str]], list[list[int]]]:
    import tiktoken

    files = importlib.import_module("public_tokenizers")
    with open(files.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    own = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [own.encode_ordinary(t) for t in texts]


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """Writes 16-bit token files into ``folder`` (a URI) and returns (file, doc, doc_id), doc counted from 0 in a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.bin"
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        own = f"{root}/.{name}.{task.taskAttemptId()}"
        encode, at, size = _encoder(vocabulary), 0, 0
        with store.open_output_stream(own) as out:
            for b in pieces(batches):
                texts = [t or "" for t in b.column("text").to_pylist()]
                for ids in encode(texts):
                    ids.append(separator)
                    out.write(np.array(ids, "<u2").tobytes())
                    size += len(ids)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(at, at + n)), b.column("doc_id")], ["file", "doc", "doc_id"])
                at += n
        store.move(own, f"{root}/{name}") if at else store.delete_file(own)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, doc long, doc_id long")
    return materialize(rows, "documents-in-files")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, size) of the token files in a folder; their content isn't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"))


def find_separators(ids: np.ndarray, separator: int) -> np.ndarray:
    return np.flatnonzero(ids == separator)


def scan(files: DataFrame, separator: int = SEPARATOR, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, doc, first, n_tokens, finished) for every document of the files (path, file, size)."""
    block -= block % width
    checked = F.when(F.col("size") % width != 0, F.raise_error(F.concat(F.lit("not a whole number of ids: "), "path"))).otherwise(F.col("size"))
    blocks = files.where("size > 0").withColumn("size", checked.cast("long"))
    blocks = blocks.select("path", "file", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - width, F.lit(block).cast("long"))).alias("block", "start"))
    blocks = blocks.repartition("file", "block")
    kind = f"<u{width}"

    def read(path: str, start: int, size: int) -> np.ndarray:
        store, p = _filesystem(path)
        with store.open_input_file(p) as f:
            f.seek(start)
            return np.frombuffer(f.read(min(block, size - start)), kind)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at = find_separators(read(r["path"], r["start"], r["size"]), separator) + r["start"] // width
                row = [[r["file"]], [r["block"]], [r["size"] // width], [at.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["file", "block", "tokens", "at"])

    found = materialize(blocks.mapInArrow(summarise, "file string, block long, tokens long, at array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n, last = F.size("at"), F.element_at(F.col("at"), -1)
    carry = found.select("file", "block", "tokens", n.alias("n"), F.when(n > 0, last).alias("last"))
    carry = carry.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("docs"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open"))
    whole = found.join(carry, ["file", "block"]).select("file", "docs", "open", F.col("at"), F.posexplode("at").alias("i", "end"))
    first = F.when(F.col("i") == 0, F.col("open")).otherwise(F.get("at", F.col("i") - 1)) + 1
    done = whole.select("file", (F.col("docs") + F.col("i")).alias("doc"), first.alias("first"), (F.col("end") - first).alias("n_tokens"), F.lit(True).alias("finished"))
    tail = found.groupBy("file").agg(F.sum(n).cast("long").alias("doc"), F.coalesce(F.max(F.when(n > 0, last)), F.lit(-1)).alias("open"), F.max("tokens").alias("tokens"))
    tail = tail.where("tokens > open + 1").select("file", "doc", (F.col("open") + 1).alias("first"), (F.col("tokens") - F.col("open") - 1).alias("n_tokens"), F.lit(False).alias("finished"))
    return done.unionByName(tail)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, n_tokens of every document: texts become flat token files, whose documents the scan finds again."""
    folder = f"{shared_dir(docs.sparkSession)}/strandlake-tokens-{uuid.uuid4().hex}"
    try:
        names = write_token_files(docs, folder, vocabulary, separator)
        if names.isEmpty():
            return names.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
        found = scan(token_files(docs.sparkSession, folder), separator)  # what it found is written: the files aren't read again
    finally:
        delete(docs.sparkSession, folder)
    return names.join(found, ["file", "doc"]).select("doc_id", "n_tokens")
