"""Writers: FASTA, design tables, records by species, verified shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import wrap
from ..operators.curate import shard_layout


def fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 80) -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrap(F.col(seq), width)).alias("value")).write.text(path)


def design_table(df: DataFrame, path: str, seq: str = "sequence") -> None:
    df.withColumn("sha256", F.sha2(seq, 256)).write.option("sep", "\t").option("header", "true").csv(path)


def by_species(df: DataFrame, path: str) -> None:
    """One folder a species; existing output stays."""
    df.write.mode("ignore").partitionBy("species").json(path)


def sidecar(rows: DataFrame, keys: list[str], n: str, payload: str) -> DataFrame:
    """(keys, n_pos, crc32) of each shard; the checksum is the sum of the payloads' own, so no shard is gathered or ordered."""
    sums = F.sum(F.crc32(F.col(payload).cast("binary")))
    return rows.groupBy(*keys).agg(F.sum(n).alias("n_pos"), F.lower(F.lpad(F.hex(F.pmod(sums, F.lit(1 << 32))), 8, "0")).alias("crc32"))


def shards(df: DataFrame, path: str, group: list[str], order: str, n: str, size: int) -> None:
    """Rows laid out in shards of ``size`` positions, one folder a group and shard."""
    layout = shard_layout(df, group, order, n, size)
    df.join(layout.drop("n_pos").withColumnRenamed("first", "__first"), [*group, order]).write.partitionBy(*group, "shard_idx").parquet(path)


def shard_problems(df: DataFrame, probs: str, resid: str, idx: str, tolerance: float = 0.02) -> DataFrame:
    """Rows whose stored mass and residual don't add up to one, or whose indices and values differ in number."""
    mass = F.aggregate(F.col(probs), F.lit(0.0), lambda s, x: s + x) + F.col(resid)
    return df.where((F.abs(mass - 1) > tolerance) | (F.size(probs) != F.size(idx)))


def trajectory(spark: SparkSession, rounds: str, root: str, schema: str) -> DataFrame:
    """All records of a growing folder of JSON lines, appended to the trajectory below ``root`` once each, whatever crashes.

    A file stream notes in its checkpoint which files it has taken and its sink which it has written, so a run that was cut
    off is taken up where it stopped, and a reader sees committed files alone.
    """
    stream = spark.readStream.schema(schema).json(rounds)
    q = stream.writeStream.format("json").outputMode("append").option("path", f"{root}/records").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).json(f"{root}/records")
