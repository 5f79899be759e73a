"""Shared plumbing: tables, the shared folder, and prefix sums that no single task has to hold."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the contracts: code points other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and all tasks run in the driver's process (tests, a laptop) is a local one made.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandlake-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


#: Paths to delete, one list for each open ``scratch``, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside go when it ends, however it ends, but for those with ``keep``.

    So an operator of many steps leaves only what its result still reads; nothing lazy that reads the rest may leave.
    """
    mine: list[str] = []
    held = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(held)
        for path in mine:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage is cut, lost executors cost nothing.

    It lives as long as the scope of ``scratch`` around it, with ``keep`` as long as the next scope out.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake-{tag}-{uuid.uuid4().hex}"
    scopes = _OPEN.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    with _settings(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Arrow batches of materialised queries in bytes, unless the session says: they are twice in memory, for each core.
ARROW_BYTES = 16 << 20


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside delete their shuffle files at their end (what they made is in the shared folder then), and
    send Arrow batches of bounded bytes."""
    mine = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) is None:
        mine[size] = str(ARROW_BYTES)
    before = {name: spark.conf.get(name, None) for name in mine}
    for name, value in mine.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def literal_rows(spark: SparkSession, rows: str, schema: str) -> DataFrame:
    """A small driver-made table from a JSON array; stays inside the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<{schema}>>")))


def prefix_sums(df: DataFrame, keys: list[str], block: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Inclusive running sum ``out`` of ``value`` over (block, order) within ``keys``.

    Two levels: sums per (keys, block) become offsets in a window over the few blocks of a key, and a second window
    runs inside one block only, so a key that holds a third of all rows is still dealt over its blocks. ``keys`` and
    ``block`` must not be null.
    """
    offs = df.groupBy(*keys, block).agg(F.sum(value).alias("__sum"))
    over = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offs = offs.select(*keys, block, F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__off"))
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(offs, [*keys, block]).withColumn(out, F.col("__off") + F.sum(value).over(inner)).drop("__off")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops input columns that clash (in any case) with an operator's output: the operator's column wins."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it has at most ``rows`` rows; else as it is, for a keyed join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bits of a ``marks`` table: 4 MB at most, however many keys are marked.
MARKS = 1 << 25
#: Bits of one row of it, as Spark's bitmap functions cut them.
_BITS = 8 * 4096


def _bit(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(MARKS))


def marks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A bitmap of fixed size over the hashes of ``keys``, at most MARKS / 32768 rows; a help for ``marked``."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(MARKS)) + 1
    return rows.groupBy(F.bitmap_bucket_number(bit).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("__bits"))


def marked(rows: DataFrame, keys: list[str], table: DataFrame, name: str) -> DataFrame:
    """Adds boolean ``name``: false only for keys that were not marked, true for all that were (and for few others).

    So a join that concerns few rows need not shuffle the others.
    """
    rows = rows.withColumn("__bit", _bit(keys))
    rows = rows.withColumn("__bucket", (F.floor(F.col("__bit") / _BITS) + 1).cast("long"))
    byte = f"conv(hex(substring(__bits, cast(floor(__bit % {_BITS} / 8) AS int) + 1, 1)), 16, 10)"
    on = F.expr(f"coalesce(getbit(cast({byte} AS int), cast(__bit % 8 AS int)) = 1, false)")
    return rows.join(F.broadcast(table), "__bucket", "left").withColumn(name, on).drop("__bit", "__bucket", "__bits")
