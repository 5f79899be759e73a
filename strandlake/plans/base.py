"""The registry of queries and the views they share, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASES = ("ACGT" * 7)[:26] * 2
DNA = f"dna AS (SELECT doc_id, lang, source, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{_LETTERS}', '{_BASES}') AS seq FROM documents)"
CLEAN = r"""clean AS (SELECT doc_id, lang, source, regexp_replace(translate(regexp_replace(text, '[ \t\r\n]', '', 'g'), 'acgtn', 'ACGTN'), '[^ACGTN]', 'N', 'g') AS seq FROM documents)"""
EMB = "emb AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
SOFT = EMB + ", mx AS (SELECT vec_id, max(x) AS m FROM emb GROUP BY vec_id), ex AS (SELECT vec_id, label, i, exp(x - m) AS e FROM emb JOIN mx USING (vec_id)), soft AS (SELECT vec_id, label, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ex)"
ROUNDS = "rounds AS (SELECT user_id % 20 AS run, event_id, event_type, (event_id * 2654435761 % 4294967296) % 13 AS k, abs(value) AS value FROM events)"
GAMMA = 12


def densest(select: str) -> str:
    """SQL over k (source, span, contig, start, rk): windows by their longest open span, and r: sequences by length."""
    return f"""WITH {DNA}, r AS (SELECT source, doc_id, seq, row_number() OVER (PARTITION BY source ORDER BY length(seq) DESC, doc_id) - 1 AS contig FROM dna), w AS (SELECT source, contig, i AS start, substr(seq, i + 1, 2048) AS seq FROM r, unnest(range(0, length(seq) - 2047, 256)) t(i) WHERE contig < 3 AND length(seq) >= 2048), s AS (SELECT source, contig, start, 1 AS strand, seq FROM w UNION ALL SELECT source, contig, start, -1, reverse(translate(seq, 'ACGTN', 'TGCAN')) FROM w), cod AS (SELECT source, contig, start, strand, (i - 1) % 3 AS frame, i - 1 AS pos, substr(seq, i, 3) AS c FROM s, unnest(range(1, 2047)) t(i)), l AS (SELECT source, contig, start, pos - coalesce(max(CASE WHEN c IN ('TAA','TAG','TGA') THEN pos END) OVER (PARTITION BY source, contig, start, strand, frame ORDER BY pos ROWS UNBOUNDED PRECEDING), frame - 3) AS gap FROM cod), b AS (SELECT source, contig, start, max(gap) AS span FROM l GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY span DESC, contig, start) AS rk FROM b) {select}"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", tx.recode_letters(F.col("text")).alias("seq"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", tx.clean(F.col("text")).alias("seq"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).alias("run"), "event_id", "event_type", ((F.col("event_id") * 2654435761 % 4294967296) % 13).alias("k"), F.abs("value").alias("value"))


def r6(c):
    return F.round(c, 6)
