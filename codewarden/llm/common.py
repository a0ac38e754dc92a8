"""Shared helpers: tables, the shared folder, fold numbers and link components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or one in the warehouse where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch").rstrip("/")


def bind(value: Column, body) -> Column:
    """`body` of a value that is computed once, though it is used several times."""
    return F.transform(F.array(value), body)[0]


#: Parquet settings for rows of megabytes: a row group is closed when it is full, not after its hundredth row.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false",
              "compression": "zstd"}


def stored(df: DataFrame, name: str, settings: dict[str, object] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: it is computed once, and no lost executor takes it away."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(settings or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While the block runs, tasks get tables of large rows so many rows at a time, not by the ten thousand."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node each node is linked with, over `edges` (a, b).

    Alternating star contraction: every neighbour moves to the smallest one seen, first from the larger, then from
    the smaller neighbours. Edges never outnumber the first ones, and each round is a written table.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = stored(pairs, "edges")
    seen = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        # larger neighbours move to the smallest of the neighbourhood
        large = (both.join(least, F.col("a") == F.col("u")).where("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        # smaller neighbours and the node itself move to the smallest one
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = (large.join(low, F.col("a") == F.col("u"))
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        pairs = stored(moved, "edges")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    ends = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), "b"))).alias("e")).select("e.*")
    return ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
