"""What the operators share: tables, batches, written cuts of the lineage, components."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs on one machine (tests).
OWN_SHARED = "file:/tmp/checkpoints/sigframe"

#: Rows and bytes that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 256, 64 << 20
#: Bits of a sieve: 8 MB, whatever the number of ids.
SIEVE_BITS = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what Arrow hands to Python at once; applies to all later plans of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or OWN_SHARED).rstrip("/")


class Cuts:
    """Tables written to the shared folder so that later plans start from files, not from lineage.

    A lost executor costs only the tasks it ran: what is written stays readable by all others.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.parquet(path)
        self.tables.append((out, path))
        return out

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, df: DataFrame) -> None:
        """Removes a table that nothing reads any more."""
        for x, path in self.tables:
            if x is df:
                self._remove(path)
        self.tables = [t for t in self.tables if t[0] is not df]

    def only(self, *needed: DataFrame) -> None:
        """Removes all tables but those that the result still reads."""
        for x, _ in list(self.tables):
            if not any(x is y for y in needed):
                self.drop(x)


def numbered(rows: DataFrame, cuts: Cuts, key: str = "doc_id") -> DataFrame:
    """`rows` with row: a number of each row, the key itself where that is unique and never null.

    Else the rows are written with numbers of their own, so that every later reading agrees on them.
    """
    keyed = rows.withColumn("row", F.col(key).cast("long"))
    if keyed.groupBy("row").agg(F.count("*").alias("n")).where("n > 1 OR row IS NULL").isEmpty():
        return keyed
    return cuts.write(rows.withColumn("row", F.monotonically_increasing_id()))


def sieve(ids: DataFrame, bits: int = SIEVE_BITS):
    """A test for a column: false for numbers that aren't in `ids` (one long column), true for all that are
    and for a few others. None where so many ids would pass nearly everything.

    A Bloom filter of two positions per id in at most 2 ** bits bits, which alone reach the driver. It spares
    the rows of texts that it can clear a shuffle; an exact join must follow for the others.
    """
    spark, (name,) = ids.sparkSession, ids.columns
    count = ids.count()
    if count > 1 << bits:
        return None
    width = min(bits, max(10, (16 * count).bit_length()))
    mask = F.lit((1 << width) - 1)
    h = F.xxhash64(F.col(name))
    places = ids.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftright(h, 32).bitwiseAND(mask))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("set")).toArrow()
    held = np.zeros(max(1, 1 << width >> 6), np.int64)
    held[words.column(0).to_numpy()] = words.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def there(x: pd.Series) -> pd.Series:
        v, table, out = x.to_numpy(), shared.value, None
        for p in (v & ((1 << width) - 1), v >> 32 & ((1 << width) - 1)):
            hit = (table[p >> 6] >> (p & 63)) & 1
            out = hit if out is None else out & hit
        return pd.Series(out.astype(bool))

    def test(column: str) -> Column:
        return there(F.xxhash64(F.col(column)))

    return test


def among(rows: DataFrame, ids: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` joined to `ids` by `key` (inner or left_anti) so that hardly a row without a partner is shuffled.

    ids grow with the data, so neither side is broadcast, at any size.
    """
    passed = sieve(ids.select(key))
    near = rows if passed is None else rows.where(passed(key))
    exact = near.join(ids.hint("merge"), key, how)
    if how == "left_anti" and passed is not None:
        return rows.where(~passed(key)).unionByName(exact)
    return exact


def components(edges: DataFrame, cuts: Cuts, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long): root is the least node it reaches. Written.

    Large-star and small-star steps in turn: each node's greater neighbours, then its lesser ones,
    are hung on its least neighbour. Only counts reach the driver. A hub is a skewed join, which
    adaptive execution splits. Nodes without an edge do not appear; self-loops are ignored.
    """
    now = cuts.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cuts.write(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        small = cuts.write(small)
        cuts.drop(large)
        cuts.drop(now)
        now = small
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    out = cuts.write(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    cuts.drop(now)
    return out
