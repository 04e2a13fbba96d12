"""The flat Parquet warehouse over the archive, its views and ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.functions.exprs import finite_or_null
from sigframe.schema import FEATURES
from sigframe.sources import files, store


def flatten(snapshots: DataFrame, features: tuple = FEATURES) -> DataFrame:
    """One column f_<name> per feature; other names stay in the map f_other."""
    cols = [finite_or_null(F.try_element_at("features", F.lit(k))).alias(f"f_{k}") for k in features if k != "last_price"]
    other = F.map_filter("features", lambda k, _: ~k.isin(*features, "last_price"))
    return snapshots.select("date", "entity", "score", "last_price", "schema_version", *cols, other.alias("f_other"), F.date_format("date", "yyyy-MM").alias("month"))


def _write(df: DataFrame, path: str) -> None:
    df.repartition("month").sortWithinPartitions("month", "date", "entity").write.mode("overwrite").option("compression", "zstd").partitionBy("month").parquet(path)


def compact(spark: SparkSession, base: str, out: str) -> dict:
    """Rebuilds the warehouse from the archive and writes its summary; byte counts come from the file system."""
    _write(flatten(store.load_features(spark, base)), f"{out}/features")
    _write(store.load_prices(spark, base).select("date", "entity", "close", "schema_version", "month"), f"{out}/prices")
    found = stats(spark, base, out)
    some = lambda n: any(c.startswith("month=") for c in files.children(spark, f"{out}/{n}"))
    rows = {n: spark.read.parquet(f"{out}/{n}").count() if some(n) else 0 for n in ("features", "prices")}
    summary = {f"{n}_rows": c for n, c in rows.items()} | found
    spark.createDataFrame([tuple(summary.values())], ", ".join(f"{k} {'double' if k == 'ratio' else 'long'}" for k in summary)).coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    return found


def read_month(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """A warehouse table between two dates; the months prune partitions, the dates go to the scan."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    if first is not None:
        df = df.where((F.col("month") >= F.date_format(F.lit(first).cast("date"), "yyyy-MM")) & (F.col("date") >= F.lit(first).cast("date")))
    if last is not None:
        df = df.where((F.col("month") <= F.date_format(F.lit(last).cast("date"), "yyyy-MM")) & (F.col("date") <= F.lit(last).cast("date")))
    return df


def connect(spark: SparkSession, out: str) -> list[str]:
    """Temp views `features` and `prices` for those tables that are there."""
    made = []
    for name in ("features", "prices"):
        if any(c.startswith("month=") for c in files.children(spark, f"{out}/{name}")):
            read_month(spark, f"{out}/{name}").createOrReplaceTempView(name)
            made.append(name)
    return made


def frame(spark: SparkSession, out: str, query: str) -> DataFrame:
    """The result of a query over the views, of any size."""
    connect(spark, out)
    return spark.sql(query)


def sql(spark: SparkSession, out: str, query: str) -> list[tuple]:
    """The rows of a query whose result fits the driver; see `frame` for others."""
    return [tuple(r) for r in frame(spark, out, query).collect()]


def stats(spark: SparkSession, base: str, out: str) -> dict:
    raw = sum(files.size(spark, f"{base}/{n}") for n in ("features", "prices"))
    flat = sum(files.size(spark, f"{out}/{n}") for n in ("features", "prices"))
    return {"jsonl_bytes": raw, "parquet_bytes": flat, "ratio": round(raw / flat, 1) if flat else None}
