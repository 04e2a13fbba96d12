"""The archive: JSON rows in month partitions, upserted on (date, entity).

A write touches only the months of its rows: their old rows without the new keys, and the new rows,
are staged beside the archive and swapped in month by month. Running it again changes nothing. A month
that can't be swapped gets its old files back; what a writer left that died between the two renames is
put back by the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigframe.functions.exprs import nan_to_null
from sigframe.operators.quality import manifest, tracked_entities
from sigframe.schema import PRICE, SCHEMA_VERSION, SNAPSHOT
from sigframe.sources import files

KEY = ["date", "entity"]


def _with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("date", "yyyy-MM"))


def valid(df: DataFrame) -> DataFrame:
    """Rows with a date and an entity."""
    return df.where(F.col("date").isNotNull() & F.coalesce(F.col("entity") != "", F.lit(False)))


def read_rows(spark: SparkSession, path: str, schema: T.StructType, months: list[str] | None = None) -> DataFrame:
    """Rows of JSON lines, malformed ones left out; empty where nothing is there."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("month", F.lit(None).cast("string"))
    parts = sorted(c for c in files.children(spark, path) if c.startswith("month=") and (months is None or c[6:] in months))
    if not parts:
        return spark.createDataFrame([], schema).withColumn("month", F.lit(None).cast("string"))
    strict = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    reader = spark.read.schema(strict).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("basePath", path)
    rows = reader.json([f"{path}/{p}" for p in parts])
    return valid(rows.where("_bad IS NULL").drop("_bad").withColumn("month", F.date_format("date", "yyyy-MM")))


def deduplicated(rows: DataFrame, order: str) -> DataFrame:
    """One row per key: the last by `order`."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col(order).desc()))).where("_k = 1").drop("_k")


def recover(spark: SparkSession, path: str) -> list[str]:
    """Puts back months that a writer moved away and didn't replace; their names."""
    parent, _, name = path.rstrip("/").rpartition("/")
    back = []
    for stage in (c for c in files.children(spark, parent) if c.startswith(f"{name}.stage-")):
        for old in (c for c in files.children(spark, f"{parent}/{stage}") if c.startswith("old-")):
            if not files.exists(spark, f"{path}/month={old[4:]}"):
                files.rename(spark, f"{parent}/{stage}/{old}", f"{path}/month={old[4:]}")
                back.append(old[4:])
    return back


def _swap(spark: SparkSession, new: str, target: str, old: str) -> None:
    """`new` in place of `target`, whose files go to `old`, or come back if that fails."""
    had = files.exists(spark, target)
    if had:
        files.rename(spark, target, old)
    try:
        files.rename(spark, new, target)
    except Exception:
        if had:
            files.rename(spark, old, target)
        raise


def upsert(spark: SparkSession, path: str, rows: DataFrame, schema: T.StructType, order: str | None = None) -> tuple[int, int]:
    """Rows in and distinct keys written. Of rows of one key the last counts: by `order`, else as they are read."""
    path = path.rstrip("/")
    recover(spark, path)
    at = order or "_at"
    rows = valid(rows if order else rows.withColumn(at, F.monotonically_increasing_id()))
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    _with_month(deduplicated(rows, at).select(*schema.fieldNames())).write.parquet(f"{stage}/new")
    new = spark.read.parquet(f"{stage}/new")
    sizes = rows.count(), new.count()  # before the swap: rows may come from the archive itself
    months = [r[0] for r in new.select("month").distinct().collect()]  # as many as the rows have months
    old = read_rows(spark, path, schema, months).select(*schema.fieldNames(), "month")
    merged = old.join(new.select(*KEY), KEY, "left_anti").unionByName(new.select(*schema.fieldNames(), "month"))
    merged.repartition("month").sortWithinPartitions("month", *KEY).write.partitionBy("month").json(f"{stage}/out")
    files.make(spark, path)
    for m in sorted(months):
        _swap(spark, f"{stage}/out/month={m}", f"{path}/month={m}", f"{stage}/old-{m}")
    files.remove(spark, stage)  # only after all swaps: until then it may hold the one copy of a month
    return sizes


def append_snapshot(spark: SparkSession, base: str, rows: DataFrame, date=None) -> tuple[int, int]:
    """Stamps version and date, turns NaN into null, upserts under base/features, folds the legacy file in and
    writes the manifest anew."""
    out = rows
    if date is not None:
        out = out.withColumn("date", F.lit(date).cast("date"))
    have = set(out.columns)
    kinds = {f.name: f.dataType for f in SNAPSHOT.fields}
    out = out.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
    clean = F.transform_values("features", lambda _, v: nan_to_null(v))
    out = out.withColumn("features", clean).withColumn("schema_version", F.coalesce("schema_version", F.lit(SCHEMA_VERSION)))
    sizes = upsert(spark, f"{base}/features", out, SNAPSHOT)
    migrate_legacy(spark, base)
    write_manifest(spark, base)
    return sizes


def append_prices(spark: SparkSession, base: str, panel: DataFrame) -> tuple[int, int]:
    """panel (entity, closes map<date, close>): valid dates and closes above 0."""
    rows = panel.select("entity", F.explode("closes").alias("date", "close")).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("date").try_cast("date").alias("date"), "entity", F.col("close").cast("double").alias("close"))
    return upsert(spark, f"{base}/prices", rows.where("close > 0"), PRICE)


def load_prices(spark: SparkSession, base: str) -> DataFrame:
    return read_rows(spark, f"{base}/prices", PRICE)


def load_features(spark: SparkSession, base: str) -> DataFrame:
    """Snapshots; rows of the legacy file that no partition has come along as version 1."""
    rows = read_rows(spark, f"{base}/features", SNAPSHOT)
    legacy = f"{base}/features.jsonl"
    if files.exists(spark, legacy):
        old = spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(legacy)
        old = valid(old).withColumn("schema_version", F.coalesce("schema_version", F.lit(1)))
        rows = rows.unionByName(_with_month(old).join(rows.select(*KEY), KEY, "left_anti"))
    return rows


def has_snapshot(spark: SparkSession, base: str, date) -> bool:
    """Whether a date was collected already; reads its month alone."""
    rows = read_rows(spark, f"{base}/features", SNAPSHOT, [str(date)[:7]])
    return not rows.where(F.col("date") == F.lit(date).cast("date")).isEmpty()


def migrate_legacy(spark: SparkSession, base: str) -> int:
    """Folds the legacy file into the partitions, which win, and renames it."""
    legacy = f"{base}/features.jsonl"
    if not files.exists(spark, legacy):
        return 0
    n, _ = upsert(spark, f"{base}/features", load_features(spark, base).drop("month"), SNAPSHOT)
    files.rename(spark, legacy, f"{legacy}.migrated")
    return n


def price_panel(prices: DataFrame) -> DataFrame:
    """entity, closes: (date, close) in order; an entity's days are bounded by the calendar."""
    return prices.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("closes"))


def update_manifest(spark: SparkSession, base: str) -> DataFrame:
    """archive, rows, dates, first_date, last_date, entities for both archives."""
    both = [manifest(df).select(F.lit(n).alias("archive"), "*") for n, df in (("features", load_features(spark, base)), ("prices", load_prices(spark, base)))]
    return both[0].unionByName(both[1])


def write_manifest(spark: SparkSession, base: str) -> None:
    """The manifest as JSON under base/manifest: two rows."""
    update_manifest(spark, base).coalesce(1).write.mode("overwrite").json(f"{base}/manifest")


def tracked(spark: SparkSession, base: str) -> DataFrame:
    return tracked_entities(load_features(spark, base), load_prices(spark, base))
