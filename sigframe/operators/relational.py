"""Merges, lookups, name joins, set operations, capped unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.functions.exprs import normalize_name


def merge_sources(universe: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """universe (entity) with features, the sources' (entity, features map) laid over each other in
    order: a later source's value wins, entities outside the universe drop out."""
    out = universe.select("entity").distinct().withColumn("features", F.create_map().cast("map<string,double>"))
    for k, s in enumerate(sources):
        out = out.join(s.select("entity", F.col("features").alias(f"_f{k}")), "entity", "left")
        over = F.coalesce(F.col(f"_f{k}"), F.create_map().cast("map<string,double>"))
        out = out.withColumn("_over", over)
        kept = F.map_filter("features", lambda name, _: ~F.map_contains_key(F.col("_over"), name))
        out = out.withColumn("features", F.map_concat(kept, "_over")).drop(f"_f{k}", "_over")
    return out


def join_by_name(left: DataFrame, right: DataFrame, left_name: str, right_name: str, right_id: str) -> DataFrame:
    """left with right_id by normalised name; names that stand for several ids match nothing."""
    ids = right.select(normalize_name(F.col(right_name)).alias("_key"), right_id).where("_key <> ''")
    sure = ids.groupBy("_key").agg(F.countDistinct(right_id).alias("_n"), F.min(right_id).alias(right_id)).where("_n = 1").drop("_n")
    return left.withColumn("_key", normalize_name(F.col(left_name))).join(sure, "_key").drop("_key")


def lookup(left: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join; Spark broadcasts the small side by its measured size."""
    return left.join(small, key, "left")


def priority_cap(first: DataFrame, second: DataFrame, cap: int) -> DataFrame:
    """All of `first` (entity), then those of `second` that aren't in it, by name, while there is room."""
    first = first.select("entity").distinct().withColumn("source", F.lit(0))
    room = first.agg(F.greatest(F.lit(0), F.lit(cap) - F.count("*")).alias("room"))
    rest = second.select("entity").distinct().join(first, "entity", "left_anti").orderBy("entity").limit(cap)
    numbered = rest.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("entity")))  # at most cap rows
    return first.union(numbered.join(F.broadcast(room)).where("k <= room").select("entity", F.lit(1)))


def first_seen(rows: DataFrame, position: str, key: str) -> DataFrame:
    """Keys in the order of their first position."""
    return rows.groupBy(key).agg(F.min(position).alias(position)).orderBy(position)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def on_latest_date(df: DataFrame, date: str = "date") -> DataFrame:
    latest = df.agg(F.max(date).alias("_latest"))
    return df.join(F.broadcast(latest), F.col(date) == F.col("_latest")).drop("_latest")


