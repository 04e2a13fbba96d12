"""Data quality: manifests, missingness, label quality, the liveness gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.schema import CATASTROPHIC, COLLAPSE_RATIO, EXPECTED_DOWN, FAMILIES, MIN_GATE_ROWS, TRAILING_DATES


def manifest(archive: DataFrame) -> DataFrame:
    return archive.agg(F.count("*").alias("rows"), F.countDistinct("date").alias("dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("entity").alias("entities"))


def tracked_entities(*archives: DataFrame) -> DataFrame:
    out = archives[0].select("entity")
    for a in archives[1:]:
        out = out.union(a.select("entity"))
    return out.distinct()


def missingness(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, missing_pct, from one aggregation of all columns."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in features])
    return counts.unpivot(["_n"], features, "feature", "missing").select("feature", (F.try_divide(F.col("missing") * 100.0, F.col("_n"))).alias("missing_pct"))


def label_quality(labeled: DataFrame, y: str = "fwd_ret") -> DataFrame:
    return labeled.agg(F.count("*").alias("examples"), F.countDistinct("date").alias("dates"), F.countDistinct("entity").alias("entities"), F.avg((F.col(y) > 0).cast("double")).alias("positive_rate"), F.avg(y).alias("mean_ret"))


def gate_from_long(rows: DataFrame, families: dict = FAMILIES, expected_down: tuple = EXPECTED_DOWN, ratio: float = COLLAPSE_RATIO, trailing: int = TRAILING_DATES) -> DataFrame:
    """Of (date, family, alive): per date and family the share alive, the mean share of the dates
    before (at most `trailing`), and its status."""
    floors = F.create_map(*[F.lit(x) for k, (_, _, floor) in families.items() for x in (k, floor)])
    share = rows.groupBy("date", "family").agg(F.avg(F.col("alive").cast("double")).alias("share"))
    before = F.avg("share").over(Window.partitionBy("family").orderBy("date").rowsBetween(-trailing, -1))
    out = share.withColumn("floor", floors[F.col("family")]).withColumn("trailing", before)
    collapsed = F.coalesce((F.col("trailing") >= F.col("floor")) & (F.col("share") < F.col("trailing") * ratio), F.lit(False))
    status = F.when(collapsed, "COLLAPSED").when(F.col("share") >= F.col("floor"), "OK").otherwise("DEAD")
    shown = F.when((status != "OK") & F.col("family").isin(*expected_down), "EXPECTED-DOWN").otherwise(status)
    return out.withColumn("status", shown)


def quality_gate(snapshots: DataFrame, families: dict = FAMILIES) -> DataFrame:
    """`gate_from_long` of snapshots with a features map, for every date."""
    rows = []
    for family, (feature, mode, _) in families.items():
        v = F.try_element_at("features", F.lit(feature))
        known = v.isNotNull() & ~F.isnan(v)
        rows.append(F.struct(F.lit(family).alias("family"), F.coalesce(known if mode == "notnull" else known & (v > 0), F.lit(False)).alias("alive")))
    long = snapshots.select("date", F.explode(F.array(*rows)).alias("x")).select("date", "x.*")
    return gate_from_long(long, families)


def gate_verdict(snapshots: DataFrame, families: dict = FAMILIES, catastrophic: tuple = CATASTROPHIC, least: int = MIN_GATE_ROWS) -> tuple[str, int, list[dict]]:
    """("OK" or "FAIL", exit code, the latest date's rows): fails without dates, with few rows, or when a
    catastrophic family isn't OK."""
    latest = snapshots.agg(F.max("date")).first()[0]
    if latest is None or snapshots.where(F.col("date") == latest).count() < least:
        return "FAIL", 1, []
    report = [r.asDict() for r in quality_gate(snapshots, families).where(F.col("date") == latest).orderBy("family").collect()]
    bad = any(r["family"] in catastrophic and r["status"] not in ("OK", "EXPECTED-DOWN") for r in report)
    return ("FAIL", 1, report) if bad else ("OK", 0, report)


def family_presence(rows: DataFrame, families: dict = FAMILIES) -> DataFrame:
    """family, present, n: how many rows have each family's feature alive, from one aggregation."""
    there = {k: F.col(c).isNotNull() if kind == "notnull" else F.coalesce(F.col(c) > 0, F.lit(False)) for k, (c, kind, _) in families.items()}
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(x).alias(k) for k, x in there.items()])
    return counts.unpivot(["n"], list(families), "family", "present").select("family", "present", "n")


def write_gold(labeled: DataFrame, features: list[str], out: str, horizon: int) -> DataFrame:
    """Writes the labelled rows as JSON under out/labeled_<horizon>d and their quality under
    out/quality_<horizon>d; returns the quality: label_quality's columns and missing, the share of rows
    without each feature in per cent."""
    labeled.write.mode("overwrite").json(f"{out}/labeled_{horizon}d")
    share = F.create_map(*[x for c in features for x in (F.lit(c), F.round(F.try_divide(100.0 * F.count_if(F.col(c).isNull()), F.count("*")), 1))])
    quality = label_quality(labeled).withColumns({c: F.round(c, 4) for c in ("positive_rate", "mean_ret")}).join(F.broadcast(labeled.agg(share.alias("missing"))))
    quality.coalesce(1).write.mode("overwrite").json(f"{out}/quality_{horizon}d")
    return quality
