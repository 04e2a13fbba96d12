"""Learning on labeled rows: walk-forward fits, calibrated rank ensembles, prediction."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.functions.ranks import rank01, ranked01
from sigframe.operators import metrics as M
from sigframe.operators.labels import purged, walk_forward_folds
from sigframe.session import kept

MIN_DATES, MIN_EXAMPLES = 8, 200
#: Training rows of a part.
PART_ROWS = 50_000
#: Bins of a feature for trees, by quantiles; a feature of so many values at most has a bin for each.
BINS = 32


def _stats(train: DataFrame, keys: list[str]) -> dict[str, tuple[float, float]]:
    row = train.agg(*[s for k in keys for s in (F.avg(k).alias(f"{k}_m"), F.stddev_pop(k).alias(f"{k}_s"))]).first()
    return {k: (row[f"{k}_m"] or 0.0, row[f"{k}_s"] or 1.0) for k in keys}


def matrix(df: DataFrame, keys: list[str], stats: dict) -> DataFrame:
    """df with x: standardised features, 0 where missing."""
    cols = [F.coalesce((F.col(k).cast("double") - stats[k][0]) / stats[k][1], F.lit(0.0)).alias(f"_x{i}") for i, k in enumerate(keys)]
    wide = df.select("*", *cols)
    return VectorAssembler(inputCols=[f"_x{i}" for i in range(len(keys))], outputCol="x").transform(wide).drop(*[f"_x{i}" for i in range(len(keys))])


def fit_logistic(train: DataFrame, l2: float = 1.0):
    """L2-penalised, the penalty divided by the number of rows."""
    return LogisticRegression(featuresCol="x", labelCol="label", regParam=l2 / max(1, train.count()), elasticNetParam=0.0, standardization=False, maxIter=100).fit(train)


def fit_trees(train: DataFrame, rounds: int = 200, seed: int = 0):
    """Of x (bins), label, weight. The learner's own limit of bins lies above ours, so that it leaves them as they are."""
    return GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxBins=8 * BINS, maxDepth=3, stepSize=0.05, maxIter=rounds, seed=seed).fit(train)


def bin_edges(train: DataFrame, count: int) -> list[list[float]]:
    """Per element of x the values that begin a bin, from all rows."""
    v = train.select(*[vector_to_array("x")[i].alias(f"_{i}") for i in range(count)])
    at = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    found = v.agg(*[a for i in range(count) for a in (F.percentile_approx(f"_{i}", at, 10_000).alias(f"q{i}"), F.approx_count_distinct(f"_{i}").alias(f"n{i}"))]).first()
    few = [i for i in range(count) if found[f"n{i}"] <= 2 * BINS]
    each = v.agg(*[F.collect_set(f"_{i}").alias(f"s{i}") for i in few]).first() if few else None
    edges = [sorted(set(found[f"q{i}"] or [])) for i in range(count)]
    for i in few:
        if len(each[f"s{i}"]) <= BINS:
            edges[i] = sorted(each[f"s{i}"])[1:]
    return edges


def binned(rows: DataFrame, edges: list[list[float]], out: str) -> DataFrame:
    """rows with `out`: the bins of the elements of x."""
    names, bins = [f"_v{i}" for i in range(len(edges))], [f"_b{i}" for i in range(len(edges))]
    wide = rows.select("*", *[vector_to_array("x")[i].alias(n) for i, n in enumerate(names)])
    splits = [[float("-inf"), *(e or [0.0]), float("inf")] for e in edges]
    wide = Bucketizer(splitsArray=splits, inputCols=names, outputCols=bins, handleInvalid="keep").transform(wide)
    return VectorAssembler(inputCols=bins, outputCol=out).transform(wide).drop(*names, *bins)


class BinnedTrees:
    """Boosted trees over bins. Rows of the same bins and label are the same to every tree, at every round, so they
    are boosted as one row of their number's weight: 200 rounds go over the different cells, not over all rows."""

    def __init__(self, train: DataFrame, count: int):
        self.edges = bin_edges(train, count)
        cells = kept(binned(train, self.edges, "_bins").groupBy("_bins", "label").agg(F.count("*").cast("double").alias("weight")).withColumnRenamed("_bins", "x"), "cells")
        self.model = fit_trees(cells.repartition(1 + cells.count() // PART_ROWS)).setFeaturesCol("_bins")

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(binned(rows, self.edges, "_bins")).drop("_bins")


def scored(model, rows: DataFrame, name: str) -> DataFrame:
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction")


def rank_averaged(rows: DataFrame, by: list[str], names: list[str], out: str = "score") -> DataFrame:
    """The mean of the names' ranks in [0, 1] per group."""
    return rows.withColumn(out, sum((rank01(by, n) for n in names), F.lit(0.0)) / len(names))


def walk_forward(labeled: DataFrame, keys: list[str], folds: int = 4, embargo: int = 2, trees: bool = False, least_train: int = 20, least_test: int = 5) -> DataFrame:
    """Out-of-sample scores (labeled columns, fold, score) of expanding folds; label 0/1 must be there.

    One fit per fold and model; folds too small or of one class are passed over, and the result has no
    rows if all were. The labelled rows are written once; each fold reads its part.
    """
    rows = kept(walk_forward_folds(labeled, folds), "folds")

    def one(fold: int) -> DataFrame | None:
        test = rows.where(F.col("fold") == fold)
        start = test.agg(F.min("date"), F.count("*")).first()
        if start[1] < least_test:
            return None
        train = purged(rows.where(F.col("fold") < fold), F.lit(start[0]), embargo)
        seen = train.agg(F.count("*"), F.countDistinct("label")).first()
        if seen[0] < least_train or seen[1] < 2:
            return None
        stats = _stats(train, keys)
        # boosting runs hundreds of short jobs: no more parts than the rows are worth
        x = kept(matrix(train, keys, stats).select("x", "label").repartition(1 + seen[0] // PART_ROWS), "fold")
        part = scored(fit_logistic(x), matrix(test, keys, stats), "_a")
        names = ["_a"]
        if trees:
            part = kept(scored(BinnedTrees(x, len(keys)), part, "_b").drop("x"), "fold")
            names.append("_b")
            for n in names:
                part = ranked01(part, ["fold"], n, f"{n}r")
            part = part.withColumn("score", sum((F.col(f"{n}r") for n in names), F.lit(0.0)) / len(names)).drop(*[f"{n}r" for n in names])
        else:
            part = part.withColumn("score", F.col("_a"))
        return kept(part.drop("x", *names), "fold")

    with ThreadPoolExecutor(folds) as pool:  # folds don't wait for each other
        parts = [p for p in pool.map(inheritable_thread_target(labeled.sparkSession)(one), range(1, folds + 1)) if p is not None]
    return reduce(DataFrame.unionByName, parts, rows.where(F.lit(False)).withColumn("score", F.lit(0.0)))


def calibrate(scores: DataFrame, score: str = "score", label: str = "label"):
    """Isotonic regression of the label on the score; rows of equal score count as one of their mean and number."""
    values = scores.groupBy(score).agg(F.avg(label).alias(label), F.count("*").cast("double").alias("_weight"))
    return IsotonicRegression(featuresCol=score, labelCol=label, weightCol="_weight").fit(values)


def calibrated(model, rows: DataFrame, out: str = "p") -> DataFrame:
    return model.transform(rows).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction")


def evaluate_calibration(oos: DataFrame) -> DataFrame:
    """The earlier half of out-of-sample rows fits the calibration, the later half is scored: Brier and AUC."""
    n, first = oos.agg(F.count("*"), F.min("pos")).first()
    if n < 2:
        return oos.sparkSession.createDataFrame([], "n long, brier double, auc double")
    half = n // 2
    early, late = oos.where(F.col("pos") < first + half), oos.where(F.col("pos") >= first + half)
    p = calibrated(calibrate(early), late).withColumn("g", F.lit(1))
    return M.brier(p, ["g"], "p", "label").join(M.auc(p, ["g"], "score", "label").select("g", "auc"), "g").drop("g")


def fit_full(labeled: DataFrame, keys: list[str], oos: DataFrame | None = None):
    """(scorer, calibration): fitted on all rows; calibrated on out-of-sample scores where given."""
    stats = _stats(labeled, keys)
    x = matrix(labeled, keys, stats)
    model = fit_logistic(x)
    scorer = lambda df: scored(model, matrix(df, keys, stats), "score").drop("x")
    return scorer, calibrate(oos if oos is not None else scorer(labeled))


def readiness(labeled: DataFrame) -> tuple[bool, str]:
    """Whether there is enough to learn from, and what is missing."""
    dates, rows = labeled.agg(F.countDistinct("date"), F.count("*")).first()
    if dates >= MIN_DATES and rows >= MIN_EXAMPLES:
        return True, "ready"
    return False, f"collecting: {dates} of {MIN_DATES} dates, {rows} of {MIN_EXAMPLES} labeled examples"


def predict(labeled: DataFrame, snapshots: DataFrame, keys: list[str], top: int = 20) -> DataFrame | None:
    """date, entity, score, p (of the label's target) and p_big (of a big move of fwd_ret, where that is there
    and both outcomes occur; else null): the latest snapshot's entities by calibrated probability.

    Rows rebuilt later don't train. None if there isn't enough to learn from.
    """
    from sigframe.operators.labels import big_move
    from sigframe.operators.relational import on_latest_date

    own = labeled.where(~F.coalesce(F.col("backfilled"), F.lit(False))) if "backfilled" in labeled.columns else labeled
    if not readiness(own)[0]:
        return None
    latest = kept(on_latest_date(snapshots), "latest")
    scorer, iso = fit_full(own, keys, _or_none(walk_forward(own, keys)))
    out = calibrated(iso, scorer(latest))
    moved = own.withColumn("label", big_move()) if "fwd_ret" in own.columns else None
    if moved is not None and moved.select("label").distinct().count() == 2:
        big, big_iso = fit_full(moved, keys, _or_none(walk_forward(moved, keys)))
        out = out.join(calibrated(big_iso, big(latest)).select("date", "entity", F.col("p").alias("p_big")), ["date", "entity"], "left")
    else:
        out = out.withColumn("p_big", F.lit(None).cast("double"))
    return out.select("date", "entity", "score", "p", "p_big").orderBy(F.col("p").desc(), F.col("score").desc(), "entity").limit(top)


def _or_none(rows: DataFrame) -> DataFrame | None:
    return None if rows.isEmpty() else rows
