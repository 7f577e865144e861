"""Instant-power model: feature table, boosted trees, importance, prediction."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import expr as E
from voltlake.operators.sequence import global_row_number, settled
from voltlake.sources.points import pivot_points

SENSORS = ("soc", "soh", "pack_volt", "pack_current", "mod_avg_temp", "odometer")
FEATURES = (*SENSORS, "hour", "day_of_week", "month", "season", "car_type_encoded")
LABEL = "instant_power_kw"
# The label is pack_volt * pack_current / 1000, so these two give it away.
LEAKING = ("pack_volt", "pack_current")
# Rows that one task reads in a pass of the trees: fewer do not pay for the task, more are a large block to keep.
LEAST_SHARE, MOST_SHARE = 10_000, 1_000_000


def energy_features(points: DataFrame) -> DataFrame:
    """Points to complete feature rows with the instant power as label."""
    wide = pivot_points(points, SENSORS)
    return wide.select(
        "time", "device_no", "car_type", *SENSORS, E.power_w().alias("instant_power_w"), E.power_kw().alias(LABEL),
        *E.calendar_features("time"), E.encode_type().alias("car_type_encoded"),
    ).na.drop()


def equal_shares(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """All feature rows, settled and dealt by their key into equal shares: two a core, or more if those got too large.

    The trees pass over the rows once for each of their levels; a pass starts a task and merges a histogram for every
    share, so their number follows the cores and not the bytes. The order in a share is that of the key, so that the
    draws of the trees meet the same rows however the input was spread.
    """
    key = ["device_no", "car_type", "time"]
    rows = settled(features.select(*key, *names, LABEL))
    cores, n = features.sparkSession.sparkContext.defaultParallelism, rows.count()
    shares = max(1, min(cores * max(2, ceil(n / (cores * MOST_SHARE))), n // LEAST_SHARE))
    return rows.repartition(shares, *key).sortWithinPartitions(*key, *names, LABEL)


def train_energy_model(
    features: DataFrame, leak_free: bool = False, trees: int = 100, depth: int = 6, rate: float = 0.1,
    subsample: float = 0.8, columns: float = 0.8, seed: int = 42,
) -> PipelineModel:
    """Gradient-boosted trees; ``leak_free`` leaves out the two factors of the label."""
    names = [name for name in FEATURES if not (leak_free and name in LEAKING)]
    return Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="features"),
        GBTRegressor(
            featuresCol="features", labelCol=LABEL, predictionCol="predicted_kw", maxIter=trees, maxDepth=depth,
            stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=str(columns), seed=seed, maxBins=64,
        ),
    ]).fit(equal_shares(features, names))


def split_features(features: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Train and hold-out rows by a hash of the row key, the same on every run and in every engine."""
    digest = F.md5(F.encode(F.concat_ws("|", "device_no", E.micros("time").cast("string")), "utf-8"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000
    return features.where(place < int(share * 1000)), features.where(place >= int(share * 1000))


def rmse(model: PipelineModel, features: DataFrame) -> float:
    return RegressionEvaluator(labelCol=LABEL, predictionCol="predicted_kw", metricName="rmse").evaluate(model.transform(features))


def holdout_errors(model: PipelineModel, train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: root mean square error of the model on held-out rows, beside that of the training mean."""
    mean = train.agg(F.avg(LABEL).alias("_mean"), F.count("*").alias("train_rows"))

    def error(guess: str) -> Column:
        return F.sqrt(F.avg(F.pow(F.col(LABEL) - F.col(guess), 2)))

    scored = model.transform(test).select(LABEL, "predicted_kw").join(mean)  # one row
    return scored.agg(
        F.max("train_rows").alias("train_rows"), F.count("*").alias("holdout_rows"),
        error("predicted_kw").alias("model_error"), error("_mean").alias("mean_error"))


def permutation_importance(model: PipelineModel, test: DataFrame, seed: int = 42) -> DataFrame:
    """(feature, importance): how much the held-out error grows when a feature's values are dealt anew among the rows.

    The rows are put into one random order by a hash; each row takes the value of the row behind it there, the last
    one that of the first. One order serves all features.
    """
    order = [F.xxhash64(F.lit(seed), "device_no", "time").asc(), F.col("device_no").asc(), F.col("time").asc()]
    names = list(model.stages[0].getInputCols())
    placed = settled(global_row_number(test.select("device_no", "time", LABEL, *names), "_nth", order, total="_all"))
    behind = placed.select((F.when(F.col("_nth") == 1, F.col("_all")).otherwise(F.col("_nth") - 1)).alias("_nth"), *[F.col(n).alias(f"_{n}") for n in names])
    both = settled(placed.join(behind, "_nth"))
    whole = rmse(model, both)
    rows = [(name, rmse(model, both.withColumn(name, F.col(f"_{name}"))) - whole) for name in names]
    return test.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def predict_energy(model: PipelineModel, features: DataFrame) -> DataFrame:
    return model.transform(features).drop("features")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
