"""Clustering, regression and forest models on Spark ML, and their metrics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from basketlens.functions.columns import safe_ratio, zscore
from basketlens.operators import kmeans
from basketlens.operators.features import (
    CATEGORICAL_FEATURES,
    NUMERIC_FEATURES,
    decode_label,
    encode_label,
)
from basketlens.operators.rfm import METRICS, with_scaled_rfm
from basketlens.session import settle

SEED = 42
# Partitions in which the forests see the customers; part of what determines them, like the seed.
FOREST_PARTITIONS = 32
RESTARTS = kmeans.RESTARTS


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def kmeans_price(products: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Products with a price cluster, and the cluster centres in ascending order (cluster 0 is the cheapest)."""
    priced = products.where(F.col("price").isNotNull())
    # one scale for all prices changes no cluster and gives the tolerance its meaning
    unit = priced.agg(F.stddev_pop(F.col("price").cast("double"))).first()[0] or 1.0
    points = kmeans.settled_points(priced.withColumn("_scaled", F.col("price").cast("double") / unit), "product_id", "_scaled")
    centres, _ = kmeans.fit(points, [k]).get(k, (np.zeros((0, 1)), 0.0))
    centres = np.sort(centres, axis=0)
    table = products.sparkSession.createDataFrame([(i, float(c[0]) * unit) for i, c in enumerate(centres)], "cluster int, center double")
    cluster = kmeans.nearest(F.array(F.col("price").cast("double") / unit), centres) if len(centres) else F.lit(None).cast("int")
    return priced.select("product_id", "price", cluster.alias("cluster")), table


def _int_map(pairs: dict[int, int]):
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


SCALED = tuple(f"{m}_scaled" for m in METRICS)


def k_scan(scores: DataFrame, max_k: int = 10, restarts: int = RESTARTS) -> DataFrame:
    """Per k from 2 to ``max_k``: within-cluster sum of squares and mean silhouette (squared Euclidean)."""
    points = kmeans.settled_points(with_scaled_rfm(scores), "customer_id", *SCALED)
    fits = kmeans.fit(points, range(2, max_k + 1), restarts)
    costs = scores.sparkSession.createDataFrame([(k, cost) for k, (_, cost) in fits.items()], "k int, wcss double")
    if not fits:
        return costs.withColumn("silhouette_sq_euclidean", F.lit(None).cast("double"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), kmeans.nearest(F.col("x"), c).alias("cluster")) for k, (c, _) in fits.items())))
    assigned = points.withColumn("_fit", each).select("x", "_fit.*")
    return costs.join(kmeans.silhouettes(assigned), "k")  # a row per k


def kmeans_segments(scores: DataFrame, k: int = 4, restarts: int = RESTARTS) -> tuple[DataFrame, float]:
    """Customers with a ``cluster`` from k-means on the scaled scores, and the mean silhouette.

    Cluster ids are ordered by mean money spent, so equal fits give equal ids.
    """
    scaled = settle(with_scaled_rfm(scores))
    points = kmeans.settled_points(scaled, "customer_id", *SCALED)
    centres, _ = kmeans.fit(points, [k], restarts).get(k, (np.zeros((1, len(SCALED))), 0.0))
    fitted = settle(scaled.withColumn("x", F.array(*SCALED)).withColumn("_fit", kmeans.nearest(F.col("x"), centres)))  # read three times
    means = fitted.groupBy("_fit").agg(F.avg("monetary").alias("m"))
    order = [row["_fit"] for row in means.orderBy("m", "_fit").collect()] or [0]  # k rows
    ranks = _int_map({number: rank for rank, number in enumerate(order)})
    clustered = fitted.withColumn("cluster", F.element_at(ranks, F.col("_fit")))
    silhouette = kmeans.silhouettes(clustered.select(F.lit(k).alias("k"), "cluster", "x")).first()
    return clustered.select(*scores.columns, "cluster"), silhouette["silhouette_sq_euclidean"] if silhouette else float("nan")


@dataclass(frozen=True)
class LogisticFit:
    """A logistic curve over one number."""

    intercept: float
    coefficients: tuple[float]

    def log_odds(self, column: Column) -> Column:
        return F.lit(self.intercept) + F.lit(self.coefficients[0]) * column

    def probability(self, column: Column) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(column)))


def logistic_category_on_price(products: DataFrame, category: str, steps: int = 50, tolerance: float = 1e-12) -> LogisticFit | None:
    """Logistic model of "is of this category" on the price; None when only one class is present.

    The penalty is half the squared coefficient against the summed loss, the intercept is free. Rows are first counted by
    (price, label); each Newton step is one aggregate of five sums over these counts. Prices are centred and scaled for the
    steps. A step that raises the loss is halved; the fit ends when a step lowers it by less than ``tolerance`` of itself.
    """
    labelled = _category_labels(products, category)
    counts = settle(labelled.groupBy("price", "label").agg(F.count(F.lit(1)).cast("double").alias("n")))
    price, n = F.col("price"), F.col("n")
    rows, positives, mean = counts.agg(F.sum("n"), F.sum(n * F.col("label")), F.sum(n * price) / F.sum("n")).first()
    if not rows or positives in (0, rows):
        return None
    spread = counts.agg(F.sum(n * (price - mean) * (price - mean)) / rows).first()[0]
    scale = spread**0.5 or 1.0
    penalty = 1.0 / scale**2
    z = (price - mean) / scale
    at, move, before = np.zeros(2), np.zeros(2), None
    for _ in range(steps):
        t = F.lit(float(at[0])) + F.lit(float(at[1])) * z
        p = 1 / (1 + F.exp(-t))
        off, curve = n * (p - F.col("label")), n * p * (1 - p)
        loss = n * (F.greatest(t, F.lit(0.0)) - F.col("label") * t + F.log1p(F.exp(-F.abs(t))))
        total, g0, g1, h00, h01, h11 = counts.agg(*map(F.sum, (loss, off, off * z, curve, curve * z, curve * z * z))).first()
        total += penalty * at[1] ** 2 / 2
        if before is not None and total > before * (1 + tolerance):
            move /= 2
            at = at - move
            continue
        if before is not None and before - total <= tolerance * before:
            break
        before = total
        move = -np.linalg.solve([[h00, h01], [h01, h11 + penalty]], [g0, g1 + penalty * at[1]])
        at = at + move
    slope = float(at[1] / scale)
    return LogisticFit(float(at[0] - slope * mean), (slope,))


def _category_labels(products: DataFrame, category: str) -> DataFrame:
    return products.where(F.col("price").isNotNull() & F.col("category").isNotNull()).select(
        F.col("price").cast("double").alias("price"), (F.col("category") == category).cast("double").alias("label"))


def logistic_report(products: DataFrame, category: str, model: LogisticFit | None) -> DataFrame:
    """Accuracy on the data, coefficient and intercept; no row without a model."""
    if model is None:
        return products.sparkSession.createDataFrame([], "category string, accuracy double, coefficient double, intercept double")
    right = (model.log_odds(F.col("price")) > 0).cast("double") == F.col("label")
    return _category_labels(products, category).agg(F.avg(right.cast("double")).alias("accuracy")).select(
        F.lit(category).alias("category"), "accuracy", F.lit(model.coefficients[0]).alias("coefficient"), F.lit(model.intercept).alias("intercept"))


def logistic_curve(products: DataFrame, model: LogisticFit | None, points: int = 300) -> DataFrame:
    """The fitted probability on evenly spaced prices between the least and the largest; no row without a model."""
    if model is None:
        return products.sparkSession.createDataFrame([], "point int, price double, probability double")
    price = F.col("price").cast("double")
    span = products.agg(F.min(price).alias("low"), F.max(price).alias("high"))
    grid = span.select(
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), "low", "high"
    ).select("point", (F.col("low") + F.col("point") * (F.col("high") - F.col("low")) / (points - 1)).alias("price"))
    return grid.select("point", "price", model.probability(F.col("price")).alias("probability"))


@dataclass(frozen=True)
class FeatureEncoder:
    """Fitted preprocessing: z-scores of the numbers, 0/1 columns for all but the first level of each category.

    A level unseen at fitting, or a missing one, gives zeros. The state is a few numbers and level lists.
    """

    moments: dict[str, tuple[float, float]]
    levels: dict[str, list[str]]

    @classmethod
    def fit(cls, df: DataFrame, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES) -> FeatureEncoder:
        row = df.agg(
            *(f(F.col(c).cast("double")).alias(f"{c}_{name}") for c in numeric for name, f in (("mean", F.avg), ("std", F.stddev_pop))),
            *(F.sort_array(F.collect_set(c)).alias(f"{c}_levels") for c in categorical),  # levels are few by their nature
        ).first()
        moments = {c: (row[f"{c}_mean"] or 0.0, row[f"{c}_std"] or 0.0) for c in numeric}
        return cls(moments, {c: list(row[f"{c}_levels"]) for c in categorical})

    @property
    def names(self) -> list[str]:
        return [*self.moments, *(f"{c}_{level}" for c, levels in self.levels.items() for level in levels[1:])]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds one column per name in ``names``, numbers under ``<name>_scaled``, and the ``features`` vector."""
        encoded = {
            f"{c}_scaled": zscore(F.coalesce(F.col(c).cast("double"), F.lit(mean)), F.lit(mean), F.lit(std))
            for c, (mean, std) in self.moments.items()
        }
        for c, levels in self.levels.items():
            for level in levels[1:]:
                encoded[f"{c}_{level}"] = F.when(F.col(c) == level, 1.0).otherwise(0.0)
        # the assembler reads column names literally, dots and blanks included
        safe = {f"_f{i}": column for i, column in enumerate(encoded.values())}
        vectors = _vectors(df.withColumns(safe), list(safe))
        return vectors.withColumnsRenamed(dict(zip(safe, encoded)))


def split_train_test(df: DataFrame, key: str = "customer_id", test: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """A random split by a seeded digest of the key: a row's side never depends on partitioning or retries, and any
    engine with MD5 can draw it again. The draw is the number of the digest's first 6 hexadecimal digits."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("bigint") / F.lit(1 << 24)
    return df.where(draw >= test), df.where(draw < test)


@dataclass(frozen=True)
class LtvModels:
    encoder: FeatureEncoder
    regressor: RandomForestRegressionModel
    classifier: RandomForestClassificationModel


def train_ltv_models(
    train: DataFrame, trees: int = 100, depth: int = 10, seed: int = SEED, partitions: int = FOREST_PARTITIONS
) -> LtvModels:
    """A forest for the amount (``future_ltv``) and one for the class (``ltv_class``), on the encoded features.

    Spark draws the bags by partition and place in it. Customers are therefore always dealt over ``partitions`` by their
    id and sorted inside, so that neither files nor cores change the forests. Raise it for tables whose share of one
    partition does not fit a task; equal forests need an equal number.
    """
    encoder = FeatureEncoder.fit(train)
    data = encode_label(encoder.transform(train)).select("customer_id", "features", "future_ltv", "label")
    data = data.repartition(partitions, "customer_id").sortWithinPartitions("customer_id")
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    # rows remember their node in every tree: walking down all trees again at every level costs more than the statistics
    settings = dict(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, maxMemoryInMB=512, cacheNodeIds=True, checkpointInterval=-1)
    try:
        regressor = RandomForestRegressor(
            labelCol="future_ltv", predictionCol="predicted_ltv", featureSubsetStrategy="all", **settings
        ).fit(data)
        classifier = RandomForestClassifier(
            labelCol="label", predictionCol="_class", probabilityCol="_probability", rawPredictionCol="_raw",
            featureSubsetStrategy="sqrt", **settings,
        ).fit(data).copy()  # without the summary, whose session tasks cannot carry once it has observed a frame
    finally:
        data.unpersist()
    return LtvModels(encoder, regressor, classifier)


def predict_customers(models: LtvModels, customers: DataFrame) -> DataFrame:
    """Predicted amount and class of every customer, with the actual ones beside them when the target is known."""
    # scoring costs far more than the rows' bytes tell, so they are dealt out instead of read as a few files
    dealt = customers.repartition(customers.sparkSession.sparkContext.defaultParallelism)
    scored = models.classifier.transform(models.regressor.transform(models.encoder.transform(dealt)))
    labelled = decode_label(scored, "_class", "predicted_value_class")
    columns = ["customer_id", "predicted_ltv", "predicted_value_class"]
    if "future_ltv" not in customers.columns:
        return labelled.select(*columns)
    return labelled.select(
        *columns, F.col("future_ltv").alias("actual_ltv"), F.col("ltv_class").alias("actual_value_class")
    )


def feature_importance(models: LtvModels) -> DataFrame:
    """Impurity importance of each feature in the amount forest, largest first."""
    values = models.regressor.featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(models.encoder.names, values)]
    frame = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """RMSE and R2 of a prediction column."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    sums = df.agg(
        F.avg((a - p) * (a - p)).alias("mse"), F.var_pop(a).alias("variance"), F.count(F.lit(1)).alias("customers")
    )
    return sums.select("customers", F.sqrt("mse").alias("rmse"), (1 - F.try_divide("mse", "variance")).alias("r2"))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages as rows.

    Everything derives from the confusion counts, one row per (actual, predicted) pair of labels.
    """
    confusion = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = confusion.select(
        F.explode(F.array(
            F.struct(F.col("actual").alias("label"), F.lit(True).alias("is_actual")),
            F.struct(F.col("predicted").alias("label"), F.lit(False).alias("is_actual")),
        )).alias("s"),
        "n",
        (F.col("actual") == F.col("predicted")).alias("hit"),
    )
    per_class = (
        sides.groupBy(F.col("s.label").alias("label"))
        .agg(
            F.sum(F.when(F.col("s.is_actual") & F.col("hit"), F.col("n")).otherwise(0)).alias("hits"),
            F.sum(F.when(F.col("s.is_actual"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(~F.col("s.is_actual"), F.col("n")).otherwise(0)).alias("claimed"),
        )
        .withColumn("precision", safe_ratio(F.col("hits"), F.col("claimed")))
        .withColumn("recall", safe_ratio(F.col("hits"), F.col("support")))
        .withColumn(
            "f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
        )
    )
    scores = ("precision", "recall", "f1")
    support = F.sum("support")
    accuracy = F.sum("hits") / support
    overall = per_class.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), *(accuracy.alias(s) for s in scores), support.alias("support")),
            F.struct(F.lit("macro avg").alias("label"), *(F.avg(s).alias(s) for s in scores), support.alias("support")),
            F.struct(
                F.lit("weighted avg").alias("label"),
                *((F.sum(F.col(s) * F.col("support")) / support).alias(s) for s in scores),
                support.alias("support"),
            ),
        ).alias("rows")
    ).select(F.explode("rows").alias("r")).select("r.*")
    return per_class.select("label", *scores, "support").unionByName(overall)
