"""Logistic models: of history features, and of another model's predictions (Platt calibration)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import MaxAbsScaler, MaxAbsScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import logit

#: Feature names beyond which a vocabulary is refused; there are three names a skill and a dozen others.
MOST_NAMES = 20_000
PLATT_ROWS = 30


def vocabulary(train: DataFrame) -> list[str]:
    """Names of the features that the training attempts have, in order."""
    names = [r[0] for r in train.select(F.explode(F.map_keys("features")).alias("name")).distinct().limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError("too many feature names")
    return sorted(names)


def vectors(rows: DataFrame, names: list[str]) -> DataFrame:
    """``vector`` of the named features; others are left out, absent ones are 0."""
    array = F.transform(F.array(*map(F.lit, names)), lambda k: F.coalesce(F.element_at("features", k), F.lit(0.0)))
    return rows.withColumn("vector", array_to_vector(array))


class LogisticHistory:
    """L2-regularised logistic regression (strength ``c``) over features scaled to their largest training value."""

    def __init__(self, c: float = 1.0) -> None:
        self.c = c
        self.rate: float | None = None

    def fit(self, train: DataFrame) -> LogisticHistory:
        """``train`` has ``features`` and ``correct``. One class alone gives its smoothed rate."""
        n, hits = train.agg(F.count("*"), F.coalesce(F.sum(F.col("correct").cast("int")), F.lit(0))).first()
        if not 0 < hits < n:
            self.rate = (hits + 1) / (n + 2)
            return self
        self.names = vocabulary(train)
        rows = vectors(train, self.names).withColumn("label", F.col("correct").cast("double"))
        self.scale: MaxAbsScalerModel = MaxAbsScaler(inputCol="vector", outputCol="scaled").fit(rows)
        model = LogisticRegression(featuresCol="scaled", labelCol="label", regParam=1 / (self.c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8)
        self.model: LogisticRegressionModel = model.fit(self.scale.transform(rows))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.rate is not None:
            return rows.withColumn("probability", F.lit(self.rate))
        out = self.model.transform(self.scale.transform(vectors(rows, self.names)).drop("probability"))
        return out.withColumn("probability", vector_to_array("probability")[1]).drop("vector", "scaled", "rawPrediction", "prediction")

    def save(self, spark: SparkSession, path: str) -> None:
        """Keeps the fitted model in a folder; :meth:`load` gives one that predicts the same."""
        names = self.names if self.rate is None else []
        spark.createDataFrame([(self.c, self.rate, names)], "c double, rate double, names array<string>").coalesce(1).write.parquet(f"{path}/settings")
        if self.rate is None:
            self.scale.write().save(f"{path}/scale")
            self.model.write().save(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LogisticHistory:
        row = spark.read.parquet(f"{path}/settings").first()
        out = LogisticHistory(row["c"])
        out.rate = row["rate"]
        if out.rate is None:
            out.names = list(row["names"])
            out.scale, out.model = MaxAbsScalerModel.load(f"{path}/scale"), LogisticRegressionModel.load(f"{path}/model")
        return out

    def associations(self, most: int = 30) -> list[tuple[str, float]]:
        """The names with the largest coefficients."""
        pairs = zip(self.names, self.model.coefficients.toArray().tolist(), strict=True) if self.rate is None else ()
        return sorted(pairs, key=lambda x: (-abs(x[1]), x[0]))[:most]


def platt(validation: DataFrame) -> tuple[float, float]:
    """Slope and intercept that calibrate logits, (1, 0) for too few rows or one class. ``validation`` has ``correct`` and ``probability``."""
    rows = validation.select(F.col("correct").cast("double").alias("label"), logit(F.col("probability")).alias("x")).persist()  # or a fit makes the predictions again and again
    try:
        n, hits = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if n < PLATT_ROWS or not 0 < hits < n:
            return 1.0, 0.0
        points = rows.select("label", array_to_vector(F.array("x")).alias("vector"))
        model = LogisticRegression(featuresCol="vector", labelCol="label", regParam=1 / n, standardization=False, maxIter=200, tol=1e-10).fit(points)
        return float(model.coefficients[0]), float(model.intercept)
    finally:
        rows.unpersist()


def calibrated(predictions: DataFrame, slope: float, intercept: float) -> DataFrame:
    return predictions.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(slope) * logit(F.col("probability")) + F.lit(intercept)))))
