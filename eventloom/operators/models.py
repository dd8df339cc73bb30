"""Models per telescope type: training, prediction, signed displacement, and cross-validation with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.selection import valid_rows


def _pipeline(estimator, features: list[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep"), estimator])


def regressor(kind: str = "forest", seed: int = 0):
    e = RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed) if kind == "forest" else LinearRegression()
    return e.setFeaturesCol("__features").setLabelCol("__label").setPredictionCol("__prediction")


def classifier(kind: str = "forest", seed: int = 0):
    e = RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed) if kind == "forest" else LogisticRegression()
    return e.setFeaturesCol("__features").setLabelCol("__label").setPredictionCol("__prediction").setProbabilityCol("__probability").setRawPredictionCol("__raw")


@dataclass
class Models:
    """One fitted pipeline per telescope type; rows of an unknown type or with invalid features get NaN."""

    features: list[str]
    log_target: bool = False
    classify: bool = False
    fitted: dict[str, PipelineModel] = field(default_factory=dict)

    def fit(self, key: str, df: DataFrame, target: str, estimator=None) -> Models:
        label = F.ln(F.col(target)) if self.log_target else F.col(target).cast("double")
        d = df.where(valid_rows(df, [*self.features, target])).withColumn("__label", label)
        estimator = estimator or (classifier() if self.classify else regressor())
        self.fitted[key] = _pipeline(estimator, self.features).fit(d)
        return self

    def predict(self, df: DataFrame, kind: str, name: str) -> DataFrame:
        """df with `name` and `name`_is_valid; types are scored in turn over disjoint row sets."""
        out, known = [], []
        for key, model in sorted(self.fitted.items()):
            known.append(key)
            d = model.transform(df.where(F.col(kind) == key))
            p = vector_to_array("__probability")[1] if self.classify else (F.exp("__prediction") if self.log_target else F.col("__prediction"))
            p = F.when(valid_rows(df, self.features), p).otherwise(F.lit(float("nan")))
            out.append(d.withColumn(name, p).select(*df.columns, name))
        rest = df.where(~F.col(kind).isin(known) | F.col(kind).isNull()).withColumn(name, F.lit(float("nan")))
        for d in out:
            rest = rest.unionByName(d)
        return rest.withColumn(f"{name}_is_valid", ~F.isnan(name))

    def save(self, path: str) -> None:
        for key, model in self.fitted.items():
            model.write().overwrite().save(f"{path}/{key}")

    @staticmethod
    def load(path: str, keys: list[str], features: list[str], **how) -> Models:
        return Models(features, fitted={k: PipelineModel.load(f"{path}/{k}") for k in keys}, **how)


def signed_displacement(size: Column, sign_score: Column) -> tuple[Column, Column]:
    """(displacement, score): the regressed length with the classified sign; the score is how sure the sign is."""
    return F.when(sign_score >= 0.5, size).otherwise(-size), F.abs(2 * sign_score - 1)


def displaced_source(x: Column, y: Column, psi: Column, displacement: Column) -> tuple[Column, Column]:
    return x + displacement * F.cos(psi), y + displacement * F.sin(psi)


def folds(df: DataFrame, key: list[str], k: int, seed: int = 0) -> DataFrame:
    """df with fold, a seeded hash of the key: the same rows fall into the same fold in every run."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(k)).cast("int"))


def cross_validate(df: DataFrame, features: list[str], target: str, key: list[str], k: int = 3, classify: bool = False, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """(rows with their out-of-fold prediction, score per fold): r2 for regression, area under the ROC for classification."""
    d = folds(df, key, k, seed)
    out, scores = [], []
    for i in range(k):
        m = Models(features, classify=classify).fit("all", d.where(F.col("fold") != i), target)
        p = m.predict(d.where(F.col("fold") == i).withColumn("__all", F.lit("all")), "__all", "prediction").drop("__all")
        p = p.withColumn("__truth", F.col(target).cast("double"))
        ok = p.where("prediction_is_valid")
        e = BinaryClassificationEvaluator(rawPredictionCol="prediction", labelCol="__truth") if classify else RegressionEvaluator(predictionCol="prediction", labelCol="__truth", metricName="r2")
        scores.append(e.evaluate(ok))
        out.append(p.drop("__truth"))
    both = out[0]
    for p in out[1:]:
        both = both.unionByName(p)
    return both, scores
