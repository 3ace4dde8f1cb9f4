"""Clusters and importances by pyspark.ml, whose training is distributed."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import stored


def prototypes(vectors: DataFrame, k: int, vec_col: str = "embedding", least: int = 3, seed: int = 42) -> DataFrame:
    """cluster, n, centroid of the k-means clusters with at least `least` members."""
    rows = vectors.withColumn("features", array_to_vector(F.col(vec_col).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    counts = model.transform(rows).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    centres = rows.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cluster int, centroid array<double>",
    )
    return counts.join(F.broadcast(centres), "cluster")


def importances(table: DataFrame, names: list[str], label: str, trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """feature and importance of a random forest on standardised features, greatest first; all 0 where
    no rows, or none of a second label, leave nothing to tell apart."""
    # Each job of the training reads the rows again: from a table, and not through the plan behind it.
    rows = VectorAssembler(inputCols=names, outputCol="raw", handleInvalid="skip").transform(stored(table.select(*names, F.col(label).cast("double").alias("label"))))
    seen = rows.agg(F.min("label").alias("least"), F.max("label").alias("most")).first()
    if seen["least"] == seen["most"]:  # null, too, where there are no rows
        return table.sparkSession.createDataFrame([(n, 0.0) for n in names], "feature string, importance double").orderBy("feature")
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(scaled)
    found = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray(), strict=True)]
    return table.sparkSession.createDataFrame(found, "feature string, importance double").orderBy(F.desc("importance"), "feature")
