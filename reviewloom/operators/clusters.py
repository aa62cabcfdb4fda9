"""K-means on documents and vectors, and the cluster report."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.tokens import term_lex
from reviewloom.operators.ordering import top_n


def fit_kmeans(df: DataFrame, k: int, features: str = "features", tries: int = 10,
               cosine: bool = False, max_iter: int = 300, tol: float = 1e-4,
               seed: int = 7) -> KMeansModel:
    """The best of `tries` seeded runs by training cost."""
    best = None
    for i in range(tries):
        model = KMeans(k=k, featuresCol=features, predictionCol="cluster", maxIter=max_iter,
                       tol=tol, seed=seed + i,
                       distanceMeasure="cosine" if cosine else "euclidean").fit(df)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best


def silhouette(df: DataFrame, features: str = "features", cosine: bool = False) -> float:
    return ClusteringEvaluator(
        featuresCol=features, predictionCol="cluster",
        distanceMeasure="cosine" if cosine else "squaredEuclidean").evaluate(df)


def center_words(model: KMeansModel, vocab: DataFrame, n: int = 10) -> DataFrame:
    """Heaviest words of every centre without their tags, (cluster, rank, word).

    Centres are k rows of vocabulary width.
    """
    centers = vocab.sparkSession.createDataFrame(
        [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())],
        "cluster int, center array<double>")
    return heaviest(centers, "cluster", "center", n).join(vocab.select("term", "idx"), "idx").select(
        "cluster", "rank", term_lex("term").alias("word"))


def heaviest(rows: DataFrame, key: str, values: str, n: int) -> DataFrame:
    """Places of the n largest entries of an array per key, (key, rank, idx, weight).

    Equal entries go by place.
    """
    entries = rows.select(key, F.posexplode(values).alias("idx", "weight"))
    return top_n(entries, key, [F.col("weight").desc(), F.col("idx")], n)


def cluster_sizes(clustered: DataFrame, category: str) -> DataFrame:
    """Members and categories per cluster, (cluster, size, categories).

    Counted per category first, so a list has one entry per category.
    """
    pairs = clustered.groupBy("cluster", category).agg(F.count("*").alias("n"))
    return pairs.groupBy("cluster").agg(
        F.sum("n").alias("size"), F.sort_array(F.collect_set(category)).alias("categories"))


def cluster_report(model: KMeansModel, clustered: DataFrame, vocab: DataFrame, category: str,
                   n: int = 10) -> DataFrame:
    """One row per cluster, empty ones too: words, size, categories; numbered from 1."""
    spark = clustered.sparkSession
    k = len(model.clusterCenters())
    every = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    words = center_words(model, vocab, n).groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x.word)
        .alias("words"))
    sizes = cluster_sizes(clustered, category)
    return (every.join(words, "cluster", "left").join(sizes, "cluster", "left")
            .select((F.col("cluster") + 1).alias("cluster"), "words",
                    F.coalesce("size", F.lit(0)).alias("size"),
                    F.coalesce("categories", F.array().cast("array<string>")).alias("categories")))


def project_2d(df: DataFrame, features: str = "features", label: str | None = None,
               unknown: int | None = None) -> DataFrame:
    """First two principal components as `xy`; rows of the unknown label can be left out."""
    model = PCA(k=2, inputCol=features, outputCol="xy").fit(df)
    out = model.transform(df)
    return out if unknown is None else out.where(F.col(label) != unknown)
