"""Exact parts of the model operators over given tables, and properties every trained model must have."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import LocalLDAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import bayes, centers, classify, clusters, ordering, paragraphs, sgd, skipgram, topics
from reviewloom.plans import models
from reviewloom.plans.registry import query, table
from reviewloom.plans.weighting import bayes_model, rated_tf
from reviewloom.runtime import durable, scratch_path

DIMENSIONS = 64
TOPIC = 3


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as if they were topic weights."""
    rows = table(spark, sf, "embeddings")
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    return rows.select("vec_id", "label", vector.alias("topics"))


_ARGMAX = """WITH a AS (SELECT vec_id, label, embedding AS e,
  list_position(embedding, list_max(embedding)) - 1 AS topic FROM embeddings)"""


@query("cluster_members", """
SELECT lang AS cluster, count(*) AS size,
  array_to_string(list_sort(list(DISTINCT source)), ',') AS categories
FROM documents GROUP BY lang""")
def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("lang").alias("cluster"), "source")
    return clusters.cluster_sizes(docs, "source").withColumn(
        "categories", F.array_join("categories", ","))


@query("topic_argmax", f"""{_ARGMAX}
SELECT vec_id, CAST(topic AS INTEGER) AS topic,
  CAST(CASE WHEN list_max(e) >= 0.3 THEN topic ELSE {DIMENSIONS} END AS INTEGER) AS or_unknown,
  list_sum(list_transform(e, lambda x: CASE WHEN x >= 0.3 THEN 1 ELSE 0 END)) AS flags FROM a""")
def topic_argmax(spark: SparkSession, sf: str) -> DataFrame:
    flags = F.slice(topics.assign_flags("topics", 0.3), 1, DIMENSIONS)
    return _entries(spark, sf).select(
        "vec_id", topics.assign("topics").alias("topic"),
        topics.assign("topics", 0.3).alias("or_unknown"),
        F.aggregate(flags, F.lit(0), lambda s, x: s + x).cast("bigint").alias("flags"))


@query("topic_counts", f"""{_ARGMAX}
SELECT CAST(k AS INTEGER) AS topic, count(vec_id) AS n
FROM range({DIMENSIONS}) r(k) LEFT JOIN a ON topic = k GROUP BY k""")
def topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _entries(spark, sf).select(topics.assign("topics").alias("topic"))
    return topics.topic_sizes(rows, "topic", DIMENSIONS)


@query("topic_members", f"{_ARGMAX} SELECT vec_id, label FROM a WHERE topic = {TOPIC}")
def topic_members(spark: SparkSession, sf: str) -> DataFrame:
    rows = _entries(spark, sf)
    return rows.where(topics.assign("topics") == TOPIC).select("vec_id", "label")


@query("center_heads", """
WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS idx
           FROM embeddings),
  m AS (SELECT label, idx, round(avg(CAST(x AS DOUBLE)), 6) AS weight FROM e GROUP BY ALL)
SELECT label, CAST(idx AS INTEGER) AS idx, weight,
  row_number() OVER (PARTITION BY label ORDER BY weight DESC, idx) AS rank FROM m
QUALIFY row_number() OVER (PARTITION BY label ORDER BY weight DESC, idx) <= 5""")
def center_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Largest entries of the mean vector of each label."""
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "m")))
    centers = means.groupBy("label").agg(F.transform(ordered, lambda p: p.m).alias("center"))
    return clusters.heaviest(centers, "label", "center", 5).select(
        "label", "idx", "weight", F.col("rank").cast("bigint").alias("rank"))


@query("fold_counts", """
SELECT CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS INTEGER)
  AS fold, count(*) AS n FROM documents GROUP BY 1""")
def fold_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(ordering.fold_of("doc_id", 10).alias("fold"))
    return docs.groupBy("fold").agg(F.count("*").alias("n"))


@query("hash_sample", """
SELECT doc_id, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '/7'), doc_id
LIMIT 20""")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return ordering.hash_sample(docs, "doc_id", 20, 7)


@query("kmeans_properties", """
SELECT vec_id, TRUE AS nearest, TRUE AS better_than_one FROM embeddings""")
def kmeans_properties(spark: SparkSession, sf: str) -> DataFrame:
    """The assigned centre is the nearest one, and ten centres cost less than one."""
    rows = models.vector_rows(spark, sf)
    model = centers.fit_tries(rows, 10)
    entries = rows.select(F.posexplode(vector_to_array("features")).alias("i", "x"))
    spread = entries.groupBy("i").agg((F.var_pop("x") * F.count("*")).alias("s"))
    better = model.cost < spread.agg(F.sum("s")).first()[0]
    return nearest_centers(model.transform(rows), model.clusterCenters()).select(
        "vec_id", "nearest", F.lit(better).alias("better_than_one"))


@query("kmeans_tries_properties", "SELECT vec_id, TRUE AS nearest, TRUE AS as_cheap, TRUE AS settled FROM embeddings")
def kmeans_tries_properties(spark: SparkSession, sf: str) -> DataFrame:
    """The cosine model of 20 runs in one scan.

    Every row has its nearest centre, the runs together cost no more than Spark's own run within 2 %, and every centre
    points along the sum of its members.
    """
    rows = models.vector_rows(spark, sf)
    model = centers.fit_tries(rows, 10, tries=20, cosine=True)
    own = clusters.fit_kmeans(rows, 10, tries=1, cosine=True)
    clustered = model.transform(rows).withColumn("x", vector_to_array("features")).persist()
    entries = clustered.select("cluster", F.posexplode("x").alias("i", "v"))
    sums = entries.groupBy("cluster", "i").agg(F.sum("v").alias("s")).collect()
    length = {}
    for r in sums:
        length[r["cluster"]] = length.get(r["cluster"], 0.0) + r["s"] ** 2
    off = max(abs(r["s"] / length[r["cluster"]] ** 0.5 - model.centers[r["cluster"]][r["i"]]) for r in sums)
    dots = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: a * b), F.lit(0.0),
                        lambda s, v: s + v) for c in model.centers]
    return clustered.select(
        "vec_id", (F.array(*dots)[F.col("cluster")] >= F.greatest(*dots) - 1e-9).alias("nearest"),
        F.lit(model.cost <= 1.02 * own.summary.trainingCost).alias("as_cheap"), F.lit(off < 1e-3).alias("settled"))


@query("minibatch_properties", "SELECT TRUE AS near_full_cost, TRUE AS reads_a_share")
def minibatch_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Mini-batches cost at most 5 % more than whole passes; a step reads a twentieth of the rows, within chance."""
    rows = models.vector_rows(spark, sf)
    full, model = centers.fit_tries(rows, 10, tries=5), centers.fit_minibatch(rows, 10, "vec_id")
    entries = model.transform(rows).select("cluster", vector_to_array("features").alias("x"))
    middle = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.centers])[F.col("cluster")]
    apart = F.aggregate(F.zip_with("x", middle, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    parts = rows.groupBy(centers.part_of("vec_id", 20, 7)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return entries.agg((F.sum(apart) <= 1.05 * full.cost).alias("near_full_cost")).withColumn(
        "reads_a_share", F.lit(parts <= rows.count() / 20 * 2 + 10))


def nearest_centers(clustered: DataFrame, centers: list) -> DataFrame:
    """Whether no centre is nearer than the one of `cluster`."""
    x = vector_to_array("features")

    def apart(c) -> Column:
        center = F.array(*[F.lit(float(v)) for v in c])
        return F.aggregate(F.zip_with(x, center, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                           lambda s, d: s + d)
    d = F.array(*[apart(c) for c in centers])
    return clustered.withColumn(
        "nearest", F.get(d, F.col("cluster")) <= F.array_min(d) + F.lit(1e-9))


@query("topic_properties", """
SELECT doc_id, TRUE AS one, TRUE AS is_largest FROM documents""")
def topic_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Topic weights add up to one and the assigned topic has the largest."""
    p = vector_to_array("topics")
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return models.topic_rows(spark, sf).select(
        "doc_id", (F.abs(total - 1) < 1e-6).alias("one"),
        (F.get(p, topics.assign("topics")) == F.array_max(p)).alias("is_largest"))


@query("pca_properties", "SELECT TRUE AS orthogonal, TRUE AS by_variance")
def pca_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Components are uncorrelated, the first has the larger variance."""
    xy = vector_to_array("xy")
    out = clusters.project_2d(models.vector_rows(spark, sf)).select(
        xy[0].alias("x"), xy[1].alias("y"))
    return out.agg((F.abs(F.corr("x", "y")) < 1e-6).alias("orthogonal"),
                   (F.variance("x") >= F.variance("y")).alias("by_variance"))


@query("pca_known", f"{_ARGMAX} SELECT vec_id FROM a WHERE topic <> {TOPIC}")
def pca_known(spark: SparkSession, sf: str) -> DataFrame:
    """Projection without the rows of the unknown topic."""
    rows = _entries(spark, sf).withColumn("topic", topics.assign("topics"))
    out = clusters.project_2d(rows, "topics", "topic", unknown=TOPIC)
    return out.where(F.col("xy").isNotNull()).select("vec_id")


@query("svm_properties", "SELECT TRUE AS beats_majority")
def svm_properties(spark: SparkSession, sf: str) -> DataFrame:
    """On its training rows the machine is at least as good as the most frequent class."""
    docs = models.rated_words(spark, sf).where("NOT te")
    model = classify.svm_pipeline(classes=2).fit(docs)
    return beats_majority(classify.predictions(model, docs, "doc_id", "label"), "label")


def beats_majority(pred: DataFrame, label: str) -> DataFrame:
    counts = durable(pred.groupBy(label, "pred").agg(F.count("*").alias("n")))
    right = counts.agg(F.sum(F.when(F.col(label) == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    most = counts.groupBy(label).agg(F.sum("n").alias("n")).agg(F.max("n").alias("most"))
    return right.select((F.col("right") >= most.scalar()).alias("beats_majority"))


@query("sgd_properties", "SELECT TRUE AS separates, TRUE AS beats_majority")
def sgd_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Of the test documents, 95 % get their own one of four languages, more than by always naming the most frequent."""
    train, test, width = models.language_vectors(spark, sf)
    pred = sgd.fit_hinge(train, "features", "lang", width)[0].predict(test).persist()
    right = bayes.accuracy(pred, "lang").select((F.col("accuracy") >= 0.95).alias("separates"))
    return right.withColumn("beats_majority", F.lit(beats_majority(pred, "lang").first()[0]))


@query("paragraph_properties", """
WITH t AS (SELECT 'doc:' || doc_id AS tag FROM documents UNION SELECT 'source:' || source FROM documents)
SELECT tag, TRUE AS whole FROM t WHERE tag IS NOT NULL""")
def paragraph_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Every tag has a vector of full width without gaps."""
    _, model = models.tagged(spark, sf)
    whole = (F.size("vector") == models.SIZE) & F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6))
    return model.tags.select("tag", whole.alias("whole"))


@query("inferred_share")
def inferred_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of documents of ten words or more that, inferred as new, have their own vector among the nearest ten.

    Asked for are the documents whose id is divisible by 10, against the vectors of all documents.
    """
    docs, model = models.tagged(spark, sf)
    asked = model.infer(docs.where("doc_id % 10 = 0 AND size(tokens) >= 10"))
    return paragraphs.share_found(asked, model.tags.where("tag LIKE 'doc:%'"), 10)


@query("grid_properties", "SELECT TRUE AS best_is_largest, TRUE AS one_best")
def grid_properties(spark: SparkSession, sf: str) -> DataFrame:
    rows = models.cv_grid(spark, sf)
    best = F.max(F.when(F.col("is_best"), F.col("accuracy")))
    return rows.agg((best == F.max("accuracy")).alias("best_is_largest"),
                    (F.count_if("is_best") == 1).alias("one_best"))


@query("models_saved", """
SELECT unnest(['lda', 'word_vectors', 'naive_bayes', 'pipeline']) AS model, TRUE AS same""")
def models_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Topic, vector and text models give the same results after they were saved and loaded."""
    path = scratch_path(spark, "models")
    docs = models.words_of(spark, sf)

    def agree(name: str, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
        value = [c for c in before.columns if c != key][0]
        both = before.join(after.select(key, F.col(value).alias("again")), key)
        same = F.coalesce(F.bool_and(F.col(value).eqNullSafe(F.col("again"))), F.lit(False))
        return both.agg(same.alias("same")).select(F.lit(name).alias("model"), "same")

    counts, lda = topics.fit_topics(docs, k=models.TOPICS)
    lda.write().save(f"{path}/lda")
    out = agree("lda", topics.distribution(counts, lda, docs).select("doc_id", "topics"),
                topics.distribution(counts, LocalLDAModel.load(f"{path}/lda"), docs), "doc_id")
    vec = skipgram.fit_word_vectors(docs, size=20, epochs=1)
    vec.save(f"{path}/vec")
    out = out.unionByName(agree(
        "word_vectors", vec.transform(docs).select("doc_id", "vector"),
        skipgram.WordVectors.load(spark, f"{path}/vec", vec.size).transform(docs), "doc_id"))

    rated, tf = rated_tf(spark, sf)
    model = bayes_model(spark, sf)
    bayes.save(model, f"{path}/bayes")
    asked = tf.where("te"), rated.where("te"), "doc_id", "y"
    out = out.unionByName(agree(
        "naive_bayes", bayes.predict(model, *asked).select("doc_id", "pred"),
        bayes.predict(bayes.load(spark, f"{path}/bayes"), *asked), "doc_id"))

    words = models.rated_words(spark, sf)
    fitted = classify.bayes_pipeline().fit(words.where("NOT te"))
    fitted.write().save(f"{path}/pipeline")
    test = words.where("te")
    return out.unionByName(agree(
        "pipeline", classify.predictions(fitted, test, "doc_id"),
        classify.predictions(PipelineModel.load(f"{path}/pipeline"), test, "doc_id"), "doc_id"))
