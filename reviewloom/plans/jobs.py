"""The usual jobs from review file to result, on JSON lines in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import text as T
from reviewloom.functions import tokens as K
from reviewloom.operators import (
    bayes,
    classify,
    clusters,
    cooc,
    features,
    grid,
    skipgram,
    tables,
    topics,
    vectors,
    vocab,
    weights,
)
from reviewloom.operators.ordering import balanced, fold_of, in_test
from reviewloom.operators.rules import Rule, apply_rules
from reviewloom.runtime import durable
from reviewloom.sources import files


def _numbered(df: DataFrame) -> DataFrame:
    """Number the rows of a file scan; the number follows file order.

    The numbered rows are written once: numbers made anew for each side of a
    join would agree only if both scans are split alike.
    """
    return durable(df.withColumn("doc_id", F.monotonically_increasing_id()))


def respace(spark: SparkSession, source: str, target: str,
            marks: Sequence[str] = tuple(T.SPACING_MARKS)) -> None:
    """Set letters and marks of review texts apart."""
    docs = files.read_jsonl(spark, source, key_ma=False)
    files.write_jsonl(docs.withColumn("review", T.spacing("review", list(marks))), target)


def tokenize(spark: SparkSession, source: str, target: str,
             tokenizer: T.Tokenizer = T.tag_by_script) -> None:
    """Turn review texts into tagged tokens by any `Column -> Column` tokenizer."""
    docs = files.read_jsonl(spark, source, key_ma=False)
    files.write_jsonl(docs.withColumn("ma", tokenizer(F.col("review"))).drop("review"), target)


def rewrite(spark: SparkSession, source: str, target: str, rules: Sequence[Rule],
            retokenise: T.Tokenizer = T.tag_by_script) -> None:
    """Apply split rules, then merge rules, to tagged tokens."""
    docs = _numbered(files.read_jsonl(spark, source))
    done = apply_rules(docs, rules, "doc_id", "ma", retokenise=retokenise)
    files.write_jsonl(done.drop("doc_id"), target)


def select_terms(spark: SparkSession, source: str, target: str,
                 choose_pos: Sequence[str] | None, min_length: int = 1,
                 max_words: int | None = vocab.MAX_WORDS, lemma: bool = True,
                 normalise_docs: bool = True, by_app: bool = False) -> DataFrame:
    """Build a dictionary, cut documents to it, write them; the dictionary is returned.

    Documents pass the same token chain as the dictionary; with
    `normalise_docs=False` their raw tokens are looked up instead. Emptied
    documents are dropped. `by_app` puts reviews of an app together, in parts
    whose order the column `part` keeps.
    """
    docs = _numbered(files.read_jsonl(spark, source))
    chain = K.filter_tokens("ma", choose_pos, min_length, lemma)
    counted = docs.select(F.explode(K.terms(chain)).alias("term")).groupBy("term").agg(
        F.count("*").alias("cnt"))
    words = vocab.indexed(counted, max_words)
    looked_up = docs.withColumn("tokens", K.terms(chain if normalise_docs else F.col("ma")))
    kept = vocab.filter_by_vocab(looked_up, words, max_words=max_words)
    out = docs.drop("ma").join(kept, "doc_id").withColumnRenamed("terms", "ma")
    if by_app:
        out = tables.per_app_docs(out, "app_id", "doc_id", "ma", "app_name", "category",
                                  rating="rating")
        out = out.withColumnRenamed("tokens", "ma").drop("docs")
    files.write_jsonl(out.drop("doc_id"), target)
    return words


def _app_tf(spark: SparkSession, source: str) -> DataFrame:
    docs = files.read_jsonl_terms(spark, source, by_app=True)
    return (docs.select("app_id", F.explode("ma").alias("term")).groupBy("app_id", "term")
            .agg(F.count("*").alias("n")))


def app_keywords(spark: SparkSession, source: str, target: str, n: int = 10) -> DataFrame:
    """Keywords of every app, written as JSON and returned as rows."""
    tf = _app_tf(spark, source)
    apps = files.read_jsonl_terms(spark, source, by_app=True).agg(
        F.count_distinct("app_id")).scalar()
    best = weights.keywords(tf, apps, "app_id", n)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))
    listed = best.groupBy("app_id").agg(F.transform(ordered, lambda x: x.term).alias("keywords"))
    files.write_json_documents(listed, target, "app_id", "keywords")
    return best


def rating_contrast(spark: SparkSession, source: str, n: int = 50, good: int = 5,
                    bad: int = 1) -> tuple[DataFrame, DataFrame]:
    """Terms of one rating only, both ways, and the two lists side by side."""
    docs = files.read_jsonl_terms(spark, source)

    def counts(rate: int) -> DataFrame:
        rows = docs.where(F.col("rating") == F.lit(str(rate))).select(F.explode("ma").alias("term"))
        return rows.groupBy("term").agg(F.count("*").alias("cnt"))
    return (weights.contrast(counts(good), counts(bad), n),
            weights.side_by_side(counts(good), counts(bad), n))


def word_network(spark: SparkSession, source: str, target: str, n_edges: int,
                 max_features: int = 500, ascending: bool = True) -> DataFrame:
    """Write all word pairs by distance; the forest of the first n is returned."""
    docs = _numbered(files.read_jsonl_terms(spark, source))

    def same(c):
        return c
    words = durable(cooc.top_vocabulary(docs, max_features, "ma", same))
    edges = cooc.cooccurrence(docs, max_features, "doc_id", "ma", same, vocab=words)
    pairs = cooc.sorted_pairs(
        cooc.correlation_distance(edges, words, max_features), ascending)
    files.write_tsv(pairs, target)
    return cooc.spanning_forest(pairs.limit(n_edges), "term_i", "term_j", "distance")


def app_clusters(spark: SparkSession, source: str, k: int | None = None, n: int = 10,
                 max_features: int = vocab.MAX_WORDS, tries: int = 10) -> tuple[DataFrame, DataFrame]:
    """Cluster report and the cross-tab of category by cluster.

    Without k there is one cluster per category.
    """
    tf = _app_tf(spark, source)
    docs = files.read_jsonl_terms(spark, source, by_app=True)
    apps = docs.agg(F.count_distinct("app_id")).scalar()
    words = vocab.indexed(tf.groupBy("term").agg(F.sum("n").alias("cnt")), max_features)
    weighed = weights.tfidf(tf, apps, "app_id", max_features=max_features, grouped=True)
    category = docs.groupBy("app_id").agg(F.min_by("category", "part").alias("category"))
    rows = features.vectors_of(weighed, words, "app_id", max_features).join(category, "app_id")
    rows = durable(rows)
    k = k or rows.select("category").distinct().count()
    model = clusters.fit_kmeans(rows, k, tries=tries)
    clustered = model.transform(rows)
    report = clusters.cluster_report(model, clustered, words, "category", n)
    return report, tables.crosstab(clustered, "category", "cluster")


def rating_classifier(spark: SparkSession, source: str, **options) -> DataFrame:
    """Naive Bayes on ratings with a quarter held out, as predictions."""
    docs = _numbered(files.read_jsonl_terms(spark, source)).withColumn("te", in_test())
    tf = (docs.select("doc_id", "rating", "te", F.explode("ma").alias("term"))
          .groupBy("doc_id", "rating", "te", "term").agg(F.count("*").alias("n")))
    model = bayes.fit(tf.where("NOT te"), docs.where("NOT te"), "doc_id", "rating", **options)
    return bayes.predict(model, tf.where("te"), docs.where("te"), "doc_id", "rating")


def _rated(spark: SparkSession, source: str) -> DataFrame:
    """Reviews with a rating: doc_id, rating, te (held out) and tokens."""
    docs = _numbered(files.read_jsonl_terms(spark, source))
    return docs.where(F.col("rating").isNotNull()).select(
        "doc_id", "rating", in_test().alias("te"), F.col("ma").alias("tokens"))


def _indexed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Ratings as labels 0, 1, ... in the order of their text."""
    order = StringIndexer(inputCol="rating", outputCol="label",
                          stringOrderType="alphabetAsc").fit(docs)
    return order.transform(docs), list(order.labels)


def svm_classifier(spark: SparkSession, source: str, **options) -> DataFrame:
    """Linear SVM on ratings with a quarter held out, (doc_id, rating, pred)."""
    docs, labels = _indexed(_rated(spark, source))
    model = classify.svm_pipeline(classes=len(labels), **options).fit(docs.where("NOT te"))
    pred = classify.predictions(model, docs.where("te"), "doc_id", "rating")
    return pred.withColumn("pred", F.get(F.array(*[F.lit(x) for x in labels]), F.col("pred")))


def rating_grid(spark: SparkSession, source: str, folds: int = 10,
                alphas: Sequence[float] = (1.0, 2.0), sublinear: Sequence[bool] = (True, False),
                **axes) -> DataFrame:
    """Cross-validated accuracy of every combination of vectoriser and smoothing."""
    docs, _ = _indexed(_rated(spark, source))
    docs = docs.withColumn("fold", fold_of("doc_id", folds))
    pipeline = classify.bayes_pipeline()
    grid = classify.bayes_grid(pipeline, list(alphas), list(sublinear), **axes)
    return classify.score_table(grid, classify.fold_scores(pipeline, grid, docs, folds, "fold"), docs)


def rating_search(spark: SparkSession, source: str, axes: grid.Axes = grid.Axes(), folds: int = 10) -> DataFrame:
    """As `rating_grid` over whole axes: all combinations and folds are counted together instead of fitted."""
    docs, _ = _indexed(_rated(spark, source))
    docs = docs.withColumn("fold", fold_of("doc_id", folds))
    return grid.grid_table(grid.fold_accuracy(docs, axes, folds))


def review_topics(spark: SparkSession, source: str, target: str, k: int = 5,
                  threshold: float | None = None, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Write reviews with their topic; give the topics' words and a map without the unknown."""
    docs = _rated(spark, source)
    counts, lda = topics.fit_topics(docs, k=k)
    placed = topics.distribution(counts, lda, docs).withColumn(
        "topic", topics.assign("topics", threshold))
    placed.select("doc_id", "rating", "topic", F.col("tokens").alias("ma")).write.json(target)
    flat = clusters.project_2d(placed, "topics", "topic", unknown=k)
    return topics.topic_words(counts, lda, n), flat.select("doc_id", "topic", "xy")


def similar_reviews(spark: SparkSession, source: str, words: Sequence[str], n: int = 20,
                    **options) -> DataFrame:
    """The n reviews nearest to a query by word vectors, (doc_id, cosine, ...)."""
    docs = _rated(spark, source)
    model = skipgram.fit_word_vectors(docs, **options)
    asked = features.infer(model, list(words))
    rows = model.transform(docs).select("doc_id", vector_to_array("vector").alias("vector"))
    return vectors.ranked_by_cosine(rows, asked, "doc_id", "vector", n)


def compare_models(spark: SparkSession, source: str, n: int = 12_500, good: str = "5",
                   bad: str = "1", **options) -> DataFrame:
    """Accuracy of naive Bayes on words and of logistic regression on word vectors.

    Both see the same n reviews of the best and of the worst rating and the same
    quarter held out.
    """
    label = F.when(F.col("rating") == good, 1).when(F.col("rating") == bad, 0)
    docs = _rated(spark, source).withColumn("label", label).where("label IS NOT NULL")
    docs = durable(balanced(docs, "label", [F.col("doc_id")], n))
    tf = (docs.select("doc_id", "label", "te", F.explode("tokens").alias("term"))
          .groupBy("doc_id", "label", "te", "term").agg(F.count("*").alias("n")))
    model = bayes.fit(tf.where("NOT te"), docs.where("NOT te"), "doc_id", "label")
    by_words = bayes.predict(model, tf.where("te"), docs.where("te"), "doc_id", "label")
    placed = skipgram.fit_word_vectors(docs.where("NOT te"), **options).transform(docs)
    logistic = classify.fit_logistic(placed.where("NOT te"), "vector", "label")
    by_vectors = classify.predictions(logistic, placed.where("te"), "label")
    return (bayes.accuracy(by_words, "label").withColumn("model", F.lit("naive_bayes"))
            .unionByName(bayes.accuracy(by_vectors, "label")
                         .withColumn("model", F.lit("vectors_logistic"))))


def unknown_report(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    """Unknown tokens with counts and documents, and their totals, of tagged reviews."""
    docs = _numbered(files.read_jsonl(spark, source))
    index = vocab.unknown_index(docs, "doc_id", "ma")
    counts = docs.select(F.explode("ma").alias("t")).groupBy(
        F.col("t.lex").alias("lex"), F.col("t.pos").alias("pos")).agg(F.count("*").alias("n"))
    return vocab.unknown_words(index), vocab.unknown_totals(counts)
