"""TF-IDF, keywords, contrasts, co-occurrence, naive Bayes, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import bayes, cooc, vectors, vocab, weights
from reviewloom.operators.ordering import in_test
from reviewloom.plans.corpus import docs_of
from reviewloom.plans.registry import TOK, documents, query, table
from reviewloom.plans.reviews import labelled
from reviewloom.runtime import by_document, durable

TERMS = 500
NEAREST_PAIRS = 200


def _count(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


@query("tfidf_keywords", f"""
WITH {TOK},
  tf AS (SELECT source, w AS term, count(*) AS n FROM tok JOIN documents USING (doc_id)
         GROUP BY ALL),
  nd AS (SELECT count(DISTINCT source) AS nd FROM documents),
  idf AS (SELECT term, ln((1e0 + nd) / (count(*) + 1e0)) + 1e0 AS idf FROM tf, nd
          GROUP BY term, nd),
  raw AS (SELECT source, term, n * idf AS raw FROM tf JOIN idf USING (term)),
  nrm AS (SELECT source, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY source),
  r AS (SELECT source, term, raw,
          row_number() OVER (PARTITION BY source ORDER BY round(raw, 6) DESC, term) AS rank
        FROM raw)
SELECT source, term, round(raw / norm, 6) AS weight, rank FROM r JOIN nrm USING (source)
WHERE rank <= 10""")
def tfidf_keywords(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "source", "text")
    n_docs = table(spark, sf, "documents").agg(F.count_distinct("source")).scalar()
    tf = (vocab.token_rows(docs, "source", name="term").groupBy("source", "term")
          .agg(F.count("*").alias("n")))
    best = weights.keywords(tf, n_docs, "source", 10)
    return best.select("source", "term", F.round("weight", 6).alias("weight"),
                       F.col("rank").cast("bigint").alias("rank"))


def doc_tf(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    return vocab.bag_of_words(by_document(docs_of(spark, sf))), _count(table(spark, sf, "documents"))


_DOC_TF = f"""WITH {TOK},
  tf AS (SELECT doc_id, w AS term, count(*) AS n FROM tok GROUP BY ALL),
  nd AS (SELECT count(*) AS nd FROM documents)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.round("weight", 6))


@query("tfidf", f"""{_DOC_TF},
  idf AS (SELECT term, ln((1e0 + nd) / (count(*) + 1e0)) + 1e0 AS idf FROM tf, nd
          GROUP BY term, nd),
  raw AS (SELECT doc_id, term, n * idf AS raw FROM tf JOIN idf USING (term))
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight
FROM raw""")
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    tf, n_docs = doc_tf(spark, sf)
    return _rounded(weights.tfidf(tf, n_docs, "doc_id"))


@query("tfidf_opts", f"""{_DOC_TF},
  kept AS (SELECT term FROM tf GROUP BY term ORDER BY sum(n) DESC, term LIMIT 5000),
  ktf AS (SELECT * FROM tf WHERE term IN (SELECT term FROM kept)),
  idf AS (SELECT term, ln(nd / CAST(count(*) AS DOUBLE)) + 1e0 AS idf FROM ktf, nd
          GROUP BY term, nd),
  raw AS (SELECT doc_id, term, (1e0 + ln(n)) * idf AS raw FROM ktf JOIN idf USING (term))
SELECT doc_id, term, round(raw / sum(raw) OVER (PARTITION BY doc_id), 6) AS weight FROM raw""")
def tfidf_opts(spark: SparkSession, sf: str) -> DataFrame:
    tf, n_docs = doc_tf(spark, sf)
    return _rounded(weights.tfidf(tf, n_docs, "doc_id", idf="plain", sublinear=True, norm="l1",
                                  max_features=5000))


@query("tfidf_log2", f"""{_DOC_TF},
  idf AS (SELECT term, log2(nd / CAST(count(*) AS DOUBLE)) AS idf FROM tf, nd
          GROUP BY term, nd),
  raw AS (SELECT doc_id, term, n * idf AS raw FROM tf JOIN idf USING (term) WHERE idf <> 0)
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight
FROM raw""")
def tfidf_log2(spark: SparkSession, sf: str) -> DataFrame:
    tf, n_docs = doc_tf(spark, sf)
    return _rounded(weights.tfidf(tf, n_docs, "doc_id", idf="log2", drop_zero=True))


def rating_counts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = labelled(spark, sf)

    def counts(y: int) -> DataFrame:
        rows = vocab.token_rows(docs.where(F.col("y") == y), name="term")
        return rows.groupBy("term").agg(F.count("*").alias("cnt"))
    return counts(1), counts(0)


_RATED = f"""WITH {TOK},
  c AS (SELECT quality AS y, w AS term, count(*) AS cnt FROM tok JOIN labels USING (doc_id)
        GROUP BY ALL),
  r AS (SELECT y, term, cnt, row_number() OVER (PARTITION BY y ORDER BY cnt DESC, term) AS r
        FROM c)"""


@query("contrast_terms", f"""{_RATED},
  g AS (SELECT term, cnt FROM r WHERE y = 1 AND r <= 50),
  b AS (SELECT term, cnt FROM r WHERE y = 0 AND r <= 50),
  go AS (SELECT term, cnt, row_number() OVER (ORDER BY cnt DESC, term) AS rank FROM g
         WHERE term NOT IN (SELECT term FROM b)),
  bo AS (SELECT term, cnt, row_number() OVER (ORDER BY cnt DESC, term) AS rank FROM b
         WHERE term NOT IN (SELECT term FROM g))
SELECT coalesce(go.rank, bo.rank) AS rank, go.term AS term_good, go.cnt AS cnt_good,
  bo.term AS term_bad, bo.cnt AS cnt_bad FROM go FULL JOIN bo ON go.rank = bo.rank""")
def contrast_terms(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = rating_counts(spark, sf)
    return weights.contrast(good, bad, 50).withColumn("rank", F.col("rank").cast("bigint"))


@query("rating_terms", f"""{_RATED}
SELECT coalesce(g.r, b.r) AS rank, g.term AS term_good, g.cnt AS cnt_good, b.term AS term_bad,
  b.cnt AS cnt_bad FROM (SELECT * FROM r WHERE y = 1 AND r <= 50) g
FULL JOIN (SELECT * FROM r WHERE y = 0 AND r <= 50) b ON g.r = b.r""")
def rating_terms(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = rating_counts(spark, sf)
    return weights.side_by_side(good, bad, 50).withColumn("rank", F.col("rank").cast("bigint"))


@query("term_overlap", f"""{_RATED},
  k AS (SELECT unnest([10, 50]) AS k)
SELECT CAST(k AS BIGINT) AS k, (SELECT count(*) FROM r g JOIN r b ON g.term = b.term
    WHERE g.y = 1 AND b.y = 0 AND g.r <= k AND b.r <= k) AS shared FROM k""")
def term_overlap(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = rating_counts(spark, sf)
    return weights.overlap(good, bad, [10, 50])


_PAIRS = f"""WITH {TOK},
  dt AS (SELECT DISTINCT doc_id, w AS term FROM tok),
  v AS (SELECT term FROM dt GROUP BY term ORDER BY count(*) DESC, term LIMIT {TERMS}),
  vd AS (SELECT doc_id, term FROM dt JOIN v USING (term)),
  e AS (SELECT a.term AS term_i, b.term AS term_j, count(*) AS n FROM vd a JOIN vd b
        ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY ALL)"""


@query("cooccurrence", f"{_PAIRS} SELECT term_i, term_j, n FROM e")
def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return cooc.cooccurrence(docs_of(spark, sf), TERMS)


def distances(spark: SparkSession, sf: str) -> DataFrame:
    docs = docs_of(spark, sf)
    vocabulary = durable(cooc.top_vocabulary(docs, TERMS))
    return cooc.correlation_distance(
        cooc.cooccurrence(docs, TERMS, vocab=vocabulary), vocabulary, TERMS)


_DISTANCES = f"""{_PAIRS},
  m AS (SELECT term_i AS t, term_j AS k, n FROM e UNION ALL SELECT term_j, term_i, n FROM e),
  s AS (SELECT t, CAST(sum(n) AS DOUBLE) AS s,
          sqrt({TERMS} * CAST(sum(n * n) AS DOUBLE) - CAST(sum(n) AS DOUBLE) * sum(n)) AS d
        FROM m GROUP BY t),
  x AS (SELECT a.t AS a, b.t AS b, CAST(sum(a.n * b.n) AS DOUBLE) AS xy FROM m a
        JOIN m b ON a.k = b.k AND a.t < b.t GROUP BY ALL),
  p AS (SELECT a.t AS a, b.t AS b, a.s AS sa, b.s AS sb, a.d AS da, b.d AS db FROM s a
        JOIN s b ON a.t < b.t WHERE a.d > 0 AND b.d > 0),
  f AS (SELECT a, b, 1e0 - ({TERMS} * coalesce(xy, 0) - sa * sb) / (da * db) AS distance
        FROM p LEFT JOIN x USING (a, b))"""


@query("term_distance", f"""{_DISTANCES}
SELECT a AS term_i, b AS term_j, round(distance, 6) AS distance FROM f WHERE distance <> 0""")
def term_distance(spark: SparkSession, sf: str) -> DataFrame:
    return cooc.sorted_pairs(distances(spark, sf)).withColumn(
        "distance", F.round("distance", 6))


@query("mst_edges", f"""{_DISTANCES.replace("WITH", "WITH RECURSIVE", 1)},
  g AS (SELECT a, b, round(distance, 6) AS d FROM f WHERE distance <> 0),
  n AS (SELECT a, b, d, row_number() OVER (ORDER BY d, a, b) AS r FROM g
        QUALIFY row_number() OVER (ORDER BY d, a, b) <= {NEAREST_PAIRS}),
  reach AS (SELECT r, a AS v FROM n
            UNION SELECT reach.r, CASE WHEN n.a = v THEN n.b ELSE n.a END
            FROM reach JOIN n ON n.r < reach.r AND (n.a = v OR n.b = v))
SELECT a AS term_i, b AS term_j, d AS distance FROM n
WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.r = n.r AND reach.v = n.b)""")
def mst_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Forest of the nearest pairs; an edge is left out if smaller ones join its ends already."""
    nearest = cooc.sorted_pairs(distances(spark, sf)).limit(NEAREST_PAIRS)
    rounded = nearest.withColumn("distance", F.round("distance", 6))
    return cooc.spanning_forest(rounded, "term_i", "term_j", "distance")


@query("count_vectors", f"""WITH {TOK}, tf AS (SELECT doc_id, w AS term, count(*) AS n FROM tok GROUP BY ALL),
  top AS (SELECT term FROM tf GROUP BY term ORDER BY sum(n) DESC, term LIMIT 2000)
SELECT doc_id, term, CAST(n AS DOUBLE) AS weight FROM tf JOIN top USING (term)""")
def count_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the 2,000 most frequent words as weights, the other vectoriser."""
    tf = vocab.bag_of_words(documents(spark, sf, "text"))
    return weights.vectorise(tf, F.lit(0), "doc_id", "count", 2000)


def rated_tf(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents with their test flag, and their term frequencies."""
    docs = by_document(labelled(spark, sf)).select("doc_id", "y", "text", in_test().alias("te"))
    tf = (vocab.token_rows(docs, "doc_id", "y", "te", name="term")
          .groupBy("doc_id", "y", "te", "term").agg(F.count("*").alias("n")))
    return docs.select("doc_id", "y", "te"), tf


def bayes_model(spark: SparkSession, sf: str) -> bayes.BayesModel:
    docs, tf = rated_tf(spark, sf)
    return bayes.fit(tf.where("NOT te"), docs.where("NOT te"), "doc_id", "y")


def bayes_predictions(spark: SparkSession, sf: str) -> DataFrame:
    docs, tf = rated_tf(spark, sf)
    model = bayes.fit(tf.where("NOT te"), docs.where("NOT te"), "doc_id", "y")
    return bayes.predict(model, tf.where("te"), docs.where("te"), "doc_id", "y")


_BAYES = f"""WITH {TOK},
  lab AS (SELECT doc_id, quality AS y, (doc_id * 2654435761) % 4294967296 % 100 < 25 AS te
          FROM labels JOIN documents USING (doc_id)),
  tf AS (SELECT doc_id, w AS term, y, te, count(*) AS n FROM tok JOIN lab USING (doc_id)
         GROUP BY ALL),
  nd AS (SELECT count(*) AS nd FROM lab WHERE NOT te),
  idf AS (SELECT term, ln((1e0 + nd) / (count(*) + 1e0)) + 1e0 AS idf FROM tf, nd WHERE NOT te
          GROUP BY term, nd),
  raw AS (SELECT doc_id, term, y, te, n * idf AS raw FROM tf JOIN idf USING (term)),
  w AS (SELECT doc_id, term, y, te, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w
        FROM raw),
  cls AS (SELECT y AS c, ln(count(*) / CAST(any_value(nd) AS DOUBLE)) AS prior FROM lab, nd
          WHERE NOT te GROUP BY y),
  tot AS (SELECT y AS c, sum(w) AS total FROM w WHERE NOT te GROUP BY y),
  sums AS (SELECT y AS c, term, sum(w) AS s FROM w WHERE NOT te GROUP BY y, term),
  vs AS (SELECT count(*) AS v FROM idf),
  ll AS (SELECT c, term, ln(coalesce(s, 0) + 1e0) - ln(total + v) AS ll
         FROM (SELECT c, term FROM cls, idf) g LEFT JOIN sums USING (c, term)
         JOIN tot USING (c), vs),
  part AS (SELECT doc_id, c, sum(w * ll) AS part FROM w JOIN ll USING (term) WHERE te
           GROUP BY doc_id, c),
  sc AS (SELECT lab.doc_id, lab.y, cls.c, round(prior + coalesce(part, 0), 6) AS score
         FROM lab CROSS JOIN cls LEFT JOIN part ON part.doc_id = lab.doc_id AND part.c = cls.c
         WHERE te),
  pred AS (SELECT doc_id, y, c AS pred, score FROM sc
           QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, c) = 1)"""


@query("nb_model", f"""{_BAYES}
SELECT c AS y, term, round(ll, 6) AS log_likelihood FROM ll""")
def nb_model(spark: SparkSession, sf: str) -> DataFrame:
    rows = bayes.term_table(bayes_model(spark, sf))
    return rows.select(F.col("label").alias("y"), "term",
                       F.round("ll", 6).alias("log_likelihood"))


@query("nb_predict", f"{_BAYES} SELECT doc_id, y, pred, score FROM pred")
def nb_predict(spark: SparkSession, sf: str) -> DataFrame:
    return bayes_predictions(spark, sf)


@query("nb_accuracy", f"""{_BAYES}
SELECT round(avg((y = pred)::INT), 6) AS accuracy, count(*) AS n FROM pred""")
def nb_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return bayes.accuracy(bayes_predictions(spark, sf), "y").withColumn(
        "accuracy", F.round("accuracy", 6))


@query("confusion", f"""{_BAYES},
  v AS (SELECT y AS v FROM pred UNION SELECT pred FROM pred),
  g AS (SELECT a.v AS y, b.v AS pred FROM v a CROSS JOIN v b),
  n AS (SELECT y, pred, count(*) AS n FROM pred GROUP BY ALL),
  m AS (SELECT y, pred, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (y, pred))
SELECT y, pred, n, round(CASE WHEN sum(n) OVER (PARTITION BY y) = 0 THEN 0e0
  ELSE n / CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) END, 6) AS share FROM m""")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return bayes.confusion(bayes_predictions(spark, sf), "y").withColumn(
        "share", F.round("share", 6))


@query("class_report", f"""{_BAYES},
  v AS (SELECT y AS c FROM pred UNION SELECT pred FROM pred),
  t AS (SELECT c, (SELECT count(*) FROM pred WHERE y = c) AS support,
          (SELECT count(*) FROM pred WHERE pred.pred = c) AS given,
          (SELECT count(*) FROM pred WHERE y = c AND pred.pred = c) AS tp FROM v),
  pr AS (SELECT c, support, CASE WHEN given = 0 THEN 0e0 ELSE tp / CAST(given AS DOUBLE) END AS p,
           CASE WHEN support = 0 THEN 0e0 ELSE tp / CAST(support AS DOUBLE) END AS r FROM t),
  f AS (SELECT CAST(c AS VARCHAR) AS class, support, p, r,
          CASE WHEN p + r = 0 THEN 0e0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr),
  a AS (SELECT class, support, p, r, f1 FROM f
        UNION ALL SELECT 'macro avg', sum(support), avg(p), avg(r), avg(f1) FROM f
        UNION ALL SELECT 'weighted avg', sum(support), sum(p * support) / sum(support),
          sum(r * support) / sum(support), sum(f1 * support) / sum(support) FROM f)
SELECT class, CAST(support AS BIGINT) AS support, round(p, 6) AS precision, round(r, 6) AS recall,
  round(f1, 6) AS f1 FROM a""")
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    report = bayes.class_report(bayes_predictions(spark, sf), "y")
    return report.select("class", "support",
                         *[F.round(c, 6).alias(c) for c in ["precision", "recall", "f1"]])


_COSINE = """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
  e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e))
  * sqrt(list_dot_product(q, q))), 6) AS cosine FROM e, q ORDER BY cosine {way}, vec_id LIMIT 20"""


def similar(spark: SparkSession, sf: str, least: bool) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = vectors.vector_of(rows, "vec_id", "embedding", 0)
    return vectors.ranked_by_cosine(rows, asked, "vec_id", "embedding", 20, least)


@query("vector_topk", _COSINE.format(way="DESC"))
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return similar(spark, sf, least=False)


@query("vector_bottomk", _COSINE.format(way="ASC"))
def vector_bottomk(spark: SparkSession, sf: str) -> DataFrame:
    return similar(spark, sf, least=True)
