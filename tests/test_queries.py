"""Every registered query against its checking SQL, or against its row rules."""

from __future__ import annotations

import math

import pytest
from conftest import SMALL

from reviewloom import plans

QUERIES, SQL = plans.all_queries(), plans.all_sql()


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in sorted(names)]
    want = sorted(tuple(shown(r[i]) for i in at) for r in cur.fetchall())
    assert cols == sorted(names)
    assert got == want


def rows(spark, name):
    return QUERIES[name](spark, SMALL).collect()


def n_docs(duck):
    return duck.execute("SELECT count(*) FROM documents").fetchall()[0][0]


def test_sample_is_one_document(spark):
    assert len(rows(spark, "sample_one")) == 1


def test_clusters(spark, duck):
    apps = duck.execute("SELECT count(DISTINCT source) FROM documents").fetchall()[0][0]
    found = rows(spark, "kmeans_docs")
    assert len(found) == apps
    report = rows(spark, "cluster_summary")
    assert sum(r["size"] for r in report) == apps
    assert all(len(r["words"].split()) == 10 for r in report)


def test_vector_models(spark, duck):
    n = duck.execute("SELECT count(*) FROM embeddings").fetchall()[0][0]
    clustered = rows(spark, "kmeans_vectors")
    assert len(clustered) == n and {r["cluster"] for r in clustered} <= set(range(10))
    assert len(rows(spark, "pca_2d")) == n
    tested = rows(spark, "logreg_vectors")
    assert 0 < len(tested) < n
    labels = {r[0] for r in duck.execute("SELECT DISTINCT label FROM embeddings").fetchall()}
    assert {r["pred"] for r in tested} <= labels


def test_topics(spark, duck):
    assert len(rows(spark, "topic_terms")) == 25
    assigned = rows(spark, "topic_assign")
    assert len(assigned) == n_docs(duck)
    assert all(0 <= r["topic_label"] < 5 and 0 <= r["topic_or_unknown"] <= 5 for r in assigned)
    assert all(r["flags"].count(",") == 5 for r in assigned)
    assert sum(r["n"] for r in rows(spark, "topic_sizes")) == n_docs(duck)
    assert sum(r["n"] for r in rows(spark, "topic_query_rate")) == n_docs(duck)


def test_embeddings(spark, duck):
    found = rows(spark, "doc_vectors")
    assert len(found) == n_docs(duck) and all(len(r["vector"]) == 100 for r in found)
    assert all(len(r["vector"]) == 105 for r in rows(spark, "stacked_vectors"))
    near = rows(spark, "doc_query_topk")
    assert len(near) == 20
    assert [r["cosine"] for r in near] == sorted((r["cosine"] for r in near), reverse=True)
    unknown = rows(spark, "unknown_word_neighbours")
    assert all(r["asked"] == r["meant"][:2] + r["meant"][3:] and r["asked"] != r["word"] for r in unknown)
    assert len({(r["asked"], r["meant"], r["rank"]) for r in unknown}) == len(unknown)
    sides = [r["side"] for r in rows(spark, "word_neighbours")]
    assert sides.count("near") == 10 and sides.count("far") == 10


def test_classifiers(spark, duck):
    tested = duck.execute(
        "SELECT count(*) FROM labels JOIN documents USING (doc_id) "
        "WHERE (doc_id * 2654435761) % 4294967296 % 100 < 25").fetchall()[0][0]
    svm = rows(spark, "svm_predict")
    assert len(svm) == tested and {r["pred"] for r in svm} <= {0, 1}
    grid = rows(spark, "cv_grid")
    assert len(grid) == 4 and sum(r["is_best"] for r in grid) == 1
    both = rows(spark, "model_compare")
    assert {r["model"] for r in both} == {"naive_bayes", "vectors_logistic"}
    assert all(0 <= r["accuracy"] <= 1 for r in both)


def test_forest_matches_kruskal(spark):
    from reviewloom.operators import cooc
    from reviewloom.plans.weighting import NEAREST_PAIRS, distances
    edges = cooc.sorted_pairs(distances(spark, SMALL)).limit(NEAREST_PAIRS).collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    want = set()
    for e in sorted(edges, key=lambda e: (e["distance"], e["term_i"], e["term_j"])):
        a, b = find(e["term_i"]), find(e["term_j"])
        if a != b:
            parent[a] = b
            want.add((e["term_i"], e["term_j"]))
    got = {(r["term_i"], r["term_j"]) for r in rows(spark, "mst_edges")}
    assert got == want


def test_properties_notice_shuffled_predictions(spark):
    """The property queries would be false for predictions that belong to other rows."""
    from pyspark.sql import functions as F

    from reviewloom.operators import clusters
    from reviewloom.plans import checks, models
    rows_ = models.vector_rows(spark, SMALL)
    model = clusters.fit_kmeans(rows_, 10, tries=2)
    shifted = model.transform(rows_).withColumn("cluster", (F.col("cluster") + 1) % 10)
    assert not any(r["nearest"] for r in checks.nearest_centers(
        shifted, model.clusterCenters()).collect())
    wrong = spark.createDataFrame([(1, 0), (1, 0), (0, 1)], "y int, pred int")
    assert not checks.beats_majority(wrong, "y").first()[0]


def test_whole_grid(spark):
    table = rows(spark, "grid_search")
    assert len(table) == 192 and sum(r["is_best"] for r in table) == 1
    best = max(r["accuracy"] for r in table)
    assert all(abs(r["accuracy"] - best) < 1e-9 for r in table if r["is_best"])
    folds = rows(spark, "grid_folds")
    assert len(folds) == 192 * len({r["fold"] for r in folds}) and all(0 <= r["accuracy"] <= 1 for r in folds)


def test_minibatches_and_languages(spark, duck):
    n = duck.execute("SELECT count(*) FROM embeddings").fetchall()[0][0]
    found = rows(spark, "kmeans_minibatch")
    assert len(found) == n and {r["cluster"] for r in found} <= set(range(10))
    named = rows(spark, "sgd_languages")
    assert sum(r["lang"] == r["pred"] for r in named) >= 0.9 * len(named) > 0


def test_paragraph_queries(spark, duck):
    tags = duck.execute("SELECT count(*) + count(DISTINCT source) FROM documents").fetchall()[0][0]
    found = rows(spark, "paragraph_vectors")
    assert len(found) == tags and all(len(r["vector"]) == 100 for r in found)
    assert 0.5 <= rows(spark, "inferred_share")[0]["share"] <= 1


def test_every_query_is_checked_here():
    by_rows = {"sample_one", "kmeans_docs", "cluster_summary", "kmeans_vectors", "pca_2d",
               "logreg_vectors", "topic_terms", "topic_assign", "topic_sizes",
               "topic_query_rate", "doc_vectors", "stacked_vectors", "doc_query_topk",
               "unknown_word_neighbours", "word_neighbours", "svm_predict", "cv_grid", "model_compare",
               "grid_search", "grid_folds",
               "kmeans_minibatch", "sgd_languages", "paragraph_vectors", "inferred_share"}
    assert set(QUERIES) == set(SQL) | by_rows
