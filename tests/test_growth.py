"""Work that must not be repeated, or meet in one task, as tables grow."""

from __future__ import annotations

import time

import numpy as np
import pytest
from conftest import SMALL
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from reviewloom.functions import text as T
from reviewloom.operators import classify, clusters, features, paragraphs, rules, sgd, vocab
from reviewloom.plans import checks, corpus, models, weighting


def plain_walk(vector, words, matrix, cuts, rate, rng):
    """A pass that adds every push to the matrix on its own."""
    for at in range(0, len(words), paragraphs.STEP_WORDS):
        real = words[at:at + paragraphs.STEP_WORDS]
        drawn = np.searchsorted(cuts, rng.random((len(real), paragraphs.DRAWN)))
        live = np.concatenate([np.ones((len(real), 1), bool), drawn != real[:, None]], 1).ravel()
        both = np.concatenate([real[:, None], drawn], 1).ravel()[live]
        wanted = np.tile(np.arange(paragraphs.DRAWN + 1) == 0, len(real))[live]
        rows = matrix[both]
        push = rate * (wanted - 1 / (1 + np.exp(-np.clip(rows @ vector, -30, 30))))
        np.add.at(matrix, both, push[:, None] * vector)
        vector += push @ rows


def test_a_long_walk_equals_the_plain_one_in_less_time():
    rng = np.random.default_rng(1)
    chance = 1 / np.arange(1, 5001)
    cuts, words = np.cumsum(chance) / chance.sum(), rng.integers(0, 5000, 2 * paragraphs.DRAW_WORDS + 50)
    start, vector = rng.normal(size=(5000, 100)), rng.normal(size=100) / 100
    results, times = [], []
    for fn in (plain_walk, lambda *a: paragraphs.walk(*a, True)) * 3:
        m, v, begin = start.copy(), vector.copy(), time.perf_counter()
        fn(v, words, m, cuts, 0.05, np.random.default_rng(9))
        times.append(time.perf_counter() - begin)
        results.append((v, m))
    assert np.allclose(results[0][0], results[1][0]) and np.allclose(results[0][1], results[1][1])
    assert min(times[1::2]) < 0.8 * min(times[::2])


def test_partitions_of_paragraphs_follow_the_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"w{i % 7}"] * 10, [f"t{i}"]) for i in range(30)],
                                 "doc_id long, tokens array<string>, tags array<string>")
    parts = []
    monkeypatch.setattr(paragraphs, "PART_WORDS", 25)
    own = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *by: parts.append(n) or own(self, n, *by))
    paragraphs.fit_paragraphs(docs, size=4, min_count=1, epochs=1)
    assert max(parts) == 12
    parts.clear()
    paragraphs.fit_paragraphs(docs, size=4, min_count=1, epochs=1, parts=3)
    assert max(parts) == 3


def counting(spark):
    """A counter and a way to count the rows that pass a column."""
    seen = spark.sparkContext.accumulator(0)

    def count(words):
        seen.add(1)
        return words
    return seen, F.udf(count, "array<string>").asNondeterministic()


def test_apps_are_tokenised_once(spark, duck, monkeypatch):
    seen, count = counting(spark)
    own = vocab.token_rows
    monkeypatch.setattr(vocab, "token_rows", lambda docs, *keep, **more: own(
        docs, *keep, tokenizer=lambda text: count(T.words(text)), **more))
    rows, words = models.app_vectors(spark, SMALL)
    assert rows.count() and words.count()
    assert seen.value == duck.execute("SELECT count(*) FROM documents").fetchall()[0][0]


def test_kmeans_properties_move_all_runs_together(spark, monkeypatch):
    monkeypatch.setattr(clusters, "fit_kmeans", lambda *a, **k: pytest.fail("a fit for every run"))
    rows = checks.kmeans_properties(spark, SMALL).collect()
    assert rows and all(r["nearest"] and r["better_than_one"] for r in rows)


def test_cross_validation_fits_a_vocabulary_once_a_fold(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame(
        [(i, i % 4 // 2, float(i % 2), [f"w{j}" for j in rng.integers(0, 8, 6)] + [f"c{i % 2}"] * int(rng.integers(0, 2)))
         for i in range(60)], "doc_id long, fold int, label double, tokens array<string>")
    pipeline = classify.bayes_pipeline()
    grid = classify.bayes_grid(pipeline, [1.0, 2.0], [True, False], norm=["l1", None])
    want = classify.grid_search(pipeline, grid, docs, folds=2, fold_col="fold").avgMetrics
    fits, own = [], features.TfIdf._fit
    monkeypatch.setattr(features.TfIdf, "_fit", lambda self, df: fits.append(1) or own(self, df))
    assert classify.fold_scores(pipeline, grid, docs, 2, "fold") == pytest.approx(want)
    assert len(fits) == 2


def test_linear_machines_keep_the_partitions_of_many_rows(spark, monkeypatch):
    rows = spark.range(64, numPartitions=16).select(
        F.concat(F.lit("c"), F.col("id") % 2).alias("label"),
        array_to_vector(F.array((F.col("id") % 2).cast("double"), F.lit(1.0))).alias("features"))
    joined, own = [], type(rows).coalesce
    monkeypatch.setattr(type(rows), "coalesce", lambda self, n: joined.append(n) or own(self, n))
    sgd.fit_hinge(rows, "features", "label", 2, epochs=2)
    assert joined == [8]
    joined.clear()
    monkeypatch.setattr(sgd, "FEW_ROWS", 63)
    model = sgd.fit_hinge(rows, "features", "label", 2, epochs=20)[0]
    assert joined == [] and model.labels == ["c0", "c1"]


def test_rules_are_written_and_numbered_by_part(spark, tmp_path):
    made = spark.range(40, numPartitions=5).select(
        F.array(T.token(F.format_string("a%02d", "id"), F.lit("NNG"))).alias("before"),
        F.array(T.token(F.lit("b"), F.lit("NNG"))).alias("after"))
    path = str(tmp_path / "rules")
    rules.write_rules(made, path)
    assert len(list((tmp_path / "rules").glob("part-*"))) == 5
    rules.write_rules(made.limit(3), path)
    got = rules.read_rules(spark, path).orderBy("rule_no").collect()
    assert [r["rule_no"] for r in got] == list(range(1, 44))
    words = [r["before"][0]["lex"] for r in got]
    # The parts of one writing follow each other, in whatever order the writings are.
    whole, few = [f"a{i:02d}" for i in range(40)], ["a00", "a01", "a02"]
    assert words in (whole + few, few + whole)


def test_rated_terms_are_counted_without_a_shuffle_of_terms(spark, tmp_path):
    # As many files as make a table of its own partitions.
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(16).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        _, tf = weighting.rated_tf(spark, str(tmp_path))
        plan = tf._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert not any("term" in line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning" in line)


def test_bigrams_are_joined_in_compiled_code(spark):
    texts = [(1, "a b a b"), (2, "b  a"), (3, "a"), (4, ""), (5, None), (5, " a\tb\u00a0c ")]
    pairs = corpus.pair_counts(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {tuple(r) for r in pairs.collect()} == {("a b", 3), ("b a", 2), ("b c", 1)}
    assert "lambda" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_reached_documents_are_not_made_again_to_be_compared(spark):
    """Spark compared the digests below the rules, with the tagging in place of every use of the tokens."""
    plan = corpus.rules_reached(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
