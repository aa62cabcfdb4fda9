"""The jobs from review file to result on a small set of reviews."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewloom import schemas
from reviewloom.functions import text as T
from reviewloom.operators import bayes
from reviewloom.operators.grid import Axes
from reviewloom.plans import jobs
from reviewloom.sources import files

GOOD, BAD = "정말 good app nice 굿ㅋㅋ", "bad app slow crash 업뎃좀"
RULES = [([("업뎃", "NA")], [("업데이트", "NNG")])]


@pytest.fixture(scope="module")
def tagged(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("jobs")
    lines = []
    for i in range(80):
        good = i % 2 == 0
        lines.append({"app_id": str(i // 8), "review": GOOD if good else BAD,
                      "rating": "5" if good else "1", "category": "c" + str(i // 40),
                      "app_name": f"app{i // 8}"})
    (base / "raw.json").write_text(
        "\n".join(json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")
    jobs.respace(spark, str(base / "raw.json"), str(base / "spaced"))
    jobs.tokenize(spark, str(base / "spaced"), str(base / "ma"))
    jobs.rewrite(spark, str(base / "ma"), str(base / "rules"), RULES)
    return base


def test_preparation(spark, tagged):
    docs = files.read_jsonl(spark, str(tagged / "rules")).collect()
    assert len(docs) == 80
    bad = next(d for d in docs if d["rating"] == "1")
    assert ("업데이트", "NNG") in [tuple(t) for t in bad["ma"]]
    good = next(d for d in docs if d["rating"] == "5")
    assert "ㅋㅋ" in [t["lex"] for t in good["ma"]]


def test_keywords_and_clusters(spark, tagged):
    by_app = str(tagged / "by_app")
    words = jobs.select_terms(spark, str(tagged / "rules"), by_app, ["SL", "NNG"], by_app=True)
    assert {r["term"] for r in words.collect()} == {
        "good/SL", "app/SL", "nice/SL", "bad/SL", "slow/SL", "crash/SL", "업데이트/NNG"}
    best = jobs.app_keywords(spark, by_app, str(tagged / "keywords"), 3)
    assert best.count() == 30
    stored = files.read_keywords(spark, str(tagged / "keywords")).collect()
    assert len(stored) == 10 and all(len(r["words"]) == 3 for r in stored)
    report, table = jobs.app_clusters(spark, by_app, k=2, n=3, max_features=7, tries=1)
    assert sum(r["size"] for r in report.collect()) == 10
    assert table.count() == 2


def test_contrast_network_and_classifier(spark, tagged):
    each = str(tagged / "each")
    jobs.select_terms(spark, str(tagged / "rules"), each, ["SL", "NNG"])
    only, both = jobs.rating_contrast(spark, each, 10)
    assert {r["term_good"] for r in only.collect()} - {None} == {"good/SL", "nice/SL"}
    assert both.count() == 5
    forest = jobs.word_network(spark, each, str(tagged / "pairs"), 50, 7)
    assert 0 < forest.count() < 7
    pred = jobs.rating_classifier(spark, each)
    assert pred.count() > 0
    assert bayes.accuracy(pred, "rating").first()["accuracy"] == 1.0


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """Three files of 200 lines, read in several partitions, with one broken line."""
    base = tmp_path_factory.mktemp("many")
    for f in range(3):
        lines = [json.dumps({"app_id": str(i % 4), "rating": "5" if i % 2 else "1",
                             "ma": [f"w{i % 7}/N", "good/A" if i % 2 else "bad/A"],
                             "category": "b" if i < 100 else "a", "app_name": "x"})
                 for i in range(200)]
        if f == 1:
            lines[50] = '{"app_id": "1", "rating'
        (base / f"part{f}.json").write_text("\n".join(lines), encoding="utf-8")
    return str(base)


@pytest.fixture()
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_jobs_on_several_files(spark, many_files, small_splits):
    """Ids start at 2^33 in the second partition; no product of them overflows."""
    assert files.read_jsonl_terms(spark, many_files).count() == 599
    bad = files.bad_lines(spark, many_files, schemas.DOCS_VOCAB_JSONL).collect()
    assert len(bad) == 1 and bad[0]["file"].endswith("part1.json")
    pred = jobs.rating_classifier(spark, many_files)
    assert 0 < pred.count() < 599
    assert bayes.accuracy(pred, "rating").first()["accuracy"] == 1.0


def test_parts_keep_their_order(spark, many_files, small_splits, tmp_path):
    raw = files.read_jsonl_terms(spark, many_files)
    pairs = raw.withColumn("ma", F.transform("ma", lambda t: F.split(t, "/")))
    files.write_jsonl(pairs, str(tmp_path / "ma"))
    jobs.select_terms(spark, str(tmp_path / "ma"), str(tmp_path / "apps"), None, by_app=True)
    parts = files.read_jsonl_terms(spark, str(tmp_path / "apps"), by_app=True).collect()
    assert len({(r["app_id"], r["part"]) for r in parts}) == len(parts) > 4
    assert sum(len(r["rating"]) for r in parts) == 599


def test_model_jobs_on_several_files(spark, many_files, tmp_path):
    svm = jobs.svm_classifier(spark, many_files).collect()
    assert svm and all(r["rating"] == r["pred"] for r in svm)
    grid = jobs.rating_grid(spark, many_files, 2, [1.0], [True], norm=["l2", None]).collect()
    assert len(grid) == 2 and all(r["accuracy"] == 1.0 for r in grid)
    axes = Axes(max_features=(50,), ngrams=(1,), idf=("smooth",), norm=("l2", None), sublinear=(True,), alpha=(1.0,))
    best = jobs.rating_search(spark, many_files, axes, 2).collect()
    assert len(best) == 2 and all(r["accuracy"] == 1.0 for r in best) and sum(r["is_best"] for r in best) == 1
    words, flat = jobs.review_topics(spark, many_files, str(tmp_path / "topics"), 3, 0.4, 2)
    assert words.count() == 6 and 0 < flat.count() <= 599
    assert spark.read.json(str(tmp_path / "topics")).count() == 599
    near = jobs.similar_reviews(spark, many_files, ["good/A"], 7, size=8, epochs=1)
    assert near.count() == 7
    both = jobs.compare_models(spark, many_files, 100, size=8, epochs=1).collect()
    assert {r["model"] for r in both} == {"naive_bayes", "vectors_logistic"}
    assert all(r["n"] == both[0]["n"] for r in both)


def test_unknown_report(spark, tagged):
    words, totals = jobs.unknown_report(spark, str(tagged / "ma"))
    found = {r["lex"]: (r["n"], r["docs"]) for r in words.collect()}
    assert found["업뎃좀"] == (40, 40)
    assert totals.first()["total_unknown"] == sum(n for n, _ in found.values())


def test_null_ratings_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "d int, y string")
    tf = spark.createDataFrame([(1, "a", "x", 1), (2, None, "x", 1), (3, "b", "y", 1)],
                               "d int, y string, term string, n long")
    assert bayes.fit(tf, docs, "d", "y").labels == ["a", "b"]


def test_tokenizer_can_be_replaced(spark, tagged):
    @F.pandas_udf("array<struct<lex:string,pos:string>>")
    def upper(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"lex": w.upper(), "pos": "W"} for w in t.split()])
    jobs.tokenize(spark, str(tagged / "raw.json"), str(tagged / "upper"), upper)
    first = files.read_jsonl(spark, str(tagged / "upper")).first()["ma"][0]
    assert first["pos"] == "W" and T.UNKNOWN_TAGS == ["NA", "UNKNOWN"]
