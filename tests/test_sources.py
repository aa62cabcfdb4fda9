"""Files, feeds, pages and database options."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reviewloom import schemas
from reviewloom.runtime import scratch_path, shared_dir
from reviewloom.sources import database, feeds, files, pages


def test_shared_dir_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert scratch_path(spark, "x").startswith(named)


def test_token_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "ma")
    df = spark.createDataFrame(
        [("1", "5", [("좋", "VA")], "c", "n")],
        "app_id string, rating string, ma array<struct<lex:string,pos:string>>, "
        "category string, app_name string")
    files.write_jsonl(df, path)
    assert '"ma":[["좋","VA"]]' in spark.read.text(path).first()["value"]
    back = files.read_jsonl(spark, path).first()
    assert [tuple(t) for t in back["ma"]] == [("좋", "VA")] and back["rating"] == "5"
    assert files.read_jsonl(spark, path, only_ma=True).columns == ["app_id", "ma"]


def test_batch_names():
    names = files.batch_names("n_reviews", 250)
    assert names == ["n_reviews[1-100].txt", "n_reviews[101-200].txt", "n_reviews[201-250].txt"]
    assert files.batch_names("n_reviews", 200, 2) == ["n_reviews[101-200].txt"]


def test_tsv_keeps_odd_fields(spark, tmp_path):
    path = str(tmp_path / "tsv")
    rows = [("1", " lead", "back\\slash"), ("2", "q\"q\tt\nn", None)]
    df = spark.createDataFrame(rows, "app_id string, category string, app_name string")
    files.write_tsv(df, path, clean=True)
    got = files.read_tsv(spark, path, schemas.APP_DIMENSION).orderBy("app_id").collect()
    assert [tuple(r) for r in got] == [("1", " lead", "back\\slash"), ("2", "qqt n", None)]


def test_whole_json_document(spark, tmp_path):
    file = tmp_path / "keywords.json"
    file.write_text('{"1": ["a/N", "b/V"], "2": []}', encoding="utf-8")
    got = {r["key"]: r["words"] for r in files.read_json_documents(spark, str(file)).collect()}
    assert got == {"1": ["a/N", "b/V"], "2": []}


def test_broken_json_document_is_reported(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"1": ["a/N"]}', encoding="utf-8")
    (tmp_path / "cut.json").write_text('{"2": ["a/', encoding="utf-8")
    assert files.read_json_documents(spark, str(tmp_path)).count() == 1
    bad = files.bad_json_documents(spark, str(tmp_path)).collect()
    assert [r["file"].rsplit("/", 1)[1] for r in bad] == ["cut.json"]


def test_broken_page_has_no_fields(spark):
    rows = spark.createDataFrame([("u", "<![foo[x]]><p>a"), ("v", None)], "url string, html string")
    got = pages.app_pages(rows).collect()
    assert [r["title"] for r in got] == [None, None] and not any(r["complete"] for r in got)


def test_a_cluster_has_to_name_its_shared_folder(spark, monkeypatch):
    from reviewloom import runtime

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def test_jdbc_options():
    got = database.jdbc_options("jdbc:x", "reviews", ["app_id"], key="idx", bounds=(1, 9), parts=3)
    assert got["dbtable"] == "(select app_id from reviews) t"
    assert (got["partitionColumn"], got["numPartitions"]) == ("idx", "3")
    assert "dbtable" in database.jdbc_options("jdbc:x", "reviews")


FEED = """{"app_id":"7","feed":{"entry":[{"im:name":{"label":"App"},"category":{"attributes":\
{"label":"Games"}}},{"id":{"label":"11"},"title":{"label":"t\\tx"},"author":{"name":{"label":"me"},\
"uri":{"label":"u/id5"}},"im:rating":{"label":"5"},"content":{"label":"so\\n\\"good\\""}}]}}
{"app_id":"8","feed":{"entry":{"im:name":{"label":"Lonely"}}}}
{"app_id":"9","feed":{}}
"""


def test_json_feed_forms(spark, tmp_path):
    file = tmp_path / "feed.json"
    file.write_text(FEED, encoding="utf-8")
    landed = feeds.read_review_feed(spark, str(file))
    sizes = {r["app_id"]: r["n"] for r in landed.select(
        "app_id", F.size(feeds.feed_entries("entry")).alias("n")).collect()}
    assert sizes["7"] == 2 and sizes["8"] == 1
    row = feeds.flatten_reviews(landed).collect()
    assert len(row) == 1
    assert row[0]["category"] == "Games" and row[0]["title"] == "tx"
    assert row[0]["review"] == "so good" and row[0]["version"] is None
    assert len(feeds.flatten_reviews(landed, votes=True).collect()) == 1


XML = """<feed><title>Reviews</title><updated>2020-01-01T00:00:00Z</updated>
<entry><id>https://x/kr/app/id1?mt=8</id><title>App</title></entry>
<entry><id>https://x/kr/app/id2?mt=8</id><title>t</title><content>good &amp; bad</content>
<author><name>me</name></author><rating>4</rating><updated>2020-01-02T00:00:00Z</updated></entry>
</feed>"""


def test_xml_feed_file(spark, tmp_path):
    file = tmp_path / "feed.xml"
    file.write_text(XML, encoding="utf-8")
    landed = feeds.read_xml_feed(spark, str(file))
    row = feeds.flatten_xml_reviews(landed).collect()
    assert len(row) == 1
    assert row[0]["app_title"] == "App" and row[0]["content"] == "good & bad"
    assert row[0]["author"] == "me" and row[0]["updated"] == 1577923200
    ranks = feeds.flatten_ranks(landed).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in ranks] == [(1, "1"), (2, "2")]


def test_unknown_country_is_told_apart(spark):
    df = spark.createDataFrame([("Korea",), ("Narnia",)], "country string")
    got = {r["country"]: (r["code"], r["code_known"]) for r in
           feeds.with_codes(df, feeds.COUNTRIES, "country", "code").collect()}
    assert got == {"Korea": ("kr", True), "Narnia": (None, False)}


def test_app_page_that_lacks_nodes(spark):
    df = spark.createDataFrame(
        [("<h1>x</h1>", "u1"), ('<div id="title"><h1>T</h1></div>', "u2"), (None, "u3")],
        "html string, url string")
    got = {r["url"]: r for r in pages.app_pages(df).collect()}
    assert got["u1"]["title"] is None and got["u2"]["title"] == "T"
    assert not any(r["complete"] for r in got.values())
