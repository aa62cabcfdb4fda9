"""Expressions on hand-made cases."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewloom.functions import fields
from reviewloom.functions import text as T
from reviewloom.functions import tokens as K

TOKENS = "array<struct<lex:string,pos:string>>"


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


def of_tokens(spark, expr, tokens):
    df = spark.createDataFrame([(tokens,)], f"t {TOKENS}")
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("marks,text,want", [
    (T.SPACING_MARKS, "ㅠ개선좀해주세요ㅠㅠ", "ㅠ 개선좀해주세요 ㅠㅠ"),
    (T.SPACING_MARKS, "제발 이것좀 어떻게 해주세요ㅜㅜㅜㅜㅜ진짜 찾아갈꺼에요ㅜㅜㅜ",
     "제발 이것좀 어떻게 해주세요 ㅜㅜㅜㅜㅜ 진짜 찾아갈꺼에요 ㅜㅜㅜ"),
    ((), "ㅠ 개", "ㅠ  개"),
    ((), "", ""),
    ((), "굿!", "굿!"),
    (T.SPACING_MARKS, "굿!", "굿 !"),
])
def test_spacing(spark, marks, text, want):
    assert one(spark, T.spacing("t", marks), t=text) == want


@settings(max_examples=15, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab개ㅠㅋ!~ \n", max_size=20))
def test_spacing_only_adds_blanks(spark, text):
    spaced = one(spark, T.spacing("t", T.SPACING_MARKS), t=text)
    assert spaced.replace(" ", "") == text.replace(" ", "")


@settings(max_examples=15, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \t\n\x0b\x1c\x85\xa0 　", max_size=20))
def test_words_are_python_words(spark, text):
    assert one(spark, T.words("t"), t=text) == text.split()


def test_tags(spark):
    got = one(spark, T.tag_by_script("t"), t="앱 good 12! (漢字) -~…♥")
    assert [(t["lex"], t["pos"]) for t in got] == [
        ("앱", "NA"), ("good", "SL"), ("12", "SN"), ("!", "SF"), ("(", "SS"), ("漢字", "SH"),
        (")", "SS"), ("-", "SO"), ("~", "SO"), ("…", "SE"), ("♥", "SW")]


def test_strip_signs(spark):
    assert one(spark, T.strip_signs("t"), t="a, b  ! c") == "a b c"
    assert one(spark, T.strip_signs("t"), t="a  b") == "a  b"


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r["x"] for r in df.select(T.ngrams(F.col("w"), 2).alias("x")).collect()]
    assert got == [["a b", "b c"], [], []]


def test_token_chain(spark):
    doc = [("앱", "NNG"), ("가", "VV"), ("사 진", "NNG"), ("좋", "VA")]
    got = of_tokens(spark, K.filter_tokens("t", ["NNG", "VV"], 2), doc)
    assert [(t["lex"], t["pos"]) for t in got] == [("가다", "VV"), ("사진", "NNG")]


def test_token_chain_length_and_unknown(spark):
    doc = [("abc", "NNG"), ("ab", "NNG"), ("zzzz", "NA")]
    got = of_tokens(spark, K.filter_tokens("t", None, 3), doc)
    assert [(t["lex"], t["pos"]) for t in got] == [("abc", "NNG"), ("NULL", "NA")]


def test_deny_and_lemma(spark):
    doc = [("좋", "VA"), ("앱", "NNG"), ("!", "SF"), ("은", "JX")]
    assert of_tokens(spark, F.size(K.deny_tokens("t")), doc) == 3
    assert of_tokens(spark, K.lemma_tokens("t"), doc) == ["좋다", "앱"]
    assert of_tokens(spark, K.terms("t"), doc)[:2] == ["좋/VA", "앱/NNG"]


def test_pairs_round_trip(spark):
    df = spark.createDataFrame([([["a", "N"], ["b", "V"]],)], "p array<array<string>>")
    assert df.select(K.to_pairs(K.from_pairs("p")).alias("x")).first()["x"] == [
        ["a", "N"], ["b", "V"]]


def test_term_lex(spark):
    assert one(spark, K.term_lex("t"), t="a/b/NNG") == "a"


@pytest.mark.parametrize("doc,by_count,by_word", [
    ("구매 내역 삭제 부탁 드리다", True, True),
    ("구매 구매 내역 삭제 부탁", True, False),
    ("구매 구매 내역 삭제 부탁 드리다", False, True),
])
def test_query_hits(spark, doc, by_count, by_word):
    asked = "구매 내역 삭제 부탁 드리다".split()
    df = spark.createDataFrame([(doc.split(),)], "w array<string>")
    row = df.select(K.exact_hits("w", asked).alias("a"), K.contains_all("w", asked).alias("b"))
    assert tuple(row.first()) == (by_count, by_word)


def test_fields(spark):
    link = "https://x/kr/app/n/id503010737?mt=8"
    assert one(spark, fields.link_id("u"), u=link) == "503010737"
    assert one(spark, fields.link_id("u"), u="https://x/kr/app") is None
    assert one(spark, fields.author_id("u"), u="https://x/kr/reviews/id77") == "77"
    assert one(spark, fields.author_id("u"), u="https://x/kr/app") is None
    assert one(spark, fields.clean_field("t"), t="a\tb\"c\nd") == "abc d"
    assert one(spark, fields.clean_field("t"), t="\"") is None
    assert one(spark, fields.for_tsv("t"), t="") == "NaN"
    assert one(spark, fields.has_text("t"), t="None") is False


def test_binary_label(spark):
    got = [one(spark, fields.binary_label("r"), r=r) for r in ["1", "3", "5", "x"]]
    assert got == [0, None, 1, None]


def test_feed_urls(spark):
    url = fields.rank_feed_url(F.lit("kr"), F.lit("topfreeapplications"), F.lit("6008"), 100)
    assert one(spark, url) == (
        "https://itunes.apple.com/kr/rss/topfreeapplications/limit=100/genre=6008/json")
    none = fields.rank_feed_url(F.lit("kr"), F.lit("topmacapps"), F.lit(None).cast("string"))
    assert one(spark, none) == "https://itunes.apple.com/kr/rss/topmacapps/limit=300/json"


def test_rating_parts(spark):
    got = one(spark, fields.rating_parts("t"), t="4 stars, 120 Ratings")
    assert tuple(got) == ("4 stars", "120 Ratings")
