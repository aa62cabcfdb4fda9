"""Fixed schemas of every stage; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Column names and order of the stored review table.
REVIEW_COLUMNS = [
    "app_id", "app_name", "review_id", "title", "author",
    "author_url", "version", "rating", "review", "category",
]
REVIEWS_RAW = _strings(*REVIEW_COLUMNS)
REVIEWS_RAW_VOTES = _strings(*REVIEW_COLUMNS[:-1], "vote_count")

DOCS_TSV = _strings("app_id", "review", "rating", "category", "app_name")
DOCS_JSONL = DOCS_TSV
APP_DIMENSION = _strings("app_id", "category", "app_name")

TOKEN = T.StructType([
    T.StructField("lex", T.StringType()),
    T.StructField("pos", T.StringType()),
])
TOKENS = T.ArrayType(TOKEN)

# Token pairs sit in JSON as two-element lists, so they are read as nested
# arrays and turned into structs afterwards.
RAW_TOKENS = T.ArrayType(T.ArrayType(T.StringType()))
DOCS_MA_JSONL = T.StructType([
    T.StructField("app_id", T.StringType()),
    T.StructField("rating", T.StringType()),
    T.StructField("ma", RAW_TOKENS),
    T.StructField("category", T.StringType()),
    T.StructField("app_name", T.StringType()),
])
DOCS_VOCAB_JSONL = T.StructType([
    T.StructField("app_id", T.StringType()),
    T.StructField("rating", T.StringType()),
    T.StructField("ma", T.ArrayType(T.StringType())),
    T.StructField("category", T.StringType()),
    T.StructField("app_name", T.StringType()),
])
DOCS_BY_APP_JSONL = T.StructType([
    T.StructField("app_id", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("rating", T.ArrayType(T.StringType())),
    T.StructField("ma", T.ArrayType(T.StringType())),
    T.StructField("category", T.StringType()),
    T.StructField("app_name", T.StringType()),
])

RULES = T.StructType([
    T.StructField("rule_no", T.IntegerType()),
    T.StructField("before", TOKENS),
    T.StructField("after", TOKENS),
])

_LABEL = T.StructType([T.StructField("label", T.StringType())])

# One entry of a review feed; entry 0 describes the app itself.
FEED_ENTRY = T.StructType([
    T.StructField("im:name", _LABEL),
    T.StructField("category", T.StructType([T.StructField("attributes", _LABEL)])),
    T.StructField("id", _LABEL),
    T.StructField("title", _LABEL),
    T.StructField("author", T.StructType([
        T.StructField("name", _LABEL),
        T.StructField("uri", _LABEL),
    ])),
    T.StructField("im:version", _LABEL),
    T.StructField("im:rating", _LABEL),
    T.StructField("content", _LABEL),
    T.StructField("im:voteCount", _LABEL),
])

FEED_ENTRIES = T.ArrayType(FEED_ENTRY)

# `entry` may be a list, one object or absent, so it is kept as JSON text.
REVIEW_FEED = T.StructType([
    T.StructField("app_id", T.StringType()),
    T.StructField("feed", T.StructType([T.StructField("entry", T.StringType())])),
])

XML_FEED = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("updated", T.TimestampType()),
    T.StructField("entry", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("author", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("rating", T.StringType()),
        T.StructField("updated", T.TimestampType()),
    ]))),
])
