"""Landed review and ranking feeds, flattened to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom import schemas
from reviewloom.functions import fields

# Country codes of the store by name.
COUNTRIES = {"China": "cn", "United States": "us", "Korea": "kr"}
# Ranking lists of the store by name.
RANK_LISTS = {
    "Top Free": "topfreeapplications",
    "Top Paid": "toppaidapplications",
    "Top Grossing": "topgrossingapplications",
    "Top Free iPad": "topfreeipadapplications",
    "Top Paid iPad": "toppaidipadapplications",
    "Top Grossing iPad": "topgrossingipadapplications",
    "Top Mac Apps": "topmacapps",
}
# Genre codes of the store by name; None stands for all genres.
GENRES = {
    "None": None, "Books": "6018", "Business": "6000", "Catalogs": "6022",
    "Education": "6017", "Entertainment": "6016", "Finance": "6015", "Food & Drink": "6023",
    "Games": "6014", "Health & Fitness": "6013", "Lifestyle": "6012", "Medical": "6020",
    "Music": "6011", "Navigation": "6010", "News": "6009", "Newsstand": "6021",
    "Photo & Video": "6008", "Productivity": "6007", "Reference": "6006",
    "Social Networking": "6005", "Sports": "6004", "Travel": "6003", "Utility": "6002",
    "Weather": "6001",
}
# Sort orders of the XML review feed by name.
SORT_ORDERS = {"Most Recent": "mostRecent", "Most Helpful": "mostHelpful"}


def lookup(spark: SparkSession, names: dict[str, str | None]) -> DataFrame:
    """A name table as (name, code); these are fixed lists of a few rows."""
    return F.broadcast(spark.createDataFrame(list(names.items()), "name string, code string"))


def with_codes(df: DataFrame, names: dict[str, str | None], col: str, code: str) -> DataFrame:
    """Add the code of a name; an unknown name gives NULL and `<code>_known` false."""
    table = lookup(df.sparkSession, names).select(
        F.col("name").alias(col), F.col("code").alias(code), F.lit(True).alias("_known"))
    return (df.join(table, col, "left")
            .withColumn(f"{code}_known", F.coalesce("_known", F.lit(False))).drop("_known"))


def read_review_feed(spark: SparkSession, path) -> DataFrame:
    """Landed JSON feeds, one page per line, with `entry` as JSON text."""
    return spark.read.schema(schemas.REVIEW_FEED).json(path).select(
        "app_id", F.col("feed.entry").alias("entry"))


def feed_entries(entry: Column | str) -> Column:
    """Entries of a page; a single object counts as a list of one."""
    entry = F.col(entry) if isinstance(entry, str) else entry
    listed = F.from_json(entry, schemas.FEED_ENTRIES)
    single = F.array(F.from_json(entry, schemas.FEED_ENTRY))
    return F.when(F.substring(F.ltrim(entry), 1, 1) == "[", listed).when(entry.isNotNull(), single)


def flatten_reviews(pages: DataFrame, votes: bool = False) -> DataFrame:
    """Reviews of the pages (app_id, entry), one row each, fields cleaned.

    Entry 0 names the app and its category. With `votes` every entry that
    names an app is passed over and the vote count stands for the category.
    """
    at = pages.select("app_id", feed_entries("entry").alias("entries"))
    app = F.get("entries", F.lit(0))
    rows = at.select(
        "app_id", app["im:name"]["label"].alias("app_name"),
        app["category"]["attributes"]["label"].alias("category"),
        F.posexplode("entries").alias("at", "e"))
    named = F.col("e")["im:name"].isNull()
    rows = rows.where(named if votes else F.col("at") > 0)
    e = F.col("e")
    last = e["im:voteCount"]["label"].alias("vote_count") if votes else F.col("category")
    flat = rows.select(
        "app_id", "app_name", e["id"]["label"].alias("review_id"),
        e["title"]["label"].alias("title"), e["author"]["name"]["label"].alias("author"),
        e["author"]["uri"]["label"].alias("author_url"), e["im:version"]["label"].alias("version"),
        e["im:rating"]["label"].alias("rating"), e["content"]["label"].alias("review"), last)
    return flat.select(*[fields.clean_field(c).alias(c) for c in flat.columns])


def parse_xml_feeds(lines: DataFrame, value: str = "value") -> DataFrame:
    """Landed XML feeds kept one per row, as columns."""
    return lines.select(F.from_xml(value, schemas.XML_FEED).alias("f")).select("f.*")


def read_xml_feed(spark: SparkSession, path) -> DataFrame:
    """Landed XML feeds, one document per file, one row per feed."""
    return (spark.read.format("xml").option("rowTag", "feed")
            .schema(schemas.XML_FEED).load(path))


def flatten_xml_reviews(feeds: DataFrame) -> DataFrame:
    """Reviews of XML feeds; entry 0 is the app, times become epoch seconds."""
    app = F.get("entry", F.lit(0))
    rows = feeds.select(app["title"].alias("app_title"), app["id"].alias("app_link"),
                        F.posexplode("entry").alias("at", "e")).where("at > 0")
    return rows.select("app_title", "app_link", "e.title", "e.content",
                       F.col("e.author.name").alias("author"), "e.rating",
                       F.unix_timestamp("e.updated").alias("updated"))


def flatten_ranks(feeds: DataFrame) -> DataFrame:
    """Entries of ranking feeds with rank from 1, id from the link, epoch seconds."""
    rows = feeds.select(F.col("title").alias("feed_title"), F.posexplode("entry").alias("at", "e"))
    return rows.select(
        "feed_title", (F.col("at") + 1).alias("rank"), fields.link_id("e.id").alias("id"),
        "e.title", F.col("e.id").alias("link"), F.unix_timestamp("e.updated").alias("timestamp"))
