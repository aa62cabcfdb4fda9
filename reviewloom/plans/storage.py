"""Sources and sinks: whole tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from reviewloom import schemas
from reviewloom.functions import fields
from reviewloom.functions import text as T
from reviewloom.functions import tokens as K
from reviewloom.operators import ordering, tables, vocab
from reviewloom.plans.registry import SPACE, TOKEN, documents, query, table
from reviewloom.runtime import by_document, scratch_path
from reviewloom.sources import feeds, files, pages

# Reviews on one landed feed page at most (ids of a span of 256 per app).
PAGE_SPAN = 256


def review_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the shape of stored reviews, all strings."""
    docs = documents(spark, sf, "source", "lang", "text", "n_chars")
    return docs.select(
        fields.after_prefix("source", 3).alias("app_id"), F.col("text").alias("review"),
        F.col("doc_id").cast("string").alias("rating"), F.col("lang").alias("category"),
        F.col("source").alias("app_name"))


@query("sink_jsonl", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, substring(source, 4) AS app_id, source AS app_name,
  lang AS category, md5(text) AS digest FROM documents""")
def sink_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "reviews")
    files.write_jsonl(review_docs(spark, sf), path)
    back = files.read_jsonl(spark, path, key_ma=False)
    return back.select(F.col("rating").alias("doc_id"), "app_id", "app_name", "category",
                       F.md5("review").alias("digest"))


@query("src_jsonl", f"""
WITH t AS (SELECT doc_id, source, regexp_extract_all(text, '{TOKEN}') AS l FROM documents)
SELECT substring(source, 4) AS app_id, count(*) AS docs, CAST(sum(len(l)) AS BIGINT) AS tokens,
  min(md5(array_to_string(l, ' '))) AS least FROM t GROUP BY 1""")
def src_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    docs = review_docs(spark, sf).withColumn("ma", T.tag_unknown("review")).drop("review")
    files.write_jsonl(docs, path, only_ma=True)
    back = files.read_jsonl(spark, path, only_ma=True)
    lex = F.array_join(K.lex_only("ma"), " ")
    return back.groupBy("app_id").agg(
        F.count("*").alias("docs"), F.sum(F.size("ma").cast("bigint")).alias("tokens"),
        F.min(F.md5(lex)).alias("least"))


_TOP = f"""
WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^{SPACE}]+')) AS w FROM documents),
  c AS (SELECT doc_id, w, count(*) AS n FROM l GROUP BY ALL),
  r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM c)
SELECT CAST(doc_id AS VARCHAR) AS key, string_agg(w, ' ' ORDER BY r) AS words FROM r
WHERE r <= 3 GROUP BY doc_id"""


def top_words(spark: SparkSession, sf: str) -> DataFrame:
    """The three most frequent words of every document, (key, words)."""
    docs = by_document(documents(spark, sf, "text"))
    rows = ordering.top_n(vocab.bag_of_words(docs), "doc_id",
                         [F.col("n").desc(), F.col("term")], 3)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return rows.groupBy(F.col("doc_id").cast("string").alias("key")).agg(
        F.transform(ordered, lambda x: x.term).alias("words"))


@query("sink_keyword_json", _TOP)
def sink_keyword_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "keywords")
    files.write_json_documents(top_words(spark, sf), path, "key", "words")
    return files.read_keywords(spark, path).select(
        "key", F.array_join("words", " ").alias("words"))


@query("src_json_doc", _TOP)
def src_json_doc(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document per 4096 neighbouring keys."""
    path = scratch_path(spark, "documents")
    rows = top_words(spark, sf).withColumn(
        "part", F.floor(F.col("key").cast("long") / 4096))
    entry = F.map_from_entries(F.collect_list(F.struct("key", "words")))
    whole = rows.groupBy("part").agg(F.to_json(entry).alias("value"))
    # One file per part, as the reader takes a file for one document.
    whole.write.partitionBy("part").text(path)
    back = files.read_json_documents(spark, path)
    return back.select("key", F.array_join("words", " ").alias("words"))


def raw_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the ten columns of a scraped file."""
    docs = documents(spark, sf, "source", "lang", "text", "n_chars")
    missing = F.lit(None).cast("string")
    return docs.select(
        fields.after_prefix("source", 3).alias("app_id"), F.col("source").alias("app_name"),
        F.col("doc_id").cast("string").alias("review_id"), missing.alias("title"),
        F.concat(F.lit("user"), F.col("doc_id").cast("string")).alias("author"),
        F.concat(F.lit("https://x/id"), F.col("doc_id").cast("string")).alias("author_url"),
        F.lit("1.0").alias("version"), F.col("n_chars").cast("string").alias("rating"),
        F.col("text").alias("review"), F.col("lang").alias("category"))


_CLEAN = "replace(replace(replace(text, chr(9), ''), '\"', ''), chr(10), ' ')"


@query("src_tsv", f"""
SELECT CAST(doc_id AS VARCHAR) AS review_id, substring(source, 4) AS app_id, lang AS category,
  CAST(doc_id AS VARCHAR) AS author_id, CAST(NULL AS VARCHAR) AS title,
  md5(nullif({_CLEAN}, '')) AS digest FROM documents""")
def src_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of scraped files, named by index range and read together."""
    raw = raw_reviews(spark, sf)
    base = scratch_path(spark, "batches")
    names = files.batch_names("n_reviews", 2 * files.BATCH_SIZE)
    odd = F.col("review_id").cast("long") % 2 == 1
    for name, part in zip(names, [~odd, odd]):
        files.write_tsv(raw.where(part), f"{base}/{name}", clean=True)
    back = files.read_tsv(spark, [f"{base}/{files.literal(name)}" for name in names])
    return back.select("review_id", "app_id", "category",
                       fields.author_id("author_url").alias("author_id"), "title",
                       F.md5("review").alias("digest"))


@query("sink_tsv", """
SELECT source AS app_id, min_by(lang, doc_id) AS category, source AS app_name FROM documents
GROUP BY source""")
def sink_tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "apps")
    first = tables.first_per_app(table(spark, sf, "documents"), "source", "doc_id", "lang")
    files.write_tsv(first.select(F.col("source").alias("app_id"), F.col("lang").alias("category"),
                                 F.col("source").alias("app_name")), path)
    return files.read_tsv(spark, path, schemas.APP_DIMENSION)


@query("src_text_list", r"""
SELECT regexp_extract(url, '/([0-9]+)', 1) AS value, count(*) AS n FROM pages GROUP BY 1""")
def src_text_list(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    found = F.regexp_extract("url", "/([0-9]+)", 1)
    files.write_lines(table(spark, sf, "pages"), path, F.concat(F.lit(" "), found, F.lit(" ")))
    return tables.group_counts(files.read_lines(spark, path), "value")


@query("line_count", """
SELECT CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines
FROM (SELECT replace(text, chr(13), ' ') AS text FROM benchmark)""")
def line_count(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    files.write_lines(table(spark, sf, "benchmark"), path, F.translate("text", "\r", " "))
    return files.line_count(spark, path)


@query("sink_text", f"""
SELECT md5(array_to_string(regexp_extract_all(text, '{TOKEN}'), ' ')) AS digest FROM documents""")
def sink_text(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "lex")
    docs = documents(spark, sf, "text")
    files.write_lines(docs, path, files.token_line(K.lex_only(T.tag_unknown("text"))))
    return spark.read.text(path).select(F.md5("value").alias("digest"))


@query("sink_csv_parts", "SELECT page_id, url, md5(html) AS digest FROM pages")
def sink_csv_parts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "links")
    rows = table(spark, sf, "pages").select("page_id", "url", "html")
    files.write_csv_parts(rows, path, 8)
    return files.read_csv_parts(spark, path, rows.schema).select(
        "page_id", "url", F.md5("html").alias("digest"))


@query("sink_table", "SELECT doc_id, lang, source FROM documents")
def sink_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table of fixed schema, created, filled and read by name."""
    path = scratch_path(spark, "table")
    name = "reviews_" + path.split("scratch-")[-1].split("/")[0]
    schema = ST.StructType([ST.StructField("doc_id", ST.LongType()),
                            ST.StructField("lang", ST.StringType()),
                            ST.StructField("source", ST.StringType())])
    files.save_table(table(spark, sf, "documents"), name, path, schema)
    return spark.table(name)


def _label(c: Column) -> Column:
    return F.struct(c.cast("string").alias("label"))


def feed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """JSON feed pages of every app made from documents, (app_id, feed)."""
    docs = documents(spark, sf, "source", "lang", "text", "n_chars")
    review = F.struct(
        _label(F.col("doc_id")).alias("id"), _label(F.col("lang")).alias("title"),
        F.struct(_label(F.concat(F.lit("user"), F.col("doc_id").cast("string"))).alias("name"))
        .alias("author"),
        _label(F.lit("1.0")).alias("im:version"), _label(F.col("n_chars")).alias("im:rating"),
        _label(F.col("text")).alias("content"), _label(F.col("doc_id") % 7).alias("im:voteCount"))
    grouped = docs.groupBy("source", tables.part_of("doc_id", PAGE_SPAN).alias("page")).agg(
        F.collect_list(F.to_json(review)).alias("reviews"), F.min_by("lang", "doc_id").alias("cat"))
    app = F.to_json(F.struct(
        _label(F.col("source")).alias("im:name"),
        F.struct(_label(F.col("cat")).alias("attributes")).alias("category")))
    entry = F.concat(F.lit("["), F.array_join(F.concat(F.array(app), F.col("reviews")), ","),
                     F.lit("]"))
    line = F.concat(F.lit('{"app_id":"'), fields.after_prefix("source", 3),
                    F.lit('","feed":{"entry":'), entry, F.lit("}}"))
    return grouped.select(line.alias("value"))


_FEED = f"""
SELECT substring(source, 4) AS app_id, source AS app_name, CAST(doc_id AS VARCHAR) AS review_id,
  lang AS title, 'user' || doc_id AS author, CAST(NULL AS VARCHAR) AS author_url,
  '1.0' AS version, CAST(n_chars AS VARCHAR) AS rating, md5(nullif({_CLEAN}, '')) AS digest, %s
FROM documents"""
_PAGE_CATEGORY = "min_by(lang, doc_id) OVER (PARTITION BY source, doc_id // 256) AS category"


def landed_feed(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "feed")
    files.write_lines(feed_pages(spark, sf), path, "value")
    return feeds.read_review_feed(spark, path)


def _digested(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", F.md5("review")).drop("review")


@query("feed_json_flatten", _FEED % _PAGE_CATEGORY)
def feed_json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return _digested(feeds.flatten_reviews(landed_feed(spark, sf)))


@query("feed_json_votes", _FEED % "CAST(doc_id % 7 AS VARCHAR) AS vote_count")
def feed_json_votes(spark: SparkSession, sf: str) -> DataFrame:
    return _digested(feeds.flatten_reviews(landed_feed(spark, sf), votes=True))


def _xml_text(c: Column) -> Column:
    """Text as XML content: characters XML forbids become blanks, marks are escaped."""
    safe = F.regexp_replace(c, r"[^\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", " ")
    safe = F.replace(safe, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(safe, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _tag(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))


def _xml_time(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c + F.lit(1_700_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def xml_feeds(spark: SparkSession, sf: str, first: bool) -> DataFrame:
    """XML feeds of every app made from documents, with the app as entry 0 if `first`."""
    docs = documents(spark, sf, "source", "lang", "text", "n_chars")
    link = F.concat(F.lit("https://x/kr/app/id"), F.col("doc_id").cast("string"), F.lit("?mt=8"))
    entry = _tag("entry", F.concat(
        _tag("id", link), _tag("title", F.col("lang")), _tag("content", _xml_text(F.col("text"))),
        _tag("author", _tag("name", F.concat(F.lit("user"), F.col("doc_id").cast("string")))),
        _tag("rating", F.col("n_chars").cast("string")),
        _tag("updated", _xml_time(F.col("doc_id")))))
    ordered = F.sort_array(F.collect_list(F.struct("doc_id", entry.alias("e"))))
    grouped = docs.groupBy("source", tables.part_of("doc_id", PAGE_SPAN).alias("page")).agg(
        F.array_join(F.transform(ordered, lambda x: x.e), "").alias("entries"))
    app = _tag("entry", F.concat(_tag("id", F.concat(F.lit("https://x/"), F.col("source"))),
                                 _tag("title", F.col("source"))))
    head = F.concat(_tag("title", F.concat(F.col("source"), F.lit(" "), F.col("page"))),
                    _tag("updated", _xml_time(F.col("page"))))
    body = F.concat(head, app, F.col("entries")) if first else F.concat(head, F.col("entries"))
    return grouped.select(_tag("feed", body).alias("value"))


def landed_xml(spark: SparkSession, sf: str, first: bool) -> DataFrame:
    path = scratch_path(spark, "xml")
    files.write_lines(xml_feeds(spark, sf, first), path, "value")
    return feeds.parse_xml_feeds(spark.read.text(path))


@query("feed_xml_flatten", r"""
SELECT source AS app_title, 'https://x/' || source AS app_link, lang AS title,
  'user' || doc_id AS author, CAST(n_chars AS VARCHAR) AS rating,
  doc_id + 1700000000 AS updated,
  md5(trim(regexp_replace(text, '[\s\x{0}-\x{1F}]+', ' ', 'g'))) AS digest FROM documents""")
def feed_xml_flatten(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.flatten_xml_reviews(landed_xml(spark, sf, first=True))
    flat = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"[\s\x{0}-\x{1F}]+", " "))
    return rows.withColumn("digest", F.md5(flat)).drop("content")


@query("rank_feed", """
SELECT source || ' ' || doc_id // 256 AS feed_title,
  row_number() OVER (PARTITION BY source, doc_id // 256 ORDER BY doc_id) AS rank,
  CAST(doc_id AS VARCHAR) AS id, lang AS title,
  'https://x/kr/app/id' || doc_id || '?mt=8' AS link, doc_id + 1700000000 AS timestamp
FROM documents""")
def rank_feed(spark: SparkSession, sf: str) -> DataFrame:
    ranks = feeds.flatten_ranks(landed_xml(spark, sf, first=False))
    return ranks.withColumn("rank", F.col("rank").cast("bigint"))


@query("feed_urls", """
WITH c AS (SELECT DISTINCT n_name AS country FROM customer
    JOIN nation ON c_nationkey = n_nationkey),
  l AS (SELECT unnest(['topfreeapplications', 'toppaidapplications', 'topgrossingapplications',
    'topfreeipadapplications', 'toppaidipadapplications', 'topgrossingipadapplications',
    'topmacapps']) AS list),
  g AS (SELECT unnest([NULL, '6018', '6000', '6022', '6017', '6016', '6015', '6023', '6014',
    '6013', '6012', '6020', '6011', '6010', '6009', '6021', '6008', '6007', '6006', '6005',
    '6004', '6003', '6002', '6001']) AS genre)
SELECT country, CASE country WHEN 'CHINA' THEN 'cn'
    WHEN 'UNITED STATES' THEN 'us' END AS code,
  country IN ('CHINA', 'UNITED STATES') AS code_known,
  CASE WHEN country IN ('CHINA', 'UNITED STATES') THEN
    'https://itunes.apple.com/' || CASE country WHEN 'CHINA' THEN 'cn' ELSE 'us' END || '/rss/'
    || list || '/limit=100' || coalesce('/genre=' || genre, '') || '/json' END AS url
FROM c, l, g""")
def feed_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking feeds of every country with customers; unknown countries have no address."""
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    countries = customers.distinct().join(nations, "n_nationkey").select("country").distinct()
    names = {name.upper(): code for name, code in feeds.COUNTRIES.items()}
    coded = feeds.with_codes(countries, names, "country", "code")
    lists = F.array(*[F.lit(v) for v in feeds.RANK_LISTS.values()])
    genres = F.array(*[F.lit(v) for v in feeds.GENRES.values()])
    every = (coded.withColumn("list", F.explode(lists)).withColumn("genre", F.explode(genres)))
    url = fields.rank_feed_url(F.col("code"), F.col("list"), F.col("genre"), 100)
    return every.select("country", "code", "code_known",
                        F.when(F.col("code_known"), url).alias("url"))


@query("review_feed_urls", """
WITH a AS (SELECT DISTINCT lang, substring(source, 4) AS app_id FROM documents),
  p AS (SELECT unnest(range(1, 11)) AS page)
SELECT app_id, 'https://itunes.apple.com/' || lang || '/rss/customerreviews/id=' || app_id
  || '/page=' || page || '/sortby=mostrecent/json' AS url FROM a, p
UNION ALL SELECT app_id, 'https://itunes.apple.com/' || lang || '/rss/customerreviews/id='
  || app_id || '/sortBy=mostRecent/xml' FROM a""")
def review_feed_urls(spark: SparkSession, sf: str) -> DataFrame:
    apps = table(spark, sf, "documents").select(
        "lang", fields.after_prefix("source", 3).alias("app_id")).distinct()
    each = apps.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(10))))
    lang, app = F.col("lang"), F.col("app_id")
    json = each.select("app_id", fields.review_feed_url(lang, app, F.col("page")).alias("url"))
    order = F.lit(feeds.SORT_ORDERS["Most Recent"])
    return json.unionByName(
        apps.select("app_id", fields.review_xml_url(lang, app, order).alias("url")))


@query("app_pages", """
SELECT source AS title, 'maker ' || lang AS developer, '$' || doc_id % 10 AS price,
  lang AS category, n_chars || ' MB' AS size, 'seller ' || source AS seller,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 5 || ' stars' END AS stars,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars || ' Ratings' END AS rating,
  'https://x/id' || doc_id AS url, doc_id % 5 <> 0 AS complete FROM documents""")
def app_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Store pages made from documents; every fifth lacks its rating."""
    docs = documents(spark, sf, "source", "lang", "text", "n_chars")
    doc, size = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    k = F.col("doc_id") % 5
    stars = F.concat(k.cast("string"), F.lit(" stars, "), size, F.lit(" Ratings"))
    html = F.concat(
        F.lit('<html><body><div id="title"><div><h1>'), F.col("source"),
        F.lit("</h1><h2>By "), F.lit("maker "), F.col("lang"),
        F.lit('</h2></div></div><div id="left-stack"><ul><li>$'),
        (F.col("doc_id") % 10).cast("string"),
        F.lit('</li><li class="genre">Category: <a href="/g">'), F.col("lang"),
        F.lit("</a></li><li>Updated</li><li>Version</li><li>Size: "), size,
        F.lit(" MB</li><li>Language</li><li>Seller: seller "), F.col("source"),
        F.lit('</li></ul><div class="customer-ratings">'),
        F.when(k == 0, F.lit("")).otherwise(F.concat(
            F.lit('<div class="rating" aria-label="'), stars, F.lit('"><br></div>'))),
        F.lit("</div></div></body></html>"))
    page = docs.select(html.alias("html"), F.concat(F.lit("https://x/id"), doc).alias("url"))
    return pages.app_pages(page)
