"""Projections, filters, counts, splits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import fields
from reviewloom.functions import text as T
from reviewloom.operators import ordering, tables
from reviewloom.operators.vectors import tagged
from reviewloom.plans.registry import SPACE, documents, query, table
from reviewloom.sources.pages import page_link_rows


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a quality label, as rating."""
    docs = documents(spark, sf, "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    return docs.join(labels, "doc_id")


@query("project_reviews", """
SELECT doc_id, source, TRY_CAST(substring(source, 4) AS BIGINT) AS app_no, lang FROM documents
ORDER BY app_no, doc_id""")
def project_reviews(spark: SparkSession, sf: str) -> DataFrame:
    number = fields.after_prefix("source", 3).try_cast("bigint")
    return (table(spark, sf, "documents").select("doc_id", "source", number.alias("app_no"), "lang")
            .orderBy("app_no", "doc_id"))


@query("drop_missing", """
SELECT doc_id FROM documents WHERE text IS NOT NULL AND text NOT IN ('NaN', 'None')""")
def drop_missing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(fields.has_text("text")).select("doc_id")


@query("malformed_ids", "SELECT page_id, url FROM pages WHERE length(url) > 40")
def malformed_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(F.length("url") > 40).select("page_id", "url")


@query("docs_by_category", "SELECT doc_id, n_chars FROM documents WHERE lang = 'fr'")
def docs_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("lang") == "fr").select("doc_id", "n_chars")


@query("apps_in_list", "SELECT doc_id FROM documents WHERE source IN ('src0', 'src3')")
def apps_in_list(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "documents").where(F.col("source").isin("src0", "src3"))
            .select("doc_id"))


@query("url_id", r"""
SELECT page_id, NULLIF(regexp_extract(url, '/([0-9]+)', 1), '') AS url_id FROM pages""")
def url_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", fields.link_id("url", "/([0-9]+)").alias("url_id"))


@query("clean_fields", """
SELECT doc_id, md5(NULLIF(replace(replace(replace(text, chr(9), ''), '"', ''), chr(10), ' '), ''))
  AS cleaned FROM documents""")
def clean_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(fields.clean_field("text")).alias("cleaned"))


@query("html_fields", r"""
SELECT page_id,
  regexp_extract_all(html, '<title>([^<]*)</title>', 1)[1] AS title,
  regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)[1] AS h1,
  regexp_extract_all(html, '<html lang="([^"]*)"', 1)[1] AS lang
FROM pages""")
def html_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", fields.page_title("html").alias("title"),
        fields.page_heading("html").alias("h1"), fields.page_lang("html").alias("lang"))


@query("html_links", r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href
           FROM pages)
SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL""")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    return tables.group_counts(page_link_rows(table(spark, sf, "pages"), "page_id"),
                               "page_id", "href")


@query("balanced_sample", """
SELECT doc_id, quality AS y FROM documents JOIN labels USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= 40""")
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = labelled(spark, sf).select("doc_id", fields.binary_label("y", 0, 1).alias("y"))
    return ordering.balanced(docs.where("y IS NOT NULL"), "y", [F.col("doc_id")], 40)


@query("rank_lookup", """
WITH r AS (SELECT source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank
           FROM documents)
SELECT source, min(rank) AS rank FROM r WHERE source IN ('src1', 'src5', 'src12') GROUP BY source
""")
def rank_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "n_chars", "doc_id")
    return tables.first_rank(docs, "source", ["src1", "src5", "src12"], "n_chars", "doc_id", "rank")


@query("category_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.group_counts(table(spark, sf, "documents"), "lang")


@query("rating_hist", "SELECT quality AS y, count(*) AS n FROM labels GROUP BY quality")
def rating_hist(spark: SparkSession, sf: str) -> DataFrame:
    return tables.group_counts(
        table(spark, sf, "labels").select(F.col("quality").cast("int").alias("y")), "y")


@query("distinct_authors", """
SELECT count(DISTINCT user_id) + CAST(count(*) > count(user_id) AS BIGINT) AS n FROM events""")
def distinct_authors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.distinct_with_null(table(spark, sf, "events"), "user_id")


@query("per_app_docs", f"""
WITH d AS (SELECT doc_id, source, lang, doc_id // 256 AS part,
             regexp_extract_all(text, '[^{SPACE}]+') AS words FROM documents),
  g AS (SELECT source, part, count(*) AS docs, min_by(d.lang, doc_id) AS lang FROM d
        GROUP BY source, part),
  t AS (SELECT source, part, doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS seq
        FROM d),
  w AS (SELECT source, part, count(*) AS tokens,
          md5(string_agg(w, ' ' ORDER BY doc_id, seq)) AS digest FROM t GROUP BY source, part)
SELECT source, part, docs, lang, coalesce(tokens, 0) AS tokens, coalesce(digest, md5('')) AS digest
FROM g LEFT JOIN w USING (source, part)""")
def per_app_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "source", "lang", "text")
    docs = docs.select("doc_id", "source", "lang", T.words("text").alias("tokens"))
    parts = tables.per_app_docs(docs, "source", "doc_id", "tokens", "lang")
    return parts.select("source", "part", "docs", "lang",
                        F.size("tokens").cast("bigint").alias("tokens"),
                        F.md5(F.array_join("tokens", " ")).alias("digest"))


_SOURCES = [f"src{i}" for i in range(20)]


@query("crosstab_pivot", "SELECT lang, " + ", ".join(
    f"count(*) FILTER (source = '{s}') AS {s}" for s in _SOURCES)
    + " FROM documents GROUP BY lang")
def crosstab_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return tables.crosstab(table(spark, sf, "documents"), "lang", "source")


@query("crosstab_flags", """
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, source, n, n = max(n) OVER (PARTITION BY lang) AS is_row_max,
  n = max(n) OVER (PARTITION BY source) AS is_col_max, n = 0 AS is_zero, n > 10 AS is_large,
  source IN ('src1', 'src2') AS is_word
FROM c""")
def crosstab_flags(spark: SparkSession, sf: str) -> DataFrame:
    counts = tables.group_counts(table(spark, sf, "documents"), "lang", "source")
    return tables.crosstab_flags(counts, "lang", "source", words=["src1", "src2"])


@query("app_dimension", """
SELECT source, min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang FROM documents
GROUP BY source""")
def app_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return tables.first_per_app(table(spark, sf, "documents"), "source", "doc_id", "lang")


@query("run_groups", """
WITH s AS (SELECT conv_id, turn, role,
             CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND lag(turn) OVER w IS NOT NULL
               THEN 0 ELSE 1 END AS first
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  g AS (SELECT conv_id, turn, role, sum(first) OVER (PARTITION BY conv_id ORDER BY turn) AS run
        FROM s)
SELECT conv_id, min(turn) AS first_seq, role, count(*) AS length FROM g
GROUP BY conv_id, run, role""")
def run_groups(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.runs(table(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("sorted_trim", """
WITH s AS (SELECT CAST(page_id AS VARCHAR) AS id FROM pages),
  r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS total FROM s)
SELECT id, pos FROM r WHERE pos < total - 4""")
def sorted_trim(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"))
    return ordering.drop_last(ids, [F.col("id")], 4)


@query("ntile_chunks", """
WITH c AS (SELECT doc_id, ntile(40) OVER (ORDER BY doc_id) AS chunk FROM documents)
SELECT chunk, count(*) AS size, min(doc_id) AS first_id, max(doc_id) AS last_id FROM c
GROUP BY chunk""")
def ntile_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    return ordering.chunks(docs, [F.col("doc_id")], 40).groupBy("chunk").agg(
        F.count("*").alias("size"), F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"))


@query("split_by_app", """
WITH a AS (SELECT DISTINCT source FROM documents),
  r AS (SELECT source, row_number() OVER (
          ORDER BY TRY_CAST(regexp_extract(source, '[0-9]+') AS HUGEINT), source) AS r,
        count(*) OVER () AS n FROM a)
SELECT doc_id, source, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part
FROM documents JOIN r USING (source)""")
def split_by_app(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return ordering.split_by_app(docs, "source")


@query("train_test_counts", """
SELECT (doc_id * 2654435761) % 4294967296 % 100 < 25 AS te, quality AS y, count(*) AS n
FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def train_test_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = labelled(spark, sf).withColumn("te", ordering.in_test())
    return tables.group_counts(docs, "te", "y")


@query("ids_union", """
WITH u AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'documents' AS origin FROM documents
           UNION ALL SELECT CAST(item_id AS VARCHAR), 'benchmark' FROM benchmark)
SELECT id, count(DISTINCT origin) AS origins FROM u GROUP BY id""")
def ids_union(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("documents").alias("origin"))
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.lit("benchmark").alias("origin"))
    return docs.unionByName(items).distinct().groupBy("id").agg(F.count("*").alias("origins"))


@query("tagged_docs", """
SELECT doc_id, source, lang, CAST(doc_id AS VARCHAR) || ',' || source || ',' || lang AS tags
FROM documents""")
def tagged_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    out = tagged(docs, "doc_id", "doc_id", "source", "lang")
    return out.withColumn("tags", F.array_join("tags", ","))


@query("epoch_ts", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def epoch_ts(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", F.unix_timestamp(ts).alias("seconds"))


@query("json_get", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_get(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("sample_one")
def sample_one(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return ordering.sample_rows(docs, 1, 7)
