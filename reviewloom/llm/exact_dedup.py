"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Equal texts are found in three steps that all group by the digest *and* the
full normalised content, so a digest shared by different texts never merges
them: inside each task before the shuffle (partial aggregation), in salted
digest groups, and over the winners of the salts. A group of copies that holds
a third of all rows therefore sends one row per task and distinct text.

Defined results: null text counts as empty; a null id ranks after every other
id; repeated rows each get their row; an empty table gives an empty result;
other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import query, table
from reviewloom.runtime import durable, hot_keys, salted_join

SPACES = r"[\x20\x09-\x0D]+"

# Rows of one digest meet in this many groups before they meet in one.
SALTS = 8

# Ids are packed below the length, so that one number ranks a row. The span is
# over 2^64 and the top is 2^63, so every id has a place above 0.
_ID_SPAN = "20000000000000000000"
_ID_TOP = "9223372036854775808"


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _rank(n: Column, row_id: Column) -> Column:
    """Larger for longer texts, then for smaller ids; a null id ranks last."""
    span = F.lit(_ID_SPAN).cast("decimal(20,0)")
    low = F.coalesce(F.lit(_ID_TOP).cast("decimal(20,0)") - row_id.cast("decimal(20,0)"),
                     F.lit(0).cast("decimal(20,0)"))
    return (n.cast("decimal(10,0)") * span + low).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    low = rank % F.lit(_ID_SPAN).cast("decimal(20,0)")
    return F.when(low > 0, (F.lit(_ID_TOP).cast("decimal(20,0)") - low).cast("bigint"))


def exact_groups(docs: DataFrame, row_id: str = "doc_id", text: str = "text", salts: int = SALTS,
                 digest: object = sha256) -> DataFrame:
    """One row per input row: id, digest, keep_id, group_size, kept.

    The row with the longest original text, then the smallest id, stays.
    """
    rows = docs.select(
        F.col(row_id).alias("row_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"),
        normalised(text).alias("body")).withColumn("digest", digest(F.col("body")))
    salt = F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int")
    salted = (rows.withColumn("salt", salt).groupBy("digest", "salt", "body")
              .agg(F.count("*").alias("size"), F.max(_rank(F.col("n"), F.col("row_id"))).alias("rank")))
    winners = (salted.repartition("digest").groupBy("digest", "body")
               .agg(F.sum("size").alias("size"), F.max("rank").alias("rank")))
    # Slim rows; partitioned by digest already.
    per_digest = durable(winners.groupBy("digest").agg(
        F.count("*").alias("texts"), F.max("size").alias("size"), F.max("rank").alias("rank")))

    slim = rows.select("row_id", "digest")
    single = per_digest.where("texts = 1").drop("texts")
    out = salted_join(slim, single, "digest", hot_keys(single, "digest", "size"), "row_id")
    shared = per_digest.where("texts > 1").select("digest")
    if not shared.isEmpty():
        # A digest of several texts: these rows are told apart by their content.
        some = rows.join(shared, "digest", "left_semi")
        classes = winners.join(shared, "digest", "left_semi")
        out = out.unionByName(some.join(classes, ["digest", "body"])
                              .select("row_id", "digest", "size", "rank"))
    keep = _id_of(F.col("rank"))
    return out.select(F.col("row_id").alias(row_id), "digest", keep.alias("keep_id"),
                      F.col("size").alias("group_size"),
                      F.col("row_id").eqNullSafe(keep).alias("kept"))


SQL_TEXT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
"""


@query("op7_exact_dedup", SQL_TEXT)
def op7_exact_dedup(spark, sf_dir):
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))
