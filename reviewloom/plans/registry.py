"""Collects queries and, where SQL can express them, their checking SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewloom.runtime import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Documents with the wanted columns, spread over the cores if the file is small."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", *cols), "doc_id")


# Shared SQL. SPACE and TOKEN spell the token classes for the checking engine.
SPACE = (r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
TOKEN = r"\p{L}+|[0-9]+|[^\p{L}0-9\x{0}-\x{20}\x{7F}-\x{A0}]"
TOK = f"""
  tokl AS (SELECT doc_id, regexp_extract_all(text, '[^{SPACE}]+') AS l FROM documents),
  tok AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS seq FROM tokl)"""
TAG_CASE = r"""CASE WHEN regexp_matches(lex, '^[0-9]') THEN 'SN'
    WHEN lex IN ('.', '?', '!') THEN 'SF'
    WHEN lex IN (',', ':', ';', '/') THEN 'SP'
    WHEN lex IN ('"', '''', '(', ')', '[', ']', '{', '}', '<', '>') THEN 'SS'
    WHEN lex = '…' THEN 'SE'
    WHEN lex IN ('-', '~') THEN 'SO'
    WHEN NOT regexp_matches(lex, '^\p{L}') THEN 'SW'
    WHEN n < 3 THEN 'NA'
    WHEN lex LIKE '%er' THEN 'VV'
    ELSE 'NNG' END"""
TAG = f"""
  lexl AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS l FROM documents),
  lexs AS (SELECT doc_id, unnest(l) AS lex, generate_subscripts(l, 1) AS seq FROM lexl),
  lexn AS (SELECT lex, count(*) AS n FROM lexs GROUP BY lex),
  tagn AS (SELECT lex, {TAG_CASE} AS pos, n FROM lexn)"""
FTOK = TAG + """,
  ftok0 AS (SELECT lex AS raw, CASE WHEN pos = 'VV' THEN lex || '다' ELSE lex END AS lex, pos, n
            FROM tagn WHERE pos IN ('NNG', 'VV', 'SN')),
  ftok AS (SELECT raw, lex, pos, n FROM ftok0 WHERE length(lex) >= 2)"""
VOC = FTOK + """,
  voc0 AS (SELECT lex || '/' || pos AS term, CAST(sum(n) AS BIGINT) AS cnt FROM ftok GROUP BY 1),
  voc AS (SELECT term, cnt, row_number() OVER (ORDER BY cnt DESC, term) - 1 AS idx FROM voc0
          QUALIFY row_number() OVER (ORDER BY cnt DESC, term) <= 5000)"""
