"""TF-IDF in its variants, keywords and contrasts of two groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from reviewloom.operators.ordering import number_head, top_n
from reviewloom.operators.vocab import top_by_frequency
from reviewloom.runtime import bounded, hot_keys, salted_join, vocabulary_join


def idf_of(df: Column, n_docs: Column, kind: str) -> Column:
    """Inverse document frequency.

    smooth: ln((1+N)/(1+df)) + 1;  plain: ln(N/df) + 1;  log2: log2(N/df);
    none: 1.
    """
    n, d = n_docs.cast("double"), df.cast("double")
    if kind == "smooth":
        return F.log((n + 1) / (d + 1)) + 1
    if kind == "plain":
        return F.log(n / d) + 1
    if kind == "log2":
        return F.log(2.0, n / d)
    return F.lit(1.0)


def limit_vocabulary(tf: DataFrame, doc: str, max_features: int | None) -> DataFrame:
    """Keep the terms with the largest total count."""
    if max_features is None:
        return tf
    totals = tf.groupBy("term").agg(F.sum("n").alias("total"))
    kept = top_by_frequency(totals, "total", max_features)
    return vocabulary_join(tf, kept, "term", "total", doc, max_features, "left_semi")


def idf_table(tf: DataFrame, n_docs: Column, kind: str = "smooth") -> DataFrame:
    """(term, df, idf) from term frequencies (doc, term, n).

    Counting by `n` rather than by rows keeps the plan of `tf` the same here
    and where it is weighted, so its shuffle is read twice and made once.
    """
    df = tf.groupBy("term").agg(F.count_if(F.col("n") > 0).alias("df"))
    return df.select("term", "df", idf_of(F.col("df"), n_docs, kind).alias("idf"))


def raw_weights(tf: DataFrame, idf: DataFrame, doc: str, sublinear: bool = False,
                max_features: int | None = None) -> DataFrame:
    """Add `raw`, the weight before normalisation.

    With a bounded vocabulary the idf table is broadcast; without, frequent
    terms are split by document.
    """
    found = vocabulary_join(tf, idf.select("term", "idf", "df"), "term", "df", doc, max_features)
    count = F.col("n").cast("double")
    count = F.log(count) + 1 if sublinear else count
    return found.withColumn("raw", count * F.col("idf")).drop("idf")


def norm_of(norm: str | None, over: WindowSpec | None = None) -> Column:
    """Aggregate that gives the length of a document vector."""
    if norm is None:
        return F.lit(1.0)
    total = F.sum(F.col("raw") * F.col("raw") if norm == "l2" else F.abs("raw"))
    total = total if over is None else total.over(over)
    return F.sqrt(total) if norm == "l2" else total


def tfidf(tf: DataFrame, n_docs: Column, doc: str, idf: str = "smooth", sublinear: bool = False,
          norm: str | None = "l2", max_features: int | None = None,
          drop_zero: bool = False, grouped: bool = False) -> DataFrame:
    """Weights (doc, term, weight) from term frequencies (doc, term, n).

    Other columns of `tf` are kept. A document that was one row of text is
    normalised by a window over its own terms. With `grouped`, when a document
    stands for many rows (an app), norms are summed apart and joined back with
    large documents split.
    """
    tf = limit_vocabulary(tf.where(F.col(doc).isNotNull()), doc, max_features)
    table = idf_table(tf, n_docs, idf)
    raw = raw_weights(tf, table, doc, sublinear, max_features)
    if drop_zero:
        raw = raw.where(F.col("raw") != 0)
    if norm is None:
        return raw.withColumn("weight", F.col("raw")).drop("n", "raw")
    if grouped:
        norms = raw.groupBy(doc).agg(norm_of(norm).alias("norm"), F.count("*").alias("k"))
        hot = hot_keys(norms, doc, "k")
        raw = salted_join(raw, norms.select(doc, "norm"), doc, hot, "term")
    else:
        raw = raw.withColumn("norm", norm_of(norm, Window.partitionBy(doc)))
    return raw.withColumn("weight", F.col("raw") / F.col("norm")).drop("n", "raw", "norm")


def count_weights(tf: DataFrame) -> DataFrame:
    """Counts as weights, the other vectoriser."""
    return tf.withColumn("weight", F.col("n").cast("double")).drop("n")


def vectorise(tf: DataFrame, n_docs: Column, doc: str, vectoriser: str = "tfidf", max_features: int | None = None,
              **options) -> DataFrame:
    """Weights (doc, term, weight) by the chosen vectoriser, `tfidf` with its options or `count`."""
    if vectoriser == "tfidf":
        return tfidf(tf, n_docs, doc, max_features=max_features, **options)
    if vectoriser != "count":
        raise ValueError(f"no vectoriser {vectoriser}")
    return count_weights(limit_vocabulary(tf.where(F.col(doc).isNotNull()), doc, max_features))


def keywords(tf: DataFrame, n_docs: Column, doc: str, n: int = 10) -> DataFrame:
    """The n heaviest terms per document, (doc, term, weight, rank).

    Dividing by the norm does not change the order inside a document, so rows
    are cut to n per document first and only those meet the norms. Equal
    weights (to six places) go to the smaller term; terms have positive weight.
    """
    tf = tf.where(F.col(doc).isNotNull())
    table = idf_table(tf, n_docs)
    raw = raw_weights(tf, table, doc)
    norms = raw.groupBy(doc).agg(norm_of("l2").alias("norm"))
    best = top_n(raw.withColumn("shown", F.round("raw", 6)), doc,
                 [F.col("shown").desc(), F.col("term")], n)
    return best.join(norms, doc).select(
        doc, "term", (F.col("raw") / F.col("norm")).alias("weight"), "rank")


def side_by_side(good: DataFrame, bad: DataFrame, n: int) -> DataFrame:
    """The n most frequent terms of two groups (term, cnt) next to each other."""
    order = [F.col("cnt").desc(), F.col("term")]
    a = number_head(good.select("term", "cnt"), order, n).select(
        "rank", F.col("term").alias("term_good"), F.col("cnt").alias("cnt_good"))
    b = number_head(bad.select("term", "cnt"), order, n).select(
        "rank", F.col("term").alias("term_bad"), F.col("cnt").alias("cnt_bad"))
    return a.join(b, "rank", "full_outer")


def contrast(good: DataFrame, bad: DataFrame, n: int) -> DataFrame:
    """Terms among the n most frequent of one group only, both ways, by rank.

    Works on two lists of n rows; the shorter result is padded with NULL.
    """
    a = top_by_frequency(good, "cnt", n).select("term", "cnt")
    b = top_by_frequency(bad, "cnt", n).select("term", "cnt")
    return side_by_side(a.join(bounded(b.select("term"), n), "term", "left_anti"),
                        b.join(bounded(a.select("term"), n), "term", "left_anti"), n)


def overlap(good: DataFrame, bad: DataFrame, sizes: list[int]) -> DataFrame:
    """Number of shared terms of the two top-k lists, per k."""
    def one(k: int) -> DataFrame:
        a = top_by_frequency(good, "cnt", k).select("term")
        b = top_by_frequency(bad, "cnt", k).select("term")
        return a.intersect(b).agg(F.lit(k).cast("bigint").alias("k"),
                                  F.count("*").alias("shared"))
    out = one(sizes[0])
    for k in sizes[1:]:
        out = out.unionByName(one(k))
    return out
