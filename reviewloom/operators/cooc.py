"""Word co-occurrence: pair counts, correlation distance, spanning forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import text as T
from reviewloom.operators.ordering import count_head
from reviewloom.operators.vocab import document_frequency, token_rows
from reviewloom.runtime import bounded, durable

# Columns of one dense block; a vocabulary up to this size is summed in place.
BLOCK = 2048
# Documents multiplied at a time.
BATCH = 1024
# Matrix rows that meet in one task of the distance job.
ROWS = 128


def top_vocabulary(docs: DataFrame, max_features: int = 500, text: str = "text",
                   tokenizer: T.Tokenizer = T.words) -> DataFrame:
    """The terms found in most documents, (term, df, idx), idx by falling df from 0."""
    df = document_frequency(docs, text, tokenizer)
    first = count_head(df, "df", ["term"], max_features, "idx")
    return first.withColumn("idx", F.col("idx") - 1)


def presence(docs: DataFrame, vocab: DataFrame, max_features: int, doc: str = "doc_id",
             text: str = "text", tokenizer: T.Tokenizer = T.words) -> DataFrame:
    """Vocabulary numbers found in each document, (doc, ids).

    A document holds at most `max_features` of them.
    """
    rows = token_rows(docs, doc, text=text,
                      tokenizer=lambda t: F.array_distinct(tokenizer(t)), name="term")
    found = rows.join(bounded(vocab.select("term", "idx"), max_features), "term")
    return found.groupBy(doc).agg(F.collect_list("idx").alias("ids"))


def _block_sums(left: np.ndarray, right: np.ndarray, a: int, b: int) -> pd.DataFrame:
    sums = left.T @ right
    i, j = np.nonzero(sums)
    keep = i + a < j + b
    i, j = i[keep], j[keep]
    return pd.DataFrame({"i": i + a, "j": j + b, "n": sums[i, j].astype("int64")})


def pair_counts(found: DataFrame, vocabulary: int) -> DataFrame:
    """Documents that hold both terms, (i, j, n) with i < j and no diagonal.

    Each task multiplies its documents' 0/1 rows with themselves, so pairs are
    summed before anything is shuffled. Up to BLOCK terms one matrix is kept
    per task; beyond, sums are given out per batch and pair of column blocks.
    """
    def rows_of(pdf: pd.DataFrame, start: int, width: int) -> np.ndarray:
        out = np.zeros((len(pdf), width), dtype="float32")
        for r, ids in enumerate(pdf["ids"]):
            ids = np.asarray(ids)
            ids = ids[(ids >= start) & (ids < start + width)] - start
            out[r, ids] = 1.0
        return out

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), BATCH):
                yield pdf.iloc[at:at + BATCH]

    def whole(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((vocabulary, vocabulary), dtype="float64")
        for pdf in batches(it):
            x = rows_of(pdf, 0, vocabulary)
            total += x.T @ x
        i, j = np.nonzero(np.triu(total, 1))
        yield pd.DataFrame({"i": i, "j": j, "n": total[i, j].astype("int64")})

    def blocked(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = range(0, vocabulary, BLOCK)
        for pdf in batches(it):
            for a in starts:
                left = rows_of(pdf, a, min(BLOCK, vocabulary - a))
                for b in starts:
                    if b >= a:
                        right = rows_of(pdf, b, min(BLOCK, vocabulary - b))
                        yield _block_sums(left, right, a, b)

    job = whole if vocabulary <= BLOCK else blocked
    parts = found.select("ids").mapInPandas(job, "i long, j long, n long")
    return parts.groupBy("i", "j").agg(F.sum("n").alias("n"))


def cooccurrence(docs: DataFrame, max_features: int = 500, doc: str = "doc_id",
                 text: str = "text", tokenizer: T.Tokenizer = T.words,
                 vocab: DataFrame | None = None) -> DataFrame:
    """Pairs of frequent terms in one document, (term_i, term_j, n), term_i < term_j.

    `vocab` is the vocabulary if it is at hand.
    """
    vocab = top_vocabulary(docs, max_features, text, tokenizer) if vocab is None else vocab
    found = presence(docs, vocab, max_features, doc, text, tokenizer)
    pairs = pair_counts(found, max_features)
    a = bounded(vocab.select(F.col("idx").alias("i"), F.col("term").alias("a")), max_features)
    b = bounded(vocab.select(F.col("idx").alias("j"), F.col("term").alias("b")), max_features)
    return pairs.join(a, "i").join(b, "j").select(
        F.least("a", "b").alias("term_i"), F.greatest("a", "b").alias("term_j"), "n")


def correlation_distance(edges: DataFrame, vocab: DataFrame, vocabulary: int) -> DataFrame:
    """1 - Pearson correlation of the rows of the pair matrix, (term_i, term_j, distance).

    `edges` holds (term_i, term_j, n). Every pair of vocabulary terms is part
    of the result, so its size is set by the vocabulary and not by the data.
    Terms with a constant row have no correlation and are left out, as are
    pairs at distance 0. Rows meet in blocks of ROWS, two blocks per task.
    """
    number = bounded(vocab.select("term", "idx"), vocabulary)
    numbered = (edges.join(number.select(F.col("term").alias("term_i"), F.col("idx").alias("i")),
                           "term_i")
                .join(number.select(F.col("term").alias("term_j"), F.col("idx").alias("j")),
                      "term_j").select("i", "j", "n"))
    both = numbered.union(numbered.select("j", "i", "n"))
    rows = both.groupBy("i").agg(F.collect_list("j").alias("js"), F.collect_list("n").alias("ns"))
    names = vocab.select(F.col("idx").alias("i"), "term")
    rows = rows.join(bounded(names, vocabulary), "i")
    last = (vocabulary - 1) // ROWS
    own = F.floor(F.col("i") / ROWS).cast("int")
    rows = rows.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(last))))
    rows = rows.select("i", "term", "js", "ns", "own", F.least("own", "other").alias("p"),
                       F.greatest("own", "other").alias("q"))

    def distances(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x = np.zeros((len(pdf), vocabulary))
        for r, (js, ns) in enumerate(zip(pdf["js"], pdf["ns"])):
            x[r, np.asarray(js)] = np.asarray(ns)
        size = float(vocabulary)
        sums = x.sum(axis=1)
        spread = np.sqrt(size * (x * x).sum(axis=1) - sums * sums)
        cov = size * (x @ x.T) - np.outer(sums, sums)
        own, number = pdf["own"].to_numpy(), pdf["i"].to_numpy()
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        wanted = ((own == p)[:, None] & (own == q)[None, :]
                  & (number[:, None] < number[None, :])
                  & (spread > 0)[:, None] & (spread > 0)[None, :])
        a, b = np.nonzero(wanted)
        far = 1.0 - cov[a, b] / (spread[a] * spread[b])
        term = pdf["term"].to_numpy()
        out = pd.DataFrame({"a": term[a], "b": term[b], "distance": far})
        return out[out["distance"] != 0.0]

    pairs = rows.groupBy("p", "q").applyInPandas(distances, "a string, b string, distance double")
    return pairs.select(F.least("a", "b").alias("term_i"), F.greatest("a", "b").alias("term_j"),
                        "distance")


def sorted_pairs(pairs: DataFrame, ascending: bool = True) -> DataFrame:
    """Pairs by distance (to six places), then by terms."""
    shown = F.round("distance", 6)
    order = shown.asc() if ascending else shown.desc()
    return pairs.orderBy(order, "term_i", "term_j")


def spanning_forest(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """Minimum spanning forest of an edge table, (src, dst, weight).

    Each round every component takes its cheapest edge to another component
    and the components so linked are merged, which at least halves their
    number. Edges are ordered by weight, then ends, so no two are equal and the
    forest is unique. Tables of a round are made durable.
    """
    e = durable(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"),
                             F.col(weight).alias("w")))
    nodes = e.select(F.col("a").alias("v")).union(e.select("b")).distinct()
    comp = durable(nodes.select("v", F.col("v").alias("c")))
    chosen = None
    while True:
        ends = (e.join(comp.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a")
                .join(comp.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
                .where("ca <> cb"))
        way = F.struct("w", "a", "b")
        both = (ends.select(F.col("ca").alias("c"), F.col("cb").alias("to"), way.alias("e"))
                .union(ends.select("cb", "ca", way)))
        best = durable(both.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m"))
                       .select("c", "m.to", "m.e"))
        if best.isEmpty():
            break
        picked = best.select("e").distinct().select("e.*")
        chosen = picked if chosen is None else chosen.union(picked)
        # Each component points to the one it joins; of two that point to each
        # other the smaller becomes the root, and pointers are then doubled.
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        parent = best.join(back, "to").select(
            "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c"))
            .otherwise(F.col("to")).alias("r"))
        parent = durable(parent)
        while True:
            up = parent.select(F.col("c").alias("r"), F.col("r").alias("r2"))
            jumped = durable(parent.join(up, "r").select(
                "c", F.col("r2").alias("r"), (F.col("r2") != F.col("r")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            parent = jumped.select("c", "r")
            if not moved:
                break
        comp = durable(comp.join(parent, "c", "left").select(
            "v", F.coalesce("r", "c").alias("c")))
    if chosen is None:
        chosen = e.limit(0).select("w", "a", "b")
    return chosen.distinct().select(
        F.col("a").alias(src), F.col("b").alias(dst), F.col("w").alias(weight))
