"""Approximate nearest neighbours by largest inner product: a pruned graph per shard, beam search in every shard.

Rows are dealt to shards of about SHARD_ROWS by a hash of their row number, so any group of near vectors is spread
evenly. A task builds the graph of a shard (see `pruned_graph`); the index is a table with a row per different vector of
a shard: vector, neighbours, and its smallest ids. Only the k + 1 smallest ids of equal vectors can be among the k
nearest of any query, so no other is kept and no result is lost. Queries are cut into pieces of about QUERY_ROWS; a
task gets the index rows of one shard and then the queries of one piece as a stream, searches them in batches, and
sends on the k best per query. Their scores are summed anew in double precision over the original vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components neither ask nor are found; a
null id is found but doesn't ask, and comes last among equals; vectors of other lengths are a space of their own; rows
that share an id are rows of their own and find each other; equal scores go by id; an empty table gives no rows; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm import pruned_graph as graph
from reviewloom.llm.common import query, slices, table
from reviewloom.operators.ordering import top_n
from reviewloom.runtime import bounded, durable

SHARD_ROWS = 8192
QUERY_ROWS = 16384
BEAM = 100
K = 20

INDEX = ("size int, shard long, node int, start int, vector array<double>, edges array<int>, "
         "owners array<struct<id:long,row:long>>")
OWNER = pa.struct([("id", pa.int64()), ("row", pa.int64())])
INDEX_ARROW = pa.schema([("size", pa.int32()), ("shard", pa.int64()), ("node", pa.int32()), ("start", pa.int32()),
                         ("vector", pa.list_(pa.float64())), ("edges", pa.list_(pa.int32())),
                         ("owners", pa.list_(OWNER))])
FOUND = "query_row long, query_id long, id long, score double"
FOUND_ARROW = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()),
                         ("score", pa.float64())])


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def numbered_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Vectors that take part: row (a number of its own), id, vector, size. Durable, as the numbers are drawn once."""
    values = F.col(vector).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("id"), values.alias("vector")).where(usable(F.col("vector")))
    return durable(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector",
                               F.size("vector").alias("size")))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _groups(batches, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows that agree in the first columns, a short batch at a time."""
    for batch in slices(batches, 1024):
        at = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
        begin = 0
        for i in range(1, len(at) + 1):
            if i == len(at) or at[i] != at[begin]:
                yield at[begin], batch.slice(begin, i - begin)
                begin = i


def _shard_rows(key: tuple, parts: list[pa.RecordBatch], copies: int, degree: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Index rows of one shard."""
    vectors = np.concatenate([_matrix(p.column("vector")) for p in parts])
    ids = [x for p in parts for x in zip(p.column("id").to_pylist(), p.column("row").to_pylist())]
    unique, node = np.unique(vectors, axis=0, return_inverse=True)
    owners: list[list] = [[] for _ in unique]
    for i, n in enumerate(node.ravel()):
        owners[n].append(ids[i])
    points = graph.lifted(unique)
    edges, start = graph.build(points, degree, beam)
    for at in range(0, len(unique), 512):
        some = range(at, min(at + 512, len(unique)))
        kept = [sorted(owners[n], key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:copies] for n in some]
        yield pa.RecordBatch.from_arrays([
            pa.array([key[0]] * len(some), pa.int32()), pa.array([key[1]] * len(some), pa.int64()),
            pa.array(list(some), pa.int32()), pa.array([start] * len(some), pa.int32()),
            pa.array(unique[at:at + 512].tolist(), pa.list_(pa.float64())),
            pa.array([e[e >= 0].tolist() for e in edges[at:at + 512]], pa.list_(pa.int32())),
            pa.array([[{"id": i, "row": r} for i, r in k] for k in kept], pa.list_(OWNER))], schema=INDEX_ARROW)


def build_index(vectors: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, degree: int = graph.DEGREE,
                beam: int = graph.BUILD_BEAM) -> DataFrame:
    """The index of `numbered_vectors`, for searches of up to k neighbours."""
    counts = vectors.groupBy("size").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    counts = durable(counts)
    total = counts.agg(F.sum("shards")).first()[0] or 1
    dealt = (vectors.join(bounded(counts, counts.count()), "size")
             .withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards"))))

    def run(batches):
        key, parts = None, []
        for at, rows in _groups(batches, 2):
            if at != key and parts:
                yield from _shard_rows(key, parts, k + 1, degree, beam)
                parts = []
            key = at
            parts.append(rows)
        if parts:
            yield from _shard_rows(key, parts, k + 1, degree, beam)

    rows = dealt.select("size", "shard", "id", "row", "vector").repartitionByRange(total, "size", "shard")
    return durable(rows.sortWithinPartitions("size", "shard", "row").mapInArrow(run, INDEX))


class _Shard:
    """One shard's part of the index in a task."""

    def __init__(self, parts: list[pa.RecordBatch], degree: int):
        self.vectors = np.concatenate([_matrix(p.column("vector")) for p in parts])
        self.start = parts[0].column("start")[0].as_py()
        self.owners = [o for p in parts for o in p.column("owners").to_pylist()]
        self.points = graph.lifted(self.vectors)
        self.edges = np.full((len(self.vectors), degree), -1, np.int32)
        for node, kept in enumerate(e for p in parts for e in p.column("edges").to_pylist()):
            self.edges[node, :len(kept)] = kept

    def search(self, queries: np.ndarray, rows: list[int], k: int, beam: int) -> Iterator[list[tuple[int, float]]]:
        """(id, score) of the k nearest found of every query but its own row, best first."""
        longest = np.abs(queries).max(1, keepdims=True)
        asked = np.column_stack([queries / longest, np.zeros(len(queries))]).astype(np.float32)
        nodes, _, _ = graph.beam_search(self.points, self.edges, self.start, asked, beam)
        # One component after the other, so that equal vectors get equal scores.
        scores = np.zeros(nodes.shape)
        for j in range(queries.shape[1]):
            scores += queries[:, j:j + 1] * self.vectors[nodes, j]
        scores[nodes < 0] = -np.inf
        order = np.argsort(-scores, axis=1, kind="stable")
        for i, row in enumerate(rows):
            found = []
            for j in order[i]:
                score = float(scores[i, j])
                # Past k, only equal scores may still come before.
                if nodes[i, j] < 0 or (len(found) >= k and score < found[k - 1][1]):
                    break
                found += [(o["id"], score) for o in self.owners[nodes[i, j]] if o["row"] != row]
            found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
            yield found[:k]


def search(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, query_rows: int = QUERY_ROWS,
           degree: int = graph.DEGREE) -> DataFrame:
    """(query_row, query_id, rank, id, score): the k nearest found of each query (row, id, vector, size).

    Every query goes through every shard of its length. A query's row number keeps it from finding itself.
    """
    shards = durable(index.groupBy("size").agg((F.max("shard") + 1).alias("shards")))
    pieces = -(-queries.count() // query_rows) or 1
    total = (shards.agg(F.sum("shards")).first()[0] or 1) * pieces
    asked = (queries.join(bounded(shards, shards.count()), "size")
             .withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(pieces)))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))))
    none = F.lit(None)
    asked = asked.select("size", "shard", "piece", F.lit(1).alias("kind"), F.lit(0).alias("node"), F.lit(0).alias("start"),
                         "vector", none.cast("array<int>").alias("edges"),
                         F.array(F.struct("id", "row")).alias("owners"))
    copied = index.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))))
    copied = copied.withColumn("kind", F.lit(0)).select(asked.columns)

    def run(batches):
        key, parts, shard = None, [], None
        for (size, number, piece, kind), rows in _groups(batches, 4):
            if (size, number, piece) != key:
                key, parts, shard = (size, number, piece), [], None
            if kind == 0:
                parts.append(rows)
                continue
            shard = shard or _Shard(parts, degree)
            parts = []
            for at in range(0, rows.num_rows, graph.BATCH):
                some = rows.slice(at, graph.BATCH)
                who = [o[0] for o in some.column("owners").to_pylist()]
                hits = shard.search(_matrix(some.column("vector")), [w["row"] for w in who], k, beam)
                out = [(w["row"], w["id"], i, s) for w, found in zip(who, hits) for i, s in found]
                columns = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, FOUND_ARROW)],
                                                 schema=FOUND_ARROW)

    both = copied.unionByName(asked).repartitionByRange(total, "size", "shard", "piece")
    found = both.sortWithinPartitions("size", "shard", "piece", "kind", "node").mapInArrow(run, FOUND)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    return top_n(found, "query_row", order, k).select("query_row", "query_id", "rank", "id", "score")


@query("op13_vector_graph")
def op13_vector_graph(spark, sf_dir):
    vectors = numbered_vectors(table(spark, sf_dir, "embeddings"))
    found = search(build_index(vectors), vectors.where(F.col("id") % 20 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
