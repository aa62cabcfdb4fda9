"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Rows fall on a ring of fixed places by a hash of their key. Every shard owns
several virtual nodes; a row belongs to the first node clockwise. A shard takes
no more than its capacity: rows that overflow it go on clockwise to the next
shard that has room. Rows overflow by whole ranges of their rank inside an arc
of the ring, so the plan of who goes where needs one count per arc. These
counts (shards x nodes numbers, whatever the data) are planned on the driver;
the rows themselves are only hashed, counted, ranked inside a ring place and
joined to the plan.

With load 1.0 the capacities add up to the number of rows and differ by one at
most, so every shard is filled exactly. A larger load leaves room and moves
fewer rows when a shard is added.

Defined results: null text has no bytes; a null key is a key like others;
repeated rows are placed one by one; an empty table gives an empty result.
Very many rows of one key and content share a ring place, and only their slim
rows are sorted together there.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import query, table
from reviewloom.operators.ordering import group_index

PLACES = 16_384
NODES = 64


def ring(shards: int, nodes: int = NODES, places: int = PLACES) -> list[tuple[int, int]]:
    """Virtual nodes as (place, shard), sorted; of nodes on one place the first drawn stays."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            digest = hashlib.md5(f"{shard}/{node}".encode()).digest()
            taken.setdefault(int.from_bytes(digest[:8], "big") % places, shard)
    return sorted(taken.items())


def capacities(total: int, shards: int, load: float) -> list[int]:
    """Rows each shard may take; together at least `total`."""
    if load <= 1.0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [math.ceil(load * total / shards)] * shards


def overflow_plan(arcs: list[int], sizes: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Ranges (arc, low, high, shard, first slot) of ranks inside arcs.

    `arcs` has the owner of each arc in ring order. First every shard takes from
    its own arcs what it has room for; then, hop by hop, what is left of an arc
    asks the next other shard clockwise.
    """
    left, used, plan = list(room), [0] * len(room), []
    done = [0] * len(arcs)
    asked = [{owner} for owner in arcs]
    at = list(range(len(arcs)))
    waiting = [a for a, n in enumerate(sizes) if n]
    while waiting:
        still = []
        for a in waiting:
            shard = arcs[at[a]]
            n = min(left[shard], sizes[a] - done[a])
            if n:
                plan.append((a, done[a], done[a] + n, shard, used[shard]))
                done[a] += n
                left[shard] -= n
                used[shard] += n
            if done[a] < sizes[a]:
                while arcs[at[a]] in asked[a] and len(asked[a]) < len(room):
                    at[a] = (at[a] + 1) % len(arcs)
                asked[a].add(arcs[at[a]])
                still.append(a)
        waiting = still
    return plan


def shard_rows(docs: DataFrame, keys: list[str], shards: int, load: float = 1.0, nodes: int = NODES) -> DataFrame:
    """Add `shard` and `slot`, gapless from 0 inside each shard, to the rows of `docs`."""
    spark = docs.sparkSession
    owners = ring(shards, nodes)
    arc_of, arc = [], 0
    for place in range(PLACES):
        while arc < len(owners) and owners[arc][0] < place:
            arc += 1
        arc_of.append((place, arc % len(owners)))
    places = F.broadcast(spark.createDataFrame(arc_of, "_place int, _arc int"))

    hashed = F.xxhash64(*keys)
    rows = docs.withColumn("_place", F.pmod(hashed, F.lit(PLACES)).cast("int"))
    per_place = rows.groupBy("_place").agg(F.count("*").alias("_n")).join(places, "_place")
    sizes = {r["_arc"]: r["n"] for r in per_place.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    total = sum(sizes.values())
    plan = overflow_plan([s for _, s in owners], [sizes.get(a, 0) for a in range(len(owners))],
                         capacities(total, shards, load))
    ranges = F.broadcast(spark.createDataFrame(
        plan, "_arc int, _low long, _high long, shard int, _first long"))

    before = Window.partitionBy("_arc").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(per_place.select(
        "_place", "_arc", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = F.row_number().over(Window.partitionBy("_place").orderBy(F.xxhash64(*keys, F.lit(1)), *keys))
    ranked = (rows.withColumn("_rank", inside - 1).join(starts, "_place")
              .withColumn("_rank", F.col("_rank") + F.col("_start")))
    return (ranked.join(ranges, "_arc")
            .where((F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
            .withColumn("slot", F.col("_first") + F.col("_rank") - F.col("_low"))
            .drop("_place", "_arc", "_start", "_rank", "_low", "_high", "_first"))


def shard_documents(docs: DataFrame, shards: int = 16, load: float = 1.0, order: list[str] | None = None) -> DataFrame:
    """Slim row of every document with its shard, under the law that counts differ by one at most.

    With `order`, columns of `docs` that leave no ties, the slots of a shard follow it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), *(order or []))
    placed = shard_rows(slim, ["doc_id", "text_crc32", "size"], shards, load)
    if order:
        placed = group_index(placed.drop("slot"), "shard", [F.col(c) for c in order], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op8_sharding")
def op8_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))
