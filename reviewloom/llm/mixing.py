"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks. In the ideal mix every source that has rows
left is served in proportion to its weight at any time. The i-th block of a
source is released at the slot in which the ideal mix begins with it and due by
the end of the slot in which it is done; the released block with the earliest
deadline takes the slot. So after any number of slots every source is less than
one block away from the ideal mix, with the weights as they are, unrounded.
While all sources have rows (phase 0) with a target weight w this is slot
floor(i / w) and ceil((i + 1) / w). When a source runs out, the others go on
with their weights scaled up: a new phase. No row is dropped.

The driver takes the row count and the weight of each source, goes through the
slots in pieces of bounded size and hands out one row per block; names and rows
of sources stay in tables. Rows are numbered inside their source in an order
drawn by a hash of their id, through counts of hash buckets, so that a source of
any size is numbered in many tasks.

Defined results: a null source is a source of its own; a source without a given
weight gets weight 0 and comes after all others; repeated rows are placed one
by one; an empty table gives an empty result. With `cycle` given, weights are
rounded to multiples of 1/cycle, which needs a slot of the cycle per source.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from reviewloom.llm.common import query, table
from reviewloom.operators.ordering import global_index
from reviewloom.runtime import bounded, durable, vocabulary_join

BUCKETS = 1024
BLOCK = 32

# Slots planned at a time.
PIECE = 1 << 20

# Without given weights a source weighs its row count to this power.
TEMPERATURE = 0.5


def quotas(weights: list[float], cycle: int) -> list[int]:
    """Slots of each source in a cycle, by largest remainders; at least one each."""
    total = sum(weights)
    exact = [w / total * cycle for w in weights]
    out = [max(1, int(x)) for x in exact]
    order = sorted(range(len(out)), key=lambda s: (out[s] - exact[s], s))
    k = 0
    while sum(out) < cycle:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out) > cycle:
        out[max(range(len(out)), key=lambda s: (out[s], -s))] -= 1
    return out


class Ideal:
    """The ideal mix of sources with these weights and numbers of blocks: slots passed when a source has got v / weight.

    `v` is served per unit of weight, the same for all sources that have blocks left.
    """

    def __init__(self, weights: np.ndarray, blocks: np.ndarray):
        done = blocks / weights
        order = np.argsort(done, kind="stable")
        self.served = np.concatenate([[0.0], done[order]])
        before = np.cumsum(blocks[order])
        later = np.cumsum(weights[order][::-1])[::-1] - weights[order]
        self.slots = np.concatenate([[0.0], before + done[order] * later])

    def at(self, served: np.ndarray) -> np.ndarray:
        return np.interp(served, self.served, self.slots)


def slot_order(weights: np.ndarray, blocks: np.ndarray, piece: int = PIECE) -> Iterator[np.ndarray]:
    """The source of every slot, in pieces: earliest deadline first among the released blocks."""
    ideal, n = Ideal(weights, blocks), len(weights)
    total = int(blocks.sum())
    begun = np.zeros(n, np.int64)
    late, late_jobs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ready: list[int] = []
    for low in range(0, total, piece):
        high = min(low + piece, total)
        # All blocks that can be released before `high`; those released later wait for the next piece.
        served = np.interp(high, ideal.slots, ideal.served)
        end = np.maximum(begun, np.minimum(blocks, np.floor(served * weights).astype(np.int64) + 2))
        if high == total:
            end = blocks
        count = end - begun
        source = np.repeat(np.arange(n), count)
        i = np.arange(len(source)) + np.repeat(begun - (np.cumsum(count) - count), count)
        # Whole numbers are met in spite of rounding errors.
        error = 1e-9 + 1e-14 * total
        release = np.floor(ideal.at(i / weights[source]) + error).astype(np.int64)
        deadline = np.ceil(ideal.at((i + 1) / weights[source]) - error).astype(np.int64)
        begun = end
        release = np.concatenate([late, release])
        jobs = np.concatenate([late_jobs, deadline * n + source])
        order = np.argsort(release, kind="stable")
        release, jobs = release[order], jobs[order]
        due, waiting, k = release.tolist(), jobs.tolist(), 0
        out = np.zeros(high - low, np.int64)
        for t in range(low, high):
            while k < len(due) and (due[k] <= t or not ready):
                heapq.heappush(ready, waiting[k])
                k += 1
            out[t - low] = heapq.heappop(ready) % n
        late, late_jobs = release[k:], jobs[k:]
        yield out


def schedule(quota: list[int], cycle: int) -> list[list[int]]:
    """Slots of each source's blocks in one cycle."""
    slots: list[list[int]] = [[] for _ in quota]
    order = slot_order(np.array(quota) / cycle, np.array(quota))
    for t, s in enumerate(np.concatenate(list(order)).tolist()):
        slots[s].append(t)
    return slots


def plan(sizes: np.ndarray, weights: np.ndarray, block: int) -> Iterator[pa.Table]:
    """Source, number inside the source, phase, slot and first position of every block, in pieces."""
    blocks = -(-sizes // block)
    begun = np.zeros(len(sizes), np.int64)
    slot = position = 0
    # Sources of weight 0 wait for the others.
    for own, own_weights in ((np.flatnonzero(weights > 0), weights[weights > 0]),
                             (np.flatnonzero(weights <= 0), np.ones(int((weights <= 0).sum())))):
        if not len(own):
            continue
        ends = Ideal(own_weights, blocks[own]).slots[1:] + slot
        phase0 = len(sizes) - len(own) if slot else 0
        for order in slot_order(own_weights, blocks[own]):
            k = own[order]
            by = np.argsort(k, kind="stable")
            first = np.flatnonzero(np.diff(k[by], prepend=-1))
            count = np.diff(first, append=len(k))
            b = np.empty(len(k), np.int64)
            b[by] = np.arange(len(k)) - np.repeat(first, count) + begun[k[by]]
            begun[k[by][first]] += count
            rows = np.minimum(block, sizes[k] - b * block)
            at = slot + np.arange(len(k))
            # A phase ends before the slot in which the ideal mix is done with a source.
            phase = phase0 + np.searchsorted(ends, at + 1 - 1e-6)
            yield pa.table({"_k": k, "_b": b, "mix_phase": phase.astype(np.int32), "mix_slot": at,
                            "_position0": position + np.cumsum(rows) - rows})
            slot += len(k)
            position += int(rows.sum())


def _key(source: str) -> Column:
    """Text that tells sources apart, null among them."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def mix(docs: DataFrame, source: str = "source", row_id: str = "doc_id", weights: dict | None = None,
        block: int = BLOCK, cycle: int | None = None) -> DataFrame:
    """Add the mix to the rows: `mix_weight`, `mix_phase`, `mix_slot` and `mix_position`.

    `mix_slot` numbers the blocks and `mix_position` the rows, both gapless from
    0; sorting by `mix_position` gives the interleaved order. `mix_phase` counts
    the sources that have run out.
    """
    spark = docs.sparkSession
    rows = (docs.withColumn("_key", _key(source))
            .withColumn("_bucket", F.pmod(F.xxhash64(row_id), F.lit(BUCKETS)).cast("int")))
    counts = rows.groupBy("_key", "_bucket").agg(F.count("*").alias("_n"))
    sources = counts.groupBy("_key").agg(F.sum("_n").alias("_n"))
    if weights is None:
        sources = sources.withColumn("_share", F.pow("_n", F.lit(TEMPERATURE)))
    else:
        schema = StructType([docs.schema[source]]).add("_share", DoubleType())
        schema[0].nullable = True
        given = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], schema)
        sources = (sources.join(given.select(_key(source).alias("_key"), "_share"), "_key", "left")
                   .withColumn("_share", F.coalesce("_share", F.lit(0.0))))
    sources = durable(global_index(sources, [F.col("_key")], "_k"))
    found = sources.select("_k", "_n", "_share").toArrow().sort_by("_k")
    sizes, share = found["_n"].to_numpy(), found["_share"].to_numpy()
    total = float(share.sum()) or 1.0
    target = share
    if cycle is not None and (share > 0).any():
        if cycle < (share > 0).sum():
            raise ValueError("a cycle needs a slot for every source")
        target = np.zeros(len(share))
        target[share > 0] = np.array(quotas(share[share > 0].tolist(), cycle)) / cycle

    n_blocks = int((-(-sizes // block)).sum())
    pieces = [spark.createDataFrame(p) for p in plan(sizes, target, block)] if n_blocks <= PIECE else [
        durable(spark.createDataFrame(p)) for p in plan(sizes, target, block)]
    plan_rows = pieces[0] if pieces else spark.createDataFrame(
        [], "_k long, _b long, mix_phase int, mix_slot long, _position0 long")
    for p in pieces[1:]:
        plan_rows = plan_rows.unionByName(p)

    index = sources.select("_key", "_k", "_n", (F.col("_share") / F.lit(total)).alias("mix_weight"))
    keyed = vocabulary_join(rows, index, "_key", "_n", [row_id], len(sizes))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_key", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(
        Window.partitionBy("_key", "_bucket").orderBy(F.xxhash64(row_id, F.lit(1)), row_id))
    numbered = (keyed.withColumn("_i", inside - 1)
                .join(bounded(starts, len(sizes) * BUCKETS), ["_key", "_bucket"])
                .withColumn("_rank", F.col("_i") + F.col("_start"))
                .withColumn("_b", F.floor(F.col("_rank") / F.lit(block)).cast("long")))
    return (numbered.join(bounded(plan_rows, n_blocks), ["_k", "_b"])
            .withColumn("mix_position", F.col("_position0") + F.pmod(F.col("_rank"), F.lit(block)))
            .select(*docs.columns, "mix_weight", "mix_phase", "mix_slot", "mix_position"))


@query("op2_mixing")
def op2_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs)
