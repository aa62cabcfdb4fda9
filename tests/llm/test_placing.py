"""Sharding and mixing against brute force and their laws."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm import mixing, sharding

DOCS = "doc_id long, text string, source string, n int, slot int, mix_weight double, _note string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 0.5, "x") for i, t, s in rows], DOCS).select(
        "doc_id", "text", "source", "n", "slot")


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, "t" * rng.randrange(50), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_are_level_and_gapless(spark, shards):
    got = sharding.shard_documents(frame(spark, rows_of(500)), shards).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 500 and set(by) == set(range(shards))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_overflow_goes_clockwise():
    """Against placing row by row: what a shard has no room for asks the next other one."""
    rng = random.Random(5)
    arcs = [rng.randrange(5) for _ in range(40)]
    arcs[:5] = range(5)
    sizes = [rng.randrange(20) for _ in arcs]
    room = sharding.capacities(sum(sizes), 5, 1.0)
    plan = sharding.overflow_plan(arcs, sizes, room)
    left, want = list(room), Counter()
    waiting = [(a, [a], {arcs[a]}) for a, n in enumerate(sizes) for _ in range(n)]
    while waiting:
        still = []
        for a, at, asked in waiting:
            shard = arcs[at[0]]
            if left[shard]:
                left[shard] -= 1
                want[a, shard] += 1
                continue
            while arcs[at[0]] in asked and len(asked) < 5:
                at[0] = (at[0] + 1) % len(arcs)
            asked.add(arcs[at[0]])
            still.append((a, at, asked))
        waiting = still
    got = Counter()
    for a, low, high, shard, _ in plan:
        got[a, shard] += high - low
    assert got == want
    assert sum(got.values()) == sum(sizes)


def test_a_new_shard_moves_few_rows(spark):
    rows = frame(spark, rows_of(4000)).select("doc_id")
    for load, most in ((1.0, 0.4), (1.25, 0.25)):
        before = {r.doc_id: r.shard for r in sharding.shard_rows(rows, ["doc_id"], 16, load).collect()}
        after = {r.doc_id: r.shard for r in sharding.shard_rows(rows, ["doc_id"], 17, load).collect()}
        assert sum(before[i] != after[i] for i in before) / len(before) < most
        assert max(Counter(after.values()).values()) <= max(sharding.capacities(4000, 17, load))


def test_sharding_edge_cases(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "é", None), (2, "", "b"), (3, "x" * 100_000, "b")]
    got = sharding.shard_documents(frame(spark, rows), 2).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 1, 3, 100_001]
    assert sorted(Counter(r.shard for r in got).values()) == [2, 3]
    assert sharding.shard_documents(frame(spark, [])).count() == 0
    hot = sharding.shard_documents(frame(spark, [(7, "x", "a")] * 90 + rows_of(180))).collect()
    assert max(Counter(r.shard for r in hot).values()) == 17


@pytest.mark.parametrize("weights", [[1, 1, 1], [5, 3, 2], [0.7, 0.2, 0.06, 0.04], [1] * 9])
def test_schedule_keeps_every_source_within_one_block(weights):
    cycle = 100
    quota = mixing.quotas(weights, cycle)
    slots = mixing.schedule(quota, cycle)
    assert sorted(t for s in slots for t in s) == list(range(cycle))
    for q, own in zip(quota, slots, strict=True):
        for t in range(cycle + 1):
            assert abs(sum(x < t for x in own) - t * q / cycle) < 1
        for i, t in enumerate(own):
            assert i * cycle // q <= t < -(-(i + 1) * cycle // q)


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.2}])
def test_mix(spark, weights):
    rows = rows_of(1500)
    got = mixing.mix(frame(spark, rows), weights=weights, block=4, cycle=50).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(1500))
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert [r.mix_slot for r in got] == sorted(r.mix_slot for r in got)
    assert all(len({r.source for r in got if r.mix_slot == s}) == 1 for s in {r.mix_slot for r in got})
    first = [r for r in got if r.mix_phase == 0]
    order = {r.mix_slot: r.source for r in first}
    share = {r.source: r.mix_weight for r in first}
    rounded = dict(zip(share, mixing.quotas(list(share.values()), 50), strict=True))
    for s, q in rounded.items():
        for t in range(1, len(order) + 1):
            assert abs(sum(order[k] == s for k in range(t)) - t * q / 50) < 1
    if weights:
        # The null source has no weight and comes last.
        last = [r for r in got if r.source is None]
        assert min(r.mix_position for r in last) == 1500 - len(last)


def test_mix_edge_cases(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    got = mixing.mix(frame(spark, [(1, None, None), (1, None, None), (None, "", "a")])).collect()
    assert sorted(r.mix_position for r in got) == [0, 1, 2]
    assert set(got[0].asDict()) == {"doc_id", "text", "source", "n", "slot", "mix_weight", "mix_phase", "mix_slot",
                                    "mix_position"}


@pytest.mark.parametrize("rows", [
    {"a": 4000, "b": 4000, "c": 4000},
    {"hot": 6000, **{f"s{k}": 90 for k in range(59)}},
    {"rare": 3, "a": 5000, "b": 4997}])
def test_mix_follows_the_unrounded_weights_over_many_cycles(spark, rows):
    weights = {"rare": 0.0001, "a": 0.5, "b": 0.4999} if "rare" in rows else {
        "hot": 0.6, **{f"s{k}": 0.4 / 59 for k in range(59)}} if "hot" in rows else None
    sources = [s for s, n in rows.items() for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string")
    got = mixing.mix(docs, weights=weights, block=1).orderBy("mix_slot").collect()
    assert [r.mix_position for r in got] == list(range(len(sources)))
    assert Counter(r.source for r in got) == Counter(sources)
    first = [r for r in got if r.mix_phase == 0]
    assert len(first) > 8000
    taken = Counter()
    weight = {r.source: r.mix_weight for r in got}
    for t, r in enumerate(first, 1):
        taken[r.source] += 1
        assert all(abs(taken[s] - w * t) < 1 for s, w in weight.items())


def test_slots_follow_the_ideal_mix_after_sources_have_run_out():
    rng = np.random.default_rng(3)
    weights, blocks = rng.random(30), rng.integers(1, 200, 30)
    orders = [np.concatenate(list(mixing.slot_order(weights, blocks, piece))) for piece in (1 << 20, 500, 7)]
    assert (orders[0] == orders[1]).all() and (orders[0] == orders[2]).all()
    # The ideal mix, served in small steps of its own time.
    served, share, at = 0.0, np.zeros(30), []
    while share.sum() < blocks.sum() - 1e-9:
        live = np.where(share < blocks - 1e-12, weights, 0)
        left = np.min((blocks - share)[live > 0] / weights[live > 0])
        step = min(left, (np.floor(served + 1e-9) + 1 - served) / live.sum())
        share, served = np.minimum(blocks, share + live * step), served + live.sum() * step
        if abs(served - round(served)) < 1e-9:
            at.append((round(served), share.copy()))
    assert len(at) == blocks.sum()
    for t, want in at:
        assert (abs(np.bincount(orders[0][:t], minlength=30) - want) < 1 + 1e-6).all()


def test_mix_takes_any_number_of_sources(spark):
    rows = [(i, "", f"s{i % 1500}") for i in range(3000)] + [(9000 + i, "", "hot") for i in range(2000)]
    rows += [(None, None, None)]
    got = mixing.mix(frame(spark, rows), block=2).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(5001))
    assert Counter(r.source for r in got) == Counter(s for _, _, s in rows)
    first = [r.source for r in got if r.mix_phase == 0]
    weight = next(r.mix_weight for r in got if r.source == "hot")
    assert abs(weight - 2000 ** 0.5 / (2000 ** 0.5 + 1500 * 2 ** 0.5 + 1)) < 1e-9
    assert all(abs(first[:t].count("hot") / 2 - weight * t / 2) < 1 for t in range(2, len(first) + 1, 2))
