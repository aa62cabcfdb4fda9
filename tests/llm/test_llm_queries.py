"""Registered queries against DuckDB or brute force, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from reviewloom.llm import decontaminate, queries, secrets
from reviewloom.llm.common import table
from tests.conftest import SMALL
from tests.llm.test_pairs import brute
from tests.llm.test_texts import base_spans


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    want = duck.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    left = Counter(tuple(r[c] for c in columns) for r in got.collect())
    assert left == Counter(want.fetchall())


def test_all_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())


def test_secret_query_equals_expressions(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    for r in queries.QUERIES["op5_secrets"](spark, SMALL).collect():
        spans = base_spans(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in spans) for k in secrets.BASE]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(("name", "label", "least"), [("op4_toxicity", "toxic", 0.9), ("op6_quality", "quality", 0.9)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    """On the next larger table: the smallest has too few labels to learn a lexicon from."""
    larger = SMALL.replace("sf0.001", "sf0.01")
    known = {r.doc_id: r[label] for r in table(spark, larger, "labels").collect()}
    got = [r for r in queries.QUERIES[name](spark, larger).collect() if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in got) / len(got) >= least


def test_leak_query_finds_whole_items(spark):
    items = {r.item_id: b" ".join(decontaminate.tokens(r.text)) for r in table(spark, SMALL, "benchmark").collect()}
    docs = {r.doc_id: b" %s " % b" ".join(decontaminate.tokens(r.text)) for r in table(spark, SMALL, "documents").collect()}
    whole = {(d, i) for d, t in docs.items() for i, w in items.items() if b" %s " % w in t}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op10_decontamination"](spark, SMALL).collect()}
    assert whole and whole <= got and len(got - whole) <= len(whole) // 10


def test_shards_and_mix_hold_all_rows(spark):
    n = table(spark, SMALL, "documents").count()
    placed = queries.QUERIES["op8_sharding"](spark, SMALL).collect()
    sizes = Counter(r.shard for r in placed)
    assert sum(sizes.values()) == n and max(sizes.values()) - min(sizes.values()) <= 1
    mixed = queries.QUERIES["op2_mixing"](spark, SMALL).collect()
    assert sorted(r.mix_position for r in mixed) == list(range(n))


def test_chat_query_keeps_all_messages(spark):
    rows = Counter((r.conv_id, r.turn) for r in table(spark, SMALL, "conversations").collect())
    got = queries.QUERIES["op9_chat_format"](spark, SMALL).collect()
    assert Counter((r.conv_id, r.turn) for r in got) == rows
    assert not any(line.startswith(">") for r in got for line in r.text.split("\n"))


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, kept[-1], SMALL).write.parquet(path)
        kept.append(spark.read.parquet(path))
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in kept]
    assert all(d.columns == columns for d in kept[:-1])
    toxic = {r.doc_id for r in queries.QUERIES["op4_toxicity"](spark, SMALL).collect() if r.predicted}
    assert sorted(ids[1]) == sorted(set(ids[0]) - toxic)
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = brute([(i, texts[i]) for i in ids[1]], 5, 80)
    assert sorted(ids[2]) == sorted(i for i in ids[1] if groups[i][1] == i)
    leaks = {r.doc_id for r in queries.QUERIES["op10_decontamination"](spark, SMALL).collect()}
    assert sorted(ids[3]) == sorted(set(ids[2]) - leaks)
    assert sorted(ids[4]) == sorted(ids[5]) == sorted(ids[3])
    sizes = Counter(r.shard for r in kept[5].collect())
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    again = corpus_pipeline.run(spark, SMALL)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, kept[5].collect()))


def test_the_mix_reaches_the_rows_of_the_pipeline(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    docs, mix = table(spark, SMALL, "documents"), corpus_pipeline.mix
    sources = sorted({r.source for r in docs.select("source").collect()}, key=str)
    slots = []
    for weights in (None, {s: 1.0 + 9 * (k % 2) for k, s in enumerate(sources)}):
        def weighted(rows, weights=weights):
            return mix(rows, weights=weights)

        monkeypatch.setattr(corpus_pipeline, "mix", weighted)
        place = {r.doc_id: r.mix_position for r in weighted(docs).collect()}
        shards = {}
        for r in corpus_pipeline.run(spark, SMALL).orderBy("slot").collect():
            shards.setdefault(r.shard, []).append((r.slot, r.doc_id))
        for rows in shards.values():
            assert [slot for slot, _ in rows] == list(range(len(rows)))
            assert [place[i] for _, i in rows] == sorted(place[i] for _, i in rows)
        slots.append({(s, *row) for s, rows in shards.items() for row in rows})
    assert slots[0] != slots[1]
    # Documents that aren't stored yet keep their order too.
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    placed = corpus_pipeline.shard(spark, spark.createDataFrame(rows, docs.schema), SMALL)
    by = {}
    for r in placed.orderBy("slot").collect():
        by.setdefault(r.shard, []).append(r.doc_id)
    assert all(ids == sorted(ids, reverse=True) for ids in by.values())


def test_pipeline_of_an_empty_table(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
