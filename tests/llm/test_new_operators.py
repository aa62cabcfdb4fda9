"""Phrases, conversation repair and vector search against brute force and on odd inputs."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm import collocations, pruned_graph, turn_align, turn_repair, vector_search
from reviewloom.llm.common import table
from reviewloom.llm.queries import QUERIES
from tests.conftest import SMALL

ODD = "key string, a int, n int, h long, phrase string, row int, size int, c string, at int, place int, cells string"
ODD_ROW = ("x", 1, 2, 3, "y", 4, 5, "z", 6, 7, "w")


# Phrases

def phrases(rows, keep, least, drop):
    """Brute force: the first phrases of every language."""
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i:i + k])
                    counts[key] = counts.get(key, 0) + 1
    found = {}
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    for (lang, words), a in candidates.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((10 ** 6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        longer = [b for (other, w), b in candidates.items() if other == lang and len(w) > len(words)
                  and words in (w[:2], w[1:])]
        if not any(100 * b >= drop * a for b in longer):
            phrase = " ".join(words)
            found.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, left, right))
    return {(lang, rank, x[3], -x[1], x[4], x[5], sizes[lang], -x[0])
            for lang, all_of in found.items() for rank, x in enumerate(sorted(all_of)[:keep], 1)}


def random_texts(seed, n):
    rng = random.Random(seed)
    words = [f"{c}{d}" for c in "abcdefgé" for d in "xyz"] + ["The", "İ", " q", "\x00"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choices(words, weights, k=rng.randrange(0, 40)))
        for sign in (", ", ".", "\n", "\t", "  ", "\x0b"):
            text = text.replace(" ", sign, rng.randrange(3))
        rows.append((rng.choice(["en", "en", "en", "de", None, "a\tb"]), text))
    return rows + [("en", "fixed words here") for _ in range(12)] + [("en", None), (None, ""), ("fr", "one two")]


@pytest.mark.parametrize(("seed", "keep"), [(1, 2000), (2, 3), (3, 40)])
def test_phrases_equal_brute_force(spark, seed, keep):
    rows = random_texts(seed, 150)
    docs = spark.createDataFrame([(*r, *ODD_ROW) for r in rows], f"lang string, text string, {ODD}").repartition(5)
    got = collocations.collocations(docs, keep, 4, 50)
    assert {tuple(r) for r in got.collect()} == phrases(rows, keep, 4, 50)


def test_phrases_of_long_texts_and_small_blocks(spark, monkeypatch):
    rows = random_texts(4, 80)
    rows.append(("en", " ".join(t for _, t in rows if t) * 20))
    want = phrases(rows, 50, 4, 50)
    small = {"BLOCK": 7, "CHUNK": 50}
    for name, value in small.items():
        monkeypatch.setattr(collocations, name, value)
    ids = collocations._Ids()
    row = collocations._row_ids(rows[-1][1].encode(), ids)
    monkeypatch.undo()
    again = collocations._Ids()
    assert list(row) == list(collocations._row_ids(rows[-1][1].encode(), again)) and ids == again
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in collocations.collocations(docs, 50, 4, 50).collect()} == want


def test_thresholds_fall_until_all_are_settled(spark):
    """Pairs of the highest score are all dropped by longer phrases, so the first threshold settles nothing."""
    rows = [("en", f"p{k} q{k} r{k}") for k in range(30) for _ in range(10)]
    rows += [("en", f"u{k} v{k % 5}") for k in range(10) for _ in range(10)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for keep in (1, 20, 35, 39, 40, 100):
        assert {tuple(r) for r in collocations.collocations(docs, keep).collect()} == phrases(rows, keep, 10, 50)


def test_phrases_of_nothing(spark):
    for rows in ([], [(None, None), ("en", "  ,.")]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_scores_past_64_bits(spark):
    rows = spark.createDataFrame([(10 ** 13, 10 ** 13, 3 * 10 ** 13)], "a long, l long, r long")
    assert rows.select(collocations._score("a", "l", "r")).first()[0] == 333333


# Conversations

def least_audit(turns):
    """The least (cost, audit) by a walk over the places of the grammar."""
    best, after = {0: (0, "")}, {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}

    def put(into, place, value):
        into[place] = min(into.get(place, value), value)

    def insert():
        for _ in range(3):
            for p, (c, a) in list(best.items()):
                put(best, after[p][1], (c + 3, a + "I"))

    for t in turns:
        insert()
        new = {}
        for p, (c, a) in best.items():
            put(new, p, (c + 4, a + "D"))
            if t == "D":
                continue
            extra = 3 if t.isupper() else 0
            if p == 0 and t in "sS":
                put(new, 1, (c + extra, a + "K"))
            letter, to = after[p]
            put(new, to, (c + extra + (0 if t.lower() == letter else 3), a + ("K" if t.lower() == letter else "R")))
        best = new
    insert()
    return min(best[p] for p in (0, 3) if p in best)


def test_alignment_equals_brute_force():
    rng = random.Random(3)
    every = [p for k in range(4) for p in itertools.product("suaxSUAD", repeat=k)]
    for t in map("".join, [*every, *(rng.choices("suaxuaSUAXD", k=rng.randrange(5, 40)) for _ in range(500))]):
        assert turn_align.whole(turn_align.align(t, (0,), (0, 3))) == least_audit(t)
        cut = rng.randrange(len(t)) if t else 0
        halves = [turn_align.align(x, turn_repair.PLACES, turn_repair.PLACES) for x in (t[:cut], t[cut:])]
        assert turn_align.whole(turn_align.join(*halves)) == least_audit(t)


def repaired(turns):
    """Brute force of a conversation: (turn, role, text) to counts, audit and repaired lines."""
    space = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in turns]
    import hashlib
    rows = sorted(space, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, letters, counts = set(), "", Counter()
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" \
            else ""
        seen.add((role, text))
        counts[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        letters += "D" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    cost, audit = least_audit(letters)
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    out, left, shift = [], iter(rows), (len(audit) - audit.count("D")) % 2
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)[1:]
        if edit != "D":
            wanted = "assistant" if (len(out) - shift) % 2 else "user"
            out.append(f"{role if edit == 'K' else wanted}:{text}")
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)


def random_turns(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "what?", "cut", "", " \x0b\n", "é. ", None, "long " * 2000 + "."]
    return [(rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(50)}.") for _ in range(n)]


@pytest.mark.parametrize(("segment", "fan"), [(256, 64), (3, 2)])
def test_repair_equals_brute_force(spark, monkeypatch, segment, fan):
    talks = {k: random_turns(k, n) for k, n in enumerate([1, 2, 3, 5, 8, 13, 40, 60])} | {None: random_turns(99, 6)}
    rows = [(k, *t, *ODD_ROW) for k, turns in talks.items() for t in turns]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, {ODD}").repartition(7)
    every = frame.unionByName(frame.limit(1).selectExpr("1000L AS conv_id", *frame.columns[1:]))
    audits = turn_repair.audits
    monkeypatch.setattr(turn_repair, "audits", lambda turns: audits(turns, segment, fan))
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(every, frame).collect()}
    assert got == {k: repaired(t) for k, t in talks.items()} | {1000: repaired([])}


def test_repaired_turns_follow_the_grammar(spark):
    talks = table(spark, SMALL, "conversations")
    turns = turn_repair.turns_of(turn_repair.damaged(talks))
    rows = turn_repair.repaired_turns(turns, turn_repair.audits(turns)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.place):
        by.setdefault(r.c, []).append(r.role[0])
    assert by and all(re.fullmatch("s?(ua)+", "".join(v)) for v in by.values())


def test_repair_of_an_empty_table(spark):
    empty = table(spark, SMALL, "conversations").limit(0)
    assert turn_repair.repair(empty, turn_repair.damaged(empty)).count() == 0


# Vectors

def nearest(vectors, k):
    """Brute force: (id, score) of the k nearest rows of every row, by its place."""
    out = []
    for i, (_, v) in enumerate(vectors):
        scores = []
        for j, (name, w) in enumerate(vectors):
            if i != j and len(v) == len(w):
                total = 0.0
                for x, y in zip(v, w):
                    total += x * y
                scores.append((-total, name is None, name or 0))
        out.append([(None if none else name, -s) for s, none, name in sorted(scores)[:k]])
    return out


def test_vectors_with_copies_nulls_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6)) * rng.uniform(0.1, 3, size=(40, 1))
    rows = [(int(i), base[i % 40].tolist()) for i in rng.permutation(200)]
    rows += [(None, base[0].tolist()), (7, [1e3] * 6), (300, [0.5, 1.0]), (301, [2.0, 0.5]), (302, [1.0])]
    unusable = [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
                (404, [float("nan")] * 6), (405, [float("inf")] + [0.0] * 5)]
    frame = spark.createDataFrame([(*r, *ODD_ROW) for r in rows + unusable],
                                  f"vec_id long, embedding array<double>, {ODD}").repartition(3)
    vectors = vector_search.numbered_vectors(frame)
    assert vectors.count() == len(rows)
    index = vector_search.build_index(vectors, k=5, shard_rows=60)
    asked = vectors.where("id IS NOT NULL")
    got = {}
    for r in vector_search.search(index, asked, k=5, query_rows=70).orderBy("rank").collect():
        got.setdefault((r.query_id, r.query_row), []).append((r.id, r.score))
    want = Counter((name, tuple(near)) for (name, _), near in zip(rows, nearest(rows, 5)) if name is not None and near)
    assert Counter((name, tuple(near)) for (name, _), near in got.items()) == want


def test_recall_of_one_graph():
    rng = np.random.default_rng(2)
    for vectors in (rng.normal(size=(3000, 48)), rng.normal(size=(3000, 16)) * rng.uniform(0.2, 5, size=(3000, 1))):
        points = pruned_graph.lifted(vectors)
        edges, start = pruned_graph.build(points)
        asked = rng.normal(size=(100, vectors.shape[1]))
        lifted = np.column_stack([asked, np.zeros(100)]).astype(np.float32)
        nodes, _, _ = pruned_graph.beam_search(points, edges, start, lifted, vector_search.BEAM)
        true = np.argsort(-(asked @ vectors.T), axis=1)[:, :20]
        assert sum(len(set(a) & set(b)) for a, b in zip(nodes[:, :20], true)) >= 0.95 * true.size


def test_vector_query_against_brute_force(spark):
    larger = SMALL.replace("sf0.001", "sf0.01")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table(spark, larger, "embeddings").collect()]
    want = {name: near for (name, _), near in zip(rows, nearest(rows, 20)) if name % 20 == 0}
    got = {}
    for r in QUERIES["op13_vector_graph"](spark, larger).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    assert sum(len(set(got[k]) & set(want[k])) for k in want) >= 0.98 * sum(map(len, want.values()))


def test_vectors_of_an_empty_table(spark):
    vectors = vector_search.numbered_vectors(table(spark, SMALL, "embeddings").limit(0))
    assert vector_search.search(vector_search.build_index(vectors), vectors).count() == 0
