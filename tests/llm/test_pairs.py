"""N-gram join, exact dedup and components against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import exact_dedup, ngram_join
from reviewloom.llm.components import components

DOCS = "doc_id long, text string, row_id string, n int, k int, component string, digest string, body string, size int"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z", "b", 3) for i, t in rows], DOCS)


def classes(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = classes(links, sets)
    return {i: (len(sets[i]), root[i]) for i in sets}


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"v{rng.randrange(10 ** 6)}"
    return " ".join(out)


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for size in (7, 9, 12, 18, 30, 60, 200):
        for _ in range(3):
            base = [f"w{rng.randrange(400)}" for _ in range(size)]
            for _ in range(6):
                texts.append(edited(rng, base, rng.randrange(0, 1 + size // 30)))
            texts.append(" ".join(base[:-1]))
            texts.append(" ".join([*base, "tail"]))
    # A group of near copies of one text, many of them linked only through others.
    base = [f"g{i}" for i in range(120)]
    texts += [edited(rng, base, rng.randrange(1, 5)) for _ in range(60)]
    # A passage that many unlike texts share.
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(60)) for _ in range(30)]
    texts += ["one", "one", "one two", "ONE two", "a b c d", "A b  c\td", "a b c d e", "", " \n", None, "x " * 5000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 512), (5, 80, 8), (3, 60, 16)])
def test_join_is_exact(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(n)
    got = ngram_join.ngram_join(frame(spark, rows), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, percent)


def test_join_without_light_sets_or_without_heavy_ones(spark, monkeypatch):
    rows = [(i, t) for i, t in corpus(9) if t and len(t.split()) < 20]
    want = brute(rows, 4, 85)
    for most in (0, 18):
        monkeypatch.setattr(ngram_join, "boundary_by_cost", lambda sizes, how, most=most: most)
        got = ngram_join.ngram_join(frame(spark, rows)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_boundary_follows_cost():
    how = ngram_join.Jaccard(4, 85)
    assert ngram_join.boundary_by_cost({}, how) == ngram_join.LIGHT_MOST
    b = ngram_join.boundary_by_cost({n: 100 for n in range(1, 60)}, how)
    assert 6 <= b < 30


def test_join_edge_cases(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (3, None)]
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id) == [
        (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)]
    pairs += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    ids = {x for p in pairs for x in p}
    got = components(spark.createDataFrame(pairs, "a long, b long"), "bigint").collect()
    want = {i: c for i, c in classes(pairs, ids).items() if any(i in p and p[0] != p[1] for p in pairs)}
    assert {r.row_id: r.component for r in got} == want


def dedup_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(b.encode()).hexdigest())
                  for b, g in groups.items() for _, i in g)


def dedup_rows():
    rng = random.Random(3)
    texts = ["same text here"] * 60 + ["same  text\there"] * 5 + ["é ä 𝄞", "éä𝄞", None, "", " \n", "long " * 3000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(200)]
    rng.shuffle(texts)
    return [(i - 20, t) for i, t in enumerate(texts)] + [(2 ** 62, "far"), (-2 ** 62, "far")]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda body: F.length(body).cast("string").cast("binary")])
def test_exact_groups(spark, digest):
    """A digest as weak as the length makes different texts collide; the groups stay right."""
    rows = dedup_rows()
    got = exact_dedup.exact_groups(frame(spark, rows).repartition(5), digest=digest)
    want = [r[:4] for r in dedup_brute(rows)]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want


def test_exact_groups_edge_cases(spark):
    got = exact_dedup.exact_groups(frame(spark, [(None, "a"), (5, "a"), (5, "a"), (None, "b")])).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == [
        (5, 5, 3, True), (5, 5, 3, True), (None, 5, 3, False), (None, None, 1, True)]
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
