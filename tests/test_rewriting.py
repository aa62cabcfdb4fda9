"""Long lists of merge rules and rewriting through the inverted index, against rule by rule."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from reviewloom.operators import rewriting, rules, vocab

TOKENS = "array<struct<lex:string,pos:string>>"


def one_by_one(doc, made):
    """Every rule over the whole document, leftmost first, without looking again at what it made."""
    for before, after in made:
        out, i = [], 0
        while i < len(doc):
            if doc[i:i + len(before)] == before:
                out += after
                i += len(before)
            else:
                out.append(doc[i])
                i += 1
        doc = out
    return doc


def cases(seed, n_rules, n_docs, words):
    """Rules that feed, undo and repeat one another; some make nothing or their own run again."""
    rng = random.Random(seed)

    def run(least, most):
        return [(rng.choice(words), rng.choice("xy")) for _ in range(rng.randint(least, most))]
    made = [(run(2, 4), run(0, 3)) for _ in range(n_rules)]
    made += [made[0], (made[1][0], made[1][0] + made[1][0])]
    docs = [run(0, 60) for _ in range(n_docs)]
    return made, docs


def frame(spark, docs):
    return spark.createDataFrame([(i, "kept", d) for i, d in enumerate(docs)],
                                 f"doc_id long, tokens_ string, tokens {TOKENS}")


def lists(df):
    return {r["doc_id"]: None if r["tokens"] is None else [(t["lex"], t["pos"]) for t in r["tokens"]]
            for r in df.collect()}


def test_trie_equals_rule_by_rule():
    for seed in range(40):
        made, docs = cases(seed, 30, 20, "abcd")
        ruled = rewriting.RunRules(made)
        number = {t: i for i, t in enumerate(ruled.tokens)}
        for doc in docs:
            doc = [t for t in doc if t in number]
            got = ruled.rewritten(ruled.text(np.array([number[t] for t in doc], np.int64)))
            back = rewriting._numbers(np.frombuffer(got.encode("utf-32-le"), "<u4"))
            assert [ruled.tokens[i] for i in back] == one_by_one(doc, made)


def test_five_thousand_rules_in_one_pass(spark):
    words = [f"w{i}" for i in range(40)]
    made, docs = cases(1, 5000, 60, words)
    # Tokens of no rule, null lists and tokens stay where they are.
    docs = [[*d[:3], ("unheard", "z"), *d[3:], ("of", "z")] for d in docs] + [[], None]
    got = lists(rules.apply_rules(frame(spark, docs), made))
    assert got == {i: None if d is None else one_by_one(d, made) for i, d in enumerate(docs)}
    few = made[:30]
    assert lists(rewriting.merge_by_trie(frame(spark, docs[:-1]), few)) == lists(
        rules.apply_rules(frame(spark, docs[:-1]), few))
    assert rewriting.merge_by_trie(frame(spark, []), made).count() == 0


def test_tokens_with_nulls_meet_no_rule(spark):
    docs = frame(spark, [[("a", "x"), (None, "x"), None, ("b", "y"), ("a", "x"), ("b", "y")]])
    merged = rewriting.merge_by_trie(docs, [([("a", "x"), ("b", "y")], [("c", "z")])])
    got = [t and tuple(t) for t in merged.first()["tokens"]]
    assert got == [("a", "x"), (None, "x"), None, ("b", "y"), ("c", "z")]


def test_code_points_step_over_surrogates():
    numbers = np.array([-1, 0, 0xD7FD, 0xD7FE, 0xD7FF, rewriting.MAX_TOKENS - 1])
    text = rewriting.RunRules.text(numbers)
    assert len(set(text)) == len(numbers)
    assert (rewriting._numbers(np.frombuffer(text.encode("utf-32-le"), "<u4")) == numbers).all()


def test_only_reached_documents_are_rewritten(spark, tmp_path):
    rng = random.Random(3)
    docs = [[(f"w{rng.randint(0, 400)}", "NNG") for _ in range(20)] for _ in range(300)]
    docs[7] = [("xkeyx", "NA"), ("w1", "NNG")]
    docs[8] = [("xkeyx", "NNG")]
    # The second rule lives on what the first makes; the third has a token that is nowhere.
    a, b = docs[11][4], docs[11][5]
    made = [([a, b], [("made", "n")]), ([("made", "n"), docs[11][6]], [("twice", "n")]),
            ([("nowhere", "n"), ("w2", "NNG")], []), ([("key", "NA")], [("K", "NNG")])]
    all_docs = frame(spark, docs)
    postings = rewriting.token_postings(all_docs)
    whole, before = lists(rules.apply_rules(all_docs, made)), lists(all_docs)
    changed = {i for i in whole if whole[i] != before[i]}
    assert {7, 11} <= changed and 8 not in changed
    path = str(tmp_path / "docs")
    rewriting.write_by_bucket(all_docs, path, buckets=64)
    stored = spark.read.parquet(path)
    for got in (rules.rewrite_reached(all_docs, postings, made),
                rules.rewrite_reached(stored, postings, made, buckets=64)):
        assert got.columns == all_docs.columns
        found = lists(got)
        assert changed <= set(found) and len(found) < 30
        assert found == {i: whole[i] for i in found}
    # The scan is cut to the buckets of the reached documents.
    reached = rewriting.reached_documents(postings, made)
    some = rewriting.read_reached(stored, reached, buckets=64)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket#" in plan.replace("isnotnull(", "") and " IN " in plan
    assert lists(rules.rewrite_reached(all_docs, postings, [])) == {}


def test_contained_keys(spark):
    lexes = spark.createDataFrame([("abc",), ("zz",), (None,), ("",)], "lex string")
    assert [r[0] for r in rewriting.contained_keys(lexes, ["bc", "q"]).collect()] == ["abc"]
    assert [r[0] for r in rewriting.contained_keys(lexes, [""]).orderBy("lex").collect()] == ["", "abc", "zz"]


def test_tags_by_places_equal_tags_by_join(spark):
    texts = [(1, "a b b c. d2 e"), (2, "a f f er, a"), (2, "g b 3 über g h"), (3, None), (4, " "), (None, "f i j"),
             (None, "j k! c"), (5, "l l"), (6, "m n"), (7, "n " * 3), (8, "ü a é é"), (9, "o o o")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    joined = vocab.tag_documents(docs, vocab.tagged_counts(docs))
    placed = vocab.tag_by_corpus(vocab.with_rare(docs))
    assert placed.columns == joined.columns
    assert lists(placed) == lists(joined) and placed.count() == joined.count() == 8
    # One null id alone: its rare tokens are told from those of the other documents.
    one = docs.where("doc_id IS NOT NULL OR text LIKE 'f%'")
    assert lists(vocab.tag_by_corpus(vocab.with_rare(one))) == lists(vocab.tag_documents(one, vocab.tagged_counts(one)))


def test_slices_hold_tokens_not_documents(monkeypatch):
    monkeypatch.setattr(rewriting, "SLICE_TOKENS", 100)
    column = pa.array([[{"lex": "a", "pos": "x"}] * n for n in [1, 500, 0, 5, 300, 7, 8]] + [None])
    slices = list(rewriting._slices(column))
    assert sum(n for _, n in slices) == 8 and len(slices) >= 3
    assert all(sum(len(x or []) for x in column.slice(a, n).to_pylist()) < 600 for a, n in slices)
    assert list(rewriting._slices(column.slice(0, 0))) == []


def test_untouched_documents_stay(spark):
    docs = [[("tion", "NA"), ("x", "NNG")], [("a", "x"), ("b", "y"), ("a", "x")], [("q", "NA")], [], None]
    made = [([("tion", "NA")], [("t", "NNG")]), ([("a", "x"), ("b", "y")], [("c", "z")])]
    got = lists(rules.apply_rules(frame(spark, docs), made))
    assert got == {0: [("t", "NNG"), ("x", "NNG")], 1: [("c", "z"), ("a", "x")], 2: [("q", "NA")], 3: [], 4: None}
