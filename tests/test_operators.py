"""DataFrame jobs on hand-made cases and against brute force."""

from __future__ import annotations

import random
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.functions import text as T
from reviewloom.operators import bayes, cooc, ordering, rules, tables, vocab, weights
from reviewloom.runtime import by_document, hot_keys, salted_join

TOKENS = "array<struct<lex:string,pos:string>>"


def tagged(spark, *docs):
    return spark.createDataFrame(list(enumerate(docs)), f"doc_id long, tokens {TOKENS}")


def token_lists(df):
    return [[(t["lex"], t["pos"]) for t in r["tokens"]]
            for r in df.orderBy("doc_id").collect()]


MERGE = ([("A", "x"), ("B", "y")], [("AB", "n")])


def test_merge_rule(spark):
    docs = tagged(spark, [("A", "x"), ("B", "y"), ("A", "x"), ("B", "y"), ("C", "z")],
                  [("A", "x"), ("C", "z"), ("B", "y")], [])
    got = token_lists(rules.apply_rules(docs, [MERGE]))
    assert got == [[("AB", "n"), ("AB", "n"), ("C", "z")],
                   [("A", "x"), ("C", "z"), ("B", "y")], []]


def test_merge_result_is_not_scanned_again(spark):
    rule = ([("A", "x"), ("B", "y")], [("C", "z"), ("A", "x"), ("B", "y")])
    got = token_lists(rules.apply_rules(tagged(spark, [("A", "x"), ("B", "y")]), [rule]))
    assert got == [[("C", "z"), ("A", "x"), ("B", "y")]]


SPLIT = [([("업뎃", "NA")], [("업데이트", "NNG")]), ([("뎃좀", "NA")], [("X", "NNG")])]


def split_cases(spark):
    return tagged(spark, [("빨리업뎃좀", "NA"), ("업뎃", "NNG")], [("업뎃업뎃", "UNKNOWN")],
                  [("앱", "NNG")], [])


SPLIT_WANT = [[("빨리", "NA"), ("업데이트", "NNG"), ("좀", "NA"), ("업뎃", "NNG")],
              [("업데이트", "NNG"), ("업데이트", "NNG")], [("앱", "NNG")], []]


def test_split_rule_keeps_the_text_around_and_first_rule_wins(spark):
    assert token_lists(rules.apply_rules(split_cases(spark), SPLIT)) == SPLIT_WANT


def test_split_rules_by_table_give_the_same(spark):
    got = rules.split_by_table(split_cases(spark), SPLIT, "doc_id", "tokens", T.tag_by_script)
    assert token_lists(got) == SPLIT_WANT


def test_many_rules_go_through_both_long_ways(spark):
    many = [([(f"k{i}.", "NA")], [("S", "NNG")]) for i in range(120)]
    many += [([(f"m{i}", "x"), ("B", "y")], [(f"m{i}B", "n")]) for i in range(120)]
    docs = tagged(spark, [("ak119.", "NA"), ("m0", "x"), ("B", "y"), ("m119", "x"), ("B", "y")])
    assert token_lists(rules.apply_rules(docs, many)) == [
        [("a", "SL"), ("S", "NNG"), ("m0B", "n"), ("m119B", "n")]]


def test_rules_without_a_match_change_nothing(spark):
    docs = tagged(spark, [("q", "NA"), ("r", "SL")])
    assert token_lists(rules.apply_rules(docs, [*SPLIT, MERGE])) == token_lists(docs)


@pytest.mark.parametrize("line,before,after", [
    ("업뎃\tNA\t>>\t업데이트\tNNG", [("업뎃", "NA")], [("업데이트", "NNG")]),
    ("a\tNA\tb\t>>\tc\tNNG", [("a", "NA")], [("c", "NNG")]),
    ("a\tN\tb\tV\t>>\tc\tN\td\tV\n", [("a", "N"), ("b", "V")], [("c", "N"), ("d", "V")]),
])
def test_rule_line(spark, line, before, after):
    got = spark.createDataFrame([(line,)], "l string").select(
        rules.parse_rule("l").alias("r")).first()["r"]
    assert [tuple(t) for t in got["before"]] == before
    assert [tuple(t) for t in got["after"]] == after


def test_rule_store(spark, tmp_path):
    path = str(tmp_path / "rules")
    mapping = spark.createDataFrame(
        [("업뎃", [("업데이트", "NNG")]), ("강추", [("강력", "NNG"), ("추천", "NNG")])],
        f"lex string, after {TOKENS}")
    made = rules.rules_of_mapping(mapping, "lex", "after")
    rules.write_rules(made, path)
    stored = rules.read_rules(spark, path)
    assert len(rules.collect_rules(stored)) == 2
    twice = made.union(made)
    assert rules.new_rules(stored, twice).count() == 0
    assert rules.refused_rules(stored, made).count() == 2
    other = rules.rules_of_mapping(mapping.limit(1), "lex", "after", "UNKNOWN")
    fresh = rules.new_rules(stored, other.union(other))
    assert fresh.count() == 1
    rules.write_rules(fresh, path)
    assert rules.read_rules(spark, path).count() == 3


def test_rule_matches_against_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 8))) for _ in range(200)}
    keys = ["a", "bc", "cab", "zz"]
    counts = spark.createDataFrame([(w, 1) for w in words], "lex string, n long")
    got = {(r["key"], r["lex"]) for r in rules.rule_matches(counts, keys).collect()}
    assert got == {(k, w) for w in words for k in keys if k in w}


def hot_table(spark, n=3000):
    """One group holds a third of the rows."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"g{rng.randint(0, 40)}", i, rng.choice("ab"))
            for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, i long, v string").repartition(7)


def test_global_and_group_index_with_a_hot_group(spark):
    rows, df = hot_table(spark)
    got = {r["i"]: r["at"] for r in ordering.global_index(df, [F.col("i").desc()], "at").collect()}
    assert got == {i: len(rows) - 1 - i for i in range(len(rows))}
    want, seen = {}, Counter()
    for g, i, _ in sorted(rows, key=lambda r: r[1]):
        want[i] = seen[g]
        seen[g] += 1
    got = {r["i"]: r["at"] for r in ordering.group_index(df, "g", [F.col("i")], "at").collect()}
    assert got == want


def test_runs_with_a_hot_group(spark):
    rows, df = hot_table(spark)
    want = set()
    for g, part in groupby(sorted(rows), key=lambda r: r[0]):
        for v, run in groupby(list(part), key=lambda r: r[2]):
            run = list(run)
            want.add((g, run[0][1], v, len(run)))
    got = {tuple(r) for r in ordering.runs(df, "g", "i", "v").collect()}
    assert got == want


@pytest.mark.parametrize("n,k", [(10, 3), (2, 5), (40, 40), (101, 7)])
def test_chunks_cover_all_rows(spark, n, k):
    got = ordering.chunks(spark.range(n), [F.col("id")], k).collect()
    sizes = Counter(r["chunk"] for r in got)
    assert sum(sizes.values()) == n and max(sizes.values()) - min(sizes.values()) <= 1
    order = [r["chunk"] for r in sorted(got, key=lambda r: r["id"])]
    assert order == sorted(order) and order[0] == 1


def test_long_head_equals_short_head(spark, monkeypatch):
    rows, df = hot_table(spark, 400)
    short = ordering.number_head(df, [F.col("i").desc()], 37).orderBy("rank").collect()
    monkeypatch.setattr(ordering, "HEAD_ROWS", 5)
    long = ordering.number_head(df, [F.col("i").desc()], 37).orderBy("rank").collect()
    assert [tuple(r) for r in long] == [tuple(r) for r in short] and len(long) == 37
    assert {r["i"] for r in ordering.head(df, [F.col("i")], 9).collect()} == set(range(9))


def test_salted_join_keeps_every_row(spark):
    rows, df = hot_table(spark)
    right = df.groupBy("g").agg(F.count("*").alias("n"))
    hot = hot_keys(right, "g", "n")
    assert "hot" in {r["g"] for r in hot.collect()}
    joined = salted_join(df, right, "g", hot, "i")
    assert joined.count() == len(rows)
    part = right.where("g <> 'hot'")
    assert salted_join(df, part, "g", hot, "i", "left").where("n IS NULL").count() == sum(
        g == "hot" for g, _, _ in rows)


def test_per_app_docs_keeps_single_reviews(spark):
    df = spark.createDataFrame(
        [("1", 0, ["a"], "5", "n1"), ("2", 300, ["c"], "1", "n2"), ("2", 2, ["b"], "3", "n2")],
        "app string, seq long, t array<string>, rating string, name string")
    got = tables.per_app_docs(df, "app", "seq", "t", "name", rating="rating").orderBy(
        "app", "part").collect()
    assert [(r["app"], r["part"], r["tokens"], r["rating"], r["name"]) for r in got] == [
        ("1", 0, ["a"], ["5"], "n1"), ("2", 0, ["b"], ["3"], "n2"), ("2", 1, ["c"], ["1"], "n2")]


def test_distinct_counts_null_once(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "v string")
    assert tables.distinct_with_null(df, "v").first()["n"] == 3


def tf_of(spark, docs):
    rows = [(i, w, n) for i, d in enumerate(docs) for w, n in Counter(d.split()).items()]
    return spark.createDataFrame(rows, "doc_id long, term string, n long")


def test_idf_values(spark):
    tf = tf_of(spark, ["a b", "a", "a"])
    got = {r["term"]: round(r["idf"], 6)
           for r in weights.idf_table(tf, F.lit(3)).collect()}
    assert got == {"a": 1.0, "b": 1.693147}


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("norm,power", [("l2", 2), ("l1", 1)])
def test_norms_are_one(spark, grouped, norm, power):
    tf = tf_of(spark, ["a b b c", "a", "c c d"])
    got = weights.tfidf(tf, F.lit(3), "doc_id", norm=norm, grouped=grouped).groupBy("doc_id").agg(
        F.sum(F.pow("weight", F.lit(power))).alias("x")).collect()
    assert len(got) == 3 and all(abs(r["x"] - 1) < 1e-9 for r in got)


def test_contrast(spark):
    five = spark.createDataFrame([("a", 9), ("b", 8), ("z", 1)], "term string, cnt long")
    one = spark.createDataFrame([("b", 9), ("c", 8)], "term string, cnt long")
    got = [tuple(r) for r in weights.contrast(five, one, 2).collect()]
    assert got == [(1, "a", 9, "c", 8)]
    assert weights.overlap(five, one, [2]).first()["shared"] == 1


def test_dictionary_shapes(spark):
    counts = spark.createDataFrame(
        [("좋", "VA", 3), ("앱", "NNG", 5), ("앱", "NNP", 1)], "lex string, pos string, n long")
    got = [tuple(r) for r in vocab.dictionary(counts, ["VA", "NNG"]).orderBy("idx").collect()]
    assert got == [("앱/NNG", 5, 0), ("좋다/VA", 3, 1)]
    every = vocab.dictionary(counts, max_words=None).orderBy("idx").collect()
    assert [r["idx"] for r in every] == [0, 1, 2]
    nested = {r["lex"]: r["counts"] for r in vocab.nested_counts(counts).collect()}
    assert nested["앱"] == {"NNG": 5, "NNP": 1}
    cloud = {r["lex"]: r["cnt"] for r in vocab.word_cloud(vocab.term_counts(counts)).collect()}
    assert cloud["앱"] == 6


def test_filter_by_vocab_keeps_order_and_drops_empty(spark):
    docs = spark.createDataFrame([(0, ["b", "a", "q", "b"]), (1, ["q"])],
                                 "doc_id long, tokens array<string>")
    voc = spark.createDataFrame([("a", 1), ("b", 2)], "term string, cnt long")
    kept = vocab.filter_by_vocab(docs, voc)
    assert vocab.filter_by_vocab(docs, voc, max_words=None).collect() == kept.collect()
    assert [tuple(r) for r in kept.collect()] == [(0, ["b", "a", "b"])]
    assert [r["doc_id"] for r in vocab.docs_emptied(docs, kept).collect()] == [1]


def test_unknown_index(spark):
    docs = tagged(spark, [("x", "NA"), ("x", "NA"), ("a", "NNG")], [("x", "UNKNOWN")])
    index = vocab.unknown_index(docs)
    assert {tuple(r) for r in index.collect()} == {("x", 0, 2), ("x", 1, 1)}
    assert tuple(vocab.unknown_words(index).first()) == ("x", 3, 2)


def test_cooccurrence(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "a b c"), (2, "c")], "doc_id long, text string")
    got = {(r["term_i"], r["term_j"]): r["n"] for r in cooc.cooccurrence(docs, 10).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}


def test_blocked_pairs_equal_whole(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, sorted(rng.sample(range(30), rng.randint(0, 12)))) for i in range(200)]
    found = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(5)
    want = Counter()
    for _, ids in rows:
        want.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1:])

    def counted():
        return {(r["i"], r["j"]): r["n"] for r in cooc.pair_counts(found, 30).collect()}
    assert counted() == want
    monkeypatch.setattr(cooc, "BLOCK", 7)
    assert counted() == want


def test_distance_is_one_minus_correlation(spark, monkeypatch):
    monkeypatch.setattr(cooc, "ROWS", 4)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.sample("abcdefghij", 4))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    voc = cooc.top_vocabulary(df, 10)
    edges = cooc.cooccurrence(df, 10)
    got = {(r["term_i"], r["term_j"]): r["distance"]
           for r in cooc.correlation_distance(edges, voc, 10).collect()}
    at = {w: k for k, w in enumerate("abcdefghij")}
    m = np.zeros((10, 10))
    for r in edges.collect():
        m[at[r["term_i"]], at[r["term_j"]]] = m[at[r["term_j"]], at[r["term_i"]]] = r["n"]
    c = np.corrcoef(m)
    assert len(got) == 45
    assert all(abs(d - (1 - c[at[a], at[b]])) < 1e-9 for (a, b), d in got.items())


def test_forest_of_random_graphs(spark):
    rng = random.Random(4)
    edges = {(a, b): rng.randint(1, 5) for a, b in
             (sorted(rng.sample(range(40), 2)) for _ in range(70))}
    df = spark.createDataFrame([(str(a), str(b), w) for (a, b), w in edges.items()],
                               "s string, d string, w long")
    got = cooc.spanning_forest(df, "s", "d", "w").collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    want = set()
    for w, a, b in sorted((w, str(a), str(b)) for (a, b), w in edges.items()):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.add((a, b, w))
    assert {tuple(r) for r in got} == want


def test_bayes_matches_brute_force(spark):
    docs = ["good fine good", "fine nice", "bad poor bad", "poor slow", "good slow", "zzz"]
    y = [1, 1, 0, 0, 1, 0]
    tf = tf_of(spark, docs)
    known = spark.createDataFrame(list(enumerate(y)), "doc_id long, y int")
    train = tf.join(known, "doc_id").where("doc_id < 4")
    model = bayes.fit(train, known.where("doc_id < 4"), "doc_id", "y")
    got = {r["doc_id"]: (r["pred"], r["score"]) for r in bayes.predict(
        model, tf.where("doc_id >= 4"), known.where("doc_id >= 4"), "doc_id", "y").collect()}

    words = sorted({w for d in docs[:4] for w in d.split()})
    df = {w: sum(w in d.split() for d in docs[:4]) for w in words}

    def vec(d):
        x = np.array([d.split().count(w) * (np.log(5 / (df[w] + 1)) + 1) for w in words])
        return x / np.linalg.norm(x) if x.any() else x
    x = np.array([vec(d) for d in docs])
    want = {}
    for i in (4, 5):
        scores = []
        for c in (0, 1):
            s = sum(x[k] for k in range(4) if y[k] == c) + 1
            scores.append(np.log(0.5) + x[i] @ np.log(s / s.sum()))
        want[i] = (int(np.argmax(np.round(scores, 6))), max(scores))
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-6 for i in want)


def test_confusion_covers_the_grid(spark):
    pred = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 2)], "y int, pred int")
    got = {(r["y"], r["pred"]): (r["n"], r["share"]) for r in
           bayes.confusion(pred, "y").collect()}
    assert len(got) == 9 and got[(1, 1)] == (1, 0.5) and got[(3, 3)] == (0, 0.0)
    for y in (1, 2, 3):
        assert abs(sum(s for (a, _), (_, s) in got.items() if a == y) - 1) < 1e-9
    report = {r["class"]: r for r in bayes.class_report(pred, "y").collect()}
    assert report["3"]["precision"] == 0.0 and report["1"]["recall"] == 0.5
    assert abs(report["macro avg"]["recall"] - 0.5) < 1e-9
    assert report["weighted avg"]["support"] == 4


def test_folds_cover_all_rows(spark):
    folds = Counter(r["f"] for r in spark.range(300).select(
        ordering.fold_of("id", 3).alias("f")).collect())
    assert set(folds) == {0, 1, 2} and sum(folds.values()) == 300


def test_in_test_takes_any_id(spark):
    ids = [0, 1, 7, 10**12, 2**33, 2**62, -5]
    got = {r["id"]: r["te"] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(
        "id", ordering.in_test("id").alias("te")).collect()}
    assert got == {i: i * 2654435761 % 2**32 % 100 < 25 for i in ids}


def test_apps_are_split_in_numeric_order(spark):
    rows = [(f"src{k}", j) for k in (1, 2, 3, 10, 20) for j in range(k)]
    got = ordering.split_by_app(spark.createDataFrame(rows, "app string, j int"), "app").collect()
    assert len(got) == 36
    assert {r["app"] for r in got if r["part"] == "test"} == {"src20"}


def test_long_head_cuts_ties_in_order(spark):
    rows = spark.createDataFrame([(f"t{i:05d}", 1) for i in range(3000)], "term string, n int")
    got = ordering.head(rows, [F.col("n").desc(), F.col("term")], 1500).collect()
    assert sorted(r["term"] for r in got) == [f"t{i:05d}" for i in range(1500)]


def test_count_heads_equal_sorting(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"t{k}", rng.choice([1, 1, 1, 2, 3, 500, k])) for k in range(400)]
    df = spark.createDataFrame([*rows, ("none", None)], "term string, n long").repartition(6)
    want = [t for t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    monkeypatch.setattr(ordering, "HEAD_ROWS", 5)
    for limit in (10 ** 6, 50):
        monkeypatch.setattr(ordering, "NUMBERED_ROWS", limit)
        for n in (3, 60, 250, 399, 400, 1000):
            got = ordering.count_head(df, "n", ["term"], n).orderBy("rank").collect()
            assert [r["term"] for r in got] == want[:n]
            assert [r["rank"] for r in got] == list(range(1, min(n, 400) + 1))
    assert ordering.count_head(df.limit(0), "n", ["term"], 60).count() == 0
    # What is sorted is what reaches the last count.
    assert ordering.reaching(df, "n", 60).count() < 100


def test_hot_key_is_split_by_document(spark):
    """A word that always stands first in its document still gets many pieces."""
    from reviewloom import runtime
    left = spark.createDataFrame([(i, 0, "From") for i in range(2000)], "doc int, seq int, lex string")
    counts = spark.createDataFrame([("From", 2000)], "lex string, n long")
    hot = runtime.hot_keys(counts, "lex", "n")
    assert hot.first()["_pieces"] == runtime.HOT_SHARE
    right = spark.createDataFrame([("From", "x")], "lex string, pos string")
    got = runtime.salted_join(left, right, "lex", hot, ["doc", "seq"])
    assert got.count() == 2000 and got.where("pos = 'x'").count() == 2000


def test_rule_routes_agree(spark):
    """100 rules go by expression, 101 by table, with equal results."""
    docs = spark.createDataFrame(
        [(i, [(f"xk{i % 120}y", "NA"), ("b", "NNG")]) for i in range(240)],
        "doc_id long, tokens array<struct<lex:string,pos:string>>")
    made = [([(f"k{i}y", "NA")], [(f"K{i}", "NNG")]) for i in range(101)]
    a = {r["doc_id"]: r["tokens"] for r in rules.apply_rules(docs, made[:100]).collect()}
    b = {r["doc_id"]: r["tokens"] for r in rules.apply_rules(docs, made).collect()}
    assert {i for i in a if a[i] != b[i]} == {100, 220}


def test_vectoriser_options(spark):
    from reviewloom.operators.features import TfIdf
    docs = spark.createDataFrame([(["a", "b", "a"],), (["b", "c"],)], "tokens array<string>")
    counts = TfIdf(vectoriser="count").fit(docs)
    first = counts.transform(docs).first()["features"]
    assert first[counts.vocabulary.index("a")] == 2.0
    pairs = TfIdf(ngrams=2, maxFeatures=None, sublinear=True, norm="l1").fit(docs)
    assert set(pairs.vocabulary) == {"a", "b", "c", "a b", "b a", "b c"}
    v = pairs.transform(docs).first()["features"]
    idf = {"a": np.log(3 / 2) + 1, "b": 1.0, "a b": np.log(3 / 2) + 1, "b a": np.log(3 / 2) + 1}
    raw = {t: (1 + np.log(2 if t == "a" else 1)) * w for t, w in idf.items()}
    for t, x in raw.items():
        assert abs(v[pairs.vocabulary.index(t)] - x / sum(raw.values())) < 1e-9


def test_terms_of_documents_dealt_by_id_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i % 5 if i % 6 else None, f"a b{i % 3} a") for i in range(40)], "doc_id long, text string")
    dealt = vocab.bag_of_words(by_document(docs))
    # Read before it runs, as a plan that ran shows what it was at first, too.
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert sorted(map(str, dealt.collect())) == sorted(map(str, vocab.bag_of_words(docs).collect()))
