"""Toxicity: Levenshtein automata over a lexicon trie, with context-window scores.

The lexicon is a trie of abusive words and word stems. It is learned from
labelled documents: a word or stem that stands far more often in toxic than in
clean texts, chosen so that each entry explains toxic texts no earlier entry
explains. Every token of every text is run through the product of the trie and
the Levenshtein automata of its entries, built lazily as one automaton, so a
misspelled term costs one dictionary step per character. Each hit is judged in
a window of tokens: between quotation marks, on a quoted line, or after a word
that reports speech it is quotation, else abuse. A logistic regression over the
counts of hits (sure, misspelled or unsure terms, quotation, densest window)
gives the score.

Fitting uses at most FIT_ROWS labelled documents with distinct texts, those of
smallest hash; scoring covers all documents and whole texts.

Defined results: null and empty texts have no hits and get the score of a text
without hits; with no labelled rows the lexicon is empty and every score is
0.5 or less; repeated rows get equal scores; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import crc_mod, query, slices, table
from reviewloom.runtime import durable

FIT_ROWS = 20_000
MIN_SUPPORT = 6
MAX_ENTRIES = 2_000
# How many times more often than among clean texts a sure or unsure term stands in toxic ones.
SURE_RATIO, UNSURE_RATIO, CHANCE_WEIGHT = 40, 8, 4
HIDDEN_SHARE = 0.02
STEM_LENGTHS = range(3, 8)
WINDOW = 12
CLIP = 5
THRESHOLD = 0.7

TOKEN = re.compile(r"\w+")

# Words that report what somebody said.
REPORTING = frozenset(
    "said says say wrote writes quoted quotes called calls word term phrase sagte schrieb nannte wort "
    "dit disait écrit appelé mot dijo escribió llamó palabra".split())
QUOTES = "\"“”„«»‘’"


def edits_allowed(length: int, stem: bool) -> int:
    """Misspellings a term may have after its first letter; short terms and stems have to be exact."""
    return 0 if stem or length < 5 else 1 if length < 9 else 2


class Lexicon:
    """Trie of terms, run against tokens within the edits each term allows.

    Entries that end in `*` are stems: a token matches if it starts with one.
    The first letter of a term has to be right.
    """

    MEMORY = 50_000

    def __init__(self, entries: list[str], fuzzy: bool = True):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[dict[bool, int]] = [{}]
        self.most: list[int] = [0]
        for entry in entries:
            stem, word = entry.endswith("*"), entry.rstrip("*")
            if not word:
                continue
            allowed = edits_allowed(len(word), stem) if fuzzy else 0
            node = 0
            for ch in word:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append({})
                    self.most.append(0)
                node = self.children[node][ch]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node][stem] = allowed
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.result: list[int | None] = []
        self.steps: list[dict[str, int]] = []
        self.known: dict[str, int | None] = {}
        self.start = self._state({(0, 0)}, None)

    def _state(self, positions: set, stem: int | None) -> int:
        """Number of the state with these (node, edits) positions, after skipped letters of terms."""
        best: dict[int, int] = {}
        todo = list(positions)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            if node:
                todo += [(child, e + 1) for child in self.children[node].values()]
        for node, e in best.items():
            if e <= self.ends[node].get(True, -1):
                stem = e if stem is None else min(stem, e)
        key = (frozenset(best.items()), stem)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            whole = [e for node, e in best.items() if e <= self.ends[node].get(False, -1)]
            self.result.append(min([*whole, *([stem] if stem is not None else [])], default=None))
        return self.states[key]

    def _step(self, state: int, ch: str) -> int:
        positions, stem = self.sets[state]
        after = set()
        for node, e in positions:
            child = self.children[node].get(ch)
            if child is not None:
                after.add((child, e))
            if node:
                after.add((node, e + 1))
                after.update((c, e + 1) for c in self.children[node].values())
        return self._state(after, stem)

    def edits(self, token: str) -> int | None:
        """Edits to the nearest term that allows so many, or None."""
        if token in self.known:
            return self.known[token]
        if len(self.known) >= self.MEMORY:
            self.known.clear()
        state = self.start
        for ch in token:
            to = self.steps[state].get(ch)
            if to is None:
                to = self.steps[state][ch] = self._step(state, ch)
            state = to
            if not self.sets[state][0]:
                break
        out = self.known[token] = self.result[state]
        return out


def quoted(text: str, start: int, tokens: list[str], i: int) -> bool:
    """Whether the token at `start` is quotation, by its window."""
    low, high = max(0, start - 120), start + 120
    line = text.rfind("\n", 0, start) + 1
    if text[line:line + 1] == ">":
        return True
    opened = sum(text.count(q, max(low, line), start) for q in QUOTES)
    stop = text.find("\n", start)
    closed = any(text.find(q, start, min(high, stop if stop >= 0 else high)) >= 0 for q in QUOTES)
    if opened % 2 and closed:
        return True
    return any(t in REPORTING for t in tokens[max(0, i - 3):i])


def features(text: str | None, lexicons: tuple[Lexicon, Lexicon]) -> list[int]:
    """Hits of sure terms, misspelled ones, hits of unsure terms, quotation, and hits in the densest window."""
    if not text:
        return [0] * 5
    text = text.lower()
    tokens = TOKEN.findall(text)
    hit = {}
    for t in set(tokens):
        for kind, lexicon in zip(("sure", "unsure"), lexicons, strict=True):
            e = lexicon.edits(t)
            if e is not None:
                hit[t] = 2 if kind == "unsure" else min(e, 1)
                break
    if not hit:
        return [0] * 5
    out, places = [0] * 5, []
    for i, m in enumerate(TOKEN.finditer(text)):
        kind = hit.get(m.group())
        if kind is None:
            continue
        if quoted(text, m.start(), tokens, i):
            out[3] += 1
        else:
            out[kind] += 1
            places.append(i)
    low = 0
    for k, i in enumerate(places):
        while places[low] <= i - WINDOW:
            low += 1
        out[4] = max(out[4], k - low + 1)
    return [min(CLIP, n) for n in out]


def _stems(text: str | None) -> set[str]:
    out = set()
    for w in set(TOKEN.findall((text or "").lower())):
        out.add(w)
        out.update(w[:k] + "*" for k in STEM_LENGTHS if len(w) > k)
    return out


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, where) -> DataFrame:
    """At most `rows` labelled documents (row_id, text, y) with distinct texts, by smallest hash."""
    chosen = (labels.where(where).where(F.col(label).isNotNull())
              .select(F.col("doc_id").alias("row_id"), F.col(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("row_id"), "row_id").limit(rows))
    text = docs.select(F.col("doc_id").alias("row_id"), "text")
    # At most `rows` rows of two numbers.
    return (text.join(F.broadcast(chosen), "row_id")
            .withColumn("_h", F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["_h"]).drop("_h"))


def _count_stems(sample: DataFrame, wanted: frozenset | None) -> DataFrame:
    """Texts per stem, added up inside each task."""
    def run(batches):
        n = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found = _stems(text)
                n.update(found if wanted is None else found & wanted)
            if len(n) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())],
                                                 names=["stem", "n"])
                n = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())],
                                         names=["stem", "n"])

    counts = sample.select("text").mapInArrow(run, "stem string, n long")
    return counts.groupBy("stem").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems (`stem*`) that tell toxic texts, sure and unsure ones.

    Entries are taken greedily, the one first that explains most toxic texts not
    explained yet, less those it would explain by chance. What reaches the
    driver is bounded by the sample.
    """
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return [], []
    toxic, clean = sample.where("y = 1"), sample.where("y = 0")
    often = {r["stem"]: r["n"] for r in
             _count_stems(toxic, None).where(F.col("n") >= MIN_SUPPORT).collect()}
    against = {r["stem"]: r["n"] for r in _count_stems(clean, frozenset(often)).collect()}
    # How many toxic texts an entry would stand in if it were as frequent there as in clean ones.
    share = sizes[1] / sizes[0]
    chance = {s: share * (against.get(s, 0) + 0.5) for s in often}
    telling = frozenset(s for s, n in often.items() if n >= UNSURE_RATIO * chance[s])

    def lists(batches):
        for batch in slices(batches):
            rows = [sorted(_stems(t) & telling) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["stems"])

    texts = [r["stems"] for r in toxic.select("text").mapInArrow(lists, "stems array<string>").collect()]
    holders: dict[str, set[int]] = {}
    for k, stems in enumerate(texts):
        for s in stems:
            holders.setdefault(s, set()).add(k)

    def worth(s: str, n: int) -> tuple:
        # Smallest first. Of equal entries a whole word is preferred, then the longest stem.
        return (CHANCE_WEIGHT * chance[s] - n, s.endswith("*"), -len(s))

    chosen, explained = [], set()
    # What an entry explains only shrinks, so a stale worth is an upper bound.
    queue = [(worth(s, len(h)), s, len(h)) for s, h in holders.items()]
    heapq.heapify(queue)
    while queue and len(chosen) < MAX_ENTRIES:
        _, s, n = heapq.heappop(queue)
        now = len(holders[s] - explained)
        if now < n:
            if now >= MIN_SUPPORT:
                heapq.heappush(queue, (worth(s, now), s, now))
            continue
        if now - CHANCE_WEIGHT * chance[s] < MIN_SUPPORT:
            continue
        chosen.append(s)
        explained |= holders[s]
    sure = [s for s in chosen if often[s] >= SURE_RATIO * chance[s]]
    unsure = [s for s in chosen if s not in sure]
    # Sure terms hidden by those above, as they stand in the same texts.
    covered = tuple(s[:-1] for s in sure if s.endswith("*"))
    floor = max(MIN_SUPPORT, HIDDEN_SHARE * len(texts))
    for s in sorted(holders, key=lambda s: (-len(holders[s]), not s.endswith("*"), -len(s), s)):
        bare = s.rstrip("*")
        if (len(holders[s]) < floor or often[s] < SURE_RATIO * chance[s] or len(sure) >= MAX_ENTRIES or s in sure
                or bare.startswith(covered or ("\0",))
                or s.endswith("*") and any(c.startswith(bare) for c in sure)):
            continue
        sure.append(s)
        covered += (bare,) if s.endswith("*") else ()
    return sure, unsure


def fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on rows with counts, by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty),
                               x.T @ (n * (y - p)) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


FEATURES = ["abuse", "misspelled", "unsure", "quotation", "densest"]


def with_features(rows: DataFrame, lexicon: tuple[list[str], list[str]], keep: list[str]) -> DataFrame:
    """Columns `keep` and the features of `text`."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        tries = Lexicon(lexicon[0]), Lexicon(lexicon[1], fuzzy=False)
        for batch in slices(batches):
            found = [features(t, tries) for t in batch.column(len(keep)).to_pylist()]
            columns = [pa.array([f[k] for f in found], pa.int32()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *columns], names=[*keep, *FEATURES])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keep], *[f"{f} int" for f in FEATURES]])
    return rows.select(*keep, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, train, rows: int = FIT_ROWS) -> tuple[tuple[list[str], list[str]], list[float]]:
    """Lexicon and weights from the labelled rows that `train` keeps."""
    sample = durable(sample_labelled(docs, labels, "toxic", rows, train))
    lexicon = learn_lexicon(sample)
    # At most (CLIP + 1)^5 kinds of rows per label, and no more than sampled rows.
    bins = (with_features(sample, lexicon, ["y"]).groupBy("y", *FEATURES).agg(F.count("*").alias("n"))
            .orderBy("y", *FEATURES).collect())
    if not bins:
        return lexicon, [0.0] * (len(FEATURES) + 1)
    x = np.array([[r[f] for f in FEATURES] for r in bins], dtype=float)
    w = fit_weights(x, np.array([r["y"] for r in bins], dtype=float), np.array([r["n"] for r in bins], dtype=float))
    return lexicon, [float(v) for v in w]


def score(docs: DataFrame, model: tuple[tuple[list[str], list[str]], list[float]]) -> DataFrame:
    """`doc_id`, `score` and the features of every document."""
    lexicon, weights = model
    found = with_features(docs.select("doc_id", "text"), lexicon, ["doc_id"])
    line = sum((F.col(f) * F.lit(w) for f, w in zip(FEATURES, weights, strict=False)), F.lit(weights[-1]))
    return found.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-line)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held_out = crc_mod("doc_id", 3) == 1
    scored = score(docs, fit(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
