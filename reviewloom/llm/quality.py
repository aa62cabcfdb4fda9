"""Quality classifier: Bradley-Terry ranking from preference pairs, cut at a score quantile.

A document's strength is a linear score over bins of surface features. Labelled
documents give preference pairs (a good one beats a bad one); the weights come
from logistic loss on the difference of the two feature vectors. Scores are cut
at the quantile that equals the share of bad ones among the labelled documents,
and mapped to (0, 1) so that the cut falls on THRESHOLD.

Fitting uses at most FIT_ROWS labelled documents, those of smallest hash, whose
features (a few numbers each) come to the driver; scoring covers all documents
and whole texts.

Defined results: null and empty texts have the features of an empty text and
get a score; with labels of one class only every score is the same; repeated
rows get equal scores; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import crc_mod, query, slices, table

FIT_ROWS = 20_000
PAIRS_PER_ROW = 4
BINS = 8
THRESHOLD = 0.3

# Frequent function words.
STOPWORDS = frozenset(
    w.encode() for w in
    "the of and to a in is it that was for on are as with be by this from at an or der die und in den von zu das mit "
    "sich des auf für ist im dem nicht ein eine als de la le et les des en un du une que est pour qui dans par sur "
    "el los del se las por con no su al lo como más o".split())

FEATURES = ["log_words", "word_length", "upper", "symbols", "digits", "exclaims", "bars", "stops", "sentence_ends",
            "top_word", "distinct_words", "repeated_trigrams", "repeated_lines", "line_length", "entropy", "nonletters",
            "decorated", "non_ascii", "capitalised", "stopwords"]

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_HIGH = _BYTES >= 128
_PLAIN = np.isin(_BYTES, list(b".,;:'\"?!-()"))
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH | _PLAIN)


def features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    ink = max(1, int(count.sum() - count[_SPACE].sum()))
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
    lines = [x for x in data.split(b"\n") if x.strip()]
    freq: dict[bytes, int] = {}
    for w in words:
        freq[w] = freq.get(w, 0) + 1
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False)))
    p = count[count > 0] / count.sum()
    last = [w[-1] for w in words]
    return [
        float(np.log1p(n)),
        ink / n,
        float(count[_UPPER].sum()) / letters,
        float(count[_SYMBOL].sum()) / ink,
        float(count[_DIGIT].sum()) / ink,
        float(count[33]) / n,
        float(count[124]) / n,
        float(count[46]) / n,
        sum(b in b".!?" for b in last) / n,
        max(freq.values()) / n,
        len(freq) / n ** 0.9,
        1 - trigrams / max(1, n - 2),
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        float(-(p * np.log2(p)).sum()),
        1 - (letters + float(count[_HIGH].sum())) / ink,
        sum(b in b"*#$%&|!=_~^<>" for b in last) / n,
        float(count[_HIGH].sum()) / ink,
        sum(65 <= w[0] <= 90 for w in words) / n,
        sum(freq.get(s, 0) for s in STOPWORDS) / n,
    ]


def with_features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` and the feature vector of `text`."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for batch in slices(batches):
            found = [features(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "f"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keep], "f array<double>"])
    return rows.select(*keep, "text").mapInArrow(run, schema)


class Ranking:
    """Bin edges, weights, cut and slope of a fitted ranking."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, cut: float, slope: float):
        self.edges, self.weights, self.cut, self.slope = edges, weights, cut, slope

    def vectors(self, f: np.ndarray) -> np.ndarray:
        return bins_of(f, self.edges)

    def score(self, f: np.ndarray) -> np.ndarray:
        strength = self.vectors(f) @ self.weights
        x = self.slope * (strength - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def bins_of(f: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One-hot bins of every feature, and the features cut to [0, 1] between their outer edges."""
    parts = []
    for k, e in enumerate(edges):
        at = np.searchsorted(e, f[:, k], side="right")
        parts.append(np.eye(len(e) + 1)[at])
        if len(e) > 1 and e[-1] > e[0]:
            parts.append(np.clip((f[:, k] - e[0]) / (e[-1] - e[0]), -1, 2)[:, None])
    return np.hstack(parts) if parts else np.zeros((len(f), 0))


def preference_pairs(y: np.ndarray, per_row: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (better, worse): each row of the rarer class meets `per_row` or more of the other.

    Each row of the more frequent class is in a pair at least once.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(0, int), np.zeros(0, int)
    n = max(len(good), len(bad), per_row * min(len(good), len(bad)))
    k = np.arange(n)
    # The second index moves on after each round, so pairs don't repeat at once.
    turn = k // max(len(good), len(bad))
    return good[(k + (turn if len(good) < len(bad) else 0)) % len(good)], bad[
        (k + (turn if len(bad) <= len(good) else 0)) % len(bad)]


def fit_ranking(f: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Ranking:
    """Weights by logistic loss on feature differences (Newton steps), cut and slope."""
    if not len(f):
        return Ranking([], np.zeros(0), 0.0, 0.0)
    low = f[y == 0] if (y == 0).any() else f
    # Edges from both classes, as the rarer one would hardly move common quantiles.
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.concatenate([np.quantile(f[:, k], q), np.quantile(low[:, k], q)]))
             for k in range(f.shape[1])]
    x = bins_of(f, edges)
    better, worse = preference_pairs(y, PAIRS_PER_ROW)
    if not len(better):
        return Ranking(edges, np.zeros(x.shape[1]), 0.0, 0.0)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        gradient, hessian = -ridge * w, np.eye(len(w)) * ridge
        for at in range(0, len(better), 10_000):
            d = x[better[at:at + 10_000]] - x[worse[at:at + 10_000]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gradient = gradient + d.T @ (1 - p)
            hessian = hessian + (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    strength = x @ w
    cut = quantile_cut(strength, float((y == 0).mean()))
    spread = float(np.std(strength)) or 1.0
    return Ranking(edges, w, cut, 4.0 / spread)


def quantile_cut(strength: np.ndarray, share: float) -> float:
    """Midway between the last score below the quantile and the first above it."""
    s = np.sort(strength)
    k = min(max(int(round(share * len(s))), 1), len(s) - 1) if len(s) > 1 else 0
    return float((s[k - 1] + s[k]) / 2) if len(s) > 1 else float(s[0])


def fit(docs: DataFrame, labels: DataFrame, train, rows: int = FIT_ROWS) -> Ranking:
    chosen = (labels.where(train).where(F.col("quality").isNotNull())
              .select("doc_id", F.col("quality").cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # At most `rows` rows of two numbers.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = with_features(sample, ["doc_id", "y"]).orderBy("doc_id", "y").collect()
    if not got:
        return fit_ranking(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit_ranking(np.array([r["f"] for r in got]), np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """`doc_id` and `score` of every document."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            found = [features(t) for t in batch.column(1).to_pylist()]
            s = model.score(np.array(found)) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held_out = crc_mod("doc_id", 5) == 0
    scored = score(docs, fit(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op6_quality")
def op6_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
