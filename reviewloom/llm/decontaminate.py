"""Benchmark decontamination: n-gram seeds, lossless score bounds, Smith-Waterman alignment.

The item is leaked if its best local alignment with the text reaches a share of
the item's best score, or is as long as LONG words and nearly exact; replaced,
left-out and added words are tolerated. No such alignment is lost on the way to
it. One with M matched words in R runs has R - 1 errors at least, so its score
is at most M + P + 1, where P = M - R counts the matched neighbours. Where the
score is more than the item's words and one, the text holds two neighbours of
the item, and all its 2-grams are seeds, however frequent they are. Items that
reach a sum of M + P + 1 over the whole text are looked for in it: the stretches
of the text whose words and neighbours can add up to the score are aligned. Of
very long items (89 words) the single words are the seeds.

Items of up to SHORT words reach the share by two or three stock words, so they
also have to share a run of WORDS words with the text.

The seed index is made of blocks of items, of bounded size each, which go to
the tasks one block at a time; a larger benchmark makes more blocks and more
passes, never a larger broadcast. Texts are not shuffled.

Defined results: null and empty texts and items leak nothing; items of fewer
words than WORDS are looked for as a whole; repeated rows and items are reported
one by one; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import ngram_hashes, query, slices, table, word_hashes
from reviewloom.runtime import durable

WORDS = 3
SHORT = 10
PART = 1 << 15
BLOCK_ITEMS = 5_000
BLOCK_WORDS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
SHARE = 0.55
LONG, LONG_SHARE = 50, 0.9

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters and digits, ASCII-lower-cased, as UTF-8."""
    return TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())


def seed_words(item_words: int) -> int:
    """Length of the runs of words of which a leaked text holds at least one."""
    if item_words <= SHORT:
        return min(item_words, WORDS)
    return 2 if least_score(item_words) > item_words + 1 else 1


def least_score(item_words: int) -> float:
    """Score from which an item is leaked."""
    return min(SHARE * MATCH * item_words, LONG_SHARE * MATCH * LONG)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at `starts`, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


def _places(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted number in a sorted array, or the array's length if it isn't there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return np.where(known[at] == wanted, at, len(known))


def _lowest_before(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[max(0, j - width):j + 1] for every j, from minima inside blocks."""
    width += 1
    big = np.iinfo(x.dtype).max
    padded = np.concatenate([np.full(width - 1, big), x, np.full(-(len(x) + width - 1) % width, big)])
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:len(x)], ahead[width - 1:width - 1 + len(x)])


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score and the range of `text` it covers.

    Rows of the table are filled as vectors: a gap in the item costs the same
    per word, so its best start is a running maximum.
    """
    n = len(text)
    at = np.arange(n + 1)
    score = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(text == word, MATCH, MISMATCH)
        skipped = score[1:] + GAP
        down = np.maximum(diagonal, skipped)
        source = np.where(diagonal >= skipped, start[:-1], start[1:])
        base = np.concatenate([[0], np.maximum(down, 0)])
        source = np.concatenate([[0], np.where(down > 0, source, at[1:])])
        # The last word of `text` from which going on by gaps is best.
        lifted = base - GAP * at
        peak = np.maximum.accumulate(lifted)
        origin = np.maximum.accumulate(np.where(lifted == peak, at, 0))
        score = peak + GAP * at
        start = source[origin]
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), k)
    return best


def leaked(score: int, item_words: int) -> bool:
    return score >= least_score(item_words)


class Index:
    """Words and seeds of a block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.sizes = np.array([len(w) for w in self.words])
        self.least = np.array([least_score(m) for m in self.sizes])
        # Errors cost one each, so no leaked text is spread wider.
        self.span = self.sizes + (MATCH * self.sizes - self.least).astype(np.int64)
        lengths = np.array([seed_words(m) for m in self.sizes])
        self.pairs = (self.sizes > SHORT) & (lengths == 2)
        # Seeds a leaked text holds at least.
        self.need = np.where(self.pairs, np.ceil(self.least - self.sizes - 1),
                             np.where(self.sizes > SHORT, np.ceil(self.least / MATCH), 1))
        self.vocabulary, self.flat = np.unique(np.concatenate(self.words), return_inverse=True)
        self.first = np.cumsum(self.sizes) - self.sizes
        # By length of the seeds: the seeds, the first entry of each, and the item of each entry.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(lengths).tolist():
            some = np.flatnonzero(lengths == n)
            grams = [ngram_hashes(self.words[k], n) for k in some]
            seeds, place = np.unique(np.concatenate(grams), return_inverse=True)
            holders = np.repeat(some, [len(g) for g in grams])
            counts = np.bincount(place, minlength=len(seeds))
            self.seeds[n] = seeds, np.concatenate([[0], np.cumsum(counts)]), holders[np.argsort(place, kind="stable")]

    def candidates(self, words: np.ndarray, at: np.ndarray) -> Iterator[int]:
        """Items the whole text has seeds and words enough for."""
        here = np.zeros(len(self.vocabulary) + 1, bool)
        here[at] = True
        for n, (seeds, first, holders) in self.seeds.items():
            found = np.unique(_places(seeds, ngram_hashes(words, n)))
            found = found[found < len(seeds)]
            if not len(found):
                continue
            shared = np.bincount(holders[_ranges(first[found], first[found + 1] - first[found])],
                                 minlength=len(self.sizes))
            some = np.flatnonzero(shared >= self.need)
            if not len(some):
                continue
            sizes = self.sizes[some]
            matched = np.add.reduceat(here[self.flat[_ranges(self.first[some], sizes)]].astype(np.int64),
                                      np.cumsum(sizes) - sizes)
            most = np.where(self.pairs[some], np.minimum(matched + shared[some] + 1, MATCH * matched),
                            MATCH * matched)
            yield from some[most >= self.least[some]].tolist()

    def stretches(self, k: int, at: np.ndarray) -> list[tuple[int, int]]:
        """Parts of the text that hold every alignment that leaks item k.

        A word of the item counts as a match, any other as an error; of two
        matched neighbours that are no neighbours in the item something is left
        out between them.
        """
        span, least = int(self.span[k]), self.least[k]
        mask = np.zeros(len(self.vocabulary) + 1, bool)
        own = self.flat[self.first[k]:self.first[k] + self.sizes[k]].astype(np.int64)
        mask[own] = True
        inside = mask[at]
        gain = np.where(inside, MATCH, MISMATCH)
        wide = len(self.vocabulary) + 1
        neighbours = np.unique(own[:-1] * wide + own[1:])
        apart = _places(neighbours, at[:-1] * wide + at[1:]) == len(neighbours)
        gain[1:] -= inside[1:] & inside[:-1] & apart
        total = np.concatenate([[0], np.cumsum(gain)])
        # One more, as an alignment doesn't pay for what lies before its first word.
        ends = np.flatnonzero(total - _lowest_before(total, span) + 1 >= least)
        out: list[tuple[int, int]] = []
        for cut in np.split(ends, np.flatnonzero(np.diff(ends) >= span) + 1) if len(ends) else []:
            low, high = max(0, int(cut[0]) - span), int(cut[-1])
            # A long stretch is aligned in parts that overlap by the widest alignment.
            part = max(PART, 4 * span)
            while high - low > part:
                out.append((low, low + part))
                low += part - span
            out.append((low, high))
        return out

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, score, first word, end) of every leaked item, at its best place."""
        words = word_hashes(tokens(text))
        at = _places(self.vocabulary, words)
        found = []
        for k in self.candidates(words, at):
            best = (0, 0, 0)
            for low, high in self.stretches(k, at):
                score, a, b = align(self.words[k], words[low:high])
                if score > best[0]:
                    best = (score, low + a, low + b)
            if leaked(best[0], len(self.words[k])):
                found.append((k, *best))
        return sorted(found)


def _blocks(items: Iterable[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items cut into blocks of bounded number and length; one block is held at a time."""
    block: list = []
    size = 0
    for item in items:
        if block and (len(block) >= BLOCK_ITEMS or size + len(item[1]) > BLOCK_WORDS):
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    if block:
        yield block


def _block_leaks(texts: DataFrame, items: list[tuple[int, np.ndarray]], id_type: str) -> DataFrame:
    """Leaks of one block of items: one pass over the texts."""
    def run(batches):
        index = Index(items)
        for batch in slices(batches):
            docs, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = index.leaks(text)
                docs += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, batch.schema.field(0).type),
                 pa.array([index.ids[f[0]] for f in found], pa.int64()),
                 pa.array([f[1] / (MATCH * len(index.words[f[0]])) for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())],
                names=["doc_id", "item_id", "share", "first_word", "end_word"])

    return texts.mapInArrow(
        run, f"doc_id {id_type}, item_id long, share double, first_word int, end_word int")


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and leaked item, with the share of the item's best score and the words covered."""
    texts = docs.select("doc_id", "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    # Items come to the driver row by row; only the word hashes of one block are kept.
    rows = items.select(F.col("item_id").cast("long"), "text").orderBy("item_id").toLocalIterator()
    own = ((r["item_id"], word_hashes(tokens(r["text"]))) for r in rows)
    done, last = [], None
    for block in _blocks(x for x in own if len(x[1])):
        if last is not None:
            done.append(durable(last))
        last = _block_leaks(texts, block, id_type)
    if last is None:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {id_type}, item_id long, share double, first_word int, end_word int")
    for part in done:
        last = last.unionByName(part)
    return last


@query("op10_decontamination")
def op10_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
