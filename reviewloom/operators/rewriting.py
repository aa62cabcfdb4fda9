"""Long lists of merge rules: one pass over the tokens, and rewriting of only the documents that rules can reach.

A rule replaces a run of tokens by another, leftmost first, and rules work one after the other, so a later one
sees what an earlier one made. Doing that rule by rule costs a pass per rule. Here a trie with failure links over
the runs of all rules finds, in one pass, the rules that a document holds. They are applied by number; after each
the trie looks only at the neighbourhood of what was replaced and adds the later rules that became possible there.

Defined results: null token lists stay null; a token that is null or holds nulls meets no rule; documents without a rule
keep their tokens as they are; other columns are passed on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import text as T
from reviewloom.runtime import bounded, durable

Pair = tuple[str, str]
Rule = tuple[Sequence[Pair], Sequence[Pair]]

# Code points that stand for tokens: one for all that no rule names, then one per token of the rules. The range
# of surrogates can't be written, so numbers step over it.
OTHER = 1
SURROGATES, AFTER_SURROGATES = 0xD800, 0xE000
MAX_TOKENS = 0x110000 - (AFTER_SURROGATES - SURROGATES) - OTHER - 1
# Tokens, in whole documents, that a task turns into code points at a time.
SLICE_TOKENS = 100_000


def _code_points(numbers: np.ndarray) -> np.ndarray:
    points = numbers + OTHER + 1
    return np.where(points >= SURROGATES, points + (AFTER_SURROGATES - SURROGATES), points).astype("<u4")


def _numbers(points: np.ndarray) -> np.ndarray:
    points = points.astype(np.int64)
    return np.where(points >= AFTER_SURROGATES, points - (AFTER_SURROGATES - SURROGATES), points) - OTHER - 1


class RunRules:
    """Merge rules as strings of one character per token, with their trie."""

    def __init__(self, rules: Sequence[Rule]):
        named = sorted({tuple(t) for before, after in rules for t in [*before, *after]})
        if len(named) > MAX_TOKENS:
            raise ValueError(f"rules name more than {MAX_TOKENS} tokens")
        self.tokens = named
        number = {t: i for i, t in enumerate(named)}

        def coded(pairs: Sequence[Pair]) -> str:
            return self.text(np.array([number[tuple(t)] for t in pairs], np.int64))
        self.before = [coded(b) for b, _ in rules]
        self.after = [coded(a) for _, a in rules]
        self.reach = max(map(len, self.before), default=1) - 1
        same: dict[str, list[int]] = {}
        for i, run in enumerate(self.before):
            same.setdefault(run, []).append(i)
        self.trie = ahocorasick.Automaton()
        for run, numbers in same.items():
            self.trie.add_word(run, numbers)
        self.trie.make_automaton()

    @staticmethod
    def text(numbers: np.ndarray) -> str:
        return _code_points(numbers).tobytes().decode("utf-32-le")

    def rewritten(self, doc: str) -> str:
        """The document after all rules, each applied once, in order."""
        due: list[int] = []
        known: set[int] = set()

        def look(piece: str, after: int) -> None:
            for _, numbers in self.trie.iter(piece):
                for i in numbers:
                    if i > after and i not in known:
                        known.add(i)
                        heapq.heappush(due, i)

        look(doc, -1)
        while due:
            i = heapq.heappop(due)
            before, after = self.before[i], self.after[i]
            parts = doc.split(before)
            if len(parts) == 1:
                continue
            doc = after.join(parts)
            # New runs hold a token that was put in, or two that were apart.
            at, first, last = 0, None, None
            for part in parts[:-1]:
                at += len(part)
                start, end = max(0, at - self.reach), at + len(after) + self.reach
                if last is not None and start <= last:
                    last = end
                else:
                    if last is not None:
                        look(doc[first:last], i)
                    first, last = start, end
                at += len(after)
            look(doc[first:last], i)
        return doc


def _merge_column(column: pa.Array, rules: RunRules, pool: pa.Array, names: pa.Array) -> pa.Array:
    """A list column of tokens, rewritten; every token of the result is taken from the column or from the rules."""
    flat = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lex, pos = flat.flatten()
    named = pc.binary_join_element_wise(lex.cast(pa.string()), pos.cast(pa.string()), "\u0001")
    found = pc.index_in(named, names, skip_nulls=True)
    numbers = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    text = RunRules.text(numbers)
    out, lengths = [], np.zeros(len(column), np.int64)
    for row, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
        start = end - size
        old = text[start:end]
        new = rules.rewritten(old)
        if new == old:
            places = np.arange(start, end)
        else:
            made = _numbers(np.frombuffer(new.encode("utf-32-le"), "<u4"))
            places = made + len(flat)
            # Tokens that no rule names are neither moved past one another nor removed.
            places[made < 0] = start + np.flatnonzero(numbers[start:end] < 0)
        out.append(places)
        lengths[row] = len(places)
    taken = np.concatenate(out) if out else np.zeros(0, np.int64)
    values = pa.concat_arrays([flat, pool]).take(pa.array(taken))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, type=column.type, mask=column.is_null())


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, number) of about SLICE_TOKENS tokens, so that memory doesn't follow their lengths."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    # A row takes some memory itself.
    number = np.cumsum(sizes + 10) // SLICE_TOKENS
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else number
    yield from zip(starts.tolist(), np.diff([*starts, len(column)]).tolist(), strict=True)


def merge_by_trie(docs: DataFrame, rules: Sequence[Rule], tokens: str = "tokens") -> DataFrame:
    """`merge_expr` for any number of rules, in one pass without a cut of the plan.

    Rules of one token are left out, as there. The list is bounded by its maker (`rules.MAX_RULES`) and sent to every
    executor once.
    """
    longer = [r for r in rules if len(r[0]) > 1]
    if not longer:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(longer)
    at = docs.columns.index(tokens)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ruled = RunRules(sent.value)
        names = pa.array([f"{lex}\u0001{pos}" for lex, pos in ruled.tokens], pa.string())
        for batch in batches:
            kind = batch.schema.field(at).type.value_type
            pool = pa.array([{"lex": lex, "pos": pos} for lex, pos in ruled.tokens], kind)
            for start, rows in _slices(batch.column(at)):
                piece = batch.slice(start, rows)
                columns = piece.columns
                columns[at] = _merge_column(columns[at], ruled, pool, names)
                yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    return docs.mapInArrow(run, docs.schema)


def token_postings(tagged: DataFrame, doc: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Inverted index of all tokens, one row (lex, pos, doc, n) per posting.

    Kept long: the posting list of a frequent token has no size bound.
    """
    return (tagged.select(doc, F.explode_outer(tokens).alias("t")).where("t IS NOT NULL")
            .groupBy(F.col("t.lex").alias("lex"), F.col("t.pos").alias("pos"), doc).agg(F.count("*").alias("n")))


def reached_documents(postings: DataFrame, rules: Sequence[Rule], doc: str = "doc_id", split: bool = True,
                      merge: bool = True) -> DataFrame:
    """Ids of the documents that the rules can change, each once.

    A document no rule has changed yet holds all tokens of the first rule that does, so the postings of the rarest
    token of every rule name all of them. A rule with a token that is nowhere has none. Split rules are met by the
    unknown tokens that contain their key.
    """
    spark = postings.sparkSession
    found = []
    longer = [(i, *t) for i, r in enumerate(rules) if len(r[0]) > 1 for t in sorted({tuple(p) for p in r[0]})]
    if merge and longer:
        wanted = spark.createDataFrame(longer, "rule_no int, lex string, pos string")
        named = bounded(wanted.select("lex", "pos").distinct(), len(longer))
        counts = postings.join(named, ["lex", "pos"], "left_semi").groupBy("lex", "pos").agg(F.count("*").alias("docs"))
        each = bounded(wanted, len(longer)).join(counts, ["lex", "pos"], "left")
        rarest = each.groupBy("rule_no").agg(
            F.min_by(F.struct("lex", "pos"), F.struct(F.coalesce("docs", F.lit(0)), "lex", "pos")).alias("t"),
            F.bool_and(F.col("docs").isNotNull()).alias("all"))
        chosen = durable(rarest.where("all").select("t.lex", "t.pos").distinct())
        found.append(postings.join(bounded(chosen, len(longer)), ["lex", "pos"], "left_semi"))
    keys = sorted({r[0][0][0] for r in rules if len(r[0]) == 1})
    if split and keys:
        unknown = postings.where(F.col("pos").isin(T.UNKNOWN_TAGS))
        # Distinct tokens first: a frequent one is cut into pieces once, not per posting.
        lexes = contained_keys(unknown.select("lex").distinct(), keys)
        found.append(unknown.join(lexes, "lex", "left_semi"))
    ids = [f.select(doc) for f in found]
    if not ids:
        return postings.select(doc).limit(0)
    return (ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])).distinct()


def contained_keys(lexes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows (lex) that contain one of the keys, by one walk of a trie with failure links per token."""
    sent = lexes.sparkSession.sparkContext.broadcast(list(keys))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ahocorasick.Automaton()
        for key in sent.value:
            if key:
                trie.add_word(key, True)
        every = "" in sent.value
        if len(trie):
            trie.make_automaton()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            held = [x is not None and (every or (len(trie) > 0 and next(trie.iter(x), None) is not None))
                    for x in texts]
            yield batch.filter(pa.array(held, pa.bool_()))

    return lexes.mapInArrow(run, lexes.schema)


def write_by_bucket(docs: DataFrame, path: str, doc: str = "doc_id", buckets: int = 256) -> None:
    """Store documents by a bucket of their id, so that a few of them can be read without the rest."""
    part = F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")
    docs.withColumn("_bucket", part).write.partitionBy("_bucket").parquet(path)


def read_reached(docs: DataFrame, reached: DataFrame, doc: str = "doc_id", buckets: int = 256) -> DataFrame:
    """Of documents stored by `write_by_bucket`, those in `reached`, reading only their buckets.

    The driver sees at most `buckets` numbers.
    """
    part = F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int").alias("b")
    wanted = [r["b"] for r in reached.select(part).distinct().collect()]
    return (docs.where(F.col("_bucket").isin(wanted)).join(reached.select(doc), doc, "left_semi")
            .select([c for c in docs.columns if c != "_bucket"]))
