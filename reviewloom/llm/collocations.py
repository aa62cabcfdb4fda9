"""Phrase collocation mining: phrases of two or three words that stick together, best first.

A phrase of count a is scored by its weakest cut, floor(10^6 a^2 / (l r)), l and r being the counts of the two parts.
Words are counted first, then all pairs of words that are frequent enough. The pairs are the frontier of the growth to
three words: a phrase that starts with a pair of count p and first word of count f scores at most 10^6 p / f, since its
own count and that of its rest bound each other; the pair at its end bounds it in the same way. Pairs are expanded best
bound first, down to a threshold per language. All phrases that reach the threshold, and all longer phrases that could
drop them, are then known. A language is settled when its wanted number of surviving phrases, ties included, reach its
threshold; for the others the threshold falls and growth goes on.

Tasks count inside pieces of texts before the shuffle. What is worth counting next is told to them by bitmaps of a fixed
size over hashes of words and pairs: a false hit costs a row that a later join removes, so bitmaps change no result.
All sums and scores are exact (38-digit decimals; right up to counts of 10^15).

Defined results: null and empty texts and texts without words count nothing; a null language is `und`, together with
texts that say so themselves; texts of any length are read in blocks, whole; repeated rows all count; equal scores go by
count, then by the bytes of the phrase; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import query, slices, table
from reviewloom.operators.ordering import top_n
from reviewloom.runtime import bounded, durable, hot_keys, salted_join, spread

LEAST_COUNT = 10
KEEP = 2000
DROP_PERCENT = 50

# Letters to fold, characters that end a piece, and the blank beside the space.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" b".,;:!?\x0a\x0b\x0c\x0d" b"\t",
                       b"abcdefghijklmnopqrstuvwxyz" b"\n\n\n\n\n\n\n\n\n\n" b" ")

# Bytes of a text split at once, words counted before a task gives its counts away, rows of an Arrow batch.
BLOCK, CHUNK, OUT_ROWS = 1 << 20, 1 << 22, 50_000
NOTHING, BREAK, FIRST_WORD = 0, 1, 2

# Bits of a bitmap, and of the part of it that one row holds.
BITS, ROW_BITS = 1 << 26, 1 << 15
SEED = 42  # Spark's seed of xxhash64


class _Ids(dict):
    """Numbers of words in the order they come up."""

    def __init__(self):
        super().__init__({b"": NOTHING, b"\n": BREAK})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _row_ids(data: bytes, ids: _Ids) -> np.ndarray:
    """Numbers of the words of a text; pieces and the text end in BREAK."""
    data = data.translate(FOLD).replace(b"\n", b" \n ")
    parts, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        words = data[at:end].split(b" ")
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        at = end
    row = np.concatenate([*parts, [BREAK]])
    return row[row != NOTHING]


def _chunks(batches) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Language, words by number, and the words of many texts as one row of numbers."""
    ids, rows, size = _Ids(), {}, 0

    def flush():
        words = np.array([*ids, None], dtype=object)[:-1]
        for lang, parts in rows.items():
            yield lang, words, np.concatenate(parts)

    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = _row_ids(text, ids)
            rows.setdefault(lang, []).append(row)
            size += len(row)
            if size >= CHUNK:
                yield from flush()
                ids, rows, size = _Ids(), {}, 0
    yield from flush()


def _batches(keys: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64())], names=["key", "n"])
    for at in range(0, out.num_rows, OUT_ROWS):
        yield out.slice(at, OUT_ROWS)


def _count_words(batches):
    """Counts of words, and of all words of a language under the empty phrase."""
    for lang, words, row in _chunks(batches):
        seen, counts = np.unique(row[row >= FIRST_WORD], return_counts=True)
        keys = [lang + b"\t", *[lang + b"\t" + w for w in words[seen]]]
        yield from _batches(pa.array(keys, pa.binary()), np.append([counts.sum()], counts))


def _hashes(lang: bytes, words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of every word of the row, by number."""
    out = np.zeros(len(words), np.uint64)
    for i in np.unique(row[row >= FIRST_WORD]):
        out[i] = xxhash.xxh64_intdigest(lang + b"\t" + words[i], SEED)
    return out


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(BITS - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a << np.uint64(1)) | (a >> np.uint64(63))) ^ b


def _pair_counter(frequent):
    """Counts of pairs of words that the bitmap has."""
    def run(batches):
        for lang, words, row in _chunks(batches):
            known = (row >= FIRST_WORD) & _has(frequent.value, _hashes(lang, words, row))[row]
            both = known[:-1] & known[1:]
            pairs, counts = np.unique((row[:-1][both] << 32) | row[1:][both], return_counts=True)
            a, b = _binary(words, pairs >> 32, lang), _binary(words, pairs & 0xFFFFFFFF)
            yield from _batches(pc.binary_join_element_wise(a, b, b" "), counts)
    return run


def _triple_counter(maps):
    """Counts of triples that may reach the threshold or drop a pair that does."""
    def run(batches):
        starts, ends, reaching = maps.value
        for lang, words, row in _chunks(batches):
            word, hashes = row >= FIRST_WORD, _hashes(lang, words, row)[row]
            pair = word[:-1] & word[1:]
            at = _pair_hash(hashes[:-1], hashes[1:])
            first, last, high = (pair & _has(m, at) for m in (starts, ends, reaching))
            wanted = pair[:-1] & pair[1:] & ((first[:-1] & last[1:]) | high[:-1] | high[1:])
            at = np.flatnonzero(wanted)
            pairs, inverse = np.unique((row[at] << 32) | row[at + 1], return_inverse=True)
            triples, counts = np.unique((inverse.astype(np.int64) << 32) | row[at + 2], return_counts=True)
            a, b = pairs[triples >> 32] >> 32, pairs[triples >> 32] & 0xFFFFFFFF
            keys = pc.binary_join_element_wise(
                _binary(words, a, lang), _binary(words, b), _binary(words, triples & 0xFFFFFFFF), b" ")
            yield from _batches(keys, counts)
    return run


def _binary(words: np.ndarray, at: np.ndarray, lang: bytes | None = None) -> pa.Array:
    """The words at the given numbers, after their language if one is given."""
    used, inverse = np.unique(at, return_inverse=True)
    head = b"" if lang is None else lang + b"\t"
    return pa.array([head + w for w in words[used]], pa.binary()).take(pa.array(inverse))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of a column `h` of hashes. The driver gets at most BITS bits, whatever the rows."""
    bit = F.col("h").bitwiseAND(F.lit(BITS - 1))
    rows = (hashes.select(F.shiftright(bit, 15).cast("int").alias("at"),
                          bit.bitwiseAND(F.lit(ROW_BITS - 1)).alias("bit"))
            .groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        start = r["at"] * ROW_BITS // 8
        out[start:start + ROW_BITS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _counted(texts: DataFrame, job) -> DataFrame:
    """Phrases with their language and count. The last tab of a key ends the language, as no word has one."""
    rows = texts.mapInArrow(job, "key binary, n long").groupBy("key").agg(F.sum("n").alias("a"))
    rows = rows.withColumn("key", F.col("key").cast("string"))
    phrase = F.substring_index("key", "\t", -1)
    lang = F.left(F.col("key"), F.length("key") - F.length(phrase) - 1)
    return rows.select(lang.alias("lang"), phrase.alias("phrase"), "a")


def _key(first: int, last: int) -> Column:
    """Language and the words of a phrase from `first` to `last`."""
    words = F.slice(F.split("phrase", " "), first, last - first + 1)
    return F.concat("lang", F.lit("\t"), F.array_join(words, " "))


def _with_counts(rows: DataFrame, parts: dict[str, Column], counts: DataFrame) -> DataFrame:
    """Phrases with the counts of their parts, by name, from a table (key, a). Parts of many phrases are split."""
    rows = durable(rows)
    named = [F.struct(F.lit(name).alias("name"), part.alias("key")) for name, part in parts.items()]
    parted = rows.select("lang", "phrase", "a", F.explode(F.array(*named)).alias("p")).select("lang", "phrase", "a", "p.*")
    hot = hot_keys(durable(parted.groupBy("key").agg(F.count("*").alias("n"))), "key", "n")
    found = salted_join(parted, counts.select("key", F.col("a").alias("n")), "key", hot, ["lang", "phrase", "name"])
    return found.groupBy("lang", "phrase", "a").agg(
        *[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts])


def _score(a: str, left: str, right: str) -> Column:
    a, left, right = (f"CAST({c} AS DECIMAL(38, 0))" for c in (a, left, right))
    return F.expr(f"(1000000 * {a} * {a}) div ({left} * {right})")


def _bound(part: str) -> Column:
    """What no phrase scores more than that holds this pair and whose cut leaves out all but the given word."""
    return _score("a", "a", part)


def _per_lang(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with facts of their language, a table of counted size; rows of other languages go."""
    return rows.join(bounded(facts, facts.count()), "lang")


def _thresholds(pairs: DataFrame, langs: DataFrame, rank: int) -> DataFrame:
    """Per language the score of its pair number `rank`; 0 if it has fewer pairs.

    From counts of equal scores, of which a language has at most 1,000,001.
    """
    sizes = _per_lang(pairs, langs).groupBy("lang", "score").agg(F.count("*").alias("n"))
    down = Window.partitionBy("lang").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = sizes.withColumn("upto", F.sum("n").over(down)).where(F.col("upto") >= rank)
    found = reached.groupBy("lang").agg(F.max("score").alias("least"))
    return langs.join(found, "lang", "left").select("lang", F.coalesce("least", F.lit(0)).alias("least"))


def _pairs(texts: DataFrame, words: DataFrame, least_count: int) -> DataFrame:
    """All pairs of at least `least_count`, with the counts of their words and their score."""
    frequent = _bitmap(words.select(F.xxhash64("key").alias("h")))
    sent = texts.sparkSession.sparkContext.broadcast(frequent)
    rows = _counted(texts, _pair_counter(sent)).where(F.col("a") >= least_count)
    rows = _with_counts(rows, {"l": _key(1, 1), "r": _key(2, 2)}, words)
    return durable(rows.withColumn("score", _score("a", "l", "r")).withColumn("key", _key(1, 2)))


def _triples(texts: DataFrame, pairs: DataFrame, words: DataFrame, least_count: int) -> DataFrame:
    """Phrases of three words grown from the pairs, which carry their threshold `least`."""
    a, b = F.xxhash64(_key(1, 1)), F.xxhash64(_key(2, 2))
    turned = F.shiftleft(a, 1).bitwiseOR(F.shiftrightunsigned(a, 63))
    frontier = durable(pairs.select(
        turned.bitwiseXOR(b).alias("h"), (_bound("l") >= F.col("least")).alias("starts"),
        (_bound("r") >= F.col("least")).alias("ends"), (F.col("score") >= F.col("least")).alias("reaches")))
    maps = [_bitmap(frontier.where(c)) for c in ("starts", "ends", "reaches")]
    sent = texts.sparkSession.sparkContext.broadcast(maps)
    rows = _counted(texts, _triple_counter(sent)).where(F.col("a") >= least_count)
    parts = {"l1": _key(1, 1), "r1": _key(2, 3), "l2": _key(1, 2), "r2": _key(3, 3)}
    rows = _with_counts(rows, parts, words.unionByName(pairs.select("key", "a")))
    rows = rows.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    late = F.col("s2") < F.col("s1")
    return durable(rows.select(
        "lang", "phrase", "a", F.when(late, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(late, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score")))


def _survivors(pairs: DataFrame, triples: DataFrame, drop_percent: int) -> DataFrame:
    """Phrases that reach the threshold, without pairs that a frequent longer phrase holds."""
    held = triples.select(F.explode(F.array(_key(1, 2), _key(2, 3))).alias("key"), F.col("a").alias("longer"))
    held = held.groupBy("key").agg(F.max("longer").alias("longer"))
    columns = ["lang", "phrase", "a", "l", "r", "score", "least"]
    high = pairs.where("score >= least").join(held, "key", "left")
    kept = high.where(F.col("longer").isNull() | (100 * F.col("longer") < drop_percent * F.col("a")))
    thresholds = pairs.select("lang", "least").distinct()
    return kept.select(columns).unionByName(_per_lang(triples, thresholds).where("score >= least").select(columns))


def collocations(docs: DataFrame, keep: int = KEEP, least_count: int = LEAST_COUNT, drop_percent: int = DROP_PERCENT,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """The first `keep` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    texts = spread(docs.select(lang, text)).select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"),
        F.col(text).cast("binary").alias("text")).where(F.length("text") > 0)
    counted = _counted(texts, _count_words).where((F.col("a") >= least_count) | (F.col("phrase") == ""))
    counted = durable(counted.withColumn("key", F.concat("lang", F.lit("\t"), "phrase")))
    words = counted.where((F.col("phrase") != "") & (F.col("a") >= least_count)).select("key", "a")
    sizes = counted.where("phrase = ''").select("lang", F.col("a").alias("n"))
    pairs = _pairs(texts, words, least_count)

    settled, rank = None, keep
    langs = durable(pairs.select("lang").distinct())
    while settled is None or not langs.isEmpty():
        least = durable(_thresholds(pairs, langs, rank))
        # A pair of another language is neither expanded nor told.
        frontier = _per_lang(pairs, least)
        open_texts = _per_lang(texts.withColumn("lang", F.col("lang").cast("string")), least.select("lang"))
        triples = _triples(open_texts.withColumn("lang", F.col("lang").cast("binary")).select("lang", "text"),
                           frontier, words, least_count)
        found = durable(_survivors(frontier, triples, drop_percent))
        reached = found.groupBy("lang").agg(F.count("*").alias("reached"))
        state = durable(least.join(reached, "lang", "left").select(
            "lang", ((F.col("least") <= 0) | (F.coalesce("reached", F.lit(0)) >= keep)).alias("done")))
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        done = top_n(_per_lang(found, state.where("done").select("lang")), "lang", order, keep)
        settled = done if settled is None else settled.unionByName(done)
        langs, rank = state.where("NOT done").select("lang"), rank * 4
    return _per_lang(settled, sizes).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                            "score")


SQL_TEXT = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (
  SELECT d, lang, unnest(l) AS t, generate_subscripts(l, 1) AS p
  FROM (SELECT d, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS l FROM d)),
w AS (
  SELECT lang, l FROM (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS l FROM p) WHERE len(l) > 0),
g AS (
  SELECT lang, k, array_to_string(l[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v (k) WHERE len(l) >= k)
  GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, v.cut,
         (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM c JOIN (VALUES (1), (2)) v (cut) ON v.cut < c.k
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:v.cut], ' ')
  JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[v.cut + 1:], ' ')),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM c WHERE k = 3)
  GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n.n, CAST(score AS BIGINT) AS score
FROM best b JOIN n ON n.lang = b.lang
LEFT JOIN held h ON h.lang = b.lang AND h.part = b.phrase AND b.k = 2
WHERE h.longer IS NULL OR 100 * h.longer < 50 * a
QUALIFY rank <= 2000
"""


@query("op11_collocations", SQL_TEXT)
def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
