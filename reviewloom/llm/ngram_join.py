"""N-gram Jaccard join: a size-aware join of light and heavy sets, exact at any size.

A document's set holds the hashes of its distinct word n-grams. Equal sets are
joined first and stand as one from there on. Then, by size of the set:

* Light sets enumerate fixed-size subsets: all subsets of the size two linked
  sets must share. Two sets that meet in such a subset are linked by their
  sizes alone. Inside a group every set is linked to the smallest one; any other
  link of the group follows from these, so no pairs are made.
* Heavy sets, and light sets near enough in size to meet one, are put on
  inverted lists of their rarest n-grams (a prefix that every linked pair must
  meet in). The lists are scanned in blocks; an exact bound from short parity
  bitmaps drops most pairs inside the scan, one from bitmaps as wide as the sets
  nearly all others, and pairs already known to be joined are left out. What
  remains is verified on the whole sets.

The boundary between light and heavy is the size at which enumerating costs
more than scanning, from the histogram of set sizes.

A large group of near copies would fill the lists with pairs, so before the
scan documents that agree in a band of minimum hashes are compared with the
first of their band only, and joined if the whole sets say so. This adds no
link that the join would not find; it saves the pairs inside what is joined
already.

N-grams frequent in a sample are ordered last in the prefix. The order decides
the cost alone, never the result. N-grams are told apart by 64-bit hashes.

Defined results: texts that are null, empty or blank have an empty set and are
linked with nothing; texts of fewer words than n have one n-gram, the whole
sequence; repeated rows of one id count as one document; a null id is not
joined with anything; ids are taken to tell texts apart; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import ngram_hashes, only_ids, query, slices, table, word_hashes
from reviewloom.llm.components import components
from reviewloom.runtime import durable

# What an entry of an inverted list costs (two shuffles, a join, its scan) against
# one key of a light set (one shuffle).
KEY_COST, ENTRY_COST = 1.0, 8.0
LIGHT_MOST = 40

SAMPLE = 16
FREQUENT_IN_SAMPLE = 4
FREQUENT_MOST = 50_000

COUNTED_AT_ONCE = 1_000_000

BLOCK = 512
BANDS, BAND_ROWS = 6, 3
BITMAP_BYTES = 128


@dataclass(frozen=True)
class Jaccard:
    """Similarity of at least percent / 100 over word n-grams."""

    words: int
    percent: int

    def overlap(self, n: int, m: int) -> int:
        """Least shared n-grams of linked sets of these sizes."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def linked(self, shared: int, n: int, m: int) -> bool:
        return 100 * shared >= self.percent * (n + m - shared)

    def smallest(self, n: int) -> int:
        """Least size of a set linked to one of size n."""
        return -(-self.percent * n // 100)

    def largest(self, n: int) -> int:
        return 100 * n // self.percent

    def prefix(self, n: int) -> int:
        """Rarest n-grams of which linked sets share one at least."""
        return n - self.smallest(n) + 1

    def subset_sizes(self, n: int, boundary: int) -> list[int]:
        """Sizes of the subsets a light set of size n has to enumerate."""
        return sorted({o for m in range(self.smallest(n), min(self.largest(n), boundary) + 1)
                       if (o := self.overlap(n, m)) <= min(n, m)})

    def subsets(self, n: int, boundary: int) -> int:
        return sum(math.comb(n, o) for o in self.subset_sizes(n, boundary))


def set_of(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of the ASCII-lower-cased words of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(ngram_hashes(word_hashes(words), min(n, len(words))))


def boundary_by_cost(sizes: dict[int, int], how: Jaccard) -> int:
    """Largest size of a light set: the cheapest over all boundaries up to LIGHT_MOST."""
    def cost(b: int) -> float:
        light = sum(c * KEY_COST * how.subsets(n, b) for n, c in sizes.items() if n <= b)
        heavy = sum(c * ENTRY_COST * how.prefix(n) for n, c in sizes.items() if n >= how.smallest(b + 1))
        return light + heavy
    return min(range(LIGHT_MOST + 1), key=lambda b: (cost(b), -b))


def _shuffled(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes in another order for every k."""
    x = h * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
    return x ^ (x >> np.uint64(31))


def signature(h: np.ndarray, how: Jaccard, frequent: np.ndarray, count: np.ndarray) -> tuple:
    """Digest of the set, prefix (rarest first), minimum-hash bands, short and wide parity bitmap."""
    n = len(h)
    at = np.searchsorted(frequent, h)
    at[at == len(frequent)] = 0
    often = np.where(frequent[at] == h, count[at], 0) if len(frequent) else np.zeros(n, np.int64)
    order = np.lexsort((h, often))
    prefix = h[order[:how.prefix(n)]]
    low = np.array([_shuffled(h, k).min() for k in range(BANDS * BAND_ROWS)], np.uint64)
    bands = [int(ngram_hashes(low[b * BAND_ROWS:(b + 1) * BAND_ROWS], BAND_ROWS)[0]) for b in range(BANDS)]
    wide = parities(h)
    digest = np.array([h.sum(dtype=np.uint64), _shuffled(h, 99).sum(dtype=np.uint64)], np.uint64).tobytes()
    return digest, prefix.view(np.int64), np.array(bands, np.uint64).view(np.int64), folded(
        wide, BITMAP_BYTES).tobytes(), wide.tobytes() if len(wide) > BITMAP_BYTES else b""


def parities(h: np.ndarray) -> np.ndarray:
    """Packed parities of the hashes per place, on at least as many places as there are hashes."""
    places = max(BITMAP_BYTES * 8, 1 << (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h % np.uint64(places)).astype(np.int64), minlength=places).astype(np.uint8) & 1)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The same on fewer places."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def _frequent(texts: DataFrame, how: Jaccard) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that several documents of a sample share, with their counts; a list of bounded length."""
    def counted(seen):
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))],
                                          names=["h", "n"])

    def run(batches):
        seen = []
        for batch in slices(batches):
            seen += [set_of(t, how.words) for t in batch.column(0).to_pylist()]
            if sum(map(len, seen)) > COUNTED_AT_ONCE:
                yield counted(seen)
                seen = []
        if seen:
            yield counted(seen)

    part = texts.where(F.pmod(F.xxhash64("row_id"), F.lit(SAMPLE)) == 0).select("text")
    top = (part.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= FREQUENT_IN_SAMPLE).orderBy(F.desc("n"), "h").limit(FREQUENT_MOST).toArrow())
    h = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top.column("n").to_numpy()[order]


def _signatures(texts: DataFrame, how: Jaccard, id_type: str) -> DataFrame:
    """row_id, n, digest, prefix, bands, bitmap and (if it is longer) wide of every document."""
    frequent, count = _frequent(texts, how)

    def run(batches):
        for batch in slices(batches):
            out = []
            for t in batch.column(1).to_pylist():
                h = set_of(t, how.words)
                out.append((len(h), *(signature(h, how, frequent, count) if len(h) else (b"", [], [], b"", b""))))
            n, digest, prefix, bands, bitmap, wide = zip(*out, strict=True) if out else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(prefix, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(bitmap, pa.binary()), pa.array(wide, pa.binary())],
                names=["row_id", "n", "digest", "prefix", "bands", "bitmap", "wide"])

    return texts.mapInArrow(
        run, f"row_id {id_type}, n long, digest binary, prefix array<long>, bands array<long>, "
             "bitmap binary, wide binary")


def _sets(texts: DataFrame, how: Jaccard, id_type: str) -> DataFrame:
    """row_id and the whole set, as the bytes of its sorted hashes."""
    def run(batches):
        for batch in slices(batches):
            sets = [set_of(t, how.words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["row_id", "h"])

    return texts.mapInArrow(run, f"row_id {id_type}, h binary")


def _verified(pairs: DataFrame, texts: DataFrame, how: Jaccard, id_type: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked."""
    ids = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    some = _sets(only_ids(texts, "row_id", ids, ids.count()), how, id_type)
    joined = (pairs.join(some.select(F.col("row_id").alias("a"), F.col("h").alias("ha")), "a")
              .join(some.select(F.col("row_id").alias("b"), F.col("h").alias("hb")), "b")
              .select("a", "b", "ha", "hb"))

    def run(batches):
        for batch in slices(batches):
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good.append(how.linked(shared, len(p), len(q)))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return joined.mapInArrow(run, f"a {id_type}, b {id_type}")


def _light_links(texts: DataFrame, light: DataFrame, boundary: int, how: Jaccard, id_type: str) -> DataFrame:
    """Links (a, b) between light sets, each to the smallest set of a shared subset."""
    n_light = light.count()
    some = _sets(only_ids(texts, "row_id", light, n_light), how, id_type)

    def run(batches):
        for batch in slices(batches):
            ids, sizes, keys = [], [], []
            for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(h, np.uint64)
                n, whole = len(s), int(s.sum(dtype=np.uint64))
                hashes = s.tolist()
                for o in how.subset_sizes(n, boundary):
                    for gone in combinations(hashes, n - o):
                        ids.append(i)
                        sizes.append(n)
                        # A subset is told by its size and the sum of its hashes.
                        keys.append(((whole - sum(gone)) * 64 + o) & 0x7FFFFFFFFFFFFFFF)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())],
                names=["row_id", "n", "k"])

    keys = some.mapInArrow(run, f"row_id {id_type}, n int, k long")
    first = keys.groupBy("k").agg(F.count("*").alias("c"), F.min(F.struct("n", "row_id")).alias("first")).where("c > 1")
    size = F.col("n") + F.col("first.n")
    need = F.ceil(F.lit(how.percent) * size / F.lit(100 + how.percent))
    return (keys.join(first, "k").where(F.pmod("k", F.lit(64)) >= need)
            .where(F.col("row_id") != F.col("first.row_id"))
            .select(F.col("row_id").alias("a"), F.col("first.row_id").alias("b")).distinct())


def _id_arrow(id_type: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())


def _possible(n: np.ndarray, m: int, bits: np.ndarray, own: np.ndarray, how: Jaccard) -> np.ndarray:
    """Which sets of sizes `n` may be linked to one of size `m`, by sizes and parity bitmaps.

    Sets that differ in d hashes differ in at most d parities.
    """
    differ = np.bitwise_count(bits ^ own).sum(axis=1)
    total = n + m
    shared = -(-how.percent * total // (100 + how.percent))
    return (shared <= np.minimum(n, m)) & (differ <= total - 2 * shared)


def _bounded_pairs(pairs: DataFrame, sets: DataFrame, how: Jaccard, id_type: str) -> DataFrame:
    """The pairs (a, b) that pass the bounds on bitmaps as wide as the smaller set's."""
    bits = F.when(F.length("wide") > 0, F.col("wide")).otherwise(F.col("bitmap"))
    facts = sets.select("row_id", "n", bits.alias("bits"))
    joined = (pairs.join(facts.toDF("a", "na", "bits_a"), "a").join(facts.toDF("b", "nb", "bits_b"), "b")
              .select("a", "b", "na", "nb", "bits_a", "bits_b"))

    def run(batches):
        for batch in slices(batches):
            good = []
            for na, nb, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(p), len(q))
                bits = folded(p, size).view(np.uint64)[None, :]
                good.append(bool(_possible(np.array([na]), nb, bits, folded(q, size).view(np.uint64), how)[0]))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    return joined.mapInArrow(run, f"a {id_type}, b {id_type}")


def _band_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of a document and the first one of a band it shares."""
    keys = sets.select("row_id", F.posexplode("bands").alias("band", "k"))
    first = keys.groupBy("band", "k").agg(F.min("row_id").alias("b"), F.count("*").alias("c")).where("c > 1")
    return (keys.join(first, ["band", "k"]).where("row_id != b")
            .select(F.col("row_id").alias("a"), "b").distinct())


def _list_members(sets: DataFrame, joined: DataFrame, how: Jaccard) -> DataFrame:
    """Members of the inverted lists that some pair may come from, by pair of blocks.

    A list of several blocks is scanned block against block: each member goes
    to every pair of blocks that holds its own.
    """
    entries = sets.select("row_id", F.explode("prefix").alias("k")).repartition("k")
    lists = (entries.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
             .withColumn("blocks", F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")))
    own = F.pmod(F.xxhash64("row_id", "k"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = (entries.join(lists, "k").withColumn("own", own).withColumn("other", other)
               .select("row_id", "k", "own", F.least("own", "other").alias("low"),
                       F.greatest("own", "other").alias("high")))
    facts = sets.select("row_id", "n").join(joined, "row_id", "left").select(
        "row_id", "n", F.coalesce("component", "row_id").alias("component"))
    # Nothing is left to find among members of one component, nor between two of unlike sizes.
    group = Window.partitionBy("k", "low", "high")
    return (members.join(facts, "row_id")
            .withColumn("one", F.min("component").over(group) == F.max("component").over(group))
            .withColumn("two", F.count("*").over(group) == 2)
            .withColumn("apart", F.max("n").over(group) * how.percent > F.min("n").over(group) * 100)
            .where("NOT one AND NOT (two AND apart)").drop("one", "two", "apart"))


def _list_pairs(sets: DataFrame, joined: DataFrame, how: Jaccard, id_type: str) -> DataFrame:
    """Pairs of documents not joined yet that share a prefix n-gram and pass the bounds."""
    full = _list_members(sets, joined, how).join(sets.select("row_id", "bitmap"), "row_id")
    id_arrow = _id_arrow(id_type)

    def run(batches):
        for batch in slices(batches):
            a, b = [], []
            lists, members = batch.column(1), batch.column(1).flatten()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            owns, ids, sizes, comps = (members.field(c).to_numpy(zero_copy_only=False)
                                       for c in ("own", "id", "n", "component"))
            bitmaps = members.field("bitmap")
            for at, low, high in zip(batch.column(0).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                own, member, n, comp = owns[low:high], ids[low:high], sizes[low:high], comps[low:high]
                bits = np.frombuffer(b"".join(bitmaps.slice(low, high - low).to_pylist()), np.uint64).reshape(
                    len(n), -1)
                order = np.argsort(n, kind="stable")
                for k, i in enumerate(order):
                    rest = order[k + 1:]
                    rest = rest[(how.percent * n[rest] <= 100 * n[i]) & (comp[rest] != comp[i])]
                    if at["low"] != at["high"]:
                        rest = rest[own[rest] != own[i]]
                    if not len(rest):
                        continue
                    for j in rest[_possible(n[rest], n[i], bits[rest], bits[i], how)]:
                        x, y = min(member[i], member[j]), max(member[i], member[j])
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, id_arrow), pa.array(b, id_arrow)], names=["a", "b"])

    # A group is one pair of blocks: at most 2 x BLOCK members, about.
    item = F.struct(F.col("row_id").alias("id"), "own", "n", "component", "bitmap")
    blocks = (full.groupBy("k", "low", "high").agg(F.collect_list(item).alias("rows"))
              .select(F.struct("low", "high").alias("at"), "rows"))
    return blocks.mapInArrow(run, f"a {id_type}, b {id_type}").distinct()


def ngram_join(docs: DataFrame, words: int = 4, percent: int = 85, row_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """One row per input row: id, `n_shingles` and `component_id`, the smallest id reachable by links."""
    how = Jaccard(words, percent)
    texts = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    id_type = texts.schema["row_id"].dataType.simpleString()
    known = texts.where(F.col("row_id").isNotNull())
    rows = durable(_signatures(texts, how, id_type))

    # Equal sets stand as one, the one of smallest id.
    of_sets = [F.first(c).alias(c) for c in ("prefix", "bands", "bitmap", "wide")]
    slim = rows.where("n > 0 AND row_id IS NOT NULL")
    first = slim.groupBy("n", "digest").agg(F.min("row_id").alias("row_id"))
    sets = durable(slim.join(first, ["n", "digest", "row_id"]).groupBy("row_id", "n", "digest").agg(*of_sets))

    sizes = {r["n"]: r["c"] for r in sets.where(F.col("n") <= how.largest(LIGHT_MOST + 1)).groupBy("n")
             .agg(F.count("*").alias("c")).collect()}
    boundary = boundary_by_cost(sizes, how)
    links = durable(_light_links(known, sets.where(F.col("n") <= boundary).select("row_id"), boundary, how, id_type))
    listed = sets.where(F.col("n") >= how.smallest(boundary + 1))
    near = durable(_verified(durable(_bounded_pairs(_band_pairs(listed), sets, how, id_type)), known, how, id_type))
    links = links.unionByName(near)
    joined = components(links, id_type)
    found = durable(_bounded_pairs(_list_pairs(listed, joined, how, id_type), sets, how, id_type))
    joined = components(links.unionByName(_verified(found, known, how, id_type)), id_type)

    classes = (sets.join(joined, "row_id", "left")
               .select("n", "digest", F.coalesce("component", "row_id").alias("component_id")))
    return (rows.select("row_id", "n", "digest").join(classes, ["n", "digest"], "left")
            .select(F.col("row_id").alias(row_id), F.col("n").alias("n_shingles"),
                    F.when(F.col("row_id").isNotNull(), F.coalesce("component_id", "row_id")).alias("component_id")))


SQL_TEXT = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles,
       least(w.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""


@query("op1_ngram_join", SQL_TEXT)
def op1_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))
