"""What the operators of this package share: registry, tables, hashing, bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LIBC = ctypes.CDLL(None)

# A side of one long per row is broadcast up to this many rows (about 16 MB).
ID_BROADCAST_ROWS = 1_000_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)).cast("int")


def only_ids(df: DataFrame, key: str, ids: DataFrame, n_ids: int) -> DataFrame:
    """Rows of `df` whose key is in `ids`, a table of `n_ids` distinct keys.

    The ids are broadcast only if their counted number is small; a longer list
    is met by a shuffle on the key.
    """
    wanted = ids.select(F.col(ids.columns[0]).alias(key))
    if n_ids <= ID_BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return df.join(wanted, key, "left_semi")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in short pieces, so that a task holds few texts as Python objects at a time.

    Python workers live on for later stages, so at the end of a task the memory
    it has freed goes back to the system.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


# Odd multipliers that mix the hashes of neighbouring words.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB],
                dtype=np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of n words, from the hashes of the words."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(k, np.uint64)
    for j in range(n):
        x = words[j:j + k] * _MIX[j % len(_MIX)]
        out ^= x >> np.uint64(32)
        out += x * _MIX[(j + 3) % len(_MIX)]
    return out ^ (out >> np.uint64(29))
