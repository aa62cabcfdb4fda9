"""Row numbers, runs, chunks and splits without a one-task window.

A window over a whole table, or over a group that holds a large part of it,
runs in one task. Here rows are range-partitioned and sorted, numbered inside
their partition, and shifted by the sizes of the partitions before theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.runtime import durable, hot_keys, salted_join

# Rows that every partition may send to the one task of a top-n.
HEAD_ROWS = 1_000

# Rows of a head that one task may number, if only rows that reach its last count are sent to it.
NUMBERED_ROWS = 200_000

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low bits


def _sorted_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """Sorted rows with partition number and number inside the partition.

    The result is made durable because it is used twice and the range bounds
    are drawn from a sample.
    """
    at = F.monotonically_increasing_id()
    rows = df.orderBy(*order).withColumn("_at", at)
    return durable(
        rows.withColumn("_pid", F.shiftright("_at", _LOCAL_BITS))
        .withColumn("_local", F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_at"))


def global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a 0-based row number over the whole table in the given order."""
    rows = _sorted_rows(df, order)
    sizes = rows.groupBy("_pid").agg(F.count("*").alias("_n"))
    # One row per partition.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (rows.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_local"))
            .drop("_pid", "_local", "_off"))


def group_index(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Add a 0-based row number inside each group in the given order.

    A group may span many partitions: the window below sees one row per group
    and partition, and the join is on both.
    """
    rows = _sorted_rows(df, [F.col(group), *order])
    pieces = rows.groupBy(group, "_pid").agg(
        F.count("*").alias("_n"), F.min("_local").alias("_first"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        group, "_pid", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (rows.join(offsets, [group, "_pid"])
            .withColumn(name, F.col("_local") - F.col("_first") + F.col("_off"))
            .drop("_pid", "_local", "_first", "_off"))


def top_n(df: DataFrame, group: str, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First n rows per group, numbered from 1.

    The bound on the row number lets Spark cut every group to n rows before the
    shuffle, so a large group does not reach one task whole.
    """
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn(name, at).where(F.col(name) <= n)


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows of the table in the given order, which must leave no ties.

    A short head is picked by Spark's top-n. A long one, of which every
    partition would send n rows to one task, is picked by row number. Both ways
    give the same rows.
    """
    if n <= HEAD_ROWS:
        return df.orderBy(*order).limit(n)
    return global_index(df, order, "_i").where(F.col("_i") < n).drop("_i")


def number_head(df: DataFrame, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First n rows of the table, numbered from 1."""
    if n > HEAD_ROWS:
        rows = global_index(df, order, name).where(F.col(name) < n)
        return rows.withColumn(name, F.col(name) + 1)
    rank = F.row_number().over(Window.orderBy(*order))
    return head(df, order, n).withColumn(name, rank)


def reaching(df: DataFrame, count: str, n: int) -> DataFrame:
    """Rows whose `count`, a whole number, is at least the n-th largest: n rows and its ties.

    The n-th largest is read off the numbers of rows per count. Different counts are few: k of them need a sum of at
    least k^2 / 2. The plan of `df` is the same here and there, so its last shuffle is made once.
    """
    sizes = df.groupBy(F.col(count).alias("_c")).agg(F.count("*").alias("_n"))
    down = Window.orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = sizes.withColumn("_upto", F.sum("_n").over(down)).where(F.col("_upto") >= n)
    least = reached.agg(F.max("_c")).scalar()
    # Fewer rows than n: all of them.
    return df.where(F.coalesce(F.col(count) >= least, F.lit(True)))


def count_head(df: DataFrame, count: str, ties: list[str], n: int, name: str = "rank") -> DataFrame:
    """First n rows by `count`, largest first, then by `ties`, numbered from 1.

    Only rows that reach the n-th largest count are sorted.
    """
    order = [F.col(count).desc(), *[F.col(c) for c in ties]]
    rows = df.where(F.col(count).isNotNull())
    if n > HEAD_ROWS:
        rows = reaching(rows, count, n)
    if n > NUMBERED_ROWS:
        return number_head(rows, order, n, name)
    at = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn(name, at.cast("bigint")).where(F.col(name) <= n)


def sample_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n random rows; every task keeps n of its own."""
    return df.orderBy(F.rand(seed)).limit(n)


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that a hash of key and seed draws: the same on every cluster."""
    drawn = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")))
    return head(df, [drawn, F.col(key)], n)


def balanced(df: DataFrame, label: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of every label."""
    return top_n(df, label, order, n, "_rank").drop("_rank")


def runs(df: DataFrame, group: str, seq: str, value: str) -> DataFrame:
    """Runs of equal `value` inside a group: first `seq`, value and length.

    The row before is found by an equal join on group and number, so a large
    group is spread over all tasks.
    """
    rows = group_index(df.select(group, seq, value), group, [F.col(seq)], "_i")
    before = rows.select(group, (F.col("_i") + 1).alias("_i"), F.col(value).alias("_prev"),
                         F.lit(True).alias("_has"))
    starts = (rows.join(before, [group, "_i"], "left")
              .where(F.col("_has").isNull() | ~F.col("_prev").eqNullSafe(F.col(value)))
              .select(group, seq, value, "_i"))
    starts = group_index(starts, group, [F.col("_i")], "_k")
    following = starts.select(group, (F.col("_k") - 1).alias("_k"), F.col("_i").alias("_next"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    last = starts.groupBy(group).agg(F.max("_k").alias("_k")).join(sizes, group)
    ends = following.unionByName(last.select(group, "_k", F.col("_size").alias("_next")))
    return (starts.join(ends, [group, "_k"])
            .select(group, F.col(seq).alias("first_seq"), value,
                    (F.col("_next") - F.col("_i")).alias("length")))


def chunks(df: DataFrame, order: list[Column], n: int, name: str = "chunk") -> DataFrame:
    """Split the ordered rows into n chunks, numbered from 1.

    As with ntile, sizes differ by one at most and larger chunks come first.
    """
    rows = global_index(df, order, "_i")
    total = rows.agg(F.count("*")).scalar()
    small = F.floor(total / F.lit(n))
    large = total - small * F.lit(n)
    border = large * (small + 1)
    i = F.col("_i")
    at = (F.when(i < border, F.floor(i / (small + 1)))
          .otherwise(large + F.floor((i - border) / F.greatest(small, F.lit(1)))))
    return rows.withColumn(name, (at + 1).cast("bigint")).drop("_i")


def drop_last(df: DataFrame, order: list[Column], k: int, name: str = "pos") -> DataFrame:
    """Ordered rows without the last k, with their 0-based position."""
    rows = global_index(df, order, name)
    total = rows.agg(F.count("*")).scalar()
    return rows.where(F.col(name) < total - F.lit(k))


def number_in(name: Column | str) -> Column:
    """First run of digits of a name as a number, to order ids as numbers."""
    return F.regexp_extract(name, r"\d{1,38}", 0).try_cast("decimal(38,0)")


def split_by_app(df: DataFrame, app: str, share: float = 0.8, name: str = "part") -> DataFrame:
    """All rows with `train` or `test`: the first `share` of the ordered apps train.

    Apps are ordered by the number in their id, then by the id.
    """
    apps = global_index(df.select(app).distinct(), [number_in(app), F.col(app)], "_i")
    total = apps.agg(F.count("*")).scalar()
    train = F.col("_i") < F.floor(total * F.lit(share))
    sides = apps.select(app, F.when(train, F.lit("train")).otherwise(F.lit("test")).alias(name))
    sizes = df.groupBy(app).agg(F.count("*").alias("_n"))
    return salted_join(df, sides, app, hot_keys(sizes, app, "_n"), df.columns)


def in_test(doc_id: str = "doc_id", percent: int = 25) -> Column:
    """Repeatable test flag of a numeric id, by a multiplicative hash.

    The product is taken in two halves of the id, so no id overflows.
    """
    # Multiplier and modulus of the hash.
    factor, modulus, half = F.lit(2654435761), F.lit(4294967296), F.lit(65536)
    low_bits = F.pmod(F.col(doc_id), modulus)
    high, low = F.floor(low_bits / half), F.pmod(low_bits, half)
    mixed = F.pmod(F.pmod(high * factor, half) * half + low * factor, modulus)
    return F.pmod(mixed, F.lit(100)) < F.lit(percent)


def fold_of(doc_id: str, folds: int) -> Column:
    """Repeatable fold number of an id, from the first 32 bits of its MD5."""
    first = F.conv(F.substring(F.md5(F.col(doc_id).cast("string")), 1, 8), 16, 10)
    return F.pmod(first.cast("bigint"), F.lit(folds)).cast("int")
