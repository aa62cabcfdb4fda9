"""What every job needs from the session: spreading, hot keys, durable cuts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is hinted as broadcast only if it is known to hold no more rows.
BROADCAST_ROWS = 200_000

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so there can be
# fewer than HOT_SHARE of them whatever the data. It is split into pieces of
# about 1/HOT_SHARE of the rows, so there are fewer than 2 * HOT_SHARE of these.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    Only a local session (a test) may go without one and gets a temporary
    folder, removed at the end.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="reviewloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the session's JVM ends."""
    parent = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    folder = jvm.org.apache.hadoop.fs.Path(parent)
    fs = folder.getFileSystem(jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{parent}/{name}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint that outlives executors.

    Spark removes its files once the frame is no longer referenced if
    `spark.cleaner.referenceTracking.cleanCheckpoints` is set.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back; takes less room than a checkpoint."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files, and the checkpoints if it is told to, that no frame needs any more.

    It finds them when the driver collects its garbage, which a driver that only starts jobs seldom does.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a file scan with fewer splits than cores one split per core.

    A large table has many splits already and is passed on without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, *keys)


def by_document(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Shuffle whole texts by their document, so that counting and ranking its terms shuffles no rows of terms."""
    return df.repartition(doc)


def bounded(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Hint a broadcast if `max_rows`, a proven bound, is small enough."""
    if max_rows is not None and max_rows <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def vocabulary_join(left: DataFrame, vocab: DataFrame, key: str, count: str,
                    spread_by: str | list[str], max_rows: int | None,
                    how: str = "inner") -> DataFrame:
    """Join rows to a vocabulary with a row count per key.

    A vocabulary of proven small size is broadcast; of another the frequent
    keys are split.
    """
    if max_rows is not None and max_rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(vocab.drop(count)), key, how)
    return salted_join(left, vocab.drop(count), key, hot_keys(vocab, key, count), spread_by, how)


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Keys above 1/HOT_SHARE of all rows with the pieces to split each into."""
    total = counts.agg(F.sum(n).alias("_total")).scalar()
    share = F.col(n) * F.lit(HOT_SHARE) / total
    return counts.where(share > 1).select(key, F.ceil(share).cast("int").alias("_pieces"))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame,
                spread_by: str | list[str], how: str = "inner") -> DataFrame:
    """Join on `key` with the hot keys split by the `spread_by` columns of the left side.

    `right` has few rows per key. Rows of a hot key get one of its pieces on the
    left and are repeated per piece on the right; other keys have one piece.
    `spread_by` has to tell the rows of a key apart.
    """
    columns = [spread_by] if isinstance(spread_by, str) else spread_by
    flag = F.broadcast(hot.select(key, "_pieces"))
    piece = F.pmod(F.xxhash64(*columns), F.col("_pieces")).cast("int")
    salted = (left.join(flag, key, "left")
              .withColumn("_salt", F.coalesce(piece, F.lit(0))).drop("_pieces"))
    copies = F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)
    repeated = (right.join(flag, key, "left")
                .withColumn("_salt", F.explode(copies)).drop("_pieces"))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
