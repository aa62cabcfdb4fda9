"""Linear support vector machines by stochastic gradient descent, one class against the rest.

Every partition walks its own rows from the shared weights, and after each epoch the weights of all partitions are
averaged by their rows. All classes and all strengths of the penalty move in the same walk. The driver holds one weight
per feature, class and strength; the number of features is a parameter of the vectoriser.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.bayes import MAX_CLASSES
from reviewloom.operators.centers import BLOCK_ROWS, DIRECT_ROWS, Rows, add_up, one_row, vector_rows

PACKED = pa.schema([("begin", pa.binary()), ("index", pa.binary()), ("value", pa.binary()), ("label", pa.binary())])
# Rows up to which partitions are put together, one a core.
FEW_ROWS = 100_000
PACKED_DDL = "begin binary, index binary, value binary, label binary"


@dataclass
class HingeModel:
    """Weights (feature and bias, class) for one strength of the penalty."""

    labels: list
    weights: np.ndarray
    alpha: float
    epochs: int

    def predict(self, df: DataFrame, features: str = "features", output: str = "pred") -> DataFrame:
        """Rows with the label of the largest margin, the smaller one among equals."""
        sent = df.sparkSession.sparkContext.broadcast(self.weights)

        @F.arrow_udf("int")
        def best(column: pa.Array) -> pa.Array:
            rows, w = vector_rows(column), sent.value
            return pa.array((rows.dots(np.ascontiguousarray(w[:-1].T)) + w[-1]).argmax(1), pa.int32())

        values = F.array(*[F.lit(v) for v in self.labels])
        return df.withColumn(output, values[best(features)])


def _packed(df: DataFrame, features: str, label: str) -> DataFrame:
    """Vectors and class numbers in blocks of rows."""
    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                rows = vector_rows(batch.column(0).slice(at, BLOCK_ROWS))
                label = np.array(batch.column(1).slice(at, BLOCK_ROWS), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (rows.begin, rows.index, rows.value, label)],
                    schema=PACKED)

    return df.select(features, label).mapInArrow(pack, PACKED_DDL)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[Rows, np.ndarray]]:
    for i in range(batch.num_rows):
        begin, index, value, label = (batch.column(j)[i].as_py() for j in range(4))
        yield (Rows(np.frombuffer(begin, np.int64), np.frombuffer(index, np.int64), np.frombuffer(value)),
               np.frombuffer(label, np.int64))


def walk(rows: Rows, labels: np.ndarray, order: np.ndarray, weights: np.ndarray, scale: np.ndarray, alphas: np.ndarray,
         classes: int, at: int) -> np.ndarray:
    """One pass over rows in the given order; gives the hinge losses met on the way, by strength.

    `weights` (feature and bias, strength x class) times `scale` is the model; both are changed in place. The penalty
    only changes the scale, so a step touches no more features than its row has.
    """
    wide = np.repeat(alphas, classes)
    sign = 2.0 * np.eye(classes)[labels] - 1
    losses = np.zeros(len(alphas))
    for i in order:
        some = slice(rows.begin[i], rows.begin[i + 1])
        index, value = rows.index[some], rows.value[some]
        y = np.tile(sign[i], len(alphas))
        margin = y * ((value @ weights[index]) * scale + weights[-1])
        miss = np.maximum(1 - margin, 0)
        losses += miss.reshape(len(alphas), classes).sum(1)
        at += 1
        rate = 1 / (wide * (at + 1 / wide))
        scale *= 1 - rate * wide
        push = np.where(miss > 0, rate * y, 0.0)
        if push.any():
            weights[index] += value[:, None] * (push / scale)
            # The bias is not penalised and learns slower, as every row moves it.
            weights[-1] += 0.1 * push
    return losses


def fit_hinge(df: DataFrame, features: str, label: str, width: int, alphas: Sequence[float] = (1e-4,),
              epochs: int = 20, tol: float = 1e-3, seed: int = 7) -> list[HingeModel]:
    """A model per strength of the penalty, from vectors of `width` features.

    Rows without label or features are left out; labels are numbered in order. Training ends when no strength's mean
    loss falls by more than `tol` in an epoch, twice in a row. Rows keep their partition, so results depend on the
    partitioning, as always when weights are averaged.
    """
    df = df.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    sizes = df.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).limit(MAX_CLASSES + 1).collect()
    labels = [r[label] for r in sizes]
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if not labels:
        raise ValueError("no labelled rows")
    number = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)) - 1
    spark, strengths, classes = df.sparkSession, np.array(alphas, float), len(labels)
    parts, cores = df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    packed = _packed(df.withColumn("_label", number.cast("long")), features, "_label")
    if cores < parts <= 4 * cores and sum(r["n"] for r in sizes) <= FEW_ROWS:
        # Of few rows, more to a walk; a task of a large table keeps to its own partition.
        packed, parts = packed.coalesce(cores), cores
    packed = packed.persist()
    columns = len(strengths) * classes
    weights, best, calm, seen, done = np.zeros((width + 1, columns)), None, 0, 0, 0
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast(weights)

        def step(batches, epoch=epoch, sent=sent, seen=seen):  # the values of this epoch
            own, scale = sent.value.copy(), np.ones(columns)
            n, losses = 0, np.zeros(len(strengths))
            for batch in batches:
                for rows, numbers in _blocks(batch):
                    order = np.random.default_rng((seed, epoch, n)).permutation(len(rows))
                    losses += walk(rows, numbers, order, own, scale, strengths, classes, seen + n)
                    n += len(rows)
                    # Folded in before it gets too small.
                    own[:-1] *= scale
                    scale[:] = 1
            yield one_row(np.concatenate([[n], losses, n * own.ravel()]))

        sums = packed.mapInArrow(step, "sums binary")
        if parts > DIRECT_ROWS:
            sums = sums.repartition(int(np.sqrt(parts))).mapInArrow(add_up, "sums binary")
        total = sum(np.frombuffer(r["sums"]) for r in sums.collect())
        sent.unpersist()
        n, losses = total[0], total[1:1 + len(strengths)] / max(total[0], 1)
        weights = (total[1 + len(strengths):] / max(n, 1)).reshape(weights.shape)
        # A partition makes as many steps in an epoch as it has rows.
        seen, done = seen + int(n / max(parts, 1)), epoch + 1
        calm = calm + 1 if best is not None and (best - losses <= tol).all() else 0
        best = losses if best is None else np.minimum(best, losses)
        if calm == 2:
            break
    packed.unpersist()
    return [HingeModel(labels, np.ascontiguousarray(weights[:, i * classes:(i + 1) * classes]), float(a), done)
            for i, a in enumerate(strengths)]
