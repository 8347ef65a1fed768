"""Hard negatives by slot-decomposed selection.

An anchor's best rows of its own label are its positives. Each positive opens a window of
scores for negatives: from a share of its own score up to another share of it. The windows of
one anchor overlap, but their upper limits cut the scores into disjoint slots. Tasks keep only
the best ``k`` rows per anchor and slot (combiners), these are merged to ``k`` per slot, and a
suffix merge from the lowest slot upwards gives the best ``k`` below every upper limit; what
lies under a window's lower limit is cut from the end.

Anchors are a stated set of queries against all rows. They are packed into blocks of bounded
size; the rows are read twice per block, and only one block travels at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from agora.llm.common import stored
from agora.session import scratch_path

POSITIVES = 5
NEGATIVES = 5
#: Percent of a positive's score: the least and the greatest score of its negatives.
LOW, HIGH = 80, 100
#: Components are scaled by this factor and rounded down.
SCALE = 256
#: Anchors of a block, and the greatest number of scores computed at once.
BLOCK = 16_384
SCORES = 1 << 20
#: A scaled component of this size or more counts as not finite: scores always fit 64 bits.
TOO_LARGE = 2.0**24
_LEAST = np.iinfo(np.int64).min
_CANDIDATE = "place int, slot int, anchor_id bigint, vec_id bigint, score bigint"
_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


class Vectors:
    """The usable rows of a batch: ids, labels and integer vectors, by length of the vector."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.ids, self.labels, self.matrix = ids, labels, matrix
        self.peak = float(np.abs(matrix).max(initial=0))

    @staticmethod
    def of(batch: pa.RecordBatch, scale: int = SCALE) -> list[Vectors]:
        """Rows of (vec_id, label, embedding) without nulls and with finite components only."""
        for column in range(3):
            batch = batch.filter(pc.is_valid(batch.column(column)))
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        lists = batch.column(2)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # A null component becomes not-a-number.
        flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(scale * flat)
        ends = np.cumsum(sizes)
        fit = np.concatenate([[0], np.cumsum(~(np.abs(flat) < TOO_LARGE))])
        usable = fit[ends] == fit[ends - sizes]
        parts = []
        for size in np.unique(sizes[usable]).tolist():
            rows = np.flatnonzero(usable & (sizes == size))
            places = (ends - sizes)[rows][:, None] + np.arange(size)
            parts.append(Vectors(ids[rows], labels[rows], flat[places]))
        return parts

    def take(self, rows: np.ndarray | slice) -> Vectors:
        return Vectors(self.ids[rows], self.labels[rows], self.matrix[rows])

    def exact(self, other: Vectors) -> np.ndarray:
        """All inner products with another part; sums of integers stay exact in the type chosen."""
        bound = max(1, self.matrix.shape[1]) * max(self.peak, 1) * max(other.peak, 1)
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        return self.matrix.astype(kind) @ other.matrix.astype(kind).T


class Best:
    """The best ``k`` rows of every group: greater scores first, then smaller ids."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, _LEAST)
        self.parts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, group: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        kept = scores >= self.floor[group]
        if kept.any():
            self.parts.append(np.stack([group[kept], ids[kept], scores[kept]]))
            self.waiting += int(kept.sum())
            if self.waiting > SCORES:
                self.reduce()

    def reduce(self) -> np.ndarray:
        """Keep ``k`` rows per group; (group, id, score) in order."""
        rows = np.concatenate([np.empty((3, 0), dtype=np.int64), *self.parts], axis=1)
        rows = rows[:, np.lexsort((rows[1], -rows[2], rows[0]))]
        group = rows[0]
        place = np.arange(len(group))
        begin = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
        rank = place - np.maximum.accumulate(np.where(begin, place, 0)) if len(group) else place
        rows = rows[:, rank < self.k]
        full = rank == self.k - 1
        self.floor[group[full]] = rows[2][rank[rank < self.k] == self.k - 1]
        self.parts, self.waiting = [rows], 0
        return rows

    def batch(self, slots: int, anchors: np.ndarray) -> pa.RecordBatch:
        group, ids, scores = self.reduce()
        place = group // slots
        arrays = [place.astype(np.int32), (group % slots).astype(np.int32), anchors[place], ids, scores]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["place", "slot", "anchor_id", "vec_id", "score"])


def _pieces(anchors: Vectors, rows: Vectors) -> Iterator[tuple[np.ndarray, Vectors, Vectors]]:
    """Anchor places, anchors and rows in pieces of a bounded number of scores."""
    wide = min(len(anchors.ids), 1_024)
    high = max(1, SCORES // max(1, wide))
    for a in range(0, len(anchors.ids), wide):
        part = anchors.take(slice(a, a + wide))
        for b in range(0, len(rows.ids), high):
            yield np.arange(a, a + len(part.ids)), part, rows.take(slice(b, b + high))


def _same_label(anchors: Vectors, rows: Vectors, best: Best, places: np.ndarray) -> None:
    """Candidates for positives: rows of an anchor's label under another id."""
    for label in np.intersect1d(anchors.labels, rows.labels).tolist():
        mine = np.flatnonzero(anchors.labels == label)
        for at, part, others in _pieces(anchors.take(mine), rows.take(rows.labels == label)):
            own = places[mine[at]]
            scores = part.exact(others)
            allowed = part.ids[:, None] != others.ids[None, :]
            good = allowed & (scores >= best.floor[own][:, None])
            if scores.shape[1] > best.k:  # what this piece alone ranks behind k rows can't count
                least = scores.dtype.type(_LEAST)
                bound = np.partition(np.where(allowed, scores, least), -best.k, axis=1)[:, -best.k]
                good &= scores >= bound[:, None]
            a, b = np.nonzero(good)
            best.add(own[a], others.ids[b], scores[a, b].astype(np.int64))


def _other_labels(anchors: Vectors, rows: Vectors, best: Best, places: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
    """Candidates for negatives, each in the slot below the least upper limit it reaches."""
    slots = upper.shape[1]
    for at, part, others in _pieces(anchors, rows):
        own = places[at]
        scores = part.exact(others)
        top, bottom = upper[own], lower[own]
        good = (scores <= top[:, :1]) & (scores >= bottom.min(axis=1)[:, None])
        good &= (part.labels[:, None] != others.labels[None, :]) & (part.ids[:, None] != others.ids[None, :])
        a, b = np.nonzero(good)
        score = scores[a, b].astype(np.int64)
        slot = (top[a] >= score[:, None]).sum(axis=1) - 1
        kept = score >= bottom[a, slot]
        best.add(own[a[kept]] * slots + slot[kept], others.ids[b[kept]], score[kept])


def _scan(rows: DataFrame, anchors, k: int, slots: int, scale: int, limits=None) -> DataFrame:
    """The best ``k`` candidates per anchor place and slot: of each task first, then of all."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(places, Vectors(*arrays)) for places, *arrays in anchors.value]
        names = np.zeros(sum(len(places) for places, _ in parts), dtype=np.int64)
        for places, part in parts:
            names[places] = part.ids
        best = Best(len(names) * slots, k)
        for batch in batches:
            for found in Vectors.of(batch, scale):
                for places, part in parts:
                    if part.matrix.shape[1] != found.matrix.shape[1]:
                        continue
                    if limits is None:
                        _same_label(part, found, best, places)
                    else:
                        _other_labels(part, found, best, places, *limits.value)
        yield best.batch(slots, names)

    order = Window.partitionBy("place", "slot").orderBy(F.col("score").desc(), "vec_id")
    found = rows.mapInArrow(search, _CANDIDATE).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k)


def _packed(rows: DataFrame, scale: int, size: int) -> DataFrame:
    """Rows packed into records (block, ids, labels, lengths, vectors) of at most ``size`` of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in Vectors.of(batch, scale):
                for start in range(0, len(part.ids), size):
                    few = part.take(slice(start, start + size))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([few.ids.tobytes()], pa.binary()),
                            pa.array([few.labels.tobytes()], pa.binary()),
                            pa.array([few.matrix.astype(np.int32).tobytes()], pa.binary()),
                        ],
                        ["ids", "labels", "matrix"],
                    )

    return rows.mapInArrow(pack, "ids binary, labels binary, matrix binary")


def _unpacked(records: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the block, ids, labels, matrix) per record."""
    parts, at = [], 0
    for row in records:
        ids, labels = (np.frombuffer(row[name], dtype=np.int64) for name in ("ids", "labels"))
        matrix = np.frombuffer(row["matrix"], dtype=np.int32).reshape(len(ids), -1).astype(np.float64)
        parts.append((np.arange(at, at + len(ids)), ids, labels, matrix))
        at += len(ids)
    return parts


def _limits(best: DataFrame, anchors: int, slots: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower limits of the windows of every anchor, best positive first.

    Where an anchor has fewer positives, no score lies between the limits.
    """
    upper = np.full((anchors, slots), _LEAST)
    lower = np.full((anchors, slots), np.iinfo(np.int64).max)
    for place, rank, score in best.select("place", "rank", "score").collect():  # some rows per anchor of a block
        upper[place, rank - 1] = high * score // 100
        lower[place, rank - 1] = -(-low * score // 100)
    return upper, lower


def _windows(found: DataFrame, best: DataFrame, slots: int, k: int, low: int) -> DataFrame:
    """The best ``k`` negatives of every positive, from the best ``k`` of every slot."""
    one = F.struct("rank", F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id"))
    in_order = [F.sort_array(F.collect_list(F.when(F.col("slot") == j, one))).alias(f"slot{j}") for j in range(slots)]
    lists = found.groupBy("place").agg(*in_order)  # at most k rows per slot
    below = F.col(f"slot{slots - 1}")
    suffixes = [below]
    for j in range(slots - 2, -1, -1):  # all of a slot score higher than those below it
        below = F.slice(F.concat(F.col(f"slot{j}"), below), 1, k)
        suffixes.insert(0, below)
    wanted = best.select(
        "place", "rank", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    rows = wanted.join(lists.select("place", F.array(*suffixes).alias("below")), "place")
    reached = lambda n: F.lit(100) * n["negative_score"] >= F.lit(low) * F.col("positive_score")
    rows = rows.withColumn("below", F.filter(F.get("below", F.col("rank") - 1), reached))
    rows = rows.select("anchor_id", "positive_id", "positive_score", F.posexplode("below").alias("at", "n"))
    rank = (F.col("at") + 1).alias("rank")
    return rows.select("anchor_id", "positive_id", rank, "n.negative_id", "positive_score", "n.negative_score")


def hard_negatives(
    spark: SparkSession,
    vectors: DataFrame,
    anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    block: int = BLOCK,
) -> DataFrame:
    """Per anchor and positive the best negatives inside the positive's window of scores.

    ``vectors`` has vec_id, label and embedding; ``anchor`` says which rows are anchors (by
    default those of ids divisible by 100). Returns ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``; a score is the inner product of the scaled vectors.

    Rows with a null id, label or vector, or with a null, not finite or huge component (2**24 or
    more after scaling) take no part. Every other row counts by itself: a repeated row is found
    twice, and is an anchor twice; rows under an anchor's own id are none of its positives or
    negatives. Equal scores are ordered by id. Vectors of different lengths have no score with
    each other; those of length zero have the score 0. A window without rows gives none, as does
    an empty table. Other columns are ignored.
    """
    slim = ["vec_id", F.col("label").cast("bigint").alias("label"), "embedding"]
    chosen = stored(spark, vectors.where(F.col("vec_id") % 100 == 0 if anchor is None else anchor).select(*slim), "anchors")
    parts = max(1, -(-chosen.count() // block))
    packed = _packed(chosen.repartition(parts), scale, block).withColumn("part", F.spark_partition_id())
    packed = stored(spark, packed, "anchor-blocks")
    rows, folder, any_found = vectors.select(*slim), scratch_path(spark, "negatives"), False
    for part in range(parts):
        # Round-robin dealing makes a part one block, or little more.
        anchors = _unpacked(packed.where(F.col("part") == part).collect())
        size = sum(len(places) for places, *_ in anchors)
        if not size:
            continue
        held = spark.sparkContext.broadcast(anchors)
        best = stored(spark, _scan(rows, held, positives, 1, scale), "positives")
        limits = spark.sparkContext.broadcast(_limits(best, size, positives, low, high))
        found = _scan(rows, held, negatives, positives, scale, limits)
        _windows(found, best, positives, negatives, low).write.mode("append").parquet(folder)
        held.destroy()
        limits.destroy()
        any_found = True
    return spark.read.schema(_RESULT).parquet(folder) if any_found else spark.createDataFrame([], _RESULT)
