"""Near vectors of one label, compared block by block: their pairs, and edges that connect the same ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, at least and at most; a label that lies between has so many blocks.
LEAST, MOST, BLOCKS = 2048, 8192, 8
#: Cosines held at once, and pairs scored at once.
CELLS, CHUNK = 1 << 20, 1 << 16
#: Of a percent. A product of matrices sums in another order than a plain loop; pairs this close to a half are summed anew, in order.
SLACK = 1e-6
#: Buckets of a simhash: 8 bands of 256.
BUCKETS = 2048


def _meetings(rows: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """rows (vec_id, label, embedding) with width, i, j and block: each row once for each block of its label and width that its own block meets.

    Only rows are shuffled, each as often as its label has blocks; pairs are made where two blocks meet.
    Vectors of different lengths, without a label or with missing values pair with nothing.
    """
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull())
    rows = rows.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.size("embedding").alias("width"))
    sizes = rows.groupBy("label", "width").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.ceil(F.col("n") / BLOCKS)))).cast("int")
    placed = rows.join(sizes.select("label", "width", blocks.alias("blocks")), ["label", "width"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks")).cast("int"))
    placed = placed.join(buckets, "vec_id") if buckets is not None else placed
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other").repartition("label", "width", "i", "j")  # else a label stays in one task, where the join has put it


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first value to the last, as column functions and SQL sum."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _percent(cosine: np.ndarray) -> np.ndarray:
    return (np.clip(cosine, -1, 1) + 1) * 50


def _near(a: np.ndarray, b: np.ndarray, same: bool, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, scores) of the pairs of unit vectors that reach the threshold; each pair once if a and b are the same."""
    bar = (threshold - 0.5 - SLACK) / 50 - 1
    step = max(1, CELLS // max(1, len(b)))
    for at in range(0, len(a), step):
        first = at if same else 0
        cosines = a[at : at + step] @ b[first:].T
        found = np.flatnonzero(cosines >= bar)
        for k in range(0, len(found), CHUNK):
            p, q = np.divmod(found[k : k + CHUNK], cosines.shape[1])
            score = _percent(cosines[p, q])
            p, q = p + at, q + first
            tied = np.flatnonzero(np.abs(score - np.floor(score) - 0.5) < SLACK)
            score[tied] = _percent(_in_order(a[p[tied]], b[q[tied]]))
            score = np.floor(score) + (score - np.floor(score) >= 0.5)
            kept = (score >= threshold) & ((p < q) | (not same))
            yield p[kept], q[kept], score[kept].astype(np.int32)


def _sides(key: tuple, batches: Iterator[pa.RecordBatch], bucketed: bool = False) -> tuple[bool, list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]]:
    """Whether a block meets itself, and of each side the ids, unit vectors and sets of buckets (bits of numbers, if asked for)."""
    width, i, j = (k.as_py() for k in key[1:])
    ids, vectors, blocks, sets = [], [], [], []
    for batch in batches:
        x = np.asarray(batch.column("embedding").flatten(), dtype=np.float64).reshape(-1, width)
        with np.errstate(all="ignore"):
            length = np.sqrt(_in_order(x, x))
            good = (length > 1e-12) & (length < np.inf)  # as similarity.normalised_vector has it
            vectors.append((x / length[:, None])[good])
        ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False)[good])
        blocks.append(batch.column("block").to_numpy(zero_copy_only=False)[good])
        if bucketed:
            codes, held = batch.column("buckets"), np.zeros((len(x), BUCKETS), bool)
            held[np.repeat(np.arange(len(x)), codes.value_lengths().to_numpy(zero_copy_only=False)), codes.flatten().to_numpy(zero_copy_only=False)] = True
            sets.append(np.packbits(held[good], axis=1).view(np.uint64))
    ids, vectors, blocks = (np.concatenate(x) for x in (ids, vectors, blocks))
    side = lambda at: (ids[blocks == at], vectors[blocks == at], np.concatenate(sets)[blocks == at] if bucketed else None)
    return i == j, [side(i), side(j)]


def near_pairs(rows: DataFrame, threshold: int, buckets: DataFrame | None = None) -> DataFrame:
    """(l, r, score): all pairs of rows (vec_id, label, embedding) of a label whose cosine percent reaches the threshold, l being the smaller id.

    buckets: (vec_id, buckets), one row for each id, with the numbers of buckets of which two ids must have one in common.
    """
    bucketed = buckets is not None

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, ((ids, a, held), (others, b, held_b)) = _sides(key, batches, bucketed)
        for p, q, score in _near(a, b, same, threshold):
            l, r = ids[p], others[q]
            kept = l != r
            if bucketed:
                kept &= (held[p] & held_b[q]).any(axis=1)
            l, r = l[kept], r[kept]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(l, r)), pa.array(np.maximum(l, r)), pa.array(score[kept])], ["l", "r", "score"])

    return _meetings(rows, buckets).groupBy("label", "width", "i", "j").applyInArrow(compare, "l long, r long, score int")


def _joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """root, by node the smallest node of its component, after nodes p and q are linked."""
    while len(p):
        low, high = np.minimum(root[p], root[q]), np.maximum(root[p], root[q])
        apart = low < high
        p, q, low, high = p[apart], q[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while (root != (up := root[root])).any():
            root = up
    return root


def near_links(rows: DataFrame, threshold: int) -> DataFrame:
    """(l, r): edges that connect what near_pairs connects, at most one for each row where two blocks meet.

    Where blocks meet, each id is linked to the smallest one that it reaches there; blocks that are one
    component already need not be compared further.
    """

    def connect(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, ((ids, a, _), (others, b, _)) = _sides(key, batches)
        nodes, at = np.unique(np.concatenate([ids, others]), return_inverse=True)
        root = np.arange(len(nodes))
        for p, q, _ in _near(a, b, same, threshold):
            root = _joined(root, at[p], at[len(ids) + q])
            if not root.any():
                break
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root[linked]]), pa.array(nodes[linked])], ["l", "r"])

    return _meetings(rows).groupBy("label", "width", "i", "j").applyInArrow(connect, "l long, r long")
