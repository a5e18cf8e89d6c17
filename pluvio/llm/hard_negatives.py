"""Hard-negative mining with Fagin's threshold algorithm.

The rows are dealt by a hash of their identifier into blocks of bounded size; every
block meets the anchors, a bounded number at a time, in a task of its own.  A block keeps,
per dimension, its rows in the order of that component.  For an anchor the lists are read from the
end its sign favours (largest first for a positive component, smallest first for a negative
one), all lists to the same depth; every row met for the first time is scored by random access to
its whole vector.  The threshold, the score of a vector made of the last components read, bounds every
row not met yet.  Reading stops when it is strictly below the k-th score of each window (or
below the window itself), so that rows with equal scores are all met and ties are settled by identifier.

Two passes: the first finds the anchors' positives, and their scores give the windows in
which the second finds the negatives.  The blocks' best rows are merged over
the anchor; every score is an exact integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from pluvio.llm.common import write_table

#: Rows of a block: its vectors and sorted lists are a few tens of MB at 64 dimensions.
BLOCK_ROWS = 16_384
#: Anchors that meet a block in one task.
BLOCK_ANCHORS = 32_768
#: Depth of the first sorted access; every next one goes twice as far.
FIRST_DEPTH = 16

_BEST = "anchor_id long, id long, score long"


def _matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """Integer-valued components as rows; shorter vectors are filled up with zeros."""
    column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _exact(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices, equally wide, in the narrowest type in which all inner products are exact."""
    width = max(a.shape[1], x.shape[1])
    a, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, x))
    most = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(width, 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    if kind is object:  # Python integers
        return (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (a, x))
    return a.astype(kind), x.astype(kind)


class SortedLists:
    """Rows with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32, order="C")
        self.value = np.take_along_axis(x, self.order.T, 0).T

    def access(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, object]]:
        """(rows met for the first time, threshold of all rows not met), list by list to the same depth."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):  # every score is zero: one tie
            yield np.arange(n), None
            return
        seen = np.zeros(n, bool)
        depth, step, met = 0, FIRST_DEPTH, 0
        while met < n:
            upto = min(n, depth + step)
            at = np.concatenate([self.order[up, n - upto : n - depth].ravel(), self.order[down, depth:upto].ravel()])
            fresh = np.unique(at[~seen[at]])
            seen[fresh] = True
            met += len(fresh)
            limit = anchor[up] @ self.value[up, n - upto] + anchor[down] @ self.value[down, upto - 1]
            yield fresh, (limit if met < n else None)
            depth, step = upto, step * 2

    def best(self, anchor: np.ndarray, windows: list[tuple], k: int, use: np.ndarray | None = None) -> dict[int, int]:
        """Row -> score of the first k rows of each window (lowest, highest score; None: open), higher scores first,
        then smaller ids.  ``use`` marks the rows that take part."""
        held = [(np.zeros(0, np.int64), np.zeros(0, self.x.dtype)) for _ in windows]
        for fresh, limit in self.access(anchor):
            if use is not None:
                fresh = fresh[use[fresh]]
            score = self.x[fresh] @ anchor
            done = True
            for w, (low, high) in enumerate(windows):
                inside = np.ones(len(fresh), bool)
                if low is not None:
                    inside = np.asarray((score >= low) & (score <= high), bool)
                rows = np.concatenate([held[w][0], fresh[inside]])
                scores = np.concatenate([held[w][1], score[inside]])
                if len(rows) > k and inside.any():
                    first = np.lexsort((self.ids[rows], -scores))[:k]
                    rows, scores = rows[first], scores[first]
                held[w] = rows, scores
                below = limit is None or (len(rows) == k and limit < scores.min()) or (low is not None and limit < low)
                done = done and below
            if done:
                break
        return {int(r): int(s) for rows, scores in held for r, s in zip(rows.tolist(), scores.tolist(), strict=True)}


def _rows_of(out: list[tuple[int, int, int]]) -> pa.Table:
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "id", "score"), cols, strict=True)})


def _meet(anchors: pa.Table, rows: pa.Table, k: int, scale: float, low: int, high: int, same: bool) -> pa.Table:
    """The first k rows per anchor in one block: of its own label, or of the others per window."""
    if not anchors.num_rows or not rows.num_rows:
        return _rows_of([])
    a, x = _exact(_matrix(anchors.column("vector"), scale), _matrix(rows.column("row_vector"), scale))
    ids = rows.column("row_id").to_numpy()
    label = np.array(rows.column("row_label").to_pylist(), object)
    names = anchors.column("id").to_pylist()
    labels = anchors.column("label").to_pylist()
    out: list[tuple[int, int, int]] = []
    if same:
        lists = {}
        for i, (name, own) in enumerate(zip(names, labels, strict=True)):
            if own not in lists:
                here = np.flatnonzero(label == own)
                lists[own] = SortedLists(ids[here], x[here])
            block = lists[own]
            found = block.best(a[i], [(None, None)], k, block.ids != name)
            out += [(name, int(block.ids[r]), s) for r, s in found.items()]
        return _rows_of(out)
    block = SortedLists(ids, x)
    others = {own: label != own for own in set(labels)}
    for i, (name, scores) in enumerate(zip(names, anchors.column("scores").to_pylist(), strict=True)):
        # low * positive <= 100 * negative <= high * positive, in integers
        windows = sorted({(-(-low * s // 100), high * s // 100) for s in scores})
        found = block.best(a[i], windows, k, others[labels[i]])
        out += [(name, int(ids[r]), s) for r, s in found.items()]
    return _rows_of(out)


def _first(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k rows per key, numbered: higher scores first, then smaller ids."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), a score is the integer inner product.  ``anchors`` is a
    condition on the columns of ``rows``.  An anchor's positives are its first ``positives`` other rows
    of its label; per positive, the first ``negatives`` rows of other labels whose score is between
    ``low`` and ``high`` percent of the positive's are returned (none, if there are none).

    Rows with a null identifier, label or vector, or with a null or non-finite component, take no
    part; rows that repeat an identifier count once (the least by label, then vector).  Vectors of unequal
    length are filled up with zeros.  Equal scores are ordered by identifier.  Scores must fit a long
    (else the task raises).  An empty table, or one without anchors, gives an empty result; other
    columns of ``rows`` are not read.
    """
    spark = rows.sparkSession
    kind = rows.schema[vector_col].dataType
    vector = F.col(vector_col)
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType))):
        vector = vector.cast("array<double>")
    usable = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector.alias("vector"), anchors.alias("is_anchor")
    ).where(
        "id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL "
        "AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    )
    once = usable.groupBy("id").agg(F.min(F.struct("label", "vector", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))).alias("r"))
    table, _ = write_table(once.select("id", "r.*"), "negatives-rows")
    n, n_anchors = table.agg(F.count("*"), F.count(F.when(F.col("is_anchor"), 1))).first()
    blocks, chunks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_anchors // BLOCK_ANCHORS))

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    dealt = table.select(
        F.col("id").alias("row_id"), F.col("label").alias("row_label"), F.col("vector").alias("row_vector"), block,
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
    )

    def meet(who: DataFrame, k: int, same: bool) -> DataFrame:
        chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk")
        sent = who.select("*", chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        return sent.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk")).applyInArrow(
            lambda a, r: _meet(a, r, k, scale, low, high, same), _BEST
        )

    who = table.where("is_anchor").select("id", "label", "vector")
    found = _first(meet(who, positives, True), positives, "anchor_id")
    # a handful of rows per anchor
    best, _ = write_table(found.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    windows = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores"))
    near, _ = write_table(meet(who.join(windows, "id"), negatives, False), "negatives-found")
    inside = near.join(best, "anchor_id").where(
        (low * F.col("positive_score") <= 100 * F.col("score")) & (100 * F.col("score") <= high * F.col("positive_score"))
    )
    return _first(inside, negatives, "anchor_id", "positive_id").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
