"""Periodic runs of words by a dictionary of basic factors.

A run is a longest stretch of words in which words ``p`` apart are equal, ``p`` being the
smallest such distance; it holds at least three periods.  The dictionary names the
factors of 1, 2, 4, ... words: a factor of twice the length is the pair of names of its
halves, and only factors that occur again go on to the next length, so common text
is left after a few lengths.  At each length the successor of an occurrence (the next
one of the same factor) within twice the length proposes its distance as a period:
positions side by side with one distance are an arithmetic progression of occurrences and
stretch the proposal to both sides as far as the distance lasts.

A run of period p holds three periods, so at a length of p or more every factor that
starts in it has its successor exactly p further on.  A distance of at most the length is
therefore settled by its stretch of positions, which is the whole run; a longer one is
proposed again, stretched further, at twice the length.  Each period is reported
at the first length that settles it, so nothing is reported twice.

Texts are whole and handled side by side in slabs, in time n log n and memory
proportional to the words of a slab (one text at least).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes handled at once (one text at least).
SLAB_BYTES = 8_000_000

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ROWS = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def find_runs(words: np.ndarray, text: np.ndarray, min_length: int, min_periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in the word codes of texts laid end to end.

    ``text`` numbers the text of every word; no run crosses texts.
    """
    if min_periods < 3:
        raise ValueError("a run has at least three periods")
    n = len(words)
    found = [np.zeros((3, 0), np.int64)]
    place = np.arange(n)
    name = words.astype(np.int64) * (int(text.max(initial=0)) + 1) + text
    size = 1
    while len(place):
        order = np.argsort(name, kind="stable")
        at, key = place[order], name[order]
        same = key[1:] == key[:-1]
        gap = at[1:] - at[:-1]
        near = same & (gap <= 2 * size)
        settled = near & (gap <= size) & (2 * gap > size)
        i, d = at[:-1][settled], gap[settled]
        if len(i):
            order = np.argsort(i)
            i, d = i[order], d[order]
            first = np.concatenate([[0], np.flatnonzero((i[1:] != i[:-1] + 1) | (d[1:] != d[:-1])) + 1])
            period = d[first]
            length = np.diff(np.append(first, len(i))) + (size - 1) + period
            whole = (length >= min_length) & (length >= min_periods * period)
            found.append(np.stack([i[first], length, period])[:, whole])
        # the factors that occur again, by name; pairs of them are the factors of twice the size
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        number = np.concatenate([[0], np.cumsum(~same)])
        rank = np.full(n, -1, np.int64)
        rank[at[again]] = number[again]
        place = np.sort(at[again])
        place = place[place + size < n]
        place = place[rank[place + size] >= 0]
        name = rank[place] * (number[-1] + 1) + rank[place + size]
        size *= 2
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _slabs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + SLAB_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _run_rows(batches: Iterator[pa.RecordBatch], min_length: int, min_periods: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for slab in _slabs(batch):
            texts = [t.split() for t in slab.column("_text").to_pylist()]
            counts = np.array([len(w) for w in texts], np.int64)
            ends = np.cumsum(counts)
            flat = [w for words in texts for w in words]
            codes = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(texts)), counts)
            start, length, period = find_runs(codes, text, min_length, min_periods)
            owner = text[start] if len(start) else start
            # words behind a run's first period: one difference array over the slab
            step = np.zeros(len(flat) + 1, np.int64)
            np.add.at(step, start + period, 1)
            np.add.at(step, start + length, -1)
            kept = (np.cumsum(step[:-1]) == 0) if len(start) else None
            collapsed = [b" ".join(words) for words in texts]
            for t in np.unique(owner).tolist():
                a, b = int(ends[t] - counts[t]), int(ends[t])
                collapsed[t] = b" ".join([flat[k] for k in (np.flatnonzero(kept[a:b]) + a).tolist()])
            runs = pa.StructArray.from_arrays(
                [pa.array(start - (ends - counts)[owner] if len(start) else start), pa.array(length), pa.array(period)], fields=list(_RUN)
            )
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [slab.column("_id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(collapsed, pa.binary())],
                ["id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(
    docs: DataFrame, min_length: int = 24, min_periods: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_words, runs (array of start, length, period, in words, by start then
    period) and collapsed, the words outside every run's repeated part joined by one space.

    Words are runs of anything but ASCII white space.  A run has at least ``min_length`` words and
    ``min_periods`` (three or more) periods; of each run the first period stays in ``collapsed``.
    Null, empty and blank texts have no words, no runs and an empty ``collapsed``.  Rows are
    judged each on its own, so repeated rows and null identifiers come back as they are.  An empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"),
    )
    found = rows.mapInArrow(lambda it: _run_rows(it, min_length, min_periods), _ROWS)
    return found.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
