"""Concatenate and cut: all token ids in one stream, cut into fixed windows.

Two passes.  The first encodes the texts and writes their ids with the number
of ids before them in their partition; the partitions' totals, one row each,
are summed up to each partition's offset in the stream.  The second cuts every
text at the window borders its global offset gives, and yields the pieces,
which are the windows' boundary records.  Only the last window has padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvio.llm.common import freed, write_table
from pluvio.llm.tokenize import encoded, special_strings, word_columns

_STREAM = "doc_id long, ids binary, doc_tokens long, part int, before long"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Ids held in one output batch of pieces.
_BATCH_IDS = 500_000


@freed
def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part, before = TaskContext.get().partitionId(), 0
    for keys, texts, width in encoded(batches, path):
        end = np.array([end_id], width).tobytes()
        ids = [t + end for t in texts]
        n = np.array([len(t) // width.itemsize for t in ids], np.int64)
        starts = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(starts)],
            ["doc_id", "ids", "doc_tokens", "part", "before"],
        )


@freed
def _cut(batches: Iterator[pa.RecordBatch], window: int, width: str) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for doc, data, at in zip(batch.column("doc_id"), batch.column("ids"), batch.column("at").to_pylist(), strict=True):
            doc = doc.as_py()
            ids = np.frombuffer(data.as_buffer(), width).astype("<u4")
            start = 0
            while start < len(ids):
                sequence, offset = divmod(at + start, window)
                length = min(window - offset, len(ids) - start)
                rows.append((doc, start, length, len(ids), sequence, offset, ids[start : start + length].tobytes()))
                start += length
                held += length
                if held >= _BATCH_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack(
    docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids as <u4) of every text
    and its end id, laid without gaps into windows of ``window`` ids.

    Null and empty texts are their end id alone; a null identifier stays null; repeated rows are
    packed each; an empty table gives no piece.  Other columns of ``docs`` are not read.
    """
    specials = special_strings(tokenizer)
    stream, _ = write_table(
        word_columns(docs, id_col, text_col, specials).mapInArrow(lambda it: _encode(it, tokenizer, end_id), _STREAM),
        "packing-stream",
    )
    totals = stream.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    # one row per input partition: small whatever the texts are
    base = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = stream.join(F.broadcast(base), "part").select("doc_id", "ids", (F.col("base") + F.col("before")).alias("at"))
    width = _width(tokenizer)
    return placed.mapInArrow(lambda it: _cut(it, window, width), _PIECES)


def _width(tokenizer: str) -> str:
    from pluvio.llm.tokenize import WordEncoder

    return WordEncoder.of(tokenizer).width.str
