"""Packed token-id matrices by best-fit-decreasing.

Texts are encoded, overlong ones are split without loss into rows of the
matrix width, and the pieces are dealt by hash to shards of about equal tokens.
Each shard packs its pieces longest first into the fullest row that still
holds them; a segment tree over free capacities finds it in logarithmic time.  A row
carries its ids, the cumulative lengths of its segments (cu_seqlens) and
position numbers that start anew at every segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import freed, whole_text
from pluvio.llm.tokenize import encoded, special_strings, word_columns

#: Bytes of text a shard is planned for; their ids are about half as many bytes.
SHARD_BYTES = 8 << 20

_PIECES = "doc_id long, start long, doc_tokens long, ids binary"
PACKED = (
    "shard int, row int, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, "
    "ids binary, positions binary"
)


class CapacityTree:
    """Rows by free capacity 0..width; ``take(n)`` gives one with the least capacity of n or more."""

    def __init__(self, width: int):
        self.leaves = 1 << (width + 1 - 1).bit_length() if width else 1
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def put(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._add(capacity, 1)

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of the best fit, or None."""
        at = least + self.leaves
        if not self.count[at]:
            # climb until a right sibling holds a row, then go down its left edge
            while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not self.count[at]:
                    at += 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of positions in ``lengths`` (each 1..width), longest first, ties by position."""
    tree, rows = CapacityTree(width), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = tree.take(lengths[i])
        if got is None:
            free, row = width, len(rows)
            rows.append([])
        else:
            free, row = got
        rows[row].append(i)
        if free > lengths[i]:
            tree.put(free - lengths[i], row)
    return rows


@freed
def _split(batches: Iterator[pa.RecordBatch], path: str, width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    for keys, texts, kind in encoded(batches, path):
        end, step = np.array([end_id], kind).tobytes(), width * kind.itemsize
        doc, start, total, ids = [], [], [], []
        for key, text in zip(keys, texts, strict=True):
            text += end
            for at in range(0, len(text), step):
                doc.append(key)
                start.append(at // kind.itemsize)
                total.append(len(text) // kind.itemsize)
                ids.append(text[at : at + step])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
            ["doc_id", "start", "doc_tokens", "ids"],
        )


def _pack_shard(table: pa.Table, width: int, kind: str, pad_id: int) -> pa.Table:
    dtype = np.dtype(kind)
    table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
    docs, starts = table.column("doc_id").to_pylist(), table.column("start").to_pylist()
    ids = [np.frombuffer(b.as_buffer(), dtype) for b in table.column("ids")]
    shard = table.column("shard")[0].as_py()
    out: list[tuple] = []
    for row, members in enumerate(best_fit_decreasing([len(x) for x in ids], width)):
        matrix, positions = np.full(width, pad_id, dtype), np.zeros(width, "<u4")
        cu = [0]
        for i in members:
            a, b = cu[-1], cu[-1] + len(ids[i])
            matrix[a:b], positions[a:b] = ids[i], np.arange(b - a)
            cu.append(b)
        out.append((shard, row, cu[-1], [docs[i] for i in members], [starts[i] for i in members], cu, matrix.tobytes(), positions.tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = ["shard", "row", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "positions"]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def pack_matrices(
    docs: DataFrame, tokenizer: str, width: int = 2048, end_id: int = 1, pad_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Rows of the packed matrices: shard, row, n_tokens, doc_ids, starts, cu_seqlens, ids, positions.

    Every id of every text and its end id lies in exactly one row; a text longer than
    ``width`` becomes pieces of ``width`` and a rest, and ``starts`` has the ids before each.
    ``ids`` are little-endian uint16 (uint32 for vocabularies over 65,536), padded with
    ``pad_id``; ``positions`` are uint32.  Null and empty texts are their end id alone, repeated rows are
    packed each, an empty table gives no row.  A row holds pieces of one shard only.
    """
    total = docs.agg(F.sum(F.octet_length(whole_text(text_col)) + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    from pluvio.llm.tokenize import WordEncoder

    kind = WordEncoder.of(tokenizer).width.str
    specials = special_strings(tokenizer)
    pieces = word_columns(docs, id_col, text_col, specials).mapInArrow(lambda it: _split(it, tokenizer, width, end_id), _PIECES)
    dealt = pieces.select(F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "start", "ids")
    return dealt.groupBy("shard").applyInArrow(lambda t: _pack_shard(t, width, kind, pad_id), PACKED)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Parquet of fixed-width binary rows, one folder per call; read back with ``numpy.frombuffer``."""
    packed.write.option("compression", "zstd").parquet(path)
