"""Byte-level BPE: ranked merges folded over distinct words; decoding by concatenation.

``encode_native``: a word's bytes (two hexadecimal digits each) start as single
parts; a fold merges, step by step, the pair whose joint bytes have the lowest
rank, with the ranks in a literal map.  Spark searches a map from its start, so the
literal is an array of many small maps, dealt by CRC-32 of the bytes.

``encode`` does the same fold over the distinct words a task meets, in Python: the
higher-order functions take ten times the time the limits allow (README).  Texts
need no shuffle.  Decoding looks up every id's bytes and concatenates them.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import whole_text
from pluvio.llm.tokenize import WordEncoder, slices, split_words

_NONE = 1 << 30


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def id_hex(rank: int) -> str:
    """An id as the hexadecimal digits of its little-endian unsigned 32-bit form."""
    return rank.to_bytes(4, "little").hex().upper()


def bucketed(entries: dict[str, object], kind: str) -> tuple[Column, int]:
    """A literal array of small maps with ``entries`` (ASCII keys), and its length."""
    n = max(1, 1 << (len(entries)).bit_length())
    cells: list[dict] = [{} for _ in range(n)]
    for k, v in entries.items():
        cells[zlib.crc32(k.encode()) % n][k] = v
    return F.from_json(F.lit(json.dumps(cells)), f"array<map<string,{kind}>>"), n


def lookup(literal: tuple[Column, int], key: Column) -> Column:
    """The entry of ``key``, else null."""
    cells, n = literal
    return F.try_element_at(F.get(cells, (F.crc32(key.cast("binary")) % n).cast("int")), key)


def fold(word: Column, ranks: tuple[Column, int]) -> Column:
    """The parts (hexadecimal strings) into which ranked merges take the bytes of ``word`` (hexadecimal)."""
    pair_rank = lambda a, b: F.coalesce(lookup(ranks, F.concat(a, b)), F.lit(_NONE))
    n = (F.length(word) / 2).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(word, 2 * i + 1, F.lit(2)))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: pair_rank(
        F.substr(word, 2 * i + 1, F.lit(2)), F.substr(word, 2 * i + 3, F.lit(2))
    ))).otherwise(F.array().cast("array<int>"))
    start = F.struct(parts.alias("p"), pairs.alias("r"))

    def merge(s: Column, _: Column) -> Column:
        def at(low: Column) -> Column:
            # i: 1-based place of the first pair of the lowest rank; its two parts become one
            def joined(i: Column) -> Column:
                def built(m: Column) -> Column:
                    p, r = s["p"], s["r"]
                    size = F.size(p)
                    before = F.when(i > 1, F.array(pair_rank(F.get(p, i - 2), m))).otherwise(F.array().cast("array<int>"))
                    after = F.when(i + 1 < size, F.array(pair_rank(m, F.get(p, i + 1)))).otherwise(F.array().cast("array<int>"))
                    return F.struct(
                        F.concat(F.slice(p, 1, i - 1), F.array(m), F.slice(p, i + 2, size)).alias("p"),
                        F.concat(F.slice(r, 1, F.greatest(i - 2, F.lit(0))), before, after, F.slice(r, i + 2, size)).alias("r"),
                    )

                return _let(F.concat(F.get(s["p"], i - 1), F.get(s["p"], i)), built)

            return F.when(low >= _NONE, s).otherwise(_let(F.array_position(s["r"], low).cast("int"), joined))

        return F.when(F.size(s["r"]) == 0, s).otherwise(_let(F.array_min(s["r"]), at))

    return F.aggregate(F.sequence(F.lit(1), n), start, merge)["p"]


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_ids(word: Column, ranks: tuple[Column, int], ids: tuple[Column, int]) -> Column:
    """The ids of ``word`` (hexadecimal bytes) as hexadecimal text: whole, else by folded merges."""
    folded = F.array_join(F.transform(fold(word, ranks), lambda p: lookup(ids, p)), "")
    return F.coalesce(lookup(ids, word), folded)


def encode_native(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with expressions alone: every distinct word is folded once by higher-order functions.

    Exact, but the folds are interpreted (about 0.2 ms a word) and every occurrence of a
    word is shuffled to its ids and back; see the README for figures.
    """
    table = read_ranks(ranks_path)
    ranks = bucketed({k.hex().upper(): v for k, v in table.items()}, "int")
    ids = bucketed({k.hex().upper(): id_hex(v) for k, v in table.items()}, "string")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), whole_text(text_col).alias("_text")).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    placed = rows.select(id_col, "_row", F.posexplode_outer(F.transform(split_words(F.col("_text")), lambda w: F.hex(w))).alias("_at", "_word"))
    folded = placed.where("_word IS NOT NULL").select("_word").distinct().withColumn("_ids", word_ids(F.col("_word"), ranks, ids))
    joined = placed.join(folded, "_word", "left").groupBy("_row").agg(
        F.first(id_col).alias(id_col), F.sort_array(F.collect_list(F.struct("_at", "_ids"))).alias("_all")
    )
    return joined.select(id_col, F.unhex(F.array_join(F.col("_all._ids"), "")).alias("ids"))


class RankEncoder(WordEncoder):
    """Distinct words folded by ranked merges in a task, for the rank file at ``path``."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.width = np.dtype("<u4")
        self.forget()
        self.packed = {k: v.to_bytes(4, "little") for k, v in self.ranks.items()}

    def encode_words(self, words: list[str]) -> Iterator[bytes]:
        for word in words:
            data = word.encode()
            yield self.packed.get(data) or b"".join(map(self.packed.__getitem__, self.fold(data)))

    def fold(self, word: bytes) -> list[bytes]:
        """The parts of ``word`` after every merge, lowest joint rank first, leftmost of equals."""
        get = self.ranks.get
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], _NONE)
        return parts


_LOADED: dict[str, RankEncoder] = {}


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _LOADED:
        _LOADED[path] = RankEncoder(path)
    for batch in batches:
        for part in slices(batch, "_words"):
            ids = _LOADED[path].texts(part.column("_words"))
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(ids, pa.binary())], ["_id", "ids"])


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every text as little-endian unsigned 32-bit integers in one binary.

    Null counts as empty and gives an empty binary; special tokens are ordinary text; repeated
    rows are encoded each; an empty table gives an empty result.  Other columns are not read.
    The JVM splits the texts, and a task folds each distinct word it meets once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), split_words(whole_text(text_col)).alias("_words"))
    return rows.mapInArrow(lambda it: _encode(it, ranks_path), "_id long, ids binary").withColumnRenamed("_id", id_col)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = read_ranks(path)
    pieces = [b""] * (max(table.values()) + 1)
    for k, v in table.items():
        pieces[v] = k
    vocabulary = pa.array(pieces, pa.binary())
    for batch in batches:
        texts = []
        for ids in batch.column("ids"):
            got = vocabulary.take(pa.array(np.frombuffer(ids.as_buffer(), "<u4")))
            data = got.buffers()[2] if len(got) else None
            texts.append(data.to_pybytes()[: int(np.frombuffer(got.buffers()[1], np.int32)[len(got)])] if data is not None else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("ids"), pa.array(texts, pa.binary())], ["_id", "ids", "decoded"]
        )


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """``encode``'s rows with decoded: the concatenated bytes of their ids."""
    rows = encoded.select(F.col(id_col).alias("_id"), "ids")
    return rows.mapInArrow(lambda it: _decode(it, ranks_path), "_id long, ids binary, decoded binary").withColumnRenamed("_id", id_col)
