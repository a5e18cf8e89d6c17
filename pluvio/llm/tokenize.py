"""Token ids of whole texts, word by word, with a bounded cache of encoded words.

The JVM splits texts into words by the byte-level pattern; a Python task
encodes each distinct word once with the tokenizers library (a word alone gets
the ids it gets in a text, as merges never cross words) and lays the ids of
each text together with Arrow ``take``.  Known words and their ids are Arrow arrays: no Python
object is made for a word that is known, and a task's cache is some tens of MB.  Texts that
hold a special token's string go whole through the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import UNICODE_SPACE, whole_text

#: The split pattern of byte-level vocabularies (fixed, published), with Unicode white space.
WORDS = (
    "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+"
    f"| ?[^{UNICODE_SPACE}\\p{{L}}\\p{{N}}]+|[{UNICODE_SPACE}]+(?![^{UNICODE_SPACE}])|[{UNICODE_SPACE}]+"
)
#: Words kept per task; the cache starts anew beyond it.
CACHED_WORDS = 400_000
#: Words joined by a special token's string into one text for the library.
JOINED_WORDS = 4_000
#: Words handled at once, which bounds a task's memory whatever the batch holds.
SLICE_WORDS = 250_000
#: Words whose ids are Python numbers at once.
CODED_WORDS = 10_000
#: First UTF-8 byte of the last code points (up to U+023F) whose classes all Unicode tables agree on.
PLAIN_BYTE = 0xC8

_LOADED: dict[str, WordEncoder] = {}


def byte_signs() -> np.ndarray:
    """The code point that stands for each byte in byte-level vocabularies (fixed, published)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = np.zeros(256, "<u4")
    signs[own] = own
    signs[[b for b in range(256) if b not in own]] = range(256, 512 - len(own))
    return signs


def span(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The borders of a string or binary array's values in their bytes, and these bytes."""
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    cuts = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    return cuts - cuts[0], data[cuts[0] : cuts[-1]]


class WordEncoder:
    """Encoded words of one tokenizer file: word -> ids as little-endian uint16 or uint32."""

    #: The code points for bytes, if the library does no more than give a word's to its model.
    signs: np.ndarray | None = None

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.forget()
        split = self.lib.pre_tokenizer
        if (
            self.lib.normalizer is None and isinstance(self.lib.model, models.BPE)
            and isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
        ):
            self.signs = byte_signs()
        # the special token separates words: the library splits a text there before anything else, and no
        # word holds it (texts with a special string go whole); no end of it is its beginning, so none
        # arises across a border
        added = list(self.lib.get_added_tokens_decoder().items())
        alone = len(added) == 1 and not (added[0][1].lstrip or added[0][1].rstrip or added[0][1].single_word)
        text = added[0][1].content if alone else ""
        alone = alone and not any(text.startswith(text[i:]) for i in range(1, len(text)))
        self.joint = (added[0][0], text) if alone else None

    @staticmethod
    def of(path: str) -> WordEncoder:
        if path not in _LOADED:
            _LOADED[path] = WordEncoder(path)
        return _LOADED[path]

    def ids(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def forget(self) -> None:
        self.known, self.coded = pa.array([], pa.string()), pa.array([], pa.binary())

    def words(self, words: pa.StringArray) -> pa.BinaryArray:
        """The ids of each word; those of the words met are kept."""
        if len(self.known) > CACHED_WORDS:
            self.forget()
        n = len(self.known)
        both = pa.concat_arrays([self.known, words]).dictionary_encode()  # the known words keep their places
        self.coded = pa.concat_arrays([self.coded, self.encode_new(both.dictionary[n:])])
        self.known = both.dictionary
        return self.coded.take(both.indices[n:])

    def encode_new(self, words: pa.StringArray) -> pa.BinaryArray:
        """Words below U+0240 go to the library's model as the byte signs its splitter makes of them, which it leaves whole;
        of others its tables may know other classes than the JVM's, so it splits them itself."""
        if self.signs is None:
            return pa.array(self.encode_words(words.to_pylist()), pa.binary())
        model, done = self.lib.model, [pa.array([], pa.binary())]
        for i in range(0, len(words), CODED_WORDS):
            some = words[i : i + CODED_WORDS]
            cuts, data = span(some)
            odd = np.zeros(len(some), bool)
            odd[np.searchsorted(cuts, np.flatnonzero(data > PLAIN_BYTE), "right") - 1] = True
            text, at = self.signs[data].tobytes().decode("utf-32-le"), cuts.tolist()
            rest = self.encode_words(list(compress(some.to_pylist(), odd)) if odd.any() else [])
            ids = [
                np.frombuffer(next(rest), self.width).tolist() if o else [t.id for t in model.tokenize(text[a:b])]
                for o, a, b in zip(odd.tolist(), at[:-1], at[1:], strict=True)
            ]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(list(map(len, ids)), out=ends[1:])
            flat = np.fromiter(chain.from_iterable(ids), self.width, int(ends[-1]))
            ends *= self.width.itemsize
            done.append(pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(flat)]))
        return pa.concat_arrays(done)

    def encode_words(self, words: list[str]) -> Iterator[bytes]:
        if self.joint:
            mark, text = self.joint
            for i in range(0, len(words), JOINED_WORDS):  # one group at a time: the library's result takes some 100 bytes a token
                [e] = self.lib.encode_batch_fast([text.join(words[i : i + JOINED_WORDS])], add_special_tokens=False)
                ids = np.array(e.ids, self.width)
                cuts, data = np.flatnonzero(ids == mark) * self.width.itemsize, ids.tobytes()
                starts, ends = [0, *(cuts + self.width.itemsize).tolist()], [*cuts.tolist(), len(data)]
                yield from (data[a:b] for a, b in zip(starts, ends, strict=True))
            return
        for e in self.lib.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(e.ids, self.width).tobytes()

    def texts(self, words: pa.ListArray) -> list[bytes]:
        """The ids of each text, given as its list of words."""
        at, data = span(self.words(words.flatten()))
        data = memoryview(data)
        ends = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        cuts = at[ends].tolist()
        return [bytes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def split_words(text: Column) -> Column:
    """The words of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def word_columns(docs: DataFrame, id_col: str, text_col: str, specials: list[str]) -> DataFrame:
    """_id, _words (null for a text with a special string) and _whole (that text, else null)."""
    text = whole_text(text_col)
    special: Column = F.lit(False)
    for s in specials:
        special = special | text.contains(s)
    return docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.when(~special, split_words(text)).alias("_words"),
        F.when(special, text).alias("_whole"),
    )


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_WORDS) -> Iterator[pa.RecordBatch]:
    """Consecutive rows that hold about ``most`` list entries (one row at least)."""
    sizes = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, list[bytes], np.dtype]]:
    """(identifiers, ids of each text, width) for the batches of ``word_columns``."""
    coder = WordEncoder.of(path)
    try:
        for batch in batches:
            for part in slices(batch, "_words"):
                ids = coder.texts(part.column("_words"))
                whole = part.column("_whole")
                for i in np.flatnonzero(whole.is_valid().to_numpy(zero_copy_only=False)):
                    ids[i] = coder.ids(whole[i].as_py())
                yield part.column("_id").to_pylist(), ids, coder.width
    finally:
        coder.forget()


def special_strings(path: str) -> list[str]:
    """The added tokens' strings of a tokenizer file."""
    import json

    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]
