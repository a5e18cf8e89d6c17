"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends behind a white space
where the hash of the bytes before it has certain bits zero.  Borders depend
on the last 16 bytes only, so chunks of a passage are the same wherever it
stands and whatever is inserted before it.  From every border, as many pieces as
make ``CHUNK_WORDS`` words are one variable chunk (short pieces alone recur by
chance).  Chunks are matched by digest: those that occur twice or more come out of
one range sort, the first occurrence (least identifier, then place) is the original, and
repeated chunks that overlap or touch make spans.  Each span then grows, word by word,
as long as the words at its edge equal those beside the first occurrence, so that it ends where
the passage does.  A span of at least ``min_words`` words is a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from pluvio.llm.common import drop_table, freed, keep, own_names, repeated_keys, salted_join, scratch_tables, whole_text, write_table

#: A word end is a border when this many high bits of the 16-bit gear hash are zero: a chunk has about 2 ** bits words.
BORDER_BITS = 2
#: Words of a chunk, at least.
CHUNK_WORDS = 8
#: Words of the shortest span; a passage without any chunk of its own is not found, so this is well under the 50 of the passages sought.
MIN_WORDS = 16
#: Words that a span can grow at each edge: a longer edge would hold a chunk but with probability 0.75 ** 40.
EDGE_WORDS = 48
#: Tasks over which the spans that repeat one first occurrence are dealt.
FIRST_SALTS = 4
#: The gear table: 16-bit values of the 256 bytes, by a fixed rule.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=6) & 0xFFFF for b in range(256)], np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def borders(data: np.ndarray, bits: int = BORDER_BITS) -> np.ndarray:
    """The ends of the chunks of ``data`` (UTF-8 bytes), the end of the text included."""
    if not len(data):
        return np.zeros(0, np.int64)
    h = GEAR[data]
    for step in (1, 2, 4, 8):  # h_i = sum of gear(byte i - k) << k, by doubling the window
        h[step:] += h[:-step] << np.uint16(step)
    # word ends: white space behind another sign; the hash is that of the bytes before
    end = np.flatnonzero(_SPACE[data[1:]] & ~_SPACE[data[:-1]]) + 1
    cut = end[(h[end - 1] >> np.uint16(16 - bits)) == 0] + 1
    if not len(cut) or cut[-1] != len(data):
        cut = np.append(cut, len(data))
    return cut


def chunks_of(data: np.ndarray, bits: int = BORDER_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before the start, words before the end) of the chunks of ``data``."""
    ends = borders(data, bits)
    space = _SPACE[data]
    total = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
    starts = np.concatenate([[0], ends[:-1]])
    last = np.searchsorted(total[ends], total[starts] + CHUNK_WORDS)
    whole = last < len(ends)
    starts, last = starts[whole], ends[last[whole]]
    return starts, last, total[starts], total[last]


_CHUNKS = "id long, text_key long, start long, size int, word int, words int, d1 long, d2 int"


@freed
def _chunks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "text_key", "start", "size", "word", "words", "d1", "d2"]
    for batch in batches:
        rows: list[list[np.ndarray]] = []
        held = 0

        def out():
            cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for key, own, text in zip(batch.column("_id").to_pylist(), batch.column("_own").to_pylist(), batch.column("_text"), strict=True):
            raw = bytes(text.as_buffer()) if text.is_valid else b""
            if key is None or not raw:
                continue
            starts, ends, word, upto = chunks_of(np.frombuffer(raw, np.uint8), bits)
            n = len(starts)
            if not n:
                continue
            # the digest is that of the chunk's words: white space around it does not tell chunks apart
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b].strip()) for a, b in zip(starts.tolist(), ends.tolist())), np.int64)
            rows.append([
                np.full(n, key, np.int64), np.full(n, own, np.int64), starts, (ends - starts).astype(np.int32), word.astype(np.int32),
                (upto - word).astype(np.int32), digest[::2], (digest[1::2] & 0x7FFFFFFF).astype(np.int32),
            ])
            held += n
            if held > 500_000:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()


def repeated_spans(
    docs: DataFrame, min_words: int = MIN_WORDS, bits: int = BORDER_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Repeated passages, one row per occurrence: id, start, length (UTF-8 bytes), n_words, first_id, kept.

    ``kept`` marks spans whose chunks occur nowhere earlier (by identifier, then place);
    the others repeat earlier text, ``first_id`` being the least document that holds their first chunk.
    A span ends where its words and those of the first occurrence part, at most ``EDGE_WORDS`` words beyond its
    chunks; a passage in which no chunk of ``CHUNK_WORDS`` words lies whole is not found.
    Spans of one document and kind do not overlap.  ``text_key`` is a hash of identifier and text: rows that
    repeat an identifier with different texts are documents of their own, in the order of that hash; rows
    that repeat both are one place.  Null, empty and short texts have no spans; a null identifier is left
    out; an empty table gives an empty result; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), _text_key(id_col, text_col).alias("_own"), F.col(text_col).cast("string").cast("binary").alias("_text")
    )
    with scratch_tables(spark):
        chunks, path = write_table(rows.mapInArrow(lambda it: _chunks(it, bits), _CHUNKS), "substring-chunks")
        shared, _ = write_table(repeated_keys(chunks, ["d1", "d2"], "id"), "substring-shared")
        drop_table(spark, path)
        found, _ = write_table(_spans(shared), "substring-found")
        texts = rows.where("_id IS NOT NULL").select("_own", "_text")
        spans, path = write_table(_merged(_grown(found, texts)).where(F.col("n_words") >= min_words), "substring-spans")
        keep(path)
    return spans.select(F.col("id").alias(id_col), "start", "length", "n_words", "first_id", (~F.col("again")).alias("kept"), "text_key")


def _text_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _spans(shared: DataFrame) -> DataFrame:
    """The spans that the chunks found twice or more make, one row per span and kind; ``first`` and ``last`` are
    the places (text, byte) where the first chunk begins and the last one ends in their first occurrences."""
    place = F.struct("id", "text_key", "start")
    firsts = shared.groupBy("d1", "d2").agg(F.min(F.struct("id", "text_key", "start", "size")).alias("f"), F.count("*").alias("n"))
    matched = shared.join(firsts.where("n > 1").drop("n"), ["d1", "d2"]).select(
        "id", "text_key", "start", (F.col("start") + F.col("size")).alias("end"), "word", (F.col("word") + F.col("words")).alias("upto"),
        (place != F.struct("f.id", "f.text_key", "f.start")).alias("again"), F.col("f.id").alias("first_id"),
        F.struct("f.text_key", F.col("f.start").alias("at")).alias("first"),
        F.struct("f.text_key", (F.col("f.start") + F.col("f.size")).alias("at")).alias("last"),
    )
    return _runs(matched).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("word").alias("word"), F.max("upto").alias("upto"),
        F.min_by("first_id", "start").alias("first_id"), F.min_by("first", "start").alias("first"), F.max_by("last", "end").alias("last"),
    )


def _runs(pieces: DataFrame) -> GroupedData:
    """``pieces`` grouped by runs that overlap or touch in one document, alike in being a repetition."""
    # a document's pieces are bounded by its text
    order = Window.partitionBy("id", "text_key", "again").orderBy("start")
    begins = F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = pieces.withColumn("_run", F.sum(F.coalesce(begins, F.lit(True)).cast("long")).over(order))
    return runs.groupBy("id", "text_key", "again", "_run")


def _merged(spans: DataFrame) -> DataFrame:
    """Spans that grew into each other put together, one row per span and kind."""
    return _runs(spans).agg(
        F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"),
        (F.max("upto") - F.min("word")).cast("long").alias("n_words"), F.min_by("first_id", "start").alias("first_id"),
    )


@freed
def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text and asked place, the bytes of up to ``EDGE_WORDS`` whole words before or behind it."""
    for batch in batches:
        rows = []
        for key, text, asked in zip(batch.column("_own").to_pylist(), batch.column("_text"), batch.column("asked"), strict=True):
            raw = bytes(text.as_buffer())
            space = _SPACE[np.frombuffer(raw, np.uint8)]
            begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
            end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
            for ask in asked.as_py():
                at, word = ask["at"], int(np.searchsorted(begin, ask["at"]))
                if ask["behind"]:  # one white space behind the last word, as in chunks
                    upto = min(word + EDGE_WORDS, len(begin))
                    edge = raw[at : end[upto - 1] + 1] if upto > word else b""
                else:
                    edge = raw[begin[max(word - EDGE_WORDS, 0)] : at] if word else b""
                rows.append({"text_key": key, "at": at, "behind": ask["behind"], "ref": ask["ref"], "edge": edge})
        kinds = pa.schema([("text_key", pa.int64()), ("at", pa.int64()), ("behind", pa.bool_()), ("ref", _REF), ("edge", pa.binary())])
        yield pa.RecordBatch.from_pylist(rows, kinds)


_REF = pa.struct([("text_key", pa.int64()), ("at", pa.int64()), ("behind", pa.bool_())])
_REF_SQL = "struct<text_key:bigint,at:bigint,behind:boolean>"


def _common(own: bytes, ref: bytes, behind: bool) -> tuple[int, int, int]:
    """(equal words from the place on, their bytes in the one edge, in the other)."""
    a, b = own.split(), ref.split()  # the ASCII white space of the contracts
    if not behind:
        a, b = a[::-1], b[::-1]
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    sizes = []
    for edge in (own, ref):
        at = 0 if behind else len(edge)
        for w in a[:n]:
            at = edge.index(w, at) + len(w) if behind else edge.rindex(w, 0, at)
        sizes.append((min(at + 1, len(edge)) if behind else len(edge) - at) if n else 0)
    return n, *sizes


def _grown(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``found`` spans grown at both edges by the words that they have in common with the first occurrence; a span
    that is a first occurrence grows as far as the farthest of those that repeat it from its edge."""

    @F.pandas_udf("struct<words:int,size:bigint,ref_size:bigint>")
    def common(own: pd.Series, ref: pd.Series, behind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_common(*x) for x in zip(own, ref, behind, strict=True)], columns=["words", "size", "ref_size"])

    def side(at: str, other: str, behind: bool):
        ref = F.struct(f"{other}.text_key", f"{other}.at", F.lit(behind).alias("behind"))
        return F.struct(F.col(at).alias("at"), F.lit(behind).alias("behind"), ref.alias("ref"))

    own = found.where("again").select("text_key", F.explode(F.array(side("start", "first", False), side("end", "last", True))).alias("ask"))
    firsts = own.select("ask.ref.*").distinct().select(
        "text_key", F.struct("at", "behind", F.lit(None).cast(_REF_SQL).alias("ref")).alias("ask")
    )
    # a text's places are bounded by its length
    asked = own.unionByName(firsts).groupBy("text_key").agg(F.collect_set("ask").alias("asked"))
    kinds = f"text_key long, at long, behind boolean, ref {_REF_SQL}, edge binary"
    edges, _ = write_table(
        texts.join(asked, texts["_own"] == asked["text_key"]).select("_own", "_text", "asked").mapInArrow(_edges, kinds)
        .dropDuplicates(["text_key", "at", "behind", "ref"]),  # wholly repeated rows are one place
        "substring-edges",
    )
    first = edges.where("ref IS NULL").select(F.struct("text_key", "at", "behind").alias("ref"), F.col("edge").alias("first_edge"))
    shared = salted_join(edges.where("ref IS NOT NULL"), first, "ref", "text_key", salts=FIRST_SALTS)
    grown, _ = write_table(
        shared.select("text_key", "at", "behind", "ref", common("edge", "first_edge", "behind").alias("c")).where("c.words > 0"), "substring-grown"
    )
    more = grown.select("text_key", "at", "behind", F.lit(True).alias("again"), F.struct("c.words", "c.size").alias("more")).unionByName(
        grown.groupBy("ref").agg(F.max(F.struct("c.words", F.col("c.ref_size").alias("size"))).alias("more"))
        .select("ref.*", F.lit(False).alias("again"), "more")
    )
    before = more.where("NOT behind").select("text_key", F.col("at").alias("start"), "again", F.col("more").alias("_before"))
    behind = more.where("behind").select("text_key", F.col("at").alias("end"), "again", F.col("more").alias("_behind"))
    wide = found.join(before, ["text_key", "again", "start"], "left").join(behind, ["text_key", "again", "end"], "left")
    by = lambda c: F.coalesce(F.col(c), F.lit(0))
    return wide.select(
        "id", "text_key", "again", (F.col("start") - by("_before.size")).alias("start"), (F.col("end") + by("_behind.size")).alias("end"),
        (F.col("word") - by("_before.words")).alias("word"), (F.col("upto") + by("_behind.words")).alias("upto"), "first_id",
    )


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, bits: int = BORDER_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every repeated span but its first occurrence cut out of the text; all rows and columns stay.

    Cases as in ``repeated_spans``: a row loses only what its own text repeats; rows without spans, among
    them null, empty and short texts and null identifiers, stay as they are.
    """
    spans = repeated_spans(docs, min_words, bits, id_col, text_col).where("NOT kept")
    mine_own, mine_key, mine_cuts = own_names("own", "key", "cuts")
    cuts = spans.groupBy(F.col("text_key").alias(mine_key)).agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias(mine_cuts)
    )

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def cut(text, spans):
            data, out, at = text.encode(), [], 0
            for s in spans:
                out.append(data[at : s["start"]])
                at = s["start"] + s["length"]
            return b"".join([*out, data[at:]]).decode("utf-8", "ignore")

        return pd.Series([cut(t, c) for t, c in zip(texts, cuts, strict=True)])

    keyed = docs.withColumn(mine_own, F.when(F.col(id_col).isNotNull(), _text_key(id_col, text_col)))
    joined = keyed.join(cuts, F.col(mine_own) == F.col(mine_key), "left")
    found = F.col(mine_cuts)
    changed = joined.where(found.isNotNull()).withColumn(text_col, without(whole_text(text_col), found))
    return changed.select(*docs.columns).unionByName(joined.where(found.isNull()).select(*docs.columns))
