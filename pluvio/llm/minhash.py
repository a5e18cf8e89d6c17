"""Near-duplicate documents by fast similarity sketches.

A sketch has t coordinates (bins).  In round i every shingle of a text is hashed to one bin and
to a value i + u with u in [0, 1); a bin keeps its least value, so an earlier round always
wins.  The first t rounds hash to bins at random, round t + j sends all shingles to bin j.  After 2 t
rounds at the latest, and usually after some t log t / n, every bin is filled, so the sketch of a
set of any size has t coordinates; the share of equal coordinates of two sketches is their Jaccard
similarity in expectation, with the concentration of sampling without replacement.

Sketches are cut into bands of ``BAND_ROWS`` coordinates; as many bands as make sets at the
threshold miss each other with a probability of ``MISS`` at most.  Equal sets are one
class with one representative.  Band entries that several representatives share come
out of one range sort, which cuts a frequent entry over tasks; each piece of
an entry links its sets to the piece's first.  Sets verified with their likeliest
partner grow components; what still shares a band in different components is compared pair by
pair where an entry has few sets, and block by block where it has many.  All links are
confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import components, keep, repeated_keys, salted_join, scratch_tables, write_table
from pluvio.llm.ngram_join import Shingler, family_links, few_verified_pairs, near_sizes, set_table, verified_pairs

#: Coordinates of a band.
BAND_ROWS = 6
#: Probability at most that two sets exactly at the threshold share no band.
MISS = 1e-6
#: Sets that share a band entry before they are compared in blocks.
HOT = 16
#: Shingles sketched side by side (one text at least).
SLAB_SHINGLES = 500_000

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def bands_for(num: int, den: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` coordinates that sets of similarity num / den miss with probability ``miss`` at most."""
    meet = (num / den) ** rows
    return 1 if meet >= 1 else math.ceil(math.log(miss) / math.log1p(-meet))


def _hash(x: np.ndarray, number: int) -> np.ndarray:
    """The hash function of that number over 64-bit values."""
    x = x + np.uint64((number * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The sketches of non-empty sets, one row each: round in the upper 16 bits, fraction in the lower 48."""
    out = np.full((len(sets), t), _EMPTY)
    if not len(sets):
        return out
    flat = out.reshape(-1)
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    open_sets = np.arange(len(sets))
    for i in range(2 * t):
        h = _hash(x, i)
        if i < t:
            spot = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            at = owner * t + spot.astype(np.int64)
        else:
            at = owner * t + (i - t)
        # bins filled in an earlier round hold smaller values
        free = (flat[at] >> np.uint64(48)) >= np.uint64(i)
        value = (np.uint64(i) << np.uint64(48)) | (_hash(h, 1) >> np.uint64(16))
        np.minimum.at(flat, at[free], value[free])
        full = (out[open_sets] != _EMPTY).all(axis=1)
        if full.any():
            open_sets = open_sets[~full]
            if not len(open_sets):
                break
            still = np.zeros(len(sets), bool)
            still[open_sets] = True
            stay = still[owner]
            x, owner = x[stay], owner[stay]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of every sketch; keys of different bands differ."""
    out = np.zeros((len(sketch), bands), np.uint64)
    for r in range(rows):
        out = _hash(out ^ sketch[:, r : bands * rows : rows], r)
    return _hash(out ^ np.arange(bands, dtype=np.uint64)[None, :], rows)


_INDEX = "id long, size long, digest binary, bands array<long>"


def _index(batches: Iterator[pa.RecordBatch], n: int, least: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    shingle = Shingler(n)

    def table(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        # a set smaller than ``least`` links with equal ones only
        use = [i for i, s in enumerate(sets) if len(s) >= least]
        keys = band_keys(sketches([sets[i] for i in use], bands * rows), bands, rows).view(np.int64)
        ends = np.zeros(len(sets) + 1, np.int32)
        ends[1:][use] = bands
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.reshape(-1))),
            ],
            ["id", "size", "digest", "bands"],
        )

    for batch in batches:
        ids, sets, held = [], [], 0
        for key, text in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True):
            s = shingle(text.as_py())
            ids.append(key)
            sets.append(s)
            held += len(s)
            if held > SLAB_SHINGLES:
                yield table(ids, sets)
                ids, sets, held = [], [], 0
        if ids:
            yield table(ids, sets)


_STARS = "band long, hub long, hub_size long, id long, size long"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, id), each with the first row of its entry in this task; the
    entries' pieces in different tasks are put together by their hubs."""
    band = hub = hub_size = None
    for batch in batches:
        if not batch.num_rows:
            continue
        b, i, s = (batch.column(c).to_numpy() for c in ("band", "id", "size"))
        head = np.concatenate([[band is None or b[0] != band], b[1:] != b[:-1]])
        first = np.flatnonzero(head)
        at = np.cumsum(head) - 1
        hubs, sizes = i[first], s[first]
        if not head[0]:  # goes on from the batch before
            hubs, sizes, at = np.concatenate([[hub], hubs]), np.concatenate([[hub_size], sizes]), at + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("band"), pa.array(hubs[at]), pa.array(sizes[at]), batch.column("id"), batch.column("size")],
            ["band", "hub", "hub_size", "id", "size"],
        )
        band, hub, hub_size = b[-1], hubs[at[-1]], sizes[at[-1]]


def similar_components(
    docs: DataFrame, shingle_words: int = 5, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest identifier reachable by links), kept (id = component_id).

    Words are runs of anything but ASCII white space, A-Z lower-cased.  Two texts link when
    den * |x & y| >= num * |x | y| for their sets of ``shingle_words``-word shingles; a shorter
    text is one shingle.  Null, empty and blank texts have an empty set, link with nothing and are
    their own component.  Rows that repeat an identifier with equal texts are one document, each
    returned; with different texts, the identifier's links are those of any of them.  A row with a null
    identifier takes no part in links: its component and kept are null.  An empty table gives an empty
    result; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # unequal sets of sizes s < s + 1 reach s / (s + 1) at most
    least = next(s for s in range(1, den + 2) if den * s >= num * (s + 1))
    bands = bands_for(num, den)
    with scratch_tables(spark):
        index, _ = write_table(rows.mapInArrow(lambda it: _index(it, shingle_words, least, bands, BAND_ROWS), _INDEX), "minhash-index")
        known = index.where("digest IS NOT NULL AND id IS NOT NULL")
        classes, _ = write_table(
            known.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.max("size").alias("size"), F.min_by("bands", "id").alias("bands")),
            "minhash-classes",
        )
        # a digest that many rows have is dealt over tasks; single rows are their own representative
        several = classes.where("n > 1").select("digest", "rep")
        member, member_path = write_table(
            salted_join(index.select("id", F.col("size").alias("n_shingles"), "digest"), several, "digest", "id", "left").select(
                "id", "n_shingles", F.coalesce("rep", "id").alias("rep")
            ),
            "minhash-classes",
        )
        entries = classes.select(F.col("rep").alias("id"), "size", F.explode("bands").alias("band"))
        shared, _ = write_table(repeated_keys(entries, ["band"], "id"), "minhash-shared")
        links = _links(rows, shared, shingle_words, num, den)
        keep(member_path)
        grown, grown_path = write_table(components(links, "a", "b", "minhash"), "minhash-components")
        keep(grown_path)
    joined = member.join(grown, member["rep"] == grown["node"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep"))
    return joined.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept")
    )


def _links(texts: DataFrame, shared: DataFrame, shingle_words: int, num: int, den: int) -> DataFrame:
    """Verified links (a, b) between representatives that span every component."""
    sets = set_table(texts, shared.select("id").distinct(), shingle_words)
    starred, _ = write_table(
        shared.repartitionByRange("band", "id").sortWithinPartitions("band", "id").mapInArrow(_stars, _STARS), "minhash-stars"
    )
    # the hubs of an entry's pieces meet the entry's least hub: one row per task and entry
    hubs = starred.where("id = hub").select("band", "hub", "hub_size")
    least = hubs.groupBy("band").agg(F.min(F.struct("hub", "hub_size")).alias("f"), F.count("*").alias("n")).where("n > 1")
    between = hubs.join(least, "band").where("hub > f.hub").select(
        "band", F.col("f.hub").alias("hub"), F.col("f.hub_size").alias("hub_size"), F.col("hub").alias("id"), F.col("hub_size").alias("size")
    )
    star = starred.where("id > hub").unionByName(between).where(near_sizes("hub_size", "size", num, den))
    counted = star.groupBy("id", "hub").agg(F.count("*").alias("n"))
    likeliest = counted.groupBy("id").agg(F.max(F.struct("n", -F.col("hub"))).alias("top"))
    best = likeliest.select((-F.col("top.col2")).alias("a"), F.col("id").alias("b"))
    links, _ = write_table(verified_pairs(best, sets, num, den), "minhash-links")
    # what shares a band in different components: few sets pair by pair, many in blocks
    grown = components(links, "a", "b", "minhash-part")
    placed = shared.join(grown, shared["id"] == grown["node"], "left").select(
        "band", "id", "size", F.coalesce("component", "id").alias("c")
    )
    lit, _ = write_table(placed, "minhash-placed")
    parts = lit.groupBy("band", "c").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    apart = parts.groupBy("band").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("first").alias("first")).where("k > 1")
    here, _ = write_table(salted_join(lit, apart.drop("k"), "band", "id"), "minhash-apart")
    few = here.where(F.col("n") <= HOT)
    l, r = few.alias("l"), few.alias("r")
    pairs = (
        l.join(r, (F.col("l.band") == F.col("r.band")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.c") != F.col("r.c")))
        .where(near_sizes("l.size", "r.size", num, den))
        .select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    )
    more, _ = write_table(few_verified_pairs(pairs, sets, num, den, "minhash"), "minhash-links")
    wide, _ = write_table(family_links(here.where(F.col("n") > HOT), sets, num, den), "minhash-links")
    return links.unionByName(more).unionByName(wide)


def minhash_dedup(
    docs: DataFrame, shingle_words: int = 5, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its component, with all their columns.

    A null identifier takes no part in links, so its rows stay; other cases as ``similar_components``.
    """
    gone = similar_components(docs, shingle_words, num, den, id_col, text_col).where("NOT kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
