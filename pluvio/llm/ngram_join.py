"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A text's set holds the hashes of its word shingles.  Sets are put into size bands
[L, U], U about L / similarity, so that linked sets lie in one band or in neighbouring ones.
Two linked sets, the smaller in band b, differ in at most H_b shingles.  The
hash universe is cut into m_b segments; of each set, every segment's subset is
indexed by its sum of hashes (allocation 1: found when the subsets are equal), and the
subsets of d_b segments also with each one shingle left out (allocation 2: found
when the subsets differ by one).  With m_b + d_b = H_b + 1 + slack_b, linked
sets meet in more than slack_b allocated segments.

The allocation is by cost.  m_b and d_b weigh the index entries against the light
segments (empty or of one shingle), in which strangers meet; and of the entries that more
than HOT sets share, each set drops its hottest, up to slack_b segments' worth (an entry of
a doubled segment counts twice): linked sets still meet elsewhere.  Copies of a
popular text have more and keep the rest.

A set's bands are its own and the one below.  Entries that only one set has go in one
streaming pass over their sorted order.  Of those shared, each set is first verified with one
partner it shares most entries with; then only sets in different components are left,
compared pair by pair where an entry has few sets and block by block where it has many.
A pair counts only when it shares as many entries as linked sets must; a pair that also
shares an entry of many sets is in those blocks.
Verification is exact on the shingle sets.  Equal sets are one class with one
representative throughout, and components grow over classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvio.llm.common import components, drop_table, freed, keep, maybe_among, repeated_keys, salted_join, scratch_tables, write_table

#: Sets that share an entry before it counts as hot.
HOT = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


# -- shingle sets -----------------------------------------------------------
class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; word hashes are kept while they are few."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self.word_hashes(words)
        size = min(self.n, len(h))
        n = len(h) - size + 1
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = _mixed((out ^ h[k : k + n]) * _MIX)
        return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX2
    return x ^ (x >> np.uint64(29))


# -- bands and allocation ---------------------------------------------------
@lru_cache(maxsize=None)
def band_top(band: int, num: int, den: int) -> int:
    """The largest size of a band: 0 first, then every band ends at least one above and about den / num times its start."""
    return 0 if band == 0 else max(band_top(band - 1, num, den) + 1, (band_top(band - 1, num, den) + 1) * den // num)


def band_of(size: int, num: int, den: int) -> int:
    band = 0
    while band_top(band, num, den) < size:
        band += 1
    return band


@lru_cache(maxsize=None)
def allocation(band: int, num: int, den: int) -> tuple[int, int, int]:
    """(segments, segments allocated 2, slack) of a band."""
    top = band_top(band, num, den)
    low = band_top(band - 1, num, den) + 1 if band else 1
    # sizes s <= t <= s den / num and 100 |x & y| >= ... : |x ^ y| <= (s + t)(den - num) / (den + num)
    worst = max(((s + s * den // num) * (den - num)) // (den + num) for s in {low, top})
    slack = 1 + worst // 12
    if worst == 0:
        return 1, 0, 0
    best = None
    for d in range(1, (worst + 1 + slack) // 2 + 1):
        m = worst + 1 + slack - d
        if d > m:
            break
        each = top / m
        light = m * math.exp(-each) * (1 + each)
        cost = m + d * each + 4 * light
        if best is None or cost < best[0]:
            best = (cost, m, d)
    return best[1], best[2], slack


def entries(shingles: np.ndarray, band: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The index entries of a set in a band's segmentation (64-bit; equal entries mean equal
    subsets), and for each whether its segment is allocated 2."""
    m, d, _ = allocation(band, num, den)
    # segments by the top 32 bits, so the sorted hashes are already in segment order
    segment = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    value = _mixed(shingles * _MIX)
    cut = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    sums = total[cut[1:]] - total[cut[:-1]]
    name = _mixed((np.arange(m, dtype=np.uint64) + np.uint64(band << 32) + np.uint64(1)) * _MIX)
    whole = _mixed(sums + name)
    few = cut[d]  # the shingles of the first d segments, each left out once
    seg = segment[:few].astype(np.int64)
    without = _mixed(sums[seg] - value[:few] + name[seg])
    return np.concatenate([whole, without]), np.concatenate([np.arange(m) < d, np.ones(few, bool)]).astype(np.int64)


#: Index rows have entry and meta (size, band and allocation of the segment); one set row per text has size and digest.
_INDEX = "id long, meta long, entry long, size long, digest binary"
_META_BAND, _META_SIZE = 2, 1 << 12
#: Index rows in one output batch.
BATCH_ENTRIES = 200_000


@freed
def _index(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    shingle = Shingler(n)
    names = ["id", "meta", "entry", "size", "digest"]
    for batch in batches:
        keys = batch.column("_id").to_pylist()
        sets: list[tuple] = []
        ids, metas, found, held = [], [], [], 0

        def rows():
            k = sum(map(len, found))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(ids, np.int64), [len(f) for f in found])),
                    pa.array(np.concatenate(metas)),
                    pa.array(np.concatenate(found).view(np.int64)),
                    pa.nulls(k, pa.int64()),
                    pa.nulls(k, pa.binary()),
                ],
                names,
            )

        for key, text in zip(keys, batch.column("_text"), strict=True):
            s = shingle(text.as_py())
            sets.append((len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None))
            own = band_of(len(s), num, den)
            for band in (own, own - 1):
                if key is None or band < 1 or allocation(band, num, den)[0] == 1:
                    continue  # sets this small link only when equal
                if band < own and len(s) * num > band_top(band, num, den) * den:
                    continue  # too large for any set of the band below
                e, twice = entries(s, band, num, den)
                ids.append(key)
                metas.append(len(s) * _META_SIZE + band * _META_BAND + twice)
                found.append(e)
                held += len(e)
            if held > BATCH_ENTRIES:
                yield rows()
                ids, metas, found, held = [], [], [], 0
        if held:
            yield rows()
        if keys:
            size, digest = zip(*sets, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64()),
                 pa.array(size, pa.int64()), pa.array(digest, pa.binary())],
                names,
            )


@freed
def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    shingle = Shingler(n)
    for batch in batches:
        for part in range(0, batch.num_rows, 200):
            rows = batch.slice(part, 200)
            sets = [shingle(t.as_py()).tobytes() for t in rows.column("_text")]
            yield pa.RecordBatch.from_arrays([rows.column("_id"), pa.array(sets, pa.binary())], ["id", "set"])


@freed
def _verified(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            keep.append(den * both >= num * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


# -- the join ---------------------------------------------------------------
def similar_components(
    docs: DataFrame, shingle_words: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_shingles, component_id, the smallest identifier reachable by links.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  Two texts link when
    den * |x & y| >= num * |x | y| for their sets of ``shingle_words``-word shingles; a shorter
    text is one shingle.  Null, empty and blank texts have an empty set, link with nothing and are
    their own component.  Rows that repeat an identifier are one document if their texts are
    equal; identifiers must not be null otherwise (a null one is its own component, null).
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    with scratch_tables(spark):
        index, index_path = write_table(rows.mapInArrow(lambda it: _index(it, shingle_words, num, den), _INDEX), "jaccard-index")
        sets = index.where("size IS NOT NULL").select("id", "size", "digest")
        classes, _ = write_table(
            sets.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")),
            "jaccard-digests",
        )
        # Every text with the representative of its class: equal sets are one node from here on.  A digest that many
        # texts have is dealt over tasks.
        member, member_path = write_table(
            salted_join(sets, classes.where("n > 1").select("digest", "rep"), "digest", "id", "left").select(
                "id", F.col("size").alias("n_shingles"), F.coalesce("rep", "id").alias("rep")
            ),
            "jaccard-classes",
        )
        shared, shared_path = write_table(
            repeated_keys(index.where("entry IS NOT NULL").select("id", "meta", "entry"), ["entry"], "id"), "jaccard-shared"
        )
        drop_table(spark, index_path)
        reps = member.where("id = rep").select("id").distinct()
        links = _links(rows, shared.join(reps, "id", "left_semi"), shared_path, shingle_words, num, den)
        grown, grown_path = write_table(components(links, "a", "b", "jaccard"), "jaccard-components")
        keep(member_path)
        keep(grown_path)
    joined = member.join(grown, member["rep"] == grown["node"], "left")
    return joined.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def _links(texts: DataFrame, shared: DataFrame, shared_path: str, shingle_words: int, num: int, den: int) -> DataFrame:
    """Verified links (a, b) between representatives that span every component; tables go when their successor is written."""
    spark = texts.sparkSession
    meta = F.col("meta")
    own = shared.select(
        "id", "entry", F.floor(meta / _META_SIZE).alias("size"),
        F.floor(meta % _META_SIZE / _META_BAND).cast("int").alias("band"), (meta % 2 + 1).alias("weight"),
    )
    counted = own.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1")
    marked = own.join(counted, "entry").withColumn("hot", F.col("n") > HOT)
    # allocation 0 for the hottest entries of a set, as far as the slack makes up for them (a segment
    # counts its allocation).  All sets drop in one global order, so of the entries two sets share,
    # both together drop no more than the one that goes further down.
    slack = F.udf(lambda band: allocation(band, num, den)[2], "int")
    bands = own.select("band").distinct().withColumn("slack", slack("band"))
    group = Window.partitionBy("id", "band")
    hottest = group.orderBy(F.desc("n"), "entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = marked.join(F.broadcast(bands), "band").withColumn("lost", F.sum(F.when(F.col("hot"), F.col("weight")).otherwise(0)).over(hottest))
    drop = F.col("hot") & (F.col("lost") <= F.col("slack"))
    # what a linked set still shares with this one at least, after both dropped
    need = F.col("slack") + 1 - F.coalesce(F.max(F.when(drop, F.col("lost"))).over(group), F.lit(0))
    kept = ranked.withColumn("need", need).where(~drop).select("entry", "id", "size", "band", "weight", "need")
    used, used_path = write_table(kept, "jaccard-used")
    drop_table(spark, shared_path)

    sets = set_table(texts, used.select("id").distinct(), shingle_words)
    # first: every set with the one it shares most entries with among the entries' smallest
    first = used.groupBy("entry").agg(F.min("id").alias("a"), F.min_by("size", "id").alias("na"))
    star = (
        used.join(first, "entry").where("id > a").where(near_sizes("na", "size", num, den))
        .groupBy("id", "a", "band").agg(F.sum("weight").alias("count"))
    )
    best = star.groupBy("id").agg(F.max(F.struct("count", -F.col("a"))).alias("top")).select((-F.col("top.col2")).alias("a"), F.col("id").alias("b"))
    links, _ = write_table(verified_pairs(best, sets, num, den), "jaccard-links")
    # then: what shares an entry in different components, pair by pair where few share it, else by blocks
    grown = components(links, "a", "b", "jaccard-part")
    lit = used.join(grown, used["id"] == grown["node"], "left").select(
        *used.columns, F.coalesce("component", "id").alias("c")
    )
    apart = lit.groupBy("entry").agg(F.count_distinct("c").alias("k"), F.count("*").alias("n"), F.min("id").alias("first")).where("k > 1")
    here, _ = write_table(lit.join(apart, "entry").drop("k"), "jaccard-apart")
    drop_table(spark, used_path)
    l, r = here.where(F.col("n") <= HOT).alias("l"), here.where(F.col("n") <= HOT).alias("r")
    pairs = (
        l.join(r, (F.col("l.entry") == F.col("r.entry")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.c") != F.col("r.c")))
        .where(near_sizes("l.size", "r.size", num, den))
        .groupBy(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l.band").alias("band"))
        .agg(F.sum("l.weight").alias("shared"), F.min(F.least("l.need", "r.need")).alias("need"))
        .where("shared >= need")
        .select("a", "b").distinct()
    )
    more, _ = write_table(few_verified_pairs(pairs, sets, num, den, "jaccard"), "jaccard-links")
    wide, _ = write_table(family_links(here.where(F.col("n") > HOT), sets, num, den), "jaccard-links")
    return links.unionByName(more).unionByName(wide)


def family_links(here: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components among the texts that share hot entries.

    Strangers share hot entries too, by what many texts quote, and one of them joins thousands, so the
    texts meet by shingles: only those of which one of their rarest is the same are compared, pair by pair where
    a shingle has few texts, else by blocks.
    """
    texts, _ = write_table(here.select("id", "c").distinct(), "jaccard-families")
    rare, rare_path = write_table(rarest_shingles(texts, sets, num, den), "jaccard-rarest")
    apart = rare.groupBy("shingle").agg(
        F.count("*").alias("n"), F.min("id").alias("first"), F.min("c").alias("low"), F.max("c").alias("high")
    ).where("low < high")
    met, _ = write_table(rare.join(apart.drop("low", "high"), "shingle"), "jaccard-met")
    drop_table(texts.sparkSession, rare_path)
    l, r = met.where(F.col("n") <= HOT).alias("l"), met.where(F.col("n") <= HOT).alias("r")
    # at the first shingle that two sets share, what follows it in either bounds what they share
    after = F.least(F.col("l.size") - F.col("l.place"), F.col("r.size") - F.col("r.place"))
    pairs = (
        l.join(r, (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.c") != F.col("r.c")))
        .where(near_sizes("l.size", "r.size", num, den))
        .where((after + 1) * (num + den) >= (F.col("l.size") + F.col("r.size")) * num)
        .select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    )
    few, _ = write_table(few_verified_pairs(pairs, sets, num, den, "jaccard"), "jaccard-links")
    return few.unionByName(block_links(met.where(F.col("n") > HOT), sets, num, den))


@freed
def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "c", "text", "size", "shingle"]
    for batch in batches:
        at, ends = 0, np.cumsum([len(s.as_buffer()) // 8 for s in batch.column("set")])
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_ENTRIES, "right")))
            part = batch.slice(at, upto - at)
            found = [np.frombuffer(s.as_buffer(), np.int64) for s in part.column("set")]
            size = np.array([len(f) for f in found])
            text = np.array([xxhash.xxh3_64_intdigest(f) for f in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(x, size)) for x in (part.column("id").to_numpy(), part.column("c").to_numpy(), text, size)]
                + [pa.array(np.concatenate(found))],
                names,
            )
            at = upto


def rarest_shingles(texts: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of each of the ``texts`` (id, c) the rarest shingles, as far as a linked text may share none of them before.

    Shingles are ordered by the number of texts that have them, those within one component first.  A set of s shares
    at least num s / den with any linked one; were the first shared shingle not among the first s - num s / den + 1 of
    both, too few would be left to share.  Shingles of one component take their places but link nothing, so they are not
    returned.
    """
    chosen = texts.join(maybe_among(sets, "id", texts.select("id")), "id").select("id", "c", "set")
    every, _ = write_table(chosen.mapInArrow(_exploded, "id long, c long, text long, size long, shingle long"), "jaccard-exploded")
    spread, _ = write_table(
        every.groupBy("shingle").agg(F.count("*").alias("held"), F.min("c").alias("low"), F.max("c").alias("high"))
        .where("low < high").select("shingle", "held"),
        "jaccard-spread",
    )
    common = maybe_among(every, "shingle", spread.select("shingle")).join(spread, "shingle")
    group = Window.partitionBy("id", "text")
    place = F.col("size") - F.count("*").over(group) + F.row_number().over(group.orderBy("held", "shingle"))
    return common.withColumn("place", place).where(F.col("place") <= F.col("size") - F.expr(f"(size * {num} + {den - 1}) div {den}") + 1).select(
        "shingle", "id", "c", "size", "place"
    )


#: Texts of a family compared at once with as many others.
BLOCK = 256


def block_links(here: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components among the texts that share a shingle of ``here`` (id, c, first: the least id that has it).

    A family is what these shingles connect (copies of one popular text).  The texts outside its
    largest component are compared with all of the family, in blocks against blocks, so no pair
    is a row: a text is sent once to every block it has to meet.
    """
    family = components(here.where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b")), "a", "b", "jaccard-family")
    named = here.select("id", "c").distinct().join(family, F.col("id") == F.col("node"), "left").select(
        "id", "c", F.coalesce("component", "id").alias("family")
    )
    texts, _ = write_table(named, "jaccard-blocks")
    sizes = texts.groupBy("family", "c").count()
    largest = sizes.groupBy("family").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
    plan = largest.where("most < `all`").select(
        "family", "main",
        F.ceil(F.col("most") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("others"),
    )
    spot = F.pmod(F.xxhash64("id"), F.when(F.col("c") == F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    # blocks of others are -1, -2, ...; those of the largest component 0, 1, ...
    own = texts.join(plan, "family").withColumn("block", F.when(F.col("c") == F.col("main"), spot).otherwise(-1 - spot))
    other = F.transform(F.sequence(F.lit(1), "others"), lambda x: -x)
    main = F.sequence(F.lit(0), F.col("mains") - 1)
    meets = own.withColumn("with", F.explode(F.when(F.col("block") < 0, F.concat(other, main)).otherwise(other)))
    sent = meets.select(
        "family", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "c"
    )
    return sent.join(maybe_among(sets, "id", own.select("id")), "id").groupBy("family", "i", "j").applyInArrow(lambda t: _block_links(t, num, den), "a long, b long")


def _block_links(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links between the two blocks (or within the one) that join different components; a spanning part of them."""
    table = table.combine_chunks()
    ids, c, block = (table.column(x).to_numpy() for x in ("id", "c", "block"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
    sizes = np.array([len(x) for x in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[code] > 1
    code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, (int(code.max()) + 1) if len(code) else 0, 4096):
        part = (code >= at) & (code < at + 4096)
        here = np.zeros((len(sets), 4096), np.float32)
        here[owner[part], code[part] - at] = 1
        both += here @ here.T
    x, y = np.nonzero(np.triu(den * both >= num * (sizes[:, None] + sizes[None, :] - both), 1))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    use = (c[x] != c[y]) & ((block[x] != block[y]) | (i == j))
    group = {int(k): int(k) for k in np.unique(c)}

    def root(k: int) -> int:
        while group[k] != k:
            k = group[k]
        return k

    out = []
    for p, q in zip(x[use].tolist(), y[use].tolist(), strict=True):
        a, b = root(int(c[p])), root(int(c[q]))
        if a != b:
            group[a] = b
            out.append((int(ids[p]), int(ids[q])))
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


def near_sizes(a: str, b: str, num: int, den: int):
    return (F.least(a, b) * den) >= (F.greatest(a, b) * num)


def set_table(texts: DataFrame, ids: DataFrame, shingle_words: int) -> DataFrame:
    """The shingle sets of the texts that share an entry with another, and of a few others; no text is shuffled."""
    wanted = maybe_among(texts, "_id", ids)
    return write_table(wanted.mapInArrow(lambda it: _sets(it, shingle_words), "id long, set binary"), "jaccard-shingles")[0]


def verified_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(lambda it: _verified(it, num, den), "a long, b long")


def few_verified_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """``verified_pairs`` of pairs that hold few of the sets: the others are not sent."""
    known, _ = write_table(pairs, f"{name}-pairs")
    ids = known.select(F.explode(F.array("a", "b")).alias("id"))
    return verified_pairs(known, maybe_among(sets, "id", ids), num, den)


def near_dedup(
    docs: DataFrame, shingle_words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its component, with all their columns."""
    found = similar_components(docs, shingle_words, num, den, id_col, text_col)
    stay = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_stay")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["_stay"]), "left_semi")
