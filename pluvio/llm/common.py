"""Helpers that several training-data operators share.

* ``write_table`` cuts lineage with a Parquet table under the shared folder
  that ``spark.checkpoint.dir`` names, and has Spark remove the shuffle files of the
  job that wrote it; ``drop_table`` removes a table that no plan needs any more, and
  ``scratch_tables`` all that were written inside it.
* ``salted_join`` joins on a key that may hold a large part of all rows.
* ``repeated_keys`` keeps the rows whose key occurs twice or more: one range
  shuffle on (key, tie) that cuts hot keys across tasks, then a streaming pass
  that holds one key at a time.
* ``components`` labels the connected components of an edge list.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.session import ensure_checkpoint_dir

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
ASCII_SPACE = "[\\x20\\x09-\\x0D]"
#: Unicode White_Space, spelled out because Java's \s is ASCII only.
UNICODE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: Frees a query's shuffle files as soon as it has run, not at some later collection of garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most bytes of one Arrow batch that a task of a written table gets: a batch of 10,000 long texts, or of their lists of
#: words, would be held several times over in the JVM's buffers and in the Python worker.
_BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: The tables written inside the open ``scratch_tables`` blocks, innermost last.
_SCRATCH: list[list[str]] = []


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` under the shared checkpoint folder; (reread table, its path)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    held = {_CLEANUP: "true"} | _BATCH_BYTES
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables written inside when the block ends: its results are to be written outside it, or by ``keep``."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            drop_table(spark, path)


def keep(path: str) -> str:
    """Let a table of the open ``scratch_tables`` block outlive it (it then belongs to the block around)."""
    if _SCRATCH and path in _SCRATCH[-1]:
        _SCRATCH[-1].remove(path)
        if len(_SCRATCH) > 1:
            _SCRATCH[-2].append(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of ``write_table`` whose successor is written."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def freed(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """The generator ``task`` of a Python task, at whose end the worker's unused memory goes back to the system.

    Spark keeps idle workers for later tasks, more of them than an executor has cores after a stage with two Python
    steps; what they would keep of one stage stays beside the JVM in all later ones.
    """

    @wraps(task)
    def run(*args, **named):
        try:
            yield from task(*args, **named)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return run


def own_names(*names: str) -> list[str]:
    """Column names made of ``names`` that no table of a caller has."""
    mark = uuid.uuid4().hex[:8]
    return [f"_{mark}_{n}" for n in names]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key) on ``key``; the rows of a key are dealt over ``salts`` tasks by
    ``spread``, for which each row of ``table`` is repeated: for tables much smaller than ``rows``."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


#: 64-bit words of the bitmap that ``maybe_among`` sends to every task: 8 MB at most, whatever the number of keys.
BITMAP_WORDS = 1 << 19


def maybe_among(rows: DataFrame, key: str, keys: DataFrame, words: int = BITMAP_WORDS) -> DataFrame:
    """The ``rows`` whose ``key`` is in the one column of ``keys``, and a few others (one in twenty with 1.7 million keys).

    For a join that would shuffle all of ``rows`` to find a small part of them.  The hashes of the keys set bits of a
    bitmap of bounded size, which is built by a partial aggregate and broadcast.  (A semi-join above would be
    moved below this by Spark, and shuffle all rows again.)
    """
    word, bit, bits = own_names("word", "bit", "bits")
    spot = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(words * 64))
    marks = keys.where(F.col(keys.columns[0]).isNotNull()).select((spot / 64).cast("long").alias(word), (spot % 64).cast("int").alias(bit))
    bitmap = marks.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias(bits))
    mine = F.pmod(F.xxhash64(F.col(key)), F.lit(words * 64))
    placed = rows.where(F.col(key).isNotNull()).withColumns({word: (mine / 64).cast("long"), bit: (mine % 64).cast("int")})
    met = placed.join(F.broadcast(bitmap), word).where(f"(shiftrightunsigned({bits}, {bit}) & 1L) = 1L")
    return met.select(*rows.columns)


def whole_text(text_col: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


@freed
def _repeats(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of key-sorted batches whose key equals a neighbour's, and the task's first and last
    run, which may go on in the neighbouring task.  Holds back one row between batches."""
    held: pa.RecordBatch | None = None
    held_in = True  # the first row of the task always stays
    first_run = True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        n = rows.num_rows
        same = np.ones(n - 1, bool)
        for k in keys:
            v = rows.column(k).to_numpy(zero_copy_only=False)
            same &= v[1:] == v[:-1]
        keep = np.zeros(n, bool)
        keep[1:] |= same
        keep[:-1] |= same
        if held is not None:
            keep[0] |= held_in
        if first_run:  # rows up to the first change belong to the first run
            change = np.flatnonzero(~same)
            upto = n if not len(change) else change[0] + 1
            keep[:upto] = True
            first_run = not len(change)
        # the last row waits for its successor
        out = keep[:-1]
        if out.any():
            yield rows.slice(0, n - 1).filter(pa.array(out))
        held, held_in = rows.slice(n - 1), bool(keep[-1])
    if held is not None:
        yield held  # the last run may go on in the next task


def repeated_keys(df: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Rows of ``df`` (integer key columns without nulls) whose key occurs in two rows or more,
    plus at most two runs of single rows per task (a run may continue in the next task).

    Range partitioning on (keys, tie) spreads a key that holds any share of the rows over
    as many tasks as its share is worth; nothing is gathered by key.
    """
    order = [*keys, tie]
    return (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(lambda it: _repeats(it, keys), df.schema)
    )


#: Tasks over which the links of one node are dealt.
CENTRE_SALTS = 16


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), each once.

    Alternates large-star and small-star steps (every node hands its neighbours to its
    smallest one) until nothing changes; the edge list never grows and each
    step is written to the shared folder.  Neighbour minima are partial aggregates, so a
    node with many links is one small row before the shuffle, and its links are dealt over
    ``CENTRE_SALTS`` tasks where they meet that minimum.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    state, path = write_table(pairs, f"{name}-edges")
    before = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every neighbour above u links to the least of u and its neighbours
        large = (
            salted_join(both.where("v > u"), low, "u", "v", salts=CENTRE_SALTS).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: the lower neighbours of u, and u, link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            salted_join(large, least, "u", "v", salts=CENTRE_SALTS)
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after_state, after_path = write_table(small, f"{name}-edges")
        after = after_state.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        drop_table(spark, path)
        state, path = after_state, after_path
        if before == after:
            break
        before = after
    # converged: every node above its component's least one has exactly the edge to it
    return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
