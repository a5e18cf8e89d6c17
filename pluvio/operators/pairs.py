"""Sums of products over all pairs of variables in one pass.

The values of a key are brought together once; a task turns blocks of keys into dense
(keys x variables) matrices, whose products are the sums over those keys for every pair, and
gives one row per pair however many keys it met.  No row is made per key and pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matrix entries of one block of keys, which bounds a task's memory beside the pairs themselves.
BLOCK_ENTRIES = 4_000_000


def _sums(batches: Iterator[pa.RecordBatch], names: list[str], products: dict[str, tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    place: dict = {}
    total = {p: np.zeros((0, 0)) for p in products}
    kind = None
    for batch in batches:
        rows = batch.column("_rows")
        keys = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False))
        entries = rows.flatten()
        variable = entries.field("_var").dictionary_encode()
        kind = variable.dictionary.type
        for v in variable.dictionary.to_pylist():
            place.setdefault(v, len(place))
        local = np.array([place[v] for v in variable.dictionary.to_pylist()], np.int64)
        at = local[variable.indices.to_numpy(zero_copy_only=False)] if len(entries) else np.zeros(0, np.int64)
        values = {n: entries.field(n).to_numpy(zero_copy_only=False).astype(float) for n in names}
        d = len(place)
        total = {p: np.pad(t, (0, d - len(t))) for p, t in total.items()}
        step = max(BLOCK_ENTRIES // max(d, 1), 1)
        for low in range(0, len(rows), step):
            a, b = np.searchsorted(keys, [low, low + step])
            size = min(step, len(rows) - low)
            # a repeated (key, variable) adds up, which counts every combination, as a join of the rows would
            matrix = {n: np.bincount((keys[a:b] - low) * d + at[a:b], v[a:b], size * d).reshape(size, d) for n, v in values.items()}
            for p, (left, right) in products.items():
                total[p] += matrix[left].T @ matrix[right]
    if not place:
        return
    known = pa.array(list(place), kind)
    d = len(place)
    for low in range(0, d, max(1_000_000 // d, 1)):
        high = min(low + max(1_000_000 // d, 1), d)
        yield pa.RecordBatch.from_arrays(
            [known.take(pa.array(np.repeat(np.arange(low, high), d))), known.take(pa.array(np.tile(np.arange(d), high - low)))]
            + [pa.array(total[p][low:high].ravel()) for p in products],
            ["var1", "var2", *products],
        )


def pair_sums(df: DataFrame, key: str, var: str, values: dict[str, Column], products: dict[str, tuple[str, str]]) -> DataFrame:
    """(var1, var2, one column per product) for every ordered pair of variables, a variable with itself included.

    ``df`` is long: a row per key and variable.  ``values`` are numbers of a row (not null) and
    ``products`` name pairs of them: the column is the sum, over keys, of the left value at var1 times the right value
    at var2.  Rows with a null key or variable take no part.  Variables of one key, and the pairs of
    all variables, must fit in a task: a few thousand variables.
    """
    names = list(values)
    kind = df.schema[var].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull() & F.col(var).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.collect_list(F.struct(F.col(var).alias("_var"), *[c.cast("double").alias(n) for n, c in values.items()])).alias("_rows")
    )
    schema = f"var1 {kind}, var2 {kind}, " + ", ".join(f"`{p}` double" for p in products)
    partial = rows.select("_rows").mapInArrow(lambda it: _sums(it, names, products), schema)
    return partial.groupBy("var1", "var2").agg(*[F.sum(p).alias(p) for p in products])
