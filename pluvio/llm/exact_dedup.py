"""Exact deduplication by content sort.

Every text is normalised and range-partitioned by sampled splitters over its
first bytes, its digest and a salt of the identifier; the external sort of each
range puts equal texts side by side, and each row is compared in full with
the one before it.  The salt cuts a text that holds a large part of all rows
into many ranges; the runs of one text are put together afterwards from one
narrow row per run, and handed back to the rows over (digest, salt), so
no step gathers a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.llm.common import ASCII_SPACE, own_names, shuffle_partitions, whole_text, write_table

#: Characters of the normalised text in the range key; splitters stay small whatever the texts are.
SPLITTER_CHARS = 32


def normalised(text_col: str) -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(whole_text(text_col), f"{ASCII_SPACE}+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty and is a text like any other.  Rows with the same identifier
    and text are a group; one of them is kept.  A null identifier sorts after all others.
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    salts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm")).select(
        "_id",
        "_norm",
        F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"),
        F.substring("_norm", 1, SPLITTER_CHARS).alias("_start"),
        F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt"),
    )
    spot = ["_start", "_sha", "_salt"]
    # The range partitioning satisfies the windows' clustering: no second shuffle of texts.
    neighbours = Window.partitionBy(*spot).orderBy("_norm", F.col("_id").asc_nulls_last())
    ranged = rows.repartitionByRange(*spot)
    compared = ranged.select(
        "_id", *spot, (~F.col("_norm").eqNullSafe(F.lag("_norm").over(neighbours))).alias("_head"),
        F.row_number().over(neighbours).alias("_at"),
    )
    runs = Window.partitionBy(*spot).orderBy("_at")
    numbered = compared.withColumn("_run", F.sum(F.col("_head").cast("long")).over(runs))
    run = Window.partitionBy(*spot, "_run")
    local, _ = write_table(
        numbered.select(
            "_id", "_sha", "_salt", "_run", "_head",
            F.min("_id").over(run).alias("_first"), F.count("*").over(run).alias("_n"),
        ),
        "exact-runs",
    )
    # One narrow row per run of a salted text; the digest of the whole text names the group.
    heads = local.where("_head").select("_sha", "_salt", "_run", "_first", "_n")
    groups = heads.groupBy("_sha").agg(F.min("_first").alias("keep_id"), F.sum("_n").alias("group_size"))
    resolved = heads.join(groups, "_sha").select("_sha", "_salt", "_run", "keep_id", "group_size")
    return local.join(resolved, ["_sha", "_salt", "_run"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_head") & F.col("_first").eqNullSafe(F.col("keep_id")) & F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each group.

    Of rows that repeat an identifier and its text, any one stays.  Null texts count as empty, a null
    identifier as one more identifier, kept only where its group has no other; an empty table stays empty;
    columns of any names stay as they are.
    """
    key = own_names("key", "null", "sha")  # plain equality: the join's partitions and order serve the last step too

    def keyed(df: DataFrame, sha: Column) -> DataFrame:
        i = F.col(id_col)
        return df.withColumns(dict(zip(key, (F.coalesce(i.cast("string"), F.lit("")), i.isNull(), sha), strict=True)))

    rows = keyed(docs, F.sha2(normalised(text_col).cast("binary"), 256))
    kept = keyed(exact_groups(docs, id_col, text_col).where("kept"), F.col("text_sha256")).select(*key)
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)
