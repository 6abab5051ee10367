"""Exact dedup by content sort, in DataFrame operations only.

Rows are range-partitioned on (prefix, hash, salt) of the normalised text with Spark's sampled splitters, sorted
externally so that equal texts lie next to each other, and grouped by comparing neighbours' whole texts. The splitter
key is short and of fixed size, so that the sample which reaches the driver doesn't grow with text length.

A text that holds a large share of a hash sample is hot. Its rows get a salt from their identifier, so that its run
spans several range partitions; the few runs of a hot text are merged afterwards by digest. The hot list has at most
2 entries per shuffle partition, which bounds both broadcasts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import partitions, stage, text_of

PREFIX_CHARS = 24
SAMPLE_PER_PARTITION = 400


def hot_texts(rows: DataFrame, parts: int, total: int) -> DataFrame:
    """(h, salts) of the hashes with a sample share of 1 / (2 * parts) or more: 2 * parts rows at most."""
    wanted = SAMPLE_PER_PARTITION * parts
    every = max(1, total // wanted)
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(every)) == 0)
    counted = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    size = max(1, total // every)
    share = F.col("n") / F.lit(float(size))
    return counted.where((share >= 1.0 / (2 * parts)) & (F.col("n") >= 20)).select(
        F.col("h").alias("hot_h"), F.ceil(share * 4 * parts).cast("int").alias("salts")
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    keep: str = "max",
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are byte-equal; a null text counts as empty. Of equal texts the row
    with the largest (keep="max") or smallest identifier stays; among repeated rows with that identifier exactly one
    stays. Null identifiers come last: one is kept only if its group has no other. An empty table gives an empty
    result. Columns besides the two named are ignored, whatever their names.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col(id_col).alias("id"), normalise(text_of(text_col)).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    narrow = rows.select("id", "h")
    found = stage(hot_texts(narrow, parts, docs.count()), "hot")
    any_hot = found.count() > 0
    rows = rows.join(F.broadcast(found), F.col("h") == F.col("hot_h"), "left").drop("hot_h")
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)))
    rows = rows.withColumn("prefix", F.substring("t", 1, PREFIX_CHARS))
    ranged = rows.repartitionByRange("prefix", "h", "salt")
    order = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    run = Window.partitionBy("prefix", "h", "salt", "t").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = ranged.select(
        "id",
        F.sha2("t", 256).alias("sha"),
        "salts",
        "salt",
        F.first("id").over(whole).alias("run_keep"),
        F.count(F.lit(1)).over(whole).alias("run_size"),
        (F.row_number().over(run) == 1).alias("heads"),
    )
    if not any_hot:
        return runs.select(
            F.col("id").alias(id_col),
            F.col("run_keep").alias("keep_id"),
            F.col("run_size").alias("group_size"),
            F.col("heads").alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    runs = stage(runs, "runs")
    best = F.max("run_keep") if keep == "max" else F.min("run_keep")
    merged = (
        runs.where(F.col("heads") & F.col("salts").isNotNull())
        .groupBy(F.col("sha").alias("hot_sha"))
        .agg(best.alias("hot_keep"), F.sum("run_size").alias("hot_size"))
    )
    keep_id = F.when(F.col("hot_sha").isNotNull(), F.col("hot_keep")).otherwise(F.col("run_keep"))
    # a hot text's head in any run is the group's head only where it has the group's identifier; the same
    # identifier always gets the same salt, so that repeated rows meet in one run. Null identifiers do too.
    return runs.join(F.broadcast(merged), F.col("sha") == F.col("hot_sha"), "left").select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("hot_size", "run_size").alias("group_size"),
        (F.col("heads") & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
