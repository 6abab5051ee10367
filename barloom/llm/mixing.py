"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within a source the key space is cut into equal ranges; each (source, range)
is sorted by one task, so that a source with a third of all rows spreads over all ranges. Range totals form a table
of (source, range) rows whose running sums give each range its offset: prefix sums without one task per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import WORD, partitions, stage, text_of

SEED = "mix-1"
WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights repeat over the sources by code point, null last.

    The sources share `share` times the total by weight; a target above max_epochs times its source's size stops there
    and the excess is shared again by weight until none is above. That fixed point is min(cap, level * weight), where
    the level comes from running sums over the sources sorted by cap / weight. One row per source: the length of the
    weight list, not of the data.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn(
        "w", F.element_at(ring, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    every = Window.partitionBy()
    by_level = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "source",
        "source_size",
        "w",
        "cap",
        (F.sum("source_size").over(every) * F.lit(share)).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("w_left"),
    )
    # the first source below its cap has the level; at later sources the same quotient is no larger
    level = (F.col("total") - F.col("cap_before")) / F.col("w_left")
    rows = rows.withColumn("level", F.when(level * F.col("w") <= F.col("cap"), level))
    rows = rows.withColumn("level", F.max("level").over(every))
    return rows.select(
        "source",
        "source_size",
        F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = SEED,
    ranges: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[Column] = (),
) -> DataFrame:
    """One row per input row: id_col, size, source_size, target, taken.

    size counts words (null text: 0). A source's target is taken in whole epochs and a last part: documents in key
    order until the budget's exact word, so that a source's taken words add up to its target rounded down. Repeated
    rows are separate documents of the mix. Documents without words take nothing; a source without words has target 0.
    Null sources form one source. Rows of one identifier have keys by their texts, null identifiers too; long texts are
    counted whole. Columns of `keep` (named expressions) are passed on; other columns are ignored. The same input and seed give the same result.
    """
    n = ranges or 4 * partitions(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(text_of(text_col)).alias("size"), F.md5(text_of(text_col)).alias("hash"),
        F.struct(F.lit(0).alias("none"), *keep).alias("kept"),
    )
    # the text's hash spreads the rows of a null or repeated identifier
    salted = F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "hash")
    rows = rows.withColumn("key", F.conv(F.substring(F.sha2(salted, 256), 1, 15), 16, 10).cast("long"))
    # keys have 60 bits; the leading 30 choose the range
    rows = rows.withColumn("range", F.shiftright(F.shiftright("key", 30) * F.lit(n).cast("long"), 30).cast("int"))
    rows = stage(rows.withColumn("named", F.col("source").isNotNull()).fillna({"source": ""}), "mix")
    group = ["named", "source", "range"]
    sums = rows.groupBy(*group).agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("named", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("start"))
    totals = sums.groupBy("named", "source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(
        totals.select(F.when(F.col("named"), F.col("source")).alias("source"), "source_size"), weights, share, max_epochs
    ).select(
        F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source"), "source_size", "target"
    )
    within = Window.partitionBy(*group).orderBy("key", "id", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts.join(targets, ["named", "source"]), group)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("start") - F.col("ahead")))
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), "kept.*"
    ).drop("none")


ORACLE = f"""
WITH sized AS (
    SELECT doc_id, source, md5(coalesce(text, '')) AS hash, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
           [{', '.join(f'{w}::DOUBLE' for w in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w
    FROM sources),
levels AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
               - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
    FROM weighed),
level AS (SELECT max(lv) AS lv FROM levels WHERE lv * w <= cap),
targets AS (
    SELECT source, source_size, least(cap, coalesce(level.lv * w, cap)) AS target, floor(least(cap, coalesce(level.lv * w, cap)))::BIGINT AS budget
    FROM levels, level),
cut AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN t.budget // t.source_size ELSE 0 END AS epochs, t.budget,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY substr(sha256('{SEED}:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.hash), 1, 15), s.doc_id, s.size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, budget - epochs * source_size - ahead)))::BIGINT AS taken
FROM cut
"""
