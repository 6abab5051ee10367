"""A corpus pipeline: quality, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each stage's rows to
the shared folder and reads them again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, mixing, ngram_join, quality, token_output
from barloom.llm.common import WORD, discard, read, stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Every row is judged by its own text; nulls count as empty."""
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest identifier, null identifiers last.

    Groups are those of texts: unlike texts stay, whether their identifiers are null, repeated or their own. Of rows
    with the same identifier and text, the one whose other columns sort first stays. Rows without words are no
    duplicates and stay, each of them.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    groups = ngram_join.similar_groups(docs).where("head and n_shingles > 0")
    # grouped by an expression: partial sums move, and a hot text's rows are dealt to several tasks by the join before
    heads = groups.groupBy(F.substring("copy", 1, 32).alias("copy")).agg(F.min("doc_id").alias("id")).select(_key(F.col("id"), F.col("copy")).alias("__key"))  # a null id only if all are
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD)
    rows = docs.where(worded).withColumn("__key", _key(F.col("doc_id"), _hash())).join(heads, "__key", "left_semi")
    # one key, one row: the join has brought equal rows together already
    first = rows.groupBy("__key").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.min(F.struct(F.lit(0).alias("__0"), *rest)).alias("__rest"))
    first = first.select(*[F.col(f"__rest.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns])
    return first.unionByName(docs.where(~worded))


def _hash() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _key(identifier: Column, copy: Column) -> Column:
    return F.concat_ws(":", copy, F.coalesce(identifier.cast("string"), F.lit("none")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark passages; rows are judged each for itself, without words they stay."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one that a source's budget cuts is taken whole.

    Documents without words give the mix nothing and stay once. Rows of one identifier and text share the copies that
    the mix takes of them evenly, rounded up; an empty table stays empty.
    """
    taken = mixing.mix(docs, keep=[_hash().alias("hash")]).select(_key(F.col("doc_id"), F.col("hash")).alias("__key"), "size", "taken")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.greatest(F.lit(1), F.col("size"))))
    taken = taken.groupBy("__key").agg(F.ceil(F.avg(copies)).cast("int").alias("__copies"))
    both = docs.withColumn("__key", _key(F.col("doc_id"), _hash())).join(taken, "__key").where("__copies > 0")
    return both.select(*docs.columns, F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy")).drop("__copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards on the shared folder, read back: one row per row of docs, null identifiers first."""
    return token_output.report(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokens),
]

#: A trained classifier and a tokenizer have no SQL. tests/llm compares the join, decontamination, mixing and tokens with
#: brute-force versions, and the first stage with the classifier's own scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, work) in enumerate(STAGES):
        docs, before = stage(work(spark, docs, sf_dir), f"pipeline-{k}"), docs
        if k:
            discard(before)
    return docs
