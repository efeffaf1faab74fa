"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. Rows are told apart by doc_id
and text, so that doc_ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import row_key
from tidemill.llm.decontamination import decontaminate
from tidemill.llm.exact_dedup import exact_dedup
from tidemill.llm.ngram_join import ngram_join
from tidemill.llm.packing import pack_along_curve
from tidemill.llm.quality import fit_quality, score_quality
from tidemill.session import table

#: Near duplicates: words a shingle, and the similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


KEY = "_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, row_key(F.col("doc_id"), F.col("text")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose keys are in ``gone``."""
    return _keyed(docs).join(table(gone.select(KEY), "gone"), KEY, "left_anti").select(docs.columns)


def _kept(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept in ``judged``; of rows that repeat doc_id and text and are
    not all kept, one or none."""
    share = judged.groupBy(KEY).agg(F.count_if("kept").alias("some"), F.count(F.lit(1)).alias("all"))
    share = table(share.filter("some < all"), "not_all_kept")
    left = _keyed(docs).join(share.select(KEY), KEY, "left_anti")
    # Rows that repeat a kept one; where there are none, adaptive execution drops this branch.
    again = _keyed(docs).join(share.filter("some > 0").select(KEY), KEY, "left_semi").dropDuplicates([KEY])
    return left.union(again).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; all others stay as they are.

    A row goes through the classifier as a whole, so that nothing has to be joined to it again.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    others = {c: f"_column{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    judged = score_quality(docs.withColumnsRenamed(others), model, keep=("text", *others.values()))
    return judged.filter("predicted <> 0").select(*(F.col(others.get(c, c)).alias(c) for c in docs.columns))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one of smallest doc_id stays, null before all others."""
    return _kept(docs, exact_dedup(_keyed(docs), keep=(KEY,)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest doc_id stays, null before all others."""
    return _kept(docs, ngram_join(_keyed(docs), SHINGLE_WORDS, SIMILAR_PERCENT, keep=(KEY,)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontaminate(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=(KEY,), span=None)
    return _without(docs, found.filter("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed into sequences."""
    return pack_along_curve(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained classifier and a tokenizer can't be put in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = table(docs, f"stage{number + 1}")
    return docs
