"""From raw documents to token ids: toxicity, exact copies, near copies, mix, BPE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from echofold.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from echofold.llm.common import Scratch, documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without toxic documents, judged by a model of those of them that labels covers.

    Null and empty texts stay; repeated rows stay or go together; without toxic and clean labels nothing goes. Empty docs stay empty.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the smallest doc_id, once if rows repeat it.

    Rows with a null doc_id or text stay; of several empty texts one stays. Empty docs stay empty.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of connected near copies: the one with the smallest doc_id.

    Rows with a null doc_id and null or wordless texts stay. Empty docs stay empty.
    """
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, once at least.

    A row of no source is taken once; a null or empty text counts one token; repeated rows draw alike. Empty docs stay empty.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source with token ids, their number and whether they decode to the text.

    One row for each row; a null text has null ids, an empty one none. Empty docs give no rows.
    """
    return bpe.encode(docs, ("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE", encode),
]
#: maximal segments, connected components and flows have no SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows but the last's are written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = reduce(lambda docs, stage: scratch.table(stage[1](spark, docs, sf_dir), "stage"), STAGES[:-1], documents(spark, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
