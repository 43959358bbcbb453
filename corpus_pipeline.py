"""From raw documents to packed training sequences: five stages over the whole table.

Every stage takes any table with the columns of documents; other columns go along with
their rows, whatever their names. Rows that are equal, or share an id or have none, are
rows of their own, judged by their texts. Texts are worked on whole, whatever their length.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywait.llm import langid, line_rules, minhash, mixing, packing
from skywait.llm.common import others_aside
from skywait.sources.shared import forget, settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; null texts and those without a letter go.

    Languages that score alike go by code point, which changes no decision here.
    """
    return _in_a_language(docs)


@others_aside("doc_id", "text", "lang")
def _in_a_language(docs: DataFrame) -> DataFrame:
    names = ("_language", "_score")
    return langid.predict(docs, langid.fit(docs), names).where(F.col(names[0]) != "und").drop(*names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their host's frequent lines.

    A null source is a host of its own; null and blank texts fail, and equal rows fare alike.
    """
    return line_rules.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least id, then of the least text key.

    Null texts copy nothing and stay, once for each id; blank ones copy each other.
    """
    return minhash.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, as documents; some come several times, some in part.

    A null source comes last; null and blank texts have no words and are not taken.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix with their place in training sequences.

    Null and empty texts are one end token; pieces of equal length are taken by id, piece and content.
    """
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        if stage is not STAGES[0][1]:
            forget(before)  # each stage reads its predecessor alone
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express language models, signatures and tokenizers.
ORACLE_SQL = None
