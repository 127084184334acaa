"""A training-data pipeline over documents: language ID, quality, near-duplicates, source mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import langid, mixing, packing, quality, simhash
from lexspan.llm.common import fold, materialize, session, table
from lexspan.llm.queries import tokenizer_path

#: A document goes if its language can't be told, or with less than this share of the evidence.
LEAST_LANGUAGE = 0.5
#: The same threshold as the quality query's.
LEAST_QUALITY = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model is learned from the rows of this stage's input that have one.

    Null and empty texts, and texts without a letter, go; ties between languages go to the first by code point; an empty table stays empty.
    """
    session(spark)
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2))
    judged = langid.predict(docs.withColumns({"__lang": F.col("lang"), "__body": F.col("text")}), model, ["__body", *docs.columns])
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned on labelled rows of this stage's input, predicts as good.

    Null and empty texts have a score too; repeated rows are judged alike; an empty table stays empty.
    """
    session(spark)
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    model = quality.fit(docs, labels, "quality")
    return quality.classify(docs, model, docs.columns, threshold=LEAST_QUALITY).filter("predicted = 1").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shares 0.8 or more of its five-word shingles: the one with the smallest doc_id, and of equal or only null ids one of them.

    A row is told by its file and its place there, so doc_ids may be null or repeated.
    """
    session(spark)
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = materialize(docs)
    rows = docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("__row"))
    gone = simhash.similar_documents(rows, words=5, similarity=0.8, row="__row").filter("not kept").select("__row")
    return rows.join(materialize(gone), "__row", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as it is taken.

    Documents without a word weigh nothing and are taken as often as their source's whole copies say; rows that tie in the order are taken by size; an empty table stays empty.
    """
    session(spark)
    taken = mixing.mix(docs, carry=tuple(docs.columns))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).filter("copies > 0").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and place.

    A null or empty text is the end token alone; pieces of equal length are ordered by a hash of their row; an empty table gives an empty result.
    """
    session(spark)
    return packing.best_fit_packing(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned models, XXH64 and a tokenizer can't be told in DuckDB SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
