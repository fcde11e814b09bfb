"""From raw documents to packed training sequences, stage by stage.

Every stage works on all that the one before kept.  All but the last return the
columns of ``documents``; the last returns the packing plan.  Rows that repeat an
id and a text pass or go together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.llm.cluster import cut
from sheetweave.llm.lang_id import UNKNOWN, fluent, predict, train, usual_rates
from sheetweave.llm.line_dedup import remove_repeated_lines
from sheetweave.llm.mixing import mix, tokens
from sheetweave.llm.near_dedup import near_duplicates
from sheetweave.llm.packing import pack
from sheetweave.llm.sampling import held_out
from sheetweave.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of corrected n-gram counts below which no language is recognised.
MIN_SCORE = 0.26


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; a missing ``lang`` is filled in.

    A language is recognised where it leads the others and the text has about
    the share of its n-grams that texts of that language have.  Null, empty and
    letterless texts go.  Null ids, repeated rows and ties are judged by their
    text like all rows; a tie goes to the first language by name.
    """
    docs = docs.select(*COLUMNS)
    learned = docs.where(~held_out(F.col("doc_id")))
    model = train(learned)
    rates = usual_rates(learned, model)
    judged = predict(docs, model, keep=COLUMNS)
    rate = F.coalesce(F.create_map(*(F.lit(x) for pair in rates.items() for x in pair))[F.col("lang_pred")], F.lit(0.0)) if rates else F.lit(0.0)
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE) & fluent(F.col("hits"), F.col("n_grams"), rate))
    return kept.withColumn("lang", F.coalesce("row.lang", "lang_pred")).select("row.doc_id", "row.text", "lang", "row.source", "row.n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents that have no word left.

    Null, empty and blank texts have no word and go.  Rows that repeat an id and
    a text are one document; those with a null id come first in the order.
    """
    trimmed = remove_repeated_lines(docs.select(*COLUMNS)).where("n_removed < n_lines")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text"))
    return trimmed.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", F.when(text.isNotNull(), F.length(text).cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8.

    Of a group the smallest id stays, with all of its rows.  Texts that are null
    or have no word are nobody's duplicates and stay, as do rows with a null id.
    """
    docs = docs.select(*COLUMNS)
    kept = cut(near_duplicates(docs, shingle_words=5, percent=80).where("kept").select("doc_id").distinct())
    return docs.join(kept.withColumnRenamed("doc_id", "_kept"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target marginals by source, language and topic.

    Null sources and languages are a category of their own.  Rows without a word
    go where their cell has no tokens.  Rows that repeat an id pass or go
    together within a cell.
    """
    return mix(docs.select(*COLUMNS)).where("kept").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin, the offset and the tokens of every piece of a document.

    A text that is null or has no word has one row without a bin.  Repeated rows
    are packed each, but not into one bin; null ids and sources are packed, too.
    """
    return pack(docs.select("doc_id", tokens(F.col("text")).alias("tokens"), "source", F.md5("text").alias("cluster")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near", near),
    ("mixture", mixture),
    ("packing", packing),
]

#: Language models and the LSH forest aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from a checkpoint of the one before."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
