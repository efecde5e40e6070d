"""A training-data pipeline over ``documents``: five stages, each the production operator of its kind.

Every stage reads all that its predecessor kept and its decisions take effect
on the rows; all but the last return the columns of ``documents``.

Defined results, stage by stage (further columns of ``docs``, whatever their
names, go along unread until the last stage):

* language: null texts and texts without a letter go; all else stays.
* near_dedup: one row of each component stays, that of the least doc_id (null
  last) and, where that id has several texts in it, of the text with the least
  key; rows that repeat id and text count once; texts without a word stay.
* pii: rows and order of columns stay; a null text stays null; n_chars follows.
* mixing: a row appears as often as its source's target asks, so 0, 1 or 2 times.
* sentencepiece: a null text has no pieces; repeated rows have equal pieces.

Each stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import language, minhash, mixing, pieces, pii
from strandline.llm.common import materialize, ship, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language; texts without a letter go."""
    ship(spark)
    found = language.identify(docs, language.sample(docs))
    return found.filter(F.col("lang_pred") != language.UND).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the least doc_id, of each group of near copies (five words, 0.8)."""
    ship(spark)
    # what is decided for a row holds for its doc_id and text: other texts may have the same doc_id
    found = materialize(minhash.near_duplicates(docs, words=5, numerator=8, denominator=10), "pipeline-near", thin=True)
    gone = materialize(found.filter(~F.col("first")).select("doc_id", "text_key").distinct(), "pipeline-gone", thin=True)
    # rows with the id and the text of their component's representative: one of them stays
    twice = found.filter(F.col("first") & F.col("cls").isNotNull()).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    twice = materialize(twice.filter("rows > 1").select("doc_id", "text_key"), "pipeline-twice", thin=True)
    kept = _joined(docs, gone, "left_anti")
    return _joined(kept, twice, "left_anti").unionByName(_one_each(_joined(kept, twice, "left_semi")))


def _joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["doc_id"]) & (minhash.text_key("text") == keys["text_key"]), how)


def _one_each(docs: DataFrame) -> DataFrame:
    """One row, whole, of those with equal ids and texts: the least in the order of the other columns."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = docs.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("row"))
    return one.select("doc_id", "text", "row.*").select(*docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and terms that give it away, in every text."""
    ship(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target weight asks."""
    ship(spark)
    return mixing.mixed(docs).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, and confirm by decoding it again."""
    ship(spark)
    return pieces.encode(docs)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("sentencepiece", tokenise),
]

#: The stages are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
