"""The corpus pipeline: language, near duplicates, personal data, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of its
predecessor. ``run`` writes every stage as Parquet to the shared folder and
reads it again for the next; what a stage wrote on the way goes as soon as
its result is there, and a stage's result as soon as the next one's is.

All stages: an empty table stays empty (packing: no pieces), null ids are
ids like any other, extra columns of any names are carried along up to
packing, texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plexframe.llm import jaccard, language, mixing, packing, pii
from plexframe.session import Scratch, temporary

#: A document whose language is less certain than this goes, as does one without a letter.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose language is known with confidence; the model learns from the labelled rows outside the held-out fold.

    Rows of null text or text without a letter go, and all rows if none is
    labelled. Repeated rows share their fate; equally likely languages leave
    a score of a half at most, which stays if it is LEAST_SCORE.
    """
    model = language.train(docs.where(~language.held_out("doc_id")))
    scored = docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns})
    scored = language.identify(scored, model, "own_text")
    kept = scored.where((F.col("lang_pred") != language.UNDECIDED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"own_{c}").alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near duplicates, the one of the smallest id, nulls last.

    Rows without words (null text too) all stay. Of rows of the same id and
    text one stays.
    """
    return jaccard.representatives(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text; n_chars follows. Null texts stay null, with n_chars null.

    Every row stays, repeated ones too; of overlapping spans the first names
    the replacement.
    """
    found = pii.scan(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns}), "own_text")
    new = {"text": F.col("text_redacted"), "n_chars": F.length("text_redacted").cast("long")}
    return found.select(*[new.get(c, F.col(f"own_{c}")).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it, 0 to 3 times.

    Null source is a source of its own; rows of null text have size 0 and
    come with the whole copies of their source. Of equal rows chance that is fixed by
    their place in the table decides which is taken.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences' pieces: one row per piece of every row, those of repeated rows each.

    Null text is the end id alone.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("mixture", mixed),
    ("packing", packed),
]

#: Byte context trees, token ids and the genetic search aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    kept = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary():
            last, docs = docs, kept.write(stage(spark, docs, sf_dir), name)
        kept.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
