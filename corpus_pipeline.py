"""From raw documents to packed training sequences, one operator a stage.

Every stage is a function of (spark, docs, sf_dir).  It works on all rows its predecessor kept;
all but the last return the columns of ``documents``.  Between stages the rows are written to
shared storage and read again, so a stage can be repeated on its own after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanframe.llm import exact_dedup, jaccard, langid, packing, pii
from gleanframe.llm.queries import PII_KEY, VOCABULARY
from gleanframe.llm.rows import fold
from gleanframe.session import scratch_path, scratch_scope

# setting that names the key of the pseudonyms; without it the key of the test tables is used
KEY_SETTING = "spark.gleanframe.pii.key"
NEAR_WORDS, NEAR_PERCENT = 5, 80
# bytes of rows that pass to a Python worker at once, unless the session sets its own
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
SEQUENCE_TOKENS = 2048


def small_batches(spark: SparkSession) -> None:
    """Bound what an executor holds per worker: long texts would make a default batch many times larger."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the languages that the labelled documents teach.

    A null, empty or letterless text is rejected; repeated rows are judged alike, each for itself.
    Without any labelled text no language is known and every row goes.  An empty table stays one.
    """
    small_batches(spark)
    trees = langid.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return langid.accepted(docs, trees)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id.

    A null text equals an empty one, a null id loses to any other, and of rows that repeat the
    largest id one stays.  An empty table stays one.
    """
    small_batches(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts the one with the smallest id.

    A text without words, null included, is similar to none and stays, as does a row with a null
    id; rows that repeat the smallest id all stay.  An empty table stays one.
    """
    small_batches(spark)
    return jaccard.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in every text; ``n_chars`` follows the new text.

    A null text stays null, an empty one empty; repeated rows change alike.  An empty table stays one.
    """
    small_batches(spark)
    key = spark.conf.get(KEY_SETTING, PII_KEY.decode()).encode()
    done = pii.pseudonymise(docs, key, spans=None)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most SEQUENCE_TOKENS tokens.

    A null or empty text is the end mark alone; repeated rows are packed each for itself.  An
    empty table gives no pieces.
    """
    small_batches(spark)
    return packing.pack(
        packing.token_pieces(docs, VOCABULARY, capacity=SEQUENCE_TOKENS), capacity=SEQUENCE_TOKENS,
    )


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]

# context trees, pseudonyms and packing have no SQL; tests hold the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
