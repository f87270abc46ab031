"""A corpus pipeline of five stages over the llm operators.

Every stage works on all documents that the stage before it kept; all but the
last return the columns of documents. Stages are written as Parquet and read
again, so a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.exact_dedup import exact_dedup
from quern.llm.language import UNDECIDED, identify, train, with_letters
from quern.llm.packing import pack_documents
from quern.llm.pii import replace_entities, session_key
from quern.llm.shared import checkpoint, remove, shared_folder
from quern.llm.simhash import simhash_dedup

#: The columns of documents; each stage drops extra ones.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; a text that is null or has none goes. Where no language could be learnt, ``und`` says nothing of a text.

    Repeated rows and rows without a doc_id stay; no documents give none.
    """
    model = train(docs)
    if not model.langs:
        return with_letters(docs.select(*COLUMNS))
    found = identify(docs.select(*COLUMNS), model, [c for c in COLUMNS if c != "doc_id"])
    return found.where(F.col("lang_pred") != UNDECIDED).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of their own for each row (row), checkpointed, since keys made twice may differ."""
    return checkpoint(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def _first_rows(keyed: DataFrame, groups: DataFrame, order: list) -> DataFrame:
    """Of each group (row, group) the one row that comes first by ``order``, then doc_id (null last), then row."""
    ranks = keyed.select("row", F.struct(*order, F.col("doc_id").isNull().alias("last"), "doc_id", F.col("row").alias("first")).alias("rank"))
    first = ranks.join(groups, "row").groupBy("group").agg(F.min("rank").alias("rank")).select(F.col("rank.first").alias("row"))
    return keyed.join(first, "row", "left_semi").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the row that exact dedup keeps; one row even if doc_ids repeat or are null."""
    keyed = _keyed(docs)
    found = exact_dedup(keyed.select(F.col("row").alias("doc_id"), "text"))
    longest = (-F.char_length(F.coalesce("text", F.lit("")))).alias("p")
    return _first_rows(keyed, found.select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")), [longest])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, one row: that with the smallest doc_id, null last."""
    keyed = _keyed(docs)
    found = simhash_dedup(keyed.select(F.col("row").alias("doc_id"), "text"))
    return _first_rows(keyed, found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), [])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data by the session's key; repeated rows and null ids stay as they are."""
    replaced = replace_entities(docs, session_key(spark), passing=["lang", "source"])
    return replaced.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences; a repeated row has pieces of its own, a null text one of length one."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Language machines, surrogates and token ids are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what lies between them goes to the shared folder and is deleted once the last stage is done.

    The last stage works on a checkpoint of its own, so its rows do not need the
    stages' tables any more.
    """
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        remove(spark, base)
