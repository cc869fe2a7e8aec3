"""A corpus pipeline of five stages, each an operator of nodalis.llm.

documents -> toxicity -> SimHash near copies -> benchmark decontamination ->
personal data -> SentencePiece ids.  A stage gets what its predecessor kept and
returns the columns of documents; the last returns ids and decoded texts.  No
stage reads an id, label or source to decide (labels teach the first one).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm import decontaminate, pieces, pii, simhash, toxicity
from nodalis.llm.common import held_out, ready, remove, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; learned from the labels that are not held out."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.accept(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays (five-word
    shingles, similarity 0.8 or more)."""
    ready(spark)
    return simhash.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with begin and end, and the text they decode to."""
    ready(spark)
    out = pieces.encode_decode(docs, as_array=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_copies),
    ("benchmark", drop_benchmark),
    ("personal_data", mask_personal),
    ("sentencepiece", encode),
]

#: The stages are learned models, an index search and a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared
    folder and read again, so a lost executor never sends work back further.  A
    copy goes once the next one is written; the last, which the result reads,
    stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{name}")
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
