"""From raw documents to token ids: toxic documents go, one of each group of near
copies stays, benchmark leaks go, personal data is blanked, and what is left is
encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
each result as Parquet to a folder of its own below the shared checkpoint folder
and hands the written rows to the next stage, so a stage never recomputes the
one before it and a lost executor costs no more than its tasks. All stages but
the last return the columns of ``documents``. Null texts pass every filter and
encode to the end id; rows without an id are judged by their text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm import decontamination, jaccard, pieces, pii, toxicity
from tallyroom.llm.queries import table, tokenizer_path
from tallyroom.llm.tokenfiles import new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(toxicity.sample_rows(docs, table(spark, sf_dir, "labels"), F.lit(True)))
    return toxicity.reject(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def blank_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    blanked = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        blanked = blanked.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(kind))
    return blanked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), ["doc_id"], ids=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_near_copies),
    ("decontamination", drop_leaks),
    ("pii", blank_personal_data),
    ("sentencepiece", encode),
]

# The first stage scores with a trained model, which SQL cannot express;
# tests/llm runs the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
