"""A training-corpus pipeline of five stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir), works on every document its predecessor kept, and is
written as Parquet and read back before the next one starts.  All but the last keep the columns
of ``documents``:

    toxicity          documents at or above their language's threshold go
    jaccard_join      of each class of near copies the document of the least id stays
    decontamination   documents that hold a benchmark window of ten words go
    secrets           every secret is replaced in its text, n_chars is counted anew
    packing           the ids of what is left are packed into sequences

Null texts are empty texts: not toxic unless the empty text is, copies of each other, clean; a null
id, language, source or count is kept as it is (a null id stays only where its class has no other).
Equal least ids of a class are told apart by their texts' digests, and a row that repeats in all stays once.  Texts are whole in
every stage, however long.  Without usable labels nothing is rejected as toxic; empty tables give no
rows.  Columns that ``documents`` has beyond its own are carried to the last stage, whatever their names.
A stage's table is deleted when the next one is written; the last one's stays for its reader.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewheel.llm import decontamination, jaccard_join, packing, secrets, shared, toxicity
from tidewheel.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is trained on the labelled ones of ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

# SQL expresses none of classifier, tokenizer and guess cost; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = shared.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if done is not None:
            shared.drop_table(done)
        done = docs
    return docs
