"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet below the shared folder and
reads again as the next stage's docs. All but the last return the columns of documents, unchanged, of the rows they keep.

1. toxicity: documents that the model rejects (score of 0.5 or more) go. The model learns from `labels`.
2. near_duplicates: one document of each group of texts whose 5-word shingle sets are 0.8 alike stays, the least doc_id.
3. decontaminate: documents that hold ten consecutive words of a benchmark item go.
4. pack: what is left is tokenised and packed into sequences of 4096.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns are handled as the operators state; an
empty text is not toxic, not a near duplicate and not contaminated, and packs as its closing id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storeflow.llm import decontaminate, jaccard, packing, toxicity
from storeflow.llm._text import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, toxicity.training_labels(labels))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]

#: SQL can express neither the trained scores nor the tokenizer's ids; tests hold the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = shared_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
    return docs
