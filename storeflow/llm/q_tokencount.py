"""op4: piece counts of every document. No SQL form; tests hold it to a unigram tokenizer."""

from __future__ import annotations

from .tokencount import load_vocabulary, token_counts


def op4_tokencount(spark, sf_dir):
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {"op4_tokencount": op4_tokencount}
ORACLES: dict[str, str] = {}
