"""op6: all documents packed into sequences of 4096 tokens. No SQL form (ids come from a tokenizer); tests use an exact round trip."""

from __future__ import annotations

from .packing import pack


def op6_packing(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
