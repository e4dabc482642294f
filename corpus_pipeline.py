"""The corpus pipeline over ``documents``: toxic documents go, one of each group of near copies stays, repeated
passages are cut out, sources are mixed to their target weights, and the result is encoded."""

from __future__ import annotations

from tessera.llm.bpe import encode_stage
from tessera.llm.common import materialize, read
from tessera.llm.mixing import mix_stage
from tessera.llm.simhash import first_of_each
from tessera.llm.suffixes import strip_repeats
from tessera.llm.toxicity import keep_clean

STAGES = [
    ("toxicity", keep_clean),
    ("simhash", first_of_each),
    ("suffixes", strip_repeats),
    ("mixing", mix_stage),
    ("bpe", encode_stage),
]

#: A trained classifier and a fold over byte pieces have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
