"""The corpus pipeline: five stages over documents, each on what the one before
kept. All but the last return the columns of their input, whatever other columns
there are; names that the operators use themselves don't clash.

Defined results, stage by stage:

- toxicity: rows without text, or with an empty one, get the base score and stay
  while it is below one half; rows without an id are scored and never learnt from;
  repeated rows go or stay together; an empty table stays empty.
- simhash_near_dedup: texts without words, null ones among them, are copies of each
  other; of a component the smallest doc_id stays (a null id comes last), of rows
  that share it the smallest text hash, of fully repeated rows one.
- suffix_array_dedup: no row goes; null text stays null; rows that share an id are
  documents of their own unless their texts are equal too, then they share a result.
  A character that lost some of its bytes goes whole; n_chars is counted anew.
- decontamination: rows without words stay; items without an id, text or words
  leave no mark; rows that share an id are each compared as a whole.
- packing: null text is the end id alone; rows without an id or with a repeated one
  are packed as any other; an empty table gives no rows.

Texts of any length are read whole. Each stage's scratch tables go once its result
is written, and that result once the next stage's is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, packing, repeats, simhash, toxicity
from marlstone.llm.common import cut, drop_cut, table
from marlstone.session import temporary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the deobfuscating classifier does not reject."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.one_of_each(docs, shingle=4, radius=4, seed=42)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that occur earlier."""
    return repeats.without_repeats(docs, length=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens along the Hilbert curve."""
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=1))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL has neither the tokenizer nor the hashes; tests/llm/test_contracts.py and
#: tests/llm/test_pipeline.py hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark) as keep:
            docs = keep(cut(stage(spark, before, sf_dir), name))
        if hasattr(before, "_scratch_path"):
            drop_cut(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    if hasattr(docs, "_scratch_path"):
        drop_cut(docs)  # the last stage has written the ids that it reads
    return out
