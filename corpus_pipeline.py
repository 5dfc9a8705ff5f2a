"""A training-data pipeline over documents: language ID, exact dedup, near dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with those
beside them, whatever their names. Between stages the rows are written to the shared folder and read again, so a lost
executor costs no more than its tasks. Texts are read whole in every stage; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import encode_round_trip
from palimpsest.llm.common import table, written
from palimpsest.llm.exact_dedup import drop_exact_copies
from palimpsest.llm.language_id import keep_identified
from palimpsest.llm.mixing import mixed_documents
from palimpsest.llm.near_dedup import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language can't be told: null and empty texts, texts without letters, and those that no
    language is likelier for than the others. Each row is judged by its text, so repeated rows, and rows without a doc_id,
    stay or go by themselves."""
    return keep_identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z, a-z), the document with the largest doc_id; null is the empty text, a null doc_id is
    smaller than any. Of rows that repeat doc_id and text, one."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar texts connect, the one with the smallest doc_id. Texts without words, and rows
    without a doc_id, stay; rows that repeat a doc_id stay or go together."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each time that it takes a document, cut to the chosen words where it takes a part. Rows
    without words go; rows that repeat are dealt what they take one by one; rows without a source are one source."""
    return mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256 of each row."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows of documents, through all stages in order. What each does with nulls, empty and very long texts,
    repeated rows and columns of any name is said above; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language models, MinHash and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {}
