"""The corpus pipeline: quality rules, near duplicates, decontamination, PII, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. Between stages the rows are written as Parquet and read
again.

Defined results: null and empty texts fail the base rule of the first stage. Given to a
later stage, they have no duplicates, are clean, are left as they are, and get no ids.
An empty table gives an empty result of the same columns. Further columns, whatever their
names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracord.llm import decontaminate, pieces, pii, quality_rules, setjoin
from veracord.llm.bpe import tokenizer_path
from veracord.llm.common import cut, load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    return quality_rules.kept_documents(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, Jaccard 0.8 or more.

    The smallest doc_id stays. Rows without a doc_id stay, and so does each of the rows that
    share a doc_id but are no near duplicates.
    """
    return setjoin.one_of_each(docs, width=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    carry = tuple(c for c in docs.columns if c != "doc_id")
    return decontaminate.find_leaks(docs, load(spark, sf_dir, "benchmark"), carry=carry).where("NOT contaminated").select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in their texts; n_chars follows where a text has changed."""
    count = "n_replaced"
    while count in docs.columns:
        count += "_"
    out = pii.pseudonymise(docs, pii.key_of(spark), counted=count)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_fallback, round_trip, n_pieces of every document."""
    out = pieces.encode_texts(docs, tokenizer_path("piece_bpe_32k.model"))
    return out.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("sentencepiece", sentence_pieces),
]

#: Learned rules, similarity components and latent retrieval have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
