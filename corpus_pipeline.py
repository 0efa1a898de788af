"""A corpus pipeline: documents scored, de-duplicated, decontaminated, masked and tokenised.

Each stage takes (spark, docs, sf_dir); ``docs`` is what the stage before it kept.  Null texts count as empty, null ids are
ids of documents like others, and an empty table gives an empty one.  Rows are told apart by id and text, so documents
that share an id, or have none, are decided on one by one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkedframe.llm import bpe, decontaminate, nearcopies, queries, secretscan, toxicity
from linkedframe.llm.common import stored, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold.  Each row is scored for itself, so repeated rows stay or go together."""
    scored = toxicity.score(docs, queries.toxicity_model(spark, sf_dir), column="__toxicity")
    return scored.where(F.col("__toxicity") < queries.TOXIC).select(*docs.columns)


def joined(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` joined by document, told apart by id, null or not, and text; ``found`` has a row a document (doc_id, text_hash)."""
    marks = found.withColumnsRenamed({"doc_id": "__key", "text_hash": "__hash"})
    return docs.join(marks, F.col("doc_id").eqNullSafe(F.col("__key")) & (F.xxhash64("text") == F.col("__hash")), how)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more.

    Candidates are found by the fingerprints and the trie join of ``op9_simhash``, and by minimum hashes beyond its bits.
    It is the one with the smallest id, null ids last, then with the smallest hash of its text.  Of rows that share id
    and text, the one with the smallest hash of all columns stays.
    """
    groups = nearcopies.near_copies(docs.select("doc_id", "text"))
    kept = stored(groups.where("first").select("doc_id", "text_hash", "times").distinct())
    single = joined(docs, kept.where("times = 1"), "left_semi")
    again = joined(docs, kept.where("times > 1"), "inner").groupBy("__key", "__hash")
    return single.select(*docs.columns).unionByName(again.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without enough benchmark words.  Repeated rows stay or go together; a text without words stays."""
    found = decontaminate.find_contamination(docs.select("doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return joined(docs, found.where("contaminated").select("doc_id", "text_hash").distinct(), "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each secret replaced and the number of characters set anew; a null text stays null, as its number."""
    masked = secretscan.mask(docs, secretscan.train(docs.select("doc_id", "text")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, n_bytes) of each row: token ids, and how many bytes they decode to; no text has none of both."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN), path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.octet_length("decoded").cast("long").alias("n_bytes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: Fingerprints, trained models and merges cannot be written in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents.  Each result but the last is written and read again, so lineage stays short."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
