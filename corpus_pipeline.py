"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; all but
the last return the columns of `documents`. `run` writes each stage's result to the shared folder
and rereads it, so a lost executor repeats tasks of one stage only.

Cases, as in the operators: null texts count as empty; the near-duplicate stage keeps one row of each
group of near copies, whatever their doc_ids: rows of one doc_id, or of none, with different texts are
different documents; empty tables pass through; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm import mixing, pieces, pii, simhash, toxicity
from sigframe.llm.common import Cuts, among, numbered, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: sets of 5-word shingles of similarity 0.8 at least, proposed by 256-bit fingerprints.
#: Sets of similarity 0.8 differ in 39 bits on average (standard deviation 6), so the radius is three
#: deviations wider; unrelated ones differ in 128.
SHINGLE, LANES, RADIUS, SIMILAR = 5, 4, 57, (4, 5)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field doesn't call toxic."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).where("predicted = 0").select(*COLUMNS)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each group of near duplicates."""
    cuts = Cuts(spark, "pipeline")
    rows = numbered(docs.select(*COLUMNS), cuts)
    marked = simhash.similar_documents(rows.select("row", "text"), SHINGLE, LANES, RADIUS, SIMILAR, Cuts(spark, "similar"))
    gone = cuts.write(marked.where("row <> component_row").select("row"))
    return among(rows, gone, "row", "left_anti").select(*COLUMNS)


def private_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal numbers and dates, under the session's key."""
    changed = pii.pseudonymise_texts(docs.select(*COLUMNS), pii.session_key(spark)).drop("pii_kinds")
    return changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it; texts are only read, never shuffled."""
    sized = docs.select(*COLUMNS).withColumn("size", mixing.word_count("text")).withColumn("sources", F.array("source"))
    taken = mixing.taken(sized, ["doc_id", "text", "lang", "source", "n_chars"]).where("times > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; exact: they decode to its text."""
    return pieces.encode_texts(docs.select("doc_id", "text", "source")).select("doc_id", "source", "n_pieces", "piece_ids", "exact")


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", copies_out),
    ("pseudonyms", private_out),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: Models, component search and piece paths are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs, cuts = table(spark, sf_dir, "documents"), Cuts(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cuts.write(docs)
    return docs
