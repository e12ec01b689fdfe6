"""Raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import lines, mixing, neardup, packing, quality
from rasterloom.llm.queries import table, tokenizer_path
from rasterloom.llm.workspace import Scratch, passing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, as they are.

    Null and empty texts have too few words and go; a null id stays what it is; repeated
    rows are judged alike; columns beside the documents' own are left out; an empty table
    stays empty; texts are judged whole, however long.
    """
    labels = table(spark, sf_dir, "labels")
    judged = quality.quality_rules(docs.withColumnRenamed("doc_id", "id"), labels.withColumnRenamed("doc_id", "id"), id_col="id", keep=COLUMNS[1:])
    return judged.where("kept").select(F.col("id").alias("doc_id"), *COLUMNS[1:])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one whose words are all gone goes.

    Of equal or near lines the one with the smallest id, then the first, stays.  Documents
    with null text or none have no words and go.
    """
    left = lines.deduplicate_lines(docs, keep=["lang", "source"]).where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: all rows with its smallest id.

    Rows with a null id are all kept; equal ids are one document.
    """
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them; a null source is one of its own."""
    mixed = mixing.mix_sources(docs.withColumnRenamed("doc_id", "id"), id_col="id", keep=COLUMNS[1:])
    taken = mixing.mixed_documents(mixed)
    return taken.select(F.col("id").alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences; a document that the mix takes twice is packed twice."""
    return packing.pieces_crc(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Log-ratios, sketches and tokenizer ids are outside SQL.  Tests hold near duplicates against brute force, quality against its
#: own operator, lines for exact copies only, and mixing and packing by properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again.

    Once a stage's result is written, what the stage read and wrote on its way is deleted, so
    disk holds one stage at a time.
    """
    scratch = Scratch(spark, "pipeline")
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with passing():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(*read)
        scratch.release()
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
