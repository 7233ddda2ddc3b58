"""The training-data pipeline: documents in, packed sequences out.

Each stage is (name, function); a function takes (spark, docs, sf_dir), docs with the columns
of `documents`, and returns a DataFrame with the same columns (the last: packed pieces).
Stages are written as Parquet in the shared folder and read again, so a lost executor costs
a task and not the pipeline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table, written
from tickloom.llm.decontaminate import decontaminate
from tickloom.llm.langid import fit, score, unlike
from tickloom.llm.lines import dedup_lines
from tickloom.llm.packing import pack, word_lengths
from tickloom.llm.similar import one_of_each_similar
from tickloom.plans.ship import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those without a letter or unlike all languages go.

    The models are learned from the documents' own labels. A given lang stays, a null one
    becomes the prediction. Null and empty texts go, repeated rows are judged each, extra
    columns of any name pass through, an empty table gives an empty one.
    """
    ship(spark)
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    packed = docs.select("text", rest.alias("row"))
    scored = written(score(packed, fit(docs)), "scored")
    kept = unlike(scored, F.lit(True)).where(~F.col("rejected"))
    columns = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("text")}
    columns["lang"] = F.coalesce(columns["lang"], F.col("lang_pred"))
    return kept.select(*(columns[c].alias(c) for c in docs.columns))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; n_chars is that of the remaining text.

    Null texts stay null (n_chars null), a fully repeated text becomes empty; equal rows are cut
    alike; extra columns pass through, but for n_lines and n_removed, which go.
    """
    cut = dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 or more) stays: the least doc_id.

    Texts without a word (null too) are one group; rows with equal doc_id and text are one
    document, of which one row stays; extra columns of any name pass through.
    """
    ship(spark)
    return one_of_each_similar(docs).select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; equal rows share
    their fate; extra columns pass through."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document, by its words, in packed sequences. Null texts are one token (an end);
    repeated rows are packed each; only doc_id is carried along."""
    ship(spark)
    return pack(word_lengths(docs))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("best-fit packing", pack_sequences),
]

#: Groups of near copies and best-fit packing have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
