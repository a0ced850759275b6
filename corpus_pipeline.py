"""A training-corpus pipeline of the operators in ``roadtrace.llm``; each stage's output is written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.llm import decontam, jaccard, langid, linededup, packing
from roadtrace.llm.storage import release, scratch, shared_folder

#: Documents whose language is undetermined or less certain than this go.
LEAST_CERTAIN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters (null or empty text among them) or of an uncertain language go.

    Rows of a null lang teach nothing and are predicted like all others; repeated
    rows are each judged; a table from which no language can be learned keeps no row.
    """
    found = langid.identify(docs)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_CERTAIN)).select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; ``n_chars`` follows the text. A null text becomes an empty one; repeated rows count as documents of their own."""
    kept = linededup.drop_repeated_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates. Rows that repeat id and text are one; texts without words and rows of a null id all stay."""
    return jaccard.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text; a null or wordless text is clean, and so is every text where the benchmark is empty."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token sequences of at most 4096 ids; a null or empty text is its end id alone, and repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]
#: Trained models and token ids are no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows. An empty table passes every stage; other columns, whatever their names, are carried to the last but one.

    What a stage put in the shared folder goes once its output is written, and that
    output once the next one's is; the last one's stays for the caller to read.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = shared_folder(spark, "stage")
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            release([last])
        last = path
    return docs
