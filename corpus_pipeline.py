"""The corpus pipeline: stages over ``documents``, each written and read again.

Language ID, line dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing. Every stage
but the last returns the columns of ``documents``; ``n_chars`` follows the text.

Null ids, ids that several texts share, repeated rows, null and empty texts and an empty table
go through every stage by the rules of its operator; only a text without a letter is dropped as
such, by the first stage. Columns may come in any order.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import DOCUMENT, document_key
from contestry.llm.language import UNDETERMINED, fit_languages, identify, read_pieces
from contestry.llm.line_dedup import dedup_lines
from contestry.llm.ngram_join import similar_texts
from contestry.llm.packing import pack_documents
from contestry.llm.suffix_dedup import remove_repeats
from contestry.session import cut_lineage

#: Share of the probability that the best language needs.
LEAST_SCORE = 0.5


#: Rows of a batch between Spark and Python. Texts are long, and the executor and its Python
#: workers hold several batches beside each other, which no heap setting bounds.
BATCH_ROWS = 2_000


def in_small_batches(stage):
    """The stage, with BATCH_ROWS in this session from its call on, as it runs when it is written."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or a clear language go.

    Learns from all documents with a language.
    """
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    languages, probabilities = fit_languages(docs, pieces, F.lit(True))
    found = identify(docs, pieces, languages, probabilities, carry=[c for c in docs.columns if c != "doc_id"])
    told = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return found.where(told).select(docs.columns)


@in_small_batches
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that an earlier line equals or nearly equals."""
    cleaned = dedup_lines(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@in_small_batches
def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest id, and one row of it.

    Documents are told apart by id and text: other texts with the id of a dropped one stay, and
    documents without an id are compared like any other.
    """
    told = similar_texts(docs).groupBy(*DOCUMENT).agg(F.count("*").alias("_rows"), F.first("kept").alias("_kept"))
    odd = cut_lineage(told.where("NOT _kept OR _rows > 1"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *document_key(docs["doc_id"], docs["text"]))
    single = rows.join(odd, DOCUMENT, "left_anti")
    repeated = rows.join(odd.where("_kept"), DOCUMENT, "left_semi").dropDuplicates(DOCUMENT)
    return single.unionByName(repeated).select("_row.*")


@in_small_batches
def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes under strings of 200 that start anywhere else too."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cleaned = remove_repeats(docs, carry=rest, as_text=True).withColumnRenamed("kept", "text")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1,024 tokens."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(docs, tokenizer, public_tokenizers.PATTERN, end_id=2, capacity=1024)


STAGES = [
    ("language ID", keep_identified),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("suffix-array dedup", remove_repeated_strings),
    ("best-fit packing", pack),
]

#: A learned language model, connected components and a packing search are beyond SQL; the tests
#: hold every stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
