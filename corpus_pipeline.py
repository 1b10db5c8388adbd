"""Corpus pipeline: five stages from documents to token ids, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lang_parse, ngram_jaccard, rindex_dedup, sentencepiece_bpe
from tidemark.llm._common import keyed, shared_dir
from tidemark.llm.queries import tokenizer_path

COLUMNS = ("text", "lang", "source", "n_chars")
#: Phrases a character above which a text, one phrase at its end let go, is in none of the learned languages.
FOREIGN_RATE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that no learned language parses well."""
    rows = keyed(docs, "doc_id", *COLUMNS)
    model = lang_parse.train(rows.where(~lang_parse.held_out()))
    told = lang_parse.identify(rows, model, COLUMNS)
    parsed = F.length(F.regexp_replace("text", r"[^\p{L}]+", " "))
    foreign = F.col("phrase_rate") > FOREIGN_RATE + 1 / parsed
    return told.where((F.col("lang_pred") != "und") & ~foreign).select("doc_id", *COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group that shares four fifths of its five-word shingles."""
    groups = ngram_jaccard.ngram_jaccard_join(docs, width=5, percent=80)
    return docs.join(groups.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select("doc_id", *COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 100 bytes or more that also start earlier in the corpus."""
    cut = rindex_dedup.suffix_dedup(docs, length=100, keep_text=True).select("doc_id", F.col("kept_text").alias("text"))
    return cut.join(docs.select("doc_id", "lang", "source"), "doc_id").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    told = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return told.where(~F.col("contaminated")).select("doc_id", *COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text, decode the ids, and give both digests."""
    return sentencepiece_bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL has neither the parses, the tokenizer nor the search; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
    return docs
