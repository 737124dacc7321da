"""The training-data pipeline over `documents`: five stages, each on all that the one before it kept.

Each stage is (name, function); function(spark, docs, sf_dir) returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontam, langid, linededup, neardup, sampling
from attestry.llm.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text stays if its language's posterior reaches this.
LEAST_SCORE = 0.5


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c) for c in COLUMNS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; undecided texts (without a letter, or with a posterior under one half) go."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return _documents(langid.identify(_documents(docs), model).filter((F.col("lang_pred") != langid.UNDECIDED) & (F.col("score") >= LEAST_SCORE)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without duplicate lines, n_chars counted anew; documents that lost lines and have no word left go."""
    out = linededup.dedup_lines(_documents(docs), short=True)
    left = out.filter((F.col("n_removed") == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    return _documents(left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Rows with a null doc_id stay. Texts that share a doc_id are judged each by itself."""
    gone = written(neardup.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_gone"), "tkey").distinct(), "gone")
    of = (docs.doc_id.cast("long") == gone["_gone"]) & (F.xxhash64(docs.text.cast("string")) == gone.tkey)
    return _documents(docs.join(gone, of, "left_anti"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a test item."""
    found = decontam.find_leaks(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _documents(found.filter(F.size("leaks") == 0))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, ids, and whether the ids decode to the very text."""
    back = sampling.encode_and_decode(_documents(docs), F.col("doc_id"))
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_neardup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: Language ID, the MinHash candidates and the sampled segmentations have no SQL form. tests/llm/test_words.py runs each stage and run() on a small table with a known result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
