"""Relating documents as they arrive, with Structured Streaming.

Each micro-batch's pages give facts by themselves; its facts are joined with each other and with those of all batches
before, never the old ones with each other again. A store folder keeps documents with their positions, normalised facts
and relationships, each in a partition of its batch. A batch reads only partitions of earlier batches and overwrites
its own, so one that is run again after a failure repeats nothing; the stream's checkpoint is in the same folder.
All pages of a document come in one batch (one file, or one trigger); a document that is known already is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.extract import extract_facts
from ..operators.relate import candidate_pairs, classify, compare, normalize_facts
from ..scratch import drop, numbered, written

TABLES = ("documents", "facts", "relationships")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _kept(spark: SparkSession, store: str, table: str, like: DataFrame, before: int) -> DataFrame:
    """Rows of a table that batches before this one have kept."""
    path = f"{store}/{table}"
    if not _exists(spark, path):
        return like.limit(0)
    return spark.read.schema(StructType([*like.schema, StructField("batch", LongType())])).parquet(path).filter(F.col("batch") < before).drop("batch")


def add_batch(pages: DataFrame, batch: int, store: str) -> None:
    """Take in one batch of pages (doc_id, document_name, page_ord, page_number, text, and doc_pos if documents have their places already).

    Without doc_pos new documents get places after all that are kept, in the order of their names and ids.
    """
    spark = pages.sparkSession
    given = "doc_pos" in pages.columns
    own = written(pages.select("doc_id", *["doc_pos"] * given, "document_name", "page_ord", "page_number", "text"), "pages")
    place = F.min("doc_pos" if given else F.lit(None)).cast("long").alias("doc_pos")
    docs = own.groupBy("doc_id").agg(place, F.min("document_name").alias("document_name"))
    known = _kept(spark, store, "documents", docs, batch)
    fresh = docs.join(known.select("doc_id"), "doc_id", "left_anti")
    if not given:
        last = known.agg(F.coalesce(F.max("doc_pos"), F.lit(-1))).first()[0]
        fresh = numbered(fresh.drop("doc_pos"), "doc_pos", "document_name", "doc_id").withColumn("doc_pos", F.col("doc_pos") + F.lit(last)).select(*docs.columns)
    put = lambda df, table: df.write.mode("overwrite").parquet(f"{store}/{table}/batch={batch}")
    put(fresh, "documents")
    fresh = spark.read.schema(docs.schema).parquet(f"{store}/documents/batch={batch}")
    facts = normalize_facts(extract_facts(own.drop("doc_pos", "document_name").join(fresh, "doc_id")))
    put(facts, "facts")
    new = spark.read.schema(facts.schema).parquet(f"{store}/facts/batch={batch}")
    put(classify(compare(candidate_pairs(new, _kept(spark, store, "facts", facts, batch)))), "relationships")
    drop(own)


def relate_stream(pages: DataFrame, store: str) -> StreamingQuery:
    """Start taking in a stream of pages until what is there has been read; start it again for what comes later."""

    def run(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, store)

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str, table: str = "relationships") -> DataFrame:
    """All that the store has of a table: documents, facts (normalised) or relationships."""
    if table not in TABLES:
        raise ValueError(f"a store has {TABLES}")
    return spark.read.parquet(f"{store}/{table}").drop("batch")
