"""Substring search by an index of trigrams, for facts and relationships that are searched again and again.

Every row's searched columns are cut into runs of three characters (in lower case); a posting is (trigram, id). Postings are
written in buckets by a trigram's hash, so a query reads the buckets of its own trigrams alone. Ids that have all of them are confirmed by
looking for the query in the row itself, so the result is that of a scan. A query of under three characters has no
trigram and is a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _trigrams(text: Column) -> Column:
    """The distinct runs of three characters."""
    runs = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2))
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(runs, lambda i: F.substr(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def write_index(rows: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Write the postings of `rows` (key: a unique id) over `columns`: (bucket, trigram, id), sorted by trigram inside a bucket's files.

    A trigram that very many rows have is spread over a bucket's files by id, of which there are as many as tasks write.
    """
    grams = F.array_distinct(F.flatten(F.array(*(_trigrams(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in columns))))
    postings = rows.select(F.col(key).alias("id"), F.explode(grams).alias("trigram")).withColumn("bucket", _bucket(F.col("trigram")))
    spread = postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4)))
    spread.sortWithinPartitions("bucket", "trigram", "id").write.partitionBy("bucket").parquet(path)


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """Ids whose columns have all of the query's trigrams between them; None for a query without any."""
    low = query.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams:
        return None
    buckets = [r["b"] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket(F.col("g")).alias("b")).distinct().collect()]
    postings = spark.read.parquet(path).filter(F.col("bucket").isin(buckets) & F.col("trigram").isin(grams))
    return postings.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("id")


def search(rows: DataFrame, key: str, columns: list[str], path: str, query: str) -> DataFrame:
    """Rows with the query, in any case, in one of `columns`, by an index that write_index() made of these rows and columns. A blank query finds all."""
    if not query.strip():
        return rows
    confirmed = F.greatest(*(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower())) for c in columns)) if len(columns) > 1 else F.contains(F.lower(F.coalesce(F.col(columns[0]), F.lit(""))), F.lit(query.lower()))
    found = candidates(rows.sparkSession, path, query)
    own = rows if found is None else rows.join(found, F.col(key) == F.col("id"), "left_semi")
    return own.filter(confirmed)
