"""MinHash near-duplicate detection with tensored banding.

A document is its set of distinct 5-word shingles. Copies with equal sets collapse first. Of each remaining set
a few *collections* (short tuples of minimum hashes) are computed; the table keys are all pairs of collections, so
m collections of width w give m(m-1)/2 tables of 2w rows from only m*w minimum hashes, the square root of what
independent bands would take. A 512-bit sketch keeps hopeless candidates out; the rest are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .linking import BITS, BROADCAST_IDS, classes
from .scratch import written

SHINGLE_WORDS = 5
#: Linked at 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 12 collections of 2: 66 tables of 4 rows from 24 minimum hashes. At similarity 0.75 a pair shares none with probability 0.0008.
COLLECTIONS, WIDTH = 12, 2


def sketches(docs: DataFrame, shingle: int = SHINGLE_WORDS, collections: int = COLLECTIONS, width: int = WIDTH) -> DataFrame:
    """(doc_id, tkey, n_shingles, d1, d2, c0 .. c{m-1}, s0 ..): a hash of the text, size and 128-bit digest of each document's shingle set, its collections and sketch bits."""
    fields = [("doc_id", pa.int64()), ("tkey", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), *((f"c{i}", pa.int64()) for i in range(collections)), *((s, pa.int64()) for s in BITS)]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(2))
            for lo, hi in K.slices(offsets):
                h, _, _, bounds = K.words(data, offsets[lo : hi + 1], lower=True)
                sets, bounds = K.shingle_sets(h, bounds, shingle)
                d1, d2 = K.set_digest(sets, bounds)
                least = K.minhashes(sets, bounds, collections * width, 11)
                cells = [np.sum([least[:, i * width + j].astype(np.uint64) * f for j, f in enumerate(K.multipliers(width, 12))], axis=0, dtype=np.uint64) for i in range(collections)]
                bits = K.sketch_bits(K.one_permutation(sets, np.repeat(np.arange(hi - lo), np.diff(bounds)), hi - lo))
                columns = [batch.column(0)[lo:hi], batch.column(1)[lo:hi], np.diff(bounds), d1, d2, *(K.mix(c).view(np.int64) for c in cells), *np.ascontiguousarray(bits.T)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) if isinstance(c, np.ndarray) else c for c, (_, t) in zip(columns, fields, strict=True)], schema=schema)

    ddl = ", ".join(f"{n} long" for n, _ in fields)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string")).mapInArrow(K.task(run), ddl)


def shingle_sets(texts: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id, members): the whole shingle sets of texts (id, text), as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(1))
            for lo, hi in K.slices(offsets):
                h, _, _, bounds = K.words(data, offsets[lo : hi + 1], lower=True)
                sets, bounds = K.shingle_sets(h, bounds, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))], names=["id", "members"])

    return texts.select("id", "text").mapInArrow(K.task(run), "id long, members array<long>")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate classes of documents (doc_id, text, ...): doc_id, n_shingles, component_id, kept, tkey, one row for each input row.

    Words are runs of anything but \\x20 and \\x09-\\x0D, A-Z in lower case. A text of 1 to 4 words is one shingle;
    an empty, blank or null text has none and is linked with nothing. component_id is the smallest doc_id
    reachable over links, kept says that it is the row's own. Texts are told apart by themselves, so rows that share a doc_id
    may be in different classes (tkey, xxhash64 of the text, tells which is which), and equal rows get equal results;
    a null doc_id gets a null component_id and is kept. Other columns of the input are not read.
    """
    own = written(sketches(docs, shingle), "sketches")
    full = own.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    cells = [f"c{i}" for i in range(COLLECTIONS)]
    same = full.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "tkey")).alias("at"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in [*cells, *BITS]))
    same = written(same.withColumn("id", F.monotonically_increasing_id()), "sets")
    keys = F.array(*(F.xxhash64(F.lit(i * COLLECTIONS + j), f"c{i}", f"c{j}") for i, j in combinations(range(COLLECTIONS), 2)))

    def members(ids: DataFrame) -> DataFrame:
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        places = same.select("id", "at.*").join(F.broadcast(ids) if few else ids, "id", "left_semi")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tkey"), F.col("text").cast("string").alias("text"))
        return shingle_sets(texts.join(F.broadcast(places) if few else places, ["doc_id", "tkey"]).dropDuplicates(["id"]), shingle)

    _, roots = classes(same.select("id", keys.alias("keys"), "n", *BITS), members, percent, source=same)
    rooted = same.select("d1", "d2", "at", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = rooted.groupBy("root").agg(F.min("at.doc_id").alias("component_id"))
    groups = rooted.select("d1", "d2", "root").join(first, "root").select("d1", "d2", "component_id")
    rows = full.select("doc_id", "tkey", "n_shingles", "d1", "d2").join(groups, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id", "tkey")
    rest = own.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "tkey")
    return rows.unionByName(rest).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "tkey")


def op9_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    """One row for each document: its shingles, the smallest doc_id of its component, and whether that is its own."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tkey")
