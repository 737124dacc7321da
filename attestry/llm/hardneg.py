"""Hard-negative mining by blocked dense products.

Anchors go out in blocks of a bounded number of bytes, one broadcast each; every task multiplies a block with its own
candidates in float64, which is exact while no inner product can reach 2^53 (beyond that int64 is used, and what could
leave that is an error). A task keeps for each anchor the best few of all its candidates, thresholds of earlier
candidates sparing it most of the later ones, and sends only those; lists of one anchor from several tasks merge into
one of the same length. A first pass finds each anchor's positives, a second one the negatives whose score lies in the
window that a positive's score opens. Both passes read all candidates, once for each block of anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import drop, written
from .vectors import finite, matrix

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOW to HIGH percent of the positive's.
LOW, HIGH = 50, 95
#: Bytes of a block's vectors as float64: what is broadcast at once.
BLOCK_BYTES = 1 << 24
#: Anchors and candidates whose scores are held at a time (16 MB).
ANCHORS, CANDIDATES = 2048, 1024
_NONE = np.iinfo(np.int64).min


class Best:
    """For each of `n` slots the `k` best (score, id), higher scores first, ties by smaller id, each id once."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), _NONE), np.zeros((n, k), dtype=np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(slot):
            return
        own = np.unique(slot)
        kept = self.score[own] != _NONE
        slot = np.concatenate([np.repeat(own, kept.sum(axis=1)), slot])
        score = np.concatenate([self.score[own][kept], score])
        ident = np.concatenate([self.id[own][kept], ident])
        order = np.lexsort((-score, ident, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        new = np.concatenate([[True], (slot[1:] != slot[:-1]) | (ident[1:] != ident[:-1])])
        slot, score, ident = slot[new], score[new], ident[new]
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.k
        self.score[own] = _NONE
        self.score[slot[keep], rank[keep]], self.id[slot[keep], rank[keep]] = score[keep], ident[keep]

    def least(self, lo: int, hi: int) -> np.ndarray:
        """What a score must reach to enter, for slots lo to hi."""
        return self.score[lo:hi, -1]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two int64 matrices, as int64."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    raise ValueError("inner products of these vectors do not fit 64 bits")


def _against(batches: Iterator[pa.RecordBatch], ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors lo to hi against some candidates: their scores, whether the candidate is another row of the same label, of a different one, and the candidates' ids."""
    part = 64  # the first candidates set thresholds and are few
    for batch in batches:
        mine, of, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), vectors.shape[1])
        at = 0
        while at < len(rows):
            end = min(at + part, len(rows))
            part = min(2 * part, CANDIDATES)
            for lo in range(0, len(ids), ANCHORS):
                hi = min(lo + ANCHORS, len(ids))
                other = ids[lo:hi, None] != mine[None, at:end]
                same = labels[lo:hi, None] == of[None, at:end]
                yield lo, hi, scores(vectors[lo:hi], rows[at:end]), same & other, ~same & other, mine[at:end]
            at = end


def _collected(block: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and vectors of a block of anchors (bounded by its caller)."""
    table = block.select("vec_id", "label", "vector").orderBy("vec_id").toArrow()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64)
    return table.column(0).to_numpy(), table.column(1).to_numpy(), matrix(table.column(2), width)


def _merged(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each anchor's candidates (..., id, score) over the tasks' lists, with rank from 1; each id once."""
    once = lists.repartition(by[0]).groupBy(*by, "id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Negatives (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchor` holds for.

    rows: vec_id, label and vector (array of longs), each vector's score being its inner product with the anchor's.
    An anchor's positives are its first `positives` other rows of the same label, higher scores first, ties by smaller
    vec_id; for each, of the rows of a different label with 100 * score from `low` to `high` times the positive's score the
    first `negatives` in the same order. Fewer are returned where there are no more; a negative score of a positive opens no window.

    Rows with a null vec_id, label or vector take no part. A shorter vector counts as if zeros followed. Where rows share
    a vec_id, the one with the least (label, vector) is the anchor, none of them is a partner of it, and a partner is
    named once, by its best score. An empty table gives an empty one. Other columns are not read.
    """
    spark = rows.sparkSession
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull())
    own = written(rows.filter(whole).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<long>"), anchor.alias("anchor")), "vectors")
    first = own.filter("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")
    anchors = written(first, "anchors")
    n, width = anchors.count(), own.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    count = -(-n * max(1, width) * 8 // block_bytes)
    candidates = own.select("vec_id", "label", "vector")
    found = []
    for g in range(count):
        block = _collected(anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(count)) == g), width)
        found.append(_of_block(candidates, block, positives, negatives, low, high))
    if not found:
        return spark.createDataFrame([], _SCHEMA)
    drop(own, anchors)
    return spark.read.schema(_SCHEMA).parquet(*(t.__dict__["written_to"] for t in found))


_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _of_block(candidates: DataFrame, block: tuple[np.ndarray, np.ndarray, np.ndarray], positives: int, negatives: int, low: int, high: int) -> DataFrame:
    context = candidates.sparkSession.sparkContext
    sent = context.broadcast(block)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = sent.value
        best = Best(len(ids), positives)
        for lo, hi, score, same, _, mine in _against(batches, ids, labels, vectors):
            slot, at = np.nonzero(same & (score >= best.least(lo, hi)[:, None]))
            best.add(slot + lo, score[slot, at], mine[at])
        slot, at = np.nonzero(best.score != _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(ids[slot]), pa.array(best.id[slot, at]), pa.array(best.score[slot, at])], names=["anchor_id", "id", "score"])

    near = written(_merged(candidates.mapInArrow(K.task(nearest), "anchor_id long, id long, score long"), ["anchor_id"], positives), "positives")
    pairs = near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).orderBy("anchor_id", "positive_id").toArrow()  # `positives` rows for each anchor of the block
    anchor_id, positive_id, positive_score = (c.to_numpy() for c in pairs.columns)
    place = np.searchsorted(block[0], anchor_id)  # ids of a block come in order
    turn = np.arange(len(place)) - np.searchsorted(place, place) if len(place) else place
    shape = (positives, len(block[0]))
    named, lowest, highest = np.zeros(shape, np.int64), np.full(shape, 1), np.zeros(shape, np.int64)  # an empty window
    named[turn, place] = positive_id
    exact = positive_score.astype(object)  # a hundred times a score may not fit 64 bits
    lowest[turn, place], highest[turn, place] = -(-low * exact // 100), high * exact // 100
    windows = context.broadcast((named, lowest, highest))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, labels, vectors), (named, lowest, highest) = sent.value, windows.value
        best = [Best(len(ids), negatives) for _ in range(positives)]
        for lo, hi, score, _, different, mine in _against(batches, ids, labels, vectors):
            for j, own in enumerate(best):
                slot, at = np.nonzero(different & (score >= np.maximum(lowest[j, lo:hi], own.least(lo, hi))[:, None]) & (score <= highest[j, lo:hi, None]))
                own.add(slot + lo, score[slot, at], mine[at])
        for j, own in enumerate(best):
            slot, at = np.nonzero(own.score != _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(ids[slot]), pa.array(named[j, slot]), pa.array(own.id[slot, at]), pa.array(own.score[slot, at])], names=["anchor_id", "positive_id", "id", "score"])

    lists = candidates.mapInArrow(K.task(hard), "anchor_id long, positive_id long, id long, score long")
    hardest = _merged(lists, ["anchor_id", "positive_id"], negatives)
    told = hardest.join(near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "positive_id"])
    out = written(told.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    for value in (sent, windows):
        value.destroy()
    drop(near)
    return out


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors (vec_id divisible by 50) against the whole of `embeddings`, components as whole 256ths."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.filter(F.col("label").isNotNull() & finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda c: F.floor(c.cast("double") * 256))
    return mine(rows.select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 50 == 0)


#: All anchors against all rows, as the definition says it.
OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
