"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A seed is a run of three words of a test item that is rare: its chance under the corpus's own word frequencies is
at most RARE, or so small that less than one is expected in the whole corpus (an item without enough such runs
brings its rarest). A leaked passage that repeats all over the corpus
doesn't make its own seeds common, as words and not runs are counted. Where a document holds seeds of an item, the
words around them are aligned with the item; edits, insertions and gaps lower the score but don't hide the copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SEED_WORDS, RARE, LEAST_SEEDS = 3, 1e-8, 8
MATCH, MISMATCH, GAP = 2, -1, 1
#: An item leaks from this share of its full alignment score on, if at least LEAST_WORDS of its words (all, if it has fewer) are worth the score.
SHARE, LEAST_WORDS = 0.4, 8
#: Or, whatever its share, if so many of its words are left when each edit costs EDIT, two matches: a passage out of a long item.
PASSAGE_WORDS, EDIT = 25, 4
#: Items in one pass over the corpus; a larger benchmark is taken in blocks of so many.
BLOCK_ITEMS = 20_000
#: And characters of items in one pass (one item at least); what is broadcast takes some four bytes for each.
BLOCK_CHARS = 16 << 20
#: Cells of the alignments that are made side by side.
CELLS = 1 << 21
LEAKS = "array<struct<item_id:long,score:double,seeds:long>>"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.utf8(texts)
    h, _, _, bounds = K.words(data, offsets, lower=True, apart=K.MARKS)
    return h, bounds


def _word_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each hash of `vocabulary` (sorted) is a word of the corpus, and the number of all its words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, seen = shared.value, 0, np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            data, offsets = K.utf8(batch.column(0))
            for lo, hi in K.slices(offsets):
                h, _, _, _ = K.words(data, offsets[lo : hi + 1], lower=True, apart=K.MARKS)
                total += len(h)
                at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                seen += np.bincount(at[own[at] == h], minlength=len(own))
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(seen[found], total))], names=["word", "n"])

    counts = np.zeros(len(vocabulary), dtype=np.int64)
    total = 0
    for r in docs.select("text").mapInArrow(K.task(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r["word"] < 0:
            total = r["n"]
        else:
            counts[r["word"]] = r["n"]
    return counts, total


def _seeds(h: np.ndarray, bounds: np.ndarray, chance: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted seed hashes, and the item and place in it of each. chance: log frequency of each word of the items."""
    grams, at = K.ngrams(h, bounds, SEED_WORDS)
    item = np.searchsorted(bounds, at, side="right") - 1
    rare = sum(chance[at + j] for j in range(SEED_WORDS))
    order = np.lexsort((rare, item))
    first = np.searchsorted(item[order], np.arange(len(bounds)))
    rank = np.arange(len(order)) - first[item[order]]
    take = order[(rank < LEAST_SEEDS) | (rare[order] <= np.log(max(RARE, 1 / max(1, total))))]
    take = take[np.argsort(grams[take], kind="stable")]
    return grams[take], item[take], at[take] - bounds[item[take]]


def align(items: list[np.ndarray], passages: list[np.ndarray], mismatch: int = MISMATCH, gap: int = GAP) -> np.ndarray:
    """Smith-Waterman scores of word sequences, pair by pair: the best local alignment of each item with its passage."""
    out = np.zeros(len(items), dtype=np.int64)
    order = np.argsort([len(x) * 4096 + len(y) for x, y in zip(items, passages, strict=True)])
    lo = 0
    while lo < len(order):
        widest = max(len(passages[i]) for i in order[lo : lo + 256])
        part = order[lo : lo + min(256, max(1, CELLS // max(1, widest)))]
        lo += len(part)
        m, w = max(len(items[i]) for i in part), max(len(passages[i]) for i in part)
        a, b = np.zeros((len(part), m), dtype=np.uint64), np.ones((len(part), w), dtype=np.uint64)  # 0 and 1: never the same
        for k, i in enumerate(part):
            a[k, : len(items[i])], b[k, : len(passages[i])] = items[i], passages[i]
        slope = gap * np.arange(w, dtype=np.int32)
        h = np.zeros((len(part), w), dtype=np.int32)
        best = np.zeros(len(part), dtype=np.int32)
        for i in range(m):
            step = np.where(b == a[:, i : i + 1], np.int32(MATCH), np.int32(mismatch))
            step[:, 1:] += h[:, :-1]
            np.maximum(step, h - gap, out=step)
            np.maximum(step, 0, out=step)
            h = np.maximum.accumulate(step + slope, axis=1) - slope
            np.maximum(best, h.max(axis=1), out=best)
        out[part] = best
    return out


def _short(h: np.ndarray, bounds: np.ndarray, ids: list[list[int]]) -> dict[tuple[int, ...], list[int]]:
    """Ids of the items that have words, but too few for a seed, by their words."""
    out: dict[tuple[int, ...], list[int]] = {}
    size = np.diff(bounds)
    for i in np.flatnonzero((size > 0) & (size < SEED_WORDS)).tolist():
        out.setdefault(tuple(h[bounds[i] : bounds[i + 1]].tolist()), []).extend(ids[i])
    return out


def _equal(h: np.ndarray, bounds: np.ndarray, short: dict[tuple[int, ...], list[int]]) -> dict[int, list[tuple[int, float, int]]]:
    """For each row that has the very words of a short item, its (item_id, 1, 0)."""
    size = np.diff(bounds)
    rows = np.flatnonzero((size > 0) & (size < SEED_WORDS)).tolist() if short else []
    words = {r: tuple(h[bounds[r] : bounds[r + 1]].tolist()) for r in rows}
    return {r: [(i, 1.0, 0) for i in sorted(set(short[w]))] for r, w in words.items() if w in short}


def _found(h: np.ndarray, bounds: np.ndarray, block: dict) -> dict[int, list[tuple[int, float, int]]]:
    """For each row that leaks, its (item_id, score, seeds)."""
    out = _equal(h, bounds, block["short"])
    grams, at = K.ngrams(h, bounds, SEED_WORDS)
    seeds = block["seeds"]
    lo, hi = np.searchsorted(seeds, grams), np.searchsorted(seeds, grams, side="right")
    hits = np.flatnonzero(hi > lo)
    if not len(hits):
        return out
    many = hi[hits] - lo[hits]
    place = np.repeat(at[hits], many)
    seed = np.repeat(lo[hits] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    row, item = np.searchsorted(bounds, place, side="right") - 1, block["item"][seed]
    begin = place - block["at"][seed]  # where the item would begin
    order = np.lexsort((begin, item, row))
    row, item, begin = row[order], item[order], begin[order]
    size = block["bounds"][item + 1] - block["bounds"][item]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    slack = size[first] // 2 + 4
    left = np.maximum(bounds[row[first]], begin[first] - slack)
    right = np.minimum(bounds[row[first] + 1], begin[last] + size[first] + slack)
    items = [block["h"][block["bounds"][i] : block["bounds"][i + 1]] for i in item[first]]
    passages = [h[x:y] for x, y in zip(left, right, strict=True)]
    score = align(items, passages)
    full = MATCH * size[first]
    leaks = (score >= SHARE * full) & (score >= np.minimum(full, MATCH * LEAST_WORDS))
    part = np.flatnonzero(~leaks & (score >= MATCH * PASSAGE_WORDS))
    leaks[part] = align([items[i] for i in part], [passages[i] for i in part], -EDIT, EDIT) >= MATCH * PASSAGE_WORDS
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for k in np.flatnonzero(leaks):
        key, got = (int(row[first[k]]), int(item[first[k]])), (float(score[k] / full[k]), int(last[k] - first[k] + 1))
        best[key] = max(best.get(key, (0.0, 0)), got)
    for (r, i), (s, n) in sorted(best.items()):
        out.setdefault(r, []).extend((item_id, s, n) for item_id in block["ids"][i])
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """`docs` (text, ...) with leaks: an array of (item_id, score, seeds), one for each test item that the text holds.

    benchmark: (item_id, text). Words are runs of letters and digits (and of anything beyond ASCII), A-Z in lower
    case. score is the alignment score over that of the whole item, 0.4 to 1, or less for a passage out of a
    longer item: 25 verbatim words, and two more for each edit inside it. Null or wordless texts hold nothing;
    null items and ones with a null id take no part; an item of one or two words leaks only into a text that has
    no other words (score 1, no seeds), as ordinary texts hold such words by the way; one of 3 to 7 words must
    occur whole. Items repeated under one id count once where their texts are the same. All columns of `docs` stay,
    but for a former leaks.
    """
    out = docs.drop("leaks").withColumn("leaks", F.array().cast(LEAKS))
    told = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    # items of one text are aligned once
    told = told.groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("ids")).orderBy(F.get("ids", F.lit(0)), "text")
    block: list = []
    chars = 0
    for r in told.toLocalIterator():
        if block and (len(block) == block_items or chars + len(r["text"]) > BLOCK_CHARS):
            out, block, chars = _marked(out, docs, block), [], 0
        block.append(r)
        chars += len(r["text"])
    return _marked(out, docs, block) if block else out


def _marked(out: DataFrame, docs: DataFrame, items: list) -> DataFrame:
    h, bounds = _words(pa.array([r["text"] for r in items], pa.large_string()))
    vocabulary, of = np.unique(h, return_inverse=True)
    if not len(vocabulary):
        return out
    counts, total = _word_counts(docs, vocabulary)
    chance = np.log((counts + 1) / (total + len(vocabulary)))
    seeds, item, at = _seeds(h, bounds, chance[of], total)
    shared = docs.sparkSession.sparkContext.broadcast({"seeds": seeds, "item": item, "at": at, "h": h, "bounds": bounds, "ids": [r["ids"] for r in items], "short": _short(h, bounds, [r["ids"] for r in items])})
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("seeds", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            leaks: dict[int, list] = {}
            for lo, hi in K.slices(offsets):
                h, _, _, bounds = K.words(data, offsets[lo : hi + 1], lower=True, apart=K.MARKS)
                leaks |= {lo + r: [dict(zip(("item_id", "score", "seeds"), x, strict=True)) for x in v] for r, v in _found(h, bounds, shared.value).items()}
            at = batch.schema.names.index("leaks")
            column = batch.column(at)
            if leaks or column.null_count:
                before = column.to_pylist()
                column = pa.array([(before[i] or []) + leaks.get(i, []) for i in range(batch.num_rows)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1 :]], names=batch.schema.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(K.task(run), schema)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, score, seeds): every document and test item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.score", "leak.seeds")
