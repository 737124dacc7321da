"""Substring dedup: repeated runs of words, found by level-wise doubling.

A window that repeats contains shorter windows that repeat, so lengths are taken level by level, each about twice the
one before, up to the length asked for; windows repeated at one length alone are extended to the next, and the work
ends as soon as none is left. The first level needs no window at every word: of each long window only its least short
window (by hash) is looked at, which equal windows have in common, so one place in some six is counted. Hashes
only bring places together at the lower levels; at the last one 128 bits tell windows apart.

Copies collapse first: all words of a text that an earlier one repeats word by word are covered, and its windows can't
be the earliest of anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import drop, written

WINDOW = 20
#: The first level's windows have at least so many words.
SHORTEST = 8


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths from the shortest to `window`, each at most twice the one before."""
    out = [window]
    while out[0] >= 2 * shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of each `span` neighbours, of equal ones the first, by doubling."""
    at, done = np.arange(len(x)), 1
    while done < span:
        step = min(done, span - done)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        done += step
    return at


def _leads(h: np.ndarray, bounds: np.ndarray, short: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside a row: its first word, the position of its least short window, and that one's hash."""
    grams, at = K.ngrams(h, bounds, short)
    starts = np.flatnonzero(_whole(h, bounds, window))
    if not len(starts):
        return starts, starts, np.zeros(0, dtype=np.uint64)
    # of equal short windows the first, so that equal windows at two places never share the place of theirs
    hashes = np.full(len(h), ~np.uint64(0))
    hashes[at] = grams
    first = _least(hashes, window - short + 1)[starts]
    return starts, first, hashes[first]


def _whole(h: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Whether the window from each word on stays inside its row."""
    out = np.zeros(len(h), dtype=bool)
    if len(h):
        row = np.searchsorted(bounds, np.arange(len(h)), side="right") - 1
        out = np.arange(len(h)) + window <= bounds[row + 1]
    return out


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column: rows lo to hi, the hashes of their words and each row's range of them."""
    data, offsets = K.utf8(column)
    for lo, hi in K.slices(offsets):
        h, _, _, bounds = K.words(data, offsets[lo : hi + 1])
        yield lo, hi, h, bounds


def _seeds(docs: DataFrame, short: int, window: int) -> DataFrame:
    """(doc_id, tkey, n, d1, d2, seeds): of each text its words, 128 bits of all of them in order, and the hashes of its windows' least short windows (one for each place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, bounds in _words(batch.column(2)):
                row = np.repeat(np.arange(hi - lo), np.diff(bounds))
                place = (np.arange(len(h)) - bounds[row]).astype(np.uint64) + np.uint64(1)
                total = []
                for seed in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(h + place * seed), dtype=np.uint64)])
                    total.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
                _, first, hashes = _leads(h, bounds, short, window)
                new = np.ones(len(first), dtype=bool)
                new[1:] = first[1:] != first[:-1]
                cut = np.searchsorted(first[new], bounds)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(hashes[new].view(np.int64)))
                columns = [batch.column(0)[lo:hi], batch.column(1)[lo:hi], np.diff(bounds).astype(np.int64), *total, lists]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["doc_id", "tkey", "n", "d1", "d2", "seeds"])

    return docs.select("doc_id", "tkey", "text").mapInArrow(K.task(run), "doc_id long, tkey long, n long, d1 long, d2 long, seeds array<long>")


def _extended(held: DataFrame, before: int, length: int, window: int, first: bool) -> DataFrame:
    """(doc_id, tkey, start, h1, h2) of the windows of `length` words that may repeat, in texts `held` (doc_id, tkey, text, alive).

    alive: of the first level the hashes of short windows that repeat, else the starts of windows of `before` words that do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = batch.column(3)
            for lo, hi, h, bounds in _words(batch.column(2)):
                own = alive[lo:hi]
                values, of = own.flatten().to_numpy(), np.repeat(np.arange(hi - lo), own.value_lengths().to_numpy())
                if first:  # a short window that repeats may stand where the text has it only by chance of the hash: a candidate more
                    starts, _, hashes = _leads(h, bounds, before, window)
                    row = np.searchsorted(bounds, starts, side="right") - 1
                    mark = K.mix(values.view(np.uint64) + of.astype(np.uint64))
                    good = starts[np.isin(K.mix(hashes + row.astype(np.uint64)), mark)]
                    if length < window:  # all windows of this length inside those
                        good = np.unique((good[:, None] + np.arange(window - length + 1)).ravel())
                else:
                    live = np.zeros(len(h) + 1, dtype=bool)
                    live[bounds[of] + values] = True
                    fits = np.flatnonzero(_whole(h, bounds, length))
                    good = fits[live[fits] & live[fits + length - before]]
                row = np.searchsorted(bounds, good, side="right") - 1
                at = pa.array(row + lo)
                pair = []
                for seed in (91, 92):
                    total = np.zeros(len(good), dtype=np.uint64)
                    for j, f in enumerate(K.multipliers(length, seed)):
                        total += K.stir(h[good + j] ^ np.uint64(seed)) * f if seed == 92 else h[good + j] * f
                    pair.append(K.mix(total).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array((good - bounds[row]).astype(np.int32)), *map(pa.array, pair)], names=["doc_id", "tkey", "start", "h1", "h2"])

    return held.select("doc_id", "tkey", "text", "alive").mapInArrow(K.task(run), "doc_id long, tkey long, start int, h1 long, h2 long")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Of `docs` (doc_id, text): (doc_id, tkey, starts, of), the windows of `window` words that repeat an earlier one, and (doc_id, tkey) of whole copies.

    starts: first words (0-based) of the windows, of: the doc_id where each stands first. tkey is xxhash64 of the text. A copy
    is a text of `window` words or more whose words are those of a text of a smaller doc_id; its windows, all of them
    repeats, are not listed. Earlier means a smaller doc_id, or the same one and an earlier start. Null texts and rows with a null doc_id take no part.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tkey"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    lengths = levels(window)
    short = lengths[0] if len(lengths) > 1 else window
    seeds = written(_seeds(own, short, window), "seeds")
    whole = seeds.filter(F.col("n") >= window)
    firsts = written(whole.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")).filter("many > 1").drop("many"), "firsts")
    copies = written(whole.select("doc_id", "tkey", "d1", "d2").join(firsts, ["d1", "d2"]).filter("doc_id > first").select("doc_id", "tkey").distinct(), "copies")
    lead = whole.join(copies, ["doc_id", "tkey"], "left_anti").dropDuplicates(["doc_id", "tkey"]).select("doc_id", "tkey", F.explode("seeds").alias("h"))
    lead = written(lead, "leads")
    twice = lead.groupBy("h").agg(F.count("*").alias("many")).filter("many > 1").select("h")
    alive = written(lead.join(twice, "h", "left_semi").groupBy("doc_id", "tkey").agg(F.collect_set("h").alias("alive")), "alive")
    drop(seeds, firsts, lead)
    found = None
    for k, length in enumerate(lengths[1:] or [window]):
        before = lengths[k]
        held = own.join(alive, ["doc_id", "tkey"]).dropDuplicates(["doc_id", "tkey"])
        windows = written(_extended(held, before, length, window, k == 0), "windows")
        drop(alive)
        first = windows.groupBy("h1", "h2").agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "start")).alias("first")).filter("many > 1").drop("many")
        if length < window:
            alive = written(windows.join(first, ["h1", "h2"], "left_semi").groupBy("doc_id", "tkey").agg(F.collect_list("start").alias("alive")), "alive")
        else:
            later = windows.join(first, ["h1", "h2"]).filter(F.struct("doc_id", "start") > F.col("first"))
            found = written(later.groupBy("doc_id", "tkey").agg(F.collect_list("start").alias("starts"), F.collect_list("first.doc_id").alias("of")), "repeats")
        drop(windows)
    return found, copies


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` (doc_id, text, ...) with kept (a string: the words that stay, joined by one space), n_words and n_removed (longs).

    Words are runs of anything but \\x20 and \\x09-\\x0D. A word goes if a window of `window` words covers it whose words,
    in order, also stand earlier: in a document of smaller doc_id, or in the same one with an earlier start. Windows are
    judged on the input, not on what is left. A null, empty or blank text has no words and is kept as an empty string;
    of a row with a null doc_id nothing goes, and it makes nothing else go. Rows that share a doc_id count as one document whose windows may start
    at the same word: an equal start isn't earlier, so repeated rows lose the same words. All columns stay, but for former ones of these three names.
    """
    docs = docs.drop("kept", "n_words", "n_removed")
    repeats, copies = repeated_windows(docs, window)
    names = docs.columns
    marks = repeats.select(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_tkey"), F.col("starts").alias("_starts"), F.lit(False).alias("_copy"))
    marks = marks.unionByName(copies.select(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_tkey"), F.array().cast("array<int>").alias("_starts"), F.lit(True).alias("_copy")))
    of = (docs.doc_id.cast("long") == F.col("_doc")) & (F.xxhash64(docs.text.cast("string")) == F.col("_tkey"))
    joined = docs.join(marks, of, "left").select(*names, "_starts", "_copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            for text, starts, copy in zip(batch.column("text"), batch.column("_starts"), batch.column("_copy"), strict=True):
                words = str(text.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes are cut at \x20 and \x09-\x0D
                total.append(len(words))
                if copy.as_py():
                    words = []
                elif starts.is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    at = starts.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    words = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
                kept.append(b" ".join(words))
                removed.append(total[-1] - len(words))
            own = {n: batch.column(n) for n in names}
            yield pa.RecordBatch.from_arrays([*own.values(), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*own, "kept", "n_words", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(K.task(run), f"{schema}{', ' * bool(names)}kept string, n_words long, n_removed long")


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each document: its words, how many go, and the digest of those that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
