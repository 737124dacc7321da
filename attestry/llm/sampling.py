"""Sampled segmentations over the piece lattice, and lossless decoding.

Encoding filters forward over the lattice of every distinct stretch of text and samples backward for each of its
occurrences. Each choice is seeded by the row's key and the place in its text, so a row is cut alike in any batch,
partition or run. Nothing is normalised: a space is the vocabulary's space mark, a character without a piece becomes
its bytes, and one space mark stands before the text; decoding undoes exactly that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .langid import MODEL_FILE, vocabulary_path
from .lattice import FALLBACK, RAW_MARK, SPACE_MARK, Pieces, forward, lattice, pieces

#: A piece weighs (1 + rank) ** -STEEPNESS; a character spelled in bytes weighs BYTE_WEIGHT.
STEEPNESS, BYTE_WEIGHT = 1.0, 1e-9
#: Bytes of text at a time: so much varied text makes more than as many edges, at some 100 bytes each.
SLICE = 1 << 18
#: Chances are multiples of 1 / GRAIN, exact beside any node number, so that a choice is the same wherever its string lies: what is likelier
#: by less than that may be drawn as another, and a cut with a chance below it never is.
GRAIN = 1 << 24


Runner = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _unit_string(raw: bytes, first: bool) -> str:
    text = raw.decode("utf-8", "replace").replace(SPACE_MARK, RAW_MARK).replace(" ", SPACE_MARK)
    return SPACE_MARK + text if first else text


def _widths(strings: list[str], firsts: np.ndarray) -> np.ndarray:
    """For each node, the bytes of raw text before it in its string."""
    point = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32)
    size = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
    size[point == ord(SPACE_MARK)] = 1
    length = np.array([len(s) for s in strings], dtype=np.int64)
    begin = np.cumsum(length) - length
    size[begin[firsts]] = 0  # the space mark before a text
    upto = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(strings)), length + 1)
    return upto[np.arange(len(owner)) - owner] - upto[begin[owner]]


class _Sampler:
    """The lattices of a slice's distinct stretches, ready for backward steps."""

    def __init__(self, strings: list[str], firsts: np.ndarray, vocabulary: Pieces):
        graph = lattice(strings, vocabulary)
        weight = (1.0 + vocabulary.ranks) ** -STEEPNESS
        w = np.where(graph.piece == FALLBACK, BYTE_WEIGHT, weight[graph.piece])
        alpha, scale = forward(graph, w[:, None])
        share = alpha[graph.source, 0] * w * np.exp(scale[graph.source] - scale[graph.target])
        nodes = len(alpha)
        count = np.bincount(graph.target, minlength=nodes)
        self.first = np.concatenate([[0], np.cumsum(count)])
        within = share
        at, end = self.first[:-1][count > 1] + 1, self.first[1:][count > 1]
        while len(at):  # running sums, node by node, so that a string's bounds don't depend on its neighbours
            within[at] += within[at - 1]
            at, end = at[at + 1 < end] + 1, end[at + 1 < end]
        within /= within[self.first[1:] - 1][graph.target]
        self.bound = graph.target + np.floor(np.minimum(within, 1.0) * GRAIN) / GRAIN
        self.bound[self.first[1:][count > 0] - 1] = np.flatnonzero(count) + 1.0
        self.source, self.piece, self.base = graph.source, graph.piece, graph.base
        self.end = graph.base + graph.length
        self.width = _widths(strings, firsts)

    def step(self, node: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """The edge chosen into each node."""
        edge = np.searchsorted(self.bound, node + chance, side="right")
        return np.clip(edge, self.first[node], self.first[node + 1] - 1)


def _sampled(data: np.ndarray, rows: np.ndarray, origin: np.ndarray, keys: np.ndarray, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows' sampled pieces, one row after the other, and row bounds. origin: where each row's whole text begins."""
    h, starts, ends, bounds, trailing = K.units(data, rows)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(bounds))
    if len(trailing):  # white space at the end of a row is a stretch of its own
        begin = np.array([ends[bounds[i + 1] - 1] if bounds[i + 1] > bounds[i] else rows[i] for i in trailing])
        h, starts, ends, owner = np.concatenate([h, K.hashes(data, begin, rows[trailing + 1])]), np.concatenate([starts, begin]), np.concatenate([ends, rows[trailing + 1]]), np.concatenate([owner, trailing])
    if not len(h):
        return np.zeros(0, dtype=np.int32), np.zeros(len(rows), dtype=np.int64)
    first = starts == origin[owner]
    at, unit, _ = K.distinct(K.mix(h + first.astype(np.uint64)), data, starts, ends, also=first)
    firsts = first[at]
    raw, lowest = data[rows[0] : rows[-1]].tobytes(), int(rows[0])
    strings = [_unit_string(raw[i - lowest : j - lowest], f) for i, j, f in zip(starts[at].tolist(), ends[at].tolist(), firsts.tolist(), strict=True)]
    lattices = _Sampler(strings, firsts, vocabulary)
    slots = np.full(int(rows[-1] - rows[0]) + len(rows), -1, dtype=np.int32)  # one before each row's bytes
    node, start, row = lattices.end[unit], starts - rows[0], owner
    floor = lattices.base[unit]
    salt = K.mix(keys ^ np.uint64(0x5851F42D4C957F2D))
    passed = rows[0] - origin  # from a text's begin to the slice's
    while len(node):
        before = lattices.width[node]
        place = start + before  # byte position of the piece's end, from the slice's first byte
        chance = (K.mix(salt[row] + (place + passed[row] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (node == floor + 1).astype(np.uint64)) >> np.uint64(40)) / GRAIN
        edge = lattices.step(node, chance)
        piece, source = lattices.piece[edge], lattices.source[edge]
        plain = piece != FALLBACK
        slots[(place + row)[plain]] = piece[plain]
        raw = ~plain
        if raw.any():
            size, last = (before - lattices.width[source])[raw], place[raw]
            for j in range(4):
                m = size > j
                slots[(last + row[raw])[m] - j] = vocabulary.byte_id + data[rows[0] + last[m] - 1 - j]
        go = source > floor
        node, start, row, floor = source[go], start[go], row[go], floor[go]
    marked = slots >= 0
    cuts = np.concatenate([[0], np.cumsum(marked)])
    return slots[marked], cuts[rows - rows[0] + np.arange(len(rows))]


def _encoder(path: str, rest: list[str]) -> Runner:
    """Batches of the columns `rest` (text among them) and a seed to batches of `rest` and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in batches:
            texts = batch.column("text")
            data, offsets = K.utf8(texts)
            seeds = batch.column(batch.num_columns - 1).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts: list[np.ndarray] = []
            for lo, hi, rows in K.segments(data, offsets, SLICE):
                ids, bounds = _sampled(data, rows, offsets[lo:hi], seeds[lo:hi], vocabulary)
                if rows[-1] < offsets[hi]:
                    parts.append(ids)
                    continue
                if parts:
                    ids, parts = np.concatenate([*parts, ids]), []
                    bounds = np.array([0, len(ids)])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=texts[lo:hi].is_null())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], lists], names=[*rest, "ids"])

    return run


def _decoder(path: str) -> Runner:
    """Batches with ids to batches with decoded besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = _spellings(path)
        for batch in batches:
            lists = batch.column("ids")
            data, at = spelled
            bounds = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)
            texts: list[pa.Array] = []
            for lo, hi in K.slices(bounds, 1 << 20):
                own = ids[bounds[lo] : bounds[hi]]
                size = at[own + 1] - at[own]
                ends = np.concatenate([[0], np.cumsum(size)])
                out = data[np.repeat(at[own] - ends[:-1], size) + np.arange(ends[-1])]
                cuts = ends[bounds[lo : hi + 1] - bounds[lo]]
                skip = (np.diff(cuts) > 0).astype(np.int64)  # the space mark before the text
                keep = np.ones(len(out), dtype=bool)
                keep[cuts[:-1][skip > 0]] = False
                cuts = cuts - np.concatenate([[0], np.cumsum(skip)])
                made = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out[keep]))
                texts.append(made.cast(pa.string()))
            decoded = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
            if lists.null_count:
                decoded = pc.if_else(lists.is_valid(), decoded, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return run


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, key: Column, path: str | None = None) -> DataFrame:
    """`docs` (text, ...) with ids, the array of a sampled segmentation's piece ids, seeded by `key` (a long; null counts as 0).

    A null text has null ids, an empty one none. Equal texts under equal keys get equal ids. All columns of the
    input stay, but for a former ids.
    """
    docs = docs.drop("ids")
    run = _encoder(path or vocabulary_path(MODEL_FILE), docs.columns)
    return docs.select("*", key.cast("long").alias("_seed")).mapInArrow(K.task(run), f"{_ddl(docs)}, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """`coded` (ids, ...) with decoded, the text that the piece ids spell; null ids decode to null. A former decoded goes."""
    coded = coded.drop("decoded")
    return coded.mapInArrow(K.task(_decoder(path or vocabulary_path(MODEL_FILE))), f"{_ddl(coded)}, decoded string")


def encode_and_decode(docs: DataFrame, key: Column, path: str | None = None) -> DataFrame:
    """decode(encode(docs, key)) in one worker for each task."""
    path, docs = path or vocabulary_path(MODEL_FILE), docs.drop("ids", "decoded")
    forth, back = _encoder(path, docs.columns), _decoder(path)
    return docs.select("*", key.cast("long").alias("_seed")).mapInArrow(K.task(lambda batches: back(forth(batches))), f"{_ddl(docs)}, ids array<int>, decoded string")


def _spellings(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces, one after the other, and where each begins."""
    vocabulary = pieces(path)
    if path not in _spelled:
        parts = [bytes([i - vocabulary.byte_id]) if vocabulary.byte_id <= i < vocabulary.byte_id + 256 else name.replace(SPACE_MARK, " ").encode() for i, name in enumerate(vocabulary.names)]
        _spelled[path] = np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return _spelled[path]


_spelled: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    back = encode_and_decode(docs, F.col("doc_id"))
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.hash("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"),
    )
