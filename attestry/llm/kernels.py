"""Array kernels over the UTF-8 bytes of an Arrow string column.

They run inside Spark tasks on one record batch at a time, and inside a batch on slices and blocks of a
bounded number of bytes, so that memory follows the longest single text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 21
BLOCK_BYTES = 1 << 17
#: White space as the contracts define it: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All of ASCII but letters and digits, for words without marks.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: Of eight bytes as a little-endian number, those of the first n.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


#: Bytes of a batch that goes to a worker, instead of Spark's 64 MB.
BATCH_BYTES = 1 << 23
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow; once a partition is done, memory that its arrays have freed goes back to the system, as workers stay for later tasks.

    Lowers the session's bound on a batch's bytes to BATCH_BYTES, if it is above: rows of whole texts are wide.
    """
    session = SparkSession.getActiveSession()
    if session is not None and int(session.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        session.conf.set(_BATCH, str(BATCH_BYTES))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def stir(h: np.ndarray) -> np.ndarray:
    """A shorter mix() for what is hashed already: sums of its values tell sets apart, and its low and high bits are both fit for use."""
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    return h


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)), offsets


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `size` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def _blocks(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that end at white space or at the end of a row."""
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + BLOCK_BYTES, end)
        if hi < end:
            stop, at = int(offsets[np.searchsorted(offsets, hi)]), hi
            while at < stop:
                found = np.flatnonzero(apart[data[at : min(at + 4096, stop)]])
                if len(found):
                    at += int(found[0])
                    break
                at = min(at + 4096, stop)
            hi = at
        yield lo, hi
        lo = hi


def _eights(data: np.ndarray, lower: bool) -> np.ndarray:
    """At each byte the number that it and the seven after it make (zeros after the end), A-Z in lower case if asked for."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    if lower:
        np.take(LOWER, data, out=padded[: len(data)])
    else:
        padded[: len(data)] = data
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def _further(starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of eight bytes beyond the first of each stretch: the longer stretches, where each one's blocks begin, and of each block its number, place and bytes."""
    long = np.flatnonzero(size > 8)
    count = (size[long] - 1) // 8
    first = np.cumsum(count) - count
    k = np.arange(int(count.sum())) - np.repeat(first, count) + 1
    return long, first, k, np.repeat(starts[long], count) + 8 * k, np.minimum(np.repeat(size[long], count) - 8 * k, 8)


def _hashes(eights: np.ndarray, starts: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of stretches of bytes: each block of eight goes through mix() under a key of its place, and the sum and the length through mix() again.

    mix() is one to one, so stretches of one length up to eight bytes never share a hash, and no pattern of longer ones cancels out.
    """
    key = lambda k: mix(np.asarray(k, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(2 * seed + 1))
    total = mix((eights[starts] & _FIRST[np.minimum(size, 8)]) ^ key([0]))
    long, first, k, at, left = _further(starts, size)
    if len(long):
        total[long] += np.add.reduceat(mix((eights[at] & _FIRST[left]) ^ key(k)), first)
    return mix(total + size.astype(np.uint64) * np.uint64(_BASE))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches data[start:end]."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    low = int(starts.min())
    return _hashes(_eights(data[low : int(ends.max())], False), starts - low, ends - starts)


def segments(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of rows with at most `size` bytes, each with its offsets; a longer row comes alone and in parts of about `size` bytes, cut where a word ends before white space."""
    for lo, hi in slices(offsets, size):
        begin, end = int(offsets[lo]), int(offsets[hi])
        while end - begin > size and hi == lo + 1:
            at, cut = begin + size, 0
            while at < end and not cut:
                apart = SPACE[data[at - 1 : min(at + 4096, end)]]
                found = np.flatnonzero(apart[1:] & ~apart[:-1])
                cut = at + int(found[0]) if len(found) else 0
                at += 4096
            if not cut:
                break
            yield lo, hi, np.array([begin, cut])
            begin = cut
        yield lo, hi, np.concatenate([[begin], offsets[lo + 1 : hi + 1]])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the rows, cut at the bytes marked in `apart`: 64-bit hashes, starts and ends in `data`, and for each row the range of its words (n + 1 bounds)."""
    parts = []
    for lo, hi in _blocks(data, offsets, apart):
        block = data[lo:hi]
        inside = ~apart[block]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        cut = offsets[np.searchsorted(offsets, lo, side="right") : np.searchsorted(offsets, hi)] - lo  # rows that begin inside the block
        before[cut] = False
        after[cut - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        parts.append((_hashes(_eights(block, lower), starts, ends - starts), starts + lo, ends + lo))
    if parts:
        h, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        h, starts, ends = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return h, starts, ends, np.searchsorted(starts, offsets)


def distinct(h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches data[start:end] told apart: the position of one of each, each stretch's place among those, and second hashes of those.

    Hashes only bring equal stretches together; whether they are equal is read from their bytes (and from `also`).
    """
    if not len(h):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    _, at, back = np.unique(h, return_index=True, return_inverse=True)
    low = int(starts.min())
    eights = _eights(data[low : int(ends.max())], lower)
    one, two, size = starts - low, starts[at][back] - low, ends - starts
    differ = (size != size[at][back]) | ((eights[one] ^ eights[two]) & _FIRST[np.minimum(size, 8)] != 0)
    if also is not None:
        differ |= also != also[at][back]
    fine = np.flatnonzero(~differ & (size > 8))
    long, first, _, places, left = _further(one[fine], size[fine])
    if len(long):
        shift = np.repeat((two - one)[fine][long], np.diff(np.append(first, len(places))))
        differ[fine[long]] |= np.add.reduceat((eights[places] ^ eights[places + shift]) & _FIRST[left] != 0, first, dtype=np.int64) > 0
    wrong = np.flatnonzero(differ)
    if len(wrong):  # two stretches with one hash
        known: dict[tuple, int] = {}
        more = []
        for i in wrong.tolist():
            raw = data[starts[i] : ends[i]]
            name = (LOWER[raw] if lower else raw).tobytes(), None if also is None else also[i]
            if name not in known:
                known[name] = len(at) + len(more)
                more.append(i)
            back[i] = known[name]
        at = np.concatenate([at, np.array(more, dtype=at.dtype)])
    return at, back, _hashes(eights, one[at], size[at], 1)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word with the white space before it: hashes of both together, starts (of the white space) and ends, row bounds, and the rows that end in white space (or hold nothing else)."""
    h, starts, ends, bounds = words(data, offsets)
    begin = np.empty_like(starts)
    begin[1:] = ends[:-1]
    has = bounds[1:] > bounds[:-1]
    begin[bounds[:-1][has]] = offsets[:-1][has]
    gap = starts - begin
    code = np.zeros(len(h), dtype=np.uint64)
    code[gap == 1] = data[begin[gap == 1]]
    code[gap > 1] = hashes(data, begin[gap > 1], starts[gap > 1]) | np.uint64(256)
    last = offsets[:-1].copy()
    last[has] = ends[bounds[1:][has] - 1]
    return mix(h + (code + np.uint64(1)) * np.uint64(_BASE)), begin, ends, bounds, np.flatnonzero(offsets[1:] > last)


class Memo:
    """Values of pairs of 64-bit keys (two hashes of one thing), kept for later batches; it starts anew where it would take more than `limit` bytes."""

    RUNS = 8

    def __init__(self, limit: int = 1 << 25):
        self.limit, self.runs = limit, []

    def get(self, keys: np.ndarray, checks: np.ndarray, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Values of the things with these keys; make(positions) returns those of things not kept, a row for each."""
        out, left = None, np.arange(len(keys))
        for own, second, values in self.runs:
            at = np.minimum(np.searchsorted(own, keys[left]), len(own) - 1)
            hit = (own[at] == keys[left]) & (second[at] == checks[left])
            if out is None:
                out = np.empty((len(keys), *values.shape[1:]), dtype=values.dtype)
            out[left[hit]] = values[at[hit]]
            left = left[~hit]
        if not len(left) and out is not None:
            return out
        made = make(left)
        if out is None:
            out = np.empty((len(keys), *made.shape[1:]), dtype=made.dtype)
        out[left] = made
        own, first = np.unique(keys[left], return_index=True)
        self.runs.append((own, checks[left][first], made[first]))
        if sum(r.nbytes for run in self.runs for r in run) > self.limit:
            self.runs.clear()
        elif len(self.runs) > self.RUNS:
            own, second, values = (np.concatenate(x) for x in zip(*self.runs, strict=True))
            own, first = np.unique(own, return_index=True)
            self.runs = [(own, second[first], values[first])]
        return out


_memos: dict[str, Memo] = {}


def memo(name: str) -> Memo:
    """This worker's memo of that name; those of other models under the same kind (before the colon) are let go."""
    if name not in _memos:
        for other in [m for m in _memos if m.split(":")[0] == name.split(":")[0]]:
            del _memos[other]
        _memos[name] = Memo()
    return _memos[name]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each row's values (along the first axis)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def ngrams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words that stay inside a row, and the position of each run's first word. A row of fewer words has none."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    factor = multipliers(n, 77)
    total = np.zeros(count, dtype=np.uint64)
    for j in range(n):
        total += h[j : j + count] * factor[j]
    valid = np.ones(len(h), dtype=bool)
    if n > 1:
        last = (bounds[1:, None] - np.arange(1, n)).ravel()  # runs that would leave their row
        valid[last[last >= 0]] = False
    at = np.flatnonzero(valid[:count])
    return mix(total[at]), at


def shingle_sets(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row its sorted distinct n-word shingles, one row after the other, and n_rows + 1 bounds. A row of 1 to n - 1 words has one shingle, the whole sequence; a row without words has none."""
    grams, at = ngrams(h, bounds, n)
    gram_bounds = np.searchsorted(at, bounds)
    parts, sizes = [], np.zeros(len(bounds), dtype=np.int64)
    factor = multipliers(n, 78)
    for row in range(len(bounds) - 1):
        lo, hi = bounds[row], bounds[row + 1]
        if hi - lo >= n:
            one = np.unique(grams[gram_bounds[row] : gram_bounds[row + 1]])
        elif hi > lo:
            one = mix(np.array([np.sum(h[lo:hi] * factor[: hi - lo], dtype=np.uint64) + np.uint64(hi - lo)], dtype=np.uint64))
        else:
            continue
        parts.append(one)
        sizes[row + 1] = len(one)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), np.cumsum(sizes)


def set_digest(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that are equal for equal sets; 0 for an empty one."""
    out = []
    for seed in (np.uint64(0x632BE59BD9B4E019), np.uint64(0xD6E8FEB86659FD93)):
        total = np.zeros(len(bounds), dtype=np.uint64)
        total[0] = 0
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ seed), dtype=np.uint64)])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def minhashes(values: np.ndarray, bounds: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n minimum hashes (32 bits) of each row's values, rows x n. All ones for a row without values."""
    out = np.full((len(bounds) - 1, n), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        low = values.astype(np.uint32)
        high = (values >> np.uint64(32)).astype(np.uint32)
        a, b = multipliers(n, seed).astype(np.uint32) | np.uint32(1), multipliers(n, seed + 1).astype(np.uint32)
        starts = bounds[:-1][full]
        for j in range(n):
            x = (low ^ b[j]) * a[j]
            x ^= high
            x *= a[n - 1 - j]
            out[full, j] = np.minimum.reduceat(x, starts)
    return out


#: Bins of a one-permutation sketch; the value of an empty one; bins that an empty one looks into, in order.
BINS, EMPTY = 256, np.uint32(0xFFFFFFFF)
_PROBES = np.random.Generator(np.random.PCG64(31)).integers(0, BINS, (12, BINS))


def one_permutation(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """One-permutation MinHash, BINS x rows: the least hash (32 bits) in each of a row's BINS bins. Empty bins borrow by a fixed probing order, so that two rows agree in a bin with the probability of their similarity. A row without values is all EMPTY."""
    out = np.full(BINS * rows, EMPTY, dtype=np.uint32)
    np.minimum.at(out, (values & np.uint64(BINS - 1)).view(np.int64) * rows + row, (values >> np.uint64(33)).astype(np.uint32))
    full = np.zeros(rows, dtype=bool)
    full[row] = True
    own = out.copy()
    square, grid = out.reshape(BINS, rows), own.reshape(BINS, rows)
    signed, lent, empty = square.view(np.int32), np.empty((BINS, rows), dtype=np.int32), np.empty((BINS, rows), dtype=np.int32)
    for probe in _PROBES:  # hashes have 31 bits, so the sign tells which bins are empty
        np.right_shift(signed, 31, out=empty)
        np.take(grid.view(np.int32), probe, axis=0, out=lent, mode="clip")
        lent ^= signed
        lent &= empty
        signed ^= lent
    left = np.flatnonzero((square == EMPTY).any(axis=0) & full)
    if len(left):  # what is empty then takes the next full bin below it
        some = grid[:, left]
        below = np.where(some != EMPTY, np.arange(BINS, dtype=np.int16)[:, None], np.int16(-1))
        np.maximum.accumulate(below, axis=0, out=below)
        below = np.where(below < 0, below[-1], below)
        mine = square[:, left]
        square[:, left] = np.where(mine == EMPTY, np.take_along_axis(some, below.astype(np.intp), axis=0), mine)
    return square


def sketch_bits(sketch: np.ndarray) -> np.ndarray:
    """Two bits of each bin, packed into BINS / 32 longs a row; two rows agree in both with probability similarity + (1 - similarity) / 4."""
    two = ((sketch * np.uint32(0x9E3779B1) ^ sketch >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(30)).astype(np.uint8)
    four = two[0::4] | two[1::4] << 2 | two[2::4] << 4 | two[3::4] << 6
    return np.ascontiguousarray(four.T).view(np.int64)


def worded_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row the number of its \\n-cut lines with a word."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if lo == hi:
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    block = data[lo:hi]
    begins = np.unique(np.concatenate([offsets[:-1][offsets[1:] > offsets[:-1]] - lo, np.flatnonzero(block[:-1] == 10) + 1]))
    filled = np.logical_or.reduceat(~SPACE[block], begins)
    upto = np.concatenate([[0], np.cumsum(filled)])
    at = np.searchsorted(begins, offsets - lo)
    return upto[at[1:]] - upto[at[:-1]]


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
