"""Line dedup: fuzzy lines by MinHash.

A line (24 characters or more) is its set of 5-character shingles, A-Z in lower case. Two lines are linked at a Jaccard
similarity that one changed word of sixteen letters or two of six leave (they break WORD shingles of either line), from 0.6 for short
lines rising to 0.8 for long ones, by the size of the larger set. Lines with equal shingles collapse first. Signatures come from
one-permutation hashing, one hash a shingle whatever their length, and are cut into bands of 4, of which a line has as many
as its similarity needs: a pair at the threshold shares none with probability 0.02, and none but a few above it.
Candidates are confirmed by exact Jaccard on their shingle sets, links are joined by distributed union-find, and of each component the first line
(by doc_id, then position) stays. Shorter lines with a word can take part by their whole text: of equal ones the first stays.

A line goes by 64 bits of a digest; where 64 more bits tell lines of one digest apart, none of them is taken for another, and all stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .linking import BITS, classes, restrict, written
from .scratch import drop

SHINGLE, MIN_CHARS = 5, 24
#: Least and greatest similarity (percent) that links, and shingles that changed words break.
LEAST, MOST, WORD = 60, 80, 20
#: Hashes of a band, and the probability that a pair at the threshold shares no band.
ROWS, MISSED = 4, 0.02
#: Bands for similarities from each step of five percent on.
BANDS = {p: math.ceil(math.log(MISSED) / math.log(1 - (p / 100) ** ROWS)) for p in range(LEAST, MOST + 1, 5)}
#: Bytes of text at a time: what stays in a core's cache.
SLICE = 1 << 16
#: Lines sketched at a time (a kilobyte each), however many a text has.
LINES = 1 << 13
#: Lines whose texts are looked up by a broadcast: some 20 MB as a hash table. More are shuffled.
BROADCAST_LINES = 500_000
#: Bytes of the removed lines' positions that dedup_lines() may broadcast, and what a text's row in the hash table takes beside 4 a line. More are shuffled.
BROADCAST_BYTES, ROW_BYTES = 24 << 20, 100


def _points(text: str) -> np.ndarray:
    """Code points, A-Z in lower case."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)


def _shingles(points: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE characters from each position on."""
    wide = points.astype(np.uint64)
    count = max(0, len(wide) - SHINGLE + 1)
    h = wide[:count].copy()
    for j in range(1, SHINGLE):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[j : j + count]
    return K.stir(h)


def _percent(larger: Column) -> Column:
    """The similarity that links two lines, by the size of the larger set."""
    return F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.floor((larger - WORD) * 100 / (larger + WORD))))


def percent_of(larger: np.ndarray | int) -> np.ndarray:
    """_percent() of sizes in a task."""
    return np.clip(100 * (larger - WORD) // (larger + WORD), LEAST, MOST)


def _short_lines(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the `\\n`-cut lines of `text` with a word and fewer than MIN_CHARS characters: positions, and two 64-bit digests of the whole line."""
    points = _points(text)
    cuts = np.flatnonzero(points == 10)
    starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(points)]])
    filled = np.concatenate([[0], np.cumsum((points != 32) & ((points < 9) | (points > 13)))])
    takes = np.flatnonzero((ends - starts < MIN_CHARS) & (filled[ends] > filled[starts]))
    size = ends[takes] - starts[takes]
    bounds = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    if not len(takes):
        return takes, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    own = (points[place + np.repeat(starts[takes], size)].astype(np.uint64) << np.uint64(8)) + place.astype(np.uint64) + np.uint64(1)
    return takes, *(K.mix(np.add.reduceat(K.mix(own ^ seed), bounds[:-1]) ^ np.uint64(0x632BE59BD9B4E019)) for seed in (np.uint64(0), _SECOND))


#: What makes the second digest another one.
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _line_sketches(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the `\\n`-cut lines of `text` that take part, some thousands at a time: positions, two 64-bit digests of their shingle sets, set sizes and sketches."""
    points = _points(text)
    cuts = np.flatnonzero(points == 10)
    starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(points)]])
    takes = np.flatnonzero(ends - starts >= MIN_CHARS)
    for lo in range(0, len(takes), LINES):
        part = takes[lo : lo + LINES]
        first = int(starts[part[0]])
        h = _shingles(points[first : ends[part[-1]]])
        size = ends[part] - starts[part] - SHINGLE + 1
        bounds = np.concatenate([[0], np.cumsum(size)])
        own = h[np.arange(bounds[-1]) + np.repeat(starts[part] - first - bounds[:-1], size)]
        row = np.repeat(np.arange(len(part)), size)
        # each shingle once: 40 bits of a hash tell the shingles of a line apart
        keys = np.sort((row.astype(np.uint64) << np.uint64(40)) | (own >> np.uint64(24)))
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        keys = keys[new]
        n = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=len(part))
        sets, begin = keys & np.uint64((1 << 40) - 1), np.cumsum(n) - n
        digests = (K.mix(np.add.reduceat(h, begin) + n.astype(np.uint64)) for h in (K.stir(sets), K.mix(sets ^ _SECOND)))
        yield part, *digests, n, K.one_permutation(own, row, len(part))


def line_table(docs: DataFrame, short: bool = False) -> DataFrame:
    """(tkey, doc_id, line, id, other, n, keys, s0 ..): one row for each line of `docs` (doc_id, text) that takes part.

    tkey is the text's hash, id and other are digests of the line's shingles (equal for lines that have the same), keys are
    its bands, as many as its size needs, n and s0 .. its size and sketch bits. With `short`, lines of fewer than MIN_CHARS characters have rows
    too: id and other are digests of the whole line, n is 0, and they have no bands and sketch bits.
    """
    fields = [("tkey", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("id", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), *((s, pa.int64()) for s in BITS)]
    schema = pa.schema(fields)
    factors = K.multipliers(ROWS, 52)
    counts = np.array([BANDS.get(5 * i, 0) for i in range(MOST // 5 + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column(2))
            tkeys, ids = batch.column(0), batch.column(1)
            for lo, hi in K.slices(offsets, SLICE):
                # the slice's texts as one, each followed by a line feed
                texts = batch.column(2)[lo:hi].to_pylist()
                lines = np.array([t.count("\n") + 1 if t is not None else 1 for t in texts])
                whole = "\n".join(t or "" for t in texts)
                first = np.concatenate([[0], np.cumsum(lines)])
                for take, digest, other, n, sketch in _line_sketches(whole):
                    row = np.searchsorted(first, take, side="right") - 1
                    many = counts[percent_of(n) // 5]
                    bounds = np.concatenate([[0], np.cumsum(many)])
                    bands = np.empty(bounds[-1], dtype=np.int64)
                    for count in BANDS.values():
                        own = np.flatnonzero(many == count)
                        wide = sketch[: count * ROWS, own].astype(np.uint64)
                        key = sum(wide[j::ROWS] * factors[j] for j in range(ROWS)) + np.arange(1, count + 1, dtype=np.uint64)[:, None]
                        bands[bounds[own] + np.arange(count)[:, None]] = K.mix(key).view(np.int64)
                    keys = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(bands))
                    where = pa.array(row + lo)
                    columns = [tkeys.take(where), ids.take(where), take - first[row], digest.view(np.int64), other.view(np.int64), n, keys, *np.ascontiguousarray(K.sketch_bits(sketch).T)]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, (_, t) in zip(columns, fields, strict=True)], schema=schema)
                if short:
                    take, digest, other = _short_lines(whole)
                    row = np.searchsorted(first, take, side="right") - 1
                    where = pa.array(row + lo)
                    columns = [tkeys.take(where), ids.take(where), pa.array(take - first[row], pa.int32()), pa.array(digest.view(np.int64)), pa.array(other.view(np.int64)), pa.array(np.zeros(len(take), np.int64)), *(pa.nulls(len(take), t) for _, t in fields[6:])]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl_types = {pa.int32(): "int", pa.list_(pa.int64()): "array<long>"}
    ddl = ", ".join(f"{n} {ddl_types.get(t, 'long')}" for n, t in fields)
    return docs.select(F.xxhash64("text"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.task(run), ddl)


def _line_sets(texts: DataFrame) -> DataFrame:
    """(id, members): the shingle sets of lines (id, text), as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_shingles(_points(t))).view(np.int64) for t in batch.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], names=["id", "members"])

    return texts.select("id", "text").mapInArrow(K.task(run), "id long, members array<long>")


def _similar_lines(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines (of_a, of_b) are similar enough, by their whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[str, np.ndarray] = {}
            linked = []
            for one, two in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True):
                for text in (one, two):
                    if text not in sets:
                        sets[text] = np.unique(_shingles(_points(text)))
                both, either = K.jaccard(sets[one], sets[two])
                percent = int(percent_of(max(len(sets[one]), len(sets[two]))))
                linked.append(100 * both >= percent * either)
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.mapInArrow(K.task(run), "a long, b long")


def duplicate_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, tkey, line): the lines (0-based, cut at \\n) that repeat, exactly or nearly, one that stands before them.

    tkey is xxhash64 of the text that the line is in. Of each component of similar lines the first by (doc_id, line,
    tkey) is not in the result, so texts that share a doc_id are told apart. Lines of fewer than 24 characters take part
    only with `short`: those with a word then repeat one that is equal but for A-Z and a-z. Blank lines take no part; nor
    do null texts and rows with a null doc_id. Rows repeated with one doc_id and text lose the same lines. Columns
    other than doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    sketched = written(line_table(docs, short), "sketches")
    lines = written(sketched.select("tkey", "doc_id", "line", "id", "other"), "lines", sketched)
    place = F.struct("doc_id", "line", "tkey")
    same = lines.groupBy("id").agg(F.min(place).alias("at"), F.max(place).alias("last"), F.min("other").alias("one"), F.max("other").alias("two"))
    same = written(same.filter("one = two").select("id", "at", "last"), "same", lines)

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = written(restrict(same.select("id", "at"), ids, "id").groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.tkey").alias("tkey")).agg(F.collect_list(F.struct("id", "at.line")).alias("want")), "wanted", same)
        few = ids.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
        own = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").join(F.broadcast(wanted) if few else wanted, ["doc_id", "tkey"])
        cut = own.select("want", F.split("text", "\n").alias("cut"))
        return cut.select(F.explode(F.transform("want", lambda w: F.struct(w.id.alias("id"), F.get("cut", w.line).alias("text")))).alias("w")).select("w.id", "w.text").dropDuplicates(["id"])

    def confirm(pairs: DataFrame) -> DataFrame:
        ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids", same)
        texts = written(texts_of(ids), "texts")
        a, b = (texts.select(F.col("id").alias(c), F.col("text").alias(f"of_{c}")) for c in "ab")
        return _similar_lines(pairs.join(b, "b").join(a, "a"))

    _, roots = classes(sketched.filter("n > 0"), lambda ids: _line_sets(texts_of(ids)), _percent, confirm, (sketched,), sketched, percent_of)
    rooted = same.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = rooted.groupBy("root").agg(F.min("at").alias("first"), F.max("last").alias("last")).filter("first <> last").select("root", "first")
    touched = written(rooted.select("id", "root").join(groups, "root").select("id", "first"), "touched", same)
    gone = written(lines.select("doc_id", "tkey", "line", "id").join(touched, "id").filter(F.col("first") != place).select("doc_id", "tkey", "line").distinct(), "gone", lines)
    drop(lines, same, touched)
    return gone


def dedup_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """`docs` (doc_id, text, ...) without its duplicate lines (duplicate_lines), and n_lines, n_removed (longs).

    With `short`, repeats of lines under 24 characters go as well; op1_line_dedup and the pipeline ask for them.

    n_lines counts the \\n-cut lines with a word before removal. Texts without duplicate lines stay as they are, null ones too (n_lines null as 0).
    All columns of the input stay, but for former ones of these two names.
    """
    docs = docs.drop("n_lines", "n_removed")
    gone = duplicate_lines(docs, short)
    by_text = written(gone.groupBy(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_tkey")).agg(F.collect_list("line").alias("_gone")), "gone-texts", gone)
    few = (by_text.agg(F.sum(ROW_BYTES + 4 * F.size("_gone"))).first()[0] or 0) <= BROADCAST_BYTES
    of = (docs.doc_id.cast("long") == F.col("_doc")) & (F.xxhash64(docs.text.cast("string")) == F.col("_tkey"))
    joined = docs.join(F.broadcast(by_text) if few else by_text, of, "left")
    joined = joined.select(*docs.columns, "_gone")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column("text"), batch.column("_gone")
            data, offsets = K.utf8(texts)
            lines = np.concatenate([K.worded_lines(data, offsets[lo : hi + 1]) for lo, hi in K.slices(offsets)]) if batch.num_rows else np.zeros(0, dtype=np.int64)
            removed = pc.fill_null(pc.list_value_length(gone), 0).cast(pa.int64())
            touched = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            if len(touched):
                left = []
                for text, lost in zip(texts.take(pa.array(touched)).to_pylist(), gone.take(pa.array(touched)).to_pylist(), strict=True):
                    drop = set(lost)
                    left.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
                texts = pc.replace_with_mask(texts, gone.is_valid(), pa.array(left, texts.type))
            own = {n: batch.column(n) for n in names} | {"text": texts}
            yield pa.RecordBatch.from_arrays([*own.values(), pa.array(lines), removed], names=[*own, "n_lines", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(K.task(run), f"{schema}, n_lines long, n_removed long")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each document: its lines, how many went, and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    out = dedup_lines(docs, short=True)
    return out.select("doc_id", "n_lines", "n_removed", (F.col("n_lines") - F.col("n_removed")).alias("n_kept"), F.sha2("text", 256).alias("text_sha256"))
