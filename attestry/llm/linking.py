"""From hashed buckets to classes: candidate pairs, verified links, connected components.

No step emits all pairs of a bucket up front. Every member is first compared with its bucket's leader, the one
that meets most others over all buckets (of a group of copies, its centre), which settles buckets whose members
really are alike. What the leaders leave apart is compared across the classes found so far, so no link inside a
bucket is lost; a pair is made only if sizes and 512-bit sketches leave its similarity possible and, for sets of
up to SMALL members, which travel with the rows, if it is a link. Of buckets of up to FEW ids the pairs whose sizes leave them
possible are made at once where the ids meet, and these buckets take no part in the rest. A large bucket is cut into blocks whose pairs are
keys of their own, so that a task holds two blocks of it; comparing k members of different classes still takes k * k / 2
comparisons of sketches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .kernels import BINS
from .scratch import drop
from .scratch import written as _written

#: Ids that restrict() may broadcast: half a million longs are some 30 MB as a hash table. More are shuffled.
BROADCAST_IDS = 500_000
ROUNDS = 60
BITS = [f"s{i}" for i in range(BINS // 32)]
#: Standard deviations that a sketch may fall short by: 5 pairs in 10,000 at the very threshold, fewer above.
SLACK = 3.3
#: Members (longs) of a set that is compared inside the join of a bucket's classes.
SMALL = 1024
#: Members of a bucket that meet as one block.
BLOCK = 2048
#: Members up to which a bucket's pairs are made before their sets are compared.
FEW_LEFT = 64
#: Ids up to which a bucket's pairs are made where its ids meet: at most (FEW - 1) / 2 for each of them.
FEW = 8
#: Steps of sizes to a factor of two, and bits of a size in such steps.
SIZE_STEPS, SIZE_BITS = 12, 8
#: Pairs of key and id that a task packs at a time, and that meet in a partition (16 bytes each, some three times that while sorted).
BATCH_PAIRS, PART_PAIRS = 1 << 20, 1 << 22


#: Bytes of the tables that a step reads for each task that writes its result, and such tasks at least.
TASK_BYTES, LEAST_TASKS = 1 << 22, 12


def size_of(*tables: DataFrame) -> int:
    """Bytes of written tables."""
    spark = tables[0].sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(t.__dict__["written_to"]) for t in tables]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in paths)


def written(df: DataFrame, name: str, *read: DataFrame) -> DataFrame:
    """`df`, written in tasks by the bytes of the tables `read` that it comes from, so that small steps don't leave a file for each shuffle partition and the driver isn't told of as many tasks.

    Only for steps whose result is about as large as what they read, not for those that read texts by ids."""
    return _written(df.coalesce(max(LEAST_TASKS, -(-size_of(*read) // TASK_BYTES))) if read else df, name)


def restrict(df: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of `df` whose `key` is in the written table `ids` (distinct). The ids are broadcast only when counted to at most `bound`."""
    n = ids.limit(bound + 1).count()
    return df.join(F.broadcast(ids) if n <= bound else ids, key, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find over edges (a, b) of longs, a written table: (node, root) with the smallest id of each node's component.

    Each round hooks every node to the smallest root among its neighbours, then halves paths (root of the root).
    The aggregations combine on the map side and the joins are plain shuffle joins that adaptive execution can
    split, so a hub with very many edges isn't gathered. Rounds grow with the log of the longest path.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", edges)
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots", both)
    before = roots
    for _ in range(ROUNDS):
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = written(hooked.join(up, "root", "left").select("node", "old", F.least("root", "above").alias("root")), "roots", both)
        drop(before)
        before, roots = after, after.select("node", "root")
        if after.filter("root <> old").isEmpty():
            drop(both)
            return roots
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


#: A similarity in percent, or one by the size of a pair's larger set.
Percent = int | Callable[[Column], Column]


def _least(percent: Percent, a: Column, b: Column) -> Column:
    return percent(F.greatest(a, b)) if callable(percent) else F.lit(percent)


def possible(x: str, y: str, percent: Percent) -> Column:
    """Whether rows x and y (aliases; n and the sketch bits) can have a similarity of `percent` or more."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = F.lit(0)
    for s in BITS:
        x_or = F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))
        apart = apart + F.bit_count(x_or.bitwiseOR(F.shiftrightunsigned(x_or, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    percent = _least(percent, nx, ny)
    p = percent / 100 + (1 - percent / 100) / 4
    filled = 0.8 * BINS * (1 - F.exp(-F.least(nx, ny) / BINS))  # bins that count on their own, with room for borrowed ones
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (apart <= BINS * (1 - p + SLACK * F.sqrt(p * (1 - p) / filled)))


def similar(pairs: DataFrame, sets: DataFrame, percent: Percent) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union. sets: (id, members), each member (a long) once."""
    a, b = (sets.select(F.col("id").alias(c), F.col("members").alias(f"of_{c}")) for c in "ab")
    return pairs.join(b, "b").join(a, "a").filter(_linked(F.col("of_a"), F.col("of_b"), percent)).select("a", "b")


def _linked(a: Column, b: Column, percent: Percent) -> Column:
    """100 * intersection >= percent * union, for sets that aren't empty, with the intersection written (and so computed) once."""
    percent = _least(percent, F.size(a), F.size(b))
    return (100 + percent) * F.size(F.array_intersect(a, b)) >= percent * (F.size(a) + F.size(b))


def _size_level(n: np.ndarray) -> np.ndarray:
    """Sizes in steps that fit SIZE_BITS."""
    return np.minimum(np.floor(SIZE_STEPS * np.log2(np.maximum(n, 1))), (1 << SIZE_BITS) - 1).astype(np.uint64)


def shared_keys(keyed: DataFrame, least: int | None = None) -> DataFrame:
    """(key, id, many): the keys of `keyed` (id: a long, keys: an array of distinct longs) that two ids or more have, and how many have them in what was seen together.

    Rows repeated under one id count once. A batch of rows sends each of its keys to the key's place once, packed with
    those of the same place; where the batch itself has a key twice, its ids are known to share it and need no meeting.
    So a key that very many ids have costs a place one entry a batch, and memory follows the number of places. Of a key
    the highest 32 bits below its place's are kept: a place holds half a million, so about one in ten thousand is taken
    for another, which makes candidates and no links.

    With `least`, a similarity in percent, `keyed` has the sizes n too. Of keys that up to FEW ids have the
    pairs come instead, if the smaller size is `least` percent of the larger: key and id are then a pair's ids, the smaller first, and many is 0.
    """
    pairs = keyed.agg(F.sum(F.size("keys")).alias("n")).first()["n"] or 0
    parts = max(1, -(-pairs // PART_PAIRS))
    bits = max(1, (8 * parts - 1).bit_length())
    low = np.uint64((1 << (32 - min(bits, 31))) - 1)
    level_bits = np.uint64((1 << SIZE_BITS) - 1)
    # the last level holds all larger sizes, and rounding may part two sizes by one step more
    apart = None if least is None or low < level_bits else int(SIZE_STEPS * np.log2(100 / least)) + 2

    def packed(ids: np.ndarray, keys: np.ndarray, sizes: np.ndarray, levels: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
        _, at = np.unique(ids, return_index=True)
        once = np.zeros(len(ids), dtype=bool)
        once[at] = True
        keys, ids = keys[np.repeat(once, sizes)] & ~low | np.repeat(levels[once], sizes[once]), np.repeat(ids[once], sizes[once])
        order = np.argsort(keys)
        sized, ids = keys[order], ids[order]
        keys = sized & ~low
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        many = np.diff(np.append(first, len(keys)))
        # where pairs are made of few ids, all those of a key go to its place, as far as they may be few
        twice = np.repeat(many > (1 if apart is None else FEW), many)
        sent = ~twice
        sent[first] = True
        count = np.where(twice, np.repeat(many, many), 1)
        for own, of, count, sure in ((sized[sent], ids[sent], count[sent], False), (keys[twice], ids[twice], np.repeat(many, many)[twice], True)):
            place = (own >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)
            ends = np.append(cuts, len(own)).astype(np.int32)
            blobs = [pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(np.ascontiguousarray(x))]) for x in (own, of, np.minimum(count, 1 << 30).astype(np.int32))]
            # what is sure needs no meeting, so it goes anywhere
            where = K.mix(place[cuts].astype(np.uint64) + np.uint64(turn << 32)).astype(np.int64) & ((1 << bits) - 1) if sure else place[cuts]
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(np.full(len(cuts), sure)), *blobs], names=["place", "sure", "keys", "ids", "many"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        total = turn = 0
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids, keys = batch.column(0).to_numpy(), lists.values.to_numpy().view(np.uint64)
            levels = np.zeros(len(ids), dtype=np.uint64) if apart is None else _size_level(batch.column(2).to_numpy())
            for lo, hi in K.slices(offsets, BATCH_PAIRS):
                held.append((ids[lo:hi], keys[offsets[lo] : offsets[hi]], np.diff(offsets[lo : hi + 1]), levels[lo:hi]))
                total += int(offsets[hi] - offsets[lo])
                if total >= BATCH_PAIRS:
                    yield from packed(*(np.concatenate(x) for x in zip(*held, strict=True)), turn)
                    held, total, turn = [], 0, turn + 1
        if total:
            yield from packed(*(np.concatenate(x) for x in zip(*held, strict=True)), turn)

    def met(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, ids, many = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(keys)
        sized, ids, many = keys[order], ids[order], many[order]
        keys = sized & ~low
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(first, len(keys)))
        total = np.add.reduceat(many, first)
        shared = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)) | (np.maximum.reduceat(many, first) > 1)
        if apart is not None:
            # of what is shared, each id once
            own = np.flatnonzero(np.repeat(shared, size))
            if not len(own):
                return
            own = own[np.lexsort((ids[own], sized[own]))]
            sized, ids, many = sized[own], ids[own], many[own]
            new = np.ones(len(own), dtype=bool)
            new[1:] = (sized[1:] != sized[:-1]) | (ids[1:] != ids[:-1]) | (many[1:] > 1) | (many[:-1] > 1)
            sized, ids, many = sized[new], ids[new], many[new]
            keys = sized & ~low
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(first, len(keys)))
            total = np.add.reduceat(many, first)
            shared = np.ones(len(first), dtype=bool)
            few = shared & (size <= FEW) & (np.maximum.reduceat(many, first) == 1)
            shared &= ~few
            own = np.flatnonzero(np.repeat(few, size))
            after = (np.repeat(first + size, size)[own] - own - 1).astype(np.int64)  # of a bucket's ids, those behind this one
            one = np.repeat(own, after)
            two = one + np.arange(len(one)) - np.repeat(np.cumsum(after) - after, after) + 1
            level = (sized & level_bits).astype(np.int64)
            fit = ((level[two] - level[one] <= apart) | (level[two] == int(level_bits))) & (ids[one] != ids[two])
            one, two = ids[one[fit]], ids[two[fit]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(np.zeros(len(one), np.int64))], names=["key", "id", "many"])
        out = np.repeat(shared, size) & (many == 1)
        yield pa.RecordBatch.from_arrays([pa.array(keys[out].view(np.int64)), pa.array(ids[out]), pa.array(np.repeat(total, size)[out].astype(np.int64))], names=["key", "id", "many"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        now = None
        for batch in batches:
            for place, sure, keys, ids, many in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns)), strict=True):
                row = tuple(np.frombuffer(x.as_buffer(), dtype=t) for x, t in ((keys, np.uint64), (ids, np.int64), (many, np.int32)))
                if sure:
                    yield pa.RecordBatch.from_arrays([pa.array(row[0].view(np.int64)), pa.array(row[1]), pa.array(row[2].astype(np.int64))], names=["key", "id", "many"])
                    continue
                if place != now and rows:
                    yield from met(rows)
                    rows = []
                now = place
                rows.append(row)
        if rows:
            yield from met(rows)

    sent = keyed.select("id", "keys", *(["n"] if apart is not None else [])).mapInArrow(K.task(send), "place int, sure boolean, keys binary, ids binary, many binary")
    return sent.repartition(parts, "place").sortWithinPartitions("place").mapInArrow(K.task(meet), "key long, id long, many long").groupBy("key", "id", (F.col("many") == 0).alias("_pair")).agg(F.max("many").alias("many")).drop("_pair")


def _met(x: DataFrame, y: DataFrame, how: str, also: Column) -> DataFrame:
    """Rows of x joined with those of y (as "x" and "y") in one bucket and block pair, of different classes, that may be similar enough.

    Dealt by bucket and block pair beforehand: these are bounded, so no partition needs to be split, which would pair every piece of one side with every piece of the other.
    """
    place = ["key", "low", "high"]
    x, y = x.repartition(*place).alias("x"), y.repartition(*place).alias("y")
    keys = (F.col("x.key") == F.col("y.key")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
    once = (F.col("x.low") == F.col("x.high")) | (F.col("x.block") != F.col("y.block"))  # members of one block meet in its own pair alone
    return x.join(y, keys & once & (F.col("x.root") != F.col("y.root")) & also, how)


def _blocks(rows: DataFrame) -> DataFrame:
    """`rows` (key, id, many, ...) once for each pair of blocks (low, high) of their bucket that they take part in: a bucket has a block for every BLOCK members."""
    count = F.ceil(F.col("many") / BLOCK)
    own = rows.withColumn("block", F.pmod(F.xxhash64("id"), count))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).drop("other", "many")


def _cell_links(held: DataFrame, percent_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b), a < b: the links between rows `held` (key, low, high, block, id, root, members) of one bucket and block pair and of different classes, by their whole sets.

    A task holds one bucket and block pair at a time. Each row's members are marked and the others' marks counted, some nanoseconds a member.
    """

    def compared(ids: np.ndarray, roots: np.ndarray, blocks: np.ndarray, across: bool, members: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(blocks, kind="stable")
        ids, roots, blocks, members = ids[order], roots[order], blocks[order], [members[i] for i in order]
        size = np.array([len(m) for m in members])
        bounds = np.concatenate([[0], np.cumsum(size)])
        named, codes = np.unique(np.concatenate(members), return_inverse=True)
        marks = np.zeros(len(named), dtype=np.uint8)
        second = int(np.searchsorted(blocks, blocks[0], side="right"))
        one, two = [], []
        for i in range(second if across else len(ids) - 1):
            j = second if across else i + 1  # members of one block meet in its own pair alone
            if j == len(ids):
                break
            own = codes[bounds[i] : bounds[i + 1]]
            marks[own] = 1
            both = np.add.reduceat(marks[codes[bounds[j] :]], bounds[j:-1] - bounds[j], dtype=np.int64)
            marks[own] = 0
            linked = (100 * both >= percent_of(np.maximum(size[i], size[j:])) * (size[i] + size[j:] - both)) & (roots[j:] != roots[i])
            at = j + np.flatnonzero(linked)
            one.append(np.minimum(ids[i], ids[at]))
            two.append(np.maximum(ids[i], ids[at]))
        pairs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def ended() -> pa.RecordBatch:
            ids, roots, blocks, members = ([x for p in parts for x in p[i]] for i in range(4))
            return compared(np.array(ids, np.int64), np.array(roots, np.int64), np.array(blocks, np.int64), now[1] != now[2], members)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, lo, hi, blocks, ids, roots = (batch.column(i).to_numpy() for i in range(6))
            new = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            lists = batch.column(6)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for begin, end in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                cell = int(key[begin]), int(lo[begin]), int(hi[begin])
                if cell != now and parts:
                    yield ended()
                    parts = []
                now = cell
                parts.append((ids[begin:end], roots[begin:end], blocks[begin:end], [values[offsets[i] : offsets[i + 1]].copy() for i in range(begin, end)]))
        if parts:
            yield ended()

    place = ["key", "low", "high"]
    dealt = held.select(*place, "block", "id", "root", "members").repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(K.task(run), "a long, b long")


def classes(sketches: DataFrame, members: Callable[[DataFrame], DataFrame], percent: Percent, confirm: Callable[[DataFrame], DataFrame] | None = None, spent: tuple[DataFrame, ...] = (), source: DataFrame | None = None, percent_of: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of ids that share a key: links and components.

    sketches: rows (id, keys: the buckets that the id is in, n, s0 ..: the set size and sketch bits); equal
    rows may repeat; `source` is the written table that they are read from. `spent` are tables to delete once the sketches have been read. confirm(pairs) returns those of
    (a, b) that are links, by default told from their members. members(ids) takes a table of distinct ids (id) and returns their sets (id, members), none of them
    empty. percent_of is `percent` for sizes in a task, needed only if that isn't a number; it must not fall. Returns the links (a, b), a < b, that were compared and found, and (node, root) for every linked id; ids
    without a link are in neither. A bucket of one id makes nothing.
    """
    read = [source] if source is not None else []
    share = percent_of or (lambda larger: np.full(np.shape(larger), percent))
    shared = written(shared_keys(sketches.select("id", "keys", "n"), int(share(np.array([1]))[0])), "shared", *read)
    paired, gathered = shared.filter("many = 0").select(F.col("key").alias("a"), F.col("id").alias("b")), shared.filter("many > 0")
    once = shared.select("id", "many").unionByName(paired.select(F.col("a").alias("id"), F.lit(0).cast("long").alias("many")))
    met = written(once.groupBy("id").agg(F.sum("many").alias("met")), "met", shared)
    known = written(restrict(sketches.select("id", "n", *BITS), met.select("id"), "id").dropDuplicates(["id"]), "known", *read)
    drop(*spent)
    confirm = confirm or (lambda pairs: _confirmed(pairs, members, percent))
    lead = gathered.select("key", "id").join(met, "id").groupBy("key").agg(F.count("*").alias("many"), F.max(F.struct("met", (-F.col("id")).alias("minus"))).alias("lead"))
    lead = written(lead.select("key", "many", (-F.col("lead.minus")).alias("lead")), "leaders", shared)
    drop(met)
    led = gathered.join(lead, "key").filter("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).unionByName(paired).distinct()
    x, y = known.alias("x"), known.alias("y")
    pairs = led.join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & possible("x", "y", percent))
    pairs = written(pairs.select("a", "b"), "pairs", shared, known)
    links = written(confirm(pairs), "links", pairs)
    drop(pairs)
    roots = components(links)

    # Buckets that still hold more than one class: compare the members of different classes. Members and leaders were compared above.
    placed = gathered.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    placed = written(placed.join(lead.filter("many > 2"), "key"), "placed", shared)
    drop(shared, lead)
    mixed = written(placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key"), "mixed-keys", placed)
    mixed_rows = written(restrict(placed, mixed, "key").filter("id <> lead").drop("lead").join(known, "id"), "mixed", placed, known)
    drop(placed, mixed, known)
    if mixed_rows.isEmpty():
        drop(mixed_rows)
        return links, roots
    # first the ids that any other may be similar to, a row at most for each row here; in crowded buckets their sets, if small, travel with them to the second comparison
    near = written(_met(_blocks(mixed_rows), _blocks(mixed_rows), "left_semi", possible("x", "y", percent)).select("id").distinct(), "near", mixed_rows)
    rows = restrict(mixed_rows, near, "id")
    rows = written(rows.join(rows.groupBy("key").agg(F.count("*").alias("now")), "key"), "near-rows", mixed_rows)
    drop(mixed_rows, near)
    if rows.isEmpty():
        drop(rows)
        return links, roots
    # where few are left in a bucket their pairs are no more than FEW_LEFT / 2 for each of them
    few = _blocks(rows.filter(F.col("now") <= FEW_LEFT))
    later = (F.col("x.id") < F.col("y.id")) & possible("x", "y", percent)
    told = written(_met(few, few, "inner", later).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "pairs", rows)
    crowded = rows.filter(F.col("now") > FEW_LEFT)
    if crowded.isEmpty():
        more = written(confirm(told), "links", told)
    else:
        ids = written(crowded.filter(F.col("n") <= SMALL).select("id").distinct(), "ids", rows)
        small = _written(members(ids), "sets")
        inside = written(_cell_links(_blocks(crowded.select("key", "id", "many", "root")).join(small, "id"), share).distinct(), "links", rows, small)
        # pairs with a set too large to travel are told from their texts
        large = (F.col("x.n") > SMALL) & ((F.col("y.n") <= SMALL) | (F.col("x.id") < F.col("y.id")))
        held = _blocks(crowded)
        open_pairs = _met(held.filter(F.col("n") > SMALL), held, "inner", large & possible("x", "y", percent))
        open_pairs = written(open_pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).unionByName(told).distinct(), "pairs", rows, told)
        drop(ids, small)
        more = written(inside.unionByName(confirm(open_pairs)).distinct(), "links", inside, open_pairs)
        drop(inside, open_pairs)
    drop(told, rows)
    if more.isEmpty():
        return links, roots
    # the classes found so far are the nodes of a second, small graph
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    above = components(written(between.filter("a <> b").distinct(), "between", more)).select(F.col("node").alias("root"), F.col("root").alias("above"))
    nodes = roots.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    merged = written(nodes.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots", links, more)
    return links.unionByName(more), merged


def _confirmed(pairs: DataFrame, members: Callable[[DataFrame], DataFrame], percent: Percent) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    ids = _written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    return similar(pairs, _written(members(ids), "sets"), percent)
