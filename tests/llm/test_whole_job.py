"""Cases that an operator once left out: held against brute force on small tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from attestry.llm import decontam, linededup, neardup, quality

SYLLABLES = ["ka", "lo", "mi", "ten", "ru", "sha", "vor", "pel", "dun", "gri", "os", "fa"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def test_short_lines(spark):
    long = prose(random.Random(1), 30)
    rows = [(1, f"Read more\n{long}\n \nx"), (2, "READ MORE\nRead more.\n \nmore Read"), (3, "x\n\nRead more\nx\n" + "é" * 23), (4, "é" * 23), (5, "é" * 22), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup_lines(docs, short=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("Read more.\n \nmore Read", 1), 3: ("\n" + "é" * 23, 3), 4: ("", 1), 5: ("é" * 22, 0), None: ("x", 0)}
    assert {r["n_removed"] for r in linededup.dedup_lines(docs).collect()} == {0}


def test_edits_inside_lines(spark):
    rng = random.Random(2)
    lines = ["Copyright 2023 Example Media Group. All rights reserved.", "Copyright 2024 Example Media Group. All rights reserved."]
    lines += ["By Maria Kovac, staff writer, on Monday 3 May at noon", "By Maria Kovac, staff writer, on Friday 3 May at noon"]
    for size in range(30, 82, 2):
        line = prose(rng, 30)[:size]
        at = rng.randrange(size // 4, 3 * size // 4)
        word = rng.choice([w for w in line.split(" ")[1:-1] if w])
        lines += [line, line[:at] + "#" + line[at + 1 :], line.replace(word, "".join(rng.choices("bcqwxyz", k=len(word))), 1), prose(rng, 30)[:size]]
    rng.shuffle(lines)
    sets = [{x.lower()[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    root = list(range(len(lines)))
    linked = [(i, j) for i in root for j in range(i) if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])]  # all have at most 128 shingles
    for _ in lines:
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    gone = {r["doc_id"] for r in linededup.dedup_lines(docs).filter("n_removed = 1").collect()}
    assert gone == {i for i in range(len(lines)) if root[i] != i} and len(gone) > 40
    for a, b in (("2023", "2024"), ("Monday", "Friday")):
        assert sum(i in gone for i, x in enumerate(lines) if a in x or b in x) == 1


def test_passages_of_long_items(spark):
    rng = random.Random(3)
    items = [prose(rng, n).split(" ") for n in (200, 300, 400, 30)]
    part = lambda i, lo, n: " ".join(items[i][lo : lo + n])
    thinned = " ".join(w if k % 3 else "qq" for k, w in enumerate(items[2][:120]))
    texts = [
        (f"{prose(rng, 60)} {part(0, 100, 70)} {prose(rng, 60)}", [0]),
        (f"{prose(rng, 10)} {part(1, 0, 100)}", [1]),
        (part(1, 275, 25), [1]),
        (f"{prose(rng, 60)} {part(2, 200, 14)} qq {part(2, 215, 13)} {prose(rng, 60)}", [2]),
        (f"{prose(rng, 60)} {part(2, 200, 13)} qq {part(2, 214, 13)} {prose(rng, 60)}", []),
        (f"{prose(rng, 60)} {part(0, 20, 24)} {prose(rng, 60)}", []),
        (f"{thinned} {prose(rng, 60)}", []),
        (f"{part(3, 0, 15)} {prose(rng, 60)} {part(0, 0, 30)}", [0, 3]),
    ]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {i: want for i, (_, want) in enumerate(texts)}


def test_groups_with_much_junk(spark):
    rng = random.Random(4)

    def junk():
        return " ".join(w + " " + "".join(rng.choices("#*$%&|", k=rng.randint(1, 4))) if rng.random() < 0.4 else w for w in prose(rng, rng.randint(60, 300)).split(" "))

    rows = []
    for source, share in (("a", 0.35), ("b", 0.45)):
        rows += [(len(rows) + i, junk() if i < 400 * share else prose(rng, rng.randint(60, 300)), "l", source, i < 400 * share) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    for source in "ab":
        assert not [i for i, _, _, s, bad in rows if bad and s == source and kept[i]]
        clean = [kept[i] for i, _, _, s, bad in rows if not bad and s == source]
        assert sum(clean) >= 0.98 * len(clean)


def test_texts_that_share_a_doc_id(spark):
    import corpus_pipeline

    unique = " ".join(f"alone{i}" for i in range(40))
    copied = " ".join(f"shared{i}" for i in range(40))
    near = " ".join([*unique.split(" ")[:-1], "changed"])
    rows = [(1, copied), (7, copied), (7, unique), (8, near), (None, unique), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["doc_id"], r["tkey"]): (r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    told = {(r["doc_id"], r["text"]): got[r["doc_id"], r["k"]] for r in docs.withColumn("k", F.xxhash64("text")).collect()}
    assert told == {(1, copied): (1, True), (7, copied): (1, False), (7, unique): (7, True), (8, near): (7, False), (None, unique): (None, True), (9, None): (9, True)}
    left = corpus_pipeline.minhash_neardup(spark, docs, "")
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(1, copied), (7, unique), (None, unique), (9, None)], key=repr)


def test_line_thresholds_rise_smoothly():
    sizes = np.arange(20, 400)
    steps = np.diff(linededup.percent_of(sizes))
    assert linededup.percent_of(20) == 60 and linededup.percent_of(400) == 80 and steps.min() >= 0 and steps.max() <= 1
    assert linededup.BANDS[60] == 29 and linededup.BANDS[80] == 8


def test_lines_of_one_digest_are_told_apart(spark, monkeypatch):
    """Where 64 bits of a digest are equal and 64 more are not, no line goes."""
    lines = [f"line number {i} says that {w} is all there is" for i, w in enumerate(("apples", "violets"))]
    docs = spark.createDataFrame([(1, lines[0]), (2, lines[1]), (3, "x"), (4, "x")], "doc_id long, text string").coalesce(1)
    table = linededup.line_table
    monkeypatch.setattr(linededup, "line_table", lambda d, short=False: table(d, short).withColumn("id", F.when(F.col("n") > 0, F.lit(5)).otherwise(F.col("id"))))
    got = {(r["doc_id"], r["text"]) for r in linededup.dedup_lines(docs, short=True).collect()}
    assert got == {(1, lines[0]), (2, lines[1]), (3, "x"), (4, "")}
